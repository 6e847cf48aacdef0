import duckdb
import pytest

from loomgraph.plans import registry
from loomgraph.plans.relations import TABLES

FOLDER = "/root/testdata/sf0.001"
#: Several seconds each; AGG-04 stands for the other uses of the inventory.
SLOW = ("AGG-05", "FLT-05", "FLT-06", "SRT-02")


def rounded(rows):
    return sorted(tuple(str(round(x, 6)) if isinstance(x, float) else str(x) for x in r) for r in rows)


@pytest.mark.parametrize("name", [n for n in registry.ORACLES if not n.startswith(SLOW)])
def test_query_equals_sql(spark, name):
    with duckdb.connect() as base:
        for t in TABLES:
            base.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
        frame = registry.QUERIES[name](spark, FOLDER)
        columns = ", ".join(sorted(frame.columns))
        assert rounded(frame.select(*sorted(frame.columns)).collect()) == rounded(base.execute(f"SELECT {columns} FROM ({registry.ORACLES[name]})").fetchall())
