import numpy as np
import pytest

from loomgraph.operators import search as text_search
from loomgraph.operators import tables, vectors
from loomgraph.plans import registry


def test_nearest_to_a_missing_vector_is_empty(spark, tmp_path):
    rows = spark.createDataFrame([(1, [0.5, 0.5])], "vec_id long, embedding array<float>")
    for frame in (rows, rows.limit(0)):
        frame.write.mode("overwrite").parquet(f"{tmp_path}/embeddings.parquet")
        assert registry.QUERIES["VEC-01_top_k"](spark, str(tmp_path)).collect() == []


@pytest.mark.parametrize("query_block, block", [(1000, 20_000), (3, 17)])
def test_nearest_equals_brute_force(spark, query_block, block):
    numbers = np.random.default_rng(1)
    made = numbers.integers(-2, 3, (120, 4)).astype(float)  # many ties, some zeros
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(made)] + [(900, None)], "vec_id long, embedding array<float>").repartition(3)
    got = vectors.nearest(rows, rows.filter("vec_id % 20 = 0"), 7, query_block=query_block, block=block).collect()
    want = []
    for q in range(0, 120, 20):
        norms = np.linalg.norm(made, axis=1) * np.linalg.norm(made[q])
        like = np.where(norms > 0, made @ made[q] / np.where(norms > 0, norms, 1), 0.0)
        order = sorted(range(120), key=lambda i: (-round(like[i], 6), i))[:7]
        want += [(q, rank, i, round(like[i], 6)) for rank, i in enumerate(order, 1)]
    assert sorted((r.query_id, r.rank, r.vec_id, round(r.similarity, 6)) for r in got) == sorted(want)
    assert vectors.nearest(rows.limit(0), rows).collect() == [] and vectors.nearest(rows, rows.limit(0)).collect() == []


def test_indexed_search_equals_a_scan(spark, tmp_path):
    names = ["Spring", "RINGO", "ring", "rin", "bring.spring", "r", "", "\u00c9t\u00e9", "inring", None]
    rows = spark.createDataFrame([(f"n{i}", n, f"m.{n}") for i, n in enumerate(names)], "id string, name string, qualified_name string")
    index = text_search.build(rows, f"file://{tmp_path}/grams", 16)
    for text in ("ring", "RINGO", "ri", "", "ing.sp", "\u00e9t\u00e9", "absent", "m.r"):
        want = sorted(r.id for r in tables.search(rows, text).collect())
        assert sorted(r.id for r in text_search.search(spark, rows, index, text, 16).collect()) == want, text
    plan = text_search.search(spark, rows, index, "ring", 16)
    read = {f.rpartition("/")[0].rpartition("/")[2] for f in plan.inputFiles()}
    assert 1 <= len([f for f in read if f.startswith("bucket=")]) <= 2  # ring has two grams
