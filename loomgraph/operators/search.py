"""Search of a text within names through an index of trigrams that is read by bucket."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.operators import tables
from loomgraph.plans import store

#: Buckets of an index, by gram.
BUCKETS = 256
_SCHEMA = "gram string, id string"


def grams(text: Column) -> Column:
    """The distinct substrings of three characters; none of a shorter text."""
    at = F.sequence(F.lit(1), F.greatest(F.length(text) - 2, F.lit(1)))
    found = F.array_distinct(F.transform(at, lambda i: F.substring(text, i, F.lit(3))))
    return F.filter(found, lambda gram: F.length(gram) == 3)


def build(nodes: DataFrame, folder: str, buckets: int = BUCKETS) -> store.Parts:
    """Write the grams of names and qualified names of ``nodes`` (id, name, qualified_name), whatever their case."""
    lower = lambda c: grams(F.lower(F.coalesce(F.col(c), F.lit(""))))
    # One row group is one task else, and a row gives many grams. A gram is once in a node's row; repeated ids may repeat it.
    cores = nodes.sparkSession.sparkContext.defaultParallelism
    nodes = nodes.repartition(cores) if nodes.rdd.getNumPartitions() < cores else nodes
    rows = nodes.select(F.explode(F.array_union(lower("name"), lower("qualified_name"))).alias("gram"), "id")
    return store.write_parts(rows, folder, "grams", store.bucket_of(F.col("gram"), buckets))


def search(spark: SparkSession, nodes: DataFrame, index: store.Parts, text: str, buckets: int = BUCKETS) -> DataFrame:
    """``tables.search`` of nodes that the index leaves: those that have every gram of ``text``.

    Only the buckets of these grams are read; a text of fewer than three characters looks at all nodes.
    """
    low = text.lower()
    asked = sorted({low[i : i + 3] for i in range(len(low) - 2)})
    if not asked:
        return tables.search(nodes, text)
    of = set(spark.range(1).select(*[store.bucket_of(F.lit(g), buckets).alias(f"of_{i}") for i, g in enumerate(asked)]).first())
    found = store.read_parts(spark, index, _SCHEMA, of).filter(F.col("gram").isin(*asked)).distinct()
    all_ = found.groupBy("id").agg(F.count("*").alias("n")).filter(F.col("n") == len(asked))
    return tables.search(nodes.join(all_, "id", "left_semi"), text)
