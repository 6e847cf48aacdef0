"""Nearest vectors by cosine, and their surroundings in a graph."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.operators.traverse import reach
from loomgraph.schemas import DEPENDENCIES


def dot(a: Column, b: Column) -> Column:
    product = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(product, F.lit(0.0), lambda total, x: total + x)


def cosine(a: Column, b: Column) -> Column:
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms > 0, dot(a, b) / norms).otherwise(0.0)


def top_k(vectors: DataFrame, query: list[float], k: int = 40) -> DataFrame:
    """vec_id and similarity of the ``k`` vectors nearest to ``query``; of equal ones the least id."""
    against = F.array(*[F.lit(float(x)) for x in query])
    return vectors.select("vec_id", cosine(F.col("embedding"), against).alias("similarity")).orderBy(F.desc("similarity"), "vec_id").limit(k)


#: Queries and vectors that meet in one task.
QUERY_BLOCK, BLOCK = 1000, 20_000


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 40, digits: int = 6, query_block: int = QUERY_BLOCK, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, similarity of the ``k`` vectors nearest to each of ``queries`` (both vec_id, embedding).

    Queries and vectors are dealt into blocks, and every pair of blocks is one matrix product in a task
    of its own, which hands on each query's best ``k`` of that block; these are merged by query. The result is
    exact; similarities are rounded to ``digits`` before they are compared, and of equal ones the least id comes
    first. Rows without an embedding are left out, a vector of zeros has similarity 0; all have one length.
    """
    vectors, queries = (t.filter("embedding IS NOT NULL").select("vec_id", "embedding") for t in (vectors, queries))
    n_q, n_v = (max(1, -(-t.count() // size)) for t, size in ((queries, query_block), (vectors, block)))
    deal = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    rows = queries.select(deal(n_q).alias("q"), every(n_v).alias("v"), F.lit(0).alias("side"), "*").union(
        vectors.select(every(n_q).alias("q"), deal(n_v).alias("v"), F.lit(1).alias("side"), "*")
    )
    schema = "query_id long, vec_id long, similarity double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            key = np.stack([batch.column(c).to_numpy() for c in ("q", "v")], axis=1)
            cuts = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(axis=1), True]) if len(key) else []
            for low, high in zip(cuts[:-1], cuts[1:]):
                if tuple(key[low]) != now and held:
                    yield product(held)
                    held = []
                now = tuple(key[low])
                held.append(batch.slice(low, high - low))
        if held:
            yield product(held)

    def product(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        side = np.concatenate([b.column("side").to_numpy() for b in held])
        ids = np.concatenate([b.column("vec_id").to_numpy() for b in held])
        values = np.concatenate([b.column("embedding").flatten().to_numpy(zero_copy_only=False) for b in held]).astype(np.float64).reshape(len(ids), -1)
        norm = np.sqrt((values * values).sum(axis=1))
        values /= np.where(norm > 0, norm, 1)[:, None]
        asked, there = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        there = there[np.argsort(ids[there], kind="stable")]
        out: list[tuple] = []
        for q in asked if len(there) else []:
            found = np.round(values[there] @ values[q], digits) + 0.0
            if len(found) > k:
                least = np.partition(found, len(found) - k)[len(found) - k]
                close = np.flatnonzero(found >= least)
            else:
                close = np.arange(len(found))
            best = close[np.argsort(-found[close], kind="stable")][:k]
            out.append((np.full(len(best), ids[q]), ids[there[best]], found[best]))
        columns = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["query_id", "vec_id", "similarity"])

    partial = rows.repartition("q", "v").sortWithinPartitions("q", "v", "side").mapInArrow(run, schema)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "vec_id"))
    return partial.withColumn("rank", rank.cast("long")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "similarity")


def expanded(hits: DataFrame, edges: DataFrame, depth: int = 1) -> DataFrame:
    """Hits (id, similarity) and what lies within ``depth`` dependency edges of them, either way.

    id, similarity (of the best hit that leads there), distance from the nearest hit; hits have 0.
    """
    roots = hits.select(F.col("id").alias("root"), "similarity")
    ways = [reach(edges, roots.select("root"), depth, DEPENDENCIES, backward) for backward in (False, True)]
    near = ways[0].select("root", "id", "distance").union(ways[1].select("root", "id", "distance")).join(roots, "root").drop("root")
    both = near.unionByName(hits.select("id", "similarity", F.lit(0).alias("distance")))
    return both.groupBy("id").agg(F.max("similarity").alias("similarity"), F.min("distance").alias("distance"))
