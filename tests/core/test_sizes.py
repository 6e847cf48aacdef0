import cProfile
import pstats

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomgraph.functions import scalar
from loomgraph.functions.languages import PARSERS
from loomgraph.operators import history, resolve, search, tables, traverse
from loomgraph.plans import delta, index, language_queries, store


def test_sync_finds_sources_of_changed_modules_without_nested_loops(spark, tmp_path, monkeypatch):
    """F1 to F4: sources were compared with every changed module and class."""
    folder, plans, stored = f"file://{tmp_path}/graph", [], delta.stored

    def kept(frame, name):
        plans.append(frame._jdf.queryExecution().optimizedPlan().toString() + frame._jdf.queryExecution().executedPlan().toString())
        return stored(frame, name)

    files = spark.createDataFrame([(f"m{i}.py", f"class K{i}:\n    def run(self):\n        self.run()\n".encode()) for i in range(4)], "path string, content binary")
    index.save(*(lambda g, r: (g, folder, r))(*index.index_with_repeats(index.empty_graph(spark), files)), buckets=3)
    monkeypatch.setattr(delta, "stored", kept)
    paths = spark.createDataFrame([("m1.py",), ("m2.py",)], "file string")
    report = delta.sync(spark, store.read_version(spark, folder), folder, files.filter("path <> 'm2.py'").withColumn("content", F.lit(b"def run():\n    run()\n")), paths)
    assert report.version == 2 and plans and not [p for p in plans if "NestedLoop" in p or "CartesianProduct" in p]


def test_sizes_round_as_c_does(spark):
    """of two equally near decimals the even one, and the double's own value counts."""
    sizes = [0, 1023, 1024, 1024 + 256, 1024 + 768, 1280 * 7, 1048575, 1048576 * 5 // 4, 1073741824 * 9 // 4, 10**15 + 7, 641438959167919, 2**62 + 12345]
    sizes += [n * 1024 + part for n in range(1, 40) for part in (51, 52, 154, 256, 768)] + [int(1073741824 * (k + 0.05)) + d for k in range(1, 10**6, 99991) for d in (-1, 0, 1)]
    rows = spark.createDataFrame([(n,) for n in sizes], "n long").select("n", scalar.format_size(F.col("n")).alias("shown")).collect()

    def wanted(n):
        for power, unit in ((1, "KB"), (2, "MB"), (3, "GB")):
            if n < 1024 ** (power + 1) or power == 3:
                return f"{n}B" if n < 1024 else f"{float(n) / 1024.0**power:.1f}{unit}"

    assert {r["n"]: r["shown"] for r in rows} == {n: wanted(n) for n in sizes}


@pytest.mark.parametrize("order", [1, -1])
def test_of_rows_with_one_path_the_first_by_seq_counts(spark, order):
    """which of them counted was left open."""
    rows = [("a/1.md", bytearray(b"first"), 3), ("a/1.md", bytearray(b"second"), 9), ("a/1.md", bytearray(b"third"), 12), ("Z/1.md", bytearray(b"earlier path"), 1)][::order]
    files = spark.createDataFrame(rows, "path string, content binary, seq long").coalesce(1)
    ledger, _ = history.sync_folder(history.empty_ledger(spark), files, lambda diffs: diffs.select("node_id", F.lit("aceptado").alias("message")))
    digest = spark.sql("SELECT md5(CAST('first' AS BINARY))").first()[0]
    assert [tuple(r) for r in ledger.nodes.select("id", "body_hash").collect()] == [("Document:1.md", digest)]


def test_parsed_rows_are_handed_over_in_bounded_batches(monkeypatch):
    """a task built the rows of a whole batch of files, 10,000 by default, at once."""
    monkeypatch.setattr(index, "ROWS", 8)
    paths, sources = [f"p/m{i}.py" for i in range(41)], [f"def f{i}():\n    g()\n" for i in range(41)]
    seq = pa.struct([("path", pa.list_(pa.string())), ("at", pa.int32())])
    text, numbers = ("kind", "qualified_name", "file", "edge_kind", "src", "callee_name"), ("lineno", "end_lineno")
    schema = pa.schema([("is_node", pa.bool_()), *((c, pa.string()) for c in text), *((c, pa.int32()) for c in numbers), ("external", pa.bool_()), ("seq", seq)])
    batches = list(index._parse(iter([pa.RecordBatch.from_arrays([pa.array(paths), pa.array(sources)], ["path", "source"])]), schema))
    assert [b.num_rows for b in batches] == [8] * 20 + [4]
    rows = [r for b in batches for r in b.to_pylist()]
    assert [(r["file"], r["kind"], r["seq"]["at"]) for r in rows if r["is_node"]] == [(p, k, at) for p in paths for at, k in enumerate(("Module", "Function"))]
    assert [(r["seq"]["path"], r["edge_kind"], r["callee_name"], r["kind"], r["lineno"]) for r in rows if not r["is_node"]] == [
        (p.split("/"), *e, None, None) for p in paths for e in (("DEFINES", ""), ("CALLS", "g"))
    ]


def test_closure_sends_no_ids_through_the_driver(spark, monkeypatch):
    """F7 to F12: frontiers and seen ids were broadcast, up to Spark's limit of compressed size, level by level."""
    plans, cut = [], traverse.cut

    def kept(frame):
        plans.append(frame._jdf.queryExecution().executedPlan().toString())
        return cut(frame)

    monkeypatch.setattr(traverse, "cut", kept)
    edges = spark.createDataFrame([("a", "CALLS", "b", "exact", 1), ("b", "CALLS", "c", "exact", 2), ("c", "CALLS", "a", "exact", 3), ("d", "CALLS", "a", "exact", 4)], "src string, kind string, dst string, confidence string, seq long")
    found = traverse.closure(edges, spark.createDataFrame([("a",)], "id string"))
    assert sorted(r[0] for r in found.collect()) == ["a", "b", "c"]
    assert sum("SortMergeJoin" in p for p in plans) and not [p for p in plans if "Broadcast" in p]


def test_large_buckets_are_written_by_several_tasks(spark, tmp_path):
    """one task aggregated the grams of all names, and one wrote each bucket."""
    rows = spark.range(4000).select(F.concat(F.lit("n"), F.col("id") % 3990).alias("id"), F.concat(F.lit("spring"), F.col("id")).alias("name"), F.lit("m.x").alias("qualified_name"))
    size = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    spark.conf.set(size, "16k")
    try:
        parts = search.build(rows.coalesce(1), f"file://{tmp_path}/grams", 1)
    finally:
        spark.conf.unset(size)
    assert [len(of) for of in parts.values()] == [1] and len(list(tmp_path.glob("grams/data/*/grams/bucket=0/*.parquet"))) > 1
    for text in ("spring39", "G399"):
        assert sorted(r.id for r in search.search(spark, rows, parts, text, 1).collect()) == sorted(r.id for r in tables.search(rows, text).collect())


def test_edges_that_ask_for_one_name_are_dealt_out(spark, monkeypatch):
    """F14 to F16: a name that most files ask for, and edges without a class, came to one task. F19 to F23: tables of nodes were broadcast."""
    nodes = spark.createDataFrame([("Module:m", "Module", "m", "m", "m.py", 0), ("Function:m.f", "Function", "m.f", "f", "m.py", 1), ("Function:o.run", "Function", "o.run", "run", "o.py", 2)], "id string, kind string, qualified_name string, name string, file string, seq int")
    made = F.lit("").alias("dst"), F.lit("run").alias("callee_name"), F.lit("").alias("receiver"), F.lit("unresolved").alias("confidence"), F.lit(False).alias("external")
    edges = spark.range(0, 8000, 1, 1).select(F.lit("Function:m.f").alias("src"), F.lit("CALLS").alias("kind"), *made, F.col("id").cast("int").alias("seq"))
    assert "Broadcast" not in resolve.resolve(nodes, edges)._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(tables, "CROWD", 100, raising=False)
    settings = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        found = resolve.resolve(nodes, edges).groupBy("dst", "confidence", F.spark_partition_id()).count().collect()
    finally:
        for name in settings:
            spark.conf.unset(name)
    assert {tuple(r)[:2] for r in found} == {("Function:o.run", "heuristic")} and sum(r["count"] for r in found) == 8000
    assert max(r["count"] for r in found) < 4000


def test_parsing_takes_few_steps_a_character():
    """patterns were tried at every token that its first character rules out; 30,685 calls for these sources."""
    with cProfile.Profile() as profile:
        for suffix, source, *_ in language_queries.SHAPES:
            PARSERS[f".{suffix}"](source, f"m.{suffix}", "m")
    assert pstats.Stats(profile).total_calls < 5 * sum(len(source) for _, source, *_ in language_queries.SHAPES)


def test_tables_are_compared_in_one_pass(spark):
    """F4 to F7: rows that differ were found by two joins, each with both tables."""
    rows = lambda *some: spark.createDataFrame(some, "file string, n int, at array<string>")
    before = rows(("same", 1, ["a"]), ("gone", None, None), ("changed", 1, ["b", None]), ("twice", 1, []))
    now = rows(("new", 0, ["a"]), ("changed", 1, ["b", "c"]), ("same", 1, ["a"]), ("twice", 1, []), ("twice", 1, []))
    found = delta._unequal(before, now)
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert sorted(r.file for r in found.collect()) == ["changed", "changed", "gone", "new", "twice"]
