import time

from loomgraph.plans import index, store
from loomgraph.sources import changes, tree
from loomgraph.streaming import sync, watch


def test_changes_of_a_tree_reach_the_overlay(spark, tmp_path):
    root, folder = tmp_path / "code", f"file://{tmp_path}/graph"
    for name, text in {"a.py": "def f():\n    g()\n", "b/c.py": "def g():\n    pass\n", "node_modules/x.py": "x", "d.txt": "no"}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    index.save(index.index(index.empty_graph(spark), tree.code_tree(spark, str(root))), folder, buckets=4)

    def run():
        edits = changes.code_changes(spark, str(root), f"{tmp_path}/states", from_now=True)
        sync.sync_tree(edits, f"{tmp_path}/checkpoint", folder).awaitTermination()
        return store.numbers(spark, f"{folder}.overlay")

    assert run() == []  # nothing has changed since the first look
    (root / "a.py").write_text("def renamed():\n    g()\n")
    (root / "b/c.py").unlink()
    (root / "new.js").write_text("function fresh() { renamed(); }\n")
    assert run() == [1]
    names = {r.qualified_name for r in index.load(spark, f"{folder}.overlay").nodes.collect()}
    assert names == {"a", "a.renamed", "new", "new.fresh"}
    assert run() == [1]
    assert index.load(spark, folder).nodes.filter("name = 'f'").count() == 1


def test_watches_end_in_a_stream(spark, tmp_path):
    polls = [[(1, 1, None, 3), (1, 2, False, 0), (2, 1, True, 1), (3, 1, False, 0)], [(1, 3, None, 0), (1, 4, False, 0), (1, 5, False, 0), (2, 2, None, None), (2, 3, None, None), (3, 2, False, 1)]]
    schema = "watch long, at long, busy boolean, pending int"
    for part in polls:
        spark.createDataFrame(part, schema).write.mode("append").parquet(f"file://{tmp_path}/polls")
        ends = watch.watch_ends(spark.readStream.schema(schema).parquet(f"file://{tmp_path}/polls"))
        out = ends.writeStream.format("parquet").option("path", f"file://{tmp_path}/ends").option("checkpointLocation", f"file://{tmp_path}/state")
        out.trigger(availableNow=True).start().awaitTermination()
    assert {tuple(r) for r in spark.read.parquet(f"file://{tmp_path}/ends").collect()} == {(1, 5), (2, 2)}
    whole = sync.idle(spark.createDataFrame(polls[0] + polls[1], schema)).collect()
    assert {tuple(r) for r in whole} == {(1, 5), (2, 2)}  # its states and the window agree


def test_a_silent_watch_ends_by_its_timer(spark, tmp_path):
    schema = "watch long, at long, busy boolean, pending int"
    spark.createDataFrame([(7, 1, True, 1), (7, 2, True, 1)], schema).write.parquet(f"file://{tmp_path}/polls")
    ends = watch.watch_ends(spark.readStream.schema(schema).parquet(f"file://{tmp_path}/polls"), silence=300)
    query = ends.writeStream.format("memory").queryName("silent").trigger(processingTime="100 milliseconds").option("checkpointLocation", f"file://{tmp_path}/state").start()
    try:
        until = time.time() + 60
        while time.time() < until and not spark.table("silent").collect():
            time.sleep(0.5)
        assert [tuple(r) for r in spark.table("silent").collect()] == [(7, 2)]
    finally:
        query.stop()
