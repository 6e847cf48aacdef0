import hashlib
import subprocess

import pytest
from pyspark.sql import functions as F

from loomgraph.operators import history, inventory, tables, traverse
from loomgraph.plans import delta, index
from loomgraph.sources import tree
from loomgraph.streaming import sync

FILES = {
    "app.py": "from svc import Service\n\ndef main():\n    s = Service()\n    s.run()\n",
    "orphan.py": "def never():\n    return 1\n",
    "svc.py": "from util import helper\n\nclass Service(Base):\n    def run(self):\n        return helper()\n\n    def _priv(self):\n        return self.run()\n",
    "util.py": "def helper():\n    return 1\n\ndef _internal():\n    return helper()\n",
}


def frame(spark, files):
    return spark.createDataFrame([(p, t.encode()) for p, t in files.items()], "path string, content binary")


@pytest.fixture(scope="module")
def graph(spark, tmp_path_factory):
    folder = f"file://{tmp_path_factory.mktemp('graph')}"
    index.save(index.index(index.empty_graph(spark), frame(spark, FILES), {"commit_sha": "abc"}), folder)
    return index.load(spark, folder)


def test_resolution_of_a_small_project(graph):
    found = {(e.src.split(":")[1], e.callee_name): (e.dst.partition(":")[2], e.confidence, e.external) for e in graph.edges.filter("kind IN ('CALLS', 'INHERITS')").collect()}
    assert found == {
        ("svc.Service", "Base"): ("", "heuristic", True), ("util._internal", "helper"): ("util.helper", "exact", False),
        ("svc.Service.run", "helper"): ("util.helper", "heuristic", False), ("svc.Service._priv", "run"): ("svc.Service.run", "exact", False),
        ("app.main", "Service"): ("svc.Service", "heuristic", False), ("app.main", "run"): ("svc.Service.run", "heuristic", False),
    }
    assert graph.nodes.count() == 11 and graph.edges.count() == 15
    assert [(s.id, s.node_count, s.edge_count, s.commit_sha) for s in graph.snapshots.collect()] == [(1, 11, 15, "abc")]
    assert graph.changes.filter("change = 'added'").count() == 11


def test_inventory_of_a_small_project(graph, spark):
    found = inventory.build(graph.nodes, graph.edges, graph.annotations)
    by = {r.qualified_name: (r.fan_in, r.fan_in_modules, r.labels) for r in found.collect()}
    assert by == {
        "util.helper": (2, 2, ["reusable", "mandatory"]), "svc.Service.run": (2, 2, ["reusable", "mandatory"]), "svc.Service": (1, 1, ["mandatory"]),
        "app.main": (0, 0, ["mandatory"]), "orphan.never": (0, 0, ["dead"]), "util._internal": (0, 0, []), "svc.Service._priv": (0, 0, []),
    }
    assert [r.name for r in inventory.hotspots(found).collect()] == ["run", "helper", "Service", "main", "never"]
    start = spark.createDataFrame([("Method:svc.Service.run",)], "root string")
    assert {(r.id, r.distance) for r in traverse.blast_radius(graph.edges, start).collect()} == {("Method:svc.Service._priv", 1), ("Function:app.main", 1)}
    assert traverse.blast_radius(graph.edges, start, 0).collect() == []


def test_sync_takes_only_what_changed(graph, spark):
    after = {p: t for p, t in FILES.items() if p != "orphan.py"} | {"util.py": "def assist():\n    return 2\n"}
    paths = spark.createDataFrame([("orphan.py",), ("util.py",), ("app.py",), ("readme.md",)], "file string")
    synced = index.sync(graph, frame(spark, after), paths)
    names = {r.qualified_name for r in synced.nodes.collect()}
    assert "util.assist" in names and not {"util.helper", "orphan.never", "orphan"} & names
    changes = {(c.node_id, c.change) for c in synced.changes.filter("snapshot_id = 2").collect()}
    assert changes == {("Function:util.assist", "added"), *((f"Function:{n}", "removed") for n in ("util.helper", "util._internal", "orphan.never")), ("Module:orphan", "removed")}
    call = [e for e in synced.edges.collect() if e.callee_name == "helper" and e.kind == "CALLS"]
    assert [(e.src, e.dst, e.external) for e in call] == [("Method:svc.Service.run", "", True)]
    again = index.sync(graph, frame(spark, FILES), paths.filter("file <> 'readme.md'"))
    assert again.changes.filter("snapshot_id = 2").count() == 0 and again.snapshots.count() == 2


def test_file_tree_reads_hidden_names_and_drops_folders(spark, tmp_path):
    for name in ("a/__init__.py", "a/_x.PY", "node_modules/b.py", "bin/c.py", "doc.md", ".terraform/d.md", "e.png", "bad.bas"):
        path = tmp_path / name
        path.parent.mkdir(exist_ok=True, parents=True)
        path.write_bytes(b"x\r\n\xff")
    files = tree.files(spark, str(tmp_path))
    assert {r.path for r in tree.code_files(files).collect()} == {"a/__init__.py", "a/_x.PY", "bad.bas"}
    docs, omitted = tree.document_files(files)
    assert [r.path for r in docs.collect()] == ["doc.md"] and omitted.first()["omitted"] == 1
    assert tree.document_files(files, exclude=False)[0].count() == 2
    assert index.parse_files(tree.code_files(files))[0].count() == 3


def test_tree_prunes_folders_and_reads_only_code(spark, tmp_path):
    for name in ("b/z.py", "a.py", "a/x.py", "node_modules/deep/b.py", "doc.md", "B.CLS"):
        path = tmp_path / name
        path.parent.mkdir(exist_ok=True, parents=True)
        path.write_text("x")
    assert [r.path for r in tree.in_order(tree.code_tree(spark, str(tmp_path))).collect()] == ["B.CLS", "a/x.py", "a.py", "b/z.py"]
    assert {r.path for r in tree.files(spark, str(tmp_path), ("node_modules",), (".py",)).collect()} == {"b/z.py", "a.py", "a/x.py"}


def test_digests_are_of_the_text_and_other_files_are_left_out(spark):
    bytes_of = {"a.py": b"x = 1\r\ny = 2\n", "README.md": b"# no code", "deep.py": b"x = " + b"(" * 5000 + b")" * 5000, "odd.py": b"a = '\xff'\n"}
    files = spark.createDataFrame(list(bytes_of.items()), "path string, content binary")
    graph = index.index(index.empty_graph(spark), files)
    assert {r.name for r in graph.nodes.collect()} == {"a", "deep", "odd"}
    digests = {r.file: r.digest for r in graph.file_hashes.collect()}
    assert set(digests) == {"a.py", "deep.py", "odd.py"} and digests["a.py"] == hashlib.md5(b"x = 1\ny = 2\n").hexdigest()
    assert digests["odd.py"] == hashlib.md5("a = '\ufffd'\n".encode()).hexdigest()


def test_each_file_is_parsed_once(spark):
    plan = index.index(index.empty_graph(spark), frame(spark, FILES)).edges._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" not in plan


def test_overlay_leaves_the_durable_graph_alone(spark, graph, tmp_path):
    folder = f"file://{tmp_path}/graph"
    index.save(graph, folder)
    change = {"util.py": "def assist():\n    return 2\n"}
    paths = spark.createDataFrame([("util.py",)], "file string")
    first = delta.sync_to(spark, folder, frame(spark, change), paths, durable=False).first()
    assert (first.target, first.snapshot_id, first.files, first.added, first.removed) == ("overlay", 2, 1, 1, 2)
    second = delta.sync_to(spark, folder, frame(spark, FILES), paths, durable=False).first()
    assert (second.snapshot_id, second.added, second.removed) == (3, 2, 1)
    assert index.load(spark, folder).snapshots.count() == 1
    assert delta.sync_to(spark, folder, frame(spark, change), paths).first().target == "durable"
    state = index.state(index.load(spark, folder), "abc").first()
    assert state.last_snapshot.id == 2 and not state.out_of_sync  # the last snapshot has no commit
    assert index.state(graph, "abc").first().out_of_sync is False and index.state(graph, "x").first().out_of_sync is True
    assert index.state(index.empty_graph(spark), "x").first()["last_snapshot"] is None


def test_json_lines_come_back_and_clear_keeps_the_log(spark, graph, tmp_path):
    index.save_json(graph, f"file://{tmp_path}/json")
    again = index.load_json_lines(spark, f"file://{tmp_path}/json")
    for name, table in graph._asdict().items():
        assert sorted(map(str, table.collect())) == sorted(map(str, getattr(again, name).select(*table.columns).collect()))
    empty = index.clear(graph)
    assert [t.count() for t in empty] == [0, 0, graph.annotations.count(), 1, 11, 0]
    assert index.as_text({"ñ": 1}) == '{\n  "ñ": 1\n}'


def test_annotations_of_equal_labels_count_with_the_last(spark):
    notes = spark.createDataFrame([("a", "x", "1", 0), ("a", "x", "2", 1), ("a", "keep", "", 2), ("b", "x", "3", 3)], "node_id string, label string, note string, seq long")
    found = {r.id: (r.annotations, r.others) for r in inventory.annotation_maps(notes).collect()}
    assert found == {"a": ({"x": "2", "keep": ""}, ["x"]), "b": ({"x": "3"}, ["x"])}
    assert {tuple(r) for r in inventory.annotations_of(notes, "a").collect()} == {("a", "x", "2"), ("a", "keep", "")}
    assert inventory.annotations_of(notes).count() == 3


def test_watch_goes_on_while_something_is_readable(spark):
    polls = [("a", 1, None, 3), ("a", 2, False, 0), ("a", 3, None, 0), ("a", 4, False, None), ("a", 5, False, 0), ("b", 1, True, 1), ("b", 2, None, None)]
    ended = sync.idle(spark.createDataFrame(polls, "watch string, at int, busy boolean, pending int")).collect()
    assert {tuple(r) for r in ended} == {("a", 5), ("b", 2)}


def test_git(spark, tmp_path):
    run = lambda *a: subprocess.run(["git", "-c", "user.name=a", "-c", "user.email=a@b", *a], cwd=tmp_path, check=True, capture_output=True)
    run("init")
    (tmp_path / "a.py").write_text("1")
    run("add", ".")
    run("commit", "-m", "first")
    (tmp_path / "a.py").write_text("2")
    (tmp_path / "b.py").write_text("3")
    assert [r.file for r in tree.changed_files(spark, "HEAD", str(tmp_path)).collect()] == ["a.py", "b.py"]
    assert tree.is_dirty(str(tmp_path)) and len(tree.commit_metadata(str(tmp_path))["commit_sha"]) == 40
    assert tree.git(["rev-parse", "HEAD"], str(tmp_path / "none")) == ""


def test_json_graph_drops_unknown_fields(spark, tmp_path):
    (tmp_path / "g.json").write_text('{"nodes": [{"kind": "Class", "qualified_name": "a", "odd": 1}], "file_hashes": {"f": "d"}}')
    found = index.load_json(spark, f"file://{tmp_path}/g.json")
    assert [(r.kind, r.qualified_name, r.seq) for r in found["nodes"].collect()] == [("Class", "a", 0)]
    assert found["edges"].count() == 0 and [tuple(r) for r in found["file_hashes"].collect()] == [("f", "d")]


def test_upserts_keep_places_and_cycles_end(spark):
    old = spark.createDataFrame([("a", "1", 0), ("b", "1", 1)], "id string, v string, seq int")
    new = spark.createDataFrame([("c", "2", 0), ("a", "2", 1), ("a", "3", 2)], "id string, v string, seq int")
    assert sorted(map(tuple, tables.upsert(old, new, ["id"]).collect())) == [("a", "3", 0), ("b", "1", 1), ("c", "2", 0)]
    ring = spark.createDataFrame([(f"n{i}", "CALLS", f"n{(i + 1) % 4}", "exact", i) for i in range(4)], "src string, kind string, dst string, confidence string, seq int")
    root = spark.createDataFrame([("n0",)], "root string")
    assert {(r.id, r.distance) for r in traverse.callees(ring, root, 9).collect()} == {("n1", 1), ("n2", 2), ("n3", 3)}
    assert traverse.closure(ring, root.select(F.col("root").alias("id"))).count() == 4


def test_ledger_commits_only_what_was_applied(spark):
    docs = lambda *rows: spark.createDataFrame([(p, d, i) for i, (p, d) in enumerate(rows)], "path string, digest string, seq int")
    ledger = history.document_nodes(docs(("x/a.md", "1"), ("b.md", "1")))
    new = docs(("a.md", "2"), ("c.md", "1"))
    diffs = history.diff_nodes(ledger, history.document_nodes(new))
    assert {(r.node_id, r.change) for r in diffs.collect()} == {("Document:a.md", "modified"), ("Document:b.md", "removed"), ("Document:c.md", "added")}
    after = history.commit(ledger, new, diffs.filter("node_id <> 'Document:b.md'"))
    assert {(r.name, r.body_hash) for r in after.collect()} == {("a.md", "2"), ("b.md", "1"), ("c.md", "1")}


def test_ledger_of_single_documents(spark):
    one = history.record_one(history.empty_ledger(spark), "x/a.md", "1", {"commit_sha": "s"})
    two = history.record_one(history.record_one(one, "y/b.md", "1"), "a.md", "2")
    assert {(r.file, r.body_hash) for r in two.nodes.collect()} == {("a.md", "2"), ("b.md", "1")}
    assert [(r.snapshot_id, r.change) for r in history.history_of(two, "z/a.md").collect()] == [(1, "added"), (3, "modified")]
    assert [r.body_hash for r in history.digest_of(two, "q/b.md").collect()] == ["1"] and history.digest_of(two, "c").collect() == []
    gone = history.remove_one(history.remove_one(two, "a.md"), "a.md")
    assert [r.file for r in gone.nodes.collect()] == ["b.md"] and gone.snapshots.count() == 4
    assert history.document_state(gone).first().last_snapshot.id == 4
