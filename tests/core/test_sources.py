import os

import pytest
from pyspark.sql import Row

from loomgraph.sources import outcomes, tree


def made(folder, names):
    for name in names:
        path = folder / name
        path.parent.mkdir(exist_ok=True, parents=True)
        path.write_text(name)


def test_a_deep_tree_is_listed_by_rounds(spark, tmp_path, monkeypatch):
    names = [f"d{i % 7}/e{i % 5}/f{i}.py" for i in range(60)] + ["top.md", "_x/.y/é b.py", "d1/bin/no.py", "d1/keep.PY"]
    made(tmp_path, names)
    (tmp_path / "empty").mkdir()
    os.symlink(tmp_path, tmp_path / "d1" / "loop")
    os.symlink(tmp_path / "top.md", tmp_path / "link.md")
    os.symlink(tmp_path / "nowhere", tmp_path / "dangling.md")
    found = {r.path: r.size for r in tree.listing(spark, str(tmp_path)).collect()}
    assert found == {n: len(n.encode()) for n in names} | {"link.md": 6}
    monkeypatch.setattr(tree, "FOLDERS_PER_TASK", 3)
    monkeypatch.setattr(tree, "FILES_PER_TASK", 4)
    for root in (f"{tmp_path}/", f"file://{tmp_path}"):
        read = tree.files(spark, root, ("bin",), (".py",))
        assert read.rdd.getNumPartitions() > 10
        assert {r.path: bytes(r.content).decode() for r in read.collect()} == {n: n for n in names if n.lower().endswith(".py") and "bin" not in n}


def test_files_gone_since_the_listing_and_missing_roots(spark, tmp_path):
    made(tmp_path, ["a.py", "b.py"])
    read = tree.files(spark, str(tmp_path))
    (tmp_path / "b.py").unlink()
    assert [(r.path, r.size) for r in read.collect()] == [("a.py", 4)]
    assert tree.files(spark, f"{tmp_path}/none").collect() == [] and tree.files(spark, f"file://{tmp_path}/none").collect() == []


def send(node_id, change, detail):
    if node_id.endswith("3"):
        raise TimeoutError(detail)
    return None if node_id.endswith("4") else f"{change} accepted"


def test_every_entry_has_an_outcome(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(outcomes, "ANSWERS_HELD", 2)
    diffs = spark.createDataFrame([(f"Document:{i}", "added", f"late {i}") for i in range(30)], "node_id string, change string, detail string").repartition(5)
    got = {r.node_id: (r.message, r.raised) for r in outcomes.applied(diffs, send, str(tmp_path)).collect()}
    want = {i: (f"TimeoutError: late {i}", True) if i % 10 == 3 else (None, False) if i % 10 == 4 else ("added accepted", False) for i in range(30)}
    assert got == {f"Document:{i}": v for i, v in want.items()}
    [manifest] = tmp_path.glob("*.manifest")
    parts = outcomes.committed(f"file://{tmp_path}", manifest.stem)
    assert sum(p.sent for p in parts) == 30 and sum(p.raised for p in parts) == 3
    assert outcomes.applied(diffs.limit(0), send).collect() == []
    # A second run in the folder doesn't show the first one's answers.
    assert outcomes.applied(diffs.filter("node_id = 'Document:1'"), send, str(tmp_path)).count() == 1


def test_answers_of_lost_attempts_do_not_count(spark, tmp_path):
    writer = outcomes._Writer(f"file://{tmp_path}", "run", send)
    entries = [Row(node_id=f"n{i}", change="removed", detail="") for i in range(4)]

    def dying():
        yield from entries[:2]
        raise MemoryError

    with pytest.raises(MemoryError):
        writer.write(dying())
    twice = [writer.write(iter(entries)) for _ in range(2)]
    with pytest.raises(FileNotFoundError):
        outcomes.answers(spark, f"file://{tmp_path}", "run")
    writer.commit([twice[1], None])
    assert len(list(tmp_path.glob("*.parquet"))) == 3
    assert outcomes.answers(spark, f"file://{tmp_path}", "run").count() == 4
