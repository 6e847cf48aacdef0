"""Changes of a tree of files as a stream: a Python data source with offsets over the tree's states."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from loomgraph.functions.languages import PARSERS
from loomgraph.sources.tree import CODE_EXCLUDED


class _Changed(InputPartition):
    def __init__(self, paths: list[str], seq: int):
        self.paths, self.seq = paths, seq


class _Reader(DataSourceStreamReader):
    """An offset is the number of a state: what the tree held, by path, when it was looked at.

    States are files in the folder ``states``, each written whole under a name of its own and then given its number, so
    a batch that is repeated compares the same two. State 0 is empty, or with ``from_now`` what is there at first.
    """

    def __init__(self, root: str, states: str, per_task: int, excluded: set[str], suffixes: tuple[str, ...], from_now: bool):
        self.root, self.states, self.per_task, self.excluded, self.suffixes, self.from_now = root, states, per_task, excluded, suffixes, from_now

    def look(self) -> dict[str, list[int]]:
        found = {}
        for folder, below, names in os.walk(self.root):
            below[:] = sorted(name for name in below if name not in self.excluded)
            for name in names:
                full = os.path.join(folder, name)
                if (not self.suffixes or name.lower().endswith(self.suffixes)) and os.path.isfile(full):
                    stat = os.stat(full)
                    found[os.path.relpath(full, self.root).replace(os.sep, "/")] = [stat.st_mtime_ns, stat.st_size]
        return found

    def state(self, number: int) -> dict[str, list[int]]:
        with open(f"{self.states}/{number}", encoding="utf-8") as file:
            return json.load(file)

    def keep(self, number: int, state: dict[str, list[int]]) -> None:
        os.makedirs(self.states, exist_ok=True)
        new = f"{self.states}/{number}.{os.getpid()}"
        with open(new, "w", encoding="utf-8") as file:
            json.dump(state, file)
        os.replace(new, f"{self.states}/{number}")

    def last(self) -> int:
        names = os.listdir(self.states) if os.path.isdir(self.states) else []
        return max((int(n) for n in names if n.isdigit()), default=-1)

    def initialOffset(self) -> dict:
        if self.last() < 0:
            self.keep(0, self.look() if self.from_now else {})
        return {"state": 0}

    def latestOffset(self) -> dict:
        self.initialOffset()
        last, now = self.last(), self.look()
        if now != self.state(last):
            last += 1
            self.keep(last, now)
        return {"state": last}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        before, now = self.state(start["state"]), self.state(end["state"])
        paths = sorted(p for p in {*before, *now} if before.get(p) != now.get(p))
        return [_Changed(paths[i : i + self.per_task], end["state"]) for i in range(0, len(paths), self.per_task)]

    def read(self, partition: _Changed) -> Iterator[tuple]:
        for path in partition.paths:
            try:
                with open(os.path.join(self.root, path), "rb") as file:
                    yield path, file.read(), partition.seq
            except FileNotFoundError:
                yield path, None, partition.seq

    def commit(self, end: dict) -> None:
        for name in os.listdir(self.states):  # no batch goes back before this one
            if name.isdigit() and int(name) < end["state"]:
                os.remove(f"{self.states}/{name}")


class ChangeSource(DataSource):
    """``spark.readStream.format("tree_changes")``: path, content (null of a file that is gone), seq.

    Options: ``path`` and ``states`` (folders), ``exclude`` and ``suffixes`` (comma-separated), ``fromNow``.
    """

    @classmethod
    def name(cls) -> str:
        return "tree_changes"

    def schema(self) -> str:
        return "path string, content binary, seq long"

    def streamReader(self, schema) -> DataSourceStreamReader:
        listed = {name: [v for v in self.options.get(name, "").split(",") if v] for name in ("exclude", "suffixes")}
        per_task, from_now = int(self.options.get("filesPerTask", 200)), self.options.get("fromNow", "false").lower() == "true"
        return _Reader(self.options["path"], self.options["states"], per_task, set(listed["exclude"]), tuple(listed["suffixes"]), from_now)


def code_changes(spark: SparkSession, root: str, states: str, from_now: bool = False) -> DataFrame:
    """A stream of the code files below ``root`` that are new, changed or gone."""
    spark.dataSource.register(ChangeSource)
    options = {"states": states, "exclude": ",".join(CODE_EXCLUDED), "suffixes": ",".join(PARSERS), "fromNow": str(from_now)}
    return spark.readStream.format("tree_changes").options(**options).load(root)
