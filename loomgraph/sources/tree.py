"""Sources: a tree of files, git, status and environment texts.

Spark's own file sources skip names that begin with ``_`` or ``.``, so trees are listed and read by tasks
of our own: a round lists the folders of one depth, and the files found are dealt out to be read.
"""

from __future__ import annotations

import os
import subprocess
from collections.abc import Iterator

import pyarrow as pa
from pyarrow.fs import FileSelector, FileSystem, FileType
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions import scalar
from loomgraph.functions.languages import PARSERS
from loomgraph.plans import lineage

# Folders that hold no code or documents of the user's, and suffixes of documents.
_ALWAYS = (
    "node_modules .git .svn .hg __pycache__ .venv venv site-packages dist build .next .nuxt target vendor "
    "bower_components .idea .vscode .cache .gradle .tox .pytest_cache .mypy_cache"
).split()
CODE_EXCLUDED = (*_ALWAYS, "bin", "obj")
DOCUMENT_EXCLUDED = (*_ALWAYS, ".angular", ".terraform")
DOCUMENT_SUFFIXES = (".md", ".txt", ".pdf", ".docx", ".doc", ".pptx", ".csv", ".rst", ".html")


#: Folders that one task lists in a round, and files and bytes that one task reads.
FOLDERS_PER_TASK, FILES_PER_TASK, BYTES_PER_TASK = 100, 1000, 64 << 20
_LISTED = pa.schema([("path", pa.string()), ("size", pa.int64()), ("folder", pa.bool_())])
_FILES = pa.schema([("path", pa.string()), ("size", pa.int64()), ("content", pa.binary())])
_ROWS = 10_000
#: Content that is held before it goes on: Arrow's batches stay small, whatever the files' sizes.
_HELD = 16 << 20


def _is_local(root: str) -> bool:
    return "://" not in root and not root.startswith("file:")


def _entries(root: str, folder: str) -> Iterator[tuple[str, int, bool]]:
    """name, size, whether it is a folder, of what lies in a folder; links to folders are left out.

    A root with a scheme (``file:``, ``hdfs:``, ``s3:``) is read through Arrow's file systems; that of
    Hadoop asks for its native library where tasks run.
    """
    if not _is_local(root):
        system, base = FileSystem.from_uri(root)
        for info in system.get_file_info(FileSelector(f"{base}/{folder}".rstrip("/"), allow_not_found=True)):
            if info.type is not FileType.NotFound and not (info.type is FileType.Directory and os.path.islink(info.path)):
                yield info.base_name, info.size or 0, info.type is FileType.Directory
        return
    try:
        with os.scandir(os.path.join(root, folder)) as found:
            for entry in found:
                if entry.is_dir(follow_symlinks=False) or entry.is_file():
                    is_folder = entry.is_dir(follow_symlinks=False)
                    yield entry.name, 0 if is_folder else entry.stat().st_size, is_folder
    except FileNotFoundError:
        return


def _content(root: str, path: str) -> bytes | None:
    """A file's bytes; nothing if it is gone since it was listed."""
    try:
        if _is_local(root):
            with open(os.path.join(root, path), "rb") as file:
                return file.read()
        system, base = FileSystem.from_uri(root)
        with system.open_input_file(f"{base}/{path}") as file:
            return file.read()
    except FileNotFoundError:
        return None


def listing(spark: SparkSession, root: str, exclude: tuple[str, ...] = (), suffixes: tuple[str, ...] = ()) -> DataFrame:
    """path (relative), size of the files below ``root``, listed by tasks.

    A round lists all folders of one depth and gives those of the next, so the driver holds one number
    a round. Folders named in ``exclude`` aren't entered; with ``suffixes`` other files aren't listed.
    """
    root = root.rstrip("/") or "/"

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for folder in batch.column(0).to_pylist():
                for name, size, is_folder in _entries(root, folder):
                    if name not in exclude if is_folder else not suffixes or name.lower().endswith(suffixes):
                        rows.append((f"{folder}/{name}".lstrip("/"), size, is_folder))
                    if len(rows) == _ROWS:
                        yield _batch(rows, _LISTED)
                        rows = []
            yield _batch(rows, _LISTED)

    target, depth, count = lineage.fresh(spark, "listing"), 0, 1
    folders = spark.createDataFrame([("",)], "path string")
    while count:
        schema = "path string, size long, folder boolean"
        dealt = folders.repartition(-(-count // FOLDERS_PER_TASK))
        dealt.mapInArrow(look, schema).write.parquet(f"{target}/depth={depth}")
        folders = spark.read.schema(schema).parquet(f"{target}/depth={depth}").filter("folder").select("path")
        count, depth = folders.count(), depth + 1
    return spark.read.schema(f"{schema}, depth int").parquet(target).filter("not folder").select("path", "size")


def files(spark: SparkSession, root: str, exclude: tuple[str, ...] = (), suffixes: tuple[str, ...] = ()) -> DataFrame:
    """path (relative), size, content of the files of ``listing``; the tree is listed now, files are read when asked for."""
    root = root.rstrip("/") or "/"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for path in batch.column(0).to_pylist():
                content = _content(root, path)
                if content is not None:
                    held.append((path, len(content), content))
                    size += len(content)
                if size >= _HELD:
                    yield _batch(held, _FILES)
                    held, size = [], 0
        yield _batch(held, _FILES)

    listed = listing(spark, root, exclude, suffixes)
    many, size = listed.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    dealt = listed.select("path").repartition(1 + many // FILES_PER_TASK + size // BYTES_PER_TASK)
    return dealt.mapInArrow(read, "path string, size long, content binary")


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types)], schema=schema)


def code_tree(spark: SparkSession, root: str) -> DataFrame:
    """The code files below ``root``; excluded folders aren't entered and other files not read."""
    return code_files(files(spark, root, CODE_EXCLUDED, tuple(PARSERS)))


def _inside(excluded: tuple[str, ...]):
    return F.exists(F.split("path", "/"), lambda part: part.isin(*excluded))


def code_files(tree: DataFrame) -> DataFrame:
    """Files that a parser is registered for, outside the excluded folders."""
    return tree.filter(scalar.suffix(F.col("path")).isin(*PARSERS) & ~_inside(CODE_EXCLUDED))


def document_files(tree: DataFrame, exclude: bool = True) -> tuple[DataFrame, DataFrame]:
    """Documents, and one row with the number left out (``omitted``)."""
    candidates = tree.filter(scalar.suffix(F.col("path")).isin(*DOCUMENT_SUFFIXES))
    gone = _inside(DOCUMENT_EXCLUDED) & F.lit(exclude)
    return candidates.filter(~gone), candidates.agg(F.count_if(gone).alias("omitted"))


def in_order(tree: DataFrame) -> DataFrame:
    return tree.orderBy(F.split("path", "/"))


# ---- git, on the driver


def git(arguments: list[str], folder: str) -> str:
    """What a git command prints; nothing if it fails or takes over 30 seconds."""
    try:
        done = subprocess.run(["git", *arguments], cwd=folder, capture_output=True, text=True, timeout=30, check=False)
    except (OSError, subprocess.SubprocessError):
        return ""
    return done.stdout.strip() if done.returncode == 0 else ""


def commit_metadata(folder: str) -> dict[str, str]:
    asked = {"commit_sha": ["rev-parse", "HEAD"], "branch": ["rev-parse", "--abbrev-ref", "HEAD"], "commit_time": ["show", "-s", "--format=%cI", "HEAD"]}
    return {name: git(arguments, folder) for name, arguments in asked.items()}


def is_dirty(folder: str) -> bool:
    return bool(git(["status", "--porcelain"], folder))


def changed_files(spark: SparkSession, ref: str, folder: str) -> DataFrame:
    """Files that differ from ``ref`` or aren't tracked, each once, in order."""
    listed = [git(["diff", "--name-only", ref], folder), git(["ls-files", "--others", "--exclude-standard"], folder)]
    rows = [(name,) for text in listed for name in text.split("\n") if name]
    return spark.createDataFrame(rows, "file string").distinct().orderBy("file")


# ---- texts


def environment(lines: DataFrame) -> DataFrame:
    """key, value of KEY=VALUE lines (columns at, line): comments, blanks, quotes and empty keys go, the last key wins."""
    bare = lambda text: F.regexp_replace(text, r"^\s+|\s+$", "")
    line = bare(F.col("line"))
    rows = lines.filter((line != "") & ~line.startswith("#") & line.contains("="))
    key = bare(F.substring_index(line, "=", 1))
    value = F.btrim(F.btrim(bare(line.substr(F.instr(line, "=") + 1, F.length(line))), F.lit('"')), F.lit("'"))
    pairs = rows.select(key.alias("key"), value.alias("value"), "at").filter("key <> ''")
    return pairs.groupBy("key").agg(F.max_by("value", "at").alias("value"))


STATUS = "statuses map<string,array<struct<id:string,doc_id:string,file_path:string,file_source:string,status:string>>>"


def status_documents(texts: DataFrame) -> DataFrame:
    """state and the document's fields from status texts (column ``json``), with their order."""
    parsed = texts.select(F.from_json("json", STATUS).alias("s")).select(F.posexplode(F.map_entries("s.statuses")).alias("state_at", "entry"))
    rows = parsed.select("state_at", F.col("entry.key").alias("state"), F.posexplode("entry.value").alias("at", "doc"))
    return rows.select("state", F.struct("state_at", "at").alias("seq"), "doc.*")


def processed_ids(documents: DataFrame) -> DataFrame:
    status = F.coalesce(F.col("status"), F.col("state"))
    rows = documents.filter(F.lower(status).contains("processed"))
    return rows.select(scalar.first_truthy(F.col("id"), F.col("doc_id")).alias("doc_id")).filter("doc_id IS NOT NULL").distinct()


def find_by_name(documents: DataFrame, path: str) -> DataFrame:
    """The first document whose path ends in the same name as ``path``, whatever the case."""
    own = F.lower(scalar.basename(scalar.first_truthy(F.col("file_path"), F.col("file_source"))))
    return documents.filter(own == path.rstrip("/").rpartition("/")[2].lower()).orderBy("seq").limit(1)
