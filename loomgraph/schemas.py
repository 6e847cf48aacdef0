"""Schemas of the graph tables.

``seq`` is the order in which rows were first seen: the parts of the file's path, then the place
within the file. It sorts like a walk over sorted files and needs no global numbering. Operators take
any sortable ``seq``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NODE = "kind string, qualified_name string, name string, file string, lineno int, end_lineno int, lang string, body_hash string"
EDGE = "src string, kind string, dst string, callee_name string, receiver string, confidence string, external boolean"
ANNOTATION = "node_id string, label string, note string"
SNAPSHOT = "id int, commit_sha string, commit_time string, branch string, created_at string, node_count long, edge_count long"
CHANGE = "snapshot_id int, node_id string, change string, detail string"
FILE_HASH = "file string, digest string"

SYMBOLS = ("Function", "Method", "Class")
DEPENDENCIES = ("CALLS", "INHERITS", "IMPLEMENTS")


def node_id() -> Column:
    return F.concat_ws(":", "kind", "qualified_name")


def edge_key() -> Column:
    """Source, kind, and the target or (while unknown) what was called on what."""
    target = F.when(F.col("dst") != "", F.col("dst")).otherwise(F.concat(F.lit("?"), "callee_name", F.lit(":"), "receiver"))
    return F.struct("src", "kind", target.alias("target"))


def is_symbol() -> Column:
    return F.col("kind").isin(*SYMBOLS)


def is_dependency() -> Column:
    return F.col("kind").isin(*DEPENDENCIES) & (F.col("dst") != "")


def is_public() -> Column:
    return ~F.col("name").startswith("_")


def known_fields(rows: DataFrame, schema: str) -> DataFrame:
    """Only the columns that the schema has; what else a source brings is dropped."""
    return rows.select(*[c.split()[0] for c in schema.split(", ")])
