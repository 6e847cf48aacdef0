"""Queries of the code graph: symbols, resolution, traversal, inventory, table maintenance."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.operators import history, inventory, resolve, tables, traverse
from loomgraph.operators import search as text_search
from loomgraph.plans import lineage
from loomgraph.plans import relations as rel
from loomgraph.plans.registry import query
from loomgraph.plans.relations import duck, rows
from loomgraph.schemas import edge_key, is_dependency, is_public, is_symbol

_N, _E = f"n AS ({duck(rel.NODES)})", f"e AS ({duck(rel.EDGES)})"
_CN = f"n AS ({duck(rel.CODE_NODES)})"
_DEP = "kind IN ('CALLS', 'INHERITS', 'IMPLEMENTS') AND dst <> ''"
_CORE = "id, kind, qualified_name, name, file, seq"


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(spark, sf_dir, rel.NODES)


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(spark, sf_dir, rel.EDGES)


def core(df: DataFrame) -> DataFrame:
    return df.select(*_CORE.split(", "))


def one(spark: SparkSession, *names: str) -> DataFrame:
    return spark.createDataFrame([(n,) for n in names], "root string")


# ---- filters


@query("FLT-01_find_nodes", f"WITH {_N} SELECT {_CORE} FROM n WHERE kind = 'Method' AND name = 'red widget'")
def find_nodes(spark, sf_dir):
    return core(tables.find(nodes(spark, sf_dir), kind="Method", name="red widget", qualified_name=None))


@query("FLT-02_search", f"WITH {_N} SELECT {_CORE} FROM n WHERE contains(lower(name), 'ring') OR contains(lower(qualified_name), 'ring')")
def search(spark, sf_dir):
    return core(tables.search(nodes(spark, sf_dir), "RING"))


@query("FLT-02_indexed_search", f"WITH {_N} SELECT {_CORE} FROM n WHERE contains(lower(name), 'ring') OR contains(lower(qualified_name), 'ring')")
def indexed_search(spark, sf_dir):
    folder, found = f"{lineage.checkpoint_dir(spark)}/grams-{uuid.uuid4().hex}", nodes(spark, sf_dir)
    return core(text_search.search(spark, found, text_search.build(found, folder), "RING"))


@query("FLT-03_direct_callers", f"WITH {_E} SELECT src, dst, confidence, seq FROM e WHERE kind = 'CALLS' AND dst = 'n17'")
def direct_callers(spark, sf_dir):
    return tables.find(edges(spark, sf_dir), kind="CALLS", dst="n17").select("src", "dst", "confidence", "seq")


@query("FLT-03_direct_callees", f"WITH {_E} SELECT src, dst, confidence, seq FROM e WHERE kind = 'CALLS' AND src = 'n17'")
def direct_callees(spark, sf_dir):
    return tables.find(edges(spark, sf_dir), kind="CALLS", src="n17").select("src", "dst", "confidence", "seq")


@query("FLT-04_get_node", f"WITH {_N} SELECT {_CORE} FROM n WHERE id = 'n42'")
def get_node(spark, sf_dir):
    return core(tables.find(nodes(spark, sf_dir), id="n42").limit(1))


@query("FLT-10_dependencies", f"WITH {_E} SELECT src, kind, dst FROM e WHERE {_DEP}")
def dependencies(spark, sf_dir):
    return edges(spark, sf_dir).filter(is_dependency()).select("src", "kind", "dst")


@query("FLT-11_symbols", f"WITH {_N} SELECT {_CORE} FROM n WHERE kind IN ('Function', 'Method', 'Class')")
def symbols(spark, sf_dir):
    return core(nodes(spark, sf_dir).filter(is_symbol()))


@query("FLT-12_public", f"WITH {_N} SELECT {_CORE} FROM n WHERE NOT starts_with(name, '_')")
def public(spark, sf_dir):
    return core(nodes(spark, sf_dir).filter(is_public()))


@query("FLT-13_file_scope", f"WITH {_N} SELECT {_CORE} FROM n WHERE file = 'Brand#7.py'")
def file_scope(spark, sf_dir):
    return core(tables.find(nodes(spark, sf_dir), file="Brand#7.py"))


# ---- resolution

_TABLES = f"""
n AS MATERIALIZED ({duck(rel.CODE_NODES)}), e AS MATERIALIZED ({rel.CODE_EDGES.format(code_nodes="SELECT * FROM n", lineitem="lineitem")}),
files AS MATERIALIZED (SELECT file, arg_max(qualified_name, seq) AS module FROM n WHERE kind = 'Module' GROUP BY file),
last AS MATERIALIZED (SELECT id, arg_max(kind, seq) AS kind, arg_max(qualified_name, seq) AS qualified_name, arg_max(name, seq) AS name, arg_max(file, seq) AS file FROM n GROUP BY id),
kids AS MATERIALIZED (SELECT s.kind, s.qualified_name AS owner, c.name, c.kind AS child_kind, c.id, e.seq
  FROM e JOIN last AS s ON s.id = e.src JOIN last AS c ON c.id = e.dst WHERE e.kind = 'DEFINES'),
top AS MATERIALIZED (SELECT owner, name, arg_max(id, seq) AS id FROM kids WHERE kind = 'Module' GROUP BY owner, name),
mem AS MATERIALIZED (SELECT owner, name, arg_max(id, seq) AS id FROM kids WHERE kind = 'Class' AND child_kind IN ('Method', 'Function') GROUP BY owner, name),
uniq AS MATERIALIZED (SELECT name, min(id) AS id FROM n WHERE kind IN ('Function', 'Method', 'Class') GROUP BY name HAVING count(*) = 1),
uniq_class AS MATERIALIZED (SELECT name, min(id) AS id FROM n WHERE kind = 'Class' GROUP BY name HAVING count(*) = 1),
imports AS MATERIALIZED (SELECT DISTINCT s.qualified_name AS module, callee_name AS name FROM e JOIN last AS s ON s.id = e.src WHERE e.kind = 'IMPORTS'),
placed AS MATERIALIZED (SELECT e.*, s.id IS NOT NULL AS known, f.module,
    CASE WHEN s.kind = 'Method' AND contains(s.qualified_name, '.') THEN regexp_replace(s.qualified_name, '\\.[^.]*$', '') END AS class,
    regexp_replace(e.callee_name, '^.*\\.', '') AS short, CASE WHEN e.receiver = '' THEN e.callee_name ELSE e.receiver END AS wanted
  FROM e LEFT JOIN last AS s ON s.id = e.src LEFT JOIN files AS f ON f.file = s.file),
found AS (SELECT p.*, top.id AS top_id, mem.id AS mem_id, u.id AS uniq_id, i.name IS NOT NULL AS imported, tt.id AS type_top, uc.id AS type_uniq
  FROM placed AS p
  LEFT JOIN top ON top.owner = p.module AND top.name = p.callee_name
  LEFT JOIN mem ON mem.owner = p.class AND mem.name = p.callee_name
  LEFT JOIN uniq AS u ON u.name = p.callee_name
  LEFT JOIN imports AS i ON i.module = p.module AND i.name = p.wanted
  LEFT JOIN top AS tt ON tt.owner = p.module AND tt.name = p.short
  LEFT JOIN uniq_class AS uc ON uc.name = p.short)"""
_RULE = """CASE WHEN kind IN ('DEFINES', 'IMPORTS') OR NOT known THEN 'as is'
  WHEN kind <> 'CALLS' THEN CASE WHEN type_top IS NOT NULL THEN 'type top' WHEN type_uniq IS NOT NULL THEN 'type unique' ELSE 'type external' END
  WHEN lower(receiver) IN ('self', 'me', 'this', 'mybase', 'myclass', 'mi') AND mem_id IS NOT NULL THEN 'member'
  WHEN receiver = '' AND top_id IS NOT NULL THEN 'top' WHEN receiver = '' AND mem_id IS NOT NULL THEN 'member'
  WHEN receiver <> '' AND imported THEN 'external' WHEN uniq_id IS NOT NULL THEN 'unique'
  WHEN receiver = '' AND imported THEN 'external' ELSE 'none' END"""
_RESOLVED = f"""WITH {_TABLES}, ruled AS (SELECT *, {_RULE} AS rule FROM found)
SELECT src, kind, callee_name, receiver, seq,
  CASE rule WHEN 'as is' THEN dst WHEN 'type top' THEN type_top WHEN 'type unique' THEN type_uniq WHEN 'member' THEN mem_id WHEN 'top' THEN top_id
    WHEN 'unique' THEN uniq_id ELSE '' END AS dst,
  CASE WHEN rule = 'as is' THEN confidence WHEN rule IN ('type top', 'member', 'top') THEN 'exact' WHEN rule = 'none' THEN 'unresolved' ELSE 'heuristic' END AS confidence,
  rule IN ('type external', 'external') AS external
FROM ruled"""


def _code(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Symbols and edges; the edges, which are read more than once, are written first."""
    found = rows(spark, sf_dir, rel.CODE_NODES)
    return found, lineage.stored(rows(spark, sf_dir, rel.CODE_EDGES, code_nodes=found.hint("merge")), "code-edges")


def _resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.resolve(*_code(spark, sf_dir)).select("src", "kind", "callee_name", "receiver", "seq", "dst", "confidence", "external")


@query("JOIN-01_unique_names", f"WITH {_CN} SELECT name, min(id) AS id FROM n WHERE kind IN ('Function', 'Method', 'Class') GROUP BY name HAVING count(*) = 1")
def unique_names(spark, sf_dir):
    return resolve.unique_names(rows(spark, sf_dir, rel.CODE_NODES)).select("name", "id").filter("id IS NOT NULL")


@query("JOIN-02_resolve_calls", f"SELECT * FROM ({_RESOLVED}) WHERE kind = 'CALLS'")
def resolve_calls(spark, sf_dir):
    return _resolved(spark, sf_dir).filter("kind = 'CALLS'")


@query("JOIN-03_resolve_types", f"SELECT * FROM ({_RESOLVED}) WHERE kind IN ('INHERITS', 'IMPLEMENTS')")
def resolve_types(spark, sf_dir):
    return _resolved(spark, sf_dir).filter("kind IN ('INHERITS', 'IMPLEMENTS')")


@query("JOIN-04_resolve_all", _RESOLVED)
def resolve_all(spark, sf_dir):
    return _resolved(spark, sf_dir)


@query("JOIN-08_changed_symbols", f"WITH {_N} SELECT {_CORE} FROM n WHERE kind IN ('Function', 'Method', 'Class') AND file IN ('Brand#3.py', 'Brand#12.py')")
def changed_symbols(spark, sf_dir):
    files = spark.createDataFrame([("Brand#3.py",), ("Brand#12.py",), ("Brand#3.py",)], "file string")
    return core(nodes(spark, sf_dir).filter(is_symbol()).join(files.distinct(), "file", "left_semi"))


# ---- aggregates and inventory

_FAN = f"""SELECT dst AS id, count(DISTINCT (e.src, e.kind)) AS fan_in, count(DISTINCT coalesce(m.module, s.file)) AS fan_in_modules,
  count(DISTINCT e.src) FILTER (WHERE e.kind = 'CALLS') AS call_in
FROM e LEFT JOIN n AS s ON s.id = e.src LEFT JOIN (SELECT file, arg_max(qualified_name, seq) AS module FROM n WHERE kind = 'Module' GROUP BY file) AS m ON m.file = s.file
WHERE e.{_DEP} GROUP BY dst"""
_LIVE = f"""live AS (SELECT id FROM n WHERE kind IN ('Function', 'Method', 'Class') AND lower(name) IN ('main', 'red widget')
  UNION SELECT e.dst FROM live JOIN e ON e.src = live.id WHERE e.{_DEP})"""
_INVENTORY = f"""WITH RECURSIVE {_N}, {_E}, {_LIVE}, fan AS ({_FAN}),
a AS (SELECT node_id AS id, bool_or(label = 'reusable') AS r, bool_or(label = 'mandatory') AS m, bool_or(label = 'keep') AS k,
  coalesce(list(label ORDER BY seq) FILTER (WHERE label NOT IN ('reusable', 'mandatory', 'keep')), []) AS others FROM ({duck(rel.ANNOTATIONS)}) GROUP BY node_id),
f AS (SELECT n.id, qualified_name, n.name, n.kind, lang, file, seq, coalesce(fan_in, 0) AS fan_in, coalesce(fan_in_modules, 0) AS fan_in_modules, coalesce(call_in, 0) AS call_in,
  (coalesce(fan_in_modules, 0) >= 2 AND NOT starts_with(name, '_')) OR coalesce(r, false) AS reusable,
  n.id IN (SELECT id FROM live) OR coalesce(m, false) AS mandatory, coalesce(k, false) AS keep, coalesce(others, []) AS others
  FROM n LEFT JOIN fan USING (id) LEFT JOIN a USING (id) WHERE n.kind IN ('Function', 'Method', 'Class')),
inv AS (SELECT *, call_in = 0 AND NOT mandatory AND NOT starts_with(name, '_') AND NOT keep AS dead FROM f)"""


def _inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    notes = rows(spark, sf_dir, rel.ANNOTATIONS)
    return inventory.build(nodes(spark, sf_dir), edges(spark, sf_dir), notes, ("Red Widget",))


_SHOWN = "id, qualified_name, kind, lang, file, fan_in, fan_in_modules, reusable, mandatory, dead"


@query("AGG-01_fan_in", f"WITH {_N}, {_E} {_FAN}")
def fan_in(spark, sf_dir):
    return inventory.fan_in(nodes(spark, sf_dir), edges(spark, sf_dir))


@query(
    "AGG-04_inventory",
    f"""{_INVENTORY} SELECT {_SHOWN}, array_to_string(list_concat(CASE WHEN reusable THEN ['reusable'] ELSE [] END,
  list_concat(CASE WHEN mandatory THEN ['mandatory'] ELSE [] END, list_concat(CASE WHEN dead THEN ['dead'] ELSE [] END, others))), ',') AS labels FROM inv""",
)
def full_inventory(spark, sf_dir):
    return _inventory(spark, sf_dir).select(*_SHOWN.split(", "), F.array_join("labels", ",").alias("labels"))


@query("FLT-05_inventory_filter", f"{_INVENTORY} SELECT {_SHOWN} FROM inv WHERE reusable")
def inventory_filter(spark, sf_dir):
    return inventory.matching(_inventory(spark, sf_dir), " Reusable ").select(*_SHOWN.split(", "))


@query("FLT-06_dead_code", f"{_INVENTORY} SELECT {_SHOWN} FROM inv WHERE dead")
def dead_code(spark, sf_dir):
    return inventory.matching(_inventory(spark, sf_dir), "dead").select(*_SHOWN.split(", "))


@query("SRT-02_hotspots", f"{_INVENTORY} SELECT id, fan_in FROM inv ORDER BY fan_in DESC, seq LIMIT 5")
def hotspots(spark, sf_dir):
    return inventory.hotspots(_inventory(spark, sf_dir)).select("id", "fan_in")


@query(
    "AGG-05_architecture",
    f"""{_INVENTORY} SELECT 'lang' AS metric, lang AS name, count(*) AS value FROM n GROUP BY lang
UNION ALL SELECT 'total', 'modules', count(*) FROM n WHERE kind = 'Module' UNION ALL SELECT 'total', 'symbols', count(*) FROM inv
UNION ALL SELECT 'total', 'reusable', count(*) FROM inv WHERE reusable UNION ALL SELECT 'total', 'mandatory', count(*) FROM inv WHERE mandatory
UNION ALL SELECT 'total', 'dead', count(*) FROM inv WHERE dead""",
)
def architecture(spark, sf_dir):
    return inventory.overview(nodes(spark, sf_dir), _inventory(spark, sf_dir))


@query("JOIN-10_annotations", f"SELECT node_id AS id, string_agg(concat(label, '=', note), ',' ORDER BY label) AS notes FROM ({duck(rel.ANNOTATIONS)}) GROUP BY node_id")
def annotations(spark, sf_dir):
    found = inventory.annotation_maps(rows(spark, sf_dir, rel.ANNOTATIONS))
    pairs = F.array_sort(F.transform(F.map_entries("annotations"), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    return found.select("id", F.array_join(pairs, ",").alias("notes"))


@query("AGG-14_symbols_by_file", f"WITH {_N} SELECT file, count(*) AS symbols FROM n WHERE kind IN ('Function', 'Method', 'Class') GROUP BY file")
def symbols_by_file(spark, sf_dir):
    return nodes(spark, sf_dir).filter(is_symbol()).groupBy("file").agg(F.count("*").alias("symbols"))


@query("FLT-09_annotations_of", f"SELECT node_id, label, arg_max(note, seq) AS note FROM ({duck(rel.ANNOTATIONS)}) WHERE node_id = 'n6' GROUP BY ALL")
def annotations_of(spark, sf_dir):
    return inventory.annotations_of(rows(spark, sf_dir, rel.ANNOTATIONS), "n6")


# ---- traversal


def _bfs(start: str, depth: int, here: str, there: str, kinds: str) -> str:
    return f"""WITH RECURSIVE {_E}, r(id, d) AS (SELECT '{start}', 0 UNION SELECT e.{there}, d + 1 FROM r JOIN e ON e.{here} = r.id WHERE {kinds} AND dst <> '' AND d < {depth})
SELECT id, min(d) AS distance FROM r WHERE id <> '{start}' GROUP BY id"""


_ANY = "kind IN ('CALLS', 'INHERITS', 'IMPLEMENTS')"


@query("GRF-02_callees", _bfs("n1717", 4, "src", "dst", "kind = 'CALLS'"))
def callees(spark, sf_dir):
    return traverse.callees(edges(spark, sf_dir), one(spark, "n1717"), 4).select("id", "distance")


@query("GRF-03_callers", _bfs("n17", 3, "dst", "src", "kind = 'CALLS'"))
def callers(spark, sf_dir):
    return traverse.callers(edges(spark, sf_dir), one(spark, "n17"), 3).select("id", "distance")


@query("GRF-04_blast_radius", _bfs("n17", 5, "dst", "src", _ANY))
def blast_radius(spark, sf_dir):
    return traverse.blast_radius(edges(spark, sf_dir), one(spark, "n17")).select("id", "distance")


@query(
    "GRF-05_discovery_order",
    f"""WITH RECURSIVE {_N}, {_E}, r(id, d, path, confidence) AS (SELECT 'n17', 0, []::BIGINT[], '' UNION ALL
  SELECT e.src, d + 1, list_append(path, e.seq), e.confidence FROM r JOIN e ON e.dst = r.id WHERE {_ANY} AND d < 4),
first AS (SELECT id, d, path, confidence, row_number() OVER (PARTITION BY id ORDER BY d, path) AS k FROM r WHERE id <> 'n17')
SELECT first.id, coalesce(n.qualified_name, first.id) AS qualified_name, coalesce(n.kind, '?') AS kind, coalesce(file, '') AS file, d AS distance, first.confidence
FROM first LEFT JOIN n ON n.id = first.id WHERE k = 1""",
)
def discovery_order(spark, sf_dir):
    found = traverse.blast_radius(edges(spark, sf_dir), one(spark, "n17"), 4)
    return traverse.described(found, nodes(spark, sf_dir)).drop("root", "path")


@query(
    "GRF-06_closure",
    f"""WITH RECURSIVE {_E}, r(id) AS (SELECT unnest(['n17', 'n333']) UNION SELECT e.dst FROM r JOIN e ON e.src = r.id WHERE {_DEP}) SELECT id FROM r""",
)
def closure(spark, sf_dir):
    return traverse.closure(edges(spark, sf_dir), one(spark, "n17", "n333").withColumnRenamed("root", "id"))


@query(
    "GRF-07_change_impact",
    f"""WITH RECURSIVE {_N}, {_E}, r(root, id, d) AS (SELECT id, id, 0 FROM n WHERE kind IN ('Function', 'Method', 'Class') AND file IN ('Brand#3.py', 'Brand#12.py')
  UNION SELECT root, e.src, d + 1 FROM r JOIN e ON e.dst = r.id WHERE {_ANY} AND d < 3)
SELECT root, id, min(d) AS distance FROM r WHERE id <> root GROUP BY ALL""",
)
def change_impact(spark, sf_dir):
    files = spark.createDataFrame([("Brand#3.py",), ("Brand#12.py",)], "file string")
    return traverse.change_impact(nodes(spark, sf_dir), edges(spark, sf_dir), files).select("root", "id", "distance")


@query(
    "AGG-14_impact_by_file",
    f"""WITH RECURSIVE {_N}, {_E}, t AS (SELECT id, file, qualified_name AS symbol FROM n WHERE kind IN ('Function', 'Method', 'Class') AND file IN ('Brand#3.py', 'Brand#12.py')),
r(root, id, d) AS (SELECT id, id, 0 FROM t UNION SELECT root, e.src, d + 1 FROM r JOIN e ON e.dst = r.id WHERE {_ANY} AND d < 3)
SELECT file, symbol, t.id, count(DISTINCT r.id) - 1 AS affected FROM t JOIN r ON r.root = t.id GROUP BY ALL""",
)
def impact_by_file(spark, sf_dir):
    files = spark.createDataFrame([("Brand#3.py",), ("Brand#12.py",)], "file string")
    return traverse.impact_by_file(nodes(spark, sf_dir), edges(spark, sf_dir), files)


@query(
    "GRF-01_resolve_symbol",
    f"""WITH {_N}, q AS (SELECT unnest(['Brand#7.red widget', 'red widget', '_red widget', 'nothing', 'Brand#19.small ring']) AS symbol),
ex AS (SELECT symbol, n.seq, id FROM q JOIN n ON n.qualified_name = symbol),
al AS (SELECT * FROM ex UNION ALL SELECT symbol, n.seq, id FROM q JOIN n ON n.name = symbol WHERE n.kind <> 'Module' AND symbol NOT IN (SELECT symbol FROM ex))
SELECT q.symbol, CASE WHEN count(al.id) = 1 THEN min(al.id) END AS id,
  coalesce(array_to_string(CASE WHEN count(al.id) > 1 THEN list_slice(list(al.id ORDER BY al.seq), 1, 20) ELSE [] END, ','), '') AS candidates
FROM q LEFT JOIN al USING (symbol) GROUP BY q.symbol""",
)
def resolve_symbol(spark, sf_dir):
    asked = [("Brand#7.red widget",), ("red widget",), ("_red widget",), ("nothing",), ("Brand#19.small ring",)]
    found = traverse.resolve_symbols(nodes(spark, sf_dir), spark.createDataFrame(asked, "symbol string"))
    return found.withColumn("candidates", F.array_join("candidates", ","))


# ---- table maintenance


@query(
    "MUT-01_upsert_nodes",
    f"""WITH o AS (SELECT id, name, body_hash, seq, 0 AS t FROM ({duck(rel.NODES)}) WHERE seq % 3 <> 0),
u AS (SELECT * FROM o UNION ALL SELECT id, concat(name, '2'), body_hash, seq, 1 FROM ({duck(rel.NODES)}) WHERE seq % 2 = 0)
SELECT id, arg_max(name, t) AS name, arg_max(body_hash, t) AS body_hash, min(seq) AS seq FROM u GROUP BY id""",
)
def upsert_nodes(spark, sf_dir):
    rows_ = nodes(spark, sf_dir).select("id", "name", "body_hash", "seq")
    return tables.upsert(rows_.filter("seq % 3 <> 0"), rows_.filter("seq % 2 = 0").withColumn("name", F.concat("name", F.lit("2"))), ["id"])


_BOTH = f"""WITH {_N}, {_E},
un AS (SELECT id, name, seq, 0 AS t FROM n WHERE seq % 3 <> 0 UNION ALL SELECT id, concat(name, '2'), seq, 1 FROM n WHERE seq % 2 = 0),
ue AS (SELECT src, kind, dst, confidence, seq, 0 AS t FROM e WHERE seq % 3 <> 0 UNION ALL SELECT src, kind, dst, 'again', seq, 1 FROM e WHERE seq % 2 = 0)
SELECT 'node' AS what, id, arg_max(name, t) AS value, arg_min(seq, t * 100000000 + seq) AS seq FROM un GROUP BY id
UNION ALL SELECT 'edge', concat(src, ' ', kind, ' ', dst), arg_max(confidence, t * 100000000 + seq), arg_min(seq, t * 100000000 + seq) FROM ue GROUP BY src, kind, dst"""


@query("MUT-03_upsert_many", _BOTH)
def upsert_many(spark, sf_dir):
    n, e = nodes(spark, sf_dir).select("id", "name", "seq"), edges(spark, sf_dir)
    new_nodes = n.filter("seq % 2 = 0").withColumn("name", F.concat("name", F.lit("2")))
    new_edges = e.filter("seq % 2 = 0").withColumn("confidence", F.lit("again"))
    n, e = tables.upsert_graph(n.filter("seq % 3 <> 0"), e.filter("seq % 3 <> 0"), new_nodes, new_edges)
    shown = e.select(F.lit("edge").alias("what"), F.concat_ws(" ", "src", "kind", "dst").alias("id"), F.col("confidence").alias("value"), "seq")
    return shown.union(n.select(F.lit("node"), "id", "name", "seq"))


@query(
    "MUT-02_collapse_edges",
    f"""WITH r AS ({_RESOLVED}) SELECT src, kind, CASE WHEN dst <> '' THEN dst ELSE concat('?', callee_name, ':', receiver) END AS target,
  arg_max(receiver, seq) AS receiver, min(seq) AS seq FROM r GROUP BY ALL""",
)
def collapse_edges(spark, sf_dir):
    keyed = _resolved(spark, sf_dir).withColumn("key", edge_key()).select("key", "receiver", "seq")
    return tables.last_wins(keyed, ["key"]).select("key.*", "receiver", "seq")


@query(
    "MUT-04_delete_by_file",
    f"""WITH {_N}, {_E} SELECT src, kind, dst FROM e WHERE src NOT IN (SELECT id FROM n WHERE file = 'Brand#3.py')""",
)
def delete_by_file(spark, sf_dir):
    gone = spark.createDataFrame([("Brand#3.py",)], "file string")
    return tables.delete_files(nodes(spark, sf_dir), edges(spark, sf_dir), gone)[1].select("src", "kind", "dst")


@query(
    "MUT-06_set_annotation",
    f"""SELECT node_id, label, arg_max(note, t) AS note FROM (SELECT *, 0 AS t FROM ({duck(rel.ANNOTATIONS)}) UNION ALL
  SELECT node_id, 'legacy', 'again', seq, 1 FROM ({duck(rel.ANNOTATIONS)}) WHERE seq % 6 = 2) GROUP BY ALL""",
)
def set_annotation(spark, sf_dir):
    old = rows(spark, sf_dir, rel.ANNOTATIONS)
    new = old.filter("seq % 6 = 2").withColumns({"label": F.lit("legacy"), "note": F.lit("again")})
    return tables.upsert(old, new, ["node_id", "label"]).drop("seq")


_C = duck(rel.CHANGES)


@query("FLT-07_history_of", f"SELECT snapshot_id, change, detail, seq FROM ({_C}) WHERE node_id = 'n8'")
def history_of(spark, sf_dir):
    return tables.find(rows(spark, sf_dir, rel.CHANGES), node_id="n8").select("snapshot_id", "change", "detail", "seq").orderBy("seq")


@query("FLT-08_changes_between", f"SELECT * FROM ({_C}) WHERE snapshot_id > 3 AND snapshot_id <= 9")
def changes_between(spark, sf_dir):
    return history.changes_between(rows(spark, sf_dir, rel.CHANGES), 9, 3)


@query("AGG-11_next_snapshot_id", f"SELECT CAST(coalesce(max(snapshot_id), 0) + 1 AS INT) AS next_id FROM ({_C})")
def next_snapshot_id(spark, sf_dir):
    return tables.next_id(rows(spark, sf_dir, rel.CHANGES), "snapshot_id")


@query("SRT-04_latest_change", f"SELECT * FROM ({_C}) ORDER BY seq DESC LIMIT 1")
def latest_change(spark, sf_dir):
    return tables.latest(rows(spark, sf_dir, rel.CHANGES), "seq")


@query("WIN-03_latest_per_node", f"SELECT node_id, arg_max(change, seq) AS change, max(seq) AS seq FROM ({_C}) GROUP BY node_id")
def latest_per_node(spark, sf_dir):
    return rows(spark, sf_dir, rel.CHANGES).groupBy("node_id").agg(F.max_by("change", "seq").alias("change"), F.max("seq").alias("seq"))


@query("FN-04_edge_keys", f"WITH r AS ({_RESOLVED}) SELECT DISTINCT concat(src, '|', kind, '|', CASE WHEN dst <> '' THEN dst ELSE concat('?', callee_name, ':', receiver) END) AS edge_key FROM r")
def edge_keys(spark, sf_dir):
    keyed = _resolved(spark, sf_dir).select(edge_key().alias("k"))
    return keyed.select(F.concat_ws("|", "k.src", "k.kind", "k.target").alias("edge_key")).distinct()
