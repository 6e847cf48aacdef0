"""Queries of documents: ledger, drift, sources, scalar functions, vectors, streams, whole index."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions import scalar
from loomgraph.operators import history, vectors
from loomgraph.plans import delta, index, ledgers, lineage, store
from loomgraph.plans import relations as rel
from loomgraph.plans.registry import query
from loomgraph.plans.relations import duck, rows
from loomgraph.sources import outcomes, tree
from loomgraph.streaming import sync, watch

_O, _NEW = f"o AS ({duck(rel.OLD_NODES)})", f"w AS ({duck(rel.NEW_NODES)})"
_DIFF = f"""WITH {_O}, {_NEW} SELECT coalesce(w.id, o.id) AS node_id,
  CASE WHEN o.id IS NULL THEN 'added' WHEN w.id IS NULL THEN 'removed' ELSE 'modified' END AS change,
  CASE WHEN o.id IS NULL OR w.id IS NULL THEN '' WHEN o.file <> w.file THEN 'movida' ELSE 'firma/cuerpo cambiado' END AS detail
FROM o FULL JOIN w ON o.id = w.id WHERE o.id IS NULL OR w.id IS NULL OR o.file <> w.file OR o.body_hash <> w.body_hash"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return rows(spark, sf_dir, rel.OLD_NODES), rows(spark, sf_dir, rel.NEW_NODES)


# ---- versions and ledger


@query("MUT-09_diff_nodes", _DIFF)
def diff_nodes(spark, sf_dir):
    return history.diff_nodes(*_versions(spark, sf_dir)).drop("seq")


@query("MUT-10_change_records", f"SELECT 7 AS snapshot_id, * FROM ({_DIFF})")
def change_records(spark, sf_dir):
    return history.change_records(history.diff_nodes(*_versions(spark, sf_dir)), 7)


@query("AGG-06_change_summary", f"SELECT count(*) FILTER (WHERE change = 'added') AS added, count(*) FILTER (WHERE change = 'modified') AS modified, count(*) FILTER (WHERE change = 'removed') AS removed FROM ({_DIFF})")
def change_summary(spark, sf_dir):
    return history.summary(history.diff_nodes(*_versions(spark, sf_dir)))


_LEDGER = "SELECT concat('Document:', name) AS id, name, arg_max(digest, seq) AS body_hash, min(seq) AS seq FROM (SELECT *, regexp_replace(path, '^.*/', '') AS name FROM ({})) GROUP BY name"


@query("MUT-16_ledger_rows", _LEDGER.format(duck(rel.PATHS)))
def ledger_rows(spark, sf_dir):
    return history.document_nodes(rows(spark, sf_dir, rel.PATHS)).drop("file")


@query(
    "MUT-17_partial_commit",
    f"""WITH old AS ({_LEDGER.format(f"SELECT * FROM ({duck(rel.PATHS)}) WHERE seq % 5 <> 0")}), new AS ({_LEDGER.format(f"SELECT seq, path, concat(digest, CASE WHEN seq % 2 = 0 THEN 'x' ELSE '' END) AS digest FROM ({duck(rel.PATHS)}) WHERE seq % 4 <> 0")}),
diff AS (SELECT coalesce(new.id, old.id) AS id, new.id IS NULL AS gone FROM old FULL JOIN new ON old.id = new.id WHERE old.id IS NULL OR new.id IS NULL OR old.body_hash <> new.body_hash),
done AS (SELECT * FROM diff WHERE id < 'Document:5')
SELECT id, name, body_hash, seq FROM old WHERE id NOT IN (SELECT id FROM done)
UNION ALL SELECT id, name, body_hash, seq FROM new WHERE id IN (SELECT id FROM done WHERE NOT gone)""",
)
def partial_commit(spark, sf_dir):
    paths = rows(spark, sf_dir, rel.PATHS)
    ledger = history.document_nodes(paths.filter("seq % 5 <> 0"))
    new = paths.filter("seq % 4 <> 0").withColumn("digest", F.concat("digest", F.when(F.col("seq") % 2 == 0, "x").otherwise("")))
    applied = history.diff_nodes(ledger, history.document_nodes(new)).filter("node_id < 'Document:5'")
    return history.commit(ledger, new, applied).drop("file")


_HELD = "SELECT * FROM ({}) WHERE seq % 5 <> 0"
_OLD_LEDGER = _LEDGER.format(_HELD.format(duck(rel.PATHS)))
_CHANGED = f"SELECT seq, path, concat(digest, CASE WHEN seq % 2 = 0 THEN 'x' ELSE '' END) AS digest FROM ({duck(rel.PATHS)}) WHERE seq % 4 <> 0"
_LEDGER_DIFF = """SELECT coalesce(new.id, old.id) AS node_id, CASE WHEN old.id IS NULL THEN 'added' WHEN new.id IS NULL THEN 'removed' ELSE 'modified' END AS change,
  CASE WHEN old.id IS NULL OR new.id IS NULL THEN '' ELSE 'firma/cuerpo cambiado' END AS detail
FROM old FULL JOIN new ON old.id = new.id WHERE old.id IS NULL OR new.id IS NULL OR old.body_hash <> new.body_hash"""


def _ledger(spark: SparkSession, sf_dir: str) -> history.Ledger:
    """Two snapshots: nothing, then four fifths of the paths."""
    return history.record(history.empty_ledger(spark), rows(spark, sf_dir, rel.PATHS).filter("seq % 5 <> 0"))


@query("MUT-18_record_batch", f"WITH old AS ({_OLD_LEDGER}), new AS ({_LEDGER.format(_CHANGED)}) SELECT 1 AS snapshot_id, id AS node_id, 'added' AS change, '' AS detail FROM old UNION ALL SELECT 2, * FROM ({_LEDGER_DIFF})")
def record_batch(spark, sf_dir):
    new = rows(spark, sf_dir, rel.PATHS).filter("seq % 4 <> 0").withColumn("digest", F.concat("digest", F.when(F.col("seq") % 2 == 0, "x").otherwise("")))
    return history.record(_ledger(spark, sf_dir), new).changes


@query(
    "MUT-14_record_one",
    f"""WITH old AS ({_OLD_LEDGER}) SELECT id, snapshots, CASE WHEN id = 'Document:3.md' THEN 'fresh' ELSE body_hash END AS body_hash
FROM (SELECT id, body_hash FROM old UNION SELECT 'Document:3.md', NULL WHERE NOT EXISTS (FROM old WHERE id = 'Document:3.md')), (SELECT 3 AS snapshots)""",
)
def record_one(spark, sf_dir):
    once = history.record_one(_ledger(spark, sf_dir), "elsewhere/3.md", "fresh")
    twice = history.record_one(once, "3.md", "fresh")  # nothing changed, a snapshot all the same
    return twice.nodes.select("id", "body_hash").crossJoin(twice.snapshots.agg(F.count("*").cast("int").alias("snapshots")))


@query("SRC-16_stored_ledger", f"WITH old AS ({_OLD_LEDGER}), new AS ({_LEDGER.format(_CHANGED)}), kept AS (SELECT 1 AS version, id, body_hash FROM old UNION ALL SELECT 2, id, body_hash FROM new UNION ALL SELECT 3, id, body_hash FROM new WHERE id <> 'Document:5.md') SELECT version, id, body_hash FROM kept")
def stored_ledger(spark, sf_dir):
    """Three versions of a ledger on disk, each as it loads afterwards."""
    folder = f"{lineage.checkpoint_dir(spark)}/ledger-{uuid.uuid4().hex}"
    new = rows(spark, sf_dir, rel.PATHS).filter("seq % 4 <> 0").withColumn("digest", F.concat("digest", F.when(F.col("seq") % 2 == 0, "x").otherwise("")))
    ledgers.update(spark, folder, lambda ledger: history.record(ledger, rows(spark, sf_dir, rel.PATHS).filter("seq % 5 <> 0")))
    ledgers.update(spark, folder, lambda ledger: history.record(ledger, new))
    ledgers.update(spark, folder, lambda ledger: history.remove_one(ledger, "x/5.md"))
    shown = [ledgers.as_of(spark, folder, n).select(F.lit(n).alias("version"), "id", "body_hash") for n in (1, 2, 3)]
    return shown[0].union(shown[1]).union(shown[2])


@query(
    "MUT-15_remove_one",
    f"""WITH old AS ({_OLD_LEDGER}), s AS (SELECT CAST(1 + count(*) AS INT) AS snapshots FROM old WHERE id = 'Document:3.md')
SELECT id, snapshots FROM old, s WHERE id <> 'Document:3.md'""",
)
def remove_one(spark, sf_dir):
    gone = history.remove_one(history.remove_one(_ledger(spark, sf_dir), "docs/3.md"), "never/was.md")
    return gone.nodes.select("id").crossJoin(gone.snapshots.agg(F.count("*").cast("int").alias("snapshots")))


_FOLDER = f"SELECT concat('Document:', name) AS id, arg_max(digest, string_split(path, '/')) AS body_hash FROM (SELECT *, regexp_replace(path, '^.*/', '') AS name FROM ({_CHANGED})) GROUP BY name"
_SYNCED = f"""old AS (SELECT id, body_hash FROM ({_OLD_LEDGER})), new AS ({_FOLDER.replace("concat(digest, CASE WHEN seq % 2 = 0 THEN 'x' ELSE '' END)", "CASE WHEN seq % 2 = 0 THEN md5(concat(digest, 'x')) ELSE md5(digest) END")}),
diff AS ({_LEDGER_DIFF}), done AS (SELECT * FROM diff WHERE length(node_id) % 2 = 0)"""


def _folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    content = F.concat("digest", F.when(F.col("seq") % 2 == 0, "x").otherwise("")).cast("binary")
    return rows(spark, sf_dir, rel.PATHS).filter("seq % 4 <> 0").select("path", content.alias("content"), "seq")


def _folder_synced(spark: SparkSession, sf_dir: str) -> tuple[history.Ledger, DataFrame]:
    answer = F.when(F.length("node_id") % 2 == 0, "documento aceptado").otherwise("error 500")
    return history.sync_folder(_ledger(spark, sf_dir), _folder(spark, sf_dir), lambda diffs: diffs.select("node_id", answer.alias("message")))


@query(
    "MUT-20_sync_folder",
    f"""WITH {_SYNCED} SELECT id, body_hash FROM old WHERE id NOT IN (SELECT node_id FROM done)
UNION ALL SELECT id, body_hash FROM new WHERE id IN (SELECT node_id FROM done WHERE change <> 'removed')""",
)
def sync_folder(spark, sf_dir):
    return _folder_synced(spark, sf_dir)[0].nodes.select("id", "body_hash")


@query(
    "MUT-20_sync_summary",
    f"""WITH {_SYNCED} SELECT (SELECT count(*) FROM ({_CHANGED})) AS files, count(*) FILTER (WHERE change = 'added' AND ok) AS added, count(*) FILTER (WHERE change = 'modified' AND ok) AS modified,
  count(*) FILTER (WHERE change = 'removed' AND ok) AS removed, count(*) FILTER (WHERE NOT ok) AS errors,
  (SELECT coalesce(string_agg(name, ',' ORDER BY name), '') FROM (SELECT regexp_replace(path, '^.*/', '') AS name FROM ({_CHANGED}) GROUP BY 1 HAVING count(*) > 1)) AS duplicates
FROM (SELECT *, length(node_id) % 2 = 0 AS ok FROM diff)""",
)
def sync_summary(spark, sf_dir):
    return _folder_synced(spark, sf_dir)[1].withColumn("duplicates", F.array_join("duplicates", ","))


def _store(node_id: str, change: str, detail: str) -> str:
    """A store that takes names of even length, is out of reach for every third length, and refuses the rest."""
    if len(node_id) % 3 == 0:
        raise ConnectionError("out of reach")
    return "error 500" if len(node_id) % 2 else "documento aceptado"


@query(
    "MUT-20_entry_outcomes",
    f"""WITH {_SYNCED} SELECT node_id, change, length(node_id) % 3 = 0 AS raised, length(node_id) % 3 <> 0 AND length(node_id) % 2 = 0 AS ok,
  CASE WHEN length(node_id) % 3 = 0 THEN 'ConnectionError: out of reach' WHEN length(node_id) % 2 = 0 THEN 'documento aceptado' ELSE 'error 500' END AS message FROM diff""",
)
def entry_outcomes(spark, sf_dir):
    """Every difference of a folder sent to a store by tasks, and what each entry met."""
    kept = []

    def send(diffs: DataFrame) -> DataFrame:
        kept.append(outcomes.applied(diffs, _store))
        return kept[0]

    history.sync_folder(_ledger(spark, sf_dir), _folder(spark, sf_dir), send)
    return kept[0].select("node_id", "change", "raised", scalar.accepted(F.col("message")).alias("ok"), "message")


@query("MUT-25_digest_of", f"SELECT name AS file, body_hash FROM ({_OLD_LEDGER}) WHERE name = '7.md'")
def digest_of(spark, sf_dir):
    return history.digest_of(_ledger(spark, sf_dir), "any/where/7.md")


@query("CTL-05_document_state", f"SELECT count(*) AS documents, 1 AS last_id, count(*) AS last_count FROM ({_OLD_LEDGER})")
def document_state(spark, sf_dir):
    state = history.document_state(_ledger(spark, sf_dir))
    return state.select("documents", F.col("last_snapshot.id").alias("last_id"), F.col("last_snapshot.node_count").alias("last_count"))


@query("AGG-08_duplicate_names", f"SELECT name FROM (SELECT regexp_replace(path, '^.*/', '') AS name FROM ({duck(rel.PATHS)})) GROUP BY name HAVING count(*) > 1 ORDER BY name")
def duplicate_names(spark, sf_dir):
    return history.duplicate_names(rows(spark, sf_dir, rel.PATHS))


# ---- drift

_DRIFT = """WITH x AS (SELECT doc_id FROM documents WHERE doc_id % 4 <> 0), g AS (SELECT DISTINCT doc_id FROM labels), v AS (SELECT DISTINCT vec_id AS doc_id FROM embeddings)
SELECT 'missing_in_graph' AS drift_kind, doc_id FROM x WHERE doc_id NOT IN (SELECT doc_id FROM g)
UNION ALL SELECT 'missing_in_vector', doc_id FROM x WHERE doc_id NOT IN (SELECT doc_id FROM v)
UNION ALL SELECT 'orphan_in_graph', doc_id FROM g WHERE doc_id NOT IN (SELECT doc_id FROM x)
UNION ALL SELECT 'orphan_in_vector', doc_id FROM v WHERE doc_id NOT IN (SELECT doc_id FROM x)"""


def _drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    expected = table(spark, sf_dir, "documents").filter("doc_id % 4 <> 0")
    return history.drift(expected, table(spark, sf_dir, "labels"), table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "doc_id"))


@query("SET-01_alignment", _DRIFT)
def alignment(spark, sf_dir):
    return _drift(spark, sf_dir)


@query("AGG-09_drift_summary", f"SELECT {', '.join(f'''count(*) FILTER (WHERE drift_kind = '{k}') AS {k}''' for k in ('missing_in_graph', 'missing_in_vector', 'orphan_in_graph', 'orphan_in_vector'))}, count(*) = 0 AS is_aligned FROM ({_DRIFT})")
def drift_summary(spark, sf_dir):
    return history.drift_summary(_drift(spark, sf_dir))


@query(
    "SET-02_repair_plan",
    f"""SELECT DISTINCT CASE WHEN starts_with(drift_kind, 'missing') THEN 0 WHEN drift_kind = 'orphan_in_graph' THEN 1 ELSE 2 END AS kind_rank,
  CASE WHEN starts_with(drift_kind, 'missing') THEN 'reindex' WHEN drift_kind = 'orphan_in_graph' THEN 'delete_orphan_graph' ELSE 'delete_orphan_vector' END AS kind, doc_id FROM ({_DRIFT})""",
)
def repair_plan(spark, sf_dir):
    return history.repair_plan(_drift(spark, sf_dir))


@query(
    "MUT-22_reconcile",
    f"""WITH p AS ({_DRIFT}), again AS (SELECT doc_id FROM p WHERE starts_with(drift_kind, 'missing'))
SELECT 'graph' AS store, doc_id FROM (SELECT doc_id FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM p WHERE drift_kind = 'orphan_in_graph') UNION SELECT doc_id FROM again)
UNION ALL SELECT 'vector', doc_id FROM (SELECT vec_id AS doc_id FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM p WHERE drift_kind = 'orphan_in_vector') UNION SELECT doc_id FROM again)""",
)
def reconcile(spark, sf_dir):
    plan = history.repair_plan(_drift(spark, sf_dir))
    graph, vector = history.reconciled(plan, table(spark, sf_dir, "labels"), table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "doc_id"))
    return graph.select(F.lit("graph").alias("store"), "doc_id").union(vector.select(F.lit("vector"), "doc_id"))


# ---- sources

_STATES = "CASE WHEN doc_id % 5 = 0 THEN 'pending' WHEN doc_id % 5 = 1 THEN 'failed' ELSE 'preprocessed' END"


def _status(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("state", F.expr(_STATES))
    own = F.struct(F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.col("doc_id").cast("string")).alias("id"), F.col("doc_id").cast("string").alias("doc_id"), F.concat(F.lit("in/"), "source", F.lit("/"), F.col("doc_id"), F.lit(".MD")).alias("file_path"))
    # One text per hundred documents, as a paged status request gives.
    grouped = docs.groupBy(F.floor(F.col("doc_id") / 100).alias("page"), "state").agg(F.collect_list(own).alias("docs"))
    texts = grouped.groupBy("page").agg(F.map_from_entries(F.collect_list(F.struct("state", "docs"))).alias("statuses")).select(F.to_json(F.struct("statuses")).alias("json"))
    return tree.status_documents(texts)


@query("SRC-11_status_documents", f"SELECT {_STATES} AS state, CAST(doc_id AS STRING) AS doc_id, concat('in/', source, '/', doc_id, '.MD') AS file_path FROM documents")
def status_documents(spark, sf_dir):
    return _status(spark, sf_dir).select("state", "doc_id", "file_path")


@query("SRC-13_distinct_ids", "SELECT DISTINCT doc_id FROM labels WHERE doc_id IS NOT NULL")
def distinct_ids(spark, sf_dir):
    return table(spark, sf_dir, "labels").select("doc_id").filter("doc_id IS NOT NULL").distinct()


@query("SRC-14_processed_ids", "SELECT DISTINCT CAST(doc_id AS STRING) AS doc_id FROM documents WHERE doc_id % 5 > 1")
def processed_ids(spark, sf_dir):
    return tree.processed_ids(_status(spark, sf_dir))


@query("AGG-07_status_counts", f"SELECT upper({_STATES}) AS state, count(*) AS n FROM documents GROUP BY 1")
def status_counts(spark, sf_dir):
    return _status(spark, sf_dir).groupBy(F.upper("state").alias("state")).agg(F.count("*").alias("n"))


@query("JOIN-09_find_by_name", "SELECT CAST(doc_id AS STRING) AS doc_id FROM documents WHERE doc_id = 77")
def find_by_name(spark, sf_dir):
    return tree.find_by_name(_status(spark, sf_dir), "/elsewhere/77.md").select("doc_id")


@query("SRC-03_read_text", "SELECT page_id, md5(regexp_replace(coalesce(html, ''), '\\r\\n?', chr(10), 'g')) AS text_md5 FROM pages")
def read_text(spark, sf_dir):
    content = F.coalesce("html", F.lit("")).cast("binary")
    return table(spark, sf_dir, "pages").select("page_id", F.md5(scalar.text_of(content)).alias("text_md5"))


_LINES = """SELECT event_id AS place, CASE event_id % 8 WHEN 0 THEN concat('# ', event_type) WHEN 1 THEN '   ' WHEN 2 THEN concat(' =', event_type) WHEN 3 THEN event_type
  WHEN 4 THEN concat('  U', CAST(user_id AS STRING), ' = "', event_type, '" ') WHEN 5 THEN concat('U', CAST(user_id AS STRING), '=', CHR(39), 'a=b', CHR(39))
  WHEN 6 THEN concat('T', CAST(user_id % 20 AS STRING), '=  ', event_type, ' # kept') ELSE concat('T', CAST(user_id % 30 AS STRING), '=') END AS line FROM {events}"""


@query(
    "SRC-15_environment",
    f"""SELECT key, arg_max(trim(trim(trim(substr(line, strpos(line, '=') + 1)), '"'), chr(39)), place) AS value
FROM (SELECT place, trim(line) AS line, trim(split_part(line, '=', 1)) AS key FROM ({duck(_LINES)}))
WHERE NOT starts_with(line, '#') AND contains(line, '=') AND key <> '' GROUP BY key""",
)
def environment(spark, sf_dir):
    return tree.environment(rows(spark, sf_dir, _LINES).withColumnRenamed("place", "at"))


# ---- scalar functions


@query("FN-01_content_hash", "SELECT doc_id, md5(text) AS digest FROM documents")
def content_hash(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("digest"))


@query("FN-03_basename", "SELECT page_id, regexp_replace(regexp_replace(url, '/+$', ''), '^.*/', '') AS name FROM pages")
def basename(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", scalar.basename(F.col("url")).alias("name"))


@query(
    "FN-05_format_size",
    """SELECT o_orderkey, CASE WHEN n < 1024 THEN concat(n, 'B') WHEN n < 1048576 THEN concat(printf('%.1f', n / 1024.0), 'KB')
  WHEN n < 1073741824 THEN concat(printf('%.1f', n / 1048576.0), 'MB') ELSE concat(printf('%.1f', n / 1073741824.0), 'GB') END AS size
FROM (SELECT o_orderkey, CAST(o_orderkey * o_orderkey * 7919 + o_orderkey AS BIGINT) AS n FROM orders)""",
)
def format_size(spark, sf_dir):
    n = (F.col("o_orderkey") * F.col("o_orderkey") * 7919 + F.col("o_orderkey")).cast("long")
    return table(spark, sf_dir, "orders").select("o_orderkey", scalar.format_size(n).alias("size"))


@query(
    "FN-06_format_duration",
    """SELECT o_orderkey, CASE WHEN o_orderkey < 60 THEN concat(o_orderkey, 's') WHEN o_orderkey < 3600 THEN concat(o_orderkey // 60, 'm', lpad(CAST(o_orderkey % 60 AS STRING), 2, '0'), 's')
  ELSE concat(o_orderkey // 3600, 'h', lpad(CAST(o_orderkey % 3600 // 60 AS STRING), 2, '0'), 'm') END AS duration FROM orders""",
)
def format_duration(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", scalar.format_duration(F.col("o_orderkey")).alias("duration"))


@query(
    "FN-07_status_line",
    """WITH c AS (SELECT source, CASE doc_id % 6 WHEN 0 THEN 'PENDING' WHEN 1 THEN 'PROCESSING' WHEN 2 THEN 'FAILED' WHEN 3 THEN 'ODD' ELSE 'PROCESSED' END AS state, count(*) AS n FROM documents GROUP BY ALL),
p AS (SELECT source, string_agg(concat(CASE state WHEN 'PENDING' THEN 'pendientes' WHEN 'PROCESSING' THEN 'procesando' WHEN 'PROCESSED' THEN 'indexados' WHEN 'FAILED' THEN 'fallidos' ELSE 'odd' END, '=', n), '  '
  ORDER BY CASE state WHEN 'PENDING' THEN 0 WHEN 'PROCESSING' THEN 1 WHEN 'PROCESSED' THEN 2 WHEN 'FAILED' THEN 3 ELSE 4 END) AS line, sum(n) AS total FROM c GROUP BY source)
SELECT source, concat(line, CASE total % 3 WHEN 0 THEN '  pipeline=ocupado' WHEN 1 THEN '  pipeline=inactivo' ELSE '' END) AS line FROM p""",
)
def status_line(spark, sf_dir):
    state = F.expr("CASE doc_id % 6 WHEN 0 THEN 'PENDING' WHEN 1 THEN 'PROCESSING' WHEN 2 THEN 'FAILED' WHEN 3 THEN 'ODD' ELSE 'PROCESSED' END")
    counts = table(spark, sf_dir, "documents").groupBy("source", state.alias("state")).agg(F.count("*").alias("n"))
    grouped = counts.groupBy("source").agg(F.map_from_entries(F.collect_list(F.struct("state", "n"))).alias("counts"), F.sum("n").alias("total"))
    busy = F.when(F.col("total") % 3 == 0, True).when(F.col("total") % 3 == 1, False)
    return grouped.select("source", scalar.status_line(F.col("counts"), busy).alias("line"))


@query("FN-08_progress", "SELECT doc_id, doc_id * 100 // t AS pct, round(3.5 / (doc_id + 1) * (t - doc_id - 1), 6) AS eta FROM documents, (SELECT max(doc_id) + 1 AS t FROM documents)")
def progress(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id")
    docs = docs.crossJoin(docs.agg((F.max("doc_id") + 1).alias("total")))  # one row
    eta = scalar.eta(F.lit(3.5), F.col("doc_id") + 1, F.col("total"))
    return docs.select("doc_id", scalar.progress(F.col("doc_id"), F.col("total")).alias("pct"), F.round(eta, 6).alias("eta"))


_ENVS = """SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN NULL WHEN 1 THEN 'PGKVStorage' ELSE 'JsonKVStorage' END AS kv,
  CASE p_partkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'NanoVectorDBStorage' ELSE 'PGVectorStorage' END AS vector,
  CASE p_partkey % 7 WHEN 0 THEN NULL WHEN 1 THEN 'NetworkXStorage' WHEN 2 THEN 'PGGraphStorage' ELSE 'Neo4JStorage' END AS graph,
  CASE p_partkey % 2 WHEN 0 THEN NULL ELSE 'PGDocStatusStorage' END AS doc_status,
  CASE WHEN p_size % 3 = 0 THEN 'bolt://h' WHEN p_size % 3 = 1 THEN '' END AS graph_uri, CASE WHEN p_size % 4 = 0 THEN 'secret' END AS graph_password,
  CASE WHEN p_size % 5 = 0 THEN 'host' END AS table_host, CASE WHEN p_size % 2 = 0 THEN 'secret' END AS table_password FROM {part}"""
_PROFILE = """CASE concat_ws('/', coalesce(kv, 'JsonKVStorage'), coalesce(vector, 'NanoVectorDBStorage'), coalesce(graph, 'NetworkXStorage'), coalesce(doc_status, 'JsonDocStatusStorage'))
  WHEN 'JsonKVStorage/NanoVectorDBStorage/NetworkXStorage/JsonDocStatusStorage' THEN 'filesystem' WHEN 'PGKVStorage/PGVectorStorage/PGGraphStorage/PGDocStatusStorage' THEN 'postgres'
  WHEN 'JsonKVStorage/NanoVectorDBStorage/Neo4JStorage/JsonDocStatusStorage' THEN 'neo4j' WHEN 'PGKVStorage/PGVectorStorage/Neo4JStorage/PGDocStatusStorage' THEN 'hibrido' ELSE 'mixed' END"""


@query("FN-09_storage_profile", f"SELECT p_partkey, {_PROFILE} AS profile FROM ({duck(_ENVS)})")
def storage_profile(spark, sf_dir):
    return rows(spark, sf_dir, _ENVS).select("p_partkey", scalar.storage_profile().alias("profile"))


@query(
    "FN-10_storage_problems",
    f"""SELECT p_partkey, concat_ws(',', CASE WHEN g AND coalesce(graph_uri, '') = '' THEN 'error: graph without uri' END, CASE WHEN g AND coalesce(graph_password, '') = '' THEN 'error: graph without password' END,
  CASE WHEN t AND coalesce(table_host, '') = '' THEN 'error: tables without host' END, CASE WHEN t AND coalesce(table_password, '') = '' THEN 'error: tables without password' END,
  CASE WHEN profile = 'mixed' THEN 'warning: mixed profile' END, CASE WHEN profile <> 'filesystem' THEN 'warning: reindex after a change' END) AS problems
FROM (SELECT *, coalesce(graph = 'Neo4JStorage', false) AS g, coalesce(starts_with(kv, 'PG'), false) OR coalesce(starts_with(vector, 'PG'), false) OR coalesce(starts_with(graph, 'PG'), false) OR coalesce(starts_with(doc_status, 'PG'), false) AS t,
  {_PROFILE} AS profile FROM ({duck(_ENVS)}))""",
)
def storage_problems(spark, sf_dir):
    return rows(spark, sf_dir, _ENVS).select("p_partkey", F.array_join(scalar.storage_problems(), ",").alias("problems"))


_HEALTH = """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'no object' WHEN 1 THEN concat('{{"KV_Storage": "', p_brand, '", "working_dir": "d", "storage_list": [1], "max_storage": ', CAST(p_size AS STRING), '}}')
  WHEN 2 THEN concat('{{"status": "ok", "storage": "outer", "configuration": {{"Graph_STORAGE": "', p_type, '", "vector_storage": {{"a": 1}}, "llm": "x"}}}}')
  ELSE concat('{{"configuration": "flat", "doc_storage": null, "kv_storage": "', p_name, '"}}') END AS health FROM {part}"""


@query(
    "FLT-15_storage_entries",
    """SELECT p_partkey, 'kv_storage' AS field, p_brand AS value FROM part WHERE p_partkey % 4 = 1 UNION ALL SELECT p_partkey, 'max_storage', CAST(p_size AS VARCHAR) FROM part WHERE p_partkey % 4 = 1
UNION ALL SELECT p_partkey, 'graph_storage', p_type FROM part WHERE p_partkey % 4 = 2 UNION ALL SELECT p_partkey, 'kv_storage', p_name FROM part WHERE p_partkey % 4 = 3""",
)
def storage_entries(spark, sf_dir):
    return rows(spark, sf_dir, _HEALTH).select("p_partkey", F.explode(scalar.storage_entries(F.col("health"))).alias("field", "value"))


@query("FN-14_accepted", "SELECT doc_id, doc_id % 4 IN (0, 2) AS ok FROM documents")
def accepted(spark, sf_dir):
    message = F.expr("CASE doc_id % 4 WHEN 0 THEN concat('subido ', source, ': aceptado') WHEN 1 THEN 'error' WHEN 2 THEN 'sin duplicar' END")
    return table(spark, sf_dir, "documents").select("doc_id", scalar.accepted(message).alias("ok"))


@query("FN-15_first_truthy", "SELECT page_id, coalesce(nullif(CASE WHEN page_id % 2 = 0 THEN '' ELSE 'response' END, ''), nullif(url, '')) AS answer FROM pages")
def first_truthy(spark, sf_dir):
    odd = F.when(F.col("page_id") % 2 == 0, "").otherwise("response")
    return table(spark, sf_dir, "pages").select("page_id", scalar.first_truthy(odd, F.col("url")).alias("answer"))


@query("FN-16_mode", "SELECT doc_id, CASE WHEN source IN ('local', 'global', 'hybrid', 'mix', 'naive') THEN source ELSE 'mix' END AS mode FROM documents")
def mode(spark, sf_dir):
    modes = ("local", "global", "hybrid", "mix", "naive")
    return table(spark, sf_dir, "documents").select("doc_id", scalar.mode_or_default(F.col("source"), modes, "other").alias("mode"))


@query("PAR-01_module_names", "SELECT page_id, regexp_replace(regexp_replace(replace(path, '/', '.'), '\\.md$', ''), '^\\.+', '') AS module FROM (SELECT seq AS page_id, path FROM (" + duck(rel.PATHS) + "))")
def module_names(spark, sf_dir):
    return rows(spark, sf_dir, rel.PATHS).select(F.col("seq").alias("page_id"), scalar.module_name(F.concat(F.lit("./"), "path")).alias("module"))


_BLOCK = r"<script[^>]*>(.*?)</script>"


@query("PAR-05_script_blocks", rf"SELECT page_id, CAST(len(regexp_extract_all(html, '(?s){_BLOCK}', 1)) AS INT) AS blocks, md5(array_to_string(regexp_extract_all(html, '(?s){_BLOCK}', 1), chr(10))) AS script FROM pages WHERE html IS NOT NULL")
def script_blocks(spark, sf_dir):
    found = F.regexp_extract_all("html", F.lit(f"(?s){_BLOCK}"), F.lit(1))
    return table(spark, sf_dir, "pages").filter("html IS NOT NULL").select("page_id", F.size(found).alias("blocks"), F.md5(F.array_join(found, "\n")).alias("script"))


@query("AGG-12_total_size", "SELECT CAST(sum(strlen(text)) AS BIGINT) AS total FROM documents")
def total_size(spark, sf_dir):
    return table(spark, sf_dir, "documents").agg(F.sum(F.octet_length("text")).alias("total"))


# ---- vectors


@query("VEC-01_top_k", "SELECT e.vec_id, round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS similarity FROM embeddings AS e, (SELECT embedding FROM embeddings WHERE vec_id = 0) AS q ORDER BY similarity DESC, e.vec_id LIMIT 40")
def top_k(spark, sf_dir):
    embeddings = table(spark, sf_dir, "embeddings")
    asked = embeddings.filter("vec_id = 0").first()
    if asked is None:  # the SQL, too, has no rows then
        return embeddings.select("vec_id", F.lit(0.0).alias("similarity")).limit(0)
    return vectors.top_k(embeddings, asked["embedding"]).withColumn("similarity", F.round("similarity", 6))


@query(
    "VEC-01_search_all",
    """WITH s AS (SELECT q.vec_id AS query_id, e.vec_id, round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS similarity
  FROM embeddings AS e, embeddings AS q WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS rank FROM s)
SELECT query_id, rank, vec_id, similarity FROM r WHERE rank <= 40""",
)
def search_all(spark, sf_dir):
    """Every vector whose id is divisible by 20 against all vectors."""
    embeddings = table(spark, sf_dir, "embeddings")
    return vectors.nearest(embeddings, embeddings.filter("vec_id % 20 = 0"))


@query(
    "VEC-02_expanded",
    f"""WITH e AS ({duck(rel.EDGES)}), h AS (SELECT concat('n', e.vec_id) AS id, round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS similarity
  FROM embeddings AS e, (SELECT embedding FROM embeddings WHERE vec_id = 0) AS q ORDER BY similarity DESC, e.vec_id LIMIT 40),
x AS (SELECT src AS a, dst AS b FROM e WHERE kind IN ('CALLS', 'INHERITS', 'IMPLEMENTS') AND dst <> '' UNION SELECT dst, src FROM e WHERE kind IN ('CALLS', 'INHERITS', 'IMPLEMENTS') AND dst <> ''),
r AS (SELECT id, similarity, 0 AS distance FROM h UNION ALL SELECT x.b, similarity, 1 FROM h JOIN x ON x.a = h.id WHERE x.b <> h.id)
SELECT id, max(similarity) AS similarity, min(distance) AS distance FROM r GROUP BY id""",
)
def expanded(spark, sf_dir):
    hits = top_k(spark, sf_dir).select(F.concat(F.lit("n"), F.col("vec_id").cast("string")).alias("id"), "similarity")
    return vectors.expanded(hits, rows(spark, sf_dir, rel.EDGES))


# ---- streams


@query("STR-02_stream_counts", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_counts(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("ts", "event_type")
    folder = f"{lineage.checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    events.write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(events.schema).parquet(f"{folder}/in")

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    counted = sync.window_counts(stream)
    running = counted.writeStream.outputMode("update").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(keep).start()
    running.awaitTermination()
    latest = spark.read.parquet(f"{folder}/out").groupBy("start", "event_type").agg(F.max_by("n", "batch").alias("n"))
    return latest.withColumn("start", F.col("start").cast("timestamp_ntz"))


_POLLS = """SELECT user_id AS watch, event_id AS place, CASE WHEN event_id % 9 = 0 THEN NULL ELSE event_id % 4 = 1 END AS busy,
  CASE WHEN event_id % 18 = 0 THEN NULL WHEN event_id % 5 = 0 THEN 2 ELSE 0 END AS pending FROM {events}"""


_ENDS = (
    f"""WITH q AS (SELECT watch, place, busy IS NULL AND pending IS NULL AS lost, coalesce(NOT busy, false) AND coalesce(pending, 0) = 0 AS quiet FROM ({duck(_POLLS)})),
w AS (SELECT *, quiet AND coalesce(lag(quiet) OVER (PARTITION BY watch ORDER BY place), false) AS twice FROM q)
SELECT watch, min(place) AS ended_at FROM w WHERE lost OR twice GROUP BY watch"""
)


@query("STR-01_watch_end", _ENDS)
def watch_end(spark, sf_dir):
    return sync.idle(rows(spark, sf_dir, _POLLS).withColumnRenamed("place", "at")).withColumnRenamed("at", "ended_at")


@query("STR-01_watch_stream", _ENDS)
def watch_stream(spark, sf_dir):
    """Polls that arrive in two parts; the second run of the stream goes on from the first one's states."""
    folder = f"{lineage.checkpoint_dir(spark)}/watch-{uuid.uuid4().hex}"
    polls = rows(spark, sf_dir, _POLLS).withColumnRenamed("place", "at")
    half = polls.agg(F.avg("at")).first()[0] or 0
    for part in (polls.filter(F.col("at") <= half), polls.filter(F.col("at") > half)):
        part.write.mode("append").parquet(f"{folder}/polls")
        ends = watch.watch_ends(spark.readStream.schema(polls.schema).parquet(f"{folder}/polls"))
        ends.writeStream.format("parquet").option("path", f"{folder}/ends").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("watch long, at long").parquet(f"{folder}/ends").withColumnRenamed("at", "ended_at")


# ---- parsing and the whole index, over sources made from the driver's rows

_SOURCE = '''import lib%d as other
from pkg import helper%d

class Service%d(Base, mod.Other):
    def run(self):
        helper%d()
        return self.stop(other.go(1))

    def stop(self, value):
        return value

def main():
    Service%d().run()
    if True:
        def hidden():
            pass
'''


def _sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey").cast("string")
    text = F.replace(F.lit(_SOURCE), F.lit("%d"), F.concat(F.lit(""), (F.col("p_partkey") % 40).cast("string")))
    path = F.concat(F.lit("src/"), F.regexp_replace("p_brand", "#", ""), F.lit("/m"), key, F.lit(".py"))
    return table(spark, sf_dir, "part").select(path.alias("path"), text.cast("binary").alias("content"))


_FILES = "SELECT concat('src.', replace(p_brand, '#', ''), '.m', p_partkey) AS m, CAST(p_partkey % 40 AS VARCHAR) AS v, concat('src/', replace(p_brand, '#', ''), '/m', p_partkey, '.py') AS path FROM part"


def _per_file(columns: str, rows_: list[str]) -> str:
    """SQL: these rows for every source of ``_sources``, {M} being its module and {V} its number."""
    shown = ", ".join(c if c == "external" else f"replace(replace({c}, '{{M}}', m), '{{V}}', v) AS {c}" for c in columns.split(", "))
    return f"SELECT path, {shown} FROM ({_FILES}), (VALUES {', '.join(rows_)}) AS t({columns})"


_EDGE = "src, kind, dst, callee_name, receiver, confidence, external"
_DEFINED = [
    "('Module:{M}', 'IMPORTS', '', 'other', 'lib{V}', 'exact', false)", "('Module:{M}', 'IMPORTS', '', 'helper{V}', 'pkg.helper{V}', 'exact', false)",
    "('Module:{M}', 'DEFINES', 'Class:{M}.Service{V}', '', '', 'exact', false)", "('Module:{M}', 'DEFINES', 'Function:{M}.main', '', '', 'exact', false)",
    "('Class:{M}.Service{V}', 'DEFINES', 'Method:{M}.Service{V}.run', '', '', 'exact', false)", "('Class:{M}.Service{V}', 'DEFINES', 'Method:{M}.Service{V}.stop', '', '', 'exact', false)",
]


def _called(*answers: str) -> list[str]:
    """What the sources name but don't define, each with its target, confidence and whether it is external."""
    asked = [
        ("Class:{M}.Service{V}", "INHERITS", "Base", ""), ("Class:{M}.Service{V}", "INHERITS", "Other", ""), ("Method:{M}.Service{V}.run", "CALLS", "helper{V}", ""),
        ("Method:{M}.Service{V}.run", "CALLS", "stop", "self"), ("Method:{M}.Service{V}.run", "CALLS", "go", "other"), ("Function:{M}.main", "CALLS", "run", ""),
        ("Function:{M}.main", "CALLS", "Service{V}", ""),
    ]
    return [f"('{s}', '{k}', {a.split(', ')[0]}, '{n}', '{r}', {', '.join(a.split(', ')[1:])})" for (s, k, n, r), a in zip(asked, answers)]


_PARSED = _per_file(_EDGE, _DEFINED + _called(*["'', 'unresolved', false"] * 7))
_EXTERNAL = "'', 'heuristic', true"
_INDEXED = _per_file(_EDGE, _DEFINED + _called(_EXTERNAL, _EXTERNAL, _EXTERNAL, "'Method:{M}.Service{V}.stop', 'exact', false", _EXTERNAL, "'', 'unresolved', false", "'Class:{M}.Service{V}', 'exact', false"))
_NODES = _per_file("node_id", [f"('{n}')" for n in ("Module:{M}", "Class:{M}.Service{V}", "Method:{M}.Service{V}.run", "Method:{M}.Service{V}.stop", "Function:{M}.main")])
_RESYNCED = f"""SELECT 1 AS snapshot_id, node_id, 'added' AS change, '' AS detail FROM ({_NODES})
UNION ALL SELECT 2, node_id, 'removed', '' FROM ({_NODES}) WHERE path LIKE '%3.py' OR (path LIKE '%7%' AND node_id NOT LIKE 'Module:%')
UNION ALL SELECT 2, concat('Function:', m, '.other'), 'added', '' FROM ({_FILES}) WHERE path LIKE '%7%' AND path NOT LIKE '%3.py'"""


@query("PAR-02_parse_python", f"SELECT {_EDGE} FROM ({_PARSED})")
def parse_python(spark, sf_dir):
    return index.parse_files(_sources(spark, sf_dir))[1].drop("seq")


@query(
    "PAR-04_parse_visual_basic",
    """SELECT concat(kind, ':vb.m', p_partkey, rest) AS id, kind, concat('vb.m', p_partkey, rest) AS qualified_name, CASE WHEN rest = '' THEN concat('m', p_partkey) ELSE name END AS name,
  concat('vb/m', p_partkey, '.bas') AS file, CAST(lineno AS INT) AS lineno, CAST(end_lineno AS INT) AS end_lineno, 'vb6' AS lang, CASE WHEN body = '' THEN '' ELSE md5(replace(body, '|', chr(10))) END AS body_hash
FROM part, (VALUES ('Module', '', '', 1, 7, ''), ('Class', '.C', 'C', 1, 7, 'Public Class C| Inherits Base| Sub Go()|  Call Run|  obj.Stop (1) '' note| End Sub|End Class'),
  ('Method', '.C.Go', 'Go', 3, 6, ' Sub Go()|  Call Run|  obj.Stop (1) '' note| End Sub')) AS t(kind, rest, name, lineno, end_lineno, body)""",
)
def parse_visual_basic(spark, sf_dir):
    code = "Public Class C\n Inherits Base\n Sub Go()\n  Call Run\n  obj.Stop (1) ' note\n End Sub\nEnd Class\n"
    files = table(spark, sf_dir, "part").select(F.concat(F.lit("vb/m"), "p_partkey", F.lit(".bas")).alias("path"), F.lit(code).cast("binary").alias("content"))
    return index.parse_files(files)[0].drop("seq")


@query(
    "PAR-05_parse_asp",
    """SELECT replace(src, '{K}', CAST(page_id AS VARCHAR)) AS src, kind, replace(dst, '{K}', CAST(page_id AS VARCHAR)) AS dst, replace(callee_name, '{K}', CAST(page_id % 7 AS VARCHAR)) AS callee_name,
  replace(receiver, '{K}', CAST(page_id % 7 AS VARCHAR)) AS receiver, confidence, false AS external
FROM pages, (VALUES ('Module:asp.p{K}', 'IMPORTS', '', 'lib{K}.asp', 'inc/lib{K}.asp', 'exact'), ('Module:asp.p{K}', 'IMPORTS', '', 'top.inc', '/top.inc', 'exact'),
  ('Module:asp.p{K}', 'DEFINES', 'Function:asp.p{K}.Go{K}', '', '', 'exact'), ('Function:asp.p{K}.Go{K}', 'CALLS', '', 'Run{K}', '', 'unresolved'),
  ('Function:asp.p{K}.Go{K}', 'CALLS', '', 'Write', 'Response', 'unresolved')) AS t(src, kind, dst, callee_name, receiver, confidence)""",
)
def parse_asp(spark, sf_dir):
    """Pages with two includes and a procedure that begins in one script block and ends in another."""
    number, few = F.col("page_id").cast("string"), (F.col("page_id") % 7).cast("string")
    text = F.concat(
        F.lit('<!-- #include file="inc/lib'), few, F.lit('.asp" -->\n<html><!--#INCLUDE virtual = "/top.inc"-->\n<% Sub Go'), number,
        F.lit("()\n Call Run"), few, F.lit(" %>\n<p>"), F.coalesce(F.translate("url", "<%>", ""), F.lit("")), F.lit("</p><%= Response.Write(\"a\")\n End Sub %>"),
    )
    files = table(spark, sf_dir, "pages").select(F.concat(F.lit("asp/p"), number, F.lit(".asp")).alias("path"), text.cast("binary").alias("content"))
    return index.parse_files(files)[1].drop("seq")


def _indexed(spark: SparkSession, sf_dir: str) -> index.Graph:
    return index.index(index.empty_graph(spark), _sources(spark, sf_dir), {"commit_sha": "abc"})


@query("MUT-11_full_index", f"SELECT {_EDGE} FROM ({_INDEXED})")
def full_index(spark, sf_dir):
    return _indexed(spark, sf_dir).edges.drop("seq")


@query("AGG-10_index_summary", "SELECT 1 AS snapshot_id, count(*) AS files, 5 * count(*) AS nodes, 13 * count(*) AS edges, 5 * count(*) AS added, 0 AS modified, 0 AS removed FROM part")
def index_summary(spark, sf_dir):
    shown = index.summary(_indexed(spark, sf_dir), _sources(spark, sf_dir))
    return shown.withColumns({c: F.col(c).cast("int") for c in ("modified", "removed")})


@query("CTL-04_index_state", "SELECT 1 AS snapshot_id, 'abc' AS commit_sha, 5 * count(*) AS node_count, 'def' AS head, true AS out_of_sync FROM part")
def index_state(spark, sf_dir):
    shown = index.state(_indexed(spark, sf_dir), "def")
    return shown.select(F.col("last_snapshot.id").alias("snapshot_id"), "last_snapshot.commit_sha", "last_snapshot.node_count", "head", "out_of_sync")


def _saved_index(spark: SparkSession, sf_dir: str) -> str:
    folder = f"{lineage.checkpoint_dir(spark)}/graph-{uuid.uuid4().hex}"
    graph, repeated = index.index_with_repeats(index.empty_graph(spark), _sources(spark, sf_dir), {"commit_sha": "abc"})
    index.save(graph, folder, repeated)
    return folder


def _edited(files: DataFrame) -> DataFrame:
    return files.withColumn("content", F.when(F.col("path").contains("7"), F.lit(b"def other():\n    main()\n")).otherwise(F.col("content")))


def _synced(spark: SparkSession, sf_dir: str) -> index.Graph:
    files, folder = _sources(spark, sf_dir), _saved_index(spark, sf_dir)
    edited = _edited(files).filter(~F.col("path").endswith("3.py"))
    delta.sync(spark, store.read_version(spark, folder), folder, edited, files.select(F.col("path").alias("file")))
    return index.load(spark, folder)


@query("MUT-12_sync_paths", _RESYNCED)
def sync_paths(spark, sf_dir):
    return _synced(spark, sf_dir).changes


@query(
    "MUT-12_synced_edges",
    f"""SELECT {_EDGE} FROM ({_INDEXED}) WHERE path NOT LIKE '%3.py' AND path NOT LIKE '%7%'
UNION ALL SELECT concat('Module:', m), 'DEFINES', concat('Function:', m, '.other'), '', '', 'exact', false FROM ({_FILES}) WHERE path LIKE '%7%' AND path NOT LIKE '%3.py'
UNION ALL SELECT concat('Function:', m, '.other'), 'CALLS', '', 'main', '', 'unresolved', false FROM ({_FILES}) WHERE path LIKE '%7%' AND path NOT LIKE '%3.py'""",
)
def synced_edges(spark, sf_dir):
    return _synced(spark, sf_dir).edges.drop("seq")


@query(
    "MUT-21_sync_target",
    f"""WITH c AS ({_RESYNCED}) SELECT 2 AS snapshot_id, 'overlay' AS target, count(*) FILTER (WHERE change = 'added') AS added, count(*) FILTER (WHERE change = 'removed') AS removed,
  1 AS durable_snapshots FROM c WHERE snapshot_id = 2""",
)
def sync_target(spark, sf_dir):
    files, folder = _sources(spark, sf_dir), _saved_index(spark, sf_dir)
    shown = delta.sync_to(spark, folder, _edited(files).filter(~F.col("path").endswith("3.py")), files.select(F.col("path").alias("file")), durable=False)
    durable = index.load(spark, folder).snapshots.agg(F.count("*").cast("int").alias("durable_snapshots"))
    return shown.select("snapshot_id", "target", "added", "removed").crossJoin(durable)


@query("STR-02_staged_edits", _RESYNCED)
def staged_edits(spark, sf_dir):
    """Edits staged as files, synced into the overlay by a stream."""
    folder = _saved_index(spark, sf_dir)
    edits = _edited(_sources(spark, sf_dir)).filter("path LIKE '%7%' OR path LIKE '%3.py'")
    edits = edits.select("path", F.when(~F.col("path").endswith("3.py"), F.col("content")).alias("content"), F.lit(1).cast("long").alias("seq"))
    edits.write.parquet(f"{folder}.staged")
    sync.sync_overlay(spark, f"{folder}.staged", f"{folder}.state", folder).awaitTermination()
    return index.load(spark, f"{folder}.overlay").changes
