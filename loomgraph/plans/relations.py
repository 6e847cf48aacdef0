"""Graph and document relations derived from the driver's tables, in SQL that both engines read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

NODES = """
SELECT concat('n', CAST(p_partkey AS STRING)) AS id,
  CASE WHEN p_partkey % 7 = 0 THEN 'Module' WHEN p_partkey % 7 = 1 THEN 'Class' WHEN p_partkey % 7 = 2 THEN 'Method' ELSE 'Function' END AS kind,
  concat(p_brand, '.', p_name) AS qualified_name, CASE WHEN p_partkey % 6 = 0 THEN concat('_', p_name) ELSE p_name END AS name,
  concat(p_brand, '.py') AS file, p_size AS lineno, p_size + 5 AS end_lineno,
  CASE WHEN p_partkey % 3 = 0 THEN 'python' ELSE 'vb6' END AS lang, md5(p_type) AS body_hash, p_partkey AS seq
FROM {part}"""
EDGES = """
SELECT concat('n', CAST(p_partkey AS STRING)) AS src, CASE WHEN p_partkey % 5 = 0 THEN 'DEFINES' ELSE 'CALLS' END AS kind,
  concat('n', CAST(CAST(floor(p_partkey / 2) AS BIGINT) AS STRING)) AS dst, '' AS callee_name, '' AS receiver,
  CASE WHEN p_partkey % 2 = 0 THEN 'exact' ELSE 'heuristic' END AS confidence, false AS external, 2 * p_partkey AS seq
FROM {part}
UNION ALL
SELECT concat('n', CAST(p_partkey AS STRING)), CASE WHEN p_partkey % 3 = 0 THEN 'INHERITS' ELSE 'CALLS' END,
  concat('n', CAST((7 * p_partkey + 3) % (SELECT count(*) FROM {part}) AS STRING)), '', '',
  CASE WHEN p_partkey % 4 = 0 THEN 'exact' ELSE 'heuristic' END, false, 2 * p_partkey + 1
FROM {part}"""
#: Symbols and calls for the resolver: parts are symbols of modules by brand, line items call them.
CODE_NODES = """
SELECT concat(CASE WHEN p_partkey < 100 THEN 'Module:' WHEN p_partkey % 4 = 0 THEN 'Class:' WHEN p_partkey % 4 = 1 THEN 'Method:' ELSE 'Function:' END, q) AS id,
  CASE WHEN p_partkey < 100 THEN 'Module' WHEN p_partkey % 4 = 0 THEN 'Class' WHEN p_partkey % 4 = 1 THEN 'Method' ELSE 'Function' END AS kind,
  q AS qualified_name, CASE WHEN p_partkey % 3 = 0 THEN concat(p_name, CAST(p_partkey % 50 AS STRING)) ELSE concat(p_name, CAST(p_partkey AS STRING)) END AS name,
  p_brand AS file, body_hash, p_partkey AS seq
FROM (SELECT *, md5(p_type) AS body_hash,
  CASE WHEN p_partkey % 4 = 1 THEN concat('c', CAST(p_partkey - 1 AS STRING), '.m', CAST(p_partkey AS STRING)) ELSE concat('c', CAST(p_partkey AS STRING)) END AS q
  FROM {part}) AS p"""
CODE_EDGES = """
SELECT n.id AS src, 'DEFINES' AS kind, m.id AS dst, '' AS callee_name, '' AS receiver, 'exact' AS confidence, false AS external, m.seq AS seq
FROM ({code_nodes}) AS n JOIN ({code_nodes}) AS m ON m.seq = n.seq + CASE WHEN n.kind = 'Class' THEN 1 ELSE 700 END
WHERE n.kind = 'Class' OR n.kind = 'Module'
UNION ALL
SELECT n.id, 'IMPORTS', '', concat('lib', CAST(n.seq % 9 AS STRING)), '', 'exact', false, 1000000 + n.seq FROM ({code_nodes}) AS n WHERE n.kind = 'Module'
UNION ALL
SELECT coalesce(n.id, 'Function:unknown'), CASE WHEN l.k % 8 = 0 THEN 'INHERITS' WHEN l.k % 8 = 1 THEN 'IMPLEMENTS' ELSE 'CALLS' END, '',
  CASE WHEN l.k % 8 < 2 THEN concat('pkg.', m.name) WHEN l.k % 8 = 2 THEN concat('lib', CAST(l.k % 9 AS STRING)) ELSE m.name END,
  CASE WHEN l.k % 5 = 0 THEN 'Self' WHEN l.k % 5 = 1 THEN concat('lib', CAST(l.k % 11 AS STRING)) WHEN l.k % 5 = 2 THEN 'obj' ELSE '' END,
  'unresolved', false, 2000000 + l.k
FROM (SELECT DISTINCT l_partkey AS p, l_suppkey AS s, l_partkey * 13 + l_suppkey AS k FROM {lineitem}) AS l
LEFT JOIN ({code_nodes}) AS n ON n.seq = l.p AND n.seq % 10 <> 9
JOIN ({code_nodes}) AS m ON m.seq = CASE WHEN l.k % 3 = 0 THEN l.p + 1 WHEN l.k % 3 = 1 THEN l.s + 700 ELSE l.s END"""
OLD_NODES = """
SELECT concat('Document:', CAST(doc_id AS STRING)) AS id, CAST(doc_id AS STRING) AS name, source AS file, md5(coalesce(text, '')) AS body_hash, doc_id AS seq
FROM {documents} WHERE doc_id % 10 <> 0"""
NEW_NODES = """
SELECT concat('Document:', CAST(doc_id AS STRING)) AS id, CAST(doc_id AS STRING) AS name, CASE WHEN doc_id % 11 = 0 THEN concat(source, '-moved') ELSE source END AS file,
  md5(CASE WHEN doc_id % 7 = 0 THEN concat(coalesce(text, ''), '!') ELSE coalesce(text, '') END) AS body_hash, doc_id AS seq
FROM {documents} WHERE doc_id % 10 <> 1"""
PATHS = "SELECT page_id AS seq, concat('docs/', CAST(page_id % 7 AS STRING), '/', CAST(page_id % 90 AS STRING), '.md') AS path, md5(html) AS digest FROM {pages}"
CHANGES = """
SELECT CAST(event_id % 20 AS INT) AS snapshot_id, concat('n', CAST(user_id AS STRING)) AS node_id,
  CASE WHEN event_type = 'error' THEN 'removed' WHEN event_type = 'click' THEN 'added' ELSE 'modified' END AS change, props AS detail, event_id AS seq
FROM {events}"""
ANNOTATIONS = """
SELECT concat('n', CAST(doc_id AS STRING)) AS node_id, CASE WHEN doc_id % 3 = 0 THEN 'keep' WHEN doc_id % 3 = 1 THEN 'reusable' ELSE 'legacy' END AS label,
  CAST(quality AS STRING) AS note, doc_id AS seq FROM {labels}
UNION ALL
SELECT concat('n', CAST(doc_id AS STRING)), CASE WHEN toxic = 1 THEN 'mandatory' ELSE 'seen' END, '', 1000000 + doc_id FROM {labels} WHERE doc_id % 2 = 0"""

VIEWS = {"code_nodes": CODE_NODES}


def sql_for(text: str, names: dict[str, str]) -> str:
    views = {k: v.format(**names) for k, v in VIEWS.items()}
    return text.format(**names, **views)


def duck(text: str) -> str:
    """The text over tables by their own names."""
    return sql_for(text, {t: t for t in TABLES})


def rows(spark: SparkSession, sf_dir: str, text: str, **views: DataFrame) -> DataFrame:
    """The text over the parquet files in ``sf_dir``; ``views`` stand for those of ``VIEWS``."""
    names = {t: f"parquet.`{sf_dir}/{t}.parquet`" for t in TABLES}
    return spark.sql(text.format(**names, **{v: "{" + v + "}" for v in views}), **views) if views else spark.sql(sql_for(text, names))
