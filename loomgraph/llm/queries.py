"""The registered queries of this subpackage and, where SQL can express one, its DuckDB oracle."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from loomgraph.llm import alignment, bpe_codec, collocations, exact_dedup, language_id, lm_scoring, matroska, packing, personal_data, repeats, simhash, token_counts, warc
from loomgraph.llm.common import documents, spread


def tokenizer(name: str) -> str:
    """A vocabulary file: in LOOMGRAPH_TOKENIZERS, or where the package of public tokenizers has it."""
    folder = os.environ.get("LOOMGRAPH_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score(spread(documents(spark, sf_dir)))


OP1_ORACLE = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
w AS (SELECT doc_id, unnest(ws) AS c, unnest(range(len(ws))) AS i FROM d),
t AS (
  SELECT doc_id, i, c, lag(c) OVER doc AS b, lag(c, 2) OVER doc AS a
  FROM w WINDOW doc AS (PARTITION BY doc_id ORDER BY i)),
c0 AS (SELECT doc_id, count(*) AS own, sum(count(*)) OVER () - count(*) AS n FROM t GROUP BY doc_id),
o1 AS (SELECT doc_id, c, count(*) AS own FROM t GROUP BY ALL),
c1 AS (SELECT doc_id, c, sum(own) OVER (PARTITION BY c) - own AS n FROM o1),
o2 AS (SELECT doc_id, b, c, count(*) AS own FROM t WHERE b IS NOT NULL GROUP BY ALL),
c2 AS (SELECT doc_id, b, c, sum(own) OVER (PARTITION BY b, c) - own AS n FROM o2),
o3 AS (SELECT doc_id, a, b, c, count(*) AS own FROM t WHERE a IS NOT NULL GROUP BY ALL),
c3 AS (SELECT doc_id, a, b, c, sum(own) OVER (PARTITION BY a, b, c) - own AS n FROM o3),
s AS (
  SELECT t.doc_id,
    CASE WHEN c3.n > 0 THEN ln(c3.n / h2.n)
         WHEN c2.n > 0 THEN ln(c2.n / h1.n) + if(t.a IS NULL, 0, ln(0.4))
         ELSE ln(greatest(c1.n, 0.5) / greatest(c0.n, 1)) + if(t.b IS NULL, 0, ln(0.4)) + if(t.a IS NULL, 0, ln(0.4)) END AS score,
    CASE WHEN c3.n > 0 OR (c2.n > 0 AND t.a IS NULL) OR t.b IS NULL THEN 0 ELSE 1 END AS gave_up
  FROM t JOIN c0 USING (doc_id) JOIN c1 ON c1.doc_id = t.doc_id AND c1.c = t.c
  LEFT JOIN c2 ON c2.doc_id = t.doc_id AND c2.b = t.b AND c2.c = t.c
  LEFT JOIN c3 ON c3.doc_id = t.doc_id AND c3.a = t.a AND c3.b = t.b AND c3.c = t.c
  LEFT JOIN c1 AS h1 ON h1.doc_id = t.doc_id AND h1.c = t.b
  LEFT JOIN c2 AS h2 ON h2.doc_id = t.doc_id AND h2.b = t.a AND h2.c = t.b),
r AS (SELECT doc_id, count(*) AS n_words, sum(gave_up) AS n_backoff, sum(score) AS score FROM s GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(n_backoff, 0)::BIGINT AS n_backoff,
       round(coalesce(score, 0), 4)::DOUBLE AS log_score
FROM d LEFT JOIN r USING (doc_id)
"""


def op2_repeat_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.removal_report(spread(documents(spark, sf_dir)))


OP2_ORACLE = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
pieces AS (SELECT doc_id, unnest(range(0, len(h) // 2, 500)) AS base, h FROM d),
p AS (SELECT doc_id, base, substring(h, 2 * base + 1, 2 * 549) AS part FROM pieces),
w AS (SELECT doc_id, base + i AS place, substring(part, 2 * i + 1, 100) AS s
  FROM (SELECT doc_id, base, part, unnest(range(0, least(500, len(part) // 2 - 49))) AS i FROM p)),
least_owner AS (SELECT s, min(doc_id) AS owner FROM w GROUP BY s HAVING min(doc_id) < max(doc_id)),
g AS (SELECT w.doc_id, w.place FROM w JOIN least_owner AS o ON o.s = w.s AND o.owner < w.doc_id),
m AS (SELECT *, CASE WHEN place <= lag(place) OVER (PARTITION BY doc_id ORDER BY place) + 50 THEN 0 ELSE 1 END AS opens FROM g),
n AS (SELECT *, sum(opens) OVER (PARTITION BY doc_id ORDER BY place) AS span FROM m),
spans AS (SELECT doc_id, span, min(place) AS a, max(place) + 50 AS b FROM n GROUP BY doc_id, span),
gaps AS (SELECT doc_id, b AS a, coalesce(lead(a) OVER (PARTITION BY doc_id ORDER BY a), 1000000000) AS b FROM spans
  UNION ALL SELECT doc_id, 0, min(a) FROM spans GROUP BY doc_id),
kept AS (SELECT doc_id, string_agg(substring(h, 2 * a + 1, 2 * (b - a)), '' ORDER BY a) AS h FROM gaps JOIN d USING (doc_id) GROUP BY doc_id),
sums AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans FROM spans GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
  CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept.h, d.h))) AS kept_sha256
FROM d LEFT JOIN sums USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(spread(documents(spark, sf_dir)))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(documents(spark, sf_dir))


OP4_ORACLE = r"""
WITH d AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = min(doc_id) OVER same AS kept, sha256(norm) AS text_sha256
FROM d WINDOW same AS (PARTITION BY norm)
"""


def op5_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_codec.round_trip(spread(documents(spark, sf_dir)), tokenizer("word_bpe_49k.json"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(spread(documents(spark, sf_dir)), tokenizer("byte_bpe_50k.json"), limit=1024)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))


OP7_ORACLE = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS body, strlen(coalesce(html, '')) AS n,
         max(page_id) OVER (PARTITION BY coalesce(html, '')) AS response
  FROM pages)
SELECT page_id, n AS payload_bytes, sha1(body) AS payload_digest,
       CASE WHEN n >= 1000 AND page_id <> response THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND page_id <> response THEN response END AS refers_to
FROM p
"""


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(spread(documents(spark, sf_dir)), tokenizer("byte_bpe_50k.json"), window=1024)


def op9_matroska_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matroska.read_back(matroska.mux(spread(documents(spark, sf_dir))))


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(spread(documents(spark, sf_dir)))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(spread(documents(spark, sf_dir)))


OP11_ORACLE = r"""
WITH d AS (
  SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS doc,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, doc, unnest(ps) AS piece, unnest(range(len(ps))) AS pi FROM (SELECT *, regexp_extract_all(t, '[^.,;:!?\x0A-\x0D]+') AS ps FROM d)),
w AS (SELECT lang, doc, pi, unnest(ws) AS w1, unnest(range(len(ws))) AS i FROM (SELECT *, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p)),
t AS (SELECT lang, w1, lead(w1) OVER o AS w2, lead(w1, 2) OVER o AS w3 FROM w WINDOW o AS (PARTITION BY doc, pi ORDER BY i)),
n AS (SELECT lang, count(*) AS n FROM t GROUP BY lang),
f1 AS (SELECT lang, w1, count(*) AS f FROM t GROUP BY ALL),
f2 AS (SELECT lang, w1, w2, count(*) AS f FROM t WHERE w2 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
f3 AS (SELECT lang, w1, w2, w3, count(*) AS f FROM t WHERE w3 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
c2 AS (
  SELECT f2.lang, f2.w1 || ' ' || f2.w2 AS phrase, f2.f AS a, x.f AS l, y.f AS r, 1000000 * f2.f::HUGEINT * f2.f // (x.f::HUGEINT * y.f) AS score
  FROM f2 JOIN f1 AS x ON x.lang = f2.lang AND x.w1 = f2.w1 JOIN f1 AS y ON y.lang = f2.lang AND y.w1 = f2.w2
  WHERE NOT EXISTS (FROM f3 WHERE f3.lang = f2.lang AND f3.w1 = f2.w1 AND f3.w2 = f2.w2 AND 100 * f3.f >= 50 * f2.f)
    AND NOT EXISTS (FROM f3 WHERE f3.lang = f2.lang AND f3.w2 = f2.w1 AND f3.w3 = f2.w2 AND 100 * f3.f >= 50 * f2.f)),
c3 AS (
  SELECT f3.lang, f3.w1 || ' ' || f3.w2 || ' ' || f3.w3 AS phrase, f3.f AS a, x.f AS l1, q.f AS r1, p.f AS l2, z.f AS r2,
    1000000 * f3.f::HUGEINT * f3.f // (x.f::HUGEINT * q.f) AS s1, 1000000 * f3.f::HUGEINT * f3.f // (p.f::HUGEINT * z.f) AS s2
  FROM f3 JOIN f1 AS x ON x.lang = f3.lang AND x.w1 = f3.w1 JOIN f1 AS z ON z.lang = f3.lang AND z.w1 = f3.w3
  JOIN f2 AS p ON p.lang = f3.lang AND p.w1 = f3.w1 AND p.w2 = f3.w2 JOIN f2 AS q ON q.lang = f3.lang AND q.w1 = f3.w2 AND q.w2 = f3.w3),
c AS (
  SELECT lang, phrase, a, l, r, score FROM c2
  UNION ALL SELECT lang, phrase, a, if(s2 < s1, l2, l1), if(s2 < s1, r2, r1), least(s1, s2) FROM c3),
k AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM c)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM k JOIN n USING (lang) WHERE rank <= 2000
"""


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(documents(spark, sf_dir), tokenizer("byte_bpe_50k.json"), tokenizer("piece_bpe_32k.model"))


def op13_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data.personal_data(spread(documents(spark, sf_dir)))


QUERIES = {
    "op1_lm_scoring": op1_lm_scoring,
    "op2_repeat_removal": op2_repeat_removal,
    "op3_language_id": op3_language_id,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_bpe_round_trip": op5_bpe_round_trip,
    "op6_token_counts": op6_token_counts,
    "op7_warc": op7_warc,
    "op8_packing": op8_packing,
    "op9_matroska_media": op9_matroska_media,
    "op10_simhash_near_dedup": op10_simhash_near_dedup,
    "op11_collocations": op11_collocations,
    "op12_token_alignment": op12_token_alignment,
    "op13_personal_data": op13_personal_data,
}

ORACLES: dict[str, str] = {
    "op1_lm_scoring": OP1_ORACLE,
    "op2_repeat_removal": OP2_ORACLE,
    "op4_exact_dedup": OP4_ORACLE,
    "op7_warc": OP7_ORACLE,
    "op11_collocations": OP11_ORACLE,
}
