"""One query per operator over its whole table, and SQL twins where SQL can express it."""

from __future__ import annotations

import zlib
from collections.abc import Callable
from pathlib import Path

import numpy as np
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from runsift.llm import balltree, exact, mixing, neardup, negatives, ngramjoin, pieces, quality, runs, secrets, toxicity, warc
from runsift.llm.shared import documents

TOKENIZER = "piece_bpe_32k.model"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def tokenizer(name: str = TOKENIZER) -> bytes:
    return Path(public_tokenizers.path(name)).read_bytes()


@query("op1_quality_crf")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return quality.score(docs, quality.fit(docs, documents(spark, sf_dir, "labels")))


@query("op2_minhash_neardup", r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
  FROM documents),
s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(words) = 0 THEN []::VARCHAR[] WHEN len(words) < 2 THEN [words[1]]
    ELSE list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1]) END) AS items
  FROM w),
u AS (SELECT doc_id, len(items) AS n, unnest(items) AS item FROM s),
e AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM u AS a JOIN u AS b ON a.item = b.item AND a.doc_id <> b.doc_id
    AND a.n * 100 >= b.n * 80 AND b.n * 100 >= a.n * 80
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
r AS (SELECT doc_id AS node, doc_id AS seen FROM s UNION SELECT r.node, e.b FROM r JOIN e ON r.seen = e.a),
c AS (SELECT node, min(seen) AS component_id FROM r GROUP BY node)
SELECT s.doc_id, len(s.items) AS n_shingles, c.component_id, s.doc_id = c.component_id AS kept FROM s JOIN c ON c.node = s.doc_id""")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_groups(documents(spark, sf_dir), words=2)


@query("op3_balltree_topk", r"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM v AS q JOIN v AS c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score
FROM p QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 10""")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return balltree.top_k(documents(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


@query("op4_secret_crf")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return secrets.find(docs, secrets.fit(docs))


@query("op5_toxicity_trees")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return toxicity.score(docs, toxicity.fit(docs, documents(spark, sf_dir, "labels")))


@query("op6_token_counts")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.count_tokens(documents(spark, sf_dir), tokenizer())


@query("op7_source_mix", r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
    substr(md5(coalesce(doc_id::VARCHAR, 'null')), 1, 15) AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM d GROUP BY source),
w AS (SELECT *, [3, 1, 2][((place - 1) % 3 + 1)::INT]::BIGINT AS weight, 2 * source_size AS most FROM s),
l AS (SELECT *, most::DOUBLE / weight AS level FROM w),
m AS (
  SELECT *, (sum(most) OVER o - most)::DOUBLE AS most_before, (sum(weight) OVER o - weight)::DOUBLE AS weight_before,
    (sum(source_size) OVER ())::DOUBLE AS total, (sum(weight) OVER ())::DOUBLE AS weights
  FROM l WINDOW o AS (ORDER BY level, place ROWS UNBOUNDED PRECEDING)),
t AS (SELECT *, (total * 1.5::DOUBLE - most_before) / (weights - weight_before) AS try FROM m),
g AS (SELECT source, source_size, least(most::DOUBLE, (SELECT try FROM t WHERE try <= level ORDER BY level, place LIMIT 1) * weight) AS target FROM t),
p AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM g),
c AS (
  SELECT source, h, sum(size)::DOUBLE AS words, sum(sum(size)) OVER (PARTITION BY source ORDER BY h ROWS UNBOUNDED PRECEDING)::DOUBLE AS upto
  FROM d WHERE size > 0 GROUP BY source, h),
b AS (
  SELECT c.source, CASE WHEN upto - rest < rest - (upto - words) THEN h || '~' ELSE h END AS cut
  FROM (SELECT source, target - whole * source_size AS rest FROM p) AS q JOIN c ON c.source IS NOT DISTINCT FROM q.source
  WHERE rest > 0 AND upto >= rest AND upto - words < rest)
SELECT d.doc_id, d.size, p.source_size, p.target, d.size * (p.whole + CASE WHEN d.h < b.cut THEN 1 ELSE 0 END) AS taken
FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source LEFT JOIN b ON d.source IS NOT DISTINCT FROM b.source""")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.decide(documents(spark, sf_dir))


@query("op8_exact_dedup", """
WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, d.text_sha256 FROM d JOIN g USING (text_sha256)""")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.label_copies(documents(spark, sf_dir))


@query("op9_warc_fixity", r"""
WITH p AS (
  SELECT page_id, floor(page_id / 200)::BIGINT AS file, url, coalesce(html, '') AS html,
    CASE WHEN page_id % 97 = 13 THEN '#' || substr(coalesce(html, ''), 2) WHEN page_id % 211 = 7 THEN NULL ELSE coalesce(html, '') END AS copy FROM pages),
h AS (
  SELECT page_id, file, copy, 'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '')
    || chr(13) || chr(10) || 'Content-Length: ' AS head, chr(13) || chr(10) || chr(13) || chr(10) AS gap, html FROM p),
r AS (
  SELECT page_id, file, head || strlen(html)::VARCHAR || gap || html || gap AS a, head || strlen(copy)::VARCHAR || gap || copy || gap AS b FROM h),
o AS (SELECT file, (sum(strlen(a)) OVER (PARTITION BY file ORDER BY page_id, sha256(a) ROWS UNBOUNDED PRECEDING) - strlen(a))::BIGINT AS "offset", sha256(a) AS digest FROM r),
k AS (SELECT file, (sum(strlen(b)) OVER (PARTITION BY file ORDER BY page_id, sha256(b) ROWS UNBOUNDED PRECEDING) - strlen(b))::BIGINT AS "offset", sha256(b) AS digest FROM r WHERE b IS NOT NULL),
d AS (
  SELECT coalesce(o.file, k.file) AS file, coalesce(o."offset", k."offset") AS "offset", o.digest AS primary_digest, k.digest AS replica_digest
  FROM o FULL JOIN k ON o.file IS NOT DISTINCT FROM k.file AND o."offset" = k."offset" WHERE o.digest IS DISTINCT FROM k.digest),
m AS (SELECT file, replica_digest, min("offset") AS found_at FROM d WHERE replica_digest IS NOT NULL GROUP BY 1, 2)
SELECT d.*, found_at FROM d LEFT JOIN m ON d.file IS NOT DISTINCT FROM m.file AND d.primary_digest = m.replica_digest""")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The replica is derived from the pages: some bodies have a changed byte, some records are lost, and it has its own offsets."""
    html = F.coalesce("html", F.lit(""))
    copy = F.when(F.col("page_id") % 97 == 13, F.concat(F.lit("#"), F.expr("substr(coalesce(html, ''), 2)"))).when(
        F.col("page_id") % 211 == 7, F.lit(None)).otherwise(html)
    pages = documents(spark, sf_dir, "pages").select("page_id", "url", html.alias("html"), copy.alias("copy"))
    primary = warc.record_digests(pages, {"digest": F.col("html")})
    return warc.audit(primary, warc.record_digests(pages.where("copy is not null"), {"digest": F.col("copy")}))


@query("op10_piece_encoding")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digests(pieces.encode(documents(spark, sf_dir), tokenizer()))


@query("op11_hard_negatives", r"""
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, list_inner_product(a.v, c.v)::BIGINT AS score
  FROM v AS a JOIN v AS c ON a.vec_id <> c.vec_id WHERE a.vec_id % 100 = 0),
p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, p.positive_id, row_number() OVER w::INT AS rank, s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 80 * p.positive_score <= 100 * s.score AND s.score <= p.positive_score
WINDOW w AS (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) QUALIFY row_number() OVER w <= 5""")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(documents(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, moved)


def _bent(doc_id: int, n: int) -> np.ndarray | None:
    """Every tenth text, by the checksum of its id, repeats a piece of itself from some word on."""
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    words = np.arange(n)
    return np.where(words < a, words, a + (words - a) % (1 + (n - a) // (3 + g % 8)))


@query("op12_periodic_runs")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.find_runs(documents(spark, sf_dir), rearrange=_bent)
    longest = F.try_element_at(F.array_sort("runs", lambda x, y: F.when(
        x["length"] != y["length"], F.when(x["length"] > y["length"], -1).otherwise(1)).when(
        x["start"] != y["start"], F.when(x["start"] < y["start"], -1).otherwise(1)).otherwise(
        F.signum(x["period"] - y["period"]).cast("int"))), F.lit(1))
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    listed = F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), "")
    best = found.withColumn("best", longest)
    return best.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), *[F.col("best")[name].alias(name) for name in ("start", "length", "period")],
        F.floor(F.col("best")["length"] * 1000 / F.col("best")["period"]).cast("long").alias("exponent_milli"),
        F.sha2(listed.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))


@query("op13_ngram_jaccard", r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
  FROM documents),
s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(words) = 0 THEN []::VARCHAR[] WHEN len(words) < 3 THEN [array_to_string(words, ' ')]
    ELSE list_transform(range(1, len(words) - 1), lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2]) END) AS items
  FROM w),
u AS (SELECT doc_id, len(items) AS n, unnest(items) AS item FROM s),
e AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM u AS a JOIN u AS b ON a.item = b.item AND a.doc_id <> b.doc_id
    AND a.n * 100 >= b.n * 90 AND b.n * 100 >= a.n * 90
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
r AS (SELECT doc_id AS node, doc_id AS seen FROM s UNION SELECT r.node, e.b FROM r JOIN e ON r.seen = e.a),
c AS (SELECT node, min(seen) AS component_id FROM r GROUP BY node)
SELECT s.doc_id, len(s.items) AS n_shingles, c.component_id FROM s JOIN c ON c.node = s.doc_id""")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngramjoin.join_components(documents(spark, sf_dir))


QUERIES["pipeline"] = corpus_pipeline.run
if corpus_pipeline.ORACLE_SQL is not None:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
