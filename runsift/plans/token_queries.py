"""HSH, ARR, MTH-6..11, JSN and DAT over the given tables."""

from pyspark.sql import functions as F

from runsift.functions import hashing as H
from runsift.functions import numeric as N
from runsift.functions import tokens as K
from runsift.plans import standins  # noqa: F401
from runsift.plans.registry import query
from runsift.plans.summary_queries import r6

LENGTHS_SQL = "WITH t AS (SELECT row_id, conv_id, turn, words, list_transform(words, lambda w: length(w)) AS ids FROM token_rows)\n"


def _tokens(t):
    return t.token_rows.withColumn("ids", F.transform("words", lambda w: F.length(w)))


def _lits(*values):
    return F.array(*map(F.lit, values))


def text_of(array):
    return F.array_join(F.transform(array, lambda x: x.cast("string")), ",")


@query("hsh01_sha256_text", "SELECT doc_id, sha256(text) AS sha256 FROM documents")
def _(t):
    return t.documents.select("doc_id", H.sha256_text(F.col("text")).alias("sha256"))


@query("hsh02_sha256_int_list", LENGTHS_SQL + """
SELECT row_id, sha256(array_to_string(ids, ',')) AS decimal_hash,
  sha256(unhex(array_to_string(list_transform(ids, lambda x: printf('%02x%02x0000', x & 255, x >> 8)), ''))) AS binary_hash FROM t""")
def _(t):
    ids = F.col("ids")
    return _tokens(t).select("row_id", H.sha256_decimal_list(ids).alias("decimal_hash"), H.sha256_int32_list(ids).alias("binary_hash"))


@query("hsh03_stable_seed", """
SELECT o_orderkey, greatest(1, CAST(('0x' || substr(sha256('rev1|' || o_orderkey || '|7'), 1, 16))::UHUGEINT % 2147483647 AS BIGINT)) AS seed FROM orders""")
def _(t):
    return t.orders.select("o_orderkey", H.stable_seed(F.lit("rev1"), F.col("o_orderkey"), F.lit(7)).alias("seed"))


@query("arr01_find_subsequence", LENGTHS_SQL + """
SELECT row_id, coalesce(list_filter(range(2, len(ids) - 1), lambda i: ids[i + 1 : i + 2] = [5, 2])[1], -1) AS start_at FROM t""")
def _(t):
    at = K.find_subsequence(F.col("ids"), _lits(5, 2), 2)
    return _tokens(t).select("row_id", F.coalesce(at, F.lit(-1)).alias("start_at"))


@query("arr02_first_stop", LENGTHS_SQL + """
SELECT row_id, coalesce(list_filter(range(len(ids)), lambda i: i >= 3 AND ids[i + 1] IN (9, 11))[1], -1) AS stop_at FROM t""")
def _(t):
    return _tokens(t).select("row_id", F.coalesce(K.first_stop(F.col("ids"), _lits(9, 11), 3), F.lit(-1)).alias("stop_at"))


@query("arr03_trim_at_stop", LENGTHS_SQL + """
, p AS (SELECT row_id, ids, coalesce(list_filter(range(len(ids)), lambda i: ids[i + 1] IN (9, 11))[1], len(ids)) AS s FROM t)
SELECT row_id, array_to_string(ids[1:s], ',') AS without_stop, array_to_string(ids[1:least(s + 1, len(ids))], ',') AS with_stop FROM p""")
def _(t):
    ids, stops = F.col("ids"), _lits(9, 11)
    return _tokens(t).select(
        "row_id", text_of(K.trim_at_stop(ids, stops)).alias("without_stop"), text_of(K.trim_at_stop(ids, stops, True)).alias("with_stop"))


@query("arr04_channel_split", LENGTHS_SQL + """
, a AS (SELECT row_id, ids, list_filter(range(len(ids)), lambda i: ids[i + 1] = 4)[1] AS o FROM t),
b AS (SELECT *, o + 1 AS c, CASE WHEN o IS NOT NULL THEN list_filter(range(len(ids) - 1), lambda i: i >= o + 1 AND ids[i + 1 : i + 2] = [6, 2])[1] END AS b FROM a),
s AS (SELECT *, b + 2 AS e, coalesce(list_filter(range(len(ids)), lambda i: i >= coalesce(b + 2, 0) AND ids[i + 1] = 10)[1], len(ids)) AS stop FROM b)
SELECT row_id, CASE WHEN o IS NULL THEN 'missing_reasoning_open' WHEN b IS NULL THEN 'missing_answer_boundary' ELSE 'ok' END AS parse_status,
  array_to_string(CASE WHEN o IS NULL THEN [] WHEN b IS NULL THEN ids[c + 1 : stop] ELSE ids[c + 1 : b] END, ',') AS thought,
  array_to_string(CASE WHEN o IS NULL THEN ids[1 : stop] WHEN b IS NULL THEN [] ELSE ids[e + 1 : stop] END, ',') AS answer,
  greatest(len(ids) - 3, 0) >= 60 AS truncated FROM s""")
def _(t):
    ids = F.col("ids")
    rest = F.slice(ids, F.lit(4), F.greatest(F.size(ids) - 3, F.lit(0)))
    rows = K.split_channels(
        _tokens(t), F.slice(ids, 1, 3), rest, _lits(4), _lits(6, 2), _lits(10), F.lit(60), F.lit(None).cast("string"))
    return rows.select("row_id", "parse_status", text_of(F.col("thought_ids")).alias("thought"), text_of(F.col("answer_ids")).alias("answer"), "truncated")


@query("arr05_continuation_summary", LENGTHS_SQL + """
, p AS (SELECT row_id, ids, list_filter(range(len(ids)), lambda i: ids[i + 1] IN (10, 12))[1] AS s FROM t)
SELECT row_id, len(ids[1:coalesce(s, len(ids))]) AS answer_tokens, array_to_string(ids[1:least(coalesce(s, len(ids)), 12)], ',') AS endpoint,
  CASE WHEN s IS NOT NULL THEN 'registered_terminal' WHEN len(ids) >= 40 THEN 'max_new_tokens' ELSE 'backend_stop_without_registered_terminal' END AS stop_reason FROM p""")
def _(t):
    rows = _tokens(t).select("row_id", K.summarise_continuation(F.col("ids"), _lits(10, 12), 40, 12).alias("r"))
    return rows.select("row_id", F.size("r.answer_ids").alias("answer_tokens"), text_of(F.col("r.endpoint_ids")).alias("endpoint"), "r.stop_reason")


@query("arr06_boundary_prefix", LENGTHS_SQL + """
, p AS (SELECT row_id, ids, list_filter(range(len(ids) - 1), lambda i: ids[i + 1 : i + 2] = [3, 2])[1] AS b FROM t)
SELECT row_id, '1,1,' || array_to_string(ids[3 : b + 2], ',') AS prefix FROM p WHERE b + 2 > 2""")
def _(t):
    ids = F.col("ids")
    prefix = K.boundary_prefix(_lits(1, 1), F.slice(ids, 1, 2), F.slice(ids, F.lit(3), F.greatest(F.size(ids) - 2, F.lit(0))), _lits(3, 2))
    rows = _tokens(t).select("row_id", prefix.alias("p")).where("p is not null and size(p) > 2")
    return rows.select("row_id", text_of(F.col("p")).alias("prefix"))


@query("arr07_source_mask", LENGTHS_SQL + """
, m AS (SELECT row_id, c AS mask_condition, list_transform(ids, lambda v, i: CASE WHEN v IN (2, 3) THEN 1 WHEN c IN ('question', 'joint') AND i > 2 AND i <= 6 THEN 0
   WHEN c IN ('trace', 'joint') AND i > 6 AND i <= len(ids) - 2 THEN 0 ELSE 1 END) AS mask FROM t, (SELECT unnest(['none', 'question', 'trace', 'joint']) AS c))
SELECT row_id, mask_condition, len(list_filter(mask, lambda x: x = 0)) AS masked_positions, sha256(array_to_string(mask, ',')) AS mask_hash FROM m""")
def _(t):
    rows = _tokens(t).withColumn("mask_condition", F.explode(_lits("none", "question", "trace", "joint")))
    ids = F.col("ids")
    mask = K.source_mask(ids, (F.lit(2), F.lit(6)), (F.lit(6), F.size(ids) - 2), _lits(2, 3), F.col("mask_condition"))
    rows = rows.select("row_id", "mask_condition", mask.alias("mask"))
    return rows.select("row_id", "mask_condition", K.masked_count(F.col("mask")).alias("masked_positions"), H.sha256_decimal_list(F.col("mask")).alias("mask_hash"))


@query("arr08_token_safe_cut", """
WITH p AS (SELECT row_id, list_transform(words, lambda w: w || ' ') AS pieces, len(words) AS n FROM token_rows WHERE len(words) >= 12),
g AS (SELECT *, greatest(4, least(n - 2, CAST(round_even(n * 0.5, 0) AS INT))) AS target, greatest(8, CAST(round_even(n * 0.12, 0) AS INT)) AS radius FROM p),
c AS (SELECT row_id, n, target, pieces, unnest(range(greatest(4, target - radius), least(n - 1, target + radius) + 1)) AS cut FROM g),
q AS (SELECT *, CASE WHEN regexp_matches(array_to_string(pieces[1:cut], ''), '(?:[.!?]["'')\\]]*|\\n)\\s*$') THEN 0 ELSE 1 END AS quality FROM c),
r AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY quality, abs(cut - target), cut) AS rn FROM q)
SELECT row_id, quality, CAST(cut AS INT) AS cut, CAST(abs(cut - target) AS INT) AS distance FROM r WHERE rn = 1""")
def _(t):
    pieces = F.transform("words", lambda w: F.concat(w, F.lit(" ")))
    rows = K.token_safe_cut(t.token_rows, pieces, 0.5, "r").where("r is not null")
    return rows.select("row_id", "r.quality", "r.cut", "r.distance")


@query("arr09_token_table", """
SELECT row_id, i AS pos, words[i + 1] AS token, CASE WHEN i < 5 THEN 'prefilled' ELSE 'generated' END AS region
FROM (SELECT row_id, words, unnest(range(len(words))) AS i FROM token_rows)""")
def _(t):
    rows = t.token_rows.select("row_id", F.posexplode("words").alias("pos", "token"))
    return rows.withColumn("region", F.when(F.col("pos") < 5, "prefilled").otherwise("generated"))


PREFIX_SQL = """
WITH p AS (SELECT row_id, k, array_to_string(words[1:k], '') AS prefix FROM token_rows, (SELECT unnest([0, 1, 2, 4, 8, 16, 32]) AS k) WHERE k <= len(words))
"""


def _prefixes(t):
    return t.token_rows.select("row_id", K.prefixes_at(F.col("words"), [0, 1, 2, 4, 8, 16, 32]).alias("prefix_by_k"))


@query("arr10_answer_prefixes", PREFIX_SQL + "SELECT * FROM p")
def _(t):
    return _prefixes(t).select("row_id", F.explode("prefix_by_k").alias("k", "prefix"))


@query("jsn02_map_by_key", PREFIX_SQL + "SELECT row_id, max(prefix) FILTER (WHERE k = 8) AS prefix_8, max(prefix) FILTER (WHERE k = 2) AS prefix_2 FROM p GROUP BY 1")
def _(t):
    at = lambda k: F.try_element_at("prefix_by_k", F.lit(k)).alias(f"prefix_{k}")
    return _prefixes(t).select("row_id", at(8), at(2))


VISIBLE_SQL = """
WITH p AS (SELECT row_id, turn, list_transform(words, lambda w: w || ' ') AS pieces FROM token_rows),
k AS (SELECT row_id, pieces, unnest(range(1, len(pieces) + 1)) AS k FROM p),
s AS (SELECT row_id, k, contains(array_to_string(pieces[1:k], ''), 'ing') AS a, contains(array_to_string(pieces[1:k], ''), 'ion') AS b FROM k),
v AS (SELECT row_id, min(k) AS token FROM s WHERE a OR b GROUP BY 1),
f AS (SELECT row_id, turn, len(pieces) AS n, token FROM p LEFT JOIN v USING (row_id))
"""


def _visible(t):
    pieces = F.transform("words", lambda w: F.concat(w, F.lit(" ")))
    return K.first_visible_token(t.token_rows, pieces, {"Q": F.lit("ing"), "QSTAR": F.lit("ion")}, "v")


@query("arr11_first_visible_token", VISIBLE_SQL + """
SELECT f.row_id, token, CASE WHEN a AND b THEN CASE WHEN position('ing' IN t) < position('ion' IN t) THEN 'Q' ELSE 'QSTAR' END WHEN a THEN 'Q' ELSE 'QSTAR' END AS state
FROM f JOIN s ON f.row_id = s.row_id AND s.k = f.token JOIN (SELECT row_id, array_to_string(pieces, '') AS t FROM p) x ON x.row_id = f.row_id""")
def _(t):
    return _visible(t).where("v is not null").select("row_id", "v.token", "v.state")


@query("arr12_exposure_curve", VISIBLE_SQL + """
SELECT k, round(avg(coalesce(token <= k, false)::INT), 6) AS exposed, count(*) AS cases FROM f, (SELECT unnest([0, 1, 2, 4, 8, 16, 32]) AS k) GROUP BY 1""")
def _(t):
    rows = _visible(t).withColumn("k", F.explode(_lits(0, 1, 2, 4, 8, 16, 32)))
    hit = F.coalesce(F.col("v.token") <= F.col("k"), F.lit(False)).cast("double")
    return r6(rows.groupBy("k").agg(F.avg(hit).alias("exposed"), F.count("*").alias("cases")), "exposed")


@query("jsn01_json_values", """
SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, '{"k":' || (props->>'k') || ',"kind":"' || event_type || '"}' AS encoded FROM events""")
def _(t):
    k = F.get_json_object("props", "$.k").cast("bigint")
    return t.events.select("event_id", k.alias("k"), F.to_json(F.struct(k.alias("k"), F.col("event_type").alias("kind"))).alias("encoded"))


@query("mth06_logprob_summary", """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings)
SELECT vec_id, len(v) AS token_count, round(list_sum(v), 6) AS total_logprob, round(list_sum(v) / len(v), 6) AS average_logprob, round(exp(-list_sum(v) / len(v)), 6) AS perplexity FROM e""")
def _(t):
    v = F.transform("embedding", lambda x: x.cast("double"))
    rows = t.embeddings.select("vec_id", N.logprob_summary(v).alias("s")).select("vec_id", "s.*")
    return r6(rows, "total_logprob", "average_logprob", "perplexity")


@query("mth07_candidate_preference", """
SELECT o_orderkey, round(o_totalprice - c_acctbal * 40, 4) AS delta, CASE WHEN o_totalprice - c_acctbal * 40 > 0 THEN 'QSTAR' ELSE 'Q' END AS preferred
FROM orders JOIN customer ON o_custkey = c_custkey""")
def _(t):
    rows = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    q, s = F.col("c_acctbal") * 40, F.col("o_totalprice")
    return rows.select("o_orderkey", F.round(s - q, 4).alias("delta"), N.preference(q, s).alias("preferred"))


@query("mth08_branch_entropy", """
WITH c AS (SELECT pair_id, temperature, count(*) FILTER (WHERE final_branch = 'Q') AS q, count(*) FILTER (WHERE final_branch = 'QSTAR') AS s FROM runs GROUP BY 1, 2)
SELECT pair_id, temperature, q, s, round(CASE WHEN q > 0 AND s > 0 THEN -(s / (q + s) * log2(s / (q + s)) + q / (q + s) * log2(q / (q + s))) ELSE 0 END, 6) AS entropy FROM c""")
def _(t):
    rows = t.runs.groupBy("pair_id", "temperature").agg(
        F.count_if(F.col("final_branch") == "Q").alias("q"), F.count_if(F.col("final_branch") == "QSTAR").alias("s"))
    return r6(rows.withColumn("entropy", N.branch_entropy(F.col("q"), F.col("s"))), "entropy")


@query("mth09_recovered_gap", """
WITH b AS (SELECT p_partkey, p_retailprice - p_size AS gap, p_retailprice AS base FROM part)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(CASE WHEN abs(gap) > 1e-9 THEN (l_extendedprice - base) / gap END, 6) AS recovered FROM lineitem JOIN b ON l_partkey = p_partkey""")
def _(t):
    base = t.part.select(F.col("p_partkey").alias("l_partkey"), (F.col("p_retailprice") - F.col("p_size")).alias("gap"), F.col("p_retailprice").alias("base"))
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").join(base, "l_partkey")
    out = N.recovered_gap(F.col("l_extendedprice") - F.col("base"), F.col("gap"))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(out, 6).alias("recovered"))


@query("mth10_log1p_scaling", "SELECT doc_id, round(ln(1 + n_chars), 6) AS log_chars FROM documents")
def _(t):
    return t.documents.select("doc_id", F.round(F.log1p("n_chars"), 6).alias("log_chars"))


@query("mth11_difficulty_bucket", """
SELECT p_partkey, CASE WHEN p_partkey % 6 IN (0, 1) THEN 'easy' WHEN p_partkey % 6 = 5 THEN 'hard' ELSE 'medium' END AS difficulty FROM part""")
def _(t):
    return t.part.select("p_partkey", N.difficulty(F.col("p_partkey")).alias("difficulty"))


@query("dat01_utc_timestamp")
def _(t):
    return t.events.groupBy("event_type").agg(F.count("*").alias("events")).withColumn("created_at_utc", H.utc_timestamp())


@query("dat02_rate_and_eta", """
WITH s AS (SELECT event_type, count(*) AS done, CAST(epoch_us(max(ts)) - epoch_us(min(ts)) AS DOUBLE) / 1e6 AS seconds FROM events GROUP BY 1)
SELECT event_type, done, round(done / seconds, 6) AS rows_per_second, round((3000 - done) / (done / seconds), 3) AS eta_seconds FROM s""")
def _(t):
    micros = F.unix_micros(F.max(F.col("ts").cast("timestamp"))) - F.unix_micros(F.min(F.col("ts").cast("timestamp")))
    rows = t.events.groupBy("event_type").agg(F.count("*").alias("done"), (micros / 1e6).alias("seconds"))
    r = N.rate_and_eta(F.col("done"), F.lit(3000), F.col("seconds"))
    rows = rows.select("event_type", "done", r.alias("r"))
    return rows.select("event_type", "done", F.round("r.rows_per_second", 6).alias("rows_per_second"), F.round("r.eta_seconds", 3).alias("eta_seconds"))
