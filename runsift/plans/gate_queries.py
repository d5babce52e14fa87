"""SET and IDX: gates over the given tables."""

from pyspark.sql import functions as F

from runsift.functions import hashing as H
from runsift.operators import gates as G
from runsift.operators import joins as J
from runsift.plans import standins  # noqa: F401
from runsift.plans.registry import query
from runsift.session import scratch_path
from runsift.sources.store import KeyedStore

MASKS = ["none", "question", "cot", "question_and_cot"]


@query("idx01_idempotent_append", """
SELECT l_orderkey, min(l_linenumber) AS l_linenumber FROM lineitem
WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') GROUP BY 1""")
def _(t):
    store = KeyedStore(t.spark, scratch_path(t.spark, "keyed"), "l_orderkey bigint, l_linenumber int", ["l_orderkey"])
    stored = t.orders.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"), F.lit(0).alias("l_linenumber"))
    store.append(stored, [F.col("l_linenumber")])
    return store.append(t.lineitem.select("l_orderkey", "l_linenumber"), [F.col("l_linenumber")])


@query("set01_exact_ids", """
WITH e AS (SELECT DISTINCT o_orderkey AS k FROM orders WHERE o_orderkey % 5 <> 0), o AS (SELECT l_orderkey AS k, count(*) AS n FROM lineitem GROUP BY 1)
SELECT 'duplicate' AS rule, CAST(k AS STRING) AS id FROM o WHERE n > 1
UNION ALL SELECT 'missing', CAST(k AS STRING) FROM e WHERE k NOT IN (SELECT k FROM o)
UNION ALL SELECT 'extra', CAST(k AS STRING) FROM o WHERE k NOT IN (SELECT k FROM e)""")
def _(t):
    expected = t.orders.where("o_orderkey % 5 <> 0").select(F.col("o_orderkey").alias("k"))
    return G.exact_ids(expected, t.lineitem.select(F.col("l_orderkey").alias("k")), "k")


def sample_ids(plan, model, pair, temperatures, samples):
    """model::pair::temp_t::sample_ii for every planned sample."""
    grid = J.expand(plan, temperature=temperatures, sample_index=list(range(samples)))
    return grid.select(F.concat_ws(
        "::", F.lit(model), F.col(pair), F.concat(F.lit("temp_"), "temperature"),
        F.concat(F.lit("sample_"), F.lpad(F.col("sample_index").cast("string"), 2, "0"))).alias("expected_id"))


@query("set02_expected_ids", """
SELECT 'm1::' || c_custkey || '::temp_' || t || '::sample_' || lpad(CAST(i AS STRING), 2, '0') AS expected_id
FROM customer, (SELECT unnest(['0.2', '0.7']) AS t), (SELECT unnest(range(12)) AS i)""")
def _(t):
    return sample_ids(t.customer.select("c_custkey"), "m1", "c_custkey", ["0.2", "0.7"], 12)


@query("set03_conditional_grid", """
SELECT p_partkey || '::primary' AS id FROM part
UNION ALL SELECT p_partkey || '::' || x FROM part, (SELECT unnest(['plain', 'active']) AS x) WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 49)""")
def _(t):
    plan = t.part.select("p_partkey")
    subset = t.lineitem.where("l_quantity >= 49").select(F.col("l_partkey").alias("p_partkey"))
    extra = J.expand(plan.join(subset, "p_partkey", "left_semi"), template=["plain", "active"])
    both = plan.withColumn("template", F.lit("primary")).unionByName(extra)
    return both.select(F.concat_ws("::", "p_partkey", "template").alias("id"))


@query("set04_union_of_parts", """
SELECT o_orderkey AS id, 'order' AS part, o_totalprice AS price FROM orders UNION ALL SELECT p_partkey, 'part', NULL FROM part""")
def _(t):
    a = t.orders.select(F.col("o_orderkey").alias("id"), F.lit("order").alias("part"), F.col("o_totalprice").alias("price"))
    b = t.part.select(F.col("p_partkey").alias("id"), F.lit("part").alias("part"))
    return a.unionByName(b, allowMissingColumns=True)


@query("set05_in_every_row", """
SELECT mask, line_no FROM (SELECT DISTINCT mask, line_no FROM masks) WHERE line_no IN
 (SELECT line_no FROM masks GROUP BY 1 HAVING count(DISTINCT masked_branch || natural_branch) = (SELECT count(DISTINCT masked_branch || natural_branch) FROM masks))""")
def _(t):
    m = t.masks.withColumn("row", F.concat("masked_branch", "natural_branch"))
    return m.select("mask", "line_no").distinct().join(G.in_every_row(m, "line_no", "row"), "line_no", "left_semi")


@query("set06_has_all_members", """
SELECT parent_id FROM masks GROUP BY 1 HAVING bool_or(mask = 'none') AND bool_or(mask = 'question') AND bool_or(mask = 'cot')""")
def _(t):
    return G.has_all(t.masks, "parent_id", "mask", ["none", "question", "cot"])


@query("set07_unknown_keys", """
SELECT c AS k, side FROM (SELECT DISTINCT doc_id AS c, 'left_only' AS side FROM documents WHERE doc_id NOT IN (SELECT event_id FROM events WHERE value > 30)
UNION ALL SELECT DISTINCT event_id, 'right_only' FROM events WHERE value > 30 AND event_id NOT IN (SELECT doc_id FROM documents))""")
def _(t):
    return G.unknown_keys(t.documents.select(F.col("doc_id").alias("k")), t.events.where("value > 30").select(F.col("event_id").alias("k")), "k")


LABEL_NAMES = ["FOLLOW", "COT_STAGE_CORRECTION", "FINAL_STAGE_TRANSPARENT_CORRECTION", "SILENT_BYPASS_REANCHOR",
               "ANSWER_ONLY_FOLLOW"]
JUDGED_SQL = """
WITH j AS (SELECT event_id, CASE event_id % 7 WHEN 0 THEN 'FOLLOW' WHEN 1 THEN 'COT_STAGE_CORRECTION' WHEN 2 THEN 'FINAL_STAGE_TRANSPARENT_CORRECTION'
  WHEN 3 THEN 'SILENT_BYPASS_REANCHOR' WHEN 4 THEN 'ANSWER_ONLY_FOLLOW' WHEN 5 THEN 'UNSURE' ELSE NULL END AS manual_label,
  CASE event_type WHEN 'view' THEN 'none' WHEN 'click' THEN '' WHEN 'error' THEN NULL ELSE 'compare' END AS bridge,
  CASE user_id % 3 WHEN 0 THEN 'original_correct' WHEN 1 THEN 'counterfactual' ELSE NULL END AS boundary_state,
  CASE WHEN user_id % 2 = 0 THEN 'answer_only' ELSE 'normal' END AS answer_format FROM events)
"""


def judged(t):
    e, u = F.col("event_id") % 7, F.col("user_id")
    names = {0: LABEL_NAMES[0], 1: LABEL_NAMES[1], 2: LABEL_NAMES[2], 3: LABEL_NAMES[3], 4: LABEL_NAMES[4], 5: "UNSURE"}
    label = F.lit(None).cast("string")
    for k, v in names.items():
        label = F.when(e == k, v).otherwise(label)
    kind = F.col("event_type")
    return t.events.select(
        "event_id", label.alias("manual_label"),
        F.when(kind == "view", "none").when(kind == "click", "").when(kind != "error", "compare").alias("bridge"),
        F.when(u % 3 == 0, "original_correct").when(u % 3 == 1, "counterfactual").alias("boundary_state"),
        F.when(u % 2 == 0, "answer_only").otherwise("normal").alias("answer_format"))


@query("set08_label_rules", JUDGED_SQL + """
SELECT CAST(event_id AS STRING) AS id, rule FROM (
 SELECT event_id, 'invalid_label' AS rule FROM j WHERE manual_label IS NULL OR manual_label = 'UNSURE'
 UNION ALL SELECT event_id, 'transparent_without_bridge' FROM j WHERE manual_label = 'FINAL_STAGE_TRANSPARENT_CORRECTION' AND coalesce(bridge, '') IN ('', 'none')
 UNION ALL SELECT event_id, 'silent_with_bridge_marked' FROM j WHERE manual_label = 'SILENT_BYPASS_REANCHOR' AND bridge = 'compare'
 UNION ALL SELECT event_id, 'cot_correction_boundary_state_check' FROM j WHERE manual_label = 'COT_STAGE_CORRECTION' AND boundary_state IS DISTINCT FROM 'original_correct'
 UNION ALL SELECT event_id, 'answer_only_label_on_normal_row' FROM j WHERE manual_label = 'ANSWER_ONLY_FOLLOW' AND answer_format = 'normal')""")
def _(t):
    rules = G.label_rules("manual_label", "bridge", "boundary_state", "answer_format", LABEL_NAMES)
    return G.row_problems(judged(t), "event_id", rules)


@query("set09_required_fields", """
WITH d AS (SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN '' ELSE lang END AS lang, CASE WHEN doc_id % 4 = 0 THEN NULL ELSE source END AS source,
  CASE WHEN contains(text, '@') THEN list_filter(string_split(text, ' '), lambda w: contains(w, '@')) ELSE [] END AS mails FROM documents)
SELECT CAST(doc_id AS STRING) AS id, rule FROM (SELECT doc_id, 'missing_lang' AS rule FROM d WHERE lang = '' OR lang IS NULL
 UNION ALL SELECT doc_id, 'missing_source' FROM d WHERE source IS NULL OR source = '' UNION ALL SELECT doc_id, 'missing_mails' FROM d WHERE len(mails) = 0)""")
def _(t):
    d = t.documents.select(
        "doc_id", F.when(F.col("doc_id") % 9 == 0, "").otherwise(F.col("lang")).alias("lang"),
        F.when(F.col("doc_id") % 4 != 0, F.col("source")).alias("source"),
        F.filter(F.split("text", " "), lambda w: F.contains(w, F.lit("@"))).alias("mails"))
    return G.row_problems(d, "doc_id", G.required_fields(d, ["lang", "source", "mails"]))


@query("set10_pair_rules", """
WITH p AS (SELECT o_orderkey, o_orderstatus = 'P' AS edited, CAST(o_custkey % 3 AS STRING) AS q, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE CAST(o_orderkey % 3 AS STRING) END AS s,
  o_orderpriority AS prefix, o_orderstatus = 'F' AS closes FROM orders)
SELECT CAST(o_orderkey AS STRING) AS id, rule FROM (SELECT o_orderkey, 'equal_answers' AS rule FROM p WHERE NOT edited AND q = s
 UNION ALL SELECT o_orderkey, 'edited_row_has_counterfactual' FROM p WHERE edited AND s IS NOT NULL
 UNION ALL SELECT o_orderkey, 'prefix_without_open_marker' FROM p WHERE NOT starts_with(prefix, '1')
 UNION ALL SELECT o_orderkey, 'prefix_without_close_marker' FROM p WHERE closes AND NOT ends_with(prefix, 'T'))""")
def _(t):
    c = F.col
    p = t.orders.select(
        "o_orderkey", (c("o_orderstatus") == "P").alias("edited"), (c("o_custkey") % 3).cast("string").alias("q"),
        F.when(c("o_orderkey") % 7 != 0, (c("o_orderkey") % 3).cast("string")).alias("s"), c("o_orderpriority").alias("prefix"),
        (c("o_orderstatus") == "F").alias("closes"))
    return G.row_problems(p, "o_orderkey", G.pair_rules(c("q"), c("s"), c("edited"), c("prefix"), "1", "T", c("closes")))


SCORES_SQL = """
WITH s AS (SELECT vec_id, CASE WHEN vec_id % 5 = 0 THEN [] ELSE list_transform(embedding, lambda x: CASE WHEN vec_id % 7 = 0 AND x > 0.1 THEN 'nan'::DOUBLE ELSE CAST(x AS DOUBLE) END) END AS v,
   len(embedding) - CASE WHEN vec_id % 11 = 0 THEN 1 ELSE 0 END AS n, CASE WHEN vec_id % 13 = 0 THEN 'infinity'::DOUBLE ELSE 0.5 END AS total, CASE WHEN vec_id % 3 = 0 THEN [] ELSE [1] END AS ids FROM embeddings)
"""


@query("set11_score_rules", SCORES_SQL + """
SELECT CAST(vec_id AS STRING) AS id, rule FROM (SELECT vec_id, 'empty_q_score' AS rule FROM s WHERE len(v) = 0
 UNION ALL SELECT vec_id, 'non_finite_q_score' FROM s WHERE len(list_filter(v, lambda x: NOT isfinite(x))) > 0
 UNION ALL SELECT vec_id, 'q_score_token_count_mismatch' FROM s WHERE len(v) > 0 AND n <> len(v)
 UNION ALL SELECT vec_id, 'invalid_q_score_total_logprob' FROM s WHERE len(v) > 0 AND NOT isfinite(total)
 UNION ALL SELECT vec_id, 'missing_ids' FROM s WHERE len(ids) = 0)""")
def _(t):
    i = F.col("vec_id")
    v = F.transform("embedding", lambda x: F.when((i % 7 == 0) & (x > 0.1), F.lit(float("nan"))).otherwise(x.cast("double")))
    v = F.when(i % 5 == 0, F.slice(v, 1, 0)).otherwise(v)
    rows = t.embeddings.select(
        "vec_id", F.struct(
            v.alias("token_logprobs"), (F.size("embedding") - F.when(i % 11 == 0, 1).otherwise(0)).alias("token_count"),
            F.when(i % 13 == 0, F.lit(float("inf"))).otherwise(0.5).alias("total_logprob"),
            F.lit(0.1).alias("average_logprob"), F.lit(1.1).alias("perplexity")).alias("q_score"),
        F.when(i % 3 == 0, F.slice(F.array(F.lit(1)), 1, 0)).otherwise(F.array(F.lit(1))).alias("ids"))
    return G.row_problems(rows, "vec_id", G.score_rules("q_score", "ids"))


@query("set12_sample_rules", """
WITH s AS (SELECT row_id, CASE WHEN turn % 3 = 0 THEN 0 ELSE greatest(1, CAST(('0x' || substr(sha256('rev|' || row_id || '|20260717'), 1, 16))::UHUGEINT % 2147483647 AS BIGINT)) END AS seed,
   words AS answer, CASE WHEN conv_id % 4 = 0 THEN words[1:5] ELSE words[1:6] END AS endpoint, CAST(turn AS STRING) AS temperature FROM token_rows)
SELECT row_id AS id, rule FROM (SELECT row_id, 'incorrect_seed' AS rule FROM s WHERE seed <> greatest(1, CAST(('0x' || substr(sha256('rev|' || row_id || '|20260717'), 1, 16))::UHUGEINT % 2147483647 AS BIGINT))
 UNION ALL SELECT row_id, 'endpoint_mismatch' FROM s WHERE endpoint <> answer[1:6]
 UNION ALL SELECT row_id, 'unregistered_temperature' FROM s WHERE temperature NOT IN ('0', '1', '2'))""")
def _(t):
    c = F.col
    seed = H.stable_seed(F.lit("rev"), c("row_id"), F.lit(20260717))
    s = t.token_rows.select(
        "row_id", F.when(c("turn") % 3 == 0, F.lit(0).cast("bigint")).otherwise(seed).alias("seed"), "words",
        F.when(c("conv_id") % 4 == 0, F.slice("words", 1, 5)).otherwise(F.slice("words", 1, 6)).alias("endpoint"),
        c("turn").cast("string").alias("temperature"))
    rules = G.sample_rules(c("seed"), seed, c("words"), c("words"), c("endpoint"), 6, c("temperature"), ["0", "1", "2"])
    return G.row_problems(s, "row_id", rules)


@query("set13_vector_rules", """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 6 = 0 THEN embedding[1:63] ELSE embedding END AS vec, vec_id % 4 AS k, vec_id % 9 = 0 AS broken FROM embeddings)
SELECT CAST(vec_id AS STRING) AS id, rule FROM (SELECT vec_id, 'shape_mismatch' AS rule FROM v WHERE len(vec) <> 64
 UNION ALL SELECT vec_id, 'non_finite_values' FROM v WHERE broken UNION ALL SELECT vec_id, 'unregistered_position' FROM v WHERE k NOT IN (0, 1, 2))""")
def _(t):
    i = F.col("vec_id")
    vec = F.when(i % 6 == 0, F.slice("embedding", 1, 63)).otherwise(F.col("embedding"))
    vec = F.transform(vec, lambda x, p: F.when((i % 9 == 0) & (p == 5), F.lit(float("nan")).cast("float")).otherwise(x))
    rows = t.embeddings.select("vec_id", vec.alias("vec"), (i % 4).alias("k"))
    return G.row_problems(rows, "vec_id", G.vector_rules(F.col("vec"), 64, F.col("k"), [0, 1, 2]))


@query("set14_mask_family_rules", """
WITH f AS (SELECT parent_id, max(masked_position_count) FILTER (WHERE mask = 'none') AS n, max(masked_position_count) FILTER (WHERE mask = 'question') AS q,
   max(masked_position_count) FILTER (WHERE mask = 'cot') AS t, max(masked_position_count) FILTER (WHERE mask = 'question_and_cot') AS j FROM masks GROUP BY 1)
SELECT CAST(parent_id AS STRING) AS id, rule FROM (SELECT parent_id, 'unmasked_control_masks_positions' AS rule FROM f WHERE n <> 0
 UNION ALL SELECT parent_id, 'incomplete_mask_family' FROM f WHERE n IS NULL OR q IS NULL OR t IS NULL OR j IS NULL
 UNION ALL SELECT parent_id, 'empty_source_mask' FROM f WHERE q <= 0 OR t <= 0 OR j <= 0
 UNION ALL SELECT parent_id, 'joint_smaller_than_component' FROM f WHERE n IS NOT NULL AND j < greatest(q, t) AND q IS NOT NULL AND t IS NOT NULL)""")
def _(t):
    wide = J.variants_side_by_side(t.masks, "parent_id", "mask", "masked_position_count", MASKS)
    rules = G.mask_family_rules({"none": "none", "question": "question", "trace": "cot", "joint": "question_and_cot"})
    return G.row_problems(wide, "parent_id", rules)


def _problems(t):
    ids = G.exact_ids(t.orders.select(F.col("o_orderkey").alias("k")), t.lineitem.select(F.col("l_orderkey").alias("k")), "k")
    labels = G.row_problems(
        judged(t), "event_id", G.label_rules("manual_label", "bridge", "boundary_state", "answer_format", LABEL_NAMES))
    clean = G.row_problems(t.part, "p_partkey", {"no_name": F.col("p_name").isNull()})
    return G.roll_up([("lines", "hard", ids), ("labels", "warning", labels), ("parts", "hard", clean)])


@query("set15_gate_roll_up", JUDGED_SQL + """
, o AS (SELECT l_orderkey AS k, count(*) AS n FROM lineitem GROUP BY 1),
 w AS (SELECT sum((manual_label IS NULL OR manual_label = 'UNSURE')::INT + coalesce((manual_label = 'FINAL_STAGE_TRANSPARENT_CORRECTION' AND coalesce(bridge, '') IN ('', 'none'))::INT, 0)
   + coalesce((manual_label = 'SILENT_BYPASS_REANCHOR' AND bridge = 'compare')::INT, 0) + coalesce((manual_label = 'COT_STAGE_CORRECTION' AND boundary_state IS DISTINCT FROM 'original_correct')::INT, 0)
   + coalesce((manual_label = 'ANSWER_ONLY_FOLLOW' AND answer_format = 'normal')::INT, 0)) AS n FROM j)
SELECT 'lines' AS stage, (SELECT count(*) FROM o WHERE n > 1) + (SELECT count(*) FROM orders WHERE o_orderkey NOT IN (SELECT k FROM o)) AS hard_failures, 0 AS warnings, false AS passed
UNION ALL SELECT 'labels', 0, CAST((SELECT n FROM w) AS BIGINT), true UNION ALL SELECT 'parts', 0, 0, true""")
def _(t):
    return G.gate_summary(_problems(t), ["lines", "labels", "parts"])


@query("set17_frozen_cohort", """
WITH s AS (SELECT user_id, count(DISTINCT event_type) AS models FROM events WHERE value > 100 GROUP BY 1)
SELECT user_id, models FROM s WHERE models <> (SELECT count(DISTINCT event_type) FROM events WHERE value > 100)""")
def _(t):
    return G.cohort_problems(t.events.where("value > 100"), "event_type", "user_id")
