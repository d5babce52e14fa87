"""PRJ, FLT, JON, WIN and SRT over the given tables."""

from pyspark.sql import functions as F

from runsift.functions import projections as P
from runsift.operators import joins as J
from runsift.operators import pivots as V
from runsift.operators import sorts as O
from runsift.operators import summary as S
from runsift.plans import standins  # noqa: F401
from runsift.plans.registry import query
from runsift.plans.summary_queries import BRANCHES, r6

STEPS = ["view", "click", "purchase"]


@query("prj01_nested_to_flat", """SELECT event_id, CAST(props->>'k' AS BIGINT) AS k FROM events""")
def _(t):
    rows = t.events.select("event_id", F.from_json("props", "k bigint").alias("evidence"))
    return P.flatten(rows, "evidence", ["k"])


@query("prj02_metadata_projection", "SELECT p_partkey, p_name, p_brand, p_type, p_size FROM part")
def _(t):
    return t.part.select("p_partkey", "p_name", "p_brand", "p_type", "p_size")


@query("prj03_later_wins_merge", """
SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'F' THEN 'final' ELSE o_orderstatus END AS status, c_name AS name, o_orderpriority AS category
FROM orders JOIN customer ON o_custkey = c_custkey""")
def _(t):
    rows = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    meta = {"id": F.col("o_orderkey"), "status": F.col("c_mktsegment"), "category": F.col("o_orderpriority")}
    run = {"status": F.when(F.col("o_orderstatus") == "F", "final").otherwise(F.col("o_orderstatus")), "name": F.col("c_name")}
    return P.merge_later_wins(rows, [meta, run])


@query("prj04_eligibility_flag", """
SELECT run_id, coalesce(eligible AND edit_type <> 'edit_1', false) AND trace_branch = 'QSTAR' AND parse_status = 'ok' AS eligible FROM runs""")
def _(t):
    c = F.col
    flag = P.all_true(c("eligible"), c("edit_type") != "edit_1", c("trace_branch") == "QSTAR", c("parse_status") == "ok")
    return t.runs.select("run_id", flag.alias("eligible"))


@query("prj05_label_encoding", """
SELECT run_id, CASE final_branch WHEN 'QSTAR' THEN 1 ELSE 0 END AS label FROM runs WHERE final_branch IN ('Q', 'QSTAR')""")
def _(t):
    rows = t.runs.where(F.col("final_branch").isin("Q", "QSTAR"))
    return rows.select("run_id", P.encode_label(F.col("final_branch"), {"Q": 0, "QSTAR": 1}).alias("label"))


@query("prj06_recode_map", """
SELECT doc_id, CASE lang WHEN 'en' THEN 'english' WHEN 'de' THEN 'german' END AS language FROM documents""")
def _(t):
    return t.documents.select("doc_id", P.recode(F.col("lang"), {"en": "english", "de": "german"}).alias("language"))


@query("prj07_key_parsing", """
SELECT o_orderkey, o_orderpriority AS item, o_orderstatus || '::' || o_custkey AS variant,
  CASE WHEN starts_with(o_orderpriority, '1-') THEN substr(o_orderpriority, 3) ELSE o_orderpriority END AS bare FROM orders""")
def _(t):
    key = F.concat_ws("::", "o_orderpriority", "o_orderstatus", "o_custkey")
    return t.orders.select(
        "o_orderkey", P.key_head(key).alias("item"), P.key_tail(key).alias("variant"),
        P.strip_prefix(F.col("o_orderpriority"), "1-").alias("bare"))


@query("prj08_default_recovery", """
SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'stored' WHEN event_type LIKE 'p%' THEN 'pay' WHEN event_type LIKE 's%' THEN 'sign' ELSE 'other' END AS variant FROM events""")
def _(t):
    stored = F.when(F.col("event_id") % 2 == 0, "stored")
    found = P.recover(stored, F.col("event_type"), {"pay": "p", "sign": "s", "other": ""})
    return t.events.select("event_id", found.alias("variant"))


@query("flt01_cohort_filter", """
SELECT run_id, pair_id FROM runs WHERE condition = 'view' AND category IN ('linear', 'word') AND eligible
  AND final_branch IN ('Q', 'QSTAR') AND parse_status = 'ok'""")
def _(t):
    c = F.col
    return t.runs.where(
        (c("condition") == "view") & c("category").isin("linear", "word") & c("eligible")
        & c("final_branch").isin("Q", "QSTAR") & (c("parse_status") == "ok")).select("run_id", "pair_id")


@query("flt02_prefix_suffix_filter", """
SELECT p_partkey, p_type FROM part WHERE ends_with(p_type, 'L') AND starts_with(p_brand, 'Brand#1')""")
def _(t):
    return t.part.where(F.col("p_type").endswith("L") & F.col("p_brand").startswith("Brand#1")).select("p_partkey", "p_type")


@query("flt03_run_selection", """
SELECT o_orderkey, o_orderpriority, position FROM (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS position FROM orders
  WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')) WHERE position >= 100 AND position < 1500""")
def _(t):
    from runsift.operators.scale import global_row_number

    rows = t.orders.where(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")).select("o_orderkey", "o_orderpriority")
    rows = global_row_number(rows, [], ["o_orderkey"], "position").withColumn("position", F.col("position") - 1)
    return rows.where(P.row_range(F.col("position"), 100, 1500))


@query("flt04_two_denominators", """
SELECT category, count(*) AS total, count(*) FILTER (WHERE edit_type IS NOT NULL) AS clean,
  round(100.0 * count(*) FILTER (WHERE edit_type IS NOT NULL AND final_branch = 'Q') / nullif(count(*) FILTER (WHERE edit_type IS NOT NULL), 0), 6) AS clean_pct,
  round(100.0 * count(*) FILTER (WHERE final_branch = 'Q') / count(*), 6) AS total_pct FROM runs GROUP BY 1""")
def _(t):
    clean, hit = F.col("edit_type").isNotNull(), F.col("final_branch") == "Q"
    out = t.runs.groupBy("category").agg(
        F.count("*").alias("total"), F.count_if(clean).alias("clean"),
        S.percent(F.count_if(clean & hit), F.count_if(clean)).alias("clean_pct"),
        S.percent(F.count_if(hit), F.count("*")).alias("total_pct"))
    return r6(out, "clean_pct", "total_pct")


@query("flt05_finite_scores", """
SELECT event_id, round(v, 6) AS score FROM (SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'nan'::DOUBLE WHEN event_id % 7 = 0 THEN 'infinity'::DOUBLE
  WHEN event_id % 11 = 0 THEN NULL ELSE value END AS v FROM events) WHERE isfinite(v)""")
def _(t):
    v = (F.when(F.col("event_id") % 5 == 0, F.lit(float("nan"))).when(F.col("event_id") % 7 == 0, F.lit(float("inf")))
         .when(F.col("event_id") % 11 == 0, F.lit(None)).otherwise(F.col("value")))
    rows = t.events.select("event_id", v.alias("score"))
    return r6(rows.where(P.is_finite(F.col("score"))), "score")


@query("jon01_lookup", """
SELECT o_orderkey, c_name, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey""")
def _(t):
    pairs = t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_name", "c_mktsegment")
    return J.lookup(t.orders.select("o_orderkey", "o_custkey"), pairs, "o_custkey").drop("o_custkey")


@query("jon02_role_split", """
SELECT conv_id, arg_min(text, turn) FILTER (WHERE role = 'user') AS text_user, arg_min(text, turn) FILTER (WHERE role = 'assistant') AS text_assistant,
  coalesce(bool_or(role = 'user'), false) AND coalesce(bool_or(role = 'assistant'), false) AS complete FROM conversations GROUP BY 1""")
def _(t):
    return J.split_roles(t.conversations, "conv_id", "role", ["user", "assistant"], ["text"], F.col("turn"))


@query("jon03_one_to_one_join", """
WITH r AS (SELECT edit_type, category, condition, min(run_id) AS first_run, max(margin) AS top_margin FROM runs WHERE temperature = '0.7' GROUP BY 1, 2, 3),
l AS (SELECT DISTINCT edit_type, category, condition FROM runs)
SELECT l.edit_type, l.category, l.condition, first_run, top_margin FROM l LEFT JOIN r
  ON l.edit_type IS NOT DISTINCT FROM r.edit_type AND l.category = r.category AND l.condition = r.condition""")
def _(t):
    keys = ["edit_type", "category", "condition"]
    left = t.runs.select(*keys).distinct()
    right = t.runs.where("temperature = '0.7'").groupBy(*keys).agg(F.min("run_id").alias("first_run"), F.max("margin").alias("top_margin"))
    return J.one_to_one_left_join(left, right, keys)[0]


@query("jon03_one_to_one_problems", """
WITH l AS (SELECT l_orderkey AS k FROM lineitem), o AS (SELECT o_orderkey AS k FROM orders WHERE o_orderstatus <> 'P')
SELECT k, count(*) AS "rows", 'duplicate_left' AS problem FROM l GROUP BY 1 HAVING count(*) > 1
UNION ALL SELECT k, count(*), 'duplicate_right' FROM o GROUP BY 1 HAVING count(*) > 1
UNION ALL SELECT k, count(*), 'unmatched' FROM l WHERE k NOT IN (SELECT k FROM o) GROUP BY 1""")
def _(t):
    left = t.lineitem.select(F.col("l_orderkey").alias("k"))
    right = t.orders.where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("k"))
    return J.one_to_one_left_join(left, right, ["k"])[1]


AUDIT_SQL = """
WITH a AS (SELECT doc_id, lang, quality FROM documents LEFT JOIN labels USING (doc_id)),
x AS (SELECT doc_id, 'marked toxic' AS exclude_note FROM labels WHERE toxic = 1),
o AS (SELECT doc_id, CASE quality WHEN 1 THEN 'GOOD' ELSE 'POOR' END AS override_label, 'manual' AS override_note FROM labels),
j AS (SELECT doc_id, d.lang, CASE WHEN x.doc_id IS NOT NULL THEN 'DATASET_ISSUE' ELSE coalesce(override_label, upper(d.lang)) END AS audited_label,
  CASE WHEN x.doc_id IS NOT NULL THEN 'excluded' WHEN override_label IS NOT NULL THEN 'overridden' ELSE 'auto_accepted' END AS audit_status,
  CASE WHEN x.doc_id IS NOT NULL THEN exclude_note WHEN override_label IS NOT NULL THEN override_note ELSE '' END AS audit_note
  FROM documents d LEFT JOIN x USING (doc_id) LEFT JOIN o USING (doc_id))
"""


def audited(t):
    auto = t.documents.select("doc_id", "lang", F.upper("lang").alias("auto_label"))
    excluded = t.labels.where("toxic = 1").select("doc_id", F.lit("marked toxic").alias("exclude_note"))
    overrides = t.labels.select(
        "doc_id", F.when(F.col("quality") == 1, "GOOD").otherwise("POOR").alias("override_label"),
        F.lit("manual").alias("override_note"))
    return J.apply_overrides(auto, excluded, overrides, "doc_id", "auto_label").drop("auto_label")


@query("jon04_override_join", AUDIT_SQL + "SELECT * FROM j")
def _(t):
    return audited(t)


@query("jon05_enrichment_defaults", """
SELECT doc_id, lang, coalesce(quality, -1) AS quality, coalesce(toxic, 0) AS toxic FROM documents LEFT JOIN labels USING (doc_id)""")
def _(t):
    return J.enrich(t.documents.select("doc_id", "lang"), t.labels, "doc_id", {"quality": -1, "toxic": 0})


@query("jon06_grid", """
SELECT c_custkey, t AS temperature, i AS sample_index FROM customer, (SELECT unnest(['0.2', '0.7', '1.0']) AS t), (SELECT unnest(range(4)) AS i)""")
def _(t):
    return J.expand(t.customer.select("c_custkey"), temperature=["0.2", "0.7", "1.0"], sample_index=list(range(4)))


@query("jon07_parents_across_models", """
SELECT l_orderkey AS parent_id, l_linenumber, o_orderpriority AS category FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
def _(t):
    parents = [t.orders.where(F.col("o_orderstatus") == s).select(F.col("o_orderkey").alias("parent_id"), F.col("o_orderpriority").alias("category"))
               for s in ("F", "O", "P")]
    return J.parents_of(t.lineitem.select(F.col("l_orderkey").alias("parent_id"), "l_linenumber"), parents, "parent_id")


@query("jon08_pending_rows", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def _(t):
    return J.pending(t.orders.select("o_orderkey"), t.lineitem.select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey")


@query("jon09_selected_rows", "SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def _(t):
    return J.select_ids(t.documents.select("doc_id", "source"), t.labels.where("quality = 1"), "doc_id")[0]


@query("jon10_source_unavailable", """
SELECT doc_id, quality, CASE WHEN l.doc_id IS NULL THEN 'not_run_source_unavailable' ELSE 'planned' END AS execution_status
FROM documents d LEFT JOIN labels l USING (doc_id)""")
def _(t):
    return J.mark_unavailable(t.documents.select("doc_id"), t.labels, "doc_id", ["quality"])


@query("jon11_variant_comparison", """
SELECT parent_id, max(masked_position_count) FILTER (WHERE mask = 'none') AS "none", max(masked_position_count) FILTER (WHERE mask = 'question') AS question,
  max(masked_position_count) FILTER (WHERE mask = 'cot') AS cot, max(masked_position_count) FILTER (WHERE mask = 'question_and_cot') AS question_and_cot
FROM masks GROUP BY 1""")
def _(t):
    return J.variants_side_by_side(t.masks, "parent_id", "mask", "masked_position_count", ["none", "question", "cot", "question_and_cot"])


@query("win03_pivot_counts", """
SELECT condition, count(*) FILTER (WHERE final_branch = 'Q') AS "Q", count(*) FILTER (WHERE final_branch = 'QSTAR') AS "QSTAR",
  count(*) FILTER (WHERE final_branch = 'AMBIGUOUS') AS "AMBIGUOUS", count(*) FILTER (WHERE final_branch = 'OTHER') AS "OTHER" FROM runs GROUP BY 1""")
def _(t):
    return V.pivot_counts(t.runs, "condition", "final_branch", BRANCHES)


@query("win03_pivot_rates", """
SELECT condition, round(avg(CAST(final_branch = 'Q' AS INT)), 6) AS "Q", round(avg(CAST(final_branch = 'QSTAR' AS INT)), 6) AS "QSTAR",
  round(avg(CAST(final_branch = 'AMBIGUOUS' AS INT)), 6) AS "AMBIGUOUS", round(avg(CAST(final_branch = 'OTHER' AS INT)), 6) AS "OTHER" FROM runs GROUP BY 1""")
def _(t):
    return r6(V.pivot_rates(t.runs, "condition", "final_branch", BRANCHES), *BRANCHES)


PIVOT_SQL = """
WITH p AS (SELECT pair_id, category, arg_min(final_branch, run_id) FILTER (WHERE condition = 'view') AS "view",
  arg_min(final_branch, run_id) FILTER (WHERE condition = 'click') AS click, arg_min(final_branch, run_id) FILTER (WHERE condition = 'purchase') AS purchase
  FROM runs WHERE eligible GROUP BY 1, 2)
"""


def _pivoted(t):
    return V.pivot_first(t.runs.where("eligible"), ["pair_id", "category"], "condition", "final_branch", STEPS, F.col("run_id"))


@query("win04_pivot_per_question", PIVOT_SQL + "SELECT * FROM p")
def _(t):
    return _pivoted(t)


@query("win05_trajectory_counts", PIVOT_SQL + """
SELECT coalesce("view", 'None') || ' -> ' || coalesce(click, 'None') || ' -> ' || coalesce(purchase, 'None') AS trajectory, count(*) AS questions FROM p GROUP BY 1""")
def _(t):
    return V.value_counts(V.trajectory(_pivoted(t), STEPS), "trajectory")


@query("win06_paired_transitions", PIVOT_SQL + """
SELECT "view", click, count(*) AS questions FROM p WHERE "view" IS NOT NULL AND click IS NOT NULL GROUP BY 1, 2""")
def _(t):
    return V.paired_transitions(_pivoted(t), "view", "click")


@query("win07_first_last_state", """
SELECT pair_id, arg_min(final_branch, run_id) AS first_state, arg_max(final_branch, run_id) AS terminal_state,
  count(*) FILTER (WHERE final_branch = 'Q') AS q_mentions, count(*) FILTER (WHERE final_branch = 'QSTAR') AS qstar_mentions FROM runs GROUP BY 1""")
def _(t):
    return V.first_last_states(t.runs, "pair_id", "final_branch", F.col("run_id"), "Q", "QSTAR")


@query("win08_group_row_weight", "SELECT doc_id, round(1.0 / count(*) OVER (PARTITION BY source), 6) AS weight FROM documents")
def _(t):
    return r6(V.group_row_weight(t.documents.select("doc_id", "source"), "source").drop("source"), "weight")


@query("win09_keep_last", """
SELECT o_custkey, o_orderstatus, o_orderkey, o_orderpriority FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderkey DESC) AS r FROM orders) WHERE r = 1""")
def _(t):
    rows = t.orders.select("o_custkey", "o_orderstatus", "o_orderkey", "o_orderpriority")
    return V.keep_last(rows, ["o_custkey", "o_orderstatus"], [F.col("o_orderkey")])


@query("win10_keep_latest_over_files", """
SELECT pair_id, condition, arg_max(run_id, (CASE temperature WHEN '0.2' THEN 0 WHEN '0.7' THEN 1 ELSE 2 END) * 100000000 + run_id) AS run_id FROM runs GROUP BY 1, 2""")
def _(t):
    file_no = F.when(F.col("temperature") == "0.2", 0).when(F.col("temperature") == "0.7", 1).otherwise(2)
    rows = t.runs.select("pair_id", "condition", "run_id", file_no.alias("file_no"))
    return V.keep_last(rows, ["pair_id", "condition"], [F.col("file_no"), F.col("run_id")]).drop("file_no")


@query("win11_keep_first_over_sources", """
SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY CASE event_type WHEN 'purchase' THEN 0 ELSE 1 END, event_id) AS r
  FROM events WHERE user_id % 10 <> 0) WHERE r = 1""")
def _(t):
    rank = F.when(F.col("event_type") == "purchase", 0).otherwise(1)
    key = F.when(F.col("user_id") % 10 != 0, F.col("user_id"))
    rows = t.events.select(key.alias("user_id"), "event_id", rank.alias("source_rank"))
    return V.keep_first(rows, "user_id", [F.col("source_rank"), F.col("event_id")]).drop("source_rank")


@query("win12_margin_bins", """
WITH r AS (SELECT run_id, final_branch, row_number() OVER (PARTITION BY final_branch ORDER BY abs(margin), run_id) AS rn,
  count(*) OVER (PARTITION BY final_branch) AS n FROM runs WHERE final_branch IN ('Q', 'QSTAR')),
b AS (SELECT run_id, final_branch, CASE WHEN rn <= 25 THEN 'low' WHEN rn > n - 25 THEN 'high'
  WHEN rn > greatest(0, n // 2 - 12) AND rn <= greatest(0, n // 2 - 12) + 25 THEN 'middle' END AS margin_bin FROM r)
SELECT * FROM b WHERE margin_bin IS NOT NULL""")
def _(t):
    rows = t.runs.where(F.col("final_branch").isin("Q", "QSTAR")).select("run_id", "final_branch", "margin")
    return V.margin_bins(rows, "final_branch", "margin", "run_id", 25).drop("margin")


@query("win13_balanced_sample", """
WITH o AS (SELECT run_id, pair_id, final_branch, row_number() OVER (PARTITION BY final_branch, pair_id ORDER BY run_id) AS occ FROM runs),
r AS (SELECT *, row_number() OVER (PARTITION BY final_branch ORDER BY occ > 1, pair_id, run_id) AS rn FROM o)
SELECT run_id, pair_id, final_branch FROM r WHERE rn <= 200""")
def _(t):
    return V.balanced_sample(t.runs.select("run_id", "pair_id", "final_branch"), "final_branch", "pair_id", "run_id", 200)


@query("srt01_review_order", """
SELECT run_id, row_number() OVER (ORDER BY condition, category, pair_id, final_branch, coalesce(edit_type, 'None'),
   coalesce(s, -1), coalesce(edit_type, 'None'), run_id) AS position
FROM (SELECT *, CASE WHEN run_id % 3 = 0 THEN NULL ELSE run_id % 4 END AS s FROM runs)""")
def _(t):
    from runsift.operators.scale import global_row_number

    rows = t.runs.withColumn("s", F.when(F.col("run_id") % 3 != 0, F.col("run_id") % 4))
    keys = O.review_order("condition", "category", "pair_id", "final_branch", "edit_type", "s", "edit_type")
    return global_row_number(rows, [], [*keys, F.col("run_id")], "position").select("run_id", "position")


@query("srt02_order_like", """
SELECT doc_id, quality, n_chars AS position FROM labels JOIN documents USING (doc_id) ORDER BY position""")
def _(t):
    return O.order_like(t.labels.select("doc_id", "quality"), t.documents, "doc_id", "n_chars")


@query("srt03_abs_margin_order", "SELECT run_id, margin FROM runs ORDER BY abs(margin), margin")
def _(t):
    return O.by_abs_then_value(t.runs.select("run_id", "margin"), "margin")


@query("srt04_representative_cases", """
SELECT run_id, final_branch, "rank" FROM (SELECT *, row_number() OVER (PARTITION BY final_branch
  ORDER BY NOT (CAST(run_id AS STRING) LIKE '77%' OR CAST(run_id AS STRING) LIKE '91%'), condition, category, run_id) AS "rank" FROM runs) WHERE "rank" <= 6""")
def _(t):
    out = O.representative_cases(t.runs, "final_branch", "run_id", ["condition", "category"], ["77", "91"], 6)
    return out.select("run_id", "final_branch", "rank")


@query("srt07_most_common", """
SELECT token, count(*) AS "count" FROM (SELECT unnest(string_split(text, ' ')) AS token FROM documents) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 30""")
def _(t):
    return O.most_common(t.documents.select(F.explode(F.split("text", " ")).alias("token")), "token", 30)


@query("srt08_first_offenders", """
SELECT condition, count(*) AS offenders, array_to_string(list_sort(list(CAST(run_id AS STRING)))[1:3], ',') AS first_ids
FROM runs WHERE parse_status <> 'ok' GROUP BY 1""")
def _(t):
    return O.first_offenders(t.runs.where("parse_status <> 'ok'"), ["condition"], "run_id", 3)
