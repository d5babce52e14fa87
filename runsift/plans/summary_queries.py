"""AGG: counts, rates and summaries."""

from pyspark.sql import functions as F

from runsift.functions import labels as lab
from runsift.operators import summary as S
from runsift.plans import standins  # noqa: F401
from runsift.plans.registry import query

CONDITIONS = ["view", "click", "purchase", "signup"]
BRANCHES = ["Q", "QSTAR", "AMBIGUOUS", "OTHER"]


def r6(df, *cols):
    """Round double columns so that summation order does not show."""
    return df.withColumns({c: F.round(c, 6) for c in cols})


@query("agg01_accuracy_by_role", """
SELECT prompt_role, category, count(final_correct) AS "count", CAST(sum(CAST(final_correct AS INT)) AS BIGINT) AS "sum",
  round(avg(CAST(final_correct AS DOUBLE)), 6) AS mean FROM controls GROUP BY 1, 2""")
def _(t):
    return r6(S.accuracy_by_keys(t.controls, ["prompt_role", "category"], "final_correct"), "mean")


@query("agg02_contingency", """
SELECT condition, edit_type, final_branch, count(*) AS "count" FROM runs WHERE edit_type IS NOT NULL GROUP BY 1, 2, 3""")
def _(t):
    return S.contingency(t.runs, ["condition", "edit_type", "final_branch"])


@query("agg03_counter_keeps_null", """
SELECT edit_type, category, count(*) AS "count" FROM runs GROUP BY 1, 2""")
def _(t):
    return S.contingency(t.runs, ["edit_type", "category"], keep_null_keys=True)


@query("agg04_multi_key_summary", """
SELECT final_branch, condition, category, temperature, count(*) AS "count",
  CASE grouping_id(condition, category, temperature) WHEN 3 THEN 'condition' WHEN 5 THEN 'category'
    WHEN 6 THEN 'temperature' ELSE 'condition,category' END AS summary
FROM runs GROUP BY GROUPING SETS ((final_branch, condition), (final_branch, category), (final_branch, temperature),
  (final_branch, condition, category))""")
def _(t):
    sets = [["condition"], ["category"], ["temperature"], ["condition", "category"]]
    return S.multi_key_counts(t.runs, "final_branch", sets)


@query("agg05_share_of_total", """
SELECT status, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM controls), 6) AS pct
FROM controls GROUP BY 1""")
def _(t):
    return r6(S.share_of_total(t.controls, "status"), "pct")


@query("agg06_sampling_rates", """
SELECT pair_id, temperature, count(*) AS samples,
  round(avg(CASE WHEN final_branch = trace_branch THEN 1.0 ELSE 0 END), 6) AS greedy_reproduction,
  round(avg(CASE WHEN final_branch = 'Q' THEN 1.0 ELSE 0 END), 6) AS q_rate,
  round(avg(CASE WHEN final_branch = 'QSTAR' THEN 1.0 ELSE 0 END), 6) AS qstar_rate,
  round(avg(CASE WHEN final_branch NOT IN ('Q', 'QSTAR') THEN 1.0 ELSE 0 END), 6) AS other_rate
FROM runs GROUP BY 1, 2""")
def _(t):
    out = S.sampling_rates(t.runs, ["pair_id", "temperature"], "final_branch", "trace_branch")
    return r6(out, "greedy_reproduction", "q_rate", "qstar_rate", "other_rate")


@query("agg07_instruction_summary", """
SELECT temperature, condition, count(*) AS runs, count(*) FILTER (WHERE final_branch = 'Q') AS q_branch,
  count(*) FILTER (WHERE final_branch = 'QSTAR') AS qstar_branch,
  round(avg(CASE WHEN eligible THEN 1.0 ELSE 0 END), 6) AS bridge_language_rate,
  round(avg(CASE WHEN truncated THEN 1.0 ELSE 0 END), 6) AS both_values_rate
FROM runs GROUP BY 1, 2""")
def _(t):
    out = S.instruction_summary(t.runs, ["temperature", "condition"], "final_branch", "eligible", "truncated")
    return r6(out, "bridge_language_rate", "both_values_rate")


@query("agg08_guarded_rates", """
SELECT round(avg(CASE WHEN mask = 'none' THEN CAST(masked_branch = natural_branch AS INT) END), 6) AS natural_branch_reproduction,
  round(avg(CASE WHEN mask = 'question' THEN CAST(masked_branch = 'QSTAR' AS INT) END), 6) AS q_suppressed_qstar_rate,
  round(avg(CASE WHEN mask = 'cot' THEN CAST(masked_branch = 'Q' AS INT) END), 6) AS cot_suppressed_q_rate,
  CAST(avg(CASE WHEN mask = 'absent' THEN 1 END) AS DOUBLE) AS absent_rate
FROM masks""")
def _(t):
    mask, branch = F.col("mask"), F.col("masked_branch")
    out = S.guarded_rates(t.masks, {
        "natural_branch_reproduction": (mask == "none", branch == F.col("natural_branch")),
        "q_suppressed_qstar_rate": (mask == "question", branch == "QSTAR"),
        "cot_suppressed_q_rate": (mask == "cot", branch == "Q"),
        "absent_rate": (mask == "absent", branch == "Q"),
    })
    return r6(out, *out.columns)


@query("agg09_success_trials", """
WITH x AS (SELECT unnest(['natural outcome reproduced', 'question hidden', 'trace hidden', 'both hidden']) AS test,
  unnest(['none', 'question', 'cot', 'question_and_cot']) AS m)
SELECT test, count(*) FILTER (WHERE CASE m WHEN 'none' THEN masked_branch = natural_branch WHEN 'question' THEN masked_branch = 'QSTAR'
  WHEN 'cot' THEN masked_branch = 'Q' ELSE masked_branch = 'OTHER' END) AS successes, count(mask) AS trials,
  round(successes / greatest(trials, 1), 6) AS rate
FROM x LEFT JOIN masks ON mask = m GROUP BY test""")
def _(t):
    mask, branch = F.col("mask"), F.col("masked_branch")
    out = S.success_trials(t.masks, {
        "natural outcome reproduced": (mask == "none", branch == F.col("natural_branch")),
        "question hidden": (mask == "question", branch == "QSTAR"),
        "trace hidden": (mask == "cot", branch == "Q"),
        "both hidden": (mask == "question_and_cot", branch == "OTHER"),
    })
    return r6(out, "rate")


@query("agg10_sign_agreement", """
SELECT count(*) AS cases, round(avg(CAST((margin > 0) = (final_branch = 'QSTAR') AS INT)), 6) AS sign_accuracy FROM runs""")
def _(t):
    return r6(S.sign_agreement(t.runs, "margin", "final_branch"), "sign_accuracy")


GRID_SQL = """
WITH g AS (SELECT c.condition, k.category, b.final_branch FROM
   (SELECT unnest(['view', 'click', 'purchase', 'signup']) AS condition) c
   CROSS JOIN (SELECT DISTINCT category FROM runs WHERE eligible) k
   CROSS JOIN (SELECT unnest(['Q', 'QSTAR', 'AMBIGUOUS', 'OTHER']) AS final_branch) b),
n AS (SELECT condition, category, final_branch, count(*) AS n FROM runs WHERE eligible GROUP BY 1, 2, 3),
f AS (SELECT condition, category, final_branch, coalesce(n, 0) AS "count" FROM g LEFT JOIN n USING (condition, category, final_branch)),
r AS (SELECT *, CAST(sum("count") OVER (PARTITION BY condition, category) AS BIGINT) AS category_total FROM f)
"""


def _rates(t):
    grid = S.zero_filled_counts(
        t.runs.where("eligible"), "condition", "category", "final_branch", CONDITIONS, BRANCHES)
    return S.with_partition_rate(grid, ["condition", "category"], "category_total")


@query("agg11_macro_branch_rates", GRID_SQL + """
SELECT condition, final_branch, round(avg("count" / nullif(category_total, 0)), 6) AS macro_rate FROM r GROUP BY 1, 2""")
def _(t):
    return r6(S.macro_rates(_rates(t), ["condition", "final_branch"]), "macro_rate")


@query("win01_partition_total", GRID_SQL + """
SELECT condition, category, final_branch, "count", category_total, round("count" / nullif(category_total, 0), 6) AS rate FROM r""")
def _(t):
    return r6(_rates(t), "rate")


@query("win02_zero_filled_grid", GRID_SQL + "SELECT * FROM f")
def _(t):
    return S.zero_filled_counts(
        t.runs.where("eligible"), "condition", "category", "final_branch", CONDITIONS, BRANCHES)


@query("agg12_distinct_counts", """
SELECT category, count(DISTINCT pair_id) AS pairs, count(DISTINCT margin) AS margins FROM runs GROUP BY 1""")
def _(t):
    return t.runs.groupBy("category").agg(
        F.countDistinct("pair_id").alias("pairs"), F.countDistinct("margin").alias("margins"))


@query("agg13_set_equality", """
WITH p AS (SELECT pair_id, CASE WHEN bool_or(status NOT IN ('F', 'O')) THEN 'other' WHEN bool_or(status = 'F') AND bool_or(status = 'O') THEN 'both'
  WHEN bool_or(status = 'F') THEN 'only_F' ELSE 'only_O' END AS preference_set FROM controls GROUP BY 1)
SELECT preference_set, count(*) AS cases FROM p GROUP BY 1""")
def _(t):
    return S.set_equality_counts(t.controls, "pair_id", "status", ("F", "O"))


@query("agg14_median", """
SELECT condition, round(median(margin), 6) AS median FROM runs GROUP BY 1""")
def _(t):
    return r6(S.median_by(t.runs, ["condition"], "margin"), "median")


@query("agg15_feature_means", """
SELECT l.quality, count(*) AS n, round(avg(d.n_chars), 6) AS mean_n_chars, round(avg(l.toxic), 6) AS mean_toxic
FROM documents d JOIN labels l USING (doc_id) GROUP BY 1""")
def _(t):
    rows = t.documents.select("doc_id", "n_chars").join(t.labels, "doc_id")
    return r6(S.feature_means(rows, "quality", ["n_chars", "toxic"]), "mean_n_chars", "mean_toxic")


@query("agg16_duplicates", """
SELECT l_orderkey, l_linenumber, count(*) AS "count" FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1""")
def _(t):
    return S.duplicates(t.lineitem, ["l_orderkey", "l_linenumber"])


@query("agg17_stage_status", """
SELECT condition, parse_status, count(*) AS "rows", count(*) FILTER (WHERE truncated) AS truncated_rows
FROM runs WHERE execution_status = 'generated' GROUP BY 1, 2""")
def _(t):
    return S.stage_status(t.runs, "condition", "execution_status", "parse_status", "truncated")


@query("agg18_usable_rate", """
SELECT condition, count(*) AS "rows", count(*) FILTER (WHERE parse_status = 'ok' AND NOT truncated) AS usable,
  round(usable / count(*), 6) AS usable_rate, CAST(CASE condition WHEN 'view' THEN 0.88 ELSE 0.87 END AS DOUBLE) AS minimum,
  usable / count(*) >= minimum AS passed FROM runs GROUP BY 1""")
def _(t):
    floor = F.when(F.col("condition") == "view", F.lit(0.88)).otherwise(F.lit(0.87))
    return r6(S.usable_rate(t.runs, "condition", "parse_status", "truncated", floor), "usable_rate")


@query("agg19_source_rate", """
WITH m AS (SELECT doc_id, doc_id IN (SELECT doc_id FROM labels) AS have FROM documents)
SELECT count(*) AS planned, count(*) FILTER (WHERE have) AS available,
  (SELECT string_agg(s, ',' ORDER BY s) FROM (SELECT CAST(doc_id AS STRING) AS s FROM m WHERE NOT have ORDER BY doc_id LIMIT 3)) AS first_missing,
  round(available / planned, 6) AS source_rate FROM m""")
def _(t):
    return r6(S.source_coverage(t.documents, t.labels, "doc_id"), "source_rate")


@query("agg20_ranked_vocabulary", """
WITH w AS (SELECT conv_id, turn, unnest(string_split(text, ' ')) AS token, generate_subscripts(string_split(text, ' '), 1) - 1 AS rank FROM conversations)
SELECT token, CAST(sum(greatest(1, 8 - rank)) AS BIGINT) AS weight FROM w WHERE length(token) BETWEEN 1 AND 28 GROUP BY 1""")
def _(t):
    words = t.conversations.select(F.posexplode(F.split("text", " ")).alias("rank", "token"))
    return S.ranked_vocabulary(words, "token", "rank", 8, F.length("token").between(1, 28))


@query("agg21_distribution_mismatch", """
WITH e AS (SELECT o_orderpriority AS category, 1000 + 1000 * (ascii(o_orderpriority) % 3) AS expected FROM orders GROUP BY o_orderpriority)
SELECT category, coalesce(expected, 0) AS expected, coalesce(n, 0) AS observed
FROM e FULL JOIN (SELECT category, count(*) AS n FROM controls GROUP BY 1) o USING (category) WHERE expected IS DISTINCT FROM n""")
def _(t):
    expected = t.orders.groupBy(F.col("o_orderpriority").alias("category")).agg(
        (F.lit(1000) + 1000 * (F.ascii("category") % 3)).alias("expected"))
    return S.distribution_mismatch(t.controls, "category", expected)


@query("agg22_children_per_parent", """
SELECT o_orderkey, coalesce(n, 0) AS children, CASE WHEN o_orderkey % 2 = 0 THEN 4 ELSE 3 END AS expected_children
FROM orders LEFT JOIN (SELECT l_orderkey AS o_orderkey, count(*) AS n FROM lineitem GROUP BY 1) USING (o_orderkey)
WHERE coalesce(n, 0) <> CASE WHEN o_orderkey % 2 = 0 THEN 4 ELSE 3 END""")
def _(t):
    wanted = F.when(F.col("o_orderkey") % 2 == 0, 4).otherwise(3)
    children = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"))
    return S.children_mismatch(t.orders.select("o_orderkey"), children, "o_orderkey", wanted)


PROGRESS_SQL = """
WITH e AS (SELECT condition, temperature, count(*) + CASE temperature WHEN '0.7' THEN 25 ELSE 0 END AS expected FROM runs GROUP BY 1, 2),
c AS (SELECT condition, temperature, count(*) AS n FROM runs WHERE execution_status = 'generated' OR temperature = '0.2' GROUP BY 1, 2),
p AS (SELECT condition, temperature, expected, coalesce(n, 0) AS completed, round(100.0 * completed / expected, 2) AS percent,
  completed = expected AS complete FROM e LEFT JOIN c USING (condition, temperature))
"""


def _progress(t):
    runs = t.runs
    extra = F.when(F.col("temperature") == "0.7", 25).otherwise(0)
    expected = runs.groupBy("condition", "temperature").agg(F.count("*").alias("n")).select(
        "condition", "temperature", (F.col("n") + extra).alias("expected"))
    done = runs.where("execution_status = 'generated' OR temperature = '0.2'")
    return S.progress_table(done, expected, ["condition", "temperature"])


@query("agg23_stage_progress", PROGRESS_SQL + "SELECT * FROM p")
def _(t):
    return _progress(t)


@query("agg23_overall_progress", PROGRESS_SQL + """
SELECT CAST(sum(least(completed, expected)) AS BIGINT) AS completed, CAST(sum(expected) AS BIGINT) AS expected,
  round(100.0 * sum(least(completed, expected)) / sum(expected), 2) AS percent FROM p""")
def _(t):
    return S.overall_progress(_progress(t))


@query("agg24_forecast_accuracy", """
WITH f AS (SELECT CASE WHEN parse_status <> 'ok' THEN 'UNPARSEABLE' ELSE trace_branch END AS prediction, final_branch FROM runs)
SELECT count(*) AS "rows", count(*) FILTER (WHERE prediction <> 'UNPARSEABLE') AS parseable,
  round(avg(CAST(prediction = final_branch AS INT)) FILTER (WHERE prediction <> 'UNPARSEABLE'), 6) AS accuracy FROM f""")
def _(t):
    rows = t.runs.withColumn("prediction", F.when(F.col("parse_status") != "ok", "UNPARSEABLE").otherwise(F.col("trace_branch")))
    return r6(S.forecast_accuracy(rows, "prediction", "final_branch"), "accuracy")


@query("agg25_heuristic_accuracy", """
WITH f AS (SELECT quality, length(text) - length(replace(text, 'th', '')) >= 40 AND length(text) - length(replace(text, 'er', '')) >= 40
   AND n_chars >= 800 AND NOT contains(text, '@') AS rule FROM documents JOIN labels USING (doc_id))
SELECT count(*) AS "rows", count(*) FILTER (WHERE rule) AS predicted, round(avg(CAST(rule = (quality = 1) AS INT)), 6) AS accuracy FROM f""")
def _(t):
    rows = t.documents.join(t.labels, "doc_id")
    text = F.col("text")
    rule = lab.follow_heuristic(
        authority=lab.term_count(text, "th"), verification=lab.term_count(text, "er"),
        fractions=F.col("n_chars"), reanchor=lab.term_count(text, "@"), floors=(20, 20, 800))
    return r6(S.heuristic_accuracy(rows, rule, F.col("quality") == 1), "accuracy")
