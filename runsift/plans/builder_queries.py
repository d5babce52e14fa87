"""BLD: dataset, plan and review-table builders over the given tables."""

from pyspark.sql import functions as F

from runsift.functions import strings as S
from runsift.functions import tokens as K
from runsift.functions import vocab
from runsift.operators import builders as B
from runsift.operators import joins as J
from runsift.plans import standins  # noqa: F401
from runsift.plans.registry import query
from runsift.plans.relational_queries import AUDIT_SQL, audited
from runsift.plans.text_queries import REDUCED, sql_list
from runsift.plans.token_queries import PREFIX_SQL

c = F.col


def lit_sql(text):
    """A Python text as SQL, line breaks as chr(10)."""
    return " || chr(10) || ".join("'" + part.replace("'", "''") + "'" for part in text.split("\n"))


@query("bld01_prompt_rows", """
SELECT pair_id || '::original' AS prompt_id, 'original' AS prompt_role, original_question AS question FROM pairs
UNION ALL SELECT pair_id || '::counterfactual', 'counterfactual', counterfactual_question FROM pairs WHERE status <> 'P'""")
def _(t):
    both, one = F.array(F.lit("original"), F.lit("counterfactual")), F.array(F.lit("original"))
    items = t.pairs.withColumn("roles", F.when(c("status") != "P", both).otherwise(one))
    return B.prompt_rows(items, "pair_id", "roles", {"original": c("original_question"), "counterfactual": c("counterfactual_question")}).select("prompt_id", "prompt_role", "question")


TRACE = "Words come first. Then more words: a list) and an end"


@query("bld02_transfer_interventions", f"""
WITH p AS (SELECT *, trim('{TRACE} ' || d || '! Then ' || e || '. Done') AS t FROM pairs), n AS (SELECT *, length(t) AS n, r AS ratio, k AS kind FROM p,
  (SELECT unnest([0.5, 0.9, 1.0, 1.0]::DOUBLE[]) AS r, unnest({sql_list([x["intervention_type"] for x in vocab.TRANSFER_CONDITIONS])}) AS k)),
e AS (SELECT *, list_filter(range(2, n + 1), lambda i: t[i] = ' ' AND t[i - 1] IN ('.', '!', '?', ')', ':')) AS ends,
  greatest(1, least(n, CAST(floor(n * ratio) AS INT))) AS target, floor(n * greatest(0.05::DOUBLE, ratio - 0.12::DOUBLE)) AS lo, floor(n * least(0.98::DOUBLE, ratio + 0.12::DOUBLE)) AS hi FROM n),
k AS (SELECT *, list_filter(ends, lambda i: i >= lo AND i <= hi) AS near FROM e),
d AS (SELECT *, list_sort(list_transform(CASE WHEN len(near) > 0 THEN near ELSE ends END, lambda i: abs(i - target) * 100000 + i))[1] % 100000 AS cut FROM k),
f AS (SELECT *, CASE WHEN ratio < 1 THEN rtrim(t[1 : cut]) ELSE t END AS injected_thought FROM d)
SELECT pair_id || '::' || kind AS intervention_id, injected_thought, CASE WHEN kind = 'full_cot_answer_only' THEN rtrim(original_question, chr(10)) || chr(10) || chr(10) || '{vocab.ANSWER_ONLY_INSTRUCTION}' ELSE original_question END AS question,
  '<|channel>thought' || chr(10) || injected_thought || CASE WHEN kind LIKE 'full%' THEN '<channel|>' ELSE '' END AS injected_raw_prefix FROM f""")
def _(t):
    items = t.pairs.withColumn("trace", F.concat(F.lit(TRACE + " "), "d", F.lit("! Then "), "e", F.lit(". Done")))
    out = B.transfer_interventions(items, "pair_id", "original_question", "trace")
    return out.select("intervention_id", "injected_thought", "question", "injected_raw_prefix")


EDITS = ["final_conclusion_corruption", "local_computation_corruption", "fake_verification", "method_step_corruption", "confidence_marker_ablation", "plain"]


def _tail_sql(name):
    return lit_sql(vocab.EDITED_TAILS[name]).replace("{w}", "' || w || '")


@query("bld03_edited_interventions", f"""
WITH p AS (SELECT *, '(' || (CAST(d AS BIGINT) + 1) || ', ' || {REDUCED} || ')' AS w, {sql_list(EDITS)}[1 + CAST(pair_id % 6 AS INT)] AS edit FROM pairs),
x AS (SELECT *, thought || CASE edit {" ".join(f"WHEN '{k}' THEN {_tail_sql(k)}" for k in EDITS[:4])}
  WHEN 'confidence_marker_ablation' THEN CASE WHEN pair_id % 2 = 0 THEN {_tail_sql("uncertainty")} ELSE {_tail_sql("confidence")} END ELSE {_tail_sql("other")} END AS injected_thought FROM p)
SELECT pair_id || '::' || k AS intervention_id, w AS expected_wrong_answer, sha256(injected_thought) AS thought_hash, length(injected_thought) AS injected_char_count
FROM x, (SELECT unnest(['edited_full_cot_normal', 'edited_full_cot_answer_only']) AS k)""")
def _(t):
    items = t.pairs.withColumns({"edit": F.get(F.array(*map(F.lit, EDITS)), (c("pair_id") % 6).cast("int")), "kind": F.lit("tuple")})
    out = B.edited_interventions(items, "pair_id", c("pair_id"), "original_question", "thought", "edit", "original_answer", "kind")
    return out.select("intervention_id", "expected_wrong_answer", F.sha2("injected_thought", 256).alias("thought_hash"), "injected_char_count")


SUFFIX_SQL = " ".join(f"WHEN '{k}' THEN " + lit_sql(v).replace("{eq}", "' || a || 'x + ' || b || 'y = ' || c || '") for k, v in vocab.PROBE_SUFFIXES.items())
ASK_SQL = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in vocab.PROBE_QUESTIONS.items())
PROBES_SQL = f"""
WITH v AS (SELECT unnest({sql_list([v[0] for v in vocab.PROBE_VARIANTS])}) AS variant, unnest({sql_list([v[2] for v in vocab.PROBE_VARIANTS])}) AS suffix, unnest({sql_list([v[3] for v in vocab.PROBE_VARIANTS])}) AS ask),
r AS (SELECT pair_id, variant, CASE WHEN suffix = '' THEN thought ELSE thought || chr(10) || chr(10) || CASE suffix {SUFFIX_SQL} END END AS injected_thought,
  CASE WHEN ask <> '' THEN rtrim(original_question, chr(10)) || chr(10) || chr(10) || CASE ask {ASK_SQL} END WHEN variant = 'baseline_full_qstar_answer_only' THEN rtrim(original_question, chr(10)) || chr(10) || chr(10) || '{vocab.ANSWER_ONLY_INSTRUCTION}' ELSE original_question END AS question
  FROM pairs, v)
"""


def _probes(t):
    priors = t.runs.groupBy("pair_id").agg(F.min("final_branch").alias("prior_label"))
    return B.probe_rows(t.pairs, "pair_id", "original_question", "counterfactual_question", "thought", priors)


@query("bld04_probe_rows", PROBES_SQL + """
SELECT pair_id, variant AS probe_variant, sha256(injected_thought) AS thought_hash, sha256(question) AS question_hash, prior_label
FROM r LEFT JOIN (SELECT pair_id, min(final_branch) AS prior_label FROM runs GROUP BY 1) USING (pair_id)""")
def _(t):
    return _probes(t).select("pair_id", "probe_variant", F.sha2("injected_thought", 256).alias("thought_hash"), F.sha2("question", 256).alias("question_hash"), "prior_label")


FOCUS = ["frame_generic_present", "frame_qstar_self_check", "final_restate_system_first"]


@query("bld05_focused_subset", PROBES_SQL + f"SELECT pair_id, variant AS probe_variant FROM r WHERE variant IN ('{FOCUS[0]}', '{FOCUS[1]}', '{FOCUS[2]}') AND pair_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def _(t):
    items = t.labels.where("quality = 1").select(c("doc_id").alias("pair_id"))
    return B.focused_subset(_probes(t), "pair_id", items, "probe_variant", FOCUS).select("pair_id", "probe_variant")


def _ablation_sql(template):
    return lit_sql(template).replace("{eqs}", "' || eqs || '").replace("{sol}", "' || sol || '").replace("{checks}", "' || checks || '")


CHECK1 = "a * CAST(e AS BIGINT) * a + CAST(b AS BIGINT) * CAST(b AS BIGINT)"
BY = "CASE WHEN b = '1' THEN 'y' ELSE b || 'y' END"
RED = lambda n, d: f"CASE WHEN ({n}) % ({d}) = 0 THEN CAST(({n}) // ({d}) AS STRING) ELSE (({n}) // gcd(abs({n}), {d})) || '/' || (({d}) // gcd(abs({n}), {d})) END"


@query("bld06_source_ablation", f"""
WITH p AS (SELECT *, '    (1) `' || a || 'x + ' || {BY} || ' = ' || c || '`' || chr(10) || '    (2) `x - y = ' || e || '`' AS eqs, 'x = ' || e || ', y = ' || {REDUCED} AS sol, {REDUCED} AS y FROM pairs),
k AS (SELECT *, '    * Check (1) `' || a || 'x + ' || {BY} || ' = ' || c || '`: ' || a || 'x=' || a || '(' || e || '), ' || CASE WHEN b = '1' THEN 'y=' || y ELSE b || 'y=' || b || '(' || y || ')' END || '; left side = '
  || {RED(CHECK1, "a")} || ' = ' || c || '. (' || CASE WHEN {CHECK1} = CAST(c AS BIGINT) * a THEN 'Correct' ELSE 'Mismatch' END || ')' || chr(10)
  || '    * Check (2) `x - y = ' || e || '`: x=' || e || ', -1y=-1(' || y || '); left side = ' || {RED("CAST(e AS BIGINT) * a - CAST(b AS BIGINT)", "a")} || ' = ' || e || '. (Mismatch)' AS checks FROM p),
v AS (SELECT pair_id, variant, CASE variant WHEN 'raw_full_qstar_cot_control' THEN thought WHEN 'raw_truncated_before_closure' THEN split_part(thought, chr(10) || '2. **Final Review', 1) || {lit_sql(vocab.CLOSED_AT_HEADING)}
  WHEN 'minimal_qstar_state' THEN {_ablation_sql(vocab.MINIMAL_STATE)} WHEN 'weak_summary_no_verification' THEN {_ablation_sql(vocab.WEAK_SUMMARY)} ELSE {_ablation_sql(vocab.STRONG_STATE)} END AS th
  FROM k, (SELECT unnest({sql_list([x["variant_id"] for x in B.ABLATION_VARIANTS])}) AS variant))
SELECT pair_id || '::' || variant AS intervention_id, sha256(th) AS thought_hash FROM v""")
def _(t):
    out = B.source_ablation(t.pairs, "pair_id", "counterfactual_question", "counterfactual_answer", "thought", ["x", "y"])
    return out.select("intervention_id", F.sha2("injected_thought", 256).alias("thought_hash"))


@query("bld07_candidate_texts", f"""
SELECT pair_id, k AS template, CASE k WHEN 'standard_system' THEN {lit_sql(vocab.CANDIDATE_PREAMBLES["standard_system"][2])} ELSE '' END || '1) ' || a || 'x + ' || b || 'y = ' || c || chr(10) AS preamble,
  '2) 1x - 1y = ' || d || chr(10) AS q_line, '2) 1x - 1y = ' || e || chr(10) AS qstar_line FROM pairs, (SELECT unnest(['standard_system', 'minimal']) AS k)""")
def _(t):
    out = B.candidate_texts(t.pairs, "pair_id", "original_question", "counterfactual_question", F.lit(2), ["standard_system", "minimal"])
    return out.select("pair_id", "template", "preamble", "q_line", "qstar_line")


CONDITIONS = [{"condition": "cot_50", "answer_format": "normal"}, {"condition": "full_only", "answer_format": "answer_only"}]


def _sources(t):
    return t.labels.select(c("doc_id").alias("pair_id"), F.concat(F.lit("trace "), "quality").alias("trace"))


@query("bld08_prefill_plan", f"""
SELECT pair_id || '::' || k || '::' || s AS row_id, CASE WHEN k = 'full_only' THEN rtrim(original_question, chr(10)) || chr(10) || chr(10) || '{vocab.ANSWER_ONLY_INSTRUCTION}' ELSE original_question END AS question_used,
  CASE WHEN doc_id IS NULL THEN 'not_run_source_unavailable' ELSE 'planned' END AS execution_status
FROM pairs LEFT JOIN labels ON doc_id = pair_id, (SELECT unnest(['cot_50', 'full_only']) AS k), (SELECT unnest(['primary', 'second']) AS s)""")
def _(t):
    out = B.prefill_plan(t.pairs, _sources(t), "pair_id", "original_question", CONDITIONS, ["primary", "second"], ["trace"])
    return out.select("row_id", "question_used", "execution_status")


@query("bld09_grounding_plan", """
WITH g AS (SELECT *, CASE WHEN r = 'conflict' THEN original_question ELSE counterfactual_question END AS active FROM pairs LEFT JOIN labels ON doc_id = pair_id,
  (SELECT unnest(['hidden_prefill', 'explicit_user_trace']) AS p), (SELECT unnest(['plain', 'compare']) AS i), (SELECT unnest(['conflict', 'matched']) AS r))
SELECT pair_id || '::' || p || '::' || i || '::' || r || '::primary' AS row_id, CASE WHEN doc_id IS NULL THEN NULL ELSE rtrim(active, chr(10)) || chr(10) || chr(10) ||
  CASE WHEN p = 'hidden_prefill' THEN '' ELSE '<trace>' || chr(10) || 'trace ' || quality || chr(10) || '</trace>' || chr(10) || chr(10) END || CASE i WHEN 'plain' THEN 'Answer.' ELSE 'Compare first.' END END AS question_used FROM g""")
def _(t):
    out = B.grounding_plan(
        t.pairs, _sources(t), "pair_id", "original_question", "counterfactual_question", "trace", ["hidden_prefill", "explicit_user_trace"],
        {"plain": "Answer.", "compare": "Compare first."}, ["primary"], ("<trace>", "</trace>"))
    return out.select("row_id", "question_used")


@query("bld10_boundary_packet", """
SELECT doc_id, lang, quality, right(text, 1800) AS trace_tail, right(text, 2400) AS answer_tail, '' AS human_label, '' AS human_notes FROM documents JOIN labels USING (doc_id)""")
def _(t):
    rows = t.documents.join(t.labels, "doc_id")
    return B.review_packet(rows, ["doc_id", "lang", "quality"], {"trace_tail": ("text", 1800), "answer_tail": ("text", 2400)}, ["human_label", "human_notes"])


@query("bld11_judge_view", """
SELECT pair_id, sha256('ORIGINAL QUESTION:' || chr(10) || original_question || chr(10) || chr(10) || 'COUNTERFACTUAL QUESTION:' || chr(10) || counterfactual_question || chr(10) || chr(10) || 'ORIGINAL ANSWER: ' || original_answer || chr(10)
  || 'EXPECTED WRONG/COUNTERFACTUAL ANSWER: ' || counterfactual_answer || chr(10) || chr(10) || 'INJECTED COT PREFIX:' || chr(10) || thought || chr(10) || chr(10) || '[INJECTION ENDS HERE]' || chr(10) || chr(10) || 'GENERATED COT CONTINUATION:' || chr(10) || chr(10) || chr(10)
  || '[COT ENDS / ANSWER CHANNEL BEGINS]' || chr(10) || chr(10) || 'FINAL ANSWER:' || chr(10) || final_answer || chr(10)) AS view_hash FROM pairs""")
def _(t):
    view = B.judge_view(c("original_question"), c("counterfactual_question"), c("original_answer"), c("counterfactual_answer"), c("thought"), F.lit(""), c("final_answer"))
    return t.pairs.select("pair_id", F.sha2(view, 256).alias("view_hash"))


@query("bld12_review_queue", """
SELECT 'sampling::' || run_id AS review_record_id, 'sampling' AS record_family, CAST(run_id AS STRING) AS result_record_id, temperature, NULL AS mask FROM runs
UNION ALL SELECT 'masking::' || parent_id || '-' || line_no, 'masking', parent_id || '-' || line_no, NULL, mask FROM masks""")
def _(t):
    a = t.runs.select(c("run_id").cast("string").alias("result_record_id"), "temperature")
    b = t.masks.select(F.concat_ws("-", "parent_id", "line_no").alias("result_record_id"), "mask")
    out = B.review_queue([("sampling", a), ("masking", b)])
    return out.select("review_record_id", "record_family", "result_record_id", "temperature", "mask")


@query("bld13_audit_log", AUDIT_SQL + "SELECT * FROM j WHERE audit_status <> 'auto_accepted'")
def _(t):
    return B.changed_labels(audited(t))


@query("bld14_merged_labels", """
SELECT doc_id, quality, toxic, lang, source FROM labels LEFT JOIN (SELECT doc_id, lang, source FROM documents) USING (doc_id)""")
def _(t):
    packets = t.documents.select("doc_id", "lang", "source", F.lit(-1).alias("quality"))
    return B.merge_labels(packets, t.labels, "doc_id", ["quality", "toxic"])


@query("bld15_monitor_frame", PREFIX_SQL + "SELECT row_id, k, role || ': ' || prefix AS visible_text FROM p JOIN token_rows USING (row_id)")
def _(t):
    rows = t.token_rows.select("row_id", F.concat("role", F.lit(": ")).alias("base"), K.prefixes_at(c("words"), [0, 1, 2, 4, 8, 16, 32]).alias("by_k"))
    return B.monitor_frame(rows, "base", "by_k").select("row_id", "k", "visible_text")


@query("bld16_prefix_depths", """
WITH f AS (SELECT row_id, words, CAST(i AS DOUBLE) / 10 AS fraction FROM token_rows, (SELECT unnest(range(1, 11)) AS i))
SELECT row_id, fraction, CAST(greatest(1, round_even(len(words) * fraction, 0)) AS INT) AS prefix_tokens, sha256(array_to_string(words[1 : CAST(greatest(1, round_even(len(words) * fraction, 0)) AS INT)], ' ')) AS prefix_hash FROM f""")
def _(t):
    out = B.prefix_depths(t.token_rows.select("row_id", "words"), "words", [i / 10 for i in range(1, 11)])
    return out.select("row_id", "fraction", "prefix_tokens", F.sha2(F.array_join("prefix", " "), 256).alias("prefix_hash"))


@query("udf04_suffix_templates", """
SELECT pair_id, 'Use `' || a || 'x + ' || b || 'y = ' || c || '` and answer ' || counterfactual_answer || '.' AS text FROM pairs""")
def _(t):
    text = B.fill("Use `{eq}` and answer {answer}.", eq=S.first_equation(c("counterfactual_question")), answer=c("counterfactual_answer"))
    return t.pairs.select("pair_id", text.alias("text"))


MARKERS = {"system": ("<a>", "</a>"), "user": ("<b>", "</b>"), "assistant": ("<think>", "</think>")}


@query("udf05_format_markers", """
WITH m AS (SELECT unnest(['system', 'user', 'assistant']) AS role, unnest(['<a>', '<b>', '<think>']) AS o, unnest(['</a>', '</b>', '</think>']) AS e),
r AS (SELECT conv_id, turn, role, e, o || split_part(text, ' ', 1) || e || text AS raw FROM conversations JOIN m USING (role))
SELECT conv_id, turn, split_part(raw, e, 1) AS thought, substr(raw, position(e IN raw) + length(e)) AS answer FROM r""")
def _(t):
    start, end = F.lit(""), F.lit("")
    for role, (o, e) in MARKERS.items():
        start, end = F.when(c("role") == role, o).otherwise(start), F.when(c("role") == role, e).otherwise(end)
    rows = t.conversations.withColumns({"o": start, "e": end})
    rows = rows.withColumn("raw", F.concat("o", F.substring_index("text", " ", 1), "e", "text"))
    at = F.position(c("e"), c("raw"))
    return rows.select("conv_id", "turn", F.substring(c("raw"), F.lit(1), at - 1).alias("thought"),
                       F.substring(c("raw"), at + F.length("e"), F.lit(100_000_000)).alias("answer"))
