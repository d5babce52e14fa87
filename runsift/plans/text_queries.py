"""STR, MTH-1..5 and LBL over the given tables."""

from pyspark.sql import functions as F

from runsift.functions import labels as L
from runsift.functions import rationals as R
from runsift.functions import strings as S
from runsift.functions import vocab
from runsift.operators import builders as B
from runsift.operators import joins as J
from runsift.plans import standins  # noqa: F401
from runsift.plans.registry import query
from runsift.plans.token_queries import text_of

c = F.col
NUM = r"[-+]?(?:\d+\s*/\s*\d+|\d+\.\d+|\d+)"
NORM = (r"replace(replace(replace(replace(regexp_replace(translate({t}, '−–—', '---'), '\\d?frac\s*\{\s*([-+]?\d+)\s*\}\s*\{\s*(\d+)\s*\}', '\1/\2', 'g'),"
        r" '\times', '*'), '\cdot', '*'), '$', ''), '**', '')")
CANON = (r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(translate(lower({t}), '−–', '--'), '[$`*{}\[\]()\\\s]', '', 'g'), '\++-', '-', 'g'), '--', '+', 'g'),"
         r" '(^|[^0-9])1([xyz])', '\1\2', 'g')")
# RE2 has no lookaround: words that hold letters are matched first and dropped.
WORD_OR_NUM = rf"[-+]?[A-Za-z_0-9]*[A-Za-z_][A-Za-z_0-9]*|{NUM}"
NUMBERS = "list_filter(regexp_extract_all({t}, '" + WORD_OR_NUM + "'), lambda m: NOT regexp_matches(m, '[A-Za-z_]'))"


def sql_list(values):
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def norm(t):
    """Thousands commas need a lookaround, so the twin removes them where a comma stands between digits."""
    return r"regexp_replace(" + NORM.replace("{t}", t) + r", '(\d),(\d\d\d)', '\1\2', 'g')"


@query("str01_normalise_math", f"SELECT pair_id, {norm('final_answer')} AS text FROM pairs")
def _(t):
    return t.pairs.select("pair_id", S.normalise_math(c("final_answer")).alias("text"))


@query("str02_compact_equation", "SELECT pair_id, regexp_replace(lower(" + norm("original_question") + r"), '[{}\\\s]', '', 'g') AS text FROM pairs")
def _(t):
    return t.pairs.select("pair_id", S.compact_equation(c("original_question")).alias("text"))


@query("str03_canonical_equation", "SELECT pair_id, " + CANON.replace("{t}", r"replace(original_question, '1x - 1y', '+1x +--1y')") + " AS text FROM pairs")
def _(t):
    q = F.replace("original_question", F.lit("1x - 1y"), F.lit("+1x +--1y"))
    return t.pairs.select("pair_id", S.canonical_equation(q).alias("text"))


@query("str04_pretty_equation", r"""
SELECT pair_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(original_question, ' - ', ' + -'), '\b1([a-z])\b', '\1', 'g'), '\+-', '-', 'g'),
  '\+\s*-', '- ', 'g'), '-1([a-z])\b', '- \1', 'g'), '\s+', ' ', 'g')) AS text FROM pairs""")
def _(t):
    return t.pairs.select("pair_id", S.pretty_equation(F.replace("original_question", F.lit(" - "), F.lit(" + -"))).alias("text"))


@query("str05_equation_key", r"SELECT pair_id, lower(regexp_replace(final_answer, '[\s$]', '', 'g')) AS key FROM pairs")
def _(t):
    return t.pairs.select("pair_id", S.equation_key(c("final_answer")).alias("key"))


@query("str06_loose_text", r"""
SELECT pair_id, lower(trim(regexp_replace(translate(regexp_replace(regexp_replace(replace(final_answer, '\\frac', ' frac'), '\$+', ' ', 'g'), '\\\\[a-zA-Z]+', ' ', 'g'), '{}−–', '  --'), '\\s+', ' ', 'g'))) AS loose,
  regexp_replace(replace(lower(final_answer), '\\', '\'), '\s+', ' ', 'g') AS folded FROM pairs""")
def _(t):
    return t.pairs.select("pair_id", S.loose_text(c("final_answer")).alias("loose"), S.packet_text(c("final_answer")).alias("folded"))


@query("str07_numbers",
       "WITH n AS (SELECT pair_id, " + norm("concat(final_answer, ' 3x _4 5')") + " AS t FROM pairs) SELECT pair_id, len(" + NUMBERS.replace("{t}", "t")
       + ") AS n, round(list_sum(list_transform(" + NUMBERS.replace("{t}", "t") + r", lambda m: CAST(split_part(m, '/', 1) AS DOUBLE) / CAST(coalesce(nullif(split_part(m, '/', 2), ''), '1') AS DOUBLE))), 6) AS total FROM n")
def _(t):
    rows = t.pairs.select("pair_id", S.numbers(F.concat("final_answer", F.lit(" 3x _4 5"))).alias("v"))
    total = F.aggregate("v", F.lit(0.0), lambda a, v: a + R.as_double(v))
    return rows.select("pair_id", F.size("v").alias("n"), F.round(total, 6).alias("total"))


@query("str08_audit_numbers", r"""
WITH p AS (SELECT pair_id, final_answer AS t, regexp_replace(final_answer, '\\frac\s*\{\s*(-?\d+)\s*\}\s*\{\s*(-?\d+)\s*\}', '\1/\2', 'g') AS plain FROM pairs)
SELECT pair_id, len(regexp_extract_all(t, '\\frac\s*\{\s*-?\d+\s*\}\s*\{\s*-?\d+\s*\}'))
  + len(list_filter(regexp_extract_all(plain, '[\w/.-]*[\w][\w/.-]*'), lambda m: regexp_full_match(m, '-?\d+(?:\.\d+)?(?:/-?\d+)?'))) AS n FROM p""")
def _(t):
    return t.pairs.select("pair_id", F.size(S.audit_numbers(c("final_answer"))).alias("n"))


@query("str09_assignments", r"""
SELECT pair_id, regexp_extract_all(final_answer, '\bx\s*=\s*(-?\d+(?:\.\d+)?(?:\s*/\s*-?\d+)?)', 1)[-1] AS x,
  regexp_extract_all(final_answer, '\by\s*=\s*(-?\d+(?:\.\d+)?(?:\s*/\s*-?\d+)?)', 1)[-1] AS y FROM pairs""")
def _(t):
    rows = t.pairs.select("pair_id", "a", "b", S.assignments(c("final_answer")).alias("v"))
    y = F.when(R.equal(c("v.y"), R.parse(F.concat_ws("/", "b", "a"))), F.concat_ws("/", "b", "a")).otherwise(R.to_text(c("v.y")))
    return rows.select("pair_id", R.to_text(c("v.x")).alias("x"), y.alias("y"))


CLOSEST_SQL = rf"""
WITH p AS (SELECT pair_id, concat('x = 1; ', final_answer, ' so y = 2 or x = 3.') AS t FROM pairs),
m AS (SELECT pair_id, t, unnest(range(1, length(t) + 1)) AS pos FROM p),
h AS (SELECT pair_id, pos, substr(t, pos, 1) AS var, regexp_extract(substr(t, pos), '^[xy]\s*=\s*({NUM})', 1) AS value FROM m
   WHERE regexp_matches(substr(t, pos), '^[xy]\s*=\s*{NUM}') AND (pos = 1 OR NOT regexp_matches(substr(t, pos - 1, 1), '\w'))),
b AS (SELECT a.pair_id, a.value AS x, b.value AS y, row_number() OVER (PARTITION BY a.pair_id ORDER BY abs(a.pos - b.pos), -greatest(a.pos, b.pos)) AS rn
   FROM h a JOIN h b ON a.pair_id = b.pair_id AND a.var = 'x' AND b.var = 'y')
SELECT pair_id, x, round(CAST(split_part(y, '/', 1) AS DOUBLE) / CAST(coalesce(nullif(split_part(y, '/', 2), ''), '1') AS DOUBLE), 6) AS y FROM b WHERE rn = 1
"""


@query("str10_closest_assignment", CLOSEST_SQL)
def _(t):
    txt = F.concat(F.lit("x = 1; "), "final_answer", F.lit(" so y = 2 or x = 3."))
    rows = S.closest_assignment(t.pairs, S.normalise_math(txt), ["x", "y"], "v")
    return rows.select("pair_id", R.to_text(c("v")[0]).alias("x"), F.round(R.as_double(c("v")[1]), 6).alias("y"))


@query("str11_tuple_candidate", r"""
SELECT pair_id, nullif(regexp_extract(final_answer, '\((\d+), (\d+/\d+)\)', 1), '') AS first_value FROM pairs""")
def _(t):
    rows = t.pairs.select("pair_id", S.tuple_candidate(c("final_answer"), 2).alias("v"))
    return rows.select("pair_id", R.to_text(c("v")[0]).alias("first_value"))


CUE = r"final\s+answer|solution|therefore|thus|hence|we\s+(?:obtain|get|find)"
CONCLUSION_SQL = rf"""
WITH p AS (SELECT pair_id, category, original_answer, counterfactual_answer, b || '/' || a AS ratio, d, e, {norm('final_answer')} AS t FROM pairs),
w AS (SELECT *, regexp_extract_all(t, '(?is)(?:{CUE})(.{{0,320}})', 1)[-1] AS win, regexp_extract(t, '[(\[]([^()\[\]]+)[)\]]', 1) AS tup FROM p),
v AS (SELECT *, regexp_extract(win, '(?i)\bx\s*=\s*({NUM})', 1) AS x1, regexp_extract(win, '(?i)\by\s*=\s*({NUM})', 1) AS y1,
  {NUMBERS.replace("{t}", "tup")} AS tv, {NUMBERS.replace("{t}", "t")} AS nums FROM w),
m AS (SELECT *, CASE WHEN x1 <> '' AND y1 <> '' THEN 'labelled_variable_assignments' WHEN len(tv) = 2 THEN 'last_ordered_tuple' ELSE 'no_tuple_conclusion' END AS method,
  CASE WHEN x1 <> '' AND y1 <> '' THEN x1 WHEN len(tv) = 2 THEN tv[1] END AS x, CASE WHEN x1 <> '' AND y1 <> '' THEN y1 WHEN len(tv) = 2 THEN tv[2] END AS y FROM v),
r AS (SELECT *, coalesce(x = d AND y = ratio, false) AS mq, coalesce(x = e AND y = ratio, false) AS ms,
  list_contains(nums, d) AND list_contains(nums, ratio) AS pq, list_contains(nums, e) AND list_contains(nums, ratio) AS ps FROM m),
f AS (SELECT *, CASE WHEN mq AND NOT ms THEN 'Q' WHEN ms AND NOT mq THEN 'QSTAR' WHEN mq AND ms THEN 'AMBIGUOUS' WHEN pq AND NOT ps THEN 'Q' WHEN ps AND NOT pq THEN 'QSTAR'
  WHEN pq AND ps THEN 'AMBIGUOUS' ELSE 'OTHER' END AS branch FROM r)
"""


@query("str12_conclusion", CONCLUSION_SQL + "SELECT pair_id, method, x FROM f")
def _(t):
    rows = S.extract_conclusion(t.pairs, c("final_answer"), ["x", "y"], 2)
    return rows.select("pair_id", c("conclusion.method").alias("method"), R.to_text(F.get(c("conclusion.values"), F.lit(0))).alias("x"))


@query("str12_single_conclusion", rf"""
WITH p AS (SELECT pair_id, {norm('final_answer')} AS t FROM pairs),
s AS (SELECT pair_id, t, regexp_extract_all(t, '(?i)(?:final\s+answer|answer|therefore|thus|hence)\s*(?:is|:|=)?\s*([^\n]{{0,160}})', 1)[-1] AS seg FROM p),
v AS (SELECT pair_id, {NUMBERS.replace("{t}", "coalesce(seg, '')")} AS a, {NUMBERS.replace("{t}", "t")} AS b FROM s)
SELECT pair_id, CASE WHEN len(a) > 0 THEN 'last_answer_label' WHEN len(b) > 0 THEN 'last_numeric_value' ELSE 'no_numeric_conclusion' END AS method FROM v""")
def _(t):
    rows = S.extract_conclusion(t.pairs, c("final_answer"), [], 1)
    return rows.select("pair_id", c("conclusion.method").alias("method"))


@query("str13_rfind", "SELECT doc_id, CASE WHEN position('eht' IN reverse(text)) = 0 THEN -1 ELSE length(text) - 3 - position('eht' IN reverse(text)) + 1 END AS at FROM documents")
def _(t):
    return t.documents.select("doc_id", S.rfind(c("text"), F.lit("the")).alias("at"))


@query("str14_occurrences", """
SELECT conv_id, turn, len(list_filter(range(1, length(text)), lambda i: text[i : i + 1] = 'ee')) AS n FROM conversations""")
def _(t):
    return t.conversations.select("conv_id", "turn", F.size(S.occurrences(c("text"), F.lit("ee"))).alias("n"))


@query("str15_changed_line", """
SELECT pair_id, 3 AS line_number, '1x - 1y = ' || d AS original, '1x - 1y = ' || e AS counterfactual FROM pairs""")
def _(t):
    q, s = c("original_question"), c("counterfactual_question")
    rows = t.pairs.select("pair_id", S.first_changed_line(q, s).alias("l"), S.changed_equation(q, s).alias("e"))
    return rows.select("pair_id", "l.line_number", "l.original", c("e.s").alias("counterfactual"))


@query("str16_changed_pairs", "SELECT pair_id, 'x-y=' || d AS q, 'x-y=' || e AS s FROM pairs")
def _(t):
    rows = t.pairs.select("pair_id", F.explode(S.changed_equations(c("original_question"), c("counterfactual_question"))).alias("p"))
    return rows.select("pair_id", S.canonical_equation(c("p.q")).alias("q"), S.canonical_equation(c("p.s")).alias("s"))


@query("str17_equation_lines", """
SELECT pair_id, array_to_string(list_filter(string_split(original_question, chr(10))[2:], lambda l: contains(l, '=')), '|') AS skipped,
  len(list_filter(string_split(original_question, chr(10)), lambda l: contains(l, '='))) AS n FROM pairs""")
def _(t):
    q = c("original_question")
    return t.pairs.select("pair_id", F.array_join(S.equation_lines(q, 1), "|").alias("skipped"), F.size(S.equation_lines(q)).alias("n"))


@query("str18_first_equation", """
WITH l AS (SELECT page_id, list_filter(list_transform(string_split(html, '<'), lambda x: trim(x)), lambda x: x <> '') AS l FROM pages)
SELECT page_id, coalesce(list_filter(l, lambda x: contains(x, '='))[1], l[-1]) AS eq FROM l""")
def _(t):
    return t.pages.select("page_id", S.first_equation(F.replace(F.translate("html", "\n\r\x0b\x0c\u0085\u2028\u2029", " "), F.lit("<"), F.lit("\n"))).alias("eq"))


@query("str19_bridge_evidence", rf"""
SELECT pair_id, len(regexp_extract_all(final_answer, '(?i){vocab.BRIDGE_PATTERN}')) > 0 AS bridge_language,
  array_to_string(regexp_extract_all(final_answer, '(?i){vocab.BRIDGE_PATTERN}'), '|') AS matches, list_contains(n, d) AS mentions_q, list_contains(n, e) AS mentions_qstar
FROM (SELECT *, {NUMBERS.replace("{t}", norm("final_answer"))} AS n FROM pairs)""")
def _(t):
    rows = S.bridge_evidence(t.pairs, c("final_answer"), c("d"), c("e"), name="v")
    return rows.select("pair_id", "v.bridge_language", F.array_join("v.bridge_matches", "|").alias("matches"),
                       c("v.mentions_original_changed_value").alias("mentions_q"), c("v.mentions_counterfactual_changed_value").alias("mentions_qstar"))


TERMS = ["th", "qu", "éé", "ung", "reth"]


@query("str20_term_detectors", f"""
SELECT pair_id, len(list_filter({sql_list(vocab.EXPLICIT_BRIDGE_TERMS)}, lambda t: contains(lower(final_answer), t))) > 0 AS explicit_bridge,
  len(list_filter({sql_list(vocab.BOUNDARY_BRIDGE_TERMS)}, lambda t: contains(lower(final_answer), t))) > 0 AS boundary_bridge,
  len(list_filter({sql_list(vocab.ABLATION_BRIDGE_TERMS)}, lambda t: contains(lower(final_answer), t))) > 0 AS ablation_bridge,
  array_to_string(list_filter({sql_list(vocab.PACKET_BRIDGE_TERMS)}, lambda t: contains(lower(final_answer), t)), '|') AS packet_terms FROM pairs""")
def _(t):
    low = F.lower("final_answer")
    return t.pairs.select(
        "pair_id", S.has_term(S.loose_text(c("final_answer")), vocab.EXPLICIT_BRIDGE_TERMS).alias("explicit_bridge"),
        S.has_term(low, vocab.BOUNDARY_BRIDGE_TERMS).alias("boundary_bridge"), S.has_term(low, vocab.ABLATION_BRIDGE_TERMS).alias("ablation_bridge"),
        F.array_join(S.matching_terms(S.packet_text(c("final_answer")), vocab.PACKET_BRIDGE_TERMS), "|").alias("packet_terms"))


@query("str21_false_conflict", "SELECT doc_id, regexp_matches(text, '(?i)tho|ing') AND NOT regexp_matches(text, '(?i)ess|ung') AS flagged FROM documents")
def _(t):
    return t.documents.select("doc_id", S.false_conflict(c("text"), "tho|ing", "ess|ung").alias("flagged"))


SCORE_SQL = r"""
WITH p AS (SELECT pair_id, final_answer AS t, original_answer, d, e, b || '/' || a AS ratio FROM pairs),
g AS (SELECT *, regexp_extract_all(t, '\bx\s*=\s*(-?\d+(?:\.\d+)?(?:\s*/\s*-?\d+)?)', 1)[-1] AS x, regexp_extract_all(t, '\by\s*=\s*(-?\d+(?:\.\d+)?(?:\s*/\s*-?\d+)?)', 1)[-1] AS y FROM p),
s AS (SELECT pair_id,
  CASE WHEN x IS NULL AND y IS NULL THEN CASE WHEN contains(t, '(' || d || ', ' || ratio || ')') THEN 8 ELSE 0 END ELSE 4 * (coalesce(x = d, false)::INT + coalesce(y = ratio, false)::INT) END AS o,
  CASE WHEN x IS NULL AND y IS NULL THEN CASE WHEN contains(t, '(' || e || ', ' || ratio || ')') THEN 8 ELSE 0 END ELSE 4 * (coalesce(x = e, false)::INT + coalesce(y = ratio, false)::INT) END AS w FROM g),
r AS (SELECT pair_id, o AS final_original_score, w AS final_wrong_score, CASE WHEN o = 0 AND w = 0 THEN 'unclear' WHEN w > o THEN 'counterfactual_or_edited_wrong' WHEN o > w THEN 'original' ELSE 'mixed' END AS final_relation FROM s)
"""


def _relation(t):
    return S.answer_relation(t.pairs, c("final_answer"), c("original_answer"), c("counterfactual_answer"), "final")


@query("str22_answer_score", SCORE_SQL + "SELECT pair_id, final_original_score, final_wrong_score FROM r")
def _(t):
    return _relation(t).select("pair_id", "final_original_score", "final_wrong_score")


@query("str23_answer_relation", SCORE_SQL + "SELECT pair_id, final_relation FROM r")
def _(t):
    return _relation(t).select("pair_id", "final_relation")


@query("str24_answer_mentions", r"""
SELECT pair_id, contains(replace(lower(final_answer), ' ', ''), d) AND contains(replace(lower(final_answer), ' ', ''), b || '/' || a) AS mentioned FROM pairs""")
def _(t):
    return t.pairs.select("pair_id", S.answer_mentions(c("final_answer"), c("original_answer")).alias("mentioned"))


def _count_sql(column, term):
    return f"(length({column}) - length(replace({column}, '{term}', ''))) // {len(term)}"


@query("str25_text_features", rf"""
SELECT doc_id, length(text) AS chars, CASE WHEN text = '' THEN 0 ELSE length(text) - length(replace(text, chr(10), '')) + 1 END AS lines,
  len(regexp_extract_all(lower(text), 'equation|eq\.|\(\d+\)')) AS equation_refs, len(regexp_extract_all(text, '[$=]|\\frac|\\times|\\implies')) AS math_lines,
  len(regexp_extract_all(text, '\d+\s*/\s*\d+|\\frac')) AS fraction_mentions, {_count_sql('lower(text)', 'en')} + {_count_sql('lower(text)', 'ing')} AS frequent_terms FROM documents""")
def _(t):
    cols = S.text_features(c("text"), {"frequent": ["en", "ing"]})
    return t.documents.select("doc_id", *cols).drop("step_mentions")


@query("str26_trace_features", r"""
SELECT pair_id, length(thought) AS cot_chars, len(string_split(thought, chr(10))) AS cot_lines, length(thought) - length(replace(thought, '/', '')) AS cot_fraction_slashes,
  len(regexp_extract_all(thought, '(?i)verif|check')) AS cot_verify_mentions, len(regexp_extract_all(thought, '(?i)question|prompt|problem')) AS cot_question_mentions,
  len(regexp_extract_all(thought, '(?i)\bwait\b|re-?read|double.?check')) AS cot_wait_mentions, right(thought, 1200) AS cot_tail FROM pairs""")
def _(t):
    return t.pairs.select("pair_id", *S.trace_features(c("thought")))


@query("str27_value_mentions", r"""
WITH w AS (SELECT pair_id, d, e, regexp_extract_all(replace(final_answer, ' ', ''), '[\d/]+') AS n FROM pairs)
SELECT pair_id, len(list_filter(n, lambda x: x = d)) AS q_mentions, len(list_filter(n, lambda x: x = e)) AS qstar_mentions FROM w""")
def _(t):
    return t.pairs.select("pair_id", S.value_mentions(c("final_answer"), c("d")).alias("q_mentions"), S.value_mentions(c("final_answer"), c("e")).alias("qstar_mentions"))


RAW = "CASE pair_id % 4 WHEN 0 THEN '<|channel>thought' || chr(10) || thought || '<channel|>' || final_answer || '<turn|>x' WHEN 1 THEN '<think>' || thought || '</think> ' || final_answer WHEN 2 THEN '<b>' || final_answer || '<eos>' ELSE final_answer || '<channel|>' END"


def _raw():
    m = c("pair_id") % 4
    return (F.when(m == 0, F.concat(F.lit("<|channel>thought\n"), "thought", F.lit("<channel|>"), "final_answer", F.lit("<turn|>x")))
            .when(m == 1, F.concat(F.lit("<think>"), "thought", F.lit("</think> "), "final_answer"))
            .when(m == 2, F.concat(F.lit("<b>"), "final_answer", F.lit("<eos>"))).otherwise(F.concat("final_answer", F.lit("<channel|>"))))


@query("str28_split_response", "SELECT pair_id, CASE WHEN pair_id % 4 < 2 THEN thought ELSE '' END AS thought, final_answer AS answer FROM pairs")
def _(t):
    return t.pairs.select("pair_id", S.split_response(_raw()).alias("r")).select("pair_id", "r.thought", "r.answer")


@query("str29_split_continuation", f"""
WITH r AS (SELECT pair_id, {RAW} AS raw FROM pairs)
SELECT pair_id, CASE WHEN contains(raw, '<channel|>') THEN split_part(raw, '<channel|>', 1) ELSE raw END AS generated_trace,
  CASE WHEN contains(raw, '<channel|>') THEN 'generated_continuation' ELSE 'not_seen' END AS marker_source,
  CASE WHEN contains(raw, '<channel|>') THEN substr(raw, position('<channel|>' IN raw) + 10) ELSE '' END AS final_raw FROM r""")
def _(t):
    return t.pairs.select("pair_id", S.split_continuation(c("thought"), _raw()).alias("r")).select("pair_id", "r.*")


@query("str30_marker_counts", f"""
WITH r AS (SELECT pair_id, {RAW} || '<channel|><eos>' AS raw FROM pairs)
SELECT pair_id, {_count_sql('raw', '<|channel>thought')} AS thought_start_count, {_count_sql('raw', '<channel|>')} AS answer_channel_count,
  {_count_sql('raw', '<turn|>')} AS turn_count, {_count_sql('raw', '<eos>')} AS eos_count FROM r""")
def _(t):
    return t.pairs.select("pair_id", *S.marker_counts(F.concat(_raw(), F.lit("<channel|><eos>"))))


@query("str31_previews", r"""
SELECT doc_id, CASE WHEN length(text) <= 600 THEN text ELSE text[1:300] || chr(10) || '...[TRIMMED FOR PACKET; USE RAW FILE FOR FULL TEXT]...' || chr(10) || text[length(text) - 299:] END AS trimmed,
  replace(text, chr(10), '\n')[1:80] || CASE WHEN length(replace(text, chr(10), '\n')) > 80 THEN '...' ELSE '' END AS preview FROM documents""")
def _(t):
    return t.documents.select("doc_id", S.trim_middle(c("text"), 600).alias("trimmed"), S.preview(c("text"), 80).alias("preview"))


@query("str32_cut_at_boundary", r"""
WITH p AS (SELECT conv_id, turn, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM conversations), n AS (SELECT *, length(t) AS n FROM p),
g AS (SELECT *, greatest(1, least(n, CAST(floor(n * 0.5) AS INT))) AS target, floor(n * 0.38) AS lo, floor(n * 0.62) AS hi FROM n),
e AS (SELECT *, list_filter(range(2, n + 1), lambda i: t[i] = ' ' AND t[i - 1] IN ('.', '!', '?', ')', ':')) AS ends FROM g),
k AS (SELECT *, list_filter(ends, lambda i: i >= lo AND i <= hi) AS near FROM e),
d AS (SELECT *, list_sort(list_transform(CASE WHEN len(near) > 0 THEN near ELSE ends END, lambda i: abs(i - target) * 100000 + i))[1] % 100000 AS cut FROM k)
SELECT conv_id, turn, rtrim(t[1 : coalesce(cut, target)]) AS cut_text FROM d""")
def _(t):
    folded = F.trim(F.regexp_replace("text", r"(?U)\s+", " "))
    return S.cut_at_boundary(t.conversations.withColumn("folded", folded), c("folded"), 0.5).select("conv_id", "turn", "cut_text")


@query("str33_cut_before_closing", """
SELECT pair_id, split_part(thought, chr(10) || '2. **Final Review', 1) || chr(10) || chr(10) ||
  'I will stop the scratchpad here before the final verification/formatting step. Now present the solution clearly.' AS thought FROM pairs""")
def _(t):
    return t.pairs.select("pair_id", S.cut_before_closing(c("thought")).alias("thought"))


@query("str34_channel_markers", f"""
WITH r AS (SELECT pair_id, {RAW} AS raw FROM pairs)
SELECT pair_id, split_part(raw, '<channel|>', 1) AS stripped, CASE WHEN ends_with(raw, '<channel|>') THEN raw ELSE raw || '<channel|>' END AS closed,
  CASE WHEN starts_with(raw, '<|channel>thought') THEN raw ELSE '<|channel>thought' || chr(10) || raw END AS opened FROM r""")
def _(t):
    raw = _raw()
    return t.pairs.select("pair_id", S.strip_answer_channel(raw).alias("stripped"), S.ensure_answer_channel(raw).alias("closed"), S.ensure_thought(raw).alias("opened"))


VARIANTS = ["original", "truncate_before_closure", *vocab.SUFFIX_SENTENCES, *vocab.RECAP_LABELS]


@query("str35_suffix_variants", rf"""
WITH r AS (SELECT *, thought || '<channel|>' AS raw, v AS variant FROM pairs, (SELECT unnest({sql_list(VARIANTS)}) AS v))
SELECT pair_id, variant, sha256(CASE variant WHEN 'original' THEN raw WHEN 'truncate_before_closure' THEN raw
  {" ".join(f"WHEN '{k}' THEN thought || chr(10) || chr(10) || '" + v.strip().replace("'", "''") + "' || '<channel|>'" for k, v in vocab.SUFFIX_SENTENCES.items())}
  ELSE thought || chr(10) || chr(10) || 'Final consistency recap of the ' || CASE variant WHEN 'append_q_system_recap' THEN 'original user-prompt system' ELSE 'counterfactual scratchpad system' END || ':' || chr(10)
   || '    (1) $' || a || 'x + ' || b || 'y = ' || c || '$' || chr(10) || '    (2) $1x - 1y = ' || CASE variant WHEN 'append_q_system_recap' THEN d ELSE e END || '$' || chr(10)
   || 'The final response should present the solution for this active system.' || '<channel|>' END) AS text_hash FROM r""")
def _(t):
    rows = J.expand(t.pairs, variant=VARIANTS)
    made = S.suffix_variant(F.concat("thought", F.lit("<channel|>")), c("variant"), c("original_question"), c("counterfactual_question"))
    return rows.select("pair_id", "variant", F.sha2(made, 256).alias("text_hash"))


@query("str36_first_move", r"""
WITH w AS (SELECT pair_id, final_answer, d, e, regexp_extract_all(final_answer, '\d+') AS n FROM pairs)
SELECT pair_id, CASE WHEN contains(final_answer, '1x - 1y = ' || e) THEN 'starts_with_Qstar_changed_line' WHEN contains(final_answer, '1x - 1y = ' || d) THEN 'starts_with_Q_changed_line'
  WHEN list_contains(n, e) THEN 'mentions_Qstar_changed_value_early' WHEN list_contains(n, d) THEN 'mentions_Q_changed_value_early' ELSE 'unknown' END AS move FROM w""")
def _(t):
    rows = t.pairs.withColumn("l", S.first_changed_line(c("original_question"), c("counterfactual_question")))
    return rows.select("pair_id", S.first_move(c("final_answer"), c("l.original"), c("l.counterfactual")).alias("move"))


@query("str37_last_label", "SELECT doc_id, coalesce(regexp_extract_all(upper(text), 'HANDING|TION')[-1], 'UNPARSEABLE') AS label FROM documents")
def _(t):
    return t.documents.select("doc_id", S.last_label(c("text"), ["HANDING", "TION"]).alias("label"))


TOKENS_SQL = "SELECT DISTINCT unnest(string_split(text, ' ')) AS token FROM conversations"


@query("str38_readable_token", rf"""
WITH t AS ({TOKENS_SQL})
SELECT token, CASE WHEN trim(token) = '' OR length(token) > 28 OR regexp_matches(token, '[<>�]') THEN false WHEN regexp_full_match(trim(token), '[-+*/=().,:;$]+') THEN true
  WHEN length(trim(token)) = 1 AND regexp_matches(trim(token), '[[:punct:]]') THEN false WHEN regexp_full_match(trim(token), '\d+([./]\d+)?') THEN true
  ELSE length(regexp_replace(token, '[^\x00-\x7f]', '', 'g')) / length(token) >= 0.85 AND regexp_matches(token, '[A-Za-z0-9]') AND NOT regexp_matches(token, '[a-z][A-Z][a-z]') END AS readable FROM t""")
def _(t):
    words = t.conversations.select(F.explode(F.split("text", " ")).alias("token")).distinct()
    return words.select("token", S.readable_token(c("token")).alias("readable"))


@query("str39_keyword_hits", rf"""
WITH p AS (SELECT pair_id, string_split(final_answer, ' ') AS w FROM pairs)
SELECT pair_id, array_to_string(list_filter(w, lambda x: lower(trim(x, ' .,:;!?()[]{{}}')) IN ('answer', 'final', 'equals', 'therefore', 'result', 'value', 'solution')), '|') AS answer_words FROM p""")
def _(t):
    return t.pairs.select("pair_id", F.array_join(S.keyword_hits(F.split("final_answer", " "), vocab.ANSWER_WORDS), "|").alias("answer_words"))


@query("str40_safe_name", r"SELECT page_id, replace(replace(replace(url, '::', '__'), '/', '_'), '\', '_') AS name, regexp_replace(url, '[^A-Za-z0-9_.-]+', '__', 'g') AS case_name FROM pages")
def _(t):
    return t.pages.select("page_id", S.safe_name(c("url")).alias("name"), S.safe_case_name(c("url")).alias("case_name"))


@query("str41_visible_escape", r"""
SELECT conv_id, turn, array_to_string(list_transform(string_split(text, ''), lambda ch: CASE WHEN ch = '\' THEN '\\' WHEN ch = chr(10) THEN '\n' WHEN ch = chr(13) THEN '\r' WHEN ch = chr(9) THEN '\t'
  WHEN unicode(ch) BETWEEN 32 AND 126 THEN ch WHEN unicode(ch) < 256 THEN '\x' || lpad(printf('%x', unicode(ch)), 2, '0') WHEN unicode(ch) < 65536 THEN '\u' || lpad(printf('%x', unicode(ch)), 4, '0')
  ELSE '\U' || lpad(printf('%x', unicode(ch)), 8, '0') END), '') AS shown FROM conversations""")
def _(t):
    return t.conversations.select("conv_id", "turn", S.visible_escape(c("text")).alias("shown"))


@query("mth01_rational_equality", """
SELECT pair_id, CAST(b AS BIGINT) * 6 = a * 4 AS equals_two_thirds, CAST(b AS BIGINT) * 2 = a AS equals_half FROM pairs""")
def _(t):
    v = R.parse(F.concat_ws("/", "b", "a"))
    return t.pairs.select("pair_id", R.equal(v, R.parse(F.lit("4/6"))).alias("equals_two_thirds"), R.equal(v, R.parse(F.lit("0.50"))).alias("equals_half"))


@query("mth01_long_values", """
WITH k AS (SELECT o_orderkey, CAST(o_orderkey + 1 AS STRING) AS k, CAST(3 + o_orderkey % 10 AS INT) AS n FROM orders)
SELECT o_orderkey, 3 AS found, concat('1', repeat(lpad('1', CAST(length(k) AS INT), '0'), n - 1)) AS ratio, repeat(k, n) AS whole, true AS same FROM k""")
def _(t):
    """Numbers of up to 80 digits: an order number written n times, over itself, alone, and a decimal as a fraction."""
    key, n = (c("o_orderkey") + 1).cast("string"), (c("o_orderkey") % 10 + 3).cast("int")
    # Long numbers are dear for the bytes their orders take, so the number of tasks is not left to the size of the table.
    orders = t.orders.select("o_orderkey").repartition(4 * t.spark.sparkContext.defaultParallelism)
    rows = orders.select("o_orderkey", key.alias("k"), F.repeat(key, n).alias("long"))
    decimal = F.concat(F.lit("0."), F.repeat(F.lit("3"), F.lit(20)), "k")
    spelled = F.concat(F.repeat(F.lit("3"), F.lit(20)), "k", F.lit("/1"), F.repeat(F.lit("0"), F.length("k") + 20))
    text = F.concat(F.lit("first "), "long", F.lit(" / "), "k", F.lit(" then 000"), "long", F.lit(" and "), decimal)
    rows = rows.withColumn("v", S.numbers(text)).withColumn("same", R.equal(c("v")[2], R.parse_all(F.array(spelled))[0]))
    return rows.select("o_orderkey", F.size("v").alias("found"), R.to_text(c("v")[0]).alias("ratio"), R.to_text(c("v")[1]).alias("whole"), "same")


REDUCED = "CASE WHEN CAST(b AS BIGINT) % a = 0 THEN CAST(CAST(b AS BIGINT) // a AS STRING) ELSE (CAST(b AS BIGINT) // gcd(CAST(b AS BIGINT), a)) || '/' || (a // gcd(CAST(b AS BIGINT), a)) END"


@query("mth02_rational_format", f"SELECT pair_id, {REDUCED} AS value, '(' || d || ', ' || {REDUCED} || ')' AS tuple FROM pairs")
def _(t):
    return t.pairs.select("pair_id", R.to_text(R.parse(F.concat_ws("/", "b", "a"))).alias("value"), R.tuple_text(R.answer_values(c("original_answer"))).alias("tuple"))


@query("mth03_perturbed_answer", f"""
SELECT pair_id, '(' || (CAST(d AS BIGINT) + 1) || ', ' || {REDUCED} || ')' AS wrong_tuple, CAST(CAST(c AS BIGINT) + 1 AS STRING) AS wrong_value FROM pairs""")
def _(t):
    return t.pairs.select("pair_id", R.perturbed_answer(c("original_answer"), F.lit("tuple")).alias("wrong_tuple"), R.perturbed_answer(c("c"), F.lit("integer")).alias("wrong_value"))


@query("mth04_answer_complexity", """
SELECT pair_id, 2 AS answer_num_count, (CAST(b AS BIGINT) % a <> 0)::INT AS answer_nonint_count, a // gcd(CAST(b AS BIGINT), a) AS answer_max_den FROM pairs""")
def _(t):
    return t.pairs.select("pair_id", R.complexity(c("original_answer")).alias("v")).select("pair_id", "v.*")


@query("mth05_answer_check", """
SELECT pair_id, 1 AS equation_no, CASE WHEN a * CAST(d AS BIGINT) * a + CAST(b AS BIGINT) * CAST(b AS BIGINT) = CAST(c AS BIGINT) * a THEN 'Correct' ELSE 'Mismatch' END AS status FROM pairs
UNION ALL SELECT pair_id, 2, CASE WHEN CAST(d AS BIGINT) * a - CAST(b AS BIGINT) = CAST(d AS BIGINT) * a THEN 'Correct' ELSE 'Mismatch' END FROM pairs""")
def _(t):
    return B.check_answers(t.pairs, "pair_id", "original_question", "original_answer", ["x", "y"]).select("pair_id", "equation_no", "status")


def answer_branches(t):
    q, s = R.answer_values(c("original_answer")), R.answer_values(c("counterfactual_answer"))
    rows = t.pairs.withColumns({"qv": q, "sv": s})
    return L.answer_branch(rows, c("final_answer"), c("qv"), c("sv"), ["x", "y"], 2)


@query("lbl01_answer_branch", CONCLUSION_SQL + "SELECT pair_id, branch, method FROM f")
def _(t):
    return answer_branches(t).select("pair_id", "answer.branch", c("answer.extraction_method").alias("method"))


LINE_SQL = r"""
WITH x AS (SELECT pair_id, d, e, regexp_replace(lower(final_answer || ' 1x - 1y = ' || d || CASE WHEN pair_id % 4 = 0 THEN ' or 1x - 1y = ' || e ELSE '' END), '\s', '', 'g') AS t,
  '1x-1y=' || d AS q, '1x-1y=' || e AS s FROM pairs),
p AS (SELECT pair_id, CASE WHEN contains(t, q) THEN length(t) - position(reverse(q) IN reverse(t)) - length(q) ELSE -1 END AS pq,
  CASE WHEN contains(t, s) THEN length(t) - position(reverse(s) IN reverse(t)) - length(s) ELSE -1 END AS ps FROM x)
SELECT pair_id, CASE WHEN pq < 0 AND ps < 0 THEN 'OTHER' WHEN pq = ps THEN 'AMBIGUOUS' WHEN pq > ps THEN 'Q' ELSE 'QSTAR' END AS equation_branch FROM p
"""


@query("lbl02_equation_branch", LINE_SQL)
def _(t):
    tail = F.when(c("pair_id") % 4 == 0, F.concat(F.lit(" or 1x - 1y = "), "e")).otherwise("")
    rows = t.pairs.withColumn("txt", F.concat("final_answer", F.lit(" 1x - 1y = "), "d", tail))
    rows = L.equation_branch(rows, c("txt"), c("original_question"), c("counterfactual_question"), F.lit(True))
    return rows.select("pair_id", "equation_branch")


@query("lbl03_visible_branch", CONCLUSION_SQL + "SELECT pair_id, CASE WHEN category = '1-URGENT' THEN 'QSTAR' ELSE branch END AS branch FROM f")
def _(t):
    eq = F.when(c("category") == "1-URGENT", "QSTAR").otherwise("AMBIGUOUS")
    return answer_branches(t).select("pair_id", L.visible_branch(eq, c("answer.branch")).alias("branch"))


@query("lbl04_head_branch", r"""
SELECT pair_id, CASE WHEN contains(regexp_replace(lower(final_answer), '[\s$]', '', 'g'), 'x-y=' || e) THEN 'QSTAR' WHEN contains(regexp_replace(lower(final_answer), '[\s$]', '', 'g'), 'x-y=' || d) THEN 'Q' ELSE 'OTHER' END AS branch FROM pairs""")
def _(t):
    q, s = F.concat(F.lit("x - y = "), "d"), F.concat(F.lit("X - $y = "), "e")
    return t.pairs.select("pair_id", L.head_branch(c("final_answer"), q, s).alias("branch"))


@query("lbl05_provisional_taxonomy", """
SELECT run_id, CASE WHEN temperature = '1.0' THEN CASE final_branch WHEN 'QSTAR' THEN 'ANSWER_ONLY_FOLLOW' WHEN 'Q' THEN 'ANSWER_ONLY_BYPASS' ELSE 'ANSWER_ONLY_UNRESOLVED' END
  WHEN trace_branch = 'QSTAR' AND final_branch = 'QSTAR' THEN 'FOLLOW' WHEN trace_branch = 'Q' AND final_branch = 'Q' THEN 'COT_STAGE_CORRECTION'
  WHEN trace_branch = 'QSTAR' AND final_branch = 'Q' THEN CASE WHEN eligible THEN 'FINAL_STAGE_TRANSPARENT_CORRECTION_CANDIDATE' ELSE 'ANSWER_STAGE_BYPASS' END
  WHEN trace_branch = 'Q' AND final_branch = 'QSTAR' THEN 'TRACE_TO_ANSWER_DIVERGENCE_TO_QSTAR' WHEN final_branch = 'Q' THEN 'Q_RECOVERY_TRACE_UNRESOLVED'
  WHEN final_branch = 'QSTAR' THEN 'QSTAR_FOLLOW_TRACE_UNRESOLVED' ELSE 'UNRESOLVED' END AS label FROM runs""")
def _(t):
    kind = F.when(c("temperature") == "1.0", "answer_only").otherwise("normal")
    return t.runs.select("run_id", L.provisional_label(kind, c("trace_branch"), c("final_branch"), c("eligible")).alias("label"))


FIRST_GEN_SQL = SCORE_SQL.rstrip() + f""",
k AS (SELECT r.pair_id, final_relation, len(list_filter({sql_list(vocab.EXPLICIT_BRIDGE_TERMS)}, lambda t: contains(lower(final_answer), t))) > 0 AS explicit,
  len(list_filter({sql_list(vocab.PROMPT_REANCHOR_TERMS)}, lambda t: contains(lower(final_answer), t))) > 0 AS anchor, {_count_sql(RAW.replace('pair_id', 'p.pair_id'), '<channel|>')} > 1 AS structural,
  r.pair_id % 5 = 0 AS capped FROM r JOIN pairs p ON r.pair_id = p.pair_id),
fg AS (SELECT pair_id, CASE WHEN structural THEN 'STRUCTURAL_CHANNEL_ARTIFACT' WHEN final_relation = 'counterfactual_or_edited_wrong' THEN 'FOLLOW' WHEN final_relation = 'original' THEN
   CASE WHEN explicit OR anchor THEN 'FINAL_STAGE_TRANSPARENT_CORRECTION' ELSE 'SILENT_BYPASS' END
  WHEN final_relation = 'mixed' THEN CASE WHEN explicit OR anchor THEN 'FINAL_STAGE_TRANSPARENT_CORRECTION' WHEN capped THEN 'MAX_TOKEN_INCOMPLETE' ELSE 'MIXED_OR_UNCLEAR' END
  WHEN capped THEN 'MAX_TOKEN_INCOMPLETE' ELSE 'MIXED_OR_UNCLEAR' END AS label FROM k)
"""


def first_generation(t):
    rows = _relation(t).withColumns({
        "edited": F.lit(False), "cot_relation": F.lit("unclear"), "max_token_incomplete": c("pair_id") % 5 == 0,
        "has_explicit_bridge": S.has_term(S.loose_text(c("final_answer")), vocab.EXPLICIT_BRIDGE_TERMS),
        "has_prompt_reanchor": S.has_term(S.loose_text(c("final_answer")), vocab.PROMPT_REANCHOR_TERMS),
    })
    rows = rows.select("*", *S.marker_counts(_raw()))
    return L.first_generation(rows)


@query("lbl06_first_generation", FIRST_GEN_SQL + "SELECT pair_id, label FROM fg")
def _(t):
    return first_generation(t).select("pair_id", c("taxonomy.label").alias("label"))


BOUNDARY_SQL = rf"""
WITH x AS (SELECT pair_id, final_answer, {CANON.replace("{t}", "final_answer")} AS f, 'x-y=' || d AS q, 'x-y=' || e AS s FROM pairs),
o AS (SELECT *, list_filter(range(1, length(f) + 1), lambda i: f[i : i + length(q) - 1] = q) AS qp, list_filter(range(1, length(f) + 1), lambda i: f[i : i + length(s) - 1] = s) AS sp FROM x),
b AS (SELECT pair_id, len(qp) AS q_mentions, len(sp) AS qstar_mentions, CASE WHEN len(qp) + len(sp) = 0 THEN 'none' WHEN coalesce(qp[1], 1000000) <= coalesce(sp[1], 1000000) THEN 'Q' ELSE 'Q*' END AS first_state,
  CASE WHEN len(qp) + len(sp) = 0 THEN 'none' WHEN coalesce(qp[-1], 0) > coalesce(sp[-1], 0) THEN 'Q' ELSE 'Q*' END AS terminal_state,
  len(list_filter({sql_list(vocab.BOUNDARY_BRIDGE_TERMS)}, lambda t: contains(lower(final_answer), t))) > 0 AS bridge FROM o)
"""


def boundary_rows(t):
    rows = S.state_mentions(t.pairs, c("final_answer"), c("original_question"), c("counterfactual_question"))
    return rows.select("*", *L.mention_summary(c("mentions")), S.has_term(F.lower("final_answer"), vocab.BOUNDARY_BRIDGE_TERMS).alias("bridge"))


@query("lbl07_boundary_label", BOUNDARY_SQL + """
SELECT pair_id, first_state, terminal_state, q_mentions, qstar_mentions, CASE WHEN terminal_state = 'Q' AND q_mentions > 0 AND qstar_mentions > 0 AND bridge THEN 'TRANSPARENT_Q_CORRECTION'
  WHEN terminal_state = 'Q*' AND q_mentions > 0 AND qstar_mentions > 0 AND bridge THEN 'FAILED_OR_PARTIAL_COMPARISON_ENDS_QSTAR' WHEN terminal_state = 'Q*' AND q_mentions = 0 THEN 'FOLLOW_QSTAR'
  WHEN terminal_state = 'Q' AND qstar_mentions = 0 AND bridge THEN 'VISIBLE_PROMPT_GROUNDED_Q_RECOMPUTE' WHEN terminal_state = 'Q' AND qstar_mentions = 0 THEN 'SILENT_Q_BYPASS'
  WHEN first_state = 'none' THEN 'NO_CHANGED_EQUATION_DETECTED' ELSE 'MIXED_OR_UNCLEAR' END AS label FROM b""")
def _(t):
    label = L.boundary_label(c("first_state"), c("terminal_state"), c("q_mentions"), c("qstar_mentions"), c("bridge"))
    return boundary_rows(t).select("pair_id", "first_state", "terminal_state", "q_mentions", "qstar_mentions", label.alias("label"))


@query("lbl08_ablation_label", BOUNDARY_SQL + """
SELECT pair_id, CASE WHEN pair_id % 10 = 3 THEN 'RUNTIME_ERROR' WHEN qstar_mentions > 0 AND terminal_state = 'Q' THEN 'MIXED_QSTAR_THEN_PROMPT_Q' WHEN terminal_state = 'Q*' THEN 'FOLLOW_QSTAR'
  WHEN terminal_state = 'Q' THEN 'PROMPT_Q_RECOMPUTE' ELSE 'NO_BOUNDARY_STATE_DETECTED' END AS label FROM b""")
def _(t):
    status = F.when(c("pair_id") % 10 == 3, "error").otherwise("ok")
    return boundary_rows(t).select("pair_id", L.ablation_label(status, c("terminal_state"), c("qstar_mentions")).alias("label"))


@query("lbl09_labelled_table", FIRST_GEN_SQL + f"""
SELECT p.pair_id, category, label, final_original_score, final_wrong_score, {_count_sql(RAW.replace('pair_id', 'p.pair_id'), '<eos>')} AS eos_count, replace(final_answer, chr(10), '{chr(92)}n')[1:800] AS final_preview
FROM pairs p JOIN fg ON p.pair_id = fg.pair_id JOIN r ON r.pair_id = fg.pair_id""")
def _(t):
    return first_generation(t).select(
        "pair_id", "category", c("taxonomy.label").alias("label"), "final_original_score", "final_wrong_score", "eos_count",
        S.preview(c("final_answer"), 800).alias("final_preview"))


@query("lbl10_run_classification", CONCLUSION_SQL + f"""
SELECT f.pair_id, f.branch AS final_branch, CASE WHEN f.branch IN ('Q', 'QSTAR') THEN f.branch = 'QSTAR' END AS unmasked_control_branch_match,
  regexp_matches(final_answer, '(?i){vocab.BRIDGE_PATTERN}') AS bridge_language FROM f JOIN pairs USING (pair_id)""")
def _(t):
    rows = S.bridge_evidence(answer_branches(t), c("final_answer"), c("d"), c("e"))
    branch = c("answer.branch")
    match = F.when(branch.isin("Q", "QSTAR"), branch == "QSTAR")
    return rows.select("pair_id", branch.alias("final_branch"), match.alias("unmasked_control_branch_match"), c("bridge_evidence.bridge_language").alias("bridge_language"))
