"""Text operations as column expressions.

Multi-step operations take and return a DataFrame: every step is a column of
its own, so a later step refers to it instead of evaluating it again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runsift.functions import rationals as R
from runsift.functions import vocab

INF = 2147483647
MARK = "\u0001"


def text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def strip(c: Column) -> Column:
    """Drops white space of every kind at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def rstrip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\s+$", "")


def lines(c: Column) -> Column:
    """Lines at every line break character; a trailing empty line does not count."""
    brk = r"(?:\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029])"
    return F.when(c == "", F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace(c, brk + r"\z", ""), brk, -1))


def count_of(c: Column, term: str) -> Column:
    """Non-overlapping occurrences of a fixed term."""
    return ((F.length(c) - F.length(F.replace(c, F.lit(term), F.lit("")))) / len(term)).cast("int")


def rfind(haystack: Column, needle: Column) -> Column:
    """0-based last position of a text, -1 when absent."""
    at = F.position(F.reverse(needle), F.reverse(haystack))
    return F.when(at == 0, F.lit(-1)).otherwise(F.length(haystack) - F.length(needle) - at + 1)


def match_spans(c: Column, pattern: str) -> Column:
    """All matches with their 0-based start: array<struct<pos:int, match:string>>.

    Matches are fenced with a mark, the text is split at it, and piece lengths
    give the positions: one regex pass and one fold.
    """
    clean = F.translate(c, MARK, "\u0002")
    pieces = F.split(F.regexp_replace(clean, f"({pattern})", f"{MARK}$1{MARK}"), MARK, -1)
    start = F.struct(
        F.lit(0).alias("pos"), F.lit(False).alias("inside"),
        F.array().cast("array<struct<pos:int,match:string>>").alias("found"))
    step = lambda s, p: F.struct(
        (s["pos"] + F.length(p)).alias("pos"), (~s["inside"]).alias("inside"),
        F.when(s["inside"], F.concat(s["found"], F.array(F.struct(s["pos"].alias("pos"), p.alias("match"))))).otherwise(s["found"]).alias("found"))
    return F.aggregate(pieces, start, step, lambda s: s["found"])


# ---- mathematical text -------------------------------------------------------------

def normalise_math(c: Column) -> Column:
    """Plain dashes, a/b fractions, '*' products; no \\left, \\right, '$', '**' or thousands commas."""
    v = F.translate(c, "\u2212\u2013\u2014", "---")
    v = F.regexp_replace(v, r"\\(?:d?frac)\s*\{\s*([-+]?\d+)\s*\}\s*\{\s*(\d+)\s*\}", "$1/$2")
    for old, new in (("\\times", "*"), ("\\cdot", "*"), ("\\left", ""), ("\\right", ""), ("$", ""), ("**", "")):
        v = F.replace(v, F.lit(old), F.lit(new))
    return F.regexp_replace(v, r"(?U)(?<=\d),(?=\d{3}\b)", "")


def compact_equation(c: Column) -> Column:
    return F.regexp_replace(F.lower(normalise_math(c)), r"(?U)[{}\\\s]", "")


def canonical_equation(c: Column, macros: Sequence[str] = vocab.MATH_MACROS) -> Column:
    """Equation text without macros, brackets and blanks, signs folded, unit coefficients dropped."""
    v = F.regexp_replace(c, r"(?U)\\frac\s*\{\s*([^{}]+?)\s*\}\s*\{\s*([^{}]+?)\s*\}", "$1/$2")
    v = F.translate(F.lower(v), "\u2212\u2013", "--")
    for m in macros:
        v = F.replace(v, F.lit(m), F.lit(""))
    v = F.regexp_replace(v, r"(?U)[$`*{}\[\]()\\\s]", "")
    v = F.regexp_replace(v, r"\++-", "-")
    v = F.regexp_replace(v, "--", "+")
    return F.regexp_replace(v, r"(?<![0-9])1([xyz])", "$1")


def pretty_equation(c: Column) -> Column:
    """Readable form: 1x -> x, '+ -' -> '- ', blanks folded."""
    v = F.regexp_replace(c, r"(?U)\b1([a-z])\b", "$1")
    v = F.regexp_replace(v, r"\+-", "-")
    v = F.regexp_replace(v, r"(?U)\+\s*-", "- ")
    v = F.regexp_replace(v, r"(?U)-1([a-z])\b", "- $1")
    v = F.regexp_replace(v, r"(?U)\+\s*1([a-z])\b", "+ $1")
    v = F.trim(F.regexp_replace(v, r"(?U)\s+", " "))
    return F.replace(v, F.lit("+ -"), F.lit("- "))


def tidy_equation(c: Column) -> Column:
    """The source-ablation form: blanks kept, signs and unit coefficients tidied."""
    v = F.replace(strip(c), F.lit("+ -"), F.lit("- "))
    v = F.regexp_replace(v, r"(?U)\b1([xyz])\b", "$1")
    for var in "xyz":
        v = F.replace(v, F.lit(f" -1{var}"), F.lit(f" - {var}"))
    for var in "xyz":
        v = F.replace(v, F.lit(f"+ 1{var}"), F.lit(f"+ {var}"))
    for var in "xyz":
        v = F.replace(v, F.lit(f"-1{var}"), F.lit(f"-{var}"))
    return v


def equation_key(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, r"(?U)[\s$]", ""))


def loose_text(c: Column) -> Column:
    """Lower-case text for term search.  Only an escaped frac, escaped macros and a
    backslash followed by s are rewritten; blanks are not folded."""
    v = F.replace(text(c), F.lit("\\\\frac"), F.lit(" frac"))
    v = F.regexp_replace(v, r"\$+", " ")
    v = F.regexp_replace(v, r"\\\\[a-zA-Z]+", " ")
    v = F.translate(v, "{}\u2212\u2013", "  --")
    v = F.regexp_replace(v, r"\\s+", " ")
    return F.lower(strip(v))


def packet_text(c: Column) -> Column:
    """The packet variant: double backslashes halved and blanks folded."""
    v = F.replace(F.lower(text(c)), F.lit("\\\\"), F.lit("\\"))
    return F.regexp_replace(v, r"(?U)\s+", " ")


def _number_tokens(c: Column) -> Column:
    return F.regexp_extract_all(normalise_math(c), F.lit(rf"((?<![A-Za-z0-9_]){R.NUMBER}(?![A-Za-z0-9_]))"), 1)


def numbers(c: Column) -> Column:
    """Exact values of all free-standing numbers of a text."""
    return F.filter(R.parse_all(_number_tokens(c)), lambda v: v.isNotNull())


LATEX_FRACTION = r"\\frac\s*\{\s*(-?\d+)\s*\}\s*\{\s*(-?\d+)\s*\}"


def plain_fractions(c: Column) -> Column:
    return F.regexp_replace(c, LATEX_FRACTION, "$1/$2")


def audit_numbers(c: Column) -> Column:
    """The audit variant: LaTeX fractions first, then plain tokens not next to word, '/', '.' or '-'."""
    t = text(c)
    whole = F.regexp_extract_all(t, F.lit(f"({LATEX_FRACTION})"), 1)
    frac = F.transform(whole, lambda m: F.regexp_replace(m, LATEX_FRACTION, "$1/$2"))
    token = r"((?<![\w/.-])-?\d+(?:\.\d+)?(?:\s*/\s*-?\d+)?(?![\w/.-]))"
    plain = F.regexp_extract_all(plain_fractions(t), F.lit(token), 1)
    return F.filter(R.parse_all(F.concat(frac, plain)), lambda v: v.isNotNull())


def assignments(c: Column, variables: Sequence[str] = ("x", "y", "z")) -> Column:
    """Struct of the last parseable value assigned to each variable."""
    plain = plain_fractions(text(c))
    fields = []
    for var in variables:
        found = F.regexp_extract_all(plain, F.lit(rf"(?iU)\b{var}\s*=\s*(-?\d+(?:\.\d+)?(?:\s*/\s*-?\d+)?)"), 1)
        values = F.filter(R.parse_all(found), lambda v: v.isNotNull())
        fields.append(F.try_element_at(values, F.lit(-1)).alias(var))
    return F.struct(*fields)


def tuple_candidate(c: Column, length: int) -> Column:
    """Values of the last innermost (...) or [...] that holds exactly ``length`` numbers."""
    inner = F.regexp_extract_all(normalise_math(c), F.lit(r"[(\[]([^()\[\]]+)[)\]]"), 1)
    inside = lambda x: F.filter(F.transform(_number_tokens(x), R.parse), lambda v: v.isNotNull())
    fit = F.filter(F.transform(inner, inside), lambda v: F.size(v) == length)
    return F.try_element_at(fit, F.lit(-1))


def _first_of_each(c: Column, variables: Sequence[str]) -> Column:
    """First parseable assignment of each variable as an array, null when one is absent."""
    first = []
    for var in variables:
        found = F.regexp_extract_all(c, F.lit(rf"(?iU)\b{var}\s*=\s*({R.NUMBER})"), 1)
        first.append(F.try_element_at(F.filter(F.transform(found, R.parse), lambda v: v.isNotNull()), F.lit(1)))
    return F.array(*first)


def closest_assignment(df: DataFrame, c: Column, variables: Sequence[str], name: str) -> DataFrame:
    """Adds the assignments of all variables that lie closest together (the latest on a tie).

    For every assignment taken as the last of its bundle, the nearest earlier
    one of each other variable gives the smallest span, so no product of all
    matches is built.  Between the two ends the earliest value of the remaining
    variable counts.
    """
    var = "|".join(variables)
    spans = match_spans(c, rf"(?iU)\b(?:{var})\s*=\s*{R.NUMBER}")
    parsed = F.transform(spans, lambda m: F.struct(
        m["pos"].alias("pos"), F.lower(F.substring(m["match"], 1, 1)).alias("var"),
        R.parse(F.regexp_replace(m["match"], r"(?U)^.\s*=\s*", "")).alias("value")))
    out = df.withColumn("__m", F.filter(parsed, lambda m: m["value"].isNotNull()))
    m = F.col("__m")

    def last_before(end: Column, v: str) -> Column:
        return F.try_element_at(F.filter(m, lambda e: (e["var"] == v) & (e["pos"] <= end)), F.lit(-1))["pos"]

    nearest = lambda e: F.array(*[last_before(e["pos"], v) for v in variables])
    ends = F.transform(m, lambda e: F.struct(
        F.array_min(nearest(e)).alias("lo"), e["pos"].alias("hi"),
        F.forall(nearest(e), lambda p: p.isNotNull()).alias("full")))
    keys = F.transform(F.filter(ends, lambda e: e["full"]), lambda e: F.struct((e["hi"] - e["lo"]).alias("span"), (-e["hi"]).alias("neg"), e["lo"].alias("lo")))
    out = out.withColumn("__best", F.array_min(keys))
    lo, hi = F.col("__best.lo"), -F.col("__best.neg")
    pick = lambda v: F.try_element_at(F.filter(m, lambda e: (e["var"] == v) & (e["pos"] >= lo) & (e["pos"] <= hi)), F.lit(1))["value"]
    out = out.withColumn(name, F.when(F.col("__best").isNotNull(), F.array(*[pick(v) for v in variables])))
    return out.drop("__m", "__best")


def extract_conclusion(df: DataFrame, c: Column, variables: Sequence[str], length: int, name: str = "conclusion") -> DataFrame:
    """Adds struct(values, method, confidence) of the final answer of a text.

    Cascade: assignments after the last usable cue, last tuple, closest
    assignments; for one value the last labelled number, then the last number
    of the final 1200 characters.  A step gets a null text, and so costs
    nothing, once an earlier one has an answer.
    """
    out = df.withColumn("__clean", normalise_math(c))
    clean = F.col("__clean")
    result = lambda v, method, conf: F.when(v.isNotNull(), F.struct(
        v.alias("values"), F.lit(method).alias("method"), F.lit(conf).alias("confidence")))
    nothing = lambda method: F.struct(
        F.lit(None).cast(f"array<{R.RATIONAL_TYPE}>").alias("values"), F.lit(method).alias("method"), F.lit("none").alias("confidence"))
    steps = []
    labelled = bool(variables) and len(variables) == length
    if labelled:
        windows = F.regexp_extract_all(clean, F.lit(rf"(?isU)(?=(?:{vocab.CONCLUSION_CUES})(.{{0,320}}))"), 1)
        usable = F.filter(F.transform(F.reverse(windows), lambda w: _first_of_each(w, variables)), lambda v: F.forall(v, lambda x: x.isNotNull()))
        out = out.withColumn("__s1", F.try_element_at(usable, F.lit(1)))
        steps.append(result(F.col("__s1"), "labelled_variable_assignments", "high"))
    open_case = F.col("__s1").isNull() if labelled else F.lit(True)
    if length > 1:
        out = out.withColumn("__s2", F.when(open_case, tuple_candidate(c, length)))
        steps.append(result(F.col("__s2"), "last_ordered_tuple", "medium"))
        if labelled:
            out = closest_assignment(out, F.when(open_case & F.col("__s2").isNull(), clean), variables, "__s3")
            steps.append(result(F.col("__s3"), "coherent_variable_assignments", "medium"))
        steps.append(nothing("no_tuple_conclusion"))
    else:
        segments = F.regexp_extract_all(clean, F.lit(rf"(?iU)(?:{vocab.ANSWER_LABELS})\s*(?:is|:|=)?\s*([^\n]{{0,160}})"), 1)
        last = lambda values: F.when(F.size(values) > 0, F.slice(values, -1, 1))
        out = out.withColumn("__seg", F.try_element_at(segments, F.lit(-1)))
        out = out.withColumn("__s4", F.when(open_case, last(numbers(F.col("__seg")))))
        out = out.withColumn("__s5", F.when(open_case & F.col("__s4").isNull(), last(numbers(F.right(clean, F.lit(1200))))))
        steps.append(result(F.col("__s4"), "last_answer_label", "high"))
        steps.append(result(F.col("__s5"), "last_numeric_value", "medium"))
        steps.append(nothing("no_numeric_conclusion"))
    out = out.withColumn(name, F.coalesce(*steps))
    return out.drop("__clean", "__s1", "__s2", "__s3", "__s4", "__s5", "__seg")


# ---- questions and changed lines ---------------------------------------------------

def equation_lines(question: Column, skip: int = 0) -> Column:
    """Stripped lines with '='; ``skip`` leading lines are ignored."""
    all_lines = lines(question)
    used = F.slice(all_lines, skip + 1, 100_000_000) if skip else all_lines
    return F.transform(F.filter(used, lambda l: F.contains(l, F.lit("="))), strip)


def first_equation(question: Column) -> Column:
    """First line with '=', else the last non-blank line."""
    full = F.filter(F.transform(lines(question), strip), lambda l: l != "")
    eq = F.filter(full, lambda l: F.contains(l, F.lit("=")))
    return F.coalesce(F.try_element_at(eq, F.lit(1)), F.try_element_at(full, F.lit(-1)), strip(question))


def zip_shorter(a: Column, b: Column) -> Column:
    """array<struct<q, s, i>> over the shorter length; i is 0-based."""
    pairs = F.zip_with(a, b, lambda x, y: F.struct(x.alias("q"), y.alias("s")))
    both = F.filter(pairs, lambda p: p["q"].isNotNull() & p["s"].isNotNull())
    return F.transform(both, lambda p, i: F.struct(p["q"].alias("q"), p["s"].alias("s"), i.alias("i")))


def first_changed_line(q: Column, qstar: Column) -> Column:
    """struct(line_number, original, counterfactual) of the first differing line, else null."""
    diff = F.filter(zip_shorter(lines(text(q)), lines(text(qstar))), lambda p: p["q"] != p["s"])
    one = F.transform(F.slice(diff, 1, 1), lambda p: F.struct(
        (p["i"] + 1).alias("line_number"), p["q"].alias("original"), p["s"].alias("counterfactual")))
    return F.try_element_at(one, F.lit(1))


def changed_equation(q: Column, qstar: Column, skip: int = 1) -> Column:
    """struct(q, s, i) of the single differing equation, null unless there is exactly one."""
    diff = F.filter(zip_shorter(equation_lines(q, skip), equation_lines(qstar, skip)), lambda p: p["q"] != p["s"])
    return F.when(F.size(diff) == 1, F.try_element_at(diff, F.lit(1)))


def changed_equations(q: Column, qstar: Column, macros: Sequence[str] = vocab.MATH_MACROS) -> Column:
    """All equation pairs that differ after canonicalising, or all pairs when none does."""
    pairs = zip_shorter(equation_lines(q), equation_lines(qstar))
    diff = F.filter(pairs, lambda p: canonical_equation(p["q"], macros) != canonical_equation(p["s"], macros))
    return F.when(F.size(diff) > 0, diff).otherwise(pairs)


def occurrences(haystack: Column, needle: Column) -> Column:
    """0-based positions of a text, overlaps included."""
    n = F.length(haystack) - F.length(needle)
    spots = F.when(n >= 0, F.sequence(F.lit(0), n)).otherwise(F.array().cast("array<int>"))
    return F.filter(spots, lambda i: F.substring(haystack, i + 1, F.length(needle)) == needle)


def state_mentions(df: DataFrame, final: Column, q: Column, qstar: Column, name: str = "mentions",
                   macros: Sequence[str] = vocab.MATH_MACROS) -> DataFrame:
    """Adds the ordered mentions of the changed equations: array<struct<pos, state, pattern>>."""
    out = df.withColumns({
        "__f": canonical_equation(final, macros),
        "__pairs": F.transform(changed_equations(q, qstar, macros), lambda p: F.struct(
            canonical_equation(p["q"], macros).alias("q"), canonical_equation(p["s"], macros).alias("s"))),
    })
    f = F.col("__f")
    spot = lambda pat, state: F.transform(occurrences(f, pat), lambda i: F.struct(
        i.alias("pos"), F.lit(state).alias("state"), pat.alias("pattern")))
    both = F.flatten(F.transform("__pairs", lambda p: F.concat(spot(p["q"], "Q"), spot(p["s"], "Q*"))))
    return out.withColumn(name, F.array_sort(both)).drop("__f", "__pairs")


# ---- detectors ---------------------------------------------------------------------

def bridge_evidence(df: DataFrame, c: Column, original_value: Column, counterfactual_value: Column,
                    pattern: str = vocab.BRIDGE_PATTERN, name: str = "bridge_evidence") -> DataFrame:
    """Adds bridge language, its first 12 matches, and which changed values the text mentions."""
    out = df.withColumns({
        "__hits": F.regexp_extract_all(text(c), F.lit(f"(?iU)({pattern})"), 1),
        "__nums": F.transform(numbers(text(c)), R.to_text),
    })
    has = lambda v: F.array_contains(F.col("__nums"), v.cast("string"))
    out = out.withColumn(name, F.struct(
        (F.size("__hits") > 0).alias("bridge_language"), F.slice("__hits", 1, 12).alias("bridge_matches"),
        has(original_value).alias("mentions_original_changed_value"),
        has(counterfactual_value).alias("mentions_counterfactual_changed_value"),
        (has(original_value) & has(counterfactual_value)).alias("mentions_both_changed_values")))
    return out.drop("__hits", "__nums")


def has_term(c: Column, terms: Sequence[str]) -> Column:
    out = F.lit(False)
    for t in terms:
        out = out | F.contains(c, F.lit(t))
    return out


def matching_terms(c: Column, terms: Sequence[str]) -> Column:
    return F.filter(F.array(*map(F.lit, terms)), lambda t: F.contains(c, t))


def false_conflict(c: Column, claim: str = vocab.CONFLICT_CLAIM, denial: str = vocab.CONFLICT_DENIAL) -> Column:
    return c.rlike(f"(?iU)(?:{claim})") & ~c.rlike(f"(?iU)(?:{denial})")


def answer_mentions(c: Column, answer: Column) -> Column:
    """Every number of the answer occurs in the text once blanks are dropped; false without numbers."""
    squeezed = F.replace(packet_text(c), F.lit(" "), F.lit(""))
    parts = F.regexp_extract_all(text(answer), F.lit(r"(-?\d+\s*/\s*-?\d+|-?\d+(?:\.\d+)?)"), 1)
    hit = F.forall(parts, lambda p: F.contains(squeezed, F.replace(p, F.lit(" "), F.lit(""))))
    return (F.size(parts) > 0) & hit


def _quoted(c: Column) -> Column:
    return F.regexp_replace(c, r"([^A-Za-z0-9_])", r"\\$1")


def answer_score(df: DataFrame, c: Column, answer: Column, name: str) -> DataFrame:
    """Adds the evidence points a text gives to an answer.

    Tuples: 4 per matching assignment, or 4 per part for the written tuple.
    Single values: 6 for an equal number, else 3 per part for the exact text
    and 2 per part token.
    """
    return _scored(_evidence(df, c), answer, name).drop(*EVIDENCE)


EVIDENCE = ("__norm", "__asg", "__nums")


def _evidence(df: DataFrame, c: Column) -> DataFrame:
    """Adds what a text shows, whichever answer it is compared with."""
    return df.withColumns({"__norm": loose_text(c), "__asg": assignments(c), "__nums": audit_numbers(c)})


def _scored(df: DataFrame, answer: Column, name: str) -> DataFrame:
    parts = R.answer_parts(text(answer))
    out = df.withColumns({"__exact": loose_text(answer), "__parts": parts, "__vals": R.parse_all(parts)})
    # As R.answer_values: null as soon as one part does not parse.
    out = out.withColumn("__vals", F.when(F.forall("__vals", lambda v: v.isNotNull()), F.col("__vals")))
    norm, exact, parts, vals, asg = (F.col(f"__{k}") for k in ("norm", "exact", "parts", "vals", "asg"))
    matched = F.lit(0)
    for i, var in enumerate("xyz"):
        matched = matched + F.coalesce(R.equal(asg[var], F.get(vals, F.lit(i))), F.lit(False)).cast("int")
    any_asg = asg["x"].isNotNull() | asg["y"].isNotNull() | asg["z"].isNotNull()
    in_text = (exact != "") & F.contains(norm, exact)

    def token_hit(part: Column) -> Column:
        a, b = _quoted(F.trim(F.split_part(part, F.lit("/"), F.lit(1)))), _quoted(F.trim(F.regexp_replace(part, r"^[^/]*/", "")))
        # Slashed answers ask for literal backslashes around the slash.
        pattern = F.concat(F.lit(r"(?i)(?<![\\d-])(?:"), a, F.lit(r"\\s*/\\s*"), b, F.lit("|"), a, F.lit(r"\\s+over\\s+"), b, F.lit(r")(?!\d)"))
        plain = (part != "") & F.contains(norm, F.lower(part))
        return F.when(F.contains(part, F.lit("/")), F.regexp_like(norm, pattern)).otherwise(plain)

    tokens = F.size(F.filter(parts, token_hit))
    loose = F.when(in_text, 3 * F.size(parts)).otherwise(0) + 2 * tokens
    hit = R.contains(F.col("__nums"), F.try_element_at(vals, F.lit(1)))
    score = (
        F.when(vals.isNotNull() & (F.size(vals) > 1), F.when(any_asg, 4 * matched).when(in_text, 4 * F.size(vals)).otherwise(0))
        .when(vals.isNotNull() & (F.size(vals) == 1) & hit, 6).otherwise(loose)
    )
    return out.withColumn(name, score).drop("__exact", "__parts", "__vals")


def answer_relation(df: DataFrame, c: Column, original: Column, wrong: Column, prefix: str) -> DataFrame:
    """Adds ``<prefix>_relation`` and both scores over the last 2500 characters."""
    out = df.withColumn("__tail", F.right(text(c), F.lit(2500)))
    out = _evidence(out, F.col("__tail"))
    out = _scored(out, original, f"{prefix}_original_score")
    out = _scored(out, wrong, f"{prefix}_wrong_score").drop(*EVIDENCE)
    o, w = F.col(f"{prefix}_original_score"), F.col(f"{prefix}_wrong_score")
    relation = (
        F.when((o == 0) & (w == 0), "unclear").when(w > o, "counterfactual_or_edited_wrong")
        .when(o > w, "original").otherwise("mixed")
    )
    return out.withColumn(f"{prefix}_relation", relation).drop("__tail")


# ---- shape features ----------------------------------------------------------------

def text_features(c: Column, terms: dict[str, list[str]] = vocab.FEATURE_TERMS) -> list[Column]:
    t, low = text(c), F.lower(text(c))
    count = lambda s, p: F.regexp_count(s, F.lit(p))
    out = [
        F.length(t).alias("chars"), F.when(t == "", 0).otherwise(count_of(t, "\n") + 1).alias("lines"),
        count(low, r"equation|eq\.|\(\d+\)").alias("equation_refs"),
        count(t, r"[$=]|\\frac|\\times|\\implies").alias("math_lines"),
        count(t, r"\d+\s*/\s*\d+|\\frac").alias("fraction_mentions"), count(low, r"(?U)\bstep\b").alias("step_mentions"),
    ]
    for key, needles in terms.items():
        total = count_of(low, needles[0])
        for n in needles[1:]:
            total = total + count_of(low, n)
        out.append(total.alias(f"{key}_terms"))
    return out


def trace_features(c: Column) -> list[Column]:
    count = lambda p: F.regexp_count(c, F.lit(p))
    return [
        F.length(c).alias("cot_chars"), F.size(lines(c)).alias("cot_lines"), count_of(c, "/").alias("cot_fraction_slashes"),
        count(r"(?iU)verif|check").alias("cot_verify_mentions"), count(r"(?iU)question|prompt|problem").alias("cot_question_mentions"),
        count(r"(?iU)\bwait\b|re-?read|double.?check").alias("cot_wait_mentions"), F.right(c, F.lit(1200)).alias("cot_tail"),
    ]


def changed_values(q_line: Column, qstar_line: Column) -> Column:
    """Pairs of integer tokens that differ at the same place of two lines."""
    ints = lambda l: F.regexp_extract_all(text(l), F.lit(r"(-?\d+)"), 1)
    return F.filter(zip_shorter(ints(q_line), ints(qstar_line)), lambda p: p["q"] != p["s"])


def value_mentions(c: Column, value: Column) -> Column:
    """Mentions of a value not next to a digit or slash, blanks dropped."""
    squeezed = F.replace(text(c), F.lit(" "), F.lit(""))
    return F.regexp_count(squeezed, F.concat(F.lit(r"(?<![\d/])-?"), _quoted(value), F.lit(r"(?![\d/])")))


def first_move(head_of: Column, q_line: Column, qstar_line: Column) -> Column:
    """Which changed line, else which changed value, opens an answer (first 1200 characters; Q* first)."""
    head = F.substring(head_of, 1, 1200)
    fold = lambda s: F.replace(s, F.lit("+ -"), F.lit("-"))
    has_line = lambda l: F.coalesce((l != "") & F.contains(fold(head), fold(l)), F.lit(False))
    seen = lambda v: F.regexp_like(head, F.concat(F.lit(r"(?<!\d)"), _quoted(v), F.lit(r"(?!\d)")))
    by_value = F.filter(
        F.transform(changed_values(q_line, qstar_line), lambda p: F.when(seen(p["s"]), "mentions_Qstar_changed_value_early")
                    .when(seen(p["q"]), "mentions_Q_changed_value_early")), lambda x: x.isNotNull())
    return (
        F.when(has_line(qstar_line), "starts_with_Qstar_changed_line").when(has_line(q_line), "starts_with_Q_changed_line")
        .otherwise(F.coalesce(F.try_element_at(by_value, F.lit(1)), F.lit("unknown")))
    )


# ---- responses, markers, cuts ------------------------------------------------------

def clean_answer(c: Column) -> Column:
    v = F.regexp_replace(c, r"<turn\|>|<eos>|<bos>", "")
    return strip(F.regexp_replace(v, r"<\|/?[^>]+\|>|<[^>]+>", ""))


RESPONSE_PATTERNS = [
    r"(?s)<\|channel>thought\n(.*?)<channel\|>(.*?)(?:<turn\|>|<eos>|$)",
    r"(?s)<start_of_turn>thought\n(.*?)<end_of_turn>(.*?)(?:<end_of_turn>|<eos>|$)",
    r"(?s)<think>(.*?)</think>(.*?)(?:<eos>|$)",
]


def split_response(c: Column, patterns: Sequence[str] = RESPONSE_PATTERNS) -> Column:
    """struct(thought, answer): the first pattern that matches, else an empty thought."""
    out = F.struct(F.lit("").alias("thought"), clean_answer(c).alias("answer"))
    for p in reversed(patterns):
        hit = F.struct(strip(F.regexp_extract(c, p, 1)).alias("thought"), clean_answer(F.regexp_extract(c, p, 2)).alias("answer"))
        out = F.when(c.rlike(p), hit).otherwise(out)
    return out


def split_continuation(prefix: Column, continuation: Column, marker: str = vocab.ANSWER_OPEN) -> Column:
    """struct(trace, source, final): where the answer marker was seen and the text on both sides."""
    p, c = text(prefix), text(continuation)
    at = F.position(F.lit(marker), c)
    closed, seen = p.endswith(marker), at > 0
    return F.struct(
        F.when(closed, "").when(seen, F.substring(c, F.lit(1), at - 1)).otherwise(c).alias("generated_trace"),
        F.when(closed, "injected_prefix").when(seen, "generated_continuation").otherwise("not_seen").alias("marker_source"),
        F.when(closed, c).when(seen, F.substring(c, at + len(marker), F.lit(INF))).otherwise("").alias("final_raw"),
    )


def marker_counts(c: Column) -> list[Column]:
    t = text(c)
    names = {"thought_start_count": vocab.THOUGHT_OPEN, "answer_channel_count": vocab.ANSWER_OPEN,
             "turn_count": vocab.TURN_END, "eos_count": vocab.EOS}
    return [count_of(t, m).alias(n) for n, m in names.items()]


def trim_middle(c: Column, limit: int = 6000, notice: str = vocab.PACKET_CUT_NOTICE) -> Column:
    """Head and tail of a long text with a notice between them (a display column only)."""
    t, half = text(c), limit // 2
    cut = F.concat(F.substring(t, 1, half), F.lit(notice), F.right(t, F.lit(half)))
    return F.when(F.length(t) <= limit, t).otherwise(cut)


def preview(c: Column, n: int = 500) -> Column:
    t = F.replace(text(c), F.lit("\n"), F.lit("\\n"))
    return F.concat(F.substring(t, 1, n), F.when(F.length(t) > n, "...").otherwise(""))


def folded_preview(c: Column, n: int = 240) -> Column:
    return F.substring(strip(F.regexp_replace(c, r"(?U)\s+", " ")), 1, n)


def cut_at_boundary(df: DataFrame, c: Column, ratio: Column | float, name: str = "cut_text") -> DataFrame:
    """Adds the prefix that ends at the text boundary nearest to ratio x length.

    Boundaries are paragraph, sentence, ')' and ':' ends and newlines, searched
    within 12 points of the ratio first; the smaller position wins a tie.
    """
    ratio = F.lit(ratio) if isinstance(ratio, float) else ratio
    out = df.withColumn("__t", strip(text(c)))
    t = F.col("__t")
    out = out.withColumn("__n", F.length(t))
    n = F.col("__n")
    ends = lambda p: F.transform(match_spans(t, p), lambda m: m["pos"] + F.length(m["match"]))
    out = out.withColumns({
        "__target": F.greatest(F.lit(1), F.least(n, F.floor(n * ratio).cast("int"))),
        "__ends": F.array_union(ends(r"(?U)\n\s*\n|(?<=[.!?])\s+|(?<=\))\s+|(?<=:)\s+"), ends(r"\n")),
        "__lo": F.floor(n * F.greatest(F.lit(0.05), ratio - 0.12)), "__hi": F.floor(n * F.least(F.lit(0.98), ratio + 0.12)),
    })
    target = F.col("__target")
    near = F.filter("__ends", lambda p: (p >= F.col("__lo")) & (p <= F.col("__hi")))
    nearest = lambda a: F.array_min(F.transform(a, lambda p: F.struct(F.abs(p - target).alias("d"), p.alias("p"))))["p"]
    out = out.withColumn("__near", near)
    cut = F.coalesce(nearest(F.col("__near")), nearest(F.col("__ends")), target)
    out = out.withColumn(name, rstrip(F.substring(t, F.lit(1), cut)))
    return out.drop("__t", "__n", "__target", "__ends", "__lo", "__hi", "__near")


def cut_before_closing(c: Column, headings: Sequence[str] = vocab.CLOSING_HEADINGS) -> Column:
    """Text before the earliest closing heading plus a stop sentence; a closing sentence when there is none."""
    at = [F.nullif(F.regexp_instr(c, F.lit(f"(?iU){h}")), F.lit(0)) for h in headings]
    first = F.least(*at)
    cut = F.concat(rstrip(F.substring(c, F.lit(1), first - 1)), F.lit(vocab.CLOSED_AT_HEADING))
    return F.when(first.isNull(), F.concat(c, F.lit(vocab.CLOSED_WITHOUT_HEADING))).otherwise(cut)


def ensure_thought(c: Column, close: Column | bool = False) -> Column:
    """Thought text behind the open marker, closed by the answer marker when asked for."""
    close = F.lit(close) if isinstance(close, bool) else close
    t = strip(text(c))
    raw = F.when(t.startswith(vocab.THOUGHT_OPEN), t).otherwise(F.concat(F.lit(vocab.THOUGHT_OPEN + "\n"), t))
    return F.when(close, ensure_answer_channel(raw)).otherwise(raw)


def strip_answer_channel(c: Column) -> Column:
    return F.substring_index(c, vocab.ANSWER_OPEN, 1)


def ensure_answer_channel(c: Column) -> Column:
    return F.when(c.endswith(vocab.ANSWER_OPEN), c).otherwise(F.concat(rstrip(c), F.lit(vocab.ANSWER_OPEN)))


def suffix_variant(prefix: Column, variant: Column, q: Column, qstar: Column) -> Column:
    """The eight trace variants of a prefix, chosen by the variant column."""
    thought = strip_answer_channel(prefix)
    out = F.when(variant == "original", prefix)
    trimmed = thought
    for p in reversed(vocab.CLOSURE_CUTS):
        pattern = f"(?is){p}"
        trimmed = F.when(thought.rlike(pattern), F.regexp_replace(thought, pattern, "")).otherwise(trimmed)
    out = out.when(variant == "truncate_before_closure", ensure_answer_channel(trimmed))
    for name, sentence in vocab.SUFFIX_SENTENCES.items():
        out = out.when(variant == name, ensure_answer_channel(F.concat(rstrip(thought), F.lit(sentence))))
    for name, label in vocab.RECAP_LABELS.items():
        eqs = equation_lines(qstar if "qstar" in name else q)
        recap = F.array_join(F.transform(eqs, lambda l, i: F.concat(F.lit("    ("), (i + 1).cast("string"), F.lit(") $"), l, F.lit("$"))), "\n")
        body = F.concat(rstrip(thought), F.lit(vocab.RECAP_OPEN + label + ":\n"), recap, F.lit(vocab.RECAP_CLOSE))
        out = out.when(variant == name, ensure_answer_channel(body))
    return out.otherwise(F.raise_error(F.concat(F.lit("unknown variant: "), variant)).cast("string"))


def last_label(c: Column, labels: Sequence[str], missing: str = "UNPARSEABLE") -> Column:
    found = F.regexp_extract_all(F.upper(c), F.lit(f"({'|'.join(labels)})"), 1)
    return F.coalesce(F.try_element_at(found, F.lit(-1)), F.lit(missing))


def clean_token(c: Column) -> Column:
    v = strip(F.replace(F.replace(c, F.lit("\u2581"), F.lit(" ")), F.lit("\\n"), F.lit(" ")))
    return strip(F.replace(F.replace(v, F.lit("<bos>"), F.lit("")), F.lit("<eos>"), F.lit("")))


def readable_token(c: Column) -> Column:
    """Short operators, numbers and mostly-ASCII words without inner capitals."""
    s = strip(c)
    blocked = (c == "") | (F.length(c) > 28) | c.rlike("[<>\ufffd]") | (s == "")
    operator = s.rlike(r"^[-+*/=().,:;$]+$")
    punctuation = F.contains(F.lit("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"), s)
    number = s.rlike(r"^\d+([./]\d+)?$")
    ascii_ratio = F.length(F.regexp_replace(s, r"[^\x00-\x7f]", "")) / F.greatest(F.length(s), F.lit(1))
    word = (ascii_ratio >= 0.85) & s.rlike("[A-Za-z0-9]") & ~s.rlike("[a-z][A-Z][a-z]")
    return F.when(blocked, False).when(operator, True).when(punctuation, False).when(number, True).otherwise(word)


def keyword_hits(words: Column, keywords: Sequence[str]) -> Column:
    """Words whose lower-cased, punctuation-stripped form is a keyword."""
    bare = lambda w: F.regexp_replace(F.lower(w), r"^[ .,:;!?()\[\]{}]+|[ .,:;!?()\[\]{}]+$", "")
    return F.filter(words, lambda w: F.array_contains(F.array(*map(F.lit, keywords)), bare(w)))


def safe_name(c: Column) -> Column:
    return F.translate(F.replace(c, F.lit("::"), F.lit("__")), "/\\", "__")


def safe_case_name(c: Column) -> Column:
    """The case variant: every run of other characters becomes one double underscore."""
    return F.regexp_replace(c, r"[^A-Za-z0-9_.-]+", "__")


def visible_escape(c: Column) -> Column:
    """Backslash escapes for backslash, newline, return, tab and every other non-printing or non-ASCII character."""
    def one(ch: Column) -> Column:
        code = F.conv(F.hex(F.encode(ch, "UTF-32")), 16, 10).cast("bigint")
        hexed = F.lower(F.hex(code))
        return (
            F.when(ch == "\\", "\\\\").when(ch == "\n", "\\n").when(ch == "\r", "\\r").when(ch == "\t", "\\t")
            .when((code >= 32) & (code < 127), ch)
            .when(code < 256, F.concat(F.lit("\\x"), F.lpad(hexed, 2, "0")))
            .when(code < 65536, F.concat(F.lit("\\u"), F.lpad(hexed, 4, "0")))
            .otherwise(F.concat(F.lit("\\U"), F.lpad(hexed, 8, "0"))))
    return F.array_join(F.transform(F.filter(F.split(c, ""), lambda ch: ch != ""), one), "")
