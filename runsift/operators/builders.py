"""Dataset, request-plan and review-table builders."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runsift.functions import rationals as R
from runsift.functions import strings as S
from runsift.functions import vocab
from runsift.operators import joins as J


def expand_variants(df: DataFrame, variants: Sequence[dict]) -> DataFrame:
    """Every row x every variant; the variant's fields become columns (a narrow explode)."""
    rows = F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in one.items()]) for one in variants])
    return df.withColumn("__v", F.explode(rows)).select(*df.columns, "__v.*")


def fill(template: str, **values: Column) -> Column:
    """A fixed template with {name} placeholders filled from columns."""
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), value)
    return out


def prompt_rows(items: DataFrame, item: str, roles: str, questions: dict[str, Column]) -> DataFrame:
    """One prompt per item and role in the item's role list."""
    rows = items.withColumn("prompt_role", F.explode(roles))
    q = F.lit(None).cast("string")
    for role, col in questions.items():
        q = F.when(F.col("prompt_role") == role, col).otherwise(q)
    return rows.withColumns({"prompt_id": F.concat_ws("::", item, "prompt_role"), "question": q})


def answer_only_question(question: Column, instruction: str = vocab.ANSWER_ONLY_INSTRUCTION) -> Column:
    return F.concat(S.rstrip(question), F.lit("\n\n" + instruction))


def _finish(rows: DataFrame, item: str, question: str, source: str) -> DataFrame:
    only = F.col("answer_format") == "answer_only"
    n = F.length("injected_thought")
    return rows.withColumns({
        "intervention_id": F.concat_ws("::", item, "intervention_type"),
        "question": F.when(only, answer_only_question(F.col(question))).otherwise(F.col(question)),
        "injected_raw_prefix": S.ensure_thought(F.col("injected_thought"), F.col("close")),
        "injected_char_count": n,
        "actual_char_ratio": F.bround(n / F.greatest(F.lit(1), F.length(source)), 4),
    })


def transfer_interventions(items: DataFrame, item: str, question: str, source: str,
                           conditions: Sequence[dict] = vocab.TRANSFER_CONDITIONS) -> DataFrame:
    """Item x depth condition with the trace cut at the text boundary nearest the ratio."""
    rows = expand_variants(items.withColumn("__src", S.strip(F.col(source))), conditions)
    rows = S.cut_at_boundary(rows, F.col("__src"), F.col("target_ratio"), "__cut")
    thought = F.when(F.col("target_ratio") < 1.0, F.col("__cut")).otherwise(F.col("__src"))
    return _finish(rows.withColumn("injected_thought", thought), item, question, source).drop("__cut", "__src")


def edited_tail(edit_type: Column, wrong: Column, marker: Column) -> Column:
    out = None
    for name in ("final_conclusion_corruption", "local_computation_corruption", "fake_verification", "method_step_corruption"):
        hit = fill(vocab.EDITED_TAILS[name], w=wrong)
        out = F.when(edit_type == name, hit) if out is None else out.when(edit_type == name, hit)
    ablation = edit_type == "confidence_marker_ablation"
    out = out.when(ablation & (marker == "uncertainty"), fill(vocab.EDITED_TAILS["uncertainty"], w=wrong))
    out = out.when(ablation, fill(vocab.EDITED_TAILS["confidence"], w=wrong))
    return out.otherwise(fill(vocab.EDITED_TAILS["other"], w=wrong))


def edited_interventions(items: DataFrame, item: str, number: Column, question: str, source: str, edit_type: str, answer: str,
                         answer_type: str, conditions: Sequence[dict] = vocab.EDITED_CONDITIONS) -> DataFrame:
    """Item x condition with a wrong conclusion appended to the item's own trace; the marker follows the id parity."""
    marker = F.when(F.col(edit_type) == "confidence_marker_ablation", F.when(number % 2 == 0, "uncertainty").otherwise("confidence"))
    rows = items.withColumns({
        "expected_wrong_answer": R.perturbed_answer(F.col(answer), F.col(answer_type)), "confidence_marker_variant": marker})
    tail = edited_tail(F.col(edit_type), F.col("expected_wrong_answer"), F.col("confidence_marker_variant"))
    rows = rows.withColumn("injected_thought", F.concat(S.rstrip(S.strip(F.col(source))), tail))
    return _finish(expand_variants(rows, conditions), item, question, source)


def probe_rows(items: DataFrame, item: str, q: str, qstar: str, source: str, priors: DataFrame | None = None,
               variants: Sequence[tuple] = vocab.PROBE_VARIANTS) -> DataFrame:
    """Item x probe variant: suffixed question or trace, prior labels joined where known.

    The labels join the items, so that an item moves once and not once a variant.
    """
    labels = [] if priors is None else [k for k in priors.columns if k != item]
    items = items if priors is None else items.join(priors, item, "left")
    fields = ("probe_variant", "probe_family", "__suffix", "__ask", "__only")
    rows = expand_variants(items, [dict(zip(fields, v)) for v in variants])
    ask, suffix = F.lit(""), F.lit("")
    for k, v in vocab.PROBE_QUESTIONS.items():
        ask = F.when(F.col("__ask") == k, v).otherwise(ask)
    for k, v in vocab.PROBE_SUFFIXES.items():
        suffix = F.when(F.col("__suffix") == k, fill(v, eq=S.first_equation(F.col(qstar)))).otherwise(suffix)
    rows = rows.withColumns({"__asked": ask, "__said": suffix})
    asked, said, only = F.col("__asked"), F.col("__said"), F.col("__only")
    question = (
        F.when(asked != "", F.concat(S.rstrip(F.col(q)), F.lit("\n\n"), asked)).when(only, answer_only_question(F.col(q)))
        .otherwise(F.col(q)))
    trace = S.strip(F.col(source))
    rows = rows.withColumns({
        "intervention_id": F.concat_ws("::", item, "probe_variant"), "question": question,
        "injected_thought": F.when(said != "", F.concat(S.rstrip(trace), F.lit("\n\n"), said)).otherwise(trace),
        "answer_format": F.when(only, "answer_only").otherwise("normal"), "max_new_tokens": F.when(only, 256).otherwise(2048)})
    rows = rows.withColumn("injected_raw_prefix", S.ensure_thought(F.col("injected_thought"), True))
    rows = rows.drop("__suffix", "__ask", "__only", "__asked", "__said")
    return rows.select(*[k for k in rows.columns if k not in labels], *labels)


def focused_subset(rows: DataFrame, item: str, items: DataFrame, variant: str, variants: Sequence[str]) -> DataFrame:
    """Rows of the chosen items and variants; compare its count with items x variants."""
    return rows.where(F.col(variant).isin(*variants)).join(items.select(item), item, "left_semi")


# ---- answer checks by substitution -------------------------------------------------

def _coefficient(term: Column) -> Column:
    digits = F.regexp_replace(term, r"[xyz\s]", "")
    return F.when(digits.isin("", "+"), F.lit("1")).when(digits == "-", F.lit("-1")).otherwise(R.whole(digits))


def _sides(equation: Column, variables: Sequence[str]) -> Column:
    """struct(equation, coefficients, rhs) of one equation, as integers of any length."""
    left = F.replace(F.split_part(equation, F.lit("="), F.lit(1)), F.lit("+ -"), F.lit("-"))
    right = F.trim(F.split_part(equation, F.lit("="), F.lit(2)))
    terms = F.regexp_extract_all(left, F.lit(r"([+-]?\s*\d*\s*[xyz])"), 1)

    def summed(ts: Column, variable: str) -> Column:
        mine = F.filter(ts, lambda t: t.endswith(variable))
        return F.aggregate(mine, F.lit("0"), lambda a, t: R.plus(a, R.let(t, _coefficient)))

    coefficients = R.let(terms, lambda ts: F.array(*[summed(ts, v) for v in variables]))
    rhs = F.when(right.rlike(r"^[-+]?\d+$"), R.whole(right))
    return F.struct(equation.alias("equation"), coefficients.alias("cs"), rhs.alias("rhs"))


def _result(e: Column, number: Column, side: Column, values: Column, variables: Sequence[str]) -> Column:
    """struct(equation_no, equation, status, check_line) of one equation and its left side."""
    named = F.zip_with(e["cs"], F.array(*map(F.lit, variables)), lambda k, v: F.struct(k.alias("k"), v.alias("v")))
    text = lambda n, value: F.when(n["k"] == "1", F.concat(n["v"], F.lit("="), value)).otherwise(
        F.concat(n["k"], n["v"], F.lit("="), n["k"], F.lit("("), value, F.lit(")")))
    parts = F.zip_with(named, values, lambda n, v: F.when(n["k"] != "0", text(n, R.to_text(v))))
    shown = F.array_join(F.filter(parts, lambda x: x.isNotNull()), ", ")
    ok = F.coalesce((side["num"] == e["rhs"]) & (side["den"] == "1"), F.lit(False))
    status = F.when(ok, "Correct").otherwise("Mismatch")
    line = F.concat(
        F.lit("    * Check ("), number.cast("string"), F.lit(") `"), e["equation"], F.lit("`: "), shown, F.lit("; left side = "),
        R.to_text(side), F.lit(" = "), e["rhs"], F.lit(". ("), status, F.lit(")"))
    return F.struct(number.alias("equation_no"), e["equation"].alias("equation"), status.alias("status"), line.alias("check_line"))


def with_checks(df: DataFrame, question: str, answer: str, variables: Sequence[str], name: str = "checks") -> DataFrame:
    """Adds one check struct per equation: the stored answer put in, both sides compared exactly, at any length.

    The check stays inside the row, so it is a narrow step.
    """
    struct = lambda n, d: F.struct(n.alias("num"), d.alias("den"))
    share = lambda k, v: struct(R.times(k, v["num"]), v["den"])
    added = lambda a, x: struct(R.plus(R.times(a["num"], x["den"]), R.times(x["num"], a["den"])), R.times(a["den"], x["den"]))
    total = lambda shares: F.aggregate(shares, struct(F.lit("0"), F.lit("1")), added)
    out = df.withColumns({
        "__vals": R.answer_values(F.col(answer)), "__lines": F.transform(S.equation_lines(F.col(question)), S.tidy_equation)})
    out = out.withColumn("__sides", F.transform("__lines", lambda line: _sides(line, variables)))
    # One step a column, because the analyzer resolves nested lambdas one level at a time.
    out = out.withColumn("__shares", F.transform("__sides", lambda e: F.zip_with(e["cs"], F.col("__vals"), share)))
    out = out.withColumn("__totals", F.transform("__shares", total))
    out = out.withColumn("__left", F.transform("__totals", lambda t: R.fraction(t["num"], t["den"])))
    checks = F.transform("__sides", lambda e, i: _result(e, i + 1, F.col("__left")[i], F.col("__vals"), variables))
    return out.withColumn(name, checks).drop("__vals", "__lines", "__sides", "__shares", "__totals", "__left")


def check_answers(df: DataFrame, row_id: str, question: str, answer: str, variables: Sequence[str]) -> DataFrame:
    """One row per equation with its number, text, status and readable check line."""
    # An inner explode would repeat the whole check in an inferred filter.
    rows = with_checks(df, question, answer, variables).select(row_id, F.explode_outer("checks").alias("__c"))
    return rows.where(F.col("__c").isNotNull()).select(row_id, "__c.*")


ABLATION_VARIANTS = [
    {"variant_id": "raw_full_qstar_cot_control", "family": "raw_control"},
    {"variant_id": "raw_truncated_before_closure", "family": "closure_ablation"},
    {"variant_id": "minimal_qstar_state", "family": "state_strength_ablation"},
    {"variant_id": "weak_summary_no_verification", "family": "state_strength_ablation"},
    {"variant_id": "strong_verified_qstar_state", "family": "state_strength_ablation"},
]


def source_ablation(items: DataFrame, item: str, qstar: str, qstar_answer: str, thought: str, variables: Sequence[str]) -> DataFrame:
    """Item x five trace variants: raw, truncated, minimal, weak and verified."""
    eqs = F.array_join(F.transform(S.equation_lines(F.col(qstar)), lambda l, i: F.concat(
        F.lit("    ("), (i + 1).cast("string"), F.lit(") `"), S.tidy_equation(l), F.lit("`"))), "\n")
    values = F.transform(R.answer_values(F.col(qstar_answer)), R.to_text)
    sol = F.array_join(F.zip_with(F.array(*map(F.lit, variables)), values, lambda v, x: F.concat(v, F.lit(" = "), x)), ", ")
    rows = with_checks(items, qstar, qstar_answer, variables, "__c").withColumns({
        "__eqs": eqs, "__sol": sol, "__checks": F.array_join(F.transform("__c", lambda x: x["check_line"]), "\n")})
    rows = expand_variants(rows, ABLATION_VARIANTS)
    kind, e, s = F.col("variant_id"), F.col("__eqs"), F.col("__sol")
    made = (
        F.when(kind == "raw_full_qstar_cot_control", F.col(thought))
        .when(kind == "raw_truncated_before_closure", S.cut_before_closing(F.col(thought)))
        .when(kind == "minimal_qstar_state", fill(vocab.MINIMAL_STATE, eqs=e, sol=s))
        .when(kind == "weak_summary_no_verification", fill(vocab.WEAK_SUMMARY, eqs=e, sol=s))
        .otherwise(fill(vocab.STRONG_STATE, eqs=e, sol=s, checks=F.col("__checks"))))
    rows = rows.withColumns({"injected_thought": made, "intervention_id": F.concat_ws("::", item, "variant_id")})
    prefix = F.concat(F.lit(vocab.THOUGHT_OPEN + "\n"), F.col("injected_thought"), F.lit(vocab.ANSWER_OPEN))
    return rows.withColumn("injected_raw_prefix", prefix).drop("__checks", "__eqs", "__sol", "__c")


def candidate_texts(pairs: DataFrame, pair: str, q: str, qstar: str, variable_count: Column, templates: Sequence[str]) -> DataFrame:
    """Pair x template with preamble, Q line and Q* line; an error unless exactly one equation changed."""
    rows = J.expand(pairs.withColumns({"__ch": S.changed_equation(F.col(q), F.col(qstar)), "__eq": S.equation_lines(F.col(q), 1)}), template=templates)
    opening = F.lit("")
    for name in templates:
        for n, text in vocab.CANDIDATE_PREAMBLES[name].items():
            opening = F.when((F.col("template") == name) & (variable_count == n), text).otherwise(opening)
    i = F.col("__ch.i")
    before = F.array_join(F.transform(F.slice("__eq", F.lit(1), i), lambda l, k: F.concat((k + 1).cast("string"), F.lit(") "), l, F.lit("\n"))), "")
    one = F.when(F.col("__ch").isNull(), F.raise_error(F.concat(F.lit("expected one changed equation in "), F.col(pair).cast("string"))).cast("string"))
    number = F.concat((i + 1).cast("string"), F.lit(") "))
    return rows.select(
        *pairs.columns, "template", F.coalesce(one, F.concat(opening, before)).alias("preamble"),
        F.concat(number, F.col("__ch.q"), F.lit("\n")).alias("q_line"), F.concat(number, F.col("__ch.s"), F.lit("\n")).alias("qstar_line"))


# ---- request plans -----------------------------------------------------------------

def prefill_plan(pairs: DataFrame, sources: DataFrame, key: str, question: str, conditions: Sequence[dict], seeds: Sequence[str],
                 columns: Sequence[str]) -> DataFrame:
    """Pair x seed x condition; pairs without a source stay as unavailable rows."""
    rows = J.mark_unavailable(pairs, sources, key, columns)
    rows = expand_variants(J.expand(rows, seed_label=seeds), conditions)
    only = F.col("answer_format") == "answer_only"
    return rows.withColumns({
        "row_id": F.concat_ws("::", key, "condition", "seed_label"),
        "source_row_id": F.concat_ws("::", F.col(key), F.lit("counterfactual"), F.lit("primary")),
        "question_used": F.when(only, answer_only_question(F.col(question))).otherwise(F.col(question))})


def grounding_plan(pairs: DataFrame, sources: DataFrame, key: str, q: str, qstar: str, trace: str, placements: Sequence[str],
                   instructions: dict[str, str], seeds: Sequence[str], tags: tuple[str, str]) -> DataFrame:
    """Pair x seed x placement x instruction x relation with the full question text."""
    rows = J.mark_unavailable(pairs, sources, key, [trace])
    rows = J.expand(rows, seed_label=seeds, placement=placements, instruction_variant=list(instructions), relation=["conflict", "matched"])
    said = F.lit(None).cast("string")
    for name, text in instructions.items():
        said = F.when(F.col("instruction_variant") == name, text).otherwise(said)
    active = F.when(F.col("relation") == "conflict", F.col(q)).otherwise(F.col(qstar))
    head = S.rstrip(active)
    explicit = F.concat(head, F.lit(f"\n\n{tags[0]}\n"), S.strip(F.col(trace)), F.lit(f"\n{tags[1]}\n\n"), said)
    used = F.when(F.col("placement") == "hidden_prefill", F.concat(head, F.lit("\n\n"), said)).otherwise(explicit)
    planned = F.col("execution_status") == "planned"
    return rows.withColumns({
        "row_id": F.concat_ws("::", key, "placement", "instruction_variant", "relation", "seed_label"),
        "active_question": active, "question_used": F.when(planned, used)})


# ---- review tables -----------------------------------------------------------------

def review_packet(rows: DataFrame, keep: Sequence[str], tails: dict[str, tuple[str, int]], human: Sequence[str]) -> DataFrame:
    """Kept columns, the last n characters of long texts, and blank fields for the reviewer."""
    return rows.select(
        *keep, *[F.right(S.text(F.col(src)), F.lit(n)).alias(name) for name, (src, n) in tails.items()],
        *[F.lit("").alias(h) for h in human])


def judge_view(q: Column, qstar: Column, answer: Column, wrong: Column, prefix: Column, trace: Column, final: Column, limit: int = 5000) -> Column:
    """One readable text of a run for the judge; the packet columns keep the whole texts."""
    t = lambda col: S.trim_middle(col, limit)
    return F.concat(
        F.lit("ORIGINAL QUESTION:\n"), q, F.lit("\n\nCOUNTERFACTUAL QUESTION:\n"), qstar, F.lit("\n\nORIGINAL ANSWER: "), answer,
        F.lit("\nEXPECTED WRONG/COUNTERFACTUAL ANSWER: "), wrong, F.lit("\n\nINJECTED COT PREFIX:\n"), t(prefix),
        F.lit("\n\n[INJECTION ENDS HERE]\n\nGENERATED COT CONTINUATION:\n"), t(trace),
        F.lit("\n\n[COT ENDS / ANSWER CHANNEL BEGINS]\n\nFINAL ANSWER:\n"), t(final), F.lit("\n"))


def review_queue(parts: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    """Rows of several record families in one shape; a column a family lacks is null."""
    out = None
    for family, df in parts:
        tagged = df.withColumn("record_family", F.lit(family))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    return out.withColumn("review_record_id", F.concat_ws("::", "record_family", "result_record_id"))


def changed_labels(audited: DataFrame) -> DataFrame:
    """Log of the rows an audit touched."""
    return audited.where(F.col("audit_status") != "auto_accepted")


def merge_labels(packets: DataFrame, labels: DataFrame, key: str, label_columns: Sequence[str]) -> DataFrame:
    """Packet columns beside label columns; where both have a name the label's value stands."""
    left = packets.select(*[c for c in packets.columns if c not in label_columns])
    return labels.select(key, *label_columns).join(left, key, "left")


def monitor_frame(rows: DataFrame, base: str, prefixes: str) -> DataFrame:
    """One row per k with base text and the first k answer tokens as the visible text."""
    out = rows.select(*[c for c in rows.columns if c != prefixes], F.explode(prefixes).alias("k", "__p"))
    return out.withColumn("visible_text", F.concat(base, "__p")).drop("__p")


def prefix_depths(rows: DataFrame, tokens: str, fractions: Sequence[float]) -> DataFrame:
    """Row x fraction with the first round(n x f) tokens, at least one."""
    out = J.expand(rows, fraction=list(fractions))
    take = F.greatest(F.lit(1), F.bround(F.size(tokens) * F.col("fraction")).cast("int"))
    out = out.withColumn("prefix_tokens", take)
    return out.withColumn("prefix", F.slice(F.col(tokens), F.lit(1), F.col("prefix_tokens")))
