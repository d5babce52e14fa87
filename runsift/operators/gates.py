"""Completeness and validity gates.

Every check returns problem rows ``(rule, id)``; a gate is their union with a
stage and a severity, so it is one set of scans and never a driver-side loop
over rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runsift.functions.projections import is_finite


def row_problems(df: DataFrame, row_id: str, rules: dict[str, Column]) -> DataFrame:
    """One (rule, id) row per violated rule; a rule that evaluates to null does not fire."""
    hits = F.filter(F.array(*[F.when(cond, F.lit(name)) for name, cond in rules.items()]), lambda r: r.isNotNull())
    return df.select(F.explode(hits).alias("rule"), F.col(row_id).cast("string").alias("id"))


def exact_ids(expected: DataFrame, observed: DataFrame, key: str) -> DataFrame:
    """Duplicate, missing and extra ids of an observed table against the planned one.

    Both sides are counted per id first, so a hot duplicate id joins as one row.
    """
    exp = expected.groupBy(key).agg(F.lit(1).alias("__e"))
    obs = observed.groupBy(key).agg(F.count("*").alias("__o"))
    both = exp.join(obs, key, "full_outer")
    return row_problems(both, key, {
        "duplicate": F.col("__o") > 1, "missing": F.col("__o").isNull(), "extra": F.col("__e").isNull(),
    })


def in_every_row(df: DataFrame, key: str, row_id: str) -> DataFrame:
    """Values of ``key`` that occur with every row id."""
    total = df.agg(F.countDistinct(row_id)).scalar()
    return df.groupBy(key).agg(F.countDistinct(row_id).alias("rows")).where(F.col("rows") == total).select(key)


def has_all(df: DataFrame, key: str, member: str, required: Sequence[str]) -> DataFrame:
    """Keys that have every required member at least once."""
    every = reduce(lambda a, b: a & b, [F.bool_or(F.col(member) == m) for m in required])
    return df.groupBy(key).agg(every.alias("__all")).where("__all").select(key)


def unknown_keys(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Ids of either table without a partner in the other one."""
    a = left.select(key).distinct().join(right.select(key), key, "left_anti").withColumn("side", F.lit("left_only"))
    b = right.select(key).distinct().join(left.select(key), key, "left_anti").withColumn("side", F.lit("right_only"))
    return a.unionByName(b)


def label_rules(label: str, bridge: str, boundary: str, answer_format: str, valid: Sequence[str]) -> dict[str, Column]:
    """The five consistency rules of manual labels."""
    lab, has_bridge = F.col(label), F.coalesce(F.col(bridge), F.lit("")).isin("", "none")
    answer_only = lab.isin("ANSWER_ONLY_FOLLOW", "ANSWER_ONLY_BYPASS")
    silent = lab.isin("SILENT_BYPASS_REANCHOR", "SILENT_BYPASS_RECOMPUTE")
    state_ok = F.coalesce(F.col(boundary).isin("original_correct", "already_corrected"), F.lit(False))
    return {
        "invalid_label": ~F.coalesce(lab.isin(*valid), F.lit(False)),
        "transparent_without_bridge": (lab == "FINAL_STAGE_TRANSPARENT_CORRECTION") & has_bridge,
        "silent_with_bridge_marked": silent & ~has_bridge,
        "cot_correction_boundary_state_check": (lab == "COT_STAGE_CORRECTION") & ~state_ok,
        "answer_only_label_on_normal_row": answer_only & ~F.col(answer_format).eqNullSafe("answer_only"),
    }


def required_fields(df: DataFrame, fields: Sequence[str]) -> dict[str, Column]:
    """A rule per field: null, empty text and empty list all count as missing."""
    kinds = dict(df.dtypes)
    empty = {}
    for f in fields:
        c, kind = F.col(f), kinds[f]
        blank = F.size(c) == 0 if kind.startswith(("array", "map")) else c == "" if kind == "string" else F.lit(False)
        empty[f"missing_{f}"] = c.isNull() | blank
    return empty


def pair_rules(q_answer: Column, qstar_answer: Column, edited: Column, prefix: Column, open_marker: str, close_marker: str,
               closes: Column) -> dict[str, Column]:
    """Q and Q* must differ, edited rows carry no Q*, and prefixes start and end with their markers."""
    return {
        "equal_answers": ~edited & (q_answer == qstar_answer),
        "edited_row_has_counterfactual": edited & qstar_answer.isNotNull(),
        "prefix_without_open_marker": ~prefix.startswith(open_marker),
        "prefix_without_close_marker": closes & ~prefix.endswith(close_marker),
    }


def score_rules(score: str, ids: str) -> dict[str, Column]:
    """Token list non-empty, finite and as long as it says; totals finite; candidate ids present."""
    values = F.col(f"{score}.token_logprobs")
    none = values.isNull() | (F.size(values) == 0)
    rules = {
        f"empty_{score}": none,
        f"non_finite_{score}": ~none & ~F.forall(values, is_finite),
        f"{score}_token_count_mismatch": ~none & (F.coalesce(F.col(f"{score}.token_count"), F.lit(-1)) != F.size(values)),
        f"missing_{ids}": F.col(ids).isNull() | (F.size(ids) == 0),
    }
    for part in ("total_logprob", "average_logprob", "perplexity"):
        rules[f"invalid_{score}_{part}"] = ~none & ~is_finite(F.col(f"{score}.{part}"))
    return rules


def sample_rules(seed: Column, expected_seed: Column, generated: Column, answer: Column, endpoint: Column,
                 limit: int, temperature: Column, registered: Sequence[str]) -> dict[str, Column]:
    """Seed as derived, endpoint = first tokens of the answer, registered temperature, non-empty."""
    return {
        "incorrect_seed": ~seed.eqNullSafe(expected_seed),
        "empty_generated_ids": generated.isNull() | (F.size(generated) == 0),
        "endpoint_mismatch": ~endpoint.eqNullSafe(F.slice(answer, 1, limit)),
        "unregistered_temperature": ~F.coalesce(temperature.isin(*registered), F.lit(False)),
    }


def vector_rules(vec: Column, dim: int, k: Column, registered: Sequence[int]) -> dict[str, Column]:
    """Right length, all finite, registered position."""
    return {
        "shape_mismatch": F.coalesce(F.size(vec), F.lit(-1)) != dim,
        "non_finite_values": ~F.forall(vec, lambda x: is_finite(x.cast("double"))),
        "unregistered_position": ~k.isin(*registered),
    }


def mask_family_rules(counts: dict[str, str]) -> dict[str, Column]:
    """Rules over one row per parent; ``counts`` maps none, question, trace, joint to count columns."""
    none, q, t, j = (F.col(counts[k]) for k in ("none", "question", "trace", "joint"))
    complete = none.isNotNull() & q.isNotNull() & t.isNotNull() & j.isNotNull()
    return {
        "unmasked_control_masks_positions": none != 0,
        "empty_source_mask": (q <= 0) | (t <= 0) | (j <= 0),
        "incomplete_mask_family": ~complete,
        "joint_smaller_than_component": complete & (j < F.greatest(q, t)),
    }


def roll_up(parts: Sequence[tuple[str, str, DataFrame]]) -> DataFrame:
    """(stage, severity, problem rows) parts as one table."""
    tagged = [
        df.select(F.lit(stage).alias("stage"), F.lit(severity).alias("severity"), "rule", "id")
        for stage, severity, df in parts
    ]
    return reduce(lambda a, b: a.unionByName(b), tagged)


def gate_summary(problems: DataFrame, stages: Sequence[str]) -> DataFrame:
    """Hard failures and warnings per stage and whether it passed; clean stages are listed too."""
    seen = problems.groupBy("stage").agg(
        F.count_if(F.col("severity") == "hard").alias("hard_failures"),
        F.count_if(F.col("severity") == "warning").alias("warnings"),
    )
    spark = problems.sparkSession
    listed = spark.range(1).select(F.explode(F.array(*map(F.lit, stages))).alias("stage"))
    out = listed.join(seen, "stage", "left").na.fill(0)
    return out.withColumn("passed", F.col("hard_failures") == 0)


def verify_manifest(inventory: DataFrame, manifest: DataFrame) -> DataFrame:
    """Manifest entries (path, sha256) that are missing on disk or hash differently, and unlisted files."""
    have = inventory.select("path", F.col("sha256").alias("__have"))
    both = manifest.select("path", F.col("sha256").alias("__want")).join(have, "path", "full_outer")
    return row_problems(both, "path", {
        "missing_file": F.col("__have").isNull(), "unlisted_file": F.col("__want").isNull(),
        "hash_mismatch": F.col("__have") != F.col("__want"),
    })


def cohort_problems(rows: DataFrame, model: str, member: str) -> DataFrame:
    """Members that are not present for every model."""
    models = rows.agg(F.countDistinct(model)).scalar()
    seen = rows.groupBy(member).agg(F.countDistinct(model).alias("models"))
    return seen.withColumn("all_models", models).where("models <> all_models").select(member, "models")
