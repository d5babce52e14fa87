"""Counts, rates and summaries of run tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runsift.operators.scale import exact_percentile, null_safe_join, with_totals


def rate(flag: Column) -> Column:
    """Share of true rows; null flags are skipped and an empty group gives null."""
    return F.avg(flag.cast("double"))


def accuracy_by_keys(df: DataFrame, keys: Sequence[str], flag: str) -> DataFrame:
    f = F.col(flag)
    return df.groupBy(*keys).agg(
        F.count(f).alias("count"), F.sum(f.cast("bigint")).alias("sum"), rate(f).alias("mean")
    )


def contingency(df: DataFrame, keys: Sequence[str], keep_null_keys: bool = False, name: str = "count") -> DataFrame:
    """Size of every key combination.  Null keys are dropped unless asked for."""
    rows = df if keep_null_keys else df.na.drop(subset=list(keys))
    return rows.groupBy(*keys).agg(F.count("*").alias(name))


def multi_key_counts(df: DataFrame, label: str, key_sets: Sequence[Sequence[str]], name: str = "count") -> DataFrame:
    """The same label count over several key lists in one scan (grouping sets).

    ``summary`` names the key list of a row; keys outside it are null.
    """
    keys = list(dict.fromkeys(k for ks in key_sets for k in ks))
    sets = [[F.col(label), *[F.col(k) for k in ks]] for ks in key_sets]
    bits = lambda ks: sum(0 if k in ks else 1 << (len(keys) - 1 - i) for i, k in enumerate(keys))
    which = F.lit(None).cast("string")
    for ks in key_sets:
        which = F.when(F.col("__gid") == bits(ks), F.lit(",".join(ks))).otherwise(which)
    grouped = df.groupingSets(sets, F.col(label), *[F.col(k) for k in keys]).agg(
        F.grouping_id().alias("__gid"), F.count("*").alias(name)
    )
    return grouped.withColumn("summary", which).drop("__gid")


def percent(n: Column, d: Column) -> Column:
    """100 * n / d, and 0 where the denominator is 0."""
    return F.when(d == 0, F.lit(0.0)).otherwise(100.0 * n / F.nullif(d, F.lit(0)))


def share_of_total(df: DataFrame, key: str) -> DataFrame:
    counts = df.groupBy(key).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    return counts.select(key, "n", percent(F.col("n"), total).alias("pct"))


def sampling_rates(
    df: DataFrame, keys: Sequence[str], sampled: str, greedy: str, branches: tuple[str, str] = ("Q", "QSTAR")
) -> DataFrame:
    """Sample count, greedy reproduction and the rate of each branch and of all others."""
    s = F.col(sampled)
    return df.groupBy(*keys).agg(
        F.count("*").alias("samples"),
        rate(s == F.col(greedy)).alias("greedy_reproduction"),
        rate(s == branches[0]).alias("q_rate"),
        rate(s == branches[1]).alias("qstar_rate"),
        rate(~s.isin(*branches)).alias("other_rate"),
    )


def instruction_summary(df: DataFrame, keys: Sequence[str], branch: str, flag_a: str, flag_b: str) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.count("*").alias("runs"),
        F.count_if(F.col(branch) == "Q").alias("q_branch"),
        F.count_if(F.col(branch) == "QSTAR").alias("qstar_branch"),
        rate(F.col(flag_a)).alias("bridge_language_rate"),
        rate(F.col(flag_b)).alias("both_values_rate"),
    )


def guarded_rates(df: DataFrame, rates: dict[str, tuple[Column, Column]]) -> DataFrame:
    """One row of rates, each over its own subset; null when the subset is empty."""
    return df.agg(*[rate(F.when(subset, hit)).alias(name) for name, (subset, hit) in rates.items()])


def success_trials(df: DataFrame, tests: dict[str, tuple[Column, Column]]) -> DataFrame:
    """(test, successes, trials, rate) rows from one aggregation pass."""
    aggs = []
    for i, (available, success) in enumerate(tests.values()):
        aggs += [F.count_if(available & success).alias(f"s{i}"), F.count_if(available).alias(f"t{i}")]
    rows = F.array(
        *[
            F.struct(F.lit(name).alias("test"), F.col(f"s{i}").alias("successes"), F.col(f"t{i}").alias("trials"))
            for i, name in enumerate(tests)
        ]
    )
    out = df.agg(*aggs).select(F.explode(rows).alias("r")).select("r.*")
    return out.withColumn("rate", F.col("successes") / F.greatest(F.col("trials"), F.lit(1)))


def sign_agreement(df: DataFrame, delta: str, branch: str, positive: str = "QSTAR") -> DataFrame:
    """How often delta > 0 goes with the positive branch; delta = 0 counts as the other one."""
    hit = (F.col(delta) > 0) == (F.col(branch) == positive)
    return df.agg(F.count("*").alias("cases"), rate(hit).alias("sign_accuracy"))


def zero_filled_counts(
    df: DataFrame, condition: str, category: str, branch: str, conditions: Sequence[str], branches: Sequence[str]
) -> DataFrame:
    """Every registered condition x observed category x branch, with 0 where unseen."""
    counts = contingency(df, [condition, category, branch])
    grid = (
        counts.select(category).distinct()
        .withColumn(condition, F.explode(F.array(*map(F.lit, conditions))))
        .withColumn(branch, F.explode(F.array(*map(F.lit, branches))))
    )
    filled = grid.join(counts, [condition, category, branch], "left")
    return filled.select(condition, category, branch, F.coalesce("count", F.lit(0)).alias("count"))


def with_partition_rate(counts: DataFrame, keys: Sequence[str], total: str) -> DataFrame:
    """Total over ``keys`` beside each count, and the rate (null when the total is 0)."""
    out = with_totals(counts, keys, **{total: F.sum("count")})
    return out.withColumn("rate", F.try_divide(F.col("count"), F.col(total)))


def macro_rates(rates: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean of the per-category rates; empty strata are null and therefore skipped."""
    return rates.groupBy(*keys).agg(F.avg("rate").alias("macro_rate"))


def set_equality_counts(df: DataFrame, case: str, preference: str, values: tuple[str, str]) -> DataFrame:
    """Cases whose preferences are exactly {a}, exactly {b}, exactly {a, b}, or anything else."""
    a, b = values
    p = F.col(preference)
    per_case = df.groupBy(case).agg(
        F.bool_or(p == a).alias("has_a"), F.bool_or(p == b).alias("has_b"), F.bool_or(~p.isin(a, b)).alias("has_other")
    )
    kind = (
        F.when(F.col("has_other"), "other")
        .when(F.col("has_a") & F.col("has_b"), "both")
        .when(F.col("has_a"), f"only_{a}")
        .otherwise(f"only_{b}")
    )
    return per_case.groupBy(kind.alias("preference_set")).agg(F.count("*").alias("cases"))


def median_by(df: DataFrame, keys: Sequence[str], value: str, name: str = "median") -> DataFrame:
    return exact_percentile(df, keys, value, 0.5, name)


def feature_means(df: DataFrame, label: str, features: Sequence[str]) -> DataFrame:
    return df.groupBy(label).agg(F.count("*").alias("n"), *[F.avg(f).alias(f"mean_{f}") for f in features])


def duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return contingency(df, keys, keep_null_keys=True).where("count > 1")


def stage_status(df: DataFrame, stage: str, status: str, parse: str, truncated: str, generated: str = "generated") -> DataFrame:
    """Parse-status histogram and truncations of the generated rows of each stage."""
    rows = df.where(F.col(status) == generated)
    return rows.groupBy(stage, parse).agg(
        F.count("*").alias("rows"), F.count_if(F.col(truncated)).alias("truncated_rows")
    )


def usable_rate(df: DataFrame, stage: str, parse: str, truncated: str, minimum: Column) -> DataFrame:
    """ok and not truncated over all rows of the stage, against the stage's minimum."""
    good = (F.col(parse) == "ok") & ~F.col(truncated)
    out = df.groupBy(stage).agg(F.count("*").alias("rows"), F.count_if(good).alias("usable"))
    out = out.withColumn("usable_rate", F.col("usable") / F.col("rows"))
    return out.withColumn("minimum", minimum).withColumn("passed", F.col("usable_rate") >= F.col("minimum"))


def source_coverage(plan: DataFrame, sources: DataFrame, key: str, show: int = 3) -> DataFrame:
    """Available sources over all planned keys, with the first missing ids."""
    have = sources.select(key).distinct().withColumn("__have", F.lit(True))
    marked = plan.select(key).distinct().join(have, key, "left")
    totals = marked.agg(
        F.count("*").alias("planned"), F.count_if(F.col("__have").isNotNull()).alias("available")
    )
    first = marked.where(F.col("__have").isNull()).orderBy(key).limit(show)
    first = first.agg(F.array_join(F.array_sort(F.collect_list(F.col(key).cast("string"))), ",").alias("first_missing"))
    totals = totals.withColumn("first_missing", first.scalar())
    return totals.withColumn("source_rate", F.col("available") / F.col("planned"))


def ranked_vocabulary(df: DataFrame, token: str, rank: str, top_k: int, keep: Column | None = None) -> DataFrame:
    """Sum of max(1, top_k - rank) per token."""
    rows = df if keep is None else df.where(keep)
    weight = F.greatest(F.lit(1), F.lit(top_k) - F.col(rank)).cast("bigint")
    return rows.groupBy(token).agg(F.sum(weight).alias("weight"))


def distribution_mismatch(df: DataFrame, key: str, expected: DataFrame) -> DataFrame:
    """Keys whose observed count differs from the expected table (key, expected)."""
    seen = contingency(df, [key], keep_null_keys=True, name="observed")
    both = expected.join(seen, key, "full_outer").select(
        key, F.coalesce("expected", F.lit(0)).alias("expected"), F.coalesce("observed", F.lit(0)).alias("observed")
    )
    return both.where(F.col("expected") != F.col("observed"))


def children_mismatch(parents: DataFrame, children: DataFrame, key: str, expected: Column) -> DataFrame:
    """Parents whose number of child rows is not the number their kind calls for."""
    n = children.groupBy(key).agg(F.count("*").alias("children"))
    out = parents.join(n, key, "left").withColumn("children", F.coalesce("children", F.lit(0)))
    return out.withColumn("expected_children", expected).where("children <> expected_children")


def progress_table(rows: DataFrame, expected: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Completed, expected, percent and complete flag per stage; expected has (keys, expected)."""
    seen = rows.groupBy(*keys).agg(F.count("*").alias("completed"))
    out = null_safe_join(expected, seen, keys, "left")
    out = out.withColumn("completed", F.coalesce("completed", F.lit(0)))
    out = out.withColumn("percent", F.round(percent(F.col("completed"), F.col("expected")), 2))
    return out.withColumn("complete", F.col("completed") == F.col("expected"))


def overall_progress(progress: DataFrame) -> DataFrame:
    """A stage never counts for more than it was expected to give."""
    done = F.sum(F.least("completed", "expected"))
    return progress.agg(
        done.alias("completed"), F.sum("expected").alias("expected"),
        F.round(percent(done, F.sum("expected")), 2).alias("percent"),
    )


def forecast_accuracy(df: DataFrame, prediction: str, actual: str, unparsed: str = "UNPARSEABLE") -> DataFrame:
    ok = F.col(prediction) != unparsed
    return df.agg(
        F.count("*").alias("rows"), F.count_if(ok).alias("parseable"),
        rate(F.when(ok, F.col(prediction) == F.col(actual))).alias("accuracy"),
    )


def heuristic_accuracy(df: DataFrame, rule: Column, label: Column) -> DataFrame:
    return df.agg(F.count("*").alias("rows"), F.count_if(rule).alias("predicted"), rate(rule == label).alias("accuracy"))
