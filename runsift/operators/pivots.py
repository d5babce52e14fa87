"""Pivots, trajectories, ordered selections and one-row-per-key picks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runsift.operators.scale import global_row_number, keep_one, top_k, with_totals


def pivot_counts(df: DataFrame, index: str, column: str, values: Sequence[str]) -> DataFrame:
    """One row per index, one count column per listed value, 0 where unseen."""
    return df.groupBy(index).agg(*[F.count_if(F.col(column) == v).alias(v) for v in values])


def pivot_rates(df: DataFrame, index: str, column: str, values: Sequence[str]) -> DataFrame:
    """Row-normalised pivot: each count over the sum of the row's listed counts."""
    counts = pivot_counts(df, index, column, values)
    total = sum((F.col(v) for v in values[1:]), F.col(values[0]))
    return counts.select(index, *[F.try_divide(F.col(v), total).alias(v) for v in values])


def pivot_first(df: DataFrame, keys: Sequence[str], column: str, value: str, values: Sequence[str], order: Column) -> DataFrame:
    """One row per key with the earliest value of each listed condition, null where absent."""
    return df.groupBy(*keys).agg(
        *[F.min_by(F.when(F.col(column) == v, F.col(value)), F.when(F.col(column) == v, order)).alias(v) for v in values]
    )


def trajectory(df: DataFrame, steps: Sequence[str], null_text: str = "None", name: str = "trajectory") -> DataFrame:
    """'a -> b -> c' over ordered step columns; every null is spelled ``null_text``."""
    return df.withColumn(name, F.concat_ws(" -> ", *[F.coalesce(F.col(s), F.lit(null_text)) for s in steps]))


def value_counts(df: DataFrame, column: str, name: str = "questions") -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias(name))


def paired_transitions(df: DataFrame, a: str, b: str, name: str = "questions") -> DataFrame:
    """How often state a goes with state b; pairs with a missing side are dropped."""
    return df.na.drop(subset=[a, b]).groupBy(a, b).agg(F.count("*").alias(name))


def first_last_states(df: DataFrame, key: str, state: str, order: Column, q: str, qstar: str) -> DataFrame:
    """First and last state of the ordered mentions of a key, and the count of both states."""
    s = F.col(state)
    return df.groupBy(key).agg(
        F.min_by(s, order).alias("first_state"), F.max_by(s, order).alias("terminal_state"),
        F.count_if(s == q).alias("q_mentions"), F.count_if(s == qstar).alias("qstar_mentions"),
    )


def group_row_weight(df: DataFrame, group: str, name: str = "weight") -> DataFrame:
    """1 / rows of the row's group, by aggregate and join so a hot group stays spread out."""
    out = with_totals(df, [group], __n=F.count("*"))
    return out.withColumn(name, F.lit(1.0) / F.col("__n")).drop("__n")


def keep_last(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    return keep_one(df, keys, order, last=True)


def keep_first(df: DataFrame, key: str, order: Sequence[Column]) -> DataFrame:
    """First row per id over ordered sources; rows without an id are dropped."""
    k = F.col(key)
    return keep_one(df.where(k.isNotNull() & (k.cast("string") != "")), [key], order)


def margin_bins(df: DataFrame, branch: str, margin: str, row_id: str, k: int) -> DataFrame:
    """k lowest, k middle and k highest rows by |margin| inside each branch.

    A row in two bins keeps the first of low, high, middle.  With k = 0 nothing
    is selected.
    """
    rows = df.withColumn("__a", F.abs(F.col(margin)))
    ranked = global_row_number(rows, [branch], ["__a", row_id], "__rn")
    ranked = with_totals(ranked, [branch], __n=F.count("*"))
    rn, n = F.col("__rn"), F.col("__n")
    start = F.greatest(F.lit(0), F.floor(n / 2) - k // 2)
    bin_name = (
        F.when(rn <= k, "low").when(rn > n - k, "high").when((rn > start) & (rn <= start + k), "middle")
    )
    picked = ranked.withColumn("margin_bin", bin_name).where(F.col("margin_bin").isNotNull() & F.lit(k > 0))
    return picked.drop("__a", "__rn", "__n")


def balanced_sample(df: DataFrame, label: str, item: str, row_id: str, k: int) -> DataFrame:
    """Up to k rows per class, one row of every item first, repeats after.

    Both ranks are literal top-k filters, so a hot class or item is cut to k
    rows in each task before the shuffle.
    """
    per_item = top_k(df, [label, item], [F.col(row_id)], k, "__occ")
    order = [(F.col("__occ") > 1).cast("int"), F.col(item), F.col(row_id)]
    return top_k(per_item, [label], order, k, "__rank").drop("__occ", "__rank")
