"""Building blocks that hold when one key owns a third of all rows.

* totals come from partial aggregation and an equi-join back, never from an
  unbounded window partition;
* ordered work (running totals, ranks, medians) is range partitioned on
  (group, order) so a hot group is spread over many tasks;
* "one row per key" is an aggregate, so it is combined before the shuffle.

No join here carries a broadcast hint: adaptive execution broadcasts a side
from its measured size and splits skewed shuffle partitions otherwise.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runsift.session import cut_lineage


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join in which a null key equals a null key, keeping the left key columns."""
    renamed = right.select(
        *[F.col(k).alias(f"__r_{k}") for k in keys],
        *[c for c in right.columns if c not in keys],
    )
    cond = reduce(lambda a, b: a & b, [left[k].eqNullSafe(renamed[f"__r_{k}"]) for k in keys])
    return left.join(renamed, cond, how).drop(*[f"__r_{k}" for k in keys])


def with_totals(df: DataFrame, keys: Sequence[str], **aggs: Column) -> DataFrame:
    """Add per-key aggregates to every row: partial aggregation plus a join back."""
    totals = df.groupBy(*keys).agg(*[c.alias(n) for n, c in aggs.items()])
    return null_safe_join(df, totals, keys, "left")


def keep_one(df: DataFrame, keys: Sequence[str], order: Sequence[Column], last: bool = False) -> DataFrame:
    """One row per key, the first (or last) by ``order``, as a map-side combined aggregate."""
    pick = F.max_by if last else F.min_by
    rows = df.groupBy(*keys).agg(pick(F.struct("*"), F.struct(*order)).alias("row"))
    return rows.select("row.*")


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """First k rows per key.  A literal ``row_number <= k`` filter lets Spark keep only
    k rows per key in each task before the shuffle, so a hot key stays small."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def running_totals(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[Column | str],
    sums: dict[str, Column | str],
) -> DataFrame:
    """Exact running sums inside each group, up to and including the row.

    Rows are range partitioned on (group, order); each part adds up on its own
    and is shifted by the sum of the earlier parts of its group.  ``order`` must
    be unique inside a group for a defined result.
    """
    group = list(group)
    order_cols = [F.col(o) if isinstance(o, str) else o for o in order]
    names = list(sums)
    base = df.select("*", *[(F.col(v) if isinstance(v, str) else v).alias(f"__v_{n}") for n, v in sums.items()])
    ranged = base.repartitionByRange(*[F.col(g) for g in group], *order_cols)
    ranged = cut_lineage(ranged.withColumn("__part", F.spark_partition_id()))
    per_part = ranged.groupBy(*group, "__part").agg(*[F.sum(f"__v_{n}").alias(f"__s_{n}") for n in names])
    before = Window.partitionBy(*group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_part.select(
        *group, "__part", *[F.coalesce(F.sum(f"__s_{n}").over(before), F.lit(0)).alias(f"__o_{n}") for n in names]
    )
    inside = Window.partitionBy(*group, "__part").orderBy(*order_cols)
    inside = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = ranged.select("*", *[F.sum(f"__v_{n}").over(inside).alias(f"__c_{n}") for n in names])
    joined = null_safe_join(local, offsets, [*group, "__part"])
    return joined.select(*df.columns, *[(F.col(f"__c_{n}") + F.col(f"__o_{n}")).alias(n) for n in names])


def global_row_number(df: DataFrame, group: Sequence[str], order: Sequence[Column | str], name: str = "row_no") -> DataFrame:
    """1-based position inside each group, without one task per group."""
    return running_totals(df, group, order, {name: F.lit(1).cast("bigint")})


def exact_percentile(df: DataFrame, group: Sequence[str], value: str, q: float, name: str) -> DataFrame:
    """Linear-interpolated percentile per group from value counts; nulls are skipped.

    Equal values are counted before the shuffle, the counts are summed in order
    across range partitions, and only the rows that hold the two wanted ranks
    are kept.
    """
    group = list(group)
    counts = df.where(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count("*").alias("__n"))
    cum = running_totals(counts, group, [value], {"__hi": "__n"})
    if group:
        cum = with_totals(cum, group, __total=F.sum("__n"))
    else:
        cum = cum.withColumn("__total", counts.agg(F.sum("__n")).scalar())
    pos = (F.col("__total") - 1) * F.lit(float(q))
    lo = F.col("__hi") - F.col("__n")
    low_rank, high_rank = F.floor(pos), F.ceil(pos)
    has = lambda r: (lo <= r) & (r < F.col("__hi"))
    picked = cum.where(has(low_rank) | has(high_rank))
    agg = picked.groupBy(*group).agg(
        F.max(F.when(has(low_rank), F.col(value))).alias("__a"),
        F.max(F.when(has(high_rank), F.col(value))).alias("__b"),
        F.max(pos - low_rank).alias("__f"),
    )
    return agg.select(*group, (F.col("__a") + (F.col("__b") - F.col("__a")) * F.col("__f")).alias(name))
