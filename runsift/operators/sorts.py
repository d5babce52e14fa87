"""Orders and top-k selections."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runsift.operators.scale import top_k


def review_order(model: str, family: str, pair: str, condition: str, temperature: str, sample: str, mask: str) -> list[Column]:
    """Sort keys of the review queue: null sample -> -1, null text -> 'None'."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("None"))
    return [
        F.col(model), F.col(family), F.col(pair), F.col(condition), text(temperature),
        F.coalesce(F.col(sample), F.lit(-1)), text(mask),
    ]


def order_like(df: DataFrame, reference: DataFrame, key: str, position: str) -> DataFrame:
    """Rows in the order of another table: its position joined by key."""
    pos = reference.select(key, F.col(position).alias("position"))
    return df.join(pos, key).orderBy("position")


def by_abs_then_value(df: DataFrame, column: str) -> DataFrame:
    return df.orderBy(F.abs(F.col(column)), F.col(column))


def representative_cases(
    df: DataFrame, label: str, row_id: str, order: Sequence[str], prefixes: Sequence[str], k: int
) -> DataFrame:
    """First k rows per label: ids with a priority prefix first, then the order columns."""
    text = F.col(row_id).cast("string")
    hit = F.lit(False)
    for p in prefixes:
        hit = hit | text.startswith(p)
    return top_k(df, [label], [(~hit).cast("int"), *map(F.col, order), F.col(row_id)], k)


def best_layers(df: DataFrame, layer: str, score: str, k: int = 8) -> DataFrame:
    """k layers by (score, layer) descending; an order with a limit is a distributed top-k."""
    return df.orderBy(F.desc(score), F.desc(layer)).limit(k)


def most_common(df: DataFrame, key: str, k: int) -> DataFrame:
    """k most frequent keys; ties follow the key."""
    counts = df.groupBy(key).agg(F.count("*").alias("count"))
    return counts.orderBy(F.desc("count"), F.asc(key)).limit(k)


def first_offenders(df: DataFrame, keys: Sequence[str], row_id: str, k: int = 3) -> DataFrame:
    """Number of offending ids per key and the first k of them in order."""
    ids = df.select(*keys, F.col(row_id).cast("string").alias("__id"))
    total = ids.groupBy(*keys).agg(F.count("*").alias("offenders"))
    head = top_k(ids, keys, [F.col("__id")], k, "__rank").groupBy(*keys).agg(
        F.array_join(F.array_sort(F.collect_list("__id")), ",").alias("first_ids")
    )
    return total.join(head, list(keys))
