"""Lookups, role re-joins, overrides, grids and resume joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runsift.operators.scale import null_safe_join


def lookup(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Attach the row of a keyed table; its measured size decides between broadcast and shuffle."""
    return rows.join(table, key)


def split_roles(df: DataFrame, key: str, role: str, roles: Sequence[str], columns: Sequence[str], order: Column) -> DataFrame:
    """One row per key with ``<column>_<role>`` columns and a flag for a missing side.

    Duplicate roles resolve to the first row by ``order``.
    """
    aggs = [F.bool_or(F.col(role) == r).alias(f"__has_{r}") for r in roles]
    for r in roles:
        hit = F.col(role) == r
        aggs += [F.min_by(F.when(hit, F.col(c)), F.when(hit, order)).alias(f"{c}_{r}") for c in columns]
    out = df.groupBy(key).agg(*aggs)
    complete = F.lit(True)
    for r in roles:
        complete = complete & F.col(f"__has_{r}")
    return out.withColumn("complete", complete).drop(*[f"__has_{r}" for r in roles])


def one_to_one_left_join(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Null-safe left join and a table of key problems (duplicate on a side, unmatched)."""
    marked = null_safe_join(left, right.withColumn("__hit", F.lit(True)), keys, "left")
    dup = lambda df, side: df.groupBy(*keys).agg(F.count("*").alias("rows")).where("rows > 1").withColumn(
        "problem", F.lit(f"duplicate_{side}"))
    missing = marked.where("__hit is null").groupBy(*keys).agg(F.count("*").alias("rows")).withColumn(
        "problem", F.lit("unmatched"))
    problems = dup(left, "left").unionByName(dup(right, "right")).unionByName(missing)
    return marked.drop("__hit"), problems


def apply_overrides(auto: DataFrame, excluded: DataFrame, overrides: DataFrame, key: str, label: str) -> DataFrame:
    """Exclude list before override map before the automatic label, with status and note.

    excluded: (key, exclude_note); overrides: (key, override_label, override_note).
    """
    out = auto.join(excluded.withColumn("__ex", F.lit(True)), key, "left").join(overrides, key, "left")
    ex, ov = F.col("__ex").isNotNull(), F.col("override_label").isNotNull()
    return out.select(
        *auto.columns,
        F.when(ex, "DATASET_ISSUE").otherwise(F.coalesce("override_label", label)).alias("audited_label"),
        F.when(ex, "excluded").when(ov, "overridden").otherwise("auto_accepted").alias("audit_status"),
        F.when(ex, F.col("exclude_note")).when(ov, F.col("override_note")).otherwise("").alias("audit_note"),
    )


def enrich(df: DataFrame, extra: DataFrame, key: str, defaults: dict[str, object]) -> DataFrame:
    """Left join with a default in place of each absent value."""
    out = df.join(extra.select(key, *defaults), key, "left")
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})


def expand(df: DataFrame, **dims: Sequence) -> DataFrame:
    """Every row x every combination of the listed values.

    A plan dimension is a short literal list, so the grid is a narrow explode
    and needs neither a shuffle nor a product join.
    """
    for name, values in dims.items():
        df = df.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return df


def parents_of(results: DataFrame, parents: Sequence[DataFrame], key: str) -> DataFrame:
    """Result rows joined to the union of the parents of all models."""
    union = parents[0]
    for p in parents[1:]:
        union = union.unionByName(p)
    return results.join(union, key)


def pending(plan: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return plan.join(done.select(key), key, "left_anti")


def select_ids(plan: DataFrame, wanted: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Plan rows in the wanted list, and the wanted ids the plan does not hold (must be empty)."""
    return plan.join(wanted.select(key), key, "left_semi"), wanted.select(key).join(plan, key, "left_anti")


def mark_unavailable(plan: DataFrame, sources: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Plan rows with their source; rows without one stay as ``not_run_source_unavailable``."""
    src = sources.select(key, *columns).withColumn("__src", F.lit(True))
    out = plan.join(src, key, "left")
    status = F.when(F.col("__src").isNull(), "not_run_source_unavailable").otherwise("planned")
    return out.withColumn("execution_status", status).drop("__src")


def variants_side_by_side(df: DataFrame, parent: str, variant: str, value: str, variants: Sequence[str]) -> DataFrame:
    """One row per parent with the largest value of each variant beside each other."""
    return df.groupBy(parent).agg(*[F.max(F.when(F.col(variant) == v, F.col(value))).alias(v) for v in variants])
