"""Classifier metrics and rank statistics, many tables (keys) in one job."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runsift.functions.numeric import correlation_p
from runsift.functions.projections import is_finite
from runsift.operators.scale import null_safe_join, running_totals, with_totals
from runsift.session import cut_lineage


def confusion(df: DataFrame, keys: Sequence[str], label: str, score: str) -> DataFrame:
    """Counts by label and prediction; score >= 0 predicts 1."""
    rows = df.where(is_finite(F.col(score)))
    pred = (F.col(score) >= 0).cast("int").alias("prediction")
    return rows.groupBy(*keys, label, pred).agg(F.count("*").alias("count"))


def _cells(df: DataFrame, keys: Sequence[str], label: str, score: str, weight: str) -> DataFrame:
    y, s, w = F.col(label), F.col(score), F.col(weight)
    pos, pred = y == 1, s >= 0
    names = {"tp": pos & pred, "fn": pos & ~pred, "fp": ~pos & pred, "tn": ~pos & ~pred}
    aggs = [F.count_if(c).alias(n) for n, c in names.items()]
    aggs += [F.sum(F.when(c, w).otherwise(0.0)).alias(f"w_{n}") for n, c in names.items()]
    return df.groupBy(*keys).agg(F.count("*").alias("n"), *aggs)


def balanced(tp: Column, fn: Column, fp: Column, tn: Column) -> Column:
    """Mean of both recalls; null when a class is absent."""
    return (F.try_divide(tp, tp + fn) + F.try_divide(tn, tn + fp)) / 2


def roc_aucs(df: DataFrame, keys: Sequence[str], label: str, score: str, weights: dict[str, str | None]) -> DataFrame:
    """Areas under the ROC curve per key, one per named weight; ties count one half, one class gives null.

    Rows are first added up per score, then the negatives below each score come
    from a distributed running total.
    """
    pos = F.col(label) == 1
    sums = []
    for name, weight in weights.items():
        w = F.lit(1.0) if weight is None else F.col(weight)
        sums += [F.sum(F.when(pos, w).otherwise(0.0)).alias(f"__p_{name}"), F.sum(F.when(pos, 0.0).otherwise(w)).alias(f"__n_{name}")]
    cells = df.where(is_finite(F.col(score))).groupBy(*keys, score).agg(*sums)
    cum = running_totals(cells, keys, [score], {f"__c_{n}": f"__n_{n}" for n in weights})
    aggs, areas = [], []
    for n in weights:
        below = F.col(f"__c_{n}") - F.col(f"__n_{n}") / 2
        aggs += [F.sum(F.col(f"__p_{n}") * below).alias(f"__s_{n}"), F.sum(f"__p_{n}").alias(f"__sp_{n}"), F.sum(f"__n_{n}").alias(f"__sn_{n}")]
        areas.append(F.try_divide(F.col(f"__s_{n}"), F.col(f"__sp_{n}") * F.col(f"__sn_{n}")).alias(n))
    return cum.groupBy(*keys).agg(*aggs).select(*keys, *areas)


def roc_auc(df: DataFrame, keys: Sequence[str], label: str, score: str, weight: str | None = None, name: str = "roc_auc") -> DataFrame:
    return roc_aucs(df, keys, label, score, {name: weight})


def metric_bundle(df: DataFrame, keys: Sequence[str], label: str, score: str, group: str) -> DataFrame:
    """n, accuracy, balanced accuracy, F1, MCC, AUC, and the group-weighted balanced accuracy and AUC."""
    # Scores are dear to compute and read several times below, so the narrow table is written once.
    return bundle_of(cut_lineage(df.where(is_finite(F.col(score))).select(*keys, group, label, score)), keys, label, score, group)


def bundle_of(written: DataFrame, keys: Sequence[str], label: str, score: str, group: str) -> DataFrame:
    """``metric_bundle`` of written rows (keys..., group, label, score) with finite scores.

    Rows meet the sizes of their groups once, for the cells and for both areas.
    """
    rows = cut_lineage(with_totals(written, [*keys, group], __size=F.count("*"))).withColumn("__w", F.lit(1.0) / F.col("__size"))
    c = _cells(rows, keys, label, score, "__w")
    tp, fn, fp, tn = (F.col(x) for x in ("tp", "fn", "fp", "tn"))
    d = lambda x: x.cast("double")
    root = F.sqrt(d(tp + fp) * d(tp + fn) * d(tn + fp) * d(tn + fn))
    mcc = F.when(root == 0, 0.0).otherwise((d(tp) * d(tn) - d(fp) * d(fn)) / F.nullif(root, F.lit(0.0)))
    two = (tp + fn > 0) & (tn + fp > 0)
    out = c.select(
        *keys, "n", ((tp + tn) / F.col("n")).alias("accuracy"), balanced(tp, fn, fp, tn).alias("balanced_accuracy"),
        balanced(*(F.col(f"w_{x}") for x in ("tp", "fn", "fp", "tn"))).alias("weighted_balanced_accuracy"),
        F.coalesce(F.try_divide(2 * tp, 2 * tp + fp + fn), F.lit(0.0)).alias("f1"), F.when(two, mcc).alias("mcc"))
    areas = roc_aucs(rows, keys, label, score, {"roc_auc": None, "weighted_roc_auc": "__w"})
    if keys:
        return null_safe_join(out, areas, list(keys), "left")
    return out.withColumns({n: areas.select(n).scalar() for n in areas.columns})


def spearman(df: DataFrame, keys: Sequence[str], a: str, b: str, name: str = "spearman") -> DataFrame:
    """Rank correlation with average ranks and its two-sided p-value (``<name>_p``); null when a side is constant.

    Both rank tables are built from value counts; rows are collapsed to (a, b)
    counts before they meet their ranks.
    """
    rows = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    cells = rows.groupBy(*keys, a, b).agg(F.count("*").alias("__n"))

    def ranks(value: str, out: str) -> DataFrame:
        counts = cells.groupBy(*keys, value).agg(F.sum("__n").alias("__k"))
        cum = running_totals(counts, keys, [value], {"__hi": "__k"})
        return cum.select(*keys, value, (F.col("__hi") - (F.col("__k") - 1) / 2.0).alias(out))

    both = null_safe_join(cells, ranks(a, "__ra"), [*keys, a])
    both = null_safe_join(both, ranks(b, "__rb"), [*keys, b])
    n, x, y = F.col("__n"), F.col("__ra"), F.col("__rb")
    s = both.groupBy(*keys).agg(
        F.sum(n).alias("n"), F.sum(n * x).alias("sx"), F.sum(n * y).alias("sy"), F.sum(n * x * y).alias("sxy"),
        F.sum(n * x * x).alias("sxx"), F.sum(n * y * y).alias("syy"))
    c = F.col
    cov = c("sxy") - c("sx") * c("sy") / c("n")
    vx, vy = c("sxx") - c("sx") * c("sx") / c("n"), c("syy") - c("sy") * c("sy") / c("n")
    value = F.when((vx > 1e-9) & (vy > 1e-9), cov / F.sqrt(vx * vy))
    return s.select(*keys, c("n"), value.alias(name)).withColumn(f"{name}_p", correlation_p(c(name), c("n")))
