"""Held-out-group classifiers.

Folds are fitted side by side in blocks whose state fits the driver: a Newton step
is one distributed pass that sums loss, gradient and curvature of every fold of the
block inside the tasks; the driver solves the small systems.  A fold may carry its
own affine transform (scaling, whitened principal components), which also comes
from sums.  There is no limit to the number of folds, but every fold trains on all
other rows, so the work is that of folds x rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runsift.operators import foldpca
from runsift.operators.scale import null_safe_join, top_k
from runsift.operators.vectors import vector_sum
from runsift.session import cut_lineage, written

#: Numbers that the folds of one block may hold on the driver (256 MB).
BLOCK_STATE = 1 << 25


# ---- text features -----------------------------------------------------------------

def words(text: Column) -> Column:
    """Lower-cased words of a text, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"(?U)(\b[\w/+=-]+\b)"), 1)


def grams(df: DataFrame, column: str, keep: Sequence[str] = ()) -> DataFrame:
    """(keep..., term): the words and word pairs of every row, as often as they come."""
    after = F.slice(column, 2, F.greatest(F.size(column) - 1, F.lit(0)))
    pairs = df.select(*keep, F.explode(F.arrays_zip(F.col(column).alias("a"), after.alias("b"))).alias("__p"))
    both = F.array("__p.a", F.concat_ws(" ", "__p.a", "__p.b"))
    return pairs.select(*keep, F.explode(F.when(F.col("__p.b").isNull(), F.array("__p.a")).otherwise(both)).alias("term"))


def ngrams(df: DataFrame, row_id: str, group: str, text: str) -> DataFrame:
    """(row, group, term, tf) of lower-cased words and word pairs."""
    # Texts are dealt by row, so that the counts of a row are made where its text is and terms do not move.
    rows = df.select(row_id, group, text).repartition(row_id, group).select(row_id, group, words(F.col(text)).alias("__w"))
    return grams(rows, "__w", [row_id, group]).groupBy(row_id, group, "term").agg(F.count("*").alias("tf"))


def fold_vocabulary(terms: DataFrame, row_id: str, group: str, min_df: int = 2, max_features: int = 3000,
                    max_folds: int = 2000, docs: DataFrame | None = None) -> DataFrame:
    """(fold, term, count, idf) per held-out group: totals minus the group's own counts.

    Kept are the max_features most frequent terms with enough documents, ties
    by term; idf is ln((1 + n) / (1 + df)) + 1 over the training documents, those with a
    term or, where ``docs`` (group, __n) counts them, all.
    The number of folds is checked, as every fold has a vocabulary of its own.

    Leaving a group out only lowers counts, so a term whose total is below the
    held-out count of a fold's last place among the overall top terms (twice as
    many as are kept, so that terms of one group do not lower that count) cannot
    enter the fold and is left out of its grid.
    """
    folds = [r[0] for r in (terms if docs is None else docs).select(group).distinct().limit(max_folds + 1).collect()]
    if len(folds) > max_folds:
        raise ValueError(f"more than {max_folds} folds")
    own = written(terms.groupBy(group, "term").agg(F.count("*").alias("__df"), F.sum("tf").alias("__tf")), "own-terms")
    total = own.groupBy("term").agg(F.sum("__df").alias("__tdf"), F.sum("__tf").alias("__ttf")).where(F.col("__tdf") >= min_df)
    # The top terms and the candidates are few and written, so that the counts of all terms meet them without an exchange.
    top = written(total.orderBy(F.desc("__ttf"), "term").limit(2 * max_features), "top-terms")
    kind = dict(own.dtypes)[group]
    names = F.array(*map(F.lit, folds)) if folds else F.array().cast(f"array<{kind}>")

    def held_out(grid: DataFrame, mine: DataFrame) -> DataFrame:
        return grid.join(mine.withColumnRenamed(group, "fold"), ["fold", "term"], "left").select(
            "fold", "term", (F.col("__tdf") - F.coalesce("__df", F.lit(0))).alias("df"),
            (F.col("__ttf") - F.coalesce("__tf", F.lit(0))).alias("count")).where(F.col("df") >= min_df)

    first = held_out(top.withColumn("fold", F.explode(names)), own.join(top.select("term"), "term"))
    first = top_k(first, ["fold"], [F.desc("count"), F.col("term")], max_features).groupBy("fold")
    # One row a fold, and their number is checked.
    floors = {r["fold"]: r["floor"] for r in first.agg(F.when(F.count("*") == max_features, F.min("count")).otherwise(1).alias("floor")).collect()}
    floors = {fold: floors.get(fold, 1) for fold in folds}
    candidates = written(total.where(F.col("__ttf") >= min(floors.values(), default=1)), "candidate-terms")
    each = [F.struct(F.lit(fold).alias("fold"), F.lit(floor).cast("bigint").alias("floor")) for fold, floor in floors.items()]
    each = F.array(*each) if each else F.array().cast(f"array<struct<fold:{kind},floor:bigint>>")
    grid = candidates.select("*", F.inline(each)).where(F.col("__ttf") >= F.col("floor")).drop("floor")
    both = held_out(grid, own.join(candidates.select("term"), "term"))
    kept = top_k(both, ["fold"], [F.desc("count"), F.col("term")], max_features)
    if docs is None:
        docs = terms.groupBy(group).agg(F.countDistinct(row_id).alias("__n"))
    n = docs.withColumn("__all", docs.agg(F.sum("__n")).scalar()).select(
        F.col(group).alias("fold"), (F.col("__all") - F.col("__n")).alias("__train"))
    idf = F.log((F.lit(1.0) + F.col("__train")) / (1.0 + F.col("df"))) + 1.0
    return kept.join(n, "fold").select("fold", "term", "count", idf.alias("idf"))


def held_out_tfidf(terms: DataFrame, vocabulary: DataFrame, row_id: str, group: str) -> DataFrame:
    """L2-normalised (row, term, weight) of each row under the vocabulary of its own fold."""
    # The vocabulary is written, so that terms outside of it are left out before anything moves.
    rows = terms.withColumnRenamed(group, "fold").join(written(vocabulary, "vocabulary"), ["fold", "term"])
    rows = rows.withColumn("__w", (1.0 + F.log("tf")) * F.col("idf"))
    # A row has at most as many terms as the vocabularies, so its window is bounded.
    rows = rows.withColumn("__sq", F.sum(F.col("__w") * F.col("__w")).over(Window.partitionBy(row_id)))
    return rows.select(row_id, "fold", "term", (F.col("__w") / F.sqrt("__sq")).alias("weight"))


# ---- baselines ---------------------------------------------------------------------

def condition_prior(df: DataFrame, condition: str, group: str, label: str) -> DataFrame:
    """Adds the Laplace-smoothed log-odds of the row's condition without the row's own group."""
    own = df.groupBy(condition, group).agg(F.sum(label).alias("__s"), F.count("*").alias("__n"))
    total = own.groupBy(condition).agg(F.sum("__s").alias("__ts"), F.sum("__n").alias("__tn"))
    table = null_safe_join(own, total, [condition])
    p = (F.col("__ts") - F.col("__s") + 1.0) / (F.col("__tn") - F.col("__n") + 2.0)
    table = table.select(condition, group, F.log(p / (1 - p)).alias("score"))
    return null_safe_join(df, table, [condition, group])


def majority(df: DataFrame, value: float = 1.0) -> DataFrame:
    return df.withColumn("score", F.lit(value))


def long_predictions(parts: dict[str, DataFrame], columns: Sequence[str]) -> DataFrame:
    """(monitor, columns..., score) rows of several monitors."""
    out = None
    for name, df in parts.items():
        rows = df.select(F.lit(name).alias("monitor"), *columns, F.col("score").cast("double").alias("score"))
        out = rows if out is None else out.unionByName(rows)
    return out


# ---- fitted folds ------------------------------------------------------------------

@dataclass
class Fold:
    """A held-out group: affine map z = x * weight (x W for a matrix, x itself for None) + offset, and its fit."""

    number: int
    weight: np.ndarray | None
    offset: np.ndarray
    class_weight: tuple
    beta: np.ndarray
    converged: bool = True


def _scales(sums: dict, total: tuple) -> dict:
    """Standardising map of each fold; a constant feature is left unscaled."""
    out = {}
    for f, own in sums.items():
        n, one, two = (t - o for t, o in zip(total, own))
        mean = one / n
        std = np.sqrt(np.clip(two / n - mean * mean, 0, None))
        weight = 1 / np.where(std > 1e-12, std, 1.0)
        out[f] = weight, -mean * weight, True
    return out


def _sums_of(rows: DataFrame, *keys: str) -> DataFrame:
    squares = F.transform("__x", lambda v: v * v)
    rows = rows.withColumn("__x2", squares)
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), vector_sum("__x").alias("one"), vector_sum("__x2").alias("two"))


def group_held_out_scores(df: DataFrame, row_id: str, group: str, label: str, features: Column, dim: int,
                          transform: str | None = None, components: int = 8, c: float = 1.0, train: Column | None = None,
                          test: Column | None = None, iterations: int = 50, tol: float = 1e-8,
                          block_state: int = BLOCK_STATE) -> DataFrame:
    """(row, group, label, score, converged): logistic decision value of every test row from a model without the row's group.

    L2 penalty 1/(2c) on the coefficients, balanced classes, each group weighs
    one in total.  Steps that raise the loss are halved; ``converged`` is false where
    ``iterations`` passes did not end in a step below ``tol``.

    Defined cases: a null group is a group of its own; a row without a label, or
    whose features are null, not ``dim`` long or not finite numbers, trains nothing,
    and such features give a null score; a fold whose training rows hold one class
    gives null scores and a null ``converged``; no rows give no rows.
    """
    if transform not in (None, "scale", "pca"):
        raise ValueError(transform)
    flag = lambda x: F.lit(True) if x is None else x
    odd = F.exists("__x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    rows = df.select(F.col(row_id).alias("__id"), F.col(group).alias("__g"), F.col(label).cast("int").alias("__y"),
                     features.alias("__x"), flag(train).alias("__train"), flag(test).alias("__test"))
    rows = rows.withColumn("__x", F.when((F.size("__x") == dim) & ~odd, F.col("__x")))
    rows = rows.withColumn("__train", F.coalesce(F.col("__train") & F.col("__y").isin(0, 1) & F.col("__x").isNotNull(), F.lit(False)))
    types = dict(df.dtypes)
    keys = sorted((r[0] for r in rows.select("__g").distinct().collect()), key=lambda v: (v is not None, v))
    numbers = df.sparkSession.createDataFrame(list(enumerate(keys)), f"__f int, __g {types[group]}")
    # Every Newton step reads the rows again, so the features are written once.
    rows = cut_lineage(null_safe_join(rows, numbers, ["__g"]))
    fit = rows.where("__train").select("__f", "__y", "__x")
    own = np.zeros((len(keys), 2), np.int64)
    for r in fit.groupBy("__f", "__y").agg(F.count("*").alias("n")).collect():
        own[r["__f"], r["__y"]] = r["n"]
    left = own.sum(axis=0) - own
    size = np.maximum(1, own.sum(axis=1))
    usable = [f for f in range(len(keys)) if left[f].min() > 0]

    width = min(components, dim) if transform == "pca" else dim
    state = 2 * (width + 1) * (width + 2) + 2 * dim * (foldpca.basis_size(dim, components) + width if transform == "pca" else 2)
    if transform == "pca" and usable:
        n, mean, matrix = foldpca.scatter(fit, dim)
    elif transform == "scale" and usable:
        row = _sums_of(fit).first()
        total = row["n"], np.asarray(row["one"]), np.asarray(row["two"])
    step, scored = max(1, block_state // state), []
    for at in range(0, len(usable), step):
        block = usable[at : at + step]
        mine = fit.where(F.col("__f").between(block[0], block[-1])).select("__f", "__x")
        if transform:
            none = 0, np.zeros(dim), np.zeros(dim)
            sums = dict.fromkeys(block, none)
            sums.update({r["__f"]: (r["n"], np.asarray(r["one"]), np.asarray(r["two"])) for r in _sums_of(mine, "__f").collect() if r["__f"] in sums})
            if transform == "pca":
                maps = foldpca.held_out_components(mine, {f: v[:2] for f, v in sums.items()}, n, mean, matrix, components)
            else:
                maps = _scales(sums, total)
        else:
            maps = {f: (None, np.zeros(dim), True) for f in block}
        folds = []
        for f in block:
            weight, offset, good = maps[f]
            balance = tuple(left[f].sum() / (2 * left[f]))
            folds.append(Fold(f, weight, offset, balance, np.zeros(len(offset) + 1), good))
        _fit(fit, folds, size, c, iterations, tol)
        scored.append(_score(rows.where(F.col("__f").between(block[0], block[-1])), folds))
    out = None
    for part in scored:
        out = part if out is None else out.unionByName(part)
    unfit = rows.where(~F.col("__f").isin(usable)) if len(usable) < len(keys) or not keys else None
    if unfit is not None:
        rest = unfit.where("__test").select("__id", "__g", "__y", F.lit(None).cast("double").alias("score"), F.lit(None).cast("boolean").alias("converged"))
        out = rest if out is None else out.unionByName(rest)
    return out.select(F.col("__id").alias(row_id), F.col("__g").alias(group), F.col("__y").alias("label"), "score", "converged")


def _fit(rows: DataFrame, folds: list[Fold], size: np.ndarray, c: float, iterations: int, tol: float) -> None:
    """Newton's method with step halving, all folds in one pass over the rows a step."""
    trial = {f.number: f.beta for f in folds}
    loss, move, active = {}, {}, list(folds)
    for _ in range(iterations):
        if not active:
            return
        sums, still = _newton_sums(rows, active, trial, size), []
        for f in active:
            i, k = f.number, len(f.offset) + 1
            penalty = np.r_[np.full(k - 1, 1.0 / c), 0.0]
            value = sums[i][0] + (penalty * trial[i] ** 2).sum() / 2
            if i in loss and not value <= loss[i] + 1e-12 * abs(loss[i]):
                move[i] = move[i] / 2
            else:
                f.beta, loss[i] = trial[i], value
                gradient = sums[i][1 : k + 1] + penalty * f.beta
                move[i] = np.linalg.solve(sums[i][k + 1 :].reshape(k, k) + np.diag(penalty + 1e-12), gradient)
            trial[i] = f.beta - move[i]
            if np.max(np.abs(move[i])) > tol:
                still.append(f)
            elif value <= loss[i]:
                f.beta = trial[i]
        active = still
    for f in active:
        f.converged = False


def _newton_sums(rows: DataFrame, folds: list[Fold], beta: dict, size: np.ndarray) -> dict:
    # Plain values only, so that tasks need nothing but numpy and pandas.
    plans = [(f.number, f.weight, f.offset, beta[f.number], f.class_weight) for f in folds]

    def mapped(x, weight, offset):
        z = x if weight is None else x * weight if weight.ndim == 1 else x @ weight
        return np.c_[z + offset, np.ones(len(x))]

    def partial(batches):
        import pandas as pd

        acc = {}
        for batch in batches:
            if batch.empty:
                continue
            x, y, g = np.stack(batch["__x"].to_numpy()), batch["__y"].to_numpy(), batch["__f"].to_numpy()
            base = 1.0 / size[g]
            for held, weight, offset, b, balance in plans:
                z = mapped(x, weight, offset)
                w = base * np.where(y == 1, balance[1], balance[0]) * (g != held)
                at = z @ b
                p = 1 / (1 + np.exp(-np.clip(at, -500, 500)))
                loss = w @ np.logaddexp(0, np.where(y == 1, -at, at))
                part = np.concatenate([[loss], z.T @ (w * (p - y)), ((z * (w * p * (1 - p))[:, None]).T @ z).ravel()])
                acc[held] = acc[held] + part if held in acc else part
        yield pd.DataFrame({"fold": pd.Series(list(acc), dtype="int32"), "sums": [a.tolist() for a in acc.values()]})

    parts = rows.mapInPandas(partial, "fold int, sums array<double>")
    total = parts.groupBy("fold").agg(vector_to_array(Summarizer.sum(array_to_vector("sums"))).alias("s"))
    return {r["fold"]: np.asarray(r["s"]) for r in total.collect()}


def _score(rows: DataFrame, folds: list[Fold]) -> DataFrame:
    """Scores of the test rows of these folds; the map and the fit are one linear form a fold."""
    forms = {}
    for f in folds:
        slope = f.beta[:-1] if f.weight is None else f.weight * f.beta[:-1] if f.weight.ndim == 1 else f.weight @ f.beta[:-1]
        forms[f.number] = [slope.tolist(), float(f.offset @ f.beta[:-1] + f.beta[-1]), bool(f.converged)]
    table = rows.sparkSession.createDataFrame([(f, *v) for f, v in forms.items()], "__f int, __slope array<double>, __at double, converged boolean")
    product = F.aggregate(F.zip_with("__x", "__slope", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    return rows.where("__test").join(table, "__f").select("__id", "__g", "__y", (product + F.col("__at")).alias("score"), "converged")


# ---- any estimator per fold --------------------------------------------------------

def scores_by_fold(df: DataFrame, group: str, fit_predict: Callable[[DataFrame, DataFrame], DataFrame], max_folds: int = 200) -> DataFrame:
    """Union of fit_predict(train, test) over held-out groups; for estimators that need a fit of their own."""
    groups = [r[0] for r in df.select(group).distinct().limit(max_folds + 1).collect()]
    if len(groups) > max_folds:
        raise ValueError(f"more than {max_folds} folds")
    out = None
    for g in sorted(groups):
        part = fit_predict(df.where(F.col(group) != g), df.where(F.col(group) == g))
        out = part if out is None else out.unionByName(part)
    return out


def spark_logistic(features: str, label: str, weight: str, keep: Sequence[str], c: float = 1.0) -> Callable:
    """fit_predict over Spark ML: the summed loss is averaged there, so the penalty is 1 / (c * sum of weights)."""
    from pyspark.ml.classification import LogisticRegression

    def fit_predict(train: DataFrame, test: DataFrame) -> DataFrame:
        total = train.agg(F.sum(weight)).first()[0]
        model = LogisticRegression(
            featuresCol=features, labelCol=label, weightCol=weight, regParam=1.0 / (c * total), elasticNetParam=0.0,
            standardization=False, maxIter=100, tol=1e-8).fit(train)
        raw = vector_to_array("rawPrediction")[1]
        return model.transform(test).select(*keep, raw.alias("score"))

    return fit_predict
