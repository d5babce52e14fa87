"""Held-out-group logistic regression on sparse text features.

Every fold has a vocabulary of its own and is fitted on the rows of all other
groups.  The rows are written once, with the counts of the terms that any fold
has; a pass reads them and gives every row to all folds that are not done: tf-idf
and norm under a fold's vocabulary are products of the counts with the fold's
idf, so neither rows nor features are written, joined or exchanged once a fold.
Loss and gradient are sums in the tasks, one vector a fold and task.  The state of all L-BFGS
runs is a table with one row a fold, which a pass replaces: nothing is fitted on
the driver, which hands the trial coefficients on, and no curvature matrix is
built.  A row of the state holds as many numbers as there are terms a few times over, and a
task works on ``BLOCK_ROWS`` rows at once.  Every fold trains on all other rows, so the
work, not the disk, grows with folds x rows; the number of folds is checked.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StructType

from runsift.operators.models import fold_vocabulary, grams, words
from runsift.session import delete_path, scratch_path

BLOCK_ROWS = 256
#: Numbers in the dense counts of one block, which has fewer rows if there are many terms.
BLOCK_CELLS = 1 << 20
#: Hashed counters of the terms.
SLOTS = 1 << 19
#: Pairs of steps and gradient changes that a run remembers.
MEMORY = 8


def _written(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def frequent_terms(base: DataFrame, row_id: str, min_df: int, max_features: int, max_folds: int, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (row, key, term, tf) of frequent terms, and the vocabulary of every fold, of texts (row, key, words).

    No term comes more often than its hashed counter says, so terms whose counter
    is below the last count in every vocabulary are in none.  Counted one by one are only the terms
    of large counters, down to what a vocabulary without the largest group should need; should one of the vocabularies
    reach below that, they are counted again from there.
    """
    slot = F.pmod(F.xxhash64("term"), F.lit(SLOTS))
    slots = _written(grams(base, "words").groupBy(slot.alias("slot")).agg(F.count("*").alias("n")), "text-slots")
    top = slots.orderBy(F.desc("n")).limit(max_features).agg(F.count("*").alias("slots"), F.min("n").alias("n")).first()
    floor, size = min_df, docs.agg(F.count("*").alias("folds"), F.max("__n").alias("most"), F.sum("__n").alias("all")).first()
    if top["slots"] == max_features:  # a fifth below, because a counter holds rare terms as well
        floor = max(min_df, int(0.8 * top["n"] * (1 - size["most"] / size["all"])))
    while True:
        kept = _written(slots.where(F.col("n") >= floor).select("slot"), "text-kept")  # small, so that terms meet it without an exchange
        # Texts are dealt by row, so that the counts of a row are made where its text is.
        found = grams(base.repartition(row_id, "key"), "words", [row_id, "key"]).withColumn("slot", slot).join(kept, "slot")
        terms = _written(found.groupBy(row_id, "key", "term").agg(F.count("*").alias("tf")), "text-terms")
        vocabulary = _written(fold_vocabulary(terms, row_id, "key", min_df, max_features, max_folds, docs), "text-vocabulary")
        full = vocabulary.groupBy("fold").agg(F.count("*").alias("terms"), F.min("count").alias("last")).where(F.col("terms") == max_features)
        full = full.agg(F.count("*").alias("folds"), F.min("last").alias("last")).first()
        last = max(min_df, full["last"]) if full["folds"] and full["folds"] == size["folds"] else min_df
        if floor <= last:
            return terms, vocabulary
        floor = last


class _Table:
    """What every task knows: the groups, the weights of the folds, and the idf of every fold and term (0: not in its vocabulary)."""

    def __init__(self, groups: list[str], sizes: list[int], folds: list[str], weights: np.ndarray, idf: np.ndarray):
        self.groups, self.sizes, self.idf, self.weights = groups, np.array(sizes, np.float64), idf, weights
        at = {fold: i for i, fold in enumerate(folds)}
        self.folds, self.at = folds, at
        self.group_at = {g: i for i, g in enumerate(groups)}
        #: The fold that a group is held out from, or -1.
        self.own = np.array([at.get(g, -1) for g in groups], np.int64)

    def blocks(self, keys, cells, most: int):
        """Blocks of rows: their place, group, sums and sums of squares of 1 + ln tf by row and term."""
        size = self.idf.shape[1]
        step = max(1, min(most, BLOCK_CELLS // max(1, size)))
        group = np.array([self.group_at[k] for k in keys], np.int64)
        for first in range(0, len(group), step):
            part = [np.asarray(c, np.int64) for c in cells[first : first + step]]
            flat = np.concatenate([*part, np.zeros(0, np.int64)])
            spot = np.repeat(np.arange(len(part)), [len(c) for c in part]) * size + (flat >> 32)
            w = 1.0 + np.log(flat & 0xFFFFFFFF)
            dense = lambda v: np.bincount(spot, v, len(part) * size).reshape(len(part), size)
            yield slice(first, first + len(part)), group[first : first + len(part)], dense(w), dense(w * w)


def _norms(squares: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Norm of every row under every fold's vocabulary, 1 for a row without its terms."""
    norm = np.sqrt(squares @ (idf * idf).T)
    return np.where(norm > 0, norm, 1.0)


def _sums(table: Broadcast, trial: Broadcast, most: int):
    """mapInPandas function over rows (key, y, cells): loss and gradient (intercept last) of every fold at its trial point."""

    def run(batches):
        known, (folds, trials) = table.value, trial.value
        at = np.array([known.at[f] for f in folds], np.int64)
        idf, (one, zero) = known.idf[at], known.weights[:, at]
        slope, sums = (idf * trials[:, :-1]).T, np.zeros((len(folds), trials.shape[1] + 1))
        seen = False
        for batch in batches:
            labels = batch["y"].to_numpy(np.float64)
            for rows, group, x, squares in known.blocks(batch["key"], list(batch["cells"]), most):
                seen, y, norm = True, labels[rows, None], _norms(squares, idf)
                z = x @ slope / norm + trials[:, -1]
                w = np.where(y == 1, one, zero) / known.sizes[group, None]
                own = known.own[group, None] == at
                loss = np.where(own, 0.0, w * (np.logaddexp(0, z) - y * z))
                rest = np.where(own, 0.0, w * (1 / (1 + np.exp(-np.clip(z, -500, 500))) - y))
                sums[:, 0] += loss.sum(axis=0)
                sums[:, 1:-1] += (rest / norm).T @ x * idf
                sums[:, -1] += rest.sum(axis=0)
        if seen:
            yield pd.DataFrame({"fold": folds, "sums": list(sums)})

    return run


def _scores(table: Broadcast, model: Broadcast, most: int):
    """mapInArrow function over rows (..., key, cells): decision value under the model of the row's own fold, and whether that converged."""

    def run(batches):
        known, (slopes, converged) = table.value, model.value
        for batch in batches:
            score, ended, there = np.zeros(batch.num_rows), np.zeros(batch.num_rows, bool), np.zeros(batch.num_rows, bool)
            cells = batch.column("cells")
            sizes = np.append(0, np.cumsum(cells.value_lengths().to_numpy(zero_copy_only=False)))
            cells = np.split(cells.flatten().to_numpy(), sizes[1:-1]) if batch.num_rows else []
            for rows, group, x, squares in known.blocks(batch.column("key").to_pylist(), cells, most):
                for fold in np.unique(known.own[group]):
                    mine = known.own[group] == fold
                    to = np.arange(rows.start, rows.stop)[mine]
                    if fold >= 0:
                        idf = known.idf[fold]
                        score[to] = x[mine] @ (idf * slopes[fold, :-1]) / _norms(squares[mine], idf[None])[:, 0] + slopes[fold, -1]
                        ended[to], there[to] = converged[fold], True
            keep = [i for i, name in enumerate(batch.schema.names) if name not in ("key", "cells")]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(i) for i in keep], pa.array(score, mask=~there), pa.array(ended, mask=~there)],
                names=[*[batch.schema.names[i] for i in keep], "score", "converged"])

    return run


def _direction(g: np.ndarray, steps: list, changes: list) -> np.ndarray:
    """The two loops of L-BFGS."""
    d, kept = -g, []
    for s, y in reversed(list(zip(steps, changes))):
        a = (s @ d) / (s @ y)
        kept.append(a)
        d = d - a * y
    if steps:
        d = d * ((steps[-1] @ changes[-1]) / (changes[-1] @ changes[-1]))
    for (s, y), a in zip(zip(steps, changes), reversed(kept)):
        d = d + (a - (y @ d) / (s @ y)) * s
    return d


def _step(c: float, tol: float):
    """mapInPandas function over states and the sums at their trial points: the next states."""

    def advance(row) -> dict:
        trial = np.asarray(row.trial)
        n = len(trial)
        penalised = np.append(trial[:-1], 0.0)
        loss = row.sums[0] + penalised @ penalised / (2 * c)
        g = np.asarray(row.sums[1:]) + penalised / c
        x, before, d = (np.asarray(v) for v in (row.x, row.g, row.d))
        steps, changes = (list(np.asarray(v).reshape(-1, n)) for v in (row.steps, row.changes))
        first = not len(d)
        if not first and loss > row.loss + 1e-4 * row.t * (before @ d) and row.t > 1e-12:
            t = row.t / 2  # too far: half the step from the same point
            return {"fold": row.fold, "x": x, "g": before, "d": d, "loss": row.loss, "t": t, "trial": x + t * d,
                    "steps": row.steps, "changes": row.changes, "converged": False}
        if not first and (trial - x) @ (g - before) > 1e-14:
            steps, changes = [*steps, trial - x][-MEMORY:], [*changes, g - before][-MEMORY:]
        d = _direction(g, steps, changes)
        t = 1.0 if steps else min(1.0, 1.0 / max(np.abs(g).sum(), 1e-12))
        flat = lambda rows: np.concatenate([*rows, np.zeros(0)])
        return {"fold": row.fold, "x": trial, "g": g, "d": d, "loss": loss, "t": t, "trial": trial + t * d,
                "steps": flat(steps), "changes": flat(changes), "converged": bool(np.abs(g).max() <= tol)}

    def run(batches):
        for batch in batches:
            rows = [advance(r) for r in batch.itertuples(index=False)]
            if rows:
                yield pd.DataFrame(rows)

    return run


STATE = ", ".join(["fold string", *[f"{v} array<double>" for v in ("x", "g", "d")], "loss double", "t double",
                   *[f"{v} array<double>" for v in ("trial", "steps", "changes")], "converged boolean"])


def _numbers(column: pa.ChunkedArray) -> list[np.ndarray]:
    return [np.asarray(v.values.to_numpy(zero_copy_only=False)) for v in column]


def fit(rows: DataFrame, table: Broadcast, c: float = 1.0, tol: float = 1e-6, passes: int = 100) -> DataFrame:
    """(fold, x, converged) from rows (key, y, cells) and what the tasks know of the folds.

    Minimises the sum of w * log loss plus |x|^2 / (2 c) without the intercept, the
    last number of x; terms outside of a fold's vocabulary stay at 0.  A run ends once no entry of its gradient exceeds ``tol``;
    one that has not after ``passes`` passes says so.
    """
    spark, known = rows.sparkSession, table.value
    none = F.array().cast("array<double>")
    zeros = F.array_repeat(F.lit(0.0), known.idf.shape[1] + 1)
    folds = spark.createDataFrame([(f,) for f in known.folds], "fold string")
    path = scratch_path(spark, "text-state")
    folds.select(
        "fold", zeros.alias("x"), zeros.alias("g"), none.alias("d"), F.lit(float("inf")).alias("loss"), F.lit(1.0).alias("t"),
        zeros.alias("trial"), none.alias("steps"), none.alias("changes"), F.lit(False).alias("converged")).write.parquet(path)
    state = spark.read.schema(STATE).parquet(path)
    for _ in range(passes):
        still = state.where("not converged")
        trials = still.select("fold", "trial").toArrow()
        if not trials.num_rows:
            break
        # Every task needs the coefficients of all folds, and a row goes to all of them without being copied.
        trial = spark.sparkContext.broadcast((trials["fold"].to_pylist(), np.array(_numbers(trials["trial"]))))
        parts = rows.select("key", "y", "cells").mapInPandas(_sums(table, trial, BLOCK_ROWS), "fold string, sums array<double>")
        total = parts.groupBy("fold").agg(vector_to_array(Summarizer.sum(array_to_vector("sums"))).alias("sums"))
        moved = still.join(total, "fold").mapInPandas(_step(c, tol), STATE)
        before, path = path, scratch_path(spark, "text-state")
        moved.unionByName(state.where("converged")).write.parquet(path)
        state = spark.read.schema(STATE).parquet(path)
        trial.destroy()
        delete_path(spark, before)
    return state.select("fold", "x", "converged")


def text_scores(df: DataFrame, row_id: str, group: str, label: str, text: str, max_features: int = 3000, min_df: int = 2,
                c: float = 1.0, tol: float = 1e-6, passes: int = 100, max_folds: int = 2000) -> DataFrame:
    """(row, group, label, score, converged): decision value of each row from a text model without the row's group.

    Balanced classes, each group weighs one in total.  A fold whose training rows
    hold one class gives null.  A null group is a group like any other.
    """
    spark = df.sparkSession
    base = _written(df.select(row_id, group, F.col(label).cast("double").alias("y"), words(F.col(text)).alias("words"),
                              F.to_json(F.struct(F.col(group).alias("g"))).alias("key")), "text-words")
    counts = _written(base.groupBy("key").agg(F.count("*").alias("n"), F.sum("y").alias("ones")), "text-groups")
    terms, vocabulary = frequent_terms(base, row_id, min_df, max_features, max_folds, counts.select("key", F.col("n").alias("__n")))

    # Numbered are the terms of any fold; there are few more than a fold has, since a held-out group replaces few of them.
    place = F.row_number().over(Window.orderBy("term")) - 1
    columns = _written(vocabulary.select("term").distinct().withColumn("place", place), "text-columns")
    size = columns.count()
    cell = F.shiftleft(F.col("place").cast("bigint"), 32).bitwiseOR(F.col("tf"))
    cells = terms.where(F.col(row_id).isNotNull()).join(columns, "term").groupBy(row_id).agg(F.sort_array(F.collect_list(cell)).alias("cells"))
    rows = base.select(row_id, group, "key", "y").join(cells, row_id, "left")
    rows = _written(rows.withColumn("cells", F.coalesce("cells", F.array().cast("array<bigint>"))), "text-rows")

    left = counts.agg(F.sum("n")).scalar().cast("double") - F.col("n")
    ones = counts.agg(F.sum("ones")).scalar() - F.col("ones")
    folds = counts.select(F.col("key").alias("fold"), left.alias("left"), ones.alias("ones")).where((F.col("ones") > 0) & (F.col("ones") < F.col("left")))
    folds = folds.select("fold", F.col("left") / (2 * F.col("ones")), F.col("left") / (2 * (F.col("left") - F.col("ones")))).orderBy("fold")
    folds = folds.limit(max_folds).collect()  # fold_vocabulary has checked their number
    groups = counts.select("key", "n").limit(max_folds).collect()
    at, idf = {f[0]: i for i, f in enumerate(folds)}, np.zeros((len(folds), size))
    entries = vocabulary.join(columns, "term").select("fold", "place", "idf").toArrow()
    fold = np.array([at.get(f, -1) for f in entries["fold"].to_pylist()], np.int64)
    idf[fold[fold >= 0], entries["place"].to_numpy()[fold >= 0]] = entries["idf"].to_numpy()[fold >= 0]
    weights = np.array([f[1:] for f in folds]).reshape(len(folds), 2).T
    table = spark.sparkContext.broadcast(_Table([g[0] for g in groups], [g[1] for g in groups], list(at), weights, idf))

    model = fit(rows, table, c, tol, passes).toArrow()
    slopes, converged = np.zeros((len(folds), size + 1)), np.zeros(len(folds), bool)
    to = [at[f] for f in model["fold"].to_pylist()]
    if to:
        slopes[to], converged[to] = np.array(_numbers(model["x"])), model["converged"].to_numpy(zero_copy_only=False)
    told = spark.sparkContext.broadcast((slopes, converged))
    own = rows.select(row_id, group, F.col("y").cast("int").alias("label"), "key", "cells")
    schema = StructType([*own.select(row_id, group, "label").schema]).add("score", DoubleType()).add("converged", BooleanType())
    return own.mapInArrow(_scores(table, told, BLOCK_ROWS), schema)
