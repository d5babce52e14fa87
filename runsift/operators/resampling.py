"""Permutation and bootstrap tests.

Draws come from seeded hashes of (seed, repetition, unit), so a lost task
recomputes the same draw and the result does not depend on partitioning.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runsift.functions.projections import is_finite
from runsift.operators.metrics import balanced, bundle_of, roc_auc
from runsift.operators.scale import global_row_number, null_safe_join
from runsift.operators.trajectories import moves, strata
from runsift.session import cut_lineage, scratch_path

#: Groups of a block, and draws that a task makes at a time.
PLACES, DRAWN = 2048, 1 << 18
CELLS = ["tp", "fn", "fp", "tn"]


def permute_labels(df: DataFrame, group: str, variant: str, label: str, repetitions: int, seed: int) -> DataFrame:
    """Label vectors moved as a whole between groups with the same variants.

    Returns (rep, group, variant, permuted).  Groups alone in their stratum keep
    their labels.
    """
    places = strata(df, group, variant)
    moved = moves(places, group, repetitions, seed).select("rep", group, F.col("source").alias("__source"))
    labels = df.select(F.col(group).alias("__source"), variant, F.col(label).alias("permuted"))
    return null_safe_join(moved, labels, ["__source"]).select("rep", group, variant, "permuted")


def permutation_p(null: DataFrame, observed: Column, statistic: str) -> DataFrame:
    """(1 + how often the null reaches the observed value) / (repetitions + 1), and the 95% null quantile."""
    hits = F.count_if(F.col(statistic) >= observed)
    return null.agg(
        F.count(statistic).alias("repetitions"), ((hits + 1) / (F.count(statistic) + 1)).alias("p_value"),
        F.percentile(statistic, F.lit(0.95)).alias("null_q95"))


def max_statistic(df: DataFrame, rep: str, statistic: str) -> DataFrame:
    """Largest statistic over all layers of each repetition."""
    return df.groupBy(rep).agg(F.max(statistic).alias(statistic))


def _drawn(groups: DataFrame, group: str, repetitions: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """(rep, block, picks) and the places (block, at, group) of the groups.

    ``picks`` holds the drawn places of a block as 16-bit offsets, one for each draw.
    A task draws ``DRAWN`` places at a time, so neither the groups nor the draws
    of a repetition are ever whole in one.
    """
    spark = groups.sparkSession
    places = global_row_number(groups.select(group).distinct(), [], [group], "__i")
    n, total = places.agg(F.count("*"), F.count(group)).first()
    place = F.col("__i") - 1
    places = places.select(F.floor(place / PLACES).alias("block"), (place % PLACES).alias("at"), group)
    chunks = -(-n // DRAWN) if total else 0

    def hashed(head, tails):
        """The first 48 bits of the SHA-256 of ``head`` and each tail; the head is taken in once and its state copied."""
        start, digests = hashlib.sha256(head).copy, []
        for tail in tails:
            state = start()
            state.update(tail)
            digests.append(state.digest())
        return (np.frombuffer(b"".join(digests), ">u8")[::4] >> np.uint64(16)).astype(np.int64)

    def draw(batches):
        held, numbers = None, []
        for batch in batches:
            for unit in batch["id"].tolist():
                chunk, rep = divmod(unit, repetitions)
                if chunk != held:  # the units of a task share the numbers of a chunk
                    held, first = chunk, chunk * DRAWN
                    numbers = [b"%d" % i for i in range(first + 1, min(n, first + DRAWN) + 1)]
                picks = np.sort(hashed(f"{seed}:{rep}:".encode(), numbers) % total)
                block, start = np.unique(picks // PLACES, return_index=True)
                parts = np.split((picks % PLACES).astype("<u2"), start[1:])
                yield pd.DataFrame({"rep": np.full(len(block), rep), "block": block, "picks": [x.tobytes() for x in parts]})

    # A unit is dear for the eight bytes it reads, so the number of tasks is not left to the size of the rows.
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    units = spark.range(0, repetitions * chunks, 1, min(4 * tasks, max(1, repetitions * chunks)))
    return units.mapInPandas(draw, "rep bigint, block bigint, picks binary"), places


def group_draws(groups: DataFrame, group: str, repetitions: int, seed: int) -> DataFrame:
    """(rep, group, times): as many groups as there are, drawn with replacement.

    A draw is 48 bits of the SHA-256 of seed, repetition and place, so any
    engine can repeat it.
    """
    drawn, places = _drawn(groups, group, repetitions, seed)

    def count(batches):
        for batch in batches:
            for rep, block, picks in zip(batch["rep"], batch["block"], batch["picks"]):
                at, times = np.unique(np.frombuffer(picks, "<u2"), return_counts=True)
                yield pd.DataFrame({"rep": np.full(len(at), rep), "block": np.full(len(at), block), "at": at.astype(np.int64), "times": times})

    counted = drawn.mapInPandas(count, "rep bigint, block bigint, at bigint, times bigint")
    counted = counted.groupBy("rep", "block", "at").agg(F.sum("times").alias("times"))
    # Written, as its estimate would be that of the units, and a join would broadcast it.
    path = scratch_path(groups.sparkSession, "draws")
    counted.write.parquet(path)
    counted = groups.sparkSession.read.schema(counted.schema).parquet(path)
    return counted.join(places, ["block", "at"]).select(F.col("rep").cast("int").alias("rep"), group, "times")


def comparison(long: DataFrame, keys: Sequence[str], label: str, score: str, group: str, repetitions: int = 5000,
               seed: int = 20260710) -> DataFrame:
    """Monitors stacked in long form beside all metrics and the bootstrap bounds of the balanced accuracy.

    All monitors share the draws, so their bounds can be compared.  Rows without
    a finite score count for no monitor; a monitor whose draws never hold both
    classes has null bounds.
    """
    rows = cut_lineage(long.where(is_finite(F.col(score))).select(*keys, group, label, score))
    bounds = cluster_bootstrap(rows, keys, group, label, score, "balanced_accuracy", repetitions, seed)
    return null_safe_join(bundle_of(rows, keys, label, score, group), bounds, list(keys), "left")


def _drawn_counts(cells: DataFrame, keys: Sequence[str], drawn: DataFrame, places: DataFrame, group: str) -> DataFrame:
    """(keys..., rep, counts): the cells of the drawn groups added up, by products of a block's draws and cells."""
    # Keys travel as text and numbers are joined back, so that they may have any type.
    text = F.to_json(F.struct(*keys)) if keys else F.lit("")
    cells = cut_lineage(cells.withColumn("key", text))
    names = cells.select("key", *keys).groupBy("key").agg(*[F.first(k).alias(k) for k in keys], F.lit(1).alias("one"))
    cells = cells.join(places, group).select("block", "at", "key", *CELLS)

    def add(draws, cells):
        out = []
        reps = np.unique(draws["rep"])
        for some in np.array_split(reps, max(1, -(-len(reps) // 256))) if len(cells) else []:
            mine = draws[draws["rep"].isin(some)]
            where = np.searchsorted(some, mine["rep"]) * PLACES
            codes = np.concatenate([w + np.frombuffer(x, "<u2") for w, x in zip(where, mine["picks"])])
            times = np.bincount(codes, minlength=len(some) * PLACES).reshape(-1, PLACES).astype(float)
            for key, rows in cells.groupby("key"):
                sums = times[:, rows["at"]] @ rows[CELLS].to_numpy(float)  # whole numbers, exact as doubles
                out.append(pd.DataFrame({"key": key, "rep": some, **dict(zip(CELLS, sums.round().astype(np.int64).T))}))
        return pd.concat(out) if out else pd.DataFrame({k: [] for k in ["key", "rep", *CELLS]})

    # Draws and cells of a block meet by key: at most repetitions x PLACES draws on average, whatever the number of groups.
    sums = drawn.groupBy("block").cogroup(cells.groupBy("block")).applyInPandas(
        add, "key string, rep bigint, " + ", ".join(f"{c} bigint" for c in CELLS))
    sums = sums.groupBy("key", "rep").agg(*[F.sum(c).alias(c) for c in CELLS])
    return sums.join(names, "key").select(*keys, "rep", *CELLS)


def cluster_bootstrap(df: DataFrame, keys: Sequence[str], group: str, label: str, score: str, metric: str = "balanced_accuracy",
                      repetitions: int = 5000, seed: int = 20260710) -> DataFrame:
    """2.5 and 97.5 percentiles of a metric over group draws; one-class draws are skipped.

    Balanced accuracy needs only each group's four counts; AUC the counts per
    (group, score).  Draws multiply those small tables, never the rows.
    """
    pos, pred = F.col(label) == 1, F.col(score) >= 0
    if metric == "balanced_accuracy":
        cells = df.groupBy(*keys, group).agg(
            F.count_if(pos & pred).alias("tp"), F.count_if(pos & ~pred).alias("fn"),
            F.count_if(~pos & pred).alias("fp"), F.count_if(~pos & ~pred).alias("tn"))
        drawn = _drawn_counts(cells, keys, *_drawn(df, group, repetitions, seed), group)
        values = drawn.select(*keys, "rep", balanced(*map(F.col, CELLS)).alias("value"))
    elif metric == "roc_auc":
        cells = df.groupBy(*keys, group, label, score).agg(F.count("*").alias("__n"))
        draws = group_draws(df, group, repetitions, seed)
        drawn = cells.join(draws, group).withColumn("__w", (F.col("__n") * F.col("times")).cast("double"))
        values = roc_auc(drawn, [*keys, "rep"], label, score, "__w", "value")
    else:
        raise ValueError(metric)
    bound = lambda q: F.percentile("value", F.lit(q))
    return values.where("value is not null").groupBy(*keys).agg(
        F.count("*").alias("repetitions"), bound(0.025).alias("ci_low"), bound(0.975).alias("ci_high"))
