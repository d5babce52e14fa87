"""Null distribution of held-out centroid scores when label vectors move between groups.

A repetition only names a source group for each group, so a class sum of a group is
one of as many vectors as its stratum has groups, whatever the number of repetitions.
Unit vectors are packed into bundles of one group; bundles times the labels of all
sources give those sums, sums picked by source give the class sums of every
repetition, and bundles times the centroids of a block of repetitions give scores.
All three are matrix products inside tasks: vectors are read once and never copied
for a repetition, and a hot group is many bundles.

A row of the tables holds (groups of a stratum) x (vector length) numbers, or
``BLOCK`` x (vector length).  The scores are rows x repetitions, as the exact
statistic of each repetition needs them all; for areas they are ranked where they are made.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runsift.operators.scale import global_row_number, null_safe_join
from runsift.operators.vectors import doubles, l2_normalise, vector_sum
from runsift.session import scratch_path

#: Rows of a bundle, about, and repetitions scored together.
BUNDLE, BLOCK = 256, 250


def _written(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _tasks(df: DataFrame) -> int:
    spark = df.sparkSession
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def strata(df: DataFrame, group: str, variant: str) -> DataFrame:
    """(group, stratum, pos): groups with the same variants share a stratum and are numbered in it from 1.

    Coverage is an order-free fingerprint, so no group is collected.
    """
    cover = df.groupBy(group).agg(F.sum(F.xxhash64(variant).cast("decimal(38,0)")).alias("__h"), F.count("*").alias("__c"))
    cover = cover.select(group, F.concat_ws(":", "__h", "__c").alias("stratum"))
    return global_row_number(cover, ["stratum"], [group], "pos")


def moves(places: DataFrame, group: str, repetitions: int, seed: int) -> DataFrame:
    """(rep, group, stratum, pos, source, source_pos): for each repetition the group whose labels a group takes.

    In a repetition the groups of a stratum are ordered by SHA-256 of
    ``seed:rep:group``; the group numbered p takes the labels of the p-th of them.
    """
    reps = places.select(F.col(group).alias("source"), "stratum", F.col("pos").alias("source_pos"),
                         F.explode(F.sequence(F.lit(0), F.lit(repetitions - 1))).alias("rep"))
    order = F.sha2(F.concat_ws(":", F.lit(seed), "rep", F.coalesce(F.col("source").cast("string"), F.lit(""))), 256)
    drawn = global_row_number(reps.withColumn("__o", order), ["rep", "stratum"], ["__o", "source_pos"], "pos").drop("__o")
    return drawn.join(places, ["stratum", "pos"]).select("rep", group, "stratum", "pos", "source", "source_pos")


def _scored_bundles(df: DataFrame, row_id: str, group: str, variant: str, label: str, vec: str, keys: list[str],
                    repetitions: int, seed: int, bundle: int, block: int) -> tuple[DataFrame, DataFrame, str]:
    """(k0..., block, stratum, pos, part, n, u, labels, src, c): bundles beside the centroids of their group; the bundles; the schema of the keys."""
    rows = df.where(F.col(vec).isNotNull())
    places = _written(strata(df.select(group, variant).distinct(), group, variant), "strata")
    known = null_safe_join(df.groupBy(group, variant).agg(F.coalesce(F.max(label).cast("int"), F.lit(0)).alias("__l")), places, [group])
    known = known.groupBy("stratum", variant).agg(F.sort_array(F.collect_list(F.struct("pos", "__l"))).alias("__l"))
    known = known.select("stratum", variant, F.transform("__l", lambda x: x["__l"]).alias("labels"))
    size = F.ceil(F.count("*") / bundle)
    rows = rows.select(row_id, group, variant, *keys, l2_normalise(doubles(F.col(vec))).alias("__u"))
    counts = rows.groupBy(*keys, group).agg(size.alias("__b"))
    rows = null_safe_join(null_safe_join(rows, counts, [*keys, group]), places, [group])
    rows = null_safe_join(rows, known, ["stratum", variant])
    dealt = rows.groupBy(*keys, "stratum", "pos", F.pmod(F.xxhash64(row_id), F.col("__b")).alias("part")).agg(
        F.flatten(F.collect_list("__u")).alias("u"), F.flatten(F.collect_list("labels")).alias("labels"), F.count("*").alias("n"))
    bundles = _written(dealt, "bundles")

    def own_sums(batches):
        """Sums of the unit vectors and their number (last) by source, over the rows its labels call 1; then over all rows."""
        import pandas as pd

        for batch in batches:
            out = []
            for u, lab, n in zip(batch["u"], batch["labels"], batch["n"]):
                u, lab = np.c_[u.reshape(n, -1), np.ones(n)], lab.reshape(n, -1).astype(float)
                out.append(np.vstack([lab.T @ u, u.sum(axis=0)]).ravel())
            yield pd.DataFrame({**{k: batch[k] for k in [*keys, "stratum", "pos"]}, "sums": out})

    kinds = dict(bundles.dtypes)
    head = ", ".join(f"`{k}` {kinds[k]}" for k in keys)
    head = f"{head}, " if head else ""
    place = "stratum string, pos bigint"
    sums = bundles.mapInPandas(own_sums, f"{head}{place}, sums array<double>")
    sums = _written(sums.groupBy(*keys, "stratum", "pos").agg(vector_sum("sums").alias("sums")), "group-sums")
    drawn = moves(places, group, repetitions, seed).withColumn("block", F.floor(F.col("rep") / block))
    drawn = drawn.groupBy("stratum", "pos", "block").agg(F.sort_array(F.collect_list(F.struct("rep", "source_pos"))).alias("d"))
    drawn = _written(drawn.select("stratum", "pos", "block", F.transform("d", lambda x: x["source_pos"] - 1).alias("src")), "moves")
    # Every stratum's positions count its groups, so a table of sums has one row more than its stratum has groups.
    most = known.select("stratum", F.size("labels").alias("m")).distinct().groupBy("stratum").agg(F.max("m").alias("m"))
    picked = _written(sums.join(most, "stratum").join(drawn, ["stratum", "pos"]), "picked-sums")

    def picks(table, m, src):
        table = table.reshape(m + 1, -1)
        ones = table[src]
        return ones, table[m] - ones

    def class_sums(batches):
        import pandas as pd

        for batch in batches:
            total = {}
            for row in batch.itertuples(index=False):
                key = tuple(getattr(row, f"k{i}") for i in range(len(keys))) + (row.block,)
                both = np.stack(picks(row.sums, row.m, row.src))
                total[key] = total[key] + both if key in total else both
            if total:
                out = pd.DataFrame(list(total), columns=[*keys, "block"])
                out["total"] = [v.ravel() for v in total.values()]
                yield out

    named = picked.select(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], "block", "sums", "m", "src")
    totals = named.mapInPandas(class_sums, f"{head}block bigint, total array<double>")
    totals = _written(totals.groupBy(*keys, "block").agg(vector_sum("total").alias("total")), "class-sums")

    def centroids(batches):
        """Difference of the unit centroids of both classes without the group, by repetition; nan where a class is missing."""
        import pandas as pd

        for batch in batches:
            out = []
            for table, m, src, total in zip(batch["sums"], batch["m"], batch["src"], batch["total"]):
                rest = total.reshape(2, len(src), -1) - np.stack(picks(table, m, src))
                rest[rest[:, :, -1] < 0.5] = np.nan
                body = rest[:, :, :-1]
                unit = body / np.maximum(np.sqrt((body * body).sum(axis=2, keepdims=True)), 1e-12)
                out.append((unit[0] - unit[1]).ravel())
            yield pd.DataFrame({**{k: batch[k] for k in [*keys, "stratum", "pos", "block"]}, "src": batch["src"], "c": out})

    both = null_safe_join(picked, totals, [*keys, "block"])
    middle = both.mapInPandas(centroids, f"{head}{place}, block bigint, src array<bigint>, c array<double>")
    middle = _written(middle, "centroids")

    pairs = null_safe_join(bundles, middle, [*keys, "stratum", "pos"])
    pairs = pairs.select(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], "block", "stratum", "pos", "part", "n", "u", "labels", "src", "c")
    return pairs, bundles, head


def null_scores(df: DataFrame, row_id: str, group: str, variant: str, label: str, vec: str, by: Sequence[str],
                repetitions: int, seed: int, bundle: int = BUNDLE, block: int = BLOCK) -> DataFrame:
    """(by..., rep, permuted, score) of every row and repetition: unit centroids of the moved labels without the row's group.

    Groups alone in their stratum keep their labels; where a group repeats a
    variant, its largest label counts, and a null label counts as 0; a class without
    rows outside the group gives a null score; a row without a vector takes no part.
    A null group is a group and a null variant a variant.
    """
    keys = list(by)
    pairs, _, head = _scored_bundles(df, row_id, group, variant, label, vec, keys, repetitions, seed, bundle, block)
    # The products are dear for the bytes they read, so their number of tasks is not left to the size of the rows.
    pairs = pairs.repartition(_tasks(df))

    def score(batches):
        import pandas as pd

        for batch in batches:
            for row in batch.itertuples(index=False):
                n, r = int(row.n), len(row.src)
                values = row.u.reshape(n, -1) @ row.c.reshape(r, -1).T
                out = {k: np.repeat(np.array([getattr(row, f"k{i}")]), n * r) for i, k in enumerate(keys)}
                yield pd.DataFrame({
                    **out, "rep": np.tile(row.block * block + np.arange(r), n), "permuted": row.labels.reshape(n, -1)[:, row.src].ravel(),
                    "score": pd.array(values.ravel(), dtype="Float64")})

    out = pairs.mapInPandas(score, f"{head}rep bigint, permuted int, score double")
    return out.withColumn("score", F.when(~F.isnan("score"), F.col("score")))


def null_aucs(df: DataFrame, row_id: str, group: str, variant: str, label: str, vec: str, by: Sequence[str],
              repetitions: int, seed: int, bundle: int = BUNDLE, block: int = BLOCK, cells: int = 1 << 24, most: int = 1 << 22) -> DataFrame:
    """(rep, by..., roc_auc) of the null scores, exact; null where a repetition has one class.

    Scores never move: bundles do, with the centroids of a block of repetitions, and
    a task scores and ranks all rows of a key for ``most`` scores at a time.  A key
    with more than ``cells`` numbers in its bundles is dealt into chunks, and the
    positives of each chunk meet the negatives of every chunk in a task of the two.
    """
    keys = list(by)
    pairs, bundles, _ = _scored_bundles(df, row_id, group, variant, label, vec, keys, repetitions, seed, bundle, block)
    names = [f"k{i}" for i in range(len(keys))]
    # Keys travel as text and are joined back, so that they may have any type.
    tag = lambda columns: F.to_json(F.struct(*[F.col(c).alias(k) for c, k in zip(columns, keys)])) if keys else F.lit("")
    numbers = F.size("u") * (1 + min(block, repetitions) / F.col("n"))
    chunks = F.greatest(F.lit(1), F.ceil(F.sum(numbers) / cells)).alias("chunks")
    sizes = _written(bundles.groupBy(*keys).agg(chunks).select(*keys, tag(keys).alias("tag"), F.coalesce("chunks", F.lit(1)).alias("chunks")), "chunks")
    positive = F.transform("labels", lambda v: v != 0).alias("positive")
    rows = pairs.select(tag(names).alias("tag"), "block", "stratum", "pos", "part", "n", "u", positive, "src", "c").join(sizes.select("tag", "chunks"), "tag")
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("stratum", "pos", "part"), F.col("chunks")))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("chunks") - 1)))
    rows = rows.withColumns({"a": F.least("chunk", "other"), "b": F.greatest("chunk", "other")})
    meet = ["tag", "block", "a", "b"]
    rows = rows.select(*meet, "chunk", "stratum", "pos", "n", "u", "positive", "src", "c").repartition(4 * _tasks(df), *meet).sortWithinPartitions(*meet)

    def won(positives, negatives):
        """Pairs that the positive wins, ties by half, of sorted scores."""
        return float(np.searchsorted(negatives, positives, "left").sum() + np.searchsorted(negatives, positives, "right").sum()) / 2

    def ranked(key, held):
        tag, number, a, b = key
        units, reps = {}, len(held[0].src)
        for row in held:
            units.setdefault((row.chunk, row.stratum, row.pos), []).append(row)
        parts = [(chunk, np.concatenate([np.asarray(r.u).reshape(int(r.n), -1) for r in some]),
                  np.concatenate([np.asarray(r.positive, bool).reshape(int(r.n), -1) for r in some]),
                  np.asarray(some[0].src), np.asarray(some[0].c).reshape(reps, -1)) for (chunk, _, _), some in units.items()]
        first = np.concatenate([np.full(len(u), chunk == a) for chunk, u, *_ in parts])
        step, out = max(1, most // len(first)), []
        for at in range(0, reps, step):
            some = slice(at, at + step)
            values = np.concatenate([c[some] @ u.T for _, u, _, _, c in parts], axis=1)
            ones = np.concatenate([labels[:, src[some]].T for _, _, labels, src, _ in parts], axis=1)
            for i, (value, one) in enumerate(zip(values, ones)):
                known = ~np.isnan(value)
                cut = lambda of: np.sort(value[known & of])
                if a == b:
                    pos, neg = cut(one), cut(~one)
                    out.append((tag, number * block + at + i, won(pos, neg), len(pos), len(neg)))
                else:
                    out.append((tag, number * block + at + i, won(cut(one & first), cut(~one & ~first)) + won(cut(one & ~first), cut(~one & first)), 0, 0))
        return out

    def wins(batches):
        """Wins and class sizes of each repetition; the rows that meet follow one another."""
        import pandas as pd

        columns = ["tag", "rep", "won", "ones", "zeros"]
        key, held = None, []
        for batch in batches:
            for row in batch.itertuples(index=False):
                at = (row.tag, row.block, row.a, row.b)
                if held and at != key:
                    yield pd.DataFrame(ranked(key, held), columns=columns)
                    held = []
                key = at
                held.append(row)
        if held:
            yield pd.DataFrame(ranked(key, held), columns=columns)

    found = rows.mapInPandas(wins, "tag string, rep bigint, won double, ones bigint, zeros bigint")
    total = found.groupBy("tag", "rep").agg(*[F.sum(x).alias(x) for x in ("won", "ones", "zeros")]).where("ones + zeros > 0")
    area = F.when((F.col("ones") > 0) & (F.col("zeros") > 0), F.col("won") / (F.col("ones").cast("double") * F.col("zeros")))
    return total.join(sizes, "tag").select("rep", *keys, area.alias("roc_auc"))
