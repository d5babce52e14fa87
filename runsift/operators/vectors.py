"""Vector operators on array columns.

Centroids come from sums: class sums of all rows minus the held-out group's own
sums, so leaving a group out needs no refit and no pair of rows is ever formed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runsift.functions.rationals import let
from runsift.operators.scale import null_safe_join, top_k, with_totals
from runsift.session import cut_lineage

FLOOR = 1e-12


def doubles(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def l2_normalise(v: Column, floor: float = FLOOR) -> Column:
    return let(norm(v), lambda n: F.transform(v, lambda x: x / F.greatest(n, F.lit(floor))))


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def vector_sum(v: str, weight: str | None = None) -> Column:
    """Element-wise sum as a JVM aggregate with map-side combine."""
    vec = array_to_vector(F.col(v))
    return vector_to_array(Summarizer.sum(vec, F.col(weight)) if weight else Summarizer.sum(vec))


def mean_pool(df: DataFrame, keys: Sequence[str], vec: str, position: str, start: Column, end: Column) -> DataFrame:
    """Mean vector over the positions start <= position < end."""
    span = df.where((F.col(position) >= F.greatest(start, F.lit(0))) & (F.col(position) < end))
    return span.groupBy(*keys).agg(vector_to_array(Summarizer.mean(array_to_vector(F.col(vec)))).alias("pooled"))


def similarity_by_layer(rows: DataFrame, pairs: DataFrame, row_id: str, layer: str, vec: str, a: str, b: str) -> DataFrame:
    """Cosine of the two runs of each listed pair at every common layer."""
    left = rows.select(F.col(row_id).alias(a), layer, F.col(vec).alias("__a"))
    right = rows.select(F.col(row_id).alias(b), layer, F.col(vec).alias("__b"))
    out = pairs.join(left, a).join(right, [b, layer])
    return out.select(a, b, layer, cosine(F.col("__a"), F.col("__b")).alias("similarity"))


def q_or_qstar(rows: DataFrame, triples: DataFrame, row_id: str, layer: str, vec: str) -> DataFrame:
    """Similarity of a run to its Q and its Q* run by layer; a tie counts as Q.  triples: (run, q, qstar)."""
    q = similarity_by_layer(rows, triples.select("run", "q"), row_id, layer, vec, "run", "q").withColumnRenamed("similarity", "to_q")
    s = similarity_by_layer(rows, triples.select("run", "qstar"), row_id, layer, vec, "run", "qstar").withColumnRenamed("similarity", "to_qstar")
    out = triples.join(q, ["run", "q"]).join(s, ["run", "qstar", layer])
    diff = F.col("to_qstar") - F.col("to_q")
    return out.withColumns({"difference": diff, "closer_to": F.when(diff > 0, "QSTAR").otherwise("Q")})


def feature_moments(rows: DataFrame, layer: str, vec: str) -> DataFrame:
    """Per layer the sums of products of every two vector elements.

    The weighted Gram form of centroids needs only these and the class sums; the
    matrix over all pairs of rows is never formed.
    """
    cells = rows.select(layer, F.col(vec).alias("__v"), F.posexplode(vec).alias("i", "__x"))
    cells = cells.select(layer, "i", F.transform("__v", lambda y: y * F.col("__x")).alias("__p"))
    sums = cells.groupBy(layer, "i").agg(vector_sum("__p").alias("__p"))
    return sums.select(layer, "i", F.posexplode("__p").alias("j", "moment"))


def centroid_scores(df: DataFrame, row_id: str, group: str, label: str, vec: str, by: Sequence[str] = (),
                    weighted: bool = False, strict: bool = False, train: Column | None = None, test: Column | None = None,
                    floor: float = FLOOR, extra: float = 0.0) -> DataFrame:
    """Score of each row against unit class centroids built without its own group.

    ``by`` keys (layer, repetition) are scored side by side in the same job.
    weighted: every group counts once.  A missing class gives null, or an error
    when ``strict``.
    """
    keys = list(by)
    rows = df.select(row_id, group, label, *keys, l2_normalise(doubles(F.col(vec)), floor).alias("__u"),
                     (F.lit(True) if train is None else train).alias("__train"), (F.lit(True) if test is None else test).alias("__test"))
    if weighted:
        rows = with_totals(rows, [*keys, group], __size=F.count("*")).withColumn("__w", F.lit(1.0) / F.col("__size"))
    else:
        rows = rows.withColumn("__w", F.lit(1.0))
    sums = rows.where("__train").groupBy(*keys, group, label).agg(
        vector_sum("__u", "__w").alias("__s"), F.count("*").alias("__n"))
    own = sums.groupBy(*keys, group).agg(*[
        F.max(F.when(F.col(label) == c, F.col(x))).alias(f"{x}{c}") for c in (0, 1) for x in ("__s", "__n")])
    totals = sums.groupBy(*keys, label).agg(vector_sum("__s").alias("__t"), F.sum("__n").alias("__m"))
    totals = totals.groupBy(*keys).agg(*[
        F.max(F.when(F.col(label) == c, F.col(x))).alias(f"{x}{c}") for c in (0, 1) for x in ("__t", "__m")])
    groups = rows.select(*keys, group).distinct()
    table = null_safe_join(groups, own, [*keys, group], "left")
    if keys:
        table = null_safe_join(table, totals, keys, "left")
    else:
        for c in totals.columns:
            table = table.withColumn(c, totals.select(c).scalar())

    def unit(c: int) -> Column:
        rest = F.coalesce(F.zip_with(f"__t{c}", f"__s{c}", lambda a, b: a - b), F.col(f"__t{c}"))
        left = F.col(f"__m{c}") - F.coalesce(F.col(f"__n{c}"), F.lit(0))
        missing = F.raise_error(F.lit(f"no class {c} rows outside the held-out group")).cast("array<double>") if strict else F.lit(None).cast("array<double>")
        made = let(rest, lambda v: let(norm(v), lambda n: F.transform(v, lambda x: x / (F.greatest(n, F.lit(FLOOR)) + extra))))
        return F.when(left > 0, made).otherwise(missing)

    table = table.select(*keys, group, unit(0).alias("__c0"), unit(1).alias("__c1"))
    out = null_safe_join(rows.where("__test"), table, [*keys, group], "left")
    score = dot(F.col("__u"), F.col("__c1")) - dot(F.col("__u"), F.col("__c0"))
    return out.select(row_id, group, label, *keys, score.alias("score"))


def leave_one_out_accuracy(df: DataFrame, row_id: str, label: str, vec: str, layer: str) -> DataFrame:
    """Accuracy per layer with each row scored against centroids of the others; only score > 0 picks class 1."""
    rows = df.withColumn("__g", F.col(row_id))
    scored = centroid_scores(rows, row_id, "__g", label, vec, [layer], extra=1e-9)
    hit = (F.coalesce(F.col("score") > 0, F.lit(False)).cast("int") == F.col(label)).cast("double")
    return scored.groupBy(layer).agg(F.avg(hit).alias("accuracy"), F.count("*").alias("rows"))


def _packed(df: DataFrame, row_id: str, vec: str, size: int, part: str) -> DataFrame:
    """(part, ids, flat): about ``size`` rows a part, dealt by hash; rows without id or vector are left out."""
    rows = df.where(F.col(row_id).isNotNull() & F.col(vec).isNotNull()).select(F.col(row_id).alias("__id"), doubles(F.col(vec)).alias("__v"))
    parts = rows.agg(F.greatest(F.lit(1), F.ceil(F.count("*") / size))).scalar()
    rows = rows.groupBy(F.pmod(F.xxhash64("__id"), parts).alias(part)).agg(F.collect_list(F.struct("__id", "__v")).alias("__r"))
    return rows.select(part, F.transform("__r", lambda r: r["__id"]).alias(f"{part}_ids"), F.flatten(F.transform("__r", lambda r: r["__v"])).alias(f"{part}_flat"))


def nearest_runs(reference: DataFrame, queries: DataFrame, row_id: str, vec: str, k: int = 8, max_queries: int = 1024, shard_rows: int = 4096) -> DataFrame:
    """(query_id, row, similarity, rank): the k most similar reference rows of each query by cosine, the query itself left out.

    Queries and references are tables of packed blocks that meet by shard; a
    meeting is one matrix product that keeps the k best a query, and those lists
    are merged per query.  Rows without an id or a vector take no part, nor do
    vectors of length zero; ties go to the smaller id; no queries give no rows.
    """
    import numpy as np
    import pandas as pd

    shards = cut_lineage(_packed(reference, row_id, vec, shard_rows, "shard"))
    blocks = _packed(queries, row_id, vec, max_queries, "block")
    numbers = shards.agg(F.collect_set("shard")).scalar()
    meet = blocks.withColumn("shard", F.explode(numbers)).join(shards, "shard")

    def best(batches):
        for batch in batches:
            for row in batch.itertuples(index=False):
                ids, rid = np.asarray(row.block_ids), np.asarray(row.shard_ids)
                q, x = (np.asarray(v, float).reshape(n, -1) for v, n in ((row.block_flat, len(ids)), (row.shard_flat, len(rid))))
                with np.errstate(invalid="ignore", divide="ignore"):
                    sim = (x / np.linalg.norm(x, axis=1, keepdims=True)) @ (q / np.linalg.norm(q, axis=1, keepdims=True)).T
                sim[(rid[:, None] == ids[None, :]) | ~np.isfinite(sim)] = -np.inf
                # By id first, so that a stable sort by similarity leaves ties in order of ids.
                by_id = np.argsort(rid, kind="stable")
                order = by_id[np.argsort(-sim[by_id], axis=0, kind="stable")[:k]]
                at = np.broadcast_to(np.arange(len(ids)), order.shape)
                keep = np.isfinite(sim[order, at])
                yield pd.DataFrame({"query_id": ids[at[keep]], row_id: rid[order[keep]], "similarity": sim[order, at][keep]})

    kind = dict(reference.dtypes)[row_id]
    found = meet.select("block_ids", "block_flat", "shard_ids", "shard_flat").mapInPandas(best, f"query_id {kind}, `{row_id}` {kind}, similarity double")
    return top_k(found, ["query_id"], [F.desc("similarity"), F.col(row_id)], k)
