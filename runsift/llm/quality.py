"""Document quality from lines: a linear-chain conditional random field labels every line good or bad.

A line is described by rates of its own characters and words and by those of
the lines before and after it.  The field is trained on lines that carry the
label of their document; forward-backward marginals of the lines, weighted by
line length, give the quality of a document, which a logistic curve turns into a
probability.

The model is fitted on the driver from features of at most ``sample`` labelled
documents, taken in hash order from the ids that are not held out; texts stay on
the executors.  Scoring reads every whole text once and shuffles nothing.

Defined cases: a text without a non-blank line (or null) gets the share of good
documents in the sample; without labels of both kinds every score is that share,
or 0.5 without any label; rows are scored one by one, so repeated rows get equal
scores; an empty table gives no rows; further columns are not used by ``score``
and pass unchanged through ``keep_good``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from runsift.llm.crf import Chains, LinearChain
from runsift.llm.shared import SpanHasher, chunks, held_out, word_bounds

SAMPLE = 4000
THRESHOLD = 0.3
_CLASSES = {
    "upper": range(65, 91), "digit": range(48, 58), "letter": [*range(65, 91), *range(97, 123), *range(128, 256)],
    "bang": b"!?", "bar": b"|<>{}[]\\", "sign": b"#$%&*@^~+=_/", "stop": b".,;:'\"-()",
}


def line_features(hasher: SpanHasher, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of every non-blank line, its length in bytes, and the number of such lines of each row."""
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets] = True
    breaks = raw == 10
    starts_at = edge[:-1].copy()
    starts_at[1:] |= breaks[:-1]
    starts = np.flatnonzero(starts_at & ~breaks)
    stop = np.flatnonzero(breaks | edge[1:])
    ends = stop[np.searchsorted(stop, starts)]
    ends = np.where(breaks[ends], ends, ends + 1)
    w_start, w_end, _ = word_bounds(raw, offsets)
    lo, hi = np.searchsorted(w_start, starts), np.searchsorted(w_start, ends)
    full = hi > lo
    starts, ends, lo, hi = starts[full], ends[full], lo[full], hi[full]
    rows = np.searchsorted(offsets, starts, side="right") - 1
    size, words = (ends - starts).astype(float), (hi - lo).astype(float)

    def rate(members) -> np.ndarray:
        table = np.zeros(256, np.int32)
        table[list(members)] = 1
        total = np.concatenate(([0], np.cumsum(table[raw])))
        return (total[ends] - total[starts]) / size

    hashes = hasher(raw, w_start, w_end)
    again = np.concatenate(([0], np.cumsum(np.append(False, hashes[1:] == hashes[:-1]))))
    back = np.concatenate(([0], np.cumsum(np.append([False, False], hashes[2:] == hashes[:-2])[: len(hashes)])))
    odd_end = np.zeros(256, bool)
    odd_end[list(b"#$%&*!|")] = True
    odd = np.concatenate(([0], np.cumsum(odd_end[raw[w_end - 1]]))) if len(w_end) else np.zeros(1)
    whole = hasher(raw, starts, ends)
    same = np.zeros(len(starts))
    same[1:] = (whole[1:] == whole[:-1]) & (rows[1:] == rows[:-1])
    own = np.column_stack([
        *[rate(m) for m in _CLASSES.values()],
        (again[hi] - again[lo]) / words, (back[hi] - back[lo]) / words, (odd[hi] - odd[lo]) / words, same,
        np.isin(raw[ends - 1], list(b".!?")) if len(ends) else np.zeros(0),
        np.log1p(words) / 5, np.minimum(size / words, 30) / 10,
    ]).astype(float)
    linked = rows[1:] == rows[:-1]
    before, after = np.zeros((len(own), own.shape[1] + 1)), np.zeros((len(own), own.shape[1] + 1))
    before[1:][linked, :-1], before[1:][linked, -1] = own[:-1][linked], 1
    after[:-1][linked, :-1], after[:-1][linked, -1] = own[1:][linked], 1
    x = np.hstack([own, before, after, np.ones((len(own), 1))])
    return x, size, np.bincount(rows, minlength=len(offsets) - 1)


@dataclass
class Model:
    """Field, curve of the document score, and the share of good documents."""

    chain: LinearChain | None
    scale: float
    shift: float
    share: float

    def document_scores(self, x: np.ndarray, size: np.ndarray, lines: np.ndarray) -> np.ndarray:
        out = np.full(len(lines), self.share)
        some = lines > 0
        if self.chain is None or not some.any():
            return out
        z = _pooled(self.chain, x, size, lines[some])
        out[some] = 1 / (1 + np.exp(-np.clip(self.scale * z + self.shift, -30, 30)))
        return out


def _pooled(chain: LinearChain, x: np.ndarray, size: np.ndarray, lines: np.ndarray) -> np.ndarray:
    """Log-odds of the length-weighted mean marginal of each document."""
    good = chain.marginals(x, Chains(lines))[:, 1]
    first = np.concatenate(([0], np.cumsum(lines)[:-1]))
    mean = np.add.reduceat(good * size, first) / np.add.reduceat(size, first)
    mean = np.clip(mean, 1e-4, 1 - 1e-4)
    return np.log(mean / (1 - mean))


def _logistic(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve, by damped Newton steps with a small penalty."""
    a = np.column_stack([z, np.ones_like(z)])
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        grad = a.T @ (y - p) - 0.5 * w
        curve = (a * (p * (1 - p))[:, None]).T @ a + 0.5 * np.eye(2)
        step = np.linalg.solve(curve, grad)
        w = w + step * min(1.0, 2.0 / (np.abs(step).max() + 1e-12))
    return float(w[0]), float(w[1])


def sampled(docs: DataFrame, labels: DataFrame, label: str, per_class: int | None, sample: int, id_col: str, text_col: str) -> DataFrame:
    """(id, text, label) of at most ``sample`` labelled documents that are not held out, in hash order.

    With ``per_class``, label 1 has at most that many of them.
    """
    known = labels.where(~held_out(id_col) & F.col(label).isin(0, 1)).groupBy(id_col).agg(F.min(label).alias("label"))
    order = [F.xxhash64(id_col), F.col(id_col)]
    if per_class is None:
        chosen = known.orderBy(*order).limit(sample)
    else:
        chosen = known.where("label = 1").orderBy(*order).limit(per_class).unionByName(
            known.where("label = 0").orderBy(*order).limit(sample - per_class))
    # At most ``sample`` pairs of numbers are broadcast.
    chosen = F.broadcast(chosen.withColumnRenamed(id_col, "__id"))
    return docs.join(chosen, F.col(id_col) == F.col("__id")).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), "label")


def _sample_features(batches):
    hasher = SpanHasher()
    for batch in batches:
        for first, end, raw, offsets in chunks(batch.column(1)):
            x, size, lines = line_features(hasher, raw, offsets)
            cuts = np.cumsum(lines)[:-1]
            packed = [np.column_stack([s, r]).astype("<f4").tobytes() for s, r in zip(np.split(size, cuts), np.split(x, cuts))]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, end - first), batch.column(2).slice(first, end - first), pa.array(packed, pa.binary())],
                                             ["id", "label", "lines"])


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> Model:
    rows = sampled(docs, labels, "quality", None, sample, id_col, text_col).select("id", "text", F.col("label").cast("int").alias("label"))
    rows = rows.mapInArrow(_sample_features, f"id {rows.schema['id'].dataType.simpleString()}, label int, lines binary").toPandas().sort_values(["id", "lines"])
    if not len(rows):
        return Model(None, 0.0, 0.0, 0.5)
    y = rows["label"].to_numpy().astype(int)
    share = float(y.mean())
    width = line_features(SpanHasher(), np.frombuffer(b"a", np.uint8), np.array([0, 1]))[0].shape[1] + 1
    parts = [np.frombuffer(b, "<f4").reshape(-1, width) for b in rows["lines"]]
    lines = np.array([len(p) for p in parts])
    some = lines > 0
    if len(set(y[some].tolist())) < 2:
        return Model(None, 0.0, 0.0, share)
    stacked = np.concatenate(parts).astype(float)
    size, x, chains = stacked[:, 0], stacked[:, 1:], Chains(lines[some])
    chain = LinearChain(2, x.shape[1]).fit(x, np.repeat(y, lines), chains, penalty=2.0)
    scale, shift = _logistic(_pooled(chain, x, size, lines[some]), y[some])
    return Model(chain, scale, shift, share)


def _scorer(model: Model) -> Callable:
    def run(batches):
        hasher = SpanHasher()
        for batch in batches:
            scores = [model.document_scores(*line_features(hasher, raw, offsets)) for _, _, raw, offsets in chunks(batch.column(1))]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.concatenate(scores) if scores else np.zeros(0), pa.float64())], [*batch.schema.names, "__score"])

    return run


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, held_out, score, predicted."""
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    scored = texts.mapInArrow(_scorer(model), f"id {texts.schema['id'].dataType.simpleString()}, text string, __score double")
    return scored.select(F.col("id").alias(id_col), held_out("id").alias("held_out"), F.col("__score").alias("score"),
                         (F.col("__score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: Model, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose score reaches the threshold, all columns."""
    rest = [c for c in docs.columns if c != text_col]
    packed = docs.select(F.struct(*rest).alias("rest") if rest else F.struct(F.lit(1).alias("x")).alias("rest"), F.col(text_col).alias("text"))
    schema = StructType([*packed.schema.fields, StructField("__score", DoubleType())])
    scored = packed.select("rest", "text").mapInArrow(_scorer(model), schema)
    kept = scored.where(F.col("__score") >= threshold)
    return kept.select(*[F.col("text").alias(c) if c == text_col else F.col(f"rest.`{c}`") for c in docs.columns])
