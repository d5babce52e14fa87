"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

Features of a text: densities of a learned lexicon (words and word beginnings
that toxic training documents use far more often), how near lexicon words stand
to second-person words, capitals, punctuation and obfuscation rates.  Letters
replaced by digits or signs are read back before a word is looked up.

At most ``sample`` labelled documents that are not held out are used, taken in
hash order, label 1 up to a third of them: nearly half for the lexicon, a third
for the trees, the rest to calibrate with the true label shares as weights.
Only hashes and features of the sample reach the driver.  Scoring reads every
whole text once and shuffles nothing.

Defined cases: null counts as the empty text, which has features of zero and is
scored like any other; without labels of both kinds every score is the share of
label 1, or 0 without labels; equal texts get equal scores; an empty table gives
no rows; further columns are not used.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runsift.llm.quality import sampled
from runsift.llm.shared import SpanHasher, chunks, held_out, word_bounds

SAMPLE = 6000
THRESHOLD = 0.5
STEMS = (5, 7)
SECOND_PERSON = "you your yours yourself u ur du dich dir dein deine deinen ihr euch tu te toi ton ta tes vous votre vos tú ti tus usted ustedes vosotros".split()

_READ = np.arange(256, dtype=np.uint8)
_READ[65:91] += 32
for _sign, _letter in zip(b"013457@$", b"oieastas"):
    _READ[_sign] = _letter
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_MASK = np.zeros(256, bool)
_MASK[list(b"013457@$*")] = True


def _words(hasher: SpanHasher, raw: np.ndarray, offsets: np.ndarray):
    """Row, word hash and stem hashes of every word, trimmed of signs at its ends and read back; rates of odd spellings."""
    starts, ends, rows = word_bounds(raw, offsets)
    hidden = np.concatenate(([0], np.cumsum(_MASK[raw])))
    letters = np.concatenate(([0], np.cumsum(_LETTER[raw])))
    for _ in range(4):
        starts = starts + ((ends - starts > 1) & ~(_LETTER[raw[starts]] | _MASK[raw[starts]]))
        ends = ends - ((ends - starts > 1) & ~(_LETTER[raw[ends - 1]] | _MASK[raw[ends - 1]]))
    inner = hidden[np.maximum(ends - 1, starts)] - hidden[np.minimum(starts + 1, ends)]
    odd = (inner > 0) & (letters[ends] - letters[starts] >= 2)
    plain = _READ[raw]
    words = hasher(plain, starts, ends)
    stems = [np.where(ends - starts > n, hasher(plain, starts, np.minimum(starts + n, ends)), np.uint64(0)) for n in STEMS]
    return rows, words, stems, odd


def _hashed(words: list[str]) -> np.ndarray:
    raw = np.frombuffer("".join(words).encode(), np.uint8)
    cuts = np.cumsum([0, *[len(w.encode()) for w in words]])
    return np.sort(SpanHasher()(_READ[raw], cuts[:-1], cuts[1:]))


def _member(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    if not len(ordered):
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)
    return ordered[at] == values


def features(hasher: SpanHasher, raw: np.ndarray, offsets: np.ndarray, lexicon: list[np.ndarray], second: np.ndarray) -> np.ndarray:
    """One row of dense features per text; ``lexicon`` has sorted hashes of words and of each stem length."""
    n = len(offsets) - 1
    rows, words, stems, odd = _words(hasher, raw, offsets)
    count = lambda hit: np.bincount(rows[hit], minlength=n).astype(float)
    total = np.maximum(np.bincount(rows, minlength=n), 1).astype(float)
    hits = [_member(h, known) for h, known in zip((words, *stems), lexicon)]
    any_hit, person = np.logical_or.reduce(hits), _member(words, second)
    near = np.zeros(len(words), bool)
    where = np.flatnonzero(person)
    if len(where):
        at = np.flatnonzero(any_hit)
        after = np.minimum(np.searchsorted(where, at), len(where) - 1)
        before = np.maximum(after - 1, 0)
        for side in (after, before):
            near[at] |= (np.abs(where[side] - at) <= 5) & (rows[where[side]] == rows[at])
    size = np.maximum(np.diff(offsets), 1).astype(float)

    def share(members) -> np.ndarray:
        table = np.zeros(256, np.int32)
        table[list(members)] = 1
        sums = np.concatenate(([0], np.cumsum(table[raw])))
        return np.diff(sums[offsets]) / size

    counts = [count(h) for h in (*hits, any_hit)]
    return np.column_stack([
        *[c / total for c in counts], *[np.log1p(c) for c in counts],
        count(person) / total, count(near) / np.maximum(counts[-1], 1), share(range(65, 91)), share(b"!?"), share(b".,;:"),
        count(odd) / total, count(odd & any_hit) / total, np.log1p(np.bincount(rows, minlength=n)),
    ])


class Trees:
    """Boosted trees of depth 3 for the log-odds, on feature bins."""

    def __init__(self, x: np.ndarray, y: np.ndarray, rounds: int = 80, rate: float = 0.15, bins: int = 32, leaf: float = 1.0):
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
        self.base = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
        self.rate, self.trees = rate, []
        binned, total = self._binned(x), np.full(len(y), self.base)
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-total))
            tree = {}
            out = self._grow(tree, 1, binned, p - y, p * (1 - p), np.ones(len(y), bool), bins, leaf)
            self.trees.append(tree)
            total = total + rate * out

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(e, c, side="right") for e, c in zip(self.edges, x.T)])

    def _grow(self, tree: dict, node: int, binned, g, h, here, bins, leaf) -> np.ndarray:
        total_g, total_h = g[here].sum(), h[here].sum()
        best = (1e-6, -1, -1)
        if node < 8:
            for j in range(binned.shape[1]):
                gs = np.cumsum(np.bincount(binned[here, j], g[here], minlength=bins))[:-1]
                hs = np.cumsum(np.bincount(binned[here, j], h[here], minlength=bins))[:-1]
                gain = gs**2 / (hs + leaf) + (total_g - gs) ** 2 / (total_h - hs + leaf) - total_g**2 / (total_h + leaf)
                gain[(hs < 0.5) | (total_h - hs < 0.5)] = 0
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (float(gain[k]), j, k)
        if best[1] < 0:
            tree[node] = -total_g / (total_h + leaf)
            return np.where(here, tree[node], 0.0)
        _, j, k = best
        tree[node] = (j, k)
        left = binned[:, j] <= k
        return self._grow(tree, 2 * node, binned, g, h, here & left, bins, leaf) + self._grow(tree, 2 * node + 1, binned, g, h, here & ~left, bins, leaf)

    def margins(self, x: np.ndarray) -> np.ndarray:
        binned, total = self._binned(x), np.full(len(x), self.base)
        for tree in self.trees:
            todo = [(1, np.arange(len(x)))]
            while todo:
                node, at = todo.pop()
                if not isinstance(tree[node], tuple):
                    total[at] += self.rate * tree[node]
                    continue
                j, k = tree[node]
                left = binned[at, j] <= k
                todo += [(2 * node, at[left]), (2 * node + 1, at[~left])]
        return total


def isotonic(z: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the weighted non-decreasing fit of ``y`` on ``z`` by pooling adjacent violators."""
    order = np.argsort(z, kind="stable")
    blocks: list[list[float]] = []
    for i in order:
        blocks.append([y[i] * weight[i], weight[i], z[i] * weight[i]])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            top = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], top)]
    at, value = (np.array([b[k] / b[1] for b in blocks]) for k in (2, 0))
    return at, value


@dataclass
class Model:
    lexicon: list[np.ndarray]
    second: np.ndarray
    trees: Trees | None
    knots: tuple[np.ndarray, np.ndarray] | None
    share: float

    def scores(self, hasher: SpanHasher, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        if self.trees is None:
            return np.full(len(offsets) - 1, self.share)
        return np.interp(self.trees.margins(features(hasher, raw, offsets, self.lexicon, self.second)), *self.knots)


def _sample_words(batches):
    """Distinct word and stem hashes of each text."""
    hasher = SpanHasher()
    for batch in batches:
        for first, end, raw, offsets in chunks(batch.column(1)):
            rows, words, stems, _ = _words(hasher, raw, offsets)
            cuts = np.searchsorted(rows, np.arange(1, len(offsets) - 1))
            columns = [pa.array([np.unique(part).tobytes() for part in np.split(h, cuts)], pa.binary()) for h in (words, *stems)]
            yield pa.RecordBatch.from_arrays([batch.column(2).slice(first, end - first), *columns], ["label", *[f"h{i}" for i in range(len(columns))]])


def _sample_rows(lexicon: list[np.ndarray], second: np.ndarray) -> Callable:
    def run(batches):
        hasher = SpanHasher()
        for batch in batches:
            for first, end, raw, offsets in chunks(batch.column(1)):
                x = features(hasher, raw, offsets, lexicon, second)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, end - first), batch.column(2).slice(first, end - first),
                                                  pa.array([r.astype("<f8").tobytes() for r in x], pa.binary())], ["id", "label", "x"])

    return run


def _learned(labels: np.ndarray, columns: list, least: int = 4, times: float = 5.0) -> list[np.ndarray]:
    """Hashes that documents of label 1 hold ``times`` as often as the others."""
    out, ones = [], max(int(labels.sum()), 1)
    zeros = max(len(labels) - ones, 1)
    for packed in columns:
        toxic, clean = ([np.frombuffer(b, np.uint64) for b, y in zip(packed, labels) if y == want] for want in (1, 0))
        values, n = np.unique(np.concatenate(toxic) if toxic else np.zeros(0, np.uint64), return_counts=True)
        others, m = np.unique(np.concatenate(clean) if clean else np.zeros(0, np.uint64), return_counts=True)
        seen = np.zeros(len(values))
        if len(others) and len(values):
            at = np.minimum(np.searchsorted(others, values), len(others) - 1)
            seen = np.where(others[at] == values, m[at], 0)
        keep = (n >= max(least, 0.01 * ones)) & (n / ones > times * (seen + 0.5) / zeros) & (values != 0)
        out.append(values[keep])
    return out


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> Model:
    counts = dict(labels.where(~held_out(id_col) & F.col("toxic").isin(0, 1)).groupBy("toxic").count().collect())
    ones, known = counts.get(1, 0), sum(counts.values())
    share, second = (ones / known if known else 0.0), _hashed(SECOND_PERSON)
    if not 0 < share < 1:
        return Model([], second, None, None, share)
    rows = sampled(docs, labels, "toxic", sample // 3, sample, id_col, text_col).select("id", "text", F.col("label").cast("int").alias("label"))
    part = F.pmod(F.xxhash64("id", F.lit("part")), F.lit(100))
    names = [f"h{i}" for i in range(len(STEMS) + 1)]
    seen = rows.where(part < 45).mapInArrow(_sample_words, "label int, " + ", ".join(f"{n} binary" for n in names)).toPandas()
    lexicon = _learned(seen["label"].to_numpy(), [seen[n] for n in names])
    out = rows.withColumn("part", part).where("part >= 45")
    id_type = rows.schema["id"].dataType.simpleString()
    frames = [out.where(cond).select("id", "text", "label").mapInArrow(_sample_rows(lexicon, second), f"id {id_type}, label int, x binary").toPandas().sort_values(["id", "x"])
              for cond in ("part < 80", "part >= 80")]
    if any(f["label"].nunique() < 2 for f in frames):
        return Model(lexicon, second, None, None, share)
    (x, y), (cx, cy) = ((np.stack([np.frombuffer(b, "<f8") for b in f["x"]]), f["label"].to_numpy().astype(float)) for f in frames)
    trees = Trees(x, y)
    weight = np.where(cy == 1, share / max(cy.mean(), 1e-9), (1 - share) / max(1 - cy.mean(), 1e-9))
    at, value = isotonic(trees.margins(cx), cy, weight)
    return Model(lexicon, second, trees, (at, np.clip(value, 0.001, 0.999)), share)


def _scorer(model: Model) -> Callable:
    def run(batches):
        hasher = SpanHasher()
        for batch in batches:
            scores = [model.scores(hasher, raw, offsets) for _, _, raw, offsets in chunks(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(scores) if scores else np.zeros(0), pa.float64())], ["id", "score"])

    return run


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, held_out, score, predicted."""
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    scored = texts.mapInArrow(_scorer(model), f"id {texts.schema['id'].dataType.simpleString()}, score double")
    return scored.select(F.col("id").alias(id_col), held_out("id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
