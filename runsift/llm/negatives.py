"""Hard-negative mining: Strassen products of anchor and candidate tiles, merged by heaps.

Components become integers floor(scale * x), so every score is an exact integer.

* A tile is a bounded block of anchors against a bounded shard of candidates.
  Both are dealt by hash, and a task multiplies the tiles that meet: 7 products of
  half-sized blocks in place of 8, down to small leaves, on int64 with zero
  padding; all additions are exact.  A vector is copied to as many tiles as the
  other side has blocks, so rows exchanged grow with ``anchors * candidates /
  tile_rows``, a small part of the products themselves.
* The first pass meets only rows of one label and keeps a heap of the ``positives``
  best per anchor and tile; heaps merge by a grouped top-k.
* The second pass meets every shard with the anchors and their positive scores,
  and keeps per anchor and positive a heap of the ``negatives`` best rows of other
  labels inside the window ``low * positive <= 100 * score <= 100 * positive``;
  these merge likewise.

A label or shard that holds most rows only gives more tiles of the same size.

Defined cases: rows with a null id, label or vector, an empty vector, or a null or
non-finite component take no part; a row is no partner of rows with its own id;
rows with a repeated id are rows of their own, each an anchor's positive or
negative, but an anchor that is repeated with an equal label and vector asks once;
of vectors of different lengths the shorter is padded with zeros; fewer
partners than asked for: all are returned; ties go to the smaller id; a table
whose scores could exceed a long is refused with an error; an empty table gives no
rows; further columns are not used.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runsift.llm.shared import materialize

SCALE = 256
TILE_ROWS = 8192
#: Candidates multiplied at once inside a tile, which bounds the scores held.
STRIP_ROWS = 2048
#: Blocks with a side of at most this are multiplied directly.
LEAF = 32


def _padded(block: np.ndarray) -> np.ndarray:
    rows, columns = block.shape
    return np.pad(block, ((0, rows % 2), (0, columns % 2))) if rows % 2 or columns % 2 else block


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """a @ b of int64 matrices."""
    rows, columns = a.shape[0], b.shape[1]
    if min(rows, a.shape[1], columns) <= leaf:
        return a @ b
    a, b = _padded(a), _padded(b)
    i, k, j = a.shape[0] // 2, a.shape[1] // 2, b.shape[1] // 2
    a11, a12, a21, a22 = a[:i, :k], a[:i, k:], a[i:, :k], a[i:, k:]
    b11, b12, b21, b22 = b[:k, :j], b[:k, j:], b[k:, :j], b[k:, j:]
    m1 = strassen(a11 + a22, b11 + b22, leaf)
    m2 = strassen(a21 + a22, b11, leaf)
    m3 = strassen(a11, b12 - b22, leaf)
    m4 = strassen(a22, b21 - b11, leaf)
    m5 = strassen(a11 + a12, b22, leaf)
    out = np.empty((2 * i, 2 * j), np.int64)
    out[:i, j:] = m3 + m5
    out[i:, :j] = m2 + m4
    m5 -= m4
    m2 -= m3
    out[:i, :j] = m1 - m5
    out[:i, :j] += strassen(a12 - a22, b21 + b22, leaf)
    out[i:, j:] = m1 - m2
    out[i:, j:] += strassen(a21 - a11, b11 + b12, leaf)
    return out[:rows, :columns]


def _matrix(cells: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(cells), width), np.int64)
    for row, cell in zip(out, cells):
        row[: len(cell)] = cell
    return out


def _largest(matrix: np.ndarray) -> int:
    return max(int(matrix.max(initial=0)), -int(matrix.min(initial=0)))


def _scores(anchors: pd.DataFrame, candidates: pd.DataFrame):
    """(first candidate of the strip, its scores with every anchor)."""
    width = max(max(map(len, anchors["vec"])), max(map(len, candidates["vec"])))
    a, c = _matrix(anchors["vec"], width), _matrix(candidates["vec"], width)
    # Sums inside the recursion stay far below this in practice and wrap around exactly beyond it.
    if _largest(a) * _largest(c) * width >= 1 << 63:
        raise ArithmeticError("components too large: an inner product could exceed a long")
    for at in range(0, len(c), STRIP_ROWS):
        yield at, strassen(a, np.ascontiguousarray(c[at : at + STRIP_ROWS].T))


class Heaps:
    """The k best (score, id) of each of ``n`` rows, higher scores first, ties to the smaller id."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.score = np.zeros((n, k), np.int64)
        self.name = np.zeros((n, k), np.int64)
        self.held = np.zeros((n, k), bool)

    def merge(self, score: np.ndarray, name: np.ndarray, allowed: np.ndarray) -> None:
        """Take the k best of what is held and of the allowed cells of a strip (rows x candidates)."""
        full = self.held[:, -1]
        least = self.score[:, -1:]
        allowed = allowed & (~full[:, None] | (score > least) | ((score == least) & (name[None, :] < self.name[:, -1:])))
        row, column = np.nonzero(allowed)
        mine, slot = np.nonzero(self.held)
        rows = np.concatenate((mine, row))
        scores = np.concatenate((self.score[mine, slot], score[row, column]))
        names = np.concatenate((self.name[mine, slot], name[column]))
        order = np.lexsort((names, -scores, rows))
        rows, scores, names = rows[order], scores[order], names[order]
        place = np.arange(len(rows)) - np.searchsorted(rows, rows, side="left")
        top = place < self.k
        rows, place = rows[top], place[top]
        self.held[:] = False
        self.held[rows, place] = True
        self.score[rows, place], self.name[rows, place] = scores[top], names[top]

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        row, slot = np.nonzero(self.held)
        return row, self.name[row, slot], self.score[row, slot]


def _positives(k: int) -> Callable:
    def run(candidates: pd.DataFrame, anchors: pd.DataFrame) -> pd.DataFrame:
        heaps = Heaps(len(anchors), k)
        names, own = candidates["vec_id"].to_numpy(), anchors["anchor_id"].to_numpy()
        if len(names) and len(own):
            for at, scores in _scores(anchors, candidates):
                strip = names[at : at + STRIP_ROWS]
                heaps.merge(scores, strip, own[:, None] != strip)
        row, name, score = heaps.rows()
        return pd.DataFrame({"anchor": anchors["anchor"].to_numpy()[row], "anchor_id": own[row], "positive_id": name, "positive_score": score})

    return run


def _negatives(k: int, low: int) -> Callable:
    def run(candidates: pd.DataFrame, anchors: pd.DataFrame) -> pd.DataFrame:
        names, labels = candidates["vec_id"].to_numpy(), candidates["label"].to_numpy()
        own, mine = anchors["anchor_id"].to_numpy(), anchors["label"].to_numpy()
        goals = anchors["positive_scores"].tolist()
        depth = max(map(len, goals), default=0)
        goal = np.zeros((len(own), depth), np.int64)
        asked = np.zeros((len(own), depth), bool)
        for row, scores in enumerate(goals):
            goal[row, : len(scores)], asked[row, : len(scores)] = scores, True
        heaps = [Heaps(len(own), k) for _ in range(depth)]
        if len(names) and len(own):
            for at, scores in _scores(anchors, candidates):
                strip = names[at : at + STRIP_ROWS]
                other = (mine[:, None] != labels[at : at + STRIP_ROWS]) & (own[:, None] != strip)
                for turn, heap in enumerate(heaps):
                    limit = goal[:, turn : turn + 1]
                    # 100 * score >= low * limit, in whole numbers that cannot overflow
                    least = np.array([[-(-low * int(v) // 100)] for v in limit[:, 0]], np.int64)
                    heap.merge(scores, strip, other & asked[:, turn : turn + 1] & (scores >= least) & (scores <= limit))
        parts = []
        for turn, heap in enumerate(heaps):
            row, name, score = heap.rows()
            parts.append(pd.DataFrame({"anchor": anchors["anchor"].to_numpy()[row], "turn": turn, "negative_id": name, "negative_score": score}))
        empty = pd.DataFrame({"anchor": [], "turn": [], "negative_id": [], "negative_score": []}).astype("int64")
        return pd.concat(parts) if parts else empty

    return run


def _quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def _tiles(candidates: DataFrame, anchors: DataFrame, by: list[str], tile_rows: int) -> tuple:
    """Candidates and anchors grouped so that every block of one meets every block of the other (of equal ``by``)."""
    parts = lambda n: F.greatest(F.lit(1), F.ceil(F.col(n) / tile_rows)).cast("int")
    if by:
        count = lambda rows, n: rows.groupBy(*by).agg(F.count("*").alias(n))
        sizes = count(candidates, "c").join(count(anchors, "a"), by)
        sizes = materialize(sizes.select(*by, parts("c").alias("shards"), parts("a").alias("blocks")), "tiles")
        sized = lambda rows: rows.join(sizes, by)
    else:
        shards, blocks = (-(-rows.count() // tile_rows) or 1 for rows in (candidates, anchors))
        sized = lambda rows: rows.withColumns({"shards": F.lit(shards), "blocks": F.lit(blocks)})
    deal = lambda key, n: F.pmod(F.xxhash64(key, F.lit(n)), F.col(n)).cast("int")
    others = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    fresh = lambda rows: [F.col(c).alias(c) for c in rows.columns]
    left = sized(candidates).select(*fresh(candidates), deal("vec_id", "shards").alias("shard"), others("blocks").alias("block"))
    right = sized(anchors).select(*fresh(anchors), deal("anchor", "blocks").alias("block"), others("shards").alias("shard"))
    keys = [*by, "shard", "block"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys))


def mine(vectors: DataFrame, is_anchor: Column, label: Column, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = SCALE,
         positives: int = 5, negatives: int = 5, low_percent: int = 80, tile_rows: int = TILE_ROWS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score), best negatives first."""
    vec = _quoted(vec_col)
    usable = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = F.transform(vec, lambda x: F.floor(x.cast("double") * scale).cast("long"))
    rows = vectors.select(
        _quoted(id_col).cast("long").alias("vec_id"), label.cast("long").alias("label"), vec.alias("cells"),
        F.when(usable & (F.size(vec) > 0), whole).alias("vec"), F.coalesce(is_anchor, F.lit(False)).alias("asks"))
    rows = materialize(rows.where("vec_id is not null and label is not null and vec is not null").drop("cells"), "vectors")
    # An anchor is known by a hash of its whole row, so a repeated anchor asks once and different rows with one id ask for themselves.
    anchors = rows.where("asks").select(
        F.xxhash64("vec_id", "label", "vec").alias("anchor"), F.col("vec_id").alias("anchor_id"), "label", "vec").dropDuplicates(["anchor"])
    candidates = rows.select("vec_id", "label", "vec")

    near = _tiles(candidates, anchors, ["label"], tile_rows).applyInPandas(
        _positives(positives), "anchor long, anchor_id long, positive_id long, positive_score long")
    best = Window.partitionBy("anchor").orderBy(F.desc("positive_score"), "positive_id")
    chosen = near.withColumn("turn", F.row_number().over(best) - 1).where(F.col("turn") < positives)
    chosen = materialize(chosen.withColumn("turn", F.col("turn").cast("long")), "positives")
    goals = chosen.groupBy("anchor").agg(F.transform(F.sort_array(F.collect_list(F.struct("turn", "positive_score"))), lambda g: g["positive_score"]).alias("positive_scores"))
    asking = materialize(anchors.join(goals, "anchor"), "anchors")

    far = _tiles(candidates, asking, [], tile_rows).applyInPandas(
        _negatives(negatives, low_percent), "anchor long, turn long, negative_id long, negative_score long")
    best = Window.partitionBy("anchor", "turn").orderBy(F.desc("negative_score"), "negative_id")
    ranked = far.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= negatives)
    return ranked.join(chosen, ["anchor", "turn"]).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
