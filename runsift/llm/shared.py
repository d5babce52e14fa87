"""Helpers that several pipeline operators use."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runsift.session import scratch_path

#: Bytes of text that a task turns into arrays at once; a longer text is one chunk of its own.
CHUNK_BYTES = 1 << 20

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


#: Bytes of an Arrow batch that tasks hand to Python while rows are written; the default holds 64 MB in both of them for every task.
BATCH_BYTES = 4 << 20


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Arrow batches of ``BATCH_BYTES`` at most for the jobs run inside; a smaller setting stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    digits = before.rstrip("bB")
    if not digits.isdigit() or int(digits) <= BATCH_BYTES:  # set by the user, in units or lower
        yield
        return
    spark.conf.set(name, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write the rows as Parquet in the shared folder and read them back, which cuts the lineage."""
    path = scratch_path(df.sparkSession, name)
    with small_batches(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def held_out(id_col: str) -> Column:
    """True for the fifth of the ids that no model may learn from (a null id: true)."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, UTF-8 bytes, offsets of the rows in them) for runs of rows of about ``limit`` bytes.

    A null counts as an empty text.
    """
    if column.null_count:
        column = pc.fill_null(column, "")
    n = len(column)
    wide = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offset_buffer, data = column.buffers()
    offsets = np.frombuffer(offset_buffer, wide)[column.offset : column.offset + n + 1].astype(np.int64) if n else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        end = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1)
        end = min(end, n)
        yield first, end, raw[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
        first = end


def word_bounds(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every run of non-space bytes; a run never crosses rows."""
    solid = ~SPACE[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets] = True
    before = np.concatenate(([False], solid[:-1])) if len(raw) else solid
    after = np.concatenate((solid[1:], [False])) if len(raw) else solid
    starts = np.flatnonzero(solid & (~before | edge[:-1]))
    ends = np.flatnonzero(solid & (~after | edge[1:])) + 1
    rows = np.searchsorted(offsets, starts, side="right") - 1
    return starts, ends, rows


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of unsigned 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class SpanHasher:
    """64-bit hashes of many byte spans at once, as differences of one running polynomial."""

    BASE = 0x9E3779B97F4A7C15
    INVERSE = pow(BASE, -1, 1 << 64)

    def __init__(self):
        self._grow(CHUNK_BYTES)

    def _grow(self, n: int) -> None:
        self.size = n
        self.up, self.down = (self._powers(base, n) for base in (self.BASE, self.INVERSE))

    @staticmethod
    def _powers(base: int, n: int) -> np.ndarray:
        factors = np.full(n + 1, base, np.uint64)
        factors[0] = 1
        return np.cumprod(factors, dtype=np.uint64)

    def __call__(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        if len(raw) > self.size:
            self._grow(len(raw))
        total = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(mix64(raw.astype(np.uint64) + np.uint64(1)) * self.up[: len(raw)], dtype=np.uint64, out=total[1:])
        spans = (total[ends] - total[starts]) * self.down[starts]
        return mix64(spans + mix64((ends - starts).astype(np.uint64)))
