"""Bit filters made of built-in bitmap functions, kept as a small table of (block, bits).

A filter of 2^m bits is 2^m / 32,768 rows of 4 KB, so its size is bounded by the
``max_bits`` parameter whatever the number of rows is; with more rows it only
lets more of them through, and whoever uses it checks exactly afterwards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runsift.llm.shared import materialize

BLOCK = 32768
BITS_PER_ROW = 16
#: 2^28 bits are 32 MB, the most that is ever broadcast.
MAX_BITS = 1 << 28


def size_for(rows: int, bits_per_row: int = BITS_PER_ROW, max_bits: int = MAX_BITS) -> int:
    """The power of two of bits for so many rows, one block at least and ``max_bits`` at most."""
    return min(max(BLOCK, 1 << max(rows * bits_per_row - 1, 1).bit_length()), max_bits)


def positions(key: Column, bits: int) -> list[Column]:
    """Two bit positions of a key."""
    return [F.pmod(F.xxhash64(F.lit(seed), key), F.lit(bits)) for seed in (1, 2)]


def _blocks(bits: DataFrame, name: str) -> DataFrame:
    return bits.groupBy((F.col("bit") / BLOCK).cast("int").alias(name)).agg(
        F.bitmap_construct_agg((F.col("bit") % BLOCK)).alias(f"{name}_bits"))


def repeated_bits(keys: DataFrame, key: str, bits: int) -> DataFrame:
    """Table of the bits that two or more rows hit: the filter of possibly repeated keys."""
    hits = keys.select(F.explode(F.array_distinct(F.array(*positions(F.col(key), bits)))).alias("bit"))
    return _blocks(hits.groupBy("bit").count().where("count > 1"), "block")


def present_bits(keys: DataFrame, key: str, bits: int) -> DataFrame:
    """Table of the bits that any row hits: the filter of keys that may be in ``keys``."""
    hits = keys.select(F.explode(F.array(*positions(F.col(key), bits))).alias("bit"))
    return _blocks(hits, "block")


def _is_set(bitmap: str, at: str) -> Column:
    byte = F.conv(F.hex(F.substring(F.col(bitmap), (F.col(at) % BLOCK / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.coalesce(F.getbit(byte, (F.col(at) % 8).cast("int")) == 1, F.lit(False))


def with_maybe(rows: DataFrame, key: str, table: DataFrame, bits: int, name: str) -> DataFrame:
    """Add a boolean: every bit of the key is in the filter.  The filter is broadcast: it has ``bits`` / 8 bytes at most."""
    kept = rows.columns
    first, second = positions(F.col(key), bits)
    out = rows.withColumns({"__p1": first, "__p2": second})
    for i in ("1", "2"):
        side = table.select(F.col("block").alias(f"__b{i}"), F.col("block_bits").alias(f"__m{i}"))
        out = out.join(F.broadcast(side), (F.col(f"__p{i}") / BLOCK).cast("int") == F.col(f"__b{i}"), "left")
    return out.select(*[F.col(c) for c in kept], (_is_set("__m1", "__p1") & _is_set("__m2", "__p2")).alias(name))


def maybe_in(rows: DataFrame, wanted: DataFrame, key: str, name: str) -> DataFrame:
    """The rows whose key may be among those of ``wanted``, by a bit filter of bounded size."""
    bits = size_for(wanted.count())
    return with_maybe(rows, key, materialize(present_bits(wanted, key, bits), name), bits, "maybe").where("maybe").drop("maybe")
