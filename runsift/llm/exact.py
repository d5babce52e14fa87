"""Exact dedup: two passes over a bit filter find possibly repeated texts; only those rows shuffle.

Built-in functions only.  Pass one counts bit positions of the text digests
(two numbers per row, no texts) and keeps the bits that were hit twice.  Pass
two tests every row against these bits: a row with a clear bit is alone and
passes straight through, the others are grouped by digest.  The filter can only
let too many rows through, so the groups are exact.

Defined cases: a null text counts as the empty text; among equal texts the
largest id stays, a null id only if no other is there; rows that share text and
id share the answer, and ``drop_copies`` keeps one of them; an empty table gives
no rows; further columns pass unchanged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runsift.llm import bloom
from runsift.llm.shared import materialize


def _filter(keys: DataFrame, bits_per_row: int, max_bits: int) -> tuple[DataFrame, int]:
    bits = bloom.size_for(keys.count(), bits_per_row, max_bits)
    return materialize(bloom.repeated_bits(keys, "__digest", bits), "repeated-bits"), bits


def _digest(text_col: str):
    return F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256)


def label_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 bits_per_row: int = bloom.BITS_PER_ROW, max_bits: int = bloom.MAX_BITS) -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept, text_sha256."""
    keys = materialize(docs.select(F.col(id_col).alias("__id"), F.unhex(_digest(text_col)).alias("__digest")), "digests")
    table, bits = _filter(keys, bits_per_row, max_bits)
    marked = bloom.with_maybe(keys, "__digest", table, bits, "__maybe")
    alone = marked.where(~F.col("__maybe")).select(
        "__id", "__digest", F.col("__id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"))
    maybe = marked.where("__maybe").drop("__maybe")
    groups = maybe.groupBy("__digest").agg(F.max("__id").alias("keep_id"), F.count("*").alias("group_size"))
    grouped = maybe.join(materialize(groups, "copy-groups"), "__digest").select("__id", "__digest", "keep_id", "group_size")
    return alone.unionByName(grouped).select(
        F.col("__id").alias(id_col), "keep_id", "group_size", F.col("__id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("__digest")).alias("text_sha256"))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                bits_per_row: int = bloom.BITS_PER_ROW, max_bits: int = bloom.MAX_BITS) -> DataFrame:
    """The rows of ``docs`` that stay, all columns: rows that are alone never shuffle."""
    keyed = docs.withColumn("__digest", F.unhex(_digest(text_col)))
    table, bits = _filter(keyed.select("__digest"), bits_per_row, max_bits)
    marked = bloom.with_maybe(keyed, "__digest", table, bits, "__maybe")
    row = F.struct(*[F.col(c) for c in docs.columns])
    best = marked.where("__maybe").groupBy("__digest").agg(F.max_by(row, F.struct(id_col)).alias("row"))
    return marked.where(~F.col("__maybe")).select(*docs.columns).unionByName(best.select("row.*"))
