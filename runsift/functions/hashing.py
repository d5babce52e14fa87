"""Hashes, seeds and timestamps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sha256_text(value: Column) -> Column:
    return F.sha2(value, 256)


def sha256_decimal_list(values: Column) -> Column:
    """Hash of the comma-joined decimals."""
    return F.sha2(F.array_join(F.transform(values, lambda x: x.cast("string")), ","), 256)


def sha256_int32_list(values: Column) -> Column:
    """Hash of the values as 4-byte little-endian integers."""

    def little_endian(x: Column) -> Column:
        h = F.lpad(F.hex(F.pmod(x.cast("bigint"), F.lit(4294967296))), 8, "0")
        return F.concat(*[F.substring(h, p, 2) for p in (7, 5, 3, 1)])

    return F.sha2(F.unhex(F.array_join(F.transform(values, little_endian), "")), 256)


def stable_seed(revision: Column, row_id: Column, seed: Column) -> Column:
    """First 8 bytes of sha256("revision|id|seed"), big-endian, mod 2^31 - 1, with 0 -> 1."""
    digest = F.sha2(F.concat_ws("|", revision, row_id.cast("string"), seed.cast("string")), 256)
    head = F.conv(F.substring(digest, 1, 16), 16, 10).cast("decimal(20,0)")
    value = (head % F.lit(2147483647)).cast("bigint")
    return F.when(value == 0, F.lit(1).cast("bigint")).otherwise(value)


def utc_timestamp() -> Column:
    """Current time as ISO-8601 UTC text, whatever the session time zone is."""
    utc = F.to_utc_timestamp(F.current_timestamp(), F.current_timezone())
    return F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")
