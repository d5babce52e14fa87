"""Row-level projections, recodes and predicates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def flatten(df: DataFrame, struct: str, fields: Sequence[str]) -> DataFrame:
    """Named struct fields as top-level columns beside the other columns."""
    return df.select(*[c for c in df.columns if c != struct], *[F.col(f"{struct}.{f}").alias(f) for f in fields])


def merge_later_wins(df: DataFrame, order: Sequence[dict[str, Column]]) -> DataFrame:
    """Columns of several records merged; a later record overwrites an earlier one."""
    merged: dict[str, Column] = {}
    for part in order:
        merged.update(part)
    return df.select(*[c.alias(n) for n, c in merged.items()])


def all_true(*flags: Column) -> Column:
    """Conjunction in which a null counts as false."""
    out = F.lit(True)
    for f in flags:
        out = out & F.coalesce(f, F.lit(False))
    return out


def recode(value: Column, mapping: dict[str, object]) -> Column:
    """Value lookup; an unmapped value gives null."""
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), value)


def encode_label(value: Column, mapping: dict[str, int]) -> Column:
    """Value lookup that rejects an unknown label."""
    hit = recode(value, mapping)
    bad = F.raise_error(F.concat(F.lit("unknown label: "), F.coalesce(value, F.lit("null")))).cast("int")
    return F.when(hit.isNotNull(), hit).otherwise(bad)


def key_head(value: Column, sep: str = "::") -> Column:
    return F.split(value, sep, 2)[0]


def key_tail(value: Column, sep: str = "::") -> Column:
    return F.try_element_at(F.split(value, sep, 2), F.lit(2))


def strip_prefix(value: Column, prefix: str) -> Column:
    return F.when(value.startswith(prefix), F.substring(value, len(prefix) + 1, 2147483647)).otherwise(value)


def recover(value: Column, source: Column, prefixes: dict[str, str]) -> Column:
    """The stored value, or the one whose prefix the source text starts with; else an error."""
    found = F.lit(None).cast("string")
    for name, prefix in reversed(list(prefixes.items())):
        found = F.when(source.startswith(prefix), F.lit(name)).otherwise(found)
    return F.coalesce(value, found, F.raise_error(F.lit("value cannot be recovered")).cast("string"))


def is_finite(value: Column) -> Column:
    """Not null, not NaN, not infinite."""
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) < F.lit(float("inf")))


def row_range(position: Column, start: int = 0, end: int | None = None) -> Column:
    """Rows start <= position < end of a 0-based position column."""
    ok = position >= start
    return ok if end is None else ok & (position < end)


def nested_as_json(df: DataFrame) -> DataFrame:
    """Struct, array and map columns as JSON text, for CSV."""
    nested = (T.StructType, T.ArrayType, T.MapType)
    return df.select(
        *[F.to_json(f.name).alias(f.name) if isinstance(f.dataType, nested) else F.col(f.name) for f in df.schema.fields]
    )
