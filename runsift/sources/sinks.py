"""Writers; Spark's commit protocol stands in for temporary files and renames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runsift.functions.hashing import utc_timestamp
from runsift.functions.projections import nested_as_json
from runsift.sources.store import KeyedStore


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def append_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("append").option("ignoreNullFields", False).json(path)


def append_new(batch: DataFrame, path: str, schema: str, key: str, order: Sequence[Column]) -> DataFrame:
    """Append the rows whose id is not stored yet to a keyed JSONL store; returns the rows stored.

    Running it twice changes nothing.  Only the buckets of the batch's ids are
    read; ``read_appended`` reads the whole store.
    """
    return KeyedStore(batch.sparkSession, path, schema, [key], "json").append(batch, order)


def read_appended(spark: SparkSession, path: str, schema: str, key: str) -> DataFrame:
    """All rows of a keyed JSONL store."""
    return KeyedStore(spark, path, schema, [key], "json").read()


def write_csv_union(parts: Sequence[DataFrame], path: str) -> None:
    """CSV over the union of all columns, in first-seen order; a missing value is empty."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    write_csv(out, path)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with nested columns as JSON text."""
    (nested_as_json(df).write.mode("overwrite").option("header", True).option("escape", '"')
     .option("emptyValue", "").option("nullValue", "").csv(path))


def write_results(tables: dict[str, DataFrame], root: str, fmt: str = "parquet") -> None:
    """One folder per named result table."""
    for name, df in tables.items():
        if fmt == "csv":
            write_csv(df, f"{root}/{name}")
        else:
            df.write.mode("overwrite").parquet(f"{root}/{name}")


def write_families(df: DataFrame, path: str, keys: Sequence[str]) -> DataFrame:
    """One partition folder per family and model; returns the row count of each."""
    df.write.mode("overwrite").partitionBy(*keys).parquet(path)
    written = df.sparkSession.read.parquet(path)
    return written.groupBy(*keys).agg(F.count("*").alias("rows"))


def content_hash(df: DataFrame, columns: Sequence[str]) -> Column:
    """Order-free fingerprint of a table's rows, as an aggregate column."""
    return F.sha2(F.sum(F.xxhash64(*columns).cast("decimal(38,0)")).cast("string"), 256)


def stage_marker(df: DataFrame, model: str, stage: str, expected: int, columns: Sequence[str], config: str) -> DataFrame:
    """One manifest row: expected and observed rows, completeness, fingerprints, time."""
    return df.agg(
        F.lit(model).alias("model_key"), F.lit(stage).alias("stage"), F.lit(expected).alias("expected_records"),
        F.count("*").alias("observed_records"), (F.count("*") == expected).alias("complete"),
        content_hash(df, columns).alias("checkpoint_sha256"), F.sha2(F.lit(config), 256).alias("config_sha256"),
    ).withColumn("created_at_utc", utc_timestamp())
