"""Structured Streaming: keyed ingest, running progress, resume."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from runsift.operators.scale import null_safe_join, running_totals
from runsift.sources.store import KeyedStore


def read_stream(spark: SparkSession, folder: str, schema: str, max_files: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.json(folder)


def keyed_ingest(stream: DataFrame, store: KeyedStore, checkpoint: str, order: Sequence[str]) -> StreamingQuery:
    """First row per key over all time, without state: each batch appends the keys the store lacks.

    A batch is in the store whole or not at all, and one that is replayed after
    a crash is skipped or finds its keys stored, so rows are neither lost nor
    repeated.  A new checkpoint folder may go on with the same store.
    """

    def sink(batch: DataFrame, batch_id: int) -> None:
        store.append(batch, [F.col(c) for c in order], checkpoint, batch_id)

    return stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def progress_store(spark: SparkSession, root: str, key_schema: str, **options: int) -> KeyedStore:
    """Rows completed per stage and heartbeat window; ``key_schema`` declares the columns of a stage."""
    schema = f"{key_schema}, beat_start timestamp, beat_end timestamp, completed bigint"
    names = [f.name for f in spark.createDataFrame([], schema).schema][:-1]
    return KeyedStore(spark, root, schema, names, **options)


def running_progress(stream: DataFrame, store: KeyedStore, checkpoint: str, event_time: str, beat: str = "30 seconds") -> StreamingQuery:
    """Count the rows of each batch per stage and window and add them to the store.

    There is no watermark: a late row is added to its own window however late it
    comes.  A replayed batch is not added twice.  Rows without a time have no
    window and are not counted.
    """
    keys = [k for k in store.keys if k not in ("beat_start", "beat_end")]

    def sink(batch: DataFrame, batch_id: int) -> None:
        window = F.window(event_time, beat)
        counts = batch.groupBy(*keys, window.alias("beat")).agg(F.count("*").alias("completed"))
        store.add(counts.select(*keys, F.col("beat.start").alias("beat_start"), F.col("beat.end").alias("beat_end"), "completed"),
                  checkpoint, batch_id)

    return stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def progress_report(store: KeyedStore, expected: DataFrame) -> DataFrame:
    """Windows beside the expected count of their stage: rows in the window, rows so far, rows a second, share done.

    ``expected`` has the stage columns and ``expected``; a stage without a plan
    has a null there and a null share.
    """
    keys = [k for k in store.keys if k not in ("beat_start", "beat_end")]
    so_far = running_totals(store.read(), keys, ["beat_start"], {"so_far": "completed"})
    seconds = F.unix_seconds("beat_end") - F.unix_seconds("beat_start")
    out = null_safe_join(so_far, expected.select(*keys, "expected"), keys, "left")
    return out.select(
        *keys, "beat_start", "completed", "so_far", "expected", (F.col("completed") / seconds).alias("rows_per_second"),
        (F.col("so_far") / F.nullif(F.col("expected"), F.lit(0))).alias("share"))
