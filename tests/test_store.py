from datetime import datetime

import pytest
from pyspark.sql import functions as F

from runsift.sources.store import KeyedStore
from runsift.streaming import ingest

SCHEMA = "id bigint, t string"


def _store(spark, tmp_path, **options):
    return KeyedStore(spark, str(tmp_path / "store"), SCHEMA, ["id"], **options)


def _rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_first_row_of_a_key_stays_and_null_is_a_key(spark, tmp_path):
    store = _store(spark, tmp_path)
    assert store.read().count() == 0 and store.read().columns == ["id", "t"]
    batch = spark.createDataFrame([(1, "b"), (1, "a"), (None, "n"), (2, "c"), (2, "c")], SCHEMA)
    stored = store.append(batch, [F.col("t")])
    assert _rows(stored) == [(1, "a"), (2, "c"), (None, "n")]
    assert store.append(batch.unionByName(spark.createDataFrame([(3, "d"), (1, "0")], SCHEMA)), [F.col("t")]).collect() == [(3, "d")]
    assert store.append(batch.limit(0), [F.col("t")]).count() == 0
    assert _rows(store.read()) == [(1, "a"), (2, "c"), (3, "d"), (None, "n")]
    assert store.doubled_keys().count() == 0


def test_stored_keys_do_not_pass_through_the_driver(spark, tmp_path, monkeypatch):
    """The join with the stored keys was a broadcast in each batch, so the driver received them all again and again."""
    plans, store = [], _store(spark, tmp_path)
    write = store._write
    monkeypatch.setattr(store, "_write", lambda placed, state: plans.append(placed._jdf.queryExecution().executedPlan().toString()) or write(placed, state))
    for _ in range(2):
        store.append(spark.createDataFrame([(1, "b"), (None, "n")], SCHEMA), [F.col("t")])
    assert "SortMergeJoin" in plans[1] and "Broadcast" not in plans[1] and store.read().count() == 2


def test_the_last_batch_reads_as_much_as_the_first(spark, tmp_path):
    store = _store(spark, tmp_path, buckets=2, target_bytes=8000, max_parts=2)
    for i in range(10):
        store.append(spark.range(i * 120, i * 120 + 120).select("id", F.sha2(F.col("id").cast("string"), 256).alias("t")), [F.col("t")])
    state = store._load()
    assert state["buckets"] >= 16 and all(len(parts) <= 2 for parts in state["live"].values())
    for key in (5, 700, 1199, 100_000):
        touched = store._touched(store._place(spark.createDataFrame([(key, "x")], SCHEMA), state["buckets"]))
        assert len(touched) == 1 and len(store._folders(state, touched)) <= 2
        assert store._rows(state, touched).count() <= 240  # two batches, of ten stored
    assert store.read().count() == 1200 and store.doubled_keys().count() == 0


def test_a_write_without_its_manifest_is_not_seen(spark, tmp_path, monkeypatch):
    store = _store(spark, tmp_path)
    store.append(spark.createDataFrame([(1, "a")], SCHEMA), [F.col("t")], "s", 0)

    def crash(self, state):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(KeyedStore, "_commit", crash)
        with pytest.raises(OSError):
            store.append(spark.createDataFrame([(2, "b")], SCHEMA), [F.col("t")], "s", 1)
    assert _rows(store.read()) == [(1, "a")]
    store.append(spark.createDataFrame([(2, "b")], SCHEMA), [F.col("t")], "s", 1)
    store.append(spark.createDataFrame([(2, "b"), (9, "z")], SCHEMA), [F.col("t")], "s", 1)  # committed before: skipped
    assert _rows(store.read()) == [(1, "a"), (2, "b")]
    assert store.vacuum(1) == 1
    assert _rows(store.read()) == [(1, "a"), (2, "b")]


def test_a_second_writer_of_a_version_fails(spark, tmp_path):
    store = _store(spark, tmp_path)
    state = store._load()
    store.append(spark.createDataFrame([(1, "a")], SCHEMA), [F.col("t")])
    with pytest.raises(RuntimeError, match="another writer"):
        store._commit(state)


def test_merge_double_and_vacuum_keep_all_rows(spark, tmp_path):
    store = _store(spark, tmp_path, buckets=1, target_bytes=3000, max_parts=2)
    for i in range(5):
        store.append(spark.range(i * 10, i * 10 + 15).select("id", F.lit(f"batch {i}").alias("t")), [F.col("t")])
    want = [(k, f"batch {max(0, (k - 5) // 10)}") for k in range(55)]
    assert sorted(map(tuple, store.read().collect())) == want
    assert store.vacuum() > 0 and store.vacuum() == 0
    assert sorted(map(tuple, store.read().collect())) == want


def test_stream_ingest_is_idempotent(spark, tmp_path):
    src, cp = str(tmp_path / "in"), str(tmp_path / "cp")
    store = _store(spark, tmp_path)
    df = spark.createDataFrame([(1, "b"), (1, "a"), (2, "c")], SCHEMA)
    for _ in range(2):
        df.write.mode("append").json(src)
        ingest.keyed_ingest(ingest.read_stream(spark, src, SCHEMA), store, cp, ["t"]).awaitTermination()
    ingest.keyed_ingest(ingest.read_stream(spark, src, SCHEMA), store, cp + "2", ["t"]).awaitTermination()
    assert _rows(store.read()) == [(1, "a"), (2, "c")]


def test_progress_counts_late_rows_and_no_batch_twice(spark, tmp_path):
    src, cp = str(tmp_path / "in"), str(tmp_path / "cp")
    schema = "stage string, ts timestamp"
    store = ingest.progress_store(spark, str(tmp_path / "store"), "stage string")
    at = lambda minute, second: datetime(2024, 1, 1, 0, minute, second)
    batches = [[("a", at(50, 1)), ("b", at(0, 0)), ("a", None)], [("a", at(0, 5)), ("a", at(0, 29)), (None, at(0, 1))], [("a", at(50, 2)), ("a", at(0, 30))]]
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(src)
        ingest.running_progress(ingest.read_stream(spark, src, schema), store, cp, "ts").awaitTermination()
    store.add(store.read(), cp, 2)  # a replay of the last batch
    plan = spark.createDataFrame([("a", 10), ("b", 0)], "stage string, expected bigint")
    got = {(r.stage, r.beat_start): (r.completed, r.so_far, r.expected, r.share) for r in ingest.progress_report(store, plan).collect()}
    assert got == {
        ("a", at(0, 0)): (2, 2, 10, 0.2), ("a", at(0, 30)): (1, 3, 10, 0.3), ("a", at(50, 0)): (2, 5, 10, 0.5),
        ("b", at(0, 0)): (1, 1, 0, None), (None, at(0, 0)): (1, 1, None, None)}
