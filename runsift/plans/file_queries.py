"""SRC, SNK and STM: write-and-read round trips of the given tables through the shared folder."""

from pyspark.sql import functions as F

from runsift.operators import gates as G
from runsift.plans import standins  # noqa: F401
from runsift.plans.registry import query
from runsift.session import scratch_path
from runsift.sources import files as R
from runsift.sources import sinks as W
from runsift.sources.store import KeyedStore
from runsift.streaming import ingest as I

EVENT = "event_id bigint, user_id bigint, event_type string, value double"
EVENT_SQL = "SELECT event_id, user_id, event_type, value FROM events"


def _events(t):
    return t.events.select("event_id", "user_id", "event_type", "value")


def _written(t, name="events"):
    path = scratch_path(t.spark, name)
    W.write_jsonl(_events(t), path)
    return path


@query("src01_jsonl_fail_fast", EVENT_SQL)
def _(t):
    return R.read_jsonl(t.spark, _written(t), EVENT)


def _by_range(t, line, step=1000):
    """Text files of ``step`` event ids each, in order: one line per event."""
    path = scratch_path(t.spark, "ranges")
    rows = t.events.select("event_id", line.alias("value"), F.floor(F.col("event_id") / step).alias("range"))
    rows = rows.repartition("range").sortWithinPartitions("range", "event_id")
    rows.select("value", "range").write.partitionBy("range").text(path)
    return path


@query("src02_jsonl_until_bad", """
SELECT event_id, user_id FROM events e WHERE NOT EXISTS (
  SELECT 1 FROM events b WHERE b.event_id // 1000 = e.event_id // 1000 AND b.value > 300 AND b.event_id <= e.event_id)""")
def _(t):
    line = F.when(F.col("value") > 300, F.lit('{"event_id": 7, "user')).otherwise(F.to_json(F.struct("event_id", "user_id")))
    rows = R.read_jsonl_until_bad(t.spark, f"{_by_range(t, line)}/range=*/*.txt", "event_id bigint, user_id bigint")
    return rows.select("event_id", "user_id")


@query("src03_line_provenance", "SELECT event_id, row_number() OVER (PARTITION BY event_id // 1000 ORDER BY event_id) AS line_no FROM events")
def _(t):
    path = _by_range(t, F.to_json(F.struct("event_id")))
    return R.read_jsonl_numbered(t.spark, f"{path}/range=*/*.txt", "event_id bigint").select("event_id", "line_no")


@query("src04_json_document", "SELECT n_name, n_regionkey FROM nation")
def _(t):
    path = scratch_path(t.spark, "documents")
    t.nation.write.partitionBy("n_nationkey").json(path)
    return R.read_json_document(t.spark, f"{path}/*/*.json", "n_name string, n_regionkey int")


@query("src05_csv_strings", "SELECT CAST(o_orderkey AS STRING) AS o_orderkey, o_orderpriority FROM orders WHERE o_orderstatus = 'F'")
def _(t):
    path = scratch_path(t.spark, "csv")
    W.write_csv(t.orders.select("o_orderkey", "o_orderpriority", "o_orderstatus"), path)
    df = R.read_csv_strings(t.spark, path, ["o_orderkey", "o_orderpriority", "o_orderstatus"], F.col("o_orderstatus") == "F")
    return df.drop("o_orderstatus")


def _by_type(t):
    root = scratch_path(t.spark, "runs")
    _events(t).withColumn("kind", F.col("event_type")).write.partitionBy("kind").json(root)
    return root


@query("src06_glob_scan", "SELECT event_id, event_type, true AS named FROM events")
def _(t):
    df = R.read_glob(t.spark, f"{_by_type(t)}/kind=*/*.json", EVENT)
    return df.select("event_id", "event_type", F.col("source_file").startswith("part-").alias("named"))


@query("src06_array_files", "SELECT event_id, event_type, value, event_id % 500 AS position, true AS named FROM events")
def _(t):
    path = scratch_path(t.spark, "arrays")
    rows = _events(t).withColumn("range", F.floor(F.col("event_id") / 500))
    lists = rows.groupBy("range").agg(F.sort_array(F.collect_list(F.struct("event_id", "event_type", "user_id", "value"))).alias("rows"))
    lists.select("range", F.to_json("rows", {"pretty": "true"}).alias("value")).write.partitionBy("range").text(path)
    df = R.read_array_glob(t.spark, f"{path}/range=*/*.txt", EVENT)
    return df.select("event_id", "event_type", "value", "position", F.col("source_file").startswith("part-").alias("named"))


@query("src07_latest_file", "SELECT event_id, event_type FROM events WHERE event_id // 1000 = (SELECT max(event_id) // 1000 FROM events)")
def _(t):
    # One file per range of ids; the last range is written after all others.
    root = scratch_path(t.spark, "newest")
    rows = _events(t).withColumn("range", F.floor(F.col("event_id") / 1000))
    last = rows.agg(F.max("range")).scalar()
    for part in (rows.where(F.col("range") < last), rows.where(F.col("range") == last)):
        part.repartition("range").write.mode("append").partitionBy("range").json(root)
    return R.latest_file(t.spark, f"{root}/range=*/*.json", EVENT).select("event_id", "event_type")


@query("src08_largest_run", """
WITH n AS (SELECT event_type, count(*) AS n FROM events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1) SELECT event_id, event_type FROM events WHERE event_type = (SELECT event_type FROM n)""")
def _(t):
    return R.largest_run(_events(t), "event_type").select("event_id", "event_type")


@query("src09_shards", EVENT_SQL)
def _(t):
    root = _by_type(t)
    shards = [f"{root}/kind={r[0]}" for r in t.events.select("event_type").distinct().collect()]
    return R.read_shards(t.spark, shards, EVENT)


@query("src10_numeric_arrays", """
SELECT vec_id, d AS depth, round(list_sum(list_transform(embedding[d * 16 + 1 : d * 16 + 16], lambda x: CAST(x AS DOUBLE))), 6) AS total
FROM embeddings, (SELECT unnest(range(4)) AS d)""")
def _(t):
    rows = R.long_vectors(t.embeddings, "vec_id", "embedding", 16)
    total = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x)
    return rows.select("vec_id", "depth", F.round(total, 6).alias("total"))


FILES_SQL = """
SELECT 'range=' || CAST(event_id // 1000 AS STRING) AS folder, sum(strlen(event_type || ',' || CAST(event_id AS STRING)) + 1) AS size_bytes,
  sha256(string_agg(event_type || ',' || CAST(event_id AS STRING), chr(10) ORDER BY event_id) || chr(10)) AS sha256
FROM events GROUP BY 1"""


def _inventory(t):
    path = _by_range(t, F.concat_ws(",", "event_type", "event_id"))
    files = R.file_inventory(t.spark, path).where(F.col("path").endswith(".txt"))
    return files.select(F.substring_index("relative_path", "/", 1).alias("folder"), "size_bytes", "sha256")


@query("src11_file_inventory", FILES_SQL.replace("sum(strlen", "CAST(sum(strlen").replace("+ 1) AS size", "+ 1) AS BIGINT) AS size"))
def _(t):
    return _inventory(t)


@query("src12_row_counts", "SELECT event_type AS kind, count(*) AS \"rows\" FROM events GROUP BY 1")
def _(t):
    counts = R.count_lines(t.spark, f"{_by_type(t)}/kind=*/*.json")
    return counts.groupBy(F.regexp_extract("file", "kind=([a-z]+)", 1).alias("kind")).agg(F.sum("rows").alias("rows"))


@query("snk01_jsonl_overwrite", EVENT_SQL)
def _(t):
    path = _written(t)
    W.write_jsonl(_events(t), path)
    return R.read_jsonl(t.spark, path, EVENT)


@query("snk02_jsonl_append", EVENT_SQL)
def _(t):
    path = scratch_path(t.spark, "append")
    W.append_new(_events(t).where("event_id % 3 <> 0"), path, EVENT, "event_id", [F.col("user_id")])
    W.append_new(_events(t), path, EVENT, "event_id", [F.col("user_id")])
    return W.read_appended(t.spark, path, EVENT, "event_id")


@query("snk03_csv_key_union", """
SELECT CAST(c_custkey AS STRING) AS id, c_mktsegment AS segment, NULL AS brand FROM customer UNION ALL SELECT CAST(p_partkey AS STRING), NULL, p_brand FROM part""")
def _(t):
    path = scratch_path(t.spark, "union")
    W.write_csv_union([t.customer.select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment")),
                       t.part.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("brand"))], path)
    return R.read_csv_strings(t.spark, path, ["id", "segment", "brand"])


@query("snk04_csv_nested_json", """SELECT CAST(event_id AS STRING) AS event_id, '{"k":' || (props->>'k') || '}' AS evidence FROM events""")
def _(t):
    path = scratch_path(t.spark, "nested")
    W.write_csv(t.events.select("event_id", F.from_json("props", "k bigint").alias("evidence")), path)
    return R.read_csv_strings(t.spark, path, ["event_id", "evidence"])


@query("snk05_result_tables", "SELECT condition, final_branch, count(*) AS \"count\" FROM runs GROUP BY 1, 2")
def _(t):
    root = scratch_path(t.spark, "results")
    W.write_results({"branch_counts": t.runs.groupBy("condition", "final_branch").count()}, root)
    return t.spark.read.parquet(f"{root}/branch_counts")


@query("snk06_family_outputs", "SELECT category AS family, condition AS model_key, count(*) AS \"rows\" FROM runs GROUP BY 1, 2")
def _(t):
    rows = t.runs.select("run_id", F.col("category").alias("family"), F.col("condition").alias("model_key"))
    return W.write_families(rows, scratch_path(t.spark, "families"), ["family", "model_key"])


@query("snk07_stage_marker", """
SELECT 'm1' AS model_key, 'sampling' AS stage, 10000 AS expected_records, count(*) AS observed_records, count(*) = 10000 AS complete, sha256('cfg') AS config_sha256 FROM runs""")
def _(t):
    marker = W.stage_marker(t.runs, "m1", "sampling", 10000, ["run_id", "final_branch"], "cfg")
    return marker.drop("checkpoint_sha256", "created_at_utc")


@query("set16_manifest_verification", f"""
WITH f AS ({FILES_SQL}), n AS (SELECT folder, CAST(substr(folder, 7) AS BIGINT) AS i FROM f)
SELECT CASE WHEN i % 5 = 0 THEN 'hash_mismatch' ELSE 'unlisted_file' END AS rule, folder AS id
FROM n WHERE i % 5 < 2 UNION ALL SELECT 'missing_file', 'gone=' || folder FROM n WHERE i % 5 = 2""")
def _(t):
    # The manifest is made in plain SQL functions from the table; it errs on some ranges, lacks some and lists files that are not there.
    line = F.concat_ws(",", "event_type", "event_id")
    rows = t.events.groupBy(F.floor(F.col("event_id") / 1000).alias("i")).agg(F.sort_array(F.collect_list(F.struct("event_id", line.alias("line")))).alias("lines"))
    text = F.concat(F.array_join("lines.line", "\n"), F.lit("\n"))
    listed = rows.select("i", F.concat(F.lit("range="), "i").alias("path"), F.sha2(F.when(F.col("i") % 5 == 0, F.lit("")).otherwise(text), 256).alias("sha256"))
    extra = listed.where("i % 5 = 2").withColumn("path", F.concat(F.lit("gone="), "path"))
    manifest = listed.where("i % 5 <> 1").unionByName(extra).drop("i")
    return G.verify_manifest(_inventory(t).withColumnRenamed("folder", "path"), manifest)


@query("stm01_keyed_ingest", "SELECT event_id, event_type FROM events")
def _(t):
    root = scratch_path(t.spark, "stream")
    rows = t.events.select("event_id", "event_type")
    rows.unionByName(rows.where("event_id % 4 = 0")).write.json(f"{root}/in")
    stream = I.read_stream(t.spark, f"{root}/in", "event_id bigint, event_type string", 1)
    store = KeyedStore(t.spark, f"{root}/store", "event_id bigint, event_type string", ["event_id"])
    I.keyed_ingest(stream, store, f"{root}/checkpoint", ["event_type"]).awaitTermination()
    return store.read()


@query("stm02_running_progress", """
WITH beats AS (SELECT event_type, date_trunc('day', ts) AS beat_start, count(*) AS completed FROM events GROUP BY 1, 2)
SELECT event_type, CAST(beat_start AS TIMESTAMP) AS beat_start, completed, CAST(sum(completed) OVER w AS BIGINT) AS so_far,
  CAST(sum(completed) OVER (PARTITION BY event_type) AS BIGINT) AS expected, completed / 86400.0 AS rows_per_second,
  CAST(sum(completed) OVER w AS DOUBLE) / sum(completed) OVER (PARTITION BY event_type) AS share
FROM beats WINDOW w AS (PARTITION BY event_type ORDER BY beat_start)""")
def _(t):
    # Every batch holds rows of all days, so all but the first are late.
    root = scratch_path(t.spark, "progress")
    rows = t.events.select("event_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    rows.repartition(4, F.xxhash64("event_id")).write.json(f"{root}/in")
    stream = I.read_stream(t.spark, f"{root}/in", "event_id bigint, event_type string, ts timestamp", 1)
    store = I.progress_store(t.spark, f"{root}/store", "event_type string")
    I.running_progress(stream, store, f"{root}/checkpoint", "ts", "1 day").awaitTermination()
    return I.progress_report(store, t.events.groupBy("event_type").agg(F.count("*").alias("expected")))


@query("stm03_resume", "SELECT event_id, event_type FROM events")
def _(t):
    root = scratch_path(t.spark, "resume")
    rows = t.events.select("event_id", "event_type")
    store = KeyedStore(t.spark, f"{root}/store", "event_id bigint, event_type string", ["event_id"])
    run = lambda: I.keyed_ingest(
        I.read_stream(t.spark, f"{root}/in", "event_id bigint, event_type string"), store, f"{root}/checkpoint",
        ["event_type"]).awaitTermination()
    rows.where("event_id % 2 = 0").write.mode("append").json(f"{root}/in")
    run()
    rows.write.mode("append").json(f"{root}/in")
    run()
    return store.read()
