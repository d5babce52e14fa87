import json
import statistics
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from runsift.operators import gates as G
from runsift.operators import joins as J
from runsift.operators import pivots as P
from runsift.operators import scale
from runsift.operators import summary as S
from runsift.sources import files as R
from runsift.sources import sinks as W

ROOT = Path(__file__).resolve().parents[1]


@pytest.fixture(scope="module")
def skewed(spark):
    """2,000 rows, a third of them under one key, many ties."""
    df = spark.range(2000).select(
        F.col("id"), F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50).alias("k"), (F.col("id") * 7919 % 41).alias("v"))
    return df.repartition(6).cache()


def test_running_totals_over_a_hot_key(skewed):
    rows = scale.running_totals(skewed, ["k"], ["v", "id"], {"run": "v"}).collect()
    by = {}
    for r in sorted(rows, key=lambda r: (r["k"], r["v"], r["id"])):
        by[r["k"]] = by.get(r["k"], 0) + r["v"]
        assert r["run"] == by[r["k"]]
    assert len(rows) == 2000


def test_median_does_not_depend_on_partitions(skewed):
    want = {}
    for r in skewed.collect():
        want.setdefault(r["k"], []).append(r["v"])
    for n in (1, 9):
        got = {r["k"]: r["median"] for r in S.median_by(skewed.repartition(n), ["k"], "v").collect()}
        assert got == {k: statistics.median(v) for k, v in want.items()}


def test_keep_last_is_idempotent(skewed):
    once = P.keep_last(skewed, ["k"], [F.col("v"), F.col("id")])
    twice = P.keep_last(once, ["k"], [F.col("v"), F.col("id")])
    assert sorted(once.collect()) == sorted(twice.collect()) and once.count() == skewed.select("k").distinct().count()


def test_margin_bins_small_branch_and_zero(spark):
    df = spark.createDataFrame([(i, "Q", float(i)) for i in range(4)], "id int, b string, m double")
    got = {r["id"]: r["margin_bin"] for r in P.margin_bins(df, "b", "m", "id", 2).collect()}
    assert got == {0: "low", 1: "low", 2: "high", 3: "high"}
    assert P.margin_bins(df, "b", "m", "id", 0).count() == 0


def test_null_keys(spark):
    df = spark.createDataFrame([(None, 1), ("a", 2)], "k string, v int")
    assert S.contingency(df, ["k"]).count() == 1 and S.contingency(df, ["k"], keep_null_keys=True).count() == 2
    joined, problems = J.one_to_one_left_join(df, df.withColumnRenamed("v", "w"), ["k"])
    assert sorted(r["w"] for r in joined.collect()) == [1, 2] and problems.count() == 0


def test_empty_stratum_rates(spark):
    df = spark.createDataFrame([("c1", "x", "Q"), ("c2", "y", "R")], "c string, g string, b string")
    grid = S.zero_filled_counts(df, "c", "g", "b", ["c1", "c3"], ["Q", "R"])
    rates = S.with_partition_rate(grid, ["c", "g"], "total")
    assert rates.count() == 8 and rates.where("c = 'c3' and rate is not null").count() == 0
    assert S.macro_rates(rates, ["c", "b"]).where("c = 'c1' and b = 'Q'").first()["macro_rate"] == 1.0
    assert df.select(S.percent(F.lit(3), F.lit(0))).first()[0] == 0.0


def test_exact_gate(spark):
    plan = spark.createDataFrame([(i,) for i in range(5)], "id int")
    assert G.exact_ids(plan, plan, "id").count() == 0
    seen = spark.createDataFrame([(0,), (0,), (1,), (2,), (9,)], "id int")
    assert sorted(map(tuple, G.exact_ids(plan, seen, "id").collect())) == [
        ("duplicate", "0"), ("extra", "9"), ("missing", "3"), ("missing", "4")]


def test_label_rules_each_fire(spark):
    rows = [("FOLLOW", None, None, "normal"), ("X", "", "", "normal"), (None, "", "", "normal"),
            ("FINAL_STAGE_TRANSPARENT_CORRECTION", None, "", "normal"), ("SILENT_BYPASS_REANCHOR", "compare", "", "normal"),
            ("COT_STAGE_CORRECTION", "", None, "normal"), ("ANSWER_ONLY_FOLLOW", "", "", None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, l string, b string, s string, f string")
    valid = [r[0] for r in rows if r[0] and r[0] != "X"]
    got = {int(r["id"]): r["rule"] for r in G.row_problems(df, "i", G.label_rules("l", "b", "s", "f", valid)).collect()}
    assert got == {1: "invalid_label", 2: "invalid_label", 3: "transparent_without_bridge", 4: "silent_with_bridge_marked",
                   5: "cot_correction_boundary_state_check", 6: "answer_only_label_on_normal_row"}


def test_jsonl_readers(spark, tmp_path):
    good = tmp_path / "good.jsonl"
    good.write_bytes(b"\xef\xbb\xbf" + b'{"a": 1}\n\n{"a": 2, "b": "x"}\n')
    assert [r["a"] for r in R.read_jsonl(spark, str(good), "a int, b string").collect()] == [1, 2]
    assert R.read_jsonl(spark, str(tmp_path / "none.jsonl"), "a int").count() == 0
    bad = tmp_path / "bad.jsonl"
    bad.write_text('{"a": 1}\n{"a": 2}\n{"a": 3\n{"a": 4}\n{"a"')
    with pytest.raises(Exception):
        R.read_jsonl(spark, str(bad), "a int").collect()
    kept = R.read_jsonl_until_bad(spark, str(bad), "a int")
    assert sorted((r["line_no"], r["a"]) for r in kept.collect()) == [(1, 1), (2, 2)]
    lines = R.read_jsonl_numbered(spark, _plain(tmp_path), "a int").collect()
    assert sorted((r["line_no"], r["a"]) for r in lines) == [(1, 1), (3, 3)]


def _plain(tmp_path):
    p = tmp_path / "plain.jsonl"
    p.write_text('{"a": 1}\n\n{"a": 3}\n')
    return str(p)


def test_line_numbers_over_many_splits(spark, tmp_path):
    p = tmp_path / "long.jsonl"
    p.write_text("".join(json.dumps({"a": i, "pad": "x" * (i % 97)}) + "\n" for i in range(3000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        df = R.read_jsonl_numbered(spark, str(p), "a int")
        assert df.rdd.getNumPartitions() >= 1 and df.where("line_no <> a + 1").count() == 0 and df.count() == 3000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_missing_shard_and_latest_and_npz(spark, tmp_path):
    import numpy as np

    (tmp_path / "s1.json").write_text('{"a": 1}\n')
    with pytest.raises(FileNotFoundError):
        R.read_shards(spark, [str(tmp_path / "s1.json"), str(tmp_path / "s2.json")], "a int")
    np.savez(tmp_path / "h.npz", hidden=np.arange(12, dtype="float16").reshape(2, 3, 2), k=np.array([0, 1, 4], dtype="int32"))
    rows = R.read_npz(spark, str(tmp_path / "h.npz")).collect()
    assert len(rows) == 6 and {r["k"] for r in rows} == {0, 1, 4}


def test_append_is_idempotent_and_csv_round_trip(spark, tmp_path):
    path, schema = str(tmp_path / "store"), "id int, t string"
    df = spark.createDataFrame([(1, 'a "b",\nc'), (2, None), (1, "z")], schema)
    for _ in range(2):
        W.append_new(df, path, schema, "id", [F.col("t")])
    assert sorted(r["id"] for r in W.read_appended(spark, path, schema, "id").collect()) == [1, 2]
    W.write_csv(df.limit(1).withColumn("n", F.struct("id")), str(tmp_path / "csv"))
    r = R.read_csv_strings(spark, str(tmp_path / "csv"), ["id", "t", "n"]).first()
    assert (r["t"], r["n"]) == ('a "b",\nc', '{"id":1}')


def test_entry_needs_no_session_to_list_queries():
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q); print(len(q))"
    out = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr
    assert int(out.stdout) > 200
