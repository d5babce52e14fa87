import sys
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import __spark_entry__  # noqa: E402
import corpus_pipeline  # noqa: E402
from runsift.llm import balltree, mixing, neardup, quality, warc  # noqa: E402
from runsift.llm.queries import ORACLES, QUERIES  # noqa: E402
from runsift.llm.shared import documents  # noqa: E402
from tools.check_oracle import canonical  # noqa: E402

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_twin(spark, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings", "pages"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    result = QUERIES[name](spark, SF)
    cursor = con.execute(ORACLES[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(result.columns)
    assert canonical([tuple(r) for r in result.collect()], result.columns) == canonical(cursor.fetchall(), columns)


def test_registered():
    names = set(__spark_entry__.queries())
    assert {f"op{n}_" for n in range(1, 11)} <= {q.split("_")[0] + "_" for q in names} and "pipeline" in names


def plain_top(rows, k):
    vectors = {i: np.floor(1024 * np.array(v, np.float64)) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v)}
    out = {}
    for q in vectors:
        if q % 100 == 0:
            ranked = sorted((-int(vectors[q] @ v), i) for i, v in vectors.items() if i != q)[:k]
            out[q] = [(i, -s) for s, i in ranked]
    return out


def test_top_k_with_shards_blocks_and_ties(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in np.round(rng.normal(size=6), 1)]) for i in range(900)]
    rows += [(1000, None), (1001, []), (1002, [float("nan")] * 6), (1003, [None, *[1.0] * 5]), (1004, [float("inf")] * 6)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("x"))
    rows = [(r.vec_id, r.embedding) for r in table.collect()]
    for shard_rows, block_rows in ((8192, 2048), (150, 4), (2000, 2)):
        got = {}
        for r in balltree.top_k(table, F.col("vec_id") % 100 == 0, shard_rows=shard_rows, block_rows=block_rows).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert got == plain_top(rows, 10)
    few = table.where("vec_id < 4")
    assert balltree.top_k(few, F.col("vec_id") == 0).count() == 3
    assert balltree.top_k(table.limit(0), F.col("vec_id") == 0).count() == 0


def test_mix_cases(odd_docs, no_docs):
    rows = mixing.decide(odd_docs).collect()
    assert len(rows) == odd_docs.count() and all(0 <= r.taken <= 2 * r.size and r.taken % max(r.size, 1) == 0 for r in rows)
    total = sum(r.size for r in rows)
    targets = {r.source_size: r.target for r in rows}
    assert sum(targets.values()) == pytest.approx(1.5 * total) and all(t <= 2 * s for s, t in targets.items())
    mix = mixing.mix(odd_docs)
    assert mix.columns == odd_docs.columns
    assert sorted((r[0] or -1) for r in mix.select("doc_id").collect()) == sorted(
        i for r in rows for i in [(r.doc_id or -1)] * (r.taken // r.size if r.size else 0))
    assert mixing.decide(no_docs).count() == 0 and mixing.mix(no_docs).count() == 0


def test_audit_finds_every_change(spark):
    rows = [(f, 700 * i, f"{f}-{i}") for f in ("a", "b", None) for i in range(900)]
    primary = spark.createDataFrame(rows, "file string, offset long, digest string")
    changed = {("a", 0), ("b", 700 * 899), (None, 700 * 450)}
    lost = {("a", 700 * 7), ("b", 0)}
    other = [(f, o, "bad" if (f, o) in changed else d) for f, o, d in rows if (f, o) not in lost] + [("new", 5, "d")]
    replica = spark.createDataFrame(other, "file string, offset long, digest string")
    found = {(r.file, r.offset): (r.primary_digest, r.replica_digest) for r in warc.audit(primary, replica).collect()}
    assert set(found) == changed | lost | {("new", 5)} and all(found[k][1] is None for k in lost) and found["new", 5][0] is None
    assert warc.audit(primary, primary).count() == 0
    nothing = primary.limit(0)
    assert warc.audit(nothing, nothing).count() == 0 and warc.audit(nothing, primary.limit(5)).count() == 5


def plain_audit(primary, replica):
    """(file, offset) to the sorted digests of both sides and the first place of the primary's, where the sides disagree."""
    sides = []
    for rows in (primary, replica):
        held = {}
        for f, o, d in rows:
            held.setdefault((f, o), []).append(d or "")
        sides.append({k: ",".join(sorted(v)) for k, v in held.items()})
    apart = [k for k in sides[0].keys() | sides[1].keys() if sides[0].get(k) != sides[1].get(k)]
    places = {}
    for f, o in apart:
        d = sides[1].get((f, o))
        if d is not None:
            places.setdefault((f, d), []).append(o)
    first = lambda k: min((o for o in places.get((k[0], sides[0].get(k)), []) if o is not None), default=None)
    return {(*k, sides[0].get(k), sides[1].get(k), first(k)) for k in apart}


@pytest.mark.parametrize("change", ["moved in a range", "moved over ranges", "shifted", "swapped", "repeated", "null offsets", "null digests", "shorter tree"])
def test_audit_equals_comparing_all_records(spark, change):
    rows = [(f, 9_000 * i, f"{f}-{i}") for f in ("a", "b", None) for i in range(60)]
    other = list(rows)
    if change == "moved in a range":
        other[7] = ("a", 9_000 * 7 + 200, "a-7")
    elif change == "moved over ranges":
        other = [(f, o + 70_000 if f == "b" and 70_000 <= o < 140_000 else o, d) for f, o, d in rows if f != "b" or not 140_000 <= o < 210_000]
    elif change == "shifted":
        other = [(f, o - 9_000 if f is None and o > 90_000 else o, d) for f, o, d in rows if (f, o) != (None, 90_000)]
    elif change == "swapped":
        other[3], other[4] = ("a", rows[3][1], "a-4"), ("a", rows[4][1], "a-3")
    elif change == "repeated":
        rows, other = rows + [("b", 18_000, "more")] * 2, rows + [("b", 18_000, "more"), ("a", 0, "a-0")]
    elif change == "null offsets":
        rows, other = rows + [("a", None, "x"), (None, None, "y"), ("b", None, "z")], other + [("a", None, "x"), (None, None, "other"), ("c", None, "z")]
    elif change == "null digests":
        rows, other = rows + [("a", 5, None), ("b", 5, None), ("b", 6, None)], other + [("a", 5, None), ("a", 5, None), ("b", 5, "d")]
    else:
        other = rows[:5]
    frames = [spark.createDataFrame(r, "file string, offset long, digest string").withColumn("hash", F.lit(1)) for r in (rows, other)]
    got = [tuple(r) for r in warc.audit(*frames).select("file", "offset", "primary_digest", "replica_digest", "found_at").collect()]
    assert len(got) == len(set(got)) and set(got) == plain_audit(rows, other)


def test_pipeline_against_brute_force(spark):
    from tests.llm.test_dedup import brute

    docs = documents(spark, SF)
    model = quality.fit(docs, documents(spark, SF, "labels"))
    good = {r.doc_id for r in quality.score(docs, model).where("predicted = 1").collect()}
    last = {}
    for r in sorted((r for r in docs.collect() if r.doc_id in good), key=lambda r: r.doc_id):
        last[r.text] = r
    texts = {r.doc_id: r.text for r in last.values()}
    kept = {i for i, (_, c) in brute(texts, 5).items() if i == c}
    left = docs.where(F.col("doc_id").isin(*kept))
    want = {r.doc_id: r.taken // r.size for r in mixing.decide(left).where("taken > 0").collect()}
    got = {r.doc_id: r["count"] for r in corpus_pipeline.run(spark, SF).groupBy("doc_id").count().collect()}
    assert got == want
    assert [c for _, stage in corpus_pipeline.STAGES[:2] for c in stage(spark, docs, SF).columns] == docs.columns * 2
    assert neardup.keep_one_each(docs).columns == docs.columns
