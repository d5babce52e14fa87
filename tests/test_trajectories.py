"""Null scores by matrix products against a refit of every repetition."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from runsift.operators import metrics as M
from runsift.operators import resampling as X
from runsift.operators import trajectories as T

SEED = 11


def plain_sources(cover, reps):
    """(rep, group) to its source, by sorting digests inside each stratum."""
    out, kinds = {}, {}
    for g, variants in cover.items():
        kinds.setdefault(tuple(sorted(variants)), []).append(g)
    for members in kinds.values():
        members.sort()
        for rep in range(reps):
            drawn = sorted(members, key=lambda g: hashlib.sha256(f"{SEED}:{rep}:{g}".encode()).hexdigest())
            out.update({(rep, g): s for g, s in zip(members, drawn)})
    return out


def unit(x):
    return x / max(np.linalg.norm(x), 1e-12)


@pytest.mark.parametrize("bundle, block", [(256, 250), (3, 4)])
def test_null_scores_equal_refits(spark, bundle, block):
    rng = np.random.default_rng(8)
    # Group 0 is alone in its stratum and holds a third of the rows.
    rows = [(0, v) for v in range(15)] + [(g, v) for g in range(1, 7) for v in range(4)] + [(g, v) for g in (7, 8) for v in range(3)]
    label = {gv: int(rng.integers(0, 2)) for gv in rows}
    data = [(i, g, v, label[g, v], d, rng.normal(size=5).tolist()) for i, (g, v) in enumerate(rows) for d in range(2)]
    df = spark.createDataFrame(data, "id int, g int, v int, y int, depth int, vec array<double>").repartition(3)
    reps = 9
    source = plain_sources({g: [v for h, v in rows if h == g] for g in range(9)}, reps)
    want = []
    for rep in range(reps):
        moved = [label[source[rep, g], v] for _, g, v, *_ in data]
        for (i, g, v, _, d, x), y in zip(data, moved):
            part = [[unit(np.array(r[5])) for r, m in zip(data, moved) if r[4] == d and r[1] != g and m == k] for k in (1, 0)]
            score = unit(np.array(x)) @ (unit(np.sum(part[0], axis=0)) - unit(np.sum(part[1], axis=0)))
            want.append((d, rep, y, round(float(score), 9)))
    out = T.null_scores(df, "id", "g", "v", "y", "vec", ["depth"], reps, SEED, bundle, block)
    got = [(r["depth"], r["rep"], r["permuted"], round(r["score"], 9)) for r in out.collect()]
    assert len(got) == len(want)
    for a, b in zip(sorted(got), sorted(want)):
        assert a[:3] == b[:3] and abs(a[3] - b[3]) < 1e-8
    labels = X.permute_labels(df.where("depth = 0"), "g", "v", "y", reps, SEED).collect()
    assert {(r["rep"], r["g"], r["v"]): r["permuted"] for r in labels} == {(rep, g, v): label[source[rep, g], v] for rep in range(reps) for g, v in rows}


def test_missing_class_nulls_and_no_rows(spark):
    schema = "id int, g int, v int, y int, vec array<double>"
    run = lambda rows: T.null_scores(spark.createDataFrame(rows, schema), "id", "g", "v", "y", "vec", [], 3, SEED).collect()
    assert {r["score"] for r in run([(1, 1, 0, 1, [1.0]), (2, 2, 1, 0, [2.0])])} == {None}
    odd = run([(1, None, None, 1, [1.0, 0.0]), (2, 2, None, 0, [0.0, 1.0]), (3, 3, 0, 1, [1.0, 1.0]), (4, 4, 0, 0, [0.0, 2.0]), (5, 4, 1, 0, None)])
    assert len(odd) == 12 and all(r["score"] is not None for r in odd)
    assert run([]) == []


@pytest.mark.parametrize("by", [["depth"], []])
@pytest.mark.parametrize("cells, most", [(1 << 16, 4096), (64, 3), (2, 1)])
def test_aucs_equal_ranking_all_scores(spark, by, cells, most):
    rng = np.random.default_rng(9)
    # Few distinct vectors, so that scores tie or differ in the last digit, by the order of sums; small cells and ranges put them on every path.
    data = [(i, i % 6, i // 6, int(rng.integers(0, 2)), i % 2 if by else 0, rng.integers(0, 2, 3).astype(float).tolist()) for i in range(48)]
    df = spark.createDataFrame(data, "id int, g int, v int, y int, depth int, vec array<double>").repartition(3)
    args = ("id", "g", "v", "y", "vec", by, 7, SEED)
    scored = M.roc_auc(T.null_scores(df, *args).where("score is not null"), ["rep", *by], "permuted", "score")
    want = {tuple(r[k] for k in ("rep", *by)): r["roc_auc"] for r in scored.collect()}
    got = {tuple(r[k] for k in ("rep", *by)): r["roc_auc"] for r in T.null_aucs(df, *args, bundle=5, block=3, cells=cells, most=most).collect()}
    assert got.keys() == want.keys() and len(got) == 7 * (2 if by else 1)
    assert all(abs(got[k] - want[k]) < 0.02 for k in want) and sum(abs(got[k] - want[k]) < 1e-9 for k in want) >= len(want) - 2


def test_aucs_of_no_rows(spark):
    df = spark.createDataFrame([], "id int, g int, v int, y int, vec array<double>")
    assert T.null_aucs(df, "id", "g", "v", "y", "vec", [], 3, SEED).collect() == []


def test_aucs_move_no_scores(spark, monkeypatch):
    """Rows x repetitions of scores went to disk before; chunks of few numbers meet in pairs and give the same areas."""
    rng = np.random.default_rng(10)
    data = [(i, i % 5, i // 5, int(rng.integers(0, 2)), None if i % 2 else "a", rng.normal(size=3).tolist()) for i in range(60)]
    df = spark.createDataFrame(data, "id int, g int, v int, y int, k string, vec array<double>")
    written, keep = [], T._written
    monkeypatch.setattr(T, "_written", lambda rows, name: written.append(rows) or keep(rows, name))
    args = ("id", "g", "v", "y", "vec", ["k"], 6, SEED)
    run = lambda **sizes: {(r["rep"], r["k"]): r["roc_auc"] for r in T.null_aucs(df, *args, **sizes).collect()}
    whole, cut = run(), run(bundle=2, block=4, cells=40, most=1)
    assert len(whole) == 12 and whole.keys() == cut.keys() and all(abs(whole[k] - cut[k]) < 1e-9 for k in whole)
    assert written and not any({"score", "positive"} & set(rows.columns) for rows in written)
