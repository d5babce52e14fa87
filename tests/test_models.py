import numpy as np
import pytest
from pyspark.sql import functions as F

from runsift.operators import metrics as M
from runsift.operators import models as Q
from runsift.operators import resampling as X
from runsift.operators import vectors as V

RNG = np.random.default_rng(5)
N, D = 60, 4
VEC = RNG.normal(size=(N, D))
LABEL = (VEC[:, 0] + RNG.normal(size=N) > 0).astype(int)
# Group 0 holds a third of all rows.
GROUP = np.where(np.arange(N) % 3 == 0, 0, np.arange(N) % 7)


@pytest.fixture(scope="module")
def rows(spark):
    data = [(i, int(GROUP[i]), int(LABEL[i]), VEC[i].tolist()) for i in range(N)]
    return spark.createDataFrame(data, "row_id int, g int, label int, vec array<double>").repartition(5).cache()


def unit(x):
    return x / np.clip(np.linalg.norm(x, axis=-1, keepdims=True), 1e-12, None)


@pytest.mark.parametrize("weighted", [False, True])
def test_centroids_equal_the_refit(rows, weighted):
    u, want = unit(VEC), {}
    size = np.bincount(GROUP, minlength=7)
    for g in np.unique(GROUP):
        cents = []
        for y in (1, 0):
            m = (GROUP != g) & (LABEL == y)
            w = 1 / size[GROUP[m]] if weighted else np.ones(m.sum())
            cents.append(unit((u[m] * w[:, None]).sum(axis=0)))
        for i in np.where(GROUP == g)[0]:
            want[i] = u[i] @ cents[0] - u[i] @ cents[1]
    got = {r["row_id"]: r["score"] for r in V.centroid_scores(rows, "row_id", "g", "label", "vec", weighted=weighted).collect()}
    assert all(abs(got[i] - want[i]) < 1e-9 for i in want)


def test_missing_class_gives_null_or_error(spark):
    df = spark.createDataFrame([(1, 1, 1, [1.0]), (2, 2, 0, [2.0])], "row_id int, g int, label int, vec array<double>")
    assert [r["score"] for r in V.centroid_scores(df, "row_id", "g", "label", "vec").collect()] == [None, None]
    with pytest.raises(Exception, match="no class"):
        V.centroid_scores(df, "row_id", "g", "label", "vec", strict=True).collect()


def newton(z, y, w):
    z, b = np.c_[z, np.ones(len(z))], np.zeros(z.shape[1] + 1)
    pen = np.r_[np.ones(z.shape[1] - 1), 0]
    for _ in range(60):
        p = 1 / (1 + np.exp(-z @ b))
        b = b - np.linalg.solve((z * (w * p * (1 - p))[:, None]).T @ z + np.diag(pen), z.T @ (w * (p - y)) + pen * b)
    return b


@pytest.mark.parametrize("transform", [None, "scale", "pca"])
def test_held_out_logistic(rows, transform):
    want = {}
    for g in np.unique(GROUP):
        tr, te = np.where(GROUP != g)[0], np.where(GROUP == g)[0]
        a, b = VEC[tr], VEC[te]
        if transform == "scale":
            mu, sd = a.mean(axis=0), a.std(axis=0)
            a, b = (a - mu) / sd, (b - mu) / sd
        elif transform == "pca":
            mu = a.mean(axis=0)
            _, s, vt = np.linalg.svd(a - mu, full_matrices=False)
            k = min(2, len(tr) - 2, D)
            scale = vt[:k].T / (s[:k] / np.sqrt(len(tr) - 1))
            a, b = (a - mu) @ scale, (b - mu) @ scale
        y, n = LABEL[tr], len(tr)
        size = np.bincount(GROUP[tr], minlength=7)
        w = (1 / size[GROUP[tr]]) * np.where(y == 1, n / (2 * y.sum()), n / (2 * (n - y.sum())))
        beta = newton(a, y, w)
        for i, s in zip(te, np.c_[b, np.ones(len(b))] @ beta):
            want[i] = s
    out = Q.group_held_out_scores(rows, "row_id", "g", "label", F.col("vec"), D, transform=transform, components=2)
    got = {r["row_id"]: r["score"] for r in out.collect()}
    assert all(abs(got[i] - want[i]) < 1e-5 for i in want)


def test_auc_ties_sign_and_one_class(spark):
    data = [("a", int(RNG.integers(0, 2)), float(RNG.integers(0, 4))) for _ in range(80)] + [("b", 1, 1.0)]
    df = spark.createDataFrame(data, "k string, label int, score double")
    got = {r["k"]: r["roc_auc"] for r in M.roc_auc(df, ["k"], "label", "score").collect()}
    neg = {r["k"]: r["roc_auc"] for r in M.roc_auc(df.withColumn("score", -F.col("score")), ["k"], "label", "score").collect()}
    pos, rest = [s for k, y, s in data if k == "a" and y], [s for k, y, s in data if k == "a" and not y]
    want = np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in rest])
    assert abs(got["a"] - want) < 1e-12 and abs(got["a"] + neg["a"] - 1) < 1e-12 and got["b"] is None


def test_spearman_constant_is_null(spark):
    df = spark.createDataFrame([("a", 1, 5), ("a", 2, 5), ("b", 1, 2), ("b", 2, 9)], "k string, x int, y int")
    got = {r["k"]: r["spearman"] for r in M.spearman(df, ["k"], "x", "y").collect()}
    assert got["a"] is None and abs(got["b"] - 1) < 1e-12


def test_permutation_keeps_strata_and_repeats(spark):
    data = [(g, v, int(RNG.integers(0, 2))) for g in range(9) for v in range(3 if g < 8 else 2)]
    df = spark.createDataFrame(data, "g int, v int, y int")
    run = lambda d: sorted(map(tuple, X.permute_labels(d, "g", "v", "y", 6, 11).collect()))
    first = run(df)
    assert first == run(df.repartition(7))
    by_label = {(g, v): y for g, v, y in data}
    vectors = sorted(tuple(by_label[(g, v)] for v in range(3)) for g in range(8))
    for rep in range(6):
        moved = {(g, v): y for r, g, v, y in first if r == rep}
        assert sorted(tuple(moved[(g, v)] for v in range(3)) for g in range(8)) == vectors
        assert all(moved[(8, v)] == by_label[(8, v)] for v in range(2))


def test_bootstrap_draws_and_bounds(rows):
    draws = X.group_draws(rows, "g", 30, 1).groupBy("rep").agg(F.sum("times").alias("n")).collect()
    assert {r["n"] for r in draws} == {len(np.unique(GROUP))}
    scored = rows.withColumn("score", F.col("vec")[0])
    for metric in ("balanced_accuracy", "roc_auc"):
        r = X.cluster_bootstrap(scored, [], "g", "label", "score", metric, 40).first()
        assert 0 <= r["ci_low"] <= r["ci_high"] <= 1


def test_draws_meet_cells_by_block(spark, monkeypatch):
    """Draws go packed through many blocks and units; a plan that joins them as rows is taken for small and broadcast."""
    import hashlib

    monkeypatch.setattr(X, "PLACES", 4)
    monkeypatch.setattr(X, "DRAWN", 5)
    data = [(g, k, int(y), float(s)) for g in range(11) for k in ("a", None) for y, s in RNG.normal(size=(4, 2)).round(1) > 0]
    df = spark.createDataFrame(data, "g int, k string, label int, score double").withColumn("score", F.col("score") - 0.5)
    pick = lambda rep, i: int(hashlib.sha256(f"3:{rep}:{i}".encode()).hexdigest()[:12], 16) % 11
    picks = [[pick(rep, i) for i in range(1, 12)] for rep in range(30)]
    got = {(r["rep"], r["g"]): r["times"] for r in X.group_draws(df, "g", 30, 3).collect()}
    assert got == {(rep, g): drawn.count(g) for rep, drawn in enumerate(picks) for g in set(drawn)}
    out = X.cluster_bootstrap(df, ["k"], "g", "label", "score", repetitions=30, seed=3)
    for r in out.collect():
        values = []
        for drawn in picks:
            rows = np.array([(y, s >= 0.5) for g in drawn for h, k, y, s in data if h == g and k == r["k"]])
            y, up = rows[:, 0] == 1, rows[:, 1] == 1
            if 0 < y.sum() < len(y):
                values.append((up[y].mean() + (~up[~y]).mean()) / 2)
        assert r["repetitions"] == len(values) and np.allclose([r["ci_low"], r["ci_high"]], np.percentile(values, [2.5, 97.5]))
    assert "Generate" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_comparison_shares_draws_and_equals_plain_bounds(spark, rows):
    import hashlib

    scored = rows.withColumn("score", F.col("vec")[0])
    long = scored.withColumn("monitor", F.lit("a")).unionByName(scored.withColumn("monitor", F.lit("b"))).unionByName(
        scored.withColumn("monitor", F.lit("none")).withColumn("score", F.lit(float("nan"))))
    got = {r["monitor"]: r.asDict() for r in X.comparison(long, ["monitor"], "label", "score", "g", 60, 5).collect()}
    assert set(got) == {"a", "b"}
    assert {k: v for k, v in got["a"].items() if k != "monitor"} == {k: v for k, v in got["b"].items() if k != "monitor"}
    local = scored.select("g", "label", "score").toPandas()
    groups, values = sorted(local["g"].unique()), []
    for rep in range(60):
        picks = [groups[int(hashlib.sha256(f"5:{rep}:{i}".encode()).hexdigest()[:12], 16) % len(groups)] for i in range(1, len(groups) + 1)]
        drawn = [local[local["g"] == g] for g in picks]
        y, up = np.concatenate([d["label"] for d in drawn]), np.concatenate([d["score"] >= 0 for d in drawn])
        if 0 < y.sum() < len(y):
            values.append((up[y == 1].mean() + (~up[y == 0]).mean()) / 2)
    assert got["a"]["repetitions"] == len(values)
    assert np.allclose([got["a"]["ci_low"], got["a"]["ci_high"]], np.percentile(values, [2.5, 97.5]))


def test_bundle_joins_group_sizes_once(spark, rows, monkeypatch):
    """Rows with the sizes of their groups are written; the cells and the areas read them and do not join again."""
    kept, real = [], M.cut_lineage
    monkeypatch.setattr(M, "cut_lineage", lambda df: kept.append(real(df)) or kept[-1])
    out = M.metric_bundle(rows.withColumn("score", F.col("vec")[0]).withColumn("one", F.lit(1)), ["one"], "label", "score", "g")
    sized = [df for df in kept if "__size" in df.columns]
    assert len(sized) == 1 and {(r["g"], r["__size"]) for r in sized[0].collect()} == {(int(g), int((GROUP == g).sum())) for g in np.unique(GROUP)}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 2  # the areas with the sums of earlier parts, and with the cells
    up = VEC[:, 0] >= 0
    size = 1 / np.array([(GROUP == g).sum() for g in GROUP])
    share = lambda y: (size * (LABEL == y) * (up == y)).sum() / (size * (LABEL == y)).sum()
    assert np.isclose(out.first()["weighted_balanced_accuracy"], (share(0) + share(1)) / 2)


def test_fold_vocabulary_equals_counting(spark):
    docs = [(i, i % 3, " ".join(RNG.choice(list("abcdefgh"), size=12))) for i in range(30)]
    df = spark.createDataFrame(docs, "d int, g int, t string")
    terms = Q.ngrams(df, "d", "g", "t").cache()
    got = {}
    for r in Q.fold_vocabulary(terms, "d", "g", 2, 10).collect():
        got.setdefault(r["fold"], set()).add(r["term"])
    for fold in range(3):
        count, docs_with = {}, {}
        for i, g, t in docs:
            if g == fold:
                continue
            w = t.split()
            grams = w + [f"{a} {b}" for a, b in zip(w, w[1:])]
            for x in grams:
                count[x] = count.get(x, 0) + 1
            for x in set(grams):
                docs_with[x] = docs_with.get(x, 0) + 1
        kept = sorted((x for x in count if docs_with[x] >= 2), key=lambda x: (-count[x], x))[:10]
        assert got[fold] == set(kept)


@pytest.mark.parametrize("sizes", [{}, {"max_queries": 2, "shard_rows": 7}])
def test_nearest_runs(rows, sizes):
    out = V.nearest_runs(rows, rows, "row_id", "vec", 3, **sizes).collect()
    assert len(out) == 3 * N
    u = unit(VEC)
    for q in range(N):
        sim = u @ u[q]
        sim[q] = -9
        got = [r["row_id"] for r in sorted((r for r in out if r["query_id"] == q), key=lambda r: r["rank"])]
        assert got == np.argsort(-sim)[:3].tolist()


def test_nearest_runs_odd_rows(spark):
    data = [("a", [1.0, 0.0]), ("b", [2.0, 0.0]), ("c", [4.0, 0.0]), ("z", [0.0, 0.0]), ("n", None), (None, [1.0, 0.0])]
    df = spark.createDataFrame(data, "id string, vec array<double>")
    found = [(r["query_id"], r["id"], r["rank"]) for r in V.nearest_runs(df, df, "id", "vec", 1, 1, 1).collect()]
    assert sorted(found) == [("a", "b", 1), ("b", "a", 1), ("c", "a", 1)]
    assert V.nearest_runs(df, df.limit(0), "id", "vec").collect() == [] and V.nearest_runs(df.limit(0), df, "id", "vec").collect() == []


def test_terms_outside_the_vocabulary_do_not_move(spark):
    docs = [(i, i % 3, " ".join(RNG.choice(list("abcdefgh"), size=12))) for i in range(30)] + [(1, 1, "a a b")]
    df = spark.createDataFrame(docs, "d int, g int, t string")
    terms = Q.ngrams(df, "d", "g", "t")
    assert terms._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1  # the texts
    assert terms.where("d = 1 and term = 'a a'").count() == 1
    vocabulary = Q.fold_vocabulary(terms, "d", "g", 2, 10)
    out = Q.held_out_tfidf(terms, vocabulary, "d", "g")
    squares = {r["d"]: r["s"] for r in out.groupBy("d").agg(F.sum(F.col("weight") * F.col("weight")).alias("s")).collect()}
    assert squares and all(abs(v - 1) < 1e-9 for v in squares.values())


def test_terms_of_one_group_do_not_widen_the_grid(spark, monkeypatch):
    """A frequent term of one group only let every term of the table into the grid of all folds."""
    docs = [(i, i % 3, "own own own own " + f"a{i % 7} b{i % 5} c{i}" if i % 3 == 0 else f"a{i % 7} b{i % 5} c{i} c{i}") for i in range(60)]
    df = spark.createDataFrame(docs * 2, "d int, g int, t string").withColumn("d", F.monotonically_increasing_id())
    written, keep = {}, Q.written
    monkeypatch.setattr(Q, "written", lambda rows, name: written.setdefault(name, keep(rows, name)))
    terms = Q.ngrams(df, "d", "g", "t").cache()
    got = Q.fold_vocabulary(terms, "d", "g", 2, 5).groupBy("fold").agg(F.sort_array(F.collect_set("term")).alias("terms")).collect()
    assert written["candidate-terms"].count() < 20 < written["own-terms"].select("term").distinct().count()
    for r in got:
        rows = [x for x in docs * 2 if x[1] != r["fold"]]
        count = {}
        for _, _, t in rows:
            w = t.split()
            for x in w + [f"{a} {b}" for a, b in zip(w, w[1:])]:
                count[x] = count.get(x, 0) + 1
        assert r["terms"] == sorted(sorted(count, key=lambda x: (-count[x], x))[:5])
