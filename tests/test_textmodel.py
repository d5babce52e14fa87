"""The text monitor against a dense Newton fit of the same features."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from runsift.operators import textmodel as X

TOKEN = re.compile(r"(?u)\b[\w/+=-]+\b")


def features_of(texts, min_df, most):
    """(vocabulary, rows) of the tf-idf of training texts, as the usual vectoriser defines it."""
    grams = []
    for t in texts:
        w = TOKEN.findall(t.lower())
        grams.append(Counter(w + [" ".join(p) for p in zip(w, w[1:])]))
    df, tf = Counter(k for g in grams for k in g), Counter()
    for g in grams:
        tf.update(g)
    kept = sorted((k for k in df if df[k] >= min_df), key=lambda k: (-tf[k], k))[:most]
    return {k: (i, math.log((1 + len(texts)) / (1 + df[k])) + 1) for i, k in enumerate(sorted(kept))}


def vector(text, vocabulary):
    w = TOKEN.findall(text.lower())
    out = np.zeros(len(vocabulary))
    for k, n in Counter(w + [" ".join(p) for p in zip(w, w[1:])]).items():
        if k in vocabulary:
            i, idf = vocabulary[k]
            out[i] = (1 + math.log(n)) * idf
    return out / (np.linalg.norm(out) or 1.0)


def newton(x, y, w):
    z, beta = np.c_[x, np.ones(len(x))], np.zeros(x.shape[1] + 1)
    penalty = np.r_[np.ones(x.shape[1]), 0]
    for _ in range(40):
        p = 1 / (1 + np.exp(-z @ beta))
        step = np.linalg.solve((z * (w * p * (1 - p))[:, None]).T @ z + np.diag(penalty + 1e-12), z.T @ (w * (p - y)) + penalty * beta)
        beta -= step
    return beta


def test_text_scores_against_a_dense_fit(spark, monkeypatch):
    monkeypatch.setattr(X, "BLOCK_ROWS", 16)
    rng = random.Random(6)
    words = ["alpha", "Beta", "x=1", "a/b", "über", "gamma-ray", "delta", "epsilon", "+", "zeta"]
    rows = []
    for i in range(90):
        label = rng.random() < 0.5
        pool = words[:6] if label else words[4:]
        rows.append((i, rng.choice(["a", "b", "c", None]), int(label), " ".join(rng.choice(pool if rng.random() < 0.7 else words) for _ in range(rng.randrange(0, 25)))))
    rows += [(90, "d", 1, ""), (91, "e", 0, "unseen words only")]
    df = spark.createDataFrame(rows, "id int, grp string, y int, t string").repartition(3)
    got = {r.id: r for r in X.text_scores(df, "id", "grp", "y", "t", max_features=60).collect()}
    assert len(got) == len(rows) and all(r.converged for r in got.values())
    sizes = Counter(r[1] for r in rows)
    for held in sizes:
        train = [r for r in rows if r[1] != held]
        vocabulary = features_of([r[3] for r in train], 2, 60)
        y = np.array([r[2] for r in train])
        w = np.array([1 / sizes[r[1]] for r in train]) * np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
        beta = newton(np.array([vector(r[3], vocabulary) for r in train]), y, w)
        for r in rows:
            if r[1] == held:
                want = vector(r[3], vocabulary) @ beta[:-1] + beta[-1]
                assert abs(got[r[0]].score - want) < 1e-4, (r, got[r[0]].score, want, len(vocabulary))


def test_one_class_and_unfinished_fits(spark):
    rows = [(1, "a", 1, "x y"), (2, "a", 0, "y z"), (5, "a", 0, "z z y"), (3, "b", 1, "x x"), (4, "b", 1, "x y")]
    df = spark.createDataFrame(rows, "id int, grp string, y int, t string")
    got = {r.id: r for r in X.text_scores(df, "id", "grp", "y", "t").collect()}
    assert got[1].score is None and got[2].score is None and got[3].score is not None  # without a only ones are left
    few = {r.id: r.converged for r in X.text_scores(df, "id", "grp", "y", "t", passes=2).collect()}
    assert few[3] is False
    assert X.text_scores(df.where("id < 0"), "id", "grp", "y", "t").count() == 0


def many_groups(spark, groups):
    rng = random.Random(8)
    rows = [(i, f"g{i % groups}", rng.randrange(2), " ".join(f"w{int(rng.paretovariate(0.7)) % 50}" for _ in range(30))) for i in range(120)]
    return spark.createDataFrame(rows, "id int, grp string, y int, t string")


def test_rows_are_written_once_and_not_once_a_fold(spark, monkeypatch):
    keep, entries = X._written, []

    def written(df, name):
        out, lists = keep(df, name), [k for k, kind in df.dtypes if kind.startswith("array")]
        if lists and name != "text-state":  # the state holds one row a fold
            entries[-1] += out.agg(sum(F.coalesce(F.sum(F.size(k)), F.lit(0)) for k in lists)).first()[0]
        return out

    monkeypatch.setattr(X, "_written", written)
    for groups in (3, 24):
        entries.append(0)
        assert X.text_scores(many_groups(spark, groups), "id", "grp", "y", "t", max_features=40, passes=2).count() == 120
    assert 0 < entries[1] < 1.5 * entries[0]


@pytest.mark.parametrize("hot, rounds", [(False, 1), (True, 2)])
def test_vocabularies_from_terms_of_large_counters(spark, monkeypatch, hot, rounds):
    """Only terms of large counters are counted, and again from a lower count where a vocabulary reaches below it."""
    monkeypatch.setattr(X, "SLOTS", 4096)
    rng = random.Random(9)
    draw = lambda: " ".join(f"w{min(int(rng.paretovariate(0.6)), 4000)}" for _ in range(40))
    rows = [(i, f"g{i % 6}", draw()) for i in range(150)]
    if hot:  # few texts with most of the words, all of them in one group
        rows += [(1000 + i, "g0", " ".join(f"own{(i * j) % 37}" for j in range(1500))) for i in range(3)]
    keep, written = X._written, []
    monkeypatch.setattr(X, "_written", lambda df, name: written.append((name, keep(df, name))) or written[-1][1])
    base = spark.createDataFrame([(i, g, t.split()) for i, g, t in rows], "id int, key string, words array<string>")
    docs = base.groupBy("key").agg(F.count("*").alias("__n"))
    terms, vocabulary = X.frequent_terms(base, "id", 2, 25, 100, docs)
    got = {}
    for r in vocabulary.collect():
        got.setdefault(r["fold"], {})[r["term"]] = r["idf"]
    for fold in {r[1] for r in rows}:
        want = features_of([t for _, g, t in rows if g != fold], 2, 25)
        assert got[fold].keys() == want.keys() and all(abs(got[fold][k] - idf) < 1e-9 for k, (_, idf) in want.items())
    assert [name for name, _ in written].count("text-terms") == rounds
    every = {k for *_, t in rows for w in [TOKEN.findall(t)] for k in w + [" ".join(p) for p in zip(w, w[1:])]}
    assert terms.select("term").distinct().count() < len(every) / 2


def test_repeated_and_null_ids(spark):
    """Texts of an id are counted together inside of a group; rows without an id have no features."""
    rng = random.Random(10)
    word = lambda: rng.choice(["a", "b", "c", "d", "e", "f"])
    rows = [(i, rng.choice(["p", "q", "r"]), i % 2, " ".join(word() for _ in range(8))) for i in range(40)]
    rows += [(1, "p", 1, "a b a"), (1, "p", 1, "f f"), (1, "q", 0, "c d"), (None, "p", 0, "e e e"), (None, "r", 1, "b")]
    got = X.text_scores(spark.createDataFrame(rows, "id int, grp string, y int, t string"), "id", "grp", "y", "t").collect()
    assert len(got) == len(rows)
    counts = {}
    for i, g, _, t in rows:
        w = t.split()
        counts.setdefault((i, g), Counter()).update(w + [" ".join(p) for p in zip(w, w[1:])])
    sizes = Counter(r[1] for r in rows)
    for held in sizes:
        train, df = [r for r in rows if r[1] != held], Counter(k for (_, g), c in counts.items() if g != held for k in c)
        places = {k: i for i, k in enumerate(sorted(k for k in df if df[k] >= 2))}

        def vector_of(id):
            w = [(places[k], (1 + math.log(n)) * (math.log((1 + len(train)) / (1 + df[k])) + 1))
                 for (i, _), c in counts.items() if i == id and id is not None for k, n in c.items() if k in places]
            out = np.zeros(len(places))
            np.add.at(out, [p for p, _ in w], [v for _, v in w])
            return out / (math.sqrt(sum(v * v for _, v in w)) or 1.0)

        y = np.array([r[2] for r in train])
        w = np.array([1 / sizes[r[1]] for r in train]) * np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
        beta = newton(np.array([vector_of(r[0]) for r in train]), y, w)
        want = sorted((str(r[0]), r[2], vector_of(r[0]) @ beta[:-1] + beta[-1]) for r in rows if r[1] == held)
        found = sorted((str(r.id), r.label, r.score) for r in got if r.grp == held)
        assert [x[:2] for x in found] == [x[:2] for x in want] and all(abs(a[2] - b[2]) < 1e-4 for a, b in zip(found, want))
