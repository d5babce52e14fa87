"""Held-out fits at real widths and group counts, against NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from runsift.operators import foldpca
from runsift.operators import models as Q
from tests.test_models import newton


def plain_pca_score(x, y, g, held, components):
    """Scores of the held-out rows from whitened components and a Newton fit of the other rows."""
    tr, te = np.where(g != held)[0], np.where(g == held)[0]
    mean = x[tr].mean(axis=0)
    _, s, vt = np.linalg.svd(x[tr] - mean, full_matrices=False)
    k = min(components, len(tr) - 2, x.shape[1])
    scale = vt[:k].T / (s[:k] / np.sqrt(len(tr) - 1))
    n, size = len(tr), np.bincount(g, minlength=g.max() + 1)
    w = (1 / size[g[tr]]) * np.where(y[tr] == 1, n / (2 * y[tr].sum()), n / (2 * (n - y[tr].sum())))
    beta = newton((x[tr] - mean) @ scale, y[tr], w)
    return dict(zip(te.tolist(), np.c_[(x[te] - mean) @ scale, np.ones(len(te))] @ beta))


def frame(spark, x, y, g):
    rows = [(i, int(g[i]), int(y[i]), x[i].tolist()) for i in range(len(x))]
    return spark.createDataFrame(rows, "row_id int, g int, label int, vec array<double>").repartition(4)


@pytest.mark.parametrize("rows, dim, groups, looked_at", [(320, 1536, 29, range(0, 29, 4)), (6000, 8, 5000, range(0, 5000, 700))])
def test_wide_vectors_and_many_groups(spark, rows, dim, groups, looked_at):
    rng = np.random.default_rng(dim)
    x = rng.normal(size=(rows, dim)) * np.linspace(2, 1, dim)
    y = (x[:, 0] + rng.normal(size=rows) > 0).astype(int)
    g = np.arange(rows) % groups
    if groups < 100:
        g[::3] = 0  # one group holds a third of all rows
    out = Q.group_held_out_scores(frame(spark, x, y, g), "row_id", "g", "label", F.col("vec"), dim, transform="pca").collect()
    assert len(out) == rows and all(r["converged"] for r in out)
    got = {r["row_id"]: r["score"] for r in out}
    for held in looked_at:
        for i, s in plain_pca_score(x, y, g, held, 8).items():
            assert abs(got[i] - s) < 1e-5


@pytest.mark.parametrize("transform", [None, "scale", "pca"])
def test_blocks_of_folds_do_not_change_the_scores(spark, transform):
    rng = np.random.default_rng(3)
    x, y, g = rng.normal(size=(60, 5)), rng.integers(0, 2, 60), np.arange(60) % 6
    df = frame(spark, x, y, g)
    run = lambda **kw: {r["row_id"]: r["score"] for r in Q.group_held_out_scores(df, "row_id", "g", "label", F.col("vec"), 5, transform=transform, components=2, **kw).collect()}
    whole, single = run(), run(block_state=1)
    assert whole.keys() == single.keys() and all(abs(whole[i] - single[i]) < 1e-7 for i in whole)


@pytest.mark.parametrize("transform", [None, "scale", "pca"])
def test_odd_rows(spark, transform):
    rng = np.random.default_rng(4)
    rows = [(i, None if i % 4 == 0 else f"g{i % 4}", int(rng.integers(0, 2)), rng.normal(size=3).tolist()) for i in range(40)]
    bad = [(100, "g1", 1, None), (101, "g1", 0, [1.0, None, 2.0]), (102, "g1", 1, [1.0, float("nan"), 0.0]), (103, "g2", 1, [1.0])]
    unlabelled = [(104, "g3", None, [0.1, 0.2, 0.3]), (105, None, None, [0.1, 0.2, 0.3])]
    df = lambda r: spark.createDataFrame(r, "row_id int, g string, label int, vec array<double>")
    run = lambda r: {x["row_id"]: x["score"] for x in Q.group_held_out_scores(df(r), "row_id", "g", "label", F.col("vec"), 3, transform=transform, components=2).collect()}
    got, clean = run(rows + bad + unlabelled), run(rows)
    assert all(got[i] is None for i, *_ in bad) and got[104] is not None and got[105] is not None
    assert all(abs(got[i] - clean[i]) < 1e-9 for i in clean)
    assert run([]) == {}
    assert set(run([(i, "a", i % 2, [1.0 * i, 2.0, 3.0]) for i in range(4)]).values()) == {None}


def test_unfinished_and_refused(spark):
    rng = np.random.default_rng(6)
    df = frame(spark, rng.normal(size=(30, 3)), rng.integers(0, 2, 30), np.arange(30) % 3)
    one = Q.group_held_out_scores(df, "row_id", "g", "label", F.col("vec"), 3, iterations=1).collect()
    assert not any(r["converged"] for r in one)
    with pytest.raises(ValueError, match="features"):
        foldpca.scatter(df, foldpca.MOST_FEATURES + 1)
