import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from runsift.llm import negatives

SCHEMA = "vec_id long, label int, embedding array<float>, anchor string, vec int"


def test_strassen_is_exact():
    rng = np.random.default_rng(0)
    for shape in [(1, 1, 1), (33, 65, 35), (70, 3, 90), (129, 64, 257), (100, 101, 99)]:
        a = rng.integers(-(1 << 20), 1 << 20, shape[:2])
        b = rng.integers(-(1 << 20), 1 << 20, shape[1:])
        assert np.array_equal(negatives.strassen(a, b, leaf=4), a @ b)
    big = np.full((40, 40), 1 << 28)
    assert np.array_equal(negatives.strassen(big, big, leaf=2), big @ big)


def brute(rows, every=5):
    use = [(i, label, [int(np.floor(256.0 * np.float32(x))) for x in vec]) for i, label, vec in rows
           if i is not None and label is not None and vec and all(x is not None and np.isfinite(x) for x in vec)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for i, label, vec in {repr(r): r for r in use if r[0] % every == 0}.values():
        scored = sorted((-dot(vec, v), j, other) for j, other, v in use if j != i)
        for s, j, _ in [r for r in scored if r[2] == label][:5]:
            inside = [r for r in scored if r[2] != label and -80 * s <= -100 * r[0] <= -100 * s][:5]
            out += [(i, j, k + 1, r[1], -s, -r[0]) for k, r in enumerate(inside)]
    return sorted(out)


def mined(spark, rows, **kw):
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    return sorted(map(tuple, negatives.mine(frame, F.col("vec_id") % 5 == 0, F.col("label"), **kw).collect()))


def test_mining_against_brute_force(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice([0, 0, 0, 1, 2]), [rng.choice([-0.5, 0.1, 0.25, 1.0]) + rng.random() / 99 for _ in range(rng.choice([6, 6, 6, 4]))]) for i in range(90)]
    rows += [(i + 200, label, vec) for i, label, vec in rows[:20]]  # ties
    want = brute(rows)
    assert len(want) > 100
    assert mined(spark, rows) == want
    assert mined(spark, rows, tile_rows=16) == want


def test_mining_cases(spark):
    base = [1.0, 2.0]
    rows = [(0, 1, base), (0, 1, base), (1, 1, base), (1, 1, [1.0, 1.9]), (2, 2, [1.0, 1.8]), (3, 2, None), (4, None, base), (None, 2, base),
            (5, 2, [None, 1.0]), (6, 2, [float("nan"), 1.0]), (7, 2, []), (8, 2, [float("inf"), 1.0]), (9, 2, [1.0, 1.8, 4.0]), (10, 3, [-1.0])]
    want = brute(rows)
    assert mined(spark, rows) == want and {r[3] for r in want} == {2, 9}
    assert mined(spark, rows[2:]) == []
    empty = spark.createDataFrame([], SCHEMA)
    assert negatives.mine(empty, F.lit(True), F.col("label")).count() == 0
    with pytest.raises(Exception, match="exceed a long"):
        mined(spark, [(0, 1, [1e15]), (1, 1, [1e15]), (2, 2, [1.0])])
