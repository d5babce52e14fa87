import math
from decimal import Decimal, getcontext

import pytest
from pyspark.sql import functions as F

from runsift.functions import numeric as N

getcontext().prec = 800


def even_p(r: float, df: int) -> float:
    """The tail for an even number of degrees of freedom as a finite sum, in 800 digits."""
    s = abs(Decimal(r))
    square, term, total = 1 - s * s, Decimal(1), Decimal(0)
    for k in range(df // 2):
        total += term
        term = term * square * (2 * k + 1) / (2 * k + 2)
    return float(1 - s * total)


def odd_p(r: float, df: int) -> float:
    cos, term, total = math.sqrt(1 - r * r), 1.0, 0.0
    for k in range((df - 1) // 2):
        total += term * cos ** (2 * k + 1)
        term *= (2 * k + 2) / (2 * k + 3)
    return 1 - 2 / math.pi * (math.asin(abs(r)) + abs(r) * total)


def test_p_values_equal_the_finite_sums(spark):
    rs = [-0.999, -0.9, -0.31, -0.02, 1e-9, 0.001, 0.1, 0.5, 0.77, 0.95, 0.999999]
    cases = [(r, df + 2) for r in rs for df in (1, 2, 3, 4, 7, 10, 30, 51, 100, 200)] + [(0.004, 100_002), (0.1, 2002), (1e-3, 2002)]
    rows = spark.createDataFrame(cases, "r double, n bigint").withColumn("p", N.correlation_p(F.col("r"), F.col("n"))).collect()
    assert len(rows) == len(cases)
    for row in rows:
        if row.n % 2 == 0:
            assert row.p == pytest.approx(even_p(row.r, row.n - 2), rel=1e-9, abs=1e-300)
        else:
            assert row.p == pytest.approx(odd_p(row.r, row.n - 2), abs=1e-12)


def test_p_values_at_the_ends(spark):
    cases = [(0.0, 9), (1.0, 9), (-1.0, 9), (1.0 + 1e-16, 3), (0.5, 2), (None, 9), (0.5, None), (1.96e-4, 100_000_002)]
    rows = spark.createDataFrame(cases, "r double, n bigint").withColumn("p", N.correlation_p(F.col("r"), F.col("n"))).collect()
    got = [r.p for r in rows]
    assert got[:7] == [1.0, 0.0, 0.0, 0.0, None, None, None]
    assert got[7] == pytest.approx(math.erfc(1.96 / math.sqrt(2)), rel=1e-6)  # the normal limit


def test_incomplete_beta_of_whole_numbers_is_a_binomial_tail(spark):
    cases = [(x, a, b) for x in (0.0, 0.01, 0.3, 0.5, 0.9, 1.0) for a in (1, 2, 9, 40) for b in (1, 3, 25)]
    rows = spark.createDataFrame(cases, "x double, a int, b int").withColumn("v", N.incomplete_beta(F.col("x"), F.col("a"), F.col("b"))).collect()
    for x, a, b, v in rows:
        n = a + b - 1
        want = math.fsum(math.comb(n, j) * x**j * (1 - x) ** (n - j) for j in range(a, n + 1))
        assert v == pytest.approx(want, rel=1e-10, abs=1e-300)
    odd = spark.createDataFrame([(-0.1, 1.0), (1.1, 1.0), (0.5, 0.0), (None, 1.0)], "x double, a double")
    assert [r[0] for r in odd.select(N.incomplete_beta(F.col("x"), F.col("a"), F.lit(2.0))).collect()] == [None] * 4


def test_log_gamma(spark):
    zs = [1e-6, 0.5, 1.0, 1.5, 2.0, 7.99, 33.3, 1e5, 1e9]
    rows = spark.createDataFrame([(z,) for z in zs], "z double").select("z", N.log_gamma(F.col("z")), N.log_gamma_ratio(F.col("z"), F.lit(0.5))).collect()
    for z, value, ratio in rows:
        assert value == pytest.approx(math.lgamma(z), rel=1e-13, abs=1e-13)
        if z < 1e4:
            assert ratio == pytest.approx(math.lgamma(z + 0.5) - math.lgamma(z), rel=1e-11, abs=1e-12)
        else:
            assert ratio == pytest.approx(0.5 * math.log(z), rel=1e-5)
