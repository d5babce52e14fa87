"""Scores, margins, entropies and other numeric columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def logprob_summary(values: Column) -> Column:
    """Count, total, mean and perplexity of a token log-prob list."""
    total = F.aggregate(values, F.lit(0.0), lambda a, x: a + x)
    n = F.size(values)
    return F.struct(
        n.alias("token_count"), total.alias("total_logprob"), F.try_divide(total, n).alias("average_logprob"),
        F.exp(-F.try_divide(total, n)).alias("perplexity"),
    )


def preference(q: Column, qstar: Column) -> Column:
    """delta > 0 prefers QSTAR; a tie goes to Q."""
    return F.when(qstar - q > 0, "QSTAR").otherwise("Q")


def branch_entropy(q: Column, qstar: Column) -> Column:
    """Entropy in bits over the two branches; 0 when one-sided or empty."""
    p = F.try_divide(qstar.cast("double"), q + qstar)
    mixed = (q > 0) & (qstar > 0)
    return F.when(mixed, -(p * F.log2(p) + (1 - p) * F.log2(1 - p))).otherwise(F.lit(0.0))


def recovered_gap(shift: Column, gap: Column) -> Column:
    return F.when(F.abs(gap) > 1e-9, shift / gap)


def difficulty(index: Column, default: str = "medium") -> Column:
    """Index mod 6: 0 and 1 easy, 2 to 4 the default, 5 hard."""
    m = index % 6
    return F.when(m.isin(0, 1), "easy").when(m.isin(2, 3, 4), default).otherwise("hard")


def rate_and_eta(done: Column, total: Column, seconds: Column) -> Column:
    """Rows per second and remaining seconds; null when nothing is done or no time has passed."""
    rate = F.when((done > 0) & (seconds > 0), done / seconds)
    return F.struct(rate.alias("rows_per_second"), F.try_divide(total - done, rate).alias("eta_seconds"))


# Coefficients of 1/z, 1/z^3, ... in the asymptotic series of the logarithm of the gamma function.
STIRLING = (1 / 12, -1 / 360, 1 / 1260, -1 / 1680, 1 / 1188, -691 / 360360)
SHIFT = 8  # the series is used from here on


def _stirling_rest(z: Column) -> Column:
    total = F.lit(0.0)
    for k in reversed(STIRLING):
        total = total / (z * z) + F.lit(k)
    return total / z


def log_gamma(z: Column) -> Column:
    """Logarithm of the gamma function for z > 0; null otherwise."""
    z = F.when(z > 0, z.cast("double"))
    w, lower = z + SHIFT, sum((F.ln(z + i) for i in range(1, SHIFT)), F.ln(z))
    return (w - 0.5) * F.ln(w) - w + F.lit(0.9189385332046727) + _stirling_rest(w) - lower  # ln(2 pi) / 2


def log_gamma_ratio(z: Column, h: Column) -> Column:
    """log_gamma(z + h) - log_gamma(z) for z, h > 0, without the cancellation that large z brings."""
    w = z + SHIFT
    lower = sum((F.log1p(h / (z + i)) for i in range(1, SHIFT)), F.log1p(h / z))
    return (w - 0.5) * F.log1p(h / w) + h * F.ln(w + h) - h + _stirling_rest(w + h) - _stirling_rest(w) - lower


def _bind(fn, **values: Column) -> Column:
    """fn of a struct of values that are computed once; written out, they would be repeated at each use."""
    return F.transform(F.array(F.struct(*[v.alias(n) for n, v in values.items()])), fn)[0]


def _beta_fraction(a: Column, b: Column, x: Column, terms: int) -> Column:
    """Continued fraction of the incomplete beta function, evaluated forwards."""
    tiny = 1e-300
    safe = lambda v: F.when(F.abs(v) < tiny, F.lit(tiny)).otherwise(v)

    def numerator(i: Column) -> Column:
        m = F.floor(i / 2).cast("double")
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        return F.when(i % 2 == 0, even).otherwise(odd)

    def step(state: Column, k: Column) -> Column:
        def scaled(v: Column) -> Column:
            c, d = safe(v["c"]), 1 / safe(v["d"])
            return F.struct(c.alias("c"), d.alias("d"), (v["h"] * c * d).alias("h"))

        return _bind(scaled, c=1 + k / state["c"], d=1 + k * state["d"], h=state["h"])

    numerators = F.transform(F.sequence(F.lit(1), F.lit(2 * terms)), numerator)
    start = F.struct(F.lit(1 / tiny).alias("c"), F.lit(1.0).alias("d"), F.lit(1.0).alias("h"))
    return F.aggregate(numerators, start, step, lambda s: s["h"])


def incomplete_beta(x: Column, a: Column, b: Column, y: Column | None = None, terms: int = 200) -> Column:
    """Regularised incomplete beta function for 0 <= x <= 1 and a, b > 0; null for other arguments.

    ``y`` is 1 - x, given where it is known better than by subtraction.  The
    fraction needs some sqrt(max(a, b)) terms, and under 60 where either
    parameter is 1/2, however large the other one.
    """

    def turned(v: Column) -> Column:
        """The fraction converges fast below (a + 1) / (a + b + 2); beyond it the roles change."""
        near = v["x"] < (v["a"] + 1) / (v["a"] + v["b"] + 2)
        pick = lambda here, there: F.when(near, v[here]).otherwise(v[there])
        return _bind(tail, near=near, a=pick("a", "b"), b=pick("b", "a"), x=pick("x", "y"), y=pick("y", "x"))

    def tail(v: Column) -> Column:
        ln = lambda u, rest: F.when(rest < 0.5, F.log1p(-rest)).otherwise(F.ln(u))
        gammas = _bind(lambda g: log_gamma_ratio(g["high"], g["low"]) - log_gamma(g["low"]),
                       high=F.greatest(v["a"], v["b"]), low=F.least(v["a"], v["b"]))
        front = F.exp(gammas + v["a"] * ln(v["x"], v["y"]) + v["b"] * ln(v["y"], v["x"])) / v["a"]
        return _bind(lambda t: F.when(t["near"], t["value"]).otherwise(1 - t["value"]),
                     near=v["near"], value=front * _beta_fraction(v["a"], v["b"], v["x"], terms))

    x, a, b = x.cast("double"), a.cast("double"), b.cast("double")
    y = 1 - x if y is None else y.cast("double")
    inside = (x > 0) & (y > 0) & (a > 0) & (b > 0)
    ends = F.when((a > 0) & (b > 0), F.when(x == 0, 0.0).when(y == 0, 1.0))
    return F.when(inside, _bind(turned, x=x, y=y, a=a, b=b)).otherwise(ends)


def correlation_p(r: Column, n: Column) -> Column:
    """Two-sided p-value of a correlation of n pairs by the t distribution with n - 2 degrees of freedom; null below 3 pairs."""
    size = F.when(F.abs(r) > 1, 1.0).otherwise(F.abs(r))
    return F.when(n > 2, incomplete_beta((1 - size) * (1 + size), (n - 2) / 2.0, F.lit(0.5), size * size))
