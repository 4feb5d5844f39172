"""Upper tails of the binomial and chi-square laws as -log10, in log space, on the JVM."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

LN10 = math.log(10.0)
# Probabilities are clipped to [1e-300, 1] before the logarithm.
DEEPEST = 300.0


def ln_gamma(x: Column) -> Column:
    """ln Gamma(x) for x > 0: Stirling's series at x + 7, stepped back by the recurrence."""
    y = x + 7.0
    s = F.lit(1.0) / (y * y)
    tail = F.lit(691 / 360360)
    for c in (1 / 1188, 1 / 1680, 1 / 1260, 1 / 360, 1 / 12):
        tail = F.lit(c) - s * tail
    series = tail / y
    product = x * (x + 1) * (x + 2) * (x + 3) * (x + 4) * (x + 5) * (x + 6)
    return (y - 0.5) * F.log(y) - y + F.lit(0.5 * math.log(2 * math.pi)) + series - F.log(product)


def _ratio_sum(first: Column, steps: Column, ratio) -> Column:
    """1 + r(first) + r(first) r(first+1) + ... over `steps` terms."""
    return F.aggregate(
        F.sequence(F.lit(0).cast("bigint"), F.greatest(steps.cast("bigint"), F.lit(0).cast("bigint"))),
        F.struct(F.lit(0.0).alias("sum"), F.lit(1.0).alias("term")),
        lambda acc, j: F.struct((acc["sum"] + acc["term"]).alias("sum"),
                                (acc["term"] * ratio(first, j)).alias("term")),
        lambda acc: acc["sum"])


def neg_log10_binom_sf(k: Column, n: Column, p: Column) -> Column:
    """-log10 P(Bin(n, p) >= k).

    Terms are summed away from the mode, so every ratio is at most one, and a
    dozen standard deviations of terms reach double precision for any n.
    """
    k, n, p = k.cast("double"), n.cast("double"), p.cast("double")
    q = F.lit(1.0) - p
    reach = 40 + 12 * F.sqrt(n + 1)

    def ln_pmf(i: Column) -> Column:
        return (ln_gamma(n + 1) - ln_gamma(i + 1) - ln_gamma(n - i + 1)
                + i * F.log(p) + (n - i) * F.log(q))

    up = _ratio_sum(k, F.least(n - k, reach), lambda i, j: (n - i - j) / (i + j + 1) * p / q)
    down = _ratio_sum(k - 1, F.least(k - 1, reach), lambda i, j: (i - j) / (n - i + j + 1) * q / p)
    above = -(ln_pmf(k) + F.log(up)) / LN10
    below = -F.log1p(-F.least(F.exp(ln_pmf(k - 1)) * down, F.lit(1 - 1e-16))) / LN10
    tail = (F.when(k <= 0, F.lit(0.0)).when(k > n, F.lit(DEEPEST))
            .when(k > n * p, above).otherwise(below))
    return F.greatest(F.least(tail, F.lit(DEEPEST)), F.lit(0.0))


def neg_log10_chi2_sf(x: Column, df: Column | int, terms: int = 400) -> Column:
    """-log10 of the chi-square upper tail, any whole number of degrees of freedom.

    Series for the lower part below the mean, the continued fraction of the
    upper incomplete gamma function above it.
    """
    if isinstance(df, int) and df == 2:
        return F.greatest(x.cast("double"), F.lit(0.0)) / (2 * LN10)
    a = (df.cast("double") if isinstance(df, Column) else F.lit(float(df))) / 2.0
    y = F.greatest(x.cast("double"), F.lit(0.0)) / 2.0
    front = a * F.log(y) - y - ln_gamma(a)
    # Enough steps for either expansion to reach double precision at this a.
    steps = F.sequence(F.lit(1), F.least(F.lit(terms) + (12 * F.sqrt(a)).cast("int"), F.lit(100_000)))
    series = F.aggregate(
        steps, F.struct((F.lit(1.0) / a).alias("sum"), (F.lit(1.0) / a).alias("term")),
        lambda acc, i: F.struct((acc["sum"] + acc["term"] * y / (a + i)).alias("sum"),
                                (acc["term"] * y / (a + i)).alias("term")),
        lambda acc: acc["sum"])
    b0 = y + 1.0 - a
    fraction = F.aggregate(
        steps,
        F.struct((b0).alias("b"), F.lit(1e300).alias("c"), (F.lit(1.0) / b0).alias("d"),
                 (F.lit(1.0) / b0).alias("h")),
        lambda acc, i: _lentz(acc, i, a),
        lambda acc: acc["h"])
    lower = F.least(F.exp(front) * series, F.lit(1 - 1e-16))
    near = -F.log1p(-lower) / LN10
    far = -(front + F.log(fraction)) / LN10
    return F.when(y <= 0, F.lit(0.0)).when(y < a + 1, near).otherwise(far)


def _lentz(acc: Column, i: Column, a: Column) -> Column:
    an = -i * (i - a)
    b = acc["b"] + 2.0
    d = F.lit(1.0) / (an * acc["d"] + b)
    c = b + an / acc["c"]
    return F.struct(b.alias("b"), c.alias("c"), d.alias("d"), (acc["h"] * c * d).alias("h"))
