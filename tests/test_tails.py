import math
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from dyad.functions.tails import ln_gamma, neg_log10_binom_sf, neg_log10_chi2_sf


def exact_binomial(k, n, p):
    q = Fraction(p)
    tail = sum(math.comb(n, i) * q ** i * (1 - q) ** (n - i) for i in range(k, n + 1))
    return -(math.log10(tail.numerator) - math.log10(tail.denominator)) if tail else 300.0


def test_binomial_tail_against_exact_fractions(spark):
    cases = [(k, n, p) for n in (1, 5, 36, 120) for p in (1e-6, 0.03, 0.4, 0.97) for k in {0, 1, n // 3, n // 2, n - 1, n, n + 1}]
    d = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, k int, n int, p double")
    got = {r["i"]: r["s"] for r in d.select("i", neg_log10_binom_sf(F.col("k"), F.col("n"), F.col("p")).alias("s")).collect()}
    for i, (k, n, p) in enumerate(cases):
        want = 300.0 if k > n else min(exact_binomial(max(k, 0), n, p), 300.0)
        assert got[i] == pytest.approx(want, rel=1e-9, abs=1e-9), (k, n, p)


def test_binomial_tail_at_large_exposure(spark):
    """A pair with a million shared hands: normal approximation with continuity correction."""
    n, p = 1_000_000, 0.2
    sd = math.sqrt(n * p * (1 - p))
    ks = [int(n * p + z * sd) for z in (-3, 0, 1, 3)]
    d = spark.createDataFrame([(k,) for k in ks], "k bigint")
    got = {r["k"]: r["s"] for r in d.select("k", neg_log10_binom_sf(F.col("k"), F.lit(n), F.lit(p)).alias("s")).collect()}
    for k in ks:
        z = (k - 0.5 - n * p) / sd
        assert got[k] == pytest.approx(-math.log10(0.5 * math.erfc(z / math.sqrt(2))), rel=2e-3, abs=1e-3)


def chi2_sf(x, df):
    """Closed form: the survival function steps up two degrees of freedom at a time."""
    y = x / 2
    if df % 2 == 0:
        return math.exp(-y) * sum(y ** i / math.factorial(i) for i in range(df // 2))
    out = math.erfc(math.sqrt(y))
    for j in range(1, (df + 1) // 2):
        a = j - 0.5
        out += math.exp(a * math.log(y) - y - math.lgamma(a + 1))
    return out


def test_chi2_tail_any_degrees(spark):
    cases = [(x, df) for df in (1, 2, 5, 6, 15, 40, 75) for x in (0.01, 1.0, 4.0, 20.0, 90.0, 300.0)]
    d = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, x double, df int")
    got = {r["i"]: r["s"] for r in d.select("i", neg_log10_chi2_sf(F.col("x"), F.col("df")).alias("s")).collect()}
    for i, (x, df) in enumerate(cases):
        assert got[i] == pytest.approx(-math.log10(chi2_sf(x, df)), rel=1e-6, abs=1e-9), (x, df)


def test_ln_gamma(spark):
    xs = [1.0, 1.5, 2.0, 7.25, 100.0, 1e6, 1e12]
    d = spark.createDataFrame([(x,) for x in xs], "x double")
    for r in d.select("x", ln_gamma(F.col("x")).alias("g")).collect():
        assert r["g"] == pytest.approx(math.lgamma(r["x"]), rel=1e-12, abs=1e-11)
