"""Segmented statistics against plain ones, on data where one key holds most rows."""

import random
import statistics

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from dyad.functions import ordered as od


@pytest.fixture(scope="module")
def skewed(spark):
    rnd = random.Random(3)
    rows = []
    for i in range(900):
        key = "hot" if i % 3 else f"k{i % 11}"
        value = rnd.choice([None, 0.0, 0.0, 1.5, -2.25, rnd.uniform(-100, 100), rnd.uniform(0, 1e-6)])
        rows.append((key, i, rnd.randrange(5), value, rnd.choice([None, i])))
    return spark.createDataFrame(rows, "k string, id bigint, g int, x double, m bigint").cache()


def same(a, b, columns):
    key = lambda r: tuple((v is None, str(v)) for v in r)
    left = sorted((tuple(r) for r in a.select(*columns).collect()), key=key)
    right = sorted((tuple(r) for r in b.select(*columns).collect()), key=key)
    assert left == right


def test_row_numbers(skewed):
    got = od.row_numbers(skewed, ["k"], [F.col("id")], F.floor(F.col("id") / 50), "rn")
    want = skewed.withColumn("rn", F.row_number().over(Window.partitionBy("k").orderBy("id")).cast("bigint"))
    same(got, want, ["k", "id", "rn"])


def test_running_carries_over_segments(skewed):
    cols = {"s": ("sum", F.col("id")), "mx": ("max", F.col("x")), "mn": ("min", F.col("x")), "la": ("last", F.col("m"))}
    got = od.running(skewed, ["k", "g"], ["id"], cols, segment=F.floor(F.col("id") / 70))
    w = Window.partitionBy("k", "g").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    want = skewed.withColumns({"s": F.coalesce(F.sum("id").over(w), F.lit(0)), "mx": F.max("x").over(w),
                               "mn": F.min("x").over(w), "la": F.last("m", True).over(w)})
    same(got, want, ["id", "s", "mx", "mn", "la"])


def test_running_by_position(skewed, monkeypatch):
    d = skewed.withColumn("pos", F.row_number().over(Window.partitionBy("k").orderBy("id")) - 1)
    monkeypatch.setattr(od, "BLOCK_ROWS", 7)
    got = od.running(d, ["k"], ["pos"], {"s": ("sum", F.col("g").cast("bigint"))}, position="pos")
    w = Window.partitionBy("k").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    same(got, d.withColumn("s", F.coalesce(F.sum("g").over(w), F.lit(0))), ["id", "s"])


@pytest.mark.parametrize("rows", [5, 64, 10_000])
def test_neighbourhood(skewed, rows):
    d = skewed.withColumn("rn", F.row_number().over(Window.partitionBy("k").orderBy("id")))
    got = od.neighbourhood(d, ["k"], "rn", 3, lambda f: {
        "c": F.count("*").over(f(-3, 3)), "prev": F.max("id").over(f(-1, -1)), "nxt": F.max("id").over(f(2, 2))}, rows)
    w = Window.partitionBy("k").orderBy("rn")
    want = d.withColumns({"c": F.count("*").over(w.rowsBetween(-3, 3)), "prev": F.lag("id").over(w),
                          "nxt": F.lead("id", 2).over(w)})
    same(got, want, ["id", "c", "prev", "nxt"])


def test_percentiles_use_average_ranks_and_skip_nulls(skewed):
    got = {r["id"]: r["pct_x"] for r in od.percentiles(skewed, ["k"], ["k", "id"], ["x"]).collect()}
    rows = skewed.collect()
    for r in rows:
        peers = [q["x"] for q in rows if q["k"] == r["k"]]
        if r["x"] is None:
            assert got[r["id"]] is None
            continue
        less = sum(1 for v in peers if v is not None and v < r["x"])
        ties = sum(1 for v in peers if v == r["x"])
        assert got[r["id"]] == pytest.approx((less + (ties + 1) / 2) / len(peers))


def test_order_values(skewed):
    out = od.order_values(skewed, ["k"], "x", {"med": od.median_positions(), "q": od.nearest_positions(0.95)})
    rows = skewed.collect()
    for r in out.collect():
        xs = sorted(q["x"] for q in rows if q["k"] == r["k"] and q["x"] is not None)
        assert r["med"] == pytest.approx(statistics.median(xs))
        assert r["q"] == xs[int(0.95 * (len(xs) - 1) + 0.5)]


def test_ordinal_ranks_break_ties_by_id(skewed):
    got = od.ordinal_ranks(skewed, ["k"], "x", "id", "r")
    w = Window.partitionBy("k").orderBy(F.col("x").desc(), "id")
    want = skewed.where("x is not null").withColumn("r", F.row_number().over(w).cast("bigint"))
    same(got, want, ["id", "r"])


def test_top_means(skewed):
    out = od.top_means(skewed, ["k"], {"t3": ("x", 3), "t1": ("id", 1)})
    rows = skewed.collect()
    for r in out.collect():
        xs = sorted((q["x"] for q in rows if q["k"] == r["k"] and q["x"] is not None), reverse=True)[:3]
        assert r["t3"] == pytest.approx(sum(xs) / len(xs))
        assert r["t1"] == max(q["id"] for q in rows if q["k"] == r["k"])


def test_magnitude_segment_keeps_order(spark):
    rnd = random.Random(1)
    xs = sorted([0.0, -0.0, 1e-300, -1e-300, 1e300, 5e-324] + [rnd.uniform(-1, 1) * 10 ** rnd.randint(-9, 9) for _ in range(500)])
    d = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x double")
    segs = [r["s"] for r in d.select("i", od.magnitude_segment("x").alias("s")).orderBy("i").collect()]
    assert segs == sorted(segs)


def test_assert_unique(spark):
    ok = spark.createDataFrame([(1, 2), (1, 3)], "a int, b int")
    assert od.assert_unique(ok, ["a", "b"]).count() == 2
    with pytest.raises(Exception, match="duplicate key"):
        od.assert_unique(ok.union(ok), ["a", "b"]).collect()


def test_minus_own(spark):
    d = spark.createDataFrame([("a", 1), ("a", 4), ("b", 5)], "k string, v int")
    assert sorted(r["rest_v"] for r in od.minus_own(d, ["k"], ["v"]).collect()) == [0, 1, 4]
