"""Nearest references by principal coordinates against all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from dyad.operators import neighbours
from dyad.operators.neighbours import nearest_by_axes


def low_rank(rng, n, size=64, rank=3):
    return rng.standard_normal((n, rank)) @ rng.standard_normal((rank, size)) + 0.01 * rng.standard_normal((n, size))


def frame(spark, v, fold):
    return spark.createDataFrame([(i, x.tolist(), int(f)) for i, (x, f) in enumerate(zip(v, fold))], "id long, vec array<double>, fold int").repartition(4)


def plain(q, qf, r, rf, k):
    out = {}
    for i, x in enumerate(q):
        d = np.sqrt(((r - x) ** 2).sum(axis=1))
        order = [j for j in sorted(range(len(r)), key=lambda j: (round(d[j], 12), j)) if rf[j] != qf[i]][:k]
        out[i] = [(j, d[j]) for j in order]
    return out


@pytest.mark.parametrize("kind", ["low rank", "noise", "copies"])
def test_same_rows_as_all_pairs(spark, kind):
    rng = np.random.default_rng(1)
    v = low_rank(rng, 500, 12) if kind == "low rank" else rng.standard_normal((300, 6))
    if kind == "copies":
        v[100:] = v[0]
    fold = rng.integers(0, 3, len(v))
    d = frame(spark, v, fold)
    got = {}
    for r in nearest_by_axes(d, d, 4, axis_count=3, cell_rows=20).orderBy("id", "rank").collect():
        got.setdefault(r["id"], []).append((r["ref"], r["dist"]))
    want = plain(v, fold, v, fold, 4)
    assert set(got) == set(want)
    for i in want:
        assert [d for _, d in got[i]] == pytest.approx([d for _, d in want[i]], abs=1e-9)
        if kind != "low rank":
            assert [j for j, _ in got[i]] == [j for j, _ in want[i]]


def test_few_pairs_on_vectors_of_low_rank(spark):
    """At most a tenth of all pairs have their distance computed."""
    rng = np.random.default_rng(2)
    n = 4000
    fold = rng.integers(0, 5, n)
    d = frame(spark, low_rank(rng, n), fold).withColumn("qkey", F.col("id"))
    own = neighbours.CELL_ROWS * n
    home, near = neighbours.candidates(d.select("qkey", "fold", "vec"), d.select("id", "fold", "vec"), 5)
    compared = own + near.count()
    assert home.count() == 5 * n and compared < n * n / 10


def test_more_references_make_more_cells(spark):
    rng = np.random.default_rng(3)
    for n, least in ((200, 1), (3000, 9)):
        d = frame(spark, low_rank(rng, n, 8), np.zeros(n)).select(F.col("id").alias("ref"), "fold", "vec")
        filed, _, _ = neighbours.file_references(neighbours.with_coordinates(d, *neighbours.axes(d, 3)), 256)
        sizes = [r["count"] for r in filed.groupBy("slice", "cell").count().collect()]
        assert len(sizes) >= least and sum(sizes) == n and max(sizes) < 3 * 256


def test_fewer_references_than_asked_for(spark):
    d = frame(spark, np.eye(3), [0, 1, 1])
    got = sorted((r["id"], r["ref"]) for r in nearest_by_axes(d, d, 5).collect())
    assert got == [(0, 1), (0, 2), (1, 0), (2, 0)]
    assert nearest_by_axes(d, d.where("id < 0"), 5).count() == 0


def test_pairs_that_are_not_near_make_no_rows(spark):
    """Comparing 600 vectors with one another yields the best of every group, not a row for every pair."""
    from dyad.operators import similarity
    rng = np.random.default_rng(4)
    d = frame(spark, rng.standard_normal((600, 8)), rng.integers(0, 3, 600))
    q = d.select(F.col("id").alias("qkey"), F.col("fold").alias("q_fold"), "vec", F.lit(0).alias("g"))
    r = d.select(F.col("id").alias("ref"), "fold", F.col("vec").alias("rvec"), F.pmod("id", F.lit(1)).cast("int").alias("g"))
    assert similarity.nearest_in_groups(q, r, ["g"], 4).count() == 4 * 600
    for found in (similarity.nearest_references(d, d, 4), nearest_by_axes(d, d, 4)):
        assert " SortMergeJoin [cell" not in (plan := found._jdf.queryExecution().executedPlan().toString()) and "FlatMapCoGroupsInPandas" in plan
