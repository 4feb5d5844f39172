"""Metrics, similarity, blends and model protocols."""

import math
import random

import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.sql import functions as F

from dyad.operators import aggregate as ag
from dyad.operators import bags as bg
from dyad.operators import metrics as mt
from dyad.operators import models as md
from dyad.operators import pairs as pr
from dyad.operators import retrieval as rt
from dyad.operators import similarity as sm
from dyad.sources import tables as tb


def brute_ap(rows):
    hits, total, n = 0, 0.0, 0
    for i, (_, _, y) in enumerate(sorted(rows, key=lambda r: (-r[1], r[0])), 1):
        if y:
            hits += 1
            total += hits / i
    n = sum(y for *_, y in rows)
    return total / n if n else 0.0


@pytest.mark.parametrize("levels", [1, 3, 1000])
def test_average_precision_with_heavy_ties(spark, levels):
    rnd = random.Random(levels)
    rows = [(i, float(rnd.randrange(levels)), int(rnd.random() < 0.2)) for i in range(300)]
    d = spark.createDataFrame(rows, "id bigint, s double, y int")
    assert mt.average_precision(d, "s", "y", "id").first()["ap"] == pytest.approx(brute_ap(rows))


def test_perfect_and_empty_ranking(spark):
    d = spark.createDataFrame([(i, float(-i), int(i < 4)) for i in range(20)], "id bigint, s double, y int")
    assert mt.average_precision(d, "s", "y", "id").first()["ap"] == 1.0
    assert mt.average_precision(d.withColumn("y", F.lit(0)), "s", "y", "id").first()["ap"] == 0.0


def test_map_counts_every_target_and_ignores_repeats(spark):
    picks = spark.createDataFrame([(1, 2, "a", 1), (1, 2, "a", 2), (1, 2, "b", 3), (3, 4, "x", 1)],
                                  "p1 bigint, p2 bigint, hand_id string, slot int")
    gold = spark.createDataFrame([(1, 2, "a"), (1, 2, "b"), (3, 4, "x")], "p1 bigint, p2 bigint, hand_id string")
    targets = spark.createDataFrame([(1, 2), (3, 4), (5, 6)], "p1 bigint, p2 bigint")
    valid = gold.where("hand_id <> 'x'")
    got = {r["p1"]: r["ap"] for r in mt.map_at_k(picks, gold, targets, valid).collect()}
    assert got == {1: pytest.approx((1 + 2 / 3) / 2), 3: 0.0, 5: 0.0}


def test_absent_family_scores_zero(spark):
    d = spark.createDataFrame([(1, "soft_play", "soft_play", 0.9), (2, None, "soft_play", 0.1)],
                              "pid bigint, family string, predicted string, risk double")
    got = {r["target_family"]: r["ap"] for r in mt.behaviour_ap(d, "pid").collect()}
    assert got == {"soft_play": 1.0, "directed_transfer": 0.0, "coordinated_isolation": 0.0}


def test_bootstrap_of_equal_scores_has_no_difference(spark):
    rnd = random.Random(1)
    rows = [(i, f"t{i % 20}", rnd.random(), int(rnd.random() < 0.1)) for i in range(600)]
    d = spark.createDataFrame(rows, "id bigint, t string, a double, y int").withColumn("b", F.col("a"))
    d = d.withColumn("c", F.col("a") + F.col("y"))
    same = mt.bootstrap_summary(mt.bootstrap_replicates(d, ("a", "b"), "y", "id", "t", 10, "s")).first()
    assert same["mean_delta"] == 0.0 and same["p_improves"] == 0.0
    better = mt.bootstrap_summary(mt.bootstrap_replicates(d, ("a", "c"), "y", "id", "t", 10, "s")).first()
    assert better["low"] > 0 and better["p_improves"] == 1.0


@pytest.mark.parametrize("shard_rows", [7, 20_000])
def test_nearest_references_with_a_crowded_cell(spark, shard_rows):
    """A third of the references are copies of one point."""
    rnd = random.Random(5)
    pts = [(i, [0.5, 0.5, 0.5] if i % 3 == 0 else [rnd.gauss(0, 1) for _ in range(3)], i % 4) for i in range(240)]
    d = spark.createDataFrame(pts, "id bigint, vec array<float>, fold bigint")
    exact = {r["id"]: [float(x) for x in r["vec"]] for r in d.collect()}
    fold = {i: f for i, _, f in pts}
    got: dict[int, list[float]] = {}
    for r in sm.nearest_references(d, d, 4, pivots=6, shard_rows=shard_rows).collect():
        got.setdefault(r["id"], []).append(r["dist"])
    for i, v in exact.items():
        want = sorted(math.dist(v, exact[j]) for j in exact if fold[j] != fold[i])[:4]
        assert sorted(got[i]) == pytest.approx(want, abs=1e-9)


def test_placebo_lends_another_pairs_block(spark):
    rows = [("d", 0, p, p + 1, f"h{h}", h * 3600, float(100 * p + h)) for p in (1, 5, 9) for h in range(p)]
    d = spark.createDataFrame(rows, "phase string, table_id bigint, p1 bigint, p2 bigint, hand_id string, started_at bigint, score double")
    got = bg.placebo(d, ["score"], "s").collect()
    assert len(got) == len(rows)
    for p in (1, 5, 9):
        owners = {int(r["score"] // 100) for r in got if r["p1"] == p}
        assert len(owners) == 1 and p not in owners


def test_cohorts_and_sampling_avoid_positive_actors(spark):
    pairs = spark.createDataFrame([(a, b) for a in range(8) for b in range(a + 1, 8)], "p1 bigint, p2 bigint")
    labels = spark.createDataFrame([(0, 1, 1, "soft_play"), (2, 3, 0, None)], "p1 bigint, p2 bigint, label int, family string")
    cohorts = {(r["p1"], r["p2"]): r["cohort"] for r in ag.label_cohorts(pairs, labels).collect()}
    assert cohorts[0, 1] == "labelled" and cohorts[0, 5] == "mixed" and cohorts[4, 5] == "eval_like"
    drawn = ag.sample_unknown(pairs, labels, pairs.where("p1 = 4 and p2 = 5"), 100, "s").collect()
    assert len(drawn) == 13 and all(not {r["p1"], r["p2"]} & {0, 1} for r in drawn)


def test_splice_and_guard(spark):
    a = spark.createDataFrame([("x", 1, "p"), ("y", 2, "q")], "k string, v int, w string")
    out = rt.splice(a, a.withColumn("v", F.col("v") * 10), ["k"], ["v"])
    assert sorted((r["k"], r["v"], r["w"]) for r in out.collect()) == [("x", 10, "p"), ("y", 20, "q")]
    assert rt.changed_elsewhere(a, out, ["v"]).count() == 0
    with pytest.raises(Exception, match="key missing"):
        rt.splice(a, a.where("k = 'x'"), ["k"], ["v"]).collect()


def test_fold_directions_is_symmetric(spark):
    d = spark.createDataFrame([(1, 2, 5.0), (2, 1, 7.0)], "actor bigint, partner bigint, s double")
    one = pr.fold_directions(d, [], ["s"], sums=["s"]).first()
    swapped = d.select(F.col("partner").alias("actor"), F.col("actor").alias("partner"), "s")
    other = pr.fold_directions(swapped, [], ["s"], sums=["s"]).first()
    assert one == other and (one["s_hi"], one["s_lo"], one["s_sum"]) == (7.0, 5.0, 12.0)


def test_crossfit_scores_every_row_once_and_out_of_fold(spark):
    """The label is the fold itself, so only a leaking model could know it."""
    rows = [(i, i % 3, float(i % 3), float(i % 3 == 0)) for i in range(90)] + [(100 + i, None, 1.0, None) for i in range(5)]
    d = spark.createDataFrame(rows, "id bigint, fold int, x double, y double")
    make = lambda: LogisticRegression(labelCol="y", featuresCol="features")
    out = md.crossfit(d, make, ["x"], "y", ["id"], 2, 3)
    got = {r["id"]: r for r in out.collect()}
    assert len(got) == out.count() == 95
    assert all(got[i]["prob1"] < 0.6 for i in range(90) if i % 3 == 0)


def test_nested_crossfit_has_a_row_per_consumer(spark):
    rows = [(i, i % 3, float(i), float(i % 2)) for i in range(60)]
    d = spark.createDataFrame(rows, "id bigint, fold int, x double, y double")
    out = md.crossfit_nested(d, lambda: LogisticRegression(labelCol="y", featuresCol="features", maxIter=3), ["x"], "y", ["id"], 2)
    assert out.count() == 180 and out.select("id", "outer_fold").distinct().count() == 180


def test_csv_round_trip_keeps_text(spark, tmp_path):
    d = spark.createDataFrame([("a", "0.10"), ("b", "1e-3")], "pair_id string, risk_score string")
    tb.write_csv(d, str(tmp_path / "r"))
    back = tb.read_text_csv(spark, str(tmp_path / "r"), ["pair_id", "risk_score"])
    assert sorted(tuple(r) for r in back.collect()) == [("a", "0.10"), ("b", "1e-3")]
    tb.write_parquet(d, str(tmp_path / "p"), ["pair_id"])
    assert tb.read_parquet(spark, str(tmp_path / "p")).count() == 2
    tb.write_json(d, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2
