"""Nothing is dropped or learnt from where it should not be."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from dyad import session
from dyad.operators import metrics, models, similarity, tokens


def test_a_lone_fold_is_not_scored_by_its_own_model(spark):
    d = spark.createDataFrame([(i, 0 if i < 40 else None, float(i % 7), i % 2) for i in range(50)], "id long, fold int, x double, label int")
    rows = models.crossfit(d, models.logistic("label"), ["x"], "label", ["id"], 2, folds=3).collect()
    assert sorted(r["id"] for r in rows) == list(range(50))
    assert all(r["prob1"] is None for r in rows if r["id"] < 40)
    assert all(r["prob1"] is not None for r in rows if r["id"] >= 40)
    nested = models.crossfit_nested(d.where("fold is not null"), models.logistic("label"), ["x"], "label", ["id"], 2).collect()
    assert {r["id"] for r in nested} == set(range(40)) and all(r["prob0"] is None for r in nested if r["outer_fold"] == 0)


def test_a_positive_without_a_score_counts_as_last(spark):
    d = spark.createDataFrame([("a", 0.9, 0), ("b", 0.8, 1), ("c", 0.1, 0), ("d", None, 1)], "id string, s double, y int")
    got = metrics.average_precision(d, "s", "y", "id").first()
    assert (got["rows"], got["positives"]) == (4, 2) and got["ap"] == pytest.approx((1 / 2 + 2 / 4) / 2)


def test_undrawn_positives_stay_as_negatives(spark):
    rows = [(i, 1 if i < 8 else 0, "known" if i < 4 else "held" if i < 8 else None, float(20 - i)) for i in range(20)]
    d = spark.createDataFrame(rows, "id long, label int, family string, score double")
    got = metrics.mixture_rows(d, "held", 0.2, "s", "id").groupBy("draw").agg(F.count("*").alias("n"), F.sum("target").alias("t")).collect()
    assert len(got) == 5 and all((r["n"], r["t"]) == (20, 5) for r in got)
    assert metrics.mixture_ap(d, "held", 0.0, "s", "id").first()["ap"] == 1.0


def test_every_token_over_the_floor_has_a_loading(spark):
    rnd = np.random.default_rng(8)
    cells = [(b, b + 1, f"h{b}", int(t), int(n)) for b in range(60) for t, n in zip(rnd.choice(300, 25, replace=False), rnd.integers(1, 9, 25))]
    d = spark.createDataFrame(cells, "p1 int, p2 int, hand_id string, token long, n long")
    factor = {r["token"]: r["loading"] for r in tokens.fit_token_svd(d, 2, 2, steps=60).collect()}
    kept = sorted(r["token"] for r in tokens.token_vocab(d, 2).collect())
    assert sorted(factor) == kept
    x = np.zeros((60, len(kept)))
    for b, _, _, t, n in cells:
        if t in factor:
            x[b, kept.index(t)] = np.log1p(n)
    right = np.linalg.svd(x)[2][:2]
    got = np.array([factor[t] for t in kept]).T
    assert abs(right[0] @ got[0]) == pytest.approx(1, abs=1e-6) and abs(right[1] @ got[1]) == pytest.approx(1, abs=2e-2)


def test_every_hand_of_a_pair_is_compared(spark):
    rows = [("development", "t", 1, 2, f"h{i:03d}", float(i), float(i % 5), i % 2) for i in range(50)]
    d = spark.createDataFrame(rows, "phase string, table_id string, p1 int, p2 int, hand_id string, score double, v double, type_a int")
    got = similarity.pair_consistency(d, ["v"]).collect()
    assert len(got) == 50 and all(r["sim_mean"] == 0 for r in got if r["rank"] > 20)
    whole = sum((i % 2) / (50 - i) for i in range(50))
    assert {round(r["type_agree"], 9) for r in got} == {0.0, round(whole, 9)}


def test_every_hand_of_a_pair_is_ranked(spark):
    rows = [("development", f"{t}", t, 9, f"h{t}-{i:02d}", float(i), float(i % 5), int(i % 4 == 0)) for t in range(4) for i in range(26)]
    rows += [("development", "8", 8, 9, "lone", 1.0, 0.0, 1), ("development", "0", 0, 9, "none", None, 0.0, 0)]
    d = spark.createDataFrame(rows, "phase string, table_id string, p1 int, p2 int, hand_id string, score double, v double, gold int")
    d = d.withColumn("table_id", F.col("table_id").cast("long"))
    got = {r["hand_id"]: r["borda"] for r in models.pairwise_ranker(d, ["score", "v"], folds=2).collect()}
    assert set(got) == {r[4] for r in rows}
    low = ["none", *(f"h0-{i:02d}" for i in range(6))]
    assert [got[h] for h in low] == sorted(got[h] for h in low) and len({got[h] for h in low}) == 7
    assert all(got[h] < 0 for h in [*low, "lone"]) and all(got[f"h0-{i:02d}"] >= 0 for i in range(6, 26))


def test_a_cluster_needs_a_shared_folder():
    class Spark:
        class conf:  # noqa: N801
            get = staticmethod(lambda *_: None)

        class sparkContext:  # noqa: N801
            master = "spark://host:7077"
    with pytest.raises(ValueError):
        session.scratch_root(Spark)


def test_every_line_is_dealt_and_every_hand_ranked(spark):
    from dyad.plans import base
    from dyad.plans.catalog import QUERIES

    sf = "/root/testdata/sf0.001"
    lines = spark.read.parquet(f"{sf}/lineitem.parquet").count()
    assert QUERIES["parsed_boards"](spark, sf).count() == lines
    assert QUERIES["draws"](spark, sf).agg(F.sum("n_lines")).first()[0] == lines
    hands = base.pair_hands(spark, sf).count()
    assert all(QUERIES[q](spark, sf).count() == hands for q in ("borda_scores", "comparator_blend", "seed_bag_placebo", "template_features", "sizing_features"))


def test_columns_out_of_place_and_missing_rows_are_told(spark):
    from dyad.operators import retrieval

    slots = ", ".join(f"{s} string" for s in retrieval.SLOTS)
    rows = [(f"{i}", 1, 2, 0.5, "none", *["NO_EVIDENCE"] * 5) for i in range(3)]
    d = spark.createDataFrame(rows, f"pair_id string, p1 int, p2 int, risk_score double, predicted_behavior string, {slots}")
    hands = spark.createDataFrame([("h", "evaluation")], "hand_id string, phase string")
    seats = spark.createDataFrame([("h", 1)], "hand_id string, player_id int")
    got = {r["rule"]: r["n_bad"] for r in retrieval.validate(d.select("risk_score", *[c for c in d.columns if c != "risk_score"]).where("pair_id > 0"), d.select("pair_id"), hands, seats).collect()}
    assert got["column_order"] == 1 and got["row_count"] == 1 and got["constant_risk"] == 1 and got["missing_pair"] == 1
    fine = {r["rule"]: r["n_bad"] for r in retrieval.validate(d, d.select("pair_id"), hands, seats).collect()}
    assert fine["column_order"] == fine["row_count"] == fine["missing_pair"] == 0
