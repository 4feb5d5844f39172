"""Hand-written logs with the expected facts written out."""

import pytest
from pyspark.sql import functions as F

from dyad.functions import ordered as od
from dyad.functions.cols import action_code
from dyad.operators import live as lv
from dyad.operators import pair_hands as phs
from dyad.operators import pairs as pr
from dyad.operators import seats as st
from dyad.operators import sequence as sq

LOG = "hand_id string, street int, player_id bigint, action string, amount bigint, strength int"
# h1: 2 raises, 1 (stronger at that moment) folds to 2, 3 calls; h2: relay of 1 and 2 over 3, who folds;
# h3: all passive to the last street; h4: two fold with nobody aggressive.
ROWS = [
    ("h1", 0, 1, "call", 30_000, 80), ("h1", 0, 2, "raise", 40_000, 20), ("h1", 0, 3, "call", 40_000, 50),
    ("h1", 1, 1, "fold", 0, 10), ("h1", 3, 2, "bet", 10_000, 20), ("h1", 3, 3, "fold", 0, 30),
    ("h2", 0, 1, "raise", 20_000, 60), ("h2", 0, 3, "call", 20_000, 61), ("h2", 0, 2, "raise", 50_000, 10),
    ("h2", 0, 3, "fold", 0, 61), ("h2", 1, 1, "check", 0, 60), ("h2", 3, 2, "check", 0, 11), ("h2", 3, 1, "check", 0, 60),
    ("h3", 0, 1, "check", 5, 40), ("h3", 1, 2, "check", 5, 40), ("h3", 3, 1, "check", 5, 40), ("h3", 3, 2, "check", 5, 40),
    ("h4", 0, 1, "fold", 1, 90), ("h4", 0, 2, "fold", 1, 10),
]


def numbered(spark, rows):
    seen: dict[str, int] = {}
    out = []
    for r in rows:
        out.append((*r, seen.get(r[0], 0)))
        seen[r[0]] = seen.get(r[0], 0) + 1
    d = spark.createDataFrame(out, LOG + ", action_no bigint")
    return d.withColumns({"table_id": F.lit(0).cast("bigint"), "phase": F.lit("development"), "y": action_code("action"),
                          "started_at": F.lit(0).cast("bigint"), "big_blind": F.lit(10_000).cast("bigint")})


@pytest.fixture(scope="module")
def built(spark):
    context = sq.action_context(numbered(spark, ROWS), 1_000_000).cache()
    seats = st.seat_features(context).cache()
    ph = phs.pair_hands(seats, st.hand_totals(seats), sq.consecutive_aggression(context)).cache()
    return context, seats, {(r["hand_id"], r["p1"], r["p2"]): r for r in ph.collect()}


def test_context(built):
    rows = {(r["hand_id"], r["action_no"]): r for r in built[0].collect()}
    r = rows["h1", 5]
    assert (r["last_agg"], r["n_agg_hand"], r["n_agg_st"], r["own_act_before"]) == (2, 2, 1, 1)
    assert (r["to_call"], r["pot_before"], r["players_active"], r["live_opponents"]) == (10_000, 120_000, 2, 1)
    assert rows["h1", 0]["last_agg"] is None and rows["h2", 6]["self_last_agg"] == 0
    assert rows["h1", 4]["self_last_agg"] == 1 and rows["h1", 4]["to_call"] == 0


def test_attribution(built):
    got = {(r["hand_id"], r["player_id"]): (r["folded_to"], r["folds_induced"]) for r in sq.fold_attribution(built[0]).collect()}
    assert got == {("h1", 1): (2, 0), ("h1", 3): (2, 0), ("h1", 2): (None, 2), ("h2", 3): (2, 0), ("h2", 2): (None, 1)}


def test_fold_to_partner(built):
    r = built[2]["h1", 1, 2]
    assert r["folded_1_to_2"] and not r["folded_2_to_1"]
    # Folded on the second street holding 80 so far against 20: ahead, and not on the first street.
    assert r["ahead_fold_1_to_2"] and not r["ahead_fold_preflop_1_to_2"]
    assert r["fold_better_1_to_2"] and r["conceded_1_to_2"] and not r["paid_1_to_2"]
    assert r["outsiders_folded_to_pair"] == 1 and r["outsider_folds"] == 1


def test_unknown_aggressor_means_no(built):
    r = built[2]["h4", 1, 2]
    assert not r["folded_1_to_2"] and not r["ahead_fold_1_to_2"] and r["both_folded"] and not r["heads_up"]
    assert built[2]["h3", 1, 2]["folded_1_to_2"] is False


def test_relay_and_squeeze(built):
    r = built[2]["h2", 1, 2]
    assert r["consecutive_aggression"] and r["relay_cleared"] and r["both_raised_preflop"] and not r["squeeze_sandwich"]
    assert not built[2]["h2", 1, 3]["consecutive_aggression"]


def test_passive_and_tied_strength(built):
    r = built[2]["h3", 1, 2]
    assert r["mutual_passive"] and r["both_showdown"] and r["strength_gap"] == 0
    assert r["strength_rank_1"] == r["strength_rank_2"] == 1 and r["transfer_gross"] == 0


def test_value_flow_is_the_smaller_of_loss_and_gain(built):
    for r in built[2].values():
        assert r["transfer_1_to_2"] == min(max(-r["net_1"], 0), max(r["net_2"], 0))
        assert r["transfer_2_to_1"] == min(max(-r["net_2"], 0), max(r["net_1"], 0))


def test_net_sums_to_zero(built):
    assert all(r["s"] == 0 for r in built[1].groupBy("hand_id").agg(F.sum("net").alias("s")).collect())


def test_walk_has_no_rows(spark):
    assert st.seat_features(sq.action_context(numbered(spark, ROWS[:0]), 1)).count() == 0


@pytest.fixture(scope="module")
def hot(spark):
    """One hand holds most of the log."""
    rows = []
    for i in range(400):
        rows.append(("big", min(i // 100, 3), (i * 7) % 13, ["fold", "check", "call", "bet", "raise"][(i * i + i // 3) % 5],
                     100 + i, (i * 31) % 100))
    for h in range(20):
        rows += [(f"h{h}", j % 4, j % 3, ["check", "bet", "call", "fold"][(h + j) % 4], 10 * j, (h * j) % 100) for j in range(6)]
    return numbered(spark, rows).cache()


def snapshot(df):
    columns = sorted(df.columns)
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def test_cutting_a_hot_hand_changes_nothing(hot, monkeypatch):
    whole = sq.action_context(hot, 1_000_000).cache()
    seats = st.seat_features(whole).cache()
    plain = [snapshot(whole), snapshot(phs.third_folds_live(whole, seats)), snapshot(phs.isolation_counts(whole, seats)),
             snapshot(lv.expand_live(whole, seats, ["y"]))]
    monkeypatch.setattr(od, "BLOCK_ROWS", 16)
    cut = sq.action_context(hot, 1_000_000)
    assert snapshot(cut) == plain[0]
    assert snapshot(phs.third_folds_live(whole, seats)) == plain[1]
    assert snapshot(phs.isolation_counts(whole, seats)) == plain[2]
    assert snapshot(lv.expand_live(whole, seats, ["y"])) == plain[3]


@pytest.mark.parametrize("block", [2, 3, 512])
def test_blocked_pair_join(spark, block):
    rows = [("big", p) for p in range(17)] + [("small", p) for p in (3, 5, 9)] + [("one", 4)]
    s = spark.createDataFrame(rows, "hand_id string, player_id bigint")
    got = pr.seat_pairs(s.withColumnRenamed("player_id", "p1"), s.withColumnRenamed("player_id", "p2"), ["hand_id"], block=block)
    want = sorted((h, a, b) for h, a in rows for g, b in rows if h == g and a < b)
    assert sorted((r["hand_id"], r["p1"], r["p2"]) for r in got.collect()) == want
