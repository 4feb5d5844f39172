"""Steps that many queries share: how often they move rows, and what they give whichever way they take."""

from pyspark.sql import functions as F

from dyad.functions import ordered as od
from dyad.operators import pair_hands as phs
from dyad.operators import seats as st
from dyad.operators import sequence as sq
from dyad.operators import within_pair as wp
from dyad.operators.pairs import PAIR
from dyad.plans import base as b
from dyad.plans.catalog import QUERIES

SF = "/root/testdata/sf0.001"


def shuffles(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def scores(spark):
    return spark.range(900).select("id", F.pmod("id", F.lit(7)).alias("k"), F.when(F.col("id") % 11 != 0, F.pmod(F.hash("id"), F.lit(40))).alias("x"),
                                   (F.pmod(F.hash("id"), F.lit(13)) / 4.0).alias("y"))


def test_percentiles_of_many_columns_share_one_shuffle(spark):
    assert shuffles(od.percentiles(scores(spark), ["k"], ["k", "id"], ["x", "y"])) == 1


def test_percentiles_of_long_keys_are_the_same(spark, monkeypatch):
    d = scores(spark).where("k < 3 or id < 60")
    read = lambda: sorted(map(tuple, od.percentiles(d, ["k"], ["k", "id"], ["x", "y"], keep=["y"]).collect()), key=lambda r: r[:2])
    plain = read()
    monkeypatch.setattr(od, "BLOCK_ROWS", 50)
    assert read() == plain and len(plain) == d.count()


def test_signals_move_no_rows(spark):
    assert "Exchange" not in QUERIES["hand_signals"](spark, SF)._jdf.queryExecution().executedPlan().toString()


def test_crowded_hands_give_the_same_pair_hands(spark, monkeypatch):
    s, acts = b.seats(spark, SF), b.scored(spark, SF)
    keys = ["hand_id", "p1", "p2"]

    def rows():
        from dyad.operators import live as lv
        d = phs.pair_hands(s, st.hand_totals(s), sq.consecutive_aggression(b.context(spark, SF)), lv.surprise_by_seat(acts), b.by_target(spark, SF))
        return sorted(map(tuple, d.select(*keys, "pair_rn", "consecutive_aggression", "h_folds", "net_1", "net_2", "surprise_1", "v_surprise_1_to_2").collect()))

    plain = rows()
    cut = phs.cell_count
    monkeypatch.setattr(phs, "cell_count", lambda d, g: cut(d, g, 2))
    assert rows() == plain
    want = wp.with_pair_position(b.pair_hands(spark, SF).drop("pair_rn")).select(*keys, "pair_rn")
    assert sorted(map(tuple, want.collect())) == [r[:4] for r in plain] and len(PAIR) == 4


def test_time_subsets_have_every_pair(spark, monkeypatch):
    from dyad.plans import catalog
    hands = [("development", 1, p, p + 1, f"{p}-{i}", i + 1) for p in range(40) for i in range(1 + p % 3)]
    monkeypatch.setattr(catalog, "signals", lambda *_: spark.createDataFrame(hands, "phase string, table_id long, p1 long, p2 long, hand_id string, pair_rn long"))
    got = QUERIES["time_subsets"](spark, SF).collect()
    assert len(got) == 40 and any(r["late_hands"] is None and r["sampled_hands"] is None for r in got)


def test_tokens_move_bags_and_actions_only(spark):
    plan = QUERIES["sequence_tokens"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "token" not in "".join(line for line in plan.splitlines() if "Exchange" in line) and "Window" not in plan


def test_tokens_of_long_hands_are_the_same(spark, monkeypatch):
    from dyad.operators import tokens as tk
    bags, acts = b.pair_hands(spark, SF), tk.described_actions(b.context(spark, SF))
    read = lambda: sorted(map(tuple, tk.sequence_tokens(bags, acts).collect()))
    factor = lambda: {r[0]: [abs(round(x, 6)) for x in r[1]] for r in tk.fit_bag_svd(tk.bag_tokens(bags, acts), 2, 20).collect()}
    plain, loadings = read(), factor()
    monkeypatch.setattr(tk, "LINE_ROWS", 6)
    assert len({r["whole"] for r in tk.bag_tokens(bags, acts).select("whole").distinct().collect()}) == 2
    assert read() == plain and factor() == loadings


def test_comparisons_make_no_couples(spark, monkeypatch):
    for name in ("borda_scores", "comparator_blend"):
        df = QUERIES[name](spark, SF)
        assert shuffles(df) == 1 and "Join" not in df._jdf.queryExecution().executedPlan().toString()
        plain = sorted(map(tuple, df.collect()))
        monkeypatch.setattr(od, "BLOCK_ROWS", 5)
        assert sorted(map(tuple, QUERIES[name](spark, SF).collect())) == plain
        monkeypatch.undo()


def test_pair_aggregate_moves_hands_once(spark):
    from dyad.operators import aggregate as ag
    ph = b.pair_hands(spark, SF)
    once, apart = ag.pair_aggregate(ph, True), ag.pair_aggregate(ph)
    assert shuffles(once) == 1 and once.columns == apart.columns
    read = lambda d: sorted(([round(v, 9) if isinstance(v, float) else v for v in r] for r in d.collect()), key=lambda r: r[:4])
    for x, y in zip(read(once), read(apart), strict=True):
        assert x == y


def test_residual_sums_do_not_move(spark):
    from dyad.operators import relational as rl
    plan = rl.policy_residual(b.live(spark, SF))._jdf.queryExecution().executedPlan().toString()
    moved = next(line for line in plan.splitlines() if "Exchange hashpartitioning" in line)
    assert "REPARTITION_BY_COL" in moved and shuffles(rl.policy_residual(b.live(spark, SF))) == 1


def test_rows_without_fold_are_not_moved(spark):
    from dyad.operators import models as md
    d = spark.range(300).select("id", (F.col("id") % 7).cast("double").alias("x"), F.when(F.col("id") % 4 != 0, (F.col("id") % 3).cast("int")).alias("fold"),
                                F.when(F.col("id") % 2 == 0, (F.col("id") % 7 > 3).cast("double")).alias("y"))
    out = md.crossfit(d, md.logistic("y"), ["x"], "y", ["id"], 2, 3)
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    got = {r["id"]: r for r in out.collect()}
    assert len(got) == 300
    whole = md.with_features(d, ["x"])
    fits = [md.logistic("y")().fit(whole.where(F.col("y").isNotNull() & (F.col("fold") != k))) for k in range(3)]
    want = [{r["id"]: r["probability"][1] for r in m.transform(whole).collect()} for m in fits]
    for i, r in got.items():
        mean = sum(w[i] for w in want) / 3 if r["fold"] is None else want[r["fold"]][i]
        assert abs(r["prob1"] - mean) < 1e-9


def test_labels_of_hands_are_those_of_the_bags(spark):
    from dyad.operators import bags as bg
    from dyad.plans import catalog as c
    ph = b.pair_hands(spark, SF).select(*PAIR, "hand_id")
    d = bg.label_hands(ph, c.labels(spark, SF), c.evidence(spark, SF))
    got = {(r["p1"], r["p2"], r["hand_id"]): r["bag_label"] for r in d.collect()}
    bags = {(r["p1"], r["p2"], r["hand_id"]): r["bag_label"] for r in c.bag_rows(spark, SF).collect()}
    assert len(got) == ph.count() and got == {k: bags.get(k) for k in got} and len(set(bags.values())) == 3
    assert {r[0] for r in d.select("family").distinct().collect()} >= {r[0] for r in c.labels(spark, SF).select("family").distinct().collect()}


def test_cells_move_actions_once(spark):
    from dyad.operators import relational as rl
    plan = rl.relational_cells(rl.encode_context(b.live(spark, SF)))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan


def test_positions_of_long_pairs_are_the_same(spark):
    d = b.pair_hands(spark, SF).select(*PAIR, "hand_id", "started_at")
    once, apart = wp.with_pair_position(d, True), wp.with_pair_position(d)
    assert shuffles(once) == 1
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, apart.select(*once.columns).collect()))
