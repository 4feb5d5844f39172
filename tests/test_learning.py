"""Templates, self-training, listwise ranking: literal hands, plain versions, skew."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from dyad.functions import ordered
from dyad.operators import listwise, self_training, templates
from dyad.operators.self_training import Rule

SCHEMA = "phase string, table_id long, hand_id string, street int, action_no long, player_id long, action string"


def hands(spark, lines):
    """`lines`: (hand, street, player, action) in order."""
    count, rows = {}, []
    for hand, street, player, action in lines:
        rows.append(("development", 1, hand, street, count.get(hand, 0), player, action))
        count[hand] = count.get(hand, 0) + 1
    acts = spark.createDataFrame(rows, SCHEMA)
    seats = spark.createDataFrame([(h, count[h], p) for h, p in sorted({(r[2], r[5]) for r in rows})], "hand_id string, hand_actions long, player_id long")
    return acts, seats


KINDS = {"fold": 0, "check": 1, "call": 2, "bet": 3, "raise": 3, "all_in": 4}


def plain_templates(lines):
    out = {}
    players = {}
    for hand, _, p, _ in lines:
        players.setdefault(hand, set()).add(p)
    for hand, seats in players.items():
        for a in seats:
            for b in seats:
                if a >= b:
                    continue
                for street in range(4):
                    run = [(p, KINDS[k]) for h, s, p, k in lines if h == hand and s == street and p in (a, b)]
                    for i in range(1, len(run)):
                        (p, k), (q, last) = run[i], run[i - 1]
                        if p == q:
                            continue
                        before = run[i - 2] if i > 1 and run[i - 2][0] == p else (None, None)
                        if k == 1 and last == 1:
                            name = "chk_chk"
                        elif last == 4 and k == 2:
                            name = "shove_call"
                        elif last >= 3 and k != 1:
                            name = ("chk_bet" if before[1] == 1 else "re" if before[1] in (3, 4) else "bet") + "_" + {0: "fold", 2: "call"}.get(k, "raise")
                        else:
                            continue
                        name += "_pre" if street == 0 else "_post"
                        if not name.startswith("chk_chk"):
                            name += "_1" if p == a else "_2"
                        key = (hand, a, b)
                        out.setdefault(key, {}).setdefault(name, 0)
                        out[key][name] += 1
    return out


def as_counts(df):
    return {(r["hand_id"], r["p1"], r["p2"]): {c: r[c] for c in df.columns if c not in templates.HAND_KEY and r[c]} for r in df.collect()}


def test_literal_patterns(spark):
    lines = [("h", 1, 1, "check"), ("h", 1, 2, "bet"), ("h", 1, 3, "call"), ("h", 1, 1, "fold"),  # check, bet, fold
             ("g", 0, 1, "bet"), ("g", 0, 2, "raise"), ("g", 0, 1, "call"),  # raised, then paid after an own bet
             ("f", 2, 2, "all_in"), ("f", 2, 1, "call"), ("e", 3, 1, "check"), ("e", 3, 2, "check")]
    got = as_counts(templates.partner_templates(templates.pair_steps(*hands(spark, lines))))
    assert got["h", 1, 2] == {"chk_bet_fold_post_1": 1}
    assert got["h", 2, 3] == {"bet_call_post_2": 1} and ("h", 1, 3) not in got
    assert got["g", 1, 2] == {"bet_raise_pre_2": 1, "re_call_pre_1": 1}
    assert got["f", 1, 2] == {"shove_call_post_1": 1} and got["e", 1, 2] == {"chk_chk_post": 1}


@pytest.mark.parametrize("rows", [65_536, 7])
def test_templates_of_long_hands_in_segments(spark, monkeypatch, rows):
    """Segments of seven actions, most of them without one of the two, give what whole hands give."""
    monkeypatch.setattr(ordered, "BLOCK_ROWS", rows)
    rnd = random.Random(1)
    lines = [(h, s, rnd.randint(1, 5), rnd.choice(list(KINDS))) for h in ("a", "b", "c") for s in range(4) for _ in range({"a": 60, "b": 4, "c": 25}[h])]
    lines += [("a", 3, 1, "bet")] + [("a", 3, 5, "check")] * 40 + [("a", 3, 2, "fold"), ("a", 3, 2, "fold")]
    assert as_counts(templates.partner_templates(templates.pair_steps(*hands(spark, lines)))) == plain_templates(lines)


def test_one_hand_with_most_rows_spreads_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(ordered, "BLOCK_ROWS", 500)
    rnd = random.Random(2)
    lines = [("hot", 1, rnd.randint(1, 3), rnd.choice(list(KINDS))) for _ in range(20_000)]
    steps = templates.pair_steps(*hands(spark, lines)).withColumn("part", F.floor(F.col("action_no") / 500))
    assert steps.groupBy("p1", "p2", "part").count().agg(F.max("count")).first()[0] <= 500
    assert steps.where("step_1 is null").count() == 3 and steps.where("step_2 is null").count() == 6


def test_every_pair_hand_has_template_features(spark):
    rnd = random.Random(3)
    lines = [(f"h{i}", 1, rnd.randint(1, 3), rnd.choice(list(KINDS))) for i in range(12) for _ in range(5)]
    acts, seats = hands(spark, lines)
    t = templates.partner_templates(templates.pair_steps(acts, seats))
    ph = spark.createDataFrame([("development", 1, 1, 2, f"h{i}") for i in range(15)], "phase string, table_id long, p1 long, p2 long, hand_id string")
    got = templates.template_features(ph, t).collect()
    assert len(got) == 15 and all(r["t_chk_chk"] is not None and 0 < r["pct_t_fold_don"] <= 1 for r in got)


def plain_ridge(x, y, w, ridge=self_training.RIDGE):
    m, t = w @ x / w.sum(), w @ y / w.sum()
    cov = (x * w[:, None]).T @ x / w.sum() - np.outer(m, m)
    b = np.linalg.solve(cov + ridge * np.eye(x.shape[1]), (w * y) @ x / w.sum() - m * t)
    return lambda v: v @ b + t - m @ b


def plain_rounds(x, label, fold, rule, rounds, folds):
    n = len(x)
    conf = np.zeros((folds, n), bool)
    inner, out = None, []
    for r in range(rounds + 1):
        if r:
            new = np.array([(label == -1) & (fold != f) & (np.round(inner[f], 9) > rule.threshold) for f in range(folds)])
            if (new == conf).all():
                break
            conf = new
        scores, deep = np.zeros(n), np.zeros((folds, n))
        for f in range(folds):
            c = conf[f]
            y = ((label == 1) | (c & (rule.mode == "positive"))).astype(float)
            w = np.where(label == 1, rule.positive, np.where(label == 0, rule.negative, np.where(c, rule.picked if rule.mode == "positive" else 0.0, rule.unknown)))
            for g in range(folds):
                use = (fold != f) & (fold != g) & (w > 0)
                model = plain_ridge(x[use], y[use], w[use])
                deep[f, fold == g] = model(x[fold == g])
                if f == g:
                    scores[fold == f] = model(x[fold == f])
        inner = deep
        out.append((scores, conf.sum()))
    return out


@pytest.mark.parametrize("mode", ["positive", "drop"])
def test_self_training_rounds(spark, mode):
    rng = np.random.default_rng(4)
    n = 300
    label = rng.choice([-1, 0, 1], n, p=[0.6, 0.2, 0.2])
    hidden = (rng.random(n) < 0.4) | (label == 1)
    x = rng.standard_normal((n, 3)) + hidden[:, None] * 1.5 * (label != 0)[:, None]
    fold = rng.integers(0, 3, n)
    d = spark.createDataFrame([(i, int(a), int(k), *map(float, v)) for i, (a, k, v) in enumerate(zip(label, fold, x))] + [(999, None, 0, 1.0, 1.0, 1.0)],
                              "id long, label int, fold int, a double, b double, c double").repartition(3)
    rule = Rule(threshold=0.7, mode=mode)
    scored, rounds = self_training.self_training(d, ["a", "b", "c"], ["id"], rule, rounds=3, folds=3)
    want = plain_rounds(x, label, fold, rule, 3, 3)
    assert [(r["round"], r["picked"]) for r in rounds.orderBy("round").collect()] == [(i, p) for i, (_, p) in enumerate(want)]
    assert len(want) > 1
    for i, (scores, _) in enumerate(want):
        got = {r["id"]: r["score"] for r in scored.where(F.col("round") == i).collect()}
        assert len(got) == n and all(math.isclose(got[k], s, abs_tol=1e-9) for k, s in enumerate(scores))
    report = self_training.round_report(scored, rounds, "id").collect()
    assert len(report) == len(want) and all(0 <= r["labelled_ap"] <= 1 for r in report)


def test_no_confident_row_ends_the_rounds(spark):
    d = spark.createDataFrame([(i, i % 3 - 1, i % 2, float(i)) for i in range(30)], "id long, label int, fold int, a double")
    scored, rounds = self_training.self_training(d, ["a"], ["id"], Rule(threshold=5.0), folds=2)
    assert rounds.count() == 1 and scored.count() == 30


def test_linear_crossfit_knows_no_row_of_its_fold(spark):
    rows = [(i, None if i == 40 else i % 2, float(i), float(i % 2)) for i in range(41)]
    d = spark.createDataFrame(rows, "id long, fold int, a double, y double")
    got = {r["id"]: r["score"] for r in self_training.linear_crossfit(d, ["a"], "y", 2).collect()}
    assert all(abs(got[i] - (1 - i % 2)) < 1e-6 for i in range(40)) and 0.4 < got[40] < 0.6
    lone = self_training.linear_crossfit(d.where("fold = 0"), ["a"], "y", 2).collect()
    assert all(r["score"] is None for r in lone)
    assert self_training.linear_crossfit(d.where("id < 0"), ["a"], "y", 2).count() == 0


def lists(rng, n_lists, k=3, longest=60):
    rows = []
    for p in range(n_lists):
        n = rng.integers(2, longest)
        x = rng.standard_normal((n, k))
        gold = np.zeros(n, int)
        gold[np.argsort(-(x @ np.array([1.5, -1.0, 0.0][:k]) + rng.gumbel(size=n)))[:rng.integers(1, 4)]] = 1
        rows += [("development", p % 7, p, p + 1, f"h{i:04d}", int(g), *map(float, v)) for i, (g, v) in enumerate(zip(gold, x))]
    return rows


LIST = "phase string, table_id int, p1 int, p2 int, hand_id string, gold int, a double, b double, c double"


def test_gradient_and_hessian_of_the_list_likelihood(spark):
    rng = np.random.default_rng(5)
    rows = lists(rng, 12) + [("development", 1, 90, 91, "x", 1, 1.0, 2.0, 3.0)]
    d = spark.createDataFrame(rows, LIST).withColumn("outer", F.lit(0)).cache()
    key = ["p1", "p2"]
    theta = np.array([0.4, -0.2, 0.7])

    def plain(t):
        loss = 0.0
        for p in {r[2] for r in rows}:
            own = [r for r in rows if r[2] == p]
            s = np.array([r[6:] for r in own]) @ t
            g = np.array([r[5] for r in own], bool)
            if (~g).any():
                loss += sum(np.log(np.exp(s[~g]).sum() + np.exp(v)) - v for v in s[g])
        return loss
    names = ["a", "b", "c"]
    loss, grad, hess = listwise.likelihood(d, {0: theta}, names, key)[0]
    assert loss == pytest.approx(plain(theta), rel=1e-10)
    step = 1e-5
    for i in range(3):
        e = np.eye(3)[i] * step
        assert grad[i] == pytest.approx((plain(theta + e) - plain(theta - e)) / (2 * step), rel=1e-6, abs=1e-6)
        other = [listwise.likelihood(d, {0: theta + sign * e}, names, key)[0][1] for sign in (1, -1)]
        assert hess[i] == pytest.approx((other[0] - other[1]) / (2 * step), rel=1e-5, abs=1e-5)
    assert np.isfinite(listwise.likelihood(d, {0: theta * 1e4}, names, key)[0][0])


def test_listwise_order_beats_a_single_measure_and_keeps_every_hand(spark):
    rng = np.random.default_rng(6)
    rows = lists(rng, 40) + [("development", 3, 500, 501, f"h{i:04d}", int(i == 7), 3.0 if i == 7 else 0.0, 0.0, 0.0) for i in range(3000)]
    rows += [("development", 2, 600, 601, f"h{i}", 0, 1.0, None, 0.0) for i in range(5)]
    d = spark.createDataFrame(rows, LIST).repartition(5)
    got = {(r["p1"], r["hand_id"]): r["list_score"] for r in listwise.listwise_ranker(d, ["a", "b", "c"], folds=3).collect()}
    assert len(got) == len(rows) and all(v is not None for v in got.values())

    def top(score):
        hits = 0
        for p in range(40):
            own = [r for r in rows if r[2] == p]
            hits += max(own, key=score)[5]
        return hits
    assert top(lambda r: got[r[2], r[4]]) > max(top(lambda r: r[6]), top(lambda r: -r[7]))
    assert max((v, h) for (p, h), v in got.items() if p == 500)[1] == "h0007"


def plain_ap(rows):
    """`rows`: (score, id, target, weight); a null score comes last."""
    hits = seen = 0
    gain = 0.0
    for score, i, y, w in sorted(rows, key=lambda r: (math.inf if r[0] is None else -r[0], r[1])):
        for _ in range(w):
            seen += 1
            hits += y
            gain += y * hits / seen
    return gain / hits if hits else 0.0


def test_lanes_of_one_ranking(spark):
    """Every lane equals the ranking of its own rows; ties, null scores and lanes without positives included."""
    from dyad.operators import sweeps

    rnd = random.Random(8)
    rows = [(i, rnd.choice([None, 0.1, 0.1, rnd.random()]), *[rnd.random() < 0.2 for _ in range(3)], *[rnd.choice([0, 0, 1, 3]) for _ in range(3)]) for i in range(120)]
    d = spark.createDataFrame(rows, "id long, s double, y0 boolean, y1 boolean, y2 boolean, w0 int, w1 int, w2 int").repartition(4)
    for weights in (None, [F.col(f"w{i}") for i in range(3)]):
        got = sweeps.precision_sweep(d, "s", "id", [F.col("y0"), F.col("y1"), F.lit(False)], weights=weights).first()
        for i in range(3):
            want = plain_ap([(r[1], r[0], r[2 + i] and i < 2, r[5 + i] if weights else 1) for r in rows])
            assert got["ap"][i] == pytest.approx(want, abs=1e-12)
    assert sweeps.precision_sweep(d.where("id < 0"), "s", "id", [F.col("y0")]).count() == 0


def test_rows_are_not_copied_per_replicate(spark):
    """The plan of a sweep reads and ranks each row once, whatever the number of lanes."""
    from dyad.operators import sweeps

    d = spark.createDataFrame([(i, float(i % 9), i % 2 == 0) for i in range(50)], "id long, s double, y boolean")
    plan = sweeps.precision_sweep(d, "s", "id", [F.col("y")] * 12)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan


@pytest.mark.parametrize("stretch", [4096, 3])
def test_k_best_of_several_scores(spark, stretch):
    """Stretches of three rows, merged level by level, give what a whole sort gives; nulls and ties included."""
    from dyad.operators import best

    rnd = random.Random(9)
    rows = [("hot" if i < 150 else f"k{i % 4}", i, f"h{i:03d}", rnd.choice([None, 1.0, 2.0, rnd.random()]), rnd.randint(0, 5), rnd.choice([None, float(i)])) for i in range(200)]
    d = spark.createDataFrame(rows, "k string, place long, hand_id string, a double, b int, c double").repartition(4)
    got = {r["k"]: r for r in best.k_best(d, ["k"], "place", "hand_id", ["a", "b"], 4, ["c"], stretch).collect()}
    assert set(got) == {r[0] for r in rows}
    for key, r in got.items():
        for name, at in (("a", 3), ("b", 4)):
            own = sorted(((-x[at], x[2], x[5]) for x in rows if x[0] == key and x[at] is not None), key=lambda t: t[:2])
            assert [tuple(x) for x in r[f"best_{name}"]] == own[:4]
            assert r[f"n_{name}"] == len(own) and r[f"sum_{name}"] == pytest.approx(-sum(x[0] for x in own))
    features = best.many_score_features(d, "place", {"a": (1, 3), "b": (2,)}, {"a": ["c"]}, 3, ["k"]).collect()
    for r in features:
        own = sorted(((-x[3], x[2], x[5]) for x in rows if x[0] == r["k"] and x[3] is not None), key=lambda t: t[:2])[:3]
        assert r["a_top3"] == pytest.approx(-sum(x[0] for x in own) / 3)
        some = [x[2] for x in own if x[2] is not None]
        assert r["a_best3_c"] == (pytest.approx(sum(some) / len(some)) if some else None)
