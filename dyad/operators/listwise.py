"""Listwise ranking inside a pair: a linear Plackett-Luce model, fitted by Newton steps.

Every evidence hand of a pair should be drawn ahead of all hands of the pair that are not evidence: it
competes with these alone, so the likelihood of a list is a product over its evidence hands. What a
step needs of a list are sums over its hands (of exp(score), times features, times their products),
which combine map-side, so a list may have any length; then one row per evidence hand, and one
grand total. Features stand in units of their own spread, folds are learnt side by side.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dyad.operators.pairs import PAIR
from dyad.session import settle

RIDGE = 1e-2
STEPS = 12


def _dot(theta: np.ndarray, names: list[str]) -> Column:
    return reduce(lambda a, b: a + b, (F.lit(float(t)) * F.col(n) for t, n in zip(theta, names)))


def _score(thetas: dict[int, np.ndarray], names: list[str], by: str) -> Column:
    out = F.lit(None).cast("double")
    for k, theta in thetas.items():
        out = F.when(F.col(by) == k, _dot(theta, names)).otherwise(out)
    return out


def likelihood(rows: DataFrame, thetas: dict[int, np.ndarray], names: list[str], keys: list[str]) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """For every model: negative log-likelihood, gradient and Hessian over the lists it learns from.

    `rows` has ``outer`` (the model), the list's `keys`, ``gold`` and the features. Lists without a gold
    hand or without another one say nothing.
    """
    k = len(names)
    upper = [(i, j) for i in range(k) for j in range(i, k)]
    d = rows.withColumn("__s", _score(thetas, names, "outer"))
    group = ["outer", *keys]
    # Exponentials are taken against the largest score among the others, and both against the larger of that and the gold one: none overflows.
    top = d.groupBy(*group).agg(F.max(F.when(F.col("gold") == 0, F.col("__s"))).alias("__top"), F.max("gold").alias("__any")).where("__any = 1 and __top is not null").drop("__any")
    d = d.join(top, group)
    e = F.exp(F.col("__s") - F.col("__top"))
    others = d.where("gold = 0").groupBy(*group).agg(
        F.sum(e).alias("__d"), *[F.sum(e * F.col(n)).alias(f"__m{i}") for i, n in enumerate(names)],
        *[F.sum(e * F.col(names[i]) * F.col(names[j])).alias(f"__h{i}_{j}") for i, j in upper])
    ahead = F.col("__s") - F.col("__top")
    gold = d.where("gold = 1").withColumns({"__e": F.exp(F.least(ahead, F.lit(0.0))), "__o": F.exp(-F.greatest(ahead, F.lit(0.0)))}).select(
        *group, "__s", "__e", "__o", F.greatest("__s", "__top").alias("__max"), *names).join(others, group)
    own, rest = F.col("__e"), F.col("__o")
    whole = rest * F.col("__d") + own
    mean = [(rest * F.col(f"__m{i}") + own * F.col(n)) / whole for i, n in enumerate(names)]
    sums = [F.sum(F.log(whole) + F.col("__max") - F.col("__s")), *[F.sum(m - F.col(n)) for m, n in zip(mean, names)],
            *[F.sum((rest * F.col(f"__h{i}_{j}") + own * F.col(names[i]) * F.col(names[j])) / whole - mean[i] * mean[j]) for i, j in upper]]
    out = {}
    for r in gold.groupBy("outer").agg(*sums).collect():  # one row per model
        v = np.array([float(x) for x in r[1:]])
        h = np.zeros((k, k))
        h[np.triu_indices(k)] = v[1 + k:]
        out[r[0]] = float(v[0]), v[1:1 + k], h + np.triu(h, 1).T
    return out


def fit(rows: DataFrame, names: list[str], keys: list[str], models: list[int], steps: int = STEPS, ridge: float = RIDGE) -> dict[int, np.ndarray]:
    """Newton steps on the penalised likelihood, halved while they do not improve it; all models in one pass a step."""
    theta = {m: np.zeros(len(names)) for m in models}

    def state(at: dict[int, np.ndarray]) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
        found = likelihood(rows, at, names, keys)
        return {m: (loss + ridge / 2 * at[m] @ at[m], g + ridge * at[m], h + ridge * np.eye(len(names))) for m, (loss, g, h) in found.items()}
    now = state(theta)
    share = dict.fromkeys(now, 1.0)
    for _ in range(steps):
        going = [m for m in now if np.abs(now[m][1]).max() > 1e-8 * max(1.0, now[m][0]) and share[m] > 1e-3]
        if not going:
            break
        tried = {m: theta[m] - share[m] * np.linalg.solve(now[m][2], now[m][1]) if m in going else theta[m] for m in theta}
        found = state(tried)
        for m in going:
            if found[m][0] <= now[m][0]:
                theta[m], now[m], share[m] = tried[m], found[m], 1.0
            else:
                share[m] /= 2
    return theta


def spreads(df: DataFrame, features: list[str]) -> dict[str, tuple[float, float]]:
    """Mean and standard deviation of every feature; a constant one counts as spread 1."""
    r = df.agg(*[f(c) for c in features for f in (F.avg, F.stddev_pop)]).first()
    return {c: (r[2 * i] or 0.0, r[2 * i + 1] or 1.0) for i, c in enumerate(features)}


def listwise_ranker(cands: DataFrame, features: list[str], folds: int = 5, steps: int = STEPS, ridge: float = RIDGE, key: list[str] = PAIR) -> DataFrame:
    """Every hand of `cands` with ``list_score`` by the model that never saw its table's fold.

    `cands` has the pair's keys, hand_id, table_id, ``gold`` (1 for evidence) and the features; null features
    stand at their mean. No hand is left out, however long its list. Where no list outside the fold has both kinds of
    hands, scores are zero. Rows of one hand are ranked alike.
    """
    stats = spreads(cands, features)
    names = [f"f{i}" for i in range(len(features))]
    scaled = {n: F.coalesce((F.col(c).cast("double") - F.lit(m)) / F.lit(s), F.lit(0.0)) for n, (c, (m, s)) in zip(names, stats.items())}
    d = settle(cands.select(*key, "hand_id", F.coalesce(F.col("gold"), F.lit(0)).cast("int").alias("gold"),
                            F.pmod("table_id", F.lit(folds)).cast("int").alias("fold"), *[c.alias(n) for n, c in scaled.items()]))
    some = d.where("gold = 1").select(*key).distinct()
    lists = settle(d.join(some, key, "left_semi"))
    rows = lists.withColumn("outer", F.explode(F.array(*map(F.lit, range(folds))))).where("outer <> fold")
    theta = fit(rows, names, key, list(range(folds)), steps, ridge)
    return d.select(*key, "hand_id", _score(theta, names, "fold").alias("list_score"))
