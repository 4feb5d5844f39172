"""Self-training of a linear learner: confident unlabelled rows join the training set, round by round.

The learner is a weighted ridge regression, so a model is a function of sums, and the model that
leaves out any folds is the total of the others' sums. One pass over the rows gives the sums of
every fold; all models of a round, also those that leave out two folds, come from these. A row's
pseudo-label inside the model of fold f comes from a model that knew neither f nor the row's own fold.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dyad.functions.cols import as_int
from dyad.operators.metrics import average_precision
from dyad.session import settle

UNKNOWN = -1
RIDGE = 1e-3


@dataclass(frozen=True)
class Sums:
    """Weighted moments of one part of the rows; parts add up."""
    weight: float
    x: np.ndarray
    xx: np.ndarray
    y: float
    xy: np.ndarray

    def __add__(self, o: Sums) -> Sums:
        return Sums(self.weight + o.weight, self.x + o.x, self.xx + o.xx, self.y + o.y, self.xy + o.xy)

    def model(self, ridge: float = RIDGE) -> np.ndarray | None:
        """Intercept and slopes; None without rows to learn from."""
        if self.weight <= 0:
            return None
        mean, target = self.x / self.weight, self.y / self.weight
        cov = self.xx / self.weight - np.outer(mean, mean)
        slopes = np.linalg.solve(cov + ridge * np.eye(len(mean)), self.xy / self.weight - mean * target)
        return np.concatenate([[target - mean @ slopes], slopes])


def fold_sums(rows: DataFrame, features: list[str], label: str, weight: str, keys: list[str]) -> dict[tuple, Sums]:
    """The moments of every group of `keys` (folds, so few); rows with a null label or no weight do not count."""
    k, w = len(features), F.col(weight).cast("double")
    one = [F.sum(w), *[F.sum(w * F.col(a)) for a in features], *[F.sum(w * F.col(a) * F.col(b)) for i, a in enumerate(features) for b in features[i:]],
           F.sum(w * F.col(label)), *[F.sum(w * F.col(label) * F.col(a)) for a in features]]
    out = {}
    for r in rows.where((w > 0) & F.col(label).isNotNull()).groupBy(*keys).agg(*one).collect():
        v = [float(x) for x in r[len(keys):]]
        xx = np.zeros((k, k))
        xx[np.triu_indices(k)] = v[1 + k:-1 - k]
        out[tuple(r[:len(keys)])] = Sums(v[0], np.array(v[1:1 + k]), xx + np.triu(xx, 1).T, v[-1 - k], np.array(v[-k:]))
    return out


def model_without(parts: dict[int, Sums], left_out: Iterable[int], ridge: float = RIDGE) -> np.ndarray | None:
    rest = [s for fold, s in sorted(parts.items()) if fold not in left_out]
    return sum(rest[1:], rest[0]).model(ridge) if rest else None


def linear_score(model: np.ndarray | None, features: list[str]) -> Column:
    if model is None:
        return F.lit(None).cast("double")
    score = F.lit(float(model[0]))
    for b, name in zip(model[1:], features):
        score = score + F.lit(float(b)) * F.col(name)
    return score


def by_fold(models: dict[int, np.ndarray | None], features: list[str], fold: str = "fold") -> Column:
    """Each row scored by its fold's model; all models are literals of one expression, so one pass scores every row."""
    out = F.lit(None).cast("double")
    for k, model in models.items():
        out = F.when(F.col(fold) == k, linear_score(model, features)).otherwise(out)
    return out


def linear_crossfit(df: DataFrame, features: list[str], label: str, folds: int, weight: str | None = None, ridge: float = RIDGE, out: str = "score") -> DataFrame:
    """`df` with the score of a ridge regression that never saw the row's fold.

    Features that are null count as zero; a row without a fold teaches none and has the mean of the fold models, a
    fold without other rows to learn from has null scores. One pass fits, one scores.
    """
    names = [f"__x{i}" for i in range(len(features))]
    d = df.withColumns({"fold": F.pmod("fold", F.lit(folds)).cast("int"), "__w": F.col(weight).cast("double") if weight else F.lit(1.0),
                        **{n: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for n, c in zip(names, features)}})
    parts = {k[0]: s for k, s in fold_sums(d.where("fold is not null"), names, label, "__w", ["fold"]).items()}
    models = {k: model_without(parts, {k}, ridge) for k in range(folds)}
    known = [m for m in models.values() if m is not None]
    loose = linear_score(np.mean(known, axis=0) if known else None, names)
    return d.withColumn(out, F.when(F.col("fold").isNull(), loose).otherwise(by_fold(models, names))).drop("__w", *names)


def linear_crossfit_nested(df: DataFrame, features: list[str], label: str, folds: int, ridge: float = RIDGE) -> DataFrame:
    """One row per row and outer fold, scored by a model that knew neither the outer fold nor the row's own."""
    parts = {k[0]: s for k, s in fold_sums(df.withColumn("__w", F.lit(1.0)), features, label, "__w", ["fold"]).items()}
    each = df.withColumn("outer_fold", F.explode(F.array(*[F.lit(f) for f in range(folds)])))
    score = F.lit(None).cast("double")
    for f in range(folds):
        score = F.when(F.col("outer_fold") == f, by_fold({g: model_without(parts, {f, g}, ridge) for g in range(folds)}, features)).otherwise(score)
    return each.withColumn("score", score)


@dataclass(frozen=True)
class Rule:
    """Which unlabelled rows are taken up, and as what.

    Over `threshold` a row is confident: a positive of weight `picked` (mode "positive"), or left out
    ("drop"). The others are negatives of weight `unknown`; with `low` set only those at or under it.
    """
    threshold: float
    mode: str = "positive"
    picked: float = 3.0
    positive: float = 10.0
    negative: float = 1.0
    unknown: float = 0.3
    low: float | None = None


def self_training(df: DataFrame, features: list[str], ident: list[str], rule: Rule, rounds: int = 2, folds: int = 5, ridge: float = RIDGE) -> tuple[DataFrame, DataFrame]:
    """Out-of-fold scores of every round, and a table of rounds.

    `df` has ``label`` (1, 0, -1 unknown), ``fold`` and numeric features; null features count as zero, rows
    with a null label or fold are left out. The first result has `ident`, label, fold, round, score, round 0
    being the start, where every unknown row is a weak negative. The second has round, picked
    (confident rows, counted once per model) and changed (of these, rows whose standing differs from the round
    before). Rounds end early once a round would change nothing.
    """
    names = [f"x{i}" for i in range(len(features))]
    d = settle(df.where("label is not null and fold is not null").select(
        *ident, F.col("label").cast("int").alias("label"), F.pmod("fold", F.lit(folds)).cast("int").alias("fold"),
        *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(n) for n, c in zip(names, features)]))
    each = d.select("label", "fold", *names, F.explode(F.array(*[F.lit(f) for f in range(folds)])).alias("outer")).where("outer <> fold")
    unknown = F.col("label") == UNKNOWN

    def inner_score(models: dict[tuple[int, int], np.ndarray | None]) -> Column:
        score = F.lit(None).cast("double")
        for f in range(folds):
            score = F.when(F.col("outer") == f, by_fold({g: models[f, g] for g in range(folds)}, names)).otherwise(score)
        return F.round(score, 9)

    picked_before, before, scored, table = F.lit(False), None, [], []
    for r in range(rounds + 1):
        score = inner_score(before) if before is not None else F.lit(None).cast("double")
        confident = unknown & F.coalesce(score > rule.threshold, F.lit(False))
        rest = F.lit(rule.unknown) if rule.low is None or before is None else F.when(F.coalesce(score <= rule.low, F.lit(False)), rule.unknown).otherwise(0.0)
        rows = each.withColumns({
            "target": F.when(F.col("label") == 1, 1.0).when(confident & F.lit(rule.mode == "positive"), 1.0).otherwise(0.0),
            "weight": F.when(F.col("label") == 1, rule.positive).when(F.col("label") == 0, rule.negative)
            .when(confident, rule.picked if rule.mode == "positive" else 0.0).otherwise(rest)})
        if before is not None:
            n, changed = rows.agg(F.sum(as_int(confident)), F.sum(as_int(confident != picked_before))).first()
            if not changed:
                break
            table.append((r, n, changed))
        else:
            table.append((0, 0, 0))
        sums = fold_sums(rows, names, "target", "weight", ["outer", "fold"])
        parts = {f: {g: s for (o, g), s in sums.items() if o == f} for f in range(folds)}
        scored.append(d.select(*ident, "label", "fold", F.lit(r).alias("round"), by_fold({f: model_without(parts[f], {f}, ridge) for f in range(folds)}, names).alias("score")))
        picked_before = confident
        before = {(f, g): model_without(parts[f], {f, g}, ridge) for f in range(folds) for g in range(folds)}
    out = scored[0]
    for s in scored[1:]:
        out = out.unionByName(s)
    return out, df.sparkSession.createDataFrame(table, "round int, picked long, changed long")


def round_report(scored: DataFrame, rounds: DataFrame, ident: str) -> DataFrame:
    """The table of rounds with average precision over labelled rows alone and over all rows, unknown ones counted as negatives."""
    d = scored.withColumns({"y": as_int(F.col("label") == 1), "score": F.round("score", 9)})
    known = average_precision(d.where(F.col("label") != UNKNOWN), "score", "y", ident, ["round"]).select("round", F.col("ap").alias("labelled_ap"))
    whole = average_precision(d, "score", "y", ident, ["round"]).select("round", "rows", "positives", F.col("ap").alias("population_ap"))
    return rounds.join(F.broadcast(known), "round", "left").join(F.broadcast(whole), "round", "left")  # as many rows as rounds
