"""Quality scores from a sparse ensemble of rules over text statistics.

Shallow trees are grown on labelled rows; every path from a root is a rule, a conjunction of
thresholds on statistics. A lasso-penalised logistic regression keeps a few rules and weighs them,
and the result is compiled into one Spark column expression over the statistics.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dyad.llm import store

MAX_ROWS = 20_000
CUT = 0.3

_CLASSES = {"upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789", "stop": b".,;:?'\"-()", "bang": b"!",
            "symbol": b"#$%&*+/<=>@[\\]^_`{|}~", "space": b" \t\n\r\x0b\x0c", "wide": bytes(range(128, 256))}
_MEMBER = np.array([[b in members for b in range(256)] for members in _CLASSES.values()], float)
STATS = ["log_bytes", "log_words", "log_lines", *(f"{c}_share" for c in _CLASSES), "entropy", "word_bytes", "longest_word",
         "distinct_share", "repeat_share", "common_share", "odd_word_share", "shout_share", "line_words", "distinct_line_share", "ended_line_share"]


def statistics(value: str | None) -> list[float]:
    """STATS of a text; a null counts as empty, and an empty text has zeros."""
    whole = (value or "").encode()
    words = whole.split()
    if not words:
        return [0.0] * len(STATS)
    counts = np.bincount(np.frombuffer(whole, np.uint8), minlength=256)
    share = counts[counts > 0] / len(whole)
    lines = [x for x in whole.split(b"\n") if x.strip()]
    seen: dict[bytes, int] = {}
    for w in words:
        seen[w] = seen.get(w, 0) + 1
    n, kinds = len(words), len(seen)
    odd = sum(c for w, c in seen.items() if not w[-1:].isalpha() and w[-1] < 128 and w[-1:] not in b".,;:?!")
    shout = sum(c for w, c in seen.items() if len(w) > 1 and w.isupper())
    return [np.log1p(len(whole)), np.log1p(n), np.log1p(len(lines)), *(_MEMBER @ counts / len(whole)), -(share * np.log2(share)).sum(),
            sum(len(w) * c for w, c in seen.items()) / n, np.log1p(max(map(len, seen))), kinds / n,
            sum(map(bytes.__eq__, words, words[1:])) / n, max(seen.values()) / n, odd / n, shout / n, np.log1p(n / len(lines)),
            len(set(lines)) / len(lines), sum(x.rstrip()[-1:] in b".?!" for x in lines) / len(lines)]


@F.pandas_udf(T.StructType([T.StructField(s, T.DoubleType()) for s in STATS]))
def stats_of(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for batch in texts:
        yield pd.DataFrame([statistics(t) for t in batch], columns=STATS, dtype=float)


@dataclass
class RuleEnsemble:
    """Rules as lists of (statistic, is above, threshold), their weights, and an intercept."""

    intercept: float
    rules: list[tuple[tuple[str, bool, float], ...]] = field(default_factory=list)
    weights: list[float] = field(default_factory=list)

    def score(self, stats: str) -> Column:
        """The chance of label 1, from the struct column of statistics with that name."""
        terms = [f"if({_holds(rule, stats)}, {weight!r}D, 0D)" for rule, weight in zip(self.rules, self.weights)]
        return 1 / (1 + F.exp(-F.expr(" + ".join([f"{self.intercept!r}D", *terms]))))


def _holds(rule, stats: str) -> str:
    return " and ".join(f"{stats}.{name} {'>' if above else '<='} {at!r}D" for name, above, at in rule)


def _paths(node, held: tuple = ()) -> Iterator[tuple]:
    if held:
        yield held
    if node.subtreeDepth():
        name, at = STATS[node.split().featureIndex()], round(node.split().threshold(), 6)
        yield from _paths(node.leftChild(), (*held, (name, False, at)))
        yield from _paths(node.rightChild(), (*held, (name, True, at)))


def fit(rows: DataFrame, stats: str = "stats", label: str = "label", trees: int = 20, depth: int = 3, penalty: float = 0.002, seed: int = 7) -> RuleEnsemble:
    """An ensemble from labelled rows (a bounded sample). Without rows of both labels: their smoothed share, and no rules."""
    from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
    from pyspark.ml.functions import array_to_vector

    n, good = rows.agg(F.count("*"), F.coalesce(F.sum(label), F.lit(0))).first()
    if not 0 < good < n:
        return RuleEnsemble(float(np.log((good + 1) / (n - good + 1))))
    whole = rows.select(F.col(label).cast("double").alias("label"), stats, array_to_vector(F.array(*(f"{stats}.{s}" for s in STATS))).alias("x"))
    forest = RandomForestClassifier(labelCol="label", featuresCol="x", numTrees=trees, maxDepth=depth, seed=seed, subsamplingRate=0.7).fit(whole)
    rules = list(dict.fromkeys(tuple(sorted(p)) for tree in forest.trees for p in _paths(tree._java_obj.rootNode())))
    held = whole.select("label", array_to_vector(F.array(*(F.expr(f"if({_holds(r, stats)}, 1D, 0D)") for r in rules))).alias("x"))
    lasso = LogisticRegression(labelCol="label", featuresCol="x", elasticNetParam=1.0, regParam=penalty, standardization=False, maxIter=40, tol=1e-4).fit(held)
    kept = [(r, float(w)) for r, w in zip(rules, lasso.coefficients.toArray()) if w]
    return RuleEnsemble(float(lasso.intercept), [r for r, _ in kept], [w for _, w in kept])


def held_out(id_col: str) -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0


def learn(stats: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = MAX_ROWS) -> RuleEnsemble:
    """Fits on labelled rows outside the held-out fifth: all of them, or an even sample of about `max_rows`.

    `stats` has doc_id and the struct column stats. Null labels and ids are left aside; of repeated
    labels of a document the highest counts.
    """
    marks = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).alias("label"))
    rows = stats.where(~held_out("doc_id")).join(marks, "doc_id")
    share = min(1.0, max_rows / max(1, rows.count()))
    sample = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000))
    sample, path = store.kept(sample.repartition(4, "doc_id").sortWithinPartitions("doc_id"), "sample")
    model = fit(sample)
    store.drop(sample.sparkSession, path)
    return model


def scored(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "quality", max_rows: int = MAX_ROWS) -> DataFrame:
    """One row per row of `docs`: doc_id, held_out, score, predicted.

    The score reads the text alone. Nulls and empty texts are scored like any other; a row without an
    id is not held out. Empty in, empty out. Repeated rows get the same score.
    """
    stats, _ = store.kept(docs.select(F.col(id_col).alias("doc_id"), stats_of(F.col(text_col).cast("string")).alias("stats")), "stats")
    model = learn(stats, labels, label, max_rows)
    return stats.select("doc_id", F.coalesce(held_out("doc_id"), F.lit(False)).alias("held_out"), model.score("stats").alias("score")).withColumn(
        "predicted", (F.col("score") >= CUT).cast("int"))


def passing(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "quality",
            max_rows: int = MAX_ROWS, cut: float = CUT) -> DataFrame:
    """The rows of `docs` with a score of at least `cut`, all columns as they are.

    Texts are read twice and never shuffled: once for the statistics to learn from, once to score.
    """
    own = "_stats"
    while own in docs.columns:
        own += "_"
    stats, _ = store.kept(docs.select(F.col(id_col).alias("doc_id"), stats_of(F.col(text_col).cast("string")).alias("stats")), "stats")
    model = learn(stats, labels, label, max_rows)
    return docs.withColumn(own, stats_of(F.col(text_col).cast("string"))).where(model.score(own) >= cut).drop(own)
