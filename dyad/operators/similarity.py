"""Standardised feature space, exact nearest references, self-consistency of a pair."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dyad.functions.cols import md5_key
from dyad.functions.ordered import magnitude_segment, melt, order_values, row_numbers, top_rows
from dyad.operators.pairs import PAIR
from dyad.session import carried, settle

carried(__name__)


def fit_standardiser(df: DataFrame, columns: list[str]) -> DataFrame:
    """Means and deviations of the fit rows: a single row."""
    return df.agg(*[F.avg(F.coalesce(F.col(c), F.lit(0))).alias(f"mu_{c}") for c in columns],
                  *[F.stddev_pop(F.coalesce(F.col(c), F.lit(0))).alias(f"sd_{c}") for c in columns])


def apply_standardiser(df: DataFrame, moments: DataFrame, columns: list[str]) -> DataFrame:
    d = df.join(F.broadcast(moments))
    scale = {c: F.when(F.col(f"sd_{c}") < 1e-9, 1.0).otherwise(F.col(f"sd_{c}")) for c in columns}
    return d.withColumns({f"z_{c}": (F.coalesce(F.col(c), F.lit(0)) - F.col(f"mu_{c}")) / scale[c]
                          for c in columns}).drop(*[f"{p}_{c}" for c in columns for p in ("mu", "sd")])


def fit_winsoriser(df: DataFrame, columns: list[str], low: float = 0.001, high: float = 0.999) -> DataFrame:
    """Clip limits and the imputing median of the fit rows: a single row."""
    n1 = F.col("n") - 1

    def at(q: float) -> tuple[Column, Column]:
        i = F.floor(F.lit(q) * n1 + F.lit(0.5))
        return i, i

    limits = order_values(melt(df, [], columns), ["signal"], "x", {
        "lo": at(low), "hi": at(high), "med": (F.floor(n1 / 2), F.ceil(n1 / 2))})
    return limits.agg(*[F.max(F.when(F.col("signal") == c, F.col(m))).alias(f"{m}_{c}")
                        for c in columns for m in ("lo", "hi", "med")])


def apply_winsoriser(df: DataFrame, limits: DataFrame, columns: list[str]) -> DataFrame:
    d = df.join(F.broadcast(limits))
    return d.withColumns({
        f"w_{c}": F.least(F.greatest(F.coalesce(F.col(c).cast("double"), F.col(f"med_{c}")), F.col(f"lo_{c}")),
                          F.col(f"hi_{c}")) for c in columns
    }).drop(*[f"{p}_{c}" for c in columns for p in ("lo", "hi", "med")])


def distance(a: Column, b: Column, dims: int | None = None) -> Column:
    """Euclidean distance of two arrays; with `dims` it is spelled out, so it compiles."""
    if dims is not None:
        total = F.lit(0.0)
        for i in range(dims):
            gap = F.get(a, F.lit(i)) - F.get(b, F.lit(i))
            total = total + gap * gap
        return F.sqrt(total)
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0),
                              lambda acc, d: acc + d))


# References per shard of a pivot cell, and queries that meet them in one group.
SHARD_ROWS = 20_000
QUERY_ROWS = 16_384
# What rounding may add to a squared distance, per unit of squared length.
ROUNDING = 1e-12


def _distances(q: np.ndarray, r: np.ndarray, row: np.ndarray, col: np.ndarray) -> np.ndarray:
    """`distance` of the named rows, its terms added in the same order."""
    total = np.zeros(len(row))
    for i in range(q.shape[1]):
        gap = q[:, i][row] - r[:, i][col]
        total += gap * gap
    return np.sqrt(total)


def _best_of_group(k: int) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    """The k nearest references of a cogroup for every query of it, ties to the smaller reference.

    A matrix product rules most pairs out; what is within its rounding of the k-th distance is computed as `distance` does.
    Queries with ``theta`` (a bound of the k-th distance) and coordinates ``y`` skip cells of references that lie beyond it.
    """
    def best(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        bounded = "theta" in left
        if not len(left) or not len(right):
            return pd.DataFrame({"qkey": left["qkey"].iloc[:0], "ref": right["ref"].iloc[:0], "dist": np.zeros(0)})
        right = right.sort_values(["cell", "ref"] if bounded else "ref")
        if bounded:
            left = left.sort_values("y", key=lambda ys: ys.map(lambda y: y[1]))
            y, ry, theta = np.stack(left["y"]), np.stack(right["y"]), left["theta"].to_numpy()
            cell = right["cell"].to_numpy()
            start = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
            sizes = np.diff(np.r_[start, len(cell)])
            low, high = np.minimum.reduceat(ry, start), np.maximum.reduceat(ry, start)
        fold = pd.factorize(pd.concat([left["q_fold"], right["fold"]]))[0]
        q_fold, fold = fold[:len(left)], fold[len(left):]
        q, r, keys, ids = np.stack(left["vec"]), np.stack(right["rvec"]), left["qkey"].to_numpy(), right["ref"].to_numpy()
        rank = np.argsort(np.argsort(ids, kind="stable"), kind="stable")
        q_square, r_square = (q * q).sum(1), (r * r).sum(1)
        slack = ROUNDING * (q_square.max() + r_square.max())
        found = []
        for i in range(0, len(q), 512):
            at = slice(i, i + 512)
            cols = np.arange(len(r))
            if bounded:
                beyond = np.maximum(np.maximum(low - y[at].max(0), y[at].min(0) - high), 0)
                cols = np.flatnonzero(np.repeat((beyond * beyond).sum(1) <= theta[at].max() ** 2 + slack, sizes))
            apart = q_square[at, None] + r_square[cols] - 2 * (q[at] @ r[cols].T)
            apart[q_fold[at, None] == fold[cols]] = np.inf
            some = apart[:, ::max(1, len(cols) // 2048)]
            limit = np.partition(some, k - 1, axis=1)[:, k - 1] if some.shape[1] > k else np.full(len(apart), np.inf)
            if bounded:
                limit = np.minimum(limit, theta[at] ** 2)
            row, col = np.nonzero((apart <= limit[:, None] + slack) & np.isfinite(apart))
            col = cols[col]
            dist = _distances(q[at], r, row, col)
            order = np.lexsort((rank[col], dist, row))
            row, col, dist = row[order], col[order], dist[order]
            first = np.arange(len(row)) - np.searchsorted(row, row) < k
            found.append(pd.DataFrame({"qkey": keys[at][row[first]], "ref": ids[col[first]], "dist": dist[first]}))
        return pd.concat(found)
    return best


def nearest_in_groups(queries: DataFrame, refs: DataFrame, keys: list[str], k: int) -> DataFrame:
    """(qkey, ref, dist): the k nearest references of other folds, for every query and every group of `keys` it stands in.

    `queries` has qkey, q_fold and vec, `refs` has ref, fold and rvec, vectors as doubles. Pairs are compared in blocks: no row is made
    for a pair that is not among the k best of its group.
    """
    kinds = f"qkey {dict(queries.dtypes)['qkey']}, ref {dict(refs.dtypes)['ref']}, dist double"
    q, r = queries.where("q_fold is not null"), refs.where("fold is not null")
    return q.groupBy(*keys).cogroup(r.groupBy(*keys)).applyInPandas(_best_of_group(k), kinds)


def parts_of(n: int) -> int:
    """Parts in which n queries meet a block of references."""
    return max(1, -(-n // QUERY_ROWS))


def nearest_references(queries: DataFrame, refs: DataFrame, k: int, pivots: int = 16,
                       shard_rows: int = SHARD_ROWS) -> DataFrame:
    """The k nearest references of every query, exactly, without an all-pairs join.

    Both sides have ``id``, ``vec`` and ``fold``; a query never sees references of
    its own fold. References are filed under their nearest pivot. From per-cell
    summaries (a number of rows bounded by pivots x folds) each query gets an
    upper bound on its k-th distance, visits only cells that the triangle
    inequality cannot rule out, where queries and references meet block by block.
    A crowded cell is cut into shards so that it spreads over several tasks.
    """
    spark = refs.sparkSession
    as_double = F.transform("vec", lambda v: v.cast("double"))
    q = queries.select("id", F.col("fold").alias("q_fold"), as_double.alias("vec"))
    r = refs.select(F.col("id").alias("ref"), "fold", as_double.alias("rvec"))
    # A fixed number of pivots: bounded by `pivots`, whatever the size of the data.
    chosen = [row["rvec"] for row in r.orderBy(md5_key("ref"), "ref").limit(pivots).collect()]
    one_row = spark.createDataFrame([(chosen,)], "centres array<array<double>>")

    def to_pivots(v: str) -> Column:
        return F.transform("centres", lambda c: distance(c, F.col(v)))

    r = r.join(F.broadcast(one_row)).withColumn("dp", to_pivots("rvec")).drop("centres")
    r = r.withColumns({"cell": F.array_position("dp", F.array_min("dp")).cast("int") - 1,
                       "to_pivot": F.array_min("dp")}).drop("dp")
    folds = r.groupBy("cell", "fold").agg(F.max("to_pivot").alias("radius"), F.count("*").alias("n"))
    sizes = folds.groupBy("cell").agg(F.greatest(F.ceil(F.sum("n") / F.lit(shard_rows)), F.lit(1)).cast("int").alias("shards"))
    # At most pivots x folds entries in one row.
    cells = folds.join(F.broadcast(sizes), "cell").agg(
        F.collect_list(F.struct("cell", "fold", "radius", "n", "shards")).alias("cells"))
    d = (q.join(F.broadcast(one_row)).withColumn("dq", to_pivots("vec")).drop("centres")
         .join(F.broadcast(cells)))
    visible = F.filter("cells", lambda c: c["fold"] != F.col("q_fold"))
    # A cell-and-fold with at least k references bounds the k-th distance by the far side of its ball.
    bounds = F.transform(F.filter(visible, lambda c: c["n"] >= k),
                         lambda c: F.element_at(F.col("dq"), c["cell"] + 1) + c["radius"])
    d = d.withColumn("theta", F.coalesce(F.array_min(bounds), F.lit(float("inf"))) + F.lit(1e-9))
    reach = F.array_distinct(F.transform(
        F.filter(visible, lambda c: F.element_at(F.col("dq"), c["cell"] + 1) - c["radius"] <= F.col("theta")),
        lambda c: F.struct(c["cell"].alias("cell"), c["shards"].alias("shards"))))
    d = d.select("id", "q_fold", "vec", "dq", "theta", F.explode(reach).alias("c"))
    d = d.select("id", "q_fold", "vec", "theta", F.col("c.cell").alias("cell"),
                 F.element_at("dq", F.col("c.cell") + 1).alias("q_pivot"),
                 F.explode(F.sequence(F.lit(0), F.col("c.shards") - 1)).alias("shard"))
    filed = r.join(F.broadcast(sizes), "cell").select(
        "ref", "fold", "rvec", "cell", "to_pivot", F.pmod(F.xxhash64("ref"), F.col("shards")).cast("int").alias("shard"))
    parts = parts_of(queries.count())
    left = d.select(F.col("id").alias("qkey"), "q_fold", "vec", "cell", "shard", F.pmod(F.xxhash64("id", F.lit("part")), F.lit(parts)).alias("part"))
    right = filed.select("ref", "fold", "rvec", "cell", "shard", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(parts - 1).cast("bigint"))).alias("part"))
    near = nearest_in_groups(left, right, ["cell", "shard", "part"], k).withColumnRenamed("qkey", "id")
    return top_rows(near, ["id"], [F.col("dist"), F.col("ref")], k)


def knn_mean_distance(queries: DataFrame, refs: DataFrame, k: int = 5, **options) -> DataFrame:
    """Mean distance of each query to its k nearest references from other folds."""
    return nearest_references(queries, refs, k, **options).groupBy("id").agg(
        F.avg("dist").alias("mean_dist"), F.min("dist").alias("min_dist"), F.count("*").alias("k_found"))


def pair_consistency(hs: DataFrame, space: list[str], top: int = 20) -> DataFrame:
    """How much a hand looks like the best other hands of its pair. Every hand has a row.

    Distances are taken among the `top` best hands, closer to the front counting more; further hands
    have similarity zero. `type_agree` is the weight of all hands of the pair with the hand's event.
    `hs` has ``score`` and ``type_a`` (0/1) besides the space columns.
    """
    ranked = row_numbers(hs.withColumn("__neg", -F.col("score")), PAIR, [F.col("__neg"), F.col("hand_id")], magnitude_segment("__neg"), "rank")
    ranked = settle(ranked.select(*PAIR, "hand_id", "rank", "type_a", F.array(*[F.col(c) for c in space]).alias("v")))
    best = ranked.where(F.col("rank") <= top)
    other = best.select(*PAIR, F.col("hand_id").alias("o_hand"), F.col("rank").alias("o_rank"),
                        F.col("v").alias("o_v"))
    couples = best.join(other, PAIR).where(F.col("hand_id") != F.col("o_hand"))
    w = F.lit(1.0) / F.col("o_rank")
    sim = -distance(F.col("v"), F.col("o_v"))
    stats = couples.groupBy(*PAIR, "hand_id").agg(
        (F.sum(sim * w) / F.sum(w)).alias("sim_mean"), F.max(sim).alias("sim_max"))
    dominant = ranked.groupBy(*PAIR).agg(F.sum(F.col("type_a") / F.col("rank")).alias("dominant"))
    return (ranked.join(stats, [*PAIR, "hand_id"], "left").join(dominant, PAIR)
            .select(*PAIR, "hand_id", "rank", F.coalesce("sim_mean", F.lit(0.0)).alias("sim_mean"),
                    F.coalesce("sim_max", F.lit(0.0)).alias("sim_max"),
                    (F.col("type_a") * F.col("dominant")).alias("type_agree")))
