"""Exact nearest references by lower bounds on leading principal coordinates.

Two vectors are at least as far apart as their leading coordinates and the lengths of what is left
of them. References are filed in cells of a few hundred rows: slices of the first coordinate, each
cut along the second, so their number grows with the references. A query first meets its own cell, which bounds its
k-th distance, then the slices within the bound, and there only cells whose box the bound
does not rule out; references and queries of a slice meet block by block. Equal vectors are one query, and of equal references of one fold no more than
k can be among the k nearest, so very common vectors cost nothing.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dyad.functions.ordered import top_rows
from dyad.operators.similarity import distance, nearest_in_groups, parts_of
from dyad.session import settle

CELL_ROWS = 256
AXES = 4
SLACK = 1e-9


def axes(refs: DataFrame, k: int) -> tuple[list[float], list[list[float]]]:
    """Mean and k leading principal directions of the vectors; what the driver holds is the vector's size times k."""
    v = refs.select(array_to_vector("vec").alias("features"))
    mean = v.select(Summarizer.mean(F.col("features"))).first()[0].toArray()
    pc = PCA(k=k, inputCol="features", outputCol="out").fit(v).pc.toArray()
    return mean.tolist(), np.ascontiguousarray(pc.T).tolist()


def with_coordinates(df: DataFrame, mean: list[float], directions: list[list[float]]) -> DataFrame:
    """`df` with ``y``: coordinates along the directions, then the length of the rest."""
    d = len(mean)
    own = [F.get("vec", F.lit(i)) - F.lit(mean[i]) for i in range(d)]

    def along(direction: list[float]) -> Column:
        total = F.lit(0.0)
        for c, x in zip(direction, own):
            total = total + x * F.lit(c)
        return total
    square = F.lit(0.0)
    for x in own:
        square = square + x * x
    out = df.withColumns({"__sq": square, **{f"__y{j}": along(p) for j, p in enumerate(directions)}})
    rest = F.col("__sq") - sum((F.col(f"__y{j}") * F.col(f"__y{j}") for j in range(len(directions))), F.lit(0.0))
    y = F.array(*[F.col(f"__y{j}") for j in range(len(directions))], F.sqrt(F.greatest(rest, F.lit(0.0))))
    return out.withColumn("y", y).drop("__sq", *[f"__y{j}" for j in range(len(directions))])


def _place(value: Column, bounds: Column) -> Column:
    """How many bounds a value exceeds."""
    return F.size(F.filter(bounds, lambda b: b < value))


def file_references(refs: DataFrame, cell_rows: int) -> tuple[DataFrame, DataFrame, list[float]]:
    """References with slice and cell, the second-level bounds of every slice, and the slices' bounds."""
    n = refs.count()
    slices = max(1, int(np.ceil(np.sqrt(n / cell_rows))))
    first = []
    if slices > 1:
        cuts = [i / slices for i in range(1, slices)]
        first = sorted(set(refs.agg(F.percentile_approx(F.get("y", F.lit(0)), cuts, 10_000)).first()[0]))  # as many as the root of the cells
    sliced = refs.withColumn("slice", _place(F.get("y", F.lit(0)), F.lit(first).cast("array<double>")))
    cuts = [i / slices for i in range(1, slices)] or [0.5]
    second = sliced.groupBy("slice").agg(F.percentile_approx(F.get("y", F.lit(1)), cuts, 10_000).alias("bounds"))
    second = settle(second)
    return settle(sliced.join(second, "slice").withColumn("cell", _place(F.get("y", F.lit(1)), F.col("bounds"))).drop("bounds")), second, first


def boxes(filed: DataFrame, width: int) -> DataFrame:
    """Smallest and largest coordinates of every cell."""
    ends = [f(F.get("y", F.lit(j))).alias(f"{n}{j}") for j in range(width) for n, f in (("lo", F.min), ("hi", F.max))]
    b = filed.groupBy("slice", "cell").agg(*ends)
    return b.select("slice", "cell", F.array(*[F.col(f"lo{j}") for j in range(width)]).alias("lo"), F.array(*[F.col(f"hi{j}") for j in range(width)]).alias("hi"))


def _to_box(y: Column, lo: Column, hi: Column, width: int) -> Column:
    total = F.lit(0.0)
    for j in range(width):
        v = F.get(y, F.lit(j))
        gap = F.greatest(F.get(lo, F.lit(j)) - v, v - F.get(hi, F.lit(j)), F.lit(0.0))
        total = total + gap * gap
    return F.sqrt(total)


def _placed(queries: DataFrame, refs: DataFrame, k: int, axis_count: int, cell_rows: int) -> tuple[DataFrame, DataFrame, DataFrame, list[float]]:
    """Queries with a bound ``theta`` of their k-th distance, filed references, the best of the own cells, and the slices' bounds."""
    size = len(refs.select("vec").first()[0])
    width = min(axis_count, size) + 1
    mean, directions = axes(refs, width - 1)
    filed, second, first = file_references(settle(with_coordinates(refs.select(F.col("id").alias("ref"), "fold", "vec"), mean, directions)), cell_rows)
    q = with_coordinates(queries, mean, directions).withColumn("slice", _place(F.get("y", F.lit(0)), F.lit(first).cast("array<double>")))
    q = settle(q.join(second, "slice", "left").withColumn("cell", F.coalesce(_place(F.get("y", F.lit(1)), F.col("bounds")), F.lit(0))).drop("bounds"))
    home = settle(nearest_in_groups(q.select("qkey", F.col("fold").alias("q_fold"), "vec", "slice", "cell"),
                                    filed.select("ref", "fold", F.col("vec").alias("rvec"), "slice", "cell"), ["slice", "cell"], k))
    reach = home.groupBy("qkey").agg(F.max("dist").alias("__far"), F.count("*").alias("__n"))
    q = q.join(reach, "qkey", "left").withColumn("theta", F.when(F.col("__n") >= k, F.col("__far") * (1 + SLACK) + SLACK).otherwise(float("inf")))
    return q.drop("__far", "__n"), filed, home, first


def _slices_in_reach(q: DataFrame, first: list[float]) -> DataFrame:
    """A row for every slice of references within a query's bound, as ``__slice``."""
    bounds, y0 = F.lit(first).cast("array<double>"), F.get("y", F.lit(0))
    return q.withColumn("__slice", F.explode(F.sequence(_place(y0 - F.col("theta"), bounds), _place(y0 + F.col("theta"), bounds))))


def candidates(queries: DataFrame, refs: DataFrame, k: int, axis_count: int = AXES, cell_rows: int = CELL_ROWS) -> tuple[DataFrame, DataFrame]:
    """Pairs of distinct queries and references that the bounds leave: (the best of the own cell; those outside), with their distance.

    Columns qkey, ref, dist. Both sides have ``id``, ``vec`` (doubles), ``fold``, ``qkey`` the query class.
    """
    q, filed, home, first = _placed(queries, refs, k, axis_count, cell_rows)
    size = len(refs.select("vec").first()[0])
    width = min(axis_count, size) + 1
    right = filed.select("slice", "cell", "ref", F.col("fold").alias("r_fold"), F.col("vec").alias("rvec"), F.col("y").alias("ry"))
    cells = boxes(filed, width).select(F.col("slice").alias("__slice"), F.col("cell").alias("__cell"), "lo", "hi")
    away = _slices_in_reach(q, first).join(cells, "__slice").where(((F.col("__slice") != F.col("slice")) | (F.col("__cell") != F.col("cell"))) & (_to_box(F.col("y"), F.col("lo"), F.col("hi"), width) <= F.col("theta")))
    away = away.select("qkey", "fold", "vec", "y", "theta", F.col("__slice").alias("slice"), F.col("__cell").alias("cell"))
    near = away.join(right, ["slice", "cell"]).where((F.col("fold") != F.col("r_fold")) & (distance(F.col("y"), F.col("ry"), width) <= F.col("theta")))
    return home.select("qkey", "ref", "dist"), near.select("qkey", "ref", distance(F.col("vec"), F.col("rvec"), size).alias("dist"))


def nearest_by_axes(queries: DataFrame, refs: DataFrame, k: int, axis_count: int = AXES, cell_rows: int = CELL_ROWS) -> DataFrame:
    """(id, ref, dist, rank): the k nearest references of other folds for every query, ties to the smaller id.

    Both sides have ``id``, ``vec`` and ``fold``. All vectors have one length, none is null. Without references no rows.
    """
    if refs.isEmpty():
        return queries.sparkSession.createDataFrame([], f"id {dict(queries.dtypes)['id']}, ref {dict(refs.dtypes)['id']}, dist double, rank int")
    vec = F.transform("vec", lambda v: v.cast("double")).alias("vec")
    q = settle(queries.select("id", "fold", vec).withColumn("qkey", F.sha2(F.concat_ws(",", F.col("fold").cast("string"), F.col("vec").cast("string")), 256)))
    r = refs.select("id", "fold", vec)
    few = top_rows(r.withColumn("__v", F.sha2(F.col("vec").cast("string"), 256)), ["fold", "__v"], [F.col("id")], k, "__i").select("id", "fold", "vec")
    distinct = q.groupBy("qkey").agg(F.first("fold").alias("fold"), F.first("vec").alias("vec"))
    placed, filed, _, first = _placed(distinct, settle(few), k, axis_count, cell_rows)
    parts = parts_of(q.count())
    left = _slices_in_reach(placed, first).select("qkey", F.col("fold").alias("q_fold"), "vec", "y", "theta", F.col("__slice").alias("slice"),
                                                  F.floor(F.pmod(F.xxhash64("qkey"), F.lit(parts))).cast("int").alias("part"))
    right = filed.select("ref", "fold", F.col("vec").alias("rvec"), "y", "slice", "cell", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
    # A slice is compared whole with the part of the queries that reach it; cells beyond their bounds are passed over there.
    best = top_rows(nearest_in_groups(left, right, ["slice", "part"], k), ["qkey"], [F.col("dist"), F.col("ref")], k)
    return q.select("id", "qkey").join(best, "qkey").select("id", "ref", "dist", "rank")
