"""Ordered statistics that survive a hot key.

A plain ``Window.partitionBy(key).orderBy(x)`` sends every row of a key to one
task. Here each key is cut into ordered *segments*; rows are ordered inside
(key, segment) and a small table of per-segment totals carries the state from
one segment to the next. No task ever holds more than one segment of rows, and
the carried table is aggregated map-side first.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dyad.session import settle

SEGMENT = "__seg"
BLOCK_ROWS = 65_536
DAY = 86_400


def _before(keys: Sequence[str]):
    return (Window.partitionBy(*keys).orderBy(SEGMENT)
            .rowsBetween(Window.unboundedPreceding, -1))


def block_rows() -> int:
    return BLOCK_ROWS


def position_segment(position: str) -> Column:
    """Segment of a dense 0-based position."""
    return F.floor(F.col(position) / F.lit(block_rows())).cast("bigint")


def time_segment(seconds: str, width: int) -> Column:
    return F.floor(F.col(seconds) / F.lit(width)).cast("bigint")


def magnitude_segment(value: str | Column) -> Column:
    """Order-preserving coarse code of a number: 256 steps per power of two."""
    x = (F.col(value) if isinstance(value, str) else value).cast("double")
    code = F.greatest(F.floor(F.log2(F.abs(x)) * 256) + 300_000, F.lit(1))
    return F.when(x > 0, code).when(x < 0, -code).otherwise(F.lit(0)).cast("bigint")


def row_numbers(df: DataFrame, keys: Sequence[str], order: Sequence[Column],
                segment: Column, out: str = "rn") -> DataFrame:
    """Global ``row_number`` per key. `segment` must be monotone in `order`."""
    d = df.withColumn(SEGMENT, segment)
    sizes = d.groupBy(*keys, SEGMENT).agg(F.count("*").alias("__size"))
    offsets = sizes.select(*keys, SEGMENT,
                           F.coalesce(F.sum("__size").over(_before(keys)), F.lit(0)).alias("__off"))
    w = Window.partitionBy(*keys, SEGMENT).orderBy(*order)
    return (d.withColumn("__rn", F.row_number().over(w))
            .join(offsets, [*keys, SEGMENT])
            .withColumn(out, (F.col("__rn") + F.col("__off")).cast("bigint"))
            .drop("__rn", "__off", SEGMENT))


_FOLD = {
    "sum": (F.sum, lambda c, loc: F.coalesce(c, F.lit(0)) + F.coalesce(loc, F.lit(0))),
    "max": (F.max, lambda c, loc: F.greatest(c, loc)),
    "min": (F.min, lambda c, loc: F.least(c, loc)),
}


def running(df: DataFrame, keys: Sequence[str], order: Sequence[str],
            columns: dict[str, tuple[str, Column]], position: str | None = None,
            segment: Column | None = None, cut: Sequence[str] | None = None, short: bool = False) -> DataFrame:
    """Statistics over the rows of the key strictly before the current one.

    `columns` maps an output name to (kind, value) with kind one of ``sum``,
    ``max``, ``min`` or ``last`` (last non-null). With `position` (dense from 0
    inside `cut`, a subset of the keys) only keys longer than one segment need
    the carried table; on ordinary data that side is empty. `short` says that no key is longer
    (see `all_short`): then windows over whole keys do, and rows already dealt out by key stay.
    """
    if short:
        w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        return df.withColumns({
            name: F.last(v, True).over(w) if kind == "last"
            else F.coalesce(F.sum(v).over(w), F.lit(0)) if kind == "sum" else _FOLD[kind][0](v).over(w)
            for name, (kind, v) in columns.items()})
    seg = segment if segment is not None else position_segment(position)
    d = df.withColumn(SEGMENT, seg)
    values = {f"__v_{name}": value for name, (_, value) in columns.items()}
    d = d.withColumns(values)
    cut = list(cut or keys)
    part = cut + [SEGMENT] + [k for k in keys if k not in cut]
    w = (Window.partitionBy(*part).orderBy(*order)
         .rowsBetween(Window.unboundedPreceding, -1))
    pick = F.struct(*[F.col(o) for o in order])

    source = d
    if position is not None:
        hot = df.where(F.col(position) >= block_rows()).select(*cut).distinct()
        source = d.join(hot, cut, "left_semi")
    totals, carry, local = [], [], {}
    for name, (kind, _) in columns.items():
        v = F.col(f"__v_{name}")
        if kind == "last":
            totals.append(F.max_by(v, F.when(v.isNotNull(), pick)).alias(f"__t_{name}"))
            carry.append(F.last(F.col(f"__t_{name}"), True).over(_before(keys)).alias(f"__c_{name}"))
            local[f"__l_{name}"] = F.last(v, True).over(w)
        else:
            totals.append(_FOLD[kind][0](v).alias(f"__t_{name}"))
            carry.append(_FOLD[kind][0](F.col(f"__t_{name}")).over(_before(keys)).alias(f"__c_{name}"))
            local[f"__l_{name}"] = _FOLD[kind][0](v).over(w)
    carried = (source.groupBy(*keys, SEGMENT).agg(*totals).select(*keys, SEGMENT, *carry)
               .where(F.greatest(*[F.col(f"__c_{n}").isNotNull() for n in columns], F.lit(False))))
    joined = d.withColumns(local).join(carried, [*keys, SEGMENT], "left")
    out = {}
    for name, (kind, _) in columns.items():
        c, loc = F.col(f"__c_{name}"), F.col(f"__l_{name}")
        out[name] = F.coalesce(loc, c) if kind == "last" else _FOLD[kind][1](c, loc)
    drop = [SEGMENT, *values, *local, *[f"__c_{n}" for n in columns]]
    return joined.withColumns(out).drop(*drop)


def all_short(df: DataFrame, position: str) -> bool:
    """Whether no key is longer than one segment."""
    return df.where(F.col(position) >= block_rows()).isEmpty()


def neighbourhood(df: DataFrame, keys: Sequence[str], rn: str, reach: int,
                  columns: Callable[[Callable[[int, int], Window]], dict[str, Column]],
                  rows: int | None = None) -> DataFrame:
    """Bounded-frame windows (lag, lead, centred frames) over a 1-based position.

    Each key is cut into blocks of `rows` positions; the `reach` rows next to a
    border are copied into the neighbouring block, so every frame is complete
    inside one block. `columns` receives a function (from, to) -> window.
    """
    rows = rows or block_rows()
    i = F.col(rn) - 1
    home = F.floor(i / rows).cast("bigint")
    inside = i - home * rows
    targets = F.array_compact(F.array(
        home,
        F.when((inside < reach) & (home > 0), home - 1),
        F.when(inside >= rows - reach, home + 1)))
    copies = (df.withColumn("__home", home)
              .withColumn(SEGMENT, F.explode(targets)))
    base = Window.partitionBy(*keys, SEGMENT).orderBy(rn)
    frame = lambda a, b: base.rowsBetween(a, b)
    return (copies.withColumns(columns(frame)).where(F.col("__home") == F.col(SEGMENT))
            .drop("__home", SEGMENT))


def melt(df: DataFrame, keep: Sequence[str], columns: Sequence[str],
         name: str = "signal", value: str = "x") -> DataFrame:
    """Wide to long, null values dropped."""
    pairs = ", ".join(f"'{c}', cast(`{c}` as double)" for c in columns)
    return (df.select(*keep, F.expr(f"stack({len(columns)}, {pairs}) as ({name}, {value})"))
            .where(F.col(value).isNotNull()))


def value_ranks(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """One row per (key, distinct value): ``below`` smaller rows, ``ties`` equal ones, ``n`` in all."""
    seen = (df.where(F.col(value).isNotNull()).groupBy(*keys, value)
            .agg(F.count("*").alias("ties"))
            .withColumn(SEGMENT, magnitude_segment(value)))
    coarse = seen.groupBy(*keys, SEGMENT).agg(F.sum("ties").alias("__size"))
    offsets = coarse.select(*keys, SEGMENT,
                            F.coalesce(F.sum("__size").over(_before(keys)), F.lit(0)).alias("__off"),
                            F.sum("__size").over(Window.partitionBy(*keys)).alias("n"))
    w = (Window.partitionBy(*keys, SEGMENT).orderBy(value)
         .rowsBetween(Window.unboundedPreceding, -1))
    return (seen.withColumn("__in", F.coalesce(F.sum("ties").over(w), F.lit(0)))
            .join(offsets, [*keys, SEGMENT])
            .withColumn("below", F.col("__in") + F.col("__off"))
            .drop("__in", "__off", SEGMENT))


def ident_segment(df: DataFrame, ident: str, prefix: int = 6) -> Column:
    """Order-preserving coarse code of an identifier, by magnitude or by leading characters."""
    if dict(df.dtypes)[ident] == "string":
        return F.substring(F.col(ident), 1, prefix)
    return magnitude_segment(ident)


def ordinal_ranks(df: DataFrame, keys: Sequence[str], value: str, ident: str, out: str) -> DataFrame:
    """1-based rank by (value desc, ident asc), nulls left unranked.

    Smaller values are counted on distinct values, then ties are numbered by
    ident, so neither many rows nor one very common value meets a single task.
    """
    d = df.withColumn("__neg", -F.col(value))
    below = value_ranks(d, keys, "__neg").select(*keys, "__neg", "below")
    tied = row_numbers(d.where(F.col("__neg").isNotNull()), [*keys, "__neg"], [F.col(ident)],
                       ident_segment(d, ident), "__in")
    return (tied.join(below, [*keys, "__neg"])
            .withColumn(out, (F.col("below") + F.col("__in")).cast("bigint")).drop("below", "__in", "__neg"))


def percentiles(df: DataFrame, keys: Sequence[str], ident: Sequence[str],
                columns: Sequence[str], prefix: str = "pct_", keep: Sequence[str] = (), short: bool = False) -> DataFrame:
    """Average rank divided by the row count of the key, for many columns at once.

    Returns `ident` (which must identify a row, and include the keys) and `keep` plus one
    percentile per column; a null value has a null percentile. Keys of up to a block of rows are
    ranked side by side where their rows lie; only longer ones are counted by distinct values.
    `short` says that no key is longer: then nothing is written, and rows already dealt out by key stay.
    """
    ident = list(ident)
    kept = [c for c in keep if c not in ident]
    if short:
        return _ranked_together(df, keys, [*ident, *kept], columns, prefix)
    d = settle(df.select(*ident, *kept, *[c for c in columns if c not in ident and c not in kept]))
    long_keys = d.groupBy(*keys).agg(F.count("*").alias("__n")).where(F.col("__n") > block_rows()).select(*keys)
    if long_keys.isEmpty():
        return _ranked_together(d, keys, [*ident, *kept], columns, prefix)
    long_keys = F.broadcast(long_keys)  # at most one key in a block of rows
    short = _ranked_together(d.join(long_keys, list(keys), "left_anti"), keys, [*ident, *kept], columns, prefix)
    return short.unionByName(_ranked_by_value(d.join(long_keys, list(keys), "left_semi"), keys, ident, kept, columns, prefix))


def _ranked_together(df: DataFrame, keys: Sequence[str], keep: Sequence[str], columns: Sequence[str], prefix: str) -> DataFrame:
    """Percentiles from windows over whole keys, which share one shuffle."""
    every = Window.partitionBy(*keys)
    n, out = F.count("*").over(every), {}
    for c in columns:
        x = F.col(c).cast("double")
        order = every.orderBy(x.asc_nulls_last())
        ties = F.count("*").over(order.rangeBetween(Window.currentRow, Window.currentRow))
        out[f"{prefix}{c}"] = F.when(x.isNotNull(), (F.rank().over(order) - 1 + (ties + 1) / 2.0) / n)
    return df.select(*keep, *[v.alias(k) for k, v in out.items()])


def _ranked_by_value(df: DataFrame, keys: Sequence[str], ident: Sequence[str], keep: Sequence[str], columns: Sequence[str],
                     prefix: str) -> DataFrame:
    """The same from counts of distinct values, which no long key brings to one task."""
    long = melt(df, ident, columns)
    ranks = value_ranks(long, [*keys, "signal"], "x").drop("n")
    n = df.groupBy(*keys).agg(F.count("*").alias("__n"))
    scored = (long.join(ranks, [*keys, "signal", "x"]).join(n, list(keys))
              .withColumn("pct", (F.col("below") + (F.col("ties") + 1) / 2.0) / F.col("__n")))
    wide = scored.groupBy(*ident).agg(
        *[F.max(F.when(F.col("signal") == c, F.col("pct"))).alias(f"{prefix}{c}") for c in columns])
    return df.select(*ident, *keep).join(wide, list(ident), "left")


def order_values(df: DataFrame, keys: Sequence[str], value: str,
                 positions: dict[str, tuple[Column, Column]]) -> DataFrame:
    """Exact order statistics per key without collecting the group.

    `positions` maps an output to two 0-based positions (as expressions of the
    non-null count ``n``) whose values are averaged.
    """
    hit = value_ranks(df, keys, value)
    inside = lambda p: (F.col("below") <= p) & (p < F.col("below") + F.col("ties"))
    wanted = F.lit(False)
    for a, b in positions.values():
        wanted = wanted | inside(a) | inside(b)
    aggs = []
    for name, (a, b) in positions.items():
        aggs.append(((F.max(F.when(inside(a), F.col(value))) + F.max(F.when(inside(b), F.col(value)))) / 2.0)
                    .alias(name))
    return hit.where(wanted).groupBy(*keys).agg(*aggs)


def median_positions() -> tuple[Column, Column]:
    n = F.col("n")
    return F.floor((n - 1) / 2), F.ceil((n - 1) / 2)


def nearest_positions(q: float) -> tuple[Column, Column]:
    """Nearest-rank quantile: element round(q * (n - 1))."""
    p = F.floor(F.lit(q) * (F.col("n") - 1) + F.lit(0.5))
    return p, p


def medians(df: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    return order_values(df, keys, value, {out: median_positions()})


def top_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int,
             out: str = "rank") -> DataFrame:
    """The k first rows per key; Spark trims each map partition to k rows per key first."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(out, F.row_number().over(w)).where(F.col(out) <= k)


def top_means(df: DataFrame, keys: Sequence[str],
              columns: dict[str, tuple[str, int]]) -> DataFrame:
    """Mean of the k largest values per key, for many (column, k) at once."""
    sources = sorted({c for c, _ in columns.values()})
    most = max(k for _, k in columns.values())
    long = top_rows(melt(df, keys, sources), [*keys, "signal"], [F.col("x").desc()], most)
    return long.groupBy(*keys).agg(*[
        F.avg(F.when((F.col("signal") == c) & (F.col("rank") <= k), F.col("x"))).alias(name)
        for name, (c, k) in columns.items()])


def with_totals(df: DataFrame, keys: Sequence[str], **aggs: Column) -> DataFrame:
    """Group totals joined back; the aggregate is combined map-side before it is shuffled."""
    totals = df.groupBy(*keys).agg(*[a.alias(n) for n, a in aggs.items()])
    return df.join(totals, list(keys))


def minus_own(df: DataFrame, all_keys: Sequence[str], columns: Sequence[str],
              prefix: str = "rest_") -> DataFrame:
    """The total over `all_keys` with the row's own share taken out."""
    totals = df.groupBy(*all_keys).agg(*[F.sum(c).alias(f"__all_{c}") for c in columns])
    return (df.join(totals, list(all_keys))
            .withColumns({f"{prefix}{c}": F.col(f"__all_{c}") - F.col(c) for c in columns})
            .drop(*[f"__all_{c}" for c in columns]))


def duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once."""
    return df.groupBy(*keys).agg(F.count("*").alias("copies")).where(F.col("copies") > 1)


def assert_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Fails the job when a key repeats, without a separate pass by the driver.

    Every row carries its key's copy count, and the plan raises on the first one
    above one.
    """
    n = df.groupBy(*keys).agg(F.count("*").alias("__copies"))
    guard = F.when(F.col("__copies") > 1,
                   F.raise_error(F.concat(F.lit("duplicate key: "), F.concat_ws(",", *keys)))
                   .cast("boolean")).otherwise(F.lit(True))
    return df.join(n, list(keys)).where(guard).drop("__copies")
