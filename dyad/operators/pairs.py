"""Pairs of actors present in the same hand."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dyad.functions.cols import as_int, md5_key

PAIR = ["phase", "table_id", "p1", "p2"]
MIN_SHARED = 38
# Seats per block when one hand is cut for the pair join.
BLOCK_SEATS = 512
CELL = ["__r", "__c"]


def cell_count(rows: DataFrame, group: list[str], block: int = BLOCK_SEATS) -> DataFrame:
    """Cells along each side of a group's pair join (``__cells``), one for an ordinary group."""
    return rows.groupBy(*group).agg(F.ceil(F.count("*") / F.lit(block)).cast("int").alias("__cells"))


def cut_cells(side: DataFrame, who: str, own: str, other: str) -> DataFrame:
    """A side of the pair join with its cells; needs ``__cells``."""
    return (side.withColumn(own, F.pmod(F.xxhash64(who), F.col("__cells")).cast("int"))
            .withColumn(other, F.explode(F.sequence(F.lit(0), F.col("__cells") - 1))).drop("__cells"))


def find_cells(pairs: DataFrame, crowded: DataFrame, group: list[str]) -> DataFrame:
    """Rows about pairs with the cell that each pair is joined in; `crowded` has ``__cells`` of groups with more than one."""
    cells = F.coalesce(F.col("__cells"), F.lit(1))
    return (pairs.join(crowded, group, "left")
            .withColumns({own: F.pmod(F.xxhash64(who), cells).cast("int") for who, own in zip(("p1", "p2"), CELL, strict=True)}).drop("__cells"))


def seat_pairs(left: DataFrame, right: DataFrame, group: list[str], actor: str = "player_id",
               block: int = BLOCK_SEATS) -> DataFrame:
    """Join of two one-row-per-(group, actor) tables into unordered pairs.

    `left` and `right` must carry the actor as ``p1`` and ``p2``. A group with more
    actors than one block is cut into block x block cells, so its pairs spread
    over many tasks; an ordinary group is a single cell.
    """
    large = (left.groupBy(*group).agg(F.count("*").alias("__n")).where(F.col("__n") > block)
             .withColumn("__cells", F.ceil(F.col("__n") / F.lit(block)).cast("int"))
             .select(*group, "__cells"))

    def cut(side: DataFrame, who: str, own: str, other: str) -> DataFrame:
        cells = F.coalesce(F.col("__cells"), F.lit(1))
        return (side.join(large, group, "left")
                .withColumn(own, F.pmod(F.xxhash64(who), cells).cast("int"))
                .withColumn(other, F.explode(F.sequence(F.lit(0), cells - 1)))
                .drop("__cells"))

    a, b = cut(left, "p1", "__r", "__c"), cut(right, "p2", "__c", "__r")
    return a.join(b, [*group, "__r", "__c"]).where(F.col("p1") < F.col("p2")).drop("__r", "__c")


def pair_universe(seats: DataFrame) -> DataFrame:
    """Every co-seated pair with its number of shared hands, per phase and table."""
    s = seats.select("phase", "table_id", "hand_id", "player_id").distinct()
    left = s.withColumnRenamed("player_id", "p1")
    right = s.select("hand_id", F.col("player_id").alias("p2"))
    return seat_pairs(left, right, ["hand_id"]).groupBy(*PAIR).agg(F.count("*").alias("shared_hands"))


def candidate_pairs(universe: DataFrame, min_shared: int = MIN_SHARED) -> DataFrame:
    return universe.where(F.col("shared_hands") >= min_shared)


def reconcile(candidates: DataFrame, given: DataFrame) -> DataFrame:
    """Agreement with a given pair list: one row of counts."""
    keys = ["p1", "p2"]
    both = candidates.select(*keys, F.col("shared_hands").alias("mine"), F.lit(1).alias("in_mine")).join(
        given.select(*keys, F.col("shared_hands").alias("theirs"), F.lit(1).alias("in_given")), keys, "full")
    mine, theirs = F.col("in_mine").isNotNull(), F.col("in_given").isNotNull()
    return both.agg(F.sum(as_int(mine & theirs)).alias("matched"),
                    F.sum(as_int(mine & theirs & (F.col("mine") != F.col("theirs")))).alias("count_differs"),
                    F.sum(as_int(mine & ~theirs)).alias("only_candidates"),
                    F.sum(as_int(theirs & ~mine)).alias("only_given"))


def pivot_directed(directed: DataFrame, group: list[str], actor: str, target: str,
                   columns: list[str]) -> DataFrame:
    """Directed measures laid side by side on the unordered pair; absent means zero."""
    forward = F.col(actor) < F.col(target)
    aggs = []
    for c in columns:
        aggs.append(F.sum(F.when(forward, F.col(c)).otherwise(F.lit(0))).alias(f"{c}_1_to_2"))
        aggs.append(F.sum(F.when(~forward, F.col(c)).otherwise(F.lit(0))).alias(f"{c}_2_to_1"))
    return directed.groupBy(*group, F.least(actor, target).alias("p1"),
                            F.greatest(actor, target).alias("p2")).agg(*aggs)


def both_directions(pairs: DataFrame, keep: list[str], columns: dict[str, tuple[str, str]]) -> DataFrame:
    """One row per ordered (actor, partner). `columns` maps a name to its (1->2, 2->1) sources."""
    sides = F.array(*[
        F.struct(F.col(a).alias("actor"), F.col(b).alias("partner"),
                 *[F.col(src[i]).alias(name) for name, src in columns.items()])
        for i, (a, b) in enumerate([("p1", "p2"), ("p2", "p1")])])
    return pairs.select(*keep, F.explode(sides).alias("__s")).select(*keep, "__s.*")


def fold_directions(directed: DataFrame, keep: list[str], columns: list[str], actor: str = "actor",
                    partner: str = "partner", sums: list[str] | None = None,
                    lows: bool = True) -> DataFrame:
    """Two directions onto the unordered pair: larger, smaller, and optionally the sum."""
    aggs: list[Column] = [F.max(c).alias(f"{c}_hi") for c in columns]
    if lows:
        aggs += [F.min(c).alias(f"{c}_lo") for c in columns]
    aggs += [F.sum(c).alias(f"{c}_sum") for c in (sums or [])]
    return directed.groupBy(*keep, F.least(actor, partner).alias("p1"),
                            F.greatest(actor, partner).alias("p2")).agg(*aggs)


def truncate_last(pair_hands: DataFrame, share: float) -> DataFrame:
    """The last `share` of every pair's shared hands (needs the 1-based position ``pair_rn``)."""
    n = pair_hands.groupBy(*PAIR).agg(F.count("*").alias("__n"))
    return (pair_hands.join(n, PAIR)
            .where((F.col("pair_rn") - 1) / F.col("__n") >= F.lit(1.0 - share)).drop("__n"))


def subsample(pair_hands: DataFrame, share: float, seed: str) -> DataFrame:
    """Reproducible random share of the hands, by hash of the hand."""
    draw = F.conv(F.substring(md5_key("hand_id", F.lit(seed)), 1, 8), 16, 10).cast("bigint")
    return pair_hands.where(draw / F.lit(4294967296.0) < F.lit(share))
