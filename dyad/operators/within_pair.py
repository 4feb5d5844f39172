"""Sequence operators inside one pair's shared hands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dyad.functions.cols import as_int
from dyad.functions.ordered import (DAY, minus_own, neighbourhood, ordinal_ranks, percentiles, row_numbers,
                                    running, time_segment, top_rows, with_totals)
from dyad.operators.pairs import PAIR
from dyad.session import settle

HAND_KEY = [*PAIR, "hand_id"]


def with_pair_position(ph: DataFrame, short: bool = False) -> DataFrame:
    """1-based chronological position of each shared hand (``pair_rn``).

    `short` says that no pair has more hands than a block of rows: then one window numbers them.
    """
    if short:
        return ph.withColumn("pair_rn", F.row_number().over(Window.partitionBy(*PAIR).orderBy("started_at", "hand_id")).cast("bigint"))
    return row_numbers(ph, PAIR, [F.col("started_at"), F.col("hand_id")],
                       time_segment("started_at", 7 * DAY), "pair_rn")


def episode_features(ph: DataFrame) -> DataFrame:
    """Chronology of each shared hand: its place, the gaps beside it and the sums of its neighbours.

    Needs ``pair_rn`` and the hand signals. Neighbour sums leave the hand out.
    """
    d = with_totals(ph, PAIR, pair_hands=F.count("*"), contact_total=F.sum("contact"))
    ahead, behind = F.col("transfer_event"), F.col("contact")
    d = d.withColumn("__pos", F.col("pair_rn") - 1)
    d = running(d, PAIR, ["pair_rn"], {
        "contact_before": ("sum", behind.cast("bigint")), "events_before": ("sum", ahead.cast("bigint")),
    }, position="__pos")

    def around(frame) -> dict[str, Column]:
        prev, nxt, local = frame(-1, -1), frame(1, 1), frame(-4, 4)

        def neighbour_mean(c: str) -> Column:
            return (F.coalesce(F.sum(c).over(prev), F.lit(0)) + F.coalesce(F.sum(c).over(nxt), F.lit(0))) / 2.0

        return {"neighbour_transfer": neighbour_mean("transfer_gross"),
                "neighbour_surprise": neighbour_mean("pair_surprise"),
                "local_event_density": F.sum("transfer_event").over(local) - F.col("transfer_event"),
                "__prev": F.max("started_at").over(prev), "__next": F.max("started_at").over(nxt)}

    d = neighbourhood(d, PAIR, "pair_rn", 4, around)
    hours = lambda c: c / 3600.0
    missing = F.lit(-1.0 / 3600.0)
    return d.withColumns({
        "timeline_position": F.col("__pos") / F.col("pair_hands"),
        "gap_to_prev": F.coalesce(hours(F.col("started_at") - F.col("__prev")), missing),
        "gap_to_next": F.coalesce(hours(F.col("__next") - F.col("started_at")), missing),
        "contact_position": F.col("contact_before") / F.greatest(F.col("contact_total"), F.lit(1)),
        "contact_index": F.when(F.col("contact") == 1, F.col("contact_before")).otherwise(999),
    }).drop("__prev", "__next", "__pos")


def direction_consistency(ph: DataFrame) -> DataFrame:
    """Flow and concessions of a hand, signed by the direction that prevails in the rest of the pair's hands."""
    d = ph.withColumns({"__a12": as_int(F.col("ahead_fold_1_to_2")), "__a21": as_int(F.col("ahead_fold_2_to_1"))})
    d = minus_own(d, PAIR, ["transfer_1_to_2", "transfer_2_to_1", "__a12", "__a21"], "__r_")

    def along(first: Column, second: Column, cond: Column) -> Column:
        return F.when(cond, first - second).otherwise(second - first)

    return d.withColumns({
        "with_dominant_flow": along(F.col("transfer_1_to_2"), F.col("transfer_2_to_1"),
                                    F.col("__r_transfer_1_to_2") >= F.col("__r_transfer_2_to_1")),
        "with_dominant_concession": along(F.col("__a12"), F.col("__a21"),
                                          F.col("__r___a12") >= F.col("__r___a21")),
    }).drop("__a12", "__a21", "__r_transfer_1_to_2", "__r_transfer_2_to_1", "__r___a12", "__r___a21")


def within_pair(ph: DataFrame, columns: list[str]) -> DataFrame:
    """Percentile, share of the largest and z-score of each column inside its pair."""
    stats = ph.groupBy(*PAIR).agg(
        *[F.max(F.abs(c)).alias(f"__max_{c}") for c in columns],
        *[F.avg(c).alias(f"__mean_{c}") for c in columns],
        *[F.stddev_samp(c).alias(f"__sd_{c}") for c in columns])
    d = percentiles(ph, PAIR, HAND_KEY, columns, keep=columns).join(stats, PAIR)
    new = {}
    for c in columns:
        new[f"rel_{c}"] = F.col(c) / (F.col(f"__max_{c}") + 1e-9)
        new[f"z_{c}"] = (F.col(c) - F.col(f"__mean_{c}")) / (F.col(f"__sd_{c}") + 1e-3)
    return d.withColumns(new).select(*HAND_KEY, *[f"{p}_{c}" for c in columns for p in ("pct", "rel", "z")])


def rolling_means(ph: DataFrame, column: str, widths: tuple[int, ...]) -> DataFrame:
    """Centred rolling means over the pair's chronology, partial at the ends. Needs ``pair_rn``."""
    reach = max(widths) // 2
    return neighbourhood(ph, PAIR, "pair_rn", reach, lambda frame: {
        f"roll{w}": F.avg(column).over(frame(-(w // 2), w // 2)) for w in widths})


def score_ranks(hs: DataFrame, score: str, out: str) -> DataFrame:
    """Ordinal rank inside the pair, best first, ties by hand id."""
    return ordinal_ranks(hs, PAIR, score, "hand_id", out)


def _ranked_side_by_side(hs: DataFrame) -> DataFrame:
    """Hands with both scores and their ranks, a pair's hands brought together once."""
    pair = Window.partitionBy(*PAIR)
    d = hs.repartition(*PAIR).withColumns({
        f"r_{c}": F.row_number().over(pair.orderBy(F.col(c).desc_nulls_last(), "hand_id")).cast("bigint") for c in ("score", "score2")})
    d = d.where(F.col("score").isNotNull() & F.col("score2").isNotNull()).withColumn("__m", F.least("r_score", "r_score2"))
    return d.withColumn("r", F.row_number().over(pair.orderBy("__m", "r_score", "hand_id")).cast("bigint"))


def candidate_features(hs: DataFrame, n: int = 50,
                       thresholds: tuple[float, ...] = (1.0, 2.0, 3.0), short: bool = False) -> DataFrame:
    """Shortlist of the n best hands per pair with rank, distance and before/after features.

    `hs` has ``score``, ``score2``, ``pair_rn``. The better of the two ranks decides. `short` says that no pair has more
    hands than a block of rows: then one shuffle of its hands does for all ranks, sums and positions.
    """
    stats = {"pair_hands": F.count("*"), "best": F.max("score"), "best2": F.max("score2"),
             "fifth": F.max(F.when(F.col("r_score") == 5, F.col("score"))),
             "fifth2": F.max(F.when(F.col("r_score2") == 5, F.col("score2"))),
             "mean": F.avg("score"), "sd": F.stddev_samp("score"), "total": F.sum("score"),
             **{f"all_{i}": F.sum(as_int(F.col("score") > t)) for i, t in enumerate(thresholds)}}
    if short:
        d = _ranked_side_by_side(hs)
        d = d.withColumns({name: c.over(Window.partitionBy(*PAIR)) for name, c in stats.items()})
    else:
        d = with_totals(_ranked_apart(hs), PAIR, **stats)
    d = d.withColumn("__pos", F.col("pair_rn") - 1)
    d = running(d, PAIR, ["pair_rn"], {
        "mass_prior": ("sum", F.col("score")),
        **{f"prior_{i}": ("sum", as_int(F.col("score") > t).cast("bigint")) for i, t in enumerate(thresholds)},
    }, position="__pos", short=short)
    new = {f"after_{i}": F.col(f"all_{i}") - F.col(f"prior_{i}") - as_int(F.col("score") > t)
           for i, t in enumerate(thresholds)}
    new |= {"after_mass": F.col("total") - F.col("mass_prior") - F.col("score"),
            "to_best": F.col("score") - F.col("best"), "to_fifth": F.col("score") - F.col("fifth"),
            "to_best2": F.col("score2") - F.col("best2"), "to_fifth2": F.col("score2") - F.col("fifth2"),
            "share_of_best": F.col("score") / F.col("best"),
            "z_pair": (F.col("score") - F.col("mean")) / (F.col("sd") + 1e-3),
            "timeline": F.col("__pos") / F.col("pair_hands")}
    d = d.withColumns(new)
    d = d.withColumn("mass_before", F.col("mass_prior") / (F.col("mass_prior") + F.col("after_mass") + 1e-6))
    kept = d.where(F.col("r") <= n)
    # At most n rows per pair enter this window, and fifteen of them count.
    before = Window.partitionBy(*PAIR).orderBy("pair_rn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (kept.withColumn("chrono", F.when(F.col("r") <= 15, F.count(F.when(F.col("r") <= 15, 1)).over(before)).otherwise(99))
            .drop("__m", "__pos", "best", "best2", "fifth", "fifth2", "mean", "sd", "total",
                  *[f"all_{i}" for i in range(len(thresholds))]))


def _ranked_apart(hs: DataFrame) -> DataFrame:
    """The same for pairs of any length, by segments and distinct values."""
    slim = [*HAND_KEY, "score", "score2"]
    first = score_ranks(hs.select(*slim), "score", "r_score").select(*HAND_KEY, "r_score")
    second = score_ranks(hs.select(*slim), "score2", "r_score2").select(*HAND_KEY, "r_score2")
    d = settle(hs.join(first, HAND_KEY).join(second, HAND_KEY))
    return settle(row_numbers(d.withColumn("__m", F.least("r_score", "r_score2")), PAIR,
                              [F.col("__m"), F.col("r_score"), F.col("hand_id")], F.floor(F.col("__m") / 4096), "r"))


def action_templates(context: DataFrame) -> DataFrame:
    """Counts of folds, pay-offs and re-raises answering one player, per (hand, actor, target)."""
    x = context.where(F.col("last_agg").isNotNull() & (F.col("last_agg") != F.col("player_id")))
    a = F.col("action")
    return x.groupBy("phase", "table_id", "hand_id", "player_id", F.col("last_agg").alias("target")).agg(
        F.sum(as_int(a == "fold")).alias("t_fold"), F.sum(as_int(a == "call")).alias("t_pay"),
        F.sum(as_int(a.isin("bet", "raise", "all_in"))).alias("t_aggr"))


def orient_templates(directed: DataFrame) -> DataFrame:
    """Templates laid on the unordered pair, relabelled donor / receiver by the pair's other hands."""
    forward = F.col("player_id") < F.col("target")
    kinds = ["t_fold", "t_pay", "t_aggr"]
    aggs = []
    for k in kinds:
        aggs += [F.sum(F.when(forward, F.col(k)).otherwise(0)).alias(f"{k}_1"),
                 F.sum(F.when(~forward, F.col(k)).otherwise(0)).alias(f"{k}_2")]
    d = directed.groupBy("phase", "table_id", F.least("player_id", "target").alias("p1"),
                         F.greatest("player_id", "target").alias("p2"), "hand_id").agg(*aggs)
    d = d.withColumns({f"give_{i}": F.col(f"t_fold_{i}") + F.col(f"t_pay_{i}") for i in (1, 2)})
    d = minus_own(d, PAIR, ["give_1", "give_2"])
    first = F.col("rest_give_1") >= F.col("rest_give_2")
    new = {}
    for k in kinds:
        new[f"{k}_donor"] = F.when(first, F.col(f"{k}_1")).otherwise(F.col(f"{k}_2"))
        new[f"{k}_receiver"] = F.when(first, F.col(f"{k}_2")).otherwise(F.col(f"{k}_1"))
    return d.withColumns(new).select(*HAND_KEY, *new)


def shortlist(hs: DataFrame, n: int) -> DataFrame:
    return top_rows(hs, PAIR, [F.col("score").desc(), F.col("hand_id")], n)
