"""Seat table: one row per (hand, player)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dyad.functions.cols import COUNTED_AGGRESSION, as_int, count_where
from dyad.functions.ordered import value_ranks
from dyad.operators.sequence import SEAT, fold_attribution


def seat_action_stats(context: DataFrame) -> DataFrame:
    """Counts, sums and extremes of a seat's actions."""
    a, st = F.col("action"), F.col("street")
    post, facing, agg = st > 0, F.col("to_call") > 0, a.isin(COUNTED_AGGRESSION)
    is_fold = a == "fold"
    whole = ["table_id", "phase", "started_at"]  # of the hand
    return context.groupBy(*SEAT).agg(
        *[F.max(c).alias(c) for c in whole],
        F.count("*").alias("n_actions"),
        *[count_where(a == k).alias(n) for k, n in [
            ("raise", "raises"), ("bet", "bets"), ("call", "calls"), ("check", "checks"),
            ("fold", "folds"), ("all_in", "all_ins")]],
        count_where(agg).alias("aggressive_actions"),
        count_where(agg & post).alias("postflop_aggressive"),
        count_where((a == "check") & post).alias("postflop_checks"),
        count_where((a == "call") & post).alias("postflop_calls"),
        count_where(post).alias("postflop_actions"),
        count_where(is_fold & facing).alias("folds_facing_bet"),
        count_where((a == "call") & facing).alias("calls_facing_bet"),
        count_where((st == 0) & a.isin("call", "raise", "bet", "all_in")).alias("vpip_actions"),
        count_where((st == 0) & (a == "raise")).alias("preflop_raises"),
        F.sum("amount").alias("contribution"), F.max("amount").alias("max_amount"),
        F.max("to_call").alias("max_to_call"), F.sum("to_call").alias("sum_to_call"),
        F.max("pot_before").alias("max_pot_before"),
        F.min("players_active").alias("min_players_active"),
        F.max(F.when(is_fold, F.col("to_call"))).alias("fold_to_call"),
        F.max(F.when(is_fold, F.col("pot_before"))).alias("fold_pot_before"),
        F.min(F.when(is_fold, st)).alias("fold_street"),
        F.max("street").alias("last_street"),
        F.min(F.when(is_fold, F.col("action_no"))).alias("exit_no"),
        F.max("players_dealt").alias("players_dealt"), F.max("hand_actions").alias("hand_actions"),
        F.max("big_blind").alias("big_blind"),
        F.max("strength").alias("best"),
        *[F.max(F.when(st <= i, F.col("strength"))).alias(f"str_{i}") for i in range(4)])


def hand_totals(seats: DataFrame) -> DataFrame:
    """Sums over all seats of a hand."""
    return seats.groupBy("hand_id").agg(
        F.sum(as_int(F.col("folded"))).alias("h_folds"),
        F.sum("aggressive_actions").alias("h_aggressive"),
        F.sum("contribution").alias("h_contribution"),
        F.sum("folds_facing_bet").alias("h_folds_facing_bet"),
        F.sum(as_int(F.col("went_to_showdown"))).alias("h_showdowns"),
        F.sum("n_actions").alias("h_actions"), F.max("best").alias("h_best"),
        F.sum("preflop_raises").alias("h_preflop_raises"))


def with_strength_rank(seats: DataFrame) -> DataFrame:
    """1 = strongest of the hand, ties sharing the smallest rank; who held the best."""
    ranks = value_ranks(seats.withColumn("__s", -F.col("best")), ["hand_id"], "__s")
    ranked = ranks.select("hand_id", (-F.col("__s")).alias("best"), (F.col("below") + 1).alias("strength_rank"))
    return (seats.join(ranked, ["hand_id", "best"], "left")
            .withColumn("held_best_hand", as_int(F.col("strength_rank") == 1)))


def seat_features(context: DataFrame) -> DataFrame:
    """Action statistics, attribution, outcome and prices of every seat.

    The net result is scaled by the number of seats, which keeps it an integer
    that sums to zero over the hand.
    """
    stats = seat_action_stats(context)
    pots = stats.groupBy("hand_id").agg(F.sum("contribution").alias("final_pot"))
    s = stats.join(fold_attribution(context), SEAT, "left").join(pots, "hand_id")
    bb = F.col("big_blind").cast("double")
    zero = F.lit(0).cast("bigint")
    folded = F.col("exit_no").isNotNull()
    fold_call, fold_pot = F.coalesce("fold_to_call", zero), F.coalesce("fold_pot_before", zero)
    s = s.withColumns({
        "folds_induced": F.coalesce("folds_induced", zero),
        "folded": folded,
        "went_to_showdown": ~folded & (F.col("last_street") == 3),
        "net": F.col("contribution") * F.col("players_dealt") - F.col("final_pot"),
        "contribution_bb": F.col("contribution") / bb, "pot_bb": F.col("final_pot") / bb,
        "max_amount_bb": F.col("max_amount") / bb, "max_to_call_bb": F.col("max_to_call") / bb,
        "fold_to_call_bb": fold_call / bb, "fold_pot_before_bb": fold_pot / bb,
        "fold_pot_odds": fold_pot.cast("double") / F.greatest(fold_call, F.lit(1).cast("bigint")),
        "seat_no": F.col("player_id") % F.lit(15),
    })
    s = s.withColumns({"net_bb": F.col("net") / (bb * F.col("players_dealt")),
                       "preflop_pct": (F.coalesce("str_0", F.lit(0)) + 1) / F.lit(100.0)})
    return with_strength_rank(s)
