"""Staged tables every query of the catalogue starts from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dyad.operators import live as lv
from dyad.operators import pair_hands as phs
from dyad.operators import seats as st
from dyad.operators import sequence as sq
from dyad.session import rows_stay, staged, tune
from dyad.sources import event_log as ev

LIVE_COLUMNS = ["table_id", "phase", "y", "action", "amount", "big_blind", "pot_before", "players_active",
                "live_opponents", "surp", "p_fold", "p_pass", "p_agg", "p0", "p1", "p2", "p3", "p4", "size_z",
                "fold"]


def log(spark: SparkSession, sf: str) -> DataFrame:
    return staged(tune(spark), sf, "log", lambda: ev.read_actions(spark, sf))


def context(spark: SparkSession, sf: str) -> DataFrame:
    return staged(spark, sf, "context", lambda: sq.action_context(log(spark, sf), ev.STARTING_STACK))


def seats(spark: SparkSession, sf: str) -> DataFrame:
    acts = context(spark, sf)
    with rows_stay(spark):
        return staged(spark, sf, "seats", lambda: st.seat_features(acts))


def hands(spark: SparkSession, sf: str) -> DataFrame:
    return staged(spark, sf, "hands", lambda: (
        context(spark, sf).groupBy("hand_id", "table_id", "started_at", "phase")
        .agg(F.count("*").alias("hand_actions"), F.max("players_dealt").alias("players_dealt"),
             F.sum("amount").alias("final_pot"))))


def scored(spark: SparkSession, sf: str) -> DataFrame:
    """Actions with the out-of-fold policy, surprisal and size residual."""
    def build() -> DataFrame:
        acts = lv.with_policy_context(sq.with_fold(context(spark, sf)))
        sized = lv.size_residual(acts, ["c_street", "c_hu"])
        return lv.surprisal(lv.score_policy(sized, lv.context_policy(acts)))
    return staged(spark, sf, "scored", build)


def live(spark: SparkSession, sf: str) -> DataFrame:
    return staged(spark, sf, "live",
                  lambda: lv.expand_live(scored(spark, sf), seats(spark, sf), LIVE_COLUMNS))


def by_target(spark: SparkSession, sf: str) -> DataFrame:
    return lv.surprise_by_target(scored(spark, sf))


def pair_hands(spark: SparkSession, sf: str) -> DataFrame:
    """Pair-hands with their surprise and chronology."""
    s = seats(spark, sf)
    acts, answers = scored(spark, sf), by_target(spark, sf)
    with rows_stay(spark):
        return staged(spark, sf, "pair_hands", lambda: phs.pair_hands(
            s, st.hand_totals(s), sq.consecutive_aggression(context(spark, sf)), lv.surprise_by_seat(acts), answers))
