"""Facts a reviewer reads: how a pair treats each other, and what happened in a hand."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dyad.functions.cols import as_int, ratio
from dyad.functions.ordered import minus_own
from dyad.operators.pairs import both_directions

TABLE = ["phase", "table_id"]
LINE_CHUNK = 512


def pair_profile(ph: DataFrame, concessions: DataFrame, co_aggression: str = "first_aggr") -> DataFrame:
    """Events with the partner against the same events with everyone else, over exposure.

    One row per ordered (player, partner). Every count toward the field is the
    player's total over all partners minus the partner's own.
    """
    given = concessions.groupBy(*TABLE, "hand_id", F.col("folder").alias("player"), F.col("target").alias("other")).agg(
        F.count("*").alias("folds"), F.sum("better").alias("conceded"))
    a, b = F.least("player", "other").alias("p1"), F.greatest("player", "other").alias("p2")
    forward = F.col("player") < F.col("other")
    on_pair = given.groupBy(*TABLE, a, b).agg(*[
        F.sum(F.when(cond, F.col(c)).otherwise(0)).alias(f"{c}_{d}")
        for c in ("folds", "conceded") for cond, d in ((forward, "12"), (~forward, "21"))])
    quiet = (F.col("both_showdown") & (F.col("postflop_aggressive_1") == 0)
             & (F.col("postflop_aggressive_2") == 0))
    shared = ph.groupBy(*TABLE, "p1", "p2").agg(
        F.count("*").alias("hands"),
        F.sum(as_int((F.col(f"{co_aggression}_1") > 0) & (F.col(f"{co_aggression}_2") > 0))).alias("co_raises"),
        F.sum(as_int(F.col("both_showdown"))).alias("showdowns"), F.sum(as_int(quiet)).alias("quiet"),
        F.sum("net_1").alias("net_12"), F.sum("net_2").alias("net_21"))
    pairs = shared.join(on_pair, [*TABLE, "p1", "p2"], "left").fillna(0)
    same = {c: (c, c) for c in ("hands", "co_raises", "showdowns", "quiet")}
    d = both_directions(pairs, TABLE, same | {c: (f"{c}_12", f"{c}_21") for c in ("folds", "conceded", "net")})
    d = minus_own(d, [*TABLE, "actor"], ["hands", "co_raises", "showdowns", "quiet", "folds", "conceded"])
    new = {}
    for name, count, base in (("fold", "folds", "hands"), ("concession", "conceded", "hands"),
                              ("co_raise", "co_raises", "hands"), ("quiet_showdown", "quiet", "showdowns")):
        mine, field = ratio(F.col(count), F.col(base)), ratio(F.col(f"rest_{count}"), F.col(f"rest_{base}"))
        new[f"{name}_rate"], new[f"{name}_field"] = mine, field
        new[f"{name}_lift"] = F.when((F.col(count) > 0) & (F.col(f"rest_{count}") > 0), ratio(mine, field))
    return d.withColumns(new)


def hand_lines(context: DataFrame, chunk: int = LINE_CHUNK) -> DataFrame:
    """The action line of each street as text, at most `chunk` actions per row."""
    word = F.concat_ws(" ", F.col("player_id").cast("string"), "action", F.col("amount").cast("string"))
    part = F.floor(F.col("action_no") / F.lit(chunk)).cast("bigint")
    lines = context.groupBy("hand_id", "street", part.alias("part")).agg(
        F.sort_array(F.collect_list(F.struct("action_no", word.alias("w")))).alias("acts"))
    return lines.select("hand_id", "street", "part",
                        F.array_join(F.transform("acts", lambda a: a["w"]), "; ").alias("line"))


def hand_report(evidence: DataFrame, ph: DataFrame, lines: DataFrame) -> DataFrame:
    """Stakes, both sides' economics and strength, and the action line of every evidence hand."""
    facts = ph.select("p1", "p2", "hand_id", "big_blind", "players_dealt", "pot_bb", "contribution_1",
                      "contribution_2", "net_1", "net_2", "best_1", "best_2", "strength_rank_1", "strength_rank_2",
                      as_int(F.col("folded_1")).alias("folded_1"), as_int(F.col("folded_2")).alias("folded_2"))
    d = evidence.select("p1", "p2", "hand_id", "slot").join(facts, ["p1", "p2", "hand_id"])
    return d.join(lines, "hand_id")


def exposure(seats: DataFrame) -> DataFrame:
    """(hand x other opponent) slots of every player."""
    return seats.groupBy(*TABLE, "player_id").agg(
        F.count("*").alias("hands"), F.sum(F.col("players_dealt") - 1).alias("slots"))
