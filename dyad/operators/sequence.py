"""Per-hand sequence operators: who acted before, in what order, at what price."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dyad.functions.cols import ATTRIBUTED_AGGRESSION, as_int, md5_key
from dyad.functions.ordered import (DAY, SEGMENT, all_short, block_rows, position_segment, row_numbers, running,
                                    time_segment)

HAND = ["hand_id"]
SEAT = ["hand_id", "player_id"]


def with_table_order(hands: DataFrame) -> DataFrame:
    """Chronological position of every hand inside its table."""
    return row_numbers(hands, ["table_id"], [F.col("started_at"), F.col("hand_id")],
                       time_segment("started_at", 7 * DAY), "t_order")


def phase_split(ordered: DataFrame, share: float = 0.6) -> DataFrame:
    """First `share` of each table's hands is development, the rest evaluation."""
    sizes = ordered.groupBy("table_id").agg(F.count("*").alias("table_hands"))
    return ordered.join(sizes, "table_id").withColumn(
        "split_phase",
        F.when(F.col("t_order") <= F.floor(F.col("table_hands") * F.lit(share)), "development")
        .otherwise("evaluation"))


def timeline_block(ordered: DataFrame, blocks: int) -> DataFrame:
    """Equal blocks of each table's timeline."""
    sizes = ordered.groupBy("table_id").agg(F.count("*").alias("__n"))
    return (ordered.join(sizes, "table_id")
            .withColumn("block", F.floor((F.col("t_order") - 1) * F.lit(blocks) / F.col("__n")).cast("int"))
            .drop("__n"))


def with_fold(df: DataFrame, n: int = 5, group: str = "table_id", seed: str | None = None) -> DataFrame:
    """Group-closed folds: every row of a group falls in one fold."""
    if seed is None:
        return df.withColumn("fold", F.pmod(F.col(group), F.lit(n)).cast("int"))
    digest = F.conv(F.substring(md5_key(group, F.lit(seed)), 1, 8), 16, 10).cast("bigint")
    return df.withColumn("fold", F.pmod(digest, F.lit(n)).cast("int"))


def action_context(actions: DataFrame, stack: int | None = None) -> DataFrame:
    """What every action knows about the actions strictly before it."""
    aggressive = F.col("action").isin(ATTRIBUTED_AGGRESSION)
    one, agg, fold = F.lit(1).cast("bigint"), as_int(aggressive).cast("bigint"), as_int(F.col("action") == "fold")
    order = ["action_no"]
    short = all_short(actions, "action_no")
    if short:  # every hand fits into one segment: it is brought together once
        actions = actions.repartition("hand_id")
    d = running(actions, SEAT, order, {
        "own_act_before": ("sum", one), "own_agg_before": ("sum", agg),
        "own_folds_before": ("sum", fold.cast("bigint")),
        "invested_before": ("sum", F.col("amount")),
    }, position="action_no", cut=HAND, short=short)
    d = d.withColumn("is_exit", (F.col("action") == "fold") & (F.col("own_folds_before") == 0))
    d = running(d, ["hand_id", "street"], order, {
        "n_agg_st": ("sum", agg), "n_act_st": ("sum", one),
    }, position="action_no", cut=HAND, short=short)
    d = running(d, HAND, order, {
        "n_agg_hand": ("sum", agg), "exits_before": ("sum", as_int(F.col("is_exit")).cast("bigint")),
        "pot_before": ("sum", F.col("amount")),
        "last_agg": ("last", F.when(aggressive, F.col("player_id"))),
        "last_agg_amount": ("last", F.when(aggressive, F.col("amount"))),
        "last_agg_street": ("last", F.when(aggressive, F.col("street"))),
    }, position="action_no", cut=HAND, short=short)
    seated = {"players_dealt": F.sum(as_int(F.col("own_act_before") == 0)), "hand_actions": F.count("*")}
    if short:
        d = d.withColumns({name: c.over(Window.partitionBy("hand_id")) for name, c in seated.items()})
    else:
        d = d.join(d.groupBy("hand_id").agg(*[c.alias(name) for name, c in seated.items()]), "hand_id")
    to_call = F.when(F.col("last_agg").isNotNull() & (F.col("last_agg") != F.col("player_id")),
                     F.col("last_agg_amount")).otherwise(F.lit(0).cast("bigint"))
    d = d.withColumns({
        "self_last_agg": as_int(F.col("last_agg") == F.col("player_id")),
        "to_call": to_call,
        "players_active": F.col("players_dealt") - F.col("exits_before"),
        "live_opponents": (F.col("players_dealt") - 1 - F.col("exits_before")
                           + as_int(F.col("own_folds_before") > 0)),
    })
    if stack is not None:
        d = d.withColumn("stack_before", F.lit(stack).cast("bigint") - F.col("invested_before"))
    return d


def action_economics(actions: DataFrame, soft: bool = False) -> DataFrame:
    """Prices in blinds, pot odds, stack depth. `soft` adds 1e-9 instead of clipping at 1."""
    def over(a: Column, b: Column) -> Column:
        b = b.cast("double")
        return a.cast("double") / (b + 1e-9 if soft else F.greatest(b, F.lit(1.0)))

    bb = F.col("big_blind").cast("double")
    call, pot, stack = F.col("to_call"), F.col("pot_before"), F.col("stack_before")
    return actions.withColumns({
        "to_call_bb": call / bb, "pot_bb": pot / bb, "stack_bb": stack / bb,
        "amount_bb": F.col("amount") / bb,
        "pot_odds": over(call, pot + call), "call_stack": over(call, stack),
        "stack_to_pot": over(stack, pot), "bet_ratio": over(call, pot),
    })


def meet_seats(actions: DataFrame, seats: DataFrame) -> DataFrame:
    """Actions joined to the seats of their hand.

    The seats of a very long hand are repeated once per segment of its actions
    (``hand_actions`` tells how many there are), so its actions spread over many
    tasks; an ordinary hand has one segment and is joined as it stands.
    """
    last = F.floor((F.col("hand_actions") - 1) / F.lit(block_rows())).cast("bigint")
    spread = (seats.withColumn(SEGMENT, F.explode(F.sequence(F.lit(0).cast("bigint"), last)))
              .drop("hand_actions"))
    cut = actions.withColumn(SEGMENT, position_segment("action_no"))
    return cut.join(spread, ["hand_id", SEGMENT]).drop(SEGMENT)


def rel_position(seat: Column, origin: Column, n: Column) -> Column:
    """Clockwise seats from `origin` to `seat`, never negative."""
    return F.pmod(seat - origin, n)


def exit_no(actions: DataFrame) -> DataFrame:
    """The action at which each seat left the hand."""
    return actions.groupBy(*SEAT).agg(
        F.min(F.when(F.col("action") == "fold", F.col("action_no"))).alias("exit_no"))


def fold_attribution(context: DataFrame) -> DataFrame:
    """Whom each leaving player answered, and how many exits each aggressor caused."""
    exits = context.where(F.col("is_exit") & F.col("last_agg").isNotNull())
    who = exits.select("hand_id", "player_id", F.col("last_agg").alias("folded_to"))
    induced = (exits.groupBy("hand_id", F.col("last_agg").alias("player_id"))
               .agg(F.count("*").alias("folds_induced")))
    return who.join(induced, SEAT, "full").withColumn(
        "folds_induced", F.coalesce("folds_induced", F.lit(0).cast("bigint")))


def consecutive_aggression(context: DataFrame) -> DataFrame:
    """Pairs whose aggressive actions followed one another in a hand."""
    relay = context.where(F.col("action").isin(ATTRIBUTED_AGGRESSION) & F.col("last_agg").isNotNull()
                          & (F.col("last_agg") != F.col("player_id")))
    return relay.select("hand_id", F.least("last_agg", "player_id").alias("p1"),
                        F.greatest("last_agg", "player_id").alias("p2")).distinct()


def actor_style(seats: DataFrame) -> DataFrame:
    """Six raw rates per (player, phase) from the seat table."""
    n = F.count("*").cast("double")
    return seats.groupBy("player_id", "phase").agg(
        F.count("*").alias("hands"),
        (F.sum(as_int(F.col("vpip_actions") > 0)) / n).alias("vpip_rate"),
        (F.sum(as_int(F.col("preflop_raises") > 0)) / n).alias("pfr_rate"),
        (F.sum(as_int(F.col("folded"))) / n).alias("fold_rate"),
        (F.sum(as_int(F.col("went_to_showdown"))) / n).alias("showdown_rate"),
        (F.sum("aggressive_actions") / F.greatest(F.sum("n_actions"), F.lit(1)).cast("double"))
        .alias("aggression_rate"),
        (F.sum("postflop_aggressive") / F.greatest(F.sum("postflop_actions"), F.lit(1)).cast("double"))
        .alias("postflop_aggression_rate"))


# Fixed prior (successes, trials) of each smoothed rate.
STYLE_PRIORS = {"open_raise": (1, 5), "open_fold": (3, 5), "versus_raise_aggressive": (1, 10),
                "versus_raise_fold": (6, 10), "later_aggressive": (3, 10), "later_fold_to_bet": (4, 10)}


def actor_style_smoothed(context: DataFrame) -> DataFrame:
    """Six rates per (player, phase), shrunk to a prior."""
    first, later = F.col("street") == 0, F.col("street") > 0
    opened = F.col("n_agg_st") > 0
    aggressive, fold = F.col("action").isin(ATTRIBUTED_AGGRESSION), F.col("action") == "fold"
    faced = later & (F.col("to_call") > 0)
    trials = {"open_raise": (first & ~opened, aggressive), "open_fold": (first & ~opened, fold),
              "versus_raise_aggressive": (first & opened, aggressive),
              "versus_raise_fold": (first & opened, fold),
              "later_aggressive": (later, aggressive), "later_fold_to_bet": (faced, fold)}
    aggs = [((F.sum(as_int(at & hit)) + STYLE_PRIORS[name][0])
             / (F.sum(as_int(at)) + STYLE_PRIORS[name][1]).cast("double")).alias(name)
            for name, (at, hit) in trials.items()]
    return context.groupBy("player_id", "phase").agg(F.count("*").alias("style_actions"), *aggs)


def concessions(context: DataFrame, seats: DataFrame) -> DataFrame:
    """One row per fold to a bet or raise, with both strengths on that street where they can be compared."""
    s = strength_at
    exits = context.where(F.col("is_exit") & F.col("last_agg").isNotNull())
    mine = seats.select("hand_id", "player_id", *[F.col(f"str_{i}").alias(f"m_{i}") for i in range(4)])
    theirs = seats.select("hand_id", F.col("player_id").alias("last_agg"),
                          *[F.col(f"str_{i}").alias(f"t_{i}") for i in range(4)])
    x = exits.join(mine, SEAT).join(theirs, ["hand_id", "last_agg"], "left")
    a, b = s(F.col("street"), "m"), s(F.col("street"), "t")
    comparable = (F.col("street") > 0) & a.isNotNull() & b.isNotNull()
    return x.select(
        "hand_id", "table_id", "phase", "street", F.col("player_id").alias("folder"), F.col("last_agg").alias("target"),
        (F.col("last_agg_amount") / F.col("big_blind")).alias("to_bet_bb"),
        F.col("last_agg_street").alias("to_street"), a.alias("folder_strength"), b.alias("aggressor_strength"),
        as_int(comparable).alias("comparable"), as_int(comparable & (a > b)).alias("better"))


def strength_at(street: Column, prefix: str, suffix: str = "") -> Column:
    """The actor's strength on the street in question."""
    out = F.when(street == 0, F.col(f"{prefix}_0{suffix}"))
    for i in (1, 2, 3):
        out = out.when(street == i, F.col(f"{prefix}_{i}{suffix}"))
    return out
