"""What two members of a hand do to one another: short patterns of their own actions, and how much they play for.

The actions of the two on one street form a sequence. An automaton that remembers two of them names
the pattern every answer completes: a check answered by a check, or an answer to the other's
aggression, told apart by what the answering member had done before. Since two steps are all the
memory there is, a very long hand is read segment by segment; what a segment leaves behind is its
last two steps, and those of all earlier segments compose to the state the next one starts in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dyad.functions.cols import as_int
from dyad.functions.ordered import SEGMENT, block_rows, minus_own, percentiles, position_segment
from dyad.operators.pairs import PAIR
from dyad.operators.sequence import action_economics, meet_seats

HAND_KEY = [*PAIR, "hand_id"]
FOLD, CHECK, CALL, RAISE, SHOVE = range(5)
CLASS = {"fold": FOLD, "check": CHECK, "call": CALL, "bet": RAISE, "raise": RAISE, "all_in": SHOVE}
OPENINGS = ("bet", "chk_bet", "re")  # a first bet, a bet after the other's check, a bet over the other's bet
ANSWERS = {"fold": (FOLD,), "call": (CALL,), "raise": (RAISE, SHOVE)}
PATTERNS = [f"{o}_{a}" for o in OPENINGS for a in ANSWERS] + ["shove_call", "chk_chk"]
PERIODS = {"pre": lambda street: street == 0, "post": lambda street: street > 0}
GROUPS = {"fold": [f"{o}_fold" for o in OPENINGS], "pay": [f"{o}_call" for o in OPENINGS] + ["shove_call"],
          "aggr": [f"{o}_raise" for o in OPENINGS]}
SIDES = (1, 2)


def _step(side: Column, action: Column) -> Column:
    kinds = F.create_map(*[F.lit(x) for item in CLASS.items() for x in item])
    return side * 8 + F.element_at(kinds, action)


def _side(step: str) -> Column:
    return F.shiftright(F.col(step), 3)


def _class(step: str) -> Column:
    return F.col(step).bitwiseAND(F.lit(7))


def pair_steps(context: DataFrame, seats: DataFrame) -> DataFrame:
    """Every action once for each other seat of its hand, with the two steps before it of the same two members and street.

    Columns: the pair-hand's keys, ``street``, ``action_no`` and ``step``, ``step_1``, ``step_2`` (this, the last, the one before; 8 * side + class).
    """
    acts = context.select("phase", "table_id", "hand_id", "street", "action_no", "player_id", "action")
    other = seats.select("hand_id", "hand_actions", F.col("player_id").alias("__o"), F.col("hand_actions").alias("__all"))
    x = meet_seats(acts, other).where(F.col("player_id") != F.col("__o"))
    x = x.select("phase", "table_id", F.least("player_id", "__o").alias("p1"), F.greatest("player_id", "__o").alias("p2"), "hand_id", "street", "action_no",
                 position_segment("action_no").alias(SEGMENT), "__all",
                 _step(F.when(F.col("player_id") < F.col("__o"), 1).otherwise(2), F.col("action")).alias("step"))
    key = ["hand_id", "p1", "p2", "street"]
    inside = Window.partitionBy(*key, SEGMENT).orderBy("action_no")
    x = x.withColumns({"__1": F.lag("step", 1).over(inside), "__2": F.lag("step", 2).over(inside)})
    left = x.where(F.col("__all") > block_rows()).groupBy(*key, SEGMENT).agg(F.max(F.struct("action_no", "step", "__1")).alias("last"))
    along = Window.partitionBy(*key).orderBy(SEGMENT)
    state = left.select(*key, SEGMENT, F.lag("last.step", 1).over(along).alias("__c1"),
                        F.coalesce(F.lag("last.__1", 1).over(along), F.lag("last.step", 2).over(along)).alias("__c2"))
    x = x.join(state, [*key, SEGMENT], "left")
    return x.select(*HAND_KEY, "street", "action_no", "step", F.coalesce("__1", "__c1").alias("step_1"),
                    F.coalesce("__2", F.when(F.col("__1").isNull(), F.col("__c2")).otherwise(F.col("__c1"))).alias("step_2"))


def pattern() -> Column:
    """Name of the pattern that ``step`` completes, null if it completes none."""
    own, last = _class("step"), _class("step_1")
    mine_before = F.coalesce(_side("step_2") == _side("step"), F.lit(False))
    before = _class("step_2")
    opening = F.when(mine_before & (before == CHECK), "chk_bet").when(mine_before & before.isin(RAISE, SHOVE), "re").otherwise("bet")
    answer = F.when(own == FOLD, "fold").when(own == CALL, "call").when(own.isin(RAISE, SHOVE), "raise")
    name = (F.when((own == CHECK) & (last == CHECK), "chk_chk").when((last == SHOVE) & (own == CALL), "shove_call")
            .when(last.isin(RAISE, SHOVE) & answer.isNotNull(), F.concat_ws("_", opening, answer)))
    return F.when(_side("step") != _side("step_1"), name)


def partner_templates(steps: DataFrame) -> DataFrame:
    """Counts of each pattern before and after the flop by the member that answers, for pair-hands that have any."""
    d = steps.withColumn("__name", pattern()).where(F.col("__name").isNotNull())
    counts = {}
    for period, when in PERIODS.items():
        for name in PATTERNS:
            hit = (F.col("__name") == name) & when(F.col("street"))
            if name == "chk_chk":
                counts[f"{name}_{period}"] = hit
            else:
                counts |= {f"{name}_{period}_{i}": hit & (_side("step") == i) for i in SIDES}
    return d.groupBy(*HAND_KEY).agg(*[F.sum(as_int(c)).alias(n) for n, c in counts.items()])


def template_features(pair_hands: DataFrame, templates: DataFrame) -> DataFrame:
    """Seven counts for every pair-hand, giver and receiver told by the pair's other hands, and their percentiles inside the pair.

    The giver concedes (folds and pays) at least as often as its partner over the pair's other hands; equal counts make it the first.
    A pair-hand without patterns has zeros.
    """
    totals = {f"__{g}_{i}": sum((F.col(f"{n}_{p}_{i}") for n in names for p in PERIODS), F.lit(0)) for g, names in GROUPS.items() for i in SIDES}
    d = templates.select(*HAND_KEY, *[c.alias(n) for n, c in totals.items()], sum((F.col(f"chk_chk_{p}") for p in PERIODS), F.lit(0)).alias("t_chk_chk"))
    d = pair_hands.select(*HAND_KEY).join(d, HAND_KEY, "left").fillna(0)
    d = minus_own(d.withColumns({f"__give_{i}": F.col(f"__fold_{i}") + F.col(f"__pay_{i}") for i in SIDES}), PAIR, ["__give_1", "__give_2"], "__rest")
    first = F.col("__rest__give_1") >= F.col("__rest__give_2")
    new = {}
    for g in GROUPS:
        new[f"t_{g}_don"] = F.when(first, F.col(f"__{g}_1")).otherwise(F.col(f"__{g}_2"))
        new[f"t_{g}_rec"] = F.when(first, F.col(f"__{g}_2")).otherwise(F.col(f"__{g}_1"))
    names = [*new, "t_chk_chk"]
    d = d.withColumns(new).select(*HAND_KEY, *names)
    return percentiles(d, PAIR, HAND_KEY, names, keep=names)


SIZES = {"bet": "largest own bet in pots", "mean_bet": "mean own bet in pots", "depth": "smallest stack in blinds", "pot": "largest pot in blinds",
         "crowd": "most players still in"}


def seat_sizing(context: DataFrame) -> DataFrame:
    """The measures of `SIZES` of every seat; bets in pots are null for a seat that made none."""
    d = action_economics(context)
    bet = F.when(F.col("action").isin("bet", "raise", "all_in"), F.col("amount") / F.greatest(F.col("pot_before"), F.lit(1)).cast("double"))
    return d.groupBy("hand_id", "player_id").agg(F.max(bet).alias("bet"), F.avg(bet).alias("mean_bet"), F.min("stack_bb").alias("depth"), F.max("pot_bb").alias("pot"),
                                                 F.max("players_active").cast("double").alias("crowd"))


def sizing_features(pair_hands: DataFrame, sizing: DataFrame) -> DataFrame:
    """Larger and smaller of the two members' measures for every pair-hand, and their percentiles inside the pair."""
    d = pair_hands.select(*HAND_KEY)
    for i in SIDES:
        d = d.join(sizing.select("hand_id", F.col("player_id").alias(f"p{i}"), *[F.col(m).alias(f"__{m}_{i}") for m in SIZES]), ["hand_id", f"p{i}"], "left")
    new = {f"sz_{m}_{end}": f(f"__{m}_1", f"__{m}_2") for m in SIZES for end, f in (("hi", F.greatest), ("lo", F.least))}
    d = d.withColumns(new).select(*HAND_KEY, *new)
    return percentiles(d, PAIR, HAND_KEY, list(new), keep=list(new))
