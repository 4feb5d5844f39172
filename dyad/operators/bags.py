"""Bags of actions: multiple-instance tables, pooling and audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dyad.functions.cols import as_int, md5_key
from dyad.functions.ordered import percentiles, row_numbers, running, time_segment, top_rows
from dyad.operators.pairs import PAIR
from dyad.operators.sequence import SEAT
from dyad.session import settle

BAG = ["p1", "p2", "hand_id"]


def synthetic_evidence(bags: DataFrame, labels: DataFrame) -> DataFrame:
    """Arithmetic stand-in for an evidence table: three to five hands per positive pair."""
    positive = labels.where(F.col("label") == 1).select("p1", "p2")
    d = bags.join(positive, ["p1", "p2"]).select("p1", "p2", "hand_id")
    d = d.withColumn("__o", md5_key("p1", "p2", "hand_id"))
    best = top_rows(d, ["p1", "p2"], [F.col("__o"), F.col("hand_id")], 5, "evidence_rank")
    size = 3 + F.pmod(F.col("p1") + F.col("p2"), F.lit(3))
    return best.where(F.col("evidence_rank") <= size).drop("__o")


def bag_table(ph: DataFrame, labels: DataFrame, evidence: DataFrame) -> DataFrame:
    """Every bag with its three-valued label: evidence 1, negative pair 0, otherwise censored -1."""
    d = ph.select(*PAIR, "hand_id").join(labels.select("p1", "p2", "label"), ["p1", "p2"])
    ev = evidence.select(*BAG, F.lit(1).alias("listed"))
    d = d.join(ev, BAG, "left")
    return d.withColumn("bag_label", F.when(F.col("listed") == 1, 1).when(F.col("label") == 0, 0).otherwise(-1)
                        ).drop("listed")


def label_hands(hands: DataFrame, labels: DataFrame, evidence: DataFrame, phase: str = "development", unknown: DataFrame | None = None) -> DataFrame:
    """Every hand with its ``bag_label`` as in `bag_table`, null outside `phase` and for unlisted pairs, and its pair's family.

    Hands of `unknown`, unlisted pairs taken for ordinary, are negatives too: listed negatives alone are a narrow part of what
    is clean. A pair's evidence, a few hands, travels with its label, so hands meet their pair once and nothing else.
    """
    listed = evidence.groupBy("p1", "p2").agg(F.collect_set("hand_id").alias("__listed"))
    known = labels.select("p1", "p2", "label", "family").join(listed, ["p1", "p2"], "left")
    if unknown is not None:
        known = known.unionByName(unknown.select("p1", "p2", F.lit(0).alias("label")), allowMissingColumns=True)
    told = F.when(F.array_contains("__listed", F.col("hand_id")), 1).when(F.col("label") == 0, 0).otherwise(-1)
    return hands.join(known, ["p1", "p2"], "left").withColumn(
        "bag_label", F.when((F.col("phase") == phase) & F.col("label").isNotNull(), told)).drop("__listed", "label")


def missing_bags(bags: DataFrame, evidence: DataFrame) -> DataFrame:
    """Evidence with no bag behind it; must be empty."""
    return evidence.select(*BAG).exceptAll(bags.where(F.col("bag_label") == 1).select(*BAG))


def instances(bags: DataFrame, scored: DataFrame, seats: DataFrame, carry: list[str] = [], short: bool = False) -> DataFrame:
    """Each member's actions in a bag, with what the partner did before and after, and the `carry` columns of the bag.

    The actor's own running counts come with the action table, so the partner's
    are the bag's running counts minus those. `short` says that no hand is longer than a block of rows: then
    bags, actions and seats are brought together by hand once, and what is made of them stays (under `rows_stay`).
    """
    if short:
        bags, scored, seats = (d.repartition("hand_id") for d in (bags, scored, seats))
    members = bags.select("phase", "table_id", *BAG, *carry, F.explode(F.array(
        F.struct(F.col("p1").alias("player_id"), F.col("p2").alias("partner")),
        F.struct(F.col("p2").alias("player_id"), F.col("p1").alias("partner")))).alias("m")).select(
        "phase", "table_id", *BAG, *carry, "m.*")
    acts = scored.select("hand_id", "player_id", "action_no", "street", "y", "amount", "strength", "surp",
                         "last_agg", "to_call", "pot_before", "players_active", "hand_actions",
                         "own_act_before", "own_agg_before", "own_folds_before", "invested_before", "big_blind")
    d = members.join(acts, SEAT)
    mate = seats.select("hand_id", F.col("player_id").alias("partner"), F.col("exit_no").alias("b_exit"),
                        F.col("n_actions").alias("b_n"), F.col("aggressive_actions").alias("b_agg"),
                        F.col("folds").alias("b_folds"), F.col("net").alias("b_net"),
                        *[F.col(f"str_{i}").alias(f"b_{i}") for i in range(4)])
    own = seats.select("hand_id", "player_id", F.col("net").alias("a_net"), F.col("n_actions").alias("a_n"))
    d = d.join(mate, ["hand_id", "partner"]).join(own, SEAT)
    one = F.lit(1).cast("bigint")
    agg, fold = as_int(F.col("y") >= 3), as_int(F.col("y") == 0)
    d = running(d, BAG, ["action_no"], {
        "bag_before": ("sum", one), "bag_agg_before": ("sum", agg.cast("bigint")),
        "bag_fold_before": ("sum", fold.cast("bigint")),
        "prev_no": ("last", F.col("action_no")), "prev_who": ("last", F.col("player_id")),
    }, position="action_no", cut=BAG, short=short)
    b_str = F.when(F.col("street") == 0, F.col("b_0")).when(F.col("street") == 1, F.col("b_1")).when(
        F.col("street") == 2, F.col("b_2")).otherwise(F.col("b_3"))
    facing = (F.when(F.col("last_agg").isNull(), 0).when(F.col("last_agg") == F.col("player_id"), 1)
              .when(F.col("last_agg") == F.col("partner"), 2).otherwise(3))
    d = d.withColumns({
        "partner_acted_before": F.col("bag_before") - F.col("own_act_before"),
        "partner_aggr_before": F.col("bag_agg_before") - F.col("own_agg_before"),
        "partner_folds_before": F.col("bag_fold_before") - F.col("own_folds_before"),
        "partner_live": as_int(F.col("b_exit").isNull() | (F.col("b_exit") > F.col("action_no"))),
        "facing": facing, "rel": F.coalesce(F.col("strength") - b_str, F.lit(0)),
        "is_last_action": as_int(F.col("action_no") == F.col("hand_actions") - 1),
        "outsiders_left": F.col("players_active") - 2,
        "turns_since_partner": F.when(F.col("prev_who").isNotNull() & (F.col("prev_who") != F.col("player_id")),
                                      F.col("action_no") - F.col("prev_no")).otherwise(F.lit(-1).cast("bigint")),
        "share_of_actions": (F.col("a_n") + F.col("b_n")) / F.col("hand_actions"),
        "amount_bb": F.col("amount") / F.col("big_blind"), "invested_bb": F.col("invested_before") / F.col("big_blind"),
        "actor_won": as_int(F.col("a_net") > F.col("b_net"))})
    return d.withColumns({
        "partner_acts_after": F.col("b_n") - F.col("partner_acted_before"),
        "partner_aggr_after": F.col("b_agg") - F.col("partner_aggr_before"),
        "partner_folds_after": F.col("b_folds") - F.col("partner_folds_before"),
    }).drop("b_0", "b_1", "b_2", "b_3", "b_n", "b_agg", "b_folds", "b_exit", "bag_before", "bag_agg_before",
            "bag_fold_before", "prev_no", "prev_who", "a_n")


TAU = 1.0


def pool_bag(rows: DataFrame, score: str, keys: list[str] = [*PAIR, "hand_id"]) -> DataFrame:
    """Pools action scores into one row per bag.

    Noisy-OR in log space, log-sum-exp about the bag's maximum, gap to the second
    best, a description of the best action, and the percentile inside the pair.
    """
    z = F.col(score)
    top = F.max_by(F.struct("street", "y", "facing", "surp"), F.struct(z, -F.col("action_no"), -F.col("player_id")))
    tops = rows.groupBy(*keys).agg(F.max(z).alias("max_z"), top.alias("top"))
    softplus = F.greatest(z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z)))
    d = rows.join(tops.select(*keys, "max_z"), keys)
    sums = d.groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg(z).alias("mean_z"), (-F.sum(softplus)).alias("log_none"),
        (F.max("max_z") + TAU * F.log(F.sum(F.exp((z - F.col("max_z")) / TAU)))).alias("lse_z"))
    seconds = top_rows(rows.select(*keys, "action_no", "player_id", score), keys,
                       [z.desc(), F.col("action_no"), F.col("player_id")], 2)
    seconds = seconds.groupBy(*keys).agg(F.min(z).alias("second_z"))
    pooled = sums.join(tops, keys).join(seconds, keys).withColumns({
        "noisy_or": F.log(-F.expm1(F.least(F.col("log_none"), F.lit(-1e-12)))) - F.col("log_none"),
        "z_gap": F.col("max_z") - F.col("second_z"), "top_street": F.col("top.street"), "top_action": F.col("top.y"),
        "top_answers_partner": as_int(F.col("top.facing") == 2), "top_surprise": F.col("top.surp"),
        "__p": F.round("max_z", 6)}).drop("top", "second_z", "log_none")
    rest = [c for c in pooled.columns if c not in keys and c != "__p"]
    return percentiles(pooled, [k for k in keys if k != "hand_id"], keys, ["__p"], keep=rest).withColumnRenamed(
        "pct___p", "pct_max_z")


TOP_FIELDS = ["street", "y", "facing", "rel", "partner_live", "amount_bb", "actor_won", "players_active"]


def action_score_aggregates(rows: DataFrame, score: str, keys: list[str] = [*PAIR, "hand_id"], high: float = 1.5, fields: list[str] = TOP_FIELDS) -> DataFrame:
    """Hand-level summary of action scores, with the number above `high`, and the fields of the highest-scored action."""
    s = F.col(score)
    zero = F.lit(0.0)
    order = F.struct(F.round(s, 6), -F.col("action_no"), -F.col("player_id"))
    best = F.max_by(F.struct(*fields), order)
    out = rows.groupBy(*keys).agg(
        F.max(s).alias("act_max"), F.sum(s).alias("act_sum"), F.avg(s).alias("act_mean"),
        F.sum(as_int(s > high)).alias("act_n_high"),
        F.coalesce(F.max(F.when(F.col("street") == 0, s)), zero).alias("act_max_first"),
        F.coalesce(F.max(F.when(F.col("street") > 0, s)), zero).alias("act_max_later"),
        F.coalesce(F.max(F.when(F.col("partner_live") == 1, s)), zero).alias("act_max_partner_live"),
        best.alias("top"))
    second = top_rows(rows.select(*keys, "action_no", "player_id", score), keys,
                      [s.desc(), F.col("action_no"), F.col("player_id")], 2)
    second = second.groupBy(*keys).agg(F.min(s).alias("act_second"))
    return out.join(second, keys).select(
        *keys, "act_max", "act_sum", "act_mean", "act_n_high", "act_max_first", "act_max_later",
        "act_max_partner_live", "act_second", *[F.col(f"top.{f}").alias(f"top_{f}") for f in fields])


def fold_audit(rows: DataFrame, keys: dict[str, list[str]]) -> DataFrame:
    """How many groups of each kind appear in more than one fold; every count must be zero."""
    out = None
    for name, cols in keys.items():
        spans = rows.groupBy(*cols).agg(F.min("fold").alias("a"), F.max("fold").alias("b"))
        row = spans.agg(F.lit(name).alias("what"), F.count("*").alias("groups"),
                        F.coalesce(F.sum(as_int(F.col("a") != F.col("b"))), F.lit(0)).cast("bigint")
                        .alias("spanning"))
        out = row if out is None else out.unionByName(row)
    return out


def fold_census(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Rows, positives and nulls per fold."""
    return rows.groupBy("fold").agg(
        F.count("*").alias("rows"), F.sum(as_int(F.col("bag_label") == 1)).alias("positives"),
        F.sum(as_int(F.col("bag_label") == -1)).alias("censored"),
        *[F.sum(as_int(F.col(c).isNull())).alias(f"null_{c}") for c in columns])


def seed_bag(blocks: list[DataFrame], keys: list[str], columns: list[str]) -> DataFrame:
    """Mean of the same columns over several seeds, key by key."""
    both = blocks[0].select(*keys, *columns)
    for b in blocks[1:]:
        both = both.unionByName(b.select(*keys, *columns))
    return both.groupBy(*keys).agg(*[F.avg(c).alias(c) for c in columns])


def placebo(block: DataFrame, columns: list[str], seed: str) -> DataFrame:
    """Each pair receives another pair's block, repeated or cut to its own length.

    Pairs are numbered in key order and in a seeded order; the pair at a place of
    the first order takes the block of the pair at the same place of the second.
    Numbering is done on one row per pair.
    """
    numbered = settle(row_numbers(block, PAIR, [F.col("started_at"), F.col("hand_id")],
                                  time_segment("started_at", 7 * 86_400), "rn"))
    sizes = block.groupBy(*PAIR).agg(F.count("*").alias("len"))
    shuffled = sizes.withColumn("__h", md5_key(*PAIR, F.lit(seed)))
    head = F.conv(F.substring("__h", 1, 4), 16, 10).cast("bigint")
    one = F.lit(1)
    by_hash = settle(row_numbers(shuffled.withColumn("__k", one), ["__k"],
                                 [F.col("__h"), *[F.col(c) for c in PAIR]], head, "place"))
    # The next pair in the shuffled circle lends its block: never the pair itself when there are two or more.
    total = sizes.agg(F.count("*").alias("pairs"))
    giver = by_hash.select("place", F.col("len").alias("g_len"), *[F.col(c).alias(f"g_{c}") for c in PAIR])
    taker = by_hash.join(F.broadcast(total)).select(
        *PAIR, (F.pmod(F.col("place"), F.col("pairs")) + 1).alias("place"))
    match = taker.join(giver, "place").drop("place")
    lent = numbered.select(*[F.col(c).alias(f"g_{c}") for c in PAIR], F.col("rn").alias("g_rn"), *columns)
    d = (numbered.select(*PAIR, "hand_id", "rn").join(match, PAIR)
         .withColumn("g_rn", F.pmod(F.col("rn") - 1, F.col("g_len")) + 1))
    return d.join(lent, [*[f"g_{c}" for c in PAIR], "g_rn"]).select(*PAIR, "hand_id", *columns)


def refine_instances(rows: DataFrame, score: str, m: int) -> DataFrame:
    """The m best instances of every positive bag; all instances of the others."""
    keys = [*PAIR, "hand_id"]
    w = Window.partitionBy(*keys).orderBy(F.col(score).desc(), "action_no", "player_id")
    kept = (rows.where(F.col("bag_label") == 1).withColumn("__r", F.row_number().over(w))
            .where(F.col("__r") <= m).drop("__r"))
    return kept.unionByName(rows.where(F.col("bag_label") != 1))


def pseudo_label(scores: DataFrame, threshold: float, mode: str = "hard") -> DataFrame:
    """Unlabelled pairs above a score become positives, with weight one or with their score."""
    picked = (F.col("label") == -1) & (F.col("score") >= F.lit(threshold))
    weight: Column = F.when(picked, F.col("score") if mode == "soft" else F.lit(1.0))
    return scores.withColumns({
        "train_label": F.when(picked, 1).otherwise(F.col("label")),
        "train_weight": F.coalesce(weight, F.when(F.col("label") == -1, 0.3).otherwise(1.0))})
