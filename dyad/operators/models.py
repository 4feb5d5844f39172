"""Model jobs on pyspark.ml: the driver loops over folds, executors fit and score."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import Estimator
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dyad.functions.cols import FAMILIES, KINDS, as_int
from dyad.functions.ordered import top_rows
from dyad.operators.pairs import PAIR
from dyad.operators.retrieval import borda, entropy, shortlist_pairs, under_compared
from dyad.operators.softmax import held_out_losses
from dyad.session import settle

SEED = 7


def with_features(df: DataFrame, features: list[str]) -> DataFrame:
    filled = df.withColumns({f"__f_{c}": F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in features})
    names = [f"__f_{c}" for c in features]
    return VectorAssembler(inputCols=names, outputCol="features").transform(filled).drop(*names)


def class_probabilities(n: int) -> list[Column]:
    p = vector_to_array("probability")
    return [F.coalesce(F.get(p, F.lit(i)), F.lit(0.0)).alias(f"prob{i}") for i in range(n)]


def crossfit(df: DataFrame, make: Callable[[], Estimator], features: list[str], label: str, keep: list[str],
             classes: int, folds: int = 5, usable: Column | None = None) -> DataFrame:
    """Every row of a fold scored by a model that never saw that fold.

    `usable` restricts training rows (for instance to labelled ones); rows with a
    null ``fold`` get the mean of the fold models. Where no row outside a fold can be learnt from,
    the fold's rows have null scores: a model is never asked about rows it was trained on.
    """
    d = settle(with_features(df.withColumn("fold", F.pmod("fold", F.lit(folds)).cast("int")), features))
    ok = F.col(label).isNotNull() if usable is None else usable & F.col(label).isNotNull()
    nothing = [F.lit(None).cast("double").alias(f"prob{i}") for i in range(classes)]
    out, loose, models = None, d.where(F.col("fold").isNull()), []
    for k in range(folds):
        train = d.where(ok & (F.col("fold") != k))
        own = d.where(F.col("fold") == k)
        if train.isEmpty():
            part = own.select(*keep, "fold", *nothing)
        else:
            model = make().fit(train)
            part = model.transform(own).select(*keep, "fold", *class_probabilities(classes))
            # Rows without a fold pass through one model after the other: none is copied or moved.
            loose = model.transform(loose).withColumn(f"__p{k}", vector_to_array("probability")).drop("rawPrediction", "probability", "prediction")
            models.append(k)
        out = part if out is None else out.unionByName(part)
    given = [[F.coalesce(F.get(f"__p{k}", F.lit(i)), F.lit(0.0)) for k in models] for i in range(classes)]
    mean = [(sum(g[1:], g[0]) / len(g)).alias(f"prob{i}") for i, g in enumerate(given)] if models else nothing
    return out.unionByName(loose.select(*keep, "fold", *mean))


def crossfit_nested(df: DataFrame, make: Callable[[], Estimator], features: list[str], label: str,
                    keep: list[str], classes: int, folds: int = 3) -> DataFrame:
    """Scores for a consumer that itself trains per fold.

    A row in fold j, read by consumer fold k, is scored by a model trained on
    neither; models are shared between (j, k) and (k, j). Without rows in a third fold the score is null.
    """
    d = df.withColumn("fold", F.pmod("fold", F.lit(folds)).cast("int"))
    d = settle(with_features(d, features).where(F.col(label).isNotNull()))
    fitted: dict[frozenset, object] = {}
    out = None
    for outer in range(folds):
        for inner in range(folds):
            left_out = frozenset((outer, inner))
            if left_out not in fitted:
                train = d.where(~F.col("fold").isin(*left_out))
                fitted[left_out] = None if train.isEmpty() else make().fit(train)
            own, model = d.where(F.col("fold") == inner), fitted[left_out]
            scores = [F.lit(None).cast("double").alias(f"prob{i}") for i in range(classes)] if model is None else class_probabilities(classes)
            part = (own if model is None else model.transform(own)).select(*keep, "fold", F.lit(outer).alias("outer_fold"), *scores)
            out = part if out is None else out.unionByName(part)
    return out


def forest(label: str, weight: str | None = None, trees: int = 20, depth: int = 5) -> Callable[[], Estimator]:
    def make() -> Estimator:
        m = RandomForestClassifier(labelCol=label, featuresCol="features", numTrees=trees, maxDepth=depth, seed=SEED)
        return m.setWeightCol(weight) if weight else m
    return make


def boosted(label: str, weight: str | None = None, rounds: int = 10, depth: int = 3) -> Callable[[], Estimator]:
    def make() -> Estimator:
        m = GBTClassifier(labelCol=label, featuresCol="features", maxIter=rounds, maxDepth=depth, seed=SEED)
        return m.setWeightCol(weight) if weight else m
    return make


def logistic(label: str, family: str = "auto", iterations: int = 20) -> Callable[[], Estimator]:
    return lambda: LogisticRegression(labelCol=label, featuresCol="features", maxIter=iterations,
                                      regParam=1e-3, family=family)


POLICY_FEATURES = ["street", "strength", "n_agg_hand", "n_agg_st", "own_agg_before", "players_active",
                   "to_call", "pot_before", "self_last_agg"]


def policy_model(actions: DataFrame, folds: int = 2) -> DataFrame:
    """P(kind | state) by a multinomial model, each half of the tables scored by the other."""
    d = actions.withColumn("label", F.col("y").cast("double"))
    scored = crossfit(d, logistic("label", "multinomial"), POLICY_FEATURES, "label",
                      ["hand_id", "action_no", "y"], 5, folds)
    return with_observed(scored)


def with_observed(scored: DataFrame) -> DataFrame:
    p = F.element_at(F.array(*[F.col(f"prob{i}") for i in range(5)]), F.col("y") + 1)
    return scored.withColumn("surp", -F.log(F.greatest(p, F.lit(1e-9))))


OPPONENT_FEATURES = {
    "plain": ["street", "strength", "players_active", "pot_before", "live_opponents"],
    "no_style": ["street", "strength", "players_active", "pot_before", "live_opponents", "opp_str", "rel",
                 "facing_n", "opp_seat"],
    "full": ["street", "strength", "players_active", "pot_before", "live_opponents", "opp_str", "rel",
             "facing_n", "opp_seat", "opp_fold_rate", "opp_aggression_rate"]}


def opponent_policy(x: DataFrame, style: DataFrame, variants: list[str], folds: int = 2) -> DataFrame:
    """Held-out log-loss of the policy on (action, live opponent) rows, per feature set.

    Styles have one row per player and phase and are joined by key. All variants and folds are fitted side by side.
    """
    s = style.select("phase", F.col("player_id").alias("opp"), F.col("fold_rate").alias("opp_fold_rate"),
                     F.col("aggression_rate").alias("opp_aggression_rate"))
    d = x.join(s, ["phase", "opp"], "left").withColumn("facing_n", as_int(F.col("facing")))
    found = held_out_losses(d, {v: OPPONENT_FEATURES[v] for v in variants}, F.col("y"), F.col("fold"), len(KINDS) - 1, folds)
    return x.sparkSession.createDataFrame([(v, *found[v]) for v in variants], "variant string, n bigint, log_loss double")


def size_model(actions: DataFrame, folds: int = 2) -> DataFrame:
    """Expected bet size of aggressive actions, out of fold, and the standardised residual; null without other folds."""
    d = actions.where(F.col("y") >= 3).withColumn(
        "label", F.log1p(F.col("amount") / F.greatest(F.col("pot_before"), F.lit(1).cast("bigint"))))
    d = settle(with_features(d.withColumn("fold", F.pmod("fold", F.lit(folds)).cast("int")), POLICY_FEATURES))
    out = None
    for k in range(folds):
        train = d.where(F.col("fold") != k)
        own = d.where(F.col("fold") == k)
        if train.isEmpty():
            part = own.select("hand_id", "action_no", "label", F.lit(None).cast("double").alias("prediction"))
        else:
            m = GBTRegressor(labelCol="label", featuresCol="features", maxIter=8, maxDepth=3, seed=SEED).fit(train)
            part = m.transform(own).select("hand_id", "action_no", "label", "prediction")
        out = part if out is None else out.unionByName(part)
    out = out.withColumn("resid", F.col("label") - F.col("prediction"))
    sd = out.agg(F.stddev_samp("resid").alias("sd"))
    return out.join(F.broadcast(sd)).withColumn("size_z", F.col("resid") / F.col("sd")).drop("sd")


HAND_FEATURES = ["transfer_gross", "pair_surprise", "surprise_vs_partner", "fold_vs_partner", "call_vs_partner",
                 "aggr_vs_partner", "contact", "transfer_event", "ahead_fold", "donor_weakness",
                 "receiver_weakness", "surprise_imbalance", "outsider_clear_rate", "pot_bb", "abs_net_gap"]


def hand_scorer(hands: DataFrame, folds: int = 5) -> DataFrame:
    """P(hand belongs to the pair's evidence), any family, out of fold. Needs ``bag_label``."""
    d = hands.withColumn("label", F.when(F.col("bag_label") >= 0, F.col("bag_label").cast("double")))
    return crossfit(d, forest("label"), HAND_FEATURES, "label", [*PAIR, "hand_id"], 2, folds).withColumnRenamed(
        "prob1", "score").drop("prob0")


def family_hand_scorer(hands: DataFrame, folds: int = 5) -> DataFrame:
    """Four classes: none and the three families; one probability column per family."""
    index = F.array_position(F.array(*[F.lit(f) for f in FAMILIES]), F.col("family")).cast("double")
    d = hands.withColumn("label", F.when(F.col("bag_label") == 1, index).when(F.col("bag_label") == 0, 0.0))
    scored = crossfit(d, forest("label"), HAND_FEATURES, "label", [*PAIR, "hand_id"], 4, folds)
    return scored.withColumnsRenamed({f"prob{i + 1}": f"score_{f}" for i, f in enumerate(FAMILIES)}).drop("prob0")


ACTION_FEATURES = ["street", "y", "strength", "rel", "surp", "facing", "partner_live", "partner_acted_before",
                   "partner_aggr_before", "partner_acts_after", "players_active", "amount_bb", "invested_bb",
                   "turns_since_partner", "share_of_actions"]


# An action of an evidence hand weighs so much against one of any other hand.
TRIGGER_WEIGHT = 3.0


def action_scorer(rows: DataFrame, folds: int = 5) -> DataFrame:
    """P(action is a trigger), one model per family, with the label inherited from the bag.

    A family's model learns from the positive pairs of that family, evidence hands against their other hands, and from all
    negative pairs; it scores the rows whose pair has it as ``rule_family``. A bag shares its weight among its actions.
    Rows without a bag label are scored only, those without a fold by the mean of the fold models.
    """
    taught = rows.where(F.col("bag_label").isNotNull())
    size = taught.groupBy(*PAIR, "hand_id").agg(F.count("*").alias("bag_rows"))
    trigger = F.col("bag_label") == 1
    d = taught.join(size, [*PAIR, "hand_id"]).unionByName(
        rows.where(F.col("bag_label").isNull()), allowMissingColumns=True)
    d = d.withColumns({"label": F.when(F.col("bag_label").isNotNull(), F.when(trigger, 1.0).otherwise(0.0)),
                       "w": F.when(trigger, TRIGGER_WEIGHT).otherwise(1.0) / F.col("bag_rows")})
    keep = [*PAIR, "hand_id", "action_no", "player_id", "rule_family", "street", "y", "facing", "surp", "rel", "partner_live",
            "amount_bb", "actor_won", "players_active"]
    out = None
    for family in FAMILIES:
        own = F.col("rule_family") == family
        teaches = (F.col("bag_label") == 0) | (F.col("bag_label").isNotNull() & (F.col("family") == family))
        scored = crossfit(d.where(own | teaches), boosted("label", "w", rounds=5), ACTION_FEATURES, "label", keep, 2, folds, teaches).where(own)
        out = scored if out is None else out.unionByName(scored)
    return out.withColumnRenamed("prob1", "score").drop("prob0")


def pairwise_ranker(cands: DataFrame, features: list[str], top: int = 20, folds: int = 5) -> DataFrame:
    """Preference model on couples (evidence, other) inside a pair; score is the Borda mean.

    Couples are formed only inside the pair's `top` best hands. Every other hand has a row too, below
    these (-1 to -0.999), in the order of its score; one without a score is last.
    """
    best = top_rows(cands, PAIR, [F.col("score").desc(), F.col("hand_id")], top)
    couples = shortlist_pairs(best, [*features, "gold"])
    couples = couples.withColumns({"label": F.when(F.col("d_gold") > 0, 1.0).when(F.col("d_gold") < 0, 0.0),
                                   "fold": F.pmod("table_id", F.lit(folds)).cast("int")})
    cols = [f"{p}_{c}" for c in features for p in ("a", "b", "d")]
    scored = crossfit(couples, logistic("label"), cols, "label", [*PAIR, "a_hand", "b_hand"], 2, folds)
    return under_compared(cands, borda(scored.withColumnRenamed("prob1", "win"), "win"))


# Fixed class weights: positive, negative, unlabelled.
RISK_WEIGHTS = (10.0, 1.0, 0.3)


def pair_risk(pairs: DataFrame, features: list[str], folds: int = 5,
              weights: tuple[float, float, float] = RISK_WEIGHTS) -> DataFrame:
    """Risk of every pair; unlabelled pairs train as weak negatives with their own weight."""
    pos, neg, unknown = weights
    d = pairs.withColumns({
        "y": as_int(F.col("label") == 1).cast("double"),
        "w": F.when(F.col("label") == 1, pos).when(F.col("label") == 0, neg).otherwise(unknown)})
    d = d.where(F.col("w") > 0)
    return crossfit(d, boosted("y", "w"), features, "y", [*PAIR, "label"], 2, folds).withColumnRenamed(
        "prob1", "risk").drop("prob0")


def behaviour_model(pairs: DataFrame, features: list[str], folds: int = 5, held_out: str | None = None) -> DataFrame:
    """Family probabilities from the positives, with the arg-max and its entropy.

    `held_out` leaves one family out of training.
    """
    index = F.array_position(F.array(*[F.lit(f) for f in FAMILIES]), F.col("family")).cast("double") - 1
    usable = F.col("label") == 1
    if held_out:
        usable = usable & (F.col("family") != held_out)
    d = pairs.withColumn("y", F.when(F.col("label") == 1, index))
    s = crossfit(d, lambda: forest("y", trees=10)(), features, "y", [*PAIR], len(FAMILIES), folds, usable)
    probs = [f"prob{i}" for i in range(len(FAMILIES))]
    best = F.greatest(*probs)
    pick = F.lit(FAMILIES[-1])
    for i in range(len(FAMILIES) - 2, -1, -1):
        pick = F.when(F.col(probs[i]) == best, FAMILIES[i]).otherwise(pick)
    return s.withColumns({"predicted": pick, "certainty": best, "entropy": entropy(probs)})
