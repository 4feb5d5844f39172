"""From scores to a result table: evidence, ties, blends, splices, checks and comparisons."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dyad.functions.cols import FAMILIES, NO_EVIDENCE, as_int
from dyad.functions.ordered import (magnitude_segment, nearest_positions, order_values, percentiles, row_numbers, top_rows,
                                    value_ranks)
from dyad.operators.pairs import PAIR
from dyad.session import settle

SLOTS = [f"evidence_hand_{i}" for i in range(1, 6)]


def top_picks(scored: DataFrame, k: int = 5, key: list[str] = PAIR) -> DataFrame:
    """Long form of the k best hands, with a 1-based ``slot``."""
    return top_rows(scored, key, [F.col("score").desc(), F.col("hand_id")], k, "slot")


def top_evidence(pairs: DataFrame, scored: DataFrame, k: int = 5, key: list[str] = PAIR) -> DataFrame:
    """One row per pair of the template, its best hands in columns, empty slots filled."""
    wide = top_picks(scored, k, key).groupBy(*key).agg(
        *[F.max(F.when(F.col("slot") == i + 1, F.col("hand_id"))).alias(SLOTS[i]) for i in range(k)])
    return pairs.join(wide, key, "left").fillna(NO_EVIDENCE, subset=SLOTS[:k])


def tie_break(df: DataFrame, risk: str, activity: str, weight: float = 1e-6) -> DataFrame:
    """A deterministic nudge by activity, then clipped to [0, 1]."""
    span = df.agg(F.min(activity).alias("__lo"), F.max(activity).alias("__hi"))
    d = df.join(F.broadcast(span))
    part = (F.col(activity) - F.col("__lo")) / F.greatest(F.col("__hi") - F.col("__lo"), F.lit(1))
    nudged = F.col(risk) + F.lit(weight) * part
    return d.withColumn("risk_score", F.least(F.greatest(nudged, F.lit(0.0)), F.lit(1.0))).drop("__lo", "__hi")


def splice(base: DataFrame, other: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """`base` with `columns` taken from `other`; the key sets must agree."""
    fresh = other.select(*key, *[F.col(c).alias(f"__{c}") for c in columns], F.lit(True).alias("__seen"))
    d = base.join(fresh, key, "left")
    known = F.when(F.col("__seen"), True).otherwise(F.raise_error(F.lit("splice: key missing")).cast("boolean"))
    keep = [F.col(f"__{c}").alias(c) if c in columns else F.col(c) for c in base.columns]
    return d.where(known).select(*keep)


def changed_elsewhere(before: DataFrame, after: DataFrame, columns: list[str]) -> DataFrame:
    """Rows whose columns outside the spliced ones differ; must be empty."""
    rest = [c for c in before.columns if c not in columns]
    return before.select(*rest).exceptAll(after.select(*rest))


def _check(name: str, bad: Column) -> Column:
    return F.struct(F.lit(name).alias("rule"), bad.cast("bigint").alias("n_bad"))


def validate(result: DataFrame, template: DataFrame, hands: DataFrame, seats: DataFrame,
             phase: str = "evaluation", columns: list[str] | None = None) -> DataFrame:
    """One row per rule with the number of rows that break it.

    `result` has pair_id, p1, p2, risk_score, predicted_behavior and five slots. `columns` must stand in it in this order (others
    may stand between): the rule counts those that are missing or come too early. The row count is held against the template's.
    """
    wanted = columns or ["pair_id", "risk_score", "predicted_behavior", *SLOTS]
    places = [result.columns.index(c) if c in result.columns else -1 for c in wanted]
    misplaced = sum(p <= max(places[:i], default=-1) for i, p in enumerate(places))
    vocabulary = ["none", *FAMILIES, "other_coordination"]
    copies = result.groupBy("pair_id").agg(F.count("*").alias("copies"))
    r = result.join(copies, "pair_id")
    slots = F.filter(F.array(*[F.col(s) for s in SLOTS]), lambda x: x != NO_EVIDENCE)
    row_checks = r.agg(F.array(
        _check("duplicate_pair", F.sum(as_int(F.col("copies") > 1))),
        _check("null_value", F.sum(as_int(F.col("risk_score").isNull() | F.col("predicted_behavior").isNull()))),
        _check("risk_out_of_range", F.sum(as_int((F.col("risk_score") < 0) | (F.col("risk_score") > 1)))),
        _check("unknown_behaviour", F.sum(as_int(~F.col("predicted_behavior").isin(vocabulary)))),
        _check("repeated_evidence", F.sum(as_int(F.size(slots) != F.size(F.array_distinct(slots))))),
        _check("column_order", F.lit(misplaced)),
        _check("constant_risk", as_int(F.min("risk_score") == F.max("risk_score"))),
    ).alias("c")).select(F.explode("c").alias("c")).select("c.*")
    missing = template.join(result, "pair_id", "left_anti").agg(_check("missing_pair", F.count("*")).alias("c"))
    extra = result.join(template, "pair_id", "left_anti").agg(_check("unexpected_pair", F.count("*")).alias("c"))
    sizes = result.agg(F.count("*").alias("n")).join(F.broadcast(template.agg(F.count("*").alias("m"))))
    missing = missing.unionByName(sizes.select(_check("row_count", F.abs(F.col("n") - F.col("m"))).alias("c")))
    cited = (result.select("p1", "p2", F.explode(F.array(*[F.col(s) for s in SLOTS])).alias("hand_id"))
             .where(F.col("hand_id") != NO_EVIDENCE))
    known = cited.join(hands.select("hand_id", F.col("phase").alias("__ph")), "hand_id", "left")
    for p in ("p1", "p2"):
        here = seats.select("hand_id", F.col("player_id").alias(p), F.lit(1).alias(f"__{p}"))
        known = known.join(here, ["hand_id", p], "left")
    cited_checks = known.agg(F.array(
        _check("unknown_hand", F.sum(as_int(F.col("__ph").isNull()))),
        _check("wrong_phase", F.sum(as_int(F.col("__ph") != phase))),
        _check("actor_not_seated", F.sum(as_int(F.col("__p1").isNull() | F.col("__p2").isNull()))),
    ).alias("c")).select(F.explode("c").alias("c")).select("c.*")
    out = (row_checks.unionByName(missing.select("c.*")).unionByName(extra.select("c.*"))
           .unionByName(cited_checks).withColumn("n_bad", F.coalesce("n_bad", F.lit(0).cast("bigint"))))
    return out.withColumn("ok", as_int(F.col("n_bad") == 0))


def table_diff(a: DataFrame, b: DataFrame, key: str, columns: list[str], score: str, ks: list[int]) -> DataFrame:
    """Rows changed per column, rank correlation of the score, overlap of the top k."""
    bb = b.select(key, *[F.col(c).alias(f"__{c}") for c in columns])
    d = settle(a.select(key, *columns).join(bb, key))
    changed = d.agg(F.array(*[
        F.struct(F.lit(f"changed_{c}").alias("metric"),
                 F.sum(as_int(~F.col(c).eqNullSafe(F.col(f"__{c}")))).cast("double").alias("value"))
        for c in columns]).alias("m")).select(F.explode("m").alias("m")).select("m.*")
    both = d.select(key, F.col(score).alias("x"), F.col(f"__{score}").alias("y")).withColumn("__k", F.lit(1))
    ranks = percentiles(both, ["__k"], ["__k", key], ["x", "y"])
    rho = ranks.agg(F.lit("spearman").alias("metric"), F.corr("pct_x", "pct_y").alias("value"))
    out = changed.unionByName(rho)
    most = max(ks)
    ta = top_rows(both, ["__k"], [F.col("x").desc(), F.col(key)], most, "ra").select(key, "ra")
    tb = top_rows(both, ["__k"], [F.col("y").desc(), F.col(key)], most, "rb").select(key, "rb")
    shared = ta.join(tb, key)
    for k in ks:
        out = out.unionByName(shared.agg(
            F.lit(f"top{k}_overlap").alias("metric"),
            (F.coalesce(F.sum(as_int((F.col("ra") <= k) & (F.col("rb") <= k))), F.lit(0)) / F.lit(float(k)))
            .alias("value")))
    return out


def rank_blend(df: DataFrame, key: list[str], ident: list[str], weights: dict[str, float],
               out: str = "blend", short: bool = False) -> DataFrame:
    """Weighted mean of percentile ranks inside each key; `short` as in `percentiles`."""
    pct = percentiles(df, key, ident, list(weights), short=short)
    total = sum(weights.values())
    mixed = None
    for c, w in weights.items():
        part = F.col(f"pct_{c}") * (w / total)
        mixed = part if mixed is None else mixed + part
    return pct.withColumn(out, mixed)


def routed_blend(df: DataFrame, key: list[str], ident: list[str], pooled: str, specialists: dict[str, str],
                 probabilities: dict[str, str], weight: float = 0.5) -> DataFrame:
    """Specialist ranks weighted by family probability, mixed with the pooled rank."""
    d = percentiles(df, key, ident, [pooled, *specialists.values()], keep=list(probabilities.values()))
    soft = F.lit(0.0)
    for f, c in specialists.items():
        soft = soft + F.col(probabilities[f]) * F.col(f"pct_{c}")
    return d.withColumn("routed", weight * soft + (1.0 - weight) * F.col(f"pct_{pooled}"))


def tail_depth(rank: Column, n: Column) -> Column:
    """Percentile to top-tail depth, 0 .. log10(n)."""
    return -F.log10(F.lit(1.0) - rank + F.lit(1.0) / n)


def tail_guard(df: DataFrame, key: list[str], ident: list[str], model: str, generic: str, margin: float) -> DataFrame:
    """The model's tail depth, never further than `margin` below the generic score's."""
    pct = percentiles(df, key, ident, [model, generic])
    n = df.groupBy(*key).agg(F.count("*").alias("__n"))
    d = pct.join(n, key)
    return d.withColumn("guarded", F.greatest(tail_depth(F.col(f"pct_{model}"), F.col("__n")),
                                              tail_depth(F.col(f"pct_{generic}"), F.col("__n")) - margin)).drop("__n")


def entropy(probabilities: list[str]) -> Column:
    out = F.lit(0.0)
    for p in probabilities:
        out = out - F.col(p) * F.log(F.col(p) + 1e-9)
    return out


def route_other(pairs: DataFrame, risk: str, probabilities: dict[str, str], q: float, ident: list[str], k: int) -> DataFrame:
    """Family of the largest probability; of the `k` riskiest pairs, those whose out-of-family score reaches
    the q quantile among these go to `other_coordination`. Pairs further down keep their family.

    The score is the rank of the risk, scaled to [0, 1), times what the best family leaves open. Every pair has a row.
    """
    ps = list(probabilities.values())
    best = F.greatest(*[F.col(p) for p in ps])
    names = list(probabilities)
    pick = F.lit(names[-1])
    for f in reversed(names[:-1]):
        pick = F.when(F.col(probabilities[f]) == best, F.lit(f)).otherwise(pick)
    d = pairs.withColumns({"__k": F.lit(1), "__neg": -F.col(risk).cast("double"), "family_argmax": pick})
    d = row_numbers(d, ["__k"], [F.col("__neg"), *ident], magnitude_segment("__neg"), "__place")
    d = d.join(F.broadcast(pairs.agg(F.count("*").alias("__n"))))
    ranked = (F.col("__n") - F.col("__place")) / F.col("__n")
    d = settle(d.withColumn("ood", F.round(ranked * (1.0 - best) * (1.0 + 0.2 * entropy(ps)), 9)).select(
        "__k", *ident, "__place", "ood", "family_argmax"))
    cut = order_values(d.where(F.col("__place") <= k), ["__k"], "ood", {"cut": nearest_positions(q)})
    out = (F.col("__place") <= k) & (F.col("ood") >= F.col("cut"))
    return d.join(F.broadcast(cut), "__k", "left").select(
        *ident, "ood", "family_argmax", F.when(out, "other_coordination").otherwise(F.col("family_argmax")).alias("routed"))


def shortlist_pairs(best: DataFrame, features: list[str], key: list[str] = PAIR) -> DataFrame:
    """Ordered couples of a pair's shortlist with both blocks and their difference.

    `best` must already be cut to a fixed number of hands per pair.
    """
    a = best.select(*key, F.col("hand_id").alias("a_hand"), *[F.col(c).alias(f"a_{c}") for c in features])
    b = best.select(*key, F.col("hand_id").alias("b_hand"), *[F.col(c).alias(f"b_{c}") for c in features])
    d = a.join(b, key).where(F.col("a_hand") != F.col("b_hand"))
    return d.withColumns({f"d_{c}": F.col(f"a_{c}") - F.col(f"b_{c}") for c in features})


def borda(couples: DataFrame, prob: str, key: list[str] = PAIR) -> DataFrame:
    """Average win probability of a hand against the others, both directions of each couple."""
    won = couples.groupBy(*key, F.col("a_hand").alias("hand_id")).agg(
        F.sum(prob).alias("won"), F.count("*").alias("seen"))
    lost = couples.groupBy(*key, F.col("b_hand").alias("hand_id")).agg(F.sum(prob).alias("lost"))
    return won.join(lost, [*key, "hand_id"]).select(
        *key, "hand_id", (0.5 * (F.col("won") / F.col("seen") + 1.0 - F.col("lost") / F.col("seen")))
        .alias("borda"))


def under_compared(hands: DataFrame, compared: DataFrame, key: list[str] = PAIR) -> DataFrame:
    """Every hand with its ``borda``; one that was not compared stands below all others (-1 to -0.999), by its ``score``.

    A hand without a score comes last.
    """
    listwise = value_ranks(hands, key, "score").select(*key, "score", ((F.col("below") + (F.col("ties") + 1) / 2) / F.col("n")).alias("__place"))
    d = hands.select(*key, "hand_id", "score").join(listwise, [*key, "score"], "left").join(compared, [*key, "hand_id"], "left")
    return d.select(*key, "hand_id", F.coalesce("borda", -1.0 + 1e-3 * F.coalesce("__place", F.lit(0.0))).alias("borda"))


def compare_best(hands: DataFrame, top: int, features: list[str], win: Callable, key: list[str] = PAIR, short: bool = False) -> DataFrame:
    """Every hand with its ``borda``: the mean chance of the key's `top` best by ``score`` against one another; others stand below.

    ``win(a, b)`` gives the chance of hand a against hand b from their `features`, by name. `short` says that no key is longer than
    a block of rows: then the best of a key are gathered beside its hands (at most `top`), and couples make no rows.
    """
    if not short:
        best = top_rows(hands, key, [F.col("score").desc(), F.col("hand_id")], top)
        side = lambda p: {c: F.col(f"{p}_{c}") for c in features}
        couples = shortlist_pairs(best, features, key).withColumn("win", win(side("a"), side("b")))
        return under_compared(hands, borda(couples, "win", key), key).join(hands.select(*key, "hand_id", "score"), [*key, "hand_id"])
    every = Window.partitionBy(*key)
    order = every.orderBy(F.col("score").asc_nulls_last())
    ties = F.count("*").over(order.rangeBetween(Window.currentRow, Window.currentRow))
    place = F.when(F.col("score").isNotNull(), (F.rank().over(order) - 1 + (ties + 1) / 2) / F.count("score").over(every))
    own = F.struct("hand_id", *features)
    d = hands.select(*key, "hand_id", "score", *[c for c in features if c != "score"]).withColumns({
        "__rank": F.row_number().over(every.orderBy(F.col("score").desc(), "hand_id")), "__place": place})
    d = d.withColumn("__others", F.collect_list(F.when(F.col("__rank") <= top, own)).over(every))
    others = F.filter("__others", lambda o: o["hand_id"] != F.col("hand_id"))
    seen = F.size(others)

    def mean(chance: Callable) -> Column:
        known = F.filter(F.transform(others, chance), lambda x: x.isNotNull())
        return F.when(F.size(known) > 0, F.aggregate(known, F.lit(0.0), lambda acc, x: acc + x)) / seen

    won = F.when(F.col("__rank") <= top, 0.5 * (mean(lambda o: win(own, o)) + 1.0 - mean(lambda o: win(o, own))))
    return d.select(*key, "hand_id", "score", F.coalesce(won, -1.0 + 1e-3 * F.coalesce("__place", F.lit(0.0))).alias("borda"))
