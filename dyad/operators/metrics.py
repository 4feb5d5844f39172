"""Ranking metrics over keyed DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dyad.functions.cols import FAMILIES, as_int, md5_key
from dyad.functions.ordered import (ident_segment, magnitude_segment, melt, percentiles, row_numbers, running,
                                    top_rows)
from dyad.operators.sweeps import lanes, mixture_sweep, precision_sweep, resampled
from dyad.session import settle

UNSCORED = 1.7e308  # as a negated score: behind every other

# Fixed weights of the composite score.
WEIGHTS = {"pair": 0.70, "evidence": 0.20, "behaviour": 0.10}


def average_precision(df: DataFrame, score: str, y: str, ident: str, by: list[str] | None = None,
                      weight: str | None = None) -> DataFrame:
    """Mean precision at the positives, ordered by (score desc, id asc); zero without positives.

    Distinct scores are ordered first, then the rows tied at a score by id, so
    one global ranking needs no single-task sort even when most scores are equal.
    `weight` repeats a row that many times. A row without a score comes last and counts like any other.
    """
    keys = by or ["__all"]
    d = df if by else df.withColumn("__all", F.lit(1))
    w = F.col(weight).cast("bigint") if weight else F.lit(1).cast("bigint")
    d = d.withColumns({"__neg": F.coalesce(-F.col(score).cast("double"), F.lit(UNSCORED)), "__y": as_int(F.col(y) == 1), "__w": w})
    by_score = d.groupBy(*keys, "__neg").agg(F.sum("__w").alias("n"), F.sum(F.col("__w") * F.col("__y")).alias("h"))
    above = running(by_score, keys, ["__neg"], {"__n0": ("sum", F.col("n")), "__h0": ("sum", F.col("h"))},
                    segment=magnitude_segment("__neg")).select(*keys, "__neg", "__n0", "__h0")
    d = running(d, [*keys, "__neg"], [ident], {
        "__n1": ("sum", F.col("__w")), "__h1": ("sum", F.col("__w") * F.col("__y"))},
        segment=ident_segment(d, ident)).join(above, [*keys, "__neg"])
    d = d.withColumns({"__rows": F.col("__n0") + F.col("__n1"), "__hits": F.col("__h0") + F.col("__h1")})
    gain = (F.col("__hits") + 1) / (F.col("__rows") + 1)
    if weight:
        gain = F.aggregate(F.sequence(F.lit(1).cast("bigint"), F.col("__w")), F.lit(0.0),
                           lambda acc, j: acc + (F.col("__hits") + j) / (F.col("__rows") + j))
    hit = F.col("__y") == 1
    out = d.groupBy(*keys).agg(
        F.sum(F.col("__w")).alias("rows"), F.sum(F.col("__w") * F.col("__y")).alias("positives"),
        F.sum(F.when(hit, gain)).alias("__gain"))
    out = out.withColumn("ap", F.when(F.col("positives") > 0, F.col("__gain") / F.col("positives")).otherwise(0.0))
    return out.drop("__gain", "__all")


def map_at_k(picks: DataFrame, gold: DataFrame, targets: DataFrame, valid: DataFrame | None = None,
             k: int = 5, key: tuple[str, ...] = ("p1", "p2")) -> DataFrame:
    """Average precision at k per target, every target counted.

    `picks` has a 1-based ``slot``; a repeated or unknown hand is a miss.
    """
    keys = list(key)
    p = picks.where(F.col("slot") <= k)
    # At most k rows per target from here on.
    once = Window.partitionBy(*keys, "hand_id").orderBy("slot")
    p = p.withColumn("first", F.row_number().over(once) == 1)
    p = p.join(gold.select(*keys, "hand_id", F.lit(1).alias("is_gold")).distinct(), [*keys, "hand_id"], "left")
    hit = F.col("first") & (F.col("is_gold") == 1)
    if valid is not None:
        p = p.join(valid.select(*keys, "hand_id", F.lit(1).alias("is_valid")).distinct(),
                   [*keys, "hand_id"], "left")
        hit = hit & (F.col("is_valid") == 1)
    p = p.withColumn("hit", as_int(hit))
    upto = Window.partitionBy(*keys).orderBy("slot").rowsBetween(Window.unboundedPreceding, 0)
    p = p.withColumn("gain", F.col("hit") * F.sum("hit").over(upto) / F.col("slot"))
    gained = p.groupBy(*keys).agg(F.sum("gain").alias("gain"))
    size = gold.select(*keys, "hand_id").distinct().groupBy(*keys).agg(F.count("*").alias("n_gold"))
    return (targets.select(*keys).distinct().join(size, keys, "left").join(gained, keys, "left")
            .withColumn("ap", F.coalesce(F.col("gain") / F.least(F.col("n_gold"), F.lit(k)), F.lit(0.0)))
            .select(*keys, F.coalesce("n_gold", F.lit(0).cast("bigint")).alias("n_gold"), "ap"))


def mean_ap(per_target: DataFrame) -> DataFrame:
    return per_target.agg(F.count("*").alias("targets"), F.avg("ap").alias("map"))


def behaviour_ap(pairs: DataFrame, ident: str) -> DataFrame:
    """AP per family with the risk kept only where that family was predicted.

    Needs ``family``, ``predicted``, ``risk``. Every family is present in the result.
    """
    names = F.array(*[F.lit(f) for f in FAMILIES])
    d = pairs.withColumn("target_family", F.explode(names)).withColumns({
        "routed": F.when(F.col("predicted") == F.col("target_family"), F.col("risk")).otherwise(0.0),
        "is_target": as_int(F.col("family") == F.col("target_family"))})
    return average_precision(d, "routed", "is_target", ident, ["target_family"])


def composite_score(pair_ap: Column, evidence: Column, behaviour: Column) -> Column:
    return WEIGHTS["pair"] * pair_ap + WEIGHTS["evidence"] * evidence + WEIGHTS["behaviour"] * behaviour


def bootstrap_weights(groups: DataFrame, group: str, replicates: int, seed: str) -> DataFrame:
    """How often each group is drawn in each replicate of a whole-group resample.

    Draw d of replicate r takes the group numbered md5(seed, r, d) mod n: n draws
    per replicate from n groups, computed row by row on one row per group.
    """
    # One row per group; numbers follow the group's md5 order and need no global window task.
    ids = groups.select(group).distinct()
    head = F.conv(F.substring(md5_key(group), 1, 4), 16, 10).cast("bigint")
    numbered = row_numbers(ids.withColumns({"__k": F.lit(1), "__h": md5_key(group)}), ["__k"],
                           [F.col("__h"), F.col(group)], head, "no").select(group, "no")
    n = ids.agg(F.count("*").alias("n_groups"))
    draws = (numbered.join(F.broadcast(n))
             .withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1)))))
    digest = F.conv(F.substring(md5_key(F.lit(seed), "replicate", "no"), 1, 8), 16, 10).cast("bigint")
    drawn = draws.select("replicate", (F.pmod(digest, F.col("n_groups")) + 1).alias("no"))
    counts = drawn.groupBy("replicate", "no").agg(F.count("*").alias("w"))
    return counts.join(numbered, "no").select("replicate", group, "w")


def bootstrap_replicates(df: DataFrame, scores: tuple[str, str], y: str, ident: str, group: str,
                         replicates: int, seed: str) -> DataFrame:
    """AP of both scores in every replicate, on the same resampled groups."""
    weights = bootstrap_weights(df, group, replicates, seed)
    each = resampled(df.select(group, ident, y, *scores), {n: F.col(n) for n in scores}, y, ident, group, weights, replicates)
    out = each.groupBy("replicate").agg(*[F.max(F.when(F.col("name") == n, F.col("ap"))).alias(f"ap_{n}") for n in scores])
    return out.withColumn("delta", F.col(f"ap_{scores[1]}") - F.col(f"ap_{scores[0]}"))


def bootstrap_summary(replicates: DataFrame) -> DataFrame:
    """Mean difference, nearest-rank 95% interval and share of improving replicates."""
    ordered = Window.orderBy("delta", "replicate")
    n = Window.partitionBy()
    d = replicates.withColumns({"i": F.row_number().over(ordered) - 1, "n": F.count("*").over(n)})

    def at(q: float) -> Column:
        return F.max(F.when(F.col("i") == F.floor(F.lit(q) * (F.col("n") - 1) + 0.5), F.col("delta")))

    return d.agg(F.avg("delta").alias("mean_delta"), at(0.025).alias("low"), at(0.975).alias("high"),
                 F.avg(as_int(F.col("delta") > 0)).alias("p_improves"))


def recall_at(picks: DataFrame, gold: DataFrame, ks: list[int], key: tuple[str, ...] = ("p1", "p2")) -> DataFrame:
    """Share of gold hands found in the first k slots, for several k."""
    keys = list(key)
    found = gold.select(*keys, "hand_id").join(picks.select(*keys, "hand_id", "slot"), [*keys, "hand_id"], "left")
    levels = F.array(*[F.lit(k) for k in ks])
    return (found.withColumn("k", F.explode(levels)).groupBy("k").agg(
        F.count("*").alias("gold"), F.sum(as_int(F.col("slot") <= F.col("k"))).alias("found"))
        .withColumn("recall", F.col("found") / F.col("gold")))


def recall_by_rank(picks: DataFrame, gold: DataFrame, k: int, key: tuple[str, ...] = ("p1", "p2")) -> DataFrame:
    """Recall in the first k slots by the rank the evidence was listed under."""
    keys = list(key)
    found = gold.join(picks.select(*keys, "hand_id", "slot"), [*keys, "hand_id"], "left")
    return found.groupBy("evidence_rank").agg(
        F.count("*").alias("gold"), F.avg(as_int(F.col("slot") <= k)).alias("recall"))


def precision_by_slot(picks: DataFrame, gold: DataFrame, k: int, key: tuple[str, ...] = ("p1", "p2")) -> DataFrame:
    keys = list(key)
    g = gold.select(*keys, "hand_id", F.lit(1).alias("hit"))
    d = picks.where(F.col("slot") <= k).join(gold.select(*keys).distinct(), keys, "left_semi")
    return d.join(g, [*keys, "hand_id"], "left").groupBy("slot").agg(
        F.count("*").alias("picks"), F.avg(F.coalesce("hit", F.lit(0))).alias("precision"))


def within_pair_auc(df: DataFrame, score: str, y: str, n: int, key: tuple[str, ...] = ("p1", "p2")) -> DataFrame:
    """Rank-sum AUC inside each pair's n best hands; pairs with both classes only."""
    keys = list(key)
    best = settle(top_rows(df.select(*keys, "hand_id", score, y), keys, [F.col(score).desc(), F.col("hand_id")], n))
    d = percentiles(best, keys, [*keys, "hand_id"], [score], keep=[y])
    size = best.groupBy(*keys).agg(F.count("*").alias("rows"), F.sum(y).alias("pos"))
    d = d.join(size, keys)
    g = d.groupBy(*keys).agg(
        F.max("rows").alias("rows"), F.max("pos").alias("pos"),
        F.sum(F.when(F.col(y) == 1, F.col(f"pct_{score}") * F.col("rows"))).alias("rank_sum"))
    p, m = F.col("pos"), F.col("rows") - F.col("pos")
    return g.where((p > 0) & (m > 0)).select(
        *keys, "rows", "pos", ((F.col("rank_sum") - p * (p + 1) / 2.0) / (p * m)).alias("auc"))


def precision_variants(df: DataFrame, score: str, ident: str, excluded: Column) -> DataFrame:
    """(variant, rows, positives, ap): over all rows with unknown labels as negatives, over labelled rows, and without `excluded` ones.

    ``label`` is 1, 0 or -1 (unknown). One ranking serves all three; a row a variant leaves out counts zero times in it.
    """
    known = F.coalesce(F.col("label") >= 0, F.lit(False))
    count = {"population": F.lit(1), "labelled": as_int(known), "cleaned": 1 - as_int(excluded)}
    sweep = precision_sweep(df, score, ident, [F.col("label") == 1] * len(count), weights=list(count.values()))
    names = F.array(*map(F.lit, count))
    return lanes(sweep, [], "__i").select(F.get(names, F.col("__i")).alias("variant"), "rows", "positives", "ap")


def shortlist_auc(df: DataFrame, score: str, shortlist: str, y: str, n: int, key: tuple[str, ...] = ("p1", "p2")) -> DataFrame:
    """Per pair: rows and positives among its n best by `shortlist`, rank-sum AUC of `score` there (null with one class), positives in all.

    Ties of the shortlist go to the smaller hand, ties of the score count half.
    """
    keys = list(key)
    total = df.groupBy(*keys).agg(F.sum(y).cast("bigint").alias("all_pos"))
    best = top_rows(df.select(*keys, "hand_id", score, shortlist, y), keys, [F.col(shortlist).desc(), F.col("hand_id")], n)
    # At most n rows per key enter these windows.
    own = Window.partitionBy(*keys)
    place = F.rank().over(own.orderBy(score)) + (F.count("*").over(Window.partitionBy(*keys, score)) - 1) / 2.0
    g = best.withColumn("__place", place).groupBy(*keys).agg(
        F.count("*").alias("rows"), F.sum(y).cast("bigint").alias("pos"), F.sum(F.when(F.col(y) == 1, F.col("__place"))).alias("__sum"))
    p, m = F.col("pos"), F.col("rows") - F.col("pos")
    auc = F.when((p > 0) & (m > 0), (F.col("__sum") - p * (p + 1) / 2.0) / F.greatest(p * m, F.lit(1)))
    return g.select(*keys, "rows", "pos", auc.alias("auc")).join(total, keys)


def shortlist_summary(pairs: DataFrame) -> DataFrame:
    """Mean AUC, pairs that have one, and the share of all positives that are in their pair's shortlist."""
    return pairs.agg(F.avg("auc").alias("mean_auc"), F.count("auc").alias("pairs"), (F.sum("pos") / F.sum("all_pos")).alias("recall_inside"))


def separation(df: DataFrame, columns: list[str], y: str, key: tuple[str, ...] = ("p1", "p2")) -> DataFrame:
    """Within-pair z of the positives against the rest, and Welch's t, per column."""
    keys = list(key)
    long = melt(df, [*keys, "hand_id", y], columns)
    stats = long.groupBy(*keys, "signal").agg(F.avg("x").alias("m"), F.stddev_samp("x").alias("s"))
    z = long.join(stats, [*keys, "signal"]).withColumn("z", (F.col("x") - F.col("m")) / (F.col("s") + 1e-9))
    pos, neg = F.col(y) == 1, F.col(y) == 0
    agg = z.groupBy("signal").agg(
        F.sum(as_int(pos)).alias("n_pos"), F.sum(as_int(neg)).alias("n_neg"),
        F.avg(F.when(pos, F.col("z"))).alias("mean_pos"), F.avg(F.when(neg, F.col("z"))).alias("mean_neg"),
        F.var_samp(F.when(pos, F.col("z"))).alias("v_pos"), F.var_samp(F.when(neg, F.col("z"))).alias("v_neg"))
    gap = F.col("mean_pos") - F.col("mean_neg")
    t = gap / F.sqrt(F.col("v_pos") / F.col("n_pos") + F.col("v_neg") / F.col("n_neg"))
    return agg.select("signal", "n_pos", "n_neg", gap.alias("gap"), t.alias("welch_t"))


def mixture_rows(df: DataFrame, held: str, share: float, seed: str, ident: str, draws: int = 5) -> DataFrame:
    """All rows once per draw, with `target`: positives of the known families and a reproducible draw of the
    held-out family that makes up `share` of the positives. What is not drawn stays, as a negative."""
    hidden = F.coalesce((F.col("label") == 1) & (F.col("family") == held), F.lit(False))
    d = df.withColumns({"__hidden": hidden, "draw": F.explode(F.array(*map(F.lit, range(draws))))})
    known = (F.col("label") == 1) & ~F.col("__hidden")
    want = df.agg(F.round(F.lit(share) * F.sum(as_int((F.col("label") == 1) & ~hidden)) / (1 - share)).alias("want"))
    h = md5_key(ident, F.concat(F.lit(seed), F.col("draw").cast("string")))
    placed = row_numbers(d.withColumn("__h", h), ["draw", "__hidden"], [F.col("__h"), F.col(ident)],
                         F.conv(F.substring("__h", 1, 4), 16, 10).cast("bigint"), "place").join(F.broadcast(want))
    drawn = F.col("__hidden") & (F.col("place") <= F.col("want"))
    return placed.withColumn("target", as_int(F.coalesce(known, F.lit(False)) | drawn)).drop("__h", "__hidden", "place", "want")


def mixture_ap(df: DataFrame, held: str, share: float, seed: str, ident: str, draws: int = 5) -> DataFrame:
    """Mean over the draws of the average precision on mixture rows."""
    each = mixture_sweep(df, {"score": F.col("score")}, held, [share], seed, ident, draws)
    return each.agg(*[F.avg(c).alias(c) for c in ("rows", "positives", "ap")])
