"""Average precision of one ranking under many weights and labellings at once.

A resample only changes how often a row counts, a mixture only which rows are positive; the order
stays. So rows are ranked once, and every replicate, share or draw is a lane: one more running sum
beside the others. Nothing is copied per lane.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dyad.functions.cols import as_int, flag, md5_key
from dyad.functions.ordered import ident_segment, magnitude_segment, row_numbers, running

UNSCORED = 1.7e308  # as a negated score: behind every other


def precision_sweep(df: DataFrame, score: str, ident: str, targets: list[Column], by: list[str] | None = None, weights: list[Column] | None = None) -> DataFrame:
    """One row per `by` with arrays rows, positives and ap, an entry for each lane.

    Ordered by (score desc, id asc), rows without a score last. `targets` are conditions, unknown meaning no. `weights`, one
    per lane, say how often a row counts in it; without them every row counts once in all lanes. A lane without positives has 0.
    """
    keys = by or ["__all"]
    d = df if by else df.withColumn("__all", F.lit(1))
    w = [f"__w{i}" for i in range(len(weights or [0]))]
    h = [f"__h{i}" for i in range(len(targets))]
    own = lambda i: w[i if weights else 0]
    d = d.withColumns({n: c.cast("bigint") for n, c in zip(w, weights or [F.lit(1)])})
    d = d.select(*keys, ident, F.coalesce(-F.col(score).cast("double"), F.lit(UNSCORED)).alias("__neg"), *w,
                 *[F.when(flag(t), F.col(own(i))).otherwise(0).alias(h[i]) for i, t in enumerate(targets)])
    lanes = [*w, *h]
    tied = d.groupBy(*keys, "__neg").agg(*[F.sum(c).alias(c) for c in lanes])
    above = running(tied, keys, ["__neg"], {f"__a{c}": ("sum", F.col(c)) for c in lanes}, segment=magnitude_segment("__neg")).select(*keys, "__neg", *[f"__a{c}" for c in lanes])
    d = running(d, [*keys, "__neg"], [ident], {f"__b{c}": ("sum", F.col(c)) for c in lanes}, segment=ident_segment(d, ident)).join(above, [*keys, "__neg"])
    before = lambda c: F.col(f"__a{c}") + F.col(f"__b{c}")

    def gain(i: int) -> Column:
        hits, rows = before(h[i]), before(own(i))
        if not weights:
            return (hits + 1) / (rows + 1)
        return F.aggregate(F.sequence(F.lit(1).cast("bigint"), F.col(own(i))), F.lit(0.0), lambda acc, j: acc + (hits + j) / (rows + j))

    sums = d.groupBy(*keys).agg(*[F.sum(c).alias(f"__s{c}") for c in lanes], *[F.sum(F.when(F.col(c) > 0, gain(i))).alias(f"__g{i}") for i, c in enumerate(h)])
    ap = [F.when(F.col(f"__s{c}") > 0, F.col(f"__g{i}") / F.col(f"__s{c}")).otherwise(0.0) for i, c in enumerate(h)]
    out = sums.select(*keys, F.array(*[F.col(f"__s{own(i)}") for i in range(len(h))]).alias("rows"), F.array(*[F.col(f"__s{c}") for c in h]).alias("positives"), F.array(*ap).alias("ap"))
    return out if by else out.drop("__all")


def lanes(sweep: DataFrame, keep: list[str], name: str = "lane") -> DataFrame:
    """One row per lane, numbered from 0."""
    return sweep.select(*keep, F.posexplode(F.arrays_zip("rows", "positives", "ap")).alias(name, "__e")).select(*keep, name, "__e.*")


def melted_scores(df: DataFrame, scores: dict[str, Column], keep: list[str], name: str) -> DataFrame:
    """Each row once per score, as `score` under its name: the orders differ, so each needs a ranking of its own."""
    each = F.array(*[F.struct(F.lit(n).alias(name), c.cast("double").alias("score")) for n, c in scores.items()])
    return df.select(*keep, F.explode(each).alias("__s")).select(*keep, "__s.*")


def resampled(df: DataFrame, scores: dict[str, Column], y: str, ident: str, group: str, weights: DataFrame, replicates: int) -> DataFrame:
    """(name, replicate, rows, positives, ap): every score in every whole-group resample.

    `weights` has replicate, the group and ``w``, how often it is drawn; a group it lacks counts not at all.
    """
    # At most one entry per replicate is gathered for a group.
    drawn = weights.groupBy(group).agg(F.map_from_entries(F.collect_list(F.struct("replicate", "w"))).alias("__drawn"))
    d = melted_scores(df.join(drawn, group, "left"), scores, [ident, y, "__drawn"], "name")
    times = [F.coalesce(F.try_element_at("__drawn", F.lit(r)), F.lit(0)) for r in range(replicates)]
    return lanes(precision_sweep(d, "score", ident, [F.col(y) == 1] * replicates, ["name"], times), ["name"], "replicate")


def mixture_sweep(df: DataFrame, scores: dict[str, Column], held: str, shares: list[float], seed: str, ident: str, draws: int = 5) -> DataFrame:
    """(name, share, draw, rows, positives, ap) with one family's positives put back at each share of all positives.

    `df` has ``label`` and ``family``. A draw takes the held family's positives first by hash; those not taken stay, as
    negatives. Shares and draws are lanes of one ranking per score.
    """
    positive = flag(F.col("label") == 1)
    hidden = flag(positive & (F.col("family") == held))
    known = df.agg(F.sum(as_int(positive & ~hidden)).alias("known"))
    want = known.select(F.array(*[F.round(F.lit(s) * F.col("known") / (1 - s)) for s in shares]).alias("__want"))
    few = df.where(hidden).select(ident, F.explode(F.array(*map(F.lit, range(draws)))).alias("draw"))
    h = md5_key(ident, F.concat(F.lit(seed), F.col("draw").cast("string")))
    placed = row_numbers(few.withColumn("__h", h), ["draw"], [F.col("__h"), F.col(ident)], F.conv(F.substring("__h", 1, 4), 16, 10).cast("bigint"), "place")
    places = placed.groupBy(ident).agg(F.map_from_entries(F.collect_list(F.struct("draw", "place"))).alias("__places"))  # `draws` entries a row
    d = df.select(ident, (positive & ~hidden).alias("__known"), *[c.alias(f"__score_{i}") for i, c in enumerate(scores.values())]).join(places, ident, "left").join(F.broadcast(want))
    d = melted_scores(d, {n: F.col(f"__score_{i}") for i, n in enumerate(scores)}, [ident, "__known", "__places", "__want"], "name")
    targets = [F.col("__known") | flag(F.try_element_at("__places", F.lit(k)) <= F.get("__want", F.lit(i))) for i in range(len(shares)) for k in range(draws)]
    out = lanes(precision_sweep(d, "score", ident, targets, ["name"]), ["name"])
    table = F.array(*[F.lit(float(s)) for s in shares])
    return out.select("name", F.get(table, F.floor(F.col("lane") / draws).cast("int")).alias("share"), F.pmod("lane", F.lit(draws)).alias("draw"), "rows", "positives", "ap")
