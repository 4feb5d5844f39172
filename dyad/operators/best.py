"""The k best rows of a key by several scores at once, and what pair features need of them.

One grouped pass: rows are gathered in stretches of a key of bounded size, every score keeps its k
best of the stretch, and stretches merge level by level. The number of scores adds nothing to
what is shuffled first, and no task holds more than a stretch of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dyad.operators.pairs import PAIR

STRETCH = 4096
LEVELS = 2  # of merging: a key may have STRETCH**(LEVELS + 1) rows before the last merge sees more than STRETCH stretches


def _kept(rows: Column, k: int) -> Column:
    return F.slice(F.sort_array(rows), 1, k)


def k_best(df: DataFrame, keys: list[str], place: str, ident: str, scores: list[str], k: int, carried: list[str] = [], stretch: int = STRETCH, short: bool = False) -> DataFrame:
    """One row per key: for each score an array of its k best rows (``neg`` the negated score, ident, `carried`), best first, and n_{score}, sum_{score}.

    Ties go to the smaller ident; a null score is not ranked and not summed. `place` numbers the rows of a key densely.
    `short` says that no key is longer than a stretch: then the first pass is the last, and no array is moved.
    """
    if stretch < 2:
        raise ValueError("a stretch holds two rows at least")
    apart = [] if short else ["__part"]
    d = df if short else df.withColumn("__part", F.floor(F.col(place) / stretch).cast("bigint"))
    row = F.struct(ident, *scores, *carried)
    sums = [f for s in scores for f in (F.count(s).alias(f"n_{s}"), F.sum(F.col(s).cast("double")).alias(f"sum_{s}"))]
    d = d.groupBy(*keys, *apart).agg(F.collect_list(row).alias("__rows"), *sums)

    def ranked(s: str) -> Column:
        some = F.filter("__rows", lambda r: r[s].isNotNull())
        return _kept(F.transform(some, lambda r: F.struct((-r[s].cast("double")).alias("neg"), r[ident].alias(ident), *[r[c].alias(c) for c in carried])), k)

    sized = [c for s in scores for c in (f"n_{s}", f"sum_{s}")]
    d = d.select(*keys, *apart, *[ranked(s).alias(f"best_{s}") for s in scores], *sized)
    for level in range(0 if short else LEVELS + 1):
        last = level == LEVELS
        group = keys if last else [*keys, "__part"]
        if not last:
            d = d.withColumn("__part", F.floor(F.col("__part") / stretch).cast("bigint"))
        d = d.groupBy(*group).agg(*[_kept(F.flatten(F.collect_list(f"best_{s}")), k).alias(f"best_{s}") for s in scores], *[F.sum(c).alias(c) for c in sized])
    return d


def top_mean(score: str, k: int) -> Column:
    """Mean of the k largest values, of all if there are fewer; null without any."""
    first = F.slice(F.col(f"best_{score}"), 1, k)
    return F.when(F.size(first) > 0, -F.aggregate(first, F.lit(0.0), lambda acc, r: acc + r["neg"]) / F.size(first))


def carried_mean(score: str, column: str, k: int) -> Column:
    """Mean of a carried column over the k best rows of a score; nulls are left aside."""
    values = F.filter(F.transform(F.slice(F.col(f"best_{score}"), 1, k), lambda r: r[column].cast("double")), lambda v: v.isNotNull())
    return F.when(F.size(values) > 0, F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v) / F.size(values))


def many_score_features(hs: DataFrame, place: str, tops: dict[str, tuple[int, ...]], carried: dict[str, list[str]], depth: int = 5, keys: list[str] = PAIR, short: bool = False) -> DataFrame:
    """Per pair and score: means of the k largest for each k of `tops`, sum and mean; means of `carried` columns over a score's `depth` best hands."""
    k = max([depth, *(k for ks in tops.values() for k in ks)])
    columns = sorted({c for cs in carried.values() for c in cs})
    b = k_best(hs, keys, place, "hand_id", list(tops), k, columns, short=short)
    out = {f"{s}_top{n}": top_mean(s, n) for s, ns in tops.items() for n in ns}
    out |= {f"{s}_sum": F.coalesce(F.col(f"sum_{s}"), F.lit(0.0)) for s in tops}
    out |= {f"{s}_mean": F.when(F.col(f"n_{s}") > 0, F.col(f"sum_{s}") / F.col(f"n_{s}")) for s in tops}
    out |= {f"{s}_best{depth}_{c}": carried_mean(s, c, depth) for s, cs in carried.items() for c in cs}
    return b.select(*keys, *[c.alias(n) for n, c in out.items()])
