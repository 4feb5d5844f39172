"""Small Column helpers shared by every operator."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed vocabularies of the action log.
KINDS = ["fold", "check", "call", "bet", "raise", "all_in"]
STREETS = ["preflop", "flop", "turn", "river"]
FAMILIES = ["directed_transfer", "soft_play", "coordinated_isolation"]
NO_EVIDENCE = "NO_EVIDENCE"

# "Aggressive" has two meanings: counts leave all-in out, attribution keeps it.
COUNTED_AGGRESSION = ["bet", "raise"]
ATTRIBUTED_AGGRESSION = ["bet", "raise", "all_in"]


def col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def flag(cond: Column) -> Column:
    """Three-valued predicate read as two-valued: unknown means no."""
    return F.coalesce(cond, F.lit(False))


def as_int(cond: Column) -> Column:
    return flag(cond).cast("int")


def count_where(cond: Column) -> Column:
    return F.sum(as_int(cond)).cast("bigint")


def sum_where(cond: Column, value: Column, default=0) -> Column:
    return F.sum(F.when(cond, value).otherwise(F.lit(default)))


def ratio(a: Column, b: Column) -> Column:
    """Float division, null when the denominator is zero."""
    return F.when(b != 0, a.cast("double") / b.cast("double"))


def lo(a, b) -> Column:
    return F.least(col(a), col(b))


def hi(a, b) -> Column:
    return F.greatest(col(a), col(b))


def canonical_pair(a, b) -> list[Column]:
    """The unordered key of two actors."""
    return [lo(a, b).alias("p1"), hi(a, b).alias("p2")]


def action_code(action: str | Column) -> Column:
    """Ordinal of an action kind; -1 for a kind outside the vocabulary."""
    return F.array_position(F.array(*[F.lit(k) for k in KINDS]), col(action)).cast("int") - 1


def is_pass(y) -> Column:
    return col(y).isin(1, 2)


def is_aggressive(y) -> Column:
    return col(y) >= 3


def md5_key(*parts) -> Column:
    """Reproducible pseudo-random order: hex digest of the joined parts."""
    return F.md5(F.concat_ws("|", *[col(p).cast("string") for p in parts]))


def round6(df: DataFrame, *columns: str) -> DataFrame:
    """Round the named double columns (or every double column) to six places."""
    names = columns or [c for c, t in df.dtypes if t in ("double", "float")]
    return df.withColumns({c: F.round(F.col(c).cast("double"), 6) for c in names})
