"""Card hands: parsing, the best five of up to seven cards, draws, starting hands.

Strength is a seat-table job: cards are counted per rank and suit in one grouped
pass and ordered with bit arithmetic, no Python involved.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed card alphabets.
RANKS = "23456789TJQKA"
SUITS = "cdhs"
KICKER_BASE = 14
# Fixed category order, weakest first.
CATEGORIES = ["high", "pair", "two_pair", "trips", "straight", "flush", "full_house", "quads", "straight_flush"]


def parse_cards(df: DataFrame, text: str, out: str = "cards") -> DataFrame:
    """A card string such as ``"Ah Kd 7c"`` as an array of (rank, suit), and its size."""
    parsed = F.transform(
        F.filter(F.split(F.trim(F.coalesce(F.col(text), F.lit(""))), " +"), lambda c: F.length(c) == 2),
        lambda c: F.struct((F.position(F.substring(c, 1, 1), F.lit(RANKS)) - 1).alias("rank"),
                           (F.position(F.substring(c, 2, 1), F.lit(SUITS)) - 1).alias("suit")))
    return df.withColumn(out, parsed).withColumn(f"n_{out}", F.size(out))


def _bit(i: Column) -> Column:
    return F.pow(F.lit(2.0), i).cast("int")


def _highest(mask: Column) -> Column:
    """Index of the highest set bit, -1 for none."""
    return F.when(mask > 0, F.floor(F.log2(mask + F.lit(0.5))).cast("int")).otherwise(F.lit(-1))


def _top_bits(mask: Column, k: int) -> list[Column]:
    bits = F.filter(F.array(*[F.lit(i) for i in range(12, -1, -1)]), lambda i: F.getbit(mask, i) == 1)
    return [F.coalesce(F.get(bits, F.lit(i)), F.lit(-1)) for i in range(k)]


def _straight_top(mask: Column) -> Column:
    """Top rank of the best straight in a 13-bit mask, -1 for none; the ace also plays low."""
    m = mask * 2 + F.when(mask.bitwiseAND(F.lit(1 << 12)) > 0, 1).otherwise(0)
    run = m
    for i in range(1, 5):
        run = run.bitwiseAND(F.shiftright(m, i))
    # Bit b of `run` marks five in a row from b to b+4, counted with the low ace at 0.
    return F.when(run > 0, _highest(run) + 3).otherwise(F.lit(-1))


def _longest_run(mask: Column) -> Column:
    """Longest run of consecutive ranks, the ace at both ends."""
    m = mask * 2 + F.when(mask.bitwiseAND(F.lit(1 << 12)) > 0, 1).otherwise(0)
    length, run = F.when(m > 0, 1).otherwise(0), m
    for k in range(2, 15):
        run = run.bitwiseAND(F.shiftright(m, k - 1))
        length = F.when(run > 0, k).otherwise(length)
    return length


def card_counts(cards: DataFrame, keys: list[str]) -> DataFrame:
    """Per seat: cards of each rank, of each suit, rank mask and per-suit masks."""
    r, s = F.col("rank"), F.col("suit")
    return cards.groupBy(*keys).agg(
        F.count("*").alias("n_cards"),
        *[F.sum((r == i).cast("int")).cast("int").alias(f"r{i}") for i in range(13)],
        *[F.sum((s == i).cast("int")).cast("int").alias(f"s{i}") for i in range(4)],
        F.bit_or(_bit(r)).cast("int").alias("mask"),
        *[F.coalesce(F.bit_or(F.when(s == i, _bit(r))), F.lit(0)).cast("int").alias(f"m{i}") for i in range(4)])


def seat_strength(cards: DataFrame, keys: list[str]) -> DataFrame:
    """Category and packed score of the best five of each seat's cards.

    `cards` has one row per distinct card with ``rank`` 0-12 and ``suit`` 0-3; seats
    with fewer than five cards have no score. The packed score orders hands:
    category, then five base-14 digits of kickers.
    """
    d = card_counts(cards, keys)
    groups = F.sort_array(F.array(*[F.col(f"r{i}") * 16 + F.lit(i) for i in range(13)]), asc=False)
    d = d.withColumn("g", groups)
    count = [F.floor(F.element_at("g", i) / 16).cast("int") for i in (1, 2)]
    rank = [F.pmod(F.element_at("g", i), F.lit(16)).cast("int") for i in range(1, 6)]
    suit_of = F.array(*[F.col(f"s{i}") for i in range(4)])
    flush_mask = F.element_at(F.array(*[F.col(f"m{i}") for i in range(4)]),
                              F.array_position(suit_of, F.array_max(suit_of)).cast("int"))
    d = d.withColumns({
        "c0": count[0], "c1": count[1], **{f"k{i}": rank[i] for i in range(5)},
        "has_flush": F.array_max(suit_of) >= 5, "flush_mask": flush_mask,
        "straight": _straight_top(F.col("mask"))})
    c0, c1 = F.col("c0"), F.col("c1")
    d = d.withColumn("flush_straight", F.when(F.col("has_flush"), _straight_top(F.col("flush_mask"))).otherwise(-1))
    category = (F.when(F.col("flush_straight") >= 0, 8).when(c0 == 4, 7).when((c0 == 3) & (c1 >= 2), 6)
                .when(F.col("has_flush"), 5).when(F.col("straight") >= 0, 4).when(c0 == 3, 3)
                .when((c0 == 2) & (c1 == 2), 2).when(c0 == 2, 1).otherwise(0))
    # A flush outranks nothing it should not: a full house or quads cannot share seven cards with one.
    d = d.withColumn("category", category)
    k = [F.col(f"k{i}") for i in range(5)]
    none = F.lit(-1)
    without_two = F.col("mask") - _bit(k[0]) - _bit(k[1])
    f = _top_bits(F.col("flush_mask"), 5)
    cat = F.col("category")
    layouts = {0: k, 1: [*k[:4], none], 2: [k[0], k[1], _highest(without_two), none, none],
               3: [*k[:3], none, none], 4: [F.col("straight"), none, none, none, none], 5: f,
               6: [k[0], k[1], none, none, none],
               7: [k[0], _highest(F.col("mask") - _bit(k[0])), none, none, none],
               8: [F.col("flush_straight"), none, none, none, none]}
    score = cat.cast("bigint")
    for i in range(5):
        digit = F.lit(-1)
        for c, cols in layouts.items():
            digit = F.when(cat == c, cols[i]).otherwise(digit)
        score = score * KICKER_BASE + (digit + 1)
    return d.where(F.col("n_cards") >= 5).select(*keys, "n_cards", "category", score.alias("score"))


def draw_features(cards: DataFrame, keys: list[str]) -> DataFrame:
    """Cards in the commonest suit, longest rank run, whether a hole card is of that suit.

    `cards` also has ``hole`` (0/1). Among equally common suits the first counts.
    """
    suits = card_counts(cards, keys)
    hole = cards.where(F.col("hole") == 1).groupBy(*keys).agg(
        *[F.max((F.col("suit") == i).cast("int")).alias(f"h{i}") for i in range(4)])
    by_suit = F.array(*[F.col(f"s{i}") for i in range(4)])
    top = F.array_position(by_suit, F.array_max(by_suit)).cast("int")
    held = F.element_at(F.array(*[F.coalesce(F.col(f"h{i}"), F.lit(0)) for i in range(4)]), top)
    return suits.join(hole, keys, "left").select(
        *keys, F.array_max(by_suit).alias("suit_cards"), _longest_run(F.col("mask")).alias("rank_run"),
        held.alias("hole_in_suit"))


def start_bucket(r1: Column, s1: Column, r2: Column, s2: Column) -> Column:
    """One of 169 starting hands: hi*13+lo when suited, lo*13+hi otherwise."""
    high, low = F.greatest(r1, r2), F.least(r1, r2)
    suited = (r1 != r2) & (s1 == s2)
    return F.when(suited, high * 13 + low).otherwise(low * 13 + high).cast("int")


def bucket_strength(hands: DataFrame, bucket: str, won: str) -> DataFrame:
    """Empirical win share of each starting hand and its percentile: at most 169 rows."""
    t = hands.groupBy(bucket).agg(F.count("*").alias("dealt"), F.avg(won).alias("win_share"))
    order = Window.orderBy("win_share")
    tied = Window.partitionBy("win_share")
    n = F.count("*").over(Window.partitionBy())
    return t.withColumn("strength_pct", (F.rank().over(order) + (F.count("*").over(tied) - 1) / 2.0) / n)


def lookup_strength(seats: DataFrame, table: DataFrame, bucket: str) -> DataFrame:
    """At most 169 rows on the table side, so it is broadcast."""
    return seats.join(F.broadcast(table), bucket, "left")
