"""Closed-table action log read from the `events` and `lineitem` tables.

Users are grouped into closed tables of fifteen, each table's six-hour windows
are its hands, and event types stand for action kinds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dyad.functions.cols import action_code
from dyad.functions.ordered import row_numbers, time_segment

TABLE_SIZE = 15
HAND_SECONDS = 21_600
STREET_SECONDS = 5_400
DEVELOPMENT_DAYS = 18
BIG_BLIND = 10_000
STARTING_STACK = 1_000_000

# Fixed mapping of event types to action kinds.
KIND_OF = {"error": "fold", "view": "check", "click": "call", "signup": "bet", "purchase": "raise"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def seconds_of(ts: str):
    """Epoch seconds of a zoneless timestamp, whatever the session's time zone."""
    t = F.col(ts)
    return (F.unix_date(F.to_date(t)).cast("bigint") * 86_400
            + F.hour(t) * 3_600 + F.minute(t) * 60 + F.second(t)).cast("bigint")


def read_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per action, numbered from 0 inside its hand."""
    kind = F.create_map(*[F.lit(x) for pair in KIND_OF.items() for x in pair])
    raw = (table(spark, sf_dir, "events")
           .select("event_id", "ts", F.col("user_id").alias("player_id"),
                   F.element_at(kind, F.col("event_type")).alias("action"),
                   F.round(F.col("value") * 100).cast("bigint").alias("amount"),
                   F.get_json_object("props", "$.k").cast("int").alias("strength"),
                   seconds_of("ts").alias("sec")))
    logged = raw.select(
        "event_id", "ts", "sec", "player_id", "action", "amount", "strength",
        action_code("action").alias("y"),
        F.expr(f"player_id div {TABLE_SIZE}").alias("table_id"),
        F.expr(f"sec div {HAND_SECONDS} * {HAND_SECONDS}").alias("started_at"),
        F.expr(f"cast(sec % {HAND_SECONDS} div {STREET_SECONDS} as int)").alias("street"),
        F.when(F.dayofmonth("ts") <= DEVELOPMENT_DAYS, "development")
        .otherwise("evaluation").alias("phase"),
        F.concat_ws("-", F.expr(f"player_id div {TABLE_SIZE}").cast("string"),
                    F.expr(f"sec div {HAND_SECONDS}").cast("string")).alias("hand_id"))
    numbered = row_numbers(logged, ["hand_id"], [F.col("ts"), F.col("event_id")],
                           time_segment("sec", 600), "rn")
    return (numbered.withColumn("action_no", F.col("rn") - 1)
            .withColumn("big_blind", F.lit(BIG_BLIND).cast("bigint"))
            .select("table_id", "hand_id", "started_at", "phase", "street", "action_no", "player_id",
                    "action", "y", "amount", "strength", "big_blind"))


LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount",
              "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


def read_line_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Second mapping: an order is a hand, its lines are actions, suppliers are actors."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", *LINE_ORDER)
    numbered = row_numbers(lines, ["l_orderkey"], [F.col(c) for c in LINE_ORDER],
                           F.expr("cast(l_linenumber as bigint)"), "rn")
    return numbered.select(
        F.col("l_orderkey").alias("hand_id"), (F.col("rn") - 1).alias("action_no"),
        F.col("l_suppkey").alias("player_id"), F.col("l_partkey").alias("part_id"),
        F.concat("l_returnflag", "l_linestatus").alias("action"),
        F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("amount"))
