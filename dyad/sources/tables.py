"""Readers and writers with explicit schemas for the log, the labels and the results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

S, I, D, B, TS = T.StringType(), T.IntegerType(), T.DoubleType(), T.BooleanType(), T.TimestampType()


def _schema(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields])


PLAYERS = _schema(("player_id", S), ("account_age_days", I), ("experience_hands_bucket", S),
                  ("preferred_stake", S), ("region_bucket", S), ("client_family", S))
HANDS = _schema(("hand_id", S), ("table_id", S), ("started_at", TS), ("phase", S),
                ("button_seat", I), ("small_blind", I), ("big_blind", I), ("board_cards", S),
                ("final_pot", I), ("players_dealt", I), ("players_at_showdown", I))
SEATS = _schema(("hand_id", S), ("player_id", S), ("seat_no", I), ("starting_stack", I),
                ("hole_card_1", S), ("hole_card_2", S), ("total_contribution", I), ("net_chips", I),
                ("folded", B), ("went_to_showdown", B), ("won_share", D))
ACTIONS = _schema(("hand_id", S), ("action_no", I), ("street", S), ("player_id", S), ("action", S),
                  ("amount", I), ("amount_to", I), ("pot_before", I), ("stack_before", I),
                  ("to_call", I), ("players_active", I))
LABELS = _schema(("pair_id", S), ("player_1", S), ("player_2", S), ("label", I),
                 ("label_status", S), ("behavior_family", S))
EVIDENCE = _schema(("pair_id", S), ("evidence_rank", I), ("hand_id", S), ("behavior_family", S))
PAIRS = _schema(("pair_id", S), ("player_1", S), ("player_2", S), ("shared_hands", I))
RESULT = _schema(("pair_id", S), ("risk_score", D), ("predicted_behavior", S),
                 *[(f"evidence_hand_{i}", S) for i in range(1, 6)])


def read_parquet(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.parquet(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def read_text_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Every column as text, so untouched columns survive a round trip byte for byte."""
    return read_csv(spark, path, _schema(*[(c, S) for c in columns]))


def write_parquet(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    writer = df.write.mode("overwrite").option("compression", "zstd")
    (writer.partitionBy(*by) if by else writer).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
