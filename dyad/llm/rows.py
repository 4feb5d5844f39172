"""Rows told apart where ids are not enough."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dyad.llm import store


def repeated(docs: DataFrame, id_col: str = "doc_id") -> bool:
    """Whether two rows have the same id; rows without one do not count."""
    ids = docs.select(F.col(id_col).cast("long").alias("id")).where("id is not null").groupBy("id").count()
    return (ids.agg(F.max("count")).first()[0] or 0) > 1


def numbered(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """`docs` with the key `row`, written out so that every later read sees the same keys.

    Keys rise with the id; equal ids are ordered by the hash of their text. A row without an id has no key.
    """
    key = F.monotonically_increasing_id()
    order = [F.col(id_col).cast("long"), F.xxhash64(F.col(text_col).cast("string")), F.col("row")]
    sorted_rows = docs.withColumn("row", key).orderBy(*order)  # the first key only deals equal rows out
    whole = sorted_rows.withColumn("row", F.when(F.col(id_col).cast("long").isNotNull(), key))
    return store.kept(whole, "rows")[0]
