"""From raw documents to packed sequences: each stage works on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dyad.llm import containment, lines, near, packing, quality, simhash
from dyad.llm.store import kept

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble, learnt from the labels, does not reject."""
    return quality.passing(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).select(COLUMNS)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that have an earlier similar line; n_chars follows the text."""
    left = lines.without_similar(docs.select(COLUMNS)).select("doc_id", "text", "rest.*")
    return left.withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def keep_first_of_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by fingerprints or by similarity 0.8 of their five-word shingles the one with the smallest id."""
    return near.first_of_groups(docs, by=(simhash.groups, near.groups)).select(COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    return containment.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, packed into sequences of 1024 tokens."""
    return packing.pack(docs)


STAGES = [("quality classifier", keep_quality), ("line dedup", drop_lines), ("simhash near-dedup", keep_first_of_group),
          ("benchmark decontamination", drop_contaminated), ("best-fit packing", pack)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs, _ = kept(docs, f"stage{i}")
    return docs
