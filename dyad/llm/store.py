"""Tables written to the folder that all executors share, to cut lineage and to read a result more than once."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from dyad.session import scratch_root


def kept(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """The table written under spark.checkpoint.dir and read back, and its path."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/dyad-llm/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def drop(spark: SparkSession, *paths: str) -> None:
    """Removes written tables that nothing reads any more."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)
