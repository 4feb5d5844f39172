"""Session settings and staged tables."""

from __future__ import annotations

import hashlib
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

# Runtime settings only: nothing here overrides how the cluster was sized.
RUNTIME = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
}

_written: dict[str, str] = {}


def tune(spark: SparkSession) -> SparkSession:
    for key, value in RUNTIME.items():
        spark.conf.set(key, value)
    return spark


@contextmanager
def rows_stay(spark: SparkSession) -> Iterator[None]:
    """Joins run inside leave a side where it is if it is dealt out by some of the join's keys."""
    key = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def carried(module: str) -> None:
    """Functions of the module go to the executors with their code, which need not have this library."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; a temporary one where it is unset and one machine does all."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def staged(spark: SparkSession, source: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """A table written once per application and read back.

    Cuts the lineage of tables that many operators share; the files live in the
    shared folder, so a lost executor costs a re-read and not a recomputation.
    """
    app = spark.sparkContext.applicationId
    key = f"{app}|{source}|{name}"
    if key not in _written:
        mark = hashlib.md5(source.encode()).hexdigest()[:12]
        path = f"{scratch_root(spark)}/dyad/{app}/{mark}/{name}"
        build().write.mode("overwrite").option("compression", "zstd").parquet(path)
        _written[key] = path
    return spark.read.parquet(_written[key])


def settle(df: DataFrame) -> DataFrame:
    """Writes an intermediate once and reads it back, for a table several branches would recompute."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/dyad/{spark.sparkContext.applicationId}/tmp/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.parquet(path)
