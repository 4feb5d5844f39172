"""Connected components of a graph given as an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dyad.llm import store


def _towards(edges: DataFrame, mins: DataFrame) -> DataFrame:
    return edges.join(mins, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")


def roots(edges: DataFrame) -> DataFrame:
    """(u, root): the smallest node reachable from every node that has an edge, itself included.

    `edges` has long columns u and v; direction, loops and repeats do not matter. Alternating star
    steps, as published for map-reduce: every node first hands its larger neighbours, then its
    smaller ones, to the smallest it knows. Only pairs with a minimum are written, so a step is
    linear in the edges; the written tables carry the state from step to step.
    """
    spark = edges.sparkSession
    now, path = store.kept(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    mark = F.struct(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")))
    state = now.agg(mark).first()[0]
    while state[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        mins = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = _towards(both.where("v > u"), mins).distinct()
        small_mins = large.groupBy("u").agg(F.min("v").alias("m"))
        small = _towards(large, small_mins).unionByName(small_mins.select("u", F.col("m").alias("v"))).distinct()
        after, after_path = store.kept(small, "edges")
        new = after.agg(mark).first()[0]
        store.drop(spark, path)
        now, path = after, after_path
        if new == state:
            break
        state = new
    return now.select("u", F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("u"), F.col("v").alias("root")).distinct())
