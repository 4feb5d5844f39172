"""Exact duplicates by deterministic block naming.

A text, with every run of white space turned into one space, is cut into blocks of a fixed number
of bytes. Equal blocks meet in one bucket; a bucket sorts its blocks and numbers them, so that a
block's integer name stands for its content without any chance of a collision. Then two
neighbouring names are named in the same way, level by level, until a text has one name: two texts
are equal exactly if they end at the same level with the same name.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dyad.llm import store, text

BLOCK = 2048
BUCKETS = 4096
_REF = "struct<row:bigint,id:bigint,at:int,blocks:int,sha:string>"


def normalised(value: str | None) -> bytes:
    """Each run of white space as one space, in UTF-8; a null as an empty text."""
    whole = (value or "").encode()
    words = whole.split()
    lead = b" " if whole[:1].isspace() else b""
    tail = b" " if words and whole[-1:].isspace() else b""
    return lead + b" ".join(words) + tail


def _cut(size: int):
    refs = pa.list_(pa.struct([("row", pa.int64()), ("id", pa.int64()), ("at", pa.int32()), ("blocks", pa.int32()), ("sha", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text.slices(batch, most=8 << 20):
                seen: dict[bytes, list] = {}
                for row, key, value in zip(part.column("row").to_pylist(), part.column("id").to_pylist(), part.column("text").to_pylist()):
                    whole = normalised(value)
                    n = max(1, -(-len(whole) // size))
                    for i in range(n):
                        ref = {"row": row, "id": key, "at": i, "blocks": n, "sha": hashlib.sha256(whole).hexdigest() if i == 0 else None}
                        seen.setdefault(whole[i * size:(i + 1) * size], []).append(ref)
                if seen:
                    blocks = list(seen)
                    yield pa.record_batch([pa.array([zlib.crc32(b) for b in blocks], pa.int64()), pa.array(blocks, pa.binary()),
                                           pa.array(list(seen.values()), refs)], names=["mark", "block", "refs"])
    return run


def _numbered(df: DataFrame, bucket, *keys: str) -> DataFrame:
    """`name`: the rank of the keys inside their bucket, made unique over buckets."""
    order = Window.partitionBy("bucket").orderBy(*keys)
    return (df.withColumn("bucket", F.pmod(bucket, F.lit(BUCKETS)))
            .withColumn("name", F.dense_rank().over(order).cast("long") * BUCKETS + F.col("bucket")).drop("bucket"))


def identities(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """One row per row of `docs`: id, level, name, sha; equal (level, name) means equal normalised text.

    Nulls count as empty; an empty text is one empty block. Ids may be null or repeat: every row is
    numbered as it is read, and its blocks are written with that number and named by it. Blocks
    that occur many times in a task leave it once, with the list of their places, so a text that
    a third of all rows hold does not become one long task.
    """
    spark = docs.sparkSession
    source = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    cut = source.mapInArrow(_cut(block), f"mark long, block binary, refs array<{_REF}>")
    named = _numbered(cut, F.col("mark"), "block").select("name", F.explode("refs").alias("r"))
    level, path = store.kept(named.select(F.col("r.row").alias("row"), F.col("r.id").alias("id"), F.col("r.at").alias("at"), F.col("r.blocks").alias("blocks"),
                                          F.col("r.sha").alias("sha"), "name"), "names")
    longest = level.agg(F.max("blocks")).first()[0] or 0
    found = level.where("blocks = 1").select("id", F.lit(0).alias("level"), "name", "sha")
    rest, depth = level.where("blocks > 1"), 0
    while longest > 1:
        depth, longest = depth + 1, -(-longest // 2)
        pairs = rest.groupBy("row", "id", F.floor(F.col("at") / 2).cast("int").alias("half"), F.ceil(F.col("blocks") / 2).cast("int").alias("blocks")).agg(
            F.max(F.when(F.col("at") % 2 == 0, F.col("name"))).alias("l"),
            F.coalesce(F.max(F.when(F.col("at") % 2 == 1, F.col("name"))), F.lit(-1)).alias("r"), F.max("sha").alias("sha"))
        names = _numbered(pairs.select("l", "r").distinct(), F.xxhash64("l", "r"), "l", "r")
        rest, _ = store.kept(pairs.join(names, ["l", "r"]).select("row", "id", F.col("half").alias("at"), "blocks", "sha", "name"), "names")
        found = found.unionByName(rest.where("blocks = 1").select("id", F.lit(depth).alias("level"), "name", "sha"))
        rest = rest.where("blocks > 1")
    return found


def duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """One row per row of `docs`, the dropped ones too: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the rows with the smallest id stay; where ids repeat that may be several. Nulls have
    no place in the order of ids: such a row is `kept` null. An empty table gives an empty result;
    columns other than the two named are not read.
    """
    found = identities(docs, id_col, text_col, block)
    groups = found.groupBy("level", "name").agg(F.min("id").alias("keep_id"), F.count("*").alias("group_size"))
    return found.join(groups, ["level", "name"]).select(
        F.col("id").alias("doc_id"), "keep_id", "group_size", (F.col("id") == F.col("keep_id")).alias("kept"),
        F.col("sha").alias("text_sha256"))
