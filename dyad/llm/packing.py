"""Best-fit packing of token pieces into sequences of a fixed capacity, in bulk-synchronous rounds.

Lengths and gaps are integers up to the capacity, so sorting by size leaves at most `capacity`
classes, whatever the corpus: Spark counts the classes and ranks the pieces inside each. In a round
all waiting pieces of the largest waiting length look for the successor of that length among the
gaps, the smallest gap that holds them. If there are more pieces than such gaps, the lower ranks
win and the rest look on in the next round; the gaps that were filled are updated before it begins.
Where no gap is large enough, new sequences are opened for all that wait. The rounds see classes and
counts alone and write runs (length, ranks, sequences, offset); Spark hands each piece its place by
joining its length and rank with those runs.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dyad.llm import store, text, tokens

CAPACITY = 1024
END = 2
BLOCK_ROWS = 500_000


def rounds(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Runs (length, first rank, how many, first sequence, offset) that place every piece."""
    gaps: dict[int, list[tuple[int, int]]] = {}  # by size: runs of sequences (first, how many)
    opened, runs = 0, []
    for length in sorted(counts, reverse=True):
        rank, waiting = 0, counts[length]
        while waiting:
            size = min((g for g in gaps if g >= length), default=capacity)  # the successor of all that wait
            if size not in gaps:
                gaps[size] = [(opened, waiting // (capacity // length) or 1)]
                opened += gaps[size][0][1]
            first, many = gaps[size].pop()
            take = min(many, waiting)
            runs.append((length, rank, take, first, capacity - size))
            rank, waiting = rank + take, waiting - take
            if take < many:
                gaps[size].append((first + take, many - take))
            if not gaps[size]:
                del gaps[size]
            if size > length:
                gaps.setdefault(size - length, []).append((first, take))
    return runs


def _cut(ranks_path: str, capacity: int, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        enc = tokens.encoder(ranks_path)
        tail = np.array([end], "<u4")
        for batch in batches:
            for part in text.slices(batch, most=8 << 20):
                rows: list[tuple] = []
                for key, value in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                    ids = np.concatenate([np.array(enc(value or ""), "<u4"), tail])
                    at, piece = 0, 0
                    stop = (len(ids) - 1) % capacity + 1
                    while at < len(ids):
                        rows.append((key, piece, at, stop - at, zlib.crc32(ids[at:stop].tobytes())))
                        at, stop, piece = stop, stop + capacity, piece + 1
                if rows:
                    cols = list(zip(*rows))
                    yield pa.record_batch([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()),
                                           *(pa.array(c, pa.int64()) for c in cols[2:])], names=["doc_id", "piece", "start", "length", "ids_crc32"])
    return run


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end: int = END,
           ranks_path: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: every document's ids and the end id, cut where longer than the capacity.

    A null or empty text is the end id alone. All pieces but the first of a document are full.
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(_cut(ranks_path or tokens.default_ranks(), capacity, end),
                             "doc_id long, piece int, start long, length long, ids_crc32 long")


def placed(items: DataFrame, keys: list[str], length: str = "length", capacity: int = CAPACITY) -> DataFrame:
    """`items` with sequence_id and offset. `keys` must tell rows apart; rows without a length between
    1 and the capacity are refused with an error, so that none is lost."""
    spark = items.sparkSession
    counts = {r[0]: r[1] for r in items.groupBy(length).count().collect()}  # at most `capacity` classes
    if wrong := [n for n in counts if n is None or not 0 < n <= capacity]:
        raise ValueError(f"lengths outside 1..{capacity}: {wrong[:5]}")
    blocks = max(1, -(-max(counts.values(), default=0) // BLOCK_ROWS))
    runs = spark.createDataFrame(rounds(counts, capacity), f"{length} long, first_rank long, many long, first_sequence long, offset long")
    rows = items.withColumn("_block", F.pmod(F.xxhash64(*keys), F.lit(blocks)))
    before = Window.partitionBy(length).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy(length, "_block").count().select(length, "_block", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"))
    order = Window.partitionBy(length, "_block").orderBy(*keys)
    ranked = rows.withColumn("_rank", F.row_number().over(order) - 1).join(starts, [length, "_block"]).withColumn("_rank", F.col("_rank") + F.col("_start"))
    hit = (ranked[length] == runs[length]) & (F.col("_rank") >= F.col("first_rank")) & (F.col("_rank") < F.col("first_rank") + F.col("many"))
    return ranked.join(runs, hit).select(*[ranked[c] for c in items.columns],
                                         (F.col("first_sequence") + F.col("_rank") - F.col("first_rank")).alias("sequence_id"), "offset")


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end: int = END,
         ranks_path: str | None = None) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Sequences are filled from offset 0 without holes. Repeated texts are packed like any others;
    `docs` must have one row per id; an empty table gives no rows.
    """
    cut, _ = store.kept(pieces(docs, id_col, text_col, capacity, end, ranks_path), "pieces")
    return placed(cut, ["doc_id", "piece"], capacity=capacity)
