"""Benchmark decontamination: short items inside long documents, by size-partitioned MinHash containment.

An item is a set of word shingles. It counts as contained in a document that has at least a share
`threshold` of them. An item of q shingles is sketched by its floor((1 - threshold) q) + 1 smallest
shingle hashes: a document with enough of the item has at least one of these, so no item can be missed.
Items are partitioned by size; a partition has a largest sketch hash, and only the document hashes below
it are looked up, which is most telling for large items. What is found is verified on the shingles
themselves. Documents are never sketched, whatever their length.

Items are the stated query set: they are dealt into blocks of bounded size, and each block is held
against all documents in one pass.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dyad.llm import text

SHINGLE = 5
THRESHOLD = 0.8
BLOCK_BYTES = 2 << 20


def shingles(value: bytes, k: int) -> set[bytes]:
    words = value.lower().split()
    return {b" ".join(words[i:i + k]) for i in range(len(words) - k + 1)}


class Index:
    """Sketches of a block of items, by shingle length and size."""

    def __init__(self, items: list[tuple[int, str]], shingle: int, threshold: float):
        self.threshold = threshold
        self.items: list[tuple[int, int, set[bytes]]] = []  # id, shingle length, shingles
        parts: dict[tuple[int, int], list[tuple[np.ndarray, int]]] = {}
        for key, value in items:
            raw = (value or "").encode()
            k = min(shingle, len(raw.split()))
            if not k:
                continue
            own = shingles(raw, k)
            hashes = np.unique(text.grams(text.Words(pa.array([value])).hashes(lower=True), k))
            sketch = hashes[:math.floor(round((1 - threshold) * len(own), 9)) + 1]
            parts.setdefault((k, len(own).bit_length()), []).append((sketch, len(self.items)))
            self.items.append((key, k, own))
        self.parts: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for (k, _), found in parts.items():
            hashes = np.concatenate([s for s, _ in found])
            owners = np.concatenate([np.full(len(s), i) for s, i in found])
            order = np.argsort(hashes, kind="stable")
            self.parts.setdefault(k, []).append((hashes[order], owners[order]))

    def hits(self, col: pa.Array) -> Iterator[tuple[int, int, int, int]]:
        """(row, item id, shingles of the item, shared shingles) of every contained item."""
        words = text.Words(col)
        hashes = words.hashes(lower=True)
        pairs: set[tuple[int, int]] = set()
        for k, sketches in self.parts.items():
            own = text.grams(hashes, k)
            for keys, owners in sketches:
                at = np.flatnonzero(own <= keys[-1])
                low = np.searchsorted(keys, own[at])
                hit = keys[low] == own[at]
                at, low = at[hit], low[hit]
                rows = np.searchsorted(words.first, at, side="right") - 1
                whole = at + k <= words.first[rows + 1]
                for row, first in set(zip(rows[whole].tolist(), low[whole].tolist())):
                    stop = np.searchsorted(keys, keys[first], side="right")
                    pairs.update((row, i) for i in owners[first:stop].tolist())
        seen: dict[tuple[int, int], set[bytes]] = {}
        for row, i in sorted(pairs):
            key, k, own = self.items[i]
            if (row, k) not in seen:
                seen = {(row, k): shingles(col[row].as_py().encode(), k)}
            shared = len(own & seen[row, k])
            if shared >= math.ceil(round(self.threshold * len(own), 9)):
                yield row, key, len(own), shared


@functools.lru_cache(maxsize=2)
def _index(block, shingle: int, threshold: float) -> Index:
    return Index(block.value, shingle, threshold)


def _blocks(items: DataFrame, id_col: str | None, text_col: str, block_bytes: int) -> list:
    """Broadcasts of (id, text) lists of about `block_bytes` each; without an id column all items have the id 0."""
    spark = items.sparkSession
    key = F.lit(0).cast("long") if id_col is None else F.col(id_col).try_cast("long")
    if id_col is not None and not items.where(key.isNull() & F.col(id_col).isNotNull()).isEmpty():
        raise ValueError(f"{id_col} has ids that are not integers")
    rows = items.select(key.alias("id"), F.col(text_col).cast("string").alias("text")).where("id is not null")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    out = []
    for i in range(blocks):
        part = rows.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == i)
        out.append(spark.sparkContext.broadcast([(r[0], r[1]) for r in part.collect()]))
    return out


def contained(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
              item_text: str = "text", shingle: int = SHINGLE, threshold: float = THRESHOLD, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, item_id, n_shingles, n_shared): every item of which a document has the given share of shingles.

    Words are compared in lower case (A-Z). An item of fewer words than a shingle is one shingle of
    its own length; one without words, or without an id, is contained nowhere. Null and empty
    documents contain nothing. Repeated documents and repeated items each have rows of their own.
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out = None
    for block in _blocks(items, item_col, item_text, block_bytes):
        def run(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            index = _index(block, shingle, threshold)
            for batch in batches:
                for part in text.slices(batch):
                    found = list(index.hits(part.column("text")))
                    if found:
                        rows, *cols = zip(*found)
                        yield pa.record_batch([part.column("doc_id").take(pa.array(rows)), *(pa.array(c, pa.int64()) for c in cols)],
                                              names=["doc_id", "item_id", "n_shingles", "n_shared"])
        found = source.mapInArrow(run, "doc_id long, item_id long, n_shingles long, n_shared long")
        out = found if out is None else out.unionByName(found)
    return out


def _leaks(block, shingle: int, threshold: float):
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        index = _index(block, shingle, threshold)
        for series in texts:
            batch = pa.record_batch([pa.array(series, pa.string())], names=["text"])
            bad, at = np.zeros(len(series), bool), 0
            for part in text.slices(batch):
                bad[[at + row for row, *_ in index.hits(part.column("text"))]] = True
                at += part.num_rows
            yield pd.Series(bad)
    return F.pandas_udf(run, "boolean")


def clean(docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
          shingle: int = SHINGLE, threshold: float = THRESHOLD, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of `docs` that contain no item, all columns as they are; texts are not shuffled. Ids of items do not matter."""
    for block in _blocks(items, None, item_text, block_bytes):
        docs = docs.where(~_leaks(block, shingle, threshold)(F.col(text_col).cast("string")))
    return docs
