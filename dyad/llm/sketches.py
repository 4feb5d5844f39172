"""Document fingerprints that keep every shingle hash below a fixed fraction of the hash range.

A shingle is a run of 16 characters; a shorter text is one shingle. Since all documents keep the same
part of the range, sketches of very unequal documents can be compared, and the sketch of a
collection is the union of its documents' sketches, thinned by the same rule. The fraction alone would leave short texts
without a single hash, so at least the smallest `LEAST` hashes are kept too; of two sketches only the range
that both hold in full is compared.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dyad.llm import store, text

SHINGLE = 16  # characters, a power of two
FRACTION = 64  # one hash in so many is kept
LEAST = 16
SLICE = 1 << 16  # characters hashed at a time
RANGE = 1 << 48  # of the hashes: enough to tell shingles apart, and short to store
LIMIT = RANGE // FRACTION

_MULTIPLIERS = [np.uint64(pow(0xBF58476D1CE4E5B9, 1 << j, 1 << 64)) for j in range(16)]


def shingle_hashes(value: str, shingle: int = SHINGLE) -> Iterator[np.ndarray]:
    """Hashes below `RANGE` of the runs of `shingle` characters, a stretch of the text at a time."""
    for a in range(0, max(len(value) - shingle, 0) + 1, SLICE):
        h = np.frombuffer(value[a:a + SLICE + shingle - 1].encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        if len(h) < shingle:
            h = text.grams(h, len(h)) if len(h) else h
        else:
            for j in range(shingle.bit_length() - 1):  # a run of 2w characters is two runs of w
                w = 1 << j
                h = h[:-w] * _MULTIPLIERS[j] + h[w:]
        yield text.mix(h) >> np.uint64(16)


def sketch(value: str, shingle: int = SHINGLE, least: int = LEAST, limit: int = LIMIT) -> np.ndarray:
    """The distinct hashes below `limit`, and the smallest `least` in any case, in order."""
    kept = np.zeros(0, np.uint64)
    for h in shingle_hashes(value, shingle):
        low = np.unique(h[h < limit])
        if len(low) < least:
            low = np.unique(h)[:least]
        kept = np.union1d(kept, low)
        kept = kept[:max(least, int(np.searchsorted(kept, limit)))]
    return kept


def merged(a: Column, b: Column, least: int = LEAST, limit: int = LIMIT) -> Column:
    """The sketch of both documents' shingles together."""
    both = F.array_sort(F.array_union(a, b))
    return F.filter(both, lambda h, i: (h < limit) | (i < least))


def containment(a: Column, b: Column, least: int = LEAST, limit: int = LIMIT) -> Column:
    """The share of the smaller sketch that the other holds, over the range that both hold in full.

    Two equal sketches have 1, also empty ones; if a sketch has nothing in that range, it is 0.
    """
    def reach(s: Column) -> Column:  # below it the sketch lacks nothing
        return F.when(F.size(s) < least, F.lit(RANGE)).otherwise(F.greatest(F.lit(limit), F.element_at(s, -1) + 1))
    top = F.least(reach(a), reach(b))
    x, y = (F.filter(s, lambda h: h < top) for s in (a, b))
    share = F.size(F.array_intersect(x, y)) / F.least(F.size(x), F.size(y))
    return F.when(a == b, F.lit(1.0)).when(F.least(F.size(x), F.size(y)) == 0, F.lit(0.0)).otherwise(share)


def contained(a: np.ndarray, b: np.ndarray, least: int = LEAST, limit: int = LIMIT) -> float:
    """`containment` of two sketches inside a task."""
    if len(a) == len(b) and (a == b).all():
        return 1.0
    top = min(RANGE if len(s) < least else max(limit, int(s[-1]) + 1) for s in (a, b))
    x, y = (s[:np.searchsorted(s, top)] for s in (a, b))
    smaller = min(len(x), len(y))
    return len(np.intersect1d(x, y, assume_unique=True)) / smaller if smaller else 0.0


def sketched(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, sketch (array of longs, in order) of every row. A null text is empty and has an empty sketch; rows stay as they are."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text.slices(batch):
                found = [text.signed(sketch(t.as_py())) for t in part.column("text")]
                yield pa.record_batch([part.column("doc_id"), pa.array(found, pa.list_(pa.int64()))], names=["doc_id", "sketch"])
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return source.mapInArrow(run, "doc_id long, sketch array<long>")


_ROW = "doc_id long, n_chars long, edited_sha256 string, sketch array<long>, edited array<long>, near_edited double, near_next double"
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("sketch", pa.list_(pa.int64())), ("edited", pa.list_(pa.int64())),
                     ("near_edited", pa.float64()), ("near_next", pa.float64())])
_FIELDS = _SCHEMA.names


def _row(key: int | None, own: str, sk: np.ndarray, after: str, after_sk: np.ndarray) -> tuple:
    cut = len(own) // 3
    edited = own[:len(own) - cut] + after[:cut]
    new = sketch(edited)
    return (key, len(own), hashlib.sha256(edited.encode()).hexdigest(), text.signed(sk), text.signed(new), contained(sk, new), contained(sk, after_sk))


def _paired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with their successor in the partition; its first and last row also come as they are, for the seams."""
    schema = pa.schema([*_SCHEMA, ("part", pa.int32()), ("first", pa.string()), ("last", pa.string())])
    none = (None,) * len(_FIELDS)
    before, spot = None, None
    for batch in batches:
        for part in text.slices(batch):
            done = []
            for key, value in zip(part.column("doc_id").to_pylist(), part.column("text")):
                own = value.as_py()
                sk = sketch(own)
                if before is None:
                    spot = part.column("part")[0].as_py()
                    done.append((*none, spot, own, None))
                else:
                    done.append(_row(*before, own, sk) + (None, None, None))
                before = (key, own, sk)
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*done), schema, strict=True)], schema=schema)
    if before is not None:
        yield pa.record_batch([pa.array([c], f.type) for c, f in zip((before[0], *none[1:], spot, None, before[1]), schema, strict=True)], schema=schema)


def _seams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in range(batch.num_rows):
            key, own, after = (batch.column(c)[r].as_py() for c in ("doc_id", "last", "first"))
            row = _row(key, own, sketch(own), after, sketch(after))
            yield pa.record_batch([pa.array([c], f.type) for c, f in zip(row, _SCHEMA, strict=True)], schema=_SCHEMA)


def edited_sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: doc_id, n_chars, edited_sha256, the sketches of the text and of its edited form, and near_edited and
    near_next, how much of the text's sketch that of the edited form and that of the next document contain.

    In the edited form the last third of the characters is replaced by as many of the next document's
    first; next is the one with the next smaller id, after the last the first. Rows of one id are
    documents of their own, in the order of their texts' hashes (equal rows in any); rows without an id come last. A null text is empty. A
    single document is its own next. Empty in, empty out.

    Texts are sorted in one range shuffle and read once; only the first and last row of each partition meet by a join.
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    spread = [F.desc_nulls_last("doc_id"), F.xxhash64("text"), F.monotonically_increasing_id()]  # the last splits a run of equal rows
    ordered = source.withColumns({"h": spread[1], "i": spread[2]}).orderBy(spread[0], "h", "i").select("doc_id", "text", F.spark_partition_id().alias("part"))
    rows, _ = store.kept(ordered.mapInArrow(_paired, f"{_ROW}, part int, first string, last string"), "neighbours")
    # One row a partition: the first of the next one that has rows, and after the last that of the first.
    firsts = rows.where("first is not null").select("part", "first")
    turn = Window.orderBy("part")
    after = firsts.select("part").select("part", F.coalesce(F.lead("part").over(turn), F.first("part").over(turn.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("follower"))
    ends = rows.where("last is not null").select("doc_id", "last", "part").join(after, "part").drop("part")
    seams = ends.join(firsts.withColumnRenamed("part", "follower"), "follower").select("doc_id", "last", "first").mapInArrow(_seams, _ROW)
    return rows.where("first is null and last is null").select(_FIELDS).unionByName(seams)


def as_text(s: Column) -> Column:
    """A sketch as a string: its hashes in hexadecimal, 12 digits each."""
    return F.array_join(F.transform(s, lambda h: F.lower(F.lpad(F.hex(h), 12, "0"))), "")
