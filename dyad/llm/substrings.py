"""Repeated passages over a length threshold, by seed and extend.

Seeds: of the hashes of SEED consecutive words, every window of `size` words picks its smallest, so
two places with the same words in a window always pick the same seed at the same point of it.
Neighbouring windows with one seed form a run. Extend: places are joined on their seed and compared
over all the words their windows reach to both sides. A run whose whole reach also stands earlier is
a repeat; where one seed has different surroundings, the first place of each is compared window by
window. Repeats that touch are merged into maximal ones. No two places are ever paired: a group is
told apart by hashes of its surroundings (two 64-bit hashes that must agree), and each place is
measured against the first of its kind. Texts meet their ranges by a merge join at every size: the
ranges grow with the corpus and are never broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dyad.llm import rows, store, text

SIZE = 20
SEED = 8


class _Hashed:
    """Words of a slice with a hash of any range of them."""

    def __init__(self, part: pa.RecordBatch):
        self.words = text.Words(part.column("text"))
        self.each = self.words.hashes()
        up, self.down = text.powers(len(self.each))
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.each * up)])

    def between(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return text.mix((self.sums[end] - self.sums[start]) * self.down[start])


def _runs(size: int, seed: int):
    reach = size - seed + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for part in text.slices(batch):
                h = _Hashed(part)
                first, n = h.words.first, len(h.each)
                if n < size:
                    continue
                seeds = text.grams(h.each, seed)
                pick = np.arange(n - size + 1) + np.lib.stride_tricks.sliding_window_view(seeds, reach).argmin(axis=1)
                row = np.repeat(np.arange(len(first) - 1), np.diff(first))[:n - size + 1]
                inside = np.flatnonzero(np.arange(size, n + 1) <= first[row + 1])
                if not len(inside):
                    continue
                new = np.ones(len(inside), bool)
                new[1:] = (np.diff(inside) > 1) | (np.diff(pick[inside]) != 0)
                lo = inside[new]
                hi = inside[np.append(np.flatnonzero(new)[1:] - 1, len(inside) - 1)]
                ids = part.column("doc_id").to_numpy(zero_copy_only=False)[row[lo]].astype(np.int64)
                out.append((seeds[pick[lo]], text.mix(h.between(lo, hi + size) + (hi - lo).astype(np.uint64)), ids, (lo - first[row[lo]]) * 64 + hi - lo))
            if not out:
                continue
            key, reached, ids, at = (np.concatenate(x) for x in zip(*out))
            order = np.lexsort((at, ids, reached, key))
            key, reached, ids, at = key[order], reached[order], ids[order], at[order]
            later = np.zeros(len(key), bool)
            later[1:] = (key[1:] == key[:-1]) & (reached[1:] == reached[:-1])
            spread = text.mix(ids.astype(np.uint64) ^ text.mix(at.astype(np.uint64)))
            key = np.where(later, spread, key)  # settled here: dealt out evenly, so a hot passage leaves a task once
            yield pa.record_batch([pa.array(text.signed(key)), pa.array(text.signed(reached)), pa.array(ids), pa.array(at), pa.array(later)],
                                  names=["seed", "reached", "doc_id", "at", "later"])
    return run


def _windows(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text.slices(batch):
                h = _Hashed(part)
                checks = part.column("checks")
                many = np.asarray(pc.list_value_length(checks))
                flat = checks.flatten()
                row = np.repeat(np.arange(len(many)), many)
                seed, at = (np.asarray(flat.field(i)) for i in (0, 1))
                reps = at % 64 + 1
                ends = np.cumsum(reps)
                which = np.repeat(np.arange(len(at)), reps)
                start = (at // 64)[which] + np.arange(ends[-1]) - (ends - reps)[which]
                where = start + h.words.first[row[which]]
                ids = part.column("doc_id").to_numpy(zero_copy_only=False)[row[which]].astype(np.int64)
                yield pa.record_batch([pa.array(seed[which]), pa.array(text.signed(h.between(where, where + size))), pa.array(ids), pa.array(start)],
                                      names=["seed", "words", "doc_id", "start"])
    return run


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in text.slices(batch):
            ids, words, gone, left = part.column("doc_id"), [], [], []
            for value, spans in zip(part.column("text").to_pylist(), part.column("spans").to_pylist()):
                all_words = (value or "").encode().split()
                mask = np.ones(len(all_words), bool)
                for s in spans or ():
                    mask[s["start"]:s["end"]] = False
                keep = mask.sum()
                words.append(len(mask))
                gone.append(len(mask) - keep)
                left.append(b" ".join(all_words if keep == len(mask) else [all_words[i] for i in np.flatnonzero(mask)]).decode())
            yield pa.record_batch([ids, pa.array(words, pa.int64()), pa.array(gone, pa.int64()), pa.array(left)], names=["doc_id", "n_words", "n_removed", "text"])


def _source(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ranges that overlap or touch as one, in order."""
    for batch in batches:
        out = []
        for ranges in batch.column("spans").to_pylist():
            whole: list[dict] = []
            for r in sorted(ranges, key=lambda r: r["start"]):
                if whole and r["start"] <= whole[-1]["end"]:
                    whole[-1]["end"] = max(whole[-1]["end"], r["end"])
                else:
                    whole.append(dict(r))
            out.append(whole)
        yield pa.record_batch([batch.column("doc_id"), pa.array(out, batch.schema.field("spans").type)], names=["doc_id", "spans"])


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, seed: int = SEED) -> DataFrame:
    """doc_id and spans (start, end word, end exclusive): maximal ranges covered by windows of `size` words
    that also start earlier, in a smaller id or further up in the same document.

    Words are compared byte by byte. Nulls and texts of fewer words have no spans; only documents
    with spans have a row. Rows without an id are not looked at. Rows with the same id are documents
    of their own, ordered by the hash of their texts; of equal rows one is first.
    """
    keyed, id_col, text_col = _keyed(docs, id_col, text_col)
    found = _repeats(keyed, id_col, text_col, size, seed)
    return found if id_col != "row" else found.withColumnRenamed("doc_id", "row").join(keyed.select("row", "doc_id"), "row").select("doc_id", "spans")


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, str, str]:
    """The table and its key and text columns: the id where it tells rows apart, else `row` of a written table with doc_id and text."""
    if not rows.repeated(docs, id_col):
        return _source(docs, id_col, text_col), "doc_id", "text"
    return rows.numbered(_source(docs, id_col, text_col), "doc_id", "text"), "row", "text"


def _repeats(docs: DataFrame, id_col: str, text_col: str, size: int, seed: int) -> DataFrame:
    if not 0 < seed <= size <= 60 + seed:
        raise ValueError("a window must hold the seed and at most 60 words more")
    source = _source(docs, id_col, text_col).where("doc_id is not null")
    placed = source.mapInArrow(_runs(size, seed), "seed long, reached long, doc_id long, at long, later boolean")
    same = Window.partitionBy("seed", "reached").orderBy("doc_id", "at")
    about = Window.partitionBy("seed")
    flagged = placed.withColumn("nth", F.row_number().over(same)).withColumn("many", F.min("reached").over(about) != F.max("reached").over(about))
    flagged = flagged.select("seed", "doc_id", "at", (F.col("later") | (F.col("nth") > 1)).alias("later"), "many").where("later or many")
    flagged, _ = store.kept(flagged, "runs")
    lo = F.floor(F.col("at") / 64).cast("int")
    whole = flagged.where("later").select("doc_id", lo.alias("start"), (lo + F.col("at") % 64 + size).cast("int").alias("end"))
    checks = flagged.where("not later").groupBy("doc_id").agg(F.collect_list(F.struct("seed", "at")).alias("checks"))
    windows = source.join(checks.hint("merge"), "doc_id").mapInArrow(_windows(size), "seed long, words long, doc_id long, start long")
    nth = F.row_number().over(Window.partitionBy("seed", "words").orderBy("doc_id", "start"))
    single = windows.withColumn("nth", nth).where("nth > 1").select("doc_id", F.col("start").cast("int").alias("start"), (F.col("start") + size).cast("int").alias("end"))
    lists = whole.unionByName(single).groupBy("doc_id").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    return lists.mapInArrow(_joined, "doc_id long, spans array<struct<start:int,end:int>>")


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, seed: int = SEED) -> DataFrame:
    """One row per row of `docs`: doc_id, n_words, n_removed, text (the words left, joined by one space).

    Windows are judged on the input, and rows with the same id as in `repeats`. A null text has no words.
    Empty in, empty out.
    """
    keyed, key, text_col = _keyed(docs, id_col, text_col)
    found, _ = store.kept(_repeats(keyed, key, text_col, size, seed), "spans")
    found = found.withColumnRenamed("doc_id", key)
    return keyed.join(found.hint("merge"), key, "left").select("doc_id", "text", "spans").mapInArrow(_kept, "doc_id long, n_words long, n_removed long, text string")
