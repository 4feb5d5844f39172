"""Document likelihood under a subword lattice, beside a word unigram baseline.

The pieces of a public vocabulary get unigram probabilities from the training documents: their
relative frequency when the vocabulary splits every training word. A word's probability is the sum
over all its segmentations into pieces, by a forward recursion in log space; a document's is the
product over its words and one end mark. Counts come from all training documents. The recursion runs
once per distinct word of the corpus, not once per place.
"""

from __future__ import annotations

import functools
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dyad.llm import store, text

COMMON = 1 << 20  # a word is common if it is one in this many words or more, so there are no more common words than this
FLUSH = 400_000
SMOOTH = 0.5
_LN10 = math.log(10)
_NONE = -math.inf


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 10 == 0, F.lit(False))


def words_of(value: str | None) -> list[bytes]:
    return (value or "").encode().lower().split()


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of a stretch of rows with how often they stand in training rows and in all."""
    train: Counter = Counter()
    other: Counter = Counter()

    def out() -> pa.RecordBatch:
        words = list(train.keys() | other.keys())
        batch = pa.record_batch([pa.array(words, pa.binary()), pa.array([train[w] for w in words], pa.int64()),
                                 pa.array([train[w] + other[w] for w in words], pa.int64())], names=["word", "seen", "places"])
        train.clear()
        other.clear()
        return batch

    for batch in batches:
        for value, held in zip(batch.column("text"), batch.column("held_out")):
            (other if held.as_py() else train).update(words_of(value.as_py()))
            if len(train) + len(other) > FLUSH:
                yield out()
    if train or other:
        yield out()


@functools.cache
def _splitter(model_path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=model_path)


def _split(model_path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp = _splitter(model_path)
        total = np.zeros(sp.get_piece_size(), np.int64)
        for batch in batches:
            ids = sp.encode([w.decode() for w in batch.column("word").to_pylist()], num_threads=1)
            sizes = np.fromiter(map(len, ids), np.int64, len(ids))
            flat = np.fromiter((i for x in ids for i in x), np.int64, int(sizes.sum()))
            np.add.at(total, flat, np.repeat(np.asarray(batch.column("seen")), sizes))
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at), pa.array(total[at])], names=["piece", "n"])
    return run


class Lattice:
    """Log probabilities of pieces and the forward recursion over a word."""

    def __init__(self, pieces: dict[str, float], single: dict[int, float]):
        """`single`: log probability of each byte piece, for characters that are no piece."""
        self.known: dict[str, float | None] = {}
        for p in pieces:
            for i in range(1, len(p)):
                self.known.setdefault(p[:i], None)
        self.known.update(pieces)
        self.single, self.longest = single, max(map(len, pieces), default=1)

    def word(self, word: str) -> float:
        """Natural log of the summed probability of all segmentations of a word with its start mark."""
        line = "▁" + word
        n, get, longest = len(line), self.known.get, self.longest
        alpha = [_NONE] * (n + 1)
        alpha[0] = 0.0
        exp, log1p = math.exp, math.log1p
        for i in range(n):
            a = alpha[i]
            if a == _NONE:
                continue
            if get(line[i]) is None:
                v = a + sum(self.single[b] for b in line[i].encode())
                b = alpha[i + 1]
                alpha[i + 1] = v if b == _NONE else max(v, b) + log1p(exp(-abs(v - b)))
            for j in range(i + 1, min(i + longest, n) + 1):
                part = line[i:j]
                p = get(part, 1.0)
                if p is None:
                    continue
                if p == 1.0:
                    break
                v = a + p
                b = alpha[j]
                alpha[j] = v if b == _NONE else (v + log1p(exp(b - v)) if v > b else b + log1p(exp(v - b)))
        return alpha[n]


def lattice(counts: dict[int, int], ends: int, model_path: str) -> tuple[dict[str, float], dict[int, float], float]:
    """Log probabilities of pieces, of byte pieces and of the end, from counts of piece ids."""
    sp = _splitter(model_path)
    usable = [i for i in range(sp.get_piece_size()) if not sp.is_control(i) and not sp.is_unknown(i)]
    total = math.log(sum(counts.get(i, 0) + SMOOTH for i in usable) + ends + SMOOTH)
    prob = {i: math.log(counts.get(i, 0) + SMOOTH) - total for i in usable}
    single = {int(sp.id_to_piece(i)[3:5], 16): prob[i] for i in usable if sp.is_byte(i)}
    return {sp.id_to_piece(i): prob[i] for i in usable if not sp.is_byte(i)}, single, math.log(ends + SMOOTH) - total


def _summed(pieces, single):
    made: list[Lattice] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not made:
            made.append(Lattice(pieces.value, single))
        for batch in batches:
            scores = [made[0].word(w.decode()) / _LN10 for w in batch.column("word").to_pylist()]
            yield pa.record_batch([*batch.columns, pa.array(scores, pa.float64())], names=["word", "seen", "places", "score"])
    return run


def _looked_up(common, floor: float):
    """Sums over the common words of each row; its other words are left for the join."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = common.value
        for part in (p for batch in batches for p in text.slices(batch, most=8 << 20)):
            rows, tails = [], []
            for value in part.column("text"):
                n, known, base, score, tail = 0, 0, 0.0, 0.0, []
                for w, k in Counter(words_of(value.as_py())).items():
                    n += k
                    if found := table.get(w):
                        seen, s = found
                        known += k * (seen > 0)
                        base += k * (math.log10(seen + 0.1) - floor)
                        score += k * s
                    else:
                        tail.append({"word": w, "n": k})
                rows.append((n, known, base, score))
                tails.append(tail)
            cols = list(zip(*rows)) or [()] * 4
            yield pa.record_batch([part.column("doc_id"), part.column("row"), part.column("held_out"), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()),
                                   pa.array(cols[2], pa.float64()), pa.array(cols[3], pa.float64()),
                                   pa.array(tails, pa.list_(pa.struct([("word", pa.binary()), ("n", pa.int64())])))],
                                  names=["doc_id", "row", "held_out", "n_words", "n_known", "base", "score", "rest"])
    return run


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def scored(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model_path: str | None = None, common: int = COMMON) -> DataFrame:
    """One row per row of `docs`: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Words in lower case (A-Z) and one end per document are the tokens. base_score is the log10
    probability under smoothed word counts, score the log10 probability under the lattice. A null or
    empty text is an end alone; without training documents all counts are zero. Rows of one id are
    documents of their own; rows without an id count as training. Empty in, empty out.
    """
    spark = docs.sparkSession
    model_path = model_path or default_model()
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).withColumn("held_out", held_out(F.col("doc_id")))
    keyed = source.withColumn("row", F.monotonically_increasing_id())  # written below, so each row keeps its key
    counts = source.select("text", "held_out").mapInArrow(_counted, "word binary, seen long, places long").groupBy("word").agg(
        F.sum("seen").alias("seen"), F.sum("places").alias("places"))
    counts, counts_path = store.kept(counts, "words")
    ends = source.where(~F.col("held_out")).count()
    n, known, places = counts.agg(F.coalesce(F.sum("seen"), F.lit(0)), F.count_if(F.col("seen") > 0), F.coalesce(F.sum("places"), F.lit(0))).first()
    n, known = n + ends, known + (ends > 0)
    floor = math.log10(n + 0.1 * (known + 1))

    split = counts.where("seen > 0").select("word", "seen").mapInArrow(_split(model_path), "piece long, n long").groupBy("piece").agg(F.sum("n").alias("n"))
    pieces, single, end = lattice({r[0]: r[1] for r in split.collect()}, ends, model_path)  # as many rows as the vocabulary has pieces
    words, _ = store.kept(counts.mapInArrow(_summed(spark.sparkContext.broadcast(pieces), single), "word binary, seen long, places long, score double"), "scores")
    store.drop(spark, counts_path)

    often = F.col("places") * F.lit(common) >= F.lit(places)
    top = {bytes(r[0]): (r[1], r[2]) for r in words.where(often).select("word", "seen", "score").toLocalIterator()}  # no more than `common` rows
    rows, _ = store.kept(keyed.mapInArrow(_looked_up(spark.sparkContext.broadcast(top), floor), "doc_id long, row long, held_out boolean, n_words long, n_known long, "
                                           "base double, score double, rest array<struct<word:binary,n:bigint>>"), "rows")
    rest = rows.select("doc_id", "row", "held_out", F.explode("rest").alias("r")).select("doc_id", "row", "held_out", "r.word", "r.n").join(
        words.where(~often).select("word", "seen", F.col("score").alias("s")), "word")
    rest = rest.select("doc_id", "row", "held_out", F.lit(0).cast("long").alias("n_words"), F.when(F.col("seen") > 0, F.col("n")).otherwise(0).alias("n_known"),
                       (F.col("n") * (F.log10(F.col("seen") + 0.1) - F.lit(floor))).alias("base"), (F.col("n") * F.col("s")).alias("score"), F.lit(0).cast("long").alias("ends"))
    whole = rows.select("doc_id", "row", "held_out", "n_words", "n_known", "base", "score", F.lit(1).cast("long").alias("ends")).unionByName(rest)
    sums = whole.groupBy("row", "doc_id", "held_out").agg(*(F.sum(c).alias(c) for c in ("n_words", "n_known", "base", "score", "ends")))
    return sums.select("doc_id", "held_out", (F.col("n_words") + F.col("ends")).alias("n_tokens"),
                       (F.col("n_known") + (F.col("ends") if ends else F.lit(0))).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
                       (F.col("base") + F.col("ends") * (math.log10(ends + 0.1) - floor)).alias("base_score"),
                       (F.col("score") + F.col("ends") * (end / _LN10)).alias("score"))
