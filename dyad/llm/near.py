"""Near-duplicate documents by an exact set-similarity join on five-word shingles, at Jaccard 0.8.

A document is the set of the hashes of its shingles (lower case A-Z; fewer words are one shingle, a
text without words is the empty set). Documents with equal sets are one class, which its smallest id
stands for. Shingles are ordered by rarity, counted in a table of fixed size; two similar sets share
a shingle in their prefixes. Groups need no list of all pairs: first every document of a shared
shingle is held against the smallest id there, then only documents that are still in different groups
are held against each other, if the tokens that both prefixes hold leave room for the similarity. Every link is verified on the whole sets, so groups are those of all pairs.

Tokens of a prefix that the other prefix lacks, and that are no greater than its last, are in neither
set's overlap: that bounds it by the tokens shared so far and the rest of the set whose prefix ends first.

Most shingles occur once. They are told by a bit table of fixed size, filled by the hashes of those that two
prefixes hold; a posting whose bit is not set is never made. A false bit costs a posting and changes nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dyad.llm import components, rows, store, text

SHINGLE = 5
BITS = 18
SHARED_BITS = 26


def _sets(col: pa.Array, shingle: int) -> Iterator[np.ndarray]:
    """The distinct shingle hashes of every row, sorted."""
    words = text.Words(col)
    hashes = words.hashes(lower=True)
    whole = text.grams(hashes, shingle)
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist()):
        if b - a >= shingle:
            yield np.unique(whole[a:b - shingle + 1])
        else:
            yield text.grams(hashes[a:b], b - a) if b > a else hashes[:0]


def _counts(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(1 << BITS, np.int64)
        for batch in batches:
            for part in text.slices(batch):
                found = [own >> np.uint64(64 - BITS) for own in _sets(part.column("text"), shingle)]
                if found:
                    seen += np.bincount(np.concatenate(found).astype(np.int64), minlength=1 << BITS)
        at = np.flatnonzero(seen)
        yield pa.record_batch([pa.array(at, pa.int32()), pa.array(seen[at])], names=["b", "n"])
    return run


def rarity(source: DataFrame, shingle: int = SHINGLE) -> np.ndarray:
    """Logarithmic counts of all shingles, below 32, for each bucket of them."""
    ranks = np.zeros(1 << BITS, np.uint64)
    seen = source.select("text").mapInArrow(_counts(shingle), "b int, n long").groupBy("b").agg(F.sum("n").alias("n"))
    for b, c in seen.select("b", F.least(F.floor(F.log2(F.col("n") + 1)), F.lit(31)).cast("int")).collect():  # at most 1 << BITS rows
        ranks[b] = c
    return ranks


def _prefixes(shingle: int, ranks):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text.slices(batch):
                sizes, marks, prefixes = [], [], []
                for own in _sets(part.column("text"), shingle):
                    n = len(own)
                    place = np.sort(ranks.value[(own >> np.uint64(64 - BITS)).astype(np.int64)] << np.uint64(58) | own >> np.uint64(6))
                    sizes.append(n)
                    marks.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest())
                    prefixes.append(text.signed(place[:n - (4 * n + 4) // 5 + 1]) if n else np.zeros(0, np.int64))
                yield pa.record_batch([part.column("doc_id"), pa.array(sizes, pa.int32()), pa.array(marks, pa.binary()), pa.array(prefixes, pa.list_(pa.int64()))],
                                      names=["doc_id", "n", "mark", "prefix"])
    return run


def shared_bits(prefixes: DataFrame, bits: int = SHARED_BITS) -> np.ndarray:
    """A table of 2**bits bits in which every token of two or more rows of `prefix` has its bit set."""
    twice = prefixes.select(F.explode("prefix").alias("h")).groupBy("h").agg(F.count("*").alias("n")).where("n > 1")
    place, bit = F.shiftrightunsigned(_spread(F.col("h")), 64 - bits + 6).cast("int"), F.shiftrightunsigned(_spread(F.col("h")), 64 - bits).bitwiseAND(F.lit(63)).cast("int")
    words = twice.groupBy(place.alias("at")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit)).alias("w")).toArrow()  # at most 2**(bits - 6) rows
    table = np.zeros(1 << (bits - 6), np.int64)
    table[np.asarray(words.column("at"))] = np.asarray(words.column("w"))
    return table.view(np.uint64)


def _spread(token: Column) -> Column:
    """The token's hash bits moved to the top: the rarity in its upper six bits spreads badly."""
    return F.call_function("shiftleft", token, F.lit(6))


def _posted(shared, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            prefix = batch.column("prefix")
            sizes = np.asarray(prefix.value_lengths().fill_null(0), np.int64)
            tokens = np.asarray(prefix.flatten(), np.int64)
            row = np.repeat(np.arange(len(sizes)), sizes)
            at = np.arange(len(tokens)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            place = tokens.view(np.uint64) << np.uint64(6) >> np.uint64(64 - bits)
            keep = np.flatnonzero(table[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63)) & np.uint64(1))
            own = pa.array(row[keep])
            end = tokens[np.cumsum(sizes) - 1] if len(tokens) else tokens  # of the row; rows without tokens are not taken
            yield pa.record_batch([batch.column("doc_id").take(own), batch.column("n").take(own), pa.array(at[keep].astype(np.int32)), pa.array(tokens[keep]), pa.array(end[row[keep]])],
                                  names=["doc_id", "n", "at", "token", "end"])
    return run


def _beyond(n: Column) -> Column:
    """How much of a set of n is not in its prefix."""
    return F.floor((4 * n + 4) / 5) - 1


def _alike(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, own = None, None
        for batch in batches:
            links = []
            for u, v, a, b in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist(), batch.column("u_text"), batch.column("v_text")):
                if u != last:
                    last, own = u, next(_sets(pa.array([a.as_py()], pa.string()), shingle))
                other = next(_sets(pa.array([b.as_py()], pa.string()), shingle))
                if 9 * len(np.intersect1d(own, other, assume_unique=True)) >= 4 * (len(own) + len(other)):
                    links.append((u, v))
            yield pa.record_batch([pa.array([x[i] for x in links], pa.int64()) for i in (0, 1)], names=["u", "v"])
    return run


def _verified(source: DataFrame, pairs: DataFrame, shingle: int) -> DataFrame:
    """(u, v) of the candidates that reach the similarity, judged on their texts."""
    pairs, path = store.kept(pairs, "pairs")
    wanted = pairs.select(F.explode(F.array("u", "v")).alias("doc_id")).distinct()
    texts = source.join(wanted, "doc_id")
    left, right = (texts.select(F.col("doc_id").alias(c), F.col("text").alias(f"{c}_text")) for c in "uv")
    both = pairs.join(left, "u").join(right, "v").select("u", "v", "u_text", "v_text")
    found, _ = store.kept(both.mapInArrow(_alike(shingle), "u long, v long"), "links")
    store.drop(source.sparkSession, path)
    return found


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, bits: int = SHARED_BITS) -> DataFrame:
    """(doc_id, component_id) of every row with an id; component_id is the smallest id that links of similarity 0.8 reach.

    A null text has no words. `docs` must have one row per id; rows without an id are not linked. Empty in, empty out.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id is not null")
    ranks = spark.sparkContext.broadcast(rarity(source, shingle))
    sets, path = store.kept(source.mapInArrow(_prefixes(shingle, ranks), "doc_id long, n int, mark binary, prefix array<long>"), "prefixes")
    named, _ = store.kept(sets.select("doc_id", "mark").join(sets.groupBy("mark").agg(F.min("doc_id").alias("u")), "mark").select("doc_id", "u"), "classes")
    firsts = sets.select("doc_id", "n", "prefix").join(named.where("doc_id = u").select("doc_id"), "doc_id")
    shared = spark.sparkContext.broadcast(shared_bits(firsts, bits))
    posts, posts_path = store.kept(firsts.mapInArrow(_posted(shared, bits), "doc_id long, n int, at int, token long, end long"), "posts")
    store.drop(spark, path)
    first = posts.groupBy("token").agg(F.count("*").alias("many"), F.min(F.struct("doc_id", "n", "at")).alias("a")).where("many > 1").select("token", "a")

    x, y = F.col("a.n"), F.col("b.n")
    length = 5 * F.least(x, y) >= 4 * F.greatest(x, y)
    positional = 9 * F.least(x - F.col("a.at"), y - F.col("b.at")) >= 4 * (x + y)

    star = posts.join(first, "token").select("a", F.struct("doc_id", "n", "at").alias("b")).where((F.col("a.doc_id") < F.col("b.doc_id")) & length & positional)
    links = _verified(source, star.select(F.col("a.doc_id").alias("u"), F.col("b.doc_id").alias("v")).distinct(), shingle)
    roots, _ = store.kept(components.roots(links).select(F.col("u").alias("doc_id"), "root"), "roots")

    rest = posts.join(roots, "doc_id", "left").withColumn("root", F.coalesce("root", "doc_id"))
    mixed = rest.groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("token")
    rest, rest_path = store.kept(rest.join(mixed, "token"), "rest")
    store.drop(spark, posts_path)
    a, b = rest.alias("a"), rest.alias("b")
    near = a.join(b, (F.col("a.token") == F.col("b.token")) & (F.col("a.doc_id") < F.col("b.doc_id")) & (F.col("a.root") != F.col("b.root")) & length)
    # Documents of different groups meet here in every token that both prefixes hold.
    met = near.groupBy(F.col("a.doc_id").alias("u"), F.col("b.doc_id").alias("v")).agg(
        F.count("*").alias("shared"), F.bool_or(positional).alias("early"), *[F.first(f"{s}.{c}").alias(f"{s}_{c}") for s in "ab" for c in ("n", "end")])
    left = F.when(F.col("a_end") <= F.col("b_end"), _beyond(F.col("a_n"))).otherwise(_beyond(F.col("b_n")))
    room = 9 * (F.col("shared") + left) >= 4 * (F.col("a_n") + F.col("b_n"))
    more = _verified(source, met.where(F.col("early") & room).select("u", "v"), shingle)
    found, _ = store.kept(components.roots(links.unionByName(more)), "roots")
    store.drop(spark, rest_path)
    return named.join(found, "u", "left").select("doc_id", F.coalesce("root", "u").alias("component_id"))


def _later(docs: DataFrame, id_col: str, by: tuple[Callable[..., DataFrame], ...]) -> DataFrame:
    """The ids (column doc_id) that are not the smallest their links of any kind reach."""
    moved = [g(docs, id_col).where("component_id <> doc_id").select(F.col("doc_id").alias("u"), F.col("component_id").alias("v")) for g in by]
    if len(moved) == 1:
        return moved[0].select(F.col("u").alias("doc_id"))
    return components.roots(reduce(DataFrame.unionByName, moved)).where("root <> u").select(F.col("u").alias("doc_id"))


def first_of_groups(docs: DataFrame, by: tuple[Callable[..., DataFrame], ...] = (groups,)) -> DataFrame:
    """The rows of `docs` (doc_id, text and others) that are first in their group: the smallest id, and of rows with the same id one.

    `by` gives the kinds of groups, as functions of rows and the name of their key; groups that share a row are one.
    """
    if not rows.repeated(docs):
        later = _later(docs, "doc_id", by)
        return docs.join(later.hint("merge"), "doc_id", "left_anti").select(docs.columns)
    whole = docs.select("doc_id", "text", F.struct(*docs.columns).alias("whole"))  # a caller's own column may have the key's name
    own = rows.numbered(whole, "doc_id", "text")
    later = _later(own, "row", by).withColumnRenamed("doc_id", "row")
    return own.join(later.hint("merge"), "row", "left_anti").select("whole.*")
