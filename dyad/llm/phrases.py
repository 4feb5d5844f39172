"""Collocations from a weighted de Bruijn graph of words.

Words are read in pieces, which end at punctuation and line ends. Every word begins one gram: the
longest run of up to four words inside its piece. Grams of four words are the weighted edges of a
graph whose nodes are runs of three words, shorter grams are the ends of pieces. Edges of enough
weight are compacted along unary paths (nodes with one edge in and one out, of equal weight); the
count of every shorter phrase is the flow out of its node plus the pieces that end there.

Only phrases with enough occurrences matter, so a gram is cut short where a word, or two words in a
row, occur too rarely anywhere: what is counted lies between such places, and the cut is one more
end of a piece. Rare places come from a bit table of fixed size, filled by the hashes of all frequent
words and word pairs; a false bit costs a longer gram and changes no count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dyad.llm import store, text

ORDER = 4  # words of an edge
SUPPORT = 30
TOP = 2000
SCALE = 2_000_000  # of the score: 10**6 for a phrase that is all of both its parts
FILTER_BITS = 26
HASH_BITS = 32  # of a word or pair while they are counted: two of one hash count together, which can only keep a rare one
STRETCH = 256  # edges in one row of a path
SLICE_BYTES = 1 << 22
SALTS = 64

_BREAK = np.zeros(256, bool)
_BREAK[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = True
_GAPS = _BREAK.copy()
_GAPS[[9, 32]] = True
_M = np.uint64(0x9FB21C651E98DF25)


def _gather(buf: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of the given ranges one after another, and where each begins."""
    at = np.zeros(len(sizes) + 1, np.int64)
    np.cumsum(sizes, out=at[1:])
    return buf[np.arange(at[-1]) + np.repeat(starts - at[:-1], sizes)], at


class Pieces:
    """Words of a slice in lower case with their languages, and whether the next word follows in the same piece."""

    def __init__(self, part: pa.RecordBatch):
        words = text.Words(part.column("text"), _GAPS)
        n = len(words.starts)
        self.size = words.ends - words.starts
        langs = part.column("lang").dictionary_encode()
        self.names = langs.dictionary
        self.lang = np.repeat(np.asarray(langs.indices).astype(np.int64), np.diff(words.first))
        breaks = np.cumsum(_BREAK[words.buf])
        self.follows = np.zeros(n, bool)
        if n:
            self.follows[:-1] = breaks[words.starts[1:]] == breaks[words.ends[:-1] - 1]
            last = words.first[1:] - 1
            self.follows[last[last >= 0]] = False
        seeds = np.array([xxhash.xxh64_intdigest(x.encode()) for x in self.names.to_pylist()], np.uint64)
        self.hash = text.mix(words.hashes(lower=True) + seeds[self.lang]) if n else np.zeros(0, np.uint64)
        self.pair = text.mix(self.hash[:-1] * _M + self.hash[1:])
        # The same words one blank apart: a gram is one range of bytes.
        padded = np.append(text.LOWER[words.buf], np.uint8(32))
        self.line, at = _gather(padded, words.starts, self.size + 1)
        self.starts = at[:-1]
        self.line[at[1:] - 1] = 32

    def ids(self) -> np.ndarray:
        """A number for every word, equal for equal words of one language."""
        _, first, ids = np.unique(self.hash, return_index=True, return_inverse=True)
        model = first[ids]
        alike = (self.size[model] == self.size).all() and (self.lang[model] == self.lang).all()
        if alike and (self.line[_gather(np.arange(len(self.line)), self.starts[model], self.size + 1)[0]] == self.line).all():
            return ids.astype(np.int64)
        known: dict[tuple[int, bytes], int] = {}  # two words of one hash
        whole = self.line.tobytes()
        return np.array([known.setdefault((k, whole[a:a + s]), len(known)) for k, a, s in zip(self.lang.tolist(), self.starts.tolist(), self.size.tolist())], np.int64)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in text.slices(batch, most=SLICE_BYTES):
            p = Pieces(part)
            seen, n = np.unique(np.concatenate([p.hash, p.pair[p.follows[:-1]]]) >> np.uint64(64 - HASH_BITS), return_counts=True)
            yield pa.record_batch([pa.array(text.signed(seen)), pa.array(n)], names=["h", "n"])


def frequent_bits(source: DataFrame, support: int = SUPPORT, bits: int = FILTER_BITS) -> np.ndarray:
    """A table of 2**bits bits in which every word and word pair that occurs `support` times has its bit set."""
    often = source.mapInArrow(_hashed, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= support)
    place, bit = F.shiftright("h", HASH_BITS - bits + 6).cast("int"), F.shiftright("h", HASH_BITS - bits).bitwiseAND(F.lit(63)).cast("int")
    words = often.groupBy(place.alias("at")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit)).alias("w")).toArrow()  # at most 2**(bits - 6) rows
    table = np.zeros(1 << (bits - 6), np.int64)
    table[np.asarray(words.column("at"))] = np.asarray(words.column("w"))
    return table.view(np.uint64)


def _looked_up(table: np.ndarray, bits: int, h: np.ndarray) -> np.ndarray:
    place = h >> np.uint64(64 - bits)
    return (table[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63)) & np.uint64(1)).astype(bool)


def _grams(shared, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text.slices(batch, most=SLICE_BYTES):
                yield from _grams_of(Pieces(part), shared.value, bits)
    return run


def _grams_of(p: Pieces, table: np.ndarray, bits: int) -> Iterator[pa.RecordBatch]:
    """lang, size, gram, n of the grams that begin at each word; rows of size 0 count all words."""
    names = ["lang", "size", "gram", "n"]
    total = np.bincount(p.lang, minlength=len(p.names))
    yield pa.record_batch([p.names, pa.array(np.zeros(len(p.names), np.int32)), pa.nulls(len(p.names), pa.string()), pa.array(total.astype(np.int64))], names=names)
    n = len(p.hash)
    if not n:
        return
    ok = _looked_up(table, bits, p.hash)
    link = np.zeros(n + ORDER, bool)
    link[:n - 1] = p.follows[:-1] & ok[:-1] & ok[1:] & _looked_up(table, bits, p.pair)
    size = np.zeros(n, np.int64)
    for j in range(ORDER - 2, -1, -1):
        size = np.where(link[j:n + j], size + 1, 0)
    size = np.where(ok, size + 1, 0)
    ids = np.append(p.ids(), np.zeros(ORDER, np.int64))
    pairs = np.zeros(n + ORDER, np.int64)
    linked = np.flatnonzero(link[:n])
    pairs[linked] = np.unique(ids[linked] << 32 | ids[linked + 1], return_inverse=True)[1]
    ends = p.starts + p.size
    for k in range(1, ORDER + 1):
        at = np.flatnonzero(size == k)
        if not len(at):
            continue
        key = {1: lambda: ids[at], 2: lambda: pairs[at], 3: lambda: pairs[at] << 32 | ids[at + 2], 4: lambda: pairs[at] << 32 | pairs[at + 2]}[k]()
        _, first, seen = np.unique(key, return_index=True, return_counts=True)
        at = at[first]
        data, offsets = _gather(p.line, p.starts[at], ends[at + k - 1] - p.starts[at])
        grams = pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(offsets), pa.py_buffer(data)).cast(pa.string())
        yield pa.record_batch([p.names.take(pa.array(p.lang[at])), pa.array(np.full(len(at), k, np.int32)), grams, pa.array(seen.astype(np.int64))], names=names)


def graph(source: DataFrame, support: int = SUPPORT, bits: int = FILTER_BITS) -> DataFrame:
    """(lang, size, gram, n): edges (size 4), ends of pieces (sizes 1 to 3) and, as size 0, all words. `source`: text, lang, no null lang."""
    shared = source.sparkSession.sparkContext.broadcast(frequent_bits(source, support, bits))
    found = source.mapInArrow(_grams(shared, bits), "lang string, size int, gram string, n long")
    return store.kept(found.groupBy("lang", "size", "gram").agg(F.sum("n").alias("n")), "grams")[0]


def _first(gram: str, k: int) -> Column:
    return F.substring_index(F.col(gram), " ", k)


def compacted(edges: DataFrame) -> DataFrame:
    """Unary paths: (lang, path, n), words one blank apart, n the weight of all its edges. `edges`: lang, gram, n.

    Every edge lies in one path. Places in a path come from pointers that double their reach; edges
    on a circle stay single. A path is cut after `STRETCH` edges, its parts overlap by a node.
    """
    end = F.struct("gram", "n")
    into = edges.groupBy("lang", _first("gram", 1 - ORDER).alias("node")).agg(F.count("*").alias("ins"), F.min(end).alias("a"))
    out = edges.groupBy("lang", _first("gram", ORDER - 1).alias("node")).agg(F.count("*").alias("outs"), F.min(end).alias("b"))
    unary = into.where("ins = 1").join(out.where("outs = 1"), ["lang", "node"]).where("a.n = b.n and a.gram <> b.gram")
    links, links_path = store.kept(unary.select("lang", F.col("a.gram").alias("a"), F.col("b.gram").alias("b")), "links")
    heads = links.select("lang", F.col("a").alias("gram")).join(links.select("lang", F.col("b").alias("gram")), ["lang", "gram"], "left_anti")
    state, path = store.kept(links.select("lang", F.col("b").alias("gram"), F.col("a").alias("at"), F.lit(1).cast("long").alias("place"), F.lit(False).alias("done"))
                             .unionByName(heads.withColumns({"at": F.col("gram"), "place": F.lit(0).cast("long"), "done": F.lit(True)})), "places")
    open_before, still_open = None, state.where("not done").count()
    while still_open and still_open != open_before:
        back = state.select("lang", F.col("gram").alias("at"), F.col("at").alias("at2"), F.col("place").alias("place2"), F.col("done").alias("done2"))
        moved = state.where("not done").join(back, ["lang", "at"]).select("lang", "gram", F.col("at2").alias("at"), (F.col("place") + F.col("place2")).alias("place"), F.col("done2").alias("done"))
        old = path
        state, path = store.kept(state.where("done").unionByName(moved), "places")
        store.drop(edges.sparkSession, old)
        open_before, still_open = still_open, state.where("not done").count()
    placed = edges.join(state.where("done").select("lang", "gram", "at", "place"), ["lang", "gram"], "left")
    placed = placed.withColumns({"at": F.coalesce("at", "gram"), "place": F.coalesce("place", F.lit(0).cast("long"))})
    parts = placed.groupBy("lang", "at", F.floor(F.col("place") / STRETCH).alias("part")).agg(
        F.min("n").alias("n"), F.sort_array(F.collect_list(F.struct("place", "gram"))).alias("run"))
    line = F.concat_ws(" ", F.get("run", F.lit(0))["gram"], F.transform(F.slice("run", 2, STRETCH), lambda e: F.substring_index(e["gram"], " ", -1)))
    found, _ = store.kept(parts.select("lang", line.alias("path"), "n"), "paths")
    store.drop(edges.sparkSession, path, links_path)
    return found


def _edges_of(paths: DataFrame) -> DataFrame:
    words = F.split("path", " ")
    each = F.transform(F.sequence(F.lit(1), F.size(words) - (ORDER - 1)), lambda i: F.array_join(F.slice(words, i, F.lit(ORDER)), " "))
    return paths.select("lang", F.explode(each).alias("gram"), "n")


def phrase_counts(grams: DataFrame, support: int = SUPPORT) -> DataFrame:
    """(lang, size, gram, n) of all phrases of 1 to 4 words with `support` occurrences, from a graph.

    Phrases below the support cannot matter; they are ends of their node, like the ends of pieces.
    """
    spark = grams.sparkSession
    edges = grams.where((F.col("size") == ORDER) & (F.col("n") >= support)).select("lang", "gram", "n")
    level = _edges_of(compacted(edges))
    below = grams.where((F.col("size") == ORDER) & (F.col("n") < support)).select("lang", "gram", "n")
    found, paths = level.withColumn("size", F.lit(ORDER)), []
    for k in range(ORDER - 1, 0, -1):
        flow = level.unionByName(below).select("lang", _first("gram", k).alias("gram"), "n")
        ends = grams.where(F.col("size") == k).select("lang", "gram", "n")
        whole, path = store.kept(flow.unionByName(ends).groupBy("lang", "gram").agg(F.sum("n").alias("n")), f"flow{k}")
        paths.append(path)
        level, below = whole.where(F.col("n") >= support), whole.where(F.col("n") < support)
        found = found.unionByName(level.withColumn("size", F.lit(k)))
    counts, _ = store.kept(found.select("lang", "size", "gram", "n"), "phrases")
    store.drop(spark, *paths)
    return counts


def _scored(counts: DataFrame) -> DataFrame:
    """(lang, phrase, size, a, l, r, score): phrases of two words or more at their lowest-scoring cut."""
    words = F.split("gram", " ")
    cut = counts.where("size > 1").select("lang", F.col("gram").alias("phrase"), "size", F.col("n").alias("a"), F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"), words.alias("w"))
    cut = cut.select("lang", "phrase", "size", "a", "k", F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("left"),
                     F.array_join(F.slice("w", F.col("k") + 1, F.col("size")), " ").alias("right"))
    part = counts.select("lang", F.col("gram").alias("part"), "n")
    cut = cut.join(part.select("lang", F.col("part").alias("left"), F.col("n").alias("l")), ["lang", "left"])
    cut = cut.join(part.select("lang", F.col("part").alias("right"), F.col("n").alias("r")), ["lang", "right"])
    score = F.expr(f"(cast({SCALE} as decimal(10, 0)) * cast(a as decimal(19, 0))) div cast(l + r as decimal(19, 0))")
    best = cut.withColumn("score", score).groupBy("lang", "phrase", "size", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("b"))
    return best.select("lang", "phrase", "size", "a", "b.l", "b.r", "b.score")


def _inside_longer(counts: DataFrame) -> DataFrame:
    """(lang, phrase, longer): the largest count of a longer phrase that holds the phrase."""
    w = F.split("gram", " ")
    spans = F.flatten(F.transform(F.sequence(F.lit(2), F.col("size") - 1), lambda k: F.transform(
        F.sequence(F.lit(1), F.col("size") - k + 1), lambda i: F.array_join(F.slice(w, i, k), " "))))
    return counts.where("size > 2").select("lang", "n", F.explode(spans).alias("phrase")).groupBy("lang", "phrase").agg(F.max("n").alias("longer"))


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", support: int = SUPPORT, top: int = TOP, bits: int = FILTER_BITS) -> DataFrame:
    """Each language's `top` phrases of 2 to 4 words: lang, rank, phrase, a, l, r, n, score.

    a, l, r are the occurrences of the phrase and of the two parts of its lowest-scoring cut, n all
    words of the language, score floor(2000000 a / (l + r)). Phrases inside a longer one with four fifths of their
    occurrences are left out. Letters A-Z are lowered. A null text is empty, a null language is `und`;
    repeated rows count as often as they stand, ids are not read; ties go by a, then by the bytes of the phrase. Empty in, empty out.
    """
    source = docs.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"))
    grams = graph(source, support, bits)
    counts = phrase_counts(grams, support)
    longer = _inside_longer(counts)
    left = _scored(counts).join(longer, ["lang", "phrase"], "left").where("longer is null or 5 * longer < 4 * a")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salted = left.withColumn("salt", F.pmod(F.hash("phrase"), F.lit(SALTS)))
    nearly = salted.withColumn("nth", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("nth") <= top)
    ranked = nearly.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    words = grams.where("size = 0").select("lang", "n")
    return ranked.join(words, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
