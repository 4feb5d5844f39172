"""Near duplicates by SimHash, joined on a segment-popcount embedding.

A 64-bit fingerprint is cut into 32 segments of two bits; the vector of their bit counts embeds it
so that Manhattan distance never exceeds Hamming distance. Written in unary, the counts fit 64 bits
again and the Manhattan distance of two vectors is the bit count of their exclusive or. The grid:
the 32 coordinates form six groups, a cell fixes the counts of three groups, and since a radius of
three cannot touch more than three groups, two vectors in range share at least one of the twenty
cells that each lies in. Inside a cell pairs pass the Manhattan bound first, then the exact distance.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dyad.llm import components, store, text

SHINGLE = 3
RADIUS = 3
GROUPS = (5, 5, 5, 5, 6, 6)
_LOW = 0x5555555555555555


def fingerprint(value: str | None, shingle: int = SHINGLE) -> int:
    """Majority bits of the XXH64 (seed 42) of all shingles, as an unsigned integer; zero without words."""
    words = (value or "").encode().lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) < shingle:
        hashes = [xxhash.xxh64_intdigest(line, 42)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        hashes = [xxhash.xxh64_intdigest(line[a:b], 42) for a, b in zip(starts[:len(words) - shingle + 1].tolist(), ends[shingle - 1:].tolist())]
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 4096):
        part = np.array(hashes[i:i + 4096], "<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little")


def _prints(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text.slices(batch):
                found = np.array([fingerprint(t, shingle) for t in part.column("text").to_pylist()], np.uint64)
                yield pa.record_batch([part.column("doc_id"), pa.array(text.signed(found))], names=["doc_id", "print"])
    return run


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def unary(bits: Column) -> Column:
    """Bit counts of the two-bit segments, each written as 00, 01 or 11."""
    low = F.lit(_LOW)
    odd, even = F.shiftrightunsigned(bits, 1).bitwiseAND(low), bits.bitwiseAND(low)
    return F.shiftleft(odd.bitwiseAND(even), 1).bitwiseOR(odd.bitwiseOR(even))


def cells(groups: tuple[int, ...] = GROUPS, radius: int = RADIUS) -> list[int]:
    """Masks over the unary vector: all choices of len(groups) - radius groups."""
    masks, at = [], 0
    for n in groups:
        masks.append(((1 << 2 * n) - 1) << 2 * at)
        at += n
    return [_signed(sum(c)) for c in itertools.combinations(masks, len(groups) - radius)]


def links(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(u, v): the ids of distinct fingerprints that differ in at most `radius` (1 to 3) bits.

    `prints` has one row per fingerprint: u (long) and print (long). Equal fingerprints must have been
    joined before, so a group of copies is one point here.
    """
    if not 0 < radius <= len(GROUPS) - 3:
        raise ValueError("the grid serves a radius of 1 to 3")
    masks = F.array(*map(F.lit, cells()))
    points = prints.select("u", "print", unary(F.col("print")).alias("unary")).select("u", "print", "unary", F.posexplode(masks).alias("cell", "mask")).select(
        "u", "print", "unary", "cell", F.col("unary").bitwiseAND(F.col("mask")).alias("counts"))
    a, b = points.alias("a"), points.alias("b")
    near = lambda c: F.bit_count(F.col(f"a.{c}").bitwiseXOR(F.col(f"b.{c}"))) <= radius
    same = (F.col("a.cell") == F.col("b.cell")) & (F.col("a.counts") == F.col("b.counts"))
    return a.join(b, same & (F.col("a.u") < F.col("b.u")) & near("unary") & near("print")).select(F.col("a.u").alias("u"), F.col("b.u").alias("v")).distinct()


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """One row per row of `docs`: doc_id, fingerprint (16 hex digits), component_id.

    component_id is the smallest id that links reach. Null, empty and wordless texts have fingerprint
    zero and are linked like any other. `docs` must have one row per id; a row without id is not linked
    and has no component. Empty in, empty out.
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    prints, _ = store.kept(source.mapInArrow(_prints(shingle), "doc_id long, print long"), "prints")
    points, _ = store.kept(prints.where("doc_id is not null").groupBy("print").agg(F.min("doc_id").alias("u")), "points")
    found = components.roots(links(points, radius))
    named = points.join(found, "u", "left").select("print", F.coalesce("root", "u").alias("component_id"))
    return prints.join(named, "print", "left").select("doc_id", F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"),
                                                      F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))
