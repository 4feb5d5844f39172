"""Token counts for every context limit from one exact histogram of encoded lengths."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dyad.llm import store, text, tokens

SPAN = 1024


def _counted(ranks_path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = tokens.encoder(ranks_path)
        for batch in batches:
            for part in text.slices(batch, most=8 << 20):
                sizes = [len(enc(t.as_py() or "")) for t in part.column("text")]
                yield pa.record_batch([pa.array(sizes, pa.int64())], names=["length"])
    return run


def histogram(docs: DataFrame, text_col: str = "text", ranks_path: str | None = None) -> DataFrame:
    """(length, n_docs): how many rows have that many token ids; null and empty texts have none."""
    source = docs.select(F.col(text_col).cast("string").alias("text"))
    counted = source.mapInArrow(_counted(ranks_path or tokens.default_ranks()), "length long")
    return counted.groupBy("length").agg(F.count("*").alias("n_docs"))


def suffix_sums(hist: DataFrame) -> DataFrame:
    """One row per length that occurs, with what every context limit of that length asks for.

    n_docs, n_tokens: documents and tokens of just this length. docs_over, tokens_over: of longer
    documents. kept_truncated: tokens left if documents are cut to this length. kept_dropped: tokens
    left if longer documents go. share_within: the part of documents that fit, so a quantile q is the
    smallest length with share_within >= q. Limits between two lengths: answer by `at_limits`.

    Sums run in spans of lengths: rows are ordered inside a span and only spans, of which a text of
    bounded size can give a bounded number, are ordered as a whole. Empty in, empty out.
    """
    rows = hist.where("length is not null").withColumn("span", F.floor(F.col("length") / SPAN).cast("long")).withColumn(
        "n_tokens", F.col("length") * F.col("n_docs"))
    spans = rows.groupBy("span").agg(F.sum("n_docs").alias("d"), F.sum("n_tokens").alias("t"))
    after = Window.orderBy(F.col("span").desc()).rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.select("span", F.coalesce(F.sum("d").over(after), F.lit(0)).alias("d_after"), F.coalesce(F.sum("t").over(after), F.lit(0)).alias("t_after"),
                         F.sum("d").over(Window.partitionBy()).alias("d_all"), F.sum("t").over(Window.partitionBy()).alias("t_all"))
    inside = Window.partitionBy("span").orderBy(F.col("length").desc()).rowsBetween(Window.unboundedPreceding, -1)
    over = lambda c, base: F.coalesce(F.sum(c).over(inside), F.lit(0)) + F.col(base)
    out = rows.join(spans, "span").select("length", "n_docs", "n_tokens", over("n_docs", "d_after").alias("docs_over"),
                                          over("n_tokens", "t_after").alias("tokens_over"), "d_all", "t_all")
    return out.select("length", "n_docs", "n_tokens", "docs_over", "tokens_over",
                      (F.col("t_all") - F.col("tokens_over") + F.col("length") * F.col("docs_over")).alias("kept_truncated"),
                      (F.col("t_all") - F.col("tokens_over")).alias("kept_dropped"),
                      ((F.col("d_all") - F.col("docs_over")) / F.col("d_all")).alias("share_within"))


def at_limits(sums: DataFrame, limits: list[int]) -> DataFrame:
    """Totals for the given context limits: limit, docs_over, kept_truncated, kept_dropped."""
    wanted = sums.sparkSession.createDataFrame([(x,) for x in limits], "limit long")
    per = sums.join(wanted, F.col("length") <= F.col("limit"), "right").groupBy("limit").agg(
        F.max_by(F.struct("length", "docs_over", "kept_truncated", "kept_dropped"), "length").alias("m"))
    whole = sums.agg(F.sum("n_docs").alias("d"))
    return per.join(whole).select("limit", F.coalesce("m.docs_over", "d").alias("docs_over"),
                                  F.coalesce(F.col("m.kept_truncated") + (F.col("limit") - F.col("m.length")) * F.col("m.docs_over"),
                                             F.col("limit") * F.col("d"), F.lit(0)).alias("kept_truncated"),
                                  F.coalesce("m.kept_dropped", F.lit(0)).alias("kept_dropped"))


def length_table(docs: DataFrame, text_col: str = "text", ranks_path: str | None = None) -> DataFrame:
    """`suffix_sums` of the histogram of `docs`; the histogram is written once and read twice."""
    return suffix_sums(store.kept(histogram(docs, text_col, ranks_path), "lengths")[0])
