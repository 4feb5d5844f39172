"""Near-duplicate lines by an exact set-similarity join, in DataFrame operations alone.

A line is the set of its five-word shingles (a shorter line is one shingle), told by their hashes. Lines with equal sets are one
class, of which the first line stands for all. First lines that reach Jaccard similarity 0.8 must share a shingle in their
prefixes, the smallest hashes; pairs that do pass the length and positional filters, and what is left is verified on the whole
sets. A line goes if an earlier line, in a smaller id or further up, is similar. Most are similar to the first line of a prefix
shingle, so each line is held against these first: at most as many pairs as prefixes have shingles. Lines of a shingle that few
have meet one another as well.

What is left are pairs of lines of a shingle that many have. These lines, a small part, are ordered anew: by the number of these lines that hold a shingle, rarest first. Lines of one family then differ in
their first shingles, those of their edits, and the positional filter rules out a pair that shares only what the whole family
has. A family of similar lines costs as many pairs as it has lines.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dyad.llm import rows, store

SHINGLE = 5
SMALLEST = 4  # shingles: below, only equal sets are similar
FEW = 8  # lines of a shingle that meet one another
_SOLID = "[^\x20\x09-\x0d]"
_ODD_SPACE = ("\x09", "\x0b", "\x0c", "\x0d", "  ")


def words_of(line: Column) -> Column:
    """Words of a line; the costlier split only where there is other white space than single blanks between words."""
    odd = reduce(Column.__or__, (line.contains(x) for x in _ODD_SPACE), line.startswith(" ") | line.endswith(" "))
    return F.when(odd, F.array_remove(F.split(line, "[\x20\x09-\x0d]"), "")).otherwise(F.split(line, " "))


def _lines(docs: DataFrame) -> DataFrame:
    """doc_id, line (from 0), and the words of every line that has any."""
    each = docs.select("doc_id", F.posexplode_outer(F.split("text", "\n")).alias("line", "content"))
    return each.where(F.col("content").rlike(_SOLID)).select("doc_id", "line", words_of(F.col("content")).alias("words"))


def _shingles(lines: DataFrame) -> DataFrame:
    """The distinct shingle hashes of every line, sorted, as `set`, never empty. Each word is hashed once, shingles from these."""
    hashed = lines.withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w))).drop("words")
    return hashed.withColumn("set", F.array_distinct(F.sort_array(F.transform(_starts(), _hash)))).drop("hashes")


def _starts() -> Column:
    return F.sequence(F.lit(0), F.greatest(F.size("hashes") - SHINGLE, F.lit(0)))


def _hash(start: Column) -> Column:
    return F.xxhash64(*(F.get("hashes", start + j) for j in range(SHINGLE)))


def _needed(n: Column) -> Column:
    return F.floor((4 * n + 4) / 5).cast("int")  # the least overlap with a set of equal size: four fifths, rounded up


def similar_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, line) of every line that has an earlier similar one. `docs` has doc_id and text, no nulls, one row per id.

    Candidates are verified on the texts again.
    """
    spark = docs.sparkSession
    sets = _shingles(_lines(docs))
    n = F.size("set")
    brief = sets.select("doc_id", "line", n.alias("n"), F.xxhash64("set").alias("s1"), F.xxhash64(F.lit(1), "set").alias("s2"),
                        F.when(n >= SMALLEST, F.slice("set", 1, n - _needed(n) + 1)).alias("prefix"))
    nth = F.row_number().over(Window.partitionBy("s1", "s2").orderBy("doc_id", "line"))
    ranked = brief.withColumn("nth", nth).select("doc_id", "line", "n", (F.col("nth") > 1).alias("again"), F.when(F.col("nth") == 1, F.col("prefix")).alias("prefix"))
    ranked, path = store.kept(ranked, "lines")
    posts = ranked.where("prefix is not null").select("doc_id", "line", "n", F.posexplode_outer("prefix").alias("at", "token"))
    end = F.struct("doc_id", "line", "n", "at")
    left = F.col("n") - F.col("at")
    first = posts.groupBy("token").agg(F.count("*").alias("many"), F.min(end).alias("a"), F.min("n").alias("least"), F.max(left).alias("longest")).where("many > 1")
    posts, posts_path = store.kept(posts.join(first, "token").select("token", "a", end.alias("b"), "many", "least", "longest"), "posts")
    again, _ = store.kept(ranked.where("again").select("doc_id", "line"), "again")
    store.drop(spark, path)

    size, rest = F.col("b.n"), F.col("b.n") - F.col("b.at")
    partner = F.greatest(F.col("least"), _needed(size))  # no similar line of the shingle is smaller
    others = posts.where((F.col("many") > 2) & (9 * F.least(rest, "longest") >= 4 * (size + partner)))
    few = others.where(F.col("many") <= FEW).groupBy("token").agg(F.collect_list("b").alias("all")).where(F.size("all") > 1)
    few = few.select("all", F.explode("all").alias("a")).select("a", F.explode("all").alias("b"))
    close, close_path = store.kept(posts.select("a", "b").unionByName(few).where(_may_be_similar()).select(_key("a"), _key("b")).distinct(), "pairs")
    crowd, crowd_path = store.kept(others.where((F.col("many") > FEW) & (_key("a") != _key("b"))).select(_key("b").alias("e")).distinct(), "crowd")
    store.drop(spark, posts_path)
    wanted = close.select(F.explode(F.array("a", "b")).alias("e")).unionByName(crowd)
    found, found_path = store.kept(_sets_of(docs, wanted), "sets")
    later, _ = store.kept(_similar(close, found), "later")
    store.drop(spark, close_path)

    own = found.join(crowd, F.struct("doc_id", "line") == F.col("e"), "left_semi")
    rest, rest_path = store.kept(_family_pairs(own, later), "pairs")
    more, _ = store.kept(_similar(rest, found), "later")
    store.drop(spark, rest_path, crowd_path, found_path)
    return again.unionByName(later).unionByName(more)


def _key(side: str) -> Column:
    return F.struct(F.col(f"{side}.doc_id").alias("doc_id"), F.col(f"{side}.line").alias("line")).alias(side)


def _may_be_similar() -> Column:
    """Whether a is earlier than b and the length and positional filters let the pair through."""
    a, b = (lambda c: F.col(f"a.{c}")), (lambda c: F.col(f"b.{c}"))
    earlier = (a("doc_id") < b("doc_id")) | ((a("doc_id") == b("doc_id")) & (a("line") < b("line")))
    length = 5 * F.least(a("n"), b("n")) >= 4 * F.greatest(a("n"), b("n"))
    return earlier & length & (9 * F.least(a("n") - a("at"), b("n") - b("at")) >= 4 * (a("n") + b("n")))


def _sets_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """doc_id, line and set of the lines `e`.

    The lines asked for are written out first: while they are few, texts stay where they are.
    """
    by_doc, _ = store.kept(wanted.select("e.*").groupBy("doc_id").agg(F.collect_set("line").alias("wanted")), "wanted")
    each = docs.join(by_doc, "doc_id").select("doc_id", F.split("text", "\n").alias("all"), F.explode("wanted").alias("line"))
    return _shingles(each.select("doc_id", "line", words_of(F.get("all", F.col("line"))).alias("words")))


def _family_pairs(sets: DataFrame, gone: DataFrame) -> DataFrame:
    """Pairs (a, b) that may be similar, b not in `gone`, by prefixes in the order of the exact counts of shingles in `sets`.

    A shingle of one line alone comes before all others: it takes a place and is in no pair.
    """
    tokens = sets.select("doc_id", "line", F.size("set").alias("n"), F.explode_outer("set").alias("token"))
    shared = tokens.join(tokens.groupBy("token").agg(F.count("*").alias("many")).where("many > 1"), "token")
    of_line = Window.partitionBy("doc_id", "line")
    at = F.col("n") - F.count("*").over(of_line) + F.row_number().over(of_line.orderBy("many", "token")) - 1
    ordered = shared.withColumn("at", at.cast("int")).where(F.col("at") <= F.col("n") - _needed(F.col("n")))
    posts, _ = store.kept(ordered.select("token", F.struct("doc_id", "line", "n", "at").alias("b")), "posts")
    still = posts.join(gone.select(F.struct("doc_id", "line").alias("gone")), (F.col("b.doc_id") == F.col("gone.doc_id")) & (F.col("b.line") == F.col("gone.line")), "left_anti")
    return posts.select("token", F.col("b").alias("a")).join(still, "token").where(_may_be_similar()).select(_key("a"), _key("b")).distinct()


def _similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(doc_id, line) of the later line of each pair that is similar on the whole sets."""
    left, right = (sets.select(F.struct("doc_id", "line").alias(side), F.col("set").alias(f"{side}_set")) for side in "ab")
    both = pairs.join(left, "a").join(right, "b")
    shared = F.size(F.array_intersect("a_set", "b_set"))
    return both.where(9 * shared >= 4 * (F.size("a_set") + F.size("b_set"))).select("b.doc_id", "b.line").distinct()


def _as(docs: DataFrame, column: str, name: str, kind: str) -> Column:
    """The column under that name and type, untouched if it has them: an alias would keep Spark from reusing an exchange."""
    return F.col(column) if column == name and dict(docs.dtypes)[column] == kind else F.col(column).cast(kind).alias(name)


def without_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: doc_id, text without the lines that have an earlier similar one, n_lines,
    n_removed, and the other columns, if any, as they are in the struct `rest`.

    Lines end at a line feed and are judged on the input. Lines without words stay. A null text has
    no lines and stays null; a text that loses all its lines is empty. Rows without an id are left as
    they are. Rows with the same id are documents of their own, ordered by the hash of their texts; of
    equal rows one is first. Empty in, empty out.
    """
    others = [c for c in docs.columns if c not in (id_col, text_col)]
    if not rows.repeated(docs, id_col):
        return _without_similar(docs, id_col, text_col)
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *([F.struct(*map(F.col, others)).alias("rest")] if others else []))
    left = _without_similar(rows.numbered(own, "doc_id", "text"), "row", "text")
    return left.select("rest.doc_id", "text", *(["rest.rest"] if others else []), "n_lines", "n_removed")


def _without_similar(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    others = [F.col(c) for c in docs.columns if c not in (id_col, text_col)]
    own = docs.select(_as(docs, id_col, "doc_id", "bigint"), _as(docs, text_col, "text", "string"), *([F.struct(*others).alias("rest")] if others else []))
    texts = own.select("doc_id", "text")
    whole = "doc_id is not null and text is not null"
    usable = texts.where(whole)
    gone = similar_lines(usable).groupBy("doc_id").agg(F.collect_set("line").alias("gone"))
    if others:  # joined to the decisions first, so that both joins of the texts read one exchange
        cut = usable.join(own.where(whole).select("doc_id", "rest").join(gone.hint("merge"), "doc_id", "left").hint("merge"), "doc_id")
    else:
        cut = usable.join(gone.hint("merge"), "doc_id", "left")
    cut = cut.withColumn("gone", F.coalesce("gone", F.array().cast("array<int>")))
    lines = F.split("text", "\n")
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("gone"))
    kept = F.when(F.size("gone") == 0, F.col("text")).otherwise(F.array_join(F.transform(left, lambda i: F.get("lines", i)), "\n"))
    cut = cut.withColumn("lines", lines).withColumns({"text": kept, "n_lines": F.size("lines").cast("long"), "n_removed": F.size("gone").cast("long")})
    none = F.lit(0).cast("long")
    rest = own.where(f"not ({whole})").withColumns({"n_lines": F.when(F.col("text").isNull(), none).otherwise(F.size(lines).cast("long")), "n_removed": none})
    return cut.drop("gone", "lines").unionByName(rest)
