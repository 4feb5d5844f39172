"""Personal data: fixed rules first, then identifiers that only their wording gives away.

One pass over the texts finds the spans of the fixed rules (the seeds) and every other run of
characters that looks like an identifier, each with the words before it. The words before a run are
its lexical patterns. Patterns and values form a graph, scored in rounds by Spark: a pattern is worth
the mean score of the distinct values it introduces, a value the chance that at least one trusted
pattern is right about it, and seeds are certain. Patterns that stay above the bar name further spans.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dyad.llm import store, text as slicing

KINDS = ("email", "ip", "card", "phone")
SUPPORT = 3
TRUST = 0.8
ROUNDS = 3

_SIGN = re.compile("@")
_HOST = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_NUMBER = re.compile(r"[+(]?[0-9](?:[\x20().-]{0,2}[0-9])+")
_MARK = re.compile(r"@|\[at\]|\(at\)")
_AFTER = re.compile(r"[A-Za-z0-9.-]*[A-Za-z0-9]")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def luhn(digits: str) -> bool:
    odd = sum(int(d) for d in digits[-1::-2])
    return (odd + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def _around(text: str, mark: re.Pattern, host: re.Pattern) -> list[tuple[int, int]]:
    """As `[A-Za-z0-9._%+-]+`, `mark` and `host` in a row are found, in time linear in the text."""
    found, free = [], 0
    m = mark.search(text)
    while m:
        begin = m.start()
        while begin > free and (c := text[begin - 1]).isascii() and (c.isalnum() or c in "._%+-"):
            begin -= 1
        after = host.match(text, m.end()) if begin < m.start() else None
        free = after.end() if after else m.end()
        if after:
            found.append((begin, free))
        m = mark.search(text, free)
    return found


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the fixed rules in code points, by kind and start."""
    found = [(0, a, b) for a, b in _around(text, _SIGN, _HOST)] if "@" in text else []
    if _DIGIT.search(text):
        found += [(1, *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            digits = re.sub("[^0-9]", "", m[0])
            if 16 <= len(digits) <= 19 and luhn(digits):
                found.append((2, *m.span()))
        found += [(3, *m.span()) for m in _PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]
    return found


def _left(text: str, start: int) -> list[str]:
    """Patterns of a place: its two words before, and the last alone if it ends like a label."""
    words = [re.sub("[0-9]", "0", w.lower()) for w in _WORD.findall(text[max(0, start - 80):start])][-2:]
    return [" ".join(words)] * (len(words) == 2) + [w for w in words[-1:] if w[-1] in ":=#"]


def _fits(value: str) -> list[int]:
    """Kinds whose look a value has."""
    digits = sum(c.isdigit() for c in value)
    if "@" in value or "at" in value:
        return [0]
    dots = value.count(".")
    return [1] * (dots == 3 and digits >= 4) + [2] * (12 <= digits <= 19) + [3] * (7 <= digits <= 15)


def places(text: str) -> tuple[list[dict], list[dict]]:
    """Base spans, and (kind, start, end, value, seed, patterns) of seeds and of other runs that look alike."""
    base = base_spans(text)
    out = [{"kind": k, "start": a, "end": b, "value": text[a:b], "seed": True, "patterns": _left(text, a)} for k, a, b in base]
    if "@" in text or "at]" in text or "at)" in text or _DIGIT.search(text):
        covered = sorted((a, b) for _, a, b in base)
        i = 0
        for a, b in sorted([*_around(text, _MARK, _AFTER), *(m.span() for m in _NUMBER.finditer(text))], key=lambda s: s[0]):
            while i < len(covered) and covered[i][1] <= a:
                i += 1
            if any(x < b and y > a for x, y in covered[i:i + 4]) or (a and text[a - 1].isalnum()) or (b < len(text) and text[b].isalnum()):
                continue
            out += [{"kind": k, "start": a, "end": b, "value": text[a:b], "seed": False, "patterns": _left(text, a)} for k in _fits(text[a:b])]
    return [{"kind": k, "start": a, "end": b} for k, a, b in base], [x for x in out if x["seed"] or x["patterns"]]


_SPAN = [("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]
_PLACE = [*_SPAN, ("value", pa.string()), ("seed", pa.bool_()), ("patterns", pa.list_(pa.string()))]
_SPAN_SQL = "kind:int,start:int,end:int"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slicing.slices(batch, most=8 << 20):
            base, around = [], []
            for value in part.column("text"):
                b, p = places(value.as_py() or "")
                base.append(b)
                around.append(p)
            yield pa.record_batch([part.column("doc_id"), part.column("row"), pa.array(base, pa.list_(pa.struct(_SPAN))), pa.array(around, pa.list_(pa.struct(_PLACE)))],
                                  names=["doc_id", "row", "base", "around"])


def trusted_patterns(found: DataFrame, support: int = SUPPORT, trust: float = TRUST, rounds: int = ROUNDS) -> DataFrame:
    """(kind, pattern, worth) of the patterns to believe, from rows (kind, value, seed, pattern).

    A pattern needs `support` distinct values whose score reaches `trust`, seeds or found by other
    patterns. Scores only grow, so patterns are only added; the last ones added get `rounds` rounds too.
    """
    edges, _ = store.kept(found.groupBy("kind", "pattern", "value").agg(F.max(F.col("seed").cast("double")).alias("sure")), "edges")
    score = edges.withColumn("score", F.col("sure"))
    i, known, last = 0, 0, 0
    while True:
        patterns = score.groupBy("kind", "pattern").agg(F.count(F.when(F.col("score") >= trust, 1)).alias("sound"), (F.sum("score") / (F.count("*") + 1)).alias("worth"))
        patterns, _ = store.kept(patterns.where((F.col("sound") >= support) & (F.col("worth") >= trust / 2)), "patterns")
        now = patterns.count()
        if now > known:
            known, last = now, i
        if i - last >= rounds - 1:
            return patterns.where(F.col("worth") >= trust).select("kind", "pattern", "worth")
        values = edges.join(patterns, ["kind", "pattern"]).groupBy("kind", "value").agg(
            (1 - F.exp(F.sum(F.log(1 - F.least("worth", F.lit(0.999)))))).alias("chance"))
        score, _ = store.kept(edges.join(values, ["kind", "value"], "left").select(
            *edges.columns, F.greatest("sure", F.coalesce("chance", F.lit(0.0))).alias("score")), "scores")
        i += 1


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: int = SUPPORT,
                  trust: float = TRUST, rounds: int = ROUNDS) -> DataFrame:
    """One row per row of `docs`: doc_id, base and added arrays of (kind, start, end), code points, end exclusive.

    A null text is empty and has no spans. Spans that patterns add never overlap those of the fixed
    rules; where two kinds claim a place, the better pattern wins, then the earlier kind. Rows of one id and
    rows without an id are texts of their own. Empty in, empty out.
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.monotonically_increasing_id().alias("row"))
    seen, _ = store.kept(source.mapInArrow(_scan, f"doc_id long, row long, base array<struct<{_SPAN_SQL}>>, "
                                           f"around array<struct<{_SPAN_SQL},value:string,seed:boolean,patterns:array<string>>>"), "places")
    around = seen.where(F.size("around") > 0).select("row", F.explode("around").alias("p")).select("row", "p.*").withColumn(
        "pattern", F.explode("patterns")).drop("patterns")
    trusted = trusted_patterns(around.select("kind", "value", "seed", "pattern"), support, trust, rounds)
    best = around.where("not seed").join(trusted, ["kind", "pattern"]).groupBy("row", "start", "end").agg(
        F.max(F.struct("worth", (-F.col("kind")).alias("minus"))).alias("b"))
    added = best.groupBy("row").agg(F.sort_array(F.collect_list(F.struct((-F.col("b.minus")).alias("kind"), "start", "end"))).alias("added"))
    none = F.array().cast(f"array<struct<{_SPAN_SQL}>>")
    return seen.select("doc_id", "row", "base").join(added, "row", "left").select("doc_id", "base", F.coalesce("added", none).alias("added"))


def digest(found: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone of the fixed rules, base_sha256, spans (all), n_added."""
    kinds = F.array(*map(F.lit, KINDS))
    line = lambda spans: F.array_join(F.transform(F.sort_array(spans), lambda s: F.concat_ws(
        ":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
    of_kind = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")  # noqa: E731; a second argument would be the index
    count = [of_kind(k).alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return found.select("doc_id", *count, F.sha2(line(F.col("base")).cast("binary"), 256).alias("base_sha256"),
                        line(F.concat("base", "added")).alias("spans"), F.size("added").cast("long").alias("n_added"))
