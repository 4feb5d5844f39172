"""Operators against brute force on small tables with nulls, empty, long and repeated texts and clashing columns."""

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter

import pytest
import xxhash

from dyad.llm import containment, exact, lengths, likelihood, lines, near, packing, pii, quality, simhash, substrings, tokens

SPACE = re.compile("[\x20\x09-\x0d]+")


def words(t):
    return [w for w in SPACE.split(t or "") if w]


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def table(spark, texts, extra="name string, seen long, rest string, id long, n int"):
    rows = [(i, t, f"x{i}", None, "r", 5, 7) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, f"doc_id long, text string, {extra}").repartition(3)


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(11)
    out = [None, "", " ", "\n\t\n", "One", "one", "two words", "two  words", "two\twords ", "é ü ß 中文 𝒳 x", "A" * 9000, "a b " * 3000]
    vocabulary = [f"w{i}" for i in range(300)]
    for _ in range(70):
        t = [rnd.choice(vocabulary) for _ in range(rnd.choice([1, 3, 30, 80, 200]))]
        for i in range(0, len(t), 12):
            t[i] += "\n"
        out.append(" ".join(t))
    for _ in range(40):
        t = rnd.choice(out[12:82]).split(" ")
        t[rnd.randrange(len(t))] = "Changed"
        out.append(" ".join(t))
    return out + out[12:22] * 2 + [out[10]] * 4


@pytest.fixture(scope="module")
def docs(spark, texts):
    return table(spark, texts).cache()


@pytest.fixture(scope="module")
def none(spark):
    return table(spark, ["x"]).where("doc_id < 0")


def test_exact_duplicates(docs, texts):
    norm = [SPACE.sub(" ", t or "") for t in texts]
    first, size = {}, Counter(norm)
    for i, t in enumerate(norm):
        first.setdefault(t, i)
    for block in (4, 64, exact.BLOCK):
        got = {r["doc_id"]: tuple(r)[1:] for r in exact.duplicates(docs, block=block).collect()}
        assert got == {i: (first[t], size[t], first[t] == i, hashlib.sha256(t.encode()).hexdigest()) for i, t in enumerate(norm)}


def test_substrings(docs, texts):
    for size, seed in ((20, 8), (6, 3)):
        first, want = set(), {}
        for i, t in enumerate(texts):
            w = words(t)
            keep = [True] * len(w)
            for s in range(len(w) - size + 1):
                g = tuple(w[s:s + size])
                if g in first:
                    keep[s:s + size] = [False] * size
                first.add(g)
            want[i] = (len(w), keep.count(False), " ".join(x for x, k in zip(w, keep) if k))
        got = {r["doc_id"]: tuple(r)[1:] for r in substrings.without_repeats(docs, size=size, seed=seed).collect()}
        assert got == want
        spans = {r["doc_id"]: r["spans"] for r in substrings.repeats(docs, size=size, seed=seed).collect()}
        assert all(sum(s["end"] - s["start"] for s in spans.get(i, [])) == want[i][1] for i in want)
        assert all(a["end"] < b["start"] for s in spans.values() for a, b in zip(s, s[1:]))


def fingerprint(t):
    w = words(lower(t))
    grams = [" ".join(w[i:i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash(docs, texts):
    prints = [fingerprint(t) for t in texts]
    root = list(range(len(prints)))
    changed = True
    while changed:
        changed = False
        for i, a in enumerate(prints):
            for j in range(i):
                if (a ^ prints[j]).bit_count() <= 3 and root[i] != root[j]:
                    root[i] = root[j] = min(root[i], root[j])
                    changed = True
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.groups(docs).collect()}
    assert got == {i: (f"{p:016x}", root[i]) for i, p in enumerate(prints)}


def test_links_find_every_pair(spark):
    rnd = random.Random(2)
    points = {0, 1, 2**64 - 1, 2**63}
    for _ in range(12):
        base = rnd.getrandbits(64)
        for _ in range(40):
            x = base
            for _ in range(rnd.randint(0, 6)):
                x ^= 1 << rnd.randrange(64)
            points.add(x)
    points = list(points)
    df = spark.createDataFrame([(i, x - (1 << 64) if x >> 63 else x) for i, x in enumerate(points)], "u long, print long")
    for radius in (1, 3):
        got = {tuple(r) for r in simhash.links(df, radius).collect()}
        assert got == {(i, j) for j in range(len(points)) for i in range(j) if (points[i] ^ points[j]).bit_count() <= radius}


def test_containment(spark, docs, texts):
    rnd = random.Random(3)
    items = [(i, " ".join(words(rnd.choice(texts[12:82]))[:rnd.choice([4, 9, 25, 60])])) for i in range(30)]
    items += [(30, None), (31, ""), (32, items[0][1]), (33, "never seen words in this order at all"), (None, "w1 w2"), (34, "ONE")]

    def grams(t, k):
        w = words(lower(t))
        return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)}
    want = set()
    for key, t in items:
        k = min(5, len(words(t)))
        own = grams(t, k) if k else set()
        for i, d in enumerate(texts):
            shared = len(own & grams(d, k)) if own else 0
            if own and key is not None and 5 * shared >= 4 * len(own):
                want.add((i, key, len(own), shared))
    frame = spark.createDataFrame(items, "item_id long, text string")
    for size in (containment.BLOCK_BYTES, 500):
        assert {tuple(r) for r in containment.contained(docs, frame, block_bytes=size).collect()} == want
        clean = containment.clean(docs, frame, block_bytes=size)
        assert clean.columns == docs.columns
        assert {r["doc_id"] for r in clean.collect()} == set(range(len(texts))) - {w[0] for w in want}
    assert containment.contained(docs, frame.where("false")).count() == 0


def test_items_are_searched_whatever_their_ids(spark):
    own = spark.createDataFrame([(1, "x a b c d e f y"), (2, "g h i j k l"), (3, "none of it is in here")], "doc_id long, text string")
    items = spark.createDataFrame([(None, "a b c d e f"), ("item-7", "g h i j k l")], "item_id string, text string")
    assert [r["doc_id"] for r in containment.clean(own, items).collect()] == [3]
    with pytest.raises(ValueError):
        containment.contained(own, items)


def test_similar_lines(docs, texts):
    seen, want = [], {}
    for i, t in enumerate(texts):
        kept, gone = [], 0
        for line in t.split("\n") if t is not None else []:
            w = words(line)
            own = {tuple(w[j:j + 5]) for j in range(max(len(w) - 4, 1))} if w else set()
            if own and any(9 * len(own & o) >= 4 * (len(own) + len(o)) for o in seen):
                gone += 1
            else:
                kept.append(line)
            if own:
                seen.append(own)
        want[i] = (None if t is None else "\n".join(kept), 0 if t is None else len(t.split("\n")), gone)
    got = {r["doc_id"]: (r["text"], r["n_lines"], r["n_removed"]) for r in lines.without_similar(docs).collect()}
    assert got == want


def test_a_line_of_eight_words_meets_the_same_with_one_more(spark):
    eight = "a b c d e f g h"
    for nine in (f"{eight} i", f"z {eight}"):
        for first, second in ((eight, nine), (nine, eight)):
            own = spark.createDataFrame([(1, first), (2, f"other\n{second}")], "doc_id long, text string")
            got = {r["doc_id"]: (r["text"], r["n_removed"]) for r in lines.without_similar(own).collect()}
            assert got == {1: (first, 0), 2: ("other", 1)}


def test_lengths(docs, texts):
    encode = tokens.encoder(tokens.default_ranks())
    sizes = [len(encode(t or "")) for t in texts]
    got = lengths.length_table(docs)
    rows = {r["length"]: r for r in got.collect()}
    assert set(rows) == set(sizes)
    for n, r in rows.items():
        assert r["n_docs"] == sizes.count(n) and r["docs_over"] == sum(s > n for s in sizes)
        assert r["tokens_over"] == sum(s for s in sizes if s > n) and r["kept_truncated"] == sum(min(s, n) for s in sizes)
        assert r["kept_dropped"] == sum(s for s in sizes if s <= n) and r["share_within"] == sum(s <= n for s in sizes) / len(sizes)
    for r in lengths.at_limits(got, [0, 1, 17, 100, 5000, 10**6]).collect():
        assert r["kept_truncated"] == sum(min(s, r["limit"]) for s in sizes) and r["docs_over"] == sum(s > r["limit"] for s in sizes)


def test_token_ids_are_those_of_the_vocabulary(texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    encode = tokens.encoder(tokens.default_ranks())
    assert all(encode(x or "") == t.encode(x or "", add_special_tokens=False).ids for x in texts)


def test_packing(docs, texts):
    encode = tokens.encoder(tokens.default_ranks())
    for capacity in (1024, 50):
        rows = packing.pack(docs, capacity=capacity).collect()
        by_doc, by_sequence = {}, {}
        for r in rows:
            by_doc.setdefault(r["doc_id"], []).append(r)
            by_sequence.setdefault(r["sequence_id"], []).append(r)
        assert set(by_doc) == set(range(len(texts)))
        for i, own in by_doc.items():
            ids = [*encode(texts[i] or ""), 2]
            at = 0
            for k, r in enumerate(sorted(own, key=lambda r: r["piece"])):
                assert (r["piece"], r["start"]) == (k, at) and (k == 0 or r["length"] == capacity)
                part = b"".join(x.to_bytes(4, "little") for x in ids[at:at + r["length"]])
                assert zlib.crc32(part) == r["ids_crc32"]
                at += r["length"]
            assert at == len(ids)
        for own in by_sequence.values():
            at = 0
            for r in sorted(own, key=lambda r: r["offset"]):
                assert r["offset"] == at
                at += r["length"]
            assert at <= capacity
        assert len(by_sequence) <= 1 + 1.02 * sum(r["length"] for r in rows) / capacity


def test_rounds_are_best_fit():
    rnd = random.Random(4)
    for _ in range(20):
        counts = {n: rnd.randint(1, 9) for n in rnd.sample(range(1, 65), 20)}
        gaps, want = [], 0
        for n in sorted(counts, reverse=True):
            for _ in range(counts[n]):
                fit = min((g for g in gaps if g >= n), default=None)
                if fit is None:
                    want, fit = want + 1, 64
                else:
                    gaps.remove(fit)
                gaps.append(fit - n)
        runs = packing.rounds(counts, 64)
        assert max(r[3] + r[2] for r in runs) == want
        assert Counter({r[0]: 0 for r in runs}) + sum((Counter({r[0]: r[2]}) for r in runs), Counter()) == Counter(counts)


def test_placed_refuses_lengths_it_cannot_place(spark):
    with pytest.raises(ValueError):
        packing.placed(spark.createDataFrame([(1, 2000)], "k long, length long"), ["k"])


RULES = [re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
         re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")]


def by_rule(t):
    out = []
    for k, rule in enumerate(RULES):
        for m in rule.finditer(t):
            d = [int(c) for c in m[0] if c in "0123456789"]
            check = sum(x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(reversed(d))) % 10
            if k == 0 or k == 1 and all(int(x) <= 255 for x in m[0].split(".")) or k == 2 and 16 <= len(d) <= 19 and check == 0 or k == 3 and 8 <= len(d) <= 15:
                out.append((k, *m.span()))
    return out


def test_base_spans_follow_the_rules():
    rnd = random.Random(5)
    for letters in ("a@.b", "a@.-1é@ ", "12.3.45 ", "0123456789- ", "+0123456789() .-", "4 -0"):
        for _ in range(3000):
            t = "".join(rnd.choice(letters) for _ in range(rnd.randint(0, 40)))
            assert pii.base_spans(t) == by_rule(t)


def test_wording_finds_more(spark):
    rows = [f"xx é call me: +1 (555) 010-{i:04d} now" for i in range(8)] + ["xx call me: 555 010 7777 now", "page 555 010 8888 of it", None, "", "4111111111111111, 10.0.0.1 a@b.co"]
    got = {r["doc_id"]: r for r in pii.digest(pii.personal_data(table(spark, rows))).collect()}
    assert len(got) == len(rows)
    assert got[8]["n_added"] == 1 and got[8]["spans"] == "phone:12:24" and got[8]["n_phone"] == 0
    assert got[9]["n_added"] == 0 and got[10]["spans"] == "" and got[10]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    assert got[12]["spans"] == "email:27:33,ip:18:26,card:0:16"
    for i, t in enumerate(rows):
        line = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in by_rule(t or ""))
        assert got[i]["base_sha256"] == hashlib.sha256(line.encode()).hexdigest()


def test_wording_found_by_found_values_finds_more(spark):
    rows = [f"call me: +1 (555) 010-{i:04d} now" for i in range(20)]
    rows += [f"{lead} 555 020 {i:04d} now" for i in range(6) for lead in ("call me:", "or text")] + ["or text 555 030 0000 now", "page no 555 040 0000 now"]
    got = [r["spans"] for r in pii.digest(pii.personal_data(table(spark, rows))).orderBy("doc_id").collect()]
    assert got[20:] == ["phone:9:21", "phone:8:20"] * 6 + ["phone:8:20", ""]


def test_quality(spark, docs, texts):
    rnd = random.Random(6)
    rows = [" ".join(rnd.choice(["alpha", "beta", "gamma", "delta"]) + ("!!" if i % 3 == 0 else "") for _ in range(40)) for i in range(600)] + [None, ""]
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(600)] + [(5, None), (None, 1), (9999, 0)], "doc_id long, quality int")
    own = table(spark, rows)
    got = {r["doc_id"]: r for r in quality.scored(own, labels).collect()}
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got.values())
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert {i for i in range(602) if got[i]["held_out"]} == {i for i in range(602) if zlib.crc32(str(i).encode()) % 5 == 0}
    assert sum(got[i]["predicted"] == int(i % 3 > 0) for i in held) / len(held) > 0.98
    kept = quality.passing(own, labels)
    assert kept.columns == own.columns and {r["doc_id"] for r in kept.collect()} == {i for i, r in got.items() if r["predicted"]}
    lone = {r["score"] for r in quality.scored(own, labels.where("false")).collect()}
    assert lone == {0.5}


def test_lattice_sums_all_segmentations():
    pieces = {"▁": 0.1, "▁a": 0.2, "a": 0.1, "b": 0.05, "ab": 0.2, "▁ab": 0.05, "ba": 0.1}
    lattice = likelihood.Lattice({p: math.log(x) for p, x in pieces.items()}, {b: math.log(0.001) for b in range(256)})

    def brute(s):
        if not s:
            return 1.0
        got = sum(x * brute(s[len(p):]) for p, x in pieces.items() if s.startswith(p))
        return got + (0 if s[0] in pieces else 0.001 ** len(s[0].encode()) * brute(s[1:]))
    for w in ("a", "ab", "abab", "bba", "aéb", "z", "b" * 30):
        assert math.isclose(lattice.word(w), math.log(brute("▁" + w)), rel_tol=1e-9)


def test_likelihood(docs, texts):
    held = [zlib.crc32(str(i).encode()) % 10 == 0 for i in range(len(texts))]
    counts, ends = Counter(), 0
    for t, h in zip(texts, held):
        if not h:
            counts.update(words(lower(t)))
            ends += 1
    n, v = sum(counts.values()) + ends, len(counts) + 1
    log = lambda c: math.log10((c + 0.1) / (n + 0.1 * (v + 1)))
    runs = [{r["doc_id"]: r for r in likelihood.scored(docs, common=c).collect()} for c in (1, 50, likelihood.COMMON)]
    for got in runs:
        assert set(got) == set(range(len(texts)))
        for i, t in enumerate(texts):
            w, r = words(lower(t)), got[i]
            assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[i], len(w) + 1, sum(counts[x] > 0 for x in w) + 1, n)
            assert math.isclose(r["base_score"], sum(log(counts[x]) for x in w) + log(ends), rel_tol=1e-9)
            assert math.isclose(r["score"], runs[0][i]["score"], rel_tol=1e-9) and r["score"] < 0


def test_empty_tables(spark, none):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert exact.duplicates(none).count() == 0
    assert substrings.without_repeats(none).count() == 0
    assert simhash.groups(none).count() == 0
    assert lines.without_similar(none).count() == 0
    assert lengths.length_table(none).count() == 0
    assert packing.pack(none).count() == 0
    assert pii.digest(pii.personal_data(none)).count() == 0
    assert quality.scored(none, labels).count() == 0 and quality.passing(none, labels).count() == 0
    assert likelihood.scored(none).count() == 0
    assert containment.contained(none, none.select("doc_id", "text"), item_col="doc_id").count() == 0


def test_rows_without_an_id(spark):
    own = spark.createDataFrame([(None, "a b c"), (None, "a b c"), (1, None), (2, "a b c")], "doc_id long, text string")
    labels = spark.createDataFrame([(None, 1)], "doc_id long, quality int")
    assert substrings.without_repeats(own).count() == simhash.groups(own).count() == lines.without_similar(own).count() == 4
    assert pii.personal_data(own).count() == quality.scored(own, labels).count() == packing.pack(own).count() == 4
    assert likelihood.scored(own).where("doc_id is null").count() == 2 and likelihood.scored(own).count() == 4


def test_rows_with_the_same_id_are_told_apart(spark):
    passage = " ".join(f"w{i}" for i in range(25))
    own = spark.createDataFrame([(1, passage, "a"), (1, passage, "b"), (1, "short", "c"), (2, f"x {passage}", "d"), (None, passage, "e"), (None, passage, "f")],
                                "doc_id long, text string, row string").repartition(3)
    want = sorted([(1, 25, 0, passage), (1, 25, 25, ""), (1, 1, 0, "short"), (2, 26, 25, "x"), (None, 25, 0, passage), (None, 25, 0, passage)], key=str)
    assert sorted(map(tuple, substrings.without_repeats(own).collect()), key=str) == want
    assert sorted((r["doc_id"], *map(tuple, r["spans"])) for r in substrings.repeats(own).collect()) == [(1, (0, 25)), (2, (1, 26))]
    for df in (own, own.select("doc_id", "text")):
        left = lines.without_similar(df)
        got = sorted(((r["doc_id"], r["text"], r["n_lines"], r["n_removed"]) for r in left.collect()), key=str)
        assert got == sorted([(1, passage, 1, 0), (1, "", 1, 1), (1, "short", 1, 0), (2, "", 1, 1), (None, passage, 1, 0), (None, passage, 1, 0)], key=str)
        assert left.columns == (["doc_id", "text", "rest", "n_lines", "n_removed"] if "row" in df.columns else ["doc_id", "text", "n_lines", "n_removed"])
    assert {r[0] for r in lines.without_similar(own).select("rest.row").collect()} == set("abcdef")


def test_long_texts_without_an_id_or_with_the_same(spark):
    texts = ["a" * 5000, "b" * 5000, "a" * 5000, "c" * 5000]
    for key in (None, 7):
        own = spark.createDataFrame([(key, t) for t in texts], "doc_id long, text string").repartition(2)
        got = [tuple(r) for r in exact.duplicates(own).collect()]
        kept = None if key is None else True
        assert sorted(got, key=str) == sorted([(key, key, texts.count(t), kept, hashlib.sha256(t.encode()).hexdigest()) for t in texts], key=str)


def test_strings_of_added_tokens_are_one_id(spark):
    """Ids, lengths and checksums are those of the tokenizer itself, also where a text spells an added token."""
    import public_tokenizers
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    cases = ["<|endoftext|>", "a <|endoftext|> b", "<|endoftext|><|endoftext|>", "<|endoftext|", "x<|endoftext|>y  z", "plain text", ""]
    docs = table(spark, cases)
    got = {r["doc_id"]: r for r in packing.pieces(docs).collect()}
    for i, t in enumerate(cases):
        ids = own.encode(t, add_special_tokens=False).ids + [2]
        assert got[i]["length"] == len(ids)
        assert got[i]["ids_crc32"] == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids))
    assert {r["length"]: r["n_docs"] for r in lengths.histogram(docs).collect()} == Counter(len(own.encode(t, add_special_tokens=False).ids) for t in cases)


def test_documents_of_one_id_have_results_of_their_own(spark):
    """Personal data and likelihood of a row do not depend on the other rows of its id."""
    seeds = [(100 + i, f"reach me, call now: +49 30 1234{i:04d}") for i in range(12)]
    own = spark.createDataFrame([*seeds, (1, "reach me, call now: 030 555 7788 99"), (1, "no digit here"), (None, "no digit either")], "doc_id long, text string").repartition(3)
    found = pii.personal_data(own, support=3).collect()
    assert len(found) == 15
    assert sorted(len(r["added"]) for r in found if r["doc_id"] == 1) == [0, 1]
    scored = sorted((r["n_tokens"], r["score"]) for r in likelihood.scored(own.where("doc_id = 1")).collect())
    assert [n for n, _ in scored] == [4, 9]


def test_a_column_named_like_the_row_key_comes_back(spark):
    passage = " ".join(f"w{i}" for i in range(30))
    rows = [(1, passage, "A", 1), (1, "other words stand in this one", "C", 2), (2, passage, "B", 3)]
    left = near.first_of_groups(spark.createDataFrame(rows, "doc_id long, text string, row string, key int"))
    assert left.columns == ["doc_id", "text", "row", "key"]
    assert sorted((r["row"], r["key"]) for r in left.collect()) == [("A", 1), ("C", 2)]


def test_texts_longer_than_a_slice(spark):
    """A text of over a megabyte, twice, beside short ones."""
    rnd = random.Random(9)
    line = " ".join(rnd.choice([f"w{i}" for i in range(900)]) for _ in range(250_000))
    cases = [line, "short one", line, None, "mail a.b@c.de"]
    docs = table(spark, cases)
    assert sorted(r["group_size"] for r in exact.duplicates(docs).collect()) == [1, 1, 1, 2, 2]
    assert {r["doc_id"]: r["n_words"] - r["n_removed"] for r in substrings.without_repeats(docs).collect()}[2] == 0
    assert {r["doc_id"]: r["component_id"] for r in simhash.groups(docs).collect()}[2] == 0
    assert len({r["n_tokens"] for r in likelihood.scored(docs).where("doc_id in (0, 2)").collect()}) == 1
    assert packing.pack(docs).agg({"length": "sum"}).first()[0] == lengths.histogram(docs).selectExpr("sum(length * n_docs)").first()[0] + 5
    assert sum(r["n_email"] for r in pii.digest(pii.personal_data(docs)).collect()) == 1
    assert lines.without_similar(docs).where("n_removed = 1").count() == 1
    assert near.first_of_groups(docs).count() == 4


def test_a_family_of_similar_lines_is_not_paired(spark, monkeypatch):
    """Lines that are all similar to one another are verified against few others each, not in all pairs."""
    from dyad.llm import store

    rnd = random.Random(12)
    base = [f"w{i}" for i in range(150)]
    texts = []
    for i in range(150):
        own = list(base)
        own[rnd.randrange(150)] = f"x{i}"
        texts.append(" ".join(own))
    seen, real = [], store.kept

    def counted(df, name):
        out = real(df, name)
        if name == "pairs":
            seen.append(out[0].count())
        return out
    monkeypatch.setattr(store, "kept", counted)
    got = {r["doc_id"]: r["n_removed"] for r in lines.without_similar(table(spark, texts)).collect()}
    assert got == {i: int(i > 0) for i in range(150)}
    assert sum(seen) < 10 * 150


def test_a_family_of_lines_short_of_similar_is_not_paired(spark, monkeypatch):
    """Lines that share most of their shingles, but not enough of them to be similar, are not verified in all pairs."""
    from dyad.llm import store

    base = [f"w{i}" for i in range(120)]
    texts = []
    for i in range(120):  # three edits each, in places of their own
        own = list(base)
        for j in range(3):
            own[(i + 40 * j) % 120] = f"x{i}_{j}"
        texts.append(" ".join(own))
    texts += [" ".join([*texts[70].split(" "), "more"]), " ".join(base)]
    seen, real = [], store.kept

    def counted(df, name):
        out = real(df, name)
        if name == "pairs":
            seen.append(out[0].count())
        return out
    monkeypatch.setattr(store, "kept", counted)
    got = {r["doc_id"]: r["n_removed"] for r in lines.without_similar(table(spark, texts)).collect()}
    sets = [{tuple(w[j:j + 5]) for j in range(len(w) - 4)} for w in (t.split(" ") for t in texts)]
    want = {i: int(any(9 * len(x & y) >= 4 * (len(x) + len(y)) for y in sets[:i])) for i, x in enumerate(sets)}
    assert got == want and any(want.values())
    assert sum(seen) < 10 * len(texts)


def test_a_long_run_of_letters_or_digits_takes_linear_time():
    begin = time.monotonic()
    for t in ("1" * 100_000, "a" * 100_000 + " 1", "a@" * 50_000 + "1"):
        pii.places(t)
    assert time.monotonic() - begin < 10
    found, _ = pii.places("ask ann[at]host.org. or bob@host.org")
    assert found == [{"kind": 0, "start": 24, "end": 36}]


def test_counts_of_personal_data_are_by_kind(spark):
    text = "1.2.3.4 ann@host.org bob@host.org +1 555 010 9999 x 4111 1111 1111 1111 x 10.0.0.9"
    docs = spark.createDataFrame([(1, text), (2, "ann@host.org"), (3, None)], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]) for r in pii.digest(pii.personal_data(docs)).collect()}
    assert got == {1: (2, 2, 1, 1), 2: (1, 0, 0, 0), 3: (0, 0, 0, 0)}
