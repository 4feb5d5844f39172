"""Collocations, scaled sketches and whitening against plain versions."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from dyad.llm import phrases, queries, sketches, whitening


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def plain_collocations(rows, support, top):
    f, n = defaultdict(Counter), Counter()
    for lang, t in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", lower(t)):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 5):
                f[lang].update(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, c in f.items():
        found = {p: a for p, a in c.items() if len(p) > 1 and a >= support}
        rank = []
        for p, a in found.items():
            if any(100 * b >= 80 * a for q, b in found.items() if len(q) > len(p) and any(q[i:i + len(p)] == p for i in range(len(q) - len(p) + 1))):
                continue
            score, k = min((2000000 * a // (c[p[:k]] + c[p[k:]]), k) for k in range(1, len(p)))
            rank.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        out += [(lang, i, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(rank)[:top], 1)]
    return sorted(out)


@pytest.fixture(scope="module")
def prose():
    rnd = random.Random(5)
    vocabulary = [f"w{i}" for i in range(12)] + ["É", "Ab", "<\x00>", "x" * 80]
    line = " ".join(rnd.choice(vocabulary) for _ in range(300))
    out = [(None, None), ("en", ""), ("en", " \t "), (None, "One"), ("de", None)]
    for i in range(160):
        w = [rnd.choice(vocabulary) + rnd.choice(["", "", "", ",", ".", "\n", "!?", "\t"]) for _ in range(rnd.choice([1, 4, 40]))]
        out.append((rnd.choice(["en", "de", "und", None]), " ".join(w)))
    out += [("en", line)] * 6 + [("de", "a b a b a b a b a b"), ("de", "q q q q q q q")] * 6
    return out


def test_collocations(spark, prose):
    docs = spark.createDataFrame([(i, lang, t, "g", 1, 2) for i, (lang, t) in enumerate(prose)], "doc_id long, lang string, text string, gram string, n int, size int").repartition(3)
    for support, top, bits in ((5, 40, 26), (3, 2000, 8)):
        got = sorted(tuple(r) for r in phrases.collocations(docs, support=support, top=top, bits=bits).collect())
        assert got == plain_collocations(prose, support, top)
    assert phrases.collocations(docs.where("doc_id < 0")).count() == 0
    assert phrases.collocations(docs.where("text is null")).count() == 0


def test_long_text_crosses_slices(spark):
    rnd = random.Random(1)
    t = " ".join(rnd.choice("abcdefgh") * rnd.randint(1, 3) for _ in range(400_000)) + ". end of it"
    docs = spark.createDataFrame([("en", t), ("en", t[:1000])], "lang string, text string")
    got = phrases.collocations(docs, support=2, top=50)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    first = got.where("size(split(phrase, ' ')) = 2").orderBy("rank").first()
    if first:
        w = t.split(". ")[0].split(" ")
        assert first["a"] == Counter(zip(w, w[1:]))[tuple(first["phrase"].split(" "))] + Counter(zip(t[:1000].split(" "), t[:1000].split(" ")[1:]))[tuple(first["phrase"].split(" "))]
    assert got.first()["n"] == len(t.split()) + len(t[:1000].split())


def test_paths(spark):
    """A passage is one path until others branch off; circles stay single edges; every edge is in one path."""
    long = [f"p{i}" for i in range(900)]
    lines = [" ".join(long)] * 3 + ["a b c d e f"] * 3 + ["x b c d y"] * 2 + ["r s t r s t r s t r s t r s t"] * 2 + ["o o o o o"]
    docs = spark.createDataFrame([("en", t) for t in lines], "lang string, text string")
    grams = phrases.graph(docs, support=1)
    edges = grams.where("size = 4").select("lang", "gram", "n")
    paths = phrases.compacted(edges)
    assert sorted(map(tuple, phrases._edges_of(paths).collect())) == sorted(map(tuple, edges.collect()))
    sizes = {r["path"].split(" ")[0]: len(r["path"].split(" ")) for r in paths.collect()}
    assert sizes["p0"] == 259 and sizes["a"] == 4 and sizes["x"] == 4 and sizes["o"] == 4
    assert {s for w, s in sizes.items() if w in "rst"} == {4}


def test_words_of_one_hash_stay_apart():
    part = pa.record_batch([pa.array(["one two one two", "one"]), pa.array(["en", "de"])], names=["text", "lang"])
    p = phrases.Pieces(part)
    p.hash[:] = 7
    assert len(set(p.ids().tolist())) == 3
    assert p.ids().tolist()[:2] == p.ids().tolist()[2:4]


@pytest.mark.parametrize("value", ["", "a", "short", "ab" * 50_000, "".join(random.Random(3).choices("abcdefghijé中𝒳 ", k=150_000))])
def test_sketch_keeps_all_hashes_below_the_fraction(value):
    whole = np.unique(np.concatenate([h for h in sketches.shingle_hashes(value)]))
    assert len(whole) == len({value[i:i + 16] for i in range(max(len(value) - 15, 1))} - {""})
    want = whole[:max(sketches.LEAST, int((whole < sketches.LIMIT).sum()))]
    assert (sketches.sketch(value) == want).all()


def test_merged_and_containment(spark):
    rnd = random.Random(4)
    texts = ["".join(rnd.choices("abcdefgh ", k=k)) for k in (0, 3, 30, 400, 5000, 60_000)]
    pairs = [(a, b) for a in texts for b in texts]
    pairs += [(texts[4], texts[5] + texts[4]), (texts[3], texts[3] + texts[2])]
    as_list = lambda t: sketches.sketch(t).astype(np.int64).tolist()
    df = spark.createDataFrame([(i, as_list(a), as_list(b)) for i, (a, b) in enumerate(pairs)], "i int, a array<long>, b array<long>")
    for r in df.select("i", sketches.merged(F.col("a"), F.col("b")).alias("m"), sketches.containment(F.col("a"), F.col("b")).alias("c"), sketches.containment(F.col("b"), F.col("a")).alias("d")).collect():
        a, b = pairs[r["i"]]
        both = np.unique(np.concatenate([*sketches.shingle_hashes(a), *sketches.shingle_hashes(b)]))
        assert r["m"] == both[:max(sketches.LEAST, int((both < sketches.LIMIT).sum()))].astype(np.int64).tolist()
        assert r["c"] == sketches.contained(sketches.sketch(a), sketches.sketch(b))
        assert 0 <= r["c"] <= 1 and r["c"] == r["d"] and (a != b or r["c"] == 1)
    last = df.where("i >= 36").orderBy("i").select(sketches.containment(F.col("a"), F.col("b"))).collect()
    assert last[0][0] > 0.9 and last[1][0] > 0.6


def test_edited_sketches(spark):
    rnd = random.Random(6)
    rows = [(i, "".join(rnd.choices("abc déf中𝒳\n", k=rnd.choice([1, 5, 50, 700])))) for i in range(60)]
    rows += [(60, None), (61, ""), (62, rows[3][1]), (63, "y" * 2_000_000), (70, "tail"), (None, "no id")]
    rnd.shuffle(rows)
    docs = spark.createDataFrame([(k, t, 1, "p", 0.5) for k, t in rows], "doc_id long, text string, part int, first string, h double").repartition(5)
    ordered = sorted([(k, t or "") for k, t in rows], key=lambda r: (r[0] is None, -(r[0] or 0)))
    want = {}
    for (k, t), (_, n) in zip(ordered, ordered[1:] + ordered[:1]):
        cut = len(t) // 3
        e = t[:len(t) - cut] + n[:cut]
        want[k] = (len(t), hashlib.sha256(e.encode()).hexdigest(), *(sketches.sketch(v).astype(np.int64).tolist() for v in (t, e)),
                   *(sketches.contained(sketches.sketch(t), sketches.sketch(v)) for v in (e, n)))
    got = {r[0]: tuple(r)[1:] for r in sketches.edited_sketches(docs).collect()}
    assert got == want
    one = sketches.edited_sketches(docs.where("doc_id = 70")).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0
    assert sketches.edited_sketches(docs.where("doc_id < 0")).count() == 0
    same = spark.createDataFrame([(1, "aaa bbb ccc")] * 40 + [(1, "zzz yyy xxx")], "doc_id long, text string").repartition(4)
    assert sketches.edited_sketches(same).count() == 41
    assert sketches.sketched(docs).count() == len(rows)


def test_whitening(spark):
    rng = np.random.default_rng(3)
    scale = np.array([3.0, 3.0, 2.9, 2.5, 1, 1, 1, 0.9, 0.85, 0.8] + [0.5] * 20)
    v = rng.standard_normal((700, 30)) * scale
    v[600:] = v[:100]
    rows = [(i, x.tolist(), "o", 1) for i, x in enumerate(v)]
    rows[7] = (None, rows[7][1], None, None)
    bad = [(900, None, "o", 1), (901, [None] + [0.0] * 29, "o", 1), (902, [math.nan] + [0.0] * 29, "o", 1), (903, [math.inf] + [0.0] * 29, "o", 1), (904, [], "o", 1)]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>, n string, x int").repartition(4)
    x = np.floor(1024 * v).astype(np.int64) + 100_000
    mean = x.mean(axis=0)
    cov = (x - mean).T @ (x - mean) / len(x)
    e, u = np.linalg.eigh(cov)
    e, u = e[::-1], u[:, ::-1]
    got = whitening.whitened(df).collect()
    assert len(got) == 700 * 8 and {r["n"] for r in got} == {700}
    exact = [sum((700 * int(a) - int(s)) ** 2 for a, s in zip(row, x.sum(axis=0))) for row in x]
    by_id = {(r["vec_id"], r["component"]): r for r in got}
    for i, row in enumerate(x):
        key = None if i == 7 else i
        for c in range(1, 9):
            r = by_id[key, c]
            assert int(r["deviation"]) == exact[i]
            assert math.isclose(r["explained"], e[c - 1] / cov.trace(), rel_tol=1e-10)
            assert abs(abs(r["whitened"]) - abs((row - mean) @ u[:, c - 1]) / math.sqrt(e[c - 1])) < 1e-7
    assert got[0]["identity_error"] < 1e-9
    assert whitening.whitened(df.where("vec_id >= 900")).count() == 0
    assert whitening.whitened(df.where("vec_id = 1")).count() == 0
    with pytest.raises(ValueError):
        whitening.whitened(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<double>"))


def test_few_directions_give_few_components(spark):
    rng = np.random.default_rng(8)
    v = rng.standard_normal((50, 3)) @ rng.standard_normal((3, 20))
    df = spark.createDataFrame([(i, np.round(x * 64).tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    got = whitening.whitened(df)
    assert got.select("component").distinct().count() == 8 and got.first()["identity_error"] < 1e-6
    flat = spark.createDataFrame([(i, [float(i), 2.0 * i, 0.0]) for i in range(9)], "vec_id long, embedding array<double>")
    assert sorted({r[0] for r in whitening.whitened(flat).select("component").collect()}) == [1]


@pytest.mark.parametrize("gap", [0.5, 1e-3, 0.0])
def test_leading_components_of_a_close_spectrum(gap):
    rng = np.random.default_rng(2)
    d = 200
    q = np.linalg.qr(rng.standard_normal((d, d)))[0]
    e = np.concatenate([[50], 10 + gap * np.arange(12)[::-1], rng.uniform(0, 10, d - 13)])
    a = q @ np.diag(e) @ q.T
    calls = []

    def product(b):
        calls.append(b.shape[1])
        return a @ b
    values, vectors = whitening.leading(product, d)
    want = np.sort(e)[::-1][:8]
    assert np.allclose(values, want, rtol=1e-12)
    assert np.abs(a @ vectors - vectors * values).max() < 1e-12 * values[0]
    assert np.abs(vectors.T @ vectors - np.eye(8)).max() < 1e-12


def test_wide_deviations_are_exact():
    x = np.array([[2**45, 1], [5, 2**44], [3, 3]], np.int64)
    s = x.sum(axis=0)
    c = whitening.Centre(3, s // 3, s % 3)
    assert [int(v) for v in c.deviations(x)] == [sum((3 * int(a) - int(b)) ** 2 for a, b in zip(r, s)) for r in x]


def test_query_columns(spark):
    sf = "/root/testdata/sf0.001"
    p = queries.op12_document_fingerprints(spark, sf)
    assert p.columns == ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    assert p.where("near_edited not between 0 and 1 or near_next not between 0 and 1").count() == 0
    w = queries.op13_embedding_whitening(spark, sf)
    assert dict(w.dtypes)["deviation"] == "bigint" and w.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
