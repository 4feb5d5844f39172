"""The pipeline, stage by stage, against plain versions on the smallest tables."""

import random

import corpus_pipeline as pipeline
from test_operators import fingerprint, lower, words

from dyad.llm import quality, tokens

SF = "/root/testdata/sf0.001"


def rows(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(pipeline.STAGES)
    assert list(stages) == ["quality classifier", "line dedup", "simhash near-dedup", "benchmark decontamination", "best-fit packing"]
    step = lambda name, d: stages[name](spark, d, SF)

    good = step("quality classifier", docs)
    marks = rows(quality.scored(docs, spark.read.parquet(f"{SF}/labels.parquet")))
    assert good.columns == docs.columns
    before, after = rows(docs), rows(good)
    assert after == {i: r for i, r in before.items() if marks[i]["predicted"]}

    good = good.cache()
    lines = step("line dedup", good).cache()
    seen, want = [], {}
    for i in sorted(after):
        kept = []
        for line in after[i]["text"].split("\n"):
            w = words(line)
            own = {tuple(w[j:j + 5]) for j in range(max(len(w) - 4, 1))} if w else set()
            if not own or not any(9 * len(own & o) >= 4 * (len(own) + len(o)) for o in seen):
                kept.append(line)
            if own:
                seen.append(own)
        want[i] = "\n".join(kept)
    got = rows(lines)
    assert lines.columns == docs.columns and {i: r["text"] for i, r in got.items()} == want
    assert all(r["n_chars"] == len(want[i]) and (r["lang"], r["source"]) == (after[i]["lang"], after[i]["source"]) for i, r in got.items())

    first = step("simhash near-dedup", lines).cache()
    prints, root = {i: fingerprint(t) for i, t in want.items()}, {i: i for i in want}
    changed = True
    while changed:
        changed = False
        for i in want:
            for j in want:
                if (prints[i] ^ prints[j]).bit_count() <= 3 and root[i] > root[j]:
                    root[i], changed = root[j], True
    left = {i: t for i, t in want.items() if root[i] == i}
    assert {i: r["text"] for i, r in rows(first).items()} == left and first.columns == docs.columns

    clean = step("benchmark decontamination", first).cache()
    grams = lambda t: {tuple(w[i:i + 5]) for w in [words(lower(t))] for i in range(len(w) - 4)}
    items = [grams(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    left = {i: t for i, t in left.items() if not any(5 * len(x & grams(t)) >= 4 * len(x) for x in items)}
    assert {i: r["text"] for i, r in rows(clean).items()} == left and clean.columns == docs.columns

    packed = step("best-fit packing", clean).collect()
    encode = tokens.encoder(tokens.default_ranks())
    sizes = {}
    for r in packed:
        sizes[r["doc_id"]] = sizes.get(r["doc_id"], 0) + r["length"]
    assert sizes == {i: len(encode(t)) + 1 for i, t in left.items()}
    whole = {(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in packed}
    assert {(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in pipeline.run(spark, SF).collect()} == whole


def test_near_copies_at_the_similarity_leave(spark):
    rnd = random.Random(9)
    texts = []
    for _ in range(40):
        w = [f"w{rnd.randrange(10**6)}" for _ in range(rnd.choice([1, 4, 8, 30, 100, 300]))]
        texts.append(" ".join(w))
        for changes in (0, 1, 1, 2, 4):  # 100 words with one changed have similarity 0.9
            v = list(w)
            for _ in range(changes):
                v[rnd.randrange(len(v))] = f"new{rnd.randrange(10**6)}"
            texts.append(" ".join(v).title() + " tail" * rnd.randrange(2))
    texts += [None, "", " ", "one two", "One  Two"]
    order = list(range(len(texts)))
    rnd.shuffle(order)
    texts = [texts[i] for i in order]
    sets = [{tuple(w[i:i + 5]) for i in range(max(len(w) - 4, 1))} if w else set() for w in (words(lower(t)) for t in texts)]
    root = list(range(len(texts)))
    for j, y in enumerate(sets):
        for i, x in enumerate(sets[:j]):
            if 9 * len(x & y) >= 4 * (len(x) + len(y)) and root[i] != root[j]:
                lo, hi = sorted((root[i], root[j]))
                root = [lo if r == hi else r for r in root]
    docs = spark.createDataFrame([(i, t, "l", "s", 0) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    stage = dict(pipeline.STAGES)["simhash near-dedup"]
    assert set(rows(stage(spark, docs.repartition(3), SF))) == {i for i, r in enumerate(root) if i == r}
    twice = docs.unionByName(docs.where("doc_id = 0")).unionByName(docs.limit(1).selectExpr("0L as doc_id", "'quite another text' as text", "lang", "source", "n_chars"))
    got = [r["doc_id"] for r in stage(spark, twice, SF).collect()]
    assert sorted(got) == sorted([i for i, r in enumerate(root) if i == r] + [0])


def test_fingerprints_drop_what_shingle_sets_do_not_see(spark):
    refrain = "one two three " * 200
    texts = [refrain, refrain + " ".join(f"new{i}" for i in range(12)), "quite another text of its own"]
    assert (fingerprint(texts[0]) ^ fingerprint(texts[1])).bit_count() <= 3
    docs = spark.createDataFrame([(i, t, "l", "s", 0) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    assert set(rows(dict(pipeline.STAGES)["simhash near-dedup"](spark, docs, SF))) == {0, 2}
