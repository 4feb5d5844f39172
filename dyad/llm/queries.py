"""The named queries of this package and, where SQL can say it, a statement that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dyad.llm import (
    containment,
    exact,
    lengths,
    likelihood,
    lines,
    packing,
    phrases,
    pii,
    quality,
    simhash,
    sketches,
    substrings,
    whitening,
)
from dyad.llm.store import table


def op1_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and the groups that their links make."""
    return simhash.groups(table(spark, sf_dir, "documents", "doc_id", "text"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the words of passages of 20 words that stand earlier."""
    left = substrings.without_repeats(table(spark, sf_dir, "documents", "doc_id", "text"))
    return left.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item found in a document: at least four fifths of its five-word shingles are there."""
    found = containment.contained(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"))
    return found.withColumn("containment", F.col("n_shared") / F.col("n_shingles"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all documents, learnt from the labelled ones outside the held-out fifth."""
    return quality.scored(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "labels", "doc_id", "quality"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers for every context limit, from the token lengths of all documents."""
    return lengths.length_table(table(spark, sf_dir, "documents", "text"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal documents."""
    return exact.duplicates(table(spark, sf_dir, "documents", "doc_id", "text"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the lines that have an earlier similar line."""
    left = lines.without_similar(table(spark, sf_dir, "documents", "doc_id", "text"))
    return left.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all documents, by rules and by learnt wording."""
    return pii.digest(pii.personal_data(table(spark, sf_dir, "documents", "doc_id", "text")))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 1024 tokens."""
    return packing.pack(table(spark, sf_dir, "documents", "doc_id", "text"))


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probability of all documents under the subword lattice and under word counts, learnt outside the held-out tenth."""
    return likelihood.scored(table(spark, sf_dir, "documents", "doc_id", "text"))


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language's first collocations, from all documents; a null text is empty, a null language `und`."""
    return phrases.collocations(table(spark, sf_dir, "documents", "text", "lang"))


def op12_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts, with the likeness to these and to the next document; a null text is empty."""
    s = sketches.edited_sketches(table(spark, sf_dir, "documents", "doc_id", "text"))
    return s.select("doc_id", "n_chars", "edited_sha256", sketches.as_text(F.col("sketch")).alias("fingerprint"), sketches.as_text(F.col("edited")).alias("edited_fingerprint"),
                    "near_edited", "near_next")


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All whole embeddings along their first eight components, whitened; rows with null or non-finite entries go."""
    return whitening.whitened(table(spark, sf_dir, "embeddings", "vec_id", "embedding")).withColumn("deviation", F.col("deviation").cast("long"))


QUERIES = {f.__name__: f for f in (op1_simhash_dedup, op2_substring_dedup, op3_decontamination, op4_quality_classifier, op5_token_counts, op6_exact_dedup, op7_line_dedup, op8_personal_data,
                                    op9_best_fit_packing, op10_lm_scoring, op11_phrase_collocations, op12_document_fingerprints, op13_embedding_whitening)}

SQL = {
    "op2_substring_dedup": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d),
k AS (SELECT doc_id, i, array_to_string(list_slice(w, i, i + 19), ' ') AS g FROM p WHERE i + 19 <= len(w)),
n AS (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS nth FROM k),
gone AS (SELECT DISTINCT doc_id, j AS i FROM (SELECT doc_id, unnest(range(i, i + 20)) AS j FROM n WHERE nth > 1)),
words AS (SELECT p.doc_id, p.i, w[p.i] AS word, gone.i IS NOT NULL AS dropped FROM p LEFT JOIN gone ON p.doc_id = gone.doc_id AND p.i = gone.i),
c AS (SELECT doc_id, sum(CASE WHEN dropped THEN 1 ELSE 0 END) AS n_removed,
             string_agg(CASE WHEN dropped THEN NULL ELSE word END, ' ' ORDER BY i) AS kept FROM words GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(c.n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(c.kept, '')) AS kept_sha256
FROM d LEFT JOIN c ON d.doc_id = c.doc_id""",
    "op3_decontamination": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM benchmark),
dp AS (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5),
bp AS (SELECT item_id, w, unnest(range(1, len(w) - 3)) AS i FROM b WHERE len(w) >= 5),
ds AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 4), ' ') AS s FROM dp),
bs AS (SELECT DISTINCT item_id, array_to_string(list_slice(w, i, i + 4), ' ') AS s FROM bp),
q AS (SELECT item_id, count(*) AS n FROM bs GROUP BY item_id),
m AS (SELECT doc_id, item_id, count(*) AS n_shared FROM ds JOIN bs ON ds.s = bs.s GROUP BY doc_id, item_id)
SELECT doc_id, m.item_id, n AS n_shingles, n_shared, CAST(n_shared AS DOUBLE) / n AS containment
FROM m JOIN q ON m.item_id = q.item_id WHERE 5 * n_shared >= 4 * n""",
    "op6_exact_dedup": r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM n""",
    "op7_line_dedup": r"""
WITH t AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
l AS (SELECT doc_id, i, ls[i] AS content, regexp_extract_all(ls[i], '[^\x20\x09-\x0D]+') AS w FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM t)),
p AS (SELECT doc_id, i, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS j FROM l WHERE len(w) > 0),
s AS (SELECT DISTINCT doc_id, i, array_to_string(list_slice(w, j, j + 4), ' ') AS g FROM p),
n AS (SELECT doc_id, i, count(*) AS n FROM s GROUP BY doc_id, i),
m AS (SELECT a.doc_id AS ad, a.i AS ai, b.doc_id AS bd, b.i AS bi, count(*) AS c FROM s a JOIN s b ON a.g = b.g
      WHERE a.doc_id < b.doc_id OR (a.doc_id = b.doc_id AND a.i < b.i) GROUP BY a.doc_id, a.i, b.doc_id, b.i),
gone AS (SELECT DISTINCT bd AS doc_id, bi AS i FROM m JOIN n x ON x.doc_id = ad AND x.i = ai JOIN n y ON y.doc_id = bd AND y.i = bi WHERE 9 * c >= 4 * (x.n + y.n)),
k AS (SELECT l.doc_id, sum(CASE WHEN gone.i IS NULL THEN 0 ELSE 1 END) AS n_removed, count(*) AS n_lines,
             string_agg(CASE WHEN gone.i IS NULL THEN content END, chr(10) ORDER BY l.i) AS kept
      FROM l LEFT JOIN gone ON l.doc_id = gone.doc_id AND l.i = gone.i GROUP BY l.doc_id)
SELECT d.doc_id, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents d LEFT JOIN k ON d.doc_id = k.doc_id""",
    "op11_phrase_collocations": r"""
WITH t AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS s FROM documents),
p AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM (SELECT lang, unnest(string_split_regex(s, '[.,;:!?\x0A-\x0D]')) AS piece FROM t)),
i AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM p),
f AS (SELECT lang, k, array_to_string(list_slice(w, i, i + k - 1), ' ') AS g, count(*) AS n
      FROM i, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE i + k - 1 <= len(w) GROUP BY 1, 2, 3),
words AS (SELECT lang, CAST(sum(n) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, g, n AS a, string_split(g, ' ') AS w FROM f WHERE k >= 2 AND n >= 30),
cut AS (SELECT *, unnest(range(1, k)) AS j FROM c),
s AS (SELECT cut.lang, cut.g, a, x.n AS l, y.n AS r, CAST(CAST(2000000 AS HUGEINT) * a // (x.n + y.n) AS BIGINT) AS score, j
      FROM cut JOIN f x ON x.lang = cut.lang AND x.g = array_to_string(list_slice(cut.w, 1, j), ' ')
      JOIN f y ON y.lang = cut.lang AND y.g = array_to_string(list_slice(cut.w, j + 1, cut.k), ' ')),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, j) = 1),
o AS (SELECT lang, w, k, a, m, unnest(range(1, k - m + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS m FROM c WHERE k > 2)),
z AS (SELECT lang, array_to_string(list_slice(w, i, i + m - 1), ' ') AS g, max(a) AS longer FROM o GROUP BY 1, 2),
q AS (SELECT b.lang, b.g AS phrase, a, l, r, score, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.g) AS rank
      FROM b LEFT JOIN z ON z.lang = b.lang AND z.g = b.g WHERE longer IS NULL OR 100 * longer < 80 * a)
SELECT q.lang, rank, phrase, a, l, r, words.n, score FROM q JOIN words ON words.lang = q.lang WHERE rank <= 2000""",
}
