"""Queries of this subpackage on the tables of a folder, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import alignment, decontaminate, divergence, embeddings, licenses, linededup, lm, mixing, neardup, packing, secrets, tokenfile, toxicity

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document scored by a bigram automaton of the training documents. Null text: its end token only; null id: the crc32 of empty text; repeated rows: each scored; no training rows: all unknown, score 0."""
    return lm.lm_scores(_table(spark, sf_dir, "documents"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's words that benchmark windows cover. Null or wordless text: no words, no hits; an item without id hits unlisted; repeated rows: each its own."""
    return decontaminate.digest(decontaminate.contaminated_spans(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")))


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document row's class of near duplicates. Text without words: a class of its own; null ids: named by another id of the class if it has one; repeated rows: one of them kept."""
    return neardup.near_duplicates(_table(spark, sf_dir, "documents"))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document. Null or empty text: no spans; repeated rows: each its own; values of any length are costed whole."""
    return secrets.secret_scan(_table(spark, sf_dir, "documents"))


def op5_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document written to token-id files and read back. Null or empty text: the end id only; null id: first; repeated ids: side by side, by a hash of their texts."""
    return tokenfile.token_digest(_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), end=2)


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence signs of every document. Null or empty text: no labels, score 0; a malformed expression: its identifiers at a lower strength."""
    return licenses.license_scan(_table(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's tokens packed into sequences of 2048. Null or empty text: its end id; longer texts are cut into pieces; repeated rows: each packed."""
    return packing.best_fit_pack(_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), end=0)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without later occurrences of three-line windows. Null text: null, no lines; rows of one id: in the order in which they were read; null id: first."""
    return linededup.dedup_lines(_table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity score. Null, empty or wordless text: that of a text which says nothing; no labels of both classes: 0."""
    return toxicity.toxicity_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's links and class. Null, empty, zero or non-finite vectors: no links; other lengths: compared among themselves; repeated ids: vectors of their own."""
    return embeddings.near_vectors(_table(spark, sf_dir, "embeddings"))


def op11_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of every document a mix of all sources takes. Null text: size 0; null source: the last one; repeated rows: each taken for itself; a very long text: counted whole, and taken at most twice."""
    return mixing.mix_digest(_table(spark, sf_dir, "documents"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's tokens by two tokenizers, aligned. Null or empty text, or one that a tokenizer does not give back: zeros; repeated rows: each counted; a very long text: aligned whole."""
    return alignment.align_tokenizers(_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the sources of each language differ. Null text, lang or source: empty; a source without terms: audited with counts of 0; ties: by the bytes of the name; a very long text: counted whole."""
    return divergence.source_divergence(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    "op1_lm_scores": op1_lm_scores,
    "op2_decontaminate": op2_decontaminate,
    "op3_near_duplicates": op3_near_duplicates,
    "op4_secrets": op4_secrets,
    "op5_token_ids": op5_token_ids,
    "op6_licenses": op6_licenses,
    "op7_packing": op7_packing,
    "op8_line_dedup": op8_line_dedup,
    "op9_toxicity": op9_toxicity,
    "op10_near_vectors": op10_near_vectors,
    "op11_source_mix": op11_source_mix,
    "op12_token_alignment": op12_token_alignment,
    "op13_source_divergence": op13_source_divergence,
}

ORACLE_SQL: dict[str, str] = {
    "op2_decontaminate": r"""
WITH words AS (
  SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos
  FROM (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents)
), items AS (
  SELECT item_id, w, least(10, len(w)) AS n
  FROM (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark)
  WHERE len(w) > 0
), windows AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i : i + n - 1], ' ') AS win
  FROM (SELECT item_id, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM items)
), lengths AS (SELECT DISTINCT n FROM windows), grams AS (
  SELECT doc_id, pos, n, array_to_string(g, ' ') AS win
  FROM (
    SELECT doc_id, pos, n, list(word) OVER (PARTITION BY doc_id, n ORDER BY pos ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING)[1 : n] AS g
    FROM words CROSS JOIN lengths
  ) WHERE len(g) = n
), hits AS (
  SELECT doc_id, pos, grams.n, item_id FROM grams JOIN windows ON grams.win = windows.win AND grams.n = windows.n
), covered AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(pos, pos + n)) AS p FROM hits) GROUP BY doc_id
), found AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id
), sizes AS (SELECT doc_id, count(*) AS n_words FROM words GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM documents d LEFT JOIN sizes USING (doc_id) LEFT JOIN covered USING (doc_id) LEFT JOIN found USING (doc_id)
""",
    "op8_line_dedup": r"""
WITH lines AS (
  SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS pos FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)
), triples AS (
  SELECT doc_id, pos, line AS a, lead(line, 1) OVER w AS b, lead(line, 2) OVER w AS c FROM lines WINDOW w AS (PARTITION BY doc_id ORDER BY pos)
), later AS (
  SELECT doc_id, pos FROM (
    SELECT doc_id, pos, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, pos) AS nth
    FROM triples WHERE c IS NOT NULL AND a || b || c <> ''
  ) WHERE nth > 1
), gone AS (SELECT DISTINCT doc_id, unnest([pos, pos + 1, pos + 2]) AS pos FROM later),
kept AS (
  SELECT doc_id, count(*) AS n_lines, count(g.pos) AS n_removed, string_agg(CASE WHEN g.pos IS NULL THEN line END, chr(10) ORDER BY pos) AS text
  FROM lines LEFT JOIN gone g USING (doc_id, pos) GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed,
  CASE WHEN d.text IS NOT NULL THEN coalesce(k.text, '') END AS text
FROM documents d LEFT JOIN kept k USING (doc_id)
""",
    "op11_source_mix": r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents
), sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, [3, 1, 2][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS INT) + 1] AS w FROM sized GROUP BY source
), ordered AS (
  SELECT *, row_number() OVER (ORDER BY source_size * (6 // w), source NULLS LAST) AS k FROM sources
), levels AS (
  SELECT k, source_size, w, 150 * sum(source_size) OVER () - 200 * coalesce(sum(source_size) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS num,
    100 * sum(w) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS den FROM ordered
), first_open AS (
  SELECT k, CAST(num AS DOUBLE) AS num, CAST(den AS DOUBLE) AS den FROM levels WHERE num * w <= 2 * den * source_size ORDER BY k LIMIT 1
), targets AS (
  SELECT o.source, source_size, CASE WHEN o.k < f.k THEN 2.0::DOUBLE * source_size ELSE w * f.num / f.den END AS target,
    CAST('0x' || substr(md5('mix-1' || CASE WHEN o.source IS NULL THEN '-' ELSE '+' || o.source END), 1, 7) AS BIGINT) * 4 AS shift
  FROM ordered o CROSS JOIN first_open f
), rates AS (
  SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE least(CAST(floor(target / source_size * 1073741824.0::DOUBLE) AS BIGINT), 2147483648) END AS rate FROM targets
), placed AS (
  SELECT doc_id, source, size, row_number() OVER (PARTITION BY source ORDER BY size, doc_id NULLS FIRST) - 1 AS place FROM sized
)
SELECT doc_id, size, source_size, target, CAST(size * ((rate * (place + 1) + shift) // 1073741824 - (rate * place + shift) // 1073741824) AS BIGINT) AS taken
FROM placed JOIN rates ON placed.source IS NOT DISTINCT FROM rates.source
""",
    "op13_source_divergence": r"""
WITH docs AS (
  SELECT row_number() OVER () AS d, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents
), words AS (
  SELECT d, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs
), counted AS (
  SELECT lang, term, source, count(*) AS n, count(DISTINCT d) AS docs FROM words GROUP BY ALL
), kept AS (
  SELECT lang, term, CAST(sum(n) AS HUGEINT) AS n FROM counted GROUP BY lang, term HAVING sum(docs) >= 10
), vocabulary AS (SELECT lang, CAST(count(*) AS HUGEINT) AS v FROM kept GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM docs),
cells AS (
  SELECT g.lang, g.source, k.term, CAST(coalesce(c.n, 0) AS HUGEINT) AS n, k.n AS all_n
  FROM groups g JOIN kept k USING (lang) LEFT JOIN counted c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), p AS (
  SELECT lang, source, term, n, 1 + (1000000000 * (n + 2)) // (sum(n) OVER (PARTITION BY lang, source)::HUGEINT + 2 * v) AS p,
    1 + (1000000000 * (all_n + 2)) // (sum(all_n) OVER (PARTITION BY lang, source)::HUGEINT + 2 * v) AS q
  FROM cells JOIN vocabulary USING (lang)
), far AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN far f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
), terms AS (
  SELECT lang, source, 'term' AS part, term AS item, CAST((p - q) * (p - q) // (p + q) AS BIGINT) AS value FROM p WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INT) AS rank
FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms) QUALIFY part = 'pair' OR rank <= 10
""",
}
