"""The whole literature run over the given tables: papers, texts, annotations and recorded replies made of documents, gated rows and drops out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import candidates, lexicon
from .plans import literature
from .registry import Registry
from .tables import base

R = Registry()

_SYMBOL = "'GEN' || CAST(doc_id % 50 AS STRING) || 'K'"
_ALIAS = "'alias-' || CAST(doc_id % 50 AS STRING) || 'Q'"
_SENTENCE = f"{_SYMBOL} || ' expression was significantly higher in ' || lang || ' tumours, with ' || CAST(n_chars % 90 + 10 AS STRING) || ' patients studied in ' || source"
_ANNOTATED = "doc_id % 4 = 0"
_GIVEN = f"SELECT doc_id, lang, source, n_chars, {_SYMBOL} AS symbol, {_ALIAS} AS alias, {_SENTENCE} AS sentence FROM documents"


def _inputs(spark: SparkSession, sf_dir: str) -> literature.Inputs:
    """A run's tables: each document's paper names a gene, every third reply also one that stands nowhere, and odd ones quote what no paper says."""
    d = spark.sql(_GIVEN.replace("FROM documents", "FROM {documents}"), documents=base(spark, sf_dir, "documents")).withColumn("pmid", F.col("doc_id").cast("string"))
    none, n = F.lit(""), F.col("doc_id")
    symbols = d.select("symbol", "alias").distinct()
    named = d.select("pmid", F.lit(0).alias("position"), F.lit("llm_text").alias("source"), F.when(n % 6 == 0, F.col("alias")).otherwise(F.col("symbol")).alias("label"), none.alias("variant"), F.col("symbol").alias("mention"), none.alias("evidence"))
    lost = d.where(n % 3 == 0).select("pmid", F.lit(1).alias("position"), F.lit("llm_text").alias("source"), F.concat(F.lit("LOST"), n.cast("string")).alias("label"), none.alias("variant"), none.alias("mention"), none.alias("evidence"))
    return literature.Inputs(
        papers=d.select("pmid", F.concat(F.lit("T"), "pmid").alias("title"), F.array("lang", "source").alias("authors"), F.lit("2020").alias("year"), F.col("lang").alias("journal"), none.alias("doi"), F.repeat(F.lit("abstract "), F.lit(20)).alias("abstract"), (n % 9 == 0).alias("is_mandatory")),
        texts=d.select("pmid", F.concat(F.lit("Background words stand here. "), "sentence", F.lit(". Methods follow.")).alias("text"), none.alias("captions")),
        tables=d.limit(0).select("pmid", F.lit(None).cast("array<struct<label:string,table_id:string,rows:array<array<string>>>>").alias("tables")),
        ner=d.where(_ANNOTATED).select("pmid", "symbol", n.cast("string").alias("gene_id"), F.array("symbol").alias("mentions")),
        associations=named.unionByName(lost),
        details=d.select("pmid", F.col("symbol").alias("gene"), none.alias("variant"), none.alias("error"), F.concat(F.lit("higher in "), "lang").alias("Key Finding"), F.when(n % 2 == 0, F.col("sentence")).otherwise("Nothing of this kind was ever written by anybody in any paper").alias("Key Finding Citation")),
        lexicon=symbols.select(F.lit(0).alias("ordinal"), "symbol", F.array("alias").alias("alias_symbol"), F.array().cast("array<string>").alias("prev_symbol"), F.lit("gene").alias("locus_type")),
        primary_counts=d.where(n % 3 != 1).select("pmid", (F.col("n_chars") % 300).cast("int").alias("count")),
        secondary_counts=d.where(n % 2 == 0).select("pmid", (F.col("n_chars") % 70).cast("int").alias("count"), (n % 5 != 0).alias("ok")),
        gene_dim=symbols.select("symbol", F.concat(F.lit("D"), "symbol").alias("gene_id"), F.lower("symbol").alias("full_name"), F.array(F.lit("a"), F.lit("b"), F.lit("c"), F.lit("d")).alias("aliases"), F.lit("17").alias("chromosome")),
    )


@R.query(f"""WITH g AS ({_GIVEN}), k AS (SELECT *, CAST(doc_id AS VARCHAR) AS pmid, {_ANNOTATED} AS annotated, CAST(CASE WHEN doc_id % 3 <> 1 THEN n_chars % 300 WHEN doc_id % 2 = 0 AND doc_id % 5 <> 0 THEN n_chars % 70 ELSE 0 END AS INT) AS citations FROM g)
SELECT pmid, symbol AS gene, 'kept' AS outcome, CASE WHEN annotated THEN 'HIGH' ELSE 'MEDIUM' END AS confidence, CASE WHEN annotated THEN pmid ELSE 'D' || symbol END AS gene_id, CASE WHEN annotated THEN 'both' ELSE 'llm' END AS gene_source, lower(symbol) AS full_name, 'a, b, c' AS aliases, citations,
  CASE WHEN annotated THEN 'deterministic_lexicon,llm_text,pubtator' ELSE 'deterministic_lexicon,llm_text' END AS sources FROM k WHERE doc_id % 2 = 0
UNION ALL SELECT pmid, symbol, 'ungrounded_citation', NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM k WHERE doc_id % 2 = 1
UNION ALL SELECT pmid, 'LOST' || pmid, 'not_grounded_in_text', NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM k WHERE doc_id % 3 = 0""".replace("AS STRING", "AS VARCHAR"))
def literature_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of all sources merged, grounded, validated, detailed, cited, gated and joined with their dimensions; drops with their reason."""
    result = literature.run(_inputs(spark, sf_dir), ["Key Finding"])
    kept = result.rows.select(F.col("PMID").alias("pmid"), F.col("`Gene/Group`").alias("gene"), F.lit("kept").alias("outcome"), F.col("Confidence").alias("confidence"), F.col("`NCBI Gene ID`").alias("gene_id"), F.col("`Gene Source`").alias("gene_source"), F.col("`Gene Full Name`").alias("full_name"), F.col("`Gene Aliases`").alias("aliases"), F.col("Citations").alias("citations"), F.col("`Candidate Source`").alias("sources"))
    return kept.unionByName(result.drops.select("pmid", "gene", F.col("reason").alias("outcome")), allowMissingColumns=True)


@R.query(f"""WITH g AS ({_GIVEN}) SELECT CAST(doc_id AS VARCHAR) AS pmid, symbol, CASE WHEN doc_id % 6 = 0 THEN alias ELSE symbol END AS label, CASE WHEN doc_id % 6 = 0 THEN alias || '->' || symbol || ' (local_alias)' ELSE 'local_symbol' END AS note FROM g""".replace("AS STRING", "AS VARCHAR"))
def symbols_noted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels with their symbol and how they came to it."""
    i = _inputs(spark, sf_dir)
    named = lexicon.resolve(i.associations.where("position = 0"), i.lexicon)
    return named.select("pmid", "symbol", "label", lexicon.normalization_note("label", "symbol", "resolution").alias("note"))


_MENTION = "CASE doc_id % 3 WHEN 0 THEN 'MMP-9' WHEN 1 THEN 'TNF-alpha' ELSE 'IFN-gamma' END"


@R.query(f"""SELECT CAST(doc_id AS VARCHAR) AS pmid, CASE doc_id % 3 WHEN 0 THEN 'MMP9' WHEN 1 THEN 'TNF' ELSE 'IFNG' END AS gene, {_MENTION} AS mention FROM documents""".replace("AS STRING", "AS VARCHAR"))
def mentions_looked_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mentions of each candidate's gene in its paper, by an index of the texts."""
    d = base(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("pmid"), F.expr(_MENTION).alias("m"), F.col("doc_id"))
    texts = d.select("pmid", F.concat(F.lit("Levels of "), "m", F.lit(" rose in the cohort.")).alias("text"))
    gene = F.when(F.col("doc_id") % 3 == 0, "MMP9").when(F.col("doc_id") % 3 == 1, "TNF").otherwise("IFNG")
    asked = d.select("pmid", gene.alias("gene"), F.lit("").alias("variant"))
    return candidates.mentions_for(candidates.mention_index(texts), asked).select("pmid", "gene", "mention")


QUERIES, ORACLE_SQL = R.queries, R.sql
