"""Plan of a literature run: papers, texts, annotations and recorded replies to gated, sorted result rows.

Each stage is a function of DataFrames that returns what stays and what goes, so
every dropped candidate or row is kept with its reason. Texts stay out of the
joins until a stage needs them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import text
from ..operators import candidates, citations, evidence, gates, lexicon, metadata, output, screening
from ..tables import written


@dataclass
class Inputs:
    """papers (pmid, title, authors, year, journal, doi, abstract, is_mandatory), texts (pmid, text, captions), tables (pmid, tables), ner (pmid, symbol, gene_id,
    mentions), associations (pmid, position, source, label, variant, mention, evidence), details (pmid, gene, variant, error, user columns and citations),
    lexicon, primary and secondary citation counts, gene_dim (symbol, gene_id, full_name, aliases, chromosome)."""

    papers: DataFrame
    texts: DataFrame
    tables: DataFrame
    ner: DataFrame
    associations: DataFrame
    details: DataFrame
    lexicon: DataFrame
    primary_counts: DataFrame
    secondary_counts: DataFrame
    gene_dim: DataFrame


@dataclass
class Result:
    rows: DataFrame
    drops: DataFrame
    screening: DataFrame
    candidates: DataFrame


def discover(i: Inputs) -> DataFrame:
    """Candidates of all sources, merged: recorded replies, the mention index, the lexicon scan and annotations."""
    none = F.lit("")
    named = i.associations.select("pmid", "position", "source", "label", "variant", "mention", "evidence")
    index = candidates.mention_index(i.texts)
    shift = 1_000_000
    mentions = index.select("pmid", F.lit(shift).alias("position"), F.lit("llm_text").alias("source"), F.col("gene").alias("label"), "variant", "mention", F.col("sentence").alias("evidence"))
    scanned = lexicon.scan(i.texts, i.lexicon).select("pmid", (F.col("position") + 2 * shift).alias("position"), F.lit("deterministic_lexicon").alias("source"), F.col("gene").alias("label"), none.alias("variant"), none.alias("mention"), none.alias("evidence"))
    annotated = i.ner.select("pmid", F.lit(3 * shift).alias("position"), F.lit("pubtator").alias("source"), F.col("symbol").alias("label"), none.alias("variant"), F.coalesce(F.get("mentions", F.lit(0)), none).alias("mention"), none.alias("evidence"))
    every = named.unionByName(mentions).unionByName(scanned).unionByName(annotated)
    resolved = lexicon.resolve(every, i.lexicon)
    return candidates.merge(resolved.withColumn("gene", F.coalesce("symbol", F.trim("label"))))


def with_terms(found: DataFrame, lex: DataFrame) -> DataFrame:
    aliases = lex.select(F.upper("symbol").alias("_s"), F.concat(F.coalesce("alias_symbol", F.array().cast("array<string>")), F.coalesce("prev_symbol", F.array().cast("array<string>"))).alias("_aliases"))
    c = found.join(aliases, text.gene_key("gene") == F.col("_s"), "left")
    return c.withColumn("terms", candidates.search_terms("gene", "variant", "labels", "_aliases", "mentions")).drop("_s", "_aliases")


def validate(grounded: DataFrame, lex: DataFrame, texts: DataFrame) -> gates.Gate:
    """Confidence from lexicon and nomenclature; lexicon-only candidates need biological context."""
    known = lex.select(F.upper("symbol").alias("_s"), F.col("locus_type").alias("biotype"), F.lit(True).alias("_known"))
    c = grounded.join(known, text.gene_key("gene") == F.col("_s"), "left").withColumn("confidence", text.validation_confidence(F.coalesce("_known", F.lit(False)), "variant")).drop("_s", "_known")
    lone = (F.size("sources") == 1) & F.array_contains("sources", "deterministic_lexicon") & (F.col("variant") == "")
    c = c.join(texts.select("pmid", F.col("text").alias("_text")), "pmid", "left")
    c = c.withColumn("_c", F.when(lone, evidence.context_evidence("gene", "terms", "_text"))).withColumns({"context_supported": F.coalesce("_c.supported", F.lit(False)), "context_reason": F.coalesce("_c.reason", F.lit(""))}).drop("_c", "_text")
    return gates.validation_gate(written(c, "validated"))


def run(i: Inputs, user_columns: list[str], top_n: int | None = None) -> Result:
    """The whole plan."""
    papers = metadata.fuse_citations(i.papers, i.primary_counts, i.secondary_counts)
    screened = screening.screen(papers)
    # Rows that more than one branch reads are written: each branch would else find, ground and verify them all again.
    terms = with_terms(discover(i), i.lexicon)
    grounded, ungrounded = evidence.ground(terms, i.texts, hold=lambda x: written(x, "grounded"))
    passed, invalid = validate(grounded, i.lexicon, i.texts)
    kinds = passed.withColumn("candidate_type", candidates.candidate_type(F.col("sources"), F.col("variant"), F.col("context_reason")))
    d = i.details.withColumns({"_g": text.gene_key("gene"), "_v": text.gene_key(text.normalize_variant("gene", "variant"))}).drop("gene", "variant").withColumnRenamed("_g", "gene_key").withColumnRenamed("_v", "variant_key")
    keyed = kinds.withColumns({"gene_key": text.gene_key("gene"), "variant_key": text.gene_key("variant")})
    rows = written(output.details_or_skeletons(keyed, d, ["pmid", "gene_key", "variant_key"]).drop("gene_key", "variant_key"), "detailed")
    rows = evidence.backfill(rows, i.texts, user_columns[0], user_columns)
    rows = written(evidence.fill_missing(rows, user_columns, i.texts), "filled")
    index = citations.table_rows(i.tables)
    # All columns' quotes are rows of one table: each is verified once, and the rows meet the verdicts in one join, however many columns there are.
    row = F.xxhash64("gene", "variant")
    quotes = F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"`{c} Citation`").alias("citation")) for k, c in enumerate(user_columns)])
    asked = rows.select("pmid", row.alias("row"), "gene", F.col("labels").alias("names"), F.inline(quotes)).where(F.trim(F.coalesce("citation", F.lit(""))) != "").where(F.col("citation") != C.AUTO_SNIPPET)
    told = citations.verify(asked.withColumn("cid", F.struct("row", "k")), i.texts, index)
    verdict = lambda k, x: F.max(F.when(F.col("k") == k, F.col(x)))
    wide = told.groupBy("pmid", "row").agg(*[verdict(k, x).alias(f"{c}_citation_{n}") for k, c in enumerate(user_columns) for x, n in (("valid", "valid"), ("reason", "details"), ("confidence", "confidence"))])
    rows = rows.withColumn("row", row).join(wide, ["pmid", "row"], "left").drop("row")
    rows = rows.withColumn("validation_confidence", F.col("confidence"))
    kept, gone = gates.all_gates(written(rows, "verified"), user_columns)
    ner = i.ner.select("pmid", F.col("symbol").alias("_s"), F.col("gene_id").alias("NCBI Gene ID")).dropDuplicates(["pmid", "_s"])
    kept = kept.withColumn("_s", text.gene_key("gene")).join(ner, ["pmid", "_s"], "left").withColumn("Gene Source", F.when(F.col("`NCBI Gene ID`").isNotNull(), "both").otherwise("llm"))
    dim = i.gene_dim.select(F.upper("symbol").alias("_s"), F.col("full_name").alias("Gene Full Name"), F.array_join(F.slice("aliases", 1, 3), ", ").alias("Gene Aliases"), F.col("chromosome").alias("Chromosome"), F.col("gene_id").alias("_id"))
    kept = kept.join(dim, "_s", "left").withColumn("NCBI Gene ID", F.coalesce(F.nullif(F.trim("`NCBI Gene ID`"), F.lit("")), "_id")).drop("_s", "_id")
    words = F.concat_ws(" ", *[F.col(f"`{x}`") for c in user_columns for x in (c, f"{c} Citation")])
    kept = kept.withColumn("Association Type", candidates.row_type(F.col("candidate_type"), words, F.col("candidate_type")))
    about = papers.select("pmid", F.col("title").alias("Study Title"), F.array_join("authors", "; ").alias("Authors"), F.col("year").alias("Publication Year"), F.col("journal").alias("Journal Name"), F.col("doi").alias("DOI"), F.col("citations").alias("Citations"))
    kept = kept.join(about, "pmid").withColumnsRenamed({"pmid": "PMID", "gene": "Gene/Group", "variant": "Variant Name", "grounding_match": "Grounding Match", "grounding_source": "Grounding Source"}).withColumn("Candidate Source", F.array_join("sources", ","))
    final = gates.row_confidence(output.with_group(kept), user_columns)
    if top_n:
        best = papers.select(F.col("pmid").alias("PMID"), "is_mandatory", F.col("citations").alias("_c")).join(final.select("PMID").distinct(), "PMID", "left_semi").orderBy(F.desc("is_mandatory"), F.desc("_c"), "PMID").limit(top_n)
        final = final.join(best.select("PMID"), "PMID", "left_semi")
    shared = lambda x: x.select("pmid", "gene", "variant", "reason")
    drops = shared(ungrounded).unionByName(shared(invalid)).unionByName(shared(gone))
    return Result(final, drops, screened, passed)
