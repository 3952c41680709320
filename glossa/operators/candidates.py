"""Candidates: mention index, merging with provenance, types and groups, search terms."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import text


def mention_index(texts: DataFrame, id_column: str = "pmid", text_column: str = "text") -> DataFrame:
    """Distinct normalized mentions: id, mention, gene, variant, sentence, rule.

    Texts are split once; only sentences that hold a rule's leading letters meet the rules, all in one pass.
    """
    lead = r"(?i)IFN|interferon|TNF|MMP|HLA"
    s = texts.where(F.col(text_column).rlike(lead)).select(id_column, F.explode(text.sentences(text_column)).alias("sentence")).where(F.col("sentence").rlike(lead))
    inner = r"(?i)([ABC])w?[\s\-]*\*?(\d{2,4}(?::\d{2,4}){0,3})$"

    def found(name: str, pattern: str, gene: str | None) -> Column:
        def shaped(m: Column) -> Column:
            locus = F.concat(F.lit("HLA-"), F.upper(F.regexp_extract(m, inner, 1)))
            g, v = (F.lit(gene), F.lit("")) if gene else (locus, F.concat(locus, F.lit("*"), F.regexp_extract(m, inner, 2)))
            return F.struct(m.alias("mention"), g.alias("gene"), v.alias("variant"), F.lit(name).alias("rule"))

        return F.transform(F.regexp_extract_all("sentence", F.lit(pattern), F.lit(0)), shaped)

    rules = [found(n, p, g) for n, g, p in C.ALIAS_RULES] + [found("hla_direct_allele", C.HLA_DIRECT, None)]
    short = found("hla_class_i_allele_shorthand", C.HLA_SHORT, None)
    rules.append(F.when(F.col("sentence").rlike(C.HLA_CONTEXT), short).otherwise(F.slice(short, 1, 0)))
    return s.select(id_column, "sentence", F.explode(F.concat(*rules)).alias("m")).select(id_column, "m.mention", "m.gene", "m.variant", "sentence", "m.rule").distinct()


def mentions_for(index: DataFrame, candidates: DataFrame, id_column: str = "pmid") -> DataFrame:
    """Mentions of each candidate (gene, variant): same gene, and a variant that agrees or, for gene-level candidates, none."""
    c = candidates.select(id_column, text.gene_key("gene").alias("_g"), F.upper(text.normalize_variant("gene", "variant")).alias("_v"), "gene", "variant")
    m = index.select(id_column, text.gene_key("gene").alias("_g"), F.upper("variant").alias("_mv"), "mention", "sentence", "rule")
    fits = ((F.col("_v") != "") & ((F.col("_mv") == "") | (F.col("_mv") == F.col("_v")))) | ((F.col("_v") == "") & (F.col("_mv") == ""))
    return c.join(m, [id_column, "_g"]).where(fits).drop("_g", "_v", "_mv")


def merge(associations: DataFrame, id_column: str = "pmid") -> DataFrame:
    """One row for each (paper, gene, variant): its sources, labels, ordered mentions and first evidence.

    associations has id, position, source, gene (resolved), label (as reported),
    variant, mention and evidence; earlier positions win.
    """
    a = associations.withColumn("variant", text.normalize_variant("gene", "variant")).where(text.gene_key("gene") != "")
    a = a.withColumns({"_gene": text.gene_key("gene"), "_variant": text.gene_key("variant")})
    filled = lambda c: F.nullif(F.trim(F.coalesce(F.col(c), F.lit(""))), F.lit(""))
    ordered = F.transform(F.array_sort(F.collect_list(F.when(filled("mention").isNotNull(), F.struct("position", filled("mention").alias("m"))))), lambda x: x["m"])
    return a.groupBy(id_column, "_gene", "_variant").agg(
        F.min_by("gene", "position").alias("gene"), F.min_by("variant", "position").alias("variant"),
        F.array_sort(F.collect_set("source")).alias("sources"),
        F.array_sort(F.array_distinct(F.array_compact(F.flatten(F.collect_list(F.array(filled("label"), filled("mention"))))))).alias("labels"),
        ordered.alias("_mentions"), F.coalesce(F.min_by(filled("evidence"), F.when(filled("evidence").isNotNull(), F.col("position"))), F.lit("")).alias("evidence"),
        F.min("position").alias("position"),
    ).withColumn("mentions", text.normalize_list("_mentions")).drop("_gene", "_variant", "_mentions")


def search_terms(gene: Column | str, variant: Column | str, labels: Column | str, aliases: Column | str, mentions: Column | str, most_aliases: int = 15) -> Column:
    """Terms to look a candidate up by, in order, each once regardless of case."""
    col = lambda x: F.col(x) if isinstance(x, str) else x
    none = F.array().cast("array<string>")
    parts = F.concat(F.array(F.coalesce(col(variant), F.lit("")), F.coalesce(col(gene), F.lit(""))), F.array_sort(F.coalesce(col(labels), none)), F.slice(F.coalesce(col(aliases), none), 1, most_aliases), F.coalesce(col(mentions), none))
    return text.normalize_list(parts)


def candidate_type(sources: Column, variant: Column, context_reason: Column) -> Column:
    """What a candidate seems to be, the first of an ordered list."""
    has = lambda *names: F.arrays_overlap(sources, F.array(*[F.lit(n) for n in names]))
    return (
        F.when(variant != "", "variant_association").when(has("llm_figure"), "figure_derived_gene")
        .when(context_reason == "pathway_context", "mechanistic_pathway_gene").when(context_reason == "result_context", "mechanistic_or_biomarker_gene")
        .when(has("pubtator"), "pubtator_supported_gene").when((F.size(sources) == 1) & has("deterministic_lexicon"), "deterministic_candidate")
        .when(has("llm_text", "llm_abstract"), "llm_supported_gene").otherwise("candidate_gene")
    )


def row_type(base: Column, row_text: Column, fallback: Column) -> Column:
    """A row's type: three strong types stay, else words of the row decide, else the candidate's type."""
    t = F.lower(row_text)
    has = lambda *words: reduce(lambda a, b: a | b, [F.contains(t, F.lit(w)) for w in words])
    return (
        F.when(base.isin("variant_association", "susceptibility_gene", "figure_derived_gene"), base)
        .when(has("genome wide association", "susceptibility", "polymorphism"), "susceptibility_gene")
        .when(has("knockout", "murine model", "mouse model") | F.contains(F.concat(F.lit(" "), t, F.lit(" ")), F.lit(" ko ")), "animal_model_gene")
        .when(has("biomarker", "serum level", "diagnos"), "biomarker_response_gene")
        .when(has("pathway", "signaling", "nf kappab") | t.rlike(r"\bmapk\b"), "mechanistic_pathway_gene")
        .otherwise(F.coalesce(F.nullif(base, F.lit("")), fallback))
    )


def association_group(kind: Column | str) -> Column:
    k = F.trim(F.coalesce(F.col(kind) if isinstance(kind, str) else kind, F.lit("")))
    chain = None
    for t, group in C.TYPE_GROUPS.items():
        chain = F.when(k == t, group) if chain is None else chain.when(k == t, group)
    return chain.otherwise(C.OTHER_GROUP)


def group_counts(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Rows of each association group: the explicit one, or that of the type."""
    group = F.coalesce(F.nullif(F.trim("association_group"), F.lit("")), association_group("association_type"))
    return rows.groupBy(*(by or []), group.alias("association_group")).agg(F.count("*").alias("n"))


def with_gene_level(candidates: DataFrame, id_column: str = "pmid") -> DataFrame:
    """Adds (gene, no variant) for genes of which only variants are there."""
    genes = candidates.select(id_column, "gene").distinct()
    there = candidates.where("variant = ''").select(id_column, "gene")
    return candidates.select(id_column, "gene", "variant").unionByName(genes.join(there, [id_column, "gene"], "left_anti").withColumn("variant", F.lit("")))


def source_counts(candidates: DataFrame) -> DataFrame:
    return candidates.select(F.explode("sources").alias("source")).groupBy("source").agg(F.count("*").alias("n"))


def source_sets(ner: Column, llm: Column) -> dict[str, Column]:
    """Union, overlap and differences of two gene lists."""
    return {"all_genes": F.array_sort(F.array_union(ner, llm)), "both": F.array_sort(F.array_intersect(ner, llm)), "only_ner": F.array_sort(F.array_except(ner, llm)), "only_llm": F.array_sort(F.array_except(llm, ner))}


def allele_variants(details: DataFrame, candidates: DataFrame, id_column: str = "pmid") -> DataFrame:
    """HLA detail rows without variant take the allele of their gene if it is the only candidate and no gene-level one exists."""
    hla = candidates.where(F.col("gene").startswith("HLA-"))
    one = hla.where("variant <> ''").groupBy(id_column, "gene").agg(F.countDistinct("variant").alias("_n"), F.first("variant").alias("_allele")).where("_n = 1")
    one = one.join(hla.where("variant = ''"), [id_column, "gene"], "left_anti").select(id_column, "gene", "_allele")
    return details.join(one, [id_column, "gene"], "left").withColumn("variant", F.coalesce(F.nullif("variant", F.lit("")), "_allele", F.lit(""))).drop("_allele")
