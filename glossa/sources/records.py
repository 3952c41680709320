"""Record sources: MEDLINE text, JSON annotation documents, lexicon, journal ranks, manifests, outputs, replies."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import format_issn, journal_key

_LISTS = {"AU": "authors", "AD": "affiliations", "AID": "aid", "LID": "lid", "PT": "publication_types"}
_SINGLE = {"PMID": "pmid", "TI": "title", "JT": "journal", "AB": "abstract", "DP": "dp", "EDAT": "edat", "PHST": "phst", "DEP": "dep", "PDAT": "pdat", "IS": "issn"}


def read_medline(spark: SparkSession, path: str) -> DataFrame:
    """Records of MEDLINE text files: one a blank-line block, tags in four columns, continuation lines indented."""
    return parse_medline(spark.read.option("lineSep", "\n\n").text(path))


def parse_medline(blocks: DataFrame, column: str = "value") -> DataFrame:
    joined = F.regexp_replace(F.col(column), r"\r?\n {2,}", " ")
    lines = F.filter(F.split(joined, r"\r?\n"), lambda x: x.rlike("^[A-Z]{2,4} *- "))
    pairs = F.transform(lines, lambda x: F.struct(F.trim(F.substring(x, 1, 4)).alias("k"), F.trim(F.regexp_replace(x, "^[A-Z]{2,4} *- ", "")).alias("v")))
    b = blocks.withColumn("_p", pairs).where("size(_p) > 0")
    every = lambda tag: F.transform(F.filter("_p", lambda x: x["k"] == tag), lambda x: x["v"])
    return b.select(*[F.get(every(t), F.lit(0)).alias(n) for t, n in _SINGLE.items()], *[every(t).alias(n) for t, n in _LISTS.items()])


ANNOTATION = "STRUCT<infons: STRUCT<type: STRING, identifier: STRING, name: STRING, rsid: STRING, normalized: STRING, gene_id: STRING, hgvs: STRING>, text: STRING, locations: ARRAY<STRUCT<offset: INT, length: INT>>>"
DOCUMENT = f"STRUCT<pmid: STRING, id: STRING, _id: STRING, passages: ARRAY<STRUCT<annotations: ARRAY<{ANNOTATION}>>>>"


def documents_of(raw: DataFrame, column: str = "value") -> DataFrame:
    """Documents of three envelope shapes: an array, an object with a list, or one document; pmid from pmid, id or _id before the bar."""
    as_list = F.from_json(column, f"ARRAY<{DOCUMENT}>")
    nested = F.from_json(column, f"STRUCT<PubTator3: ARRAY<{DOCUMENT}>, documents: ARRAY<{DOCUMENT}>>")
    one = F.from_json(column, DOCUMENT)
    text = F.trim(F.col(column))
    docs = F.when(text.startswith("["), as_list).otherwise(F.coalesce(nested["PubTator3"], nested["documents"], F.array(one)))
    d = raw.select(F.explode(docs).alias("d")).select("d.*")
    filled = lambda c: F.nullif(F.trim(c), F.lit(""))
    return d.withColumn("pmid", F.coalesce(filled("pmid"), filled("id"), filled(F.split("_id", r"\|")[0]))).where("pmid IS NOT NULL").select("pmid", "passages")


def annotations(docs: DataFrame) -> DataFrame:
    a = docs.select("pmid", F.explode("passages").alias("p")).select("pmid", F.explode("p.annotations").alias("a"))
    return a.select("pmid", F.lower("a.infons.type").alias("type"), "a.infons", F.col("a.text").alias("text"), F.col("a.locations").alias("locations"))


def ner_genes(docs: DataFrame) -> DataFrame:
    """Genes of each paper by upper-case symbol, with identifier, mentions and locations."""
    g = annotations(docs).where("type = 'gene'").withColumn("symbol", F.upper(F.trim(F.coalesce(F.nullif("infons.name", F.lit("")), "text")))).where("symbol <> ''")
    return g.groupBy("pmid", "symbol").agg(F.min("infons.identifier").alias("gene_id"), F.array_sort(F.array_distinct(F.collect_list("text"))).alias("mentions"), F.array_sort(F.flatten(F.collect_list("locations"))).alias("locations"))


def ner_variants(docs: DataFrame) -> DataFrame:
    v = annotations(docs).where("type IN ('variant', 'mutation', 'dnamutation', 'proteinmutation', 'snp')")
    return v.select("pmid", "text", "type", F.coalesce("infons.rsid", F.nullif(F.regexp_extract(F.coalesce("infons.identifier", F.lit("")), r"(rs\d+)", 1), F.lit(""))).alias("rsid"), F.coalesce("infons.hgvs", "infons.name").alias("hgvs"), F.col("infons.gene_id").alias("gene_id")).distinct()


def read_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """A JSON map symbol -> entry, with old or new field names, as rows in file order."""
    entry = "STRUCT<symbol: STRING, name: STRING, locus_type: STRING, alias_symbol: ARRAY<STRING>, aliases: ARRAY<STRING>, prev_symbol: ARRAY<STRING>, prev_symbols: ARRAY<STRING>>"
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", f"MAP<STRING, {entry}>").alias("m"))
    return lexicon_rows(raw.select(F.posexplode(F.map_entries("m")).alias("ordinal", "e")).select("ordinal", F.col("e.key").alias("key"), "e.value.*"))


def lexicon_rows(entries: DataFrame) -> DataFrame:
    none = F.array().cast("array<string>")
    return entries.select("ordinal", F.upper(F.col("key")).alias("symbol"), F.coalesce("alias_symbol", "aliases", none).alias("alias_symbol"), F.coalesce("prev_symbol", "prev_symbols", none).alias("prev_symbol"), F.coalesce("locus_type", F.lit("unknown")).alias("locus_type"), "name")


def is_stale(snapshot: Column | str, days: int = 365) -> Column:
    return F.datediff(F.current_date(), F.to_date(snapshot)) > days


def journal_ranks(raw: DataFrame) -> DataFrame:
    """issn, name_norm, quartile from rows with Issn (comma list), Title and a quartile column; only Q1 to Q4."""
    r = raw.where(F.col("quartile").isin("Q1", "Q2", "Q3", "Q4"))
    return r.select(F.explode_outer(F.split("issn", r"\s*,\s*")).alias("_i"), journal_key("title").alias("name_norm"), "quartile").select(format_issn("_i").alias("issn"), "name_norm", "quartile")


def read_journal_ranks(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.option("header", True).option("sep", ";").option("quote", '"').csv(path)
    return journal_ranks(raw.select(F.col("Issn").alias("issn"), F.col("Title").alias("title"), F.col("SJR Best Quartile").alias("quartile")))


def read_manifests(spark: SparkSession, path: str, fingerprint: str | None = None, pilots: bool = False) -> DataFrame:
    """Run manifests under a folder, with the file's path; pilots and other corpora are left out."""
    m = spark.read.option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "study_run.json").json(path).withColumn("manifest_path", F.col("_metadata.file_path"))
    if not pilots and "pilot" in m.columns:
        m = m.where(~F.coalesce("pilot", F.lit(False)))
    return m if fingerprint is None else m.where(F.col("corpus_fingerprint") == fingerprint)


def flexible(df: DataFrame, names: tuple[str, ...]) -> Column:
    """The first of some column names that a table has, regardless of case; empty text without one."""
    low = {c.lower(): c for c in df.columns}
    hit = next((low[n.lower()] for n in names if n.lower() in low), None)
    return F.trim(F.coalesce(F.col(f"`{hit}`").cast("string"), F.lit(""))) if hit else F.lit("")


def output_observations(df: DataFrame, run: str = "run_id") -> DataFrame:
    """Per run and paper of output rows: rows, genes, and gene-variant keys of rows that have a variant."""
    o = df.select(run, flexible(df, ("PMID",)).alias("pmid"), F.upper(flexible(df, ("Gene", "Gene/Group", "gene_name"))).alias("g"), F.upper(flexible(df, ("Variant", "Variant Name", "variant_name"))).alias("v")).where("pmid <> ''")
    named = F.col("g") != ""
    return o.groupBy(run, "pmid").agg(F.count("*").alias("rows"), F.array_sort(F.collect_set(F.when(named, F.col("g")))).alias("genes"), F.array_sort(F.collect_set(F.when(named & (F.col("v") != ""), F.concat("g", F.lit("|"), "v")))).alias("gene_variants"))


def replies(spark: SparkSession, path: str, purpose: str) -> DataFrame:
    """Recorded extraction replies (pmid, purpose, payload) of one purpose: the offline form of the extraction service."""
    return spark.read.json(path).where(F.col("purpose") == purpose)


def repaired(text: Column | str) -> list[Column]:
    """Forms of a reply in the order in which they are tried as JSON: as is, without fences, its outermost brackets, with commas mended."""
    t = F.trim(F.col(text) if isinstance(text, str) else text)
    bare = F.trim(F.regexp_replace(F.regexp_replace(t, r"^```(?:json)?\s*", ""), r"\s*```$", ""))
    first = F.regexp_extract(bare, r"(?s)[\[{].*[\]}]", 0)
    mended = F.regexp_replace(F.regexp_replace(first, r",\s*([\]}])", "$1"), r"([}\]])\s*([{\[])", "$1,$2")
    return [t, bare, first, mended]


def parse_json(df: DataFrame, column: str, name: str = "json") -> DataFrame:
    """Adds the first repaired form that is JSON, or null."""
    forms = {f"_f{k}": f for k, f in enumerate(repaired(column))}
    d = df.withColumns(forms)
    return d.withColumn(name, F.coalesce(*[F.when(F.expr(f"try_parse_json({k})").isNotNull(), F.col(k)) for k in forms])).drop(*forms)


def associations(df: DataFrame, column: str = "json") -> DataFrame:
    """Candidate associations of parsed replies, with old or new field names; rows without a gene go."""
    a = "STRUCT<reported_gene: STRING, gene: STRING, reported_variant: STRING, variant: STRING, original_mention: STRING, evidence_sentence: STRING>"
    listed = F.coalesce(F.from_json(column, f"STRUCT<associations: ARRAY<{a}>>")["associations"], F.from_json(column, f"ARRAY<{a}>"))
    r = df.select("*", F.posexplode(listed).alias("position", "a"))
    r = r.withColumns({"label": F.trim(F.coalesce("a.reported_gene", "a.gene", F.lit(""))), "variant": F.coalesce("a.reported_variant", "a.variant", F.lit("")), "mention": F.coalesce("a.original_mention", F.lit("")), "evidence": F.coalesce("a.evidence_sentence", F.lit(""))})
    return r.where("label <> ''").drop("a")


def best_source(sources: list[DataFrame], good: Column, key: str = "pmid") -> DataFrame:
    """Of several sources, in order of preference, the first good row of each key."""
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [s.where(good).withColumn("_priority", F.lit(k)) for k, s in enumerate(sources)])
    rest = [c for c in both.columns if c not in (key, "_priority")]
    return both.groupBy(key).agg(F.min_by(F.struct(*rest), "_priority").alias("r"), F.min("_priority").alias("source_no")).select(key, "source_no", "r.*")
