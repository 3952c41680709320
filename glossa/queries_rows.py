"""Queries on result rows, candidates, views and relational joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text
from .operators import candidates, counters, gates, metadata, output, results_view, screening
from .registry import Registry
from .tables import base, shared_folder, sql_with, table

R = Registry()

_GROUP = "CASE association_type WHEN 'variant_association' THEN 'Primary Genetic Association' WHEN 'animal_model_gene' THEN 'Animal Model Signal' WHEN 'biomarker_gene' THEN 'Biomarker/Response Signal' WHEN 'figure_derived_gene' THEN 'Figure-Derived Signal' ELSE 'Other Candidate Signal' END"
_ROWS = sql_with(["rows_given"], "").rstrip() + " "
_VARIANT = "CASE WHEN variant = 'n/a' THEN '' ELSE variant END"


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "rows_given")


@R.query(_ROWS + f"""SELECT pmid, upper(trim(gene)) AS gene_key, {_VARIANT} AS variant, array_to_string(list_sort(list(DISTINCT source)), ',') AS sources, CAST(count(*) AS BIGINT) AS n
FROM rows_given WHERE trim(gene) <> '' GROUP BY pmid, upper(trim(gene)), {_VARIANT}""")
def candidate_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Associations of several sources merged with their provenance."""
    r = _rows(spark, sf_dir).select("pmid", "position", "source", "gene", F.col("gene").alias("label"), "variant", F.lit("").alias("mention"), F.coalesce("quote", F.lit("")).alias("evidence"))
    merged = candidates.merge(r).select("pmid", text.gene_key("gene").alias("gene_key"), "variant", F.array_join("sources", ",").alias("sources"))
    counts = r.where(text.gene_key("gene") != "").groupBy("pmid", text.gene_key("gene").alias("gene_key"), text.normalize_variant("gene", "variant").alias("variant")).agg(F.count("*").alias("n"))
    return merged.join(counts, ["pmid", "gene_key", "variant"])


@R.query(_ROWS + f"""SELECT source, CAST(count(*) AS BIGINT) AS n FROM (SELECT DISTINCT pmid, upper(trim(gene)), {_VARIANT}, source FROM rows_given WHERE trim(gene) <> '') GROUP BY source""")
def source_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of each source."""
    r = _rows(spark, sf_dir).select("pmid", "position", "source", "gene", F.col("gene").alias("label"), "variant", F.lit("").alias("mention"), F.lit("").alias("evidence"))
    return candidates.source_counts(candidates.merge(r))


@R.query(_ROWS + f"""SELECT pmid, gene_key, v AS variant, coalesce(min_by(f, position) FILTER (f <> ''), '') AS finding, coalesce(min_by(q, position) FILTER (q <> ''), '') AS quote, min(position) AS position FROM
(SELECT pmid, upper(trim(gene)) AS gene_key, {_VARIANT} AS v, trim(finding) AS f, trim(quote) AS q, position FROM rows_given) GROUP BY pmid, gene_key, v""")
def duplicate_rows_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first non-empty value of each field over rows of one gene and variant."""
    m = output.merge_duplicates(_rows(spark, sf_dir), ["finding", "quote"], ["pmid"])
    return m.select("pmid", text.gene_key("gene").alias("gene_key"), "variant", "finding", "quote", "position")


@R.query(_ROWS + """SELECT pmid, gene, finding, quote, array_to_string(list_sort(list(DISTINCT variant)), '; ') AS variant, min(position) AS position FROM rows_given WHERE trim(gene) <> '' GROUP BY pmid, gene, finding, quote
UNION ALL SELECT pmid, gene, finding, quote, variant, position FROM rows_given WHERE trim(gene) = ''""")
def variants_aggregated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variants of rows that agree otherwise; null fields are a group."""
    r = _rows(spark, sf_dir).select("pmid", "gene", "finding", "quote", "variant", "position")
    return output.aggregate_variants(r, ["pmid", "gene", "finding", "quote"]).select("pmid", "gene", "finding", "quote", "variant", "position")


def _gated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(spark, sf_dir).withColumnsRenamed({"finding": "Finding", "quote": "Finding Citation", "quote_valid": "Finding_citation_valid"}).withColumn("sources", F.array_compact(F.array(F.nullif("source", F.lit("")))))


_GATES = """, g AS (SELECT *, CASE WHEN trim(coalesce(quote, '')) <> '' AND NOT quote_valid THEN 'ungrounded_citation' WHEN validation_confidence < 0.7 THEN 'low_validation_confidence'
  WHEN (trim(coalesce(finding, '')) <> '')::INT + (trim(coalesce(quote, '')) <> '')::INT < CASE WHEN source LIKE 'llm%' THEN 0 ELSE 1 END THEN 'insufficient_user_evidence' ELSE 'kept' END AS reason FROM rows_given) """
_WITH_GATES = sql_with(["rows_given"], "").rstrip() + _GATES


@R.query(_WITH_GATES + "SELECT doc_id, reason FROM g")
def gates_applied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which gate drops each row."""
    kept, gone = gates.all_gates(_gated(spark, sf_dir), ["Finding"])
    return kept.select("doc_id", F.lit("kept").alias("reason")).unionByName(gone.select("doc_id", "reason"))


@R.query(_WITH_GATES + "SELECT reason, CAST(count(*) AS BIGINT) AS n FROM g WHERE reason <> 'kept' GROUP BY reason")
def gate_drops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A10: dropped rows by reason."""
    return gates.all_gates(_gated(spark, sf_dir), ["Finding"])[1].groupBy("reason").agg(F.count("*").alias("n"))


@R.query(_WITH_GATES + """, k AS (SELECT *, error <> '' AS quota FROM g)
SELECT unnest(['rows', 'papers', 'genes', 'quota_rows', 'quota_papers', 'kept', 'ungrounded_citation', 'low_validation_confidence', 'insufficient_user_evidence']) AS counter, unnest([count(*), count(DISTINCT pmid), count(DISTINCT CASE WHEN trim(gene) <> '' THEN pmid || '|' || upper(trim(gene)) END), count(*) FILTER (quota), count(DISTINCT CASE WHEN quota THEN pmid END), count(*) FILTER (reason = 'kept'),
  count(*) FILTER (reason = 'ungrounded_citation'), count(*) FILTER (reason = 'low_validation_confidence'), count(*) FILTER (reason = 'insufficient_user_evidence')]) AS n FROM k""")
def gates_counted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run's counters, observed while its rows are written."""
    rows = counters.judged(_gated(spark, sf_dir), ["Finding"])
    told = counters.write_counted(rows, shared_folder(spark, "judged"), ("ungrounded_citation", "low_validation_confidence", "insufficient_user_evidence"), quota=F.col("error") != "")
    return spark.createDataFrame([*told.items()], "counter string, n long")


_CONFIDENCE = """, c AS (SELECT *, CASE WHEN trim(gene) = '' THEN 'REVIEW' WHEN extraction_mode = 'skeleton' THEN 'REVIEW' WHEN source = 'llm_figure' THEN 'REVIEW' WHEN NOT quote_valid THEN 'REVIEW' WHEN validation_confidence < 0.85 THEN 'LOW'
  WHEN gene_source = 'both' AND quote_valid THEN 'HIGH' ELSE 'MEDIUM' END AS confidence,
  CASE WHEN trim(gene) = '' THEN 'No genes extracted' WHEN extraction_mode = 'skeleton' THEN 'LLM failed; no content' || CASE WHEN error <> '' THEN ' (' || error || ')' ELSE '' END
  WHEN source = 'llm_figure' THEN 'Figure-only gene — no prose citation available' WHEN NOT quote_valid THEN 'Citation text not found in paper' WHEN validation_confidence < 0.85 THEN 'Low confidence' ELSE '' END AS note FROM rows_given) """
_WITH_CONFIDENCE = sql_with(["rows_given"], "").rstrip() + _CONFIDENCE


def _confident(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _gated(spark, sf_dir).withColumnsRenamed({"gene": "Gene/Group", "source": "Candidate Source", "gene_source": "Gene Source", "error": "detail_extraction_error"})
    return gates.row_confidence(r, ["Finding"])


@R.query(_WITH_CONFIDENCE + "SELECT doc_id, confidence, note FROM c")
def row_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confidence level and note of every row."""
    return _confident(spark, sf_dir).select("doc_id", F.col("Confidence").alias("confidence"), F.col("Confidence Note").alias("note"))


@R.query(_WITH_CONFIDENCE + "SELECT confidence, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT nullif(gene, '')) AS BIGINT) AS genes FROM c GROUP BY confidence")
def confidence_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and distinct genes by confidence."""
    return _confident(spark, sf_dir).groupBy(F.col("Confidence").alias("confidence")).agg(F.count("*").alias("n"), F.countDistinct(F.nullif("`Gene/Group`", F.lit(""))).alias("genes"))


@R.query(_ROWS + f"SELECT {_GROUP} AS association_group, CAST(count(*) AS BIGINT) AS n FROM rows_given GROUP BY 1")
def association_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each association group."""
    return candidates.group_counts(_rows(spark, sf_dir).withColumn("association_group", F.lit("")))


@R.query(_ROWS + """SELECT doc_id, CASE WHEN variant NOT IN ('', 'n/a') THEN 'variant_association' WHEN source = 'llm_figure' THEN 'figure_derived_gene' WHEN source = 'pubtator' THEN 'pubtator_supported_gene'
  WHEN source = 'deterministic_lexicon' THEN 'deterministic_candidate' WHEN source = 'llm_text' THEN 'llm_supported_gene' ELSE 'candidate_gene' END AS candidate_type,
  CASE WHEN association_type IN ('variant_association', 'figure_derived_gene') THEN association_type WHEN finding = 'finding 1' THEN 'biomarker_response_gene' ELSE association_type END AS row_type FROM rows_given""")
def association_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """types of candidates and of rows."""
    r = _rows(spark, sf_dir).withColumn("sources", F.array_compact(F.array(F.nullif("source", F.lit("")))))
    said = F.when(F.col("finding") == "finding 1", "Serum level rose").otherwise(F.col("finding"))
    kind = candidates.candidate_type(F.col("sources"), text.normalize_variant("gene", "variant"), F.lit(""))
    return r.select("doc_id", kind.alias("candidate_type"), candidates.row_type(F.col("association_type"), said, kind).alias("row_type"))


@R.query(_ROWS + f"""SELECT pmid, CAST(count(*) AS BIGINT) AS emitted_rows, CAST(count(*) FILTER (trim(gene) <> '') AS BIGINT) AS associations,
  CAST(count(*) FILTER (trim(gene) <> '' AND {_GROUP} = 'Primary Genetic Association') AS BIGINT) AS primary_rows FROM rows_given GROUP BY pmid""")
def emitted_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Emitted rows and groups of each paper."""
    s = output.emitted_summary(_rows(spark, sf_dir).withColumn("association_group", F.lit("")))
    return s.select("pmid", "emitted_rows", "associations", F.coalesce(F.try_element_at("group_counts", F.lit("Primary Genetic Association")), F.lit(0)).cast("long").alias("primary_rows"))


@R.query(sql_with(["rows_given"], """, p AS (SELECT DISTINCT CAST(doc_id % 120 AS STRING) AS pmid, CAST(doc_id % 120 % 7 AS BIGINT) AS candidate_count FROM documents), e AS (SELECT pmid, count(*) AS n, count(*) FILTER (trim(gene) <> '') AS a FROM rows_given GROUP BY pmid)
SELECT CAST(count(*) AS BIGINT) AS papers, CAST(sum(candidate_count) AS BIGINT) AS total_candidates, CAST(sum(coalesce(n, 9)) AS BIGINT) AS total_emitted_rows, CAST(sum(coalesce(a, 0)) AS BIGINT) AS total_associations FROM p LEFT JOIN e USING (pmid)""").replace(") , p", "), p"))
def audit_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit's totals; what was emitted wins over what a paper reports."""
    p = base(spark, sf_dir, "documents").select((F.col("doc_id") % 120).cast("string").alias("pmid"), (F.col("doc_id") % 120 % 7).alias("candidate_count"), F.lit(9).cast("long").alias("emitted_rows")).distinct()
    return output.audit_summary(output.candidate_audit(p, _rows(spark, sf_dir).withColumn("association_group", F.lit(""))))


_SORTED = f"""SELECT doc_id, CAST(row_number() OVER (ORDER BY CASE {_GROUP} WHEN 'Primary Genetic Association' THEN 0 WHEN 'Biomarker/Response Signal' THEN 1 WHEN 'Animal Model Signal' THEN 3 WHEN 'Figure-Derived Signal' THEN 4 ELSE 5 END, confidence, pmid, gene, doc_id) AS BIGINT) AS row_id FROM c"""


@R.query(_WITH_CONFIDENCE + _SORTED)
def final_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order that both outputs share."""
    from .operators.ordering import with_ordinal

    r = output.with_group(_confident(spark, sf_dir).withColumnsRenamed({"pmid": "PMID", "association_type": "Association Type"}))
    return with_ordinal(r, [*output.final_order(), F.col("doc_id")], "row_id").select("doc_id", F.col("row_id").cast("long").alias("row_id"))


@R.query(_ROWS + """SELECT doc_id FROM rows_given WHERE contains(lower(concat_ws(chr(1), pmid, gene, variant, coalesce(finding, ''), coalesce(quote, ''))), 'tp53')""")
def any_cell_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with a text in any cell."""
    r = _rows(spark, sf_dir)
    return results_view.any_cell_contains(r, "TP53", ["pmid", "gene", "variant", "finding", "quote"]).select("doc_id")


@R.query("""SELECT p_partkey, CAST(row_number() OVER (ORDER BY CASE WHEN p_partkey % 3 = 0 THEN p_size END ASC NULLS LAST, lower(CASE WHEN p_partkey % 3 = 0 THEN CAST(p_size AS STRING) || 'mm' ELSE p_name END), p_partkey) AS BIGINT) AS position FROM part""")
def view_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers before texts."""
    from .operators.ordering import with_ordinal

    p = base(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_partkey") % 3 == 0, F.concat(F.col("p_size").cast("string"), F.lit("mm"))).otherwise(F.col("p_name")).alias("cell"))
    return with_ordinal(p, [*results_view.numeric_first("cell"), F.col("p_partkey")]).select("p_partkey", F.col("position").cast("long").alias("position"))


@R.query("""SELECT o_orderkey, o_orderpriority FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 50""")
def paged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The third page of orders by price."""
    return screening.page(base(spark, sf_dir, "orders"), [F.desc("o_totalprice"), F.col("o_orderkey")], 3).select("o_orderkey", "o_orderpriority")


@R.query(_ROWS + """SELECT doc_id, extraction_mode = 'skeleton' AND (contains(error, '429') OR contains(error, 'RESOURCE_EXHAUSTED') OR contains(lower(error), 'quota')) AS quota_row,
  CASE WHEN error = '' THEN 'none' ELSE 'rate_limit' END AS error_class FROM rows_given""")
def quota_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quota rows and error classes."""
    from .operators.events import error_class

    r = _rows(spark, sf_dir).withColumnRenamed("error", "detail_extraction_error")
    return r.select("doc_id", results_view.is_quota_row().alias("quota_row"), error_class("detail_extraction_error").alias("error_class"))


_STAR = """SELECT c.c_custkey, coalesce(n.n_name, 'none') AS nation, coalesce(r.r_name, 'none') AS region, CAST(coalesce(o.n, 0) AS BIGINT) AS n_orders, round(coalesce(o.spent, 0), 2) AS spent
FROM customer c LEFT JOIN (SELECT o_custkey, count(*) AS n, sum(o_totalprice) AS spent FROM orders GROUP BY o_custkey) o ON c.c_custkey = o.o_custkey
LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey LEFT JOIN region r ON n.n_regionkey = r.r_regionkey"""


@R.query(_STAR)
def star_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A star of left joins with default values; facts are aggregated before they meet the dimension."""
    o = base(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n_orders"), F.sum("o_totalprice").alias("spent"))
    c = metadata.with_defaults(base(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), o, "c_custkey", {"n_orders": 0, "spent": 0.0})
    n = base(spark, sf_dir, "nation").join(base(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("nation"), F.col("r_name").alias("region"))
    return metadata.with_defaults(c, n, "c_nationkey", {"nation": "none", "region": "none"}).select("c_custkey", "nation", "region", F.col("n_orders").cast("long").alias("n_orders"), F.round("spent", 2).alias("spent"))


@R.query("""SELECT c_custkey, c_mktsegment FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey)""")
def missing_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was asked for and not found."""
    return metadata.missing(base(spark, sf_dir, "customer"), base(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey").select("c_custkey", "c_mktsegment")


@R.query("""SELECT coalesce(a.k, b.k) AS k, CAST(coalesce(a.n, 0) AS BIGINT) AS suppliers, CAST(coalesce(b.n, 0) AS BIGINT) AS customers FROM (SELECT s_nationkey AS k, count(*) AS n FROM supplier WHERE s_acctbal > 0 GROUP BY 1) a
FULL JOIN (SELECT c_nationkey AS k, count(*) AS n FROM customer WHERE c_acctbal > 9000 GROUP BY 1) b ON a.k = b.k""")
def full_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of either side."""
    a = base(spark, sf_dir, "supplier").where("s_acctbal > 0").groupBy(F.col("s_nationkey").alias("k")).agg(F.count("*").alias("suppliers"))
    b = base(spark, sf_dir, "customer").where("c_acctbal > 9000").groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("customers"))
    return a.join(b, "k", "full").select("k", F.coalesce("suppliers", F.lit(0)).cast("long").alias("suppliers"), F.coalesce("customers", F.lit(0)).cast("long").alias("customers"))


@R.query("""SELECT o_custkey, max_by(o_orderkey, struct_pack(d := o_orderdate, k := o_orderkey)) AS last_order, min_by(o_orderkey, struct_pack(d := o_orderdate, k := o_orderkey)) AS first_order FROM orders GROUP BY o_custkey""")
def first_and_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First-wins and last-wins of each key, without a sort of its rows."""
    at = F.struct("o_orderdate", "o_orderkey")
    return base(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max_by("o_orderkey", at).alias("last_order"), F.min_by("o_orderkey", at).alias("first_order"))


@R.query("""WITH s AS (SELECT l_suppkey AS k, list(DISTINCT l_returnflag) AS a, list(DISTINCT l_linestatus || CASE WHEN l_quantity > 45 THEN 'A' ELSE '' END) AS b FROM lineitem GROUP BY l_suppkey)
SELECT k, array_to_string(list_sort(list_distinct(a || b)), ',') AS all_genes, array_to_string(list_sort(list_intersect(a, b)), ',') AS both, array_to_string(list_sort(list_filter(a, lambda x: NOT list_contains(b, x))), ',') AS only_ner,
  array_to_string(list_sort(list_filter(b, lambda x: NOT list_contains(a, x))), ',') AS only_llm FROM s""")
def hybrid_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Union, overlap and differences of two sets."""
    flag = F.concat("l_linestatus", F.when(F.col("l_quantity") > 45, "A").otherwise(""))
    s = base(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("k")).agg(F.collect_set("l_returnflag").alias("a"), F.collect_set(flag).alias("b"))
    return s.select("k", *[F.array_join(c, ",").alias(n) for n, c in candidates.source_sets(F.col("a"), F.col("b")).items()])


@R.query(_ROWS + """SELECT pmid, gene, variant FROM (SELECT DISTINCT pmid, gene, variant FROM rows_given WHERE variant <> 'n/a' AND gene <> '') UNION
SELECT DISTINCT pmid, gene, '' FROM rows_given WHERE variant <> 'n/a' AND gene <> ''""")
def gene_level_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Genes of which only variants are there get a gene-level row."""
    c = _rows(spark, sf_dir).where("variant <> 'n/a' AND gene <> ''").select("pmid", "gene", "variant").distinct()
    return candidates.with_gene_level(c)


@R.query(_ROWS + """SELECT pmid, gene, CAST(count(DISTINCT variant) FILTER (variant <> 'n/a') AS BIGINT) AS n_variants, CAST(count(DISTINCT doc_id) AS BIGINT) AS n_rows FROM rows_given WHERE gene <> '' GROUP BY pmid, gene HAVING count(DISTINCT variant) FILTER (variant <> 'n/a') = 1""")
def single_variant_genes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Genes of a paper with exactly one variant."""
    g = _rows(spark, sf_dir).where("gene <> ''").groupBy("pmid", "gene").agg(F.countDistinct(F.when(F.col("variant") != "n/a", F.col("variant"))).alias("n_variants"), F.countDistinct("doc_id").alias("n_rows"))
    return g.where("n_variants = 1")


@R.query(_ROWS.rstrip() + """, a AS (SELECT pmid, upper(trim(gene)) AS g FROM rows_given WHERE trim(gene) <> '' GROUP BY 1, 2) SELECT x.pmid, x.g AS gene, array_to_string(list_sort(list(y.g)), ',') AS peers FROM a x JOIN a y ON x.pmid = y.pmid AND x.g <> y.g GROUP BY x.pmid, x.g""".replace(", a AS", ", a AS"))
def peers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Other genes of the same paper, from one list a paper."""
    g = _rows(spark, sf_dir).select("pmid", text.gene_key("gene").alias("gene")).where("gene <> ''").distinct()
    every = g.groupBy("pmid").agg(F.collect_set("gene").alias("_all"))
    return g.join(every, "pmid").withColumn("peers", F.array_join(F.array_sort(F.array_remove("_all", F.col("gene"))), ",")).where("peers <> ''").select("pmid", "gene", "peers")


@R.query(_ROWS + "SELECT doc_id, CASE WHEN finding = 'finding 0' THEN '' ELSE trim(finding) END AS value, coalesce(try_cast(nullif(regexp_extract(variant, '\\d+', 0), '') AS DOUBLE), 0) AS number FROM rows_given")
def placeholders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """placeholders and safe numbers."""
    said = F.when(F.col("finding") == "finding 0", " No Evidence ").otherwise(F.col("finding"))
    return _rows(spark, sf_dir).select("doc_id", text.normalize_placeholder(said).alias("value"), text.safe_number(F.nullif(F.regexp_extract("variant", r"\d+", 0), F.lit(""))).alias("number"))


QUERIES, ORACLE_SQL = R.queries, R.sql
