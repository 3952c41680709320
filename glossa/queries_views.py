"""Queries on views, names and labels of results, each worked out from values of the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import scoring, text
from .operators import events, output, reports, results_view, screening
from .operators.ordering import with_ordinal
from .registry import Registry
from .sources import search
from .tables import base

R = Registry()


@R.query("SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT'")
def rows_of_a_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of one group of the results view."""
    o = base(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderpriority").alias("Association Group"))
    both = results_view.in_group(results_view.in_group(o, "All"), "1-URGENT")
    return both.select("o_orderkey")


@R.query("""SELECT p_partkey, CAST(row_number() OVER (ORDER BY lpad(CAST(p_size AS VARCHAR), 12, '0') || ' ' || lower(p_name), p_partkey) AS BIGINT) AS position FROM part""")
def names_in_natural_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts in which numbers sort by their value."""
    p = base(spark, sf_dir, "part").select("p_partkey", F.concat(F.col("p_size").cast("string"), F.lit(" "), F.col("p_name")).alias("cell"))
    return with_ordinal(p, [*results_view.natural("cell"), F.col("p_partkey")]).select("p_partkey", F.col("position").cast("long").alias("position"))


@R.query("""WITH s AS (SELECT user_id, event_id, event_type FROM events), n AS (SELECT user_id, min(event_id) AS position FROM s GROUP BY 1), t AS (SELECT user_id FROM n ORDER BY position, user_id LIMIT 20)
SELECT event_id, event_type FROM s WHERE user_id IN (SELECT user_id FROM t)""")
def rows_of_first_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the first papers that have rows."""
    e = base(spark, sf_dir, "events").select(F.col("user_id").alias("pmid"), "event_id", "event_type")
    first = e.groupBy("pmid").agg(F.min("event_id").alias("position"))
    rows = e.join(first, "pmid")
    return screening.top_papers(rows, 20, [F.col("position"), F.col("pmid")]).select("event_id", "event_type")


@R.query("SELECT event_id, event_type FROM events WHERE event_type IN ('error', 'click')")
def log_levels_shown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P25: log lines of the levels that are shown."""
    e = base(spark, sf_dir, "events").withColumn("level", F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "click", "warn").otherwise("debug"))
    return events.shown_levels(e).select("event_id", "event_type")


@R.query("""SELECT 0 AS view, bool_and(l_returnflag = 'R') OR bool_and(l_linestatus = 'O') AS metadata_only FROM lineitem UNION ALL SELECT 1, bool_and(l_quantity > 0) FROM lineitem""")
def metadata_only_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a result has metadata only: here of line items as rows, once by their status and once by their quantity."""
    li = base(spark, sf_dir, "lineitem")
    by_status = results_view.metadata_only(li.select(F.when(F.col("l_returnflag") == "R", " ").otherwise("G").alias("gene"), F.when(F.col("l_linestatus") == "O", "metadata_only").otherwise("llm").alias("extraction_mode")))
    by_quantity = results_view.metadata_only(li.select(F.lit("G").alias("gene"), F.when(F.col("l_quantity") > 0, "metadata_only").otherwise("llm").alias("extraction_mode")))
    return by_status.select(F.lit(0).alias("view"), "metadata_only").unionByName(by_quantity.select(F.lit(1).alias("view"), "metadata_only"))


@R.query("""SELECT n_nationkey, n_name AS "Gene/Group", lower(n_name) AS "User: Gene/Group", CAST(n_regionkey AS VARCHAR) AS "Gene/Group (2)" FROM nation""")
def columns_made_safe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User columns that meet reserved names get other ones, and repeated names a number."""
    n = base(spark, sf_dir, "nation")
    asked = output.safe_user_columns({" Gene/Group ": "a name", "": "nothing"}, ["Gene/Group"])
    wide = n.select(F.col("n_nationkey"), F.col("n_name"), F.lower("n_name"), F.col("n_regionkey").cast("string"))
    return output.with_unique_columns(wide.toDF("n_nationkey", "Gene/Group", *asked, "Gene/Group"))


@R.query("""SELECT upper(trim(n_name)) AS gene, upper(trim(r_name)) AS variant, CAST(count(*) AS BIGINT) AS n FROM nation JOIN region ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey GROUP BY 1, 2""")
def associations_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rows of one association, by its key."""
    named = base(spark, sf_dir, "nation").join(base(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).join(base(spark, sf_dir, "customer"), F.col("c_nationkey") == F.col("n_nationkey"))
    keyed = named.select(text.association_key(F.concat(F.lit(" "), F.lower("n_name")), F.initcap("r_name")).alias("k"))
    return keyed.groupBy("k").agg(F.count("*").alias("n")).select("k.gene", "k.variant", "n")


@R.query("""SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'quoted ' || p_name WHEN 1 THEN 'plain ' || p_name WHEN 2 THEN 'boxed ' || p_name || ' here' WHEN 3 THEN 'a long quote of ' || p_name ELSE '' END AS citation FROM part""")
def citations_taken_from_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F32: the citation in a reply, by four patterns in order."""
    k, name = F.col("p_partkey") % 5, F.col("p_name")
    reply = F.when(k == 0, F.concat(F.lit('Citation: "quoted '), name, F.lit('" and more'))).when(k == 1, F.concat(F.lit("x\ncitation: plain "), name, F.lit("\nend"))).when(k == 2, F.concat(F.lit("[Citation:boxed "), name, F.lit(" here]")))
    reply = reply.when(k == 3, F.concat(F.lit('he said "a long quote of '), name, F.lit('"'))).otherwise(F.lit('Citation: "short"'))
    # The second pattern would take a boxed one with its bracket.
    cited = text.quoted_citation(reply)
    return base(spark, sf_dir, "part").select("p_partkey", F.rtrim(cited, F.lit("]")).alias("citation"))


@R.query("""WITH t AS (SELECT n_regionkey, n_nationkey, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS k, n_name FROM nation), r AS (SELECT s_nationkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS k, s_name || ' | ' || CAST(s_suppkey AS VARCHAR) AS line FROM supplier),
x AS (SELECT t.n_regionkey, t.k, n_name || chr(10) || coalesce((SELECT string_agg(line, chr(10) ORDER BY r.k) FROM r WHERE r.s_nationkey = t.n_nationkey AND r.k <= 3), '') AS shown FROM t WHERE t.k <= 2)
SELECT n_regionkey, string_agg(shown, chr(10) || chr(10) ORDER BY k) AS prompt FROM x GROUP BY 1""")
def tables_as_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tables as text, both tables and rows capped: here a table of suppliers for each nation of a region."""
    s = base(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.transform(F.array_sort(F.collect_list(F.struct("s_suppkey", "s_name"))), lambda x: F.array(x["s_name"], x["s_suppkey"].cast("string"))).alias("rows"))
    none = F.array().cast("array<array<string>>")
    t = base(spark, sf_dir, "nation").join(s, "n_nationkey", "left").groupBy("n_regionkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", F.col("n_name").alias("label"), F.coalesce("rows", none).alias("rows")))), lambda x: F.struct(x["label"].alias("label"), x["rows"].alias("rows"))).alias("tables"))
    return t.select("n_regionkey", reports.table_prompt(F.col("tables"), 2, 3).alias("prompt"))


@R.query("""SELECT p_partkey, CASE WHEN p_brand = 'Brand#1' THEN 'review_type' WHEN p_size IS NULL THEN 'unscored' WHEN p_size <= 10 THEN 'no_genetic_content' WHEN p_name LIKE 'red%' THEN 'no_gene_symbols' WHEN p_partkey % 2 = 0 THEN 'no_molecular_context' ELSE 'weak_signal' END AS reason FROM part""")
def weak_papers_explained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """why a paper looks weak."""
    types = F.when(F.col("p_brand") == "Brand#1", F.array(F.lit("Review"), F.lit("X"))).otherwise(F.array("p_type"))
    symbols = F.when(F.col("p_name").startswith("red"), F.array().cast("array<string>")).otherwise(F.array("p_name"))
    return base(spark, sf_dir, "part").select("p_partkey", scoring.low_relevance_reason(types, F.col("p_size") - 10, symbols, F.col("p_partkey") % 2 != 0).alias("reason"))


@R.query("""SELECT DISTINCT o_custkey AS pmid FROM orders WHERE o_orderpriority = '1-URGENT' AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '2-HIGH')""")
def papers_added(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What has been selected since a selection was restored."""
    o = base(spark, sf_dir, "orders").select(F.col("o_custkey").alias("pmid"), "o_orderpriority")
    picked = lambda p: o.where(F.col("o_orderpriority") == p).select("pmid").distinct()
    return reports.added_since(picked("1-URGENT"), picked("2-HIGH"))


@R.query("""WITH b AS (SELECT o_custkey AS pmid, CAST(count(*) AS BIGINT) AS n FROM orders WHERE o_orderstatus = 'O' GROUP BY 1), s AS (SELECT o_custkey AS pmid, CAST(count(*) AS BIGINT) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1)
SELECT c_custkey AS pmid, coalesce(b.n, s.n, 0) AS count FROM customer LEFT JOIN b ON b.pmid = c_custkey LEFT JOIN s ON s.pmid = c_custkey""")
def citations_in_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of a batch call, else of single calls, else 0."""
    o = base(spark, sf_dir, "orders")
    counts = lambda s: o.where(F.col("o_orderstatus") == s).groupBy(F.col("o_custkey").alias("pmid")).agg(F.count("*").alias("count"))
    return search.citation_batch(counts("O"), counts("F"), base(spark, sf_dir, "customer").select(F.col("c_custkey").alias("pmid")))


QUERIES, ORACLE_SQL = R.queries, R.sql
