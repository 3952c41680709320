"""Queries on sources and sinks of the library's own: landed replies, published files, workbooks, supplements, manifests."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .operators import runs
from .registry import Registry
from .sources import landed, manifests, markup, published, supplements
from .tables import base, shared_folder

R = Registry()

#: The id whose reply is cut off, so that its batch fails.
_BROKEN_ID = 57


@R.query(f"""WITH broken AS (SELECT doc_id // {landed.BATCH_IDS} AS b FROM documents WHERE doc_id = {_BROKEN_ID})
SELECT doc_id AS pmid, 'Study ' || doc_id AS title, CAST(1990 + doc_id % 35 AS INT) AS year, lang AS journal, CAST(NULL AS BIGINT) AS failed FROM documents WHERE doc_id >= 20 AND 1990 + doc_id % 35 >= 2000 AND doc_id // {landed.BATCH_IDS} NOT IN (SELECT b FROM broken)
UNION ALL SELECT NULL, NULL, NULL, CAST(b * {landed.BATCH_IDS} AS VARCHAR), 1 FROM broken""")
def literature_fetched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies landed in batches of 50 ids, read through a data source with pushed filters; one failed batch is tolerated and reported."""
    where = shared_folder(spark, "landed")
    n = F.col("doc_id")
    papers = base(spark, sf_dir, "documents").select(n.alias("pmid"), F.concat(F.lit("Study "), n.cast("string")).alias("title"), F.substring("text", 1, 200).alias("abstract"), F.col("lang").alias("journal"), (1990 + n % 35).cast("int").alias("year"))
    landed.land(papers, where, cut=F.col("pmid") == _BROKEN_ID)
    replies = landed.fetched(spark, where)
    found = replies.where("pmid >= 20 AND year >= 2000").select("pmid", "title", "year", "journal", F.lit(None).cast("long").alias("failed"))
    told = landed.failures(landed.fetched(spark, where)).where("failed > 0")
    return found.unionByName(told.select(F.lit(None).cast("long").alias("pmid"), F.lit(None).cast("string").alias("title"), F.lit(None).cast("int").alias("year"), F.array_join("batches", ",").alias("journal"), "failed"))


@R.query("""SELECT strftime(ts, '%Y-%m-%d') AS run, event_type AS kind, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids, CAST(count(DISTINCT event_id % 2) AS BIGINT) AS commits FROM events GROUP BY 1, 2""")
def run_logs_published(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log lines of runs, written by tasks and published in two commits, read back."""
    where = shared_folder(spark, "logs")
    e = base(spark, sf_dir, "events").select("event_id", F.to_json(F.struct(F.date_format("ts", "yyyy-MM-dd").alias("run"), F.col("event_type").alias("kind"), F.col("event_id").alias("id"))).alias("value"))
    for part in (0, 1):
        published.publish(e.where(F.col("event_id") % 2 == part).select("value"), where)
    lines = spark.read.option("recursiveFileLookup", True).text(where).select(F.from_json("value", "run string, kind string, id long").alias("r"), F.regexp_extract(F.col("_metadata.file_path"), "commit-([0-9a-f]+)", 1).alias("commit"))
    return lines.groupBy("r.run", "r.kind").agg(F.count("*").alias("n"), F.sum("r.id").alias("ids"), F.count_distinct("commit").alias("commits"))


@R.query(f"""WITH rows AS (
  SELECT CAST(s_nationkey AS VARCHAR) AS book, 'suppliers' AS sheet, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS r, s_name || '|' || CAST(s_suppkey AS VARCHAR) AS cells FROM supplier
  UNION ALL SELECT CAST(c_nationkey AS VARCHAR), 'customers', row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey), c_name || '|' || c_mktsegment || ' & <' || CAST(c_custkey AS VARCHAR) || '>' FROM customer)
SELECT book, sheet, CAST(r AS INT) AS row, cells FROM rows WHERE r <= {supplements.ROWS}""")
def workbooks_published(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A workbook for each nation with two sheets, written by tasks, published together and read back as supplements."""
    where = shared_folder(spark, "books")

    def sheet(table: str, nation: str, key: str, no: int, name: str, cells: list) -> DataFrame:
        t = base(spark, sf_dir, table)
        row = F.row_number().over(Window.partitionBy(nation).orderBy(key))
        return t.select(F.col(nation).cast("string").alias("book"), F.lit(no).alias("sheet_no"), F.lit(name).alias("sheet"), row.alias("row"), F.array(*cells).alias("cells"))

    s = sheet("supplier", "s_nationkey", "s_suppkey", 1, "suppliers", [F.col("s_name"), F.col("s_suppkey").cast("string")])
    c = sheet("customer", "c_nationkey", "c_custkey", 2, "customers", [F.col("c_name"), F.concat("c_mktsegment", F.lit(" & <"), F.col("c_custkey").cast("string"), F.lit(">"))])
    published.workbooks(s.unionByName(c), where)
    rows = supplements.read_supplements(spark, where, r"([^/]+)\.xlsx$")
    return rows.select(F.col("paper").alias("book"), "sheet", "row", F.array_join("cells", "|").alias("cells"))


@F.pandas_udf(T.BinaryType())
def _zipped(members: pd.Series) -> pd.Series:
    """Archives of members (name, body)."""

    def one(own) -> bytes:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for m in own:
                z.writestr(m["name"], m["body"])
        return out.getvalue()

    return members.map(one)


_PARTS = "SELECT p_partkey // 20 AS paper, p_partkey % 20 AS i, p_name, CAST(p_size AS VARCHAR) AS p_size FROM part"


@R.query(f"""WITH p AS ({_PARTS}), c AS (SELECT paper, row_number() OVER (PARTITION BY paper ORDER BY i) AS r, row_number() OVER (PARTITION BY paper, i // 5 ORDER BY i) AS rm, i // 5 AS m, p_name || ', "x"|' || p_size AS cells, p_name || '|' || p_size AS plain FROM p)
SELECT CAST(paper AS VARCHAR) AS paper, 'csv' AS kind, NULL AS member, 1 AS row, 'name|size' AS cells, NULL AS reason FROM p GROUP BY paper
UNION ALL SELECT CAST(paper AS VARCHAR), 'csv', NULL, r + 1, cells, NULL FROM c
UNION ALL SELECT CAST(paper AS VARCHAR), 'zip', 'm' || m || '.tsv', rm, plain, NULL FROM c WHERE m < {supplements.MEMBERS}
UNION ALL SELECT DISTINCT CAST(paper AS VARCHAR), 'xlsx', NULL, NULL, NULL, 'BadZipFile' FROM p WHERE paper % 2 = 0
UNION ALL SELECT DISTINCT CAST(paper AS VARCHAR), 'pdf', NULL, NULL, NULL, 'ValueError' FROM p WHERE paper % 3 = 0""")
def supplements_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delimited files and archives of each paper as rows, by a table function; broken files and those without tables are rows with a reason."""
    where = shared_folder(spark, "supplements")
    k = F.col("p_partkey")
    p = base(spark, sf_dir, "part").select(F.expr("cast(p_partkey div 20 as string)").alias("paper"), (k % 20).alias("i"), "p_name", F.col("p_size").cast("string").alias("p_size"))
    said = F.concat(F.lit('"'), F.col("p_name"), F.lit(', ""x""",'), F.col("p_size"))
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", said.alias("s")))), lambda x: x["s"]), "\n")
    table = p.groupBy("paper").agg(F.concat(F.lit("name,size\n"), lines).cast("binary").alias("content")).select("paper", F.lit("a.csv").alias("file"), "content")
    tabbed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", F.concat_ws("\t", "p_name", "p_size").alias("s")))), lambda x: x["s"]), "\n")
    members = p.groupBy("paper", F.expr("i div 5").alias("m")).agg(tabbed.alias("body")).select("paper", F.struct(F.concat(F.lit("m"), F.col("m").cast("string"), F.lit(".tsv")).alias("name"), "body").alias("member"))
    archive = members.groupBy("paper").agg(F.array_sort(F.collect_list("member")).alias("own")).select("paper", F.lit("b.zip").alias("file"), _zipped(F.array_append("own", F.struct(F.lit("read.me").alias("name"), F.lit("none").alias("body")))).alias("content"))
    papers = p.select("paper").distinct()
    broken = papers.where("paper % 2 = 0").select("paper", F.lit("c.xlsx").alias("file"), F.lit("not a book").cast("binary").alias("content"))
    other = papers.where("paper % 3 = 0").select("paper", F.lit("d.pdf").alias("file"), F.lit("%PDF").cast("binary").alias("content"))
    files = table.unionByName(archive).unionByName(broken).unionByName(other)
    published.publish(files.select(F.concat_ws("__", "paper", "file").alias("name"), "content"), where, "files")
    rows = supplements.read_supplements(spark, where, r"([^/]+)__[^/]+$")
    return rows.select("paper", F.regexp_extract("file", r"\.(\w+)$", 1).alias("kind"), "member", "row", F.array_join("cells", "|").alias("cells"), "reason")


_HOURLY = """SELECT CAST(epoch(date_trunc('hour', ts)) // 3600 AS BIGINT) AS h, date_trunc('hour', ts) AS started, count(*) AS n, count(*) FILTER (event_type NOT IN ('error', 'signup')) AS ok, count(*) FILTER (event_type = 'error' AND user_id % 7 <> 0) AS bad,
  count(*) FILTER (event_type = 'error' AND user_id % 11 = 0) AS quota, count(*) FILTER (event_type = 'error' AND user_id % 7 = 0) AS late, count(*) FILTER (event_type = 'click') AS calls, count(*) FILTER (event_type = 'purchase') AS outputs, CAST(max(user_id) % 100 AS DOUBLE) / 4 AS runtime FROM events GROUP BY ALL"""


@R.query(f"""WITH m AS (SELECT * FROM ({_HOURLY}) WHERE h % 10 <> 3 AND h % 7 <> 5),
b AS (SELECT *, CASE WHEN h % 3 = 1 THEN 0 ELSE quota END AS q, CASE WHEN h % 3 = 2 THEN 0 ELSE late END AS l, n > 0 AND ok = n AS good FROM m)
SELECT 'run' || CAST(h AS VARCHAR) AS run_id, CASE WHEN hour(started) < 6 THEN 'night' WHEN hour(started) < 12 THEN 'morning' WHEN hour(started) < 18 THEN 'afternoon' ELSE 'evening' END AS time_block, runtime AS runtime_seconds, ok AS completed_papers, n AS total_papers, bad AS failed_papers, calls AS api_calls,
  CASE WHEN good AND q > 0 THEN 'complete_with_quota_limit' WHEN good AND l > 0 THEN 'complete_with_timeout' WHEN good THEN 'complete_clean' WHEN q > 0 THEN 'quota_limited' WHEN l > 0 THEN 'timeout' WHEN calls = 0 AND outputs = 0 THEN 'upstream_metadata_or_fulltext_failure' WHEN h % 2 = 1 THEN 'runner_error' ELSE 'partial_or_unclassified_failure' END AS failure_class FROM b""")
def manifests_analyzed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifests of three shapes as VARIANT values: renamed, retyped and missing fields; pilots and another corpus's runs are left out."""
    where = shared_folder(spark, "manifests")
    kind, user = F.col("event_type"), F.col("user_id")
    error = kind == "error"
    status = F.when(error & (user % 7 == 0), "timeout").when(error, "failed").when(kind == "signup", "no_full_text").otherwise("ok")
    e = base(spark, sf_dir, "events").groupBy(F.date_trunc("hour", "ts").alias("started")).agg(
        F.collect_list(F.struct(F.col("event_id").cast("string").alias("pmid"), status.alias("status"))).alias("papers"), F.count_if(error & (user % 11 == 0)).alias("quota"), F.count_if(error & (user % 7 == 0)).alias("late"),
        F.count_if(kind == "click").alias("calls"), F.count_if(kind == "purchase").alias("outputs"), (F.max("user_id") % 100 / 4).alias("runtime"), F.count("*").alias("n"), F.count_if(status == "ok").alias("ok"), F.count_if(status == "failed").alias("bad"),
    )
    h = F.expr("unix_seconds(cast(started as timestamp)) div 3600")
    run, at, text = F.concat(F.lit("run"), h.cast("string")), F.date_format("started", "yyyy-MM-dd HH:mm:ss"), lambda c: F.col(c).cast("string")
    code, pilot, corpus = (h % 2).cast("int"), h % 10 == 3, F.when(h % 7 == 5, "other").otherwise("c1")
    # The current shape; an older one with other names and text for numbers; and one with counters at the top, without papers.
    shapes = [
        F.to_json(F.struct(run.alias("run_id"), at.alias("started_at"), corpus.alias("corpus_fingerprint"), pilot.alias("pilot"), F.col("runtime").alias("runtime_seconds"), code.alias("return_code"), F.struct(F.col("quota").alias("quota_limited_rows"), F.col("late").alias("timeout_count"), F.col("calls").alias("gemini_api_calls"), F.col("outputs").alias("output_rows")).alias("batch"), F.col("papers").alias("per_paper"))),
        F.to_json(F.struct(run.alias("run"), at.alias("start"), corpus.alias("fingerprint"), pilot.alias("is_pilot"), text("runtime").alias("runtime"), code.cast("string").alias("returnCode"), F.struct(text("ok").alias("completed"), text("n").alias("total"), text("bad").alias("failed"), text("late").alias("timeouts"), text("calls").alias("api_calls"), F.col("outputs").alias("rows")).alias("stats"))),
        F.to_json(F.struct(run.alias("id"), F.struct(at.alias("started_at")).alias("schedule"), F.struct(corpus.alias("fingerprint")).alias("corpus"), pilot.cast("string").alias("pilot"), F.col("runtime").alias("duration_seconds"), code.alias("exit_code"), F.col("ok").alias("completed_papers"), F.col("n").alias("total_papers"), F.col("bad").alias("failed_papers"), F.col("quota").alias("quota_limited_rows"), F.col("calls").alias("gemini_api_calls"), text("outputs").alias("output_rows"))),
    ]
    body = F.when(h % 3 == 0, shapes[0]).when(h % 3 == 1, shapes[1]).otherwise(shapes[2])
    published.publish(e.select(F.concat(run, F.lit(".json")).alias("name"), body.cast("binary").alias("content")), where, "files")
    m = manifests.manifests(manifests.read_variants(spark, where), "c1").withColumn("time_block", runs.time_block("started"))
    return runs.batch_rows(m).select("run_id", "time_block", "runtime_seconds", "completed_papers", "total_papers", "failed_papers", F.col("gemini_api_calls").alias("api_calls"), "failure_class")


_FIGURES = "SELECT doc_id // 12 AS pmid, doc_id % 2 AS parser, doc_id % 12 // 2 AS part, doc_id, CASE WHEN doc_id % 4 = 1 THEN '' ELSE 'Fig ' || CAST(doc_id AS VARCHAR) END AS label, CASE WHEN doc_id % 3 = 0 THEN lang ELSE ' ' END AS caption FROM documents"


@R.query(f"""WITH RECURSIVE f AS ({_FIGURES}), u AS (SELECT pmid, doc_id, parser, part, doc_id AS url, 0 AS k FROM f WHERE doc_id % 7 <> 6 UNION ALL SELECT pmid, doc_id, parser, part, doc_id + 3, 1 FROM f WHERE doc_id % 5 <> 0 AND doc_id % 7 <> 6),
e AS (SELECT DISTINCT a.pmid, a.doc_id AS x, b.doc_id AS y FROM u a JOIN u b ON a.pmid = b.pmid AND a.url = b.url),
r AS (SELECT pmid, x, y FROM e UNION SELECT r.pmid, r.x, e.y FROM r JOIN e ON r.pmid = e.pmid AND r.y = e.x),
g AS (SELECT r.pmid, r.x AS doc_id, arg_min(r.y, (parser, part)) AS lead FROM r JOIN f ON f.pmid = r.pmid AND f.doc_id = r.y GROUP BY ALL),
o AS (SELECT f.*, coalesce(lead, f.doc_id) AS lead FROM f LEFT JOIN g USING (pmid, doc_id)),
a AS (SELECT pmid, lead, url, min((parser, part, k)) AS seen FROM u JOIN o USING (pmid, doc_id) GROUP BY ALL)
SELECT o.pmid, coalesce(arg_min(label, (parser, part)) FILTER (trim(label) <> ''), '') AS label, coalesce(arg_min(caption, (parser, part)) FILTER (trim(caption) <> ''), '') AS caption, CAST(count(*) AS BIGINT) AS n_figures,
  coalesce((SELECT string_agg(CAST(url AS VARCHAR), ',' ORDER BY seen) FROM a WHERE a.pmid = o.pmid AND a.lead = o.lead), '') AS urls FROM o GROUP BY o.pmid, o.lead""".replace("f.*, coalesce(lead", "f.pmid, f.doc_id, f.parser, f.part, label, caption, coalesce(lead").replace("JOIN o USING (pmid, doc_id) GROUP", "JOIN (SELECT pmid, doc_id, lead FROM o) USING (pmid, doc_id) GROUP"))
def figures_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures of two parsers that share addresses, in chains of any length."""
    d = F.col("doc_id")
    urls = F.when(d % 7 == 6, F.array().cast("array<string>")).when(d % 5 == 0, F.array(d.cast("string"))).otherwise(F.array(d.cast("string"), (d + 3).cast("string")))
    f = base(spark, sf_dir, "documents").select(F.expr("doc_id div 12").alias("pmid"), (d % 2).cast("int").alias("parser"), F.expr("cast(doc_id % 12 div 2 as int)").alias("part"), F.when(d % 4 == 1, "").otherwise(F.concat(F.lit("Fig "), d.cast("string"))).alias("label"), F.when(d % 3 == 0, F.col("lang")).otherwise(" ").alias("caption"), urls.alias("urls"))
    merged = markup.merge_figures(f, counted=True)
    return merged.select("pmid", "label", "caption", "n_figures", F.array_join("urls", ",").alias("urls"))


QUERIES, ORACLE_SQL = R.queries, R.sql
