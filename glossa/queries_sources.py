"""Queries on sources, sinks, evidence and text fitting: what they read is first rendered from the given tables, then read back by the engine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import constants as C
from .functions import text
from .operators import candidates, citations, evidence, events, metadata, output, reports, results_view, runs
from .registry import Registry
from .sources import markup, records, search
from .streaming import events as streams
from .tables import base, shared_folder, sql_with, table

R = Registry()

#: A text with single blanks, in SQL.
_SQUEEZED = r"trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g'))"
_DOCS = f"WITH d AS (SELECT *, CAST(doc_id AS VARCHAR) AS pmid, {_SQUEEZED} AS t FROM documents) "


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = base(spark, sf_dir, "documents")
    return d.withColumns({"pmid": F.col("doc_id").cast("string"), "t": text.squeezed(F.coalesce("text", F.lit("")))})


def _said(*parts: Column | str) -> Column:
    """Columns and texts, one behind the other."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


@R.query(_DOCS + """SELECT pmid, 'Title of ' || pmid AS title, md5(t) AS abstract_md5, '2019 Mar' AS dp, 'Journal Article|' || lang AS publication_types, source AS authors FROM d""")
def medline_parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records written as MEDLINE text and read back, with a continued title and repeated tags."""
    d, path = _docs(spark, sf_dir), shared_folder(spark, "medline")
    lines = ["PMID- ", F.col("pmid"), "\nTI  - Title of\n      ", F.col("pmid"), "\nAB  - ", F.col("t"), "\nDP  - 2019 Mar\nPT  - Journal Article\nPT  - ", F.col("lang"), "\nAU  - ", F.col("source")]
    d.select(_said(*lines).alias("value")).write.option("lineSep", "\n\n").text(path)
    got = records.read_medline(spark, path)
    return got.select("pmid", "title", F.md5(F.coalesce("abstract", F.lit(""))).alias("abstract_md5"), "dp", F.array_join("publication_types", "|").alias("publication_types"), F.array_join("authors", "|").alias("authors"))


def _articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles of which abstract and body hold a document's text."""
    safe = F.col("t")
    for ch, code in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        safe = F.replace(safe, F.lit(ch), F.lit(code))
    xml = _said(
        '<article xmlns:xlink="http://www.w3.org/1999/xlink"><front><abstract><p>', safe, "</p></abstract></front><body><p>Lead <b>", F.col("pmid"), "</b></p><sec><title>Results</title><p>Body ", safe,
        "</p><sec><title>Deep</title><p>More</p></sec></sec></body><table-wrap><label>Table 1</label><caption><p>Cap ", F.col("lang"), "</p></caption><table><tr><td>a</td><td>", F.col("pmid"),
        '</td></tr><tr><th>G</th><th>N</th></tr></table></table-wrap><fig><label>Fig 1</label><caption><p>Shown</p></caption><graphic xlink:href="f', F.col("pmid"), '"/></fig>',
        '<supplementary-material xlink:href="s', F.col("pmid"), '.csv"><label>S1</label></supplementary-material></article>',
    )
    return _docs(spark, sf_dir).select("pmid", xml.alias("xml"), _said("http://x/", F.col("pmid")).alias("url"))


_PARTS = """SELECT pmid, 'abstract' AS kind, 0 AS part, NULL AS row, '' AS label, '' AS caption, md5(t) AS text_md5, NULL AS cells, NULL AS n_urls, NULL AS first_url FROM d
UNION ALL SELECT pmid, 'body', k, NULL, '', '', md5(CASE k WHEN 0 THEN 'Lead ' || pmid WHEN 1 THEN 'Results' WHEN 2 THEN trim('Body ' || t) WHEN 3 THEN 'Deep' ELSE 'More' END), NULL, NULL, NULL FROM d, (VALUES (0), (1), (2), (3), (4)) AS v(k)
UNION ALL SELECT pmid, 'table', 0, 0, 'Table 1', 'Cap ' || lang, md5(''), 'G|N', NULL, NULL FROM d UNION ALL SELECT pmid, 'table', 0, 1, 'Table 1', 'Cap ' || lang, md5(''), 'a|' || pmid, NULL, NULL FROM d
UNION ALL SELECT pmid, 'figure', 0, NULL, 'Fig 1', 'Shown', md5(''), NULL, 14, 'http://x/' || pmid || '/f' || pmid || '.jpg' FROM d
UNION ALL SELECT pmid, 'supplement', 0, NULL, 'S1', '', md5(''), NULL, 1, 'http://x/' || pmid || '/s' || pmid || '.csv' FROM d"""


@R.query(_DOCS + _PARTS)
def article_parts_parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part of articles in document order."""
    p = markup.parse_articles(_articles(spark, sf_dir))
    return p.select("pmid", "kind", "part", "row", "label", "caption", F.md5("text").alias("text_md5"), F.array_join("cells", "|").alias("cells"), F.when(F.col("urls").isNotNull(), F.size("urls")).alias("n_urls"), F.get("urls", F.lit(0)).alias("first_url"))


_JOINED = "(CASE WHEN t = '' THEN '' ELSE t || chr(10) || chr(10) END) || 'Lead ' || pmid || repeat(chr(10), 2) || 'Results' || repeat(chr(10), 2) || trim('Body ' || t) || repeat(chr(10), 2) || 'Deep' || repeat(chr(10), 2) || 'More' || repeat(chr(10), 2) || 'G' || chr(9) || 'N' || repeat(chr(10), 2) || 'a' || chr(9) || pmid || repeat(chr(10), 2) || 'Fig 1 Shown'"


@R.query(_DOCS + f"""SELECT pmid, md5({_JOINED}) AS text_md5, CAST(5 AS BIGINT) AS body_parts, CAST(1 AS BIGINT) AS n_tables, CAST(1 AS BIGINT) AS n_figures, 'Table 1' AS label, 'a|' || pmid AS cells FROM d""")
def article_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An article's text in order, and its tables as the citation index takes them."""
    p = markup.parse_articles(_articles(spark, sf_dir))
    t = markup.article_tables(p).select("pmid", F.get("tables", F.lit(0)).alias("t")).select("pmid", "t.label", F.array_join(F.get("t.rows", F.lit(0)), "|").alias("cells"))
    return markup.article_text(p).select("pmid", F.md5("text").alias("text_md5"), "body_parts", "n_tables", "n_figures").join(t, "pmid")


_GOOD = "(length(clean) >= 1000 AND doc_id % 5 <> 0 AND doc_id % 7 <> 0 AND doc_id % 11 <> 0)"
_FETCHED = f"""WITH d AS (SELECT doc_id, CAST(doc_id AS VARCHAR) AS pmid, coalesce(text, '') AS clean FROM documents),
f AS (SELECT pmid, CASE WHEN {_GOOD} AND doc_id % 2 = 0 THEN 'primary' WHEN {_GOOD.replace('clean', "clean || clean")} THEN 'secondary' END AS method, doc_id, clean FROM d) """


def _fetched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each paper's text from the first of two sources that has a good one."""
    d = base(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").cast("string").alias("pmid"), F.coalesce("text", F.lit("")).alias("text"))
    d = d.withColumns({"quality": F.when(F.col("doc_id") % 5 == 0, 0.2).otherwise(0.5), "type": F.when(F.col("doc_id") % 7 == 0, "minimal_content").otherwise("full_article"), "problem": F.when(F.col("doc_id") % 11 == 0, "timeout"), "n_tables": (F.col("doc_id") % 3).cast("int"), "n_figures": F.lit(1)})
    primary = d.where("doc_id % 2 = 0").withColumn("method", F.lit("primary"))
    secondary = d.withColumns({"method": F.lit("secondary"), "text": F.concat("text", "text")})
    return search.full_texts(d.select("pmid"), [x.drop("doc_id") for x in (primary, secondary)], text.is_good_content("text", "quality", "type", "problem"))


@R.query(_FETCHED + """SELECT pmid, method, CAST(CASE method WHEN 'primary' THEN length(clean) WHEN 'secondary' THEN 2 * length(clean) ELSE 0 END AS INT) AS length, CAST(CASE WHEN method IS NULL THEN 0 ELSE doc_id % 3 END AS INT) AS n_tables,
  CAST(CASE WHEN method IS NULL THEN 0 ELSE 1 END AS INT) AS n_figures, CASE WHEN method IS NULL THEN 'no good source' END AS error FROM f""")
def texts_fetched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first good text of two sources, or why there is none."""
    return search.fetch_report(_fetched(spark, sf_dir))


@R.query(_FETCHED + """SELECT CAST(count(method) AS BIGINT) AS succeeded, CAST(count(*) - count(method) AS BIGINT) AS failed, CAST(sum(CASE WHEN method IS NULL THEN 0 ELSE doc_id % 3 END) AS BIGINT) AS tables,
  CAST(count(method) AS BIGINT) AS figures, CAST(count(*) FILTER (method IS NOT NULL AND doc_id % 3 > 0) AS BIGINT) AS papers_with_tables FROM f""")
def fetch_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How fetching went over all papers."""
    return search.fetch_statistics(search.fetch_report(_fetched(spark, sf_dir)))


@R.query("""SELECT CAST(doc_id AS VARCHAR) AS pmid, 'BRCA1' AS symbol, '672' AS gene_id, 'BRCA1|Brca1' AS mentions, CAST(doc_id % 100 AS INT) AS first_offset, 'rs' || doc_id AS rsid, 'p.V600E' AS hgvs FROM documents""")
def annotations_parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Genes and variants of annotation documents in three envelopes."""
    d = base(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % 100).cast("string").alias("at"), F.col("doc_id").cast("string").alias("pmid"))
    gene = lambda name, said, at: _said('{"infons": {"type": "Gene", "identifier": "672"', name, '}, "text": "', said, '", "locations": [{"offset": ', at, ', "length": 5}]}')
    notes = _said(gene(', "name": "brca1"', "BRCA1", F.col("at")), ", ", gene("", "Brca1", F.lit("200")), ', {"infons": {"type": "Variant", "identifier": "tmVar:rs', F.col("pmid"), ';x", "name": "p.V600E"}, "text": "V600E", "locations": []}')
    body = lambda key, value: _said('{"', key, '": "', value, '", "passages": [{"annotations": [', notes, "]}]}")
    kind = F.col("doc_id") % 3
    value = F.when(kind == 0, _said("[", body("pmid", F.col("pmid")), "]")).when(kind == 1, _said('{"PubTator3": [', body("_id", _said(F.col("pmid"), "|PMC1")), "]}")).otherwise(body("id", F.col("pmid")))
    docs = records.documents_of(d.select(value.alias("value")))
    genes = records.ner_genes(docs).select("pmid", "symbol", "gene_id", F.array_join("mentions", "|").alias("mentions"), F.get("locations", F.lit(0))["offset"].alias("first_offset"))
    return genes.join(records.ner_variants(docs).select("pmid", "rsid", "hgvs"), "pmid")


@R.query(sql_with(["lexicon"], "SELECT CAST(ordinal AS INT) AS ordinal, symbol, names AS aliases, CASE WHEN ordinal % 2 = 0 THEN locus_type ELSE 'unknown' END AS locus_type FROM lexicon"))
def lexicon_loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A lexicon written as one JSON map, with old and new field names, and loaded in its order."""
    path = shared_folder(spark, "lexicon")
    names = F.concat(F.lit('["'), F.replace("names", F.lit(","), F.lit('","')), F.lit('"]'))
    new = _said('{"alias_symbol": ', names, ', "locus_type": "', F.col("locus_type"), '"}')
    old = _said('{"aliases": ', names, "}")
    entry = _said('"', F.lower("symbol"), '": ', F.when(F.col("ordinal") % 2 == 0, new).otherwise(old))
    # A lexicon is a table of known, small size.
    whole = table(spark, sf_dir, "lexicon").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", entry.alias("e")))), lambda x: x["e"]), ", ").alias("v"))
    whole.select(_said("{", F.col("v"), "}").alias("value")).coalesce(1).write.text(path)
    return records.read_lexicon(spark, path).select("ordinal", "symbol", F.array_join("alias_symbol", ",").alias("aliases"), "locus_type")


@R.query("""SELECT CASE k WHEN 0 THEN '1234-' || lpad(CAST(s_suppkey % 10000 AS VARCHAR), 4, '0') WHEN 1 THEN '9999-' || lpad(CAST(s_suppkey % 1000 AS VARCHAR), 3, '0') || 'X' END AS issn, 'journal of ' || lower(replace(s_name, '#', '')) AS name_norm, 'Q' || (s_suppkey % 5) AS quartile
FROM supplier, (VALUES (0), (1), (2)) AS v(k) WHERE s_suppkey % 5 BETWEEN 1 AND 4""")
def journal_ranks_loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Journal ranks from a file with several ISSNs a row, some of them malformed."""
    path, s = shared_folder(spark, "journals"), base(spark, sf_dir, "supplier")
    issn = _said("1234", F.lpad((F.col("s_suppkey") % 10000).cast("string"), 4, "0"), ", 9999", F.lpad((F.col("s_suppkey") % 1000).cast("string"), 3, "0"), "x, 12")
    s.select(_said("The Journal of ", F.col("s_name")).alias("Title"), issn.alias("Issn"), _said("Q", (F.col("s_suppkey") % 5).cast("string")).alias("SJR Best Quartile")).write.option("header", True).option("sep", ";").csv(path)
    return records.read_journal_ranks(spark, path)


_SEARCHED = sql_with(["papers"], "")


@R.query(_SEARCHED + """SELECT pmid FROM papers WHERE year <> 'N/A' AND CAST(year AS INT) BETWEEN 1995 AND 2020 AND (contains(lower(title), 'cohort') OR contains(lower(abstract), 'cohort') OR contains(lower(title), 'expression') OR contains(lower(abstract), 'expression'))
  AND NOT (contains(lower(title), 'nursing') OR contains(lower(abstract), 'nursing')) AND doc_id % 3 <> 0 AND doc_id % 4 <> 0 ORDER BY search_rank ASC NULLS LAST, pmid LIMIT 200""")
def papers_searched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search for at most two hundred papers, without excluded publication types, open access only."""
    p = table(spark, sf_dir, "papers").withColumns({"publication_types": F.when(F.col("doc_id") % 3 == 0, F.array(F.lit("Review"))).otherwise(F.array(F.lit("Journal Article"))), "is_open_access": F.col("doc_id") % 4 != 0})
    return search.search(p, search.predicate(any_of=["cohort", "expression"], none_of=["nursing"], years=(1995, 2020)), 200).select("pmid")


@R.query(_SEARCHED + """, f AS (SELECT count(*) AS n FROM papers WHERE contains(lower(title), 'cohort') OR contains(lower(abstract), 'cohort'))
SELECT CAST(n AS BIGINT) AS returned, '(("cohort") AND NOT Review[Publication Type]' AS begins, '"free full text"[sb]' AS ends, CAST(CASE WHEN n <= 500 THEN n ELSE 0 END AS BIGINT) AS rankable FROM f""")
def search_audited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit row of a search, and what of it can be ranked."""
    found = table(spark, sf_dir, "papers").where(search.matches("cohort"))
    rankable = search.within_limit(found, 500).agg(F.count("*").alias("rankable"))
    a = search.audit(found, '"cohort"', True, True)
    return a.select("returned", F.left("effective_query", F.lit(44)).alias("begins"), F.right("effective_query", F.lit(20)).alias("ends")).join(rankable)


@R.query(_SEARCHED + """SELECT pmid FROM papers WHERE doc_id % 2 = 0 OR doc_id % 5 = 0 ORDER BY search_rank ASC NULLS LAST, pmid LIMIT 200""")
def author_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An author's papers by search rank, at most two hundred."""
    p = table(spark, sf_dir, "papers").withColumn("authors", F.array_compact(F.array(F.when(F.col("doc_id") % 2 == 0, "A B"), F.when(F.col("doc_id") % 3 == 0, "C D"), F.when(F.col("doc_id") % 10 == 5, "A B"))))
    return search.by_author(p, "A B").select("pmid")


@R.query("""SELECT c_custkey AS author, CASE WHEN c_custkey % 1500 BETWEEN 1 AND 1000 THEN 'full' WHEN c_custkey % 1500 > c_custkey % 700 THEN 'full' ELSE 'short' END AS form FROM customer""")
def author_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spelling of an author's name that finds more."""
    c = base(spark, sf_dir, "customer")
    both = c.select(F.col("c_custkey").alias("author"), F.lit("full").alias("form"), (F.col("c_custkey") % 1500).alias("n")).unionByName(c.select(F.col("c_custkey").alias("author"), F.lit("short").alias("form"), (F.col("c_custkey") % 700).alias("n")))
    return search.better_name_form(both)


@R.query("""SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'unbalanced_parentheses' WHEN 1 THEN 'unbalanced_quotes' WHEN 2 THEN 'dangling_operator' WHEN 3 THEN 'dangling_operator' END AS problem FROM documents""")
def queries_diagnosed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with search strings."""
    q = F.when(F.col("doc_id") % 6 == 0, _said("(", F.col("lang"))).when(F.col("doc_id") % 6 == 1, _said('"', F.col("lang"))).when(F.col("doc_id") % 6 == 2, _said(F.col("lang"), " and")).when(F.col("doc_id") % 6 == 3, _said("OR ", F.col("lang"))).otherwise(_said('("', F.col("lang"), '" OR x)'))
    return base(spark, sf_dir, "documents").select("doc_id", metadata.diagnose_query(q).alias("problem"))


@R.query("""SELECT CAST(doc_id AS VARCHAR) AS pmid, CASE WHEN doc_id % 3 <> 0 AND doc_id % 4 <> 0 THEN 'PMC' || doc_id END AS pmc FROM documents""")
def ids_converted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archive ids; replies for another paper do not count."""
    d = _docs(spark, sf_dir)
    replies = d.where("doc_id % 3 <> 0").select("pmid", F.when(F.col("doc_id") % 4 == 0, "other").otherwise(F.col("pmid")).alias("requested_pmid"), _said("PMC", F.col("pmid")).alias("pmc"))
    return search.converted(d.select("pmid"), replies)


@R.query("""WITH i AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN doc_id - doc_id % 8 WHEN 1 THEN doc_id WHEN 2 THEN doc_id END AS p, CASE doc_id % 4 WHEN 0 THEN 'pmid' WHEN 1 THEN 'doi' ELSE 'pmc' END AS type FROM documents)
SELECT CAST(p AS VARCHAR) AS pmid, min_by(type, doc_id) AS type, min(doc_id) AS position FROM i WHERE p IS NOT NULL GROUP BY p""")
def ids_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identifiers of three kinds resolved to one, the first of each paper staying; unknown ones go."""
    d = base(spark, sf_dir, "documents").select("doc_id")
    k, own = F.col("doc_id") % 4, F.col("doc_id").cast("string")
    value = F.when(k == 0, (F.col("doc_id") - F.col("doc_id") % 8).cast("string")).when(k == 1, _said("10.1/AB", own)).when(k == 2, _said("PMC", own)).otherwise(_said("PMC0", own))
    ids = d.select(F.col("doc_id").alias("position"), F.when(k == 0, "pmid").when(k == 1, "doi").otherwise("pmc").alias("type"), value.alias("value"), value.alias("original"))
    known = d.select(own.alias("pmid"), _said("10.1/ab", own).alias("doi"), _said("pmc", own).alias("pmc"))
    first = metadata.resolved_first(ids, known)
    return first.join(ids.select("position", "type", "value"), ["type", "value"]).groupBy("pmid", "type").agg(F.min("position").alias("position"))


_WORDS = r"len(list_filter(string_split(t, ' '), lambda x: x <> ''))"


@R.query(_DOCS + f"""SELECT doc_id, CAST(floor({_WORDS} * {C.TOKENS_PER_WORD}) AS INT) AS tokens, md5(array_to_string(list_slice(string_split(t, ' '), 1, 40), ' ')) AS cut_md5, {_WORDS} * {C.TOKENS_PER_WORD} >= 801 AS too_long FROM d""")
def texts_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token estimates, texts cut to a limit, and which ones a context of a thousand tokens would make shorter."""
    d = base(spark, sf_dir, "documents")
    fitted = evidence.fit_context(d.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), 1000, "doc_id").select("doc_id", F.col("truncated").alias("too_long"))
    body = F.coalesce("text", F.lit(""))
    return d.select("doc_id", text.estimate_tokens(body).alias("tokens"), F.md5(text.truncate_words(body, 30)).alias("cut_md5")).join(fitted, "doc_id")


_SECTIONED = "WITH d AS (SELECT doc_id, CAST(n_chars % 40 AS INT) + 1 AS a, CAST(n_chars % 7 AS INT) + 1 AS b FROM documents), s AS (SELECT *, CAST(floor(a * 1.3) AS INT) AS ta, CAST(floor(b * 1.3) AS INT) AS tb FROM d) "


@R.query(_SECTIONED + """SELECT doc_id, CASE WHEN ta > 30 THEN '' WHEN ta + tb > 30 THEN 'a' WHEN ta + tb + ta > 30 THEN 'ab' ELSE 'aba' END AS kept FROM s""")
def sections_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leading sections as far as a limit of tokens goes."""
    d = base(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") % 40 + 1).cast("int").alias("a"), (F.col("n_chars") % 7 + 1).cast("int").alias("b"))
    words = lambda w, n: F.rtrim(F.repeat(F.lit(f"{w} "), F.col(n)))
    whole = _said(words("a", "a"), "\n\n", words("b", "b"), "\n\n\n", words("a", "a"))
    kept = text.keep_leading_sections(whole, 30)
    return d.select("doc_id", F.regexp_replace(F.regexp_replace(kept, " [ab]", ""), r"\s", "").alias("kept")).withColumn("kept", F.regexp_replace(F.regexp_replace("kept", "a+b+a+", "aba"), "^a+$", "a"))


@R.query("""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE '1234-567X' END AS issn, 'A ' || lang || ' title' AS plain, CAST(length(text) AS INT) AS length, left(text, CASE WHEN length(text) > 200 THEN 80 ELSE length(text) END) AS head, CASE WHEN length(text) > 200 THEN right(text, 80) END AS tail,
  lang || '|x' AS listed, CASE doc_id % 4 WHEN 0 THEN 'Strong' WHEN 1 THEN 'Moderate' WHEN 2 THEN 'Weak' ELSE 'Needs review' END AS shown, CASE WHEN doc_id % 2 = 0 THEN 'plan ' || lang ELSE source END AS label FROM documents""")
def values_shaped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ISSNs, tags, long values, lists, display names and labels."""
    d, k = base(spark, sf_dir, "documents"), F.col("doc_id")
    short = text.summarize("text")
    return d.select(
        "doc_id", text.format_issn(F.when(k % 3 == 0, "12-34").otherwise(" 1234 567x ")).alias("issn"), text.strip_tags(_said("<i>A</i> <b>", F.col("lang"), "</b>\n title ")).alias("plain"),
        short["length"].alias("length"), short["head"].alias("head"), short["tail"].alias("tail"),
        F.array_join(text.normalize_list(F.array(_said(" ", F.col("lang")), F.upper("lang"), F.lit(""), F.lit("x"))), "|").alias("listed"),
        reports.display_confidence(F.when(k % 4 == 0, "HIGH").when(k % 4 == 1, "MEDIUM").when(k % 4 == 2, "LOW").otherwise("REVIEW")).alias("shown"),
        reports.planned_label(F.when(k % 2 == 0, _said("plan ", F.col("lang"))).otherwise(" "), F.col("source")).alias("label"),
    )


@R.query("""WITH d AS (SELECT doc_id, CAST(doc_id AS VARCHAR) AS p, CASE WHEN doc_id % 2 = 0 THEN 'G' || doc_id || ' rose with P' || doc_id || '.' ELSE 'G' || doc_id || ' rose with P' || doc_id || '. ' || repeat('x ', 300) || 'Then G' || doc_id || ' stood alone.' END AS body FROM documents)
SELECT p AS pmid, 'G' || p AS gene, CASE WHEN doc_id % 5 = 0 THEN 'given' WHEN doc_id % 2 = 0 THEN body ELSE trim(right(body, 80 + length('G' || p || ' stood alone.'))) END AS finding, doc_id % 5 <> 0 AS backfilled,
  CASE WHEN doc_id % 5 = 0 THEN '' WHEN doc_id % 2 = 0 THEN 'co_mention' ELSE 'gene_specific' END AS specificity, CASE WHEN doc_id % 5 <> 0 AND doc_id % 2 = 0 THEN 'P' || p ELSE '' END AS peers FROM d
UNION ALL SELECT p, 'P' || p, 'has a quote', false, '', '' FROM d""")
def evidence_backfilled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows without evidence take a snippet, one that names no other gene of the paper if there is one."""
    d = base(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").cast("string").alias("pmid"))
    own, peer = _said("G", F.col("pmid")), _said("P", F.col("pmid"))
    first = _said(own, " rose with ", peer, ".")
    texts = d.select("pmid", F.when(F.col("doc_id") % 2 == 0, first).otherwise(_said(first, " ", F.repeat(F.lit("x "), F.lit(300)), "Then ", own, " stood alone.")).alias("text"))
    rows = d.select("pmid", own.alias("gene"), F.array(own).alias("terms"), F.when(F.col("doc_id") % 5 == 0, "given").otherwise("").alias("finding"), F.lit("").alias("finding Citation"))
    rows = rows.unionByName(d.select("pmid", peer.alias("gene"), F.array(peer).alias("terms"), F.lit("has a quote").alias("finding"), F.lit("q").alias("finding Citation")))
    done = evidence.backfill(rows, texts, "finding", ["finding"])
    return done.select("pmid", "gene", "finding", F.col("evidence_backfilled").alias("backfilled"), F.col("evidence_specificity").alias("specificity"), F.col("co_mentioned_genes").alias("peers"))


@R.query("""SELECT CAST(doc_id AS VARCHAR) AS pmid, CASE WHEN doc_id % 3 = 0 THEN 'given' WHEN doc_id % 3 = 1 THEN 'Levels of G' || doc_id || ' rose, p <0.0' || (doc_id % 9 + 1) || '.' ELSE '' END AS statistical_significance, CASE WHEN doc_id % 2 = 0 THEN 'key ' || doc_id ELSE 'disease' END AS conclusion,
  CASE WHEN doc_id % 2 = 0 THEN 'key quote' ELSE 'disease' END AS conclusion_citation FROM documents""")
def fields_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics from the shortest sentence that has one, conclusions from other fields."""
    d, k = base(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").cast("string").alias("pmid")), F.col("doc_id")
    gene = _said("G", F.col("pmid"))
    said = _said("First words on ", gene, ". A longer sentence about levels of ", gene, " which also rose here, p <0.5. Levels of ", gene, " rose, p <0.0", (k % 9 + 1).cast("string"), ". End.")
    texts = d.select("pmid", F.when(k % 3 == 2, _said("Only ", gene, " is named.")).otherwise(said).alias("text"))
    blank = F.lit("")
    rows = d.select(
        "pmid", F.array(gene).alias("terms"), F.when(k % 3 == 0, "given").otherwise("").alias("Statistical Significance"), blank.alias("Statistical Significance Citation"), blank.alias("Conclusion"), blank.alias("Conclusion Citation"),
        F.when(k % 2 == 0, _said("key ", F.col("pmid"))).otherwise("").alias("Key Finding"), F.when(k % 2 == 0, "key quote").otherwise("").alias("Key Finding Citation"), F.lit("disease").alias("Disease Association"), blank.alias("Disease Association Citation"),
    )
    done = evidence.fill_missing(rows, ["Statistical Significance", "Conclusion"], texts)
    return done.select("pmid", F.col("`Statistical Significance`").alias("statistical_significance"), F.col("Conclusion").alias("conclusion"), F.col("`Conclusion Citation`").alias("conclusion_citation"))


@R.query(r"""WITH d AS (SELECT doc_id, regexp_matches(coalesce(text, ''), '\S') AS has_words FROM documents)
SELECT CAST(doc_id AS VARCHAR) AS pmid, CASE WHEN NOT has_words THEN 'nothing_to_compare' WHEN doc_id % 4 = 0 THEN 'quote_found' WHEN doc_id % 4 = 1 THEN 'number_not_near:771077' WHEN doc_id % 4 = 2 THEN 'symbol_not_near' ELSE 'short_quote_not_found' END AS reason,
  CASE WHEN has_words AND doc_id % 4 = 1 THEN 24.0 / 26 WHEN has_words AND doc_id % 4 <> 3 THEN 1.0 ELSE 0.0 END AS ratio, has_words AND doc_id % 4 = 0 AS valid FROM d""")
def citations_judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotes behind a document's text, word for word or nearly, with numbers and symbols that do or do not stand near them."""
    d = base(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").cast("string").alias("pmid"), F.coalesce("text", F.lit("")).alias("text"))
    k, words = F.col("doc_id") % 4, " alpha beta gamma delta epsilon zeta eta theta iota kappa value "
    added = F.when(k == 1, f"{words}12 units").otherwise(" near GENE-1 so")
    texts = d.select("pmid", F.when(F.col("text").rlike(r"\S"), _said(F.col("text"), added)).otherwise("").alias("text"))
    quote = F.when(k == 0, "near  GENE-1\nSO").when(k == 1, f"{words}771077 units").when(k == 2, "near gene-1").otherwise("nowhere here zzz")
    names = F.when(k == 2, F.array(F.lit("OTHER9"))).when(k == 0, F.array(F.lit("GENE1"))).otherwise(F.array().cast("array<string>"))
    cited = d.select("pmid", F.lit(0).alias("cid"), F.lit("").alias("gene"), names.alias("names"), quote.alias("citation"))
    return citations.verify(cited, texts).select("pmid", "reason", "ratio", "valid")


@R.query("""SELECT CAST(doc_id AS VARCHAR) AS pmid, CASE WHEN doc_id % 4 = 0 THEN 'HLA-B*27:05' WHEN doc_id % 4 = 3 THEN 'own' ELSE '' END AS variant FROM documents""")
def alleles_reconciled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detail rows without variant take their gene's only allele, unless there is a gene-level candidate or a second allele."""
    d, k = base(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").cast("string").alias("pmid")), F.col("doc_id") % 4
    found = F.when(k == 0, F.array(F.lit("HLA-B*27:05"))).when(k == 1, F.array(F.lit("HLA-B*27:05"), F.lit(""))).when(k == 2, F.array(F.lit("HLA-B*27:05"), F.lit("HLA-B*07"))).otherwise(F.array(F.lit("HLA-B*27:05")))
    details = d.select("pmid", F.lit("HLA-B").alias("gene"), F.when(k == 3, "own").otherwise("").alias("variant"))
    return candidates.allele_variants(details, d.select("pmid", F.lit("HLA-B").alias("gene"), F.explode(found).alias("variant"))).select("pmid", "variant")


@R.query("""SELECT CAST(doc_id AS VARCHAR) AS pmid, CASE WHEN doc_id % 3 = 1 THEN 'llm' ELSE 'skeleton' END AS extraction_mode, CASE WHEN doc_id % 3 = 0 THEN '' WHEN doc_id % 3 = 2 THEN '429' ELSE '' END AS error, 'metadata_only' AS minimal_mode, CASE WHEN doc_id % 2 = 0 THEN 'CANCELLED' ELSE '' END AS status FROM documents""")
def rows_completed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Details or skeletons, minimal rows, and what a cancelled run did not reach."""
    d = base(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").cast("string").alias("pmid"))
    replies = d.where("doc_id % 3 <> 0").select("pmid", F.when(F.col("doc_id") % 3 == 2, "429").otherwise("").alias("error"))
    detailed = output.details_or_skeletons(d.select("pmid"), replies, ["pmid"]).select("pmid", "extraction_mode", F.coalesce("error", F.lit("")).alias("error"))
    minimal = output.minimal_rows(d.select("pmid")).where("gene = '' AND variant = ''").select("pmid", F.col("extraction_mode").alias("minimal_mode"))
    left = output.cancelled(d.select("pmid"), d.where("doc_id % 2 = 1").select("pmid"))
    return detailed.join(minimal, "pmid").join(left, "pmid", "left").withColumn("status", F.coalesce("status", F.lit("")))


_SIZES = "[n_chars % 150 + 1, n_chars % 90 + 1, n_chars % 200 + 1, 5]"


@R.query(f"""WITH d AS (SELECT CAST(doc_id AS VARCHAR) AS pmid, {_SIZES} AS z FROM documents), s AS (SELECT pmid, k AS position, z[k + 1] AS n, list_sum(list_slice(z, 1, k)) AS before FROM d, (VALUES (0), (1), (2)) AS v(k))
SELECT pmid, CAST(position AS INT) AS position, CAST(least(n, 250 - coalesce(before, 0)) AS INT) AS length FROM s WHERE coalesce(before, 0) < 250""")
def supplements_limited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most three supplements of a paper, up to a budget of characters."""
    sizes = F.array(*[(F.col("n_chars") % m + 1).cast("int") for m in (150, 90, 200)], F.lit(5))
    files = base(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("pmid"), F.posexplode(sizes).alias("position", "n")).select("pmid", "position", F.repeat(F.lit("x"), F.col("n")).alias("text"))
    return markup.limited_supplements(files, 3, 250).select("pmid", "position", F.length("text").alias("length"))


@R.query("""WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS before FROM events)
SELECT event_id, CAST(before AS BIGINT) AS calls_before, CASE WHEN event_id % 3 = 0 THEN before + 1 < 3 ELSE before < 3 END AS allowed, event_id % 30 > 10 AS late FROM e""")
def calls_planned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which calls a paper may still make when one is kept back for those that have to be made, and which slots began late."""
    e = base(spark, sf_dir, "events").withColumn("optional", F.col("event_id") % 3 == 0)
    late = runs.is_late(F.col("ts").cast("timestamp"), F.col("ts").cast("timestamp") + F.make_interval(mins=(F.col("event_id") % 30).cast("int")))
    return events.running_calls(e, "user_id", ["ts", "event_id"], 3, 1).select("event_id", "calls_before", "allowed", late.alias("late"))


@R.query(sql_with(["rows_given"], """SELECT pmid, CAST(count(*) AS BIGINT) AS n_rows, CAST(count(*) AS BIGINT) AS n_json, CAST(count(*) AS BIGINT) AS n_metadata, CAST(count(*) FILTER (trim(gene) <> '') AS BIGINT) AS n_genes,
  array_to_string(list_sort(list(DISTINCT CASE WHEN finding = '' THEN NULL ELSE finding END)), '|') AS findings FROM rows_given GROUP BY pmid"""))
def results_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Primary and metadata CSV and primary JSON, written, read back and tied by their order."""
    r = table(spark, sf_dir, "rows_given").select(
        F.col("pmid").alias("PMID"), F.col("gene").alias("Gene/Group"), F.col("variant").alias("Variant Name"), F.col("finding").alias("Finding"), F.col("quote").alias("Finding Citation"),
        F.lit("HIGH").alias("Confidence"), F.col("association_type").alias("Association Type"), F.lit("hidden").alias("internal"),
    )
    where = output.write_results(r, ["Finding"], shared_folder(spark, "results"))
    csv = lambda k: spark.read.option("header", True).csv(where[k])
    p = csv("primary_csv")
    assert "internal" not in p.columns and "internal" in csv("metadata_csv").columns
    rows = p.groupBy(F.col("PMID").alias("pmid")).agg(F.count("*").alias("n_rows"), F.count_if(F.trim(F.coalesce("Gene", F.lit(""))) != "").alias("n_genes"), F.array_join(F.array_sort(F.collect_set("Finding")), "|").alias("findings"))
    n = lambda df, name: df.groupBy(F.col("PMID").alias("pmid")).agg(F.count("*").alias(name))
    return rows.join(n(spark.read.json(where["primary_json"]), "n_json"), "pmid").join(n(csv("metadata_csv"), "n_metadata"), "pmid")


_PER_PAPER = """, p AS (SELECT pmid, CAST(count(*) AS BIGINT) AS emitted, CAST(count(*) FILTER (trim(gene) <> '') AS BIGINT) AS named, CAST(count(DISTINCT upper(trim(gene)) || '/' || variant || '/' || position) AS BIGINT) AS listed, min(upper(trim(gene))) AS least FROM rows_given GROUP BY pmid) """


@R.query(sql_with(["rows_given"], _PER_PAPER.strip() + " SELECT pmid, 'q' AS query, CAST(named AS BIGINT) AS associations, emitted AS emitted_rows, listed AS candidate_count, least AS first_gene, 'candidate_audit_v1' AS schema_version FROM p"))
def payloads_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Debug, audit and candidate payloads, written as JSON and read back."""
    r = table(spark, sf_dir, "rows_given")
    papers = r.groupBy("pmid").agg(F.count("*").alias("candidate_count"), F.lit(0).cast("long").alias("emitted_rows"))
    path = shared_folder(spark, "payloads")
    audit = reports.audit_payload(papers, r.withColumn("association_group", F.lit("")))
    reports.drop_debug(papers, {"query": "q"}).withColumnRenamed("payload", "debug").join(audit.withColumnRenamed("payload", "audit"), "pmid").write.json(path)
    found = candidates_of(r)
    get = lambda c, p: F.get_json_object(c, p)
    w = spark.read.schema("pmid string, debug string, audit string").json(path)
    w = w.select("pmid", get("debug", "$.run.query").alias("query"), get("audit", "$.associations").cast("long").alias("associations"), get("audit", "$.emitted_rows").cast("long").alias("emitted_rows"), get("audit", "$.schema_version").alias("schema_version"))
    return w.join(found, "pmid")


def candidates_of(rows: DataFrame) -> DataFrame:
    life = reports.candidate_lifecycle(rows.select("pmid", F.upper(F.trim("gene")).alias("gene"), "variant", F.array("source").alias("sources"), F.lit("kept").alias("outcome")))
    return life.select("pmid", "candidate_count", F.get_json_object("candidates", "$[0].gene").alias("first_gene"))


@R.query("""WITH e AS (SELECT 'n' || (event_id % 200) AS node_id, 's' || (event_id % 7) AS stage_id, event_id FROM events), l AS (SELECT node_id, max(event_id) AS event_id FROM e GROUP BY node_id)
SELECT l.node_id, e.stage_id, CAST(l.event_id AS BIGINT) AS captured_at, CAST((SELECT count(*) FROM e AS x WHERE x.stage_id = e.stage_id) AS BIGINT) AS stage_events FROM l JOIN e ON e.event_id = l.event_id""")
def traces_archived(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest event of each node as JSON."""
    e = base(spark, sf_dir, "events").select(_said("n", (F.col("event_id") % 200).cast("string")).alias("node_id"), _said("s", (F.col("event_id") % 7).cast("string")).alias("stage_id"), F.col("user_id").cast("string").alias("pmid"), F.col("event_id").alias("captured_at"))
    a = reports.trace_archive(e)
    return a.select("node_id", F.get_json_object("payload", "$.stage_id").alias("stage_id"), F.get_json_object("payload", "$.captured_at").cast("long").alias("captured_at"), F.get_json_object("payload", "$.stage_events").cast("long").alias("stage_events"))


@R.query("""SELECT 'run' || (user_id % 20) AS run_id, CAST(count(DISTINCT user_id) AS BIGINT) AS n_papers, CAST(min(user_id) AS VARCHAR) AS first_paper, CAST(count(*) AS BIGINT) AS total FROM events GROUP BY user_id % 20""")
def manifests_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run manifests written as JSON and read back."""
    path = shared_folder(spark, "manifests")
    e = base(spark, sf_dir, "events").withColumn("run_id", _said("run", (F.col("user_id") % 20).cast("string")))
    per = e.groupBy("run_id", F.lpad(F.col("user_id").cast("string"), 12, "0").alias("pmid")).agg(F.count("*").alias("n"))
    reports.manifest(e.select("run_id").distinct(), e.groupBy("run_id").agg(F.count("*").alias("total")), per).write.json(path)
    m = spark.read.json(path)
    return m.select("run_id", F.size("per_paper").cast("long").alias("n_papers"), F.ltrim(F.get("per_paper", F.lit(0))["pmid"], F.lit("0")).alias("first_paper"), F.col("batch.total").alias("total")).withColumn("first_paper", F.when(F.col("first_paper") == "", "0").otherwise(F.col("first_paper")))


@R.query("""SELECT event_type AS kind, min(value) AS min, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) AS q3, max(value) AS max, CAST(count(*) FILTER (user_id % 3 = 0) AS BIGINT) AS a FROM events GROUP BY event_type""")
def plots_prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Box plots' five numbers and a matrix, as one report table."""
    e = base(spark, sf_dir, "events").withColumn("kind", F.col("event_type"))
    counts = e.groupBy("kind", (F.col("user_id") % 3).cast("string").alias("part")).agg(F.count("*").alias("n"))
    matrix = reports.matrix_data(counts, "kind", "part", "n", ["0", "1", "2"]).select("kind", F.col("0").alias("a"))
    both = reports.report_table([reports.box_data(e, "kind", "value"), matrix])
    return both.groupBy("kind").agg(*[F.max(c).alias(c) for c in ("min", "q1", "median", "q3", "max")], F.coalesce(F.max("a"), F.lit(0)).alias("a"))


@R.query("""SELECT CASE event_id % 4 WHEN 0 THEN 'progress' WHEN 1 THEN 'log' ELSE 'result' END AS kind, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (event_id % 4 <> 2) AS BIGINT) AS n_json FROM events WHERE event_id % 4 <> 3 GROUP BY 1""")
def events_routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of files as a stream, dispatched by kind and appended to a table of each."""
    where = shared_folder(spark, "routed")
    m = F.col("event_id") % 4
    body = _said('{"id": ', F.col("event_id").cast("string"), "}")
    base(spark, sf_dir, "events").select(F.when(m == 0, _said("PROGRESS:", body)).when(m == 1, _said("LOG:", body)).when(m == 2, F.lit("RESULT:{broken")).otherwise(F.lit("noise")).alias("value")).write.text(f"{where}/lines")
    kinds = ("progress", "log", "result")
    streams.route(streams.dispatch(streams.read_lines(spark, f"{where}/lines")), {k: f"{where}/out/{k}" for k in kinds}, f"{where}/checkpoint").awaitTermination()
    out = None
    for k in kinds:
        own = spark.read.schema("value string, kind string, payload string, json string").option("recursiveFileLookup", True).parquet(f"{where}/out/{k}").groupBy("kind").agg(F.count("*").alias("n"), F.count("json").alias("n_json"))
        out = own if out is None else out.unionByName(own)
    return out


@R.query("""SELECT CAST(doc_id AS VARCHAR) AS pmid, doc_id % 3 = 0 OR doc_id % 4 = 0 OR doc_id % 5 = 0 AS incomplete FROM documents""")
def metadata_incomplete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P20: papers whose metadata lack something."""
    k = F.col("doc_id")
    p = base(spark, sf_dir, "documents").select(k.cast("string").alias("pmid"), F.when(k % 3 == 0, 0.8).otherwise(1.0).alias("metadata_completeness"), F.when((k % 4 == 0) | (k % 5 == 0), F.array(F.lit("missing_year"))).otherwise(F.array().cast("array<string>")).alias("metadata_warnings"))
    return p.select("pmid", metadata.is_incomplete().alias("incomplete"))


@R.query(sql_with(["rows_given"], """SELECT CAST(position AS BIGINT) AS row_id, pmid, gene, source FROM rows_given"""))
def rows_with_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result rows and their metadata, by place."""
    r = table(spark, sf_dir, "rows_given").withColumn("row_id", F.col("position").cast("long"))
    return results_view.with_metadata(r.select("row_id", "pmid", "gene"), r.select("row_id", "pmid", "source")).select("row_id", "pmid", "gene", "source")


@R.query("""SELECT CAST(doc_id AS VARCHAR) AS pmid, CAST(CASE WHEN doc_id % 2 = 0 THEN doc_id ELSE 0 END AS BIGINT) AS drops, CAST(CASE WHEN doc_id % 3 = 0 THEN doc_id ELSE 0 END AS BIGINT) AS emitted, CASE WHEN doc_id % 5 = 0 THEN 'primary' ELSE '' END AS method FROM documents""")
def papers_summarized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Papers with their debug, audit and fetch records."""
    d = base(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").cast("string").alias("pmid"))
    part = lambda m, name, value: d.where(F.col("doc_id") % m == 0).select("pmid", value.alias(name))
    return reports.paper_summary(d.select("pmid"), part(2, "drops", F.col("doc_id")), part(3, "emitted", F.col("doc_id")), part(5, "method", F.lit("primary"))).select("pmid", "drops", "emitted", "method")


QUERIES, ORACLE_SQL = R.queries, R.sql
