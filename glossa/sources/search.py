"""Search over landed papers: predicates, audits, identifiers, fetch outcomes.

Remote services are outside the engine: their replies are landed as tables, and a
search is a filter that reaches the scan. The effective query stays as text.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as C
from ..operators.metadata import open_access_query, publication_type_query


def matches(term: str, columns: tuple[str, ...] = ("title", "abstract")) -> Column:
    """Whether a paper's title or abstract has a term, regardless of case."""
    return reduce(lambda a, b: a | b, [F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit(term.lower())) for c in columns])


def predicate(every: list[str] = (), any_of: list[str] = (), none_of: list[str] = (), years: tuple[int, int] = (1900, 3000)) -> Column:
    """All of some terms, one of others, none of a third list, within a range of years (papers without year stay out)."""
    p = F.col("year").try_cast("int").between(*years)
    for t in every:
        p = p & matches(t)
    if any_of:
        p = p & reduce(lambda a, b: a | b, map(matches, any_of))
    return p & ~reduce(lambda a, b: a | b, map(matches, none_of), F.lit(False))


def query_text(every: list[str] = (), any_of: list[str] = (), none_of: list[str] = (), years: tuple[int, int] | None = None) -> str:
    """The same conditions as a search string."""
    parts = [*every, *([f"({' OR '.join(any_of)})"] if any_of else [])]
    text = " AND ".join(parts)
    if none_of:
        text = f"{text} NOT ({' OR '.join(none_of)})".strip()
    return f"({text}) AND {years[0]}:{years[1]}[dp]" if years else text


def author_query(name: str, keywords: list[str] = (), operator: str = "AND", years: tuple[int, int] = (1900, 2099)) -> str:
    words = f" {operator} ".join(f'"{k}"' for k in keywords)
    return f"{name}[Author]" + (f" AND ({words})" if words else "") + f" AND {years[0]}:{years[1]}[dp]"


def by_author(papers: DataFrame, name: str, most: int = 200) -> DataFrame:
    """Papers of an author, by search rank."""
    return papers.where(F.array_contains("authors", name)).orderBy(F.col("search_rank").asc_nulls_last(), "pmid").limit(most)


def better_name_form(counts: DataFrame) -> DataFrame:
    """Of an author's two spellings (author, form, n) the one with more papers; the first, full form if it has at most a thousand."""
    full = F.max(F.when((F.col("form") == "full") & (F.col("n") > 0) & (F.col("n") <= 1000), F.col("form")))
    return counts.groupBy("author").agg(F.coalesce(full, F.max_by("form", F.struct("n", "form"))).alias("form"))


def search(papers: DataFrame, where: Column, most: int, types: bool = True, open_access: bool = True) -> DataFrame:
    """Ids of papers that match, by search rank, without excluded publication types and, if asked, open access only."""
    p = papers.where(where)
    if types and "publication_types" in papers.columns:
        p = p.where(~F.arrays_overlap("publication_types", F.array(*[F.lit(t) for t in C.EXCLUDED_PUBLICATION_TYPES])))
    if open_access and "is_open_access" in papers.columns:
        p = p.where("is_open_access")
    return p.select("pmid", "search_rank").orderBy(F.col("search_rank").asc_nulls_last(), "pmid").limit(most)


def audit(found: DataFrame, query: str, types: bool, open_access: bool) -> DataFrame:
    """One row: the query as given and as sent, filters and how many were found."""
    sent = publication_type_query(query, C.EXCLUDED_PUBLICATION_TYPES if types else [])
    sent = open_access_query(sent) if open_access else sent
    return found.agg(F.count("*").alias("returned")).select(F.lit(query).alias("query"), F.lit(sent).alias("effective_query"), "returned", F.lit(types).alias("type_filter"), F.lit(open_access).alias("access_filter"), F.current_timestamp().alias("retrieved_at"))


def within_limit(found: DataFrame, most: int = 500) -> DataFrame:
    """Nothing when a search found more than can be ranked."""
    n = found.agg(F.count("*").alias("_n"))
    return found.crossJoin(F.broadcast(n)).where(F.col("_n") <= most).drop("_n")


def converted(asked: DataFrame, replies: DataFrame) -> DataFrame:
    """Archive ids of asked papers; a reply for another paper than the asked one does not count."""
    return asked.join(replies.where("pmid = requested_pmid").groupBy("pmid").agg(F.min("pmc").alias("pmc")), "pmid", "left")


def citation_batch(batch: DataFrame, singles: DataFrame, asked: DataFrame) -> DataFrame:
    """Counts of a batch call, else of single calls, else 0."""
    s = singles.withColumnRenamed("count", "_single")
    return asked.join(batch, "pmid", "left").join(s, "pmid", "left").select("pmid", F.coalesce("count", "_single", F.lit(0)).alias("count"))


def full_texts(asked: DataFrame, sources: list[DataFrame], good: Column) -> DataFrame:
    """For each asked paper the first good text of its sources in order, or an explicit miss; sources have pmid, text, method, n_tables, n_figures."""
    from .records import best_source

    none = F.lit("no_full_text")
    found = best_source(sources, good)
    return asked.join(found, "pmid", "left").withColumns({"method": F.coalesce("method", none), "error": F.when(F.col("source_no").isNull(), "no good source")})


def fetch_report(texts: DataFrame) -> DataFrame:
    return texts.select("pmid", F.when(F.col("method") != "no_full_text", F.col("method")).alias("method"), F.coalesce(F.length("text"), F.lit(0)).alias("length"), F.coalesce("n_tables", F.lit(0)).alias("n_tables"), F.coalesce("n_figures", F.lit(0)).alias("n_figures"), "error")


def fetch_statistics(report: DataFrame) -> DataFrame:
    return report.agg(F.count_if(F.col("method").isNotNull()).alias("succeeded"), F.count_if(F.col("method").isNull()).alias("failed"), F.sum("n_tables").alias("tables"), F.sum("n_figures").alias("figures"), F.count_if(F.col("n_tables") > 0).alias("papers_with_tables"))


def read_corpus(spark: SparkSession, path: str, size: int = 10, allow_unverified: bool = False) -> DataFrame:
    """A corpus list in its order; it has to be verified and of the fixed size."""
    raw = spark.read.option("multiLine", True).json(path)
    checked = raw.withColumn("pmids", F.when(F.lit(allow_unverified) | F.col("verified"), F.col("pmids")).otherwise(F.raise_error(F.lit("corpus is not verified"))))
    checked = checked.withColumn("pmids", F.when(F.size("pmids") == size, F.col("pmids")).otherwise(F.raise_error(F.concat(F.lit("corpus does not have the fixed number of papers: "), F.size("pmids").cast("string")))))
    return checked.select(F.posexplode("pmids").alias("position", "p")).select("position", "p.*")


def read_settings(spark: SparkSession, path: str) -> DataFrame:
    """key, value of a settings file: comments and blank lines go, quotes around values too; the last of a key wins."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"\r?\n")).alias("n", "line"))
    kv = lines.where(F.col("line").rlike(r"^\s*(?:export\s+)?[A-Za-z_]\w*\s*="))
    pattern = r"^\s*(?:export\s+)?([A-Za-z_]\w*)\s*=\s*(.*?)\s*$"
    value = F.regexp_replace(F.regexp_extract("line", pattern, 2), r"""^(["'])(.*)\1$""", "$2")
    return kv.select(F.regexp_extract("line", pattern, 1).alias("key"), value.alias("value"), "n").groupBy("key").agg(F.max_by("value", "n").alias("value"))


def inside(folder: str, path: str) -> bool:
    """Whether a path stays within a folder: the check before results are read for a view."""
    import posixpath

    base, full = posixpath.normpath(folder), posixpath.normpath(posixpath.join(folder, path))
    return full == base or full.startswith(base + "/")
