"""Paper metadata: normalization, identifiers, citation fusion, lookups by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

YEAR = r"\b((?:19|20)\d{2})\b"
_PATTERNS = [
    ("pmid", r"(?i)^PMID:\s*(\d+)", 1), ("doi", r"(?i)^DOI:\s*(10\.\S+)", 1), ("pmid", r"(?i)pubmed\.ncbi\.nlm\.nih\.gov/(\d+)", 1),
    ("pmc", r"(?i)ncbi\.nlm\.nih\.gov/pmc/articles/(PMC\d+)", 1), ("doi", r"(?i)doi\.org/(10\.\S+)", 1), ("pmc", r"(?i)^(PMC\d+)$", 1),
    ("doi", r"^(10\.\d{4,}/\S+)", 1), ("pmid", r"^(\d{1,8})$", 1),
]


def first_year(*fields: Column | str) -> Column:
    """The first year of the fields in order; N/A without one."""
    found = [F.nullif(F.regexp_extract(F.coalesce(F.col(f) if isinstance(f, str) else f, F.lit("")), YEAR, 1), F.lit("")) for f in fields]
    return F.coalesce(*found, F.lit("N/A"))


def first_doi(*lists: Column | str) -> Column:
    """The first entry that ends in ``[doi]``, without that."""
    every = F.concat(*[F.coalesce(F.col(x) if isinstance(x, str) else x, F.array().cast("array<string>")) for x in lists])
    hits = F.filter(every, lambda x: F.trim(x).rlike(r"(?i).+\s+\[doi\]$"))
    return F.coalesce(F.trim(F.regexp_replace(F.trim(F.get(hits, F.lit(0))), r"(?i)\s+\[doi\]$", "")), F.lit(""))


def normalize_papers(raw: DataFrame) -> DataFrame:
    """Records (pmid, title, authors, journal, abstract, dates, aid, lid, affiliations) with defaults, warnings and completeness."""
    said = lambda c, default: F.coalesce(F.nullif(F.trim(F.col(c)), F.lit("")), F.lit(default))
    nonblank = lambda c: F.filter(F.transform(F.coalesce(F.col(c), F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x != "")
    p = raw.select(
        F.trim(F.coalesce("pmid", F.lit(""))).alias("pmid"), said("title", "No Title").alias("title"), nonblank("authors").alias("authors"),
        first_year("dp", "edat", "phst", "dep", "pdat").alias("year"), said("journal", "N/A").alias("journal"), nonblank("affiliations").alias("affiliations"),
        said("abstract", "No abstract available").alias("abstract"), first_doi("aid", "lid").alias("doi"),
    )
    checks = {"title": F.col("title") == "No Title", "year": F.col("year") == "N/A", "journal": F.col("journal") == "N/A", "authors": F.size("authors") == 0, "abstract": F.col("abstract") == "No abstract available"}
    missing = {"pmid": F.col("pmid") == "", **checks}
    passed = sum(((~c).cast("int") for c in checks.values()), F.lit(0))
    return p.withColumns({
        "metadata_warnings": F.array_compact(F.array(*[F.when(c, F.lit(f"missing_{k}")) for k, c in missing.items()])),
        "metadata_completeness": F.round(passed / 5, 2),
    })


def is_incomplete() -> Column:
    return (F.col("metadata_completeness") < 1) | (F.size("metadata_warnings") > 0)


def parse_identifiers(rows: DataFrame, column: str = "text") -> DataFrame:
    """One row for each identifier of a text: its position, type, value and original spelling."""
    parts = F.filter(F.transform(F.split(F.col(column), r"[\n,;]+"), lambda x: F.trim(x)), lambda x: x != "")
    r = rows.select("*", F.posexplode(parts).alias("position", "original"))
    kind, value = F, F
    for k, (name, pattern, group) in enumerate(_PATTERNS):
        hit = F.col("original").rlike(pattern)
        found = F.regexp_extract("original", pattern, group)
        found = F.upper(found) if name == "pmc" else found
        kind = F.when(hit, name) if k == 0 else kind.when(hit, name)
        value = F.when(hit, found) if k == 0 else value.when(hit, found)
    return r.withColumns({"type": kind.otherwise("unknown"), "value": value.otherwise(F.col("original"))})


def resolved_first(ids: DataFrame, id_map: DataFrame) -> DataFrame:
    """Identifiers resolved to pmid by doi (any case) or archive id; of several with one pmid the first stays."""
    m = id_map.select("pmid", F.lower("doi").alias("_doi"), F.upper("pmc").alias("_pmc"))
    by_doi = m.where("_doi IS NOT NULL").groupBy("_doi").agg(F.min("pmid").alias("_by_doi"))
    by_pmc = m.where("_pmc IS NOT NULL").groupBy("_pmc").agg(F.min("pmid").alias("_by_pmc"))
    r = ids.join(by_doi, (F.col("type") == "doi") & (F.lower("value") == F.col("_doi")), "left").join(by_pmc, (F.col("type") == "pmc") & (F.col("value") == F.col("_pmc")), "left")
    r = r.withColumn("pmid", F.when(F.col("type") == "pmid", F.col("value")).otherwise(F.coalesce("_by_doi", "_by_pmc"))).where("pmid IS NOT NULL")
    return r.groupBy("pmid").agg(F.min_by(F.struct("type", "value", "original"), "position").alias("first")).select("pmid", "first.*")


def fuse_citations(papers: DataFrame, primary: DataFrame, secondary: DataFrame) -> DataFrame:
    """Citation counts: the primary source's, else the secondary's if it answered, else 0; the secondary is used only where the primary has none."""
    unresolved = papers.select("pmid").distinct().join(primary.where("count IS NOT NULL"), "pmid", "left_anti")
    second = secondary.where("ok").join(unresolved, "pmid", "left_semi").groupBy("pmid").agg(F.max(F.coalesce("count", F.lit(0))).alias("secondary_count"))
    first = primary.where("count IS NOT NULL").groupBy("pmid").agg(F.max("count").alias("primary_count"))
    p, s = F.col("primary_count"), F.col("secondary_count")
    return papers.join(first, "pmid", "left").join(second, "pmid", "left").withColumns({
        "citations": F.coalesce(p, s, F.lit(0)), "citation_source": F.when(p.isNotNull(), "primary").when(s.isNotNull(), "secondary").otherwise("none"),
    })


def count_of(record: dict[str, Column | str]) -> Column:
    """A citation count under its several field names, else the size of a list of citing papers."""
    numbers = [F.col(record[k]).try_cast("int") for k in ("citedByPmidCount", "citation_count", "cited_by_count") if k in record]
    sizes = [F.when(F.col(record[k]).isNotNull(), F.size(record[k])) for k in ("cited_by", "citedByPmidsByYear") if k in record]
    return F.coalesce(*numbers, *sizes)


def missing(asked: DataFrame, found: DataFrame, key: str = "pmid") -> DataFrame:
    """What was asked for and not found."""
    return asked.join(found, key, "left_anti")


def with_defaults(rows: DataFrame, lookup: DataFrame, key: str | list[str], defaults: dict) -> DataFrame:
    """A left join whose missing values take defaults."""
    joined = rows.join(lookup, key, "left")
    return joined.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})


def publication_type_query(query: str, excluded: list[str]) -> str:
    """A search string with a clause for each excluded publication type."""
    if not excluded:
        return query
    clauses = " AND ".join(f"NOT {t}[Publication Type]" for t in excluded)
    return f"({query}) AND {clauses}" if query.strip() else clauses


def open_access_query(query: str, subset: str = '"free full text"[sb]') -> str:
    return f"({query}) AND {subset}" if query.strip() else subset


def diagnose_query(query: Column | str) -> Column:
    """What is wrong with a search string: parentheses, quotes or a dangling operator; null if nothing."""
    q = F.col(query) if isinstance(query, str) else query
    count = lambda ch: F.length(q) - F.length(F.replace(q, F.lit(ch), F.lit("")))
    return (
        F.when(count("(") != count(")"), "unbalanced_parentheses").when(count('"') % 2 == 1, "unbalanced_quotes")
        .when(F.trim(q).rlike(r"(?i)(?:^(?:AND|OR)\b|\b(?:AND|OR|NOT)$)"), "dangling_operator")
    )
