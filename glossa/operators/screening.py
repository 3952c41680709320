"""Screening and ranking of papers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import scoring, text
from .ordering import with_ordinal


def screen(papers: DataFrame, threshold: int = C.SCREENING_THRESHOLD, signals: scoring.Signals | None = None, mandatory: Column | None = None) -> DataFrame:
    """Adds score, confidence, passed, reason and the signs found to papers (title, abstract); filters nothing."""
    s = F.col("_parts")
    must = mandatory if mandatory is not None else F.lit(False)
    return (
        scoring.with_abstract_parts(papers, signals, name="_parts")
        .withColumns({
            "score": F.coalesce(s["score"], F.lit(0)), "confidence": F.round(scoring.screening_confidence(F.coalesce(s["score"], F.lit(0))), 6),
            "positive": F.coalesce(s["positive"], F.array().cast("array<string>")), "negative": F.coalesce(s["negative"], F.array().cast("array<string>")),
            "symbols": F.coalesce(s["symbols"], F.array().cast("array<string>")),
        })
        .withColumn("passed", must | (s.isNotNull() & (F.col("score") >= threshold)))
        .withColumn("reason", F.when(F.col("passed"), "").when(s.isNull(), "abstract_too_short").otherwise("below_threshold"))
        .drop("_parts")
    )


def relevance(papers: DataFrame, signals: scoring.Signals | None = None) -> DataFrame:
    """Adds relevance (score, tier, symbols, keywords, context) of papers; every variant mention counts."""
    s = F.col("_parts")
    nothing = F.array().cast("array<string>")
    return scoring.with_abstract_parts(papers, signals, distinct_variants=False, name="_parts").withColumn(
        "relevance",
        F.struct(
            F.coalesce(s["score"], F.lit(0)).alias("score"), scoring.tier(F.coalesce(s["score"], F.lit(0))).alias("tier"),
            F.slice(F.array_distinct(F.coalesce(s["symbols"], nothing)), 1, 10).alias("symbols"), F.slice(F.coalesce(s["positive"], nothing), 1, 5).alias("keywords"),
            F.coalesce(s["context"], F.lit(False)).alias("context"),
        ),
    ).drop("_parts")


def with_journal_quality(papers: DataFrame, ranks: DataFrame, default: int = C.UNRANKED_SCORE) -> DataFrame:
    """Adds quartile and journal_quality: by ISSN, else by normalized name, else unranked.

    ranks has issn (null allowed), name_norm and quartile; a name with several
    rows counts by its best quartile.
    """
    by_issn = ranks.where("issn IS NOT NULL").groupBy("issn").agg(F.min("quartile").alias("_q_issn"))
    by_name = ranks.groupBy(F.col("name_norm").alias("_name")).agg(F.min("quartile").alias("_q_name"))
    joined = papers.join(by_issn, "issn", "left").withColumn("_name", text.journal_key("journal")).join(by_name, "_name", "left")
    quartile = F.coalesce("_q_issn", "_q_name", F.lit("Unranked"))
    return joined.withColumn("quartile", quartile).withColumn("journal_quality", scoring.quartile_score(F.col("quartile"), default)).drop("_name", "_q_issn", "_q_name")


def with_scores(papers: DataFrame) -> DataFrame:
    """Adds composite, genetics and recommendation scores to papers with citations, journal_quality and relevance."""
    return papers.withColumns({
        "composite_score": scoring.composite_score(F.col("citations"), F.col("journal_quality")),
        "genetics_score": scoring.genetics_signal(F.col("relevance.score")),
    }).withColumn("recommendation_score", scoring.recommendation(F.col("genetics_score"), F.col("composite_score")))


def paper_order(mode: str = "recommended") -> list[Column]:
    """The total order of a sort mode; every one ends in the search rank, missing ranks last."""
    rank, rec = F.col("search_rank").asc_nulls_last(), F.coalesce("recommendation_score", F.lit(0)).desc()
    return {
        "recommended": [rec, F.coalesce("relevance.score", F.lit(0)).desc(), F.coalesce("composite_score", F.lit(0)).desc(), rank],
        "recent": [F.coalesce("year", F.lit("")).desc(), rec, rank],
        "citations": [F.coalesce("citations", F.lit(0)).desc(), rec, rank],
        "source": [rank],
    }[mode]


def page(rows: DataFrame, order: list[Column], number: int = 1, size: int = 25) -> DataFrame:
    """One page of a total order."""
    return rows.orderBy(*order).offset((number - 1) * size).limit(size)


def auto_selected(page_rows: DataFrame) -> DataFrame:
    """The rows of a page whose tier is high or medium."""
    return page_rows.where(F.col("relevance.tier").isin("high", "medium"))


def processing_order(papers: DataFrame) -> DataFrame:
    """Adds position: mandatory papers first, then by citations, then by id."""
    return with_ordinal(papers, [F.col("is_mandatory").desc(), F.when(~F.col("is_mandatory"), F.col("citations")).desc_nulls_last(), F.col("pmid")])


def top_papers(rows: DataFrame, n: int, order: list[Column]) -> DataFrame:
    """Rows of the first n distinct papers that have rows."""
    first = rows.select("pmid", *[c for c in rows.columns if c in ("position",)]).distinct().orderBy(*order).limit(n)
    return rows.join(first.select("pmid"), "pmid", "left_semi")


def eligible(papers: DataFrame, id_map: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Explicit and author papers without an archive id are excluded; query hits are not checked. Kept and excluded."""
    checked = papers.where("is_mandatory").join(id_map.where("pmc IS NOT NULL"), "pmid", "left_semi")
    gone = papers.where("is_mandatory").join(id_map.where("pmc IS NOT NULL"), "pmid", "left_anti")
    return papers.where("NOT is_mandatory").unionByName(checked), gone


def union_ids(**sources: DataFrame) -> DataFrame:
    """Distinct pmid over several sources, with whether any of them is other than ``query`` and the names of all."""
    tagged = [d.select("pmid", F.lit(name).alias("source")) for name, d in sources.items()]
    both = reduce(DataFrame.unionByName, tagged)
    return both.groupBy("pmid").agg((F.max((F.col("source") != "query").cast("int")) == 1).alias("is_mandatory"), F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"))


def within_publication_types(papers: DataFrame, excluded: list[str] | None = None) -> DataFrame:
    """Papers of none of the excluded publication types."""
    return papers.where(~F.arrays_overlap("publication_types", F.array(*[F.lit(x) for x in excluded or C.EXCLUDED_PUBLICATION_TYPES])))
