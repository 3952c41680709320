"""Markup sources: JATS articles in document order, and HTML pages."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import squeezed, strip_tags
from ..operators.components import components

IMAGE_TYPES = ("jpg", "jpeg", "png", "gif", "tif", "tiff", "webp")
_HREF = "{http://www.w3.org/1999/xlink}href"
PARTS = "pmid string, kind string, part int, row int, label string, caption string, text string, cells array<string>, urls array<string>"


def inline_text(e: ET.Element) -> str:
    """An element's text, with a blank where two fragments would touch."""
    out = ""
    for piece in e.itertext():
        if piece and out and not out[-1].isspace() and not piece[0].isspace():
            out += " "
        out += piece
    return " ".join(out.split())


def _tag(e: ET.Element) -> str:
    return e.tag.rsplit("}", 1)[-1] if isinstance(e.tag, str) else ""


def _under(e: ET.Element, name: str) -> Iterator[ET.Element]:
    return (x for x in e.iter() if _tag(x) == name)


def _child(e: ET.Element, name: str) -> str:
    return next((inline_text(x) for x in e if _tag(x) == name), "")


def body_paragraphs(body: ET.Element) -> Iterator[str]:
    """Paragraphs of a body, then title and paragraphs of each section, in document order."""
    for e in body:
        if _tag(e) == "p":
            yield inline_text(e)
        elif _tag(e) == "sec":
            if title := _child(e, "title"):
                yield title
            yield from body_paragraphs(e)


def image_urls(href: str, base: str = "") -> list[str]:
    """Places where a figure may be: an absolute address as it is, else against the article and its bin folder, with every image type if the name has none."""
    if re.match(r"https?://", href):
        return [href]
    names = [href] if re.search(r"\.\w{3,4}$", href) else [f"{href}.{t}" for t in IMAGE_TYPES]
    base = base.rstrip("/")
    return list(dict.fromkeys(f"{base}/{folder}{n}" for n in names for folder in ("", "bin/")))


def parts_in_order(xml: str, base: str = "") -> Iterator[dict]:
    """Abstract and body paragraphs, rows of all tables (row 0: the header), figures and supplements, one at a time; nothing of malformed XML."""
    try:
        root = ET.fromstring(xml)
    except ET.ParseError:
        return
    made = lambda kind, part, **k: {"kind": kind, "part": part, "row": None, "label": "", "caption": "", "text": "", "cells": None, "urls": None} | k
    for k, p in enumerate(p for a in _under(root, "abstract") for p in _under(a, "p")):
        yield made("abstract", k, text=inline_text(p))
    body = next(_under(root, "body"), None)
    if body is not None:
        for k, t in enumerate(x for x in body_paragraphs(body) if x):
            yield made("body", k, text=t)
    for k, t in enumerate(_under(root, "table-wrap")):
        about = {"label": _child(t, "label") or t.get("id", ""), "caption": _child(t, "caption")}
        rows = [[(_tag(c), inline_text(c)) for c in r if _tag(c) in ("th", "td")] for r in _under(t, "tr")]
        head = next((i for i, r in enumerate(rows) if r and any(tag == "th" for tag, _ in r)), None)
        ordered = ([rows[head]] if head is not None else [[]]) + [r for i, r in enumerate(rows) if i != head]
        for n, r in enumerate(ordered):
            yield made("table", k, row=n, cells=[c for _, c in r], **about)
    seen = set()
    for k, f in enumerate(_under(root, "fig")):
        hrefs = [g.get(_HREF) for g in f.iter() if g.get(_HREF)]
        urls = list(dict.fromkeys(u for h in hrefs for u in image_urls(h, base)))
        if urls and urls[0] not in seen:
            seen.add(urls[0])
            yield made("figure", k, label=_child(f, "label"), caption=_child(f, "caption"), urls=urls)
    seen = set()
    for k, s in enumerate(_under(root, "supplementary-material")):
        href = s.get(_HREF) or next((g.get(_HREF) for g in s.iter() if g.get(_HREF)), None)
        if href and href not in seen:
            seen.add(href)
            yield made("supplement", k, label=_child(s, "label") or _child(s, "caption") or "Supplementary", urls=[href if re.match(r"https?://", href) else f"{base.rstrip('/')}/{href}"])


def article_parts(xml: str, base: str = "") -> list[dict]:
    """All parts of an article in document order."""
    return list(parts_in_order(xml, base))


#: Characters of parts after which a worker hands them on, and bytes of articles that it is given at once.
PART_CHARS, ARTICLE_BYTES = 1 << 20, "4m"


def parts_in_pieces(articles: Iterable[tuple[str, str | None, str]], most: int = PART_CHARS) -> Iterator[list[dict]]:
    """Parts of articles (pmid, xml, address) in lists of about so many characters; an article of more than as many again goes on in the next."""
    rows, n = [], 0
    for pmid, xml, url in articles:
        for p in parts_in_order(xml or "", url):
            rows.append({"pmid": pmid} | p)
            n += 100 + len(p["label"]) + len(p["caption"]) + len(p["text"]) + sum(len(x) + 10 for x in p["cells"] or p["urls"] or ())
            if n >= 2 * most:
                yield rows
                rows, n = [], 0
        if n >= most:
            yield rows
            rows, n = [], 0
    if rows:
        yield rows


def parse_articles(articles: DataFrame) -> DataFrame:
    """All parts of articles (pmid, xml, optionally url).

    A worker holds a batch of articles, one article's tree and a piece of its parts, however large the table is. The
    session's batches for Python are cut smaller where it leaves Spark's 64 MB.
    """
    conf = articles.sparkSession.conf
    if conf.get("spark.sql.execution.arrow.maxBytesPerBatch") in ("67108864b", "67108864"):
        conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARTICLE_BYTES)
    a = articles.select("pmid", "xml", F.coalesce("url", F.lit("")).alias("url") if "url" in articles.columns else F.lit("").alias("url"))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        strings = pa.list_(pa.string())
        kinds = {"part": pa.int32(), "row": pa.int32(), "cells": strings, "urls": strings}
        schema = pa.schema([(n, kinds.get(n, pa.string())) for n in ("pmid", "kind", "part", "row", "label", "caption", "text", "cells", "urls")])
        one_by_one = (tuple(c[k].as_py() for c in b.columns) for b in batches for k in range(b.num_rows))
        for rows in parts_in_pieces(one_by_one):
            yield pa.RecordBatch.from_pylist(rows, schema)

    return a.mapInArrow(parse, PARTS)


def article_text(parts: DataFrame) -> DataFrame:
    """Per article: abstract, body, table rows and figure captions in this order, blank lines between; tables and figures as lists."""
    order = F.when(F.col("kind") == "abstract", 0).when(F.col("kind") == "body", 1).when(F.col("kind") == "table", 2).otherwise(3)
    shown = F.when(F.col("kind") == "table", F.array_join("cells", "\t")).when(F.col("kind") == "figure", F.concat_ws(" ", "label", "caption")).otherwise(F.col("text"))
    p = parts.where("kind <> 'supplement'").withColumns({"_o": order, "_t": shown}).where("_t <> ''")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_o", "part", F.coalesce("row", F.lit(0)).alias("r"), "_t"))), lambda x: x["_t"]), "\n\n")
    return p.groupBy("pmid").agg(text.alias("text"), F.count_if(F.col("kind") == "body").alias("body_parts"), F.countDistinct(F.when(F.col("kind") == "table", F.col("part"))).alias("n_tables"), F.countDistinct(F.when(F.col("kind") == "figure", F.col("part"))).alias("n_figures"))


def article_tables(parts: DataFrame) -> DataFrame:
    """pmid and tables (label, table_id, rows), as the citation index takes them."""
    rows = parts.where("kind = 'table' AND row > 0").groupBy("pmid", "part").agg(F.first("label").alias("label"), F.array_sort(F.collect_list(F.struct("row", "cells"))).alias("_r"))
    t = F.struct("part", "label", F.lit("").alias("table_id"), F.transform("_r", lambda x: x["cells"]).alias("rows"))
    return rows.groupBy("pmid").agg(F.transform(F.array_sort(F.collect_list(t)), lambda x: F.struct(x["label"].alias("label"), x["table_id"].alias("table_id"), x["rows"].alias("rows"))).alias("tables"))


def merge_figures(figures: DataFrame, counted: bool = False) -> DataFrame:
    """Figures of two parsers (pmid, parser, part, label, caption, urls) that share an address, directly or over others, are one; first non-empty fields win, addresses are joined in order. Figures without address stay as they are. If asked, n_figures says how many became one."""
    f = figures.withColumn("_id", F.struct("pmid", "parser", "part"))
    keys = f.select("_id", F.explode("urls").alias("_u"))
    # One pair for each figure and address: the address's first figure stands for it.
    least = keys.groupBy(F.col("_id.pmid").alias("_p"), "_u").agg(F.min("_id").alias("_m"))
    pairs = keys.withColumn("_p", F.col("_id.pmid")).join(least, ["_p", "_u"]).select(F.col("_id").alias("a"), F.col("_m").alias("b"))
    group = components(pairs).select(F.col("node").alias("_id"), F.col("component").alias("_g"))
    first = lambda c: F.coalesce(F.min_by(c, F.when(F.trim(c) != "", F.col("_id"))), F.lit(""))
    whole = f.join(group, "_id", "left").withColumn("_g", F.coalesce("_g", "_id"))
    return whole.groupBy("pmid", "_g").agg(first("label").alias("label"), first("caption").alias("caption"), F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("_id", "urls"))), lambda x: x["urls"]))).alias("urls"), *([F.count("*").alias("n_figures")] if counted else [])).drop("_g")


def html_text(html: Column | str) -> Column:
    """Visible text of a page: scripts, styles, comments and tags go, five entities are read."""
    h = F.col(html) if isinstance(html, str) else html
    h = F.regexp_replace(F.regexp_replace(h, r"(?is)<(script|style|noscript)\b.*?</\1\s*>", " "), r"(?s)<!--.*?-->", " ")
    h = F.regexp_replace(h, r"(?s)<[^>]*>", " ")
    for code, ch in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        h = F.replace(h, F.lit(code), F.lit(ch))
    return squeezed(h)


def html_title(html: Column | str) -> Column:
    return squeezed(F.regexp_extract(F.col(html) if isinstance(html, str) else html, r"(?is)<title[^>]*>(.*?)</title>", 1))


def abstracts(answers: DataFrame, column: str = "xml") -> DataFrame:
    """pmid and abstract of each article in answers of a metadata service: its abstract's parts joined by blanks, tags stripped.

    An article without id goes; one without abstract has an empty one.
    """
    part = lambda x: strip_tags(F.regexp_extract(x, r"(?is)^<AbstractText[^>]*>(.*)</AbstractText>$", 1))
    found = answers.select(F.explode(F.regexp_extract_all(column, F.lit(r"(?is)<PubmedArticle\b.*?</PubmedArticle>"), F.lit(0))).alias("_a"))
    parts = F.transform(F.regexp_extract_all("_a", F.lit(r"(?is)<AbstractText[^>]*>.*?</AbstractText>"), F.lit(0)), part)
    return found.select(F.regexp_extract("_a", r"(?is)<PMID[^>]*>\s*(\d+)", 1).alias("pmid"), F.array_join(F.filter(parts, lambda p: p != ""), " ").alias("abstract")).where("pmid <> ''")


def limited_supplements(files: DataFrame, most: int = 3, budget: int = 200_000) -> DataFrame:
    """At most `most` files of a paper in order, until a character budget; the last one is clipped. files has pmid, position, text."""
    from pyspark.sql import Window

    w = Window.partitionBy("pmid").orderBy("position")
    f = files.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most)
    before = F.coalesce(F.sum(F.length("text")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return f.withColumn("_b", before).where(F.col("_b") < budget).withColumn("text", F.expr(f"substring(text, 1, CAST({budget} - _b AS INT))")).drop("_n", "_b")
