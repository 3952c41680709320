"""Citations: whether quoted text stands in a paper or in its tables.

Exact quotes are found by an expression in the JVM, and so are the numbers and
symbols that have to stand near a quote. Only quotes that do not stand there
word for word go to the sequence matcher, one row for each distinct (paper,
citation, gene), and that only compares windows which have enough of a quote's
words to reach the ratio asked for.
"""

from __future__ import annotations

import difflib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .. import constants as C
from ..functions.text import normalized, numbers, squeezed, word_count

#: Characters around a quote in which its numbers, and a symbol of its gene, have to stand; words of the shortest quote that is compared loosely.
NUMBERS_WITHIN, SYMBOLS_WITHIN, LOOSE_WORDS, SPARE_WORDS = 500, 1500, 5, 3


def plain(text: Column | str) -> Column:
    """The form in which quotes and texts are compared: normalized, lower-case and squeezed."""
    return squeezed(F.lower(normalized(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")))))


def closest_window(quote: list[str], words: list[str], least: float = 0.0) -> tuple[float, int]:
    """The window of a few more words than a quote that is most like it: (ratio, place), (0, -1) if none reaches `least`.

    A window's matches are at most those of its words that the quote has, which
    bounds its ratio; windows are compared from the highest bound on, until no
    bound is left above the best ratio. A word matches no more often than the
    quote has it: windows that cannot be better by that count are passed over.
    """
    n, size = len(quote), len(quote) + SPARE_WORDS
    own = Counter(quote)
    shared = np.zeros(len(words) + 1, np.int64)
    np.cumsum(np.fromiter(map(own.__contains__, words), np.bool_, len(words)), out=shared[1:])
    start = np.arange(max(1, len(words) - n + 1))
    end = np.minimum(start + size, len(words))
    bound = 2 * np.minimum(shared[end] - shared[start], n) / (n + end - start)
    start = start[bound >= least]
    best, at, matcher = 0.0, -1, difflib.SequenceMatcher(None, quote)
    for j in start[np.argsort(-bound[start], kind="stable")].tolist():
        if bound[j] <= best:
            break
        window, left, most = words[j : j + size], dict(own), 0
        for w in window:
            if left.get(w):
                left[w] -= 1
                most += 1
        if 2 * most / (n + len(window)) <= best or 2 * most / (n + len(window)) < least:
            continue
        matcher.set_seq2(window)
        ratio = matcher.ratio()
        if ratio > best and ratio >= least:
            best, at = ratio, j
    return best, at


@F.pandas_udf(T.StructType([T.StructField("ratio", T.DoubleType()), T.StructField("at", T.IntegerType()), T.StructField("size", T.IntegerType())]))
def loose_place(quote: pd.Series, text: pd.Series) -> pd.DataFrame:
    """Ratio, place (from 1) and length of the closest window; null for a null quote."""
    out = []
    for q, t in zip(quote, text, strict=True):
        ratio, j = (0.0, -1)
        if q is not None:
            own, words = q.split(" "), t.split(" ")
            ratio, j = closest_window(own, words, C.CITATION_RATIO)
        out.append((ratio, 1 + len(" ".join(words[:j])) + (j > 0), len(" ".join(words[j : j + len(own) + SPARE_WORDS]))) if j >= 0 else (None, None, None))
    return pd.DataFrame(out, columns=["ratio", "at", "size"]).astype({"at": "Int32", "size": "Int32"})


def judged(asked: DataFrame) -> DataFrame:
    """Adds found, ratio and reason to rows of _quote and _text, both plain, and _names: wording, then numbers, then a symbol near by.

    Reasons: nothing_to_compare, short_quote_not_found, no_similar_text,
    number_not_near:<number>, symbol_not_near, quote_found, similar_text_found.
    """
    short = F.size(F.split("_quote", " ")) < LOOSE_WORDS
    empty = (F.col("_quote") == "") | (F.col("_text") == "")
    a = asked.withColumn("_at", F.when(empty, 0).otherwise(F.instr("_text", F.col("_quote"))))
    loose = (F.col("_at") == 0) & ~empty & ~short
    a = a.withColumn("_loose", loose_place(F.when(loose, F.col("_quote")), F.when(loose, F.col("_text"))))
    exact = F.col("_at") > 0
    a = a.withColumns({"ratio": F.when(exact, 1.0).otherwise(F.coalesce("_loose.ratio", F.lit(0.0))), "_from": F.when(exact, F.col("_at")).otherwise(F.col("_loose.at")), "_size": F.when(exact, F.length("_quote")).otherwise(F.col("_loose.size"))})

    def around(within: int) -> Column:
        return F.substring(F.col("_text"), F.greatest(F.col("_from") - within, F.lit(1)), F.col("_size") + within + F.least(F.lit(within), F.col("_from") - 1))

    a = a.withColumns({"_lost": F.get(F.array_except(numbers("_quote"), numbers(around(NUMBERS_WITHIN))), F.lit(0)), "_wide": around(SYMBOLS_WITHIN)})
    word = lambda s: F.concat(F.lit("\\b\\Q"), s, F.lit("\\E\\b"))
    bare = lambda s: F.replace(s, F.lit("-"), F.lit(""))
    named = (F.size("_names") == 0) | F.exists(F.transform("_names", lambda s: F.lower(s)), lambda s: F.rlike("_wide", word(s)) | F.rlike(bare(F.col("_wide")), word(bare(s))))
    reason = F.when(empty, "nothing_to_compare").when(F.col("_from").isNull() & short, "short_quote_not_found").when(F.col("_from").isNull(), "no_similar_text")
    reason = reason.when(F.col("_lost").isNotNull(), F.concat(F.lit("number_not_near:"), F.col("_lost"))).when(~named, "symbol_not_near").when(exact, "quote_found").otherwise("similar_text_found")
    a = a.withColumn("reason", reason).withColumn("found", F.col("reason").isin("quote_found", "similar_text_found"))
    return a.drop("_at", "_loose", "_from", "_size", "_lost", "_wide")


def confidence(citation: Column | str, found: Column, ratio: Column) -> Column:
    n = word_count(citation)
    score = 0.7 + F.when(n >= 20, 0.2).when(n >= 10, 0.1).otherwise(0.0) + F.when(ratio >= 0.99, 0.1).otherwise(0.0)
    return F.when(found, F.round(F.least(score, F.lit(1.0)), 3)).otherwise(0.0)


def passages_within(bodies: DataFrame, passages: DataFrame) -> DataFrame:
    """item_id and doc_id of all passages (item_id, quote) that stand in a body (doc_id, body), by one pass over each body.

    The passages, which have to be few enough for one automaton, are sent to all tasks; nothing is shuffled.
    """
    schema = T.StructType([passages.schema["item_id"], bodies.schema["doc_id"]])
    known: dict[str, list] = {}
    for r in passages.collect():
        known.setdefault(r["quote"], []).append(r["item_id"])
    sent = bodies.sparkSession.sparkContext.broadcast(known)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        items, automaton = sent.value, ahocorasick.Automaton()
        for quote in filter(None, items):
            automaton.add_word(quote, quote)
        automaton.make_automaton()
        always = {""} & items.keys()
        for b in batches:
            found, at = [], []
            for k, body in enumerate(b.column("body")):
                if body.is_valid:
                    hits = {q for _, q in automaton.iter(body.as_py())} if automaton.kind == ahocorasick.AHOCORASICK else set()
                    ids = [i for q in hits | always for i in items[q]]
                    found += ids
                    at += [k] * len(ids)
            yield pa.RecordBatch.from_arrays([pa.array(found, kind), b.column("doc_id").take(pa.array(at, pa.int64()))], names=["item_id", "doc_id"])

    kind = to_arrow_type(schema["item_id"].dataType)
    return bodies.select("doc_id", "body").mapInArrow(search, schema)


def table_rows(tables: DataFrame, id_column: str = "pmid") -> DataFrame:
    """Index of table rows: id, table_no, label, row_index, row_text and numbers; tables has id and tables (label, table_id, rows)."""
    t = tables.select(id_column, F.posexplode("tables").alias("table_no", "t"))
    t = t.select(id_column, "table_no", F.coalesce(F.nullif(F.col("t.label"), F.lit("")), F.nullif(F.col("t.table_id"), F.lit("")), F.lit("unknown")).alias("label"), F.posexplode("t.rows").alias("row_index", "cells"))
    t = t.withColumn("row_text", F.array_join("cells", " ", ""))
    return t.withColumn("numbers", numbers("row_text")).drop("cells")


def rows_naming(index: DataFrame, genes: DataFrame, id_column: str = "pmid") -> DataFrame:
    """Table rows that name a gene or an alias of it between non-alphanumeric characters; genes has id, gene and names.

    Names of one alphanumeric run meet the rows' tokens in an equi-join; other
    names are searched for in the rows of their own paper only.
    """
    names = genes.select(id_column, "gene", F.explode("names").alias("_n")).select(id_column, "gene", F.lower(F.trim("_n")).alias("_n")).where("_n <> ''").distinct()
    key = [id_column, "table_no", "row_index"]
    low = index.withColumn("_low", F.lower("row_text"))
    tokens = low.select(*key, F.explode(F.array_distinct(F.regexp_extract_all("_low", F.lit("[a-z0-9]+"), F.lit(0)))).alias("_n"))
    simple = names.where(F.col("_n").rlike("^[a-z0-9]+$")).join(tokens, [id_column, "_n"]).select(*key, "gene")
    other = names.where(~F.col("_n").rlike("^[a-z0-9]+$")).join(low, id_column)
    padded, quoted = F.concat(F.lit(" "), F.col("_low"), F.lit(" ")), F.regexp_replace("_n", r"([^A-Za-z0-9 ])", r"\\$1")
    other = other.where(F.contains("_low", F.col("_n"))).where(F.regexp_like(padded, F.concat(F.lit("[^a-z0-9]"), quoted, F.lit("[^a-z0-9]")))).select(*key, "gene")
    return index.join(simple.unionByName(other).distinct(), key)


def cells_mentioning(tables: DataFrame, genes: DataFrame, id_column: str = "pmid") -> DataFrame:
    """id, gene, table_no and row_index of table rows of which any cell contains a name of a gene of the same paper, in any case.

    tables and genes are as for table_rows and rows_naming. This is the looser form
    of rows_naming: a name inside a longer word counts.
    """
    t = tables.select(id_column, F.posexplode("tables").alias("table_no", "t")).select(id_column, "table_no", F.posexplode("t.rows").alias("row_index", "cells"))
    low = t.withColumn("cells", F.transform("cells", lambda c: F.lower(F.coalesce(c, F.lit("")))))
    # One row a paper and gene, so that a table row meets each gene of its paper once.
    names = genes.select(id_column, "gene", F.explode("names").alias("_n")).where("_n <> ''").groupBy(id_column, "gene").agg(F.collect_set(F.lower("_n")).alias("_names"))
    has = F.exists("cells", lambda c: F.exists("_names", lambda n: F.contains(c, n)))
    return low.join(names, id_column).where(has).select(id_column, "gene", "table_no", "row_index")


def best_table_row(citations: DataFrame, index: DataFrame, id_column: str = "pmid") -> DataFrame:
    """For citations (id, cid, gene, names, citation) the best row that names the gene: 1.0 if it has all numbers, else 0.7; the first on ties."""
    r = rows_naming(index, citations.select(id_column, "gene", "names"), id_column)
    c = citations.withColumn("_nums", numbers("citation")).join(r, [id_column, "gene"])
    lost = F.array_except("_nums", "numbers")
    score = F.when((F.size("_nums") > 0) & (F.size(lost) == 0), 1.0).otherwise(0.7)
    best = c.withColumn("score", score).withColumn("missing", lost)
    return best.groupBy(id_column, "cid").agg(F.max_by(F.struct("label", "row_index", "score", "missing"), F.struct("score", -F.col("table_no"), -F.col("row_index"))).alias("b")).select(id_column, "cid", "b.*")


def verify(citations: DataFrame, texts: DataFrame, index: DataFrame | None = None, id_column: str = "pmid") -> DataFrame:
    """Adds found, ratio, details, confidence and valid to citations (id, cid, gene, names, citation)."""
    names = F.array_distinct(F.concat(F.array(F.coalesce("gene", F.lit(""))), F.coalesce("names", F.array().cast("array<string>"))))
    c = citations.withColumn("_names", F.filter(names, lambda x: F.trim(x) != ""))
    each = c.select(id_column, "citation", "_names").distinct()
    # Quotes without their texts are small: a join that broadcasts the texts would leave all of the matcher's work to the one task that quotes fit in.
    said = each.withColumn("_quote", plain("citation")).join(texts.select(id_column, plain("text").alias("_text")).hint("merge"), id_column, "left").withColumn("_text", F.coalesce("_text", F.lit("")))
    told = judged(said).select(id_column, "citation", "_names", "found", "ratio", "reason")
    out = c.join(told, [id_column, "citation", "_names"], "left")
    if index is not None:
        out = out.join(best_table_row(citations, index, id_column).select(id_column, "cid", F.col("score").alias("_score"), F.col("label").alias("_label")), [id_column, "cid"], "left")
        by_table = ~F.col("found") & (F.col("_score") >= 0.7)
        out = out.withColumns({"ratio": F.when(by_table, F.col("_score")).otherwise(F.col("ratio")), "reason": F.when(by_table, F.concat(F.lit("table_match:"), F.col("_label"))).otherwise(F.col("reason")), "found": F.col("found") | F.coalesce(by_table, F.lit(False))}).drop("_score", "_label")
    out = out.withColumn("confidence", confidence("citation", F.col("found"), F.col("ratio")))
    return out.withColumn("valid", F.col("found") & (F.col("confidence") >= C.CITATION_MINIMUM)).drop("_names")
