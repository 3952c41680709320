"""Gene lexicon: aliases, resolution of labels, lexicon scans of texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as C
from ..functions.text import gene_key, token_key


def alias_index(lexicon: DataFrame) -> DataFrame:
    """token, symbol: each symbol for itself, each alias or former symbol for the first entry (by ordinal) that lists it and is no symbol itself.

    lexicon has ordinal, symbol, alias_symbol and prev_symbol.
    """
    none = F.array().cast("array<string>")
    own = lexicon.select(F.upper("symbol").alias("token"), F.upper("symbol").alias("symbol"), "ordinal", F.lit(0).alias("rank"), F.lit(0).alias("place"))
    listed = lexicon.select(F.upper("symbol").alias("symbol"), "ordinal", F.posexplode(F.concat(F.coalesce("alias_symbol", none), F.coalesce("prev_symbol", none))).alias("place", "alias"))
    listed = listed.select(gene_key("alias").alias("token"), "symbol", "ordinal", F.lit(1).alias("rank"), "place").where("token <> ''")
    both = own.unionByName(listed)
    return both.groupBy("token").agg(F.min_by("symbol", F.struct("rank", "ordinal", "place")).alias("symbol"), F.min(F.struct("rank", "ordinal", "place")).alias("at"))


def resolve(mentions: DataFrame, lexicon: DataFrame, label: str = "label") -> DataFrame:
    """Adds symbol and resolution (local_symbol, local_alias, local_alias_norm, unresolved or empty) to mentions."""
    index = alias_index(lexicon)
    exact = index.select(F.col("token").alias("_key"), F.col("symbol").alias("_exact"), (F.col("at.rank") == 0).alias("_own"))
    plain = index.where(token_key("token") != "").groupBy(token_key("token").alias("_norm")).agg(F.min_by("symbol", F.struct("at.rank", "at.ordinal", "at.place")).alias("_plain"))
    m = mentions.withColumn("_key", gene_key(label)).withColumn("_norm", F.nullif(token_key(F.coalesce(F.col(label), F.lit(""))), F.lit("")))
    m = m.join(exact, "_key", "left").join(plain, "_norm", "left")
    return m.withColumns({
        "symbol": F.coalesce("_exact", "_plain"),
        "resolution": F.when(F.col("_key") == "", "empty").when(F.col("_own"), "local_symbol").when(F.col("_exact").isNotNull(), "local_alias").when(F.col("_plain").isNotNull(), "local_alias_norm").otherwise("unresolved"),
    }).drop("_key", "_norm", "_exact", "_own", "_plain")


def normalization_note(label: Column | str, symbol: Column | str, source: Column | str) -> Column:
    lab, sym, src = (F.col(x) if isinstance(x, str) else x for x in (label, symbol, source))
    return F.when(sym.isNull(), "").when(gene_key(lab) != sym, F.concat(F.trim(lab), F.lit("->"), sym, F.lit(" ("), src, F.lit(")"))).otherwise(src)


def shortened(word: Column | str, most: int) -> Column:
    """A word and every string that comes of leaving out up to `most` of its letters, each once."""
    w = F.col(word) if isinstance(word, str) else word
    one = lambda x: F.transform(F.sequence(F.lit(1), F.length(x)), lambda i: F.concat(F.substring(x, F.lit(1), i - 1), F.substring(x, i + 1, F.length(x))))
    every = last = F.array(w)
    for _ in range(most):
        last = F.array_distinct(F.flatten(F.transform(F.filter(last, lambda x: x != ""), one)))
        every = F.concat(every, last)
    return F.array_distinct(every)


def near_symbols(labels: DataFrame, symbols: DataFrame, farthest: int = 3) -> DataFrame:
    """label, symbol, distance of all pairs at an edit distance of at most `farthest`.

    Two words so near have a string in common that is left when each loses up to that many letters, so both sides
    meet in an equi-join on such strings; the exact distance decides. A label much longer than every symbol meets none and is
    left out first, which bounds the strings of a label by the longest symbol.
    """
    longest = symbols.agg(F.coalesce(F.max(F.length("symbol")), F.lit(0))).first()[0]
    a = labels.select("label").distinct().where(F.length("label") <= longest + farthest).select("label", F.explode(shortened("label", farthest)).alias("_k"))
    b = symbols.select("symbol").distinct().select("symbol", F.explode(shortened("symbol", farthest)).alias("_k"))
    met = a.join(b, "_k").where(F.abs(F.length("label") - F.length("symbol")) <= farthest).select("label", "symbol").distinct()
    return met.withColumn("distance", F.levenshtein("label", "symbol")).where(F.col("distance") <= farthest)


def suggestions(labels: DataFrame, lexicon: DataFrame, label: str = "label", n: int = 3, farthest: int = 3) -> DataFrame:
    """The n symbols that are nearest to each label, whatever letter they begin with, nearest first and then by name; of one at least a letter has to stay."""
    near = near_symbols(labels.select(gene_key(label).alias("label")).where("label <> ''"), lexicon.select(F.upper("symbol").alias("symbol")), farthest)
    near = near.where(F.col("distance") < F.greatest(F.length("label"), F.length("symbol")))
    w = Window.partitionBy("label").orderBy("distance", "symbol")
    top = near.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= n)
    return top.groupBy("label").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", "symbol"))), lambda x: x["symbol"]), "; ").alias("suggestions"))


def scan(texts: DataFrame, lexicon: DataFrame, id_column: str = "pmid", text_column: str = "text", cap: int = C.LEXICON_CAP) -> DataFrame:
    """Canonical symbols that a text names, by first appearance, at most cap of them: id, gene, position.

    Only tokens in capitals, with a digit or with a hyphen count, and no aliases.
    """
    tokens = F.regexp_extract_all(F.coalesce(F.col(text_column), F.lit("")), F.lit(C.LEXICON_TOKEN), F.lit(0))
    # Other tokens go before each becomes a row of its own.
    counts = lambda x: (x == F.upper(x)) | x.rlike(r"[0-9\-]")
    placed = F.filter(F.transform(tokens, lambda x, k: F.struct(k.alias("position"), x.alias("token"))), lambda x: counts(x["token"]))
    t = texts.select(id_column, F.inline(placed))
    t = t.groupBy(id_column, F.upper("token").alias("token")).agg(F.min("position").alias("position"))
    symbols = lexicon.select(F.upper("symbol").alias("token")).distinct()
    hit = t.join(symbols, "token", "left_semi")
    w = Window.partitionBy(id_column).orderBy("position")
    return hit.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= cap).select(id_column, F.col("token").alias("gene"), "position")
