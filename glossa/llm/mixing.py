"""Mixing sources to target weights by systematic sampling, with DataFrame functions only.

The sources of a corpus get weights and share a target number of words; no target
is above a multiple of its source's size, and what is left over is shared again by
weight until none is. A source's target over its size is the expected number of
copies of each of its documents. Within a source documents stand in order of size;
the running sum of expected copies, with one random offset of the source's own, is
cut at integers, and a document is taken once for each integer that its own stretch
crosses. So it is taken the rounded-down or the rounded-up number of times, and as
neighbours in the order are alike in size, the words that a source gives differ from
its target by no more than about its largest document.

How it runs: sizes are counted once and written, as narrow rows. These are dealt to
ranges of (source, size, id) and sorted there, so a source of any share is spread
over many tasks; a place within a source is a place within its part of a range plus
the rows of the ranges before, one number for each source and range. Expected copies
are whole multiples of 2^-30, so running sums are exact and no order of summation
changes the result.

Defined cases: a null text has no words and is taken like any other document; null
sources are one source, the last; an empty source name is a source of its own; a
source without words has the target 0 and nothing of it is taken; rows that are
repeated are documents of their own, and which of equal rows comes first does not
matter; null ids come first among documents of one size; an empty table gives no
rows; other columns of any name travel along untouched in mix().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ordering import with_ordinal
from .common import PARTITIONS, drop, shards_for, shared_table

#: Weights of the sources in order of their names, repeating.
WEIGHTS = (3, 1, 2)
#: Words of the mix, in hundredths of the corpus.
PERCENT = 150
#: A target is at most so many times its source's size.
MOST = 2
#: Names this sample: another seed gives other offsets.
SEED = "mix-1"
#: Bytes of narrow rows for which a range is added.
RANGE_BYTES = 32 << 20
#: Bytes of a narrow row, about.
_ROW_BYTES = 64
#: Rows of source-and-range figures up to which they are broadcast: some 100 bytes each, 10 MB in all.
BROADCAST_ROWS = 100_000

_WORD = r"[^\x20\x09-\x0D]+"
_BITS = 30
_ONE = 1 << _BITS
_SHIFT = 33


def words(text: Column) -> Column:
    """The number of words between ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(_WORD)), F.lit(0)).cast("long")


def _exact(c: Column) -> Column:
    return c.cast("decimal(38,0)")


def source_targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, percent: int = PERCENT, most: int = MOST) -> DataFrame:
    """Adds to sources (source, source_size, n_docs), a row each, weight and target.

    Sources above the highest target allowed get that; what remains is shared by weight among the others, again until
    none is above. Only sums come to the driver; comparisons are between whole numbers.
    """
    named = with_ordinal(sources, [F.col("source").asc_nulls_last()], "place")
    own = F.array(*map(F.lit, weights))[F.pmod(F.col("place") - 1, F.lit(len(weights))).cast("int")].cast("long")
    t = shared_table(named.select("source", "source_size", "n_docs", own.alias("weight")), "mix-weights")
    total = t.agg(F.sum("source_size")).first()[0] or 0
    over = F.lit(False)
    # What is left for the open sources is num / den words for each unit of weight.
    num, den = percent * total, 100 * (t.agg(F.sum("weight")).first()[0] or 1)
    while True:
        # A source once above stays so: each round leaves more for the others.
        above = _exact(F.lit(num)) * F.col("weight") > _exact(F.lit(most * den)) * F.col("source_size")
        got = t.agg(F.sum(F.when(above, F.col("source_size"))).alias("size"), F.sum(F.when(~above, F.col("weight"))).alias("weight")).first()
        over = above
        left, weight = percent * total - 100 * most * (got["size"] or 0), got["weight"]
        if weight is None or (left, 100 * weight) == (num, den):
            break
        num, den = left, 100 * weight
    target = F.when(over, F.col("source_size") * F.lit(float(most))).otherwise(F.col("weight") * F.lit(float(num)) / F.lit(float(den)))
    return t.withColumn("target", target.cast("double"))


def _offset(source: Column, seed: str) -> Column:
    """A source's random offset, in units of 2^-30."""
    digest = F.md5(F.concat(F.lit(seed), F.when(source.isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), source))).cast("binary"))
    return F.conv(F.substring(digest, 1, 7), 16, 10).cast("long") * 4


def copies(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, percent: int = PERCENT, most: int = MOST, seed: str = SEED, keep: Column | None = None) -> DataFrame:
    """A row for each document: doc_id, source, size, source_size, target, copies; and keep, if a column is given for it."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), words(F.col("text").cast("string")).alias("size"), *([keep.alias("keep")] if keep is not None else []))
    sizes = shared_table(rows, "mix-sizes")
    sources = shared_table(sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs")), "mix-sources")
    targets = source_targets(sources, weights, percent, most)
    n = sources.agg(F.sum("n_docs")).first()[0] or 0
    ranges = min(PARTITIONS, shards_for(n * _ROW_BYTES, RANGE_BYTES))
    # The row's own number comes last, so that even rows repeated without end are dealt to many ranges.
    order = [F.col("source").asc_nulls_last(), F.col("size"), F.col("doc_id").asc_nulls_first(), F.col("row")]
    dealt = sizes.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(max(ranges, docs.sparkSession.sparkContext.defaultParallelism), *order).sortWithinPartitions(*order).drop("row")
    placed = shared_table(dealt.withColumn("at", F.monotonically_increasing_id()), "mix-placed")
    part = F.shiftright("at", _SHIFT).cast("int")
    parts = placed.groupBy("source", part.alias("part")).agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rate = F.when(F.col("source_size") == 0, F.lit(0)).otherwise(F.floor(F.col("target") / F.col("source_size") * F.lit(float(_ONE)))).cast("long")
    known = targets.select(F.col("source").alias("of"), "source_size", "target", F.least(rate, F.lit(most * _ONE)).alias("rate"), _offset(F.col("source"), seed).alias("shift"))
    figures = shared_table(
        parts.withColumn("before", before).join(known, F.col("source").eqNullSafe(F.col("of"))).select(F.col("source").alias("of"), F.col("part").alias("in_part"), (F.col("before") - F.col("first")).alias("to_place"), "source_size", "target", "rate", "shift"), "mix-figures"
    )
    few = figures.count() <= BROADCAST_ROWS
    joined = placed.join(F.broadcast(figures) if few else figures, F.col("source").eqNullSafe(F.col("of")) & (part == F.col("in_part")))
    # Where the stretch of a document begins, past an integer: factors stay below 2^31 and 2^30.
    begins = (F.col("rate") * (F.col("at") + F.col("to_place")).bitwiseAND(_ONE - 1) + F.col("shift")).bitwiseAND(_ONE - 1)
    taken = F.shiftright(begins + F.col("rate"), _BITS).cast("int")
    drop(sizes, sources)
    return joined.select("doc_id", "source", "size", "source_size", "target", taken.alias("copies"), *(["keep"] if keep is not None else []))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, percent: int = PERCENT, most: int = MOST, seed: str = SEED) -> DataFrame:
    """The mixed corpus: every document as often as it is taken, with all its columns."""
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    taken = copies(docs, weights, percent, most, seed, keep=row).where("copies > 0")
    return taken.select("keep", F.explode(F.sequence(F.lit(1), "copies"))).select("keep.*")


def mix_digest(docs: DataFrame) -> DataFrame:
    """Per document row: doc_id, size, source_size, target, taken (words of the mix, repeats counted)."""
    return copies(docs).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))
