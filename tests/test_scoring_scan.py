"""The search for terms behind gates and the boundaries behind first letters, against what they stand for."""

import re

from pyspark.sql import functions as F

from glossa import constants as C
from glossa import queries
from glossa.functions import scoring

TEXTS = ["lncrna and mrna near expression of", "gene expressioneditingvariants in", "overviewperspective quality of lifeloss of", "exonintronexom", "plain", "", None, "mutation mutations in mutationmutations"]


def test_terms_that_overlap_or_contain_each_other_are_all_found(spark):
    groups = [list(C.GENETIC_KEYWORDS), C.NEGATIVE_KEYWORDS, C.GENE_PHRASES, C.MOLECULAR_CONTEXT, ["ab", "abcd", "b", "bc", "a"]]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate([*TEXTS, "xabcx abce", *sum(groups, [])])], "k int, t string")
    gates = scoring._gates(sum(groups, []))
    assert all(g in t for t, g in gates.items()) and len(set(gates.values())) < len(gates) / 2
    seen = rows.withColumn("o", F.array(*[F.contains("t", F.lit(g)) for g in dict.fromkeys(gates.values())]))
    for r in seen.select("t", *[scoring._found(F.col("t"), g, gates, F.col("o")).alias(f"g{n}") for n, g in enumerate(groups)]).collect():
        assert [r[f"g{n}"] for n in range(len(groups))] == [[x for x in g if x in (r["t"] or "")] for g in groups], r["t"]


def test_a_boundary_behind_the_first_letters_is_the_same_boundary(spark):
    texts = ["rs12345 xrs12345 _rs123456 -rs99999 érs12345 rs1234", "L858R xL858R LL858R é858R éL858R L858Rx L8589R.V600E", "A1B22 EGFR1_ _EGFR1 éEGFR1 aEGFR"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    patterns = [*C.VARIANT_SIGNS, r"\b[a-z]{2}\d+", r"\b[A-Z-]\d", r"\bab+|\bL8", r"\bx?rs"]
    plain = lambda p: re.sub(r"\\b", lambda m: scoring._ASCII_BOUND, p)
    for p in patterns:
        for was, now in ((p, scoring._bound_behind(p)), (plain(p), scoring._ascii_bounds(p))):
            r = rows.select(scoring._all(F.col("t"), was).alias("was"), scoring._all(F.col("t"), now).alias("now")).collect()
            assert [x["was"] for x in r] == [x["now"] for x in r], p
    assert scoring._bound_behind(r"\brs\d{5,}") == r"rs(?<=\brs)\d{5,}"


def test_scores_are_worked_out_once(spark, sf_dir):
    """A filter on scores took their whole expression along, with all its searches, many times."""
    most = sum(map(len, (C.GENETIC_KEYWORDS, C.NEGATIVE_KEYWORDS, C.GENE_PHRASES, C.MOLECULAR_CONTEXT))) * 3 // 2
    for name in ("screening_summary", "screening_scores", "relevance_scores", "paper_scores", "selected_bands"):
        plan = queries.QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Contains(") <= most, name
