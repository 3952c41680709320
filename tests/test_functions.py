import re
import time
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from glossa import constants as C
from glossa.functions import scoring, text


def values(spark, column, rows):
    df = spark.createDataFrame([(k, r) for k, r in enumerate(rows)], "k int, v string")
    return [r[0] for r in df.orderBy("k").select(column(F.col("v"))).collect()]


@pytest.mark.parametrize(
    "function, given, want",
    [
        (text.normalize_slashes, ["5⁄6", r"671 \upmu g", "3 mu g/l", "µl", None], ["5/6", "671 μ g", "3 μg/l", "μl", None]),
        (text.normalize_drift, ["so­ft", "expres-\nsion", "a–b—c", "ﬁnd ﬄ"], ["soft", "expression", "a-b-c", "find ffl"]),
        (text.numbers, ["p<0.05, 12 of 3.5.", "none", None], [["0.05", "12", "3.5"], [], None]),
        (text.sentences, ["One. Two!  Three\nfour?", "", None, "..."], [["One.", "Two!", "four?"], [], [], []]),
        (text.word_count, ["a  b\nc", "", "  ", None], [3, 0, 0, 0]),
        (text.estimate_tokens, ["one two three", None], [3, 0]),
        (text.journal_key, ["The Journal of X-Ray, Ltd."], ["journal of xray ltd"]),
        (text.format_issn, ["12345678", "1234-567x", "12"], ["1234-5678", "1234-567X", None]),
        (text.normalize_placeholder, [" N/A ", "No Evidence", "found", None], ["", "", "found", ""]),
        (text.quoted_citation, ['Answer. Citation: "quoted text here"', "[Citation: bracketed words]", "nothing", None], ["quoted text here", "bracketed words]", "", ""]),
        (text.natural_key, ["a10b", "a9b"], ["a000000000010b", "a000000000009b"]),
        (text.strip_tags, ["<p>a <b>b</b></p>"], ["a b"]),
    ],
)
def test_text(spark, function, given, want):
    assert values(spark, function, given) == want


@pytest.mark.parametrize("variant, name", [("p.Val600Glu", "hgvs_protein"), ("p.V600E", "hgvs_protein_short"), ("L858R", "amino_acid_substitution"), ("c.35delG", "deletion"), ("c.5_6delinsA", "deletion_insertion"), ("delins", "deletion_insertion"), ("dup", "duplication"), ("fs12", "frameshift_simple"), ("p.Lys5fs*3", "frameshift_hgvs"), ("Exon 19 deletion", "exon_deletion"), ("exon 20 ins", "exon_insertion"), ("X123", "nonsense"), ("inv(3)(q21q26.2)", "inversion_cytogenetic"), ("g.1000_2000inv", "inversion_genomic"), ("g.5A>T", "hgvs_genomic"), ("", "empty"), ("unclear", "no_match")])
def test_variant_classes(spark, variant, name):
    assert values(spark, text.variant_class, [variant]) == [name]


def test_hla_variants_follow_their_locus(spark):
    df = spark.createDataFrame([("HLA-B", "B27:05"), ("HLA-B", "A02"), ("TNF", "B27"), ("HLA-A", "HLA A*02:01"), ("HLA-A", None), ("HLA-A", "none")], "g string, v string")
    assert [r[0] for r in df.select(text.normalize_variant("g", "v")).collect()] == ["HLA-B*27:05", "A02", "B27", "HLA-A*02:01", "", ""]


def test_lists_keep_the_first_spelling(spark):
    df = spark.createDataFrame([Row(x=[" A", "b", "a", "", "B ", "c"]), Row(x=[])], "x array<string>")
    assert [r[0] for r in df.select(text.normalize_list("x")).collect()] == [["A", "b", "c"], []]


def test_sections(spark):
    t = "Title\nIntroduction: one\n\ntwo\nMethods three"
    assert values(spark, text.sections, [t]) == [["Title", "one", "two", "three"]]
    assert values(spark, lambda c: text.keep_leading_sections(c, 2), [t]) == ["Title\n\none"]
    assert values(spark, lambda c: text.truncate_words(c, 3), ["a b c d e"]) == ["a b c d"]


def test_content(spark):
    good = "Abstract introduction methods. " * 300
    df = spark.createDataFrame([(good, ""), ("short", ""), ("é" * 200 + "x" * 200, "https://x/articles/1"), ("advertisement sponsored content most popular trending now " * 4, "")], "t string, u string")
    df = df.withColumn("c", text.clean_content("t"))
    assert [r[0] for r in df.select(text.content_type("c", "u")).collect()] == ["full_article", "empty", "full_article", "low_quality"]
    assert df.select(text.content_quality("c")).first()[0] == pytest.approx(0.3 + 0.1 + 0.2 + 0.15)
    assert df.where(text.is_good_content("c", text.content_quality("c"), text.content_type("c", "u"), F.lit(None).cast("string"))).count() == 1


def test_abstract_scores(spark):
    genetic = "We report a BRCA1 mutation c.68A>G and rs12345 associated with breast cancer. Sequencing of TP53 found p.Val600Glu and p.Val600Glu in tumours of many patients."
    clinical = "This systematic review covers rehabilitation and quality of life in patients with IL6 and IL6 measured at baseline, over many years of follow up in hospitals."
    df = spark.createDataFrame([("g", genetic), ("c", clinical), ("s", "short"), ("n", None)], "title string, abstract string")
    got = {r["title"]: r for r in scoring.with_abstract_parts(df).collect()}
    ui = {r["title"]: r for r in scoring.with_abstract_parts(df, distinct_variants=False).collect()}
    assert got["g"]["parts"]["n_symbols"] == 2 and got["g"]["parts"]["context"]
    assert ui["g"]["parts"]["score"] - got["g"]["parts"]["score"] == 3 * (ui["g"]["parts"]["n_variants"] - got["g"]["parts"]["n_variants"]) > 0
    # Three negative phrases, one symbol without molecular context: -15 + 2 - 4.
    assert got["c"]["parts"]["score"] == -17
    assert got["s"]["parts"] is None and got["n"]["parts"] is None
    own = scoring.Signals(keywords={"tumours": 7}, negatives=(), phrases=(), symbols=("ZZZ",))
    assert scoring.with_abstract_parts(df, own).where("title = 'g'").first()["parts"]["positive"] == ["tumours"]


def test_scores(spark):
    df = spark.createDataFrame([(10, 100, 25), (0, 30, -3), (500, 35, 7)], "c int, q int, s int")
    got = df.select(scoring.composite_score(F.col("c"), F.col("q")), scoring.genetics_signal(F.col("s")), scoring.tier(F.col("s")), scoring.recommendation(F.col("q"), F.col("c"))).collect()
    assert [tuple(r) for r in got] == [(43, 100, "high", 69), (12, 0, "none", 20), (74, 35, "medium", 100)]
    assert C.QUARTILE_SCORES["Q1"] == 100


def test_sentences_of_odd_texts_and_of_a_long_line(spark):
    """The same as the plain pattern's; a line without an end of sentence costs no more than its length."""
    odd = ["", ".", "a", "a.b?!c\nd e\n\nf!", "no end\n", "\n\n", "..a..\n.b", "x\ny.", "a \n b", "end!\n"]
    rows = spark.createDataFrame([(t,) for t in odd], "t string").select("t", text.sentences("t").alias("s")).collect()
    for r in rows:
        assert r["s"] == [x for x in (" ".join(m.split()) for m in re.findall(r"[^.!?\n]+(?:[.!?]+|$)", r["t"])) if x]
    start = time.monotonic()
    long = spark.range(1).select(text.sentences(F.concat(F.repeat(F.lit("x"), F.lit(400_000)), F.lit("\nEnd."))).alias("s"))
    assert long.first()["s"] == ["End."] and time.monotonic() - start < 20


def test_content_is_cleaned_and_counted_once(spark):
    """The same as plain patterns give; a text's chain of replacements stands once in the plan, and its counts are columns."""
    body = "Results:\r\n\n\n\nα gene  \t\t of p. \r " + "word \t\n" * 30
    df = spark.createDataFrame([(x,) for x in (body, "\n\t " + body + " \r\n", "é" * 200, "short", None, " a\rb " * 40)], "t string").withColumn("k", text.clean_content("t"))
    for r in df.collect():
        want = r["t"] or ""
        for sign, word in C.GREEK.items():
            want = want.replace(sign, word)
        for pattern, by in ((r"[^\x00-\x7F]+", " "), (r"[ \r]+", " "), (r"\t+", "\t"), (r"\n{3,}", "\n\n"), (r"^\s+|\s+\Z", "")):
            want = re.sub(pattern, by, want)
        assert r["k"] == (want if len(want) >= 100 else "")
    counted, n = text.with_content_counts(df, "k")
    both = counted.select(text.content_type("k", F.lit("")), text.content_type("k", F.lit(""), n), text.content_quality("k"), text.content_quality("k", n)).collect()
    assert all(r[0] == r[1] and r[2] == r[3] for r in both)
    plan = df.select("k")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(r"\n{3,}") == 1
