"""Loosely matched quotes: what is read, compared and spread over tasks, against brute force."""

import difflib
import random

import pytest
from pyspark.sql import functions as F

from glossa import queries
from glossa.functions import text
from glossa.operators import citations


def test_windows_that_cannot_be_better_are_not_compared(monkeypatch):
    """A quote's frequent words, which stand in a window more often than in the quote, raised the bound of windows that were then compared for nothing."""
    quote = "the cell and the gene of one mouse are altered in this old study".split()
    words = (["x"] + [w for w in quote if w != "altered"] + ["the", "of", "and"] * 30 + ["y"]) * 3
    compared = []

    class Counted(difflib.SequenceMatcher):
        def ratio(self):
            compared.append(1)
            return super().ratio()

    monkeypatch.setattr(citations.difflib, "SequenceMatcher", Counted)
    ratio, j = citations.closest_window(quote, words, 0.7)
    monkeypatch.undo()
    every = [difflib.SequenceMatcher(None, quote, words[k : k + len(quote) + 3]).ratio() for k in range(len(words) - len(quote) + 1)]
    assert ratio == max(every) == every[j] and len(compared) <= 2


def test_windows_are_those_of_all_comparisons():
    rng = random.Random(3)
    for _ in range(300):
        kinds, n, least = rng.choice([2, 4, 9]), rng.randrange(1, 16), rng.choice([0.0, 0.7, 0.85])
        quote, words = [[f"w{rng.randrange(kinds)}" for _ in range(m)] for m in (n, rng.randrange(1, 50))]
        every = [difflib.SequenceMatcher(None, quote, words[k : k + n + 3]).ratio() for k in range(max(1, len(words) - n + 1))]
        ratio, j = citations.closest_window(quote, words, least)
        assert ratio == (max(every) if max(every) >= least else 0.0) and (every[j] == ratio if ratio else j == -1)


def test_leading_words_are_those_of_the_whole_text(spark):
    texts = ["", " ", "\n a", "a", "a  b\t\tc\n\nd  e ", "  a b c d", "a b c d e f", "é\u00a0x b\r\nc d e", "a b c d  ", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    first = lambda c: F.slice(F.split(text.squeezed(c), " "), 1, 4)
    for r in rows.select("t", text.leading_words("t", 4).alias("lead"), first(F.col("t")).alias("was"), first(text.leading_words("t", 4)).alias("now")).collect():
        assert r["now"] == r["was"] and (r["t"] is None or r["t"].startswith(r["lead"])), r["t"]
    long = spark.createDataFrame([("a b c d " + "e " * 100,)], "t string")
    assert long.select(text.leading_words("t", 4)).first()[0] == "a b c d"


def test_texts_are_normalized_alike_whether_wide_or_not(spark):
    texts = ["5⁄6 and 7∕8", r"671 \upmu g \alpha \pm 1 \leq", "3 mu g/l, emu g", "µl of so\u00adft", "expres-\nsion – a—b‑c", "ﬁnd ﬄ -\n", "caf\u00e9 \u00b5 -\nx x-\ny", "plain", "", None, "数 mu L \\beta\u00ad-\n"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in rows.select("t", text.normalized("t").alias("now"), text.normalize_drift(text.normalize_slashes("t")).alias("each")).collect():
        assert r["now"] == r["each"], r["t"]
    plain = lambda t: t.replace("µ", "μ").replace("\u00ad", "")
    assert [x[0] for x in rows.where(F.col("t").isin("µl of so\u00adft", "plain", "")).select(text.normalized("t")).collect()] == [plain("µl of so\u00adft"), "plain", ""]


def expected(t):
    """found and ratio of the query's quote, which has its own thirteenth word changed."""
    if t is None:
        return False, 0.0
    words = t.split()
    quote = [w.lower() for w in words[2:12] + ["altered"] + words[13:23]]
    low = [w.lower() for w in words]
    if not words or " ".join(quote) in " ".join(low):
        return bool(words), float(bool(words))
    if len(quote) < citations.LOOSE_WORDS:
        return False, 0.0
    best = max(difflib.SequenceMatcher(None, quote, low[j : j + len(quote) + 3]).ratio() for j in range(max(1, len(low) - len(quote) + 1)))
    return (True, best) if best >= 0.85 else (False, 0.0)


@pytest.fixture
def odd_texts(spark, tmp_path):
    rng = random.Random(5)
    texts = [" ".join(f"w{rng.randrange(k)}" for _ in range(n)) for k in (3, 9, 400) for n in (1, 2, 5, 12, 13, 14, 22, 23, 24, 60)]
    texts += ["", "  ", None, "\n\n  Lead  " + "\t".join(f"V{k}" for k in range(40)) + "  \n", "altered " * 30, "same text here " * 50]
    spark.createDataFrame([(i, t, "de", "s", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path), texts


def test_loose_quotes_of_odd_texts(spark, odd_texts):
    sf, texts = odd_texts
    got = {int(r["pmid"]): (r["found"], r["ratio"]) for r in queries.QUERIES["citations_fuzzy"](spark, sf).collect()}
    for i, t in enumerate(texts):
        found, ratio = expected(t)
        if t is None:
            assert not got[i][0]
        else:
            assert got[i] == (found, pytest.approx(ratio, abs=1e-6)), t


def test_quotes_go_to_the_tasks_of_their_texts(spark, odd_texts):
    """Small texts were broadcast to their quotes, which fit in one task: that one did all comparisons. Quotes were cut from whole squeezed texts."""
    query = queries.QUERIES["citations_fuzzy"](spark, odd_texts[0])._jdf.queryExecution()
    assert "strategy=merge" in query.optimizedPlan().toString()
    plan = query.executedPlan().toString()
    below = plan[plan.index("loose_place") :].split("HashAggregate")[0]
    assert "SortMergeJoin" in below and "BroadcastHashJoin" not in below
    assert "split(trim(regexp_replace(text#" not in plan
