"""Queries on rows that the given tables or the SQL comparison leave out, against brute force."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from glossa import constants as C
from glossa import queries, queries_literature

GREEK_TEXT = "Die α-Kette und naïve T-Zellen, 12.5 mg 中文 in 40 Fällen. " * 4


def folder(spark, tmp_path, texts, items=()):
    rows = [(i, t, "de", "src2", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    if items:
        spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


def test_short_passages_are_cited(spark, tmp_path, monkeypatch):
    texts = ["See the quick brown foxes run", "the quick brown fox.", "The  Quick\nbrown fox jumps high", "a fox", "", None]
    monkeypatch.setattr(queries_literature, "SHORT_AT_ONCE", 2)
    items = ["the quick brown fox", "fox", "brown fox jumps", "the quick brown fox jumps", "quick brown fox jumps high", "nowhere", None]
    got = sorted(tuple(r) for r in queries.QUERIES["citations_exact"](spark, folder(spark, tmp_path, texts, items)).select("item_id", "doc_id").collect())
    plain = lambda t: " ".join(t.lower().split())
    assert got == [(i, d) for i, q in enumerate(items) for d, t in enumerate(texts) if q is not None and t is not None and plain(q) in plain(t)]


def test_all_texts_are_cleaned_and_measured(spark, tmp_path):
    texts = [GREEK_TEXT, "plain words only " * 10, "é" * 200, "", None]
    sf = folder(spark, tmp_path, texts)
    cleaned = []
    for t in texts:
        k = t or ""
        for greek, name in C.GREEK.items():
            k = k.replace(greek, name)
        k = re.sub(r"[ \r]+", " ", re.sub(r"[^\x00-\x7F]+", " ", k)).strip()
        cleaned.append(hashlib.md5((k if len(k) >= 100 else "").encode()).hexdigest())
    got = {r["doc_id"]: r for r in queries.QUERIES["content_cleaned"](spark, sf).collect()}
    assert [got[i]["clean_md5"] for i in range(len(texts))] == cleaned
    measured = {int(r["pmid"]): r for r in queries.QUERIES["text_measures"](spark, sf).collect()}
    from glossa.tables import SENTENCES

    whole = ["" if t is None else t + SENTENCES.get(i, "") for i, t in enumerate(texts)]
    assert [measured[i]["n_words"] for i in range(len(texts))] == [len(t.split()) for t in whole]
    assert [measured[i]["n_numbers"] for i in range(len(texts))] == [len(re.findall(r"\b\d+(?:\.\d+)?\b", t)) for t in whole]


@pytest.mark.parametrize("name", ["content_cleaned", "text_measures"])
def test_no_text_is_left_out(spark, sf_dir, name):
    assert queries.QUERIES[name](spark, sf_dir).count() == spark.read.parquet(f"{sf_dir}/documents.parquet").count()


def test_papers_without_a_search_rank_stand_on_pages(spark, sf_dir):
    got = queries.QUERIES["ranked_pages"](spark, sf_dir)
    assert got.where(F.col("pmid").cast("long") % 13 == 0).count() > 0


def test_passages_are_found_in_one_pass_or_by_their_words(spark, tmp_path, monkeypatch):
    texts = ["Alpha  beta\tgamma delta epsilon zeta", "beta–gamma mu g of it; xmu g \\alpha", "", None, "emu\ng and mu  g ⁄ ﬁne", "gamma delta epsilon zetas"]
    items = ["beta gamma delta epsilon zeta", "gamma delta epsilon", "a", "", None, "μg of", "beta-gamma μg of it; xmu", "nowhere at all in any text", "a"]
    sf = folder(spark, tmp_path, texts, items)
    pairs = lambda df: sorted(tuple(r) for r in df.select("item_id", "doc_id").collect())
    scanned = queries.QUERIES["citations_exact"](spark, sf)
    plan = scanned._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "MapInArrow" in plan
    want = [(0, 0), (1, 0), (1, 5), (2, 0), (2, 1), (2, 4), (2, 5), *[(3, d) for d in (0, 1, 2, 4, 5)], (5, 1), (6, 1), (8, 0), (8, 1), (8, 4), (8, 5)]
    assert pairs(scanned) == want
    monkeypatch.setattr(queries_literature, "CHARACTERS_AT_ONCE", 4)
    assert pairs(queries.QUERIES["citations_exact"](spark, sf)) == want
