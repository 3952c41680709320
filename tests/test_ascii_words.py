"""Symbols that touch letters beyond ASCII: the scores' SQL takes such letters for no part of a word."""

import duckdb
import pytest

from glossa import queries

#: A symbol behind such a letter, before one, and one within an ASCII word; variants likewise.
TEXTS = ["ÑÍGATA!! casa y mutation. ", "BRCA1ß und xEGFRx. ", "éL858R, KRASé, rs12345ü, _TNF ", "ÄrsÄrs99999 T790MÖ mutation _MYC2 "]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    where = str(tmp_path_factory.mktemp("letters"))
    rows = [(k, TEXTS[k // 80] + "lorem ipsum dolor " * 6, ("en", "fr", "de", "es")[k % 4], "src1", 0) for k in range(80 * len(TEXTS))]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{where}/documents.parquet")
    return where


@pytest.mark.parametrize("name", ["relevance_scores", "screening_scores", "screening_summary", "paper_scores", "selected_bands"])
def test_letters_beyond_ascii_bound_words(spark, folder, name):
    got = queries.QUERIES[name](spark, folder)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{folder}/documents.parquet/*.parquet')")
    want = con.execute(queries.ORACLE_SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(map(str, (tuple(r[c] for c in columns) for r in got.collect()))) == sorted(map(str, want.fetchall()))
