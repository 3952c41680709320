import json

import pytest
from pyspark.sql import functions as F

from glossa.operators import reports
from glossa.sources import search


def test_search(spark):
    p = spark.createDataFrame([("1", "BRCA1 study", "tumour", "2001", ["Journal Article"], True, ["A"], 2), ("2", "BRCA1 review", "tumour", "2005", ["Review"], True, ["A", "B"], 1), ("3", "BRCA1 mouse", "", "N/A", ["Journal Article"], True, [], 3), ("4", "brca1", None, "2010", ["Letter x"], False, ["B"], None)], "pmid string, title string, abstract string, year string, publication_types array<string>, is_open_access boolean, authors array<string>, search_rank int")
    found = search.search(p, search.predicate(every=["brca1"], none_of=["mouse"]), 10)
    assert [r["pmid"] for r in found.collect()] == ["1"]
    assert [r["pmid"] for r in search.search(p, search.predicate(any_of=["tumour", "brca1"]), 10, types=False, open_access=False).collect()] == ["2", "1", "4"]
    a = search.audit(found, "q", True, True).first()
    assert a["returned"] == 1 and a["effective_query"].startswith("((q) AND NOT Review[Publication Type]")
    assert [r["pmid"] for r in search.by_author(p, "B").collect()] == ["2", "4"]
    assert search.within_limit(found, 0).count() == 0 and search.within_limit(found, 1).count() == 1
    assert search.query_text(["a"], ["b", "c"], ["d"], (2000, 2001)) == "(a AND (b OR c) NOT (d)) AND 2000:2001[dp]"
    assert search.author_query("X Y", ["k"]) == 'X Y[Author] AND ("k") AND 1900:2099[dp]'
    forms = spark.createDataFrame([("a", "full", 5), ("a", "short", 50), ("b", "full", 0), ("b", "short", 3)], "author string, form string, n int")
    assert {r["author"]: r["form"] for r in search.better_name_form(forms).collect()} == {"a": "full", "b": "short"}


def test_fetching(spark):
    asked = spark.createDataFrame([("1",), ("2",), ("3",)], "pmid string")
    text = "pmid string, text string, method string, n_tables int, n_figures int"
    a, b = spark.createDataFrame([("1", "x" * 5, "pmc", 1, 0)], text), spark.createDataFrame([("1", "y" * 2000, "epmc", 2, 1), ("2", "z" * 3000, "epmc", 0, 0)], text)
    got = search.full_texts(asked, [a, b], F.length("text") >= 1000)
    report = search.fetch_report(got)
    assert {r["pmid"]: (r["method"], r["length"]) for r in report.collect()} == {"1": ("epmc", 2000), "2": ("epmc", 3000), "3": (None, 0)}
    assert tuple(search.fetch_statistics(report).first()) == (2, 1, 2, 1, 1)
    ids = spark.createDataFrame([("1", "1", "PMC1"), ("2", "9", "PMC9")], "pmid string, requested_pmid string, pmc string")
    assert {r["pmid"]: r["pmc"] for r in search.converted(asked, ids).collect()} == {"1": "PMC1", "2": None, "3": None}
    n = "pmid string, count int"
    assert {r["pmid"]: r["count"] for r in search.citation_batch(spark.createDataFrame([("1", 4)], n), spark.createDataFrame([("2", 5)], n), asked).collect()} == {"1": 4, "2": 5, "3": 0}


def test_corpus_and_settings(spark, tmp_path):
    c = tmp_path / "c.json"
    c.write_text(json.dumps({"verified": False, "pmids": [{"pmid": str(k)} for k in range(10)]}))
    assert [r["pmid"] for r in search.read_corpus(spark, str(c), allow_unverified=True).orderBy("position").collect()] == [str(k) for k in range(10)]
    with pytest.raises(Exception, match="not verified"):
        search.read_corpus(spark, str(c)).collect()
    with pytest.raises(Exception, match="fixed number"):
        search.read_corpus(spark, str(c), 9, True).collect()
    (tmp_path / "run.env").write_text("# no\nA=1\nexport B = 'x y'\nA=2\nbroken\n")
    assert {r["key"]: r["value"] for r in search.read_settings(spark, str(tmp_path / "run.env")).collect()} == {"A": "2", "B": "x y"}
    assert search.inside("/o", "a/b.csv") and not search.inside("/o", "../x") and not search.inside("/o", "/etc/x")


def test_payloads(spark):
    rows = spark.createDataFrame([("1", "A", "variant_association", "")], "pmid string, gene string, association_type string, association_group string")
    papers = spark.createDataFrame([("1", 3, 7), ("2", 1, 0)], "pmid string, candidate_count int, emitted_rows long")
    audit = {r["pmid"]: json.loads(r["payload"]) for r in reports.audit_payload(papers, rows).collect()}
    assert audit["1"]["emitted_rows"] == 1 and audit["2"]["emitted_rows"] == 0 and audit["1"]["group_counts"] == {"Primary Genetic Association": 1}
    assert json.loads(reports.drop_debug(papers, {"query": "q"}).orderBy("pmid").first()["payload"])["run"] == {"query": "q"}
    c = spark.createDataFrame([("1", "B", "", ["x"], "passed"), ("1", "A", "v", ["y"], "low")], "pmid string, gene string, variant string, sources array<string>, outcome string")
    assert [x["gene"] for x in json.loads(reports.candidate_lifecycle(c).first()["candidates"])] == ["A", "B"]
    m = reports.manifest(spark.createDataFrame([("r", 1.5)], "run_id string, runtime_seconds double"), spark.createDataFrame([("r", 2)], "run_id string, total_papers int"), spark.createDataFrame([("r", "2", "ok"), ("r", "1", "ok")], "run_id string, pmid string, status string")).first()
    assert m["batch"]["total_papers"] == 2 and [p["pmid"] for p in m["per_paper"]] == ["1", "2"]
    t = reports.report_table([spark.createDataFrame([(1,)], "b int"), spark.createDataFrame([(2,)], "a int")])
    assert t.columns == ["a", "b"] and t.count() == 2


def test_views_of_runs(spark):
    r = spark.createDataFrame([("x", "n", 1.0), ("x", "m", 3.0), ("y", "n", 5.0)], "run string, block string, v double")
    assert tuple(reports.box_data(r, "run", "v").orderBy("run").first()) == ("x", 1.0, 1.5, 2.0, 2.5, 3.0)
    assert {x["run"]: (x["n"], x["m"]) for x in reports.matrix_data(r, "run", "block", "v", ["n", "m"]).collect()} == {"x": (1.0, 3.0), "y": (5.0, None)}
    e = spark.createDataFrame([("a", "s", "1", 1.0), ("a", "s", "2", 2.0), ("b", "t", None, 1.0)], "node_id string, stage_id string, pmid string, captured_at double")
    got = {x["node_id"]: json.loads(x["payload"]) for x in reports.trace_archive(e).collect()}
    assert got["a"]["pmid"] == "2" and got["a"]["stage_events"] == 2
    t = spark.createDataFrame([([("T", [["a", "b"], ["c"]])],)], "t array<struct<label:string,rows:array<array<string>>>>")
    assert t.select(reports.table_prompt(F.col("t"), most_rows=1)).first()[0] == "T\na | b"
    c = spark.createDataFrame([("1", "A", True), ("1", "a ", False), ("2", "", None)], "pmid string, gene string, quota_limited boolean")
    assert tuple(reports.run_counters(c).first()) == (2, 3, 1, 1, 1)
    s = reports.paper_summary(spark.createDataFrame([("1",)], "pmid string"), spark.createDataFrame([], "pmid string, status string"), spark.createDataFrame([], "pmid string, n long"), spark.createDataFrame([], "pmid string, method string")).first()
    assert tuple(s) == ("1", "", 0, "")
    d = spark.createDataFrame([(" ", "r", "LOW")], "p string, r string, l string")
    assert tuple(d.select(reports.planned_label(F.col("p"), F.col("r")), reports.display_confidence(F.col("l"))).first()) == ("r", "Weak")
    one = spark.createDataFrame([("1",), ("2",)], "pmid string")
    assert reports.added_since(one, one.where("pmid = '1'")).first()["pmid"] == "2"


def test_workbook_is_optional(spark, tmp_path):
    df = spark.createDataFrame([("A", "HIGH", "g")], "Gene string, Confidence string, `Association Group` string")
    assert reports.workbook(df, df, str(tmp_path / "w.xlsx")) == (tmp_path / "w.xlsx").exists()
