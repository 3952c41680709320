"""Landed replies, published files, workbooks and supplements: pushdown, failures, atomic commits, odd files."""

import io
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from glossa.sources import landed, published, sheets, supplements


def files_under(path):
    return sorted(os.path.join(d, f) for d, _, names in os.walk(path) for f in names)


def test_filters_on_ids_choose_batches(spark, tmp_path):
    where = f"file://{tmp_path}/replies"
    papers = spark.range(230).select(F.col("id").alias("pmid"), F.concat(F.lit("T"), "id").alias("title"), F.lit(None).cast("string").alias("abstract"), F.lit(2000).alias("year"))
    landed.land(papers, where)
    assert [os.path.basename(f) for f in files_under(tmp_path / "replies")] == [f"replies-{k}.jsonl" for k in (0, 100, 150, 200, 50)]
    df = landed.fetched(spark, where).where("pmid >= 120 AND pmid < 160 AND year >= 2000")
    plan = spark._jvm.org.apache.spark.sql.api.python.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    assert "GreaterThanOrEqual(pmid,120)" in plan and df.rdd.getNumPartitions() == 2  # of five batches
    assert sorted(r["pmid"] for r in df.collect()) == list(range(120, 160))
    some = landed.fetched(spark, where).where("pmid IN (3, 222, 999)")
    assert some.rdd.getNumPartitions() == 2 and sorted(r["title"] for r in some.collect()) == ["T222", "T3"]


def test_one_failed_batch_is_reported_and_two_are_an_error(spark, tmp_path):
    where = f"file://{tmp_path}/replies"
    papers = spark.range(150).select(F.col("id").alias("pmid"), F.lit("x").alias("title"))
    landed.land(papers, where, cut=F.col("pmid") == 57)
    assert landed.fetched(spark, where).where("error IS NULL").count() == 100
    assert tuple(landed.failures(landed.fetched(spark, where)).first()) == (1, [50])
    landed.land(papers, where, cut=F.col("pmid").isin(57, 3))
    with pytest.raises(Exception, match="failed batches: 2"):
        landed.failures(landed.fetched(spark, where)).collect()


def test_many_small_replies_share_partitions(spark, tmp_path):
    where = f"file://{tmp_path}/replies"
    papers = spark.range(20_000).select(F.col("id").alias("pmid"), F.concat(F.lit("T"), "id").alias("title"))
    landed.land(papers, where, cut=F.col("pmid") == 57)
    df = landed.fetched(spark, where)
    assert df.rdd.getNumPartitions() <= 2 * landed.FEW_PARTITIONS  # of 400 batches
    assert tuple(df.agg(F.count("pmid"), F.count_distinct("pmid"), F.count("error"), F.count_distinct("batch")).first()) == (19_950, 19_950, 1, 400)
    assert sorted(r["pmid"] for r in landed.fetched(spark, where).where("pmid >= 19990").collect()) == list(range(19990, 20000))


def test_a_failing_task_leaves_nothing_behind(spark, tmp_path):
    where = f"file://{tmp_path}/logs"
    lines = spark.range(0, 100, 1, 4).select(F.concat(F.lit("line "), "id").alias("value"))
    published.publish(lines, where)
    before = files_under(tmp_path / "logs")
    broken = spark.range(0, 100, 1, 4).select(F.when(F.col("id") == 99, F.raise_error(F.lit("no"))).otherwise(F.lit("x")).cast("string").alias("value"))
    with pytest.raises(Exception, match="no"):
        published.publish(broken, where)
    assert files_under(tmp_path / "logs") == before and not [d for d in os.listdir(tmp_path / "logs") if d.startswith("_")]
    published.publish(lines, where)
    assert spark.read.option("recursiveFileLookup", True).text(where).count() == 200
    published.publish(lines.limit(3), where, mode="overwrite")
    assert spark.read.option("recursiveFileLookup", True).text(where).count() == 3 and len(os.listdir(tmp_path / "logs")) == 1


def test_workbooks_are_written_whole_or_not_at_all(spark, tmp_path):
    where = f"file://{tmp_path}/books"
    rows = [("a", 1, "one", k, [str(k), "<&>\x00_x0041_", None]) for k in range(250)] + [("a", 2, "two/[x]", 0, ["é"]), ("a", 3, "three", 0, ["z"]), ("b:c", 1, "s", 0, ["", "y"])]
    schema = "book string, sheet_no int, sheet string, row int, cells array<string>"
    published.workbooks(spark.createDataFrame(rows, schema).repartition(5), where)
    got = supplements.read_supplements(spark, where, r"([^/]+)\.xlsx$").collect()
    a = [(r["sheet"], r["row"], r["cells"]) for r in got if r["paper"] == "a"]
    # The first two sheets and 200 rows of each.
    assert sorted(a) == sorted([("one", k + 1, [str(k), "<&>\x00_x0041_", ""]) for k in range(200)] + [("two__x_", 1, ["é"])])
    assert [(r["file"], r["cells"]) for r in got if r["paper"] != "a"] == [("b%3ac.xlsx", ["", "y"])]
    before = files_under(tmp_path / "books")
    with pytest.raises(Exception, match="cannot hold row"):
        published.workbooks(spark.createDataFrame([*rows, ("z", 1, "s", 0, ["x" * 40_000])], schema), where)
    assert files_under(tmp_path / "books") == before


def test_books_of_other_programs(tmp_path):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        m, r = sheets._MAIN, sheets._LINKS
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{m}" xmlns:r="{r}"><sheets><sheet name="S" sheetId="1" r:id="rId7"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="x"><Relationship Id="rId7" Target="/xl/worksheets/first.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{m}"><si><r><t>ri</t></r><r><t>ch</t></r></si></sst>')
        z.writestr("xl/worksheets/first.xml", f'<worksheet xmlns="{m}"><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1"><v>2.5</v></c></row><row r="2"/></sheetData></worksheet>')
    assert list(sheets.read_book(io.BytesIO(out.getvalue()), 2, 200)) == [("S", 1, ["rich", "", "2.5"]), ("S", 2, [])]


def test_supplements_keep_limits_and_give_reasons(spark):
    def zipped(*members):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for name, body in members:
                z.writestr(name, body)
        return out.getvalue()

    files = [
        (1, "a.csv", b"\xef\xbb\xbfx, y\n" + b"1,2\n" * 300), (1, "b.tsv", "é\tß\n".encode()), (1, "c.zip", zipped(("no.pdf", b""), *((f"m{k}.txt", f"{k},k") for k in range(5)))), (2, "d.xlsx", b"junk"), (2, "e.pdf", b"%PDF"),
        (2, "f.csv", b""), (2, "g", None), (3, None, b"x"), (3, "h.zip", b"PK"), (3, "i.xlsx", zipped(("a", b""))), (None, "j.csv", b'"open'),
    ]
    got = supplements.supplement_rows(spark.createDataFrame(files, "paper long, name string, content binary")).collect()
    assert got[0].__fields__ == ["paper", "file", "member", "sheet", "row", "cells", "reason"]
    by = {}
    for r in got:
        by.setdefault((r["paper"], r["file"]), []).append((r["member"], r["row"], r["cells"], r["reason"]))
    assert len(by[1, "a.csv"]) == 200 and (None, 1, ["x", "y"], None) in by[1, "a.csv"]
    assert by[1, "b.tsv"] == [(None, 1, ["é", "ß"], None)]
    assert sorted(by[1, "c.zip"]) == [(f"m{k}.txt", 1, [str(k), "k"], None) for k in range(3)]
    reasons = {k: v[0][3] for k, v in by.items() if v[0][3]}
    assert reasons == {(2, "d.xlsx"): "BadZipFile", (2, "e.pdf"): "ValueError", (2, "f.csv"): "no rows", (2, "g"): "ValueError", (3, ""): "ValueError", (3, "h.zip"): "BadZipFile", (3, "i.xlsx"): "no workbook"}
    assert by[None, "j.csv"] == [(None, 1, ["open"], None)]
    assert supplements.supplement_rows(spark.createDataFrame([], "paper string, name string, content binary")).schema["paper"].dataType.simpleString() == "string"
    with pytest.raises(Exception, match="a table with paper"):
        spark.sql("SELECT * FROM supplement_rows(TABLE(SELECT 1 AS paper))")
