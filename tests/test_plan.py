"""The whole literature plan on a few papers."""

import pytest

from glossa.plans import literature

TEXT = "Background words here. BRCA1 expression was significantly higher in tumours, with 12 patients studied. TP53 is named with a kit. IFN-gamma signaling rose in the pathway."


@pytest.fixture()
def inputs(spark):
    strings = "array<string>"
    return literature.Inputs(
        papers=spark.createDataFrame([("1", "T1", ["A"], "2020", "J", "10.1/a", "abstract " * 30, True), ("2", "T2", ["B"], "2021", "J", "", "x", False)], f"pmid string, title string, authors {strings}, year string, journal string, doi string, abstract string, is_mandatory boolean"),
        texts=spark.createDataFrame([("1", TEXT, "figure of XYZ9"), ("2", None, None)], "pmid string, text string, captions string"),
        tables=spark.createDataFrame([("1", [("T1", "", [["BRCA1", "12"]])])], "pmid string, tables array<struct<label:string,table_id:string,rows:array<array<string>>>>"),
        ner=spark.createDataFrame([("1", "BRCA1", "672", ["BRCA1"])], f"pmid string, symbol string, gene_id string, mentions {strings}"),
        associations=spark.createDataFrame([("1", 0, "llm_text", "BRCA1", "", "BRCA1", "e"), ("1", 1, "llm_text", "NOTHERE7", "", "", ""), ("2", 0, "llm_abstract", "TP53", "", "", "")], "pmid string, position int, source string, label string, variant string, mention string, evidence string"),
        details=spark.createDataFrame([("1", "BRCA1", "", "", "higher expression", "BRCA1 expression was significantly higher in tumours")], "pmid string, gene string, variant string, error string, `Key Finding` string, `Key Finding Citation` string"),
        lexicon=spark.createDataFrame([(0, "BRCA1", [], [], "gene"), (1, "TP53", [], [], "gene"), (2, "IFNG", ["IFN-gamma"], [], "gene")], f"ordinal int, symbol string, alias_symbol {strings}, prev_symbol {strings}, locus_type string"),
        primary_counts=spark.createDataFrame([("1", 7)], "pmid string, count int"),
        secondary_counts=spark.createDataFrame([("2", 3, True)], "pmid string, count int, ok boolean"),
        gene_dim=spark.createDataFrame([("BRCA1", "672", "BRCA1 gene", ["a", "b", "c", "d"], "17")], f"symbol string, gene_id string, full_name string, aliases {strings}, chromosome string"),
    )


def test_plan(inputs):
    result = literature.run(inputs, ["Key Finding"])
    rows = {r["Gene/Group"]: r for r in result.rows.collect()}
    assert rows["BRCA1"]["Confidence"] == "HIGH" and rows["BRCA1"]["Citations"] == 7 and rows["BRCA1"]["Gene Aliases"] == "a, b, c"
    assert rows["IFNG"]["extraction_mode"] == "skeleton" and rows["IFNG"]["evidence_backfilled"] and rows["IFNG"]["Confidence"] == "REVIEW"
    drops = {(r["pmid"], r["gene"]): r["reason"] for r in result.drops.collect()}
    assert drops["1", "NOTHERE7"] == "not_grounded_in_text" and drops["2", "TP53"] == "not_grounded_in_text"
    assert result.screening.count() == 2
    assert {r["PMID"] for r in literature.run(inputs, ["Key Finding"], top_n=1).rows.collect()} == {"1"}
