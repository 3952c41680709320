import json

import pytest
from pyspark.sql import functions as F

from glossa.sources import markup, records

MEDLINE = """PMID- 1
TI  - A title that
      goes on
AU  - A B
AU  - C D
DP  - 2019 Jan
AID - 10.1/x [doi]
AB  - Text.

PMID- 2
TI  - Other
"""


def test_medline(spark, tmp_path):
    (tmp_path / "m.txt").write_text(MEDLINE)
    got = {r["pmid"]: r for r in records.read_medline(spark, str(tmp_path)).collect()}
    assert got["1"]["title"] == "A title that goes on" and got["1"]["authors"] == ["A B", "C D"] and got["1"]["aid"] == ["10.1/x [doi]"]
    assert got["2"]["abstract"] is None and got["2"]["authors"] == []


def document(**keys):
    note = {"infons": {"type": "Gene", "identifier": "672", "name": "brca1"}, "text": "BRCA1", "locations": [{"offset": 3, "length": 5}]}
    other = {"infons": {"type": "Gene", "identifier": "672"}, "text": "Brca1", "locations": [{"offset": 30, "length": 5}]}
    variant = {"infons": {"type": "Variant", "identifier": "tmVar:rs123;x", "name": "p.V600E", "gene_id": "673"}, "text": "V600E", "locations": []}
    return {"passages": [{"annotations": [note, other, variant]}]} | keys


def test_annotation_documents_of_three_envelopes(spark):
    rows = [json.dumps([document(pmid="1"), document(id="2")]), json.dumps({"PubTator3": [document(_id="3|PMC3")]}), json.dumps(document(pmid="4")), "{broken"]
    docs = records.documents_of(spark.createDataFrame([(r,) for r in rows], "value string"))
    assert sorted(r["pmid"] for r in docs.collect()) == ["1", "2", "3", "4"]
    g = records.ner_genes(docs).where("pmid = '3'").collect()
    assert len(g) == 1 and g[0]["symbol"] == "BRCA1" and g[0]["mentions"] == ["BRCA1", "Brca1"] and [x["offset"] for x in g[0]["locations"]] == [3, 30]
    v = records.ner_variants(docs).where("pmid = '1'").first()
    assert (v["rsid"], v["hgvs"], v["gene_id"]) == ("rs123", "p.V600E", "673")


def test_lexicon_and_journal_ranks(spark, tmp_path):
    (tmp_path / "l.json").write_text(json.dumps({"TP53": {"aliases": ["P53"], "prev_symbols": []}, "IL6": {"alias_symbol": ["IL-6"], "locus_type": "gene"}}))
    got = records.read_lexicon(spark, str(tmp_path / "l.json")).orderBy("ordinal").collect()
    assert [(r["symbol"], r["alias_symbol"], r["locus_type"]) for r in got] == [("TP53", ["P53"], "unknown"), ("IL6", ["IL-6"], "gene")]
    (tmp_path / "j.csv").write_text('Title;Issn;SJR Best Quartile\n"The Journal, of X";"12345678, 1234567X";Q2\nNo rank;11112222;-\n')
    ranks = records.read_journal_ranks(spark, str(tmp_path / "j.csv")).collect()
    assert {(r["issn"], r["name_norm"], r["quartile"]) for r in ranks} == {("1234-5678", "journal of x", "Q2"), ("1234-567X", "journal of x", "Q2")}
    assert spark.range(1).select(records.is_stale(F.lit("2001-01-01"))).first()[0]


def test_manifests(spark, tmp_path):
    for name, print_, pilot in (("a", "f1", False), ("b", "f2", False), ("c", "f1", True)):
        (tmp_path / name).mkdir()
        (tmp_path / name / "study_run.json").write_text(json.dumps({"run_id": name, "corpus_fingerprint": print_, "pilot": pilot, "per_paper": []}, indent=1))
    assert [r["run_id"] for r in records.read_manifests(spark, str(tmp_path), "f1").collect()] == ["a"]
    assert records.read_manifests(spark, str(tmp_path), pilots=True).count() == 3


def test_replies(spark):
    rows = ['{"associations": [{"reported_gene": "TNF", "reported_variant": "v"}, {"gene": ""}]}', '```json\n[{"gene": "IL6", "variant": "x",}]\n```', "none"]
    parsed = records.parse_json(spark.createDataFrame([(r,) for r in rows], "reply string"), "reply")
    assert sorted((r["label"], r["variant"]) for r in records.associations(parsed).collect()) == [("IL6", "x"), ("TNF", "v")]


def test_the_first_good_source_wins(spark):
    a = spark.createDataFrame([("1", 900), ("2", 5000)], "pmid string, n int")
    b = spark.createDataFrame([("1", 2000), ("2", 6000), ("3", 10)], "pmid string, n int")
    assert {(r["pmid"], r["source_no"], r["n"]) for r in records.best_source([a, b], F.col("n") >= 1000).collect()} == {("1", 1, 2000), ("2", 0, 5000)}


ARTICLE = """<article xmlns:xlink="http://www.w3.org/1999/xlink"><front><article-meta><abstract><p>Short <b>bold</b><i>it</i>.</p></abstract></article-meta></front>
<body><p>Lead.</p><sec><title>Results</title><p>Found.</p><sec><title>Deep</title><p>More.</p></sec></sec>
<table-wrap id="t1"><label>Table 1</label><caption><p>Cap</p></caption><table><tr><td>a</td><td>1</td></tr><tr><th>G</th><th>N</th></tr></table></table-wrap>
<fig><label>Fig 1</label><caption><p>Shown</p></caption><graphic xlink:href="f1"/></fig><fig><graphic xlink:href="f1"/></fig><fig><label>no link</label></fig>
<supplementary-material xlink:href="s1.csv"><label>S1</label></supplementary-material></body></article>"""


def test_articles_in_document_order(spark):
    parts = markup.parse_articles(spark.createDataFrame([("1", ARTICLE, "http://x/1"), ("2", "<broken", ""), ("3", None, "")], "pmid string, xml string, url string"))
    rows = parts.orderBy("kind", "part", "row").collect()
    assert [r["text"] for r in rows if r["kind"] == "body"] == ["Lead.", "Results", "Found.", "Deep", "More."]
    assert [r["text"] for r in rows if r["kind"] == "abstract"] == ["Short bold it ."]
    assert [r["cells"] for r in rows if r["kind"] == "table"] == [["G", "N"], ["a", "1"]]
    figures = [r for r in rows if r["kind"] == "figure"]
    assert len(figures) == 1 and figures[0]["urls"][:2] == ["http://x/1/f1.jpg", "http://x/1/bin/f1.jpg"]
    assert [r["urls"] for r in rows if r["kind"] == "supplement"] == [["http://x/1/s1.csv"]]
    text = markup.article_text(parts).first()
    assert text["text"].startswith("Short bold it .\n\nLead.") and (text["n_tables"], text["n_figures"]) == (1, 1)
    t = markup.article_tables(parts).first()
    assert t["tables"][0]["label"] == "Table 1" and t["tables"][0]["rows"] == [["a", "1"]]


def test_figures_of_two_parsers_merge(spark):
    f = spark.createDataFrame([("1", 0, 0, "", "cap", ["u1"]), ("1", 1, 0, "Fig 1", "", ["u1", "u2"]), ("1", 1, 1, "Fig 2", "", ["u3"])], "pmid string, parser int, part int, label string, caption string, urls array<string>")
    assert sorted((r["label"], r["caption"], tuple(r["urls"])) for r in markup.merge_figures(f).collect()) == [("Fig 1", "cap", ("u1", "u2")), ("Fig 2", "", ("u3",))]


def test_html_and_supplements(spark):
    h = "<html><head><title> A\n b</title><style>x{}</style></head><body><script>if (a<b) {}</script><p>Tom &amp; Ann &lt;3</p><!-- no --></body></html>"
    assert tuple(spark.createDataFrame([(h,)], "h string").select(markup.html_title("h"), markup.html_text("h")).first()) == ("A b", "A b Tom & Ann <3")
    s = spark.createDataFrame([("1", k, "x" * 90) for k in range(5)], "pmid string, position int, text string")
    assert [len(r["text"]) for r in markup.limited_supplements(s, 3, 200).orderBy("position").collect()] == [90, 90, 20]


@pytest.mark.parametrize("href, n", [("http://a/b", 1), ("f.png", 2), ("f", 14)])
def test_image_urls(href, n):
    assert len(markup.image_urls(href, "http://x")) == n


def test_a_worker_hands_parts_on_in_pieces():
    """What a worker holds does not grow with its batch of articles; nothing is lost between pieces."""
    xml = "<article><body>" + "<p>" + "x" * 999 + "</p>" + "<p>y</p>" * 2 + "</body></article>"
    pieces = list(markup.parts_in_pieces([(str(k), xml, "") for k in range(100)] + [("bad", "<broken", ""), ("none", None, "")], 5000))
    assert [(r["pmid"], r["part"]) for rows in pieces for r in rows] == [(str(k), part) for k in range(100) for part in range(3)]
    assert max(sum(len(r["text"]) for r in rows) for rows in pieces) <= 5000 + 1001 and len(pieces) == 25


def _of_tables(n: int, rows: int, cell: str = "") -> str:
    """An article of so many tables, each row with its numbers."""
    return "<article><body><p>Lead.</p>" + "".join(
        f"<table-wrap><label>Table {k}</label><caption><p>Cap {k}</p></caption><table><tr><th>G{k}</th></tr>" + "".join(f"<tr><td>{k} {r}{cell}</td></tr>" for r in range(rows)) + "</table></table-wrap>" for k in range(n)
    ) + '</body><fig><graphic href="no"/></fig><supplementary-material xmlns:x="http://www.w3.org/1999/xlink" x:href="s.csv"/></article>'


def test_every_table_of_an_article_is_read(spark):
    """An article has as many tables as it has, in parts, text and the citation index's form."""
    parts = markup.parse_articles(spark.createDataFrame([("1", _of_tables(45, 2), ""), ("2", _of_tables(20, 1), ""), ("3", _of_tables(21, 1), "")], "pmid string, xml string, url string")).cache()
    got = [(r["part"], r["row"], r["label"], r["caption"], r["cells"]) for r in parts.where("pmid = '1' AND kind = 'table'").orderBy("part", "row").collect()]
    assert got == [(k, r, f"Table {k}", f"Cap {k}", [f"G{k}" if r == 0 else f"{k} {r - 1}"]) for k in range(45) for r in range(3)]
    assert {r["pmid"]: r["n_tables"] for r in markup.article_text(parts).collect()} == {"1": 45, "2": 20, "3": 21}
    assert markup.article_text(parts).where("pmid = '1'").first()["text"] == "\n\n".join(["Lead."] + [t for k in range(45) for t in (f"G{k}", f"{k} 0", f"{k} 1")])
    tables = {r["pmid"]: r["tables"] for r in markup.article_tables(parts).collect()}
    assert [(t["label"], t["rows"]) for t in tables["1"]] == [(f"Table {k}", [[f"{k} 0"], [f"{k} 1"]]) for k in range(45)]
    assert (len(tables["2"]), len(tables["3"])) == (20, 21)
    assert parts.where("kind = 'supplement'").count() == 3


def test_one_article_of_many_tables_is_handed_on_in_pieces():
    """What a worker holds does not grow with an article's tables, whose cells count; nothing is lost where an article is cut."""
    xml = _of_tables(200, 10, "x" * 500)
    pieces = list(markup.parts_in_pieces([("1", xml, ""), ("2", xml, "")], 5000))
    assert [r for rows in pieces for r in rows] == [{"pmid": pmid} | p for pmid in ("1", "2") for p in markup.article_parts(xml)]
    assert len(markup.article_parts(xml)) == 2 + 200 * 11
    assert max(sum(len(c) for r in rows for c in r["cells"] or ()) for rows in pieces) <= 2 * 5000 + 510
