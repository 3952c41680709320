import difflib
import random
import re

import pytest
from pyspark.sql import functions as F

from glossa.operators import candidates, citations, evidence, gates, lexicon, metadata, output, runs
from glossa.operators import events as ev
from glossa.operators.ordering import with_ordinal

LEXICON = [(0, "BRCA1", ["RNF53"], ["BRCC1"], "protein"), (1, "TP53", ["P53", "BRCA1"], [], "protein"), (2, "IL6", ["IL-6", "P53"], [], "protein"), (3, "F2", [], [], "protein")]


@pytest.fixture()
def lex(spark):
    return spark.createDataFrame(LEXICON, "ordinal int, symbol string, alias_symbol array<string>, prev_symbol array<string>, locus_type string")


def test_aliases_go_to_the_first_entry_and_never_hide_symbols(spark, lex):
    got = {r["token"]: r["symbol"] for r in lexicon.alias_index(lex).collect()}
    assert got["BRCA1"] == "BRCA1" and got["P53"] == "TP53" and got["BRCC1"] == "BRCA1"
    m = spark.createDataFrame([("p53",), ("il 6",), ("brca1 ",), ("",), (None,), ("zz",)], "label string")
    assert [(r["symbol"], r["resolution"]) for r in lexicon.resolve(m, lex).orderBy("label").collect()] == [(None, "empty"), (None, "empty"), ("BRCA1", "local_symbol"), ("IL6", "local_alias_norm"), ("TP53", "local_alias"), (None, "unresolved")]
    near = lexicon.suggestions(spark.createDataFrame([("BRCA2",), ("TP5",)], "label string"), lex)
    assert {r["label"]: r["suggestions"] for r in near.collect()} == {"BRCA2": "BRCA1", "TP5": "TP53"}


def test_scan_takes_capitals_digits_and_hyphens_only(spark, lex):
    t = spark.createDataFrame([("1", "IL6 then tp53 and Brca1, F2."), ("2", None)], "pmid string, text string")
    assert [(r["gene"]) for r in lexicon.scan(t, lex).orderBy("position").collect()] == ["IL6", "TP53", "BRCA1", "F2"]
    plain = spark.createDataFrame([("1", "Cat and CAT")], "pmid string, text string")
    cat = spark.createDataFrame([(0, "CAT", [], [], "x")], "ordinal int, symbol string, alias_symbol array<string>, prev_symbol array<string>, locus_type string")
    assert lexicon.scan(plain, cat).first()["position"] == 2


def test_mentions(spark):
    t = spark.createDataFrame([("1", "IFN-gamma rose. HLA-B*27:05 among HLA class I alleles such as A*02 and B27. TNF α fell. A*02 alone.")], "pmid string, text string")
    got = {(r["mention"], r["gene"], r["variant"], r["rule"]) for r in candidates.mention_index(t).collect()}
    assert got == {("IFN-gamma", "IFNG", "", "cytokine_alias_ifng"), ("HLA-B*27:05", "HLA-B", "HLA-B*27:05", "hla_direct_allele"), ("A*02", "HLA-A", "HLA-A*02", "hla_class_i_allele_shorthand"), ("B27", "HLA-B", "HLA-B*27", "hla_class_i_allele_shorthand"), ("TNF α", "TNF", "", "cytokine_alias_tnf")}


def test_merge_keeps_provenance(spark):
    rows = [("1", 0, "llm_text", "TNF", "TNF-a", "N/A", "TNF alpha", ""), ("1", 1, "pubtator", "tnf", "TNF", "", "", "later"), ("1", 2, "llm_text", "TNF", "x", "p.V1A", "tnf ALPHA", "e"), ("1", 3, "llm_text", "", "x", "", "", "")]
    got = {(r["gene"], r["variant"]): r for r in candidates.merge(spark.createDataFrame(rows, "pmid string, position int, source string, gene string, label string, variant string, mention string, evidence string")).collect()}
    assert got.keys() == {("TNF", ""), ("TNF", "p.V1A")}
    r = got["TNF", ""]
    assert (r["sources"], r["labels"], r["mentions"], r["evidence"]) == (["llm_text", "pubtator"], ["TNF", "TNF alpha", "TNF-a"], ["TNF alpha"], "later")


TEXT = "Earlier words. We found that BRCA1 rose with TP53. Later, BRCA-1 alone was expressed, p <0.05. F2-isoprostanes were low. F2 was higher in protein expression."


def told(spark, expression, **values):
    """What an expression gives for one row of texts and lists of texts."""
    kinds = {k: "string" if isinstance(v, str) else "array<string>" for k, v in values.items()}
    kinds |= {"peers": "array<struct<gene:string,terms:array<string>>>"} if "peers" in values else {}
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {t}" for k, t in kinds.items())).select(expression.alias("x")).first()["x"]


def test_snippets(spark):
    first = lambda terms, text=TEXT: told(spark, evidence.first_snippet("terms", "text"), terms=terms, text=text)
    assert first(["zzz", "BRCA1"])["term"] == "BRCA1"
    assert first(["BRCA1"])["snippet"].startswith("We found that BRCA1")
    assert tuple(first(["RCA1"])) == tuple(first([])) == tuple(first([None, " "])) == ("", "")
    assert first(["a.b(", "x\\E"], "see a.b( here")["term"] == "a.b("
    assert first(["BRCA1"], "In B-R/C.A 1 it rose")["snippet"] == "In B-R/C.A 1 it rose"
    # The compound's name does not count as the gene.
    assert "F2 was" in first(["F2"])["snippet"]
    cut = first(["long"], "word " * 30 + "long " + "word " * 100)["snippet"]
    assert cut.endswith("...") and 200 < len(cut) <= 240
    specific = lambda peers, text=TEXT: told(spark, evidence.specific_snippet("terms", "peers", "text"), terms=["BRCA1"], peers=peers, text=text)
    s = specific([("TP53", ["TP53", "p53"])])
    assert not s["specific"] and s["peers"] == ["TP53"] and "BRCA1" in s["snippet"]
    far = "TP53 and BRCA1. " + "x" * 400 + " Here BRCA1 stands. " + "y" * 400
    assert specific([("TP53", ["TP53"])], far)["specific"]
    assert tuple(specific([("TP53", ["TP53"])], "nothing")) == ("", False, [])


def test_places_of_all_matches(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab. ") for _ in range(60)) for _ in range(30)]
    every, two = (evidence.spans(F.col("value"), F.lit("a+b?"), n) for n in (50, 2))
    for text, found, first in spark.createDataFrame(texts, "string").select("value", every, two).collect():
        assert [tuple(x) for x in found] == [(m.start() + 1, len(m[0])) for m in re.finditer(r"a+b?", text)]
        assert first == found[:2]


def test_context_and_statistics(spark):
    context = lambda gene, text=TEXT, terms=None: told(spark, evidence.context_evidence("gene", "terms", "text"), gene=gene, terms=[gene] if terms is None else terms, text=text)
    assert tuple(context("F2"))[:2] == (True, "result_context")
    assert context("F2")["snippet"] == "F2 was higher in protein expression."
    assert context("PAM", "PAM macrophages were higher in expression")["supported"] is False
    assert context("X1", "forward primer for X1 in buffer")["reason"] == "no_strong_deterministic_context"
    assert context("X1", "forward primer for X1 in buffer")["snippet"] == "forward primer for X1 in buffer"
    assert context("X1", "")["reason"] == "no_paper_text" and context("X1", "x", [])["reason"] == "no_candidate_terms"
    no_end = "a" * 300 + " X1 " + "b" * 700
    assert context("X1", no_end)["snippet"] == "a" * 139 + " X1 " + "b" * 319
    said = lambda terms: told(spark, evidence.statistical_sentence("terms", "text"), terms=terms, text=TEXT)
    assert said(["BRCA-1"]) == "Later, BRCA-1 alone was expressed, p <0.05." and said(["zz", "BRCA-1"]) == said(["BRCA-1"]) and said(["TP53"]) == said([]) == ""

def test_grounding_uses_captions_and_the_whole_text(spark):
    c = spark.createDataFrame([("1", "A1", "", ["llm_text"], ["A1"]), ("1", "B2", "", ["llm_figure"], ["B2"]), ("1", "C3", "", ["llm_text"], ["C3"]), ("1", "D4", "", ["llm_text"], ["D4"])], "pmid string, gene string, variant string, sources array<string>, terms array<string>")
    t = spark.createDataFrame([("1", "A1 and B2 here", "A1 and B2 here, C3 too", "figure of B2")], "pmid string, text string, original_text string, captions string")
    kept, gone = evidence.ground(c, t)
    assert {(r["gene"], r["grounding_source"]) for r in kept.collect()} == {("A1", "paper_text"), ("B2", "figure_caption"), ("C3", "original_text")}
    assert [r["gene"] for r in gone.collect()] == ["D4"]


def test_sections_in_document_and_header_order(spark):
    t = "Pre\nResults\n" + "r " * 30 + "\nMethods\n" + "m " * 60 + "\nResults\nagain"
    assert [n for n, _ in evidence.named_sections(t)] == ["_preamble", "results", "methods"]
    got = evidence.fit_context(spark.createDataFrame([("1", t), ("2", "tiny")], "pmid string, text string"), limit=100).orderBy("pmid").collect()
    assert got[0]["removed"] == "methods" and "m m" not in got[0]["text"] and got[0]["text"].endswith("again") and got[1]["text"] == "tiny"


def brute_window(citation, words):
    n = len(citation)
    best = 0.0
    for j in range(0, max(1, len(words) - n + 1)):
        best = max(best, difflib.SequenceMatcher(None, citation, words[j : j + n + 3]).ratio())
    return best


def test_fuzzy_citations():
    rng = random.Random(0)
    words = [f"w{rng.randrange(60)}" for _ in range(200)]
    for k in range(20):
        a = rng.randrange(170)
        quote = words[a : a + 12]
        quote[rng.randrange(12)] = "changed"
        got, _ = citations.closest_window(quote, words)
        reverse = difflib.SequenceMatcher(None, quote, words[a : a + 15]).ratio()
        assert got >= reverse - 1e-9
    # No window is missed that is as like as asked for.
    for _ in range(30):
        quote, words = [f"w{rng.randrange(6)}" for _ in range(7)], [f"w{rng.randrange(6)}" for _ in range(40)]
        every = [difflib.SequenceMatcher(None, quote, words[j : j + 10]).ratio() for j in range(34)]
        want = max(every) if max(every) >= 0.7 else 0.0
        assert citations.closest_window(quote, words, 0.7)[0] == pytest.approx(want)
        if want:
            assert every[citations.closest_window(quote, words, 0.7)[1]] == pytest.approx(want)


def test_reasons_of_citations(spark):
    text = "Alpha beta gamma delta epsilon zeta eta theta. " + "filler " * 100 + "The value of 12 units was seen near BRCA-1. " + "more " * 400 + "EGFR at the end, 99 of it."
    cases = {
        ("", ()): ("nothing_to_compare", 0.0), ("alpha  BETA gamma", ()): ("quote_found", 1.0), ("alpha nowhere", ()): ("short_quote_not_found", 0.0),
        ("no such words in here at all", ()): ("no_similar_text", 0.0), ("value of 12 units", ("BRCA1",)): ("quote_found", 1.0), ("value of 12 units", ("EGFR",)): ("symbol_not_near", 1.0),
        ("The value of 13 units was seen near BRCA-1. more more more", ()): ("number_not_near:13", 20 / 24), ("alpha beta gamma delta changed zeta eta theta." + " filler" * 12, ()): ("similar_text_found", None),
    }
    rows = [("1", k, names[0] if names else "", list(names), quote) for k, (quote, names) in enumerate(cases)]
    cited = spark.createDataFrame(rows, "pmid string, cid int, gene string, names array<string>, citation string")
    got = {r["cid"]: r for r in citations.verify(cited, spark.createDataFrame([("1", text)], "pmid string, text string")).collect()}
    for k, (reason, ratio) in enumerate(cases.values()):
        if not reason.startswith("number"):
            assert got[k]["reason"] == reason
        if ratio in (0.0, 1.0):
            assert got[k]["ratio"] == ratio
        assert got[k]["found"] == reason.endswith("_found") and got[k]["found"] == got[k]["valid"] or reason == "short_quote_not_found"
    assert not got[6]["found"]
    # A paper without text.
    assert citations.verify(cited, spark.createDataFrame([("2", text)], "pmid string, text string")).where("reason <> 'nothing_to_compare'").count() == 0


def test_verify_falls_back_to_tables(spark):
    t = spark.createDataFrame([("1", "Nothing to see in this text.")], "pmid string, text string")
    tables = spark.createDataFrame([("1", [("T1", "", [["IL-6", "12.5", "3"], ["IL6X", "7"]])])], "pmid string, tables array<struct<label:string,table_id:string,rows:array<array<string>>>>")
    cited = spark.createDataFrame([("1", 0, "IL6", ["IL-6"], "rose to 12.5 in this whole group of patients"), ("1", 1, "ZZ", [], "rose to 12.5")], "pmid string, cid int, gene string, names array<string>, citation string")
    got = {r["cid"]: r for r in citations.verify(cited, t, citations.table_rows(tables)).collect()}
    assert got[0]["found"] and got[0]["reason"] == "table_match:T1" and got[0]["valid"] and not got[1]["found"]


def test_gates_keep_their_drops(spark):
    rows = [("a", "x", "cite", True, 0.9, ["llm_text"]), ("b", "x", "cite", False, 0.9, ["llm_text"]), ("c", "", "", None, 0.9, ["pubtator"]), ("d", "", "", None, 0.5, ["llm_text"]), ("e", "", "", None, 0.9, ["llm_text"]), ("f", "x", "Auto snippet from paper text", False, 0.9, ["pubtator"])]
    df = spark.createDataFrame(rows, "gene string, K string, `K Citation` string, K_citation_valid boolean, validation_confidence double, sources array<string>")
    kept, gone = gates.all_gates(df, ["K"])
    assert {r["gene"] for r in kept.collect()} == {"a", "e", "f"}
    assert {r["gene"]: r["reason"] for r in gone.collect()} == {"b": "ungrounded_citation", "c": "insufficient_user_evidence", "d": "low_validation_confidence"}
    assert gates.strict_gate(df.drop("validation_confidence"))[0].count() == 0


def test_row_confidence(spark):
    rows = [("A", "llm", "", 0.9, "both", "llm_text", "q", True, ""), ("", "llm", "", 1.0, "both", "", "", None, ""), ("B", "skeleton", "e" * 90, 1.0, "llm", "", "", None, ""), ("C", "llm", "", 0.8, "llm", "", "", None, ""), ("D", "llm", "", 0.9, "llm", "llm_figure", "", None, ""), ("E", "llm", "", 0.9, "llm", "pubtator", "q", False, ""), ("F", "llm", "", 0.9, "llm", "", "", None, "no_oa_full_text"), ("G", "llm", "", 0.9, "llm", "pubtator", "q", None, "")]
    df = spark.createDataFrame(rows, "`Gene/Group` string, extraction_mode string, detail_extraction_error string, validation_confidence double, `Gene Source` string, `Candidate Source` string, `K Citation` string, K_citation_valid boolean, context_modifications string")
    got = {r["Gene/Group"]: (r["Confidence"], r["Confidence Note"]) for r in gates.row_confidence(df, ["K"]).collect()}
    assert got["A"] == ("HIGH", "") and got[""] == ("REVIEW", "No genes extracted") and got["B"][1] == f"LLM failed; no content ({'e' * 80}…)"
    assert got["C"] == ("LOW", "Low confidence") and got["D"][1].startswith("Figure-only") and got["E"][0] == "REVIEW" and got["F"] == ("LOW", "Abstract only") and got["G"] == ("MEDIUM", "No citation")


def test_output_columns_and_files(spark, tmp_path):
    assert output.unique_names(["a", "b", "a", "a"]) == ["a", "b", "a (2)", "a (3)"]
    assert list(output.safe_user_columns({"PMID": "", "x": "", " x ": "", "": ""})) == ["User: PMID", "x", "User: x"]
    assert output.user_output_columns(["K", "L Citation", "K"], ["K", "K Citation", "L Citation"]) == ["K", "K Citation", "L Citation"]
    rows = [("2", "B", "", "MEDIUM", "animal_model_gene", "k"), ("1", "A", "v", "HIGH", "variant_association", "k"), ("1", "C", "", "LOW", "variant_association", "k")]
    df = spark.createDataFrame(rows, "PMID string, `Gene/Group` string, `Variant Name` string, Confidence string, `Association Type` string, K string")
    where = output.write_results(df, ["K"], str(tmp_path / "out"))
    read = spark.read.option("header", True).csv(where["primary_csv"])
    assert read.columns == ["Gene", "Variant", "K", "Confidence", "Association Group", "Association Type", "PMID"]
    primary, meta = output.split_output(df, ["K"])
    assert [r["Gene"] for r in primary.orderBy("row_id").collect()] == ["A", "C", "B"] == [r["Gene/Group"] for r in meta.orderBy("row_id").collect()]
    assert spark.read.json(where["primary_json"]).count() == 3


def test_ordinal_is_a_total_order_for_any_partitioning(spark):
    for n in (1, 3, 7):
        df = spark.range(100).select((F.col("id") * 37 % 100).alias("v")).repartition(n)
        assert [r["position"] for r in with_ordinal(df, [F.desc("v")]).orderBy(F.desc("v")).collect()] == list(range(1, 101))
    assert with_ordinal(spark.range(0), [F.col("id")]).count() == 0


def test_headroom_feeds_back(spark):
    s = spark.createDataFrame([(1, k, "d", c) for k, c in enumerate([4, 4, 9, 1])], "session int, slot int, quota_window string, calls long")
    got = runs.headroom(s, ["session"], most=10, estimate=3).orderBy("slot").collect()
    assert [r["status"] for r in got] == ["run", "run", "skipped_call_headroom", "skipped_call_headroom"]


def test_jaccard_of_empty_sets_and_single_runs(spark):
    s = spark.createDataFrame([("a", 1, []), ("a", 2, []), ("b", 1, ["x"]), ("c", 1, ["x", "y"]), ("c", 2, ["y", "z"])], "k string, r int, s array<string>")
    assert {r["k"]: r["mean_jaccard"] for r in runs.mean_pairwise_jaccard(s, "k", "r", "s").collect()} == {"a": 1.0, "b": None, "c": pytest.approx(1 / 3)}


def test_runs_small(spark):
    assert runs.nice_ticks(47) == [0, 10, 20, 30, 40, 50] and runs.nice_ticks(0) == [0.0, 1.0]
    d = runs.describe(spark.createDataFrame([("a", 1.0)], "m string, value double"), ["m"]).first()
    assert (d["sd"], d["p95"], d["count"]) == (0.0, 1.0, 1)
    b = spark.createDataFrame([("r1", "night", 10.0, 0, [("ok",), ("ok",)], (0, 1)), ("r2", "night", 20.0, 1, [("ok",), ("failed",)], (2, 0))], "run_id string, time_block string, runtime_seconds double, return_code int, per_paper array<struct<status:string>>, batch struct<quota_limited_rows:int,timeout_count:int>")
    for c in ("completed_papers", "total_papers", "failed_papers", "quota_limited_papers", "gemini_api_calls", "gemini_total_tokens", "gemini_error_count", "model_unavailable_count", "permission_denied_count", "output_rows"):
        b = b.withColumn("batch", F.col("batch").withField(c, F.lit(1)))
    got = {r["run_id"]: r["failure_class"] for r in runs.batch_rows(b).collect()}
    assert got == {"r1": "complete_with_quota_limit", "r2": "quota_limited"}
    lines = list(runs.report(runs.verdict(runs.batch_rows(b), runs.block_summary(runs.batch_rows(b))), runs.block_summary(runs.batch_rows(b))))
    assert "Verdict" in lines[0] and len(lines) == 3


def test_queries_as_text(spark):
    assert metadata.publication_type_query("x", ["Review", "News"]) == "(x) AND NOT Review[Publication Type] AND NOT News[Publication Type]"
    assert metadata.open_access_query("x").startswith("(x) AND ")
    df = spark.createDataFrame([("(a",), ('"a',), ("a AND",), ("(a) OR b",)], "q string")
    assert [r[0] for r in df.select(metadata.diagnose_query("q")).collect()] == ["unbalanced_parentheses", "unbalanced_quotes", "dangling_operator", None]


def test_calls_leave_room_for_required_ones(spark):
    c = spark.createDataFrame([("1", k, o) for k, o in enumerate([True, True, False])], "pmid string, seq int, optional boolean")
    assert [r["allowed"] for r in ev.running_calls(c, "pmid", ["seq"], 3).orderBy("seq").collect()] == [True, True, True]
    e = spark.createDataFrame([("retry in 7s", 1), ("503 UNAVAILABLE", 3), (None, 9)], "e string, n int")
    assert [tuple(r) for r in e.select(ev.error_class("e"), ev.retry_delay("e", "n")).collect()] == [("permanent", 7.0), ("transient", 8.0), ("none", 60.0)]
