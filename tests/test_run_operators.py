"""Pacing, attempts, call profiles, job tables, LaTeX lines, table cells and abstracts, against brute force or by hand."""

import random

from glossa.operators import citations, events, reports, runs
from glossa.sources import markup


def test_paced_requests_are_a_fold(spark):
    draw = random.Random(3)
    rows = [(k, i, draw.randrange(200)) for k in "ab" for i in range(40)]
    want, last = {}, {}
    for k, i, at in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        last[k] = max(at, last.get(k, -10) + 10)
        want[k, i] = last[k]
    got = runs.paced(spark.createDataFrame(rows, "k string, i int, at long"), "k", ["at", "i"], "at", 10)
    assert {(r["k"], r["i"]): r["started"] for r in got.collect()} == want
    assert runs.paced(spark.createDataFrame([], "k string, i int, at long"), "k", ["at", "i"], "at", 10).count() == 0


def test_attempts(spark):
    # The first to time out ends at 100: what is in flight then is tried again, what begins later is not touched.
    rows = [(1, "p", 0, 150.0), (2, "p", 50, 80.0), (3, "p", 10, 20.0), (4, "p", 120, 300.0), (5, "p", 130, 5.0), (6, "q", 50, 80.0), (7, "p", 60, 500.0)]
    got = runs.attempt_outcomes(spark.createDataFrame(rows, "i int, pool string, started long, seconds double"), ["pool"], "started", "seconds", 100.0)
    assert {r["i"]: r["outcome"] for r in got.collect()} == {1: "timed_out", 2: "resubmitted", 3: "done", 4: "timed_out", 5: "done", 6: "done", 7: "resubmitted"}


def test_call_profile(spark):
    trace = [("call", "f"), ("call", "__init__"), ("return", "__init__"), ("call", "g"), ("call", "<lambda>"), ("return", "<lambda>"), ("return", "g"), ("call", "g"), ("call", "noisy"), ("return", "g"), ("return", "f"), ("call", "late")]
    rows = [("r", i, *x) for i, x in enumerate(trace)]
    got = events.call_profile(spark.createDataFrame(rows, "run string, i int, event string, function string"), "run", "i", most=6, noise=("noisy",))
    assert {r["function"]: (r["calls"], r["deepest"], r["returns"]) for r in got.collect()} == {"f": (1, 0, 1), "g": (2, 1, 2)}


def test_job_table_after_changes(spark):
    draw = random.Random(4)
    kinds = ["insert", "update", "delete"]
    jobs = [(j, "old", j) for j in range(8)]
    changes = [(draw.randrange(12), draw.choice(["x", "y", None]), draw.choice([1, 2, None]), i, draw.choice(kinds)) for i in range(60)]
    held = {j: [s, n] for j, s, n in jobs}
    for j, s, n, _, action in changes:
        if action == "delete":
            held.pop(j, None)
        elif action == "insert" or j in held:
            old = held.get(j, [None, None])
            held[j] = [s if s is not None else old[0], n if n is not None else old[1]]
    got = events.applied(spark.createDataFrame(jobs, "job_id int, status string, n int"), spark.createDataFrame(changes, "job_id int, status string, n int, seq int, action string"))
    assert {r["job_id"]: [r["status"], r["n"]] for r in got.collect()} == held


def test_latex(spark):
    rows = spark.createDataFrame([(1, "a_b & 5% {x} \\ $#", 2.25), (2, None, None)], "i int, name string, x double")
    lines = [r["line"] for r in reports.latex_rows(rows, ["name", "x"], ["i"]).orderBy("i").collect()]
    assert lines == [r"a\_b \& 5\% \{x\} \textbackslash  \$\# & 2.3 \\", r"-- & -- \\"]
    whole = reports.latex_table(lines, ["Name", "X"], "Runs", "tab:runs").split("\n")
    assert whole[0] == r"\begin{table}" and whole[3] == r"\begin{tabular}{lr}" and lines[0] in whole and whole[-1] == r"\end{table}"


def test_cells_that_mention(spark):
    tables = spark.createDataFrame([("1", [([["xIL6y", "b"], ["c", None], ["il", "6"]],), ([["Bsf2"]],)]), ("2", [([["IL6"]],)])], "pmid string, tables array<struct<rows: array<array<string>>>>")
    genes = spark.createDataFrame([("1", "IL6", ["IL6", "bsf2", "", None]), ("2", "TNF", ["TNF"])], "pmid string, gene string, names array<string>")
    assert sorted(tuple(r) for r in citations.cells_mentioning(tables, genes).collect()) == [("1", "IL6", 0, 0), ("1", "IL6", 1, 0)]


def test_abstracts(spark):
    xml = "<Set><PubmedArticle><PMID Version='1'>7</PMID><AbstractText Label='A'>One <b>two</b>.</AbstractText>\n<AbstractText>Three\nfour.</AbstractText></PubmedArticle><PubmedArticle><PMID>8</PMID></PubmedArticle><PubmedArticle><AbstractText>x</AbstractText></PubmedArticle></Set>"
    got = markup.abstracts(spark.createDataFrame([(xml,), ("",), (None,)], "xml string"))
    assert {r["pmid"]: r["abstract"] for r in got.collect()} == {"7": "One two. Three four.", "8": ""}
