"""Operators whose work is spread over tasks whatever a group's size: components, quantiles, near symbols, term search, counters, manifests."""

import itertools
import json
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from glossa.functions.text import natural_key
from glossa.operators import components, counters, evidence, gates, lexicon, quantiles, runs, termsearch
from glossa.sources import manifests, markup


def brute_components(pairs):
    of = {}
    for a, b in pairs:
        if a is None or b is None:
            continue
        x, y = of.setdefault(a, {a}), of.setdefault(b, {b})
        if x is not y:
            x |= y
            for n in y:
                of[n] = x
    return {n: min(s) for n, s in of.items()}


@pytest.mark.parametrize("pairs", [[], [(1, 1), (None, 2), (3, 4), (4, 3)], [(k, k + 1) for k in range(40)] + [(100, 7), (200, 300)], [(0, k) for k in range(1, 60)] + [(k, 500) for k in range(70, 80)]], ids=["none", "odd", "chain", "star"])
def test_components(spark, pairs):
    got = components.components(spark.createDataFrame(pairs, "a long, b long"))
    assert {r["node"]: r["component"] for r in got.collect()} == brute_components(pairs)


def test_components_of_random_pairs_and_of_structs(spark):
    rng = random.Random(1)
    pairs = [(rng.randrange(120), rng.randrange(120)) for _ in range(80)]
    df = spark.createDataFrame([(("x", a), ("x", b)) for a, b in pairs], "a struct<s:string,k:int>, b struct<s:string,k:int>")
    assert {r["node"]["k"]: r["component"]["k"] for r in components.components(df).collect()} == brute_components(pairs)


def test_figures_chained_over_addresses_are_one(spark):
    rows = [("1", 0, 0, "", "c", ["a", "b"]), ("1", 0, 1, "L", " ", ["c"]), ("1", 1, 0, "M", "d", ["b", "c"]), ("1", 1, 1, "", "", []), ("2", 0, 0, "N", "", ["a"])]
    f = spark.createDataFrame(rows, "pmid string, parser int, part int, label string, caption string, urls array<string>")
    got = sorted((r["pmid"], r["label"], r["caption"], r["urls"], r["n_figures"]) for r in markup.merge_figures(f, counted=True).collect())
    assert got == [("1", "", "", [], 1), ("1", "L", "c", ["a", "b", "c"], 3), ("2", "N", "", ["a"], 1)]


def test_quantiles_of_groups_that_span_ranges(spark):
    rng = np.random.default_rng(3)
    groups = {"hot": rng.integers(0, 5, 5000).astype(float), "one": np.array([7.0]), "two": np.array([1.0, 2.0]), None: rng.normal(size=33)}
    rows = [(g, float(x)) for g, xs in groups.items() for x in xs] + [("none", None), ("two", None)]
    got = {r["g"]: r for r in quantiles.quantiles(spark.createDataFrame(rows, "g string, x double").repartition(7), ["g"], "x", {"q0": 0.0, "q37": 0.37, "median": 0.5, "q100": 1.0}, {"p95": 0.95}).collect()}
    for g, xs in groups.items():
        assert got[g]["n"] == len(xs)
        for name, q in (("q0", 0), ("q37", 0.37), ("median", 0.5), ("q100", 1)):
            assert got[g][name] == pytest.approx(np.quantile(xs, q))
        assert got[g]["p95"] == np.sort(xs)[int(np.ceil(0.95 * len(xs))) - 1]
    assert got["none"]["n"] == 0 and got["none"]["median"] is None
    assert quantiles.quantiles(spark.createDataFrame([], "g string, x double"), ["g"], "x", {"m": 0.5}).count() == 0


def test_descriptions_equal_those_that_hold_a_group(spark):
    rows = [(k % 3, float(k * k % 17)) for k in range(100)] + [(9, None)]
    long = spark.createDataFrame(rows, "g int, value double")
    one, other = ({r["g"]: [pytest.approx(x) for x in r[1:]] for r in d.collect()} for d in (runs.describe(long, ["g"]), quantiles.describe_any_size(long, ["g"])))
    assert one.keys() == other.keys() and all([x.expected for x in one[g]] == other[g] for g in one)


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(row[-1] + 1, last[j] + 1, last[j - 1] + (x != y)))
    return row[-1]


@pytest.mark.parametrize("farthest", [1, 2, 3])
def test_near_symbols_equal_all_pairs(spark, farthest):
    rng = random.Random(farthest)
    words = sorted({"".join(rng.choice("ABC1") for _ in range(rng.randint(1, 7))) for _ in range(70)})
    labels = sorted({"".join(rng.choice("ABC1") for _ in range(rng.randint(1, 12))) for _ in range(60)}) + ["", "A" * 40]
    got = lexicon.near_symbols(spark.createDataFrame([(x,) for x in labels], "label string"), spark.createDataFrame([(x,) for x in words * 2], "symbol string"), farthest)
    assert sorted(map(tuple, got.collect())) == sorted((a, b, d) for a, b in itertools.product(labels, words) if (d := levenshtein(a, b)) <= farthest)


TERMS = ["TNF", "TNF-alpha", "tnf α", "p.V600E", "F2", "IL6", "(X1)", "a.b", "HLA-B*27:05", "12", " IL-6 ", "", None, "--", "BRCA1"]
PIECES = ["TNF", "tnf-ALPHA", "T N-F", "xTNF", "TNF1", "tnf α", "p.V600E", "P V600 e", "F2", "F2 isoprostane", "f2-isops", "IL6", "I_L/6", "IL 6", "il.6x", "(X1)", "X1", "a.b", "ab", "a b", "HLA-B*27:05", "HLA B 27 05", "12", "1 2", "brca1", "BRCA-1", ". ", "! ", " ", "\n", "é", "中", ","]


def test_one_pass_finds_what_expressions_find(spark):
    rng = random.Random(5)
    texts = [(str(k), "".join(rng.choice(PIECES) + rng.choice(["", " ", ", "]) for _ in range(rng.randint(0, 60)))) for k in range(60)] + [("60", None), ("61", "")]
    asked = [(str(k), f"g{j}", rng.sample(TERMS, rng.randint(0, 5))) for k in range(62) for j in range(4)]
    c = spark.createDataFrame(asked, "pmid string, gene string, terms array<string>").withColumn("sources", F.array(F.lit("llm_text")))
    t = spark.createDataFrame(texts, "pmid string, text string")
    kept, _ = evidence.ground(c, t)
    want = sorted((r["pmid"], r["gene"], r["grounding_match"], r["grounding_snippet"], r["grounding_source"]) for r in kept.collect())
    got = sorted((r["pmid"], r["gene"], r["grounding_match"], r["grounding_snippet"], r["grounding_source"]) for r in termsearch.ground_in_one_pass(c, t).collect())
    assert got == want and len(want) > 100


def test_counters_come_with_the_pass_that_writes(spark, tmp_path):
    rows = [(str(k % 7), ("A", "b ", " B", "", None)[k % 5], "x" if k % 3 else "", "q" if k % 2 else "", k % 4 != 1, k / 40, ["llm_text"] if k % 2 else [], k % 11 == 0) for k in range(60)]
    df = spark.createDataFrame(rows, "pmid string, gene string, F string, `F Citation` string, F_citation_valid boolean, validation_confidence double, sources array<string>, quota boolean")
    reasons = ("ungrounded_citation", "low_validation_confidence", "insufficient_user_evidence")
    told = counters.write_counted(counters.judged(df, ["F"]), str(tmp_path / "rows"), reasons, quota=F.col("quota"))
    kept, gone = gates.all_gates(df, ["F"])
    drops = {r["reason"]: r["count"] for r in gone.groupBy("reason").count().collect()}
    names = [(p, (g or "").strip().upper()) for p, g, *_ in rows]
    assert told == {"rows": 60, "papers": 7, "genes": len({n for n in names if n[1]}), "quota_rows": sum(r[7] for r in rows), "quota_papers": len({r[0] for r in rows if r[7]}), "kept": kept.count(), **{r: drops.get(r, 0) for r in reasons}}
    assert spark.read.parquet(str(tmp_path / "rows")).count() == 60


def test_manifests_of_any_shape(spark, tmp_path):
    files = [
        {"run_id": "a", "corpus_fingerprint": "c", "batch": {"completed_papers": 1, "total_papers": 2, "output_rows": "7"}, "per_paper": [{"pmid": "1", "status": "ok"}, {"pmid": "2", "status": "timeout", "more": 1}], "return_code": 0},
        {"run": 17, "fingerprint": "c", "stats": {"completed": "3", "total": 3.0, "api_calls": "many"}, "returnCode": "2", "runtime": "12.5"},
        {"id": "p", "fingerprint": "c", "is_pilot": "true"},
        {"run_id": "other", "corpus_fingerprint": "d"},
        {"note": "no run"},
        [1, 2],
    ]
    for k, f in enumerate(files):
        (tmp_path / f"{k}.json").write_text(json.dumps(f, indent=1))
    (tmp_path / "bad.json").write_text("{broken")
    (tmp_path / "not.txt").write_text("{}")
    v = manifests.read_variants(spark, str(tmp_path))
    got = {r["run_id"]: r for r in runs.batch_rows(manifests.manifests(v, "c").withColumn("time_block", runs.time_block("started"))).collect()}
    assert got.keys() == {"a", "17"}
    assert (got["a"]["completed_papers"], got["a"]["total_papers"], got["a"]["failed_papers"], got["a"]["output_rows"]) == (1, 2, 0, 7)
    assert (got["17"]["completed_papers"], got["17"]["total_papers"], got["17"]["return_code"], got["17"]["runtime_seconds"], got["17"]["gemini_api_calls"]) == (3, 3, 2, 12.5, 0)
    assert {r["run_id"] for r in manifests.manifests(v, pilots=True).collect()} == {"a", "17", "p", "other"}
    told = manifests.shape(v).first()
    assert told["unreadable"] == 1 and told["schema"] == "VARIANT"  # objects and a list have nothing else in common
    (tmp_path / "5.json").unlink()
    assert "stats: OBJECT<" in manifests.shape(manifests.read_variants(spark, str(tmp_path))).first()["schema"]


def test_long_numbers_sort_by_their_value(spark):
    words = ["a123456789012999", "a123456789012", "a9", "a10", "a009", "b1", "a123456789013"]
    got = [r["w"] for r in spark.createDataFrame([(w,) for w in words], "w string").orderBy(natural_key("w"), "w").collect()]
    assert got == ["a009", "a9", "a10", "a123456789012", "a123456789013", "a123456789012999", "b1"]
    assert pd.Series(got).is_unique
