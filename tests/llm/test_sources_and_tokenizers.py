"""Mixing, tokenizer alignment and the divergence audit against brute force, on odd input and on the given tables."""

import bisect
import collections
import hashlib
import math
import re

import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import types as T
from tokenizers import Tokenizer

from glossa.llm import alignment, divergence, mixing
from glossa.llm.queries import tokenizer_path

from .conftest import lower
from .test_properties import ALPHABET

SCHEMA = T.StructType([T.StructField(n, t) for n, t in [("doc_id", T.LongType()), ("text", T.StringType()), ("lang", T.StringType()), ("source", T.StringType()), ("row", T.StringType()), ("size", T.StringType()), ("at", T.StringType()), ("block", T.StringType())]])


def frame(spark, rows, parts=3):
    """Rows (doc_id, text, lang, source) beside columns whose names operators use inside."""
    return spark.createDataFrame([(*r, "r", "s", "a", "b") for r in rows], SCHEMA).repartition(parts)


ODD = [
    (None, None, None, None), (1, None, "en", "s1"), (2, "", "en", "s1"), (3, "  \n ", "de", ""), (4, "one two\tthree\n", "en", "s2"), (4, "one two\tthree\n", "en", "s2"), (5, "Word " * 4000, "en", "s2"), (6, "a b c", None, None),
    (7, "a b c", None, "s3"), (8, "ÀÉ straße x1y2 don't", "de", "s3"), (9, "x" * 3000, "fr", "s1"), (10, "Word word WORD two", "en", "s3"), (11, "only here", "en", "s4"), (None, "a b", "en", "s2"),
]


def of_tables(spark, sf_dir):
    return [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source").collect()]


def brute_targets(sizes):
    """Targets by sharing again and again."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    total, capped = 1.5 * sum(sizes.values()), set()
    while True:
        open_ = [s for s in names if s not in capped]
        left = total - sum(2 * sizes[s] for s in capped)
        got = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if got[s] > 2 * sizes[s]}
        if not over:
            return got | {s: 2.0 * sizes[s] for s in capped}
        capped |= over


@pytest.mark.parametrize("given_rows", [ODD, [(i, "w " * (i % 50 + 1), "en", f"s{i % 3}" if i % 4 else "hot") for i in range(800)], None], ids=["odd", "many", "tables"])
def test_mix_meets_its_targets(spark, sf_dir, given_rows):
    rows = given_rows or of_tables(spark, sf_dir)
    got = mixing.copies(frame(spark, rows)).collect()
    assert sorted(got, key=str) == sorted(mixing.copies(frame(spark, rows, 5)).collect(), key=str)  # reruns agree, however rows are dealt
    sizes = collections.Counter()
    for _, text, _, source in rows:
        sizes[source] += len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    targets = brute_targets(dict(sizes))
    assert collections.Counter((r["doc_id"], r["source"], r["size"]) for r in got) == collections.Counter((i, s, len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for i, t, _, s in rows)
    taken, largest = collections.Counter(), collections.Counter()
    for r in got:
        rate = targets[r["source"]] / sizes[r["source"]] if sizes[r["source"]] else 0
        assert r["source_size"] == sizes[r["source"]] and math.isclose(r["target"], targets[r["source"]], rel_tol=1e-12)
        assert r["copies"] in (math.floor(rate + 1e-9), math.ceil(rate - 1e-9)) and r["copies"] <= 2
        taken[r["source"]] += r["size"] * r["copies"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
    assert all(abs(taken[s] - targets[s]) <= 1.001 * largest[s] + 1e-6 * sizes[s] for s in sizes)


def test_mix_returns_whole_rows_as_often_as_they_are_taken(spark):
    docs = frame(spark, ODD)
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    want = collections.Counter()
    for r in mixing.copies(docs).collect():
        want[r["doc_id"], r["source"], r["size"]] += r["copies"]
    assert collections.Counter((r["doc_id"], r["source"], len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))) for r in mixed.collect()) == +want
    assert mixing.mix_digest(frame(spark, [])).count() == 0 and mixing.mix(frame(spark, [])).count() == 0


def test_mix_runs_no_python(spark):
    plan = mixing.mix_digest(frame(spark, ODD))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan) and "BroadcastHashJoin" in plan


def test_rows_repeated_without_end_are_dealt_to_many_ranges(spark):
    got = mixing.copies(frame(spark, [(1, "a b", "en", "s")] * 5000)).collect()
    assert abs(sum(r["copies"] for r in got) - 7500) <= 1 and {r["copies"] for r in got} == {1, 2}


def brute_alignment(rows):
    first = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    first.encode_special_tokens = True
    second = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    byte = alignment._byte_of()
    done, held, best = [], collections.Counter(), collections.Counter()
    for i, text in rows:
        a, b = (first.encode(" " + text, add_special_tokens=False).ids, second.encode(text)) if text else ([], [])
        raw = [[bytes(byte[c] for c in first.id_to_token(x)) for x in a], [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x..>", p := second.id_to_piece(x)) else p.replace("▁", " ").encode() for x in b]]
        if not text or any(b"".join(x) != (" " + text).encode() for x in raw):
            done.append((i, 0, 0, 0, collections.Counter(), ""))
            continue
        ends = [[sum(map(len, x[: k + 1])) for k in range(len(x))] if len(x) < 200 else list(__import__("itertools").accumulate(map(len, x))) for x in raw]
        cuts = sorted(set(ends[0]) & set(ends[1]))
        groups = [([], []) for _ in cuts]
        for side, ids in enumerate((a, b)):
            for x, e in zip(ids, ends[side], strict=True):
                groups[bisect.bisect_left(cuts, e)][side].append(x)
        links = collections.Counter((x, y) for g in groups for x in g[0] for y in g[1])
        held.update(links.keys())
        said = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        done.append((i, len(a), len(b), len(cuts), links, hashlib.sha256(said.encode()).hexdigest()))
    for (x, _), n in held.items():
        best[x] = max(best[x], n)
    return [(i, n_a, n_b, n, sum(k.values()), sum(c for p, c in k.items() if held[p] == best[p[0]]), sum(c * held[p] for p, c in k.items()), sha) for i, n_a, n_b, n, k, sha in done]


def align(docs):
    got = alignment.align_tokenizers(docs, tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return sorted(map(tuple, got.collect()), key=str)


STRANGE = ["<|endoftext|> and <s> </s> <unk> <0x41>", "a ▁ b", "tab\tand\r\nlines\r\n  {\r\n", "　wide　 blank", "no-break  blank  x\u0085 y", "é ﬁ ½ 😀😀 中文字 кириллица", "\x00\x01 \x1c", "   ", "\n\n \n", "a  b   c ", " lead", "ab" * 2000, "don't we'LL 1234567 a1b2", "﻿mark ​ x", "Word " * 3000]


def test_alignment_equals_brute_force(spark, sf_dir):
    rows = [(r[0], r[1]) for r in ODD] + [(100 + k, t) for k, t in enumerate(STRANGE)] + [(100, STRANGE[0])]
    assert align(frame(spark, [(i, t, None, None) for i, t in rows])) == sorted(brute_alignment(rows), key=str)
    tables = [r[:2] for r in of_tables(spark, sf_dir)]
    assert align(frame(spark, [(*r, None, None) for r in tables])) == sorted(brute_alignment(tables), key=str)
    assert align(frame(spark, [])) == []


BOTH = alignment._Tokenizers(open(tokenizer_path("byte_bpe_50k.json"), encoding="utf-8").read(), open(tokenizer_path("piece_bpe_32k.model"), "rb").read())


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.lists(st.sampled_from([*ALPHABET, " ", " ", "▁", ";\r", "{", "}\r"]), min_size=1, max_size=60).map("".join), st.text(min_size=1, max_size=40)))
def test_runs_are_tokenized_as_within_their_text(text):
    import numpy as np

    raw = np.frombuffer((" " + text).encode(), np.uint8)
    starts = alignment._runs(raw, np.array([0]))
    runs = [raw[a:b].tobytes().decode() for a, b in zip(starts, np.append(starts[1:], len(raw)), strict=True)]
    got = BOTH.encode(runs)
    a, b = BOTH.a.encode(" " + text, add_special_tokens=False).ids, BOTH.b.encode(text)
    back = b"".join(BOTH.a_bytes[i] for i in a) == raw.tobytes() == b"".join(BOTH.b_bytes[i] for i in b)
    assert back == all(x is not None for x in got)
    if back:
        assert ([i for x in got for i in x[0]], [i for x in got for i in x[1]]) == (a, b)


def brute_divergence(rows, least, top):
    count, docs, groups = collections.defaultdict(collections.Counter), collections.defaultdict(collections.Counter), collections.defaultdict(set)
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        found = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower(text))
        groups[lang].add(source)
        count[lang, source].update(found)
        docs[lang].update(set(found))
    out = []
    for lang, sources in groups.items():
        kept = sorted((t for t, n in docs[lang].items() if n >= least), key=lambda t: t.encode())

        def frequencies(c, kept=kept):
            n = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 2) // (n + 2 * len(kept)) for t in kept}

        p = {s: frequencies(count[lang, s]) for s in sources}
        q = frequencies(sum((count[lang, s] for s in sources), collections.Counter()))
        for s in sources:
            pairs = [(-sum((p[s][t] - p[o][t]) ** 2 // (p[s][t] + p[o][t]) for t in kept), o.encode()) for o in sources if o != s]
            terms = [(-((p[s][t] - q[t]) ** 2 // (p[s][t] + q[t])), t.encode()) for t in kept if count[lang, s][t] and p[s][t] > q[t]]
            out += [(lang, s, "pair", o.decode(), -v, k) for k, (v, o) in enumerate(sorted(pairs), 1)]
            out += [(lang, s, "term", t.decode(), -v, k) for k, (v, t) in enumerate(sorted(terms)[:top], 1)]
    return sorted(out)


@pytest.mark.parametrize("least, top", [(1, 3), (2, 10), (10, 10)])
def test_divergence_equals_brute_force(spark, sf_dir, least, top):
    for rows in (ODD, [(i, " ".join(f"{'xyz'[i % 3]}w{chr(97 + j % 26)}" for j in range(i % 40)) + " The the", ("en", "de")[i % 7 == 0], f"s{i % 9}") for i in range(300)], of_tables(spark, sf_dir)):
        got = divergence.source_divergence(frame(spark, rows), least, top)
        assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
        assert sorted(map(tuple, got.collect())) == brute_divergence(rows, least, top)


def test_divergence_of_nothing(spark):
    assert divergence.source_divergence(frame(spark, [])).count() == 0


def test_frequencies_are_exact_beyond_64_bits():
    import numpy as np

    for count, total in [(0, 2), (10**12, 3 * 10**12 + 7), (5 * 10**14, 10**15 + 1), (7, 9 * 10**15)]:
        assert divergence._frequency(np.array([count]), np.array([total])).tolist() == [1 + 10**9 * (count + 2) // total]
