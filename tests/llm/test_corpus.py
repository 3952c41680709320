"""Operators that need facts about the whole corpus, against brute force on small data."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from glossa.llm import bytescan, embeddings, exchange, graph, linededup, lm, neardup, toxicity
from glossa.llm.common import pack_sorted, unpack_sorted

from .conftest import lower

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ODD = [None, "", "   ", "\n\n\n", "a\nb", "é", "tie", "tie", "x y " * 3000, "z" * 100_000]


@pytest.fixture(autouse=True)
def small_blocks(monkeypatch):
    """Several blocks even on small data."""
    monkeypatch.setattr(exchange, "BLOCK_BYTES", 20_000)


@pytest.mark.parametrize("operator", [lm.lm_scores, linededup.dedup_lines, neardup.near_duplicates])
def test_partitions_of_several_shards(spark, sf_dir, docs_of, monkeypatch, operator):
    docs = docs_of(real(spark, sf_dir, 60), 4)
    rows = lambda: sorted((tuple(r) for r in operator(docs).collect()), key=str)
    want = rows()
    # Many more shards than a block's keys fall to, and than partitions.
    monkeypatch.setattr(exchange, "shards_for", lambda n: 5000)
    monkeypatch.setattr(exchange, "PARTITIONS", 3)
    assert rows() == want


def test_shards_of_keys():
    keys = np.sort(np.random.default_rng(0).integers(0, 1 << 64, 200, np.uint64))
    other = keys[::3]
    parts = exchange.shard_parts(1 << 22, keys, other)
    assert [s for s, _ in parts] == sorted({int(k >> np.uint64(32)) * (1 << 22) >> 32 for k in keys})
    for at, k in enumerate((keys, other)):
        assert np.array_equal(np.concatenate([k[own[at]] for _, own in parts]), k)
    assert exchange.shard_parts(4, keys[:0]) == []


def real(spark, sf_dir, n=80):
    return [(r[0], r[1]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").limit(n).select("doc_id", "text").collect()]


def brute_lm(rows):
    crc = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 7
    texts = [(i, [*re.findall(r"[^\x20\x09-\x0D]+", lower(t)), "\0end"]) for i, t in rows]
    train = [t for i, t in texts if crc(i) != 2]
    uni, pairs = Counter(w for t in train for w in t), Counter(p for t in train for p in zip(["\0begin", *t], t))
    n, v = sum(uni.values()), len(uni)
    ones, twos = (sum(c == k for c in uni.values()) for k in (1, 2))
    d = ones / (ones + 2 * twos) if ones and twos else 0.5
    p1 = lambda w: (uni[w] - d if w in uni else d * v) / n if n else 1.0
    context = dict(uni) | {"\0begin": uni["\0end"]}
    out = {}
    for i, t in texts:
        score = 0.0
        for a, w in zip(["\0begin", *t], t):
            c = context.get(a, 0)
            m = lm.SPREAD * c**lm.GROWTH
            score += math.log10((pairs[a, w] + m * p1(w)) / (c + m) if c else p1(w))
        out[i] = (crc(i) == 2, len(t), sum(w in uni for w in t), n, sum(math.log10((uni[w] + 1) / (n + v + 1)) for w in t), score)
    return out


def test_lm_scores(spark, sf_dir, docs_of):
    rows = [*real(spark, sf_dir), *((5000 + i, t) for i, t in enumerate(ODD)), (None, "no id")]
    want = brute_lm(rows)
    got = {r["doc_id"]: tuple(r)[1:] for r in lm.lm_scores(docs_of(rows, 4)).collect()}
    assert got.keys() == want.keys()
    for i, w in want.items():
        assert got[i][:4] == w[:4]
        assert got[i][4:] == pytest.approx(w[4:], rel=1e-9)
    held = [w for w in want.values() if w[0]]
    assert sum(w[5] for w in held) > sum(w[4] for w in held)


def test_lm_probabilities_sum_to_one():
    # Every context's pairs sum to its count; the begin counts as often as the end, word 3.
    counts, pairs = np.array([5, 3, 0, 2]), np.array([2, 3, 2, 3])
    model = lm.Automaton(counts, 3, np.array([-1, 0, 0, 1]), np.array([0, 1, 3, 0]), pairs, 10, 3, 0.5)
    for before in ([], [0], [1]):
        base = model.walk(before)
        # Known words and the one unknown word.
        assert sum(10 ** (model.walk([*before, w]) - base) for w in range(4)) == pytest.approx(1)


def test_lm_without_training_rows(docs_of):
    held = next(i for i in range(1000) if zlib.crc32(str(i).encode()) % 7 == 2)
    r = lm.lm_scores(docs_of([(held, "a b")])).first()
    assert (r["n_known"], r["train_tokens"], r["score"]) == (0, 0, 0)
    assert lm.lm_scores(docs_of([]).where("false")).count() == 0


def brute_lines(rows):
    seen, out = set(), {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        if t is None:
            out[i] = (0, 0, None)
            continue
        lines, gone = t.split("\n"), set()
        for k in range(len(lines) - 2):
            w = tuple(lines[k : k + 3])
            if any(w) and w in seen:
                gone |= {k, k + 1, k + 2}
            seen.add(w)
        out[i] = (len(lines), len(gone), "\n".join(x for k, x in enumerate(lines) if k not in gone))
    return out


def test_line_dedup(spark, sf_dir, docs_of):
    rng = random.Random(3)
    made = [(9000 + i, "\n".join(rng.choice("abcde") for _ in range(rng.randint(1, 9)))) for i in range(60)]
    rows = [*real(spark, sf_dir, 200), *((5000 + i, t) for i, t in enumerate(ODD)), *made, (9990, "\n\n\n\n"), (9991, "\n\n\n\n")]
    got = {r["doc_id"]: (r["n_lines"], r["n_removed"], r["text"]) for r in linededup.dedup_lines(docs_of(rows, 5)).collect()}
    assert got == brute_lines(rows)
    kept = linededup.without_repeated_lines(docs_of([(1, "a\nb\nc"), (2, "a\nb\nc"), (3, None), (4, "")]))
    assert kept.columns == ["doc_id", "text", "row", "bin", "block"]
    assert {r["doc_id"] for r in kept.collect()} == {1, 3, 4}
    assert linededup.dedup_lines(docs_of([]).where("false")).count() == 0


def brute_classes(rows):
    """Components of weighted Jaccard similarity >= 0.8 over all pairs."""
    grams = {}
    for i, t in rows:
        w = WORD.findall(lower(t))
        if w:
            grams[i] = Counter(zip(*[w[k:] for k in range(5)])) if len(w) >= 5 else Counter([tuple(w)])
    df = Counter(g for c in grams.values() for g in c)
    scale = math.log2(len(rows) + 1)
    weigh = lambda g, n: n * (1 + neardup.IDF_SHARE * (1 - min(1, math.floor(math.log2(df[g])) / scale)))
    w = {i: {g: weigh(g, n) for g, n in c.items()} for i, c in grams.items()}
    parent = {i: i for i, _ in rows}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    near = set()
    ids = sorted(w)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = sum(min(x, w[b][g]) for g, x in w[a].items() if g in w[b])
            if both:
                s = both / (sum(w[a].values()) + sum(w[b].values()) - both)
                if s >= 0.8:
                    parent[max(root(a), root(b))] = min(root(a), root(b))
                elif s > 0.75:
                    near.add((a, b))
    return {i: root(i) for i, _ in rows}, near


def test_near_duplicates(spark, sf_dir, docs_of):
    rng = random.Random(5)
    vocabulary = [f"w{k}" for k in range(500)]
    origin = [rng.choice(vocabulary) for _ in range(300)]
    copies = []
    for k in range(40):
        c = list(origin)
        for _ in range(k // 4):
            c[rng.randrange(300)] = f"new{rng.random()}"
        copies.append((9000 + k, " ".join(c)))
    rows = [*real(spark, sf_dir, 200), *((5000 + i, t) for i, t in enumerate(ODD)), *copies, (9990, "Tie!"), (9991, "One two three"), (9992, "one, TWO three.")]
    want, _ = brute_classes(rows)
    got = neardup.near_duplicates(docs_of(rows, 5)).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(i for i, _ in rows)
    assert {r["doc_id"]: r["component_id"] for r in got} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)
    kept = neardup.without_near_duplicates(docs_of(rows, 5))
    assert {r["doc_id"] for r in kept.collect()} == set(want.values())


def test_near_duplicates_of_repeated_rows_and_empty_tables(docs_of):
    text = "one two three four five six seven"
    rows = [(7, text), (7, text), (3, text), (3, text), (None, text), (None, None), (9, "a b"), (9, "c d"), (None, "e f"), (None, "e f")]
    got = neardup.near_duplicates(docs_of(rows)).collect()
    assert Counter((r["doc_id"], r["component_id"], r["kept"]) for r in got) == Counter({(7, 3, False): 2, (3, 3, True): 1, (3, 3, False): 1, (None, 3, False): 1, (None, None, True): 2, (None, None, False): 1, (9, 9, True): 2})
    # One row of each class stays, and texts of one id that differ are no copies.
    assert Counter((r["doc_id"], r["text"]) for r in neardup.without_near_duplicates(docs_of(rows)).collect()) == Counter([(3, text), (None, None), (9, "a b"), (9, "c d"), (None, "e f")])
    assert neardup.near_duplicates(docs_of([]).where("false")).count() == 0
    assert neardup.without_near_duplicates(docs_of([]).where("false")).count() == 0


def test_consistent_sampling_estimates_weighted_jaccard():
    rng = np.random.default_rng(2)
    keys = rng.integers(1, 2**63, 400).astype(np.uint64)
    wa, wb = rng.uniform(0.5, 3, 300), rng.uniform(0.5, 3, 300)
    a, b = keys[:300], keys[100:]
    sampled = neardup.samples(np.concatenate([a, b]), np.concatenate([wa, wb]), np.array([0, 300]), 2000)
    both = np.minimum(wa[100:], wb[:200]).sum()
    truth = both / (wa.sum() + wb.sum() - both)
    assert (sampled[0] == sampled[1]).mean() == pytest.approx(truth, abs=0.04)


def test_chunk_pairs_equal_pairwise_similarity():
    rng, scale = random.Random(1), 10.0
    block, sets = neardup._Block(scale), {}
    base = [rng.randrange(2**64) for _ in range(60)]
    code = {k: rng.randrange(4) for k in base}
    for u in range(30):
        own = sorted({*rng.sample(base, 55), *(rng.randrange(2**64) for _ in range(rng.randrange(8)))})
        counts, codes = np.array([rng.choice([1, 1, 2]) for _ in own]), np.array([code.get(k, 0) for k in own], np.uint8)
        blob = neardup.vector(np.array(own, np.uint64), counts, codes)
        sets[u] = neardup._weighted(blob, scale)
        assert sets[u][1] == pytest.approx(neardup.weights_of(counts, codes, scale), abs=0)
        block.rows[0].append((u, blob))
        block.rows[1].append((u, blob))
    got, want = defaultdict(set), defaultdict(set)
    for links, pairs in ((got, block.links()), (want, [(u, v) for u in sets for v in sets if u < v and neardup.similarity(sets[u], sets[v]) >= 0.8])):
        for u, v in pairs:
            joined = {u, v} | links[u] | links[v]
            for x in joined:
                links[x] = joined
    assert {frozenset(x) for x in got.values()} == {frozenset(x) for x in want.values()}


def test_near_duplicates_of_very_long_texts_in_small_chunks(docs_of, monkeypatch):
    monkeypatch.setattr(neardup, "CHUNK_SHINGLES", 2000)
    rng = random.Random(8)
    long = [f"w{rng.randrange(10**6)}" for _ in range(30_000)]
    almost = [w if k % 60 else "other" for k, w in enumerate(long)]
    made = [(100 + k, " ".join(f"v{(k // 3) * 1000 + j + (j % 37 == k % 3)}" for j in range(200))) for k in range(30)]
    rows = [(1, " ".join(long)), (2, " ".join(almost)), (3, "short text"), *made]
    want, _ = brute_classes(rows)
    assert {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(docs_of(rows)).collect()} == want
    assert want[2] == 1


def test_components(spark):
    rng = random.Random(9)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + k, 101 + k) for k in range(30)] + [(200, 201 + k) for k in range(30)] + [(5, 5)]
    parent = {x: x for e in edges for x in e}

    def root(x):
        return x if parent[x] == x else root(parent[x])

    for u, v in edges:
        parent[max(root(u), root(v))] = min(root(u), root(v))
    linked = {x for u, v in edges if u != v for x in (u, v)}
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: root(x) for x in linked}


def test_sorted_keys_round_trip():
    keys = np.sort(np.random.default_rng(0).integers(0, 2**64, 1000, dtype=np.uint64))
    assert (unpack_sorted(pack_sorted(keys)) == keys).all() and len(unpack_sorted(pack_sorted(keys[:0]))) == 0


def labelled(spark, n=400):
    rng = random.Random(4)
    words = [f"w{k}" for k in range(300)]
    docs, labels = [], []
    for i in range(n):
        toxic = i % 3 == 0
        t = [rng.choice(words) for _ in range(rng.randint(20, 200))]
        for _ in range(rng.randint(2, 6) if toxic else 0):
            t.insert(rng.randrange(len(t)), rng.choice(["Idiot", "scum!", "trash,"]))
        docs.append((i, " ".join(t)))
        labels.append((i, int(toxic)))
    return docs, labels


def test_toxicity_held_out_accuracy(spark, docs_of):
    docs, labels = labelled(spark)
    got = toxicity.toxicity_scores(docs_of([*docs, *((5000 + i, t) for i, t in enumerate(ODD)), (None, "scum")]), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    truth = dict(labels)
    held = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    assert len(held) > 40 and all(r["predicted"] == truth[r["doc_id"]] for r in held)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got if r["doc_id"] is not None)
    clean = toxicity.drop_toxic(docs_of(docs), spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert clean.columns == ["doc_id", "text", "row", "bin", "block"]
    assert {r["doc_id"] for r in clean.collect()} == {i for i, t in labels if not t}


def test_toxicity_ignores_labels_of_the_held_out_fold(spark, docs_of):
    docs, labels = labelled(spark, 200)
    flipped = [(i, 1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t) for i, t in labels]
    runs = [{r["doc_id"]: r["score"] for r in toxicity.toxicity_scores(docs_of(docs), spark.createDataFrame(x, "doc_id long, toxic int")).collect()} for x in (labels, flipped)]
    assert runs[0] == runs[1]


def test_toxicity_without_a_model(spark, docs_of):
    none = spark.createDataFrame([(1, None)], "doc_id long, toxic int")
    assert [(r["score"], r["predicted"]) for r in toxicity.toxicity_scores(docs_of([(1, "a")]), none).collect()] == [(0.0, 0)]
    assert toxicity.drop_toxic(docs_of([(1, "a")]), none).count() == 1


def test_toxicity_gives_rare_expressions_a_smaller_weight(spark):
    docs, labels = labelled(spark, 150)
    truth, texts = dict(labels), {i: t for i, t in docs}
    rows = [(t + (" wretch" if truth[i] and i % 45 == 0 else "") + (" dear" if i % 2 == 0 else ""), truth[i]) for i, t in texts.items()]
    model = toxicity.fit(rows)
    assert (model.ratios != 0).all()
    said = {w: float(model.evidence(pa.array([w]))[0][0]) for w in ("idiot", "wretch", "dear", "never seen")}
    assert said["idiot"] > 2 * said["wretch"] > 0 and abs(said["dear"]) < 0.1 * said["idiot"] and abs(said["never seen"]) < 0.1 * said["idiot"]
    rare = toxicity.fit([("a b c d", 0), ("a c b d", 0), ("a b scum c", 1), ("scum b d a", 1)])
    assert rare.evidence(pa.array(["c scum d"]))[0][0] > 0
    # Nothing was told of texts not seen: ranked, and not rejected.
    low, high = (rare.score(*rare.evidence(pa.array([x])))[0] for x in ("a b", "scum scum"))
    assert 0 < low < high < 0.5


@pytest.mark.parametrize("place", [0, 3, 10])
def test_toxicity_sample_keeps_the_rows_behind_a_long_text(spark, docs_of, monkeypatch, place):
    monkeypatch.setattr(toxicity, "SAMPLE_BYTES", 60_000)
    docs, labels = labelled(spark, 60)
    table = spark.createDataFrame(labels, "doc_id long, toxic int")
    whole = list(toxicity.training_sample(docs_of(docs), table))
    assert Counter(t for _, t in whole) == Counter(t for i, t in labels if zlib.crc32(str(i).encode()) % 5) and {t for t, _ in whole} <= {t for _, t in docs}
    long = dict(docs) | {next(i for i, t in docs if t == whole[place][0]): "long wörds " * 10_000}
    got = list(toxicity.training_sample(docs_of(long.items()), table))
    assert [t for _, t in got] == [t for _, t in whole]
    assert [k for k in range(len(got)) if got[k] != whole[k]] == [place]
    assert 1000 < len(got[place][0]) and sum(len(t.encode()) for t, _ in got) <= 60_000


def test_toxicity_sample_takes_one_text_of_a_repeated_id(spark, docs_of):
    docs = [*((1, f"text {k}") for k in range(50)), (2, "other"), (3, None)]
    table = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (3, 0), (4, 1)], "doc_id long, toxic int")
    got = list(toxicity.training_sample(docs_of(docs), table))
    assert len(got) == len({i for i in (1, 2, 3) if zlib.crc32(str(i).encode()) % 5}) and sum(t.startswith("text") for t, _ in got) <= 1
    assert got == list(toxicity.training_sample(docs_of(docs, 2), table))


def test_toxicity_probabilities_of_words_sum_to_one_in_each_class(spark):
    docs, labels = labelled(spark, 40)
    truth = dict(labels)
    sample = toxicity._Sample(pa.array([t for _, t in docs]), np.array([truth[i] for i, _ in docs]))
    for seen in (np.ones(len(docs), bool), np.arange(len(docs)) % 3 > 0):
        p, q = sample.probabilities(seen)
        assert all(x.sum() == pytest.approx(1) and (x > 0).all() for x in p) and len(p[0]) == len(sample.kinds) + 1
        assert all((x > 0).all() and (x < 1).all() for x in q)


def test_toxicity_probabilities_equal_their_definition():
    texts, y = ["you fool you fool stop", "a fine day a fine walk", "you stop fool", "a day"], [1, 0, 1, 0]
    d = toxicity.DISCOUNT
    sample = toxicity._Sample(pa.array(texts), np.array(y))
    (p, _), words = sample.probabilities(np.ones(4, bool)), sorted({w for t in texts for w in t.split()})
    number = {w: int(np.searchsorted(sample.kinds, bytescan.scan(pa.array([w])).hashes()[0])) for w in words}
    before = {(c, w): {a for t, k in zip(texts, y) if k == c for a, b in zip(["", *t.split()], t.split()) if b == w} for c in (0, 1) for w in words}
    n = {c: sum(len(before[c, w]) for w in words) for c in (0, 1)}
    shared = {w: (len(before[0, w]) + len(before[1, w])) / (n[0] + n[1]) for w in words}
    own = lambda c, w: (max(len(before[c, w]) - d, 0) + d * sum(bool(before[c, x]) for x in words) * shared[w]) / n[c]
    for w in words:
        # Between the class's own estimate and the shared one, at the same point in both classes.
        mixed = [(p[k][number[w]], own(c, w), shared[w]) for k, c in ((0, 1), (1, 0))]
        assert all(min(o, s) * 0.8 <= x <= max(o, s) * 1.25 for x, o, s in mixed)
    assert p[0][number["fool"]] > p[1][number["fool"]] and p[0][number["fine"]] < p[1][number["fine"]]


def brute_vectors(rows):
    good = {k: np.array(v, float) for k, (_, v) in enumerate(rows) if v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    unit = {k: v / np.linalg.norm(v / np.abs(v).max()) / np.abs(v).max() for k, v in good.items()}
    links = {k: [j for j in unit if j != k and len(unit[k]) == len(unit[j]) and unit[k] @ unit[j] >= 0.9 - 1e-12] for k in unit}
    label = {k: rows[k][0] for k in range(len(rows))}
    while True:
        new = {k: min([label[k], *(label[j] for j in links.get(k, []))]) for k in label}
        if new == label:
            return Counter((rows[k][0], len(links.get(k, [])), label[k], rows[k][0] == label[k]) for k in label)
        label = new


@pytest.mark.parametrize("chunk", [2048, 7])
def test_near_vectors(spark, monkeypatch, chunk):
    monkeypatch.setattr(embeddings, "CHUNK", chunk)
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(300)]
    for i in range(60):
        c = np.array(rows[i % 12][1])
        rows.append((1000 + i, (c + rng.normal(size=8) * 0.05).tolist()))
    rows += [(2000, rows[3][1]), (2001, rows[3][1]), (2002, None), (2003, [0.0] * 8), (2004, [1.0] * 5), (2005, [float("nan")] + [1.0] * 7), (2006, [None] + [1.0] * 7), (2007, [x * 3 for x in rows[4][1]]), (2008, [x * 1e300 for x in rows[5][1]]), (2009, [])]
    got = embeddings.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("cell", F.lit("x")))
    want, found = brute_vectors(rows), Counter(map(tuple, got.collect()))
    total = lambda c: sum(r[1] * n for r, n in c.items())
    assert Counter(r[0] for r in want.elements()) == Counter(r[0] for r in found.elements())
    assert 0.9 * total(want) <= total(found) <= total(want)
    assert sum((want & found).values()) >= 0.95 * len(rows)
    for odd in (2002, 2003, 2004, 2005, 2006, 2009):
        assert found[odd, 0, odd, True] == 1


def test_near_vectors_of_several_lengths_and_repeated_ids(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(200)]
    rows += [(500 + i, rng.normal(size=5).tolist()) for i in range(100)]
    rows += [(700 + i, (np.array(rows[200 + i][1]) + 0.01).tolist()) for i in range(20)]
    # Few of a length: the sample's index has one cell, and all are compared.
    rows += [(800, [1.0, 2.0]), (801, [2.0, 4.0]), (802, [1.0, 2.1]), (803, [-1.0, 2.0])]
    # One id with two vectors, of which each has its own links; the other's are not added to them.
    rows += [(900, rows[0][1]), (900, rows[1][1]), (901, rows[0][1])]
    want, found = brute_vectors(rows), Counter(map(tuple, embeddings.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()))
    assert found.total() == len(rows) and sum((want & found).values()) >= 0.97 * len(rows)
    assert found[801, 2, 800, False] == found[900, 2, 0, False] == found[900, 1, 1, False] == 1


def test_near_vectors_of_the_tables(spark, sf_dir, monkeypatch):
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    monkeypatch.setattr(embeddings, "SAMPLE", 256)
    x = np.array([r["embedding"] for r in df.orderBy("vec_id").collect()], float)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    links = int((u @ u.T >= 0.9).sum()) - len(u)
    got = embeddings.near_vectors(df)
    assert 0.9 * links <= got.agg(F.sum("n_links")).first()[0] <= links
    assert embeddings.near_vectors(df.where("false")).count() == 0


def test_traversal_visits_cells_by_distance():
    rng = np.random.default_rng(0)
    index = embeddings.MultiIndex(rng.normal(size=(5, 2)), rng.normal(size=(7, 2)), 0.0)
    near, far = index.distances(rng.normal(size=(3, 4)))
    for a, b in zip(near, far):
        seen = list(index.traverse(a, b))
        assert len({c for _, c in seen}) == 35
        assert [d for d, _ in seen] == pytest.approx(sorted((a[:, None] + b[None, :]).reshape(-1)))
