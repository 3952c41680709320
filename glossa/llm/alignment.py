"""Alignment of two tokenizers: which tokens of one stand where tokens of the other stand.

A text's tokens by tokenizer A and by tokenizer B both cover a blank and the text. Where a
token of A and a token of B end at the same byte, both are cut; the tokens between two cuts
are a group, and every token of A in a group is linked with every token of B in it.

How it runs: neither tokenizer's merges reach across a place where other text is followed by
a blank or a line feed (for B this is read off its vocabulary), so a text is a row of runs
that begin there, and tokens, cuts, groups and links of a text are those of its runs. Each
distinct run of the corpus is tokenized once and aligned once, relationally: tokens by
posexplode, byte ends by a windowed running sum, cuts where both sides meet on run and end,
group numbers by a running count of cuts. Aligning every document's own tokens this way would
move each token of the corpus through several shuffles for the same rows.

Documents are kept in blocks of bounded size, as numbers of the block's runs. The groups of
the runs that most blocks have are told to every task; other runs meet theirs in a join on
the run, a row for each block and run, and come back to the block, which brings both sides of
each group together for its links. A block sends each pair of ids with the number of its
documents that link it; these are summed, and come back in the same way. So a run or pair of
any frequency is at most one row a block.

Defined cases: null and empty texts, and texts that a tokenizer does not give back byte for
byte, have no tokens: zeros, and '' for their groups; the strings of special tokens are
plain text; a run may be as long as its text, which may be of any length; repeated rows are
documents of their own, each counted; null ids stay null; ties for a token's best partner
all count; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import bytescan as B
from .common import PARTITIONS, batch, documents, drop, frames, map_arrow, pack, place_of, shared_table, unframe, unpack
from .encoding import broadcast_tokenizer, tokenizer_json

#: Bytes of text in a block; a longer single text is a block of its own.
BLOCK_BYTES = 6 << 20
#: Partitions of runs and pairs for each block of text.
_PER_BLOCK = 1
#: The place of a block's own row, before what comes back to it.
_OWN = -1
#: A pair of ids is one number: A's above, B's below.
_PAIR_BITS = 24

# Bytes behind which a text is not cut: blanks, controls, and ends of characters that may be white space outside ASCII.
_JOINED = np.ones(256, bool)
_JOINED[0x21:0x7F] = False
_JOINED[0x80:] = False
_LEADS2, _LEADS3 = np.zeros(256, bool), np.zeros(256, bool)
_LEADS2[0xC2] = True
_LEADS3[[0xE1, 0xE2, 0xE3]] = True


def _runs(raw: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """Where runs begin: at heads, and at a blank or line feed behind other text."""
    cut = (raw == 0x20) | (raw == 0x0A)
    cut[:1] = False
    cut[1:] &= ~_JOINED[raw[:-1]]
    cut[2:] &= ~_LEADS2[raw[:-2]]
    cut[3:] &= ~_LEADS3[raw[:-3]]
    cut[heads] = True
    return np.flatnonzero(cut)


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for piece in B.chunks(batches, limit=BLOCK_BYTES):
        n = len(B.buffers(piece.column("text"))[0])
        if held and size + n > BLOCK_BYTES:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
        held.append(piece)
        size += n
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _int(x: np.ndarray) -> bytes:
    return pack(np.ascontiguousarray(x.astype("<i4").view(np.uint8).reshape(-1, 4).T))


def _from_int(raw: bytes) -> np.ndarray:
    raw = unpack(raw)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view("<i4").reshape(-1).astype(np.int64) if raw else np.zeros(0, np.int64)


_IDS = pa.schema([("doc_id", pa.int64())])


def _ids(column: pa.Array) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, _IDS, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd"))) as w:
        w.write_batch(pa.RecordBatch.from_arrays([column], schema=_IDS))
    return sink.getvalue().to_pybytes()


def _from_ids(raw: bytes) -> pa.Array:
    return pa.ipc.open_stream(raw).read_all().column(0).combine_chunks()


_BLOCK = pa.schema([("block", pa.int64()), ("payload", pa.binary()), ("runs", pa.list_(pa.string()))])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    first = TaskContext.get().partitionId() << 20
    for k, docs in enumerate(_gathered(batches)):
        raw, at = B.buffers(docs.column("text"))
        some = np.flatnonzero(np.diff(at))
        raw = np.insert(raw, at[some], np.uint8(0x20))
        heads = at[some] + np.arange(len(some))
        starts = _runs(raw, heads)
        ends = pa.py_buffer(np.append(starts, len(raw)).astype(np.int64))
        column = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, ends, pa.py_buffer(raw)]).dictionary_encode()
        counts = np.zeros(docs.num_rows, np.int64)
        counts[some] = np.diff(np.append(np.searchsorted(starts, heads), len(starts)))
        payload = frames([_ids(docs.column("doc_id")), _int(counts), _int(column.indices.to_numpy())])
        runs = column.dictionary.cast(pa.large_string()).cast(pa.string())
        yield batch(_BLOCK, [first + k], [payload], pa.ListArray.from_arrays(pa.array([0, len(runs)], pa.int32()), runs))


def _byte_of() -> dict[str, int]:
    """The byte for which each character of a byte-level vocabulary stands: printable ones for themselves, the others from U+0100 on."""
    plain = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or b >= 0xAE]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class _Tokenizers:
    """Both tokenizers, and the bytes of each of their ids."""

    def __init__(self, definition: str, model: bytes) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(definition)
        self.a.encode_special_tokens = True
        byte = _byte_of()
        size = self.a.get_vocab_size(with_added_tokens=True)
        self.a_bytes = [bytes(byte[c] for c in t) if all(c in byte for c in t) else t.encode() for t in (self.a.id_to_token(i) or "" for i in range(size))]
        self.b = sentencepiece.SentencePieceProcessor(model_proto=model)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if any("\n" in p or "▁" in p.lstrip("▁") for p in pieces):
            raise ValueError("the second vocabulary has pieces with line feeds or with blanks behind other text: runs cannot be told apart")
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.fence = self.b.encode("\n")

    def encode(self, runs: list[str]) -> list[tuple[list[int], list[int]] | None]:
        """Each run's ids by A and by B; None where the bytes of either are not the run's."""
        a = [e.ids for e in self.a.encode_batch_fast(runs, add_special_tokens=False)]
        # Behind a line feed, which merges with nothing, a run is tokenized as within its text.
        b = [x[len(self.fence) :] for x in self.b.encode(["\n" + r for r in runs], num_threads=1)]
        raw = [r.encode() for r in runs]
        return [(x, y) if b"".join([self.a_bytes[i] for i in x]) == r == b"".join([self.b_bytes[i] for i in y]) else None for x, y, r in zip(a, b, raw, strict=True)]


#: Runs of most blocks that every task gets, and the bytes that one of them has at most: some 15 MB in all.
HOT_RUNS, HOT_BYTES = 1 << 18, 32
_ENCODED = pa.schema([("run", pa.string()), ("n", pa.int64()), ("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32()))])


def _model(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def token_bytes(spark: SparkSession, a_path: str, b_path: str) -> DataFrame:
    """Both tokenizers' ids (of_b, token, bytes): as many rows as their vocabularies have entries, whatever the corpus."""
    both = _Tokenizers(tokenizer_json(a_path), _model(b_path))
    sides = [(False, both.a_bytes), (True, both.b_bytes)]
    return spark.createDataFrame(pa.table({"of_b": [s for s, x in sides for _ in x], "token": pa.array([i for _, x in sides for i in range(len(x))], pa.int32()), "bytes": pa.array([len(t) for _, x in sides for t in x], pa.int32())}))


def encoded_runs(runs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Runs (run, n) with both tokenizers' ids; those that a tokenizer does not give back are left out."""
    spark = runs.sparkSession
    model, definition = spark.sparkContext.broadcast(_model(b_path)), broadcast_tokenizer(spark, a_path)

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = _Tokenizers(definition.value, model.value)
        for b in batches:
            for k in range(0, b.num_rows, 4096):
                own = b.column("run").slice(k, 4096)
                got = both.encode(own.to_pylist())
                good = pa.array([x is not None for x in got], pa.bool_())
                yield batch(_ENCODED, own.filter(good), b.column("n").slice(k, 4096).filter(good), [x[0] for x in got if x], [x[1] for x in got if x])

    return map_arrow(runs.select("run", "n"), encoded, "run string, n long, a array<int>, b array<int>")


_KEY = ["h", "run"]


def keyed(runs: DataFrame, partitions: int) -> DataFrame:
    """Rows dealt out by a hash of their run (h). Runs are told apart by themselves; the hash makes sorting cheap."""
    return runs.withColumn("h", F.xxhash64("run")).repartition(partitions, "h")


def aligned(runs: DataFrame, sizes: DataFrame, partitions: int) -> DataFrame:
    """Per run of runs (run, a, b): its groups as text. sizes has the bytes of each token (of_b, token, bytes).

    Runs are dealt out once: all that follows looks at one run's tokens, and stays within the partition.
    """
    sides = F.array(F.struct(F.lit(False).alias("of_b"), F.col("a").alias("ids")), F.struct(F.lit(True).alias("of_b"), F.col("b").alias("ids")))
    tokens = keyed(runs.select("run", "a", "b"), partitions).select(*_KEY, F.explode(sides).alias("s")).select(*_KEY, "s.of_b", F.posexplode("s.ids").alias("pos", "token")).join(F.broadcast(sizes), ["of_b", "token"])
    end = F.sum("bytes").over(Window.partitionBy(*_KEY, "of_b").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    # Tokens of both sides meet on run and end, which is a cut if both are there. It is the equi-join of the two sides,
    # as a grouping, since each side has one token at an end: rows keep their partition, which a full join would give up.
    ends = tokens.withColumn("end", end).groupBy(*_KEY, "end").agg(F.max(F.when(~F.col("of_b"), F.col("token"))).alias("token_a"), F.max(F.when(F.col("of_b"), F.col("token"))).alias("token_b"))
    cut = (F.col("token_a").isNotNull() & F.col("token_b").isNotNull()).cast("int")
    # A token's group is the number of cuts before its end.
    before = F.coalesce(F.sum(cut).over(Window.partitionBy(*_KEY).orderBy("end").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    def said(name: str):
        own = F.array_sort(F.collect_list(F.when(F.col(name).isNotNull(), F.struct("end", F.col(name).cast("string").alias("token")))))
        return F.array_join(F.transform(own, lambda x: x["token"]), ",")

    # Every group has tokens of both sides: its last byte is a cut.
    groups = ends.withColumn("group", before).groupBy(*_KEY, "group").agg(F.concat(said("token_a"), F.lit("|"), said("token_b")).alias("said"))
    listed = groups.groupBy(*_KEY).agg(F.array_sort(F.collect_list(F.struct("group", "said"))).alias("g"))
    return listed.select(*_KEY, F.array_join("g.said", ";").alias("groups"))


def _own_session(spark: SparkSession) -> SparkSession:
    """A session whose joins take rows dealt out by a part of the join's keys as they are, and which deletes a query's shuffle files at its end: what it gives is written."""
    own = spark.newSession()
    own.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    own.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    for key in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone", "spark.sql.adaptive.advisoryPartitionSizeInBytes"):
        own.conf.set(key, spark.conf.get(key))
    return own


def _returned(blocks: DataFrame, n: int, stride: int, answers: DataFrame, columns: list[str], done: Callable[[bytes, pa.Table], pa.RecordBatch], schema: str) -> DataFrame:
    """Blocks (block, payload) with the rows of answers (block, at and columns) that come back to each, in order of at."""
    more = [c for c in columns if c != "at"]
    own = blocks.select("block", F.lit(_OWN).alias("at"), "payload", *[F.lit(None).cast(answers.schema[c].dataType).alias(c) for c in more])
    rows = answers.select("block", "at", F.lit(None).cast("binary").alias("payload"), *more)
    home = F.pmod(F.shiftright("block", 20) * stride + F.col("block").bitwiseAND((1 << 20) - 1), F.lit(n)).cast("int")
    both = own.unionByName(rows).repartitionById(n, home).sortWithinPartitions("block", "at")

    def finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        payload, held = None, []
        for b in batches:
            heads = np.flatnonzero(b.column("at").to_numpy() == _OWN)
            for a, z in zip(np.append([0], heads), np.append(heads, b.num_rows), strict=True):
                if z > a:
                    if a in heads:
                        if payload is not None:
                            yield done(payload, pa.Table.from_batches(held).select(columns))
                        payload, held = b.column("payload")[int(a)].as_py(), []
                        held.append(b.slice(a, 0))
                        a += 1
                    held.append(b.slice(a, z - a))
        if payload is not None:
            yield done(payload, pa.Table.from_batches(held).select(columns))

    return map_arrow(both, finished, schema)


class _Groups:
    """The groups of runs, read from their text. A row of pairs is a pair of ids of a run's group, with how often it is linked there."""

    def __init__(self, column: pa.Array) -> None:
        raw, where = B.buffers(column.cast(pa.large_string()))
        some = np.flatnonzero(np.diff(where))
        self.text = np.insert(raw, where[1:][some], np.uint8(ord(";")))
        self.at = where + np.append(0, np.cumsum(np.diff(where) > 0))
        n = len(where) - 1
        # A number ends at each separator.
        ends = np.flatnonzero((self.text < 0x30) | (self.text > 0x39))
        sign = self.text[ends]
        digits = np.diff(ends, prepend=-1) - 1
        ids = np.zeros(len(ends), np.int64)
        for k in range(int(digits.max(initial=0))):
            has = digits > k
            ids[has] += (self.text[ends[has] - 1 - k] - 0x30).astype(np.int64) * 10**k
        # Behind a bar come the second tokenizer's ids, up to the group's end.
        last = np.maximum.accumulate(np.where(sign != ord(","), np.arange(len(sign)), -1))
        of_b = np.zeros(len(sign), bool)
        of_b[1:] = (last[:-1] >= 0) & (sign[np.maximum(last[:-1], 0)] == ord("|"))
        group = np.cumsum(sign == ord(";")) - (sign == ord(";"))
        run = np.searchsorted(self.at, ends, "right") - 1
        run_of = run[np.flatnonzero(sign == ord(";"))]
        self.n_a, self.n_b, self.n_groups = (np.bincount(x, minlength=n) for x in (run[~of_b], run[of_b], run_of))
        # Equal tokens of a group are counted, so a group gives each pair of ids once.
        key, often = np.unique((group * 2 + of_b) << _PAIR_BITS | ids, return_counts=True)
        side, ids = key >> _PAIR_BITS, key & ((1 << _PAIR_BITS) - 1)
        a = np.flatnonzero(side % 2 == 0)
        first, size = np.searchsorted(side, side[a] + 1), np.searchsorted(side, side[a] + 1, "right") - np.searchsorted(side, side[a] + 1)
        x, y = np.repeat(a, size), np.repeat(first, size) + B.ragged(size)
        self.pair, self.times = ids[x] << _PAIR_BITS | ids[y], often[x] * often[y]
        self.pairs_of = np.bincount(run_of[side[x] // 2], minlength=n)


_SUMS = pa.schema([("doc_id", pa.int64()), *((c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")), ("groups_sha256", pa.string())])
_LINKED = pa.schema([("block", pa.int64()), ("payload", pa.binary()), ("pairs", pa.list_(pa.int64())), ("docs", pa.list_(pa.int32()))])


_TOLD = pa.schema([("block", pa.int64()), ("payload", pa.binary())])
_UNTOLD = pa.schema([("block", pa.int64()), ("at", pa.int32()), ("run", pa.string())])


def _linked(payload: bytes, answers: pa.Table, hot: list[str]) -> pa.RecordBatch:
    """A block's documents with what their runs say, and the pairs that they link."""
    number, hot_at, payload = unframe(payload)
    block, hot_at = int.from_bytes(number, "little"), _from_int(hot_at) - 1
    ids, counts, order = unframe(payload)
    counts, order = _from_int(counts), _from_int(order)
    # Groups of told runs, then those that have come back; a run that a tokenizer does not give back has come without.
    back = np.full(len(hot_at), -1)
    back[answers.column("at").to_numpy()] = np.arange(len(answers))
    both = pa.concat_arrays([pa.array(hot, pa.string()), answers.column("groups").combine_chunks()])
    column = both.take(pa.array(np.where(hot_at >= 0, hot_at, back + len(hot))))
    ok = ~column.is_null().to_numpy(zero_copy_only=False)
    groups = _Groups(column)
    n_docs, doc = len(counts), np.repeat(np.arange(len(counts)), counts)
    good = counts > 0
    good[doc[~ok[order]]] = False
    own = good[doc]
    doc, order = doc[own], order[own]
    sums = [np.bincount(doc, x[order], n_docs).astype(np.int64) for x in (groups.n_a, groups.n_b, groups.n_groups)]
    pairs, times, size = groups.pair, groups.times, groups.pairs_of
    starts = np.cumsum(size) - size
    # A document's distinct runs, then its distinct pairs.
    runs, often = np.unique(doc * len(ok) + order, return_counts=True)
    run, of = runs % max(len(ok), 1), runs // max(len(ok), 1)
    names, code = np.unique(pairs, return_inverse=True)
    at = np.repeat(starts[run], size[run]) + B.ragged(size[run])
    key = np.repeat(of, size[run]) * len(names) + code[at]
    by = np.argsort(key, kind="stable")
    key, weight = key[by], (times[at] * np.repeat(often, size[run]))[by]
    first = np.flatnonzero(np.diff(key, prepend=-1))
    weight = np.add.reduceat(weight, first) if len(first) else np.zeros(0, np.int64)
    linked, pair = key[first] // max(len(names), 1), key[first] % max(len(names), 1)
    some, pair = np.unique(pair, return_inverse=True)
    # The groups of a document are those of its runs, one after the other.
    text, where = groups.text, groups.at
    digests, total = [], np.append(0, np.cumsum(np.bincount(doc, minlength=n_docs)))
    body = memoryview(text.tobytes())
    for d in range(n_docs):
        h = hashlib.sha256()
        mine = order[total[d] : total[d + 1]]
        if len(mine):
            said = b"".join([body[where[r] : where[r + 1]] for r in mine.tolist()])
            h.update(said[:-1])
        digests.append(h.hexdigest() if len(mine) else "")
    per_doc = np.bincount(linked, minlength=n_docs)
    n_links = np.bincount(linked, weight, n_docs).astype(np.int64)
    table = pa.RecordBatch.from_arrays([_from_ids(ids), *(pa.array(x) for x in (*sums, n_links)), pa.array(digests, pa.string())], schema=_SUMS)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, _SUMS, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd"))) as w:
        w.write_batch(table)
    out = frames([sink.getvalue().to_pybytes(), _int(per_doc), _int(pair), pack(weight.astype("<i8"))])
    return batch(_LINKED, [block], [out], [names[some]], [np.bincount(pair, minlength=len(some)).astype(np.int32)])


_SCHEMA = pa.schema([*list(_SUMS)[:-1], ("n_best", pa.int64()), ("count_sum", pa.int64()), ("groups_sha256", pa.string())])
_SQL = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _scored(payload: bytes, answers: pa.Table) -> pa.RecordBatch:
    table, per_doc, pair, weight = unframe(payload)
    docs = pa.ipc.open_stream(table).read_all().combine_chunks().to_batches()
    per_doc, pair, weight = _from_int(per_doc), _from_int(pair), np.frombuffer(unpack(weight), "<i8")
    doc = np.repeat(np.arange(len(per_doc)), per_doc)
    n, best = answers.column("n").to_numpy(), answers.column("best").to_numpy().astype(np.int64)
    count_sum, n_best = np.zeros(len(per_doc), np.int64), np.zeros(len(per_doc), np.int64)
    np.add.at(count_sum, doc, weight * n[pair])
    np.add.at(n_best, doc, weight * best[pair])
    own = docs[0]
    return batch(_SCHEMA, *own.columns[:5], n_best, count_sum, own.column("groups_sha256"))


def _at_hot(runs: pa.Array, hot: pa.Array) -> np.ndarray:
    """Each run's number among the told ones, or -1."""
    return pc.index_in(runs, value_set=hot).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)


def _known_here(batches: Iterator[pa.RecordBatch], hot: list[str]) -> Iterator[pa.RecordBatch]:
    """Blocks whose payload says their number and which of their runs are told."""
    told = pa.array(hot, pa.string())
    for b in batches:
        for block, payload, runs in zip(b.column("block").to_pylist(), b.column("payload"), b.column("runs"), strict=True):
            yield batch(_TOLD, [block], [frames([block.to_bytes(8, "little"), _int(_at_hot(runs.values, told) + 1), payload.as_py()])])


def _unknown_here(batches: Iterator[pa.RecordBatch], hot: list[str]) -> Iterator[pa.RecordBatch]:
    """A row for each run of a block that is not told."""
    told = pa.array(hot, pa.string())
    for b in batches:
        for block, runs in zip(b.column("block").to_pylist(), b.column("runs"), strict=True):
            at = np.flatnonzero(_at_hot(runs.values, told) < 0)
            for k in range(0, len(at), 10_000):
                own = at[k : k + 10_000]
                yield batch(_UNTOLD, np.full(len(own), block), own, runs.values.take(pa.array(own)))


def _of_most_blocks(known: DataFrame) -> DataFrame:
    """The short runs (run) of most blocks, at most HOT_RUNS: those from a number of blocks on, by eighths of powers of two."""
    level = F.floor(F.log2("n") * 8)
    short = known.where((F.octet_length("run") <= HOT_BYTES) & (F.col("n") > 1)).withColumn("level", level)
    total, least = 0, None
    # A few hundred levels, whatever the number of runs.
    for r in sorted(short.groupBy("level").agg(F.count("*").alias("runs")).collect(), reverse=True):
        total += r["runs"]
        if total > HOT_RUNS:
            break
        least = r["level"]
    return short.where(F.lit(False) if least is None else F.col("level") >= least).select("run")


def align_tokenizers(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Per document row: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    blocks = shared_table(map_arrow(documents(docs), _blocks, "block long, payload binary, runs array<string>"), "align-blocks", "zstd")
    seen = blocks.agg(F.count("*").alias("n"), F.max(F.shiftright("block", 20)).alias("p")).first()
    n = max(1, min(PARTITIONS, seen["n"] * _PER_BLOCK))
    stride = -(-seen["n"] // ((seen["p"] or 0) + 1)) or 1
    session = _own_session(docs.sparkSession)

    def within(table: DataFrame) -> DataFrame:
        return session.read.schema(table.schema).parquet(place_of(table))

    met = within(blocks).select("block", F.posexplode("runs").alias("at", "run"))
    seen_runs = met.groupBy("run").agg(F.count("*").alias("n"))
    known = shared_table(encoded_runs(seen_runs, a_path, b_path), "align-runs", "zstd")
    sizes = token_bytes(session, a_path, b_path)
    # The runs of most blocks are told to every task; all others meet their blocks in a join, where they are aligned.
    often = _of_most_blocks(known)
    hot = sorted((r["run"], r["groups"]) for r in aligned(known.join(F.broadcast(often), "run"), sizes, n).select("run", "groups").collect())
    told_runs, told_groups = (session.sparkContext.broadcast([x[k] for x in hot]) for k in (0, 1))
    own = map_arrow(within(blocks), lambda it: _known_here(it, told_runs.value), "block long, payload binary")
    rare = keyed(map_arrow(within(blocks).select("block", "runs"), lambda it: _unknown_here(it, told_runs.value), "block long, at int, run string"), n)
    answers = rare.join(aligned(known.join(F.broadcast(often), "run", "left_anti"), sizes, n), _KEY, "left").select("block", "at", "groups")
    linked = shared_table(_returned(own, n, stride, answers, ["at", "groups"], lambda p, t: _linked(p, t, told_groups.value), "block long, payload binary, pairs array<long>, docs array<int>"), "align-links", "zstd")
    drop(blocks, known)
    counts = linked.select(F.explode(F.arrays_zip("pairs", "docs")).alias("x")).groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.docs").alias("n"))
    a_id = F.shiftright("pair", _PAIR_BITS).cast("int")
    scored = shared_table(counts.withColumn("best", F.col("n") == F.max("n").over(Window.partitionBy(a_id))), "align-pairs", "zstd")
    spark = docs.sparkSession
    last, counted = (spark.read.schema(t.schema).parquet(place_of(t)) for t in (linked, scored))
    told = last.select("block", F.posexplode("pairs").alias("at", "pair")).join(counted, "pair").select("block", "at", "n", "best")
    return _returned(last.select("block", "payload"), n, stride, told, ["n", "best"], _scored, _SQL)
