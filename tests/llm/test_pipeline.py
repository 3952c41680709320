"""The corpus pipeline: its contract, and each stage against brute force on its own input."""

import corpus_pipeline
from glossa.llm import decontaminate

from .test_corpus import brute_classes
from .test_scans import brute_contamination


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, bench = docs.columns, spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line dedup", "near dedup", "decontamination", "packing"]
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stage(spark, docs, sf_dir)
        if name == "packing":
            sizes = {r["doc_id"]: r["n"] for r in docs.groupBy("doc_id").agg({"length": "sum"}).withColumnRenamed("sum(length)", "n").collect()}
            assert sizes.keys() == {r["doc_id"] for r in before.select("doc_id").collect()}
            break
        assert docs.columns == columns and docs.schema.simpleString() == before.schema.simpleString()
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        kept = {r["doc_id"]: r for r in docs.collect()}
        given = {r["doc_id"]: r for r in before.collect()}
        assert kept.keys() <= given.keys() and len(kept) > 0.5 * len(given)
        assert all(len(r["text"]) == r["n_chars"] for r in kept.values())
        if name == "near dedup":
            want, _ = brute_classes([(i, r["text"]) for i, r in given.items()])
            assert kept.keys() == set(want.values())
        if name == "decontamination":
            found = brute_contamination([(i, r["text"]) for i, r in given.items()], [(r["item_id"], r["text"]) for r in bench.collect()])
            assert all(kept[i] == given[i] for i, _, _, _, _, hit in found if not hit)
            assert not decontaminate.contaminated_spans(docs, bench).where("size(items) > 0").count()


def test_run(spark, sf_dir):
    assert corpus_pipeline.run(spark, sf_dir).columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]


def test_stages_on_nulls_and_empty_tables(spark, sf_dir):
    schema = spark.read.parquet(f"{sf_dir}/documents.parquet").schema
    odd = [(None, None, None, None, None), (1, None, "en", "s", 0), (2, "", "en", None, 0), (3, "  \n\n ", None, "s", None), (4, "word " * 5000, "en", "s", 25000), (5, "tie a b c d e f", "en", "s", 15), (6, "tie a b c d e f", "en", "s", 15), (None, "tie a b c d e f", "en", "s", 15)]
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, spark.createDataFrame([], schema), sf_dir).count() == 0
        got = stage(spark, spark.createDataFrame(odd, schema), sf_dir).collect()
        ids = [r["doc_id"] for r in got]
        if name == "near dedup":
            # Copies go, with or without id; what has no words stays.
            assert sorted(ids, key=str) == [1, 2, 3, 4, 5, None]
        else:
            assert sorted(set(ids), key=str) == [1, 2, 3, 4, 5, 6, None]
        if name not in ("near dedup", "packing"):
            assert {r["doc_id"]: r["text"] for r in got if r["doc_id"]} == {r[0]: r[1] for r in odd if r[0]}
