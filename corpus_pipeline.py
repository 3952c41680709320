"""Corpus pipeline: the documents of a folder, filtered, deduplicated, decontaminated and packed into sequences.

A text that a stage changes gets its number of characters anew.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossa.llm import decontaminate, linededup, neardup, packing, toxicity
from glossa.llm.common import shared_table
from glossa.llm.queries import tokenizer_path


def _counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity models reject go. Null and empty texts stay, and so does everything where labels of both classes are missing."""
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of three-line windows go, and texts of which nothing stays. Null and empty texts, and texts of fewer than three lines, stay as they are."""
    return _counted(linededup.without_repeated_lines(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near duplicates stays, that of the smallest id, repeated rows included. Texts without words stay; a row without id goes if its class has one with an id."""
    return neardup.without_near_duplicates(docs)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages go, and documents that they mostly make up. Null and empty texts stay; with an empty benchmark all do."""
    return _counted(decontaminate.remove_spans(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces in sequences of fixed length. Null and empty texts are their end id; longer ones are cut; rows without id are packed too."""
    return packing.best_fit_pack(docs, tokenizer_path("word_bpe_49k.json"), end=0)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", dedup_lines),
    ("near dedup", drop_near_duplicates),
    ("decontamination", remove_benchmark),
    ("packing", pack),
]

#: Sampling, tokenisation and packing are beyond SQL; tests compare each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder; what each returns is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = shared_table(docs, f"stage-{name.replace(' ', '-')}")
    return docs
