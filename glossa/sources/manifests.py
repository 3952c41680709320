"""Run manifests of any shape: each file is one VARIANT value, and fields are taken from it under the names and types that they have had.

No schema is inferred, so manifests are read once, and fields that are missing, renamed or retyped in some of
them cost nothing: a field is the first of its paths that holds a value which can be read as its type.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Paths of each field, the current name first, then names of earlier versions (fixed values).
PATHS = {
    "run_id": ("$.run_id", "$.run", "$.id"),
    "started": ("$.started_at", "$.start", "$.schedule.started_at"),
    "fingerprint": ("$.corpus_fingerprint", "$.fingerprint", "$.corpus.fingerprint"),
    "pilot": ("$.pilot", "$.is_pilot"),
    "runtime_seconds": ("$.runtime_seconds", "$.runtime", "$.duration_seconds"),
    "return_code": ("$.return_code", "$.returnCode", "$.exit_code"),
}
#: Counters and their earlier names, below each of the objects that have held them.
OBJECTS = ("$.batch", "$.stats", "$")
COUNTERS = {
    "completed_papers": ("completed_papers", "completed"),
    "total_papers": ("total_papers", "total"),
    "failed_papers": ("failed_papers", "failed"),
    "quota_limited_papers": ("quota_limited_papers",),
    "quota_limited_rows": ("quota_limited_rows",),
    "timeout_count": ("timeout_count", "timeouts"),
    "gemini_api_calls": ("gemini_api_calls", "api_calls"),
    "gemini_total_tokens": ("gemini_total_tokens", "total_tokens"),
    "gemini_error_count": ("gemini_error_count", "api_errors"),
    "model_unavailable_count": ("model_unavailable_count",),
    "permission_denied_count": ("permission_denied_count",),
    "output_rows": ("output_rows", "rows"),
}


def read_variants(spark: SparkSession, path: str, names: str = "*.json") -> DataFrame:
    """One row a file: m (VARIANT) and the file's place. A file that is no JSON has a null m."""
    raw = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter=names)
    return raw.select(F.try_parse_json("value").alias("m"), F.col("_metadata.file_path").alias("manifest_path"))


def field(paths: tuple[str, ...], kind: str, m: Column | str = "m") -> Column:
    """The first path of a VARIANT that holds a value which is, or can be read as, a type."""
    v = F.col(m) if isinstance(m, str) else m
    return F.coalesce(*[F.coalesce(F.try_variant_get(v, p, kind), F.try_variant_get(v, p, "string").try_cast(kind)) for p in paths])


def manifests(variants: DataFrame, fingerprint: str | None = None, pilots: bool = False) -> DataFrame:
    """run_id, started, runtime_seconds, return_code, batch and per_paper of manifests, as batch_rows() takes them; pilots and other corpora are left out, and so is what names no run."""
    kinds = {"run_id": "string", "started": "timestamp", "fingerprint": "string", "pilot": "boolean", "runtime_seconds": "double", "return_code": "int"}
    counters = F.struct(*[field(tuple(f"{o}.{n}" for o in OBJECTS for n in names), "long").alias(c) for c, names in COUNTERS.items()])
    papers = F.coalesce(*[F.try_variant_get("m", p, "array<struct<pmid string, status string>>") for p in ("$.per_paper", "$.papers")])
    d = variants.select("manifest_path", *[field(PATHS[c], k).alias(c) for c, k in kinds.items()], counters.alias("batch"), papers.alias("per_paper")).where("run_id IS NOT NULL")
    if not pilots:
        d = d.where(~F.coalesce("pilot", F.lit(False)))
    if fingerprint is not None:
        d = d.where(F.col("fingerprint") == fingerprint)
    return d.drop("pilot", "fingerprint")


def shape(variants: DataFrame) -> DataFrame:
    """One row: the schema that holds all manifests, and how many are no JSON."""
    return variants.agg(F.schema_of_variant_agg("m").alias("schema"), F.count_if(F.col("m").isNull()).alias("unreadable"))
