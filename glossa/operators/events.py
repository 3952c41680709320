"""Run and trace events, usage and jobs, as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .runs import time_block

__all__ = ["time_block"]

TOKEN_FIELDS = ("prompt", "response", "total", "cached", "thought")
STEPS = [("search", "searching"), ("read", "fetching"), ("rank", "selecting top"), ("screen", "scoring abstracts"), ("analyze", "analyzing"), ("finish", "finalizing")]


def parse_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """kind and payload of PROGRESS:, LOG: and RESULT: lines; other lines go. json is null where the payload is no JSON."""
    kind = F.lower(F.regexp_extract(column, "^(PROGRESS|LOG|RESULT):", 1))
    payload = F.regexp_replace(F.col(column), "^(?:PROGRESS|LOG|RESULT):", "")
    valid = F.when(F.expr("try_parse_json(payload)").isNotNull(), F.col("payload"))
    return lines.withColumns({"kind": kind, "payload": payload}).where("kind <> ''").withColumn("json", valid)


def paper_timings(events: DataFrame, end: DataFrame, run: str = "run_id") -> DataFrame:
    """Seconds from each paper's start to the next start of its run, or to the run's end; the last start of a paper counts.

    events has run, epoch, msg and detail; end has run and end_epoch. A run's own
    events are ordered, never all runs'.
    """
    e = events.where(F.contains("msg", F.lit("Analyzing paper"))).withColumn("pmid", F.regexp_extract("detail", r"PMID\s+(\d+)", 1)).where("pmid <> ''").join(end, run)
    w = Window.partitionBy(run).orderBy("epoch", "pmid")
    e = e.withColumn("seconds", F.greatest(F.lit(0.0), F.coalesce(F.lead("epoch").over(w), F.col("end_epoch")) - F.col("epoch")))
    return e.groupBy(run, "pmid").agg(F.max_by("seconds", "epoch").alias("seconds"))


def error_counts(events: DataFrame, by: list[str], text: str = "payload") -> DataFrame:
    """Events that mention permission, availability and other service errors."""
    has = lambda *words: F.col(text).rlike("|".join(words))
    return events.groupBy(*by).agg(
        F.count_if(has("PERMISSION_DENIED", "RESOURCE_EXHAUSTED", "UNAVAILABLE", "503", r"google\.genai\.errors")).alias("error_count"),
        F.count_if(has("PERMISSION_DENIED")).alias("permission_denied_count"), F.count_if(has("UNAVAILABLE", "503")).alias("unavailable_count"),
    )


def usage_metadata(record: Column | str) -> Column:
    """Five token counts of a JSON usage record with snake or camel field names."""
    r = F.col(record) if isinstance(record, str) else record
    get = lambda *names: F.coalesce(*[F.get_json_object(r, f"$.{n}").try_cast("long") for n in names], F.lit(0).cast("long"))
    return F.struct(
        get("prompt_token_count", "promptTokenCount").alias("prompt"), get("candidates_token_count", "candidatesTokenCount").alias("response"),
        get("total_token_count", "totalTokenCount").alias("total"), get("cached_content_token_count", "cachedContentTokenCount").alias("cached"),
        get("thoughts_token_count", "thoughtsTokenCount").alias("thought"),
    )


def usage_sums(records: DataFrame, by: list[str], record: str = "usage") -> DataFrame:
    u = records.withColumn("_u", usage_metadata(record))
    return u.groupBy(*by).agg(F.count("*").alias("calls"), *[F.sum(F.col(f"_u.{f}")).alias(f"{f}_tokens") for f in TOKEN_FIELDS])


def batch_usage(stats: DataFrame, papers: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Counters of a batch, or where one is 0 or unreadable, the sum over its papers."""
    sums = papers.groupBy(key).agg(*[F.sum(F.coalesce(F.col(f).try_cast("long"), F.lit(0))).alias(f"_{f}") for f in fields])
    own = lambda f: F.nullif(F.coalesce(F.col(f).try_cast("long"), F.lit(0)), F.lit(0))
    return stats.join(sums, key, "left").select(key, *[F.coalesce(own(f), F.col(f"_{f}"), F.lit(0)).cast("long").alias(f) for f in fields])


def running_calls(calls: DataFrame, key: str, order: list[str], most: int, reserved: int = 1) -> DataFrame:
    """Whether an optional call may be made: those before it in its paper and the reserved ones leave room."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = F.count("*").over(w)
    return calls.withColumn("calls_before", before).withColumn("allowed", F.lit(most == 0) | F.when(F.col("optional"), before + reserved < most).otherwise(before < most))


def last_nodes(events: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The latest event of each node."""
    rest = [c for c in events.columns if c not in keys]
    return events.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("e")).select(*keys, "e.*")


def top_counts(events: DataFrame, column: str, most: int = 200) -> DataFrame:
    return events.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column).limit(most)


def call_profile(calls: DataFrame, run: str, order: str, most: int = 5000, noise: tuple[str, ...] = ()) -> DataFrame:
    """Per run and function of a trace: calls, deepest (calls open around it) and returns.

    calls has run, order, event (call or return) and function. Dunder and anonymous
    functions and those of noise are left out, and of the rest a run's first `most`
    events count, as in the trace that they come from.
    """
    shown = calls.where(F.col("event").isin("call", "return") & ~F.col("function").rlike("^(__.*__$|<.*>$)") & ~F.col("function").isin(*noise))
    w = Window.partitionBy(run).orderBy(order)
    # A return closes its call before the next event, so the depth never falls below zero.
    step = F.when(F.col("event") == "call", 1).otherwise(-1)
    e = shown.withColumns({"_nth": F.row_number().over(w), "_sum": F.sum(step).over(w)}).where(F.col("_nth") <= most)
    e = e.withColumn("_depth", F.col("_sum") - F.least(F.min("_sum").over(w), F.lit(0)))
    called = F.col("event") == "call"
    return e.groupBy(run, "function").agg(F.count_if(called).alias("calls"), F.max(F.when(called, F.col("_depth") - 1)).alias("deepest"), F.count_if(~called).alias("returns"))


def applied(jobs: DataFrame, changes: DataFrame, key: str = "job_id", order: str = "seq") -> DataFrame:
    """A job table after a batch of changes (insert, update, delete by id), which may be written in its place.

    changes has the columns of jobs, order and action. A null field of an update
    leaves the job's value; a job that is inserted again after it was deleted has
    nothing of the old one.
    """
    fields = [c for c in jobs.columns if c != key]
    old = jobs.select(key, *fields, F.lit(-1).cast("long").alias(order), F.lit("insert").alias("action"))
    log = old.unionByName(changes.select(key, *fields, F.col(order).cast("long").alias(order), "action"))
    gone = log.groupBy(key).agg(F.max(F.when(F.col("action") == "delete", F.col(order))).alias("_gone"))
    left = log.join(gone, key).where(F.col("_gone").isNull() | (F.col(order) > F.col("_gone"))).drop("_gone")
    # What follows a delete must begin with an insert: an update of no job changes nothing.
    begun = left.groupBy(key).agg(F.min(F.when(F.col("action") == "insert", F.col(order))).alias("_begun"))
    left = left.join(begun, key).where(F.col(order) >= F.col("_begun"))
    return left.groupBy(key).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in fields])


def progress_deltas(events: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Positive increments of a cumulative counter."""
    w = Window.partitionBy(key).orderBy(order)
    return events.withColumn("delta", F.greatest(F.lit(0), F.col(value) - F.lag(value, 1, 0).over(w)))


def last_n(events: DataFrame, key: str, order: list[str], n: int) -> DataFrame:
    """The last n events of each key."""
    w = Window.partitionBy(key).orderBy(*[F.desc(o) for o in order])
    return events.withColumn("_nth", F.row_number().over(w)).where(F.col("_nth") <= n).drop("_nth")


def shown_levels(logs: DataFrame, levels: tuple[str, ...] = ("info", "warn", "error")) -> DataFrame:
    return logs.where(F.col("level").isin(*levels))


def step_status(stages: DataFrame, column: str = "stage") -> DataFrame:
    """For each stage message the status of every step: done before the matching one, active at it, pending behind it."""
    low = F.lower(F.col(column))
    at = F.lit(-1)
    for k, (_, word) in reversed(list(enumerate(STEPS))):
        at = F.when(F.contains(low, F.lit(word)), k).otherwise(at)
    s = stages.withColumn("_at", at)
    return s.select("*", F.posexplode(F.array(*[F.lit(n) for n, _ in STEPS])).alias("step_no", "step")).withColumn("status", F.when(F.col("step_no") < F.col("_at"), "done").when(F.col("step_no") == F.col("_at"), "active").otherwise("pending")).drop("_at")


def latest_jobs(job_events: DataFrame, key: str = "job_id", order: str = "seq") -> DataFrame:
    """Each job's last known value of every field, deleted jobs left out: insert, update and delete as an append-only log."""
    fields = [c for c in job_events.columns if c not in (key, order, "action")]
    last = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in fields]
    return job_events.groupBy(key).agg(F.max_by("action", order).alias("action"), *last).where("action <> 'delete'").drop("action")


def job_status(events: DataFrame, key: str = "job_id", order: str = "seq") -> DataFrame:
    """queued, running, completed, failed or cancelled: a cancellation stays, then a result, then the exit code, then progress."""
    w = events.groupBy(key).agg(F.bool_or(F.col("kind") == "cancel").alias("c"), F.max_by("ok", F.when(F.col("kind") == "result", F.col(order))).alias("r"), F.max_by("code", F.when(F.col("kind") == "exit", F.col(order))).alias("x"), F.bool_or(F.col("kind").isin("progress", "log")).alias("p"))
    return w.select(key, F.when(F.col("c"), "cancelled").when(F.col("r").isNotNull(), F.when(F.col("r"), "completed").otherwise("failed")).when(F.col("x").isNotNull(), F.when(F.col("x") == 0, "completed").otherwise("failed")).when(F.col("p"), "running").otherwise("queued").alias("status"))


def usage_by_day(calls: DataFrame, ts: str, count: str) -> DataFrame:
    return calls.groupBy(F.to_date(ts).alias("day")).agg(F.sum(count).alias("calls"))


def error_class(error: Column | str) -> Column:
    e = F.coalesce(F.col(error) if isinstance(error, str) else error, F.lit(""))
    return F.when(e.rlike("(?i)429|RESOURCE_EXHAUSTED|rate limit|quota"), "rate_limit").when(e.rlike("(?i)50[0-4]|UNAVAILABLE|timeout|timed out|connection"), "transient").when(e != "", "permanent").otherwise("none")


def retry_delay(error: Column | str, attempt: Column | str, base: float = 2.0, longest: float = 60.0) -> Column:
    """The delay that an error names, else one that doubles with each attempt."""
    e, n = (F.col(x) if isinstance(x, str) else x for x in (error, attempt))
    named = F.regexp_extract(F.coalesce(e, F.lit("")), r"(?i)retry\s*(?:delay|in|after)[\"':\s]*(\d+(?:\.\d+)?)\s*s?", 1).try_cast("double")
    return F.coalesce(named, F.least(F.pow(F.lit(base), n), F.lit(longest)))
