"""Queries on run events: statistics, stability, schedules, logs, jobs and streams."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import events, quantiles, reports, results_view, runs
from .registry import Registry
from .sources import records
from .streaming import events as streams
from .tables import base, shared_folder

R = Registry()

# One batch an hour: counters from event types, runtime from values.
_BATCH = """, hourly AS (SELECT date_trunc('hour', ts) AS started, 'run' || CAST(date_trunc('hour', ts) AS STRING) AS run_id, CAST(count(*) AS BIGINT) AS total_papers, CAST(sum(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END) AS BIGINT) AS completed_papers,
  CAST(sum(CASE WHEN event_type = 'error' AND user_id % 3 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS failed_papers, CAST(0 AS BIGINT) AS quota_limited_papers, CAST(sum(CASE WHEN event_type = 'error' AND user_id % 11 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS quota_limited_rows,
  CAST(sum(CASE WHEN event_type = 'error' AND user_id % 7 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS timeout_count, CAST(sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) AS BIGINT) AS gemini_api_calls, CAST(sum(user_id) AS BIGINT) AS gemini_total_tokens,
  CAST(sum(CASE WHEN event_type = 'error' AND user_id % 2 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS gemini_error_count, CAST(0 AS BIGINT) AS model_unavailable_count, CAST(0 AS BIGINT) AS permission_denied_count, CAST(sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS BIGINT) AS output_rows,
  CAST(0 AS BIGINT) AS return_code, CAST(count(*) * 60 + max(user_id) % 100 AS DOUBLE) AS runtime_seconds FROM events GROUP BY 1, 2)"""
_BLOCK = "CASE WHEN hour(started) < 6 THEN 'night' WHEN hour(started) < 12 THEN 'morning' WHEN hour(started) < 18 THEN 'afternoon' ELSE 'evening' END"
_CLASSES = ("WITH " + _BATCH.removeprefix(", ") + f""", b AS (SELECT *, {_BLOCK} AS time_block, completed_papers / greatest(total_papers, 1) AS completion_rate, total_papers > 0 AND completed_papers = total_papers AS successful FROM hourly),
c AS (SELECT *, CASE WHEN successful AND quota_limited_rows > 0 THEN 'complete_with_quota_limit' WHEN successful AND timeout_count > 0 THEN 'complete_with_timeout' WHEN successful AND gemini_error_count > 0 THEN 'complete_recovered_gemini_errors' WHEN successful THEN 'complete_clean'
  WHEN quota_limited_rows > 0 THEN 'quota_limited' WHEN timeout_count > 0 THEN 'timeout' WHEN gemini_error_count > 0 THEN 'gemini_api_failure' WHEN gemini_api_calls = 0 AND output_rows = 0 THEN 'upstream_metadata_or_fulltext_failure' ELSE 'partial_or_unclassified_failure' END AS failure_class FROM b) """)


def _batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    hourly = spark.sql("WITH " + _BATCH.removeprefix(", ").replace("FROM events", "FROM {events}") + " SELECT * FROM hourly", events=base(spark, sf_dir, "events"))
    return runs.classified(hourly.withColumn("time_block", runs.time_block("started")))


@R.query(_CLASSES + "SELECT run_id, time_block, round(completion_rate, 6) AS completion_rate, successful, failure_class FROM c")
def batch_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches with completion and failure class."""
    return _batches(spark, sf_dir).select("run_id", "time_block", F.round("completion_rate", 6).alias("completion_rate"), "successful", "failure_class")


_GOOD = lambda c: f"coalesce(median(CAST({c} AS DOUBLE)) FILTER (successful), median(CAST({c} AS DOUBLE)), 0)"
_BLOCKS = f"""SELECT time_block, CAST(count(*) AS BIGINT) AS runs, CAST(count(*) FILTER (successful) AS BIGINT) AS successful_runs, {_GOOD('runtime_seconds')} AS median_runtime_seconds, round(median(completion_rate), 6) AS median_completion_rate,
  CAST(count(*) FILTER (quota_limited_rows > 0) AS BIGINT) AS quota_limited_runs, CAST(count(*) FILTER (timeout_count > 0) AS BIGINT) AS timeout_runs, {_GOOD('output_rows')} AS median_output_rows, {_GOOD('gemini_api_calls')} AS median_api_calls FROM c GROUP BY time_block"""


@R.query(_CLASSES + _BLOCKS)
def block_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Medians by time block."""
    b = runs.block_summary(_batches(spark, sf_dir))
    return b.select("time_block", "runs", "successful_runs", "median_runtime_seconds", F.round("median_completion_rate", 6).alias("median_completion_rate"), "quota_limited_runs", "timeout_runs", "median_output_rows", "median_api_calls")


@R.query(_CLASSES + f""", k AS ({_BLOCKS}), s AS (SELECT count(*) AS n, median(completion_rate) AS completion, median(runtime_seconds) AS runtime, count(*) FILTER (quota_limited_rows > 0 OR timeout_count > 0) AS limited, count(*) FILTER (failed_papers > 0) AS failed FROM c),
t AS (SELECT count(*) AS blocks, max(median_runtime_seconds) / min(median_runtime_seconds) AS ratio FROM k WHERE median_runtime_seconds > 0)
SELECT CASE WHEN n = 0 THEN 'no_data' WHEN completion < 0.7 THEN 'not_usable' WHEN limited > 0 THEN CASE WHEN completion < 0.9 THEN 'not_usable' ELSE 'marginal' END WHEN blocks < 4 THEN 'insufficient_data'
  WHEN completion >= 0.9 AND runtime <= 5400 AND ratio <= 2 AND failed = 0 THEN 'usable' ELSE 'marginal' END AS verdict, CAST(n AS BIGINT) AS n, round(completion, 6) AS completion, round(runtime, 6) AS runtime, round(ratio, 6) AS ratio FROM s, t""")
def verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How usable the service was."""
    b = _batches(spark, sf_dir)
    v = runs.verdict(b, runs.block_summary(b))
    return v.select("verdict", "n", *[F.round(c, 6).alias(c) for c in ("completion", "runtime", "ratio")])


_METRICS = {"batch_runtime_seconds": "runtime_seconds", "batch_api_calls": "gemini_api_calls", "batch_total_tokens": "gemini_total_tokens", "batch_output_rows": "output_rows"}
_STACK = " UNION ALL ".join(f"SELECT '{m}' AS metric, CAST({c} AS DOUBLE) AS value FROM c" for m, c in _METRICS.items())


@R.query(_CLASSES + f""", l AS ({_STACK}) SELECT metric, CAST(count(value) AS BIGINT) AS count, round(avg(value), 6) AS mean, median(value) AS median, round(coalesce(stddev_samp(value), 0), 6) AS sd, min(value) AS min, max(value) AS max, quantile_disc(value, 0.95) AS p95 FROM l GROUP BY metric""")
def descriptive_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Descriptive statistics of stacked metrics."""
    d = runs.describe(runs.metric_stack(_batches(spark, sf_dir), _METRICS), ["metric"])
    return d.select("metric", "count", F.round("mean", 6).alias("mean"), "median", F.round("sd", 6).alias("sd"), "min", "max", "p95")


@R.query("SELECT l_returnflag, l_linestatus, round(quantile_cont(l_extendedprice, 0.25), 4) AS q25, round(quantile_cont(l_extendedprice, 0.5), 4) AS q50, round(quantile_cont(l_extendedprice, 0.95), 4) AS q95 FROM lineitem GROUP BY 1, 2")
def linear_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interpolated quantiles."""
    q = {f"q{round(x * 100)}": x for x in (0.25, 0.5, 0.95)}
    return base(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(*[F.round(runs.linear_quantile("l_extendedprice", x), 4).alias(n) for n, x in q.items()])


_OBSERVED = """, o AS (SELECT CAST(user_id % 40 AS STRING) AS pmid, CAST(date_trunc('day', ts) AS STRING) AS run_id, list(DISTINCT event_type) AS genes, list(DISTINCT event_type || '|' || CAST(user_id % 3 AS STRING)) AS gv, count(*) AS n, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS d FROM events GROUP BY 1, 2)"""


@R.query("WITH " + _OBSERVED.removeprefix(", ") + """, s AS (SELECT pmid, count(*) AS runs, avg(n) AS mean_rows, coalesce(stddev_samp(n), 0) AS sd_rows, min(n) AS min_rows, max(n) AS max_rows, avg(d) AS mean_strict_drops, avg(d / (n + d)) AS mean_drop_rate FROM o GROUP BY pmid),
j AS (SELECT a.pmid, avg(len(list_intersect(a.genes, b.genes)) / len(list_distinct(a.genes || b.genes))) AS g, avg(len(list_intersect(a.gv, b.gv)) / len(list_distinct(a.gv || b.gv))) AS v FROM o a JOIN o b ON a.pmid = b.pmid AND a.run_id < b.run_id GROUP BY a.pmid)
SELECT s.pmid, CAST(runs AS BIGINT) AS runs, round(mean_rows, 6) AS mean_rows, round(sd_rows, 6) AS sd_rows, CAST(min_rows AS DOUBLE) AS min_rows, CAST(max_rows AS DOUBLE) AS max_rows, round(mean_strict_drops, 6) AS mean_strict_drops, round(mean_drop_rate, 6) AS mean_drop_rate, round(g, 6) AS gene_jaccard, round(v, 6) AS gene_variant_jaccard FROM s LEFT JOIN j ON s.pmid = j.pmid""")
def output_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stability of outputs over runs."""
    e = base(spark, sf_dir, "events").select((F.col("user_id") % 40).cast("string").alias("PMID"), F.date_trunc("day", "ts").cast("string").alias("run_id"), F.col("event_type").alias("Gene"), (F.col("user_id") % 3).cast("string").alias("Variant"))
    reported = e.groupBy("run_id", F.col("PMID").alias("pmid")).agg(F.lit(0).alias("emitted_rows"), F.count_if(F.col("Gene") == "error").alias("strict_gate_drops"), F.lit(0).alias("citation_gate_drops"))
    s = runs.stability(records.output_observations(e), reported)
    return s.select("pmid", "runs", "min_rows", "max_rows", *[F.round(c, 6).alias(c) for c in ("mean_rows", "sd_rows", "mean_strict_drops", "mean_drop_rate", "gene_jaccard", "gene_variant_jaccard")])


@R.query("""WITH e AS (SELECT user_id % 20 AS run_id, epoch(ts) AS epoch, CAST(event_id % 13 AS STRING) AS pmid FROM events WHERE event_type = 'view'), f AS (SELECT run_id, max(epoch(ts)) AS end_epoch FROM (SELECT user_id % 20 AS run_id, ts FROM events) GROUP BY run_id),
t AS (SELECT e.run_id, pmid, epoch, greatest(0.0, coalesce(lead(epoch) OVER (PARTITION BY e.run_id ORDER BY epoch, pmid), end_epoch) - epoch) AS seconds FROM e JOIN f ON e.run_id = f.run_id)
SELECT run_id, pmid, round(max_by(seconds, epoch), 3) AS seconds FROM t GROUP BY run_id, pmid""")
def paper_timings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seconds from each paper's start to the next one."""
    e = base(spark, sf_dir, "events").withColumns({"run_id": F.col("user_id") % 20, "epoch": F.unix_micros(F.col("ts").cast("timestamp")) / 1e6})
    end = e.groupBy("run_id").agg(F.max("epoch").alias("end_epoch"))
    logs = e.where("event_type = 'view'").select("run_id", "epoch", F.lit("Analyzing paper").alias("msg"), F.concat(F.lit("PMID "), (F.col("event_id") % 13).cast("string")).alias("detail"))
    return events.paper_timings(logs, end).select("run_id", "pmid", F.round("seconds", 3).alias("seconds"))


@R.query("""SELECT CASE WHEN hour(ts) < 6 THEN 'night' WHEN hour(ts) < 12 THEN 'morning' WHEN hour(ts) < 18 THEN 'afternoon' ELSE 'evening' END AS time_block, CAST(ts - INTERVAL 9 HOUR AS DATE) AS quota_window, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1, 2""")
def quota_window_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Time blocks and quota windows."""
    e = base(spark, sf_dir, "events")
    return e.groupBy(runs.time_block("ts").alias("time_block"), runs.quota_window("ts").alias("quota_window")).agg(F.count("*").alias("n"))


@R.query("""WITH b AS (SELECT min(ts) AS t FROM events), s AS (SELECT unnest(generate_series(CASE WHEN date_trunc('hour', t) = t THEN date_trunc('hour', t) ELSE date_trunc('hour', t) + INTERVAL 1 HOUR END, CASE WHEN date_trunc('hour', t) = t THEN date_trunc('hour', t) ELSE date_trunc('hour', t) + INTERVAL 1 HOUR END + INTERVAL 23 HOUR, INTERVAL 1 HOUR)) AS p FROM b)
SELECT 'hour' || strftime(p, '%H') AS run_id, CASE WHEN hour(p) < 6 THEN 'night' WHEN hour(p) < 12 THEN 'morning' WHEN hour(p) < 18 THEN 'afternoon' ELSE 'evening' END AS time_block, strftime(p, '%H:%M') AS planned_local_time, CAST(p AS DATE) AS planned_date, CAST(p - INTERVAL 9 HOUR AS DATE) AS quota_window FROM s""")
def hourly_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A day of hourly slots."""
    bounds = base(spark, sf_dir, "events").agg(F.min("ts").alias("start_at"), F.lit(24).alias("hours"))
    return runs.schedule(bounds).select("run_id", "time_block", "planned_local_time", "planned_date", "quota_window")


@R.query()
def call_headroom(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which slots of each session run within the quota."""
    e = base(spark, sf_dir, "events").groupBy((F.col("user_id") % 10).alias("session"), F.date_trunc("hour", "ts").alias("slot")).agg(F.count("*").alias("calls"))
    return runs.headroom(e.withColumn("quota_window", runs.quota_window("slot").cast("string")), ["session"], most=30, estimate=2)


@R.query("""WITH s AS (SELECT user_id, event_id, event_type = 'error' AS failed, sum(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY event_id) AS island FROM events)
SELECT user_id, event_id, CAST(sum(failed::INT) OVER (PARTITION BY user_id, island ORDER BY event_id) AS BIGINT) AS streak FROM s""")
def failure_streaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consecutive failures."""
    e = base(spark, sf_dir, "events").select("user_id", "event_id", (F.col("event_type") == "error").alias("failed"))
    return runs.failure_streaks(e, "user_id", "event_id", "failed").select("user_id", "event_id", "streak")


@R.query("""SELECT n_regionkey, sha256(string_agg(CAST(n_nationkey AS STRING), chr(10) ORDER BY n_nationkey)) AS fingerprint, CAST(count(*) AS BIGINT) AS n FROM nation GROUP BY n_regionkey""")
def corpus_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of ordered id lists."""
    return runs.fingerprint(base(spark, sf_dir, "nation"), ["n_regionkey"], "n_nationkey", "n_nationkey")


@R.query("""SELECT event_type, CAST(count(*) FILTER (regexp_matches(p, 'PERMISSION_DENIED|RESOURCE_EXHAUSTED|UNAVAILABLE|503')) AS BIGINT) AS error_count, CAST(count(*) FILTER (contains(p, 'PERMISSION_DENIED')) AS BIGINT) AS permission_denied_count, CAST(count(*) FILTER (regexp_matches(p, 'UNAVAILABLE|503')) AS BIGINT) AS unavailable_count
FROM (SELECT event_type, CASE event_id % 4 WHEN 0 THEN 'PERMISSION_DENIED' WHEN 1 THEN 'code 503' ELSE props END AS p FROM events) GROUP BY event_type""")
def event_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Service errors in event payloads."""
    m = F.col("event_id") % 4
    e = base(spark, sf_dir, "events").withColumn("payload", F.when(m == 0, "PERMISSION_DENIED").when(m == 1, "code 503").otherwise(F.col("props")))
    return events.error_counts(e, ["event_type"])


@R.query("""SELECT user_id, CAST(count(*) AS BIGINT) AS calls, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS prompt_tokens, CAST(sum(event_id % 5) AS BIGINT) AS total_tokens FROM events GROUP BY user_id""")
def usage_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token sums over usage records with snake or camel names."""
    record = F.concat(F.lit('{"'), F.when(F.col("event_id") % 2 == 0, "prompt_token_count").otherwise("promptTokenCount"), F.lit('": "'), F.get_json_object("props", "$.k"), F.lit('", "totalTokenCount": '), (F.col("event_id") % 5).cast("string"), F.lit("}"))
    return events.usage_sums(base(spark, sf_dir, "events").withColumn("usage", record), ["user_id"]).select("user_id", "calls", "prompt_tokens", "total_tokens")


@R.query("""SELECT user_id, event_type, max_by(event_id, struct_pack(t := ts, i := event_id)) AS event_id, max_by(value, struct_pack(t := ts, i := event_id)) AS value FROM events GROUP BY 1, 2""")
def last_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest event of each node."""
    e = base(spark, sf_dir, "events").withColumn("at", F.struct("ts", "event_id"))
    return events.last_nodes(e.select("user_id", "event_type", "event_id", "value", "at"), ["user_id", "event_type"], "at").select("user_id", "event_type", "event_id", "value")


@R.query("SELECT event_type, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY event_type ORDER BY n DESC, event_type LIMIT 200")
def trace_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by name, at most two hundred."""
    return events.top_counts(base(spark, sf_dir, "events"), "event_type")


@R.query("SELECT user_id, event_id, greatest(0, event_id % 9 - coalesce(lag(event_id % 9) OVER (PARTITION BY user_id ORDER BY event_id), 0)) AS delta FROM events")
def progress_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positive increments of a counter."""
    e = base(spark, sf_dir, "events").withColumn("v", F.col("event_id") % 9)
    return events.progress_deltas(e, "user_id", "event_id", "v").select("user_id", "event_id", "delta")


@R.query("SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n <= 5")
def rolling_buffer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last five events of each key."""
    return events.last_n(base(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], 5).select("user_id", "event_id")


@R.query("""WITH s AS (SELECT event_id, event_id % 4 AS a FROM events) SELECT event_id, step, CASE WHEN a = 3 THEN 'pending' WHEN k < CASE a WHEN 0 THEN 1 WHEN 1 THEN 4 ELSE 5 END THEN 'done' WHEN k = CASE a WHEN 0 THEN 1 WHEN 1 THEN 4 ELSE 5 END THEN 'active' ELSE 'pending' END AS status
FROM s, (VALUES (0, 'search'), (1, 'read'), (2, 'rank'), (3, 'screen'), (4, 'analyze'), (5, 'finish')) AS t(k, step)""")
def step_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status of each step for a stage message."""
    m = F.col("event_id") % 4
    e = base(spark, sf_dir, "events").select("event_id", F.when(m == 0, "Fetching full text").when(m == 1, "Analyzing paper").when(m == 2, "Finalizing results").otherwise("Waiting").alias("stage"))
    return events.step_status(e).select("event_id", "step", "status")


_JOBS = "SELECT user_id AS job_id, event_id AS seq, CASE event_type WHEN 'click' THEN 'progress' WHEN 'view' THEN 'log' WHEN 'purchase' THEN 'result' WHEN 'error' THEN 'exit' ELSE 'other' END AS kind, event_id % 3 <> 0 AS ok, CAST(event_id % 2 AS INT) AS code FROM events WHERE event_id % 5 = 0"


@R.query(f"""WITH j AS ({_JOBS}), a AS (SELECT job_id, max_by(ok, seq) FILTER (kind = 'result') AS r, max_by(code, seq) FILTER (kind = 'exit') AS x, bool_or(kind IN ('progress', 'log')) AS p FROM j GROUP BY job_id)
SELECT job_id, CASE WHEN r IS NOT NULL THEN CASE WHEN r THEN 'completed' ELSE 'failed' END WHEN x IS NOT NULL THEN CASE WHEN x = 0 THEN 'completed' ELSE 'failed' END WHEN p THEN 'running' ELSE 'queued' END AS status FROM a""")
def job_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status of each job."""
    return events.job_status(spark.sql(_JOBS.replace("FROM events", "FROM {events}"), events=base(spark, sf_dir, "events")))


@R.query("""WITH e AS (SELECT user_id AS job_id, event_id AS seq, event_type AS status, CASE WHEN event_id % 3 = 0 THEN value END AS stats, CASE WHEN event_id % 10 = 0 THEN 'delete' ELSE 'update' END AS action FROM events)
SELECT job_id, max_by(status, seq) AS status, round(max_by(stats, seq) FILTER (stats IS NOT NULL), 6) AS stats FROM e GROUP BY job_id HAVING max_by(action, seq) <> 'delete'""")
def latest_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Insert, update and delete as an append-only log."""
    e = base(spark, sf_dir, "events").select(F.col("user_id").alias("job_id"), F.col("event_id").alias("seq"), F.col("event_type").alias("status"), F.when(F.col("event_id") % 3 == 0, F.col("value")).alias("stats"), F.when(F.col("event_id") % 10 == 0, "delete").otherwise("update").alias("action"))
    return events.latest_jobs(e).select("job_id", "status", F.round("stats", 6).alias("stats"))


@R.query("""SELECT o_orderkey, o_orderstatus FROM orders WHERE contains(lower(o_orderpriority), 'urgent') OR contains(lower(o_orderstatus), 'urgent')""")
def job_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs by a text in query or status."""
    o = base(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderpriority").alias("query"), F.col("o_orderstatus").alias("status"))
    return results_view.jobs_matching(o, "URGENT").select("o_orderkey", F.col("status").alias("o_orderstatus"))


@R.query("SELECT CAST(ts AS DATE) AS day, CAST(sum(user_id % 7) AS BIGINT) AS calls FROM events GROUP BY 1")
def usage_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls of each day."""
    return events.usage_by_day(base(spark, sf_dir, "events").withColumn("c", F.col("user_id") % 7), "ts", "c")


@R.query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'progress' WHEN 1 THEN 'log' ELSE 'result' END AS kind, event_id % 4 <> 2 AS is_json FROM events WHERE event_id % 4 <> 3""")
def protocol_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The line protocol."""
    m, body = F.col("event_id") % 4, F.col("props")
    lines = base(spark, sf_dir, "events").select("event_id", F.when(m == 0, F.concat(F.lit("PROGRESS:"), body)).when(m == 1, F.concat(F.lit("LOG:"), body)).when(m == 2, F.lit("RESULT:{broken")).otherwise(F.lit("noise")).alias("value"))
    return events.parse_lines(lines).select("event_id", "kind", F.col("json").isNotNull().alias("is_json"))


@R.query("""SELECT date_trunc('hour', ts) AS start, event_type, CAST(count(*) AS BIGINT) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2""")
def streamed_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly windows by a stream that runs over the table once, in complete mode."""
    where = shared_folder(spark, "windows")
    e = base(spark, sf_dir, "events")
    source = streams.read_table(spark, f"{sf_dir}/events.parquet" if _is_folder(spark, f"{sf_dir}/events.parquet") else sf_dir, e.schema, pathGlobFilter="*.parquet" if _is_folder(spark, f"{sf_dir}/events.parquet") else "events.parquet")
    collected = where + "/out"
    q = streams.windowed(source).writeStream.outputMode("complete").foreachBatch(lambda b, n: b.write.mode("overwrite").parquet(collected)).option("checkpointLocation", where + "/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(collected).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


def _is_folder(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


@R.query("""WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) AS came, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts), event_id) AS n FROM events),
s AS (SELECT user_id, event_id, n, came AS started FROM e WHERE n = 1 UNION ALL SELECT e.user_id, e.event_id, e.n, greatest(e.came, s.started + 3600000000) FROM s JOIN e ON e.user_id = s.user_id AND e.n = s.n + 1)
SELECT event_id, started FROM s""")
def requests_paced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When requests are sent, an hour or more apart for each user."""
    e = base(spark, sf_dir, "events").select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    return runs.paced(e, "user_id", ["at", "event_id"], "at", 3_600_000_000).select("event_id", "started")


@R.query("""WITH a AS (SELECT event_id, user_id, CAST(ts AS DATE) AS day, epoch_us(ts) / 1e6 AS started, value * 40 AS seconds FROM events)
SELECT event_id, CASE WHEN EXISTS (SELECT 1 FROM f WHERE f.user_id = a.user_id AND f.day = a.day AND a.started < f.rebuilt AND a.started + least(a.seconds, 600) > f.rebuilt) THEN 'resubmitted' WHEN seconds > 600 THEN 'timed_out' ELSE 'done' END AS outcome FROM a""".replace(
    "\nSELECT event_id", ", f AS (SELECT DISTINCT ON (user_id, day) user_id, day, started + 600 AS rebuilt FROM a WHERE seconds > 600 ORDER BY user_id, day, started)\nSELECT event_id", 1))
def attempts_judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attempts that end, time out, or are submitted again because another timed out."""
    a = base(spark, sf_dir, "events").select("event_id", "user_id", F.to_date("ts").alias("day"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("started"), (F.col("value") * 40).alias("seconds"))
    return runs.attempt_outcomes(a, ["user_id", "day"], "started", "seconds", 600.0).select("event_id", "outcome")


@R.query("""WITH e AS (SELECT user_id AS run_id, event_id, CASE WHEN event_id % 5 < 3 THEN 'call' ELSE 'return' END AS event, CASE event_type WHEN 'error' THEN '__init__' WHEN 'view' THEN '<lambda>' ELSE event_type END AS function FROM events),
k AS (SELECT *, row_number() OVER w AS nth, sum(CASE WHEN event = 'call' THEN 1 ELSE -1 END) OVER w AS level FROM e WHERE function NOT LIKE '\\_\\_%' ESCAPE '\\' AND function NOT LIKE '<%' WINDOW w AS (PARTITION BY run_id ORDER BY event_id)),
d AS (SELECT run_id, event, function, level - least(0, min(level) OVER (PARTITION BY run_id ORDER BY nth)) AS depth FROM k WHERE nth <= 5000)
SELECT run_id, function, CAST(count(*) FILTER (event = 'call') AS BIGINT) AS calls, CAST(max(depth - 1) FILTER (event = 'call') AS BIGINT) AS deepest, CAST(count(*) FILTER (event = 'return') AS BIGINT) AS returns FROM d GROUP BY run_id, function""")
def calls_profiled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls of each function by run, how deep they stand, the first 5,000 events of a run."""
    m = F.col("event_type")
    e = base(spark, sf_dir, "events").select(F.col("user_id").alias("run_id"), "event_id", F.when(F.col("event_id") % 5 < 3, "call").otherwise("return").alias("event"), F.when(m == "error", "__init__").when(m == "view", "<lambda>").otherwise(m).alias("function"))
    return events.call_profile(e, "run_id", "event_id")


@R.query("""WITH e AS (SELECT user_id AS job_id, event_id AS seq, event_type AS status, CASE WHEN event_id % 3 = 0 THEN value END AS stats, CASE WHEN event_id % 10 = 0 THEN 'delete' WHEN event_id % 7 = 0 THEN 'insert' ELSE 'update' END AS action FROM events),
j AS (SELECT DISTINCT ON (job_id) job_id, status, stats FROM e WHERE job_id % 2 = 0 ORDER BY job_id, seq), l AS (SELECT job_id, -1 AS seq, status, stats, 'insert' AS action FROM j UNION ALL SELECT * FROM e),
k AS (SELECT *, coalesce(max(CASE WHEN action = 'delete' THEN seq END) OVER (PARTITION BY job_id), -2) AS gone FROM l), m AS (SELECT *, min(CASE WHEN action = 'insert' THEN seq END) OVER (PARTITION BY job_id) AS begun FROM k WHERE seq > gone)
SELECT job_id, max_by(status, seq) AS status, round(max_by(stats, seq) FILTER (stats IS NOT NULL), 6) AS stats FROM m WHERE seq >= begun GROUP BY job_id""")
def jobs_applied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A job table after inserts, updates and deletes by id."""
    n = F.col("event_id")
    e = base(spark, sf_dir, "events").select(F.col("user_id").alias("job_id"), n.alias("seq"), F.col("event_type").alias("status"), F.when(n % 3 == 0, F.col("value")).alias("stats"), F.when(n % 10 == 0, "delete").when(n % 7 == 0, "insert").otherwise("update").alias("action"))
    jobs = e.where("job_id % 2 = 0").groupBy("job_id").agg(F.min_by(F.struct("status", "stats"), "seq").alias("f")).select("job_id", "f.*")
    return events.applied(jobs, e).select("job_id", "status", F.round("stats", 6).alias("stats"))


@R.query(_CLASSES + f""", k AS ({_BLOCKS}) SELECT time_block, concat_ws(' & ', time_block, runs, successful_runs, printf('%.1f', median_runtime_seconds), printf('%.1f', median_output_rows)) || ' ' || chr(92) || chr(92) AS line FROM k""")
def latex_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a LaTeX table of the time blocks."""
    b = runs.block_summary(_batches(spark, sf_dir))
    return reports.latex_rows(b, ["time_block", "runs", "successful_runs", "median_runtime_seconds", "median_output_rows"], ["time_block"])


@R.query("""SELECT l_returnflag, CAST(count(l_extendedprice) AS BIGINT) AS n, median(CAST(l_extendedprice AS DOUBLE)) AS median, quantile_cont(CAST(l_extendedprice AS DOUBLE), 0.9) AS q90, quantile_disc(CAST(l_extendedprice AS DOUBLE), 0.95) AS p95 FROM lineitem GROUP BY 1""")
def quantiles_of_large_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact quantiles of groups that no task could hold."""
    return quantiles.quantiles(base(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_extendedprice", {"median": 0.5, "q90": 0.9}, {"p95": 0.95})


QUERIES, ORACLE_SQL = R.queries, R.sql
