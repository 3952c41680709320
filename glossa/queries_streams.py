"""Queries that run streams over the given tables, landed batch by batch, and the batch SQL that they end in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .registry import Registry
from .streaming import jobs
from .tables import base, shared_folder

R = Registry()

#: Batches in which a table arrives.
BATCHES = 3
_IDLE_HOURS = 24
#: Events arrive up to so many hours late, across batches.
_LATE_HOURS = 24
_TICK = -1


def _arrive(spark: SparkSession, rows: DataFrame, ts: str, arrival, where: str, run) -> None:
    """Lands rows in folders by their time of arrival and calls run() after each; the last two only move watermarks on."""
    span = rows.agg(F.min(arrival).alias("a"), F.max(arrival).alias("z"), F.max(ts).alias("t")).first()
    if span["a"] is None:
        rows.write.parquet(f"{where}/batch=0")
        return run()
    width = (span["z"] - span["a"]) / BATCHES
    for k in range(BATCHES):
        own = arrival >= F.lit(span["a"] + k * width)
        rows.where(own if k == BATCHES - 1 else own & (arrival < F.lit(span["a"] + (k + 1) * width))).write.parquet(f"{where}/batch={k}")
        run()
    nothing = rows.limit(1).select(*(F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in rows.columns if c != ts))
    for k, at in enumerate((F.lit(span["t"]) + F.expr(f"INTERVAL {_LATE_HOURS} HOURS 1 SECOND"), F.lit(span["t"]) + F.expr(f"INTERVAL {_LATE_HOURS} HOURS 2 SECONDS"))):
        nothing.withColumn(ts, at).select(*rows.columns).write.parquet(f"{where}/batch={BATCHES + k}")
        run()


_EVENTS = """SELECT user_id * 100 + extract(day FROM ts) // 4 AS job_id, event_id AS seq, epoch_ms(ts) AS at_ms,
  CASE WHEN event_id % 29 = 0 THEN 'cancel' WHEN event_type = 'purchase' THEN CASE WHEN event_id % 2 = 0 THEN 'result' ELSE 'exit' END WHEN event_type IN ('view', 'error') THEN 'log' WHEN event_type = 'click' THEN 'progress' ELSE 'other' END AS kind,
  value > 200 AS ok, CAST(event_id % 3 AS INT) AS code FROM events"""


@R.query(f"""WITH e AS ({_EVENTS}), o AS (
  SELECT *, lag(at_ms) OVER w AS before, max(at_ms) OVER () AS now, lead(at_ms) OVER w AS next FROM e WINDOW w AS (PARTITION BY job_id ORDER BY at_ms, seq)
), f AS (SELECT *, kind IN ('cancel', 'result', 'exit') AS final, coalesce(at_ms - before > {_IDLE_HOURS * 3600000}, false) AS gap FROM o),
c AS (SELECT *, coalesce(sum(CASE WHEN final THEN 1 ELSE 0 END) OVER (PARTITION BY job_id ORDER BY at_ms, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + sum(CASE WHEN gap THEN 1 ELSE 0 END) OVER (PARTITION BY job_id ORDER BY at_ms, seq) AS ended FROM f),
s AS (SELECT job_id, arg_max(kind, (at_ms, seq)) AS kind, arg_max(ok, (at_ms, seq)) AS ok, arg_max(code, (at_ms, seq)) AS code, max(at_ms) AS at_ms, max(now) AS now, bool_or(kind IN ('progress', 'log')) AS ran, count(*) AS n_events, count(*) FILTER (kind = 'result') AS n_results FROM c WHERE ended = 0 GROUP BY job_id)
SELECT job_id, CASE kind WHEN 'cancel' THEN 'cancelled' WHEN 'result' THEN CASE WHEN ok THEN 'completed' ELSE 'failed' END WHEN 'exit' THEN CASE WHEN code = 0 THEN 'completed' ELSE 'failed' END
  ELSE CASE WHEN at_ms + {_IDLE_HOURS * 3600000} <= now + 1000 THEN 'expired' WHEN ran THEN 'running' ELSE 'queued' END END AS status, n_events, n_results FROM s""")
def jobs_streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A job state machine over events that arrive in several batches, up to a day out of order; results behind a cancellation go, and idle jobs expire by timer."""
    where = shared_folder(spark, "jobs")
    n, kind = F.col("event_id"), F.col("event_type")
    named = F.when(n % 29 == 0, "cancel").when(kind == "purchase", F.when(n % 2 == 0, "result").otherwise("exit")).when(kind.isin("view", "error"), "log").when(kind == "click", "progress").otherwise("other")
    rows = base(spark, sf_dir, "events").select((F.col("user_id") * 100 + F.expr("day(ts) div 4")).alias("job_id"), n.alias("seq"), F.col("ts").cast("timestamp").alias("ts"), named.alias("kind"), (F.col("value") > 200).alias("ok"), (n % 3).cast("int").alias("code"))
    own = jobs.session_for_state(spark)
    schema, out = rows.schema, f"{where}/out"

    def run() -> None:
        source = own.readStream.schema(schema).option("recursiveFileLookup", True).parquet(f"{where}/in")
        shown = jobs.job_events(source, "job_id", "ts", f"{_LATE_HOURS} hours", _IDLE_HOURS * 3_600_000, 3650 * jobs.DAY_MS)
        shown.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", f"{where}/checkpoint").trigger(availableNow=True).start().awaitTermination()

    arrival = F.col("ts") + F.expr("make_interval(0, 0, 0, 0, cast(seq % 5 * 6 as int))")
    _arrive(spark, rows, "ts", arrival, f"{where}/in", run)
    return jobs.latest(spark.read.schema("job_id long, seq long, at_ms long, kind string, status string").parquet(out), "job_id")


@R.query("""WITH p AS (SELECT event_id AS slot_id, ts AS planned_at FROM events WHERE event_id % 2 = 0),
s AS (SELECT event_id AS slot_id, ts + to_seconds((event_id % 16) * 300) AS started_at FROM events WHERE event_id % 2 = 0 AND event_id % 3 <> 0)
SELECT p.slot_id, planned_at, started_at, CASE WHEN started_at IS NULL THEN 'skipped' WHEN started_at > planned_at + INTERVAL 10 MINUTES THEN 'late' ELSE 'started' END AS outcome
FROM p LEFT JOIN s ON p.slot_id = s.slot_id AND started_at BETWEEN planned_at AND planned_at + INTERVAL 1 HOUR""")
def slots_streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Planned and started slots as two streams in a left outer interval join; slots never started come out as skipped once the watermarks pass."""
    where = shared_folder(spark, "slots")
    n, ts = F.col("event_id"), F.col("ts").cast("timestamp")
    e = base(spark, sf_dir, "events").where(n % 2 == 0)
    rows = e.select(n.alias("slot_id"), ts.alias("planned_at"), F.when(n % 3 != 0, ts + F.expr("make_interval(0, 0, 0, 0, 0, cast(event_id % 16 * 5 as int))")).alias("started_at"))
    schema, out = rows.schema, f"{where}/out"

    def run() -> None:
        # The clock's ticks get a slot of their own: rows without one would be left out below the watermarks.
        source = spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(f"{where}/in").withColumn("slot_id", F.coalesce("slot_id", F.lit(_TICK)))
        # Both streams read what has landed; the second one as it would come from another writer, ticks included.
        plans = source.select("slot_id", "planned_at")
        starts = source.select("slot_id", F.coalesce("started_at", F.when(F.col("slot_id") == _TICK, F.col("planned_at"))).alias("started_at")).where("started_at IS NOT NULL")
        found = jobs.slot_outcomes(plans, starts, delay=f"{_LATE_HOURS - 2} hours")
        # The condition reads the time too, so that it stays above the watermark.
        found.where(F.when(F.col("planned_at").isNotNull(), F.col("slot_id")) != _TICK).writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", f"{where}/checkpoint").trigger(availableNow=True).start().awaitTermination()

    _arrive(spark, rows, "planned_at", F.col("planned_at"), f"{where}/in", run)
    got = spark.read.schema("slot_id long, planned_at timestamp, started_at timestamp, outcome string").parquet(out)
    return jobs.first_starts(got).select("slot_id", F.col("planned_at").cast("timestamp_ntz").alias("planned_at"), F.col("started_at").cast("timestamp_ntz").alias("started_at"), "outcome")


QUERIES, ORACLE_SQL = R.queries, R.sql
