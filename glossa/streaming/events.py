"""Structured Streaming forms: line protocol, windows with lateness, latest state, job status."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..constants import LATE_MINUTES, QUOTA_RESET_HOUR
from ..operators.events import parse_lines


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of files as they arrive in a folder; a file source hands over whole lines only."""
    return spark.readStream.text(path)


def read_table(spark: SparkSession, path: str, schema, **options: str) -> DataFrame:
    return spark.readStream.schema(schema).options(**options).parquet(path)


def dispatch(lines: DataFrame) -> DataFrame:
    """Progress, log and result events of a line stream; others go, undecodable payloads stay as text."""
    return parse_lines(lines)


def route(events: DataFrame, paths: dict[str, str], checkpoint: str, cancelled: list[str] | None = None) -> StreamingQuery:
    """Appends each kind of event to its own table, batch by batch; results of cancelled jobs are left out.

    A batch that is run again overwrites its own folder, so each event lands once.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.persist()
        for kind, path in paths.items():
            own = batch.where(F.col("kind") == kind)
            if kind == "result" and cancelled and "job_id" in batch.columns:
                own = own.where(~F.col("job_id").isin(cancelled))
            own.write.mode("overwrite").parquet(f"{path}/batch={number}")
        batch.unpersist()

    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed(events: DataFrame, ts: str = "ts", by: tuple[str, ...] = ("event_type",), length: str = "1 hour", late: str = f"{LATE_MINUTES} minutes", value: str = "value") -> DataFrame:
    """Counts and sums of fixed windows; events later than the watermark are left out."""
    w = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).groupBy(F.window(ts, length), *by)
    return w.agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("window.start").alias("start"), *by, "n", "total")


def quota_windows(events: DataFrame, ts: str = "ts", late: str = f"{LATE_MINUTES} minutes") -> DataFrame:
    """Counts of days that begin at the quota's reset hour."""
    w = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).groupBy(F.window(ts, "1 day", "1 day", f"{QUOTA_RESET_HOUR} hours"))
    return w.agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "n")


def write_available(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Runs a stream over what is there now, into a table."""
    q = df.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


_RANK = {"queued": 0, "running": 1, "completed": 2, "failed": 2, "cancelled": 3}


def _next(status: str, kind: str, ok, code) -> str:
    """A job's status after an event; a final status stays, but a cancellation comes before a result."""
    if status == "cancelled" or kind == "cancel":
        return "cancelled"
    if kind == "result":
        return "completed" if ok else "failed"
    if kind == "exit" and status not in ("completed", "failed"):
        return "completed" if code == 0 else "failed"
    return "running" if kind in ("progress", "log") and status == "queued" else status


def job_states(events: DataFrame, key: str = "job_id") -> DataFrame:
    """Each job's status whenever events of it arrive; events (key, seq, kind, ok, code) are folded in order of seq."""

    def fold(keys: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        status = state.get[0] if state.exists else "queued"
        rows = pd.concat(list(batches)).sort_values("seq")
        for r in rows.itertuples(index=False):
            status = _next(status, r.kind, r.ok, r.code)
        state.update((status,))
        yield pd.DataFrame({key: [keys[0]], "status": [status], "seq": [int(rows["seq"].max())]})

    kind = dict(events.dtypes)[key]
    return events.groupBy(key).applyInPandasWithState(fold, f"{key} {kind}, status string, seq long", "status string", "update", GroupStateTimeout.NoTimeout)
