"""Jobs as a stream: a state machine that puts events in order, drops what comes behind the end of a job, and lets idle jobs expire.

Events of a job may arrive in any order within the watermark's delay, across batches too. They wait in a
list in the job's state until the watermark has passed them, and are then folded in order of time and number.
A job is queued, then running with its first progress or log; a cancellation, a result or a process's exit
ends it, and so does a time without events. What comes behind the end is left out, results of cancelled jobs
among it. An ended job is remembered for a time, so that stragglers do not begin it anew, and then forgotten.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
ENDED = ("cancelled", "completed", "failed", "expired")
DAY_MS = 86_400_000


def _after(status: str, kind: str, ok: bool | None, code: int | None) -> str:
    """An open job's status after an event."""
    if kind == "cancel":
        return "cancelled"
    if kind == "result":
        return "completed" if ok else "failed"
    if kind == "exit":
        return "completed" if code == 0 else "failed"
    return "running" if kind in ("progress", "log") else status


class JobStates(StatefulProcessor):
    """Folds each job's events; yields every event that counts, with the job's status after it, and expirations.

    State of a job: one value with its status, the time of its timer, and the events that the watermark has not
    passed, which are no more than its events within the delay. Each call reads and writes that value once and sets
    a timer at most: what a job costs is the number of times that its worker asks for state.
    """

    def __init__(self, key: str, idle_ms: int, keep_ms: int) -> None:
        self.idle, self.keep = idle_ms, keep_ms
        self.shown = Row(key, "seq", "at_ms", "kind", "status")

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", "status string, at_ms long, wake_ms long, waiting array<struct<at_ms: long, seq: long, kind: string, ok: boolean, code: int>>")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        came = [(r.at_ms, r.seq, r.kind, r.ok, r.code) for r in rows]
        status, last, wake, waiting = self.job.get() or ("queued", None, None, [])
        if status in ENDED:
            return iter([])
        first = min(x[0] for x in came)
        if wake is None or first < wake:
            if wake is not None:
                self.handle.deleteTimer(wake)
            self.handle.registerTimer(first)
            wake = first
        self.job.update((status, last, wake, [tuple(x) for x in waiting] + came))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs()
        status, last, _, waiting = self.job.get()
        if status in ENDED:
            self.job.clear()  # remembered long enough
            return
        waiting = sorted(tuple(x) for x in waiting)
        due, rest = [x for x in waiting if x[0] <= now], [x for x in waiting if x[0] > now]
        for at, seq, kind, ok, code in due:
            if last is not None and at - last > self.idle:
                break
            status, last = _after(status, kind, ok, code), at
            yield self.shown(key[0], seq, at, kind, status)
            if status in ENDED:
                break
        if status not in ENDED and last is not None and last + self.idle <= now:
            status, last = "expired", last + self.idle
            yield self.shown(key[0], None, last, "idle", status)
        if status in ENDED:
            rest, wake = [], last + self.keep
        else:
            wake = min([last + self.idle, *(x[0] for x in rest)])
        self.job.update((status, last, wake, rest))
        self.handle.registerTimer(wake)  # the timer that has just expired goes by itself


def job_events(events: DataFrame, key: str, ts: str, delay: str, idle_ms: int, keep_ms: int = 30 * DAY_MS) -> DataFrame:
    """A stream of the events that count (key, seq, at_ms, kind, status after it) of events (key, seq, kind, ok, code) at ts.

    The session's state store has to be RocksDB's: see `session_for_state`. Events without key only move the watermark.
    """
    kind = dict(events.dtypes)[key]
    # The condition reads the time too: otherwise it would be moved below the watermark, which then would not see the other rows.
    named = F.when(F.col(ts).isNotNull(), F.col(key)).isNotNull()
    rows = events.withColumn("at_ms", F.unix_millis(ts)).withWatermark(ts, delay).where(named).select(key, ts, "at_ms", F.col("seq").cast("long").alias("seq"), "kind", "ok", F.col("code").cast("int").alias("code"))
    return rows.groupBy(key).transformWithState(JobStates(key, idle_ms, keep_ms), f"{key} {kind}, seq long, at_ms long, kind string, status string", "Append", "EventTime")


def session_for_state(spark):
    """A session of the same application whose streams may keep state and timers for a key."""
    own = spark.newSession()
    own.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    own.conf.set("spark.sql.session.timeZone", spark.conf.get("spark.sql.session.timeZone"))
    own.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))
    return own


def latest(shown: DataFrame, key: str) -> DataFrame:
    """Each job's status after its last event that counts, how many counted, and how many results were handed on."""
    return shown.groupBy(key).agg(F.max_by("status", F.struct("at_ms", F.col("kind") == "idle", "seq")).alias("status"), F.count_if(F.col("kind") != "idle").alias("n_events"), F.count_if(F.col("kind") == "result").alias("n_results"))


# Late slots -------------------------------------------------------------------


def slot_outcomes(planned: DataFrame, started: DataFrame, wait: str = "1 hour", late_minutes: int = 10, delay: str = "15 minutes") -> DataFrame:
    """Planned slots (slot_id, planned_at) with what became of them: a stream-stream left outer interval join.

    A start (slot_id, started_at) counts from its plan until `wait` after it. Once both watermarks have passed that
    time, a slot without a start comes out as skipped; one that started more than `late_minutes` after its plan is
    late, and its run is skipped too. State of both sides goes as the watermarks pass it.
    """
    p = planned.withWatermark("planned_at", delay)
    s = started.select(F.col("slot_id").alias("started_slot"), "started_at").withWatermark("started_at", delay)
    within = (F.col("slot_id") == F.col("started_slot")) & (F.col("started_at") >= F.col("planned_at")) & (F.col("started_at") <= F.col("planned_at") + F.expr(f"INTERVAL {wait}"))
    return p.join(s, within, "leftOuter").select("slot_id", "planned_at", "started_at", outcome(late_minutes).alias("outcome"))


def outcome(late_minutes: int) -> Column:
    late = F.col("started_at") > F.col("planned_at") + F.expr(f"INTERVAL {late_minutes} minutes")
    return F.when(F.col("started_at").isNull(), "skipped").when(late, "late").otherwise("started")


def first_starts(outcomes: DataFrame) -> DataFrame:
    """One row a slot: a slot that was started again counts by its first start."""
    w = Window.partitionBy("slot_id").orderBy(F.col("started_at").asc_nulls_last())
    return outcomes.withColumn("_nth", F.row_number().over(w)).where("_nth = 1").drop("_nth")
