"""Streams of jobs and slots: order across batches, cancellation, expiry by timer, forgetting, late and missing starts."""

import datetime as dt

import pytest
from pyspark.sql import Row

from glossa.streaming import jobs

T0 = dt.datetime(2024, 1, 1)
EVENTS = "job_id long, seq long, ts timestamp, kind string, ok boolean, code int"


def at(hours):
    return T0 + dt.timedelta(hours=hours)


@pytest.fixture()
def fold(spark, tmp_path):
    """Runs batches through the state machine and gives what counted of each job, in order."""

    def run(batches, idle=10, keep=1000, delay="2 hours"):
        own = jobs.session_for_state(spark)
        schema = spark.createDataFrame([], EVENTS).schema
        for k, rows in enumerate(batches):
            spark.createDataFrame(rows, EVENTS).coalesce(1).write.parquet(f"{tmp_path}/in/batch={k}")
            source = own.readStream.schema(schema).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
            shown = jobs.job_events(source, "job_id", "ts", delay, idle * 3_600_000, keep * 3_600_000)
            shown.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
        got = sorted(spark.read.parquet(f"{tmp_path}/out").collect(), key=lambda r: (r["job_id"], r["at_ms"], r["seq"] is None))
        return {j: [(r["seq"], r["kind"], r["status"]) for r in got if r["job_id"] == j] for j in {r["job_id"] for r in got}}

    return run


def tick(hours):
    return (None, None, at(hours), None, None, None)


def test_events_of_later_batches_are_put_in_order(fold):
    got = fold(
        [
            [(1, 3, at(1.5), "result", True, None), (2, 1, at(0), "log", None, None), (4, 1, at(0), "exit", None, 3)],
            [(1, 2, at(0.5), "progress", None, None), (2, 3, at(1.5), "result", True, None), (2, 2, at(1), "cancel", None, None)],
            [(1, 4, at(3), "log", None, None), (3, 1, at(3), "other", None, None), tick(6)],
            [tick(40)],
            [tick(41)],
        ]
    )
    assert got == {
        1: [(2, "progress", "running"), (3, "result", "completed")],
        2: [(1, "log", "running"), (2, "cancel", "cancelled")],  # the result behind the cancellation is not handed on
        3: [(1, "other", "queued"), (None, "idle", "expired")],
        4: [(1, "exit", "failed")],
    }


def test_a_gap_within_a_batch_expires_a_job_and_an_old_job_is_forgotten(fold):
    got = fold([[(1, 1, at(0), "log", None, None), (1, 2, at(30), "result", True, None), tick(35)], [tick(60)], [(1, 3, at(70), "log", None, None), tick(75)], [tick(76)]], keep=20)
    # Expired at 10 h; forgotten at 30 h, so what comes at 70 h is a job anew.
    assert got[1] == [(1, "log", "running"), (None, "idle", "expired"), (3, "log", "running")]


def test_slots(spark, tmp_path):
    plans, starts = "slot_id long, planned_at timestamp", "slot_id long, started_at timestamp"
    landed = [
        ([(1, at(0)), (2, at(1)), (3, at(2))], [(1, at(0.1)), (9, at(0))]),
        ([(4, at(3))], [(2, at(1.5)), (1, at(0.05))]),
        ([(5, at(4))], [(3, at(3.5)), (4, at(2.9))]),
        ([(-1, at(50))], [(-1, at(50))]),
        ([(-1, at(51))], [(-1, at(51))]),
    ]
    for k, (p, s) in enumerate(landed):
        spark.createDataFrame(p, plans).coalesce(1).write.parquet(f"{tmp_path}/p/b={k}")
        spark.createDataFrame(s, starts).coalesce(1).write.parquet(f"{tmp_path}/s/b={k}")
        a, b = (spark.readStream.schema(x).option("recursiveFileLookup", True).parquet(f"{tmp_path}/{n}") for x, n in ((plans, "p"), (starts, "s")))
        q = jobs.slot_outcomes(a, b, delay="5 hours").writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
        q.awaitTermination()
    got = {r["slot_id"]: (r["started_at"], r["outcome"]) for r in jobs.first_starts(spark.read.parquet(f"{tmp_path}/out").where("slot_id > 0")).collect()}
    # 3 started after its hour, 4 before its plan: neither start counts.
    assert got == {1: (at(0.05), "started"), 2: (at(1.5), "late"), 3: (None, "skipped"), 4: (None, "skipped"), 5: (None, "skipped")}


def test_a_call_reads_and_writes_a_jobs_state_once():
    """Every request goes over a socket; their number a job decides how long a large stream takes."""
    asked, held, timers = [], {}, set()

    class Handle:
        def getValueState(self, name, schema):
            return self

        def get(self):
            asked.append("get")
            return held.get("job")

        def update(self, value):
            asked.append("update")
            held["job"] = value

        def registerTimer(self, t):
            asked.append("register")
            timers.add(t)

        def deleteTimer(self, t):
            asked.append("delete")
            timers.discard(t)

    class Now:
        def getCurrentWatermarkInMs(self):
            return 50

    row = Row("at_ms", "seq", "kind", "ok", "code")
    states = jobs.JobStates("job_id", 1000, 1000)
    states.init(Handle())
    list(states.handleInputRows((1,), iter([row(40, 2, "log", None, None), row(90, 3, "result", True, None)]), Now()))
    list(states.handleInputRows((1,), iter([row(30, 1, "progress", None, None)]), Now()))
    assert asked == ["get", "register", "update", "get", "delete", "register", "update"] and timers == {30}
    asked.clear()
    shown = [tuple(r) for r in states.handleExpiredTimer((1,), Now(), None)]
    assert shown == [(1, 1, 30, "progress", "running"), (1, 2, 40, "log", "running")]
    assert asked == ["get", "update", "register"] and timers == {30, 90}
