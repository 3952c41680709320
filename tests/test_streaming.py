import datetime as dt

from pyspark.sql import functions as F

from glossa.operators.events import job_status
from glossa.streaming import events


def test_line_protocol_is_routed_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text('PROGRESS:{"percent": 5}\nnoise\nLOG:{"level": "info"}\nRESULT:{broken\n')
    paths = {k: str(tmp_path / k) for k in ("progress", "log", "result")}
    for _ in range(2):
        events.route(events.dispatch(events.read_lines(spark, str(tmp_path / "in"))), paths, str(tmp_path / "cp")).awaitTermination()
    got = {k: spark.read.parquet(p).collect() for k, p in paths.items()}
    assert {k: len(v) for k, v in got.items()} == {"progress": 1, "log": 1, "result": 1}
    assert got["result"][0]["payload"] == "{broken" and got["result"][0]["json"] is None


def test_windows_leave_late_events_out(spark, tmp_path):
    t = dt.datetime(2024, 1, 1, 12)
    schema = "ts timestamp, event_type string, value double"

    def put(n, rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"p={n}"))

    def run():
        source = events.read_table(spark, str(tmp_path / "in"), spark.createDataFrame([], schema).schema, recursiveFileLookup="true")
        events.write_available(events.windowed(source), str(tmp_path / "out"), str(tmp_path / "cp"))
        return {(r["start"].hour, r["n"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()} if (tmp_path / "out").exists() else set()

    put(1, [(t, "a", 1.0), (t + dt.timedelta(minutes=5), "a", 2.0), (t + dt.timedelta(hours=3), "a", 1.0)])
    run()
    put(2, [(t + dt.timedelta(minutes=1), "a", 9.0), (t + dt.timedelta(hours=6), "a", 1.0)])
    got = run()
    # The late event of 12:01 does not change the closed window.
    assert (12, 2) in got and (12, 3) not in got


def test_job_states_equal_the_batch_form(spark, tmp_path):
    rows = [(1, 0, "progress", None, None), (1, 1, "result", True, None), (1, 2, "exit", None, 1), (2, 0, "log", None, None), (3, 0, "exit", None, 2), (4, 0, "cancel", None, None), (4, 1, "result", True, None), (5, 0, "other", None, None)]
    schema = "job_id long, seq long, kind string, ok boolean, code int"
    df = spark.createDataFrame(rows, schema)
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = events.job_states(events.read_table(spark, str(tmp_path / "in"), df.schema))
    q = stream.writeStream.outputMode("update").foreachBatch(lambda b, n: b.write.mode("append").parquet(str(tmp_path / "out"))).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {r["job_id"]: r["status"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {r["job_id"]: r["status"] for r in job_status(df).collect()}
    assert got == {1: "completed", 2: "running", 3: "failed", 4: "cancelled", 5: "queued"}


def test_quota_windows(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 2, 8),), (dt.datetime(2024, 1, 2, 10),)], "ts timestamp")
    assert sorted(r["start"].day for r in events.quota_windows(df).collect()) == [1, 2]
    assert df.where(F.lit(True)).count() == 2
