"""Streams: late rows, sliding windows, restarts, and the fold of alerts."""

import datetime as dt

from pyspark.sql import functions as F

from tideline.streaming import alerts
from tideline.streaming import state as S

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def at(minute, second=0):
    return dt.datetime(2024, 1, 1, 10) + dt.timedelta(minutes=minute, seconds=second)


def write(spark, path, rows):
    spark.createDataFrame([(i, t, u, k, float(v), '{"k": 1}') for i, t, u, k, v in rows], SCHEMA).coalesce(1).write.mode("append").parquet(path)


def stream(spark, path):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)


def collected(frame, mode, state):
    """All rows that a stream gives until its source is read; its progress is kept in the folder `state`."""
    rows = []
    q = frame.writeStream.outputMode(mode).option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(lambda f, _: rows.extend(f.collect())).start()
    q.awaitTermination()
    return rows


def test_late_rows_are_left_out(spark, tmp_path):
    source, state = str(tmp_path / "in"), str(tmp_path / "state")
    rollup = lambda: S.rollup(stream(spark, source), ["event_type"], "value", "1 minute", "2 minutes")
    write(spark, source, [(1, at(0, 10), 1, "view", 2), (2, at(0, 50), 1, "view", 4), (3, at(9), 1, "view", 1)])
    rows = collected(rollup(), "append", state)
    write(spark, source, [(4, at(0, 20), 1, "view", 100), (5, at(30), 1, "view", 1)])
    rows += collected(rollup(), "append", state)
    assert sorted((r.bucket.minute, r.n, r.total) for r in rows) == [(0, 2, 6.0), (9, 1, 1.0)]


def test_mastery_survives_a_restart(spark, tmp_path):
    source, state = str(tmp_path / "in"), str(tmp_path / "state")
    days = {}

    def run():
        rows = stream(spark, source).withColumn("concept", F.lit(1)).select("event_id", "ts", "user_id", "event_type", "concept")
        for r in collected(S.mastery_days(rows, "2 days"), "update", state):
            days[r.user_id, r.day] = r  # a later batch replaces an earlier one
        frame = spark.createDataFrame(list(days.values()), "user_id long, concept int, day timestamp, sum struct<low: double, high: double, shift: double>, n int")
        return {r.user_id: (round(r.mastery, 6), r.evidence) for r in S.mastery(frame).collect()}

    write(spark, source, [(i, at(i), 7, "purchase", 1) for i in range(4)])
    assert run() == {7: (1.0, 4)}
    write(spark, source, [(9, at(20), 7, "error", 1)])
    assert run() == {7: (0.88, 5)}
    # An event that comes late counts where it belongs: before the last error, at a mastery of one already.
    write(spark, source, [(10, at(10), 7, "purchase", 1), (11, at(24 * 60 + 5), 7, "error", 1)])
    assert run() == {7: (0.76, 7)}


def test_closed_days_leave_no_state(spark, tmp_path):
    source, state = str(tmp_path / "in"), str(tmp_path / "state")
    days = lambda: S.mastery_days(stream(spark, source).withColumn("concept", F.lit(1)), "1 hour")
    write(spark, source, [(1, at(0), 7, "purchase", 1)])
    collected(days(), "update", state)
    write(spark, source, [(2, at(3 * 24 * 60), 7, "purchase", 1)])
    collected(days(), "update", state)
    write(spark, source, [(3, at(1), 7, "error", 1), (4, at(3 * 24 * 60 + 1), 7, "error", 1)])  # the first is too late
    assert [(r.day.day, r.n) for r in collected(days(), "update", state)] == [(4, 2)]


def test_alerts_fire_cool_down_and_resolve(spark):
    rows = [(1, at(0), 1, True), (1, at(1), 2, True), (1, at(20), 3, True), (1, at(21), 4, False), (1, at(22), 5, True), (2, at(0), 6, False)]
    frame = spark.createDataFrame(rows, "k int, ts timestamp, event_id int, hit boolean")
    got = {r.k: (r.state, r.sent, r.resolved) for r in alerts.fold_alerts(frame, ["k"], ["ts", "event_id"], "hit", 900).collect()}
    assert got == {1: ("firing", 3, 1), 2: ("ok", 0, 0)}


def test_issue_reopens(spark, tmp_path):
    source = str(tmp_path / "in")
    write(spark, source, [(1, at(0), 1, "error", 1), (2, at(1), 1, "error", 1), (3, at(2), 1, "fixed", 1), (4, at(3), 1, "error", 1), (5, at(3), 2, "error", 1), (6, at(4), 2, "fixed", 1)])
    rows = stream(spark, source).select(F.col("user_id").cast("string").alias("fingerprint"), "ts", (F.col("event_type") == "fixed").alias("resolved"))
    got = {r.fingerprint: (r.status, r.occurrences) for r in S.drained(S.issues(rows), "update", str(tmp_path / "out")).collect()}
    assert got == {"1": ("reopened", 3), "2": ("resolved", 1)}


def test_rooms(spark):
    events = spark.createDataFrame([(1, "error"), (2, "view")], "user_id int, kind string")
    rooms = [F.lit("global"), F.when(F.col("kind") == "error", "ops"), F.lit("global")]
    assert sorted((r.user_id, r.room) for r in S.routed(events, rooms).collect()) == [(1, "global"), (1, "ops"), (2, "global")]
