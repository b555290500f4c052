"""Streams with timers, expiring state and two inputs: late rows, silent keys, restarts."""

import datetime as dt
import random
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tideline.streaming import joins as J
from tideline.streaming import timers as X
from tideline.streaming import weeks as K

T0 = dt.datetime(2024, 1, 1, 10)
EVENTS = "event_id long, ts timestamp, user_id long, surface string"
VALUES = "event_id long, ts timestamp, metric string, value double, hit boolean"


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


def write(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def collected(spark, frame, state, mode="append"):
    rows = []
    with X.timed_state(spark):
        q = frame.writeStream.outputMode(mode).option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(lambda f, _: rows.extend(f.collect())).start()
    q.awaitTermination()
    return rows


def presence(spark, path, lateness="5 minutes"):
    return X.presence(spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(path), 10 * 60_000, lateness)


def told(rows):
    return sorted((r.user_id, (r.started - T0).seconds // 60, (r.last_seen - T0).seconds // 60, r.surface, r.events) for r in rows)


def test_a_silent_user_expires_and_a_late_row_is_left_out(spark, tmp_path):
    source, state = str(tmp_path / "in"), str(tmp_path / "state")
    write(spark, source, [(1, at(0), 7, "view"), (2, at(4), 7, "click"), (3, at(8), 8, "view")], EVENTS)
    assert collected(spark, presence(spark, source), state) == []
    write(spark, source, [(4, at(60), 9, "view")], EVENTS)
    assert told(collected(spark, presence(spark, source), state)) == [(7, 0, 4, "click", 2), (8, 8, 8, "view", 1)]
    write(spark, source, [(5, at(5), 7, "late"), (6, at(90), 9, "view")], EVENTS)
    assert told(collected(spark, presence(spark, source), state)) == [(9, 60, 60, "view", 1)]


def test_rows_in_any_order_within_the_lateness_give_the_same(spark, tmp_path):
    rng = random.Random(2)
    rows = [(i, at(rng.randint(0, 300)), rng.randint(1, 4), rng.choice("ab")) for i in range(80)]
    want = []
    for user in range(1, 5):
        own, now = sorted((r[1], r[0], r[3]) for r in rows if r[2] == user), []
        for t, i, s in own:
            if now and t - now[-1][0] > dt.timedelta(minutes=10):
                want.append((user, now))
                now = []
            now.append((t, i, s))
        want.append((user, now))
    want = sorted((u, (n[0][0] - T0).seconds // 60, (n[-1][0] - T0).seconds // 60, n[-1][2], len(n)) for u, n in want)
    for parts in (1, 4):
        source = str(tmp_path / f"in{parts}")
        for k in range(parts):
            write(spark, source, rows[k::parts], EVENTS)
        write(spark, source, [(99, at(300), 5, "z")], EVENTS)
        write(spark, source, [(100, at(900), 5, "z")], EVENTS)
        got = collected(spark, presence(spark, source, "400 minutes"), str(tmp_path / f"state{parts}"))
        assert [r for r in told(got) if r[0] < 5] == want


def test_a_restart_gives_what_one_run_gives(spark, tmp_path):
    rng = random.Random(4)
    files = [[(10 * k + i, at(30 * k + rng.randint(0, 25)), rng.randint(1, 3), "v") for i in range(8)] for k in range(4)] + [[(99, at(400), 9, "v")]]
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    in_steps = []
    for rows in files:
        write(spark, a, rows, EVENTS)
        write(spark, b, rows, EVENTS)
        in_steps += collected(spark, presence(spark, a), str(tmp_path / "state-a"))
    at_once = collected(spark, presence(spark, b), str(tmp_path / "state-b"))
    assert told(in_steps) == told(at_once) and len(at_once) > 3


def plain_alerts(rows, window, step, need, cooldown, until):
    """rows: (minute, id, hit), of one metric; times in minutes."""
    firing, notified, out = False, None, []
    for tick in range(0, until + 1, step):
        seen = [r for r in sorted(rows) if tick - window <= r[0] < tick]
        if not seen:
            continue
        if len(seen) >= need and all(r[2] for r in seen[-need:]):
            if not firing or tick - notified >= cooldown:
                firing, notified = True, tick
                out.append((tick, "firing"))
        elif firing:
            firing = False
            out.append((tick, "resolved"))
    return out


@pytest.mark.parametrize("parts", [1, 5])
def test_alerts_against_a_plain_evaluation(spark, tmp_path, parts):
    rng = random.Random(6)
    rows = {m: [(t, i, rng.random() < 0.7) for i, t in enumerate(sorted(rng.sample(range(600), 70)))] for m in ("cpu", "gpu")}
    rows["quiet"] = [(5, 0, True), (6, 1, True), (7, 2, True)]  # falls silent while it fires
    flat = sorted((t, i, m, hit) for m, own in rows.items() for t, i, hit in own)
    source, state = str(tmp_path / "in"), str(tmp_path / "state")
    got = []
    stream = lambda: X.alerts(spark.readStream.schema(VALUES).option("maxFilesPerTrigger", 1).parquet(source), 30 * 60, 10 * 60, 3, 60 * 60, "0 minutes")
    size = -(-len(flat) // parts)
    for k in range(parts):
        write(spark, source, [(i, at(t), m, float(t), hit) for t, i, m, hit in flat[k * size : (k + 1) * size]], VALUES)
        got += collected(spark, stream(), state)
    write(spark, source, [(999, at(1200), "end", 0.0, False)], VALUES)
    got += collected(spark, stream(), state)
    for m, own in rows.items():
        assert sorted(((r.noticed_at - T0).seconds // 60, r.status) for r in got if r.metric == m) == plain_alerts(own, 30, 10, 3, 60, 1200)


def test_notices_are_quiet_until_their_state_expires(spark, tmp_path):
    """A stream on the clock has no last batch, so it runs until it is stopped."""
    source, rows = str(tmp_path / "in"), []
    write(spark, source, [("a",), ("a",), ("b",)], "k string")
    with X.timed_state(spark):
        notices = X.notices(spark.readStream.schema("k string").parquet(source), "k", 4000)
        q = notices.writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "state")).foreachBatch(lambda f, _: rows.extend(f.collect())).start()

    def until(n):
        end = time.time() + 40
        while len(rows) < n and time.time() < end and q.isActive:
            time.sleep(0.2)

    try:
        for n, more, wait in ((2, [("a",), ("c",)], 0), (3, [("a",)], 8)):
            until(n)
            time.sleep(wait)
            write(spark, source, more, "k string")
        until(4)
    finally:
        q.stop()
    assert [sorted((r["key"], r["rows"]) for r in rows[i:j]) for i, j in ((0, 2), (2, 3), (3, None))] == [[("a", 2), ("b", 1)], [("c", 1)], [("a", 1)]]


def test_stream_join_gives_unmatched_rows_once(spark, tmp_path):
    asked, cached, state = str(tmp_path / "asked"), str(tmp_path / "cached"), str(tmp_path / "state")
    a, c = "user_id long, asked_at timestamp, asked long", "user_id long, valid_from timestamp, cached long"

    def run():
        join = J.valid_at(spark.readStream.schema(a).parquet(asked), spark.readStream.schema(c).parquet(cached), "user_id", "60 MINUTES", "10 minutes")
        return [(r.asked, r.cached) for r in collected(spark, join, state)]

    write(spark, asked, [(1, at(10), 1), (1, at(80), 2), (2, at(10), 3), (None, at(10), 4)], a)
    write(spark, cached, [(1, at(0), 11), (1, at(9), 12), (1, at(11), 13)], c)
    got = run()
    write(spark, asked, [(3, at(300), 5)], a)
    write(spark, cached, [(2, at(5), 14), (3, at(300), 15)], c)  # the watermark is at minute 1, so 14 is in time
    got += run()
    write(spark, asked, [(9, at(600), 6)], a)
    write(spark, cached, [(9, at(600), 16)], c)
    got += run()
    assert sorted(got, key=str) == sorted([(1, 11), (1, 12), (2, None), (3, 14), (4, None), (5, 15), (6, 16)], key=str)


def test_weeks_are_written_once_and_late_rows_reported(spark, tmp_path):
    source, root = str(tmp_path / "in"), str(tmp_path / "root")
    schema = "ts timestamp, user_id long, concept int, value double"
    day = lambda d: dt.datetime(2024, 1, 1) + dt.timedelta(days=d)  # noqa: E731  a Monday
    run = lambda: K.write_closed_weeks(spark.readStream.schema(schema).parquet(source), root, "1 day", 2)
    write(spark, source, [(day(0), u, u % 2, 1.5) for u in (5, 3, 4)] + [(day(1), 3, 7, 2.0), (day(6), 4, 1, 1.0)], schema)
    assert run() == 0
    write(spark, source, [(day(8), 3, 1, 9.0)], schema)
    assert run() == 1 and run() == 0
    rows = lambda: sorted((str(r.week), r.user_id, r.events, r.concepts, r.total) for r in K.summaries(spark, root).collect())
    first = rows()
    assert first == [("2024-01-01", 3, 2, 2, 3.5), ("2024-01-01", 4, 2, 2, 2.5)]
    write(spark, source, [(day(2), 3, 1, 50.0), (day(16), 9, 1, 1.0)], schema)
    assert run() == 1 and rows()[:2] == first and rows()[2:] == [("2024-01-08", 3, 1, 1, 9.0)]
    late = K.late_rows(spark, root, spark.read.schema(schema).parquet(source).schema).collect()
    assert [(r.user_id, r.value, str(r.week)) for r in late] == [(3, 50.0, "2024-01-01")]
    assert sorted((str(r.week), r.learners, r.rows) for r in K.ledger(spark, root).collect()) == [("2024-01-01", 2, 5), ("2024-01-08", 1, 1)]
    write(spark, source, [(day(17), 9, 1, 1.0)], schema)
    assert run() == 0


def test_other_queries_keep_their_state_store(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    with pytest.raises(ValueError), X.timed_state(spark):
        assert spark.conf.get(key) != before
        raise ValueError
    assert spark.conf.get(key) == before and F is not None


def test_only_the_last_rows_of_a_step_reach_the_alerts():
    rng = random.Random(3)
    rows = [(rng.choice("ab"), pd.Timestamp(at(rng.randint(0, 240))), i, rng.random() < 0.5, float(i)) for i in range(900)]
    frame = pd.DataFrame(rows, columns=["metric", "ts", "event_id", "hit", "value"])
    got = pd.concat(X._last_of_steps(3600, 3)(iter([frame[:400], frame[400:]])))
    want = set()
    for tick in range(1, 6):
        for metric in "ab":
            seen = sorted((r[1], r[2]) for r in rows if r[0] == metric and at(60 * (tick - 1)) <= r[1] < at(60 * tick))
            want |= {i for _, i in seen[-3:]}
    assert set(got.event_id) == want and len(got) == len(want)


class _Kept:
    """State that notes what is put into it."""

    def __init__(self):
        self.rows, self.value = [], None

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def appendList(self, rows):  # noqa: N802
        self.rows += rows


class _Handle:
    def __init__(self):
        self.list = _Kept()

    def getListState(self, *_):  # noqa: N802
        return self.list

    def getValueState(self, *_):  # noqa: N802
        return _Kept()

    def registerTimer(self, _):  # noqa: N802
        pass

    def deleteTimer(self, _):  # noqa: N802
        pass


def test_presence_keeps_a_row_for_a_time_of_activity_not_for_each_event():
    handle = _Handle()
    processor = X._Presence(10 * 60_000)
    processor.init(handle)
    frame = pd.DataFrame({"ts": [pd.Timestamp(at(i if i < 50 else i + 30)) for i in range(100)], "event_id": range(100), "surface": ["view"] * 100})
    list(processor.handleInputRows((7,), iter([frame[::2], frame[1::2]]), None))
    assert [r[4] for r in handle.list.rows] == [50, 50]
