"""Streams with timers: presence that ends by itself, alerts that are evaluated as event time passes, and notices that
stay quiet for a while.

Each key's state is a few values, or the rows of one look-back window, and it is freed when nothing is left to wait for.
Timers run on the watermark, so the rows that come out do not depend on how the input was cut into batches, as long as no
row is later than the watermark allows; later rows are left out by Spark.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def timed_state(spark: SparkSession) -> Iterator[None]:
    """Queries started in here keep their state where timers and lists can be kept; others are as before."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


def _micros(ts: pd.Series) -> pd.Series:
    return ts.astype("datetime64[us]").astype("int64")


class _Presence(StatefulProcessor):
    """The times of activity that the watermark has not passed, and one row of state for the one that runs."""

    def __init__(self, window_ms: int) -> None:
        self.window = window_ms * 1000

    def init(self, handle) -> None:
        self.handle = handle
        self.runs = handle.getListState("runs", "started long, last long, id long, surface string, n long")
        self.now = handle.getValueState("now", "started long, last long, id long, surface string, n long, due long")

    def _joined(self, runs: list[tuple]) -> list[tuple]:
        """Runs of events that lie within the window of each other made one; their order of arrival does not count."""
        out: list[tuple] = []
        for run in sorted(runs, key=lambda r: r[:3]):
            if out and run[0] - out[-1][1] <= self.window:
                a = out[-1]
                late = run if run[1:3] >= a[1:3] else a
                out[-1] = (a[0], late[1], late[2], late[3], a[4] + run[4])
            else:
                out.append(run)
        return out

    def _runs(self, frame: pd.DataFrame) -> list[tuple]:
        """The runs of some events."""
        f = pd.DataFrame({"at": _micros(frame["ts"]), "id": frame["event_id"].astype("int64"), "surface": frame["surface"]}).sort_values(["at", "id"], kind="stable")
        at, ids, surface = f["at"].to_numpy(), f["id"].to_numpy(), f["surface"].to_numpy()
        first = [0, *((at[1:] - at[:-1] > self.window).nonzero()[0] + 1).tolist()]
        ends = [*first[1:], len(at)]
        return [(int(at[i]), int(at[j - 1]), int(ids[j - 1]), surface[j - 1], j - i) for i, j in zip(first, ends, strict=True)]

    def _timed(self, now: tuple | None, due: int | None, set_for: int | None) -> None:
        """Keeps what runs, and waits for the watermark to reach a time in place of the one that was waited for."""
        due = None if due is None else -(-due // 1000)
        if due != set_for:
            if set_for is not None:
                self.handle.deleteTimer(set_for)
            if due is not None:
                self.handle.registerTimer(due)
        if now is None and due is None:
            self.now.clear()
        else:
            self.now.update((*(now or (None,) * 5), due))

    def _state(self) -> tuple[tuple | None, int | None]:
        held = self.now.get() if self.now.exists() else None
        return (tuple(held[:5]) if held and held[0] is not None else None), (held[5] if held else None)

    def handleInputRows(self, key, rows, timerValues):
        runs: list[tuple] = []
        for frame in rows:
            runs = self._joined(runs + self._runs(frame))
        now, set_for = self._state()
        self.runs.appendList(runs)
        first = runs[0][0] if set_for is None else min(runs[0][0], set_for * 1000)
        self._timed(now, first, set_for)
        yield _frame([], _PRESENCE)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        now, set_for = self._state()
        seen = timerValues.getCurrentWatermarkInMs() * 1000
        runs = [tuple(r) for r in self.runs.get()] if self.runs.exists() else []
        # All rows up to the watermark are here, so what has begun by then is joined as far as it goes; a later row
        # may lie inside it, and joins it in its turn.
        begun = self._joined(([now] if now is not None else []) + [r for r in runs if r[0] <= seen])
        rest = [r for r in runs if r[0] > seen]
        ended = [r for r in begun if r[1] + self.window <= seen]
        open_ = [r for r in begun if r[1] + self.window > seen]
        now = open_[0] if open_ else None
        rest += open_[1:]
        if rest:
            self.runs.put(rest)
        elif runs:
            self.runs.clear()
        due = [r[0] for r in rest] + ([now[1] + self.window] if now is not None else [])
        self._timed(now, min(due) if due else None, None)
        time = lambda us: pd.Timestamp(us, unit="us")
        yield _frame([(key[0], time(a), time(b), s, n, time(b + self.window)) for a, b, _, s, n in ended], _PRESENCE)

    def close(self) -> None:
        pass


_PRESENCE = ("user_id", "started", "last_seen", "surface", "events", "expired_at")


def _frame(rows: list[tuple], names: tuple[str, ...]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=list(names))


def presence(stream: DataFrame, window_ms: int, lateness: str) -> DataFrame:
    """user_id, started, last_seen, surface of the last event, events and expired_at of each time that a user was active
    and then sent nothing for longer than the window. stream: ts, event_id, user_id, surface.

    A row comes out once the watermark has passed the window's end, also for a user of whom nothing more is heard; until
    then the user is active. Of events at one time the greater event_id is the last.
    """
    schema = "user_id long, started timestamp, last_seen timestamp, surface string, events long, expired_at timestamp"
    rows = stream.withWatermark("ts", lateness).select("user_id", "ts", "event_id", "surface")
    return rows.groupBy("user_id").transformWithStateInPandas(_Presence(window_ms), schema, "append", "eventtime")


class _Alerts(StatefulProcessor):
    """The rows that a look-back window may still need, and the state of the alert."""

    def __init__(self, window_s: int, step_s: int, need: int, cooldown_s: int) -> None:
        self.window, self.step, self.cooldown = (1_000_000 * s for s in (window_s, step_s, cooldown_s))
        self.need = need

    def init(self, handle) -> None:
        self.handle = handle
        self.rows = handle.getListState("rows", "at long, id long, hit boolean, value double")
        self.alert = handle.getValueState("alert", "firing boolean, notified long, due long")

    def handleInputRows(self, key, rows, timerValues):
        first = None
        for frame in rows:
            at = _micros(frame["ts"])
            self.rows.appendList([(int(a), int(i), bool(h), float(v)) for a, i, h, v in zip(at, frame["event_id"], frame["hit"], frame["value"], strict=True)])
            first = min(int(at.min()), first) if first is not None else int(at.min())
        # The first tick that sees a row is the next whole step after it.
        due = (first // self.step + 1) * self.step
        firing, notified, timer = self.alert.get() if self.alert.exists() else (False, None, None)
        if timer is None or due < timer:
            if timer is not None:
                self.handle.deleteTimer(timer // 1000)
            self.handle.registerTimer(due // 1000)
            timer = due
        self.alert.update((firing, notified, timer))
        yield _frame([], _ALERTS)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        firing, notified, tick = self.alert.get()
        seen = timerValues.getCurrentWatermarkInMs() * 1000
        rows, out = sorted(self.rows.get()), []
        low = high = 0
        while tick <= seen and low < len(rows):
            while high < len(rows) and rows[high][0] < tick:
                high += 1
            while low < high and rows[low][0] < tick - self.window:
                low += 1
            if low < high:
                last = rows[max(low, high - self.need) : high]
                if len(last) == self.need and all(r[2] for r in last):
                    if not firing or tick - notified >= self.cooldown:
                        firing, notified = True, tick
                        out.append((key[0], pd.Timestamp(tick, unit="us"), "firing", last[-1][3]))
                elif firing:
                    firing = False
                    out.append((key[0], pd.Timestamp(tick, unit="us"), "resolved", last[-1][3]))
                tick += self.step
            else:  # nothing in the window: on to the first tick that sees the next row
                tick = (rows[high][0] // self.step + 1) * self.step if high < len(rows) else seen + self.step
        rows = rows[low:]
        if rows:
            self.rows.put(rows)
            self.handle.registerTimer(tick // 1000)
            self.alert.update((firing, notified, tick))
        else:
            self.rows.clear()
            if firing:
                self.alert.update((firing, notified, None))
            else:
                self.alert.clear()
        yield _frame(out, _ALERTS)

    def close(self) -> None:
        pass


_ALERTS = ("metric", "noticed_at", "status", "value")
#: Rows that a task gathers before it looks which of them count.
GATHERED = 500_000


def _last_of_steps(step_s: int, need: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Of each metric's rows between two steps only the last `need`: no evaluation looks at others, wherever its window
    begins, and a batch's latest row is among them, so the watermark stays what it is."""

    def last(frame: pd.DataFrame) -> pd.DataFrame:
        at = _micros(frame["ts"])
        frame = frame.assign(hit=frame["hit"].fillna(False).astype(bool), _at=at, _step=at // (1_000_000 * step_s))
        ordered = frame.sort_values(["_at", "event_id", "hit", "value"])
        return ordered.groupby(["metric", "_step"], dropna=False, sort=False).tail(need).drop(columns=["_at", "_step"])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n, out = [], 0, None
        for frame in frames:
            held.append(frame)
            n += len(frame)
            if n >= GATHERED:
                out = last(pd.concat(held, ignore_index=True))
                # Where little can be left out, what is gathered goes on.
                if len(out) > GATHERED // 2:
                    yield out
                    held, n = [], 0
                else:
                    held, n = [out], len(out)
        if n:
            yield last(pd.concat(held, ignore_index=True))

    return run


def alerts(stream: DataFrame, window_s: int, step_s: int, need: int, cooldown_s: int, lateness: str) -> DataFrame:
    """metric, noticed_at, status and value of each notice. stream: metric, ts, event_id, value and hit (whether it breaches).

    At every whole step of event time the values of the last window are looked at, if there are any: `need` breaches in a
    row at its end fire, again only after the cooldown; anything else resolves what fires. A metric that falls silent
    keeps its state of firing and costs nothing else. Steps must be whole milliseconds.
    """
    rows = stream.select("metric", "ts", F.col("event_id").cast("long").alias("event_id"), F.col("hit").cast("boolean").alias("hit"), F.col("value").cast("double").alias("value"))
    rows = rows.where("ts IS NOT NULL").mapInPandas(_last_of_steps(step_s, need), "metric string, ts timestamp, event_id long, hit boolean, value double").withWatermark("ts", lateness)
    schema = "metric string, noticed_at timestamp, status string, value double"
    return rows.groupBy("metric").transformWithStateInPandas(_Alerts(window_s, step_s, need, cooldown_s), schema, "append", "eventtime")


class _Quiet(StatefulProcessor):
    """Whether a key has spoken; the state store forgets it after a while."""

    def __init__(self, quiet_ms: int) -> None:
        self.quiet = quiet_ms

    def init(self, handle) -> None:
        self.spoken = handle.getValueState("spoken", "at long", ttlDurationMs=self.quiet)

    def handleInputRows(self, key, rows, timerValues):
        n = sum(len(frame) for frame in rows)
        if self.spoken.exists():
            yield _frame([], ("key", "rows"))
        else:
            self.spoken.update((timerValues.getCurrentProcessingTimeInMs(),))
            yield _frame([(key[0], n)], ("key", "rows"))

    def close(self) -> None:
        pass


def notices(stream: DataFrame, key: str, quiet_ms: int) -> DataFrame:
    """key and rows of its batch: a notice for each key, and no other for quiet_ms of the clock, by state that expires.
    Such a stream has no last batch: it runs until it is stopped, and is not for a trigger of what is available now."""
    return stream.select(F.col(key).cast("string").alias("key")).groupBy("key").transformWithStateInPandas(_Quiet(quiet_ms), "key string, rows long", "append", "processingtime")


def drained_with_timers(stream: DataFrame, path: str, drained: Callable[[DataFrame, str, str], DataFrame]) -> DataFrame:
    """drained() under timed_state()."""
    with timed_state(stream.sparkSession):
        return drained(stream, "append", path)
