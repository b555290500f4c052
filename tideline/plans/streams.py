"""Streams over the events table, drained into tables; each gives what the batch form gives."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import relational as R
from ..sources.scratch import scratch_path
from ..streaming import joins as J
from ..streaming import state as S
from ..streaming import timers as X
from ..streaming import weeks as K
from ._registry import query
from .learning import _MASTERY


def _newest(keys):
    return lambda rows: R.latest(rows, keys, ["batch"])


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS bucket, event_type, count(*) AS n, round_even(sum(value), 2) AS total, min(value) AS lo, max(value) AS hi FROM events GROUP BY 1, 2")
def stream_hour_rollup(spark, sf):
    out = S.drained(S.rollup(S.events_stream(spark, sf), ["event_type"], "value", "1 hour", S.whole_span(spark, sf)), "update", scratch_path(spark, "stream"), _newest(["bucket", "event_type"]))
    return out.select(F.col("bucket").cast("timestamp_ntz").alias("bucket"), "event_type", "n", F.bround("total", 2).alias("total"), "lo", "hi")


@query("SELECT s AS bucket, count(*) AS n FROM (SELECT unnest(range(time_bucket(INTERVAL 12 HOURS, ts) - INTERVAL 12 HOURS, time_bucket(INTERVAL 12 HOURS, ts) + INTERVAL 1 HOUR, INTERVAL 12 HOURS)) AS s FROM events) GROUP BY 1")
def stream_sliding_day(spark, sf):
    """Counts of a day, every twelve hours."""
    out = S.drained(S.rollup(S.events_stream(spark, sf), [], "value", "1 day", S.whole_span(spark, sf), "12 hours"), "update", scratch_path(spark, "stream"), _newest(["bucket"]))
    return out.select(F.col("bucket").cast("timestamp_ntz").alias("bucket"), "n")


@query(f"WITH RECURSIVE {_MASTERY} SELECT user_id, concept, round_even(mastery, 6) AS mastery, cast(evidence AS INTEGER) AS evidence FROM mastery")
def stream_mastery(spark, sf):
    """The clamped fold as a stream: days are kept as state until they close, and merge where the table is read."""
    events = S.events_stream(spark, sf, None).withColumn("concept", F.get_json_object("props", "$.k").cast("int") % 10)
    days = S.drained(S.mastery_days(events.select("event_id", "ts", "user_id", "event_type", "concept"), "1 day"), "update", scratch_path(spark, "stream"), _newest(["user_id", "concept", "day"]))
    return S.mastery(days).withColumn("mastery", F.bround("mastery", 6))


@query("""WITH e AS (SELECT 'u' || cast(user_id AS VARCHAR) AS fingerprint, ts, event_type = 'purchase' AS resolved FROM events WHERE event_type IN ('error', 'purchase')), h AS (SELECT fingerprint, ts FROM e WHERE NOT resolved),
s AS (SELECT fingerprint, count(*) AS n, min(ts) AS first_seen, max(ts) AS last_seen FROM h GROUP BY 1), r AS (SELECT fingerprint, count(*) AS n FROM e WHERE resolved AND ts > (SELECT min(ts) FROM h WHERE h.fingerprint = e.fingerprint) GROUP BY 1), l AS (SELECT fingerprint, max(ts) AS last_resolved, min(ts) AS first_resolved FROM e WHERE resolved AND ts > (SELECT min(ts) FROM h WHERE h.fingerprint = e.fingerprint) GROUP BY 1)
SELECT s.fingerprint, CASE WHEN last_resolved IS NULL THEN 'open' WHEN last_resolved > last_seen THEN 'resolved' ELSE 'reopened' END AS status, cast(s.n AS INTEGER) AS occurrences, first_seen, last_seen FROM s LEFT JOIN l USING (fingerprint)""")
def stream_issue_lifecycle(spark, sf):
    e = S.events_stream(spark, sf).where(F.col("event_type").isin("error", "purchase"))
    e = e.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("fingerprint"), "ts", (F.col("event_type") == "purchase").alias("resolved"))
    out = S.drained(S.issues(e), "update", scratch_path(spark, "stream"), _newest(["fingerprint"])).where("occurrences > 0")
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("first_seen", "last_seen")})


@query("SELECT user_id, count(DISTINCT event_type) AS kinds FROM events GROUP BY 1")
def stream_dedup(spark, sf):
    out = S.drained(S.deduplicated(S.events_stream(spark, sf), ["user_id", "event_type"], S.whole_span(spark, sf)), "append", scratch_path(spark, "stream"))
    return out.groupBy("user_id").agg(F.count(F.lit(1)).alias("kinds"))


@query("""SELECT room, count(*) AS n FROM (SELECT unnest(list_distinct(['global', 'user:' || cast(user_id AS VARCHAR), CASE WHEN event_type = 'error' THEN 'ops' END])) AS room FROM events) WHERE room IS NOT NULL GROUP BY 1""")
def stream_room_routing(spark, sf):
    rooms = [F.lit("global"), F.concat(F.lit("user:"), F.col("user_id").cast("string")), F.when(F.col("event_type") == "error", "ops")]
    out = S.drained(S.routed(S.events_stream(spark, sf).select("event_id", "user_id", "event_type"), rooms), "append", scratch_path(spark, "stream"))
    return out.groupBy("room").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH e AS (SELECT user_id, ts, event_id, event_type, ts - lag(ts) OVER w > INTERVAL 6 HOURS AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), g AS (SELECT *, count(*) FILTER (new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM e)
SELECT user_id, min(ts) AS started, max(ts) AS last_seen, max_by(event_type, (ts, event_id)) AS surface, count(*) AS events, max(ts) + INTERVAL 6 HOURS AS expired_at FROM g GROUP BY user_id, g HAVING date_trunc('millisecond', (SELECT max(ts) FROM events)) >= max(ts) + INTERVAL 6 HOURS""")
def stream_presence(spark, sf):
    """Times of activity that ended by a timer: six hours without an event of the user."""
    e = S.events_stream(spark, sf, None).select("ts", "event_id", "user_id", F.col("event_type").alias("surface"))
    out = X.drained_with_timers(X.presence(e, 6 * 3_600_000, "0 seconds"), scratch_path(spark, "stream"), S.drained)
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("started", "last_seen", "expired_at")})


@query("""WITH RECURSIVE ticks AS (SELECT unnest(generate_series(date_trunc('hour', (SELECT min(ts) FROM events)), date_trunc('millisecond', (SELECT max(ts) FROM events)), INTERVAL 1 HOUR)) AS tick),
seen AS (SELECT event_type AS metric, tick, value, value > 20 AS hit, row_number() OVER (PARTITION BY event_type, tick ORDER BY ts DESC, event_id DESC) AS back FROM ticks JOIN events ON ts >= tick - INTERVAL 6 HOURS AND ts < tick),
steps AS (SELECT metric, tick, count(*) = 3 AND bool_and(hit) AS breached, max_by(value, -back) AS value, row_number() OVER (PARTITION BY metric ORDER BY tick) AS i FROM seen WHERE back <= 3 GROUP BY metric, tick),
fold AS (SELECT metric, cast(0 AS BIGINT) AS i, cast(NULL AS TIMESTAMP) AS tick, false AS firing, cast(NULL AS TIMESTAMP) AS notified, cast(NULL AS VARCHAR) AS status, cast(NULL AS DOUBLE) AS value FROM (SELECT DISTINCT metric FROM steps)
UNION ALL SELECT s.metric, s.i, s.tick, s.breached, CASE WHEN s.breached AND (NOT f.firing OR s.tick - f.notified >= INTERVAL 12 HOURS) THEN s.tick ELSE f.notified END,
CASE WHEN s.breached AND (NOT f.firing OR s.tick - f.notified >= INTERVAL 12 HOURS) THEN 'firing' WHEN NOT s.breached AND f.firing THEN 'resolved' END, s.value FROM fold f JOIN steps s ON s.metric = f.metric AND s.i = f.i + 1)
SELECT metric, tick AS noticed_at, status, value FROM fold WHERE status IS NOT NULL""")
def stream_alerts(spark, sf):
    """Notices of each event type's values, evaluated every hour of event time over the last six hours by timers."""
    e = S.events_stream(spark, sf, None).select(F.col("event_type").alias("metric"), "ts", "event_id", "value", (F.col("value") > 20).alias("hit"))
    out = X.drained_with_timers(X.alerts(e, 6 * 3600, 3600, 3, 12 * 3600, "0 seconds"), scratch_path(spark, "stream"), S.drained)
    return out.withColumn("noticed_at", F.col("noticed_at").cast("timestamp_ntz"))


@query("""WITH c AS (SELECT event_id AS cached, ts AS valid_from, user_id FROM events WHERE event_type = 'view'), a AS (SELECT event_id AS asked, ts AS asked_at, user_id FROM events WHERE event_type = 'click'),
j AS (SELECT asked, asked_at, cached FROM a LEFT JOIN c ON a.user_id = c.user_id AND valid_from <= asked_at AND asked_at < valid_from + INTERVAL 6 HOURS), e AS (SELECT least((SELECT max(ts) FROM events WHERE event_type = 'view'), (SELECT max(ts) FROM events WHERE event_type = 'click')) AS t)
SELECT asked, count(cached) AS entries, max(cached) AS cached FROM j, e WHERE asked_at < t - INTERVAL 1 HOUR GROUP BY asked""")
def stream_validity_join(spark, sf):
    """Clicks joined with the views of six hours before them as two streams; clicks of the last hour may still wait."""
    e = S.events_stream(spark, sf, None)
    asked = e.where("event_type = 'click'").select("user_id", F.col("ts").alias("asked_at"), F.col("event_id").alias("asked"))
    cached = S.events_stream(spark, sf, None).where("event_type = 'view'").select("user_id", F.col("ts").alias("valid_from"), F.col("event_id").alias("cached"))
    out = S.drained(J.valid_at(asked, cached, "user_id", "6 HOURS", "0 seconds"), "append", scratch_path(spark, "stream"))
    newest = spark.read.parquet(f"{sf}/events.parquet").where("event_type IN ('view', 'click')").groupBy("event_type").agg(F.max("ts").alias("t")).agg(F.min("t").cast("timestamp").alias("t"))
    final = out.join(F.broadcast(newest), F.col("asked_at") < F.col("t") - F.expr("INTERVAL 1 HOUR"))
    return final.groupBy("asked").agg(F.count("cached").alias("entries"), F.max("cached").alias("cached"))


@query("""WITH w AS (SELECT user_id, date_trunc('week', ts)::DATE AS week, count(*) AS events, count(DISTINCT cast(json_extract_string(props, '$.k') AS INTEGER) % 10) AS concepts, round_even(sum(value), 2) AS total FROM events GROUP BY 1, 2)
SELECT * FROM w WHERE week + INTERVAL 8 DAYS <= (SELECT max(ts) FROM events) QUALIFY row_number() OVER (PARTITION BY week ORDER BY user_id) <= 500""")
def stream_closed_weeks(spark, sf):
    """The summary of every closed week, of 500 learners each, written by a job that runs again without effect."""
    root = scratch_path(spark, "weeks")
    for _ in range(2):
        e = S.events_stream(spark, sf).select("ts", "user_id", (F.get_json_object("props", "$.k").cast("int") % 10).alias("concept"), "value")
        K.write_closed_weeks(e, root)
    return K.summaries(spark, root)
