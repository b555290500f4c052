"""Metric rollups, error groups, anomalies, alerts and activity over the events stream.

Event types are metric keys, value is a duration in milliseconds, and the number in props names the service.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import relational as R
from ..operators import windows as W
from ..sources.tables import AS_OF, table
from ._registry import query

_K = "cast(json_extract_string(props, '$.k') AS INTEGER)"


def _k():
    return F.get_json_object("props", "$.k").cast("int")


@query("""SELECT date_trunc('hour', ts) AS bucket, event_type AS metric_key, count(*) AS n, round_even(sum(value), 2) AS total, min(value) AS lo, max(value) AS hi, round_even(avg(value), 7) AS p50, max(value) AS p95, max(value) AS p99 FROM events GROUP BY 1, 2""")
def hour_rollup_parity(spark, sf):
    """Rollup with the running mean and maximum in the place of percentiles, as the dashboards expect them."""
    g = table(spark, sf, "events").groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("bucket"), F.col("event_type").alias("metric_key"))
    top = F.max("value")
    return g.agg(F.count(F.lit(1)).alias("n"), F.bround(F.sum("value"), 2).alias("total"), F.min("value").alias("lo"), top.alias("hi"), F.bround(F.avg("value"), 7).alias("p50"), top.alias("p95"), top.alias("p99"))


@query("""SELECT date_trunc('day', ts) AS bucket, event_type AS metric_key, count(*) AS n, round_even(quantile_cont(value, 0.5), 4) AS p50, round_even(quantile_cont(value, 0.95), 4) AS p95, round_even(quantile_cont(value, 0.99), 4) AS p99 FROM events GROUP BY 1, 2""")
def day_rollup_exact(spark, sf):
    g = table(spark, sf, "events").groupBy(F.date_trunc("day", "ts").cast("timestamp_ntz").alias("bucket"), F.col("event_type").alias("metric_key"))
    return g.agg(F.count(F.lit(1)).alias("n"), *[F.bround(F.percentile("value", p), 4).alias(f"p{round(p * 100)}") for p in (0.5, 0.95, 0.99)])


_NORM = "substring(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim({0})), '[0-9a-f]{{8}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{12}}', '<uuid>', 'g'), '\\b[0-9a-f]{{16,}}\\b', '<id>', 'g'), '\\b[0-9]+\\b', '<n>', 'g'), '\\s+', ' ', 'g'), 1, 400)"


@query(f"""WITH e AS (SELECT event_id, ts, user_id, substring(sha256(concat_ws('|', {_NORM.format("event_type || ' failed for user ' || cast(user_id AS VARCHAR) || ' in 0123456789abcdef0'")}, {_NORM.format("props")}, 'svc' || cast({_K} % 3 AS VARCHAR), 'production')), 1, 40) AS fingerprint FROM events WHERE event_type = 'error')
SELECT fingerprint, count(*) AS occurrences, min(ts) AS first_seen, max(ts) AS last_seen, count(user_id) AS affected_events, count(DISTINCT user_id) AS affected_users FROM e GROUP BY 1""")
def error_fingerprint_groups(spark, sf):
    e = table(spark, sf, "events").where("event_type = 'error'")
    title = F.concat(F.col("event_type"), F.lit(" failed for user "), F.col("user_id").cast("string"), F.lit(" in 0123456789abcdef0"))
    fp = T.error_fingerprint(title, F.col("props"), F.concat(F.lit("SVC"), (_k() % 3).cast("string")), F.lit(None).cast("string"))
    return e.groupBy(fp.alias("fingerprint")).agg(F.count(F.lit(1)).alias("occurrences"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.count("user_id").alias("affected_events"), F.count_distinct("user_id").alias("affected_users"))


@query("""WITH a AS (SELECT count(*) AS requests, count(*) FILTER (event_type = 'error') AS errors, avg(value) AS latency, count(DISTINCT user_id) AS users FROM events WHERE ts >= TIMESTAMP '2024-01-30' AND ts < TIMESTAMP '2024-01-31')
SELECT requests, errors, users, round_even(latency, 7) AS mean_ms, round_even(CASE WHEN requests > 0 THEN errors / requests END, 6) AS error_rate, round_even(CASE WHEN requests > 0 THEN 1 - errors / requests END, 6) AS success_rate,
CASE WHEN requests > 0 AND errors / requests >= 0.5 THEN 'critical' WHEN requests > 0 AND errors / requests >= 0.1 THEN 'degraded' ELSE 'healthy' END AS status FROM a""")
def overview_dashboard(spark, sf):
    day = (F.col("ts") >= F.expr(f"TIMESTAMP_NTZ'{AS_OF}' - INTERVAL 1 DAY")) & (F.col("ts") < F.expr(f"TIMESTAMP_NTZ'{AS_OF}'"))
    a = table(spark, sf, "events").where(day).agg(F.count(F.lit(1)).alias("requests"), F.count_if(F.col("event_type") == "error").alias("errors"), F.avg("value").alias("latency"), F.count_distinct("user_id").alias("users"))
    rate = F.try_divide("errors", "requests")
    status = F.when(rate >= 0.5, "critical").when(rate >= 0.1, "degraded").otherwise("healthy")
    return a.select("requests", "errors", "users", F.bround("latency", 7).alias("mean_ms"), F.bround(rate, 6).alias("error_rate"), F.bround(1 - rate, 6).alias("success_rate"), status.alias("status"))


@query("SELECT event_id, event_type, value FROM events WHERE value >= 20 ORDER BY value DESC, event_id LIMIT 20")
def slow_requests_topk(spark, sf):
    return table(spark, sf, "events").where("value >= 20").orderBy(F.col("value").desc(), "event_id").limit(20).select("event_id", "event_type", "value")


@query("SELECT event_id, ts, event_type FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-20' AND event_type = 'error' AND (props ILIKE '%\"k\": 1%' OR event_type ILIKE '%\"k\": 1%') ORDER BY ts DESC, event_id LIMIT 100")
def log_search_ilike(spark, sf):
    at = lambda d: F.expr(f"TIMESTAMP_NTZ'{d} 00:00:00'")
    rows = R.filtered(table(spark, sf, "events"), F.col("ts") >= at("2024-01-10"), F.col("ts") < at("2024-01-20"), F.col("event_type") == "error", R.any_like([F.col("props"), F.col("event_type")], '"k": 1'))
    return rows.orderBy(F.col("ts").desc(), "event_id").limit(100).select("event_id", "ts", "event_type")


def _daily(spark, sf, keys):
    days = table(spark, sf, "events").groupBy(*keys, F.to_date("ts").alias("d")).agg(F.avg("value").alias("v"))
    return days.groupBy(*keys).agg(W.ordered_list("v", "d").alias("vals"))


@query("""WITH RECURSIVE d AS (SELECT event_type, cast(ts AS DATE) AS d, avg(value) AS v FROM events GROUP BY 1, 2), o AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY d) AS i, count(*) OVER (PARTITION BY event_type) AS n FROM d),
f AS (SELECT event_type, i, v, n, v AS e FROM o WHERE i = 1 UNION ALL SELECT o.event_type, o.i, o.v, o.n, 0.3 * o.v + (1 - 0.3) * f.e FROM f JOIN o ON o.event_type = f.event_type AND o.i = f.i + 1),
m AS (SELECT event_type, median(abs(v - e)) AS m FROM f WHERE i > 1 GROUP BY 1), s AS (SELECT event_type, e, abs(v - e) / (1.4826 * coalesce(nullif(m, 0), 1e-6)) AS score FROM f JOIN m USING (event_type) WHERE i = n AND n >= 5)
SELECT event_type, round_even(e, 6) AS ewma, round_even(score, 6) AS score, score >= 3 AS anomaly FROM s""")
def ewma_anomaly(spark, sf):
    x = _daily(spark, sf, ["event_type"]).withColumn("x", W.ewma(F.col("vals")))
    return x.where("x.ewma IS NOT NULL").select("event_type", F.bround("x.ewma", 6).alias("ewma"), F.bround("x.score", 6).alias("score"), F.col("x.anomaly").alias("anomaly"))


@query("""WITH d AS (SELECT user_id, cast(ts AS DATE) AS d, avg(value) AS v FROM events GROUP BY 1, 2), m AS (SELECT user_id, median(v) AS m, count(*) AS n, max_by(v, d) AS last FROM d GROUP BY 1),
x AS (SELECT user_id, any_value(last) AS last, any_value(m) AS m, coalesce(nullif(median(abs(v - m)), 0), 1e-6) AS mad, any_value(n) AS n FROM d JOIN m USING (user_id) GROUP BY 1)
SELECT user_id, round_even(abs(last - m) / (1.4826 * mad), 4) AS score, abs(last - m) / (1.4826 * mad) >= 3.5 AS anomaly FROM x WHERE n >= 5""")
def mad_anomaly(spark, sf):
    x = _daily(spark, sf, ["user_id"]).withColumn("x", W.mad(F.col("vals"))).where(F.size("vals") >= 5)
    return x.select("user_id", F.bround("x.score", 4).alias("score"), F.col("x.anomaly").alias("anomaly"))


@query("""WITH r(rule, metric, comparator, threshold, need) AS (VALUES (1, 'error', 'gt', 9.0, 2), (2, 'view', 'lt', 11.0, 3), (3, 'click', 'eq', 10.0, 1), (4, 'signup', 'gte', 8.0, 2), (5, 'purchase', 'odd', 1.0, 1)),
d AS (SELECT event_type, cast(ts AS DATE) AS d, avg(value) AS v FROM events WHERE ts >= TIMESTAMP '2024-01-17' GROUP BY 1, 2),
b AS (SELECT rule, d, need, CASE comparator WHEN 'gt' THEN v > threshold WHEN 'gte' THEN v >= threshold WHEN 'lt' THEN v < threshold WHEN 'lte' THEN v <= threshold WHEN 'eq' THEN abs(v - threshold) < 1e-9 ELSE false END AS hit, row_number() OVER (PARTITION BY rule ORDER BY d DESC) AS back FROM r JOIN d ON metric = event_type)
SELECT rule, count(*) FILTER (back <= need) >= any_value(need) AND bool_and(hit) FILTER (back <= need) AS breached FROM b GROUP BY rule""")
def alert_consecutive(spark, sf):
    rules = spark.createDataFrame([(1, "error", "gt", 9.0, 2), (2, "view", "lt", 11.0, 3), (3, "click", "eq", 10.0, 1), (4, "signup", "gte", 8.0, 2), (5, "purchase", "odd", 1.0, 1)], "rule int, event_type string, comparator string, threshold double, need int")
    days = table(spark, sf, "events").where(F.col("ts") >= F.expr(f"TIMESTAMP_NTZ'{AS_OF}' - INTERVAL 14 DAYS")).groupBy("event_type", F.to_date("ts").alias("d")).agg(F.avg("value").alias("v"))
    flags = days.join(F.broadcast(rules), "event_type").withColumn("hit", W.compared(F.col("v"), F.col("comparator"), F.col("threshold")))
    lists = flags.groupBy("rule", "need").agg(W.ordered_list("hit", "d").alias("flags"))
    last = F.when(F.size("flags") >= F.col("need"), F.forall(F.slice("flags", -F.col("need"), F.col("need")), lambda x: x)).otherwise(F.lit(False))
    return lists.select("rule", last.alias("breached"))


@query("""WITH x AS (SELECT user_id, max(ts) AS last_at, max_by(event_type, (ts, event_id)) AS surface FROM events GROUP BY 1)
SELECT surface, count(*) AS users, max(last_at) AS newest FROM x WHERE last_at >= TIMESTAMP '2024-01-31' - INTERVAL 12 HOURS GROUP BY 1""")
def active_recently(spark, sf):
    last = R.latest(table(spark, sf, "events").select("user_id", "ts", "event_id", "event_type"), ["user_id"], ["ts", "event_id"])
    live = last.where(F.col("ts") >= F.expr(f"TIMESTAMP_NTZ'{AS_OF}' - INTERVAL 12 HOURS"))
    return live.groupBy(F.col("event_type").alias("surface")).agg(F.count(F.lit(1)).alias("users"), F.max("ts").alias("newest"))


@query("""WITH h AS (SELECT date_trunc('hour', ts) AS b, event_type, max(value) AS p95, avg(value) AS p50 FROM events GROUP BY 1, 2) SELECT event_type, round_even(avg(p95), 7) AS mean_p95, round_even(avg(p50), 6) AS mean_p50, max_by(round_even(p50, 7), b) AS last_p50 FROM h GROUP BY 1""")
def mean_of_percentiles(spark, sf):
    h = table(spark, sf, "events").groupBy(F.date_trunc("hour", "ts").alias("b"), "event_type").agg(F.max("value").alias("p95"), F.avg("value").alias("p50"))
    return h.groupBy("event_type").agg(F.bround(F.avg("p95"), 7).alias("mean_p95"), F.bround(F.avg("p50"), 6).alias("mean_p50"), F.max_by(F.bround("p50", 7), "b").alias("last_p50"))


@query("""WITH RECURSIVE e AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, ts FROM events WHERE event_type IN ('error', 'purchase')),
f AS (SELECT user_id, i, ts, CASE WHEN event_type = 'error' THEN 'firing' ELSE 'ok' END AS state, CASE WHEN event_type = 'error' THEN ts END AS notified, cast(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS INTEGER) AS sent, 0 AS resolved FROM e WHERE i = 1
UNION ALL SELECT e.user_id, e.i, e.ts, CASE WHEN event_type = 'error' THEN 'firing' ELSE 'ok' END, CASE WHEN event_type = 'error' AND (state = 'ok' OR e.ts - notified >= INTERVAL 24 HOURS) THEN e.ts ELSE notified END,
sent + CASE WHEN event_type = 'error' AND (state = 'ok' OR e.ts - notified >= INTERVAL 24 HOURS) THEN 1 ELSE 0 END, resolved + CASE WHEN event_type <> 'error' AND state = 'firing' THEN 1 ELSE 0 END FROM f JOIN e ON e.user_id = f.user_id AND e.i = f.i + 1)
SELECT user_id, max_by(state, i) AS state, max_by(notified, i) AS last_notified, cast(max(sent) AS INTEGER) AS sent, cast(max(resolved) AS INTEGER) AS resolved FROM f GROUP BY 1""")
def alert_state_machine(spark, sf):
    """Fire, cooldown and resolve, folded over each key's ordered events: errors breach, purchases recover."""
    from ..streaming.alerts import fold_alerts

    e = table(spark, sf, "events").where(F.col("event_type").isin("error", "purchase")).select("user_id", "ts", "event_id", (F.col("event_type") == "error").alias("breached"))
    return fold_alerts(e, ["user_id"], ["ts", "event_id"], "breached", cooldown_seconds=86_400)
