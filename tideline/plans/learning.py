"""Ordered learner state over the events stream, and the concept graph.

A learner is a user, a concept the number in an event's props; event types stand for kinds of evidence.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import learning as L
from ..functions import text as T
from ..operators import graph as G
from ..operators import windows as W
from ..sources.tables import table
from ._registry import query

_W = "CASE event_type WHEN 'purchase' THEN 0.15 WHEN 'error' THEN -0.12 WHEN 'click' THEN 0.10 WHEN 'view' THEN -0.05 WHEN 'signup' THEN 0.12 ELSE 0 END"
_C = "cast(json_extract_string(props, '$.k') AS INTEGER) % 10"


def _events(spark, sf):
    concept = (F.get_json_object("props", "$.k").cast("int") % 10).alias("concept")
    return table(spark, sf, "events").select("event_id", "ts", "user_id", "event_type", "value", concept, L.evidence_weight(F.col("event_type")).alias("w"))


def mastery_table(events):
    """user_id, concept, mastery and evidence: the clamped fold of each learner's evidence on each concept.

    Each day folds by itself to three numbers, and the days of a history merge in their order, so no row holds a history
    and the days of one key fold in as many tasks."""
    days = events.groupBy("user_id", "concept", F.to_date("ts").alias("day")).agg(L.clamped_sum(W.ordered_list("w", "ts", "event_id")).alias("sum"), F.count(F.lit(1)).alias("n"))
    g = days.groupBy("user_id", "concept").agg(L.merged_sums(W.ordered_list("sum", "day")).alias("total"), F.sum("n").cast("int").alias("evidence"))
    return g.select("user_id", "concept", L.applied(F.col("total")).alias("mastery"), "evidence")


_MASTERY = f"""e AS (SELECT user_id, {_C} AS concept, cast({_W} AS DOUBLE) AS w, row_number() OVER (PARTITION BY user_id, {_C} ORDER BY ts, event_id) AS i FROM events),
f AS (SELECT user_id, concept, i, round_even(greatest(0.0, least(1.0, 0.5 + w)), 12) AS m FROM e WHERE i = 1 UNION ALL SELECT e.user_id, e.concept, e.i, round_even(greatest(0.0, least(1.0, m + w)), 12) FROM f JOIN e ON e.user_id = f.user_id AND e.concept = f.concept AND e.i = f.i + 1),
mastery AS (SELECT user_id, concept, max_by(m, i) AS mastery, max(i) AS evidence FROM f GROUP BY 1, 2)"""


@query(f"WITH RECURSIVE {_MASTERY} SELECT user_id, concept, round_even(mastery, 6) AS mastery, cast(evidence AS INTEGER) AS evidence FROM mastery")
def mastery_fold(spark, sf):
    return mastery_table(_events(spark, sf)).withColumn("mastery", F.bround("mastery", 6))


@query("""WITH RECURSIVE e AS (SELECT user_id, least(1.0, value / 20.0) AS s, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS i FROM events),
f AS (SELECT user_id, i, 0.5 * (1 - 0.2) + s * 0.2 AS c FROM e WHERE i = 1 UNION ALL SELECT e.user_id, e.i, c * (1 - 0.2) + s * 0.2 FROM f JOIN e ON e.user_id = f.user_id AND e.i = f.i + 1 AND e.i <= 20)
SELECT user_id, round_even(max_by(c, i), 6) AS confidence FROM f GROUP BY 1""")
def confidence_ema(spark, sf):
    """The newest twenty signals, folded from the newest on, so that the newest weighs least."""
    recent = _events(spark, sf).withColumn("r", F.row_number().over(Window.partitionBy("user_id").orderBy(F.col("ts").desc(), F.col("event_id").desc()))).where("r <= 20")
    g = recent.withColumn("s", F.least(F.lit(1.0), F.col("value") / 20.0)).groupBy("user_id").agg(W.ordered_list("s", "r").alias("s"))
    return g.select("user_id", F.bround(L.confidence_fold(F.col("s")), 6).alias("confidence"))


@query("""WITH r AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events),
s AS (SELECT user_id, sum(CASE WHEN event_type = 'click' THEN 1.0 ELSE 0 END) AS conversation, sum(CASE WHEN event_type = 'view' THEN 1.5 ELSE 0 END) AS visual, sum(CASE WHEN event_type = 'purchase' THEN 1.3 ELSE 0 END) AS practice FROM r WHERE r <= 200 GROUP BY 1),
n AS (SELECT *, coalesce(nullif(conversation + visual + practice, 0), 1) AS t FROM s)
SELECT user_id, round_even(conversation / t, 3) AS conversation, round_even(visual / t, 3) AS visual, round_even(practice / t, 3) AS practice,
CASE WHEN greatest(round_even(conversation / t, 3), round_even(visual / t, 3), round_even(practice / t, 3)) < 0.15 THEN 'balanced' WHEN round_even(conversation / t, 3) >= greatest(round_even(visual / t, 3), round_even(practice / t, 3)) THEN 'conversation' WHEN round_even(visual / t, 3) >= round_even(practice / t, 3) THEN 'visual' ELSE 'practice' END AS dominant FROM n""")
def style_mix(spark, sf):
    recent = _events(spark, sf).withColumn("r", F.row_number().over(Window.partitionBy("user_id").orderBy(F.col("ts").desc(), F.col("event_id").desc()))).where("r <= 200")
    add = lambda kind, w: F.sum(F.when(F.col("event_type") == kind, w).otherwise(0.0))
    s = recent.groupBy("user_id").agg(add("click", 1.0).alias("conversation"), add("view", 1.5).alias("visual"), add("purchase", 1.3).alias("practice"))
    total = F.coalesce(F.nullif(F.col("conversation") + F.col("visual") + F.col("practice"), F.lit(0.0)), F.lit(1.0))
    n = s.select("user_id", *[F.bround(F.col(c) / total, 3).alias(c) for c in ("conversation", "visual", "practice")])
    best = F.greatest("conversation", "visual", "practice")
    style = F.when(best < 0.15, "balanced").when(F.col("conversation") == best, "conversation").when(F.col("visual") == best, "visual").otherwise("practice")
    return n.withColumn("dominant", style)


@query("""WITH o AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i FROM events)
SELECT user_id, round_even(coalesce(regr_slope(value, i) FILTER (i < 200), 0), 6) AS slope, count(*) AS n FROM o GROUP BY 1""")
def trend_slope(spark, sf):
    """Least-squares slope of each learner's first two hundred values over their position."""
    o = _events(spark, sf).withColumn("i", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1)
    used = F.when(F.col("i") < 200, F.col("value"))
    return o.groupBy("user_id").agg(F.bround(F.coalesce(F.regr_slope(used, F.col("i").cast("double")), F.lit(0.0)), 6).alias("slope"), F.count(F.lit(1)).alias("n"))


@query(f"""WITH RECURSIVE {_MASTERY}, m AS (SELECT user_id, round_even(avg(mastery), 9) AS m FROM mastery GROUP BY 1), s AS (SELECT user_id, round_even(least(1e0, avg(value) / 20e0), 9) AS c, greatest(0.0, least(1e0, count(*) FILTER (ts >= TIMESTAMP '2024-01-24') / 7e0 / 20e0)) AS e, count(*) FILTER (event_type = 'error') / count(*) AS r FROM events GROUP BY 1),
x AS (SELECT user_id, m, c, e, greatest(0.0, least(1.0, (1 - m) * 0.35e0 + (1 - c) * 0.25e0 + (1 - e) * 0.25e0 + r * 0.15e0)) AS risk FROM m JOIN s USING (user_id))
SELECT user_id, round_even(risk, 6) AS risk, CASE WHEN risk >= 0.65 THEN 'high' WHEN risk >= 0.4 THEN 'medium' ELSE 'low' END AS level, CASE WHEN m < 0.45 OR c < 0.4 THEN 'below_level' WHEN m >= 0.75 AND c >= 0.7 THEN 'above_level' ELSE 'on_level' END AS advice FROM x""")
def risk_score(spark, sf):
    events = _events(spark, sf)
    m = mastery_table(events).groupBy("user_id").agg(F.bround(F.avg("mastery"), 9).alias("m"))
    recent = F.count_if(F.col("ts") >= F.expr("TIMESTAMP_NTZ'2024-01-24 00:00:00'"))
    s = events.groupBy("user_id").agg(F.bround(F.least(F.lit(1.0), F.avg("value") / 20.0), 9).alias("c"), L.engagement(recent).alias("e"), (F.count_if(F.col("event_type") == "error") / F.count(F.lit(1))).alias("r"))
    x = m.join(s, "user_id").withColumn("x", L.risk_score(F.col("m"), F.col("c"), F.col("e"), F.col("r")))
    return x.select("user_id", F.bround("x", 6).alias("risk"), L.risk_level(F.col("x")).alias("level"), L.difficulty_advice(F.col("m"), F.col("c")).alias("advice"))


@query(f"""WITH RECURSIVE {_MASTERY}, m AS (SELECT user_id, avg(mastery) AS m FROM mastery GROUP BY 1), d AS (SELECT user_id, cast(ts AS DATE) AS d, avg(value) AS v FROM events GROUP BY 1, 2),
o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY d) - 1 AS i FROM d), t AS (SELECT user_id, coalesce(regr_slope(v, i), 0) AS s FROM o GROUP BY 1)
SELECT user_id, round_even(greatest(0.0, least(1.0, m + greatest(s, 0.0) * 0.15 - greatest(-s, 0.0) * 0.10)), 3) AS forecast FROM m JOIN t USING (user_id)""")
def forecast_7d(spark, sf):
    events = _events(spark, sf)
    m = mastery_table(events).groupBy("user_id").agg(F.avg("mastery").alias("m"))
    days = events.groupBy("user_id", F.to_date("ts").alias("d")).agg(F.avg("value").alias("v"))
    o = days.withColumn("i", F.row_number().over(Window.partitionBy("user_id").orderBy("d")) - 1)
    t = o.groupBy("user_id").agg(F.coalesce(F.regr_slope("v", F.col("i").cast("double")), F.lit(0.0)).alias("s"))
    up = lambda c: F.greatest(c, F.lit(0.0))
    return m.join(t, "user_id").select("user_id", L.forecast(F.col("m"), up(F.col("s")), up(-F.col("s"))).alias("forecast"))


@query(f"""WITH RECURSIVE {_MASTERY}, g AS (SELECT d.user_id, d.concept, d.mastery, d.concept - 1 AS pre, coalesce(p.mastery, 0) AS pre_mastery FROM mastery d LEFT JOIN mastery p ON p.user_id = d.user_id AND p.concept = d.concept - 1)
SELECT user_id, concept, CASE WHEN mastery >= 0.7 AND evidence_low THEN 'surface_memorization' WHEN concept > 0 AND pre_mastery < 0.5 THEN 'missing_prerequisite' ELSE 'incomplete' END AS gap
FROM (SELECT g.*, m.evidence < 3 AS evidence_low FROM g JOIN mastery m USING (user_id, concept)) WHERE (mastery >= 0.7 AND evidence_low) OR (concept > 0 AND pre_mastery < 0.5) OR mastery < 0.5""")
def knowledge_gaps(spark, sf):
    m = mastery_table(_events(spark, sf))
    before = m.select("user_id", (F.col("concept") + 1).alias("concept"), F.col("mastery").alias("pre"))
    x = m.join(before, ["user_id", "concept"], "left").withColumn("pre", F.coalesce("pre", F.lit(0.0)))
    shallow, missing = (F.col("mastery") >= 0.7) & (F.col("evidence") < 3), (F.col("concept") > 0) & (F.col("pre") < 0.5)
    gap = F.when(shallow, "surface_memorization").when(missing, "missing_prerequisite").when(F.col("mastery") < 0.5, "incomplete")
    return x.withColumn("gap", gap).where("gap IS NOT NULL").select("user_id", "concept", "gap")


@query(f"SELECT user_id, {_C} AS concept, count(*) AS n, round_even(least(0.95e0, 0.5e0 + (count(*) - 1) * 0.08e0), 4) AS confidence FROM events WHERE event_type = 'error' GROUP BY 1, 2")
def misconception_counts(spark, sf):
    g = _events(spark, sf).where("event_type = 'error'").groupBy("user_id", "concept").agg(F.count(F.lit(1)).alias("n"))
    return g.withColumn("confidence", F.bround(L.misconception_confidence(F.col("n")), 4))


@query(f"""WITH g AS (SELECT user_id, {_C} AS method, count(*) FILTER (event_type = 'purchase') AS good, count(*) FILTER (event_type = 'error') AS bad FROM events GROUP BY 1, 2),
t AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY good DESC, method) AS rank FROM g) SELECT user_id, method, good, bad, cast(rank AS INTEGER) AS rank FROM t WHERE rank <= 3 AND good > bad""")
def teaching_methods_topk(spark, sf):
    """The three most successful methods first, of these the ones that succeed more often than they fail."""
    g = _events(spark, sf).groupBy("user_id", F.col("concept").alias("method")).agg(F.count_if(F.col("event_type") == "purchase").alias("good"), F.count_if(F.col("event_type") == "error").alias("bad"))
    rank = F.row_number().over(Window.partitionBy("user_id").orderBy(F.col("good").desc(), "method"))
    return g.withColumn("rank", rank).where("rank <= 3").where("good > bad")


@query(f"""WITH r AS (SELECT user_id, {_C} AS c, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events), g AS (SELECT user_id, c FROM r WHERE r <= 300 AND event_type = 'signup' GROUP BY 1, 2 HAVING count(*) > 1)
SELECT user_id, count(*) AS revised, count(*) >= 2 AS prefers_revision FROM g GROUP BY 1""")
def revision_behaviour(spark, sf):
    recent = _events(spark, sf).withColumn("r", F.row_number().over(Window.partitionBy("user_id").orderBy(F.col("ts").desc(), F.col("event_id").desc()))).where("r <= 300 AND event_type = 'signup'")
    g = recent.groupBy("user_id", "concept").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return g.groupBy("user_id").agg(F.count(F.lit(1)).alias("revised")).withColumn("prefers_revision", F.col("revised") >= 2)


@query("""WITH d AS (SELECT DISTINCT user_id, cast(ts AS DATE) AS d FROM events), i AS (SELECT user_id, d, d - cast(row_number() OVER (PARTITION BY user_id ORDER BY d) AS INTEGER) AS g FROM d),
r AS (SELECT user_id, g, count(*) AS n, max(d) AS last FROM i GROUP BY 1, 2), x AS (SELECT user_id, max(n) AS longest, max(last) AS last_day, max_by(n, last) AS n FROM r GROUP BY 1)
SELECT user_id, cast(CASE WHEN last_day >= DATE '2024-01-30' THEN n ELSE 0 END AS INTEGER) AS current, cast(longest AS INTEGER) AS longest, last_day FROM x""")
def study_streaks(spark, sf):
    days = table(spark, sf, "events").select("user_id", F.to_date("ts").alias("d"))
    return W.streaks(days, "user_id", "d", "2024-01-31")


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) > INTERVAL 6 HOURS THEN 1 ELSE 0 END AS new FROM events),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM g)
SELECT user_id, min(ts) AS started, count(*) AS n, cast(least(14400, greatest(0, date_diff('microsecond', min(ts), max(ts)) // 1000000)) AS BIGINT) AS seconds FROM s GROUP BY user_id, s""")
def study_sessions_window(spark, sf):
    """Sessions end after six idle hours; their length is capped at four hours."""
    s = table(spark, sf, "events").groupBy("user_id", F.session_window("ts", "6 hours 1 microsecond")).agg(F.min("ts").alias("started"), F.max("ts").alias("ended"), F.count(F.lit(1)).alias("n"))
    micros = F.unix_micros(F.col("ended").cast("timestamp")) - F.unix_micros(F.col("started").cast("timestamp"))
    return s.select("user_id", "started", "n", F.least(F.lit(14400), F.greatest(F.lit(0), F.floor(micros / 1_000_000))).cast("long").alias("seconds"))


@query(f"""SELECT user_id, date_trunc('week', ts)::DATE AS week, count(*) AS events, count(DISTINCT {_C}) AS concepts, round_even(sum(value), 2) AS total FROM events GROUP BY 1, 2""")
def period_summary(spark, sf):
    g = _events(spark, sf).groupBy("user_id", F.date_trunc("week", "ts").cast("date").alias("week"))
    return g.agg(F.count(F.lit(1)).alias("events"), F.count_distinct("concept").alias("concepts"), F.bround(F.sum("value"), 2).alias("total"))


@query("""WITH x AS (SELECT cast(value AS DOUBLE) AS v, floor((epoch_us(TIMESTAMP '2024-01-31') - 1 - epoch_us(ts)) / 604800000000.0) AS k FROM events), w AS (SELECT k, avg(v) AS m FROM x WHERE k BETWEEN 0 AND 4 GROUP BY 1)
SELECT cast(TIMESTAMP '2024-01-31' - s.k * INTERVAL 7 DAYS AS DATE) AS week_end, round_even(coalesce(last_value(m IGNORE NULLS) OVER (ORDER BY s.k DESC), 0), 4) AS mean FROM range(5) s(k) LEFT JOIN w ON w.k = s.k""")
def completion_trend_locf(spark, sf):
    return W.locf_weeks(table(spark, sf, "events"), "ts", "value", "2024-01-31 00:00:00").withColumn("mean", F.bround("mean", 4))


@query("""WITH w AS (SELECT user_id, avg(value) FILTER (ts >= TIMESTAMP '2024-01-24') AS now, avg(value) FILTER (ts >= TIMESTAMP '2024-01-17' AND ts < TIMESTAMP '2024-01-24') AS before FROM events GROUP BY 1)
SELECT user_id, round_even(abs(coalesce(now, before, 0) - coalesce(before, now, 0)), 4) AS change, CASE WHEN coalesce(now, before, 0) >= coalesce(before, now, 0) THEN 'up' ELSE 'down' END AS direction FROM w""")
def health_trend_lag(spark, sf):
    day = lambda d: F.expr(f"TIMESTAMP_NTZ'{d} 00:00:00'")
    mean = lambda p: F.avg(F.when(p, F.col("value")))
    w = table(spark, sf, "events").groupBy("user_id").agg(mean(F.col("ts") >= day("2024-01-24")).alias("now"), mean((F.col("ts") >= day("2024-01-17")) & (F.col("ts") < day("2024-01-24"))).alias("before"))
    now, before = F.coalesce("now", "before", F.lit(0.0)), F.coalesce("before", "now", F.lit(0.0))
    return w.select("user_id", F.bround(F.abs(now - before), 4).alias("change"), F.when(now >= before, "up").otherwise("down").alias("direction"))


@query("""WITH c AS (SELECT p_brand, p_partkey, trim(both '_' from regexp_replace(lower(p_brand || '|' || cast(p_partkey AS VARCHAR)), '[^a-z0-9]+', '_', 'g')) AS key FROM part),
l AS (SELECT lag(key) OVER (PARTITION BY p_brand ORDER BY p_partkey) AS prerequisite, key AS dependent FROM c) SELECT DISTINCT prerequisite, dependent FROM l WHERE prerequisite IS NOT NULL AND prerequisite <> dependent""")
def concept_edges_lag(spark, sf):
    return _edges(spark, sf)


def _edges(spark, sf):
    c = table(spark, sf, "part").select("p_brand", "p_partkey", T.slug(F.concat_ws("|", "p_brand", F.col("p_partkey").cast("string"))).alias("key"))
    return G.chain_edges(c, ["p_brand"], ["p_partkey"], "key")


@query("""WITH RECURSIVE c AS (SELECT p_brand, p_partkey, trim(both '_' from regexp_replace(lower(p_brand || '|' || cast(p_partkey AS VARCHAR)), '[^a-z0-9]+', '_', 'g')) AS key FROM part),
e AS (SELECT lag(key) OVER (PARTITION BY p_brand ORDER BY p_partkey) AS p, key AS d FROM c), up AS (SELECT d AS concept, p AS prerequisite, 1 AS depth FROM e WHERE p IS NOT NULL UNION ALL SELECT up.concept, e.p, depth + 1 FROM up JOIN e ON e.d = up.prerequisite WHERE depth < 4 AND e.p IS NOT NULL)
SELECT concept, prerequisite, cast(min(depth) AS INTEGER) AS depth FROM up GROUP BY 1, 2""")
def transitive_prereqs(spark, sf):
    return G.ancestors(_edges(spark, sf), 4)


@query(f"""WITH RECURSIVE {_MASTERY}, c AS (SELECT {_C} AS k, min((ts, event_id)) AS first FROM events GROUP BY 1), ed AS (SELECT lag(k) OVER (ORDER BY first) AS p, k AS d FROM c), s AS (SELECT DISTINCT user_id, concept FROM mastery)
SELECT s.user_id, s.concept, ed.p AS prerequisite FROM s JOIN ed ON ed.d = s.concept LEFT JOIN mastery m ON m.user_id = s.user_id AND m.concept = ed.p WHERE ed.p IS NOT NULL AND coalesce(m.mastery, 0) < 0.5""")
def direct_gaps(spark, sf):
    """Weak or missing direct prerequisites; a concept follows the one that was first met before it."""
    events = _events(spark, sf)
    met = events.groupBy("concept").agg(F.min(F.struct("ts", "event_id")).alias("first")).withColumn("all", F.lit(1))  # a row for each concept
    edges = G.chain_edges(met, ["all"], ["first"], "concept").withColumnRenamed("dependent", "concept")
    return G.weak_prerequisites(mastery_table(events).select("user_id", "concept", "mastery"), edges, 0.5)


@query("""WITH RECURSIVE e AS (SELECT DISTINCT n_regionkey AS p, n_nationkey + 100 AS d FROM nation UNION SELECT n_nationkey + 100, n_nationkey % 7 + 200 FROM nation), l AS (SELECT DISTINCT p AS node, 0 AS level FROM e WHERE p NOT IN (SELECT d FROM e) UNION ALL SELECT e.d, level + 1 FROM l JOIN e ON e.p = l.node)
SELECT node, cast(max(level) AS INTEGER) AS level FROM l GROUP BY 1""")
def topo_order(spark, sf):
    n = table(spark, sf, "nation")
    a = n.select(F.col("n_regionkey").alias("prerequisite"), (F.col("n_nationkey") + 100).alias("dependent"))
    b = n.select((F.col("n_nationkey") + 100).alias("prerequisite"), (F.col("n_nationkey") % 7 + 200).alias("dependent"))
    return G.topological_levels(a.union(b))


@query("""WITH w AS (SELECT c_custkey AS k, c_acctbal AS a, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_acctbal / 2 END AS b, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_acctbal * 2 END AS c FROM customer)
SELECT k, round_even((0.5 * a + coalesce(0.3 * b, 0) + coalesce(0.2 * c, 0)) / (0.5 + CASE WHEN b IS NULL THEN 0 ELSE 0.3 END + CASE WHEN c IS NULL THEN 0 ELSE 0.2 END), 6) AS score FROM w""")
def scorecard_weighted(spark, sf):
    from ..operators.relational import renormalised

    k = F.col("c_custkey")
    rows = table(spark, sf, "customer").select(k.alias("k"), F.col("c_acctbal").alias("a"), F.when(k % 4 != 0, F.col("c_acctbal") / 2).alias("b"), F.when(k % 3 != 0, F.col("c_acctbal") * 2).alias("c"))
    return rows.select("k", F.bround(renormalised({"a": 0.5, "b": 0.3, "c": 0.2}), 6).alias("score"))
