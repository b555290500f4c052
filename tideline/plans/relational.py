"""Dashboards over learners, classes, assignments and usage.

Stand-ins in the tables: customers are students and nations their classes, parts are chapters with their brand as
subject, line items are progress rows (quantity over 50 as percentage), orders are assignments, events are usage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import relational as R
from ..sources.tables import AS_OF, lookup, retained, row_id, table, upserted
from ._registry import query


def _pct():
    return F.col("l_quantity") * 2


def _progress(spark: SparkSession, sf: str) -> DataFrame:
    """student, chapter, subject, status, pct, at: a row for each line item."""
    items, orders, parts = table(spark, sf, "lineitem"), table(spark, sf, "orders"), table(spark, sf, "part")
    joined = items.join(orders.select("o_orderkey", "o_custkey"), items.l_orderkey == orders.o_orderkey).join(parts.select("p_partkey", "p_name", "p_brand"), items.l_partkey == parts.p_partkey)
    return joined.select(F.col("o_custkey").alias("student"), F.col("l_partkey").alias("chapter"), F.col("p_brand").alias("subject"), F.col("p_name").alias("title"), _pct().alias("pct"), F.col("l_shipdate").alias("at"))


_PROGRESS_SQL = """progress AS (SELECT o_custkey AS student, l_partkey AS chapter, p_brand AS subject, p_name AS title, l_quantity * 2 AS pct, l_shipdate AS at
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)"""


@query("""SELECT p_brand AS subject, coalesce(nullif(trim(p_name), ''), p_brand) AS topic, cast(round_even(avg(l_quantity * 2), 0) AS INTEGER) AS avg_pct, count(DISTINCT l_orderkey) AS students
FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2 HAVING avg(l_quantity * 2) < 55 ORDER BY avg(l_quantity * 2), 1, 2 LIMIT 20""")
def weak_topics_having(spark, sf):
    items, parts = table(spark, sf, "lineitem"), table(spark, sf, "part")
    topic = F.coalesce(F.nullif(F.trim("p_name"), F.lit("")), F.col("p_brand"))
    grouped = items.join(parts, items.l_partkey == parts.p_partkey).groupBy(F.col("p_brand").alias("subject"), topic.alias("topic"))
    agg = grouped.agg(F.avg(_pct()).alias("mean"), F.count_distinct("l_orderkey").alias("students"))
    return agg.where("mean < 55").orderBy("mean", "subject", "topic").limit(20).select("subject", "topic", R.percent(F.col("mean")).alias("avg_pct"), "students")


@query("""SELECT p_type AS topic, cast(round_even(avg(l_quantity * 2), 0) AS INTEGER) AS mastery, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1""")
def topic_mastery(spark, sf):
    items, parts = table(spark, sf, "lineitem"), table(spark, sf, "part")
    return items.join(parts, items.l_partkey == parts.p_partkey).groupBy(F.col("p_type").alias("topic")).agg(R.percent(F.avg(_pct())).alias("mastery"), F.count(F.lit(1)).alias("n"))


@query(f"WITH {_PROGRESS_SQL} SELECT student, cast(round_even(avg(pct), 0) AS INTEGER) AS completion FROM progress GROUP BY 1")
def completion_map(spark, sf):
    return _progress(spark, sf).groupBy("student").agg(R.percent(F.avg("pct")).alias("completion"))


@query(f"""WITH {_PROGRESS_SQL}, done AS (SELECT student, round_even(avg(pct), 0) AS completion FROM progress GROUP BY 1)
SELECT c_nationkey AS class_id, cast(round_even(avg(coalesce(completion, 0)), 0) AS INTEGER) AS average, count(*) AS students FROM customer LEFT JOIN done ON student = c_custkey GROUP BY 1""")
def class_average_missing_zero(spark, sf):
    done = _progress(spark, sf).groupBy(F.col("student").alias("c_custkey")).agg(F.bround(F.avg("pct")).alias("completion"))
    students = R.with_default(table(spark, sf, "customer").select("c_custkey", "c_nationkey"), done, ["c_custkey"], {"completion": 0.0})
    return students.groupBy(F.col("c_nationkey").alias("class_id")).agg(R.percent(F.avg("completion")).alias("average"), F.count(F.lit(1)).alias("students"))


@query("""SELECT c_nationkey AS class_id, cast(round_even(100.0 * avg(CASE WHEN o_orderstatus IN ('F', 'P') THEN 1 ELSE 0 END), 0) AS INTEGER) AS rate
FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1""")
def assignment_rate(spark, sf):
    orders, students = table(spark, sf, "orders"), table(spark, sf, "customer")
    done = F.when(F.col("o_orderstatus").isin("F", "P"), 1).otherwise(0)
    return orders.join(students, orders.o_custkey == students.c_custkey).groupBy(F.col("c_nationkey").alias("class_id")).agg(R.percent(100.0 * F.avg(done)).alias("rate"))


@query(f"""WITH {_PROGRESS_SQL}, done AS (SELECT student, avg(pct) AS completion FROM progress GROUP BY 1),
tasks AS (SELECT o_custkey AS student, avg(CASE WHEN o_orderstatus IN ('F', 'P') THEN 100.0 ELSE 0.0 END) AS rate, max(o_orderdate) AS last FROM orders GROUP BY 1),
score AS (SELECT n_name AS class_name, avg(coalesce(completion, 0)) AS completion, avg(coalesce(rate, 0)) AS assignments, 100.0 * avg(CASE WHEN last >= TIMESTAMP '2001-01-01' THEN 1 ELSE 0 END) AS active, count(*) AS students
FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN done d ON d.student = c_custkey LEFT JOIN tasks t ON t.student = c_custkey GROUP BY 1),
health AS (SELECT *, greatest(0.0, least(100.0, 0.6 * completion + 0.25 * assignments + 0.15 * active)) AS h FROM score)
SELECT class_name, students, cast(round_even(h, 0) AS INTEGER) AS health, CASE WHEN h >= 70 THEN 'Good' WHEN h >= 45 THEN 'Fair' ELSE 'At Risk' END AS status,
cast(rank() OVER (ORDER BY round_even(h, 4) DESC, class_name) AS INTEGER) AS place FROM health""")
def class_health_score(spark, sf):
    """Completion, assignment and activity of each class in one score, with its place among the classes."""
    from pyspark.sql import Window

    done = _progress(spark, sf).groupBy(F.col("student").alias("c_custkey")).agg(F.avg("pct").alias("completion"))
    tasks = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.avg(F.when(F.col("o_orderstatus").isin("F", "P"), 100.0).otherwise(0.0)).alias("rate"), F.max("o_orderdate").alias("last"))
    students = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    students = R.with_default(R.with_default(students, done, ["c_custkey"], {"completion": 0.0}), tasks, ["c_custkey"], {"rate": 0.0})
    active = F.when(F.col("last") >= F.expr("TIMESTAMP_NTZ'2001-01-01 00:00:00'"), 1).otherwise(0)
    score = students.groupBy(F.col("n_name").alias("class_name")).agg(F.avg("completion").alias("c"), F.avg("rate").alias("a"), (100.0 * F.avg(active)).alias("v"), F.count(F.lit(1)).alias("students"))
    health = score.withColumn("h", R.clamp(0.6 * F.col("c") + 0.25 * F.col("a") + 0.15 * F.col("v"), 0.0, 100.0))
    place = F.rank().over(Window.orderBy(F.bround("h", 4).desc(), "class_name"))  # a row for each class: few
    return health.select("class_name", "students", R.percent(F.col("h")).alias("health"), R.health_status(F.col("h")).alias("status"), place.cast("int").alias("place"))


@query(f"""WITH {_PROGRESS_SQL}, g AS (SELECT student, subject, avg(pct) AS m FROM progress GROUP BY 1, 2)
SELECT student, subject AS weakest, cast(round_even(m, 0) AS INTEGER) AS pct FROM (SELECT *, row_number() OVER (PARTITION BY student ORDER BY m, subject) AS r FROM g) WHERE r = 1""")
def weakest_subject_minby(spark, sf):
    g = _progress(spark, sf).groupBy("student", "subject").agg(F.avg("pct").alias("m"))
    low = g.groupBy("student").agg(F.min(F.struct("m", "subject")).alias("x"))
    return low.select("student", F.col("x.subject").alias("weakest"), R.percent(F.col("x.m")).alias("pct"))


@query(f"""WITH {_PROGRESS_SQL}, low AS (SELECT student, cast(round_even(avg(pct), 0) AS INTEGER) AS completion FROM progress GROUP BY 1 HAVING avg(pct) < 45),
rows AS (SELECT student, completion, 0 AS source FROM low UNION ALL SELECT c_custkey, 0, 1 FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) AND c_custkey NOT IN (SELECT student FROM low)),
risk AS (SELECT student, completion, source, c_name, CASE WHEN completion >= 70 THEN 'Low' WHEN completion >= 45 THEN 'Medium' WHEN completion > 0 THEN 'High' ELSE 'Not Started' END AS risk FROM rows JOIN customer ON c_custkey = student)
SELECT student, completion, risk, cast(source AS INTEGER) AS source FROM risk ORDER BY CASE risk WHEN 'High' THEN 0 WHEN 'Medium' THEN 1 WHEN 'Low' THEN 2 ELSE 9 END, lower(c_name), student LIMIT 20""")
def at_risk_union_rank(spark, sf):
    low = _progress(spark, sf).groupBy("student").agg(F.avg("pct").alias("m")).where("m < 45").select("student", R.percent(F.col("m")).alias("completion"))
    students = table(spark, sf, "customer")
    idle = students.join(table(spark, sf, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select(F.col("c_custkey").alias("student"), F.lit(0).alias("completion"))
    rows = R.first_wins([low, idle], ["student"]).join(students.select(F.col("c_custkey").alias("student"), "c_name"), "student")
    rows = rows.withColumn("risk", R.risk_status(F.col("completion")))
    order = F.when(F.col("risk") == "High", 0).when(F.col("risk") == "Medium", 1).when(F.col("risk") == "Low", 2).otherwise(9)
    return rows.orderBy(order, F.lower("c_name"), "student").limit(20).select("student", "completion", "risk", "source")


@query("""SELECT c_custkey, last_login, CASE WHEN last_login IS NULL THEN 'never' WHEN last_login >= TIMESTAMP '2024-01-24' THEN 'active' ELSE 'idle' END AS status
FROM customer LEFT JOIN (SELECT user_id, max(ts) AS last_login FROM events GROUP BY 1) ON user_id = c_custkey""")
def last_login_left_join(spark, sf):
    last = table(spark, sf, "events").groupBy(F.col("user_id").alias("c_custkey")).agg(F.max("ts").alias("last_login"))
    status = F.when(F.col("last_login").isNull(), "never").when(F.col("last_login") >= F.expr("TIMESTAMP_NTZ'2024-01-24 00:00:00'"), "active").otherwise("idle")
    return table(spark, sf, "customer").select("c_custkey").join(last, "c_custkey", "left").withColumn("status", status)


@query("""SELECT count(*) AS total, count(last) AS logged_in, count(*) FILTER (last >= TIMESTAMP '2024-01-29') AS recent, count(*) FILTER (c_mktsegment = 'BUILDING') AS building
FROM customer LEFT JOIN (SELECT user_id, max(ts) AS last FROM events GROUP BY 1) ON user_id = c_custkey""")
def credential_status_filter(spark, sf):
    last = table(spark, sf, "events").groupBy(F.col("user_id").alias("c_custkey")).agg(F.max("ts").alias("last"))
    rows = table(spark, sf, "customer").join(last, "c_custkey", "left")
    recent = F.col("last") >= F.expr("TIMESTAMP_NTZ'2024-01-29 00:00:00'")
    return rows.agg(F.count(F.lit(1)).alias("total"), F.count("last").alias("logged_in"), F.count_if(recent).alias("recent"), F.count_if(F.col("c_mktsegment") == "BUILDING").alias("building"))


@query("""SELECT o_orderkey, o_custkey FROM orders o WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o.o_orderkey AND l_returnflag IS NOT NULL AND l_returnflag NOT ILIKE 'r%') AND o_orderstatus = 'F'""")
def saved_plans_semi(spark, sf):
    items = table(spark, sf, "lineitem").where(F.col("l_returnflag").isNotNull() & ~F.col("l_returnflag").ilike("r%"))
    orders = table(spark, sf, "orders").where("o_orderstatus = 'F'")
    return orders.join(items, orders.o_orderkey == items.l_orderkey, "left_semi").select("o_orderkey", "o_custkey")


@query("SELECT p_partkey, p_brand FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R')")
def uncovered_anti(spark, sf):
    seen = table(spark, sf, "lineitem").where("l_returnflag = 'R'")
    parts = table(spark, sf, "part")
    return parts.join(seen, parts.p_partkey == seen.l_partkey, "left_anti").select("p_partkey", "p_brand")


@query("""WITH u AS (SELECT s_suppkey AS user_id, s_nationkey AS own_class, cast(s_suppkey % 5 AS VARCHAR) AS grade, cast(s_suppkey % 3 AS VARCHAR) AS sa, cast((s_suppkey + 1) % 3 AS VARCHAR) AS sb, CASE WHEN s_suppkey % 2 = 0 THEN '' ELSE 'C' || cast(s_suppkey % 4 AS VARCHAR) END AS cur FROM supplier),
c AS (SELECT n_nationkey AS class_id, cast(n_nationkey % 5 AS VARCHAR) AS grade, cast(n_regionkey % 3 AS VARCHAR) AS section, CASE WHEN n_nationkey % 7 = 0 THEN NULL ELSE 'C' || cast(n_nationkey % 4 AS VARCHAR) END AS cur FROM nation)
SELECT DISTINCT user_id, class_id FROM u, c WHERE own_class = class_id OR (u.grade = c.grade AND section IN (sa, sb) AND (u.cur = '' OR c.cur IS NULL OR u.cur = c.cur))""")
def roster_theta_explode(spark, sf):
    s = lambda c: c.cast("string")
    k, n = F.col("s_suppkey"), F.col("n_nationkey")
    none = F.lit(None).cast("int")
    curriculum = F.when(k % 2 == 0, F.lit("")).otherwise(F.concat(F.lit("C"), s(k % 4)))
    no_sections = F.array().cast("array<string>")
    teaching = F.array(
        F.struct(F.col("s_nationkey").alias("class_id"), F.lit(None).cast("string").alias("grade"), no_sections.alias("sections"), curriculum.alias("curriculum")),
        F.struct(none.alias("class_id"), s(k % 5).alias("grade"), F.array(s(k % 3), s((k + 1) % 3)).alias("sections"), curriculum.alias("curriculum")),
    )
    users = table(spark, sf, "supplier").select(k.alias("user_id"), teaching.alias("teaching"))
    classes = table(spark, sf, "nation").select(n.alias("class_id"), s(n % 5).alias("grade"), s(F.col("n_regionkey") % 3).alias("section"), F.when(n % 7 != 0, F.concat(F.lit("C"), s(n % 4))).alias("curriculum"))
    return R.roster(users, classes)


@query("""SELECT user_id, cast(round(sum(CASE WHEN ts >= TIMESTAMP '2024-01-30' THEN value ELSE 0 END) * 100) AS BIGINT) AS day_cents, cast(round(sum(CASE WHEN ts >= TIMESTAMP '2024-01-24' THEN value ELSE 0 END) * 100) AS BIGINT) AS week_cents,
cast(round(sum(CASE WHEN ts >= TIMESTAMP '2024-01-01' THEN value ELSE 0 END) * 100) AS BIGINT) AS month_cents, count(*) AS calls, count(*) FILTER (event_type = 'error') AS errors FROM events GROUP BY 1""")
def token_telemetry_rolling(spark, sf):
    since = lambda days: F.sum(F.when(F.col("ts") >= F.expr(f"TIMESTAMP_NTZ'{AS_OF}' - INTERVAL {days} DAYS"), F.col("value")).otherwise(0.0))
    cents = lambda c: F.round(c * 100).cast("long")
    return table(spark, sf, "events").groupBy("user_id").agg(cents(since(1)).alias("day_cents"), cents(since(7)).alias("week_cents"), cents(since(30)).alias("month_cents"), F.count(F.lit(1)).alias("calls"), F.count_if(F.col("event_type") == "error").alias("errors"))


@query("""WITH e AS (SELECT n_name, user_id, round(value * 100) AS cents FROM events LEFT JOIN customer ON c_custkey = user_id LEFT JOIN nation ON n_nationkey = c_nationkey)
SELECT n_name, user_id, cast(sum(cents) AS BIGINT) AS cents, cast(grouping(n_name, user_id) AS INTEGER) AS level FROM e GROUP BY ROLLUP (n_name, user_id)""")
def usage_rollup_two_level(spark, sf):
    students = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("n_nationkey") == F.col("c_nationkey")).select(F.col("c_custkey").alias("user_id"), "n_name")
    rows = table(spark, sf, "events").join(students, "user_id", "left").withColumn("cents", F.round(F.col("value") * 100))
    return rows.rollup("n_name", "user_id").agg(F.sum("cents").cast("long").alias("cents"), F.grouping_id().cast("int").alias("level"))


@query("""SELECT c_nationkey AS school, count(*) FILTER (c_mktsegment = 'BUILDING') AS building, count(*) FILTER (c_mktsegment = 'MACHINERY') AS machinery, count(*) FILTER (c_mktsegment = 'HOUSEHOLD') AS household FROM customer GROUP BY 1""")
def users_by_role_pivot(spark, sf):
    roles = ["BUILDING", "MACHINERY", "HOUSEHOLD"]
    wide = table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("school")).pivot("c_mktsegment", roles).count()
    return wide.select("school", *[F.coalesce(r, F.lit(0)).cast("long").alias(r.lower()) for r in roles])


@query("""WITH a AS (SELECT count(DISTINCT CASE WHEN ts >= TIMESTAMP '2024-01-24' THEN user_id END) AS now, count(DISTINCT CASE WHEN ts >= TIMESTAMP '2024-01-17' AND ts < TIMESTAMP '2024-01-24' THEN user_id END) AS before FROM events)
SELECT now, before, CASE WHEN before = 0 THEN NULL ELSE round_even(100.0 * (now - before) / before, 2) END AS delta_pct FROM a""")
def active_users_distinct(spark, sf):
    between = lambda a, b: (F.col("ts") >= F.expr(f"TIMESTAMP_NTZ'{a} 00:00:00'")) & (F.col("ts") < F.expr(f"TIMESTAMP_NTZ'{b} 00:00:00'"))
    a = table(spark, sf, "events").agg(F.count_distinct(F.when(between("2024-01-24", "9999-01-01"), F.col("user_id"))).alias("now"), F.count_distinct(F.when(between("2024-01-17", "2024-01-24"), F.col("user_id"))).alias("before"))
    return a.withColumn("delta_pct", F.bround(F.try_divide(100.0 * (F.col("now") - F.col("before")), F.col("before")), 2))


@query("""WITH s AS (SELECT o_custkey, CASE WHEN o_orderstatus IN ('O', 'P') AND o_orderdate < TIMESTAMP '1998-01-01' THEN 'overdue' WHEN o_orderstatus = 'O' THEN 'pending' WHEN o_orderstatus = 'P' THEN 'in_progress' ELSE 'graded' END AS status FROM orders)
SELECT c_nationkey AS class_id, count(*) AS total, count(*) FILTER (status = 'overdue') AS overdue, count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'in_progress') AS in_progress, count(*) FILTER (status = 'graded') AS graded
FROM s JOIN customer ON c_custkey = o_custkey GROUP BY 1""")
def submission_status_counts(spark, sf):
    late = F.col("o_orderstatus").isin("O", "P") & (F.col("o_orderdate") < F.expr("TIMESTAMP_NTZ'1998-01-01 00:00:00'"))
    status = F.when(late, "overdue").when(F.col("o_orderstatus") == "O", "pending").when(F.col("o_orderstatus") == "P", "in_progress").otherwise("graded")
    rows = table(spark, sf, "orders").withColumn("status", status).join(table(spark, sf, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    return rows.groupBy(F.col("c_nationkey").alias("class_id")).agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("status") == s).alias(s) for s in ("overdue", "pending", "in_progress", "graded")])


@query(f"""WITH {_PROGRESS_SQL}, q AS (SELECT student, avg(pct) AS overall, avg(CASE WHEN progress.at >= TIMESTAMP '2001-01-01' THEN pct END) AS now, avg(CASE WHEN progress.at >= TIMESTAMP '2000-01-01' AND progress.at < TIMESTAMP '2001-01-01' THEN pct END) AS before FROM progress GROUP BY 1)
SELECT student, round_even(coalesce(now, overall), 4) AS current, round_even(coalesce(now, overall) - coalesce(before, overall), 4) AS trend FROM q""")
def quiz_trend(spark, sf):
    day = lambda d: F.expr(f"TIMESTAMP_NTZ'{d} 00:00:00'")
    q = _progress(spark, sf).groupBy("student").agg(F.avg("pct").alias("overall"), F.avg(F.when(F.col("at") >= day("2001-01-01"), F.col("pct"))).alias("now"), F.avg(F.when((F.col("at") >= day("2000-01-01")) & (F.col("at") < day("2001-01-01")), F.col("pct"))).alias("before"))
    now, before = F.coalesce("now", "overall"), F.coalesce("before", "overall")
    return q.select("student", F.bround(now, 4).alias("current"), F.bround(now - before, 4).alias("trend"))


@query("""SELECT event_id, user_id, event_type, (SELECT count(*) FROM events WHERE event_type = 'error' AND props ILIKE '%9%') AS total FROM events WHERE event_type = 'error' AND props ILIKE '%9%' ORDER BY ts DESC, event_id LIMIT 25 OFFSET 25""")
def issues_page_offset(spark, sf):
    rows = R.filtered(table(spark, sf, "events"), F.col("event_type") == "error", R.any_like([F.col("props")], "9"), None)
    part, total = R.page(rows, [F.col("ts").desc(), F.col("event_id")], 2, 25)
    return part.select("event_id", "user_id", "event_type", F.lit(total).cast("long").alias("total"))


@query("""SELECT 'brand' AS facet, array_to_string(list_sort(list(DISTINCT p_brand)), ',') AS options FROM part UNION ALL SELECT 'type', array_to_string(list_sort(list(DISTINCT p_type)), ',') FROM part""")
def faceted_options(spark, sf):
    sets = table(spark, sf, "part").agg(*[F.array_join(F.array_sort(F.collect_set(c)), ",").alias(f) for f, c in (("brand", "p_brand"), ("type", "p_type"))])
    return sets.selectExpr("stack(2, 'brand', brand, 'type', type) AS (facet, options)")


@query("""WITH eav AS (SELECT p_partkey AS id, 'brand' AS key, p_brand AS value FROM part UNION ALL SELECT p_partkey, 'type', p_type FROM part UNION ALL SELECT p_partkey, 'size', cast(p_size AS VARCHAR) FROM part)
SELECT a.value AS brand, b.value AS type, count(*) AS n, min(a.id) AS first_id FROM eav a JOIN eav b ON a.id = b.id AND a.key = 'brand' AND b.key = 'type' GROUP BY 1, 2""")
def eav_self_join(spark, sf):
    parts = table(spark, sf, "part")
    eav = parts.selectExpr("p_partkey AS id", "stack(3, 'brand', p_brand, 'type', p_type, 'size', CAST(p_size AS STRING)) AS (key, value)")
    wide = eav.groupBy("id").pivot("key", ["brand", "type"]).agg(F.first("value"))
    return wide.groupBy("brand", "type").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"))


@query("""WITH asked AS (SELECT cast(event_id AS VARCHAR) AS id, CASE WHEN event_id % 3 = 0 THEN cast(user_id AS VARCHAR) WHEN event_id % 3 = 1 THEN 'Customer#' || lpad(cast(user_id AS VARCHAR), 9, '0') ELSE 'x' || cast(user_id AS VARCHAR) END AS ref FROM events)
SELECT a.id, coalesce(k.id, m.id, a.ref) AS ref FROM asked a LEFT JOIN (SELECT cast(c_custkey AS VARCHAR) AS id FROM customer) k ON k.id = a.ref LEFT JOIN (SELECT c_name AS label, cast(c_custkey AS VARCHAR) AS id FROM customer) m ON m.label = a.ref""")
def id_remap_coalesce(spark, sf):
    u, e = F.col("user_id").cast("string"), F.col("event_id")
    ref = F.when(e % 3 == 0, u).when(e % 3 == 1, F.concat(F.lit("Customer#"), F.lpad(u, 9, "0"))).otherwise(F.concat(F.lit("x"), u))
    asked = table(spark, sf, "events").select(e.cast("string").alias("id"), ref.alias("ref"))
    students = table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("label"))
    return R.remapped(asked.withColumnRenamed("id", "row"), "ref", students, students).select(F.col("row").alias("id"), "ref")


@query("""SELECT o_orderkey AS book, o_custkey % 9 AS asked, l_linenumber AS page, l_partkey AS chunk, cast(greatest(0, 24 - 6 * abs(l_linenumber - o_custkey % 9)) AS INTEGER) AS score FROM orders JOIN lineitem ON l_orderkey = o_orderkey AND abs(l_linenumber - o_custkey % 9) <= 4""")
def page_proximity_band(spark, sf):
    """Chunks of the asked book within four pages of the asked page."""
    asked = table(spark, sf, "orders").select(F.col("o_orderkey").alias("book"), (F.col("o_custkey") % 9).alias("asked"))
    chunks = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("book"), F.col("l_linenumber").alias("page"), F.col("l_partkey").alias("chunk"))
    near = R.band_join(asked, chunks, ["book"], "asked", "page", 4)
    return near.select("book", "asked", "page", "chunk", F.greatest(F.lit(0), 24 - 6 * F.abs(F.col("page") - F.col("asked"))).cast("int").alias("score"))


@query("""SELECT c_custkey AS id, coalesce(u.value, c_acctbal) AS balance, u.user_id IS NOT NULL AS updated FROM customer FULL JOIN (SELECT user_id, max_by(value, (ts, event_id)) AS value FROM events GROUP BY 1) u ON u.user_id = c_custkey WHERE c_custkey IS NOT NULL
UNION ALL SELECT user_id, max_by(value, (ts, event_id)), true FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer) GROUP BY 1""")
def upsert_latest(spark, sf):
    newest = R.latest(table(spark, sf, "events").select("user_id", "ts", "event_id", "value"), ["user_id"], ["ts", "event_id"])
    target = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"), F.lit(False).alias("updated"))
    return upserted(target, newest.select(F.col("user_id").alias("id"), F.col("value").alias("balance"), F.lit(True).alias("updated")), ["id"])


@query("SELECT event_type, count(*) AS kept FROM events WHERE ts >= TIMESTAMP '2024-01-31' - INTERVAL 14 DAYS GROUP BY 1")
def retention_filter(spark, sf):
    return retained(table(spark, sf, "events"), "ts", AS_OF, 14).groupBy("event_type").agg(F.count(F.lit(1)).alias("kept"))


@query("SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey = 42")
def point_lookup(spark, sf):
    return lookup(table(spark, sf, "customer"), "c_custkey", 42).select("c_custkey", "c_name", "c_acctbal")


@query("SELECT doc_id, sha256(concat_ws(':', 'text', source, cast(doc_id AS VARCHAR), substring(sha256(substring(text, 1, 200)), 1, 12))) AS row_id FROM documents")
def deterministic_row_ids(spark, sf):
    head = F.substring(F.sha2(F.substring("text", 1, 200), 256), 1, 12)
    return table(spark, sf, "documents").select("doc_id", row_id(F.lit("text"), F.col("source"), F.col("doc_id"), head).alias("row_id"))


@query("""WITH q AS (SELECT o_custkey AS student, coalesce(max(o_totalprice), 0) AS best, coalesce(avg(o_totalprice), 0) AS mean FROM orders GROUP BY 1)
SELECT c_custkey AS student, round_even(greatest(coalesce(best, 0), coalesce(mean, 0), c_acctbal), 4) AS signal FROM customer LEFT JOIN q ON student = c_custkey""")
def best_signal_greatest(spark, sf):
    q = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_totalprice").alias("best"), F.avg("o_totalprice").alias("mean"))
    rows = R.with_default(table(spark, sf, "customer").select("c_custkey", "c_acctbal"), q, ["c_custkey"], {"best": 0.0, "mean": 0.0})
    return rows.select(F.col("c_custkey").alias("student"), F.bround(F.greatest("best", "mean", "c_acctbal"), 4).alias("signal"))


@query("""SELECT s_nationkey AS k, cast(coalesce(max(s_suppkey), 0) + 1 AS BIGINT) AS next_seq FROM supplier GROUP BY 1""")
def next_sequence(spark, sf):
    return table(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg((F.coalesce(F.max("s_suppkey"), F.lit(0)) + 1).cast("long").alias("next_seq"))


@query("""SELECT lower(title) AS topic, min(source) AS source FROM (SELECT p_name AS title, 0 AS source FROM part WHERE p_size < 10 UNION ALL SELECT p_name, 1 FROM part WHERE p_brand = 'Brand#1') GROUP BY 1""")
def union_first_wins(spark, sf):
    parts = table(spark, sf, "part").select(F.lower("p_name").alias("topic"), "p_size", "p_brand")
    return R.first_wins([parts.where("p_size < 10").select("topic"), parts.where("p_brand = 'Brand#1'").select("topic")], ["topic"])


@query("""WITH a AS (SELECT DISTINCT l_partkey AS p FROM lineitem WHERE l_returnflag = 'A'), r AS (SELECT DISTINCT l_partkey AS p FROM lineitem WHERE l_returnflag = 'R')
SELECT 'minus' AS op, count(*) AS n FROM (FROM a EXCEPT FROM r) UNION ALL SELECT 'both', count(*) FROM (FROM a INTERSECT FROM r) UNION ALL SELECT 'either', count(*) FROM (FROM a UNION FROM r)""")
def set_operations(spark, sf):
    items = table(spark, sf, "lineitem")
    a, r = (items.where(F.col("l_returnflag") == x).select("l_partkey").distinct() for x in "AR")
    one = lambda df, op: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(op).alias("op"), "n")
    return one(a.subtract(r), "minus").union(one(a.intersect(r), "both")).union(one(a.union(r).distinct(), "either"))
