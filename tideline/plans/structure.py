"""Document structure, parsers, small classifiers, dates and the remaining rankings."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import structure as X
from ..functions import text as T
from ..operators import relational as R
from ..operators import windows as W
from ..sources.scratch import scratch_path
from ..sources.tables import table
from ._registry import query


@query("""WITH s AS (SELECT p_brand, p_partkey AS start FROM part) SELECT p_brand, start, greatest(start, coalesce(lead(start) OVER (PARTITION BY p_brand ORDER BY start) - 1, 99999)) AS end_page FROM s""")
def chapter_page_spans(spark, sf):
    return X.page_spans(table(spark, sf, "part").select("p_brand", F.col("p_partkey").alias("start")), "p_brand", "start", 100_000)


@query("""WITH g AS (SELECT p_brand, list(DISTINCT p_size) AS have, min(p_size) AS lo, max(p_size) AS hi FROM part GROUP BY 1) SELECT p_brand, array_to_string(list_sort(list_filter(range(lo, hi + 1), lambda x: NOT list_contains(have, cast(x AS INTEGER)))), ',') AS missing FROM g""")
def numbering_gaps(spark, sf):
    return X.missing_numbers(table(spark, sf, "part"), "p_brand", "p_size").select("p_brand", F.array_join(F.transform("missing", lambda x: x.cast("string")), ",").alias("missing"))


@query("""WITH m AS (SELECT l_orderkey, l_suppkey % 2 + (l_partkey % 5) // 4 AS "offset" FROM lineitem WHERE l_returnflag <> 'N'), t AS (SELECT l_orderkey, l_partkey % 3 AS "offset" FROM lineitem WHERE l_returnflag = 'N' AND l_quantity > 25),
mode AS (SELECT l_orderkey, 'm' AS kind, "offset", count(*) AS votes FROM m GROUP BY 1, 3 UNION ALL SELECT l_orderkey, 't', "offset", count(*) FROM t GROUP BY 1, 3), r AS (SELECT *, sum(votes) OVER (PARTITION BY l_orderkey, kind) AS total FROM mode QUALIFY row_number() OVER (PARTITION BY l_orderkey, kind ORDER BY votes DESC, "offset") = 1),
k AS (SELECT DISTINCT l_orderkey FROM lineitem), j AS (SELECT k.l_orderkey, a."offset" AS mo, a.votes AS mv, a.total AS mt, b."offset" AS t_o, b.votes AS tv, coalesce(a.votes >= 4 AND a.votes / a.total >= 0.5, false) AS sure FROM k LEFT JOIN r a ON a.l_orderkey = k.l_orderkey AND a.kind = 'm' LEFT JOIN r b ON b.l_orderkey = k.l_orderkey AND b.kind = 't')
SELECT l_orderkey, CASE WHEN sure THEN mo ELSE coalesce(t_o, mo, 0) END AS "offset", CASE WHEN sure THEN mv ELSE coalesce(tv, mv, 0) END AS votes, round_even(CASE WHEN sure THEN least(0.98e0, 0.7e0 + 0.3e0 * (mv / mt)) WHEN tv IS NOT NULL THEN 0.88e0 WHEN mv IS NOT NULL THEN 0.65e0 ELSE 0.5e0 END, 6) AS confidence FROM j""")
def page_offset_consensus(spark, sf):
    """The page offset of each book: returned and accepted lines stand for page margins, the others for contents."""
    items = table(spark, sf, "lineitem").withColumn("printed", F.col("l_linenumber").cast("long"))
    ahead = F.when(F.col("l_returnflag") != "N", F.col("l_suppkey") % 2 + F.when(F.col("l_partkey") % 5 == 4, 1).otherwise(0)).otherwise(F.col("l_partkey") % 3)
    rows = items.withColumn("physical", F.col("printed") + ahead)
    found = X.offset_consensus(items, rows.where("l_returnflag <> 'N'"), rows.where("l_returnflag = 'N' AND l_quantity > 25"), "l_orderkey", "printed", "physical")
    return found.withColumn("confidence", F.bround("confidence", 6))


@query(r"""WITH w AS (SELECT unnest(string_split_regex(lower(text), '[^a-z]+')) AS numeral FROM documents), d AS (SELECT numeral, count(*) AS n FROM w WHERE regexp_full_match(numeral, '[ivxlcdm]+') GROUP BY 1),
v AS (SELECT *, list_transform(string_split(numeral, ''), lambda c: CASE c WHEN 'i' THEN 1 WHEN 'v' THEN 5 WHEN 'x' THEN 10 WHEN 'l' THEN 50 WHEN 'c' THEN 100 WHEN 'd' THEN 500 ELSE 1000 END) AS l FROM d)
SELECT numeral, n, cast(list_sum(list_transform(l, lambda x, i: CASE WHEN x < coalesce(l[i + 1], 0) THEN -x ELSE x END)) AS INTEGER) AS value FROM v""")
def roman_numerals(spark, sf):
    """The words of all documents that are Roman numerals, how often they occur, and their numbers."""
    words = table(spark, sf, "documents").select(F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("numeral")).groupBy("numeral").agg(F.count(F.lit(1)).alias("n"))
    return words.withColumn("value", X.roman(F.col("numeral"))).where("value IS NOT NULL")


@query("""SELECT p_partkey, p_name, row_number() OVER (ORDER BY coalesce(try_cast(nullif(regexp_extract(p_name || ' ' || cast(p_size AS VARCHAR), '([0-9]+)', 1), '') AS BIGINT), p_partkey), lower(p_name), p_partkey) AS place FROM part ORDER BY place LIMIT 50""")
def natural_order_topk(spark, sf):
    key = X.first_number(F.concat_ws(" ", "p_name", F.col("p_size").cast("string")), F.col("p_partkey"))
    top = table(spark, sf, "part").orderBy(key, F.lower("p_name"), "p_partkey").limit(50).withColumn("k", key)
    return top.withColumn("place", F.row_number().over(Window.orderBy("k", F.lower("p_name"), "p_partkey")).cast("long")).select("p_partkey", "p_name", "place")


@query(r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) SELECT doc_id, count(*) FILTER (regexp_matches(line, '(?i)^\s*(chapter|unit|lesson|section)\s+\w+')) AS chapter, count(*) FILTER (length(line) <= 80 AND NOT regexp_matches(line, '(?i)^\s*(chapter|unit|lesson|section)\s+\w+') AND regexp_matches(line, '^\s*\p{Lu}[\p{Lu}\s]{3,}$')) AS caps FROM l GROUP BY 1""")
def heading_kinds(spark, sf):
    kinds = F.transform(F.split("text", "\n"), X.heading)
    n = lambda k: F.size(F.filter("kinds", lambda x: F.coalesce(x == k, F.lit(False)))).cast("long").alias(k)
    return table(spark, sf, "documents").select("doc_id", kinds.alias("kinds")).select("doc_id", n("chapter"), n("caps"))


@query(r"""WITH t AS (SELECT l_orderkey, string_agg('| ' || cast(l_partkey AS VARCHAR) || ' | ' || l_returnflag || CASE WHEN l_quantity > 45 THEN ' | bulk |' ELSE ' |' END, chr(10) ORDER BY l_linenumber, l_partkey, l_returnflag, l_quantity) AS body FROM lineitem GROUP BY 1),
l AS (SELECT l_orderkey, list_filter(list_transform(string_split('| item | flag |' || chr(10) || '|---|:--:|' || chr(10) || body, chr(10)), lambda x: trim(x)), lambda x: regexp_matches(x, '^\|.*\|$') AND NOT regexp_matches(x, '^\|[\s:|-]+\|$')) AS rows FROM t),
w AS (SELECT l_orderkey, len(rows) AS n, list_transform(rows, lambda x: len(string_split(x, '|')) - 2) AS widths FROM l)
SELECT l_orderkey, cast(n AS INTEGER) AS rows, cast(widths[1] AS INTEGER) AS cols, len(list_distinct(widths)) > 1 AS ragged, n >= 2 AND len(list_distinct(widths)) = 1 AS ok FROM w""")
def markdown_tables(spark, sf):
    """Size and shape of a table in Markdown: here each order's items, written as one, with some rows too wide."""
    row = F.concat(F.lit("| "), F.col("l_partkey").cast("string"), F.lit(" | "), F.col("l_returnflag"), F.when(F.col("l_quantity") > 45, F.lit(" | bulk |")).otherwise(F.lit(" |")))
    items = table(spark, sf, "lineitem").withColumn("row", row).groupBy("l_orderkey").agg(W.ordered_list("row", "l_linenumber", "l_partkey", "l_returnflag", "l_quantity").alias("rows"))
    md = F.concat_ws("\n", F.lit("| item | flag |"), F.lit("|---|:--:|"), F.array_join("rows", "\n"))
    return items.select("l_orderkey", X.markdown_table(md).alias("t")).select("l_orderkey", "t.*")


@query(r"""WITH t AS (SELECT doc_id, lower('Fig. ' || cast(n_chars % 5 AS VARCHAR) || ' ' || coalesce(text, '') || ' figure ' || cast(n_chars % 5 AS VARCHAR) || '.' || cast(doc_id % 7 AS VARCHAR) || '; FIG ' || cast(doc_id % 3 AS VARCHAR)) AS s FROM documents), f AS (SELECT doc_id, unnest(regexp_extract_all(s, '\bfig(?:ure)?\.?\s*([0-9]+(?:\.[0-9]+)?)', 1)) AS figure, generate_subscripts(regexp_extract_all(s, '\bfig(?:ure)?\.?\s*([0-9]+(?:\.[0-9]+)?)', 1), 1) AS i FROM t),
d AS (SELECT doc_id, figure, min(i) AS i FROM f GROUP BY 1, 2) SELECT doc_id, string_agg(figure, ',' ORDER BY i) AS figures FROM d GROUP BY 1""")
def figure_citations(spark, sf):
    """Figures that a document cites, in order: those of its text, between two that its own numbers give."""
    number = lambda c, m: (F.col(c) % m).cast("string")
    text = F.concat(F.lit("Fig. "), number("n_chars", 5), F.lit(" "), F.coalesce("text", F.lit("")), F.lit(" figure "), number("n_chars", 5), F.lit("."), number("doc_id", 7), F.lit("; FIG "), number("doc_id", 3))
    return table(spark, sf, "documents").select("doc_id", F.array_join(X.figure_refs(text), ",").alias("figures"))


@query(r"""SELECT doc_id, round_even(coalesce(len(regexp_extract_all(text, '[^\p{L}\p{N}\s.,;:!?''"()-]')) / nullif(length(text), 0), 0), 6) AS noise FROM documents""")
def ocr_noise(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.bround(X.noise_ratio(F.col("text")), 6).alias("noise"))


@query("""WITH c AS (SELECT conv_id, turn, length(text) AS n, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS used FROM conversations) SELECT conv_id, count(*) AS turns, cast(sum(n) AS BIGINT) AS chars FROM c WHERE used <= 2000 GROUP BY 1""")
def context_budget(spark, sf):
    kept = X.within_budget(table(spark, sf, "conversations").select("conv_id", "turn", "text"), ["conv_id"], ["turn"], "text", 2000)
    return kept.groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"), F.sum(F.length("text")).cast("long").alias("chars"))


@query("""WITH g AS (SELECT l_orderkey, list(DISTINCT l_partkey % 6) AS covered, count(*) FILTER (l_returnflag = 'R') = count(*) AS done FROM lineitem GROUP BY 1), t AS (SELECT *, cast(l_orderkey % 7 AS INTEGER) AS total FROM g)
SELECT l_orderkey, cast(CASE WHEN done THEN 100 WHEN total <= 0 THEN 0 ELSE least(99, round_even(100e0 * len(covered) / greatest(total, 1), 0)) END AS INTEGER) AS pct FROM t""")
def topic_coverage_pct(spark, sf):
    g = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.col("l_partkey") % 6).alias("covered"), (F.count_if(F.col("l_returnflag") == "R") == F.count(F.lit(1))).alias("done"))
    return g.select("l_orderkey", X.covered_percent(F.col("covered"), (F.col("l_orderkey") % 7).cast("int"), F.col("done")).cast("int").alias("pct"))


@query("""WITH b AS (SELECT vec_id AS id, label, embedding[1]::DOUBLE AS x0, embedding[2]::DOUBLE AS y0, embedding[1]::DOUBLE + abs(embedding[3]::DOUBLE) + 0.05e0 AS x1, embedding[2]::DOUBLE + abs(embedding[4]::DOUBLE) + 0.05e0 AS y1, vec_id // 40 AS page FROM embeddings),
p AS (SELECT a.id AS a, b.id AS b, greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0)) / least((a.x1 - a.x0) * (a.y1 - a.y0), (b.x1 - b.x0) * (b.y1 - b.y0)) AS o FROM b a JOIN b ON a.page = b.page AND a.label = b.label AND a.id < b.id)
SELECT a, b, round_even(o, 6) AS overlap FROM p WHERE o >= 0.55""")
def near_duplicate_boxes(spark, sf):
    """Boxes of one page and label that share more than half of the smaller one; forty boxes stand on a page."""
    e = lambda i: F.get("embedding", F.lit(i)).cast("double")
    box = F.struct(e(0).alias("x0"), e(1).alias("y0"), (e(0) + F.abs(e(2)) + 0.05).alias("x1"), (e(1) + F.abs(e(3)) + 0.05).alias("y1"))
    b = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.floor(F.col("vec_id") / 40).alias("page"), "label", box.alias("box"))
    p = b.select(F.col("id").alias("a"), "page", "label", F.col("box").alias("box_a")).join(b.select(F.col("id").alias("b"), "page", "label", F.col("box").alias("box_b")), ["page", "label"]).where("a < b")
    return p.withColumn("o", X.overlap_of_smaller(F.col("box_a"), F.col("box_b"))).where("o >= 0.55").select("a", "b", F.bround("o", 6).alias("overlap"))


@query("""WITH RECURSIVE e AS (SELECT user_id, cast(json_extract_string(props, '$.k') AS INTEGER) % 5 AS q, CASE event_type WHEN 'purchase' THEN 'CORRECT' WHEN 'click' THEN 'PARTIAL' WHEN 'error' THEN 'INCORRECT' ELSE 'NOT_AN_ANSWER' END AS g, row_number() OVER (PARTITION BY user_id, cast(json_extract_string(props, '$.k') AS INTEGER) % 5 ORDER BY ts, event_id) AS i FROM events),
f AS (SELECT user_id, q, cast(0 AS BIGINT) AS i, cast(NULL AS VARCHAR) AS outcome, 0 AS attempts, false AS done, false AS revealed FROM (SELECT DISTINCT user_id, q FROM e) UNION ALL
SELECT e.user_id, e.q, e.i, CASE WHEN done OR g = 'NOT_AN_ANSWER' THEN outcome ELSE g END, attempts + CASE WHEN NOT done AND g = 'INCORRECT' THEN 1 ELSE 0 END, done OR g IN ('CORRECT', 'PARTIAL') OR (g = 'INCORRECT' AND attempts + 1 >= 2), revealed OR (NOT done AND g = 'INCORRECT' AND attempts + 1 >= 2) FROM f JOIN e ON e.user_id = f.user_id AND e.q = f.q AND e.i = f.i + 1),
l AS (SELECT user_id, q, max(i) AS i FROM f GROUP BY 1, 2) SELECT user_id, q, outcome, cast(attempts AS INTEGER) AS attempts, revealed, CASE WHEN outcome = 'CORRECT' THEN 1e0 WHEN outcome = 'PARTIAL' AND NOT revealed THEN 0.5e0 ELSE 0e0 END AS points FROM f JOIN l USING (user_id, q, i)""")
def quiz_state_machine(spark, sf):
    t = F.col("event_type")
    g = F.when(t == "purchase", "CORRECT").when(t == "click", "PARTIAL").when(t == "error", "INCORRECT").otherwise("NOT_AN_ANSWER")
    e = table(spark, sf, "events").select("user_id", (F.get_json_object("props", "$.k").cast("int") % 5).alias("q"), "ts", "event_id", g.alias("g"))
    return X.quiz_fold(e, ["user_id", "q"], ["ts", "event_id"], "g")


@query("""SELECT user_id, strftime(ts + INTERVAL 330 MINUTES, '%d %b %Y, %I:%M %p') AS shown, cast(ts + INTERVAL 330 MINUTES AS DATE) AS local_day FROM (SELECT user_id, max(ts) AS ts FROM events GROUP BY 1)""")
def local_time_labels(spark, sf):
    last = table(spark, sf, "events").groupBy("user_id").agg(F.max("ts").cast("timestamp").alias("ts"))
    local = F.from_utc_timestamp("ts", "Asia/Kolkata")
    return last.select("user_id", F.date_format(local, "dd MMM yyyy, hh:mm a").alias("shown"), F.to_date(local).alias("local_day"))


@query("""SELECT o_orderkey, cast(i AS INTEGER) AS step, cast(o_orderdate AS DATE) + cast(i + 1 AS INTEGER) AS day, ['read', 'recall', 'practise'][(i % 3) + 1] AS task FROM orders, range(5) r(i)""")
def revision_schedule(spark, sf):
    tasks = F.array(*[F.lit(x) for x in ("read", "recall", "practise")])
    rows = table(spark, sf, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("d"), F.explode(F.sequence(F.lit(0), F.lit(4))).alias("step"))
    return rows.select("o_orderkey", "step", F.date_add("d", F.col("step") + 1).alias("day"), F.get(tasks, F.col("step") % 3).alias("task"))


@query("""SELECT o_orderkey, CASE WHEN TIMESTAMP '1998-01-01' < o_orderdate THEN 'upcoming' WHEN TIMESTAMP '1998-01-01' <= o_orderdate + INTERVAL 90 DAYS THEN 'live' ELSE 'completed' END AS status FROM orders""")
def session_status(spark, sf):
    now, start = F.expr("TIMESTAMP_NTZ'1998-01-01 00:00:00'"), F.col("o_orderdate")
    return table(spark, sf, "orders").select("o_orderkey", F.when(now < start, "upcoming").when(now <= start + F.expr("INTERVAL 90 DAYS"), "live").otherwise("completed").alias("status"))


@query("""WITH d AS (SELECT source, avg(CASE WHEN n_chars < 400 THEN 1.0 ELSE 0.0 END) AS low, avg(n_chars) AS mean FROM documents GROUP BY 1) SELECT source, CASE WHEN low >= 0.85 THEN 'scanned' WHEN low >= 0.25 THEN 'mixed' WHEN mean < 150 THEN 'low_quality' ELSE 'digital' END AS kind FROM d""")
def document_kind(spark, sf):
    d = table(spark, sf, "documents").groupBy("source").agg(F.avg(F.when(F.col("n_chars") < 400, 1.0).otherwise(0.0)).alias("low"), F.avg("n_chars").alias("mean"))
    return d.select("source", F.when(F.col("low") >= 0.85, "scanned").when(F.col("low") >= 0.25, "mixed").when(F.col("mean") < 150, "low_quality").otherwise("digital").alias("kind"))


@query("""WITH r AS (SELECT doc_id, CASE WHEN lang <> 'en' THEN 'language' WHEN n_chars < 300 THEN 'too_short' WHEN contains(lower(text), 'license') THEN 'license' END AS reason FROM documents) SELECT coalesce(reason, 'kept') AS reason, count(*) AS n FROM r GROUP BY 1""")
def ordered_reject_reasons(spark, sf):
    reason = F.when(F.col("lang") != "en", "language").when(F.col("n_chars") < 300, "too_short").when(F.contains(F.lower("text"), F.lit("license")), "license").otherwise("kept")
    return table(spark, sf, "documents").groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH m AS (SELECT l_partkey % 50 AS topic, round_even(avg(l_quantity / 50), 9) AS mastery, l_suppkey FROM lineitem GROUP BY l_partkey % 50, l_suppkey)
SELECT topic, count(*) AS learners, cast(sum(cast(trunc(round_even((1 - mastery) * 100, 6)) AS BIGINT)) AS BIGINT) // count(*) AS struggle_pct FROM m WHERE mastery < 0.55 GROUP BY 1 ORDER BY 2 DESC, 3 DESC, 1 LIMIT 20""")
def struggle_topics(spark, sf):
    m = table(spark, sf, "lineitem").groupBy((F.col("l_partkey") % 50).alias("topic"), "l_suppkey").agg(F.bround(F.avg(F.col("l_quantity") / 50), 9).alias("mastery")).where("mastery < 0.55")
    g = m.groupBy("topic").agg(F.count(F.lit(1)).alias("learners"), F.sum(F.bround((1 - F.col("mastery")) * 100, 6).cast("long")).alias("s"))
    return g.select("topic", "learners", F.expr("s div learners").alias("struggle_pct")).orderBy(F.col("learners").desc(), F.col("struggle_pct").desc(), "topic").limit(20)


@query("""WITH c AS (SELECT event_id, ts AS valid_from, ts + INTERVAL 6 HOURS AS expires_at, user_id FROM events WHERE event_type = 'view'), a AS (SELECT event_id AS asked, ts AS asked_at, user_id FROM events WHERE event_type = 'click')
SELECT asked, max_by(c.event_id, (valid_from, c.event_id)) AS cached FROM a JOIN c ON a.user_id = c.user_id AND valid_from <= asked_at AND expires_at > asked_at GROUP BY 1""")
def ttl_validity_join(spark, sf):
    """The cache entry that was valid at each question: the user's last one, if it had not expired."""
    e = table(spark, sf, "events")
    entries = e.where("event_type = 'view'").select("user_id", F.col("ts").alias("valid_from"), "event_id", (F.col("ts") + F.expr("INTERVAL 6 HOURS")).alias("expires_at"))
    asked = e.where("event_type = 'click'").select(F.col("event_id").alias("asked"), "ts", "user_id")
    found = R.as_of(asked, entries, "user_id", "ts", "valid_from").where(F.col("_entry.expires_at") > F.col("ts"))
    return found.select("asked", F.col("_entry.event_id").alias("cached"))


@query("""WITH m AS (SELECT user_id, avg(value) AS mean, max(value) AS top, min(value) AS low FROM events GROUP BY 1) SELECT user_id, key, round_even(v, 6) AS value FROM (SELECT user_id, 'mean' AS key, mean AS v FROM m UNION ALL SELECT user_id, 'top', top FROM m UNION ALL SELECT user_id, 'low', low FROM m)""")
def metric_snapshots(spark, sf):
    m = table(spark, sf, "events").groupBy("user_id").agg(F.avg("value").alias("mean"), F.max("value").alias("top"), F.min("value").alias("low"))
    return m.unpivot("user_id", ["mean", "top", "low"], "key", "value").withColumn("value", F.bround("value", 6))


@query("""WITH r AS (SELECT conv_id, turn, lower(role) AS low, role, row_number() OVER (PARTITION BY conv_id, lower(role) ORDER BY turn DESC) AS r FROM conversations), k AS (SELECT * FROM r WHERE r = 1), x AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM k)
SELECT conv_id, string_agg(role, ',' ORDER BY turn) AS recent FROM x WHERE back <= 2 GROUP BY 1""")
def recent_unique_list(spark, sf):
    """The last two distinct items of each list, whatever their case, in the order of their last use."""
    last = table(spark, sf, "conversations").groupBy("conv_id", F.lower("role").alias("low")).agg(F.max(F.struct("turn", "role")).alias("x"))
    lists = last.groupBy("conv_id").agg(F.sort_array(F.collect_list("x")).alias("xs"))
    return lists.select("conv_id", F.array_join(F.transform(F.slice("xs", F.greatest(F.size("xs") - 1, F.lit(1)), F.lit(2)), lambda x: x["role"]), ",").alias("recent"))


@query("""WITH b AS (SELECT p_partkey, p_type, 0.35e0 * (p_size % 10) + 0.25e0 * (p_partkey % 4) + 0.20e0 * length(p_name) + 0.20e0 * (p_retailprice / 1000) AS score FROM part), r AS (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY round_even(score, 6) DESC, p_partkey) AS rank FROM b)
SELECT p_type, p_partkey, round_even(score, 6) AS score, cast(rank AS INTEGER) AS rank FROM r WHERE rank <= 5""")
def rerank_weighted(spark, sf):
    score = 0.35 * (F.col("p_size") % 10) + 0.25 * (F.col("p_partkey") % 4) + 0.20 * F.length("p_name") + 0.20 * (F.col("p_retailprice") / 1000)
    b = table(spark, sf, "part").select("p_type", "p_partkey", F.bround(score, 6).alias("score"))
    return R.top_per_key(b, ["p_type"], [F.col("score").desc(), F.col("p_partkey")], 5)


@query("""WITH a AS (SELECT p_brand, p_partkey, CASE p_type WHEN 'ECONOMY' THEN 0 WHEN 'SMALL' THEN 1 ELSE 2 END AS priority, p_size FROM part), r AS (SELECT *, row_number() OVER (PARTITION BY p_brand, p_size ORDER BY priority, p_partkey) AS r FROM a) SELECT p_brand, p_size, p_partkey AS best FROM r WHERE r = 1""")
def best_asset_dedup(spark, sf):
    priority = F.when(F.col("p_type") == "ECONOMY", 0).when(F.col("p_type") == "SMALL", 1).otherwise(2)
    g = table(spark, sf, "part").groupBy("p_brand", "p_size").agg(F.min(F.struct(priority.alias("priority"), "p_partkey")).alias("x"))
    return g.select("p_brand", "p_size", F.col("x.p_partkey").alias("best"))


@query("""WITH h AS (SELECT source, doc_id, cast(contains(lower(text), 'the') AS INT) + cast(contains(lower(text), 'der') AS INT) + cast(contains(lower(text), 'que') AS INT) AS hits FROM documents), g AS (SELECT source, max(hits) AS best, count(*) FILTER (hits >= 2) AS strong FROM h GROUP BY 1)
SELECT source, cast(best AS INTEGER) AS best, strong, CASE WHEN best >= 3 THEN 'FULL' WHEN best >= 1 THEN 'PARTIAL' ELSE 'NONE' END AS level FROM g""")
def chapter_coverage_level(spark, sf):
    terms = F.array(*[F.lit(x) for x in ("the", "der", "que")])
    h = table(spark, sf, "documents").select("source", T.keyword_score(terms, F.col("text")).alias("hits"))
    g = h.groupBy("source").agg(F.max("hits").alias("best"), F.count_if(F.col("hits") >= 2).alias("strong"))
    return g.withColumn("level", F.when(F.col("best") >= 3, "FULL").when(F.col("best") >= 1, "PARTIAL").otherwise("NONE"))


@query("""SELECT * FROM (SELECT 'part' AS kind, cast(p_partkey AS BIGINT) AS id, p_name AS title FROM part WHERE p_name ILIKE '%ring%' ORDER BY p_partkey LIMIT 8) UNION ALL SELECT * FROM (SELECT 'customer', c_custkey, c_name FROM customer WHERE c_name ILIKE '%ring%' OR c_name ILIKE '%00007%' ORDER BY c_custkey LIMIT 8) UNION ALL SELECT * FROM (SELECT 'nation', cast(n_nationkey AS BIGINT), n_name FROM nation WHERE n_name ILIKE '%1%' ORDER BY 2 LIMIT 5)""")
def global_search(spark, sf):
    def found(name, key, title, texts, n):
        t = table(spark, sf, name)
        hit = F.lit(False)
        for x in texts:
            hit = hit | R.any_like([F.col(title)], x)
        return t.where(hit).orderBy(key).limit(n).select(F.lit(name).alias("kind"), F.col(key).cast("long").alias("id"), F.col(title).alias("title"))

    return found("part", "p_partkey", "p_name", ["ring"], 8).union(found("customer", "c_custkey", "c_name", ["ring", "00007"], 8)).union(found("nation", "n_nationkey", "n_name", ["1"], 5))


@query("""WITH t AS (SELECT l_orderkey, list(DISTINCT l_returnflag) AS have FROM lineitem GROUP BY 1) SELECT l_orderkey, len(list_filter(['A', 'N', 'R'], lambda x: NOT list_contains(have, x))) = 0 AS covers, array_to_string(list_filter(['A', 'N', 'R'], lambda x: NOT list_contains(have, x)), ',') AS lacking FROM t""")
def required_subset(spark, sf):
    """Whether each group has every required kind, and which it lacks."""
    want = F.array(*[F.lit(x) for x in "ANR"])
    t = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_returnflag").alias("have"))
    lacking = F.array_except(want, "have")
    return t.select("l_orderkey", (F.size(lacking) == 0).alias("covers"), F.array_join(lacking, ",").alias("lacking"))


_PHASES = """WITH c AS (SELECT event_type AS phase, CASE WHEN value > 100 THEN 'FAIL' WHEN value > 40 THEN 'WARN' ELSE 'PASS' END AS status, value FROM events) SELECT phase, ['PASS', 'WARN', 'FAIL'][max(CASE status WHEN 'FAIL' THEN 3 WHEN 'WARN' THEN 2 ELSE 1 END)] AS status, count(*) FILTER (status = 'PASS') AS passed, count(*) AS checks, round_even(sum(value), 2) AS ms FROM c GROUP BY 1"""


@query(_PHASES)
def phase_report(spark, sf):
    rank = F.when(F.col("value") > 100, 3).when(F.col("value") > 40, 2).otherwise(1)
    g = table(spark, sf, "events").withColumn("s", rank).groupBy(F.col("event_type").alias("phase")).agg(F.max("s").alias("s"), F.count_if(F.col("s") == 1).alias("passed"), F.count(F.lit(1)).alias("checks"), F.bround(F.sum("value"), 2).alias("ms"))
    return g.select("phase", F.get(F.array(*[F.lit(x) for x in ("PASS", "WARN", "FAIL")]), F.col("s") - 1).alias("status"), "passed", "checks", "ms")


@query(_PHASES)
def report_sink(spark, sf):
    """The report written as JSON lines and as one Markdown table, and read back from the latter."""
    path = scratch_path(spark, "report")
    report = phase_report(spark, sf)
    report.write.json(f"{path}/json")
    cells = ["phase", "status", "passed", "checks", "ms"]
    line = lambda xs: F.concat(F.lit("| "), F.concat_ws(" | ", *xs), F.lit(" |"))
    stored = spark.read.schema(report.schema).json(f"{path}/json")
    stored.select(line([F.col(c).cast("string") for c in cells])).write.text(f"{path}/md")
    parts = F.split(F.regexp_replace("value", r"^\| | \|$", ""), r" \| ")
    kinds = dict(report.dtypes)
    return spark.read.text(f"{path}/md").select(*[F.get(parts, F.lit(i)).cast(kinds[c]).alias(c) for i, c in enumerate(cells)])


@query("""WITH s AS (SELECT c_nationkey, c_custkey, o_orderkey, o_orderstatus FROM customer LEFT JOIN orders ON o_custkey = c_custkey) SELECT c_nationkey AS class_id, count(DISTINCT c_custkey) AS students, count(o_orderkey) AS chapters, count(*) FILTER (o_orderstatus = 'F') AS completed, CASE WHEN count(o_orderkey) > 0 AND count(*) FILTER (o_orderstatus = 'F') = count(o_orderkey) THEN 'complete' ELSE 'open' END AS status FROM s GROUP BY 1""")
def parent_child_counts(spark, sf):
    s = table(spark, sf, "customer").join(table(spark, sf, "orders"), F.col("o_custkey") == F.col("c_custkey"), "left")
    g = s.groupBy(F.col("c_nationkey").alias("class_id")).agg(F.count_distinct("c_custkey").alias("students"), F.count("o_orderkey").alias("chapters"), F.count_if(F.col("o_orderstatus") == "F").alias("completed"))
    return g.withColumn("status", F.when((F.col("chapters") > 0) & (F.col("completed") == F.col("chapters")), "complete").otherwise("open"))


@query(f"""WITH q AS (SELECT conv_id, turn, lower(coalesce(text, '')) AS q FROM conversations) SELECT conv_id, turn, CASE WHEN regexp_matches(q, '{X.WHOLE_CHAPTER}') THEN 'chapter' WHEN regexp_matches(q, '{X.BROAD}') THEN 'broad' ELSE 'narrow' END AS breadth FROM q""")
def query_breadth(spark, sf):
    """How wide each turn asks."""
    return table(spark, sf, "conversations").select("conv_id", "turn", X.breadth(F.col("text")).alias("breadth"))


@query("""WITH m AS (SELECT user_id, regr_slope(value, i) AS s FROM (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i FROM events) GROUP BY 1), e AS (SELECT user_id, count(*) FILTER (event_type = 'purchase') / count(*) AS c, count(*) FILTER (event_type = 'click') / count(*) AS g FROM events GROUP BY 1),
x AS (SELECT user_id, 0.4e0 * coalesce(s, 0) + 0.3e0 * c + 0.3e0 * g AS t FROM m JOIN e USING (user_id)) SELECT user_id, round_even(greatest(0, t), 4) AS improvement, round_even(greatest(0, -t), 4) AS regression FROM x""")
def learning_trend(spark, sf):
    o = table(spark, sf, "events").withColumn("i", (F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1).cast("double"))
    n = F.count(F.lit(1))
    share = lambda k: F.count_if(F.col("event_type") == k) / n
    x = o.groupBy("user_id").agg((0.4 * F.coalesce(F.regr_slope("value", "i"), F.lit(0.0)) + 0.3 * share("purchase") + 0.3 * share("click")).alias("t"))
    return x.select("user_id", F.bround(F.greatest(F.lit(0.0), F.col("t")), 4).alias("improvement"), F.bround(F.greatest(F.lit(0.0), -F.col("t")), 4).alias("regression"))


@query("""WITH s AS (SELECT label, vec_id, round_even(embedding[1]::DOUBLE, 4) AS y FROM embeddings), g AS (SELECT *, CASE WHEN y - lag(y) OVER (PARTITION BY label ORDER BY y, vec_id) > 0.02e0 THEN 1 ELSE 0 END AS new FROM s), c AS (SELECT *, sum(new) OVER (PARTITION BY label ORDER BY y, vec_id) AS row FROM g)
SELECT label, cast(row AS BIGINT) AS row, count(*) AS words, min(y) AS lo, max(y) AS hi FROM c GROUP BY 1, 2""")
def visual_rows(spark, sf):
    """Rows of words: a gap of more than a tolerance in the sorted coordinate starts the next one."""
    s = table(spark, sf, "embeddings").select("label", "vec_id", F.bround(F.get("embedding", F.lit(0)).cast("double"), 4).alias("y"))
    w = Window.partitionBy("label").orderBy("y", "vec_id")
    c = s.withColumn("new", F.when(F.col("y") - F.lag("y").over(w) > 0.02, 1).otherwise(0)).withColumn("row", F.sum("new").over(w))
    return c.groupBy("label", "row").agg(F.count(F.lit(1)).alias("words"), F.min("y").alias("lo"), F.max("y").alias("hi"))


