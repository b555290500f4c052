"""Rule-based labels, quotas, guidance and checks over learners, chapters and items."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import dialogue as D
from ..functions import learning as L
from ..functions import splitting as S
from ..operators import assignment as A
from ..operators import retrieval as V
from ..operators import windows as W
from ..sources.tables import table
from ._registry import query
from .retrieval import _HITS


@query("""WITH q AS (SELECT p_partkey, p_brand, round_even(1 + (p_size % 41) / 10e0, 2) AS d FROM part), b AS (SELECT *, CASE WHEN d < 2.5 THEN 'easy' WHEN d < 3.8 THEN 'medium' ELSE 'hard' END AS bucket FROM q), r AS (SELECT *, row_number() OVER (PARTITION BY p_brand, bucket ORDER BY p_partkey) AS r FROM b)
SELECT p_brand, bucket, p_partkey FROM r WHERE r <= CASE bucket WHEN 'hard' THEN 1 ELSE 2 END""")
def worksheet_quotas(spark, sf):
    """Questions of each brand in difficulty buckets, two easy, two medium and one hard."""
    d = F.bround(1 + (F.col("p_size") % 41) / 10.0, 2)
    b = table(spark, sf, "part").select("p_brand", "p_partkey", F.when(d < 2.5, "easy").when(d < 3.8, "medium").otherwise("hard").alias("bucket"))
    r = b.withColumn("r", F.row_number().over(Window.partitionBy("p_brand", "bucket").orderBy("p_partkey")))
    return r.where(F.col("r") <= F.when(F.col("bucket") == "hard", 1).otherwise(2)).select("p_brand", "bucket", "p_partkey")


@query("""SELECT c_custkey, CASE WHEN c_custkey % 14 BETWEEN 1 AND 5 THEN 'primary' WHEN c_custkey % 14 BETWEEN 1 AND 8 THEN 'middle' ELSE 'secondary' END AS band FROM customer""")
def curriculum_band(spark, sf):
    grade = F.regexp_extract(F.concat(F.lit("Class_"), (F.col("c_custkey") % 14).cast("string")), r"(?i)class[_\s]*([0-9]{1,2})", 1).cast("int")
    return table(spark, sf, "customer").select("c_custkey", F.when((grade > 0) & (grade <= 5), "primary").when((grade > 0) & (grade <= 8), "middle").otherwise("secondary").alias("band"))


@query(r"""WITH t AS (SELECT p_partkey, trim(regexp_replace(CASE WHEN p_partkey % 5 = 0 THEN p_name || ' ' || p_name WHEN p_partkey % 5 = 1 THEN split_part(p_name, ' ', 1) || ' ' || p_name WHEN p_partkey % 5 = 2 THEN 'gear' ELSE p_name END, '\s+', ' ', 'g')) AS t FROM part)
SELECT p_partkey, length(t) BETWEEN 4 AND 72 AND lower(t) NOT IN ('gear', 'science', 'maths') AND NOT (len(string_split(lower(t), ' ')) >= 2 AND string_split(lower(t), ' ')[1] = string_split(lower(t), ' ')[2]) AS meaningful FROM t""")
def meaningful_topics(spark, sf):
    k, name = F.col("p_partkey") % 5, F.col("p_name")
    raw = F.when(k == 0, F.concat_ws(" ", name, name)).when(k == 1, F.concat_ws(" ", F.split_part(name, F.lit(" "), F.lit(1)), name)).when(k == 2, "gear").otherwise(name)
    t = F.trim(F.regexp_replace(raw, r"\s+", " "))
    words = F.split(F.lower(t), " ")
    doubled = (F.size(words) >= 2) & (F.get(words, F.lit(0)) == F.coalesce(F.get(words, F.lit(1)), F.lit("")))
    return table(spark, sf, "part").select("p_partkey", (F.length(t).between(4, 72) & ~F.lower(t).isin("gear", "science", "maths") & ~doubled).alias("meaningful"))


@query(r"""WITH w(term) AS (VALUES ('ring'), ('bolt'), ('widget'), ('der')), h AS (SELECT doc_id, count(*) AS hits FROM documents, w WHERE regexp_matches(lower(text), '\b' || term || '(?:s|es|ed|d|ing|al|n|ns)?\b') GROUP BY 1) SELECT doc_id, hits FROM h""")
def inflected_term_hits(spark, sf):
    """How many of a few terms a text has as words of their own, common endings allowed."""
    low = F.lower("text")
    hits = [F.when(low.rlike(rf"\b{t}(?:s|es|ed|d|ing|al|n|ns)?\b"), 1).otherwise(0) for t in ("ring", "bolt", "widget", "der")]
    total = hits[0] + hits[1] + hits[2] + hits[3]
    return table(spark, sf, "documents").select("doc_id", total.cast("long").alias("hits")).where("hits > 0")


@query(r"""WITH s AS (SELECT doc_id, string_split_regex(text, '[.!?]\s+') AS parts FROM documents), b AS (SELECT doc_id, list_transform(parts, lambda p: length(trim(p))) AS n FROM s) SELECT doc_id, cast(len(list_filter(n, lambda x: x > 0)) AS INTEGER) AS sentences, cast(list_max(n) AS INTEGER) AS longest FROM b""")
def sentence_statistics(spark, sf):
    n = F.transform(F.split("text", r"[.!?]\s+"), lambda p: F.length(F.trim(p)))
    return table(spark, sf, "documents").select("doc_id", n.alias("n")).select("doc_id", F.size(F.filter("n", lambda x: x > 0)).alias("sentences"), F.array_max("n").alias("longest"))


@query("""WITH u AS (SELECT user_id, count(*) FILTER (event_type = 'error') / count(*) AS confusion, count(*) FILTER (event_type = 'purchase') / count(*) AS mastery, count(*) FILTER (event_type = 'click') > 2 AS quiz, avg(value) AS v FROM events GROUP BY 1),
x AS (SELECT *, CASE WHEN confusion >= 0.55 OR 0.5 < 0.4 THEN 'slow' WHEN mastery >= 0.75 AND confusion < 0.3 THEN 'fast' ELSE 'medium' END AS pace FROM u)
SELECT user_id, pace, CASE WHEN confusion >= 0.3 AND v < 8 THEN 'revision_session_recommended' WHEN confusion >= 0.25 THEN 'simplify_and_reteach' WHEN mastery < 0.1 THEN 'revise_prerequisite_then_teach' WHEN quiz THEN 'micro_quiz_check' WHEN pace = 'slow' THEN 'smaller_steps_same_topic' ELSE 'teach_current_topic' END AS action FROM x""")
def next_best_action(spark, sf):
    share = lambda k: F.count_if(F.col("event_type") == k) / F.count(F.lit(1))
    u = table(spark, sf, "events").groupBy("user_id").agg(share("error").alias("confusion"), share("purchase").alias("mastery"), (F.count_if(F.col("event_type") == "click") > 2).alias("quiz"), F.avg("value").alias("v"))
    c, m = F.col("confusion"), F.col("mastery")
    x = u.withColumn("pace", L.pace(c, F.lit(0.5), m))
    action = F.when((c >= 0.3) & (F.col("v") < 8), "revision_session_recommended").when(c >= 0.25, "simplify_and_reteach").when(m < 0.1, "revise_prerequisite_then_teach").when(F.col("quiz"), "micro_quiz_check").when(F.col("pace") == "slow", "smaller_steps_same_topic").otherwise("teach_current_topic")
    return x.select("user_id", "pace", action.alias("action"))


@query("""WITH u AS (SELECT user_id, count(*) FILTER (event_type = 'purchase') AS good, count(*) FILTER (event_type = 'error') AS bad, count(*) AS n FROM events GROUP BY 1)
SELECT user_id, array_to_string(list_filter([CASE WHEN good > bad THEN 'strong' END, CASE WHEN bad > good THEN 'weak' END, CASE WHEN n < 5 THEN 'low_engagement' END, CASE WHEN bad / n > 0.25 THEN 'needs_review' END], lambda x: x IS NOT NULL), ',') AS notes FROM u""")
def teacher_summary_rules(spark, sf):
    u = table(spark, sf, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "purchase").alias("good"), F.count_if(F.col("event_type") == "error").alias("bad"), F.count(F.lit(1)).alias("n"))
    notes = F.array_compact(F.array(F.when(F.col("good") > F.col("bad"), "strong"), F.when(F.col("bad") > F.col("good"), "weak"), F.when(F.col("n") < 5, "low_engagement"), F.when(F.col("bad") / F.col("n") > 0.25, "needs_review")))
    return u.select("user_id", F.array_join(notes, ",").alias("notes"))


@query("""WITH t AS (SELECT p_brand, list(p_type ORDER BY p_partkey) AS l FROM part GROUP BY 1), o AS (SELECT p_brand, l, len(l) % 5 AS k FROM t)
SELECT p_brand, array_to_string(list_slice(list_concat(list_slice(l, k + 1, len(l)), list_slice(l, 1, k)), 1, 2), ',') AS chosen FROM o""")
def rotated_choice(spark, sf):
    """The first two of a list turned by an offset, by their places, so that no list is built."""
    part = table(spark, sf, "part").select("p_brand", "p_type", "p_partkey")
    i = F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey")) - 1
    t = part.withColumn("i", i).join(part.groupBy("p_brand").agg(F.count(F.lit(1)).alias("n")), "p_brand")
    t = t.withColumn("place", F.pmod(F.col("i") - F.col("n") % 5, F.col("n"))).where("place < 2")
    return t.groupBy("p_brand").agg(F.array_join(W.ordered_list("p_type", "place"), ",").alias("chosen"))


@query("""WITH a AS (SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS pos FROM documents QUALIFY pos <= 10), b AS (SELECT doc_id, 10 + row_number() OVER (ORDER BY doc_id) AS pos FROM documents QUALIFY pos <= 30), u AS (SELECT doc_id, min(pos) AS pos FROM (FROM a UNION ALL FROM b) GROUP BY 1)
SELECT doc_id, cast(row_number() OVER (ORDER BY pos) AS INTEGER) AS place FROM u ORDER BY pos LIMIT 20""")
def ordered_unique_merge(spark, sf):
    d = table(spark, sf, "documents")
    a = d.orderBy(F.col("n_chars").desc(), "doc_id").limit(10).withColumn("pos", F.row_number().over(Window.orderBy(F.col("n_chars").desc(), "doc_id")))
    b = d.orderBy("doc_id").limit(20).withColumn("pos", 10 + F.row_number().over(Window.orderBy("doc_id")))
    u = a.select("doc_id", "pos").union(b.select("doc_id", "pos")).groupBy("doc_id").agg(F.min("pos").alias("pos")).orderBy("pos").limit(20)
    return u.select("doc_id", F.row_number().over(Window.orderBy("pos")).alias("place"))


@query(r"""WITH x AS (SELECT event_id, regexp_extract('Sure! ' || event_type || chr(10) || CASE WHEN event_id % 9 = 4 THEN replace(props, '}', '') ELSE props END || chr(10) || 'done', '(?s)\{.*\}') AS raw FROM events) SELECT event_id, CASE WHEN json_valid(raw) THEN cast(json_extract(raw, '$.k') AS INTEGER) END AS k FROM x""")
def json_salvage(spark, sf):
    """The first to last brace of a noisy text as JSON; null where that is none. Every ninth text has lost its end."""
    props = F.when(F.col("event_id") % 9 == 4, F.replace("props", F.lit("}"), F.lit(""))).otherwise(F.col("props"))
    raw = F.concat(F.lit("Sure! "), F.col("event_type"), F.lit("\n"), props, F.lit("\ndone"))
    return table(spark, sf, "events").select("event_id", F.get_json_object(F.regexp_extract(raw, r"(?s)(\{.*\})", 1), "$.k").try_cast("int").alias("k"))


@query("""WITH h AS (SELECT n_nationkey AS id, cast(n_regionkey + 1 AS VARCHAR) || CASE WHEN n_nationkey % 5 = 0 THEN '' ELSE '.' || cast(n_nationkey % 5 AS VARCHAR) END AS number FROM nation)
SELECT c.id AS child, min(p.id) AS parent FROM h c JOIN h p ON starts_with(c.number, p.number || '.') AND NOT contains(p.number, '.') GROUP BY 1""")
def heading_parents(spark, sf):
    """Parents by number: the joined key is the number without its last part, so no range of rows is compared."""
    number = F.concat((F.col("n_regionkey") + 1).cast("string"), F.when(F.col("n_nationkey") % 5 == 0, "").otherwise(F.concat(F.lit("."), (F.col("n_nationkey") % 5).cast("string"))))
    h = table(spark, sf, "nation").select(F.col("n_nationkey").alias("id"), number.alias("number"))
    up = h.where(F.contains("number", F.lit("."))).select(F.col("id").alias("child"), F.regexp_replace("number", r"\.[^.]*$", "").alias("number"))
    return up.join(h.withColumnRenamed("id", "parent"), "number").groupBy("child").agg(F.min("parent").alias("parent"))


@query("""WITH s AS (SELECT l_orderkey, count(DISTINCT l_returnflag) AS kinds, count(*) AS n, count(*) - count(DISTINCT l_partkey) AS doubles, min(l_quantity) AS least FROM lineitem GROUP BY 1)
SELECT l_orderkey, round_even((cast(n >= 3 AS INT) + cast(kinds >= 2 AS INT) + cast(doubles = 0 AS INT) + cast(least >= 3 AS INT)) / 4e0, 2) AS score, n >= 3 AND doubles = 0 AS ok FROM s""")
def artifact_checks(spark, sf):
    """Passed over all checks of a worksheet: enough items, kinds, no doubles, enough options."""
    s = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count_distinct("l_returnflag").alias("kinds"), F.count(F.lit(1)).alias("n"), F.count_distinct("l_partkey").alias("parts"), F.min("l_quantity").alias("least"))
    checks = [F.col("n") >= 3, F.col("kinds") >= 2, F.col("n") == F.col("parts"), F.col("least") >= 3]
    passed = sum((c.cast("int") for c in checks[1:]), checks[0].cast("int"))
    return s.select("l_orderkey", F.bround(passed / 4.0, 2).alias("score"), (checks[0] & checks[2]).alias("ok"))


@query("""WITH p AS (SELECT item_id, lower(text) AS phrase FROM benchmark) SELECT item_id, count(d.doc_id) > 0 AS found FROM p LEFT JOIN documents d ON contains(lower(d.text), phrase) GROUP BY 1""")
def golden_phrase_recall(spark, sf):
    """Which expected passages occur in any document."""
    from ..operators.matching import phrases_found

    phrases = table(spark, sf, "benchmark").select("item_id", F.lower("text").alias("phrase"))
    return phrases_found(phrases, table(spark, sf, "documents").select(F.lower("text").alias("text")))


@query("""SELECT o_orderstatus AS status, count(*) AS uploads, cast(sum(n) AS BIGINT) AS chunks, max(o_orderdate) AS newest FROM orders JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey GROUP BY 1""")
def worker_totals(spark, sf):
    n = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("n"))
    return table(spark, sf, "orders").join(n, "o_orderkey").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count(F.lit(1)).alias("uploads"), F.sum("n").alias("chunks"), F.max("o_orderdate").alias("newest"))


@query("""WITH c AS (SELECT DISTINCT c_nationkey, p_brand FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey WHERE l_returnflag = 'R' AND l_shipdate >= TIMESTAMP '2001-01-01')
SELECT c_nationkey AS class_id, sha256(array_to_string(list_sort(list(p_brand)), '|')) AS scope_key, count(*) AS subjects FROM c GROUP BY 1""")
def enrolment_scope(spark, sf):
    items = table(spark, sf, "lineitem").where((F.col("l_returnflag") == "R") & (F.col("l_shipdate") >= F.expr("TIMESTAMP_NTZ'2001-01-01 00:00:00'")))
    c = items.join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    g = c.select("c_nationkey", "p_brand").distinct().groupBy(F.col("c_nationkey").alias("class_id")).agg(F.array_sort(F.collect_list("p_brand")).alias("s"))
    return g.select("class_id", F.sha2(F.array_join("s", "|"), 256).alias("scope_key"), F.size("s").cast("long").alias("subjects"))


@query(f"""WITH {_HITS}, h AS (SELECT query, id, score, cast(rank AS INTEGER) AS rank, max(score) OVER (PARTITION BY query) AS top FROM hits WHERE rank <= CASE WHEN query % 3 = 0 THEN 16 ELSE 12 END), k AS (SELECT * FROM h WHERE top >= 0.28 AND score >= 0.5 * top),
p AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY rank) - 1 AS i, count(*) OVER (PARTITION BY query) AS n FROM k) SELECT query, id, score, rank FROM p WHERE n <= 6 OR list_contains(list_transform(range(6), lambda j: cast(round_even(j * (n - 1) / 5e0, 0) AS BIGINT)), i)""")
def tutor_retrieval(spark, sf):
    """Retrieval as the tutor does it: a width by the question, top hits, weak ones dropped, an even spread of the rest."""
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")
    q = e.where("id % 100 = 0").select(F.col("id").alias("query"), "vector", "label")
    hits = V.without_weak(V.topk_filtered(q, e, "label", 16).where(F.col("rank") <= F.when(F.col("query") % 3 == 0, 16).otherwise(12)))
    return W.spread_sample(hits.select("query", "id", "score", "rank"), ["query"], ["rank"], 6)


@query("""WITH RECURSIVE e AS (SELECT vec_id AS id, label, cast(embedding AS DOUBLE[]) AS v FROM embeddings), q AS (SELECT id AS query, label, v FROM e WHERE id % 100 = 0),
s AS (SELECT query, label, e.id, row_number() OVER (PARTITION BY query ORDER BY round_even(list_cosine_similarity(q.v, e.v), 6) DESC, e.id) AS rank FROM q JOIN e USING (label)), h AS (SELECT label, query, list(id ORDER BY rank) AS ids FROM s WHERE rank <= 8 GROUP BY 1, 2),
o AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY query) AS i FROM h), t AS (SELECT label, cast(0 AS BIGINT) AS i, cast(NULL AS BIGINT) AS query, cast([] AS BIGINT[]) AS taken, cast(NULL AS BIGINT) AS id FROM (SELECT DISTINCT label FROM o)
UNION ALL SELECT label, i, query, CASE WHEN free IS NULL THEN taken ELSE list_append(taken, free) END, free FROM (SELECT t.label, o.i, o.query, t.taken, list_filter(o.ids, lambda x: NOT list_contains(t.taken, x))[1] AS free FROM t JOIN o ON o.label = t.label AND o.i = t.i + 1))
SELECT query, id FROM t WHERE id IS NOT NULL""")
def figure_assignment(spark, sf):
    """Each topic gets its best figure that no topic before it took."""
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")
    q = e.where("id % 100 = 0").select(F.col("id").alias("query"), "vector", "label")
    return A.in_turn(V.topk_filtered(q, e, "label", 8).join(q.select("query", "label"), "query"))


@query("""WITH p AS (SELECT p_brand, p_partkey, p_name, p_size, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS i, lead(p_name, 1, 'none of these') OVER (PARTITION BY p_brand ORDER BY p_partkey) AS b, lead(p_type, 1, 'neither') OVER (PARTITION BY p_brand ORDER BY p_partkey) AS c FROM part)
SELECT p_brand AS id, cast(i AS INTEGER) AS number, 'Which of size ' || p_size || '?' AS question, array_to_string(CASE WHEN p_partkey % 3 = 0 THEN [p_name, b] ELSE [p_name, b, c] END, '|') AS options, CASE WHEN p_partkey % 5 = 0 THEN 'B' WHEN p_partkey % 7 = 0 THEN NULL ELSE 'A' END AS answer FROM p""")
def mcq_items(spark, sf):
    """Questions, options and answers of each brand's quiz in Markdown, of its parts; some answers stand in a key at the end."""
    w = Window.partitionBy("p_brand").orderBy("p_partkey")
    k, text = F.col("p_partkey"), lambda c: F.col(c).cast("string")
    p = table(spark, sf, "part").withColumns({"i": F.row_number().over(w), "b": F.lead("p_name", 1, "none of these").over(w), "c": F.lead("p_type", 1, "neither").over(w)})
    third = F.when(k % 3 == 0, "").otherwise(F.concat(F.lit("\nC) "), "c"))
    block = F.concat(text("i"), F.lit(". Which of size "), text("p_size"), F.lit("?\nA) "), "p_name", F.lit("\nB) "), "b", third, F.when((k % 5 == 0) | (k % 7 == 0), "").otherwise("\nAnswer: A"))
    key = F.when(k % 5 == 0, F.concat(text("i"), F.lit(". B\n"))).otherwise("")
    quiz = p.withColumns({"block": block, "key": key}).groupBy("p_brand").agg(F.array_join(W.ordered_list("block", "i"), "\n").alias("q"), F.array_join(W.ordered_list("key", "i"), "").alias("a"))
    items = S.quiz_items(quiz.select(F.col("p_brand").alias("id"), F.concat("q", F.lit("\n\n## Answer Key\n"), "a").alias("text")))
    return items.withColumn("options", F.array_join("options", "|"))


@query()
def longest_increasing_runs(spark, sf):
    """The longest increasing subsequence of each brand's sizes in the order of their keys."""
    lists = table(spark, sf, "part").groupBy("p_brand").agg(W.ordered_list("p_size", "p_partkey").alias("xs"))
    return lists.select("p_brand", S.longest_increasing(F.col("xs")).alias("run")).select("p_brand", F.size("run").alias("n"), F.array_join(F.transform("run", lambda x: x.cast("string")), ",").alias("run"))


_OUT = r"[^\p{L}\p{N}_]"
_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def _torn(words: str, low: str) -> str:
    """SQL of letter_spaced for a list of words and the text in lower case."""
    short, single = f"len(list_filter({words}, lambda x: length(x) <= 2))", f"len(list_filter({words}, lambda x: length(x) = 1))"
    return f"(len({words}) >= 3 AND (({single} >= 3 AND {short} >= 0.55 * len({words})) OR (len({words}) >= 4 AND {short} >= 0.7 * len({words})) OR regexp_matches({low}, '(?:^|[^a-z])(?:[a-z]\\s+){{3,}}[a-z](?:[^a-z]|\\z)')))".replace("{{", "{").replace("}}", "}").replace("\\\\", "\\")


def _tokens(text: str) -> str:
    return f"list_filter(string_split_regex({text}, '[^A-Za-z0-9]+'), lambda x: x <> '')"


def _words(text: str, n: int) -> str:
    return f"len(list_filter(string_split_regex({text}, '{_OUT}+'), lambda x: regexp_full_match(x, '[a-z]{{{n},}}')))"


@query(rf"""WITH x AS (SELECT doc_id, coalesce(text, '') AS t, lower(coalesce(text, '')) AS low, trim(lower(coalesce(text, '')), {_BLANKS}) AS c FROM documents),
y AS (SELECT *, trim(regexp_replace(trim(regexp_replace(c, '{D._LABEL}', ''), '{D._MARKS}'), '{D._TRAILING}', '\1'), '{D._MARKS}') AS body, list_filter(list_transform(string_split(c, chr(10)), lambda l: trim(l, {_BLANKS})), lambda l: l <> '') AS lines FROM x),
z AS (SELECT *, {_tokens("t")} AS tt, {_tokens("c")} AS ct, {_tokens("body")} AS bt FROM y)
SELECT doc_id, {_torn("tt", "low")} AS spaced, length(t) > 0 AND len(regexp_extract_all(t, '[0-9]')) / length(t) > 0.2 AS numeric_noise,
length(c) >= 6 AND (regexp_matches(c, '{D.CRUMBS}') OR {_torn("ct", "c")} OR (len(lines) >= 3 AND length(array_to_string(lines, '')) < 22 * len(lines))
 OR ({_words("c", 2)} >= 2 AND len(list_filter(lines, lambda l: regexp_matches(l, '\p{{L}}\z') AND length(l) < 12)) >= 2)
 OR {_torn("bt", "body")} OR ({_words("body", 3)} = 0 AND len(bt) >= 3)) AS corrupt FROM z""")
def ocr_flags(spark, sf):
    """Texts of torn letters, texts of many digits, and texts that are fragments rather than captions."""
    digits = F.try_divide(F.regexp_count("text", F.lit("[0-9]")), F.length("text"))
    return table(spark, sf, "documents").select("doc_id", D.letter_spaced(F.col("text")).alias("spaced"), F.coalesce(digits > 0.2, F.lit(False)).alias("numeric_noise"), D.corrupt_caption(F.col("text")).alias("corrupt"))


@query("""WITH e AS (SELECT doc_id, list_distinct(regexp_extract_all(text, '[A-Z][a-z]{3,}')) AS names FROM documents WHERE lang = 'en'), x AS (SELECT doc_id, names, lead(names) OVER (ORDER BY doc_id) AS next FROM e)
SELECT doc_id, cast(len(names) AS INTEGER) AS entities, round_even(coalesce(len(list_intersect(names, next)) / nullif(len(names), 0), 0), 6) AS purity FROM x WHERE next IS NOT NULL""")
def entity_purity(spark, sf):
    names = F.array_distinct(F.regexp_extract_all("text", F.lit("([A-Z][a-z]{3,})"), 1))
    e = table(spark, sf, "documents").where("lang = 'en'").select("doc_id", names.alias("names"))
    x = W.with_next(e, "doc_id", "names", "next").where("next IS NOT NULL")
    return x.select("doc_id", F.size("names").alias("entities"), F.bround(F.coalesce(F.try_divide(F.size(F.array_intersect("names", "next")), F.size("names")), F.lit(0.0)), 6).alias("purity"))


