"""Vector retrieval, ranking and evaluation: embeddings are chunks, their label the textbook they belong to."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import evaluation as E
from ..operators import retrieval as V
from ..operators import windows as W
from ..sources.scratch import scratch_path
from ..sources.tables import table
from ._registry import query

_HITS = """q AS (SELECT vec_id AS query, cast(embedding AS DOUBLE[]) AS v, label FROM embeddings WHERE vec_id % 100 = 0), s AS (SELECT query, e.vec_id AS id, round_even(list_cosine_similarity(v, cast(e.embedding AS DOUBLE[])), 6) AS score FROM q JOIN embeddings e ON e.label = q.label),
hits AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank FROM s)"""


def _hits(spark, sf, k=12):
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")
    q = e.where(F.col("id") % 100 == 0).select(F.col("id").alias("query"), "vector", "label")
    return V.topk_filtered(q, e, "label", k)


@query(f"WITH {_HITS} SELECT query, id, score, cast(rank AS INTEGER) AS rank FROM hits WHERE rank <= 12")
def vector_topk_filtered(spark, sf):
    return _hits(spark, sf)


@query(f"""WITH {_HITS}, h AS (SELECT query, id, CASE WHEN id % 11 = 0 THEN NULL ELSE score END AS score FROM hits WHERE rank <= 12 AND id <> query), t AS (SELECT *, max(score) OVER (PARTITION BY query) AS top FROM h)
SELECT query, id, score FROM t WHERE top IS NULL OR (top >= 0.28 AND (score IS NULL OR score >= 0.5 * top))""")
def weak_hit_filter(spark, sf):
    h = _hits(spark, sf).where("id <> query").select("query", "id", F.when(F.col("id") % 11 != 0, F.col("score")).alias("score"))
    return V.without_weak(h)


@query(f"""WITH {_HITS}, r AS (SELECT query, id, rank FROM hits WHERE rank <= 12 UNION ALL SELECT query, id, row_number() OVER (PARTITION BY query ORDER BY id) FROM hits WHERE rank <= 12)
SELECT query, id, round_even(sum(1.0 / (60 + rank)), 8) AS score FROM r GROUP BY 1, 2""")
def rrf_fusion(spark, sf):
    h = _hits(spark, sf)
    other = h.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy("id")))
    return V.fused(h.select("query", "id", "rank").union(other.select("query", "id", "rank"))).withColumn("score", F.bround("score", 8))


def _mmr_sql(n: int) -> str:
    """Step by step: what was picked, then the best of the rest by relevance less likeness to it."""
    ctes = [f"WITH {_HITS}, h AS (SELECT query, hits.id, 100 * score AS score, cast(embedding AS DOUBLE[]) AS v FROM hits JOIN embeddings ON vec_id = hits.id WHERE rank <= 12)", "p1 AS (SELECT query, id, v, 1 AS place FROM h QUALIFY row_number() OVER (PARTITION BY query ORDER BY score DESC, id) = 1)"]
    for k in range(2, n + 1):
        gain = f"SELECT h.query, h.id, h.v, h.score, 0.7e0 * h.score - 0.3e0 * 100 * max(list_cosine_similarity(h.v, p.v)) AS gain FROM h JOIN p{k - 1} p USING (query) WHERE NOT EXISTS (SELECT 1 FROM p{k - 1} x WHERE x.query = h.query AND x.id = h.id) GROUP BY h.query, h.id, h.v, h.score"
        ctes.append(f"p{k} AS (SELECT * FROM p{k - 1} UNION ALL SELECT query, id, v, {k} FROM (SELECT * FROM ({gain}) QUALIFY row_number() OVER (PARTITION BY query ORDER BY round_even(gain, 9) DESC, score DESC, id) = 1))")
    return ", ".join(ctes) + f" SELECT query, id, cast(place AS INTEGER) AS place FROM p{n}"


@query(_mmr_sql(5))
def mmr_select(spark, sf):
    """The five hits of each query that are relevant and unlike each other."""
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return V.diverse(_hits(spark, sf).join(e, "id").select("query", "id", (F.col("score") * 100).alias("score"), "vector"), 5)


@query("""WITH u AS (SELECT vec_id, label, list_transform(cast(embedding AS DOUBLE[]), lambda x: x / sqrt(list_dot_product(cast(embedding AS DOUBLE[]), cast(embedding AS DOUBLE[])))) AS v FROM embeddings),
p AS (SELECT label, list(x ORDER BY i) AS v FROM (SELECT label, i, avg(v[i]) AS x FROM u, range(1, 65) r(i) GROUP BY 1, 2) GROUP BY 1),
s AS (SELECT vec_id AS id, p.label, round_even(list_cosine_similarity(cast(embedding AS DOUBLE[]), p.v), 6) AS score FROM embeddings, p), b AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, label) AS r FROM s)
SELECT id, CASE WHEN score >= 0.3 THEN label END AS label, score FROM b WHERE r = 1""")
def prototype_classify(spark, sf):
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")
    return V.prototypes(e.select("id", "vector"), e.select("label", "vector"), 0.3)


@query(f"""WITH {_HITS}, h AS (SELECT *, max(score) OVER (PARTITION BY query) AS top FROM hits WHERE rank <= 12 AND id <> query), k AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS r FROM h),
c AS (SELECT *, (score >= 0.4 OR (top < 0.4 AND r = 1)) AND (r <= 2 OR (r <= 4 AND score >= top * 0.92)) AS selected FROM k)
SELECT query, id, selected, CASE WHEN selected THEN NULL WHEN score < 0.4 THEN 'below_min_score' WHEN score < top * 0.92 THEN 'below_extra_ratio' ELSE 'count_limit' END AS reason FROM c""")
def strict_select(spark, sf):
    return V.strict_selection(_hits(spark, sf).where("id <> query").select("query", "id", "score"), 0.4).select("query", "id", "selected", "reason")


@query("""WITH p AS (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS i, count(*) OVER (PARTITION BY label) AS n FROM embeddings)
SELECT label, vec_id FROM p WHERE n <= 7 OR list_contains(list_transform(range(7), lambda j: least(n - 1, cast(round_even(j * ((n - 1) / 6.0), 0) AS BIGINT))), i)""")
def spread_sample(spark, sf):
    return W.spread_sample(table(spark, sf, "embeddings").select("label", "vec_id"), ["label"], ["vec_id"], 7)


@query("""WITH r AS (SELECT p_brand, p_name, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS turn FROM part), f AS (SELECT lower(p_name) AS low, min((turn, p_brand, p_name)) AS x FROM r WHERE turn <= 48 GROUP BY 1)
SELECT x[2] AS p_brand, x[3] AS p_name FROM (SELECT struct_extract(x, 1) AS a, struct_extract(x, 2) AS b, struct_extract(x, 3) AS c, x FROM f) ORDER BY a, b LIMIT 12""".replace("x[2]", "b").replace("x[3]", "c"))
def interleave_round_robin(spark, sf):
    return W.interleaved(table(spark, sf, "part"), "p_brand", ["p_partkey"], "p_name", 12)


@query(f"""WITH {_HITS}, j AS (SELECT query, id, rank, CASE WHEN (id + query) % 3 = 0 THEN 1 ELSE 0 END AS rel FROM hits WHERE rank <= 10),
d AS (SELECT query, sum(rel) FILTER (rank <= 5) / 5.0 AS p5, max(CASE WHEN rank <= 3 THEN rel ELSE 0 END) AS hit3, coalesce(1.0 / min(rank) FILTER (rel = 1), 0) AS mrr, sum(rel / log2(rank + 1)) AS dcg, sum(rel) AS n FROM j GROUP BY 1)
SELECT query, round_even(coalesce(p5, 0), 6) AS precision_5, cast(hit3 AS INTEGER) AS hit_3, round_even(mrr, 6) AS mrr, round_even(CASE WHEN n = 0 THEN 0 ELSE dcg / (SELECT sum(1 / log2(k + 1)) FROM range(1, 11) r(k) WHERE k <= n) END, 6) AS ndcg FROM d""")
def ir_metrics(spark, sf):
    judged = _hits(spark, sf, 10).withColumn("relevant", (F.col("id") + F.col("query")) % 3 == 0)
    m = E.ranking_metrics(judged, 5, 3)
    return m.select("query", F.bround("precision", 6).alias("precision_5"), F.col("hit").alias("hit_3"), F.bround("mrr", 6).alias("mrr"), F.bround("ndcg", 6).alias("ndcg"))


_RUN = "SELECT event_type AS phase, avg(value) AS ms, count(*) FILTER (value > 10) / count(*) AS score, count(*) FILTER (value > 30) / count(*) AS top1, count(*) FILTER (value <= 1) / count(*) AS h FROM events WHERE ts {} TIMESTAMP '2024-01-16' GROUP BY 1"


@query(f"""WITH b AS ({_RUN.format('<')}), c AS ({_RUN.format('>=')}), j AS (SELECT phase, b.ms AS ms_b, c.ms AS ms_n, b.score AS score_b, c.score AS score_n, b.top1 AS top_b, c.top1 AS top_n, b.h AS h_b, c.h AS h_n FROM b JOIN c USING (phase) WHERE (SELECT count(*) FROM b FULL JOIN c USING (phase) WHERE b.ms IS NULL OR c.ms IS NULL) <= 2)
SELECT phase, 'quality_drop' AS kind, 'score' AS measure, round_even(score_b, 6) AS previous, round_even(score_n, 6) AS now FROM j WHERE score_b > 0 AND score_n < score_b - 0.01
UNION ALL SELECT phase, 'retrieval_degradation', 'retrieval_top1', round_even(top_b, 6), round_even(top_n, 6) FROM j WHERE top_b - top_n > 0.001
UNION ALL SELECT phase, 'hallucination_increase', 'hallucination_rate', round_even(h_b, 6), round_even(h_n, 6) FROM j WHERE h_n - h_b > 0.001
UNION ALL SELECT phase, 'latency_increase', 'ms', round_even(ms_b, 6), round_even(ms_n, 6) FROM j WHERE ms_b >= 5 AND ms_n > ms_b * 1.02""")
def regression_compare(spark, sf):
    """What got worse from the first half of the month to the second, phases being event types."""
    e, n = table(spark, sf, "events"), F.count(F.lit(1))
    day = F.expr("TIMESTAMP_NTZ'2024-01-16 00:00:00'")
    share = lambda p: F.count_if(p) / n
    run = lambda p: e.where(p).groupBy(F.col("event_type").alias("phase")).agg(F.avg("value").alias("ms"), share(F.col("value") > 10).alias("score"), share(F.col("value") > 30).alias("retrieval_top1"), share(F.col("value") <= 1).alias("hallucination_rate"))
    out = E.regressions(run(F.col("ts") < day), run(F.col("ts") >= day), score_drop=0.01, latency_ratio=1.02, latency_floor=5.0, retrieval_drop=0.001, hallucination_rise=0.001)
    return out.withColumns({c: F.bround(c, 6) for c in ("previous", "now")})


@query("""WITH k AS (SELECT p_partkey AS item, lower(trim(p_brand)) AS answer FROM part), a AS (SELECT l_orderkey AS submission, l_partkey AS item, CASE WHEN l_linenumber % 3 = 0 THEN NULL WHEN l_linenumber % 3 = 1 THEN ' BRAND#' || cast(l_suppkey % 25 + 1 AS VARCHAR) ELSE 'brand#' || cast(l_partkey % 25 + 1 AS VARCHAR) || ' ' END AS given FROM lineitem)
SELECT submission, count(*) AS items, count(given) AS answered, count(*) FILTER (lower(trim(given)) = answer) AS correct, round_even(100.0 * count(*) FILTER (lower(trim(given)) = answer) / count(*), 4) AS score, CASE WHEN count(given) = count(*) THEN 'graded' ELSE 'submitted' END AS status FROM a JOIN k USING (item) GROUP BY 1""")
def grade_items(spark, sf):
    key = table(spark, sf, "part").select(F.col("p_partkey").alias("item"), F.col("p_brand").alias("answer"))
    n = F.col("l_linenumber") % 3
    given = F.when(n == 1, F.concat(F.lit(" BRAND#"), (F.col("l_suppkey") % 25 + 1).cast("string"))).when(n == 2, F.concat(F.lit("brand#"), (F.col("l_partkey") % 25 + 1).cast("string"), F.lit(" ")))
    answers = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("submission"), F.col("l_partkey").alias("item"), given.alias("given"))
    return E.graded(answers, key).withColumn("score", F.bround("score", 4))


@query("""WITH o AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT event_type AS run, count(*) AS n, round_even(median(value), 4) AS median, max(value) FILTER (r = least(n, cast(floor(0.9 * n) AS BIGINT) + 1)) AS p90, round_even(avg(value), 6) AS mean, round_even(100.0 * count(*) FILTER (value >= 8) / count(*), 4) AS good_pct FROM o GROUP BY 1""")
def run_statistics(spark, sf):
    return E.run_statistics(table(spark, sf, "events").select(F.col("event_type").alias("run"), "value"), "run", "value", 8.0)


@query(r"""WITH p AS (SELECT conv_id, turn, text, coalesce(lag(text) OVER (PARTITION BY conv_id ORDER BY turn), '') AS ctx FROM conversations), t AS (SELECT conv_id, turn, text, lower(ctx) AS c, list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda w: length(w) > 2 AND NOT list_contains(['the','a','an','and','or','to','of','in','on','for','is','are','was','were','be','as','by','with','that','this','it','from'], w)) AS w, regexp_extract_all(text, '[A-Za-z]+') AS words, list_filter(regexp_extract_all(text, '\b[0-9]{4}\b'), lambda y: NOT contains(lower(ctx), y)) AS years FROM p),
x AS (SELECT conv_id, turn, CASE WHEN trim(c) = '' OR len(w) = 0 THEN 0.0 ELSE len(list_filter(w, lambda z: contains(c, z))) / len(w) END AS g, CASE WHEN len(words) = 0 THEN 0.0 ELSE greatest(0.0, least(1.0, 1.0 - (list_sum(list_transform(words, lambda z: length(z))) / len(words) - 8.5) / 5.0)) END AS grade, CASE WHEN text = '' THEN 0.0 WHEN regexp_matches(text, '(?i)(page\s*[0-9]+|fig(ure)?\.?\s*[0-9]+|chapter\s*[0-9]+)') THEN 1.0 ELSE 0.5 END AS cite, length(text) BETWEEN 40 AND 8000 AS ok, len(years) AS flags FROM t)
SELECT conv_id, turn, round_even(greatest(0.0, least(1.0, 0.25 * g + 0.25 + 0.2 + 0.1 * grade + 0.1 * cite + CASE WHEN ok THEN 0.1 ELSE 0.0 END - least(0.5, 0.1 * flags))), 6) AS score FROM x""")
def tutor_score(spark, sf):
    p = table(spark, sf, "conversations").withColumn("ctx", F.coalesce(F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn")), F.lit("")))
    return p.select("conv_id", "turn", F.bround(E.tutor_score(F.col("text"), F.col("ctx")), 6).alias("score"))


@query("""SELECT label, count(*) AS vectors, cast(sum(vec_id) AS BIGINT) AS ids, round_even(sum(list_sum(list_transform(embedding, lambda x: cast(x AS DOUBLE)))), 4) AS total, cast(0 AS BIGINT) AS lost FROM embeddings GROUP BY 1""")
def vector_migration(spark, sf):
    """All vectors moved to another format, a part for each label, with what each part holds and what it has lost."""
    path = scratch_path(spark, "vectors")
    source = table(spark, sf, "embeddings").select("vec_id", "label", "embedding")
    source.write.partitionBy("label").orc(path)
    moved = spark.read.schema(source.schema).orc(path)
    digest = F.xxhash64("embedding")
    have = moved.select("vec_id", digest.alias("moved"))
    checked = source.select("vec_id", "label", "embedding", digest.alias("own")).join(have, "vec_id", "left")
    total = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double"))
    lost = F.sum((F.col("moved").isNull() | (F.col("moved") != F.col("own"))).cast("long"))
    return checked.groupBy("label").agg(F.count(F.lit(1)).alias("vectors"), F.sum("vec_id").alias("ids"), F.bround(F.sum(total), 4).alias("total"), lost.alias("lost"))
