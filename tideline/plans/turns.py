"""Turns of conversations and lines of contents: types, counts, scores, logical pages, parsers in competition."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import turns as Q
from ..sources import docx as D
from ..sources.tables import table
from ._registry import query

def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_KINDS = " ".join(f"WHEN regexp_matches(q, {_quoted(p)}) THEN {_quoted(k)}" for k, p in Q.ANSWER_TYPES.items())
_COUNT = rf"regexp_extract(q, {_quoted(Q.COUNT)}, 1)"


@query(rf"""WITH p AS (SELECT conv_id, turn, lower(coalesce(text, '')) AS q FROM conversations), n AS (SELECT *, {_COUNT} AS w, regexp_matches(q, {_quoted(Q.COMPLAINT)}) AS complaint FROM p), v AS (SELECT *, CASE w {' '.join(f"WHEN '{k}' THEN {v}" for k, v in Q.NUMBER_WORDS.items())} ELSE try_cast(w AS INTEGER) END AS v FROM n)
SELECT conv_id, turn, CASE {_KINDS} ELSE 'short-answer' END AS kind, cast(CASE WHEN v IS NOT NULL THEN least(10, v) END AS INTEGER) AS wanted, complaint,
trim(q, ' ') = '' OR complaint OR (regexp_matches(q, {_quoted(Q.ASKS)}) AND ends_with(rtrim(q, ' '), '?')) AS non_answer FROM v""")
def turn_rules(spark, sf):
    """What each turn asks for, how much of it, and whether it complains or answers nothing."""
    q = F.lower(F.coalesce("text", F.lit("")))
    return table(spark, sf, "conversations").select("conv_id", "turn", Q.answer_type(q).alias("kind"), Q.requested_count(q).cast("int").alias("wanted"), Q.is_complaint(q).alias("complaint"), Q.is_non_answer(q).alias("non_answer"))


@query("""WITH x AS (SELECT conv_id, turn, lower(text) AS a, list_filter(['the', 'der', 'que', 'les'], lambda k: contains(lower(text), k)) AS h, list_filter(['idiot', 'scum'], lambda k: contains(lower(text), k)) AS b FROM conversations WHERE role = 'assistant'),
s AS (SELECT conv_id, turn, len(h) AS hits, len(b) AS bad, length(a) AS n, CASE WHEN length(a) < 40 THEN 2e0 WHEN length(a) > 80 THEN 7e0 ELSE 5e0 END AS base FROM x), k AS (SELECT *, CASE WHEN hits > 0 THEN least(10e0, base + 1.5e0 * hits) ELSE greatest(1e0, base - 3e0) END AS kept FROM s)
SELECT conv_id, turn, CASE WHEN bad > 0 THEN greatest(1e0, kept - 2.5e0 * bad) ELSE kept END AS score, round_even(10e0 * hits / 4, 1) AS expect, cast((n < 40)::INT + (hits = 0)::INT + (bad > 0)::INT AS INTEGER) AS bugs FROM k""")
def turn_scores(spark, sf):
    words = lambda *xs: F.array(*[F.lit(x) for x in xs])
    s = Q.answer_score(F.col("text"), words("the", "der", "que", "les"), words("idiot", "scum"))
    return table(spark, sf, "conversations").where("role = 'assistant'").select("conv_id", "turn", s.alias("s")).select("conv_id", "turn", "s.score", "s.expect", F.size("s.bugs").alias("bugs"))


@query("""WITH l AS (SELECT doc_id, trim(unnest(string_split(text, chr(10))), ' ') AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents), f AS (SELECT *, length(line) < 25 AS h FROM l WHERE line <> ''),
g AS (SELECT *, count(*) FILTER (h) OVER (PARTITION BY doc_id ORDER BY i) AS part FROM f), p AS (SELECT doc_id, part, max(line) FILTER (h) AS section, string_agg(line, chr(10) || chr(10) ORDER BY i) FILTER (NOT h) AS text FROM g GROUP BY 1, 2),
w AS (SELECT doc_id, cast(row_number() OVER (PARTITION BY doc_id ORDER BY part) - 1 AS INTEGER) AS page, section, text FROM p WHERE text IS NOT NULL UNION ALL SELECT doc_id, 0, NULL, string_agg(line, chr(10) || chr(10) ORDER BY i) FROM g GROUP BY doc_id HAVING bool_and(h))
SELECT doc_id, page, section, length(text) AS chars, md5(text) AS digest FROM w""")
def logical_pages(spark, sf):
    """Texts cut to pages that each begin at a heading, here a short line."""
    lines = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "text")).withColumn("heading", F.length(F.trim("text")) < 25)
    return D.logical_pages(lines, "doc_id", "i").select("doc_id", "page", "section", F.length("text").cast("long").alias("chars"), F.md5("text").alias("digest"))


@query(r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents), a AS (SELECT *, regexp_replace(line, '^\s*(?:(?:[cC][hH][aA][pP][tT][eE][rR]|[uU][nN][iI][tT])\s+)?[0-9]+(?:\.[0-9]+)*[.):]?\s+', '') AS x FROM l)
SELECT doc_id, cast(i - 1 AS INTEGER) AS i, trim(regexp_replace(regexp_replace(x, '(^|[\s.])[\s.]*[0-9]{1,4}\s*\z', ''), '\s+', ' ', 'g'), ' ') AS title FROM a WHERE regexp_matches(line, '[0-9]')""")
def contents_titles(spark, sf):
    """Lines with digits as lines of contents: numbers in front, dot leaders and page numbers taken off."""
    lines = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line")).where(F.col("line").rlike("[0-9]"))
    return lines.select("doc_id", "i", Q.clean_title(F.col("line")).alias("title"))


@query("""WITH r AS (SELECT 'by_size' AS parser, p_brand, p_partkey AS i, p_size AS page FROM part UNION ALL SELECT 'by_key', p_brand, p_partkey, p_partkey % 97 FROM part), s AS (SELECT *, page > lag(page) OVER (PARTITION BY p_brand, parser ORDER BY i) AS up FROM r), c AS (SELECT p_brand, parser, count(*) FILTER (up) AS score FROM s GROUP BY 1, 2)
SELECT p_brand, max_by(parser, (score, CASE parser WHEN 'by_size' THEN 1 ELSE 0 END)) AS parser, max(score) AS score FROM c GROUP BY 1""")
def parser_tournament(spark, sf):
    """Of several readings of the same rows, the one whose pages rise most often; the earlier one on ties."""
    p = table(spark, sf, "part")
    a = p.select(F.lit("by_size").alias("parser"), "p_brand", F.col("p_partkey").alias("i"), F.col("p_size").cast("long").alias("page"))
    b = p.select(F.lit("by_key").alias("parser"), "p_brand", F.col("p_partkey").alias("i"), (F.col("p_partkey") % 97).alias("page"))
    up = F.col("page") > F.lag("page").over(Window.partitionBy("p_brand", "parser").orderBy("i"))
    c = a.union(b).withColumn("up", up).groupBy("p_brand", "parser").agg(F.count_if("up").alias("score"))
    order = F.when(F.col("parser") == "by_size", 1).otherwise(0)
    best = c.groupBy("p_brand").agg(F.max(F.struct("score", order.alias("o"), "parser")).alias("x"))
    return best.select("p_brand", F.col("x.parser").alias("parser"), F.col("x.score").alias("score"))


@query("""WITH s AS (SELECT doc_id, source, CASE WHEN contains(lower(text), 'license') THEN 0 WHEN n_chars > 2000 THEN 1 ELSE 2 END AS stage, n_chars FROM documents), r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY stage, n_chars DESC, doc_id) AS r FROM s) SELECT source, doc_id, cast(stage AS INTEGER) AS stage FROM r WHERE r <= 6""")
def staged_selection(spark, sf):
    """Mandatory rows first, then supporting ones, each stage by its own measure, up to a number."""
    stage = F.when(F.contains(F.lower("text"), F.lit("license")), 0).when(F.col("n_chars") > 2000, 1).otherwise(2)
    s = table(spark, sf, "documents").select("source", "doc_id", stage.alias("stage"), "n_chars")
    r = s.withColumn("r", F.row_number().over(Window.partitionBy("source").orderBy("stage", F.col("n_chars").desc(), "doc_id")))
    return r.where("r <= 6").select("source", "doc_id", "stage")


@query(r"""WITH s AS (SELECT conv_id, turn, list_filter(list_transform(string_split_regex(text, '[.!?]'), lambda x: len(regexp_extract_all(x, '\S+'))), lambda n: n > 0) AS n FROM conversations WHERE role = 'assistant')
SELECT conv_id, turn, round_even(coalesce(list_sum(n) / nullif(len(n), 0), 0), 4) AS words_per_sentence, coalesce(list_max(n), 0) > 25 AS too_long FROM s""")
def struggling_reader_rubric(spark, sf):
    n = F.filter(F.transform(F.split("text", "[.!?]"), lambda x: F.regexp_count(x, F.lit(r"\S+"))), lambda k: k > 0)
    total = F.aggregate("n", F.lit(0), lambda s, k: s + k)
    return table(spark, sf, "conversations").where("role = 'assistant'").select("conv_id", "turn", n.alias("n")).select("conv_id", "turn", F.bround(F.coalesce(F.try_divide(total, F.size("n")), F.lit(0.0)), 4).alias("words_per_sentence"), (F.coalesce(F.array_max("n"), F.lit(0)) > 25).alias("too_long"))
