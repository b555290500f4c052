"""Document preparation, text scores and classifiers over documents, pages and conversations."""

from __future__ import annotations


from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import splitting
from ..functions import text as T
from ..functions.sql import register
from ..operators import relational as R
from ..operators import typos as X
from ..operators import windows as W
from ..sources.tables import table
from ._registry import query

BOILERPLATE = ["All rights reserved", "Not for sale", "Licensed under"]


@query(r"""SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), 'All rights reserved[^\n]*', '', 'gi'), 'Not for sale[^\n]*', '', 'gi'), 'Licensed under[^\n]*', '', 'gi'), '\b([a-zA-Z]{2,})-[ \t]*\n\s*([a-zA-Z]{2,})\b', '\1\2', 'g'), '\n{3,}', chr(10) || chr(10), 'g')) AS cleaned FROM documents""")
def doc_clean(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.cleaned(F.col("text"), BOILERPLATE).alias("cleaned"))


@query(r"""WITH l AS (SELECT source, doc_id, unnest(string_split(text, chr(10))) AS line FROM documents), n AS (SELECT source, count(*) AS docs FROM documents GROUP BY 1)
SELECT source, trim(line) AS line, count(DISTINCT doc_id) AS docs FROM l WHERE trim(line) <> '' GROUP BY 1, 2 HAVING count(DISTINCT doc_id) >= greatest(2, floor(0.05 * (SELECT docs FROM n WHERE n.source = l.source)))""")
def boilerplate_lines(spark, sf):
    """Lines in a twentieth of a source's documents, and in two at least."""
    docs = table(spark, sf, "documents")
    lines = docs.select("source", "doc_id", F.explode(F.array_distinct(F.transform(F.split("text", "\n"), lambda x: F.trim(x)))).alias("line")).where("line <> ''")
    n = docs.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    g = lines.groupBy("source", "line").agg(F.count_distinct("doc_id").alias("docs"))
    return g.join(n, "source").where(F.col("docs") >= F.greatest(F.lit(2), F.floor(0.05 * F.col("n")))).select("source", "line", "docs")


@query()
def doc_chunks(spark, sf):
    """Recursive splitting at paragraphs, lines, sentences and words, with overlap."""
    return splitting.chunks(table(spark, sf, "documents").select("doc_id", "text"), 512, 51)


@query("""WITH x AS (SELECT source, doc_id, CASE WHEN doc_id % 7 = 0 THEN 'H' || cast(doc_id AS VARCHAR) END AS title, CASE WHEN doc_id % 7 = 0 THEN cast(doc_id % 3 AS INTEGER) END AS level FROM documents)
SELECT source, doc_id, coalesce(title, last_value(title IGNORE NULLS) OVER w) AS title, coalesce(level, last_value(level IGNORE NULLS) OVER w) AS level FROM x WINDOW w AS (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def section_forward_fill(spark, sf):
    heading = F.col("doc_id") % 7 == 0
    x = table(spark, sf, "documents").select("source", "doc_id", F.when(heading, F.concat(F.lit("H"), F.col("doc_id").cast("string"))).alias("title"), F.when(heading, (F.col("doc_id") % 3).cast("int")).alias("level"))
    return W.forward_filled(x, ["source"], ["doc_id"], ["title", "level"])


@query(r"""WITH x AS (SELECT doc_id, greatest(1, length(text) // 4) AS n, regexp_matches(trim(text), '[A-Za-z]-\s*$') AS hyphen, regexp_matches(text, '(?:^|\n)\s*(?:[-*]|[0-9]+[.)])\s*$') AS lst FROM documents)
SELECT doc_id, cast(n AS INTEGER) AS tokens, n < 50 AS too_small, n > 1200 AS too_large, round_even(1e0 - 0.2e0 * (cast(n < 50 AS INT) + cast(n > 1200 AS INT) + cast(hyphen AS INT) + cast(lst AS INT)), 2) AS score FROM x""")
def chunk_quality(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", T.token_length(F.col("text")).alias("tokens"), T.chunk_issues(F.col("text")).alias("issues"))
    has = lambda x: F.array_contains("issues", x)
    return rows.select("doc_id", "tokens", has("too_small").alias("too_small"), has("too_large").alias("too_large"), F.bround(F.greatest(F.lit(0.0), 1.0 - 0.2 * F.size("issues")), 2).alias("score"))


@query(r"""WITH x AS (SELECT conv_id, turn, regexp_replace('auth: Bearer abc.def-' || cast(turn AS VARCHAR) || '= ' || text || ' bearer x/' || cast(conv_id AS VARCHAR), '(?i)(bearer\s+)[A-Za-z0-9\-._~+/]+=*', '\1[REDACTED]', 'g') AS t FROM conversations)
SELECT conv_id, turn, CASE WHEN length(t) > 2000 THEN substring(t, 1, 2000) || '…[truncated]' ELSE t END AS redacted FROM x""")
def redact_text(spark, sf):
    text = F.concat(F.lit("auth: Bearer abc.def-"), F.col("turn").cast("string"), F.lit("= "), F.col("text"), F.lit(" bearer x/"), F.col("conv_id").cast("string"))
    return table(spark, sf, "conversations").select("conv_id", "turn", T.redacted(text).alias("redacted"))


def _bloom_sql(text: str) -> str:
    hits = ", ".join(f"len(regexp_extract_all(lower({text}), '\\b({verbs})\\b'))" for verbs in T.BLOOM.values())
    names = ", ".join(f"'{x}'" for x in T.BLOOM)
    return f"CASE WHEN list_max([{hits}]) = 0 THEN 'understand' ELSE ([{names}])[list_position([{hits}], list_max([{hits}]))] END"


@query(f"SELECT doc_id, {_bloom_sql('CASE doc_id % 4 WHEN 0 THEN ' + chr(39) + 'compare and define ' + chr(39) + ' || text WHEN 1 THEN ' + chr(39) + 'Design, create; solve ' + chr(39) + ' || text ELSE text END')} AS level FROM documents")
def bloom_level(spark, sf):
    k = F.col("doc_id") % 4
    text = F.when(k == 0, F.concat(F.lit("compare and define "), "text")).when(k == 1, F.concat(F.lit("Design, create; solve "), "text")).otherwise(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", T.bloom(text).alias("level"))


@query(f"""WITH x AS (SELECT doc_id, {_bloom_sql('text')} AS level, len(regexp_extract_all(text, '\\S+')) AS n FROM documents)
SELECT doc_id, round_even(least(5e0, greatest(1e0, CASE level WHEN 'remember' THEN 1e0 WHEN 'understand' THEN 2e0 WHEN 'apply' THEN 3e0 WHEN 'analyze' THEN 3.5e0 WHEN 'evaluate' THEN 4e0 WHEN 'create' THEN 4.5e0 ELSE 2.5e0 END + 0.18e0 + least(1e0, n / 200e0) * 0.2e0)), 4) AS difficulty FROM x""")
def difficulty(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.difficulty(T.bloom(F.col("text")), F.regexp_count("text", F.lit(r"\S+")), digits=4).alias("difficulty"))


@query(r"SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS text FROM pages")
def page_markup_strip(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.markup_stripped(F.col("html")).alias("text"))


@query("SELECT sha256(text) AS digest, min(doc_id) AS kept, count(*) AS copies FROM documents GROUP BY 1 HAVING count(*) > 1")
def content_hash_dedup(spark, sf):
    g = table(spark, sf, "documents").groupBy(F.sha2("text", 256).alias("digest")).agg(F.min("doc_id").alias("kept"), F.count(F.lit(1)).alias("copies"))
    return g.where("copies > 1")


@query("""WITH t AS (SELECT conv_id, turn, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM conversations), p AS (SELECT conv_id, turn, w, lag(w) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM t)
SELECT conv_id, turn, round_even(coalesce(len(list_intersect(w, b)) / nullif(len(list_distinct(list_concat(w, b))), 0), 0), 6) AS jaccard FROM p WHERE b IS NOT NULL""")
def token_jaccard(spark, sf):
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("([a-z0-9]+)"), 1))
    p = table(spark, sf, "conversations").select("conv_id", "turn", words.alias("w")).withColumn("b", F.lag("w").over(Window.partitionBy("conv_id").orderBy("turn")))
    return p.where("b IS NOT NULL").select("conv_id", "turn", F.bround(T.jaccard(F.col("w"), F.col("b")), 6).alias("jaccard"))


@query(r"""WITH n AS (SELECT p_partkey AS id, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')) AS hay FROM part),
q AS (SELECT p_partkey AS query, trim(regexp_replace(lower(p_name[1:1] || p_name[3:3] || p_name[2:2] || left(p_name[4:], -1)), '[^a-z0-9]+', ' ', 'g')) AS want FROM part WHERE p_partkey % 100 = 0),
t AS (SELECT query, id, want, hay, list_transform(string_split(want, ' ')[1:8], lambda x: len(list_filter(string_split(hay, ' '), lambda w: starts_with(w, x) OR damerau_levenshtein(x, w) <= CASE WHEN length(x) <= 3 THEN 0 WHEN length(x) <= 6 THEN 1 ELSE 2 END OR damerau_levenshtein(x, left(w, length(x))) <= CASE WHEN length(x) <= 3 THEN 0 WHEN length(x) <= 6 THEN 1 ELSE 2 END)) > 0) AS ok FROM q, n)
SELECT query, id FROM t WHERE contains(replace(hay, ' ', ''), replace(want, ' ', '')) OR NOT list_contains(ok, false)""")
def fuzzy_search(spark, sf):
    """All part names against every hundredth one with two letters swapped and its last one lost."""
    part, name = table(spark, sf, "part"), F.col("p_name")
    misspelt = F.concat(F.substring(name, 1, 1), F.substring(name, 3, 1), F.substring(name, 2, 1), F.expr("substring(p_name, 4, greatest(length(p_name) - 4, 0))"))
    queries = part.where("p_partkey % 100 = 0").select(F.col("p_partkey").alias("query"), misspelt.alias("said"))
    return X.forgiving_search(part.select(F.col("p_partkey").alias("id"), name.alias("text")), queries)


@query("""WITH d AS (SELECT doc_id, cast(('the' IN lower(text))::INT + ('and' IN lower(text))::INT + ('der' IN lower(text))::INT + ('que' IN lower(text))::INT + ('license' IN lower(text))::INT AS INTEGER) AS score FROM (SELECT doc_id, text FROM documents))
SELECT doc_id, score FROM d WHERE score > 0 ORDER BY score DESC, doc_id LIMIT 20""".replace("('the' IN lower(text))", "contains(lower(text), 'the')").replace("('and' IN lower(text))", "contains(lower(text), 'and')").replace("('der' IN lower(text))", "contains(lower(text), 'der')").replace("('que' IN lower(text))", "contains(lower(text), 'que')").replace("('license' IN lower(text))", "contains(lower(text), 'license')"))
def keyword_topk(spark, sf):
    terms = T.query_terms(F.lit("The license AND der que, 1 x 12 the"))
    scored = table(spark, sf, "documents").select("doc_id", T.keyword_score(terms, F.col("text")).alias("score"))
    return scored.where("score > 0").orderBy(F.col("score").desc(), "doc_id").limit(20)


@query("""WITH c AS (SELECT conv_id, turn, role, trim(text) AS text FROM conversations WHERE role IN ('user', 'assistant') AND trim(text) <> ''),
n AS (SELECT *, lead(role) OVER w AS next_role, lead(text) OVER w AS next_text FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, turn, text AS question, CASE WHEN next_role = 'assistant' THEN next_text ELSE '' END AS answer FROM n WHERE role = 'user' AND (next_role = 'assistant' OR next_role IS NULL)""")
def turn_pairs(spark, sf):
    return splitting.turn_pairs(table(spark, sf, "conversations"))


@query("""WITH c AS (SELECT conv_id, turn, role, trim(text) AS text FROM conversations WHERE role IN ('user', 'assistant') AND trim(text) <> ''),
n AS (SELECT *, lead(role) OVER w AS next_role, lead(text) OVER w AS next_text FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn)), p AS (SELECT conv_id, turn, text AS question, CASE WHEN next_role = 'assistant' THEN next_text ELSE '' END AS answer FROM n WHERE role = 'user' AND (next_role = 'assistant' OR next_role IS NULL)),
l AS (SELECT conv_id, turn, left(question, 80) AS topic, CASE WHEN answer <> '' THEN 'Student: ' || left(question, 120) || '. Tutor: ' || left(answer, 160) ELSE 'Student asked: ' || left(question, 120) END AS line FROM p)
SELECT conv_id, right(string_agg(line, chr(10) ORDER BY turn), 1200) AS summary, [max_by(topic, turn)] AS last_topic, cast(count(DISTINCT topic) AS INTEGER) AS n_topics FROM l GROUP BY 1""")
def conversation_memory(spark, sf):
    """A bounded summary and the recent topics of each conversation, folded over its question and answer pairs."""
    pairs = splitting.turn_pairs(table(spark, sf, "conversations"))
    line = F.when(F.col("answer") != "", F.concat(F.lit("Student: "), F.substring("question", 1, 120), F.lit(". Tutor: "), F.substring("answer", 1, 160))).otherwise(F.concat(F.lit("Student asked: "), F.substring("question", 1, 120)))
    g = pairs.withColumn("line", line).withColumn("topic", F.substring("question", 1, 80)).groupBy("conv_id").agg(W.ordered_list("line", "turn").alias("lines"), W.ordered_list("topic", "turn").alias("topics"))
    summary = F.aggregate("lines", F.lit(""), lambda s, x: F.right(F.concat_ws("\n", F.nullif(s, F.lit("")), x), F.lit(1200)))
    return g.select("conv_id", summary.alias("summary"), F.slice(F.reverse(F.array_distinct(F.reverse("topics"))), -1, 1).alias("last_topic"), F.size(F.array_distinct("topics")).alias("n_topics"))


def _spoken(text: str) -> str:
    """SQL of splitting.spoken: single blanks become two, so that each filler has blanks of its own to match."""
    out, border = f"lower(coalesce({text}, ''))", r"[^\p{L}\p{N}_]"
    for words, by in (("you''?re", "you are"), ("i''m", "i am")):
        out = rf"regexp_replace({out}, '(^|{border}){words}($|{border})', '\1{by}\2', 'g')"
    out = rf"' ' || regexp_replace(trim(regexp_replace({out}, '[^\p{{L}}\p{{N}}_\s]', ' ', 'g')), '\s+', '  ', 'g') || ' '"
    fillers = splitting.FILLERS.replace(" ", "  ")
    return rf"trim(regexp_replace(regexp_replace({out}, ' (?:{fillers}) ', ' ', 'g'), '\s+', ' ', 'g'))"


@query(rf"""WITH c AS (SELECT conv_id, turn, role, text, lag(text) OVER w AS before, lag(role) OVER w AS who FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
s AS (SELECT conv_id, turn, {_spoken("text")} AS u, {_spoken("before")} AS a, list_transform(string_split_regex(coalesce(before, ''), '[.!?]+'), lambda x: {_spoken("x")}) AS said FROM c WHERE role = 'user' AND who = 'assistant'),
w AS (SELECT *, list_filter(string_split(u, ' '), lambda x: length(x) > 2) AS uw, list_filter(string_split(a, ' '), lambda x: length(x) > 2) AS aw FROM s),
p AS (SELECT *, list_transform(uw[2:], lambda x, i: uw[i] || ' ' || x) AS up, list_transform(aw[2:], lambda x, i: aw[i] || ' ' || x) AS ap, list_transform(list_filter(aw, lambda x: length(x) >= 6), lambda x: left(x, 6)) AS stems FROM w),
r AS (SELECT *, len(list_filter(uw, lambda x: list_contains(aw, x) OR (length(x) >= 6 AND list_contains(stems, left(x, 6))))) / nullif(len(uw), 0) AS recall, len(list_intersect(uw, aw)) / nullif(len(list_distinct(list_concat(uw, aw))), 0) AS shared, coalesce(len(list_intersect(up, ap)) / nullif(len(list_distinct(up)), 0), 0) AS pairs FROM p)
SELECT conv_id, turn, round_even(CASE WHEN length(u) < 3 OR a = '' THEN 0e0 WHEN len(string_split(u, ' ')) BETWEEN 2 AND 6 AND len(list_filter(said, lambda x: x = u OR starts_with(x, u || ' '))) > 0 THEN 1e0
WHEN (contains(a, u) AND (len(uw) >= 4 OR length(u) >= 28)) OR (length(left(a, 120)) >= 24 AND contains(u, left(a, 120))) THEN 1e0 WHEN len(uw) <= 3 THEN 0e0 ELSE greatest(recall, 0.55e0 * recall + 0.25e0 * shared + 0.20e0 * pairs) END, 6) AS echo FROM r""")
def echo_similarity(spark, sf):
    """How far a user's turn repeats the assistant's turn before it."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = table(spark, sf, "conversations").withColumn("before", F.lag("text").over(w)).withColumn("who", F.lag("role").over(w)).where("role = 'user' AND who = 'assistant'")
    return c.select("conv_id", "turn", F.bround(splitting.echo(F.col("text"), F.col("before")), 6).alias("echo"))


@query("""WITH p AS (SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS ctx FROM conversations), t AS (SELECT conv_id, turn, lower(coalesce(ctx, '')) AS ctx, list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda w: length(w) > 2 AND NOT list_contains(['the','a','an','and','or','to','of','in','on','for','is','are','was','were','be','as','by','with','that','this','it','from'], w)) AS w FROM p)
SELECT conv_id, turn, round_even(CASE WHEN trim(ctx) = '' OR len(w) = 0 THEN 0.0 ELSE len(list_filter(w, lambda x: contains(ctx, x))) / len(w) END, 6) AS groundedness FROM t""")
def groundedness(spark, sf):
    p = table(spark, sf, "conversations").withColumn("ctx", F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn")))
    return p.select("conv_id", "turn", F.bround(T.groundedness(F.col("text"), F.col("ctx")), 6).alias("groundedness"))


@query("""WITH s AS (SELECT lang, source, count(*) AS n FROM documents GROUP BY 1, 2), t AS (SELECT lang, source FROM s QUALIFY row_number() OVER (PARTITION BY lang ORDER BY n DESC, source) = 1)
SELECT d.lang, count(*) AS n, any_value(t.source) AS top_source, cast(round_even(median(n_chars), 0) AS BIGINT) AS median_chars, round_even(avg(n_chars), 4) AS mean_chars FROM documents d LEFT JOIN t ON t.lang IS NOT DISTINCT FROM d.lang GROUP BY 1""")
def source_profile(spark, sf):
    d = table(spark, sf, "documents")
    return d.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.mode("source", deterministic=True).alias("top_source"), F.bround(F.median("n_chars")).cast("long").alias("median_chars"), F.bround(F.avg("n_chars"), 4).alias("mean_chars"))


@query("""WITH h AS (SELECT vec_id AS id, list_sum(list_transform(range(64), lambda i: CASE WHEN embedding[i + 1] > 0 THEN CASE WHEN i = 63 THEN (-9223372036854775808)::BIGINT ELSE cast(1::BIGINT << i::INT AS BIGINT) END ELSE 0 END))::BIGINT AS bits FROM embeddings)
SELECT x.id AS a, y.id AS b, cast(bit_count(xor(x.bits, y.bits)) AS INTEGER) AS distance FROM h x JOIN h y ON x.id < y.id AND bit_count(xor(x.bits, y.bits)) <= 6""")
def hamming_near_pairs(spark, sf):
    """Vectors whose sign bits differ in six places at most, found through slices of the bits."""
    bit = F.transform("embedding", lambda x: F.when(x > 0, F.expr("1L")).otherwise(F.expr("0L")))
    bits = F.aggregate(F.reverse(bit), F.lit(0).cast("long"), lambda s, b: F.shiftleft(s, 1).bitwiseOR(b))
    h = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), bits.alias("bits"))
    return R.hamming_pairs(h, "id", "bits", 6)


@query()
def key_concepts(spark, sf):
    """The most frequent words and word pairs of each language, without near synonyms of those before them."""
    words = F.filter(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}{4,})"), 1), lambda w: ~w.isin(T.STOPWORDS))
    d = table(spark, sf, "documents").select("lang", words.alias("w"))
    return splitting.without_synonyms(R.top_terms(d, ["lang"], "w", 40), 20)


@query("""SELECT source, CASE WHEN source IS NULL THEN 'general' ELSE trim(both '_' from regexp_replace(lower(source || ' & ' || lang), '[^a-z0-9]+', '_', 'g')) END AS slug, cast(sum(greatest(1, length(coalesce(text, '')) // 4)) AS BIGINT) AS tokens, CASE WHEN avg(n_chars) >= 70 THEN 'Good' WHEN avg(n_chars) >= 45 THEN 'Fair' ELSE 'At Risk' END AS size FROM documents GROUP BY 1, 2""")
def sql_functions(spark, sf):
    """The library's functions called from SQL text."""
    register(spark)
    table(spark, sf, "documents").createOrReplaceTempView("_sql_documents")
    return spark.sql("SELECT source, slug(source || ' & ' || lang) AS slug, sum(token_length(text)) AS tokens, health_status(avg(n_chars)) AS size FROM _sql_documents GROUP BY 1, 2")


@query()
def sql_chunks(spark, sf):
    """The splitter as a function of tables: what doc_chunks gives."""
    register(spark)
    table(spark, sf, "documents").createOrReplaceTempView("_sql_documents")
    return spark.sql("SELECT d.doc_id, c.ordinal, c.chunk AS text, length(c.chunk) AS n_chars FROM _sql_documents d, LATERAL split_text(d.text, 512, 51) c")
