"""Learners' turns, captions and titles: acts, affect, strategy, keywords, tags, matches; and what is written and read back."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import dialogue as D
from ..functions import text as T
from ..operators import retrieval as V
from ..operators import titles as N
from ..operators import windows as W
from ..sources import tables as S
from ..sources.scratch import scratch_path
from ..sources.tables import table
from ._registry import query

PHRASES = ["licensed under", "under license", "right reserve", "write mail", "the and"]
_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_OUT = r"[^\p{L}\p{N}_]"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _listed(texts: list[str]) -> str:
    return "[" + ", ".join(map(_quoted, texts)) + "]"


def _cases(column: str, rules: list, default: str, result=lambda rule, i: _quoted(rule.result)) -> str:
    return "CASE " + " ".join(f"WHEN {r.sql(column)} THEN {result(r, i)}" for i, r in enumerate(rules)) + f" ELSE {default} END"


def _stripped(column: str) -> str:
    return f"trim(lower(coalesce({column}, '')), {_BLANKS})"


_SAID = f"SELECT conv_id, turn, {_stripped('text')} AS q FROM conversations"


@query(f"WITH x AS ({_SAID}) SELECT conv_id, turn, CASE WHEN q = '' THEN 'none' ELSE {_cases('q', D.ACTS, _quoted('new_topic'))} END AS act FROM x")
def followup_act(spark, sf):
    """The dialogue act of each turn, by the first rule that applies."""
    return table(spark, sf, "conversations").select("conv_id", "turn", D.dialogue_act(F.col("text")).alias("act"))


@query("""WITH u AS (SELECT vec_id, label, cast(embedding AS DOUBLE[]) AS v FROM embeddings), p AS (SELECT label, v FROM u QUALIFY row_number() OVER (PARTITION BY label ORDER BY vec_id) <= 3),
s AS (SELECT u.vec_id AS id, p.label, max(round_even(100 * list_cosine_similarity(u.v, p.v), 4)) AS score FROM u, p GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, label) AS r, lead(score) OVER (PARTITION BY id ORDER BY score DESC, label) AS second FROM s)
SELECT id, CASE WHEN score >= 38 AND score - greatest(coalesce(second, 0), 0) >= 2.5 THEN label END AS label, score FROM r WHERE r = 1""")
def followup_prototype(spark, sf):
    """The act whose nearest sample utterance is nearest, if it is near enough and ahead of the next act's."""
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "label", F.col("embedding").alias("vector"))
    r = F.row_number().over(Window.partitionBy("label").orderBy("id"))
    return V.nearest_prototype(e.select("id", "vector"), e.withColumn("r", r).where("r <= 3").select("label", "vector"), 38.0, 2.5)


_AFFECT = f"CASE WHEN q = '' THEN -1 ELSE {_cases('q', D.AFFECTS, '-1', lambda rule, i: str(i))} END"
_AFFECT_ROWS = ", ".join(f"({i}, {_quoted(r.result)}, {', '.join(f'{v}e0' for v in r.values)})" for i, r in [(-1, D.Rule("neutral", "")), *enumerate(D.AFFECTS)])


@query(f"WITH x AS ({_SAID}), a AS (SELECT conv_id, turn, {_AFFECT} AS i FROM x), f(i, affect, valence, engagement, confusion) AS (VALUES {_AFFECT_ROWS}) SELECT conv_id, turn, affect, valence, engagement, confusion FROM a JOIN f USING (i)")
def student_affect(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", D.affect(F.col("text")).alias("a")).select("conv_id", "turn", "a.*")


@query(f"""WITH x AS ({_SAID}), f(i, affect, valence, engagement, confusion) AS (VALUES {_AFFECT_ROWS}), a AS (SELECT conv_id, turn, affect FROM (SELECT conv_id, turn, {_AFFECT} AS i FROM x) JOIN f USING (i)), c AS (SELECT *, lag(affect) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM a),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM c WHERE before IS NULL OR before <> affect) SELECT conv_id, string_agg(affect, ',' ORDER BY turn) AS trajectory FROM r WHERE back <= 5 GROUP BY 1""")
def affect_trajectory(spark, sf):
    a = table(spark, sf, "conversations").select("conv_id", "turn", D.affect(F.col("text"))["affect"].alias("affect"))
    g = a.groupBy("conv_id").agg(W.ordered_list("affect", "turn").alias("xs"))
    return g.select("conv_id", F.array_join(D.trajectory(F.col("xs")), ",").alias("trajectory"))


@query("""WITH u AS (SELECT user_id, count(*) FILTER (event_type = 'error') / count(*) AS confusion, count(*) FILTER (event_type = 'view') / count(*) AS attention, count(*) FILTER (event_type = 'purchase') / count(*) AS confidence, count(*) FILTER (event_type = 'click') / count(*) AS engagement, count(*) FILTER (value > 50) AS strong, count(*) FILTER (value <= 10) AS weak, user_id % 3 = 0 AS quiz, user_id % 4 = 0 AS said FROM events GROUP BY user_id),
p AS (SELECT user_id, least(1e0, 2.5e0 * confusion) AS c, least(1e0, 2e0 * attention) AS a, least(1e0, 3e0 * confidence) AS f, least(1e0, 3.5e0 * engagement) AS e, CASE WHEN strong + weak > 0 THEN strong / (strong + weak) ELSE 0.5e0 END AS m, quiz, said FROM u)
SELECT user_id, CASE WHEN c >= 0.55e0 OR a < 0.4e0 THEN 'slow' WHEN m >= 0.75e0 AND c < 0.3e0 THEN 'fast' ELSE 'medium' END AS pace, CASE WHEN m < 0.45e0 OR f < 0.4e0 THEN 'below_level' WHEN m >= 0.75e0 AND f >= 0.7e0 THEN 'above_level' ELSE 'on_level' END AS difficulty,
CASE WHEN f < 0.4e0 THEN 'effort_reinforcement_with_choice' WHEN quiz THEN 'challenge_with_support' ELSE 'effort_with_choice' END AS motivation, CASE WHEN c >= 0.55e0 THEN 'high' WHEN said THEN 'low' ELSE 'medium' END AS encouragement, CASE WHEN c >= 0.55e0 THEN 'high' WHEN f >= 0.75e0 THEN 'low' ELSE 'medium' END AS hints, CASE WHEN c >= 0.55e0 OR a < 0.4e0 THEN 'low' WHEN e >= 0.7e0 THEN 'moderate_high' ELSE 'moderate' END AS load FROM p""")
def teaching_strategy(spark, sf):
    """What to teach how, by each learner's shares of events."""
    n = F.count(F.lit(1))
    share = lambda kind, scale: F.least(F.lit(1.0), scale * (F.count_if(F.col("event_type") == kind) / n))
    u = table(spark, sf, "events").groupBy("user_id").agg(share("error", 2.5).alias("c"), share("view", 2.0).alias("a"), share("purchase", 3.0).alias("f"), share("click", 3.5).alias("e"), F.count_if(F.col("value") > 50).alias("strong"), F.count_if(F.col("value") <= 10).alias("weak"))
    s = D.strategy(F.col("c"), F.col("a"), F.col("f"), F.col("e"), F.col("strong"), F.col("weak"), F.col("user_id") % 3 == 0, F.col("user_id") % 4 == 0)
    return u.select("user_id", s.alias("s")).select("user_id", "s.*")


@query("""WITH x AS (SELECT event_id, event_type, value, cast(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events), y AS (SELECT *, CASE event_type WHEN 'purchase' THEN 'assignment_submitted' WHEN 'signup' THEN 'chapter_completed' WHEN 'click' THEN 'quiz_answer' ELSE event_type END AS kind, CASE WHEN k % 7 = 0 THEN k % 2 = 0 END AS correct FROM x),
t AS (SELECT event_id, CASE WHEN coalesce(correct, false) THEN 'correct' WHEN NOT coalesce(correct, true) OR kind = 'quiz_answer' THEN 'incorrect' WHEN k / 100 >= 0.55 AND k % 5 = 0 THEN 'confusion' WHEN k % 11 = 0 THEN 'hint_used' WHEN kind = 'assignment_submitted' AND k % 3 > 0 THEN CASE WHEN k / 100 >= 0.6 THEN 'assignment_correct' ELSE 'assignment_incorrect' END WHEN kind = 'chapter_completed' THEN 'chapter_complete' WHEN k % 13 = 0 THEN 'affirmation' WHEN k / 100 >= 0.7 THEN 'correct' ELSE 'confusion' END AS evidence FROM y)
SELECT evidence, count(*) AS events, min(event_id) AS first FROM t GROUP BY 1""")
def evidence_types(spark, sf):
    """How many events give which kind of evidence."""
    k = F.col("k")
    kind = F.when(F.col("event_type") == "purchase", "assignment_submitted").when(F.col("event_type") == "signup", "chapter_completed").when(F.col("event_type") == "click", "quiz_answer").otherwise(F.col("event_type"))
    x = table(spark, sf, "events").select("event_id", kind.alias("kind"), F.get_json_object("props", "$.k").cast("int").alias("k"))
    e = D.evidence_type(F.col("kind"), F.when(k % 7 == 0, k % 2 == 0), F.when(k % 5 == 0, k / 100), k % 11 == 0, F.when(k % 3 > 0, k / 100), k % 13 == 0, k / 100)
    return x.select("event_id", e.alias("evidence")).groupBy("evidence").agg(F.count(F.lit(1)).alias("events"), F.min("event_id").alias("first"))


def _phrase_sql(phrase: str) -> str:
    """Whether `text` holds the phrase: positions of its stems in the list of words, two words between them at most; for phrases of
    two stems."""
    exact = f"contains(lower(coalesce(text, '')), {_quoted(phrase)})"
    stems, w = D.phrase_stems(phrase), f"string_split_regex(lower(coalesce(text, '')), '{_OUT}+')"
    if len(stems) < 2:
        return exact
    before = " OR ".join(f"coalesce(starts_with(w[greatest(i - {k}, 0)], {_quoted(stems[0])}), false)" for k in range(1, D.GAP + 2))
    return f"({exact} OR len(list_filter([{w}], lambda w: len(list_filter(range(1, len(w) + 1), lambda i: starts_with(w[i], {_quoted(stems[1])}) AND ({before}))) > 0)) > 0)"


@query(f"SELECT doc_id, array_to_string(list_filter([{', '.join(f'CASE WHEN {_phrase_sql(p)} THEN {_quoted(p)} END' for p in PHRASES)}], lambda x: x IS NOT NULL), ',') AS phrases FROM documents")
def phrase_matches(spark, sf):
    """Which phrases a document holds in any inflection, with up to two words between theirs."""
    found = F.array_compact(F.array(*[F.when(D.holds_phrase(F.col("text"), p), F.lit(p)) for p in PHRASES]))
    return table(spark, sf, "documents").select("doc_id", F.array_join(found, ",").alias("phrases"))


#: Ids that more than one row has are broadcast up to this number; beyond it the words of all rows are grouped.
FEW = 200_000


def _counted_together(docs):
    """(doc_id, keywords) of each row of docs, by the words of all rows of its id."""
    w = docs.select("doc_id", F.explode(D.keyword_words(F.col("text"))).alias("word")).groupBy("doc_id", "word").agg(F.count(F.lit(1)).alias("n"))
    r = F.row_number().over(Window.partitionBy("doc_id").orderBy(D.keyword_weight(F.col("word"), F.col("n")).desc(), "word"))
    lists = w.withColumn("r", r).where("r <= 10").groupBy("doc_id").agg(W.ordered_list("word", "r").alias("words"))
    return lists.join(docs.select("doc_id", D.figure_type(F.col("text")).alias("kind")), "doc_id").select("doc_id", D.keywords_with_type(F.col("words"), F.col("kind")).alias("keywords"))


_NUMBER = r"^fig\.?\s*[0-9]+(?:\.[0-9]+)*\s*"
#: c is the stripped text and t its caption without label, of which the types are told.
_CAPTION = rf"""SELECT doc_id, c, n, CASE WHEN regexp_matches(c, '{_NUMBER}\.?\z') OR regexp_matches(t, '^[0-9. ]+\z') THEN '' ELSE left(t, 512) END AS t
FROM (SELECT doc_id, {_stripped("text")} AS c, length(coalesce(text, '')) AS n, trim(regexp_replace(regexp_replace({_stripped("text")}, '{_NUMBER}[:. ]+', ''), '\s+', ' ', 'g'), ' .:;-') AS t FROM documents)"""
_TYPE = _cases("t", D.FIGURES, "'unknown'")
_ROLE = f"CASE WHEN length(c) < 8 THEN 'decorative' WHEN regexp_matches(c, {_quoted(D.ACTIVITY)}) THEN 'activity' ELSE CASE kind {' '.join(f'WHEN {_quoted(k)} THEN {_quoted(r)}' for k, r in D.ROLES.items())} ELSE 'sidebar_example' END END"


def _tags_sql(column: str, tags: dict[str, str]) -> str:
    return f"CASE {column} {' '.join(f'WHEN {_quoted(k)} THEN {_listed(v.split(chr(124)))}' for k, v in tags.items())} ELSE [] END"


@query(rf"""WITH w AS (SELECT doc_id, unnest(list_filter(string_split_regex(lower(coalesce(text, '')), '{_OUT}+'), lambda x: regexp_full_match(x, '[a-z]{{3,}}') AND NOT list_contains({_listed(D.NO_KEYWORDS)}, x))) AS word FROM documents), n AS (SELECT doc_id, word, count(*) AS n FROM w GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n * CASE WHEN list_contains({_listed(D.DOMAIN_WORDS)}, word) THEN 2e0 ELSE 1e0 END * least(1.5e0, length(word) / 8e0) DESC, word) AS r FROM n), l AS (SELECT doc_id, list(word ORDER BY r) AS words FROM r WHERE r <= 10 GROUP BY 1),
k AS (SELECT doc_id, {_TYPE} AS kind FROM ({_CAPTION}))
SELECT doc_id, array_to_string(CASE WHEN kind <> 'unknown' AND NOT list_contains(words, kind) THEN list_prepend(kind, words)[1:10] ELSE words END, '|') AS keywords FROM l JOIN k USING (doc_id)""")
def semantic_keywords(spark, sf):
    """The ten weightiest words of each document, its type among them. A row whose id no other row has is ranked by itself;
    the words of rows that share an id are counted together."""
    docs = table(spark, sf, "documents").select("doc_id", "text").where("doc_id IS NOT NULL")
    shared = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id")
    n = shared.limit(FEW + 1).count()
    if n > FEW:
        return _counted_together(docs)
    known = F.broadcast(shared)
    alone = docs.join(known, "doc_id", "left_anti") if n else docs
    ranked = alone.select("doc_id", F.explode(D.text_keywords(F.col("text"))).alias("keywords"))
    return ranked.unionByName(_counted_together(docs.join(known, "doc_id", "left_semi"))) if n else ranked


@query(f"""WITH x AS (SELECT doc_id, lower(coalesce(text, '')) AS low FROM documents), k AS (SELECT *, {_TYPE} AS kind FROM ({_CAPTION})), r AS (SELECT doc_id, kind, {_ROLE} AS role FROM k),
t AS (SELECT doc_id, list_concat(list_filter([{', '.join(f'CASE WHEN regexp_matches(low, {_quoted(D.as_word(w))}) THEN {_quoted(k)} END' for k, w in D.SUBJECTS.items())}], lambda x: x IS NOT NULL), {_tags_sql('kind', D.TYPE_TAGS)}, {_tags_sql('role', D.ROLE_TAGS)}) AS l FROM x JOIN r USING (doc_id))
SELECT doc_id, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i)[1:{D.TAGS}], '|') AS tags FROM t""")
def educational_tags(spark, sf):
    """Tags of each document's subjects, type and role."""
    kinds = table(spark, sf, "documents").select("doc_id", "text", D.figure_type(F.col("text")).alias("type"))
    roles = kinds.select("doc_id", "text", "type", D.figure_role(F.col("text"), F.col("type")).alias("role"))
    return roles.select("doc_id", D.educational_tags(F.col("text"), F.col("type"), F.col("role")).alias("tags"))


@query(rf"""WITH k AS (SELECT *, {_TYPE} AS kind FROM ({_CAPTION}))
SELECT doc_id, kind AS type, {_ROLE} AS role, round_even(CASE WHEN c = '' THEN 0.1e0 ELSE least(1e0, least(0.5e0, n / 200e0) + CASE WHEN regexp_matches(c, {_quoted(D.LABELLED)}) THEN 0.2e0 ELSE 0e0 END + CASE WHEN regexp_matches(c, {_quoted(D.CUES)}) THEN 0.15e0 ELSE 0e0 END) END, 6) AS salience FROM k""")
def figure_facts(spark, sf):
    """Type, role and salience of figures whose captions are the documents."""
    f = table(spark, sf, "documents").select("doc_id", D.figure_facts(F.col("text")).alias("f")).select("doc_id", "f.*")
    return f.withColumn("salience", F.bround("salience", 6))


@query(f"""WITH kept AS (SELECT doc_id FROM documents WHERE {_phrase_sql('licensed under')}), e AS (SELECT vec_id AS id, label, cast(embedding AS DOUBLE[]) AS v FROM embeddings), q AS (SELECT id AS query, label, v FROM e WHERE id % 100 = 0), c AS (SELECT e.* FROM e JOIN kept ON doc_id = id),
s AS (SELECT query, c.id, round_even(list_cosine_similarity(q.v, c.v), 6) AS score FROM q JOIN c USING (label)) SELECT query, id, score, cast(row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS INTEGER) AS rank FROM s QUALIFY row_number() OVER (PARTITION BY query ORDER BY score DESC, id) <= 3""")
def filtered_then_ranked(spark, sf):
    """Vectors of documents that hold a phrase, ranked among these only."""
    kept = table(spark, sf, "documents").where(D.holds_phrase(F.col("text"), "licensed under")).select(F.col("doc_id").alias("id"))
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")
    q = e.where("id % 100 = 0").select(F.col("id").alias("query"), "vector", "label")
    return V.topk_filtered(q, e.join(kept, "id", "left_semi"), "label", 3)


@query()
def toc_alignment(spark, sf):
    """Numbers of an order's returned lines matched in order with the nearest of its other lines."""
    items = table(spark, sf, "lineitem").withColumn("numbered", F.col("l_returnflag") == "R")
    pos = lambda p: F.array_sort(F.filter(F.collect_list(F.when(p, F.col("l_quantity"))), lambda x: x.isNotNull()))
    g = items.groupBy("l_orderkey").agg(pos(F.col("numbered")).alias("numbers"), pos(~F.col("numbered")).alias("pages"))
    return g.select("l_orderkey", F.posexplode(N.aligned(F.col("numbers"), F.col("pages"))).alias("i", "page"))


@query(r"""WITH l AS (SELECT doc_id, trim(unnest(string_split(coalesce(text, ''), chr(10))), ' ') AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents) SELECT doc_id, md5(coalesce(string_agg(regexp_replace(line, '([*`~$])', '\\\1', 'g'), ' ' ORDER BY i) FILTER (line <> ''), '')) AS merged FROM l GROUP BY 1""")
def merged_paragraphs(spark, sf):
    """A digest of each document as one paragraph."""
    return table(spark, sf, "documents").select("doc_id", F.md5(D.paragraph(F.col("text"))).alias("merged"))


@query("""WITH q AS (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN n_name WHEN 1 THEN 'Explain ' || n_name || ' please' WHEN 2 THEN split_part(n_name, '_', 1) ELSE c_mktsegment END AS query FROM customer JOIN nation ON n_nationkey = c_nationkey), n AS (SELECT c_custkey, trim(regexp_replace(lower(query), '[^a-z0-9]+', ' ', 'g')) AS q FROM q), t AS (SELECT n_nationkey AS topic, trim(regexp_replace(lower(n_name), '[^a-z0-9]+', ' ', 'g')) AS t FROM nation),
p AS (SELECT c_custkey, topic, q, t, list_distinct(string_split(q, ' ')) AS a, list_distinct(string_split(t, ' ')) AS b FROM n, t), s AS (SELECT c_custkey, topic, CASE WHEN q = t THEN 100e0 WHEN (contains(q, t) OR contains(t, q)) AND len(a) = 1 AND len(b) >= 2 THEN 52e0 WHEN contains(q, t) OR contains(t, q) THEN 85e0 WHEN len(list_intersect(a, b)) / len(a) >= 0.8 AND len(a) >= 2 THEN 70e0 + 10e0 * len(list_intersect(a, b)) / len(a) WHEN len(a) = 1 AND len(list_intersect(a, b)) = 1 THEN 55e0 ELSE 0e0 END AS score FROM p WHERE len(list_intersect(a, b)) > 0)
SELECT c_custkey, topic, score FROM s WHERE score >= 50 QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY score DESC, topic) = 1""")
def topic_match(spark, sf):
    """The topic whose title fits a learner's words best, if it fits well enough."""
    k = F.col("c_custkey") % 4
    asked = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    text = F.when(k == 0, F.col("n_name")).when(k == 1, F.concat(F.lit("Explain "), "n_name", F.lit(" please"))).when(k == 2, F.split_part("n_name", F.lit("_"), F.lit(1))).otherwise(F.col("c_mktsegment"))
    titles = table(spark, sf, "nation").select(F.col("n_nationkey").alias("topic"), F.col("n_name").alias("title"))
    return N.best_title(asked.select("c_custkey", text.alias("query")), titles, "c_custkey", "topic", 50.0)


@query("SELECT lang, count(*) AS n FROM documents WHERE source IN ('src1', 'src2') AND n_chars >= 100 GROUP BY 1")
def sentinel_filters(spark, sf):
    """Filters of which some say 'all'."""
    return S.chosen(table(spark, sf, "documents"), {"source": ["src1", "src2"], "lang": "all"}, F.col("n_chars") >= 100).groupBy("lang").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT conv_id, turn FROM conversations WHERE list_contains(list_transform(string_split(text, ' '), lambda x: lower(x)), 'the')")
def array_contains_any_case(spark, sf):
    return table(spark, sf, "conversations").where(S.contains_any_case(F.split("text", " "), "THE")).select("conv_id", "turn")


@query("SELECT user_id AS recipient, event_type AS kind, count(*) AS n FROM (SELECT DISTINCT user_id, event_type FROM events) GROUP BY 1, 2")
def inbox_insert(spark, sf):
    """Messages inserted once for each recipient and kind, read back from the table they were written to."""
    path = scratch_path(spark, "inbox")
    S.insert_distinct(table(spark, sf, "events").select(F.col("user_id").alias("recipient"), F.col("event_type").alias("kind")), path, ["recipient", "kind"])
    return spark.read.parquet(path).groupBy("recipient", "kind").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT source, count(*) AS chunks, cast(sum(CASE WHEN source = 'src1' THEN n_chars + 1 ELSE n_chars END) AS BIGINT) AS chars FROM documents GROUP BY 1")
def reindexed_partitions(spark, sf):
    """A table partitioned by source of which one source is indexed anew, twice; the others stay."""
    path = scratch_path(spark, "index")
    docs = table(spark, sf, "documents").select("doc_id", "n_chars", "source")
    S.replace_partitions(docs, path, ["source"])
    again = docs.where("source = 'src1'").withColumn("n_chars", F.col("n_chars") + 1)
    for _ in range(2):
        S.replace_partitions(again, path, ["source"])
    return spark.read.parquet(path).groupBy("source").agg(F.count(F.lit(1)).alias("chunks"), F.sum("n_chars").alias("chars"))


@query("SELECT s_suppkey, s_name, s_acctbal FROM supplier WHERE s_acctbal > 0")
def csv_export(spark, sf):
    """A filtered list exported as CSV and read back."""
    path = scratch_path(spark, "export")
    S.export_csv(table(spark, sf, "supplier").where("s_acctbal > 0").select("s_suppkey", "s_name", "s_acctbal"), path)
    return spark.read.option("header", True).schema("s_suppkey long, s_name string, s_acctbal double").csv(path)


@query("SELECT CASE source WHEN 'src3' THEN 'moved' ELSE source END AS source, count(*) AS n FROM documents GROUP BY 1")
def namespace_rename(spark, sf):
    return S.rename_namespace(table(spark, sf, "documents").select("source"), "source", "src3", "moved").groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_type, count(*) AS n, cast(sum(cast(json_extract_string(props, '$.k') AS INTEGER)) AS BIGINT) AS k FROM events GROUP BY 1")
def json_scan(spark, sf):
    """Events written as JSON files and read under an explicit schema, of which one field is dropped."""
    path = scratch_path(spark, "json")
    table(spark, sf, "events").select("event_id", "event_type", F.from_json("props", "k int").alias("props")).write.json(path)
    return S.json_documents(spark, path, "event_type string, props struct<k: int>", multi_line=False).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("props.k").alias("k"))


@query(r"""SELECT count(*) AS texts, cast(sum(octet_length(encode(replace(replace(replace(text, '\', '\\'), chr(10), '\n'), chr(13), '\r') || chr(10)))) AS BIGINT) AS bytes, cast(sum(length(text)) AS BIGINT) AS chars FROM benchmark WHERE text IS NOT NULL""")
def blob_scan(spark, sf):
    """Texts written as lines of eight text files, line ends escaped, and fetched as blobs: how many, their bytes, and the
    characters of the texts that come back."""
    path = scratch_path(spark, "blobs")
    table(spark, sf, "benchmark").where("text IS NOT NULL").select(S.one_line(F.col("text")).alias("value")).repartition(8).write.text(path)
    lines = S.blobs(spark, path, "*.txt").select("length", F.explode(F.split(F.regexp_replace(F.decode("content", "UTF-8"), "\n\\z", ""), "\n")).alias("line"))
    texts = lines.where("line <> '' OR length > 0").agg(F.count(F.lit(1)).alias("texts"), F.sum(F.octet_length("line") + 1).cast("long").alias("bytes"), F.sum(F.length(S.from_one_line(F.col("line")))).alias("chars"))
    return texts


@query("SELECT source, count(*) AS n, cast(sum(n_chars) AS BIGINT) AS chars FROM documents WHERE source NOT IN ('src1') GROUP BY 1")
def prefix_copy_delete(spark, sf):
    """A table copied under another prefix, of which one part is then deleted; the first stays as it was."""
    path = scratch_path(spark, "prefix")
    table(spark, sf, "documents").select("doc_id", "n_chars", "source").write.partitionBy("source").parquet(f"{path}/a")
    copied = S.copy_prefix(spark, f"{path}/a", f"{path}/b")
    deleted = S.delete_prefix(spark, f"{path}/b/source=src1")
    left = spark.read.parquet(f"{path}/b")
    kept = spark.read.parquet(f"{path}/a").count()
    if not copied or (deleted and kept < left.count()):
        raise RuntimeError("the copy or its source is not whole")
    return left.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))
