"""Small cases of the functions and operators, with expected values worked out by hand."""

import datetime

import pytest
from pyspark.sql import functions as F

from tideline.functions import learning as L
from tideline.functions import splitting as S
from tideline.functions import text as T
from tideline.operators import graph as G
from tideline.operators import relational as R
from tideline.operators import retrieval as V
from tideline.operators import windows as W
from tideline.sources import tables


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def array(*values):
    return F.array(*[F.lit(v) for v in values])


def test_mastery_depends_on_order(spark):
    assert one(spark, L.mastery_fold(array(0.15), 0.95)) == 1.0
    assert one(spark, L.mastery_fold(array(0.15, -0.12), 0.9)) == pytest.approx(0.88)
    assert one(spark, L.mastery_fold(array(-0.12, 0.15), 0.9)) == pytest.approx(0.93)


def test_risk(spark):
    score = L.risk_score(F.lit(0.2), F.lit(0.3), F.lit(0.2), F.lit(0.5))
    assert one(spark, score) == pytest.approx(0.73)
    assert one(spark, L.risk_level(score)) == "high"


@pytest.mark.parametrize(("value", "how", "limit", "want"), [(1.0, "eq", 1.0 + 1e-10, True), (2.0, "gt", 1.0, True), (1.0, "lt", 1.0, False), (1.0, "odd", 0.0, False)])
def test_comparators(spark, value, how, limit, want):
    assert one(spark, W.compared(F.lit(value), F.lit(how), F.lit(limit))) is want


@pytest.mark.parametrize(("flags", "n", "want"), [([False, True, True], 2, True), ([False, True, True], 4, False), ([True], 0, False), ([True, False], 1, False)])
def test_consecutive(spark, flags, n, want):
    assert one(spark, W.all_of_last(array(*flags), n)) is want


def test_anomalies_need_five_points(spark):
    short = array(1.0, 2.0, 900.0)
    assert one(spark, W.ewma(short)["anomaly"]) is False
    assert one(spark, W.mad(short)["anomaly"]) is False
    assert one(spark, W.mad(array(1.0, 1.1, 0.9, 1.0, 50.0))["anomaly"]) is True


def test_fingerprints_ignore_numbers(spark):
    fp = lambda t: one(spark, T.error_fingerprint(F.lit(t), F.lit(None).cast("string"), F.lit("API"), F.lit(None).cast("string")))
    assert fp("Timeout after 30 s for 123e4567-e89b-12d3-a456-426614174000") == fp("timeout after 99  s for 00000000-e89b-12d3-a456-426614174000 ")
    assert fp("Timeout") != fp("Refused")


def test_title_scores(spark):
    score = lambda q, t: one(spark, T.title_score(F.lit(q), F.lit(t)))
    assert score("Weather", "weather!") == 100.0
    assert score("weather", "Understanding the Weather") == 52.0
    assert score("the weather", "Understanding the Weather") == 85.0
    assert score("", "x") == 0.0


def test_bloom(spark):
    assert one(spark, T.bloom(F.lit("Compare and contrast"))) == "analyze"
    assert one(spark, T.bloom(F.lit("nothing here"))) == "understand"
    assert one(spark, T.bloom(F.lit("define and explain"))) == "remember"


def test_chunk_issues(spark):
    assert "broken_paragraph_hyphen" in one(spark, T.chunk_issues(F.lit("the com-")))
    assert one(spark, T.chunk_issues(F.lit("word " * 100))) == []


def test_redaction(spark):
    assert one(spark, T.redacted(F.lit("Bearer abc.DEF= rest"))) == "Bearer [REDACTED] rest"
    assert one(spark, T.redacted_map(F.create_map(F.lit("api_key"), F.lit("x"), F.lit("name"), F.lit("y")))) == {"api_key": "[REDACTED]", "name": "y"}


def test_splitter():
    text = "para one. " * 30 + "\n\n" + "x" * 250
    parts = S.split_text(text, 100, 10)
    assert all(len(p) <= 100 for p in parts)
    assert S.split_text("", 10, 1) == []


def test_slug(spark):
    assert one(spark, T.slug(F.lit("  Light & Shadow! "))) == "light_shadow"
    assert one(spark, T.slug(F.lit(None).cast("string"))) == "general"


def test_ancestors(spark):
    edges = spark.createDataFrame([(a, b) for a, b in zip("abcde", "bcdef", strict=True)], "prerequisite string, dependent string")
    got = {(r.prerequisite, r.depth) for r in G.ancestors(edges, 4).where("concept = 'f'").collect()}
    assert got == {("e", 1), ("d", 2), ("c", 3), ("b", 4)}


def test_weak_hits(spark):
    hits = spark.createDataFrame([(1, 1, 0.8), (1, 2, 0.5), (1, 3, 0.3), (1, 4, None), (2, 5, 0.2), (2, 6, None), (3, 7, None)], "query int, id int, score double")
    assert {r.id for r in V.without_weak(hits).collect()} == {1, 2, 4, 7}


def test_streaks(spark):
    d = lambda *days: [(1, datetime.date(2024, 1, x)) for x in days]
    run = lambda days: W.streaks(spark.createDataFrame(d(*days), "u int, d date"), "u", "d", "2024-01-31").first()
    assert (run([28, 29, 30]).current, run([28, 29]).current, run([5, 6, 7, 30]).longest) == (3, 0, 3)


def test_band_join_is_exact(spark):
    a = spark.range(60).select(F.col("id").alias("p"))
    b = spark.range(60).select(F.col("id").alias("q"))
    got = {(r.p, r.q) for r in R.band_join(a, b, [], "p", "q", 4).collect()}
    assert got == {(p, q) for p in range(60) for q in range(60) if abs(p - q) <= 4}


def test_hamming_pairs(spark):
    rows = spark.createDataFrame([(1, 0), (2, 0b1111), (3, -1), (4, (1 << 62) | 1)], "k long, v long")
    assert {(r.a, r.b, r.distance) for r in R.hamming_pairs(rows, "k", "v", 4).collect()} == {(1, 2, 4), (1, 4, 2), (2, 4, 4)}


def test_upsert_is_idempotent(spark):
    t = spark.createDataFrame([(1, 1.0), (2, 2.0)], "k int, v double")
    u = spark.createDataFrame([(2, 5.0), (3, 6.0)], "k int, v double")
    once = tables.upserted(t, u, ["k"])
    assert sorted(tables.upserted(once, u, ["k"]).collect()) == sorted(once.collect()) == [(1, 1.0), (2, 5.0), (3, 6.0)]


def test_partition_overwrite(spark, tmp_path):
    path = str(tmp_path / "t")
    tables.replace_partitions(spark.createDataFrame([(1, "a"), (2, "b")], "v int, k string"), path, ["k"])
    tables.replace_partitions(spark.createDataFrame([(9, "b")], "v int, k string"), path, ["k"])
    assert sorted((r.v, r.k) for r in spark.read.parquet(path).collect()) == [(1, "a"), (9, "b")]


def test_sources(spark, tmp_path):
    (tmp_path / "g.json").write_text('{"cases": [{"question": "q", "expected_pages": [1, 2]}], "extra": 1}')
    row = tables.json_documents(spark, str(tmp_path / "g.json"), "cases array<struct<question string, expected_pages array<int>>>").first()
    assert row.cases[0].expected_pages == [1, 2]
    assert tables.blobs(spark, str(tmp_path), "*.json").select("length").first()["length"] > 0
    assert tables.deep_merge({"a": {"b": 1, "c": 2}}, {"a": {"b": 3}}) == {"a": {"b": 3, "c": 2}}


def test_spread_sample(spark):
    rows = spark.range(13).select(F.lit(1).alias("k"), "id")
    assert [r.id for r in W.spread_sample(rows, ["k"], ["id"], 4).orderBy("id").collect()] == [0, 4, 8, 12]


def test_forward_fill_moves_as_a_whole(spark):
    rows = spark.createDataFrame([("d", 1, "A", 1), ("d", 2, None, None), ("d", 3, "B", None), ("d", 4, None, None)], "s string, i int, t string, l int")
    assert [(r.t, r.l) for r in W.forward_filled(rows, ["s"], ["i"], ["t", "l"]).orderBy("i").collect()] == [("A", 1), ("A", 1), ("B", None), ("B", None)]


def test_phrases_both_ways(spark):
    from tideline.operators.matching import phrases_found

    phrases = spark.createDataFrame([(1, "he quick brown"), (2, "brown"), (3, "fox jumps high"), (4, "no"), (5, "over the la"), (6, ""), (7, None), (8, "x ju"), (9, "y"), (10, "qq"), (11, "brown fox\njumps")], "item_id int, phrase string")
    texts = spark.createDataFrame([("the quick brown fox",), ("jumps over the lazy dog",)], "text string")
    want = [(1, True), (2, True), (3, False), (4, False), (5, True), (6, True), (7, False), (8, False), (9, True), (10, False), (11, False)]
    assert sorted(phrases_found(phrases, texts).collect()) == want
    assert not any(r.found for r in phrases_found(phrases, texts.where("false")).collect())
