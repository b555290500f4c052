"""Pages that are not clean, templated documents, whole license texts, targets out of reach, and hot keys."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tests.llm.test_operators import plain_components, shingles
from tideline.llm import extraction, jaccard, licenses, mixing, tokens
from tideline.llm._common import spread_join, stored

LONG = "Some words of the text that go on and on. " * 4


@pytest.mark.parametrize("page, want", [
    ("<script>if(a<b){x=1} // don't</script><p>it's text here</p>", "it's text here"),
    ("<style>p > a{content:'<p>'}</style><title>no</title><p>yes</p>", "yes"),
    ("<script>never closed <p>lost", ""),
    (f'<article><p>ok</p><div class="legal-history">{LONG}</div><p><a href=x>one link alone</a></p><label>kept</label></article>', f"ok\n{LONG.strip()}\none link alone\nkept"),
    (f'<article><p>{LONG}</p><div class="share-buttons">Share</div><div class="cookie-notice">{LONG}</div><div class="comments"><p>{LONG}</p></div></article>', LONG.strip()),
    (f'<article class="comment"><p>{LONG}</p></article><div><p>{LONG}1</p><p>{LONG}2</p></div>', f"{LONG}1\n{LONG}2"),
    (f'<article class="teaser"><p>Short one.</p></article><div>{LONG}1</div><div>{LONG}2</div><p>{LONG}3</p>', f"Short one.\n{LONG}1\n{LONG}2\n{LONG}3"),
    (f'<ul><li><a href=a>Home</a><li><a href=b>News</a><li><a href=c>More</a><li><a href=d>About</a></ul><p>{LONG}</p><p>The end.</p>' + "<p><a href=e>x</a></p>" * 5, f"{LONG.strip()}\nThe end."),
    ('<div class="social-study">few</div><p>' + LONG + "</p>", LONG.strip()),
])
def test_pages_that_are_not_clean(page, want):
    assert extraction.main_text(page) == want


def test_density_decides_on_lines_outside_an_article():
    thin = "<p>a</p>" * 6
    page = f"<body>{thin}<p>{LONG}</p><p>b</p>{thin}</body>"
    kept = extraction.main_text(page).split("\n")
    assert LONG.strip() in kept and len(kept) < 14 and kept.count("a") < 12


BROKEN = {
    "a": "<a " * 350_000, "declarations": "<!" * 500_000, "ends": "</b>" * 250_000, "deep": "<div>" * 200_000, "values": "<a x='" * 170_000, "texts": "<" * 1_000_000,
    "inside": "<article>" + "<div>" * 100_000 + "</b>" * 100_000, "tags": '<p class="x" ' * 90_000,
}


@pytest.mark.parametrize("kind", BROKEN)
def test_long_broken_pages_take_time_by_their_length(kind):
    import time

    began = time.process_time()
    extraction.main_text(BROKEN[kind])
    assert time.process_time() - began < 3


@pytest.mark.parametrize("page, want", [
    (f"<article><p title=it's>{LONG}</p><p>it's {LONG}</p></article>", f"{LONG.strip()}\nit's {LONG.strip()}"),
    (f'<article><p class=x">{LONG}</p></article>', LONG.strip()),
    (f"<article><p title='the hidden valley'>{LONG}1</p><p data-x='a hidden b'>{LONG}2</p><p hidden>no</p><p style='display: none'>no</p><p aria-hidden=true>no</p></article>", f"{LONG}1\n{LONG}2"),
    (f"<article><p>{LONG}</p><section id='legal'><h2>Law</h2><p>{LONG}2</p></section></article>", f"{LONG.strip()}\nLaw\n{LONG}2"),
    (f"<article><p>{LONG}</p></article><div id='legal'><p>{LONG}2</p></div>", LONG.strip()),
    ("<p>a < b and 3 <4 or <> too</p>", "a < b and 3 <4 or <> too"),
    ('<p title="never closed>text</p>', "text"),
    ("<article><p>Short.</p><p><a href=x>all of it a link</a></p></article>", "Short.\nall of it a link"),
    ("<article>" + "<div>" * 600 + LONG + "</div>" * 600 + f"<p>{LONG}2</p></article>", f"{LONG.strip()}\n{LONG}2"),
])
def test_attributes_quotes_and_parts_of_articles(page, want):
    assert extraction.main_text(page) == want


def test_surge_and_dive_find_the_text_of_real_pages_without_the_article():
    """Without their article and main elements, pages are judged by density alone: on most of them it finds the text that
    the elements mark, and on nearly all of them nearly all of it."""
    import duckdb

    pages = [h for (h,) in duckdb.sql("SELECT html FROM '/root/testdata/sf0.01/pages.parquet'").fetchall()]
    same = near = 0
    for html in pages:
        with_it, without = (extraction.main_text(x).split("\n") for x in (html, re.sub(r"(?i)(</?)(article|main)(?=[\s>])", r"\1div", html)))
        same += with_it == without
        near += len(set(with_it) & set(without)) >= 0.9 * len(set(with_it) | set(without))
    assert same >= 0.95 * len(pages) and near >= 0.98 * len(pages)


def test_twin_rows_are_encoded_once(spark, tmp_path):
    path = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")
    rows = [(None, "the same text")] * 500 + [(7, "another  text")] * 300 + [(i, f"own {i}") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for more in (0, 0, 5):
        every = docs.unionByName(spark.range(more).selectExpr("id AS doc_id", "concat('new ', id % 2) AS text"))
        assert tokens.token_counts(every, path, str(tmp_path / "c")).count() == 820 + more
        assert spark.read.parquet(str(tmp_path / "c")).count() == 22 + 2 * (more > 0)


def test_templated_documents_are_not_compared_in_pairs(spark, tmp_path):
    rng = random.Random(8)
    paragraphs = [" ".join(f"w{rng.randint(0, 5000)}" for _ in range(60)) for _ in range(16)]
    rows = [(i, " ".join(rng.sample(paragraphs, 6))) for i in range(240)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(4).write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    keys = stored(jaccard.set_keys(docs), "t")
    texts, total = jaccard._without_copies(docs, keys)
    bits, maps = jaccard.frequency_levels(texts, total)
    held = spark.sparkContext.broadcast(maps)
    active = stored(texts.mapInArrow(jaccard._active(bits, held, 2), "node long, n long, alone long, odd array<long>, p0 array<long>, p1 array<long>, set binary"), "t")
    nodes = active.select("node", "n")
    pairs = nodes.toDF("a", "na").join(nodes.toDF("b", "nb"), F.col("a") < F.col("b")).where(100 * F.least("na", "nb") >= 75 * F.greatest("na", "nb")).select("a", "b")
    tried = jaccard.candidates(pairs, active, 2)
    linked = jaccard._verified(pairs, active, 2)
    sets = [shingles(t) for _, t in rows]
    want = sum(100 * len(a & b) >= 75 * len(a | b) for i, a in enumerate(sets) for b in sets[:i] if a != b)
    assert linked.count() == want and tried.count() <= len(rows) < pairs.count() / 50


def test_parities_never_exceed_the_differences(spark):
    import numpy as np

    rng = np.random.default_rng(5)
    rows = []
    for n in (1, 3, 20, 60, 70, 130, 500, 1000):
        for cut in (0, n // 9, n // 5):
            a = rng.integers(0, 2**63, n, dtype=np.uint64)
            b = np.concatenate([a[cut:], rng.integers(0, 2**63, n // 7, dtype=np.uint64)])
            rows.append((jaccard._parities(a).tolist(), jaccard._parities(b).tolist(), cut + n // 7))
    frame = spark.createDataFrame(rows, "a array<long>, b array<long>, d int")
    assert frame.where(jaccard._differences(F.col("a"), F.col("b")) > F.col("d")).count() == 0
    assert frame.where((F.col("d") == 0) & (jaccard._differences(F.col("a"), F.col("b")) != 0)).count() == 0


def test_hot_keys_are_joined_once(spark):
    rows = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i}", i % 2) for i in range(300)], "i int, k string, j int")
    table = spark.createDataFrame([("hot", 1), ("k0", 2), ("k3", 3)], "k string, v int")
    got = sorted((r.i, r.k, r.v) for r in spread_join(rows, table, ["k"]).collect())
    assert got == sorted((r.i, r.k, {"hot": 1, "k0": 2, "k3": 3}.get(r.k)) for r in rows.collect())
    assert spread_join(rows.where("false"), table, ["k"]).count() == 0 and spread_join(rows, table.where("false"), ["k"]).count() == 300


def test_copies_and_empty_texts_in_components(spark, tmp_path):
    rows = [(i, "same text of some words here" if i % 3 else None if i % 2 else "") for i in range(120)] + [(None, "same text of some words here")]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "d"))
    got = [tuple(r) for r in jaccard.ngram_jaccard_join(spark.read.parquet(str(tmp_path / "d"))).collect()]
    assert sorted(map(str, got)) == sorted(map(str, plain_components(rows).elements()))


def test_whole_license_texts(spark):
    body = licenses.TEXTS["mit-text"]
    cut = body.replace("without limitation ", "").replace("merge, publish, ", "")
    rows = [(1, "word " * 20_000 + body + " tail" * 10), (2, cut), (3, body[:200]), (4, licenses.TEXTS["bsd-3-text"]), (5, licenses.TEXTS["agpl-3-header"]), (6, None), (7, "the the the " * 9)]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert "mit-text" in got[1].labels.split(",") and got[1].n_words == 20_010 + len([w for w in __import__("re").split(licenses._BREAK, body) if w]) and got[1].score == 1.0
    assert "mit-text" in got[2].labels and 0.6 <= got[2].score and "mit-text" not in got[3].labels.split(",")
    assert {"bsd-3-text", "bsd-2-text"} <= set(got[4].labels.split(",")) and "agpl-3-header" in got[5].labels.split(",")
    assert got[6].labels == got[7].labels == "" and got[6].n_words == 0


def test_targets_out_of_reach_are_reported(spark):
    docs = spark.createDataFrame([(i, "river stone light " * (1 + i % 4)) for i in range(60)], "doc_id long, text string")
    labelled = docs.select("doc_id", F.lit("clean").alias("domain"))
    near = mixing.mix(docs, labelled, {"clean": 1.0})
    assert near.first().gap <= mixing.TOLERANCE
    far = mixing.mix(docs, labelled, {"clean": 0.1, "toxic": 5.0}, 2.0)
    rows = far.collect()
    assert len(rows) == 60 and len({r.gap for r in rows}) == 1 and all(r.rate >= 0 for r in rows)
    assert rows[0].gap > mixing.TOLERANCE


def test_rates_solve_the_least_squares(spark):
    """The fitted rates against projected gradient descent on the same numbers, written out with plain arrays."""
    import numpy as np

    rng = np.random.default_rng(2)
    post = rng.dirichlet([0.6, 0.4, 0.3], 300)
    tokens_ = rng.integers(1, 200, 300)
    frame = spark.createDataFrame([(int(t), p.tolist()) for t, p in zip(tokens_, post)], "_mix_tokens long, _mix_posterior array<double>")
    model = mixing.Classifier(["a", "b", "c"], np.zeros(3), np.zeros((3, 1)))
    steps, have, want = mixing.fit_rates(frame, model, {"a": 0.6, "b": 0.3, "c": 0.1})
    rates = np.ones(300)
    for g in steps:
        rates = np.maximum(0, rates - post @ g)
    assert np.allclose(have, (rates * tokens_) @ post) and np.abs(have - want).max() <= mixing.TOLERANCE * tokens_.sum()


def test_equal_texts_and_ids_count_once_each(spark, tmp_path):
    path = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")
    rows = [(1, "a b"), (1, "a b"), (1, "a  b"), (1, "c"), (2, "a b"), (None, None)]
    got = tokens.token_counts(spark.createDataFrame(rows, "doc_id long, text string"), path, str(tmp_path / "c"))
    assert sorted((r.doc_id or 0, r.n_bytes, r.n_tokens) for r in got.collect()) == [(0, 0, 0), (1, 1, 1), (1, 3, 2), (1, 3, 2), (1, 4, 2), (2, 3, 2)]


def test_grants_and_texts_with_lost_words(spark):
    body = licenses.TEXTS["mit-text"].split()
    thinned = " ".join(w for i, w in enumerate(body) if i % 6 != 5)
    rows = [(1, "It is Licensed under the Apache License, Version 2.0. More."), (2, "Licensed under CC BY-NC 4.0."), (3, "This work is licensed under the GNU General Public License, version 3."), (4, "Released under the MIT License."), (5, "licensed under the GNU General Public License, version 4"), (6, thinned), (7, licenses.TEXTS["unlicense-text"]), (8, "They were released under the sea and licensed under a bridge"), (None, "licensed under the ISC license")]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    labels = {k: r.labels.split(",") for k, r in got.items()}
    assert labels[1] == ["apache", "apache-2.0-grant"] and labels[2] == ["cc-by", "cc-by-nc-4.0-grant"] and labels[3] == ["gpl", "gpl-3.0-grant"] and labels[4] == ["mit", "mit-release"]
    assert labels[5] == ["gpl"] and labels[6] == ["mit-text"] and "mit-text" not in labels[7] and "unlicense-text" in labels[7] and labels[8] == [""] and labels[None] == ["isc-grant"]


def test_votes_by_diagonal_against_plain_counting(spark):
    """Exact templates stand wherever their words do, counted word by word; longer ones where enough of their runs do."""
    rng = random.Random(5)
    bits = [*licenses.PHRASES, *licenses.GRANTS.values(), "license", "the gnu", "licensed under", "mit", "x", "apache", "cc", "by"]
    rows = [(i, " ".join(rng.choice(bits) for _ in range(rng.randint(0, 12)))) for i in range(150)]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"), notices={}).collect()}
    for i, text in rows:
        words = text.split()
        places = lambda phrase: [k for k in range(len(words)) if words[k : k + len(phrase.split())] == phrase.split()]
        base = {p: places(p) for p in licenses.PHRASES}
        own = sorted({licenses.PHRASES[p] for p, at in base.items() if at} | {name for name, line in licenses.GRANTS.items() if places(line)})
        at = sorted(x for xs in base.values() for x in xs)
        assert (got[i].labels, got[i].n_base, got[i].first_word, got[i].last_word) == (",".join(own), len(at), at[0] if at else None, at[-1] if at else None)


def test_labels_of_the_table_are_more_than_the_base_ones(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    found = licenses.scan(docs).where("labels <> ''")
    assert found.where("labels <> base_labels").count() >= 200 and found.where("base_labels = ''").count() == 0


def test_each_word_is_encoded_once_in_its_range(spark, monkeypatch):
    from tideline.llm import bpe

    path = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")
    docs = spark.createDataFrame([(i, " ".join(f"w{(i * 7 + j) % 90}" for j in range(40))) for i in range(60)] + [(99, None)], "doc_id int, text string").repartition(3)
    assert bpe.word_ranges(docs, 2) == 2
    plain = sorted(map(tuple, bpe.round_trip(docs, path).collect()))
    monkeypatch.setattr(bpe, "word_ranges", lambda docs, least: 9)
    assert sorted(map(tuple, bpe.round_trip(docs, path).collect())) == plain
    many = spark.range(3000).selectExpr("id AS doc_id", "concat('a', id, ' b', id, ' a', id) AS text")
    sampled = many.select("text").mapInArrow(bpe._sampled_words, "h long").distinct().count()
    assert 0.5 * 6000 < bpe.SAMPLED * sampled < 2 * 6000
    given, encode = [], bpe.encode
    monkeypatch.setattr(bpe, "encode", lambda words, p: given.extend(words) or encode(words, p))
    asked = bpe._ask(1)(docs.select("doc_id", "text").toArrow().to_batches())
    list(bpe._answer(path)(iter([*asked, *bpe._ask(1)(docs.toArrow().to_batches())])))
    assert len(given) == len(set(given)) == 90 + ("" in given)
