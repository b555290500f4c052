"""The pipeline's stages on the smallest tables: each on what the stage before it kept."""

import hashlib
import re
from collections import Counter

import pytest

import corpus_pipeline
from tests.llm.test_operators import TOKENIZER, plain_components, words_of
from tideline.llm import quality, tokens
from tideline.llm._common import stored

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        kept = stored(stage(spark, docs, SF), name)
        out.append((name, docs, kept))
        docs = kept
    return out


def test_columns(steps):
    assert [s[0] for s in steps] == ["language_id", "quality_rules", "ngram_jaccard", "source_mixing", "bpe_round_trip"]
    for _, before, after in steps[:-1]:
        assert after.schema.simpleString() == before.schema.simpleString()
        assert set(after.collect()) <= set(before.collect())


def test_language_keeps_texts_with_letters(steps):
    _, before, after = steps[0]
    kept = {r.doc_id for r in after.collect()}
    assert all(re.search(r"[^\W\d_]", r.text) for r in after.collect())
    assert len(kept) >= 0.98 * before.count()


def test_quality_drops_what_fails_the_rules(spark, steps):
    _, before, after = steps[1]
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    want = {r.doc_id for r in quality.quality_rules(before, labels).where("kept").collect()}
    assert {r.doc_id for r in after.collect()} == want
    assert all(len(words_of(r.text)) >= quality.MIN_WORDS for r in after.collect())
    good = {r.doc_id for r in labels.where("quality = 1 AND toxic = 0").collect()}
    long = {r.doc_id for r in quality.quality_rules(before, labels).where("NOT base_failed").collect()}
    assert len(good & long - want) <= 1


def test_one_of_each_component_stays(steps):
    _, before, after = steps[2]
    rows = [(r.doc_id, r.text) for r in before.collect()]
    assert sorted(r.doc_id for r in after.collect()) == sorted({c for _, _, c in plain_components(rows)})


def test_mixing_repeats_documents(steps):
    _, before, after = steps[3]
    n = Counter(r.doc_id for r in after.collect())
    assert 0.7 * before.count() <= sum(n.values()) <= 1.5 * before.count() and max(n.values()) <= 4


def test_tokens_of_every_row(steps):
    _, before, after = steps[4]
    known = tokens.tokenizer(pytest.importorskip("public_tokenizers").path(TOKENIZER))
    want = Counter()
    for r in before.collect():
        ids = known.encode(r.text or "", add_special_tokens=False).ids
        want[(r.doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256) for r in after.collect()) == want
