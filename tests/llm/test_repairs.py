"""Cases that once failed: rows alike but for their order, ids that are no numbers, labelled rows without letters, texts
of repeated passages, and many rows without an id."""

import hashlib
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tideline.llm import bpe, fingerprints, katz, language
from tideline.llm._common import _BASE, id_hashes, sequence_hash


@pytest.mark.parametrize("kind, ids", [("long", [None, None]), ("string", ["a", "b"]), ("int", [7, 7])])
def test_katz_blocks_with_equal_words_in_another_order(spark, tmp_path, kind, ids):
    texts = ["a b c a b b", "c a c b b a a c c c"]
    apart = str(tmp_path / "apart")
    for i, t in zip(ids, texts, strict=True):
        spark.createDataFrame([(i, t)], f"doc_id {kind}, text string").write.mode("append").parquet(apart)
    together = str(tmp_path / "together")
    spark.createDataFrame(list(zip(ids, texts, strict=True)), f"doc_id {kind}, text string").coalesce(1).write.parquet(together)
    score = lambda at: sorted(round(r.score, 9) for r in katz.katz_scores(spark.read.parquet(at), F.lit(False), ranges=2).collect())
    found = score(apart)
    assert len(found) == 2 and found == score(together)


def test_text_ids(spark, tmp_path):
    path = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")
    rows = [("x", "one two"), (None, None), ("y", "three"), ("x", "one two")]
    spark.createDataFrame(rows, "doc_id string, text string").write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    assert sorted(str(r.doc_id) for r in bpe.round_trip(docs, path).collect()) == ["None", "x", "x", "y"]
    assert sorted(str(r.doc_id) for r in fingerprints.compare_with_next(docs, 3).collect()) == ["None", "x", "x", "y"]


@pytest.mark.parametrize("text", ["", "123 !?", "é"])
def test_language_of_labelled_rows_that_give_no_trigram(spark, text):
    for i in range(6):
        models = language.train(spark.createDataFrame([(i, text, "en")], "doc_id long, text string, lang string"))
        found = language.identify(spark.createDataFrame([(1, "some words"), (2, None)], "doc_id long, text string"), models).collect()
        assert len(found) == 2


def test_names_depend_on_order_and_nulls():
    import numpy as np

    a = np.arange(5, dtype=np.uint64)
    assert sequence_hash(a) != sequence_hash(a[::-1]) and sequence_hash(a, a[:0]) != sequence_hash(a[:0], a)
    h = id_hashes(pa.array([1, None, 1, 2]))
    assert h[0] == h[2] != h[3] and h[1] not in (h[0], h[3])


def likeness_of(*texts):
    prints, _ = fingerprints.fingerprint(pa.array(texts, pa.large_string()))
    return prints, fingerprints.likeness(prints[0], prints[1])


def test_repeated_passages_keep_their_sketch():
    (print_, _), like = likeness_of("abc def ghi jkl " * 20_000, "")
    assert print_ and like == 0.0
    rng = random.Random(4)
    lines = ["".join(rng.choice("abcdefghij ") for _ in range(60)) for _ in range(40)]
    (a, b), like = likeness_of("\n".join(rng.choice(lines) for _ in range(4_000)), "\n".join(rng.choice(lines) for _ in range(3_000)))
    assert len(a) == len(b) == 8 * fingerprints.SKETCH and like > 0.5


def test_no_switch_at_a_length():
    rng = random.Random(9)
    text = "".join(rng.choice("abcdefgh ") for _ in range(300))
    for n in range(150, 290):
        _, like = likeness_of(text[:n], text[: n + 2])
        assert like > 0.6


def plain_sketch(text: str) -> set[int]:
    """The parse read off its definition, one name after the other."""
    mask = 2**64 - 1

    def mix(h):
        h ^= h >> 32
        h = h * 0xD6E8FEB86659FD93 & mask
        h ^= h >> 32
        h = h * 0xD6E8FEB86659FD93 & mask
        return h ^ h >> 32

    def toss(x, bits):
        out = [x[0] & 1]
        for a, b in zip(x, x[1:]):
            k = ((a ^ b) & -(a ^ b)).bit_length() - 1 if a != b else bits  # only a text's first label can equal the next
            out.append(2 * k + (b >> k & 1))
        return out

    base, run = int(_BASE), 0x9E3779B97F4A7C15
    names, found = [mix(ord(c) + 0x51ED27) for c in text], set()
    for level in range(1, max(fingerprints.LEVELS) + 1):
        runs = []
        for n in names:
            if runs and runs[-1][0] == n:
                runs[-1][1] += 1
            else:
                runs.append([n, 1])
        names = [n if k == 1 else mix((n + k * run) & mask) for n, k in runs]
        labels = toss(names, 64)
        for _ in range(3):
            labels = toss(labels, 8)
        last = len(names) - 1
        starts = [0] + [i for i in range(2, last) if labels[i] < labels[i - 1] and labels[i] <= labels[i + 1]]
        names = [mix(sum(n * pow(base, j, 2**64) for j, n in enumerate(names[a:b])) & mask) for a, b in zip(starts, [*starts[1:], len(names)])]
        if level in fingerprints.LEVELS:
            found |= {mix(n ^ (0xA5A5A5A5 + level)) for n in names}
    return found


def test_parse_and_likeness_against_a_plain_version(spark, tmp_path):
    rng = random.Random(12)
    texts = ["".join(rng.choice("abcd é\n") for _ in range(n)) for n in (1, 2, 3, 5, 17, 90, 400, 1500)] + ["aaaa", "", "abababab" * 30]
    prints, sizes = fingerprints.fingerprint(pa.array(texts, pa.large_string()))
    for t, p, n in zip(texts, prints, sizes, strict=True):
        want = sorted(plain_sketch(t))[: fingerprints.SKETCH] if t else []
        assert p == "".join(f"{h >> 32:08x}" for h in want) and n == len(t)
    rows = list(enumerate(texts))
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "d"))
    got = {r.doc_id: r for r in fingerprints.compare_with_next(spark.read.parquet(str(tmp_path / "d")), 4).collect()}
    for i, t in rows:
        after = texts[(i + 1) % len(texts)]
        m = len(t) // 2
        edited = t[: len(t) - m] + after[:m]
        prints, _ = fingerprints.fingerprint(pa.array([t, edited, after], pa.large_string()))
        assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert [got[i].fingerprint, got[i].edited_fingerprint] == prints[:2]
        assert got[i].near_edited == fingerprints.likeness(prints[0], prints[1]) and got[i].near_next == fingerprints.likeness(prints[0], prints[2])


def test_many_rows_without_an_id_are_spread(spark, tmp_path):
    rows = [(None, f"text number {i}") for i in range(60)] + [(i, f"other {i}") for i in range(30)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    parts = fingerprints._by_neighbour(docs, 6).where("doc_id is null and not is_edge").select("part").distinct().count()
    got = fingerprints.compare_with_next(docs, 6).collect()
    assert parts > 2 and len(got) == 90
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    assert {r.doc_id: r for r in got}[29].edited_sha256 not in {hashlib.sha256(t.encode()).hexdigest() for _, t in order}
