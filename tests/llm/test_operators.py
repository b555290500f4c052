"""Each corpus operator against a plain version on small tables, with nulls, empty and long texts, ties, repeated rows,
empty tables and columns whose names clash."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tideline.llm import bpe, extraction, fingerprints, jaccard, katz, language, licenses, mixing, quality, tokens

TOKENIZER = "word_bpe_49k.json"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, label string, words string"


def path():
    return pytest.importorskip("public_tokenizers").path(TOKENIZER)


def sample() -> list[tuple]:
    rng = random.Random(5)
    vocabulary = ["alpha", "beta", "Gamma", "delta's", "été", "straße", "ñandú", "x", "long" * 9, "2024", "###", "<|endoftext|>"]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 60))) for _ in range(20)]
    base = " ".join(f"w{i}" for i in range(60))
    texts += [None, "", " \n\t ", "one", base, base, base.replace("w7 ", "changed "), base.upper(), base + " tail", "a" * 5000, "go " * 3000]
    texts += ["Licensed under the MIT License.\nfoo", "GNU General Public License and CC-BY, the apache  LICENSE", "\n".join(["same line here"] * 9)]
    rows = [(i, t, "en" if i % 2 else "fr", "s", 0, 0.0, "l", "w") for i, t in enumerate(texts)]
    return [*rows, rows[3], (None, "no id at all", None, None, None, None, None, None), (None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("docs") / "d")
    spark.createDataFrame(sample(), SCHEMA).repartition(3).write.parquet(at)
    return spark.read.parquet(at)


@pytest.fixture(scope="module")
def none(spark, docs, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("docs") / "e")
    docs.where("false").write.parquet(at)
    return spark.read.schema(docs.schema).parquet(at)


def key(row):
    return (row["doc_id"] is None, row["doc_id"] or 0, str(row))


def lower(t):
    return (t or "").translate({c: c + 32 for c in range(65, 91)})


def sha(t):
    return hashlib.sha256(t.encode()).hexdigest()


def words_of(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def test_tokens(spark, docs, none, tmp_path):
    known, cache = tokens.tokenizer(path()), str(tmp_path / "cache")
    assert tokens.token_counts(none, path(), cache).count() == 0
    want = sorted((r.doc_id is None, r.doc_id or 0, len((r.text or "").encode()), len(known.encode(r.text or "", add_special_tokens=False).ids)) for r in docs.collect())
    for _ in range(2):
        got = tokens.token_counts(docs, path(), cache, 50).collect()
        assert sorted((r.doc_id is None, r.doc_id or 0, r.n_bytes, r.n_tokens) for r in got) == want
        assert all(r.over_limit == (r.n_tokens > 50) for r in got)
    rows = spark.read.parquet(cache)
    assert rows.count() == rows.select("content").distinct().count() == len({re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "") for r in docs.collect()})


def test_bpe(docs, none, monkeypatch):
    monkeypatch.setattr(bpe, "BLOCK", 3000)
    known = tokens.tokenizer(path())
    got = bpe.round_trip(docs, path(), full=True).collect()
    assert len(got) == docs.count() and bpe.round_trip(none, path()).count() == 0
    want = Counter()
    for r in docs.collect():
        ids = known.encode(r.text or "", add_special_tokens=False).ids
        want[(r.doc_id, len(ids), sha(" ".join(map(str, ids))), sha(known.decode(ids, skip_special_tokens=False)), tuple(ids))] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256, tuple(r.ids)) for r in got) == want


def test_quality_counts(spark, docs, none):
    labels = spark.createDataFrame([(i, 1, 0) for i in range(0, 20, 2)] + [(1, 0, 1), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality.quality_rules(docs, labels).collect()
    assert len(got) == docs.count() and quality.quality_rules(none, labels).count() == 0
    for r in got:
        w = words_of(r.text)
        lines = [x for x in (r.text or "").split("\n") if words_of(x)]
        grams = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        covered = {j for i in range(len(w) - 7) if grams[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
        assert (r.n_words, r.word_chars, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(lines) - len(set(lines)), len(covered))
        assert r.n_symbols == len(re.findall(r"[#*$%&|<>]", r.text or ""))
        assert r.base_failed == (len(w) < 20 or 100 * len(covered) > 30 * len(w))
        assert not (r.kept and r.base_failed)
    bare = quality.quality_rules(docs, labels.where("false")).collect()
    assert all(r.kept == (not r.base_failed) and r.llr_score == 0 for r in bare)


def test_quality_ratio_separates(spark):
    good = [(i, " ".join(["the quick brown fox jumps over a lazy dog"] * 3 + [f"n{i}"])) for i in range(40)]
    bad = [(100 + i, " ".join(["zxq### vvv!! kkk%%"] * 10 + [f"m{i}"])) for i in range(40)]
    labels = spark.createDataFrame([(i, 1, 0) for i, _ in good[:30]], "doc_id long, quality int, toxic int")
    frame = spark.createDataFrame(good + bad, "doc_id long, text string")
    score = {r.doc_id: r.llr_score for r in quality.quality_rules(frame, labels).collect()}
    assert min(score[i] for i, _ in good) > max(score[i] for i, _ in bad)


def test_licenses(docs, none, spark):
    phrases = {tuple(k.split()): v for k, v in licenses.PHRASES.items()}
    got = licenses.scan(docs).collect()
    assert len(got) == docs.count() and licenses.scan(none).count() == 0
    texts = defaultdict(list)
    for r in docs.collect():
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(r.text))
        at = [(i, v) for p, v in phrases.items() for i in range(len(w)) if tuple(w[i : i + len(p)]) == p]
        texts[r.doc_id].append((len(w), len(at), min((i for i, _ in at), default=None), max((i for i, _ in at), default=None), ",".join(sorted({v for _, v in at}))))
    for r in got:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) in texts[r.doc_id]
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
    notice = licenses.NOTICES["mit-notice"].split()
    near = " ".join(["x"] * 7 + notice[:6] + ["inserted"] + notice[6:])
    row = licenses.scan(spark.createDataFrame([(1, near), (2, "of the the of in the")], "doc_id long, text string")).collect()
    assert {r.doc_id: r.labels for r in row} == {1: "mit-notice", 2: ""}


def shingles(t):
    w = words_of(lower(t))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def plain_components(rows):
    parent = {i: i for i in range(len(rows))}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    sets = [shingles(t) for _, t in rows]
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and rows[i][0] is not None and rows[j][0] is not None and 100 * len(a & b) >= 75 * len(a | b):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return Counter((d, len(s), None if d is None else least[find(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True)))


def test_jaccard(docs, none):
    got = jaccard.ngram_jaccard_join(docs).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == plain_components([(r.doc_id, r.text) for r in docs.collect()])
    assert jaccard.ngram_jaccard_join(none).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_jaccard_on_edited_copies(spark, tmp_path, seed):
    rng = random.Random(seed)
    word = lambda: f"v{rng.randint(0, 400)}"
    shared = [word() for _ in range(30)]
    rows = []
    for _ in range(12):
        base = [word() for _ in range(rng.randint(3, 90))] + (shared if rng.random() < 0.5 else [])
        for _ in range(rng.randint(1, 9)):
            copy = [word() if rng.random() < rng.choice([0.0, 0.01, 0.03, 0.06]) else w for w in base]
            rows.append((len(rows), " ".join(copy)))
    spark.createDataFrame(rows, "doc_id long, text string").repartition(4).write.parquet(str(tmp_path / "d"))
    got = jaccard.ngram_jaccard_join(spark.read.parquet(str(tmp_path / "d"))).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == plain_components(rows)


def test_jaccard_stage_keeps_one_of_each(spark, docs):
    kept = jaccard.stage(spark, docs, "")
    want = {r.component_id for r in jaccard.ngram_jaccard_join(docs).collect() if r.doc_id is not None}
    ids = [r.doc_id for r in kept.collect()]
    assert kept.columns == docs.columns and Counter(i for i in ids if i is not None) == Counter(want) and ids.count(None) == 2


def test_fingerprints(docs, none):
    got = sorted(fingerprints.compare_with_next(docs, 4).collect(), key=key)
    assert len(got) == docs.count() and fingerprints.compare_with_next(none, 4).count() == 0
    rows = [r for r in docs.collect()]
    by_id = defaultdict(list)
    for r in got:
        by_id[r.doc_id].append(r)
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    unique = [r for r in rows if sum(x.doc_id == r.doc_id for x in rows) == 1]
    order = sorted(r.doc_id for r in unique)
    text = {r.doc_id: r.text or "" for r in unique}
    for i in order:
        after = i + 1 if i + 1 in text else None
        if after is not None:
            t, m = text[i], len(text[i]) // 2
            assert by_id[i][0].edited_sha256 == sha(t[: len(t) - m] + text[after][:m]) and by_id[i][0].n_chars == len(t)
    assert by_id[24][0].fingerprint == by_id[25][0].fingerprint


def test_fingerprints_follow_content():
    import pyarrow as pa

    rng = random.Random(3)
    text = "".join(rng.choice("abcdefgh ") for _ in range(4000))
    (a, b, c, d), _ = fingerprints.fingerprint(pa.array([text, "some other opening " + text, text[:3600], "".join(rng.choice("abcdefgh ") for _ in range(4000))]))
    assert fingerprints.likeness(a, b) > 0.85 and fingerprints.likeness(a, c) > 0.7 and fingerprints.likeness(a, d) < 0.1
    (x, y), _ = fingerprints.fingerprint(pa.array([text, "neighbour"]))
    assert x == a and fingerprints.likeness(x, x) == 1.0


def test_katz(spark, docs, none, monkeypatch):
    monkeypatch.setattr(katz, "HOT_SHARE", 0.02)
    held_out = F.coalesce(F.col("doc_id"), F.lit(0)) % 3 == 1
    got = katz.katz_scores(docs, held_out, ranges=3).collect()
    assert len(got) == docs.count() and katz.katz_scores(none, held_out, ranges=3).count() == 0
    rows = [(r.doc_id, [*words_of(lower(r.text)), None], (r.doc_id or 0) % 3 == 1) for r in docs.collect()]
    one, two = Counter(), defaultdict(Counter)
    for _, t, held in rows:
        if not held:
            one.update(t)
            for a, b in zip(["\0start", *t], t):
                two[a][b] += 1
    total = sum(one.values())

    def low(counts):
        n = Counter(counts)
        return [n[i] for i in range(katz.GT_LIMIT + 2)]

    d1, d2 = katz.good_turing(low(one.values())), katz.good_turing(low([c for x in two.values() for c in x.values()]))
    cut = lambda c, d: c * (d[c] if c <= katz.GT_LIMIT else 1.0)
    free = sum(c - cut(c, d1) for c in one.values())
    size = total + (0 if free > 0 else 1)
    p1 = lambda w: cut(one[w], d1) / size if one[w] else (free if free > 0 else 1) / size

    def p2(w, h):
        if h not in two:
            return p1(w)
        n = sum(two[h].values())
        rest = n - sum(cut(c, d2) for c in two[h].values())
        whole = n if rest > 0 else n + 1
        below = sum(p1(x) for x in two[h])
        return cut(two[h][w], d2) / whole if two[h][w] else (rest if rest > 0 else 1) / whole / (1 - below) * p1(w)

    for h in list(two)[:5]:
        assert sum(p2(w, h) for w in [*one, "\0unseen"]) == pytest.approx(1.0)
    want = sorted((i is None, i or 0, round(sum(math.log10(p2(w, h)) for h, w in zip(["\0start", *t], t)), 6), len(t), sum(w in one for w in t), round(sum(math.log10((one[w] + 1) / (total + len(one) + 1)) for w in t), 6)) for i, t, _ in rows)
    assert sorted((r.doc_id is None, r.doc_id or 0, round(r.score, 6), r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got) == want
    assert {r.train_tokens for r in got} == {total}


def test_language(spark, none):
    rng = random.Random(1)
    pools = {"aa": "abcde", "bb": "defgh", "cc": "ghijé"}
    rows = []
    for i in range(300):
        lang = list(pools)[i % 3]
        rows.append((i, " ".join("".join(rng.choice(pools[lang]) for _ in range(4)) for _ in range(20)), lang))
    rows += [(1000, None, "aa"), (1001, "123 !?", None), (1002, "", None), (None, "abcd eabc", None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    models = language.train(language.training_rows(frame))
    got = {r.doc_id: r for r in language.identify(frame, models).collect()}
    assert len(got) == len(rows)
    assert all(got[i].lang_pred == lang and 0 <= got[i].score <= 1 for i, _, lang in rows[:300])
    assert all(got[i].lang_pred == "und" and got[i].score == 0 and got[i].rejected for i in (1000, 1001, 1002))
    strange = spark.createDataFrame([(1, "zwxyv " * 400)], "doc_id long, text string")
    assert language.identify(strange, models).first().rejected
    empty = language.train(none)
    assert language.identify(frame, empty).select("lang_pred").distinct().collect() == [("und",)]
    assert language.identify(none, models).count() == 0
    kept = language.keep_identified(frame, models)
    assert kept.columns == frame.columns and 1000 not in {r.doc_id for r in kept.collect()}


def test_language_probabilities_add_up():
    import numpy as np

    rng = np.random.default_rng(0)
    u, v, w = rng.integers(0, 12, (3, 500))
    model = language.KneserNey(u, v, w, np.ones(500))
    everything = np.arange(language.ALPHABET)
    for a, b in [(u[0], v[0]), (u[9], v[3]), (40, 41)]:
        assert model.probability(np.full(language.ALPHABET, a), np.full(language.ALPHABET, b), everything).sum() == pytest.approx(1.0)


def test_mixing(spark, docs, none):
    rng = random.Random(2)
    texts = {"clean": "river stone light", "poor": "buy now click", "toxic": "idiot clown scum"}
    rows, labels = [], []
    for i in range(600):
        d = list(texts)[0 if i % 10 < 6 else 1 if i % 10 < 9 else 2]
        rows.append((i, " ".join(rng.choice(texts[d].split() + ["the", "of"]) for _ in range(rng.randint(5, 60)))))
        if i % 2:
            labels.append((i, d))
    frame, labelled = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, domain string")
    targets = {"clean": 0.5, "poor": 0.4, "toxic": 0.1}
    out = mixing.mix(frame, labelled, targets).collect()
    total = sum(r.n_tokens for r in out)
    for k, name in enumerate(sorted(targets)):
        assert sum(r.n_tokens * r.posterior[k] * r.rate for r in out) == pytest.approx(targets[name] * total, abs=2e-3 * total)
    assert all(r.rate >= 0 and abs(r.copies - r.rate) < 1 for r in out)
    odd = mixing.mix(docs, labelled, targets).collect()
    assert len(odd) == docs.count() and mixing.mix(none, labelled, targets).count() == 0
    assert mixing.mix(docs, labelled.where("false"), targets).count() == docs.count()


PAGE = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style><script>var a="</p><p>no";</script></head><body><header><p>Site</p></header>
<nav><ul><li><a href="/x">Menu</a></li></ul></nav><div class="ad">Buy this</div><div id="cookie-notice">We use cookies</div>
<article><h1>Title &amp; more</h1><p>First  para<b> bold</b>
 end<br><p>Second.<p>Third &copy; &#233;<form>Mail <input></form></article><aside>Related</aside><div class="comments"><p>Nice!</p></div><footer>&copy; Us</footer>"""


def test_extraction(spark):
    assert extraction.main_text(PAGE) == "Title & more\nFirst para bold end\nSecond.\nThird © é"
    plain = "<html><body><ul><li><a href=a>Home</a><li><a href=b>News</a></ul>" + "".join(f"<p>{'Some words of the text. ' * 5}{i}</p>" for i in range(3)) + "<p>Short end.</p><div class=footer>(c)</div>"
    assert extraction.main_text(plain).split("\n")[-1] == "Short end." and "Home" not in extraction.main_text(plain)
    pages = spark.createDataFrame([(1, "u", PAGE, 7), (1, None, None, 7), (None, "v", "", 7), (2, "w", "<p>x", 7)], "page_id long, url string, html string, text long")
    got = extraction.extract(pages).collect()
    assert sorted((r.text, r.n_chars) for r in got)[:2] == [("", 0), ("", 0)] and {r.n_chars for r in got} == {0, 1, len(extraction.main_text(PAGE))}
    assert extraction.extract(pages.where("false")).count() == 0
    assert [w for w in extraction.spans([0, 0, 5, 0, 5, 0, 0, 0, 0, 0, 9], 3, 1)] == [(2, 5), (10, 11)]


def test_crc_matches(spark):
    rows = spark.range(50).select("id", language.crc_mod("id", 7).alias("m")).collect()
    assert all(r.m == zlib.crc32(str(r.id).encode()) % 7 for r in rows)
