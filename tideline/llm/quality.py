"""Quality rules: counted rules, then a hashed n-gram log-likelihood ratio of trusted target against raw corpus.

Built from DataFrame functions alone. Word unigrams and bigrams are hashed into a fixed number of buckets. One
multinomial is counted over the trusted documents (labelled good and not toxic), the other over every document; a
document's score is the mean over its n-grams of log(target / raw) of their buckets, so its length cancels out. The
threshold is a low quantile of the trusted documents' own scores, and every document is decided by it. Each document is
scored once: its score is written, and both the threshold and the verdict are taken from there.

The table of ratios has `buckets` numbers whatever the corpus, and is the only thing that passes through the driver.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import stored

BUCKETS = 1 << 13
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
#: Share of the trusted documents that may fall below the threshold.
TRUSTED_LOSS = 0.001
#: The threshold is a multiple of this.
GRID = 1e-4

_SYMBOLS = r"[#*$%&|<>]"


def _let(value: Column, body) -> Column:
    """body(value) with the value computed once."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), "")


def word_hashes(words: Column) -> Column:
    """A 64-bit hash of each word; n-grams and windows hash these, so a word's characters are read once."""
    return F.transform(words, lambda w: F.xxhash64(w))


def _window_hashes(hashes: Column) -> Column:
    size = F.size(hashes)
    return F.when(size >= WINDOW, F.transform(F.sequence(F.lit(1), F.greatest(size - (WINDOW - 1), F.lit(1))), lambda i: F.xxhash64(F.slice(hashes, i, WINDOW)))).otherwise(F.array().cast("array<bigint>"))


def _covered(windows: Column) -> Column:
    """Words inside windows whose hash occurs twice or more: sort by hash, keep neighbours that agree, add up the gaps."""
    ordered = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def repeated(s: Column) -> Column:
        n = F.size(s)
        twin = lambda j: ((j > 1) & (F.get(s, j - 2)["h"] == F.get(s, j - 1)["h"])) | ((j < n) & (F.get(s, j - 1)["h"] == F.get(s, j)["h"]))
        return F.array_sort(F.transform(F.filter(F.sequence(F.lit(1), n), twin), lambda j: F.get(s, j - 1)["i"]))

    total = lambda p: F.aggregate(
        p, F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("sum")), lambda a, i: F.struct(i.alias("last"), (a["sum"] + F.least(F.lit(WINDOW), i - a["last"])).alias("sum")), lambda a: a["sum"]
    )
    return _let(ordered, lambda s: _let(repeated(s), total))


def judged(text: Column, ratio: list[float] | None = None, buckets: int | None = None) -> Column:
    """A struct of n_words, word_chars, n_repeat_words, llr_score and base_failed.

    One expression that splits the text once: as separate columns, a filter on one would be pushed below them and copy
    each into the others.
    """

    def counted(w: Column, h: Column) -> Column:
        score = F.lit(0.0) if ratio is None else ratio_score(h, ratio, buckets or len(ratio))
        repeated = lambda x: F.when(F.size(F.array_distinct(x)) < F.size(x), _covered(x)).otherwise(F.lit(0)).cast("long")
        return F.struct(F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), _let(_window_hashes(h), repeated).alias("n_repeat_words"), score.alias("llr_score"))

    def decided(c: Column) -> Column:
        failed = (c["n_words"] < MIN_WORDS) | (100 * c["n_repeat_words"] > MAX_REPEAT_PERCENT * c["n_words"])
        return F.struct(c["n_words"].alias("n_words"), c["word_chars"].alias("word_chars"), c["n_repeat_words"].alias("n_repeat_words"), c["llr_score"].alias("llr_score"), failed.alias("base_failed"))

    return _let(_let(words_of(text), lambda w: _let(word_hashes(w), lambda h: counted(w, h))), decided)


def line_counts(docs: DataFrame) -> DataFrame:
    """Adds n_symbols and n_dup_lines; a null text has none."""
    text = F.coalesce(F.col("text"), F.lit(""))
    full_lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    return docs.withColumn("n_symbols", F.regexp_count(text, F.lit(_SYMBOLS)).cast("long")).withColumn("n_dup_lines", _let(full_lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"))


def ngram_buckets(hashes: Column, buckets: int) -> Column:
    """Buckets of all unigrams and bigrams of words with these hashes."""
    single = F.transform(hashes, lambda h: F.pmod(h, F.lit(buckets)).cast("int"))
    pair = F.transform(F.slice(hashes, 2, F.greatest(F.size(hashes) - 1, F.lit(0))), lambda h, i: F.pmod(F.xxhash64(F.get(hashes, i), h), F.lit(buckets)).cast("int"))
    return F.concat(single, pair)


def trusted_ids(labels: DataFrame) -> DataFrame:
    """The ids of all documents labelled good and not toxic, each once."""
    good = labels.where((F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) != 1) & F.col("doc_id").isNotNull())
    return good.select("doc_id").distinct()


def _bucket_counts(docs: DataFrame, buckets: int) -> dict[int, int]:
    grams = docs.select(F.explode(_let(word_hashes(words_of(F.col("text"))), lambda h: ngram_buckets(h, buckets))).alias("b"))
    return {r["b"]: r["n"] for r in grams.groupBy("b").agg(F.count(F.lit(1)).alias("n")).collect()}


def fit_ratio(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS) -> list[float]:
    """log(target / raw) for each bucket; all zero without trusted documents.

    Raw counts are taken over every document, target counts over every trusted one, which a join finds. The join is the
    same at any number of trusted ids: texts cross the network once. The counts come back as one number for each bucket.
    """
    docs = docs.select("doc_id", "text")
    target = _bucket_counts(docs.join(trusted.hint("merge"), "doc_id", "left_semi"), buckets)
    raw_counts = _bucket_counts(docs, buckets) if target else {}
    rows = {b: (target.get(b, 0), n) for b, n in raw_counts.items()}
    t_all, n_all = sum(t for t, _ in rows.values()), sum(n for _, n in rows.values())
    if not t_all:
        return [0.0] * buckets
    counts = [rows.get(b, (0, 0)) for b in range(buckets)]
    raw = [(n + 1.0) / (n_all + buckets) for _, n in counts]
    # The target is smoothed towards the raw multinomial: what neither has seen says nothing.
    return [math.log((t + buckets * p) / (t_all + buckets) / p) for (t, _), p in zip(counts, raw, strict=True)]


def ratio_score(hashes: Column, ratio: list[float], buckets: int = BUCKETS) -> Column:
    """Mean log-likelihood ratio of the n-grams of words with these hashes; 0 without words."""
    table = F.split(F.lit(",".join(map(repr, ratio))), ",").cast("array<double>")  # folds to one literal
    total = F.aggregate(ngram_buckets(hashes, buckets), F.lit(0.0), lambda a, b: a + F.get(table, b))
    return F.when(F.size(hashes) > 0, total / (2 * F.size(hashes) - 1)).otherwise(F.lit(0.0))


def threshold_of(scored: DataFrame, trusted: DataFrame) -> float:
    """The threshold, from the scores of all trusted documents of MIN_WORDS words or more.

    scored: doc_id, n_words, llr_score as written rows, so that only numbers are joined and nothing is scored again.
    """
    step = F.floor(F.col("llr_score") / GRID).cast("long").alias("step")
    full = scored.where(F.col("n_words") >= MIN_WORDS).select("doc_id", "llr_score")
    return low_quantile({r["step"]: r["n"] for r in full.join(trusted, "doc_id").groupBy(step).agg(F.count(F.lit(1)).alias("n")).collect()})


def low_quantile(counts: dict[int, int]) -> float:
    """The lower end of the step that holds the TRUSTED_LOSS quantile; -inf without scores. Exact counts, so that it is
    the same in every run; a score is a mean of bounded logarithms, so the steps are bounded in number."""
    left = TRUSTED_LOSS * sum(counts.values())
    for step in sorted(counts):
        left -= counts[step]
        if left < 0:
            return step * GRID
    return -math.inf


_COUNTS = ["n_words", "word_chars", "n_repeat_words", "llr_score", "base_failed"]


def _decided(docs: DataFrame, labels: DataFrame, buckets: int, drop: tuple[str, ...] = ()) -> tuple[DataFrame, str, Column]:
    """docs without the columns to drop and with a struct of counts and score, its name, and the verdict on a row. Every
    text is scored once: the scores are written with the rows, and the threshold is taken from the written scores."""
    trusted = trusted_ids(labels)
    ratio = fit_ratio(docs, trusted, buckets)
    name = "_judged"
    while name in docs.columns:
        name += "_"
    rows = stored(docs.select(*[F.col(c) for c in docs.columns if c not in drop], judged(F.col("text"), ratio, buckets).alias(name)), "quality-scores")
    threshold = threshold_of(rows.select("doc_id", f"{name}.n_words", f"{name}.llr_score"), trusted)
    return rows, name, ~F.col(name)["base_failed"] & (F.col(name)["llr_score"] >= threshold)


def quality_rules(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, keep_text: bool = True) -> DataFrame:
    """The input's rows with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, llr_score, base_failed and kept.

    labels: doc_id, quality, toxic; trusted are quality 1 and toxic not 1. Null ids are never trusted, an empty table
    of labels gives a score of 0 and a threshold of -inf, so that only the counted rules decide. A null or empty text
    has no words and fails. Equal texts get equal verdicts, repeated rows stay repeated, columns of these names in the
    input are replaced. Texts of any length are scored whole. The rows are written to a scratch table once, with the
    text only if it is to be kept.
    """
    rows, name, verdict = _decided(line_counts(docs), labels, buckets, () if keep_text else ("text",))
    old = [F.col(c) for c in rows.columns if c not in (*_COUNTS, "kept", name)]
    return rows.select(*old, *[F.col(name)[c].alias(c) for c in _COUNTS], verdict.alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows = quality_rules(docs.select("doc_id", "text"), labels, keep_text=False)
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "llr_score")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents that the rules keep, with the columns of documents."""
    rows, _, verdict = _decided(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), BUCKETS)
    return rows.where(verdict).select(*docs.columns)
