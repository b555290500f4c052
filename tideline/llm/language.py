"""Language identification by interpolated Kneser-Ney character trigram models, one per language.

Training counts character trigrams of a bounded sample of labelled documents in Spark and collects one row for each
distinct (language, trigram). A model keeps its numbers in sorted arrays of hashed n-grams, looked up by binary
search; scoring tasks ask for each distinct trigram once and remember the answer in a table over the alphabet.

Characters: letters in lower case, of which the ALPHABET - 2 most frequent have a symbol of their own and the others
share one; everything else is one gap symbol. A text is read as if a gap stood before it.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import batch, bounded, code_points, crc_mod, mix, pieces

ALPHABET = 64
FOLDS, HELD_OUT = 5, 0
#: The models and the rejection limits are fitted on so many labelled documents at most.
SAMPLE = 12_000
#: Rejected are texts whose cross-entropy lies this many times as far above their language's mean as the worst of the
#: calibration sample but for a thousandth (the distance is scaled by the root of the length, up to LONG characters).
SLACK, QUANTILE, LONG = 4.0, 0.999, 2000

_GAP, _OTHER = 0, ALPHABET - 1
_BMP = 1 << 16


def _lower_letters() -> np.ndarray:
    """For each code point of the basic plane: its lower-case letter's code point, or 0 for what is no letter."""
    table = np.zeros(_BMP, np.uint32)
    for c in range(_BMP):
        x = chr(c)
        if x.isalpha():
            low = x.lower()
            table[c] = ord(low) if len(low) == 1 and ord(low) < _BMP else c
    return table


_letters: np.ndarray | None = None


def letters(points: np.ndarray) -> np.ndarray:
    """Lower-case letters of code points, 0 for the rest; letters outside the basic plane count as U+FFFF."""
    global _letters
    if _letters is None:
        _letters = _lower_letters()
    low = _letters[np.minimum(points, _BMP - 1)]
    far = np.flatnonzero(points >= _BMP)
    if len(far):
        low[far] = [_BMP - 1 if chr(c).isalpha() else 0 for c in points[far]]
    return low


def _keys(*parts: np.ndarray) -> np.ndarray:
    """A hash of an n-gram of symbols; its length is part of it."""
    h = np.full(len(parts[0]), len(parts), np.uint64)
    for p in parts:
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + p.astype(np.uint64) + np.uint64(1))
    return h


class _Table:
    """Numbers by n-gram: a sorted array of hashes and the values in the same order; 0 for what is absent."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.values = keys[order], values[order]

    def get(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.zeros(len(keys))
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.values[at], 0.0)


def _sums(values: np.ndarray, *parts: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Distinct combinations of the parts, with the sum of the values and the number of rows of each."""
    code = np.zeros(len(values), np.int64)
    for p in parts:
        code = code * ALPHABET + p
    unique, inverse = np.unique(code, return_inverse=True)
    cut = []
    for _ in parts:
        cut.append(unique % ALPHABET)
        unique = unique // ALPHABET
    return cut[::-1], np.bincount(inverse, values), np.bincount(inverse).astype(float)


def _discount(counts: np.ndarray) -> float:
    n1, n2 = np.sum(counts == 1), np.sum(counts == 2)
    return float(n1 / (n1 + 2 * n2)) if n1 and n2 else 0.5


class KneserNey:
    """An interpolated model: discounted trigram counts, then continuation counts of bigrams and of single symbols."""

    def __init__(self, u: np.ndarray, v: np.ndarray, w: np.ndarray, counts: np.ndarray):
        self.levels = []
        (u, v, w), counts, _ = _sums(counts, u, v, w)
        self._level(counts, (u, v), w)
        (v, w), _, kinds = _sums(counts, v, w)  # a bigram counts once for each symbol before it
        self._level(kinds, (v,), w)
        (w,), _, kinds = _sums(kinds, w)
        d = _discount(kinds)
        total = max(kinds.sum(), 1.0)
        self.single = _Table(_keys(w), np.maximum(kinds - d, 0) / total)
        self.floor = (d * len(w) / total if len(w) else 1.0) / ALPHABET

    def _level(self, counts: np.ndarray, context: tuple, w: np.ndarray) -> None:
        d = _discount(counts)
        group, totals, kinds = _sums(counts, *context)
        total = _Table(_keys(*group), totals)
        own = np.maximum(counts - d, 0) / np.maximum(total.get(_keys(*context)), 1.0)
        self.levels.append((_Table(_keys(*context, w), own), _Table(_keys(*group), d * kinds / totals), total))

    def probability(self, u: np.ndarray, v: np.ndarray, w: np.ndarray) -> np.ndarray:
        p = self.single.get(_keys(w)) + self.floor
        for (own, rest, total), context in zip(self.levels[::-1], ((v,), (u, v)), strict=True):
            key = _keys(*context)
            p = np.where(total.get(key) > 0, own.get(_keys(*context, w)) + rest.get(key) * p, p)
        return p


class Models:
    """The languages' models, and their numbers remembered by trigram of the alphabet."""

    def __init__(self, names: list[str], alphabet: np.ndarray, models: list[KneserNey], limits: list[tuple[float, float]] | None = None):
        self.names, self.alphabet, self.models, self.limits = names, alphabet, models, limits
        self.memo = self.seen = None

    def __getstate__(self):
        return self.__dict__ | {"memo": None, "seen": None}

    def symbols(self, low: np.ndarray) -> np.ndarray:
        table = np.full(_BMP, _OTHER, np.int32)
        table[0] = _GAP
        table[self.alphabet] = np.arange(1, len(self.alphabet) + 1)
        self.symbols = lambda x: table[x]
        return table[low]

    def costs(self, codes: np.ndarray) -> np.ndarray:
        """-log2 of each trigram's probability, a column for each language."""
        if self.memo is None:
            self.memo = np.zeros((ALPHABET**3, len(self.models)), np.float32)
            self.seen = np.zeros(ALPHABET**3, bool)
        new = np.flatnonzero((np.bincount(codes, minlength=ALPHABET**3) > 0) & ~self.seen)
        if len(new):
            u, v, w = new // ALPHABET**2, new // ALPHABET % ALPHABET, new % ALPHABET
            for k, m in enumerate(self.models):
                self.memo[new, k] = -np.log2(m.probability(u, v, w))
            self.seen[new] = True
        return self.memo[codes]

    def score(self, column: pa.Array):
        """For each text: number of letters, number of characters read, cross-entropies in bits (a row of languages)."""
        n = len(column)
        n_letters, length, bits = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros((n, len(self.models)))
        for a, b, data, offsets in pieces(column):
            points, at = code_points(data, offsets)
            if not len(points):
                continue
            low = letters(points)
            s = self.symbols(low)
            codes = _trigrams(s, at)
            costs = self.costs(codes)
            full = np.flatnonzero(at[1:] > at[:-1])
            n_letters[a + full] = np.add.reduceat((low > 0).astype(np.int64), at[full])
            length[a + full] = np.diff(at)[full]
            bits[a + full] = np.add.reduceat(costs, at[full], axis=0, dtype=np.float64)
        return n_letters, length, bits / np.maximum(length, 1)[:, None]


def _trigrams(s: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Codes of the trigrams that end at each symbol; before a text there are gaps."""
    one, two = np.zeros_like(s), np.zeros_like(s)
    one[1:], two[2:] = s[:-1], s[:-2]
    begin = at[:-1][at[1:] > at[:-1]]
    one[begin] = two[begin] = _GAP
    second = at[:-1][at[1:] > at[:-1] + 1] + 1
    two[second] = _GAP
    return (two * ALPHABET + one) * ALPHABET + s


def _count_trigrams(batches):
    """(lang, trigram of lower-case letters, count) of each batch; a letter takes 16 bits of the code."""
    schema = pa.schema([("lang", pa.string()), ("code", pa.int64()), ("n", pa.int64())])
    for rb in bounded(batches):
        langs = np.array(rb.column(1).to_pylist(), object)
        for a, b, data, offsets in pieces(rb.column(0)):
            points, at = code_points(data, offsets)
            if not len(points):
                continue
            low = letters(points).astype(np.int64)
            one, two = np.zeros_like(low), np.zeros_like(low)
            one[1:], two[2:] = low[:-1], low[:-2]
            begin = at[:-1][at[1:] > at[:-1]]
            one[begin] = two[begin] = 0
            two[at[:-1][at[1:] > at[:-1] + 1] + 1] = 0
            code = (two << 32) | (one << 16) | low
            who = np.repeat(langs[a:b], np.diff(at))
            for lang in set(langs[a:b]):
                keys, n = np.unique(code[who == lang], return_counts=True)
                yield batch(schema, pa.array([lang] * len(keys), pa.string()), keys, n)


def train(docs: DataFrame, bound: int = SAMPLE) -> Models:
    """Models of the languages that occur in a sample of at most `bound` rows with a language and a text.

    The sample takes the smallest hashes of the ids, so it does not depend on the order of the rows. Four fifths of
    it train, the rest calibrate the rejection limits. Without any labelled row
    that has characters there are no languages.
    """
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    known = known.select("doc_id", "text", "lang", F.xxhash64("doc_id").alias("_h"))
    top = known.select("_h").orderBy("_h").limit(bound).agg(F.max("_h").alias("h")).first()["h"]
    if top is None:
        return Models([], np.zeros(0, np.int64), [], [])
    sample = known.where(F.col("_h") <= top)
    fit = sample.where(F.pmod(F.xxhash64("_h"), F.lit(5)) != 0)
    counts = fit.select("text", "lang").mapInArrow(_count_trigrams, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n")).toPandas()
    use = counts.groupby(counts.code.to_numpy() & 0xFFFF).n.sum()
    use = use[use.index > 0].sort_index().sort_values(ascending=False, kind="stable").index.to_numpy()[: ALPHABET - 2]
    models = Models(sorted(counts.lang.unique()), np.sort(use), [])
    for name in models.names:
        own = counts[counts.lang == name]
        code = own.code.to_numpy()
        u, v, w = (models.symbols((code >> k) & 0xFFFF) for k in (32, 16, 0))
        models.models.append(KneserNey(u.astype(np.int64), v.astype(np.int64), w.astype(np.int64), own.n.to_numpy().astype(float)))
    models.__dict__.pop("symbols", None)  # its table belongs to this process

    if not models.names:  # labelled rows, but none of them with a character to learn from
        models.limits = []
        return models

    def residuals(batches):
        schema = pa.schema([("k", pa.int32()), ("bits", pa.float64()), ("n", pa.int64())])
        for rb in bounded(batches):
            found, n, bits = models.score(rb.column(0))
            ok = found > 0
            best = bits.argmin(axis=1)
            yield batch(schema, best[ok], bits[ok, best[ok]], n[ok])

    rest = sample.where(F.pmod(F.xxhash64("_h"), F.lit(5)) == 0).select("text").mapInArrow(residuals, "k int, bits double, n long").toPandas()
    models.limits = []
    for k in range(len(models.names)):
        own = rest[rest.k == k]
        if not len(own):
            models.limits.append((math.inf, math.inf))
            continue
        mean = float(np.average(own.bits, weights=own.n))
        far = (own.bits - mean) * np.sqrt(np.minimum(own.n, LONG))
        models.limits.append((mean, SLACK * max(float(np.quantile(far, QUANTILE)), 1e-9)))
    models.memo = models.seen = None
    return models


def identify(docs: DataFrame, models: Models) -> DataFrame:
    """doc_id, lang_pred, score (share of the best language after softmax over a thousand characters at most), bits
    (cross-entropy a character) and rejected, a row for each row of docs.

    The language has the lowest cross-entropy, ties go to the first name. A text that is null or has no letter gets
    'und', score 0 and is rejected; so is every text if no language was learned. A text is also rejected if its
    cross-entropy is above its language's limit for its length. Ids may be null or repeated; other columns are ignored.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for rb in bounded(batches):
            found, n, bits = models.score(rb.column(1)) if models.names else (np.zeros(rb.num_rows, int),) * 2 + (np.zeros((rb.num_rows, 1)),)
            best = bits.argmin(axis=1)
            low = bits[np.arange(len(best)), best]
            share = 1 / np.exp2(-np.minimum(n, 1000)[:, None] * (bits - low[:, None])).sum(axis=1)
            none = found == 0
            mean, far = (np.array([x[i] for x in models.limits] or [0.0])[best] for i in (0, 1))
            out = none | (low > mean + far / np.sqrt(np.maximum(np.minimum(n, LONG), 1)))
            names = np.array([*models.names, "und"], object)[np.where(none, -1, best)]
            yield pa.RecordBatch.from_arrays(
                [rb.column(0), pa.array(names, pa.string()), pa.array(np.where(none, 0.0, share)), pa.array(np.where(none, 0.0, low)), pa.array(out)],
                names=["doc_id", "lang_pred", "score", "bits", "rejected"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, bits double, rejected boolean")


def training_rows(docs: DataFrame) -> DataFrame:
    return docs.where(crc_mod("doc_id", FOLDS) != HELD_OUT)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = identify(docs, train(training_rows(docs)))
    return found.select("doc_id", (crc_mod("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "lang_pred", "score", "bits", "rejected")


def keep_identified(docs: DataFrame, models: Models) -> DataFrame:
    """The rows of docs, with all their columns, that are not rejected."""

    def run(batches):
        for rb in bounded(batches):
            i = rb.schema.get_field_index("text")
            found, n, bits = models.score(rb.column(i)) if models.names else (np.zeros(rb.num_rows, int),) * 2 + (np.zeros((rb.num_rows, 1)),)
            best = bits.argmin(axis=1)
            mean, far = (np.array([x[k] for x in models.limits] or [0.0])[best] for k in (0, 1))
            ok = (found > 0) & (bits[np.arange(len(best)), best] <= mean + far / np.sqrt(np.maximum(np.minimum(n, LONG), 1)))
            yield rb.filter(pa.array(ok))

    return docs.mapInArrow(run, docs.schema)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents whose language is known; the models are learned from the stage's own input."""
    return keep_identified(docs, train(training_rows(docs)))
