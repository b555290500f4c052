"""Katz backoff model of words: Good-Turing discounted n-gram counts with exactly normalised backoff weights.

Texts are taken in blocks; a block's distinct words and pairs of words cross the network packed, with their counts.

1. Words go to ranges of the hash space, which add up the training counts over all blocks and number the words that
   training has seen: the unigram table, a partition for each range. The same task answers each block's question.
2. For each length from two to the order: n-grams of word numbers go to ranges dealt by the context (all words but the
   last); those of a very frequent context are dealt by all words. A block asks only where training has seen the
   context, which the length before has answered. Ranges add up the training counts: the n-gram table, partitioned
   likewise. The task answers each block with its n-grams' counts and, for each context, with its total, the mass that
   the shorter context gives the words seen after it, and how many of these were seen 1, 2, ... times; what a very
   frequent context has in each range is added up afterwards.
3. Counts of counts give the Good-Turing discounts of every length. A context's backoff weight is (1 - discounted mass
   of the words seen after it) / (1 - mass of the same words one word shorter), so its probabilities add up to one.
4. Blocks meet their answers and score every token from the words up: the discounted n-gram if training has seen it,
   else the weight of its context times the probability one word shorter. A text begins with one start word, so its
   first tokens have the contexts that are there.

The unigram level is discounted too; its free mass belongs to one class of unseen words. docs is read more than once
and must give the same rows each time, as files do.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import crc_mod, id_hashes, mix, pieces, release, scratch, sequence_hash, word_hashes
from .bpe import _blocks, _join_bytes, _numbers, _planes, _split_bytes, _unzip, _zip

FOLDS, HELD_OUT = 7, 2
#: Bytes of text in a block.
BLOCK = 12 << 20
#: Counts above this are not discounted.
GT_LIMIT = 5
#: Words of the longest n-grams, unless the caller asks for others.
ORDER = 2
#: Ranges of longer n-grams for each range of words.
GRAM_RANGES = 4
#: A context with more than this share of a range's even part of the training tokens is dealt by all words.
HOT_SHARE = 0.25

_END = np.uint64(0x454E445F454E4421)
_START = np.uint64(0x53544152545F5421)


def _tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's words and its end, and each text's first token (then the number of all)."""
    out, sizes = [], [np.zeros(0, np.int64)]
    for _, _, data, offsets in pieces(texts):
        w, first = word_hashes(data, offsets)
        n = np.diff(first)
        h = np.full(len(w) + len(n), _END)
        ends = np.cumsum(n + 1) - 1
        keep = np.ones(len(h), bool)
        keep[ends] = False
        h[keep] = w
        out.append(h)
        sizes.append(n + 1)
    first = np.concatenate([[0], np.cumsum(np.concatenate(sizes))]).astype(np.int64)
    return np.concatenate(out) if out else np.zeros(0, np.uint64), first


class _Block:
    """A block's tokens as numbers of its distinct words, which are sorted by hash; the start is a word as well."""

    def __init__(self, ids: pa.Array, held: np.ndarray, texts: pa.Array):
        h, self.first = _tokens(texts)
        words, index = np.unique(np.append(h, _START), return_inverse=True)
        self.words, self.index = words, index[:-1]
        self.start = int(index[-1])
        self.ids, self.held = ids, held
        owner_held = np.repeat(held, np.diff(self.first))
        self.train = np.bincount(self.index[~owner_held], minlength=len(words)).astype(np.int64)
        self.start_train = int((~held).sum())
        # Two blocks of one name are alike in all that is asked and answered, and in their rows.
        self.name = sequence_hash(words, words[self.index], self.first.astype(np.uint64), held.astype(np.uint64), id_hashes(ids))


def _read_blocks(batches):
    """Blocks of (doc_id, text, held_out) batches."""
    flags = []

    def two():
        for rb in batches:
            flags.append(rb.column(2).to_numpy(zero_copy_only=False))
            yield rb.select([0, 1])

    for ids, texts in _blocks(two(), BLOCK):
        held = np.concatenate(flags)
        yield _Block(ids, held[: len(ids)].astype(bool), texts)
        flags[:] = [held[len(ids) :]]


def _word_range(h: np.ndarray, ranges: int) -> np.ndarray:
    """Ranges of the sorted hashes: equal parts of the hash space."""
    return ((h >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)


def _ask_words(ranges: int):
    def run(batches):
        for b in _read_blocks(batches):
            cut = np.searchsorted(_word_range(b.words, ranges), np.arange(ranges + 1))
            full = np.flatnonzero(np.diff(cut))
            train = b.train.copy()
            train[b.start] += b.start_train
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(full), b.name)), pa.array(full.astype(np.int32)), pa.array([b.words[cut[r] : cut[r + 1]].tobytes() for r in full], pa.binary()), pa.array([_planes(train[cut[r] : cut[r + 1]]) for r in full], pa.binary())],
                names=["block", "range", "words", "counts"],
            )

    return run


def _merge(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    k, n = np.concatenate(keys), np.concatenate(counts).astype(np.int64)
    order = np.argsort(k, kind="stable")
    k, n = k[order], n[order]
    at = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    return k[at], np.add.reduceat(n, at)


def _words_of_range(key, table):
    """A range's unigram table (sorted hashes that training has seen, counts), and the answers to the blocks: for each
    word its number, 0 if training lacks it, and its count."""
    r = key[0].as_py()
    asked = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("words")]
    words, counts = _merge(asked, [_numbers(x.as_py()) for x in table.column("counts")])
    seen = counts > 0
    words, counts = words[seen], counts[seen]
    real = words != _START
    low = np.bincount(np.minimum(counts[real], GT_LIMIT + 2), minlength=GT_LIMIT + 3)[: GT_LIMIT + 2]
    rows = [(None, r, words.tobytes(), _pack(counts), int(real.sum()), int(counts[real].sum()), low.tolist())]
    for block, w in zip(table.column("block").to_pylist(), asked, strict=True):
        at = np.minimum(np.searchsorted(words, w), max(len(words) - 1, 0))
        ok = words[at] == w if len(words) else np.zeros(len(w), bool)
        number = np.where(ok, (r << 40) + at + 1, 0)
        rows.append((block, r, _pack(number), _pack(counts[at] * ok if len(words) else number), 0, 0, None))
    return _table(rows, _WORD_ROWS)


def _table(rows: list[tuple], fields: list[tuple[str, pa.DataType]]) -> pa.Table:
    return pa.Table.from_arrays([pa.array([x[i] for x in rows], kind) for i, (_, kind) in enumerate(fields)], names=[name for name, _ in fields])


_WORD_ROWS = [("block", pa.int64()), ("range", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary()), ("kinds", pa.int64()), ("tokens", pa.int64()), ("low", pa.list_(pa.int64()))]
_WORD_SCHEMA = "block long, range int, keys binary, counts binary, kinds long, tokens long, low array<long>"


def good_turing(low: list[int], limit: int = GT_LIMIT) -> np.ndarray:
    """Discount ratios by count (0 to limit) in Katz's form; 1 where the counts of counts give none between 0 and 1."""
    n = np.array(low, float)
    out = np.ones(limit + 1)
    if n[1] <= 0:
        return out
    common = (limit + 1) * n[limit + 1] / n[1]
    for r in range(1, limit + 1):
        if n[r] > 0 and common < 1:
            d = ((r + 1) * n[r + 1] / (r * n[r]) - common) / (1 - common)
            out[r] = d if 0 < d < 1 else 1.0
    return out


class Unigrams:
    """Sizes and discounts of the unigram level."""

    def __init__(self, kinds: int, tokens: int, low: list[int]):
        self.kinds, self.tokens, self.discount = kinds, tokens, good_turing(low)
        free = sum(r * n * (1 - self.discount[r]) for r, n in enumerate(low[: GT_LIMIT + 1]))
        # Without discounts one more token is counted, which is an unseen word.
        self.total = max(tokens, 0) + (0 if free > 0 else 1)
        self.unseen = (free if free > 0 else 1) / self.total

    def probability(self, counts: np.ndarray) -> np.ndarray:
        return np.where(counts > 0, discounted(counts, self.discount) / self.total, self.unseen)


def discounted(counts: np.ndarray, discount: np.ndarray) -> np.ndarray:
    return counts * np.where(counts > GT_LIMIT, 1.0, discount[np.minimum(counts, GT_LIMIT)])


def _pack(x: np.ndarray) -> bytes:
    """Numbers from 0 to below 2**63, compressed."""
    return _zip(_split_bytes(x.astype("<i8")))


def _unpack(b: bytes) -> np.ndarray:
    return _join_bytes(_unzip(b), "<i8")


def _state(batches):
    """A block's row for the joins: tokens as places in the list of its distinct words by falling frequency."""
    for b in _read_blocks(batches):
        order = np.argsort(-np.bincount(b.index, minlength=len(b.words)), kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([b.name]), pa.ListArray.from_arrays(pa.array([0, len(b.ids)], pa.int32()), b.ids), pa.array([np.packbits(b.held).tobytes()], pa.binary()),
                pa.array([_planes(np.diff(b.first))], pa.binary()), pa.array([_planes(place[b.index])], pa.binary()), pa.array([_planes(order)], pa.binary()), pa.array([b.start], pa.int64()),
            ],
            names=["block", "doc_ids", "held", "n", "index", "order", "start"],
        )


class _Known:
    """A block and what the unigram ranges answered; words are places in the block's list of words by hash."""

    def __init__(self, row: dict, answers: dict[int, tuple[bytes, bytes]]):
        self.ids = row["doc_ids"]
        self.held = np.unpackbits(np.frombuffer(row["held"], np.uint8))[: len(self.ids)].astype(bool)
        self.first = np.concatenate([[0], np.cumsum(_numbers(row["n"]).astype(np.int64))])
        order = _numbers(row["order"]).astype(np.int64)
        self.index = order[_numbers(row["index"]).astype(np.int64)]
        self.start = row["start"]
        parts = [answers[r] for r in sorted(answers)]
        self.number = np.concatenate([_unpack(a) for a, _ in parts]) if parts else np.zeros(0, np.int64)
        self.count = np.concatenate([_unpack(c) for _, c in parts]) if parts else np.zeros(0, np.int64)
        if len(self.number) != len(order):
            raise ValueError("the documents changed between two reads")
        self.previous = np.empty_like(self.index)
        if len(self.index):
            self.previous[1:] = self.index[:-1]
            self.previous[self.first[:-1]] = self.start

        self.train = ~np.repeat(self.held, np.diff(self.first))

    def words(self) -> _Grams:
        every = np.arange(len(self.number))
        return _Grams([], every, None, None, self.index, None)

    def longer(self, shorter: _Grams, n: np.ndarray, ranges: int, hot: int) -> _Grams:
        """The distinct n-grams, one word longer, whose context training has seen. n: training counts of the shorter ones."""
        before = np.full(len(self.index), -1, np.int64)
        if len(self.index):
            before[1:] = shorter.at[:-1]
            before[self.first[:-1]] = -1 if shorter.context else self.start
        known = before >= 0
        known[known] = n[before[known]] > 0
        width = max(len(self.number), 1)
        unique, token, inverse = np.unique(before[known] * width + self.index[known], return_index=True, return_inverse=True)
        of, word = unique // width, unique % width
        counts = np.bincount(inverse[self.train[known]], minlength=len(unique))
        context = [*(c[of] for c in shorter.context), shorter.word[of]]
        h = mix(self.number[context[0]].astype(np.uint64))
        for c in [*context[1:], word]:
            own, h = h, mix(h + self.number[c].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        part = (np.where(n[of] > hot, h, own) % np.uint64(ranges)).astype(np.int64)
        order = np.lexsort((self.number[word], *(self.number[c] for c in reversed(context)), part))
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        at = np.full(len(self.index), -1, np.int64)
        at[known] = back[inverse]
        return _Grams([c[order] for c in context], word[order], counts[order], np.searchsorted(part[order], np.arange(ranges + 1)), at, (np.flatnonzero(known)[token][order], of[order]))


class _Grams:
    """A block's distinct n-grams of one length by (range, numbers of the words): the words as places, training counts
    in the block, borders of the ranges, each token's n-gram (-1 if it has none), and of each n-gram a token that has it
    and the shorter n-gram that is its context."""

    def __init__(self, context, word, counts, cut, at, where):
        self.context, self.word, self.counts, self.cut, self.at, self.where = context, word, counts, cut, at, where


class _Model:
    """What all tasks know of the model: sizes, discounts by length, and sums of the very frequent contexts by length."""

    def __init__(self, unigrams: Unigrams, ranges: int, hot: int):
        self.unigrams, self.ranges, self.hot = unigrams, ranges, hot
        self.discounts: dict[int, np.ndarray] = {1: unigrams.discount}
        self.often: dict[int, dict[tuple, list[float]]] = {}

    def resolved(self, k: _Known, answers: pa.Table, upto: int):
        """For each length to `upto`: a block's n-grams, their training counts, and the weights and denominators of their contexts."""
        out = [(k.words(), k.count, None, None)]
        for length in range(2, upto + 1):
            g = k.longer(out[-1][0], out[-1][1], self.ranges, self.hot)
            context_count = out[-1][1][g.where[1]]
            found = _answers_of(answers, length)
            n, weight, total = np.zeros(len(g.word), np.int64), np.ones(len(g.word)), np.ones(len(g.word))
            for r in np.flatnonzero(np.diff(g.cut)):
                s = slice(g.cut[r], g.cut[r + 1])
                n[s] = _unpack(found[int(r)][0])
                stats = _unpack_stats(found[int(r)][1])
                runs = _runs(*(c[s] for c in g.context))
                for i in np.flatnonzero(context_count[s][runs] > self.hot):
                    stats[i] = self.often[length][tuple(int(k.number[c[s][runs[i]]]) for c in g.context)]
                w, d = weights(stats, self.discounts[length])
                times = np.diff(np.append(runs, g.cut[r + 1] - g.cut[r]))
                weight[s], total[s] = np.repeat(w, times), np.repeat(d, times)
            out.append((g, n, weight, total))
        return out


def _runs(*columns: np.ndarray) -> np.ndarray:
    """Where the runs of equal rows begin."""
    if not len(columns[0]):
        return np.zeros(0, np.int64)
    new = np.zeros(len(columns[0]), bool)
    new[0] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def _answers_of(table: pa.Table, length: int) -> dict[int, tuple[bytes, bytes]]:
    own = table.filter(pa.array([x == length for x in table.column("length").to_pylist()], pa.bool_()))
    return {r: (k, c) for r, k, c in zip(*(own.column(x).to_pylist() for x in ("range", "keys", "counts")), strict=True)}


_ASKED = [("block", pa.int64()), ("range", pa.int32()), ("u", pa.list_(pa.binary())), *((c, pa.binary()) for c in ("length", "hot", "scale", "v", "count_v", "counts"))]
_ASKED_SCHEMA = "block long, range int, u array<binary>, length binary, hot binary, scale binary, v binary, count_v binary, counts binary"


def _packed_contexts(columns: list[np.ndarray]) -> list[bytes]:
    """Sorted rows of numbers; the first column, which rises, as differences."""
    return [_pack(np.diff(columns[0], prepend=0)), *(_pack(c) for c in columns[1:])]


def _ask(length: int, model: _Model):
    """Each block's n-grams by range, with what gives their probability one word shorter: the shorter n-gram's count,
    and for each context the denominator there (left out for pairs, whose shorter n-grams are words)."""

    def run(key, states, answers):
        out, words = [], _answers_of(answers, 1)
        for row in states.to_pylist():
            k = _Known(row, words)
            shorter, below, _, scale = model.resolved(k, answers, length - 1)[-1]
            g = k.longer(shorter, below, model.ranges, model.hot)
            token, of = g.where
            for r in np.flatnonzero(np.diff(g.cut)):
                s = slice(g.cut[r], g.cut[r + 1])
                runs = _runs(*(c[s] for c in g.context))
                short = shorter.at[token[s]]
                scales = None if scale is None else _pack(scale[short[runs]].view(np.int64))
                out.append((row["block"], int(r), _packed_contexts([k.number[c[s][runs]] for c in g.context]), _planes(np.diff(np.append(runs, g.cut[r + 1] - g.cut[r]))), _planes(below[of[s][runs]] > model.hot), scales, _pack(k.number[g.word[s]]), _pack(below[short]), _planes(g.counts[s])))
        release()
        return _table(out, _ASKED)

    return run


_ROWS = [("block", pa.int64()), ("range", pa.int32()), ("u", pa.list_(pa.binary())), ("length", pa.binary()), ("v", pa.binary()), ("counts", pa.binary()), ("stats", pa.binary()), ("low", pa.list_(pa.int64()))]
_SCHEMA = "block long, range int, u array<binary>, length binary, v binary, counts binary, stats binary, low array<long>"


def _grams_of_range(unigram_total: float, discount: np.ndarray):
    """A range's n-gram table and the answers to the blocks; discount is that of the shorter n-grams.

    Stats of a context are a row of numbers: total, mass one word shorter of the words seen after it, and how many of
    them were seen 1, 2, ..., GT_LIMIT times. The table's row holds those of the very frequent contexts, as parts.
    """

    def run(key, table):
        r = key[0].as_py()
        blocks, begins, parts = [], [], []
        for x in table.to_pylist():
            length = _numbers(x["length"]).astype(np.int64)
            u = [_unpack(c) for c in x["u"]]
            u[0] = np.cumsum(u[0])
            scale = np.full(len(length), float(unigram_total)) if x["scale"] is None else _unpack(x["scale"]).view(np.float64)
            blocks.append(x["block"])
            begins.append(np.cumsum(length) - length)
            parts.append([*(np.repeat(c, length) for c in u), _unpack(x["v"]), np.repeat(_numbers(x["hot"]), length), discounted(_unpack(x["count_v"]), discount) / np.repeat(scale, length), _numbers(x["counts"]).astype(np.int64)])
        sizes = [len(x[0]) for x in parts]
        *u, v, hot, lower, n = (np.concatenate(c) for c in zip(*parts, strict=True))
        del parts
        order = np.lexsort((v, *reversed(u)))
        u, v, hot, lower, n = [c[order] for c in u], v[order], hot[order], lower[order], n[order]
        at = _runs(*u, v)
        place = np.empty(len(order), np.int64)
        place[order] = np.repeat(np.arange(len(at)), np.diff(np.append(at, len(v))))
        total = np.add.reduceat(n, at)
        u, v, hot, lower = [c[at] for c in u], v[at], hot[at], lower[at]
        begin = _runs(*u)
        context = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(v))))
        seen = total > 0
        stats = np.stack([np.add.reduceat(x, begin) for x in (total.astype(float), np.where(seen, lower, 0.0), *((total == c).astype(float) for c in range(1, GT_LIMIT + 1)))], axis=1)
        often = hot[begin] > 0
        su, sv, sn = [c[seen] for c in u], v[seen], total[seen]
        runs = _runs(*su)
        low = np.bincount(np.minimum(sn, GT_LIMIT + 2), minlength=GT_LIMIT + 3)[: GT_LIMIT + 2]
        sums = np.concatenate([*(c[begin][often, None].astype("<i8").view("<f8") for c in u), stats[often]], axis=1)
        rows = [(None, r, _packed_contexts([c[runs] for c in su]), _planes(np.diff(np.append(runs, len(sv)))), _pack(sv), _pack(sn), sums.astype("<f8").tobytes(), low.tolist())]
        done = 0
        for block, first, size in zip(blocks, begins, sizes, strict=True):
            own = place[done : done + size]
            rows.append((block, r, None, None, None, _pack(total[own]), _pack_stats(stats[context[own[first]]]), None))
            done += size
        release()
        return _table(rows, _ROWS)

    return run


def _pack_stats(x: np.ndarray) -> bytes:
    counts = np.delete(x, 1, axis=1).T.astype("<i8")
    return _zip(x[:, 1].astype("<f8").tobytes() + b"".join(_split_bytes(c) for c in counts))


def _unpack_stats(b: bytes) -> np.ndarray:
    b = _unzip(b)
    n = len(b) // (8 * (GT_LIMIT + 2))
    total, *low = (_join_bytes(b[8 * n * (i + 1) : 8 * n * (i + 2)], "<i8") for i in range(GT_LIMIT + 1))
    return np.stack([total.astype(float), np.frombuffer(b[: 8 * n], "<f8"), *(c.astype(float) for c in low)], axis=1)


def weights(stats: np.ndarray, discount: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(backoff weight, denominator of the discounted counts) for rows of stats.

    A first word that nothing follows in training has weight 1. Where no count is discounted, one more occurrence is
    counted, so that something is left for the words not seen after it; where the unigram level leaves those no mass
    to share, they get none and the seen ones all.
    """
    total, below = stats[:, 0], stats[:, 1]
    free = (stats[:, 2:] * np.arange(1, GT_LIMIT + 1) * (1 - discount[1:])).sum(axis=1)
    denominator = np.where(free > 0, total, total + 1)
    left = np.where(free > 0, free, 1.0) / denominator
    room = 1 - below
    weight = np.where(total > 0, left / np.maximum(room, 1e-300), 1.0)
    none = (total > 0) & (room <= 1e-12)
    return np.where(none, 0.0, weight), np.where(none, total - free, denominator)


def _score(order: int, model: _Model):
    fields = [("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())]

    def run(key, states, answers):
        words, unigrams = _answers_of(answers, 1), model.unigrams
        out, own = [], [("doc_id", states.schema.field("doc_ids").type.value_type), *fields]
        for row in states.to_pylist():
            k = _Known(row, words)
            count = k.count[k.index]
            p = unigrams.probability(count)
            for length, (g, n, weight, total) in enumerate(model.resolved(k, answers, order)[1:], 2):
                gram = np.maximum(g.at, 0)
                if len(g.word):
                    p = np.where(g.at >= 0, np.where(n[gram] > 0, discounted(n, model.discounts[length])[gram] / total[gram], weight[gram] * p), p)
            base = np.log10((count + 1) / (unigrams.tokens + unigrams.kinds + 1))
            begin = k.first[:-1]
            with np.errstate(divide="ignore"):
                score = np.log10(p)
            out.append(pa.Table.from_arrays([pa.array(x, f) for x, (_, f) in zip((k.ids, k.held, np.diff(k.first), np.add.reduceat((count > 0).astype(np.int64), begin), np.add.reduceat(base, begin), np.add.reduceat(score, begin)), own, strict=True)], names=[f for f, _ in own]))
        release()
        return pa.concat_tables(out) if out else _table([], own)

    return run


def _written(df: DataFrame, name: str) -> DataFrame:
    """Written as a table partitioned by range, and read again."""
    path = scratch(df.sparkSession, name)
    df.write.partitionBy("range").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def katz_scores(docs: DataFrame, held_out: Column, ranges: int | None = None, order: int = ORDER) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score, a row for each row of docs.

    The model has n-grams of 1 to `order` words (2 at least) and learns from the rows where held_out is false. Null and empty texts consist of their end; ids may be of
    any simple type, null or repeated, and repeated rows are learned as often as they occur. score is the sum of log10 probabilities under
    the model, base_score that under add-one unigrams. Without training rows every word is unseen. Other columns are
    ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.select("doc_id", "text", held_out.alias("held_out"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    asked = docs.mapInArrow(_ask_words(ranges), "block long, range int, words binary, counts binary")
    words = _written(asked.groupBy("range").applyInArrow(_words_of_range, _WORD_SCHEMA), "unigrams")
    sizes = words.where("block is null").select("kinds", "tokens", *[F.get("low", F.lit(i)).alias(f"n{i}") for i in range(GT_LIMIT + 2)]).agg(*[F.sum(c).alias(c) for c in ("kinds", "tokens", *(f"n{i}" for i in range(GT_LIMIT + 2)))]).first()
    low = [int(sizes[f"n{i}"] or 0) for i in range(GT_LIMIT + 2)]
    unigrams = Unigrams(int(sizes["kinds"] or 0), int(sizes["tokens"] or 0), low)
    model = _Model(unigrams, ranges * GRAM_RANGES, int(HOT_SHARE * unigrams.tokens / ranges) + 1)

    states = docs.mapInArrow(_state, f"block long, doc_ids array<{kind}>, held binary, n binary, index binary, order binary, start long").groupBy("block")
    answers = words.where("block is not null").select("block", F.lit(1).alias("length"), "range", "keys", "counts")
    for length in range(2, order + 1):
        packets = states.cogroup(answers.groupBy("block")).applyInArrow(_ask(length, model), _ASKED_SCHEMA)
        grams = _written(packets.groupBy("range").applyInArrow(_grams_of_range(unigrams.total, model.discounts[length - 1]), _SCHEMA), f"grams-{length}")
        sums = grams.where("block is null").agg(*[F.sum(F.get("low", F.lit(i))).alias(f"n{i}") for i in range(GT_LIMIT + 2)]).first()
        often: dict[tuple, list[float]] = {}  # at most ranges / HOT_SHARE contexts are that frequent
        for row in grams.where("block is null and length(stats) > 0").select("stats").collect():
            parts = np.frombuffer(row["stats"], "<f8").reshape(-1, length - 1 + GT_LIMIT + 2)
            for u, stats in zip(parts[:, : length - 1].copy().view("<i8").tolist(), parts[:, length - 1 :].tolist(), strict=True):
                often[tuple(u)] = [x + y for x, y in zip(often.get(tuple(u), [0.0] * (GT_LIMIT + 2)), stats, strict=True)]
        model.discounts[length], model.often[length] = good_turing([int(sums[f"n{i}"] or 0) for i in range(GT_LIMIT + 2)]), often
        answers = answers.union(grams.where("block is not null").select("block", F.lit(length), "range", F.col("counts").alias("keys"), F.col("stats").alias("counts")))

    schema = f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double"
    scored = states.cogroup(answers.groupBy("block")).applyInArrow(_score(order, model), schema)
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(unigrams.tokens).cast("long").alias("train_tokens"), "base_score", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return katz_scores(docs, crc_mod("doc_id", FOLDS) == HELD_OUT)
