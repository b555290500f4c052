"""BPE encoding and decoding through a table of distinct words.

Texts are taken in blocks. A block's distinct words go, packed, to the ranges of a table that is dealt by the words'
hashes; there each word is encoded once, whatever the number of blocks that hold it, and its ids go back to every
block that asked. In a block, ids are joined to positions by word number. Decoding joins ids to pieces, whose table is
as small as the vocabulary. What crosses the network is a block's distinct words, their ids, and its texts as word
numbers; no text and no row for a single word does.

A block is named by its words, so that a task which runs again asks and answers alike. docs must give the same rows
when it is read twice, as files do; store the result of a computation first.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from ._common import _RANDOM, bounded, id_hashes, pieces, release, sequence_hash, span_hashes, word_spans
from .tokens import distinct_words, encode, tokenizer

#: Bytes of text in a block, and tokens that are turned to strings at once.
BLOCK = 6 << 20
SLICE = 1 << 18
_CODEC = pa.Codec("zstd", 1)
#: Distinct words of a range of the hash space, about; their ids are all held while it answers.
RANGE_WORDS = 250_000
#: They are counted on one of so many parts of the hash space.
SAMPLED = 64


def _zip(b: bytes) -> bytes:
    """Compressed bytes behind their length."""
    return len(b).to_bytes(8, "little") + (_CODEC.compress(b, asbytes=True) if b else b"")


def _unzip(b: bytes) -> bytes:
    n = int.from_bytes(b[:8], "little")
    return _CODEC.decompress(b[8:], n, asbytes=True) if n else b""


def _split_bytes(x: np.ndarray) -> bytes:
    """The bytes of whole numbers, all lowest bytes first: the higher ones of small numbers are runs of zeros."""
    return np.ascontiguousarray(np.ascontiguousarray(x).view(np.uint8).reshape(-1, x.itemsize).T).tobytes()


def _join_bytes(b: bytes, kind: str) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def _planes(x: np.ndarray) -> bytes:
    """Numbers from 0 to below 2**32, compressed."""
    return _zip(_split_bytes(x.astype("<u4")))


def _numbers(b: bytes) -> np.ndarray:
    return _join_bytes(_unzip(b), "<u4")


def _blocks(batches, limit: int | None = None):
    """(ids, texts) of about `limit` (BLOCK) bytes of text; a longer text makes a longer block.

    Memory that is no longer used goes back before the next block.
    """
    limit = limit or BLOCK
    ids, texts, size = [], [], 0
    for rb in bounded(batches):
        text = pc.fill_null(rb.column(1).cast(pa.large_string()), "")
        length = pc.binary_length(text).to_numpy(zero_copy_only=False)
        lo = 0
        for hi in range(1, rb.num_rows + 1):
            size += int(length[hi - 1])
            if size >= limit or hi == rb.num_rows:
                ids.append(rb.column(0).slice(lo, hi - lo))
                texts.append(text.slice(lo, hi - lo))
                lo = hi
                if size >= limit:
                    yield pa.concat_arrays(ids), pa.concat_arrays(texts)
                    ids, texts, size = [], [], 0
                    release()
    if ids:
        yield pa.concat_arrays(ids), pa.concat_arrays(texts)


def _numbered(doc_ids: pa.Array, texts: pa.Array, ranges: int):
    """(block, word numbers, each text's first word, words by number, range of each word): frequent words come first.

    The block's name also depends on the ids, so that blocks of copies of one text do not meet under one name.
    """
    index, first, words = distinct_words(texts)
    _, offsets, data = words.buffers()
    if not len(words):
        return 0, np.zeros(0, np.int64), first, words, np.zeros(0, np.int64)
    offsets = np.frombuffer(offsets, np.int64)[words.offset : words.offset + len(words) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    h = span_hashes(_RANDOM[data], offsets[:-1], offsets[1:])
    order = np.lexsort((h, -np.bincount(index, minlength=len(words))))
    number = np.empty(len(order), np.int64)
    number[order] = np.arange(len(order))
    h = h[order]
    name = sequence_hash(h, id_hashes(doc_ids))
    return name, number[index], first, words.take(pa.array(order)), (h % np.uint64(ranges)).astype(np.int64)


def _joined(values: pa.Array, ids: np.ndarray, first: np.ndarray, by: str = " ") -> pa.Array:
    """The values with the given numbers, those between two entries of `first` joined to one string."""
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(first, pa.int32()), values.take(pa.array(ids))), pa.scalar(by, pa.large_string()))


def _ask(ranges: int):
    def run(batches):
        for ids, texts in _blocks(batches):
            name, _, _, words, part = _numbered(ids, texts, ranges)
            if not len(words):
                continue
            order = np.argsort(part, kind="stable")
            at = np.searchsorted(part[order], np.arange(ranges + 1))
            blobs = _joined(words, order, at, "\n")
            full = np.flatnonzero(np.diff(at))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(full), name)), pa.array(full.astype(np.int32)), pa.array(np.diff(at)[full]), pa.array([_zip(blobs[int(r)].as_buffer().to_pybytes()) for r in full], pa.binary())], names=["block", "part", "n", "words"]
            )

    return run


def _answer(path: str):
    def run(batches):
        memo: dict[str, bytes] = {}  # a word's ids, four bytes each
        for rb in batches:
            lengths, ids = [], []
            for blob in rb.column(3):
                words = _unzip(blob.as_py()).decode().split("\n")
                new = [w for w in words if w not in memo]
                fresh = dict(zip(new, (np.array(x, "<u4").tobytes() for x in encode(new, path)), strict=True))
                memo |= fresh
                found = [memo[w] for w in words]
                lengths.append(_planes(np.array([len(x) // 4 for x in found], np.uint32)))
                ids.append(_planes(np.frombuffer(b"".join(found), "<u4")))
            yield pa.RecordBatch.from_arrays([rb.column(0), rb.column(1), pa.array(lengths, pa.binary()), pa.array(ids, pa.binary())], names=["block", "part", "lengths", "ids"])

    return run


def _texts_as_numbers(ranges: int):
    def run(batches):
        for ids, texts in _blocks(batches):
            name, index, first, _, part = _numbered(ids, texts, ranges)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name]), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), pa.array([_planes(np.diff(first))], pa.binary()), pa.array([_planes(index)], pa.binary()), pa.array([_planes(part)], pa.binary())],
                names=["block", "doc_ids", "n_words", "index", "parts"],
            )

    return run


def _expand(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions start, start + 1, ... of every span, one after the other."""
    total = np.cumsum(lengths)
    return np.repeat(starts - total + lengths, lengths) + np.arange(total[-1] if len(total) else 0)


def _positions(path: str, full: bool):
    def run(blocks: pa.Table, answers: pa.Table) -> pa.Table:
        known = tokenizer(path)
        size = known.get_vocab_size(with_added_tokens=True)
        decimal = pa.array([str(i) for i in range(size)], pa.large_string())
        pieces = pa.array([known.id_to_token(i) or "" for i in range(size)], pa.large_string())
        by_part = {}
        for p, lengths, ids in zip(*(answers.column(c).to_pylist() for c in ("part", "lengths", "ids")), strict=True):
            by_part[p] = (lengths, ids)
        out = []
        for row in range(blocks.num_rows):
            doc_ids = blocks.column("doc_ids").combine_chunks().slice(row, 1).flatten()
            n_words, index, part = (_numbers(blocks.column(c)[row].as_py()).astype(np.int64) for c in ("n_words", "index", "parts"))
            order = np.argsort(part, kind="stable")
            used = np.unique(part)
            if any(int(p) not in by_part for p in used):
                raise ValueError("the documents changed between two reads")
            lengths = np.zeros(len(part), np.int64)
            lengths[order] = np.concatenate([_numbers(by_part[p][0]) for p in used]) if len(used) else []
            flat = np.concatenate([_numbers(by_part[p][1]) for p in used]).astype(np.int64) if len(used) else np.zeros(0, np.int64)
            starts = np.zeros(len(part), np.int64)
            starts[order] = np.cumsum(lengths[order]) - lengths[order]
            word_at = np.concatenate([[0], np.cumsum(n_words)])
            token_at = np.concatenate([[0], np.cumsum(lengths[index])])[word_at]
            lo = 0
            while lo < len(n_words):
                hi = max(lo + 1, int(np.searchsorted(token_at, token_at[lo] + SLICE, "right")) - 1)
                w = index[word_at[lo] : word_at[hi]]
                ids = flat[_expand(starts[w], lengths[w])]
                first = token_at[lo : hi + 1] - token_at[lo]
                text = _joined(pieces, ids, first)
                columns = [doc_ids.slice(lo, hi - lo), pa.array(np.diff(first))]
                for strings in (_joined(decimal, ids, first), text):
                    columns.append(pa.array([hashlib.sha256(x.as_buffer() if x.is_valid else b"").hexdigest() for x in strings], pa.string()))
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if full:
                    columns += [pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(ids, pa.int32())), text.cast(pa.string())]
                    names += ["ids", "decoded"]
                out.append(pa.Table.from_arrays(columns, names=names))
                lo = hi
        release()
        if out:
            return pa.concat_tables(out)
        empty = [pa.array([], blocks.schema.field("doc_ids").type.value_type), pa.array([], pa.int64()), pa.array([], pa.string()), pa.array([], pa.string())]
        names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
        return pa.Table.from_arrays(empty + ([pa.array([], pa.list_(pa.int32())), pa.array([], pa.string())] if full else []), names=names + (["ids", "decoded"] if full else []))

    return run


def _sampled_words(batches):
    """The hashes of the distinct words of each slice that fall into one of SAMPLED equal parts of all hashes."""
    for rb in bounded(batches):
        for _, _, data, offsets in pieces(rb.column(0)):
            starts, ends, _ = word_spans(data, offsets)
            h = span_hashes(_RANDOM[data], starts, ends)
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(h[h % np.uint64(SAMPLED) == 0]).view(np.int64))], names=["h"])


def word_ranges(docs: DataFrame, least: int) -> int:
    """Ranges of the hash space for the words of docs: so many that each has RANGE_WORDS distinct words, about, and least
    at least. So a range can hold all its words and encodes each of them once, whatever the size of the input."""
    part = docs.select("text").mapInArrow(_sampled_words, "h long").distinct().count()
    n = SAMPLED * part
    return max(least, -(-n // RANGE_WORDS))


def round_trip(docs: DataFrame, path: str, full: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 (and with full also ids and decoded), a row for each row of docs.

    ids are those that the tokenizers library gives for the whole text without added special tokens; the decoded text
    is its decoding without a decoder, that is, the pieces joined by spaces. A null text counts as empty: no ids, an
    empty decoded text. Ids may be of any simple type, null or repeated, other columns are ignored, an empty table gives no rows.
    """
    if tokenizer(path).decoder is not None:
        raise ValueError("decoding joins pieces by spaces; this tokenizer has a decoder of its own")
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    ranges = word_ranges(docs, int(spark.conf.get("spark.sql.shuffle.partitions")))
    kind = docs.schema["doc_id"].dataType.simpleString()
    asked = docs.mapInArrow(_ask(ranges), "block long, part int, n long, words binary")
    answers = asked.repartition(ranges, "part").mapInArrow(_answer(path), "block long, part int, lengths binary, ids binary")
    blocks = docs.mapInArrow(_texts_as_numbers(ranges), f"block long, doc_ids array<{kind}>, n_words binary, index binary, parts binary")
    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if full else "")
    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_positions(path, full), schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the digests of ids and decoded text of every document."""
    import public_tokenizers

    return round_trip(docs, public_tokenizers.path("word_bpe_49k.json"))
