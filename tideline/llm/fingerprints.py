"""Document fingerprints by locally consistent parsing.

A text starts as the names of its code points. On each level, runs of one name become one name; deterministic coin
tossing then turns each name into a label below 6 that depends on the name and four neighbours to its left only, and
the local minima of the labels cut the sequence into phrases of two to about a dozen names. A phrase's name is a hash
of its names, and the phrases are the next level's sequence. Wherever a substring stands, its interior is cut alike,
so equal substrings share interior phrase names whatever their offset.

The fingerprint keeps the SKETCH smallest hashes of the phrase names of the levels in LEVELS; likeness is the share of
the smallest hashes of two fingerprints' union that both have, an estimate of the Jaccard similarity of the sets.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import code_points, mix, pieces, span_hashes

LEVELS = (2, 3)
SKETCH = 48
#: Rows of the sample that sets a part's range of ids.
SAMPLED = 50
_DIGITS = 8


def _collapse_runs(names: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One name for each run of equal names inside a text, made of the name and the run's length."""
    new = np.ones(len(names), bool)
    new[1:] = names[1:] != names[:-1]
    new[first[:-1][first[1:] > first[:-1]]] = True
    at = np.flatnonzero(new)
    length = np.diff(np.append(at, len(names)))
    out = names[at]
    many = length > 1
    out[many] = mix(out[many] + length[many].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return out, np.searchsorted(at, first)


def _toss(labels: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """2k + bit, where k is the lowest bit in which a label differs from the one before it; a text's first is bit 0 alone."""
    out = np.empty_like(labels)
    differ = labels[1:] ^ labels[:-1]
    low = differ & (~differ + differ.dtype.type(1))
    k = np.bitwise_count(low - low.dtype.type(1)).astype(labels.dtype)
    out[1:] = 2 * k + ((labels[1:] >> k) & labels.dtype.type(1))
    out[begin] = labels[begin] & labels.dtype.type(1)
    return out


def _phrases(names: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The phrases' names, and each text's first phrase (then the number of all)."""
    names, first = _collapse_runs(names, first)
    begin = first[:-1][first[1:] > first[:-1]]
    labels = _toss(names, begin).astype(np.uint8)
    for _ in range(3):
        labels = _toss(labels, begin)
    cut = np.zeros(len(names), bool)
    if len(names) > 2:
        cut[1:-1] = (labels[1:-1] < labels[:-2]) & (labels[1:-1] <= labels[2:])
    # No cut next to a text's ends: whether one would stand there depends on what is not the text.
    cut[np.minimum(begin + 1, len(names) - 1)] = False
    cut[first[1:][first[1:] > first[:-1]] - 1] = False
    cut[begin] = True
    starts = np.flatnonzero(cut)
    ends = np.append(starts[1:], len(names))
    return span_hashes(names, starts, ends), np.searchsorted(starts, first)


def _sketches(column: pa.Array) -> tuple[list[np.ndarray], np.ndarray]:
    """The smallest distinct hashes of each text's phrases, ascending, and its number of code points.

    Every text is treated alike, whatever its length; repeated phrases count once.
    """
    out: list[np.ndarray] = []
    sizes = np.zeros(len(column), np.int64)
    for a, b, data, offsets in pieces(column):
        points, at = code_points(data, offsets)
        sizes[a:b] = np.diff(at)
        if not len(points):
            out += [np.zeros(0, np.uint64)] * (b - a)
            continue
        names, first = mix(points.astype(np.uint64) + np.uint64(0x51ED27)), at
        found, whose = [], []
        for level in range(1, max(LEVELS) + 1):
            names, first = _phrases(names, first)
            if level in LEVELS:
                found.append(mix(names ^ np.uint64(0xA5A5A5A5 + level)))
                whose.append(np.repeat(np.arange(b - a), np.diff(first)))
        h, d = np.concatenate(found), np.concatenate(whose)
        order = np.lexsort((h, d))
        h, d = h[order], d[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
        h, d = h[new], d[new]
        begin = np.searchsorted(d, np.arange(b - a + 1))
        out += [h[begin[i] : min(begin[i] + SKETCH, begin[i + 1])] for i in range(b - a)]
    return out, sizes


def _hex(sketch: np.ndarray) -> str:
    return (sketch >> np.uint64(32)).astype(">u4").tobytes().hex()


def likeness(a: str, b: str) -> float:
    """Estimated Jaccard similarity of two fingerprints' phrases; 1 for two empty ones, 0 if one of them is empty."""
    x, y = ({s[i : i + _DIGITS] for i in range(0, len(s), _DIGITS)} for s in (a, b))
    if not x or not y:
        return float(len(x) == len(y))
    union = sorted(x | y)[:SKETCH]
    both = x & y
    return sum(h in both for h in union) / len(union)


def fingerprint(column: pa.Array) -> tuple[list[str], np.ndarray]:
    """Fingerprints (hexadecimal digits) and numbers of code points of a column of texts; null counts as empty."""
    found, sizes = _sketches(column)
    return [_hex(x) for x in found], sizes


def fingerprints(docs: DataFrame) -> DataFrame:
    """The input's doc_id with n_chars and the fingerprint of its whole text, a row for each row, without a shuffle."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for rb in batches:
            prints, sizes = fingerprint(rb.column(1))
            yield pa.RecordBatch.from_arrays([rb.column(0), pa.array(sizes), pa.array(prints, pa.string())], names=["doc_id", "n_chars", "fingerprint"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_chars long, fingerprint string")


def _edited(rows) -> list[str]:
    """Each text with its last half replaced by as many first characters of the text that follows."""
    out = []
    for text, after in rows:
        m = len(text) // 2
        out.append(text[: len(text) - m] + after[:m] if m else text)
    return out


def _range_of(bounds: list, row: Column) -> Column:
    """The number of the sorted bounds that are not above the row; two short searches instead of one long one."""
    if not bounds:
        return F.lit(0)
    step = math.isqrt(len(bounds) - 1) + 1
    count = lambda found: F.size(F.filter(found, lambda b: b <= row))
    chunks = [F.array(*bounds[i : i + step]) for i in range(0, len(bounds), step)]
    coarse = count(F.array(*bounds[step::step])) if len(chunks) > 1 else F.lit(0)
    return F.transform(F.array(coarse), lambda i: i * step + count(F.get(F.array(*chunks), i)))[0]


def _by_neighbour(docs: DataFrame, parts: int) -> DataFrame:
    """Rows (part, is_edge, doc_id, text), sorted within a part, where the part's last row is the row after the others.

    Parts are ranges of (doc_id, hash of the text) between rows of a sample of about SAMPLED rows for each part, so many
    rows of one id or without an id are spread. The first row of each part that has rows is copied to the part before
    it as its edge, the very first to the last part.
    """
    id_type = docs.schema["doc_id"].dataType
    keyed = docs.withColumn("_hash", F.xxhash64("text"))
    key = F.struct("doc_id", "_hash")
    share = min(1.0, SAMPLED * parts / max(keyed.select("doc_id").count(), 1))
    drawn = keyed.select("doc_id", "_hash").where(F.pmod(F.xxhash64("doc_id", "_hash"), F.lit(1 << 40)) < int(share * (1 << 40)))
    drawn = [(r["doc_id"], r["_hash"]) for r in drawn.distinct().orderBy(F.col("doc_id").asc_nulls_first(), "_hash").collect()]
    cuts = sorted({len(drawn) * i // parts for i in range(1, parts)} - {0}) if drawn else []
    part = _range_of([F.struct(F.lit(drawn[i][0]).cast(id_type).alias("doc_id"), F.lit(drawn[i][1]).cast("long").alias("_hash")) for i in cuts], key)
    firsts = keyed.select("doc_id", "_hash", part.alias("part")).groupBy("part").agg(F.min(key).alias("f")).orderBy("part").collect()
    edges = [(r["f"]["doc_id"], r["f"]["_hash"], firsts[i - 1]["part"]) for i, r in enumerate(firsts)]
    schema = T.StructType([T.StructField("_id", id_type), T.StructField("_h", T.LongType()), T.StructField("to", T.IntegerType())])
    edge = docs.sparkSession.createDataFrame(edges, schema)
    # One row of the table of edges for each part: their number is a parameter.
    marked = keyed.join(F.broadcast(edge), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_hash") == F.col("_h")), "left")
    both = marked.withColumn("_part", F.explode(F.array_compact(F.array(F.struct(part.alias("p"), F.lit(False).alias("e")), F.when(F.col("to").isNotNull(), F.struct(F.col("to").alias("p"), F.lit(True).alias("e")))))))
    return both.select(F.col("_part.p").alias("part"), F.col("_part.e").alias("is_edge"), "doc_id", "_hash", "text")


def compare_with_next(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness; the next text is that of the next doc_id.

    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next, a row for each
    row of docs. Null texts count as empty. Ids may be of any simple type; null ids come first; among equal ids the hash of the text decides, and equal
    rows follow each other. The last row is followed by the first. A table of one row is followed by itself.
    The texts cross the network once, in ranges of ids, and stream through each task.
    """
    docs = docs.select("doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    parts = parts or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = _by_neighbour(docs, parts).repartitionById(parts, F.col("part")).sortWithinPartitions("part", "is_edge", F.col("doc_id").asc_nulls_first(), "_hash")
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def finish(kind_of_id, ids, texts, prints, sizes, nexts, next_prints):
        edited = _edited(zip(texts, nexts, strict=True))
        digests = [hashlib.sha256(x.encode()).hexdigest() for x in edited]
        new, _ = fingerprint(pa.array(edited, pa.large_string()))
        near_e = [likeness(a, b) for a, b in zip(prints, new, strict=True)]
        near_n = [likeness(a, b) for a, b in zip(prints, next_prints, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(ids, kind_of_id), pa.array(sizes), pa.array(digests, pa.string()), pa.array(prints, pa.string()), pa.array(new, pa.string()), pa.array(near_e), pa.array(near_n)], names=names)

    def run(batches):
        held = None  # the row whose next row has not come yet
        for rb in batches:
            for lo in range(0, rb.num_rows, 500):
                cut = rb.slice(lo, 500)
                prints, sizes = fingerprint(cut.column(3))
                part, is_edge, ids = cut.column(0).to_pylist(), cut.column(1).to_pylist(), cut.column(2).to_pylist()
                texts = pc.fill_null(cut.column(3).cast(pa.large_string()), "").to_pylist()
                rows = [*([held] if held else []), *zip(part, is_edge, ids, texts, prints, sizes.tolist(), strict=True)]
                held = rows.pop()
                if rows:
                    pairs = [(x, y) for x, y in zip(rows, [*rows[1:], held], strict=True) if not x[1]]
                    if pairs:
                        yield finish(cut.column(2).type, [x[2] for x, _ in pairs], [x[3] for x, _ in pairs], [x[4] for x, _ in pairs], [x[5] for x, _ in pairs], [y[3] for _, y in pairs], [y[4] for _, y in pairs])
        if held and not held[1]:
            raise ValueError("a part of the documents has no edge row")

    return rows.select("part", "is_edge", "doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_with_next(spark.read.parquet(f"{sf_dir}/documents.parquet"))
