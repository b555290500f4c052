"""Helpers that the corpus operators share: scratch tables, and vectorised work on Arrow text columns.

The kernels read a text column's UTF-8 bytes as one numpy array. Word separators are ASCII, so splitting bytes
and splitting characters agree. Work is cut into pieces of about PIECE bytes at document borders, which bounds the
memory of a task whatever the size of an Arrow batch; one longer text makes one longer piece.
"""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import scratch_path as scratch

PIECE = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_RANDOM = np.random.default_rng(20240607).integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C13)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows written to a scratch table and read again: the lineage ends there, and a lost executor costs nothing."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread_join(rows: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """rows left-joined with a table of one row for each key, where a few keys may hold most of the rows.

    Keys with more than an eighth of an even partition's share of the rows are joined by broadcast: there are at most
    eight for each partition, whatever the size of the input. All others meet by a shuffle. Keys must not be null.
    """
    n = 8 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    total = counts.agg(F.sum("_n").alias("t")).first()["t"] or 0
    often = counts.where(F.col("_n") * n > total).select(*keys)
    held = table.join(F.broadcast(often), keys, "left_semi").withColumn("_often", F.lit(True))
    marked = rows.join(F.broadcast(held), keys, "left")
    columns = [*rows.columns, *[c for c in table.columns if c not in keys]]
    rest = marked.where(F.col("_often").isNull()).select(*rows.columns).join(table, keys, "left")
    return marked.where("_often").select(*columns).unionByName(rest.select(*columns))


def crc_mod(column: str, modulus: int) -> Column:
    """crc32 of the id as decimal text, modulo a small number; null ids count as the text 'null'."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("null")).cast("binary")) % modulus


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values, so that every bit depends on every other."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, for positions up to n or more. A process keeps one table, the
    longest so far, of a bounded length; what is longer is made anew."""
    size = 1 << max(16, int(n).bit_length())
    kept = max(_powers, default=0)
    if kept >= size:
        return _powers[kept]
    if size > 4 * PIECE:
        return _power_table(size)
    _powers.clear()
    _powers[size] = _power_table(size)
    return _powers[size]


def _power_table(size: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(size, _BASE), np.full(size, _BASE_INVERSE)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of the (already random-looking) uint64 values; equal spans have equal hashes."""
    up, down = power_table(len(values))
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts])


def release() -> None:
    """Gives memory that this process no longer uses back to the machine; workers live on from task to task."""
    pa.default_memory_pool().release_unused()
    trim = getattr(_libc, "malloc_trim", None)
    if trim is not None:
        trim(0)


try:
    _libc = ctypes.CDLL(None)
except (OSError, TypeError):
    _libc = None


def bounded(batches, text: str = "text", limit: int = 4 * PIECE):
    """The batches cut to slices of about limit bytes in the named column; a longer text makes a longer slice."""
    for rb in batches:
        size = pc.fill_null(pc.binary_length(rb.column(rb.schema.get_field_index(text))), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(size.astype(np.int64))
        row = 0
        while row < rb.num_rows:
            to = max(row + 1, int(np.searchsorted(ends, (ends[row - 1] if row else 0) + limit, "right")))
            yield rb.slice(row, to - row)
            row = to
        release()


def pieces(column: pa.Array, limit: int = PIECE):
    """(first row, past the last row, bytes, offsets) for pieces of a text column of about limit bytes; null counts as empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        to = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        yield row, to, data[offsets[row] : offsets[to]], offsets[row : to + 1] - offsets[row]
        row = to


def id_hashes(ids: pa.Array) -> np.ndarray:
    """A 64-bit hash of each id, whatever its type; nulls have one of their own."""
    out = np.full(len(ids), 0x4E554C4C, np.uint64)
    for a, b, data, offsets in pieces(ids.cast(pa.large_string())):
        out[a:b] = span_hashes(_RANDOM[data], offsets[:-1], offsets[1:])
    out[ids.is_null().to_numpy(zero_copy_only=False)] = np.uint64(0x4E554C4C)
    return out


def sequence_hash(*sequences: np.ndarray) -> int:
    """A number from 0 to below 2**63 that depends on the uint64 sequences, their order and the order in them."""
    h = np.zeros(1, np.uint64)
    for x in sequences:
        odd = 2 * np.arange(len(x), dtype=np.uint64) + np.uint64(1)
        h = mix(h * _BASE + mix((mix(x) * odd).sum(keepdims=True) + np.uint64(len(x))))
    return int(h[0] >> np.uint64(1))


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes other than ASCII white space, and the number of the first of each text."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~_SPACE[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    full = offsets[:-1] < offsets[1:]
    at, till = offsets[:-1][full], offsets[1:][full] - 1
    first[at] = inside[at]
    last[till] = inside[till]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words with A-Z in lower case, and the number of the first of each text."""
    starts, ends, first = word_spans(data, offsets)
    return span_hashes(_RANDOM[_LOWER[data]], starts, ends), first


def owners(first: np.ndarray) -> np.ndarray:
    """For items counted by `first` (a text's first item, then the number of all): the text of each."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def code_points(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the texts, and the offsets counted in code points."""
    begins = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=begins[1:])
    return np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32), begins[offsets]


def batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
