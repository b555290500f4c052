"""Token counts with a cache of digests.

A text's content digest is SHA-256 of its text with runs of ASCII white space made one space: the tokenizer does the
same before it splits, so equal digests have equal counts. The cache is a Parquet table of (content digest, tokenizer
digest, count). Texts whose digest is not in it for this tokenizer's digest are encoded once for each distinct digest,
the counts are appended, and every row's count comes from a join with the cache.

No token of such a tokenizer spans white space, so a batch of texts is encoded by its distinct words.
"""

from __future__ import annotations

import hashlib
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import bounded, scratch, spread_join, stored

LIMIT = 2048
#: A worker remembers the counts of so many words at most.
REMEMBERED = 300_000
_CACHE = "content binary, tokenizer string, n_tokens long"
_loaded: dict[str, object] = {}


def tokenizer(path: str):
    """The tokenizer of a .json file, with truncation and padding off; loaded once in a process."""
    if path not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        found = Tokenizer.from_file(path)
        found.no_truncation()
        found.no_padding()
        _loaded[path] = found
    return _loaded[path]


def tokenizer_digest(path: str) -> str:
    """The version of a tokenizer: a digest of its file."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def content_digest(text: Column) -> Column:
    return F.unhex(F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " "), 256))


def distinct_words(column: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """For a column of texts: the number of each word among the distinct ones, each text's first word (then the number
    of all), and the distinct words. Words are cut at ASCII white space; white space at an end leaves an empty word."""
    lists = pc.ascii_split_whitespace(pc.fill_null(column.cast(pa.large_string()), ""))
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    words = lists.flatten().dictionary_encode()
    first = lists.offsets.to_numpy().astype(np.int64)
    return words.indices.to_numpy(), first - first[0], words.dictionary


def encode(words: list[str], path: str) -> list[list[int]]:
    """The ids of each string, without special tokens being added."""
    return [e.ids for e in tokenizer(path).encode_batch_fast(words, add_special_tokens=False)]


def count_texts(column: pa.Array, path: str, memo: dict[str, int]) -> np.ndarray:
    """The number of tokens of each text; the memo of words is added to, and emptied once it is full."""
    index, first, words = distinct_words(column)
    words = words.to_pylist()
    if len(memo) > REMEMBERED:
        memo.clear()
    counts = np.array([memo.get(w, -1) for w in words], np.int64)
    new = np.flatnonzero(counts < 0)
    for lo in range(0, len(new), 20_000):
        part = new[lo : lo + 20_000]
        counts[part] = [len(x) for x in encode([words[i] for i in part], path)]
    memo.update((words[i], int(counts[i])) for i in new[: REMEMBERED - len(memo)])
    sums = np.zeros(len(index) + 1, np.int64)
    np.cumsum(counts[index], out=sums[1:])
    return sums[first[1:]] - sums[first[:-1]]


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_cache(spark: SparkSession, cache: str, version: str) -> DataFrame:
    """content and n_tokens of one tokenizer, a row for each content."""
    if not _exists(spark, cache):
        return spark.createDataFrame([], "content binary, n_tokens long")
    found = spark.read.schema(_CACHE).parquet(cache).where(F.col("tokenizer") == version)
    return found.groupBy("content").agg(F.min("n_tokens").alias("n_tokens"))  # two writers may have added the same text


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and content of each row, written to a scratch table, so that a text is digested once."""
    text = F.coalesce("text", F.lit(""))
    return stored(docs.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), content_digest(F.col("text")).alias("content")), "digests")


#: Missing contents up to this number are broadcast to find their texts; beyond it all texts are grouped.
FEW = 200_000


def add_misses(docs: DataFrame, known: DataFrame, cache: str, path: str) -> None:
    """Encodes the distinct contents that the cache lacks, each once, and appends their counts; known are the digests of
    docs. A text moves once, after equal ones in a task became one row, whatever the number of rows that have it; when the
    cache lacks few, only their texts move."""
    spark, version = docs.sparkSession, tokenizer_digest(path)
    rows = docs.select(content_digest(F.col("text")).alias("content"), "text")
    if _exists(spark, cache):
        misses = stored(known.select("content").distinct().join(read_cache(spark, cache, version), "content", "left_anti"), "missing-digests")
        n = misses.count()
        if not n:
            return
        if n <= FEW:
            rows = rows.join(F.broadcast(misses), "content", "left_semi")
        texts = rows.groupBy("content").agg(F.first("text").alias("text"))
        if n > FEW:
            texts = texts.join(misses, "content", "left_semi")
    else:
        texts = rows.groupBy("content").agg(F.first("text").alias("text"))

    def count(batches):
        memo: dict[str, int] = {}
        for rb in bounded(batches):
            n = count_texts(rb.column(0), path, memo)
            yield pa.RecordBatch.from_arrays([rb.column(1), pa.array([version] * len(n), pa.string()), pa.array(n)], names=["content", "tokenizer", "n_tokens"])

    texts.select("text", "content").mapInArrow(count, _CACHE).write.mode("append").parquet(cache)


def token_counts(docs: DataFrame, path: str, cache: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit, a row for each row of docs; adds what the cache lacks to it first.

    A null text counts as empty: no bytes, no tokens. Ids may be null or repeated, and other columns are ignored. Whole
    texts are encoded, without added special tokens; the strings of special tokens inside a text count as the library
    counts them. An empty table adds nothing to the cache. Equal texts are encoded once, under whatever ids; a cache may be
    shared by runs and tokenizers, since its rows carry both digests.
    """
    known = digests(docs)
    add_misses(docs, known, cache, path)
    counts = read_cache(docs.sparkSession, cache, tokenizer_digest(path))
    found = spread_join(known.select("doc_id", "n_bytes", "content"), counts, ["content"])
    return found.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def query(spark: SparkSession, sf_dir: str, cache: str | None = None) -> DataFrame:
    """The counts of all documents; without a cache of its own, the run starts an empty one in the scratch folder."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return token_counts(docs, public_tokenizers.path("word_bpe_49k.json"), cache or scratch(spark, "token-counts"))
