"""N-gram Jaccard join by prefix filters under several global token orders, and the components of its links.

A document's set is its distinct five-word shingles as 64-bit hashes. Documents of one set form a node. Two sets with a
Jaccard similarity of 3/4 or more share a token among the first floor(n/4) + 1 of each under any order of all tokens,
so a candidate pair has to share such a prefix token under each of ORDERS orders. Then the parities of buckets of both sets
are compared, which bound from below how much the sets differ; only what that leaves fetches its sets.

1. Document frequencies are counted over all nodes: blocks of documents send their sorted tokens, packed, to ranges of
   the hash space. Each range answers with bitmaps of the tokens in at least 2, 8, 64 and 512 nodes. The bitmaps have a
   bounded number of bits; two tokens may share one, which makes a token look more frequent, never less.
2. The orders put rare tokens first (by the level the bitmaps give, then by a hash of their own), so passages that many
   documents share stand last. A token in one node only links nothing: a node whose prefix holds none but such tokens
   takes no further part.
3. Nodes that share a prefix token meet there, if enough of both sets follows it in the order. First each is compared with one hub, then with every hub, both only
   across components found so far, last all remaining pairs across components. A group of near copies is joined by a
   star of comparisons so, and none of its pairs is emitted; a pair inside one component cannot change the result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import PIECE, bounded, mix, pieces, spread_join, stored, word_hashes
from .bpe import _expand, _numbers, _planes

WORDS = 5
#: A pair links when 100 * |both| >= PERCENT * |either|.
PERCENT = 75
ORDERS = 2
LEVELS = (2, 8, 64, 512)
MAX_BITS = 30
#: Tokens that one range of the hash space counts, about.
RANGE_TOKENS = 2 << 20
#: Copies to be left out are broadcast up to so many, and joined beyond.
BROADCAST_COPIES = 1_000_000

_ODD = np.uint64(0xB492B66FBE98F273)


def shingle_sets(column: pa.Array, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each text, ascending within it, and each text's first (then the number of all)."""
    found, sizes = [], [np.zeros(0, np.int64)]
    for _, _, data, offsets in pieces(column):
        w, first = word_hashes(data, offsets)
        n = np.diff(first)
        k = np.where(n >= words, n - words + 1, (n > 0).astype(np.int64))
        start, doc = _expand(first[:-1], k), np.repeat(np.arange(len(n)), k)
        length = np.minimum(n, words)[doc]
        h = length.astype(np.uint64)
        for j in range(words):
            use = length > j
            h = np.where(use, h * _ODD + w[np.minimum(start + j, max(len(w) - 1, 0))], h) if len(h) else h
        h = mix(h)
        order = np.lexsort((h, doc))
        h, doc = h[order], doc[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
        found.append(h[new])
        sizes.append(np.bincount(doc[new], minlength=len(n)))
    first = np.concatenate([[0], np.cumsum(np.concatenate(sizes))]).astype(np.int64)
    return np.concatenate(found) if found else np.zeros(0, np.uint64), first


def _set_keys(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit keys of each set: sums over its hashes, so they do not depend on an order."""
    out = []
    for salt in (0x1234567, 0x7654321):
        sums = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(mix(h ^ np.uint64(salt)), out=sums[1:])
        out.append(mix(sums[first[1:]] - sums[first[:-1]]).view(np.int64))
    return out[0], out[1]


def set_keys(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, n_shingles, node and check (the set's keys) of each row."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for rb in bounded(batches):
            h, first = shingle_sets(rb.column(2))
            node, check = _set_keys(h, first)
            yield pa.RecordBatch.from_arrays([rb.column(0), rb.column(1), pa.array(np.diff(first)), pa.array(node), pa.array(check)], names=["doc_id", "text_hash", "n_shingles", "node", "check"])

    return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(run, f"doc_id {kind}, text_hash long, n_shingles long, node long, check long")


def _without_copies(docs: DataFrame, keys: DataFrame) -> tuple[DataFrame, int]:
    """Texts of one document of each node, and the number of tokens they have. Documents without words or id go."""
    full = keys.where((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    me = F.struct("doc_id", "text_hash")
    first = full.groupBy("node", "check").agg(F.min(me).alias("first"), F.max("n_shingles").alias("n"))
    total = int(first.agg(F.sum("n").alias("t")).first()["t"] or 0)
    copies = stored(spread_join(full, first.select("node", "check", "first"), ["node", "check"]).where(me != F.col("first")).select("doc_id", "text_hash"), "copies")
    texts = docs.where(F.col("doc_id").isNotNull()).select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    few = copies.limit(BROADCAST_COPIES + 1).count() <= BROADCAST_COPIES
    return texts.join(F.broadcast(copies) if few else copies, ["doc_id", "text_hash"], "left_anti").select("text"), total


def _send_tokens(b: int):
    """The sorted distinct tokens of each block, cut to b + 32 bits and dealt to 2**b ranges, with their counts."""

    def run(batches):
        for rb in bounded(batches, limit=16 * PIECE):
            h, _ = shingle_sets(rb.column(0))
            h = np.sort(h >> np.uint64(32 - b))
            if not len(h):
                continue
            at = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            counts, h = np.diff(np.append(at, len(h))), h[at]
            cut = np.searchsorted(h, np.arange((1 << b) + 1, dtype=np.uint64) << np.uint64(32))
            full = np.flatnonzero(np.diff(cut))
            low = (h & np.uint64(0xFFFFFFFF)).astype(np.uint32)
            steps = [_planes(np.diff(low[cut[r] : cut[r + 1]], prepend=np.uint32(0))) for r in full]
            yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array(steps, pa.binary()), pa.array([_planes(counts[cut[r] : cut[r + 1]] - 1) for r in full], pa.binary())], names=["range", "steps", "more"])

    return run


def _count_range(b: int, bits: list[int]):
    def run(key, table):
        r = key[0].as_py()
        low = np.concatenate([np.cumsum(_numbers(x.as_py()), dtype=np.uint64) for x in table.column("steps")])
        n = np.concatenate([_numbers(x.as_py()).astype(np.int64) + 1 for x in table.column("more")])
        order = np.argsort(low, kind="stable")
        low, n = low[order], n[order]
        at = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]]))
        df, low = np.add.reduceat(n, at), low[at]
        slices = []
        for least, size in zip(LEVELS, bits, strict=True):
            slot = np.zeros(1 << (size - b), bool)
            slot[(low[df >= least] >> np.uint64(32 + b - size)).astype(np.int64)] = True
            slices.append(np.packbits(slot).tobytes())
        return pa.table({"range": pa.array([r] * len(bits), pa.int32()), "level": pa.array(range(len(bits)), pa.int32()), "bits": pa.array(slices, pa.binary())})

    return run


def frequency_levels(texts: DataFrame, total: int) -> tuple[list[int], list[np.ndarray]]:
    """For each of LEVELS, the number of leading hash bits and a bitmap over them: set where a token is that frequent."""
    b = max(3, math.ceil(math.log2(max(total, 1) / RANGE_TOKENS))) if total > RANGE_TOKENS else 3
    top = min(MAX_BITS, max(b + 6, math.ceil(math.log2(total + 2))))
    bits = [top] + [top - 3] * (len(LEVELS) - 1)
    sent = texts.mapInArrow(_send_tokens(b), "range int, steps binary, more binary")
    rows = sent.groupBy("range").applyInArrow(_count_range(b, bits), "range int, level int, bits binary").collect()  # bounded by MAX_BITS
    maps = [np.zeros(1 << (size - 3), np.uint8) for size in bits]
    for r in rows:
        width = 1 << (bits[r["level"]] - b - 3)
        maps[r["level"]][r["range"] * width : (r["range"] + 1) * width] = np.frombuffer(r["bits"], np.uint8)
    return bits, maps


def _levels_of(h: np.ndarray, bits: list[int], maps: list[np.ndarray]) -> np.ndarray:
    out = np.zeros(len(h), np.int8)
    for k, (size, own) in enumerate(zip(bits, maps, strict=True)):
        at = (h >> np.uint64(64 - size)).astype(np.int64)
        hit = (own[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1
        out[hit > 0] = k + 1
    return out


def _parities(own: np.ndarray) -> np.ndarray:
    """For buckets of the set's hashes, four or more for each: whether an odd number falls into each, as bits.

    Every element that two sets do not share changes one bit, so they have at least as many such elements as their
    parities differ in; half as many buckets are the exclusive or of both halves."""
    size = 1 << max(6, (4 * len(own) - 1).bit_length())
    odd = np.bincount((own & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(bool), bitorder="little").view("<i8")


def _active(bits: list[int], maps, orders: int):
    """(node, n, alone, parities, prefix tokens of each order that may link, the set) of the texts whose prefixes hold
    such tokens.

    alone is the number of tokens that no other node has; they come first in every order.
    """

    def run(batches):
        for rb in bounded(batches):
            h, first = shingle_sets(rb.column(0))
            n = np.diff(first)
            level = _levels_of(h, bits, maps.value)
            alone = np.zeros(len(h) + 1, np.int64)
            np.cumsum(level == 0, out=alone[1:])
            prefix = n - -(-PERCENT * n // 100) + 1
            lone = alone[first[1:]] - alone[first[:-1]]
            live = np.flatnonzero((n > 0) & (lone < prefix))
            node, _ = _set_keys(h, first)
            columns = [[] for _ in range(orders)]
            for d in live:
                own, lv = h[first[d] : first[d + 1]], level[first[d] : first[d + 1]]
                for k in range(orders):
                    key = mix(own ^ np.uint64(0x5851F42D4C957F2D * (k + 1) & (2**64 - 1)))
                    chosen = np.lexsort((key, lv))[: prefix[d]]
                    columns[k].append(own[chosen[lv[chosen] > 0]].view(np.int64))
            sets = [h[first[d] : first[d + 1]].tobytes() for d in live]
            yield pa.RecordBatch.from_arrays(
                [pa.array(node[live]), pa.array(n[live]), pa.array(lone[live]), pa.array([_parities(h[first[d] : first[d + 1]]) for d in live], pa.list_(pa.int64())), *(pa.array(c, pa.list_(pa.int64())) for c in columns), pa.array(sets, pa.binary())],
                names=["node", "n", "alone", "odd", *(f"p{k}" for k in range(orders)), "set"],
            )

    return run


def _similar_size(a: str, b: str) -> Column:
    return (100 * F.least(a, b)) >= (PERCENT * F.greatest(a, b))


def _enough_left(n_a: str, at_a: str, n_b: str, at_b: str) -> Column:
    """Whether sets that first meet at these positions (from 0) of one order can still have enough in common."""
    need = PERCENT * (F.col(n_a) + F.col(n_b))
    return ((100 + PERCENT) * (F.col(n_a) - F.col(at_a)) >= need) & ((100 + PERCENT) * (F.col(n_b) - F.col(at_b)) >= need)


def _differences(a: Column, b: Column) -> Column:
    """In how many buckets two lists of parities differ; the longer one is folded to the length of the other."""
    half = lambda x: F.zip_with(F.slice(x, F.lit(1), (F.size(x) / 2).cast("int")), F.slice(x, (F.size(x) / 2).cast("int") + 1, F.size(x)), lambda p, q: p.bitwiseXOR(q))
    fold = lambda x, y: F.when(F.size(x) > F.size(y), half(x)).otherwise(x)
    return F.aggregate(F.zip_with(fold(a, b), fold(b, a), lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda s, n: s + n)


def candidates(pairs: DataFrame, active: DataFrame, orders: int) -> DataFrame:
    """The pairs (a, b) that share a prefix token in every order and whose parities do not show them to be too unlike.

    Sizes of a pair differ by a third at most, so their lists of parities by one halving."""
    rest = [f"p{k}" for k in range(1, orders)]
    for side in ("a", "b"):
        pairs = pairs.join(active.select(F.col("node").alias(side), *(F.col(c).alias(f"{c}_{side}") for c in ["n", "alone", "odd", *rest])), side)
    common = F.ceil(PERCENT * (F.col("n_a") + F.col("n_b")) / F.lit(100 + PERCENT)).cast("int")
    short = lambda c, s: F.slice(f"{c}_{s}", 1, F.greatest(F.col(f"n_{s}") - common + 1 - F.col(f"alone_{s}"), F.lit(0)).cast("int"))
    pairs = pairs.where(_differences(F.col("odd_a"), F.col("odd_b")) <= F.col("n_a") + F.col("n_b") - 2 * common)
    for c in rest:
        pairs = pairs.where(F.arrays_overlap(short(c, "a"), short(c, "b")))
    return pairs.select("a", "b")


def _verified(pairs: DataFrame, active: DataFrame, orders: int) -> DataFrame:
    """The candidates among the pairs (a, b) whose sets are similar enough; only these fetch their sets."""
    pairs = candidates(pairs, active, orders)
    for side in ("a", "b"):
        pairs = pairs.join(active.select(F.col("node").alias(side), F.col("set").alias(f"set_{side}")), side)

    def run(batches):
        for rb in batches:
            ok = []
            for x, y in zip(rb.column(2), rb.column(3), strict=True):
                x, y = (np.frombuffer(s.as_buffer(), np.uint64) for s in (x, y))
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                both = int((y[at] == x).sum())
                ok.append(100 * both >= PERCENT * (len(x) + len(y) - both))
            yield rb.select([0, 1]).filter(pa.array(ok, pa.bool_()))

    return pairs.select("a", "b", "set_a", "set_b").mapInArrow(run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(node, label): the smallest node that each node of the links (a, b) is connected with.

    Labels pass along links and are then replaced by their own labels, until none changes.
    """
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")), "labels")
    while True:
        near = both.join(labels, both.a == labels.node).groupBy(F.col("b").alias("node")).agg(F.min("label").alias("m"))
        step = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "m").alias("label"))
        far = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        moved = stored(step.join(far, "label", "left").select("node", "old", F.least("label", F.coalesce("further", "label")).alias("label")), "labels")
        labels = moved.select("node", "label")
        if moved.where("label != old").limit(1).count() == 0:
            return labels


def _across(pairs: DataFrame, labels: DataFrame | None) -> DataFrame:
    """The pairs whose ends are not in one component."""
    if labels is None:
        return pairs
    for side in ("a", "b"):
        pairs = pairs.join(labels.select(F.col("node").alias(side), F.col("label").alias(f"l_{side}")), side, "left")
    return pairs.where(F.coalesce("l_a", "a") != F.coalesce("l_b", "b")).select("a", "b")


def link_components(active: DataFrame, orders: int = ORDERS) -> DataFrame:
    """(node, label) of the nodes that have a link; label is the same for nodes that links connect.

    active: node, n, alone, odd, p0, p1, ..., set, a row for each node (more rows of one node do no harm).
    """
    tokens = active.select("node", "n", "alone", F.posexplode("p0").alias("at", "token")).withColumn("at", F.col("at") + F.col("alone"))
    # The hub has the smallest share of tokens of its own: of a group of edited copies, the least edited one.
    shared = tokens.groupBy("token").agg(F.min(F.struct((F.col("alone") / F.col("n")).alias("share"), "node", "n", "at")).alias("hub"), F.min("node").alias("lo"), F.max("node").alias("hi"))
    shared = shared.where("lo != hi").select("token", F.col("hub.node").alias("hub"), F.col("hub.n").alias("hub_n"), F.col("hub.at").alias("hub_at"))
    stars = tokens.join(shared, "token").where((F.col("node") != F.col("hub")) & _similar_size("n", "hub_n") & _enough_left("n", "at", "hub_n", "hub_at"))
    stars = stored(stars.groupBy(F.col("hub").alias("a"), F.col("node").alias("b")).agg(F.count(F.lit(1)).alias("votes")), "stars")
    best = stars.groupBy("b").agg(F.max(F.struct("votes", "a")).alias("m")).select(F.col("m.a").alias("a"), "b")
    links = stored(_verified(best, active, orders), "links")
    labels = components(links)
    more = stored(_verified(_across(stars.select("a", "b"), labels), active, orders), "links")
    links = links.union(more)
    labels = components(links)
    # All pairs across components that share a token: only tokens where two components still meet.
    placed = tokens.join(labels, "node", "left").select("token", "node", "n", "at", F.coalesce("label", "node").alias("label"))
    split = placed.groupBy("token").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo != hi").select("token")
    met = placed.join(split, "token", "left_semi")
    x, y = (met.select("token", F.col("node").alias(s), F.col("n").alias(f"n_{s}"), F.col("at").alias(f"at_{s}"), F.col("label").alias(f"l_{s}")) for s in ("a", "b"))
    pairs = x.join(y, (x.token == y.token) & (x.l_a < y.l_b) & _similar_size("n_a", "n_b") & _enough_left("n_a", "at_a", "n_b", "at_b")).select("a", "b").distinct()
    tried = stars.select("a", "b").union(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
    rest = stored(_verified(pairs.join(tried, ["a", "b"], "left_anti"), active, orders), "links")
    return components(links.union(rest))


def ngram_jaccard_join(docs: DataFrame, orders: int = ORDERS) -> DataFrame:
    """doc_id, n_shingles and component_id, a row for each row of docs.

    component_id is the smallest id that links reach from the row, itself included. A null or empty text has no
    shingles and links with nothing, so its component is its own id. Rows with a null id link with nothing and have a
    null component. Equal texts are linked, repeated rows too. Other columns are ignored. docs is read several times.
    """
    keys = stored(set_keys(docs.select("doc_id", "text")), "set-keys")
    texts, total = _without_copies(docs, keys)
    bits, maps = frequency_levels(texts, total)
    held = docs.sparkSession.sparkContext.broadcast(maps)
    schema = "node long, n long, alone long, odd array<long>, " + "".join(f"p{k} array<long>, " for k in range(orders)) + "set binary"
    active = stored(texts.mapInArrow(_active(bits, held, orders), schema), "active")
    labels = link_components(active, orders)
    linked = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    rows = spread_join(keys.where(linked).select("doc_id", "n_shingles", "node"), labels, ["node"]).withColumn("label", F.coalesce("label", "node"))
    least = rows.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    placed = spread_join(rows.select("doc_id", "n_shingles", "label"), least, ["label"]).select("doc_id", "n_shingles", "component_id")
    return placed.unionByName(keys.where(~linked).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_join(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one document of each component, that of the smallest id; documents without an id stay."""
    found = ngram_jaccard_join(docs)
    stay = found.where(F.col("doc_id") == F.col("component_id")).select("doc_id").distinct()
    kept = docs.join(stay, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return kept.select(*docs.columns).unionByName(docs.where(F.col("doc_id").isNull()))
