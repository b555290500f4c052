"""Vector and keyword retrieval: filtered top-k, fusion, diversity and selection rules."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x))


def cosine(a: Column, b: Column) -> Column:
    """0 where one of the vectors is zero."""
    return F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0))


def normalised(a: Column) -> Column:
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: x.cast("double") / n)).otherwise(F.transform(a, lambda x: x.cast("double")))


#: Rows of prototypes, samples or block counts that are carried to every row, at most.
CARRIED = 10_000
#: Vectors of one block, and queries that are compared with a block at once.
BLOCK, AT_ONCE = 20_000, 256
#: Scores are rounded to six places; what is as near to the last kept one may still come before it.
_SLACK = 3e-6


def _best_of_block(k: int):
    """For the queries of a partition and one block of its vectors: the pairs that may be among a query's k best."""

    def matrix(column) -> np.ndarray:
        flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        v = np.asarray(flat.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(flat), -1)
        return v / np.where((n := np.linalg.norm(v, axis=1, keepdims=True)) > 0, n, 1.0)

    def run(queries: pa.Table, vectors: pa.Table) -> pa.Table:
        found_q, found_v = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        if queries.num_rows and vectors.num_rows:
            v = matrix(vectors.column("_v"))
            for lo in range(0, queries.num_rows, AT_ONCE):
                scores = matrix(queries.column("_asked").slice(lo, AT_ONCE)) @ v.T
                last = np.partition(scores, -min(k, scores.shape[1]), axis=1)[:, -min(k, scores.shape[1])]
                q, at = np.nonzero(scores >= last[:, None] - _SLACK)
                found_q.append(q + lo)
                found_v.append(at)
        return pa.table({"query": queries.column("_query").take(pa.array(np.concatenate(found_q))), "id": vectors.column("_id").take(pa.array(np.concatenate(found_v)))})

    return run


def topk_filtered(queries: DataFrame, vectors: DataFrame, partition: str, k: int) -> DataFrame:
    """(query, id, score, rank): the k vectors of the query's own partition with the greatest cosine.

    queries: query, vector and the partition; vectors: id, vector and the partition; vectors of one length and not null.
    The filter is the key, so a query never meets another partition's vectors. A partition's vectors are cut to blocks by
    their ids; each block multiplies its matrix with the queries' and lets some k vectors of a query pass, so what leaves
    a block does not grow with it. Only these are scored and ranked as rows.
    """
    sizes = vectors.groupBy(partition).agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / F.lit(float(BLOCK)))).alias("_blocks"))
    v = vectors.select(partition, "id", "vector").join(F.broadcast(sizes) if sizes.limit(CARRIED + 1).count() <= CARRIED else sizes, partition)
    v = v.select(F.col(partition).alias("_part"), F.pmod(F.xxhash64("id"), "_blocks").alias("_at"), F.col("id").alias("_id"), F.col("vector").alias("_v"))
    q = queries.select("query", "vector", partition)
    asked = q.join(sizes, partition).select(F.col(partition).alias("_key"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1)).alias("_block"), F.col("query").alias("_query"), F.col("vector").alias("_asked"))
    kinds = dict(queries.dtypes)["query"], dict(vectors.dtypes)["id"]
    near = asked.groupBy("_key", "_block").cogroup(v.groupBy("_part", "_at")).applyInArrow(_best_of_block(k), f"query {kinds[0]}, id {kinds[1]}")
    pairs = near.join(q.select("query", "vector", partition), "query").join(vectors.select(partition, "id", F.col("vector").alias("_v")), ["id", partition])
    scored = pairs.select("query", "id", F.bround(cosine(F.col("vector"), F.col("_v")), 6).alias("score"))
    w = Window.partitionBy("query").orderBy(F.col("score").desc(), "id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def without_weak(hits: DataFrame, floor: float = 0.28, keep: float = 0.5) -> DataFrame:
    """Hits of each query with at least `keep` of its best score, and those without a score; no hit at all where the
    best score is below the floor."""
    top = F.max("score").over(Window.partitionBy("query"))
    judged = hits.withColumn("_top", top)
    return judged.where(F.col("_top").isNull() | ((F.col("_top") >= floor) & (F.col("score").isNull() | (F.col("score") >= F.col("_top") * keep)))).drop("_top")


def fused(rankings: DataFrame, k: int = 60) -> DataFrame:
    """(query, id, score): reciprocal rank fusion of rows (query, id, rank)."""
    return rankings.groupBy("query", "id").agg(F.sum(F.lit(1.0) / (k + F.col("rank"))).alias("score"))


def strict_selection(hits: DataFrame, least: float, primary: int = 2, ratio: float = 0.92, total: int = 4) -> DataFrame:
    """hits with selected and reason: the best two above `least`, then up to four that are nearly as good as the first;
    where none is above it, the best one alone."""
    w = Window.partitionBy("query").orderBy(F.col("score").desc(), "id")
    r = hits.withColumn("_r", F.row_number().over(w)).withColumn("_top", F.max("score").over(Window.partitionBy("query")))
    fits = (F.col("score") >= least) | ((F.col("_top") < least) & (F.col("_r") == 1))
    chosen = fits & ((F.col("_r") <= primary) | ((F.col("_r") <= total) & (F.col("score") >= F.col("_top") * ratio)))
    reason = F.when(chosen, F.lit(None)).when(F.col("score") < least, "below_min_score").when(F.col("score") < F.col("_top") * ratio, "below_extra_ratio").otherwise("count_limit")
    return r.withColumn("selected", chosen).withColumn("reason", reason).drop("_r", "_top")


def diverse(hits: DataFrame, n: int, weight: float = 0.7) -> DataFrame:
    """(query, id, place): maximal marginal relevance; hits: query, id, score (0..100) and vector, few for each query."""
    schema = "query long, id long, place int"

    def choose(table: pa.Table) -> pa.Table:
        frame = table.to_pandas().sort_values(["score", "id"], ascending=[False, True], ignore_index=True)
        v = np.stack(frame.vector.to_numpy()).astype(float)
        v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
        left, picked = list(range(len(frame))), []
        while left and len(picked) < n:
            gain = [weight * frame.score[i] - (1 - weight) * 100 * (max(v[i] @ v[j] for j in picked) if picked else 0) for i in left]
            picked.append(left.pop(int(np.argmax(gain))))
        return pa.table({"query": pa.array(frame["query"][picked].to_numpy(), pa.int64()), "id": pa.array(frame.id[picked].to_numpy(), pa.int64()), "place": pa.array(range(1, len(picked) + 1), pa.int32())})

    return hits.groupBy("query").applyInArrow(choose, schema)


def prototypes(vectors: DataFrame, labelled: DataFrame, least: float) -> DataFrame:
    """(id, label, score): the label whose mean direction is nearest, null below `least`. There are as many prototypes
    as labels; more than CARRIED are an error, since they are broadcast."""
    if labelled.select("label").distinct().limit(CARRIED + 1).count() > CARRIED:
        raise ValueError(f"more than {CARRIED} labels")
    unit = labelled.select("label", F.posexplode(normalised(F.col("vector"))).alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("x"))
    p = unit.groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("_p"))
    table = p.agg(F.sort_array(F.collect_list(F.struct("label", "_p"))).alias("ps"))
    scored = vectors.join(F.broadcast(table)).withColumn("best", F.array_max(F.transform("ps", lambda s: F.struct(F.bround(cosine(F.col("vector"), s["_p"]), 6).alias("score"), (-s["label"]).alias("minus")))))
    return scored.select("id", F.when(F.col("best.score") >= least, -F.col("best.minus")).alias("label"), F.col("best.score").alias("score"))


def nearest_prototype(vectors: DataFrame, samples: DataFrame, least: float, margin: float) -> DataFrame:
    """(id, label, score): the label of the nearest sample, as a hundred times the cosine; null where that is below
    `least`, or less than `margin` above the best of another label (or above 0). samples: label, vector, a few for each
    of a fixed set of labels; more than CARRIED are an error, since they are broadcast."""
    if samples.limit(CARRIED + 1).count() > CARRIED:
        raise ValueError(f"more than {CARRIED} sample vectors")
    listed = samples.groupBy("label").agg(F.collect_list("vector").alias("vs")).agg(F.collect_list(F.struct("label", "vs")).alias("ps"))
    best = lambda s: F.array_max(F.transform(s["vs"], lambda v: F.bround(100 * cosine(F.col("vector"), v), 4)))
    scores = F.reverse(F.array_sort(F.transform("ps", lambda s: F.struct(best(s).alias("score"), (-s["label"]).alias("minus")))))
    scored = vectors.join(F.broadcast(listed)).select("id", scores.alias("s"))
    first, second = F.get("s", F.lit(0)), F.coalesce(F.get("s", F.lit(1))["score"], F.lit(0.0))
    sure = (first["score"] >= least) & (first["score"] - F.greatest(second, F.lit(0.0)) >= margin)
    return scored.select("id", F.when(sure, -first["minus"]).alias("label"), first["score"].alias("score"))
