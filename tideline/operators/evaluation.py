"""Ranking metrics, graded items, answer scores and comparisons of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def ranking_metrics(hits: DataFrame, k: int, hit_k: int) -> DataFrame:
    """query, precision (over k, however many were retrieved), hit, mrr and ndcg, whose ideal is the retrieved gains
    in their best order; hits: query, rank from 1, relevant."""
    gain = F.col("relevant").cast("int")
    best = F.row_number().over(Window.partitionBy("query").orderBy(gain.desc(), "rank"))
    g = hits.withColumn("_g", gain).withColumn("_b", best).groupBy("query").agg(
        (F.sum(F.when(F.col("rank") <= k, F.col("_g")).otherwise(0)) / F.lit(float(k))).alias("precision"),
        F.max(F.when(F.col("rank") <= hit_k, F.col("_g")).otherwise(0)).alias("hit"),
        F.coalesce(F.lit(1.0) / F.min(F.when(F.col("_g") == 1, F.col("rank"))), F.lit(0.0)).alias("mrr"),
        F.sum(F.col("_g") / F.log2(F.col("rank") + 1)).alias("dcg"),
        F.sum(F.col("_g") / F.log2(F.col("_b") + 1)).alias("ideal"),
    )
    return g.select("query", "precision", "hit", "mrr", F.coalesce(F.try_divide("dcg", "ideal"), F.lit(0.0)).alias("ndcg"))


#: Measures of retrieval that may fall, and the measure that may rise.
RETRIEVAL = ("retrieval_top1", "retrieval_top3", "retrieval_mrr", "retrieval_ndcg")


def regressions(before: DataFrame, now: DataFrame, score_drop: float = 0.05, latency_ratio: float = 1.5, latency_floor: float = 5000.0, retrieval_drop: float = 0.05, hallucination_rise: float = 0.05, apart: int = 2) -> DataFrame:
    """(phase, kind, measure, previous, now) of what got worse in phases that both runs have.

    before and now: phase, ms, score, and where there are any status, hallucination_rate and the measures of RETRIEVAL.
    A lower score, a time above the floor that grew by the ratio, a retrieval measure that fell, hallucinations that rose.
    Phases skipped in one of the runs are left out, and runs whose sets of phases differ in more than `apart` are not
    compared at all.
    """
    given = ["ms", "score", *[c for c in (*RETRIEVAL, "hallucination_rate", "status") if c in before.columns and c in now.columns]]
    b = before.select("phase", *[F.col(c).alias(f"{c}_b") for c in given])
    n = now.select("phase", *[F.col(c).alias(f"{c}_n") for c in given])
    differing = before.select("phase").distinct().withColumn("_b", F.lit(1)).join(now.select("phase").distinct().withColumn("_n", F.lit(1)), "phase", "full_outer").agg(F.count_if(F.col("_b").isNull() | F.col("_n").isNull()).alias("_differ"))
    both = b.join(n, "phase").join(F.broadcast(differing)).where(F.col("_differ") <= apart)  # one row
    if "status" in given:
        both = both.where((F.coalesce("status_b", F.lit("")) != "SKIP") & (F.coalesce("status_n", F.lit("")) != "SKIP"))

    def found(kind: str, measure: str, worse: Column) -> Column:
        return F.when(worse, F.struct(F.lit(kind).alias("kind"), F.lit(measure).alias("measure"), F.col(f"{measure}_b").cast("double").alias("previous"), F.col(f"{measure}_n").cast("double").alias("now")))

    fell = lambda m, by: F.col(f"{m}_n") < F.col(f"{m}_b") - by
    rules = [
        found("quality_drop", "score", (F.col("score_b") != 0) & fell("score", score_drop)),
        *[found("retrieval_degradation", m, F.col(f"{m}_b") - F.col(f"{m}_n") > retrieval_drop) for m in RETRIEVAL if m in given],
        *[found("hallucination_increase", m, F.col(f"{m}_n") - F.col(f"{m}_b") > hallucination_rise) for m in ("hallucination_rate",) if m in given],
        found("latency_increase", "ms", (F.col("ms_b") >= latency_floor) & (F.col("ms_n") > F.col("ms_b") * latency_ratio)),
    ]
    return both.select("phase", F.explode(F.array_compact(F.array(*rules))).alias("x")).select("phase", "x.*")


def graded(answers: DataFrame, key: DataFrame) -> DataFrame:
    """submission, items, answered, correct, score in percent and status, from answers (submission, item, given) and a
    key (item, answer); case and white space around do not matter."""
    same = lambda c: F.lower(F.trim(c))
    joined = answers.join(key, "item").withColumn("_ok", F.coalesce(same(F.col("given")) == same(F.col("answer")), F.lit(False)))
    g = joined.groupBy("submission").agg(F.count(F.lit(1)).alias("items"), F.count("given").alias("answered"), F.count_if("_ok").alias("correct"))
    return g.withColumn("score", 100.0 * F.col("correct") / F.col("items")).withColumn("status", F.when(F.col("answered") == F.col("items"), "graded").otherwise("submitted"))


def run_statistics(rows: DataFrame, key: str, value: str, good: float) -> DataFrame:
    """n, median, p90 (an element, not interpolated), mean and the share that is good, of each run."""
    s = F.sort_array(F.collect_list(value))
    n = F.size("_s")
    g = rows.groupBy(key).agg(s.alias("_s"), F.count(F.lit(1)).alias("n"), F.bround(F.median(value), 4).alias("median"), F.bround(F.avg(value), 6).alias("mean"), F.bround(100.0 * F.count_if(F.col(value) >= good) / F.count(F.lit(1)), 4).alias("good_pct"))
    return g.select(key, "n", "median", F.get("_s", F.least(n - 1, F.floor(0.9 * n).cast("int"))).alias("p90"), "mean", "good_pct")


def tutor_score(answer: Column, context: Column) -> Column:
    """Groundedness, faithfulness, alignment, reading level, citation and length in one score, less a penalty for years
    that the context does not have; unsafe answers get 0."""
    words = F.regexp_extract_all(answer, F.lit("([A-Za-z]+)"), 1)
    mean = F.aggregate(words, F.lit(0), lambda s, w: s + F.length(w)) / F.size(words)
    grade = F.when(F.size(words) == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.0 - (mean - 8.5) / 5.0)))
    cite = F.when(answer == "", 0.0).when(answer.rlike(r"(?i)(page\s*[0-9]+|fig(ure)?\.?\s*[0-9]+|chapter\s*[0-9]+)"), 1.0).otherwise(0.5)
    low = F.lower(context)
    years = F.size(F.filter(F.regexp_extract_all(answer, F.lit(r"\b([0-9]{4})\b"), 1), lambda y: ~F.contains(low, y)))
    hedge = F.when(F.lower(answer).rlike(r"\b(as an ai|i don't have access to the (textbook|chapter))\b"), 0.2).otherwise(0.0)
    length = F.when(F.length(answer).between(40, 8000), 0.1).otherwise(0.0)
    total = 0.25 * T.groundedness(answer, context) + 0.25 * (1.0 - hedge) + 0.2 + 0.1 * grade + 0.1 * cite + length - F.least(F.lit(0.5), 0.1 * years)
    unsafe = answer.rlike(r"(?i)\b(kill yourself|make a bomb|hack into|credit card number)\b")
    return F.when(unsafe, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), total)))
