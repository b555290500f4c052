"""Joins of two streams within an interval of event time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def valid_at(asked: DataFrame, cached: DataFrame, key: str, valid: str, lateness: str) -> DataFrame:
    """asked, asked_at, key and cached of each question and each entry of its key that was valid then: from its time on,
    for less than `valid`. A question without one comes out once, with a null, when the watermark of both streams shows
    that none can follow. asked: key, asked_at, asked; cached: key, valid_from, cached.

    Both streams have a watermark and the condition bounds both times, so both sides' state is dropped as time passes.
    """
    a = asked.withWatermark("asked_at", lateness).select(F.col(key).alias("_a"), "asked", "asked_at")
    c = cached.withWatermark("valid_from", lateness).select(F.col(key).alias("_c"), "cached", "valid_from")
    within = (F.col("valid_from") <= F.col("asked_at")) & (F.col("asked_at") < F.col("valid_from") + F.expr(f"INTERVAL {valid}"))
    return a.join(c, (F.col("_a") == F.col("_c")) & within, "left_outer").select("asked", "asked_at", F.col("_a").alias(key), "cached")
