"""Matches of titles with what learners say, and of page numbers with pages."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import title_score


def _words(text: str) -> Column:
    return F.array_distinct(F.filter(F.split(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "), " "), lambda w: w != ""))


def best_title(queries: DataFrame, titles: DataFrame, key: str, topic: str, least: float) -> DataFrame:
    """(key, topic, score): the title that fits each query best, if its score is `least` or more; the smaller topic on ties.

    queries: key and query; titles: topic and title. A title is scored only if it shares a word with the query, so both
    meet by an equi join on words; the words of titles are counted once for each distinct query.
    """
    asked = queries.select("query").distinct()
    a = asked.select("query", F.explode(_words("query")).alias("word"))
    b = titles.select(F.col(topic).alias("_topic"), "title", F.explode(_words("title")).alias("word"))
    pairs = a.join(b, "word").select("query", "_topic", "title").distinct()
    scored = pairs.withColumn("score", title_score(F.col("query"), F.col("title"))).where(F.col("score") >= least)
    best = scored.groupBy("query").agg(F.max(F.struct("score", (-F.col("_topic")).alias("minus"))).alias("m"))
    return queries.join(best, "query").select(key, (-F.col("m.minus")).alias(topic), F.col("m.score").alias("score"))


def align(numbers, pages) -> list[int]:
    """For each of the ascending numbers, the place of the page that it belongs to: in order, each page taken once, with
    the smallest sum of distances; of ways that cost the same, the one whose last, then last but one, ... page is earliest.
    Nothing where there are fewer pages."""
    if len(numbers) > len(pages):
        return []
    at, sums = np.asarray(pages, float), []
    before = np.zeros(len(at))  # the least cost of the numbers so far on pages before each
    for x in numbers:
        sums.append(before + np.abs(at - x))
        before = np.append(np.inf, np.minimum.accumulate(sums[-1])[:-1]) if len(at) else before
    out = [len(at)]
    for total in reversed(sums):
        out.append(int(np.argmin(total[: out[-1]])))
    return out[:0:-1]


def aligned(numbers: Column, pages: Column) -> Column:
    """The array of places that `align` gives for two short ascending arrays."""

    @F.pandas_udf("array<int>")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([align(x, y) for x, y in zip(a, b, strict=True)], dtype=object)

    return run(numbers, pages)
