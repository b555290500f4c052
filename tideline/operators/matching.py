"""Joins of texts with tables of phrases."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words of a phrase that are looked up together.
GRAM = 3


def _inner_words(text: Column) -> Column:
    """The words between the first and the last one cut at single spaces: wherever a text holds the phrase, these stand
    between spaces there too; the first and last may be part of longer words."""
    return F.transform(F.array(F.split(text, " ")), lambda w: F.slice(w, 2, F.greatest(F.size(w) - 2, F.lit(0))))[0]


def _grams(words: Column, n: int) -> Column:
    """Hashes of all runs of n words; the words are computed once."""
    single = F.transform(F.array(words), lambda w: F.transform(w, lambda x: F.xxhash64(x)))[0]
    run = lambda h: F.transform(F.slice(h, 1, F.greatest(F.size(h) - (n - 1), F.lit(0))), lambda x, i: F.xxhash64(x, *[F.get(h, i + j) for j in range(1, n)]))
    return F.transform(F.array(single), run)[0]


def _char_grams(text: Column, n: int) -> Column:
    return F.transform(F.array(F.split(text, "")), lambda c: F.array_distinct(F.transform(c, lambda x, i: F.concat(x, *[F.coalesce(F.get(c, i + j), F.lit("")) for j in range(1, n)]))))[0]


def phrases_found(phrases: DataFrame, texts: DataFrame) -> DataFrame:
    """(item_id, found): whether any text holds the phrase, inside words too; phrases: item_id, phrase; texts: text.

    Every lookup is an equi join, verified by `contains`. A phrase is looked up by a run of its inner words, GRAM of them
    if it has so many, else one; the run that the fewest phrases share is taken. Phrases without inner words, of two words
    or fewer, are looked up by their first three characters. An empty phrase is in every text, a null one in none.
    """
    # Runs travel with a hash of their text, not with the text.
    hashed = texts.where("text IS NOT NULL").withColumn("h", F.xxhash64("text"))
    p = phrases.where("phrase IS NOT NULL").select("phrase").distinct().withColumn("w", _inner_words(F.col("phrase")))
    found = []
    for n, wanted in ((GRAM, F.size("w") >= GRAM), (1, (F.size("w") > 0) & (F.size("w") < GRAM))):
        keyed = p.where(wanted).select("phrase", F.explode(F.array_distinct(_grams(F.col("w"), n))).alias("k"))
        if keyed.isEmpty():
            continue
        shared = keyed.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
        rarest = keyed.join(shared, "k").groupBy("phrase").agg(F.min(F.struct("n", "k")).alias("m")).select("phrase", F.col("m.k").alias("k"))
        spread = hashed.select("h", F.explode(_grams(F.split("text", " "), n)).alias("k"))
        found.append(spread.join(rarest, "k").select("h", "phrase"))
    for n in (1, 2, 3):
        size = F.length("phrase")
        brief = p.where((F.size("w") == 0) & ((size == n) if n < 3 else (size >= n))).select("phrase", F.substring("phrase", 1, n).alias("k"))
        if not brief.isEmpty():
            found.append(hashed.select("h", F.explode(_char_grams(F.col("text"), n)).alias("k")).join(brief, "k").select("h", "phrase"))
    hits = p.where(F.col("phrase") == "" if not hashed.isEmpty() else F.lit(False)).select("phrase")
    if found:
        tried = reduce(lambda a, b: a.union(b), found).distinct()
        hits = hits.union(hashed.join(tried, "h").where(F.contains("text", F.col("phrase"))).select("phrase"))
    return phrases.join(hits.distinct().withColumn("found", F.lit(True)), "phrase", "left").select("item_id", F.coalesce("found", F.lit(False)).alias("found"))
