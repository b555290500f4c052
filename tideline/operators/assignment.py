"""Assignment of items to queries by rounds of proposals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import stored


def in_turn(hits: DataFrame) -> DataFrame:
    """(query, id): the queries of a label, in the order of their numbers, take the best of their hits that is free.

    hits: label, query, id, rank. All items prefer the smaller query, so taking turns gives the one stable matching, and
    any order of proposals finds it: in each round every query without an item asks for its next one, and an item keeps
    the smallest query of those that ever asked. A round is one join and one group-by of all labels at once; no group of
    queries is gathered. Only queries that are not turned away in a round wait; the rounds end when nobody is.
    """
    order = Window.partitionBy("label", "query").orderBy("rank", "id")
    wishes = stored(hits.select("label", "query", "id", F.row_number().over(order).alias("nth")), "wishes")
    asks = stored(wishes.where("nth = 1"), "asks")
    while True:
        held = asks.groupBy("label", "id").agg(F.min("query").alias("holder"))
        told = stored(asks.join(held, ["label", "id"]).withColumn("kept", F.col("query") == F.col("holder")), "asks-told")
        if told.where("NOT kept").isEmpty():
            return told.select("query", "id")
        again = told.where("NOT kept").select("label", "query", (F.col("nth") + 1).alias("nth"))
        asks = stored(told.where("kept").select(*asks.columns).unionByName(again.join(wishes, ["label", "query", "nth"]).select(*asks.columns)), "asks")
