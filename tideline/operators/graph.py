"""Concept graphs as edge tables (prerequisite, dependent)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import stored


def chain_edges(nodes: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """An edge from each node to the next one of its group, once, without loops on itself."""
    before = F.lag(name).over(Window.partitionBy(*keys).orderBy(*order))
    e = nodes.select(before.alias("prerequisite"), F.col(name).alias("dependent"))
    return e.where(F.col("prerequisite").isNotNull() & (F.col("prerequisite") != F.col("dependent"))).distinct()


def ancestors(edges: DataFrame, depth: int) -> DataFrame:
    """(concept, prerequisite, depth): everything within `depth` steps upstream, at its smallest distance.

    One self join for each step, so the plan's size is the depth, not the graph."""
    step = edges.select(F.col("dependent").alias("_d"), F.col("prerequisite").alias("_p"))
    levels = [edges.select(F.col("dependent").alias("concept"), "prerequisite", F.lit(1).alias("depth"))]
    for d in range(2, depth + 1):
        last = levels[-1]
        levels.append(last.join(step, last.prerequisite == step["_d"]).select("concept", F.col("_p").alias("prerequisite"), F.lit(d).alias("depth")).distinct())
    every = reduce(lambda a, b: a.union(b), levels).where(F.col("concept") != F.col("prerequisite"))
    return every.groupBy("concept", "prerequisite").agg(F.min("depth").alias("depth"))


def weak_prerequisites(mastery: DataFrame, edges: DataFrame, threshold: float) -> DataFrame:
    """(user_id, concept, prerequisite) where the learner's mastery of a direct prerequisite is low or missing."""
    have = mastery.select("user_id", F.col("concept").alias("prerequisite"), F.col("mastery").alias("_m"))
    need = mastery.select("user_id", "concept").distinct().join(edges, "concept").join(have, ["user_id", "prerequisite"], "left")
    return need.where(F.coalesce("_m", F.lit(0.0)) < threshold).select("user_id", "concept", "prerequisite")


def topological_levels(edges: DataFrame) -> DataFrame:
    """(node, level): the length of the longest way from a node without prerequisites, for graphs of any depth.

    Nodes without an open prerequisite are taken away, level by level, and their dependents have one less. The rounds end
    when all nodes are gone; if some are left and none is free, they lie on or behind a cycle, and that is an error.
    Repeated edges count once, edges from a node to itself not at all. Each round writes the counts of open nodes, and
    reads the edges of those that it took.
    """
    spark = edges.sparkSession
    every = edges.select("prerequisite", "dependent").where(F.col("prerequisite").isNotNull() & F.col("dependent").isNotNull())
    kept = stored(every.where(F.col("prerequisite") != F.col("dependent")).distinct(), "graph-edges")
    needs = kept.groupBy(F.col("dependent").alias("node")).agg(F.count(F.lit(1)).alias("open"))
    nodes = every.select(F.col("prerequisite").alias("node")).union(every.select("dependent")).distinct()
    open_ = stored(nodes.join(needs, "node", "left").select("node", F.coalesce("open", F.lit(0)).cast("long").alias("open")), "graph-open")
    left, levels = open_.count(), []
    while left:
        free = open_.where("open = 0").select("node")
        levels.append(free.withColumn("level", F.lit(len(levels))))
        less = kept.join(free, kept.prerequisite == free.node).groupBy(F.col("dependent").alias("node")).agg(F.count(F.lit(1)).alias("less"))
        rest = open_.where("open > 0").join(less, "node", "left").select("node", (F.col("open") - F.coalesce("less", F.lit(0))).alias("open"))
        open_ = stored(rest, "graph-open")
        n = open_.count()
        if n == left:
            raise ValueError(f"{n} nodes lie on a cycle or behind one")
        left = n
    none = spark.createDataFrame([], nodes.schema).withColumn("level", F.lit(0))
    return reduce(lambda a, b: a.unionByName(b), levels, none)
