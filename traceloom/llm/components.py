"""Connected components of an edge table, by alternating large-star and small-star steps.

Every step is a partial-aggregated minimum and a join on a node and a hash of its neighbour, so neither a
component nor the neighbours of a node are ever gathered in one task, and the driver sees two numbers a round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traceloom.llm import common


SALTS = 64


def _with(edges: DataFrame, least: DataFrame) -> DataFrame:
    """edges with the value m of their a. The edges of a node are dealt over up to SALTS tasks, and its value is sent
    to those that have some."""
    salted = edges.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(SALTS)))
    return salted.join(salted.select("a", "salt").distinct().join(least, "a"), ["a", "salt"])


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large_star(edges: DataFrame) -> DataFrame:
    """Of each node u: its larger neighbours are tied to the least of u and all its neighbours."""
    near = _both_ways(edges)
    least = near.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return _with(near.where("b > a"), least).select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Of each node u: u and its smaller neighbours are tied to the least of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    tied = _with(down, least).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return tied.unionByName(least.select("a", F.col("m").alias("b")))


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """node, component (its least node) of all nodes that edges (a, b: long) have; nulls and loops are left out."""
    now = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    mark = None
    while True:
        now = common.written(_small_star(_large_star(now)).where("a <> b").distinct(), label)
        seen = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if seen == mark or not seen[0]:
            break
        mark = seen
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
