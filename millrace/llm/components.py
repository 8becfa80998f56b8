"""Connected components of edge tables by alternating large-star and small-star steps.

Each step is two aggregations and joins over (u, v) rows; neighbours are never collected, and each round is cut by a
staged table. Rounds grow with the logarithm of the longest path. Vertices with very many edges go by broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import drop, stage

HUBS = 1000


def hub_join(rows: DataFrame, table: DataFrame, on: list[str], weight: str, total: int) -> DataFrame:
    """Inner join of `total` rows with a table that has one row a key and, as `weight`, the number of its rows (kept). Keys with more than total / HUBS rows are at most HUBS, so they are broadcast, and no other key holds more."""
    bound = max(16, total // HUBS)
    large = table.where(F.col(weight) > bound)
    by_hub = rows.join(F.broadcast(large), on)
    rest = rows.join(F.broadcast(large.select(*on)), on, "left_anti").join(table.where(F.col(weight) <= bound), on)
    return by_hub.unionByName(rest)


def _star(edges: DataFrame, total: int) -> DataFrame:
    """One large-star and one small-star step over edges with u > v."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
    large = hub_join(both.where("v > u"), low, ["u"], "n", 2 * total).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
    low = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    small = hub_join(large, low, ["u"], "n", total)
    return small.where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).distinct()


def _open(edges: DataFrame) -> int:
    """How many edges there are if they do not yet form stars around their smallest vertices, else 0."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    by = ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    n, wrong = by.agg(F.sum("up"), F.count(F.when((F.col("up") > 1) | (F.col("up") > 0) & (F.col("down") > 0), 1))).first()
    return n if wrong else 0


def components(edges: DataFrame) -> DataFrame:
    """(vertex, component) for every vertex of the edges (a, b): component is the smallest vertex reachable. Staged."""
    e = edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now = stage(e, "edges", tidy=False)
    while total := _open(now):
        now, before = stage(_star(now, total), "edges", tidy=False), now
        drop(before)
    ends = now.select(F.col("u").alias("vertex"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("vertex"), F.col("v").alias("component"))).distinct()
    out = stage(ends, "components", tidy=False)
    drop(now)
    return out
