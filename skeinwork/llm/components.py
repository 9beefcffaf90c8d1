"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinwork.llm._store import Store


def connected_components(links: DataFrame, store: Store, name: str) -> DataFrame:
    """``links(a, b)`` to ``(id, component)``: the smallest id reachable, for every id that has a link.

    Each step keeps the components and draws every node towards its neighbourhood's smallest id; the number of
    steps grows with the logarithm of the longest shortest path. Steps are written to the shared folder. All
    neighbourhood minima are partial aggregations; a hub's links are joined to its minimum by a splittable join.
    """
    edges = store.put(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{name}0")
    seen, step = None, 0
    while True:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least).distinct()
        step += 1
        edges = store.put(small, f"{name}{step}")
        store.drop(f"{name}{step - 1}")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).union(edges.select("b", "b").distinct())
