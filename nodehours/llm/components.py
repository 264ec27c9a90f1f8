"""Connected components of links in a few rounds of grouping and joining."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nodehours.llm.common import Folder


def components(links: DataFrame, a: str, b: str, folder: Folder, name: str = "components") -> DataFrame:
    """node and component (its smallest node) for every node of a link; integer nodes.

    Each round links the larger neighbours of every node to its smallest one, then its smaller neighbours and itself
    to the smallest of them, until nothing changes: stars remain, with the smallest node in the middle. Minima are
    combined before rows move, and a round is a written table, so neither hubs nor lost executors matter.
    """
    edge = lambda df, x, y: df.select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v")).where("u > v").distinct()
    now, was, k = folder.put(edge(links, F.col(a), F.col(b)), f"{name}0"), None, 0
    while True:
        state = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == was:
            break
        was, k = state, k + 1
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), F.least("u", "m").alias("m"))
        large = edge(both.where("v > u").join(least, F.expr("u = c")), F.col("v"), F.col("m"))
        small = large.groupBy(F.col("u").alias("c")).agg(F.min("v").alias("m"))
        near = large.join(small, F.expr("u = c"))
        next_ = edge(near, F.col("v"), F.col("m")).unionByName(small.select(F.col("c").alias("u"), F.col("m").alias("v"))).distinct()
        now = folder.put(next_, f"{name}{k}")
        folder.drop(f"{name}{k - 1}")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
