"""Connected components by alternating stars, each step a join and an aggregate, written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sonaria.llm.common import kept


def components(edges: DataFrame) -> DataFrame:
    """(u, root) for every node of the edges (u, v) but the roots: the least node that u is connected with.

    In a large star every node hands its larger neighbours to its least one; in a small star it does so with
    its smaller neighbours and itself. Both keep components together, and in the end all nodes of one hang on
    its least node. A hub, the least node of many, is met in the first join only, whose skewed side the engine
    splits; by its larger end an edge has few neighbours. Only sums come to the driver.
    """
    now = kept(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct(), "edges")
    state = None
    while True:
        r = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(r) == state or not r[0]:
            return now.select("u", F.col("v").alias("root"))
        state = tuple(r)
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).repartition("u")
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(down.select("u", F.col("m").alias("v")))
        now = kept(small.filter("u <> v").distinct(), "edges")
