"""Connected components of a link table, by contraction with Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import discard, written


def components(links: DataFrame) -> DataFrame:
    """``links(a, b)`` -> ``(node, component)``, component the smallest node.

    Each round hooks every node to the neighbour that comes first in a fixed
    pseudo-random order, jumps once over the hooks, renames the links'
    ends and drops those that became loops. The order is random, so a constant
    share of the nodes goes in each round whatever the graph's shape, and the
    loop ends when no link is left. Tables are cut from their lineage by a
    write to the shared folder; nothing but a row count reaches the driver.
    A null end and a loop link nothing. No links: no rows.
    """
    order = lambda c: F.struct(F.xxhash64(c).alias("h"), c.alias("id"))
    edges = written(
        links.select("a", "b").where("a <> b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")).where("a <> b")).distinct()
    )
    names = written(edges.select(F.col("a").alias("node")).distinct().withColumn("now", F.col("node")))
    while not edges.isEmpty():
        hook = written(
            edges.groupBy("a").agg(F.min(order(F.col("b"))).alias("m"))
            .select(F.col("a").alias("id"), F.least(F.col("m"), order(F.col("a")))["id"].alias("to"))
        )
        above = hook.select(F.col("id").alias("to"), F.col("to").alias("top"))
        jump = written(hook.join(above, "to", "left").select("id", F.coalesce("top", "to").alias("to")))
        renamed = edges.join(jump.select(F.col("id").alias("a"), F.col("to").alias("x")), "a").join(
            jump.select(F.col("id").alias("b"), F.col("to").alias("y")), "b"
        )
        left = written(renamed.where("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct())
        named = written(
            names.join(jump.select(F.col("id").alias("now"), "to"), "now", "left").select("node", F.coalesce("to", "now").alias("now"))
        )
        for old in (edges, names, hook, jump):
            discard(old)
        edges, names = left, named
    least = names.groupBy("now").agg(F.min("node").alias("component"))
    return written(names.join(least, "now").select("node", "component"))
