"""Connected components of a link table, without ever gathering links or components at the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldkeep.session import materialize


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, root`` for every node of ``links``: the smallest node that it is connected with.

    Alternates the large-star and the small-star step: each node's neighbours
    are linked to the smallest of them, by windows over the node. Rounds grow
    with the logarithm of the longest path; each ends in a written table. A
    node with very many neighbours only hands on their minimum, found by an
    aggregate before the shuffle, and is joined by an equi-join whose large
    partitions Spark splits. Self links and repeated links do no harm.
    """
    edge = links.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).where("hi is not null and lo is not null")
    nodes = edge.select(F.col("hi").alias("node")).union(edge.select("lo")).distinct()
    edge = materialize(edge.where("hi <> lo").distinct(), "links")
    while True:
        both = edge.union(edge.select("lo", "hi")).toDF("u", "v")
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo"))
        large = materialize(large.where("hi <> lo").distinct(), "links-large")
        floor = large.groupBy("hi").agg(F.min("lo").alias("m")).withColumnRenamed("hi", "u")
        # the smaller neighbours of u, and u itself, go to the smallest of them
        star = large.join(floor, F.col("hi") == F.col("u")).select(F.col("lo").alias("v"), "m").union(floor.select("u", "m"))
        small = materialize(star.where("v <> m").distinct().toDF("hi", "lo"), "links-small")
        edge = small
        several = edge.groupBy("hi").agg(F.count("*").alias("n")).where("n > 1").select("hi")
        chained = edge.join(edge.select(F.col("lo").alias("hi")), "hi", "left_semi").select("hi")
        if several.union(chained).isEmpty():
            break  # every node has one smaller node, and that has none: all are stars
    roots = edge.groupBy("hi").agg(F.min("lo").alias("root")).withColumnRenamed("hi", "node")
    return nodes.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"))
