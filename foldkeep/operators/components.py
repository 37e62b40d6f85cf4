"""Groups of keys that commands tie together, by repeated minimum labels, without gathering them at the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldkeep.session import materialize


def key_groups(pairs: DataFrame) -> DataFrame:
    """``key, group`` for the keys of ``pairs`` (``a, b``): the smallest key that each is tied to.

    Each round takes the smallest label among a key's neighbours and then the
    label of that label, so the rounds grow with the logarithm of the longest
    chain in most graphs; every round is a written table.
    """
    both = materialize(pairs.union(pairs.select("b", "a")).toDF("key", "near").where("key <> near").distinct(), "key-pairs")
    label = materialize(pairs.select(F.col("a").alias("key")).union(pairs.select("b")).distinct().withColumn("group", F.col("key")), "key-groups")
    while True:
        near = both.join(label.select(F.col("key").alias("near"), F.col("group").alias("_g")), "near").groupBy("key").agg(F.min("_g").alias("_near"))
        step = label.join(near, "key", "left").select("key", "group", F.least("group", F.coalesce("_near", "group")).alias("_next"))
        jump = step.join(step.select(F.col("key").alias("_next"), F.col("_next").alias("_far")), "_next", "left")
        after = materialize(jump.select("key", F.col("group").alias("_was"), F.least("_next", F.coalesce("_far", "_next")).alias("group")), "key-groups")
        label = after.select("key", "group")
        if after.where("_was <> group").isEmpty():
            return label
