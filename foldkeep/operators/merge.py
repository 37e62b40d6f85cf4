"""Merging deltas over a base, and reads over tiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ttl_after(intent: Column, delta_ms: Column, base_ms: Column) -> Column:
    """The expiry after a delta: set, cleared, or the base's."""
    return F.when(intent == "set", delta_ms).when(intent == "cleared", F.lit(0)).otherwise(F.coalesce(base_ms, F.lit(0))).cast("bigint")


def merge(element: DataFrame, meta: DataFrame, delta: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The state after deltas (schema ``DELTA``) over a base.

    A delta with ``delete_all`` needs no base, nor does one of another type than
    the base's (its key's elements of other types go). Keys without elements
    are gone. Untouched keys pass through one anti-join. New keys lie in their
    delta's shard. Deltas are read several times, so hand in a written table.
    """
    d = delta.select("shard", "key", F.col("type").alias("_t"), "tombstone", "delete_all", "ttl_intent", F.col("abs_ttl_ms").alias("_ttl"), "adds", "removes", "last_seq")
    rules = d.select("key", "_t", (F.col("tombstone") | F.col("delete_all")).alias("_all"))
    adds = d.where("not tombstone").select("shard", "key", F.col("_t").alias("type"), F.explode("adds").alias("a")).select("shard", "key", "type", "a.*")
    removes = d.select("key", F.explode("removes").alias("elem"))
    # a string has one element, without a name
    named = lambda c: F.coalesce(c, F.lit(""))
    dropped = removes.union(adds.select("key", named(F.col("elem")).alias("elem"))).select("key", F.col("elem").alias("_elem"), F.lit(True).alias("_gone"))
    base = element.join(rules, "key", "left").where("_all is null or (not _all and type = _t)").drop("_t", "_all")
    base = base.withColumn("_elem", named(F.col("elem"))).join(dropped.distinct(), ["key", "_elem"], "left_anti").drop("_elem")
    out = base.select("shard", "key", "type", "elem", "val", "score").unionByName(adds.select("shard", "key", "type", "elem", "val", "score"))
    kept = meta.select("key", F.col("abs_ttl_ms").alias("_base"), F.col("latest_seq").alias("_seq"), F.col("type").alias("_bt"))
    ttl = d.join(kept, "key", "full_outer").select(
        "key",
        ttl_after(F.col("ttl_intent"), F.col("_ttl"), F.when(F.coalesce("delete_all", F.lit(False)) | (F.col("_bt") != F.col("_t")), F.lit(0)).otherwise(F.col("_base"))).alias("abs_ttl_ms"),
        F.greatest("last_seq", "_seq").alias("latest_seq"),
    )
    count = out.groupBy("shard", "key").agg(F.first("type").alias("type"), F.count("*").alias("cardinality"))
    return out, count.join(ttl, "key").select("shard", "key", "type", "abs_ttl_ms", "cardinality", "latest_seq")


def merged_meta(meta: DataFrame, delta: DataFrame) -> DataFrame:
    """Type and expiry of every key after deltas, without looking at elements: ``key, type, abs_ttl_ms``."""
    d = delta.select("key", F.col("type").alias("_t"), "tombstone", "delete_all", "ttl_intent", F.col("abs_ttl_ms").alias("_ttl"))
    m = meta.join(d, "key", "full_outer").where("tombstone is null or not tombstone")
    base = F.when(F.coalesce("delete_all", F.lit(False)), F.lit(0)).otherwise(F.col("abs_ttl_ms"))
    return m.select("key", F.coalesce("_t", "type").alias("type"), ttl_after(F.col("ttl_intent"), F.col("_ttl"), base).alias("abs_ttl_ms"))


def needs_base(delta: DataFrame) -> DataFrame:
    """The keys whose delta says not everything itself."""
    return delta.where("not delete_all and not tombstone").select("key")


def cardinality(element: DataFrame, meta: DataFrame, delta: DataFrame) -> DataFrame:
    """``key, n`` after deltas: the base's count, and what additions and removals change, without gathering elements."""
    names = element.select("key", "elem")
    d = delta.where("not tombstone")
    add = d.select("key", F.explode("adds.elem").alias("elem"))
    gone = d.select("key", F.explode("removes").alias("elem"))
    kept = d.where("not delete_all").select("key")
    new = add.join(names.join(kept, "key", "left_semi"), ["key", "elem"], "left_anti").groupBy("key").agg(F.count("*").alias("_new"))
    less = gone.join(names, ["key", "elem"], "left_semi").groupBy("key").agg(F.count("*").alias("_less"))
    base = meta.select("key", "cardinality").join(delta.select("key", F.col("tombstone").alias("_dead"), F.col("delete_all").alias("_all")), "key", "full_outer").join(new, "key", "left").join(less, "key", "left")
    n = F.when(F.coalesce("_all", F.lit(False)), F.lit(0)).otherwise(F.coalesce("cardinality", F.lit(0))) + F.coalesce("_new", F.lit(0)) - F.coalesce("_less", F.lit(0))
    return base.where("_dead is null or not _dead").select("key", n.alias("n")).where("n > 0")


def member_reads(element: DataFrame, delta: DataFrame, reqs: DataFrame) -> DataFrame:
    """``req_id, pos, val`` of ``key, elem`` requests over delta and base: the delta's answer first."""
    d = delta.select("key", F.col("delete_all").alias("_all"), F.col("tombstone").alias("_dead"))
    add = delta.where("not tombstone").select("key", F.explode("adds").alias("a")).select("key", "a.elem", F.col("a.val").alias("_new"), F.lit(True).alias("_hit"))
    gone = delta.select("key", F.explode("removes").alias("elem")).withColumn("_gone", F.lit(True))
    r = reqs.join(d, "key", "left").join(add, ["key", "elem"], "left").join(gone, ["key", "elem"], "left").join(element.select("key", "elem", F.col("val").alias("_old")), ["key", "elem"], "left")
    hidden = F.coalesce("_all", F.lit(False)) | F.coalesce("_dead", F.lit(False)) | F.coalesce("_gone", F.lit(False))
    return r.select("req_id", "pos", F.when(F.coalesce("_hit", F.lit(False)), F.col("_new")).when(~hidden, F.col("_old")).alias("val"))


def tiered(tiers: list[DataFrame], by: str = "key", value: str = "val") -> DataFrame:
    """The value of the first tier that holds each key, and its number: ``key, val, tier``. One aggregate, no chain of joins."""
    each = [t.select(by, F.col(value).alias("val"), F.lit(i).alias("tier")) for i, t in enumerate(tiers)]
    rows = each[0]
    for t in each[1:]:
        rows = rows.unionByName(t)
    return rows.groupBy(by).agg(F.min_by("val", "tier").alias("val"), F.min("tier").alias("tier"))


def tier_hits(reqs: DataFrame, tiers: list[DataFrame], names: list[str], by: str = "key") -> DataFrame:
    """``tier, n``: how many requests each tier answers; the rest are misses."""
    held = tiered([t.select(by, F.lit(1).alias("val")) for t in tiers], by)
    label = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("tier") + 1)
    return reqs.join(held, by, "left").groupBy(F.when(F.col("tier").isNull(), "miss").otherwise(label).alias("tier")).agg(F.count("*").alias("n"))
