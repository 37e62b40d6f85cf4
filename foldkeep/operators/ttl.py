"""Expiry, eviction and admission."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldkeep.functions.values import is_live


def live(meta: DataFrame, now_ms: int) -> DataFrame:
    return meta.where(is_live(F.col("abs_ttl_ms"), now_ms))


def expired(meta: DataFrame, now_ms: int) -> DataFrame:
    return meta.where(~is_live(F.col("abs_ttl_ms"), now_ms))


def sweep_buckets(meta: DataFrame, now_ms: int, bucket_ms: int = 1000) -> DataFrame:
    """``bucket, n``: the expired keys by the bucket of their expiry."""
    return expired(meta, now_ms).groupBy(F.expr(f"abs_ttl_ms div {int(bucket_ms)}").alias("bucket")).agg(F.count("*").alias("n"))


def compare_and_delete(element: DataFrame, meta: DataFrame, swept: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The state without the keys of ``swept`` (``key, abs_ttl_ms``) whose expiry is still the one that the sweep saw."""
    gone = swept.select("key", "abs_ttl_ms").join(meta.select("key", "abs_ttl_ms"), ["key", "abs_ttl_ms"], "left_semi").select("key")
    return element.join(gone, "key", "left_anti"), meta.join(gone, "key", "left_anti")


def sample_expired(meta: DataFrame, now_ms: int, n: int, seed: int = 0) -> DataFrame:
    """Up to ``n`` keys sampled by a keyed hash, with whether they have expired."""
    return meta.orderBy(F.xxhash64(F.lit(seed), "key"), "key").limit(n).select("key", (~is_live(F.col("abs_ttl_ms"), now_ms)).alias("expired"))


def evictable(hot: DataFrame, now_ms: int, eviction_s: Column, drained_seq: Column) -> DataFrame:
    """Hot keys past their eviction time; ``evict`` if the log behind them is drained, else they are parked."""
    due = F.greatest("linked_ms", "accessed_ms") + eviction_s * 1000 <= now_ms
    return hot.where(due).withColumn("evict", F.col("latest_seq") <= drained_seq)


def over_budget(hot: DataFrame, budget: int, by: str = "shard", bytes_: str = "bytes", accessed: str = "accessed_ms", tie: str = "key") -> DataFrame:
    """The rows that must go so that each shard's most recently used ones fit the budget."""
    w = Window.partitionBy(by).orderBy(F.col(accessed).desc(), F.col(tie)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return hot.withColumn("running", F.sum(bytes_).over(w)).where(F.col("running") > budget)


def byte_size(element: DataFrame, fixed: int = 64) -> DataFrame:
    """``key, bytes``: octets of names and values, and a fixed part an element."""
    n = F.coalesce(F.octet_length("elem"), F.lit(0)) + F.coalesce(F.octet_length("val"), F.lit(0)) + F.when(F.col("score").isNotNull(), 8).otherwise(0) + fixed
    return element.groupBy("key").agg((F.sum(n) + F.first(F.octet_length("key"))).cast("bigint").alias("bytes"))


def stubs(meta: DataFrame, evicted: DataFrame) -> DataFrame:
    """What stays of evicted keys: type, expiry and sequence."""
    return meta.join(evicted.select("key"), "key", "left_semi").select("key", "type", "abs_ttl_ms", "latest_seq")


def without_old_tombstones(state: DataFrame, horizon: Column | int) -> DataFrame:
    return state.where(~(F.col("tombstoned") & (F.col("latest_seq") <= horizon)))


def admitted(accesses: DataFrame, window_ms: int, at_ms: str = "at_ms", order: str = "seq") -> DataFrame:
    """Accesses that are admitted to the cache: the second and later ones of a key within its window (exact, where a sketch could err)."""
    slot = F.expr(f"{at_ms} div {int(window_ms)}")
    w = Window.partitionBy("key", slot).orderBy(at_ms, order)
    return accesses.withColumn("nth", F.row_number().over(w)).where("nth >= 2")


def worker_pass(meta: DataFrame, now_ms: int, horizon: int) -> DataFrame:
    """What one pass of the worker does with each key, in its order: expiry, then tombstones; ``key, action``."""
    action = F.when(~is_live(F.col("abs_ttl_ms"), now_ms), "expire").when(F.coalesce("tombstoned", F.lit(False)) & (F.col("latest_seq") <= horizon), "drop_tombstone").otherwise("keep")
    return meta.select("key", action.alias("action"))


def tier_label(meta: DataFrame, now_ms: int, accessed: str = "accessed_ms", eviction_s: Column | None = None) -> DataFrame:
    """Where a key stands by its two times: gone, hot or cold."""
    hot = F.col(accessed) + (F.lit(86400) if eviction_s is None else eviction_s) * 1000 > now_ms
    return meta.withColumn("tier", F.when(~is_live(F.col("abs_ttl_ms"), now_ms), "gone").when(hot, "hot").otherwise("cold"))


def ewma(series: DataFrame, alpha: float, value: str = "value", by: str = "series", order: str = "at_ms") -> DataFrame:
    """The exponentially weighted mean at the end of each series, by a fold over its values in order."""
    v = F.transform(F.sort_array(F.collect_list(F.struct(order, value))), lambda x: x[value].cast("double"))
    step = lambda a, x: F.when(a.isNull(), x).otherwise(a * (1 - alpha) + x * alpha)
    return series.groupBy(by).agg(F.aggregate(v, F.lit(None).cast("double"), step).alias("ewma"))


def next_rate(rate: float, expired_share: float, cpu: float, low: float = 0.05, high: float = 0.25, most_cpu: float = 0.8, least: float = 1.0, most: float = 10_000.0) -> float:
    """The next rate of a background scan: more while many samples have expired, less when few have or the machine is busy."""
    if cpu > most_cpu or expired_share < low:
        rate /= 2
    elif expired_share > high:
        rate *= 2
    return min(most, max(least, rate))
