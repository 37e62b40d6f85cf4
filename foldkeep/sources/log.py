"""The log as a table: appending, reading, scanning, offsets and retention."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foldkeep.operators.running import running, same
from foldkeep.schema import LOG


def numbered(entries: DataFrame, tails: DataFrame | None = None, order: tuple[str, ...] = ("appended_at_ms", "req_id", "ord")) -> DataFrame:
    """Entries with ``seq``, counted by shard from 1 or from the shard's tail; rows of one ``req_id`` share it.

    The window is by shard: a log of many shards numbers them side by side.
    """
    w = Window.partitionBy("shard").orderBy(*[c for c in order if c != "ord"])
    out = entries.withColumn("_n", F.dense_rank().over(w).cast("bigint"))
    if tails is None:
        return out.withColumnRenamed("_n", "seq")
    t = tails.select("shard", F.col("tail_seq").alias("_tail"))
    return out.join(F.broadcast(t), "shard", "left").withColumn("seq", F.col("_n") + F.coalesce("_tail", F.lit(0))).drop("_n", "_tail")


def append(log_path: str, entries: DataFrame) -> None:
    """Append numbered entries, a folder a shard, sorted by sequence so that file statistics prune range reads."""
    entries.repartition("shard").sortWithinPartitions("shard", "seq", "ord").write.mode("append").partitionBy("shard").parquet(log_path)


def read(spark: SparkSession, log_path: str) -> DataFrame:
    return spark.read.schema(LOG).parquet(log_path)


def read_range(log: DataFrame, shard: int, from_seq: int, count: int, durable_end: int | None = None, first_seq: int = 1) -> DataFrame:
    """Up to ``count`` entries of a shard from ``from_seq`` on, below what is durable. Reading below the first kept sequence is an error."""
    if from_seq < first_seq:
        raise ValueError(f"sequence {from_seq} is no longer kept; the first is {first_seq}")
    rows = log.where((F.col("shard") == shard) & (F.col("seq") >= from_seq) & (F.col("seq") < from_seq + count))
    return rows if durable_end is None else rows.where(F.col("seq") < durable_end)


def whole_batches(log: DataFrame, size: str = "batch_size") -> DataFrame:
    """Entries of batches that are there as a whole (entries without a batch are whole)."""
    here = F.count("*").over(Window.partitionBy("batch"))
    return log.withColumn("_here", here).where(F.col("batch").isNull() | (F.col("_here") == F.col(size))).drop("_here")


def flush_rows(spark: SparkSession, shards: int, at_ms: int) -> DataFrame:
    """One FLUSH entry a shard."""
    cols = {"ord": "0", "batch": "cast(null as bigint)", "appended_at_ms": f"{at_ms}L", "op": "'FLUSH'", "key": "cast(null as string)", "elem": "cast(null as string)", "val": "cast(null as string)", "score": "cast(null as double)", "ttl_ms": "cast(null as bigint)", "replaces_state": "false"}
    return spark.range(shards).selectExpr("cast(id as int) as shard", *[f"{v} as {k}" for k, v in cols.items()])


def stats(log: DataFrame) -> DataFrame:
    """``shard, first_seq, tail_seq, entries, bytes``."""
    n = sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in ("key", "elem", "val")), F.lit(48))
    return log.groupBy("shard").agg(F.min("seq").alias("first_seq"), F.max("seq").alias("tail_seq"), F.count_distinct("seq").alias("entries"), F.sum(n).cast("bigint").alias("bytes"))


def committed(offsets: DataFrame) -> DataFrame:
    """``consumer, shard, seq``: each consumer's highest committed sequence of a shard."""
    return offsets.groupBy("consumer", "shard").agg(F.max("seq").alias("seq"))


def oldest_needed(offsets: DataFrame) -> DataFrame:
    """``shard, seq``: what every consumer of the shard has committed."""
    return committed(offsets).groupBy("shard").agg(F.min("seq").alias("seq"))


def removable(segments: DataFrame, offsets: DataFrame, now_ms: int, min_retention_ms: int) -> DataFrame:
    """Sealed segments that may go, oldest first, up to the first one that may not.

    ``segments`` has a row a segment and shard: ``log, ordinal, sealed_at_ms, shard,
    max_seq``. A segment may go once it is old enough and every shard's
    committed sequence has reached its last one in it.
    """
    s = segments.join(offsets.select("shard", F.col("seq").alias("_done")), "shard", "left")
    ok = s.groupBy("log", "ordinal").agg(
        (F.bool_and(F.coalesce(F.col("_done") >= F.col("max_seq"), F.lit(False))) & (F.max("sealed_at_ms") + min_retention_ms <= now_ms)).alias("free")
    )
    w = Window.partitionBy("log").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return ok.withColumn("_all", F.min(F.col("free").cast("int")).over(w)).where("_all = 1").select("log", "ordinal")


def visible(log: DataFrame, durable: DataFrame) -> DataFrame:
    """Entries below their shard's durable end."""
    return log.join(F.broadcast(durable.select("shard", "durable_end")), "shard").where("seq < durable_end").drop("durable_end")


def admitted(writes: DataFrame, window_bytes: int, window_ms: int) -> DataFrame:
    """Writes with ``admit``: whether the bytes of the shard's last ``window_ms`` fit the durability window."""
    # bytes come in at their instant and go out after the window's last one, so that one running sum serves all windows
    some = F.when(F.col("bytes").isNotNull(), 1).otherwise(0)
    comes = writes.select("shard", F.col("at_ms").isNull().alias("_none"), "at_ms", F.lit(0).alias("_out"), F.coalesce("bytes", F.lit(0)).alias("_b"), some.alias("_c"))
    goes = comes.where("not _none").select("shard", "_none", F.try_add("at_ms", F.lit(window_ms)).alias("at_ms"), F.lit(1).alias("_out"), (-F.col("_b")).alias("_b"), (-F.col("_c")).alias("_c")).where("at_ms is not null")
    by = ["shard", "_none", "at_ms", "_out"]
    moves = comes.groupBy(*by).agg(F.sum("_b").alias("_b"), F.sum("_c").alias("_c")).unionByName(goes.groupBy(*by).agg(F.sum("_b").alias("_b"), F.sum("_c").alias("_c")))
    sums = running(moves, ["shard", "_none"], ["at_ms", "_out"], {"_b": "_bytes", "_c": "_count"}, "sum", "window").where("_out = 0")
    sums = sums.select(F.col("shard").alias("_shard"), F.col("at_ms").alias("_at_ms"), F.when(F.col("_count") > 0, F.col("_bytes")).alias("in_window"))
    both = writes.join(sums, same(writes, sums, ["shard", "at_ms"], "_"), "left").select(*writes.columns, "in_window")
    return both.withColumn("admit", F.col("in_window") <= window_bytes)


def check_topology(spark: SparkSession, path: str, shards: int, logs: int = 1) -> None:
    """Write the number of shards and logs with a new log; refuse to open an old one with other numbers."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_topology")
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(p):
        spark.createDataFrame([(shards, logs)], "shards int, logs int").coalesce(1).write.json(f"{path}/_topology")
        return
    had = spark.read.schema("shards int, logs int").json(f"{path}/_topology").first()
    if (had.shards, had.logs) != (shards, logs):
        raise ValueError(f"the log has {had.shards} shards in {had.logs} logs, not {shards} in {logs}")
