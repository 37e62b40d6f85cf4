"""The streaming forms against their batch forms."""

import pytest
from pyspark.sql import functions as F

from foldkeep import queries as q
from foldkeep.operators import compact
from foldkeep.operators.fold import fold
from foldkeep.schema import LOG
from foldkeep.sources import log as logs
from foldkeep.streaming.compaction_stream import compact_stream
from foldkeep.streaming.fold_stream import FoldStream, log_source

SF = "/root/testdata/sf0.001"


def rows(element, meta):
    return sorted((r.key, r.type, r.elem or "", r.val) for r in element.collect()), sorted((r.key, r.type, r.abs_ttl_ms, r.cardinality, r.latest_seq) for r in meta.collect())


@pytest.mark.parametrize("every", [2, 16])
def test_fold_stream_equals_fold(spark, tmp_path, every):
    log = q._typed_log(q.events(spark, SF)).select(*[c.split()[0] for c in LOG.split(", ")]).where("seq <> 600")
    flush = log.limit(1).select(*[F.lit("FLUSH").alias("op") if c == "op" else F.lit(600).cast("long").alias("seq") if c == "seq" else F.lit(None).cast("string").alias("key") if c == "key" else F.col(c) for c in log.columns])
    # the first write of a key after the flush makes it anew
    first = log.where("seq > 600").groupBy("key").agg(F.min("seq").alias("_f"))
    log = log.join(first, "key", "left").withColumn("replaces_state", F.col("replaces_state") | F.coalesce((F.col("seq") == F.col("_f")) & (F.col("ord") == 0), F.lit(False))).select(*log.columns).unionByName(flush)
    src = str(tmp_path / "log")
    for a, z in ((0, 300), (300, 700), (700, 1 << 30)):
        log.where(f"seq >= {a} and seq < {z}").coalesce(1).write.mode("append").parquet(src)
    s = FoldStream(spark, str(tmp_path / "state"), every=every)
    run = s.start(log_source(spark, src, files=1), str(tmp_path / "cp"))
    run.awaitTermination()
    assert s.version() == 2
    want = rows(*fold(spark.read.schema(LOG).parquet(src)))
    assert rows(*s.state()) == want
    s.absorb(log, 1)  # a batch that comes again changes nothing
    assert s.version() == 2 and rows(*s.state()) == want
    s.rebase()
    assert s.tail() == [] and rows(*s.state()) == want


def test_compaction_stream_equals_batch(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    e = q.events(spark, SF).where("cast(key as int) < 5").select("key", "seq", "at_ms").withColumn("ts", F.timestamp_millis("at_ms"))
    src = str(tmp_path / "writes")
    half = e.agg(F.percentile_approx("at_ms", 0.5)).first()[0]
    e.where(F.col("at_ms") < half).coalesce(1).write.parquet(src)
    e.where(F.col("at_ms") >= half).coalesce(1).write.mode("append").parquet(src)
    # a last write, far on, lets every timer fall due
    end = e.agg(F.max("at_ms")).first()[0] + 10**10
    spark.createDataFrame([("end", 10**9, end)], "key string, seq long, at_ms long").withColumn("ts", F.timestamp_millis("at_ms")).coalesce(1).write.mode("append").parquet(src)
    quiet, cap = 6 * 3_600_000, 40_000_000
    stream = spark.readStream.schema("key string, seq long, at_ms long, ts timestamp").option("maxFilesPerTrigger", 1).parquet(src)
    run = compact_stream(stream, quiet, cap).writeStream.format("memory").queryName("flushes").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    run.awaitTermination()
    got = sorted((r.key, r.first_seen_ms, r.last_modified_ms, r.writes, r.reason) for r in spark.table("flushes").collect())
    want = sorted((r.key, r.first_seen, r.last_modified, r.writes, r.reason) for r in compact.flushes(e, quiet, cap).collect())
    assert got == want and len(want) > 10


def test_log_table(spark, tmp_path):
    e = q.events(spark, SF).select((F.col("key").cast("long") % 4).cast("int").alias("shard"), F.col("at_ms").alias("appended_at_ms"), F.col("seq").alias("req_id"), F.lit(0).alias("ord"), "key", "val")
    first = logs.numbered(e.where("req_id < 500"))
    names = [c.split()[0] for c in LOG.split(", ")]
    full = lambda d: d.withColumn("op", F.lit("SET")).withColumn("batch", F.col("req_id")).withColumn("elem", F.lit(None).cast("string")).withColumn("score", F.lit(None).cast("double")).withColumn("ttl_ms", F.lit(0).cast("long")).withColumn("replaces_state", F.lit(True)).select(*names)
    path = str(tmp_path / "log")
    logs.append(path, full(first))
    tails = logs.stats(logs.read(spark, path))
    logs.append(path, full(logs.numbered(e.where("req_id >= 500"), tails)))
    log = logs.read(spark, path)
    from foldkeep.operators.fold import gaps

    assert gaps(log).isEmpty() and log.count() == e.count()
    assert logs.read_range(log, 1, 10, 5).count() == 5
    with pytest.raises(ValueError):
        logs.read_range(log, 1, 3, 5, first_seq=4)
    logs.check_topology(spark, path + "-t", 4)
    logs.check_topology(spark, path + "-t", 4)
    with pytest.raises(ValueError):
        logs.check_topology(spark, path + "-t", 8)
