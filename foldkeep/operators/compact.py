"""Compaction of many writes into one delta a key, and the schedule of flushes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldkeep.operators.fold import after_flush, at, code, elements_of, is_reset, keys_of, op_of, type_of
from foldkeep.schema import ADDS, REMOVES


def deltas(log: DataFrame) -> DataFrame:
    """One row a key of the log (schema ``DELTA``): what the writes come to, to be merged over a base.

    ``delete_all`` says that the base no longer counts; ``tombstone`` that the
    key ends deleted. The last effect of an element wins, so an addition and a
    removal cancel. Effects of another type than the last reset's are ignored.
    ``ttl_intent`` is set, cleared or unchanged. An element list is gathered a
    key, as in the delta's own form.
    """
    log = after_flush(log)
    timed, typed = F.when(F.col("op").isin("PEXPIREAT", "PERSIST", "SET") | is_reset(), at()), F.when(type_of(F.col("op")).isNotNull(), at())
    touched = log.groupBy("shard", "key").agg(
        F.max_by(code(), timed).alias("_ttl_code"), F.max_by(F.coalesce("ttl_ms", F.lit(0)), timed).alias("_ttl_ms"),
        F.min("seq").alias("first_seq"), F.count_distinct("seq").alias("write_count"), F.max_by(code(), typed).alias("_type_code"),
    ).withColumn("last_type", type_of(op_of(F.col("_type_code"))))
    keys = keys_of(log).join(touched, ["shard", "key"])
    kind = F.when(F.col("reset_op").isNotNull() & (F.col("reset_op") != "DEL"), type_of(F.col("reset_op"))).otherwise(F.col("last_type"))
    keys = keys.withColumn("type", kind)
    e = elements_of(log).withColumnRenamed("seq", "elem_seq").join(keys.select("shard", "key", "reset_seq", "type"), ["shard", "key"])
    e = e.where((F.col("reset_seq").isNull() | (F.col("elem_seq") >= F.col("reset_seq"))) & (type_of(F.col("op")) == F.col("type")))
    add = F.col("op").isin("SET", *ADDS)
    lists = e.groupBy("shard", "key").agg(
        F.sort_array(F.collect_list(F.when(add, F.struct("elem", "val", "score")))).alias("adds"),
        F.sort_array(F.collect_list(F.when(F.col("op").isin(*REMOVES), F.col("elem")))).alias("removes"),
    )
    out = keys.join(lists, ["shard", "key"], "left")
    adds = F.coalesce("adds", F.expr("cast(array() as array<struct<elem:string,val:string,score:double>>)"))
    removes = F.coalesce("removes", F.expr("cast(array() as array<string>)"))
    op, ms = op_of(F.col("_ttl_code")), F.coalesce("_ttl_ms", F.lit(0))
    intent = F.when(F.col("_ttl_code").isNull(), "unchanged").when(op.isin("PEXPIREAT", "SET") & (ms > 0), "set").otherwise("cleared")
    return out.select(
        "shard", "key", "type",
        ((F.col("reset_op") == "DEL") & (F.size(adds) == 0)).alias("tombstone"), F.col("reset_seq").isNotNull().alias("delete_all"), intent.alias("ttl_intent"),
        F.when(intent == "set", ms).otherwise(F.lit(0)).cast("bigint").alias("abs_ttl_ms"), adds.alias("adds"),
        F.when(F.col("reset_seq").isNull(), removes).otherwise(F.expr("cast(array() as array<string>)")).alias("removes"),
        "first_seq", F.col("latest_seq").alias("last_seq"), "write_count",
    ).withColumn("tombstone", F.coalesce("tombstone", F.lit(False)))


def emitted(delta: DataFrame) -> DataFrame:
    """The writes of a delta in their fixed order: ``key, ord, op, elem, val, score, ttl_ms``.

    DEL first where the base no longer counts (a SET needs none), additions,
    removals, then exactly one write of the expiry; a string carries its expiry
    itself, and a tombstone ends with its DEL.
    """
    row = lambda op, elem="null", val="null", score="null", ttl="null": f"named_struct('op', {op}, 'elem', {elem}, 'val', {val}, 'score', cast({score} as double), 'ttl_ms', cast({ttl} as bigint))"
    none = "cast(array() as array<struct<op:string,elem:string,val:string,score:double,ttl_ms:bigint>>)"
    verb = "case type when 'set' then 'SADD' when 'zset' then 'ZADD' when 'hash' then 'HSET' else 'SET' end"
    undo = "case type when 'set' then 'SREM' when 'zset' then 'ZREM' else 'HDEL' end"
    first = f"case when tombstone or (delete_all and type <> 'string') then array({row(chr(39) + 'DEL' + chr(39))}) else {none} end"
    adds = f"transform(adds, x -> {row(verb, 'x.elem', 'x.val', 'x.score', 'case when type = ' + repr('string') + ' then abs_ttl_ms end')})"
    removes = f"transform(removes, x -> {row(undo, 'x')})"
    ttl = f"case when tombstone or (type = 'string' and size(adds) > 0) or ttl_intent = 'unchanged' then {none} when ttl_intent = 'set' then array({row(chr(39) + 'PEXPIREAT' + chr(39), ttl='abs_ttl_ms')}) else array({row(chr(39) + 'PERSIST' + chr(39))}) end"
    body = F.expr(f"concat({first}, case when tombstone then {none} else concat({adds}, {removes}) end, {ttl})")
    return delta.select("key", F.posexplode(body).alias("ord", "w")).select("key", "ord", "w.*")


def expired_as_deletes(delta: DataFrame, now_ms: int) -> DataFrame:
    """Deltas at an instant: those whose key has expired by then are flushed as its deletion, whatever they hold."""
    gone = (F.col("ttl_intent") == "set") & (F.col("abs_ttl_ms") <= now_ms)
    empty = lambda c: F.when(gone, F.slice(c, 1, 0)).otherwise(F.col(c)).alias(c)
    new = {"tombstone": (F.col("tombstone") | gone).alias("tombstone"), "delete_all": (F.col("delete_all") | gone).alias("delete_all"), "adds": empty("adds"), "removes": empty("removes")}
    return delta.select(*[new.get(c, F.col(c)) for c in delta.columns])


def flush_at(first_seen_ms: Column, last_modified_ms: Column, eviction_s: Column, quiet_s: int, safety_s: int) -> Column:
    """``struct(at_ms, reason)`` of a buffered key's next flush: quiet for long enough, or just before its eviction."""
    quiet = last_modified_ms + quiet_s * 1000
    deadline = first_seen_ms + (eviction_s - safety_s) * 1000
    return F.struct(F.least(quiet, deadline).cast("bigint").alias("at_ms"), F.when(quiet <= deadline, "quiet").otherwise("deadline").alias("reason"))


def max_jitter_ms(quiet_s: int, fraction: float = 0.1) -> int:
    return int(quiet_s * 1000 * fraction)


def sessions(writes: DataFrame, quiet_ms: int, at_ms: str = "at_ms", order: str = "seq") -> DataFrame:
    """Runs of a key's writes that no quiet time parts: ``key, session, first_seen, last_modified, writes``."""
    w = Window.partitionBy("key").orderBy(at_ms, order)
    new = F.coalesce(F.col(at_ms) - F.lag(at_ms).over(w) >= quiet_ms, F.lit(True))
    s = writes.withColumn("session", F.sum(new.cast("bigint")).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return s.groupBy("key", "session").agg(F.min(at_ms).alias("first_seen"), F.max(at_ms).alias("last_modified"), F.count("*").alias("writes"))


def flushes(writes: DataFrame, quiet_ms: int, cap_ms: int, at_ms: str = "at_ms", order: str = "seq") -> DataFrame:
    """Flushes of buffered keys: a session ends when it is quiet for ``quiet_ms``, or ``cap_ms`` after its first write.

    ``key, first_seen, last_modified, writes, flush_at, reason``. A session is cut at
    its caps by a fold over its instants, so one key's session is one array.
    """
    w = Window.partitionBy("key").orderBy(at_ms, order)
    new = F.coalesce(F.col(at_ms) - F.lag(at_ms).over(w) >= quiet_ms, F.lit(True))
    s = writes.withColumn("session", F.sum(new.cast("bigint")).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    times = s.groupBy("key", "session").agg(F.sort_array(F.collect_list(F.col(at_ms).cast("bigint"))).alias("t"))
    kind = "array<struct<a:bigint,z:bigint,n:bigint>>"
    cut = F.expr(f"""aggregate(t, cast(array() as {kind}), (acc, x) -> case
        when size(acc) > 0 and x < element_at(acc, -1).a + {int(cap_ms)}
        then concat(slice(acc, 1, size(acc) - 1), array(named_struct('a', element_at(acc, -1).a, 'z', x, 'n', element_at(acc, -1).n + 1)))
        else concat(acc, array(named_struct('a', x, 'z', x, 'n', 1L))) end)""")
    parts = times.select("key", F.explode(cut).alias("p")).select("key", F.col("p.a").alias("first_seen"), F.col("p.z").alias("last_modified"), F.col("p.n").alias("writes"))
    quiet, cap = F.col("last_modified") + quiet_ms, F.col("first_seen") + cap_ms
    return parts.withColumn("flush_at", F.least(quiet, cap)).withColumn("reason", F.when(quiet <= cap, "quiet").otherwise("deadline"))


def buffer_clock(pending: DataFrame, absorbed: DataFrame) -> DataFrame:
    """``shard, clock_ms``: the oldest pending write's instant, or the newest absorbed one where nothing is pending."""
    a = absorbed.groupBy("shard").agg(F.max("at_ms").alias("_max"))
    p = pending.groupBy("shard").agg(F.min("at_ms").alias("_min"))
    return a.join(p, "shard", "left").select("shard", F.coalesce("_min", "_max").alias("clock_ms"))


def commit_frontier(drained: Column, oldest_unflushed: Column, poison: Column, checkpointed: Column, durable: Column) -> Column:
    """The sequence up to which a shard's work is done (nulls set no bound)."""
    return F.least(drained, oldest_unflushed - 1, poison - 1, checkpointed, durable - 1)


def quarantine(log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows that can be absorbed, and those that can't: unknown effects and effects without what they need."""
    known = F.col("op").isin("SET", "DEL", "FLUSH", "PEXPIREAT", "PERSIST", *ADDS, *REMOVES)
    needs = (
        F.when(F.col("op").isin(*ADDS, *REMOVES) & F.col("elem").isNull(), False)
        .when((F.col("op") == "ZADD") & (F.col("score").isNull() | F.isnan("score")), False)
        .when((F.col("op") == "PEXPIREAT") & F.col("ttl_ms").isNull(), False)
        .when((F.col("op") != "FLUSH") & F.col("key").isNull(), False)
        .otherwise(True)
    )
    good = F.coalesce(known & needs, F.lit(False))
    return log.where(good), log.where(~good)
