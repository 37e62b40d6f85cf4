"""Log to state: the last-write-wins fold.

Every step is an aggregate that combines before the shuffle, so a key with very
many writes costs one row a task and element. The last write of an element
doesn't depend on resets (it lies before or after the key's last reset as a
whole), so elements fold by (key, element) first and meet their key's reset
afterwards, in an equi-join of already reduced tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldkeep.schema import ADDS, REMOVES, TYPE_OF_OP
from foldkeep.session import materialize


def is_reset() -> Column:
    """Whether a row alone determines its key: SET, DEL, and writes flagged as replacing."""
    return F.col("op").isin("SET", "DEL") | F.coalesce("replaces_state", F.lit(False))


#: Effects by their code, counted from 1.
OPS = ("SET", "DEL", "FLUSH", "PEXPIREAT", "PERSIST", "SADD", "SREM", "ZADD", "ZREM", "HSET", "HDEL")

#: Most effects of one command; sequences of a shard stay below 2**43, else the product overflows, which is an error.
MOST_EFFECTS = 1 << 20


def at() -> Column:
    """A row's place in its shard as one number, which hash aggregates can hold (a struct would need a sort)."""
    return F.col("seq") * MOST_EFFECTS + F.col("ord")


def code(op: Column | str = "op") -> Column:
    """An effect as a number, for the same reason."""
    return F.array_position(F.array(*[F.lit(o) for o in OPS]), F.col(op) if isinstance(op, str) else op).cast("int")


def op_of(code: Column) -> Column:
    return F.try_element_at(F.array(*[F.lit(o) for o in OPS]), code)


def type_of(op: Column) -> Column:
    out = F
    for name, kind in TYPE_OF_OP.items():
        out = out.when(op == name, kind)
    return out


def after_flush(log: DataFrame) -> DataFrame:
    """The rows above their shard's last flush. The table of floors has a row a shard (16,384 at most) and is broadcast."""
    floor = log.where("op = 'FLUSH'").groupBy("shard").agg(F.max("seq").alias("_floor"))
    return log.where("op <> 'FLUSH'").join(F.broadcast(floor), "shard", "left").where(F.col("_floor").isNull() | (F.col("seq") > F.col("_floor"))).drop("_floor")


def keys_of(log: DataFrame) -> DataFrame:
    """A row a key: its last reset, that reset's effect, its expiry and its last sequence."""
    ttl = (
        F.when(F.col("op").isin("SET", "PEXPIREAT"), F.coalesce("ttl_ms", F.lit(0)))
        .when((F.col("op") == "PERSIST") | is_reset(), F.lit(0).cast("bigint"))
    )
    found = log.groupBy("shard", "key").agg(
        F.max(F.when(is_reset(), F.col("seq"))).alias("reset_seq"),
        F.max_by(code(), F.when(is_reset(), at())).alias("_code"),
        F.max_by(ttl, F.when(ttl.isNotNull(), at())).alias("abs_ttl_ms"),
        F.max("seq").alias("latest_seq"),
    )
    return found.select("shard", "key", "reset_seq", op_of(F.col("_code")).alias("reset_op"), "abs_ttl_ms", "latest_seq")


def elements_of(log: DataFrame) -> DataFrame:
    """A row an element that the log touches: its last effect."""
    rows = log.where(F.col("op").isin("SET", *ADDS, *REMOVES))
    return rows.groupBy("shard", "key", "elem").agg(F.max_by(F.struct("op", "val", "score", "seq"), at()).alias("last")).select("shard", "key", "elem", "last.*")


def fold(log: DataFrame, written: bool = False) -> tuple[DataFrame, DataFrame]:
    """``(element, meta)`` of a log; ``written`` folds once into a table of the shared folder, from which both are read.

    A key without a reset in the log is not held (it may be merged over a base,
    see ``merge``); an emptied collection doesn't exist; expiry isn't judged
    here, as the log holds an explicit DEL wherever it was.
    """
    log = after_flush(log)
    keys = keys_of(log).where("reset_seq is not null and reset_op <> 'DEL'").withColumn("type", type_of(F.col("reset_op")))
    live = (
        elements_of(log).withColumnRenamed("seq", "elem_seq")
        .join(keys, ["shard", "key"])
        .where((F.col("elem_seq") >= F.col("reset_seq")) & ~F.col("op").isin(*REMOVES) & (type_of(F.col("op")) == F.col("type")))
    )
    if written:
        live = materialize(live.select("shard", "key", "type", "elem", "val", "score", "abs_ttl_ms", "latest_seq"), "state")
    element = live.select("shard", "key", "type", "elem", "val", "score")
    meta = live.groupBy("shard", "key").agg(
        F.first("type").alias("type"), F.first("abs_ttl_ms").alias("abs_ttl_ms"), F.count("*").alias("cardinality"), F.first("latest_seq").alias("latest_seq")
    )
    return element, meta


def packed(element: DataFrame, meta: DataFrame) -> DataFrame:
    """One row a key with its value as a whole: ``str``, ``members``, ``fields``, ``scored`` (one of them not null).

    A value is gathered in one row, so use it for values that fit one.
    """
    values = element.groupBy("shard", "key").agg(
        F.max(F.when(F.col("type") == "string", F.col("val"))).alias("str"),
        F.sort_array(F.collect_list(F.when(F.col("type") == "set", F.col("elem")))).alias("members"),
        F.map_from_entries(F.collect_list(F.when(F.col("type") == "hash", F.struct("elem", "val")))).alias("fields"),
        F.sort_array(F.collect_list(F.when(F.col("type") == "zset", F.struct("score", "elem")))).alias("scored"),
    )
    only = lambda c, kind: F.when(F.col("type") == kind, F.col(c)).alias(c)
    return meta.join(values, ["shard", "key"]).select(*meta.columns, "str", only("members", "set"), only("fields", "hash"), only("scored", "zset"))


def log_clock(requests: DataFrame, at_ms: str = "at_ms", order: tuple[str, ...] = ("req_id",)) -> DataFrame:
    """``requests`` with ``clock_ms``: the latest instant that the shard has seen so far, so time never runs back."""
    seen = Window.partitionBy("shard").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return requests.withColumn("clock_ms", F.max(at_ms).over(seen))


def gaps(log: DataFrame) -> DataFrame:
    """``shard, seq, before``: where sequences of a shard don't follow each other, or run back within an order of arrival."""
    seqs = log.select("shard", "seq").distinct()
    w = Window.partitionBy("shard").orderBy("seq")
    return seqs.withColumn("before", F.lag("seq").over(w)).where("before is not null and seq <> before + 1")


def misplaced(log: DataFrame, shards: int) -> DataFrame:
    """Rows whose key doesn't belong to their shard."""
    from foldkeep.functions.routing import shard

    return log.where("op <> 'FLUSH'").where(F.col("shard") != shard(F.col("key"), shards))
