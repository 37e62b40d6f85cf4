"""Writes in closed form, where the order of a stream decides by itself.

Each takes a stream with one row a write, ``key``, the arguments, and ``seq``
(unique by key), within one epoch of the key (no reset by another kind of
write); the general case is ``decide``. Windows are by key or element.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _before(*by: str) -> Window:
    return Window.partitionBy(*by).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)


def set_last(stream: DataFrame, by: tuple[str, ...] = ("key",)) -> DataFrame:
    """Plain SET, HSET, ZADD: the last write wins. Combines before the shuffle."""
    values = [c for c in stream.columns if c not in (*by, "seq")]
    return stream.groupBy(*by).agg(F.max_by(F.struct(*values), "seq").alias("_v"), F.max("seq").alias("seq")).select(*by, "_v.*", "seq")


def set_if_absent(stream: DataFrame, by: tuple[str, ...] = ("key",)) -> DataFrame:
    """SET NX, SETNX, HSETNX, ZADD NX: the first write wins."""
    values = [c for c in stream.columns if c not in (*by, "seq")]
    return stream.groupBy(*by).agg(F.min_by(F.struct(*values), "seq").alias("_v"), F.min("seq").alias("seq")).select(*by, "_v.*", "seq")


def set_if_absent_replies(stream: DataFrame, by: tuple[str, ...] = ("key",)) -> DataFrame:
    """1 for the first write, 0 for those that found one."""
    return stream.withColumn("reply", (F.row_number().over(Window.partitionBy(*by).orderBy("seq")) == 1).cast("bigint"))


def set_if_present(stream: DataFrame, creates: Column, by: tuple[str, ...] = ("key",)) -> DataFrame:
    """SET XX, ZADD XX in a stream where ``creates`` marks the unconditional writes: those before the first of these do nothing."""
    first = F.min(F.when(creates, F.col("seq"))).over(Window.partitionBy(*by))
    return set_last(stream.withColumn("_first", first).where(F.col("seq") >= F.col("_first")).drop("_first"), by)


def set_get(stream: DataFrame, val: str = "val") -> DataFrame:
    """SET GET: each write with the value that it replaced."""
    return stream.withColumn("old", F.lag(val).over(Window.partitionBy("key").orderBy("seq")))


def set_keepttl(stream: DataFrame, sets_ttl: Column, ttl: str = "ttl_ms") -> DataFrame:
    """SET KEEPTTL: rows where ``sets_ttl`` is false carry the last expiry set before them (0: none)."""
    w = Window.partitionBy("key").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return stream.withColumn(ttl, F.coalesce(F.last(F.when(sets_ttl, F.col(ttl)), ignorenulls=True).over(w), F.lit(0).cast("bigint")))


def mset_rows(stream: DataFrame) -> DataFrame:
    """MSET: a row a pair of ``pairs`` (array of key and val), with ``batch`` and ``ord``; a repeated key's last pair wins by ``ord``."""
    return stream.select(F.col("seq").alias("batch"), F.posexplode("pairs").alias("ord", "_p")).select("batch", "ord", "_p.key", "_p.val")


def msetnx(batches: DataFrame, held: DataFrame) -> DataFrame:
    """MSETNX of batches ``batch, key, val`` that share no keys with each other, on held ``key``s: ``batch, reply``."""
    hit = batches.join(held.select("key", F.lit(True).alias("_held")), "key", "left")
    return hit.groupBy("batch").agg(F.when(F.bool_or(F.coalesce("_held", F.lit(False))), F.lit(0)).otherwise(F.lit(1)).cast("bigint").alias("reply"))


def delete(state: DataFrame, keys: DataFrame) -> DataFrame:
    """DEL, UNLINK: the state without the keys."""
    return state.join(keys.select("key").distinct(), "key", "left_anti")


def deleted(state: DataFrame, reqs: DataFrame) -> DataFrame:
    """Replies of DEL for requests with ``keys``: each live key counts once."""
    each = reqs.select("req_id", F.explode("keys").alias("key")).distinct().join(state.select("key", F.lit(1).alias("_one")).distinct(), "key", "left")
    return each.groupBy("req_id").agg(F.count("_one").alias("n"))


def sadd(state: DataFrame, adds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """SADD of ``key, elem`` (repeats allowed): the new state, and the number of new members by key."""
    new = adds.select("key", "elem").distinct().join(state, ["key", "elem"], "left_anti")
    return state.unionByName(new), new.groupBy("key").agg(F.count("*").alias("added"))


def remove(state: DataFrame, removes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """SREM, ZREM, HDEL: the new state (an emptied collection is gone with its rows), and the number removed by key."""
    gone = removes.select("key", "elem").distinct()
    return state.join(gone, ["key", "elem"], "left_anti"), state.join(gone, ["key", "elem"], "left_semi").groupBy("key").agg(F.count("*").alias("removed"))


def zadd(stream: DataFrame, rule: str = "", creates: Column | None = None) -> DataFrame:
    """ZADD over ``key, elem, score, seq`` under one rule ('', NX, XX, GT, LT): each row with ``before``, ``after``, ``added`` and ``changed``.

    GT and LT keep the running maximum and minimum; an equal score is no
    change. NaN scores are refused and have no effect. XX needs ``creates``, the
    rows that may create a member.
    """
    s = stream.where(~F.isnan("score"))
    by = _before("key", "elem")
    if rule == "GT":
        before = F.max("score").over(by)
        after = F.greatest("score", before)
    elif rule == "LT":
        before = F.min("score").over(by)
        after = F.least("score", before)
    elif rule == "NX":
        before = F.first("score").over(by)
        after = F.coalesce(before, F.col("score"))
    elif rule == "XX":
        if creates is None:
            raise ValueError("XX needs the rows that create members")
        made = F.max(creates.cast("int")).over(Window.partitionBy("key", "elem").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)) == 1
        s = s.withColumn("_s", F.when(made, F.col("score")))
        before = F.last("_s", ignorenulls=True).over(by)
        after = F.coalesce(F.col("_s"), before)
    elif not rule:
        before = F.last("score").over(by)
        after = F.col("score")
    else:
        raise ValueError(f"no rule {rule}")
    out = s.withColumn("before", before).withColumn("after", after)
    added = F.col("before").isNull() & F.col("after").isNotNull()
    changed = F.col("before").isNotNull() & (F.col("after") != F.col("before"))
    return out.withColumn("added", added.cast("bigint")).withColumn("changed", changed.cast("bigint")).drop("_s")


def expire(stream: DataFrame, rule: str) -> DataFrame:
    """EXPIRE over ``key, ttl_ms, seq`` under GT, LT, NX or XX from keys without expiry, which is endless: rows with ``before, after, reply``.

    So GT never sets a first one, LT sets it always; NX keeps the first, XX sets none.
    """
    by = _before("key")
    if rule == "LT":
        before, after = F.min("ttl_ms").over(by), F.least("ttl_ms", F.min("ttl_ms").over(by))
    elif rule in ("GT", "XX"):
        before = after = F.lit(None).cast("bigint")
    elif rule == "NX":
        before = F.first("ttl_ms").over(by)
        after = F.coalesce(before, F.col("ttl_ms"))
    elif not rule:
        before, after = F.lag("ttl_ms").over(Window.partitionBy("key").orderBy("seq")), F.col("ttl_ms")
    else:
        raise ValueError(f"no rule {rule}")
    out = stream.withColumn("before", before).withColumn("after", after)
    done = F.lit(False) if rule in ("GT", "XX") else F.lit(True) if not rule else ~F.col("after").eqNullSafe(F.col("before"))
    return out.withColumn("reply", done.cast("bigint"))


def expire_from(stream: DataFrame, rule: str, start: str = "start_ms") -> DataFrame:
    """EXPIRE GT or LT where each key begins with the expiry ``start_ms`` (0: none): the key's last expiry and the number of writes that took effect."""
    by = _before("key")
    endless = float("inf")
    first = F.when(F.col(start) == 0, F.lit(endless)).otherwise(F.col(start).cast("double"))
    t = F.col("ttl_ms").cast("double")
    if rule == "GT":
        before = F.greatest(first, F.max(t).over(by))
        took = t > before
        last = F.max(F.greatest(first, t))
    else:
        before = F.least(first, F.min(t).over(by))
        took = t < before
        last = F.min(F.least(first, t))
    out = stream.withColumn("_took", took)
    end = last.alias("_end")
    return out.groupBy("key").agg(end, F.sum(F.col("_took").cast("bigint")).alias("took")).select("key", F.when(F.col("_end") == endless, F.lit(0)).otherwise(F.col("_end")).cast("bigint").alias("ttl_ms"), "took")


def persist(meta: DataFrame, keys: DataFrame) -> DataFrame:
    """PERSIST: ``key, reply``, 1 where the key had an expiry."""
    m = meta.select("key", "abs_ttl_ms")
    return keys.join(m, "key", "left").select("key", (F.coalesce("abs_ttl_ms", F.lit(0)) > 0).cast("bigint").alias("reply"))


def copy(element: DataFrame, meta: DataFrame, pairs: DataFrame, replace: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """COPY of ``src, dst`` pairs of different keys: new elements, new metadata, and ``src, dst, reply``.

    The value goes with its expiry; a dst that is held is replaced or refuses.
    """
    m = meta.select("key", "type")
    p = pairs.join(m.select(F.col("key").alias("src"), F.lit(True).alias("_s")), "src", "left").join(m.select(F.col("key").alias("dst"), F.lit(True).alias("_d")), "dst", "left")
    done = F.coalesce("_s", F.lit(False)) & (F.lit(replace) | F.col("_d").isNull())
    p = p.select("src", "dst", done.cast("bigint").alias("reply"))
    own = p.where("reply = 1")
    move = lambda df: df.join(own.select(F.col("src").alias("key"), "dst"), "key").withColumn("key", F.col("dst")).drop("dst").select(df.columns)
    rest = lambda df: df.join(own.select(F.col("dst").alias("key")), "key", "left_anti").select(df.columns)
    return rest(element).unionByName(move(element)), rest(meta).unionByName(move(meta)), p


def renamenx(element: DataFrame, meta: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """RENAMENX: as COPY without replacing, and the source is gone; a missing source is an error (reply null)."""
    e, m, p = copy(element, meta, pairs)
    gone = p.where("reply = 1").select(F.col("src").alias("key"))
    p = p.join(meta.select(F.col("key").alias("src"), F.lit(True).alias("_s")), "src", "left").select("src", "dst", F.when(F.col("_s").isNotNull(), F.col("reply")).alias("reply"))
    return e.join(gone, "key", "left_anti").select(e.columns), m.join(gone, "key", "left_anti").select(m.columns), p
