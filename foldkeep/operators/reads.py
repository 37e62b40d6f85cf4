"""Read operators over folded state, for whole tables of requests at once.

A ``Keyspace`` is the state at an instant. Each reader takes a table with one
row a request, ``req_id, key`` and the command's arguments as columns, and
returns ``req_id`` with the reply in columns, and ``err`` where the key holds
another type. Metadata answers what it can without touching elements.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldkeep.functions.values import is_live, lex_bound, next_prefix, score_bound, score_text, ttl_reply
from foldkeep.schema import BAD_SCORE_RANGE, WRONGTYPE


@dataclass
class Keyspace:
    """Elements and metadata at ``now_ms``. Keys that have expired by then are absent."""

    element: DataFrame
    meta: DataFrame
    now_ms: int = 0

    def live(self) -> DataFrame:
        return self.meta.where(is_live(F.col("abs_ttl_ms"), self.now_ms)).select("key", F.col("type").alias("_type"), "abs_ttl_ms", "cardinality")

    def found(self, reqs: DataFrame) -> DataFrame:
        """Requests with their key's ``_type`` (null: absent), ``abs_ttl_ms`` and ``cardinality``."""
        return reqs.join(self.live(), "key", "left")

    def elements(self) -> DataFrame:
        return self.element.select("key", F.col("type").alias("_etype"), F.col("elem").alias("_elem"), F.col("val").alias("_val"), F.col("score").alias("_score"))


def wrong(kind: str) -> Column:
    return F.when(F.col("_type").isNotNull() & (F.col("_type") != kind), F.lit(WRONGTYPE)).alias("err")


def _point(ks: Keyspace, reqs: DataFrame, kind: str, elem: str) -> DataFrame:
    """Requests with the one element that they name, if the key is live and of that type."""
    e = ks.elements().where(F.col("_etype") == kind).withColumnRenamed("key", "_key")
    return ks.found(reqs).join(e, (F.col("key") == F.col("_key")) & (F.col(elem) == F.col("_elem")) & (F.col("_type") == kind), "left").drop("_key")


def _members(ks: Keyspace, reqs: DataFrame, kind: str) -> DataFrame:
    """A row for each element of each request's key."""
    e = ks.elements().where(F.col("_etype") == kind).drop("_etype")
    return reqs.join(ks.live().where(F.col("_type") == kind), "key").join(e, "key")


def prefix_scan(ks: Keyspace, prefix: str) -> DataFrame:
    """``key, type, cardinality`` of the live keys that begin with ``prefix``: a range of keys, which file statistics prune."""
    live = ks.live().where(F.col("key") >= prefix)
    end = next_prefix(prefix)
    return (live if end is None else live.where(F.col("key") < end)).select("key", F.col("_type").alias("type"), "cardinality")


def get(ks: Keyspace, reqs: DataFrame) -> DataFrame:
    e = ks.elements().where("_etype = 'string'").withColumnRenamed("key", "_key")
    return ks.found(reqs).join(e, (F.col("key") == F.col("_key")) & (F.col("_type") == "string"), "left").select("req_id", F.col("_val").alias("val"), wrong("string"))


def mget(ks: Keyspace, reqs: DataFrame) -> DataFrame:
    """``req_id, pos, val`` for requests with ``keys``; repeated keys are answered each time, other types are null."""
    each = reqs.select("req_id", F.posexplode("keys").alias("pos", "key"))
    e = ks.elements().where("_etype = 'string'").select("key", F.col("_val").alias("val"))
    strings = ks.live().where("_type = 'string'").select("key").join(e, "key")
    return each.join(strings, "key", "left").select("req_id", "pos", "val")


def exists(ks: Keyspace, reqs: DataFrame) -> DataFrame:
    """``req_id, n``: live keys among ``keys``, each repetition counted."""
    each = reqs.select("req_id", F.explode("keys").alias("key")).join(ks.live().select("key", F.lit(1).alias("_one")), "key", "left")
    return each.groupBy("req_id").agg(F.count("_one").alias("n"))


def type_of(ks: Keyspace, reqs: DataFrame) -> DataFrame:
    return ks.found(reqs).select("req_id", F.coalesce("_type", F.lit("none")).alias("type"))


def ttl(ks: Keyspace, reqs: DataFrame, millis: bool = False) -> DataFrame:
    return ks.found(reqs).select("req_id", ttl_reply(F.col("_type").isNotNull(), F.col("abs_ttl_ms"), ks.now_ms, millis).alias("ttl"))


def expiretime(ks: Keyspace, reqs: DataFrame, millis: bool = False) -> DataFrame:
    t = F.when(F.col("_type").isNull(), F.lit(-2)).when(F.coalesce("abs_ttl_ms", F.lit(0)) == 0, F.lit(-1)).otherwise(F.col("abs_ttl_ms") if millis else F.expr("abs_ttl_ms div 1000"))
    return ks.found(reqs).select("req_id", t.cast("bigint").alias("at"))


def strlen(ks: Keyspace, reqs: DataFrame) -> DataFrame:
    return get(ks, reqs).select("req_id", F.when(F.col("err").isNull(), F.coalesce(F.octet_length("val"), F.lit(0)).cast("bigint")).alias("n"), "err")


def card(ks: Keyspace, reqs: DataFrame, kind: str) -> DataFrame:
    """SCARD, ZCARD, HLEN: from metadata alone."""
    n = F.when(F.col("_type").isNull(), F.lit(0)).when(F.col("_type") == kind, F.col("cardinality")).cast("bigint")
    return ks.found(reqs).select("req_id", n.alias("n"), wrong(kind))


def is_member(ks: Keyspace, reqs: DataFrame, kind: str = "set", elem: str = "elem") -> DataFrame:
    """SISMEMBER, HEXISTS."""
    n = F.when(F.col("_type").isNull() | (F.col("_type") == kind), F.col("_elem").isNotNull().cast("bigint"))
    return _point(ks, reqs, kind, elem).select("req_id", n.alias("n"), wrong(kind))


def members(ks: Keyspace, reqs: DataFrame, kind: str = "set") -> DataFrame:
    """SMEMBERS, HKEYS, HVALS, HGETALL as rows ``req_id, elem, val`` (no order)."""
    return _members(ks, reqs, kind).select("req_id", F.col("_elem").alias("elem"), F.col("_val").alias("val"))


def smismember(ks: Keyspace, reqs: DataFrame) -> DataFrame:
    each = reqs.select("req_id", "key", F.posexplode("elems").alias("pos", "elem"))
    r = _point(ks, each, "set", "elem")
    return r.select("req_id", "pos", F.when(F.col("_type").isNull() | (F.col("_type") == "set"), F.col("_elem").isNotNull().cast("bigint")).alias("n"))


def srandmember(ks: Keyspace, reqs: DataFrame, count: int = 1, seed: int = 0) -> DataFrame:
    """``count`` different members of each set, chosen by a keyed hash (so a rerun agrees)."""
    w = Window.partitionBy("req_id").orderBy(F.xxhash64(F.lit(seed), "req_id", "elem"), "elem")
    return members(ks, reqs).withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= count).select("req_id", "elem")


def zscore(ks: Keyspace, reqs: DataFrame) -> DataFrame:
    return _point(ks, reqs, "zset", "elem").select("req_id", F.col("_score").alias("score"), wrong("zset"))


def zmscore(ks: Keyspace, reqs: DataFrame) -> DataFrame:
    each = reqs.select("req_id", "key", F.posexplode("elems").alias("pos", "elem"))
    return _point(ks, each, "zset", "elem").select("req_id", "pos", F.col("_score").alias("score"))


def hget(ks: Keyspace, reqs: DataFrame) -> DataFrame:
    return _point(ks, reqs, "hash", "elem").select("req_id", F.col("_val").alias("val"), wrong("hash"))


def hmget(ks: Keyspace, reqs: DataFrame) -> DataFrame:
    each = reqs.select("req_id", "key", F.posexplode("elems").alias("pos", "elem"))
    return _point(ks, each, "hash", "elem").select("req_id", "pos", F.col("_val").alias("val"))


def zrange_index(ks: Keyspace, reqs: DataFrame, rev: bool = False) -> DataFrame:
    """ZRANGE by rank for requests with ``start`` and ``stop`` (inclusive, negative from the end): ``req_id, rank, elem, score``.

    Members are ranked once a key, however many requests ask for it; the size of
    a key comes from metadata, so ranks from the end are counted from there.
    """
    return picked(ks, index_spans(ks, reqs, F.lit(rev)))


def index_spans(ks: Keyspace, reqs: DataFrame, rev: Column) -> DataFrame:
    """``reqs`` with the ranks that each asks for: ``_from`` up to below ``_to``, where rank 0 is the member at ``_base`` and ``_back`` says that ranks run back from there."""
    n = F.col("cardinality")
    at = lambda c: F.greatest(F.lit(-1), F.least(n, F.when(F.col(c) < 0, F.col(c) + n).otherwise(F.col(c))))
    r = reqs.join(ks.live().where("_type = 'zset'"), "key")
    return r.select(*reqs.columns, rev.alias("_back"), F.when(rev, n - 1).otherwise(0).alias("_base"), F.greatest(at("start"), F.lit(0)).alias("_from"), F.least(at("stop") + 1, n).alias("_to"))


def bound_spans(ks: Keyspace, reqs: DataFrame, rev: Column, lex: bool = False) -> DataFrame:
    """The same for requests with bounds ``min`` and ``max`` as text, of scores or of members (``lex``); those without valid bounds have no row.

    A bound's place among its key's members comes from one sort of members and
    bounds, so that no request is compared with each member.
    """
    read = lex_bound if lex else score_bound
    r = reqs.withColumn("_lo", read(F.when(rev, F.col("max")).otherwise(F.col("min")))).withColumn("_hi", read(F.when(rev, F.col("min")).otherwise(F.col("max"))))
    r = r.where("_lo is not null and _hi is not null").join(ks.live().where("_type = 'zset'").select("key"), "key")

    def place(c: str, high: bool) -> Column:
        """Where a bound sorts: before members that equal it (0) or after them (2); ends of the lex order before and after all."""
        b = F.col(c)
        is_open = b["kind"] == 2 if lex else b["open"]
        end = F.when(b["kind"].isin(-1, 1), b["kind"]).otherwise(0) if lex else F.lit(0)
        return F.struct(end.cast("int").alias("end"), b["v"].alias("v"), F.when(is_open, 0 if high else 2).otherwise(2 if high else 0).cast("int").alias("side"))

    r = r.select(*reqs.columns, place("_lo", False).alias("_lo"), place("_hi", True).alias("_hi"))
    bounds = r.select("key", F.explode(F.array("_lo", "_hi")).alias("_b")).distinct()
    e = ks.elements().where("_etype = 'zset'").join(bounds.select("key").distinct(), "key", "left_semi")
    one = F.struct(F.lit(0).alias("end"), F.col("_elem" if lex else "_score").alias("v"), F.lit(1).alias("side"))
    w = Window.partitionBy("key").orderBy("_b.end", "_b.v", "_b.side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = e.select("key", one.alias("_b"), F.lit(1).alias("_one")).unionByName(bounds.withColumn("_one", F.lit(0)))
    placed = both.withColumn("_n", F.sum("_one").over(w)).where("_one = 0")
    for c, to in (("_lo", "_low"), ("_hi", "_high")):
        r = r.join(placed.select("key", F.col("_b").alias(c), F.col("_n").alias(to)), ["key", c])
    base = F.when(rev, F.col("_high") - 1).otherwise(F.col("_low"))
    return r.select(*reqs.columns, rev.alias("_back"), base.alias("_base"), F.lit(0).cast("bigint").alias("_from"), (F.col("_high") - F.col("_low")).alias("_to"))


def limited(spans: DataFrame, offset: Column, count: Column) -> DataFrame:
    """LIMIT offset count on the ranks themselves; a negative count means all, a negative offset 0."""
    to = F.greatest(F.col("_to"), F.lit(0))
    first = F.least(F.greatest(offset, F.lit(0)), to)
    return spans.withColumn("_end", F.when(count < 0, to).otherwise(F.least(to, first + F.least(count, to)))).withColumn("_from", F.greatest("_from", first)).withColumn("_to", F.col("_end")).drop("_end")


def picked(ks: Keyspace, spans: DataFrame, lex: bool = False) -> DataFrame:
    """The members of spans: ``req_id, rank, elem, score``, a row for each that the reply has."""
    each = spans.where("_to > _from").select("req_id", F.col("key").alias("_key"), "_back", "_base", F.explode(F.sequence("_from", F.col("_to") - 1)).alias("rank"))
    each = each.withColumn("_pos", F.when(F.col("_back"), F.col("_base") - F.col("rank")).otherwise(F.col("_base") + F.col("rank")))
    found = each.join(_ranked(ks, each, lex), (F.col("_key") == F.col("key")) & (F.col("_pos") == F.col("_rank")))
    return found.select("req_id", F.col("rank").cast("bigint").alias("rank"), F.col("_elem").alias("elem"), F.col("_score").alias("score"))


def _ranked(ks: Keyspace, asked: DataFrame, lex: bool = False) -> DataFrame:
    """The members of the sorted sets that are asked for (``_key``) with their ``_rank``, by one window over each key."""
    e = ks.elements().where("_etype = 'zset'").join(asked.select(F.col("_key").alias("key")).distinct(), "key", "left_semi")
    order = ["_elem"] if lex else ["_score", "_elem"]
    return e.withColumn("_rank", (F.row_number().over(Window.partitionBy("key").orderBy(*order)) - 1).cast("bigint"))


def _in_bounds(ks: Keyspace, reqs: DataFrame, rev: bool, lex: bool, offset: int, count: int) -> DataFrame:
    spans = limited(bound_spans(ks, reqs, F.lit(rev), lex), F.lit(offset).cast("bigint"), F.lit(count).cast("bigint"))
    return picked(ks, spans, lex).withColumn("rank", F.col("rank") - max(0, offset))


def zrange_score(ks: Keyspace, reqs: DataFrame, rev: bool = False, offset: int = 0, count: int = -1) -> DataFrame:
    """ZRANGE BYSCORE for requests with bounds ``min`` and ``max`` as text; REV swaps them. Invalid bounds give one row with ``err``."""
    bad = reqs.where(score_bound(F.col("min")).isNull() | score_bound(F.col("max")).isNull()).select("req_id", F.lit(None).cast("bigint").alias("rank"), F.lit(None).cast("string").alias("elem"), F.lit(None).cast("double").alias("score"), F.lit(BAD_SCORE_RANGE).alias("err"))
    return _in_bounds(ks, reqs, rev, False, offset, count).withColumn("err", F.lit(None).cast("string")).unionByName(bad)


def zrange_lex(ks: Keyspace, reqs: DataFrame, rev: bool = False, offset: int = 0, count: int = -1) -> DataFrame:
    """ZRANGE BYLEX: by member bytes alone, scores are ignored."""
    lo, hi = ("max", "min") if rev else ("min", "max")
    wrong_bound = F.when(lex_bound(F.col(lo)).isNull(), F.col(lo)).when(lex_bound(F.col(hi)).isNull(), F.col(hi))
    unread = lex_bound(F.col(lo)).isNull() | lex_bound(F.col(hi)).isNull()
    bad = reqs.where(unread).select("req_id", F.lit(None).cast("bigint").alias("rank"), F.lit(None).cast("string").alias("elem"), F.concat(F.lit("ERR not a valid lex range bound: '"), wrong_bound, F.lit("'")).alias("err"))
    return _in_bounds(ks, reqs, rev, True, offset, count).drop("score").withColumn("err", F.lit(None).cast("string")).unionByName(bad)


def _counted(ks: Keyspace, reqs: DataFrame, lex: bool) -> DataFrame:
    n = bound_spans(ks, reqs, F.lit(False), lex).select("req_id", F.greatest(F.col("_to"), F.lit(0)).alias("_n"))
    return reqs.select("req_id").join(n, "req_id", "left").select("req_id", F.coalesce("_n", F.lit(0)).alias("n"))


def zcount(ks: Keyspace, reqs: DataFrame) -> DataFrame:
    return _counted(ks, reqs, False)


def zlexcount(ks: Keyspace, reqs: DataFrame) -> DataFrame:
    return _counted(ks, reqs, True)


def zrank(ks: Keyspace, reqs: DataFrame, rev: bool = False) -> DataFrame:
    """ZRANK, ZREVRANK: members are ranked once a key; null if the key or the member is absent."""
    r = reqs.select("req_id", F.col("key").alias("_key"), F.col("elem").alias("_e"))
    live = ks.live().where("_type = 'zset'").select(F.col("key").alias("_key"), "cardinality")
    found = r.join(live, "_key").join(_ranked(ks, r), (F.col("_key") == F.col("key")) & (F.col("_e") == F.col("_elem")))
    rank = F.col("cardinality") - 1 - F.col("_rank") if rev else F.col("_rank")
    return reqs.select("req_id").join(found.select("req_id", rank.cast("bigint").alias("rank")), "req_id", "left")


def with_scores(rows: DataFrame, rev: bool = False) -> DataFrame:
    """Replies of a range as the protocol lists them: members and score texts in turn."""
    order = F.sort_array(F.collect_list(F.struct("rank", "elem", "score")))
    rows = rows.withColumn("score", score_text(F.col("score")))
    return rows.groupBy("req_id").agg(F.flatten(F.transform(order, lambda x: F.array(x["elem"], x["score"]))).alias("arr"))
