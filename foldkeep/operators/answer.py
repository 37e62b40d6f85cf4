"""From read requests to replies: one call that parses a table of requests, deals each to the readers and prints what they found."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldkeep.functions.values import lex_bound, score_bound, score_text, ttl_reply
from foldkeep.operators.reads import Keyspace, bound_spans, exists, index_spans, limited, mget, picked
from foldkeep.plans.parse import typed_reads
from foldkeep.plans.registry import resolve
from foldkeep.schema import BAD_SCORE_RANGE, WRONGTYPE
from foldkeep.session import materialize

#: The type that each typed read asks for; TTL and TYPE take any.
KIND = {
    "GET": "string", "SISMEMBER": "set", "SMEMBERS": "set", "SCARD": "set", "ZSCORE": "zset", "ZCARD": "zset", "ZRANGE": "zset",
    "HGET": "hash", "HEXISTS": "hash", "HMGET": "hash", "HGETALL": "hash", "HKEYS": "hash", "HVALS": "hash", "HLEN": "hash",
}
CARDS, TESTS, POINTS, WHOLE = ("SCARD", "ZCARD", "HLEN"), ("SISMEMBER", "HEXISTS"), ("GET", "HGET", "ZSCORE"), ("SMEMBERS", "HGETALL", "HKEYS", "HVALS")


def _reply(df: DataFrame, kind: Column | str, **values: Column) -> DataFrame:
    kinds = {"i": "long", "s": "string", "arr": "array<string>", "err": "string"}
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return df.select("req_id", kind.alias("kind"), *[values.get(c, F.lit(None)).cast(k).alias(c) for c, k in kinds.items()])


def _bulk(df: DataFrame, text: Column) -> DataFrame:
    return _reply(df, F.when(text.isNull(), "nil").otherwise("bulk"), s=text)


def _bound_error() -> Column:
    """What is wrong with the bounds of a range by score or lex; with REV they come in reverse."""
    low, high = F.when(F.col("rev"), F.col("high")).otherwise(F.col("low")), F.when(F.col("rev"), F.col("low")).otherwise(F.col("high"))
    wrong = F.when(lex_bound(low).isNull(), low).when(lex_bound(high).isNull(), high)
    return F.when((F.col("mode") == "score") & (score_bound(low).isNull() | score_bound(high).isNull()), BAD_SCORE_RANGE).when(
        (F.col("mode") == "lex") & wrong.isNotNull(), F.concat(F.lit("ERR not a valid lex range bound: '"), wrong, F.lit("'"))
    )


def _elements(ks: Keyspace, asked: DataFrame) -> DataFrame:
    """``asked`` (with ``_type``, the live key's, and the name ``_e``) with that element's columns."""
    e = ks.elements().withColumn("_elem", F.coalesce("_elem", F.lit(""))).withColumnRenamed("key", "_key")
    return asked.join(e, (F.col("key") == F.col("_key")) & (F.col("_e") == F.col("_elem")) & (F.col("_type") == F.col("_etype")), "left")


def _ranges(ks: Keyspace, r: DataFrame) -> DataFrame:
    """Replies of ranges. LIMIT selects before members are gathered."""
    first, take = F.coalesce("start", F.lit(0)), F.coalesce("take", F.lit(-1))
    way = lambda mode, low, high: r.where(F.col("mode") == mode).select("req_id", "key", "rev", first.alias("first"), take.alias("take"), low, high)
    texts = F.col("low").alias("min"), F.col("high").alias("max")
    spans = index_spans(ks, way("index", F.col("low").cast("long").alias("start"), F.col("high").cast("long").alias("stop")), F.col("rev")).drop("start", "stop")
    spans = spans.unionByName(bound_spans(ks, way("score", *texts), F.col("rev")).drop("min", "max"))
    cut = lambda s: limited(s, F.col("first"), F.col("take"))
    found = picked(ks, cut(spans)).unionByName(picked(ks, cut(bound_spans(ks, way("lex", *texts), F.col("rev"), lex=True)), lex=True))
    found = found.select(F.col("req_id").alias("_id"), "rank", "elem", score_text(F.col("score")).alias("score"))
    asked = r.select("req_id", F.coalesce(F.col("with_scores") & (F.col("mode") != "lex"), F.lit(False)).alias("_scored"))
    both = asked.join(found, F.col("req_id") == F.col("_id"), "left")
    item = F.struct("rank", F.when(F.col("_scored"), F.array("elem", "score")).otherwise(F.array("elem")).alias("x"))
    got = both.groupBy("req_id").agg(F.sort_array(F.collect_list(F.when(F.col("rank").isNotNull(), item))).alias("_l"))
    return _reply(got, "array", arr=F.flatten(F.transform("_l", lambda x: x["x"])))


def answers(ks: Keyspace, requests: DataFrame) -> DataFrame:
    """Replies (``req_id, kind, i, s, arr, err``) of the read requests among ``req_id, args``, at the key space's instant.

    ``req_id`` must be unique. Reads are those that ``typed_reads`` knows, MGET
    and EXISTS; other commands have no row. Requests that don't parse, have
    bounds that are none or meet another type are errors, judged in this order.
    Typed requests with their key's type are written once, as each family of
    reads takes its own from them: metadata alone, single elements, whole values
    (gathered once a key, however often it is asked for) and ranges.
    """
    typed = typed_reads(requests)
    kind = F.create_map(*[F.lit(x) for kv in KIND.items() for x in kv])[F.col("op")]
    other = F.when(F.col("_type").isNotNull() & kind.isNotNull() & (F.col("_type") != kind), WRONGTYPE)
    t = materialize(ks.found(typed).withColumn("err", F.coalesce("err", _bound_error(), other)), "reads")
    failed, good = t.where("err is not null"), t.where("err is null")
    op, live = F.col("op"), F.col("_type").isNotNull()

    wait = F.when(F.col("millis"), ttl_reply(live, F.col("abs_ttl_ms"), ks.now_ms, True)).otherwise(ttl_reply(live, F.col("abs_ttl_ms"), ks.now_ms, False))
    one = _elements(ks, good.where(op.isin(*TESTS, *POINTS)).withColumn("_e", F.when(op == "GET", "").otherwise(F.try_element_at("elems", F.lit(1)))))
    text = F.when(op == "ZSCORE", score_text(F.col("_score"))).otherwise(F.col("_val"))
    each = good.where(op == "HMGET").select("req_id", "key", "_type", F.posexplode("elems").alias("pos", "_e"))
    fields = _elements(ks, each).groupBy("req_id").agg(F.sort_array(F.collect_list(F.struct("pos", "_val"))).alias("_l"))
    many = good.where(op.isin(*WHOLE)).select("req_id", "op", "key")
    value = ks.elements().where("_etype in ('set', 'hash')").join(many.select("key").distinct(), "key").groupBy("key").agg(F.sort_array(F.collect_list(F.struct("_elem", "_val"))).alias("_l"))
    listed = F.when(op == "HGETALL", F.flatten(F.transform("_l", lambda x: F.array(x["_elem"], x["_val"])))).when(op == "HVALS", F.transform("_l", lambda x: x["_val"])).otherwise(F.transform("_l", lambda x: x["_elem"]))
    # an expired key's elements are still there
    whole = many.join(good.where(live).select(F.col("req_id").alias("_id")), F.col("req_id") == F.col("_id"), "left").join(value, "key", "left")

    wide = resolve(requests.select("req_id", "args")).where(F.col("command").isin("MGET", "EXISTS"))
    keys = wide.where("err is null").select("req_id", "command", F.slice("args", F.lit(2), F.size("args") - 1).alias("keys"))
    found = mget(ks, keys.where("command = 'MGET'")).groupBy("req_id").agg(F.sort_array(F.collect_list(F.struct("pos", "val"))).alias("_l"))
    parts = [
        _reply(failed, "error", err=F.col("err")),
        _reply(good.where(op == "TYPE"), "simple", s=F.coalesce("_type", F.lit("none"))),
        _reply(good.where(op == "TTL"), "int", i=wait),
        _reply(good.where(op.isin(*CARDS)), "int", i=F.coalesce("cardinality", F.lit(0))),
        _reply(one.where(op.isin(*TESTS)), "int", i=F.col("_etype").isNotNull().cast("long")),
        _bulk(one.where(op.isin(*POINTS)).select("req_id", text.alias("_s")), F.col("_s")),
        _reply(fields, "array", arr=F.transform("_l", lambda x: x["_val"])),
        _reply(whole, "array", arr=F.coalesce(F.when(F.col("_id").isNotNull(), listed), F.expr("cast(array() as array<string>)"))),
        _ranges(ks, good.where(op == "ZRANGE")),
        _reply(found, "array", arr=F.transform("_l", lambda x: x["val"])),
        _reply(exists(ks, keys.where("command = 'EXISTS'")), "int", i=F.col("n")),
        _reply(wide.where("err is not null"), "error", err=F.col("err")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
