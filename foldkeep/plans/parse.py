"""Requests to typed columns: options, bounds and expiry times, inside Catalyst."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldkeep.functions.values import absolute_ttl, strict_double, strict_int
from foldkeep.plans.registry import resolve
from foldkeep.schema import NOT_FLOAT, NOT_INTEGER, SYNTAX

# Bits of the flags that a write carries.
FLAGS = {"NX": 1, "XX": 2, "GET": 4, "KEEPTTL": 8, "ZADD_GT": 16, "ZADD_LT": 32, "CH": 64, "MSETNX": 128, "EXPIRE_GT": 256, "EXPIRE_LT": 512}

TTL_OPTIONS = ("EX", "PX", "EXAT", "PXAT")
ZADD_OPTIONS = ("NX", "XX", "GT", "LT", "CH", "INCR")
WRITES = (
    "SET", "SETEX", "PSETEX", "SETNX", "MSET", "MSETNX", "DEL", "UNLINK", "SADD", "SREM", "ZADD", "ZREM", "HSET", "HMSET", "HSETNX", "HDEL",
    "EXPIRE", "PEXPIRE", "EXPIREAT", "PEXPIREAT", "PERSIST", "RENAMENX", "COPY", "FLUSHDB", "FLUSHALL",
)
#: Reads that have one key and no options, and what they become where that is not their own name.
PLAIN_READS = ("GET", "SMEMBERS", "SCARD", "ZCARD", "HGETALL", "HKEYS", "HVALS", "HLEN", "TTL", "PTTL", "TYPE")
MEMBER_READS = ("SISMEMBER", "ZSCORE", "HGET", "HEXISTS")
RANGE_READS = {"ZRANGE": ("BYSCORE", "BYLEX", "REV", "WITHSCORES", "LIMIT"), "ZRANGEBYSCORE": ("WITHSCORES", "LIMIT"), "ZRANGEBYLEX": ("LIMIT",)}


def name_of(args: Column) -> Column:
    return F.upper(F.try_element_at(args, F.lit(1)))


def options(args: Column, start: int) -> Column:
    """The arguments from the 1-based place ``start`` on, in upper case."""
    return F.transform(F.slice(args, F.lit(start), F.greatest(F.size(args) - start + 1, F.lit(0))), F.upper)


def zadd_front(args: Column) -> Column:
    """How many options ZADD has before its first score."""
    z = options(args, 3)
    first = F.array_position(F.transform(z, lambda x: x.isin(*ZADD_OPTIONS)), False).cast("int")
    return F.when(first > 0, first - 1).otherwise(F.size(z))


def flag_bits(args: Column, front: Column | None = None) -> Column:
    """The flags of a write command as one number; ``front`` is its ``zadd_front``, where that is known."""
    name = name_of(args)
    bit = lambda cond, flag: F.when(cond, FLAGS[flag]).otherwise(0)
    o = options(args, 4)
    # values of expiry options are no options themselves
    own = F.filter(o, lambda x, i: (i == 0) | ~F.element_at(o, F.greatest(i, F.lit(1))).isin(*TTL_OPTIONS))
    has = lambda x: F.array_contains(own, x)
    set_bits = bit(has("NX"), "NX") + bit(has("XX"), "XX") + bit(has("GET"), "GET") + bit(has("KEEPTTL"), "KEEPTTL")
    front = F.slice(options(args, 3), F.lit(1), zadd_front(args) if front is None else front)
    zhas = lambda x: F.array_contains(front, x)
    zadd_bits = bit(zhas("NX"), "NX") + bit(zhas("XX"), "XX") + bit(zhas("GT"), "ZADD_GT") + bit(zhas("LT"), "ZADD_LT") + bit(zhas("CH"), "CH")
    expire_bits = bit(F.array_contains(o, "NX"), "NX") + bit(F.array_contains(o, "XX"), "XX") + bit(F.array_contains(o, "GT"), "EXPIRE_GT") + bit(F.array_contains(o, "LT"), "EXPIRE_LT")
    return (
        F.when(name == "SET", set_bits).when(name == "ZADD", zadd_bits)
        .when(name.isin("EXPIRE", "PEXPIRE", "EXPIREAT", "PEXPIREAT"), expire_bits)
        .when(name.isin("SETNX", "HSETNX", "RENAMENX"), FLAGS["NX"]).when(name == "MSETNX", FLAGS["MSETNX"])
        .when(name == "COPY", bit(~F.array_contains(o, "REPLACE"), "NX")).otherwise(0)
    )


def expiry(args: Column, now_ms: Column) -> Column:
    """``struct(ms, err)``: the absolute expiry that SET, SETEX, PSETEX and the EXPIRE family ask for (null: none)."""
    name, low = name_of(args), F.lower(F.try_element_at(args, F.lit(1)))
    o = options(args, 4)
    at = F.array_position(F.transform(o, lambda x: x.isin(*TTL_OPTIONS)), True).cast("int")
    set_opt, set_val = F.try_element_at(o, at), F.try_element_at(args, at + 4)
    opt = (
        F.when((name == "SET") & (at > 0), set_opt).when(name == "SETEX", "EX").when(name == "PSETEX", "PX")
        .when(name == "EXPIRE", "EX").when(name == "PEXPIRE", "PX").when(name == "EXPIREAT", "EXAT").when(name == "PEXPIREAT", "PXAT")
    )
    text = F.when(name == "SET", set_val).otherwise(F.try_element_at(args, F.lit(3)))
    n = strict_int(text)
    ms = (
        F.when(opt == "EX", absolute_ttl(n, 1000, True, now_ms)).when(opt == "PX", absolute_ttl(n, 1, True, now_ms))
        .when(opt == "EXAT", absolute_ttl(n, 1000, False, now_ms)).when(opt == "PXAT", absolute_ttl(n, 1, False, now_ms))
    )
    bad = F.concat(F.lit("ERR invalid expire time in '"), low, F.lit("' command"))
    err = (
        F.when(opt.isNull(), F.lit(None)).when(text.isNull(), SYNTAX).when(n.isNull(), NOT_INTEGER)
        .when(name.isin("SET", "SETEX", "PSETEX") & (n <= 0), bad).when(ms.isNull(), bad)
    )
    return F.struct(F.when(err.isNull(), ms).alias("ms"), err.alias("err"))


def _scan(args: Column, start: int, state: dict[str, Column], step) -> Column:
    """Options from the 1-based place ``start`` on, folded from the left: ``step(state, option, options after it)`` gives the next
    state's columns; ``err`` of the state keeps the first error."""
    o = options(args, start)
    each = F.transform(o, lambda x, i: F.struct(F.coalesce(x, F.lit("")).alias("x"), i.alias("i")))

    def merge(a, t):
        new = step({k: a[k] for k in state}, t["x"], F.size(o) - 1 - t["i"])
        return F.struct(*[(F.coalesce(a["err"], v) if k == "err" else v).alias(k) for k, v in new.items()])

    return F.aggregate(each, F.struct(*[v.alias(k) for k, v in state.items()]), merge)


def _none(kind: str) -> Column:
    return F.lit(None).cast(kind)


def set_error(args: Column, ttl_err: Column) -> Column:
    """What is wrong with the options of SET; ``ttl_err`` is the error of its expiry, told where that stands."""

    def step(a, x, after):
        value, ttl = a["want"], x.isin(*TTL_OPTIONS)
        bad = (
            F.when(value, ttl_err).when(ttl, F.when(a["ttl"] | a["keep"] | (after < 1), SYNTAX))
            .when(x == "KEEPTTL", F.when(a["ttl"], SYNTAX)).when(x == "NX", F.when(a["xx"], SYNTAX)).when(x == "XX", F.when(a["nx"], SYNTAX))
            .when(x != "GET", SYNTAX)
        )
        has = lambda k, cond: a[k] | (~value & cond)
        return {"want": ~value & ttl, "ttl": has("ttl", ttl), "keep": has("keep", x == "KEEPTTL"), "nx": has("nx", x == "NX"), "xx": has("xx", x == "XX"), "err": bad}

    return _scan(args, 4, {k: F.lit(False) for k in ("want", "ttl", "keep", "nx", "xx")} | {"err": _none("string")}, step)["err"]


def write_error(args: Column, flags: Column, front: Column, ttl_err: Column) -> Column:
    """The error that a write's options and number of arguments give, null if none; the values of ZADD's scores are judged by row.

    ``flags`` are its ``flag_bits``, ``front`` its ``zadd_front``.
    """
    name, n, o = name_of(args), F.size(args), options(args, 4)
    has = lambda *names: flags.bitwiseAND(F.lit(sum(FLAGS[x] for x in names))) != 0
    incr = (front > 0) & F.array_contains(F.slice(options(args, 3), F.lit(1), front), "INCR")
    zadd = (
        F.when(incr, "ERR ZADD INCR is not supported").when(has("NX") & has("XX"), "ERR XX and NX options at the same time are not compatible")
        .when((has("ZADD_GT") & has("ZADD_LT")) | (has("NX") & has("ZADD_GT", "ZADD_LT")), "ERR GT, LT, and/or NX options at the same time are not compatible")
        .when((n - 2 - front < 1) | ((n - 2 - front) % 2 != 0), SYNTAX)
    )
    unknown = F.array_position(F.transform(o, lambda x: x.isin("NX", "XX", "GT", "LT")), False).cast("int")
    expire = (
        F.when(strict_int(F.try_element_at(args, F.lit(3))).isNull(), NOT_INTEGER)
        .when((n > 3) & (unknown > 0), F.concat(F.lit("ERR Unsupported option "), F.try_element_at(args, unknown + 3)))
        .when(has("NX") & has("XX", "EXPIRE_GT", "EXPIRE_LT"), "ERR NX and XX, GT or LT options at the same time are not compatible")
        .when(has("EXPIRE_GT") & has("EXPIRE_LT"), "ERR GT and LT options at the same time are not compatible").otherwise(ttl_err)
    )

    def copy_step(a, x, after):
        number = strict_int(x)
        bad = F.when(a["want"], F.when(number.isNull(), NOT_INTEGER).when(number != 0, "ERR DB index is out of range")).when(x == "DB", F.when(after < 1, SYNTAX)).when(x != "REPLACE", SYNTAX)
        return {"want": ~a["want"] & (x == "DB"), "err": bad}

    copy = F.coalesce(_scan(args, 4, {"want": F.lit(False), "err": _none("string")}, copy_step)["err"], F.when(F.try_element_at(args, F.lit(2)) == F.try_element_at(args, F.lit(3)), "ERR source and destination objects are the same"))
    odd = F.concat(F.lit("ERR wrong number of arguments for '"), F.lower(name), F.lit("' command"))
    return (
        F.when((name == "SET") & (n > 3), set_error(args, ttl_err)).when(name == "ZADD", zadd)
        .when(name.isin("EXPIRE", "PEXPIRE", "EXPIREAT", "PEXPIREAT"), expire).when(name == "COPY", copy)
        .when(name.isin("MSET", "MSETNX"), F.when(n % 2 != 1, odd)).when(name.isin("HSET", "HMSET"), F.when(n % 2 != 0, odd))
        .when(name.isin("FLUSHDB", "FLUSHALL"), F.when((n > 2) | ~F.coalesce(F.upper(F.try_element_at(args, F.lit(2))), F.lit("SYNC")).isin("SYNC", "ASYNC"), SYNTAX))
        .otherwise(ttl_err)
    )


def typed_writes(requests: DataFrame) -> DataFrame:
    """Write requests that have the arguments their command needs, as rows of one element each, in their canonical form.

    ``req_id, ord, op, key, elem, val, score, ttl_ms, flags, err``. SETEX and PSETEX
    become SET, HMSET and HSETNX become HSET, the EXPIRE family PEXPIREAT, DEL
    and UNLINK one row a key, FLUSHDB and FLUSHALL one FLUSH without a key; RENAMENX and COPY
    have the destination in ``elem``. A request whose options are wrong is one row with ``err``.
    """
    # Generated rather than projected, so that the optimizer doesn't copy these expressions to each place that uses them.
    once = lambda *cols: F.inline(F.array(F.struct(*cols)))
    r = requests.select("req_id", "args", "at_ms", once(name_of(F.col("args")).alias("name"), F.when(name_of(F.col("args")) == "ZADD", zadd_front(F.col("args"))).alias("_front"))).where(F.col("name").isin(*WRITES))
    r = r.select("*", once(flag_bits(F.col("args"), F.col("_front")).alias("flags"), expiry(F.col("args"), F.col("at_ms")).alias("_x")))
    r = r.select("*", once(write_error(F.col("args"), F.col("flags"), F.col("_front"), F.col("_x.err")).alias("_err")))
    arg = lambda i: F.try_element_at("args", F.lit(i))
    rest = lambda i: F.slice("args", F.lit(i), F.greatest(F.size("args") - i + 1, F.lit(0)))
    item = lambda key, elem=None, val=None, score=None: F.struct(key.alias("key"), (F.lit(None).cast("string") if elem is None else elem).alias("elem"), (F.lit(None).cast("string") if val is None else val).alias("val"), (F.lit(None).cast("string") if score is None else score).alias("score_text"))
    pairs = lambda a: F.filter(F.transform(a, lambda x, i: F.when(i % 2 == 0, F.struct(x.alias("a"), F.try_element_at(a, i + 2).alias("b")))), lambda p: p.isNotNull())
    zrest = F.slice("args", F.col("_front") + 3, F.size("args"))
    n = F.col("name")
    items = (
        F.when(F.col("_err").isNotNull(), F.array(item(F.when(~n.isin("FLUSHDB", "FLUSHALL"), arg(2)))))
        .when(n == "SET", F.array(item(arg(2), val=arg(3))))
        .when(n.isin("SETEX", "PSETEX"), F.array(item(arg(2), val=arg(4))))
        .when(n == "SETNX", F.array(item(arg(2), val=arg(3))))
        .when(n.isin("MSET", "MSETNX"), F.transform(pairs(rest(2)), lambda p: item(p["a"], val=p["b"])))
        .when(n.isin("DEL", "UNLINK"), F.transform(rest(2), lambda k: item(k)))
        .when(n.isin("SADD", "SREM", "ZREM", "HDEL"), F.transform(rest(3), lambda m: item(arg(2), m)))
        .when(n == "ZADD", F.transform(pairs(zrest), lambda p: item(arg(2), p["b"], score=p["a"])))
        .when(n.isin("HSET", "HMSET", "HSETNX"), F.transform(pairs(rest(3)), lambda p: item(arg(2), p["a"], p["b"])))
        .when(n.isin("EXPIRE", "PEXPIRE", "EXPIREAT", "PEXPIREAT", "PERSIST"), F.array(item(arg(2))))
        .when(n.isin("RENAMENX", "COPY"), F.array(item(arg(2), arg(3))))
        .when(n.isin("FLUSHDB", "FLUSHALL"), F.array(item(_none("string"))))
    )
    op = (
        F.when(n.isin("SET", "SETEX", "PSETEX", "SETNX", "MSET", "MSETNX"), "SET").when(n.isin("DEL", "UNLINK"), "DEL")
        .when(n.isin("HSET", "HMSET", "HSETNX"), "HSET").when(n.isin("EXPIRE", "PEXPIRE", "EXPIREAT", "PEXPIREAT"), "PEXPIREAT")
        .when(n.isin("FLUSHDB", "FLUSHALL"), "FLUSH").otherwise(n)
    )
    rows = r.where(items.isNotNull()).select("req_id", op.alias("op"), "flags", "_x", "_err", F.posexplode(items).alias("ord", "w"))
    score = strict_double(F.col("w.score_text"))
    err = F.coalesce(F.col("_err"), F.when(F.col("w.score_text").isNotNull() & score.isNull(), NOT_FLOAT))
    return rows.select("req_id", "ord", "op", "w.key", "w.elem", "w.val", score.alias("score"), F.col("_x.ms").alias("ttl_ms"), "flags", err.alias("err"))


def range_options(args: Column) -> Column:
    """``struct(by_score, by_lex, rev, scores, start, count, err)`` of what follows the bounds of ZRANGE and its older forms.

    ``start`` and ``count`` are those of LIMIT, 0 and -1 without one.
    """
    name = name_of(args)

    def step(a, x, after):
        free, number = a["want"] == 0, strict_int(x)
        allowed = F.lit(False)
        for command, known in RANGE_READS.items():
            allowed = allowed | ((name == command) & x.isin(*known))
        bad = F.when(~free, F.when(number.isNull(), NOT_INTEGER)).when(~allowed | ((x == "LIMIT") & (after < 2)), SYNTAX)
        has = lambda k, word: a[k] | (free & (x == word))
        return {
            "want": F.when(~free, a["want"] - 1).when(x == "LIMIT", 2).otherwise(0), "by_score": has("by_score", "BYSCORE"), "by_lex": has("by_lex", "BYLEX"),
            "rev": has("rev", "REV"), "scores": has("scores", "WITHSCORES"), "start": F.when(a["want"] == 2, number).otherwise(a["start"]),
            "count": F.when(a["want"] == 1, number).otherwise(a["count"]), "err": bad,
        }

    zero = {"want": F.lit(0), "by_score": name == "ZRANGEBYSCORE", "by_lex": name == "ZRANGEBYLEX", "rev": F.lit(False), "scores": F.lit(False), "start": F.lit(0).cast("bigint"), "count": F.lit(-1).cast("bigint"), "err": _none("string")}
    return _scan(args, 5, zero, step)


def typed_reads(requests: DataFrame) -> DataFrame:
    """Read requests as one typed row each.

    ``req_id, op, key, elems, low, high, mode, rev, with_scores, start, take, millis, err``. PTTL becomes TTL with ``millis``, the
    three forms of ZRANGE one op with ``mode`` index, score or lex; index bounds must be integers, the others are judged by the
    operators. MGET and EXISTS have many keys and are no rows here. Wrong numbers of arguments and options give ``err``.
    """
    names = (*PLAIN_READS, *MEMBER_READS, "HMGET", *RANGE_READS)
    args, n = F.col("args"), F.col("command")
    r = resolve(requests.select("req_id", "args")).where(n.isin(*names))
    ranged = n.isin(*RANGE_READS)
    r = r.withColumn("_o", F.when(ranged & F.col("err").isNull(), range_options(args)))
    at = lambda i: F.try_element_at(args, F.lit(i))
    mode = F.when(F.col("_o.by_score"), "score").when(F.col("_o.by_lex"), "lex").when(F.col("_o").isNotNull(), "index")
    low, high = F.when(ranged, at(3)), F.when(ranged, at(4))
    whole = (mode != "index") | (strict_int(at(3)).isNotNull() & strict_int(at(4)).isNotNull())
    err = F.coalesce("err", F.col("_o.err"), F.when(F.col("_o.by_score") & F.col("_o.by_lex"), SYNTAX), F.when(ranged & ~whole, NOT_INTEGER))
    elems = F.when(n.isin(*MEMBER_READS, "HMGET"), F.slice(args, F.lit(3), F.greatest(F.size(args) - 2, F.lit(0))))
    op = F.when(n == "PTTL", "TTL").when(ranged, "ZRANGE").otherwise(n)
    return r.select(
        "req_id", op.alias("op"), at(2).alias("key"), elems.alias("elems"), low.alias("low"), high.alias("high"), mode.alias("mode"), F.col("_o.rev").alias("rev"),
        F.col("_o.scores").alias("with_scores"), F.col("_o.start").alias("start"), F.col("_o.count").alias("take"), (n == "PTTL").alias("millis"), err.alias("err"),
    )
