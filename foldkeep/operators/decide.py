"""Conditional writes in general: requests to effects and replies, decided one after the other where they depend on each other."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldkeep.operators.components import key_groups
from foldkeep.operators.running import running
from foldkeep.session import lean

DECIDED = "req_id long, part int, ord int, kind string, i long, s string, arr array<string>, err string, op string, key string, elem string, val string, score double, ttl_ms long, replaces_state boolean"
#: What a task that decides reads: rows of a base before the requests of the group.
DEALT = "group string, is_request boolean, req_id long, part int, at_ms long, args array<string>, type string, key string, elem string, val string, score double, abs_ttl_ms long"
#: Commands that do to each of their keys what they would do to it alone.
EACH_KEY = ("DEL", "UNLINK", "MGET", "EXISTS", "MSET")


def keys_column(args: Column) -> Column:
    """The keys that a command names, as a column."""
    name = F.upper(F.try_element_at(args, F.lit(1)))
    n = F.size(args)
    rest = F.slice(args, F.lit(2), F.greatest(n - 1, F.lit(0)))
    none = F.expr("cast(array() as array<string>)")
    return (
        F.when((n < 2) | name.isin("FLUSHDB", "FLUSHALL", "DBSIZE"), none)
        .when(name.isin("MSET", "MSETNX"), F.filter(rest, lambda _, i: i % 2 == 0))
        .when(name.isin("DEL", "UNLINK", "MGET", "EXISTS"), rest)
        .when(name.isin("RENAMENX", "COPY"), F.slice(rest, 1, 2))
        .otherwise(F.slice(rest, 1, 1))
    )


#: Most flushes whose places are handed to every task; with more, all requests are one group.
MOST_FLUSHES = 10_000


def groups(requests: DataFrame) -> DataFrame:
    """``requests`` (``req_id, at_ms, args``) with ``group`` and ``part``: those of a group depend on each other, those of different groups don't.

    Commands whose outcome depends on several keys tie them together. Those that
    do the same to each key alone are a row a key, numbered by ``part`` (null:
    the request as a whole). A flush parts what came before it from what comes
    after, as it leaves nothing that a later command could see. DBSIZE looks at
    all keys and so ties all requests into one group.
    """
    return _groups(requests)[0]


def _tied(requests: DataFrame, of: Column, to: str) -> DataFrame:
    """Requests with the group of keys (``to``) that commands in which ``of`` holds tie together, else their first key."""
    ties = requests.where(of & (F.size("_keys") > 1)).select(F.element_at("_keys", 1).alias("a"), F.explode(F.slice("_keys", F.lit(2), F.size("_keys"))).alias("b"))
    return requests.join(key_groups(ties).select(F.col("key").alias("_key"), F.col("group").alias(to)), "_key", "left").withColumn(to, F.coalesce(to, "_key"))


def _groups(requests: DataFrame) -> tuple[DataFrame, bool, bool]:
    """The same, whether all requests are one group, and whether some request has several parts."""
    r = requests.withColumn("_keys", keys_column(F.col("args"))).withColumn("_name", F.upper(F.try_element_at("args", F.lit(1))))
    mode = F.upper(F.try_element_at("args", F.lit(2)))
    done = (F.size("args") == 1) | ((F.size("args") == 2) & mode.isin("ASYNC", "SYNC"))  # any other is refused and flushes nothing
    flush = F.coalesce(F.col("_name").isin("FLUSHDB", "FLUSHALL") & done, F.lit(False))
    many, each = F.size("_keys") > 1, F.coalesce(F.col("_name").isin(*EACH_KEY), F.lit(False))
    split = many & each & ((F.col("_name") != "MSET") | (F.size("args") % 2 == 1))
    seen = r.agg(*[F.coalesce(F.max(c), F.lit(False)).alias(n) for n, c in {"flush": flush, "all": F.col("_name") == "DBSIZE", "ties": many & ~each, "parts": split}.items()]).first()
    at = [x.req_id for x in r.where(flush).select("req_id").orderBy("req_id").limit(MOST_FLUSHES + 1).collect()] if seen.flush else []
    if len(at) > MOST_FLUSHES or seen["all"]:
        return requests.withColumn("part", F.lit(None).cast("int")).withColumn("group", F.lit("*")), True, False
    r = r.withColumn("_epoch", F.size(F.filter(F.array(*[F.lit(x) for x in at]), lambda x: x < F.col("req_id"))) if at else F.lit(0))
    # a request without keys depends on nothing but a flush
    alone = F.concat(F.lit("\x00"), F.col("req_id").cast("string"))
    r = r.withColumn("_key", F.coalesce(F.try_element_at("_keys", F.lit(1)), alone))
    if seen.parts:
        # one clock for all keys that some request names together, as if these were decided together
        r = running(_tied(r, F.lit(True), "_clock"), ["_epoch", "_clock"], ["req_id"], {"at_ms": "_now"}, "max", "clock").withColumn("at_ms", F.col("_now"))
        arg = lambda i: F.try_element_at("args", i)
        pair = lambda i: F.when(F.col("_name") == "MSET", F.array(arg(F.lit(1)), arg(i * 2 + 2), arg(i * 2 + 3))).otherwise(F.array(arg(F.lit(1)), arg(i + 2)))
        one = F.array(F.struct(F.lit(None).cast("int").alias("part"), F.col("_key").alias("_key"), F.col("args").alias("args")))
        parts = F.transform("_keys", lambda k, i: F.struct(i.alias("part"), F.coalesce(k, alone).alias("_key"), pair(i).alias("args")))
        r = r.withColumn("_p", F.explode(F.when(split, parts).otherwise(one))).select("req_id", "at_ms", "_epoch", "_p.*").withColumn("_keys", keys_column(F.col("args")))
    else:
        r = r.withColumn("part", F.lit(None).cast("int"))
    r = _tied(r, ~F.coalesce(F.upper(F.try_element_at("args", F.lit(1))).isin(*EACH_KEY), F.lit(False)), "group") if seen.ties else r.withColumn("group", F.col("_key"))
    return r.select(*requests.columns, "part", F.concat(F.col("_epoch").cast("string"), F.lit(":"), F.col("group")).alias("group")), False, seen.parts


def _held(requests: DataFrame, whole: bool, element: DataFrame, meta: DataFrame) -> DataFrame:
    """``of`` (a group), ``key, type, elem, val, score, abs_ttl_ms``: what a base holds of the keys that requests name before the first flush."""
    held = element.select("key", "type", "elem", "val", "score").join(meta.select("key", F.coalesce("abs_ttl_ms", F.lit(0)).alias("abs_ttl_ms")), "key")
    if whole:
        return held.withColumn("of", F.lit("*"))
    named = requests.where(F.col("group").startswith("0:")).select(F.col("group").alias("of"), keys_column(F.col("args")).alias("keys"))
    named = named.select("of", F.explode("keys").alias("key")).distinct()
    return held.join(named, "key")


def _fields(spec: str) -> list[tuple[str, str]]:
    return [tuple(c.split(" ", 1)) for c in spec.split(", ")]


#: Decided rows, and items of array replies, that a task holds before it hands them on.
HELD = 10_000


def _decided(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Decide groups one after the other, from rows sorted by group, the base's before requests; only one group's state is held."""
    from foldkeep.model import Machine, Value

    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}
    schema = pa.schema([(n, kinds[k]) for n, k in _fields(DECIDED)])
    out, size, group, m, now = [], 0, None, None, 0

    def handed_on() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    for b in batches:
        for of, is_request, req_id, part, at_ms, args, type_, key, elem, val, score, ttl_ms in zip(*[c.to_pylist() for c in b.columns], strict=True):
            if of != group:
                group, m, now = of, Machine(), 0
            if not is_request:
                if type_ == "string":
                    m.data[key] = Value("string", val, ttl_ms)
                else:
                    m.data.setdefault(key, Value(type_, {}, ttl_ms)).data[elem] = {"hash": val, "zset": score, "set": None}[type_]
                continue
            now = max(now, at_ms)
            (kind, v), effects = m.execute(args, now)
            arr = [None if x is None else str(x) for x in v] if kind == "array" else None
            out.append((req_id, part, -1, kind, v if kind == "int" else None, v if kind in ("bulk", "simple") else None, arr, v if kind == "error" else None, None, None, None, None, None, None, None))
            out += [(req_id, part, k, None, None, None, None, None, e.op, e.key, e.elem, e.val, e.score, e.ttl_ms, e.replaces_state) for k, e in enumerate(effects)]
            size += 1 + len(effects) + len(arr or ())
            if size >= HELD:
                yield handed_on()
                out, size = [], 0
    if out:
        yield handed_on()


def decide(requests: DataFrame, base: tuple[DataFrame, DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """``(effects, replies)`` of requests ``req_id, at_ms, args``, in the order of ``req_id``, on an empty key space or over a ``base``.

    ``base`` is ``(element, meta)`` as the fold makes them; the effects then go
    on with its log. Of it, only keys that requests name before the first flush
    are read, and a key's state goes to the task that decides its group.

    ``req_id`` must be unique. Requests are dealt by groups of keys whose commands
    depend on each other (``groups``); a task decides its groups one after the
    other and holds one group's state. DEL, MGET, EXISTS and MSET of several keys
    are decided key by key and put together again. Time never runs back among
    requests that name keys together; ``fold.log_clock`` gives a whole shard
    one clock beforehand, where instants of different clients are mixed.
    """
    r, whole, parts = _groups(requests.select(F.col("req_id").cast("long").alias("req_id"), F.col("at_ms").cast("long").alias("at_ms"), "args"))
    wide = lambda df, **have: df.select(*[have.get(n, F.lit(None)).cast(k).alias(n) for n, k in _fields(DEALT)])
    rows = wide(r, is_request=F.lit(True), **{c: F.col(c) for c in ("group", "req_id", "part", "at_ms", "args")})
    if base is not None:
        held = _held(r, whole, *base)
        rows = rows.unionByName(wide(held, group=F.col("of"), is_request=F.lit(False), **{c: F.col(c) for c in ("type", "key", "elem", "val", "score", "abs_ttl_ms")}))
    dealt = rows.repartition("group").sortWithinPartitions("group", "is_request", "key", "elem", "req_id", "part")
    both = dealt.mapInArrow(lean(_decided), DECIDED)
    effects, replies = both.where("ord >= 0"), both.where("ord < 0")
    if parts:
        w = Window.partitionBy("req_id", F.col("part").isNull())
        apart, at = F.col("part").isNotNull(), w.orderBy("part", "ord")
        effects = effects.withColumn("ord", F.when(apart, F.row_number().over(at) - 1).otherwise(F.col("ord")))
        full = w.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        arr = F.when(apart & (F.col("kind") == "array"), F.flatten(F.collect_list("arr").over(full))).otherwise(F.col("arr"))
        replies = replies.withColumns({"i": F.when(apart, F.sum("i").over(full)).otherwise(F.col("i")), "arr": arr}).where("part is null or part = 0")
    effects = effects.select("req_id", "ord", "op", "key", "elem", "val", "score", "ttl_ms", "replaces_state")
    return effects, replies.select("req_id", "kind", "i", "s", "arr", "err")


def to_log(effects: DataFrame, shard: Column | None = None) -> DataFrame:
    """Effects as rows of a log (schema ``LOG``), the request's number as sequence."""
    return effects.select(
        (F.lit(0) if shard is None else shard).cast("int").alias("shard"), F.col("req_id").alias("seq"), F.col("ord").cast("int").alias("ord"), F.col("req_id").alias("batch"),
        F.lit(None).cast("long").alias("appended_at_ms"), "op", "key", "elem", "val", "score", "ttl_ms", "replaces_state",
    )
