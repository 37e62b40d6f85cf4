"""Registered queries of the keyed-collection engine, one or more an operator, each with its SQL.

They build keyed data from the relational tables: event streams as writes,
parts as sorted sets by brand, customers as hashes and as members of their
nation's set.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foldkeep.functions import routing, values
from foldkeep.operators import compact, merge, reads, ttl, writes
from foldkeep.operators.fold import fold, gaps, log_clock, misplaced, packed
from foldkeep.operators.reads import Keyspace
from foldkeep.plans import parse, registry
from foldkeep.sources import log as logs
from foldkeep.sources import resp
from foldkeep.session import materialize

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: 2024-01-01 in milliseconds: the instant at which queries judge expiry, unless they say otherwise.
NOW = 1_704_067_200_000


def query(sql: str | None):
    """Register a query, with its SQL unless its result isn't a matter of SQL."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def events(spark: SparkSession, sf: str) -> DataFrame:
    """Events as writes: ``seq, key, elem, val, score, at_ms``. Event numbers follow the time, so they are the sequence."""
    e = table(spark, sf, "events")
    return e.select(
        F.col("event_id").alias("seq"), F.col("user_id").cast("string").alias("key"), F.col("event_type").alias("elem"), F.col("value").alias("score"),
        F.col("value").cast("string").alias("val"), F.unix_millis(F.col("ts").cast("timestamp")).alias("at_ms"),
    )


EV = "SELECT event_id AS seq, CAST(user_id AS VARCHAR) AS key, event_type AS elem, value AS score, (epoch_us(ts) // 1000) AS at_ms FROM events"


def as_log(rows: DataFrame, op: Column, replaces: Column | bool = False, elem: str | None = "elem", val: str | None = None, score: str | None = None, ttl_ms: Column | None = None) -> DataFrame:
    none = lambda kind: F.lit(None).cast(kind)
    pick = lambda c, kind: F.col(c).cast(kind) if c else none(kind)
    return rows.select(
        F.lit(0).alias("shard"), F.col("seq").cast("long").alias("seq"), F.lit(0).alias("ord"), none("long").alias("batch"), F.col("at_ms").alias("appended_at_ms"), op.alias("op"), "key",
        pick(elem, "string").alias("elem"), pick(val, "string").alias("val"), pick(score, "double").alias("score"), (none("long") if ttl_ms is None else ttl_ms).alias("ttl_ms"),
        (F.lit(replaces) if isinstance(replaces, bool) else replaces).alias("replaces_state"),
    )


def strings(spark: SparkSession, sf: str) -> Keyspace:
    """Users' last values, as strings."""
    return Keyspace(*fold(as_log(events(spark, sf), F.lit("SET"), True, elem=None, val="val"), written=True), now_ms=NOW)


def first_of_key() -> Column:
    return F.row_number().over(Window.partitionBy("key").orderBy("seq")) == 1


def brands(spark: SparkSession, sf: str) -> Keyspace:
    """Parts by brand, scored by retail price."""
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("seq"), F.col("p_brand").alias("key"), F.col("p_partkey").cast("string").alias("elem"), F.col("p_retailprice").alias("score"), F.lit(0).cast("long").alias("at_ms"))
    return Keyspace(*fold(as_log(p.withColumn("_f", first_of_key()), F.lit("ZADD"), F.col("_f"), score="score"), written=True))


def nations(spark: SparkSession, sf: str) -> Keyspace:
    """Customers as members of their nation's set."""
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("seq"), F.col("c_nationkey").cast("string").alias("key"), F.col("c_custkey").cast("string").alias("elem"), F.lit(0).cast("long").alias("at_ms"))
    return Keyspace(*fold(as_log(c.withColumn("_f", first_of_key()), F.lit("SADD"), F.col("_f")), written=True))


def customers(spark: SparkSession, sf: str) -> Keyspace:
    """Customers as hashes of their name, segment and nation."""
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("seq"), F.col("c_custkey").cast("string").alias("key"), F.expr("stack(3, 'c_name', c_name, 'c_mktsegment', c_mktsegment, 'c_nationkey', cast(c_nationkey as string)) as (elem, val)"), F.lit(0).cast("long").alias("at_ms"))
    return Keyspace(*fold(as_log(c, F.lit("HSET"), True, val="val"), written=True))


HASHES = "SELECT CAST(c_custkey AS VARCHAR) AS key, unnest(['c_name', 'c_mktsegment', 'c_nationkey']) AS elem, unnest([c_name, c_mktsegment, CAST(c_nationkey AS VARCHAR)]) AS val FROM customer"


def each_key(keys: DataFrame, key: str) -> DataFrame:
    return keys.select(F.col(key).cast("string").alias("key")).distinct().withColumn("req_id", F.col("key"))


def literal(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


# --- strings ---------------------------------------------------------------


@query(f"WITH e AS ({EV}) SELECT key, arg_max(score, seq) AS value, max(seq) AS seq FROM e GROUP BY key")
def get_lww(spark, sf):
    ks = strings(spark, sf)
    got = reads.get(ks, each_key(table(spark, sf, "events"), "user_id"))
    return got.join(ks.meta, got["req_id"] == ks.meta["key"]).select("key", F.col("val").cast("double").alias("value"), F.col("latest_seq").alias("seq"))


@query(f"WITH e AS ({EV}) SELECT key, arg_max(score, seq) AS value FROM e GROUP BY key")
def set_last(spark, sf):
    return writes.set_last(events(spark, sf).select("key", "score", "seq")).select("key", F.col("score").alias("value"))


@query(f"WITH e AS ({EV}) SELECT key, arg_min(score, seq) AS value, min(seq) AS seq FROM e GROUP BY key")
def set_nx_first(spark, sf):
    return writes.set_if_absent(events(spark, sf).select("key", "score", "seq")).select("key", F.col("score").alias("value"), "seq")


@query(f"WITH e AS ({EV}) SELECT seq, CAST(row_number() OVER (PARTITION BY key ORDER BY seq) = 1 AS BIGINT) AS reply FROM e")
def setnx_replies(spark, sf):
    return writes.set_if_absent_replies(events(spark, sf)).select("seq", "reply")


@query(f"WITH e AS ({EV}), f AS (SELECT *, min(CASE WHEN elem = 'signup' THEN seq END) OVER (PARTITION BY key) AS f FROM e) SELECT key, arg_max(score, seq) AS value FROM f WHERE seq >= f GROUP BY key")
def set_xx_after_create(spark, sf):
    e = events(spark, sf).select("key", "score", "elem", "seq")
    return writes.set_if_present(e, F.col("elem") == "signup").select("key", F.col("score").alias("value"))


@query(f"WITH e AS ({EV}) SELECT seq, lag(score) OVER (PARTITION BY key ORDER BY seq) AS old FROM e")
def set_get_old(spark, sf):
    return writes.set_get(events(spark, sf), "score").select("seq", "old")


@query(f"WITH e AS ({EV}) SELECT seq, coalesce(last_value(CASE WHEN elem = 'signup' THEN at_ms + 1000 END IGNORE NULLS) OVER (PARTITION BY key ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS ttl_ms FROM e")
def set_keepttl(spark, sf):
    e = events(spark, sf).withColumn("ttl_ms", F.col("at_ms") + 1000)
    return writes.set_keepttl(e, F.col("elem") == "signup").select("seq", "ttl_ms")


KEYS = ["7", "missing", "3", "7", "12"]


@query(f"WITH e AS ({EV}), v AS (SELECT key, arg_max(score, seq) AS value FROM e GROUP BY key), k AS (SELECT unnest(['7','missing','3','7','12']) AS key, unnest([0,1,2,3,4]) AS pos) SELECT k.pos, v.value FROM k LEFT JOIN v USING (key)")
def mget_positional(spark, sf):
    got = reads.mget(strings(spark, sf), literal(spark, [(1, KEYS)], "req_id int, keys array<string>"))
    return got.select("pos", F.col("val").cast("double").alias("value"))


@query("SELECT 1 AS req_id, count(*) AS n FROM (SELECT unnest(['7','missing','3','7','12']) AS key) WHERE key IN (SELECT CAST(user_id AS VARCHAR) FROM events)")
def exists_count(spark, sf):
    return reads.exists(strings(spark, sf), literal(spark, [(1, KEYS)], "req_id int, keys array<string>"))


@query("SELECT o_orderkey AS req_id, CAST(o_custkey * 2 IN (SELECT c_custkey FROM customer) AS BIGINT) AS n FROM orders")
def exists_semi(spark, sf):
    reqs = table(spark, sf, "orders").select(F.col("o_orderkey").alias("req_id"), F.array((F.col("o_custkey") * 2).cast("string")).alias("keys"))
    return reads.exists(customers(spark, sf), reqs)


@query(f"WITH e AS ({EV}) SELECT key, CAST(octet_length(encode(arg_max(elem, seq))) AS BIGINT) AS n FROM e GROUP BY key")
def strlen(spark, sf):
    ks = Keyspace(*fold(as_log(events(spark, sf), F.lit("SET"), True, elem=None, val="elem")))
    return reads.strlen(ks, each_key(table(spark, sf, "events"), "user_id")).select(F.col("req_id").alias("key"), "n")


@query("SELECT o_custkey AS batch, o_orderkey AS key, arg_max(o_totalprice, o_orderkey) AS val FROM orders GROUP BY 1, 2")
def mset_pairs(spark, sf):
    o = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("seq")).agg(F.sort_array(F.collect_list(F.struct(F.col("o_orderkey").alias("key"), F.col("o_totalprice").alias("val")))).alias("pairs"))
    return writes.mset_rows(o).groupBy("batch", "key").agg(F.max_by("val", "ord").alias("val"))


@query("SELECT o_custkey AS batch, CASE WHEN bool_or(o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 49)) THEN 0 ELSE 1 END::BIGINT AS reply FROM orders GROUP BY 1")
def msetnx_batches(spark, sf):
    held = table(spark, sf, "lineitem").where("l_quantity > 49").select(F.col("l_orderkey").alias("key")).distinct()
    return writes.msetnx(table(spark, sf, "orders").select(F.col("o_custkey").alias("batch"), F.col("o_orderkey").alias("key")), held)


# --- deletion, types, expiry -------------------------------------------------


@query("SELECT CAST(c_custkey AS VARCHAR) AS key FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 16 = 0)")
def del_anti(spark, sf):
    return writes.delete(customers(spark, sf).meta, table(spark, sf, "orders").where("o_orderkey % 16 = 0").select(F.col("o_custkey").cast("string").alias("key"))).select("key")


@query("SELECT CAST(o_orderdate::DATE AS VARCHAR) AS req_id, count(DISTINCT o_custkey) AS n FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer) GROUP BY 1 UNION ALL SELECT CAST(o_orderdate::DATE AS VARCHAR), 0 FROM orders GROUP BY 1 HAVING count(*) FILTER (o_custkey IN (SELECT c_custkey FROM customer)) = 0")
def del_counts(spark, sf):
    reqs = table(spark, sf, "orders").groupBy(F.to_date("o_orderdate").cast("string").alias("req_id")).agg(F.collect_list(F.col("o_custkey").cast("string")).alias("keys"))
    return writes.deleted(customers(spark, sf).meta, reqs)


@query(f"WITH e AS ({EV}), r AS (SELECT *, max(CASE WHEN elem = 'error' THEN seq END) OVER (PARTITION BY key) AS d FROM e) SELECT key, arg_max(score, seq) AS value FROM r WHERE d IS NULL OR seq > d GROUP BY key")
def del_refold(spark, sf):
    e = events(spark, sf)
    op = F.when(F.col("elem") == "error", "DEL").otherwise("SET")
    element, _ = fold(as_log(e, op, True, elem=None, val="val"))
    return element.select("key", F.col("val").cast("double").alias("value"))


@query(f"WITH e AS ({EV}), l AS (SELECT key, max(at_ms) + 86400000 * 5 AS t FROM e GROUP BY key), n AS (SELECT max(at_ms) + 86400000 * 5 - 600000 AS now FROM e) SELECT key, CASE WHEN now < t THEN 'string' ELSE 'none' END AS type, CASE WHEN now < t THEN (t - now + 500) // 1000 ELSE -2 END::BIGINT AS ttl, CASE WHEN now < t THEN t - now ELSE -2 END::BIGINT AS pttl, CASE WHEN now < t THEN t ELSE -2 END::BIGINT AS pexpiretime FROM l, n")
def type_ttl_pttl(spark, sf):
    e = events(spark, sf)
    now = e.agg(F.max("at_ms")).first()[0] + 86_400_000 * 5 - 600_000
    ks = Keyspace(*fold(as_log(e, F.lit("SET"), True, elem=None, val="val", ttl_ms=F.col("at_ms") + 86_400_000 * 5)), now_ms=now)
    r = each_key(table(spark, sf, "events"), "user_id")
    out = reads.type_of(ks, r).join(reads.ttl(ks, r), "req_id").join(reads.ttl(ks, r, millis=True).withColumnRenamed("ttl", "pttl"), "req_id")
    return out.join(reads.expiretime(ks, r, millis=True), "req_id").select(F.col("req_id").alias("key"), "type", "ttl", "pttl", F.col("at").alias("pexpiretime"))


@query(f"WITH e AS ({EV}), s AS (SELECT key, min(at_ms) AS t0 FROM e GROUP BY key), x AS (SELECT e.key, greatest(max(at_ms + CAST(floor(score) AS BIGINT) * 1000), t0) AS hi FROM e JOIN s USING (key) GROUP BY e.key, t0) SELECT key, hi AS ttl_ms FROM x")
def expire_gt(spark, sf):
    e = events(spark, sf).withColumn("start_ms", F.min("at_ms").over(Window.partitionBy("key"))).withColumn("ttl_ms", F.col("at_ms") + F.floor("score") * 1000)
    return writes.expire_from(e, "GT").select("key", "ttl_ms")


@query(f"WITH e AS ({EV}), t AS (SELECT *, at_ms + CAST(floor(score) AS BIGINT) * 1000 AS ttl_ms FROM e), b AS (SELECT *, min(ttl_ms) OVER (PARTITION BY key ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM t) SELECT seq, least(ttl_ms, b) AS after, CAST(b IS NULL OR ttl_ms < b AS BIGINT) AS reply FROM b")
def expire_lt(spark, sf):
    e = events(spark, sf).withColumn("ttl_ms", F.col("at_ms") + F.floor("score") * 1000)
    return writes.expire(e, "LT").select("seq", "after", "reply")


@query(f"WITH e AS ({EV}), l AS (SELECT key, arg_max(elem, seq) AS last FROM e GROUP BY key) SELECT key, CAST(last = 'signup' AS BIGINT) AS reply FROM l")
def persist_replies(spark, sf):
    ms = F.when(F.col("elem") == "signup", F.col("at_ms") + 1000).otherwise(0)
    _, meta = fold(as_log(events(spark, sf), F.lit("SET"), True, elem=None, val="val", ttl_ms=ms))
    return writes.persist(meta, meta.select("key"))


# --- sets --------------------------------------------------------------------


@query("SELECT CAST(c_nationkey AS VARCHAR) AS key, count(DISTINCT c_custkey) AS n FROM customer GROUP BY 1")
def scard(spark, sf):
    return reads.card(nations(spark, sf), each_key(table(spark, sf, "customer"), "c_nationkey"), "set").select(F.col("req_id").alias("key"), "n")


@query("SELECT CAST(c_nationkey AS VARCHAR) AS key, CAST(c_custkey AS VARCHAR) AS elem FROM customer")
def smembers(spark, sf):
    return reads.members(nations(spark, sf), each_key(table(spark, sf, "customer"), "c_nationkey")).select(F.col("req_id").alias("key"), "elem")


@query("SELECT s_suppkey AS req_id, CAST(EXISTS (SELECT 1 FROM customer WHERE c_nationkey = s_nationkey AND c_custkey = s_suppkey) AS BIGINT) AS n FROM supplier")
def sismember(spark, sf):
    reqs = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("req_id"), F.col("s_nationkey").cast("string").alias("key"), F.col("s_suppkey").cast("string").alias("elem"))
    return reads.is_member(nations(spark, sf), reqs).select("req_id", "n")


@query("SELECT n_nationkey AS req_id, p.pos, CAST(EXISTS (SELECT 1 FROM customer WHERE c_nationkey = n_nationkey AND c_custkey = p.pos * 7) AS BIGINT) AS n FROM nation, (SELECT unnest([0,1,2,3]) AS pos) p")
def smismember(spark, sf):
    reqs = table(spark, sf, "nation").select(F.col("n_nationkey").alias("req_id"), F.col("n_nationkey").cast("string").alias("key"), F.array(*[F.lit(str(i * 7)) for i in range(4)]).alias("elems"))
    return reads.smismember(nations(spark, sf), reqs)


@query(None)
def srandmember(spark, sf):
    return reads.srandmember(nations(spark, sf), each_key(table(spark, sf, "customer"), "c_nationkey"), 3, seed=1)


@query("SELECT CAST(c_nationkey AS VARCHAR) AS key, count(DISTINCT o_custkey) AS added FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 200000 GROUP BY 1")
def sadd_new(spark, sf):
    c, o = table(spark, sf, "customer"), table(spark, sf, "orders").where("o_totalprice > 200000")
    adds = o.join(c, o["o_custkey"] == c["c_custkey"]).select(F.col("c_nationkey").cast("string").alias("key"), F.concat(F.lit("rich:"), F.col("o_custkey").cast("string")).alias("elem"))
    return writes.sadd(nations(spark, sf).element.select("key", "elem"), adds)[1]


@query("SELECT CAST(c_nationkey AS VARCHAR) AS key, CAST(c_custkey AS VARCHAR) AS elem FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 16 = 0)")
def srem_set(spark, sf):
    c, o = table(spark, sf, "customer"), table(spark, sf, "orders").where("o_orderkey % 16 = 0")
    gone = o.join(c, o["o_custkey"] == c["c_custkey"]).select(F.col("c_nationkey").cast("string").alias("key"), F.col("o_custkey").cast("string").alias("elem"))
    return writes.remove(nations(spark, sf).element.select("key", "elem"), gone)[0]


# --- sorted sets -------------------------------------------------------------


@query(f"WITH e AS ({EV}) SELECT key, elem, arg_max(score, seq) AS score FROM e GROUP BY key, elem")
def zadd_lww(spark, sf):
    e = events(spark, sf).withColumn("_f", first_of_key())
    return fold(as_log(e, F.lit("ZADD"), F.col("_f"), score="score"))[0].select("key", "elem", "score")


def _zadd(rule: str, op: str, frame: str = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING") -> str:
    keep = {"GT": "greatest(score, b)", "LT": "least(score, b)", "NX": "coalesce(b, score)", "": "score"}[rule]
    return f"""WITH e AS ({EV}), x AS (SELECT *, {op}(score) OVER (PARTITION BY key, elem ORDER BY seq {frame}) AS b FROM e), y AS (SELECT seq, b AS before, {keep} AS after FROM x)
SELECT seq, after, CAST(before IS NULL AS BIGINT) AS added, CAST(before IS NOT NULL AND after <> before AS BIGINT) AS changed FROM y"""


@query(_zadd("GT", "max"))
def zadd_gt(spark, sf):
    return writes.zadd(events(spark, sf), "GT").select("seq", "after", "added", "changed")


@query(_zadd("LT", "min"))
def zadd_lt(spark, sf):
    return writes.zadd(events(spark, sf), "LT").select("seq", "after", "added", "changed")


@query(_zadd("NX", "first_value"))
def zadd_nx(spark, sf):
    return writes.zadd(events(spark, sf), "NX").select("seq", "after", "added", "changed")


@query(f"WITH e AS ({EV}), x AS (SELECT *, lag(score) OVER (PARTITION BY key, elem ORDER BY seq) AS b FROM e) SELECT key, CAST(sum(CAST(b IS NULL OR b <> score AS BIGINT)) AS BIGINT) AS ch FROM x GROUP BY key")
def zadd_ch(spark, sf):
    return writes.zadd(events(spark, sf)).groupBy("key").agg(F.sum(F.col("added") + F.col("changed")).alias("ch"))


@query(f"WITH e AS ({EV}), f AS (SELECT *, min(CASE WHEN score > 50 THEN seq END) OVER (PARTITION BY key, elem) AS f FROM e) SELECT key, elem, arg_max(score, seq) AS score FROM f WHERE seq >= f GROUP BY key, elem")
def zadd_xx(spark, sf):
    z = writes.zadd(events(spark, sf), "XX", F.col("score") > 50).where("after is not null")
    return z.groupBy("key", "elem").agg(F.max_by("after", "seq").alias("score"))


@query("SELECT p_partkey AS req_id, p_retailprice AS score FROM part")
def zscore(spark, sf):
    reqs = table(spark, sf, "part").select(F.col("p_partkey").alias("req_id"), F.col("p_brand").alias("key"), F.col("p_partkey").cast("string").alias("elem"))
    return reads.zscore(brands(spark, sf), reqs).select("req_id", "score")


@query("SELECT b.p_brand AS req_id, k.pos, (SELECT p_retailprice FROM part p WHERE p.p_brand = b.p_brand AND p.p_partkey = k.pos * 11 + 1) AS score FROM (SELECT DISTINCT p_brand FROM part) b, (SELECT unnest([0,1,2]) AS pos) k")
def zmscore(spark, sf):
    reqs = each_key(table(spark, sf, "part"), "p_brand").withColumn("elems", F.array(*[F.lit(str(i * 11 + 1)) for i in range(3)]))
    return reads.zmscore(brands(spark, sf), reqs)


@query("SELECT p_brand AS key, count(*) AS n FROM part GROUP BY 1")
def zcard(spark, sf):
    return reads.card(brands(spark, sf), each_key(table(spark, sf, "part"), "p_brand"), "zset").select(F.col("req_id").alias("key"), "n")


def _ranked(order: str) -> str:
    return f"SELECT p_brand AS key, CAST(p_partkey AS VARCHAR) AS elem, p_retailprice AS score, row_number() OVER (PARTITION BY p_brand ORDER BY {order}) - 1 AS rank, count(*) OVER (PARTITION BY p_brand) AS n FROM part"


ASC, DESC = "p_retailprice, CAST(p_partkey AS VARCHAR)", "p_retailprice DESC, CAST(p_partkey AS VARCHAR) DESC"


def _range(spark, sf, start, stop):
    return each_key(table(spark, sf, "part"), "p_brand").withColumn("start", F.lit(start)).withColumn("stop", F.lit(stop))


@query(f"SELECT key, rank, elem, score FROM ({_ranked(ASC)}) WHERE rank BETWEEN 2 AND 9")
def zrange_idx(spark, sf):
    return reads.zrange_index(brands(spark, sf), _range(spark, sf, 2, 9)).withColumnRenamed("req_id", "key")


@query(f"SELECT key, rank, elem, score FROM ({_ranked(DESC)}) WHERE rank BETWEEN 0 AND 4")
def zrange_rev(spark, sf):
    return reads.zrange_index(brands(spark, sf), _range(spark, sf, 0, 4), rev=True).withColumnRenamed("req_id", "key")


@query(f"SELECT key, rank, elem, score FROM ({_ranked(ASC)}) WHERE rank BETWEEN n - 3 AND n - 1")
def zrange_neg(spark, sf):
    return reads.zrange_index(brands(spark, sf), _range(spark, sf, -3, -1)).withColumnRenamed("req_id", "key")


@query("SELECT key, list_aggregate(list(x ORDER BY rank), 'string_agg', ' ') AS reply FROM (SELECT key, rank, elem || ' ' || printf('%.17g', score) AS x FROM (" + _ranked(ASC) + ") WHERE rank <= 2) GROUP BY key")
def zrange_withscores(spark, sf):
    rows = reads.zrange_index(brands(spark, sf), _range(spark, sf, 0, 2))
    return reads.with_scores(rows).select(F.col("req_id").alias("key"), F.array_join("arr", " ").alias("reply"))


def _bounds(spark, sf, low, high):
    return each_key(table(spark, sf, "part"), "p_brand").withColumn("min", F.lit(low)).withColumn("max", F.lit(high))


@query(f"SELECT key, CAST(row_number() OVER (PARTITION BY key ORDER BY score, elem) - 1 AS BIGINT) AS rank, elem, score FROM ({_ranked(ASC)}) WHERE score > 940 AND score <= 960")
def zrangebyscore_excl(spark, sf):
    return reads.zrange_score(brands(spark, sf), _bounds(spark, sf, "(940", "960")).select(F.col("req_id").alias("key"), "rank", "elem", "score")


@query(f"SELECT key, r AS rank, elem, score FROM (SELECT *, CAST(row_number() OVER (PARTITION BY key ORDER BY score DESC, elem DESC) - 3 AS BIGINT) AS r FROM ({_ranked(ASC)}) WHERE score >= 950) WHERE r BETWEEN 0 AND 3")
def zrangebyscore_rev_limit(spark, sf):
    return reads.zrange_score(brands(spark, sf), _bounds(spark, sf, "+inf", "950"), rev=True, offset=2, count=4).select(F.col("req_id").alias("key"), "rank", "elem", "score")


@query(f"SELECT key, CAST(row_number() OVER (PARTITION BY key ORDER BY elem) - 1 AS BIGINT) AS rank, elem FROM ({_ranked(ASC)}) WHERE elem >= '12' AND elem < '3'")
def zrangebylex(spark, sf):
    return reads.zrange_lex(brands(spark, sf), _bounds(spark, sf, "[12", "(3")).select(F.col("req_id").alias("key"), "rank", "elem")


@query("SELECT b.p_brand AS key, (SELECT count(*) FROM part p WHERE p.p_brand = b.p_brand AND p_retailprice > 930 AND p_retailprice < 970) AS n, (SELECT count(*) FROM part p WHERE p.p_brand = b.p_brand AND CAST(p_partkey AS VARCHAR) >= '15') AS nlex FROM (SELECT DISTINCT p_brand FROM part) b")
def zcount_zlexcount(spark, sf):
    ks = brands(spark, sf)
    a = reads.zcount(ks, _bounds(spark, sf, "(930", "(970"))
    b = reads.zlexcount(ks, _bounds(spark, sf, "[15", "+")).withColumnRenamed("n", "nlex")
    return a.join(b, "req_id").select(F.col("req_id").alias("key"), "n", "nlex")


@query(f"SELECT CAST(elem AS BIGINT) AS req_id, rank, n - 1 - rank AS revrank FROM ({_ranked(ASC)})")
def zrank_zrevrank(spark, sf):
    ks = brands(spark, sf)
    reqs = table(spark, sf, "part").select(F.col("p_partkey").alias("req_id"), F.col("p_brand").alias("key"), F.col("p_partkey").cast("string").alias("elem"))
    return reads.zrank(ks, reqs).join(reads.zrank(ks, reqs, rev=True).withColumnRenamed("rank", "revrank"), "req_id")


@query("SELECT p_brand AS key, CAST(p_partkey AS VARCHAR) AS elem FROM part WHERE p_size > 10")
def zrem(spark, sf):
    gone = table(spark, sf, "part").where("p_size <= 10").select(F.col("p_brand").alias("key"), F.col("p_partkey").cast("string").alias("elem"))
    return writes.remove(brands(spark, sf).element.select("key", "elem"), gone)[0]


# --- hashes ------------------------------------------------------------------


@query(HASHES)
def hgetall(spark, sf):
    return reads.members(customers(spark, sf), each_key(table(spark, sf, "customer"), "c_custkey"), "hash").select(F.col("req_id").alias("key"), "elem", "val")


@query("SELECT CAST(c_custkey AS VARCHAR) AS key, ['c_mktsegment', 'c_name', 'c_nationkey'] AS fields, [c_mktsegment, c_name, CAST(c_nationkey AS VARCHAR)] AS vals FROM customer")
def hkeys_hvals_packed(spark, sf):
    p = packed(*_state(customers(spark, sf)))
    e = F.sort_array(F.map_entries("fields"))
    return p.select("key", F.transform(e, lambda x: x["key"]).alias("fields"), F.transform(e, lambda x: x["value"]).alias("vals"))


def _state(ks: Keyspace) -> tuple[DataFrame, DataFrame]:
    return ks.element, ks.meta


@query("SELECT o_orderkey AS req_id, c_name AS val FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def hget(spark, sf):
    reqs = table(spark, sf, "orders").select(F.col("o_orderkey").alias("req_id"), F.col("o_custkey").cast("string").alias("key"), F.lit("c_name").alias("elem"))
    return reads.hget(customers(spark, sf), reqs).select("req_id", "val")


@query("SELECT c_custkey AS req_id, p.pos, CASE p.pos WHEN 0 THEN c_mktsegment WHEN 2 THEN c_name END AS val FROM customer, (SELECT unnest([0,1,2]) AS pos) p")
def hmget(spark, sf):
    reqs = table(spark, sf, "customer").select(F.col("c_custkey").alias("req_id"), F.col("c_custkey").cast("string").alias("key"), F.array(F.lit("c_mktsegment"), F.lit("nothing"), F.lit("c_name")).alias("elems"))
    return reads.hmget(customers(spark, sf), reqs)


@query("SELECT o_orderkey AS req_id, CAST(c_custkey IS NOT NULL AS BIGINT) AS n FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def hexists(spark, sf):
    reqs = table(spark, sf, "orders").select(F.col("o_orderkey").alias("req_id"), F.col("o_custkey").cast("string").alias("key"), F.lit("c_name").alias("elem"))
    return reads.is_member(customers(spark, sf), reqs, "hash").select("req_id", "n")


@query("SELECT CAST(c_custkey AS VARCHAR) AS key, 3::BIGINT AS n FROM customer")
def hlen(spark, sf):
    return reads.card(customers(spark, sf), each_key(table(spark, sf, "customer"), "c_custkey"), "hash").select(F.col("req_id").alias("key"), "n")


@query(f"WITH e AS ({EV}) SELECT key, elem, arg_max(score, seq) AS val FROM e GROUP BY key, elem")
def hset_merge(spark, sf):
    e = events(spark, sf).withColumn("_f", first_of_key())
    return fold(as_log(e, F.lit("HSET"), F.col("_f"), val="val"))[0].select("key", "elem", F.col("val").cast("double").alias("val"))


@query(f"WITH e AS ({EV}) SELECT key, elem, arg_min(score, seq) AS val FROM e GROUP BY key, elem")
def hsetnx_first(spark, sf):
    return writes.set_if_absent(events(spark, sf).select("key", "elem", "score", "seq"), ("key", "elem")).select("key", "elem", F.col("score").alias("val"))


@query(f"SELECT key, elem, val FROM ({HASHES}) WHERE elem <> 'c_nationkey' OR val NOT IN ('1', '3', '5')")
def hdel(spark, sf):
    ks = customers(spark, sf)
    gone = ks.element.where("elem = 'c_nationkey' and val in ('1', '3', '5')").select("key", "elem")
    return writes.remove(ks.element.select("key", "elem", "val"), gone)[0].select("key", "elem", "val")


# --- moving, flushing, routing -------------------------------------------------


def _nation_strings(spark, sf) -> Keyspace:
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("seq"), F.concat(F.lit("n:"), F.col("n_nationkey").cast("string")).alias("key"), F.col("n_name").alias("val"), F.lit(0).cast("long").alias("at_ms"))
    return Keyspace(*fold(as_log(n, F.lit("SET"), True, elem=None, val="val")))


@query("SELECT 'n:' || n_nationkey AS key, n_name AS val FROM nation UNION ALL SELECT 'copy:' || n_nationkey, n_name FROM nation WHERE n_regionkey = 1")
def copy_keys(spark, sf):
    ks = _nation_strings(spark, sf)
    pairs = table(spark, sf, "nation").where("n_regionkey = 1").select(F.concat(F.lit("n:"), F.col("n_nationkey").cast("string")).alias("src"), F.concat(F.lit("copy:"), F.col("n_nationkey").cast("string")).alias("dst"))
    return writes.copy(ks.element, ks.meta, pairs)[0].select("key", "val")


@query("SELECT CASE WHEN n_regionkey = 2 THEN 'moved:' || n_nationkey ELSE 'n:' || n_nationkey END AS key, n_name AS val FROM nation")
def renamenx_keys(spark, sf):
    ks = _nation_strings(spark, sf)
    pairs = table(spark, sf, "nation").where("n_regionkey = 2").select(F.concat(F.lit("n:"), F.col("n_nationkey").cast("string")).alias("src"), F.concat(F.lit("moved:"), F.col("n_nationkey").cast("string")).alias("dst"))
    return writes.renamenx(ks.element, ks.meta, pairs)[0].select("key", "val")


@query(f"WITH e AS ({EV}), k AS (SELECT max(seq) // 2 AS k FROM e) SELECT key, arg_max(score, seq) AS value FROM e, k WHERE seq > k GROUP BY key")
def flush_floor(spark, sf):
    e = events(spark, sf)
    k = e.agg(F.floor(F.max("seq") / 2).alias("k")).first().k
    log = as_log(e.where(F.col("seq") != k).unionByName(e.where(F.col("seq") == k)), F.when(F.col("seq") == k, "FLUSH").otherwise("SET"), True, elem=None, val="val")
    return fold(log)[0].select("key", F.col("val").cast("double").alias("value"))


def _slot_sql(key: str) -> str:
    """The slot of an ASCII key: CRC16 of its hash tag, bit by bit."""
    tag = f"CASE WHEN regexp_extract({key}, '^[^{{]*[{{]([^}}]+)[}}]', 1) <> '' THEN regexp_extract({key}, '^[^{{]*[{{]([^}}]+)[}}]', 1) ELSE {key} END"
    bit = "list_reduce(list_prepend(xor(crc, b << 8), range(8)), lambda x, i: CASE WHEN x & 32768 > 0 THEN xor(x << 1, 4129) & 65535 ELSE (x << 1) & 65535 END)"
    return f"CAST(list_reduce(list_prepend(0::BIGINT, list_transform(string_split({tag}, ''), lambda c: ascii(c)::BIGINT)), lambda crc, b: {bit}) % 16384 AS INTEGER)"


SEGMENT = "SELECT '{' || c_mktsegment || '}:' || c_custkey AS key FROM customer"


@query(f"SELECT key, {_slot_sql('key')} AS slot, CAST({_slot_sql('key')} * 64 // 16384 AS INTEGER) AS shard FROM ({SEGMENT})")
def slot_shard(spark, sf):
    k = table(spark, sf, "customer").select(F.concat(F.lit("{"), F.col("c_mktsegment"), F.lit("}:"), F.col("c_custkey").cast("string")).alias("key"))
    return k.select("key", routing.slot(F.col("key")).alias("slot"), routing.shard(F.col("key"), 64).alias("shard"))


@query("SELECT CAST(s * 10 // 16384 AS INTEGER) AS shard, CAST(min(s) AS INTEGER) AS first_slot, CAST(max(s) AS INTEGER) AS last_slot FROM (SELECT unnest(range(16384)) AS s) GROUP BY 1")
def cluster_slots(spark, sf):
    return routing.cluster_slots(spark, 10)


@query(f"SELECT c_custkey AS id, CAST({_slot_sql('c_mktsegment || c_custkey')} * 64 // 16384 AS INTEGER) % 4 <> CAST({_slot_sql('CAST(c_custkey AS VARCHAR)')} * 64 // 16384 AS INTEGER) % 4 AS crosses FROM customer")
def cross_log_keys(spark, sf):
    k = F.array(F.concat("c_mktsegment", F.col("c_custkey").cast("string")), F.col("c_custkey").cast("string"))
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), routing.crosses_logs(k, 64, 4).alias("crosses"))


@query(f"SELECT key, shard FROM (SELECT CAST(user_id AS VARCHAR) AS key, CAST(user_id % 8 AS INTEGER) AS shard, {_slot_sql('CAST(user_id AS VARCHAR)')} * 8 // 16384 AS own FROM events) WHERE shard <> own GROUP BY ALL")
def misplaced_rows(spark, sf):
    log = as_log(events(spark, sf), F.lit("SET"), True).withColumn("shard", (F.col("key").cast("long") % 8).cast("int"))
    return misplaced(log, 8).select("key", "shard").distinct()


@query(f"SELECT {_slot_sql('CAST(c_custkey AS VARCHAR)')} AS slot, count(*) AS n FROM customer GROUP BY 1")
def count_keys_in_slot(spark, sf):
    return customers(spark, sf).meta.groupBy(routing.slot(F.col("key")).alias("slot")).agg(F.count("*").alias("n"))


@query("SELECT c_mktsegment || ':' || c_custkey AS key, CASE WHEN starts_with(c_mktsegment, 'AUTO') THEN 60 WHEN starts_with(c_mktsegment, 'BUILDING:1') THEN 600 WHEN starts_with(c_mktsegment || ':' || c_custkey, 'BUILDING:1') THEN 600 WHEN starts_with(c_mktsegment, 'B') THEN 300 ELSE 86400 END AS seconds FROM customer")
def evict_prefix(spark, sf):
    k = table(spark, sf, "customer").select(F.concat(F.col("c_mktsegment"), F.lit(":"), F.col("c_custkey").cast("string")).alias("key"))
    return k.select("key", routing.eviction_seconds(F.col("key"), [("B", 300), ("BUILDING:1", 600), ("AUTO", 60)]).alias("seconds"))


@query("SELECT count(*) AS keys FROM customer")
def dbsize(spark, sf):
    return ttl.live(customers(spark, sf).meta, NOW).agg(F.count("*").alias("keys"))


# --- compaction and merging ----------------------------------------------------


def _typed_log(e: DataFrame) -> DataFrame:
    """Adds and removals of event types in users' sets: an 'error' removes 'click' and adds itself."""
    add = as_log(e.withColumn("_f", first_of_key()), F.lit("SADD"), F.col("_f"))
    return add.unionByName(as_log(e.where("elem = 'error'").withColumn("elem", F.lit("click")), F.lit("SREM")).withColumn("ord", F.lit(1)))


def _last_effects(src: str) -> str:
    return f"""x AS (SELECT key, seq, 0 AS ord, elem, true AS add FROM {src} UNION ALL SELECT key, seq, 1, 'click', false FROM {src} WHERE elem = 'error'),
l AS (SELECT key, elem, arg_max(add, seq * 2 + ord) AS add FROM x GROUP BY key, elem)"""


@query(f"WITH e AS ({EV}), {_last_effects('e')}, n AS (SELECT key, count(*) AS write_count, min(seq) AS first_seq, max(seq) AS last_seq FROM e GROUP BY key) SELECT key, (SELECT count(*) FROM l WHERE l.key = n.key AND add) AS adds, write_count, first_seq, last_seq FROM n")
def compact_delta(spark, sf):
    d = compact.deltas(_typed_log(events(spark, sf)))
    return d.select("key", F.size("adds").cast("bigint").alias("adds"), "write_count", "first_seq", "last_seq")


@query(f"WITH e0 AS ({EV}), e AS (SELECT * FROM e0 WHERE seq >= 100), {_last_effects('e')} SELECT key, sum(CAST(add AS BIGINT))::BIGINT AS adds, sum(CAST(NOT add AS BIGINT))::BIGINT AS removes FROM l GROUP BY key")
def compact_partial(spark, sf):
    e = events(spark, sf).where("seq >= 100")
    log = _typed_log(e).withColumn("replaces_state", F.lit(False))
    return compact.deltas(log).select("key", F.size("adds").cast("bigint").alias("adds"), F.size("removes").cast("bigint").alias("removes"))


@query(f"WITH e AS ({EV}), s AS (SELECT key, arg_max(score, seq) AS v, max(at_ms) + 5000 AS ttl_ms FROM e GROUP BY key) SELECT key, 0 AS ord, 'SET' AS op, v AS val, ttl_ms FROM s")
def compact_emit(spark, sf):
    d = compact.deltas(as_log(events(spark, sf), F.lit("SET"), True, elem=None, val="val", ttl_ms=F.col("at_ms") + 5000))
    return compact.emitted(d).select("key", "ord", "op", F.col("val").cast("double").alias("val"), "ttl_ms")


QUIET = 6 * 3_600_000


@query(f"WITH e AS ({EV}), g AS (SELECT *, CASE WHEN at_ms - lag(at_ms) OVER w >= {QUIET} OR lag(at_ms) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM e WINDOW w AS (PARTITION BY key ORDER BY at_ms, seq)), s AS (SELECT *, sum(new) OVER (PARTITION BY key ORDER BY at_ms, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS session FROM g) SELECT key, min(at_ms) AS first_seen, max(at_ms) AS last_modified, count(*) AS writes, least(max(at_ms) + {QUIET}, min(at_ms) + 82800000) AS flush_at, CASE WHEN max(at_ms) + {QUIET} <= min(at_ms) + 82800000 THEN 'quiet' ELSE 'deadline' END AS reason FROM s GROUP BY key, session")
def session_flush(spark, sf):
    s = compact.sessions(events(spark, sf), QUIET)
    at = compact.flush_at(F.col("first_seen"), F.col("last_modified"), F.lit(86400), QUIET // 1000, 3600)
    return s.select("key", "first_seen", "last_modified", "writes", at["at_ms"].alias("flush_at"), at["reason"].alias("reason"))


@query(f"""WITH RECURSIVE e AS ({EV}), t AS (SELECT key, at_ms, seq, row_number() OVER (PARTITION BY key ORDER BY at_ms, seq) AS i, lag(at_ms) OVER (PARTITION BY key ORDER BY at_ms, seq) AS p FROM e),
r AS (SELECT key, i, at_ms, at_ms AS a FROM t WHERE i = 1 UNION ALL SELECT t.key, t.i, t.at_ms, CASE WHEN t.at_ms - t.p >= {QUIET} OR t.at_ms >= r.a + 40000000 THEN t.at_ms ELSE r.a END FROM r JOIN t ON t.key = r.key AND t.i = r.i + 1)
SELECT reason, count(*) AS flushes, sum(writes)::BIGINT AS writes FROM (SELECT key, a, count(*) AS writes, CASE WHEN max(at_ms) + {QUIET} <= a + 40000000 THEN 'quiet' ELSE 'deadline' END AS reason FROM r GROUP BY key, a) GROUP BY reason""")
def flush_reasons(spark, sf):
    return compact.flushes(events(spark, sf), QUIET, 40_000_000).groupBy("reason").agg(F.count("*").alias("flushes"), F.sum("writes").alias("writes"))


@query(f"WITH e AS ({EV}) SELECT key, arg_max(score, seq) AS value, max(seq) AS latest_seq FROM e GROUP BY key")
def buffer_over_cold(spark, sf):
    e = events(spark, sf)
    half = e.agg(F.floor(F.max("seq") / 2).alias("k")).first().k
    row = lambda x: as_log(x, F.lit("SET"), True, elem=None, val="val")
    base = fold(row(e.where(F.col("seq") < half)), written=True)
    element, meta = merge.merge(*base, materialize(compact.deltas(row(e.where(F.col("seq") >= half))), "deltas"))
    return element.join(meta.select("key", "latest_seq"), "key").select("key", F.col("val").cast("double").alias("value"), "latest_seq")


@query(f"WITH e AS ({EV}), {_last_effects('e')} SELECT key, elem FROM l WHERE add")
def merge_sets(spark, sf):
    log = _typed_log(events(spark, sf))
    base = fold(log.where("seq < 4000"), written=True)
    return merge.merge(*base, materialize(compact.deltas(log.where("seq >= 4000")), "deltas"))[0].select("key", "elem")


@query(f"WITH e AS ({EV}), {_last_effects('e')} SELECT key, count(*) AS n FROM l WHERE add GROUP BY key")
def merge_cardinality(spark, sf):
    log = _typed_log(events(spark, sf))
    element, meta = fold(log.where("seq < 4000"), written=True)
    return merge.cardinality(element, meta, materialize(compact.deltas(log.where("seq >= 4000")), "deltas"))


@query(f"WITH e AS ({EV}) SELECT key, arg_max(score, seq) AS value, CASE WHEN max(seq) >= 7000 THEN 0 WHEN max(seq) >= 3000 THEN 1 ELSE 2 END AS tier FROM e GROUP BY key")
def tiered_read(spark, sf):
    e = events(spark, sf)
    part = lambda a, z: writes.set_last(e.where((F.col("seq") >= a) & (F.col("seq") < z)).select("key", "score", "seq")).select("key", F.col("score").alias("val"))
    return merge.tiered([part(7000, 1 << 40), part(3000, 7000), part(-1, 3000)]).select("key", F.col("val").alias("value"), "tier")


@query("SELECT CASE WHEN o_custkey % 10 = 0 THEN 'hot' WHEN o_custkey % 3 = 0 THEN 'cold' ELSE 'miss' END AS tier, count(*) AS n FROM orders GROUP BY 1")
def hit_tier(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("key"))
    keys = o.distinct()
    return merge.tier_hits(o, [keys.where("key % 10 = 0"), keys.where("key % 3 = 0")], ["hot", "cold"])


@query("SELECT CAST(c_custkey AS VARCHAR) AS key, 'hash' AS type, 3::BIGINT AS cardinality FROM customer WHERE starts_with(CAST(c_custkey AS VARCHAR), '12')")
def prefix_scan(spark, sf):
    return reads.prefix_scan(customers(spark, sf), "12")


@query(f"WITH e AS ({EV}) SELECT key, max(at_ms) // 1000 + 5 AS at FROM e GROUP BY key")
def expiretime_seconds(spark, sf):
    log = as_log(events(spark, sf), F.lit("SET"), True, elem=None, val="val", ttl_ms=F.col("at_ms") + 5000)
    return reads.expiretime(Keyspace(*fold(log, written=True)), each_key(table(spark, sf, "events"), "user_id")).select(F.col("req_id").alias("key"), "at")


@query(f"WITH e AS ({EV}) SELECT key, CAST(row_number() OVER (PARTITION BY key ORDER BY seq) - 1 AS BIGINT) AS pos, 'HSET' AS name, elem, CAST(seq AS VARCHAR) AS val FROM e")
def resp_decode(spark, sf):
    """Each user's events as a file of wire commands, decoded again."""
    e = events(spark, sf).withColumn("wire", resp.encode_command(F.array(F.lit("HSET"), "key", "elem", F.col("seq").cast("string"))))
    files = e.groupBy(F.col("key").alias("path")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", "wire"))), lambda x: x["wire"]), "").cast("binary").alias("content"))
    return resp.read_commands(files).select(F.col("path").alias("key"), "pos", F.col("args")[0].alias("name"), F.col("args")[2].alias("elem"), F.col("args")[3].alias("val"))


def _halves(spark, sf) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Users' hashes of the last value by event type: the state of the earlier events, and the deltas of the later ones; an 'error' deletes 'click'."""
    e = events(spark, sf)
    log = as_log(e.withColumn("_f", first_of_key()), F.lit("HSET"), F.col("_f"), val="val")
    log = log.unionByName(as_log(e.where("elem = 'error'").withColumn("elem", F.lit("click")), F.lit("HDEL")).withColumn("ord", F.lit(1)))
    return *fold(log.where("seq < 4000"), written=True), materialize(compact.deltas(log.where("seq >= 4000")), "deltas")


LAST = f"""WITH e AS ({EV}), x AS (SELECT key, seq, 0 AS ord, elem, score FROM e UNION ALL SELECT key, seq, 1, 'click', NULL FROM e WHERE elem = 'error'),
l AS (SELECT key, elem, max(struct_pack(o := seq * 2 + ord, v := score)) AS m FROM x GROUP BY key, elem)"""


@query(f"{LAST} SELECT r.key, l.m.v AS value FROM (SELECT DISTINCT key FROM e) r LEFT JOIN l ON l.key = r.key AND l.elem = 'click'")
def read_through(spark, sf):
    element, _, delta = _halves(spark, sf)
    reqs = each_key(table(spark, sf, "events"), "user_id").withColumn("elem", F.lit("click")).withColumn("pos", F.lit(0))
    return merge.member_reads(element, delta, reqs).select(F.col("req_id").alias("key"), F.col("val").cast("double").alias("value"))


@query(f"WITH e AS ({EV}) SELECT key FROM e GROUP BY key HAVING min(seq) < 4000 AND max(seq) >= 4000")
def needs_base(spark, sf):
    return merge.needs_base(_halves(spark, sf)[2])


@query(f"{LAST} SELECT key, 0 AS shard, count(*) AS fields FROM l WHERE m.v IS NOT NULL GROUP BY key")
def merged_shards(spark, sf):
    element, meta = merge.merge(*_halves(spark, sf))
    return element.groupBy("key", "shard").agg(F.count("*").alias("fields")).join(meta.select("key", "shard"), ["key", "shard"])


@query(f"""WITH e AS ({EV}), b AS (SELECT key, max(at_ms) + 5000 AS ttl FROM e WHERE seq < 4000 GROUP BY key),
d AS (SELECT key, arg_max(CASE WHEN elem = 'error' THEN 0 ELSE at_ms + 9000 END, seq) AS ttl FROM e WHERE seq >= 4000 AND elem IN ('error', 'click') GROUP BY key)
SELECT b.key, 'string' AS type, coalesce(d.ttl, b.ttl) AS abs_ttl_ms FROM b LEFT JOIN d USING (key)""")
def metadata_merge(spark, sf):
    """Expiry after later PERSIST and PEXPIREAT, from metadata alone."""
    e = events(spark, sf)
    _, meta = fold(as_log(e.where("seq < 4000"), F.lit("SET"), True, elem=None, val="val", ttl_ms=F.col("at_ms") + 5000))
    later = e.where("seq >= 4000 and elem in ('error', 'click')")
    op = F.when(F.col("elem") == "error", "PERSIST").otherwise("PEXPIREAT")
    delta = compact.deltas(as_log(later, op, elem=None, ttl_ms=F.when(F.col("elem") == "click", F.col("at_ms") + 9000)))
    known = meta.select("key")
    return merge.merged_meta(meta, delta).join(known, "key", "left_semi").withColumn("type", F.coalesce("type", F.lit("string")))


@query(f"""WITH e AS ({EV}), s AS (SELECT DISTINCT key FROM e WHERE seq >= 4000 AND elem = 'error')
SELECT key, 'string' AS type, 1::BIGINT AS n FROM s UNION ALL SELECT key, 'set', count(DISTINCT elem) FROM e WHERE seq < 4000 AND key NOT IN (SELECT key FROM s) GROUP BY key""")
def type_change(spark, sf):
    """Sets over which some keys are set as strings."""
    e = events(spark, sf)
    base = fold(as_log(e.where("seq < 4000").withColumn("_f", first_of_key()), F.lit("SADD"), F.col("_f")), written=True)
    delta = materialize(compact.deltas(as_log(e.where("seq >= 4000 and elem = 'error'"), F.lit("SET"), True, elem=None, val="val")), "deltas")
    return merge.merge(*base, delta)[1].select("key", "type", F.col("cardinality").alias("n"))


@query(f"WITH e AS ({EV}) SELECT key, 'string' AS type, 1::BIGINT AS adds, count(*) AS write_count FROM e GROUP BY key")
def delta_keeps_type(spark, sf):
    """Effects of another type than the last reset's are ignored."""
    e = events(spark, sf).withColumn("_f", first_of_key())
    log = as_log(e.where("_f"), F.lit("SET"), True, elem=None, val="val").unionByName(as_log(e.where("not _f"), F.lit("SADD")))
    return compact.deltas(log).select("key", "type", F.size("adds").cast("bigint").alias("adds"), "write_count")


@query(f"""WITH e AS ({EV}), {_last_effects('e')}, n AS (SELECT key, elem, row_number() OVER (PARTITION BY key ORDER BY elem) AS i, count(*) OVER (PARTITION BY key) AS n FROM l WHERE add)
SELECT key, CAST(i AS INTEGER) AS ord, 'SADD' AS op, elem FROM n UNION ALL SELECT key, 0, 'DEL', NULL FROM n GROUP BY key UNION ALL SELECT key, CAST(max(n) + 1 AS INTEGER), 'PERSIST', NULL FROM n GROUP BY key""")
def emit_replacing_sets(spark, sf):
    """A collection that was created anew is emitted as DEL, its members, and its expiry."""
    return compact.emitted(compact.deltas(_typed_log(events(spark, sf)))).select("key", "ord", "op", "elem")


@query(f"WITH e AS ({EV}), s AS (SELECT key, max(at_ms) + 5000 AS t FROM e GROUP BY key), n AS (SELECT max(at_ms) - 86400000 AS now FROM e) SELECT key, CASE WHEN t <= now THEN 'DEL' ELSE 'SET' END AS op FROM s, n")
def flush_expired_as_delete(spark, sf):
    e = events(spark, sf)
    now = e.agg(F.max("at_ms")).first()[0] - 86_400_000
    d = compact.deltas(as_log(e, F.lit("SET"), True, elem=None, val="val", ttl_ms=F.col("at_ms") + 5000))
    return compact.emitted(compact.expired_as_deletes(d, now)).select("key", "op")


@query("WITH e AS (SELECT CAST(user_id % 4 AS INTEGER) AS shard, event_type, (epoch_us(ts) // 1000) AS at_ms FROM events) SELECT shard, coalesce(min(at_ms) FILTER (event_type = 'error' AND shard <> 3), max(at_ms)) AS clock_ms FROM e GROUP BY shard")
def buffer_clock(spark, sf):
    e = events(spark, sf).withColumn("shard", (F.col("key").cast("long") % 4).cast("int"))
    return compact.buffer_clock(e.where("elem = 'error' and shard <> 3"), e)


@query("SELECT CAST(user_id AS BIGINT) AS id, least(max(event_id), min(event_id) FILTER (event_type = 'error') - 1, min(event_id) FILTER (event_type = 'click') - 1) AS frontier FROM events GROUP BY 1")
def commit_frontier(spark, sf):
    e = table(spark, sf, "events").groupBy(F.col("user_id").cast("long").alias("id")).agg(
        F.max("event_id").alias("drained"), F.min(F.when(F.col("event_type") == "error", F.col("event_id"))).alias("oldest"), F.min(F.when(F.col("event_type") == "click", F.col("event_id"))).alias("poison")
    )
    none = F.lit(None).cast("long")
    return e.select("id", compact.commit_frontier(F.col("drained"), F.col("oldest"), F.col("poison"), none, none).alias("frontier"))


@query("SELECT CAST(user_id % 4 AS INTEGER) AS shard, count(DISTINCT user_id) AS keys FROM events WHERE event_id > 3000 GROUP BY 1")
def flush_every_shard(spark, sf):
    """A flush is one entry a shard; only what comes after it is left."""
    log = as_log(events(spark, sf), F.lit("SET"), True, elem=None, val="val").withColumn("shard", (F.col("key").cast("long") % 4).cast("int"))
    flush = logs.flush_rows(spark, 4, 0).withColumn("seq", F.lit(3000).cast("long"))
    return fold(log.unionByName(flush, allowMissingColumns=True))[1].groupBy("shard").agg(F.count("*").alias("keys"))


@query("SELECT CAST(c_custkey AS VARCHAR) AS key, 'hash' AS type, 0::BIGINT AS abs_ttl_ms, CAST(c_custkey AS BIGINT) AS latest_seq FROM customer WHERE c_custkey % 7 = 0")
def stub_rows(spark, sf):
    evicted = table(spark, sf, "customer").where("c_custkey % 7 = 0").select(F.col("c_custkey").cast("string").alias("key"))
    return ttl.stubs(customers(spark, sf).meta, evicted)


@query("SELECT event_id AS key FROM events WHERE NOT (event_type = 'error' AND event_id <= 5000)")
def tombstone_gc(spark, sf):
    state = table(spark, sf, "events").select(F.col("event_id").alias("key"), (F.col("event_type") == "error").alias("tombstoned"), F.col("event_id").alias("latest_seq"))
    return ttl.without_old_tombstones(state, 5000).select("key")


@query("SELECT event_id AS key, CASE WHEN event_id % 5 = 0 THEN 'expire' WHEN event_type = 'error' AND event_id <= 5000 THEN 'drop_tombstone' ELSE 'keep' END AS action FROM events")
def worker_pass(spark, sf):
    state = table(spark, sf, "events").select(F.col("event_id").alias("key"), (F.col("event_type") == "error").alias("tombstoned"), F.col("event_id").alias("latest_seq"), F.when(F.col("event_id") % 5 == 0, F.lit(10)).otherwise(F.lit(0)).cast("long").alias("abs_ttl_ms"))
    return ttl.worker_pass(state, 100, 5000)


@query(f"WITH e AS ({EV}), t AS (SELECT key, max(at_ms) AS t, max(seq) AS s FROM e GROUP BY key), n AS (SELECT max(at_ms) - 86400000 AS now FROM e) SELECT key, t <= now AS expired FROM t, n")
def sampled_expiry(spark, sf):
    """A sample as large as the table is the table."""
    e = events(spark, sf)
    now = e.agg(F.max("at_ms")).first()[0] - 86_400_000
    return ttl.sample_expired(fold(as_log(e, F.lit("SET"), True, elem=None, val="val", ttl_ms=F.col("at_ms")))[1], now, 1 << 30)


@query(f"WITH e AS ({EV}), t AS (SELECT key, max(at_ms) AS t FROM e GROUP BY key), n AS (SELECT max(at_ms) - 86400000 AS now FROM e) SELECT key, t AS abs_ttl_ms FROM t, n WHERE NOT (t <= now AND CAST(key AS BIGINT) % 2 = 0)")
def compare_and_delete(spark, sf):
    """A sweep's keys go where their expiry is still the one that it saw; odd keys were given another meanwhile."""
    e = events(spark, sf)
    now = e.agg(F.max("at_ms")).first()[0] - 86_400_000
    element, meta = fold(as_log(e, F.lit("SET"), True, elem=None, val="val", ttl_ms=F.col("at_ms")), written=True)
    swept = ttl.expired(meta, now).select("key", (F.col("abs_ttl_ms") - F.when(F.col("key").cast("long") % 2 == 1, 1).otherwise(0)).alias("abs_ttl_ms"))
    return ttl.compare_and_delete(element, meta, swept)[1].select("key", "abs_ttl_ms")


@query("""WITH v AS (SELECT event_type AS series, value, row_number() OVER w AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events WINDOW w AS (PARTITION BY event_type ORDER BY event_id))
SELECT series, round(sum(value * CASE WHEN i = 1 THEN pow(0.75, n - 1) ELSE 0.25 * pow(0.75, n - i) END), 6) AS ewma FROM v GROUP BY series""")
def moving_rate(spark, sf):
    v = table(spark, sf, "events").select(F.col("event_type").alias("series"), "value", F.col("event_id").alias("at_ms"))
    return ttl.ewma(v, 0.25).select("series", F.round("ewma", 6).alias("ewma"))


# --- log -------------------------------------------------------------------------


@query(f"WITH e AS ({EV}), s AS (SELECT CAST(CAST(key AS BIGINT) % 4 AS INTEGER) AS shard, seq, at_ms FROM e) SELECT shard, seq AS req_id, row_number() OVER (PARTITION BY shard ORDER BY at_ms, seq) AS seq FROM s")
def log_numbering(spark, sf):
    e = events(spark, sf).select((F.col("key").cast("long") % 4).cast("int").alias("shard"), F.col("at_ms").alias("appended_at_ms"), F.col("seq").alias("req_id"), F.lit(0).alias("ord"))
    return logs.numbered(e).select("shard", "req_id", "seq")


@query("SELECT CAST(user_id % 4 AS INTEGER) AS shard, min(event_id) AS first_seq, max(event_id) AS tail_seq, count(*) AS entries FROM events GROUP BY 1")
def log_stats(spark, sf):
    log = as_log(events(spark, sf), F.lit("SET"), True).withColumn("shard", (F.col("key").cast("long") % 4).cast("int"))
    return logs.stats(log).select("shard", "first_seq", "tail_seq", "entries")


@query("SELECT seq, before FROM (SELECT event_id AS seq, lag(event_id) OVER (ORDER BY event_id) AS before FROM events WHERE event_type <> 'error') WHERE seq <> before + 1")
def log_gaps(spark, sf):
    return gaps(as_log(events(spark, sf).where("elem <> 'error'"), F.lit("SET"), True)).select("seq", "before")


@query("SELECT event_id AS seq FROM events WHERE event_id >= 50 AND event_id < 120")
def log_range(spark, sf):
    return logs.read_range(as_log(events(spark, sf), F.lit("SET"), True), 0, 50, 200, durable_end=120).select("seq")


@query("SELECT event_id AS seq, max((epoch_us(ts) // 1000) - CAST(floor(value) AS BIGINT) * 60000) OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS clock_ms FROM events")
def log_monotone_clock(spark, sf):
    e = events(spark, sf).withColumn("shard", F.lit(0)).withColumn("at_ms", F.col("at_ms") - F.floor("score").cast("long") * 60_000)
    return log_clock(e, order=("seq",)).select("seq", "clock_ms")


@query("SELECT o_custkey AS batch, count(*) AS n FROM orders GROUP BY 1 HAVING bool_and(o_orderstatus <> 'F')")
def whole_batches(spark, sf):
    o = table(spark, sf, "orders").withColumn("batch", F.col("o_custkey")).withColumn("batch_size", F.count("*").over(Window.partitionBy("o_custkey")))
    return logs.whole_batches(o.where("o_orderstatus <> 'F'")).groupBy("batch").agg(F.count("*").alias("n"))


@query("WITH c AS (SELECT event_type AS consumer, CAST(user_id % 4 AS INTEGER) AS shard, max(event_id) AS seq FROM events GROUP BY 1, 2) SELECT shard, min(seq) AS seq FROM c GROUP BY shard")
def offsets_oldest(spark, sf):
    o = table(spark, sf, "events").select(F.col("event_type").alias("consumer"), (F.col("user_id") % 4).cast("int").alias("shard"), F.col("event_id").alias("seq"))
    return logs.oldest_needed(o)


@query("""WITH s AS (SELECT event_id // 100 AS ordinal, CAST(user_id % 4 AS INTEGER) AS shard, max(event_id) AS max_seq, max((epoch_us(ts) // 1000)) AS sealed FROM events GROUP BY 1, 2),
g AS (SELECT ordinal, max(sealed) AS sealed, bool_and(max_seq <= (SELECT max(event_id) FROM events) - 300 - shard * 50) AS ok FROM s GROUP BY 1),
f AS (SELECT ordinal, ok AND sealed + 3600000 <= (SELECT max((epoch_us(ts) // 1000)) FROM events) AS free FROM g)
SELECT ordinal FROM f WHERE ordinal < coalesce((SELECT min(ordinal) FROM f WHERE NOT free), 1 << 40)""")
def retention_sweep(spark, sf):
    e = events(spark, sf)
    top = e.agg(F.max("seq").alias("s"), F.max("at_ms").alias("t")).first()
    seg = e.groupBy(F.lit(0).alias("log"), F.floor(F.col("seq") / 100).alias("ordinal"), (F.col("key").cast("long") % 4).cast("int").alias("shard")).agg(F.max("seq").alias("max_seq"), F.max("at_ms").alias("sealed_at_ms"))
    done = spark.range(4).select(F.col("id").cast("int").alias("shard"), (F.lit(top.s) - 300 - F.col("id") * 50).alias("seq"))
    return logs.removable(seg, done, top.t, 3_600_000).select("ordinal")


@query("SELECT event_id AS seq, sum(octet_length(encode(props))) OVER (ORDER BY (epoch_us(ts) // 1000) RANGE BETWEEN 3600000 PRECEDING AND CURRENT ROW)::BIGINT AS in_window FROM events")
def durability_window(spark, sf):
    e = table(spark, sf, "events").select(F.lit(0).alias("shard"), F.col("event_id").alias("seq"), F.unix_millis(F.col("ts").cast("timestamp")).alias("at_ms"), F.octet_length("props").cast("bigint").alias("bytes"))
    return logs.admitted(e, 10_000, 3_600_000).select("seq", "in_window")


@query("SELECT CAST(user_id % 4 AS INTEGER) AS shard, count(*) AS n FROM events WHERE event_id < 1000 + (user_id % 4) * 500 GROUP BY 1")
def durable_fence(spark, sf):
    log = as_log(events(spark, sf), F.lit("SET"), True).withColumn("shard", (F.col("key").cast("long") % 4).cast("int"))
    durable = spark.range(4).select(F.col("id").cast("int").alias("shard"), (F.col("id") * 500 + 1000).alias("durable_end"))
    return logs.visible(log, durable).groupBy("shard").agg(F.count("*").alias("n"))


# --- expiry, eviction, admission ---------------------------------------------------


@query(f"WITH e AS ({EV}), n AS (SELECT max(at_ms) - 86400000 AS now FROM e), t AS (SELECT key, max(at_ms) AS t FROM e GROUP BY key) SELECT t // 1000 AS bucket, count(*) AS n FROM t, n WHERE t <= now GROUP BY 1")
def ttl_sweep_bucket(spark, sf):
    e = events(spark, sf)
    now = e.agg(F.max("at_ms")).first()[0] - 86_400_000
    _, meta = fold(as_log(e, F.lit("SET"), True, elem=None, val="val", ttl_ms=F.col("at_ms")))
    return ttl.sweep_buckets(meta, now)


@query("SELECT doc_id, running FROM (SELECT doc_id, sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id DESC)::BIGINT AS running FROM documents) WHERE running > 40000")
def lru_budget(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "source", "n_chars")
    return ttl.over_budget(d, 40_000, by="source", bytes_="n_chars", accessed="doc_id", tie="doc_id").select("doc_id", "running")


@query(f"WITH e AS ({EV}) SELECT seq, nth FROM (SELECT seq, row_number() OVER (PARTITION BY key, at_ms // 86400000 ORDER BY at_ms, seq) AS nth FROM e) WHERE nth >= 2")
def doorkeeper(spark, sf):
    return ttl.admitted(events(spark, sf), 86_400_000).select("seq", F.col("nth").cast("bigint").alias("nth"))


@query(f"WITH e AS ({EV}), l AS (SELECT key, max(at_ms) AS t, max(seq) AS s FROM e GROUP BY key), n AS (SELECT max(at_ms) AS now, max(seq) - 100 AS drained FROM e) SELECT key, s <= drained AS evict FROM l, n WHERE t + 3600000 <= now")
def evict_deadline(spark, sf):
    e = events(spark, sf)
    top = e.agg(F.max("at_ms").alias("t"), F.max("seq").alias("s")).first()
    hot = e.groupBy("key").agg(F.max("at_ms").alias("accessed_ms"), F.min("at_ms").alias("linked_ms"), F.max("seq").alias("latest_seq"))
    return ttl.evictable(hot, top.t, F.lit(3600), F.lit(top.s - 100)).select("key", "evict")


@query(f"WITH e AS ({EV}), l AS (SELECT key, max(at_ms) AS t FROM e GROUP BY key), n AS (SELECT max(at_ms) AS now FROM e) SELECT key, CASE WHEN now >= t + 172800000 THEN 'gone' WHEN t + 3600000 > now THEN 'hot' ELSE 'cold' END AS tier FROM l, n")
def two_ttl_tiers(spark, sf):
    e = events(spark, sf)
    now = e.agg(F.max("at_ms")).first()[0]
    m = e.groupBy("key").agg(F.max("at_ms").alias("accessed_ms")).withColumn("abs_ttl_ms", F.col("accessed_ms") + 172_800_000)
    return ttl.tier_label(m, now, eviction_s=F.lit(3600)).select("key", "tier")


@query("SELECT CAST(c_custkey AS VARCHAR) AS key, CAST(3 * 64 + length('c_name') + length('c_mktsegment') + length('c_nationkey') + octet_length(encode(c_name)) + octet_length(encode(c_mktsegment)) + length(CAST(c_nationkey AS VARCHAR)) + length(CAST(c_custkey AS VARCHAR)) AS BIGINT) AS bytes FROM customer")
def byte_size(spark, sf):
    return ttl.byte_size(customers(spark, sf).element)


# --- commands --------------------------------------------------------------------


def _requests(spark, sf) -> DataFrame:
    """Commands made from events."""
    e = events(spark, sf)
    v = F.round(F.col("score") * 10).cast("long").cast("string")
    args = (
        F.when(F.col("elem") == "signup", F.array(F.lit("set"), F.col("key"), F.col("elem"), F.lit("EX"), v))
        .when(F.col("elem") == "click", F.array(F.lit("ZADD"), F.col("key"), F.lit("GT"), F.lit("CH"), F.col("score").cast("string"), F.col("elem")))
        .when(F.col("elem") == "error", F.array(F.lit("DEL"), F.col("key"), F.lit("x")))
        .otherwise(F.array(F.lit("HSET"), F.col("key"), F.col("elem"), v))
    )
    return e.select(F.col("seq").alias("req_id"), "at_ms", args.alias("args"))


@query(f"WITH e AS ({EV}) SELECT seq AS req_id, CASE elem WHEN 'signup' THEN 'SET' WHEN 'click' THEN 'ZADD' WHEN 'error' THEN 'DEL' ELSE 'HSET' END AS command, 'write' AS class FROM e")
def command_resolve(spark, sf):
    return registry.resolve(_requests(spark, sf)).where("err is null").select("req_id", "command", "class")


@query(f"WITH e AS ({EV}), r AS (SELECT seq AS req_id, elem, key, score, CASE elem WHEN 'signup' THEN 'SET' WHEN 'click' THEN 'ZADD' WHEN 'error' THEN 'DEL' ELSE 'HSET' END AS op, CASE elem WHEN 'click' THEN 80 ELSE 0 END AS flags, CASE WHEN elem = 'signup' AND round(score * 10) > 0 THEN at_ms + CAST(round(score * 10) AS BIGINT) * 1000 END AS ttl_ms FROM e) SELECT req_id, 0 AS ord, op, key, flags, coalesce(ttl_ms, 0) AS ttl_ms FROM r UNION ALL SELECT req_id, 1, op, 'x', flags, 0 FROM r WHERE op = 'DEL'")
def command_parse(spark, sf):
    return parse.typed_writes(_requests(spark, sf)).select("req_id", "ord", "op", "key", "flags", F.coalesce("ttl_ms", F.lit(0)).alias("ttl_ms"))


@query(f"WITH e AS ({EV}) SELECT seq AS req_id, CASE elem WHEN 'signup' THEN 'GET' WHEN 'click' THEN 'ZRANGE' WHEN 'error' THEN 'TTL' ELSE 'HMGET' END AS op, key, CASE WHEN elem NOT IN ('signup', 'click', 'error') THEN elem || ',x' END AS fields, CASE WHEN elem = 'click' AND seq % 3 = 0 THEN 'score' WHEN elem = 'click' THEN 'index' END AS mode, CASE WHEN elem = 'click' THEN CASE WHEN seq % 3 = 0 THEN 2 ELSE 0 END END AS start, elem = 'error' AS millis, CASE WHEN elem = 'click' AND seq % 3 = 1 THEN 'ERR syntax error' END AS err FROM e")
def command_reads(spark, sf):
    """Read requests as typed rows: the three forms of a range, old and new names, and options that don't fit."""
    by_score = F.array(F.lit("zrangebyscore"), F.col("key"), F.lit("(1"), F.lit("+inf"), F.lit("LIMIT"), F.lit("2"), F.lit("5"))
    by_index = F.array(F.lit("ZRANGE"), F.col("key"), F.lit("0"), F.lit("-1"), F.when(F.col("seq") % 3 == 1, "LIMIT").otherwise("rev"))
    args = (
        F.when(F.col("elem") == "signup", F.array(F.lit("get"), F.col("key"))).when((F.col("elem") == "click") & (F.col("seq") % 3 == 0), by_score)
        .when(F.col("elem") == "click", by_index).when(F.col("elem") == "error", F.array(F.lit("PTTL"), F.col("key"))).otherwise(F.array(F.lit("HMGET"), F.col("key"), F.col("elem"), F.lit("x")))
    )
    typed = parse.typed_reads(events(spark, sf).select(F.col("seq").alias("req_id"), "at_ms", args.alias("args")))
    return typed.select("req_id", "op", "key", F.array_join("elems", ",").alias("fields"), "mode", "start", "millis", "err")


@query(f"WITH e AS ({EV}) SELECT seq AS req_id, CASE elem WHEN 'signup' THEN 'SET' WHEN 'click' THEN 'ZADD' WHEN 'error' THEN 'COPY' ELSE 'PEXPIREAT' END AS op, CASE elem WHEN 'signup' THEN 'ERR syntax error' WHEN 'click' THEN 'ERR XX and NX options at the same time are not compatible' WHEN 'error' THEN NULL ELSE 'ERR Unsupported option ' || elem END AS err FROM e")
def command_errors(spark, sf):
    """Writes whose options exclude each other, one row a request."""
    key, elem = F.col("key"), F.col("elem")
    args = (
        F.when(elem == "signup", F.array(F.lit("SET"), key, elem, F.lit("NX"), F.lit("xx"))).when(elem == "click", F.array(F.lit("ZADD"), key, F.lit("NX"), F.lit("XX"), F.lit("1"), elem))
        .when(elem == "error", F.array(F.lit("COPY"), key, elem, F.lit("replace"))).otherwise(F.array(F.lit("EXPIRE"), key, F.lit("5"), elem))
    )
    return parse.typed_writes(events(spark, sf).select(F.col("seq").alias("req_id"), "at_ms", args.alias("args"))).select("req_id", "op", "err")


@query(f"WITH e AS ({EV}) SELECT seq AS req_id, '*2' || chr(13) || chr(10) || '$3' || chr(13) || chr(10) || 'GET' || chr(13) || chr(10) || '$' || length(key) || chr(13) || chr(10) || key || chr(13) || chr(10) AS wire FROM e")
def resp_encode(spark, sf):
    e = events(spark, sf)
    return e.select(F.col("seq").alias("req_id"), resp.encode_command(F.array(F.lit("GET"), F.col("key"))).alias("wire"))


@query("SELECT class, count(*) AS n FROM (VALUES ('admin', 14), ('read', 32), ('write', 23)) t(class, k), range(k) GROUP BY class")
def command_table(spark, sf):
    return registry.registry(spark).groupBy("class").agg(F.count("*").alias("n"))


@query("SELECT event_id AS req_id, CASE WHEN value > 50 THEN value END AS v FROM events")
def strict_numbers(spark, sf):
    e = table(spark, sf, "events")
    text = F.when(F.col("value") > 50, F.concat(F.lit("+"), F.col("value").cast("string"))).otherwise(F.concat(F.lit(" "), F.col("value").cast("string")))
    return e.select(F.col("event_id").alias("req_id"), values.strict_double(text).alias("v"))


READ_REPLIES = """
WITH p AS (SELECT p_partkey AS req_id, p_brand AS key, CAST(p_partkey AS VARCHAR) AS elem, p_retailprice AS score FROM part),
r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY score, elem) AS up, row_number() OVER (PARTITION BY key ORDER BY score DESC, elem DESC) AS down FROM p),
f AS (SELECT *, min(up) OVER (PARTITION BY key, score) AS low, req_id % 4 AS form FROM r),
n AS (SELECT key, count(*) AS n, string_agg(elem, ',' ORDER BY down) FILTER (WHERE down <= 3) AS last FROM r GROUP BY key)
SELECT f.req_id, CASE form WHEN 0 THEN 'int' WHEN 2 THEN 'error' ELSE 'array' END AS kind, CASE WHEN form = 0 THEN n.n END AS i,
       CASE form WHEN 1 THEN coalesce(a.elem, '') || coalesce(',' || b.elem, '') WHEN 3 THEN n.last END AS members,
       CASE WHEN form = 2 THEN 'WRONGTYPE Operation against a key holding the wrong kind of value' END AS err
FROM f JOIN n USING (key) LEFT JOIN r a ON a.key = f.key AND a.up = f.low + 1 LEFT JOIN r b ON b.key = f.key AND b.up = f.low + 2
"""


@query(READ_REPLIES)
def read_replies(spark, sf):
    """Replies of mixed reads, a request a part: counts, ranges by score with a limit, reads of a wrong type, ranges from the end."""
    from foldkeep.operators.answer import answers

    key, price, form = F.col("p_brand"), F.col("p_retailprice").cast("double").cast("string"), F.col("p_partkey") % 4
    words = lambda *x: F.array(*[F.lit(w) if isinstance(w, str) else w for w in x])
    args = (
        F.when(form == 0, words("ZCARD", key)).when(form == 1, words("ZRANGE", key, price, "+inf", "BYSCORE", "LIMIT", "1", "2"))
        .when(form == 2, words("GET", key)).otherwise(words("ZRANGE", key, "0", "2", "REV"))
    )
    out = answers(brands(spark, sf), table(spark, sf, "part").select(F.col("p_partkey").cast("long").alias("req_id"), args.alias("args")))
    return out.select("req_id", "kind", "i", F.array_join("arr", ",").alias("members"), "err")


# --- general decisions, streams and workloads ---------------------------------------


@query(None)
def decide_commands(spark, sf):
    """Effects of a stream in which one command's outcome decides the next one's, by the general decider."""
    from foldkeep.operators.decide import decide

    effects, _ = decide(_requests(spark, sf))
    return effects.groupBy("op").agg(F.count("*").alias("n"))


@query(f"WITH e AS ({EV}), c AS (SELECT key, min(seq) AS first_seq FROM e GROUP BY key) SELECT e.seq AS req_id, CASE WHEN e.seq = c.first_seq THEN 'simple' ELSE 'nil' END AS kind FROM e JOIN c USING (key)")
def decide_set_nx(spark, sf):
    from foldkeep.operators.decide import decide

    reqs = events(spark, sf).select(F.col("seq").alias("req_id"), "at_ms", F.array(F.lit("SET"), F.col("key"), F.col("val"), F.lit("NX")).alias("args"))
    return decide(reqs)[1].select("req_id", "kind")


@query("SELECT p_partkey AS req_id, CAST(CASE WHEN c_custkey IS NULL THEN 1 ELSE 0 END AS BIGINT) AS i FROM part LEFT JOIN customer ON c_custkey = p_partkey")
def decide_over_base(spark, sf):
    """SETNX with the numbers of parts as keys, over a base whose keys are the numbers of customers."""
    from foldkeep.operators.decide import decide

    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("seq"), F.col("c_custkey").cast("string").alias("key"), F.col("c_name").alias("val"), F.lit(NOW).alias("at_ms"))
    base = fold(as_log(c, F.lit("SET"), True, elem=None, val="val"))
    key = F.col("p_partkey").cast("string")
    reqs = table(spark, sf, "part").select(F.col("p_partkey").alias("req_id"), F.lit(NOW).alias("at_ms"), F.array(F.lit("SETNX"), key, F.col("p_name")).alias("args"))
    return decide(reqs, base)[1].select("req_id", "i")


def _log_folder(spark, sf, rows: DataFrame, parts: int) -> str:
    """A log folder that grew in parts, one after the other, as a log does."""
    from foldkeep.schema import LOG
    from foldkeep.session import new_path

    path = new_path(spark, "log")
    top = rows.agg(F.max("seq")).first()[0] + 1
    for i in range(parts):
        part = rows.where((F.col("seq") >= top * i // parts) & (F.col("seq") < top * (i + 1) // parts))
        part.select(*[c.split()[0] for c in LOG.split(", ")]).coalesce(1).write.mode("append").parquet(path)
    return path


@query(f"WITH e AS ({EV}) SELECT key, arg_max(score, seq) AS value, max(seq) AS seq FROM e GROUP BY key")
def stream_fold(spark, sf):
    """The fold as a stream of micro-batches over a log folder."""
    from foldkeep.session import new_path
    from foldkeep.streaming.fold_stream import FoldStream, log_source

    src = _log_folder(spark, sf, as_log(events(spark, sf), F.lit("SET"), True, elem=None, val="val"), 2)
    s = FoldStream(spark, new_path(spark, "state"))
    s.start(log_source(spark, src, files=1), new_path(spark, "checkpoint")).awaitTermination()
    element, meta = s.state()
    return element.join(meta.select("key", F.col("latest_seq").alias("seq")), "key").select("key", F.col("val").cast("double").alias("value"), "seq")


@query(ORACLE_SQL["flush_reasons"])
def stream_compaction(spark, sf):
    """Compaction with timers over a stream, its flushes counted by reason."""
    from foldkeep.session import new_path
    from foldkeep.streaming.compaction_stream import FLUSHED, compact_stream

    setting, provider = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    before = spark.conf.get(setting, None)
    spark.conf.set(setting, provider)
    try:
        e = events(spark, sf).select("key", "seq", "at_ms")
        end = e.agg(F.max("at_ms") + 10**10).first()[0]  # a write far on, at which every timer is due
        e = e.union(spark.createDataFrame([("end", 1 << 40, end)], e.schema)).withColumn("ts", F.timestamp_millis("at_ms"))
        src, out = new_path(spark, "writes"), new_path(spark, "flushes")
        e.repartitionByRange(2, "at_ms").sortWithinPartitions("at_ms").write.parquet(src)
        writes = spark.readStream.schema(e.schema).parquet(src)
        compact_stream(writes, QUIET, 40_000_000).writeStream.format("parquet").option("checkpointLocation", new_path(spark, "checkpoint")).option("path", out).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(setting, before) if before else spark.conf.unset(setting)
    return spark.read.schema(FLUSHED).parquet(out).groupBy("reason").agg(F.count("*").alias("flushes"), F.sum("writes").alias("writes"))


@query(None)
def workload_zipf(spark, sf):
    """An open-loop workload with skewed keys, its operations counted."""
    from foldkeep.workload import requests

    return requests(spark, 20_000, 1000, {"GET": 0.95, "SET": 0.05}, rate=10_000, theta=0.99).groupBy("op").agg(F.count("*").alias("n"), F.count_distinct("key").alias("keys"))


@query("SELECT count(*) AS n, max(i) AS last_us FROM range(5000) t(i)")
def workload_latency(spark, sf):
    from foldkeep.workload import histogram, latencies, requests

    r = requests(spark, 5000, 100, {"GET": 1.0}, rate=1000).withColumn("done_us", F.col("due_us") + F.col("req_id"))
    h = histogram(latencies(r), digits=9)
    return h.agg(F.sum("n").alias("n"), F.max("bucket_us").alias("last_us"))


@query("SELECT event_type AS op, count(*) AS n FROM events WHERE event_type <> 'error' GROUP BY 1 UNION ALL SELECT 'poison', count(*) FROM events WHERE event_type = 'error'")
def poison_quarantine(spark, sf):
    e = as_log(events(spark, sf), F.when(F.col("elem") == "error", "BOOM").otherwise("SADD"))
    good, bad = compact.quarantine(e)
    return good.groupBy(F.col("elem").alias("op")).agg(F.count("*").alias("n")).unionByName(bad.agg(F.count("*").alias("n")).withColumn("op", F.lit("poison")))


# --- replay of a million entries --------------------------------------------------------


MILLION = 1_000_000


def million(spark: SparkSession) -> DataFrame:
    """A log of a million SETs of 100,000 keys, one byte each."""
    rows = spark.range(MILLION).select(
        F.col("id").alias("seq"), (F.col("id") * 7919 % 100_000).cast("string").alias("key"), (F.col("id") % 10).cast("string").alias("val"), F.lit(0).cast("long").alias("at_ms")
    )
    return as_log(rows, F.lit("SET"), True, elem=None, val="val")


@query("SELECT count(*) AS keys, sum(v)::BIGINT AS total, max(s) AS latest FROM (SELECT i * 7919 % 100000 AS k, arg_max(i % 10, i) AS v, max(i) AS s FROM range(1000000) t(i) GROUP BY 1)")
def replay_million(spark, sf):
    element, meta = fold(million(spark), written=True)
    e = element.agg(F.count("*").alias("keys"), F.sum(F.col("val").cast("long")).alias("total"))
    return e.crossJoin(meta.agg(F.max("latest_seq").alias("latest")))  # two rows of one number each


@query("SELECT count(*) AS keys, sum(v)::BIGINT AS total, max(s) AS latest FROM (SELECT i * 7919 % 100000 AS k, arg_max(i % 10, i) AS v, max(i) AS s FROM range(1000000) t(i) GROUP BY 1)")
def merge_million(spark, sf):
    """The later half of the log as deltas over the state that the earlier half makes."""
    log = million(spark)
    element, meta = merge.merge(*fold(log.where(F.col("seq") < MILLION // 2), written=True), materialize(compact.deltas(log.where(F.col("seq") >= MILLION // 2)), "deltas"))
    e = element.agg(F.count("*").alias("keys"), F.sum(F.col("val").cast("long")).alias("total"))
    return e.crossJoin(meta.agg(F.max("latest_seq").alias("latest")))
