"""The decider, the log and the fold against the plain model, on a seeded stream of all commands."""

import random

import pytest
from pyspark.sql import functions as F

from foldkeep.model import Machine
from foldkeep.operators import compact, merge
from foldkeep.operators.decide import decide, to_log
from foldkeep.operators.fold import fold, gaps


def stream(seed, n, flush=True, keys=30):
    r = random.Random(seed)
    now, out = 1_000_000, []
    key = lambda: f"k{r.randrange(6 if r.random() < 0.7 else keys)}"
    m = lambda: f"m{r.randrange(12)}"
    val = lambda: "" if r.random() < 0.05 else f"v{r.randrange(1000)}"
    score = lambda: str(r.randrange(-12, 13) * 0.5)
    for i in range(n):
        now += r.choice([0, 7, 30, 400, 1200])
        kind = r.randrange(20)
        k = key()
        if kind < 4:
            a = ["SET", k, val(), *r.choice([[], [], ["NX"], ["XX"], ["GET"], ["KEEPTTL"], ["PX", "900"], ["EX", "2"], ["NX", "GET"]])]
        elif kind == 4:
            a = r.choice([["SETNX", k, val()], ["SETEX", k, "1", val()], ["PSETEX", k, "500", val()]])
        elif kind == 5:
            a = [r.choice(["MSET", "MSETNX"]), k, val(), key(), val()]
        elif kind == 6:
            a = [r.choice(["DEL", "UNLINK"]), k, key(), k]
        elif kind < 9:
            a = [r.choice(["SADD", "SADD", "SREM"]), k, m(), m()]
        elif kind < 11:
            a = ["ZADD", k, *r.choice([[], ["NX"], ["XX"], ["GT"], ["LT"], ["GT", "CH"], ["CH"]]), score(), m(), score(), m()]
        elif kind == 11:
            a = ["ZREM", k, m(), m()]
        elif kind < 14:
            a = r.choice([["HSET", k, m(), val(), m(), val()], ["HMSET", k, m(), val()], ["HSETNX", k, m(), val()], ["HDEL", k, m(), m()]])
        elif kind < 16:
            a = r.choice([["EXPIRE", k, "1"], ["PEXPIRE", k, "800", "NX"], ["PEXPIREAT", k, str(now + 500), "GT"], ["PEXPIRE", k, "300", "LT"], ["PERSIST", k], ["EXPIREAT", k, "0"]])
        elif kind == 16:
            a = r.choice([["RENAMENX", k, key()], ["COPY", k, key(), "REPLACE"], ["COPY", k, key()]])
        elif kind == 17 and flush and r.random() < 0.1:
            a = ["FLUSHDB"]
        else:
            a = r.choice([["GET", k], ["MGET", k, key(), k], ["EXISTS", k, k, key()], ["TYPE", k], ["TTL", k], ["SMEMBERS", k], ["ZRANGE", k, "0", "-1", "WITHSCORES"], ["HGETALL", k], ["HLEN", k], ["SCARD", k]])
        out.append((i, now, a))
    return out


def by_model(requests):
    m, replies = Machine(), {}
    for i, now, a in requests:
        replies[i] = m.execute(a, now)[0]
    return m, replies


def folded(element, meta):
    ttl = {r.key: (r.type, r.abs_ttl_ms, r.cardinality) for r in meta.collect()}
    got = {k: ({}, *v) for k, v in ttl.items()}
    for r in element.collect():
        got[r.key][0][r.elem] = r.val if r.type in ("string", "hash") else r.score
    return got


def held(m):
    return {k: ({None: v.data} if v.type == "string" else dict(v.data), v.type, v.ttl_ms, 1 if v.type == "string" else len(v.data)) for k, v in m.data.items()}


@pytest.mark.parametrize("seed,flush", [(1, True), (2, False)])
def test_decide_then_fold_equals_the_model(spark, seed, flush):
    reqs = stream(seed, 900, flush)
    model, replies = by_model(reqs)
    df = spark.createDataFrame(reqs, "req_id long, at_ms long, args array<string>")
    effects, answered = decide(df)
    effects = effects.cache()
    got = {r.req_id: (r.kind, r.i if r.kind == "int" else r.s if r.kind in ("bulk", "simple") else r.arr if r.kind == "array" else r.err) for r in answered.collect()}
    assert got == {i: (k, [None if x is None else str(x) for x in v] if k == "array" else v) for i, (k, v) in replies.items()}
    log = to_log(effects).withColumn("shard", F.lit(0))
    assert folded(*fold(log)) == held(model)
    # in two halves: a base, and deltas over it
    if not flush:
        base = fold(log.where("seq < 400"))
        assert folded(*merge.merge(*base, compact.deltas(log.where("seq >= 400")))) == held(model)
        n = {r.key: r.n for r in merge.cardinality(*base, compact.deltas(log.where("seq >= 400"))).collect()}
        assert n == {k: v[3] for k, v in held(model).items()}


@pytest.mark.parametrize("seed,extra", [(1, []), (2, []), (3, ["DBSIZE"])])
def test_decisions_go_on_over_a_base(spark, seed, extra):
    reqs = stream(seed, 700, flush=seed == 1)
    reqs += [(len(reqs), reqs[-1][1] + 1, extra)] if extra else []
    model, replies = by_model(reqs)
    df = spark.createDataFrame(reqs, "req_id long, at_ms long, args array<string>")
    first = to_log(decide(df.where("req_id < 350"))[0]).cache()
    effects, answered = decide(df.where("req_id >= 350"), fold(first))
    got = {r.req_id: (r.kind, r.i if r.kind == "int" else r.s if r.kind in ("bulk", "simple") else r.arr if r.kind == "array" else r.err) for r in answered.collect()}
    assert got == {i: (k, [None if x is None else str(x) for x in v] if k == "array" else v) for i, (k, v) in replies.items() if i >= 350}
    assert folded(*fold(first.unionByName(to_log(effects)))) == held(model)


def test_flushes_part_groups_unless_refused(spark):
    reqs = [(0, 1, ["SET", "k", "a"]), (1, 2, ["FLUSHDB", "NOW"]), (2, 3, ["SET", "k", "b", "NX"]), (3, 4, ["flushall", "async"]), (4, 5, ["SET", "k", "c", "NX"]), (5, 6, ["GET", "k"])]
    _, replies = by_model(reqs)
    _, answered = decide(spark.createDataFrame(reqs, "req_id long, at_ms long, args array<string>"))
    got = {r.req_id: (r.kind, r.s if r.err is None else r.err) for r in answered.collect()}
    assert got == {i: (k, v) for i, (k, v) in replies.items()} and got[2][0] == "nil" and got[4] == ("simple", "OK")


def test_gaps(spark):
    df = spark.createDataFrame([(0, 1), (0, 2), (0, 4), (1, 1), (1, 2)], "shard int, seq long")
    assert [(r.shard, r.seq, r.before) for r in gaps(df).collect()] == [(0, 4, 2)]
