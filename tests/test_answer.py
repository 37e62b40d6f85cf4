"""Replies of whole tables of reads against the plain model."""

from pyspark.sql import functions as F

from foldkeep.model import Machine
from foldkeep.operators.answer import answers
from foldkeep.operators.decide import decide, to_log
from foldkeep.operators.fold import fold
from foldkeep.operators.reads import Keyspace

WRITES = (
    "SET s hello", "SET gone x PX 5", "SET soon y PX 90000", "SADD t b a c", "SADD dead a b", "PEXPIRE dead 5", "HSET h f 1 e 2 g 3", "HSET old f 1", "PEXPIRE old 5",
    "ZADD z 1 a 2.5 b 2.5 c -3 d 10 e", "ZADD l 0 a 0 ab 0 b 0 c", "ZADD zd 1 a", "PEXPIRE zd 5",
)
FORMS = (
    "GET {}", "TYPE {}", "TTL {}", "PTTL {}", "SCARD {}", "ZCARD {}", "HLEN {}", "SMEMBERS {}", "HGETALL {}", "HKEYS {}", "hvals {}", "SISMEMBER {} a", "SISMEMBER {} q", "HGET {} e", "HGET {} q", "HEXISTS {} f",
    "HMGET {} g q e g", "ZSCORE {} b", "ZSCORE {} q", "ZRANGE {} 0 -1", "ZRANGE {} 1 2 WITHSCORES", "ZRANGE {} -2 -1 REV", "ZRANGE {} 5 1", "ZRANGE {} -99 99 REV WITHSCORES", "ZRANGE {} (1 +inf BYSCORE", "ZRANGE {} 5 -inf BYSCORE REV LIMIT 1 2 WITHSCORES",
    "ZRANGEBYSCORE {} -inf 3 LIMIT 0 2", "ZRANGEBYSCORE {} -inf 3 LIMIT 1 -1 WITHSCORES", "ZRANGEBYLEX {} [ab +", "ZRANGE {} + (a BYLEX REV LIMIT 0 2", "ZRANGEBYLEX {} - (b LIMIT 1 5", "ZRANGE {} x 1 BYSCORE", "ZRANGEBYLEX {} a +",
    "ZRANGE {} 1 2 BYSCORE BYLEX", "ZRANGE {} 0 1 LIMIT x 1", "GET {} {}", "ZRANGE {} 0 1 WHAT",
)
KEYS = ("s", "gone", "soon", "t", "dead", "h", "old", "z", "l", "zd", "none")


def test_answers_equal_the_model(spark):
    m = Machine()
    for i, w in enumerate(WRITES):
        m.execute(w.split(), 1000 + i)
    log = to_log(decide(spark.createDataFrame([(i, 1000 + i, w.split()) for i, w in enumerate(WRITES)], "req_id long, at_ms long, args array<string>"))[0])
    asked = [f.format(k, k).split() for f in FORMS for k in KEYS] + [x.split() for x in ("MGET s t none s gone soon", "EXISTS s s t gone none", "MGET", "EXISTS", "GET", "SET k v")]
    df = spark.createDataFrame(list(enumerate(asked)), "req_id long, args array<string>")
    got = {}
    for r in answers(Keyspace(*fold(log), now_ms=50_000), df).collect():
        assert r.req_id not in got
        got[r.req_id] = (r.kind, {"int": r.i, "bulk": r.s, "simple": r.s, "nil": None, "array": r.arr, "error": r.err}[r.kind])
    want = {i: m.execute(a, 50_000)[0] for i, a in enumerate(asked) if a[0] != "SET"}
    assert {i: (asked[i], got.get(i), w) for i, w in want.items() if got.get(i) != w} == {}
    assert len(got) == len(want)


def test_no_requests_no_replies(spark):
    log = to_log(decide(spark.createDataFrame([(0, 1, ["SET", "k", "v"])], "req_id long, at_ms long, args array<string>"))[0])
    none = spark.createDataFrame([], "req_id long, args array<string>")
    assert answers(Keyspace(*fold(log), now_ms=5), none).isEmpty()
    assert answers(Keyspace(*fold(log.where(F.lit(False))), now_ms=5), spark.createDataFrame([(1, ["GET", "k"])], none.schema)).first().kind == "nil"
