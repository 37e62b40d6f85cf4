"""Fixed cases of the protocol: routing, bounds, numbers, schedules, errors."""

import math

import pytest
from pyspark.sql import functions as F

from foldkeep.functions import routing, values
from foldkeep.model import Machine
from foldkeep.operators import compact, reads
from foldkeep.operators.reads import Keyspace
from foldkeep.plans import parse, registry
from foldkeep.plans.config import Config, config_get
from foldkeep.sources import frames, resp


def column(spark, items, f, kind="string"):
    return [r[1] for r in spark.createDataFrame(list(enumerate(items)), f"i int, x {kind}").select("i", f(F.col("x"))).orderBy("i").collect()]


def plain_crc16(data: bytes) -> int:
    crc = 0
    for byte in data:
        crc ^= byte << 8
        for _ in range(8):
            crc = (crc << 1 ^ 0x1021 if crc & 0x8000 else crc << 1) & 0xFFFF
    return crc


def test_routing(spark):
    # fixed value: the check value of this CRC
    assert column(spark, ["123456789", ""], routing.crc16) == [0x31C3, 0]
    keys = ["order:17", "Ünïcode", "{seg}:a", "{seg}:b", "no{tag", "x" * 300]
    tags = {"{seg}:a": "seg", "{seg}:b": "seg"}
    assert column(spark, keys, routing.slot) == [plain_crc16(tags.get(k, k).encode()) % 16384 for k in keys]
    braces = {"{cust7}.orders": "cust7", "{}x": "{}x", "{{in}}": "{in", "{p}{q}": "p", "{half": "{half", "z}y{w}": "w", "": "", "}{": "}{"}
    assert column(spark, list(braces), routing.hashtag) == list(braces.values())
    rules = [("s", 50), ("sess", 20), ("session/", 5), ("t", 70)]
    names = ["session/1", "sessile", "sea", "tea", "ale", "", "sess"]
    longest = lambda k: max((len(p), t) for p, t in [("", 99), *rules] if k.startswith(p))[1]
    assert column(spark, names, lambda k: routing.eviction_seconds(k, rules, 99)) == [longest(k) for k in names]
    for bad in ((0, []), (5, [("a", 0)]), (5, [("a", 1), ("a", 2)]), (5, [("", 1)])):
        with pytest.raises(ValueError):
            routing.check_policy(*bad)
    lists = [["{q}1", "{q}2", "{q}3"], ["m", "n"], ["solo"]]
    of = lambda k: plain_crc16((k[1:2] if k[0] == "{" else k).encode()) % 16384 * 16 // 16384
    crosses = spark.createDataFrame([(x,) for x in lists], "k array<string>").select(routing.crosses_logs(F.col("k"), 16, 16)).collect()
    assert [r[0] for r in crosses] == [len({of(k) for k in x}) > 1 for x in lists]


def test_numbers(spark):
    assert column(spark, ["12", "-5", "+5", " 1", "1 ", "", "9223372036854775808", "1.0"], values.strict_int) == [12, -5, None, None, None, None, None, None]
    assert column(spark, ["1.5", "+1.5", "-2", "inf", "-inf", "+inf", "nan", " 1", "1e3", "++1", ".5"], values.strict_double) == [1.5, 1.5, -2.0, math.inf, -math.inf, math.inf, None, None, 1000.0, None, 0.5]
    assert column(spark, [0.1, 3.0, 1e17, math.inf], values.score_text, "double") == ["0.10000000000000001", "3", "1e+17", "inf"]
    ttl = lambda x: values.ttl_reply(F.lit(True), x, 0, False)
    assert column(spark, [1499, 1500, 0], ttl, "long") == [1, 2, -1]
    mixed = [0, 1, -1, 123456789, -(1 << 63), (1 << 63) - 1]

    def plain(x):
        m = (1 << 64) - 1
        x &= m
        x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & m
        x = (x ^ (x >> 27)) * 0x94D049BB133111EB & m
        x ^= x >> 31
        return x - (1 << 64) if x >> 63 else x

    assert column(spark, mixed, values.splitmix64, "long") == [plain(x) for x in mixed]
    assert values.next_prefix("ab") == "ac" and values.next_prefix("\U0010ffff") is None


SCORES = {"kiwi": -2.5, "fig": 0.0, "plum": 0.0, "pear": 4.25, "lime": 10.0}
ZSET = [("z", "zset", m, None, s) for m, s in SCORES.items()]


def bounds(marks: list[str], low: str, high: str) -> list[tuple[str, str]]:
    ends = [low, high, *[mark + x for x in marks for mark in ("(", "" if low == "-inf" else "[")]]
    return [(a, b) for a in ends for b in ends]


def within(value, low, high, number: bool) -> bool:
    """Whether a value lies between two bounds, by their definition."""
    if number:
        read = lambda b: float(b.lstrip("("))
        return (value > read(low) if low[0] == "(" else value >= read(low)) and (value < read(high) if high[0] == "(" else value <= read(high))
    rank = lambda b: (-1, "") if b == "-" else (1, "") if b == "+" else (0, b[1:])
    v = (0, value)
    return (v > rank(low) if low[0] == "(" else v >= rank(low)) and (v < rank(high) if high[0] == "(" else v <= rank(high))


def expected(low: str, high: str, rev: bool, number: bool) -> list[str]:
    a, b = (high, low) if rev else (low, high)
    order = sorted(SCORES, key=(lambda m: (SCORES[m], m)) if number else None, reverse=rev)
    return [m for m in order if within(SCORES[m] if number else m, a, b, number)]


SCORE_CASES = [(a, b, rev) for a, b in bounds(["-2.5", "0", "4.25"], "-inf", "+inf") for rev in (False, True)]
LEX_CASES = [(a, b, rev) for a, b in bounds(["fig", "l"], "-", "+") for rev in (False, True)]


def keyspace(spark, rows):
    e = spark.createDataFrame(rows, "key string, type string, elem string, val string, score double").withColumn("shard", F.lit(0))
    m = e.groupBy("shard", "key", "type").agg(F.count("*").alias("cardinality")).withColumn("abs_ttl_ms", F.lit(0).cast("long"))
    return Keyspace(e, m)


def test_ranges(spark):
    ks = keyspace(spark, ZSET)
    for read, cases, number in ((reads.zrange_score, SCORE_CASES, True), (reads.zrange_lex, LEX_CASES, False)):
        for rev in (False, True):
            asked = [(i, "z", a, b) for i, (a, b, r) in enumerate(cases) if r == rev]
            got = {}
            for r in read(ks, spark.createDataFrame(asked, "req_id int, key string, min string, max string"), rev=rev).orderBy("rank").collect():
                got.setdefault(r.req_id, []).append(r.elem)
            assert got == {i: w for i, _, a, b in asked if (w := expected(a, b, rev, number))}
    bad = reads.zrange_score(ks, spark.createDataFrame([(1, "z", "low", "2")], "req_id int, key string, min string, max string")).collect()
    assert [r.err for r in bad] == ["ERR min or max is not a float"]


def test_ranks(spark):
    ks = keyspace(spark, ZSET)
    order = sorted(SCORES, key=lambda m: (SCORES[m], m))
    for rev in (False, True):
        mine = order[::-1] if rev else order
        reqs = spark.createDataFrame([(i * 10 + j, "z", i - 6, j - 6) for i in range(13) for j in range(10)], "req_id int, key string, start int, stop int")
        got = {}
        for r in reads.zrange_index(ks, reqs, rev=rev).orderBy("rank").collect():
            got.setdefault(r.req_id, []).append((r.rank, r.elem))
        for r in reqs.collect():
            a, b = (x + len(mine) if x < 0 else x for x in (r.start, r.stop))
            assert got.get(r.req_id, []) == [(k, m) for k, m in enumerate(mine) if a <= k <= b]
        asked = spark.createDataFrame([(i, "z", m) for i, m in enumerate([*mine, "none"])] + [(9, "no", "fig")], "req_id int, key string, elem string")
        assert {r.req_id: r["rank"] for r in reads.zrank(ks, asked, rev=rev).collect()} == {**{i: i for i in range(len(mine))}, len(mine): None, 9: None}


def test_model_agrees_on_ranges():
    m = Machine()
    m.execute(["ZADD", "z", *[x for k, v in SCORES.items() for x in (str(v), k)]], 0)
    for cases, by, number in ((SCORE_CASES, "BYSCORE", True), (LEX_CASES, "BYLEX", False)):
        for low, high, rev in cases:
            assert m.execute(["ZRANGE", "z", low, high, by, *(["REV"] if rev else [])], 0)[0] == ("array", expected(low, high, rev, number))


def test_wrong_type_expiry_and_duplicates(spark):
    ks = keyspace(spark, [("s", "string", None, "v", None), *ZSET])
    one = lambda **c: spark.createDataFrame([tuple(c.values())], list(c))
    assert reads.get(ks, one(req_id=1, key="z")).first().err.startswith("WRONGTYPE")
    assert reads.card(ks, one(req_id=1, key="s"), "zset").first().err.startswith("WRONGTYPE")
    assert reads.exists(ks, one(req_id=1, keys=["s", "s", "no", "z"])).first().n == 3
    assert [r.val for r in reads.mget(ks, one(req_id=1, keys=["z", "s", "s"])).orderBy("pos").collect()] == [None, "v", "v"]
    gone = Keyspace(ks.element, ks.meta.withColumn("abs_ttl_ms", F.lit(100).cast("long")), now_ms=100)
    assert reads.type_of(gone, one(req_id=1, key="s")).first().type == "none"
    alive = Keyspace(gone.element, gone.meta, now_ms=99)
    assert reads.get(alive, one(req_id=1, key="s")).first().val == "v"


@pytest.mark.parametrize("args,reply", [
    (["ZADD", "z", "nan", "m"], "ERR value is not a valid float"), (["ZADD", "z", "INCR", "1", "m"], "ERR ZADD INCR is not supported"),
    (["EXPIRE", "k", "9223372036854775807"], "ERR invalid expire time in 'expire' command"), (["EXPIRE", "k", "1", "NX", "XX"], "ERR NX and XX, GT or LT options at the same time are not compatible"),
    (["SET", "k", "v", "NX", "XX"], "ERR syntax error"), (["SET", "k", "v", "EX", "0"], "ERR invalid expire time in 'set' command"), (["RENAMENX", "no", "x"], "ERR no such key"),
    (["COPY", "a", "a"], "ERR source and destination objects are the same"), (["NOPE"], "ERR unknown command 'NOPE'"), (["GET"], "ERR wrong number of arguments for 'get' command"), (["HSET", "h", "f"], "ERR wrong number of arguments for 'hset' command"),
])
def test_errors(args, reply):
    assert Machine().execute(args, 10)[0] == ("error", reply)


def test_expiry_decisions():
    m = Machine()
    m.execute(["SET", "k", "v"], 10)
    r, e = m.execute(["EXPIREAT", "k", "0"], 10)
    assert r == ("int", 1) and [x.op for x in e] == ["DEL"]
    m.execute(["SET", "k", "v", "PX", "5"], 10)
    r, e = m.execute(["MSETNX", "k", "1", "j", "2"], 15)
    assert r == ("int", 1) and [x.op for x in e] == ["DEL", "SET", "SET"]
    m.execute(["ZADD", "z", "1", "m"], 15)
    r, e = m.execute(["ZADD", "z", "CH", "1", "m"], 15)
    assert r == ("int", 0) and e == []
    assert m.execute(["SADD", "new", "a"], 15)[1][0].replaces_state and not m.execute(["SADD", "new", "b"], 15)[1][0].replaces_state


def test_flush_schedule(spark):
    cases = [(first, last, ev) for first in (0, 500_000) for last in (500_000, 900_000) for ev in (120, 700, 5000)]
    df = spark.createDataFrame(cases, "first long, last long, ev int")
    got = [tuple(r.f) for r in df.select(compact.flush_at(F.col("first"), F.col("last"), F.col("ev"), 45, 90).alias("f")).collect()]
    plain = lambda first, last, ev: min((last + 45_000, 0, "quiet"), (first + (ev - 90) * 1000, 1, "deadline"))
    assert got == [(at, why) for at, _, why in (plain(*c) for c in cases)] and {w for _, w in got} == {"quiet", "deadline"}
    assert compact.max_jitter_ms(70) == 7000


def test_wire_protocol(spark, tmp_path):
    assert resp.inline_tokens(b"set  key \"a\\x41\\n\" 'it\\'s'") == [b"set", b"key", b"aA\n", b"it's"]
    for bad in (b'"open', b"'open", b'"a"b'):
        with pytest.raises(resp.Malformed):
            resp.inline_tokens(bad)
    data = b"*2\r\n$3\r\nGET\r\n$1\r\nk\r\nPING\r\n\r\n*1\r\n$4\r\nINFO\r\n*2\r\n$3\r\nGE"
    (tmp_path / "a.resp").write_bytes(data)
    (tmp_path / "b.resp").write_bytes(b"*1\r\n:5\r\n")
    got = resp.read_commands(spark.read.format("binaryFile").load(str(tmp_path))).orderBy("path", "pos").collect()
    assert [(r.args, r.err) for r in got] == [(["GET", "k"], None), (["PING"], None), (["INFO"], None), (None, "incomplete"), (None, "ERR Protocol error: a command is an array of bulk strings")]
    nested = b"*4\r\n+fine\r\n$-1\r\n*2\r\n:-7\r\n*0\r\n-no\r\n"
    assert resp.decode_frame(nested) == ([("simple", "fine"), None, [-7, []], ("error", "no")], len(nested))
    assert resp.decode_frame(b"*1\r\n" * 1000 + b":1\r\n")[1] == 4004
    assert list(resp.decode_commands(b"*1\r\n" * 5000)) == [(None, "ERR Protocol error: nested too deeply")]
    (tmp_path / "raw").mkdir()
    (tmp_path / "raw/c.resp").write_bytes(b"".join(b"*2\r\n$3\r\nGET\r\n$1\r\n" + k + b"\r\n" for k in (b"\xff", b"\xfe", b"k")))
    raw = resp.read_commands(spark.read.format("binaryFile").load(str(tmp_path / "raw"))).orderBy("pos").collect()
    assert [(r.args, bytes(r.raw[1]), r.err) for r in raw] == [(None, b"\xff", "ERR arguments must be UTF-8 text"), (None, b"\xfe", "ERR arguments must be UTF-8 text"), (["GET", "k"], b"k", None)]
    df = spark.createDataFrame([("int", 5, None, None, None), ("nil", None, None, None, None), ("array", None, None, ["é", None], None), ("error", None, None, None, "ERR x")], "kind string, i long, s string, arr array<string>, err string")
    wire = [r[0] for r in df.select(resp.encode_reply(*[F.col(c) for c in df.columns])).collect()]
    assert wire == [":5\r\n", "$-1\r\n", "*2\r\n$2\r\né\r\n$-1\r\n", "-ERR x\r\n"]


def test_frames(spark, tmp_path):
    assert frames.crc32c(b"123456789") == 0xE3069283
    for n in (0, 127, 128, 1 << 40):
        assert frames.read_varint(frames.varint(n)) == (n, len(frames.varint(n)))
    xs = [-math.inf, -1.5, -0.0, 0.5, 2.0, math.inf]
    assert sorted(xs, key=frames.sortable_double) == xs
    one = frames.encode_frame([b"SET", b"k", b"v"], 3, 7, 123, True, 9, 55)
    two = frames.encode_frame(None, 3, 8, 124, False, 9, 55)
    open_batch = frames.encode_frame([b"DEL", b"k"], 3, 9, 125, True, 9, 55, batch_rest=4096)
    (tmp_path / "s.wal").write_bytes(one + two + open_batch)
    (tmp_path / "t.wal").write_bytes(one + bytes([two[0]]) + two[1:20] + b"\xff" + two[21:])
    got = frames.read_segments(spark.read.format("binaryFile").load(str(tmp_path)), 9, 55).orderBy("path", "offset").collect()
    assert [(r.seq, r.flush, r.args, r.replaces_state) for r in got] == [(7, False, ["SET", "k", "v"], True), (8, True, None, False), (7, False, ["SET", "k", "v"], True)]


def test_registry_parse_and_config(spark):
    reqs = spark.createDataFrame([(1, 0, ["get", "k"]), (2, 0, ["GET"]), (3, 0, ["nope"]), (4, 0, ["config", "bad", "x"]), (5, 0, ["CLUSTER", "slots"])], "req_id int, at_ms long, args array<string>")
    err = {r.req_id: r.err for r in registry.resolve(reqs).collect()}
    assert err[1] is None and err[5] is None and "arguments" in err[2] and "unknown command" in err[3] and "subcommand" in err[4]
    w = spark.createDataFrame([(1, 1000, ["SET", "k", "v", "px", "NX"]), (2, 1000, ["SET", "k", "v", "EX", "5", "NX"]), (3, 1000, ["zadd", "z", "gt", "CH", "1", "a", "x", "b"]), (4, 1000, ["EXPIRE", "k", "-1", "LT"])], "req_id int, at_ms long, args array<string>")
    got = {(r.req_id, r.ord): r for r in parse.typed_writes(w).collect()}
    assert got[(1, 0)].err == "ERR value is not an integer or out of range" and got[(2, 0)].ttl_ms == 6000 and got[(2, 0)].flags == 1
    assert got[(3, 0)].score == 1.0 and got[(3, 0)].flags == 80 and got[(3, 1)].err == "ERR value is not a valid float"
    assert got[(4, 0)].ttl_ms == 1 and got[(4, 0)].flags == 512
    c = Config.load(env={"FOLDKEEP_SHARDS": "8", "FOLDKEEP_DURABILITY": "power_loss"})
    assert c.shards == 8 and sorted(r.name for r in config_get(c.table(spark), "*_SECONDS").collect()) == ["default_eviction_seconds", "min_retention_seconds", "quiet_seconds", "safety_margin_seconds"]
    with pytest.raises(ValueError):
        Config.load(env={"FOLDKEEP_SHARDS": "0"})


WRITE_CASES = [
    "SET k v NX XX", "SET k v BOGUS", "SET k v EX", "SET k v EX 0", "SET k v EX x", "SET k v EX 5 KEEPTTL", "SET k v EX 5 PX 5", "SET k v nx get ex 5", "SET k v",
    "SETEX k 0 v", "SETEX k 9 v", "PSETEX k x v", "ZADD z INCR 1 a", "ZADD z NX XX 1 a", "ZADD z GT LT 1 a", "ZADD z NX GT 1 a", "ZADD z NX CH", "ZADD z CH 1", "ZADD z 1 CH 2 b",
    "ZADD z x a", "EXPIRE k 5 NX GT", "EXPIRE k 5 GT LT", "EXPIRE k 5 huh", "EXPIRE k x huh", "EXPIRE k 9223372036854775807", "PEXPIREAT k 5 XX", "COPY a b DB 1", "COPY a b DB x",
    "COPY a b DB", "COPY a a", "COPY a b REPLACE DB 0", "COPY a b huh", "MSET a 1 b", "MSET a 1 b 2", "HSET h f", "HSET h f 1", "HMSET h f 1 g", "FLUSHDB huh", "FLUSHALL async", "DEL a b",
]


def test_errors_of_writes_are_those_of_the_model(spark):
    """One error a case, as the plain-Python model tells it; a wrong request is one row."""
    reqs = spark.createDataFrame([(i, 1000, c.split()) for i, c in enumerate(WRITE_CASES)], "req_id int, at_ms long, args array<string>")
    got = {}
    for r in parse.typed_writes(reqs).orderBy("req_id", "ord").collect():
        got.setdefault(r.req_id, []).append(r)
    for i, c in enumerate(WRITE_CASES):
        reply, _ = Machine().execute(c.split(), 1000)
        errors = [r.err for r in got[i] if r.err is not None]
        expected = [reply[1]] if reply[0] == "error" else []
        assert errors == expected, (c, errors, reply)
    row = got[WRITE_CASES.index("ZADD z 1 CH 2 b")]
    assert [(r.elem, r.score, r.flags) for r in row] == [("CH", 1.0, 0), ("b", 2.0, 0)]
    assert (got[WRITE_CASES.index("COPY a b REPLACE DB 0")][0].elem, got[WRITE_CASES.index("FLUSHALL async")][0].op) == ("b", "FLUSH")


def test_reads_become_typed_rows(spark):
    cases = {
        "get k": ("GET", "k", None, None, None), "PTTL k": ("TTL", "k", None, None, None), "HMGET h a b": ("HMGET", "h", ["a", "b"], None, None), "GET": ("GET", None, None, None, "ERR wrong number of arguments for 'get' command"),
        "ZRANGE z 0 -1 rev WITHSCORES": ("ZRANGE", "z", None, "index", None), "ZRANGE z (1 5 BYSCORE LIMIT 1 2": ("ZRANGE", "z", None, "score", None), "ZRANGE z - + BYLEX BYSCORE": ("ZRANGE", "z", None, "score", "ERR syntax error"),
        "ZRANGE z 0 x": ("ZRANGE", "z", None, "index", "ERR value is not an integer or out of range"), "ZRANGE z 0 1 LIMIT 1": ("ZRANGE", "z", None, "index", "ERR syntax error"), "ZRANGE z 0 1 LIMIT x 1": ("ZRANGE", "z", None, "index", "ERR value is not an integer or out of range"),
        "ZRANGEBYSCORE z 1 2 LIMIT 3 -4 WITHSCORES": ("ZRANGE", "z", None, "score", None), "ZRANGEBYSCORE z 1 2 REV": ("ZRANGE", "z", None, "score", "ERR syntax error"), "ZRANGEBYLEX z [a + WITHSCORES": ("ZRANGE", "z", None, "lex", "ERR syntax error"),
    }
    reqs = spark.createDataFrame([(i, 0, c.split()) for i, c in enumerate([*cases, "MGET a b", "SET k v"])], "req_id int, at_ms long, args array<string>")
    got = {r.req_id: r for r in parse.typed_reads(reqs).collect()}
    assert len(got) == len(cases)
    for i, (c, expected) in enumerate(cases.items()):
        r = got[i]
        assert (r.op, r.key, r.elems, r.mode, r.err) == expected, c
    at = lambda c: got[list(cases).index(c)]
    assert at("ZRANGE z 0 -1 rev WITHSCORES").rev and at("ZRANGE z 0 -1 rev WITHSCORES").with_scores and at("PTTL k").millis
    assert (at("ZRANGEBYSCORE z 1 2 LIMIT 3 -4 WITHSCORES").start, at("ZRANGEBYSCORE z 1 2 LIMIT 3 -4 WITHSCORES").take) == (3, -4)
