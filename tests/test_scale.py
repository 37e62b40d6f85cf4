"""Rows that plans make on the way: they grow with the input, not with its square."""

import random
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import functions as F

from foldkeep.model import Machine
from foldkeep.operators import reads
from foldkeep.operators.answer import answers
from foldkeep.operators.decide import decide, groups, to_log
from foldkeep.operators.fold import fold
from foldkeep.operators.reads import Keyspace
from foldkeep.sources import log as logs
from foldkeep.streaming.compaction_stream import Compactor


@contextmanager
def set_to(spark, **settings):
    names = {k.replace("__", "."): v for k, v in settings.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def most_rows(spark, df):
    """The rows of ``df``, and the most that any node of its plan put out."""
    with set_to(spark, spark__sql__adaptive__enabled="false"):
        rows, top, nodes = df.collect(), 0, [df._jdf.queryExecution().executedPlan()]
        while nodes:
            p = nodes.pop()
            n = p.metrics().get("numOutputRows")
            top = max(top, n.get().value() if n.isDefined() else 0)
            nodes += [p.children().apply(i) for i in range(p.children().size())]
    return rows, top


def sorted_set(spark, n):
    e = spark.range(n).select(F.lit(0).alias("shard"), F.lit("z").alias("key"), F.lit("zset").alias("type"), F.format_string("m%05d", "id").alias("elem"), F.lit(None).cast("string").alias("val"), F.col("id").cast("double").alias("score"))
    return Keyspace(e, e.groupBy("shard", "key", "type").agg(F.count("*").alias("cardinality")).withColumn("abs_ttl_ms", F.lit(0).cast("long")))


def test_ranges_with_a_limit_dont_list_what_it_leaves_out(spark):
    n = 600
    ks = sorted_set(spark, n)
    i = F.col("id").cast("string")
    args = F.when(F.col("id") % 2 == 0, F.array(F.lit("ZRANGE"), F.lit("z"), i, F.lit("+inf"), F.lit("BYSCORE"), F.lit("LIMIT"), F.lit("1"), F.lit("2"))).otherwise(F.array(F.lit("ZRANGE"), F.lit("z"), F.lit("0"), F.lit("1"), F.lit("REV")))
    rows, top = most_rows(spark, answers(ks, spark.range(n).select(F.col("id").alias("req_id"), args.alias("args"))))
    want = lambda k: [f"m{x:05d}" for x in ((k + 1, k + 2) if k % 2 == 0 else (n - 1, n - 2)) if x < n]
    assert {r.req_id: r.arr for r in rows} == {k: want(k) for k in range(n)}
    assert top <= 4 * n
    asked = spark.range(n).select(F.col("id").alias("req_id"), F.lit("z").alias("key"), F.concat(F.lit("("), i).alias("min"), F.lit("+inf").alias("max"))
    rows, top = most_rows(spark, reads.zcount(ks, asked))
    assert {r.req_id: r.n for r in rows} == {k: n - 1 - k for k in range(n)} and top <= 4 * n
    rows, top = most_rows(spark, reads.zrange_score(ks, asked.withColumn("min", F.lit("-inf")).withColumn("max", F.col("req_id").cast("string")), offset=0, count=1))
    assert {(r.req_id, r.rank, r.elem) for r in rows} == {(k, 0, "m00000") for k in range(n)} and top <= 4 * n


def test_commands_of_several_keys_dont_make_one_group(spark):
    """DEL, MGET, EXISTS and MSET with a key that all have in common; time runs back now and then, and the clock is common."""
    r, reqs = random.Random(5), []
    for i in range(500):
        k, j = f"k{r.randrange(40)}", f"k{r.randrange(40)}"
        a = r.choice([["SET", k, str(i), "NX", "PX", "900"], ["SET", k, str(i), "PX", "300"], ["DEL", k, "x", k], ["MSET", k, "1", "x", "2", k, "3"], ["MGET", k, "x", k], ["EXISTS", k, "x", j], ["MSET", k, "1", "x"], ["SADD", k, "m"], ["TTL", k]])
        reqs.append((i, 1000 + i * 40 - r.choice([0, 0, 700]), a))
    reqs.insert(0, (-1, 1, ["DEL", *[f"k{i}" for i in range(40)], "x"]))
    m, now, want, wrote = Machine(), 0, {}, {}
    for i, at, a in reqs:
        now = max(now, at)
        (kind, v), effects = m.execute(a, now)
        want[i] = (kind, [None if x is None else str(x) for x in v] if kind == "array" else v)
        wrote |= {(i, n): (e.op, e.key, e.val, e.ttl_ms) for n, e in enumerate(effects)}
    df = spark.createDataFrame(reqs, "req_id long, at_ms long, args array<string>")
    assert groups(df).select("group").distinct().count() == 41
    effects, answered = decide(df)
    assert {x.req_id: (x.kind, {"int": x.i, "array": x.arr, "error": x.err}.get(x.kind, x.s)) for x in answered.collect()} == want
    assert {(x.req_id, x.ord): (x.op, x.key, x.val, x.ttl_ms) for x in effects.collect()} == wrote


def test_groups_are_decided_many_a_task(spark):
    """No call, frame or sort a group: keys without a tie are decided in one run over a task's rows."""
    df = spark.range(200).select(F.col("id").alias("req_id"), F.lit(1).cast("long").alias("at_ms"), F.array(F.lit("SETNX"), (F.col("id") % 90).cast("string"), F.lit("v")).alias("args"))
    base = fold(to_log(decide(df.where("req_id < 10"))[0]))
    for replies in (decide(df)[1], decide(df, base)[1]):
        plan = replies._jdf.queryExecution().optimizedPlan().toString()
        assert "MapInArrow" in plan and "GroupsInPandas" not in plan
    assert [x.req_id for x in replies.where("i = 1").orderBy("req_id").collect()] == list(range(10, 90))


def test_bytes_of_a_window_equal_the_window_function(spark):
    """One sum for all windows: equal instants, gaps, nulls, a second shard; no frame is summed again a row."""
    r = random.Random(2)
    rows = [(i, r.choice([0, 0, 1, None]), r.choice([None, *[x * 5 for x in range(40)]]), r.choice([None, 0, 7, 100])) for i in range(600)] + [(600, 0, (1 << 63) - 1, 5)]
    w = spark.createDataFrame(rows, "seq int, shard int, at_ms long, bytes long")
    got = logs.admitted(w, 500, 20)
    assert "RangeFrame, -20" not in got._jdf.queryExecution().optimizedPlan().toString()
    near = lambda a, b: a is b if a is None or b is None else b - 20 <= a <= b
    for x in got.collect():
        held = [b for _, s, t, b in rows if s == x.shard and near(t, x.at_ms) and b is not None]
        total = sum(held) if held else None
        assert (x.in_window, x.admit) == (total, None if total is None else total <= 500)
    assert got.count() == 601


def test_flushes_of_one_call_are_one_frame():
    """A key of many flushes in one batch costs one frame, not one a flush."""

    class Store:
        timers, state = [], None
        exists, get = lambda self: self.state is not None, lambda self: self.state
        update, clear = lambda self, x: setattr(self, "state", x), lambda self: setattr(self, "state", None)
        listTimers, deleteTimer, registerTimer = lambda self: list(self.timers), lambda self, t: self.timers.remove(t), lambda self, t: self.timers.append(t)

    c = Compactor(10, 25)
    c.pending = c.handle = Store()
    at = [0, 30, 38, 46, 54, 90, 100]
    frames = list(c.handleInputRows(("k",), iter([pd.DataFrame({"at_ms": at[::-1], "seq": range(7)[::-1]})]), None))
    assert [x.values.tolist() for x in frames] == [[["k", 0, 0, 1, 0, "quiet"], ["k", 30, 54, 4, 4, "deadline"], ["k", 90, 90, 1, 5, "quiet"]]]
    assert c.pending.state == (100, 100, 1, 6) and c.handle.timers == [110]
