import collections
import math

from pyspark.sql import functions as F

from foldkeep import workload as w


def shares(df, n):
    c = collections.Counter(r.k for r in df.collect())
    return {k: v / n for k, v in c.items()}


def test_zipf_shares(spark):
    n, keys = 40_000, 1000
    for theta, key in ((0.9, w.zipf_key), (1.2, w.zipf_steep_key), (1.0, w.zipf_steep_key)):
        got = shares(spark.range(n).select(key(keys, theta, 3, F.col("id")).alias("k")), n)
        total = math.fsum(k**-theta for k in range(1, keys + 1))
        assert min(got) >= 0 and max(got) < keys
        for k in (0, 1, 9):
            want = (k + 1) ** -theta / total
            assert abs(got.get(k, 0) - want) < 0.25 * want + 0.003
    assert abs(w.zeta(2_000_000, 0.9) - w.zeta(1_000_000, 0.9) - math.fsum(k**-0.9 for k in range(1_000_001, 2_000_001))) < 1e-6


def test_requests_and_measures(spark):
    r = w.requests(spark, 1000, 50, {"GET": 0.9, "SET": 0.1}, rate=1000, theta=0.99, burst=10)
    assert r.where("op = 'SET' and length(val) <> 64").isEmpty() and r.agg(F.max("due_us")).first()[0] == 990_000
    assert 50 < r.where("op = 'SET'").count() < 160
    late = w.latencies(r.withColumn("done_us", F.col("due_us") + F.col("req_id") + 1))
    assert late.agg(F.max("latency_us")).first()[0] == 1000
    assert {x.bucket_us: x.n for x in w.histogram(late, 1).collect()}[100] == 100
    assert w.quantiles(late, ["op"]).count() == 2
    runs = spark.createDataFrame([(100, True), (200, True), (300, False), (400, True)], "rate int, passed boolean")
    assert w.highest_rate(runs).first().rate == 200
    t = w.trace_shape(spark, 20_000)
    assert abs(t.where("type = 'string'").count() / 20_000 - 0.8) < 0.02 and t.where("key_length < 10 or key_length > 50").isEmpty()
    assert w.latest_key(10, 0.5, 1, F.lit(3)) is not None
    a = spark.createDataFrame([("s", 1, 5)], "series string, le int, n int")
    assert w.histogram_delta(a, a.withColumn("n", F.col("n") + 2)).first().n == 2
