"""Workloads: keys by distribution, operation mixes, schedules, histograms and rate sweeps, as DataFrames."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def unit(seed: int, i: Column) -> Column:
    """A uniform number in (0, 1) for each index, by a keyed hash, so that any task computes the same."""
    return (F.shiftrightunsigned(F.xxhash64(F.lit(seed), i), 11).cast("double") + 0.5) / float(1 << 53)


def uniform_key(n: int, seed: int, i: Column) -> Column:
    return F.floor(unit(seed, i) * n).cast("long")


def zeta(n: int, theta: float) -> float:
    """The sum of ``k**-theta`` for k to n; beyond a million terms the tail is an Euler-Maclaurin integral."""
    m = min(n, 1_000_000)
    head = math.fsum(k**-theta for k in range(1, m + 1))
    if n == m:
        return head
    integral = math.log(n / m) if theta == 1 else (n ** (1 - theta) - m ** (1 - theta)) / (1 - theta)
    return head + integral + (n**-theta - m**-theta) / 2


def zipf_key(n: int, theta: float, seed: int, i: Column) -> Column:
    """Zipfian ranks from 0 with exponent ``theta`` below 1, by the closed form with precomputed sums."""
    if not 0 < theta < 1:
        raise ValueError("the closed form needs an exponent between 0 and 1; see zipf_steep_key")
    total = zeta(n, theta)
    alpha, eta = 1 / (1 - theta), (1 - (2 / n) ** (1 - theta)) / (1 - zeta(2, theta) / total)
    u = unit(seed, i)
    k = F.floor(F.pow(u * eta - eta + 1, F.lit(alpha)) * n)
    return F.least(F.when(u * total < 1, 0).when(u * total < 1 + 0.5**theta, 1).otherwise(k), F.lit(n - 1)).cast("long")


def zipf_steep_key(n: int, theta: float, seed: int, i: Column, tries: int = 24) -> Column:
    """Zipfian ranks from 0 for any exponent, by rejection from the inverse of the integral (expected tries below 1.2)."""
    h = (lambda x: F.log(x)) if theta == 1 else (lambda x: (F.pow(x, F.lit(1 - theta)) - 1) / (1 - theta))
    inverse = (lambda y: F.exp(y)) if theta == 1 else (lambda y: F.pow(y * (1 - theta) + 1, F.lit(1 / (1 - theta))))
    low, high = h(F.lit(1.5)) - 1, h(F.lit(n + 0.5))
    out: Column | None = None
    for t in reversed(range(tries)):
        y = low + unit(seed * 1000 + t, i) * (high - low)
        k = F.least(F.greatest(F.floor(inverse(y) + 0.5), F.lit(1)), F.lit(n))
        out = k if out is None else F.when(y >= h(k + 0.5) - F.pow(k, F.lit(-theta)), k).otherwise(out)
    return (out - 1).cast("long")


def latest_key(n: int, theta: float, seed: int, i: Column) -> Column:
    """The newest keys are the most likely."""
    return F.lit(n - 1) - zipf_key(n, theta, seed, i)


def pick(u: Column, mix: dict[str, float]) -> Column:
    """One of the names, each with its share."""
    total, edge, out = sum(mix.values()), 0.0, None
    for name, share in mix.items():
        edge += share / total
        out = (F if out is None else out).when(u < edge, F.lit(name))
    return out.otherwise(F.lit(list(mix)[-1]))


def requests(spark: SparkSession, n: int, keys: int, mix: dict[str, float], rate: float, theta: float | None = None, seed: int = 42, value_bytes: int = 64, burst: int = 1) -> DataFrame:
    """``req_id, due_us, op, key, val`` of an open-loop workload: request i is due at its place in the schedule, whatever came before."""
    i = F.col("id")
    key = uniform_key(keys, seed, i) if theta is None else zipf_key(keys, theta, seed, i)
    due = (F.expr(f"id div {int(burst)}") * (burst * 1_000_000 / rate)).cast("long")
    val = F.substring(F.repeat(F.sha2(i.cast("string"), 256), value_bytes // 64 + 1), 1, value_bytes)
    op = pick(unit(seed + 1, i), mix)
    return spark.range(n).select(i.alias("req_id"), due.alias("due_us"), op.alias("op"), F.concat(F.lit("k"), key.cast("string")).alias("key"), F.when(op == "SET", val).alias("val"))


# The shape of a traced workload, as shares.
TTL_SHARES = {"0": 0.15, "60": 0.25, "240": 0.15, "3600": 0.25, "86400": 0.20}
VALUE_SHARES = {"16-99": 0.30, "100-400": 0.64, "401-16383": 0.01, "16384-65536": 0.05}


def trace_shape(spark: SparkSession, n: int, collections: float = 0.2, seed: int = 7) -> DataFrame:
    """``i, key_length, type, ttl_s, value_bytes``: keys of 10 to 50 bytes, a share of collections, expiry within 10 % of its class, sizes by class."""
    i = F.col("id")
    ttl = pick(unit(seed + 2, i), TTL_SHARES).cast("long")
    span = F.split(pick(unit(seed + 4, i), VALUE_SHARES), "-")
    low, high = span[0].cast("long"), span[1].cast("long")
    return spark.range(n).select(
        i.alias("i"), (F.floor(unit(seed, i) * 41) + 10).alias("key_length"),
        pick(unit(seed + 1, i), {"string": 1 - collections, "set": collections / 2, "zset": collections / 2}).alias("type"),
        F.round(ttl * (0.9 + 0.2 * unit(seed + 3, i))).cast("long").alias("ttl_s"), (low + F.floor(unit(seed + 5, i) * (high - low + 1))).alias("value_bytes"),
    )


def latencies(done: DataFrame, due_us: str = "due_us", done_us: str = "done_us") -> DataFrame:
    """Latency from when a request was due, not from when it was sent: waiting counts."""
    return done.withColumn("latency_us", F.col(done_us) - F.col(due_us))


def quantiles(lat: DataFrame, by: list[str], at: tuple[float, ...] = (0.5, 0.99, 0.999), accuracy: int = 10_000) -> DataFrame:
    return lat.groupBy(*by).agg(F.percentile_approx("latency_us", list(at), accuracy).alias("quantiles"), F.count("*").alias("n"))


def histogram(lat: DataFrame, digits: int = 2) -> DataFrame:
    """``bucket_us, n``: counts by value, rounded down to so many leading digits."""
    step = F.pow(F.lit(10), F.greatest(F.floor(F.log10(F.greatest("latency_us", F.lit(1)))) - digits + 1, F.lit(0)))
    return lat.groupBy((F.floor(F.col("latency_us") / step) * step).cast("long").alias("bucket_us")).agg(F.count("*").alias("n"))


def histogram_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """What a scraped histogram has gained between two scrapes: ``series, le, n``."""
    b = before.select("series", "le", F.col("n").alias("_n"))
    return after.join(b, ["series", "le"], "left").select("series", "le", (F.col("n") - F.coalesce("_n", F.lit(0))).alias("n"))


def highest_rate(runs: DataFrame) -> DataFrame:
    """The highest offered rate up to which every run has passed (``rate, passed``)."""
    w = Window.orderBy("rate").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return runs.withColumn("_all", F.min(F.col("passed").cast("int")).over(w)).where("_all = 1").agg(F.max("rate").alias("rate"))
