"""Placement of keys: hash tags, CRC16, slots, shards, and eviction classes by prefix."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLOTS = 16384
#: Fixed value: the CRC-16/XMODEM polynomial.
POLYNOMIAL = 0x1021


def crc16_table() -> list[int]:
    """The 256 remainders of the CRC, from the polynomial."""
    out = []
    for byte in range(256):
        r = byte << 8
        for _ in range(8):
            r = (r << 1 ^ POLYNOMIAL if r & 0x8000 else r << 1) & 0xFFFF
        out.append(r)
    return out


def crc16(key: Column) -> Column:
    """CRC16 of a string's UTF-8 bytes (or of a binary), as an int; inside Catalyst, without a UDF."""
    table = F.array(*[F.lit(x) for x in crc16_table()])
    hexed = F.hex(key.cast("binary"))
    digits = F.transform(F.sequence(F.lit(0), F.greatest(F.length(hexed) / 2 - 1, F.lit(0)).cast("int")), lambda i: F.conv(F.substring(hexed, i * 2 + 1, F.lit(2)), 16, 10).cast("int"))

    def step(crc: Column, byte: Column) -> Column:
        index = F.shiftright(crc, 8).bitwiseXOR(byte).bitwiseAND(F.lit(255))
        return F.shiftleft(crc, 8).bitwiseAND(F.lit(0xFFFF)).bitwiseXOR(F.element_at(table, index + 1))

    return F.when(F.length(hexed) == 0, F.lit(0)).otherwise(F.aggregate(digits, F.lit(0), step))


def hashtag(key: Column) -> Column:
    """What stands between the first ``{`` and the first ``}`` after it, or the whole key if that is empty or missing."""
    tag = F.regexp_extract(key, r"(?s)^[^{]*\{([^}]+)\}", 1)
    return F.when(tag != "", tag).otherwise(key)


def slot(key: Column) -> Column:
    return (crc16(hashtag(key)) % SLOTS).cast("int")


def shard_of_slot(slot: Column, shards: int) -> Column:
    """The shard of a slot: slots are dealt in equal runs."""
    return F.floor(slot * shards / SLOTS).cast("int")


def shard(key: Column, shards: int) -> Column:
    return shard_of_slot(slot(key), shards)


def crosses_logs(keys: Column, shards: int, logs: int = 1) -> Column:
    """Whether the keys of one command belong to different logs."""
    return F.size(F.array_distinct(F.transform(keys, lambda k: shard(k, shards) % logs))) > 1


def cluster_slots(spark, shards: int) -> DataFrame:
    """``shard, first_slot, last_slot`` of every shard that owns slots."""
    s = spark.range(SLOTS).select(F.col("id").cast("int").alias("slot"))
    return s.groupBy(shard_of_slot(F.col("slot"), shards).alias("shard")).agg(F.min("slot").alias("first_slot"), F.max("slot").alias("last_slot"))


def check_policy(default_s: int, overrides: list[tuple[str, int]]) -> None:
    """Refuse policies with non-positive times, empty or repeated prefixes."""
    if default_s <= 0 or any(s <= 0 for _, s in overrides):
        raise ValueError("eviction times must be positive")
    prefixes = [p for p, _ in overrides]
    if not all(prefixes) or len(set(prefixes)) != len(prefixes):
        raise ValueError("prefixes must be different and not empty")


def eviction_seconds(key: Column, overrides: list[tuple[str, int]], default_s: int = 86400) -> Column:
    """The time of the longest prefix that fits: a chain of tests, longest prefixes first."""
    check_policy(default_s, overrides)
    out = None
    for p, s in sorted(overrides, key=lambda o: (-len(o[0]), o[0])):
        out = (F if out is None else out).when(key.startswith(p), F.lit(s))
    return F.lit(default_s) if out is None else out.otherwise(F.lit(default_s))
