"""The command table, as a DataFrame: lookup, arity, keys and subcommands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Name, arity (arguments with the name, negative: at least), first and last key, step, class.
COMMANDS = """
PING -1 0 0 0 admin
ECHO 2 0 0 0 admin
QUIT 1 0 0 0 admin
HELLO -1 0 0 0 admin
CLIENT -2 0 0 0 admin
RESET 1 0 0 0 admin
TIME 1 0 0 0 admin
COMMAND -1 0 0 0 admin
CONFIG -3 0 0 0 admin
INFO -1 0 0 0 admin
CLUSTER -2 0 0 0 admin
DBSIZE 1 0 0 0 admin
FLUSHDB -1 0 0 0 admin
FLUSHALL -1 0 0 0 admin
GET 2 1 1 1 read
SET -3 1 1 1 write
SETNX 3 1 1 1 write
SETEX 4 1 1 1 write
PSETEX 4 1 1 1 write
STRLEN 2 1 1 1 read
MGET -2 1 -1 1 read
MSET -3 1 -1 2 write
MSETNX -3 1 -1 2 write
SADD -3 1 1 1 write
SREM -3 1 1 1 write
SMEMBERS 2 1 1 1 read
SISMEMBER 3 1 1 1 read
SMISMEMBER -3 1 1 1 read
SCARD 2 1 1 1 read
SRANDMEMBER -2 1 1 1 read
ZADD -4 1 1 1 write
ZREM -3 1 1 1 write
ZSCORE 3 1 1 1 read
ZMSCORE -3 1 1 1 read
ZCARD 2 1 1 1 read
ZRANK -3 1 1 1 read
ZREVRANK -3 1 1 1 read
ZRANGE -4 1 1 1 read
ZRANGEBYSCORE -4 1 1 1 read
ZRANGEBYLEX -4 1 1 1 read
ZCOUNT 4 1 1 1 read
ZLEXCOUNT 4 1 1 1 read
HSET -4 1 1 1 write
HMSET -4 1 1 1 write
HDEL -3 1 1 1 write
HGET 3 1 1 1 read
HMGET -3 1 1 1 read
HEXISTS 3 1 1 1 read
HGETALL 2 1 1 1 read
HKEYS 2 1 1 1 read
HVALS 2 1 1 1 read
HLEN 2 1 1 1 read
DEL -2 1 -1 1 write
UNLINK -2 1 -1 1 write
EXISTS -2 1 -1 1 read
EXPIRE -3 1 1 1 write
PEXPIRE -3 1 1 1 write
EXPIREAT -3 1 1 1 write
PEXPIREAT -3 1 1 1 write
PERSIST 2 1 1 1 write
TTL 2 1 1 1 read
PTTL 2 1 1 1 read
EXPIRETIME 2 1 1 1 read
PEXPIRETIME 2 1 1 1 read
TYPE 2 1 1 1 read
RENAMENX 3 1 2 1 write
COPY -3 1 2 1 write
HSETNX 4 1 1 1 write
OBJECT -3 2 2 1 read
"""
SUBCOMMANDS = {
    "CLIENT": ("ID", "GETNAME", "SETNAME", "NO-EVICT"), "CLUSTER": ("SLOTS", "SHARDS", "NODES", "INFO", "MYID", "KEYSLOT", "COUNTKEYSINSLOT"),
    "COMMAND": ("COUNT", "INFO", "DOCS"), "CONFIG": ("GET",), "OBJECT": ("ENCODING", "IDLETIME"),
}


def registry(spark: SparkSession) -> DataFrame:
    """``command, arity, first_key, last_key, step, class`` of all commands."""
    rows = [(n, *map(int, x), c) for n, *x, c in (line.split() for line in COMMANDS.split("\n") if line)]
    return spark.createDataFrame(rows, "command string, arity int, first_key int, last_key int, step int, class string")


def subcommands(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(c, s) for c, ss in SUBCOMMANDS.items() for s in ss], "command string, subcommand string")


def arity_holds(n: Column, arity: Column) -> Column:
    return F.when(arity >= 0, n == arity).otherwise(n >= -arity)


def resolve(requests: DataFrame) -> DataFrame:
    """Requests with their command's row and ``err`` where the name is unknown, the number of arguments or the subcommand wrong.

    The table has a fixed number of rows and is broadcast.
    """
    spark = requests.sparkSession
    r = requests.withColumn("command", F.upper(F.try_element_at("args", F.lit(1))))
    r = r.join(F.broadcast(registry(spark)), "command", "left")
    subs = subcommands(spark).select("command", F.col("subcommand").alias("_sub"), F.lit(True).alias("_known"))
    r = r.withColumn("_sub", F.upper(F.try_element_at("args", F.lit(2)))).join(F.broadcast(subs), ["command", "_sub"], "left")
    low = F.lower(F.element_at("args", 1))
    err = (
        F.when(F.size("args") == 0, "ERR empty command")
        .when(F.col("arity").isNull(), F.concat(F.lit("ERR unknown command '"), F.element_at("args", 1), F.lit("'")))
        .when(~arity_holds(F.size("args"), F.col("arity")), F.concat(F.lit("ERR wrong number of arguments for '"), low, F.lit("' command")))
        .when(F.col("command").isin(*SUBCOMMANDS) & (F.size("args") > 1) & F.col("_known").isNull(), F.concat(F.lit("ERR unknown subcommand '"), F.element_at("args", 2), F.lit("'")))
    )
    return r.withColumn("err", err).drop("_sub", "_known")
