"""Schemas of the canonical tables.

``log`` holds one row per element that a decided write touches; rows of one
command share ``seq`` and are told apart by ``ord``. ``element`` and ``meta`` are
the state folded from it: one row an element, one row a key.
"""

LOG = (
    "shard int, seq long, ord int, batch long, appended_at_ms long, op string, key string, elem string, "
    "val string, score double, ttl_ms long, replaces_state boolean"
)
ELEMENT = "shard int, key string, type string, elem string, val string, score double"
META = "shard int, key string, type string, abs_ttl_ms long, cardinality long, latest_seq long"
REQUESTS = "req_id long, at_ms long, args array<string>"
REPLIES = "req_id long, kind string, i long, s string, arr array<string>, err string"
DELTA = (
    "shard int, key string, type string, tombstone boolean, delete_all boolean, ttl_intent string, abs_ttl_ms long, "
    "adds array<struct<elem:string,val:string,score:double>>, removes array<string>, first_seq long, last_seq long, write_count long"
)

#: Effects of a log, by the type of value that they make.
TYPE_OF_OP = {"SET": "string", "SADD": "set", "SREM": "set", "ZADD": "zset", "ZREM": "zset", "HSET": "hash", "HDEL": "hash"}
ADDS, REMOVES, TTL_OPS = ("SADD", "ZADD", "HSET"), ("SREM", "ZREM", "HDEL"), ("PEXPIREAT", "PERSIST")

# Error texts of the protocol.
WRONGTYPE = "WRONGTYPE Operation against a key holding the wrong kind of value"
NOT_INTEGER = "ERR value is not an integer or out of range"
NOT_FLOAT = "ERR value is not a valid float"
SYNTAX = "ERR syntax error"
NO_KEY = "ERR no such key"
CROSSSLOT = "CROSSSLOT Keys in request don't hash to the same slot"
BAD_SCORE_RANGE = "ERR min or max is not a float"
