"""Numbers, bounds and times as the protocol reads and writes them."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

_NUMBER = r"^-?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$"


def strict_int(text: Column) -> Column:
    """A 64-bit integer if the whole text is one without sign +, spaces or other signs, else null."""
    return F.when(text.rlike(r"^-?[0-9]+$"), text.try_cast("bigint"))


def strict_double(text: Column) -> Column:
    """A double if the whole text is one; one leading + is allowed, infinities too, NaN is not (null)."""
    body = F.regexp_replace(text, r"^\+(?=[^+-])", "")
    low = F.lower(body)
    return (
        F.when(low.isin("inf", "infinity"), F.lit(float("inf")))
        .when(low.isin("-inf", "-infinity"), F.lit(float("-inf")))
        .when(body.rlike(_NUMBER), body.try_cast("double"))
    )


def absolute_ttl(value: Column, unit_ms: int, relative: bool, now_ms: Column) -> Column:
    """Milliseconds since the epoch, at least 1 (0 means none); null if it overflows."""
    ms = F.try_multiply(value, F.lit(unit_ms).cast("bigint"))
    ms = F.try_add(now_ms, ms) if relative else ms
    return F.when(ms.isNotNull(), F.greatest(F.lit(1).cast("bigint"), ms))


def is_live(abs_ttl_ms: Column, now_ms: Column | int) -> Column:
    """A key is gone from the instant of its expiry on."""
    now = now_ms if isinstance(now_ms, Column) else F.lit(now_ms)
    return F.coalesce(abs_ttl_ms, F.lit(0)).isin(0) | (now < abs_ttl_ms)


def ttl_reply(found: Column, abs_ttl_ms: Column, now_ms: Column | int, millis: bool) -> Column:
    """-2 if absent, -1 without expiry, else what is left (seconds are rounded to the nearest)."""
    now = now_ms if isinstance(now_ms, Column) else F.lit(now_ms)
    left = F.greatest(abs_ttl_ms - now, F.lit(0))
    left = left if millis else F.floor((left + 500) / 1000)
    return F.when(~found, F.lit(-2)).when(F.coalesce(abs_ttl_ms, F.lit(0)) == 0, F.lit(-1)).otherwise(left).cast("bigint")


@F.pandas_udf(StringType())
def score_text(score: pd.Series) -> pd.Series:
    """A score as replies print it, with up to 17 digits; the one function that Spark's formats can't express."""
    return score.map(lambda x: None if x != x else f"{x:.17g}")


def score_bound(text: Column) -> Column:
    """``struct(v double, open boolean)`` of a score bound such as ``5``, ``(5``, ``-inf``; null if it is no number."""
    is_open = text.startswith("(")
    v = strict_double(F.when(is_open, F.substring(text, 2, 1 << 30)).otherwise(text))
    return F.when(v.isNotNull(), F.struct(v.alias("v"), is_open.alias("open")))


def lex_bound(text: Column) -> Column:
    """``struct(kind, v)``: kind -1 and 1 are the ends, 0 a closed and 2 an open bound; null if it is no bound."""
    first, rest = F.substring(text, 1, 1), F.substring(text, 2, 1 << 30)
    kind = F.when(text == "-", -1).when(text == "+", 1).when(first == "[", 0).when(first == "(", 2)
    return F.when(kind.isNotNull(), F.struct(kind.alias("kind"), rest.alias("v")))


def glob_like(text: Column, pattern: str) -> Column:
    """Whether a text fits a pattern of ``*`` and ``?``, without regard to case."""
    escaped = "".join({"*": "%", "?": "_", "%": r"\%", "_": r"\_", "\\": r"\\"}.get(c, c) for c in pattern)
    return text.ilike(escaped)


def next_prefix(prefix: str) -> str | None:
    """The smallest text above all that begin with ``prefix`` (None: there is none)."""
    for i in range(len(prefix) - 1, -1, -1):
        if ord(prefix[i]) < 0x10FFFF:
            c = ord(prefix[i]) + 1
            return prefix[:i] + chr(0xE000 if 0xD800 <= c < 0xE000 else c)
    return None


def splitmix64(x: Column) -> Column:
    """The finalizer of splitmix64 on bigints, products taken modulo 2**64."""

    def times(a: Column, b: int) -> Column:
        # 64-bit product from 32-bit halves, so that nothing overflows under ANSI rules
        lo, hi = b & 0xFFFFFFFF, b >> 32
        m16 = F.lit(0xFFFF).cast("bigint")
        part = lambda k: F.shiftrightunsigned(a, 16 * k).bitwiseAND(m16)
        bs = [lo & 0xFFFF, lo >> 16, hi & 0xFFFF, hi >> 16]
        out, carry = None, F.lit(0).cast("bigint")
        for k in range(4):
            s = carry
            for i in range(k + 1):
                s = s + part(i) * F.lit(bs[k - i]).cast("bigint")
            digit = F.shiftleft(s.bitwiseAND(m16), 16 * k)
            out = digit if out is None else out.bitwiseOR(digit)
            carry = F.shiftrightunsigned(s, 16)
        return out

    x = times(x.bitwiseXOR(F.shiftrightunsigned(x, 30)), 0xBF58476D1CE4E5B9)
    x = times(x.bitwiseXOR(F.shiftrightunsigned(x, 27)), 0x94D049BB133111EB)
    return x.bitwiseXOR(F.shiftrightunsigned(x, 31))
