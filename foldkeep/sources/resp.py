"""The wire protocol: decoding of requests, inline commands, and encoding of replies and commands."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The protocol's limits.
MOST_ELEMENTS, MOST_BULK, MOST_DEPTH = 1_048_576, 512 << 20, 1024

_ESCAPES = {ord("n"): 10, ord("t"): 9, ord("r"): 13, ord("a"): 7, ord("b"): 8}


class Malformed(ValueError):
    """Bytes that are no protocol."""


class Incomplete(Exception):
    """Bytes that end before the frame does."""


def _line(data: bytes, at: int) -> tuple[bytes, int]:
    end = data.find(b"\r\n", at)
    if end < 0:
        raise Incomplete
    return data[at:end], end + 2


def _count(text: bytes, most: int) -> int:
    body = text[1:] if text[:1] == b"-" else text
    if not body.isdigit() or int(text) > most or int(text) < -1:
        raise Malformed(f"invalid length {text!r}")
    return int(text)


def _one(data: bytes, at: int) -> tuple[str, object, int]:
    """What begins at a place: a whole value, or an array with so many elements to come."""
    if at >= len(data):
        raise Incomplete
    kind, (line, at) = data[at : at + 1], _line(data, at + 1)
    if kind in b"+-":
        return "value", ("simple" if kind == b"+" else "error", line.decode("utf-8", "replace")), at
    if kind == b":":
        digits = line[1:] if line[:1] in (b"-", b"+") else line
        if not digits.isdigit() or not -(1 << 63) <= int(line) < 1 << 63:
            raise Malformed("invalid integer")
        return "value", int(line), at
    if kind not in b"$*":
        raise Malformed(f"unknown type {kind!r}")
    n = _count(line, MOST_BULK if kind == b"$" else MOST_ELEMENTS)
    if n < 0:
        return "value", None, at
    if kind == b"*":
        return "array", n, at
    if at + n + 2 > len(data):
        raise Incomplete
    if data[at + n : at + n + 2] != b"\r\n":
        raise Malformed("bulk string without its end")
    return "value", data[at : at + n], at + n + 2


def decode_frame(data: bytes, at: int = 0) -> tuple[object, int]:
    """One value and the place after it: bytes, int, None, lists, ``("simple", s)`` or ``("error", s)``. Nesting takes no recursion."""
    nested: list[tuple[list, int]] = []  # the arrays that are open, and the number of their elements
    while True:
        what, v, at = _one(data, at)
        if what == "array" and len(nested) >= MOST_DEPTH:
            raise Malformed("nested too deeply")
        if what == "array" and v:
            nested.append(([], v))
            continue
        done = [] if what == "array" else v
        while nested:
            items, n = nested[-1]
            items.append(done)
            if len(items) < n:
                break
            done = nested.pop()[0]
        else:
            return done, at


def inline_tokens(line: bytes) -> list[bytes]:
    """Words of an inline command, with double and single quotes and their escapes."""
    out: list[bytes] = []
    i, n = 0, len(line)
    while True:
        while i < n and line[i] in b" \t\r\n\v\f\0":
            i += 1
        if i >= n:
            return out
        word = bytearray()
        quote = 0
        while i < n and (quote or line[i] not in b" \t\r\n\v\f\0"):
            c = line[i]
            if not quote and c in b"\"'":
                if word:
                    raise Malformed("unbalanced quotes in request")
                quote = c
            elif quote == 0x22 and c == 0x5C and i + 1 < n:
                i += 1
                e = line[i]
                if e == ord("x"):
                    try:
                        word.append(int(line[i + 1 : i + 3].decode(), 16) if len(line[i + 1 : i + 3]) == 2 else int("?"))
                    except ValueError:
                        raise Malformed("inline: bad hex escape") from None
                    i += 2
                else:
                    word.append(_ESCAPES.get(e, e))
            elif quote == 0x27 and c == 0x5C and line[i + 1 : i + 2] == b"'":
                i += 1
                word.append(0x27)
            elif quote and c == quote:
                if i + 1 < n and line[i + 1] not in b" \t\r\n\v\f\0":
                    raise Malformed("unbalanced quotes in request")
                quote = -1
                i += 1
                break
            else:
                word.append(c)
            i += 1
        if quote > 0:
            raise Malformed("unbalanced quotes in request")
        out.append(bytes(word))


def decode_commands(data: bytes) -> Iterator[tuple[list[bytes] | None, str | None]]:
    """Commands of a stream of bytes, arrays or inline; ``(None, error)`` ends a stream that breaks off or is malformed."""
    at = 0
    while at < len(data):
        try:
            if data[at : at + 1] == b"*":
                v, at = decode_frame(data, at)
                if v is None:
                    continue
                if not all(isinstance(x, bytes) for x in v):
                    raise Malformed("a command is an array of bulk strings")
                if v:
                    yield v, None
            else:
                end = data.find(b"\n", at)
                if end < 0:
                    raise Incomplete
                words = inline_tokens(data[at:end].removesuffix(b"\r"))
                at = end + 1
                if words:
                    yield words, None
        except Incomplete:
            yield None, "incomplete"
            return
        except Malformed as e:
            yield None, f"ERR Protocol error: {e}"
            return


def _text(args: list[bytes] | None, err: str | None) -> tuple[list[str] | None, list[bytes] | None, str | None]:
    try:
        return None if args is None else [x.decode() for x in args], args, err
    except UnicodeDecodeError:
        return None, args, "ERR arguments must be UTF-8 text"


def read_commands(files: DataFrame, content: str = "content", path: str = "path") -> DataFrame:
    """``path, pos, args, raw, err`` of the commands in each file of a ``binaryFile`` table: arguments as text, and as bytes.

    Arguments that are no UTF-8 have no text: the row has an ``err`` instead of
    ``args``, so that different keys never become one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows = [(i, *_text(v, e)) for i, (v, e) in enumerate(decode_commands(data or b""))]
                for a in range(0, len(rows), 10_000):
                    part = rows[a : a + 10_000]
                    yield pa.RecordBatch.from_pydict({
                        "path": pa.array([name] * len(part), pa.string()), "pos": pa.array([r[0] for r in part], pa.int64()),
                        "args": pa.array([r[1] for r in part], pa.list_(pa.string())), "raw": pa.array([r[2] for r in part], pa.list_(pa.binary())), "err": pa.array([r[3] for r in part], pa.string()),
                    })

    return files.select(path, content).mapInArrow(run, "path string, pos long, args array<string>, raw array<binary>, err string")


def encode_command(args: Column) -> Column:
    """A command as the array of bulk strings that goes over the wire."""
    each = F.transform(args, lambda a: F.concat(F.lit("$"), F.octet_length(a).cast("string"), F.lit("\r\n"), a, F.lit("\r\n")))
    return F.concat(F.lit("*"), F.size(args).cast("string"), F.lit("\r\n"), F.array_join(each, ""))


def encode_reply(kind: Column, i: Column, s: Column, arr: Column, err: Column) -> Column:
    """A reply (schema ``REPLIES``) as it goes over the wire; null elements are null bulk strings."""
    bulk = lambda x: F.when(x.isNull(), F.lit("$-1\r\n")).otherwise(F.concat(F.lit("$"), F.octet_length(x).cast("string"), F.lit("\r\n"), x, F.lit("\r\n")))
    return (
        F.when(kind == "int", F.concat(F.lit(":"), i.cast("string"), F.lit("\r\n")))
        .when(kind == "simple", F.concat(F.lit("+"), s, F.lit("\r\n")))
        .when(kind == "error", F.concat(F.lit("-"), err, F.lit("\r\n")))
        .when(kind == "bulk", bulk(s)).when(kind == "nil", F.lit("$-1\r\n"))
        .when(kind == "array", F.concat(F.lit("*"), F.size(arr).cast("string"), F.lit("\r\n"), F.array_join(F.transform(arr, bulk), "")))
    )
