"""Token counts under a byte-level BPE vocabulary, without making identifiers.

Method: each pre-token starts as its UTF-8 bytes in a doubly linked list; a heap
holds every adjacent pair that the merge table ranks; the lowest rank (leftmost
on ties) is popped and merged again and again. The count is the number of bytes
less the number of merges. Counts are kept by pre-token in a bounded table, as
the same pre-tokens return in most documents.
"""

from __future__ import annotations

import heapq
import json
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldkeep.session import lean

# The byte-level pre-tokenizer's split pattern, as the vocabulary's library defines it.
SPLIT = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
).replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")

#: Bits for a symbol's number in a pair's key, and for a place in a heap entry.
SYMBOL, PLACE = 32, 40
AT = (1 << PLACE) - 1


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in the vocabulary file, by the public rule:
    printable Latin-1 bytes stand for themselves, the others for the characters from U+0100 on, in order."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class MergeCounter:
    """Counts BPE tokens of texts for one ``tokenizers`` JSON file.

    Counts of the last ``keep`` to ``2 * keep`` different pre-tokens are remembered.
    """

    def __init__(self, path: str, keep: int = 400_000):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, model = spec["pre_tokenizer"] or {}, spec["model"]
        if model["type"] != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or spec.get("normalizer"):
            raise ValueError("only byte-level BPE files without a normalizer and prefix space are supported")
        specials = [a["content"] for a in spec["added_tokens"]]
        if any(a["single_word"] or a["lstrip"] or a["rstrip"] for a in spec["added_tokens"]):
            raise ValueError("added tokens that take in neighbouring characters are not supported")
        alphabet = byte_alphabet()
        raw = lambda s: bytes(alphabet[c] for c in s)
        pairs = [tuple(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        ident = {bytes([b]): b for b in range(256)}  # symbols are numbers: bytes stand for themselves
        for x, y in pairs:
            ident.setdefault(raw(x + y), len(ident))
        self.rank = {ident[raw(x)] << SYMBOL | ident[raw(y)]: i for i, (x, y) in enumerate(pairs)}
        self.made = [ident[raw(x + y)] for x, y in pairs]
        self.split = regex.compile(SPLIT).findall
        longest_first = sorted(map(regex.escape, specials), key=len, reverse=True)
        self.special = regex.compile("|".join(longest_first)) if specials else None
        self.keep, self.seen, self.old = keep, {}, {}

    def pieces(self, word: bytes) -> int:
        """Tokens of one pre-token by heap and linked list."""
        n = len(word)
        if n < 2:
            return n
        rank, made = self.rank.get, self.made
        part = list(word)
        heap = [r << PLACE | i for i in range(n - 1) if (r := rank(part[i] << SYMBOL | part[i + 1])) is not None]
        if not heap:
            return n
        heapq.heapify(heap)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        pop, push, merges = heapq.heappop, heapq.heappush, 0
        while heap:
            top = pop(heap)
            i, r = top & AT, top >> PLACE
            j = right[i]
            if j >= n or part[i] < 0 or rank(part[i] << SYMBOL | part[j]) != r:
                continue  # one of the two was merged meanwhile
            part[i] = s = made[r]
            part[j] = -1
            right[i] = k = right[j]
            merges += 1
            if k < n:
                left[k] = i
                if (r := rank(s << SYMBOL | part[k])) is not None:
                    push(heap, r << PLACE | i)
            if (h := left[i]) >= 0 and (r := rank(part[h] << SYMBOL | s)) is not None:
                push(heap, r << PLACE | h)
        return n - merges

    def count(self, text: str) -> int:
        """Tokens of a whole text; special strings count one each, as the library's default has it."""
        total, parts = 0, [text]
        if self.special is not None and self.special.search(text):
            parts = self.special.split(text)
            total = len(parts) - 1
        seen, pieces = self.seen, self.pieces
        for part in parts:
            for word, times in Counter(self.split(part)).items():
                c = seen.get(word)
                if c is None:
                    if (c := self.old.get(word)) is None:
                        c = pieces(word.encode())
                    if len(seen) >= self.keep:
                        self.old, seen = seen, {}
                        self.seen = seen
                    seen[word] = c
                total += c * times
        return total


_counters: dict[str, MergeCounter] = {}


def counter(path: str) -> MergeCounter:
    """One counter per worker process and vocabulary."""
    if path not in _counters:
        _counters[path] = MergeCounter(path)
    return _counters[path]


def count_tokens(docs: DataFrame, vocabulary: str, text: str = "text", n_bytes: str = "n_bytes", n_tokens: str = "n_tokens") -> DataFrame:
    """``docs`` with the columns ``n_bytes`` (UTF-8) and ``n_tokens`` added; no shuffle.

    ``vocabulary`` is the path of a byte-level BPE JSON file, the same on every
    executor. Null and empty texts have 0 bytes and 0 tokens; repeated rows are
    each counted; an empty table stays empty. Columns of ``docs`` that clash
    with the two new names are replaced. Memory is one Arrow batch plus the
    bounded table of counts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(vocabulary)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text))
            own = pa.array([c.count(t.as_py() or "") for t in texts], pa.int64())
            cols = {f.name: batch.column(i) for i, f in enumerate(batch.schema) if f.name not in (text, n_tokens)}
            yield pa.RecordBatch.from_pydict(cols | {n_tokens: own})

    keep = [c for c in docs.columns if c not in (text, n_bytes, n_tokens)]
    slim = docs.select(*keep, F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long").alias(n_bytes), text)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema if f.name != text)
    return slim.mapInArrow(lean(run), f"{fields}, `{n_tokens}` long")
