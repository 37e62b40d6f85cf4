"""SentencePiece BPE encoding with seeded merge-dropout, and lossless decoding.

A text's spaces become U+2581 and a dummy one leads it, as the model has it. The
characters between two such marks (with the marks before them) are a unit; no
piece of the model crosses its border, so units are encoded one by one. In a
unit an agenda holds every adjacent pair whose join is a piece; the best score
(leftmost on ties) is taken and joined, and new pairs join the agenda. The
agendas of many units run side by side, as rows of a matrix, a step of all of
them at a XX ``dropout``, by a keyed hash of the seed, the document, the unit's
place and the candidate's start and two pieces; so a rerun gives the same
pieces, and every occurrence of a unit, and of a pair in it, is drawn by itself.
Occurrences of a unit share a row as long as their draws agree; where they
differ, the row is split.

Decoding is exact for every text: marks decode to spaces, and characters that
the model lacks, as well as U+2581 itself where a text holds it, are encoded as
bytes. Without dropout, identifiers equal the library's for texts without
U+2581.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldkeep.session import free_name, lean

MARK = "▁"
_UNIT = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
_MASK = (1 << 64) - 1


#: Bits for a symbol in a pair's key, and for a place in an agenda entry.
SYMBOL, PLACE = 24, 32
_AT = (1 << PLACE) - 1
_ODD, _PAIR, _START = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F
#: Units up to these numbers of characters share a matrix; longer ones are joined one by one.
_WIDTHS = (4, 6, 8, 10, 12, 16, 20, 26, 34)
_NONE = np.iinfo(np.int32).max
#: Occurrences of units that are joined side by side.
TOGETHER = 40_000
#: Identifiers that are decoded at once.
DECODE_IDS = 1 << 18
#: Bytes of texts whose units are joined at once.
BATCH_BYTES = 1 << 20


class PairTable:
    """Pairs of symbols to the rank and number of the piece that they make, by open addressing."""

    def __init__(self, pairs: dict[int, int], rank: list[int]):
        bits = max(4, int(len(pairs) * 3).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.key = np.full(1 << bits, -1, np.int64)
        self.piece = np.full(1 << bits, -1, np.int32)
        self.rank = np.full(1 << bits, _NONE, np.int32)
        for k, p in pairs.items():
            at = (k * _ODD & _MASK) >> (64 - bits)
            while self.key[at] >= 0:
                at = at + 1 & self.mask
            self.key[at], self.piece[at], self.rank[at] = k, p, rank[p]

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Places in the table; places of pairs that make no piece have rank ``_NONE``."""
        want = left.astype(np.int64) << SYMBOL | right
        at = (want.astype(np.uint64) * np.uint64(_ODD) >> self.shift).astype(np.int64)
        got = self.key[at]
        todo = np.flatnonzero((got != want) & (got >= 0))
        while len(todo):
            at[todo] = at[todo] + 1 & self.mask
            got = self.key[at[todo]]
            todo = todo[(got != want[todo]) & (got >= 0)]
        return at


def _gathered(ids: np.ndarray, size: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Identifiers of the segmentations ``of`` one after the other, and the number of each, from those of all segmentations."""
    n = size[of]
    return ids[np.repeat((np.cumsum(size) - size)[of], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)], n


class Pieces:
    """A BPE model with byte fallback."""

    def __init__(self, path: str, dropout: float = 0.0, seed: int = 0):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        names = [sp.id_to_piece(i) for i in range(n)]
        special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) for i in range(n)]
        self.byte = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        if not all(sp.is_byte(i) for i in self.byte):
            raise ValueError("only models with byte fallback are supported")
        plain = [i for i in range(n) if not special[i] and not sp.is_byte(i)]
        if any(MARK in names[i].lstrip(MARK) for i in plain) or sp.normalize("  ﬁ x ") != f"{MARK}{MARK}{MARK}ﬁ{MARK}x{MARK}":
            raise ValueError("only models that keep texts as they are, with marks in front, are supported")
        self.id = {names[i]: i for i in plain}
        ranks = {v: r for r, v in enumerate(sorted({sp.get_score(i) for i in plain}, reverse=True))}
        self.rank = [0] * n
        #: Each piece of several characters, by the numbers of any two pieces that it is made of.
        self.pair: dict[int, int] = {}
        for i in plain:
            self.rank[i] = ranks[sp.get_score(i)]
            p = names[i]
            for c in range(1, len(p)):
                x, y = self.id.get(p[:c]), self.id.get(p[c:])
                x = n + ord(p[0]) if x is None and c == 1 else x
                y = n + ord(p[-1]) if y is None and c == len(p) - 1 else y
                if x is not None and y is not None:
                    self.pair[x << SYMBOL | y] = i
        self.size = n
        self.bytes_of: list[bytes] = [b""] * n
        for i in plain:
            self.bytes_of[i] = names[i].replace(MARK, " ").encode()
        for b, i in enumerate(self.byte):
            self.bytes_of[i] = bytes([b])
        self.letters = np.frombuffer(b"".join(self.bytes_of), np.uint8)
        self.length = np.array([len(x) for x in self.bytes_of])
        self.begin = np.cumsum(self.length) - self.length
        self.table = PairTable(self.pair, self.rank)
        self.char = np.arange(0x110000, dtype=np.int32) + n
        for p, i in self.id.items():
            if len(p) == 1:
                self.char[ord(p)] = i
        self.dropout, self.seed = dropout, seed
        self.limit = min(int(dropout * (1 << 64)), _MASK)

    def _salt(self, key: np.ndarray) -> np.ndarray:
        """Keys of occurrences, by the seed."""
        x = (key.astype(np.uint64) ^ np.uint64(self.seed * _PAIR + 0xCBF29CE484222325 & _MASK)) * np.uint64(_ODD)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(_PAIR)
        return x ^ (x >> np.uint64(29))

    def _skipped(self, key: np.ndarray, start: np.ndarray, left: np.ndarray, right: np.ndarray, own: np.ndarray) -> np.ndarray:
        """Whether occurrences of salted ``key`` skip the candidates that ``own`` picks from those given by start and two symbols."""
        x = (left.astype(np.int64) << SYMBOL | right).astype(np.uint64) * np.uint64(_PAIR) + start.astype(np.uint64) * np.uint64(_START)
        x = key ^ (x ^ (x >> np.uint64(31)))[own]
        x = (x ^ (x >> np.uint64(32))) * np.uint64(_ODD)
        return (x ^ (x >> np.uint64(29))) * np.uint64(_PAIR) < np.uint64(self.limit)

    def join(self, unit: str, key: int) -> list[int]:
        """Identifiers of one occurrence of a unit by agenda."""
        n, of, pair, rank = self.size, self.id.get, self.pair.get, self.rank
        part = [of(c, n + ord(c)) for c in unit]
        m = len(part)
        agenda = [rank[p] << PLACE | i for i in range(m - 1) if (p := pair(part[i] << SYMBOL | part[i + 1])) is not None]
        if agenda:
            heapq.heapify(agenda)
            pop, push = heapq.heappop, heapq.heappush
            left, right = list(range(-1, m - 1)), list(range(1, m + 1))
            limit = self.limit
            salted = int(self._salt(np.array([key], np.uint64))[0])
            while agenda:
                top = pop(agenda)
                i = top & _AT
                j = right[i]
                if part[i] < 0 or j >= m or (p := pair(part[i] << SYMBOL | part[j])) is None or rank[p] != top >> PLACE:
                    continue  # one of the two was joined meanwhile
                if limit:  # as _skipped
                    x = (part[i] << SYMBOL | part[j]) * _PAIR + i * _START & _MASK
                    x ^= salted ^ x >> 31
                    x = (x ^ x >> 32) * _ODD & _MASK
                    if (x ^ x >> 29) * _PAIR & _MASK < limit:
                        continue
                k = right[j]
                part[i] = p
                part[j] = -1
                right[i] = k
                if k < m:
                    left[k] = i
                    if (q := pair(p << SYMBOL | part[k])) is not None:
                        push(agenda, rank[q] << PLACE | i)
                if (h := left[i]) >= 0 and (q := pair(part[h] << SYMBOL | p)) is not None:
                    push(agenda, rank[q] << PLACE | h)
        out: list[int] = []
        for p in part:
            if p >= n:
                out.extend([self.byte[b] for b in chr(p - n).encode()])
            elif p >= 0:
                out.append(p)
        return out

    def _candidates(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranks (``_NONE``: no piece) and pieces of candidates, given by their two symbols."""
        at = self.table.find(a, b)
        return self.table.rank[at], self.table.piece[at]

    def join_rows(self, codes: np.ndarray, row: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of segmentations (-1 past the last symbol), and the segmentation of each occurrence.

        ``codes`` are units as rows of character codes (0 past their end); an occurrence has a row and a salted key.
        """
        m, w = codes.shape
        # one column more than characters, so that the last one is always empty
        sym = np.full((m, w + 1), -1, np.int32)
        sym[:, :w] = np.where(codes > 0, self.char[codes], -1)
        start = np.tile(np.arange(w + 1, dtype=np.int32), (m, 1))
        # rank and piece of the candidate that begins at each place
        rank, piece = np.full((m, w + 1), _NONE, np.int32), np.full((m, w + 1), -1, np.int32)
        own, col = np.nonzero(sym[:, 1:] >= 0)
        rank[own, col], piece[own, col] = self._candidates(sym[own, col], sym[own, col + 1])
        done, n, of, occurrence = [], 0, np.empty(len(row), np.int64), np.arange(len(row))
        ahead = np.arange(w)
        while True:
            at = rank.argmin(1)
            live = rank[np.arange(len(at)), at] < _NONE
            if not live.all():
                done.append(sym[~live])
                ended = ~live[row]
                of[occurrence[ended]] = n + (np.cumsum(~live) - 1)[row[ended]]
                n += len(done[-1])
                occurrence, key, row = occurrence[~ended], key[~ended], (np.cumsum(live) - 1)[row[~ended]]
                sym, start, rank, piece, at = sym[live], start[live], rank[live], piece[live], at[live]
            if not len(at):
                return np.concatenate(done), of
            every = np.arange(len(at))
            if self.limit:
                skip = self._skipped(key, start[every, at], sym[every, at], sym[every, at + 1], row)
                some = np.bincount(row[skip], minlength=len(at))
                whole = some == np.bincount(row, minlength=len(at))
                split = np.flatnonzero((some > 0) & ~whole)
                # those that skip leave for a new row, if others of theirs join
                to = every.copy()
                to[split] = len(at) + np.arange(len(split))
                row = np.where(skip, to[row], row)
                rests = np.concatenate([np.flatnonzero(whole), to[split]])
                sym, start, rank, piece = (np.concatenate([x, x[split]]) for x in (sym, start, rank, piece))
                at = np.concatenate([at, at[split]])
                rank[rests, at[rests]] = _NONE
                every = np.flatnonzero(~whole)
                at[rests] = w + 1
            joined = piece[every, at[every]]
            # what stands after the joined pair moves one place to the left
            later = ahead >= at[:, None] + 1
            for x in (sym, start, rank, piece):
                np.copyto(x[:, :-1], x[:, 1:].copy(), where=later)
            at = at[every]
            sym[every, at] = joined
            rank[every, at] = _NONE
            for own, c in ((every, at), (every[at > 0], at[at > 0] - 1)):
                some = sym[own, c + 1] >= 0
                own, c = own[some], c[some]
                rank[own, c], piece[own, c] = self._candidates(sym[own, c], sym[own, c + 1])

    def segment(self, words: list[str], index: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Identifiers of segmentations one after the other, the number of each, and the segmentation of each occurrence.

        An occurrence is of the unit ``words[index]`` and has a key.
        """
        size, of = np.array([len(u) for u in words], np.int64), np.empty(len(index), np.int64)
        if not len(index):
            return np.empty(0, np.int32), np.empty(0, np.int64), of
        plain = np.array(["\x00" not in u for u in words])
        salted = self._salt(key)
        parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # segmentation, place, identifier
        order = np.argsort(index, kind="stable")
        high = np.where(plain, size, _NONE)[index[order]]
        low = n = 0
        for w in _WIDTHS:
            mine = order[(high > low) & (high <= w)]
            low = w
            for own in (mine[i : i + TOGETHER] for i in range(0, len(mine), TOGETHER)):
                new = np.r_[True, np.diff(index[own]) != 0]
                these = [words[i] for i in index[own][new].tolist()]
                codes = np.array(these, dtype=f"U{w}").view(np.uint32).reshape(len(these), w).astype(np.int64)
                sym, mapped = self.join_rows(codes, np.cumsum(new) - 1, salted[own])
                of[own] = n + mapped
                r, c = np.nonzero(sym >= 0)
                parts.append((n + r, c, sym[r, c]))
                n += len(sym)
        for i in order[high > low].tolist():
            ids = self.join(words[index[i]], int(key[i]))
            parts.append((np.full(len(ids), n), np.arange(len(ids)), np.array(ids, np.int32)))
            of[i] = n
            n += 1
        unit, place, ids = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((place, unit))
        unit, ids = unit[order], ids[order]
        foreign = np.flatnonzero(ids >= self.size)  # characters that the model lacks become bytes
        if len(foreign):
            spelled = [[self.byte[b] for b in chr(c - self.size).encode("utf-8", "surrogatepass")] for c in ids[foreign].tolist()]
            times = np.ones(len(ids), np.int64)
            times[foreign] = [len(x) for x in spelled]
            unit, at = np.repeat(unit, times), np.repeat(np.arange(len(ids)), times)
            ids = ids[at]
            ids[np.isin(at, foreign)] = np.concatenate(spelled)
        return ids.astype(np.int32), np.bincount(unit, minlength=n), of

    def join_all(self, units: list[str], key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Identifiers of units one after the other, and the number of each; every one has a key."""
        return _gathered(*self.segment(units, np.arange(len(units)), key))

    def encode_all(self, texts: list[str], documents: list) -> tuple[np.ndarray, np.ndarray]:
        """Identifiers of whole texts one after the other, and the number of each."""
        # runs of units; those of no units stand for a mark of the text itself, which is spelled in bytes
        runs, doc, first = [], [], []
        for d, t in enumerate(texts):
            for k, part in enumerate(t.split(MARK) if t else []):
                if k:
                    runs.append([])
                    doc.append(d)
                    first.append(0)
                runs.append(_UNIT.findall((MARK if not k else "") + part.replace(" ", MARK)))
                doc.append(d)
                # the text counts too, so that documents that share an identifier don't share draws
                first.append(xxhash.xxh64_intdigest(part, xxhash.xxh64_intdigest(f"{documents[d]}/{k}", self.seed & _MASK)) if self.limit else 0)
                if k and not part:  # two marks in a row, or one at the end: nothing stands between them
                    runs.pop(), doc.pop(), first.pop()
        if not runs:
            return np.empty(0, np.int32), np.zeros(len(texts), np.int64)
        count = np.array([len(u) for u in runs], np.int64)
        marks = np.flatnonzero(count == 0)
        units = pa.array([u for x in runs for u in x], pa.string()).dictionary_encode()
        index, words = units.indices.to_numpy().astype(np.int64), units.dictionary.to_pylist()
        if self.limit:
            start = np.repeat(np.array(first, np.uint64), count)
            place = (np.arange(len(index)) - np.repeat(np.cumsum(count) - count, count)).astype(np.uint64) * np.uint64(_ODD) + start
            ids, size, back = self.segment(words, index, (place ^ (place >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9))
        else:
            ids, size, back = self.segment(words, np.arange(len(words)), np.zeros(len(words), np.uint64))
            back = back[index]
        flat, n = _gathered(ids, size, back)
        by_run = np.bincount(np.repeat(np.arange(len(count)), count), n, len(count)).astype(np.int64)
        if len(marks):
            spelled = np.array([self.byte[b] for b in MARK.encode()], np.int32)
            ends = np.cumsum(by_run)
            flat = np.insert(flat, np.repeat(ends[marks], len(spelled)), np.tile(spelled, len(marks)))
            by_run[marks] = len(spelled)
        return flat, np.bincount(np.array(doc, np.int64), by_run, len(texts)).astype(np.int64)

    def encode(self, text: str, document: object = None) -> np.ndarray:
        """Identifiers of a whole text (empty: none)."""
        return self.encode_all([text], [document])[0]

    def decode_all(self, ids: np.ndarray, count: np.ndarray) -> list[str]:
        """Texts of identifiers that lie one after the other, ``count`` for each; leading marks are dropped."""
        size = self.length[ids]
        ends = np.concatenate([[0], np.cumsum(size)])
        data = self.letters[np.repeat(self.begin[ids] - ends[:-1], size) + np.arange(ends[-1])].tobytes()
        at = ends[np.concatenate([[0], np.cumsum(count)])].tolist()
        return [data[a + 1 : z].decode() for a, z in zip(at[:-1], at[1:], strict=True)]

    def decode(self, ids) -> str:
        """The text of identifiers that ``encode`` made; the leading mark is dropped."""
        return self.decode_all(np.asarray(ids, np.int64), np.array([len(ids)]))[0]


_models: dict[tuple, Pieces] = {}


def model(path: str, dropout: float, seed: int) -> Pieces:
    """One model per worker process and setting."""
    key = (path, dropout, seed)
    if key not in _models:
        _models[key] = Pieces(path, dropout, seed)
    return _models[key]


def encode(docs: DataFrame, path: str, dropout: float = 0.1, seed: int = 0, doc_id: str = "doc_id", text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` with ``ids`` (array<int>) in place of ``text``; no shuffle.

    Null and empty texts have no identifiers; rows with equal doc_id and text
    have equal ones (a null doc_id is one like others). Very long texts are
    encoded whole, by themselves. A clashing column ``ids`` is replaced; columns
    of any other name pass through.
    """
    others = [c for c in docs.columns if c not in (text, ids)]
    named, said = free_name(docs, "_id"), free_name(docs, "_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path, dropout, seed)
        for whole in batches:
            size = pc.fill_null(pc.binary_length(whole.column(whole.schema.get_field_index(said))), 0).to_numpy(zero_copy_only=False)
            a, ends = 0, np.cumsum(size.astype(np.int64))
            while a < whole.num_rows:
                z = max(a + 1, int(np.searchsorted(ends, ends[a] - size[a] + BATCH_BYTES, "right")))
                b = whole.slice(a, z - a)
                flat, count = m.encode_all([t or "" for t in b.column(b.schema.get_field_index(said)).to_pylist()], b.column(b.schema.get_field_index(named)).to_pylist())
                upto = np.concatenate([[0], np.cumsum(count)]).astype(np.int32)
                yield pa.RecordBatch.from_pydict({c: b.column(b.schema.get_field_index(c)) for c in others} | {ids: pa.ListArray.from_arrays(pa.array(upto), pa.array(flat, pa.int32()))})
                a = z

    slim = docs.select(*[f"`{c}`" for c in others], F.col(doc_id).cast("string").alias(named), F.col(text).alias(said))
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.schema if f.name in others)
    return slim.mapInArrow(lean(run), f"{fields}`{ids}` array<int>")


def decode(rows: DataFrame, path: str, ids: str = "ids", text: str = "text") -> DataFrame:
    """``rows`` with ``text`` in place of ``ids``; null identifiers decode to null. No shuffle."""
    others = [c for c in rows.columns if c not in (text, ids)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path, 0.0, 0)
        for whole in batches:
            lists = whole.column(whole.schema.get_field_index(ids))
            ends, a = np.cumsum(lists.value_lengths().fill_null(0).to_numpy()), 0
            while a < whole.num_rows:
                z = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + DECODE_IDS, "right")))
                b = whole.slice(a, z - a)
                mine = b.column(b.schema.get_field_index(ids))
                told = m.decode_all(mine.flatten().to_numpy(), mine.value_lengths().fill_null(0).to_numpy())
                told = [t if ok else None for t, ok in zip(told, mine.is_valid().to_pylist(), strict=True)]
                yield pa.RecordBatch.from_pydict({c: b.column(b.schema.get_field_index(c)) for c in others} | {text: pa.array(told, pa.string())})
                a = z

    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema if f.name in others)
    return rows.select(*[f"`{c}`" for c in others], ids).mapInArrow(lean(run), f"{fields}`{text}` string")
