"""Language identification of whole texts by a linear-chain conditional random field over their words.

Each word has a label, so that text which switches languages is labelled piece
by piece. A label's score for a word is a sum of learned weights of its hashed
byte n-grams (2 to 4), its prefix and suffix of three bytes, and, for frequent
words, of the word itself (the lexicon); neighbouring labels add learned
transition weights. Training maximises the likelihood of sequences spliced from
runs of words in different languages and of unmixed ones, by forward-backward
and AdaGrad, on a bounded sample of labelled documents. A document's score for a
language is the mean of its words' marginal probabilities, by forward-backward
over the whole text.

Prediction is a map over batches without a shuffle; words of many documents are
scored at once and documents of similar length step through the chain together.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from foldkeep.session import lean

from foldkeep.llm.windows import borders, word_hashes

UNKNOWN = "und"
#: Bits of the tables of n-grams and affixes, and most words of the lexicon.
GRAM_BITS, AFFIX_BITS, LEXICON = 16, 14, 4096
GRAMS = (2, 3, 4)
#: Most characters of a document that is sampled to fit.
FIT_CHARS = 200_000
#: Words of documents that step through the chain together.
CHAIN_WORDS = 200_000
#: Bytes whose n-grams are looked up at once.
LOOK_BYTES = 1 << 19

_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def gram_codes(data: np.ndarray, n: int, bits: int = GRAM_BITS, salt: int = 0) -> np.ndarray:
    """The hashed code of the byte n-gram at each position."""
    if len(data) < n:
        return np.empty(0, np.int64)
    x = data[: len(data) - n + 1].astype(np.uint64)
    for k in range(1, n):
        x |= data[k : len(data) - n + 1 + k].astype(np.uint64) << np.uint64(8 * k)
    return ((x + np.uint64(salt << 40)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - bits)).astype(np.int64)


@dataclass
class Words:
    """Words of a text in bytes, with their feature codes."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    lexicon: np.ndarray  # sorted hashes
    known: np.ndarray = field(init=False)  # place in the lexicon, or -1

    def __post_init__(self):
        h = word_hashes(self.data, self.starts, self.ends) if len(self.starts) else np.empty(0, np.uint64)
        at = np.searchsorted(self.lexicon, h)
        at[at == len(self.lexicon)] = 0
        self.known = np.where(len(self.lexicon) and self.lexicon[at] == h, at, -1) if len(self.lexicon) else np.full(len(h), -1)

    def grams(self) -> Iterator[tuple[str, np.ndarray, np.ndarray, np.ndarray]]:
        """Table, codes by position, and each word's range of positions."""
        for n in GRAMS:
            yield f"gram{n}", gram_codes(self.data, n), self.starts, np.maximum(self.starts, self.ends - n + 1)

    def affixes(self) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
        """Table, words, and their codes."""
        w = np.flatnonzero(self.ends - self.starts >= 3)
        if len(w):
            for name, at, salt in (("prefix", self.starts[w], 1), ("suffix", self.ends[w] - 3, 2)):
                yield name, w, gram_codes(self.data, 3, AFFIX_BITS, salt)[at]
        w = np.flatnonzero(self.known >= 0)
        if len(w):
            yield "word", w, self.known[w]


def sizes(lexicon: int) -> dict[str, int]:
    return {f"gram{n}": 1 << GRAM_BITS for n in GRAMS} | {"prefix": 1 << AFFIX_BITS, "suffix": 1 << AFFIX_BITS, "word": max(1, lexicon)}


@dataclass
class Model:
    """Learned weights: labels, tables (labels x codes), start and transition weights."""

    labels: list[str]
    lexicon: np.ndarray
    tables: dict[str, np.ndarray]
    start: np.ndarray
    move: np.ndarray

    def emissions(self, w: Words) -> np.ndarray:
        """words x labels"""
        out = np.zeros((len(w.starts), len(self.labels)))
        for name, codes, lo, hi in w.grams():
            if not len(codes):
                continue
            for k, row in enumerate(self.tables[name]):
                c = np.zeros(len(codes) + 1)
                np.cumsum(row[codes], out=c[1:])
                out[:, k] += c[np.minimum(hi, len(codes))] - c[np.minimum(lo, len(codes))]
        for name, at, codes in w.affixes():
            out[at] += self.tables[name][:, codes].T
        return out

    def document_means(self, e: np.ndarray, count: np.ndarray, weight: np.ndarray, said: np.ndarray | None = None) -> np.ndarray:
        """documents x (labels + 1): weighted means of the words' marginals, and of each word's largest one.

        ``e`` holds the words of documents one after the other; ``said`` is
        filled with the label of each word, if it is given.
        """
        out = np.zeros((len(count), e.shape[1] + 1))
        order = np.argsort(-count, kind="stable")
        order = order[count[order] > 0]
        begin = np.cumsum(count) - count
        a = 0
        while a < len(order):
            z = a + max(1, int(np.searchsorted(np.cumsum(count[order[a:]]), CHAIN_WORDS, "right")))
            out[order[a:z]] = self._chains(e, begin[order[a:z]], count[order[a:z]], weight, said)
            a = z
        return out

    def _chains(self, e: np.ndarray, begin: np.ndarray, count: np.ndarray, weight: np.ndarray, said: np.ndarray | None) -> np.ndarray:
        """Forward-backward over documents sorted by falling length, one step of all of them at a time."""
        steps = int(count[0])
        alive = np.searchsorted(-count, -np.arange(steps), "left")  # documents with more than t words
        move, labels = np.exp(self.move - self.move.max()), e.shape[1]
        at = [begin[:k] + t for t, k in enumerate(alive)]
        forward = np.empty((int(count.sum()), labels))
        edge = np.concatenate([[0], np.cumsum(alive)])
        a = np.exp(self.start - self.start.max())[None, :].repeat(len(count), 0)
        for t, k in enumerate(alive):
            x = e[at[t]]
            a = (a[:k] @ move if t else a) * np.exp(x - x.max(1, keepdims=True))
            a /= a.sum(1, keepdims=True)
            forward[edge[t] : edge[t + 1]] = a
        total, weights = np.zeros((len(count), labels + 1)), np.zeros(len(count))
        b = np.ones((len(count), labels))
        for t in range(steps - 1, -1, -1):
            k = alive[t]
            p = forward[edge[t] : edge[t + 1]] * b[:k]
            p /= p.sum(1, keepdims=True)
            w = weight[at[t]]
            total[:k, :labels] += p * w[:, None]
            total[:k, labels] += p.max(1) * w
            if said is not None:
                said[at[t]] = p.argmax(1)
            weights[:k] += w
            x = e[at[t]]
            b[:k] = (b[:k] * np.exp(x - x.max(1, keepdims=True))) @ move.T
            b[:k] /= b[:k].sum(1, keepdims=True)
        return total / np.maximum(weights, 1e-12)[:, None]

    def _read(self, texts: list[str | None], said: bool = False) -> tuple[list[bool], np.ndarray, np.ndarray | None, np.ndarray]:
        """Whether texts hold a letter, their means, the label of each word if asked for, and the number of words of each."""
        has = [any(map(str.isalpha, t or "")) for t in texts]
        raw = [t.lower().encode() if ok else b"" for t, ok in zip(texts, has, strict=True)]
        parts, counts, weights, a = [], [], [], 0
        while a < len(raw):
            z, size = a, 0
            while z < len(raw) and (z == a or size + len(raw[z]) <= LOOK_BYTES):
                size += len(raw[z]) + 1
                z += 1
            data = np.frombuffer(b"\n".join(raw[a:z]), np.uint8)
            w = Words(data, *borders(data), self.lexicon)
            letters = np.concatenate([[0], np.cumsum(_LETTER[data], dtype=np.int32)])
            parts.append(self.emissions(w))
            weights.append((letters[w.ends] > letters[w.starts]).astype(float))
            bound = np.cumsum([len(x) + 1 for x in raw[a:z]])
            counts.append(np.diff(np.searchsorted(w.starts, bound), prepend=0))
            a = z
        if not parts:
            return has, np.zeros((0, len(self.labels) + 1)), np.empty(0, np.int64), np.empty(0, np.int64)
        e, count = np.concatenate(parts), np.concatenate(counts)
        label = np.full(len(e), -1, np.int64) if said else None
        return has, self.document_means(e, count, np.concatenate(weights), label), label, count

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float], list[float]]:
        """Label and score of each text, and the certainty of its words; ``und``, 0 and 0 for texts that are null or hold no letter."""
        has, mean, _, _ = self._read(texts)
        best = mean[:, :-1].argmax(1)
        some = lambda x, ok: float(min(1.0, x)) if ok else 0.0
        return (
            [self.labels[b] if ok else UNKNOWN for b, ok in zip(best, has, strict=True)],
            [some(m[b], ok) for m, b, ok in zip(mean, best, has, strict=True)],
            [some(m[-1], ok) for m, ok in zip(mean, has, strict=True)],
        )

    def runs(self, texts: list[str | None]) -> list[list[tuple[int, int, str]]]:
        """Of each text the runs of words of one language: first word, word after the last one, label."""
        _, _, label, count = self._read(texts, True)
        out, a = [], 0
        for n in count.tolist():
            own = label[a : a + n]
            cut = np.r_[0, np.flatnonzero(np.diff(own)) + 1, n] if n else np.zeros(1, int)
            out.append([(int(x), int(y), self.labels[own[x]]) for x, y in zip(cut[:-1], cut[1:], strict=True)])
            a += n
        return out


def train(texts: list[str], labels: list[str], rounds: int = 4, length: int = 64, batch: int = 256, rate: float = 0.25, seed: int = 3) -> Model:
    """Fit a model to labelled texts."""
    rng = np.random.default_rng(seed)
    names = sorted(set(labels))
    raw = [t.lower().encode() for t in texts]
    seen = Counter(x for t in raw for x in t.split())
    common = b" ".join(x for x, n in sorted(seen.items(), key=lambda i: (-i[1], i[0]))[:LEXICON] if n > 1)
    c = np.frombuffer(common, np.uint8)
    lexicon = np.unique(word_hashes(c, *borders(c))) if len(c) else np.empty(0, np.uint64)
    size = sizes(len(lexicon))
    m = Model(names, lexicon, {n: np.zeros((len(names), s), np.float32) for n, s in size.items()}, np.zeros(len(names)), np.zeros((len(names), len(names))))
    if len(names) < 2:
        return m
    data = np.frombuffer(b"\n".join(raw), np.uint8)
    w = Words(data, *borders(data), lexicon)
    bound = np.cumsum([len(x) + 1 for x in raw])
    doc = np.searchsorted(bound, w.starts, "right")
    y = np.array([names.index(s) for s in labels])[doc]

    # sequences: runs of words, of one document in every other sequence and of several in the others
    runs, a = [], 0
    edges = np.flatnonzero(np.diff(doc, append=-1)) + 1
    for z in edges:
        while a < z:
            n = min(int(rng.integers(4, 25)), int(z - a))
            runs.append(np.arange(a, a + n))
            a += n
    mixed = np.concatenate([runs[i] for i in rng.permutation(len(runs))])
    order = np.concatenate([mixed, np.arange(len(y))])
    order = order[: max(1, len(order) // length) * length]
    if len(order) < length:
        length = len(order)
    seqs = order.reshape(-1, length)

    grams = [(n, codes, lo, hi) for n, codes, lo, hi in w.grams()]
    affix = [(n, np.full(len(y), -1), at, codes) for n, at, codes in w.affixes()]
    for _, full, at, codes in affix:
        full[at] = codes
    squares = {n: np.full_like(t, 1e-2) for n, t in m.tables.items()}
    start_sq, move_sq = np.full_like(m.start, 1e-2), np.full_like(m.move, 1e-2)
    eye = np.eye(len(names))

    def step(words: np.ndarray) -> None:
        b, t = words.shape
        uniq, back = np.unique(words, return_inverse=True)
        back = back.reshape(b, t)
        e = np.zeros((len(uniq), len(names)))
        used = []
        for name, codes, lo, hi in grams:
            n = np.maximum(hi[uniq] - lo[uniq], 0)
            own = np.repeat(np.arange(len(uniq)), n)
            at = np.repeat(lo[uniq], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            used.append((name, own, codes[at]))
        for name, full, _, _ in affix:
            own = np.flatnonzero(full[uniq] >= 0)
            used.append((name, own, full[uniq][own]))
        for name, own, codes in used:
            for k in range(len(names)):
                e[:, k] += np.bincount(own, m.tables[name][k][codes], len(uniq))
        x = e[back]
        x = np.exp(x - x.max(2, keepdims=True))
        move = np.exp(m.move)
        f, g = np.empty_like(x), np.empty_like(x)
        f[:, 0] = x[:, 0] * np.exp(m.start)
        f[:, 0] /= f[:, 0].sum(1, keepdims=True)
        for i in range(1, t):
            f[:, i] = (f[:, i - 1] @ move) * x[:, i]
            f[:, i] /= f[:, i].sum(1, keepdims=True)
        g[:, -1] = 1
        pair = np.zeros_like(m.move)
        for i in range(t - 2, -1, -1):
            after = x[:, i + 1] * g[:, i + 1]
            p = f[:, i, :, None] * move[None] * after[:, None, :]
            pair += (p / p.sum((1, 2), keepdims=True)).sum(0)
            g[:, i] = after @ move.T
            g[:, i] /= g[:, i].sum(1, keepdims=True)
        p = f * g
        p /= p.sum(2, keepdims=True)
        truth = eye[y[words]]
        up = np.zeros_like(e)
        np.add.at(up, back.ravel(), (truth - p).reshape(-1, len(names)))
        for name, own, codes in used:
            for k in range(len(names)):
                d = np.bincount(codes, up[own, k], m.tables[name].shape[1]) / b
                squares[name][k] += (d**2).astype(np.float32)
                m.tables[name][k] += (rate * d / np.sqrt(squares[name][k])).astype(np.float32)
        moved = np.einsum("btj,btk->jk", truth[:, :-1], truth[:, 1:]) - pair
        for own, sq, d in ((m.start, start_sq, (truth[:, 0] - p[:, 0]).sum(0) / b), (m.move, move_sq, moved / b)):
            sq += d**2
            own += rate * d / np.sqrt(sq)

    for _ in range(rounds):
        shuffled = rng.permutation(len(seqs))
        for a in range(0, len(seqs), batch):
            step(seqs[shuffled[a : a + batch]])
    return m


def fold(doc_id: str | Column, parts: int) -> Column:
    """``crc32`` of the identifier as text, modulo ``parts``."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(c.cast("string").cast("binary")) % parts


def sample(docs: DataFrame, per_lang: int, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", most_chars: int = FIT_CHARS) -> DataFrame:
    """``text, lang`` of at most ``per_lang`` different labelled documents a language, the same ones in every run.

    Chosen by hash on identifiers and hashes of texts alone, among those of
    ``most_chars`` characters at most; their texts are then found by a broadcast
    of at most ``per_lang`` keys a language. Rows that repeat identifier, text
    and language are one, so what is gathered is bounded in rows and bytes.
    """
    keyed = docs.where(F.col(lang).isNotNull() & F.length(text).between(1, most_chars)).select(F.col(doc_id).alias("i"), F.col(lang).alias("l"), F.xxhash64(text).alias("x"), F.col(text).alias("t"))
    slim = keyed.select("i", "l", "x", F.xxhash64("i", F.lit(11)).alias("h"))
    order = Window.partitionBy("l").orderBy("h", "i", "x")
    few = slim.withColumn("n", F.row_number().over(order)).where(F.col("n") <= per_lang).select("i", "l", "x").distinct().toDF("_i", "_l", "_x")
    mine = keyed.join(F.broadcast(few), F.col("i").eqNullSafe(F.col("_i")) & (F.col("l") == F.col("_l")) & (F.col("x") == F.col("_x")), "left_semi")
    return mine.dropDuplicates(["i", "l", "x"]).select("t", "l")


def fit(docs: DataFrame, per_lang: int = 250, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", most_langs: int = 1000) -> Model:
    """A model from a bounded sample of ``docs``, ``per_lang`` documents of each language that their ``lang`` names (null: not used).

    The model has about 1 MB a language and is handed to every task; more than
    ``most_langs`` languages are an error.
    """
    got = sample(docs, per_lang, doc_id, text, lang).limit(per_lang * most_langs + 1).toArrow()
    pairs = sorted(zip(got.column(1).to_pylist(), got.column(0).to_pylist(), strict=True))
    if len({s for s, _ in pairs}) > most_langs:
        raise ValueError(f"more than {most_langs} languages")
    return train([t for _, t in pairs], [s for s, _ in pairs])


def identify(docs: DataFrame, model: Model, text: str = "text", lang_pred: str = "lang_pred", score: str = "score", certainty: str | None = None) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` added (clashing columns are replaced), by whole texts; no shuffle.

    ``score`` is the mean probability of the predicted language over the words
    that hold a letter, and ``certainty``, if a column is named, that of each
    word's own most probable language, which is high for text that mixes
    languages clearly. ``und`` with score 0 for texts that are null or hold no
    letter, and for all texts if the model has no labels. Of languages with
    equal means the first by name is predicted; equal texts have equal results.
    Very long texts step through the chain whole.
    """
    new = [lang_pred, score, *([certainty] if certainty else [])]
    others = [c for c in docs.columns if c not in new]
    if not model.labels:
        return docs.select(*[f"`{c}`" for c in others], F.lit(UNKNOWN).alias(lang_pred), *[F.lit(0.0).alias(c) for c in new[1:]])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, 1000):
                b = whole.slice(a, 1000)
                found = shared.value.predict(b.column(b.schema.get_field_index(text)).to_pylist())
                kinds = (pa.string(), pa.float64(), pa.float64())
                yield pa.RecordBatch.from_pydict({c: b.column(b.schema.get_field_index(c)) for c in others} | {c: pa.array(x, k) for c, x, k in zip(new, found, kinds)})  # noqa: B905

    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.schema if f.name in others)
    return docs.select(*[f"`{c}`" for c in others]).mapInArrow(lean(run), f"{fields}`{lang_pred}` string" + "".join(f", `{c}` double" for c in new[1:]))


def label_words(docs: DataFrame, model: Model, text: str = "text", runs: str = "runs") -> DataFrame:
    """``docs`` without ``text`` and with ``runs``, the runs of words of one language: ``array<struct<start:int,stop:int,lang:string>>``.

    Words are counted from 0, and ``stop`` is not part of a run. Texts without
    letters, and all texts where the model has no labels, have no runs.
    """
    others = [c for c in docs.columns if c not in (text, runs)]
    kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("lang", pa.string())]))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, 1000):
                b = whole.slice(a, 1000)
                texts = b.column(b.schema.get_field_index(text)).to_pylist()
                found = shared.value.runs(texts) if shared.value.labels else [[] for _ in texts]
                said = pa.array([[{"start": x, "stop": y, "lang": s} for x, y, s in r] for r in found], kind)
                yield pa.RecordBatch.from_pydict({c: b.column(b.schema.get_field_index(c)) for c in others} | {runs: said})

    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.schema if f.name in others)
    return docs.select(*[f"`{c}`" for c in others], f"`{text}`").mapInArrow(lean(run), f"{fields}`{runs}` array<struct<start:int,stop:int,lang:string>>")
