"""Toxicity by the nearest labelled examples: exact TF-IDF cosine over a block-max inverted index, and a vote by distance.

A text's vector has all words of the whole text, hashed to ``BUCKETS`` places,
and besides them, with the share ``CHOSEN`` of its squared length, the chosen
terms: whole words and beginnings of words that a bounded sample of labelled
rows associates with the label. Document frequencies of both are counted over
all documents. Labelled examples of both labels (again a bounded sample) lie in
an inverted index in blocks, each term with its largest weight in each block: a
query bounds what a block can score, looks into blocks from the best bound
down, and skips those that cannot reach its k-th neighbour, so the neighbours
are exact. Every text with a word is looked up. Votes weigh by similarity and by
how many labelled rows of its class an example stands for; for texts with chosen
terms a table fitted on further labelled rows (monotone, by pooling) turns votes
into rates, so scores are calibrated. Other texts have the rate of the label
among labelled rows without chosen terms, unless the vote of close examples is
above it. The nearest examples are kept as evidence.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldkeep.llm.windows import hashed, mix, window_hashes
from foldkeep.session import lean, materialize

#: Most labelled rows of each label for the vocabulary and as examples; most terms; neighbours; examples of a block.
FIT_ROWS, TERMS, NEIGHBOURS, BLOCK = 3000, 256, 15, 32
#: Most examples whose own votes calibrate.
CALIBRATE = 1500
#: Places of hashed words, and the share of chosen terms in the square of a vector's length.
BUCKETS, CHOSEN = 1 << 20, 0.8
#: Texts whose words are counted at once, in characters.
BATCH_CHARS = 2 << 20
#: Lengths of the beginnings of words that are terms too (marked by a final ``*``).
BEGINNINGS = (4, 5, 6)

_WORD = re.compile(r"[^\W\d_]+")
#: Lower-case ASCII letters as they are, and spaces for all other bytes.
_LETTERS = bytes(b if 97 <= b <= 122 else 32 for b in range(256))


def terms_of(text: str) -> set[str]:
    """All terms of a text, each once."""
    words = set(_WORD.findall(text.lower()))
    return words | {w[:n] + "*" for w in words for n in BEGINNINGS if len(w) >= n}


class Matcher:
    """Counts the vocabulary's terms in a text, by an Aho-Corasick automaton."""

    def __init__(self, vocabulary: list[str]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        by: dict[str, list[tuple[int, bool]]] = {}
        for i, t in enumerate(vocabulary):
            by.setdefault(t.rstrip("*"), []).append((i, t.endswith("*")))
        for t, ids in by.items():
            self.automaton.add_word(t, (len(t), ids))
        self.empty = not by
        if by:
            self.automaton.make_automaton()

    def __call__(self, text: str) -> list[tuple[int, int]]:
        """(term, times), by term."""
        if self.empty:
            return []
        text = text.lower()
        n, letter, found = len(text), lambda c: c.isalpha(), Counter()
        for end, (size, ids) in self.automaton.iter(text):
            if end >= size and letter(text[end - size]):
                continue
            inside = end + 1 < n and letter(text[end + 1])
            for i, start_only in ids:
                if start_only or not inside:
                    found[i] += 1
        return sorted(found.items())


def words_of(text: str) -> list:
    """The words of a text in lower case, as bytes where all is ASCII."""
    text = text.lower()
    return text.encode().translate(_LETTERS).split() if text.isascii() else _WORD.findall(text)


def word_counts(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the hashed words of each text (ascending, each once), how often each occurs, and where each text's begin."""
    found = [words_of(t) for t in texts]
    words = pa.array([w for x in found for w in x], pa.binary()).dictionary_encode()
    digest = xxhash.xxh64_intdigest
    place = (np.array([digest(w) for w in words.dictionary.to_pylist()], np.uint64) % np.uint64(BUCKETS)).astype(np.int64)
    row = np.repeat(np.arange(len(texts)), [len(x) for x in found])
    both, n = np.unique(row * BUCKETS + place[words.indices.to_numpy()] if len(row) else np.empty(0, np.int64), return_counts=True)
    return both % BUCKETS, n, np.searchsorted(both, np.arange(len(texts) + 1) * BUCKETS)


def parts(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``BATCH_CHARS``."""
    a = size = 0
    for i, t in enumerate(texts):
        if i > a and size + len(t) > BATCH_CHARS:
            yield a, i
            a, size = i, 0
        size += len(t)
    if a < len(texts):
        yield a, len(texts)


def _ranges(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers from each ``begin`` on, ``size`` of them, one range after the other."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin - ends + size, size)


def side_by_side(vectors: list[tuple[np.ndarray, np.ndarray]], size: int, dims: int = 256) -> np.ndarray:
    """An order of vectors in which similar ones share blocks of ``size``, so that blocks' largest weights are close to their own vectors' weights.

    Vectors are hashed to a few dimensions, and halved again and again along the
    line between two members that lie far apart.
    """
    x = np.zeros((len(vectors), dims), np.float32)
    for i, (t, w) in enumerate(vectors):
        h = mix(t.astype(np.uint64))
        x[i] = np.bincount((h % np.uint64(dims)).astype(np.int64), np.where(h >> np.uint64(63), w, -w), dims)
    todo, out = [np.arange(len(vectors))], []
    while todo:
        own = todo.pop()
        if len(own) <= size:
            out.append(own)
            continue
        p = x[own]
        a = int(((p - p.mean(0)) ** 2).sum(1).argmax())
        b = int(((p - p[a]) ** 2).sum(1).argmax())
        own = own[np.argsort(p @ (p[b] - p[a]), kind="stable")]
        half = -(-len(own) // (2 * size)) * size
        todo += [own[half:], own[:half]]
    return np.concatenate(out) if out else np.empty(0, np.int64)


#: Terms that more than this share of the rows hold have whole lists instead of blocks.
LONG_LIST = 0.03
#: How far sums of single precision may be off.
ROUGH = 1e-4


@dataclass
class BlockMax:
    """An inverted index of unit vectors without negative weights, with each term's largest weight in each block.

    The few terms that many rows hold would be searched in every block: their
    lists are kept whole, as rows of a matrix, and many queries are multiplied
    with it at once. That sum bounds from below what a row scores, and with the
    blocks' largest weights of the other terms from above.
    """

    long: np.ndarray  # terms with whole lists, ascending
    terms: np.ndarray  # the others that occur, ascending
    entries: np.ndarray  # by term: where its entries begin, one a block
    block: np.ndarray  # by entry: block, largest weight, where its rows begin
    top: np.ndarray
    begin: np.ndarray
    row: np.ndarray  # by term and row: row, weight
    weight: np.ndarray
    of: np.ndarray  # the whole lists by row: where each row begins, places in ``long``, and weights
    own: np.ndarray
    size: np.ndarray
    rows: int
    places: int

    @classmethod
    def of_vectors(cls, vectors: list[tuple[np.ndarray, np.ndarray]], places: int) -> BlockMax:
        rows = np.repeat(np.arange(len(vectors)), [len(t) for t, _ in vectors])
        own = np.concatenate([t for t, _ in vectors]).astype(np.int64) if vectors else np.empty(0, np.int64)
        size = np.concatenate([w for _, w in vectors]) if vectors else np.empty(0)
        known, n = np.unique(own, return_counts=True)
        long = known[n > max(BLOCK, LONG_LIST * len(vectors))]
        rare = ~np.isin(own, long)
        order = np.flatnonzero(rare)[np.lexsort((rows[rare], own[rare]))]
        row, term, weight = rows[order], own[order], size[order]
        blocks = -(-len(vectors) // BLOCK) + 1
        entry, begin = np.unique(term * blocks + row // BLOCK, return_index=True)
        terms, entries = np.unique(entry // blocks, return_index=True)
        top = np.maximum.reduceat(weight, begin) if len(begin) else np.empty(0)
        of = np.searchsorted(rows[~rare], np.arange(len(vectors) + 1))
        lists = np.searchsorted(long, own[~rare]).astype(np.int32)
        # numbers that are looked up at random are kept narrow, so that more of them stay in the cache
        narrow = [x.astype(np.int32) for x in (np.append(entries, len(entry)), entry % blocks, np.append(begin, len(row)), row)]
        return cls(long, terms, *narrow[:2], top.astype(np.float32), *narrow[2:], weight, of, lists, size[~rare], len(vectors), places)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if not k.startswith("_")}

    def _prepared(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The whole lists as a matrix (terms x rows, filled up to whole blocks), where each term is in ``long`` or, after these, in ``terms`` (-1: nowhere), and a place for a query's weights."""
        if "_lists" not in self.__dict__:
            n = -(-self.rows // BLOCK) * BLOCK
            self._lists = np.zeros((len(self.long), n), np.float32)
            self._lists[self.own, np.repeat(np.arange(self.rows), np.diff(self.of))] = self.size
            self._at = np.full(self.places, -1, np.int32)
            self._at[np.concatenate([self.long, self.terms])] = np.arange(len(self.long) + len(self.terms))
            self._query = np.zeros(len(self.long))
        return self._lists, self._at, self._query

    def nearest(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query the k rows of largest cosine (above 0), largest first, ties to the smaller row."""
        if not self.rows:
            return [(np.empty(0, np.int64), np.empty(0))] * len(queries)
        lists, where, _ = self._prepared()
        out = []
        for a in range(0, len(queries), 128):
            some = queries[a : a + 128]
            whole = np.zeros((len(some), len(self.long)), np.float32)
            parted = []
            for i, (term, weight) in enumerate(some):
                at = where.take(term)
                held, rest = (at >= 0) & (at < len(self.long)), at >= len(self.long)
                held, rest, by, weight = at[held], at[rest] - len(self.long), weight[held], weight[rest]
                whole[i, held] = by
                parted.append((held, by, rest, weight))
            for query, score in zip(parted, whole @ lists, strict=True):
                out.append(self._search(*query, score, k))
        return out

    def _search(self, held: np.ndarray, share: np.ndarray, at: np.ndarray, by: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The nearest rows of a query, given the scores by whole lists; blocks that cannot reach the k-th are never looked into.

        ``held`` and ``share`` are the query's terms with whole lists and their weights, ``at`` and ``by`` the others.
        """
        first = self.entries.take(at)
        n = self.entries.take(at + 1) - first
        entry, by = _ranges(first, n), np.repeat(by, n)
        block = self.block.take(entry)
        bound = score.reshape(-1, BLOCK).max(1) + np.bincount(block, by * self.top.take(entry), len(score) // BLOCK)
        kth = lambda x: np.partition(x, -k)[-k] if len(x) > k else 0.0
        some = np.flatnonzero((bound >= kth(score) - ROUGH).take(block))
        entry, by = entry.take(some), by.take(some)
        first = self.begin.take(entry)
        n = self.begin.take(entry + 1) - first
        each = _ranges(first, n)
        rare = np.bincount(self.row.take(each), np.repeat(by, n) * self.weight.take(each), len(score))
        score = score + rare
        able = np.flatnonzero((score >= max(kth(score) - 2 * ROUGH, 0)) & (score > 0))
        exact = rare[able] + self._exact(held, share, able)
        able, exact = able[exact > 0], exact[exact > 0]
        best = np.lexsort((able, -np.round(exact, 9)))[:k]
        return able[best], exact[best]

    def _exact(self, held: np.ndarray, share: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """What some rows score by whole lists, in double precision."""
        _, _, query = self._prepared()
        query[held] = share
        start = self.of[rows]
        n = self.of[rows + 1] - start
        each = _ranges(start, n)
        out = np.bincount(np.repeat(np.arange(len(rows)), n), query.take(self.own.take(each)) * self.size.take(each), len(rows))
        query[held] = 0
        return out


@dataclass
class Model:
    """What scoring needs: all parts are bounded by the parameters of ``fit``."""

    vocabulary: list[str]
    idf: np.ndarray
    ids: list
    labels: np.ndarray
    stands_for: np.ndarray
    index: BlockMax
    prior: float  # rate of the label among labelled rows without chosen terms
    rate: float  # and among those with some
    votes: np.ndarray  # calibration: votes ascending, and their rates
    rates: np.ndarray
    k: int
    word_idf: np.ndarray  # by hashed word

    def vector(self, counts: list[tuple[int, int]], place: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Terms and weights of a unit vector, from counts of the chosen terms and of hashed words."""
        t = np.array([i for i, _ in counts], np.int64)
        w = (1 + np.log(np.array([n for _, n in counts], float))) * self.idf[t]
        v = (1 + np.log(n)) * self.word_idf[place]
        share = CHOSEN if len(t) and len(place) else 1.0
        w *= np.sqrt(share) / max(np.sqrt((w**2).sum()), 1e-12)
        v *= np.sqrt(1 - share if len(t) else 1.0) / max(np.sqrt((v**2).sum()), 1e-12)
        return np.concatenate([t, place + len(self.vocabulary)]), np.concatenate([w, v])

    def vote(self, found: tuple[np.ndarray, np.ndarray], chosen: bool, skip: int | None = None) -> tuple[float, list[tuple[int, float]]]:
        """The weighted share of the label among the nearest examples, and these with their similarities.

        Where no chosen term says what matters, only close examples count for much.
        """
        rows, sims = found
        keep = rows != (-1 if skip is None else skip)
        rows, sims = rows[keep][: self.k], np.minimum(sims[keep][: self.k], 1.0)
        w = sims ** (2 if chosen else 6) / (1.05 - sims) * self.stands_for[rows]
        own = 0.2 * self.stands_for.mean() if len(self.ids) else 1.0
        return float(((w * self.labels[rows]).sum() + own * (self.rate if chosen else self.prior)) / (w.sum() + own)), list(zip(rows.tolist(), sims.tolist(), strict=True))

    def scores(self, texts: list[tuple[list[tuple[int, int]], np.ndarray, np.ndarray]]) -> list[tuple[float, list[tuple[int, float]]]]:
        """Score and evidence of texts, given by the counts of chosen terms and of hashed words."""
        some = [i for i, (counts, place, _) in enumerate(texts) if counts or len(place)]
        out: list[tuple[float, list[tuple[int, float]]]] = [(self.prior, [])] * len(texts)
        for i, found in zip(some, self.index.nearest([self.vector(*texts[i]) for i in some], self.k), strict=True):
            chosen = bool(texts[i][0])
            v, near = self.vote(found, chosen)
            if not chosen:
                v = max(v, self.prior)
            elif len(self.votes):
                v = float(np.interp(v, self.votes, self.rates))
            out[i] = (v, near)
        return out


def pooled(votes: np.ndarray, labels: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Monotone rates for votes, by pooling adjacent violators; a little of the vote itself is mixed in, so that no rate is 0 or 1."""
    order = np.argsort(votes, kind="stable")
    pool: list[list[float]] = []
    for v, y, w in zip(votes[order], labels[order], weight[order], strict=True):
        pool.append([w, w * y, w * v])
        while len(pool) > 1 and pool[-2][1] / pool[-2][0] >= pool[-1][1] / pool[-1][0]:
            last = pool.pop()
            pool[-1] = [a + b for a, b in zip(pool[-1], last, strict=True)]
    own = float(weight.mean())
    at = np.array([p[2] / p[0] for p in pool])
    return at, np.array([(p[1] + own * v) / (p[0] + own) for p, v in zip(pool, at, strict=True)])


def near_key(text: bytes) -> int:
    """The smallest hash of a text's five-word windows (of its words, if it has fewer), which near copies mostly share."""
    words = hashed(text)
    h = window_hashes(words, min(5, max(1, len(words))))
    return int(h.min().view(np.int64)) if len(h) else 0


def choose_terms(counts: list[tuple[str, int, int]], pos: int, neg: int, tried: int, most: int = TERMS) -> list[str]:
    """The terms that go with the label most surely, from the numbers of labelled and other rows that hold each.

    A term's evidence is Chernoff's bound on the chance that so many of the rows
    that hold it are labelled if it said nothing; it must outweigh the number of
    terms that were tried, so that fewer than one false term is expected.
    """
    share = pos / max(1, pos + neg)
    good = []
    for t, a, b in counts:
        p = a / (a + b)
        if not 0 < share < 1 or p <= share:
            continue
        kl = p * np.log(p / share) + ((1 - p) * np.log((1 - p) / (1 - share)) if p < 1 else 0)
        if (a + b) * kl >= np.log(max(1, tried)) + 1:
            good.append((-(a + b) * kl, t))
    return [t for _, t in sorted(good)[:most]]


def term_counts(docs: DataFrame, vocabulary: list[str]) -> DataFrame:
    """``doc_id, terms, place, n`` of ``doc_id, text``: the vocabulary's terms in each text, and its hashed words (as 32-bit numbers) with their counts; no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    kind = pa.list_(pa.struct([("term", pa.int32()), ("n", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match = Matcher(shared.value)
        for b in batches:
            texts = [x or "" for x in b.column(1).to_pylist()]
            for lo, hi in parts(texts):
                found = [[{"term": t, "n": n} for t, n in match(x)] for x in texts[lo:hi]]
                place, n, begin = word_counts(texts[lo:hi])
                ends = pa.py_buffer((begin * 4).astype(np.int32))
                packed = [pa.Array.from_buffers(pa.binary(), hi - lo, [None, ends, pa.py_buffer(x.astype("<i4").tobytes())]) for x in (place, n)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(found, kind), *packed], names=["doc_id", "terms", "place", "n"])

    of = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(lean(run), f"doc_id {of}, terms array<struct<term:int,n:int>>, place binary, n binary")


def fit_and_score(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", fit_rows: int = FIT_ROWS, most_terms: int = TERMS, k: int = NEIGHBOURS) -> DataFrame:
    """Per row of ``docs``: ``doc_id, score, evidence``, the score of the label 1 from 0 to 1.

    ``labels`` holds the rows to learn from, by ``doc_id``; of identifiers that
    it repeats the largest label counts, null labels and identifiers do not.
    At most ``fit_rows`` rows of each label are sampled (by hash, so reruns
    agree); they are the examples, and choose the terms, near copies counted
    once; of rows that share an identifier the smallest text is the example.
    Null and empty texts have no words and so get the rate of texts without
    chosen terms; very long ones are read whole. Without any labelled row all
    scores are 0.5 and without evidence. Rows of equal text have equal scores.
    ``evidence`` holds the nearest examples' identifiers (of any type that has an
    order) and similarities, equal ones in a fixed order.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    of = docs.schema["doc_id"].dataType.simpleString()
    kind = f"array<struct<doc_id:{of},similarity:double>>"
    known = labels.where(F.col(doc_id).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(doc_id).alias("_id")).agg(F.max(F.col(label).cast("int")).alias("_y"))
    known = materialize(known.select("_id", (F.col("_y") > 0).cast("int").alias("_y"), F.xxhash64("_id", F.lit(23)).alias("_h")), "toxic-labels")
    totals = {r._y: r.n for r in known.groupBy("_y").agg(F.count("*").alias("n")).collect()}
    if not totals:
        return docs.select("doc_id", F.lit(0.5).alias("score"), F.lit(None).cast(kind).alias("evidence"))
    chosen = known.where("_y = 1").orderBy("_h", "_id").limit(fit_rows).unionByName(known.where("_y = 0").orderBy("_h", "_id").limit(fit_rows))
    chosen = materialize(chosen, "toxic-sample")  # at most 2 * fit_rows rows
    mine_of = lambda df, *cols: df.join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).groupBy("doc_id").agg(F.first("_y").alias("_y"), F.min(F.struct(*cols)).alias("own")).select("doc_id", "_y", "own.*")
    sampled = mine_of(docs, "text").select("_y", "text")

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            near = pa.array([near_key((x.as_py() or "").encode()) for x in b.column(1)], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), near], names=["_y", "text", "near"])

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n: dict[str, list[int]] = {}
            for y, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for t in terms_of(x or ""):
                    n.setdefault(t, [0, 0])[y] += 1
            yield pa.RecordBatch.from_arrays([pa.array(list(n)), pa.array([v[1] for v in n.values()], pa.int64()), pa.array([v[0] for v in n.values()], pa.int64())], names=["term", "pos", "neg"])

    def chosen_terms(texts: DataFrame) -> list[str]:
        counted = texts.mapInArrow(lean(spread), "term string, pos long, neg long").groupBy("term").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
        counted = materialize(counted.where("pos + neg >= 3"), "toxic-term-counts")
        kept = {r._y: r.n for r in texts.groupBy("_y").agg(F.count("*").alias("n")).collect()}
        pos, neg = kept.get(1, 0), kept.get(0, 0)
        # only what can be chosen at all comes to the driver, the most frequent first
        likely = counted.where((F.col("pos") >= 3) & (F.col("pos") * max(1, neg) >= 3 * F.col("neg") * max(1, pos))).orderBy(F.desc("pos"), "term").limit(40 * most_terms)
        return choose_terms([(r.term, r.pos, r.neg) for r in likely.collect()], pos, neg, counted.count(), most_terms)

    # near copies are one piece of evidence, however many there are; only where that leaves nothing, each counts
    sampled = materialize(sampled.mapInArrow(lean(marked), "_y int, text string, near long"), "toxic-texts")
    vocabulary = chosen_terms(sampled.dropDuplicates(["near"]).select("_y", "text")) or chosen_terms(sampled.select("_y", "text"))

    slim = materialize(term_counts(docs, vocabulary), "toxic-terms")
    seen = {r.term: r.n for r in slim.select(F.explode("terms.term").alias("term")).groupBy("term").agg(F.count("*").alias("n")).collect()}
    rows = slim.count()
    idf = np.array([np.log((rows + 1) / (seen.get(i, 0) + 1)) + 1 for i in range(len(vocabulary))])
    # the label's rate among all labelled rows without and with terms
    found = slim.select("doc_id", (F.size("terms") > 0).alias("has")).dropDuplicates(["doc_id"]).join(known, F.col("doc_id") == F.col("_id")).groupBy("has", "_y").agg(F.count("*").alias("n"))
    n = {(r.has, r._y): r.n for r in found.collect()}
    overall = (totals.get(1, 0) + 1) / (sum(totals.values()) + 2)
    rate = lambda has: (n.get((has, 1), 0) + overall) / (n.get((has, 1), 0) + n.get((has, 0), 0) + 1)

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for b in batches:
            for a in range(0, b.num_rows, 1000):  # a word is listed once a text
                total += np.bincount(np.frombuffer(b"".join(b.column(0).slice(a, 1000).to_pylist()), "<i4"), minlength=BUCKETS)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(total[held])], names=["place", "n"])

    # at most BUCKETS rows
    often = slim.select("place").mapInArrow(lean(frequencies), "place int, n long").groupBy("place").agg(F.sum("n").alias("n")).toArrow()
    word_idf = np.full(BUCKETS, np.log(rows + 1) + 1, np.float32)
    word_idf[often.column("place").to_numpy()] = np.log((rows + 1) / (often.column("n").to_numpy() + 1)) + 1

    examples = mine_of(slim, "place", "n", "terms").where("length(place) > 0").toArrow()
    whole = lambda x: np.frombuffer(x, "<i4").astype(np.int64)
    mine = sorted(zip(*[examples.column(c).to_pylist() for c in ("doc_id", "_y", "place", "n", "terms")], strict=True), key=lambda r: r[0])
    each = {y: totals.get(y, 0) / max(1, min(fit_rows, totals.get(y, 0))) for y in (0, 1)}
    bare = Model(vocabulary, idf, [], np.empty(0), np.empty(0), None, rate(False), rate(True), np.empty(0), np.empty(0), k, word_idf)
    terms_in = lambda r: [(x["term"], x["n"]) for x in r[4]]
    vectors = [bare.vector(terms_in(r), whole(r[2]), whole(r[3])) for r in mine]
    order = side_by_side(vectors, BLOCK)
    mine, vectors = [mine[i] for i in order], [vectors[i] for i in order]
    y, stands = np.array([r[1] for r in mine], float), np.array([each[r[1]] for r in mine])
    m = Model(vocabulary, idf, [r[0] for r in mine], y, stands, BlockMax.of_vectors(vectors, len(vocabulary) + BUCKETS), rate(False), rate(True), np.empty(0), np.empty(0), k, word_idf)
    some = np.flatnonzero([len(r[4]) > 0 for r in mine])
    test = np.random.default_rng(1).permutation(some)[:CALIBRATE]
    if len(test) >= 50:
        near = m.index.nearest([vectors[i] for i in test], k + 1)
        m.votes, m.rates = pooled(np.array([m.vote(x, True, i)[0] for x, i in zip(near, test, strict=True)]), y[test], stands[test])
    shared = spark.sparkContext.broadcast(m)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for whole_batch in batches:
            for a in range(0, whole_batch.num_rows, 1000):
                b = whole_batch.slice(a, 1000)
                texts = [([(x["term"], x["n"]) for x in c], whole(p), whole(n)) for c, p, n in zip(*(b.column(i).to_pylist() for i in (1, 2, 3)), strict=True)]
                said = m.scores(texts)
                scores = [min(1.0, max(0.0, v)) for v, _ in said]
                evidence = [[{"doc_id": m.ids[j], "similarity": v} for j, v in near[:3]] for _, near in said]
                found = pa.array(evidence, pa.list_(pa.struct([("doc_id", b.schema.field(0).type), ("similarity", pa.float64())])))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores, pa.float64()), found], names=["doc_id", "score", "evidence"])

    return slim.mapInArrow(lean(run), f"doc_id {of}, score double, evidence {kind}")
