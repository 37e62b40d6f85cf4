"""Removal of repeated word windows across a corpus (substring dedup).

A window is ``width`` consecutive words of one document. Each word that a
window covers goes if the same word sequence also starts earlier, in a smaller
document or before it in the same one; windows are judged on the input.

Every window gets a Rabin-Karp hash, and Spark counts by hash how many of a
window's equals start earlier: those with any go. Windows are dealt out by an
anchor in them, the smallest of their inner ``ANCHOR``-word Rabin-Karp hashes:
equal windows have equal anchors at equal places, and as neighbouring windows
mostly share one, a row carries a whole run of windows (the anchor, and 32 bits
of each window's own hash; windows are equal if all 96 bits and the place
agree). After the one exchange, runs whose anchor is alone are done; the others
are unfolded and counted by hash. Before it, each task drops the windows that it
has seen earlier itself, whose removal is then certain; so a passage that very
many documents share is sent once a task and not once a document. A line that
stands between ever different words is an anchor of many different windows:
anchors that hold more than ``HOT`` of the runs of a sample are known before, and
their windows are dealt out one by one, by their own hashes. Removed windows
merge into maximal intervals by document, which are joined back to the texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldkeep.llm.windows import borders, hashed, mix, window_hashes
from foldkeep.session import free_name, lean, materialize

WIDTH = 20
#: Words of the hashes among which anchors are chosen.
ANCHOR = 10
#: Share of all runs above which an anchor's windows are dealt out singly, and the documents of which one is sampled to find these.
HOT, SAMPLED = 2e-5, 32
#: Words that a task gathers before it sends their windows on.
GATHER = 600_000


def sliding_argmin(x: np.ndarray, n: int) -> np.ndarray:
    """For each window of ``n`` values the index of its smallest (the leftmost of equals)."""
    best, at, span = x.copy(), np.arange(len(x)), 1
    while span < n:
        step = min(span, n - span)
        other, where = best[step:], at[step:]
        keep = best[: len(other)] <= other
        best, at = np.where(keep, best[: len(other)], other), np.where(keep, at[: len(other)], where)
        span += step
    return at[: len(x) - n + 1]


def anchored(words: np.ndarray, width: int, anchor: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each window the anchor, and its place in the window."""
    inner = window_hashes(words, anchor)
    at = sliding_argmin(inner, width - anchor + 1)
    return inner[at], (at - np.arange(len(at))).astype(np.int32)


def _gathered(docs: list[tuple], width: int, anchor: int, kind: pa.DataType, hot: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The rows that one task's gathered documents send: runs of windows, and certain removals (those with a ``stop``)."""
    docs.sort(key=lambda d: (d[0] is None, d[0] if d[0] is not None else 0, d[1]))
    doc, start, win, anc, place = [], [], [], [], []
    for i, (_, _, text) in enumerate(docs):
        words = hashed(text)
        w = window_hashes(words, width)
        if len(w):
            doc.append(np.full(len(w), i, np.int32))
            start.append(np.arange(len(w), dtype=np.int32))
            win.append(w)
            for x, y in zip((anc, place), anchored(words, width, anchor), strict=True):
                x.append(y)
    if not win:
        return
    doc, start, win, anc, place = map(np.concatenate, (doc, start, win, anc, place))
    # the first of equal windows; rows are in the order of documents and starts, and the sort is stable
    order = np.argsort(win, kind="stable")
    s = win[order]
    new = np.r_[True, s[1:] != s[:-1]]
    head = np.empty(len(win), np.int64)
    head[order] = order[np.maximum.accumulate(np.where(new, np.arange(len(s)), 0))]
    # rows that repeat a document's identifier and text count as one document, so equal starts of these are not earlier
    name = np.cumsum([0] + [a[:2] != b[:2] for a, b in zip(docs[1:], docs[:-1])])  # noqa: B905
    own = np.arange(len(win))
    same = (name[doc] == name[doc[head]]) & (start == start[head])
    ids, ties = pa.array([d[0] for d in docs], kind), pa.array([d[1] for d in docs], pa.int64())
    single = np.zeros(len(win), bool)
    if len(hot):
        at = np.minimum(np.searchsorted(hot, anc), len(hot) - 1)
        single = hot[at] == anc

    def rows(lead, by, salt, places, body, stops):
        cols = [pa.array(by), pa.array(salt), ids.take(pa.array(doc[lead])), ties.take(pa.array(doc[lead])), pa.array(start[lead]), pa.array(places), body, stops]
        yield from pa.Table.from_arrays(cols, names=[c.split()[0] for c in SENT.format("x").split(", ")]).to_batches(max_chunksize=20_000)

    first = np.flatnonzero(head == own)
    if len(first):
        # a run shares its anchor, whose place falls as the start rises
        joint = (np.diff(first) == 1) & (doc[first[1:]] == doc[first[:-1]]) & (anc[first[1:]] == anc[first[:-1]]) & (place[first[1:]] == place[first[:-1]] - 1) & ~single[first[1:]]
        cut = np.flatnonzero(np.r_[True, ~joint])
        lead, low = first[cut], win[first].astype(np.uint32).view(np.int32)
        body = pa.ListArray.from_arrays(pa.array(np.r_[cut, len(first)].astype(np.int32)), pa.array(low))
        yield from rows(lead, anc[lead].view(np.int64), np.where(single[lead], low[cut], 0).astype(np.int32), place[lead], body, pa.nulls(len(lead), pa.int32()))
    gone = np.flatnonzero((head != own) & ~same)
    if len(gone):
        cut = np.flatnonzero(np.r_[True, (np.diff(gone) != 1) | (doc[gone[1:]] != doc[gone[:-1]])])
        lead, last = gone[cut], gone[np.r_[cut[1:], len(gone)] - 1]
        spread = mix(win[lead] + np.arange(len(lead), dtype=np.uint64)).view(np.int64)  # any number: nothing is compared with these
        yield from rows(lead, spread, np.zeros(len(lead), np.int32), np.zeros(len(lead), np.int32), pa.nulls(len(lead), pa.list_(pa.int32())), pa.array((start[last] + width).astype(np.int32)))


SENT = "anchor long, salt int, doc {}, tie long, start int, place int, own array<int>, stop int"


def _send(batches: Iterator[pa.RecordBatch], width: int, anchor: int, gather: int, hot: np.ndarray) -> Iterator[pa.RecordBatch]:
    held, size, kind = [], 0, None
    for b in batches:
        kind = b.schema.field(0).type
        for d, t, x in zip(b.column(0), b.column(1), b.column(2), strict=True):
            text = x.as_buffer().to_pybytes() if x.is_valid else b""
            held.append((d.as_py(), t.as_py(), text))
            size += len(text) // 6 + 1
            if size >= gather:
                yield from _gathered(held, width, anchor, kind, hot)
                held, size = [], 0
    if held:
        yield from _gathered(held, width, anchor, kind, hot)


def hot_anchors(texts: DataFrame, width: int, anchor: int, share: float = HOT, sampled: int = SAMPLED) -> np.ndarray:
    """The anchors of more than ``share`` of the runs of one in ``sampled`` documents, by hash of the text: at most ``1 / share``.

    They only say how windows are dealt out; what is missed or found too much here changes no result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for x in b.column(0):
                words = hashed(x.as_buffer().to_pybytes())
                if len(words) >= width:
                    anc, place = anchored(words, width, anchor)
                    found.append(anc[np.r_[True, (anc[1:] != anc[:-1]) | (place[1:] != place[:-1] - 1)]])
            if found:
                anc, n = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(anc.view(np.int64)), pa.array(n)], names=["anchor", "n"])

    some = texts.where(F.col("text").isNotNull() & (F.pmod(F.xxhash64("text", F.lit(5)), F.lit(sampled)) == 0)).select("text")
    counts = materialize(some.mapInArrow(lean(run), "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n")), "substring-anchors")
    least = max(50, int((counts.agg(F.sum("n")).first()[0] or 0) * share))
    return np.sort(counts.where(F.col("n") > least).select("anchor").toArrow().column(0).to_numpy().astype(np.int64).view(np.uint64))


def tie_of(docs: DataFrame, doc_id: str, text: str) -> Column:
    """What tells rows of one identifier apart: a hash of the text where identifiers repeat (or are null several times), else nothing."""
    several = docs.groupBy(F.col(doc_id).alias("d")).agg(F.count("*").alias("n")).where("n > 1")
    return F.lit(0).cast("long") if several.isEmpty() else F.xxhash64(text)


def repeated_windows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH, anchor: int = ANCHOR, gather: int = GATHER, tie: Column | None = None) -> DataFrame:
    """``doc, tie, starts, stops`` of the documents with removals: word intervals ``[start, stop)`` whose union is what goes (``maximal`` merges them)."""
    if not 0 < anchor <= width:
        raise ValueError("the anchor must lie inside the window")
    of = docs.schema[doc_id].dataType.simpleString()
    keyed = docs.select(F.col(doc_id).alias("doc"), (tie_of(docs, doc_id, text) if tie is None else tie).alias("tie"), F.col(text).cast("binary").alias("text"))
    hot = docs.sparkSession.sparkContext.broadcast(hot_anchors(keyed, width, anchor))
    sent = keyed.mapInArrow(lean(lambda b: _send(b, width, anchor, gather, hot.value)), SENT.format(of))
    dealt = ["anchor", "salt"]
    shared = sent.withColumn("n", F.count("*").over(Window.partitionBy(*dealt))).where("n > 1 or stop is not null")
    each = shared.select(*dealt, "doc", "tie", "start", "place", "stop", F.posexplode_outer("own").alias("step", "low"))
    each = each.select(*dealt, "doc", "tie", (F.col("start") + F.coalesce("step", F.lit(0))).alias("start"), (F.col("place") - F.coalesce("step", F.lit(0))).alias("place"), "low", "stop")
    # a window's number among its equals; rows that are equal in all three are one window
    earlier = Window.partitionBy(*dealt, "place", "low").orderBy(F.col("doc").asc_nulls_last(), "tie", "start")
    gone = each.withColumn("nth", F.rank().over(earlier)).where("nth > 1 or stop is not null")
    sure = F.col("stop").isNotNull()
    found = gone.groupBy("doc", "tie").agg(F.collect_list(F.when(~sure, F.col("start"))).alias("one"), F.collect_list(F.when(sure, F.col("start"))).alias("a"), F.collect_list("stop").alias("z"))
    return found.select("doc", "tie", F.concat("one", "a").alias("starts"), F.concat(F.transform("one", lambda x: x + width), "z").alias("stops"))


def maximal(starts: np.ndarray, stops: np.ndarray, n: int) -> np.ndarray:
    """The borders of the maximal, disjoint intervals that the spans cover among ``n`` words: starts and ends in turn."""
    edge = np.zeros(n + 2, np.int64)
    np.add.at(edge, starts + 1, 1)
    np.add.at(edge, stops + 1, -1)
    return np.flatnonzero(np.diff((np.cumsum(edge) > 0).astype(np.int8)))


def keep_words(text: bytes, a: np.ndarray | None, z: np.ndarray | None) -> tuple[int, int, np.ndarray, np.ndarray]:
    """Number of words, number removed, and the starts and ends of the words that stay once the spans ``[a, z)`` are gone."""
    starts, ends = borders(np.frombuffer(text, np.uint8))
    if a is None:
        return len(starts), 0, starts, ends
    stay = np.ones(len(starts), bool)
    cut = maximal(a, z, len(starts))
    for x, y in zip(cut[::2], cut[1::2], strict=True):
        stay[x:y] = False
    return len(starts), int(len(starts) - stay.sum()), starts[stay], ends[stay]


def joined(text: bytes, starts: np.ndarray, ends: np.ndarray) -> bytes:
    """The words joined by one space."""
    return b" ".join([text[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)])


def dedup_windows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH, kept: str | None = None, anchor: int = ANCHOR, gather: int = GATHER) -> DataFrame:
    """``docs`` without ``text`` but with ``n_words, n_removed, kept_sha256``, and the text left in column ``kept`` if one is named.

    What is left are the kept words joined by one space; a text that loses no
    word is left as it is in ``kept``. Null and empty texts have no words;
    texts of less than ``width`` words lose none; very long ones are read whole.
    Identifiers may be of any type that has an order; a null one sorts last. Of
    rows that repeat identifier and text none counts as earlier than another;
    rows that share only the identifier are ordered by a hash of the text.
    Columns of ``docs`` that clash with a new name are replaced.
    """
    new = {"n_words", "n_removed", "kept_sha256", kept} - {None}
    others = [c for c in docs.columns if c != text and c not in new]
    tie = tie_of(docs, doc_id, text)
    own, at, said, starts, stops, d, t = (free_name(docs, c) for c in ("_own", "_at", "_text", "_starts", "_stops", "_doc", "_tie"))
    spans = repeated_windows(docs, doc_id, text, width, anchor, gather, tie).select(F.col("doc").alias(d), F.col("tie").alias(t), F.col("starts").alias(starts), F.col("stops").alias(stops))
    keyed = docs.select(*[f"`{c}`" for c in others], F.col(doc_id).alias(own), tie.alias(at), F.col(text).alias(said))
    both = keyed.join(spans, F.col(own).eqNullSafe(F.col(d)) & (F.col(at) == F.col(t)), "left").select(*[f"`{c}`" for c in others], said, starts, stops)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col = {f.name: b.column(i) for i, f in enumerate(b.schema)}
            out: dict[str, list] = {"n_words": [], "n_removed": [], "kept_sha256": []}
            left = []
            for x, a, z in zip(col[said], col[starts], col[stops], strict=True):
                body = x.as_buffer().to_pybytes() if x.is_valid else b""
                n, gone, s, e = keep_words(body, a.values.to_numpy() if a.is_valid else None, z.values.to_numpy() if a.is_valid else None)
                rest = joined(body, s, e)
                out["n_words"].append(n)
                out["n_removed"].append(gone)
                out["kept_sha256"].append(hashlib.sha256(rest).hexdigest())
                if kept:
                    left.append(rest.decode() if gone else x.as_py())
            arrays = {c: pa.array(v, pa.string() if c == "kept_sha256" else pa.int64()) for c, v in out.items()}
            yield pa.RecordBatch.from_pydict({c: col[c] for c in others} | arrays | ({kept: pa.array(left, pa.string())} if kept else {}))

    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.schema if f.name in others)
    return both.mapInArrow(lean(run), f"{fields}n_words long, n_removed long, kept_sha256 string" + (f", `{kept}` string" if kept else ""))
