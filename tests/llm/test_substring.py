import hashlib
import random
import re

import numpy as np
import pytest

from foldkeep.llm import substring
from foldkeep.llm.substring import dedup_windows, hot_anchors, maximal, sliding_argmin
from foldkeep.llm.windows import hashed, window_hashes


def brute(rows, width):
    """By the definition, on all windows."""
    docs = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    first = {}
    for i, w in sorted(docs, key=lambda d: (d[0] is None, d[0])):
        for s in range(len(w) - width + 1):
            first.setdefault(tuple(w[s : s + width]), (i, s))
    out = {}
    for i, w in docs:
        gone = set()
        for s in range(len(w) - width + 1):
            if first[tuple(w[s : s + width])] != (i, s):
                gone |= set(range(s, s + width))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out[i] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept)
    return out


def made(seed, n, vocabulary=40, passages=6):
    r = random.Random(seed)
    shared = [[r.choice("abcdefghij") + str(r.randrange(vocabulary)) for _ in range(r.randrange(3, 60))] for _ in range(passages)]
    rows = []
    for i in range(n):
        w = []
        for _ in range(r.randrange(0, 6)):
            w += r.choice(shared) if r.random() < 0.5 else [str(r.randrange(vocabulary)) for _ in range(r.randrange(0, 30))]
        rows.append((i, r.choice([" ", "  ", "\n", "\t "]).join(w)))
    return rows


@pytest.mark.parametrize("width,anchor,gather", [(20, 10, 1_000_000), (20, 10, 50), (5, 2, 30), (3, 3, 1), (1, 1, 10)])
def test_equals_brute_force(spark, width, anchor, gather):
    rows = made(width, 120)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = brute(rows, width)
    got = dedup_windows(df, width=width, anchor=anchor, gather=gather, kept="left").collect()
    assert len(got) == len(rows)
    for r in got:
        n, gone, sha, kept = want[r.doc_id]
        assert (r.n_words, r.n_removed, r.kept_sha256) == (n, gone, sha)
        assert not gone or r.left == kept
    assert sum(w[1] for w in want.values()) > 0


def test_documents_equal_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    want = brute([(r.doc_id, r.text) for r in docs.collect()], 20)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in dedup_windows(docs).collect()}
    assert got == {i: w[:3] for i, w in want.items()} and any(w[1] for w in got.values())


def test_nulls_repeats_long_texts_and_clashes(spark):
    body = " ".join(f"w{i}" for i in range(40))
    rows = [(1, body, 5), (1, body, 5), (2, None, 5), (3, "", 5), (4, " \n ", 5), (None, body, 5), (5, "x " * 30_000, 5), (6, "é x " + body, 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_words int")
    got = {}
    for r in dedup_windows(df).collect():
        got.setdefault(r.doc_id, []).append((r.n_words, r.n_removed))
    assert got[1] == [(40, 0)] * 2  # copies of one document are no earlier documents
    assert got[2] == got[3] == got[4] == [(0, 0)]
    assert got[None] == [(40, 40)]
    assert got[5] == [(30_000, 29_999)]
    assert got[6] == [(41, 40)]
    assert dedup_windows(df.where("false")).isEmpty()


def test_repeated_and_textual_identifiers(spark):
    body = " ".join(f"w{i}" for i in range(40))
    rows = [("b", body), ("a", "x " + body), (None, body), ("c", "y " * 30 + body), ("c", body + " z")]
    got = {}
    for r in dedup_windows(spark.createDataFrame(rows, "doc_id string, text string")).collect():
        got.setdefault(r.doc_id, []).append((r.n_words, r.n_removed))
    assert got["a"] == [(41, 0)] and got["b"] == got[None] == [(40, 40)] and sorted(got["c"]) == [(41, 40), (70, 69)]
    # rows that share an identifier are ordered by a hash of the text: one of the two keeps the passage
    rows = [(7, body + " p"), (7, "q " + body), (None, "r " + body)]
    got = dedup_windows(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r.n_removed for r in got) == [0, 40, 40]


def test_a_line_between_ever_different_words(spark, monkeypatch):
    lines = ([f"l{s}-{i}" for i in range(12)] for s in range(1000))
    line = next(x for x in lines if window_hashes(hashed(" ".join(x).encode()), 10).min() < 1 << 57)  # one that is mostly the anchor
    rows = [(i, " ".join([f"a{i}x{k}" for k in range(9)] + line + [f"b{i}x{k}" for k in range(9)])) for i in range(400)]
    rows += [(1000 + i, " ".join([f"a{i}x{k}" for k in range(9)] + line)) for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    hot = hot_anchors(df, 20, 10, 1e-3, 1)
    inner = window_hashes(hashed(" ".join(line).encode()), 10)
    assert set(hot.tolist()) <= set(inner.tolist()) and len(hot)
    for found in (np.empty(0, np.uint64), hot):  # the result is the same, however windows are dealt out
        monkeypatch.setattr(substring, "hot_anchors", lambda *_, found=found: found)
        got = {r.doc_id: r.n_removed for r in dedup_windows(df, gather=500).collect()}
        assert all(got[i] == 0 for i in range(400)) and all(got[1000 + i] == 21 for i in range(50))


def test_columns_with_clashing_names(spark):
    df = spark.createDataFrame([(1, "a " * 30, 7, 7, 7, 7, 7)], "doc_id long, text string, doc int, tie int, spans int, _text int, _doc int")
    got = dedup_windows(df).first()
    assert (got.doc, got.tie, got.spans, got["_text"], got["_doc"], got.n_removed) == (7, 7, 7, 7, 7, 29)


def test_helpers():
    r = np.random.default_rng(1)
    x = r.integers(0, 9, 200).astype(np.uint64)
    for n in (1, 2, 3, 7, 11, 200):
        assert sliding_argmin(x, n).tolist() == [i + int(np.argmin(x[i : i + n])) for i in range(200 - n + 1)]
    for _ in range(20):
        starts = r.integers(0, 40, 8)
        stops = starts + r.integers(1, 12, 8)
        covered = {w for a, z in zip(starts, stops, strict=True) for w in range(a, z)}
        cut = maximal(starts, stops, 52)
        assert {w for a, z in zip(cut[::2], cut[1::2], strict=True) for w in range(a, z)} == covered and (np.diff(cut) > 0).all()
    a = window_hashes(hashed(b"q w e r t y"), 3)
    b = window_hashes(hashed(b"  zz   w\te r\n"), 3)
    assert a[1] == b[1] and len(set(a.tolist())) == 4 and len(window_hashes(hashed(b"a b"), 3)) == 0
    assert maximal(np.array([5, 1, 3, 20, 8]), np.array([9, 3, 4, 30, 12]), 30).tolist() == [1, 4, 5, 12, 20, 30]
    assert substring.WIDTH == 20
