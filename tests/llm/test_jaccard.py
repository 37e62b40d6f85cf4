import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from foldkeep.llm.jaccard import DEPTH, found_at, intersections, jaccard_classes, jaccard_rows, prefix_length
from foldkeep.llm.links import components


def sets_of(rows, n=5):
    out = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        k = min(n, len(w))
        out.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set())
    return out


def brute(rows, threshold=0.8):
    s = sets_of(rows)
    links = {i: set() for i in range(len(rows))}
    for i in range(len(rows)):
        for j in range(i):
            u = len(s[i] | s[j])
            if u and len(s[i] & s[j]) >= threshold * u - 1e-9:
                links[i].add(j)
                links[j].add(i)
    root = list(range(len(rows)))
    for i in range(len(rows)):  # breadth first from the smallest
        todo = [i]
        while todo:
            x = todo.pop()
            for y in links[x]:
                if root[y] > root[i]:
                    root[y] = root[i]
                    todo.append(y)
    ids = [i for i, _ in rows]
    least = {}
    for k, r in enumerate(root):
        least[r] = min(least.get(r, ids[k]), ids[k])
    return {ids[k]: (least[root[k]], len(links[k])) for k in range(len(rows))}


def made(seed, groups=12, near=9):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(4))
    rows = []
    for _ in range(groups):
        base = [word() for _ in range(r.randrange(30, 120))]
        for _ in range(r.randrange(1, near)):
            w = list(base)
            for _ in range(r.choice([0, 0, 1, 2, 4])):
                w[r.randrange(len(w))] = word()
            rows.append((len(rows), " ".join(w)))
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("block", [1000, 3])
def test_equals_brute_force(spark, block):
    rows = made(5)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard_classes(df, block=block).collect()}
    assert got == brute(rows)


def test_documents_equal_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard_classes(docs).collect()}
    want = brute(rows)
    assert got == want and any(n for _, n in want.values())


def test_odd_rows(spark):
    rows = [(1, None, 0), (2, "", 0), (3, " \n", 0), (4, "a b", 0), (5, "a  b", 0), (6, "a b c", 0), (None, "a\tb", 0), (4, "a b", 0), (7, "x " * 40_000, 0), (8, "x " * 39_000, 0)]
    got = {}
    for r in jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string, class_id int")).collect():
        got.setdefault(r.doc_id, []).append((r.class_id, r.n_links, r.copy_id))
    assert got[1] == [(1, 0, 1)] and got[2] == [(2, 0, 2)] and got[3] == [(3, 0, 3)] and got[6] == [(6, 0, 6)]
    assert got[4] == [(4, 3, 4)] * 2 and got[5] == got[None] == [(4, 3, 4)]
    assert got[7] == got[8] == [(7, 1, 7)]  # one shingle each, the same
    assert jaccard_classes(spark.createDataFrame([], "doc_id long, text string")).isEmpty()


def test_components_by_brute_force(spark):
    r = random.Random(3)
    pairs = [(r.randrange(300), r.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(1000, 1100)] + [(5000, i) for i in range(4000, 4100)] + [(7, 7)]
    got = {x.node: x.root for x in components(spark.createDataFrame(pairs, "a int, b int")).collect()}
    root = {x: x for p in pairs for x in p}
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            m = min(root[a], root[b])
            changed |= (root[a], root[b]) != (m, m)
            root[a] = root[b] = m
    assert got == root


def test_helpers():
    assert prefix_length(0.8, 0.9999) == 4 and prefix_length(0.8, 0.99, depth=5) == 5 and prefix_length(0.8, 0.99) == 6
    with pytest.raises(ValueError):
        prefix_length(0.01, 0.9999)
    r = np.random.default_rng(2)
    s = [np.unique(r.integers(0, 60, r.integers(1, 50)).astype(np.uint64)) for _ in range(30)]
    assert (intersections(s, wide=7) == [[len(np.intersect1d(a, b)) for b in s] for a in s]).all()


def test_recall_is_measured_level_by_level(spark):
    """Links found at each level, and what these are taken to stand for, against all links."""
    r = random.Random(4)
    rows, every = [], 0
    for g in range(150):
        base = [f"{g}w{i}" for i in range(60)]
        rows.append((len(rows), " ".join(base)))
        for _ in range(2):  # a replaced word changes five shingles: 0.84 and 0.97 of similarity
            w = list(base)
            w[r.choice([2, 0])] = f"n{len(rows)}"
            rows.append((len(rows), " ".join(w)))
    every = sum(n for _, n in brute(rows).values()) // 2
    report = []
    out = jaccard_rows(spark.createDataFrame(rows, "doc_id long, text string"), report=report).collect()
    assert [d for d, _, _ in report] == list(range(DEPTH, prefix_length() - 1, -1))
    known = [n for _, n, _ in report]
    assert known == sorted(known) and known[-1] == every == sum(x.n_links for x in out) // 2
    assert all(abs(stands - every) < 0.02 * every for _, _, stands in report)
    assert found_at(np.array([1.0, 0.8]), 4)[0] == 1 and 0.9999 < found_at(np.array([0.8]), 4)[0] < 1


def test_prefixes_stay_long_where_links_are_surely_found(spark):
    """Many links of high similarity and a modest recall: the climb ends before the shortest prefix."""
    base = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(60):
        w = list(base)
        w[i * 6] = f"n{i}"
        rows.append((i, " ".join(w)))
    report = []
    out = jaccard_rows(spark.createDataFrame(rows, "doc_id long, text string"), recall=0.999, report=report).collect()
    assert len(report) == 1 and all(x.class_id == 0 and x.n_links == 59 for x in out)


def test_textual_identifiers(spark):
    t = " ".join(f"w{i}" for i in range(40))
    rows = [("b", t), ("a", t + " more"), (None, t), ("c", "other words")]
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard_classes(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    assert got == {"a": ("a", 2), "b": ("a", 2), None: ("a", 2), "c": ("c", 0)}


def test_sets_are_shuffled_for_the_levels_that_need_them(spark):
    """Shuffled bytes against the bytes of all shingle sets: each goes to its class once and to its nodes, not once more for every level."""
    r = random.Random(6)
    rows = []
    for g in range(100):
        base = [f"{g}w{r.randrange(10**6)}" for _ in range(600)]
        for k in range(3):
            w = list(base)
            w[k * 50 : k * 50 + 2] = [f"n{len(rows)}", f"m{len(rows)}"]
            rows.append((len(rows), " ".join(w)))
    sets = 8 * sum(len(s) for s in sets_of(rows))
    sc = spark.sparkContext

    def stages() -> dict[int, int]:
        found = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
        return {x.stageId(): x.shuffleWriteBytes() for x in sc._jvm.scala.jdk.javaapi.CollectionConverters.asJava(found)}

    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = stages()
        got = jaccard_rows(spark.createDataFrame(rows, "doc_id long, text string"), recall=0.99999).collect()
        spent = sum(n for k, n in stages().items() if k not in before)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    assert all(x.n_links == 2 and x.class_id == x.doc_id // 3 * 3 for x in got)
    assert sets < spent < 5 * sets, spent / sets


def test_equals_brute_force_where_numbers_of_classes_collide(spark, monkeypatch):
    real = F.xxhash64
    monkeypatch.setattr(F, "xxhash64", lambda *c: F.lit(7).cast("long") if c == ("cls",) else real(*c))
    rows = made(8)
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)


def test_rows_that_repeat_stand_for_their_class_once(spark):
    """The same row in many partitions: its set is made in several tasks, and counts once."""
    base = [f"w{i}" for i in range(80)]
    near = [*base[:-1], "other"]
    rows = [(1, " ".join(base))] * 40 + [(2, " ".join(near))] * 3
    got = jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(12)).collect()
    assert sorted((r.doc_id, r.class_id, r.n_links) for r in got) == [(1, 1, 42)] * 40 + [(2, 1, 42)] * 3
