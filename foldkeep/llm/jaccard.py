"""Self-join of documents by the Jaccard similarity of their word shingles, by a MinHash LSH forest.

Each document has ``TREES`` sequences of ``DEPTH`` MinHash values, kept as sorted
keys: its labels in as many prefix tries. Two documents of similarity s share a
prefix of length d in some trie with probability ``1 - (1 - s**d)**TREES``.
Nodes of the shortest prefix that can be needed (``prefix_length``) are found
first; a document that is alone in all of these has no candidates. The others
climb: matched prefixes begin at the full depth and are shortened level by
level, each level adding the pairs that first meet there. After each level the
recall is measured on the verified links: a link of similarity s that was found
stands for ``1 / P(found)`` links. Prefixes are shortened until the links that
are missing by this measure, two standard deviations included, are fewer than
the target allows; fewer than ``1 / (1 - recall)`` links measure nothing, so
prefixes then go down to the length that reaches the recall at the threshold
itself, beyond which they never go.

Candidates are verified exactly on their shingle sets. No pair ever becomes a
row: copies (equal shingle sets) count as one class with a number of members,
nodes emit only members that have a partner left after a comparison of
signatures, and verification emits one row a member with its number of links
and a root, enough to connect it. A pair that meets in several tries is looked
at in the first alone. Nodes above ``BLOCK`` classes are dealt out as pairs of
blocks, so that none needs one task's memory, whatever its size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldkeep.llm.links import components
from foldkeep.llm.windows import hashed, mix, window_hashes
from foldkeep.session import lean, materialize

SHINGLE, THRESHOLD, RECALL = 5, 0.8, 0.9999
TREES, DEPTH = 20, 6
#: Classes of a node that one task compares with each other.
BLOCK = 300
#: Bytes of a MinHash value in a label.
VALUE = 2
#: Standard deviations below the threshold at which a pair of signatures still passes.
SLACK = 5.0

_rng = np.random.default_rng(20240229)
_XOR = _rng.integers(0, 1 << 63, TREES * DEPTH, dtype=np.uint64)
_ODD = _rng.integers(0, 1 << 63, TREES * DEPTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def prefix_length(threshold: float = THRESHOLD, recall: float = RECALL, trees: int = TREES, depth: int = DEPTH) -> int:
    """The longest prefix whose matches reach the target recall at the threshold: none is shortened further."""
    for d in range(depth, 0, -1):
        if 1 - (1 - threshold**d) ** trees >= recall:
            return d
    raise ValueError("no prefix reaches the target recall; use more trees")


def shingles(text: bytes, n: int = SHINGLE) -> np.ndarray:
    """Sorted, different hashes of a text's shingles. Texts of fewer than ``n`` words have one shingle, all their words; texts without words have none."""
    words = hashed(text)
    if not len(words):
        return words
    return np.unique(window_hashes(words, min(n, len(words))))


def signature(s: np.ndarray) -> np.ndarray:
    """MinHash values of a non-empty set."""
    low = np.full(TREES * DEPTH, np.iinfo(np.uint64).max)
    for i in range(0, len(s), 2048):
        low = np.minimum(low, ((s[i : i + 2048, None] ^ _XOR) * _ODD).min(0))
    return low


def found_at(s: np.ndarray, d: int, trees: int = TREES) -> np.ndarray:
    """The probability that pairs of similarity ``s`` share a prefix of length ``d`` in some trie."""
    return 1 - (1 - s**d) ** trees


def labels_of(s: np.ndarray) -> bytes:
    """The labels of a non-empty set in all tries, one after the other: ``DEPTH`` values of ``VALUE`` bytes, the first one in front."""
    return (mix(signature(s)) >> np.uint64(64 - 8 * VALUE)).astype(f">u{VALUE}").tobytes()


def _signed(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """doc_id, tie, cls (of the set), size, labels."""
    for b in batches:
        out: dict[str, list] = {c: [] for c in ("cls", "size", "labels")}
        for x in b.column(2):
            s = shingles(x.as_buffer().to_pybytes() if x.is_valid else b"", n)
            out["size"].append(len(s))
            out["cls"].append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
            out["labels"].append(labels_of(s) if len(s) else None)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out["cls"], pa.binary()), pa.array(out["size"], pa.int64()), pa.array(out["labels"], pa.binary())], names=["doc_id", "tie", *out])


def _groups(batches: Iterator[pa.RecordBatch], most: int, handle: Callable[[pa.Table], pa.Table | None]) -> Iterator[pa.RecordBatch]:
    """Hands whole groups of equal (key, lo, hi) to ``handle``; rows come sorted by these."""
    held: list[pa.RecordBatch] = []
    rows = size = 0

    def done(t: pa.Table):
        found = handle(t.combine_chunks())
        if found is not None and found.num_rows:
            yield from found.combine_chunks().to_batches()

    for b in batches:
        held.append(b)
        rows, size = rows + b.num_rows, size + b.nbytes
        if rows < most and size < 32 << 20:
            continue
        t = pa.Table.from_batches(held)
        new = _new_group(t)
        last = int(np.flatnonzero(new)[-1])
        if last:
            yield from done(t.slice(0, last))
        held = t.slice(last).combine_chunks().to_batches()
        rows, size = sum(x.num_rows for x in held), sum(x.nbytes for x in held)
    if held:
        t = pa.Table.from_batches(held)
        if t.num_rows:
            yield from done(t)


def _new_group(t: pa.Table) -> np.ndarray:
    cols = [t.column(c).to_numpy() for c in ("key", "lo", "hi")]
    return np.r_[True, np.logical_or.reduce([c[1:] != c[:-1] for c in cols])]


def _labels(t: pa.Table) -> np.ndarray:
    """members x trees x depth"""
    return np.frombuffer(b"".join(t.column("labels").to_pylist()), f">u{VALUE}").astype(f"u{VALUE}").reshape(t.num_rows, TREES, DEPTH)


def _new_pairs(labels: np.ndarray, i: np.ndarray, j: np.ndarray, tree: np.ndarray, d: int, above: int | None) -> np.ndarray:
    """Whether pairs meet for the first time: in no trie at the level before (``above``), and in no earlier trie at this one."""
    same = labels[i] == labels[j]
    ok = same[:, :, :d].all(2).argmax(1) == tree[i]
    return ok if above is None else ok & ~same[:, :, :above].all(2).any(1)


def _partnered(t: pa.Table, least: float, d: int, above: int | None) -> pa.Table | None:
    """The members of nodes that have a new partner whose signature is near enough."""
    group = np.cumsum(_new_group(t))
    own, lo, hi, tree = (t.column(c).to_numpy() for c in ("own", "lo", "hi", "tree"))
    labels = _labels(t)
    flat = labels.reshape(t.num_rows, -1)
    stay = np.zeros(t.num_rows, bool)
    at, step = np.arange(t.num_rows), 1
    while True:
        at = at[at < t.num_rows - step]
        at = at[group[at] == group[at + step]]
        if not len(at):
            break
        for i in (at[k : k + 20_000] for k in range(0, len(at), 20_000)):
            j = i + step
            ok = (lo[i] == hi[i]) | (own[i] != own[j])
            i, j = i[ok], j[ok]
            ok = (flat[i] == flat[j]).sum(1) >= least
            i, j = i[ok], j[ok]
            ok = _new_pairs(labels, i, j, tree, d, above)
            stay[i[ok]] = stay[j[ok]] = True
        step += 1
    return t.filter(pa.array(stay))


def _verified(t: pa.Table, threshold: float, d: int, above: int | None, levels: list[int]) -> pa.Table | None:
    """A row a member with links: their number (all members of the linked classes), and a root that connects it.

    ``pairs`` counts the member's links to later members, ``stand`` the links
    that these stand for at each level, and ``spread`` the variances of that.
    """
    edge = np.flatnonzero(_new_group(t))
    own, lo, hi, tree, copies = (t.column(c).to_numpy() for c in ("own", "lo", "hi", "tree", "copies"))
    labels, sets, names = _labels(t), t.column("shingles").to_pylist(), t.column("cls").to_pylist()
    out: dict[str, list] = {c: [] for c in ("cls", "root", "links", "pairs", "stand", "spread")}
    for a, z in zip(edge, [*edge[1:], t.num_rows], strict=True):
        if z - a < 2:
            continue
        s = [np.frombuffer(x, np.uint64) for x in sets[a:z]]
        n = np.array([len(x) for x in s])
        both = intersections(s)
        union = n[:, None] + n[None, :] - both
        i, j = np.nonzero(np.triu(both >= threshold * union - 1e-9, 1))
        alike = both[i, j] / union[i, j]
        i, j = i + a, j + a
        ok = (lo[i] == hi[i]) | (own[i] != own[j])
        i, j, alike = i[ok], j[ok], alike[ok]
        ok = _new_pairs(labels, i, j, tree, d, above)
        i, j, alike = i[ok] - a, j[ok] - a, alike[ok]
        if not len(i):
            continue
        links = np.bincount(i, copies[a + j], z - a) + np.bincount(j, copies[a + i], z - a)
        pairs = np.bincount(i, minlength=z - a)
        p = np.stack([found_at(alike, x) for x in levels], 1)
        stand = np.stack([np.bincount(i, 1 / p[:, k], z - a) for k in range(len(levels))], 1)
        spread = np.stack([np.bincount(i, (1 - p[:, k]) / p[:, k] ** 2, z - a) for k in range(len(levels))], 1)
        root = np.arange(z - a)
        while True:
            low = root.copy()
            np.minimum.at(low, i, root[j])
            np.minimum.at(low, j, root[i])
            low = low[low]
            if (low == root).all():
                break
            root = low
        for k in np.flatnonzero(links):
            for c, v in zip(out, (names[a + k], names[a + root[k]], int(links[k]), int(pairs[k]), stand[k].tolist(), spread[k].tolist()), strict=True):
                out[c].append(v)
    kinds = (pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.float64()))
    return pa.table({c: pa.array(v, k) for (c, v), k in zip(out.items(), kinds, strict=True)})


def intersections(sets: list[np.ndarray], wide: int = 4096) -> np.ndarray:
    """Sizes of the pairwise intersections, by products of 0/1 matrices over the values that two sets or more hold."""
    m = len(sets)
    row = np.repeat(np.arange(m), [len(s) for s in sets])
    value = np.concatenate(sets)
    order = np.argsort(value, kind="stable")
    v, row = value[order], row[order]
    new = np.r_[True, v[1:] != v[:-1]]
    col = np.cumsum(new) - 1
    often = np.bincount(col) > 1
    rank = np.cumsum(often) - 1
    keep = often[col]
    row, col = row[keep], rank[col[keep]]
    total = np.zeros((m, m), np.float32)
    for c in range(0, int(often.sum()), wide):
        a, b = np.searchsorted(col, [c, c + wide])
        part = np.zeros((m, wide), np.float32)
        part[row[a:b], col[a:b] - c] = 1
        total += part @ part.T
    out = np.rint(total).astype(np.int64)
    out[np.arange(m), np.arange(m)] = [len(s) for s in sets]
    return out


def jaccard_classes(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, threshold: float = THRESHOLD, recall: float = RECALL, block: int = BLOCK, broadcast_rows: int = 1_000_000
) -> DataFrame:
    """Per row of ``docs``: ``doc_id, class_id, n_links, copy_id, n_shingles``.

    ``n_links`` counts the other rows whose similarity is ``threshold`` or more
    (copies included), ``class_id`` is the smallest doc_id that such links lead
    to, ``copy_id`` the smallest with an equal shingle set. Texts without words
    (null, empty, white space) link to nothing and are their own class; texts of
    fewer than ``shingle`` words have one shingle, all their words. Rows that
    repeat a doc_id are rows of their own; a null doc_id gets the smallest
    non-null one of its class, or null. Identifiers may be of any type that has
    an order. An empty table gives an empty result; very long texts are read whole.
    """
    return jaccard_rows(docs, doc_id, text, shingle, threshold, recall, block, broadcast_rows).drop("tie", "stays")


def tries(classes: DataFrame, d: int) -> DataFrame:
    """``cls, copies, labels, tree``: the members of nodes of prefix length ``d`` that hold several classes.

    Counts by node combine before the shuffle, and members meet them in an
    equi-join whose large partitions Spark splits. Classes go there by a number
    of 8 bytes; if two share it, each is listed with the other's nodes too,
    where it may be alone.
    """
    width = DEPTH * VALUE
    node = F.substring(F.col("labels"), F.col("tree") * width + 1, F.lit(VALUE * d))
    keys = classes.select(F.xxhash64("cls").alias("id"), "labels", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree")).select("id", "tree", F.xxhash64("tree", node).alias("key"))
    several = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    found = keys.join(several, "key", "left_semi").groupBy("id").agg(F.collect_set("tree").alias("trees"))
    return classes.select(F.xxhash64("cls").alias("id"), "cls", "copies", "labels").join(found, "id").select("cls", "copies", "labels", F.explode("trees").alias("tree"))


def level(members: DataFrame, d: int, above: int | None, block: int, least: float, broadcast_rows: int) -> DataFrame:
    """The members of ``d``-long prefixes that have new partners by their signatures: a row a node and pair of blocks.

    Nodes are counted without their labels, and only those above ``block`` are
    dealt out, so that labels are shuffled once.
    """
    base = "cls binary, tree int, key long, own int, lo int, hi int, copies long, labels binary"
    node = F.substring(F.col("labels"), F.col("tree") * (DEPTH * VALUE) + 1, F.lit(VALUE * d))
    rows = members.withColumn("key", F.xxhash64("tree", node))
    large = materialize(rows.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > block), "jaccard-large")
    rows = rows.join(F.broadcast(large) if large.count() <= broadcast_rows else large, "key", "left")
    rows = rows.withColumn("parts", F.coalesce(F.ceil(F.col("n") / block), F.lit(1)).cast("int")).withColumn("own", F.pmod(F.xxhash64("cls"), F.col("parts")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = rows.withColumn("lo", F.least("own", "other")).withColumn("hi", F.greatest("own", "other"))
    ordered = rows.select(*[c.split()[0] for c in base.split(", ")]).repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")
    return ordered.mapInArrow(lean(lambda b: _groups(b, 10_000, lambda t: _partnered(t, least, d, above))), base)


def jaccard_rows(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, threshold: float = THRESHOLD, recall: float = RECALL, block: int = BLOCK, broadcast_rows: int = 1_000_000, report: list | None = None
) -> DataFrame:
    """``jaccard_classes`` with ``tie``, the hash of the row's text, and ``stays``, whether the row stands for its class.

    The row of the smallest doc_id (null last) and tie does, and so does each row
    that repeats both; so does each row without words. ``report`` is filled with
    a tuple for each level: its prefix length, the links between different sets
    found so far, and those that they stand for.
    """
    floor = prefix_length(threshold, recall)
    levels = list(range(DEPTH, floor - 1, -1))
    keyed = lambda: docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("tie"), F.col(text).cast("binary").alias("text"))
    of = docs.schema[doc_id].dataType.simpleString()
    rows = materialize(keyed().mapInArrow(lean(lambda b: _signed(b, shingle)), f"doc_id {of}, tie long, cls binary, size long, labels binary"), "jaccard-rows")
    # one row a class: its members, and one of them that stands for its text
    classes = rows.where("cls is not null").groupBy("cls").agg(
        F.min("doc_id").alias("copy_id"), F.count("*").alias("copies"), F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tie")).alias("rep"), F.first("labels").alias("labels")
    )
    classes = materialize(classes, "jaccard-classes")
    members = materialize(tries(classes, floor), "jaccard-tries")

    wanted = materialize(members.select("cls").distinct().join(classes.select("cls", "rep"), "cls").select("cls", F.col("rep.doc_id").alias("_d"), F.col("rep.tie").alias("_t")), "jaccard-wanted")
    n_wanted = wanted.count()
    few = F.broadcast(wanted) if n_wanted <= broadcast_rows else wanted
    texts = keyed().join(few, F.col("doc_id").eqNullSafe(F.col("_d")) & F.col("tie").eqNullSafe(F.col("_t"))).select("cls", "text")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for b in batches:
            first = {c: i for i, c in reversed(list(enumerate(b.column(0).to_pylist()))) if c not in seen}
            seen.update(first)
            found = [shingles(b.column(1)[i].as_buffer().to_pybytes(), shingle).tobytes() for i in first.values()]
            yield pa.RecordBatch.from_arrays([pa.array(first, pa.binary()), pa.array(found, pa.binary())], names=["cls", "shingles"])

    sets_of = None
    least = TREES * DEPTH * threshold - SLACK * (TREES * DEPTH * threshold * (1 - threshold)) ** 0.5
    kind = "cls binary, root binary, links long, pairs long, stand array<double>, spread array<double>"
    every, known, above = [], 0, None
    stand, spread = np.zeros(len(levels)), np.zeros(len(levels))
    for k, d in enumerate(levels):
        left = materialize(level(members, d, above, block, least, broadcast_rows), "jaccard-members")
        if sets_of is None:
            sets_of = materialize(texts.mapInArrow(lean(sets), "cls binary, shingles binary"), "jaccard-sets")
            if sets_of.count() > n_wanted:  # a repeated row stands for its class in several tasks: one is enough
                sets_of = materialize(sets_of.dropDuplicates(["cls"]), "jaccard-sets")
        # only the sets that this level looks at are shuffled
        own = materialize(left.select("cls").distinct(), "jaccard-level")
        some = sets_of.join(F.broadcast(own), "cls", "left_semi") if own.count() <= broadcast_rows else sets_of
        full = left.join(some, "cls").repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")
        run = lean(lambda b, d=d, above=above: _groups(b, 5_000, lambda t: _verified(t, threshold, d, above, levels)))
        found = materialize(full.mapInArrow(run, kind), "jaccard-links")
        every.append(found.select("cls", "root", "links"))
        got = found.agg(F.sum("pairs"), *[F.sum(F.element_at(c, i + 1)) for c in ("stand", "spread") for i in range(len(levels))]).first()
        known += got[0] or 0
        stand += [x or 0 for x in got[1 : len(levels) + 1]]
        spread += [x or 0 for x in got[len(levels) + 1 :]]
        if report is not None:
            report.append((d, known, float(stand[k])))
        if known * (1 - recall) >= 1 and stand[k] - known + 2 * spread[k] ** 0.5 <= known * (1 - recall):
            break
        above = d
    found = every[0]
    for more in every[1:]:
        found = found.union(more)

    joined = components(found.where("cls <> root"), "cls", "root")
    near = found.groupBy("cls").agg(F.sum("links").alias("links"))
    info = classes.select("cls", "copy_id", "copies", "rep").join(near, "cls", "left").join(joined.withColumnRenamed("node", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    smallest = info.where("links is not null").groupBy("root").agg(F.min("copy_id").alias("class_id"), F.min("rep").alias("first"))
    info = info.join(smallest, "root", "left").select("cls", "copy_id", F.coalesce("class_id", "copy_id").alias("class_id"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("first", "rep").alias("first"))
    stays = F.col("first").isNull() | (F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("tie") == F.col("first.tie")))
    return rows.join(info, "cls", "left").select(
        "doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("copy_id", "doc_id").alias("copy_id"), F.col("size").alias("n_shingles"),
        "tie", stays.alias("stays"),
    )
