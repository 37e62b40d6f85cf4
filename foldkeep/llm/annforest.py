"""Approximate nearest neighbours by a forest of random-projection trees.

Each tree halves its part of a bounded sample again and again, along the line
between two random members at the median of the projections. All trees are
searched through one priority queue: a branch's priority is the sum of the
squared distances to the planes that lie between it and the query, and leaves
are taken in that order until the priority passes ``reach * r**2``. ``r`` is the
query's distance to its k-th neighbour in the sample, which is at least that to
its k-th neighbour among all rows. ``reach`` is fitted: on sample queries, the
quantile ``recall`` of the reach that their true neighbours need. So clustered
vectors need few leaves, and vectors without structure as many as the recall
takes. Candidates of a leaf are ranked by exact distance.

Every row is indexed, once a tree. Rows of a leaf and the queries that look
into it meet in one task; leaves above ``part_rows`` rows are dealt out in parts
to which the leaf's queries are copied, so no task holds more than a part.
What is broadcast is the forest and the sample, whose sizes the parameters fix.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldkeep.session import lean


@dataclass
class Forest:
    """Planes of ``trees`` complete binary trees of one depth; children of node n are 2n+1 (below) and 2n+2 (above)."""

    depth: int
    normals: np.ndarray  # trees x inner nodes x dimensions
    offsets: np.ndarray  # trees x inner nodes
    sample: np.ndarray
    ids: np.ndarray
    reach: float = np.inf

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """rows x trees: the leaf of each row, as a number from 0."""
        out = np.empty((len(x), len(self.normals)), np.int32)
        for t, (w, c) in enumerate(zip(self.normals, self.offsets, strict=True)):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (np.einsum("ij,ij->i", x, w[node]) > c[node])
            out[:, t] = node - len(c)
        return out

    def penalties(self, q: np.ndarray, x: np.ndarray) -> np.ndarray:
        """trees: the priority that the leaf of ``x`` has in each tree for the query ``q``."""
        out = np.zeros(len(self.normals))
        for t, (w, c) in enumerate(zip(self.normals, self.offsets, strict=True)):
            node = 0
            for _ in range(self.depth):
                above, margin = x @ w[node] > c[node], q @ w[node] - c[node]
                out[t] += margin**2 * ((margin > 0) != above)
                node = 2 * node + 1 + int(above)
        return out

    def radius(self, q: np.ndarray, own: int | None, k: int) -> float:
        """Squared distance to the k-th neighbour in the sample (infinite if there are fewer)."""
        d = np.sort(((self.sample[self.ids != own] - q) ** 2).sum(1))
        return float(d[k - 1]) if len(d) >= k else np.inf

    def search(self, q: np.ndarray, bound: float) -> list[tuple[int, int]]:
        """(tree, leaf) of all leaves up to the bound, nearest first, from one queue for all trees."""
        inner, out = self.offsets.shape[1], []
        margins = self.normals @ q - self.offsets
        queue = [(0.0, t, 0) for t in range(len(self.normals))]
        while queue:
            p, t, n = heapq.heappop(queue)
            if p > bound:
                break
            if n >= inner:
                out.append((t, n - inner))
                continue
            m = margins[t, n]
            near = 2 * n + 1 + int(m > 0)
            heapq.heappush(queue, (p, t, near))
            heapq.heappush(queue, (p + m * m, t, 4 * n + 3 - near))
        return out


def fit(sample: np.ndarray, ids: np.ndarray, rows: int, k: int, trees: int = 8, leaf_rows: int = 256, recall: float = 0.97, queries: int = 200, seed: int = 5) -> Forest:
    """A forest for a table of ``rows`` rows from a sample of it."""
    rng = np.random.default_rng(seed)
    depth = max(1, min(int(np.log2(max(2, rows / leaf_rows))), int(np.log2(max(2, len(sample) / 32)))))
    inner = (1 << depth) - 1
    normals, offsets = np.zeros((trees, inner, sample.shape[1])), np.zeros((trees, inner))
    for t in range(trees):
        part = {0: np.arange(len(sample))}
        for n in range(inner):
            i = part.pop(n)
            w = np.zeros(sample.shape[1])
            for _ in range(5):  # two members that differ, if a few draws find them
                if len(i) > 1:
                    a, b = rng.choice(i, 2, replace=False)
                    w = sample[a] - sample[b]
                if w.any():
                    break
            if not w.any():
                w = rng.standard_normal(sample.shape[1])
            w /= np.linalg.norm(w)
            p = sample[i] @ w
            c = float(np.median(p)) if len(i) else 0.0
            normals[t, n], offsets[t, n] = w, c
            part[2 * n + 1], part[2 * n + 2] = i[p <= c], i[p > c]
    f = Forest(depth, normals, offsets, sample, ids)
    need = []
    for j in rng.permutation(len(sample))[:queries]:
        d = ((sample - sample[j]) ** 2).sum(1)
        d[j] = np.inf
        near = np.argsort(d, kind="stable")[: min(k, len(sample) - 1)]
        if len(near) == k and d[near[-1]] > 0:
            need += [f.penalties(sample[j], sample[x]).min() / d[near[-1]] for x in near]
    if len(need) >= 100:
        f.reach = float(np.quantile(need, recall))
    return f


def usable(v: str) -> Column:
    """Whether a vector takes part: not null, of some length, all components finite, not all zero."""
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(v) > 0) & fine & F.exists(v, lambda x: x != 0), F.lit(False))


def _matrix(col: pa.Array, dim: int) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _best(q: np.ndarray, qid: np.ndarray, x: np.ndarray, xid: np.ndarray, k: int) -> tuple[list, list, list]:
    """The k nearest identifiers of a part for each query by exact distance, ties by identifier; rows are sorted by identifier, and one that repeats counts at its nearest row."""
    out: tuple[list, list, list] = ([], [], [])
    xx = (x**2).sum(1)
    first = np.flatnonzero(np.r_[True, xid[1:] != xid[:-1]])
    of = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(xid)]))
    for a in range(0, len(q), 256):
        qq = (q[a : a + 256] ** 2).sum(1)
        rough = qq[:, None] + xx[None, :] - 2 * (q[a : a + 256] @ x.T)
        rough[qid[a : a + 256, None] == xid[None, :]] = np.inf
        each = rough if len(first) == len(x) else np.minimum.reduceat(rough, first, axis=1)
        last = min(k, len(first)) - 1
        kth = np.partition(each, last, 1)[:, last]
        kth = np.where(np.isfinite(kth), kth, np.finfo(float).max)
        slack = 1e-12 * (qq + xx.max()) * q.shape[1]
        for r in range(len(qq)):
            near = np.flatnonzero(rough[r] <= kth[r] + slack[r])
            d = np.sqrt(((x[near] - q[a + r]) ** 2).sum(1))
            order = np.argsort(d, kind="stable")
            keep = order[np.sort(np.unique(of[near[order]], return_index=True)[1])[:k]]
            out[0].extend([qid[a + r]] * len(keep))
            out[1].extend(xid[near[keep]].tolist())
            out[2].extend(d[keep].tolist())
    return out


def nearest(
    rows: DataFrame, queries: DataFrame, k: int = 10, vec_id: str = "vec_id", vector: str = "embedding", sample_rows: int = 8192, trees: int = 8, leaf_rows: int = 256, recall: float = 0.97, part_rows: int = 20_000
) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each query its ``k`` nearest rows found, by Euclidean distance.

    Identifiers name vectors: rows with the query's own are no candidates, and
    rows that repeat an identifier count once, at their smallest distance.
    Vectors that are null, empty, zero or hold a null or non-finite component
    take no part, nor do those of another dimension than most usable rows have,
    nor rows without an identifier. Equal distances rank by identifier. An
    empty table, or one of a single vector, gives no rows.
    """
    spark = rows.sparkSession
    pick = lambda df: df.where(usable(vector) & F.col(vec_id).isNotNull()).select(F.col(vec_id).alias("id"), F.col(vector).cast("array<double>").alias("v"))
    x = pick(rows)
    of = x.schema["id"].dataType.simpleString()
    dims = x.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    if dims is None:
        return spark.createDataFrame([], f"query_id {of}, rank int, vec_id {of}, score double")
    dim, total = dims.d, dims.n
    x, q = x.where(F.size("v") == dim), pick(queries).where(F.size("v") == dim)
    # identifiers are drawn, not rows, so that one that repeats very often does not fill the sample
    drawn = x.select("id").distinct().orderBy(F.xxhash64("id"), "id").limit(sample_rows)
    got = x.join(F.broadcast(drawn), "id").groupBy("id").agg(F.min("v").alias("v")).orderBy(F.xxhash64("id"), "id").toArrow()
    forest = fit(_matrix(got.column("v").combine_chunks(), dim), np.array(got.column("id").to_pylist()), total, k, trees, leaf_rows, recall)
    shared = spark.sparkContext.broadcast(forest)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            leaf = shared.value.leaves(_matrix(b.column(1), dim))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(leaf.tolist(), pa.list_(pa.int32()))], names=["id", "v", "leaf"])

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = shared.value
        for b in batches:
            found = []
            for own, v in zip(b.column(0).to_pylist(), _matrix(b.column(1), dim), strict=True):
                r = f.radius(v, own, k)
                found.append([{"tree": t, "leaf": n} for t, n in f.search(v, f.reach * r if np.isfinite(r) else np.inf)])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found, pa.list_(pa.struct([("tree", pa.int32()), ("leaf", pa.int32())])))], names=["id", "v", "visit"])

    indexed = x.mapInArrow(lean(place), f"id {of}, v array<double>, leaf array<int>").select("id", "v", F.posexplode("leaf").alias("tree", "leaf"))
    # a row a leaf, at most trees * 2**depth
    sizes = indexed.groupBy("tree", "leaf").agg(F.count("*").alias("n")).withColumn("parts", F.ceil(F.col("n") / part_rows).cast("int")).drop("n")
    sizes = F.broadcast(sizes)
    indexed = indexed.join(sizes, ["tree", "leaf"]).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    asked = q.mapInArrow(lean(look), f"id {of}, v array<double>, visit array<struct<tree:int,leaf:int>>").select("id", "v", F.explode("visit").alias("c")).select("id", "v", "c.tree", "c.leaf")
    asked = asked.join(sizes, ["tree", "leaf"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    names = ["tree", "leaf", "part", "query", "id", "v"]
    both = indexed.withColumn("query", F.lit(0)).select(names).union(asked.withColumn("query", F.lit(1)).select(names))
    dealt = both.repartition("tree", "leaf", "part").sortWithinPartitions("tree", "leaf", "part", "query", "id")

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ask = np.concatenate([b.column(3).to_numpy() for b in parts])
            ids = np.array([i for b in parts for i in b.column(4).to_pylist()], dtype=object if of == "string" else None)
            v = np.concatenate([_matrix(b.column(5), dim) for b in parts])
            m, s = ask == 1, ask == 0
            if m.any() and s.any():
                found = _best(v[m], ids[m], v[s], ids[s], k)
                yield pa.RecordBatch.from_arrays([pa.array(found[0], parts[0].schema.field("id").type), pa.array(found[1], parts[0].schema.field("id").type), pa.array(found[2], pa.float64())], names=["query_id", "vec_id", "score"])

        held: list[pa.RecordBatch] = []
        at = None
        for b in batches:
            key = np.stack([b.column(i).to_numpy() for i in range(3)], 1)
            cut = np.r_[0, np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1, len(key)]
            for a, z in zip(cut[:-1], cut[1:], strict=True):
                if a == z:
                    continue
                if held and tuple(key[a]) != at:
                    yield from done(held)
                    held = []
                at = tuple(key[a])
                held.append(b.slice(int(a), int(z - a)))
        if held:
            yield from done(held)

    found = dealt.mapInArrow(lean(rank), f"query_id {of}, vec_id {of}, score double").groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
