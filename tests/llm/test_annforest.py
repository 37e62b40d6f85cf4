import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from foldkeep.llm.annforest import fit, nearest
from foldkeep.llm.queries import op4_nearest_vectors


def brute(ids, x, asked, k):
    out = {}
    for q in asked:
        d = np.sqrt(((x - x[ids.index(q)]) ** 2).sum(1))
        out[q] = [(i, v) for v, i in sorted((v, i) for v, i in zip(d, ids, strict=True) if i != q)[:k]]
    return out


def recall(got, want):
    hit = sum(len({i for i, _ in want[q]} & {r.vec_id for r in got if r.query_id == q}) for q in want)
    return hit / sum(map(len, want.values()))


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall_and_exact_scores(spark, sf):
    rows = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").collect()
    ids, x = [r.vec_id for r in rows], np.array([r.embedding for r in rows], float)
    want = brute(ids, x, [i for i in ids if i % 100 == 0], 10)
    got = op4_nearest_vectors(spark, f"/root/testdata/{sf}").collect()
    assert recall(got, want) >= 0.9
    for q in want:
        own = sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == list(range(1, 11))
        assert [(r.score, r.vec_id) for r in own] == sorted((r.score, r.vec_id) for r in own)
        for r in own:
            assert math.isclose(r.score, float(np.sqrt(((x[ids.index(q)] - x[ids.index(r.vec_id)]) ** 2).sum())), rel_tol=1e-12)


def test_clusters_need_few_leaves():
    rng = np.random.default_rng(0)
    x = np.repeat(rng.standard_normal((64, 16)) * 10, 64, 0) + rng.standard_normal((4096, 16)) * 0.01
    f = fit(x, np.arange(4096), 4096, 10)
    visits = [len(f.search(x[i], f.reach * f.radius(x[i], i, 10))) for i in range(0, 4096, 100)]
    assert np.mean(visits) < 0.2 * f.normals.shape[0] * 2**f.depth


def test_ties_copies_and_parts(spark):
    data = [(i, [1.0, 2.0, 3.0]) for i in range(300)] + [(1000, [1.0, 2.0, 4.0]), (1000, [1.0, 2.0, 9.0])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>")
    got = nearest(df, df.where("vec_id in (0, 200, 1000)"), part_rows=40).orderBy("query_id", "rank").collect()
    assert [r.vec_id for r in got if r.query_id == 0] == list(range(1, 11))
    assert [r.vec_id for r in got if r.query_id == 200] == list(range(10))
    assert {r.score for r in got if r.query_id == 1000} == {1.0}


def test_rows_that_repeat_identifiers_hide_no_neighbour(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((400, 8))
    data = [(i, (x[i] + 0.1 * c).tolist()) for i in range(400) for c in range(6)] + [(7, x[7].tolist())] * 3000
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    asked = spark.createDataFrame([(1000 + i, x[i].tolist()) for i in range(20)], "vec_id long, embedding array<double>")
    got = nearest(df, asked, sample_rows=128, part_rows=500).collect()
    hit = 0
    for i in range(20):
        d = np.sqrt(np.stack([((x + 0.1 * c - x[i]) ** 2).sum(1) for c in range(6)]).min(0))
        own = sorted((r for r in got if r.query_id == 1000 + i), key=lambda r: r["rank"])
        assert len(own) == len({r.vec_id for r in own}) == 10
        assert all(math.isclose(r.score, d[r.vec_id], rel_tol=1e-12, abs_tol=1e-12) for r in own)
        hit += len({r.vec_id for r in own} & set(np.argsort(d, kind="stable")[:10].tolist()))
    assert hit >= 180


def test_vectors_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    bad = [None, [], [0.0, 0.0], [1.0, None], [nan, 1.0], [inf, 1.0], [1.0, 2.0, 3.0]]
    data = [(i, v) for i, v in enumerate(bad)] + [(None, [1.0, 1.0]), (100, [1.0, 1.0]), (101, [1.0, 2.0]), (102, [5.0, 1.0])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in nearest(df, df).orderBy("query_id", "rank").collect()]
    assert got == [(100, 1, 101, 1.0), (100, 2, 102, 4.0), (101, 1, 100, 1.0), (101, 2, 102, math.sqrt(17)), (102, 1, 100, 4.0), (102, 2, 101, math.sqrt(17))]
    assert nearest(df.where(F.lit(False)), df).isEmpty()
    assert nearest(df.where("vec_id = 100"), df.where("vec_id = 100")).isEmpty()
