import itertools
import zlib

import numpy as np
import pytest

from foldkeep.llm.langid import Model, fit, fold, identify, label_words, sample, train
from foldkeep.llm.queries import op10_language_id


@pytest.fixture(scope="module")
def model(spark):
    return fit(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where(fold("doc_id", 4) != 2), per_lang=60)


def test_held_out_accuracy(spark):
    docs = {r.doc_id: r for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    got = op10_language_id(spark, "/root/testdata/sf0.01").collect()
    assert sorted(r.doc_id for r in got) == sorted(docs)
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
    own = [r for r in got if r.held_out and r.lang_pred != "und"]
    assert np.mean([r.lang_pred == docs[r.doc_id].lang for r in own]) >= 0.95


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(0)
    m = Model(["a", "b", "c"], np.empty(0, np.uint64), {}, rng.standard_normal(3), rng.standard_normal((3, 3)))
    count = np.array([4, 0, 1, 5])
    e, weight = rng.standard_normal((10, 3)), rng.integers(0, 2, 10).astype(float)
    weight[[0, 4]] = 1
    said = np.full(10, -1)
    got = m.document_means(e, count, weight, said)
    begin = np.cumsum(count) - count
    for d, n in enumerate(count):
        if not n:
            assert not got[d].any()
            continue
        words, sure = got[d][:-1], got[d][-1]
        p = np.zeros((n, 3))
        for path in itertools.product(range(3), repeat=int(n)):
            s = m.start[path[0]] + sum(e[begin[d] + t, y] for t, y in enumerate(path)) + sum(m.move[a, b] for a, b in itertools.pairwise(path))
            for t, y in enumerate(path):
                p[t, y] += np.exp(s)
        p /= p.sum(1, keepdims=True)
        w = weight[begin[d] : begin[d] + n]
        assert np.allclose(words, (p * w[:, None]).sum(0) / max(w.sum(), 1e-12))
        assert np.isclose(sure, (p.max(1) * w).sum() / max(w.sum(), 1e-12))
        assert said[begin[d] : begin[d] + n].tolist() == p.argmax(1).tolist()


def test_code_switched_text_follows_its_larger_part(model):
    en, de = "the of and with that this the from " * 6, "der die und nicht das von mit ist " * 6
    names, scores, sure = model.predict([en + de[:60], de + en[:60], en * 40, en])
    assert names == ["en", "de", "en", "en"] and scores[0] < scores[3]
    # the words of a mixed text are certain of their own languages, and labelled piece by piece
    assert sure[0] > 0.9 > scores[0]
    (a, b, first), (c, d, then) = model.runs([en + de])[0]
    assert (a, first, then, d) == (0, "en", "de", len((en + de).split())) and b == c and abs(b - len(en.split())) <= 2
    assert model.runs([None, "", "12"]) == [[], [], []]


def test_odd_texts(spark, model):
    rows = [(1, None, 0), (2, "", 0), (3, "123 ... !!", 0), (4, "the " * 30_000, 0), (5, "the", 0), (5, "the", 0), (6, "日本語", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, score int")
    got = {}
    for r in identify(df, model).collect():
        assert 0 <= r.score <= 1
        got.setdefault(r.doc_id, []).append(r.lang_pred)
    assert got[1] == got[2] == got[3] == ["und"] and got[4] == ["en"] and len(got[5]) == 2 and got[6][0] in model.labels
    assert identify(df.where("false"), model).isEmpty()


def test_no_labels_and_one_label(spark):
    none = spark.createDataFrame([(1, "a b", None)], "doc_id long, text string, lang string")
    assert identify(none, fit(none)).first().lang_pred == "und"
    assert train(["a b c"], ["xx"]).predict(["q r", None])[0] == ["xx", "und"]


def test_sample_is_bounded_and_the_same_again(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    a, b = sample(docs, 7).collect(), sample(docs.repartition(5), 7).collect()
    assert sorted(a) == sorted(b) and len(a) == 28


def test_sample_of_repeated_rows_stays_bounded(spark):
    docs = spark.createDataFrame([(1, "a b", "en")] * 50 + [(1, "c d", "en"), (None, "e f", "en"), (2, "x" * 300_000, "en")], "doc_id long, text string, lang string")
    got = sorted(r[0] for r in sample(docs, 100).collect())
    assert got == ["a b", "c d", "e f"]


def test_labelled_words_of_a_table(spark, model):
    df = spark.createDataFrame([(1, "the of and with that der die und nicht das", 7), (2, None, 8), (3, "", 9)], "doc_id long, text string, runs int")
    got = {r.doc_id: r.runs for r in label_words(df, model).collect()}
    assert got[2] == got[3] == [] and [r.lang for r in got[1]] == ["en", "de"] and got[1][-1].stop == 10
