from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from foldkeep.llm.pieces import _UNIT, MARK, Pieces, decode, encode
from foldkeep.llm.queries import op8_piece_dropout, tokenizer

PATH = tokenizer("piece_bpe_32k.model")
ODD = ["", " ", "  Hello  wörld\n\ttab", f"{MARK}x {MARK} {MARK}{MARK}", MARK, "日本 　 ½ ﬁ é", "<s> </s> <0x41>", "a" * 3000, "😀\r\n\x00", "the quick brown fox " * 3000]


def texts(spark):
    return [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]


def test_without_dropout_equals_the_library(spark):
    sp = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=PATH)
    m = Pieces(PATH)
    for t in texts(spark) + [o for o in ODD if MARK not in o]:
        assert m.encode(t).tolist() == sp.encode(t)


@pytest.mark.parametrize("dropout", [0.0, 0.1, 0.5, 1.0])
def test_round_trip_at_any_dropout(spark, dropout):
    m = Pieces(PATH, dropout, seed=3)
    for i, t in enumerate(texts(spark)[:60] + ODD):
        assert m.decode(m.encode(t, i)) == t


def test_dropout_is_seeded_and_varied(spark):
    t = " ".join(texts(spark)[:40])
    a, b, c = Pieces(PATH, 0.1, 1), Pieces(PATH, 0.1, 1), Pieces(PATH, 0.1, 2)
    assert np.array_equal(a.encode(t, 5), b.encode(t, 5))
    assert not np.array_equal(a.encode(t, 5), c.encode(t, 5)) and not np.array_equal(a.encode(t, 5), a.encode(t, 6))
    plain = len(Pieces(PATH).encode(t))
    assert plain < len(a.encode(t, 5)) < len(Pieces(PATH, 0.4, 1).encode(t, 5)) < len(Pieces(PATH, 1.0, 1).encode(t, 5))
    # a skipped candidate stays a symbol of its own: every piece is one of the model's
    assert max(a.encode(t, 5)) < 32000
    forms = [len({tuple(a.encode(w, i)) for i in range(60)}) for w in ("understanding", "segmentation", "regularization", "variety")]
    assert max(forms) > 1


def test_matrices_equal_single_agendas(spark):
    units = sorted({u for t in texts(spark)[:80] + ODD for u in _UNIT.findall(MARK + t.replace(" ", MARK)) if len(u) < 200})
    for dropout in (0.0, 0.15, 0.6):
        m = Pieces(PATH, dropout, 4)
        variant = np.arange(len(units)) % 4
        ids, count = m.join_all(units, variant)
        at = np.cumsum(count) - count
        for u, v, a, n in zip(units, variant.tolist(), at, count, strict=True):
            assert ids[a : a + n].tolist() == m.join(u, v)


def test_dropout_rate_of_single_candidates():
    m = Pieces(PATH, 0.3, 9)
    units = [f"{MARK}{c}" for c in "abcdefghijklmnopqrstuvwxyz"]
    kept = [len(m.join(u, v)) == 1 for u in units for v in range(4)]
    assert 0.5 < np.mean(kept) < 0.9


def test_columns_nulls_and_repeats(spark):
    df = spark.createDataFrame([(1, None, 5), (2, "", 5), (3, "a b", 5), (3, "a b", 5), (None, "a b", 5)], "doc_id long, text string, ids int")
    got = encode(df, PATH, 0.5, 1).collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r.ids)
    assert by[1] == by[2] == [[]] and by[3][0] == by[3][1] and len(by[None]) == 1
    back = decode(encode(df, PATH, 0.5, 1), PATH)
    assert back.columns == ["doc_id", "text"] and {r.text for r in back.collect()} == {"", "a b"}
    assert encode(df.where("false"), PATH).isEmpty()


def test_query_is_lossless(spark):
    got = op8_piece_dropout(spark, "/root/testdata/sf0.001")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert got.where("not lossless").isEmpty() and got.count() == docs.count()
    want = docs.select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("decoded_sha256"))
    assert sorted(got.select("doc_id", "decoded_sha256").collect()) == sorted(want.collect())


def test_every_occurrence_is_drawn_by_itself():
    m = Pieces(PATH, 0.3, 5)
    # pairs of one unit: with one draw for a pair, all are joined or none
    a, plain = m.encode("abab" * 2000, 1).tolist(), Pieces(PATH).encode("abab" * 2000).tolist()
    assert len({tuple(a[i : i + 4]) for i in range(0, len(a), 4)}) > 10 > len(set(plain))
    # occurrences of one unit: more than a few forms, of which the plain one is the most frequent
    forms = Counter(tuple(m.encode("understanding", i)) for i in range(500))
    assert len(forms) > 6 and forms.most_common(1)[0][0] == tuple(Pieces(PATH).encode("understanding").tolist())
    inside = m.encode("understanding " * 300, 1)
    assert m.decode(inside) == "understanding " * 300 and len({m.encode("understanding " * 300, i).tobytes() for i in range(9)}) == 9


def test_single_candidates_keep_the_rate():
    m = Pieces(PATH, 0.1, 6)
    joined = np.mean([len(m.join(f"{MARK}a", k)) == 1 for k in range(4000)])
    assert 0.88 < joined < 0.92
    _, count = m.join_all([f"{MARK}a"] * 4000, np.arange(4000))
    assert np.mean(count == 1) == joined


def test_spaces_and_marks_of_any_number():
    cases = [" " * 39, " " * 40, " " * 41, MARK, f"{MARK}{' ' * 40}{MARK}", f"{MARK}{MARK} {MARK}", f"a{MARK}", f"{MARK * 40}b"]
    for dropout in (0.0, 0.2, 1.0):
        m = Pieces(PATH, dropout, 2)
        flat, count = m.encode_all(cases, list(range(len(cases))))
        assert m.decode_all(flat, count) == cases


def test_columns_of_any_name_pass_through(spark):
    df = spark.createDataFrame([(1, "a b", 5, "x")], "doc_id long, text string, `_text` int, `_id` string")
    got = decode(encode(df, PATH), PATH)
    assert got.first().asDict() == {"doc_id": 1, "_text": 5, "_id": "x", "text": "a b"}
