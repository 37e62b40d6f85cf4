from collections import Counter

import pytest

import corpus_pipeline as cp
from foldkeep.llm.langid import fit, fold
from foldkeep.llm.mixing import mix
from foldkeep.llm.pieces import Pieces
from foldkeep.llm.queries import tokenizer
from foldkeep.session import materialize
from tests.llm.test_jaccard import brute as brute_classes
from tests.llm.test_substring import brute as brute_windows

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(spark):
    """The documents and what each stage made of them."""
    out = [spark.read.parquet(f"{SF}/documents.parquet")]
    for k, (_, stage) in enumerate(cp.STAGES):
        out.append(materialize(stage(spark, out[-1], SF), f"test-{k}"))
    return out


def test_stages_and_columns(tables):
    assert len(cp.STAGES) == 5
    for t in tables[:-1]:
        assert t.columns == list(cp.COLUMNS) and [f.dataType for f in t.schema] == [f.dataType for f in tables[0].schema]


def test_language_id(spark, tables):
    model = fit(tables[0].where(fold("doc_id", 4) != 2))
    rows = tables[0].collect()
    names, _, sure = model.predict([r.text for r in rows])
    want = {r.doc_id for r, n, s in zip(rows, names, sure, strict=True) if n != "und" and s >= cp.LEAST_CERTAINTY}
    assert {r.doc_id for r in tables[1].collect()} == want and len(want) > 0.95 * len(rows)


def test_near_duplicates(tables):
    rows = [(r.doc_id, r.text) for r in tables[1].collect()]
    want = {i for i, (c, _) in brute_classes(rows).items() if i == c}
    got = tables[2].collect()
    assert sorted(r.doc_id for r in got) == sorted(want) and len(want) < len(rows)


def test_substring_dedup(tables):
    rows = {r.doc_id: r.text for r in tables[2].collect()}
    want = brute_windows(list(rows.items()), 20)
    for r in tables[3].collect():
        _, gone, _, kept = want[r.doc_id]
        assert r.text == (kept if gone else rows[r.doc_id]) and r.n_chars == len(r.text)


def test_mixing(tables):
    texts = {r.doc_id: r.text for r in tables[3].collect()}
    taken = {r.doc_id: r.taken for r in mix(tables[3]).collect()}
    got, words = Counter(), Counter()
    for r in tables[4].collect():
        assert texts[r.doc_id].startswith(r.text)
        got[r.doc_id] += 1
        words[r.doc_id] += len(r.text.split())
    assert {i: n for i, n in taken.items() if n} == dict(words)
    assert any(n > 1 for n in got.values())


def test_identifiers(tables):
    m = Pieces(tokenizer("piece_bpe_32k.model"))
    want = Counter((r.doc_id, r.text) for r in tables[4].collect())
    assert Counter((r.doc_id, m.decode(r.ids)) for r in tables[5].collect()) == want
    assert tables[5].where("n_tokens <> size(ids)").isEmpty()


def test_run_is_the_stages_in_turn(spark, tables):
    key = lambda df: sorted((r.doc_id, tuple(r.ids)) for r in df.collect())
    assert key(cp.run(spark, SF)) == key(tables[5])


def test_empty_and_odd_documents(spark):
    df = spark.createDataFrame([(1, None, None, None, None), (2, "", "en", "s", 0), (3, "12 34", "en", "s", 5), (4, "the quick fox", "en", None, 13), (4, "the quick fox", "en", None, 13), (5, "der rote Fuchs", "de", "s", 14)], tables_schema())
    for docs in (df, df.where("false")):
        for _, stage in cp.STAGES:
            docs = materialize(stage(spark, docs, SF), "test-odd")
        ids = sorted({r.doc_id for r in docs.collect()})
        assert ids in ([4, 5], [])


def test_rows_without_or_with_shared_identifiers_are_told_apart(spark):
    long = lambda w: " ".join(f"{w}{i}" for i in range(40))
    rows = [(1, long("a")), (None, long("a")), (None, long("b")), (None, long("b")), (None, long("c")), (7, long("d")), (7, long("e")), (7, long("e")), (8, long("e") + " more"), (None, ""), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], tables_schema())
    left = materialize(cp.near_duplicates(spark, docs, SF), "test-shared")
    want = [(1, long("a")), (None, long("b")), (None, long("c")), (7, long("d")), (7, long("e")), (None, ""), (None, None)]
    assert Counter((r.doc_id, r.text) for r in left.collect()) == Counter(want)
    # and no later stage takes one for the other: a mix of one source has each of its documents once
    mixed = cp.source_mixing(spark, cp.substring_dedup(spark, left, SF), SF)
    assert Counter((r.doc_id, r.text) for r in mixed.collect()) == Counter((i, t) for i, t in want if t)
    # rows that only became equal share what they take
    twice = spark.createDataFrame([(None, "x y z", "en", "s", 5)] * 2 + [(None, "x y z", "en", "t", 5), (3, "u v", "en", "s", 3)], tables_schema())
    words = mix(twice).groupBy("source").agg({"taken": "sum"}).collect()
    got = Counter()
    for r in cp.source_mixing(spark, twice, SF).collect():
        got[r.source] += len(r.text.split())
    assert dict(got) == {r[0]: r[1] for r in words if r[1]}


def tables_schema():
    return "doc_id long, text string, lang string, source string, n_chars long"


def test_language_stage_keeps_mixed_texts_and_works_without_labels(spark):
    three = "the of and with that this " * 5 + "der die und nicht das von " * 5 + "el los que por para una " * 5
    docs = spark.read.parquet(f"{SF}/documents.parquet").select(*cp.COLUMNS)
    odd = spark.createDataFrame([(-5, three, None, None, 1), (-6, "12 34", "en", None, 1)], tables_schema())
    kept = {r.doc_id for r in cp.language_id(spark, docs.unionByName(odd), SF).select("doc_id").collect()}
    assert -5 in kept and -6 not in kept
    bare = spark.createDataFrame([(1, "a b", None, "s", 3), (2, "12", None, "s", 2), (3, None, None, "s", 0)], tables_schema())
    assert [r.doc_id for r in cp.language_id(spark, bare, SF).collect()] == [1]
