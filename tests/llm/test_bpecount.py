import pytest
from pyspark.sql import functions as F

from foldkeep.llm.bpecount import MergeCounter, count_tokens
from foldkeep.llm.queries import tokenizer

ODD = [None, "", "<|endoftext|>", "a<|endoftext|><|endoftext|> b", "\x1c\x1f x", "I'll DON'T ½ ²³ 日本語  \n\n x\t", "a" * 5000, "   ", "\x85\xa0​", "😀😀 é é", "ab " * 30000]


def library():
    tokenizers = pytest.importorskip("tokenizers")
    return tokenizers.Tokenizer.from_file(tokenizer("byte_bpe_50k.json"))


def test_same_counts_as_the_library_on_odd_texts(spark):
    t = library()
    df = spark.createDataFrame([(i, s, 7) for i, s in enumerate(ODD)] * 2, "doc_id long, text string, n_tokens int")
    got = count_tokens(df, tokenizer("byte_bpe_50k.json")).collect()
    assert len(got) == 2 * len(ODD)
    for r in got:
        s = ODD[r.doc_id] or ""
        assert (r.n_bytes, r.n_tokens) == (len(s.encode()), len(t.encode(s, add_special_tokens=False)))


def test_same_counts_as_the_library_on_documents(spark):
    t = library()
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    got = count_tokens(docs, tokenizer("byte_bpe_50k.json"))
    for r in got.join(docs, "doc_id").collect():
        assert r.n_tokens == len(t.encode(r.text, add_special_tokens=False))


def test_empty_table_and_bounded_memory(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert count_tokens(df, tokenizer("byte_bpe_50k.json")).agg(F.count("*")).first()[0] == 0
    small = MergeCounter(tokenizer("byte_bpe_50k.json"), keep=2)
    full = MergeCounter(tokenizer("byte_bpe_50k.json"))
    text = "one two three one two four five one"
    assert small.count(text) == full.count(text) and len(small.seen) <= 2
