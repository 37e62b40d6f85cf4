import math

from pyspark.sql import functions as F

from foldkeep.llm.mixing import mix, mixed_rows, plan_targets, word_count

SCHEMA = "doc_id long, text string, source string, target int"


def rows(spark, data):
    return mix(spark.createDataFrame(data, SCHEMA)).collect()


def reshared(sizes, weights=(5, 2, 1), most=3):
    """Targets by resharing the excess again and again, as the rule is told."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), set()
    while True:
        free = [s for s in order if s not in capped]
        level = (total - sum(most * sizes[s] for s in capped)) / max(1, sum(w[s] for s in free))
        over = [s for s in free if level * w[s] > most * sizes[s]]
        if not over:
            return {s: most * sizes[s] if s in capped else level * w[s] for s in order}
        capped |= set(over)


def test_targets_equal_repeated_resharing(spark):
    for sizes in ({"a": 10, "b": 1000, "c": 400, "d": 3, None: 77}, {"a": 0, "b": 5}, {"a": 1, "b": 1, "c": 1000000}, {"x": 9}):
        df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        got = {r.source: r.target for r in plan_targets(df).collect()}
        want = reshared(sizes)
        assert got.keys() == want.keys() and all(math.isclose(got[s], want[s]) for s in want)


def test_budgets_epochs_and_reruns(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = mix(docs)
    again = mix(docs.repartition(7))
    assert sorted(got.collect()) == sorted(again.collect())
    for r in got.groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("g")).collect():
        assert abs(r.t - r.g) <= 0.5 + 1e-9
    assert got.where("taken > 3 * size or taken < 0").isEmpty()
    # whole epochs come before the selection: within a source, epochs differ by one at most
    e = got.where("size > 0").groupBy("source").agg(F.min(F.expr("taken div size")).alias("a"), F.max(F.expr("taken div size")).alias("b"))
    assert e.where("b - a > 1").isEmpty()


def test_nulls_empty_ties_and_repeated_rows(spark):
    data = [(1, "a b c", "s", 0), (1, "a b c", "s", 0), (2, None, None, 0), (3, "", None, 0), (None, "x y", None, 0), (4, " \t\n", "t", 0), (5, "w " * 50000, "u", 0)]
    got = rows(spark, data)
    assert len(got) == len(data)
    by = {(r.doc_id, r.source): r for r in got}
    assert by[(2, None)].size == 0 and by[(2, None)].taken == 0 and by[(5, "u")].size == 50000
    for s in {r.source for r in got}:
        own = [r for r in got if r.source == s]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 0.5


def test_empty_table(spark):
    assert rows(spark, []) == []


def test_mixed_rows_hold_the_words_taken(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    m = mix(docs)
    out = mixed_rows(docs, m)
    assert out.columns == docs.columns
    want = {r.doc_id: r.taken for r in m.where("taken > 0").collect()}
    got = {r.doc_id: r.n for r in out.groupBy("doc_id").agg(F.sum(word_count("text")).alias("n")).collect()}
    assert got == want


def test_columns_with_clashing_names(spark):
    docs = spark.createDataFrame([(1, "a b c", "s", 9, 9, 9), (2, "d e", "t", 9, 9, 9)], "doc_id long, text string, source string, size int, taken int, target int")
    assert mix(docs).count() == 2 and mixed_rows(docs, mix(docs)).columns == docs.columns


def test_heavier_documents_are_taken_more_often(spark):
    n = 4000
    data = spark.range(n).select(F.col("id").alias("doc_id"), F.lit("w").alias("text"), F.lit("c").alias("source"))
    data = data.union(spark.range(n, 20 * n).select("id", F.lit("w"), F.lit("a")))
    q = F.when(F.col("doc_id") % 2 == 0, 1.0).otherwise(0.25)
    got = mix(data, quality=q, weights=(8, 1)).where("source = 'c'").groupBy((F.col("doc_id") % 2).alias("odd")).agg(F.sum("taken").alias("t"))
    t = {r.odd: r.t for r in got.collect()}
    assert t[0] > 1.0 * t[1]
