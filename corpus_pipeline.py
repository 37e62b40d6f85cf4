"""From raw documents to token identifiers: five stages, each a table of its own.

1. language ID: documents without a language, or of none surely, go;
2. n-gram Jaccard join: one document of each group of near copies stays;
3. substring dedup: word windows that an earlier document holds are cut out;
4. mixing: sources are sampled and repeated up to their target sizes;
5. SentencePiece: texts become identifiers, with seeded merge-dropout.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldkeep.llm.jaccard import jaccard_rows
from foldkeep.llm.langid import UNKNOWN, fit, fold, identify
from foldkeep.llm.mixing import mix, mixed_rows
from foldkeep.llm.pieces import encode
from foldkeep.llm.queries import tokenizer
from foldkeep.llm.substring import dedup_windows
from foldkeep.session import materialize

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")

#: A document goes if its words' languages are less certain than this on average; a text that mixes languages clearly stays.
LEAST_CERTAINTY = 0.4
#: Keys are broadcast up to this number of rows.
BROADCAST_ROWS = 1_000_000
DROPOUT, SEED = 0.1, 20


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = docs.select(*COLUMNS)
    model = fit(docs.where(fold("doc_id", 4) != 2))
    if not model.labels:  # nothing to judge by: texts without letters go, all others stay
        return docs.where(F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    seen = identify(docs, model, lang_pred="_lang", score="_score", certainty="_sure")
    return seen.where((F.col("_lang") != UNKNOWN) & (F.col("_sure") >= LEAST_CERTAINTY)).select(*COLUMNS)


def once(docs: DataFrame, *keys: str) -> DataFrame:
    """One row of those with equal keys, the smallest by the other columns."""
    rest = [c for c in COLUMNS if c not in keys]
    return docs.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("_rest")).select(*keys, "_rest.*").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id (null last) of each group stays; of rows that repeat doc_id and text, one does."""
    rows = materialize(jaccard_rows(docs).select("doc_id", "tie", "stays"), "pipeline-classes")
    gone = rows.where(~F.col("stays")).select(F.col("doc_id").alias("_gone"), F.col("tie").alias("_tie")).distinct()
    if gone.count() <= BROADCAST_ROWS:
        gone = F.broadcast(gone)
    left = docs.join(gone, F.col("doc_id").eqNullSafe(F.col("_gone")) & (F.xxhash64("text") == F.col("_tie")), "left_anti").select(*COLUMNS)
    if not rows.where("stays").groupBy("doc_id", "tie").count().where("count > 1").isEmpty():
        left = once(left, "doc_id", "text")
    return left


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = dedup_windows(docs.select(*COLUMNS), kept="_kept")
    return out.select("doc_id", F.col("_kept").alias("text"), "lang", "source", F.length("_kept").cast("long").alias("n_chars"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # rows that are equal in doc_id, source and text share what they take
    each = mix(docs, tie=True).groupBy("doc_id", "tie").agg(F.max("size").alias("size"), F.sum("taken").alias("taken"), F.count("*").alias("n"))
    taken = materialize(each, "pipeline-mix")
    docs = docs.select(*COLUMNS)
    if not taken.where("n > 1").isEmpty():
        docs = once(docs, "doc_id", "source", "text")
    taken = taken.drop("n")
    if taken.count() <= BROADCAST_ROWS:
        taken = F.broadcast(taken)
    out = mixed_rows(docs, taken)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ids = encode(docs.select("doc_id", "text", "lang", "source"), tokenizer("piece_bpe_32k.model"), dropout=DROPOUT, seed=SEED)
    return ids.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("language ID", language_id),
    ("n-gram Jaccard join", near_duplicates),
    ("substring dedup", substring_dedup),
    ("mixing sources to target weights", source_mixing),
    ("SentencePiece encoding", sentencepiece),
]

#: Several stages can't be said in SQL; tests hold the result against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialize(docs, f"pipeline-{k}")
    return docs
