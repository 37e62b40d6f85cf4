"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldkeep.llm.annforest import nearest
from foldkeep.llm.bpecount import count_tokens
from foldkeep.llm.jaccard import jaccard_classes
from foldkeep.llm.langid import fit, fold, identify
from foldkeep.llm.media import media_features, padded, parse_interleaved, resolve, store_media
from foldkeep.llm.mixing import mix
from foldkeep.llm.pieces import decode, encode
from foldkeep.llm.substring import dedup_windows
from foldkeep.llm.toxicity import fit_and_score
from foldkeep.llm.warc import read_warc, write_warc
from foldkeep.session import new_path


def tokenizer(name: str) -> str:
    """The path of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op2_media_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's text is the payload of an image; a page shows the image by its digest."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", F.coalesce("text", F.lit("")).cast("binary").alias("payload"))
    media = media_features(store_media(docs, "payload"))
    pages = docs.select("doc_id", F.octet_length("payload").cast("long").alias("n_bytes"), F.sha2(padded(F.col("payload")), 256).alias("d")).withColumn(
        "html",
        F.concat(
            F.lit("<article><h1>Document "), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit('</h1><figure><img src="sha256:'), "d",
            F.lit('"><figcaption>'), F.col("n_bytes").cast("string"), F.lit(" bytes</figcaption></figure><p>End.</p></article>"),
        ),
    )
    items = parse_interleaved(pages.select("doc_id", "n_bytes", "html")).select("doc_id", "n_bytes", F.explode("items").alias("i"))
    refs = items.where("i.kind = 'media'").select("doc_id", "n_bytes", "i.digest", "i.position", "i.caption")
    return resolve(refs, media).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "position", "caption")


def op3_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    r = read_warc(spark, path)
    number = lambda c: F.regexp_extract(c, r"^<urn:page:(-?\d+)>$", 1)
    as_id = lambda c: F.when(number(c) != "", number(c).cast("long"))
    revisit = F.col("type") == "revisit"
    return r.select(
        as_id("record_id").alias("page_id"),
        F.when(revisit, F.col("declared")).otherwise(F.col("length")).alias("payload_bytes"),
        F.when(revisit, F.col("payload_digest")).otherwise(F.col("sha")).alias("payload_digest"),
        F.col("type").alias("record_type"),
        as_id("refers").alias("refers_to"),
    )


def op4_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest(rows, rows.where(F.col("vec_id") % 100 == 0), k=10)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(fold("doc_id", 5) != 0).select("doc_id", "toxic")
    out = fit_and_score(docs, labels)
    return out.select("doc_id", F.coalesce(fold("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = count_tokens(docs, tokenizer("byte_bpe_50k.json"))
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 1024).alias("over_limit"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_windows(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def op8_piece_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segmentations with a tenth of the merges dropped, decoded again and compared with the texts."""
    path = tokenizer("piece_bpe_32k.model")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", F.col("text").alias("original"))
    ids = encode(docs, path, dropout=0.1, seed=20)
    ids = ids.select("doc_id", "original", "ids", F.size("ids").cast("long").alias("n_tokens"), F.xxhash64("ids").alias("ids_hash"))
    back = decode(ids, path)
    return back.select(
        "doc_id",
        F.coalesce(F.octet_length("original"), F.lit(0)).cast("long").alias("n_bytes"),
        "n_tokens",
        "ids_hash",
        F.sha2("text", 256).alias("decoded_sha256"),
        (F.col("text") == F.coalesce("original", F.lit(""))).alias("lossless"),
    )


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = fit(docs.where(fold("doc_id", 4) != 2))
    out = identify(docs.select("doc_id", F.coalesce(fold("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "text"), model)
    return out.select("doc_id", "held_out", "lang_pred", "score")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_source_mixing": op1_source_mixing,
    "op2_media_sequences": op2_media_sequences,
    "op3_warc_round_trip": op3_warc_round_trip,
    "op4_nearest_vectors": op4_nearest_vectors,
    "op5_toxicity": op5_toxicity,
    "op6_token_counts": op6_token_counts,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_piece_dropout": op8_piece_dropout,
    "op9_jaccard_join": op9_jaccard_join,
    "op10_language_id": op10_language_id,
}

ORACLE_SQL: dict[str, str] = {
    "op3_warc_round_trip": """
WITH p AS (SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first_id FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, payload_bytes, p.payload_digest,
       CASE WHEN first_id < page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first_id < page_id THEN first_id END AS refers_to
FROM p LEFT JOIN f ON p.payload_bytes >= 100 AND p.payload_digest = f.payload_digest
""",
    "op1_source_mixing": r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         (CAST('0x' || substring(md5('17:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0 AS u,
         0.1 + 0.9 * CASE WHEN length(text) > 0 THEN CAST(length(regexp_replace(text, '[^\p{L}]+', '', 'g')) AS DOUBLE) / length(text) ELSE 0.0 END AS q
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][(row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1] AS w FROM s),
r AS (
  SELECT *, CAST(sum(source_size) OVER () AS BIGINT) AS total,
         coalesce(sum(source_size) OVER o, 0) * 3 AS cut, CAST(sum(w) OVER () - coalesce(sum(w) OVER o, 0) AS BIGINT) AS rest
  FROM w WINDOW o AS (ORDER BY CAST(source_size AS DOUBLE) / w, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
v AS (SELECT *, CAST(total - cut AS DOUBLE) / rest AS level FROM r),
x AS (SELECT arg_min(level, CAST(source_size AS DOUBLE) / w) AS level FROM v WHERE level * w <= source_size * 3),
t AS (SELECT source, source_size, least(CAST(source_size * 3 AS DOUBLE), coalesce(x.level * w, CAST(source_size * 3 AS DOUBLE))) AS target FROM v CROSS JOIN x),
b AS (SELECT *, CAST(round(target) AS BIGINT) AS budget FROM t),
e AS (SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS epochs FROM b),
k AS (SELECT d.*, source_size, target, epochs, budget - epochs * source_size AS rest,
             coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY ln(-ln(u)) - ln(q), doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source, source_size, target,
       CAST(epochs * size + greatest(0, least(size, rest - before)) AS BIGINT) AS taken
FROM k
""",
}
