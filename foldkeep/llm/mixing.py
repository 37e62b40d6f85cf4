"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame operations only.

Every document gets an exponential key ``-ln(u) / q``, where ``u`` is a keyed
hash of its identifier and ``q`` its quality weight; within a source documents
are taken in ascending key order (which is weighted sampling without
replacement) until the source's budget of words is used. A budget above the
source's size gives whole epochs first, and the rest by the fractional
selection; the document at which the budget ends gives its first words only,
so that each source meets its target to the word.

Scale: the prefix sum is never taken over a whole source. Keys fall into narrow
classes of ``ln(key)``, which has a Gumbel distribution, so that no class holds
more than a fixed small share of any source. Sizes are summed by class, the
class in which the budget ends is found from those sums, and only its rows are
sorted. The table of sources has a row a source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldkeep.session import materialize

#: Words of a text: runs of anything but the ASCII white space characters.
WORD = r"[^\x20\x09-\x0D]+"

#: Classes of ln(key) a unit; a class holds at most exp(-1) / CLASSES of a source's rows.
CLASSES = 256

#: Weights that sources get in turn, and the most epochs of one source.
WEIGHTS = (5, 2, 1)
MOST_EPOCHS = 3


def word_count(text: str | Column) -> Column:
    """Number of words of a text (null: 0)."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def letter_share(text: str | Column) -> Column:
    """A quality weight from 0.1 to 1: the share of letters among the characters (null or empty: 0.1)."""
    text = F.col(text) if isinstance(text, str) else text
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]+", ""))
    share = F.when(F.length(text) > 0, letters / F.length(text)).otherwise(0.0)
    return F.lit(0.1) + F.lit(0.9) * F.coalesce(share, F.lit(0.0))


def uniform(seed: int, *cols: Column) -> Column:
    """A number between 0 and 1 (both exclusive) by a keyed hash of the columns; 52 bits of an MD5 sum."""
    parts = [F.coalesce(c.cast("string"), F.lit("null")) for c in cols]
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), *parts).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(2**52)


def plan_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_EPOCHS) -> DataFrame:
    """Targets of sources: ``(source, source_size)`` to the same and ``target``.

    Sources in code point order, null last, weigh ``weights`` in turn and share
    the sum of all sizes. No target is above ``most`` times its source's size;
    what is cut there goes to the others by weight, until none is above. This
    is the level ``x`` with ``sum(min(x * weight, most * size)) = sum(size)``,
    found from prefix sums over the sources ordered by ``size / weight``.
    """
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    pick = F.element_at(F.array(*[F.lit(w) for w in weights]), (turn % len(weights) + 1).cast("int"))
    by_ratio = Window.orderBy((F.col("source_size") / F.col("w")).asc(), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    s = (
        sizes.withColumn("w", pick.cast("long"))
        .withColumn("full", F.coalesce(F.sum("source_size").over(before), F.lit(0)) * most)
        .withColumn("rest", F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0)))
        .withColumn("total", F.sum("source_size").over(everything))
        .withColumn("level", (F.col("total") - F.col("full")).cast("double") / F.col("rest"))
        .withColumn("open", F.col("level") * F.col("w") <= F.col("source_size") * most)
        .withColumn("level", F.min(F.when(F.col("open"), F.struct(F.col("source_size") / F.col("w"), "level"))).over(everything)["level"])
    )
    cap = (F.col("source_size") * most).cast("double")
    return s.select("source", "source_size", F.least(cap, F.coalesce(F.col("level") * F.col("w"), cap)).alias("target"))


def mix(
    docs: DataFrame,
    seed: int = 17,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    quality: Column | None = None,
    weights: tuple[int, ...] = WEIGHTS,
    most: int = MOST_EPOCHS,
    broadcast_rows: int = 100_000,
    tie: bool = False,
) -> DataFrame:
    """Per row of ``docs``: ``doc_id, size, source, source_size, target, taken``, and ``tie`` (of text and source) if asked for.

    ``taken`` is the number of the row's words in the mix, whole epochs
    included; the sum over a source is its target rounded to a whole number.
    Null and empty texts have size 0 and nothing taken. A null source is a
    source of its own. Rows that repeat a doc_id are separate documents; ties of
    keys go by doc_id and a hash of the text, and rows that are equal in all of
    these share alike up to their order. An empty table gives an empty result.
    ``quality`` must be positive; ``letter_share`` of the text where not given.
    The table of sources is broadcast if it has ``broadcast_rows`` rows at most,
    else joined by shuffle.
    """
    q = letter_share(text) if quality is None else quality
    u = uniform(seed, F.col(doc_id))
    key = F.log(-F.log(u)) - F.log(q)
    slim = materialize(
        docs.select(
            F.col(doc_id).alias("doc_id"),
            F.col(source).alias("source"),
            word_count(text).alias("size"),
            key.alias("k"),
            F.xxhash64(text).alias("tie"),
        ).withColumn("class", F.floor(F.col("k") * CLASSES).cast("int")),
        "mix-keys",
    )
    classes = materialize(slim.groupBy("source", "class").agg(F.sum("size").alias("words")), "mix-classes")
    plan = plan_targets(classes.groupBy("source").agg(F.sum("words").alias("source_size")), weights, most)
    plan = (
        plan.withColumn("budget", F.round("target").cast("long"))
        .withColumn("epochs", F.when(F.col("source_size") > 0, F.expr("budget div source_size")).otherwise(F.lit(0)).cast("long"))
        .withColumn("left", F.when(F.col("source_size") > 0, F.col("budget") - F.col("epochs") * F.col("source_size")).otherwise(F.lit(0)))
    )
    upto = Window.partitionBy("source").orderBy("class").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = classes.withColumn("after", F.sum("words").over(upto)).withColumn("before", F.col("after") - F.col("words"))
    p, e = plan.alias("p"), ends.alias("e")
    border = (
        p.join(e, F.col("p.source").eqNullSafe(F.col("e.source")) & (F.col("left") >= F.col("before")) & (F.col("left") < F.col("after")), "left")
        .select("p.source", "source_size", "target", "epochs", "left", F.col("class").alias("at"), F.coalesce("before", F.lit(0)).alias("before"))
    )
    border = materialize(border.withColumnRenamed("source", "its"), "mix-plan")
    if border.count() <= broadcast_rows:
        border = F.broadcast(border)
    rows = slim.join(border, F.col("source").eqNullSafe(F.col("its"))).drop("its")
    out = lambda df, part: df.select(
        "doc_id", "size", "source", "source_size", "target", (F.col("epochs") * F.col("size") + part).cast("long").alias("taken"), *([F.xxhash64("tie", "source").alias("tie")] if tie else [])
    )
    inside = rows.where(F.col("class") == F.col("at"))
    outside = rows.where(F.col("at").isNull() | (F.col("class") != F.col("at")))
    order = Window.partitionBy("source").orderBy("k", "doc_id", "tie").rowsBetween(Window.unboundedPreceding, -1)
    inside = inside.withColumn("before", F.col("before") + F.coalesce(F.sum("size").over(order), F.lit(0)))
    cut = F.greatest(F.lit(0), F.least(F.col("size"), F.col("left") - F.col("before")))
    whole = F.when(F.col("class") < F.col("at"), F.col("size")).otherwise(F.lit(0))
    return out(inside, cut).unionByName(out(outside, whole))


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its ``n``-th word, unchanged (0: empty)."""
    words = F.regexp_extract_all(text, F.lit(r"([\x20\x09-\x0D]*[^\x20\x09-\x0D]+)"), 1)
    return F.array_join(F.slice(words, F.lit(1), n.cast("int")), "")


def mixed_rows(docs: DataFrame, mixed: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The mix itself: each document's row once an epoch, and its first words where the budget ends inside it.

    ``mixed`` is the result of ``mix`` for the same ``docs``; ``doc_id`` must be unique here, or with it the ``tie`` that ``mixed`` has.
    """
    tied = "tie" in mixed.columns
    m = mixed.select(F.col("doc_id").alias("_id"), F.col("size").alias("_size"), F.col("taken").alias("_taken"), *([F.col("tie").alias("_tie")] if tied else []))
    same = F.col(doc_id).eqNullSafe(F.col("_id"))
    if tied:
        same = same & (F.xxhash64(F.xxhash64(text), F.col(source)) == F.col("_tie"))
    whole, part = F.expr("_taken div greatest(_size, 1)"), F.expr("_taken % greatest(_size, 1)")
    rows = (
        docs.join(m, same)
        .where(F.col("_taken") > 0)
        .withColumn("_copy", F.explode(F.sequence(F.lit(1), (whole + F.when(part > 0, 1).otherwise(0)).cast("int"))))
    )
    cut = F.when(F.col("_copy") > whole, first_words(F.col(text), part)).otherwise(F.col(text))
    return rows.withColumn(text, cut).select(*docs.columns)
