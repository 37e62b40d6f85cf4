"""WARC archives: writing with revisit records, and reading by verified record boundaries.

Reading doesn't trust the magic. Tasks read byte ranges of the files (Spark's
text source splits at the magic, so a range may begin anywhere) and emit for
each occurrence of the magic a candidate: its offset, and the offset at which
its record would end by its header. The file's first candidate is a record for
certain, and so is each successor of a record; pointer jumping from the file's
start keeps what is reachable and rejects a magic inside a payload. Candidates
that follow each other without a gap inside one range form runs, and only
entries into runs take part in the jumps: their number is that of ranges and
of false candidates, not of records, and a chain of n entries needs log2(n)
rounds.
"""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foldkeep.session import lean, materialize

# Fixed values of the WARC format.
MAGIC = "WARC/1.1\r\n"
END = "\r\n\r\n"

#: Payloads smaller than this are always stored whole.
LEAST_REVISIT = 100


def first_pages(rows: DataFrame, page_id: str, payload: str, least: int = LEAST_REVISIT) -> DataFrame:
    """``digest, first``: the smallest ``page_id`` of each payload of ``least`` bytes or more that several rows have (a row a digest).

    Counts by digest are aggregated before the shuffle.
    """
    d = rows.where(F.octet_length(payload) >= least).select(F.col(page_id).alias("page_id"), F.sha2(payload, 256).alias("digest"))
    return d.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null").drop("n")


def record_of(page_id: Column, url: Column, payload: Column, refers_to: Column) -> Column:
    """One record as text, without the two line ends that close it."""
    digest = F.sha2(payload, 256)
    no_breaks = F.regexp_replace(F.coalesce(url, F.lit("")), r"[\x00-\x1f\x7f]+", " ")
    revisit = refers_to.isNotNull()
    body = F.when(revisit, F.lit("")).otherwise(payload.cast("string"))
    name = lambda i: F.concat(F.lit("<urn:page:"), F.coalesce(i.cast("string"), F.lit("null")), F.lit(">\r\n"))
    return F.concat(
        F.lit(MAGIC + "WARC-Type: "), F.when(revisit, "revisit").otherwise("response"), F.lit("\r\nWARC-Record-ID: "), name(page_id),
        F.lit("WARC-Date: 1970-01-01T00:00:00Z\r\nWARC-Target-URI: "), no_breaks, F.lit("\r\nWARC-Payload-Digest: sha256:"), digest,
        F.lit("\r\nWARC-Payload-Length: "), F.octet_length(payload).cast("string"), F.lit("\r\n"),
        F.when(revisit, F.concat(F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: "), name(refers_to))).otherwise(F.lit("")),
        F.lit("Content-Type: text/html\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit(END), body,
    )


def write_warc(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html", broadcast_rows: int = 500_000) -> None:
    """Write a record per row of ``pages`` as WARC files under ``path``, by Spark's own writer.

    Null payloads are empty. Of records with equal payloads of 100 bytes or more
    that with the smallest ``page_id`` is the response, and the others are
    revisits without a body that name it; a null ``page_id`` is never the
    smallest. Every row has one record: rows that share the smallest ``page_id``
    are all responses, and where all of a payload's are null, so are these. An
    empty table gives files without records. Rows find their response by digest,
    by broadcast if there are ``broadcast_rows`` of these at most, else by shuffle.
    """
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).cast("binary").alias("payload"))
    first = materialize(first_pages(rows, "page_id", "payload"), "warc-first")
    if first.count() <= broadcast_rows:
        first = F.broadcast(first)
    rows = rows.join(first, F.sha2("payload", 256) == F.col("digest"), "left")
    refers = F.when(F.col("page_id").isNull() | (F.col("page_id") > F.col("first")), F.col("first"))
    rows.select(record_of(F.col("page_id"), F.col("url"), F.col("payload"), refers)).write.option("lineSep", END).text(path)


PIECE = "file string, block long, idx int, size long, magic int, head int, length long, type string, record_id string, target string, digest string, declared long, refers string, sha string"


def _pieces(batches: Iterator[pa.RecordBatch], magic: int) -> Iterator[pa.RecordBatch]:
    """For each text between two magics: its size and, if it begins with a header, what that says."""
    names = [f.split()[0] for f in PIECE.split(", ")]
    at, idx = None, 0
    for b in batches:
        out: dict[str, list] = {c: [] for c in names}
        for file, block, value in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
            idx, at = (idx + 1 if at == (file, block) else 0), (file, block)
            end = value.find(b"\r\n\r\n")
            fields: dict[str, str] = {}
            if end >= 0:
                for line in value[:end].split(b"\r\n"):
                    k, colon, v = line.partition(b":")
                    if colon:
                        fields.setdefault(k.strip().lower().decode("utf-8", "replace"), v.strip().decode("utf-8", "replace"))
            said = fields.get("content-length", "")
            good = end >= 0 and "warc-type" in fields and said.isascii() and said.isdigit() and len(said) < 16
            length = int(said) if good else None
            body = end + 4
            whole = good and body + length <= len(value)
            own = fields.get("warc-payload-length", "")
            found = (
                file, block, idx, len(value), magic, body if good else None, length, fields.get("warc-type") if good else None, fields.get("warc-record-id"),
                fields.get("warc-target-uri"), fields.get("warc-payload-digest"), int(own) if own.isascii() and own.isdigit() else None, fields.get("warc-refers-to"),
                hashlib.sha256(value[body : body + length]).hexdigest() if whole else None,
            )
            for c, v in zip(names, found, strict=True):
                out[c].append(v)
        schema = pa.schema([(f.split()[0], {"string": pa.string(), "long": pa.int64(), "int": pa.int32()}[f.split()[1]]) for f in PIECE.split(", ")])
        yield pa.RecordBatch.from_pydict(out, schema=schema)


def _scan(spark: SparkSession, path: str, magic: str) -> DataFrame:
    """The texts between magics in file order, with the range that they were read from."""
    raw = spark.read.option("lineSep", magic).text(path)
    return raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("value"))


def located(p: DataFrame, magic: int) -> DataFrame:
    """Pieces with their ``offset``, that of the magic before them.

    Offsets are sums of sizes of one and the same scan, which is why ``p`` must
    be a written table: within a range by a window over that range alone, and
    over the ranges of a file from one row a range.
    """
    upto = Window.partitionBy("file", "block").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    blocks = p.groupBy("file", "block").agg(F.sum(F.col("size") + magic).alias("bytes"))
    start = F.coalesce(F.sum("bytes").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = blocks.select("file", "block", start.alias("start"))
    p = p.withColumn("within", F.coalesce(F.sum(F.col("size") + magic).over(upto), F.lit(0))).join(blocks, ["file", "block"])
    # what stands before a file's first magic has offset -1 times the magic's length, and is no candidate
    return p.withColumn("offset", F.col("start") + F.col("within") - magic).where("offset >= 0").drop("start", "within")


def candidates(spark: SparkSession, path: str, magic: str = MAGIC) -> DataFrame:
    """One row per occurrence of the magic: ``PIECE``, its ``offset``, and ``next``, where its record's successor would begin (null: no valid header)."""
    n = len(magic)
    p = materialize(_scan(spark, path, magic).mapInArrow(lean(lambda b: _pieces(b, n)), PIECE), "warc-pieces")
    return located(p, n).withColumn("next", F.col("offset") + n + F.col("head") + F.col("length") + len(END))


def reachable(c: DataFrame) -> DataFrame:
    """The candidates that are records: those on the chain from their file's offset 0."""
    rng = Window.partitionBy("file", "block").orderBy("offset")
    breaks = F.coalesce((F.lag("next").over(rng) != F.col("offset")) | F.lag("next").over(rng).isNull(), F.lit(True))
    c = c.withColumn("run", F.sum(breaks.cast("int")).over(rng.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    c = materialize(c, "warc-candidates")
    in_run = ["file", "block", "run"]
    runs = c.groupBy(*in_run).agg(F.max_by("next", "offset").alias("exit"))
    place = c.select("file", "offset", *in_run[1:])
    # entries: where a run's exit leads, and the start of each file; "to" is the exit of the entry's own run
    entry = runs.where("exit is not null").select("file", F.col("exit").alias("offset")).union(place.where("offset = 0").select("file", "offset")).distinct()
    entry = entry.join(place, ["file", "offset"]).join(runs, in_run).select("file", "offset", F.col("exit").alias("to"), (F.col("offset") == 0).alias("seen"))
    entry = materialize(entry, "warc-entries")
    while True:
        hop = entry.select("file", F.col("offset").alias("to"), F.col("to").alias("then"))
        told = entry.where("seen").select("file", F.col("to").alias("offset")).where("offset is not null").distinct().withColumn("told", F.lit(True))
        after = (
            entry.join(hop, ["file", "to"], "left").join(told, ["file", "offset"], "left")
            .select("file", "offset", F.col("then").alias("to"), (F.col("seen") | F.coalesce("told", F.lit(False))).alias("seen"))
        )
        entry = materialize(after, "warc-entries")
        if entry.where("seen and to is not null").isEmpty():
            break
    first = entry.where("seen").join(place, ["file", "offset"]).groupBy(*in_run).agg(F.min("offset").alias("from"))
    return c.join(first, in_run).where(F.col("offset") >= F.col("from")).drop("run", "from")


TEXT = "file string, block long, idx int, size long, value binary"


def _near(batches: Iterator[pa.RecordBatch], magic: int, spans: dict[str, tuple[list[int], list[int], int]] | None) -> Iterator[pa.RecordBatch]:
    """Every piece's size, and the texts of those that may lie in one of the spans (all texts, if no spans are given).

    Spans are starts and ends by file, disjoint and ascending, with the size of
    the file's largest piece: a range's first piece begins after the range by no
    more than that, so a piece's offset is known up to as much here.
    """
    kind = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    schema = pa.schema([(f.split()[0], kind[f.split()[1]]) for f in TEXT.split(", ")])
    at, idx, low = None, 0, 0
    for b in batches:
        out: dict[str, list] = {c: [] for c in schema.names}
        for file, block, value in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
            if at != (file, block):
                at, idx, low = (file, block), -1, block - 2 * magic
            idx += 1
            high = low + len(value) + 4 * magic
            keep = spans is None
            if not keep and file in spans:
                starts, ends, largest = spans[file]
                k = bisect.bisect_left(ends, low)
                keep = k < len(starts) and starts[k] <= high + largest
            low += len(value) + magic
            for c, v in zip(schema.names, (file, block, idx, len(value), value if keep else None), strict=True):
                out[c].append(v)
        yield pa.RecordBatch.from_pydict(out, schema=schema)


def read_warc(spark: SparkSession, path: str, magic: str = MAGIC, payload: bool = False, broadcast_rows: int = 100_000) -> DataFrame:
    """The records of uncompressed WARC files: ``file, offset, type, record_id, target, length, payload_digest, declared, refers, sha`` and, if asked for, ``payload``.

    ``sha`` is the SHA-256 of the body as read, also of bodies that hold the
    magic and so came in several pieces: those are put together in a second
    pass, from these records' pieces alone, found by their offsets. Headers and
    payloads may have any length; each is held by one task as a whole. A record
    whose end lies past the file's end (a torn tail) is dropped, as is everything
    after it; a record inside its file whose body isn't found is an error.
    """
    n = len(magic)
    found = materialize(candidates(spark, path, magic), "warc-located")
    r = materialize(reachable(found), "warc-records")
    names = ["file", "offset", "type", "record_id", "target", "length", F.regexp_replace("digest", "^sha256:", "").alias("payload_digest"), "declared", "refers", "sha"]
    wanted = r if payload else r.where("sha is null")
    if not payload and wanted.isEmpty():
        return r.select(*names)
    ends = found.groupBy("file").agg(F.max(F.col("offset") + n + F.col("size")).alias("bytes"), F.max("size").alias("largest"))
    ask = wanted.join(ends, "file").where(F.col("offset") + n + F.col("head") + F.col("length") <= F.col("bytes"))
    ask = materialize(ask.select("file", F.col("offset").alias("from"), F.col("next").alias("upto"), "head", "length", "largest"), "warc-wanted")
    spans = None
    if not payload and ask.count() <= broadcast_rows:
        spans = {}
        for x in ask.orderBy("file", "from").toLocalIterator():
            own = spans.setdefault(x["file"], ([], [], x["largest"]))
            own[0].append(x["from"])
            own[1].append(x["upto"])
    shared = spark.sparkContext.broadcast(spans)
    texts = materialize(_scan(spark, path, magic).mapInArrow(lean(lambda b: _near(b, n, shared.value)), TEXT), "warc-texts")
    # a piece belongs to the record whose span holds its offset: found by a window over the file's order, not by a range join
    marks = located(texts, n).where("value is not null").select("file", "offset", "value", F.lit(None).cast("long").alias("from"))
    marks = marks.unionByName(ask.select("file", F.col("from").alias("offset"), F.lit(None).cast("binary").alias("value"), "from"))
    order = Window.partitionBy("file").orderBy("offset", F.col("from").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    owned = marks.withColumn("from", F.last("from", ignorenulls=True).over(order)).where("value is not null and from is not null").join(ask, ["file", "from"]).where(F.col("offset") < F.col("upto"))
    parts = owned.groupBy("file", "from").agg(F.sort_array(F.collect_list(F.struct("offset", "value"))).alias("v"), F.first("head").alias("head"), F.first("length").alias("n"))
    glued = F.array_join(F.transform("v", lambda x: F.hex(x["value"])), "".join(f"{b:02X}" for b in magic.encode()))
    whole = parts.select("file", F.col("from").alias("offset"), "head", "n", F.unhex(glued).alias("all")).where(F.octet_length("all") >= F.col("head") + F.col("n"))
    whole = whole.select("file", "offset", F.substring(F.col("all"), F.col("head") + 1, F.col("n").cast("int")).alias("payload"))
    whole = whole.withColumn("again", F.sha2("payload", 256))
    asked = ask.select("file", F.col("from").alias("offset"), F.lit(True).alias("asked"))
    out = r.select(*names).join(asked, ["file", "offset"], "left").join(whole if payload else whole.drop("payload"), ["file", "offset"], "left")
    lost = F.raise_error(F.concat(F.lit("no body was found for the record at "), F.col("offset").cast("string"), F.lit(" of "), F.col("file")))
    sha = F.when(F.col("asked") & F.col("again").isNull(), lost).otherwise(F.coalesce("again", "sha"))
    return out.withColumn("sha", sha).drop("again", "asked").where("sha is not null")
