"""Interleaved document sequences: ordered text and media of HTML pages, with media held by digest.

Three parts. ``store_media`` packs byte payloads as 8-bit gray images (binary
PGM, 24 samples a row), without loss; the images are columns of a written
table, one a digest. ``parse_interleaved`` turns HTML into an ordered array of
structs, texts and media references with their captions, positions counted in
document order. ``resolve`` joins references to media by digest and keeps
position and caption with them; a payload travels only if it is asked for.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldkeep.session import lean, materialize

#: Samples a row of an image, and rows a tile; payloads are padded to whole tiles.
WIDTH = 24
TILE = WIDTH * WIDTH
PAD = b"\xff"

ITEM = "struct<position:int, kind:string, text:string, digest:string, caption:string>"

_SKIP = {"script", "style", "noscript", "template"}
_BLOCK = {"p", "div", "article", "section", "h1", "h2", "h3", "h4", "h5", "h6", "li", "ul", "ol", "table", "tr", "td", "th", "nav", "header", "footer", "figure", "figcaption", "blockquote", "pre", "br", "hr", "title", "main", "aside"}
_DIGEST = re.compile(r"^(?:media:)?sha256[:\-/]([0-9a-fA-F]{64})$")


class _Sequence(HTMLParser):
    """Collects texts and media references in document order."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.items: list[dict] = []
        self.text: list[str] = []
        self.skip = 0
        self.figures: list[tuple[list[int], list[str]]] = []  # of each open figure: its media, and its captions
        self.caption: list[str] | None = None  # of the open figcaption

    def flush(self):
        said = " ".join("".join(self.text).split())
        self.text = []
        if said:
            self.items.append({"position": len(self.items), "kind": "text", "text": said, "digest": None, "caption": None})

    def end_caption(self):
        if self.caption is not None:
            said = " ".join("".join(self.caption).split())
            self.caption = None
            if said and self.figures:
                self.figures[-1][1].append(said)
            elif said:  # without a figure it is a text
                self.text.append(said)
                self.flush()

    def end_figure(self):
        """A figure's caption goes to all its media, before and after it."""
        self.end_caption()
        media, captions = self.figures.pop()
        for i in media:
            self.items[i]["caption"] = " ".join(captions) or self.items[i]["caption"]

    def finish(self):
        while self.figures:
            self.end_figure()
        self.end_caption()
        self.flush()

    def handle_starttag(self, tag, attrs):
        if tag in _SKIP:
            self.skip += 1
            return
        if tag in _BLOCK:
            self.flush()
        if tag == "figure":
            self.end_caption()
            self.figures.append(([], []))
        elif tag == "figcaption":
            self.end_caption()
            self.caption = []
        elif tag in ("img", "video", "audio", "source", "embed"):
            a = dict(attrs)
            self.flush()
            found = _DIGEST.match((a.get("src") or "").strip())
            if self.figures:
                self.figures[-1][0].append(len(self.items))
            self.items.append(
                {"position": len(self.items), "kind": "media", "text": a.get("src"), "digest": found[1].lower() if found else None, "caption": a.get("alt") or a.get("title") or None}
            )

    def handle_startendtag(self, tag, attrs):
        if tag not in _SKIP:
            self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if tag in _SKIP:
            self.skip = max(0, self.skip - 1)
            return
        if tag == "figcaption":
            self.end_caption()
        if tag == "figure" and self.figures:
            self.end_figure()
        if tag in _BLOCK:
            self.flush()

    def handle_data(self, data):
        if not self.skip:
            (self.text if self.caption is None else self.caption).append(data)


def sequence_of(html: str | None) -> list[dict]:
    """The items of one page. Unclosed tags end with the page; null and empty pages have no items."""
    p = _Sequence()
    p.feed(html or "")
    p.close()
    p.finish()
    return p.items


def parse_interleaved(pages: DataFrame, html: str = "html", items: str = "items") -> DataFrame:
    """``pages`` without ``html`` and with ``items``, an array of ``ITEM`` in document order; no shuffle.

    A figure's caption goes to each media reference in it, wherever it stands
    and whether or not it is closed (several are joined by a space); else the
    alternative text is the caption. A caption outside figures is a text. Equal
    pages have equal items; very long pages are parsed whole, one at a time. References that are no digests are kept with a null
    digest. Null and empty pages have an empty array. A clashing column
    ``items`` is replaced.
    """
    keep = [c for c in pages.columns if c not in (html, items)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("digest", pa.string()), ("caption", pa.string())]))
        for b in batches:
            found = pa.array([sequence_of(h.as_py()) for h in b.column(b.schema.get_field_index(html))], kind)
            yield pa.RecordBatch.from_pydict({c: b.column(b.schema.get_field_index(c)) for c in keep} | {items: found})

    slim = pages.select(*[f"`{c}`" for c in keep], f"`{html}`")
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in slim.schema if f.name != html)
    return slim.mapInArrow(lean(run), f"{fields}`{items}` array<{ITEM}>")


def padded(payload: Column) -> Column:
    """The payload and as many bytes 255 as fill a positive number of tiles."""
    n = F.octet_length(payload)
    fill = F.greatest(F.lit(TILE), F.ceil(n / TILE).cast("int") * TILE) - n
    return F.concat(payload, F.unhex(F.repeat(F.lit(PAD.hex()), fill)))


def image_of(payload: Column) -> Column:
    """A binary gray image (PGM) whose samples are the bytes of a padded payload."""
    header = F.concat(F.lit(f"P5\n{WIDTH} "), (F.octet_length(payload) / WIDTH).cast("int").cast("string"), F.lit("\n255\n"))
    return F.concat(header.cast("binary"), payload)


def store_media(rows: DataFrame, payload: str | Column, digest: str = "digest") -> DataFrame:
    """Write the images of padded payloads to the shared folder and read them back: ``digest, media``.

    The digest is the payload's SHA-256 in lower-case hex, by which references name it.
    """
    body = padded(F.col(payload) if isinstance(payload, str) else payload)
    return materialize(rows.select(body.alias("_p")).select(F.sha2("_p", 256).alias(digest), image_of(F.col("_p")).alias("media")), "media")


def samples(image: bytes) -> tuple[int, bytes]:
    """Width and samples of a binary 8-bit gray image; anything else is an error."""
    kind, size, depth, body = image.split(b"\n", 3)
    width, height = map(int, size.split())
    if kind != b"P5" or depth != b"255" or width * height != len(body):
        raise ValueError("not a whole binary gray image")
    return width, body


def feature(width: int, body: bytes) -> str:
    """Mean and deviation of the samples, and the 64 bits that say which cells of an 8 x 8 grid are above the mean."""
    px = np.frombuffer(body, np.uint8).reshape(-1, width).astype(np.float64)
    rows, cols = (np.linspace(0, n, 9).astype(int)[:-1] for n in px.shape)
    cells = np.add.reduceat(np.add.reduceat(px, rows, 0), cols, 1)
    area = np.diff([*rows, px.shape[0]])[:, None] * np.diff([*cols, width])[None, :]
    bits = np.packbits((cells / area > px.mean()).ravel()).tobytes().hex()
    return f"{px.mean():.4f},{px.std():.4f},{bits}"


FEATURES = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def media_features(media: DataFrame, digest: str = "digest") -> DataFrame:
    """``digest`` and ``FEATURES`` of stored media, computed from the stored bytes; a payload that does not have its digest is an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in FEATURES.split(", ")]
        for b in batches:
            out: dict[str, list] = {c: [] for c in [digest, *names]}
            for d, image in zip(b.column(0), b.column(1), strict=True):
                image = image.as_py()
                width, body = samples(image)
                sha = hashlib.sha256(body).hexdigest()
                if sha != d.as_py():
                    raise ValueError(f"stored media of {d} has digest {sha}")
                found = (sha, len(body), sha, zlib.crc32(body[-32:]), len(image), hashlib.sha256(image).hexdigest(), feature(width, body))
                for c, v in zip(out, found, strict=True):
                    out[c].append(v)
            yield pa.RecordBatch.from_pydict(out)

    return media.select(digest, "media").mapInArrow(lean(run), f"{digest} string, {FEATURES}")


def resolve(items: DataFrame, media: DataFrame, digest: str = "digest") -> DataFrame:
    """References with the columns of their media, by digest; references that nothing resolves keep nulls.

    Columns of ``items`` that clash with the media's are replaced.

    ``media`` may hold a digest several times (copies are equal by definition);
    one row a digest is kept before the join, and written, so that no reference
    multiplies and the join is of two plain exchanges: a digest that very many
    references share is then a skewed key whose partition Spark splits.
    """
    news = [c for c in media.columns if c != digest]
    one = media.groupBy(digest).agg(*[F.first(c, ignorenulls=True).alias(c) for c in news])
    items = items.drop(*news)
    return items.join(materialize(one, "media-by-digest"), digest, "left")
