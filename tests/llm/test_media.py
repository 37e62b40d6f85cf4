import hashlib
import zlib

from pyspark.sql import functions as F

from foldkeep.llm.media import media_features, padded, parse_interleaved, resolve, samples, sequence_of, store_media
from foldkeep.llm.queries import op2_media_sequences

A, B = "ab" * 32, "CD" * 32


def test_order_positions_and_captions():
    html = f"""<html><head><title>T</title><script>var x="<p>no</p>";</script></head><body><p>one <b>two</b></p>
    <figure><img src="sha256:{A}" alt="alt"><figcaption>seen &amp; <i>said</i></figcaption></figure>
    <p>three<img src='media:sha256-{B}' title=tip>four<p>five<img src="http://x/y.png"></body>"""
    got = sequence_of(html)
    assert [i["position"] for i in got] == list(range(len(got)))
    assert [(i["kind"], i["digest"] or i["text"], i["caption"]) for i in got] == [
        ("text", "T", None), ("text", "one two", None), ("media", A, "seen & said"), ("text", "three", None),
        ("media", B.lower(), "tip"), ("text", "four", None), ("text", "five", None), ("media", "http://x/y.png", None),
    ]
    assert sequence_of(None) == sequence_of("") == []
    assert sequence_of("<p>open <b>tags") == [{"position": 0, "kind": "text", "text": "open tags", "digest": None, "caption": None}]


def test_parse_keeps_other_columns_and_replaces_a_clash(spark):
    df = spark.createDataFrame([(1, "<p>x</p>", 5), (2, None, 6)], "page_id long, html string, items int")
    got = {r.page_id: r["items"] for r in parse_interleaved(df).collect()}
    assert got[1][0].text == "x" and got[2] == []
    assert parse_interleaved(df.where("false")).isEmpty()


def test_store_reads_back_the_payload_and_resolves_once(spark):
    data = [b"", b"x", b"\xff" * 576, b"y" * 577, bytes(range(256)) * 100, b"x"]
    rows = spark.createDataFrame([(bytearray(x),) for x in data], "p binary")
    media = store_media(rows, "p")
    for r in media.collect():
        width, body = samples(bytes(r.media))
        assert width == 24 and len(body) % 576 == 0 and hashlib.sha256(body).hexdigest() == r.digest
    f = media_features(media)
    refs = rows.select(F.sha2(padded(F.col("p")), 256).alias("digest"), "p")
    got = resolve(refs.union(spark.createDataFrame([(A, bytearray(b"?"))], refs.schema)), f).collect()
    assert len(got) == len(data) + 1
    for r in got:
        raw = bytes(r.p)
        if raw == b"?":
            assert r.payload_bytes is None
            continue
        full = raw + b"\xff" * (max(576, -(-len(raw) // 576) * 576) - len(raw))
        assert (r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-32:]))


def test_query_gives_every_document_once(spark):
    got = op2_media_sequences(spark, "/root/testdata/sf0.001")
    docs = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    rows = got.collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    for r in rows:
        raw = docs[r.doc_id]
        full = raw + b"\xff" * (max(576, -(-len(raw) // 576) * 576) - len(raw))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-32:]))
        assert r.caption == f"{len(raw)} bytes" and r.position == 1 and r.feature


def test_captions_stay_with_their_media():
    said = lambda html: [(i["kind"], i["caption"] or i["text"]) for i in sequence_of(html)]
    img = lambda c="": f'<img src="sha256:{A}" alt="{c}">'
    assert said(f"<figure><figcaption>before</figcaption>{img('x')}</figure>") == [("media", "before")]
    assert said(f"<figure>{img()}<figcaption>open</figure><p>then") == [("media", "open"), ("text", "then")]
    assert said(f"<figure>{img()}<figcaption>never closed") == [("media", "never closed")]
    assert said(f"<figure>{img()}{img()}<figcaption>both</figcaption></figure>{img('own')}") == [("media", "both")] * 2 + [("media", "own")]
    assert said(f"<figure>{img()}<figcaption>a</figcaption><figure>{img()}<figcaption>b</figcaption></figure></figure>") == [("media", "a"), ("media", "b")]
    assert said("<figcaption>alone</figcaption>") == [("text", "alone")]


def test_very_long_pages_and_pages_of_the_table(spark):
    long = "<p>" + "word " * 400_000 + "</p>" + f'<img src="sha256:{A}">'
    items = sequence_of(long)
    assert len(items) == 2 and len(items[0]["text"]) == 1_999_999
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = parse_interleaved(pages, items="url").collect()
    assert len(got) == pages.count() and all([i.position for i in r.url] == list(range(len(r.url))) for r in got)
