import hashlib

import pytest

from foldkeep.llm import warc
from foldkeep.llm.warc import END, MAGIC, candidates, read_warc, write_warc
from foldkeep.session import new_path


def back(spark, data, small_ranges=None, payload=True):
    path = new_path(spark, "test-warc")
    df = spark.createDataFrame(data, "page_id long, url string, html string, offset int")
    write_warc(df.coalesce(2), path)
    try:
        if small_ranges:
            spark.conf.set("spark.sql.files.maxPartitionBytes", str(small_ranges))
            spark.conf.set("spark.sql.files.openCostInBytes", "0")
        return path, read_warc(spark, path, payload=payload).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def fake(n):
    """A payload that holds whole well-formed records."""
    body = "z" * n
    return f"<p>{MAGIC}WARC-Type: response\r\nContent-Length: {n}{END}{body}{END}" * 3 + MAGIC + "no header" + MAGIC


DATA = [
    (1, "http://a/\r\nX: y", "plain " * 30, 0), (2, None, None, 0), (3, "", "", 0), (4, "u", fake(50), 0), (5, "u", fake(3000), 0),
    (6, "u", "plain " * 30, 0), (7, "u", "short", 0), (8, "u", "short", 0), (9, "u", "x" * 100, 0), (10, "u", "x" * 100, 0), (11, "u", "é" * 200_000, 0),
    (12, "u", fake(50), 0), (13, "u", MAGIC, 0), (14, "u", "\r\n\r\n" * 40, 0),
]


@pytest.mark.parametrize("small_ranges", [None, 700])
def test_round_trip_with_magic_inside_payloads(spark, small_ranges):
    _, got = back(spark, DATA, small_ranges)
    assert len(got) == len(DATA)
    by = {int(r.record_id[10:-1]): r for r in got}
    for i, _, html, _ in DATA:
        raw = (html or "").encode()
        r = by[i]
        first = min(j for j, _, h, _ in DATA if (h or "") == (html or ""))
        assert (r.type, r.refers) == (("revisit", f"<urn:page:{first}>") if len(raw) >= 100 and first < i else ("response", None))
        assert r.payload_digest == hashlib.sha256(raw).hexdigest() and r.declared == len(raw)
        assert bytes(r.payload) == (b"" if r.type == "revisit" else raw)
        assert r.sha == hashlib.sha256(bytes(r.payload)).hexdigest()


def test_index_without_payload_has_the_same_digests(spark):
    path, full = back(spark, DATA)
    slim = read_warc(spark, path).collect()
    assert {(r.file, r.offset, r.sha) for r in slim} == {(r.file, r.offset, r.sha) for r in full}
    assert candidates(spark, path).count() > len(DATA)


def test_empty_table(spark):
    _, got = back(spark, [])
    assert got == []


def test_torn_tail_is_dropped(spark, tmp_path):
    whole = f"{MAGIC}WARC-Type: response\r\nWARC-Record-ID: <a>\r\nContent-Length: 5{END}hello{END}"
    torn = f"{MAGIC}WARC-Type: response\r\nWARC-Record-ID: <b>\r\nContent-Length: 50{END}hello"
    (tmp_path / "w").mkdir()
    (tmp_path / "w/x.warc").write_bytes((whole + whole + torn).encode())
    (tmp_path / "w/y.warc").write_bytes(("garbage" + whole).encode())
    got = read_warc(spark, str(tmp_path / "w")).collect()
    assert [r.record_id for r in got] == ["<a>", "<a>"]


def test_repeated_and_null_identifiers_have_one_record_a_row(spark):
    body = "p" * 200
    data = [(1, "u", body, 0), (5, "u", body, 0), (5, "u", body, 0), (None, "u", body, 0), (None, "u", "q" * 150, 0), (None, "u", "q" * 150, 0), (7, "u", "r" * 120, 0), (7, "u", "r" * 120, 0)]
    _, got = back(spark, data)
    said = sorted((r.record_id, r.type, r.refers or "") for r in got)
    name = lambda i: f"<urn:page:{i}>"
    assert said == sorted([
        (name(1), "response", ""), (name(5), "revisit", name(1)), (name(5), "revisit", name(1)), (name("null"), "revisit", name(1)),
        (name("null"), "response", ""), (name("null"), "response", ""), (name(7), "response", ""), (name(7), "response", ""),
    ])


@pytest.mark.parametrize("payload", [True, False])
def test_long_headers_and_payloads(spark, payload):
    data = [(1, "u", "a" * 50, 0), (2, "http://" + "x" * 2_000_000, fake(40), 0), (3, "u", "b" * 3_000_000 + MAGIC, 0)]
    _, got = back(spark, data, payload=payload)
    assert {r.record_id: r.sha for r in got} == {f"<urn:page:{i}>": hashlib.sha256(h.encode()).hexdigest() for i, _, h, _ in data}


def test_split_borders_that_differ_between_scans(spark):
    """Ranges are cut anew for each job; bodies are found by their offsets, whatever the cut."""
    path = new_path(spark, "test-warc")
    rows = [(i, "u", fake(30 + i % 7) if i % 3 else "z" * (i * 11), 0) for i in range(120)]
    write_warc(spark.createDataFrame(rows, "page_id long, url string, html string, offset int").coalesce(1), path)
    sizes = iter([900, 2500, 700, 4000, 1300, 650] * 50)
    real = warc._scan

    def scan(*args):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(next(sizes)))
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        return real(*args)

    warc._scan = scan
    try:
        got = read_warc(spark, path).collect()
    finally:
        warc._scan = real
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert {r.record_id: r.sha for r in got if r.type == "response"}.items() <= {f"<urn:page:{i}>": hashlib.sha256(h.encode()).hexdigest() for i, _, h, _ in rows}.items() and len(got) == 120
