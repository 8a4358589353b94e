"""Archives and their index: round trips, ranges, hot hosts, odd rows."""

import gzip
import hashlib
import zlib

from provenant.llm import archives as ar
from provenant.llm.common import new_folder

SCHEMA = "page_id long, url string, html string, archive string"


def pages(spark):
    big, long = "copy" * 50, "é" * 300_000
    rows = [(i, f"http://Hot.example.com:8080/a/{i % 40}?q={i}#x", f"<p>{i}</p>" * 30, "c") for i in range(1500)]
    rows += [(i, "http://one.example.org/", big, "c") for i in range(2000, 2600)]
    rows += [(5000, None, None, "c"), (5001, "", "", "c"), (5002, "not a url with blanks", "x\r\n\r\ny", "c"), (5003, "http://ex.org/%7Ea b/ü?\r\nx", long, "c"), (5004, "//u@h.example/p", long, "c"),
             (5003, "http://ex.org/%7Ea b/ü?\r\nx", long, "c"), (None, "http://n.example/", big, "c"), (-7, "http://neg.example/", "\x00\x01", "c"), (5005, "http://u.example/x", big[:99], "c"), (5006, "http://u.example/x", big[:99], "c")]
    return spark.createDataFrame(rows, SCHEMA)


def test_round_trip(spark, monkeypatch):
    monkeypatch.setattr(ar, "LINES", 7)
    df = pages(spark)
    rows = [(r.page_id, r.url or "", (r.html or "").encode()) for r in df.collect()]
    first = {}
    for page, _, payload in rows:
        if page is not None and len(payload) >= ar.LEAST:
            first[payload] = min(first.get(payload, page), page)
    want = []
    for page, url, payload in rows:
        f = first.get(payload)
        refers = None if f is None or f == page else f
        want.append((page, url, "response" if refers is None else "revisit", payload if refers is None else None, len(payload), hashlib.sha256(payload).hexdigest(), refers))
    got = [(r.page_id, r.url, r.record_type, r.payload and bytes(r.payload) if r.payload is not None else None, r.payload_bytes, r.payload_digest, r.refers_to) for r in ar.round_trip(df).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert ar.round_trip(df.limit(0)).count() == 0


def test_archives_are_plain_gzip_and_the_index_finds_ties_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(ar, "LINES", 3)
    folder = new_folder(spark)
    df = spark.createDataFrame([(7, "http://a.example/x", "p" * 10, "")] * 20 + [(8, "http://a.example/x", "q", "")], SCHEMA)
    notes = ar.write(df, folder)
    names = {r.archive for r in notes.collect()}
    assert all(n.startswith(folder) for n in names)
    files = ar.build_index(notes)
    index = ar.Index(files)
    key = ar.url_key("http://a.example/x")
    assert key == "example,a)/x"
    assert len(index.find(key, 7)) == 20 and len(set(index.find(key, 7))) == 20
    assert len(index.find(key, 8)) == 1 and index.find(key, 9) == [] and index.find("zz", 7) == [] and index.find("a", None) == []
    for name in names:
        system, path = ar._file_system(name)
        assert gzip.decompress(system.open_input_file(path).read()).startswith(b"WARC/1.1\r\n")


def test_large_records_are_read_in_small_batches(spark):
    """More payload than one batch could hold for a worker: 9,000 pages of 260 kB."""
    df = spark.range(0, 9000, 1, 8).selectExpr("id AS page_id", "'http://h.example/' || id AS url", "repeat(md5(cast(id AS string)), 8125) AS html")
    found = ar.digest(ar.round_trip(df)).selectExpr("count(*) AS n", "sum(payload_bytes) AS b", "count(DISTINCT payload_digest) AS d", "min(record_type) AS t").first()
    assert tuple(found) == (9000, 9000 * 260_000, 9000, "response")


def test_revisits_carry_no_payload(spark):
    planned = {r.page_id: r for r in ar.plan(spark.createDataFrame([(i, "u", "p" * 200, "") for i in range(5)] + [(9, "u", "p" * 99, ""), (10, "u", "p" * 99, "")], SCHEMA)).collect()}
    assert {i: len(r.payload) for i, r in planned.items()} == {0: 200, 1: 0, 2: 0, 3: 0, 4: 0, 9: 99, 10: 99}
    assert {r["size"] for r in planned.values()} == {200, 99}


def test_records():
    data = ar.record(4, "http://a.example/%41?b=c d", b"", 0, "00", None, "2020-01-01T00:00:00Z")
    assert ar.parse(data)["url"] == "http://a.example/%41?b=c d" and ar.parse(data)["payload"] == b""
    assert zlib.decompress(data, wbits=31).endswith(b"\r\n\r\n")
    again = ar.parse(ar.record(5, None, b"", 3, "11", 4, "2020-01-01T00:00:00Z"))
    assert (again["record_type"], again["refers_to"], again["payload"], again["payload_bytes"]) == ("revisit", 4, None, 3)
