import hashlib

import pytest

from flowlab.llm.warc import assemble, read_warc, records_of, with_origin, write_warc

LONG = "<p>Ünïcode " + "x" * 200 + "</p>"
TRICKY = "before\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nafter" * 3
ROWS = [
    (1, "http://a.org/", "short"), (2, "http://b.org/", "short"), (9, "http://c.org/", LONG), (4, "http://d.org/x y\r\nz", LONG),
    (7, None, LONG), (5, "http://e.org/", None), (6, "http://f.org/", ""), (8, "http://g.org/", TRICKY), (None, "http://h.org/", LONG),
    (None, "http://i.org/", "y" * 150), (10, "http://j.org/", TRICKY), (4, "http://d.org/x y\r\nz", LONG), (11, "u", "z" * 99), (12, "u", "z" * 99),
    (13, "u", "é" * 50), (14, "u", "é" * 50), (15, "big", "b" * 300_000), (-3, "neg", "n" * 100), (16, "neg", "n" * 100),
]


def expected():
    first = {}
    for key, _, html in ROWS:
        data = (html or "").encode()
        if len(data) >= 100 and key is not None:
            first[data] = min(first.get(data, key), key)
    out = []
    for key, _, html in ROWS:
        data = (html or "").encode()
        again = data in first and first[data] != key
        out.append((key, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", first[data] if again else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("size", [16 << 20, 1])
def test_round_trip(spark, tmp_path, size):
    path = str(tmp_path / "archive")
    pages = spark.createDataFrame([(*r, 1, "x") for r in ROWS], "page_id long, url string, html string, digest int, bytes string")
    write_warc(pages, path, file_bytes=size)
    records = read_warc(spark, path).cache()
    assert records.count() == 3 * len(ROWS)
    captures = with_origin(assemble(records)).collect()
    assert sorted(((r.page_id, r.response.payload_bytes, r.response.payload_digest, r.response.record_type, r.refers_to)
                   for r in captures), key=repr) == expected()
    for r in captures:
        assert r.request is not None and r.metadata is not None
        if r.response.record_type == "response":
            assert hashlib.sha256(bytes(r.response.payload)).hexdigest() == r.response.payload_digest
        else:
            assert not r.response.payload
    payloads = {bytes(r.response.payload) for r in captures if r.response.record_type == "response"}
    assert payloads == {(h or "").encode() for _, _, h in ROWS}


def test_empty_table(spark, tmp_path):
    path = str(tmp_path / "none")
    write_warc(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert with_origin(assemble(read_warc(spark, path))).count() == 0


def test_partial_transactions(spark):
    schema = "file string, offset long, record_type string, record_id string, concurrent_to string, refers_to string, " \
             "target_uri string, date string, payload_bytes long, payload_digest string, fields string, payload binary"
    row = lambda kind, own, to=None, of=None, fields=None: ("f", 0, kind, own, to, of, None, None, 1, "d", fields, None)
    records = spark.createDataFrame([
        row("response", "r1"), row("request", "q2", "r1"), row("request", "q1", "r1"), row("metadata", "m9", "gone"),
        row("revisit", "r2", of="r0"), row("metadata", "m2", "r2", fields="page-id: 5\r\n"), row("warcinfo", "w")], schema)
    made = {r.record_id: r for r in with_origin(assemble(records)).collect()}
    assert set(made) == {"r1", "r2"}
    assert made["r1"].request.id == "q1" and made["r1"].metadata is None and made["r1"].page_id is None
    assert made["r2"].request is None and made["r2"].page_id == 5 and made["r2"].refers_to is None


def test_not_an_archive():
    with pytest.raises(ValueError):
        list(records_of(b"HTTP/1.1 200 OK\r\n\r\nx"))
