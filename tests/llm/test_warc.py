import gzip
import hashlib
import io

import pytest

from tidemark.llm import warc

LONG = "<p>é</p>" * 40
ROWS = [
    (7, "http://a/x", LONG), (3, "http://a/y", LONG), (9, "http://b/", LONG), (1, "http://c/", "short"), (2, "http://c/", "short"),
    (4, "http://d/ with blank", "\n\nHTTP/1.1 404\r\n\r\n" * 9), (5, None, None), (6, "", ""), (None, "http://n/", LONG), (8, "http://e/", "a" * 100), (10, "http://e/", "a" * 100),
    (11, "http://e/", "b" * 99), (12, "http://e/", "b" * 99), (8, "http://e/", "a" * 100), (13, "http://big/", "0123456789" * 300_000),
]


@pytest.fixture
def pages(spark):
    return spark.createDataFrame([(*r, "x") for r in ROWS], "page_id BIGINT, url STRING, html STRING, payload_digest STRING").repartition(4)


def expected():
    first, out = {}, []
    order = sorted(ROWS, key=lambda r: (r[0] is None, r[0] or 0))
    for page, _, html in order:
        data = (html or "").encode()
        digest = hashlib.sha256(data).hexdigest()
        revisit = len(data) >= 100 and digest in first
        out.append((page, len(data), digest, "revisit" if revisit else "response", first.get(digest) if revisit else None))
        first.setdefault(digest, page)
    return sorted(out, key=str)


def test_round_trip(pages):
    rows = warc.warc_index(warc.convert(warc.write_arcs(pages)))
    assert sorted(map(tuple, rows.collect()), key=str) == expected()


def test_empty_table(pages):
    assert warc.warc_index(warc.convert(warc.write_arcs(pages.limit(0)))).count() == 0


def arc(version, records, names=None):
    block = f"{version} 0 test\n{names or warc.FIELDS.get(version, '')}\n\n".encode()
    out = f"filedesc://t.arc 0.0.0.0 20010203040506 text/plain {len(block)}\n".encode() + block
    return io.BytesIO(out + b"".join(b"\n" + head + b"\n" + body for head, body in records))


HTTP = b"HTTP/1.0 200 OK\r\nContent-Type: text/html\r\n\r\n"


def test_both_versions_parse_by_their_own_fields():
    body = HTTP + b"line\nhttp://fake/ 0.0.0.0 20010101000000 text/html 5\n"
    one = [*warc.read_arc(arc(1, [(b"http://a/ 1.2.3.4 20010203040506 text/html %d" % len(body), body)] * 2))]
    two = [*warc.read_arc(arc(2, [(b"http://a/ 1.2.3.4 20010203040506 text/html 200 abc - 0 t.arc %d" % len(body), body)]))]
    assert len(one) == 2 and one[0].content == two[0].content == body
    assert two[0].fields["Checksum"] == "abc" and one[0].date == "2001-02-03T04:05:06Z"
    assert one[0].payload == body[len(HTTP) :] and one[0].record_id == two[0].record_id


@pytest.mark.parametrize(
    "file",
    [
        io.BytesIO(b""), io.BytesIO(b"http://no/ block\n"), arc(3, []), arc(1, [(b"http://a/ 1.2.3.4 2001 text/html 50", b"too short")]),
        arc(1, [(b"http://a/ 1.2.3.4 2001 extra text/html 5", b"12345")]), arc(1, [(b"http://a/ 1.2.3.4 2001 text/html x", b"12345")]),
    ],
)
def test_damage_is_reported(file):
    with pytest.raises(ValueError):
        list(warc.read_arc(file))


def test_records_have_what_warc_asks_for():
    body = HTTP + b"hello"
    (record,) = warc.read_arc(arc(1, [(b"http://a/ 1.2.3.4 20010203040506 text/html %d" % len(body), body)]))
    (dns,) = warc.read_arc(arc(1, [(b"dns:a 1.2.3.4 20010203040506 text/dns 3", b"a b")]))
    data = b"".join(map(warc.warc_record, (record, dns))) + warc.warc_record(record, "<urn:uuid:x>")
    (head, block), (plain, text), (again, rest) = warc.read_warc(gzip.GzipFile(fileobj=io.BytesIO(data)))
    assert (head["WARC-Type"], plain["WARC-Type"], again["WARC-Type"]) == ("response", "resource", "revisit")
    assert block == body and text == b"a b" and rest == HTTP and plain["Content-Type"] == "text/dns"
    assert head["WARC-Payload-Digest"] == again["WARC-Payload-Digest"] == "sha256:" + hashlib.sha256(b"hello").hexdigest()
    assert again["WARC-Refers-To"] == "<urn:uuid:x>" and again["WARC-Record-ID"] != head["WARC-Record-ID"] and "WARC-Profile" in again
    assert head["WARC-Date"] == "2001-02-03T04:05:06Z" and head["Content-Length"] == str(len(body))


def test_changed_payloads_are_found():
    body = HTTP + b"hello"
    (record,) = warc.read_arc(arc(1, [(b"http://a/ 1.2.3.4 20010203040506 text/html %d" % len(body), body)]))
    data = gzip.decompress(warc.warc_record(record)).replace(b"hello", b"hullo")
    with pytest.raises(ValueError):
        list(warc.read_warc(io.BytesIO(data)))
