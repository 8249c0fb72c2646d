"""WARC round trips, members that stand alone, and the rows against a plain version."""

import gzip
import io
import zlib

import pytest

from vetloom.llm import warc

SCHEMA = "page_id long, url string, html string, name string, content string"


def rows():
    same = "<p>same</p>" * 50
    pages = [(1, "http://a", same), (2, "http://b\r\nX: y", "other ñ 日本"), (3, None, None), (4, "u", ""), (9, "u", same), (7, "u", same), (8, "u", "x" * 300_000), (9, "again", same)]
    return [(*p, "clash", "clash") for p in pages]


def expected(pages, min_bytes=0):
    top = {}
    for i, _, html, *_ in pages:
        top[html or ""] = max(top.get(html or "", -1), i)
    out = []
    for i, _, html, *_ in pages:
        text = html or ""
        again = len(text.encode()) >= min_bytes and i < top[text]
        out.append((i, len(text.encode()), warc.digest(text.encode()), "revisit" if again else "response", top[text] if again else -1))
    return sorted(out)


def round_trip(docs, folder, **kwargs):
    return warc.read(warc.normalise(warc.save(warc.write(docs, **kwargs), f"{folder}/gzip"), f"file://{folder}/records"))


@pytest.mark.parametrize("min_bytes", [0, 1, 10_000])
def test_rows(spark, tmp_path, min_bytes):
    got = round_trip(spark.createDataFrame(rows(), SCHEMA), tmp_path, min_bytes=min_bytes).collect()
    assert sorted((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, -1 if r.refers_to is None else r.refers_to) for r in got) == expected(rows(), min_bytes)
    texts = {r[0]: (r[2] or "").encode() for r in rows()}
    assert all(r.payload == texts[r.page_id] for r in got if r.record_type == "response") and all(r.error is None for r in got)
    assert sorted(p.name for p in (tmp_path / "records").iterdir() if not p.name.endswith(".crc")) == ["pages-000000.warc.gz", "pages-000000.warc.gz.idx"]
    whole = gzip.decompress((tmp_path / "gzip" / "pages-000000.warc.gz").read_bytes())
    assert gzip.decompress((tmp_path / "records" / "pages-000000.warc.gz").read_bytes()) == whole


def normal(content):
    members, index = io.BytesIO(), io.BytesIO()
    warc.normalised(io.BytesIO(content), members, index)
    return members.getvalue(), index.getvalue().decode()


def test_members_stand_alone():
    whole = b"".join(warc.record(i, f"http://{i}", b"payload" * i, i == 3, 2 if i == 3 else None) for i in range(1, 6))
    content, index = normal(gzip.compress(whole))
    assert gzip.decompress(content) == whole
    lines = [line.split("\t") for line in index.splitlines()[1:]]
    assert [x[2] for x in lines] == [f"<urn:page:{i}>" for i in range(1, 6)]
    for offset, length, name in lines:
        assert name.encode() in zlib.decompress(content[int(offset) : int(offset) + int(length)], wbits=31)
    assert normal(content) == (content, index)  # already normal
    with pytest.raises(ValueError):
        normal(gzip.compress(whole[:-10]))


def test_archives_from_elsewhere(spark, tmp_path):
    """Other kinds of records, headers without blanks or folded, missing ones, and broken files."""
    html = b"<p>hi</p>"
    record = lambda head, block: b"WARC/1.0\r\n" + head + f"\r\nContent-Length:{len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"
    whole = b"".join(
        [
            record(b"WARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:1>\r\nContent-Type: application/warc-fields", b"software: x"),
            record(b"warc-type:response\r\nWARC-Record-ID:<urn:uuid:2>\r\nX-Long: one\r\n two\r\nContent-Type: application/http;msgtype=response", b"HTTP/1.1 200 OK\r\nServer: y\r\n\r\n" + html),
            record(b"WARC-Type: response\r\nWARC-Record-ID: <urn:page:7>\r\nContent-Type: application/http\r\nWARC-Payload-Digest: sha1:AAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAA", b"HTTP/1.1 200 OK\r\n\r\n" + html),
            record(b"WARC-Type: resource", b"z" * 3_000_000),
        ]
    )
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(whole))
    (tmp_path / "b.warc.gz").write_bytes(b"no gzip")
    (tmp_path / "c.warc.gz").write_bytes(gzip.compress(whole)[:-20])
    (tmp_path / "other.txt").write_text("x")
    got = warc.read(warc.normalise(warc.listed(spark, str(tmp_path)), f"{tmp_path}/records")).collect()
    good = {r.record_id: r for r in got if r.error is None}
    assert good["<urn:uuid:1>"].record_type == "warcinfo" and good["<urn:uuid:1>"].payload == b"software: x"
    assert (good["<urn:uuid:2>"].payload, good["<urn:uuid:2>"].payload_digest, good["<urn:uuid:2>"].page_id) == (html, warc.digest(html), None)
    assert good[None].payload_bytes == 3_000_000
    bad = [(r.page_id, r.payload) for r in got if r.error is not None]
    assert sorted(bad, key=str) == [(7, None), (None, None), (None, None)]


def test_null_ids_and_empty(spark, tmp_path):
    some = [(None, "u", "a", "", ""), (5, "u", "a", "", ""), (None, "u", "b", "", "")]
    got = round_trip(spark.createDataFrame(some, SCHEMA), tmp_path).collect()
    assert sorted((str(r.page_id), r.record_type, r.refers_to or 0) for r in got) == [("5", "response", 0), ("None", "response", 0), ("None", "revisit", 5)]
    assert round_trip(spark.createDataFrame([], SCHEMA), tmp_path / "none").count() == 0
