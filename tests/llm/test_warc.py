import glob
import gzip
import hashlib

import pytest

from mailrisk.llm import warc

SCHEMA = "page_id long, url string, html string, URL string"
BIG, OTHER = "<html>" + "é" * 900, "x" * 1000
ROWS = [(1, "http://a", BIG, "q"), (4, "http://b", BIG, None), (9, None, BIG, None), (2, "http://c\r\nX: y", "small", None), (3, "u", "small", None),
        (5, "u", None, None), (6, "u", "", None), (7, "u", OTHER, None), (7, "u", OTHER, None), (8, "u", "x" * 999, None), (10, "u", "x" * 999, None),
        (None, "u", OTHER, None), (11, "u", "\r\n\r\nWARC/1.1\r\n" * 200, None)]


def test_rows(spark):
    got = {(r.page_id, r.payload_digest, r.record_type, r.refers_to, r.payload_bytes) for r in warc.op7_warc(spark.createDataFrame(ROWS, SCHEMA)).collect()}
    want = set()
    for page, _, html, _ in ROWS:
        raw = (html or "").encode()
        holder = max((p for p, _, h, _ in ROWS if (h or "") == (html or "") and p is not None), default=None)
        revisit = len(raw) >= 1000 and page != holder
        want.add((page, hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response", holder if revisit else None, len(raw)))
    assert got == want
    assert warc.op7_warc(spark.createDataFrame(ROWS, SCHEMA)).count() == len(ROWS)


def test_payloads_are_stored_once_and_records_come_back_whole(spark, tmp_path):
    records, payloads = warc.archive(spark.createDataFrame(ROWS, SCHEMA))
    assert payloads.count() == len({r[2] or "" for r in ROWS})
    back = warc.reconstruct(records, payloads).collect()
    assert len(back) == len(ROWS)
    by = {(p, h or "") for p, _, h, _ in ROWS}
    for r in back:
        head, body = bytes(r.response).split(b"\r\n\r\n", 1)
        assert (r.page_id, body.decode()) in by
        warc_head, block = bytes(r.record).split(b"\r\n\r\n", 1)
        length = int(dict(x.split(b": ", 1) for x in warc_head.split(b"\r\n")[1:])[b"Content-Length"])
        assert len(block) == length
    warc.write_warc(records, payloads, str(tmp_path / "warc"))
    raw = b"".join(gzip.decompress(open(f, "rb").read()) for f in sorted(glob.glob(f"{tmp_path}/warc/part-*")))
    n = 0
    while raw:  # a plain WARC reader: header, Content-Length bytes, two line breaks
        head, rest = raw.split(b"\r\n\r\n", 1)
        assert head.startswith(b"WARC/1.1\r\n")
        length = int(dict(x.split(b": ", 1) for x in head.split(b"\r\n")[1:])[b"Content-Length"])
        assert rest[length:length + 4] == b"\r\n\r\n"
        raw, n = rest[length + 4:], n + 1
    assert n == len(ROWS)


def test_urls_cannot_forge_header_fields(spark):
    urls = ["http://a/\u2028WARC-Refers-To: <urn:page:5>", "http://a/\u2029WARC-Payload-Digest: zz", "x\u0085\r\nWARC-Type: revisit", "é ü/😀", "http://ok/%20?a=[b]#c"]
    rows = [(i, u, "same text " * (200 if i < 2 else i + 1)) for i, u in enumerate(urls)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {(r.page_id, r.record_type, r.refers_to) for r in warc.op7_warc(df).collect()}
    assert got == {(0, "revisit", 1), (1, "response", None), (2, "response", None), (3, "response", None), (4, "response", None)}
    coded = {r[0]: r[1] for r in df.select("page_id", warc.percent_encoded(df.url)).collect()}
    from urllib.parse import quote
    assert coded == {i: quote(u, safe=":/?#[]@!$&'()*+,;=%-._~") for i, u in enumerate(urls)}


def test_files_give_whole_payloads_and_unique_ids(spark, tmp_path):
    """Every byte value passes, revisits get their payload by a join, and no two records share an id."""
    rows = [*ROWS, (20, "u", "".join(map(chr, range(0x250))) * 9, None), (21, "u", "".join(map(chr, range(0x250))) * 9, None), (21, "u", "\r\n\r\n" * 400, None)]
    path = warc.write_warc(*warc.archive(spark.createDataFrame(rows, SCHEMA)), str(tmp_path / "w"))
    read = warc.read_warc(spark, path)
    assert read.count() == read.select("record_id").distinct().count() == len(rows)
    back = sorted((r.page_id is not None, r.page_id or 0, bytes(r.payload)) for r in warc.rebuilt(read).collect())
    assert back == sorted((p is not None, p or 0, (h or "").encode()) for p, _, h, _ in rows)


def test_damage_is_an_error(spark):
    payloads = spark.createDataFrame([("0" * 64 + "-3", bytearray(b"abc"))], "payload_key string, payload binary")
    with pytest.raises(Exception, match="differs from its digest"):
        warc.verified_payloads(payloads).collect()


def test_empty(spark):
    assert warc.op7_warc(spark.createDataFrame([], SCHEMA)).collect() == []
