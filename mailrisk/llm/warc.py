"""Content-addressed WARC archive (operator 7).

``archive`` writes two tables: ``payloads`` holds each distinct payload once, under its
SHA-256 and length; ``records`` holds every record's exact header bytes and the key of
its payload.  ``reconstruct`` joins them back into whole records, and ``write_warc``
writes those as gzip WARC files of about ``FILE_BYTES`` of payloads (Spark's text writer,
whose line separator is the blank line that closes a record).  ``read_warc`` reads such
files record by record, by header fields and lengths alone, and ``rebuilt`` gives revisits
the payload of the record they refer to, by a join on record ids.  Payload digests are taken
again from the bytes on every reading; a difference is an error.

Of records with equal payloads of at least ``MIN_REVISIT`` bytes the one with the
largest page_id is the response, the others are revisits of it; smaller ones are all
responses.  Finding them moves digests only; payload bytes are shuffled once, into the files.

The writer passes bytes through a string column without looking at them and names its own
compression, so a session's codec settings do not change them; a test holds every byte value.

Edge cases: null html is an empty payload; a null page_id sorts below all others; rows
that repeat the response's page_id and payload are responses too; every record has an id
of its own; a null url has no target header and characters that RFC 3986 does not allow are
percent-encoded; an empty table gives empty tables and no records.
"""

from __future__ import annotations

import gzip
import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir
from .common import map_arrow, pick, stored

FILE_BYTES = 32 << 20
MIN_REVISIT = 1000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BREAK = "\r\n"


def _payload():
    return F.coalesce(F.col("html"), F.lit("")).cast("binary")


def _payload_key(payload):
    return F.concat_ws("-", F.sha2(payload, 256), F.octet_length(payload).cast("string"))


def _line(name: str, value):
    return F.concat(F.lit(f"{name}: "), value, F.lit(BREAK))


def _record_uri(page_id: Column, number: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("none")), F.lit(":"), number.cast("string"), F.lit(">"))


def percent_encoded(url: Column) -> Column:
    """The url with every character that RFC 3986 does not allow as the percent codes of its UTF-8 bytes."""
    fits = r"[A-Za-z0-9\-._~:/?#\[\]@!$&'()*+,;=%]"
    coded = F.array_join(F.transform(F.split(url, ""), lambda c: F.when(c.rlike(f"^{fits}$") & (F.octet_length(c) == 1), c)
                                     .otherwise(F.regexp_replace(F.hex(F.encode(c, "UTF-8")), "(..)", "%$1"))), "")
    return F.when(url.rlike(rf"\A{fits}*\z"), url).otherwise(coded)


def _headers(date: str):
    """Exact bytes of the WARC header block and the HTTP header block of a record."""
    revisit = F.col("refers_to").isNotNull()
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{BREAK}Content-Type: text/html; charset=utf-8{BREAK}"),
                    _line("Content-Length", F.col("payload_bytes").cast("string")), F.lit(BREAK))
    block = F.length(http) + F.when(revisit, F.lit(0)).otherwise(F.col("payload_bytes"))
    return F.concat(
        F.lit(f"WARC/1.1{BREAK}"),
        _line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        _line("WARC-Record-ID", _record_uri(F.col("page_id"), F.col("number"))),
        _line("WARC-Date", F.lit(date)),
        F.coalesce(_line("WARC-Target-URI", percent_encoded(F.col("url"))), F.lit("")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        F.when(revisit, F.concat(_line("WARC-Refers-To", _record_uri(F.col("refers_to"), F.col("holder_number"))),
                                 _line("WARC-Profile", F.lit(PROFILE)))).otherwise(F.lit("")),
        _line("Content-Type", F.lit("application/http; msgtype=response")),
        _line("Content-Length", block.cast("string")), F.lit(BREAK)), http


def archive(pages: DataFrame, date: str = "1970-01-01T00:00:00Z") -> tuple[DataFrame, DataFrame]:
    """Write ``(records, payloads)`` of all pages to the shared folder."""
    pages = pick(pages, "page_id", "url", "html")
    keys = stored(pages.withColumn("_p", _payload())
                  .select("page_id", "url", F.monotonically_increasing_id().alias("number"), _payload_key(F.col("_p")).alias("payload_key"),
                          F.octet_length("_p").cast("long").alias("payload_bytes"), F.sha1("_p").alias("payload_digest")),
                  "warc-keys")
    # largest page_id of each payload, its record's number and how many rows repeat it; sums by key meet first, so a hot payload is small
    holders = (keys.groupBy("payload_key", "page_id").agg(F.count(F.lit(1)).alias("n"), F.max("number").alias("number"))
               .groupBy("payload_key").agg(F.max(F.struct("page_id", "number", "n")).alias("h"))
               .select("payload_key", F.col("h.page_id").alias("holder"), F.col("h.number").alias("holder_number"), F.col("h.n").alias("n")))
    refers = (F.col("payload_bytes") >= MIN_REVISIT) & F.col("holder").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("holder"))
    warc, http = _headers(date)
    records = (keys.join(holders.drop("n"), "payload_key").withColumn("refers_to", F.when(refers, F.col("holder")))
               .select("page_id", "payload_key", "payload_bytes", warc.alias("warc_header"), http.alias("http_header")))
    # rows whose payload another row stores: stored themselves, so Spark knows their size and broadcasts them while they are few
    same = keys.join(holders, "payload_key").filter(~F.col("page_id").eqNullSafe(F.col("holder")) | (F.col("n") > 1))
    losers = stored(same.filter(~F.col("page_id").eqNullSafe(F.col("holder"))).select(F.col("page_id").alias("_page"), F.col("payload_key").alias("_key")).distinct(), "warc-losers")
    repeats = stored(same.filter(F.col("page_id").eqNullSafe(F.col("holder"))).select(F.col("page_id").alias("_page"), F.col("payload_key").alias("_key")).distinct(), "warc-repeats")
    wide = pages.withColumn("payload", _payload()).select("page_id", _payload_key(F.col("payload")).alias("payload_key"), "payload")
    on = F.col("page_id").eqNullSafe(F.col("_page")) & (F.col("payload_key") == F.col("_key"))
    single = wide.join(losers.unionByName(repeats), on, "left_anti").select("payload_key", "payload")
    several = wide.join(repeats, on, "left_semi").groupBy("payload_key").agg(F.first("payload").alias("payload"))
    return stored(records, "warc-records"), stored(single.unionByName(several), "warc-payloads", compression="zstd")


def verified_payloads(payloads: DataFrame) -> DataFrame:
    """The stored payloads, after their SHA-256 has been held against their key."""
    return payloads.select(
        F.when(_payload_key(F.col("payload")) == F.col("payload_key"), F.col("payload_key"))
        .otherwise(F.raise_error(F.concat(F.lit("payload differs from its digest: "), F.col("payload_key")))).alias("payload_key"), "payload")


def reconstruct(records: DataFrame, payloads: DataFrame) -> DataFrame:
    """Every record whole: page_id, ``record`` (as archived) and ``response`` (the HTTP response, also of revisits)."""
    r = records.join(verified_payloads(payloads), "payload_key")
    response = F.concat(F.col("http_header").cast("binary"), F.col("payload"))
    revisit = F.col("warc_header").contains(f"WARC-Type: revisit{BREAK}")
    body = F.when(revisit, F.col("http_header").cast("binary")).otherwise(response)
    return r.select("page_id", F.concat(F.col("warc_header").cast("binary"), body).alias("record"), response.alias("response"))


def write_warc(records: DataFrame, payloads: DataFrame, out: str) -> str:
    """The archive as WARC files in ``out``: records follow one another, each closed by two line breaks."""
    size, n = records.agg(F.sum("payload_bytes"), F.count(F.lit(1))).first()
    whole = reconstruct(records, payloads).select(F.col("record").cast("string").alias("value"))
    (whole.write.option("lineSep", BREAK * 2).option("compression", "gzip")
     .option("maxRecordsPerFile", max(1, FILE_BYTES * n // max(1, size or 0))).text(out))
    return out


_READ = "record_id string, page_id long, record_type string, refers_to_id string, refers_to long, said string, payload_bytes long, payload_digest string, payload binary"


def parse_records(raw: bytes):
    """``(fields, block)`` of the records of a WARC file, by their lengths."""
    at, gap = 0, b"\r\n\r\n"
    while at < len(raw):
        end = raw.index(gap, at)
        lines = raw[at:end].split(b"\r\n")
        if not lines[0].startswith(b"WARC/"):
            raise ValueError("not a WARC record")
        fields = dict(line.split(b": ", 1) for line in lines[1:])
        start = end + len(gap)
        stop = start + int(fields[b"Content-Length"])
        if raw[stop:stop + 4] != gap:
            raise ValueError("a WARC record has not the length that its header says")
        yield fields, raw[start:stop]
        at = stop + len(gap)


def _page(uri: str | None) -> int | None:
    """Page id of a record's URI ``<urn:page:ID:NUMBER>``."""
    page = uri[1:-1].split(":")[2] if uri else "none"
    return None if page == "none" else int(page)


def _parse(batches):
    names = [c.split()[0] for c in _READ.split(", ")]
    kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.binary()]
    for b in batches:
        for content in b.column(0):
            rows, held = [], 0
            for fields, block in parse_records(gzip.decompress(content.as_buffer())):
                text = {k.decode(): v.decode() for k, v in fields.items()}
                revisit = text["WARC-Type"] == "revisit"
                payload = None if revisit else block.split(b"\r\n\r\n", 1)[1]
                rows.append((text["WARC-Record-ID"], _page(text["WARC-Record-ID"]), text["WARC-Type"], text.get("WARC-Refers-To"), _page(text.get("WARC-Refers-To")),
                             text["WARC-Payload-Digest"].removeprefix("sha1:"), None if revisit else len(payload),
                             None if revisit else hashlib.sha1(payload).hexdigest(), payload))
                held += len(payload or b"")
                if held > 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Every record of the WARC files: ids, type, the digest its header says, and of responses the payload with its own digest."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return map_arrow(files, _parse, _READ)


def rebuilt(read: DataFrame, with_payload: bool = True) -> DataFrame:
    """All records with full payloads: a revisit gets those of the record it refers to, whose digest must be the one it says."""
    cols = ["payload_bytes", "payload_digest", *(["payload"] if with_payload else [])]
    own = read.filter("record_type = 'response'").select("record_id", *cols)
    found = read.filter("record_type = 'revisit'").drop(*cols, "payload").join(
        own.withColumnRenamed("record_id", "refers_to_id"), "refers_to_id", "left")
    whole = read.filter("record_type = 'response'").select(*read.drop(*cols, "payload").columns, *cols).unionByName(
        found.select(*read.drop(*cols, "payload").columns, *cols))
    right = F.when(F.col("said") == F.col("payload_digest"), F.col("payload_digest")).otherwise(F.raise_error(
        F.concat(F.lit("header and payload digests differ: "), F.col("record_id"))))
    return whole.withColumn("payload_digest", right)


def op7_warc(pages: DataFrame) -> DataFrame:
    """Archive all pages as WARC files, read those back and rebuild their records; one row a page."""
    spark = pages.sparkSession
    path = write_warc(*archive(pages), shared_dir(spark, "warc-files"))
    return rebuilt(read_warc(spark, path), with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
 d AS (SELECT page_id, octet_length(encode(h)) AS payload_bytes, sha1(h) AS payload_digest FROM p),
 w AS (SELECT payload_bytes, payload_digest, max(page_id) AS holder FROM d GROUP BY ALL)
SELECT page_id, payload_bytes, payload_digest,
 CASE WHEN payload_bytes >= 1000 AND page_id <> holder THEN 'revisit' ELSE 'response' END AS record_type,
 CASE WHEN payload_bytes >= 1000 AND page_id <> holder THEN holder END AS refers_to
FROM d JOIN w USING (payload_bytes, payload_digest)"""
