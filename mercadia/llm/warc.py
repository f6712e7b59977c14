"""Legacy ARC archives converted to WARC, and both formats written and read.

An ARC file starts with a version block; every record is a header line of
space-separated fields - five in version 1, ten in version 2 - whose last field
is the declared length of the content that follows. The converter reads records
by these lengths and writes an equivalent WARC record for each: an identifier
made from the file's name and the record's place in it, the 14-digit date as an
ISO timestamp, the record type (``warcinfo`` for the version block, ``response``
for http records, ``resource`` for others) and SHA-1 digests of block and
payload. Of records with equal payloads of at least ``REVISIT_BYTES`` bytes the
one with the largest document id stays a response; the others become ``revisit``
records that refer to it and keep their HTTP header only.

Archives are read and written by Spark's text source with a record separator, byte
for byte, so they can be on any store Spark reaches. They are compressed with
gzip, so a file is one stream, read in order record by record: memory is bounded
by one record, not by the file. A record that holds the separator is put together
again by its declared length.

Defined cases: a null payload is empty; a null url is written as ``-`` and blanks
in urls are percent-encoded; a null document id is written as an empty header and
read back as null, and never wins over another id; records that repeat an id and
a payload are written each, the first in archive order being the response; a
shorter date is padded with zeros (months and days with 01); a record whose declared
length goes past the end of its file fails; an empty table gives archives without
documents.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mercadia.llm.common import scratch, staged

REVISIT_BYTES = 1000
#: The HTTP header that carries a page's id through the archives.
ID_HEADER = "X-Document-Id"
#: ARC files are rolled after so many records.
ARC_RECORDS = 5000
WARC_MARK = "WARC/1.0\r\n"
CRLF2 = b"\r\n\r\n"
# The field lists of the two ARC versions.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
RECORDS = ("file string, place long, version int, url string, ip string, date string, mime string, "
           "kind string, doc_id long, header binary, payload binary")


# -- ARC ---------------------------------------------------------------------

def write_arc(pages: DataFrame, doc_id: str, url: str, html: str, folder: str) -> None:
    """Write (doc_id, url, html) as ARC records; files alternate between the versions.

    Dates are made from the id: the table has none.
    """
    payload = F.coalesce(F.col(html).cast("binary"), F.lit("").cast("binary"))
    ident = F.coalesce(F.col(doc_id).cast("string"), F.lit(""))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + ID_HEADER + ": "),
                    ident, F.lit("\r\nContent-Length: "), F.octet_length("body").cast("string"),
                    F.lit("\r\n\r\n"))
    rows = (pages.select(payload.alias("body"), ident.alias("ident"), F.col(doc_id),
                         F.coalesce(F.nullif(F.regexp_replace(
                             F.coalesce(F.col(url), F.lit("")), r"\s", "%20"), F.lit("")), F.lit("-")).alias("url"))
            .withColumn("content", F.concat(http.cast("binary"), "body"))
            .withColumn("at", F.monotonically_increasing_id()))
    inside = F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    file = F.shiftright("at", 33) + F.floor(inside / ARC_RECORDS)
    stamp = F.date_format(F.timestamp_seconds(
        F.lit(1_100_000_000) + F.pmod(F.coalesce(F.col(doc_id), F.lit(0)), F.lit(100_000_000))), "yyyyMMddHHmmss")
    size = F.octet_length("content").cast("string")
    lines = {1: F.concat_ws(" ", "url", F.lit("0.0.0.0"), stamp, F.lit("text/html"), size),
             2: F.concat_ws(" ", "url", F.lit("0.0.0.0"), stamp, F.lit("text/html"), F.lit("200"), F.lit("-"),
                            F.lit("-"), F.lit("0"), F.lit("pages.arc"), size)}
    blocks = {}
    for version, names in ARC_FIELDS.items():
        text = f"{version} 0 mercadia\n{names}\n"
        extra = "" if version == 1 else " 200 - - 0 pages.arc"
        blocks[version] = f"filedesc://pages.arc 0.0.0.0 20041109000000 text/plain{extra} {len(text)}\n{text}\n"

    def by_version(one: Column, two: Column) -> Column:
        return F.when(F.pmod(file, F.lit(2)) == 0, one).otherwise(two)

    opening = F.when(F.pmod(inside, F.lit(ARC_RECORDS)) == 0,
                     by_version(F.lit(blocks[1]), F.lit(blocks[2]))).otherwise(F.lit(""))
    record = F.concat(opening.cast("binary"), by_version(lines[1], lines[2]).cast("binary"),
                      F.lit("\n").cast("binary"), "content")
    (rows.select(record.cast("string").alias("value"))
     .write.option("lineSep", "\n").option("compression", "gzip").option("maxRecordsPerFile", ARC_RECORDS)
     .option("zlib.compress.level", "BEST_SPEED").text(folder))


class ArcReader:
    """Records of one ARC file from its lines (without their line feeds)."""

    def __init__(self, file: str):
        self.file, self.place, self.version = file, 0, 1
        self.fields: list[bytes] | None = None
        self.need = -1
        self.parts: list[bytes] = []

    def feed(self, line: bytes) -> dict | None:
        """Take the next line; the record that it ends, if any."""
        if self.fields is None:
            if line == b"":                     # the line feed after a record
                return None
            self.fields = line.split(b" ")
            if len(self.fields) not in (5, 10):
                raise ValueError(f"{self.file}: not an ARC header: {line[:80]!r}")
            self.need = int(self.fields[-1])
            self.parts = []
            self.got = -1                       # line feeds only stand between lines
            if self.need == 0:
                return self._end(b"")
            return None
        self.parts.append(line)
        self.got += len(line) + 1
        if self.got < self.need:
            return None
        data = b"\n".join(self.parts)
        if len(data) > self.need and data[self.need:] != b"":
            raise ValueError(f"{self.file}: record {self.place} is longer than declared")
        return self._end(data)

    def _end(self, data: bytes) -> dict:
        fields, self.fields = self.fields, None
        url = fields[0].decode("utf-8", "replace")
        if url.startswith("filedesc:"):
            self.version = int(data.split(b" ", 1)[0] or 1)
        header, payload = b"", data
        kind = "resource"
        if url.startswith("filedesc:"):
            kind = "warcinfo"
        elif data[:5] == b"HTTP/" and CRLF2 in data:
            kind = "response"
            header, payload = data.split(CRLF2, 1)
            header += CRLF2
        place, self.place = self.place, self.place + 1
        return {"file": self.file, "place": place, "version": self.version, "url": url,
                "ip": fields[1].decode("ascii", "replace"), "date": fields[2].decode("ascii", "replace"),
                "mime": fields[3].decode("ascii", "replace"), "kind": kind,
                "doc_id": http_id(header), "header": header, "payload": payload}

    def close(self) -> None:
        if self.fields is not None:
            raise ValueError(f"{self.file}: the last record is shorter than declared")


def http_id(header: bytes) -> int | None:
    found = re.search(rb"(?mi)^" + ID_HEADER.encode() + rb": *(-?\d+)\r$", header)
    return int(found[1]) if found else None


def streams(batches: Iterable[pa.RecordBatch], reader) -> Iterator[dict]:
    """Records of (file, value) rows; a file's rows come together and in order."""
    now = None
    for batch in batches:
        for file, value in zip(batch.column(0), batch.column(1)):
            file = file.as_py()
            if now is None or file != now.file:
                if now is not None:
                    yield from filter(None, [now.close()])
                now = reader(file)
            done = now.feed(value.as_py())
            if done is not None:
                yield done
    if now is not None:
        yield from filter(None, [now.close()])


def batched(records: Iterator[dict], schema: pa.Schema, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for r in records:
        held.append(r)
        size += 200 + sum(len(v) for v in r.values() if isinstance(v, bytes))
        if size > limit:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def read_arc(spark: SparkSession, folder: str) -> DataFrame:
    """Records of all ARC files of a folder (``RECORDS``)."""
    lines = spark.read.option("lineSep", "\n").text(folder).select(
        F.col("_metadata.file_name").alias("file"), F.col("value").cast("binary").alias("value"))
    schema = pa.schema([("file", pa.string()), ("place", pa.int64()), ("version", pa.int32()), ("url", pa.string()),
                        ("ip", pa.string()), ("date", pa.string()), ("mime", pa.string()), ("kind", pa.string()),
                        ("doc_id", pa.int64()), ("header", pa.binary()), ("payload", pa.binary())])
    return lines.mapInArrow(lambda b: batched(streams(b, ArcReader), schema), RECORDS)


# -- conversion ----------------------------------------------------------------

def timestamp(date: Column) -> Column:
    """A 14-digit date, or its beginning, as an ISO timestamp."""
    full = F.concat(date, F.substring(F.lit("00000101000000"), F.length(date) + 1, F.lit(14)))
    part = [F.substring(full, a, n) for a, n in ((1, 4), (5, 2), (7, 2), (9, 2), (11, 2), (13, 2))]
    return F.concat(part[0], F.lit("-"), part[1], F.lit("-"), part[2], F.lit("T"), part[3], F.lit(":"),
                    part[4], F.lit(":"), part[5], F.lit("Z"))


def record_id(file: Column, place: Column) -> Column:
    """From the number of the file and the record's place in it: the rest of a file's name is
    another at every run."""
    number = F.coalesce(F.nullif(F.regexp_extract(file, r"part-(\d+)", 1), F.lit("")), file)
    h = F.sha1(F.concat_ws(" ", number, place.cast("string")).cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"),
                    F.substring(h, 14, 3), F.lit("-8"), F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12),
                    F.lit(">"))


def originals(records: DataFrame) -> DataFrame:
    """(digest, original): the response that equal payloads refer to, for payloads that
    more than one record has. One small row per such payload."""
    light = records.where("kind = 'response'").where(F.octet_length("payload") >= REVISIT_BYTES).select(
        F.sha1("payload").alias("digest"),
        # larger id first, then the earlier place
        F.struct(F.coalesce(-F.col("doc_id"), F.lit((1 << 63) - 1)).alias("rank"), "file", "place", "doc_id",
                 "url", "date").alias("original"))
    return (light.groupBy("digest").agg(F.min("original").alias("original"), F.count(F.lit(1)).alias("n"))
            .where("n > 1").select("digest", "original"))


def convert(spark: SparkSession, arc_folder: str, warc_folder: str) -> None:
    """Write the WARC equivalent of every record of the ARC files.

    The originals are found from digests alone and written first; the join with
    them is a broadcast only if that table's size on disk allows it, else a
    sort-merge join whose hot payloads Spark splits.
    """
    records = read_arc(spark, arc_folder)
    first = staged(originals(records), "warc-originals")
    joined = (records.withColumn("digest", F.sha1("payload"))
              .join(first, "digest", "left")
              .withColumn("revisit", F.coalesce(
                  (F.col("kind") == "response") & F.col("original").isNotNull()
                  & (F.octet_length("payload") >= REVISIT_BYTES)
                  & ~((F.col("file") == F.col("original.file")) & (F.col("place") == F.col("original.place"))),
                  F.lit(False))))
    block = F.when(F.col("revisit"), F.col("header")).otherwise(F.concat("header", "payload"))

    def line(name: str, value) -> Column:
        return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))

    def only(condition: Column, value) -> Column:
        return F.when(condition, value)

    kind = F.when(F.col("revisit"), F.lit("revisit")).otherwise(F.col("kind"))
    http = F.col("kind") == "response"
    head = F.concat(
        F.lit(WARC_MARK), line("WARC-Type", kind),
        line("WARC-Record-ID", record_id(F.col("file"), F.col("place"))),
        line("WARC-Date", timestamp(F.col("date"))),
        line("WARC-Target-URI", only(F.col("kind") != "warcinfo", F.col("url"))),
        line("WARC-IP-Address", only(http, F.col("ip"))),
        line("WARC-Payload-Digest", only(http, F.concat(F.lit("sha1:"), "digest"))),
        line("WARC-Block-Digest", F.concat(F.lit("sha1:"), F.sha1("block"))),
        line("WARC-Profile", only(F.col("revisit"), F.lit(
            "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"))),
        line("WARC-Refers-To", only(F.col("revisit"), record_id(F.col("original.file"), F.col("original.place")))),
        line("WARC-Refers-To-Target-URI", only(F.col("revisit"), F.col("original.url"))),
        line("WARC-Refers-To-Date", only(F.col("revisit"), timestamp(F.col("original.date")))),
        line("X-Refers-To-Document-Id", only(F.col("revisit"), F.col("original.doc_id").cast("string"))),
        line("Content-Type", F.when(http, F.lit("application/http; msgtype=response"))
             .when(F.col("kind") == "warcinfo", F.lit("application/warc-fields")).otherwise(F.col("mime"))),
        line("Content-Length", F.octet_length("block").cast("string")), F.lit("\r\n"))
    out = joined.withColumn("block", block).select(
        F.concat(head.cast("binary"), F.col("block")).cast("string").alias("value"))
    (out.write.option("lineSep", CRLF2.decode()).option("compression", "gzip")
     .option("zlib.compress.level", "BEST_SPEED").text(warc_folder))


# -- WARC ----------------------------------------------------------------------

class WarcReader:
    """Records of one WARC file from the pieces between its ``WARC_MARK`` strings."""

    mark = WARC_MARK.encode()

    def __init__(self, file: str):
        self.file = file
        self.held: list[bytes] = []     # pieces of a record whose block holds the mark
        self.size = self.need = 0
        self.first = True

    def feed(self, piece: bytes) -> dict | None:
        if self.first:              # what stands before the first mark: nothing
            self.first = False
            return None
        if not self.held:           # a record's first piece has its whole header, which cannot hold the mark
            self.at = piece.find(CRLF2)
            if self.at < 0:
                raise ValueError(f"{self.file}: a record without the end of its header")
            self.fields = dict(x.split(b": ", 1) for x in piece[:self.at].split(b"\r\n"))
            self.need = self.at + 4 + int(self.fields[b"Content-Length"]) + 4
            self.size = -len(self.mark)
        self.held.append(piece)
        self.size += len(self.mark) + len(piece)
        if self.size < self.need:       # the mark stood inside the block
            return None
        data, self.held = self.mark.join(self.held), []
        at, fields = self.at, self.fields
        block = data[at + 4:self.need - 4]
        header, payload = b"", block
        kind = fields[b"WARC-Type"].decode()
        if block[:5] == b"HTTP/":
            header, payload = block.split(CRLF2, 1)
            header += CRLF2
        length = len(payload)
        digest = hashlib.sha1(payload).hexdigest()
        told = fields.get(b"WARC-Payload-Digest", b"").decode().removeprefix("sha1:")
        if kind == "revisit":
            length = int(re.search(rb"(?mi)^Content-Length: *(\d+)\r$", header)[1])
            digest = told
        elif told and told != digest:
            raise ValueError(f"{self.file}: payload digest differs")
        refers = fields.get(b"X-Refers-To-Document-Id")
        return {"record_id": fields[b"WARC-Record-ID"].decode(), "record_type": kind,
                "date": fields[b"WARC-Date"].decode(),
                "url": fields[b"WARC-Target-URI"].decode() if b"WARC-Target-URI" in fields else None,
                "doc_id": http_id(header), "payload": payload, "payload_bytes": length,
                "payload_digest": digest, "refers_to_id": (fields.get(b"WARC-Refers-To") or b"").decode() or None,
                "refers_to": int(refers) if refers else None}

    def close(self) -> None:
        if self.held:
            raise ValueError(f"{self.file}: the last record is shorter than declared")


def read_warc(spark: SparkSession, folder: str) -> DataFrame:
    """Records of all WARC files of a folder; a revisit's length and digest are its original's."""
    pieces = spark.read.option("lineSep", WARC_MARK).text(folder).select(
        F.col("_metadata.file_name").alias("file"), F.col("value").cast("binary").alias("value"))
    schema = pa.schema([("record_id", pa.string()), ("record_type", pa.string()), ("date", pa.string()),
                        ("url", pa.string()), ("doc_id", pa.int64()), ("payload", pa.binary()),
                        ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                        ("refers_to_id", pa.string()), ("refers_to", pa.int64())])
    return pieces.mapInArrow(
        lambda b: batched(streams(b, WarcReader), schema),
        "record_id string, record_type string, date string, url string, doc_id long, payload binary, "
        "payload_bytes long, payload_digest string, refers_to_id string, refers_to long")


def through_archives(pages: DataFrame, doc_id: str, url: str, html: str) -> DataFrame:
    """Write ``pages`` as ARC, convert to WARC and read the WARC files back."""
    spark = pages.sparkSession
    arc, warc = scratch(spark, "arc"), scratch(spark, "warc")
    write_arc(pages, doc_id, url, html, arc)
    convert(spark, arc, warc)
    return read_warc(spark, warc).where("record_type <> 'warcinfo'")
