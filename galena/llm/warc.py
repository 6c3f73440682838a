"""Legacy archive converter: ARC files, versions 1 and 2, to WARC.

An ARC file starts with a version block that says which fields its header lines
have; each record is such a line, a body of the declared length and a line end.
The converter parses lines by that version, and synthesises what WARC wants and
ARC lacks: a record identifier (from line, HTTP head and payload digest, so a
rerun gives the same), an ISO timestamp, a record type, block and payload
digests.  A record whose payload another record holds becomes a revisit.

Archives travel as rows (name, archive): whole file images of bounded size, so
executors read and write them in any store Spark knows.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator, Mapping
from datetime import datetime
from typing import NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from galena.llm.scratch import Scratch

ARCHIVE_BYTES = 4 << 20
#: Payloads below this many bytes are never made revisits.
REVISIT_BYTES = 100
PAGE_HEADER = "X-Page-Id"
#: Names of the fields of header lines, by version (fixed values of the format).
FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"


class ArcRecord(NamedTuple):
    fields: dict[str, str]
    body: bytes

    @property
    def head(self) -> bytes:
        """The HTTP head with its empty line; empty for other bodies."""
        if not self.body.startswith(b"HTTP/"):
            return b""
        head, line, _ = self.body.partition(b"\r\n\r\n")
        return head + line

    @property
    def payload(self) -> bytes:
        return self.body[len(self.head) :]


def _clean(url: str) -> str:
    """Header lines are split at spaces, so an URL must have none."""
    return "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url) or "about:blank"


def write_arc(records: list[ArcRecord], version: int, name: str, date: str) -> bytes:
    block = f"{version} 0 galena\n{FIELDS[version]}\n\n".encode()
    lead = {"URL": f"filedesc://{name}", "IP-address": "0.0.0.0", "Archive-date": date, "Content-type": "text/plain", "Result-code": "200", "Filename": name}
    out = io.BytesIO()
    for fields, body in [(lead, block), *records]:
        known = {**fields, "Archive-length": str(len(body)), "Offset": str(out.tell())}
        line = " ".join(known.get(field) or "-" for field in FIELDS[version].split())
        out.write(line.encode() + b"\n" + body + b"\n")
    return out.getvalue()


def read_arc(raw: bytes, lead: bool = False) -> Iterator[ArcRecord]:
    """The records after the version block, with ``lead`` that one first. Raises ValueError where lengths or lines are wrong."""
    if raw[:2] == b"\x1f\x8b":
        raw = gzip.decompress(raw)
    at, version = 0, 0
    while at < len(raw):
        if raw[at : at + 1] in b"\r\n":  # more line ends than the format asks for
            at += 1
            continue
        end = raw.find(b"\n", at)
        line = raw[at : end if end >= 0 else len(raw)].decode(errors="replace").rstrip("\r")
        names = FIELDS[version or 1].split()
        values = line.rsplit(" ", len(names) - 1)
        if not version and line.startswith("filedesc://") and len(line.split(" ")) == len(FIELDS[2].split()):
            names, values = FIELDS[2].split(), line.split(" ")
        if end < 0 or len(values) != len(names) or not values[-1].isdigit():
            raise ValueError(f"no header line at byte {at}")
        body = raw[end + 1 : end + 1 + int(values[-1])]
        if len(body) < int(values[-1]):
            raise ValueError(f"the record at byte {at} is cut off")
        at = end + 1 + len(body)
        if not version:
            if not line.startswith("filedesc://"):
                raise ValueError("no version block")
            version = int(body.split(b" ", 1)[0])
            if version not in FIELDS:
                raise ValueError(f"unknown version {version}")
            if not lead:
                continue
        yield ArcRecord(dict(zip(names, values, strict=True)), body)


def record_id(url: str, date: str, head: bytes, digest: str) -> str:
    seed = b"\0".join([url.encode(), date.encode(), head, digest.encode()])
    return f"urn:uuid:{uuid.UUID(bytes=hashlib.sha256(seed).digest()[:16], version=5)}"


def _iso(date: str) -> str:
    """An ARC date of 4 to 14 digits as WARC wants it; what it lacks is the first month, day, hour, minute and second."""
    if not date.isascii() or not date.isdigit() or len(date) < 4 or len(date) % 2:
        raise ValueError(f"no date: {date!r}")
    full = date[:14] + "00000101000000"[len(date[:14]) :]
    return datetime.strptime(full, "%Y%m%d%H%M%S").isoformat() + "Z"


def _warc(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", str(len(block)))])
    return gzip.compress(f"WARC/1.0\r\n{lines}\r\n".encode() + block + b"\r\n\r\n", 4, mtime=0)


def convert(arc: bytes, name: str, first: Mapping[str, list[str]]) -> bytes:
    """A WARC file of the ARC file's records, one gzip member each.

    warcinfo has the date of the version block.  Raises ValueError where a date isn't one.
    ``first`` maps payload digests that several records have to the identifiers
    of those that keep the payload; revisits refer to the first of them.
    """
    members = []
    version_block, *records = read_arc(arc, lead=True)
    for record in records:
        url, date, digest = record.fields["URL"], record.fields["Archive-date"], hashlib.sha256(record.payload).hexdigest()
        own = record_id(url, date, record.head, digest)
        keepers = first.get(digest, [own])
        kind = "revisit" if own not in keepers else "response" if record.head else "resource"
        block = record.head if kind == "revisit" else record.body
        headers = [("WARC-Type", kind), ("WARC-Record-ID", f"<{own}>"), ("WARC-Date", _iso(date)), ("WARC-Target-URI", url)]
        if record.fields["IP-address"] not in ("-", "0.0.0.0"):
            headers.append(("WARC-IP-Address", record.fields["IP-address"]))
        if kind == "revisit":
            headers += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<{keepers[0]}>")]
        headers += [("WARC-Payload-Digest", f"sha256:{digest}"), ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}")]
        headers.append(("Content-Type", "application/http; msgtype=response" if record.head else record.fields["Content-type"]))
        members.append(_warc(headers, block))
    info = f"software: galena\r\nformat: WARC File Format 1.0\r\nconverted-from: {name}\r\n".encode()
    lead = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<{record_id(name, '', info, '')}>"), ("WARC-Date", _iso(version_block.fields["Archive-date"])), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")]
    return b"".join([_warc(lead, info), *members])


def read_warc(raw: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of a WARC file with a gzip member a record."""
    at, step = 0, 1 << 16
    while at < len(raw):
        member, parts = zlib.decompressobj(31), []
        while not member.eof and at < len(raw):
            parts.append(member.decompress(raw[at : at + step]))
            at += min(step, len(raw) - at)
        if not member.eof:
            raise ValueError("the archive is cut off")
        at -= len(member.unused_data)
        data = b"".join(parts)
        head, _, rest = data.partition(b"\r\n\r\n")
        version, *lines = head.decode().split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError("no WARC record")
        headers = dict(line.split(": ", 1) for line in lines)
        yield headers, rest[: int(headers["Content-Length"])]


def _http(head: bytes) -> dict[str, str]:
    lines = head.decode(errors="replace").split("\r\n")[1:]
    return dict(line.split(": ", 1) for line in lines if ": " in line)


def page_record(page_id: int | None, url: str | None, html: bytes, date: str) -> ArcRecord:
    page = "" if page_id is None else f"{PAGE_HEADER}: {page_id}\r\n"
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{page}Content-Length: {len(html)}\r\n\r\n".encode()
    fields = {"URL": _clean(url or ""), "IP-address": "0.0.0.0", "Archive-date": date, "Content-type": "text/html", "Result-code": "200"}
    return ArcRecord(fields, head + html)


def page_archives(pages: DataFrame, date: str = "20000101000000") -> DataFrame:
    """name, archive: ``pages`` (page_id, url, html) as ARC files, converted to WARC.

    Of payloads of REVISIT_BYTES or more that are equal, the row of the smallest
    page_id (null last) stays a response; the others become revisits.  Repeated
    rows of that page_id all stay.  A null html is empty, a null url about:blank.
    """
    spark = pages.sparkSession
    html = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8")
    rows = pages.select("page_id", F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), html.alias("raw"))
    rows = rows.withColumn("digest", F.sha2("raw", 256)).withColumn("size", F.octet_length("raw"))
    best = F.min(F.struct(F.col("page_id").isNull().alias("no_id"), "page_id", "url")).alias("best")
    shared = rows.filter(F.col("size") >= REVISIT_BYTES).groupBy("digest", "size").agg(best, F.count(F.lit(1)).alias("n")).filter("n > 1")
    shared = Scratch(spark, "warc").keep("shared", shared.select("digest", F.struct("best.page_id", "best.url").alias("keeper")))
    rows = rows.join(shared, "digest", "left").select("page_id", "url", "raw", "digest", "keeper")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, size = TaskContext.get().partitionId(), 0, 0
        records: list[ArcRecord] = []
        first: dict[str, list[str]] = {}

        def closed() -> pa.RecordBatch:
            version = 1 + (part + seq) % 2
            name = f"pages-{part:06d}-{seq:06d}"
            arc = write_arc(records, version, f"{name}.arc", date)
            return pa.RecordBatch.from_arrays([pa.array([f"{name}.warc.gz"]), pa.array([convert(arc, f"{name}.arc", first)], pa.binary())], names=["name", "archive"])

        for batch in batches:
            for page_id, url, raw, digest, keeper in zip(*(column for column in batch.columns), strict=True):
                record = page_record(page_id.as_py(), url.as_py(), raw.as_py(), date)
                if (same := keeper.as_py()) is not None:  # the size of an equal payload is this one's
                    kept = page_record(same["page_id"], same["url"], record.payload, date)
                    keepers = first.setdefault(digest.as_py(), [record_id(kept.fields["URL"], date, kept.head, digest.as_py())])
                    if same["page_id"] == page_id.as_py():  # repeated rows may differ in url
                        keepers.append(record_id(record.fields["URL"], date, record.head, digest.as_py()))
                records.append(record)
                size += len(record.body)
                if size >= ARCHIVE_BYTES:
                    yield closed()
                    records, first, size, seq = [], {}, 0, seq + 1
        if records:
            yield closed()

    return rows.mapInArrow(run, "name string, archive binary")


def read_pages(spark: SparkSession, path: str, scratch: Scratch) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, target_uri of the archives under ``path``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive in batch.column(0):
                columns: list[list] = [[] for _ in range(7)]
                for headers, block in read_warc(archive.as_py()):
                    kind = headers["WARC-Type"]
                    if kind == "warcinfo":
                        continue
                    head, line, payload = block.partition(b"\r\n\r\n")
                    http = _http(head)
                    said = headers["WARC-Payload-Digest"].removeprefix("sha256:")
                    if kind != "revisit" and hashlib.sha256(payload).hexdigest() != said:
                        raise ValueError(f"{headers['WARC-Record-ID']} has another payload than it says")
                    page = http.get(PAGE_HEADER)
                    size = int(http["Content-Length"]) if kind == "revisit" else len(payload)
                    row = (page and int(page), size, said, kind, headers["WARC-Record-ID"], headers.get("WARC-Refers-To"), headers["WARC-Target-URI"])
                    for column, value in zip(columns, row, strict=True):
                        column.append(value)
                kinds = [pa.int64(), pa.int64(), *[pa.string()] * 5]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "record_id", "refers", "target_uri"]
    fields = "page_id long, payload_bytes long, payload_digest string, record_type string, record_id string, refers string, target_uri string"
    records = scratch.keep("records", spark.read.parquet(path).select("archive").mapInArrow(run, fields))
    kept = records.filter("record_type = 'response'").groupBy("record_id").agg(F.min("page_id").alias("refers_to"))
    wanted = records.filter("refers is not null").select(F.col("refers").alias("record_id")).distinct()
    kept = scratch.keep("kept", kept.join(wanted, "record_id", "left_semi"))
    return records.join(kept, records.refers == kept.record_id, "left").select(*names[:4], "refers_to", "target_uri")
