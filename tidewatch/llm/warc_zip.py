"""WARC records in ZIP packages: written by tasks, read in ranges without extraction.

A package is a ZIP file with two stored members: `archive/data.warc.gz`, one gzip member a record, and
`indexes/index.cdxj`, a line a record with its offset and length. The reader parses the end of central
directory (the ZIP64 one too), the central directory and a member's local header, reads the index,
and then reads records as ranges of the package; ranges next to each other are read at once.

Of records with equal payloads of at least REVISIT_BYTES, the one with the largest id is the response
and the others are revisits of it. Equal payloads meet by digest, with map-side aggregation.
A package has an attempt's own name, and only the manifest of the attempts that ended names packages, so a
repeated or lost task leaves nothing that is read.

Results for odd input: a null payload is empty; rows that repeat id and payload are records of one
kind; a null url is written as an empty one; an empty table gives an empty manifest; other columns aren't
stored; a record that isn't of this form, or a package without the two members, raises an error.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import struct
import uuid
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.shared import filesystem, put, shared_folder, written
from tidewatch.llm.words import pieces

REVISIT_BYTES = 1000
PACKAGE_BYTES = 32 << 20
#: Bytes of a package whose records one task reads, and the largest gap that is read over.
RANGE_BYTES, GAP_BYTES = 4 << 20, 4 << 10
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
DATE = "2024-01-01T00:00:00Z"


def roles(df: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """page_id, digest, size, refers_to of the revisits among page_id, digest and size of payloads."""
    digests = written(df.select("page_id", "digest", "size").where(F.col("size") >= least), "digests")
    largest = digests.groupBy("digest", "size").agg(F.max("page_id").alias("refers_to"), F.min("page_id").alias("other")).where("other <> refers_to").drop("other")
    return digests.join(largest, ["digest", "size"]).where("page_id <> refers_to").select("page_id", "digest", "size", "refers_to").distinct()


def record(page_id: int | None, url: str, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC/1.1 record, gzipped by itself."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    fields = [f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {url}", f"WARC-Payload-Digest: sha1:{digest}"]
    if refers_to is not None:
        fields += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
        payload = b""
    fields += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(head) + len(payload)}"]
    return gzip.compress("\r\n".join(["WARC/1.1", *fields, "", ""]).encode() + head + payload + b"\r\n\r\n", 6, mtime=0)


def parsed(raw: bytes) -> dict:
    """Fields and payload of one record."""
    data = gzip.decompress(raw)
    head, _, block = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines)
    block = block[: int(fields["Content-Length"])]
    payload = block.partition(b"\r\n\r\n")[2]
    page = lambda x: int(x[len("<urn:page:") : -1]) if x and len(x) > len("<urn:page:>") else None
    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    if fields["WARC-Type"] == "response" and hashlib.sha1(payload).hexdigest() != digest:
        raise ValueError("a payload differs from its digest")
    return {"page_id": page(fields["WARC-Record-ID"]), "url": fields["WARC-Target-URI"], "record_type": fields["WARC-Type"], "payload": payload if fields["WARC-Type"] == "response" else None, "payload_digest": digest, "refers_to": page(fields.get("WARC-Refers-To"))}


def package(records: list[tuple[dict, bytes]]) -> bytes:
    """A ZIP package of gzipped records and their index."""
    lines, at = [], 0
    for entry, raw in records:
        lines.append(json.dumps(entry | {"offset": at, "length": len(raw)}))
        at += len(raw)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        for name, data in ((DATA, b"".join(raw for _, raw in records)), (INDEX, ("\n".join(lines) + "\n").encode())):
            z.writestr(zipfile.ZipInfo(name, (2024, 1, 1, 0, 0, 0)), data)
    return out.getvalue()


def members(source) -> dict[str, tuple[int, int]]:
    """Name -> (offset of the data, length) of the stored members of a ZIP file that is open for random reads."""
    size = source.size()
    tail_at = max(0, size - (1 << 16) - 22)
    source.seek(tail_at)
    tail = source.read(size - tail_at)
    end = tail.rfind(b"PK\x05\x06")
    if end < 0:
        raise ValueError("not a ZIP file")
    count, length, start = struct.unpack_from("<HII", tail, end + 10)
    if 0xFFFF == count or 0xFFFFFFFF in (length, start):
        locator = end - 20
        if locator < 0 or tail[locator : locator + 4] != b"PK\x06\x07":
            raise ValueError("no ZIP64 locator")
        (wide,) = struct.unpack_from("<Q", tail, locator + 8)
        source.seek(wide)
        record64 = source.read(56)
        if record64[:4] != b"PK\x06\x06":
            raise ValueError("no ZIP64 directory")
        count, length, start = struct.unpack_from("<QQQ", record64, 32)
    source.seek(start)
    directory = source.read(length)
    found, at = {}, 0
    for _ in range(count):
        if directory[at : at + 4] != b"PK\x01\x02":
            raise ValueError("a broken central directory")
        method, packed, full, name_n, extra_n, comment_n, local = struct.unpack_from("<H8xIIHHH8xI", directory, at + 10)
        name = directory[at + 46 : at + 46 + name_n].decode()
        extra, x = directory[at + 46 + name_n : at + 46 + name_n + extra_n], 0
        while x + 4 <= len(extra):
            kind, n = struct.unpack_from("<HH", extra, x)
            if kind == 1:  # ZIP64: those of the three that don't fit, in this order
                wide, y = [full, packed, local], x + 4
                for i, limit in enumerate((full, packed, local)):
                    if limit == 0xFFFFFFFF:
                        (wide[i],) = struct.unpack_from("<Q", extra, y)
                        y += 8
                full, packed, local = wide
            x += 4 + n
        at += 46 + name_n + extra_n + comment_n
        if method == 0:
            source.seek(local)
            header = source.read(30)
            if header[:4] != b"PK\x03\x04":
                raise ValueError("a broken local header")
            own_name, own_extra = struct.unpack_from("<HH", header, 26)
            found[name] = (local + 30 + own_name + own_extra, packed)
    return found


def write(df: DataFrame, root: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Packages below root; returns their manifest: path, records, bytes."""
    pages = df.select(F.col(id_col).cast("long").alias("page_id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"), F.coalesce(F.col(payload_col), F.lit("")).cast("binary").alias("payload"))
    pages = pages.withColumns({"digest": F.sha1("payload"), "size": F.octet_length("payload")})
    rows = pages.join(roles(pages), ["page_id", "digest", "size"], "left")

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out() -> pa.RecordBatch:
            path, data = f"{root}/{uuid.uuid4().hex}.zip", package(held)
            put(path, [data])
            return pa.record_batch([pa.array([path]), pa.array([len(held)]), pa.array([len(data)])], ["path", "records", "bytes"])

        for batch in pieces(batches, "payload"):
            for page_id, url, payload, refers_to in zip(*(batch.column(x).to_pylist() for x in ("page_id", "url", "payload", "refers_to")), strict=True):
                url = url.replace("\r", "%0D").replace("\n", "%0A")
                raw = record(page_id, url, payload, refers_to)
                held.append(({"page_id": page_id, "url": url}, raw))
                size += len(raw)
                if size >= PACKAGE_BYTES:
                    yield out()
                    held, size = [], 0
        if held:
            yield out()

    return written(rows.mapInArrow(packed, "path string, records long, bytes long"), "manifest")


def index(manifest: DataFrame) -> DataFrame:
    """path, offset (in the package), length of each record of the packages."""

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                files, name = filesystem(path)
                with files.open_input_file(name) as source:
                    found = members(source)
                    source.seek(found[INDEX][0])
                    lines = list(map(json.loads, source.read(found[INDEX][1]).decode().splitlines()))
                yield pa.record_batch([pa.array([path] * len(lines), pa.string()), pa.array([found[DATA][0] + x["offset"] for x in lines], pa.int64()), pa.array([x["length"] for x in lines], pa.int64())], ["path", "offset", "length"])

    return manifest.select("path").repartition("path").mapInArrow(entries, "path string, offset long, length long")


FIELDS = "page_id long, url string, record_type string, payload binary, payload_digest string, refers_to long"


def read(entries: DataFrame) -> DataFrame:
    """The records that index() lists: page_id, url, record_type, payload (null in revisits), payload_digest, refers_to."""

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            todo = list(zip(*(batch.column(x).to_pylist() for x in ("path", "offset", "length")), strict=True))
            at = 0
            while at < len(todo):
                path, start, length = todo[at]
                end, stop = at + 1, start + length
                while end < len(todo) and todo[end][0] == path and stop <= todo[end][1] <= stop + GAP_BYTES and stop - start < RANGE_BYTES:
                    stop, end = todo[end][1] + todo[end][2], end + 1
                files, name = filesystem(path)
                with files.open_input_file(name) as source:
                    source.seek(start)
                    data = source.read(stop - start)
                rows = [parsed(data[o - start : o - start + n]) for _, o, n in todo[at:end]]
                yield pa.RecordBatch.from_pylist(rows, pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload", pa.binary()), ("payload_digest", pa.string()), ("refers_to", pa.int64())]))
                at = end

    block = F.floor(F.col("offset") / RANGE_BYTES)
    return entries.repartition("path", block).sortWithinPartitions("path", "offset").mapInArrow(records, FIELDS)


def round_trip(df: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of df's pages, from the packages that hold them."""
    manifest = write(df, shared_folder(df.sparkSession, "warc"))
    found = written(read(index(manifest)).select("page_id", F.octet_length("payload").cast("long").alias("size"), "payload_digest", "record_type", "refers_to"), "records")
    # a revisit has its payload in the response that it refers to
    wanted = found.select(F.col("refers_to").alias("of"), F.col("payload_digest").alias("with")).where("of is not null").distinct()
    sizes = found.where("record_type = 'response'").select(F.col("page_id").alias("of"), F.col("payload_digest").alias("with"), F.col("size").alias("theirs")).join(wanted, ["of", "with"]).distinct()
    out = found.join(sizes, (found["refers_to"] == sizes["of"]) & (found["payload_digest"] == sizes["with"]), "left")
    return out.select("page_id", F.coalesce("size", "theirs").alias("payload_bytes"), "payload_digest", "record_type", "refers_to")
