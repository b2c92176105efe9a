"""Legacy archive converter: ARC to WARC.

Pages are written as ARC archives (version 1 or 2 header lines), converted, and read back:

* ``write_arcs``: pages to ARC files. * ``read_arcs``: header lines by the version the archive declares, contents by
  declared length. * ``write_warcs``: WARC records with identifiers, timestamps, types and digests made from those.
* ``read_warcs``: the records of WARC files, by declared length.

Files are written and read by Spark, so they may lie in any store it knows. A file has at most ``FILE_CHUNKS`` chunks
of ``CHUNK_BYTES`` (or one longer record each) and is compressed with gzip: a task holds a file at a time, not more.

Of records with equal payloads of at least ``least_bytes``, that with the largest page_id is the response and the
others are revisits of it; a digest is compared with its largest page_id only, and only those two are shuffled before
the join.

Cases: a null html is an empty payload; a null url becomes ``urn:absent``; blanks and control characters of urls are
percent-encoded in header lines; rows that share the largest page_id (repeated rows) are all responses, as are rows
without a page_id that equal no row with one; payloads may hold anything, record headers included. Empty table: no
records. Only page_id, url and html are read. A file that breaks off inside a record raises an error.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.session import materialize, shared_path

CHUNK_BYTES, FILE_CHUNKS = 4 << 20, 8
ARC_DATE = "20240131000000"
# The field lists of the two versions of ARC header lines.
FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BLANK = re.compile(rb"[\x00-\x20\x7f]")


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def arc_opening(version: int, name: str) -> bytes:
    body = f"{version} 0 foliant\n{FIELDS[version]}\n".encode()
    tail = {1: "", 2: f" 200 - - 0 {name}"}[version]
    return f"filedesc://{name} 0.0.0.0 {ARC_DATE} text/plain{tail} {len(body)}\n".encode() + body


def arc_record(version: int, page_id: int | None, url: bytes, payload: bytes) -> bytes:
    mark = b"" if page_id is None else b"X-Page-Id: %d\r\n" % page_id
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n%sContent-Length: %d\r\n\r\n" % (mark, len(payload))
    url = BLANK.sub(lambda m: b"%%%02X" % m[0][0], url) or b"urn:absent"
    middle = b"" if version == 1 else b" 200 - - 0 pages.arc"
    line = b"%s 0.0.0.0 %s text/html%s %d\n" % (url, ARC_DATE.encode(), middle, len(http) + len(payload))
    return line + http + payload


def in_chunks(records: Iterator[bytes], opening: bytes, between: bytes) -> Iterator[bytes]:
    """Records joined to chunks, each after an opening record."""
    held, size = [opening], len(opening)
    for record in records:
        if len(held) > 1 and size + len(record) > CHUNK_BYTES:
            yield between.join(held)
            held, size = [opening], len(opening)
        held.append(record)
        size += len(record)
    if len(held) > 1:
        yield between.join(held)


def save(chunks: DataFrame, path: str, between: str) -> None:
    text = chunks.select(F.col("chunk").cast("string"))
    text.write.option("lineSep", between).option("maxRecordsPerFile", FILE_CHUNKS).option("compression", "gzip").text(path)


def plain(data: bytes) -> bytes:
    """The content of a file, which may be compressed."""
    return gzip.decompress(data) if data.startswith(b"\x1f\x8b") else data


def write_arcs(pages: DataFrame, path: str, version: int = 1) -> None:
    """``pages`` (page_id, url, html) to ARC files in ``path``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def records() -> Iterator[bytes]:
            for batch in batches:
                url, html = (batch.column(i).cast(pa.binary()) for i in (1, 2))
                for i, page_id in enumerate(batch.column(0).to_pylist()):
                    yield arc_record(version, page_id, url[i].as_py() or b"", html[i].as_py() or b"")

        for chunk in in_chunks(records(), arc_opening(version, "pages.arc"), b"\n"):
            yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.binary())], names=["chunk"])

    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    save(rows.mapInArrow(run, "chunk binary"), path, "\n")


def parse_arc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (by the names of the declared version) and content of each record of ARC archives in a row."""
    at, names = 0, FIELDS[1].split()
    while True:
        while data[at : at + 1] in (b"\n", b"\r"):
            at += 1
        if at >= len(data):
            return
        end = data.index(b"\n", at)
        line = data[at:end]
        if line.startswith(b"filedesc://"):
            length = int(line.rpartition(b" ")[2])
            lines = data[end + 1 : end + 1 + length].decode().splitlines()
            names = FIELDS[int(lines[0].split()[0])].split()
            at = end + 1 + length
            continue
        fields = line.decode("utf-8", "replace").rsplit(" ", len(names) - 1)
        if len(fields) != len(names):
            raise ValueError(f"header line of {len(fields)} fields, {len(names)} declared")
        header = dict(zip(names, fields))
        at = end + 1 + int(header["Archive-length"])
        if at > len(data):
            raise ValueError("archive ends inside a record")
        yield header, data[end + 1 : at]


def http_parts(block: bytes) -> tuple[bytes, dict[str, str], bytes]:
    """Head with its blank line, its fields in lower case, and the payload."""
    head, gap, payload = block.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")[1:]
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    return head + gap, fields, payload


def read_arcs(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """page_id, digest and, with ``payloads``, url, arc_date, head, payload of each record."""
    schema = pa.schema([("page_id", pa.int64()), ("digest", pa.string())])
    if payloads:
        schema = pa.schema([*schema, ("url", pa.string()), ("arc_date", pa.string()), ("head", pa.binary()), ("payload", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file in batch.column(0):
                rows, size = [], 0
                for header, block in parse_arc(plain(file.as_py())):
                    head, fields, payload = http_parts(block)
                    page_id = int(fields["x-page-id"]) if "x-page-id" in fields else None
                    row = {"page_id": page_id, "digest": payload_digest(payload)}
                    if payloads:
                        row |= {"url": header["URL"], "arc_date": header["Archive-date"], "head": head, "payload": payload}
                        size += len(payload)
                    rows.append(row)
                    if size > CHUNK_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, size = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema)

    kinds = "page_id bigint, digest string" + ", url string, arc_date string, head binary, payload binary" * payloads
    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, kinds)


def record_id(digest: str, page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{digest}/{page_id}')}>"


def warc_record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    lines = [*fields, ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines).encode() + b"\r\n" + block + b"\r\n\r\n"


def converted(row: dict) -> bytes:
    """One ARC record, with its ``keeper`` (the page it repeats, else null), as a WARC record."""
    d, revisit = row["arc_date"], row["keeper"] is not None
    block = row["head"] if revisit else row["head"] + row["payload"]
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", record_id(row["digest"], row["page_id"])),
        ("WARC-Date", f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"),
        ("WARC-Target-URI", row["url"]),
        ("WARC-Payload-Digest", f"sha1:{row['digest']}"),
        ("WARC-Block-Digest", f"sha1:{payload_digest(block)}"),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    if revisit:
        fields += [
            ("WARC-Profile", REVISIT),
            ("WARC-Refers-To", record_id(row["digest"], row["keeper"])),
            ("X-Refers-To-Page", str(row["keeper"])),
        ]
    return warc_record(fields, block)


def write_warcs(spark: SparkSession, arc_path: str, path: str, least_bytes: int = 0) -> None:
    """The ARC files in ``arc_path`` as WARC files in ``path``."""
    light = read_arcs(spark, arc_path, payloads=False)
    twins = materialize(
        light.groupBy("digest").agg(F.max("page_id").alias("largest"), F.count("*").alias("n")).where("n > 1 and largest is not null")
        .select(F.col("digest").alias("twin"), "largest"),
        "warc-twins",
    )
    rows = read_arcs(spark, arc_path)
    repeats = (F.coalesce(F.col("page_id") < F.col("largest"), F.col("largest").isNotNull())) & (
        F.length("payload") >= least_bytes
    )
    marked = rows.join(twins, rows["digest"] == twins["twin"], "left").select(
        "page_id", "digest", "url", "arc_date", "head", "payload", F.when(repeats, F.col("largest")).alias("keeper")
    )
    info = warc_record(
        [("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id("warcinfo", None)), ("WARC-Date", "2024-01-31T00:00:00Z"),
         ("Content-Type", "application/warc-fields")],
        b"software: foliant\r\nformat: WARC File Format 1.1\r\n",
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def records() -> Iterator[bytes]:
            for batch in batches:
                for i in range(batch.num_rows):
                    yield converted(batch.slice(i, 1).to_pylist()[0])

        for chunk in in_chunks(records(), info, b""):
            yield pa.RecordBatch.from_arrays([pa.array([chunk[:-2]], pa.binary())], names=["chunk"])

    save(marked.mapInArrow(run, "chunk binary"), path, "\r\n")


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Named fields (in lower case) and block of each record."""
    at = 0
    while at < len(data):
        if not data.startswith(b"WARC/", at):
            raise ValueError(f"no record at byte {at}")
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode("utf-8", "replace").split("\r\n")[1:]
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        start = end + 4
        at = start + int(fields["content-length"])
        if at + 4 > len(data):
            raise ValueError("archive ends inside a record")
        yield fields, data[start:at]
        at += 4


def read_warcs(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, record_id, url of each page's record.

    Length and digest of a response are those of the payload read; those of a revisit are what its head declares.
    """
    schema = pa.schema([
        ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()),
        ("refers_to", pa.int64()), ("record_id", pa.string()), ("url", pa.string()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file in batch.column(0):
                rows = []
                for fields, block in parse_warc(plain(file.as_py())):
                    kind = fields["warc-type"]
                    if kind == "warcinfo":
                        continue
                    _, http, payload = http_parts(block)
                    seen, page = kind == "response", fields.get("x-refers-to-page")
                    rows.append({
                        "page_id": int(http["x-page-id"]) if "x-page-id" in http else None,
                        "payload_bytes": len(payload) if seen else int(http["content-length"]),
                        "payload_digest": payload_digest(payload) if seen else fields["warc-payload-digest"].removeprefix("sha1:"),
                        "record_type": kind, "refers_to": int(page) if page else None,
                        "record_id": fields["warc-record-id"], "url": fields["warc-target-uri"],
                    })
                yield pa.RecordBatch.from_pylist(rows, schema)

    kinds = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, record_id string, url string"
    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, kinds)


def archive_pages(pages: DataFrame, version: int = 1, least_bytes: int = 0) -> DataFrame:
    """Writes the pages as ARC, converts them to WARC, and reads that back: one row for each page."""
    spark = pages.sparkSession
    arcs, warcs = shared_path(spark, "arc"), shared_path(spark, "warc")
    write_arcs(pages, arcs, version)
    write_warcs(spark, arcs, warcs, least_bytes)
    return read_warcs(spark, warcs)
