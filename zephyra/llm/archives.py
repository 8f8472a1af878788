"""ARC archives, and their conversion to WARC.

An ARC file starts with a version block, whose second line gives the version and whose third line names the fields of all
header lines; a record is a header line, as many bytes as it declares, and a line end. Records become WARC records with made
identifiers, dates, types and digests. A record whose payload equals that of a page with a smaller id becomes a revisit.

Files are written and read by Spark alone, so they may lie in any store. A task holds one file at a time; a file is closed at
``FILE_BYTES``, or after the one record that exceeds them.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime, timedelta
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zephyra.plans.tables import write_out
from zephyra.session import shared_dir

#: Names of the fields in the third line of a version block, by version.
FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
#: Bytes of an ARC file, about, before it is compressed.
FILE_BYTES = 64 << 20
#: Payloads under this size are never revisits.
LEAST_BYTES = 100
#: Up to so many revisits are broadcast to the conversion; more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_ADDRESS, _NO_URL = "0.0.0.0", "unknown:"
_FIRST_DATE = datetime(2020, 1, 1, tzinfo=UTC)


class BadArchive(ValueError):
    """A header line or a length that does not fit the file."""


def _arc_line(version: int, url: str, date: str, kind: str, length: int, offset: int, name: str) -> bytes:
    middle = f"200 - - {offset} {name} " if version == 2 else ""
    return f"{url} {_ADDRESS} {date} {kind} {middle}{length}\n".encode()


def write_arc(pages: DataFrame, path: str, file_bytes: int = FILE_BYTES) -> None:
    """Write ``pages(page_id, url, html)`` as compressed ARC files of about ``file_bytes``, versions 1 and 2 in turn.

    Bytes of a URL that a header line cannot hold are percent-encoded; a null URL is ``unknown:``. A null page is empty, a
    null id has an empty header. The date is made from the id. A partition without pages gives a file without records.
    """

    def files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, files = TaskContext.get().partitionId(), 0
        date = _FIRST_DATE.strftime("%Y%m%d%H%M%S")

        def begin() -> tuple[int, str, list[bytes], int]:
            version, name = 1 + (number + files) % 2, f"part-{number:05d}-{files}.arc"
            block = f"{version} 0 zephyra\n{FIELDS[version]}\n".encode()
            first = _arc_line(version, f"filedesc://{name}", date, "text/plain", len(block), 0, name) + block
            return version, name, [first], len(first) + 1

        def whole(records: list[bytes]) -> pa.RecordBatch:
            content = pa.array([b"\n".join(records)], pa.binary()).cast(pa.string())
            return pa.RecordBatch.from_arrays([content], names=["value"])

        version, name, out, offset = begin()
        for batch in batches:
            for page_id, url, html in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html")), strict=True):
                payload = (html or "").encode()
                http = (
                    "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\n"
                    f"Content-Length: {len(payload)}\r\nX-Page-Id: {'' if page_id is None else page_id}\r\n\r\n"
                )
                when = (_FIRST_DATE + timedelta(seconds=abs(page_id or 0) % 10**9)).strftime("%Y%m%d%H%M%S")
                content = http.encode() + payload
                target = quote(url, safe=":/?#[]@!$&'()*+,;=%-._~") if url else _NO_URL
                if len(out) > 1 and offset + len(content) > file_bytes:
                    yield whole(out)
                    files += 1
                    version, name, out, offset = begin()
                made = _arc_line(version, target, when, "text/html", len(content), offset, name) + content
                offset += len(made) + 1
                out.append(made)
        yield whole(out)

    made = pages.select("page_id", "url", "html").mapInArrow(files, "value string")
    # a row is a file
    whole = made.write.option("maxRecordsPerFile", 1).option("lineSep", "\n").option("compression", "gzip")
    whole.text(path)


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("path", "content")


def _plain(content: bytes) -> bytes:
    """All members of a gzip file."""
    parts = []
    while content:
        member = zlib.decompressobj(31)
        parts.append(member.decompress(content))
        content = member.unused_data
    return b"".join(parts)


def parse_arc(data: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """Offset, header fields and content of each record after the version block. A file without any byte has none."""
    names: list[str] | None = None
    at = 0
    while at < len(data):
        if data[at : at + 1] == b"\n":  # some writers put an empty line before a record
            at += 1
            continue
        end = data.find(b"\n", at)
        if end < 0:
            raise BadArchive(f"header line at {at} does not end")
        values = data[at:end].decode("latin-1").split(" ")
        if not values[-1].isdigit():
            raise BadArchive(f"header line at {at} declares no length")
        content = data[end + 1 : end + 1 + int(values[-1])]
        if len(content) < int(values[-1]):
            raise BadArchive(f"record at {at} declares {values[-1]} bytes, {len(content)} are there")
        if names is None:
            lines = content.decode("latin-1").split("\n")
            version = int(lines[0].split(" ")[0]) if values[0].startswith("filedesc:") and lines[0][:1].isdigit() else 0
            if version not in FIELDS or len(lines) < 2:
                raise BadArchive("the file does not start with a version block")
            names = lines[1].split(" ")
        elif len(values) != len(names):
            raise BadArchive(f"header line at {at} has {len(values)} fields, {len(names)} are named")
        else:
            yield at, dict(zip(names, values, strict=True)), content
        at = end + 1 + len(content)


def _http(content: bytes) -> tuple[bytes, dict[str, str], bytes]:
    """Head, header fields in lower case, and payload of an HTTP response."""
    head, _, payload = content.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode("latin-1").split("\r\n")[1:] if ": " in line)
    return head + b"\r\n\r\n", {k.lower(): v for k, v in fields.items()}, payload


def _identifier(fields: dict[str, str], page_id: str) -> str:
    name = f"{fields['URL']} {fields['Archive-date']} {page_id}".encode()
    return f"urn:uuid:{uuid.UUID(bytes=hashlib.sha256(name).digest()[:16], version=5)}"


def _date(fields: dict[str, str]) -> str:
    return datetime.strptime(fields["Archive-date"], "%Y%m%d%H%M%S").strftime("%Y-%m-%dT%H:%M:%SZ")


def arc_records(spark: SparkSession, path: str) -> DataFrame:
    """``path, offset, page_id, identifier, size, digest`` for each record of the ARC files in a folder."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column("path"), batch.column("content"), strict=True):
                rows = []
                for offset, fields, record in parse_arc(_plain(content.as_py())):
                    _, http, payload = _http(record)
                    page = http.get("x-page-id", "")
                    digest = hashlib.sha256(payload).hexdigest()
                    rows.append((file.as_py(), offset, int(page) if page else None, _identifier(fields, page), len(payload), digest))
                kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string()]
                columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 6, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names=["path", "offset", "page_id", "identifier", "size", "digest"])

    return _files(spark, path).mapInArrow(read, "path string, offset long, page_id long, identifier string, size long, digest string")


def revisits(records: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """``path, offset, response_page, response`` for each record that repeats the payload of a page with a smaller id."""
    large = records.where(F.col("size") >= least_bytes)
    order = F.struct(F.col("page_id").isNull().alias("none"), "page_id", "identifier")
    first = large.groupBy("digest").agg(F.min(order).alias("_first"), F.count("*").alias("_n")).where("_n > 1")
    found = large.join(first, "digest").where(F.col("page_id").isNull() | (F.col("page_id") != F.col("_first.page_id")))
    found = found.where(F.col("_first.page_id").isNotNull())
    return found.select("path", "offset", F.col("_first.page_id").alias("response_page"), F.col("_first.identifier").alias("response"))


def convert(spark: SparkSession, arc: str, warc: str, least_bytes: int = LEAST_BYTES) -> None:
    """Write the ARC files of one folder as compressed WARC files to another, a file for each."""
    found = write_out(revisits(arc_records(spark, arc), least_bytes))
    few = found.count() <= BROADCAST_ROWS
    of_file = found.groupBy("path").agg(F.collect_list(F.struct("offset", "response_page", "response")).alias("revisits"))
    joined = _files(spark, arc).join(F.broadcast(of_file) if few else of_file, "path", "left")

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content, repeats in zip(*(batch.column(c) for c in ("path", "content", "revisits")), strict=True):
                again = {r["offset"]: r for r in repeats.as_py() or ()}
                out = [_warc("warcinfo", _info(file.as_py()), b"format: WARC File Format 1.1\r\n")]
                for offset, fields, record in parse_arc(_plain(content.as_py())):
                    head, http, payload = _http(record)
                    repeat, block = again.get(offset), record
                    names = {
                        "WARC-Record-ID": f"<{_identifier(fields, http.get('x-page-id', ''))}>",
                        "WARC-Date": _date(fields),
                        "WARC-Target-URI": fields["URL"],
                        "WARC-IP-Address": fields["IP-address"],
                        "WARC-Payload-Digest": f"sha256:{hashlib.sha256(payload).hexdigest()}",
                        "Content-Type": "application/http; msgtype=response",
                    }
                    if repeat:
                        block = head
                        names |= {
                            "WARC-Profile": REVISIT_PROFILE,
                            "WARC-Refers-To": f"<{repeat['response']}>",
                            "X-Refers-To-Page": str(repeat["response_page"]),
                        }
                    names["WARC-Block-Digest"] = f"sha256:{hashlib.sha256(block).hexdigest()}"
                    out.append(_warc("revisit" if repeat else "response", names, block))
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()).cast(pa.string())], names=["value"])

    made = joined.mapInArrow(make, "value string")
    made.write.option("lineSep", "\r\n\r\n").option("compression", "gzip").text(warc)


def _info(file: str) -> dict[str, str]:
    name = file.rpartition("/")[2]
    made = uuid.UUID(bytes=hashlib.sha256(name.encode()).digest()[:16], version=5)
    return {
        "WARC-Record-ID": f"<urn:uuid:{made}>",
        "WARC-Date": _FIRST_DATE.strftime("%Y-%m-%dT%H:%M:%SZ"),
        "WARC-Filename": name,
        "Content-Type": "application/warc-fields",
    }


def _warc(kind: str, names: dict[str, str], block: bytes) -> bytes:
    lines = [f"WARC-Type: {kind}", *(f"{k}: {v}" for k, v in names.items()), f"Content-Length: {len(block)}"]
    return b"WARC/1.1\r\n" + "\r\n".join(lines).encode() + b"\r\n\r\n" + block


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and block of each record."""
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        lines = data[at:end].decode().split("\r\n")
        if end < 0 or not lines[0].startswith("WARC/"):
            raise BadArchive(f"no WARC record at {at}")
        fields = dict(line.split(": ", 1) for line in lines[1:])
        block = data[end + 4 : end + 4 + int(fields["Content-Length"])]
        if len(block) < int(fields["Content-Length"]):
            raise BadArchive(f"record at {at} is cut short")
        yield fields, block
        at = end + 4 + len(block) + 4


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to`` for each response and revisit in a folder.

    Size and digest of a response are those of the payload that was read; for a revisit they are the declared ones.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column("path"), batch.column("content"), strict=True):
                rows = []
                for fields, block in parse_warc(_plain(content.as_py())):
                    kind = fields["WARC-Type"]
                    if kind not in ("response", "revisit"):
                        continue
                    _, http, payload = _http(block)
                    declared = fields["WARC-Payload-Digest"].removeprefix("sha256:")
                    size, digest = int(http["content-length"]), declared
                    if kind == "response":
                        size, digest = len(payload), hashlib.sha256(payload).hexdigest()
                        if digest != declared:
                            raise BadArchive(f"{file}: {fields['WARC-Record-ID']} has another payload than declared")
                    page, refers = http.get("x-page-id", ""), fields.get("X-Refers-To-Page")
                    rows.append((int(page) if page else None, size, digest, kind, int(refers) if refers else None))
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
                columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 5, kinds, strict=True)]
                names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    return _files(spark, path).mapInArrow(read, schema)


def archive(pages: DataFrame, least_bytes: int = LEAST_BYTES, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write ``pages(page_id, url, html)`` as ARC, convert that to WARC, and read the WARC back, a row per page.

    Rows with one id and one payload are responses all; a null id comes after all others. A null or empty page has the
    digest of no bytes. Other columns are not looked at. The archives stay in the shared folder, under ``archives``.
    """
    spark = pages.sparkSession
    folder = f"{shared_dir(spark)}/archives/{uuid.uuid4().hex}"
    write_arc(pages, f"{folder}/arc", file_bytes)
    convert(spark, f"{folder}/arc", f"{folder}/warc", least_bytes)
    return read_warc(spark, f"{folder}/warc")
