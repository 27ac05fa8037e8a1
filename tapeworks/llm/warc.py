"""WARC records in ZIP packages: written in parallel, found by their indexes, read by ranges.

A package is a ZIP archive whose members are stored as they are: `archive/data.warc.gz`, one gzip
member a record, and `indexes/index.cdxj`, one line a record with its place in the former. Each task
writes packages of bounded size to the shared folder under names of its own attempt; the manifest,
a Parquet table that Spark commits, says which count, so what a lost or repeated task left is never
read. A reader parses a package's directories, then its index; records are range-read from the
stored member, neighbours together, and nothing is unpacked to disk.

`write` makes packages of pages, `index` lists all their records, and `fetch` reads any rows of that
list. Payloads that are equal and long enough are stored once: other records revisit the response.

Cases: a null html is an empty payload, a null url a record without a target. A null page_id is
written and read as such; it is a response unless a page with an id has the same payload. Rows that
repeat the smallest page_id of a payload are all responses. An empty table makes no packages. Line ends and
other control characters in a url are written as %XX. Other columns are left out. page_ids are whole numbers.
"""

from __future__ import annotations

import hashlib
import io
import json
import re
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import zip_ranges

LEAST = 100  # bytes of a payload that others may revisit
#: Bytes of payloads and records of a package; bytes between records that are still read in one go, and bytes read at once.
PACKAGE_BYTES, PACKAGE_RECORDS, GAP, READ_BYTES = 48 << 20, 50_000, 1 << 16, 4 << 20
DATE = "2024-01-01T00:00:00Z"  # of records whose pages have no date
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_CONTROL = re.compile(r"[\x00-\x20\x7f]")
MANIFEST = "path string, records int, bytes long"
INDEX = "path string, offset long, length long, page_id long, url string, payload_digest string"
RECORD = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long"


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """Arrow's file system of a path or URI, and the path in it."""
    if re.match(r"[A-Za-z][\w+.-]*:", path):
        return fs.FileSystem.from_uri(re.sub("^s3a:", "s3:", re.sub("^file:/+", "file:///", path)))
    return fs.LocalFileSystem(), path


def _name(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _page(name: str) -> int | None:
    number = re.fullmatch(r"<urn:page:(-?\d*)>", name)[1]
    return int(number) if number else None


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None = None, revisit: bool = False) -> bytes:
    """One WARC record; a revisit has the payload's HTTP header but not the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_name(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + _CONTROL.sub(lambda m: f"%{ord(m[0]):02X}", url))
    if revisit:
        head += [f"WARC-Refers-To: {_name(refers_to)}", f"WARC-Profile: {_PROFILE}"]
    head += [f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC fields, HTTP fields (names in lower case) and the body of one record."""
    fields, block = [], raw
    for _ in range(2):
        head, _, block = block.partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        fields.append({k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])} | {"": lines[0]})
        if not fields[0][""].startswith("WARC/"):
            raise ValueError("not a WARC record")
        if len(fields) == 1:
            n = int(fields[0]["content-length"])
            if block[n:] != b"\r\n\r\n":
                raise ValueError("a WARC record of another length than it says")
            block = block[:n]
    return fields[0], fields[1], block


class _Package:
    """Records on their way to one package."""

    def __init__(self):
        self.data, self.lines, self.size = io.BytesIO(), [], 0

    def add(self, page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> None:
        pack = zlib.compressobj(1, wbits=31)
        offset = self.data.tell()
        self.data.write(pack.compress(record(page_id, url, payload, digest, refers_to, revisit)) + pack.flush())
        self.lines.append(json.dumps({"offset": offset, "length": self.data.tell() - offset, "page_id": page_id, "url": url, "digest": f"sha256:{digest}"}))
        self.size += len(payload)

    def save(self, folder: str, zip64: bool) -> tuple[str, int, int]:
        path = f"{folder}/{uuid.uuid4().hex}.wacz"
        system, name = file_system(path)
        system.create_dir(name.rpartition("/")[0])
        with system.open_output_stream(name) as out, zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
            for member, content in (("archive/data.warc.gz", self.data.getbuffer()), ("indexes/index.cdxj", "\n".join(self.lines).encode())):
                with z.open(zipfile.ZipInfo(member), "w", force_zip64=zip64) as f:
                    f.write(content)
        return path, len(self.lines), self.data.tell()


def write(pages: DataFrame, folder: str, least: int = LEAST, package_bytes: int = PACKAGE_BYTES, package_records: int = PACKAGE_RECORDS, zip64: bool = True) -> None:
    """Write a record for every row of (page_id, url, html) to packages in `folder`, and their manifest."""
    html = F.coalesce("html", F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", html.alias("html"), F.unhex(F.sha2(html, 256)).alias("sha"))
    long_ones = rows.where(F.octet_length("html") >= least)
    first = long_ones.groupBy("sha").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("k")).where("k > 1").select("sha", "refers_to")
    told = rows.join(first, "sha", "left").select("page_id", "url", "html", "sha", "refers_to", (F.col("refers_to").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("refers_to"))).alias("revisit"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        package, saved = _Package(), []
        for b in batches:
            columns = [b["page_id"].to_pylist(), b["url"].to_pylist(), b["html"], b["sha"].to_pylist(), b["refers_to"].to_pylist(), b["revisit"].to_pylist()]
            for page_id, url, text, sha, refers_to, revisit in zip(*columns, strict=True):
                package.add(page_id, url, text.as_buffer().to_pybytes(), sha.hex(), refers_to if revisit else None, revisit)
                if package.size >= package_bytes or len(package.lines) >= package_records:
                    saved.append(package.save(f"{folder}/packages", zip64))
                    package = _Package()
        if package.lines:
            saved.append(package.save(f"{folder}/packages", zip64))
        kinds = (pa.string(), pa.int32(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*saved, strict=True) if saved else [[]] * 3, kinds, strict=True)], ["path", "records", "bytes"])

    told.mapInArrow(run, MANIFEST).write.parquet(f"{folder}/manifest")


class _Files:
    """Ranges of files; the last file stays open."""

    def __init__(self):
        self.path, self.file = None, None

    def of(self, path: str) -> _Files:
        if path != self.path:
            self.close()
            system, name = file_system(path)
            self.path, self.file = path, system.open_input_file(name)
        return self

    def __call__(self, start: int, size: int) -> bytes:
        self.file.seek(start)
        return self.file.read(size)

    def close(self) -> None:
        if self.file:
            self.file.close()
        self.path, self.file = None, None


def index(spark: SparkSession, folder: str) -> DataFrame:
    """A row for each record of the folder's packages, with its range in the package file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = _Files()
        for b in batches:
            for path, records in zip(b["path"].to_pylist(), b["records"].to_pylist(), strict=True):
                read = files.of(path)
                by_name = {m.name: m for m in zip_ranges.members(read, read.file.size())}
                listed = by_name["indexes/index.cdxj"]
                raw = read(zip_ranges.data_place(read, listed), listed.size)
                if zlib.crc32(raw) != listed.crc:
                    raise ValueError(f"{path}: the index is damaged")
                base = zip_ranges.data_place(read, by_name["archive/data.warc.gz"])
                lines = [json.loads(x) for x in raw.split(b"\n")]
                if len(lines) != records:
                    raise ValueError(f"{path}: {len(lines)} records, not {records}")
                yield pa.RecordBatch.from_arrays([
                    pa.array([path] * records), pa.array([base + x["offset"] for x in lines]), pa.array([x["length"] for x in lines]), pa.array([x["page_id"] for x in lines], pa.int64()),
                    pa.array([x["url"] for x in lines], pa.string()), pa.array([x["digest"].removeprefix("sha256:") for x in lines]),
                ], ["path", "offset", "length", "page_id", "url", "payload_digest"])
        files.close()

    manifest = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    return manifest.repartition("path").mapInArrow(run, INDEX)


def _runs(b: pa.RecordBatch) -> Iterator[list[tuple[str, int, int]]]:
    """Records (path, offset, length) that are read together."""
    now = []
    for x in zip(*(b[c].to_pylist() for c in ("path", "offset", "length")), strict=True):
        if now:
            end = now[-1][1] + now[-1][2]
            if x[0] != now[0][0] or not 0 <= x[1] - end <= GAP or x[1] + x[2] - now[0][1] > READ_BYTES:
                yield now
                now = []
        now.append(x)
    if now:
        yield now


def fetch(listed: DataFrame, with_payload: bool = True) -> DataFrame:
    """The records of rows of `index`, read by ranges and checked against their digests; payload is null for revisits, and unless asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = _Files()
        for b in batches:
            for together in _runs(b):
                start = together[0][1]
                raw = files.of(together[0][0])(start, together[-1][1] + together[-1][2] - start)
                out = []
                for path, offset, length in together:
                    warc, http, body = parse(zlib.decompress(raw[offset - start : offset - start + length], wbits=31))
                    digest, revisit = warc["warc-payload-digest"].removeprefix("sha256:"), warc["warc-type"] == "revisit"
                    size = int(http["content-length"])
                    if not revisit and (len(body) != size or hashlib.sha256(body).hexdigest() != digest):
                        raise ValueError(f"{path}: the payload at {offset} is damaged")
                    out.append((_page(warc["warc-record-id"]), warc.get("warc-target-uri"), warc["warc-type"], size, digest, _page(warc["warc-refers-to"]) if revisit else None, body if with_payload and not revisit else None))
                kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary())
                names = ["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload"]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)
        files.close()

    found = listed.select("path", "offset", "length").mapInArrow(run, RECORD + ", payload binary")
    return found if with_payload else found.drop("payload")
