"""WARC archives: a Python data source that writes and reads gzip-per-record files.

Options of the reader: path, payload ("false" leaves payloads undecoded and the
payload column null), verify ("true" raises where a payload does not match its
digest). Filters on record_type, target_uri, payload_digest and refers_to are
pushed down (spark.sql.python.filterPushdown.enabled) and tested on the parsed
headers; a record that fails them, or whose payload is not wanted, is skipped by
the compressed length in its gzip header, without inflating the rest of it.
"""

from __future__ import annotations

import base64
import hashlib
import json
import posixpath
import struct
import uuid
import zlib
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    In,
    InputPartition,
    StringContains,
    StringEndsWith,
    StringStartsWith,
    WriterCommitMessage,
)

from strandline.llm.common import materialize, scratch_path

#: Every commit adds a manifest of its own, named by this prefix and a UUID, so appends never touch an older one.
MANIFEST = "_manifest"
SPLIT_BYTES = 32 << 20
SCHEMA = (
    "record_id string, record_type string, target_uri string, warc_date string, "
    "payload_digest string, refers_to string, payload_bytes long, payload binary"
)
#: Columns to write; payload_bytes counts even where a revisit leaves the payload out.
WRITE_SCHEMA = "record_id string, record_type string, target_uri string, warc_date string, sha1_hex string, refers_to string, payload_bytes long, payload binary"
_HEADERS = {
    "record_id": "warc-record-id",
    "record_type": "warc-type",
    "target_uri": "warc-target-uri",
    "payload_digest": "warc-payload-digest",
    "refers_to": "warc-refers-to",
}


def _open(path: str):
    if "://" not in path:
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file:///") else path)


def base32_sha1(hex_digest: str) -> str:
    return base64.b32encode(bytes.fromhex(hex_digest)).decode()


def _clean(value: str) -> str:
    """A header value on one line."""
    return " ".join(value.split()) if any(c in value for c in "\r\n") else value


def encode_record(rec: dict) -> bytes:
    """One WARC/1.1 record; a revisit keeps the HTTP header and leaves the payload out."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {rec['payload_bytes']}\r\n\r\n".encode()
    lines = ["WARC/1.1", f"WARC-Type: {rec['record_type']}", f"WARC-Record-ID: <{rec['record_id']}>", f"WARC-Date: {rec['warc_date']}"]
    if rec["target_uri"] is not None:
        lines.append(f"WARC-Target-URI: {_clean(rec['target_uri'])}")
    lines.append(f"WARC-Payload-Digest: sha1:{base32_sha1(rec['sha1_hex'])}")
    block = http
    if rec["record_type"] == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{rec['refers_to']}>"]
    else:
        block += rec["payload"] or b""
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def gzip_member(data: bytes) -> bytes:
    """A gzip member whose extra field 'sl' holds its compressed and plain lengths, so readers can skip it."""
    deflate = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = deflate.compress(data) + deflate.flush()
    size = 10 + 2 + 12 + len(body) + 8
    extra = b"sl" + struct.pack("<HII", 8, size & 0xFFFFFFFF, len(data) & 0xFFFFFFFF)
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", len(extra)) + extra + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def _manifests(filesystem, root: str) -> dict[str, dict[str, list[int]]]:
    """Manifest name -> file name -> cuts, of every commit below a folder."""
    found = {}
    for f in filesystem.get_file_info(fs.FileSelector(root, allow_not_found=True)):
        if f.base_name.startswith(MANIFEST) and f.base_name.endswith(".json"):
            with filesystem.open_input_stream(f.path, compression=None) as stream:
                found[f.base_name] = json.loads(stream.read())
    return found


@dataclass
class _Wrote(WriterCommitMessage):
    file: str
    cuts: list


class WarcWriter(DataSourceArrowWriter):
    """Each attempt writes a file of its own; only files named by committed tasks enter the commit's manifest.

    An overwriting commit publishes its manifest first and then drops older ones and their files.
    """

    def __init__(self, path: str, overwrite: bool = False) -> None:
        self.path, self.overwrite = path, overwrite

    def write(self, iterator):
        filesystem, root = _open(self.path)
        filesystem.create_dir(root, recursive=True)
        name, at, cuts = f"part-{uuid.uuid4().hex}.warc.gz", 0, [0]
        with filesystem.open_output_stream(posixpath.join(root, name), compression=None) as out:
            for batch in iterator:
                for i in range(batch.num_rows):
                    if at - cuts[-1] >= SPLIT_BYTES:
                        cuts.append(at)
                    member = gzip_member(encode_record({c: batch.column(c)[i].as_py() for c in batch.schema.names}))
                    out.write(member)
                    at += len(member)
        return _Wrote(name, [*cuts, at])

    def commit(self, messages) -> None:
        filesystem, root = _open(self.path)
        files = {m.file: m.cuts for m in messages if m is not None}
        filesystem.create_dir(root, recursive=True)
        older = _manifests(filesystem, root) if self.overwrite else {}
        name = f"{MANIFEST}-{uuid.uuid4().hex}.json"
        with filesystem.open_output_stream(posixpath.join(root, "." + name), compression=None) as out:
            out.write(json.dumps(files).encode())
        filesystem.move(posixpath.join(root, "." + name), posixpath.join(root, name))  # whole or not at all
        for manifest, held in older.items():
            filesystem.delete_file(posixpath.join(root, manifest))
            for file in held:
                filesystem.delete_file(posixpath.join(root, file))

    def abort(self, messages) -> None:
        filesystem, root = _open(self.path)
        for m in messages:
            if m is not None:
                filesystem.delete_file(posixpath.join(root, m.file))


@dataclass
class _Range(InputPartition):
    file: str
    start: int
    stop: int | None


class _Inflater:
    """Plain bytes of one gzip member (or of an uncompressed file), inflated no further than asked."""

    def __init__(self, stream, compressed: bool) -> None:
        self.stream, self.have, self.rest, self.ended = stream, b"", b"", False
        self.z = zlib.decompressobj(31) if compressed else None

    def fill(self) -> bool:
        raw = self.rest or self.stream.read(1 << 14)
        self.rest = b""
        if not raw:
            self.ended = True
            return False
        if self.z is None:
            self.have += raw
            return True
        self.have += self.z.decompress(raw, 1 << 16)
        self.rest = self.z.unconsumed_tail
        if self.z.eof:
            self.ended, self.rest = True, self.z.unused_data
        return True

    def until(self, mark: bytes) -> bytes:
        while (i := self.have.find(mark)) < 0:
            if self.ended or not self.fill():
                raise ValueError("a WARC record ends within its header")
        out, self.have = self.have[: i + len(mark)], self.have[i + len(mark) :]
        return out

    def exactly(self, n: int) -> bytes:
        parts, need = [], n
        while need:
            if not self.have and (self.ended or not self.fill()):
                raise ValueError("a WARC record ends within its block")
            parts.append(self.have[:need])
            self.have = self.have[need:]
            need -= len(parts[-1])
        return b"".join(parts)


def _fields(header: bytes) -> dict[str, str]:
    found = {}
    for line in header.decode("utf-8", "replace").split("\r\n")[1:]:
        name, colon, value = line.partition(":")
        if colon:
            found[name.strip().lower()] = value.strip()
    return found


def _row(h: dict[str, str]) -> dict:
    row = {c: h.get(k) for c, k in _HEADERS.items()} | {"warc_date": h.get("warc-date")}
    for c in ("record_id", "refers_to"):
        row[c] = row[c] and row[c].strip("<>")
    row["payload_digest"] = row["payload_digest"] and row["payload_digest"].rpartition(":")[2]
    return row


class WarcReader(DataSourceReader):
    def __init__(self, path: str, payload: bool, verify: bool) -> None:
        self.path, self.payload, self.verify = path, payload, verify
        self.tests: list[tuple[str, str, object]] = []

    def pushFilters(self, filters):
        kinds = {EqualTo: "eq", In: "in", StringStartsWith: "starts", StringEndsWith: "ends", StringContains: "has"}
        for f in filters:
            kind = kinds.get(type(f))
            if kind and len(f.attribute) == 1 and f.attribute[0] in _HEADERS:
                self.tests.append((kind, f.attribute[0], list(f.value) if kind == "in" else f.value))
            else:
                yield f

    def wanted(self, row: dict) -> bool:
        for kind, column, value in self.tests:
            own = row[column]
            if own is None:
                return False
            ok = {"eq": lambda: own == value, "in": lambda: own in value, "starts": lambda: own.startswith(value), "ends": lambda: own.endswith(value), "has": lambda: value in own}[kind]()
            if not ok:
                return False
        return True

    def partitions(self):
        """Byte ranges that begin at records, from the manifests of all commits; without one, whole files."""
        filesystem, root = _open(self.path)
        info = filesystem.get_file_info(root)
        if info.type == fs.FileType.File:
            return [_Range("", 0, None)]
        manifests = _manifests(filesystem, root)
        if manifests:
            files = {n: cuts for held in manifests.values() for n, cuts in held.items()}
            return [_Range(n, a, b) for n, cuts in sorted(files.items()) for a, b in zip(cuts, cuts[1:]) if b > a] or [_Range("", 0, 0)]
        found = filesystem.get_file_info(fs.FileSelector(root, recursive=True))
        names = sorted(posixpath.relpath(f.path, root) for f in found if f.base_name.endswith((".warc", ".warc.gz")))
        return [_Range(n, 0, None) for n in names] or [_Range("", 0, 0)]

    def read(self, part):
        if part.stop == 0:
            return
        filesystem, root = _open(self.path)
        rows, size = [], 0
        with filesystem.open_input_file(posixpath.join(root, part.file) if part.file else root) as f:
            for row in self.records(f, part.start, f.size() if part.stop is None else part.stop):
                rows.append(row)
                size += len(row["payload"] or b"")
                if len(rows) >= 2000 or size > 8 << 20:
                    yield self.batch(rows)
                    rows, size = [], 0
        if rows:
            yield self.batch(rows)

    @staticmethod
    def batch(rows):
        text = ("record_id", "record_type", "target_uri", "warc_date", "payload_digest", "refers_to")
        kinds = [(c, pa.string()) for c in text] + [("payload_bytes", pa.int64()), ("payload", pa.binary())]
        return pa.RecordBatch.from_pylist(rows, pa.schema(kinds))

    def records(self, f, at: int, stop: int):
        while at < stop:
            f.seek(at)
            head = f.read(24)
            compressed, skip = head[:2] == b"\x1f\x8b", None
            if compressed and len(head) == 24 and head[3] & 4 and head[12:14] == b"sl":
                skip = struct.unpack("<I", head[16:20])[0]
            f.seek(at)
            src = _Inflater(f, compressed)
            h = _fields(src.until(b"\r\n\r\n"))
            row, length = _row(h), int(h.get("content-length", 0))
            take, used, http_length = self.wanted(row), 0, None
            if take:
                if h.get("content-type", "").startswith("application/http"):
                    http = src.until(b"\r\n\r\n")
                    used, http_length = len(http), _fields(http).get("content-length")
                row["payload_bytes"] = int(http_length) if row["record_type"] == "revisit" and http_length else length - used
                row["payload"] = None
                if self.payload and row["record_type"] != "revisit":
                    row["payload"] = src.exactly(length - used)
                    used = length
                    if self.verify and row["payload_digest"] != base32_sha1(hashlib.sha1(row["payload"]).hexdigest()):
                        raise ValueError(f"payload of {row['record_id']} does not match its digest")
                yield row
            if skip:
                at += skip
            elif compressed:  # no length to skip by: inflate to the end of the member
                while not src.ended:
                    src.have = b""
                    src.fill()
                at = f.tell() - len(src.rest)
            else:
                at += len(self.plain_header(f, at)) + length + 4

    @staticmethod
    def plain_header(f, at: int) -> bytes:
        f.seek(at)
        return _Inflater(f, False).until(b"\r\n\r\n")


class WarcDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        flag = lambda k, d: str(self.options.get(k, d)).lower() == "true"
        return WarcReader(self.options["path"], flag("payload", "true"), flag("verify", "false"))

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return WarcWriter(self.options["path"], overwrite)


def read_warc(spark, path: str, **options: str) -> DataFrame:
    """Records of the archives below a path, lazily; filters and options as in the module's text."""
    spark.dataSource.register(WarcDataSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("warc").options(**options).load(path)


def page_records(pages: DataFrame, least: int = 0) -> DataFrame:
    """WRITE_SCHEMA rows for pages(page_id, url, html), one a page.

    Of equal payloads of at least `least` bytes the page with the largest page_id
    is the response and the others revisit it; smaller payloads are responses.
    Null html is an empty payload. Rows with a null page_id, and repeated rows of
    the largest page_id, are responses. Extra columns are ignored.
    """
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    base = base.withColumns({"sha1_hex": F.sha1("payload"), "payload_bytes": F.length("payload").cast("long")})
    sums = base.filter((F.col("payload_bytes") >= least) & F.col("page_id").isNotNull()).groupBy("sha1_hex").agg(F.max("page_id").alias("head"), F.min("page_id").alias("first"))
    heads = materialize(sums.filter("first < head").select("sha1_hex", "head"), "warc-heads")  # only of payloads that some page revisits
    revisit = F.col("page_id").isNotNull() & (F.col("page_id") < F.col("head"))
    urn = lambda c: F.concat(F.lit("urn:page:"), F.col(c))
    return base.join(heads, "sha1_hex", "left").select(
        F.coalesce(urn("page_id"), F.concat(F.lit("urn:uuid:"), F.uuid())).alias("record_id"),
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.col("url").alias("target_uri"),
        F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("warc_date"),
        "sha1_hex",
        F.when(revisit, urn("head")).alias("refers_to"),
        "payload_bytes",
        F.when(~F.coalesce(revisit, F.lit(False)), F.col("payload")).alias("payload"),
    )


def write_pages(pages: DataFrame, path: str, least: int = 0) -> None:
    """Archive pages under a path that executors share."""
    pages.sparkSession.dataSource.register(WarcDataSource)
    page_records(pages, least).write.format("warc").mode("append").save(path)


def page_archive(pages: DataFrame, least: int = 0) -> DataFrame:
    """Write pages as WARC files and read every record back, payloads checked against their digests.

    (page_id, payload_bytes, payload_digest, record_type, refers_to); a null
    page_id comes back null; no page, no row.
    """
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    write_pages(pages, path, least)
    number = lambda c: F.regexp_extract(c, r"^urn:page:(-?\d+)$", 1).try_cast("long")
    return read_warc(spark, path, verify="true").select(
        number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to")
    )
