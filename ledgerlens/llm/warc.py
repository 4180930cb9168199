"""WARC archives as a Spark data source, and writing pages with their repeated payloads as revisits.

Every record is one gzip member whose extra field ``sl`` holds the member's compressed and uncompressed length. A reader
inflates a record's headers first; if a pushed predicate does not want the record, or the payload is not asked for, it
goes on at the next member and never inflates the payload. Archives without the extra field, and uncompressed
ones, are read, too.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, WriterCommitMessage,
)
from pyspark.sql.types import StructType

from ledgerlens.llm.common import need

FORMAT = "warc_archive"
SCHEMA = (
    "record_type string, record_id string, target_uri string, refers_to string, payload_digest string, "
    "payload_bytes long, payload binary"
)
WRITE_SCHEMA = "record_id string, target_uri string, refers_to string, payload_digest string, payload_bytes long, payload binary"
DATE = "2024-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "_manifest"
_CHUNK = 4_096
# an archive that has reached this size is closed, and the next one begun
ROLL_BYTES = 256 * 2**20


def _open(path: str):
    """The file system of ``path`` and the path in it; any store that Arrow knows."""
    from pyarrow import fs

    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))


def record_bytes(row: dict) -> bytes:
    """One WARC record: a response, or a revisit if ``refers_to`` is known."""
    payload, revisit = row["payload"] or b"", row["refers_to"] is not None
    http = (
        f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['payload_bytes']}\r\n\r\n"
    ).encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{row['record_id']}>",
        f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha1:{row['payload_digest']}",
        "Content-Type: application/http; msgtype=response",
    ]
    if row["target_uri"] is not None:
        head.append("WARC-Target-URI: " + quote(row["target_uri"], safe="%!#$&'()*+,/:;=?@[]~<>{}|^`\"\\"))
    if revisit:
        head += [f"WARC-Refers-To: <{row['refers_to']}>", f"WARC-Profile: {REVISIT_PROFILE}"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(record: bytes, level: int = 6) -> bytes:
    """A gzip member with the lengths of the record in its extra field."""
    deflate = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = deflate.compress(record) + deflate.flush()
    tail = struct.pack("<II", zlib.crc32(record), len(record) & 0xFFFFFFFF)
    extra = b"sl" + struct.pack("<HII", 8, 24 + len(body) + len(tail), len(record) & 0xFFFFFFFF)
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", len(extra)) + extra + body + tail


class _Source:
    """Bytes of one record after the other, inflated only as far as they are asked for."""

    def __init__(self, file, size: int):
        self.file, self.size, self.at = file, size, 0

    def start(self) -> bool:
        """Move to the next record; False at the end of the file."""
        if self.at >= self.size:
            return False
        self.file.seek(self.at)
        self.raw, self.done, self.end = self.file.read(_CHUNK), b"", None
        self.packed = self.raw[:2] == b"\x1f\x8b"
        self.inflate = zlib.decompressobj(31) if self.packed else None
        if self.packed and self.raw[3] & 4 and self.raw[12:14] == b"sl":
            self.end = self.at + struct.unpack("<I", self.raw[16:20])[0]
        return True

    def more(self) -> bool:
        if not self.raw:
            self.raw = self.file.read(_CHUNK)
        if not self.raw or (self.packed and self.inflate.eof):
            return False
        if self.packed:
            self.done += self.inflate.decompress(self.raw, 1 << 16)
            self.raw = self.inflate.unconsumed_tail
        else:
            self.done += self.raw
            self.raw = b""
        return True

    def until(self, mark: bytes, start: int = 0) -> int:
        """Position behind the next ``mark``."""
        seen = start
        while (at := self.done.find(mark, max(start, seen - len(mark)))) < 0:
            seen = len(self.done)
            if not self.more():
                raise ValueError("a record ends in its headers")
        return at + len(mark)

    def upto(self, length: int) -> bytes:
        parts = [self.done]
        have = len(self.done)
        while have < length:
            self.done = b""
            if not self.more():
                raise ValueError("a record ends in its content")
            parts.append(self.done)
            have += len(self.done)
        self.done = b"".join(parts)
        return self.done

    def skip(self, length: int) -> None:
        """Go behind the record, which has ``length`` bytes."""
        if self.end is not None:
            self.at = self.end
        elif not self.packed:
            self.at += length
        else:
            while not self.inflate.eof:
                self.done = b""
                if not self.more():
                    raise ValueError("an archive ends in a record")
            self.at = self.file.tell() - len(self.inflate.unused_data)


def _headers(lines: bytes) -> dict[str, str]:
    pairs = (line.partition(":") for line in lines.decode("utf-8", "replace").split("\r\n")[1:])
    return {name.strip().lower(): value.strip() for name, _, value in pairs if name}


def records(file, size: int, wanted=lambda row: True, payloads: bool = True) -> Iterator[tuple]:
    """Rows of SCHEMA for the records that ``wanted`` accepts by their headers."""
    source = _Source(file, size)
    while source.start():
        body = source.until(b"\r\n\r\n")
        head = _headers(source.done[:body - 4])
        length = body + int(head.get("content-length", 0)) + 4
        digest = head.get("warc-payload-digest", "").rpartition(":")[2] or None
        strip = lambda name: head[name].strip("<>") if name in head else None
        row = {
            "record_type": head.get("warc-type"), "record_id": strip("warc-record-id"), "target_uri": head.get("warc-target-uri"),
            "refers_to": strip("warc-refers-to"), "payload_digest": digest,
        }
        if wanted(row):
            payload, bytes_ = None, None
            if head.get("content-type", "").startswith("application/http"):
                start = source.until(b"\r\n\r\n", body)
                bytes_ = int(_headers(source.done[body:start - 4]).get("content-length", length - 4 - start))
                if payloads and row["record_type"] != "revisit":
                    payload = source.upto(length)[start:length - 4]
                    if digest and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                        raise ValueError(f"payload of {row['record_id']} does not have its digest")
            yield (*row.values(), bytes_, payload)
        source.skip(length)


@dataclass
class ArchiveFile(InputPartition):
    path: str
    size: int


class WarcReader(DataSourceReader):
    """One partition per archive file. Equality and IN on header columns are decided on a record's headers."""

    HEADER_COLUMNS = ("record_type", "record_id", "target_uri", "refers_to", "payload_digest")

    def __init__(self, options: dict):
        self.path, self.payloads = options["path"], options.get("payload", "true").lower() == "true"
        self.accepted: dict[str, set] = {}

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 and f.attribute[0] in self.HEADER_COLUMNS:
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                column = f.attribute[0]
                self.accepted[column] = self.accepted.get(column, values) & values
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        """The files that the manifest of a finished write names; without one, all archives of the folder or the one file."""
        from pyarrow import fs

        system, path = _open(self.path)
        about = system.get_file_info(path)
        if about.type == fs.FileType.File:
            return [ArchiveFile(path, about.size)]
        manifest = system.get_file_info(f"{path}/{MANIFEST}")
        if manifest.type == fs.FileType.File:
            with system.open_input_stream(manifest.path) as lines:
                files = json.loads(lines.read())
            # Spark wants one partition at least
            return [ArchiveFile(f"{path}/{name}", size) for name, size in files] or [ArchiveFile(path, 0)]
        found = system.get_file_info(fs.FileSelector(path, recursive=True))
        return [ArchiveFile(f.path, f.size) for f in found if re.search(r"\.warc(\.gz)?$", f.path)] or [ArchiveFile(path, 0)]

    def read(self, partition: ArchiveFile) -> Iterator[tuple]:
        def wanted(row: dict) -> bool:
            return all(row[column] in values for column, values in self.accepted.items())

        if not partition.size:
            return
        system, _ = _open(self.path)
        with system.open_input_file(partition.path) as file:
            yield from records(file, partition.size, wanted, self.payloads)


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, int]]


class WarcWriter(DataSourceWriter):
    """Archives of at most ``ROLL_BYTES`` and one record, under names of their own; a reader's task takes one of them. Only
    the files of successful tasks come into the manifest."""

    def __init__(self, options: dict):
        self.path = options["path"]

    def write(self, iterator) -> WriterCommitMessage:
        system, path = _open(self.path)
        system.create_dir(path, recursive=True)
        files, out = [], None
        try:
            for row in iterator:
                if out is None or files[-1][1] >= ROLL_BYTES:
                    if out is not None:
                        out.close()
                    files.append((f"part-{uuid.uuid4().hex}.warc.gz", 0))
                    out = system.open_output_stream(f"{path}/{files[-1][0]}", compression=None)
                packed = member(record_bytes(row.asDict()))
                out.write(packed)
                files[-1] = (files[-1][0], files[-1][1] + len(packed))
        finally:
            if out is not None:
                out.close()
        return Written(files)

    def commit(self, messages) -> None:
        system, path = _open(self.path)
        system.create_dir(path, recursive=True)
        files = [f for m in messages if m is not None for f in m.files]
        with system.open_output_stream(f"{path}/{MANIFEST}", compression=None) as out:
            out.write(json.dumps(files).encode())

    def abort(self, messages) -> None:
        """Files without a manifest entry are never read."""


class WarcSource(DataSource):
    """Archives of web pages. Options: path, and payload=false to leave payloads packed."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return WarcReader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return WarcWriter(self.options)


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` with the scheme of Spark's default file system if it has none: executors must not take it for a local one."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(hadoop).toString()


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def base32_of_hex(digest) -> F.Column:
    """Base32 of a SHA-1 in hexadecimal: 20 bits are five hexadecimal digits and four of base 32."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    groups = []
    for i in range(8):
        value = F.conv(F.substring(digest, 5 * i + 1, 5), 16, 10).cast("int")
        groups += [F.substring(F.lit(letters), F.shiftright(value, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*groups)


def write_pages(pages: DataFrame, path: str, min_bytes: int = 0) -> None:
    """Write a record per row of ``pages`` (page_id long, url, html) to the new folder ``path``.

    Of the rows whose payloads are equal and have at least ``min_bytes`` bytes, the one with the largest page_id becomes a
    response and the others revisits of it. A null html is an empty payload, a null url a record without target. Rows
    that repeat the largest page_id of their payload are all responses; a null page_id is smaller than any other.
    An empty table gives an archive without records. Other columns are not read.
    """
    rows = need(pages, "page_id", "url", "html").select(
        "page_id", "url", F.coalesce("html", F.lit("")).alias("html")).withColumns({
            "digest": F.sha1("html"), "payload_bytes": F.octet_length("html").cast("long")})
    facts = rows.select("page_id", "digest", "payload_bytes")
    groups = facts.where(F.col("payload_bytes") >= min_bytes).groupBy("digest", "payload_bytes").agg(
        F.max("page_id").alias("top"), F.count(F.lit(1)).alias("n")).where("n > 1 AND top IS NOT NULL")
    # narrow rows: a payload with very many pages is split by the join, and pages move once, by their ids
    revisits = facts.join(groups, ["digest", "payload_bytes"]).where("page_id IS NULL OR page_id < top").select(
        F.col("page_id").alias("_id"), F.col("digest").alias("_digest"), "top").distinct()
    typed = rows.join(revisits, F.col("page_id").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_digest")), "left")
    urn = lambda c: F.concat(F.lit("urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("null")))
    register(pages.sparkSession)
    typed.select(
        urn("page_id").alias("record_id"), F.col("url").alias("target_uri"),
        F.when(F.col("top").isNotNull(), urn("top")).alias("refers_to"), base32_of_hex(F.col("digest")).alias("payload_digest"),
        "payload_bytes", F.when(F.col("top").isNull(), F.encode("html", "utf-8")).alias("payload"),
    ).write.format(FORMAT).mode("append").save(qualified(pages.sparkSession, path))


def read_archives(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """Rows of SCHEMA. Filters on record_type and the header columns are pushed to the reader."""
    register(spark)
    return spark.read.format(FORMAT).option("payload", str(payload).lower()).load(qualified(spark, path))


def page_of(urn: str) -> F.Column:
    """The page_id in a record's URN; null for ``urn:page:null``."""
    return F.expr(f"try_cast(substring({urn}, {len('urn:page:') + 1}) AS bigint)")
