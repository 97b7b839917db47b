"""WARC archives as a Spark data source: ``spark.read.format("warc")`` and ``df.write.format("warc")``.

A partition is a bundle of files. Predicates on the record type and other headers are pushed down: a record's headers are
parsed first, and only if they pass is its payload inflated and decoded. Compressed archives have one gzip member a
record; members of this writer name their own length, so a reader jumps over one it doesn't want.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from hashlib import sha1
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual,
    Not, StringContains, StringEndsWith, StringStartsWith, WriterCommitMessage,
)

from listingloom.llm.common import BROADCAST_ROWS, in_filter, key_filter, quoted, shared_dir, text_or_empty, whole_row, written

SCHEMA = (
    "record_type string, record_id string, target_uri string, date string, refers_to string, content_type string, payload_digest string, "
    "headers map<string, string>, payload_length bigint, payload binary, file string"
)
#: The header of each column that a predicate can be pushed to (names of the WARC standard).
HEADER_OF = {
    "record_type": "warc-type", "record_id": "warc-record-id", "target_uri": "warc-target-uri", "date": "warc-date", "refers_to": "warc-refers-to",
    "content_type": "content-type", "payload_digest": "warc-payload-digest",
}
VERSION, BLANK_LINE = b"WARC/1.1", b"\r\n\r\n"
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_RESPONSE = "application/http;msgtype=response"
#: Bytes of a file before the next is begun, of a partition's files, of one read and of an output batch.
FILE_BYTES, PARTITION_BYTES, READ_BYTES, BATCH_BYTES = 256 << 20, 128 << 20, 1 << 20, 8 << 20
#: Subfield of a gzip member's extra field that holds the member's length as eight bytes, low ones first.
LENGTH_FIELD = b"LL"
#: Bytes that may stand before a record's block: more isn't a header.
MOST_HEADER = 1 << 20


class MalformedWarc(ValueError):
    pass


def _store(path: str):
    """The file system of a path or URI, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if path.startswith("file:") or "://" in path else (fs.LocalFileSystem(), path)


class _Plain:
    """Bytes of an uncompressed file; skipping seeks."""

    def __init__(self, file):
        self._file, self._buffer, self._size, self._at = file, b"", file.size(), 0

    def _fill(self) -> bool:
        more = self._file.read(READ_BYTES)
        self._at += len(more)
        self._buffer += more
        return bool(more)

    def at_end(self) -> bool:
        return not self._buffer and not self._fill()

    def read_until(self, mark: bytes) -> bytes:
        while (k := self._buffer.find(mark)) < 0:
            if len(self._buffer) > MOST_HEADER or not self._fill():
                raise MalformedWarc("a header doesn't end")
        out, self._buffer = self._buffer[:k], self._buffer[k + len(mark) :]
        return out

    def read(self, n: int) -> bytes:
        parts, left = [self._buffer[:n]], n - len(self._buffer)
        self._buffer = self._buffer[n:]
        while left > 0:
            if not self._fill():
                raise MalformedWarc("a block is cut off")
            parts.append(self._buffer[:left])
            self._buffer, left = self._buffer[left:], left - len(parts[-1])
        return b"".join(parts)

    def skip_record(self, n: int) -> None:
        """Over the ``n`` bytes that are left of a record."""
        ahead = n - len(self._buffer)
        if ahead <= 0:
            self._buffer = self._buffer[n:]
        elif self._at + ahead > self._size:
            raise MalformedWarc("a block is cut off")
        else:
            self._buffer, self._at = b"", self._at + ahead
            self._file.seek(self._at)


class _Gzipped(_Plain):
    """Bytes of a file of gzip members; a record that is one member of known length is skipped without inflating it."""

    def __init__(self, file):
        super().__init__(file)
        self._raw, self._inflate, self._next = b"", None, None

    def _more(self) -> bool:
        more = self._file.read(READ_BYTES)
        self._at += len(more)
        self._raw += more
        return bool(more)

    def _open(self) -> bool:
        """Begins the next member."""
        while len(self._raw) < 12 + len(LENGTH_FIELD) + 10 and self._more():
            pass
        if not self._raw:
            return False
        begin = self._at - len(self._raw)
        self._next = None
        if self._raw[3:4] == b"\x04" and self._raw[12:14] == LENGTH_FIELD and self._raw[14:16] == b"\x08\x00":
            self._next = begin + struct.unpack("<Q", self._raw[16:24])[0]
        self._inflate = zlib.decompressobj(31)
        return True

    def _fill(self) -> bool:
        while True:
            if self._inflate is None and not self._open():
                return False
            if not self._raw and not self._more():
                raise MalformedWarc("a gzip member is cut off")
            try:
                out = self._inflate.decompress(self._raw, READ_BYTES)
            except zlib.error as e:
                raise MalformedWarc(str(e)) from e
            if self._inflate.eof:
                self._raw, self._inflate = self._inflate.unused_data, None
            else:
                self._raw = self._inflate.unconsumed_tail
            if out:
                self._buffer += out
                return True

    def at_end(self) -> bool:
        self._next = None  # known again if the next record begins a member; records that share one are inflated
        return super().at_end()

    def skip_record(self, n: int) -> None:
        if self._next is not None and self._next <= self._size:
            end, self._next, self._buffer, self._inflate = self._next, None, b"", None
            ahead = end - (self._at - len(self._raw))
            if 0 <= ahead <= len(self._raw):
                self._raw = self._raw[ahead:]
            else:
                self._raw, self._at = b"", end
                self._file.seek(end)
            return
        while n > 0:
            if not self._buffer and not self._fill():
                raise MalformedWarc("a block is cut off")
            n, self._buffer = n - len(self._buffer[:n]), self._buffer[n:]


def _headers(head: bytes) -> dict[str, str]:
    """Lower-case names and values; lines that begin with white space carry the one before on."""
    out, name = {}, None
    for line in head.decode("utf-8", "replace").split("\r\n"):
        if line[:1] in " \t" and name:
            out[name] += " " + line.strip()
        elif ":" in line:
            name, _, value = line.partition(":")
            name = name.strip().lower()
            out[name] = value.strip()
    return out


def holds(f: Filter, values: dict[str, str | None]) -> bool | None:
    """A pushed predicate over header values, None as in SQL."""
    if isinstance(f, Not):
        inner = holds(f.child, values)
        return None if inner is None else not inner
    x = values[f.attribute[0]]
    if isinstance(f, IsNull):
        return x is None
    if isinstance(f, IsNotNull):
        return x is not None
    if isinstance(f, EqualNullSafe):
        return x == f.value
    if x is None:
        return None
    if isinstance(f, In):
        return True if x in f.value else None if None in f.value else False
    if f.value is None:
        return None
    for kind, test in _TESTS.items():
        if isinstance(f, kind):
            return test(x, f.value)
    raise TypeError(type(f).__name__)


def _utf8(test):
    return lambda a, b: test(a.encode(), b.encode())


_TESTS = {
    EqualTo: str.__eq__, StringStartsWith: str.startswith, StringEndsWith: str.endswith, StringContains: str.__contains__,
    GreaterThan: _utf8(bytes.__gt__), GreaterThanOrEqual: _utf8(bytes.__ge__), LessThan: _utf8(bytes.__lt__), LessThanOrEqual: _utf8(bytes.__le__),
}
PUSHED = (*_TESTS, In, IsNull, IsNotNull, EqualNullSafe)


def can_push(f: Filter) -> bool:
    if isinstance(f, Not):
        return can_push(f.child)
    return isinstance(f, PUSHED) and len(f.attribute) == 1 and f.attribute[0] in HEADER_OF


@dataclass
class Files(InputPartition):
    paths: list[str] = field(default_factory=list)


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.partition_bytes = int(options.get("partitionBytes", PARTITION_BYTES))
        wanted = options.get("payloads", "all")
        self.payloads = None if wanted == "all" else {t for t in wanted.split(",") if t}
        self.drop_malformed = options.get("mode", "FAILFAST").upper() == "DROPMALFORMED"
        self.filters: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if can_push(f):
                self.filters.append(f)
            else:
                yield f

    def partitions(self) -> list[Files]:
        """The committed files in order of name, neighbours together up to a partition's bytes."""
        from pyarrow import fs

        store, path = _store(self.path)
        info = store.get_file_info(path)
        if info.type == fs.FileType.File:
            return [Files([path])]
        inside = store.get_file_info(fs.FileSelector(path))
        lists = [f for f in inside if f.base_name.startswith("_committed-")]
        named = set()
        for f in lists:
            with store.open_input_stream(f.path) as x:
                named |= set(x.read().decode().split("\n"))
        files = sorted((f for f in inside if f.base_name.endswith((".warc", ".warc.gz")) and (not lists or f.base_name in named)), key=lambda f: f.base_name)
        out, size = [], self.partition_bytes + 1
        for f in files:
            if size + f.size > self.partition_bytes:
                out.append(Files())
                size = 0
            out[-1].paths.append(f.path)
            size += f.size
        return out or [Files()]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        store, rows, size = _store(self.path)[0], [], 0
        for path in partition.paths:
            with store.open_input_file(path) as file:
                for row in self._records(file, path):
                    rows.append(row)
                    size += 1024 + len(row[-2] or b"")
                    if size >= BATCH_BYTES:
                        yield _batch(rows)
                        rows, size = [], 0
        if rows:
            yield _batch(rows)

    def _records(self, file, path: str) -> Iterator[tuple]:
        source = (_Gzipped if path.endswith(".gz") else _Plain)(file)
        try:
            while not source.at_end():
                row = self._record(source, path)
                if row is not None:
                    yield row
        except MalformedWarc as e:
            if not self.drop_malformed:
                raise MalformedWarc(f"{path}: {e}") from e

    def _record(self, source: _Plain, path: str) -> tuple | None:
        headers = _headers(source.read_until(b"\r\n") + b"\r\n" + source.read_until(BLANK_LINE)) if source.read(5) == b"WARC/" else None
        if headers is None or not headers.get("content-length", "").isdigit():
            raise MalformedWarc("no record where one should begin")
        length = int(headers["content-length"])
        values = {c: headers.get(h) for c, h in HEADER_OF.items()}
        if not all(holds(f, values) for f in self.filters):
            source.skip_record(length + 4)
            return None
        kind, payload, size = values["record_type"], None, None
        http = (values["content_type"] or "").replace(" ", "").startswith("application/http")
        want = self.payloads is None or kind in self.payloads
        if http and (want or kind == "revisit"):
            block = source.read(length + 4)[:length]
            head, mark, payload = block.partition(BLANK_LINE)
            said = _headers(head).get("content-length", "")
            size = int(said) if kind == "revisit" and said.isdigit() else len(payload)
            payload = None if kind == "revisit" or not want else payload
        elif want:
            payload = source.read(length + 4)[:length]
            size = length
        else:
            source.skip_record(length + 4)
        return (*values.values(), list(headers.items()), size, payload, path)


_ARROW = [*[(c, pa.string()) for c in HEADER_OF], ("headers", pa.map_(pa.string(), pa.string())), ("payload_length", pa.int64()), ("payload", pa.binary()), ("file", pa.string())]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, (_, kind) in zip(zip(*rows), _ARROW)], [name for name, _ in _ARROW])


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


def record_bytes(headers: list[tuple[str, str | None]], block: bytes) -> bytes:
    lines = [VERSION, *(f"{k}: {v}".encode() for k, v in headers if v is not None), f"Content-Length: {len(block)}".encode()]
    return b"\r\n".join(lines) + BLANK_LINE + block + BLANK_LINE


def gzip_member(data: bytes) -> bytes:
    """One gzip member with its own length in the extra field."""
    deflate = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = deflate.compress(data) + deflate.flush()
    size = 24 + len(body) + 8
    extra = LENGTH_FIELD + struct.pack("<HQ", 8, size)
    head = b"\x1f\x8b\x08\x04\x00\x00\x00\x00\x00\xff" + struct.pack("<H", len(extra)) + extra
    return head + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.path, self.gzip = options["path"], options.get("compression", "gzip") == "gzip"
        self.file_bytes, self.date = int(options.get("fileBytes", FILE_BYTES)), options.get("date", "1970-01-01T00:00:00Z")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, folder = _store(self.path)
        store.create_dir(folder, recursive=True)
        names, out, size = [], None, 0
        encode = gzip_member if self.gzip else bytes
        try:
            for batch in iterator:
                for row in batch.to_pylist():
                    if out is None:
                        names.append(f"part-{uuid.uuid4().hex}.warc{'.gz' if self.gzip else ''}")
                        out = store.open_output_stream(f"{folder}/{names[-1]}", compression=None)
                        size = out.write(encode(self._about(names[-1])))
                    size += out.write(encode(self._record(row)))
                    if size >= self.file_bytes:
                        out.close()
                        out = None
        except BaseException:
            if out is not None:
                out.close()
            for name in names:
                store.delete_file(f"{folder}/{name}")
            raise
        if out is not None:
            out.close()
        return Written(names)

    def _about(self, name: str) -> bytes:
        headers = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:file:{name}>"), ("WARC-Date", self.date), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")]
        return record_bytes(headers, b"format: WARC File Format 1.1\r\n")

    def _record(self, row: dict) -> bytes:
        kind, payload = row["record_type"], row.get("payload") or b""
        headers = [("WARC-Type", kind), ("WARC-Record-ID", row["record_id"]), ("WARC-Date", row.get("date") or self.date), ("WARC-Target-URI", as_uri(row.get("target_uri")))]
        digest = row.get("payload_digest") or f"sha1:{sha1(payload).hexdigest()}"
        if kind not in ("response", "revisit"):
            return record_bytes([*headers, ("WARC-Payload-Digest", digest), ("Content-Type", row.get("content_type") or "application/octet-stream")], payload)
        size = row.get("payload_length")
        head = f"HTTP/1.1 200 OK\r\nContent-Type: {row.get('content_type') or 'text/html; charset=utf-8'}\r\nContent-Length: {len(payload) if size is None else size}\r\n\r\n".encode()
        headers += [("WARC-Payload-Digest", digest), ("Content-Type", HTTP_RESPONSE)]
        if kind == "revisit":
            return record_bytes([*headers, ("WARC-Profile", SAME_PAYLOAD), ("WARC-Refers-To", row.get("refers_to"))], head)
        return record_bytes(headers, head + payload)

    def commit(self, messages: list[Written | None]) -> None:
        """Names the files of the tasks that count; readers see no others."""
        store, folder = _store(self.path)
        store.create_dir(folder, recursive=True)
        with store.open_output_stream(f"{folder}/_committed-{uuid.uuid4().hex}") as out:
            out.write("\n".join(n for m in messages if m for n in m.names).encode())

    def abort(self, messages: list[Written | None]) -> None:
        store, folder = _store(self.path)
        for name in (n for m in messages if m for n in m.names):
            store.delete_file(f"{folder}/{name}")


def as_uri(url: str | None) -> str | None:
    """A URL on one line: control characters, spaces and angle brackets are percent-encoded."""
    return url if url is None else quote(url, safe="".join(chr(c) for c in range(0x21, 0x7F) if chr(c) not in "<>"))


class WarcDataSource(DataSource):
    """Records of WARC 1.0 and 1.1 files, plain or gzipped.

    Reading takes a folder (files named by the writer's commits where there are any, else all ``*.warc`` and ``*.warc.gz``)
    or a file. Options: ``payloads``, the record types whose payload is wanted (``all``; others are null and
    not inflated), ``partitionBytes``, ``mode`` (FAILFAST, or DROPMALFORMED to leave out the rest of a broken file).
    Writing takes rows with record_type and record_id, and target_uri, refers_to, payload, payload_length, payload_digest,
    content_type and date if there are such columns; other columns are not written. Options: ``compression`` (gzip, none),
    ``fileBytes``, ``date``. An empty table is written as an archive without files.
    """

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options)

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        if overwrite:
            raise ValueError("an archive is appended to or written anew, never overwritten")
        return WarcWriter(self.options)


def register(spark: SparkSession) -> None:
    """Makes the format known to a session, with its predicates pushed down."""
    spark.dataSource.register(WarcDataSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def archive(spark: SparkSession, path: str, payloads: str = "all", **options: str) -> DataFrame:
    """The records of the archive in ``path``."""
    register(spark)
    return spark.read.format("warc").options(payloads=payloads, **options).load(path)


#: Payloads of fewer bytes are written again rather than referred to.
LEAST_REVISIT = 1000


def _record_id(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(">"))


def page_records(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """Records to write for pages (page_id, url, html), one each: a response, or a revisit of the same payload elsewhere.

    Of equal payloads of ``least`` bytes or more the rows of the largest page_id are responses (all its rows, should that id be
    repeated; ids that are null only if all are) and the others revisit them. A null html is an empty payload, a
    null url has no target. Other columns are not read; an empty table gives no records.
    """
    rows = pages.select(quoted("page_id").alias("page_id"), quoted("url").alias("target_uri"), text_or_empty(quoted("html")).alias("html"))
    rows = rows.select("page_id", "target_uri", F.sha1(F.col("html").cast("binary")).alias("sha"), F.octet_length("html").cast("bigint").alias("payload_length"), F.col("html").cast("binary").alias("payload"))
    groups = rows.where(F.col("payload_length") >= least).groupBy("sha").agg(F.count("*").alias("_n"), F.max("page_id").alias("_keep")).where("_n > 1").select(F.col("sha").alias("_sha"), "_keep")
    groups = written(groups)
    n, same = groups.count(), F.col("sha") == F.col("_sha")
    if n <= BROADCAST_ROWS:
        told = rows.join(F.broadcast(groups), same, "left")
    else:  # rows that surely have no copy are not shuffled
        found, bits = key_filter(groups.select(F.xxhash64("_sha").alias("h")), n)
        flagged = in_filter(rows.select(whole_row(rows).alias("_row"), F.xxhash64("sha").alias("_h")), "_h", written(found), bits, "_maybe")
        alone, maybe = (flagged.where(c).select("_row.*") for c in ("not _maybe", "_maybe"))
        told = maybe.join(groups, same, "left").unionByName(alone, allowMissingColumns=True)
    revisit = F.col("_sha").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_keep"))
    return told.select(
        F.when(revisit, "revisit").otherwise("response").alias("record_type"), _record_id(F.col("page_id")).alias("record_id"), "target_uri",
        F.when(revisit, _record_id(F.col("_keep"))).alias("refers_to"), F.when(~revisit, F.col("payload")).alias("payload"), "payload_length",
        F.concat(F.lit("sha1:"), "sha").alias("payload_digest"),
    )


def write_archive(records: DataFrame, path: str | None = None, **options: str) -> str:
    """Writes records to a new archive, by default in the session's shared folder, and returns its path."""
    register(records.sparkSession)
    path = path or f"{shared_dir(records.sparkSession)}/archive-{uuid.uuid4().hex}"
    records.write.format("warc").mode("append").options(**options).save(path)
    return path


def page_report(records: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of the page records of an archive.

    A response's bytes and digest are those of its payload as read, a revisit's those that its headers give.
    """
    pages = records.where(F.col("record_type").isin("response", "revisit"))

    def page(c: str) -> Column:
        return F.regexp_extract(c, "^<urn:page:(.*)>$", 1).try_cast("bigint")

    response = F.col("record_type") == "response"
    return pages.select(
        page("record_id").alias("page_id"), F.when(response, F.octet_length("payload")).otherwise(F.col("payload_length")).cast("bigint").alias("payload_bytes"),
        F.when(response, F.sha1("payload")).otherwise(F.substring_index("payload_digest", ":", -1)).alias("payload_digest"), "record_type", page("refers_to").alias("refers_to"),
    )
