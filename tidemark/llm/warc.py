"""A Python data source for WARC archives, ``format("warc")``.

Writing: each task writes one archive of records in the folder of the path,
under a name of its own attempt; committing writes a manifest of its own with the
names of the attempts that count, so files of lost attempts are never read and two
commits do not undo each other.  A manifest is written aside and renamed; archives
of a folder are those of all its manifests.  Every record has the date of writing.

Reading: the driver plans a partition for each range of a file (plain archives
are cut at ``split`` bytes, a record belongs to the range in which it begins;
compressed ones are a partition each).  Filters on ``record_type`` (equal, in)
and equality filters on ``target_uri``, ``record_id`` and ``refers_to`` are pushed down.  A
reader parses a record's header first; if the filters reject it, or the payload
column is not asked for, a plain archive skips over the block without reading it, and
a compressed one runs over it without decoding it.

Options: ``date`` (of the records), ``path`` (a folder or file; any file system that ``pyarrow.fs`` opens),
``compression`` (``none`` or ``gzip``, a member for each record),
``columns`` (names to read, comma-joined; all by default), ``split``.
"""

from __future__ import annotations

import gzip
import json
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, In, InputPartition, WriterCommitMessage

from ._common import small_batches, staged_path

SCHEMA = (
    "record_id string, record_type string, target_uri string, refers_to string, payload_digest string, "
    "payload_length bigint, page_key string, payload binary"
)
#: Column -> header.
HEADERS = {
    "record_id": "WARC-Record-ID",
    "record_type": "WARC-Type",
    "target_uri": "WARC-Target-URI",
    "refers_to": "WARC-Refers-To",
    "payload_digest": "WARC-Payload-Digest",
    "payload_length": "X-Payload-Length",
    "page_key": "X-Page-Key",
}
PUSHED = ("record_type", "target_uri", "record_id", "refers_to")
MANIFEST = "_manifest-"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_END = b"\r\n\r\n"
_BUFFER = 1 << 20


def _filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _line(value) -> str:
    """A header value on one line; what would break the line is percent-encoded."""
    return "".join(f"%{ord(c):02X}" if ord(c) < 32 or ord(c) == 127 else c for c in str(value))


def now() -> str:
    return datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")


def record_bytes(row: dict, date: str) -> bytes:
    """A record in WARC 1.1.  Revisit records have the HTTP header alone as their block."""
    block = _HTTP + (bytes(row["payload"] or b"") if row["record_type"] != "revisit" else b"")
    lines = [f"{HEADERS[c]}: {_line(row[c])}" for c in HEADERS if row.get(c) is not None]
    if row["record_type"] == "revisit":
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    head = "\r\n".join(["WARC/1.1", *lines, f"WARC-Date: {date}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"])
    return head.encode() + _END + block + _END


@dataclass
class Written(WriterCommitMessage):
    name: str | None


@dataclass
class Range(InputPartition):
    path: str
    start: int
    end: int


class WarcWriter(DataSourceWriter):
    def __init__(self, options: dict, overwrite: bool) -> None:
        self.path, self.gz, self.overwrite = options["path"], options.get("compression", "none") == "gzip", overwrite
        self.date = options.get("date") or now()

    def write(self, rows: Iterator) -> Written:
        system, root = _filesystem(self.path)
        name, out = f"part-{uuid.uuid4().hex}.warc{'.gz' if self.gz else ''}", None
        for row in rows:
            if out is None:
                system.create_dir(root, recursive=True)
                out = system.open_output_stream(f"{root}/{name}", compression=None)
            data = record_bytes(row.asDict(), self.date)
            out.write(gzip.compress(data, 6, mtime=0) if self.gz else data)
        if out is None:
            return Written(None)
        out.close()
        return Written(name)

    def commit(self, messages: list) -> None:
        system, root = _filesystem(self.path)
        system.create_dir(root, recursive=True)
        before = _manifests(system, root) if self.overwrite else []
        name = f"{uuid.uuid4().hex}.json"
        with system.open_output_stream(f"{root}/.{name}") as out:
            out.write(json.dumps(sorted(m.name for m in messages if m and m.name)).encode())
        system.move(f"{root}/.{name}", f"{root}/{MANIFEST}{name}")
        for old in before:
            system.delete_file(old)

    def abort(self, messages: list) -> None:
        system, root = _filesystem(self.path)
        for m in messages:
            if m and m.name:
                system.delete_file(f"{root}/{m.name}")


def _manifests(system, root: str) -> list[str]:
    from pyarrow import fs

    found = system.get_file_info(fs.FileSelector(root, allow_not_found=True))
    return sorted(x.path for x in found if x.base_name.startswith(MANIFEST) and x.base_name.endswith(".json"))


def _archives(system, root: str) -> list[str] | None:
    """Names of the archives that were committed; None in a folder without manifests."""
    names, manifests = [], _manifests(system, root)
    for path in manifests:
        with system.open_input_stream(path) as at:
            names += json.loads(at.read())
    return names if manifests else None


class WarcReader(DataSourceReader):
    def __init__(self, schema, options: dict) -> None:
        self.schema, self.path = schema, options["path"]
        self.split = int(options.get("split", 64 << 20))
        asked = [c.strip() for c in options.get("columns", "").split(",") if c.strip()]
        self.columns = set(asked or schema.names)
        self.wanted: dict[str, set] = {}

    def pushFilters(self, filters: list):  # noqa: N802
        """Take what a header decides; all others stay with Spark."""
        for f in filters:
            values = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if values is not None and len(f.attribute) == 1 and f.attribute[0] in PUSHED:
                name = f.attribute[0]
                self.wanted[name] = values & self.wanted.get(name, values)
            else:
                yield f

    def partitions(self) -> list[Range]:
        from pyarrow import fs

        system, root = _filesystem(self.path)
        at = system.get_file_info(root)
        if at.type == fs.FileType.File:
            files = [at]
        else:
            names = _archives(system, root)
            if names is None:
                found = system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
                files = [x for x in found if x.path.endswith((".warc", ".warc.gz"))]
            else:
                files = system.get_file_info([f"{root}/{n}" for n in names])
        out = []
        for x in files:
            step = x.size if x.path.endswith(".gz") else self.split
            out += [Range(x.path, k, min(k + step, x.size)) for k in range(0, x.size, max(1, step))]
        return out or [Range("", 0, 0)]

    def accepts(self, headers: dict[str, str]) -> bool:
        return all(headers.get(HEADERS[c].lower()) in values for c, values in self.wanted.items())

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        schema, rows, size = to_arrow_schema(self.schema), [], 0
        if not partition.path:
            return
        system, _ = _filesystem(self.path)
        with system.open_input_file(partition.path) as source:
            records = _compressed(source) if partition.path.endswith(".gz") else _plain(source, partition)
            for headers, block in records:
                wanted = self.accepts(headers) if headers else False
                body = block(wanted and "payload" in self.columns and headers.get("warc-type") != "revisit")
                if wanted:
                    rows.append(self._row(headers, body))
                    size += len(body or b"")
                if len(rows) >= 256 or size > 8 << 20:
                    yield _batch(rows, schema)
                    rows, size = [], 0
        if rows:
            yield _batch(rows, schema)

    def _row(self, headers: dict[str, str], block: bytes | None) -> tuple:
        payload = None if block is None else block.partition(_END)[2] if headers.get("content-type", "").startswith("application/http") else block
        values: dict = {c: headers.get(h.lower()) for c, h in HEADERS.items() if c in self.columns}
        if values.get("payload_length") is not None:
            values["payload_length"] = int(values["payload_length"])
        return tuple(payload if n == "payload" else values.get(n) for n in self.schema.names)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _headers(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    out = {}
    for line in lines[1:]:
        name, found, value = line.partition(":")
        if found:
            out[name.strip().lower()] = value.strip()
    return out


def _plain(source, partition: Range):
    """Records that begin in the range: headers, and a function that reads or skips the block."""
    at = partition.start
    if at:  # the first record that begins at or after the start
        at = _seek_record(source, max(0, at - len(_END)), partition.end)
    size = source.size()
    while at is not None and at < min(partition.end, size):
        source.seek(at)
        head = b""
        while _END not in head:
            more = source.read(4096)
            if not more:
                return
            head += more
        headers = _headers(head[: head.index(_END)])
        begin = at + head.index(_END) + len(_END)
        length = int(headers.get("content-length", 0))

        def block(read: bool, begin=begin, length=length) -> bytes | None:
            if not read:
                return None
            source.seek(begin)
            return source.read(length)

        yield headers, block
        at = begin + length + len(_END)


def _seek_record(source, at: int, end: int) -> int | None:
    """The first record boundary from ``at``: an end of record before a version
    line whose header names a type, and whose block ends in an end of record."""
    mark, size = _END + b"WARC/1.", source.size()
    while at < min(end, size):
        source.seek(at)
        data = source.read(_BUFFER)
        found = data.find(mark)
        while found >= 0:
            start = at + found + len(_END)
            if start < end and _is_record(source, start, size):
                return start
            found = data.find(mark, found + 1)
        if len(data) < _BUFFER:
            return None
        at += len(data) - len(mark)
    return None


def _is_record(source, start: int, size: int) -> bool:
    source.seek(start)
    head = source.read(1 << 16)
    if _END not in head:
        return False
    headers = _headers(head[: head.index(_END)])
    if "warc-type" not in headers or not headers.get("content-length", "").isdigit():
        return False
    stop = start + head.index(_END) + len(_END) + int(headers["content-length"])
    source.seek(stop)
    return source.read(len(_END)) == _END and (stop + len(_END) == size or source.read(5) == b"WARC/")


def _compressed(source):
    """Records of a file with a gzip member for each."""
    left = b""
    while True:
        inflate, head, rest = zlib.decompressobj(31), b"", left
        while _END not in head and not inflate.eof:
            data = rest or source.read(_BUFFER)
            rest = b""
            if not data:
                return
            head += inflate.decompress(data)
        split = head.index(_END) if _END in head else len(head)
        headers = _headers(head[:split])
        state = {"left": inflate.unused_data}

        def block(read: bool, head=head, split=split, inflate=inflate, state=state, headers=headers) -> bytes | None:
            parts = [head[split + len(_END) :]]
            while not inflate.eof:
                data = source.read(_BUFFER)
                if not data:
                    break
                out = inflate.decompress(data)
                if read:
                    parts.append(out)
            state["left"] = inflate.unused_data
            return b"".join(parts)[: int(headers.get("content-length", 0))] if read else None

        yield headers, block
        left = state["left"]
        if not left:
            left = source.read(_BUFFER)
            if not left:
                return


class WarcDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(schema, self.options)

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)


def records_of(pages: DataFrame, least_bytes: int = 100) -> DataFrame:
    """A WARC record for each page (``page_id``, ``url``, ``html``).

    Of pages with equal payloads of at least ``least_bytes`` the smallest
    ``page_id`` is a response (each row of it, where rows repeat) and the others
    revisit it; a page with a null id revisits the smallest id, and is a response
    where no page of the payload has one.  A null html is an empty payload.
    Record ids are ``<urn:page:page:row>``, so that repeated pages have ids of their own;
    a revisit refers to the first row of its page.
    """
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.monotonically_increasing_id().alias("row"), "page_id", F.col("url").alias("target_uri"), payload.alias("payload")).select(
        "*", F.sha2("payload", 256).alias("digest"), F.octet_length("payload").cast("long").alias("payload_length")
    )
    firsts = (
        rows.filter(F.col("payload_length") >= least_bytes)
        .groupBy("digest")
        .agg(F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "row"))).alias("first"), F.count("*").alias("copies"))
        .filter("copies > 1 AND first IS NOT NULL")
    )
    joined = rows.join(firsts.select("digest", "first"), "digest", "left")
    again = F.col("first").isNotNull() & ~F.col("first.page_id").eqNullSafe(F.col("page_id"))
    urn = lambda page, row: F.concat(F.lit("<urn:page:"), F.coalesce(page.cast("string"), F.lit("null")), F.lit(":"), row.cast("string"), F.lit(">"))
    return joined.select(
        urn(F.col("page_id"), F.col("row")).alias("record_id"),
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        "target_uri",
        F.when(again, urn(F.col("first.page_id"), F.col("first.row"))).alias("refers_to"),
        F.concat(F.lit("sha256:"), "digest").alias("payload_digest"),
        "payload_length",
        F.col("page_id").cast("string").alias("page_key"),
        F.when(~again, F.col("payload")).alias("payload"),
    )


def write(pages: DataFrame, path: str, compression: str = "gzip") -> None:
    spark = pages.sparkSession
    small_batches(spark)
    register(spark)
    records_of(pages).write.format("warc").option("compression", compression).mode("append").save(path)


def read(spark: SparkSession, path: str, columns: tuple[str, ...] = ()) -> DataFrame:
    register(spark)
    reader = spark.read.format("warc").option("columns", ",".join(columns))
    return reader.load(path)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write the pages' records to archives in the shared folder and read them back."""
    path = staged_path(pages.sparkSession, "warc")
    write(pages, path)
    return read(pages.sparkSession, path)
