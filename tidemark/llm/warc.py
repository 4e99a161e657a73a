"""WARC archives: a Python data source that reads them, and a writer that spares equal payloads.

The writer makes one gzip member a record, whose header carries the member's length and the record's length (the "sl"
extra field of the WARC guidelines). The reader inflates a record's first bytes, parses the headers, tests the pushed
predicates and goes to the next member; payloads that no one asked for are not inflated. Archives of others without
that field, and uncompressed ones, are read as well. An archive is read in ranges of its file: only what is looked at is fetched, and
a task holds one range and one record of it, however long the archive is.
"""

from __future__ import annotations

import base64
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualNullSafe, EqualTo, Filter, In, InputPartition

from tidemark.llm.files import make_folder, open_folder, write_whole
from tidemark.llm.staging import staged
from tidemark.llm.words import text_or_empty

SCHEMA = ("record_type string, record_id string, target_uri string, date string, payload_digest string, refers_to string, "
          "content_type string, http_length bigint, payload binary, headers map<string,string>, file string, offset bigint")
#: Columns that come from one WARC header, and so can be tested before anything else is decoded.
_HEADER_OF = {"record_type": "warc-type", "record_id": "warc-record-id", "target_uri": "warc-target-uri", "date": "warc-date",
              "payload_digest": "warc-payload-digest", "refers_to": "warc-refers-to", "content_type": "content-type"}
_HEAD_BYTES = 2048
_BATCH_BYTES = 8 << 20
_BATCH_RECORDS = 4096
#: An archive is closed at this size, so a task's memory doesn't grow with its partition.
ARCHIVE_BYTES = 32 << 20
PARTITION_BYTES = 64 << 20
DATE = "1970-01-01T00:00:00Z"


def parse_head(data: bytes) -> tuple[dict[str, str], int] | None:
    """Header lines by lower-case name (``""``: the version line) and where the block starts; None if the end is missing."""
    end = data.find(b"\r\n\r\n")
    if end < 0:
        return None
    first, *lines = data[:end].decode("utf-8", "replace").split("\r\n")
    out, name = {"": first}, ""
    for line in lines:
        if line[:1] in " \t" and name:  # a folded line
            out[name] += " " + line.strip()
        else:
            name, _, value = line.partition(":")
            name = name.strip().lower()
            out[name] = value.strip()
    return out, end + 4


def member(record: bytes, level: int = 1) -> bytes:
    """A record as one gzip member with its lengths in the header."""
    squeeze = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = squeeze.compress(record) + squeeze.flush()
    size = 24 + len(body) + 8
    head = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H2sHII", 12, b"sl", 8, size, len(record))
    return head + body + struct.pack("<II", zlib.crc32(record), len(record) & 0xFFFFFFFF)


class _Ranges:
    """A file's bytes by slices; holds the last range read, of at least ``least`` bytes, and seeks past what no one asks for."""

    def __init__(self, file, size: int, least: int = 1 << 18):
        self.file, self.size, self.least = file, size, least
        self.start, self.held = 0, b""

    def __len__(self) -> int:
        return self.size

    def __getitem__(self, asked: slice) -> bytes:
        start, stop, _ = asked.indices(self.size)
        if start >= stop:
            return b""
        if start < self.start or stop > self.start + len(self.held):
            self.held = b""  # never two ranges at once
            self.file.seek(start)
            self.start, self.held = start, self.file.read(min(max(stop - start, self.least), self.size - start))
        if stop - start >= self.least:  # a long range is handed over and not kept
            out, self.held = self.held[: stop - start], b""
            return out
        return self.held[start - self.start : stop - self.start]


def _gzip_head(data: bytes, at: int) -> tuple[int, int | None]:
    """Where the deflate stream of the member at ``at`` starts, and where the next member does if its header tells."""
    for size in (1 << 10, 1 << 18):  # the header's fields are short, but may be long
        head = data[at : at + size]
        try:
            start, length = _member_head(head)
        except (IndexError, struct.error):
            continue
        return at + start, None if length is None else at + length
    raise ValueError(f"record at {at} has no complete header")


def _member_head(data: bytes) -> tuple[int, int | None]:
    """Where the deflate stream starts in a member's first bytes, and the member's length if they tell."""
    flags, start, length = data[3], 10, None
    if flags & 4:
        n = struct.unpack_from("<H", data, start)[0]
        field, end = start + 2, start + 2 + n
        while field + 4 <= end:
            kind, size = data[field : field + 2], struct.unpack_from("<H", data, field + 2)[0]
            if kind == b"sl" and size == 8:
                length = struct.unpack_from("<I", data, field + 4)[0]
            field += 4 + size
        start = end
    for bit in (8, 16):
        if flags & bit:
            while data[start]:
                start += 1
            start += 1
    return start + 2 * bool(flags & 2), length


def records(data: bytes | _Ranges, wanted, payload: bool = True) -> Iterator[tuple[int, dict[str, str], bytes | None]]:
    """(offset, headers, block or None) of the records that ``wanted(headers)`` accepts; raises on a broken archive."""
    at = 0
    while at < len(data):
        if data[at : at + 2] != b"\x1f\x8b":
            yield from _plain_records(data, at, wanted, payload)
            return
        start, following = _gzip_head(data, at)
        inflate, text, fed = zlib.decompressobj(-15), b"", start
        head = None
        while head is None:  # the headers, a small piece at a time
            if inflate.eof or fed >= len(data):
                raise ValueError(f"record at {at} has no complete header")
            text += inflate.decompress(inflate.unconsumed_tail + data[fed : fed + _HEAD_BYTES], _HEAD_BYTES)
            fed += min(_HEAD_BYTES, len(data) - fed)
            while head is None and inflate.unconsumed_tail and not inflate.eof:
                head = parse_head(text)
                if head is None:
                    text += inflate.decompress(inflate.unconsumed_tail, _HEAD_BYTES)
            head = head or parse_head(text)
        fields, block = head
        take = wanted(fields)
        if take and payload or following is None:
            parts = [text]
            rest = inflate.unconsumed_tail
            while not inflate.eof:
                if not rest and fed >= len(data):
                    raise ValueError(f"record at {at} is cut off")
                step = rest or data[fed : fed + (1 << 16 if following is None else following - fed)]
                fed += 0 if rest else len(step)
                more = inflate.decompress(step)
                rest = inflate.unconsumed_tail
                if take and payload:
                    parts.append(more)
            if following is None:
                following = fed - len(inflate.unused_data) + 8
            text = b"".join(parts) if take and payload else text
        if take:
            size = int(fields.get("content-length", "0"))
            yield at, fields, text[block : block + size] if payload else None
        at = following


def _plain_records(data: bytes | _Ranges, at: int, wanted, payload: bool) -> Iterator[tuple[int, dict[str, str], bytes | None]]:
    while at < len(data):
        size, head = _HEAD_BYTES, parse_head(data[at : at + _HEAD_BYTES])
        while head is None and at + size < len(data):
            size *= 4
            head = parse_head(data[at : at + size])
        if head is None:
            if data[at:].strip():
                raise ValueError(f"record at {at} has no complete header")
            return
        fields, block = head
        size = int(fields.get("content-length", "0"))
        if wanted(fields):
            yield at, fields, data[at + block : at + block + size] if payload else None
        at += block + size + 4


def _http(fields: dict[str, str], block: bytes | None) -> tuple[bytes | None, int | None]:
    """Payload of a block and the length that its HTTP header states."""
    if block is None or not fields.get("content-type", "").startswith("application/http"):
        return block, None
    head = parse_head(block)
    if head is None:
        return block, None
    length = head[0].get("content-length", "")
    return block[head[1] :], int(length) if length.isdigit() else None


class _Files(InputPartition):
    def __init__(self, paths: list[str]):
        super().__init__(paths)
        self.paths = paths


class WarcReader(DataSourceReader):
    def __init__(self, options):
        self.folder = options["path"]
        self.payload = options.get("payload", "true").lower() == "true"
        self.partition_bytes = int(options.get("partitionbytes", PARTITION_BYTES))
        self.tests: list[tuple[str, frozenset[str]]] = []
        if options.get("recordtype"):
            self.tests.append(("warc-type", frozenset(options["recordtype"].split(","))))

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        system, path = open_folder(self.folder)
        found = [i for i in system.get_file_info(fs.FileSelector(path, allow_not_found=True)) if i.base_name.endswith((".warc", ".warc.gz"))]
        out, size = [[]], 0
        for info in sorted(found, key=lambda i: i.path):
            if out[-1] and size + info.size > self.partition_bytes:
                out.append([])
                size = 0
            out[-1].append(info.path)
            size += info.size
        return [_Files(paths) for paths in out]

    def _wanted(self, fields: dict[str, str]) -> bool:
        return all(fields.get(name) in values for name, values in self.tests)

    def read(self, partition: _Files) -> Iterator[pa.RecordBatch]:
        system, _ = open_folder(self.folder)
        rows, held = [], 0
        for path in partition.paths:
            with system.open_input_file(path) as f:
                for offset, fields, block in records(_Ranges(f, f.size()), self._wanted, self.payload):
                    payload, length = _http(fields, block)
                    row = {column: fields.get(name) for column, name in _HEADER_OF.items()}
                    rows.append(row | {"http_length": length, "payload": payload, "headers": list(fields.items()), "file": path, "offset": offset})
                    held += len(payload or b"") + 1024
                    if held >= _BATCH_BYTES or len(rows) >= _BATCH_RECORDS:
                        yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)
                        rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)


class PushingWarcReader(WarcReader):
    """Spark accepts this reader only while ``spark.sql.python.filterPushdown.enabled`` is on."""

    def pushFilters(self, filters: list[Filter]):
        """Equality and IN on header columns are tested on the headers; the rest stays with Spark."""
        for f in filters:
            name = _HEADER_OF.get(f.attribute[0]) if isinstance(f, EqualTo | EqualNullSafe | In) and len(f.attribute) == 1 else None
            values = getattr(f, "value", None) if name else None
            values = values if isinstance(values, list | tuple) else [values]
            if name and all(isinstance(v, str) for v in values):
                self.tests.append((name, frozenset(values)))
            else:
                yield f


_ARROW = pa.schema(
    [(n, pa.string()) for n in ("record_type", "record_id", "target_uri", "date", "payload_digest", "refers_to", "content_type")]
    + [("http_length", pa.int64()), ("payload", pa.binary()), ("headers", pa.map_(pa.string(), pa.string())), ("file", pa.string()), ("offset", pa.int64())])


class WarcDataSource(DataSource):
    """``spark.read.format("warc").option("path", folder)``; options recordType (comma list), payload (true or
    false), partitionBytes, and pushdown (true where the session lets Python sources take filters)."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return (PushingWarcReader if self.options.get("pushdown") == "true" else WarcReader)(self.options)


def read_warc(spark: SparkSession, folder: str, record_type: str | None = None, payload: bool = True) -> DataFrame:
    """Every record of a folder's archives; an empty or missing folder gives no rows. Turns filter pushdown on in the session."""
    spark.dataSource.register(WarcDataSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    reader = spark.read.format("warc").option("path", folder).option("pushdown", "true").option("payload", str(payload).lower())
    return (reader.option("recordType", record_type) if record_type else reader).load()


def _line_safe(value: str) -> str:
    return " ".join(value.split())


def _record(record_id: str, uri: str, digest: bytes, refers_to: str | None, html: bytes, date: str) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(html)}\r\n\r\n".encode()
    block = http if refers_to else http + html
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if refers_to else 'response'}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {date}"]
    if uri:
        head.append(f"WARC-Target-URI: {uri}")
    head.append(f"WARC-Payload-Digest: sha1:{base64.b32encode(digest).decode()}")
    if refers_to:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def page_urn(page_id) -> str:
    return f"urn:page:{'' if page_id is None else page_id}"


def write_warc(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
               revisit_bytes: int = 1000, date: str = DATE, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes a record per row; returns the archives' index (file, records).

    Payload: the html in UTF-8 (null: empty). Of records with equal payloads of at least ``revisit_bytes``, that with the
    largest identifier is the response and the others revisit it; repeated rows with that identifier are all
    responses. Null identifiers revisit a known one, or are responses where there is none. A null url writes no target. An
    empty table writes no archive. Other columns are ignored.
    """
    make_folder(folder)
    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{url_col}`").cast("string").alias("url"),
                        text_or_empty(F.col(f"`{html_col}`")).alias("html"))
    rows = rows.withColumn("digest", F.sha1("html"))

    # equal payloads: identifiers and digests only; the largest identifier of a digest that occurs twice
    narrow = staged(rows.select("id", "digest", F.octet_length("html").alias("size")).where(F.col("size") >= revisit_bytes), "warc-digests")
    first = narrow.groupBy("digest", "size").agg(F.max("id").alias("refers_to"), F.count("*").alias("n"))
    first = first.where("n > 1 and refers_to is not null").drop("n")
    again = narrow.join(first, ["digest", "size"]).where(~F.col("id").eqNullSafe(F.col("refers_to")))
    again = again.select(F.col("id").alias("again_id"), F.col("digest").alias("again_digest"), "refers_to").distinct()
    rows = rows.join(again, rows["id"].eqNullSafe(again["again_id"]) & (rows["digest"] == again["again_digest"]), "left")
    rows = rows.select("id", "url", "html", F.unhex("digest").alias("digest"), "refers_to")

    def run(batches):
        part, number = TaskContext.get().partitionId(), 0
        members: list[bytes] = []
        size = 0

        def close() -> pa.RecordBatch:
            nonlocal number, size
            name = f"part-{part:06d}-{number:06d}.warc.gz"
            write_whole(folder, name, b"".join(members))
            out = pa.RecordBatch.from_pylist([{"file": name, "records": len(members)}])
            members.clear()
            number, size = number + 1, 0
            return out

        for batch in batches:
            for one, url, html, digest, refers_to in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                target = None if refers_to is None else page_urn(refers_to)
                members.append(member(_record(page_urn(one), _line_safe(url or ""), digest, target, html.encode(), date)))
                size += len(members[-1])
                if size >= archive_bytes:
                    yield close()
        if members:
            yield close()

    return staged(rows.mapInArrow(run, "file string, records bigint"), "warc-index")


def page_of(urn):
    """Column: the identifier in a page's record id."""
    return F.nullif(F.regexp_extract(urn, r"urn:page:(-?\d*)", 1), F.lit("")).cast("long")


def hex_digest(labelled):
    """Column: a labelled base32 SHA-1 as bare lower-case hex."""
    bits = F.regexp_replace(labelled, "^sha1:", "")
    five = F.transform(F.split(bits, ""), lambda c: F.lpad(F.conv((F.instr(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"), c) - 1).cast("string"), 10, 2), 5, "0"))
    whole = F.array_join(five, "")
    return F.lower(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(39)), lambda k: F.conv(F.substr(whole, k * 4 + 1, F.lit(4)), 2, 16)), ""))
