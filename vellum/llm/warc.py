"""WARC archives as a PySpark data source, for writing and for reading.

``spark.dataSource.register(WarcSource)``, then ``format("warc")``.

Reading plans one partition per run of records between two sync points of a file (from the manifest
that the writer leaves; files without one are a partition each).  Filters on the record type and on
headers are pushed down: a record's headers are read first, and a record that they rule out is
passed over by its length, without reading or inflating its payload.  ``option("payload", "false")``
leaves payloads out altogether.

Writing gives a file per task and a manifest at the commit; only files in a manifest are read, so
what a lost or repeated task leaves behind does no harm.  Records are gzip members of their own by
default, whose extra field ``sl`` holds their lengths.
"""

from __future__ import annotations

import base64
import json
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualNullSafe,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    IsNotNull,
    IsNull,
    LessThan,
    LessThanOrEqual,
    Not,
    StringContains,
    StringEndsWith,
    StringStartsWith,
    WriterCommitMessage,
)

from vellum.llm.common import shared_dir, table

#: Bytes between two sync points of a file, and of a batch of records.
SYNC, BATCH = 32 << 20, 4 << 20
#: Bytes that are read (or inflated) at first to find a record's headers.
HEAD = 4096
LEAST_REVISIT = 1000
RECORD_ID = "urn:x-page:"
HEADER_SCHEMA = (
    "record_id string, record_type string, target_uri string, date string, refers_to string, payload_digest string, "
    "content_type string, content_length long, payload_length long, http_status int, headers map<string,string>, file string, offset long"
)
#: Columns that headers alone decide, so that filters on them can be pushed down.
HEADERS = frozenset(("record_id", "record_type", "target_uri", "date", "refers_to", "payload_digest", "content_type", "content_length"))


def _open(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


# records


def _clean(value: str) -> str:
    """A header's value: control characters and line ends become percent escapes."""
    return "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in value)


def record(record_id: str, kind: str, uri: str, payload: bytes, payload_length: int, digest_hex: str, date: str, refers_to: str | None = None) -> bytes:
    """A response or revisit record.  A revisit has the HTTP headers only, with the payload's length."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % payload_length
    block = http if kind == "revisit" else http + payload
    head = [
        ("WARC-Type", kind), ("WARC-Record-ID", f"<{record_id}>"), ("WARC-Date", date), ("WARC-Target-URI", _clean(uri)),
        ("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(digest_hex)).decode()),
        ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block))),
    ]
    if refers_to is not None:
        head.insert(5, ("WARC-Refers-To", f"<{refers_to}>"))
        head.insert(5, ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))
    lines = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n"
    return lines.encode() + block + b"\r\n\r\n"


def gzip_member(data: bytes, level: int = 1) -> bytes:
    """A gzip member with an extra field that holds its own and its content's length."""
    deflate = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = deflate.compress(data) + deflate.flush()
    total = 24 + len(body) + 8
    if total >= 1 << 32 or len(data) >= 1 << 32:  # lengths that the field can't hold: a plain member
        return b"\x1f\x8b\x08\0\0\0\0\0\0\xff" + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff\x0c\0sl\x08\0" + struct.pack("<II", total, len(data)) + body + struct.pack("<II", zlib.crc32(data), len(data))


def parse_headers(data: bytes) -> tuple[dict[str, str], int] | None:
    """A record's headers (names in lower case) and where its block starts; None if their end isn't there."""
    end = data.find(b"\r\n\r\n")
    if end < 0:
        return None
    lines = data[:end].decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    out: dict[str, str] = {}
    last = ""
    for line in lines[1:]:
        if line[:1] in (" ", "\t") and last:  # a folded line
            out[last] += " " + line.strip()
            continue
        name, _, value = line.partition(":")
        last = name.strip().lower()
        out[last] = value.strip()
    return out, end + 4


@dataclass
class Found:
    """A record's headers, where it is, and how to get its block."""

    headers: dict[str, str]
    offset: int
    block: Callable[[], bytes]


def _plain(handle, start: int, stop: int) -> Iterator[Found]:
    at = start
    while at < stop:
        size = HEAD
        while True:
            handle.seek(at)
            data = handle.read(size)
            got = parse_headers(data)
            if got or len(data) < size:
                break
            size *= 4
        if not got:
            if data.strip():
                raise ValueError(f"a record's headers are cut off at byte {at}")
            return
        headers, begin = got
        length = int(headers.get("content-length", 0))

        def block(data: bytes = data, begin: int = begin, length: int = length, at: int = at) -> bytes:
            if begin + length <= len(data):
                return data[begin : begin + length]
            handle.seek(at + begin)
            return handle.read(length)

        yield Found(headers, at, block)
        at += begin + length + 4


def _members(handle, start: int, stop: int) -> Iterator[Found]:
    at = start
    while at < stop:
        handle.seek(at)
        first = handle.read(HEAD)
        if len(first) < 18:
            return
        if first[:3] != b"\x1f\x8b\x08":
            raise ValueError(f"no gzip member at byte {at}")
        known = struct.unpack("<I", first[16:20])[0] if first[3] == 4 and first[12:14] == b"sl" else 0
        inflate = zlib.decompressobj(31)
        head, fed = inflate.decompress(first, HEAD), len(first)
        while not parse_headers(head):
            more = inflate.unconsumed_tail or handle.read(HEAD)
            fed += 0 if inflate.unconsumed_tail else len(more)
            if not more or inflate.eof:
                raise ValueError(f"a record's headers are cut off at byte {at}")
            head += inflate.decompress(more, HEAD)
        headers, begin = parse_headers(head)
        length = int(headers.get("content-length", 0))
        whole: list[bytes] = []

        def rest(inflate=inflate, head: bytes = head, whole: list = whole, at: int = at, fed: int = fed) -> None:
            """Inflate the member to its end; the position behind it is known then."""
            parts, position = [head], fed
            handle.seek(at + fed)
            data = inflate.unconsumed_tail
            while not inflate.eof:
                if not data:
                    data = handle.read(1 << 20)
                    position += len(data)
                    if not data:
                        raise ValueError(f"a gzip member is cut off at byte {at}")
                parts.append(inflate.decompress(data))
                data = b""
            whole[:] = [b"".join(parts), position - len(inflate.unused_data)]

        def block(begin: int = begin, length: int = length, whole: list = whole, rest=rest) -> bytes:
            if not whole:
                rest()
            return whole[0][begin : begin + length]

        yield Found(headers, at, block)
        if not known and not whole:
            rest()
        at += known or whole[1]


def records(handle, compressed: bool, start: int, stop: int) -> Iterator[Found]:
    return (_members if compressed else _plain)(handle, start, stop)


def _bare(value: str | None) -> str | None:
    return value[1:-1] if value and value[:1] == "<" and value[-1:] == ">" else value


def digest_hex(value: str | None) -> str | None:
    """A SHA-1 payload digest as lower-case hex, whichever of the usual spellings it has; others as they are."""
    if not value or not value.lower().startswith("sha1:"):
        return value
    bare = value[5:]
    return bare.lower() if len(bare) == 40 else base64.b32decode(bare.upper()).hex()


def header_row(found: Found) -> dict:
    h = found.headers
    return {
        "record_id": _bare(h.get("warc-record-id")), "record_type": h.get("warc-type"), "target_uri": _bare(h.get("warc-target-uri")), "date": h.get("warc-date"),
        "refers_to": _bare(h.get("warc-refers-to")), "payload_digest": digest_hex(h.get("warc-payload-digest")), "content_type": h.get("content-type"),
        "content_length": int(h.get("content-length", 0)),
    }


def http_parts(content_type: str | None, block: bytes) -> tuple[int | None, int | None, bytes]:
    """Status, Content-Length and body of a block that holds an HTTP response; of others the block itself."""
    if not (content_type or "").startswith("application/http") or not block.startswith(b"HTTP/"):
        return None, None, block
    end = block.find(b"\r\n\r\n")
    head, body = (block[:end], block[end + 4 :]) if end >= 0 else (block, b"")
    status, length = head.split(b"\r\n", 1)[0].split(b" ")[1:2], None
    for line in head.split(b"\r\n")[1:]:
        name, _, value = line.partition(b":")
        if name.strip().lower() == b"content-length" and value.strip().isdigit():
            length = int(value)
    return int(status[0]) if status and status[0].isdigit() else None, length, body


# filters


def _test(f: Filter) -> Callable[[dict], bool] | None:
    """The filter as a test of a header row, with SQL's null; None if headers can't decide it."""
    if isinstance(f, Not):
        inner = f.child
        if isinstance(inner, EqualNullSafe | IsNull | IsNotNull):
            test = _test(inner)
            return None if test is None else lambda r: not test(r)
        test = _test(inner)
        column = getattr(inner, "attribute", (None,))[0]
        # a null makes NOT(...) null as well, which keeps no row
        return None if test is None or isinstance(inner, Not) else lambda r: r[column] is not None and not test(r)
    attribute = getattr(f, "attribute", None)
    if not attribute or len(attribute) != 1 or attribute[0] not in HEADERS:
        return None
    c, v = attribute[0], getattr(f, "value", None)
    if isinstance(f, IsNull):
        return lambda r: r[c] is None
    if isinstance(f, IsNotNull):
        return lambda r: r[c] is not None
    if isinstance(f, EqualNullSafe):
        return lambda r: r[c] == v
    has = lambda test: lambda r: r[c] is not None and test(r[c])
    tests = {
        EqualTo: lambda x: v is not None and x == v, GreaterThan: lambda x: x > v, GreaterThanOrEqual: lambda x: x >= v,
        LessThan: lambda x: x < v, LessThanOrEqual: lambda x: x <= v, In: lambda x: x in v,
        StringStartsWith: lambda x: x.startswith(v), StringEndsWith: lambda x: x.endswith(v), StringContains: lambda x: v in x,
    }
    return has(tests[type(f)]) if type(f) in tests else None


# reading


@dataclass
class Slice(InputPartition):
    """Records of one file that start in [start, stop)."""

    path: str
    start: int
    stop: int

    def __init__(self, path: str, start: int, stop: int) -> None:
        super().__init__(path)
        self.path, self.start, self.stop = path, start, stop


class WarcReader(DataSourceReader):
    def __init__(self, path: str, payload: bool) -> None:
        self.path, self.payload = path, payload
        self.filters: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            if _test(f) is None:
                yield f
            else:
                self.filters.append(f)

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        system, root = _open(self.path)
        base = self.path.rstrip("/")
        info = system.get_file_info(root)
        if info.type == fs.FileType.File:
            return [Slice(base, 0, info.size)]
        listed = {i.base_name: i for i in system.get_file_info(fs.FileSelector(root)) if i.type == fs.FileType.File}
        out: list[InputPartition] = []
        manifests = [n for n in listed if n.startswith("_manifest-")]
        for name in sorted(manifests):
            with system.open_input_stream(f"{root}/{name}") as f:
                for file in json.loads(f.read())["files"]:
                    cuts = [*file["syncs"], file["size"]]
                    out += [Slice(f"{base}/{file['name']}", a, b) for a, b in zip(cuts, cuts[1:], strict=False) if a < b]
        if not manifests:
            out = [Slice(f"{base}/{n}", 0, i.size) for n, i in sorted(listed.items()) if n.endswith((".warc", ".warc.gz"))]
        return out or [Slice("", 0, 0)]

    def read(self, partition: Slice) -> Iterator[pa.RecordBatch]:
        if partition.stop <= partition.start:
            return
        system, path = _open(partition.path)
        tests = [_test(f) for f in self.filters]
        names = [*HEADER_NAMES, *(["payload"] if self.payload else [])]
        types = [*HEADER_TYPES, *([pa.binary()] if self.payload else [])]
        rows: list[dict] = []
        held = 0
        with system.open_input_file(path) as handle:
            for found in records(handle, path.endswith(".gz"), partition.start, partition.stop):
                row = header_row(found)
                if not all(t(row) for t in tests):
                    continue
                row |= {"headers": list(found.headers.items()), "file": partition.path, "offset": found.offset, "payload_length": None, "http_status": None}
                if self.payload or row["record_type"] == "revisit":
                    row["http_status"], row["payload_length"], body = http_parts(row["content_type"], found.block())
                    if self.payload:
                        row["payload"] = body if row["record_type"] != "revisit" else None
                        held += len(body)
                rows.append(row)
                held += 500
                if held > BATCH:
                    yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in zip(names, types, strict=True)], names=names)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in zip(names, types, strict=True)], names=names)


HEADER_NAMES = [c.split()[0] for c in HEADER_SCHEMA.split(", ")]
HEADER_TYPES = [{"string": pa.string(), "long": pa.int64(), "int": pa.int32()}.get(c.split()[1], pa.map_(pa.string(), pa.string())) for c in HEADER_SCHEMA.split(", ")]


# writing


@dataclass
class Written(WriterCommitMessage):
    name: str
    size: int
    syncs: list[int]


class WarcWriter(DataSourceArrowWriter):
    """Writes rows ``(record_id, record_type, target_uri, refers_to, payload_digest, payload_length, payload)``."""

    def __init__(self, path: str, compress: bool, date: str) -> None:
        self.path, self.compress, self.date = path.rstrip("/"), compress, date

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        system, root = _open(self.path)
        system.create_dir(root, recursive=True)
        name = f"part-{uuid.uuid4().hex}.warc" + ".gz" * self.compress
        at, syncs = 0, [0]
        with system.open_output_stream(f"{root}/{name}", compression=None) as out:
            for batch in iterator:
                columns = [batch.column(batch.schema.get_field_index(c)) for c in ("record_id", "record_type", "target_uri", "refers_to", "payload_digest", "payload_length", "payload")]
                for values in zip(*columns, strict=True):
                    rid, kind, uri, refers, digest, length, payload = (v.as_py() for v in values)
                    data = record(rid, kind, uri or "", payload or b"", length, digest, self.date, refers)
                    data = gzip_member(data) if self.compress else data
                    if at - syncs[-1] >= SYNC:
                        syncs.append(at)
                    out.write(data)
                    at += len(data)
        return Written(name, at, syncs)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        system, root = _open(self.path)
        system.create_dir(root, recursive=True)
        files = [{"name": m.name, "size": m.size, "syncs": m.syncs} for m in messages if m is not None]
        with system.open_output_stream(f"{root}/_manifest-{uuid.uuid4().hex}.json") as f:
            f.write(json.dumps({"files": files}).encode())

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        system, root = _open(self.path)
        for m in messages:
            if m is not None:
                system.delete_file(f"{root}/{m.name}")


class WarcSource(DataSource):
    """``format("warc")``; options: path, payload (true), compress (true), date."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def _flag(self, name: str) -> bool:
        return self.options.get(name, "true").lower() == "true"

    def schema(self) -> str:
        return HEADER_SCHEMA + ", payload binary" * self._flag("payload")

    def reader(self, schema) -> DataSourceReader:
        return WarcReader(self.options["path"], self._flag("payload"))

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return WarcWriter(self.options["path"], self._flag("compress"), self.options.get("date", "2020-01-01T00:00:00Z"))


def use(spark: SparkSession) -> None:
    """Make the source known to a session, and let filters reach it."""
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


# pages


def as_records(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", payload_column: str = "html", least: int = LEAST_REVISIT) -> DataFrame:
    """A record per row: the largest id of equal payloads of ``least`` bytes or more is a response, others revisit it.

    A null payload is empty.  A null id is below all others; equal payloads under null ids only are
    all responses, and so are repeated rows of the largest id.
    """
    payload = F.coalesce(F.col(payload_column).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_column).cast("long").alias("id"), F.col(url_column).cast("string").alias("target_uri"), payload.alias("payload"))
    rows = rows.withColumns({"payload_digest": F.sha1("payload"), "payload_length": F.octet_length("payload").cast("long")})
    # few payloads are repeated; they are summed to one row each before anything is joined
    large = rows.where(F.col("payload_length") >= least)
    repeated = large.groupBy(F.col("payload_digest").alias("d"), F.col("payload_length").alias("n")).agg(F.max("id").alias("first"), F.count("*").alias("times")).where("times > 1 AND first IS NOT NULL")
    joined = rows.join(repeated, (F.col("payload_digest") == F.col("d")) & (F.col("payload_length") == F.col("n")), "left")
    revisit = F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    named = lambda c: F.concat(F.lit(RECORD_ID), F.coalesce(F.col(c).cast("string"), F.lit("null")))
    return joined.select(
        named("id").alias("record_id"), F.when(revisit, "revisit").otherwise("response").alias("record_type"), "target_uri",
        F.when(revisit, named("first")).alias("refers_to"), "payload_digest", "payload_length",
        F.when(~revisit, F.col("payload")).alias("payload"),
    )


def write_archives(pages: DataFrame, path: str, compress: bool = True, **columns: str) -> None:
    use(pages.sparkSession)
    as_records(pages, **columns).write.format("warc").mode("append").option("compress", str(compress).lower()).save(path)


def read_archives(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    use(spark)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages through archives and back: responses by their payloads, revisits by their headers."""
    folder = f"{shared_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    write_archives(table(spark, sf_dir, "pages"), folder)
    number = lambda c: F.regexp_extract(c, r"(-?\d+)$", 1).try_cast("long")
    full = read_archives(spark, folder).where(F.col("record_type") == "response")
    responses = full.select(
        number("record_id").alias("page_id"), F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha1("payload").alias("payload_digest"), "record_type", F.lit(None).cast("long").alias("refers_to"),
    )
    bare = read_archives(spark, folder, payload=False).where(F.col("record_type") == "revisit")
    revisits = bare.select(number("record_id").alias("page_id"), F.col("payload_length").alias("payload_bytes"), "payload_digest", "record_type", number("refers_to").alias("refers_to"))
    return responses.unionByName(revisits)


ORACLE = """
WITH p AS (
    SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS n FROM pages
), m AS (
    SELECT html, max(page_id) AS first FROM p WHERE n >= 1000 GROUP BY html
)
SELECT p.page_id, CAST(p.n AS BIGINT) AS payload_bytes, sha1(p.html) AS payload_digest,
       CASE WHEN m.first IS NOT NULL AND m.first <> p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN m.first IS NOT NULL AND m.first <> p.page_id THEN m.first END AS refers_to
FROM p LEFT JOIN m ON p.html = m.html
"""
