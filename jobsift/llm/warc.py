"""WARC archives: a writer of records and a Python data source that reads them.

The data source plans partitions of whole files, takes record-type and header predicates into the scan,
parses headers first, and seeks past the payload of records that don't qualify or whose payload isn't
asked for.
"""

from __future__ import annotations

import gzip
import io
import sys
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualNullSafe, EqualTo, Filter, In, InputPartition, IsNotNull, IsNull, Not, StringContains, StringEndsWith, StringStartsWith

from .common import BROADCAST_ROWS, join_groups, stage

CRLF = "\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_BASE32HEX, _BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: Records of a file at most; with files of bounded size a partition is a few whole files.
FILE_RECORDS = 100_000
PARTITION_BYTES = 64 << 20

SCHEMA = (
    "record_id string, warc_type string, target_uri string, date string, payload_digest string, refers_to string,"
    " content_length long, payload_length long, headers map<string,string>, payload binary"
)
_HEADER_OF = {
    "record_id": "warc-record-id",
    "warc_type": "warc-type",
    "target_uri": "warc-target-uri",
    "date": "warc-date",
    "payload_digest": "warc-payload-digest",
    "refers_to": "warc-refers-to",
}


def sha1_base32(data: Column) -> Column:
    """Bare upper-case base32 SHA-1. 20 bits, five hexadecimal digits, make four of its characters."""
    hexed = F.sha1(data)
    parts = [F.lpad(F.conv(F.substring(hexed, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), _BASE32HEX, _BASE32)


def _record(kind: str, headers: list[tuple[str, Column]], http_length: Column, payload: Column | None) -> Column:
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), http_length.cast("string"), F.lit(CRLF * 2))
    block = F.octet_length(http) + (http_length if payload is not None else 0)
    lines = [F.lit(f"WARC/1.1{CRLF}WARC-Type: {kind}{CRLF}")]
    for name, value in [*headers, ("Content-Type", F.lit("application/http;msgtype=response")), ("Content-Length", block.cast("string"))]:
        safe = F.replace(F.replace(value, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
        lines.append(F.coalesce(F.concat(F.lit(f"{name}: "), safe, F.lit(CRLF)), F.lit("")))
    return F.concat(*lines, F.lit(CRLF), http, *([payload] if payload is not None else []))


def write_warc(pages: DataFrame, path: str, date: str = "1970-01-01T00:00:00Z", compression: str = "none", key: str = "page_id", url: str = "url", payload: str = "html") -> None:
    """Write a record for each row: of rows with equal payloads the one with the smallest key is the
    response, the others are revisits that refer to it. A null payload is empty. A row with a null key is
    always a response with an empty name, since nothing could refer to it; rows that repeat the smallest
    key are all responses. A null URL has no header, and line ends in one are percent-encoded. Payloads
    don't move between machines unless there are over BROADCAST_ROWS groups of equal ones."""
    body = F.coalesce(F.col(payload), F.lit(""))
    rows = pages.select(F.col(key).alias("_key"), F.col(url).cast("string").alias("_url"), body.alias("_body"), sha1_base32(body.cast("binary")).alias("_digest"))
    groups = rows.groupBy("_digest").agg(F.min("_key").alias("_first"), F.count("*").alias("_rows")).filter("_rows > 1")
    groups = stage(groups, "payloads")
    if groups.count() <= BROADCAST_ROWS:
        rows = rows.join(F.broadcast(groups), "_digest", "left")
    else:
        rows = join_groups(rows, groups, "_digest", "_rows", pages.count(), "left")

    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    length = F.octet_length("_body").cast("long")
    same = [("WARC-Record-ID", name(F.col("_key"))), ("WARC-Date", F.lit(date)), ("WARC-Target-URI", F.col("_url")), ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "_digest"))]
    response = _record("response", same, length, F.col("_body"))
    revisit = _record("revisit", [*same, ("WARC-Profile", F.lit(REVISIT_PROFILE)), ("WARC-Refers-To", name(F.col("_first")))], length, None)
    record = F.when(F.col("_key") > F.col("_first"), revisit).otherwise(response).alias("value")
    # a record ends with two line ends, so the text writer makes a WARC file of rows
    out = rows.select(record).write.option("lineSep", CRLF * 2).option("maxRecordsPerFile", FILE_RECORDS)
    out.option("compression", compression).text(path)


@dataclass
class _Files(InputPartition):
    paths: list[str]


def _filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return pafs.FileSystem.from_uri(path if "://" in path else "file://" + path[5:])
    return pafs.LocalFileSystem(), path


def _test(f: Filter) -> tuple[str, Callable[[str | None], bool]] | None:
    """A predicate on one header, if the filter is that."""
    if isinstance(f, Not):
        inner = _test(f.child)
        if inner is None or isinstance(f.child, (IsNull, IsNotNull)):
            return None
        return inner[0], lambda v, t=inner[1]: v is not None and not t(v)
    column = ".".join(getattr(f, "attribute", ()))
    if column not in _HEADER_OF:
        return None
    match f:
        case EqualTo() | EqualNullSafe():
            return column, lambda v: v == f.value
        case In():
            return column, lambda v: v in f.value
        case IsNotNull():
            return column, lambda v: v is not None
        case IsNull():
            return column, lambda v: v is None
        case StringStartsWith():
            return column, lambda v: v is not None and v.startswith(f.value)
        case StringEndsWith():
            return column, lambda v: v is not None and v.endswith(f.value)
        case StringContains():
            return column, lambda v: v is not None and f.value in v
    return None


class WarcReader(DataSourceReader):
    def __init__(self, path: str, columns: list[str], schema) -> None:
        self.path, self.columns, self.schema = path, columns, schema
        self.tests: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if _test(f) is None:
                yield f
            else:
                self.tests.append(f)

    def partitions(self) -> list[InputPartition]:
        fs, root = _filesystem(self.path)
        info = fs.get_file_info(root)
        found = [info] if info.type == pafs.FileType.File else fs.get_file_info(pafs.FileSelector(root, recursive=True))
        files = sorted((x.path, x.size) for x in found if x.type == pafs.FileType.File and not x.base_name.startswith(("_", ".")) and x.size)
        parts: list[_Files] = []
        room = 0
        for path, size in files:
            if not parts or size > room:
                parts.append(_Files([]))
                room = PARTITION_BYTES
            parts[-1].paths.append(path)
            room -= size
        return parts or [_Files([])]

    def read(self, partition: _Files) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        fs, _ = _filesystem(self.path)
        tests = [t for f in self.tests if (t := _test(f))]
        kinds = to_arrow_schema(self.schema)
        rows: list[dict] = []
        held = 0
        for path in partition.paths:
            for row in read_records(fs, path, tests, "payload" in self.columns, "payload_length" in self.columns):
                rows.append(row)
                held += len(row.get("payload") or b"") + 500
                if held > 8 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array([r.get(f.name) for r in rows], f.type) for f in kinds], schema=kinds)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([r.get(f.name) for r in rows], f.type) for f in kinds], schema=kinds)


def _header_block(f: io.BufferedIOBase) -> tuple[str, dict[str, str], int]:
    """The first line, the fields by lower-case name, and the bytes read."""
    first = f.readline()
    read, fields, last = len(first), {}, None
    while True:
        line = f.readline()
        read += len(line)
        if line in (b"", b"\r\n", b"\n"):
            return first.decode("utf-8", "replace").strip(), fields, read
        text = line.decode("utf-8", "replace").rstrip("\r\n")
        if text[:1] in " \t" and last:
            fields[last] += " " + text.strip()
        else:
            name, _, value = text.partition(":")
            last = name.strip().lower()
            fields[last] = value.strip()


def read_records(fs: pafs.FileSystem, path: str, tests: list[tuple[str, Callable]], payload: bool, payload_length: bool) -> Iterator[dict]:
    """Records of a file that pass the tests. What isn't asked for is skipped unread."""
    raw = fs.open_input_file(path)
    f = gzip.GzipFile(fileobj=raw) if path.endswith(".gz") else io.BufferedReader(raw, 1 << 20)
    with raw, f:
        while True:
            lead = f.readline()
            while lead in (b"\r\n", b"\n"):
                lead = f.readline()
            if not lead:
                return
            if not lead.startswith(b"WARC/"):
                raise ValueError(f"{path}: no WARC record at byte {f.tell() - len(lead)}")
            _, fields, _ = _header_block(_Again(lead, f))
            left = int(fields.get("content-length", 0))
            row: dict = {name: fields.get(header) for name, header in _HEADER_OF.items()}
            if all(test(row[name]) for name, test in tests):
                row |= {"headers": list(fields.items()), "content_length": left, "payload_length": left}
                http = fields.get("content-type", "").startswith("application/http")
                if (payload or payload_length) and http and left:
                    _, own, read = _header_block(f)
                    left -= read
                    row["payload_length"] = int(own.get("content-length", left))
                if payload and row["warc_type"] != "revisit":
                    row["payload"] = f.read(left)
                    left = 0
                yield row
            if left:
                f.seek(left, 1)


class _Again:
    """A stream whose first line was read already."""

    def __init__(self, lead: bytes, f: io.BufferedIOBase) -> None:
        self.lead, self.f = lead, f

    def readline(self) -> bytes:
        lead, self.lead = self.lead, b""
        return lead or self.f.readline()


class WarcDataSource(DataSource):
    """spark.read.format("warc").load(path). Give a schema of the columns wanted: without payload in it,
    payloads aren't read."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options["path"], schema.names, schema)


def read_warc(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """Records of all files below a path; an empty folder has none. columns: names from SCHEMA."""
    cloudpickle.register_pickle_by_value(sys.modules[__name__])  # its planning worker can't import this package
    spark.dataSource.register(WarcDataSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    whole = T.StructType.fromDDL(SCHEMA)
    wanted = T.StructType([f for f in whole if columns is None or f.name in columns])
    return spark.read.format("warc").schema(wanted).load(path)
