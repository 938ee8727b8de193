"""WARC archives: written through Spark's writer, read by a Python data source."""

from __future__ import annotations

import gzip
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, StringStartsWith

from tabloom.llm.common import durable

#: Columns that are WARC headers, and the header each comes from.
HEADERS = {
    "record_type": "warc-type",
    "record_id": "warc-record-id",
    "target_uri": "warc-target-uri",
    "warc_date": "warc-date",
    "refers_to": "warc-refers-to",
    "payload_digest": "warc-payload-digest",
    "content_type": "content-type",
}
#: Payloads shorter than this are never replaced by a reference.
LEAST_SHARED = 100
#: Bytes of archives in a partition, and of payloads handed on at once.
PARTITION_BYTES = 64 << 20
BATCH_BYTES = 4 << 20
_END = "\r\n"
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


@dataclass
class Files(InputPartition):
    paths: list[str] = field(default_factory=list)


def _system(path: str):
    """File system and path within it; any scheme that pyarrow opens."""
    from pyarrow import fs

    local = re.match(r"file:/+(.*)", path)
    if local or "://" not in path:
        return fs.LocalFileSystem(), "/" + local[1] if local else path
    return fs.FileSystem.from_uri(path)


class WarcDataSource(DataSource):
    """``spark.read.format("warc").load(folder)``: one row per record.

    Option ``payloads``: record types, separated by commas, whose payload is
    wanted (all by default, an empty text for none). Option ``extra``: further
    headers to read as text columns, as name=header separated by commas.
    """

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        extra = "".join(f", `{name}` string" for name in _extra(self.options))
        headers = ", ".join(f"{c} string" for c in HEADERS)
        return f"{headers}, http_length bigint, payload binary, file string, offset bigint{extra}"

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options, schema.names)


def _extra(options) -> dict[str, str]:
    pairs = [p.split("=", 1) for p in (options.get("extra") or "").split(",") if p]
    return {name: header.lower() for name, header in pairs}


class WarcReader(DataSourceReader):
    def __init__(self, options, names: Sequence[str]):
        self.path, self.names = options["path"], list(names)
        self.columns = HEADERS | _extra(options)
        wanted = options.get("payloads")
        self.payloads = None if wanted is None else {t for t in wanted.split(",") if t}
        self.filters: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Take what can be told from headers alone; the rest goes back to Spark."""
        for f in filters:
            column = f.attribute[0] if len(f.attribute) == 1 else None
            if column in self.columns and isinstance(f, (EqualTo, In, IsNotNull, StringStartsWith)):
                self.filters.append(f)
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        """Whole archives, several small ones together."""
        from pyarrow import fs

        system, folder = _system(self.path)
        prefix = self.path[: len(self.path) - len(folder)] if self.path.endswith(folder) else ""
        found = system.get_file_info(fs.FileSelector(folder, recursive=True, allow_not_found=True))
        found = [i for i in found if i.is_file and not re.search(r"/[._][^/]*$", i.path)]
        out, size = [Files()], 0
        for info in sorted(found, key=lambda i: i.path):
            if out[-1].paths and size + info.size > PARTITION_BYTES:
                out.append(Files())
                size = 0
            out[-1].paths.append(prefix + info.path)
            size += info.size
        return out

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for path in partition.paths:
            system, name = _system(path)
            with system.open_input_stream(name, compression=None) if name.endswith(".gz") else system.open_input_file(name) as raw:
                for row in self.records(raw, path, name.endswith(".gz")):
                    rows.append(row)
                    held += 500 + len(row["payload"] or b"")
                    if held >= BATCH_BYTES:
                        yield self.batch(rows)
                        rows, held = [], 0
        yield self.batch(rows)

    def batch(self, rows: list[dict]) -> pa.RecordBatch:
        kinds = {"payload": pa.binary(), "http_length": pa.int64(), "offset": pa.int64()}
        columns = [pa.array([r.get(n) for r in rows], kinds.get(n, pa.string())) for n in self.names]
        return pa.RecordBatch.from_arrays(columns, self.names)

    def records(self, raw, path: str, zipped: bool) -> Iterator[dict]:
        """Headers first; the block of a record that is not wanted is passed over unread or undecoded."""
        stream = _Lines(gzip.GzipFile(fileobj=raw) if zipped else raw, seeks=not zipped)
        while True:
            at = stream.at
            line = stream.line()
            if not line:
                return
            if not line.strip():
                continue
            if not line.startswith(b"WARC/"):
                raise ValueError(f"no WARC record at byte {at} of {path}")
            head = _head(stream)
            length = int(head["content-length"])
            row = {c: head.get(h) for c, h in self.columns.items()} | {"file": path, "offset": at}
            if not all(_holds(f, row) for f in self.filters):
                stream.skip(length)
                continue
            row["payload"] = None
            decoded = self.payloads is None or row["record_type"] in self.payloads
            if (row["content_type"] or "").startswith("application/http"):
                start = stream.at
                stream.line()
                inner = _head(stream)
                row["http_length"] = int(inner["content-length"]) if inner.get("content-length", "").isdigit() else None
                length -= stream.at - start
            if decoded:
                row["payload"] = stream.take(length)
            else:
                stream.skip(length)
            yield row


class _Lines:
    """Lines and blocks of a stream, and the place within it."""

    def __init__(self, stream, seeks: bool):
        self.stream, self.seeks, self.at, self.held, self.pos = stream, seeks, 0, b"", 0

    def _fill(self) -> bool:
        more = self.stream.read(1 << 18)
        self.held, self.pos = self.held[self.pos :] + more, 0
        return bool(more)

    def line(self) -> bytes:
        while (end := self.held.find(b"\n", self.pos)) < 0:
            if not self._fill():
                end = len(self.held) - 1
                break
        out = self.held[self.pos : end + 1]
        self.pos = end + 1
        self.at += len(out)
        return out

    def take(self, n: int) -> bytes:
        parts = [self.held[self.pos : self.pos + n]]
        self.pos += len(parts[0])
        short = n - len(parts[0])
        while short:
            more = self.stream.read(short)
            if not more:
                raise ValueError("archive ends within a record")
            parts.append(more)
            short -= len(more)
        self.at += n
        return b"".join(parts)

    def skip(self, n: int) -> None:
        near = min(n, len(self.held) - self.pos)
        self.pos += near
        if n > near:
            if self.seeks:
                self.stream.seek(n - near, 1)
            else:
                left = n - near
                while left and (more := self.stream.read(min(left, 1 << 20))):
                    left -= len(more)
        self.at += n


def _head(stream: _Lines) -> dict[str, str]:
    out: dict[str, str] = {}
    while (line := stream.line()).strip():
        name, _, value = line.decode("utf-8", "replace").partition(":")
        out[name.strip().lower()] = value.strip()
    return out


def _holds(f: Filter, row: dict) -> bool:
    value = row[f.attribute[0]]
    if isinstance(f, IsNotNull):
        return value is not None
    if value is None:
        return False
    if isinstance(f, EqualTo):
        return value == f.value
    if isinstance(f, In):
        return value in f.value
    return value.startswith(f.value)


def read_warc(spark: SparkSession, folder: str, **options: str) -> DataFrame:
    """One row per record of the archives below a folder; filters on header columns are pushed into the reader."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)
    return spark.read.format("warc").options(**options).load(folder)


def write_pages(pages: DataFrame, folder: str) -> None:
    """A record per row of (page_id, url, html), equal payloads stored once.

    Of rows with equal payloads of LEAST_SHARED bytes or more, those with the
    smallest page_id are ``response`` records and the others ``revisit`` records
    that name the smallest; without any page_id all are responses. A missing html
    is an empty payload, a missing url leaves its header out. Spark's text writer
    commits the files, so any folder that Spark writes to will do.
    """
    html = F.coalesce("html", F.lit(""))
    sized = pages.select(
        "page_id", "url", html.alias("html"), F.octet_length(html).alias("bytes"), F.sha2(html.cast("binary"), 256).alias("digest")
    )
    shared = sized.filter(F.col("bytes") >= LEAST_SHARED).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    # stored first, so that its measured size decides whether pages have to move at all
    shared = durable(shared.filter("n > 1").select("digest", "first"))
    # a payload that a third of all pages share meets one row: large partitions of the join are split
    placed = sized.join(shared, "digest", "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    url = F.regexp_replace("url", r"[\x00-\x20\x7f]", "%20")
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("none")), F.lit(">"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(_END))
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{_END}Content-Type: text/html; charset=utf-8{_END}"),
        line("Content-Length", F.col("bytes").cast("string")),
        F.lit(_END),
    )
    body = F.when(revisit, F.lit("")).otherwise(F.col("html"))
    length = F.length(http) + F.octet_length(body)  # the HTTP head is ASCII
    record = F.concat(
        F.lit(f"WARC/1.1{_END}"),
        line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", urn(F.col("page_id"))),
        F.coalesce(line("X-Page-ID", F.col("page_id").cast("string")), F.lit("")),
        F.lit(f"WARC-Date: 1970-01-01T00:00:00Z{_END}"),
        F.coalesce(line("WARC-Target-URI", url), F.lit("")),
        F.coalesce(F.when(revisit, F.concat(line("WARC-Refers-To", urn(F.col("first"))), F.lit(f"WARC-Profile: {_REVISIT}{_END}"))), F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        F.lit(f"Content-Type: application/http; msgtype=response{_END}"),
        line("Content-Length", length.cast("string")),
        F.lit(_END),
        http,
        body,
    )
    placed.select(record.alias("value")).write.option("lineSep", _END * 2).text(folder)
