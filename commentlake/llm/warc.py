"""WARC archives as a PySpark Python data source, reading and writing.

Reading plans one partition for each bundle of files, parses a record's header
block first and looks at its payload only if the record passes the pushed
filters on record type and headers; otherwise the payload is skipped (by seek
in plain files).  Writing rolls files at a bounded size into a staging folder;
they get their place when the job commits, so lost or repeated tasks leave no
record twice.

Defined results: a null payload is an empty one; control characters in header
values become %XX; a null record id stays null; a truncated or foreign record
raises an error that names file and position, as nothing may be lost silently.
Of pages with equal payloads all that bear the largest page_id are responses;
a page without page_id is always a response.  An empty table writes no records and
reads back as none; other columns are not read.
"""

from __future__ import annotations

import base64
import gzip
import io
import operator
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import (DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, GreaterThan,
                                    GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual,
                                    StringStartsWith, WriterCommitMessage)

from ..session import scratch_path
from .common import stored, table

#: Payloads from this size on are written once.
REVISIT_BYTES = 1000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

SCHEMA = T.StructType([
    T.StructField("record_id", T.StringType()), T.StructField("warc_type", T.StringType()),
    T.StructField("target_uri", T.StringType()), T.StructField("date", T.StringType()),
    T.StructField("refers_to", T.StringType()), T.StructField("payload_digest", T.StringType()),
    T.StructField("content_length", T.LongType()), T.StructField("payload_length", T.LongType()),
    T.StructField("payload", T.BinaryType())])
_ARROW = pa.schema([(f.name, {"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary()}[f.dataType.simpleString()])
                    for f in SCHEMA])
#: Column of a header, for pushed filters.
HEADERS = {"record_id": "warc-record-id", "warc_type": "warc-type", "target_uri": "warc-target-uri",
           "date": "warc-date", "content_length": "content-length"}
#: Filters that are pushed.
COMPARE = {EqualTo: operator.eq, GreaterThan: operator.gt, GreaterThanOrEqual: operator.ge, LessThan: operator.lt,
           LessThanOrEqual: operator.le, In: lambda own, values: own in values, StringStartsWith: str.startswith}


def _clean(value: str) -> str:
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def record_bytes(row: dict, date: str) -> bytes:
    """One record.  A revisit keeps the HTTP header, and so the payload's
    length, but not the payload."""
    payload = row["payload"] or b""
    kind = row["warc_type"]
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if kind == "revisit" else head + payload
    digest = base64.b32encode(bytes.fromhex(row["payload_digest"])).decode()
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Date: {row.get('date') or date}",
             "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{digest}"]
    if row["record_id"] is not None:
        lines.append(f"WARC-Record-ID: <{_clean(row['record_id'])}>")
    if row["target_uri"] is not None:
        lines.append(f"WARC-Target-URI: {_clean(row['target_uri'])}")
    if row["refers_to"] is not None:
        lines += [f"WARC-Refers-To: <{_clean(row['refers_to'])}>", f"WARC-Profile: {PROFILE}"]
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def records(stream, seekable: bool, wanted, name: str) -> Iterator[tuple[dict, bytes]]:
    """(headers, block) of the records whose headers ``wanted`` accepts."""
    at = 0
    while True:
        line = stream.readline()
        if not line:
            return
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"{name}: no WARC record after record {at}")
        at += 1
        head: dict[str, str] = {}
        while (line := stream.readline()).strip():
            key, _, value = line.decode("utf-8", "replace").partition(":")
            head[key.strip().lower()] = value.strip()
        if not line or not head.get("content-length", "").isdigit():
            raise ValueError(f"{name}: record {at} has no whole header")
        length = int(head["content-length"])
        if wanted(head):
            block = stream.read(length)
            if len(block) < length:
                raise ValueError(f"{name}: record {at} is truncated")
            yield head, block
        elif seekable:
            stream.seek(length, io.SEEK_CUR)
        else:
            while length and (part := stream.read(min(length, 1 << 20))):
                length -= len(part)
            if length:
                raise ValueError(f"{name}: record {at} is truncated")


def parsed(head: dict, block: bytes) -> tuple:
    """A row of SCHEMA."""
    payload, size = block, len(block)
    if head.get("content-type", "").startswith("application/http"):
        http, _, payload = block.partition(b"\r\n\r\n")
        m = re.search(rb"(?im)^content-length:\s*(\d+)", http)
        size = int(m[1]) if m else len(payload)
    kind = head.get("warc-type")
    algorithm, _, digest = head.get("warc-payload-digest", "").partition(":")
    if algorithm == "sha1" and len(digest) == 32:
        digest = base64.b32decode(digest).hex()
    bare = lambda k: head[k].strip("<>") if k in head else None
    return (bare("warc-record-id"), kind, head.get("warc-target-uri"), head.get("warc-date"), bare("warc-refers-to"),
            digest or None, int(head["content-length"]), size, None if kind == "revisit" else payload)


class WarcPartition(InputPartition):
    def __init__(self, files: list[str]):
        self.files = files


class WarcReader(DataSourceReader):
    def __init__(self, path: str, bundle: int):
        self.path, self.bundle, self.tests = path, bundle, []

    def pushFilters(self, filters):  # noqa: N802 - the interface's name
        """Takes comparisons with a header; the others are Spark's."""
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if type(f) in COMPARE and name in HEADERS:
                self.tests.append((name, type(f), f.value))
            else:
                yield f

    def wanted(self, head: dict) -> bool:
        for name, op, value in self.tests:
            own = head.get(HEADERS[name])
            if own is None:
                return False
            own = int(own) if name == "content_length" else own.strip("<>") if name == "record_id" else own
            if not COMPARE[op](own, value):
                return False
        return True

    def partitions(self):
        fs, root = pafs.FileSystem.from_uri(self.path)
        info = fs.get_file_info(root)
        files = [info] if info.is_file else fs.get_file_info(pafs.FileSelector(root, recursive=True))
        files = sorted(((f.path, f.size) for f in files if f.is_file and "/_" not in f.path[len(root):]
                        and re.search(r"\.warc(\.gz)?$", f.path)))
        out: list[list[str]] = []
        size = 0
        for path, n in files:
            if not out or size + n > self.bundle:
                out.append([])
                size = 0
            out[-1].append(path)
            size += n
        return [WarcPartition(x) for x in out]

    def read(self, partition):
        fs, _ = pafs.FileSystem.from_uri(self.path)
        rows, size = [], 0
        for name in getattr(partition, "files", []):
            with fs.open_input_file(name) as raw:
                packed = name.endswith(".gz")
                stream = io.BufferedReader(gzip.GzipFile(fileobj=raw), 1 << 18) if packed else io.BufferedReader(raw, 1 << 18)
                for head, block in records(stream, not packed, self.wanted, name):
                    rows.append(parsed(head, block))
                    size += len(block)
                    if size > 1 << 23 or len(rows) >= 4096:
                        yield _batch(rows)
                        rows, size = [], 0
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)],
                                      schema=_ARROW)


class WarcFiles(WriterCommitMessage):
    def __init__(self, files: list[str]):
        self.files = files


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, path: str, options: dict):
        self.path, self.job = path, uuid.uuid4().hex
        self.packed = options.get("compression", "gzip") == "gzip"
        self.level = int(options.get("level", 3))
        self.roll = int(options.get("maxfilebytes", 128 << 20))
        self.date = options.get("date", "1970-01-01T00:00:00Z")

    def write(self, batches) -> WarcFiles:
        fs, root = pafs.FileSystem.from_uri(self.path)
        fs.create_dir(f"{root}/_staging-{self.job}", recursive=True)
        files, out = [], None
        for batch in batches:
            for row in batch.to_pylist():
                data = record_bytes(row, self.date)
                if self.packed:
                    z = zlib.compressobj(self.level, zlib.DEFLATED, 31)
                    data = z.compress(data) + z.flush()
                if out is None:
                    files.append(f"{uuid.uuid4().hex}.warc" + ".gz" * self.packed)
                    out = fs.open_output_stream(f"{root}/_staging-{self.job}/{files[-1]}", compression=None)
                out.write(data)
                if out.tell() >= self.roll:
                    out.close()
                    out = None
        if out is not None:
            out.close()
        return WarcFiles(files)

    def commit(self, messages) -> None:
        fs, root = pafs.FileSystem.from_uri(self.path)
        fs.create_dir(root, recursive=True)
        for m in messages:
            for f in m.files if m else []:
                fs.move(f"{root}/_staging-{self.job}/{f}", f"{root}/{f}")
        self._unstage(fs, root)

    def abort(self, messages) -> None:
        self._unstage(*pafs.FileSystem.from_uri(self.path))

    def _unstage(self, fs, root) -> None:
        if fs.get_file_info(f"{root}/_staging-{self.job}").type == pafs.FileType.Directory:
            fs.delete_dir(f"{root}/_staging-{self.job}")


class WarcDataSource(DataSource):
    """format("warc").  Options: path; reading: bundlebytes (files up to this
    size together make one partition); writing: compression (gzip, none), level,
    maxfilebytes, date (of records that have none)."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(self.options["path"], int(self.options.get("bundlebytes", 16 << 20)))

    def writer(self, schema, overwrite):
        return WarcWriter(self.options["path"], self.options)


def read_warc(spark: SparkSession, path: str, **options) -> DataFrame:
    """Records under ``path``.  Filters on record type and headers are pushed."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)
    return spark.read.format("warc").options(**options).load(path)


def write_warc(df: DataFrame, path: str, **options) -> None:
    """Writes rows of SCHEMA (without the length columns) as records."""
    df.sparkSession.dataSource.register(WarcDataSource)
    df.write.format("warc").options(**options).mode("append").save(path)


def page_records(pages: DataFrame, revisit_bytes: int = REVISIT_BYTES) -> DataFrame:
    """Records of ``pages``; equal payloads of at least ``revisit_bytes`` are
    kept once, by the largest page_id, and revisited by the others.  The heads
    of such groups are pre-aggregated and stored, so the join knows their size."""
    p = pages.select("page_id", "url", F.encode(F.coalesce("html", F.lit("")), "utf-8").alias("payload"))
    p = p.withColumn("payload_digest", F.sha1("payload"))
    heads = stored(p.filter(F.octet_length("payload") >= revisit_bytes).groupBy("payload_digest")
                   .agg(F.max("page_id").alias("head"), F.count("*").alias("n")).filter("n > 1")
                   .select("payload_digest", "head"), "warc-heads")
    urn = lambda c: F.concat(F.lit("urn:page:"), c.cast("string"))
    again = F.col("page_id") < F.col("head")
    return p.join(heads, "payload_digest", "left").select(
        urn(F.col("page_id")).alias("record_id"), F.when(again, "revisit").otherwise("response").alias("warc_type"),
        F.col("url").alias("target_uri"), F.lit(None).cast("string").alias("date"),
        F.when(again, urn(F.col("head"))).alias("refers_to"), "payload_digest", "payload")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    write_warc(page_records(table(spark, sf_dir, "pages")), path)
    back = read_warc(spark, path)
    page = lambda c: F.regexp_extract(c, r"^urn:page:(-?\d+)$", 1).try_cast("long")
    kept = F.col("payload").isNotNull()
    return back.select(
        page("record_id").alias("page_id"), F.when(kept, F.octet_length("payload").cast("long"))
        .otherwise(F.col("payload_length")).alias("payload_bytes"),
        F.when(kept, F.sha1("payload")).otherwise(F.col("payload_digest")).alias("payload_digest"),
        F.col("warc_type").alias("record_type"), page("refers_to").alias("refers_to"), "target_uri")


OP1_SQL = """
WITH p AS (SELECT page_id, url, coalesce(html, '') AS body FROM pages),
q AS (SELECT page_id, url, sha1(body) AS payload_digest, strlen(body) AS payload_bytes FROM p),
h AS (SELECT payload_digest, max(page_id) AS head FROM q WHERE payload_bytes >= 1000 GROUP BY payload_digest)
SELECT q.page_id, CAST(q.payload_bytes AS BIGINT) AS payload_bytes, q.payload_digest,
       CASE WHEN q.page_id < h.head THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN q.page_id < h.head THEN h.head END AS refers_to, q.url AS target_uri
FROM q LEFT JOIN h ON q.payload_digest = h.payload_digest AND q.payload_bytes >= 1000
"""
