"""WARC archives as a Spark data source: ``spark.read/write.format("warc")``.

Writing. Each task writes one ``.warc.gz`` of one gzip member a record and an index of the members' offsets under names of its
own; the commit lists the files of successful tasks in ``_manifest.json``, so what lost or repeated attempts leave is
never read. Of rows with ``refers_to`` only the HTTP head is stored, as a revisit record.

Reading. The driver plans partitions from the manifest (or, in foreign folders, from the files' names): ranges of records of
indexed files, whole files otherwise. Header predicates that Spark pushes down (``spark.sql.python.filterPushdown.enabled``)
are tested on a record's head, of which only the first bytes are inflated; the payload is inflated for
records that pass, and not at all with the option ``payload=false``.

Columns: page_id, record_type, url, refers_to, payload_digest (SHA-256, lower-case hex, of the full payload),
payload_bytes (of the full payload) and payload (null for revisits). Paths are URIs that pyarrow's file systems open.

Defined results: null html is an empty payload; a null url has no header and is read as null, line ends in it are
percent-encoded; rows without page_id are always responses and are read back without one; rows of the same page_id and
payload are all responses; an empty table makes an archive without records. Further columns are not stored.
"""

from __future__ import annotations

import json
import posixpath
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualNullSafe,
    EqualTo,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    IsNotNull,
    IsNull,
    LessThan,
    LessThanOrEqual,
    StringStartsWith,
    WriterCommitMessage,
)

from . import common

SCHEMA = "page_id long, record_type string, url string, refers_to long, payload_digest string, payload_bytes long, payload binary"
ARROW = pa.schema([("page_id", pa.int64()), ("record_type", pa.string()), ("url", pa.string()), ("refers_to", pa.int64()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary())])
URN = "urn:lumindex:page:"
MANIFEST = "_manifest.json"
REVISIT_FROM = 100  # bytes: smaller payloads are stored again and again
PARTITION = 32 << 20  # compressed bytes that one read partition takes
HEAD = 4096  # bytes inflated at first to find a record's head
CHUNK = 1 << 20
BATCH = 16 << 20  # payload bytes after which a batch of rows is handed on


def opened(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def record(page_id, url, date: str, digest: str, payload: bytes, refers_to) -> bytes:
    """One WARC record; of a revisit the block is the HTTP head alone."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{URN}{'' if page_id is None else page_id}>", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    head.append(f"WARC-Payload-Digest: sha256:{digest}")
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{URN}{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def number(urn: str | None) -> int | None:
    m = re.fullmatch(rf"<{URN}(-?\d+)>", urn or "")
    return int(m[1]) if m else None


def parsed(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    return {k.strip().lower(): v.strip(" ") for k, _, v in (line.partition(":") for line in lines[1:])}


def header_row(h: dict[str, str]) -> dict:
    return {
        "page_id": number(h.get("warc-record-id")), "record_type": h.get("warc-type"), "url": h.get("warc-target-uri"), "refers_to": number(h.get("warc-refers-to")),
        "payload_digest": h.get("warc-payload-digest", "").removeprefix("sha256:") or None,
    }


HEADER_COLUMNS = ("page_id", "record_type", "url", "refers_to", "payload_digest")
TESTS = {
    EqualTo: lambda a, b: a is not None and a == b, EqualNullSafe: lambda a, b: a == b, In: lambda a, b: a is not None and a in b,
    GreaterThan: lambda a, b: a is not None and a > b, GreaterThanOrEqual: lambda a, b: a is not None and a >= b,
    LessThan: lambda a, b: a is not None and a < b, LessThanOrEqual: lambda a, b: a is not None and a <= b,
    IsNull: lambda a, _: a is None, IsNotNull: lambda a, _: a is not None, StringStartsWith: lambda a, b: a is not None and a.startswith(b),
}


class Span(InputPartition):
    """Records ``first`` to ``last`` of an indexed file, or all of another."""

    def __init__(self, path: str, offsets: list[int] | None = None):
        self.path, self.offsets = path, offsets


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.payload = str(options.get("payload", "true")).lower() != "false"
        self.partition = int(options.get("partitionbytes", PARTITION))
        self.filters: list[tuple[str, type, object]] = []

    def pushFilters(self, filters):
        for f in filters:
            column = f.attribute[0]
            if type(f) in TESTS and len(f.attribute) == 1 and column in HEADER_COLUMNS:
                self.filters.append((column, type(f), getattr(f, "value", None)))
            else:
                yield f

    def partitions(self):
        fs, root = opened(self.path)
        manifest = posixpath.join(root, MANIFEST)
        if fs.get_file_info(manifest).type == pafs.FileType.File:
            with fs.open_input_stream(manifest) as f:
                names = json.loads(f.read())["files"]
        else:
            infos = fs.get_file_info(pafs.FileSelector(root)) if fs.get_file_info(root).type == pafs.FileType.Directory else [fs.get_file_info(root)]
            root = root if fs.get_file_info(root).type == pafs.FileType.Directory else posixpath.dirname(root)
            names = [posixpath.basename(i.path) for i in infos if re.search(r"\.warc(\.gz)?$", i.path)]
        out = []
        for name in sorted(names):
            path = posixpath.join(root, name)
            if fs.get_file_info(path + ".idx").type != pafs.FileType.File:
                out.append(Span(path))
                continue
            with fs.open_input_stream(path + ".idx") as f:
                at = np.frombuffer(f.read(), "<i8")
            first = 0
            while first < len(at) - 1:
                last = max(first + 1, int(np.searchsorted(at, at[first] + self.partition, "right")) - 1)
                out.append(Span(path, at[first : last + 1].tolist()))
                first = last
        return out

    def wanted(self, row: dict) -> bool:
        return all(TESTS[kind](row[column], value) for column, kind, value in self.filters)

    def read(self, partition):
        if partition is None:  # nothing was planned: the archive has no records
            return
        fs, _ = opened(self.path)
        rows, size = [], 0
        with fs.open_input_file(partition.path) as f:
            for row in self.indexed(f, partition.offsets) if partition.offsets else self.streamed(f, partition.path.endswith(".gz")):
                rows.append(row)
                size += len(row["payload"] or b"") + 200
                if size >= BATCH:
                    yield pa.RecordBatch.from_pylist(rows, ARROW)
                    rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, ARROW)

    def indexed(self, f, offsets: list[int]) -> Iterator[dict]:
        """Records by their offsets: heads first, the rest of those that are wanted."""
        for begin, end in zip(offsets, offsets[1:], strict=False):
            f.seek(begin)
            raw = f.read(end - begin)
            z = zlib.decompressobj(31)

            def more(z=z, begin=begin) -> bytes:
                got = z.decompress(z.unconsumed_tail, HEAD)
                if not got:
                    raise ValueError(f"the record at {begin} is cut off")
                return got

            head = z.decompress(raw, HEAD)
            while (at := head.find(b"\r\n\r\n")) < 0:
                head += more()
            h = parsed(head[:at])
            row = header_row(h)
            if self.wanted(row):
                rest = head[at + 4 :]
                need = int(h["content-length"])
                if row["record_type"] != "revisit" and self.payload:
                    rest += z.decompress(z.unconsumed_tail)
                else:
                    while b"\r\n\r\n" not in rest and len(rest) < need:
                        rest += more()
                yield self.finished(row, h, rest[:need])

    def streamed(self, f, zipped: bool) -> Iterator[dict]:
        """Records of a file without index, in order; what is not wanted is passed over a chunk at a time."""
        source = Stream(f, zipped)
        while (head := source.until(b"\r\n\r\n")) is not None:
            h = parsed(head)
            row = header_row(h)
            need = int(h.get("content-length", 0))
            if self.wanted(row):
                yield self.finished(row, h, source.take(need))
            else:
                source.skip(need)

    def finished(self, row: dict, h: dict, block: bytes) -> dict:
        size, payload = None, None
        if h.get("content-type", "").startswith("application/http"):
            http, _, body = block.partition(b"\r\n\r\n")
            size = int(parsed(http).get("content-length", len(body)))
            payload = body if row["record_type"] != "revisit" and self.payload else None
        elif self.payload:
            size, payload = len(block), block
        return row | {"payload_bytes": size, "payload": payload}


class Stream:
    """A plain or gzipped file, a bounded chunk at a time."""

    def __init__(self, f, zipped: bool):
        self.f, self.buffer = f, b""
        self.z = zlib.decompressobj(31) if zipped else None
        self.raw = b""

    def more(self) -> bool:
        if self.z is None:
            new = self.f.read(CHUNK)
            self.buffer += new
            return bool(new)
        while True:
            if not self.raw:
                self.raw = self.f.read(CHUNK)
                if not self.raw:
                    return False
            new = self.z.decompress(self.raw, CHUNK)
            self.raw = self.z.unconsumed_tail or self.z.unused_data
            if self.z.eof:
                self.z = zlib.decompressobj(31)
            if new:
                self.buffer += new
                return True

    def until(self, mark: bytes) -> bytes | None:
        while True:
            self.buffer = self.buffer.lstrip(b"\r\n") if self.buffer[:1] in (b"\r", b"\n") else self.buffer
            at = self.buffer.find(mark)
            if at >= 0:
                out, self.buffer = self.buffer[:at], self.buffer[at + len(mark) :]
                return out
            if not self.more():
                return None

    def take(self, n: int) -> bytes:
        while len(self.buffer) < n and self.more():
            pass
        out, self.buffer = self.buffer[:n], self.buffer[n:]
        return out

    def skip(self, n: int) -> None:
        while n > len(self.buffer):
            n -= len(self.buffer)
            self.buffer = b""
            if not self.more():
                return
        self.buffer = self.buffer[n:]


class Written(WriterCommitMessage):
    def __init__(self, name: str | None, rows: int):
        self.name, self.rows = name, rows


class Writer(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.date = options.get("date", "2024-01-01T00:00:00Z")
        self.level = int(options.get("level", 1))

    def write(self, iterator):
        fs, root = opened(self.path)
        name, out, at = f"part-{uuid.uuid4().hex}.warc.gz", None, [0]
        for batch in iterator:
            for r in batch.to_pylist():
                if out is None:
                    fs.create_dir(root, recursive=True)
                    out = fs.open_output_stream(posixpath.join(root, name), compression=None)
                z = zlib.compressobj(self.level, zlib.DEFLATED, 31)
                data = z.compress(record(r["page_id"], r["url"], self.date, r["payload_digest"], r["payload"] or b"", r["refers_to"])) + z.flush()
                out.write(data)
                at.append(at[-1] + len(data))
        if out is None:
            return Written(None, 0)
        out.close()
        with fs.open_output_stream(posixpath.join(root, name + ".idx")) as f:
            f.write(np.array(at, "<i8").tobytes())
        return Written(name, len(at) - 1)

    def commit(self, messages):
        fs, root = opened(self.path)
        fs.create_dir(root, recursive=True)
        manifest, names = posixpath.join(root, MANIFEST), []
        if fs.get_file_info(manifest).type == pafs.FileType.File:
            with fs.open_input_stream(manifest) as f:
                names = json.loads(f.read())["files"]
        names += [m.name for m in messages if m is not None and m.name]
        new = f"{manifest}.{uuid.uuid4().hex}"
        with fs.open_output_stream(new) as f:
            f.write(json.dumps({"files": names}).encode())
        fs.move(new, manifest)

    def abort(self, messages):
        fs, root = opened(self.path)
        for m in messages:
            if m is not None and m.name:
                for name in (m.name, m.name + ".idx"):
                    fs.delete_file(posixpath.join(root, name))


class WarcSource(DataSource):
    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return Reader(dict(self.options))

    def writer(self, schema, overwrite):
        return Writer(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def archived(pages: DataFrame, least: int = REVISIT_FROM) -> DataFrame:
    """Rows for the writer: payload, digest and, for all but the smallest page_id of equal payloads of ``least`` bytes, refers_to."""
    payload: Column = F.coalesce(F.encode("html", "UTF-8"), F.lit(b""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload")).withColumn("payload_digest", F.sha2("payload", 256))
    first = rows.where((F.octet_length("payload") >= least) & F.col("page_id").isNotNull()).groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last")).where("first < last").drop("last")
    first = common.Scratch(pages.sparkSession, "warc-first").save(first, "first")
    return rows.join(common.small(first), "payload_digest", "left").select("page_id", F.when(F.col("first") < F.col("page_id"), "revisit").otherwise("response").alias("record_type"), "url", F.when(F.col("first") < F.col("page_id"), F.col("first")).alias("refers_to"), "payload_digest", F.octet_length("payload").cast("long").alias("payload_bytes"), "payload")


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    register(spark)
    common.small_batches(spark)
    folder = f"{common.Scratch(spark, 'warc').base}/archive"
    archived(spark.read.parquet(f"{sf_dir}/pages.parquet")).write.format("warc").mode("append").save(folder)
    back = spark.read.format("warc").load(folder)
    stored = F.col("record_type") == "response"
    # The digest and size of a response are taken from what was read back, those of a revisit from its headers.
    return back.select("page_id", F.when(stored, F.octet_length("payload").cast("long")).otherwise(F.col("payload_bytes")).alias("payload_bytes"), F.when(stored, F.sha2("payload", 256)).otherwise(F.col("payload_digest")).alias("payload_digest"), "record_type", "refers_to")


OP10_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS payload, sha256(coalesce(html, '')) AS digest FROM pages),
f AS (SELECT digest, min(page_id) AS first FROM p WHERE strlen(payload) >= 100 GROUP BY digest)
SELECT page_id, CAST(strlen(payload) AS BIGINT) AS payload_bytes, p.digest AS payload_digest,
       CASE WHEN first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first < page_id THEN first END AS refers_to
FROM p LEFT JOIN f ON p.digest = f.digest
"""
