"""WARC archives as a PySpark Python data source, for writing and reading.

``spark.read.format("pagewright_warc").load(folder)`` plans one partition per archive file, takes over predicates on
record type and header columns, reads the headers of a record first and inflates past payloads that no row needs
without decoding or hashing them. ``df.write.format("pagewright_warc").mode("append").save(folder)`` writes
gzip-per-record ``.warc.gz`` files that are rolled at a size. Paths are resolved by ``pyarrow.fs``, so any store that
it knows (local, hdfs://, s3://, gs://) works. Revisit records hold the HTTP headers of the capture and no payload.
An archive that ends within a record, or whose record has no sound length, raises an error that names the file.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, In, InputPartition, IsNotNull, StringStartsWith, WriterCommitMessage
from pyspark.sql.types import StructType

from .common import scratch_path

FORMAT = "pagewright_warc"
SCHEMA = """record_id string, record_type string, uri string, date string, refers_to string, declared_digest string,
 declared_bytes long, payload_digest string, payload_bytes long, payload binary"""
#: Header columns that a predicate can be taken over for, by the WARC header that holds them.
HEADERS = {"record_id": "WARC-Record-ID", "record_type": "WARC-Type", "uri": "WARC-Target-URI", "date": "WARC-Date", "refers_to": "WARC-Refers-To", "declared_digest": "WARC-Payload-Digest"}
ROLL_BYTES = 64 << 20
BATCH_BYTES = 4 << 20
READ_BYTES = 1 << 18
DIGEST = "sha256:"
MIN_REVISIT_BYTES = 100
SALTS = 64


def store_of(path: str) -> tuple[pafs.FileSystem, str]:
    if "://" not in path and not path.startswith("file:"):
        return pafs.LocalFileSystem(), path
    return pafs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path)


def _record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    clean = "".join(f"{k}: {' '.join(v.split())}\r\n" for k, v in headers if v is not None)
    return b"WARC/1.1\r\n" + clean.encode() + f"Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def encode_record(record_type: str, record_id: str, uri: str | None, date: str, payload: bytes | None, payload_bytes: int, digest: str, refers_to: str | None) -> bytes:
    """One record as a gzip member. Response: HTTP headers and payload. Revisit: HTTP headers alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {payload_bytes}\r\n\r\n".encode()
    headers = [("WARC-Type", record_type), ("WARC-Record-ID", f"<{record_id}>"), ("WARC-Date", date), ("WARC-Target-URI", uri), ("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", DIGEST + digest)]
    if record_type == "revisit":
        headers += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<{refers_to}>")]
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress(_record(headers, http + (payload or b"" if record_type != "revisit" else b""))) + packer.flush()


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class WarcWriter(DataSourceWriter):
    """Rows: record_id, record_type, uri, date, payload, payload_bytes, payload_digest, refers_to (by name)."""

    def __init__(self, path: str, roll: int):
        self.path, self.roll = path, roll

    def write(self, rows: Iterator) -> Written:
        fs, root = store_of(self.path)
        fs.create_dir(root, recursive=True)
        files: list[str] = []
        try:
            self._write(fs, root, files, rows)
        except BaseException:  # a task that fails leaves nothing behind
            for f in files:
                if fs.get_file_info(f + ".part").is_file:
                    fs.delete_file(f + ".part")
            raise
        return Written(files)

    def _write(self, fs: pafs.FileSystem, root: str, files: list[str], rows: Iterator) -> None:
        out, size = None, 0
        for row in rows:
            if out is None:
                files.append(f"{root}/{uuid.uuid4().hex}.warc.gz")
                out, size = fs.open_output_stream(files[-1] + ".part", compression=None), 0
                packer = zlib.compressobj(1, zlib.DEFLATED, 31)
                out.write(packer.compress(_record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", row["date"]), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")) + packer.flush())
            member = encode_record(row["record_type"], row["record_id"], row["uri"], row["date"], row["payload"], row["payload_bytes"], row["payload_digest"], row["refers_to"])
            out.write(member)
            size += len(member)
            if size >= self.roll:
                out.close()
                out = None
        if out is not None:
            out.close()

    def commit(self, messages: list) -> None:
        """Only the files of attempts that count get their final names, which is what the reader lists."""
        fs, _ = store_of(self.path)
        for message in messages:
            for f in message.files if message else []:
                fs.move(f + ".part", f)

    def abort(self, messages: list) -> None:
        fs, _ = store_of(self.path)
        for message in messages:
            for f in message.files if message else []:
                fs.delete_file(f + ".part")


@dataclass
class WarcFile(InputPartition):
    path: str


class _Members:
    """Bytes of consecutive gzip members (or of a plain file), read forward only."""

    def __init__(self, stream, packed: bool):
        self.stream, self.packed = stream, packed
        self.buffer, self.raw, self.inflater, self.short = b"", b"", None, False

    def _fill(self) -> bool:
        while True:
            if not self.raw:
                self.raw = self.stream.read(READ_BYTES)
                if not self.raw:
                    return False
            if not self.packed:
                self.buffer, self.raw = self.buffer + self.raw, b""
                return True
            if self.inflater is None:
                self.inflater = zlib.decompressobj(31)
            got = self.inflater.decompress(self.raw, READ_BYTES)
            self.raw = self.inflater.unconsumed_tail or self.inflater.unused_data
            if self.inflater.eof:
                self.inflater = None
            if got:
                self.buffer += got
                return True

    def head(self) -> bytes | None:
        """The next header block, without its blank line; None at the end."""
        while True:
            self.buffer = self.buffer.lstrip(b"\r\n") if self.buffer[:1] in (b"\r", b"\n") else self.buffer
            if (end := self.buffer.find(b"\r\n\r\n")) >= 0:
                block, self.buffer = self.buffer[:end], self.buffer[end + 4 :]
                return block
            if not self._fill():
                return None

    def take(self, n: int) -> bytes:
        parts, have = [self.buffer], len(self.buffer)
        while have < n:
            self.buffer = b""
            if not self._fill():
                break
            parts.append(self.buffer)
            have += len(self.buffer)
        whole = b"".join(parts)
        self.buffer, self.short = whole[n:], len(whole) < n
        return whole[:n]

    def skip(self, n: int) -> None:
        while len(self.buffer) < n:
            n -= len(self.buffer)
            self.buffer = b""
            if not self._fill():
                self.short = True
                return
        self.buffer = self.buffer[n:]


def _whole(source: _Members, path: str, head: dict[str, str]) -> None:
    if source.short:
        raise ValueError(f"{path}: the archive ends within record {head.get('warc-record-id')}")


def _headers(block: bytes) -> dict[str, str]:
    found = {}
    for line in block.decode("utf-8", "replace").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        found[name.strip().lower()] = value.strip()
    return found


class WarcReader(DataSourceReader):
    def __init__(self, path: str, payload: bool):
        self.path, self.payload, self.tests = path, payload, []

    def pushFilters(self, filters: list) -> Iterator:
        """Takes over equality, IN, prefix and not-null tests on header columns; hands back the others."""
        for f in filters:
            column = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            if column in HEADERS and isinstance(f, EqualTo | In | StringStartsWith | IsNotNull):
                self.tests.append((column, type(f).__name__, getattr(f, "value", None)))
            else:
                yield f

    def partitions(self) -> list[WarcFile]:
        fs, root = store_of(self.path)
        found = fs.get_file_info(pafs.FileSelector(root, recursive=True, allow_not_found=True))
        return [WarcFile(x.path) for x in sorted(found, key=lambda x: x.path) if x.is_file and x.path.endswith((".warc", ".warc.gz"))]

    def _wanted(self, row: dict) -> bool:
        for column, kind, value in self.tests:
            have = row[column]
            if have is None or (kind == "EqualTo" and have != value) or (kind == "In" and have not in value) or (kind == "StringStartsWith" and not have.startswith(value)):
                return False
        return True

    def read(self, partition: WarcFile) -> Iterator[pa.RecordBatch]:
        if partition is None or getattr(partition, "path", None) is None:
            return
        fs, _ = store_of(self.path)
        fields = [x.split()[0] for x in SCHEMA.replace("\n", "").split(",")]
        kinds = [pa.int64() if f.endswith("_bytes") else pa.binary() if f == "payload" else pa.string() for f in fields]
        schema = pa.schema(list(zip(fields, kinds, strict=True)))
        with fs.open_input_stream(partition.path, compression=None) as stream:
            source, rows, size = _Members(stream, partition.path.endswith(".gz")), [], 0
            while (block := source.head()) is not None:
                head = _headers(block)
                sent = head.get("content-length", "0")
                if not (sent.isascii() and sent.isdigit()):
                    raise ValueError(f"{partition.path}: malformed Content-Length {sent!r} of record {head.get('warc-record-id')}")
                length = int(sent)
                row = dict.fromkeys(fields) | {c: head.get(h.lower()) for c, h in HEADERS.items()}
                for c in ("record_id", "refers_to"):
                    row[c] = row[c].strip("<>") if row[c] else None
                row["declared_digest"] = row["declared_digest"].removeprefix(DIGEST) if row["declared_digest"] else None
                if not self._wanted(row):
                    source.skip(length)
                    _whole(source, partition.path, head)
                    continue
                if head.get("content-type", "").startswith("application/http"):
                    body = source.take(length)
                    http, _, payload = body.partition(b"\r\n\r\n")
                    sent = _headers(http).get("content-length")
                    row["declared_bytes"] = int(sent) if sent and sent.isdigit() else None
                else:
                    payload = source.take(length)
                _whole(source, partition.path, head)
                if row["record_type"] != "revisit":
                    row["payload_bytes"], row["payload_digest"] = len(payload), hashlib.sha256(payload).hexdigest()
                    row["payload"] = payload if self.payload else None
                rows.append(row)
                size += 400 + (len(payload) if self.payload else 0)
                if size >= BATCH_BYTES:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema)


class WarcSource(DataSource):
    """Options: path; payload ('false': payloads are checked but not returned); rollBytes (size of a written file)."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(self.options["path"], self.options.get("payload", "true").lower() != "false")

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"], int(self.options.get("rollbytes", ROLL_BYTES)))


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def plan_records(pages: DataFrame) -> DataFrame:
    """The records to write for pages: one per row, a revisit where an equal payload of at least 100 bytes has a
    smaller page_id. Null html is an empty payload. Rows without page_id are responses unless an equal payload has
    one; rows that repeat the smallest page_id are all responses. Hot payloads meet their group's id salted."""
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(
        F.col("page_id").alias("page_id"), F.col("url").alias("uri"), body.alias("payload"), F.length(body).cast("long").alias("payload_bytes"),
        F.sha2(body, 256).alias("payload_digest"), F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int").alias("salt"),
    )
    groups = rows.filter(F.col("payload_bytes") >= MIN_REVISIT_BYTES).groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    groups = groups.select("payload_digest", "first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    found = rows.join(groups, ["payload_digest", "salt"], "left")
    revisit = F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("page_id"))
    name = lambda c: F.concat(F.lit("urn:page:"), F.coalesce(c.cast("string"), F.lit("null")))
    return found.select(
        name(F.col("page_id")).alias("record_id"), F.when(revisit, "revisit").otherwise("response").alias("record_type"), "uri",
        F.lit("2024-01-01T00:00:00Z").alias("date"), F.when(~revisit, F.col("payload")).alias("payload"), "payload_bytes", "payload_digest",
        F.when(revisit, name(F.col("first"))).alias("refers_to"),
    )


def archive_pages(pages: DataFrame, path: str) -> None:
    """Writes one WARC record per page under ``path``."""
    register(pages.sparkSession)
    plan_records(pages).write.format(FORMAT).mode("append").save(path)


def read_archive(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    register(spark)
    return spark.read.format(FORMAT).option("payload", str(payload).lower()).load(path)


def roundtrip(pages: DataFrame) -> DataFrame:
    """Archives all pages in the shared folder and reads the archives back; one row per page. An empty table gives no
    rows. Sizes and digests of responses are those of the payloads read; revisits give what their headers state."""
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    archive_pages(pages, path)
    back = read_archive(spark, path, payload=False).filter(F.col("record_type").isin("response", "revisit"))
    page = lambda c: F.regexp_extract(c, r"^urn:page:(-?\d+)$", 1)
    number = lambda c: F.when(page(F.col(c)) != "", page(F.col(c)).cast("long"))
    return back.select(
        number("record_id").alias("page_id"), F.coalesce("payload_bytes", "declared_bytes").alias("payload_bytes"),
        F.coalesce("payload_digest", "declared_digest").alias("payload_digest"), "record_type", number("refers_to").alias("refers_to"), "uri",
    )


ORACLE = """
WITH p AS (SELECT page_id, url, coalesce(html, '') AS body FROM pages),
q AS (SELECT page_id, url, strlen(body) AS payload_bytes, sha256(body) AS payload_digest, min(page_id) OVER (PARTITION BY body) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND first <> page_id THEN first END AS refers_to, url AS uri
FROM q
"""
