"""WARC archives as a Python data source, for reading and writing.

Writing: each task writes archives of one gzip member a record, and notes where records begin, in its commit message; each commit writes
a manifest of its own with the files of successful attempts, so that what a lost executor left behind is never read, and appending keeps what is there. Payloads that
the table says are revisits are not written again.

Reading: partitions are runs of whole records, planned from the manifests (without any, each file is a partition).
Predicates on record_type, record_id, target_uri, payload_digest and refers_to are pushed down: a record's headers are
parsed first, and only if they match (and payloads are wanted) is its payload decoded, and checked against its digest.
They are given to ``read``, or as options, as values in a JSON list. With the option pushdown (and
spark.sql.python.filterPushdown.enabled) Spark hands over a query's own filters, too; but a DataFrame of Spark 4.1 keeps those of its
last query if the next one has none, so that each query must then load the source anew. ``read`` does without that.

Options: path (a URI that all executors reach; ``read`` and ``archived`` resolve one without a scheme in Spark's default file system), payload (true: decode payloads), the columns above, date
(of written records), split_bytes (archive bytes of a partition).

``pages``: null html counts as empty. Of records with equal payloads, those with the smallest page_id are responses
and the others revisit it; so equal rows of that page_id are all responses, as are rows if all page_ids of a payload are null.
A null page_id is larger than any other. Very long payloads are one record. An empty table gives an archive without records. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, WriterCommitMessage
from pyspark.sql.types import StructType

from palisade.llm.common import findable, stored, workspace

#: What the source reads. A revisit has no payload; payload_bytes and payload_digest are those of the full one.
READ = "record_id string, record_type string, target_uri string, payload_bytes bigint, payload_digest string, refers_to string, payload binary"
#: What it writes; digest is the payload's SHA-1 in hexadecimal.
WRITTEN = "record_id string, record_type string, target_uri string, payload binary, digest string, refers_to string"
#: Archive bytes of a file, and those between two noted places.
FILE_BYTES, SPLIT_BYTES = 256 << 20, 16 << 20
BATCH_BYTES = 8 << 20
MANIFEST = "_manifest"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def place(path: str) -> tuple[fs.FileSystem, str]:
    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri("file://" + path[5:] if path.startswith("file:/") and not path.startswith("file://") else path)


def base32(hex_digest: str) -> str:
    return base64.b32encode(bytes.fromhex(hex_digest)).decode()


def packed(record_id: str, record_type: str, uri: str | None, payload: bytes, digest: str, refers_to: str | None, date: str) -> bytes:
    """A record. Of a revisit the payload is left out; its HTTP headers still tell the payload's size."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if record_type == "revisit" else http + payload
    head = ["WARC/1.1", f"WARC-Type: {record_type}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {date}"]
    head += [f"WARC-Target-URI: {' '.join(uri.split())}"] if uri else []
    head += [f"WARC-Payload-Digest: sha1:{base32(digest)}"]
    head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{refers_to}>"] if record_type == "revisit" else []
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def headers(raw: bytes) -> dict[str, str]:
    """Header lines, names in lower case."""
    found = (line.partition(":") for line in raw.decode("utf-8", "replace").split("\r\n")[1:])
    return {k.strip().lower(): v.strip() for k, colon, v in found if colon}


class Member:
    """One gzip member at a time of an archive: its bytes are inflated only as far as they are asked for."""

    STEP = 1 << 18

    def __init__(self, file: pa.NativeFile, end: int) -> None:
        self.file, self.left, self.data = file, end - file.tell(), b""

    def _read(self) -> None:
        if not self.data:
            self.data = self.file.read(min(self.STEP, self.left))
            self.left -= len(self.data)

    def __iter__(self) -> Iterator[Member]:
        while True:
            self._read()
            if not self.data:
                return
            self.z, self.out = zlib.decompressobj(31), b""
            yield self
            while self.more():
                self.out = b""  # not wanted
            self.data = self.z.unused_data

    def more(self) -> bool:
        if self.z.eof:
            return False
        self._read()
        if not self.data:
            raise ValueError("an archive ends within a record")
        self.out += self.z.decompress(self.data, self.STEP)
        self.data = self.z.unconsumed_tail
        return True

    def until(self, mark: bytes) -> bytes:
        """The bytes before a mark; both are taken off."""
        while mark not in self.out:
            if not self.more():
                raise ValueError("a record ends within its headers")
        head, _, self.out = self.out.partition(mark)
        return head

    def take(self, n: int) -> bytes:
        parts, have = [self.out], len(self.out)
        while have < n:
            self.out = b""
            if not self.more():
                raise ValueError("a record is shorter than it says")
            parts.append(self.out)
            have += len(self.out)
        whole = b"".join(parts)
        self.out = whole[n:]
        return whole[:n]


def bare(identifier: str | None) -> str | None:
    return identifier.strip("<>") if identifier else None


class Run(InputPartition):
    """Whole records of one archive: from a byte to another."""

    def __init__(self, path: str, begin: int, end: int) -> None:
        self.path, self.begin, self.end = path, begin, end


PUSHED = ("record_type", "record_id", "target_uri", "payload_digest", "refers_to")


class WarcReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path = options["path"].rstrip("/")
        self.payload = str(options.get("payload", "true")).lower() != "false"
        self.split = int(options.get("split_bytes", SPLIT_BYTES))
        self.wanted: dict[str, set[str]] = {k: set(json.loads(options[k])) for k in PUSHED if k in options}

    def partitions(self) -> list[InputPartition]:
        store, path = place(self.path)
        found = store.get_file_info(fs.FileSelector(path)) if store.get_file_info(path).type == fs.FileType.Directory else [store.get_file_info(path)]
        found = sorted(found, key=lambda f: f.path)
        manifests = [f.path for f in found if f.base_name.startswith(MANIFEST)]
        if not manifests:
            return [Run(f.path, 0, f.size) for f in found if f.path.endswith(".warc.gz")]
        files = []
        for manifest in manifests:
            with store.open_input_stream(manifest) as f:
                files += json.loads(f.read())
        out: list[InputPartition] = []
        for x in files:
            cuts = [0]
            for begin in x["begins"]:
                if begin - cuts[-1] >= self.split:
                    cuts.append(begin)
            out += [Run(f"{path}/{x['name']}", a, b) for a, b in zip(cuts, [*cuts[1:], x["size"]], strict=True)]
        return out

    def read(self, partition: Run | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no archive has a record
            return
        store, _ = place(self.path)
        kinds = pa.schema([(n, pa.int64() if n == "payload_bytes" else pa.binary() if n == "payload" else pa.string()) for n in (c.split()[0] for c in READ.split(", "))])
        rows: list[tuple] = []
        size = 0
        with store.open_input_file(partition.path) as file:
            file.seek(partition.begin)
            for member in Member(file, partition.end):
                row = self.row(member)
                if row is None:
                    continue
                rows.append(row)
                size += 200 + len(row[-1] or b"")
                if size >= BATCH_BYTES:
                    yield self.batch(rows, kinds)
                    rows, size = [], 0
        if rows:
            yield self.batch(rows, kinds)

    @staticmethod
    def batch(rows: list[tuple], kinds: pa.Schema) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(column, kind.type) for column, kind in zip(zip(*rows, strict=True), kinds, strict=True)], schema=kinds)

    def row(self, member: Member) -> tuple | None:
        """A record's row, or None if its headers don't match; then its payload isn't decoded."""
        head = headers(member.until(b"\r\n\r\n"))
        digest = head.get("warc-payload-digest", "").removeprefix("sha1:") or None
        values = {"record_id": bare(head.get("warc-record-id")), "record_type": head.get("warc-type"), "target_uri": head.get("warc-target-uri"), "payload_digest": digest, "refers_to": bare(head.get("warc-refers-to"))}
        if any(values[k] not in v for k, v in self.wanted.items()):
            return None
        length, payload = int(head["content-length"]), None
        is_http = head.get("content-type", "").startswith("application/http")
        block_head = member.until(b"\r\n\r\n") if is_http and length else b""
        n = length - len(block_head) - (4 if block_head else 0)
        if values["record_type"] == "revisit":
            told = headers(block_head).get("content-length")
            n = int(told) if told is not None else None
        elif self.payload:
            payload = member.take(n)
            if digest and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                raise ValueError(f"the payload of {values['record_id']} doesn't have its digest")
        return values["record_id"], values["record_type"], values["target_uri"], n, digest, values["refers_to"], payload


class PushingReader(WarcReader):
    """Takes a query's own filters, too."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            name = getattr(f, "attribute", ("",))[0]
            if isinstance(f, EqualTo | In) and name in PUSHED:
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.wanted[name] = self.wanted.get(name, values) & values
            elif not (isinstance(f, IsNotNull) and name in ("record_type", "record_id")):
                yield f


@dataclass
class Written(WriterCommitMessage):
    files: list[dict] = field(default_factory=list)


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict) -> None:
        self.path = options["path"].rstrip("/")
        self.date = options.get("date", "1970-01-01T00:00:00Z")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, path = place(self.path)
        store.create_dir(path, recursive=True)
        out, files = None, []
        for batch in iterator:
            for x in batch.to_pylist():
                if out is None or files[-1]["size"] >= FILE_BYTES:
                    if out is not None:
                        out.close()
                    files.append({"name": f"{uuid.uuid4().hex}.warc.gz", "size": 0, "begins": [0]})
                    out = store.open_output_stream(f"{path}/{files[-1]['name']}", compression=None)
                member = gzip.compress(packed(x["record_id"], x["record_type"], x["target_uri"], x["payload"] or b"", x["digest"], x["refers_to"], self.date), 1, mtime=0)
                if files[-1]["size"] - files[-1]["begins"][-1] >= SPLIT_BYTES:
                    files[-1]["begins"].append(files[-1]["size"])
                out.write(member)
                files[-1]["size"] += len(member)
        if out is not None:
            out.close()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        store, path = place(self.path)
        store.create_dir(path, recursive=True)
        with store.open_output_stream(f"{path}/{MANIFEST}-{uuid.uuid4().hex}.json") as f:
            f.write(json.dumps([x for m in messages if m is not None for x in m.files]).encode())

    def abort(self, messages: list[Written | None]) -> None:
        store, path = place(self.path)
        for m in messages:
            for x in m.files if m is not None else []:
                store.delete_file(f"{path}/{x['name']}")


class Warc(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return READ

    def reader(self, schema: StructType) -> WarcReader:
        return (PushingReader if str(self.options.get("pushdown", "false")).lower() == "true" else WarcReader)(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options)


def register(spark: SparkSession) -> None:
    findable(spark)
    spark.dataSource.register(Warc)


def qualified(spark: SparkSession, path: str) -> str:
    """The URI of a path, as Spark would resolve it."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(where).toString()


def read(spark: SparkSession, path: str, payload: bool = True, split_bytes: int = SPLIT_BYTES, **wanted: list[str]) -> DataFrame:
    """The records of archives whose columns have one of the values wanted, such as record_type=["revisit"]."""
    if unknown := set(wanted) - set(PUSHED):
        raise ValueError(f"no predicate on {sorted(unknown)} can be pushed down")
    register(spark)
    options = {"path": qualified(spark, path), "payload": str(payload).lower(), "split_bytes": str(split_bytes)}
    return spark.read.format("warc").options(**options, **{k: json.dumps(list(v)) for k, v in wanted.items()}).load()


def records(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """The rows to write (WRITTEN): a payload of at least so many bytes that other pages have too is written once."""
    payload = F.encode(F.coalesce(F.col("html"), F.lit("")), "utf-8")
    rows = pages.select("page_id", "url", payload.alias("payload"), F.sha1(payload).alias("digest"))
    large = F.octet_length("payload") >= least_bytes
    shared = rows.filter(large).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1").select(F.col("digest").alias("d"), "first")
    firsts = stored(shared, "digests")  # its measured size decides how it is joined
    told = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    urn = lambda c: F.concat(F.lit("urn:x-page:"), F.coalesce(c.cast("string"), F.lit("none")))
    return rows.join(firsts, F.col("digest") == F.col("d"), "left").select(
        urn(F.col("page_id")).alias("record_id"),
        F.when(told, F.lit("revisit")).otherwise(F.lit("response")).alias("record_type"),
        F.col("url").alias("target_uri"),
        "payload",
        "digest",
        F.when(told, urn(F.col("first"))).alias("refers_to"),
    )


def write(pages: DataFrame, path: str, least_bytes: int = 0) -> None:
    """Append ``pages`` to the archives below ``path``."""
    spark = pages.sparkSession
    register(spark)
    with workspace(spark):
        records(pages, least_bytes).write.format("warc").mode("append").option("path", qualified(spark, path)).save()


def archived(pages: DataFrame, path: str, least_bytes: int = 0) -> DataFrame:
    """Write ``pages`` to archives below ``path``, and read those."""
    write(pages, path, least_bytes)
    return read(pages.sparkSession, path)


def page_of(record: str) -> Column:
    return F.expr(f"try_cast(substring_index({record}, ':', -1) AS BIGINT)")
