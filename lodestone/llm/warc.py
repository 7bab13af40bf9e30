"""WARC archives written and read by Spark as a table of chunks.

Chunk table: the JVM cuts a payload into rows (record, chunk number, payload) of
at most ``chunk_bytes`` before anything else happens to it, so that no Python
worker, shuffle or sort ever holds a whole payload. The rows of a record stream
through one SHA-1; its last row carries the digest and size of the whole.

Types: of the last rows alone (without payloads), equal payloads of at least
``min_bytes`` bytes meet by digest: the one with the largest key is a response,
the others are revisits of it. Of the digests only those with two records or
more come to the join, which Spark can split when a digest is hot.

Writing: a row with the header of each record is put before its chunk rows, and
both are sorted by (record, chunk number). A payload becomes one record or,
beyond ``chunk_bytes``, a first segment and ``continuation`` records (WARC 1.1
segmentation). Spark's text writer stores them; the two line ends that close a
WARC record are its line separator. Each file is one gzip stream, named
``.warc.gz``, and is read by one task, in order.

Reading: the lines of the files stream through a parser that holds one line and
the running digest of the open record, never a whole record. It gives back
(record, chunk number) rows; the last chunk of a record carries the digest and
size of its whole payload, measured while reading (a revisit has them from its
header, as it has no payload).

Defined results: a null payload is empty. A null key is written as an empty
part of the record id; it is nobody's referent, and it revisits a keyed record
with equal payload, if there is one. Repeated rows (key and payload alike) are
each written, with the same type and an id each. Line ends in URLs are
percent-encoded; a null URL stands as ``urn:lodestone:no-url`` and is read as
null. An empty table gives an archive without records; extra columns are left
out.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import CLEANUP_KEY, materialize, new_path, release, small_batches

CHUNK_BYTES = 1 << 20
COARSE = 32  # chunks in a piece of the first of two cuts: a cut copies what it cuts once for each of its parts
MIN_BYTES = 0
END = b"\r\n\r\n"
NO_URL = "urn:lodestone:no-url"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CHUNK_SCHEMA = (
    "page_id long, chunk int, last boolean, payload binary, url string, record_type string, refers_to long, "
    "payload_bytes long, payload_digest string"
)
TABLE = "record long, page_id long, url string, chunk int, last boolean, payload binary, size long, digest string"


def cut(rows: DataFrame, size: int) -> DataFrame:
    """Rows whose payload is longer than ``size`` as several, in order; ``last`` stays with the last of them."""
    starts = F.sequence(F.lit(1), F.greatest(F.octet_length("payload"), F.lit(1)), F.lit(size))
    parts = F.transform(starts, lambda at: F.call_function("substring", F.col("payload"), at, F.lit(size)))
    kept = [c for c in rows.columns if c not in ("payload", "last")]
    each = rows.withColumn("_n", F.size(starts)).select(*kept, "last", "_n", F.posexplode(parts).alias("_at", "payload"))
    return each.select(*kept, "payload", (F.col("last") & (F.col("_at") == F.col("_n") - 1)).alias("last"))


def chunk_table(df: DataFrame, chunk_bytes: int = CHUNK_BYTES, key: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """The chunk rows of all payloads, written to the shared folder: record numbers are given once."""
    small_batches(df.sparkSession)
    body = F.coalesce(F.col(payload).cast("string").cast("binary"), F.lit(b""))
    rows = df.select(
        F.monotonically_increasing_id().alias("record"), F.col(key).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"),
        body.alias("payload"), F.lit(True).alias("last"),
    )
    rows = cut(cut(rows, COARSE * chunk_bytes), chunk_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        running, chunk, size = hashlib.sha1(), 0, 0
        for batch in batches:
            chunks, sizes, digests = [], [], []
            payloads = batch.column("payload")
            for i, last in enumerate(batch.column("last").to_pylist()):
                part = memoryview(payloads[i].as_buffer() or b"")
                running.update(part)
                chunk, size = chunk + 1, size + len(part)
                chunks.append(chunk)
                sizes.append(size if last else None)
                digests.append(base64.b32encode(running.digest()).decode() if last else None)
                if last:
                    running, chunk, size = hashlib.sha1(), 0, 0
            columns = [batch.column("record"), batch.column("page_id"), batch.column("url"), pa.array(chunks, pa.int32()), batch.column("last"), payloads]
            yield pa.record_batch([*columns, pa.array(sizes, pa.int64()), pa.array(digests, pa.string())], TABLE_NAMES)

    return materialize(rows.mapInArrow(run, TABLE), "chunks", compression="zstd")


TABLE_NAMES = [f.split()[0] for f in TABLE.split(", ")]


def typed(chunks: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """A row per record without payload: page_id, url, size, digest, n_chunks, record_type, refers_to, refers_record."""
    heads = chunks.where("last").select("record", "page_id", "url", F.col("chunk").alias("n_chunks"), "size", "digest")
    able = heads.where((F.col("size") >= min_bytes) & F.col("page_id").isNotNull())
    # a null key may be the other of two equal payloads, so it counts as a copy
    copies = heads.where(F.col("size") >= min_bytes).groupBy("digest").agg(F.count("*").alias("copies"))
    keepers = able.groupBy("digest").agg(F.max("page_id").alias("keeper"), F.max_by("record", "page_id").alias("keeper_record"))
    # written out, so that the join has an exchange on either side and a hot digest can be split
    keepers = materialize(keepers.join(copies.where("copies > 1"), "digest").drop("copies"), "keepers")
    other = (F.col("size") >= min_bytes) & F.col("keeper").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") != F.col("keeper")))
    return heads.join(keepers, "digest", "left").select(
        *heads.columns,
        F.when(other, "revisit").otherwise("response").alias("record_type"),
        F.when(other, F.col("keeper")).alias("refers_to"), F.when(other, F.col("keeper_record")).alias("refers_record"),
    )


def record_id(key: int | None, record: int, segment: int = 1) -> str:
    return f"<urn:lodestone:record:{record}{f'.{segment}' if segment > 1 else ''}:{'' if key is None else key}>"


def http_head(size: int) -> bytes:
    return b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size


def record_of(head: dict, segment: int, payload: memoryview, date: str) -> bytes:
    """One WARC record without its closing line ends: a revisit, a response or a segment of one."""
    kind, key, record, n, size = (head[c] for c in ("record_type", "page_id", "record", "n_chunks", "size"))
    block = http_head(size) if segment == 1 and kind == "response" else b""
    uri = NO_URL if head["url"] is None else re.sub(r"[\r\n]", lambda m: f"%{ord(m[0]):02X}", head["url"])
    lines = [
        "WARC/1.1",
        f"WARC-Type: {kind if segment == 1 else 'continuation'}",
        f"WARC-Record-ID: {record_id(key, record, segment)}",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {uri}",
        f"Content-Length: {len(block) + len(payload)}",
    ]
    if segment == 1:
        lines += [f"WARC-Payload-Digest: sha1:{head['digest']}", f"X-Payload-Length: {size}", "Content-Type: application/http; msgtype=response"]
    else:
        lines.append(f"WARC-Segment-Origin-ID: {record_id(key, record)}")
    if kind == "revisit":
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(head['refers_to'], head['refers_record'])}"]
    elif n > 1:
        lines.append(f"WARC-Segment-Number: {segment}")
        if segment == n:
            lines.append(f"WARC-Segment-Total-Length: {len(http_head(size)) + size}")
    return b"".join(["\r\n".join(lines).encode(), END, block, payload])


def write(chunks: DataFrame, heads: DataFrame, path: str, date: str | None = None) -> None:
    """Write a chunk table and its ``typed`` rows as WARC files in the folder ``path``."""
    stamp = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    names = [c for c in heads.columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head: dict = {}
        for batch in batches:
            out = []
            infos, payloads = batch.column("head"), batch.column("payload")
            for i, chunk in enumerate(batch.column("chunk").to_pylist()):
                if chunk == 0:
                    head = infos[i].as_py()
                    if head["record_type"] == "revisit":
                        out.append(record_of(head, 1, memoryview(b""), stamp))
                elif head["record_type"] == "response":
                    out.append(record_of(head, chunk, memoryview(payloads[i].as_buffer() or b""), stamp))
            yield pa.record_batch([pa.array(out, pa.binary())], ["value"])

    first = heads.select("record", F.lit(0).alias("chunk"), F.lit(None).cast("binary").alias("payload"), F.struct(*names).alias("head"))
    rest = chunks.select("record", "chunk", "payload", F.lit(None).cast(first.schema["head"].dataType).alias("head"))
    rows = first.unionByName(rest).repartition("record").sortWithinPartitions("record", "chunk")
    lines = rows.mapInArrow(run, "value binary").select(F.col("value").cast("string"))
    spark = heads.sparkSession
    before = spark.conf.get(CLEANUP_KEY)
    spark.conf.set(CLEANUP_KEY, "true")
    try:
        lines.write.option("lineSep", "\r\n\r\n").option("compression", "gzip").text(path)
    finally:
        spark.conf.set(CLEANUP_KEY, before)
    rename_parts(spark, path)


def rename_parts(spark: SparkSession, path: str) -> None:
    """Give the files the ending that WARC readers look for."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    folder = jvm.org.apache.hadoop.fs.Path(path)
    store = folder.getFileSystem(conf)
    for status in store.listStatus(folder):
        name = status.getPath().getName()
        if name.endswith(".txt.gz"):
            store.rename(status.getPath(), jvm.org.apache.hadoop.fs.Path(folder, name.removesuffix(".txt.gz") + ".warc.gz"))


class Parser:
    """A WARC reader fed line by line (without line feeds); it gives chunk rows."""

    def __init__(self) -> None:
        self.header: dict[str, str] | None = None
        self.left = -1
        self.skip_http = False
        self.record: dict | None = None
        self.parts: list[bytes] = []

    def feed(self, line: bytes) -> dict | None:
        if self.left >= 0:
            return self.body(line)
        line = line.rstrip(b"\r")
        if self.header is None:
            if line:
                if not line.startswith(b"WARC/"):
                    raise ValueError(f"not a WARC record: {line[:80]!r}")
                self.header = {}
        elif line:
            name, _, value = line.decode().partition(":")
            self.header[name.lower()] = value.strip()
        else:
            self.open()
        return None

    def open(self) -> None:
        head, kind = self.header, self.header["warc-type"]
        self.left, self.parts = int(head["content-length"]), []
        self.skip_http = kind == "response"
        number = int(head.get("warc-segment-number", 1))
        if kind == "continuation":
            if self.record is None or head["warc-segment-origin-id"] != self.record["id"] or number != self.record["chunk"] + 1:
                raise ValueError(f"a segment without the one before it: {head['warc-record-id']}")
            self.record["chunk"] = number
        else:
            key, url = head["warc-record-id"].rpartition(":")[2].rstrip(">"), head["warc-target-uri"]
            refers = head.get("warc-refers-to", "").rpartition(":")[2].rstrip(">")
            self.record = {
                "id": head["warc-record-id"],
                "chunk": number,
                "key": int(key) if key else None,
                "url": None if url == NO_URL else url,
                "kind": kind,
                "refers_to": int(refers) if refers else None,
                "digest": hashlib.sha1(),
                "size": 0,
                "told": (int(head["x-payload-length"]), head["warc-payload-digest"].removeprefix("sha1:")),
            }
        self.record["last"] = "warc-segment-number" not in head or "warc-segment-total-length" in head

    def body(self, line: bytes) -> dict | None:
        """A line of the block; the block ends within a line, as a record has line ends of its own."""
        whole = line + b"\n"
        take, self.left = whole[: self.left], self.left - len(whole)
        if self.skip_http:
            self.skip_http = take != b"\r\n"
        else:
            self.parts.append(take)
        if self.left > 0:
            return None
        self.left, self.header = -1, None
        own, payload = self.record, b"".join(self.parts)
        own["digest"].update(payload)
        own["size"] += len(payload)
        size, digest = own["size"], base64.b32encode(own["digest"].digest()).decode()
        if own["kind"] == "revisit":
            size, digest = own["told"]
        elif own["last"] and own["told"] != (size, digest):
            raise ValueError(f"record {own['id']} has size and digest {size, digest}, not {own['told']}")
        return {
            "page_id": own["key"],
            "chunk": own["chunk"],
            "last": own["last"],
            "payload": payload,
            "url": own["url"],
            "record_type": own["kind"],
            "refers_to": own["refers_to"],
            "payload_bytes": size if own["last"] else None,
            "payload_digest": digest if own["last"] else None,
        }


def read(spark: SparkSession, path: str, keep_payload: bool = True) -> DataFrame:
    """The chunk rows of all WARC files in a folder; without ``keep_payload`` the payload is null."""
    fields = [f.split() for f in CHUNK_SCHEMA.split(", ")]
    kinds = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary(), "string": pa.string()}
    schema = pa.schema([(name, kinds[kind]) for name, kind in fields])

    def run(batches):
        parser, out, held = Parser(), [], 0
        for batch in batches:
            for line in batch.column(0):
                row = parser.feed(line.as_py())
                if row is None:
                    continue
                held += len(row["payload"]) + 200
                if not keep_payload:
                    row["payload"] = None
                out.append(row)
                if held > 4 << 20:
                    yield pa.RecordBatch.from_pylist(out, schema)
                    out, held = [], 0
        yield pa.RecordBatch.from_pylist(out, schema)

    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.select(F.col("value").cast("binary")).mapInArrow(run, CHUNK_SCHEMA)


def archive(df: DataFrame, chunk_bytes: int = CHUNK_BYTES, min_bytes: int = MIN_BYTES) -> DataFrame:
    """Write the rows as WARC, read the archives back: one row per record."""
    spark = df.sparkSession
    chunks = chunk_table(df, chunk_bytes)
    path = new_path(spark, "warc")
    write(chunks, typed(chunks, min_bytes), path)
    release(chunks)
    found = read(spark, path, keep_payload=False).where("last")
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
