"""WARC archives as a Spark data source: one gzip member for each record, read in sequence.

``df.write.format("warc").save(folder)`` writes an archive for each partition (a new one
when it grows large); ``spark.read.format("warc").load(folder)`` reads each archive as one
task.  Folders may be local, or in any store that Arrow's file systems know by URI.  Names hold the
write's id and the attempt, and a manifest, written last, lists a write's archives: lost
executors leave no half archives, a write adds to those before it, ``mode("overwrite")`` replaces
them, and writers may run at the same time.  Archives that others put into the folder are read too;
a folder that holds such is not overwritten.

The reader holds one record: it inflates pieces of the file, takes the record's header,
frames its block by Content-Length and compares the block's and the payload's SHA-1 with
the header.  A damaged or cut member becomes one row with ``problem`` set, and reading goes
on at the next member.

Written rows: ``record_id, record_type, uri, payload, payload_bytes, payload_digest,
refers_to``; a null record type is a response, a null payload is empty, a revisit has no payload and carries length and
digest of the one it refers to.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from satchel.plans.session import scratch_path
from satchel.sources.committer import Write, committed, place

#: Bytes of an archive after which the next one begins, bytes read and inflated at once.
ARCHIVE_BYTES, READ_BYTES, INFLATE_BYTES = 512 << 20, 1 << 16, 1 << 20
#: A header that is longer than this is damage.
HEADER_BYTES = 1 << 20
BATCH_ROWS, BATCH_BYTES = 256, 8 << 20
# Fixed values of the format.
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SCHEMA = ("record_id string, record_type string, uri string, payload binary, payload_bytes bigint, payload_digest string, "
          "refers_to string")
READ_SCHEMA = SCHEMA + ", problem string"


def digest(data: bytes) -> str:
    """Base32 of the SHA-1."""
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def member(row: dict, date: str = "1970-01-01T00:00:00Z") -> bytes:
    """One record as a gzip member."""
    payload, revisit = row["payload"] or b"", row["record_type"] == "revisit"
    size = row["payload_bytes"] if revisit else len(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [("WARC-Type", row["record_type"] or "response"), ("WARC-Record-ID", f"<{row['record_id']}>"), ("WARC-Date", date)]
    if row["uri"]:
        head.append(("WARC-Target-URI", row["uri"].replace("\r", "%0D").replace("\n", "%0A")))
    if revisit:
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<{row['refers_to']}>")]
    head += [("WARC-Payload-Digest", "sha1:" + (row["payload_digest"] if revisit else digest(payload))), ("WARC-Block-Digest", "sha1:" + digest(block)),
             ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    text = VERSION + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n"
    return packer.compress(text + block + b"\r\n\r\n") + packer.flush()


def inflated(pieces: Iterator[bytes]) -> Iterator[tuple[str, bytes]]:
    """("data", bytes), ("end", b"") after each member, ("bad", b"") for damage."""
    unpack, begun, rest = zlib.decompressobj(31), False, b""
    for piece in pieces:
        rest += piece
        more = False
        while rest or more:
            try:
                # In bounded pieces, whatever a member inflates to.
                out = unpack.decompress(rest, INFLATE_BYTES)
                more = len(out) == INFLATE_BYTES
            except zlib.error:
                yield "bad", b""
                unpack, begun, more = zlib.decompressobj(31), False, False
                at = rest.find(b"\x1f\x8b\x08", 1)
                rest = rest[at:] if at >= 0 else b""
                continue
            begun = True
            if out:
                yield "data", out
            rest = unpack.unconsumed_tail
            if unpack.eof:
                yield "end", b""
                rest, unpack, begun, more = unpack.unused_data, zlib.decompressobj(31), False, False
    if begun:
        yield "bad", b""


@dataclass
class _Open:
    """The record being read."""

    head: bytearray = field(default_factory=bytearray)
    fields: dict[str, str] | None = None
    block: bytearray = field(default_factory=bytearray)
    tail: bytearray = field(default_factory=bytearray)
    problem: str | None = None

    def feed(self, data: bytes) -> None:
        if self.fields is None:
            self.head += data
            at = self.head.find(b"\r\n\r\n")
            if at < 0:
                if len(self.head) > HEADER_BYTES:
                    self.problem, self.head = "no end of header", bytearray()
                return
            data = bytes(self.head[at + 4:])
            lines = bytes(self.head[:at]).decode("utf-8", "replace").split("\r\n")
            self.head = bytearray()
            self.fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
            if not lines[0].startswith("WARC/"):
                self.problem = "no WARC header"
            if not self.fields.get("content-length", "").isdigit():
                self.problem, self.fields["content-length"] = "no length", "0"
        room = int(self.fields["content-length"]) - len(self.block)
        self.block += data[:room]
        self.tail += data[room:][:8]

    def row(self, damaged: bool = False) -> tuple:
        got = self.fields or {}
        problem = "damaged member" if damaged else self.problem
        block, payload, size = bytes(self.block), None, None
        if not problem and (not got or len(block) != int(got["content-length"]) or bytes(self.tail) != b"\r\n\r\n"):
            problem = "length differs"
        own = got.get("warc-payload-digest", "").removeprefix("sha1:")
        if not problem and got.get("warc-block-digest", "sha1:" + digest(block)) != "sha1:" + digest(block):
            problem = "block digest differs"
        if not problem:
            http, _, payload = block.partition(b"\r\n\r\n") if got.get("content-type", "").startswith("application/http") else (b"", b"", block)
            size = len(payload)
            if got.get("warc-type") == "revisit":
                payload = None
                size = next((int(x.partition(b":")[2]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")), None)
            elif own and digest(payload) != own:
                problem, payload, size = "payload digest differs", None, None
        named = {k: got.get(k, "").strip("<>") or None for k in ("warc-record-id", "warc-refers-to")}
        return (named["warc-record-id"], got.get("warc-type"), got.get("warc-target-uri"), payload, size, own or None, named["warc-refers-to"], problem)


def records(pieces: Iterator[bytes]) -> Iterator[tuple]:
    """The rows of an archive given as pieces of bytes."""
    now = _Open()
    for kind, data in inflated(pieces):
        if kind == "data":
            now.feed(data)
        else:
            yield now.row(damaged=kind == "bad")
            now = _Open()


@dataclass
class _Written(WriterCommitMessage):
    files: list[str]


#: Names of archives that a writer here has made; all other archives are as they are found.
_OWN = re.compile(r"part-\d{6}-\d{4}-[0-9a-f]{32}-\d+\.warc\.gz")


def archives(path: str) -> list[str]:
    """Names of the archives that are part of a folder."""
    store, folder = place(path)
    found = store.get_file_info(fs.FileSelector(folder, allow_not_found=True))
    others = [i.base_name for i in found if i.base_name.endswith(".warc.gz") and not _OWN.fullmatch(i.base_name)]
    return sorted(others + (committed(path) or []))


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.own = path, Write(path, overwrite)
        if overwrite and any(not _OWN.fullmatch(n) for n in archives(path)):
            raise ValueError(f"{path} holds archives of others; it is not overwritten.")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        store, folder = place(self.path)
        store.create_dir(folder, recursive=True)
        task = TaskContext.get()
        files, out, size = [], None, 0
        for batch in iterator:
            for k in range(batch.num_rows):
                if out is None:
                    files.append(self.own.name(task.partitionId(), task.taskAttemptId(), len(files), ".warc.gz"))
                    out, size = store.open_output_stream(f"{folder}/{files[-1]}", compression=None), 0
                data = member({n: batch.column(n)[k].as_py() for n in batch.schema.names})
                out.write(data)
                size += len(data)
                if size >= ARCHIVE_BYTES:
                    out.close()
                    out = None
        if out is not None:
            out.close()
        return _Written(files)

    def commit(self, messages: list[_Written | None]) -> None:
        self.own.commit([n for m in messages if m for n in m.files])

    def abort(self, messages: list[_Written | None]) -> None:
        self.own.abort()


class WarcReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[InputPartition]:
        folder = place(self.path)[1]
        return [InputPartition(f"{folder}/{n}") for n in archives(self.path)] or [InputPartition(None)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if partition.value is None:
            return
        store, _ = place(self.path)
        kinds = [pa.string(), pa.string(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.string()]
        names = [x.split()[0] for x in READ_SCHEMA.split(", ")]

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.record_batch([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names)

        with store.open_input_stream(partition.value, compression=None) as stream:
            rows, size = [], 0
            for row in records(iter(lambda: stream.read(READ_BYTES), b"")):
                rows.append(row)
                size += len(row[3] or b"")
                if len(rows) >= BATCH_ROWS or size >= BATCH_BYTES:
                    yield batch(rows)
                    rows, size = [], 0
            if rows:
                yield batch(rows)


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return READ_SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"], overwrite)


PAGE = "urn:page:"


def page_records(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Rows to write for ``pages(page_id, url, html)``.

    Of equal payloads of ``least_bytes`` or more the one with the largest page_id is the
    response, the others revisit it; rows that repeat that page_id are responses too.  A
    null html is an empty payload.  A null page_id is no response if others have its
    payload.  Only digests are grouped, in parts before they are shuffled.
    """
    own = pages.select("page_id", F.col("url").alias("uri"), F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload"))
    own = own.withColumn("payload_bytes", F.octet_length("payload").cast("bigint")).withColumn("same", F.unhex(F.sha2("payload", 256)))
    groups = (own.where(F.col("payload_bytes") >= least_bytes).groupBy("same").agg(F.max("page_id").alias("last"), F.count(F.lit(1)).alias("n"))
              .where("n > 1 AND last IS NOT NULL").select("same", "last"))
    placed = own.join(groups, "same", "left")
    revisit = F.col("last").isNotNull() & ~F.col("last").eqNullSafe(F.col("page_id"))
    urn = F.concat(F.lit(PAGE), F.coalesce(F.col("page_id").cast("string"), F.lit("none")))
    return placed.select(
        urn.alias("record_id"), F.when(revisit, "revisit").otherwise("response").alias("record_type"), "uri",
        F.when(~revisit, F.col("payload")).alias("payload"), "payload_bytes", _base32(F.sha1("payload")).alias("payload_digest"),
        F.when(revisit, F.concat(F.lit(PAGE), F.col("last").cast("string"))).alias("refers_to"))


def _base32(hex_: Column) -> Column:
    """Base32 of 40 hexadecimal digits, four characters for each five digits."""
    letters = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")

    def four(k: int):
        value = F.conv(F.substring(hex_, 5 * k + 1, 5), 16, 10).cast("int")
        return [F.substring(letters, F.shiftright(value, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]

    return F.concat(*(x for k in range(8) for x in four(k)))


def archived(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """Write ``rows`` as archives below the shared folder and read them back."""
    spark.dataSource.register(WarcSource)
    folder = scratch_path(spark, "warc")
    rows.write.format("warc").mode("append").save(folder)
    return spark.read.format("warc").load(folder)


def read_pages(found: DataFrame) -> DataFrame:
    """What an archive says about each page; damaged records are no pages."""
    number = lambda c: F.expr(f"try_cast(substring({c}, {len(PAGE) + 1}) AS bigint)")
    return found.where("problem IS NULL").select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
                                                 number("refers_to").alias("refers_to"))
