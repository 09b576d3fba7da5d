"""WARC archives: a writer of whole-file gzip streams, the normaliser that splits them into members, and a reader.

Many crawlers compress an archive as one gzip stream, so no record can be read without inflating all before it.
:func:`normalise` inflates such a stream once, in pieces, rewrites every record as a gzip member of its own and notes
member offsets in a sidecar index, a table ``archive, offset, length, ...`` staged as Parquet. :func:`read_records` then
reads members by offset, archives in parallel and records of one archive by seeks.

Archives are files of at most ``archive_bytes`` of records (one record may be larger), named after their task, in the
shared folder of the cluster; a file appears under its name only when it is complete, so a task may run again. Memory
is a few buffers in the normaliser and one record in writer and reader.

Of pages with equal payloads of at least ``least`` bytes only that with the largest ``page_id`` is stored; the others are
revisit records. Only pages whose digest may be shared (a Bloom filter of bounded size) are shuffled to be told apart.

Defined results: null html is an empty payload; nulls in other columns leave out their header; of repeated rows with the
largest ``page_id`` one is the response; null page ids lose to any other; an empty table makes no archive.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from factsieve.llm.common import col, in_filter, key_filter, shared_folder, stage, text_bytes

CHUNK = 1 << 20
LEAST = 1000
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "archive string, offset long, length long, record_id string, record_type string, target_uri string"
RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string"


def file_system(uri: str) -> tuple[fs.FileSystem, str]:
    """The store and path of a URI such as Spark gives it (``file:/x`` has one slash)."""
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


class Whole:
    """A file that takes its name when it is closed complete."""

    def __init__(self, uri: str):
        self.store, self.path = file_system(uri)
        self.draft = f"{self.path}.{uuid.uuid4().hex}"
        self.store.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.out = self.store.open_output_stream(self.draft, compression=None)
        self.size = 0

    def write(self, data: bytes) -> None:
        self.out.write(data)
        self.size += len(data)

    def close(self) -> None:
        self.out.close()
        self.store.move(self.draft, self.path)


def _header(value: object) -> str:
    """A header value on one line."""
    return "".join(c if c.isprintable() else "".join(f"%{b:02X}" for b in c.encode("utf-8", "surrogatepass")) for c in str(value))


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}:{digest}')}>"


def make_record(page_id: int | None, url: str | None, digest: str, size: int, payload: bytes | None, refers_to: int | None, serial: str) -> bytes:
    """A response record, or without payload a revisit of ``refers_to``."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if payload is None else 'response'}"]
    lines.append(f"WARC-Record-ID: {record_id(page_id, digest) if payload is not None else f'<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, serial)}>'}")
    lines.append("WARC-Date: 1970-01-01T00:00:00Z")
    if url is not None:
        lines.append(f"WARC-Target-URI: {_header(url)}")
    lines.append(f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}")
    if payload is None:
        lines += [f"WARC-Profile: {IDENTICAL}", f"WARC-Refers-To: {record_id(refers_to, digest)}"]
        if refers_to is not None:
            lines.append(f"X-Refers-To-Page: {refers_to}")
    if page_id is not None:
        lines.append(f"X-Page-Id: {page_id}")
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(http) + len(payload or b'')}", "", ""]
    return "\r\n".join(lines).encode() + http + (payload or b"") + b"\r\n\r\n"


def decide(pages: DataFrame, least: int = LEAST, filter_bits: int = 1 << 22) -> DataFrame:
    """``page_id, url, html, digest, size, revisit, refers_to`` of every page; html only where it is to be stored."""
    html = F.coalesce(col("html"), F.lit("")).cast("binary")
    rows = pages.select(col("page_id").cast("long").alias("page_id"), col("url").cast("string").alias("url"), html.alias("html"))
    rows = rows.withColumn("digest", F.sha1("html")).withColumn("size", F.octet_length("html").cast("long")).withColumn("key", F.xxhash64("digest"))
    shared = rows.where(F.col("size") >= least).groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.max("page_id").alias("top")).where("n > 1").select("digest", "top")
    shared = stage(shared, "payloads")
    words = key_filter(shared.select(F.xxhash64("digest").alias("key")), "key", filter_bits)
    names = rows.columns

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(in_filter(np.asarray(batch.column(names.index("key"))), words))], names=[*names, "maybe"])

    marked = rows.mapInArrow(mark, rows.withColumn("maybe", F.lit(True)).schema)
    alone = marked.where("not maybe").select("page_id", "url", "html", "digest", "size", F.lit(False).alias("revisit"), F.lit(None).cast("long").alias("refers_to"))
    joined = marked.where("maybe").join(shared.withColumn("found", F.lit(True)), "digest", "left")
    top = F.col("page_id").eqNullSafe(F.col("top"))
    light = joined.withColumn("html", F.when(F.col("found").isNull() | top, F.col("html")))
    nth = F.row_number().over(W.Window.partitionBy("digest", "page_id").orderBy("url"))  # only repeated rows share a group
    told = light.withColumn("revisit", F.col("found").isNotNull() & ~(top & (nth == 1)))
    told = told.select("page_id", "url", F.when(~F.col("revisit"), F.col("html")).alias("html"), "digest", "size", "revisit", F.when(F.col("revisit"), F.col("top")).alias("refers_to"))
    return alone.unionByName(told)


def write_archives(rows: DataFrame, folder: str, archive_bytes: int = 1 << 26, level: int = 1) -> DataFrame:
    """Writes what :func:`decide` returns as ``*.warc.gz`` below ``folder``, each one gzip stream; ``archive, records, size`` of each."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, nth, out = TaskContext.get().partitionId(), 0, None

        def ended() -> pa.RecordBatch:
            out.write(squeeze.flush())
            out.close()
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([records]), pa.array([out.size])], names=["archive", "records", "size"])

        for batch in batches:
            columns = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            stored = columns["html"].is_valid().to_pylist()
            payloads = text_bytes(columns["html"])
            others = zip(*(columns[n].to_pylist() for n in ("page_id", "url", "digest", "size", "refers_to")), strict=True)
            for i, (page_id, url, digest, size, refers_to) in enumerate(others):
                if out is None:
                    name = f"{folder}/part-{part:06d}-{nth:04d}.warc.gz"
                    out, squeeze, records, taken = Whole(name), zlib.compressobj(level, zlib.DEFLATED, 31), 0, 0
                record = make_record(page_id, url, digest, size, payloads[i] if stored[i] else None, refers_to, f"{name}#{records}")
                out.write(squeeze.compress(record))
                records, taken = records + 1, taken + len(record)
                if taken >= archive_bytes:
                    yield ended()
                    nth, out = nth + 1, None
        if out is not None:
            yield ended()

    return stage(rows.mapInArrow(step, "archive string, records long, size long"), "archives")


def inflate(source: BinaryIO) -> Iterator[bytes]:
    """The content of a gzip file of any number of members, in pieces of bounded size."""
    engine, rest = zlib.decompressobj(31), b""
    started = False
    while True:
        data = rest or source.read(CHUNK)
        if not data:
            if started:
                raise ValueError("the gzip stream is cut off")
            return
        started = True
        out = engine.decompress(data, CHUNK)
        if out:
            yield bytes(out)
        if engine.eof:
            rest, engine, started = engine.unused_data, zlib.decompressobj(31), False
        else:
            rest = engine.unconsumed_tail


def parse_header(head: bytes) -> dict[str, str]:
    """Header fields by lower-case name."""
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:60]!r}")
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:] if line)}


def split_members(source: BinaryIO, sink: Whole, level: int = 6) -> Iterator[tuple[int, int, dict[str, str]]]:
    """Copies the records of an inflated-once stream to ``sink``, a member each; offset, length and header of each."""
    pieces, held = inflate(source), bytearray()
    more = True
    while more or held:
        while more and (end := held.find(b"\r\n\r\n")) < 0:
            piece = next(pieces, None)
            more = piece is not None
            held += piece or b""
        while held[:2] == b"\r\n":  # stray line ends between records
            del held[:2]
        end = held.find(b"\r\n\r\n")
        if end < 0:
            if held and not more:
                raise ValueError("a record's header is cut off")
            continue
        fields = parse_header(bytes(held[:end]))
        todo = end + 4 + int(fields["content-length"]) + 4
        offset, squeeze = sink.size, zlib.compressobj(level, zlib.DEFLATED, 31)
        while todo:
            if not held:
                piece = next(pieces, None)
                if piece is None:
                    raise ValueError("a record's block is cut off")
                held += piece
            sink.write(squeeze.compress(held[:todo]))
            took = min(todo, len(held))
            del held[:took]
            todo -= took
        sink.write(squeeze.flush())
        yield offset, sink.size - offset, fields


def normalise(archives: DataFrame, folder: str, level: int = 6) -> DataFrame:
    """Rewrites every archive of ``archives(archive)`` below ``folder`` and returns the sidecar index of all of them."""
    spark = archives.sparkSession
    # an archive is one stream, so a task is an archive
    tasks = archives.select("archive").repartitionByRange(max(1, archives.count()), "archive")

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                store, path = file_system(uri)
                name = f"{folder}/{path.rpartition('/')[2]}"
                sink = Whole(name)
                with store.open_input_stream(path, compression=None) as source:
                    rows = [(name, o, n, h.get("warc-record-id"), h.get("warc-type"), h.get("warc-target-uri")) for o, n, h in split_members(source, sink, level)]
                sink.close()
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * 6, (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()), strict=True)], names=["archive", "offset", "length", "record_id", "record_type", "target_uri"])

    index = f"{folder}/index"
    tasks.mapInArrow(step, INDEX).write.parquet(index)
    return spark.read.schema(INDEX).parquet(index)


def read_records(index: DataFrame, task_bytes: int = 1 << 23) -> DataFrame:
    """Every indexed record, read by its offset: the columns of ``RECORD``; responses are digested anew from what is stored.

    Tasks are runs of records of some ``task_bytes``, so a large archive is read by many.
    """
    tasks = 1 + (index.agg(F.sum("length")).first()[0] or 0) // task_bytes

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, file = None, None
        for batch in batches:
            rows = []
            for archive, offset, length in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if archive != at:
                    store, path = file_system(archive)
                    at, file = archive, store.open_input_file(path)
                record = zlib.decompress(file.read_at(length, offset), 31)
                head, _, block = record.partition(b"\r\n\r\n")
                fields = parse_header(head)
                block = block[: int(fields["content-length"])]
                http, _, payload = block.partition(b"\r\n\r\n")
                revisit = fields["warc-type"] == "revisit"
                digest = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex() if revisit else hashlib.sha1(payload).hexdigest()
                size = int(next(x for x in http.decode().split("\r\n") if x.startswith("Content-Length:"))[15:]) if revisit else len(payload)
                number = lambda name: int(fields[name]) if name in fields else None  # noqa: B023, E731
                rows.append((number("x-page-id"), size, digest, fields["warc-type"], number("x-refers-to-page"), fields.get("warc-target-uri")))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * 6, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()), strict=True)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"])

    runs = index.select("archive", "offset", "length").repartitionByRange(tasks, "archive", "offset").sortWithinPartitions("archive", "offset")
    return runs.mapInArrow(step, RECORD)


def round_trip(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """Pages written as whole-file streams, normalised, and every record read back."""
    spark = pages.sparkSession
    folder = shared_folder(spark, "warc")
    archives = write_archives(decide(pages, least), f"{folder}/whole")
    return read_records(normalise(archives, f"{folder}/members"))
