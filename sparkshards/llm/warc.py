"""WARC archives in Zstandard, with a dictionary in front and a frame for each record.

An archive starts with a skippable frame (magic 0x184D2A5D) that holds the
dictionary, itself compressed, and goes on with one Zstandard frame for each record.
The writer trains a dictionary for each archive from its first payloads (a bounded
sample), rolls to the next archive at a byte limit and writes under a name of its
own before moving the file to its place, so that a repeated task leaves whole files.
The reader decodes one frame at a time and checks version line, header syntax,
content lengths, the blank lines at the end and the payload digest.

Equal payloads of at least ``min_bytes`` are stored once: by the response with the
smallest id; the others are revisit records that refer to it.

Edge cases: null payloads are empty; rows with a null id are kept, never referred to
unless all their copies have a null id, in which case all are responses; of repeated
rows with the smallest id one (of the first uri) is the response, and the others revisit
that id; an empty table makes no archive.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, fresh_dir, small_batches

_MAGIC_DICT, _MAGIC_FRAME = 0x184D2A5D, 0xFD2FB528
_ID = "urn:row:"
_DATE = "2020-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Sample that a dictionary is trained on, and its size.
SAMPLE_BYTES, DICT_BYTES = 1 << 20, 16 << 10
#: Digests of copies up to this number are sent to all executors, more are joined by a shuffle.
BROADCAST_ROWS = 50_000


class WarcError(ValueError):
    """An archive or a record that breaks the format."""


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _one_line(text: str | None) -> str:
    return re.sub(r"[\r\n]+", " ", text or "")


def build_record(row_id: int | None, uri: str | None, payload: bytes | None, sha1: str, refers_to: int | None, size: int | None = None) -> bytes:
    """A response with its payload, or a revisit, which needs only its ``size`` and digest."""
    size = len(payload) if size is None else size
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <{_ID}{'' if row_id is None else row_id}>",
        f"WARC-Date: {_DATE}",
        f"WARC-Target-URI: {_one_line(uri)}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{sha1}",
        f"WARC-Block-Digest: sha1:{digest(block)}",
    ]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <{_ID}{refers_to}>", f"WARC-Profile: {PROFILE}"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> dict:
    """The record's named parts; WarcError if anything does not hold."""
    head, gap, rest = raw.partition(b"\r\n\r\n")
    if not gap:
        raise WarcError("no end of headers")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if lines[0] not in ("WARC/1.0", "WARC/1.1"):
        raise WarcError(f"bad version line {lines[0][:40]!r}")
    fields: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon or not re.fullmatch(r"[!#$%&'*+.^_`|~0-9A-Za-z-]+", name):
            raise WarcError(f"bad header line {line[:40]!r}")
        if name.lower() in fields:
            raise WarcError(f"repeated header {name}")
        fields[name.lower()] = value.strip()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in fields:
            raise WarcError(f"no {name}")
    if not fields["content-length"].isascii() or not fields["content-length"].isdigit():
        raise WarcError("bad content-length")
    length = int(fields["content-length"])
    if len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
        raise WarcError(f"block has not the {length} bytes and the end that it claims")
    block = rest[:length]
    if "warc-block-digest" in fields and fields["warc-block-digest"] != "sha1:" + digest(block):
        raise WarcError("block digest differs")
    return {"fields": fields, "block": block}


def parse_page(raw: bytes) -> tuple:
    """(id, uri, payload_bytes, payload_digest, record_type, refers_to, payload) of a page's record."""
    record = parse_record(raw)
    fields, kind = record["fields"], record["fields"]["warc-type"]
    if kind not in ("response", "revisit"):
        raise WarcError(f"unexpected type {kind}")
    http, gap, payload = record["block"].partition(b"\r\n\r\n")
    claimed = re.search(rb"(?im)^Content-Length: *(\d+)\r?$", http)
    if not gap or not claimed:
        raise WarcError("bad HTTP head")
    size, sha1 = int(claimed[1]), fields.get("warc-payload-digest", "").removeprefix("sha1:")
    number = lambda text: int(m[1]) if (m := re.fullmatch(rf"<{_ID}(-?\d+)>", text)) else None
    if kind == "response" and (len(payload) != size or digest(payload) != sha1):
        raise WarcError("payload has not the length or digest that it claims")
    if kind == "revisit" and (payload or "warc-refers-to" not in fields):
        raise WarcError("bad revisit")
    refers = number(fields["warc-refers-to"]) if kind == "revisit" else None
    return number(fields["warc-record-id"]), fields.get("warc-target-uri"), size, sha1, kind, refers, payload if kind == "response" else None


class ArchiveWriter:
    """Writes records to a stream; the first ones are held back to train the dictionary."""

    def __init__(self, sink: BinaryIO):
        self.sink, self.held, self.held_bytes, self.started, self.written, self.records = sink, [], 0, False, 0, 0

    def _put(self, data: bytes) -> None:
        self.sink.write(data)
        self.written += len(data)

    def _start(self) -> None:
        trained = b""
        if len(self.held) >= 16:
            try:
                trained = zstandard.train_dictionary(DICT_BYTES, [r[:4096] for r in self.held], k=256, d=8).as_bytes()
            except zstandard.ZstdError:  # too little to learn from
                trained = b""
        if not trained:  # any content may serve as a dictionary
            trained = b"".join(self.held)[:DICT_BYTES]
        packed = zstandard.ZstdCompressor(level=3).compress(trained)
        self._put(struct.pack("<II", _MAGIC_DICT, len(packed)) + packed)
        self.zip = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(trained), write_checksum=True, write_content_size=True)
        self.started = True
        for record in self.held:
            self._put(self.zip.compress(record))
        self.held = []

    def add(self, record: bytes) -> None:
        self.records += 1
        if self.started:
            self._put(self.zip.compress(record))
            return
        self.held.append(record)
        self.held_bytes += len(record)
        if self.held_bytes >= SAMPLE_BYTES:
            self._start()

    def close(self) -> None:
        if not self.started:
            self._start()


def read_archive(source: BinaryIO) -> Iterator[bytes]:
    """The records of an archive, one frame at a time."""
    head = source.read(8)
    if len(head) < 8:
        raise WarcError("archive ends in its first frame")
    magic, size = struct.unpack("<II", head)
    dictionary, carried = None, head
    if magic == _MAGIC_DICT:
        packed = source.read(size)
        if len(packed) < size:
            raise WarcError("archive ends in its dictionary")
        zipped = packed[:4] == struct.pack("<I", _MAGIC_FRAME)
        dictionary = zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(packed) if zipped else packed)
        carried = b""
    unzip = zstandard.ZstdDecompressor(dict_data=dictionary) if dictionary else zstandard.ZstdDecompressor()
    data = carried
    while True:
        if not data:
            data = source.read(1 << 20)
            if not data:
                return
        frame, out = unzip.decompressobj(), []
        while True:
            try:
                out.append(frame.decompress(data))
            except zstandard.ZstdError as e:
                raise WarcError(f"bad frame: {e}") from e
            if frame.eof:
                data = frame.unused_data
                break
            data = source.read(1 << 20)
            if not data:
                raise WarcError("archive ends in a frame")
        yield b"".join(out)


def _files(path: str) -> tuple[fs.FileSystem, str]:
    """A filesystem by URI; one path without a scheme is local."""
    return fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))


def mark_copies(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 0) -> DataFrame:
    """A row for each record: row_id, uri, payload, size, sha1 and refers_to (null for responses).

    Copies are decided on digests, ids and uris alone.  Payloads stay where they are read,
    unless more rows than BROADCAST_ROWS are copies; then responses' payloads are dealt by row.
    Revisits are made from digests, so no payload of theirs moves.
    """
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("row_id"), F.col(url_col).cast("string").alias("uri"), payload.alias("payload"))
    rows = rows.withColumns({"sha1": F.sha1("payload"), "size": F.octet_length("payload").cast("long")})
    key = ["sha1", "row_id", "uri"]
    slim = rows.where(F.col("size") >= min_bytes).groupBy("size", *key).agg(F.count(F.lit(1)).alias("n"))
    # the first row of each payload by (id, uri), ids that are null last; a row that comes n times is n records
    order = F.struct(F.col("row_id").isNull().alias("none"), "row_id", F.col("uri").isNotNull().alias("some"), "uri")
    firsts = slim.groupBy("sha1").agg(F.min(order).alias("f"), F.sum("n").alias("total")).where("total > 1 and not f.none")
    copies = slim.join(firsts.select("sha1", F.col("f.row_id").alias("first"), F.col("f.uri").alias("first_uri")), "sha1")
    is_first = F.col("row_id").eqNullSafe(F.col("first")) & F.col("uri").eqNullSafe(F.col("first_uri"))
    copies = cut(copies.select("size", *key, "first", is_first.alias("is_first"), "n").where("not is_first or n > 1"))
    revisits = copies.withColumn("n", F.when(F.col("is_first"), F.col("n") - 1).otherwise(F.col("n")))
    revisits = revisits.select("row_id", "uri", F.lit(None).cast("binary").alias("payload"), "size", "sha1", F.col("first").alias("refers_to"), F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("nth")).drop("nth")
    few = F.broadcast if copies.count() <= BROADCAST_ROWS else (lambda x: x)
    known = few(copies.select(*[F.col(c).alias(f"k_{c}") for c in key], "is_first"))
    same = F.lit(True)
    for c in key:
        same = same & F.col(c).eqNullSafe(F.col(f"k_{c}"))
    marked = rows.join(known, same, "left")
    columns = ["row_id", "uri", "payload", "size", "sha1", F.lit(None).cast("long").alias("refers_to")]
    out = marked.where("is_first is null").select(*columns).unionByName(revisits)
    if not copies.where("is_first").isEmpty():  # the first row itself is repeated: one of these is the response
        out = out.unionByName(marked.where("is_first").groupBy("size", *key).agg(F.first("payload").alias("payload")).select(*columns))
    return out


def write_archives(rows: DataFrame, folder: str, max_bytes: int = 64 << 20) -> DataFrame:
    """Writes the rows of ``mark_copies``; a row (path, records, bytes) for each archive, kept."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        files, root = _files(folder)
        files.create_dir(root, recursive=True)
        done: list[tuple] = []
        writer = sink = None

        def close() -> None:
            nonlocal writer, sink
            if writer:
                writer.close()
                sink.close()
                final = f"{root}/part-{context.partitionId():06d}-{len(done):04d}.warc.zst"
                files.move(temp, final)
                done.append((f"{folder}/{final.rsplit('/', 1)[1]}", writer.records, writer.written))
                writer = sink = None

        for batch in batches:
            for row_id, uri, payload, size, sha1, refers in zip(*(c.to_pylist() for c in batch.columns)):
                if writer is None:
                    temp = f"{root}/.attempt-{context.taskAttemptId()}-{len(done)}"
                    sink = files.open_output_stream(temp, compression=None)
                    writer = ArchiveWriter(sink)
                writer.add(build_record(row_id, uri, payload, base64.b32encode(bytes.fromhex(sha1)).decode(), refers, size))
                if writer.written >= max_bytes:
                    close()
        close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], ["path", "records", "bytes"])

    small_batches(rows.sparkSession)
    return cut(rows.select("row_id", "uri", "payload", "size", "sha1", "refers_to").mapInArrow(write, "path string, records long, bytes long"))


def read_archives(archives: DataFrame, with_payload: bool = True) -> DataFrame:
    """A row for each record of the archives in column ``path``."""
    schema = pa.schema([("row_id", pa.int64()), ("uri", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())] + [("payload", pa.binary())] * with_payload)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                files, name = _files(path)
                held, size = [], 0
                with files.open_input_stream(name, compression=None) as source:
                    for i, raw in enumerate(read_archive(source)):
                        try:
                            held.append(parse_page(raw)[: len(schema)])
                        except WarcError as e:
                            raise WarcError(f"{path}, record {i}: {e}") from e
                        size += len(raw) if with_payload else 200
                        if size >= 4 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)
                            held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)

    ddl = "row_id long, uri string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * with_payload
    return archives.select("path").mapInArrow(read, ddl)


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 0) -> DataFrame:
    """Writes archives to a fresh folder among the shared ones and reads them back."""
    folder = fresh_dir(pages.sparkSession, "warc")
    return read_archives(write_archives(mark_copies(pages, id_col, url_col, payload_col, min_bytes), folder), with_payload=False)
