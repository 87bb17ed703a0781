"""Tar archives as streams: a bounded parser, grouping by basename, and a writer."""

from __future__ import annotations

import bz2
import gzip
import io
import lzma
import os
import zlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from typing import BinaryIO

from ..functions.errors import DuplicateKey, EncodeError, FormatError, MissingKey, OnError, ShardError
from ..functions.names import base_plus_ext, format_shard_pattern, is_shard_metadata

_BLOCK, _STEP = 512, 1 << 20
#: Longest name or PAX header that is read into memory.
MAX_HEADER = 16 << 20


def magic_type(head: bytes) -> str:
    """gzip, bzip2, xz, zstd, tar or unknown."""
    for name, start in (("gzip", b"\x1f\x8b"), ("bzip2", b"BZh"), ("xz", b"\xfd7zXZ\0"), ("zstd", b"\x28\xb5\x2f\xfd")):
        if head.startswith(start):
            return name
    return "tar" if head[257:262] == b"ustar" else "unknown"


class _Replay(io.RawIOBase):
    """A stream with bytes put back in front."""

    def __init__(self, head: bytes, rest: BinaryIO):
        self.head, self.rest = head, rest

    def readable(self) -> bool:
        return True

    def readinto(self, out) -> int:
        data = self.head[: len(out)] if self.head else self.rest.read(len(out))
        self.head = self.head[len(data) :] if self.head else b""
        out[: len(data)] = data
        return len(data)


def decompress(stream: BinaryIO) -> BinaryIO:
    """By the first bytes; anything unknown passes through."""
    head = b""
    while len(head) < 264 and (more := stream.read(264 - len(head))):
        head += more
    whole = io.BufferedReader(_Replay(head, stream), _STEP)
    kind = magic_type(head)
    if kind == "gzip":
        return gzip.GzipFile(fileobj=whole)
    if kind == "bzip2":
        return bz2.BZ2File(whole)
    if kind == "xz":
        return lzma.LZMAFile(whole)
    if kind == "zstd":
        import zstandard

        return zstandard.ZstdDecompressor().stream_reader(whole, read_across_frames=True)
    return whole


def _exact(stream: BinaryIO, n: int, what: str, none_ok: bool = False) -> bytes:
    parts, left = [], n
    while left:
        data = stream.read(min(left, _STEP))
        if not data:
            if none_ok and left == n:
                return b""
            raise FormatError(f"archive ends inside {what}")
        parts.append(data)
        left -= len(data)
    return b"".join(parts)


def _number(raw: bytes) -> int:
    if raw[0] & 0x80:
        value = int.from_bytes(bytes([raw[0] & 0x7F]) + raw[1:], "big")
        if raw[0] & 0x40 or value >= 1 << 62:
            raise FormatError("bad size in header")
        return value
    text = raw.split(b"\0", 1)[0].strip(b" ")
    if not text:
        return 0
    if any(c not in b"01234567" for c in text):
        raise FormatError("bad number in header")
    return int(text, 8)


def _pax(data: bytes) -> dict[str, str]:
    out, at = {}, 0
    while at < len(data):
        blank = data.find(b" ", at, at + 20)
        if blank < 0 or not data[at:blank].isdigit():
            break
        size = int(data[at:blank])
        if size <= blank - at or at + size > len(data):
            break
        name, eq, value = data[blank + 1 : at + size - 1].partition(b"=")
        if eq:
            out[name.decode("utf-8", "replace")] = value.decode("utf-8", "replace")
        at += size
    return out


def members(stream: BinaryIO) -> Iterator[tuple[str, bytes]]:
    """(name, bytes) of the regular files; other types are passed over.

    A missing end mark is no error; a bad header or an end inside a member is.
    """
    long_name, extra, always = None, {}, {}
    while True:
        head = _exact(stream, _BLOCK, "a header", none_ok=True)
        if not head or not head.strip(b"\0"):
            return
        blank = head[:148] + b" " * 8 + head[156:]
        if _number(head[148:156]) not in (sum(blank), sum(b - 256 if b > 127 else b for b in blank)):
            raise FormatError("bad checksum")
        size, kind = _number(head[124:136]), head[156:157]
        if kind in b"LKxg" and kind:
            if size > MAX_HEADER:
                raise FormatError("header is too long")
        elif "size" in (held := always | extra):
            if not held["size"].isdigit():
                raise FormatError("bad size in header")
            size = int(held["size"])
        body = _exact(stream, size, "a member")
        _exact(stream, -size % _BLOCK, "padding")
        if kind == b"L":
            long_name = body.rstrip(b"\0").decode("utf-8", "replace")
        elif kind == b"x":
            extra = _pax(body)
        elif kind == b"g":
            always |= _pax(body)
        elif kind != b"K":
            name = head[:100].split(b"\0", 1)[0]
            if head[257:262] == b"ustar" and head[257:265] != b"ustar  \0" and head[345]:
                name = head[345:500].split(b"\0", 1)[0] + b"/" + name
            found = (always | extra).get("path") or long_name or name.decode("utf-8", "replace")
            long_name, extra = None, {}
            if kind in (b"0", b"\0", b"7"):
                yield found, body


@dataclass
class Sample:
    key: str
    fields: dict[str, bytes] = field(default_factory=dict)


@dataclass
class Selection:
    """Which members count: metadata is passed over, then names change, then ``select`` sees the new name."""

    select: Callable[[str], bool] | None = None
    rename: Callable[[str], str] | None = None
    skip_metadata: bool = True

    def apply(self, found: Iterable[tuple[str, bytes]]) -> Iterator[tuple[str, bytes]]:
        for name, data in found:
            if self.skip_metadata and is_shard_metadata(name):
                continue
            name = self.rename(name) if self.rename else name
            if self.select is None or self.select(name):
                yield name, data


@dataclass
class Problem:
    error: ShardError


def group(found: Iterable[tuple[str, bytes]], lowercase: bool = True) -> Iterator[Sample | Problem]:
    """Neighbours with one basename form a sample; a name that comes again later starts another.

    Members without an extension do not end a run.  A repeated field is a Problem, and
    the first stays.  An error of the source is the last thing given, after the sample
    in hand.
    """
    now: Sample | None = None
    source = iter(found)
    while True:
        try:
            name, data = next(source)
        except StopIteration:
            break
        except (ShardError, OSError, EOFError, zlib.error, lzma.LZMAError) as e:
            if now and now.fields:
                yield now
            yield Problem(e if isinstance(e, ShardError) else FormatError(str(e)))
            return
        parts = base_plus_ext(name)
        if parts is None:
            continue
        key, ext = parts[0], "".join(c.lower() if c.isascii() else c for c in parts[1]) if lowercase else parts[1]
        if now is None or now.key != key:
            if now and now.fields:
                yield now
            now = Sample(key)
        if ext in now.fields:
            yield Problem(DuplicateKey(f"{key}.{ext}"))
        else:
            now.fields[ext] = data
    if now and now.fields:
        yield now


def samples_and_problems(stream: BinaryIO, selection: Selection | None = None, lowercase: bool = True) -> Iterator[Sample | Problem]:
    """All that one archive gives."""
    yield from group((selection or Selection()).apply(members(decompress(stream))), lowercase)


def read_samples(stream: BinaryIO, selection: Selection | None = None, lowercase: bool = True, policy: OnError = OnError.RAISE) -> Iterator[Sample]:
    """Samples of one archive under a policy."""
    for x in samples_and_problems(stream, selection, lowercase):
        if isinstance(x, Sample):
            yield x
        elif policy is OnError.RAISE:
            raise x.error
        elif policy.stops:
            return


# -- writing ---------------------------------------------------------------------


def compression_of(name: str) -> str:
    """By the name's end."""
    for kind, ends in (("gzip", (".tgz", ".gz")), ("zstd", (".zst", ".zstd")), ("bzip2", (".bz2", ".tbz")), ("xz", (".xz",))):
        if name.endswith(ends):
            return kind
    return "none"


def compressor(name: str, sink: BinaryIO) -> BinaryIO:
    kind = compression_of(name)
    if kind == "gzip":
        return gzip.GzipFile(filename="", mode="wb", fileobj=sink, mtime=0)
    if kind == "bzip2":
        return bz2.BZ2File(sink, "wb")
    if kind == "xz":
        return lzma.LZMAFile(sink, "wb")
    if kind == "zstd":
        import zstandard

        return zstandard.ZstdCompressor().stream_writer(sink, closefd=False)
    return sink


def _header(name: bytes, size: int, kind: bytes, mtime: int, mode: int = 0o444) -> bytes:
    # fixed values: ustar layout, owner names
    prefix = b""
    if len(name) > 100:
        cut = name.rfind(b"/", 0, 156)
        if cut > 0 and len(name) - cut - 1 <= 100:
            prefix, name = name[:cut], name[cut + 1 :]
    length = b"%011o\0" % size if size < 1 << 33 else b"\x80" + size.to_bytes(11, "big")
    head = name[:100].ljust(100, b"\0") + b"%07o\0" % mode + b"%07o\0" % 0 * 2 + length + b"%011o\0" % mtime
    tail = kind + bytes(100) + b"ustar\x0000" + b"bigdata".ljust(32, b"\0") * 2 + b"%07o\0" % 0 * 2 + prefix.ljust(155, b"\0") + bytes(12)
    total = sum(head) + 8 * 32 + sum(tail)
    return head + b"%06o\0 " % total + tail


class TarWriter:
    """Writes samples as neighbouring members: fields by name, ``_`` names only with keep_meta."""

    def __init__(self, sink: BinaryIO, name: str = "", mtime: int = 0, keep_meta: bool = False):
        self.raw, self.out, self.mtime, self.keep_meta = sink, compressor(name, sink), mtime, keep_meta

    def member(self, name: str, data: bytes) -> None:
        raw = name.encode()
        fits = len(raw) <= 100 or (0 < (c := raw.rfind(b"/", 0, 156)) and len(raw) - c - 1 <= 100)
        if not fits:
            self.out.write(_header(b"././@LongLink", len(raw) + 1, b"L", 0) + raw + bytes(1) + bytes(-(len(raw) + 1) % _BLOCK))
        self.out.write(_header(raw, len(data), b"0", self.mtime) + data + bytes(-len(data) % _BLOCK))

    def write(self, key: str | None, fields: dict[str, bytes | str | None]) -> int:
        """Payload bytes written."""
        if key is None:
            raise MissingKey("__key__")
        total = 0
        for name in sorted(fields):
            if (name.startswith("_") and not self.keep_meta) or fields[name] is None:
                continue
            data = fields[name].encode() if isinstance(fields[name], str) else fields[name]
            if not isinstance(data, (bytes, bytearray)):
                raise EncodeError(f"field {name} is neither bytes nor text")
            self.member(f"{key}.{name}", bytes(data))
            total += len(data)
        return total

    def close(self) -> None:
        self.out.write(bytes(2 * _BLOCK))
        if self.out is not self.raw:
            self.out.close()


class ShardWriter:
    """Writes samples of one process to numbered archives, as a context manager.

    The next archive begins before a sample once the present one has max_count samples
    or max_size payload bytes, so it may exceed the size by one sample.  An archive is
    written beside its place and moved when it is whole; then ``post`` gets its name.
    For datasets, ``write_shards`` does the same on the executors.
    """

    def __init__(self, pattern: str, max_count: int = 100_000, max_size: int = 3_000_000_000, start_shard: int = 0, post: Callable[[str], None] | None = None, mtime: int = 0, keep_meta: bool = False):
        format_shard_pattern(pattern, 0)
        self.pattern, self.max_count, self.max_size, self.post = pattern, max_count, max_size, post
        self.mtime, self.keep_meta, self.shard = mtime, keep_meta, start_shard
        self.writer = self.sink = None
        self.count = self.size = self.total = 0

    def __enter__(self) -> ShardWriter:
        return self

    def __exit__(self, kind, *_) -> None:
        if kind is None:
            self.close()
        elif self.sink:
            self.sink.close()
            os.unlink(self.temp)

    def next_stream(self) -> None:
        """Ends the present archive and begins another."""
        self.close()
        self.name = format_shard_pattern(self.pattern, self.shard)
        self.temp = f"{self.name}.{os.getpid()}.part"
        self.shard += 1
        self.sink = open(self.temp, "wb")
        self.writer = TarWriter(self.sink, self.name, self.mtime, self.keep_meta)
        self.count = self.size = 0

    def write(self, key: str | None, fields: dict[str, bytes | str | None]) -> int:
        if self.writer is None or self.count >= self.max_count or self.size >= self.max_size:
            self.next_stream()
        n = self.writer.write(key, fields)
        self.count += 1
        self.size += n
        self.total += 1
        return n

    def close(self) -> None:
        if self.writer:
            self.writer.close()
            self.sink.close()
            os.replace(self.temp, self.name)
            self.writer = self.sink = None
            if self.post:
                self.post(self.name)
