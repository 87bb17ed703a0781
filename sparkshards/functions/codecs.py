"""MessagePack and CBOR for JSON-like values."""

from __future__ import annotations

import math
import struct
from typing import Any

from .errors import DecodeError, EncodeError

_MAX_DEPTH = 256


class _Reader:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        if n < 0 or self.at + n > len(self.data):
            raise DecodeError("value is cut off")
        self.at += n
        return self.data[self.at - n : self.at]

    def number(self, kind: str) -> Any:
        return struct.unpack(">" + kind, self.take(struct.calcsize(kind)))[0]

    def text(self, n: int) -> str:
        try:
            return self.take(n).decode()
        except UnicodeDecodeError as e:
            raise DecodeError(str(e)) from e


def _key(x: Any) -> str:
    if not isinstance(x, str):
        raise DecodeError("map keys must be text")
    return x


def unpack_msgpack(data: bytes) -> Any:
    r = _Reader(data)

    def value(depth: int) -> Any:
        if depth > _MAX_DEPTH:
            raise DecodeError("nested too deeply")
        tag = r.number("B")
        if tag < 0x80:
            return tag
        if tag >= 0xE0:
            return tag - 256
        if tag < 0x90:
            return table(tag & 15, depth)
        if tag < 0xA0:
            return [value(depth + 1) for _ in range(tag & 15)]
        if tag < 0xC0:
            return r.text(tag & 31)
        fixed = {0xC0: None, 0xC2: False, 0xC3: True}
        if tag in fixed:
            return fixed[tag]
        numbers = {0xCA: "f", 0xCB: "d", 0xCC: "B", 0xCD: "H", 0xCE: "I", 0xCF: "Q", 0xD0: "b", 0xD1: "h", 0xD2: "i", 0xD3: "q"}
        if tag in numbers:
            return r.number(numbers[tag])
        sized = {0xC4: "B", 0xC5: "H", 0xC6: "I", 0xD9: "B", 0xDA: "H", 0xDB: "I", 0xDC: "H", 0xDD: "I", 0xDE: "H", 0xDF: "I"}
        if tag not in sized:
            raise DecodeError(f"tag {tag:#x}")
        n = r.number(sized[tag])
        if tag <= 0xC6:
            return list(r.take(n))  # bytes have no JSON form but numbers
        if tag <= 0xDB:
            return r.text(n)
        if tag <= 0xDD:
            return [value(depth + 1) for _ in range(n)]
        return table(n, depth)

    def table(n: int, depth: int) -> dict:
        return {_key(value(depth + 1)): value(depth + 1) for _ in range(n)}

    return value(0)


def pack_msgpack(x: Any) -> bytes:
    def sized(n: int, fix: tuple[int, int] | None, tags: tuple[int | None, int, int]) -> bytes:
        if fix and n < fix[1]:
            return bytes([fix[0] | n])
        for tag, kind, most in zip(tags, "BHI", (0xFF, 0xFFFF, 0xFFFFFFFF)):
            if tag is not None and n <= most:
                return bytes([tag]) + struct.pack(">" + kind, n)
        raise EncodeError("too long")

    if x is None or isinstance(x, bool):
        return {None: b"\xc0", False: b"\xc2", True: b"\xc3"}[x]
    if isinstance(x, int):
        if 0 <= x < 128:
            return bytes([x])
        if -32 <= x < 0:
            return struct.pack(">b", x)
        kinds = (("B", 0xCC), ("H", 0xCD), ("I", 0xCE), ("Q", 0xCF)) if x > 0 else (("b", 0xD0), ("h", 0xD1), ("i", 0xD2), ("q", 0xD3))
        for kind, tag in kinds:
            try:
                return bytes([tag]) + struct.pack(">" + kind, x)
            except struct.error:
                continue
        raise EncodeError("integer beyond 64 bits")
    if isinstance(x, float):
        return b"\xcb" + struct.pack(">d", x)
    if isinstance(x, str):
        data = x.encode()
        return sized(len(data), (0xA0, 32), (0xD9, 0xDA, 0xDB)) + data
    if isinstance(x, (list, tuple)):
        return sized(len(x), (0x90, 16), (None, 0xDC, 0xDD)) + b"".join(map(pack_msgpack, x))
    if isinstance(x, dict):
        return sized(len(x), (0x80, 16), (None, 0xDE, 0xDF)) + b"".join(pack_msgpack(str(k)) + pack_msgpack(v) for k, v in x.items())
    raise EncodeError(f"no MessagePack for {type(x).__name__}")


def unpack_cbor(data: bytes) -> Any:
    r = _Reader(data)
    stop = object()

    def size(info: int) -> int | None:
        if info < 24:
            return info
        if info == 31:
            return None
        kinds = {24: "B", 25: "H", 26: "I", 27: "Q"}
        if info not in kinds:
            raise DecodeError("bad CBOR length")
        return r.number(kinds[info])

    def half(bits: int) -> float:
        return struct.unpack(">e", struct.pack(">H", bits))[0]

    def value(depth: int) -> Any:
        if depth > _MAX_DEPTH:
            raise DecodeError("nested too deeply")
        head = r.number("B")
        major, info = head >> 5, head & 31
        if major == 7:
            if info == 31:
                return stop
            simple = {20: False, 21: True, 22: None, 23: None}
            if info in simple:
                return simple[info]
            if info in (25, 26, 27):
                return half(r.number("H")) if info == 25 else r.number("f" if info == 26 else "d")
            raise DecodeError("unknown CBOR simple value")
        n = size(info)
        if major in (0, 1):
            if n is None:
                raise DecodeError("bad CBOR integer")
            return n if major == 0 else -1 - n
        if major in (2, 3):
            if n is not None:
                return list(r.take(n)) if major == 2 else r.text(n)
            parts = []
            while (part := value(depth + 1)) is not stop:
                parts.append(part)
            return "".join(parts) if major == 3 else [b for p in parts for b in p]
        if major == 4:
            out = []
            while n is None or len(out) < n:
                x = value(depth + 1)
                if x is stop:
                    if n is None:
                        break
                    raise DecodeError("early CBOR break")
                out.append(x)
            return out
        if major == 5:
            held: dict[str, Any] = {}
            left = n
            while left is None or left > 0:
                k = value(depth + 1)
                if k is stop:
                    break
                held[_key(k)] = value(depth + 1)
                left = None if left is None else left - 1
            return held
        return value(depth + 1)  # a tag is skipped

    out = value(0)
    if out is stop:
        raise DecodeError("early CBOR break")
    return out


def pack_cbor(x: Any) -> bytes:
    def head(major: int, n: int) -> bytes:
        if n < 24:
            return bytes([major << 5 | n])
        for info, kind, most in ((24, "B", 0xFF), (25, "H", 0xFFFF), (26, "I", 0xFFFFFFFF), (27, "Q", (1 << 64) - 1)):
            if n <= most:
                return bytes([major << 5 | info]) + struct.pack(">" + kind, n)
        raise EncodeError("integer beyond 64 bits")

    if x is None or isinstance(x, bool):
        return {None: b"\xf6", False: b"\xf4", True: b"\xf5"}[x]
    if isinstance(x, int):
        return head(0, x) if x >= 0 else head(1, -1 - x)
    if isinstance(x, float):
        return b"\xfb" + struct.pack(">d", x)
    if isinstance(x, str):
        data = x.encode()
        return head(3, len(data)) + data
    if isinstance(x, (list, tuple)):
        return head(4, len(x)) + b"".join(map(pack_cbor, x))
    if isinstance(x, dict):
        return head(5, len(x)) + b"".join(pack_cbor(str(k)) + pack_cbor(v) for k, v in x.items())
    raise EncodeError(f"no CBOR for {type(x).__name__}")


def jsonable(x: Any) -> Any:
    """Non-finite numbers become null, integers beyond 64 bits become floats, keys are sorted."""
    if isinstance(x, float) and not math.isfinite(x):
        return None
    if isinstance(x, int) and not isinstance(x, bool) and not -(1 << 63) <= x < 1 << 63:
        return float(x)
    if isinstance(x, (list, tuple)):
        return [jsonable(v) for v in x]
    if isinstance(x, dict):
        return {str(k): jsonable(x[k]) for k in sorted(x, key=str)}
    return x
