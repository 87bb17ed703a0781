"""Images without an image library: PNG, JPEG, GIF, PPM/PGM and BMP in numpy; specs to layouts."""

from __future__ import annotations

import re
import struct
import zlib

import numpy as np

from .errors import DecodeError, EncodeError, Unsupported
from .jpeg import read_jpeg, read_jpegs, write_jpeg

#: Extensions that are images, and specs as (mode, element type, layout).
EXTENSIONS = ["jpg", "jpeg", "png", "ppm", "pgm", "pbm", "pnm", "bmp", "gif", "tif", "tiff", "webp", "tga", "dds", "exr", "ff", "hdr", "ico", "qoi", "avif", "img", "image"]
SPECS = {
    "l8": ("L", "uint8", "HWC"), "rgb8": ("RGB", "uint8", "HWC"), "rgba8": ("RGBA", "uint8", "HWC"),
    "l": ("L", "float32", "HWC"), "rgb": ("RGB", "float32", "HWC"), "rgba": ("RGBA", "float32", "HWC"),
    "torchl8": ("L", "uint8", "CHW"), "torchrgb8": ("RGB", "uint8", "CHW"), "torchrgba8": ("RGBA", "uint8", "CHW"),
    "torchl": ("L", "float32", "CHW"), "torchrgb": ("RGB", "float32", "CHW"), "torch": ("RGB", "float32", "CHW"), "torchrgba": ("RGBA", "float32", "CHW"),
    "pill": ("L", "uint8", "IMAGE"), "pil": ("RGB", "uint8", "IMAGE"), "pilrgb": ("RGB", "uint8", "IMAGE"), "pilrgba": ("RGBA", "uint8", "IMAGE"),
}


def spec(name: str) -> tuple[str, str, str]:
    if name.lower() not in SPECS:
        raise Unsupported(f"image spec {name!r}")
    return SPECS[name.lower()]


def luma(rgb: np.ndarray) -> np.ndarray:
    """ITU-R 601 in 16-bit fixed point."""
    r, g, b = (rgb[..., i].astype(np.uint32) for i in range(3))
    return ((19595 * r + 38470 * g + 7471 * b + 0x8000) >> 16).astype(np.uint8)


# -- PNG -------------------------------------------------------------------------


def _unfilter(raw: bytes, height: int, stride: int, bpp: int) -> np.ndarray:
    if len(raw) < height * (stride + 1):
        raise DecodeError("PNG data is cut off")
    rows = np.frombuffer(raw, np.uint8)[: height * (stride + 1)].reshape(height, stride + 1)
    out = np.zeros((height + 1, stride + bpp), np.uint8)
    for y in range(height):
        kind, line, up, here = rows[y, 0], rows[y, 1:], out[y], out[y + 1]
        if kind == 0:
            here[bpp:] = line
        elif kind == 1:
            for c in range(bpp):
                here[bpp + c :: bpp] = np.cumsum(line[c::bpp], dtype=np.uint8)
        elif kind == 2:
            here[bpp:] = line + up[bpp:]
        elif kind in (3, 4):
            above = up.astype(int).tolist()
            now = [0] * (stride + bpp)
            for i, v in enumerate(line.tolist(), bpp):
                a, b = now[i - bpp], above[i]
                if kind == 3:
                    guess = (a + b) // 2
                else:
                    c = above[i - bpp]
                    p = a + b - c
                    pa, pb, pc = abs(p - a), abs(p - b), abs(p - c)
                    guess = a if pa <= pb and pa <= pc else b if pb <= pc else c
                now[i] = (v + guess) & 255
            here[:] = now
        else:
            raise DecodeError(f"PNG filter {kind}")
    return out[1:, bpp:]


def _unpacked(raw: bytes, width: int, height: int, channels: int, depth: int) -> np.ndarray:
    """(height, width, channels) samples of a picture or of one pass of it, at most 8 bits of each."""
    bits = width * channels * depth
    rows = _unfilter(raw, height, -(-bits // 8), max(1, channels * depth // 8))
    if depth == 16:
        rows = rows[:, ::2]  # the high bytes
    elif depth < 8:
        each = np.unpackbits(rows, axis=1)[:, :bits].reshape(height, -1, depth)
        rows = (each * (1 << np.arange(depth - 1, -1, -1))).sum(axis=2).astype(np.uint8)
    return rows.reshape(height, width, channels)


def _passes(width: int, height: int) -> list[tuple[int, int, int, int]]:
    """First column and row, and steps, of the seven passes of an interlaced picture that hold pixels."""
    found = [(0, 0, 8, 8)]
    for step in (8, 4, 2):  # half of what is left by columns, then by rows
        found += [(step // 2, 0, step, step), (0, step // 2, step // 2, step)]
    return [(x, y, dx, dy) for x, y, dx, dy in found if x < width and y < height]


def read_png(data: bytes) -> np.ndarray:
    """(height, width, 1, 3 or 4) uint8; 16 bits keep their high byte, fewer are widened, grey with alpha becomes RGBA."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise DecodeError("not a PNG")
    at, body, palette, clear, head = 8, [], None, None, None
    while at + 12 <= len(data):
        size, kind = struct.unpack_from(">I4s", data, at)
        part = data[at + 8 : at + 8 + size]
        if len(part) < size or struct.unpack_from(">I", data.ljust(at + 12 + size, b"\0"), at + 8 + size)[0] != zlib.crc32(kind + part):
            raise DecodeError("damaged PNG chunk")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", part)
        elif kind == b"PLTE":
            palette = np.frombuffer(part, np.uint8).reshape(-1, 3)
        elif kind == b"tRNS":
            clear = np.frombuffer(part, np.uint8)
        elif kind == b"IDAT":
            body.append(part)
        elif kind == b"IEND":
            break
        at += 12 + size
    if head is None:
        raise DecodeError("PNG without a header")
    width, height, depth, color, _, _, interlaced = head
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}.get(color)
    if channels is None or depth not in (1, 2, 4, 8, 16) or (depth < 8 and channels > 1):
        raise Unsupported("kind of PNG")
    passes = _passes(width, height) if interlaced else [(0, 0, 1, 1)]
    spans = [(-(-(width - x) // dx), -(-(height - y) // dy)) for x, y, dx, dy in passes]
    sizes = [h * (-(-w * channels * depth // 8) + 1) for w, h in spans]
    try:
        raw = zlib.decompressobj().decompress(b"".join(body), sum(sizes))
    except zlib.error as e:
        raise DecodeError(f"PNG data: {e}") from e
    a, begin = np.zeros((height, width, channels), np.uint8), 0
    for (x, y, dx, dy), (w, h), size in zip(passes, spans, sizes):
        a[y::dy, x::dx] = _unpacked(raw[begin : begin + size], w, h, channels, depth)
        begin += size
    if color == 3:
        if palette is None or int(a.max(initial=0)) >= len(palette):
            raise DecodeError("bad PNG palette")
        rgb = palette[a[..., 0]]
        if clear is None:
            return rgb
        alpha = np.full(len(palette), 255, np.uint8)
        alpha[: len(clear)] = clear[: len(palette)]
        return np.concatenate([rgb, alpha[a[..., 0]][..., None]], axis=2)
    if depth < 8:
        a = a * np.uint8(255 // ((1 << depth) - 1))
    if color == 4:
        return np.concatenate([a[..., :1]] * 3 + [a[..., 1:]], axis=2)
    return a


def write_png(a: np.ndarray) -> bytes:
    a = a[..., None] if a.ndim == 2 else a
    height, width, channels = a.shape
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    lines = np.concatenate([np.zeros((height, 1), np.uint8), a.reshape(height, -1)], axis=1).tobytes()
    head = struct.pack(">IIBBBBB", width, height, 8, {1: 0, 3: 2, 4: 6}[channels], 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


# -- PPM, BMP --------------------------------------------------------------------


def read_pnm(data: bytes) -> np.ndarray:
    m = re.match(rb"(P[56])(?:\s+#[^\n]*\n)*\s+(\d+)\s+(\d+)\s+(\d+)\s", data)
    if not m or int(m[4]) != 255:
        raise Unsupported("PNM other than 8-bit P5 or P6")
    width, height, channels = int(m[2]), int(m[3]), 3 if m[1] == b"P6" else 1
    if len(data) < m.end() + width * height * channels:
        raise DecodeError("PNM data is cut off")
    return np.frombuffer(data, np.uint8, width * height * channels, m.end()).reshape(height, width, channels)


def write_pnm(a: np.ndarray) -> bytes:
    a = a[..., None] if a.ndim == 2 else a
    if a.shape[2] == 4:
        raise EncodeError("PNM has no alpha")
    return f"P{6 if a.shape[2] == 3 else 5}\n{a.shape[1]} {a.shape[0]}\n255\n".encode() + a.tobytes()


def read_bmp(data: bytes) -> np.ndarray:
    if data[:2] != b"BM" or len(data) < 54:
        raise DecodeError("not a BMP")
    start, _, width, height, _, bits, packed = struct.unpack_from("<IIiiHHI", data, 10)
    if bits not in (24, 32) or packed not in (0, 3):
        raise Unsupported("BMP other than 24 or 32 bits")
    stride = (width * bits // 8 + 3) // 4 * 4
    if len(data) < start + stride * abs(height):
        raise DecodeError("BMP data is cut off")
    rows = np.frombuffer(data, np.uint8, stride * abs(height), start).reshape(abs(height), stride)[:, : width * bits // 8]
    a = rows.reshape(abs(height), width, bits // 8)[:, :, [2, 1, 0]]
    return a[::-1].copy() if height > 0 else a.copy()


def write_bmp(a: np.ndarray) -> bytes:
    a = a[..., None] if a.ndim == 2 else a
    rgb = np.repeat(a, 3, axis=2) if a.shape[2] == 1 else a[..., :3]
    height, width = rgb.shape[:2]
    rows = np.zeros((height, (width * 3 + 3) // 4 * 4), np.uint8)
    rows[:, : width * 3] = rgb[::-1, :, ::-1].reshape(height, -1)
    return b"BM" + struct.pack("<IHHI", 54 + rows.size, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, width, height, 1, 24, 0, rows.size, 2835, 2835, 0, 0) + rows.tobytes()


# -- GIF -------------------------------------------------------------------------


def _lzw(data: bytes, width: int) -> bytes:
    """Codes that grow from ``width`` + 1 to 12 bits, lowest bit first."""
    clear = 1 << width
    start = [bytes([i]) for i in range(clear)] + [b"", b""]
    table, size, before, out = list(start), width + 1, None, []
    held = have = 0
    for byte in data:
        held |= byte << have
        have += 8
        while have >= size:
            code, held, have = held & ((1 << size) - 1), held >> size, have - size
            if code == clear:
                table, size, before = list(start), width + 1, None
                continue
            if code == clear + 1:
                return b"".join(out)
            if code > len(table) or (before is None and code >= clear):
                raise DecodeError("bad GIF code")
            entry = table[code] if code < len(table) else before + before[:1]
            out.append(entry)
            if before is not None and len(table) < 4096:
                table.append(before + entry[:1])
                if len(table) == 1 << size and size < 12:
                    size += 1
            before = entry
    return b"".join(out)


def read_gif(data: bytes) -> np.ndarray:
    """The first picture, (height, width, 3 or 4) uint8; alpha if it has a clear colour or leaves a part of the canvas."""
    if data[:6] not in (b"GIF87a", b"GIF89a") or len(data) < 13:
        raise DecodeError("not a GIF")
    wide, high, flags = struct.unpack_from("<HHB", data, 6)
    colours = lambda at, f: np.frombuffer(data, np.uint8, 3 << (f & 7) + 1, at).reshape(-1, 3)
    at = 13
    shared = colours(at, flags) if flags & 0x80 else None
    at += 3 << (flags & 7) + 1 if flags & 0x80 else 0
    clear = None

    def blocks(at: int) -> tuple[bytes, int]:
        parts = []
        while data[at]:
            parts.append(data[at + 1 : at + 1 + data[at]])
            at += 1 + data[at]
        return b"".join(parts), at + 1

    try:
        while data[at] != 0x2C:
            if data[at] != 0x21:
                raise DecodeError("GIF without a picture")
            part, after = blocks(at + 2)
            if data[at + 1] == 0xF9 and part[0] & 1:
                clear = part[3]
            at = after
        x, y, w, h, own = struct.unpack_from("<HHHHB", data, at + 1)
        at += 10
        palette = colours(at, own) if own & 0x80 else shared
        at += 3 << (own & 7) + 1 if own & 0x80 else 0
        pixels = _lzw(blocks(at + 1)[0], data[at])
    except (IndexError, ValueError, struct.error) as e:
        raise DecodeError(f"damaged GIF: {e}") from e
    if palette is None or len(pixels) < w * h:
        raise DecodeError("GIF is cut off")
    a = np.frombuffer(pixels, np.uint8, w * h).reshape(h, w)
    if own & 0x40:  # every eighth row, then those between, twice as many each time
        order = [r for first, step in ((0, 8), (4, 8), (2, 4), (1, 2)) for r in range(first, h, step)]
        a = a[np.argsort(order)]
    if int(a.max(initial=0)) >= len(palette):
        raise DecodeError("bad GIF palette")
    whole = np.zeros((max(high, y + h), max(wide, x + w), 4), np.uint8)
    whole[y : y + h, x : x + w, :3] = palette[a]
    whole[y : y + h, x : x + w, 3] = 255 if clear is None else np.where(a == clear, 0, 255)
    return whole if (whole[..., 3] == 0).any() else whole[..., :3].copy()


# -- any -------------------------------------------------------------------------


def read_image(data: bytes) -> np.ndarray:
    """By the first bytes, not by the name."""
    if data[:4] == b"\x89PNG":
        return read_png(data)
    if data[:2] in (b"P5", b"P6"):
        return read_pnm(data)
    if data[:2] == b"BM":
        return read_bmp(data)
    if data[:3] == b"\xff\xd8\xff":
        return read_jpeg(data)
    if data[:4] == b"GIF8":
        return read_gif(data)
    raise Unsupported("image format")


def read_images(datas: list[bytes | None]) -> list[np.ndarray | Exception | None]:
    """Each picture, or what is wrong with it; JPEGs of one geometry are read together."""
    out: list[np.ndarray | Exception | None] = [None] * len(datas)
    together = [i for i, d in enumerate(datas) if d is not None and d[:3] == b"\xff\xd8\xff"]
    for i, found in zip(together, read_jpegs([datas[i] for i in together])):
        out[i] = found
    for i, d in enumerate(datas):
        if d is not None and out[i] is None:
            try:
                out[i] = read_image(d)
            except (DecodeError, Unsupported) as e:
                out[i] = e
            except Exception as e:
                out[i] = DecodeError(f"image: {e}")
    return out


def to_mode(a: np.ndarray, mode: str) -> np.ndarray:
    """Channels as the mode asks; grey has no channel axis."""
    rgb = np.repeat(a, 3, axis=2) if a.shape[2] == 1 else a[..., :3]
    if mode == "L":
        return a[..., 0] if a.shape[2] == 1 else luma(a)
    if mode == "RGB":
        return rgb
    alpha = a[..., 3:] if a.shape[2] == 4 else np.full((*a.shape[:2], 1), 255, np.uint8)
    return np.concatenate([rgb, alpha], axis=2)


def to_value(a: np.ndarray, name: str) -> np.ndarray:
    mode, kind, layout = spec(name)
    out = to_mode(a, mode)
    if kind == "float32":
        out = out.astype(np.float32) / np.float32(255)
    return np.ascontiguousarray(out.transpose(2, 0, 1)) if layout == "CHW" and out.ndim == 3 else out


def from_value(a: np.ndarray) -> np.ndarray:
    """Pixels of a value: integers are clamped, floats must be about 0 to 1 and are scaled."""
    if a.ndim not in (2, 3) or (a.ndim == 3 and a.shape[2] not in (1, 3, 4)):
        raise EncodeError(f"no image of shape {a.shape}")
    if a.dtype.kind == "f":
        if a.size and (float(a.min()) < -0.001 or float(a.max()) > 1.001):
            raise EncodeError("float pixels must be from 0 to 1")
        return np.rint(a.astype(np.float64).clip(0, 1) * 255).astype(np.uint8)
    return a.clip(0, 255).astype(np.uint8)


def write_image(a: np.ndarray, extension: str) -> bytes:
    pixels = from_value(np.asarray(a))
    writers = {"png": write_png, "ppm": write_pnm, "pgm": write_pnm, "pnm": write_pnm, "bmp": write_bmp, "jpg": write_jpeg, "jpeg": write_jpeg}
    if extension not in writers:
        raise Unsupported(f"writing .{extension} images")
    return writers[extension](pixels)
