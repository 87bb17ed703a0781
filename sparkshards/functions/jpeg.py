"""JPEG in numpy: baseline and progressive decoding, baseline encoding.

Pictures of a batch that have one geometry are decoded in step: one symbol of each at a
time, as vectors over the pictures.  Others (progressive ones, or with restarts) walk
their bits in plain Python, with tables of 16 bits that are kept for pictures that share
them.  Dequantisation, the cosine transform, upsampling and colours are done for all
blocks of all pictures of a geometry at once.
"""

from __future__ import annotations

import heapq
import itertools
import struct
from collections import Counter
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np

from .errors import DecodeError, EncodeError, Unsupported

# Marker codes.
SOI, EOI, SOS, DQT, DHT, DRI, APP14 = 0xD8, 0xD9, 0xDA, 0xDB, 0xC4, 0xDD, 0xEE
BASELINE, EXTENDED, PROGRESSIVE = 0xC0, 0xC1, 0xC2
#: Largest picture, in pixels; most pictures that are decoded in step, and their pixels.
MAX_PIXELS, MAX_IN_STEP, PIXELS_IN_STEP = 1 << 28, 1024, 1 << 22


@lru_cache(1)
def zigzag() -> np.ndarray:
    """Place in the block (row * 8 + column) of each coefficient in stream order: diagonals, in turn up and down."""
    order = sorted(((r + c, r if (r + c) % 2 else c, r, c) for r in range(8) for c in range(8)))
    return np.array([r * 8 + c for _, _, r, c in order])


@lru_cache(1)
def cosines() -> np.ndarray:
    """The orthonormal transform's matrix: rows are frequencies."""
    u, x = np.mgrid[0:8, 0:8]
    m = np.cos((2 * x + 1) * u * np.pi / 16) / 2
    m[0] /= np.sqrt(2)
    return m


@lru_cache(1)
def samples_of_coefficients() -> np.ndarray:
    """What each coefficient, in stream order, adds to each sample of a block."""
    return np.kron(cosines(), cosines())[zigzag()].astype(np.float32)


@lru_cache(64)
def code_table(counts: bytes, symbols: bytes) -> list[int]:
    """For every 16 bits: length of the code that they begin with << 8 | its symbol; 0 for none."""
    out, at, seen = np.zeros(1 << 16, np.int64), 0, 0
    for length, n in enumerate(counts, 1):
        for s in symbols[seen : seen + n]:
            width = 1 << (16 - length)
            if at + width > 1 << 16:
                raise DecodeError("JPEG code table is overfull")
            out[at : at + width] = length << 8 | s
            at += width
        seen += n
    return out.tolist()


class Bits:
    """The bits of one stretch of entropy-coded data; past its end come zeros."""

    def __init__(self, data: bytes):
        raw = np.frombuffer(data + bytes(8), np.uint8).astype(np.uint64)
        n = len(data) + 4
        words = np.zeros(n, np.uint64)
        for i in range(5):
            words = words << np.uint64(8) | raw[i : i + n]
        self.words, self.at, self.size = words.tolist(), 0, 8 * len(data)

    def peek16(self) -> int:
        i = self.at >> 3
        return (self.words[i] >> (24 - (self.at & 7))) & 0xFFFF if i < len(self.words) else 0

    def symbol(self, table: list[int]) -> int:
        found = table[self.peek16()]
        if not found or self.at > self.size + 32:
            raise DecodeError("JPEG data is cut off or damaged")
        self.at += found >> 8
        return found & 255

    def number(self, n: int) -> int:
        if not n:
            return 0
        out = self.peek16() >> (16 - n)
        self.at += n
        return out

    def signed(self, n: int) -> int:
        """A number of n bits, whose lower half stands for negative ones."""
        v = self.number(n)
        return v if not n or v >> (n - 1) else v - (1 << n) + 1


@dataclass
class Plane:
    """A colour component and its coefficients."""

    ident: int
    across: int
    down: int
    table: int
    blocks_wide: int = 0
    blocks_high: int = 0
    wide: int = 0
    high: int = 0
    held: list[list[int]] = field(default_factory=list)
    #: Coefficients in stream order as an array (blocks, 64), where pictures are decoded in step.
    array: np.ndarray | None = None

    def coefficients(self) -> np.ndarray:
        return np.array(self.held, np.int64) if self.array is None else self.array


@dataclass
class Scan:
    """Decodes the blocks of one scan."""

    first: int
    last: int
    high: int
    low: int
    progressive: bool
    run: int = 0

    def block(self, bits: Bits, held: list[int], dc: list[int] | None, ac: list[int] | None, before: int) -> int:
        """Adds to a block in stream order; returns the component's last DC value."""
        if not self.progressive or self.first == 0:
            if self.high == 0:
                before += bits.signed(bits.symbol(dc))
                held[0] = before << self.low
            elif bits.number(1):
                held[0] |= 1 << self.low
        if self.progressive and self.first == 0:
            return before
        at = max(self.first, 1)
        if self.high == 0:
            self._ac_first(bits, held, ac, at)
        else:
            self._ac_more(bits, held, ac, at)
        return before

    def _ac_first(self, bits: Bits, held: list[int], ac: list[int], at: int) -> None:
        if self.run:
            self.run -= 1
            return
        last, low = self.last, self.low
        while at <= last:
            code = bits.symbol(ac)
            zeros, n = code >> 4, code & 15
            if n:
                at += zeros
                if at > 63:
                    raise DecodeError("JPEG block runs over")
                held[at] = bits.signed(n) << low
                at += 1
            elif zeros == 15:
                at += 16
            else:
                if self.progressive:
                    self.run = (1 << zeros) - 1 + bits.number(zeros)
                return

    def _ac_more(self, bits: Bits, held: list[int], ac: list[int], at: int) -> None:
        step, last = 1 << self.low, self.last

        def correct(i: int) -> None:
            if bits.number(1) and not abs(held[i]) & step:
                held[i] += step if held[i] > 0 else -step

        if not self.run:
            while at <= last:
                code = bits.symbol(ac)
                zeros, new = code >> 4, 0
                if code & 15:
                    new = step if bits.number(1) else -step
                elif zeros < 15:
                    self.run = (1 << zeros) + bits.number(zeros)
                    break
                # passes over so many zeros, correcting what is not zero
                while at <= last:
                    if held[at]:
                        correct(at)
                    elif zeros:
                        zeros -= 1
                    else:
                        break
                    at += 1
                if new and at <= last:
                    held[at] = new
                at += 1
        if self.run:
            for i in range(at, last + 1):
                if held[i]:
                    correct(i)
            self.run -= 1


class Decoder:
    """Reads one picture up to its coefficients.  ``lazy``: a lone scan that could be decoded in step is left ``pending``."""

    def __init__(self, data: bytes, lazy: bool = False):
        self.data, self.quant, self.codes, self.planes = data, {}, {}, []
        self.interval, self.adobe, self.width, self.height = 0, None, 0, 0
        self.lazy, self.pending = lazy, None

    def parse(self) -> None:
        data, at, seen = self.data, 2, False
        if data[:2] != b"\xff\xd8":
            raise DecodeError("not a JPEG")
        while True:
            at = data.find(b"\xff", at)
            while 0 <= at < len(data) - 1 and data[at + 1] == 0xFF:
                at += 1
            if at < 0 or at + 2 > len(data):
                break
            kind = data[at + 1]
            if kind == EOI:
                break
            if kind in (0, 1) or 0xD0 <= kind <= SOI:
                at += 2
                continue
            size = struct.unpack_from(">H", data, at + 2)[0] if at + 4 <= len(data) else 0
            part = data[at + 4 : at + 2 + size]
            if size < 2 or len(part) < size - 2:
                raise DecodeError("JPEG segment is cut off")
            at += 2 + size
            if kind == DQT:
                self._quantisers(part)
            elif kind == DHT:
                self._code_tables(part)
            elif kind == DRI:
                self.interval = struct.unpack(">H", part[:2])[0]
            elif kind == APP14 and part[:5] == b"Adobe":
                self.adobe = part[11] if len(part) > 11 else None
            elif kind in (BASELINE, EXTENDED, PROGRESSIVE):
                self._frame(part, kind == PROGRESSIVE)
            elif 0xC0 <= kind <= 0xCF and kind not in (0xC8, 0xCC):
                raise Unsupported("JPEG other than baseline or progressive, Huffman-coded")
            elif kind == SOS:
                if not self.planes:
                    raise DecodeError("JPEG scan without a frame")
                at = self._scan(part, at)
                seen = True
        if not seen:
            raise DecodeError("JPEG without pixels")
        if any(p.table not in self.quant for p in self.planes):
            raise DecodeError("JPEG without quantisers")

    def _quantisers(self, part: bytes) -> None:
        at = 0
        while at < len(part):
            wide, number = part[at] >> 4, part[at] & 15
            size = 128 if wide else 64
            values = np.frombuffer(part[at + 1 : at + 1 + size], ">u2" if wide else np.uint8)
            if len(values) < 64:
                raise DecodeError("JPEG quantisers are cut off")
            self.quant[number] = values.astype(np.int64)
            at += 1 + size

    def _code_tables(self, part: bytes) -> None:
        at = 0
        while at + 17 <= len(part):
            counts = part[at + 1 : at + 17]
            symbols = part[at + 17 : at + 17 + sum(counts)]
            self.codes[part[at]] = (counts, symbols)
            at += 17 + sum(counts)

    def _frame(self, part: bytes, progressive: bool) -> None:
        depth, self.height, self.width, n = struct.unpack_from(">BHHB", part)
        self.progressive = progressive
        if depth != 8 or not self.height or not self.width or n not in (1, 3, 4) or len(part) < 6 + 3 * n:
            raise Unsupported("JPEG other than 8 bits with 1, 3 or 4 components")
        if self.height * self.width > MAX_PIXELS:
            raise Unsupported("JPEG is too large")
        self.planes = [Plane(i, s >> 4, s & 15, q) for i, s, q in struct.iter_unpack("BBB", part[6 : 6 + 3 * n])]
        if any(not 1 <= x <= 4 for p in self.planes for x in (p.across, p.down)):
            raise DecodeError("bad JPEG sampling")
        self.across, self.down = max(p.across for p in self.planes), max(p.down for p in self.planes)
        self.units_wide, self.units_high = -(-self.width // (8 * self.across)), -(-self.height // (8 * self.down))
        for p in self.planes:
            p.blocks_wide, p.blocks_high = self.units_wide * p.across, self.units_high * p.down
            p.wide, p.high = -(-self.width * p.across // self.across), -(-self.height * p.down // self.down)

    def _fill(self) -> None:
        for p in self.planes:
            p.held = p.held or [[0] * 64 for _ in range(p.blocks_wide * p.blocks_high)]

    def signature(self) -> tuple:
        """What pictures that are decoded in step have in common."""
        plain = self.adobe == 0 or (self.adobe is None and bytes(p.ident for p in self.planes) == b"RGB")
        return self.width, self.height, self.adobe, plain, tuple((p.across, p.down) for p in self.planes), self.pending is not None and tuple(self.planes.index(p) for p, _, _ in self.pending[1])

    def _scan(self, part: bytes, at: int) -> int:
        """Decodes the scan that begins there; the place after it."""
        n = part[0]
        chosen = [(next((p for p in self.planes if p.ident == i), None), t >> 4, t & 15) for i, t in zip(part[1 : 1 + 2 * n : 2], part[2 : 2 + 2 * n : 2])]
        first, last, bits_ = part[1 + 2 * n : 4 + 2 * n]
        if any(p is None for p, _, _ in chosen) or last > 63 or first > last:
            raise DecodeError("bad JPEG scan")
        end = at
        while (end := self.data.find(b"\xff", end)) >= 0 and end + 1 < len(self.data) and (self.data[end + 1] == 0 or 0xD0 <= self.data[end + 1] <= 0xD7):
            end += 2
        end = len(self.data) if end < 0 else end
        stretches, lo = [], at
        i = at
        while (i := self.data.find(b"\xff", i, end)) >= 0:
            if i + 1 < end and self.data[i + 1] != 0:
                stretches.append(self.data[lo:i])
                lo = i + 2
            i += 2
        stretches.append(self.data[lo:end])
        if self.pending is not None:  # another scan after all
            self.lazy, (stretch, tables) = False, self.pending
            self.pending = None
            self._walk([stretch], tables, (0, 63, 0))
        table = lambda k: self.codes.get(k)
        tables = [(p, table(dc), table(16 + ac)) for p, dc, ac in chosen]
        if self.lazy and not self.progressive and len(stretches) == 1 and len(tables) == len(self.planes) and all(dc and ac for _, dc, ac in tables):
            self.pending = (stretches[0], tables)
        else:
            self._walk(stretches, tables, (first, last, bits_))
        return end

    def _walk(self, stretches: list[bytes], specs: list[tuple], limits: tuple[int, int, int]) -> None:
        """Decodes a scan block by block."""
        self._fill()
        first, last, bits_ = limits
        units = self._units([p for p, _, _ in specs])
        tables = [(p, dc and code_table(*dc), ac and code_table(*ac)) for p, dc, ac in specs]
        per = self.interval or len(units)
        for k, stretch in zip(range(0, len(units), per), stretches):
            scan = Scan(first, last, bits_ >> 4, bits_ & 15, self.progressive)
            bits, before = Bits(stretch.replace(b"\xff\x00", b"\xff")), [0] * len(tables)
            for unit in units[k : k + per]:
                for c, b in unit:
                    p, dc, ac = tables[c]
                    if dc is None and first == 0 and scan.high == 0 or ac is None and last and (first or not self.progressive):
                        raise DecodeError("JPEG scan without code tables")
                    before[c] = scan.block(bits, p.held[b], dc, ac, before[c])

    def _units(self, planes: list[Plane]) -> list[list[tuple[int, int]]]:
        """(component, block) of each unit; a lone component has its own blocks only, row by row."""
        if len(planes) == 1:
            p = planes[0]
            return [[(0, y * p.blocks_wide + x)] for y in range(-(-p.high // 8)) for x in range(-(-p.wide // 8))]
        return [
            [(c, (y * p.down + v) * p.blocks_wide + x * p.across + h) for c, p in enumerate(planes) for v in range(p.down) for h in range(p.across)]
            for y in range(self.units_high) for x in range(self.units_wide)
        ]



def _canonical(spec: tuple[bytes, bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a code table: 16-bit limits beyond which codes are longer, symbols, what to add to a code of each
    length for its place, and for 8 bits: length << 8 | symbol of the code that they begin with, 0 for a longer one."""
    limits, offsets, symbols = np.full(16, 1 << 16), np.zeros(17, np.int64), np.zeros(256, np.int64)
    code = place = 0
    for i, n in enumerate(spec[0]):
        offsets[i + 1] = place - code
        code, place = code + n, place + n
        limits[i] = code << (15 - i)
        code <<= 1
    symbols[: len(spec[1])] = list(spec[1])
    lengths = np.repeat(np.arange(1, 17), list(spec[0]))[: len(spec[1])]
    brief = lengths <= 8
    found = np.repeat(lengths[brief] << 8 | symbols[: len(spec[1])][brief], 1 << (8 - lengths[brief]))[:256]
    short = np.zeros(256, np.int64)
    short[: len(found)] = found
    return limits, symbols, offsets, short


def _decode_in_step(group: list[Decoder]) -> np.ndarray:
    """Fills the coefficients of pictures with one geometry; which of them are sound."""
    lead = group[0]
    order = [lead.planes.index(p) for p, _, _ in lead.pending[1]]
    units = lead._units([p for p, _, _ in lead.pending[1]])
    sequence = [(c, b) for unit in units for c, b in unit]
    component, total, n = np.array([c for c, _ in sequence] + [0]), len(sequence), len(group)
    streams = [d.pending[0].replace(b"\xff\x00", b"\xff") for d in group]
    longest = max(map(len, streams)) + 16
    raw = np.zeros((n, longest + 5), np.uint8)
    for row, stream in zip(raw, streams):
        row[: len(stream)] = np.frombuffer(stream, np.uint8)
    words = np.zeros((n, longest), np.int64)
    for i in range(5):
        words = words << 8 | raw[:, i : i + longest]
    words, sizes = words.reshape(-1), np.array([8 * len(x) for x in streams])
    known: dict[tuple, int] = {}
    tables = np.array([[known.setdefault(spec, len(known)) for _, dc, ac in d.pending[1] for spec in (dc, ac)] for d in group])
    limits, symbols, offsets, short = (np.stack(x) for x in zip(*map(_canonical, known)))
    out = np.zeros((n, total, 64), np.int32)
    flat = out.reshape(-1)
    alive, sound = np.arange(n), np.ones(n, bool)
    at, block, place = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    before, base, width = np.zeros((n, len(order)), np.int64), np.arange(n) * longest, longest - 1
    while len(alive):
        c = component[block]
        table = tables[alive, 2 * c + (place > 0)]
        peek = (words[base + np.minimum(at >> 3, width)] >> (24 - (at & 7))) & 0xFFFF
        found = short[table, peek >> 8]
        length, symbol, bad = found >> 8, found & 255, at > sizes
        more = np.flatnonzero(length == 0)
        if len(more):
            own, ahead = table[more], peek[more]
            long = (ahead[:, None] >= limits[own]).sum(axis=1) + 1
            bad[more] |= long > 16
            length[more] = long = np.minimum(long, 16)
            symbol[more] = symbols[own, (offsets[own, long] + (ahead >> (16 - long))) & 255]
        at = at + length
        bits, zeros = symbol & 15, symbol >> 4
        value = (words[base + np.minimum(at >> 3, width)] >> (40 - (at & 7) - bits)) & ((1 << bits) - 1)
        value = np.where((bits > 0) & (value < (1 << bits >> 1)), value - (1 << bits) + 1, value)
        at = at + bits
        first = place == 0
        lead_ = np.flatnonzero(first)
        before[alive[lead_], c[lead_]] += value[lead_]
        value[lead_] = before[alive[lead_], c[lead_]]
        place = np.where(first, 0, place + zeros)
        bad |= (place > 63) & (bits > 0)
        some = np.flatnonzero((first | (bits > 0)) & ~bad)
        flat[(alive[some] * total + block[some]) * 64 + place[some]] = value[some]
        # the end of a block, or sixteen zeros
        place = np.where(first | (bits > 0) | (zeros == 15), place + 1, 64)
        done = place > 63
        block, place = block + done, np.where(done, 0, place)
        if bad.any() or (block == total).any():
            sound[alive[bad]] = False
            left = np.flatnonzero(~bad & (block < total))
            alive, at, block, place, base, sizes = alive[left], at[left], block[left], place[left], base[left], sizes[left]
    for k, index in enumerate(order):
        mine = np.array([i for i, (c, _) in enumerate(sequence) if c == k])
        to = np.array([b for c, b in sequence if c == k])
        p = lead.planes[index]
        held = np.zeros((n, p.blocks_wide * p.blocks_high, 64), np.int64)
        held[:, to] = out[:, mine]
        for d, own in zip(group, held):
            d.planes[index].array = own
    return sound


def _samples(group: list[Decoder], index: int) -> np.ndarray:
    """(pictures, height, width) of a component."""
    p = group[0].planes[index]
    held = np.empty((len(group), p.blocks_high * p.blocks_wide, 64), np.float32)
    for own, d in zip(held, group):
        np.multiply(d.planes[index].coefficients(), d.quant[d.planes[index].table], out=own, casting="unsafe")
    values = held.reshape(-1, 64) @ samples_of_coefficients()
    values += np.float32(128.5)
    grid = np.floor(values).clip(0, 255).astype(np.int32).reshape(len(group), p.blocks_high, p.blocks_wide, 8, 8)
    return grid.transpose(0, 1, 3, 2, 4).reshape(len(group), p.blocks_high * 8, p.blocks_wide * 8)[:, : p.high, : p.wide]


def _upsample(lead: Decoder, p: Plane, a: np.ndarray) -> np.ndarray:
    """To full size: by two with weights 3 and 1 of the neighbours, otherwise by repetition."""
    wide, high = lead.across // p.across, lead.down // p.down
    if wide == 2 and high in (1, 2) and p.across * 2 == lead.across and p.down * high == lead.down and p.wide > 2:
        if high == 2:
            up, down = np.concatenate([a[:, :1], a[:, :-1]], axis=1), np.concatenate([a[:, 1:], a[:, -1:]], axis=1)
            a = np.stack([3 * a + up, 3 * a + down], axis=2).reshape(len(a), -1, a.shape[2])
        left, right = np.concatenate([a[..., :1], a[..., :-1]], axis=2), np.concatenate([a[..., 1:], a[..., -1:]], axis=2)
        bias, shift = ((8, 7), 4) if high == 2 else ((1, 2), 2)
        a = np.stack([(3 * a + left + bias[0]) >> shift, (3 * a + right + bias[1]) >> shift], axis=3).reshape(*a.shape[:2], -1)
        return a[:, : lead.height, : lead.width]
    rows = np.arange(lead.height) * p.down // lead.down
    columns = np.arange(lead.width) * p.across // lead.across
    return a[:, rows.clip(max=a.shape[1] - 1)][:, :, columns.clip(max=a.shape[2] - 1)]


def _colours(lead: Decoder, planes: list[np.ndarray]) -> np.ndarray:
    if len(planes) == 1:
        return planes[0].astype(np.uint8)[..., None]
    plain = lead.signature()[3] or (len(planes) == 4 and lead.adobe != 2)
    rgb = planes[:3]
    if not plain:
        y, b, r = planes[0], planes[1] - 128, planes[2] - 128
        # ITU-R 601 in 16-bit fixed point
        rgb = [y + ((91881 * r + 32768) >> 16), y + ((-22554 * b - 46802 * r + 32768) >> 16), y + ((116130 * b + 32768) >> 16)]
    out = np.stack(rgb, axis=3).clip(0, 255)
    if len(planes) == 4:  # inks, stored inverted by those who mark them
        ink = out * planes[3][..., None] if lead.adobe is not None else (255 - out) * (255 - planes[3][..., None])
        out = (ink + 127) // 255
    return out.astype(np.uint8)


def _pixels(group: list[Decoder]) -> np.ndarray:
    lead = group[0]
    return _colours(lead, [_upsample(lead, p, _samples(group, i)) for i, p in enumerate(lead.planes)])


def read_jpegs(datas: list[bytes]) -> list[np.ndarray | Exception]:
    """(height, width, 1 or 3) uint8 of each picture, or what is wrong with it."""
    out: list[np.ndarray | Exception | None] = [None] * len(datas)
    groups: dict[tuple, list[tuple[int, Decoder]]] = {}
    for i, data in enumerate(datas):
        try:
            d = Decoder(data, lazy=len(datas) > 1)
            d.parse()
            groups.setdefault(d.signature(), []).append((i, d))
        except (Unsupported, DecodeError) as e:
            out[i] = e
        except (struct.error, IndexError, ValueError) as e:
            out[i] = DecodeError(f"damaged JPEG: {e}")
    for key, held in groups.items():
        most = max(1, min(MAX_IN_STEP, PIXELS_IN_STEP // (key[0] * key[1])))
        for lo in range(0, len(held), most):
            part = held[lo : lo + most]
            if part[0][1].pending is not None:
                sound = _decode_in_step([d for _, d in part])
                for (i, _), good in zip(part, sound):
                    out[i] = None if good else DecodeError("JPEG data is cut off or damaged")
                part = [x for x, good in zip(part, sound) if good]
            if part:
                for (i, _), a in zip(part, _pixels([d for _, d in part])):
                    out[i] = a
    return out


def read_jpeg(data: bytes) -> np.ndarray:
    found = read_jpegs([data])[0]
    if isinstance(found, Exception):
        raise found
    return found


# -- writing -----------------------------------------------------------------------


def quantisers(quality: int) -> np.ndarray:
    """Coarser with frequency and with lower quality, in stream order."""
    r, c = zigzag() // 8, zigzag() % 8
    scale = 50 / quality if quality < 50 else 2 - quality / 50
    return np.floor((10 + 6.0 * (r + c)) * scale + 0.5).clip(1, 255).astype(np.int64)


def code_lengths(counts: Counter) -> dict[int, int]:
    """Huffman code lengths of at most 16 bits, none of them all ones; of equal length if others would be longer."""
    tick = itertools.count()
    heap = [(n, next(tick), {s: 0}) for s, n in counts.items()] + [(0, next(tick), {-1: 0})]  # -1 takes the code of ones
    heapq.heapify(heap)
    while len(heap) > 1:
        (a, _, x), (b, _, y) = heapq.heappop(heap), heapq.heappop(heap)
        heapq.heappush(heap, (a + b, next(tick), {s: n + 1 for s, n in (x | y).items()}))
    lengths = heap[0][2]
    if max(lengths.values()) > 16:
        lengths = dict.fromkeys(lengths, (len(lengths)).bit_length())
    lengths.pop(-1)
    return lengths


def _codes(counts: Counter) -> tuple[bytes, dict[int, tuple[int, int]]]:
    """The table's segment body, and (code, bits) of each symbol."""
    lengths = code_lengths(counts)
    order = sorted(lengths, key=lambda s: (lengths[s], s))
    code, before, out = 0, 0, {}
    for s in order:
        code <<= lengths[s] - before
        before = lengths[s]
        out[s] = (code, before)
        code += 1
    return bytes(sum(n == k for n in lengths.values()) for k in range(1, 17)) + bytes(order), out


def write_jpeg(a: np.ndarray, quality: int = 85) -> bytes:
    """Baseline, without subsampling; alpha is left out."""
    a = a[..., None] if a.ndim == 2 else a
    height, width = a.shape[:2]
    if not 0 < height < 1 << 16 or not 0 < width < 1 << 16:
        raise EncodeError("no JPEG of this size")
    planes = [a[..., 0].astype(float)]
    if a.shape[2] > 1:
        r, g, b = (a[..., i].astype(float) for i in range(3))
        y = 0.299 * r + 0.587 * g + 0.114 * b
        planes = [y, (b - y) / 1.772 + 128, (r - y) / 1.402 + 128]
    quant, m, parts = quantisers(quality), cosines(), []
    for p in planes:
        p = np.pad(p, ((0, -height % 8), (0, -width % 8)), mode="edge") - 128
        blocks = p.reshape(len(p) // 8, 8, -1, 8).transpose(0, 2, 1, 3).reshape(-1, 8, 8)
        parts.append(np.rint((m @ blocks @ m.T).reshape(-1, 64)[:, zigzag()] / quant).astype(np.int64).clip(-1023, 1023))
    # a symbol and its extra bits for each step, blocks of all components in turn
    steps: list[tuple[int, int, int, int]] = []  # table, symbol, bits, how many
    last = [0] * len(parts)
    for i in range(len(parts[0])):
        for c, blocks in enumerate(parts):
            row = blocks[i].tolist()
            places = [0, *[k for k in range(1, 64) if row[k]]]
            for k, before in zip(places, [-1, *places]):
                v = row[k] - last[c] if k == 0 else row[k]
                zeros = k - before - 1
                while zeros > 15:
                    steps.append((1, 0xF0, 0, 0))
                    zeros -= 16
                n = abs(v).bit_length()
                steps.append((int(k > 0), zeros << 4 | n, v if v >= 0 else v + (1 << n) - 1, n))
            if places[-1] < 63:
                steps.append((1, 0, 0, 0))
            last[c] = row[0]
    made = [_codes(Counter(s for t, s, _, _ in steps if t == table) or Counter([0])) for table in (0, 1)]
    codes = np.array([(made[t][1][s][0] << n | v, made[t][1][s][1] + n) for t, s, v, n in steps], np.int64)
    ends = np.cumsum(codes[:, 1])
    owner = np.repeat(np.arange(len(codes)), codes[:, 1])
    bits = (codes[owner, 0] >> (ends[owner] - 1 - np.arange(int(ends[-1])))) & 1
    body = np.packbits(np.concatenate([bits, np.ones(-len(bits) % 8, np.int64)]).astype(np.uint8)).tobytes().replace(b"\xff", b"\xff\x00")
    segment = lambda kind, part: struct.pack(">BBH", 0xFF, kind, len(part) + 2) + part
    n = len(parts)
    frame = struct.pack(">BHHB", 8, height, width, n) + b"".join(bytes([i + 1, 0x11, 0]) for i in range(n))
    start = bytes([n]) + b"".join(bytes([i + 1, 0]) for i in range(n)) + bytes([0, 63, 0])
    return b"\xff\xd8" + segment(DQT, b"\0" + bytes(quant.tolist())) + segment(BASELINE, frame) + segment(DHT, b"\x00" + made[0][0]) + segment(DHT, b"\x10" + made[1][0]) + segment(SOS, start) + body + b"\xff\xd9"
