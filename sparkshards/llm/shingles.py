"""Word-shingle hashing for batches of whole texts, vectorised in numpy.

A word is a maximal run of bytes other than space and 0x09-0x0D, with A-Z
lower-cased.  A shingle is ``width`` consecutive words; a text with fewer words
has one shingle, its whole word sequence.  Shingles are 64-bit hashes: a
position-independent polynomial over table-mapped bytes for words, a mixed
linear combination of word hashes for shingles.

A text longer than a block is hashed in slices, a word that crosses them as a whole, so
that what is held besides the text are its words' hashes.

Edge cases: null or blank text has no shingle; repeated shingles count once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_P = np.uint64(0x9E3779B97F4A7C15)
_P_INV = np.uint64(pow(int(_P), -1, 1 << 64))
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: Bytes hashed at a time.
BLOCK_BYTES = 1 << 18

_table: np.ndarray | None = None
_powers: tuple[np.ndarray, np.ndarray] | None = None


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, on a fresh array."""
    x = x ^ (x >> np.uint64(30))
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


def _byte_table() -> np.ndarray:
    global _table
    if _table is None:
        b = np.arange(256, dtype=np.uint64)
        b[65:91] = np.arange(97, 123, dtype=np.uint64)  # A-Z as a-z
        _table = mix64((b + np.uint64(1)) * _P)
    return _table


def _power_tables() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, for a slice."""
    global _powers
    if _powers is None:
        up, down = np.full(BLOCK_BYTES + 1, _P, np.uint64), np.full(BLOCK_BYTES + 1, _P_INV, np.uint64)
        up[0] = down[0] = 1
        _powers = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _powers


def _word_parts(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, polynomial) of each run of word bytes of a slice."""
    word = np.empty(len(a) + 2, bool)
    word[0] = word[-1] = False
    word[1:-1] = ~((a == 32) | ((a >= 9) & (a <= 13)))
    edges = np.flatnonzero(word[1:] != word[:-1])
    starts, ends = edges[::2], edges[1::2]
    up, down = _power_tables()
    sums = np.empty(len(a) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(_byte_table()[a] * down[: len(a)], out=sums[1:])
    return starts, ends - starts, (sums[ends] - sums[starts]) * up[starts]


def _joined(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The parts of neighbouring slices; one word where a slice's last part and the next one's first touch."""
    starts, lengths, sums = (np.concatenate(x) for x in zip(*parts))
    touching = np.flatnonzero((starts[1:] == starts[:-1] + lengths[:-1]) & (starts[1:] % size == 0)) + 1
    for i in touching[::-1].tolist():  # one a slice at most
        sums[i - 1] = (int(sums[i - 1]) + int(sums[i]) * pow(int(_P_INV), int(lengths[i - 1]), 1 << 64)) % (1 << 64)
        lengths[i - 1] += lengths[i]
    keep = np.ones(len(starts), bool)
    keep[touching] = False
    return starts[keep], lengths[keep], sums[keep]


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(start byte of each word, its 64-bit hash) of UTF-8 bytes."""
    a = np.frombuffer(data, np.uint8)
    if len(a) <= BLOCK_BYTES:
        starts, lengths, sums = _word_parts(a)
    else:
        parts = [(s + lo, n, h) for lo in range(0, len(a), BLOCK_BYTES) for s, n, h in [_word_parts(a[lo : lo + BLOCK_BYTES])]]
        starts, lengths, sums = _joined(parts, BLOCK_BYTES)
    return starts, mix64(sums + lengths.astype(np.uint64))


def combine(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` word hashes; the whole run if there are fewer."""
    width = min(width, len(words))
    if width == 0:
        return np.empty(0, np.uint64)
    n = len(words) - width + 1
    out = np.full(n, width, np.uint64)
    for j in range(width):
        out = out * _P + words[j : j + n]
    return mix64(out)


def blocks(texts: list[str | None]) -> Iterator[tuple[int, list[bytes]]]:
    """(index of the first, encoded texts) of runs of about BLOCK_BYTES."""
    first, run, size = 0, [], 0
    for i, t in enumerate(texts):
        data = b"" if t is None else t.encode("utf-8", "surrogatepass")
        if run and size + len(data) > BLOCK_BYTES:
            yield first, run
            first, run, size = i, [], 0
        run.append(data)
        size += len(data) + 1
    if run:
        yield first, run


def word_arrays(texts: list[str | None]) -> Iterator[np.ndarray]:
    """Word hashes of each text, in order."""
    for _, run in blocks(texts):
        starts, hashes = word_hashes(b" ".join(run))
        bounds = np.cumsum([0] + [len(d) + 1 for d in run])
        cuts = np.searchsorted(starts, bounds)
        for i in range(len(run)):
            yield hashes[cuts[i] : cuts[i + 1]]


def shingle_sets(texts: list[str | None], width: int = 5) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    for words in word_arrays(texts):
        grams = combine(words, width)
        grams.sort()
        yield grams[np.r_[True, grams[1:] != grams[:-1]]] if len(grams) > 1 else grams
