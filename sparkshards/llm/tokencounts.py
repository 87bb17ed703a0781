"""Token counts by section, from one encoding of each whole document.

A document is encoded once as a whole, so tokens may cross section boundaries.
Each token's character span comes from the lengths of its bytes.  An interval join
(a binary search of span ends in the sorted section bounds) finds the sections a
token touches, and a rule allocates it:

* ``majority`` (default): to the section with most of its bytes, the first of equals;
* ``first`` / ``last``: to the section of its first or last byte;
* ``split``: to every section it touches, by its share of bytes (fractions).

Sections may be given as a column array<struct<name, start, end>> of character
spans, in order and without overlap; text outside all of them is named ``""``.
Without that column each line, with its line end, is a section ``line``.

Edge cases: a null or empty text has no section and gives no row; an empty section
gets no token; repeated rows are counted each; other columns are left out.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

RULES = ("majority", "first", "last", "split")


class Encoder:
    """Byte-level BPE by ranks; every token stands for known bytes, so spans follow from ids."""

    def __init__(self, rank_file: str, pattern: str):
        import tiktoken

        with open(rank_file, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.lengths = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, i in ranks.items():
            self.lengths[i] = len(token)

    def token_ends(self, text: str) -> np.ndarray:
        """The byte after each token."""
        return np.cumsum(self.lengths[self.encoding.encode_to_numpy(text, disallowed_special=())])


_made: dict[tuple, Encoder] = {}


def encoder(rank_file: str, pattern: str) -> Encoder:
    key = (rank_file, pattern)
    if key not in _made:
        _made[key] = Encoder(rank_file, pattern)
    return _made[key]


def allocate(ends: np.ndarray, bounds: np.ndarray, rule: str) -> np.ndarray:
    """Tokens of each section; ``bounds`` are the byte ends of adjoining sections."""
    out = np.zeros(len(bounds))
    if not len(ends) or not len(bounds):
        return out
    starts = np.concatenate([[0], ends[:-1]])
    first, last = np.searchsorted(bounds, starts, side="right"), np.searchsorted(bounds, ends, side="left")
    if rule == "first":
        return np.bincount(first, minlength=len(bounds)).astype(float)
    if rule == "last":
        return np.bincount(last, minlength=len(bounds)).astype(float)
    out += np.bincount(first[first == last], minlength=len(bounds))
    for i in np.flatnonzero(first != last):  # few: only tokens that cross a boundary
        cuts = np.concatenate([[starts[i]], bounds[first[i] : last[i]], [ends[i]]])
        share = np.diff(cuts)
        if rule == "split":
            out[first[i] : last[i] + 1] += share / share.sum()
        else:
            out[first[i] + int(share.argmax())] += 1
    return out


def line_sections(data: bytes) -> tuple[list[str], np.ndarray]:
    a = np.flatnonzero(np.frombuffer(data, np.uint8) == 10) + 1
    bounds = a if len(a) and a[-1] == len(data) else np.append(a, len(data))
    return ["line"] * len(bounds), bounds


def given_sections(data: bytes, spans: list[dict]) -> tuple[list[str], np.ndarray]:
    """Adjoining sections that cover the text: the given ones and what lies between."""
    byte_of = np.append(np.flatnonzero((np.frombuffer(data, np.uint8) & 0xC0) != 0x80), len(data))
    n = len(byte_of) - 1
    names, ends, at = [], [], 0
    for s in spans or []:
        lo, hi = max(at, min(s["start"], n)), max(at, min(s["end"], n))
        if lo > at:
            names.append("")
            ends.append(lo)
        names.append(s["name"])
        ends.append(max(lo, hi))
        at = max(lo, hi)
    if at < n:
        names.append("")
        ends.append(n)
    return names, byte_of[np.array(ends, np.int64)]


def count_tokens(docs: DataFrame, rank_file: str, pattern: str, rule: str = "majority", id_col: str = "doc_id", text_col: str = "text", sections_col: str | None = None) -> DataFrame:
    """doc_id, section (from 0), name, char_start, char_end, tokens for each section of each row."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    schema = pa.schema([("doc_id", pa.int64()), ("section", pa.int32()), ("name", pa.string()), ("char_start", pa.int64()), ("char_end", pa.int64()), ("tokens", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(rank_file, pattern)
        for batch in batches:
            held: list[list[np.ndarray]] = [[] for _ in range(5)]
            names: list[str] = []
            ids: list[int | None] = []
            spans = batch.column(2).to_pylist() if sections_col else None
            for i, (doc, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                if not text:
                    continue
                data = text.encode("utf-8", "surrogatepass")
                own, bounds = given_sections(data, spans[i]) if spans else line_sections(data)
                tokens = allocate(encode.token_ends(text), bounds, rule)
                if len(data) == len(text):
                    ends = bounds
                else:
                    ends = np.concatenate([[0], np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)])[bounds]
                names += own
                ids += [doc] * len(own)
                for part, x in zip(held, (np.arange(len(own)), np.concatenate([[0], ends[:-1]]), ends, tokens)):
                    part.append(x)
            section, begin, end, tokens = (np.concatenate(p) if p else np.empty(0) for p in held[:4])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(section.astype(np.int32)), pa.array(names, pa.string()), pa.array(begin.astype(np.int64)), pa.array(end.astype(np.int64)), pa.array(tokens.astype(float))], schema=schema)

    small_batches(docs.sparkSession)
    columns = [F.col(id_col).cast("long"), F.col(text_col).cast("string"), *([F.col(sections_col)] if sections_col else [])]
    return docs.select(*columns).mapInArrow(run, "doc_id long, section int, name string, char_start long, char_end long, tokens double")
