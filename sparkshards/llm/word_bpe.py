"""Exact ids of a lower-casing word-end BPE tokenizer file, fast for whole corpora.

The file's own library encodes about 1 MB/s a core.  Words repeat, so each worker
keeps the ids of words it has met, in a bounded table, and looks up a whole batch
at once.  New words of plain Latin text go through a rank-merge encoder over the
same vocabulary, whose end-of-word mark is a zero byte; any word with other
characters goes through the file's own library.  Both give the library's ids,
which the tests hold word by word.
"""

from __future__ import annotations

import json
import re

import numpy as np

#: Most words kept by a worker; the table is emptied beyond it.
CACHE_WORDS = 400_000

# The pre-tokeniser's pattern, on lower-cased text of _PLAIN only.
_PIECE = re.compile(r"'(?:[stmd]|re|ve|ll)|[^\W\d_]+|\d|(?:[^\w\s]|_)+")
_PLAIN = re.compile("[\t\n\r\x20-\x7eÀ-ÖØ-öø-įı-ſ]*")
_END = "</w>"
#: A control character, which plain text never has.
_MARK = "\x01"


def _byte_of_char() -> dict[str, int]:
    """Byte-level BPE writes printable bytes as themselves, the rest from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class WordBpe:
    """ids(texts) -> one uint32 array a text, without special tokens added."""

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        special = {t["id"] for t in spec["added_tokens"]}
        to_byte, ranks = _byte_of_char(), {}
        for token, i in spec["model"]["vocab"].items():
            if i not in special:
                end = token.endswith(_END) and token != _END
                core = token[: -len(_END)] if end else token
                ranks[bytes(to_byte[c] for c in core) + b"\0" * end] = i
        self.ranked = tiktoken.Encoding("words", pat_str=r"[^\x00]+\x00", mergeable_ranks=ranks, special_tokens={})
        self.mark = ranks[_MARK.encode() + b"\0"]
        self.special = [t["content"] for t in spec["added_tokens"]]
        self._clear()

    def _clear(self) -> None:
        self.known: dict[str, int] = {}
        self.start = np.zeros(1 << 16, np.int64)
        self.length = np.zeros(1 << 16, np.int32)
        self.flat = np.zeros(1 << 18, np.uint32)
        self.used = 0

    def _encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, how many each word has); a mark between words shows where one ends."""
        odd = [not _PLAIN.fullmatch(w) or any(s in w for s in self.special) for w in words]
        text = f" {_MARK} ".join("" if o else w for w, o in zip(words, odd)).lower() + f" {_MARK} "
        ids = self.ranked.encode_to_numpy("\0".join(_PIECE.findall(text)) + "\0", disallowed_special=())
        ends = np.flatnonzero(ids == self.mark)
        counts = np.diff(ends, prepend=-1) - 1
        ids = ids[ids != self.mark]
        if any(odd):
            rows = np.split(ids, np.cumsum(counts)[:-1])
            for i in np.flatnonzero(odd):
                rows[i] = np.array(self.whole.encode(words[i], add_special_tokens=False).ids, np.uint32)
                counts[i] = len(rows[i])
            ids = np.concatenate(rows)
        return ids, counts

    def _learn(self, words: list[str]) -> None:
        ids, counts = self._encode_words(words)
        n, ends = len(self.known), np.cumsum(counts)
        while n + len(words) > len(self.start):
            self.start, self.length = np.resize(self.start, 2 * len(self.start)), np.resize(self.length, 2 * len(self.length))
        while self.used + len(ids) > len(self.flat):
            self.flat = np.resize(self.flat, 2 * len(self.flat))
        self.start[n : n + len(words)] = self.used + ends - counts
        self.length[n : n + len(words)] = counts
        self.flat[self.used : self.used + len(ids)] = ids
        self.used += len(ids)
        self.known.update(zip(words, range(n, n + len(words))))

    def _look_up(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, how many each word has)."""
        new = set(words)
        missing = new.difference(self.known)
        if missing:
            if len(self.known) + len(missing) > CACHE_WORDS:
                self._clear()
                missing = new
            self._learn(list(missing))
        at = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        counts = self.length[at].astype(np.int64)
        ends = np.cumsum(counts)
        total = int(ends[-1]) if len(ends) else 0
        return self.flat[np.repeat(self.start[at] - (ends - counts), counts) + np.arange(total)], counts

    def ids(self, texts: list[str | None], words_at_a_time: int = 50_000) -> list[np.ndarray]:
        """Null gives no ids.  Words are split at blanks, tabs and line ends only."""
        out: list[np.ndarray] = []
        run: list[list[str]] = []
        held = 0

        def flush() -> None:
            nonlocal held
            flat, counts = self._look_up([w for ws in run for w in ws])
            ends = np.concatenate([[0], np.cumsum(counts)])
            at = 0
            for ws in run:
                out.append(flat[ends[at] : ends[at + len(ws)]])
                at += len(ws)
            run.clear()
            held = 0

        for text in texts:
            words = [] if not text else text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")
            if len(words) > words_at_a_time:
                flush()
                parts = [self._look_up(words[i : i + words_at_a_time])[0] for i in range(0, len(words), words_at_a_time)]
                out.append(np.concatenate(parts))
                continue
            run.append(words)
            held += len(words)
            if held >= words_at_a_time:
                flush()
        flush()
        return out


_made: dict[str, WordBpe] = {}


def word_bpe(path: str) -> WordBpe:
    """The worker's encoder for a file, built once."""
    if path not in _made:
        _made[path] = WordBpe(path)
    return _made[path]
