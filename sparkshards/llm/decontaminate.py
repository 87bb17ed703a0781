"""Benchmark decontamination: every training passage queries a BM25 index of test items.

The index holds the test items; its impacts are BM25 term weights divided by the
item's score against itself, so a score is the share of an item that a passage
covers.  Each document is cut into overlapping passages, and each passage is a
query: all items that score at least ``threshold`` are retrieved by block-max WAND,
then verified by the overlap of word 3-grams with the item's question (all but its
last sentence) and its answer (the last sentence; the last third of the words if
there is only one).

WAND's bounds are tested for all passages of a batch at once before any cursor
moves: an item whose terms in the passage have too little weight without its
heaviest ones can't reach the threshold, so a passage needs one of some item's
heaviest (essential) terms, and in some block of items its terms' block maxima must
add up to the threshold.  Those are the pivot blocks; only their items are scored, for
many passages at once, and cursors move in passages that have an item at the threshold.

Test items are indexed in blocks of about ``block_bytes`` of text.  Documents are read and
hashed once; a batch of them is run against BLOCKS_A_PASS blocks at a time, which are sent
along if they are all, and else read from files in the shared folder.  Weights and the passages' width come from
statistics of all test items, so blocks bound memory and decide nothing: document
frequencies are counted once on the executors, and a pass takes those of its own terms.

Edge cases: null and wordless texts hold nothing; wordless items match nothing; an item of
one word has no answer, and its question alone must overlap; a
document that repeats an item gives one row for it; repeated rows give a row each;
null ids stay null; empty tables give no rows.
"""

from __future__ import annotations

import itertools
import math
import pickle
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import append_by_text, cut, fresh_dir, slices, small_batches
from .shingles import blocks, combine, word_hashes

#: Words of half a passage, at least; a passage is two neighbouring halves.
HALF_WORDS = 64
#: Items in an index block.
BLOCK_ITEMS = 8
#: Blocks of test items that a pass over the documents holds at once.
BLOCKS_A_PASS = 8
_SLOTS = 1 << 18
# ASCII characters other than letters and digits part words
_BLANK = bytes(32 if i < 128 and not chr(i).isalnum() else i for i in range(256))


def words_of(data: bytes) -> np.ndarray:
    return word_hashes(data.translate(_BLANK))[1]


def item_words(text: str | None) -> np.ndarray:
    return words_of((text or "").lower().encode("utf-8", "surrogatepass"))


def question_and_answer(text: str) -> tuple[str, str]:
    """The last sentence is the answer; of a single sentence the last third of its words."""
    parts = [p for p in re.split(r"(?<=[.?!])\s+", text.strip()) if p]
    if len(parts) > 1:
        return " ".join(parts[:-1]), parts[-1]
    words = text.split()
    cut = max(1, len(words) - len(words) // 3) if len(words) > 1 else len(words)
    return " ".join(words[:cut]), " ".join(words[cut:])


def _grams(text: str) -> np.ndarray:
    return np.unique(combine(words_of(text.lower().encode("utf-8", "surrogatepass")), 3))


@dataclass
class Statistics:
    """Of all test items that have words: how many, their words, those of the longest, and items by term."""

    items: int
    words: int
    longest: int
    frequency: dict[int, int]

    @classmethod
    def of(cls, words: list[np.ndarray]) -> Statistics:
        words = [w for w in words if len(w)]
        frequency = Counter(t for w in words for t in np.unique(w).tolist())
        return cls(len(words), sum(len(w) for w in words), max((len(w) for w in words), default=0), frequency)


@dataclass
class Index:
    """Postings of normalised BM25 impacts, with block maxima."""

    ids: list[int]
    threshold: float
    k1: float = 1.2
    b: float = 0.75
    questions: list[np.ndarray] = field(default_factory=list)
    answers: list[np.ndarray] = field(default_factory=list)
    half: int = HALF_WORDS

    @classmethod
    def build(cls, items: list[tuple[int, str | None]], threshold: float, statistics: Statistics | None = None) -> Index:
        """``statistics``: those of all test items, if these are not all."""
        rows = [(i, t, item_words(t)) for i, t in items]
        rows = [r for r in rows if len(r[2])]
        self = cls([r[0] for r in rows], threshold)
        known = statistics or Statistics.of([w for _, _, w in rows])
        n, frequency, mean = known.items, known.frequency, known.words / max(known.items, 1)
        counts = [Counter(w.tolist()) for _, _, w in rows]
        self.terms = np.array(sorted({t for c in counts for t in c}), np.uint64)
        at = {int(t): i for i, t in enumerate(self.terms)}
        entries: list[tuple[int, int, float]] = []
        essential = np.zeros(len(self.terms), bool)
        for i, c in enumerate(counts):
            size = sum(c.values())
            norm = self.k1 * (1 - self.b + self.b * size / mean)
            weight = {t: math.log(1 + (n - frequency[t] + 0.5) / (frequency[t] + 0.5)) * f * (self.k1 + 1) / (f + norm) for t, f in c.items()}
            total = sum(weight.values())
            light = 0.0
            for t, w in sorted(weight.items(), key=lambda x: x[1]):
                entries.append((at[t], i, w / total))
                light += w / total
                if light >= threshold - 1e-9:  # the lighter ones alone do not reach the threshold
                    essential[at[t]] = True
        for _, text, _ in rows:
            question, answer = question_and_answer(text)
            self.questions.append(_grams(question))
            self.answers.append(_grams(answer))
        entries.sort()
        term, item, impact = (np.array(x) for x in zip(*entries)) if entries else (np.empty(0, int),) * 3
        self.first = np.searchsorted(term, np.arange(len(self.terms) + 1))
        self.item, self.impact, self.essential = item.astype(np.int64), impact.astype(np.float64), essential
        block = self.item // BLOCK_ITEMS
        self.block_max = np.zeros((len(self.terms), len(rows) // BLOCK_ITEMS + 1), np.float32)
        np.maximum.at(self.block_max, (term, block), self.impact.astype(np.float32))
        self.block_max *= np.float32(1 + 1e-5)  # stays a bound in float32
        cells = self.block_max.size
        self.first_in_block = np.searchsorted(term * self.block_max.shape[1] + block, np.arange(cells + 1)).astype(np.int32)
        self.half = max(HALF_WORDS, known.longest)
        self.slots = np.zeros(_SLOTS, bool)  # which low bits terms have
        self.slots[(self.terms & np.uint64(_SLOTS - 1)).astype(np.int64)] = True
        return self

    def term_ids(self, words: np.ndarray) -> np.ndarray:
        """The index's number of each word, -1 for others."""
        out = np.full(len(words), -1, np.int64)
        maybe = np.flatnonzero(self.slots[(words & np.uint64(_SLOTS - 1)).astype(np.int64)])
        if len(maybe):
            at = np.minimum(np.searchsorted(self.terms, words[maybe]), len(self.terms) - 1)
            out[maybe] = np.where(self.terms[at] == words[maybe], at, -1)
        return out

    def search(self, terms: np.ndarray) -> list[tuple[int, float]]:
        """Block-max WAND: all (item, score) of at least the threshold; terms are distinct."""
        cursors = [[int(self.first[t]), int(self.first[t + 1]), int(t)] for t in terms]
        bound = {int(t): float(self.block_max[t].max()) for t in terms}
        found: list[tuple[int, float]] = []
        end, limit = len(self.ids), self.threshold - 1e-9
        where = lambda c: int(self.item[c[0]]) if c[0] < c[1] else end

        def advance(c: list[int], to: int) -> None:
            c[0] += int(np.searchsorted(self.item[c[0] : c[1]], to))

        while cursors:
            cursors = sorted((c for c in cursors if c[0] < c[1]), key=where)
            reached, pivot = 0.0, -1
            for i, c in enumerate(cursors):
                reached += bound[c[2]]
                if reached >= limit:
                    pivot = i
                    break
            if pivot < 0:
                break
            item = where(cursors[pivot])
            while pivot + 1 < len(cursors) and where(cursors[pivot + 1]) == item:
                pivot += 1
            block = item // BLOCK_ITEMS
            if sum(float(self.block_max[c[2], block]) for c in cursors[: pivot + 1]) < limit:
                # nothing in this block up to the next cursor's item
                after = (block + 1) * BLOCK_ITEMS
                if pivot + 1 < len(cursors):
                    after = min(after, where(cursors[pivot + 1]))
                for c in cursors[: pivot + 1]:
                    if where(c) < after:
                        advance(c, max(after, item + 1) if where(c) >= item else after)
            elif where(cursors[0]) == item:
                score = math.fsum(float(self.impact[c[0]]) for c in cursors[: pivot + 1])  # in any order of cursors
                if score >= limit:
                    found.append((item, score))
                for c in cursors[: pivot + 1]:
                    c[0] += 1
            else:
                for c in cursors[:pivot]:
                    if where(c) < item:
                        advance(c, item)
        return found

    def passages(self, words: np.ndarray, cuts: np.ndarray) -> Iterator[tuple[int, int, int, np.ndarray]]:
        """(document, first word, word after the last, distinct terms) of passages that may reach the threshold.

        ``cuts``: where each document's words begin, and the end.
        """
        ids = self.term_ids(words)
        sizes = np.diff(cuts)
        halves = -(-sizes // self.half)
        base = np.concatenate([[0], np.cumsum(halves)])
        total = int(base[-1])
        if not total:
            return
        owner = np.repeat(np.arange(len(sizes)), halves)
        half = np.repeat(base[:-1], sizes) + (np.arange(len(words)) - np.repeat(cuts[:-1], sizes)) // self.half
        known = np.flatnonzero(ids >= 0)
        hot = np.zeros(total, bool)
        hot[half[known[self.essential[ids[known]]]]] = True
        joined = np.zeros(total, bool)  # whether a half and the next are of one document
        joined[:-1] = owner[1:] == owner[:-1]
        alive = hot.copy()
        alive[:-1] |= hot[1:] & joined[:-1]
        alive[1:] |= hot[:-1] & joined[:-1]
        known = known[alive[half[known]]]
        keys = np.unique(half[known] * len(self.terms) + ids[known])
        at, term = keys // len(self.terms), keys % len(self.terms)
        bounds = np.zeros((total, self.block_max.shape[1]), np.float32)
        for lo in range(0, len(at), 1 << 16):
            here = at[lo : lo + (1 << 16)]
            starts = np.flatnonzero(np.concatenate([[True], here[1:] != here[:-1]]))
            bounds[here[starts]] += np.add.reduceat(self.block_max[term[lo : lo + (1 << 16)]], starts, axis=0)
        whole = bounds.copy()
        whole[:-1][joined[:-1]] += bounds[1:][joined[:-1]]
        tail = np.zeros(total, bool)  # a last half stands alone only if its document has no other
        tail[1:] = joined[:-1] & ~joined[1:]
        left = np.flatnonzero((whole.max(axis=1) >= self.threshold - 1e-4) & ~tail)
        first = np.searchsorted(at, np.arange(total + 1))
        blocks_ = self.block_max.shape[1]
        for lo in range(0, len(left), 256):  # pivot blocks of many passages at a time: only their items are scored
            some = left[lo : lo + 256]
            sets = [np.unique(term[first[h] : first[h + 1 + joined[h]]]) for h in some]
            row, block = np.nonzero(whole[some] >= self.threshold - 1e-4)
            sizes_ = np.array([len(x) for x in sets])[row]
            pair = np.repeat(np.arange(len(row)), sizes_)
            cell = np.concatenate([sets[r] for r in row]) * blocks_ + block[pair]
            sizes_ = self.first_in_block[cell + 1] - self.first_in_block[cell]
            ends = np.cumsum(sizes_)
            posting = np.repeat(self.first_in_block[cell] - (ends - sizes_), sizes_) + np.arange(int(ends[-1]) if len(ends) else 0)
            scores = np.bincount(np.repeat(pair, sizes_) * BLOCK_ITEMS + self.item[posting] % BLOCK_ITEMS, weights=self.impact[posting], minlength=len(row) * BLOCK_ITEMS)
            for i in np.unique(row[scores.reshape(-1, BLOCK_ITEMS).max(axis=1, initial=0) >= self.threshold - 1e-6]):
                h = some[i]
                begin = int(cuts[owner[h]]) + (int(h) - int(base[owner[h]])) * self.half
                yield int(owner[h]), begin, min(begin + (1 + int(joined[h])) * self.half, int(cuts[owner[h] + 1])), sets[i]


def _overlap(grams: np.ndarray, passage: np.ndarray) -> float:
    return 1.0 if not len(grams) else float(np.isin(grams, passage).mean())


@dataclass
class Indexes:
    """The indexes of all test items: sent along if one pass holds them, else files in the shared folder, a pass each."""

    held: Broadcast | None
    paths: list[str]

    def passes(self) -> Iterator[list[Index]]:
        if self.held is not None:
            yield self.held.value
        for path in self.paths:
            with _opened(path, "r") as f:
                yield pickle.loads(f.read())


def _opened(path: str, mode: str):
    from pyarrow import fs

    files, name = fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))
    if mode == "r":
        return files.open_input_stream(name, compression=None)
    files.create_dir(name.rsplit("/", 1)[0], recursive=True)
    return files.open_output_stream(name, compression=None)


def _leaks(texts: list[str | None], indexes: Indexes, overlap: float) -> Iterator[tuple[int, int | None, tuple]]:
    """(row, item, figures of its best passage) of the texts of a batch."""
    texts = [t.lower() if t else t for t in texts]
    hashed = []
    for first, run in blocks(texts):
        starts, words = word_hashes(b" ".join(run).translate(_BLANK))
        hashed.append((first, words, np.searchsorted(starts, np.cumsum([0] + [len(d) + 1 for d in run]))))
    for held in indexes.passes():
        for index in held:
            for first, words, cuts in hashed:
                best: dict[tuple[int, int], tuple] = {}
                for doc, begin, stop, terms in index.passages(words, cuts):
                    passage = np.concatenate([combine(words[begin:stop], n) for n in (1, 2, 3)])
                    for item, score in index.search(terms):
                        found = (score, _overlap(index.questions[item], passage), _overlap(index.answers[item], passage), begin - int(cuts[doc]))
                        if min(found[1:3]) >= overlap and found > best.get((doc, item), (0.0,)):
                            best[doc, item] = found
                for (doc, item), found in best.items():
                    yield first + doc, index.ids[item], found


def survey(items: DataFrame) -> tuple[int, int, int, DataFrame]:
    """Items with words, their words, those of the longest, and (term, n): the number of items that hold a term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            of = Statistics.of([item_words(t) for t in batch.column(0).to_pylist()])
            terms = np.fromiter(of.frequency, np.uint64, len(of.frequency)).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([None, *terms.tolist()], pa.int64()), pa.array([of.items, *of.frequency.values()], pa.int64()), pa.array([of.words] + [None] * len(terms), pa.int64()), pa.array([of.longest] + [None] * len(terms), pa.int64())], ["term", "n", "words", "longest"])

    parts = cut(items.select("text").mapInArrow(run, "term long, n long, words long, longest long"))
    n, words, longest = parts.where("term is null").agg(F.sum("n"), F.sum("words"), F.max("longest")).first()
    return n or 0, words or 0, longest or 0, parts.where("term is not null").groupBy("term").agg(F.sum("n").alias("n"))


def passes(items: DataFrame, threshold: float, block_bytes: int, item_col: str, text_col: str) -> Iterator[list[Index]]:
    """The indexes of all test items, as many at a time as a pass holds."""
    items = items.select(F.col(item_col).cast("long").alias("item_id"), F.col(text_col).cast("string").alias("text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, math.ceil(total / block_bytes))
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(parts))
    *sizes, counted = survey(items)
    if parts > BLOCKS_A_PASS:  # one pass alone reads them once
        counted = cut(counted)
    for lo in range(0, parts, BLOCKS_A_PASS):
        held: dict[int, list] = {}
        for r in items.withColumn("b", block).where(F.col("b").between(lo, lo + BLOCKS_A_PASS - 1)).collect():
            held.setdefault(r["b"], []).append((r["item_id"], r["text"]))
        order = lambda r: (r[0] is None, r[0] or 0, r[1] or "")
        terms = np.unique(np.concatenate([np.empty(0, np.uint64), *(item_words(t) for rows in held.values() for _, t in rows)])).view(np.int64)
        wanted = items.sparkSession.createDataFrame(pa.table({"term": terms}))
        got = counted.join(F.broadcast(wanted), "term", "left_semi").toArrow()
        statistics = Statistics(*sizes, dict(zip(got["term"].to_numpy().view(np.uint64).tolist(), got["n"].to_pylist())))
        yield [Index.build(sorted(rows, key=order), threshold, statistics) for rows in held.values()]


def prepare(items: DataFrame, threshold: float, block_bytes: int, item_col: str, text_col: str) -> Indexes:
    """All indexes, for one scan of the documents; the driver holds one pass at a time."""
    spark = items.sparkSession
    found = passes(items, threshold, block_bytes, item_col, text_col)
    first, second = next(found), next(found, None)
    if second is None:
        return Indexes(spark.sparkContext.broadcast(first), [])
    folder, paths = fresh_dir(spark, "test-items"), []
    for held in itertools.chain([first, second], found):
        paths.append(f"{folder}/{len(paths):06d}")
        with _opened(paths[-1], "w") as f:
            f.write(pickle.dumps(held, protocol=pickle.HIGHEST_PROTOCOL))
        first = second = None
    return Indexes(None, paths)


def find_leaks(docs: DataFrame, items: DataFrame, threshold: float = 0.7, overlap: float = 0.5, block_bytes: int = 128 << 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """A row for each document and test item that it holds, with the best passage's figures."""
    indexes = prepare(items, threshold, block_bytes, item_col, item_text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            ids = batch.column(0).to_pylist()
            rows = [(ids[doc], item, *found) for doc, item, found in _leaks(batch.column(1).to_pylist(), indexes, overlap)]
            columns = list(zip(*rows)) or [()] * 6
            types = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["doc_id", "item_id", "score", "question_overlap", "answer_overlap", "first_word"])

    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    return rows.mapInArrow(run, "doc_id long, item_id long, score double, question_overlap double, answer_overlap double, first_word long")


def without_leaks(docs: DataFrame, items: DataFrame, threshold: float = 0.7, overlap: float = 0.5, block_bytes: int = 128 << 10, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, that hold no test item."""
    indexes = prepare(items, threshold, block_bytes, item_col, item_text_col)

    def run(texts: list[str | None]) -> list[pa.Array]:
        holds = np.zeros(len(texts), bool)
        for doc, _, _ in _leaks(texts, indexes, overlap):
            holds[doc] = True
        return [pa.array(holds)]

    names = [f"c{i}" for i in range(len(docs.columns))]
    marked = append_by_text(docs.toDF(*names), names[docs.columns.index(text_col)], names, run, "holds boolean")
    return marked.where("not holds").drop("holds").toDF(*docs.columns)
