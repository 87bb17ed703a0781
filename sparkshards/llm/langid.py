"""Language identification: multinomial naive Bayes over hashed character n-grams.

Text is lower-cased, every other character than a letter becomes a blank, and
runs of blanks become one.  N-grams of one to three characters are hashed to
``2 ** bits`` buckets.  Training counts buckets by language on the executors; the
smoothed log-probability matrix (languages x buckets, so bounded by the number of
languages) is broadcast, and a batch is scored by gathering rows of that matrix
at the n-grams that occur and adding them up by document.

The training sample is bounded: at most about ``per_language`` rows of a language,
chosen by a hash of the row.  Scoring reads every whole text.

The posterior saturates on any text, so it does not tell junk.  With a ``margin``, a text
is ``und`` too if the mean log-probability of its n-grams in the predicted language is
lower by more than that than the mean of the rows that the language was learned from.

Edge cases: a null text, or one without letters, is ``und`` with score 0; so is
everything if there is nothing to learn from.  A long text is worked through in slices, with
the same n-grams as in one piece.  Null languages and null ids are
never learned from.  Repeated rows are scored each; an empty table gives no rows.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import append_by_text, slices, small_batches

UNKNOWN = "und"
#: Characters handled at a time; a longer text is worked through in slices.
BLOCK = 1 << 17

_letters: np.ndarray | None = None


def _letter_table() -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.fromiter((unicodedata.category(chr(i))[0] == "L" for i in range(0x110000)), bool, 0x110000)
    return _letters


def _normal(codes: np.ndarray, letter: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which codes stay (letters, and one blank after a run of them, besides those of ``first``), and what they become."""
    keep = letter | np.concatenate([[False], letter[:-1]])
    keep[first] = True
    return keep, np.where(letter, codes, 32)[keep].astype(np.uint32)


def _codes(text: str) -> tuple[np.ndarray, np.ndarray]:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return codes, _letter_table()[np.minimum(codes, 0x10FFFF)]


def _grams(codes: np.ndarray, owner: np.ndarray, known: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and owners of the n-grams within one text that end after the first ``known`` codes."""
    found, owners = [], []
    mixed = np.zeros(len(codes), np.uint32)
    for n in (1, 2, 3):
        m = len(codes) - n + 1
        if m <= 0:
            break
        mixed = (mixed[:m] * np.uint32(0x9E3779B1)) ^ (codes[n - 1 :] + np.uint32(n))
        hashed = mixed * np.uint32(0x85EBCA77)
        hashed ^= hashed >> np.uint32(15)
        hashed *= np.uint32(0xC2B2AE3D)
        own = owner[:m] == owner[n - 1 :]
        own[: max(0, known - n + 1)] = False
        if n == 1:
            own &= codes != 32
        found.append((hashed >> np.uint32(32 - bits))[own].astype(np.int64))
        owners.append(owner[:m][own])
    return (np.concatenate(found), np.concatenate(owners)) if found else (np.empty(0, np.int64),) * 2


def _of_long_text(text: str, bits: int) -> Iterator[np.ndarray]:
    """The buckets of a text, slice by slice; the last two codes go with the next slice."""
    held = np.array([32], np.uint32)
    known = 0
    for lo in range(0, len(text), BLOCK):
        codes, letter = _codes(text[lo : lo + BLOCK])
        # a blank at the front stays only if a letter stands before it
        new = _normal(codes, letter, np.array([0] if held[-1] != 32 else [], np.int64))[1]
        held = np.concatenate([held, new])
        yield _grams(held, np.zeros(len(held), np.int64), known, bits)[0]
        held = held[-2:]
        known = len(held)
    if held[-1] != 32:
        held = np.append(held, np.uint32(32))
        yield _grams(held, np.zeros(len(held), np.int64), known, bits)[0]


def ngram_buckets(texts: list[str | None], bits: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, texts, bucket of each n-gram, its text) by block; texts without letters have none, and a long one comes in several blocks."""
    texts = [(t or "").lower() for t in texts]
    at = 0
    while at < len(texts):
        if len(texts[at]) > BLOCK:
            for bucket in _of_long_text(texts[at], bits):
                yield at, 1, bucket, np.zeros(len(bucket), np.int64)
            at += 1
            continue
        stop, size = at, 0
        while stop < len(texts) and size + len(texts[stop]) <= BLOCK:
            size += len(texts[stop])
            stop += 1
        # a blank before, between and after texts, so that a mark of its own parts them
        codes, letter = _codes("".join(f" {t} " for t in texts[at:stop]))
        sizes = np.array([len(t) + 2 for t in texts[at:stop]])
        keep, codes = _normal(codes, letter, np.cumsum(sizes) - sizes)
        yield at, stop - at, *_grams(codes, np.repeat(np.arange(stop - at), sizes)[keep], 0, bits)
        at = stop


def train(docs: DataFrame, learn: Column, bits: int = 16, per_language: int = 4000, smoothing: float = 0.5, lang_col: str = "lang", text_col: str = "text", id_col: str = "doc_id") -> tuple[list[str], np.ndarray]:
    """(languages, float32 matrix buckets x languages of log-probabilities; last row the log-priors)."""
    rows = docs.where(learn & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    sizes = {r[0]: r[1] for r in rows.groupBy(lang_col).count().collect()}  # as many rows as languages
    langs = sorted(sizes)
    if not langs:
        return [], np.zeros(((1 << bits) + 1, 0), np.float32)
    share = F.create_map(*[F.lit(x) for k in langs for x in (k, min(1.0, per_language / sizes[k]))])
    drawn = F.pmod(F.xxhash64(id_col, text_col), F.lit(1 << 30)) < share[F.col(lang_col)] * (1 << 30)
    at = {k: i for i, k in enumerate(langs)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros((len(langs), 1 << bits), np.int64)
        for batch in slices(batches):
            label = np.array([at[x] for x in batch.column(0).to_pylist()], np.int64)
            for first, n, bucket, owner in ngram_buckets(batch.column(1).to_pylist(), bits):
                np.add.at(totals.reshape(-1), (label[first : first + n][owner] << bits) | bucket, 1)
        lang, bucket = np.nonzero(totals)
        if len(lang):
            yield pa.RecordBatch.from_arrays([pa.array(lang.astype(np.int32)), pa.array(bucket.astype(np.int32)), pa.array(totals[lang, bucket])], ["lang", "bucket", "n"])

    small_batches(docs.sparkSession)
    counted = rows.where(drawn).select(F.col(lang_col), F.col(text_col)).mapInArrow(count, "lang int, bucket int, n long")
    got = counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()  # at most languages x buckets rows
    matrix = np.full((1 << bits, len(langs)), smoothing)
    matrix[got["bucket"].to_numpy(), got["lang"].to_numpy()] += got["n"].to_numpy()
    prior = np.array([sizes[k] for k in langs], float)
    return langs, np.vstack([np.log(matrix / matrix.sum(axis=0)), np.log(prior / prior.sum())]).astype(np.float32)


def score_texts(texts: list[str | None], langs: list[str], matrix: np.ndarray, bits: int, margin: float | None = None) -> tuple[list[str], np.ndarray]:
    """(language, posterior of it) of each text; with ``margin`` also ``und`` if the text fits that language badly."""
    names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
    if not langs or not texts:
        return names, scores
    if margin is not None:  # the learning rows' mean: what smoothing added to every bucket is taken off
        seen = np.exp(matrix[:-1].astype(float))
        seen -= seen.min(axis=0)
        usual = (seen * matrix[:-1]).sum(axis=0) / np.maximum(seen.sum(axis=0), 1e-300)
    logs, grams = np.zeros((len(texts), len(langs))), np.zeros(len(texts), np.int64)
    for first, n, bucket, owner in ngram_buckets(texts, bits):
        grams[first : first + n] += np.bincount(owner, minlength=n)
        for k in range(len(langs)):
            logs[first : first + n, k] += np.bincount(owner, weights=matrix[:-1, k][bucket], minlength=n)
    logs += matrix[-1]
    best, known = logs.argmax(axis=1), np.flatnonzero(grams)
    if margin is not None:
        fit = (logs[known, best[known]] - matrix[-1][best[known]]) / grams[known]
        known = known[fit >= usual[best[known]] - margin]
    posterior = 1 / np.exp(logs - logs.max(axis=1, keepdims=True)).sum(axis=1)
    for i in known:
        names[i] = langs[best[i]]
        scores[i] = posterior[i]
    return names, scores


def identify(docs: DataFrame, langs: list[str], matrix: np.ndarray, bits: int = 16, text_col: str = "text", keep: list[str] | None = None, margin: float | None = None) -> DataFrame:
    """The kept columns (those of ``docs`` but the text, unless named), lang_pred and score."""
    keep = [c for c in docs.columns if c != text_col] if keep is None else keep
    shared = docs.sparkSession.sparkContext.broadcast((langs, np.asfortranarray(matrix)))

    def score(texts: list[str | None]) -> list[pa.Array]:
        names, scores = score_texts(texts, *shared.value, bits, margin)
        return [pa.array(names, pa.string()), pa.array(scores)]

    return append_by_text(docs, text_col, keep, score, "lang_pred string, score double")
