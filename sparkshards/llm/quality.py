"""Quality classifier learned from positive and unlabelled text.

Texts become style features: frequencies of byte classes and of pairs of
neighbouring classes, and how far words, word runs and lines repeat.  A linear
model is fitted by minimising the non-negative unbiased risk

    p * R+(positives) + max(0, R-(unlabelled) - p * R-(positives))

with the logistic loss: trusted positives are rows labelled 1, the unlabelled text
is the rows without a label, and p, the share of good text in it, is estimated by
the share of label 1 among the labelled rows (those with label 0 serve nothing
else).  Where the part that must not be negative falls below zero, its gradient
step is reversed, as the published estimator prescribes.

Fitting uses bounded samples, ``sample_rows`` of each kind at most, drawn by a hash of the
row; of copies of a row as many as their share, and only one of them moves.  So what the
driver holds doesn't grow with the input.  Scoring reads every whole text, a long one in slices.

Edge cases: null texts count as empty; empty texts are scored like any other;
without positives or unlabelled rows the model is constant at the prior.  Ids with
several labels count as positive if any label is 1.  Repeated rows are scored each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import append_by_text, cut, slices, small_batches
from .shingles import BLOCK_BYTES, blocks, combine, word_hashes

_GROUPS = [b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\r\x0b\x0c", b"\n", b".,;:", b"'\"()-", b"!?", b"|"]
_OTHER, _HIGH = len(_GROUPS), len(_GROUPS) + 1
_CLASSES = len(_GROUPS) + 2
_EXTRA = 9
FEATURES = _CLASSES + _CLASSES * _CLASSES + _EXTRA


def _class_table() -> np.ndarray:
    table = np.full(256, _OTHER, np.int32)
    for i, group in enumerate(_GROUPS):
        table[list(group)] = i
    table[128:] = _HIGH
    return table


_TABLE = _class_table()


def _distinct(x: np.ndarray) -> float:
    return len(np.unique(x)) / len(x) if len(x) else 1.0


def _class_counts(data: bytes, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of each class, and pairs of neighbours, of texts that each have a line end after them."""
    n = len(sizes)
    ends = np.cumsum(sizes + 1)
    kind = _TABLE[np.frombuffer(data, np.uint8)]
    owner = np.repeat(np.arange(n, dtype=np.int32), sizes + 1)
    inside = np.ones(len(kind), bool)
    inside[ends - 1] = False
    single = np.bincount((owner * _CLASSES + kind)[inside], minlength=n * _CLASSES).reshape(n, -1)
    pair = (owner[:-1] * _CLASSES + kind[:-1]) * _CLASSES + kind[1:]
    double = np.bincount(pair[inside[:-1] & inside[1:]], minlength=n * _CLASSES * _CLASSES).reshape(n, -1)
    return single, double


def _class_counts_of_long(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The same of one text, in slices that overlap by a byte."""
    single, double = np.zeros((1, _CLASSES), np.int64), np.zeros((1, _CLASSES * _CLASSES), np.int64)
    for lo in range(0, len(data), BLOCK_BYTES):
        part = data[lo : lo + BLOCK_BYTES + 1]
        one, two = _class_counts(part + b"\n", np.array([len(part)]))
        single += one
        double += two
        if len(part) > BLOCK_BYTES:  # the next slice counts this byte
            single[0, _TABLE[part[-1]]] -= 1
    return single, double


def features(texts: list[str | None]) -> np.ndarray:
    """float32 rows of FEATURES numbers."""
    out = np.zeros((len(texts), FEATURES), np.float32)
    for first, run in blocks(texts):
        n, data = len(run), b"\n".join(run) + b"\n"
        sizes = np.array([len(d) for d in run])
        begins = np.cumsum(sizes + 1) - sizes - 1
        single, double = _class_counts(data, sizes) if len(data) <= 2 * BLOCK_BYTES else _class_counts_of_long(run[0])
        rows = out[first : first + n]
        rows[:, :_CLASSES] = np.sqrt(single / np.maximum(sizes, 1)[:, None])
        rows[:, _CLASSES:-_EXTRA] = np.sqrt(double / np.maximum(sizes, 1)[:, None])
        starts, words = word_hashes(data)
        cuts = np.searchsorted(starts, np.append(begins, len(data)))
        for i in range(n):
            own = words[cuts[i] : cuts[i + 1]]
            lines = [x for x in run[i].split(b"\n") if x]
            same = float((own[1:] == own[:-1]).mean()) if len(own) > 1 else 0.0
            rows[i, -_EXTRA:] = (
                _distinct(own), _distinct(combine(own, 2)), _distinct(combine(own, 5)), same,
                min(sizes[i] / max(len(own), 1), 40) / 10, len(set(lines)) / max(len(lines), 1),
                min(len(lines) / max(len(own), 1), 1), np.log1p(len(own)) / 10, float(len(own) == 0),
            )
    return out


@dataclass
class Model:
    center: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float

    def score(self, rows: np.ndarray) -> np.ndarray:
        z = ((rows - self.center) / self.scale).clip(-8, 8) @ self.weights + self.bias
        return _sigmoid(z)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-z.clip(-30, 30)))


def risk_step(w: np.ndarray, positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> tuple[float, np.ndarray]:
    """The part of the risk that must not be negative, and the gradient to follow: reversed where it is."""
    zp, zu = positive @ w, unlabelled @ w
    negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
    grad = (_sigmoid(zu) @ unlabelled) / len(zu) - prior * (_sigmoid(zp) @ positive) / len(zp)
    return float(negative), grad - prior * (_sigmoid(-zp) @ positive) / len(zp) if negative >= 0 else -grad


def fit_nnpu(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = 6000, batch: int = 512, rate: float = 0.05, seed: int = 0) -> Model:
    """Minimises the non-negative risk by Adam on mini-batches, the rate falling to zero."""
    width = positive.shape[1]
    if not len(positive) or not len(unlabelled):
        return Model(np.zeros(width), np.ones(width), np.zeros(width), float(np.log(prior / (1 - prior))))
    center, scale = unlabelled.mean(axis=0), unlabelled.std(axis=0) + 1e-3
    P, U = (np.c_[((x - center) / scale).clip(-8, 8), np.ones(len(x))].astype(np.float32) for x in (positive, unlabelled))
    rng, w = np.random.default_rng(seed), np.zeros(width + 1)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        _, grad = risk_step(w, P[rng.integers(0, len(P), batch)], U[rng.integers(0, len(U), batch)], prior)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        w -= rate * (1 - t / steps) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return Model(center.astype(np.float64), scale.astype(np.float64), w[:-1], float(w[-1]))


def train(docs: DataFrame, labels: DataFrame, learn: Column, sample_rows: int = 20_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """Fits on the rows of both tables for which ``learn`` (over the id) holds."""
    marks = labels.select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("__y")).where(F.col("__id").isNotNull() & F.col("__y").isNotNull())
    marks = marks.groupBy("__id").agg(F.max("__y").alias("__y"))
    rows = docs.where(learn & F.col(id_col).isNotNull()).select(F.col(id_col).alias("__id"), F.xxhash64(id_col, text_col).alias("__h"))
    # ids, hashes and labels only, repeated rows with their number; texts are joined after the draw
    kinds = cut(rows.groupBy("__id", "__h").agg(F.count(F.lit(1)).alias("__n")).join(marks, "__id", "left").select("__id", "__h", "__n", F.coalesce("__y", F.lit(-1)).alias("__y")))
    sizes = {r[0]: r[1] for r in kinds.groupBy("__y").agg(F.sum("__n")).collect()}
    good, bad, free = (sizes.get(k, 0) for k in (1, 0, -1))
    prior = float(np.clip(good / (good + bad), 0.05, 0.95)) if good + bad else 0.5
    picked, place = None, F.pmod("__h", F.lit(1 << 30)) / (1 << 30)
    for y, n in ((1, good), (-1, free)):
        # of n copies of a row the share of n; what is left of it decides by the row's hash
        wanted = F.col("__n") * min(1.0, sample_rows / max(n, 1))
        drawn = kinds.where(F.col("__y") == y).withColumn("__m", (F.floor(wanted) + (place < wanted - F.floor(wanted)).cast("long")).cast("long"))
        drawn = drawn.where("__m > 0").orderBy(F.col("__m") / F.col("__n") < 1, place, "__id", "__h").limit(sample_rows)
        picked = drawn if picked is None else picked.unionByName(drawn)
    picked = F.broadcast(picked)  # at most 2 * sample_rows ids and hashes

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = features(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([r.tobytes() for r in rows], pa.binary())], ["y", "m", "x"])

    small_batches(docs.sparkSession)
    held = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("__id"), F.xxhash64(id_col, text_col).alias("__h"), F.col(text_col).cast("string").alias("__text"))
    # copies of a drawn row meet in the task's own aggregate before they move
    texts = held.join(picked, ["__id", "__h"]).groupBy("__id", "__h").agg(F.first("__y").alias("__y"), F.first("__text").alias("__text"), F.first("__m").alias("__m"))
    got = texts.select("__y", "__text", "__m").mapInArrow(extract, "y int, m long, x binary").toArrow()
    found = sorted(zip(got["y"].to_pylist(), got["x"].to_pylist(), got["m"].to_pylist()))  # the same in every run
    x = {y: np.frombuffer(b"".join(v * min(m, sample_rows) for k, v, m in found if k == y), np.float32).reshape(-1, FEATURES)[:sample_rows] for y in (1, -1)}
    return fit_nnpu(x[1], x[-1], prior)


def score(docs: DataFrame, model: Model, threshold: float = 0.3, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The kept columns (those of ``docs`` but the text, unless named), score and predicted."""
    keep = [c for c in docs.columns if c != text_col] if keep is None else keep
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(texts: list[str | None]) -> list[pa.Array]:
        scores = shared.value.score(features(texts))
        return [pa.array(scores), pa.array((scores >= threshold).astype(np.int32))]

    return append_by_text(docs, text_col, keep, run, "score double, predicted int")
