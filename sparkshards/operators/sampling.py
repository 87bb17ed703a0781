"""Seeded draws and orders.  All are functions of an md5 over seed and key, so they
do not depend on partitioning and any engine can reproduce them."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.errors import ValueProblem
from ..functions.names import hash_key, hash_mod
from .order import with_rank
from .transform import quoted


def random_subsample(df: DataFrame, p: float, seed: int, key: str) -> DataFrame:
    """Keeps a row with probability p (clamped); a seed keeps the same rows every time."""
    p = min(1.0, max(0.0, p))
    if p >= 1:
        return df
    bound = int(p * (1 << 64))
    return df.where(hash_key(seed, F.col(key)) < f"{bound:016x}" + "0" * 16)


def shuffle_order(df: DataFrame, seed: int, key: str, epoch: int = 0, worker: int = 0, name: str = "rn") -> DataFrame:
    """A global shuffle: adds the position in a seeded random order, which differs by epoch and worker."""
    marked = df.withColumn("__mix", hash_key(seed, epoch, worker, F.col(key)))
    return with_rank(marked, ["__mix", key], name).drop("__mix")


def buffered_place(at: Column, bufsize: int, seed: int, initial: int | None = None) -> Column:
    """Where a stream with a buffer would put the row at a position: it moves forward less than ``bufsize`` places."""
    if bufsize < 1:
        raise ValueProblem("bufsize must be one or more")
    spread = initial if initial is not None else bufsize
    return at + hash_mod(hash_key(seed, at), max(1, min(spread, bufsize)))


def shuffle_buffered(df: DataFrame, order_by: list[str], bufsize: int, seed: int, initial: int | None = None, rank: str | None = None) -> DataFrame:
    """A local shuffle as a stream with a buffer would do it; adds ``rn``, the position in it.

    Each row's place is its rank plus a seeded draw below the buffer size.  Rows of one
    place follow by rank, so the position of a row depends on ``bufsize`` rows around it
    alone, and is counted from their numbers.
    """
    spread = max(1, min(initial if initial is not None else bufsize, bufsize))
    ranked = with_rank(df, order_by, "__at", rank=rank, total="__size").withColumn("__place", buffered_place(F.col("__at"), bufsize, seed, initial))

    @F.pandas_udf("long")
    def position(at: pd.Series, place: pd.Series, size: pd.Series) -> pd.Series:
        if not len(at):
            return at
        own, wanted, n = at.to_numpy(), place.to_numpy(), int(size.iloc[0])
        out = np.empty(len(own), np.int64)
        order = np.argsort(own, kind="stable")
        # runs of neighbouring positions share their surroundings
        for run in np.split(order, np.flatnonzero(np.diff(own[order]) > spread) + 1):
            lo, hi = max(0, int(own[run[0]]) - spread), min(n - 1, int(own[run[-1]]) + spread)
            near = np.arange(lo, hi + 1)
            draws = np.fromiter((int(hashlib.md5(b"%d:%d" % (seed, i)).hexdigest()[:8], 16) % spread for i in near.tolist()), np.int64, len(near))
            # all before ``lo`` are placed before these, all after ``hi`` behind them
            out[run] = lo + np.searchsorted(np.sort((near + draws) * (2 * spread) + draws_rank(draws, spread)), wanted[run] * (2 * spread) + draws_rank(wanted[run] - own[run], spread))
        return pd.Series(out)

    return ranked.withColumn("rn", position("__at", "__place", "__size")).drop("__place", "__at", "__size")


def draws_rank(draws: np.ndarray, spread: int) -> np.ndarray:
    """Among rows of one place, the later by position has the smaller draw; so this rises with the position."""
    return spread - draws


def choose(df: DataFrame, n: int, seed: int, key: str) -> DataFrame:
    """n rows without replacement (all, if there are no more), by a bounded top-n."""
    return df.orderBy(hash_key(seed, F.col(key)), F.col(key)).limit(n)


def resample(df: DataFrame, order_by: list[str], n: int, seed: int, epoch: int = 0, rank: str | None = None) -> DataFrame:
    """n draws with replacement; adds ``draw``, from 0."""
    ranked = with_rank(df, order_by, "__at", rank=rank)
    # the number of rows is known when the query runs; of an empty table it is made 1, and no draw meets a row
    size = F.greatest(df.select(F.count(F.lit(1))).scalar(), F.lit(1))
    draws = df.sparkSession.range(n).select(F.col("id").alias("draw"), hash_mod(hash_key(seed, epoch, F.col("id")), size).alias("__at"))
    return draws.join(ranked, "__at").select(*[quoted(c) for c in df.columns], "draw")


def weighted_source(weights: list[float], key: Column) -> Column:
    """The source number that a 32-bit draw falls to."""
    if not weights or min(weights) < 0 or sum(weights) <= 0:
        raise ValueProblem("weights must be zero or more, and not all zero")
    draw, total, seen, out = hash_mod(key, 1 << 32), sum(weights), 0.0, None
    last = max(i for i, w in enumerate(weights) if w > 0)
    for i, w in enumerate(weights[:last]):
        seen += w
        test = draw < int(seen / total * (1 << 32))
        out = F.when(test, i) if out is None else out.when(test, i)
    return (F.lit(last) if out is None else out.otherwise(last)).cast("int")
