"""Explicit order: global ranks, slices, epochs.

Datasets have declared order columns.  A global rank never moves all rows to one
task: rows go to ranges of the order key (bounds from a bounded sample of rows), each
range is ranked alone, and the ranges' row counts, a small table, give the offsets.
Order columns should be unique; rows that tie are ranked in any order, and a key that
fills several ranges is dealt to them by a hash of its rows' other columns.

A rank is made once: what has one already (samples of whole shards, whose position is
known, or the result of another ordered operator) is passed on by the column's name,
``rank``, and is neither sorted nor counted again.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.errors import EmptyDataset, ValueProblem

RN = "rn"
#: A rank, and the number of rows, that a dataset carries for its own use; no fields.
RANK, TOTAL = HIDDEN = ("__rank__", "__total__")


def _range_of(order_by: list[str], bounds: list[tuple]) -> Column:
    """How many bounds are at or before the row's key: a binary search in literal arrays."""
    if not bounds:
        return F.lit(0)
    lists = [F.array(*[F.lit(b[i]) for b in bounds]) for i in range(len(order_by))]

    def before(mid: Column) -> Column:
        test = None
        for c, held in reversed(list(zip(order_by, lists))):
            value = F.get(held, mid)
            less, same = value < F.col(c), value.eqNullSafe(F.col(c))
            less = F.coalesce(less, value.isNull() & F.col(c).isNotNull())
            test = less | same if test is None else less | (same & test)
        return test

    def step(st: Column, _: Column) -> Column:
        mid = F.floor((st["lo"] + st["hi"]) / 2).cast("int")
        return F.when(st["lo"] >= st["hi"], st).when(before(mid), F.struct((mid + 1).alias("lo"), st["hi"].alias("hi"))).otherwise(F.struct(st["lo"].alias("lo"), mid.alias("hi")))

    steps = F.array(*[F.lit(i) for i in range(len(bounds).bit_length() + 1)])
    return F.aggregate(steps, F.struct(F.lit(0).alias("lo"), F.lit(len(bounds)).alias("hi")), step, lambda st: st["lo"])


def _ranges(df: DataFrame, order_by: list[str], ranges: int) -> Column:
    """The number of a row's range; ranges hold about as many rows."""
    # a bounded sample of rows; where it falls only decides how even the ranges are
    mixed = F.xxhash64(F.monotonically_increasing_id(), F.lit(17))
    sample = df.select(*order_by, mixed.alias("__h")).orderBy("__h").limit(16 * ranges).drop("__h").orderBy(*order_by).collect()
    cuts = [tuple(r) for r in sample[16::16]]
    bounds = sorted(set(cuts), key=cuts.index)
    place = _range_of(order_by, bounds)
    hot = {b: cuts.count(b) for b in bounds if cuts.count(b) > 1}
    if not hot:
        return F.lit(1 << 20) * place
    # place 2i + 1 holds what lies between two bounds, 2i a hot key alone, in as many parts as it had bounds
    plain = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.NumericType, T.StringType, T.BinaryType, T.BooleanType, T.DateType, T.TimestampType))]
    salt = F.shiftrightunsigned(F.xxhash64(*[F.col(f"`{c}`") for c in plain]), 44)
    alone, part = F.lit(1), F.lit(0)
    for key, n in hot.items():  # at most `ranges` of them
        same = reduce(lambda x, y: x & y, (F.col(c).eqNullSafe(F.lit(v)) for c, v in zip(order_by, key)))
        alone, part = F.when(same, 0).otherwise(alone), F.when(same, F.floor(salt * n / (1 << 20))).otherwise(part)
    return (F.lit(1 << 20) * (2 * place + alone) + part).cast("long")


def with_rank(df: DataFrame, order_by: list[str], name: str = RN, ranges: int | None = None, rank: str | None = None, total: str | None = None) -> DataFrame:
    """Adds the global position (from 0, BIGINT) by the order columns, nulls first.

    ``rank``: a column that has it already.  ``total``: name of a column for the number of rows.
    """
    if rank is not None:
        out = df.withColumn(name, F.col(rank))
        if total is None or TOTAL in df.columns:
            return out if total is None else out.withColumn(total, F.col(TOTAL))
        return out.crossJoin(F.broadcast(df.agg(F.count(F.lit(1)).alias(total))))  # one row
    spark = df.sparkSession
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = df.withColumn("__range", _ranges(df, order_by, ranges))
    counts = placed.groupBy("__range").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    every = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offsets = counts.select("__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"), *([F.sum("__n").over(every).alias(total)] if total else []))
    within = F.row_number().over(Window.partitionBy("__range").orderBy(*order_by))
    ranked = placed.withColumn("__within", within).join(F.broadcast(offsets), "__range")
    return ranked.withColumn(name, (F.col("__offset") + F.col("__within") - 1).cast("long")).drop("__range", "__within", "__offset")


def kept(df: DataFrame) -> DataFrame:
    """``df`` computed once: in the folder of spark.checkpoint.dir, or where there is none in the executors' memory and disk."""
    if df.sparkSession.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        return df.checkpoint(eager=True)
    return df.persist()


def slice_rows(df: DataFrame, order_by: list[str], start: int = 0, count: int | None = None, step: int = 1, rank: str | None = None, name: str | None = None) -> DataFrame:
    """Skips ``start``, takes every ``step``-th, and ``count`` of those; ``name``: a column for the new position."""
    if step < 1 or start < 0:
        raise ValueProblem("step must be one or more, start zero or more")
    at = F.col("__at") - start
    ranked = with_rank(df, order_by, "__at", rank=rank).where((at >= 0) & (at % step == 0))
    if count is not None:
        ranked = ranked.where(F.floor(at / step) < count)
    if TOTAL in df.columns:
        left = F.greatest(F.ceil((F.col(TOTAL) - start) / step), F.lit(0))
        ranked = ranked.withColumn(TOTAL, (left if count is None else F.least(left, F.lit(count))).cast("long"))
    return (ranked if name is None else ranked.withColumn(name, F.floor(at / step).cast("long"))).drop("__at")


def slice_args(df: DataFrame, order_by: list[str], *args: int | None, rank: str | None = None, name: str | None = None) -> DataFrame:
    """(stop), (start, stop) or (start, stop, step); stop is absolute."""
    s = slice(*args)
    start, step = s.start or 0, s.step or 1
    count = None if s.stop is None else max(0, math.ceil((s.stop - start) / step))
    return slice_rows(df, order_by, start, count, step, rank, name)


def take(df: DataFrame, order_by: list[str], n: int, rank: str | None = None, name: str | None = None) -> DataFrame:
    """The first n rows in order."""
    return slice_rows(df, order_by, 0, n, rank=rank, name=name)


def repeat(df: DataFrame, epochs: int) -> DataFrame:
    """Each row once an epoch; order by ``epoch`` before the other order columns."""
    return df.withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(epochs - 1).cast("long")))) if epochs > 0 else df.withColumn("epoch", F.lit(0).cast("long")).limit(0)


def with_epoch(df: DataFrame, order_by: list[str], n: int, offset: int = 0, rank: str | None = None) -> DataFrame:
    """Exactly n rows, going round as often as needed from ``offset`` on; empty stays empty.

    Adds ``epoch`` and ``rn``, the position in the result.
    """
    ranked = with_rank(df, order_by, "__at", rank=rank, total="__size")
    skipped = F.lit(offset).cast("long") % F.col("__size")
    rounds = F.greatest(F.lit(1).cast("long"), F.ceil((F.lit(n) + skipped) / F.col("__size")))
    out = ranked.withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), rounds - 1)))
    out = out.withColumn(RN, (F.col("epoch") * F.col("__size") + F.col("__at") - skipped).cast("long"))
    return out.where((F.col(RN) >= 0) & (F.col(RN) < n)).drop("__at", "__size")


def check_not_empty(df: DataFrame, message: str = "no samples") -> DataFrame:
    if df.isEmpty():
        raise EmptyDataset(message)
    return df
