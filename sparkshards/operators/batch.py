"""Fixed-size batches in order, collation and its inverse."""

from __future__ import annotations

import bisect
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.errors import ValueProblem
from ..functions.tensors import TENSOR, stack_column
from .order import HIDDEN, kept, with_rank
from .transform import quoted

BATCH = "batch_id"
_NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.BooleanType)


def with_batch(df: DataFrame, order_by: list[str], size: int, rank: str | None = None) -> DataFrame:
    if size < 1:
        raise ValueProblem("batch size must be one or more")
    return with_rank(df, order_by, "__rn", rank=rank).withColumn(BATCH, F.floor(F.col("__rn") / size).cast("long"))


def listed(df: DataFrame, order_by: list[str], size: int, partial: bool = True, rank: str | None = None) -> DataFrame:
    """(batch_id, items): arrays of rows in order; partial=False leaves out a short last one."""
    fields = [quoted(c) for c in df.columns if c not in HIDDEN]
    rows = with_batch(df, order_by, size, rank).select(BATCH, F.struct(F.col("__rn"), F.struct(*fields).alias("row")).alias("item"))
    # by rank alone: rows may hold types without an order
    by_rank = lambda a, b: F.when(a["__rn"] < b["__rn"], -1).otherwise(1)
    out = rows.groupBy(BATCH).agg(F.array_sort(F.collect_list("item"), by_rank).alias("items"))
    out = out.withColumn("items", F.transform("items", lambda x: x["row"]))
    return out if partial else out.where(F.size("items") == size)


def _collated(items: Column, name: str, kind: T.DataType) -> Column:
    values = F.transform(items, lambda x: x[name])
    if isinstance(kind, T.BooleanType):
        return F.transform(values, lambda x: x.cast("bigint"))
    if isinstance(kind, _NUMERIC):
        return values.cast("array<bigint>")
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return values.cast("array<double>")
    if kind == TENSOR:
        return stack_column(values)
    return values


def batched(df: DataFrame, order_by: list[str], size: int, partial: bool = True, collation: Callable[[pd.DataFrame], pd.DataFrame] | None = None, schema: str | None = None, combine_scalars: bool = True, combine_tensors: bool = True, rank: str | None = None) -> DataFrame:
    """One row a batch, a column a field: integers and booleans as BIGINT arrays, floats as DOUBLE
    arrays, equal-shaped tensors stacked, anything else as arrays.  Or by a function over the batch's frame.

    Without ``combine_scalars`` numbers keep their own types, without ``combine_tensors`` tensors stay apart.
    """
    if collation is not None:
        rows = with_batch(df, order_by, size, rank)
        inner = [c for c in ("__rn", BATCH, *HIDDEN) if c in rows.columns]

        def run(frame: pd.DataFrame) -> pd.DataFrame:
            own = frame.sort_values("__rn")
            made = collation(own.drop(columns=inner))
            return made if partial or len(own) == size else made.iloc[:0]

        return rows.groupBy(BATCH).applyInPandas(run, schema)
    out = listed(df, order_by, size, partial, rank)

    def collated(f: T.StructField) -> Column:
        as_is = not combine_tensors if f.dataType == TENSOR else not combine_scalars
        return F.transform("items", lambda x: x[f.name]) if as_is else _collated(F.col("items"), f.name, f.dataType)

    return out.select(BATCH, *[collated(f).alias(f.name) for f in df.schema.fields if f.name not in HIDDEN])


def unbatched(df: DataFrame, columns: list[str] | None = None, keep: tuple[str, ...] = (BATCH,)) -> DataFrame:
    """A row for each place of the array columns, with ``pos``; their lengths must agree, integers stay exact."""
    columns = columns or [f.name for f in df.schema.fields if isinstance(f.dataType, T.ArrayType)]
    if not columns:
        raise ValueProblem("nothing to unbatch")
    sizes = F.array(*[F.size(quoted(c)) for c in columns])
    same = F.when(F.array_max(sizes) != F.array_min(sizes), F.raise_error(F.lit("batched fields differ in length")).cast("boolean")).otherwise(F.lit(True))
    zipped = F.arrays_zip(*[quoted(c).alias(f"c{i}") for i, c in enumerate(columns)])
    rows = df.where(same).select(*keep, F.posexplode(zipped).alias("pos", "item"))
    names = [f.name for f in rows.schema["item"].dataType.fields]
    return rows.select(*keep, F.col("pos").cast("long").alias("pos"), *[F.col("item")[n].alias(c) for n, c in zip(names, columns)])


def unlisted(df: DataFrame, items: str = "items") -> DataFrame:
    """Flattens arrays of rows."""
    return df.select(F.inline(items))


def shard_by_count(df: DataFrame, order_by: list[str], max_count: int, rank: str | None = None) -> DataFrame:
    """The shard number of each row when shards hold max_count rows."""
    return with_batch(df, order_by, max_count, rank).withColumnRenamed(BATCH, "shard").drop("__rn")


def _next_starts(sizes: np.ndarray, max_size: int, max_count: int) -> np.ndarray:
    """For each row: where the next shard would begin if one began here; past the end if these rows do not tell."""
    n, sums = len(sizes), np.concatenate([[0], np.cumsum(sizes)])
    # the first row before which the shard holds max_size; a shard has one row at least
    by_size = np.searchsorted(sums, sums[:n] + max_size, side="left")
    by_size = np.maximum(by_size, np.arange(n) + 1)
    return np.minimum(by_size, np.minimum(np.arange(n) + max_count, n + 1))


def shard_by_size(df: DataFrame, order_by: list[str], size: Column, max_size: int, max_count: int, rank: str | None = None, block: int | None = None) -> DataFrame:
    """Shard numbers when a shard is left once it has max_count rows or max_size bytes.

    A boundary depends on all before it.  Ranks go to blocks, each with the max_count rows
    after it, since a shard that begins in the block ends there.  A block tells for every row
    at which a shard could enter it at which row of a later block the chain of shards leaves
    it; entries with one exit are one row.  The driver follows one such pointer a block, and
    with its entry known each block gives its shards' starts.
    """
    width = max(block or 1 << 18, 4 * max_count)
    ranked = with_rank(df, order_by, "__rn", rank=rank).withColumn("__size", F.greatest(F.coalesce(size.cast("long"), F.lit(0).cast("long")), F.lit(0).cast("long")))
    home = F.floor(F.col("__rn") / width)
    # (rank, size) pairs, two numbers a row; the first rows of a block also go to the block before
    ahead = F.when((F.col("__rn") % width < max_count) & (home > 0), F.array(home, home - 1)).otherwise(F.array(home))
    pairs = kept(ranked.select("__rn", "__size", F.explode(ahead).alias("block")))

    def exits(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("__rn")
        number, begin = int(rows["block"].iloc[0]), int(rows["__rn"].iloc[0])
        own = min(width, len(rows))
        follow = np.minimum(_next_starts(rows["__size"].to_numpy(), max_size, max_count), len(rows))
        at = follow.copy()
        while len(inside := np.flatnonzero(at < own)):  # twice as many shards at a time, until all chains have left
            at[inside] = at[at[inside]]
        entries = at[: min(own, max_count + 1)] + begin
        first = np.flatnonzero(np.concatenate([[True], entries[1:] != entries[:-1]]))
        return pd.DataFrame({"block": number, "entry": first + begin, "exit": entries[first]})

    pointers = pairs.groupBy("block").applyInPandas(exits, "block long, entry long, exit long")
    entered, at, now = [], 0, None
    held: list[tuple[int, int]] = []

    def leave(number: int, at: int) -> int:
        entered.append((number, at))
        i = bisect.bisect_right([e for e, _ in held], at) - 1
        return held[i][1]

    for row in pointers.orderBy("block", "entry").toLocalIterator(prefetchPartitions=True):
        if row["block"] != now and held:
            at = leave(now, at)
            held = []
        now = row["block"]
        held.append((row["entry"], row["exit"]))
    if held:
        leave(now, at)
    entries = df.sparkSession.createDataFrame(entered, "number long, entry long")  # one row a block

    def starts(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("__rn")
        begin, own = int(rows["__rn"].iloc[0]), min(width, len(rows))
        follow = np.minimum(_next_starts(rows["__size"].to_numpy(), max_size, max_count), len(rows))
        out, i = [], int(rows["entry"].iloc[0]) - begin
        while i < own:
            out.append((begin + i, begin + int(follow[i])))
            i = int(follow[i])
        return pd.DataFrame(out, columns=["lo", "hi"])

    found = pairs.join(F.broadcast(entries), F.col("block") == F.col("number")).drop("number").groupBy("block").applyInPandas(starts, "lo long, hi long")
    table = with_rank(found, ["lo"], "shard")
    # a range join: ranks meet the shards of their block of ranks
    blocked = table.select("*", F.explode(F.sequence(F.floor(F.col("lo") / max_count), F.floor((F.col("hi") - 1) / max_count))).alias("__block"))
    placed = ranked.withColumn("__block", F.floor(F.col("__rn") / max_count)).join(blocked, "__block").where("__rn >= lo and __rn < hi")
    return placed.drop("__block", "lo", "hi", "__rn", "__size")
