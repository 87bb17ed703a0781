"""Sharding by extendible hashing.

A directory is indexed by the leading bits of a 64-bit hash of each row's key.
All rows start in one bucket; a bucket over the byte limit is split on one more bit
until every bucket fits.  So a row's shard is the shortest prefix of its hash whose
bucket fits.  Bytes are counted once for all rows at a depth at which most buckets
fit, rolled up to shorter prefixes, and only buckets still too large are counted
again at a greater depth.

A bucket whose rows all have the same hash can't be split by bits: its rows (copies
of one key, or a single row) are cut into runs of at most the limit by a running
sum; a single row over the limit is a shard of its own.

Everything is DataFrame functions.  Edge cases: null keys hash like the text
"null"; null texts have 0 bytes; repeated rows each count; an empty table has no
shards; columns other than those named are left out of the assignment.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: Bits of the hash that a prefix may use.
HASH_BITS = 60
#: Shards of one key's copies that are cut in one task, about.
PART_SHARDS = 256


def key_hash(*columns: str) -> Column:
    """60 bits of an md5 over the columns as text, as a long: the same in any engine."""
    text = F.concat_ws("\u0001", *[F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in columns])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def _prefix(hash_: Column, depth: int | Column) -> Column:
    """The leading ``depth`` bits, as a number."""
    return F.floor(hash_ / F.pow(F.lit(2.0), F.lit(HASH_BITS) - depth)).cast("long") if isinstance(depth, Column) else F.shiftright(hash_, HASH_BITS - depth)


def directory(rows: DataFrame, max_bytes: int) -> DataFrame:
    """The leaves: depth, prefix, bytes, n, largest (row), unsplittable; rows has ``hash`` and ``bytes``."""
    total = rows.agg(F.sum("bytes")).first()[0] or 0
    depth, below, leaves = 0, -1, None
    step = max(4, math.ceil(math.log2(max(total / max_bytes, 1))) + 4)
    left = rows
    while below < HASH_BITS:
        depth = min(HASH_BITS, max(below, 0) + step)
        fine = cut(left.groupBy(_prefix(F.col("hash"), depth).alias("fine")).agg(F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("n"), F.min("hash").alias("lo"), F.max("hash").alias("hi"), F.max("bytes").alias("largest")))
        sums = fine.withColumn("depth", F.explode(F.sequence(F.lit(below + 1), F.lit(depth))))
        sums = sums.groupBy("depth", F.expr(f"shiftright(fine, cast({depth} - depth as int))").alias("prefix")).agg(F.sum("bytes").alias("bytes"), F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.max("largest").alias("largest"))
        sums = sums.withColumn("done", (F.col("bytes") <= max_bytes) | (F.col("lo") == F.col("hi")))
        # a leaf: done, and its parent is not (the level above ``below + 1`` is known to be too large)
        parents = sums.where(~F.col("done")).select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("parent"))
        found = sums.where("done").withColumn("parent", F.shiftright("prefix", 1))
        new = found.where(F.col("depth") == below + 1).unionByName(found.where(F.col("depth") > below + 1).join(parents, ["depth", "parent"], "left_semi"))
        new = new.select("depth", "prefix", "bytes", "n", "largest", (F.col("bytes") > max_bytes).alias("unsplittable"))
        leaves = new if leaves is None else leaves.unionByName(new)
        large = fine.where((F.col("bytes") > max_bytes) & (F.col("lo") != F.col("hi"))).select("fine")
        if depth == HASH_BITS or large.isEmpty():
            break
        left = left.withColumn("fine", _prefix(F.col("hash"), depth)).join(large, "fine", "left_semi").drop("fine")
        below, step = depth, 4
    return leaves


def assign(docs: DataFrame, max_bytes: int, key: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """The key columns, hash, bytes, and shard_id, shard_bytes, depth of every row."""
    hashed = docs.select(*key, key_hash(*key).alias("hash"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("bytes"))
    # a number for each row, kept with it, so that a task that runs again deals copies as before
    rows = cut(hashed.withColumn("nth", F.monotonically_increasing_id()))
    leaves = cut(directory(rows, max_bytes))
    depths = [r[0] for r in leaves.select("depth").distinct().collect()]  # at most HASH_BITS + 1
    probes = F.array(*[F.struct(F.lit(d).cast("int").alias("depth"), _prefix(F.col("hash"), d).alias("prefix")) for d in sorted(depths)]) if depths else F.array().cast("array<struct<depth:int,prefix:bigint>>")
    # every row has exactly one leaf; the leaves' depths, a few, are probed one by one
    placed = rows.select(*rows.columns, F.explode(probes).alias("__p")).select(*rows.columns, "__p.depth", "__p.prefix")
    placed = placed.join(leaves.select("depth", "prefix", F.col("bytes").alias("leaf_bytes"), "largest", "unsplittable"), ["depth", "prefix"])
    bits = F.when(F.col("depth") == 0, "").otherwise(F.lpad(F.bin("prefix"), F.col("depth"), F.lit("0")))
    whole = placed.where(~F.col("unsplittable")).select(*key, "hash", "bytes", F.concat(F.lit("s"), bits).alias("shard_id"), F.col("leaf_bytes").alias("shard_bytes"), "depth")
    # copies of one key: runs whose starts fall into one stretch of (limit - largest row) bytes, so that
    # a run never exceeds the limit; very many copies are dealt to parts of about PART_SHARDS shards first
    parts = F.greatest(F.lit(1), F.floor(F.col("leaf_bytes") / (PART_SHARDS * max_bytes)))
    same = placed.where("unsplittable").withColumn("part", F.pmod(F.xxhash64("nth"), parts).cast("int"))
    group = Window.partitionBy("depth", "prefix", "part")
    before = F.sum("bytes").over(group.orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)) - F.col("bytes")
    runs = same.withColumn("run", F.floor(before / F.greatest(F.lit(1), F.lit(max_bytes) - F.col("largest"))))
    sums = Window.partitionBy("depth", "prefix", "part", "run")
    cut_up = runs.select(*key, "hash", "bytes", F.concat_ws(".", F.concat(F.lit("s"), bits), F.col("part").cast("string"), F.col("run").cast("string")).alias("shard_id"), F.sum("bytes").over(sums).alias("shard_bytes"), "depth")
    return whole.unionByName(cut_up)


def write_shards(docs: DataFrame, assigned: DataFrame, path: str, key: str = "doc_id") -> None:
    """Writes each shard's rows as one folder of Parquet files; key must be unique."""
    docs.join(assigned.select(key, "shard_id"), key).repartition("shard_id").write.partitionBy("shard_id").parquet(path)
