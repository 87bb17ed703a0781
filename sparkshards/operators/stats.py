"""Totals of a dataset: samples, bytes, fields, shards, digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import URL


def _sample_bytes() -> Column:
    return F.aggregate(F.map_values("fields"), F.lit(0).cast("long"), lambda a, v: a + F.coalesce(F.octet_length(v), F.lit(0)))


def totals(raw: DataFrame) -> DataFrame:
    """samples, payload_bytes, shards, mean_bytes (whole) of raw samples."""
    out = raw.select(URL, _sample_bytes().alias("b")).agg(F.count(F.lit(1)).alias("samples"), F.coalesce(F.sum("b"), F.lit(0)).alias("payload_bytes"), F.countDistinct(URL).alias("shards"))
    return out.withColumn("mean_bytes", F.when(F.col("samples") > 0, F.expr("payload_bytes div samples")).otherwise(0).cast("long"))


def by_field(raw: DataFrame) -> DataFrame:
    """field, samples, bytes, percent of samples, by name."""
    n = F.lit(raw.count())
    entries = raw.select(F.explode(F.map_entries("fields")).alias("e"))
    out = entries.groupBy(F.col("e.key").alias("field")).agg(F.count(F.lit(1)).alias("samples"), F.sum(F.coalesce(F.octet_length("e.value"), F.lit(0)).cast("long")).alias("bytes"))
    return out.withColumn("percent", F.round(100.0 * F.col("samples") / n, 3)).orderBy("field")


def by_shard(raw: DataFrame) -> DataFrame:
    return raw.groupBy(F.col(URL).alias("url")).agg(F.count(F.lit(1)).alias("samples"), F.sum(_sample_bytes()).alias("bytes")).orderBy("url")


def report(raw: DataFrame) -> str:
    """All totals as one JSON text."""
    fields = by_field(raw).agg(F.array_sort(F.collect_list(F.struct("field", "samples", "bytes", "percent"))).alias("fields"))
    shards = by_shard(raw).agg(F.array_sort(F.collect_list(F.struct("url", "samples"))).alias("shards_list"))
    row = totals(raw).join(fields).join(shards).select(F.to_json(F.struct("samples", "payload_bytes", "shards", "mean_bytes", "fields", "shards_list")).alias("j")).first()
    return row["j"]


def canonical_digest(value: Column, kind: str = "text") -> Column:
    """SHA-256 of the value's canonical bytes."""
    data = value if kind in ("bytes", "tensor") else value.cast("string").cast("binary")
    return F.sha2(F.concat(F.lit(kind + ":").cast("binary"), data), 256)
