"""Shard lists: frames (__shard_ord__, url) of what to read, in order."""

from __future__ import annotations

import os
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.errors import EmptyDataset, FormatError, ValueProblem
from ..functions.names import SHARD_ORD, expand_urls, hash_key, hash_mod
from ..operators.order import with_rank
from .shards import shard_frame


def simple(spark: SparkSession, patterns: str | list[str]) -> DataFrame:
    """Patterns expanded, in order; none is an error."""
    urls = [u for u in expand_urls(patterns) if u]
    if not urls:
        raise EmptyDataset("no shards")
    return shard_frame(spark, urls)


def verbatim(spark: SparkSession, urls: list[str]) -> DataFrame:
    return shard_frame(spark, list(urls))


def renumber(shards: DataFrame, order_by: list[str]) -> DataFrame:
    ranked = with_rank(shards, order_by, "__new")
    return ranked.select(F.col("__new").alias(SHARD_ORD), "url")


def shuffled(shards: DataFrame, seed: int, epoch: int = 0) -> DataFrame:
    """Another order in every epoch."""
    return renumber(shards.withColumn("__mix", hash_key(seed, epoch, F.col("url"))), ["__mix", SHARD_ORD])


def resampled(shards: DataFrame, count: int | None, seed: int = 0, epoch: int = 0, worker: int = 0) -> DataFrame:
    """``count`` draws with replacement; without a count the list would have no end."""
    if count is None:
        raise ValueProblem("resampling needs a count")
    n = shards.count()
    if n == 0:
        return shards
    draws = shards.sparkSession.range(count).select(F.col("id").alias("draw"), hash_mod(hash_key(seed, epoch, worker, F.col("id")), n).alias("__at"))
    return with_rank(shards, [SHARD_ORD], "__at").join(draws, "__at").select(F.col("draw").alias(SHARD_ORD), "url")


def split_by_node(shards: DataFrame, rank: int, world_size: int) -> DataFrame:
    """Every world_size-th shard from rank on."""
    if world_size <= 1:
        return shards
    return renumber(with_rank(shards, [SHARD_ORD], "__at").where(F.pmod("__at", F.lit(world_size)) == rank), [SHARD_ORD])


def split_by_worker(shards: DataFrame, worker: int, num_workers: int) -> DataFrame:
    """The same over what a node has; several workers together read each shard once."""
    return split_by_node(shards, worker, num_workers)


def single_node_only(shards: DataFrame, world_size: int) -> DataFrame:
    if world_size > 1:
        raise ValueProblem("several nodes would read the same shards; split them first")
    return shards


@dataclass
class MixSource:
    """A part of a mix: all shards, or ``choose`` without or ``resample`` with replacement."""

    shards: str | list[str]
    name: str = ""
    choose: int | None = None
    resample: int | None = None


@dataclass
class MixSpec:
    sources: list[MixSource] = field(default_factory=list)
    seed: int = 0

    def shards_for_epoch(self, spark: SparkSession, epoch: int = 0) -> DataFrame:
        """The epoch's shards of all sources, in a seeded order."""
        parts = []
        for i, s in enumerate(self.sources):
            own = simple(spark, s.shards)
            if s.choose is not None and s.resample is not None:
                raise FormatError("a source is chosen from or resampled, not both")
            if s.choose is not None:
                own = own.orderBy(hash_key(self.seed, epoch, i, F.col("url")), SHARD_ORD).limit(s.choose)
            if s.resample is not None:
                own = resampled(own, s.resample, self.seed, epoch, i)
            parts.append(own.select(F.lit(i).alias("source"), F.col(SHARD_ORD).alias("at"), "url"))
        if not parts:
            raise EmptyDataset("no sources")
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        mixed = out.withColumn("__mix", hash_key(self.seed, epoch, F.col("source"), F.col("at"), F.col("url")))
        return renumber(mixed, ["__mix", "source", "at"])


def mix_from_yaml(text: str, seed: int = 0) -> MixSpec:
    """prefix, buckets (the first is used) and datasets; ~ and $VAR are expanded."""
    import yaml

    spec = yaml.safe_load(text) or {}
    if not isinstance(spec, dict) or not isinstance(spec.get("datasets"), list):
        raise FormatError("a mix needs datasets")
    expand = lambda x: os.path.expandvars(os.path.expanduser(str(x)))
    prefix = expand(spec.get("prefix") or "")
    sources = []
    for d in spec["datasets"]:
        buckets = d.get("buckets") or spec.get("buckets") or []
        buckets = [buckets] if isinstance(buckets, str) else buckets
        front = prefix + (expand(buckets[0]).rstrip("/") + "/" if buckets else "")
        shards = [d["shards"]] if isinstance(d.get("shards"), str) else d.get("shards") or []
        sources.append(MixSource([front + expand(x) for x in shards], d.get("name") or "", d.get("choose"), d.get("resample")))
    return MixSpec(sources, seed)


def mix_from_yaml_file(path: str, seed: int = 0) -> MixSpec:
    with open(path, encoding="utf-8") as f:
        return mix_from_yaml(f.read(), seed)


def shardspec(spark: SparkSession, spec: str) -> DataFrame:
    """A YAML file's mix, else a pattern."""
    return mix_from_yaml_file(spec).shards_for_epoch(spark) if spec.endswith(".yaml") else simple(spark, spec)


def repeated_sample(spark: SparkSession, columns: dict, length: int) -> DataFrame:
    """One sample, again and again."""
    return spark.range(length).select(F.col("id").alias("__pos__"), *[F.lit(v).alias(k) for k, v in columns.items()])
