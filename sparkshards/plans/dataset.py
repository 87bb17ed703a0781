"""ShardDataset: a lazy, immutable chain of stages over shards or frames.

Stages apply in the order written.  Each records how it runs: B built-in expressions,
A Arrow functions, D a scan; ``explain`` lists them with Spark's own plan.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.errors import OnError, ValueProblem
from ..functions.names import KEY, POS, SHARD_ORD, is_meta
from ..operators import batch as _batch
from ..operators import decode as _decode
from ..operators import mix as _mix
from ..operators import order as _order
from ..operators import sampling as _sampling
from ..operators import stats as _stats
from ..operators import transform as _transform
from ..sources import shardlists
from ..sources.opener import Opener
from ..sources.shards import read_shards, write_shards
from ..sources.tario import Selection


#: Most shards whose counts are broadcast (24 bytes each); samples of more are ranked by a sort.
MAX_COUNTS = 500_000


@dataclass(frozen=True)
class ShardDataset:
    df: DataFrame
    order_by: tuple[str, ...] = (SHARD_ORD, POS)
    key: str = KEY
    stages: tuple[tuple[str, str], ...] = ()
    length: int | None = None
    seed: int = 0
    epoch: int = 0
    #: Rows of each shard of whole samples, planned but not run: position and shard then give the rank.
    counts: DataFrame | None = None
    #: A column that has the rank in order.
    rank: str | None = None
    notes: dict[str, Any] = field(default_factory=dict)

    # -- sources ---------------------------------------------------------------

    @classmethod
    def from_shards(
        cls, spark: SparkSession, urls: str | list[str] | DataFrame, *, fields: list[str] | None = None, shardshuffle: bool | int | None = None, resampled: int | None = None,
        rank: int = 0, world_size: int = 1, worker: int = 0, num_workers: int = 1, nodesplit: str = "refuse", select_files: Callable[[str], bool] | None = None,
        rename_files: Callable[[str], str] | None = None, lowercase: bool = True, handler: OnError | str = OnError.RAISE, opener: Opener | None = None, empty_check: bool = False,
        seed: int = 0, epoch: int = 0, limit: int | None = None, **unknown: Any,
    ) -> ShardDataset:
        """Raw samples of a pattern, a list of URLs (verbatim), a shard frame or a YAML mix.

        ``nodesplit``: refuse (several nodes are an error), by_node or none.
        """
        for name in unknown:
            warnings.warn(f"unknown option {name}", stacklevel=2)
        if isinstance(urls, DataFrame):
            shards = urls
        elif isinstance(urls, str):
            shards = shardlists.shardspec(spark, urls)
        else:
            shards = shardlists.verbatim(spark, urls)
        if nodesplit == "refuse":
            shards = shardlists.single_node_only(shards, world_size)
        elif nodesplit == "by_node":
            shards = shardlists.split_by_node(shards, rank, world_size)
        elif nodesplit != "none":
            raise ValueProblem("nodesplit is refuse, by_node or none")
        shards = shardlists.split_by_worker(shards, worker, num_workers)
        if resampled is not None:
            shards = shardlists.resampled(shards, resampled, seed, epoch, worker)
        elif shardshuffle:
            shards = shardlists.shuffled(shards, seed, epoch)
        options = dict(opener=opener, selection=Selection(select_files, rename_files), lowercase=lowercase, policy=handler, limit=limit)
        raw = read_shards(shards, fields=fields, **options)
        # headers only; run when some later stage needs ranks.  They are broadcast, a row a shard
        counts = read_shards(shards, fields=[], **options).groupBy(SHARD_ORD).agg(F.count(F.lit(1)).alias("__n")) if shards.count() <= MAX_COUNTS else None
        out = cls(raw, seed=seed, epoch=epoch, stages=(("read", "D"),), counts=counts)
        return out.non_empty() if empty_check else out

    @classmethod
    def from_frame(cls, df: DataFrame, order_by: list[str], key: str, seed: int = 0) -> ShardDataset:
        return cls(df, tuple(order_by), key, (("frame", "B"),), seed=seed)

    def _next(self, name: str, kind: str, df: DataFrame, order_by: tuple[str, ...] | None = None, rank: str | None = None, whole: bool = False, total: bool = False) -> ShardDataset:
        """``whole``: the stage keeps all rows and their order; ``rank``: a column that has the new rank; ``total``: the number of rows is known still."""
        if not whole and not total:
            df = df.drop(_order.TOTAL)
        kept = dict(counts=self.counts, rank=self.rank if self.rank is None or self.rank in df.columns else None) if whole else dict(counts=None, rank=rank)
        return replace(self, df=df, order_by=self.order_by if order_by is None else order_by, stages=(*self.stages, (name, kind)), length=None, **kept)

    def _ranked(self) -> tuple[DataFrame, str | None]:
        """The frame, and the column that has the rank, if it is known without a sort."""
        if self.rank is not None:
            return self.df, self.rank
        if self.counts is None or not {SHARD_ORD, POS} <= set(self.df.columns):
            return self.df, None
        every = Window.orderBy("__ord")  # one row a shard
        before, all_of = every.rowsBetween(Window.unboundedPreceding, -1), every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        held = self.counts.withColumnRenamed(SHARD_ORD, "__ord")
        firsts = held.select("__ord", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__first"), F.sum("__n").over(all_of).alias(_order.TOTAL))
        found = self.df.join(F.broadcast(firsts), F.col(SHARD_ORD) == F.col("__ord"))
        return found.withColumn(_order.RANK, (F.col("__first") + F.col(POS)).cast("long")).drop("__ord", "__first"), _order.RANK

    def _ordered(self, name: str, kind: str, made: Callable[[DataFrame, str | None], DataFrame], order_by: tuple[str, ...] | None, rank: str | None = None, total: bool = False) -> ShardDataset:
        """The next dataset by an operator over the ranked frame; ``total``: its number of rows is still known, where it was."""
        df, known = self._ranked()
        out = made(df, known)
        out = out.drop(_order.RANK)
        return self._next(name, kind, out, order_by, rank, total=total)

    @property
    def _by(self) -> list[str]:
        return list(self.order_by)

    def compose(self, *functions: Callable[[DataFrame], DataFrame]) -> ShardDataset:
        out = self
        for f in functions:
            out = out._next(getattr(f, "__name__", "stage"), "A", out.df.transform(f))
        return out

    # -- fields ----------------------------------------------------------------

    def project(self, *names: str) -> ShardDataset:
        """Named columns of raw samples."""
        return self._next("project", "B", _transform.project_raw(self.df, list(names)), whole=True)

    def decode(self, image_spec: str | None = None, only: list[str] | None = None, partial: bool = True, handlers: dict | None = None, handler: OnError | str = OnError.RAISE, pre: list | None = None, post: list | None = None) -> ShardDataset:
        """``handler``: what becomes of samples that can't be decoded."""
        made = _decode.decode(self.df, image_spec, only, partial, handlers, handler, self._by, pre, post)
        return self._next("decode", "A", made, whole=OnError(handler) is OnError.RAISE)

    def xdecode(self, *patterns: str, **options: Any) -> ShardDataset:
        """The same; patterns have no effect."""
        return self.decode(**options)

    def select(self, predicate: Any, handler: OnError | str = OnError.RAISE) -> ShardDataset:
        return self._next("select", "B" if isinstance(predicate, (Column, str)) else "A", _transform.select(self.df, predicate, handler, self._by))

    def map(self, f: Callable, schema: str | None = None, handler: OnError | str = OnError.RAISE) -> ShardDataset:
        """``handler``: what becomes of samples for which f fails."""
        return self._next("map", "A", _transform.map_sample(self.df, f, schema, handler, self._by))

    def map_field(self, name: str, f: Callable[[Column], Column]) -> ShardDataset:
        return self._next("map_field", "B", _transform.map_field(self.df, name, f), whole=True)

    def map_dict(self, **fs: Callable[[Column], Column]) -> ShardDataset:
        return self._next("map_dict", "B", _transform.map_dict(self.df, **fs), whole=True)

    def to_tuple(self, *specs: str, missing_is_error: bool = True, handler: OnError | str = OnError.RAISE) -> ShardDataset:
        made = _transform.to_tuple(self.df, *specs, missing_is_error=missing_is_error, keep=self._by, handler=handler if missing_is_error else OnError.RAISE)
        return self._next("to_tuple", "B", made, whole=OnError(handler) is OnError.RAISE)

    def map_tuple(self, *fs: Callable[[Column], Column] | None) -> ShardDataset:
        return self._next("map_tuple", "B", _transform.map_tuple(self.df, *fs), whole=True)

    def extract_keys(self, *patterns: str, **options: bool) -> ShardDataset:
        return self._next("extract_keys", "B", _transform.extract_keys(self.df, *patterns, keep=self._by, **options), whole=True)

    def rename(self, keep: bool = True, handler: OnError | str = OnError.RAISE, **targets: str) -> ShardDataset:
        made = _transform.rename(self.df, keep, handler, self._by, **targets)
        return self._next("rename", "B", made, whole=OnError(handler) is OnError.RAISE)

    def rename_keys(self, **patterns: Any) -> ShardDataset:
        return self._next("rename_keys", "B", _transform.rename_keys(self.df, **patterns))

    def associate(self, lookup: DataFrame, lookup_key: str | None = None) -> ShardDataset:
        return self._next("associate", "B", _transform.associate(self.df, lookup, self.key, lookup_key), whole=True)

    # -- order -----------------------------------------------------------------

    def slice(self, *args: int | None) -> ShardDataset:
        return self._ordered("slice", "B", lambda df, r: _order.slice_args(df, self._by, *args, rank=r, name="__sliced__"), ("__sliced__",), "__sliced__", True)

    def sliced(self, start: int, count: int | None = None, step: int = 1) -> ShardDataset:
        return self._ordered("sliced", "B", lambda df, r: _order.slice_rows(df, self._by, start, count, step, r, "__sliced__"), ("__sliced__",), "__sliced__", True)

    def take(self, n: int) -> ShardDataset:
        return self._ordered("take", "B", lambda df, r: _order.take(df, self._by, n, r, "__sliced__"), ("__sliced__",), "__sliced__", True)

    def rsample(self, p: float, seed: int | None = None) -> ShardDataset:
        return self._next("rsample", "B", _sampling.random_subsample(self.df, p, self.seed if seed is None else seed, self.key))

    def shuffle(self, bufsize: int | None = None, seed: int | None = None, initial: int | None = None) -> ShardDataset:
        """All rows, or with ``bufsize`` only within reach of such a buffer."""
        seed = self.seed if seed is None else seed
        if bufsize is None:
            out = _sampling.shuffle_order(self.df, seed, self.key, self.epoch, name="__shuffled__")
            return self._next("shuffle", "B", out, ("__shuffled__",), "__shuffled__")
        made = lambda df, r: _sampling.shuffle_buffered(df, self._by, bufsize, seed, initial, r).drop("__shuffled__").withColumnRenamed("rn", "__shuffled__")
        return self._ordered("shuffle", "A", made, ("__shuffled__",), "__shuffled__", True)

    def repeat(self, epochs: int | None = None, nbatches: int | None = None, nsamples: int | None = None) -> ShardDataset:
        """So many epochs; with a limit on rows, whichever ends first."""
        limit = min((n for n in (nbatches, nsamples) if n is not None), default=None)
        if limit is None:
            if epochs is None:
                raise ValueProblem("an endless repetition needs a limit")
            return self._next("repeat", "B", _order.repeat(self.df, epochs), ("epoch", *self.order_by))
        out = self.with_epoch(limit)
        return out if epochs is None else out._next("repeat", "B", out.df.where(F.col("epoch") < epochs), ("rn",), "rn")

    def with_epoch(self, n: int, resume: bool = False) -> ShardDataset:
        """n samples; with ``resume`` an epoch goes on where the one before it stopped."""
        return self._ordered("with_epoch", "B", lambda df, r: _order.with_epoch(df, self._by, n, self.epoch * n if resume else 0, r), ("rn",), "rn")

    def resampled(self, n: int, seed: int | None = None) -> ShardDataset:
        return self._ordered("resampled", "B", lambda df, r: _sampling.resample(df, self._by, n, self.seed if seed is None else seed, self.epoch, r), ("draw",), "draw")

    def with_length(self, n: int) -> ShardDataset:
        return replace(self, length=n)

    def __len__(self) -> int:
        if self.length is None:
            raise TypeError("no length is set")
        return self.length

    def non_empty(self, message: str = "no samples") -> ShardDataset:
        return self._next("non_empty", "B", _order.check_not_empty(self.df, message), whole=True)

    def cached(self) -> ShardDataset:
        return self._next("cached", "B", self.df.persist(), whole=True)

    # -- batches, mixes ----------------------------------------------------------

    def listed(self, size: int, partial: bool = True) -> ShardDataset:
        return self._ordered("listed", "B", lambda df, r: _batch.listed(df, self._by, size, partial, r), (_batch.BATCH,), _batch.BATCH)

    def batched(self, size: int, partial: bool = True, collation: Callable | None = None, schema: str | None = None, combine_scalars: bool = True, combine_tensors: bool = True) -> ShardDataset:
        made = lambda df, r: _batch.batched(df, self._by, size, partial, collation, schema, combine_scalars, combine_tensors, r)
        return self._ordered("batched", "A" if collation else "B", made, (_batch.BATCH,), None if collation else _batch.BATCH)

    def unbatched(self, columns: list[str] | None = None) -> ShardDataset:
        return self._next("unbatched", "B", _batch.unbatched(self.df, columns), (_batch.BATCH, "pos"))

    def unlisted(self) -> ShardDataset:
        return self._next("unlisted", "B", _batch.unlisted(self.df))

    def _source(self) -> _mix.Source:
        df, rank = self._ranked()
        df = df.drop(_order.TOTAL)
        return (df.withColumnRenamed(_order.RANK, "__rn__"), self._by, "__rn__") if rank == _order.RANK else (df, self._by, rank)

    @staticmethod
    def concat(*datasets: ShardDataset) -> ShardDataset:
        return datasets[0]._next("concat", "B", _mix.concat([d._source() for d in datasets]), ("source", "rn"))

    @staticmethod
    def round_robin(*datasets: ShardDataset, longest: bool = False) -> ShardDataset:
        return datasets[0]._next("round_robin", "B", _mix.round_robin([d._source() for d in datasets], longest), ("rn", "source"))

    @staticmethod
    def random_mix(*datasets: ShardDataset, weights: list[float] | None = None, longest: bool = False, seed: int = 0) -> ShardDataset:
        return datasets[0]._next("random_mix", "B", _mix.random_mix([d._source() for d in datasets], weights, seed, longest), ("draw",))

    # -- results -----------------------------------------------------------------

    def totals(self) -> DataFrame:
        return _stats.totals(self.df)

    def log_keys(self, path: str, first: int | None = None) -> ShardDataset:
        """Writes position and key of each sample as text, and goes on."""
        ranked = _order.with_rank(self.df, self._by, "__at")
        if first is not None:
            ranked = ranked.where(F.col("__at") < first)
        ranked.select(F.concat_ws("\t", "__at", self.key).alias("value")).write.text(path)
        return self

    def write(self, folder: str, pattern: str = "shard-%06d.tar", max_count: int = 100_000, max_size: int | None = None, **options: Any) -> DataFrame:
        """Encodes typed samples (raw ones are ready) and writes shards; returns their manifest."""
        df, rank = self._ranked()
        df = _order.with_rank(df, self._by, "__at__", rank=rank).drop(*_order.HIDDEN)
        if "fields" not in df.columns:
            names = [c for c in df.columns if not is_meta(c) and c not in self._by and c != self.key]
            df = _decode.encode(df.withColumnRenamed(self.key, KEY) if self.key != KEY else df, names)
        by = ["__at__"]
        if max_size is None:
            placed = df.withColumn("shard", F.floor(F.col("__at__") / max_count).cast("long"))
        else:
            size = F.aggregate(F.map_values("fields"), F.lit(0).cast("long"), lambda a, v: a + F.octet_length(v))
            placed = _batch.shard_by_size(df, by, size, max_size, max_count, rank="__at__")
        return write_shards(placed, folder, pattern, order_by=by, **options)

    def trace(self, label: str = "sample", first: int = 3, every: int | None = None) -> ShardDataset:
        """Prints the first rows in order, or of every so many one, and goes on."""
        shown = _order.slice_rows(self.df, self._by, 0, first, every or 1)
        for row in shown.orderBy(*self._by).toLocalIterator():
            print(f"{label}: {row.asDict()}")
        return self

    def info(self) -> str:
        """The totals of raw samples as JSON."""
        return _stats.report(self.df)

    def ordered(self) -> DataFrame:
        return self.df.orderBy(*self._by)

    def __iter__(self) -> Iterator:
        return self.ordered().toLocalIterator(prefetchPartitions=True)

    def explain(self, mode: str = "formatted") -> str:
        lines = [f"{i}. {name} [{kind}]" for i, (name, kind) in enumerate(self.stages, 1)]
        plan = self.df._jdf.queryExecution().explainString(self.df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString(mode))
        return "\n".join(lines) + "\n\n" + plan
