"""Scanning and writing tar shards with Spark.

``read_shards`` turns a shard list (a small frame of URLs with ordinals) into raw
samples.  Only URLs travel to tasks; each task streams its archives and gives Arrow
batches of bounded bytes.  ``TarShardSource`` offers the same as a data source
(``spark.read.format("tarshards")``), one partition a shard.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from ..functions.errors import ERROR, ERROR_TYPE, EmptyDataset, OnError, ShardError, settle
from ..functions.names import KEY, LOCAL_PATH, POS, SHARD_ORD, URL, expand_urls, format_shard_pattern
from ..operators.order import kept
from .opener import Opener, to_local_path
from .tario import Problem, Selection, TarWriter, samples_and_problems

RAW = f"{SHARD_ORD} long, {POS} long, {KEY} string, {URL} string, {LOCAL_PATH} string, fields map<string,binary>, field_order array<string>"
MEMBERS = f"{SHARD_ORD} long, member_ord long, {URL} string, {LOCAL_PATH} string, name string, data binary"
BATCH_BYTES = 8 << 20
#: Most tasks of a scan.
MAX_TASKS = 50_000

_RAW_ARROW = pa.schema([(SHARD_ORD, pa.int64()), (POS, pa.int64()), (KEY, pa.string()), (URL, pa.string()), (LOCAL_PATH, pa.string()), ("fields", pa.map_(pa.string(), pa.binary())), ("field_order", pa.list_(pa.string()))])
_ERROR_ARROW = pa.field(ERROR, pa.struct([("class", pa.string()), ("message", pa.string()), ("field", pa.string())]))


def shard_frame(spark: SparkSession, urls: list[str]) -> DataFrame:
    return spark.createDataFrame(list(enumerate(urls)), f"{SHARD_ORD} long, url string")


def _scan(ordinal: int, url: str, opener: Opener, selection: Selection | None, lowercase: bool, policy: OnError, fields: set[str] | None, limit: int | None) -> Iterator[tuple]:
    """The raw samples of one shard as tuples of _RAW_ARROW, and tuples of its errors unless these are raised.

    An error has the position of the sample that it befell.
    """
    error = lambda at, e: (ordinal, at, None, url, to_local_path(url), [], [], {"class": type(e).__name__, "message": str(e), "field": None})
    try:
        stream = opener.open(url)
    except Exception as e:
        if policy is OnError.RAISE:
            raise
        yield error(0, e)
        return
    with stream:
        pos = 0
        found = samples_and_problems(stream, selection, lowercase)
        while limit is None or pos < limit:
            try:
                x = next(found, None)
            except (ShardError, OSError, EOFError) as e:  # the first bytes are no archive's
                x = Problem(e)
            if x is None:
                return
            if isinstance(x, Problem):
                if policy is OnError.RAISE:
                    raise x.error
                yield error(pos, x.error)
                if policy.stops:
                    return
                continue
            held = x.fields if fields is None else {k: v for k, v in x.fields.items() if k in fields}
            yield ordinal, pos, x.key, url, to_local_path(url), list(held.items()), list(held), None
            pos += 1


def _batches(rows: Iterator[tuple], errors: bool = False) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        if row[7] is not None and not errors:
            continue
        held.append(row)
        size += 200 + sum(len(v) for _, v in row[5])
        if size >= BATCH_BYTES:
            yield _to_batch(held, errors)
            held, size = [], 0
    if held:
        yield _to_batch(held, errors)


def _to_batch(rows: list[tuple], errors: bool) -> pa.RecordBatch:
    schema = _RAW_ARROW.append(_ERROR_ARROW) if errors else _RAW_ARROW
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)


def _settled(made: Callable[[bool], DataFrame], policy: OnError) -> DataFrame:
    """Under a policy that stops or warns, errors come as rows, and the policy is applied to them in the order of all shards."""
    if policy in (OnError.RAISE, OnError.CONTINUE):
        return made(False)
    return settle(made(True), policy, [SHARD_ORD, POS], f"scan errors {uuid.uuid4().hex[:8]}")


def read_shards(shards: DataFrame, opener: Opener | None = None, selection: Selection | None = None, lowercase: bool = True, policy: OnError | str = OnError.RAISE, fields: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """Raw samples of a shard list (__shard_ord__, url).  ``fields`` leaves other fields' bytes behind in the task;
    ``limit`` reads so many samples of each shard at most.

    A policy that stops ends the whole stream at the first error, as a reader of one shard
    after another would: no sample of it or after it is left.
    """
    opener, policy, wanted = opener or Opener(), OnError(policy), set(fields) if fields is not None else None
    n = max(1, min(shards.count(), MAX_TASKS))
    # one shard a task (neighbours together beyond MAX_TASKS), dealt by position, not by hash
    dealt = shards.select(SHARD_ORD, "url").repartitionByRange(n, SHARD_ORD)

    def made(errors: bool) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for ordinal, url in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    yield from _batches(_scan(ordinal, url, opener, selection, lowercase, policy, wanted, limit), errors)

        return dealt.mapInArrow(run, RAW + f", {ERROR} {ERROR_TYPE}" * errors)

    return _settled(made, policy)


def read_content(contents: DataFrame, selection: Selection | None = None, lowercase: bool = True, policy: OnError | str = OnError.RAISE) -> DataFrame:
    """Raw samples of archives that are rows already: (__shard_ord__, url, content)."""
    policy = OnError(policy)

    def made(errors: bool) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for ordinal, url, content in zip(*(c.to_pylist() for c in batch.columns)):
                    yield from _batches(_scan(ordinal, url, Opener(memory={url: content}), selection, lowercase, policy, None, None), errors)

        return contents.select(SHARD_ORD, "url", "content").mapInArrow(run, RAW + f", {ERROR} {ERROR_TYPE}" * errors)

    return _settled(made, policy)


def group_members(found: DataFrame, lowercase: bool = True) -> DataFrame:
    """The columnar twin of the reader's grouping, over rows (shard, member_ord, name, data).

    A sample starts where the basename differs from the one before; of a repeated
    field the first member stays.
    """
    from pyspark.sql import Window

    from ..functions.names import base_of, ext_of

    order = Window.partitionBy(SHARD_ORD).orderBy("member_ord")
    ext = ext_of(F.col("name"))
    rows = found.withColumns({"base": base_of(F.col("name")), "ext": F.lower(ext) if lowercase else ext}).where("base is not null")
    rows = rows.withColumn("new", F.coalesce((F.lag("base").over(order) != F.col("base")).cast("long"), F.lit(1).cast("long")))
    rows = rows.withColumn("group", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    once = rows.groupBy(SHARD_ORD, "group", "base", "ext").agg(F.min(F.struct("member_ord", "data")).alias("m"))
    held = F.array_sort(F.collect_list(F.struct(F.col("m.member_ord").alias("o"), F.col("ext").alias("k"), F.col("m.data").alias("v"))))
    out = once.groupBy(SHARD_ORD, "group", "base").agg(held.alias("h"))
    return out.select(SHARD_ORD, F.col("group").alias(POS), F.col("base").alias(KEY), F.map_from_arrays(F.col("h.k"), F.col("h.v")).alias("fields"), F.col("h.k").alias("field_order"))


# -- writing ---------------------------------------------------------------------


def write_shards(samples: DataFrame, folder: str, pattern: str = "shard-%06d.tar", shard_col: str = "shard", order_by: list[str] | None = None, opener: Opener | None = None, mtime: int = 0, keep_meta: bool = False, start_shard: int = 0, post: Callable[[str], None] | None = None) -> DataFrame:
    """Writes rows (shard, __key__, fields map) as one archive for each shard number.

    Samples go to the task of their shard and are sorted there (spilling if need be), so
    an archive is streamed out, never held.  Each is written under a name of its own and
    then moved, so a repeated task leaves a whole file.  Returns (shard, url, samples,
    payload_bytes), computed once; ``post`` is called on the driver for each url.
    """
    from pyarrow import fs

    order_by = order_by or [KEY]
    target = folder if "://" in folder else "file://" + os.path.abspath(folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = fs.FileSystem.from_uri(target)
        files.create_dir(root, recursive=True)
        done: list[tuple] = []
        now = writer = sink = None
        count = size = 0

        def close() -> None:
            nonlocal writer
            if writer:
                writer.close()
                sink.close()
                files.move(temp, f"{root}/{name}")
                done.append((now, f"{target}/{name}", count, size))
                writer = None

        for batch in batches:
            for shard, key, held in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if shard != now or writer is None:
                    close()
                    now, count, size = shard, 0, 0
                    name = format_shard_pattern(pattern, shard + start_shard)
                    temp = f"{root}/.{name}.{uuid.uuid4().hex}"
                    sink = files.open_output_stream(temp, compression=None)
                    writer = TarWriter(sink, name, mtime, keep_meta)
                size += writer.write(key, dict(held))
                count += 1
        close()
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*done)) or [()] * 4, (pa.int64(), pa.string(), pa.int64(), pa.int64()))], ["shard", "url", "samples", "payload_bytes"])

    rows = samples.select(F.col(shard_col).cast("long").alias("shard"), KEY, "fields", *[c for c in order_by if c != KEY])
    placed = rows.repartition("shard").sortWithinPartitions("shard", *order_by)
    # kept in the shared folder where there is one: a lost executor does not write archives again
    written = kept(placed.select("shard", KEY, "fields").mapInArrow(run, "shard long, url string, samples long, payload_bytes long"))
    written.count()
    if post:
        for row in written.orderBy("shard").toLocalIterator():
            post(row["url"])
    return written


# -- as a data source --------------------------------------------------------------


@dataclass
class _Shard(InputPartition):
    ordinal: int
    url: str


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        urls = expand_urls(options.get("path") or options.get("urls") or "")
        self.urls = [u for u in urls if u]
        if not self.urls:
            raise EmptyDataset("no shards")
        world, rank = int(options.get("world_size", 1)), int(options.get("rank", 0))
        self.parts = [_Shard(i, u) for i, u in enumerate(self.urls) if i % world == rank]
        self.policy = OnError(options.get("handler", OnError.RAISE.value))
        self.fields = set(options["fields"].split(",")) if options.get("fields") else None
        self.limit = int(options["limit"]) if options.get("limit") else None
        flag = lambda name, default: str(options.get(name, default)).lower() == "true"
        self.lowercase = flag("lowercase", "true")
        self.opener = Opener(secure=flag("secure", "false"), allow_pipe=flag("allow_pipe", "false"), rewrite=options.get("rewrite"), cache_dir=options.get("cache_dir"))

    def partitions(self) -> list[InputPartition]:
        return self.parts

    def read(self, partition: _Shard) -> Iterator[pa.RecordBatch]:
        yield from _batches(_scan(partition.ordinal, partition.url, self.opener, None, self.lowercase, self.policy, self.fields, self.limit))


@dataclass
class _Written(WriterCommitMessage):
    temp: str | None
    final: str | None
    samples: int


class _Writer(DataSourceWriter):
    """One archive a task; files take their names when the whole job is done."""

    def __init__(self, options: dict[str, str]):
        self.folder = options["path"]
        self.pattern = options.get("pattern", "part-%06d.tar")

    def write(self, rows) -> _Written:
        from pyarrow import fs
        from pyspark import TaskContext

        files, root = fs.FileSystem.from_uri(self.folder if "://" in self.folder else "file://" + os.path.abspath(self.folder))
        files.create_dir(root, recursive=True)
        name = format_shard_pattern(self.pattern, TaskContext.get().partitionId())
        temp, count = f"{root}/.{name}.{uuid.uuid4().hex}", 0
        with files.open_output_stream(temp, compression=None) as sink:
            writer = TarWriter(sink, name)
            for row in rows:
                writer.write(row[KEY], {k: bytes(v) for k, v in row["fields"].items()})
                count += 1
            writer.close()
        if not count:
            files.delete_file(temp)
            return _Written(None, None, 0)
        return _Written(temp, f"{root}/{name}", count)

    def _files(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.folder if "://" in self.folder else "file://" + os.path.abspath(self.folder))[0]

    def commit(self, messages) -> None:
        for m in messages:
            if m and m.temp:
                self._files().move(m.temp, m.final)

    def abort(self, messages) -> None:
        for m in messages:
            if m and m.temp:
                self._files().delete_file(m.temp)


class TarShardSource(DataSource):
    """Options: path (pattern), fields, limit, handler, lowercase, rank, world_size, secure, allow_pipe, rewrite, cache_dir."""

    @classmethod
    def name(cls) -> str:
        return "tarshards"

    def schema(self) -> str:
        return RAW

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(TarShardSource)
