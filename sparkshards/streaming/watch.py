"""Shards that arrive in a folder, as a stream.

A watched folder is a Structured Streaming source of paths; each micro-batch scans its
new archives with the batch reader.  The checkpoint remembers what was read, so a shard
is taken once even if a query starts again, which stands in for claim files.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.names import SHARD_ORD
from ..operators.order import with_rank
from ..sources.opener import Opener
from ..sources.shards import read_shards


def watch(spark: SparkSession, folder: str, pattern: str = "*.tar*", newest_first: bool = False, files_per_batch: int | None = None, done: str = "keep", done_folder: str | None = None) -> DataFrame:
    """A streaming frame (url, arrived).  ``done``: keep (moved to done_folder if given), unlink, or resample (left where it is)."""
    reader = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", pattern).option("latestFirst", str(newest_first).lower())
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    if done == "unlink":
        reader = reader.option("cleanSource", "delete")
    elif done == "keep" and done_folder:
        reader = reader.option("cleanSource", "archive").option("sourceArchiveDir", done_folder)
    # the content column is never read
    return reader.load(folder).select(F.col("path").alias("url"), F.col("modificationTime").alias("arrived"))


def for_each_batch(paths: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, poll: str | None = None, opener: Opener | None = None) -> StreamingQuery:
    """Calls ``handle(raw samples, batch)`` for new shards; without ``poll`` it ends when all there is was read."""

    def run(batch: DataFrame, number: int) -> None:
        ranked = with_rank(batch, ["arrived", "url"], SHARD_ORD).select(SHARD_ORD, "url")
        handle(read_shards(ranked, opener), number)

    writer = paths.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=poll) if poll else writer.trigger(availableNow=True)).start()
