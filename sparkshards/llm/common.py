"""Helpers shared by the operators of this package."""

from __future__ import annotations

import itertools
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only where that is unset (tests, one machine) a temporary folder is made.
    """
    held = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not held:
        set_by_hand = spark.sparkContext._jsc.sc().getCheckpointDir()
        held = set_by_hand.get() if set_by_hand.isDefined() else "file://" + tempfile.mkdtemp(prefix="checkpoints-")
    return held.rstrip("/")


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A path of its own, not made yet, inside the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared folder, its lineage cut."""
    spark = df.sparkSession
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fold(column: Column, parts: int) -> Column:
    """crc32 of the value as text, modulo ``parts``; null for null."""
    return F.pmod(F.crc32(column.cast("string").cast("binary")), F.lit(parts)).cast("int")


#: Bytes and rows of an Arrow batch; texts that become Python objects at a time.
ARROW_BYTES, ARROW_ROWS, ROWS = 4 << 20, 4096, 512


def slices(batches: Iterator[pa.RecordBatch], rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    """The batches in parts of few rows, so that only few texts at a time become Python objects."""
    for batch in batches:
        for lo in range(0, batch.num_rows, rows):
            yield batch.slice(lo, rows)


def small_batches(spark: SparkSession) -> None:
    """Bounds the Arrow batches of the session by bytes and rows (lower settings stay).

    Texts are long: Spark's own 10,000 rows or 64 MB a batch, on both sides of every worker,
    would take a good part of an executor.  Results do not depend on it.
    """
    for name, most in (("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES), ("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)):
        held = re.fullmatch(r"(\d+)b?", spark.conf.get(name))
        if not held or not 0 < int(held[1]) <= most:
            spark.conf.set(name, str(most))


def append_by_text(docs: DataFrame, text_col: str, keep: list[str], score: Callable[[list[str | None]], list[pa.Array]], added: str) -> DataFrame:
    """The kept columns and what ``score`` makes of the texts.

    Only texts go to Python and only the new columns come back; all else stays where it is.
    ``added``: names and types of the new columns, as DDL.
    """
    small_batches(docs.sparkSession)
    new = [x.split()[0] for x in added.split(", ")]

    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in columns:
            parts = [pa.StructArray.from_arrays(score(texts.slice(lo, ROWS).to_pylist()), new) for lo in range(0, len(texts), ROWS)]
            yield pa.concat_arrays(parts) if parts else pa.StructArray.from_arrays(score([]), new)

    # as if not deterministic: else a filter over a new column would be pushed through, and the texts scored twice
    scored = F.arrow_udf(run, "struct<" + ", ".join(f"{n}: {t}" for n, t in (x.split() for x in added.split(", "))) + ">").asNondeterministic()
    columns = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)]
    rows = docs.select(*columns, scored(F.col(f"`{text_col}`").cast("string")).alias("new"))
    return rows.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(keep)], *[F.col("new")[n].alias(n) for n in new])


def free_name(taken: Iterable[str], stem: str) -> str:
    """``stem``, or with a number after it, so that it clashes with nothing."""
    low = {x.lower() for x in taken}
    return next(n for n in itertools.chain([stem], (f"{stem}_{i}" for i in itertools.count(2))) if n.lower() not in low)
