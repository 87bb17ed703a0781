"""Best-fit packing of documents into sequences by large-item matching.

Only lengths matter for packing, and a length is an integer from 1 to the
capacity.  So the driver packs a histogram (at most ``capacity`` counters,
whatever the input), in runs of equal bins:

1. Lengths above a third of the capacity can share a bin with at most one other
   such length.  From the longest on, each is matched with the longest that still
   fits beside it.  For such lengths this greedy matching is optimal.
2. Smaller lengths, from the longest on, go to the tightest gap that holds them;
   a new bin is opened where none does.

A run is (first bin, number of equal bins, contents); a content says which ranks
among the pieces of its length it takes.  A piece's rank comes from a distributed
count by (length, bucket), so no group of pieces is ever gathered; its place is
then one binary search in the table of runs, which has at most ``capacity`` runs
for each of the two steps, each with at most sqrt(2 * capacity) different lengths.

Edge cases: a null or empty text has the end id only; a longer document than the
capacity is cut, its last piece may be shorter; repeated rows are packed as often
as they come; an empty table gives no rows; columns other than id and text are
left out, so none can clash.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, shuffle_partitions, slices, small_batches
from .word_bpe import word_bpe

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """A row for each piece: doc_id, piece, start, length, ids_crc32 (and ids)."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_bpe(tokenizer)
        for batch in slices(batches):
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            rows: list[tuple] = []
            tokens: list[np.ndarray] = []
            for doc, found in zip(ids.to_pylist(), encoder.ids(texts)):
                found = np.append(found, np.uint32(end_id)).astype("<u4")
                for piece, at in enumerate(range(0, len(found), capacity)):
                    own = found[at : at + capacity]
                    rows.append((doc, piece, at, len(own), zlib.crc32(own.tobytes())))
                    if with_ids:
                        tokens.append(own.astype(np.int32))
            columns = list(zip(*rows)) or [()] * 5
            arrays = [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                arrays, names = [*arrays, pa.array(tokens, pa.list_(pa.int32()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(arrays, names)

    small_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(encode, _PIECES + ", ids array<int>" * with_ids)


def plan_runs(counts: dict[int, int], capacity: int) -> np.ndarray:
    """Packs a histogram; rows (length, first rank, last rank + 1, first bin, in a bin, offset).

    Pieces of one length with ranks first..last fill the bins from ``first bin`` on,
    so many in each, one after another from the offset on.
    """
    left = {int(k): int(v) for k, v in counts.items() if v > 0}
    ranks = dict.fromkeys(left, 0)
    by_gap: list[list[tuple]] = [[] for _ in range(capacity + 1)]  # gap -> (first bin, bins, contents)
    bins = 0

    def take(length: int, n: int) -> int:
        at = ranks[length]
        ranks[length] = at + n
        left[length] -= n
        return at

    def split(run: tuple, n: int) -> tuple[tuple, tuple]:
        """The first n bins of a run, and the rest."""
        first, size, held = run
        return (first, n, held), (first + n, size - n, [(w, k, rank + n * k, off) for w, k, rank, off in held])

    large = [x for x in range(capacity, capacity // 3, -1) if x in left]
    for length in large:
        while left[length]:
            mate = next((m for m in range(min(capacity - length, length), capacity // 3, -1) if left.get(m)), 0)
            if mate == length and left[length] == 1:
                mate = next((m for m in range(length - 1, capacity // 3, -1) if left.get(m)), 0)
            if mate == length:
                n = left[length] // 2
                held = [(length, 2, take(length, 2 * n), 0)]
            elif mate:
                n = min(left[length], left[mate])
                held = [(length, 1, take(length, n), 0), (mate, 1, take(mate, n), length)]
            else:
                n = left[length]
                held = [(length, 1, take(length, n), 0)]
            by_gap[capacity - sum(w * k for w, k, _, _ in held)].append((bins, n, held))
            bins += n
    for length in sorted((x for x in left if x <= capacity // 3), reverse=True):
        gap = length
        while left[length]:
            while gap <= capacity and not by_gap[gap]:
                gap += 1
            if gap > capacity:  # none fits: open new ones
                n = -(-left[length] // (capacity // length))
                by_gap[capacity].append((bins, n, []))
                bins += n
                gap = length
                continue
            run, each = by_gap[gap].pop(), gap // length
            full = left[length] // each
            if full:
                if full < run[1]:
                    run, rest = split(run, full)
                    by_gap[gap].append(rest)
            else:
                each = left[length]
                if run[1] > 1:
                    run, rest = split(run, 1)
                    by_gap[gap].append(rest)
            held = [*run[2], (length, each, take(length, each * run[1]), capacity - gap)]
            by_gap[gap - each * length].append((run[0], run[1], held))
    rows = [(w, rank, rank + n * k, first, k, off) for runs in by_gap for first, n, held in runs for w, k, rank, off in held]
    return np.array(sorted(rows), np.int64).reshape(-1, 6)


def pack(pieces: DataFrame, capacity: int = 4096, key: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """``pieces`` (with a ``length``) and for each its ``sequence_id`` and ``offset``.

    ``pieces`` is read twice, so pass something kept (see ``common.cut``).
    """
    spark = pieces.sparkSession
    buckets = 8 * shuffle_partitions(spark)
    bucket = F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")
    marked = pieces.withColumn("__bucket", bucket)
    counted = cut(marked.groupBy("length", "__bucket").agg(F.count(F.lit(1)).alias("__n")))
    # at most `capacity` rows come to the driver
    histogram = {r[0]: r[1] for r in counted.groupBy("length").agg(F.sum("__n")).collect()}
    runs = plan_runs(histogram, capacity)
    shared = spark.sparkContext.broadcast(runs)
    before = Window.partitionBy("length").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    first = counted.select("length", "__bucket", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__first"))
    within = Window.partitionBy("length", "__bucket").orderBy(*key)
    ranked = marked.withColumn("__rank", F.row_number().over(within)).join(first, ["length", "__bucket"]).withColumn("__rank", F.col("__rank") - 1 + F.col("__first"))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = shared.value
        keys = (table[:, 0] << 48) | table[:, 1]  # lengths are small, ranks far below 2**48
        for rows in batches:
            rank = rows["__rank"].to_numpy(np.int64)
            length = rows["length"].to_numpy(np.int64)
            run = table[np.searchsorted(keys, (length << 48) | rank, side="right") - 1]
            nth = rank - run[:, 1]
            yield rows.drop(columns=["__rank"]).assign(sequence_id=run[:, 3] + nth // run[:, 4], offset=run[:, 5] + length * (nth % run[:, 4]))

    columns = [*pieces.columns, "__rank"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields) + ", sequence_id long, offset long"
    return ranked.select(*columns).mapInPandas(place, schema)


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """All documents as pieces with their places; one row a piece."""
    return pack(cut(token_pieces(docs, tokenizer, capacity, end_id)), capacity)
