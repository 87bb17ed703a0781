"""Mixing ordered sources: concatenation, round robin, weighted random mix.

Sources are (frame, order columns) pairs with equal columns.  Results carry ``source``
and the source's own ``rn``; order the concatenation by (source, rn), a round robin by
(rn, source), a random mix by ``draw``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import hash_key
from .order import with_rank
from .sampling import weighted_source
from .transform import quoted

Source = tuple[DataFrame, list[str]] | tuple[DataFrame, list[str], str | None]


def concat(sources: list[Source]) -> DataFrame:
    """All of the first, then all of the second, and so on.  A source may name a column that has its rank already.

    Sources with the same order columns are ranked together, by source and these.
    """
    marked = [df.withColumn("source", F.lit(i).cast("long")) for i, (df, *_) in enumerate(sources)]
    by = sources[0][1]
    kinds = lambda df, by: [(c, df.schema[c].dataType) for c in by]
    alike = all(not any(rank) and kinds(df, own) == kinds(sources[0][0], by) for df, own, *rank in sources)
    if len(sources) > 1 and alike and "source" not in by:
        both = reduce(lambda a, b: a.unionByName(b), marked)
        before = Window.orderBy("__of").rowsBetween(Window.unboundedPreceding, -1)  # one row a source
        counts = both.groupBy(F.col("source").alias("__of")).agg(F.count(F.lit(1)).alias("__n"))
        firsts = counts.select("__of", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__first"))
        ranked = with_rank(both, ["source", *by], "__all").join(F.broadcast(firsts), F.col("source") == F.col("__of"))
        return ranked.withColumn("rn", (F.col("__all") - F.col("__first")).cast("long")).drop("__all", "__of", "__first").select(*[quoted(c) for c in sources[0][0].columns if c not in ("rn", "source")], "rn", "source")
    parts = [with_rank(df, own, "rn", rank=next(iter(rank), None)) for df, (_, own, *rank) in zip(marked, sources)]
    return reduce(lambda a, b: a.unionByName(b), [p.select(*[quoted(c) for c in p.columns if c not in ("rn", "source")], "rn", "source") for p in parts])


def _lengths(sources: list[Source]) -> list[int]:
    """Counted without any rank; one number a source."""
    parts = [df.select(F.lit(i).alias("source")) for i, (df, *_) in enumerate(sources)]
    both = reduce(lambda a, b: a.unionAll(b), parts)
    held = {r["source"]: r["n"] for r in both.groupBy("source").agg(F.count(F.lit(1)).alias("n")).collect()}
    return [held.get(i, 0) for i in range(len(sources))]


def round_robin(sources: list[Source], longest: bool = False) -> DataFrame:
    """Takes turns.  It ends at the first source that is dry at its turn, or with ``longest`` at the last."""
    both = concat(sources)
    if longest:
        return both
    rn, source = min((n, i) for i, n in enumerate(_lengths(sources)))
    return both.where((F.col("rn") < rn) | ((F.col("rn") == rn) & (F.col("source") < source)))


def random_mix(sources: list[Source], weights: list[float] | None = None, seed: int = 0, longest: bool = False) -> DataFrame:
    """Each draw picks a source by weight, and its next row.

    Ends at the first draw from a dry source; with ``longest`` such draws are skipped,
    and the mix ends when all sources with weight are dry.  Draws are a table: the
    k-th draw of a source meets its row k.
    """
    weights = weights or [1.0] * len(sources)
    lengths = _lengths(sources)
    live = [i for i, w in enumerate(weights) if w > 0]
    spark = sources[0][0].sparkSession
    drawn = lambda n: spark.range(n).select(F.col("id").alias("draw"), weighted_source(weights, hash_key(seed, F.col("id"))).cast("long").alias("source"))
    # each draw before the end takes a row, so one more than all rows will do; with ``longest`` it may take more
    n = sum(lengths) + 1
    while longest:
        seen = {r["source"]: r["n"] for r in drawn(n).groupBy("source").agg(F.count(F.lit(1)).alias("n")).collect()}
        if all(seen.get(i, 0) > lengths[i] for i in live):
            break
        n *= 2
    draws = drawn(n)
    # each draw's number among its source's draws, ranked in blocks of draws
    blocks = draws.withColumn("block", F.floor(F.col("draw") / 10_000))
    counts = blocks.groupBy("source", "block").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("source", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    nth = F.row_number().over(Window.partitionBy("source", "block").orderBy("draw"))
    numbered = blocks.withColumn("nth", nth).join(counts, ["source", "block"]).select("draw", "source", (F.col("first") + F.col("nth") - 1).alias("rn"))
    if not longest:
        sizes = F.create_map(*[x for i, m in enumerate(lengths) for x in (F.lit(i).cast("long"), F.lit(m).cast("long"))])
        cut = numbered.where(F.col("rn") >= F.element_at(sizes, F.col("source"))).agg(F.min("draw")).first()[0]
        numbered = numbered.where(F.col("draw") < cut)
    return numbered.join(concat(sources), ["source", "rn"])
