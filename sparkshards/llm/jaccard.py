"""N-gram Jaccard self-join with adaptive multi-match prefixes, and its components.

A text's set is its distinct word shingles.  Tokens have one global order, from rare
to frequent.  If two sets are similar enough, then for every l their prefixes of
|x| - ceil(t|x|) + l tokens share l tokens.  Each document picks its own l: a longer
prefix costs more index entries, but as many more shared tokens are required before
a pair is verified, so candidates get fewer; the estimate takes the frequencies of
the document's own prefix tokens.  A pair must share min(l, l') prefix tokens.

Steps, each over all documents:

1. One pass gives each row's set size and signature, and a table of hashed token
   counts (fixed size, summed over all rows), which is the frequency order.
2. Rows with equal sets become one node, named by their smallest id.  The others are
   told by a bitmap of repeated signatures and then, exactly, by a join.
3. Index lists of up to SHORT documents give all their pairs; those that share
   enough tokens are verified against the whole sets.
4. Longer lists never give all their pairs.  Each is led by the document that stands
   in most long lists; all others are compared with the leader.  Documents similar
   to it are in its component.  By the triangle inequality of Jaccard distance, a
   document with similarity below 2t - 1 to the leader is similar to none of those.
   What that leaves undecided (the rest among themselves, and those between both
   bounds against the similar ones) is cut in tiles of bounded size, and each tile
   compares its documents by one matrix product and returns a spanning forest.
5. The links' components give every row its class.

Edge cases: rows without words or text have 0 shingles and only themselves; rows
with a null id are in no link, and get their set's class if other rows with the same
set have an id, else null; rows that share an id are one document, linked by any of
its texts (different texts of an id are told apart first, and joined at the end); repeated rows are returned as often as they come; empty tables give none.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.order import with_rank
from .common import cut, slices, small_batches
from .graph import components
from .shingles import shingle_sets

#: Hashed counters of the frequency order, and those in a chunk of it.
COUNTER_BITS, CHUNK = 22, 1 << 16
#: Bits of the filters for signatures and ids; a false hit only costs time.
FILTER_BITS = 24
#: Longest index list whose pairs are all formed.
SHORT = 32
#: A token of this estimated frequency goes to the long lists at once.
HOT = 4000
#: Documents and shingles in a side of a tile, about.
TILE_DOCS, TILE_SHINGLES = 192, 60_000
LEVELS = (1, 2, 3, 4, 6, 8)
#: Cost of a verified candidate in index entries, and accidental matches by token.
VERIFY_COST, ACCIDENTS = 50.0, 0.05


def _as_long(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


# -- step 1 --------------------------------------------------------------------


def survey(docs: DataFrame, width: int) -> DataFrame:
    """Rows with chunk null: id, n, hi, lo; others: a chunk of hashed token counts."""
    mask = np.uint64((1 << COUNTER_BITS) - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << COUNTER_BITS, np.int32)
        names = ["id", "n", "hi", "lo", "chunk", "counts"]
        for batch in slices(batches):
            sizes, signs, held = [], [], []
            for grams in shingle_sets(batch.column(1).to_pylist(), width):
                sizes.append(len(grams))
                signs.append(hashlib.blake2b(grams.tobytes(), digest_size=16).digest())
                held.append((grams & mask).astype(np.int32))
            np.add.at(counts, np.concatenate(held), 1)
            two = np.frombuffer(b"".join(signs), np.int64).reshape(-1, 2)
            none = [None] * len(sizes)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(two[:, 0]), pa.array(two[:, 1]), pa.array(none, pa.int32()), pa.array(none, pa.binary())], names)
        if counts.any():
            parts = [zlib.compress(counts[i : i + CHUNK].tobytes(), 1) for i in range(0, len(counts), CHUNK)]
            none = pa.array([None] * len(parts), pa.int64())
            yield pa.RecordBatch.from_arrays([none, none, none, none, pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.binary())], names)

    return cut(docs.mapInArrow(run, "id long, n long, hi long, lo long, chunk int, counts binary"))


def frequency_ranks(surveyed: DataFrame) -> tuple[np.ndarray, float]:
    """(log-scale rank of each counter as uint8, mean count)."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, None
        for batch in batches:  # sorted by chunk
            for chunk, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if chunk != now:
                    if total is not None:
                        yield pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([zlib.compress(total.tobytes(), 1)])], ["chunk", "counts"])
                    now, total = chunk, np.zeros(CHUNK, np.int64)
                total += np.frombuffer(zlib.decompress(data), np.int32)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([zlib.compress(total.tobytes(), 1)])], ["chunk", "counts"])

    parts = surveyed.where(F.col("chunk").isNotNull()).select("chunk", "counts").repartition("chunk").sortWithinPartitions("chunk")
    ranks, total = np.zeros(1 << COUNTER_BITS, np.uint8), 0
    for row in parts.mapInArrow(add, "chunk int, counts binary").collect():  # a fixed number of chunks
        counts = np.frombuffer(zlib.decompress(row["counts"]), np.int64)
        total += int(counts.sum())
        ranks[row["chunk"] * CHUNK : (row["chunk"] + 1) * CHUNK] = np.minimum(255, np.floor(8 * np.log2(counts + 1.0)))
    return ranks, total / len(ranks)


def bitmap(df: DataFrame, column: str) -> np.ndarray:
    """A bit for each value of FILTER_BITS bits that the column has."""
    bits, low = df.select(F.col(column).alias("b")).distinct(), 16

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, None
        done = lambda: pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([np.packbits(held, bitorder="little").tobytes()])], ["part", "bits"])
        for batch in batches:  # sorted by part
            part, bit = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for p in np.unique(part):
                if p != now:
                    if held is not None:
                        yield done()
                    now, held = int(p), np.zeros(1 << low, bool)
                held[bit[part == p] & ((1 << low) - 1)] = True
        if held is not None:
            yield done()

    parts = bits.select(F.shiftright("b", low).cast("int").alias("part"), "b").repartition("part").sortWithinPartitions("part")
    out = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
    for row in parts.mapInArrow(pack, "part int, bits binary").collect():  # at most 256 parts of 8 kB
        out[row["part"] << (low - 3) : (row["part"] + 1) << (low - 3)] = np.frombuffer(row["bits"], np.uint8)
    return out


def _in_bitmap(bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    return (bits[values >> 3] >> (values & 7).astype(np.uint8)) & 1 == 1


def _id_bits(ids: np.ndarray) -> np.ndarray:
    ids = ids.astype(np.int64).view(np.uint64)
    return ((ids ^ (ids >> np.uint64(FILTER_BITS)) ^ (ids >> np.uint64(2 * FILTER_BITS))) & np.uint64((1 << FILTER_BITS) - 1)).astype(np.int64)


def _id_bits_column(name: str) -> Column:
    """The same as _id_bits."""
    c = F.col(name)
    return c.bitwiseXOR(F.shiftrightunsigned(c, FILTER_BITS)).bitwiseXOR(F.shiftrightunsigned(c, 2 * FILTER_BITS)).bitwiseAND(F.lit((1 << FILTER_BITS) - 1))


# -- step 2 --------------------------------------------------------------------


def choose_level(ranks: np.ndarray, n: int, required: int, mean: float) -> int:
    """The l of least estimated cost; ranks: of the set's tokens in the global order."""
    best, level = None, 1
    noise = mean + 2 * mean**0.5
    for l in LEVELS:
        if l > required:
            break
        size = n - required + l
        frequency = np.maximum(np.exp2(ranks[:size] / 8.0) - 1 - noise, 1.0)
        cost = size + VERIFY_COST * float((frequency - 1 + ACCIDENTS).sum()) / (l * l)
        if best is None or cost < best:
            best, level = cost, l
    return level


def prefixes(docs: DataFrame, width: int, t: Fraction, ranks: np.ndarray, mean: float, repeated: np.ndarray) -> DataFrame:
    """id, n, l, hi, lo, maybe (a signature that may be repeated), and prefix tokens: usual and hot ones."""
    shared = docs.sparkSession.sparkContext.broadcast((ranks, mean, repeated))
    mask, sig_mask = np.uint64((1 << COUNTER_BITS) - 1), (1 << FILTER_BITS) - 1
    hot_rank = lambda mean: 8 * np.log2(HOT + mean + 2 * mean**0.5 + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, mean, repeated = shared.value
        for batch in slices(batches):
            rows: list[tuple] = []
            usual, hot = [], []
            for i, grams in zip(batch.column(0).to_pylist(), shingle_sets(batch.column(1).to_pylist(), width)):
                n = len(grams)
                if i is None or not n:
                    continue
                own = ranks[(grams & mask).astype(np.int64)]
                order = np.argsort(own, kind="stable")  # grams are sorted, so ties go by hash
                required = -(-t.numerator * n // t.denominator)
                level = choose_level(own[order], n, required, mean)
                order = order[: n - required + level]
                tokens, common = grams[order].view(np.int64), own[order] >= hot_rank(mean)
                hi, lo = np.frombuffer(hashlib.blake2b(grams.tobytes(), digest_size=16).digest(), np.int64)
                rows.append((i, n, level, int(hi), int(lo), bool(_in_bitmap(repeated, np.array([lo & sig_mask]))[0])))
                usual.append(tokens[~common])
                hot.append(tokens[common])
            columns = list(zip(*rows)) or [()] * 6
            types = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.bool_())
            arrays = [pa.array(c, x) for c, x in zip(columns, types)] + [pa.array(x, pa.list_(pa.int64())) for x in (usual, hot)]
            yield pa.RecordBatch.from_arrays(arrays, ["id", "n", "l", "hi", "lo", "maybe", "usual", "hot"])

    return docs.mapInArrow(run, "id long, n long, l int, hi long, lo long, maybe boolean, usual array<bigint>, hot array<bigint>")


# -- step 3 --------------------------------------------------------------------


def _pairs_of_lists(token: np.ndarray, doc: np.ndarray, n: np.ndarray, l: np.ndarray, t: Fraction):
    """All pairs of each list (sorted by token): x < y, need; sizes too different are left out."""
    starts = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]])) if len(token) else np.empty(0, np.int64)
    sizes = np.diff(np.append(starts, len(token)))
    left, right = [], []
    for k in np.unique(sizes):
        if k > 1:
            at = starts[sizes == k]
            i, j = np.triu_indices(k, 1)
            left.append((at[:, None] + i).ravel())
            right.append((at[:, None] + j).ravel())
    if not left:
        return (np.empty(0, np.int64),) * 3
    a, b = np.concatenate(left), np.concatenate(right)
    fits = (doc[a] != doc[b]) & (t.denominator * np.minimum(n[a], n[b]) >= t.numerator * np.maximum(n[a], n[b]))
    a, b = a[fits], b[fits]
    return np.minimum(doc[a], doc[b]), np.maximum(doc[a], doc[b]), np.minimum(l[a], l[b]).astype(np.int64)


def lists_to_pairs(entries: DataFrame, t: Fraction) -> DataFrame:
    """Pairs (x, y, need) of short lists; entries (token in x, document in y, need null) of long ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.empty(0, np.int64)] * 4
        long_token = None

        def out(x, y, need) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x), pa.array(y), pa.array(need, pa.int64()) if need is not None else pa.nulls(len(x), pa.int64())], ["x", "y", "need"])

        for batch in batches:
            new = [c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns]
            if long_token is not None:
                more = int(np.searchsorted(new[0] != long_token, True))
                if more:
                    yield out(new[0][:more], new[1][:more], None)
                    new = [c[more:] for c in new]
                if len(new[0]):
                    long_token = None
            rows = [np.concatenate(x) for x in zip(held, new)]
            if not len(rows[0]):
                continue
            starts = np.flatnonzero(np.concatenate([[True], rows[0][1:] != rows[0][:-1]]))
            sizes = np.diff(np.append(starts, len(rows[0])))
            long = np.repeat(sizes > SHORT, sizes)
            last = int(starts[-1])
            if long.any():
                yield out(rows[0][long], rows[1][long], None)
            if long[-1]:
                long_token, held = rows[0][-1], [np.empty(0, np.int64)] * 4
            else:
                held = [c[last:] for c in rows]
                long[last:] = True  # held back
            x, y, need = _pairs_of_lists(*[c[~long] for c in rows], t)
            if len(x):
                yield out(x, y, need)
        x, y, need = _pairs_of_lists(*held, t)
        if len(x):
            yield out(x, y, need)

    placed = entries.select("token", "id", "n", "l").repartition("token").sortWithinPartitions("token", "id")
    return placed.mapInArrow(run, "x long, y long, need long")


def sets_of(docs: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """(id, set): the sorted shingle hashes of the documents with the ids, as bytes."""
    marked = docs.sparkSession.sparkContext.broadcast(bitmap(ids.select(_id_bits_column("id").alias("b")), "b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            ids = batch.column(0).fill_null(0).to_numpy()
            wanted = np.flatnonzero(_in_bitmap(marked.value, _id_bits(ids)) & ~batch.column(0).is_null().to_numpy(zero_copy_only=False))
            texts = batch.column(1).take(pa.array(wanted)).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array(ids[wanted]), pa.array([g.tobytes() for g in shingle_sets(texts, width)], pa.binary())], ["id", "set"])

    return cut(docs.mapInArrow(run, "id long, set binary").join(ids, "id", "left_semi").distinct())


def common_counts(pairs: DataFrame, sets: DataFrame, salts: int) -> DataFrame:
    """pairs (x, y) with inter, nx, ny from their whole sets; x's set is sent to each of ``salts`` parts at most."""
    salt = F.pmod(F.xxhash64("y"), F.lit(salts)).cast("int")
    sided = pairs.select("x", "y").withColumn("salt", salt)
    members = sided.join(sets.withColumnRenamed("id", "y"), "y").select("x", "salt", F.lit(1).alias("role"), "y", "set")
    leaders = sided.select("x", "salt").distinct().join(sets.withColumnRenamed("id", "x"), "x").select("x", "salt", F.lit(0).alias("role"), F.col("x").alias("y"), "set")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, own = None, []
        for batch in batches:
            out: list[tuple] = []
            for x, salt, role, y, data in zip(*(c.to_pylist() for c in batch.columns)):
                tokens = np.frombuffer(data, np.uint64)
                if (x, salt) != now:
                    now, own = (x, salt), []
                if role == 0:
                    own.append(tokens)
                    continue
                for mine in own:
                    small, large = (tokens, mine) if len(tokens) <= len(mine) else (mine, tokens)
                    at = np.searchsorted(large, small)
                    at[at == len(large)] = 0
                    out.append((x, y, int((large[at] == small).sum()) if len(large) else 0, len(mine), len(tokens)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["x", "y", "inter", "nx", "ny"])

    rows = members.unionByName(leaders).repartition("x", "salt").sortWithinPartitions("x", "salt", "role", "y")
    return rows.mapInArrow(run, "x long, y long, inter long, nx long, ny long")


def _similar(t: Fraction) -> Column:
    return F.expr(f"inter * {t.denominator}L >= (nx + ny - inter) * {t.numerator}L")


# -- step 4 --------------------------------------------------------------------


def tile_links(sets: list[np.ndarray], sides: np.ndarray, t: Fraction) -> list[tuple[int, int]]:
    """A spanning forest of the links among documents (side 0), or between sides 1 and 2."""
    sizes = np.array([len(s) for s in sets])
    tokens, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(tokens, kind="stable")
    tokens, owner = tokens[order], owner[order]
    first = np.concatenate([[True], tokens[1:] != tokens[:-1]])
    column = np.cumsum(first) - 1
    shared = np.bincount(column)[column] > 1
    column, owner = column[shared], owner[shared]
    inter = np.zeros((len(sets), len(sets)), np.float32)
    if len(column):
        column = np.unique(column, return_inverse=True)[1]
        for lo in range(0, int(column[-1]) + 1, 8192):  # bounded matrices
            some = (column >= lo) & (column < lo + 8192)
            m = np.zeros((len(sets), 8192), np.float32)
            m[owner[some], column[some] - lo] = 1
            inter += m @ m.T
    union = sizes[:, None] + sizes[None, :] - inter
    linked = (inter * t.denominator >= union * t.numerator) & ((sides[:, None] == 0) | (sides[:, None] != sides[None, :]))
    root = np.arange(len(sets))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = int(root[i])
        return i

    out = []
    for i, j in zip(*np.nonzero(np.triu(linked, 1))):
        a, b = find(int(i)), find(int(j))
        if a != b:
            root[max(a, b)] = min(a, b)
            out.append((int(i), int(j)))
    return out


def long_list_links(entries: DataFrame, sets: DataFrame, t: Fraction) -> DataFrame:
    """Edges that connect all similar documents which share a long list (token, id)."""
    standing = entries.groupBy("id").agg(F.count(F.lit(1)).alias("c"))
    ranked = entries.join(standing, "id")
    leaders = ranked.groupBy("token").agg(F.max(F.struct("c", (-F.col("id")).alias("o"))).alias("m")).select("token", (-F.col("m.o")).alias("x"))
    stars = cut(common_counts(entries.join(leaders, "token").where("id != x").select("x", F.col("id").alias("y")).distinct(), sets, 256))
    two = Fraction(2) * t - 1
    stars = stars.groupBy("x", "y").agg(F.max(_similar(t)).alias("near"), F.max(_similar(two)).alias("mid"), F.max("ny").alias("n"))
    links = stars.where("near").select("x", "y")
    # tiles: the rest against itself, and the middle ones against the near ones
    kinds = stars.select("x", "y", "n", F.when(F.col("near"), "near").otherwise("rest").alias("kind"))
    kinds = kinds.unionByName(stars.where("mid and not near").select("x", "y", "n", F.lit("mid").alias("kind")))
    blocks = kinds.groupBy("x").pivot("kind", ["near", "rest", "mid"]).agg(F.greatest(F.ceil(F.count(F.lit(1)) / TILE_DOCS), F.ceil(F.sum("n") / TILE_SHINGLES)).cast("int"))
    placed = kinds.join(blocks.na.fill(0), "x")
    block = lambda c: F.pmod(F.xxhash64("y"), F.greatest(c, F.lit(1))).cast("int")
    to = lambda c: F.explode(F.sequence(F.lit(0), c - 1))
    rest = placed.where("kind = 'rest' and rest > 0").withColumn("own", block(F.col("rest"))).withColumn("other", to(F.col("rest")))
    rest = rest.select("x", F.lit("r").alias("set_of"), F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "y", F.lit(0).alias("side"))
    near = placed.where("kind = 'near' and mid > 0").withColumn("i", block(F.col("near"))).withColumn("j", to(F.col("mid"))).select("x", F.lit("m").alias("set_of"), "i", "j", "y", F.lit(1).alias("side"))
    mid = placed.where("kind = 'mid' and near > 0").withColumn("j", block(F.col("mid"))).withColumn("i", to(F.col("near"))).select("x", F.lit("m").alias("set_of"), "i", "j", "y", F.lit(2).alias("side"))
    tiles = rest.unionByName(near).unionByName(mid).join(sets.withColumnRenamed("id", "y"), "y")

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        ids = rows["y"].to_numpy()
        found = tile_links([np.frombuffer(x, np.uint64) for x in rows["set"]], rows["side"].to_numpy(), t) if len(rows) > 1 else []
        return pd.DataFrame({"x": [ids[i] for i, _ in found], "y": [ids[j] for _, j in found]}, dtype="int64")

    # a tile holds two blocks, whose size is bounded
    return links.unionByName(tiles.groupBy("x", "set_of", "i", "j").applyInPandas(run, "x long, y long"))


# -- all -----------------------------------------------------------------------


def texts_apart(docs: DataFrame, id_col: str, text_col: str, name: str) -> tuple[DataFrame, DataFrame | None]:
    """``docs`` with a column ``name``, which different texts never share, and (name, id, nth) of ids with several texts.

    The name is the id; of an id with several texts the first by text keeps it, and the
    others get numbers that are no id.  Without such ids there is no second frame.
    """
    number, text = F.col(id_col).cast("long"), F.col(text_col).cast("string")
    sign = F.xxhash64(text)
    found = docs.where(number.isNotNull()).groupBy(number.alias("__of")).agg((F.min(sign) != F.max(sign)).alias("__several")).where("__several").select("__of")
    several = cut(found)
    n = several.count()
    if not n:
        return docs.withColumn(name, number), None
    few = F.broadcast if n < 100_000 else (lambda x: x)
    mark = F.coalesce(F.md5(text), F.lit(""))
    texts = docs.select(number.alias("__of"), mark.alias("__mark"), text.alias("__text")).join(few(several), "__of", "left_semi")
    nth = F.row_number().over(Window.partitionBy("__of").orderBy("__text"))
    kinds = texts.groupBy("__of", "__mark").agg(F.min("__text").alias("__text")).select("__of", "__mark", nth.cast("long").alias("__nth"))
    kinds = cut(kinds)
    low, high = docs.agg(F.min(number), F.max(number)).first()
    more = kinds.where("__nth > 1")
    count = more.count()
    base = high + 1 if high + count < (1 << 63) else low - count
    named = with_rank(more, ["__of", "__nth"], "__rank").select("__of", "__mark", "__nth", (F.col("__rank") + F.lit(base)).alias("__new"))
    named = cut(named.unionByName(kinds.where("__nth = 1").select("__of", "__mark", "__nth", F.col("__of").alias("__new"))))
    few = F.broadcast if count < 100_000 else (lambda x: x)
    told = docs.withColumn("__id", number).withColumn("__sign", mark)
    on = (F.col("__id") == F.col("__of")) & (F.col("__sign") == F.col("__mark"))
    told = told.join(few(named), on, "left").select(*[F.col(f"`{c}`") for c in docs.columns], F.coalesce("__new", "__id").alias(name))
    return told, named.select(F.col("__new").alias("name"), F.col("__of").alias("id"), F.col("__nth").alias("nth"))


def jaccard_components(docs: DataFrame, percent: int = 80, width: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id of every row; a link needs ``percent`` of the union in common."""
    told, names = texts_apart(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "id", "text", "name")
    out = text_components(told, percent, width, "name", "text")
    if names is not None:
        # an id is one document: what its texts belong to is one component, under its smallest id
        whole = cut(out.join(names, "name", "left").select(F.coalesce("id", "name").alias("id"), "n", "component"))
        merged = components(whole.where("id is not null").select(F.col("id").alias("a"), F.col("component").alias("b")))
        labelled = whole.join(merged, whole["component"] == merged["u"], "left").select("id", "n", F.coalesce("v", "component").alias("label"))
        least = labelled.groupBy("label").agg(F.min("id").alias("component"))
        out = labelled.join(least, "label", "left").select("id", "n", "component")
    else:
        out = out.withColumnRenamed("name", "id")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


def text_components(docs: DataFrame, percent: int, width: int, id_col: str, text_col: str) -> DataFrame:
    """name, n, component of every row, for ids that each have one text."""
    t = Fraction(percent, 100)
    small_batches(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    surveyed = survey(docs, width)
    ranks, mean = frequency_ranks(surveyed)
    rows = surveyed.where(F.col("chunk").isNull()).select("id", "n", "hi", "lo")
    groups = cut(rows.where("n > 0").groupBy("hi", "lo").agg(F.min("id").alias("node"), F.count(F.lit(1)).alias("rows")))
    repeated = bitmap(groups.where("rows > 1").select(F.col("lo").bitwiseAND(F.lit((1 << FILTER_BITS) - 1)).alias("b")), "b")
    held = prefixes(docs, width, t, ranks, mean, repeated)
    first = F.broadcast if groups.where("rows > 1").count() < 100_000 else (lambda x: x)
    several = groups.where("rows > 1").select("hi", "lo", F.col("node").alias("id"))
    # one node for each set: told apart by the filter, then by an exact join
    marked = held.join(first(several.withColumn("known", F.lit(True))), ["hi", "lo", "id"], "left")
    alone = groups.where("rows = 1")
    unsure = marked.where("maybe and known is null")
    nodes = marked.where("not maybe or known").unionByName(unsure.join(alone.select("hi", "lo"), ["hi", "lo"], "left_semi"))
    listed = cut(nodes.select("id", "n", "l", "usual", "hot"))
    entries = listed.select(F.explode("usual").alias("token"), "id", "n", "l")
    formed = cut(lists_to_pairs(entries, t))
    pairs = cut(formed.where("need is not null").groupBy("x", "y").agg(F.count(F.lit(1)).alias("c"), F.min("need").alias("need")).where("c >= need").select("x", "y"))
    long = formed.where("need is null").select(F.col("x").alias("token"), F.col("y").alias("id")).unionByName(listed.select(F.explode("hot").alias("token"), "id"))
    long = cut(long.distinct())
    ids = pairs.select(F.explode(F.array("x", "y")).alias("id")).unionByName(long.select("id")).distinct()
    sets = sets_of(docs, ids, width)
    links = common_counts(pairs, sets, 1).where(_similar(t)).select("x", "y")
    if not long.isEmpty():
        links = links.unionByName(long_list_links(long, sets, t))
    named = components(links)
    classes = groups.join(named, groups["node"] == named["u"], "left").select("hi", "lo", F.coalesce("v", "node").alias("component"))
    out = rows.where("n > 0").join(classes, ["hi", "lo"], "left").select("id", "n", "component")
    out = out.unionByName(rows.where("n = 0").select("id", "n", F.col("id").alias("component")))
    return out.withColumnRenamed("id", "name")
