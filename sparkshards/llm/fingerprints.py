"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests.

A paragraph is a non-empty line; one of over 512 characters is cut at its sentence ends
(blanks after a full stop, question or exclamation mark), so that texts of one line
have parts too; its digest is a 64-bit hash, or 60 bits of an md5, which any engine can reproduce; a
text's key set is its distinct digests.  A sketch has three tables of cells.  A key
falls into one cell of each table; a cell keeps the XOR of its keys and the sum of
their marks, where a mark is 2**32 plus the key modulo a prime, so that a cell with a
single key can be told (its sum is the mark of its XOR, or minus that for a key of
the other side).  Subtracting two sketches cancels common keys; peeling takes out single
keys, round by round, until nothing is left: then the differing digests are known.

If peeling gets stuck the sketch was too small: it is retried larger.  A larger
sketch is cut by leading digest bits into as many sub-sketches as the two key counts
ask for, each peeled alone, and a sub-sketch that still gets stuck is retried with
more cells, and again; what three sizes can't peel (a chance far below one in a
million, or colliding digests) is compared key by key.  Work grows with the power 1.5
of the number of paragraphs, by the cut into sub-sketches, not with its square.

Everything is DataFrame functions on arrays within a row: no shuffle but the one
that brings neighbours together.  Edge cases: null is empty; empty texts have an
empty key set, and two of them are alike (1.0); repeated paragraphs count once; rows
with equal id and text are carried as one and returned as often as they come.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, free_name, shuffle_partitions

#: Cells in each of the three tables, for the fingerprint and for the retries.
BASE = 8
RETRIES = (4, 8, 32)
#: Characters beyond which a line is cut at its sentence ends.
LONG_LINE = 512
#: What ends a sentence, and what marks are made of.
SENTENCE_END, MARK_BASE, MARK_PRIME = "([.?!])[ \\\\t]+", 1 << 32, 2147483629
#: Passes over the three tables; peeling stops earlier if three in a row find nothing.
PASSES = 30
#: Keys of both sides together that a sub-sketch of a retry is made for.
KEYS_EACH = 4

# The functions below compose SQL text: nested lambdas are then parsed in one go.
# A key is struct<d, w>, a cell struct<k, v>; lambda names must differ when nested.


def _let(value: str, name: str, body: str) -> str:
    """``body``, in which ``name`` is a value that is computed once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _mark(key: str) -> str:
    return f"({MARK_BASE}L + pmod({key}, {MARK_PRIME}L))"


def paragraphs(text: str) -> str:
    """array<string>: the lines of a text, long ones cut at sentence ends, without empty ones."""
    pieces = f"split(regexp_replace(y, '{SENTENCE_END}', '$1\n'), '\n')"
    lines = f"transform(split(coalesce({text}, ''), '\n'), y -> if(length(y) > {LONG_LINE}, {pieces}, array(y)))"
    return f"filter(flatten({lines}), x -> x != '')"


#: SQL of a paragraph's digest.
DIGESTS = {"xxhash64": "xxhash64(x)", "md5": "cast(conv(substring(md5(cast(x as binary)), 1, 15), 16, 10) as bigint)"}


def keys(text: str, digest: str = "xxhash64") -> str:
    """array<struct<d, w>>: the distinct paragraph digests and their marks."""
    return f"transform(array_distinct(transform({paragraphs(text)}, x -> {DIGESTS[digest]})), d -> named_struct('d', d, 'w', {_mark('d')}))"


def _cells(size: int, tables: range = range(3)) -> str:
    """A literal: shift and wanted bits of every cell."""
    bits = size.bit_length() - 1
    return "array(" + ", ".join(f"named_struct('s', {t * bits}, 'v', {i}L)" for t in tables for i in range(size)) + ")"


def _in_cell(size: int) -> str:
    return f"(shiftrightunsigned(e.d, c.s) & {size - 1}L) = c.v"


def sketch(held: str, size: int) -> str:
    """array<struct<k, v>>: XOR of keys and sum of marks, cell by cell."""
    add = f"if({_in_cell(size)}, named_struct('k', acc.k ^ e.d, 'v', acc.v + e.w), acc)"
    return f"transform({_cells(size)}, c -> aggregate({held}, named_struct('k', 0L, 'v', 0L), (acc, e) -> {add}))"


def subtract(a: str, b: str) -> str:
    return f"zip_with({a}, {b}, (x, y) -> named_struct('k', x.k ^ y.k, 'v', x.v - y.v))"


def peel(difference: str, size: int) -> str:
    """struct<ok, a, b>: whether all was recovered, and the digests on either side only.

    A pass looks at one table, in which a key has one cell, so it finds no key twice.
    """
    single = f"filter(slice(st.cells, st.at * {size} + 1, {size}), x -> x.v != 0 and abs(x.v) = {_mark('x.k')})"
    found = f"transform({single}, x -> named_struct('d', x.k, 'w', x.v))"
    drop = f"if({_in_cell(size)}, named_struct('k', acc.k ^ e.d, 'v', acc.v - e.w), acc)"
    state = lambda cells, a, b, idle, at: f"named_struct('cells', {cells}, 'a', {a}, 'b', {b}, 'idle', {idle}, 'at', {at})"
    after = "(st.at + 1) % 3"
    taken = state(
        f"zip_with(st.cells, {_cells(size)}, (o, c) -> aggregate(f, o, (acc, e) -> {drop}))",
        "concat(st.a, transform(filter(f, x -> x.w > 0), x -> x.d))", "concat(st.b, transform(filter(f, x -> x.w < 0), x -> x.d))", "0", after,
    )
    step = f"if(st.idle >= 3, st, {_let(found, 'f', f'if(size(f) = 0, {state("st.cells", "st.a", "st.b", "st.idle + 1", after)}, {taken})')})"
    none = "cast(array() as array<bigint>)"
    done = "named_struct('ok', forall(st.cells, x -> x.k = 0 and x.v = 0), 'a', st.a, 'b', st.b)"
    return f"aggregate(sequence(1, {PASSES}), {state(difference, none, none, '0', '0')}, (st, i) -> {step}, st -> {done})"


def _exact(a: str, b: str) -> str:
    da, db = f"transform({a}, x -> x.d)", f"transform({b}, x -> x.d)"
    return f"named_struct('ok', true, 'a', array_except({da}, {db}), 'b', array_except({db}, {da}))"


def _try_sizes(a: str, b: str, sizes: tuple[int, ...]) -> str:
    if not sizes:
        return _exact(a, b)
    compared, name = peel(subtract(sketch(a, sizes[0]), sketch(b, sizes[0])), sizes[0]), f"r{len(sizes)}"
    return _let(compared, name, f"if({name}.ok, {name}, {_try_sizes(a, b, sizes[1:])})")


def _split(held: str, bits: str) -> str:
    """The keys by their leading bits, in two steps of half as many."""
    lead = lambda n: f"shiftrightunsigned(shiftrightunsigned(e.d, 1), 63 - {n})"
    first = f"transform(sequence(0L, shiftleft(1L, high) - 1), i -> filter({held}, e -> {lead('high')} = i))"
    second = f"transform(sequence(0L, shiftleft(1L, {bits} - high) - 1), j -> filter(part, e -> ({lead(bits)} & (shiftleft(1L, {bits} - high) - 1)) = j))"
    return _let(f"cast({bits} div 2 as int)", "high", f"flatten(transform({first}, part -> {second}))")


def retry(a: str, b: str) -> str:
    """struct<a, b>: differing digests by a larger sketch."""
    bits = f"cast(greatest(1, ceil(log2((size({a}) + size({b})) / {KEYS_EACH}.0D))) as int)"
    # a part that only one side has, or that both have alike, needs no sketch
    told = f"if(size(pa) = 0 or size(pb) = 0 or pa = pb, {_exact('pa', 'pb')}, {_try_sizes('pa', 'pb', RETRIES)})"
    parts = _let(bits, "bits", f"zip_with({_split(a, 'bits')}, {_split(b, 'bits')}, (pa, pb) -> {told})")
    return _let(parts, "ps", "named_struct('a', flatten(transform(ps, x -> x.a)), 'b', flatten(transform(ps, x -> x.b)))")


def diff(sketch_a: str, keys_a: str, sketch_b: str, keys_b: str) -> str:
    """struct<a, b>: digests of paragraphs that only the first, only the second text has."""
    first = peel(subtract(sketch_a, sketch_b), BASE)
    return _let(first, "r", f"if(r.ok, named_struct('a', r.a, 'b', r.b), {retry(keys_a, keys_b)})")


def likeness(keys_a: str, keys_b: str, differing: str) -> Column:
    """Common paragraphs of all paragraphs, 1.0 if there are none."""
    every = f"(size({keys_b}) + size({differing}.a))"
    return F.expr(f"if({every} = 0, 1.0D, (size({keys_a}) - size({differing}.a)) / {every})")


def fingerprint(keys_: str, sketch_: str) -> Column:
    """The sketch as a string; the same for equal texts."""
    return F.expr(f"concat(size({keys_}), ':', array_join(transform({sketch_}, x -> if(x.v = 0, '', concat(hex(x.k), '.', hex(x.v)))), ','))")


def _head_of(text: Column) -> Column:
    """The first 7 bytes as a number, in the order of texts."""
    return F.conv(F.rpad(F.hex(F.substring(text.cast("binary"), 1, 7)), 14, "0"), 16, 10).cast("long")


def _search(bounds: list[int], value: Column) -> Column:
    """How many of the sorted bounds are at or below the value: a binary search in a literal array."""
    if not bounds:
        return F.lit(0)
    held = F.lit(bounds)

    def step(st: Column, _: Column) -> Column:
        mid = F.floor((st["lo"] + st["hi"]) / 2).cast("int")
        above = F.get(held, mid) <= value
        return F.when(st["lo"] >= st["hi"], st).when(above, F.struct((mid + 1).alias("lo"), st["hi"].alias("hi"))).otherwise(F.struct(st["lo"].alias("lo"), mid.alias("hi")))

    steps = F.array(*[F.lit(i) for i in range(len(bounds).bit_length() + 1)])
    return F.aggregate(steps, F.struct(F.lit(0).alias("lo"), F.lit(len(bounds)).alias("hi")), step, lambda st: st["lo"])


def _ranges(rows: DataFrame, ranges: int) -> Column:
    """The number of a row's range by (doc_id, text), nulls lowest, so that ranges hold about as many rows.

    Bounds are quantiles of the ids; an id (or null) that takes several of them is cut
    again, by quantiles of its texts' first bytes.
    """
    share = [i / ranges for i in range(1, ranges)]
    accuracy = max(10_000, 20 * ranges)
    found = rows.agg(F.percentile_approx("doc_id", share, accuracy).alias("c"), F.count(F.lit(1)).alias("n"), F.count("doc_id").alias("known")).first()
    cuts = found["c"] or []
    bounds = sorted(set(cuts))
    place = _search(bounds, F.col("doc_id"))
    # place 2i + 1: between the bounds i and i + 1; 2i + 2: the bound i alone, where it is hot
    hot = {c: cuts.count(c) for c in bounds if cuts.count(c) > 1}
    if found["n"] - found["known"] > found["n"] / ranges:
        hot[None] = max(2, round(ranges * (found["n"] - found["known"]) / found["n"]))
    inner: Column = F.lit(0)
    if hot:
        own = F.col("doc_id").isin([c for c in hot if c is not None])
        own = own | F.col("doc_id").isNull() if None in hot else own
        heads = rows.where(own).groupBy("doc_id").agg(F.percentile_approx("head", share, accuracy).alias("c")).collect()  # `ranges` rows at most
        for value, found_heads in heads:
            few = sorted({found_heads[round(i * ranges / hot[value]) - 1] for i in range(1, hot[value])})
            inner = F.when(F.col("doc_id").eqNullSafe(F.lit(value).cast("long")), _search(few, F.col("head"))).otherwise(inner)
    alone = F.col("doc_id").isin([c for c in hot if c is not None]) if any(c is not None for c in hot) else F.lit(False)
    outer = F.when(F.col("doc_id").isNull(), F.lit(-1)).otherwise(2 * place + F.when(alone, 0).otherwise(1))
    return outer.cast("long") * (1 << 20) + inner.cast("long")


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text, next_text: the text of the next row by descending id, the first after the last.

    Rows go to ranges of (id, text); each range also gets the first text of the next range,
    so no task sees more than a range.  Equal ids follow by descending text, null ids
    come last.  Rows with equal id and text are one row here, with their number.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumns({"head": _head_of(F.col("text")), "sign": F.xxhash64("text"), "copies": F.lit(1).cast("long")})
    same = rows.groupBy("doc_id", "sign").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    same = cut(same.select(F.col("doc_id").alias("__id"), F.col("sign").alias("__sign")))
    n = same.count()
    if n:
        on = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("sign") == F.col("__sign"))
        small = F.broadcast(same) if n < 50_000 else same
        repeated = rows.join(small, on, "left_semi").groupBy("doc_id", "sign", "text").agg(F.first("head").alias("head"), F.count(F.lit(1)).alias("copies"))
        rows = rows.join(small, on, "left_anti").unionByName(repeated)
    rows = rows.drop("sign")
    rows = rows.withColumn("range", _ranges(rows, 8 * shuffle_partitions(docs.sparkSession)))
    # one row a range
    heads = rows.groupBy("range").agg(F.max(F.struct("doc_id", "head")).alias("h"))
    order = Window.orderBy(F.desc("range"))
    top = F.first("h").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    heads = heads.select(F.col("range").alias("to"), F.coalesce(F.lead("h").over(order), top).alias("h"))
    heads = heads.select("to", F.col("h.doc_id").alias("top_id"), F.col("h.head").alias("top_head"))
    on = F.col("doc_id").eqNullSafe(F.col("top_id")) & (F.col("head") == F.col("top_head"))
    first = rows.join(F.broadcast(heads), on).groupBy("to").agg(F.max("text").alias("text"))
    both = rows.select("range", "doc_id", "text", "copies", F.lit(0).alias("mark")).unionByName(first.select(F.col("to").alias("range"), F.lit(None).cast("long").alias("doc_id"), "text", F.lit(0).cast("long").alias("copies"), F.lit(1).alias("mark")))
    by = Window.partitionBy("range").orderBy("mark", F.desc_nulls_last("doc_id"), F.desc("text"))
    return both.withColumn("next_text", F.lead("text").over(by)).where("mark = 0").select("doc_id", "text", "next_text", "copies")


def compare_texts(rows: DataFrame, left: str, right: str, out: str) -> DataFrame:
    """Adds ``out``: struct<a, b> of the digests of paragraphs that only one text column has."""
    lk, rk, ls, rs = (free_name(rows.columns, n) for n in ("left_keys", "right_keys", "left_sketch", "right_sketch"))
    held = rows.withColumns({lk: F.expr(keys(f"`{left}`")), rk: F.expr(keys(f"`{right}`"))})
    held = held.withColumns({ls: F.expr(sketch(lk, BASE)), rs: F.expr(sketch(rk, BASE))})
    return held.withColumn(out, F.expr(diff(ls, lk, rs, rk))).drop(lk, rk, ls, rs)


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: str = "xxhash64") -> DataFrame:
    """Fingerprints of each text and of its edited text, and their likenesses."""
    rows = with_next(docs, id_col, text_col)
    # of n equal rows, all but the last are followed by their own text
    alone = F.struct("next_text", F.lit(1).cast("long").alias("n"))
    among = F.when(F.col("copies") > 1, F.array(alone, F.struct(F.col("text").alias("next_text"), (F.col("copies") - 1).alias("n")))).otherwise(F.array(alone))
    rows = rows.withColumn("m", F.explode(among)).select("doc_id", "text", "m.next_text", "m.n").withColumn("n_chars", F.length("text").cast("long"))
    taken = F.floor(F.col("n_chars") / 3).cast("int")
    rows = rows.withColumn("edited", F.concat(F.substring("text", F.lit(1), (F.col("n_chars") - taken).cast("int")), F.substring("next_text", F.lit(1), taken)))
    rows = rows.select("doc_id", "n", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), *[F.expr(keys(c, digest)).alias(k) for c, k in (("text", "kt"), ("edited", "ke"), ("next_text", "kn"))])
    rows = rows.withColumns({f"s{k[1]}": F.expr(sketch(k, BASE)) for k in ("kt", "ke", "kn")})
    rows = rows.withColumns({f"d{x}": F.expr(diff("st", "kt", f"s{x}", f"k{x}")) for x in "en"})
    out = rows.select(
        "doc_id", "n", "n_chars", "edited_sha256", fingerprint("kt", "st").alias("fingerprint"), fingerprint("ke", "se").alias("edited_fingerprint"),
        likeness("kt", "ke", "de").alias("near_edited"), likeness("kt", "kn", "dn").alias("near_next"),
    )
    return out.withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n")))).drop("n", "nth")
