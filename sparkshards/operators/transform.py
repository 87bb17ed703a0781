"""Filters, maps and projections over samples with one column a field.

Missing fields: a typed dataset may carry ``__fields__`` (array of the names a sample
really has), so that an absent field differs from a null one; without it, null counts
as absent.
"""

from __future__ import annotations

import fnmatch
import uuid
from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.errors import ERROR, ERROR_TYPE, DuplicateKey, FormatError, MissingKey, OnError, error_row, settle
from ..functions.names import KEY, is_meta

FIELDS = "__fields__"


def quoted(name: str) -> Column:
    """Field names may hold dots."""
    return F.col("`" + name.replace("`", "``") + "`")


def present(df: DataFrame, name: str) -> Column:
    if name not in df.columns:
        return F.lit(False)
    return F.array_contains(FIELDS, name) if FIELDS in df.columns else quoted(name).isNotNull()


def _one_by_one(f: Callable[[pd.DataFrame], pd.DataFrame], x: pd.DataFrame, names: list[str], order_by: list[str]) -> pd.DataFrame:
    """The rows of a frame each alone; a row that fails keeps its order columns and says why."""
    parts = []
    for i in range(len(x)):
        one = x.iloc[i : i + 1]
        try:
            parts.append(f(one).reindex(columns=names).assign(**{ERROR: None}))
        except Exception as e:
            bad = {n: one[n] if n in order_by else pd.Series([None], index=one.index, dtype=object) for n in names}
            parts.append(pd.DataFrame(bad).assign(**{ERROR: [{"class": type(e).__name__, "message": str(e), "field": None}]}))
    return pd.concat(parts) if parts else x.iloc[:0].reindex(columns=[*names, ERROR])


def _map_frames(df: DataFrame, f: Callable[[pd.DataFrame], pd.DataFrame], schema: T.StructType | str | None, handler: OnError | str = OnError.RAISE, order_by: Iterable[str] = ()) -> DataFrame:
    """mapInPandas that stands dots in column names.  With a ``handler`` a frame that fails is mapped again row by row."""
    handler, order_by = OnError(handler), list(order_by)
    columns = df.columns
    plain = df.toDF(*[f"c{i}" for i in range(len(columns))])
    out = df.schema if schema is None else T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    names = [x.name for x in out.fields]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in frames:
            x.columns = columns
            short = [f"c{i}" for i in range(len(names))]
            if handler is OnError.RAISE:
                yield f(x)[names].set_axis(short, axis=1)
                continue
            try:
                yield f(x)[names].set_axis(short, axis=1).assign(**{ERROR: None})
            except Exception:
                yield _one_by_one(f, x, names, order_by).set_axis([*short, ERROR], axis=1)

    fields = [T.StructField(f"c{i}", x.dataType) for i, x in enumerate(out.fields)]
    if handler is OnError.RAISE:
        return plain.mapInPandas(run, T.StructType(fields)).toDF(*names)
    made = plain.mapInPandas(run, T.StructType([*fields, T.StructField(ERROR, T._parse_datatype_string(ERROR_TYPE))])).toDF(*names, ERROR)
    return settle(made, handler, order_by or [KEY], f"map errors {uuid.uuid4().hex[:8]}")


def select(df: DataFrame, predicate: Column | str | Callable[[pd.DataFrame], pd.Series], handler: OnError | str = OnError.RAISE, order_by: Iterable[str] = ()) -> DataFrame:
    """Keeps rows: an expression, or a function from a frame to booleans."""
    if not callable(predicate) or isinstance(predicate, Column):
        return df.where(predicate)
    return _map_frames(df, lambda x: x[predicate(x).astype(bool)], None, handler, order_by)


def map_sample(df: DataFrame, f: Callable[[pd.DataFrame], pd.DataFrame], schema: str | None = None, handler: OnError | str = OnError.RAISE, order_by: Iterable[str] = ()) -> DataFrame:
    """Rows to rows, fewer if f drops some; the key comes back if f loses it."""

    def run(x: pd.DataFrame) -> pd.DataFrame:
        out = f(x)
        return out.assign(**{KEY: x[KEY].reindex(out.index)}) if KEY in x and KEY not in out else out

    return _map_frames(df, run, schema, handler, order_by)


def map_field(df: DataFrame, name: str, f: Callable[[Column], Column]) -> DataFrame:
    """Replaces a field; it keeps its place."""
    if name not in df.columns:
        raise MissingKey(name)
    return df.withColumn(name, f(quoted(name)))


def map_dict(df: DataFrame, **fs: Callable[[Column], Column]) -> DataFrame:
    for name in fs:
        if name not in df.columns:
            raise MissingKey(name)
    return df.withColumns({name: f(quoted(name)) for name, f in fs.items()})


def first_of(df: DataFrame, spec: str, missing_is_error: bool = True) -> Column:
    """The first present field of ``a;b;c``."""
    names = [n for n in spec.split(";") if n]
    known = [n for n in names if n in df.columns]
    if not known:
        if missing_is_error:
            raise MissingKey(spec)
        return F.lit(None)
    out = None
    for n in known:
        out = F.when(present(df, n), quoted(n)) if out is None else out.when(present(df, n), quoted(n))
    if missing_is_error:
        fail = F.raise_error(F.lit(f"MissingKey: {spec}"))
        return out.otherwise(fail.cast(df.schema[known[0]].dataType))
    return out


def _with_missing(df: DataFrame, specs: Iterable[str]) -> DataFrame:
    """Marks the samples that have none of a spec's fields."""
    has = lambda s: reduce(lambda a, b: a | b, [present(df, n) for n in s.split(";") if n], F.lit(False))
    return df.withColumn(ERROR, F.coalesce(*[F.when(~F.coalesce(has(s), F.lit(False)), error_row("MissingKey", F.lit(s))) for s in specs]))


def to_tuple(df: DataFrame, *specs: str, missing_is_error: bool = True, keep: Iterable[str] = (), handler: OnError | str = OnError.RAISE) -> DataFrame:
    """Positional columns _0, _1, ...; a single argument may name several, parted by blanks."""
    names = specs[0].split() if len(specs) == 1 else list(specs)
    keep = list(keep)
    if OnError(handler) is not OnError.RAISE:
        return settle(_with_missing(df, names), handler, keep or [KEY], f"tuple errors {uuid.uuid4().hex[:8]}").select(*[quoted(k) for k in keep], *[first_of(df, s, False).alias(f"_{i}") for i, s in enumerate(names)])
    return df.select(*[quoted(k) for k in keep], *[first_of(df, s, missing_is_error).alias(f"_{i}") for i, s in enumerate(names)])


def map_tuple(df: DataFrame, *fs: Callable[[Column], Column] | None) -> DataFrame:
    """By position over _0, _1, ...; None leaves one as it is, further functions are ignored."""
    return df.withColumns({f"_{i}": f(F.col(f"_{i}")) for i, f in enumerate(fs) if f is not None and f"_{i}" in df.columns})


def extract_keys(df: DataFrame, *patterns: str, missing_is_error: bool = True, duplicate_is_error: bool = True, keep: Iterable[str] = ()) -> DataFrame:
    """Positional columns by glob over field names (with or without a leading dot); ``;`` parts alternatives."""
    chosen = []
    for spec in patterns:
        hits = [c for c in df.columns if any(fnmatch.fnmatchcase(x, p) for p in spec.split(";") if p for x in (c, "." + c))]
        if not hits and missing_is_error:
            raise MissingKey(spec)
        if len(hits) > 1 and duplicate_is_error:
            raise DuplicateKey(f"{spec} matches {hits}")
        chosen += hits[:1]
    return df.select(*[quoted(k) for k in keep], *[quoted(c).alias(f"_{i}") for i, c in enumerate(chosen)])


def rename(df: DataFrame, keep: bool = True, handler: OnError | str = OnError.RAISE, order_by: Iterable[str] = (), **targets: str) -> DataFrame:
    """target="a;b": the first present one.  All alternatives go; keep=False keeps only metadata besides."""
    if OnError(handler) is not OnError.RAISE:
        df = settle(_with_missing(df, targets.values()), handler, list(order_by) or [KEY], f"rename errors {uuid.uuid4().hex[:8]}")
    used = {n for spec in targets.values() for n in spec.split(";")}
    others = [c for c in df.columns if c not in used and c not in targets and (keep or is_meta(c))]
    return df.select(*[quoted(c) for c in others], *[first_of(df, spec).alias(t) for t, spec in targets.items()])


def rename_keys(df: DataFrame, keep_unselected: bool = False, must_match: bool = True, duplicate_is_error: bool = True, **patterns: str) -> DataFrame:
    """new name = glob over the last part of old names, in lower case; later patterns win.

    The key column always stays.
    """
    chosen: dict[str, str] = {}
    matched = set()
    for c in df.columns:
        hits = [new for new, glob in patterns.items() if fnmatch.fnmatchcase(c.rsplit("/", 1)[-1].lower(), glob)]
        matched.update(hits)
        if hits:
            new = hits[-1]
        elif keep_unselected or c == KEY:
            new = c
        else:
            continue
        if new in chosen.values() and duplicate_is_error:
            raise DuplicateKey(new)
        chosen = {k: v for k, v in chosen.items() if v != new} | {c: new}
    if must_match and (lost := set(patterns) - matched):
        raise MissingKey(", ".join(sorted(lost)))
    return df.select(*[quoted(c).alias(new) for c, new in chosen.items()])


def associate(df: DataFrame, lookup: DataFrame, key: str = KEY, lookup_key: str | None = None) -> DataFrame:
    """Adds the lookup's fields by key; unknown keys add none, present fields are overwritten in place.

    The lookup must hold a key once.  Which side is sent where is left to the optimizer.
    """
    lookup_key = lookup_key or key
    twice = lookup.where(quoted(lookup_key).isNotNull()).groupBy(lookup_key).count().where("count > 1").limit(1).collect()
    if twice:
        raise DuplicateKey(f"lookup has {twice[0][0]!r} more than once")
    fields = [c for c in lookup.columns if c != lookup_key]
    right = lookup.select(quoted(lookup_key).alias("__k"), *[quoted(c).alias(f"__f{i}") for i, c in enumerate(fields)], F.lit(True).alias("__hit"))
    joined = df.join(right, quoted(key) == F.col("__k"), "left")
    value = {c: F.when(F.col("__hit"), F.col(f"__f{i}")) for i, c in enumerate(fields)}
    return joined.select(
        *[value[c].otherwise(quoted(c)).alias(c) if c in value else quoted(c) for c in df.columns],
        *[value[c].alias(c) for c in fields if c not in df.columns],
    )


def valid(df: DataFrame) -> DataFrame:
    """Drops empty samples and those marked bad."""
    if "__bad__" in df.columns:
        df = df.where(~F.coalesce(F.col("__bad__"), F.lit(False)))
    if "fields" in df.columns:
        df = df.where(F.size("fields") > 0)
    return df


def project_raw(df: DataFrame, names: list[str]) -> DataFrame:
    """Columns of raw samples by field name; absent fields are null, and listed in ``__fields__``."""
    if len(set(names)) < len(names):
        raise FormatError("field names repeat")
    meta = [c for c in df.columns if c not in ("fields", "field_order")]
    return df.select(*meta, *[F.element_at("fields", F.lit(n)).alias(n) for n in names], F.array_intersect(F.map_keys("fields"), F.lit(names)).alias(FIELDS))
