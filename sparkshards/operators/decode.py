"""Decoding fields by extension, and encoding them back.

Text, integers and JSON are column expressions; binary formats are Arrow-batched
functions.  The type of a field depends on its extension alone, so the plan has a
fixed schema.  A ``.gz`` at the end is taken off first, the name stays.
"""

from __future__ import annotations

import gzip
import json
import uuid
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..functions import codecs, images
from ..functions.errors import ERROR, DecodeError, EncodeError, MissingKey, OnError, Unsupported, error_row, settle
from ..functions.names import KEY, is_meta
from ..functions.tensors import TENSOR, Labelled, read_npy, read_npz, read_tenbin, to_array, to_row, write_npy, write_npz, write_tenbin
from .transform import FIELDS, quoted

#: A function of (".name", column) over fields that are still bytes.
LeftOver = Callable[[str, Column], Column | None]
# Which extensions mean what.
TEXT = ["txt", "text", "transcript"]
INTEGER = ["cls", "cls2", "class", "count", "index", "inx", "id"]
JSON = ["json", "jsn"]
TENBIN = ["ten", "tb", "tenbin"]
MSGPACK = ["mp", "msg", "msgpack"]
PICKLE = ["pkl", "pickle", "pyd", "pth"]
INTEGER_PATTERN = r"(?U)^\s*([+-]?[0-9]+)\s*$"


def kind_of(name: str) -> str:
    """text, integer, json, npy, npz, tenbin, msgpack, cbor, pickle, image or bytes, by the last extension."""
    ext = name.lower().removesuffix(".gz").rsplit(".", 1)[-1]
    for kind, held in (("text", TEXT), ("integer", INTEGER), ("json", JSON), ("npy", ["npy"]), ("npz", ["npz"]), ("tenbin", TENBIN), ("msgpack", MSGPACK), ("cbor", ["cbor"]), ("pickle", PICKLE), ("image", images.EXTENSIONS)):
        if ext in held:
            return kind
    return "bytes"


def _each(f: Callable, what: str) -> Callable[[pd.Series], pd.Series]:
    def run(values: pd.Series) -> pd.Series:
        out = []
        for v in values:
            try:
                out.append(None if v is None else f(bytes(v)))
            except (DecodeError, Unsupported):
                raise
            except Exception as e:
                raise DecodeError(f"{what}: {e}") from e
        return pd.Series(out, dtype=object)

    return run


def _frame(rows: list) -> pd.DataFrame:
    return pd.DataFrame([(None, None, None) if r is None else r for r in rows], columns=["dtype", "shape", "data"])


@F.pandas_udf(T.BinaryType())
def gunzip(values: pd.Series) -> pd.Series:
    return _each(gzip.decompress, "gzip")(values)


@F.pandas_udf(TENSOR)
def npy_to_tensor(values: pd.Series) -> pd.DataFrame:
    return _frame(_each(lambda v: to_row(read_npy(v)), "npy")(values).tolist())


@F.pandas_udf(T.MapType(T.StringType(), TENSOR))
def npz_to_tensors(values: pd.Series) -> pd.Series:
    row = lambda a: dict(zip(("dtype", "shape", "data"), to_row(a)))
    return _each(lambda v: {k: row(a) for k, a in read_npz(v).items()}, "npz")(values)


@F.pandas_udf(T.ArrayType(TENSOR))
def tenbin_to_tensors(values: pd.Series) -> pd.Series:
    row = lambda a: dict(zip(("dtype", "shape", "data"), to_row(a)))
    return _each(lambda v: [row(a) for a in read_tenbin(v)], "tenbin")(values)


@F.pandas_udf(T.StringType())
def msgpack_to_json(values: pd.Series) -> pd.Series:
    return _each(lambda v: json.dumps(codecs.jsonable(codecs.unpack_msgpack(v))), "msgpack")(values)


@F.pandas_udf(T.StringType())
def cbor_to_json(values: pd.Series) -> pd.Series:
    return _each(lambda v: json.dumps(codecs.jsonable(codecs.unpack_cbor(v))), "cbor")(values)


def image_to_tensor(spec: str):
    @F.pandas_udf(TENSOR)
    def decode(values: pd.Series) -> pd.DataFrame:
        found = images.read_images([None if v is None else bytes(v) for v in values])
        for x in found:
            if isinstance(x, Exception):
                raise x
        return _frame([None if x is None else to_row(images.to_value(x, spec)) for x in found])

    return decode


def decode_text(data: Column) -> Column:
    """Strict UTF-8: bad bytes raise."""
    return F.validate_utf8(data.cast("string"))


def decode_integer(data: Column) -> Column:
    """Blanks around, an optional sign, digits; anything else raises."""
    text = F.regexp_extract(data.cast("string"), INTEGER_PATTERN, 1)
    bad = F.raise_error(F.concat(F.lit("DecodeError: no integer: "), F.left(data.cast("string"), F.lit(40))))
    return F.when(data.isNull(), None).when(text == "", bad.cast("bigint")).otherwise(text.cast("bigint"))


def decode_json(data: Column) -> Column:
    return F.parse_json(data.cast("string"))


def decode_column(data: Column, name: str, image_spec: str | None = None) -> Column:
    """The decoded form of a field's bytes; unknown extensions and, without a spec, images stay bytes."""
    if name.lower().endswith(".gz"):
        data = gunzip(data)
    kind = kind_of(name)
    if kind == "pickle":
        raise Unsupported(f"{name}: pickled data runs code when it is read")
    if kind == "image":
        return F.when(data.isNotNull(), image_to_tensor(image_spec)(data)) if image_spec else data
    plain: dict[str, Callable[[Column], Column]] = {
        "text": decode_text, "integer": decode_integer, "json": decode_json, "npy": lambda c: F.when(c.isNotNull(), npy_to_tensor(c)), "npz": npz_to_tensors, "tenbin": tenbin_to_tensors,
        "msgpack": lambda c: F.parse_json(msgpack_to_json(c)), "cbor": lambda c: F.parse_json(cbor_to_json(c)),
    }
    return plain[kind](data) if kind in plain else data


def matches(name: str, extension: str) -> bool:
    """``seg.png`` and ``png`` both match the field ``seg.png``; whole parts only."""
    return ("." + name.lower()).endswith("." + extension.lower().lstrip("."))


def _tried(name: str, decode: Callable[[bytes], object], kind: T.DataType, many: Callable[[list], list] | None = None) -> Callable[[Column], Column]:
    """struct<value, error> of a field: an Arrow function that keeps errors as text.

    ``many`` makes a batch into values and exceptions first, which ``decode`` then gets.
    """
    made = to_arrow_type(T.StructType([T.StructField("value", kind), T.StructField("error", T.StringType())]))

    def one(v: bytes | None) -> dict:
        try:
            if isinstance(v, Exception):
                raise v
            return {"value": None if v is None else decode(v), "error": None}
        except Exception as e:
            return {"value": None, "error": f"{name}: {e}"}

    def run(values: pa.Array) -> pa.Array:
        held = values.to_pylist()
        return pa.array([one(v) for v in (many(held) if many else held)], made)

    run.__annotations__ = {"values": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, T.StructType([T.StructField("value", kind), T.StructField("error", T.StringType())])).asNondeterministic()


def _tensor_dict(a: np.ndarray) -> dict:
    return dict(zip(("dtype", "shape", "data"), to_row(a)))


def _binary_kinds(image_spec: str | None) -> dict[str, tuple]:
    """What binary fields become, by kind."""
    out: dict[str, tuple] = {
        "npy": (lambda v: _tensor_dict(read_npy(v)), TENSOR),
        "npz": (lambda v: [(k, _tensor_dict(a)) for k, a in read_npz(v).items()], T.MapType(T.StringType(), TENSOR)),
        "tenbin": (lambda v: [_tensor_dict(a) for a in read_tenbin(v)], T.ArrayType(TENSOR)),
        "msgpack": (lambda v: json.dumps(codecs.jsonable(codecs.unpack_msgpack(v))), T.StringType()),
        "cbor": (lambda v: json.dumps(codecs.jsonable(codecs.unpack_cbor(v))), T.StringType()),
    }
    if image_spec:
        out["image"] = (lambda a: _tensor_dict(images.to_value(a, image_spec)), TENSOR, images.read_images)
    return out


def try_decode_column(data: Column, name: str, image_spec: str | None = None) -> Column:
    """struct<value, error>: the decoded form, or null and what is wrong with the bytes."""
    pair = lambda value, error: F.struct(value.alias("value"), error.cast("string").alias("error"))
    if name.lower().endswith(".gz"):
        plain = _tried("gzip", gzip.decompress, T.BinaryType())(data)
        inner = try_decode_column(plain["value"], name[:-3], image_spec)
        return pair(inner["value"], F.coalesce(plain["error"], inner["error"]))
    kind, bad = kind_of(name), lambda value, what: F.when(data.isNotNull() & value.isNull(), F.lit(what))
    if kind == "pickle":
        return pair(F.lit(None).cast("binary"), F.when(data.isNotNull(), F.lit("pickled data runs code when it is read")))
    if kind == "text":
        value = F.try_validate_utf8(data.cast("string"))
        return pair(value, bad(value, "no UTF-8 text"))
    if kind == "integer":
        text = F.regexp_extract(F.try_validate_utf8(data.cast("string")), INTEGER_PATTERN, 1)
        value = F.nullif(text, F.lit("")).try_cast("bigint")
        return pair(value, bad(value, "no integer"))
    if kind == "json":
        value = F.try_parse_json(F.try_validate_utf8(data.cast("string")))
        return pair(value, bad(value, "no JSON"))
    found = _binary_kinds(image_spec).get(kind)
    if found is None:
        return pair(data, F.lit(None))
    tried = _tried(kind, *found)(data)
    return pair(F.try_parse_json(tried["value"]), tried["error"]) if kind in ("msgpack", "cbor") else tried


def decode(df: DataFrame, image_spec: str | None = None, only: list[str] | None = None, partial: bool = True, handlers: dict[str, Callable[[Column], Column]] | None = None, handler: OnError | str = OnError.RAISE, order_by: list[str] | None = None, pre: list[LeftOver] | None = None, post: list[LeftOver] | None = None) -> DataFrame:
    """Decodes the binary fields (all, or ``only``).  ``handlers`` go before the built-in ones, by extension.

    A field that is no longer binary is left if ``partial``, else an error.  ``handler``
    says what becomes of a sample with a field that can't be decoded (``order_by``: the
    order in which a stop policy stops).  ``pre`` and then ``post`` are functions of
    ("." + name, column) for fields that are still bytes; the first that does not return
    None makes the field.
    """
    handler = OnError(handler)
    out, errors = {}, []
    for f in df.schema.fields:
        if is_meta(f.name) or (only is not None and f.name not in only):
            continue
        if not isinstance(f.dataType, T.BinaryType):
            if not partial:
                raise DecodeError(f"{f.name} is decoded already")
            continue
        own = next((h for ext, h in (handlers or {}).items() if matches(f.name, ext)), None)
        if own:
            out[f.name] = own(quoted(f.name))
        elif handler is OnError.RAISE:
            out[f.name] = decode_column(quoted(f.name), f.name, image_spec)
        else:
            out[f.name] = try_decode_column(quoted(f.name), f.name, image_spec)
            errors.append(f.name)
    made = df.withColumns(out) if out else df
    if errors:
        # all fields are tried once, then told apart
        found = [F.when(quoted(n)["error"].isNotNull(), error_row("DecodeError", quoted(n)["error"], n)) for n in errors]
        made = made.withColumn(ERROR, F.coalesce(*found)).withColumns({n: quoted(n)["value"] for n in errors})
        made = settle(made, handler, order_by or [KEY], f"decode errors {uuid.uuid4().hex[:8]}")
    left = {}
    for f in made.schema.fields:
        if (pre or post) and isinstance(f.dataType, T.BinaryType) and not is_meta(f.name) and (only is None or f.name in only):
            value = next((v for g in [*(pre or []), *(post or [])] if (v := g("." + f.name, quoted(f.name))) is not None), None)
            if value is not None:
                left[f.name] = value
    return made.withColumns(left) if left else made


# -- encoding ----------------------------------------------------------------------


def _tensor_writer(write: Callable[[np.ndarray], bytes]):
    @F.pandas_udf(T.BinaryType())
    def encode(t: pd.DataFrame) -> pd.Series:
        return pd.Series([None if d is None else write(to_array({"dtype": d, "shape": s, "data": b})) for d, s, b in zip(t["dtype"], t["shape"], t["data"])], dtype=object)

    return encode


@F.pandas_udf(T.BinaryType())
def tensors_to_npz(values: pd.Series) -> pd.Series:
    return pd.Series([None if v is None else write_npz({k: to_array(t) for k, t in (v.items() if isinstance(v, dict) else v)}) for v in values], dtype=object)


@F.pandas_udf(T.BinaryType())
def tensors_to_tenbin(values: pd.Series) -> pd.Series:
    return pd.Series([None if v is None else write_tenbin([Labelled(to_array(t)) for t in v]) for v in values], dtype=object)


@F.pandas_udf(T.BinaryType())
def gzip_bytes(values: pd.Series) -> pd.Series:
    return pd.Series([None if v is None else gzip.compress(bytes(v), mtime=0) for v in values], dtype=object)


@F.pandas_udf(T.BinaryType())
def json_to_msgpack(values: pd.Series) -> pd.Series:
    return pd.Series([None if v is None else codecs.pack_msgpack(json.loads(v)) for v in values], dtype=object)


@F.pandas_udf(T.BinaryType())
def json_to_cbor(values: pd.Series) -> pd.Series:
    return pd.Series([None if v is None else codecs.pack_cbor(json.loads(v)) for v in values], dtype=object)


def _json_text(value: Column, kind: T.DataType) -> Column:
    return F.to_json(value) if isinstance(kind, (T.StructType, T.MapType, T.ArrayType, T.VariantType)) else F.to_json(F.struct(value.alias("v"))).substr(F.lit(6), F.length(F.to_json(F.struct(value.alias("v")))) - 6)


def encode_column(value: Column, name: str, kind: T.DataType) -> Column:
    """The bytes of a field, by its extension; bytes stay as they are."""
    if isinstance(kind, T.BinaryType):
        return value
    ext, form = name.lower().removesuffix(".gz").rsplit(".", 1)[-1], kind_of(name)
    if name.startswith("_"):
        if not isinstance(kind, T.StringType):
            raise EncodeError(f"{name} must be text or bytes")
        return value.cast("binary")
    if form == "integer":
        out = value.cast("bigint").cast("string").cast("binary")
    elif form == "json":
        out = _json_text(value, kind).cast("binary")
    elif form in ("msgpack", "cbor"):
        out = (json_to_msgpack if form == "msgpack" else json_to_cbor)(_json_text(value, kind))
    elif form == "npy" and kind == TENSOR:
        out = _tensor_writer(write_npy)(value)
    elif form == "npz" and isinstance(kind, T.MapType):
        out = tensors_to_npz(value)
    elif form == "tenbin" and kind == TENSOR:
        out = _tensor_writer(lambda a: write_tenbin([a]))(value)
    elif form == "tenbin" and isinstance(kind, T.ArrayType):
        out = tensors_to_tenbin(value)
    elif form == "image" and kind == TENSOR:
        out = _tensor_writer(lambda a: images.write_image(a, ext))(value)
    elif isinstance(kind, T.StringType):
        out = value.cast("binary")
    else:
        raise EncodeError(f"no encoding of {kind.simpleString()} as .{ext}")
    return gzip_bytes(out) if name.lower().endswith(".gz") else out


def encode(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Fields to one map of bytes, ``fields``, beside the metadata columns; null fields are absent."""
    names = names or [c for c in df.columns if not is_meta(c) and c != FIELDS]
    lost = [n for n in names if n not in df.columns]
    if lost:
        raise MissingKey(", ".join(lost))
    pairs = F.array(*[F.struct(F.lit(n).alias("key"), encode_column(quoted(n), n, df.schema[n].dataType).alias("value")) for n in names])
    meta = [c for c in df.columns if is_meta(c) and c != FIELDS]
    return df.select(*meta, F.map_from_entries(F.filter(pairs, lambda e: e["value"].isNotNull())).alias("fields"))
