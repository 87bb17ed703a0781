"""Tensors: a struct column, and the npy, npz and tenbin formats.

TENSOR is struct<dtype, shape, data>; data is little-endian, in C order.
"""

from __future__ import annotations

import ast
import io
import struct
import zipfile
from collections.abc import Iterable, Mapping
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .errors import DecodeError, EncodeError, Unsupported, ValueProblem

TENSOR = T.StructType([T.StructField("dtype", T.StringType()), T.StructField("shape", T.ArrayType(T.IntegerType())), T.StructField("data", T.BinaryType())])

#: Long and short names of the element types.
DTYPES = {"float16": "f2", "float32": "f4", "float64": "f8", "int8": "i1", "int16": "i2", "int32": "i4", "int64": "i8", "uint8": "u1", "uint16": "u2", "uint32": "u4", "uint64": "u8"}
_LONG = {v: k for k, v in DTYPES.items()}


def dtype_name(name: str) -> str:
    """The long name of a long or short one."""
    if name in DTYPES:
        return name
    if name in _LONG:
        return _LONG[name]
    raise Unsupported(f"element type {name!r}")


def to_row(a: np.ndarray) -> tuple[str, list[int], bytes]:
    name = dtype_name(a.dtype.kind + str(a.dtype.itemsize))
    return name, list(a.shape), np.ascontiguousarray(a).astype("<" + DTYPES[name]).tobytes()


def to_array(row: Mapping | T.Row) -> np.ndarray:
    kind = np.dtype("<" + DTYPES[dtype_name(row["dtype"])])
    shape = [int(x) for x in row["shape"]]
    if int(np.prod(shape, dtype=np.int64)) * kind.itemsize != len(row["data"]):
        raise ValueProblem("tensor data does not fill its shape")
    return np.frombuffer(row["data"], kind).reshape(shape)


# -- npy, npz --------------------------------------------------------------------


def read_npy(data: bytes) -> np.ndarray:
    """Versions 1 to 3, C order; big-endian is swapped, bytes after the data are ignored."""
    if data[:6] != b"\x93NUMPY" or len(data) < 10:
        raise DecodeError("not an npy file")
    wide = data[6] >= 2
    if data[6] not in (1, 2, 3):
        raise DecodeError(f"npy version {data[6]}")
    at = 12 if wide else 10
    if len(data) < at:
        raise DecodeError("npy header is cut off")
    size = struct.unpack_from("<I" if wide else "<H", data, 8)[0]
    if len(data) < at + size:
        raise DecodeError("npy header is cut off")
    try:
        head = ast.literal_eval(data[at : at + size].decode("latin1" if data[6] < 3 else "utf-8").strip())
        descr, fortran, shape = head["descr"], head["fortran_order"], head["shape"]
        kind = np.dtype(descr)
    except Exception as e:
        raise DecodeError(f"bad npy header: {e}") from e
    if fortran:
        raise Unsupported("npy in Fortran order")
    dtype_name(kind.kind + str(kind.itemsize))
    n = int(np.prod(shape, dtype=np.int64))
    if len(data) < at + size + n * kind.itemsize:
        raise DecodeError("npy data is cut off")
    a = np.frombuffer(data, kind, n, at + size).reshape(shape)
    return a.astype(kind.newbyteorder("<"))


def write_npy(a: np.ndarray) -> bytes:
    """Version 1.0, header padded to 64 bytes."""
    name, shape, data = to_row(a)
    order = "|" if DTYPES[name].endswith("1") else "<"
    dims = ", ".join(map(str, shape)) + ("," if len(shape) == 1 else "")
    head = f"{{'descr': '{order}{DTYPES[name]}', 'fortran_order': False, 'shape': ({dims}), }}"
    head += " " * (-(len(head) + 11) % 64) + "\n"
    if len(head) > 65535:
        raise EncodeError("npy header is too long")
    return b"\x93NUMPY\x01\x00" + struct.pack("<H", len(head)) + head.encode("latin1") + data


def read_npz(data: bytes) -> dict[str, np.ndarray]:
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            return {n.removesuffix(".npy"): read_npy(z.read(n)) for n in z.namelist()}
    except zipfile.BadZipFile as e:
        raise DecodeError(f"bad npz: {e}") from e


def write_npz(arrays: Mapping[str, np.ndarray]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, a in arrays.items():
            z.writestr(zipfile.ZipInfo(name + ".npy"), write_npy(np.asarray(a)), zipfile.ZIP_DEFLATED)
    return out.getvalue()


# -- tenbin ----------------------------------------------------------------------

#: Fixed values of the format.
MAGIC, ALIGN = b"~TenBin~", 64
MAX_RANK_READ, MAX_RANK_WRITE = 10, 9


@dataclass
class Labelled:
    array: np.ndarray
    label: str = ""


def _chunk(payload: bytes) -> bytes:
    return MAGIC + struct.pack("<q", len(payload)) + payload + bytes(-len(payload) % ALIGN)


def write_tenbin(arrays: Iterable[np.ndarray | Labelled]) -> bytes:
    out = b""
    for x in arrays:
        x = x if isinstance(x, Labelled) else Labelled(np.asarray(x))
        name, shape, data = to_row(x.array)
        if len(shape) > MAX_RANK_WRITE:
            raise EncodeError(f"rank {len(shape)} is over {MAX_RANK_WRITE}")
        label = x.label.encode()
        if len(label) > 8:
            raise EncodeError("label is over 8 bytes")
        out += _chunk(DTYPES[name].encode().ljust(8, b"\0") + label.ljust(8, b"\0") + struct.pack(f"<{len(shape) + 1}q", len(shape), *shape)) + _chunk(data)
    return out


def read_tenbin_labelled(data: bytes) -> list[Labelled]:
    chunks, at = [], 0
    while at < len(data):
        if data[at : at + 8] != MAGIC or len(data) < at + 16:
            raise DecodeError("bad tenbin chunk")
        size = struct.unpack_from("<q", data, at + 8)[0]
        if size < 0 or at + 16 + size > len(data):
            raise DecodeError("bad tenbin length")
        chunks.append(data[at + 16 : at + 16 + size])
        at += 16 + size + (-size % ALIGN)
    if len(chunks) % 2:
        raise DecodeError("tenbin header without data")
    out = []
    for head, body in zip(chunks[::2], chunks[1::2]):
        if len(head) < 24:
            raise DecodeError("tenbin header is cut off")
        rank = struct.unpack_from("<q", head, 16)[0]
        if not 0 <= rank <= MAX_RANK_READ or len(head) < 24 + 8 * rank:
            raise DecodeError("bad tenbin rank")
        shape = struct.unpack_from(f"<{rank}q", head, 24)
        if any(d < 0 for d in shape):
            raise DecodeError("negative tenbin dimension")
        name = dtype_name(head[:8].rstrip(b"\0").decode("latin1"))
        kind = np.dtype("<" + DTYPES[name])
        n = 1
        for d in shape:
            n *= d
        if n * kind.itemsize != len(body):
            raise DecodeError("tenbin data does not fill its shape")
        out.append(Labelled(np.frombuffer(body, kind).reshape(shape), head[8:16].rstrip(b"\0").decode("latin1")))
    return out


def read_tenbin(data: bytes) -> list[np.ndarray]:
    return [x.array for x in read_tenbin_labelled(data)]


# -- columns ---------------------------------------------------------------------


@F.pandas_udf(TENSOR)
def array_to_tensor(values: pd.Series) -> pd.DataFrame:
    """array<number> to a float32 tensor."""
    rows = [to_row(np.asarray(v, np.float32)) if v is not None else (None, None, None) for v in values]
    return pd.DataFrame(rows, columns=["dtype", "shape", "data"])


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def tensor_to_array(t: pd.DataFrame) -> pd.Series:
    """All elements, flat, as doubles."""
    return pd.Series([None if d is None else to_array({"dtype": d, "shape": s, "data": b}).astype(float).ravel().tolist() for d, s, b in zip(t["dtype"], t["shape"], t["data"])], dtype=object)


def reshape(tensor: Column, shape: list[int]) -> Column:
    """The same elements in another shape; their number must not change."""
    count = lambda dims: F.aggregate(dims, F.lit(1).cast("long"), lambda a, d: a * d)
    new = F.array(*[F.lit(d) for d in shape]) if shape else F.array().cast("array<int>")
    fits = count(tensor["shape"]) == count(new)
    bad = F.raise_error(F.lit(f"tensor does not fit the shape {shape}")).cast(TENSOR)
    return F.when(tensor.isNull(), F.lit(None).cast(TENSOR)).when(fits, F.struct(tensor["dtype"].alias("dtype"), new.alias("shape"), tensor["data"].alias("data"))).otherwise(bad)


def widen_half(row: Mapping | T.Row) -> np.ndarray:
    """float16 elements as float32; other types as they are."""
    a = to_array(row)
    return a.astype(np.float32) if a.dtype == np.float16 else a


def stack_column(values: Column) -> Column:
    """array<tensor> to one tensor with a leading axis; unequal shapes or types are an error."""
    first, n = values[0], F.size(values)
    same = F.forall(values, lambda x: (x["dtype"] == first["dtype"]) & (x["shape"] == first["shape"]))
    # joining binaries in order is the stacked data in C order
    data = F.unhex(F.array_join(F.transform(values, lambda x: F.hex(x["data"])), ""))
    stacked = F.struct(first["dtype"].alias("dtype"), F.concat(F.array(n), first["shape"]).alias("shape"), data.alias("data"))
    return F.when(n == 0, F.lit(None).cast(TENSOR)).when(same, stacked).otherwise(F.raise_error(F.lit("tensors of a batch differ in shape or type")).cast(TENSOR))
