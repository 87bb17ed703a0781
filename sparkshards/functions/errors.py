"""Errors, and what to do on them.

A scan or map can give rows with an ``_error`` column; the five policies are
expressed on that: raise, drop, drop and count, keep what comes before the first.
"""

from __future__ import annotations

from enum import Enum

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class ShardError(Exception):
    """Base of all errors of this package."""


class FormatError(ShardError):
    pass


class DecodeError(ShardError):
    pass


class EncodeError(ShardError):
    pass


class MissingKey(ShardError):
    pass


class DuplicateKey(ShardError):
    pass


class SecurityError(ShardError):
    pass


class SubprocessError(ShardError):
    pass


class Unsupported(ShardError):
    pass


class ValueProblem(ShardError):
    pass


class EmptyDataset(ShardError):
    pass


class OnError(str, Enum):
    RAISE = "reraise_exception"
    CONTINUE = "ignore_and_continue"
    WARN_CONTINUE = "warn_and_continue"
    STOP = "ignore_and_stop"
    WARN_STOP = "warn_and_stop"

    @property
    def stops(self) -> bool:
        return self in (OnError.STOP, OnError.WARN_STOP)


ERROR = "_error"
ERROR_TYPE = "struct<class:string,message:string,field:string>"


def error_row(kind: str, message: Column, field: str | None = None) -> Column:
    """The value of ``_error``."""
    return F.struct(F.lit(kind).alias("class"), message.cast("string").alias("message"), F.lit(field).cast("string").alias("field"))


def settle(df: DataFrame, policy: OnError | str, order_by: list[str], name: str = "errors") -> DataFrame:
    """Applies a policy to the rows whose ``_error`` is set, and drops that column.

    Stopping keeps the rows ordered before the first error, which a subquery finds when the
    result is used.  Warning policies also observe the number of errors, under ``name``.
    """
    policy = OnError(policy)
    bad = F.col(ERROR).isNotNull()
    if policy is OnError.RAISE:
        checked = F.when(bad, F.raise_error(F.concat_ws(": ", f"{ERROR}.class", f"{ERROR}.field", f"{ERROR}.message")).cast("boolean")).otherwise(F.lit(True))
        return df.where(checked).drop(ERROR)
    if policy in (OnError.WARN_CONTINUE, OnError.WARN_STOP):
        df = df.observe(name, F.count(F.when(bad, 1)).alias("n"))
    if policy.stops:
        first = df.where(bad).agg(F.min(F.struct(*order_by)).alias("m")).scalar()
        df = df.where(first.isNull() | (F.struct(*order_by) < first))
    return df.where(~bad).drop(ERROR)
