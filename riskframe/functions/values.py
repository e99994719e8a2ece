"""Null, NaN, infinity and arithmetic rules shared by every operator.

Missing means null or NaN. Spark's own aggregates treat NaN as a value, so columns are
passed through ``fold_nan`` before they are aggregated.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

INF = float("inf")

# Text read as a number: a decimal with optional exponent, or a spelled-out special value.
NUMBER_TEXT = r"(?i)^\s*[+-]?(\d+\.?\d*(e[+-]?\d+)?|\.\d+(e[+-]?\d+)?|inf|infinity|nan)\s*$"

# Digits, points and signs alone: what casts to a number here is one by NUMBER_TEXT as well.
PLAIN_TEXT = r"^[0-9.+-]*$"
#: Types whose cells are the same numbers by a cast as by way of their text.
NUMBERS = (T.DoubleType, T.LongType, T.IntegerType, T.ShortType, T.ByteType)


def quoted(name: str) -> Column:
    """A column by its whole name, dots and spaces included."""
    return F.col("`" + name.replace("`", "``") + "`")


def col(c: str | Column) -> Column:
    return quoted(c) if isinstance(c, str) else c


def is_missing(c: str | Column) -> Column:
    return col(c).isNull() | F.isnan(col(c))


def is_inf(c: str | Column) -> Column:
    return F.coalesce(F.abs(col(c)) == F.lit(INF), F.lit(False))


def fold_nan(c: str | Column) -> Column:
    return F.when(~F.isnan(col(c)), col(c))


def missing_flag(df: DataFrame, name: str) -> Column:
    """Missing test that fits the column's type."""
    if isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)):
        return is_missing(quoted(name))
    return quoted(name).isNull()


def required(c: str | Column, what: str) -> Column:
    """The value; the query fails when one is null or NaN, as a metric of it would mean nothing."""
    value = col(c)
    gap = value.isNull() | F.isnan(value.cast("double"))
    return F.when(gap, F.raise_error(F.lit(f"missing {what}")).cast("double")).otherwise(value)


def to_double(c: str | Column) -> Column:
    """Text or number to double; text that is no number becomes null."""
    text = col(c).cast("string")
    return F.when(text.rlike(PLAIN_TEXT) | text.rlike(NUMBER_TEXT), text.try_cast("double"))


def number_of(df: DataFrame, name: str) -> Column:
    """``to_double`` of a column; a column of numbers is not spelled out first."""
    c = quoted(name)
    return c.cast("double") if isinstance(df.schema[name].dataType, NUMBERS) else to_double(c)


def safe_div(a: Column, b: Column, default: float = 0.0) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(default))


def log1p(c: str | Column) -> Column:
    return F.log1p(col(c))


def round_to(c: str | Column, digits: int) -> Column:
    """Round half to even, as array libraries do."""
    return F.bround(col(c), digits)


def is_close(a: Column, b: Column, atol: float = 1e-6, rtol: float = 0.0) -> Column:
    return F.abs(a - b) <= F.lit(atol) + F.lit(rtol) * F.abs(b)


def direction(c: str | Column) -> Column:
    return F.when(col(c) > 0, F.lit("toward fraud")).otherwise(F.lit("toward legitimate"))


def case(conditions: Sequence[tuple[Column, object]], default: object) -> Column:
    out = None
    for condition, value in conditions:
        out = F.when(condition, F.lit(value)) if out is None else out.when(condition, F.lit(value))
    return F.lit(default) if out is None else out.otherwise(F.lit(default))


def grid(start: float, stop: float, step: float) -> list[float]:
    """Equal steps from start up to, but without, stop."""
    return [start + i * step for i in range(math.ceil((stop - start) / step))]
