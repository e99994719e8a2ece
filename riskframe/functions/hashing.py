"""Hashes of rows and seeded random numbers that depend on the row alone.

``md5`` is used wherever order or randomness matters: a retried task, another partition
count or another engine gives the same rows. ``xxhash64`` serves as a fast hash only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .values import col


def cell_text(c: str | Column, separator: str = "") -> Column:
    """A cell as text from which it can be told: null is ``\\N``, and backslashes and separators are escaped."""
    text = F.replace(col(c).cast("string"), F.lit("\\"), F.lit("\\\\"))
    text = F.replace(text, F.lit(separator), F.lit("\\" + separator)) if separator else text
    return F.coalesce(text, F.lit("\\N"))


def row_text(cells: Sequence[str | Column], separator: str) -> Column:
    """Cells as one text; different rows have different texts."""
    return F.concat_ws(separator, *[cell_text(c, separator) for c in cells])


def hash_token(key: Sequence[str | Column], seed: object) -> Column:
    """32 hex digits from key and seed; its text order is the seeded random order."""
    parts = [cell_text(k, "|" if len(key) > 1 else "") for k in key]
    return F.md5(F.concat_ws("|", *parts, F.lit(str(seed))))


def hex_number(token: Column, start: int, digits: int) -> Column:
    return F.conv(F.substring(token, start, digits), 16, 10).cast("bigint")


def uniform(key: Sequence[str | Column], seed: object) -> Column:
    """Number in [0, 1) from the first 32 bits of the token."""
    return hex_number(hash_token(key, seed), 1, 8).cast("double") / F.lit(4294967296.0)


def row_hash(cols: Sequence[str]) -> Column:
    """64-bit hash that tells null from an empty text."""
    return F.xxhash64(*[x for c in cols for x in (col(c).isNull(), col(c))])


