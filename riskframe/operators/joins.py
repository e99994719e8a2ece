"""Joins and set operations on result tables and partitions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.frames import join_on


def lookup(df: DataFrame, mapping: DataFrame, keys: Sequence[str], strict: bool = True) -> DataFrame:
    """Add the mapping's columns by key; with ``strict`` a key without an entry is an error."""
    if strict:
        unknown = join_on(df.select(*keys).distinct(), mapping.select(*keys), keys, "left_anti")
        found = unknown.limit(5).collect()
        if found:
            raise KeyError(f"No entry for {[tuple(r) for r in found]}")
    return join_on(df, mapping, keys, "left")


def align(left: DataFrame, right: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows of both frames that share a key, side by side."""
    return left.join(right, list(key))


def check_alignment(a: DataFrame, b: DataFrame, key: Sequence[str], label: str) -> DataFrame:
    """One row: matched rows, rows of one side only, rows whose labels differ."""
    left = a.select(*key, F.col(label).alias("__la"), F.lit(True).alias("__a"))
    right = b.select(*key, F.col(label).alias("__lb"), F.lit(True).alias("__b"))
    both = left.join(right, list(key), "full_outer")
    matched = F.col("__a").isNotNull() & F.col("__b").isNotNull()
    return both.agg(
        F.count_if(matched).alias("matched"),
        F.count_if(F.col("__b").isNull()).alias("only_left"),
        F.count_if(F.col("__a").isNull()).alias("only_right"),
        F.count_if(matched & ~F.col("__la").eqNullSafe(F.col("__lb"))).alias("label_differs"),
    )


def require_alignment(a: DataFrame, b: DataFrame, key: Sequence[str], label: str) -> None:
    seen = check_alignment(a, b, key, label).first()
    if seen["only_left"] or seen["only_right"] or seen["label_differs"]:
        raise ValueError(f"Predictions do not align with the partition: {seen.asDict()}")


def cohort_join(a: DataFrame, b: DataFrame, feature: str, names: tuple[str, str]) -> DataFrame:
    """Two feature tables side by side, value columns prefixed by cohort name."""
    values = [c for c in a.columns if c != feature]
    left, right = (
        part.select(feature, *[F.col(c).alias(f"{name}_{c}") for c in values])
        for part, name in ((a, names[0]), (b, names[1]))
    )
    return left.join(right, feature)


def union_all(*dfs: DataFrame) -> DataFrame:
    """Union by column name; a column a frame lacks is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def comparison_table(*rows: DataFrame) -> DataFrame:
    """Metric rows of several models in one table."""
    return union_all(*rows)
