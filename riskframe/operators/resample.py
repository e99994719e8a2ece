"""Synthetic minority oversampling inside the training rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.frames import cut_lineage, explode_count
from ..functions.hashing import hash_token, hex_number, uniform
from ..schema import SEED
from .neighbours import LEAF_ROWS, nearest_neighbours
from .quality import attach_group_facts
from .sampling import class_sizes, hash_segments, parts_frame

CHUNK = 100_000


def smote(
    df: DataFrame, label: str, key: str, vector: str, k: int = 5, seed: int = SEED,
    leaf_rows: int = LEAF_ROWS,
) -> DataFrame:
    """Rows ``key, label, vector, synthetic`` with the minority raised to the majority's size.

    A new point lies between a minority row and one of its k nearest minority neighbours.
    Every minority row starts the same number of new points; the remainder goes to the
    first rows of the seeded order. Picks depend on key, draw number and seed.
    """
    sizes = class_sizes(df, label)
    if len(sizes) != 2:
        raise ValueError("Oversampling needs exactly two classes")
    minority, majority = sorted(sizes, key=lambda c: sizes[c])
    need, few = sizes[majority] - sizes[minority], sizes[minority]
    rows = df.select(F.col(key), F.col(label), F.col(vector).cast("array<double>").alias(vector))
    real = rows.withColumn("synthetic", F.lit(False))
    if need == 0:
        return real
    if few <= k:
        raise ValueError(f"{few} minority rows cannot have {k} neighbours each")
    base = cut_lineage(rows.filter(F.col(label) == minority))
    each, extra = divmod(need, few)
    dealt = hash_segments(base, label, parts_frame(base, label, {minority: [extra, few - extra]}), [key], f"{seed}/smote", "__part")
    counted = dealt.withColumn("__draws", F.lit(each) + F.when(F.col("__part") == 0, 1).otherwise(0))

    near = cut_lineage(nearest_neighbours(base, key, vector, k, seed, leaf_rows))
    ends = base.select(F.col(key).alias("neighbour"), F.col(vector).alias("__end"))
    # One row may be the neighbour of very many.
    sought = near.groupBy("neighbour").agg(F.count(F.lit(1)).alias("n")).join(ends, "neighbour")
    lines = attach_group_facts(near, sought, ["neighbour"], "inner").groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct("rank", "__end"))).alias("__ends")
    )
    # The k end points travel with their row, so the new rows are written without a shuffle.
    drawn = explode_count(counted.join(lines, key), "__draws", "draw", [key], CHUNK, spread=each >= CHUNK)
    pick = (hex_number(hash_token([key, "draw"], f"{seed}/neighbour"), 1, 8) % k).cast("int")
    drawn = drawn.withColumns({"__end": F.col("__ends")[pick]["__end"], "__step": uniform([key, "draw"], f"{seed}/step")})
    moved = F.zip_with(vector, "__end", lambda a, b: a + (b - a) * F.col("__step"))
    made = drawn.select(
        F.concat_ws("+", F.col(key).cast("string"), F.col("draw").cast("string")).alias(key),
        F.col(label), moved.alias(vector), F.lit(True).alias("synthetic"),
    )
    return real.withColumn(key, F.col(key).cast("string")).unionByName(made)


def parity(df: DataFrame, label: str) -> Sequence[tuple]:
    """Class sizes after resampling."""
    return list(class_sizes(df, label).items())
