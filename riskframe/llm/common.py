"""Small helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Side of a join that may be sent to every executor, in bytes of its rows.
BROADCAST_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def remainder(key: str, n: int) -> Column:
    """crc32 of the key's text modulo n; null for a null key."""
    return F.pmod(F.crc32(F.col(key).cast("string")), F.lit(n))


def text_hash(text: str = "text") -> Column:
    """Tells rows of one id apart; null and empty text differ."""
    return F.xxhash64(F.col(text).isNull(), F.col(text))


def null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Join by name where null equals null; ``right``'s keys are dropped."""
    right = right.select(*[F.col(f"`{c}`").alias(f"__r_{c}") if c in keys else F.col(f"`{c}`") for c in right.columns])
    same = reduce(lambda a, b: a & b, [left[f"`{k}`"].eqNullSafe(right[f"__r_{k}"]) for k in keys])
    joined = left.join(right, same, how)
    return joined if how in ("left_semi", "left_anti") else joined.drop(*[f"__r_{k}" for k in keys])


#: Columns of a dense vector's pieces: which vector, first place, 64-bit integers.
PIECES = "which long, first long, sums binary"


def pieces_of(which: int, sums: np.ndarray, step: int) -> Iterator[tuple[int, int, bytes]]:
    """The pieces of a vector that are not all zero; the first axis is cut."""
    for i in range(0, len(sums), step):
        if sums[i : i + step].any():
            yield which, i, np.ascontiguousarray(sums[i : i + step], np.int64).tobytes()


def pieces_batch(pieces: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return pa.record_batch(dict(zip(("which", "first", "sums"), map(list, zip(*pieces)))))


def add_pieces(parts: DataFrame) -> DataFrame:
    """One row per piece: the sum of what all tasks sent. A task holds its share of the vectors only."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for which, first, part in zip(*(c.to_pylist() for c in batch.columns)):
                v = np.frombuffer(part, np.int64)
                if (which, first) in held:
                    held[which, first] += v
                else:
                    held[which, first] = v.copy()
        if held:
            yield pieces_batch([(a, b, v.tobytes()) for (a, b), v in held.items()])

    return parts.repartition("which", "first").mapInArrow(add, PIECES)
