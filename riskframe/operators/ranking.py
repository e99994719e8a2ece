"""Running sums and ranks over an order that no single task could hold.

The order column is cut at explicit values into buckets of bounded size. Each bucket is
summed, the short table of bucket sums gives every bucket its starting point, and a window
inside the bucket does the rest. The cut values are literals, so a retried task sees the
same buckets.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.frames import cut_lineage, join_on

ROWS_PER_BUCKET = 1_000_000
#: Cut values found in one pass; more buckets are cut in a second level inside these.
CUTS = 10_000


def _with_bucket(df: DataFrame, order: str, rows: int, rows_per_bucket: int) -> tuple[DataFrame, int]:
    """Bucket numbers in order, about ``rows_per_bucket`` rows each."""
    buckets = max(1, math.ceil(rows / rows_per_bucket))
    first = min(buckets, CUTS)
    coarse = _cut(df, order, first)
    inner = math.ceil(buckets / first)
    if inner == 1:
        return coarse, first
    # Second level: cuts inside every bucket of the first, joined by its number.
    shares = [i / inner for i in range(1, inner)]
    cuts = cut_lineage(coarse.groupBy("__bucket").agg(F.percentile_approx(order, shares, 10 * inner).alias("__cuts")))
    fine = join_on(coarse, cuts, ["__bucket"])
    place = F.size(F.filter("__cuts", lambda c: c <= F.col(order)))
    return fine.withColumn("__bucket", (F.col("__bucket").cast("bigint") * inner + place)).drop("__cuts"), buckets


def _cut(df: DataFrame, order: str, buckets: int) -> DataFrame:
    if buckets == 1:
        return df.withColumn("__bucket", F.lit(0).cast("bigint"))
    shares = [i / buckets for i in range(1, buckets)]
    found = df.agg(F.percentile_approx(order, shares, 10 * buckets).alias("cuts")).first()["cuts"]
    splits = [float("-inf"), *sorted(set(found)), float("inf")]
    bucketed = Bucketizer(splits=splits, inputCol=order, outputCol="__bucket", handleInvalid="keep").transform(df)
    return bucketed.withColumn("__bucket", F.col("__bucket").cast("bigint"))


def prefix_sums(
    df: DataFrame,
    order: str,
    sums: Mapping[str, Column],
    by: Sequence[str] = (),
    descending: bool = True,
    ahead: Sequence[str] = (),
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """Add running totals (``name``) and group totals (``total_name``) along ``order``.

    ``order`` is a double column, unique within a group. ``ahead`` names columns whose
    value on the following row is added as ``next_<column>``.
    """
    added = df.withColumns({f"__x_{name}": value for name, value in sums.items()})
    stored = cut_lineage(added)
    bucketed, _ = _with_bucket(stored, order, stored.count(), rows_per_bucket)
    position = F.col(order).desc() if descending else F.col(order).asc()

    keys = [*by, "__bucket"]
    heads = F.struct(*[F.col(c) for c in ahead]) if ahead else F.lit(None).cast("string")
    pick = F.max_by if descending else F.min_by
    per_bucket = bucketed.groupBy(*keys).agg(
        *[F.sum(f"__x_{name}").alias(f"__s_{name}") for name in sums],
        pick(heads, F.col(order)).alias("__head"),
    )
    across = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    bucket_order = across.orderBy(F.col("__bucket").desc() if descending else F.col("__bucket").asc())
    before = bucket_order.rowsBetween(Window.unboundedPreceding, -1)
    starts = per_bucket.select(
        *keys,
        F.lead("__head").over(bucket_order).alias("__next_head"),
        *[F.coalesce(F.sum(f"__s_{n}").over(before), F.lit(0)).alias(f"__b_{n}") for n in sums],
        *[F.sum(f"__s_{n}").over(across).alias(f"total_{n}") for n in sums],
    )
    joined = join_on(bucketed, cut_lineage(starts), keys)
    ordered = Window.partitionBy(*keys).orderBy(position)
    running = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = F.lead(F.lit(True)).over(ordered).isNull()
    columns = {name: F.col(f"__b_{name}") + F.sum(f"__x_{name}").over(running) for name in sums}
    columns |= {
        f"next_{c}": F.when(last, F.col(f"__next_head.{c}")).otherwise(F.lead(c).over(ordered))
        for c in ahead
    }
    scratch = ["__bucket", "__next_head", *[f"__x_{n}" for n in sums], *[f"__b_{n}" for n in sums]]
    return joined.withColumns(columns).drop(*scratch)


def distributed_rank(
    df: DataFrame,
    order: str,
    by: Sequence[str] = (),
    descending: bool = False,
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """Add ``rank`` 1..n along a unique order column."""
    ranked = prefix_sums(df, order, {"rank": F.lit(1).cast("bigint")}, by, descending,
                         rows_per_bucket=rows_per_bucket)
    return ranked.drop("total_rank")


def thin(df: DataFrame, order: str, points: int = 1500, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Keep every k-th row along ``order`` so that about ``points`` remain for a plot."""
    ranked = prefix_sums(df, order, {"rank": F.lit(1).cast("bigint")}, (), False,
                         rows_per_bucket=rows_per_bucket)
    stride = F.greatest(F.lit(1).cast("bigint"), F.expr(f"total_rank div {points}"))
    return ranked.filter((F.col("rank") - 1) % stride == 0).drop("rank", "total_rank")


def numbered(df: DataFrame, order: Sequence[Column], name: str = "rank") -> DataFrame:
    """Add 1..n along a sort of any columns.

    The rows are range-partitioned by the sort and stored; each then adds its place within its
    part to the rows of the parts before, of which there is one number per part.
    """
    placed = cut_lineage(df.orderBy(*order).withColumn("__id", F.monotonically_increasing_id()))
    part, place = F.shiftright("__id", 33), F.col("__id").bitwiseAND((1 << 33) - 1)
    sizes = placed.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__n"))
    upto = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("__part", F.coalesce(F.sum("__n").over(upto), F.lit(0)).alias("__start"))
    joined = join_on(placed.withColumn("__part", part), starts, ["__part"])
    return joined.withColumn(name, F.col("__start") + place + 1).drop("__id", "__part", "__start")
