"""Exact quantiles (linear interpolation) on data of any size, in two passes.

The first pass counts and sketches: Spark's approximate percentiles have a guaranteed rank error,
so two of them enclose every wanted rank. The second pass counts the values outside these
brackets by interval, and the values inside one by one; both are summed before any shuffle, and
running sums give the exact ranks. Columns of few values have brackets without ends.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.frames import cut_lineage, join_on
from ..functions.values import fold_nan, quoted

#: Rank errors of the sketch are at most 1/ACCURACY of the values.
ACCURACY = 10_000
MARGIN = 3
#: Counted values of a group that one task puts in order.
WINDOW_ROWS = 1_000_000
INF = float("inf")


def melt(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Long form: one row per feature, NaN folded to null."""
    cells = F.array(*[
        F.struct(F.lit(c).alias("feature"), fold_nan(quoted(c).cast("double")).alias("value")) for c in cols
    ])
    return df.select(*map(quoted, by), F.explode(cells).alias("cell")).select(*map(quoted, by), "cell.feature", "cell.value")


def _brackets(df: DataFrame, cols: Sequence[str], probs: Sequence[float], by: Sequence[str], accuracy: int) -> DataFrame:
    """by..., feature, n, lo and hi (a value below and above each wanted rank), k0 and k1 (the ranks around it)."""
    shares = [s for p in probs for s in (max(p - MARGIN / accuracy, 0.0), min(p + MARGIN / accuracy, 1.0))]
    values = {c: fold_nan(quoted(c).cast("double")) for c in cols}
    sketched = df.groupBy(*map(quoted, by)).agg(*[
        F.struct(F.count(v).alias("n"), F.percentile_approx(v, shares, accuracy).alias("at")).alias(f"__{i}")
        for i, v in enumerate(values.values())
    ])
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"__{i}.n").alias("n"), F.col(f"__{i}.at").alias("at")) for i, c in enumerate(cols)])
    return _edges(sketched.select(*map(quoted, by), F.explode(cells).alias("c")).select(*map(quoted, by), "c.*"), by, probs, accuracy)


def _edges(long: DataFrame, by: Sequence[str], probs: Sequence[float], accuracy: int) -> DataFrame:
    """Brackets and ranks from counts and sketched percentiles."""
    many = F.col("n") >= MARGIN * accuracy

    def edge(j: int, p: float, low: bool) -> Column:
        inside = p > MARGIN / accuracy if low else p < 1 - MARGIN / accuracy
        end = F.lit(-INF if low else INF)
        return F.when(many, F.col("at")[2 * j + (not low)]).otherwise(end) if inside else end

    rank = [F.lit(float(p)) * (F.col("n") - 1) for p in probs]
    return long.select(
        *map(quoted, by), "feature", "n",
        F.array(*[edge(j, p, True) for j, p in enumerate(probs)]).alias("lo"),
        F.array(*[edge(j, p, False) for j, p in enumerate(probs)]).alias("hi"),
        F.array(*[F.floor(r) for r in rank]).alias("k0"), F.array(*[F.ceil(r) for r in rank]).alias("k1"),
    )


def exact_quantiles(
    df: DataFrame, cols: Sequence[str], probs: Sequence[float], by: Sequence[str] = (), accuracy: int = ACCURACY
) -> DataFrame:
    """Long table: by..., feature, prob, value. Missing cells are left out of the count."""
    keys = [*by, "feature"]
    brackets = cut_lineage(_brackets(df, cols, probs, by, accuracy))
    cells = melt(df, cols, by).filter(F.col("value").isNotNull())
    met = join_on(cells, brackets.select(*map(quoted, keys), "lo", "hi"), keys)
    counts = _interval_counts(met, keys, len(probs), {"m": F.count(F.lit(1))})
    return _at_ranks(counts, brackets, keys, probs)


def quantiles_without(
    df: DataFrame, cols: Sequence[str], probs: Sequence[float], fold: str, numbers: Sequence[int], accuracy: int = ACCURACY
) -> DataFrame:
    """Long table: fold, feature, prob, value of the rows outside each fold; two passes for all folds together.

    The brackets of all training sides are one widened bracket per rank. Values are counted in
    them by fold, and a side's count is the total less its fold's.
    """
    shares = [s for p in probs for s in (max(p - MARGIN / accuracy, 0.0), min(p + MARGIN / accuracy, 1.0))]
    found = []
    for i, c in enumerate(cols):
        v = fold_nan(quoted(c).cast("double"))
        for j, f in enumerate(numbers):
            side = F.when(quoted(fold) != f, v)
            found.append(F.struct(F.count(side).alias("n"), F.percentile_approx(side, shares, accuracy).alias("at")).alias(f"__{i}_{j}"))
    cells = F.array(*[
        F.struct(F.lit(f).alias("fold"), F.lit(c).alias("feature"), F.col(f"__{i}_{j}.n").alias("n"), F.col(f"__{i}_{j}.at").alias("at"))
        for i, c in enumerate(cols) for j, f in enumerate(numbers)
    ])
    brackets = cut_lineage(_edges(df.agg(*found).select(F.explode(cells).alias("c")).select("c.*"), ["fold"], probs, accuracy))
    places = range(len(probs))
    wide = brackets.groupBy("feature").agg(
        F.array(*[F.min(F.col("lo")[j]) for j in places]).alias("lo"), F.array(*[F.max(F.col("hi")[j]) for j in places]).alias("hi"))
    met = join_on(melt(df, cols, [fold]).filter(F.col("value").isNotNull()), wide, ["feature"])
    held = {f"m_{j}": F.count_if(quoted(fold) != f) for j, f in enumerate(numbers)}
    counts = _interval_counts(met, ["feature"], len(probs), held)
    sides = F.array(*[F.struct(F.lit(f).alias("fold"), F.col(f"m_{j}").alias("m")) for j, f in enumerate(numbers)])
    counts = counts.select("feature", "exact", "place", F.explode(sides).alias("c")).select("feature", "exact", "place", "c.*").filter("m > 0")
    return _at_ranks(counts, brackets, ["fold", "feature"], probs).withColumnRenamed("fold", fold)


def _interval_counts(met: DataFrame, keys: Sequence[str], n: int, sums: dict[str, Column]) -> DataFrame:
    """keys..., exact (a value inside a bracket) or null, place (where it comes) and the sums."""
    v, places = F.col("value"), range(n)
    inside = reduce(lambda a, b: a | b, [(v >= F.col("lo")[j]) & (v <= F.col("hi")[j]) for j in places])
    slot = sum(((v > F.col("hi")[j]).cast("int") for j in places), F.lit(0))
    return met.groupBy(*map(quoted, keys), F.when(inside, v).alias("exact"), F.when(~inside, slot).alias("slot")).agg(
        F.min(v).alias("place"), *[s.alias(name) for name, s in sums.items()])


def running_counts(counts: DataFrame, keys: Sequence[str], rows: int | None = None) -> DataFrame:
    """Add ``upto``, the running sum of ``m`` along ``place``; no task holds more than about ``rows`` of a group.

    Larger groups are cut at values of their own into parts, which start from the sums of the parts before.
    """
    stored = cut_lineage(counts)
    most = stored.groupBy(*map(quoted, keys)).count().agg(F.max("count")).first()[0] or 0
    parts = -(-most // (rows or WINDOW_ROWS))
    if parts > 1:
        shares = [i / parts for i in range(1, parts)]
        cuts = cut_lineage(stored.groupBy(*map(quoted, keys)).agg(F.percentile_approx("place", shares, 10 * parts).alias("__cuts")))
        stored = join_on(stored, cuts, keys).withColumn("__part", F.size(F.filter("__cuts", lambda c: c < F.col("place")))).drop("__cuts")
    else:
        stored = stored.withColumn("__part", F.lit(0))
    inner = Window.partitionBy(*map(quoted, keys), "__part").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    placed = stored.withColumn("upto", F.sum("m").over(inner))
    if parts > 1:
        before = Window.partitionBy(*map(quoted, keys)).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
        sums = stored.groupBy(*map(quoted, keys), "__part").agg(F.sum("m").alias("__m"))
        sums = sums.select(*map(quoted, keys), "__part", F.coalesce(F.sum("__m").over(before), F.lit(0)).alias("__before"))
        placed = join_on(placed, sums, [*keys, "__part"]).withColumn("upto", F.col("upto") + F.col("__before")).drop("__before")
    return placed.drop("__part")


def _at_ranks(counts: DataFrame, brackets: DataFrame, keys: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """keys..., prob, value from counts by interval and the ranks around each wanted share."""
    places = range(len(probs))
    ranks = join_on(running_counts(counts, keys), brackets.select(*map(quoted, keys), "k0", "k1"), keys)

    def at(k: Column) -> Column:
        return F.max(F.when((k >= F.col("upto") - F.col("m")) & (k < F.col("upto")), F.col("exact")))

    found = ranks.groupBy(*map(quoted, keys)).agg(
        F.array(*[at(F.col("k0")[j]) for j in places]).alias("v0"), F.array(*[at(F.col("k1")[j]) for j in places]).alias("v1"))
    whole = join_on(brackets.select(*map(quoted, keys), "n", "k0"), found, keys, "left")

    def value(j: int, p: float) -> Column:
        share = F.lit(float(p)) * (F.col("n") - 1) - F.col("k0")[j]
        low, high = F.col("v0")[j], F.col("v1")[j]
        return F.when(share == 0, low).otherwise(low * (1 - share) + high * share)

    answers = F.array(*[F.struct(F.lit(float(p)).alias("prob"), value(j, p).alias("value")) for j, p in enumerate(probs)])
    return whole.select(*map(quoted, keys), F.explode(answers).alias("q")).select(*map(quoted, keys), "q.*")


def quantile(df: DataFrame, c: str, q: float, by: Sequence[str] = (), **options) -> DataFrame:
    return exact_quantiles(df, [c], [q], by, **options)


def quantile_value(df: DataFrame, c: str, q: float, **options) -> float | None:
    return exact_quantiles(df, [c], [q], **options).first()["value"]


def quantile_columns(
    df: DataFrame, cols: Sequence[str], named: dict[str, float], by: Sequence[str] = (), **options
) -> DataFrame:
    """One row per group and feature with one column per named quantile."""
    long = exact_quantiles(df, cols, list(named.values()), by, **options)
    return long.groupBy(*map(quoted, by), "feature").agg(*[
        F.max(F.when(F.col("prob") == p, F.col("value"))).alias(name) for name, p in named.items()
    ])


def cap_at_quantile(df: DataFrame, c: str, q: float = 0.995, **options) -> DataFrame:
    """Rows at or below the quantile of a column."""
    return df.filter(quoted(c) <= F.lit(quantile_value(df, c, q, **options)))
