"""Mixing sources to target weights by Poisson replication.

A source of size n (characters) whose target is share w of a corpus of total size T gets the
mean repetition rate w * T / n. Each document draws its count by inverting the Poisson
distribution at a uniform number hashed from its id and the seed, is exploded by that count and
dealt out by a hash of id, copy and seed: a retried task gives the same rows.

Null source is a source of its own. Null text has size 0; a source of total size 0 gets rate 0
when weighted by characters (it cannot reach any share). A null id hashes like the text "null".
Rows with the same id draw the same count. An empty table gives an empty result. Extra columns are
kept, except that ``copy`` is replaced when ``docs`` has such a column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.frames import cut_lineage
from .common import BROADCAST_BYTES

SEED = 42


def uniform(key: str, seed: int) -> Column:
    """Number strictly between 0 and 1 from the first 48 bits of an md5."""
    token = F.md5(F.concat_ws("|", F.coalesce(F.col(key).cast("string"), F.lit("null")), F.lit(str(seed))))
    return (F.conv(F.substring(token, 1, 12), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 48))


def source_rates(docs: DataFrame, weights: dict[str | None, float] | None = None, total: float | None = None) -> DataFrame:
    """source, size, rate. Without weights every source gets the same share; ``total`` defaults to the corpus size."""
    size = F.sum(F.length(F.coalesce(F.col("text"), F.lit("")))).alias("size")
    sizes = docs.groupBy("source").agg(size)
    every = Window.partitionBy()
    whole = F.lit(float(total)) if total is not None else F.sum("size").over(every).cast("double")
    if weights is None:
        share = F.lit(1.0) / F.count(F.lit(1)).over(every)
    else:
        scale = float(sum(weights.values()))
        share = F.lit(0.0)
        for name, w in weights.items():
            share = F.when(F.col("source").eqNullSafe(F.lit(name)), F.lit(w / scale)).otherwise(share)
    rate = F.when(F.col("size") > 0, share * whole / F.col("size")).otherwise(0.0)
    return sizes.select("source", "size", rate.alias("rate"))


def poisson_cuts(rates: DataFrame) -> DataFrame:
    """source, first, cuts: the distribution function at first, first + 1, ...

    Logarithms of the probabilities are running sums, so large rates neither overflow nor vanish.
    Counts further than 12 standard deviations (and 30) from the rate have no probability that a
    double could show; the sums start there, from Stirling's series.
    """
    wide = 12 * F.sqrt("rate") + 30
    first, last = F.greatest(F.lit(0), F.floor(F.col("rate") - wide)).cast("long"), F.ceil(F.col("rate") + wide).cast("long")
    steps = rates.filter("rate > 0").select("source", "rate", first.alias("first"), last.alias("last"))
    steps = steps.select("source", "rate", "first", F.explode(F.sequence("first", "last")).alias("k"))
    upto = Window.partitionBy("source").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    n = F.col("first").cast("double")
    log_factorial = F.when(F.col("first") == 0, 0.0).otherwise(
        n * F.ln(n) - n + F.ln(2 * F.pi() * n) / 2 + 1 / (12 * n) - 1 / (360 * n * n * n))
    step = F.when(F.col("k") == F.col("first"), n * F.ln("rate") - F.col("rate") - log_factorial).otherwise(F.ln("rate") - F.ln("k"))
    cuts = steps.withColumn("p", F.exp(F.sum(step).over(upto))).withColumn("cut", F.sum("p").over(upto))
    ordered = F.array_sort(F.collect_list(F.struct("k", "cut")))
    return cuts.groupBy("source", "first").agg(F.transform(ordered, lambda x: x["cut"]).alias("cuts"))


def repetitions(docs: DataFrame, cuts: DataFrame, key: str = "doc_id", seed: int = SEED, name: str = "__n") -> DataFrame:
    """``docs`` with the drawn count; sources without cuts draw 0."""
    stored = cut_lineage(cuts)
    held = stored.agg(F.sum(F.size("cuts") * 8 + F.coalesce(F.octet_length("source"), F.lit(0)) + 64)).head()[0] or 0
    side = stored.select(F.col("source").alias("__source"), F.col("first").alias("__first"), F.col("cuts").alias("__cuts"))
    side = F.broadcast(side) if held <= BROADCAST_BYTES else side
    joined = docs.withColumn("__u", uniform(key, seed)).join(side, F.col("source").eqNullSafe(F.col("__source")), "left")
    below = F.expr("__first + size(filter(__cuts, c -> c < __u))").cast("int")
    return joined.withColumn(name, F.when(F.col("__cuts").isNull(), 0).otherwise(below)).drop("__source", "__first", "__cuts", "__u")


def mix_sources(docs: DataFrame, weights: dict[str | None, float] | None = None, total: float | None = None,
                key: str = "doc_id", seed: int = SEED) -> DataFrame:
    """Every document as often as drawn, with ``copy`` (from 1), in globally shuffled order."""
    drawn = repetitions(docs.drop("copy"), poisson_cuts(source_rates(docs, weights, total)), key, seed)
    copies = drawn.filter("__n > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("__n")))).drop("__n")
    place = F.md5(F.concat_ws("|", F.coalesce(F.col(key).cast("string"), F.lit("null")), F.col("copy").cast("string"), F.lit(str(seed))))
    dealt = copies.withColumn("__place", place).repartition("__place")
    return dealt.sortWithinPartitions("__place").drop("__place")
