"""Seeded sampling, stratified splits and folds.

The random order is the order of an md5 token made from the row key and the seed. Rows go
to a part by comparing their token with a few cut tokens, so the rows themselves are never
sorted or shuffled; only the cuts have to be found. For that one scan counts the tokens by class and
first four digits, which gives the class sizes as well, and a second one orders the tokens of the few cells a cut falls into. Class
sizes, quotas and cuts are tables with one row per class.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from fractions import Fraction

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.frames import cut_lineage, join_on
from ..functions.hashing import hash_token
from ..functions.values import quoted
from ..schema import FOLDS, SEED, TEST_SIZE

DIGITS = 4


def class_counts(df: DataFrame, label: str) -> DataFrame:
    """label, n: rows per class, stored."""
    counts = cut_lineage(df.groupBy(quoted(label).alias(label)).agg(F.count(F.lit(1)).alias("n")))
    if not counts.filter(quoted(label).isNull()).isEmpty():
        raise ValueError(f"'{label}' has missing values")
    return counts


def class_sizes(df: DataFrame, label: str) -> dict:
    """Rows per class of a label with few values, ordered by class."""
    return dict(sorted(tuple(r) for r in class_counts(df, label).toLocalIterator()))


def allocate(counts: DataFrame, label: str, draws: int, total: int) -> DataFrame:
    """label, n, quota: ``draws`` shared in proportion; largest remainders get the rest, ties in class order."""
    exact = F.col("n").cast("decimal(38,0)") * F.lit(draws).cast("decimal(19,0)")
    whole = F.floor(exact / F.lit(total))
    # Division of decimals rounds; the remainder tells whether it went one too far.
    split = counts.withColumn("exact", exact.cast("decimal(38,0)")).withColumn("base", whole.cast("decimal(38,0)"))
    split = split.withColumn("rest", F.col("exact") - F.col("base") * F.lit(total))
    split = split.withColumn("base", F.when(F.col("rest") < 0, F.col("base") - 1).otherwise(F.col("base")))
    split = split.withColumn("rest", (F.col("exact") - F.col("base") * F.lit(total)).cast("decimal(38,0)"))
    left = F.lit(draws) - F.sum("base").over(Window.partitionBy())
    place = F.row_number().over(Window.orderBy(F.desc("rest"), quoted(label)))
    quota = (F.col("base") + (place <= left).cast("int")).cast("bigint")
    return split.select(quoted(label), "n", quota.alias("quota"))


def split_quotas(spark: SparkSession, sizes: Mapping, test_size: float = TEST_SIZE) -> dict:
    """Training rows per class of a few known sizes; the test part of the whole is rounded up."""
    counts = spark.createDataFrame([(c, n) for c, n in sizes.items()], "label int, n bigint")
    return {r["label"]: r["quota"] for r in _train_quotas(counts, "label", sum(sizes.values()), test_size).collect()}


def _train_quotas(counts: DataFrame, label: str, total: int, test_size: float) -> DataFrame:
    test = -((-Fraction(str(test_size)) * total) // 1)
    return allocate(counts, label, total - int(test), total)


def parts_frame(df: DataFrame, label: str, sizes: Mapping) -> DataFrame:
    """label, parts: given part sizes of a few classes."""
    kind = df.schema[label].dataType.simpleString()
    rows = [(c, [int(n) for n in parts]) for c, parts in sizes.items()]
    return df.sparkSession.createDataFrame(rows, f"`{label}` {kind}, parts array<bigint>")


def _starts() -> Column:
    """Where the parts after the first begin, from the array ``parts``."""
    return F.expr("transform(sequence(1, size(parts) - 1), i -> aggregate(slice(parts, 1, i), 0L, (a, b) -> a + b))")


def _counted(df: DataFrame, label: str, key: Sequence[str], seed: object) -> tuple[DataFrame, DataFrame]:
    """Every row's label and token, and the stored number of tokens per label and first digits."""
    tokens = df.select(quoted(label), hash_token(key, seed).alias("token")).withColumn("cell", F.substring("token", 1, DIGITS))
    return tokens, cut_lineage(tokens.groupBy(quoted(label), "cell").agg(F.count(F.lit(1)).alias("n")))


def _sizes_of(counts: DataFrame, label: str, least: int, text: str) -> tuple[DataFrame, int]:
    """label, n from the counted tokens, and the total; every class must be named and have at least ``least`` rows."""
    sizes = counts.groupBy(quoted(label)).agg(F.sum("n").alias("n"))
    facts = sizes.agg(F.min("n").alias("least"), F.sum("n").alias("total"), F.count_if(quoted(label).isNull()).alias("nameless")).first()
    if facts["nameless"]:
        raise ValueError(f"'{label}' has missing values")
    if (facts["least"] or 0) < least:
        raise ValueError(f"Every class needs at least {text} rows")
    return sizes, facts["total"]


def _cut_tokens(tokens: DataFrame, counts: DataFrame, label: str, wanted: DataFrame) -> DataFrame:
    """label, cuts (tokens at the wanted ranks), repeated (a cut between equal tokens); ``wanted``: label, k."""
    upto = Window.partitionBy(quoted(label)).orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)
    counts = counts.withColumn("upto", F.sum("n").over(upto))
    hit = join_on(wanted, counts, [label]).filter((F.col("k") >= F.col("upto") - F.col("n")) & (F.col("k") < F.col("upto")))
    hit = cut_lineage(hit.select(quoted(label), "cell", "k", (F.col("upto") - F.col("n")).alias("below")))
    near = join_on(tokens, hit.select(quoted(label), "cell").distinct(), [label, "cell"], "left_semi")
    order = Window.partitionBy(quoted(label), "cell").orderBy("token")
    near = near.withColumn("at", F.row_number().over(order).cast("bigint") - 1).withColumn("ahead", F.lag("token").over(order))
    found = join_on(near, hit, [label, "cell"]).filter(F.col("at") + F.col("below") == F.col("k"))
    return found.groupBy(quoted(label)).agg(
        F.array_sort(F.collect_list("token")).alias("cuts"),
        F.max(F.coalesce(F.col("ahead") == F.col("token"), F.lit(False))).alias("repeated"),
    )


def hash_segments(
    df: DataFrame, label: str, parts: DataFrame, key: Sequence[str], seed: object, name: str,
    counted: tuple[DataFrame, DataFrame] | None = None,
) -> DataFrame:
    """Cut each class, in its random order, into consecutive parts of the given sizes.

    ``parts`` maps a class to the sizes of its parts, which must add up to its rows. Adds the
    0-based part number. Keys that repeat at a cut raise, whatever the number of rows.
    """
    tokens, counts = counted or _counted(df, label, key, seed)
    total = F.expr("aggregate(parts, 0L, (a, b) -> a + b)")
    plan = parts.withColumn("starts", _starts()).withColumn("total", total)
    plan = plan.withColumn("ranks", F.expr("array_sort(array_distinct(filter(starts, s -> s < total)))"))
    cuts = _cut_tokens(tokens, counts, label, plan.select(quoted(label), F.explode("ranks").alias("k")))
    # A cut of rank s stands for every part that starts there, empty parts included.
    steps = plan.select(quoted(label), F.expr("transform(ranks, r -> size(filter(starts, s -> s = r)))").alias("__steps"))
    cuts = cut_lineage(join_on(steps, cuts, [label], "left"))
    if not cuts.filter("repeated").isEmpty():
        raise ValueError(f"Key {list(key)} is not unique: rows at a cut cannot be told apart")
    joined = join_on(df.withColumn("__token", hash_token(key, seed)), cuts.drop("repeated"), [label])
    passed = F.zip_with(
        F.coalesce("cuts", F.array().cast("array<string>")), "__steps",
        lambda c, s: F.when(c <= F.col("__token"), s).otherwise(F.lit(0)),
    )
    part = F.aggregate(passed, F.lit(0), lambda a, b: a + b)
    return joined.withColumn(name, part).drop("__token", "__steps", "cuts")


def stratified_split(
    df: DataFrame, label: str, key: Sequence[str], test_size: float = TEST_SIZE, seed: int = SEED
) -> DataFrame:
    """Add ``split`` ('train' or 'test') with exact counts per class."""
    if not 0 < test_size < 1:
        raise ValueError("test_size must lie between 0 and 1")
    counted = _counted(df, label, key, f"{seed}/split")
    sizes, total = _sizes_of(counted[1], label, 2, "two")
    quotas = _train_quotas(sizes, label, total, test_size)
    parts = quotas.select(quoted(label), F.array(F.col("n") - F.col("quota"), F.col("quota")).alias("parts"))
    cut = hash_segments(df, label, parts, key, f"{seed}/split", "__part", counted)
    return cut.withColumn("split", F.when(F.col("__part") == 0, "test").otherwise("train")).drop("__part")


def stratified_folds(df: DataFrame, label: str, key: Sequence[str], k: int = FOLDS, seed: int = SEED) -> DataFrame:
    """Add ``fold`` 1..k; per class and overall the folds differ by one row at most."""
    counted = _counted(df, label, key, f"{seed}/folds")
    sizes, _ = _sizes_of(counted[1], label, k, str(k))
    end = F.sum("n").over(Window.orderBy(quoted(label)).rowsBetween(Window.unboundedPreceding, 0))
    ends = sizes.withColumn("end", end).withColumn("start", end - F.col("n"))
    size = F.expr(f"transform(sequence(0, {k - 1}), f -> ((end - f + {k - 1}) div {k}) - ((start - f + {k - 1}) div {k}))")
    cut = hash_segments(df, label, ends.select(quoted(label), size.alias("parts")), key, f"{seed}/folds", "fold", counted)
    return cut.withColumn("fold", F.col("fold") + 1)


def sample_exact(df: DataFrame, n: int, key: Sequence[str], seed: int = SEED) -> DataFrame:
    """Exactly n rows (or all, when there are fewer), without replacement."""
    whole = df.withColumn("__all", F.lit(0))
    counted = _counted(whole, "__all", key, seed)
    total = counted[1].agg(F.sum("n")).first()[0] or 0
    if total <= n:
        return df
    cut = hash_segments(whole, "__all", parts_frame(whole, "__all", {0: [n, total - n]}), key, seed, "__part", counted)
    return cut.filter("__part = 0").drop("__part", "__all")


def sample_by_class(
    df: DataFrame, label: str, n: int, key: Sequence[str], seed: int = SEED, majority: object = 0
) -> DataFrame:
    """n rows of the majority class and every row of the others."""
    few = sample_exact(df.filter(quoted(label) == majority), n, key, seed)
    return few.unionByName(df.filter(quoted(label) != majority))


def pick(df: DataFrame, **key) -> DataFrame:
    """The row or rows with the given key values."""
    for name, value in key.items():
        df = df.filter(quoted(name) == value)
    return df


def preview(df: DataFrame, n: int = 5) -> DataFrame:
    return df.limit(n)
