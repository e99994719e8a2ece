"""Frame helpers: lineage cuts, size-checked broadcasts, null-safe joins."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .values import quoted

#: Number of the folder a dealt row is stored in.
DEAL = "__deal"
#: Parts of rows dealt without a fixed number of partitions.
PARTS_PER_CORE = 8


def shared_folder(spark: SparkSession) -> str:
    """The folder for stored intermediate tables, reachable from every executor.

    A folder of one machine is accepted in local mode only; a cluster must name one.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder is None:
        if not context.master.startswith("local"):
            raise RuntimeError("Set spark.checkpoint.dir to a folder every executor can reach")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="riskframe-"))
        folder = context.getCheckpointDir()
    return f"{folder}/riskframe"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Store a frame that is read several times as a table in the cluster's shared folder.

    A lost executor costs no recomputation, later reads take only the columns they need, and
    the table's size lets Spark choose its joins.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, keys: Sequence[str], partitions: int | None = None, ordered: bool = False) -> DataFrame:
    """Rows dealt by their keys, for work that computes much per row.

    With a fixed number of partitions and ``ordered`` rows every task sees the same rows in the
    same order wherever it runs, so seeded fits repeat. Otherwise every core gets several parts.
    """
    n = partitions or PARTS_PER_CORE * df.sparkSession.sparkContext.defaultParallelism
    dealt = df.repartition(n, *[quoted(k) for k in keys])
    return dealt.sortWithinPartitions(*[quoted(k) for k in keys]) if ordered else dealt


def deal(df: DataFrame, keys: Sequence[str], parts: int) -> DataFrame:
    """Rows stored once in ``parts`` folders by the hash of their keys, sorted by them; ``in_parts`` reads them for fits."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    placed = df.repartition(parts, *[quoted(k) for k in keys]).withColumn(DEAL, F.spark_partition_id())
    placed.sortWithinPartitions(DEAL, *[quoted(k) for k in keys]).write.partitionBy(DEAL).parquet(path)
    return spark.read.schema(placed.schema).parquet(path)


def in_parts(dealt: DataFrame, parts: int) -> DataFrame:
    """The rows of ``deal`` with each of its folders as one partition, in stored order; nothing is shuffled or sorted again.

    A union of single partitions alone may be read as one; the folder that does not exist keeps them apart.
    """
    folders = [dealt.filter(F.col(DEAL) == i).drop(DEAL).coalesce(1) for i in range(parts)]
    return reduce(DataFrame.unionAll, [*folders, dealt.filter(F.col(DEAL) == -1).drop(DEAL)])


def explode_count(df: DataFrame, count: str, name: str, keys: Sequence[str], chunk: int = 100_000, spread: bool = True) -> DataFrame:
    """One row per number 1..count; a large count is first cut into chunks over the tasks."""
    n, one, step = F.col(count).cast("bigint"), F.lit(1).cast("bigint"), F.lit(chunk).cast("bigint")
    if spread:
        df = df.filter(n > 0).withColumn("__from", F.explode(F.sequence(one, n, step)))
        df = df.repartition(F.xxhash64(*keys, "__from"))
        return df.withColumn(name, F.explode(F.sequence("__from", F.least(n, F.col("__from") + chunk - 1)))).drop("__from")
    return df.filter(n > 0).withColumn(name, F.explode(F.sequence(one, n)))


def join_on(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join by name where null equals null; the right side's key copies are dropped."""
    if not keys:
        raise ValueError("At least one join key is required")
    renamed = right.select(*[quoted(c).alias(f"__r_{c}") if c in keys else quoted(c) for c in right.columns])
    condition = reduce(lambda a, b: a & b, [quoted(k).eqNullSafe(quoted(f"__r_{k}")) for k in keys])
    return left.join(renamed, condition, how).drop(*[f"__r_{k}" for k in keys])


def one_row(*facts: DataFrame) -> DataFrame:
    """Several one-row frames with distinct columns as one row."""
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), facts)
    return stacked.agg(*[F.max(c).alias(c) for c in stacked.columns])


def explode_features(df: DataFrame, names: Sequence[str], carried: Sequence[str]) -> DataFrame:
    """Arrays ``x`` and ``phi`` to one row per feature: feature, value, contribution."""
    cells = F.array(*[
        F.struct(F.lit(n).alias("feature"), F.col("x")[i].alias("value"), F.col("phi")[i].alias("contribution"))
        for i, n in enumerate(names)
    ])
    return df.select(*carried, F.explode(cells).alias("cell")).select(*carried, "cell.*")
