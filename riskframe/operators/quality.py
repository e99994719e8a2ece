"""Data quality: missing and infinite cells, duplicates, conflicting labels, integrity checks."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.frames import cut_lineage, explode_count, join_on
from ..functions.hashing import row_text
from ..functions.values import is_inf, missing_flag


def numeric_cols(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def predictors(df: DataFrame, label: str) -> list[str]:
    return [c for c in df.columns if c != label]


def dtypes_table(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame(df.dtypes, "column string, dtype string")


def _per_column(df: DataFrame, flags: dict[str, Column], name: str) -> DataFrame:
    """Count flagged cells of every column in one pass; one row per column."""
    counts = df.agg(*[F.count_if(flag).alias(f"__{i}") for i, flag in enumerate(flags.values())])
    cells = F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"__{i}").alias(name)) for i, c in enumerate(flags)
    ])
    return counts.select(F.explode(cells).alias("c")).select("c.*")


def missing_counts(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    cols = cols or df.columns
    return _per_column(df, {c: missing_flag(df, c) for c in cols}, "missing_count")


def infinite_counts(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    cols = cols or numeric_cols(df)
    return _per_column(df, {c: is_inf(c) for c in cols}, "infinite_count")


def total_missing(df: DataFrame, cols: Sequence[str]) -> Column:
    return F.sum(reduce(lambda a, b: a + b, [missing_flag(df, c).cast("bigint") for c in cols]))


def total_infinite(cols: Sequence[str]) -> Column:
    return F.sum(reduce(lambda a, b: a + b, [is_inf(c).cast("bigint") for c in cols]))


def row_groups(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Distinct rows and their number; null equals null, NaN equals NaN, -0.0 equals 0.0."""
    return df.groupBy(*cols).agg(F.count(F.lit(1)).alias("n"))


def overview(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """One row: rows, columns, missing cells, copies beyond the first, column types."""
    cols = list(cols or df.columns)
    gaps = reduce(lambda a, b: a + b, [missing_flag(df, c).cast("bigint") for c in cols])
    groups = row_groups(df, cols).withColumn("gaps", gaps * F.col("n"))
    types = [f"{name}:{kind}" for name, kind in df.select(*cols).dtypes]
    return groups.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"),
        F.lit(len(cols)).cast("bigint").alias("n_cols"),
        F.coalesce(F.sum("gaps"), F.lit(0)).alias("n_missing"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n_duplicates"),
        F.lit(", ".join(types)).alias("dtypes"),
    )


def class_distribution(
    df: DataFrame, label: str, classes: Sequence = (0, 1), names: Sequence[str] = ("Legitimate", "Fraudulent")
) -> DataFrame:
    """Count and percent of every listed class, zero when absent, and the ratio first : second."""
    counted = df.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count_if(F.col(label) == c).alias(f"__{i}") for i, c in enumerate(classes)],
    )
    ratio = F.try_divide(F.col("__0").cast("double"), F.col("__1").cast("double"))
    cells = F.array(*[
        F.struct(
            F.lit(c).alias("class"), F.lit(name).alias("label"), F.col(f"__{i}").alias("count"),
            F.try_divide(F.col(f"__{i}") * 100.0, F.col("n").cast("double")).alias("percentage"),
            ratio.alias("majority_ratio"),
        )
        for i, (c, name) in enumerate(zip(classes, names, strict=True))
    ])
    return counted.select(F.explode(cells).alias("c")).select("c.*")


def duplicate_audit(df: DataFrame, cols: Sequence[str], label: str, classes: Sequence = (0, 1)) -> DataFrame:
    """One row: copies beyond the first, rows in duplicate groups, copies per class.

    ``cols`` include the label, so copies of one row share their class.
    """
    groups = row_groups(df, cols)
    copies = F.col("n") - 1
    return groups.agg(
        F.coalesce(F.sum(copies), F.lit(0)).alias("copies_after_first"),
        F.coalesce(F.sum(F.when(copies > 0, F.col("n"))), F.lit(0)).alias("rows_in_duplicate_groups"),
        *[
            F.coalesce(F.sum(F.when(F.col(label) == c, copies)), F.lit(0)).alias(f"copies_class_{c}")
            for c in classes
        ],
    )


def _labels_per_group(df: DataFrame, feats: Sequence[str], label: str) -> DataFrame:
    per_label = df.groupBy(*feats, label).agg(F.count(F.lit(1)).alias("n"))
    return per_label.groupBy(*feats).agg(F.sum("n").alias("n"), F.count(label).alias("label_count"))


def conflicting_labels(df: DataFrame, feats: Sequence[str], label: str) -> DataFrame:
    """Groups of identical features that carry several labels, and the rows in them."""
    groups = _labels_per_group(df, feats, label)
    clash = F.col("label_count") > 1
    return groups.agg(
        F.count_if(clash).alias("conflicting_groups"),
        F.coalesce(F.sum(F.when(clash, F.col("n"))), F.lit(0)).alias("rows_in_conflict"),
    )


def duplicate_measures(df: DataFrame, feats: Sequence[str], label: str) -> DataFrame:
    """Duplicate and conflict audits as measure/value rows."""
    copies = duplicate_audit(df, [*feats, label], label)
    clash = conflicting_labels(df, feats, label)

    def long(row: DataFrame) -> DataFrame:
        cells = F.array(*[F.struct(F.lit(c).alias("measure"), F.col(c).alias("value")) for c in row.columns])
        return row.select(F.explode(cells).alias("m")).select("m.*")

    return long(copies).unionByName(long(clash))


def attach_group_facts(df: DataFrame, facts: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Join per-group facts back to the rows.

    The facts are stored, so Spark knows their bytes: small ones are broadcast, and with large
    ones both sides are plain exchanges, in which adaptive execution splits a group of any size.
    """
    return join_on(df, cut_lineage(facts), keys, how)


def mark_duplicates(df: DataFrame, cols: Sequence[str], key: Sequence[str]) -> DataFrame:
    """Add ``is_copy`` (every copy after the one with the lowest key) and ``in_group``."""
    groups = df.groupBy(*cols).agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct(*key)).alias("__first")
    ).filter("n > 1")
    marked = attach_group_facts(df, groups, cols)
    return marked.withColumns({
        "is_copy": F.coalesce(F.struct(*key) != F.col("__first"), F.lit(False)),
        "in_group": F.col("n").isNotNull(),
    }).drop("n", "__first")


def label_cardinality(df: DataFrame, feats: Sequence[str], label: str) -> DataFrame:
    """Add the number of distinct labels among rows with the same features."""
    marked = attach_group_facts(df, _labels_per_group(df, feats, label), feats)
    return marked.drop("n")


def drop_exact_duplicates(
    df: DataFrame, cols: Sequence[str], key: Sequence[str] = (), decision: bool = True
) -> DataFrame:
    """Keep one of identical rows, the one with the lowest key; ``decision=False`` keeps all."""
    if not decision:
        return df
    if not key:
        return df.dropDuplicates(list(cols))
    kept = df.groupBy(*cols).agg(F.min(F.struct(*key)).alias("__key"))
    return kept.select(*[F.col(f"__key.{k}").alias(k) for k in key], *cols)


def overlap(a: DataFrame, b: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Distinct rows present in both frames."""
    both = a.select(*cols, F.lit(1).alias("__side")).unionByName(b.select(*cols, F.lit(2).alias("__side")))
    sides = both.groupBy(*cols).agg(F.min("__side").alias("lo"), F.max("__side").alias("hi"))
    return sides.filter(F.col("lo") != F.col("hi")).select(*cols)


def uncovered(whole: DataFrame, *parts: DataFrame) -> DataFrame:
    """Rows of the whole, with their multiplicity, that no part accounts for."""
    sizes = whole.groupBy(*whole.columns).agg(F.count(F.lit(1)).alias("n"))
    for part in parts:
        taken = part.select(*whole.columns).groupBy(*whole.columns).agg((-F.count(F.lit(1))).alias("n"))
        sizes = sizes.unionByName(taken)
    left = sizes.groupBy(*whole.columns).agg(F.sum("n").alias("n"))
    return left.filter("n > 0")


def fingerprint(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Order-free content checksum: row count and sums over four slices of each row's md5."""
    token = F.md5(row_text(cols, "\u001f"))
    hashed = df.select(*by, token.alias("token"))
    slices = [
        F.sum(F.conv(F.substring("token", 1 + 8 * i, 8), 16, 10).cast("decimal(28,0)")).cast("string").alias(f"sum_{i}")
        for i in range(4)
    ]
    return hashed.groupBy(*by).agg(F.count(F.lit(1)).alias("n_rows"), *slices)


def assert_clean(
    raw: DataFrame, cleaned: DataFrame, train: DataFrame, test: DataFrame, cols: Sequence[str]
) -> DataFrame:
    """Integrity checks of cleaning and split: ``check``, ``ok``, ``detail``."""
    numbers = [c for c in numeric_cols(cleaned) if c in cols]
    audit = row_groups(raw, cols).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("raw_rows"), F.count(F.lit(1)).alias("distinct_rows")
    )
    after = row_groups(cleaned, cols)
    gaps = reduce(lambda a, b: a + b, [missing_flag(cleaned, c).cast("bigint") for c in cols])
    infinite = reduce(lambda a, b: a + b, [is_inf(c).cast("bigint") for c in numbers])
    clean = after.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("copies"),
        F.coalesce(F.sum(gaps * F.col("n")), F.lit(0)).alias("missing"),
        F.coalesce(F.sum(infinite * F.col("n")), F.lit(0)).alias("infinite"),
    )
    facts = audit.first().asDict() | clean.first().asDict()
    train_rows, test_rows = train.count(), test.count()
    shared = overlap(train, test, cols).count()
    checks = [
        ("removed equals audited copies", facts["rows"] == facts["distinct_rows"],
         f"removed {facts['raw_rows'] - facts['rows']}, audited {facts['raw_rows'] - facts['distinct_rows']}"),
        ("no duplicates left", facts["copies"] == 0, f"{facts['copies']} copies"),
        ("no missing values", facts["missing"] == 0, f"{facts['missing']} cells"),
        ("no infinite values", facts["infinite"] == 0, f"{facts['infinite']} cells"),
        ("parts add up", train_rows + test_rows == facts["rows"], f"{train_rows} + {test_rows} of {facts['rows']}"),
        ("no overlap of parts", shared == 0, f"{shared} rows"),
    ]
    return raw.sparkSession.createDataFrame(checks, "check string, ok boolean, detail string")


def require_checks(checks: DataFrame) -> DataFrame:
    """Raise when an integrity check failed."""
    failed = checks.filter("not ok").collect()
    if failed:
        raise AssertionError("; ".join(f"{r['check']}: {r['detail']}" for r in failed))
    return checks


def with_row_key(df: DataFrame, cols: Sequence[str], name: str = "row_id", chunk: int = 100_000) -> DataFrame:
    """Key for a table without one: content hash and copy number.

    Copies of a row are interchangeable, so they are counted and written out again with
    numbers; a group of any size is spread over tasks in chunks.
    """
    content = F.md5(row_text(cols, "\u001f"))
    copies = explode_count(row_groups(df, cols), "n", "__copy", cols, chunk)
    return copies.select(F.concat_ws("-", content, F.col("__copy").cast("string")).alias(name), *cols)
