"""Data set verification: every audit and plot-ready table of a raw table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.values import quoted
from ..operators.profile import (
    box_stats,
    class_stats,
    correlation_matrix,
    describe,
    histogram,
    profile,
    target_correlation,
    top_abs,
)
from ..operators.quality import (
    class_distribution,
    dtypes_table,
    duplicate_measures,
    infinite_counts,
    missing_counts,
    predictors,
)
from ..operators.quantiles import cap_at_quantile
from ..schema import LABEL_COL


def profile_report(
    df: DataFrame, key: Sequence[str], label: str = LABEL_COL, amount: str = "Amount", time: str = "Time",
) -> dict[str, DataFrame]:
    """Named tables over all rows; the key columns take no part in the statistics."""
    data = df.drop(*key)
    feats = predictors(data, label)
    correlations = target_correlation(data, label, feats)
    leading = [r["feature"] for r in top_abs(correlations, "correlation_with_class", 8).collect()]
    return {
        "dataset_profile": profile(data, label, amount, time, feats),
        "class_distribution": class_distribution(data, label),
        "class_feature_summary": class_stats(data, label, [amount, time]),
        "column_data_types": dtypes_table(data),
        "missing_values": missing_counts(data),
        "infinite_values": infinite_counts(data),
        "descriptive_statistics": describe(data, [*feats, label]),
        "duplicate_analysis": duplicate_measures(data, feats, label),
        "feature_target_correlations": correlations,
        "amount_distribution": histogram(cap_at_quantile(data, amount, 0.995), amount, 70),
        "amount_by_class": box_stats(data, F.log1p(quoted(amount)), label),
        "time_distribution": histogram(data, time, 60, [label], density=True),
        "selected_feature_distributions": histogram(data, leading, 45, [label], density=True),
        "correlation_matrix": correlation_matrix(data, [*feats, label]),
    }
