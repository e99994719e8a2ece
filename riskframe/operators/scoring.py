"""Scoring with a frozen model: strict frames, uploads with quarantine, labelled uploads."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.frames import one_row
from ..functions.values import quoted
from .columns import coerce_numeric, quarantine, require_binary, validate_frame
from .metrics import average_precision, classify, point_metrics
from .models import predict


def score(model, meta: Mapping, df: DataFrame, key: Sequence[str] = (), amount: str = "Amount") -> DataFrame:
    """Probability, class and threshold for rows that must all be valid; keys are kept."""
    feats = meta["feature_order"]
    valid = validate_frame(df.drop(*key), feats, amount)
    rows = coerce_numeric(df, feats) if key else valid
    scored = predict(model, rows, "fraud_probability")
    return classify(scored, float(meta["threshold"]), "ge", "fraud_probability", "predicted_class").select(
        *key, "fraud_probability", "predicted_class", F.lit(float(meta["threshold"])).alias("threshold")
    )


def score_upload(
    model, meta: Mapping, df: DataFrame, amount: str = "Amount"
) -> tuple[DataFrame, DataFrame]:
    """Valid rows with original columns, probability and class; rejected rows with a reason.

    Both stay lazy, so each sink runs as one pass over the input.
    """
    feats = list(meta["feature_order"])
    valid, rejected = quarantine(df, feats, amount)
    kept = [c for c in df.columns if c in feats]
    held = valid.withColumns({f"__raw_{c}": quoted(c) for c in kept})
    scored = predict(model, coerce_numeric(held, feats), "fraud_probability")
    named = classify(scored, float(meta["threshold"]), "ge", "fraud_probability", "predicted_class")
    restored = named.withColumns({c: F.col(f"__raw_{c}") for c in kept}).drop(*[f"__raw_{c}" for c in kept])
    return restored, rejected


def evaluate_labelled(df: DataFrame, label: str, score: str = "fraud_probability", predicted: str = "predicted_class") -> DataFrame:
    """Precision, recall, F1, PR-AUC and confusion counts of a labelled, scored table."""
    rows = require_binary(df, label)
    both = one_row(point_metrics(rows, label, predicted), average_precision(rows, label, score))
    return both.select("precision", "recall", "f1", "pr_auc", "tn", "fp", "fn", "tp")


def score_summary(valid: DataFrame, rejected: DataFrame, predicted: str = "predicted_class") -> DataFrame:
    """One row: rows scored, rejected and flagged, and the flag rate."""
    both = valid.select(F.col(predicted).cast("int").alias("flag"), F.lit(0).alias("bad")).unionByName(
        rejected.select(F.lit(None).cast("int").alias("flag"), F.lit(1).alias("bad"))
    )
    counts = both.agg(
        F.count_if(F.col("bad") == 0).alias("scored"), F.count_if(F.col("bad") == 1).alias("rejected"),
        F.count_if(F.col("flag") == 1).alias("flagged"),
    )
    return counts.withColumn("flag_rate", F.try_divide(F.col("flagged").cast("double"), F.col("scored").cast("double")))


def ranked_scores(df: DataFrame, score: str = "fraud_probability", key: Sequence[str] = (), n: int | None = None) -> DataFrame:
    """Scored rows, highest first, ties by key; a range-partitioned sort, or a top-n when n is given.

    Forest scores tie by the million; without a key all rows of one score meet in one task.
    """
    out = df.orderBy(F.col(score).desc(), *[quoted(k) for k in key])
    return out if n is None else out.limit(n)
