"""Classification metrics from labels, scores and predicted classes.

Everything that depends on the order of scores starts from one row per distinct score.
All kernels take grouping columns, so fold, candidate and pooled results share code. A missing
label, score or prediction (null or NaN) fails the query, as a metric over it would mean nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.frames import join_on, one_row
from ..functions.values import grid, required, round_to, safe_div
from ..schema import GRID_START, GRID_STEP, GRID_STOP
from .ranking import ROWS_PER_BUCKET, prefix_sums

CV_METRICS = ["accuracy", "precision", "recall", "f1", "roc_auc", "pr_auc"]


def classify(df: DataFrame, threshold: float, rule: str = "ge", score: str = "score", name: str = "predicted") -> DataFrame:
    """0/1 class: ``ge`` is the frozen rule, ``gt`` the classifier's own cut at 0.5."""
    if rule not in ("ge", "gt"):
        raise ValueError("rule must be 'ge' or 'gt'")
    value = required(score, "score")
    hit = value >= threshold if rule == "ge" else value > threshold
    return df.withColumn(name, hit.cast("tinyint"))


def outcome(df: DataFrame, label: str = "label", predicted: str = "predicted", name: str = "outcome") -> DataFrame:
    y, p = required(label, "label") == 1, required(predicted, "prediction") == 1
    kind = (
        F.when(y & p, "true_positive").when(~y & p, "false_positive")
        .when(y & ~p, "false_negative").otherwise("true_negative")
    )
    return df.withColumn(name, kind)


def score_table(
    df: DataFrame, label: str = "label", score: str = "score", by: Sequence[str] = (),
    rows_per_bucket: int = ROWS_PER_BUCKET, times: str | None = None,
) -> DataFrame:
    """Per distinct score: pos, neg, and tp, fp counted from the highest score down.

    Also carries total_tp, total_fp and the next lower score's pos and neg. ``times`` names a column that says
    how often a row stands for itself.
    """
    n = F.lit(1).cast("bigint") if times is None else F.col(times)
    positives = F.sum((required(label, "label") == 1).cast("bigint") * n)
    counts = (
        df.groupBy(*by, required(score, "score").cast("double").alias("threshold"))
        .agg(positives.alias("pos"), F.sum(n).alias("n"))
        .select(*by, "threshold", "pos", (F.col("n") - F.col("pos")).alias("neg"))
    )
    return prefix_sums(counts, "threshold", {"tp": F.col("pos"), "fp": F.col("neg")}, by,
                       ahead=("pos", "neg"), rows_per_bucket=rows_per_bucket)


def _precision() -> Column:
    return F.col("tp") / (F.col("tp") + F.col("fp"))


def _recall() -> Column:
    return F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("total_tp").cast("double")), F.lit(1.0))


def _f1(precision: Column, recall: Column) -> Column:
    return safe_div(2 * precision * recall, precision + recall)


def _auc() -> Column:
    won = F.col("pos") * ((F.col("total_fp") - F.col("fp")) + F.col("neg") / 2.0)
    pairs = F.first("total_tp").cast("double") * F.first("total_fp").cast("double")
    return F.try_divide(F.sum(won), pairs)


def _average_precision() -> Column:
    step = F.try_divide(F.col("pos").cast("double"), F.col("total_tp").cast("double"))
    return F.sum(step * _precision())


def roc_auc_of(table: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return table.groupBy(*by).agg(_auc().alias("roc_auc"))


def average_precision_of(table: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return table.groupBy(*by).agg(_average_precision().alias("pr_auc"))


def roc_auc(df: DataFrame, label: str = "label", score: str = "score", by: Sequence[str] = ()) -> DataFrame:
    """Area under the ROC curve; a tie counts half. NULL when a class is absent."""
    return roc_auc_of(score_table(df, label, score, by), by)


def average_precision(df: DataFrame, label: str = "label", score: str = "score", by: Sequence[str] = ()) -> DataFrame:
    """Step sum of precision over recall gains. NULL without positives."""
    return average_precision_of(score_table(df, label, score, by), by)


def ranking_metrics(
    df: DataFrame, label: str = "label", score: str = "score", by: Sequence[str] = (),
    rows_per_bucket: int = ROWS_PER_BUCKET, times: str | None = None,
) -> DataFrame:
    return ranking_metrics_of(score_table(df, label, score, by, rows_per_bucket, times), by)


def ranking_metrics_of(table: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return table.groupBy(*by).agg(_auc().alias("roc_auc"), _average_precision().alias("pr_auc"))


def prevalence(df: DataFrame, label: str = "label", by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(F.avg(F.col(label).cast("double")).alias("prevalence"))


def threshold_table_of(table: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    rows = table.select(*by, "threshold", _precision().alias("precision"), _recall().alias("recall"))
    return rows.withColumn("f1", _f1(F.col("precision"), F.col("recall")))


def threshold_table(df: DataFrame, label: str = "label", score: str = "score", by: Sequence[str] = ()) -> DataFrame:
    """Precision, recall and F1 when every score at or above the threshold is flagged."""
    return threshold_table_of(score_table(df, label, score, by), by)


def pr_curve(df: DataFrame, label: str = "label", score: str = "score", by: Sequence[str] = ()) -> DataFrame:
    """Precision-recall points and the closing point (1, 0), which has no threshold."""
    return pr_curve_of(score_table(df, label, score, by), by)


def pr_curve_of(table: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    points = table.select(*by, "threshold", _precision().alias("precision"), _recall().alias("recall"))
    end = table.groupBy(*by).agg(
        F.lit(None).cast("double").alias("threshold"), F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall")
    )
    return points.unionByName(end)


def roc_curve(
    df: DataFrame, label: str = "label", score: str = "score", by: Sequence[str] = (), thin: bool = True,
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """ROC points from (0, 0); with ``thin`` points inside a straight stretch are dropped."""
    return roc_curve_of(score_table(df, label, score, by, rows_per_bucket), by, thin)


def roc_curve_of(table: DataFrame, by: Sequence[str] = (), thin: bool = True) -> DataFrame:
    if thin:
        first = (F.col("tp") == F.col("pos")) & (F.col("fp") == F.col("neg"))
        bends = (F.col("next_pos") != F.col("pos")) | (F.col("next_neg") != F.col("neg"))
        kept = table.filter(first | F.col("next_pos").isNull() | bends)
    else:
        kept = table
    share = {c: F.try_divide(F.col(c).cast("double"), F.col(f"total_{c}").cast("double")) for c in ("fp", "tp")}
    points = kept.select(*by, "threshold", share["fp"].alias("fpr"), share["tp"].alias("tpr"))
    start = table.groupBy(*by).agg(
        F.lit(float("inf")).alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr")
    )
    return start.unionByName(points)


def best_threshold(
    df: DataFrame, label: str = "label", score: str = "score", by: Sequence[str] = (),
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """Operating point of highest F1 (the lowest such threshold) with its metrics and counts."""
    return best_threshold_of(score_table(df, label, score, by, rows_per_bucket), by)


def best_threshold_of(table: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    rows = table.withColumns({"precision": _precision(), "recall": _recall()})
    rows = rows.withColumn("f1", _f1(F.col("precision"), F.col("recall")))
    point = F.struct(
        "threshold", "precision", "recall", "f1",
        (F.col("total_fp") - F.col("fp")).alias("tn"), "fp",
        (F.col("total_tp") - F.col("tp")).alias("fn"), "tp",
    )
    best = rows.groupBy(*by).agg(
        F.max_by(point, F.struct(F.col("f1"), -F.col("threshold"))).alias("best"),
        _average_precision().alias("pr_auc"),
    )
    picked = ["threshold", "precision", "recall", "f1", "tn", "fp", "fn", "tp"]
    return best.select(*by, *[f"best.{c}" for c in picked], "pr_auc")


def threshold_grid(
    df: DataFrame, label: str = "label", score: str = "score", start: float = GRID_START,
    stop: float = GRID_STOP, step: float = GRID_STEP, by: Sequence[str] = (),
) -> DataFrame:
    """Precision, recall and F1 (4 digits) on an equal-step grid.

    A score is reduced to the number of grid values it reaches, so grid and rows never meet
    in a join.
    """
    cuts = grid(start, stop, step)
    checked = df.select(*by, required(label, "label").alias("__y"), required(score, "score").alias("__s"))
    reached = sum(((F.col("__s") >= F.lit(t)).cast("int") for t in cuts), F.lit(0))
    counts = checked.groupBy(*by, reached.alias("reached")).agg(
        F.sum((F.col("__y") == 1).cast("bigint")).alias("pos"), F.count(F.lit(1)).alias("n")
    )
    flagged = [F.col("reached") > i for i in range(len(cuts))]
    per_cut = counts.groupBy(*by).agg(
        F.sum("pos").alias("positives"),
        F.array(*[
            F.struct(
                F.lit(round(t, 3)).alias("threshold"),
                F.sum(F.when(hit, F.col("pos")).otherwise(0)).alias("tp"),
                F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("flagged"),
            )
            for t, hit in zip(cuts, flagged, strict=True)
        ]).alias("cuts"),
    )
    rows = per_cut.select(*by, "positives", F.explode("cuts").alias("c")).select(*by, "positives", "c.*")
    rows = rows.withColumns({
        "precision": safe_div(F.col("tp"), F.col("flagged")), "recall": safe_div(F.col("tp"), F.col("positives")),
    })
    f1 = _f1(F.col("precision"), F.col("recall"))
    return rows.select(
        *by, "threshold", round_to("precision", 4).alias("precision"),
        round_to("recall", 4).alias("recall"), round_to(f1, 4).alias("f1"),
    )


def confusion(
    df: DataFrame, label: str = "label", predicted: str = "predicted", by: Sequence[str] = (), times: str | None = None
) -> DataFrame:
    y, p = required(label, "label") == 1, required(predicted, "prediction") == 1

    def rows(hit: Column) -> Column:
        return F.count_if(hit) if times is None else F.coalesce(F.sum(F.when(hit, F.col(times))), F.lit(0).cast("bigint"))

    return df.groupBy(*by).agg(
        rows(~y & ~p).alias("tn"), rows(~y & p).alias("fp"), rows(y & ~p).alias("fn"), rows(y & p).alias("tp"),
    )


def point_metrics_of(
    counts: DataFrame, digits: int | None = None, model: str | None = None
) -> DataFrame:
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    values = {
        "accuracy": safe_div(tn + tp, tn + fp + fn + tp),
        "precision": safe_div(tp, tp + fp),
        "recall": safe_div(tp, tp + fn),
        "f1": safe_div(2 * tp, 2 * tp + fp + fn),
        "specificity": F.try_divide(tn.cast("double"), (tn + fp).cast("double")),
    }
    if digits is not None:
        values = {name: round_to(value, digits) for name, value in values.items()}
    out = counts.withColumns(values)
    return out if model is None else out.withColumn("model", F.lit(model))


def point_metrics(
    df: DataFrame, label: str = "label", predicted: str = "predicted", by: Sequence[str] = (),
    digits: int | None = None, model: str | None = None, times: str | None = None,
) -> DataFrame:
    """Confusion counts with accuracy, precision, recall, F1 (0 on empty) and specificity."""
    return point_metrics_of(confusion(df, label, predicted, by, times), digits, model)


def classification_report(
    df: DataFrame, label: str = "label", predicted: str = "predicted", by: Sequence[str] = (),
    names: tuple[str, str] = ("legitimate", "fraud"),
) -> DataFrame:
    """Rows per class, then accuracy, macro and support-weighted averages."""
    counts = confusion(df, label, predicted, by)
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))

    def of_class(hit: Column, wrong: Column, missed: Column) -> tuple[Column, Column, Column, Column]:
        return (
            safe_div(hit, hit + wrong), safe_div(hit, hit + missed),
            safe_div(2 * hit, 2 * hit + wrong + missed), (hit + missed).cast("double"),
        )

    negative, positive = of_class(tn, fn, fp), of_class(tp, fp, fn)
    accuracy = safe_div(tn + tp, tn + fp + fn + tp)
    n0, n1 = negative[3], positive[3]
    macro = [(a + b) / 2 for a, b in zip(negative[:3], positive[:3], strict=True)]
    weighted = [safe_div(a * n0 + b * n1, n0 + n1) for a, b in zip(negative[:3], positive[:3], strict=True)]
    rows = [
        (names[0], *negative), (names[1], *positive), ("accuracy", accuracy, accuracy, accuracy, accuracy),
        ("macro avg", *macro, n0 + n1), ("weighted avg", *weighted, n0 + n1),
    ]
    columns = ["name", "precision", "recall", "f1_score", "support"]
    cells = F.array(*[
        F.struct(F.lit(row[0]).alias("name"), *[v.alias(c) for v, c in zip(row[1:], columns[1:], strict=True)])
        for row in rows
    ])
    return counts.select(*by, F.explode(cells).alias("row")).select(*by, "row.*")


def classification_metrics(
    df: DataFrame, label: str = "label", score: str = "score", by: Sequence[str] = (),
    threshold: float = 0.5, rule: str = "gt", times: str | None = None,
) -> DataFrame:
    """Point and ranking metrics together, one row per group; ``times``: how often a row counts."""
    points = point_metrics(classify(df, threshold, rule, score, "__p"), label, "__p", by, times=times)
    ranks = ranking_metrics(df, label, score, by, times=times)
    if by:
        return join_on(points, ranks, by)
    return one_row(points, ranks)


def compute_metrics(
    df: DataFrame, model: str, label: str = "label", predicted: str = "predicted", score: str = "score",
    table: DataFrame | None = None,
) -> DataFrame:
    """One rounded row for a comparison table; a ready score table saves building another."""
    ranks = ranking_metrics(df, label, score) if table is None else ranking_metrics_of(table)
    both = one_row(point_metrics(df, label, predicted), ranks)
    return both.select(F.lit(model).alias("model"), *[round_to(m, 4).alias(m) for m in CV_METRICS])


# Metric name -> kernel returning one row per group with a column of that name.
METRICS: dict[str, Callable[..., DataFrame]] = {
    **{
        name: (lambda df, by=(), _n=name, **kw: classification_metrics(df, by=by, **kw).select(*by, _n))
        for name in ("accuracy", "precision", "recall", "f1")
    },
    "roc_auc": roc_auc,
    "average_precision": average_precision,
}
