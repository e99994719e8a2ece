import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskframe.operators import metrics as M
from riskframe.operators.ranking import distributed_rank, prefix_sums, thin


def frame(spark, labels, scores):
    return spark.createDataFrame(list(zip(labels, scores, strict=True)), "label int, score double")


def brute_auc(y, s):
    pos, neg = s[y == 1], s[y == 0]
    won = (pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()
    return won / (len(pos) * len(neg))


def brute_ap(y, s):
    out, last = 0.0, 0.0
    for t in sorted(set(s), reverse=True):
        hit = s >= t
        recall = y[hit].sum() / y.sum()
        out += (recall - last) * y[hit].mean()
        last = recall
    return out


@pytest.mark.parametrize("digits", [1, 6])
@pytest.mark.parametrize("bucket", [7, 1_000_000])
def test_ranking_metrics_match_brute_force(spark, digits, bucket):
    rng = np.random.default_rng(digits)
    y = rng.integers(0, 2, 300)
    s = np.round(rng.random(300), digits)
    row = M.ranking_metrics(frame(spark, y.tolist(), s.tolist()), rows_per_bucket=bucket).first()
    assert row["roc_auc"] == pytest.approx(brute_auc(y, s), abs=1e-12)
    assert row["pr_auc"] == pytest.approx(brute_ap(y, s), abs=1e-12)


@pytest.mark.parametrize("by", [[], ["g"]])
def test_bucketed_prefix_sums_equal_plain_ones(spark, by):
    rng = np.random.default_rng(3)
    rows = [(i % 3, float(x), int(n)) for i, (x, n) in enumerate(zip(rng.permutation(500) ** 2, rng.integers(0, 9, 500), strict=True))]
    df = spark.createDataFrame(rows, "g int, x double, n bigint")

    def run(size):
        out = prefix_sums(df, "x", {"s": F.col("n")}, by, ahead=("n",), rows_per_bucket=size)
        return sorted(tuple(r) for r in out.select("g", "x", "s", "total_s", "next_n").na.fill(-1).collect())

    assert run(11) == run(10_000)


def test_distributed_rank_and_thin(spark):
    df = spark.range(1000).withColumn("x", (F.col("id") * 7 % 1000).cast("double"))
    ranked = distributed_rank(df, "x", rows_per_bucket=50)
    assert ranked.filter(F.col("rank") != F.col("x") + 1).count() == 0
    assert thin(df, "x", 100, rows_per_bucket=50).count() == 100


def test_one_class_only(spark):
    df = frame(spark, [0, 0, 0], [0.1, 0.2, 0.3])
    row = M.ranking_metrics(df).first()
    assert row["roc_auc"] is None and row["pr_auc"] is None
    point = M.point_metrics(M.classify(df, 0.9)).first()
    assert (point["precision"], point["recall"], point["f1"], point["accuracy"]) == (0, 0, 0, 1)


def test_specificity_without_negatives_is_null(spark):
    assert M.point_metrics(M.classify(frame(spark, [1], [0.5]), 0.5)).first()["specificity"] is None


def test_best_threshold_takes_lowest_of_equal_f1(spark):
    # Cutting at 0.9 gives F1 2/3 (1 of 2 found); cutting at 0.4 gives 2 of 4 flagged, also 2/3.
    row = M.best_threshold(frame(spark, [1, 0, 0, 1], [0.9, 0.8, 0.7, 0.4])).first()
    assert row["threshold"] == 0.4 and row["f1"] == pytest.approx(2 / 3)
    assert (row["tn"], row["fp"], row["fn"], row["tp"]) == (0, 2, 0, 2)


def test_threshold_rules(spark):
    df = frame(spark, [1], [0.5])
    assert M.classify(df, 0.5, "ge").first()["predicted"] == 1
    assert M.classify(df, 0.5, "gt").first()["predicted"] == 0
    with pytest.raises(ValueError):
        M.classify(df, 0.5, "lt")


def test_grid_compares_unrounded_steps(spark):
    rows = M.threshold_grid(frame(spark, [1, 0], [0.15, 0.0])).collect()
    assert len(rows) == 19
    found = {r["threshold"]: r["recall"] for r in rows}
    assert found[0.1] == 1.0 and found[0.15] == 0.0


def test_roc_curve_keeps_ends_and_bends(spark):
    df = frame(spark, [1, 1, 0, 0, 1], [0.9, 0.8, 0.7, 0.6, 0.5])
    for bucket in (2, 100):
        points = sorted((r["fpr"], r["tpr"], -r["threshold"]) for r in M.roc_curve(df, rows_per_bucket=bucket).collect())
        assert [p[:2] for p in points] == [(0, 0), (0, 1 / 3), (0, 2 / 3), (1, 2 / 3), (1, 1)]
        assert math.isinf(points[0][2])
    assert M.roc_curve(df, thin=False).count() == 6


def test_published_test_counts(spark):
    counts = spark.createDataFrame([(56648, 3, 26, 69)], "tn bigint, fp bigint, fn bigint, tp bigint")
    row = M.point_metrics_of(counts).first()
    assert row["precision"] == pytest.approx(0.9583333333333334, abs=1e-12)
    assert row["recall"] == pytest.approx(0.7263157894736842, abs=1e-12)
    assert row["f1"] == pytest.approx(0.8263473053892215, abs=1e-12)
    assert row["specificity"] == pytest.approx(0.9999470441828034, abs=1e-12)
    assert row["accuracy"] == pytest.approx(0.9994889507630493, abs=1e-12)
    assert M.point_metrics_of(counts, 4, "forest").first()["precision"] == 0.9583


def test_metric_registry(spark):
    df = frame(spark, [1, 0, 1], [0.9, 0.2, 0.4])
    values = {name: kernel(df).first()[0] for name, kernel in M.METRICS.items()}
    assert values == pytest.approx({
        "accuracy": 2 / 3, "precision": 1.0, "recall": 0.5, "f1": 2 / 3, "roc_auc": 1.0, "average_precision": 1.0,
    })


def test_same_result_for_other_partitioning(spark):
    rng = np.random.default_rng(5)
    df = frame(spark, rng.integers(0, 2, 200).tolist(), rng.random(200).tolist())
    assert M.best_threshold(df.repartition(1)).first() == M.best_threshold(df.repartition(13)).first()
