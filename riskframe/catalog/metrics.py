"""Metric kernels on line items: near-unique and tied scores, pooled and per group."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics as M
from ..operators.ranking import thin
from .fixtures import TX, transactions
from .registry import query, rounded

# Cumulative counts from the highest score down, one row per distinct score and group.
STEPS = TX + """, per_score AS (
  SELECT {g} AS g, {s} AS threshold, sum(label)::BIGINT AS pos, (count(*) - sum(label))::BIGINT AS neg
  FROM tx GROUP BY 1, 2),
steps AS (
  SELECT *, (sum(pos) OVER w)::BIGINT AS tp, (sum(neg) OVER w)::BIGINT AS fp,
    (sum(pos) OVER (PARTITION BY g))::BIGINT AS p, (sum(neg) OVER (PARTITION BY g))::BIGINT AS n
  FROM per_score WINDOW w AS (PARTITION BY g ORDER BY threshold DESC ROWS UNBOUNDED PRECEDING))
"""


def steps(score: str, group: str = "0") -> str:
    return "WITH " + STEPS.format(g=group, s=score)


@query("score_table", steps("score") + "SELECT round(threshold, 9) AS threshold, pos, neg, tp, fp FROM steps")
def score_table(spark, sf):
    return rounded(M.score_table(transactions(spark, sf)).select("threshold", "pos", "neg", "tp", "fp"))


@query("score_table_by_group", steps("tied", "returnflag") + """
SELECT g AS returnflag, round(threshold, 9) AS threshold, pos, neg, tp, fp FROM steps""")
def score_table_by_group(spark, sf):
    out = M.score_table(transactions(spark, sf), score="tied", by=["returnflag"])
    return rounded(out.select("returnflag", "threshold", "pos", "neg", "tp", "fp"))


AUC = """, mid AS (
  SELECT {g} AS g, label, rank() OVER (PARTITION BY {g} ORDER BY {s})
    + (count(*) OVER (PARTITION BY {g}, {s}) - 1) / 2.0 AS r FROM tx),
sides AS (SELECT g, sum(label)::DOUBLE AS p, (count(*) - sum(label))::DOUBLE AS n,
  sum(CASE WHEN label = 1 THEN r END) AS rank_sum FROM mid GROUP BY g)
"""


@query("roc_auc", "WITH " + TX + AUC.format(g="0", s="score") + "SELECT round((rank_sum - p * (p + 1) / 2) / (p * n), 9) AS roc_auc FROM sides")
def roc_auc(spark, sf):
    return rounded(M.roc_auc(transactions(spark, sf)))


@query("roc_auc_by_group", "WITH " + TX + AUC.format(g="returnflag", s="tied") + """
SELECT g AS returnflag, round((rank_sum - p * (p + 1) / 2) / (p * n), 9) AS roc_auc FROM sides""")
def roc_auc_by_group(spark, sf):
    return rounded(M.roc_auc(transactions(spark, sf), score="tied", by=["returnflag"]))


@query("average_precision", steps("score") + "SELECT round(sum(pos::DOUBLE / p * tp / (tp + fp)), 9) AS pr_auc FROM steps")
def average_precision(spark, sf):
    return rounded(M.average_precision(transactions(spark, sf)))


# By self join of the few distinct scores instead of running sums.
@query("average_precision_by_group", "WITH " + TX + """, d AS (
  SELECT returnflag, tied, sum(label) AS pos FROM tx GROUP BY ALL),
reached AS (
  SELECT d.returnflag, d.tied, any_value(d.pos) AS pos, sum(t.label) AS tp, count(*) AS flagged
  FROM d JOIN tx t ON t.returnflag = d.returnflag AND t.tied >= d.tied GROUP BY ALL)
SELECT returnflag, round(sum(pos::DOUBLE / (SELECT sum(label) FROM tx WHERE tx.returnflag = reached.returnflag) * tp / flagged), 9) AS pr_auc
FROM reached GROUP BY returnflag""")
def average_precision_by_group(spark, sf):
    return rounded(M.average_precision(transactions(spark, sf), score="tied", by=["returnflag"]))


@query("pr_curve", steps("score") + """
SELECT round(threshold, 9) AS threshold, round(tp::DOUBLE / (tp + fp), 9) AS precision, round(tp::DOUBLE / p, 9) AS recall FROM steps
UNION ALL SELECT NULL, 1.0::DOUBLE, 0.0::DOUBLE""")
def pr_curve(spark, sf):
    return rounded(M.pr_curve(transactions(spark, sf)))


@query("roc_curve", steps("score") + """, bends AS (
  SELECT *, lead(tp) OVER w - 2 * tp + lag(tp) OVER w AS ct, lead(fp) OVER w - 2 * fp + lag(fp) OVER w AS cf
  FROM steps WINDOW w AS (ORDER BY threshold DESC))
SELECT round(threshold, 9) AS threshold, round(fp::DOUBLE / n, 9) AS fpr, round(tp::DOUBLE / p, 9) AS tpr
FROM bends WHERE ct IS NULL OR ct <> 0 OR cf <> 0
UNION ALL SELECT 'inf'::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE""")
def roc_curve(spark, sf):
    return rounded(M.roc_curve(transactions(spark, sf)))


F1 = """, rated AS (SELECT *, tp::DOUBLE / (tp + fp) AS precision, tp::DOUBLE / p AS recall FROM steps),
points AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM rated)
"""


@query("threshold_table", steps("score") + F1 + """
SELECT round(threshold, 9) AS threshold, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1 FROM points""")
def threshold_table(spark, sf):
    return rounded(M.threshold_table(transactions(spark, sf)))


BEST = """, best AS (
  SELECT *, row_number() OVER (PARTITION BY g ORDER BY f1 DESC, threshold) AS place,
    sum(pos::DOUBLE / p * precision) OVER (PARTITION BY g) AS ap FROM points)
SELECT {group} round(threshold, 9) AS threshold, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1,
  n - fp AS tn, fp, p - tp AS fn, tp, round(ap, 9) AS pr_auc FROM best WHERE place = 1
"""


@query("best_threshold", steps("score") + F1 + BEST.format(group=""))
def best_threshold(spark, sf):
    return rounded(M.best_threshold(transactions(spark, sf)))


@query("best_threshold_by_group", steps("tied", "returnflag") + F1 + BEST.format(group="g AS returnflag,"))
def best_threshold_by_group(spark, sf):
    return rounded(M.best_threshold(transactions(spark, sf), score="tied", by=["returnflag"]))


@query("threshold_grid", "WITH " + TX + """, cuts AS (SELECT 0.05::DOUBLE + i * 0.05::DOUBLE AS t FROM range(19) r(i)),
counts AS (SELECT t, sum(CASE WHEN score >= t THEN label ELSE 0 END)::DOUBLE AS tp,
  sum(CASE WHEN score >= t THEN 1 ELSE 0 END)::DOUBLE AS flagged, sum(label)::DOUBLE AS p FROM cuts CROSS JOIN tx GROUP BY t),
pr AS (SELECT t, CASE WHEN flagged > 0 THEN tp / flagged ELSE 0 END AS precision, CASE WHEN p > 0 THEN tp / p ELSE 0 END AS recall FROM counts)
SELECT round(t, 3) AS threshold, round_even(precision, 4) AS precision, round_even(recall, 4) AS recall,
  round_even(CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END, 4) AS f1 FROM pr""")
def threshold_grid(spark, sf):
    return M.threshold_grid(transactions(spark, sf))


COUNTS = "WITH " + TX + """, cm AS (
  SELECT {g} AS g, count(*) FILTER (label = 0 AND score < 0.485) AS tn, count(*) FILTER (label = 0 AND score >= 0.485) AS fp,
    count(*) FILTER (label = 1 AND score < 0.485) AS fn, count(*) FILTER (label = 1 AND score >= 0.485) AS tp FROM tx GROUP BY 1)
"""


def flagged(spark, sf):
    return M.classify(transactions(spark, sf), 0.485)


@query("confusion_counts", COUNTS.format(g="returnflag") + "SELECT g AS returnflag, tn, fp, fn, tp FROM cm")
def confusion_counts(spark, sf):
    return M.confusion(flagged(spark, sf), by=["returnflag"])


POINTS = """SELECT {group} tn, fp, fn, tp, round((tn + tp)::DOUBLE / (tn + fp + fn + tp), 9) AS accuracy,
  round(coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0), 9) AS precision, round(coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0), 9) AS recall,
  round(coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0), 9)::DOUBLE AS f1, round(tn::DOUBLE / nullif(tn + fp, 0), 9) AS specificity FROM cm
"""


@query("point_metrics", COUNTS.format(g="returnflag") + POINTS.format(group="g AS returnflag,"))
def point_metrics(spark, sf):
    return rounded(M.point_metrics(flagged(spark, sf), by=["returnflag"]))


@query("classification_report", COUNTS.format(g="0") + """, per AS (
  SELECT 'legitimate' AS name, tn::DOUBLE / (tn + fn) AS precision, tn::DOUBLE / (tn + fp) AS recall, (tn + fp)::DOUBLE AS support FROM cm
  UNION ALL SELECT 'fraud', tp::DOUBLE / (tp + fp), tp::DOUBLE / (tp + fn), (tp + fn)::DOUBLE FROM cm),
scored AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1_score FROM per),
every AS (
  SELECT name, precision, recall, f1_score, support FROM scored
  UNION ALL SELECT 'accuracy', a, a, a, a FROM (SELECT (tn + tp)::DOUBLE / (tn + fp + fn + tp) AS a FROM cm)
  UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1_score), sum(support) FROM scored
  UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
    sum(f1_score * support) / sum(support), sum(support) FROM scored)
SELECT name, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1_score, 9) AS f1_score, round(support, 9) AS support FROM every""")
def classification_report(spark, sf):
    return rounded(M.classification_report(flagged(spark, sf)))


@query("prevalence", "WITH " + TX + "SELECT returnflag, round(avg(label), 9) AS prevalence FROM tx GROUP BY returnflag")
def prevalence(spark, sf):
    return rounded(M.prevalence(transactions(spark, sf), by=["returnflag"]))


@query("prediction_outcomes", "WITH " + TX + """
SELECT row_id, CASE WHEN score >= 0.485 THEN 1 ELSE 0 END::TINYINT AS predicted,
  CASE WHEN label = 1 AND score >= 0.485 THEN 'true_positive' WHEN label = 0 AND score >= 0.485 THEN 'false_positive'
       WHEN label = 1 THEN 'false_negative' ELSE 'true_negative' END AS outcome FROM tx""")
def prediction_outcomes(spark, sf):
    return M.outcome(flagged(spark, sf)).select("row_id", "predicted", "outcome")


@query("metrics_by_group", "WITH " + TX + AUC.format(g="returnflag", s="score") + """, per_score AS (
  SELECT returnflag AS g, score, sum(label) AS pos, count(*) AS c FROM tx GROUP BY ALL),
run AS (SELECT g, pos, sum(pos) OVER w AS tp, sum(c) OVER w AS flagged, sum(pos) OVER (PARTITION BY g) AS p FROM per_score
  WINDOW w AS (PARTITION BY g ORDER BY score DESC ROWS UNBOUNDED PRECEDING)),
ap AS (SELECT g, sum(pos::DOUBLE / p * tp / flagged) AS pr_auc FROM run GROUP BY g),
cm AS (SELECT returnflag AS g, count(*) FILTER (label = 0 AND score <= 0.5) AS tn, count(*) FILTER (label = 0 AND score > 0.5) AS fp,
    count(*) FILTER (label = 1 AND score <= 0.5) AS fn, count(*) FILTER (label = 1 AND score > 0.5) AS tp FROM tx GROUP BY 1)
SELECT g AS returnflag, round((tn + tp)::DOUBLE / (tn + fp + fn + tp), 9) AS accuracy,
  round((rank_sum - sides.p * (sides.p + 1) / 2) / (sides.p * sides.n), 9) AS roc_auc, round(pr_auc, 9) AS pr_auc
FROM cm JOIN sides USING (g) JOIN ap USING (g)""")
def metrics_by_group(spark, sf):
    out = M.classification_metrics(transactions(spark, sf), by=["returnflag"])
    return rounded(out.select("returnflag", "accuracy", "roc_auc", "pr_auc"))


@query("comparison_table", "WITH " + TX + AUC.format(g="0", s="score") + """, both_models AS (
  SELECT 'price' AS model, score AS s, label FROM tx UNION ALL SELECT 'discount', tied, label FROM tx),
cm AS (SELECT model, count(*) FILTER (label = 0 AND s < 0.485) AS tn, count(*) FILTER (label = 0 AND s >= 0.485) AS fp,
  count(*) FILTER (label = 1 AND s < 0.485) AS fn, count(*) FILTER (label = 1 AND s >= 0.485) AS tp FROM both_models GROUP BY model)
SELECT model, round_even((tn + tp)::DOUBLE / (tn + fp + fn + tp), 4) AS accuracy, round_even(coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0), 4) AS precision,
  round_even(coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0), 4) AS recall FROM cm""")
def comparison_table(spark, sf):
    from ..operators.joins import comparison_table as stack

    tx = transactions(spark, sf)
    rows = [
        M.compute_metrics(M.classify(tx, 0.485, score=s), name, score=s) for name, s in (("price", "score"), ("discount", "tied"))
    ]
    return stack(*rows).select("model", "accuracy", "precision", "recall")


@query("thinned_curve", steps("score") + F1 + """, placed AS (
  SELECT *, row_number() OVER (ORDER BY threshold) - 1 AS r, greatest(1, count(*) OVER () // 1500) AS k FROM points)
SELECT round(threshold, 9) AS threshold, round(f1, 9) AS f1 FROM placed WHERE r % k = 0""")
def thinned_curve(spark, sf):
    return rounded(thin(M.threshold_table(transactions(spark, sf)), "threshold").select("threshold", F.col("f1")))
