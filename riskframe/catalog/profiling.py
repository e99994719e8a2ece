"""Column profiles of line items and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import profile as P
from ..operators import quantiles as N
from .fixtures import FEATURES, TX, table, transactions
from .registry import query, rounded

NUMBERS = ["days", "quantity", "amount", "discount", "tax"]


def _stats(c: str) -> str:
    return (
        f"count({c}) AS {c}_count, round_even(avg({c}), 6) AS {c}_mean, round_even(quantile_cont({c}, 0.5), 6) AS {c}_median, "
        f"round_even(stddev_samp({c}), 6) AS {c}_std, round_even(min({c}), 6) AS {c}_min, round_even(max({c}), 6) AS {c}_max"
    )


@query("class_statistics", "WITH " + TX + f"SELECT label, {_stats('amount')}, {_stats('days')} FROM tx GROUP BY label")
def class_statistics(spark, sf):
    return P.class_stats(transactions(spark, sf), "label", ["amount", "days"])


def _describe(c: str) -> str:
    return (
        f"SELECT '{c}' AS feature, count({c}) AS \"count\", round(avg({c}), 7) AS mean, round(stddev_samp({c}), 7) AS std, "
        f"round(min({c}), 7) AS \"min\", round(quantile_cont({c}, 0.25), 7) AS \"25%\", round(quantile_cont({c}, 0.5), 7) AS \"50%\", "
        f"round(quantile_cont({c}, 0.75), 7) AS \"75%\", round(max({c}), 7) AS \"max\" FROM tx"
    )


@query("describe", "WITH " + TX + " UNION ALL ".join(_describe(c) for c in NUMBERS))
def describe(spark, sf):
    return rounded(P.describe(transactions(spark, sf), NUMBERS), 7)


@query("dataset_profile", "WITH " + TX + """, g AS (SELECT days, quantity, amount, discount, tax, label, count(*) AS n FROM tx GROUP BY ALL),
f AS (SELECT days, quantity, amount, discount, tax, count(*) AS n, count(DISTINCT label) AS k FROM tx GROUP BY ALL),
t AS (SELECT count(*) AS n, count(*) FILTER (label = 0) AS n0, count(*) FILTER (label = 1) AS n1, min(amount) AS lo, quantile_cont(amount, 0.5) AS mid,
  avg(amount) AS mean, max(amount) AS hi, min(days) AS t0, max(days) AS t1, avg(amount) FILTER (label = 0) AS mean0,
  quantile_cont(amount, 0.5) FILTER (label = 0) AS mid0, avg(amount) FILTER (label = 1) AS mean1, quantile_cont(amount, 0.5) FILTER (label = 1) AS mid1 FROM tx)
SELECT n AS "rows", 6 AS columns, 5 AS predictor_columns, true AS all_columns_numeric, n0 AS legitimate_count, n1 AS fraud_count,
  round(n1 * 100.0 / n, 6)::DOUBLE AS fraud_percentage, round(n0::DOUBLE / n1, 6) AS legitimate_to_fraud_ratio,
  0::BIGINT AS missing_values_total, 0::BIGINT AS infinite_values_total,
  (SELECT sum(n - 1) FROM g)::BIGINT AS exact_duplicate_rows_after_first, (SELECT coalesce(sum(n) FILTER (n > 1), 0) FROM g)::BIGINT AS all_rows_in_exact_duplicate_groups,
  (SELECT coalesce(sum(n - 1) FILTER (label = 0), 0) FROM g)::BIGINT AS duplicate_rows_after_first_class_0,
  (SELECT coalesce(sum(n - 1) FILTER (label = 1), 0) FROM g)::BIGINT AS duplicate_rows_after_first_class_1,
  (SELECT count(*) FILTER (k > 1) FROM f) AS feature_identical_conflicting_label_groups,
  (SELECT coalesce(sum(n) FILTER (k > 1), 0) FROM f)::BIGINT AS rows_in_conflicting_label_groups,
  round(lo, 6) AS amount_min, round(mid, 6) AS amount_median, round(mean, 6) AS amount_mean, round(hi, 6) AS amount_max,
  round(t0, 6) AS time_min, round(t1, 6) AS time_max, round(mean0, 6) AS legitimate_amount_mean, round(mid0, 6) AS legitimate_amount_median,
  round(mean1, 6) AS fraud_amount_mean, round(mid1, 6) AS fraud_amount_median FROM t""")
def dataset_profile(spark, sf):
    facts = P.profile(transactions(spark, sf), "label", "amount", "days", FEATURES)
    return rounded(facts.drop("column_names", "target_labels"), 6)


@query("target_correlation", "WITH " + TX + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, round(corr({c}, label), 9) AS correlation_with_class FROM tx" for c in NUMBERS))
def target_correlation(spark, sf):
    return rounded(P.target_correlation(transactions(spark, sf), "label", NUMBERS))


@query("strongest_correlations", "WITH " + TX + ", c AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, round(corr({c}, label), 9) AS correlation_with_class FROM tx" for c in NUMBERS)
    + ") SELECT * FROM c ORDER BY abs(correlation_with_class) DESC LIMIT 2")
def strongest_correlations(spark, sf):
    return rounded(P.top_abs(P.target_correlation(transactions(spark, sf), "label", NUMBERS), "correlation_with_class", 2))


MATRIX = [*NUMBERS, "label"]


@query("correlation_matrix", "WITH " + TX + " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 9) AS correlation FROM tx" for a in MATRIX for b in MATRIX))
def correlation_matrix(spark, sf):
    return rounded(P.correlation_matrix(transactions(spark, sf), MATRIX))


@query("quantiles_by_group", "WITH " + TX + " UNION ALL ".join(
    f"SELECT returnflag, 'amount' AS feature, {p}::DOUBLE AS prob, round(quantile_cont(amount, {p}), 6) AS value FROM tx GROUP BY returnflag"
    for p in (0.005, 0.25, 0.5, 0.995)))
def quantiles_by_group(spark, sf):
    return rounded(N.exact_quantiles(transactions(spark, sf), ["amount"], [0.005, 0.25, 0.5, 0.995], ["returnflag"]), 6)


# The counting method for large tables, on the same question.
@query("quantiles_by_counting", "WITH ev AS (SELECT event_type, value FROM events)" + " UNION ALL ".join(
    f"SELECT event_type, 'value' AS feature, {p}::DOUBLE AS prob, round(quantile_cont(value, {p}), 6) AS value FROM ev GROUP BY event_type"
    for p in (0.25, 0.5, 0.9)))
def quantiles_by_counting(spark, sf):
    out = N.exact_quantiles(table(spark, sf, "events"), ["value"], [0.25, 0.5, 0.9], ["event_type"])
    return rounded(out, 6)


@query("amounts_up_to_cap", "SELECT event_id, value FROM events WHERE value <= (SELECT quantile_cont(value, 0.995) FROM events)")
def amounts_up_to_cap(spark, sf):
    return N.cap_at_quantile(table(spark, sf, "events").select("event_id", "value"), "value", 0.995)


HIST = """, span AS (SELECT {g} AS g, min({c}) AS lo, max({c}) AS hi, count({c}) AS n FROM {t} GROUP BY 1),
edges AS (SELECT g, b AS bin, n, lo + b * ((hi - lo) / {bins}) AS l, CASE WHEN b = {bins} - 1 THEN hi ELSE lo + (b + 1) * ((hi - lo) / {bins}) END AS r
  FROM span CROSS JOIN range({bins}) q(b)),
counted AS (SELECT edges.g, bin, l, r, any_value(n) AS n, count(x.v) AS c FROM edges LEFT JOIN (SELECT {g} AS g, {c} AS v FROM {t}) x
  ON x.g = edges.g AND x.v >= l AND (x.v < r OR (bin = {bins} - 1 AND x.v = r)) GROUP BY ALL)
"""


@query("histogram", "WITH ev AS (SELECT 0 AS g0, value FROM events)" + HIST.format(g="g0", c="value", t="ev", bins=70) + """
SELECT 'value' AS feature, bin::INTEGER AS bin, round(l, 9) AS "left", round(r, 9) AS "right", c AS "count" FROM counted""")
def histogram(spark, sf):
    return rounded(P.histogram(table(spark, sf, "events"), "value", 70))


@query("histogram_by_class", "WITH " + TX + HIST.format(g="label", c="days", t="tx", bins=60) + """
SELECT g AS label, 'days' AS feature, bin::INTEGER AS bin, round(l, 9) AS "left", round(r, 9) AS "right", c AS "count",
  round(c / (n * (r - l)), 9) AS density FROM counted""")
def histogram_by_class(spark, sf):
    return rounded(P.histogram(transactions(spark, sf), "days", 60, ["label"], density=True))


@query("box_statistics", """WITH v AS (SELECT event_type, ln(1 + value) AS x FROM events),
q AS (SELECT event_type, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.5) AS med, quantile_cont(x, 0.75) AS q3 FROM v GROUP BY 1),
j AS (SELECT *, x BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS inside FROM v JOIN q USING (event_type))
SELECT event_type, round(any_value(q1), 6) AS q1, round(any_value(med), 6) AS median, round(any_value(q3), 6) AS q3,
  round(min(x) FILTER (inside), 6) AS whisker_low, round(max(x) FILTER (inside), 6) AS whisker_high, count(*) FILTER (NOT inside) AS outliers
FROM j GROUP BY event_type""")
def box_statistics(spark, sf):
    return rounded(P.box_stats(table(spark, sf, "events"), F.log1p("value"), "event_type"), 6)
