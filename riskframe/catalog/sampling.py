"""Seeded samples, splits and folds over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import sampling as S
from ..operators.joins import union_all
from .fixtures import TX, table, transactions
from .registry import query


@query("sample_exact", "WITH " + TX + "SELECT row_id, label FROM tx ORDER BY md5(row_id || '|42') LIMIT 2000")
def sample_exact(spark, sf):
    return S.sample_exact(transactions(spark, sf).select("row_id", "label"), 2000, ["row_id"])


@query("sample_by_class", "WITH " + TX + """
SELECT row_id, label FROM (SELECT row_id, label FROM tx WHERE label = 0 ORDER BY md5(row_id || '|42') LIMIT 2000)
UNION ALL SELECT row_id, label FROM tx WHERE label = 1""")
def sample_by_class(spark, sf):
    return S.sample_by_class(transactions(spark, sf).select("row_id", "label"), "label", 2000, ["row_id"])


# Largest remainders give the training rows per class; the test part comes first in md5 order.
@query("stratified_split", "WITH " + TX + """, s AS (SELECT label, count(*) AS n, sum(count(*)) OVER () AS total FROM tx GROUP BY label),
draws AS (SELECT label, n, (total - ceil(total * 0.2))::BIGINT AS m, n * (total - ceil(total * 0.2)) / total AS exact FROM s),
base AS (SELECT *, floor(exact)::BIGINT AS low, m - sum(floor(exact)::BIGINT) OVER () AS rest,
  row_number() OVER (ORDER BY floor(exact) - exact, label) AS place FROM draws),
q AS (SELECT label, n - low - CASE WHEN place <= rest THEN 1 ELSE 0 END AS test FROM base),
r AS (SELECT row_id, label, row_number() OVER (PARTITION BY label ORDER BY md5(row_id || '|42/split')) AS k FROM tx)
SELECT row_id, label, CASE WHEN k <= test THEN 'test' ELSE 'train' END AS split FROM r JOIN q USING (label)""")
def stratified_split(spark, sf):
    return S.stratified_split(transactions(spark, sf).select("row_id", "label"), "label", ["row_id"])


FOLDS = """, s AS (SELECT {c}, count(*) AS n, (sum(count(*)) OVER (ORDER BY {c}) - count(*))::BIGINT AS first FROM {t} GROUP BY {c}),
sizes AS (SELECT {c}, f, (first + n - f + 4) // 5 - (first - f + 4) // 5 AS size FROM s CROSS JOIN range(5) r(f)),
ends AS (SELECT {c}, f, sum(size) OVER (PARTITION BY {c} ORDER BY f) AS upto, size FROM sizes),
placed AS (SELECT {k}, {c}, row_number() OVER (PARTITION BY {c} ORDER BY md5({k} || '|42/folds')) AS place FROM {t})
SELECT {k}, {c}, (f + 1)::INTEGER AS fold FROM placed JOIN ends USING ({c}) WHERE place > upto - size AND place <= upto
"""


@query("stratified_folds", "WITH " + TX + FOLDS.format(c="label", t="tx", k="row_id"))
def stratified_folds(spark, sf):
    return S.stratified_folds(transactions(spark, sf).select("row_id", "label"), "label", ["row_id"])


# The same on a five-class label.
@query("stratified_folds_many_classes", "WITH ev AS (SELECT event_id, event_type FROM events)" + FOLDS.format(c="event_type", t="ev", k="event_id"))
def stratified_folds_many_classes(spark, sf):
    events = table(spark, sf, "events").select("event_id", "event_type")
    return S.stratified_folds(events, "event_type", ["event_id"])


@query("union_by_name", """
SELECT c_custkey AS key, c_acctbal AS balance, c_mktsegment AS segment FROM customer
UNION ALL SELECT s_suppkey, s_acctbal, NULL FROM supplier""")
def union_by_name(spark, sf):
    customers = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    suppliers = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_acctbal").alias("balance"))
    return union_all(customers, suppliers)
