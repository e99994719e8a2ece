"""Poisson replication: moments, large rates and odd rows; the whole table is compared with SQL."""

import math

from pyspark.sql import functions as F

from riskframe.llm import mixing as M


def test_cuts_are_the_distribution(spark):
    rates = spark.createDataFrame([("a", 0.3), ("b", 7.5), ("c", 90_000.0), ("d", 0.0)], "source string, rate double")
    rows = {r.source: r for r in M.poisson_cuts(rates).collect()}
    assert set(rows) == {"a", "b", "c"}
    for source, rate in (("a", 0.3), ("b", 7.5)):
        p = [math.exp(k * math.log(rate) - rate - math.lgamma(k + 1)) for k in range(25)]
        assert rows[source].first == 0
        assert all(abs(sum(p[: k + 1]) - rows[source].cuts[k]) < 1e-12 for k in range(25))
    c = rows["c"]
    assert c.first > 0 and abs(c.cuts[-1] - 1) < 1e-6
    assert abs(c.cuts[90_000 - c.first] - 0.5) < 0.01


def test_counts_have_mean_and_variance_of_the_rate(spark):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.lit("x").alias("text"))
    cuts = M.poisson_cuts(spark.createDataFrame([("s", 2.5)], "source string, rate double"))
    n = M.repetitions(docs, cuts).agg(F.avg("__n").alias("m"), F.var_samp("__n").alias("v")).head()
    assert abs(n.m - 2.5) < 0.05 and abs(n.v - 2.5) < 0.1


ROWS = [(i, "abcdefghij" if i % 3 else "abc", f"s{i % 4}" if i % 5 else None) for i in range(4000)]


def test_sources_reach_their_shares(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, source string")
    out = M.mix_sources(docs, {None: 1, "s0": 3, "s1": 0}).withColumn("size", F.length("text"))
    sizes = {r.source: r.size for r in out.groupBy("source").agg(F.sum("size").alias("size")).collect()}
    assert set(sizes) == {None, "s0"}
    assert abs(sizes["s0"] / sum(sizes.values()) - 0.75) < 0.03


def test_odd_rows_and_repeatable(spark):
    rows = [(1, None, "only null"), (None, "x", "a"), (2, "", "a"), (3, "yy", None), (3, "yy", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "5 AS copy", "6 AS rate")
    runs = [sorted(map(str, M.mix_sources(d, total=100.0).collect())) for d in (docs, docs.repartition(7))]
    assert runs[0] == runs[1] and not any("only null" in r for r in runs[0])
    out = M.mix_sources(docs, total=100.0)
    assert sorted(out.columns) == sorted(docs.columns)
    twins = out.filter("doc_id = 3").groupBy("copy").count().collect()
    assert twins and all(r["count"] == 2 for r in twins)
    assert M.mix_sources(docs.limit(0)).count() == 0


def test_order_is_shuffled_over_partitions(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, source string")
    ids = [r.doc_id for r in M.mix_sources(docs).select("doc_id").collect()]
    rising = sum(a < b for a, b in zip(ids, ids[1:])) / len(ids)
    assert 0.4 < rising < 0.6
