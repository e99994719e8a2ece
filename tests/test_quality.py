import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskframe.operators import profile as P
from riskframe.operators import quality as Q
from riskframe.operators.joins import check_alignment, lookup, require_alignment, union_all


@pytest.fixture
def odd(spark):
    nan = float("nan")
    rows = [(1, 1.0, 0), (2, nan, 0), (3, None, 1), (4, -0.0, 0), (5, 0.0, 0), (6, nan, 0), (7, None, 0), (8, math.inf, 1)]
    return spark.createDataFrame(rows, "id int, x double, y int")


def test_missing_and_infinite(odd):
    assert Q.missing_counts(odd, ["x"]).first()["missing_count"] == 4
    assert Q.infinite_counts(odd, ["x"]).first()["infinite_count"] == 1


def test_duplicates_follow_table_equality(odd):
    row = Q.duplicate_audit(odd, ["x", "y"], "y").first()
    assert tuple(row) == (2, 4, 2, 0)
    assert Q.drop_exact_duplicates(odd, ["x", "y"], ["id"]).count() == 6
    assert Q.drop_exact_duplicates(odd, ["x", "y"]).count() == 6
    assert Q.drop_exact_duplicates(odd, ["x", "y"], decision=False).count() == 8
    assert tuple(Q.conflicting_labels(odd, ["x"], "y").first()) == (1, 2)


def test_hot_groups_are_marked_like_others(spark):
    df = spark.range(300).select("id", F.when(F.col("id") < 150, 0).otherwise(F.col("id") % 40).alias("x"))
    marked = Q.mark_duplicates(df, ["x"], ["id"])
    groups = {}
    for r in df.collect():
        groups.setdefault(r["x"], []).append(r["id"])
    want = {i: (i != min(g), len(g) > 1) for g in groups.values() for i in g}
    assert {r["id"]: (r["is_copy"], r["in_group"]) for r in marked.collect()} == want


def test_row_key_is_unique_for_huge_groups(spark):
    df = spark.range(1000).select(F.when(F.col("id") < 700, "same").otherwise(F.col("id").cast("string")).alias("c"))
    keyed = Q.with_row_key(df, ["c"], chunk=50)
    assert keyed.count() == 1000 == keyed.select("row_id").distinct().count()
    assert keyed.filter("c = 'same'").count() == 700


def test_constant_column_has_no_correlation(spark):
    df = spark.createDataFrame([(1.0, 2.0, 0), (1.0, 3.0, 1), (1.0, 5.0, 1)], "a double, b double, y int")
    found = {r["feature"]: r["correlation_with_class"] for r in P.target_correlation(df, "y").collect()}
    assert found["a"] is None and found["b"] == pytest.approx(np.corrcoef([2, 3, 5], [0, 1, 1])[0, 1])


def test_correlation_matrix_uses_complete_pairs(spark):
    nan = float("nan")
    data = np.array([[1, 2, nan], [2, 1, 4], [3, nan, 5], [4, 7, 1], [5, 3, 2]])
    df = spark.createDataFrame([tuple(float(v) for v in r) for r in data], "a double, b double, c double")
    found = {(r["a"], r["b"]): r["correlation"] for r in P.correlation_matrix(df).collect()}
    for i, a in enumerate("abc"):
        for j, b in enumerate("abc"):
            both = ~np.isnan(data[:, i]) & ~np.isnan(data[:, j])
            assert found[a, b] == pytest.approx(np.corrcoef(data[both, i], data[both, j])[0, 1])


def test_histogram_edges(spark):
    values = [0.0, 0.1, 0.2, 0.3, 0.7, 1.0, 1.0]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    rows = P.histogram(df, "x", 10, density=True).orderBy("bin").collect()
    counts, edges = np.histogram(values, 10)
    assert [r["count"] for r in rows] == counts.tolist()
    assert [r["left"] for r in rows] == pytest.approx(edges[:-1].tolist())
    assert sum(r["density"] * (r["right"] - r["left"]) for r in rows) == pytest.approx(1.0)
    flat = P.histogram(df.select(F.lit(3.0).alias("x")), "x", 4).orderBy("bin").collect()
    assert [r["count"] for r in flat] == [0, 0, 7, 0] and flat[0]["left"] == 2.5


def test_class_distribution_lists_absent_classes(spark):
    df = spark.createDataFrame([(0,), (0,)], "y int")
    rows = Q.class_distribution(df, "y").orderBy("class").collect()
    assert [(r["count"], r["percentage"]) for r in rows] == [(2, 100.0), (0, 0.0)]
    assert rows[0]["majority_ratio"] is None


def test_fingerprint_ignores_order_and_sees_changes(spark):
    df = spark.range(100).withColumn("x", F.col("id") * 2)
    first = Q.fingerprint(df, ["id", "x"]).first()
    assert Q.fingerprint(df.orderBy(F.desc("id")), ["id", "x"]).first() == first
    assert Q.fingerprint(df.withColumn("x", F.when(F.col("id") == 5, 0).otherwise(F.col("x"))), ["id", "x"]).first() != first


def test_overlap_and_uncovered(spark):
    a = spark.createDataFrame([(1, None), (1, None), (2, 1.0)], "a int, b double")
    b = spark.createDataFrame([(1, None), (3, 1.0)], "a int, b double")
    assert [tuple(r) for r in Q.overlap(a, b, ["a", "b"]).collect()] == [(1, None)]
    assert sorted(tuple(r)[::2] for r in Q.uncovered(a, b).collect()) == [(1, 1), (2, 1)]


def test_checks_name_the_failure(spark):
    raw = spark.createDataFrame([(1, 0), (1, 0), (2, 1)], "x int, y int")
    bad = Q.assert_clean(raw, raw, raw, raw, ["x", "y"])
    with pytest.raises(AssertionError, match="no duplicates left"):
        Q.require_checks(bad)


def test_lookup_and_alignment(spark):
    facts = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    names = spark.createDataFrame([("a", "x")], "k string, n string")
    assert lookup(facts, names, ["k"], strict=False).count() == 2
    with pytest.raises(KeyError):
        lookup(facts, names, ["k"])
    other = spark.createDataFrame([("a", 9), ("c", 2)], "k string, v int")
    assert tuple(check_alignment(facts, other, ["k"], "v").first()) == (1, 1, 1, 1)
    with pytest.raises(ValueError):
        require_alignment(facts, other, ["k"], "v")
    assert union_all(facts, names).columns == ["k", "v", "n"]


def test_cells_of_a_row_can_be_told_apart(spark):
    rows = [("x", None), (None, "x"), ("\\N", "x"), ("a\u001fb", "c"), ("a", "b\u001fc"), ("a\\", "\u001f"), ("a", "\\\u001f")]
    df = spark.createDataFrame(rows, "a string, b string")
    assert Q.with_row_key(df, ["a", "b"]).select("row_id").distinct().count() == len(rows)
    prints = {tuple(Q.fingerprint(df.filter(F.struct("a", "b").eqNullSafe(F.struct(F.lit(a).cast("string").alias("a"), F.lit(b).cast("string").alias("b")))), ["a", "b"]).first()) for a, b in rows}
    assert len(prints) == len(rows)


def test_infinite_cells(spark):
    inf = float("inf")
    df = spark.createDataFrame([(1.0, 2.0, 0), (inf, 3.0, 1), (1.0, 5.0, 1)], "a double, b double, y int")
    found = {r["feature"]: r["correlation_with_class"] for r in P.target_correlation(df, "y").collect()}
    assert found["a"] is None and P.top_abs(P.target_correlation(df, "y"), "correlation_with_class", 1).first()["feature"] == "b"
    matrix = {(r["a"], r["b"]): r["correlation"] for r in P.correlation_matrix(df, ["a", "b"]).collect()}
    assert matrix["a", "b"] is None and matrix["b", "b"] == pytest.approx(1.0)
    with pytest.raises(Exception, match="infinite"):
        P.histogram(df, "a", 4).collect()


def test_box_statistics_leave_missing_cells_out(spark):
    nan = float("nan")
    df = spark.createDataFrame([(0, x) for x in (1.0, 2.0, 3.0, nan, nan, None, 100.0)], "g int, x double")
    row = P.box_stats(df, F.col("x"), "g").first()
    assert row["outliers"] == 1 and row["median"] == 2.5
