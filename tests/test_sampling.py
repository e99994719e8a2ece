import pytest
from pyspark.sql import functions as F

from riskframe.operators import sampling as S


@pytest.fixture(scope="module")
def rows(spark):
    return spark.range(1037).select(
        F.col("id").alias("key"), F.when(F.col("id") % 29 == 0, 1).otherwise(0).alias("y"), (F.col("id") * 3).alias("x"))


def test_published_allocation(spark):
    train = S.split_quotas(spark, {0: 283_253, 1: 473}, 0.2)
    assert train == {0: 226_602, 1: 378}
    assert {c: n - train[c] for c, n in {0: 283_253, 1: 473}.items()} == {0: 56_651, 1: 95}


def test_split_is_complete_exact_and_stable(rows):
    first = S.stratified_split(rows, "y", ["key"]).collect()
    again = S.stratified_split(rows.repartition(5), "y", ["key"]).collect()
    other = S.stratified_split(rows, "y", ["key"], seed=7).collect()
    parts = {r["key"]: r["split"] for r in first}
    assert len(first) == 1037 == len(parts)
    assert parts == {r["key"]: r["split"] for r in again} != {r["key"]: r["split"] for r in other}
    assert sum(p == "test" for p in parts.values()) == 208
    assert sum(r["y"] for r in first if r["split"] == "test") in (7, 8)


@pytest.mark.parametrize("k", [2, 5])
def test_folds_differ_by_one(rows, k):
    out = S.stratified_folds(rows, "y", ["key"], k)
    sizes = {}
    for r in out.groupBy("y", "fold").count().collect():
        sizes.setdefault(r["y"], []).append(r["count"])
    whole = [r["count"] for r in out.groupBy("fold").count().collect()]
    for s in (*sizes.values(), whole):
        assert len(s) == k and max(s) - min(s) <= 1


def test_cuts_follow_the_order_of_tokens(rows):
    from hashlib import md5

    parts = {r["key"]: (r["y"], r["split"]) for r in S.stratified_split(rows, "y", ["key"]).collect()}
    for y in (0, 1):
        order = sorted((k for k, (c, _) in parts.items() if c == y), key=lambda k: md5(f"{k}|42/split".encode()).hexdigest())
        test = sum(parts[k][1] == "test" for k in order)
        assert [parts[k][1] for k in order] == ["test"] * test + ["train"] * (len(order) - test)


def test_many_classes(spark):
    """More classes than any list on the driver should hold would do as well."""
    rows = spark.range(60_000).select(F.col("id").alias("key"), (F.col("id") % 12_000).alias("y"))
    out = S.stratified_folds(rows, "y", ["key"], 5)
    assert out.groupBy("fold").count().select("count").distinct().collect()[0][0] == 12_000
    assert out.groupBy("y", "fold").count().agg(F.max("count")).first()[0] == 1


def test_parts_of_any_size(rows):
    sizes = S.class_sizes(rows, "y")
    parts = S.parts_frame(rows, "y", {c: [0, 3, 0, n - 3, 0] for c, n in sizes.items()})
    for frame in (rows, rows.repartition(3)):
        out = S.hash_segments(frame, "y", parts, ["key"], 1, "part")
        assert {tuple(r) for r in out.groupBy("y", "part").count().collect()} == {
            (0, 1, 3), (0, 3, sizes[0] - 3), (1, 1, 3), (1, 3, sizes[1] - 3)}


def test_repeated_keys_are_refused(spark):
    df = spark.range(100).select(F.lit(1).alias("key"), (F.col("id") % 2).alias("y"))
    with pytest.raises(ValueError, match="not unique"):
        S.stratified_split(df, "y", ["key"])
    with pytest.raises(ValueError, match="not unique"):
        S.sample_exact(df, 10, ["key"])


def test_unfit_labels_are_refused(spark):
    one = spark.createDataFrame([(1, 0), (2, 0), (3, 1)], "key int, y int")
    with pytest.raises(ValueError, match="two rows"):
        S.stratified_split(one, "y", ["key"])
    gap = spark.createDataFrame([(1, 0), (2, None)], "key int, y int")
    with pytest.raises(ValueError, match="missing"):
        S.stratified_split(gap, "y", ["key"])


def test_exact_samples(rows, monkeypatch):
    small = {r["key"] for r in S.sample_exact(rows, 100, ["key"]).collect()}
    assert len(small) == 100
    assert S.sample_exact(rows, 5000, ["key"]).count() == 1037
    both = S.sample_by_class(rows, "y", 50, ["key"])
    assert {r["y"]: r["count"] for r in both.groupBy("y").count().collect()} == {0: 50, 1: 36}
    assert S.pick(rows, key=5).first()["x"] == 15
    assert S.preview(rows).count() == 5
