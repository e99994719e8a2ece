import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from riskframe.operators import features as X
from riskframe.operators.neighbours import nearest_neighbours
from riskframe.operators.resample import smote
from riskframe.operators.sampling import class_sizes


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(0)
    rows = [(i, float(rng.integers(0, 100)), float(rng.exponential(50)), float(rng.normal()), 3.0, int(i % 5 == 0)) for i in range(200)]
    return spark.createDataFrame(rows, "row_id int, Time double, Amount double, V1 double, V2 double, Class int")


FEATS = ["Time", "V1", "V2", "Amount"]


@pytest.mark.parametrize("transform", ["original", "log1p"])
def test_prepared_values(table, transform):
    model = X.lr_preprocess(FEATS, amount_transform=transform).fit(table)
    assert X.feature_names(model) == ["Time", "Amount", "V1", "V2"]
    rows = model.transform(table).orderBy("row_id").select(vector_to_array("features").alias("v")).collect()
    got = np.array([r["v"] for r in rows])
    data = table.orderBy("row_id").toPandas()
    amount = np.log1p(data["Amount"]) if transform == "log1p" else data["Amount"]
    for j, x in ((0, data["Time"]), (1, amount)):
        assert got[:, j] == pytest.approx(((x - np.median(x)) / (np.quantile(x, 0.75) - np.quantile(x, 0.25))).to_numpy())
    assert got[:, 2] == pytest.approx(((data["V1"] - data["V1"].mean()) / data["V1"].std(ddof=0)).to_numpy())
    assert np.all(got[:, 3] == 0)


def test_statistics_come_from_fitting_rows_only(table):
    train = table.filter("row_id < 150")
    changed = train.unionByName(table.filter("row_id >= 150").withColumn("V1", F.lit(1e6)))
    first = X.lr_preprocess(FEATS).fit(train)
    second = X.lr_preprocess(FEATS).fit(changed.filter("row_id < 150"))
    assert first.stages[0].getStatement() == second.stages[0].getStatement()


def test_unknown_transform_is_refused():
    with pytest.raises(ValueError):
        X.lr_preprocess(FEATS, amount_transform="sqrt")


def test_tree_preparation_keeps_values(table):
    model = X.tree_preprocess(FEATS).fit(table)
    row = model.transform(table.filter("row_id = 3")).first()
    assert list(row["features"]) == [row["Time"], row["Amount"], row["V1"], row["V2"]]


def test_class_weights(table):
    found = {r["Class"]: r["weight"] for r in X.class_weights(table, "Class").collect()}
    assert found == pytest.approx({0: 200 / (2 * 160), 1: 200 / (2 * 40)})


@pytest.mark.parametrize("block", [6, 1000])
def test_neighbours_equal_brute_force(spark, block):
    rng = np.random.default_rng(2)
    x = np.round(rng.normal(size=(120, 3)), 2)
    x[:40] = x[0]  # a third of the points coincide
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id bigint, x array<double>")
    got = {}
    for r in nearest_neighbours(df, "id", "x", 4, leaf_rows=block).collect():
        got.setdefault(r["id"], []).append((r["rank"], r["neighbour"]))
    for i in range(120):
        away = np.sqrt(((x - x[i]) ** 2).cumsum(axis=1)[:, -1])
        order = [j for j in np.lexsort((np.arange(120), away)) if j != i][:4]
        assert [n for _, n in sorted(got[i])] == order


def test_oversampling_reaches_parity_between_minority_rows(spark, table):
    arrays = table.withColumn("x", F.array("Time", "V1"))
    made = smote(arrays, "Class", "row_id", "x", k=3)
    assert class_sizes(made, "Class") == {0: 160, 1: 160}
    assert made.select("row_id").distinct().count() == 320
    minority = np.array([r["x"] for r in arrays.filter("Class = 1").collect()])
    for r in made.filter("synthetic").collect():
        p = np.array(r["x"])
        legs = np.linalg.norm(minority - p, axis=1)
        span = np.linalg.norm(minority[:, None] - minority[None, :], axis=2)
        assert np.min(legs[:, None] + legs[None, :] - span) < 1e-9
    again = smote(arrays.repartition(7), "Class", "row_id", "x", k=3)
    assert sorted(map(str, again.collect())) == sorted(map(str, made.collect()))


def test_oversampling_needs_neighbours(spark):
    df = spark.createDataFrame([(i, int(i < 3), [float(i)]) for i in range(20)], "id int, y int, x array<double>")
    with pytest.raises(ValueError, match="neighbours"):
        smote(df, "y", "id", "x")


@pytest.mark.parametrize("transform", ["original", "log1p"])
def test_preparations_of_all_folds_at_once(table, transform):
    folded = table.withColumn("fold", F.col("row_id") % 3)
    prepare = X.lr_preprocess(FEATS, amount_transform=transform)
    made = prepare.fit_without(folded, "fold", [0, 1, 2])
    for f, model in made.items():
        alone = prepare.fit(folded.filter(F.col("fold") != f))
        rows = [[r["v"] for r in m.transform(table).orderBy("row_id").select(vector_to_array("features").alias("v")).collect()] for m in (model, alone)]
        assert np.array(rows[0]) == pytest.approx(np.array(rows[1]), rel=1e-9, abs=1e-9)
    sizes = {(r["fold"], r["Class"]): r["n"] for r in X.class_sizes_without(folded, "Class", "fold", [0, 1, 2]).collect()}
    assert sizes == {(f, c): folded.filter((F.col("fold") != f) & (F.col("Class") == c)).count() for f in range(3) for c in (0, 1)}


def _visits(spark, n, leaf_rows=64):
    """Leaves visited by all points of a cloud in three dimensions, its own apart."""
    from riskframe.operators import neighbours as K

    points = spark.range(n).select("id", F.array(*[F.randn(s) for s in range(3)]).alias("x")).cache()
    placed, nodes = K.metric_tree(points, leaf_rows, 16)
    placed = placed.cache()
    assert placed.count() == n and placed.groupBy("leaf").count().agg(F.max("count")).first()[0] <= leaf_rows
    # A limit as wide as the points of a leaf are apart near the centre of the cloud.
    asking = placed.withColumn("limit", F.lit(0.8 * n ** (-1 / 3)))
    return K.open_leaves(asking, nodes).count()


def test_visits_grow_with_the_points(spark):
    small, large = _visits(spark, 3_000), _visits(spark, 30_000)
    assert 0 < small and large < 20 * small


def test_neighbours_through_a_deep_tree(spark):
    rng = np.random.default_rng(4)
    x = np.round(np.concatenate((rng.normal(size=(150, 2)), 20 + rng.normal(size=(150, 2)) * 0.1, np.full((30, 2), 5.0))), 3)
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id bigint, x array<double>")
    got = {}
    for r in nearest_neighbours(df, "id", "x", 3, leaf_rows=20, fanout=3).collect():
        got.setdefault(r["id"], []).append((r["rank"], r["neighbour"]))
    for i in range(len(x)):
        away = np.sqrt(((x - x[i]) ** 2).cumsum(axis=1)[:, -1])
        order = [j for j in np.lexsort((np.arange(len(x)), away)) if j != i][:3]
        assert [n for _, n in sorted(got[i])] == order


def test_no_row_is_stored_for_a_point_and_a_leaf(spark, monkeypatch):
    """In many dimensions nearly all leaves stay open; a point must not be written once for each of them."""
    from riskframe.operators import neighbours as K

    rng = np.random.default_rng(6)
    x = rng.normal(size=(600, 16))
    df = spark.createDataFrame([(f"p{i}", r.tolist()) for i, r in enumerate(x)], "id string, x array<double>")
    sizes, store = [], K.cut_lineage

    def stored(frame):
        kept = store(frame)
        sizes.append(kept.count())
        return kept

    monkeypatch.setattr(K, "cut_lineage", stored)
    got = {}
    for r in nearest_neighbours(df, "id", "x", 2, leaf_rows=16).collect():
        got.setdefault(r["id"], []).append((r["rank"], r["neighbour"]))
    for i in range(600):
        order = np.argsort(((x - x[i]) ** 2).sum(axis=1))
        assert [n for _, n in sorted(got[f"p{i}"])] == [f"p{j}" for j in order if j != i][:2]
    assert max(sizes) <= 5 * 600
