import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskframe.operators import explain as E
from riskframe.operators.models import BALANCED, DT, LR, ORIGINAL, RF, SUBSAMPLE, Candidate, Columns, fit, predict
from riskframe.operators.node_trees import node_table
from riskframe.operators.tree_shap import base_value

FEATS = ("a", "b", "c")
COLS = Columns("id", "y", FEATS, "c", None)


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(300):
        a, b, c = (float(v) for v in np.round(rng.random(3), 2))
        rows.append((i, a, b, c, int(a + b * c + rng.normal() * 0.2 > 0.9)))
    return spark.createDataFrame(rows, "id int, a double, b double, c double, y int")


def brute(nodes, names, x):
    """Shapley values of one tree by enumerating feature subsets."""
    at = {r["id"]: r for r in nodes}

    def value(i, known):
        n = at[i]
        if n["left"] < 0:
            return n["stats"][1] / sum(n["stats"])
        if n["feature"] in known:
            return value(n["left"] if x[n["feature"]] <= n["threshold"] else n["right"], known)
        left, right = sum(at[n["left"]]["stats"]), sum(at[n["right"]]["stats"])
        return (left * value(n["left"], known) + right * value(n["right"], known)) / sum(n["stats"])

    m = len(names)
    out = np.zeros(m)
    for f in range(m):
        rest = [g for g in range(m) if g != f]
        for size in range(m):
            for s in itertools.combinations(rest, size):
                w = math.factorial(size) * math.factorial(m - size - 1) / math.factorial(m)
                out[f] += w * (value(0, {*s, f}) - value(0, set(s)))
    return out


@pytest.mark.parametrize("spec", [
    Candidate("dt", DT, BALANCED, params={"max_depth": 5}), Candidate("rf", RF, ORIGINAL, params={"n_estimators": 3, "max_depth": 4}),
    Candidate("bag", RF, SUBSAMPLE, params={"n_estimators": 2, "max_depth": 3}),
])
def test_tree_values_equal_enumeration(spark, data, spec):
    model = fit(spec, data, COLS)
    few = data.filter("id < 4")
    long = E.explain(model, few, ["id"]).collect()
    names = ["c", "a", "b"]  # amount comes first in the vector
    trees = {}
    for r in node_table(model.stages[-1], spark).collect():
        trees.setdefault(r["tree"], []).append(r)
    for row in few.collect():
        x = [row[n] for n in names]
        want = np.mean([brute(t, names, x) for t in trees.values()], axis=0)
        got = {r["feature"]: r["contribution"] for r in long if r["id"] == row["id"]}
        assert [got[n] for n in names] == pytest.approx(want.tolist(), abs=1e-12)
    assert E.require_additivity(E.explain(model, data, ["id"]), predict(model, data), ["id"]) < 1e-9
    assert base_value(model, spark) == pytest.approx(long[0]["base"])


def test_linear_values_add_up_to_log_odds(data):
    model = fit(Candidate("lr", LR, params={"C": 1.0}), data, COLS)
    long = E.explain(model, data, ["id"])
    p = predict(model, data).withColumn("score", F.log(F.col("score") / (1 - F.col("score"))))
    assert E.require_additivity(long, p, ["id"]) < 1e-9
    assert {r["feature"] for r in long.select("feature").distinct().collect()} == set(FEATS)


def test_sampled_values_add_up_and_find_additive_parts(data):
    def score(df):
        return df.withColumn("score", 2 * F.col("a") - F.col("b") + F.lit(0.5))

    few = data.filter("id < 20")
    long = E.sampled_shap(score, few, FEATS, data, ["id"], permutations=6)
    assert E.require_additivity(long, score(few), ["id"]) < 1e-9
    assert long.filter("feature = 'c' and abs(contribution) > 1e-12").count() == 0


def test_additivity_violation_is_an_error(spark):
    long = spark.createDataFrame([(1, "a", 0.5, 0.1)], "id int, feature string, contribution double, base double")
    with pytest.raises(ValueError, match="add up"):
        E.require_additivity(long, spark.createDataFrame([(1, 0.9)], "id int, score double"), ["id"])


def test_tables_from_contributions(spark):
    rows = [(1, f, float(i), v, 0.2) for i, (f, v) in enumerate([("a", 0.3), ("b", -0.5), ("c", 0.1), ("d", -0.05)])]
    long = spark.createDataFrame(rows, "id int, feature string, value double, contribution double, base double")
    wide, names = E.wide_of(long, ["id"])
    top = E.top_contributions(wide, names, 2, ["id"]).orderBy("rank").collect()
    assert [(r["feature"], r["direction"]) for r in top] == [("b", "toward legitimate"), ("a", "toward fraud")]
    bars = E.waterfall_data(wide, names, ["id"], 2).orderBy("position").collect()
    assert [r["feature"] for r in bars] == ["b", "a", "other features"]
    assert bars[0]["start"] == pytest.approx(0.2) and bars[-1]["end"] == pytest.approx(0.05)
    why = E.explain_rows(wide.withColumn("score", F.lit(0.05)), names, ["id"], 0.485, 2).first()
    assert why["predicted_class"] == "Legitimate"
    assert [c["feature"] for c in why["top_toward_fraud"]] == ["a", "c"]
    assert [c["feature"] for c in why["top_toward_legitimate"]] == ["b", "d"]
    assert [r["rank"] for r in E.global_importance(long).orderBy("rank").collect()] == [1, 2, 3, 4]
    assert E.importance_bars(long, 3).count() == 3


def test_representatives_are_nearest_the_median(spark):
    rows = [(i, s, "true_positive") for i, s in enumerate([0.9, 0.5, 0.7, 0.7])] + [(9, 0.1, "true_negative")]
    df = spark.createDataFrame(rows, "id int, score double, outcome string")
    got = {r["outcome"]: r for r in E.representative_rows(df, ["id"]).collect()}
    assert set(got) == {"true_positive", "true_negative"}
    assert (got["true_positive"]["id"], got["true_positive"]["category_size"], got["true_positive"]["position"]) == (2, 4, 1)


def test_sample_is_bounded(data):
    model = fit(Candidate("dt", DT, params={"max_depth": 2}), data, COLS)
    assert E.explain_sample(model, data, ["id"], 50).select("id").distinct().count() == 50


def test_tables_about_rows_shuffle_nothing(data):
    wide = E.linear_contributions(data, {"a": 1.0, "b": 2.0, "c": -1.0}, 0.5, ["id"], keep=["y"], wide=True).withColumn("score", F.lit(0.2))
    names = ["a", "b", "c"]
    for frame in (E.top_contributions(wide, names, 2, ["id"]), E.waterfall_data(wide, names, ["id"], 2), E.explain_rows(wide, names, ["id"], 0.5)):
        assert "Exchange" not in frame._jdf.queryExecution().executedPlan().toString()
        assert frame.count() > 0


def test_forests_are_explained_in_groups(spark, data, monkeypatch):
    from riskframe.operators import tree_shap

    model = fit(Candidate("rf", RF, ORIGINAL, params={"n_estimators": 5, "max_depth": 3}), data, COLS)
    few = data.filter("id < 20")
    whole = {(r["id"], r["feature"]): r["contribution"] for r in E.explain(model, few, ["id"]).collect()}
    monkeypatch.setattr(tree_shap, "NODES_AT_ONCE", 20)
    parts = {(r["id"], r["feature"]): r["contribution"] for r in E.explain(model, few, ["id"]).collect()}
    assert whole.keys() == parts.keys() and all(abs(whole[k] - parts[k]) < 1e-12 for k in whole)


def test_tabled_gains_equal_the_integral(spark, data):
    import numpy as np

    from riskframe.operators import tree_shap as T
    from riskframe.operators.node_trees import node_table

    model = fit(Candidate("rf", RF, ORIGINAL, params={"n_estimators": 5, "max_depth": 4}), data, COLS)
    leaves = T.leaf_paths(node_table(model.stages[-1], spark).toPandas())
    x = np.random.default_rng(3).normal(size=(300, len(COLS.features)))
    x[0, 0] = np.nan
    table = T.gain_table(leaves, x.shape[1])
    assert np.abs(T.looked_up(leaves, table, x) - T.contributions_of(leaves, x)).max() < 1e-12


def test_rows_to_explain_are_dealt_finely(spark, data):
    from riskframe.functions.frames import spread

    assert spread(data, ["id"]).rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism


def test_steps_of_sampled_walks_are_not_shuffled(spark, data):
    def score(rows):
        return rows.withColumn("score", F.col("a") * 2 + F.col("b"))

    few = data.select("id", "a", "b").filter("id < 12")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = E.sampled_shap(score, few, ["a", "b"], few, ["id"], permutations=3)
        plan = out._jdf.queryExecution().executedPlan().toString()
        once = {(r["id"], r["feature"]): r["contribution"] for r in out.collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # The sums per row stay where the walks came together, and strings or arrays are not sorted for them.
    assert "hashpartitioning(id#" not in plan and "SortAggregate" not in plan
    assert len(once) == 24
    # Rows of one key are summed together.
    pair = E.sampled_shap(score, few.union(few), ["a", "b"], few, ["id"], permutations=3)
    twice = {(r["id"], r["feature"]): r["contribution"] for r in pair.collect()}
    assert twice.keys() == once.keys() and all(twice[k] == pytest.approx(2 * v) for k, v in once.items())
