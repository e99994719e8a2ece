import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from riskframe.operators.quantiles import cap_at_quantile, exact_quantiles, quantile_value

PROBS = [0.0, 0.25, 0.5, 0.995, 1.0]


def shapes():
    rng = np.random.default_rng(1)
    return {
        "ties": np.repeat([1.0, 2.0, 7.5], [50, 1, 9]),
        "heavy": np.append(np.exp(rng.normal(0, 3, 400)), [1e300, -1e300]),
        "tiny": np.array([3.25]),
        "pair": np.array([5.0, -5.0]),
        "close": 1e9 + rng.random(300) * 1e-6,
    }


@pytest.mark.parametrize("name", list(shapes()))
@pytest.mark.parametrize("accuracy", [20, 10_000])
def test_equals_sorted_interpolation(spark, name, accuracy):
    values = shapes()[name]
    rows = [(float(v),) for v in values] + [(None,), (float("nan"),)]
    df = spark.createDataFrame(rows, "x double")
    found = {r["prob"]: r["value"] for r in exact_quantiles(df, ["x"], PROBS, accuracy=accuracy).collect()}
    for p in PROBS:
        assert found[p] == pytest.approx(np.quantile(values, p), rel=1e-12, abs=1e-12)


def test_groups_columns_and_empty_groups(spark):
    rows = [(i % 2, float(i), None if i % 2 else float(-i)) for i in range(101)]
    df = spark.createDataFrame(rows, "g int, a double, b double")
    for accuracy in (10, 10_000):
        found = {(r["g"], r["feature"]): r["value"] for r in exact_quantiles(df, ["a", "b"], [0.5], ["g"], accuracy=accuracy).collect()}
        assert found == {(0, "a"): 50.0, (0, "b"): -50.0, (1, "a"): 50.0, (1, "b"): None}


def test_infinite_values_are_ordered(spark):
    df = spark.createDataFrame([(float("-inf"),), (1.0,), (float("inf"),)], "x double")
    found = [r["value"] for r in exact_quantiles(df, ["x"], [0.0, 0.5, 1.0]).orderBy("prob").collect()]
    assert found == [float("-inf"), 1.0, float("inf")]


def test_cap(spark):
    df = spark.createDataFrame([(float(i),) for i in range(1000)], "x double")
    assert quantile_value(df, "x", 0.995) == pytest.approx(994.005)
    assert cap_at_quantile(df, "x").count() == 995


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(-1e6, 1e6), min_size=1, max_size=30), st.floats(0, 1))
def test_counting_equals_numpy(spark, values, p):
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = exact_quantiles(df, ["x"], [p], accuracy=4).first()["value"]
    assert got == pytest.approx(np.quantile(values, p), rel=1e-9, abs=1e-9)


def test_any_distribution_takes_two_passes(spark, monkeypatch):
    """Powers of two over the whole range of doubles, and the largest double itself."""
    from riskframe.operators import quantiles

    stored = []
    monkeypatch.setattr(quantiles, "cut_lineage", lambda df, keep=quantiles.cut_lineage: stored.append(1) or keep(df))
    values = [2.0**i for i in range(-1000, 1000)] + [1.7976931348623157e308]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    found = {r["prob"]: r["value"] for r in exact_quantiles(df, ["x"], [0.0, 0.5, 1.0], accuracy=50).collect()}
    assert found == {0.0: 2.0**-1000, 0.5: 1.0, 1.0: 1.7976931348623157e308}
    assert len(stored) == 2  # brackets and counts; the rows are read twice


def test_names_with_dots_and_spaces(spark):
    df = spark.createDataFrame([(1.0, "a"), (3.0, "a")], "`x.y z` double, `g.h` string")
    row = exact_quantiles(df, ["x.y z"], [0.5], ["g.h"]).first()
    assert tuple(row) == ("a", "x.y z", 0.5, 2.0)


@pytest.mark.parametrize("rows, accuracy", [(None, 10_000), (7, 10)])
def test_training_sides_of_all_folds_at_once(spark, monkeypatch, rows, accuracy):
    from riskframe.operators import quantiles as Q

    if rows:
        monkeypatch.setattr(Q, "WINDOW_ROWS", rows)
    rng = np.random.default_rng(8)
    data = [(int(i % 3), float(rng.exponential()), float(rng.integers(0, 5)) if i % 11 else None) for i in range(900)]
    data += [(0, 100.0, float("nan")), (2, float("-inf"), 1.0)]
    df = spark.createDataFrame(data, "fold int, a double, b double")
    found = {(r["fold"], r["feature"], r["prob"]): r["value"] for r in Q.quantiles_without(df, ["a", "b"], [0.25, 0.5, 0.75], "fold", [0, 1, 2], accuracy).collect()}
    assert len(found) == 18
    for f in range(3):
        for j, c in ((1, "a"), (2, "b")):
            side = [r[j] for r in data if r[0] != f and r[j] is not None and r[j] == r[j]]
            for p in (0.25, 0.5, 0.75):
                assert found[f, c, p] == pytest.approx(np.quantile(side, p), rel=1e-12)


def test_running_counts_in_bounded_parts(spark):
    from riskframe.operators.quantiles import running_counts

    rows = [(g, float(v), int(v % 4 + 1)) for g in range(3) for v in range(500)]
    placed = running_counts(spark.createDataFrame(rows, "g int, place double, m int"), ["g"], rows=40)
    window = [o for o in placed._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Window" in o]
    assert any("__part" in o for o in window)
    got = {(r["g"], r["place"]): r["upto"] for r in placed.collect()}
    for g in range(3):
        upto = 0
        for v in range(500):
            upto += v % 4 + 1
            assert got[g, float(v)] == upto
