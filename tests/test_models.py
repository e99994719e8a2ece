import csv

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskframe.operators import explain as E
from riskframe.operators import models as M
from riskframe.operators import node_trees as N
from riskframe.operators import validation as V
from riskframe.operators.metrics import classify, outcome
from riskframe.operators.scoring import score, score_summary, score_upload
from riskframe.operators.selection import cv_summary, leaderboard, winner
from riskframe.plans import clean_and_split, explain_model, final_evaluation, profile_report, score_file, select_and_freeze
from riskframe.plans.scoring import UnsuitableSchema
from riskframe.sources import load_checked, load_model, read_split, save_model, save_preprocessing
from riskframe.streaming import score_stream

FEATS = ["Time", "V1", "V2", "Amount"]
COLS = M.Columns("row_id", "Class", tuple(FEATS))
LOGISTIC = M.Candidate("lr", M.LR, M.BALANCED, params={"C": 1.0})
TREE = M.Candidate("dt", M.DT, M.BALANCED, params={"max_depth": 3})


@pytest.fixture(scope="module")
def raw(spark):
    rng = np.random.default_rng(9)
    rows = []
    for i in range(600):
        y = int(i % 10 == 0)
        rows.append((i, float(i), float(rng.normal() + 2 * y), float(rng.normal() - y), float(rng.exponential(40)), y))
    rows += [(1000 + r[0], *r[1:]) for r in rows[:30]]
    return spark.createDataFrame(rows, "row_id int, Time double, V1 double, V2 double, Amount double, Class int")


@pytest.fixture(scope="module")
def model(raw):
    return M.fit(LOGISTIC, raw, COLS)


def test_registry():
    ids = [c.candidate_id for c in M.candidates()]
    assert len(ids) == 17 == len(set(ids))
    assert [sum(c.model == k for c in M.candidates()) for k in (M.LR, M.DT, M.RF)] == [8, 2, 7]


def test_registry_tables(spark):
    table = M.candidate_table(spark, M.candidates())
    assert table.filter("strategy = 'smote'").count() == 3
    values = {(r["candidate_id"], r["parameter"]): r["value"] for r in M.params_table(spark, M.candidates()).collect()}
    assert values["rf_balanced_200", "numTrees"] == "200" and values["rf_balanced_200_leaf2", "minInstancesPerNode"] == "2"
    assert values["lr_log1p_none_c01", "C"] == "0.1" and values["dt_original_default", "maxDepth"] == "30"


@pytest.mark.parametrize("spec", [
    M.Candidate("x", "Boosting"), M.Candidate("x", M.DT, params={"min_samples_split": 1}), M.Candidate("x", M.DT, params={"criterion": "entropy"}), M.Candidate("x", M.LR, params={"solver": "liblinear"}),
    M.Candidate("x", M.LR, "oversample"), M.Candidate("x", M.LR, M.SUBSAMPLE), M.Candidate("x", M.LR, amount_transform="sqrt"),
])
def test_unknown_choices_are_refused(raw, spec):
    with pytest.raises(ValueError):
        M.fit(spec, raw, COLS)


def test_logistic_minimises_the_stated_objective(raw, model):
    """Gradient of 0.5*|w|^2 + C * sum(weight * loss) vanishes at the fitted weights."""
    rows = model.transform(raw).select("features", "Class").collect()
    x = np.array([r["features"].toArray() for r in rows])
    y = np.array([r["Class"] for r in rows])
    n = np.bincount(y)
    weight = len(y) / (2 * n[y])
    w, b = model.stages[-1].coefficients.toArray(), model.stages[-1].intercept
    p = 1 / (1 + np.exp(-(x @ w + b)))
    gradient = w + x.T @ (weight * (p - y))
    assert np.abs(gradient).max() < 0.05 and abs((weight * (p - y)).sum()) < 0.05


@pytest.mark.parametrize("strategy, kind", [(M.SMOTE, M.LR), (M.SMOTE, M.RF), (M.SUBSAMPLE, M.RF), (M.ORIGINAL, M.DT)])
def test_strategies_fit(raw, strategy, kind):
    params = {M.LR: {"C": 1.0}, M.RF: {"n_estimators": 3, "max_depth": 3}, M.DT: {"max_depth": 3}}[kind]
    scored = M.fit_predict(M.Candidate("x", kind, strategy, params=params), raw, raw, COLS)
    row = scored.agg(F.min("score"), F.max("score"), F.count("predicted")).first()
    assert 0 <= row[0] < row[1] <= 1 and row[2] == 630


def test_models_are_saved_and_checked(spark, raw, model, tmp_path):
    path = str(tmp_path / "m")
    with pytest.raises(FileNotFoundError):
        load_checked(spark, path, FEATS)
    meta = {"feature_order": FEATS, "threshold": 0.485}
    save_model(model, path, meta, spark)
    loaded, found = load_checked(spark, path, FEATS)
    assert found["threshold"] == 0.485
    want = [r["score"] for r in M.predict(model, raw).orderBy("row_id").collect()]
    assert [r["score"] for r in M.predict(loaded, raw).orderBy("row_id").collect()] == want
    with pytest.raises(ValueError, match="other features"):
        load_checked(spark, path, FEATS[::-1])
    save_model(model, path, {**meta, "threshold": 1.5}, spark)
    with pytest.raises(ValueError, match="cut 1.5"):
        load_checked(spark, path, FEATS)
    save_preprocessing(model, str(tmp_path / "p"))
    bag = M.fit(M.Candidate("b", M.RF, M.SUBSAMPLE, params={"n_estimators": 2, "max_depth": 2}), raw, COLS)
    save_model(bag, str(tmp_path / "b"), meta, spark)
    again = load_model(str(tmp_path / "b"), spark)
    assert M.predict(again, raw).agg(F.sum("score")).first() == pytest.approx(M.predict(bag, raw).agg(F.sum("score")).first())


def test_cross_validation_scores_each_row_once(raw):
    folds = V.fold_table(raw, COLS, 3)
    scores = V.oof_scores(LOGISTIC, folds, COLS, parallelism=3)
    assert scores.count() == 630 == scores.select("row_id").distinct().count()
    rows = V.cross_validate(LOGISTIC, folds, COLS).collect()
    assert sorted(r["fold"] for r in rows) == [1, 2, 3] and all(r["roc_auc"] > 0.8 for r in rows)


def test_search_refits_the_best(raw):
    specs = V.expand_grid(M.LR, {"C": [0.001, 1.0], "class_weight": [None, "balanced"]})
    assert [s.strategy for s in specs] == [M.ORIGINAL, M.BALANCED] * 2
    assert len(V.expand_grid(M.DT, V.DT_GRID)) == 90 and len(V.expand_grid(M.RF, V.RF_GRID)) == 96
    fitted, best, results = V.grid_search(specs[:2], raw, COLS, k=2, parallelism=2)
    top = leaderboard(cv_summary(results)).first()["candidate_id"]
    assert best.candidate_id == top and M.predict(fitted, raw).count() == 630


def test_leaderboard_order(spark):
    rows = [("a", 0.5, 0.1, 0.4), ("b", 0.5, 0.05, 0.3), ("c", 0.4, 0.0, 0.9), ("d", 0.5, 0.05, 0.35)]
    summary = spark.createDataFrame(rows, "candidate_id string, pr_auc_mean double, pr_auc_std double, f1_mean double")
    assert [r["candidate_id"] for r in leaderboard(summary).collect()] == ["d", "b", "a", "c"]
    registry = spark.createDataFrame([("d", "x"), ("a", "y")], "candidate_id string, model string")
    assert winner(summary, registry).first()["model"] == "x"


META = {"feature_order": FEATS, "threshold": 0.485}


def test_strict_scoring(raw, model):
    out = score(model, META, raw.select("row_id", *FEATS), ["row_id"])
    assert out.columns == ["row_id", "fraud_probability", "predicted_class", "threshold"]
    assert out.filter((F.col("fraud_probability") >= 0.485) != (F.col("predicted_class") == 1)).count() == 0
    with pytest.raises(ValueError, match="below zero"):
        score(model, META, raw.select(*FEATS).withColumn("Amount", -F.col("Amount")))


def test_upload_keeps_original_cells(raw, model):
    text = raw.select("row_id", *[F.concat(F.lit(" "), F.col(c).cast("string")).alias(c) for c in FEATS]).withColumn("note", F.lit("n"))
    bad = text.withColumn("V1", F.when(F.col("row_id") == 3, "x").otherwise(F.col("V1")))
    valid, rejected = score_upload(model, META, bad)
    assert valid.columns == ["row_id", *FEATS, "note", "fraud_probability", "predicted_class"]
    assert valid.first()["Time"].startswith(" ")
    summary = score_summary(valid, rejected).first()
    assert (summary["scored"], summary["rejected"]) == (629, 1)
    none, everything = score_upload(model, META, bad.withColumn("V2", F.lit("?")))
    empty = score_summary(none, everything).first()
    assert (empty["scored"], empty["rejected"], empty["flag_rate"]) == (0, 630, None)


def test_file_job(spark, raw, model, tmp_path):
    path = str(tmp_path / "u.csv")
    with open(path, "w", newline="") as f:
        out = csv.writer(f)
        out.writerow(["time", "V_1", "pca2", " AMOUNT ", "is_fraud", "merchant"])
        out.writerows([[r["Time"], r["V1"], r["V2"], r["Amount"], r["Class"], "m"] for r in raw.collect()])
    done = score_file(spark, path, model, META, str(tmp_path / "out"))
    assert done.summary.first()["scored"] == 630 and done.metrics.first()["tp"] > 0
    ranked = [r["fraud_probability"] for r in done.ranked.collect()]
    assert ranked == sorted(ranked, reverse=True)
    spark.createDataFrame([("x", 1.0)], "merchant string, amount double").write.parquet(str(tmp_path / "e.parquet"))
    with pytest.raises(UnsuitableSchema, match="other terms|not in the file"):
        score_file(spark, str(tmp_path / "e.parquet"), model, META)


def test_stream_scores_like_the_batch(spark, raw, model, tmp_path):
    text = raw.select("row_id", *[F.col(c).cast("string").alias(c) for c in FEATS])
    text = text.withColumn("Amount", F.when(F.col("row_id") < 5, "-1").otherwise(F.col("Amount")))
    text.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(text.schema).parquet(str(tmp_path / "in"))
    paths = [str(tmp_path / p) for p in ("ok", "bad", "cp")]
    score_stream(stream, model, META, *paths).awaitTermination(120)
    assert spark.read.parquet(paths[0]).count() == 625 and spark.read.parquet(paths[1]).count() == 5


def test_whole_study(spark, raw, tmp_path):
    split, summary = clean_and_split(raw, str(tmp_path / "split"), ["row_id"])
    rows = {r["partition"]: r["rows"] for r in summary.collect()}
    assert rows == {"raw": 630, "cleaned": 600, "train": 480, "test_locked": 120}
    data = str(tmp_path / "split" / "data")
    train = read_split(spark, data, "train")
    frozen, tables = select_and_freeze([LOGISTIC, TREE], train, COLS, str(tmp_path / "sel"), k=3, parallelism=3)
    assert tables["fold_results"].count() == 6 and not frozen["test_data_loaded"]
    chosen, cut = frozen["selected_candidate"]["candidate_id"], frozen["threshold_selection"]["threshold"]
    args = (spark, frozen, split, data, COLS, str(tmp_path / "final"))
    with pytest.raises(ValueError, match="approved"):
        final_evaluation(*args, chosen, cut + 0.1)
    with pytest.raises(ValueError, match="split record"):
        final_evaluation(spark, frozen, {"fingerprints": {}}, data, COLS, str(tmp_path / "x"), chosen, cut)
    facts, out = final_evaluation(*args, chosen, cut)
    assert facts["test_rows"] == 120 and facts["test_positives"] == 12 and out["report"].count() == 5
    with pytest.raises(RuntimeError, match="only once"):
        final_evaluation(*args, chosen, cut)
    fitted = M.fit(TREE, train, COLS)
    test = read_split(spark, data, "test")
    predictions = outcome(classify(M.predict(fitted, test), 0.5), "Class").select("row_id", F.col("Class").alias("label"), "score", "predicted", "outcome")
    error, explained = explain_model(fitted, train, test, predictions, COLS, n=100, top=3, path=str(tmp_path / "why"))
    assert error < 1e-9 and explained["cohort_importance"].count() == 4
    assert explained["cases"].filter(F.abs(F.col("reconstructed_probability") - F.col("score")) > 1e-9).count() == 0


def test_key_is_made_when_absent(spark, raw, tmp_path):
    record, _ = clean_and_split(raw.drop("row_id"), str(tmp_path / "s"))
    assert record["key"] == ["row_id"] and record["exact_duplicate_rows_removed"] == 30


def test_profile_report(raw):
    report = profile_report(raw, ["row_id"])
    facts = report["dataset_profile"].first()
    assert (facts["rows"], facts["exact_duplicate_rows_after_first"], facts["target_labels"]) == (630, 30, [0, 1])
    assert len(facts.asDict()) == 28 and all(t.count() > 0 for t in report.values())


def rare(spark, n=20_000):
    """2 % positive; twenty times as likely above a cut."""
    rng = np.random.default_rng(1)
    x, z = rng.random(n), rng.random(n)
    y = rng.random(n) < np.where(x > 0.9, 0.18, 0.002)
    rows = [(i, float(a), float(b), int(c)) for i, (a, b, c) in enumerate(zip(x, z, y))]
    return spark.createDataFrame(rows, "row_id int, x double, z double, Class int")


RARE = M.Columns("row_id", "Class", ("x", "z"), "z", None)


def test_unweighted_trees_keep_their_probabilities(spark):
    df = rare(spark)
    model = M.fit(M.Candidate("dt", M.DT, params={"max_depth": 1}), df, RARE)
    shares = {r["high"]: r["share"] for r in df.groupBy((F.col("x") > 0.9).alias("high")).agg(F.avg("Class").alias("share")).collect()}
    levels = sorted(r["score"] for r in M.predict(model, df).select("score").distinct().collect())
    assert len(levels) == 2
    assert levels[0] == pytest.approx(shares[False], rel=0.1) and levels[1] == pytest.approx(shares[True], rel=0.1)


@pytest.mark.parametrize("strategy", [M.ORIGINAL, M.SUBSAMPLE])
def test_forests_do_not_depend_on_the_input_partitions(spark, strategy):
    df = rare(spark, 3000)
    spec = M.Candidate("rf", M.RF, strategy, params={"n_estimators": 4, "max_depth": 4})
    sums = [M.predict(M.fit(spec, df.repartition(n), RARE), df).agg(F.sum(F.round("score", 9))).first()[0] for n in (4, 6)]
    assert sums[0] == pytest.approx(sums[1], abs=1e-6)


def test_deeper_trees_than_spark_grows_are_refused(raw):
    with pytest.raises(ValueError, match="max_depth"):
        M.fit(M.Candidate("x", M.DT, params={"max_depth": 31}), raw, COLS)


def _scores(model, raw):
    return [r["score"] for r in M.predict(model, raw).orderBy("row_id").collect()]


def test_cut_trees_equal_trees_that_stop_there(spark, raw):
    deep = M.fit(M.Candidate("deep", M.DT, params={"max_depth": 8}), raw, COLS)
    nodes = N.with_depth(N.node_table(deep.stages[-1], spark)).cache()
    assert nodes.agg(F.max("depth")).first()[0] <= 8 and nodes.filter("depth = 0").count() == 1
    prepared = deep.__class__(deep.stages[:-1])
    assert _scores(N.NodeForest(prepared, nodes), raw) == pytest.approx(_scores(deep, raw))
    for depth in (0, 1, 3):
        direct = M.fit(M.Candidate("d", M.DT, params={"max_depth": depth}), raw, COLS)
        assert _scores(N.NodeForest(prepared, N.cut(nodes, max_depth=depth)), raw) == pytest.approx(_scores(direct, raw))
    for least in (20, 200, 10_000):
        rows = {r["id"]: r for r in N.cut(nodes, least).collect()}
        whole = {r["id"]: r for r in nodes.collect()}
        inner = [i for i, r in rows.items() if r["left"] >= 0]
        assert all(rows[i]["n_rows"] >= least and {rows[i]["left"], rows[i]["right"]} <= set(rows) for i in inner)
        assert all(whole[i]["left"] < 0 or r["n_rows"] < least for i, r in rows.items() if r["left"] < 0)
        assert sum(r["n_rows"] for r in rows.values() if r["left"] < 0) == 630


def test_least_rows_of_forests(spark, raw, tmp_path):
    spec = M.Candidate("f", M.RF, M.BALANCED, params={"n_estimators": 3, "max_depth": 6, "min_samples_split": 60})
    model = M.fit(spec, raw, COLS)
    assert model.nodes.filter("left >= 0").agg(F.min("n_rows")).first()[0] >= 60 and model.nodes.select("tree").distinct().count() == 3
    save_model(model, str(tmp_path / "f"), {"feature_order": FEATS, "threshold": 0.5}, spark)
    again, _ = load_checked(spark, str(tmp_path / "f"), FEATS)
    assert _scores(again, raw) == _scores(model, raw)
    gap = E.additivity(E.explain(model, raw, ["row_id"]), M.predict(model, raw), ["row_id"]).first()
    assert gap["n_rows"] == 630 and gap["max_error"] < 1e-9


def test_candidates_that_share_a_grown_tree(raw):
    specs = V.expand_grid(M.DT, {"max_depth": [2, None], "min_samples_split": [2, 50], "min_samples_leaf": [1, 5]})
    folds = V.fold_table(raw, COLS, 2)
    shared = V.validate(specs, folds, COLS, 2)
    assert shared.timings.count() == 16 and shared.scores.count() == 8 * 630
    got = {(r["candidate_id"], r["row_id"]): r["score"] for r in shared.scores.collect()}
    for spec in (specs[1], specs[2], specs[7]):
        alone = V.validate([spec], folds, COLS).scores.collect()
        assert {r["row_id"]: r["score"] for r in alone} == pytest.approx({k[1]: s for k, s in got.items() if k[0] == spec.candidate_id})


def test_scores_of_trees_are_stored_once_with_their_number(raw):
    """A grid stored every held-out row once for each of its candidates."""
    specs = V.expand_grid(M.DT, {"max_depth": [1, 2]})
    folds = V.fold_table(raw, COLS, 2)
    counted, whole = V.validate(specs, folds, COLS, 2, counted=True), V.validate(specs, folds, COLS, 2)
    sizes = {r[0]: (r[1], r[2]) for r in counted.scores.groupBy("candidate_id").agg(F.count("n"), F.sum("n")).collect()}
    assert all(n == 630 for _, n in sizes.values()) and all(stored <= 16 for stored, _ in sizes.values())
    assert COLS.key not in counted.scores.columns
    a, b = (V.fold_results(specs, v).drop("fit_time_seconds", "score_time_seconds").orderBy("candidate_id", "fold").collect() for v in (counted, whole))
    assert [r[:5] for r in a] == [r[:5] for r in b] and all(x[5:] == pytest.approx(y[5:], abs=1e-12) for x, y in zip(a, b))


def test_the_chosen_candidate_is_not_fitted_again(raw, monkeypatch):
    from riskframe.plans import select_and_freeze

    fits, fit, tree = [], V.fit, TREE.with_params(max_depth=1)
    monkeypatch.setattr(V, "fit", lambda spec, *a, **o: fits.append(spec.candidate_id) or fit(spec, *a, **o))
    _, tables = select_and_freeze([tree], raw, COLS, k=2)
    assert len(fits) == 2
    scores = {r["row_id"]: r["score"] for r in V.oof_scores(tree, raw, COLS, 2).collect()}
    assert {r["row_id"]: r["score"] for r in tables["oof_scores"].collect()} == scores and len(scores) == 630


def test_published_grids_are_supported(spark):
    specs = [*V.expand_grid(M.DT, V.DT_GRID, "dt"), *V.expand_grid(M.RF, V.RF_GRID, "rf"), *V.expand_grid(M.LR, V.LR_GRID, "lr")]
    reasons = [r["reason"] for r in V.search_status(spark, specs).filter("NOT supported").collect()]
    assert len(reasons) == 8 and all("lbfgs" in r for r in reasons)


def test_a_fold_table_is_dealt_once_for_all_fits(raw):
    from riskframe.functions.frames import in_parts, spread

    folds = V.fold_table(raw.dropDuplicates(["row_id"]), COLS, 3)
    train = in_parts(folds, M.FIT_PARTITIONS).filter("fold <> 1")
    dealt = spread(folds.filter("fold <> 1"), ["row_id"], M.FIT_PARTITIONS, ordered=True)
    ids = [df.select("row_id").rdd.glom().collect() for df in (train, dealt)]
    assert ids[0] == ids[1] and len(ids[0]) == M.FIT_PARTITIONS
    plan = train._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort" not in plan
