"""Fitted models: validation, selection, locked evaluation, scoring and tree explanations.

Fits have no SQL equivalent, so most entries carry none; tests check their invariants.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.frames import cut_lineage, shared_folder
from ..operators import explain as E
from ..operators import metrics as M
from ..operators.features import feature_names
from ..operators.models import BALANCED, DT, LR, RF, SMOTE, SUBSAMPLE, Candidate, Columns, bootstrap_draws, bootstrap_weights, fit, predict
from ..operators.sampling import stratified_split
from ..operators.scoring import score, score_summary, score_upload
from ..operators.selection import cv_summary, leaderboard, metric_bars
from ..operators.node_trees import node_table
from ..operators.tree_shap import base_value
from ..operators.validation import (
    DT_GRID, cross_validate, expand_grid, fold_results, fold_table, grid_search, oof_scores, random_search, validate,
)
from ..plans.cleaning import clean_and_split
from ..plans.evaluation import final_evaluation
from ..plans.explanation import explain_model
from ..plans.scoring import score_file
from ..plans.selecting import compare_strategies, select_and_freeze
from ..sources.tables import read_split
from .fixtures import FEATURES, TX, transactions
from .registry import query, rounded

ROLES = Columns("row_id", "label", tuple(FEATURES), "amount", "days")
LOGISTIC = Candidate("lr_log1p_balanced", LR, BALANCED, "log1p", {"C": 1.0})
TREE = Candidate("dt_balanced", DT, BALANCED, params={"max_depth": 4})
FOREST = Candidate("rf_balanced", RF, BALANCED, params={"n_estimators": 10, "max_depth": 4})


def training(spark, sf):
    return transactions(spark, sf).select("row_id", "label", *FEATURES)


def _folder(spark) -> str:
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"


def _untimed(folds):
    return folds.drop("fit_time_seconds", "score_time_seconds")


@query("logistic_cross_validation")
def logistic_cross_validation(spark, sf):
    return _untimed(cross_validate(LOGISTIC, training(spark, sf), ROLES, parallelism=5))


@query("candidate_comparison")
def candidate_comparison(spark, sf):
    specs = [LOGISTIC, TREE, FOREST]
    folds = fold_table(training(spark, sf), ROLES)
    results = fold_results(specs, validate(specs, folds, ROLES, parallelism=4, counted=True))
    return leaderboard(cv_summary(cut_lineage(results)).drop("fit_time_seconds_mean", "fit_time_seconds_total"))


# Every row is scored exactly once: checked by counts per fold and class.
@query("out_of_fold_coverage", "WITH " + TX + """, s AS (SELECT label, count(*) AS n, (sum(count(*)) OVER (ORDER BY label) - count(*))::BIGINT AS first FROM tx GROUP BY label)
SELECT label, (f + 1)::INTEGER AS fold, ((first + n - f + 4) // 5 - (first - f + 4) // 5)::BIGINT AS n_rows FROM s CROSS JOIN range(5) r(f)""")
def out_of_fold_coverage(spark, sf):
    scores = oof_scores(LOGISTIC, training(spark, sf), ROLES, parallelism=5)
    return scores.filter("score between 0 and 1").groupBy("label", "fold").agg(F.count(F.lit(1)).alias("n_rows"))


@query("frozen_threshold")
def frozen_threshold(spark, sf):
    return M.best_threshold(oof_scores(FOREST, training(spark, sf), ROLES, parallelism=5))


@query("strategy_comparison")
def strategy_comparison(spark, sf):
    specs = [LOGISTIC, Candidate("lr_plain", LR, params={"C": 1.0})]
    folds = fold_table(training(spark, sf), ROLES)
    table = compare_strategies(cut_lineage(fold_results(specs, validate(specs, folds, ROLES, parallelism=4, counted=True))))
    return table.drop("fit_time_seconds_mean", "fit_time_seconds_total")


@query("metric_bars")
def bars(spark, sf):
    folds = cut_lineage(cross_validate(LOGISTIC, training(spark, sf), ROLES, parallelism=5))
    return metric_bars(cv_summary(folds))


@query("grid_search")
def searched(spark, sf):
    specs = expand_grid(LR, {"C": [0.1, 1.0], "class_weight": [None, "balanced"]})
    _, best, results = grid_search(specs, training(spark, sf), ROLES, parallelism=4)
    return cv_summary(results).drop("fit_time_seconds_mean", "fit_time_seconds_total").withColumn("best", F.col("candidate_id") == best.candidate_id)


@query("random_search")
def searched_at_random(spark, sf):
    specs = expand_grid(LR, {"C": [0.01, 0.1, 1.0, 10.0], "class_weight": [None, "balanced"]})
    _, _, results = random_search(specs, 2, training(spark, sf), ROLES, parallelism=4)
    return cv_summary(results).drop("fit_time_seconds_mean", "fit_time_seconds_total")


@query("smote_model")
def smote_model(spark, sf):
    divided = cut_lineage(stratified_split(training(spark, sf), "label", ["row_id"]))
    train, test = (divided.filter(F.col("split") == p).drop("split") for p in ("train", "test"))
    scored = predict(fit(Candidate("lr_smote", LR, SMOTE, params={"C": 1.0}), train, ROLES), test)
    return M.classification_metrics(cut_lineage(scored))


# Draws and class weights of each tree's bootstrap sample, from the Poisson(1) steps.
@query("bootstrap_class_weights", "WITH " + TX + """, trees AS (SELECT row_id, label, unnest(range(4)) AS tree FROM tx),
draws AS (SELECT tree, label, ('0x' || substr(md5(replace(row_id, '\\', '\\\\') || '|42/tree/' || tree), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM trees),
steps AS (SELECT k, sum(exp(-1.0::DOUBLE) / gamma(k + 1)) OVER (ORDER BY k) AS step FROM range(13) r(k)),
counted AS (SELECT tree, label, sum((SELECT count(*) FROM steps WHERE step <= u))::BIGINT AS n FROM draws GROUP BY tree, label)
SELECT tree::INTEGER AS tree, label, n, round(sum(n) OVER (PARTITION BY tree) / (2.0::DOUBLE * n), 9) AS weight FROM counted""")
def bootstrap_class_weights(spark, sf):
    rows = training(spark, sf).select("label", bootstrap_draws("row_id", 4).alias("draws"))
    return rounded(bootstrap_weights(rows, "label", 4))


@query("weights_per_bootstrap")
def weights_per_bootstrap(spark, sf):
    data = training(spark, sf)
    spec = Candidate("rf_subsample", RF, SUBSAMPLE, params={"n_estimators": 4, "max_depth": 4})
    return M.classification_metrics(cut_lineage(predict(fit(spec, data, ROLES), data)))


@query("tree_importance")
def tree_importance(spark, sf):
    data = training(spark, sf)
    return E.global_importance(E.explain(fit(FOREST, data, ROLES), data, ["row_id"]))


# Tree contributions of every row must add up to the forest's probability.
@query("tree_additivity", "WITH " + TX + "SELECT count(*) AS n_rows, true AS adds_up FROM tx")
def tree_additivity(spark, sf):
    data = training(spark, sf)
    model = fit(FOREST, data, ROLES)
    gap = E.additivity(E.explain(model, data, ["row_id"]), predict(model, data), ["row_id"])
    return gap.select("n_rows", (F.col("max_error") <= 1e-6).alias("adds_up"))


# The root of a balanced tree holds one half, that of an unweighted one the positive rate.
@query("tree_base_value", "WITH " + TX + "SELECT count(*) AS n_rows, 0.5::DOUBLE AS balanced, round(avg(label), 9) AS unweighted FROM tx")
def tree_base(spark, sf):
    data = cut_lineage(training(spark, sf))
    plain = Candidate("dt_plain", DT, params={"max_depth": 2})
    values = {name: F.round(F.lit(base_value(fit(spec, data, ROLES), spark)), 9) for name, spec in (("balanced", TREE), ("unweighted", plain))}
    return data.agg(F.count(F.lit(1)).alias("n_rows")).withColumns(values)


# A tree of one split: the cut with the least squared error over all values of two features, and its shares.
@query("tree_best_split", "WITH " + TX + """, cells AS (
  SELECT 'quantity' AS feature, quantity AS v, label FROM tx UNION ALL SELECT 'discount', discount, label FROM tx),
counts AS (SELECT feature, v, count(*) AS n, sum(label) AS p FROM cells GROUP BY ALL),
cuts AS (SELECT feature, (v + lead(v) OVER w) / 2 AS threshold, sum(n) OVER u AS nl, sum(p) OVER u AS pl,
  sum(n) OVER (PARTITION BY feature) AS nt, sum(p) OVER (PARTITION BY feature) AS pt FROM counts
  WINDOW w AS (PARTITION BY feature ORDER BY v), u AS (PARTITION BY feature ORDER BY v ROWS UNBOUNDED PRECEDING)),
gains AS (SELECT *, pl * pl / nl + (pt - pl) * (pt - pl) / (nt - nl) AS gain FROM cuts WHERE nt > nl)
SELECT feature, round(threshold, 9) AS threshold, round(pl / nl, 9) AS low_share, round((pt - pl) / (nt - nl), 9) AS high_share
FROM gains ORDER BY gain DESC LIMIT 1""")
def tree_best_split(spark, sf):
    data = training(spark, sf)
    roles = Columns("row_id", "label", ("discount", "quantity"), "discount", None)
    model = fit(Candidate("stump", DT, params={"max_depth": 1}), data, roles)
    nodes = node_table(model.stages[-1], spark).withColumn("share", F.col("stats")[1] / (F.col("stats")[0] + F.col("stats")[1]))
    names = F.array(*[F.lit(n) for n in feature_names(model)])
    root = nodes.filter("left >= 0").select(names[F.col("feature")].alias("feature"), "threshold", "left", "right")
    shares = nodes.select("id", "share")
    low, high = (shares.withColumnsRenamed({"id": side, "share": f"{name}_share"}) for side, name in (("left", "low"), ("right", "high")))
    return rounded(root.join(low, "left").join(high, "right").select("feature", "threshold", "low_share", "high_share"))


# Two levels of splits; a side of the first with fewer than a fifth of all rows is not split again.
@query("tree_least_rows", "WITH " + TX + """, cells AS (
  SELECT 'quantity' AS feature, quantity AS v, label FROM tx UNION ALL SELECT 'discount', discount, label FROM tx),
counts AS (SELECT feature, v, count(*) AS n, sum(label) AS p FROM cells GROUP BY ALL),
cuts AS (SELECT feature, (v + lead(v) OVER w) / 2 AS threshold, sum(n) OVER u AS nl, sum(p) OVER u AS pl,
  sum(n) OVER (PARTITION BY feature) AS nt, sum(p) OVER (PARTITION BY feature) AS pt FROM counts
  WINDOW w AS (PARTITION BY feature ORDER BY v), u AS (PARTITION BY feature ORDER BY v ROWS UNBOUNDED PRECEDING)),
root AS (SELECT *, pl * pl / nl + (pt - pl) * (pt - pl) / (nt - nl) AS gain FROM cuts WHERE nt > nl ORDER BY gain DESC LIMIT 1),
sided AS (SELECT quantity, discount, label, CASE WHEN CASE feature WHEN 'quantity' THEN quantity ELSE discount END <= threshold THEN 'low' ELSE 'high' END AS side FROM tx, root),
sizes AS (SELECT side, count(*) AS n, sum(label) AS p FROM sided GROUP BY side),
cells2 AS (SELECT side, 'quantity' AS feature, quantity AS v, label FROM sided UNION ALL SELECT side, 'discount', discount, label FROM sided),
counts2 AS (SELECT side, feature, v, count(*) AS n, sum(label) AS p FROM cells2 GROUP BY ALL),
cuts2 AS (SELECT side, sum(n) OVER u AS nl, sum(p) OVER u AS pl, sum(n) OVER t AS nt, sum(p) OVER t AS pt FROM counts2
  WINDOW t AS (PARTITION BY side, feature), u AS (PARTITION BY side, feature ORDER BY v ROWS UNBOUNDED PRECEDING)),
best2 AS (SELECT *, pl * pl / nl + (pt - pl) * (pt - pl) / (nt - nl) AS gain FROM cuts2 WHERE nt > nl AND nt >= (SELECT count(*) // 5 FROM tx)
  AND gain > pt * pt / nt + 1e-9 QUALIFY row_number() OVER (PARTITION BY side ORDER BY gain DESC) = 1),
leaves AS (SELECT side AS leaf, n, p FROM sizes WHERE side NOT IN (SELECT side FROM best2)
  UNION ALL SELECT side || '/low', nl, pl FROM best2 UNION ALL SELECT side || '/high', nt - nl, pt - pl FROM best2)
SELECT leaf, n::BIGINT AS n_rows, round(p / n, 9) AS share FROM leaves""")
def tree_least_rows(spark, sf):
    data = training(spark, sf)
    roles = Columns("row_id", "label", ("discount", "quantity"), "discount", None)
    model = fit(Candidate("dt_least_rows", DT, params={"max_depth": 2, "min_samples_split": data.count() // 5}), data, roles)
    nodes = node_table(model.stages[-1], spark)
    steps = nodes.filter("left >= 0").select(F.explode(F.array(F.struct(F.col("left").alias("id"), F.lit("low").alias("step"), F.col("id").alias("up")),
                                                              F.struct(F.col("right").alias("id"), F.lit("high").alias("step"), F.col("id").alias("up")))).alias("s")).select("s.*")
    above = steps.select(F.col("id").alias("up"), F.col("step").alias("first"))
    paths = steps.join(above, "up", "left").select("id", F.concat_ws("/", "first", "step").alias("leaf"))
    share = (F.col("stats")[1] / (F.col("stats")[0] + F.col("stats")[1])).alias("share")
    return rounded(nodes.filter("left < 0").join(paths, "id").select("leaf", "n_rows", share))


# The published grid of single trees: 90 combinations from one grown tree per leaf size, weighting and fold; two folds, as full trees take long.
@query("published_tree_grid")
def published_tree_grid(spark, sf):
    specs = expand_grid(DT, DT_GRID)
    folds = fold_table(training(spark, sf), ROLES, 2)
    results = cv_summary(cut_lineage(fold_results(specs, validate(specs, folds, ROLES, parallelism=4, counted=True))))
    return leaderboard(results.drop("fit_time_seconds_mean", "fit_time_seconds_total"))


@query("logistic_contributions")
def logistic_contributions(spark, sf):
    data = training(spark, sf)
    return E.importance(E.explain(fit(LOGISTIC, data, ROLES), data, ["row_id"]))


@query("rows_scored")
def rows_scored(spark, sf):
    data = training(spark, sf)
    model = fit(LOGISTIC, data, ROLES)
    meta = {"feature_order": FEATURES, "threshold": 0.485}
    return score(model, meta, data.select("row_id", *FEATURES), ["row_id"], "amount")


def _digit():
    return F.substring(F.md5("row_id"), 1, 1)


def _broken_amount(amount, digit):
    """A broken cell for three of sixteen digits; the digit is looked up, so it is worked out once."""
    broken = F.create_map(*map(F.lit, ("1", "abc", "2", "inf", "3", "-5")))
    return F.coalesce(F.try_element_at(broken, digit), amount)


# Broken cells put in by hash; how many rows are rejected is known, the scores are not.
@query("upload_with_broken_cells", "WITH " + TX + """
SELECT count(*) FILTER (substr(md5(row_id), 1, 1) NOT IN ('1', '2', '3')) AS scored, count(*) FILTER (substr(md5(row_id), 1, 1) IN ('1', '2', '3')) AS rejected FROM tx""")
def upload_with_broken_cells(spark, sf):
    data = training(spark, sf)
    model = fit(LOGISTIC, data, ROLES)
    broken = data.withColumns({c: F.col(c).cast("string") for c in FEATURES}).withColumn("amount", _broken_amount(F.col("amount").cast("string"), _digit()))
    meta = {"feature_order": FEATURES, "threshold": 0.485}
    return score_summary(*score_upload(model, meta, broken, "amount")).select("scored", "rejected")


# Three of sixteen rows get a broken cell, one of sixteen loses its last cells; the file is read as text.
@query("file_scored", "WITH " + TX + """, kinds AS (SELECT substr(md5(row_id), 1, 1) AS d FROM tx)
SELECT CASE WHEN d IN ('1', '2', '3', '4') THEN CASE d WHEN '1' THEN 'missing or non-numeric: Amount' WHEN '2' THEN 'infinite value'
  WHEN '3' THEN 'negative Amount' ELSE 'another number of cells' END ELSE 'scored' END AS outcome, count(*) AS n_rows FROM kinds GROUP BY 1""")
def file_scored(spark, sf):
    data = training(spark, sf).withColumnsRenamed({"days": "Time", "quantity": "V1", "discount": "V2", "tax": "V3", "amount": "Amount", "label": "Class"})
    feats = ["Time", "V1", "V2", "V3", "Amount"]
    model = fit(LOGISTIC, data, Columns("row_id", "Class", tuple(feats)))
    cells = [*[F.col(c).cast("string") for c in ("row_id", "Time", "V1", "V2", "V3")], F.col("Class").cast("string")]

    def line(digit):  # bound once
        whole = F.concat_ws(",", *cells[:5], _broken_amount(F.col("Amount").cast("string"), digit), cells[5])
        return F.when(digit == "4", F.concat_ws(",", *cells[:5])).otherwise(whole)

    lines = data.select(F.transform(F.array(_digit()), line)[0].alias("value"))
    path = f"{_folder(spark)}/upload.csv"
    # Whole lines as one column each, so that ragged ones can be written; every part file begins with the header.
    lines.withColumnRenamed("value", "row_id,time,pca_1,V_2,v3,AMOUNT,is_fraud").write.options(header=True, sep="\u0001").csv(path)
    done = score_file(spark, path, model, {"feature_order": feats, "threshold": 0.485})
    scored = done.ranked.select(F.lit("scored").alias("outcome"))
    return scored.unionByName(done.rejected.select(F.col("reason").alias("outcome"))).groupBy("outcome").agg(F.count(F.lit(1)).alias("n_rows"))


@query("clean_and_split", "WITH " + TX + """, d AS (SELECT label, count(*) AS n FROM (SELECT DISTINCT days, quantity, amount, discount, tax, label FROM tx) GROUP BY label),
draws AS (SELECT label, n, sum(n) OVER () AS total, (sum(n) OVER () - ceil(sum(n) OVER () * 0.2))::BIGINT AS m FROM d),
base AS (SELECT *, floor(n * m / total)::BIGINT AS low FROM draws),
q AS (SELECT *, low + CASE WHEN row_number() OVER (ORDER BY low - n * m / total, label) <= m - sum(low) OVER () THEN 1 ELSE 0 END AS train FROM base)
SELECT 'raw' AS partition, count(*) AS "rows", sum(label)::BIGINT AS fraudulent FROM tx
UNION ALL SELECT 'cleaned', sum(n)::BIGINT, sum(n) FILTER (label = 1)::BIGINT FROM q
UNION ALL SELECT 'train', sum(train)::BIGINT, sum(train) FILTER (label = 1)::BIGINT FROM q
UNION ALL SELECT 'test_locked', sum(n - train)::BIGINT, sum(n - train) FILTER (label = 1)::BIGINT FROM q""")
def cleaned_and_split(spark, sf):
    _, summary = clean_and_split(training(spark, sf).select("row_id", *FEATURES, "label"), _folder(spark), ["row_id"], "label")
    return summary.select("partition", "rows", "fraudulent")


@query("locked_evaluation")
def locked_evaluation(spark, sf):
    return _study(spark, sf)[2]["metrics"]


@query("case_explanations")
def case_explanations(spark, sf):
    folder, _, tables, model = _study(spark, sf)
    train, test = (read_split(spark, f"{folder}/split/data", part) for part in ("train", "test"))
    predictions = tables["predictions"]
    return explain_model(model, train, test, predictions, ROLES)[1]["case_contributions"]


def _study(spark, sf):
    """Clean, split, select, freeze and evaluate once."""
    folder = _folder(spark)
    record, _ = clean_and_split(training(spark, sf).select("row_id", *FEATURES, "label"), f"{folder}/split", ["row_id"], "label")
    train = read_split(spark, f"{folder}/split/data", "train")
    frozen, _ = select_and_freeze([TREE, FOREST], train, ROLES, parallelism=4)
    chosen, point = frozen["selected_candidate"]["candidate_id"], frozen["threshold_selection"]["threshold"]
    facts, tables = final_evaluation(spark, frozen, record, f"{folder}/split/data", ROLES, f"{folder}/final", chosen, point)
    from ..sources.models import load_model

    return folder, facts, tables, load_model(f"{folder}/final/frozen_model", spark)
