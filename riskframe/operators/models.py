"""Classifiers as candidate specifications, fitted with Spark ML.

Trees are fitted as regressions of the 0/1 label: for two classes variance is half the gini
impurity, so the splits are those of a classification tree, and a leaf holds the class-1 share.
(Spark's classification trees merge sibling leaves that predict the same class, which erases
nearly every split of a rare label.) Rows are dealt to a fixed number of partitions and sorted by
key before every fit, so seeded forests do not depend on cores or on how the input was stored.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace
from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import DecisionTreeRegressor, RandomForestRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.frames import DEAL, cut_lineage, deal, in_parts
from ..functions.hashing import cell_text, hex_number
from ..schema import FEATURE_COLS, LABEL_COL, SEED
from .features import balanced_weight, class_sizes_without, lr_preprocess, tree_preprocess, weight_of_sizes
from .metrics import classify
from .node_trees import NodeForest, cut, node_table, stored_forest
from .resample import smote

LR, DT, RF = "Logistic Regression", "Decision Tree", "Random Forest"
ORIGINAL, BALANCED = "original_distribution", "class_weight_balanced"
SUBSAMPLE, SMOTE = "class_weight_balanced_subsample", "smote"
#: Depth of a tree without a limit; Spark grows none deeper.
DEEPEST = 30
#: Partitions of the fitting rows; part of a seeded result, so it is fixed and not taken from the cluster.
FIT_PARTITIONS = 16


@dataclass(frozen=True)
class Candidate:
    """What to fit: model kind, balancing strategy, amount transform and parameters."""

    candidate_id: str
    model: str
    strategy: str = ORIGINAL
    amount_transform: str = "original"
    params: Mapping[str, object] = field(default_factory=dict)
    source: str = ""

    def with_params(self, **params) -> Candidate:
        return replace(self, params={**self.params, **params})

    def as_row(self) -> tuple:
        params = {k: str(v) for k, v in self.params.items()}
        return (self.candidate_id, self.model, self.strategy, self.amount_transform, params, self.source)


SPEC_SCHEMA = (
    "candidate_id string, model string, strategy string, amount_transform string, "
    "params map<string,string>, source string"
)


@dataclass(frozen=True)
class Columns:
    """Column roles of a training table."""

    key: str = "row_id"
    label: str = LABEL_COL
    features: Sequence[str] = tuple(FEATURE_COLS)
    amount: str = "Amount"
    time: str | None = "Time"


# The published candidates in their published order.
CANDIDATES = [
    Candidate("lr_original_none_c1", LR, ORIGINAL, "original", {"C": 1.0}, "baseline"),
    Candidate("dt_original_default", DT, ORIGINAL, "original", {}, "baseline"),
    Candidate("rf_none_100", RF, ORIGINAL, "original", {"n_estimators": 100}, "baseline"),
    Candidate("lr_original_balanced_c1", LR, BALANCED, "original", {"C": 1.0}, "class weights"),
    Candidate("dt_balanced_default", DT, BALANCED, "original", {}, "class weights"),
    Candidate("rf_balanced_100", RF, BALANCED, "original", {"n_estimators": 100}, "class weights"),
    Candidate("lr_log1p_none_c01", LR, ORIGINAL, "log1p", {"C": 0.1}, "search"),
    Candidate("lr_log1p_none_c1", LR, ORIGINAL, "log1p", {"C": 1.0}, "search"),
    Candidate("lr_log1p_none_c10", LR, ORIGINAL, "log1p", {"C": 10.0}, "search"),
    Candidate("lr_log1p_balanced_c1", LR, BALANCED, "log1p", {"C": 1.0}, "search"),
    Candidate("lr_smote_original_c1", LR, SMOTE, "original", {"C": 1.0}, "search"),
    Candidate("lr_smote_log1p_c1", LR, SMOTE, "log1p", {"C": 1.0}, "search"),
    Candidate("rf_none_200", RF, ORIGINAL, "original", {"n_estimators": 200}, "search"),
    Candidate("rf_balanced_200", RF, BALANCED, "original", {"n_estimators": 200, "max_features": "sqrt"}, "search"),
    Candidate("rf_balanced_subsample_200", RF, SUBSAMPLE, "original", {"n_estimators": 200}, "search"),
    Candidate("rf_balanced_200_leaf2", RF, BALANCED, "original", {"n_estimators": 200, "min_samples_leaf": 2}, "search"),
    Candidate("rf_smote_100", RF, SMOTE, "original", {"n_estimators": 100}, "search"),
]


def candidates() -> list[Candidate]:
    return list(CANDIDATES)


def candidate_table(spark, specs: Sequence[Candidate]) -> DataFrame:
    return spark.createDataFrame([c.as_row() for c in specs], SPEC_SCHEMA)


def _tree_params(params: Mapping[str, object]) -> dict:
    if int(params.get("min_samples_split") or 2) < 2:
        raise ValueError("min_samples_split must be 2 or more")
    if params.get("criterion", "gini") != "gini":
        raise ValueError("Only the gini criterion is supported")
    depth = params.get("max_depth")
    if depth is not None and int(depth) > DEEPEST:
        raise ValueError(f"max_depth above {DEEPEST} is not supported")
    return {
        "maxDepth": DEEPEST if depth is None else int(depth),
        "minInstancesPerNode": int(params.get("min_samples_leaf") or 1),
        "maxBins": int(params.get("max_bins") or 256),
        "seed": int(params.get("random_state") or SEED),
        "maxMemoryInMB": int(params.get("max_memory_mb") or 1024),
    }


def classifier(spec: Candidate, weight_sum: float, label: str, weight: str | None):
    """Spark ML estimator of a candidate; an unknown kind or option raises."""
    params = dict(spec.params)
    columns = {"featuresCol": "features", "labelCol": label}
    if weight:
        columns["weightCol"] = weight
    if spec.model == LR:
        if params.get("solver", "lbfgs") != "lbfgs":
            raise ValueError("Only the lbfgs solver is supported")
        c = float(params.get("C", 1.0))
        return LogisticRegression(
            **columns, regParam=1.0 / (c * weight_sum), elasticNetParam=0.0, standardization=False,
            maxIter=int(params.get("max_iter", 1000)),
        )
    if spec.model == DT:
        return DecisionTreeRegressor(**columns, **_tree_params(params))
    if spec.model == RF:
        subset = params.get("max_features", "sqrt")
        return RandomForestRegressor(
            **columns, **_tree_params(params), numTrees=int(params.get("n_estimators", 100)),
            featureSubsetStrategy="all" if subset is None else str(subset),
        )
    raise ValueError(f"Unknown model kind: {spec.model}")


def preprocess_for(spec: Candidate, columns: Columns):
    if spec.model == LR:
        return lr_preprocess(columns.features, columns.amount, columns.time, spec.amount_transform)
    if spec.model in (DT, RF):
        return tree_preprocess(columns.features, columns.amount, columns.time)
    raise ValueError(f"Unknown model kind: {spec.model}")


def bootstrap_draws(key: str, trees: int, seed: object = SEED) -> Column:
    """Array over the trees: how often a row enters each tree's bootstrap sample, Poisson(1) draws from hashes."""
    mass, upto, cuts = 0.36787944117144233, 0.0, []
    for n in range(13):
        upto += mass
        cuts.append(upto)
        mass /= n + 1
    text, steps = cell_text(key), F.array(*map(F.lit, cuts))

    def drawn(tree: Column) -> Column:
        token = F.md5(F.concat_ws("|", text, F.concat(F.lit(f"{seed}/tree/"), tree.cast("string"))))
        return hex_number(token, 1, 8).cast("double") / F.lit(4294967296.0)

    # The number is bound once and compared with all steps.
    numbers = F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), drawn)
    return F.transform(numbers, lambda u: F.aggregate(steps, F.lit(0), lambda n, c: n + (c <= u).cast("int")))


def bootstrap_weights(rows: DataFrame, label: str, trees: int, draws: str = "draws") -> DataFrame:
    """tree, label, n (draws of the class in the tree's sample), weight (balanced); one pass for all trees."""
    sums = rows.groupBy(label).agg(F.array(*[F.sum(F.col(draws)[i]) for i in range(trees)]).alias("sums"))
    cells = sums.select(label, F.posexplode("sums").alias("tree", "n")).filter("n > 0")  # a row per tree and class
    tree = Window.partitionBy("tree")
    return cells.select("tree", label, "n", (F.sum("n").over(tree) / (F.count(F.lit(1)).over(tree) * F.col("n"))).alias("weight"))


def _fit_bagged(spec: Candidate, prepared: PipelineModel, rows: DataFrame, columns: Columns, at_once: int = 8) -> NodeForest:
    """A forest whose class weights follow each tree's own bootstrap sample; ``at_once`` trees are fitted side by side."""
    single, trees = spec.with_params(n_estimators=1), int(spec.params.get("n_estimators", 100))
    rows = cut_lineage(rows.withColumn("draws", bootstrap_draws(columns.key, trees)))
    weights: dict[int, dict] = {i: {} for i in range(trees)}
    for r in bootstrap_weights(rows, columns.label, trees).collect():
        weights[r["tree"]][r[columns.label]] = r["weight"]

    def one(i: int):
        weight = F
        for c, w in weights[i].items():
            weight = weight.when(F.col(columns.label) == c, F.lit(w))
        drawn = rows.filter(F.col("draws")[i] > 0).withColumn("__weight", weight * F.col("draws")[i])
        model = classifier(single.with_params(random_state=SEED + i), 0.0, columns.label, "__weight")
        return model.setBootstrap(False).setFeatureSubsetStrategy(str(spec.params.get("max_features") or "sqrt")).fit(drawn.drop("draws"))

    with ThreadPool(at_once) as pool:
        fitted = pool.map(inheritable_thread_target(rows.sparkSession)(one), range(trees))
    nodes = [node_table(tree, rows.sparkSession).withColumn("tree", F.lit(i)) for i, tree in enumerate(fitted)]
    return stored_forest(prepared, reduce(DataFrame.unionByName, nodes))


def grown(spec: Candidate) -> Candidate:
    """The candidate without its least number of rows for a split and, for a single tree, without its depth: what is fitted for it."""
    loose = ("min_samples_split", "max_depth") if spec.model == DT else ("min_samples_split",) if spec.model == RF else ()
    return replace(spec, candidate_id="", source="", params={k: v for k, v in spec.params.items() if k not in loose})


def cut_to(spec: Candidate, model: NodeForest) -> NodeForest:
    """A candidate's model from the one grown for it."""
    depth = spec.params.get("max_depth") if spec.model == DT else None
    return NodeForest(model.prepared, cut(model.nodes, int(spec.params.get("min_samples_split") or 2), None if depth is None else int(depth)))


@dataclass
class Prepared:
    """What a fit needs to know of its rows beforehand: the fitted preparation and the class sizes."""

    preparation: PipelineModel
    sizes: Mapping


def prepare_without(spec: Candidate, folds: DataFrame, columns: Columns, numbers: Sequence[int]) -> dict[int, Prepared]:
    """For every fold what a fit on the rows outside it needs, from a few passes for all folds together."""
    preparations = preprocess_for(spec, columns).fit_without(folds, "fold", numbers)
    sizes: dict[int, dict] = {f: {} for f in numbers}
    for r in class_sizes_without(folds, columns.label, "fold", numbers).collect():  # a row per fold and class
        sizes[r["fold"]][r[columns.label]] = r["n"]
    return {f: Prepared(preparations[f], sizes[f]) for f in numbers}


def fit(spec: Candidate, train: DataFrame, columns: Columns, partitions: int = FIT_PARTITIONS, known: Prepared | None = None):
    """Fit a candidate on training rows; statistics, weights and synthetic rows come from them only.

    A cluster with much data needs more ``partitions``; the same number gives the same model. A least number
    of rows for a split is applied to the grown trees' node table, by unweighted rows (draws, in a forest).
    """
    model = _fit_whole(spec, train, columns, partitions, known)
    least = int(spec.params.get("min_samples_split") or 2)
    if least == 2 or spec.model == LR:
        return model
    nodes = model if isinstance(model, NodeForest) else NodeForest(PipelineModel(model.stages[:-1]), cut_lineage(node_table(model.stages[-1], train.sparkSession)))
    return stored_forest(nodes.prepared, cut(nodes.nodes, least))


def _fit_whole(spec: Candidate, train: DataFrame, columns: Columns, partitions: int, known: Prepared | None):
    # A fit reads its rows several times: they are dealt and stored once, a fold table for all its fits.
    if DEAL not in train.columns or partitions != FIT_PARTITIONS:
        train = deal(train.select(columns.key, columns.label, *columns.features), [columns.key], partitions)
    prepared = known.preparation if known else preprocess_for(spec, columns).fit(train)
    rows = prepared.transform(in_parts(train, partitions).select(columns.key, columns.label, *columns.features))
    rows = rows.select(columns.key, columns.label, "features")
    weight = None
    if spec.strategy == SUBSAMPLE:
        if spec.model != RF:
            raise ValueError("Weights per bootstrap sample need a forest")
        return _fit_bagged(spec, prepared, rows, columns)
    if spec.strategy == BALANCED:
        weight = "__weight"
        rows = rows.withColumn(weight, weight_of_sizes(known.sizes, columns.label) if known else balanced_weight(rows, columns.label))
    elif spec.strategy == SMOTE:
        arrays = rows.withColumn("features", vector_to_array("features"))
        made = smote(arrays, columns.label, columns.key, "features")
        dealt = deal(made.select(columns.key, columns.label, "features"), [columns.key, "features"], partitions)
        rows = in_parts(dealt, partitions).select(columns.key, columns.label, array_to_vector("features").alias("features"))
    elif spec.strategy != ORIGINAL:
        raise ValueError(f"Unknown strategy: {spec.strategy}")
    exact = known and spec.strategy != SMOTE
    total = 0.0 if spec.model != LR else float(sum(known.sizes.values()) if exact else rows.count())
    model = classifier(spec, total, columns.label, weight).fit(rows)
    return PipelineModel([*prepared.stages, model])


def predict(model, df: DataFrame, name: str = "score") -> DataFrame:
    """Add the class-1 probability; helper columns of the pipeline are dropped."""
    out = model.transform(df)
    scored = out.withColumn(name, vector_to_array("probability")[1] if "probability" in out.columns else F.col("prediction"))
    return scored.select(*df.columns, name)


def fit_predict(spec: Candidate, train: DataFrame, other: DataFrame, columns: Columns) -> DataFrame:
    """Fit on one frame, return probability and 0/1 class (cut above 0.5) on the other."""
    return classify(predict(fit(spec, train, columns), other), 0.5, "gt")


def params_table(spark, specs: Sequence[Candidate]) -> DataFrame:
    """Effective estimator parameters of each candidate, one row per parameter."""
    rows = []
    for spec in specs:
        estimator = classifier(spec, 1.0, LABEL_COL, None)
        values = {p.name: v for p, v in estimator.extractParamMap().items()}
        if spec.model == LR:
            values["C"] = spec.params.get("C", 1.0)
            values.pop("regParam", None)
        else:
            values["minSamplesSplit"] = spec.params.get("min_samples_split") or 2
        rows += [(spec.candidate_id, name, str(value)) for name, value in sorted(values.items())]
    return spark.createDataFrame(rows, "candidate_id string, parameter string, value string")

