"""Shapley contributions for each model kind and the tables built from them.

Contributions are long (key, feature, value, contribution, base) or wide (key, arrays ``x`` and
``phi``, base). Tables about single rows start from the wide form and shuffle nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.ml.classification import LogisticRegressionModel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import DecisionTreeRegressionModel, RandomForestRegressionModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.frames import cut_lineage, explode_features, join_on
from ..functions.hashing import hash_token, hex_number, row_hash
from ..functions.values import direction
from ..schema import SEED
from .features import feature_names, transform_only
from .models import predict
from .node_trees import NodeForest
from .quantiles import exact_quantiles
from .ranking import numbered
from .sampling import sample_exact
from .selection import ranked
from .tree_shap import tree_shap

OUTCOMES = ["true_positive", "true_negative", "false_positive", "false_negative"]


def linear_contributions(
    df: DataFrame, coefficients: Mapping[str, float], intercept: float, key: Sequence[str],
    background: DataFrame | None = None, keep: Sequence[str] = (), wide: bool = False,
) -> DataFrame:
    """coefficient * (x - background mean) per feature, in log-odds."""
    names = list(coefficients)
    means = (background if background is not None else df).agg(*[F.avg(c).alias(c) for c in names]).first()
    carried = [*key, *keep]
    rows = df.select(
        *carried, F.array(*[F.col(c).cast("double") for c in names]).alias("x"),
        F.array(*[F.lit(float(coefficients[c])) * (F.col(c) - F.lit(means[c])) for c in names]).alias("phi"),
    )
    base = intercept + sum(coefficients[c] * means[c] for c in names)
    return _shaped(rows.withColumn("base", F.lit(float(base))), names, [*carried, "base"], wide)


def _shaped(rows: DataFrame, names: Sequence[str], carried: Sequence[str], wide: bool) -> DataFrame:
    return rows if wide else explode_features(rows, names, carried)


def linear_shap(
    model, df: DataFrame, key: Sequence[str], background: DataFrame | None = None, keep: Sequence[str] = (), wide: bool = False
) -> DataFrame:
    """Linear Shapley values of a fitted logistic regression on its prepared features."""
    fitted = model.stages[-1]
    names = feature_names(model)
    carried = [*key, *keep]

    def spread(frame: DataFrame, extra: Sequence[str]) -> DataFrame:
        x = vector_to_array("features")
        made = transform_only(model, frame).withColumn("__x", x)
        return made.select(*extra, *[F.col("__x")[i].alias(n) for i, n in enumerate(names)])

    data = spread(df.select(*[c for c in df.columns]), carried)
    behind = spread(background if background is not None else df, [])
    weights = dict(zip(names, (float(c) for c in fitted.coefficients), strict=True))
    return linear_contributions(data, weights, float(fitted.intercept), key, behind, keep, wide)


def sampled_shap(
    score: Callable[[DataFrame], DataFrame], df: DataFrame, features: Sequence[str], background: DataFrame,
    key: Sequence[str], permutations: int = 16, seed: int = SEED, background_rows: int | None = None,
) -> DataFrame:
    """Sampled Shapley values of any scorer (adds ``score``), all rows in one pass.

    Every row walks ``permutations`` seeded feature orders from a background row to itself;
    the steps are scored together. Walks start from any row of the background, or of a sample of
    ``background_rows``. Base is the mean score of the rows they start from, so base and
    contributions add up to the row's own score.
    """
    few = background if background_rows is None else sample_exact(background, background_rows, key, seed)
    pool = cut_lineage(numbered(few.select(*features), [F.col(f) for f in features], "__at")).select(
        (F.col("__at") - 1).alias("__at"), F.array(*[F.col(f).cast("double") for f in features]).alias("__from"))
    n = pool.count()
    rows = cut_lineage(df.select(*key, F.array(*[F.col(f).cast("double") for f in features]).alias("__x"), F.monotonically_increasing_id().alias("__row")))
    # Only numbers travel to the pool and back; a row's own cells wait for its walks, and all its steps are summed where they are made.
    token = hash_token([*key, "__walk"], seed)
    calls = rows.select(*key, "__row", F.explode(F.sequence(F.lit(0), F.lit(permutations - 1))).alias("__walk"))
    calls = calls.select((F.col("__row") * permutations + F.col("__walk")).alias("__call"), (hex_number(token, 1, 12) % n).alias("__at"))
    met = calls.join(pool, "__at").select(
        F.expr(f"__call div {permutations}").alias("__row"), F.expr(f"cast(__call % {permutations} AS int)").alias("__walk"), "__from")
    walks = rows.join(met, "__row")
    turns = F.array_sort(F.array(*[
        F.struct(hash_token([*key, "__walk"], f"{seed}/{f}").alias("t"), F.lit(i).alias("i")) for i, f in enumerate(features)
    ]))
    walks = walks.withColumn("__turns", F.transform(turns, lambda s: s["i"]))
    steps = walks.withColumn("__step", F.explode(F.sequence(F.lit(0), F.lit(len(features)))))
    mixed = steps.withColumns({
        f: F.when(F.array_position("__turns", F.lit(i)) <= F.col("__step"), F.col("__x")[i]).otherwise(F.col("__from")[i])
        for i, f in enumerate(features)
    })
    # A step's score counts for the feature that came last and against the one that comes next, so
    # plain sums per row give the gains.
    walked = mixed.select(
        *key, "__row", "__step", F.get("__turns", F.col("__step") - 1).alias("__last"), F.get("__turns", F.col("__step")).alias("__next"), "__x", *features)
    scored = score(walked)

    def gain(i: int) -> Column:
        sign = F.when(F.col("__last") == i, 1).otherwise(0) - F.when(F.col("__next") == i, 1).otherwise(0)
        return F.sum(sign * F.col("score")) / permutations

    # Rows of one key are summed together, which costs a shuffle only if keys repeat.
    alone = rows.groupBy(row_hash(key).alias("h")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty()
    cells = F.array(*[F.any_value(F.col("__x")[i]) for i in range(len(features))])  # numbers only, so that nothing is sorted to be summed
    mean = scored.groupBy(*["__row"] if alone else [], *key).agg(
        cells.alias("x"), F.array(*[gain(i) for i in range(len(features))]).alias("phi"),
        F.avg(F.when(F.col("__step") == 0, F.col("score"))).alias("base"),
    )
    return explode_features(mean, list(features), [*key, "base"])


def explain(
    model, df: DataFrame, key: Sequence[str], background: DataFrame | None = None, keep: Sequence[str] = (), wide: bool = False, **options
) -> DataFrame:
    """Contributions by the method that fits the model; ``feature_names`` gives the order of the wide form."""
    fitted = model.stages[-1]
    if isinstance(fitted, (DecisionTreeRegressionModel, RandomForestRegressionModel, NodeForest)):
        return tree_shap(model, df, key, keep, wide)
    if isinstance(fitted, LogisticRegressionModel):
        return linear_shap(model, df, key, background, keep, wide)
    features = feature_names(model)
    return sampled_shap(
        lambda rows: predict(model, rows), df, features, background if background is not None else df, key, **options
    )


def explain_sample(model, df: DataFrame, key: Sequence[str], n: int = 500, seed: int = SEED, **options) -> DataFrame:
    """Contributions on at most n sampled rows."""
    return explain(model, sample_exact(df, n, key, seed), key, **options)


def additivity(contributions: DataFrame, scores: DataFrame, key: Sequence[str], score: str = "score") -> DataFrame:
    """Largest gap between base plus contributions and the model's score, over all rows."""
    sums = contributions.groupBy(*key).agg((F.first("base") + F.sum("contribution")).alias("__sum"))
    both = join_on(sums, scores.select(*key, score), key)
    return both.agg(F.count(F.lit(1)).alias("n_rows"), F.max(F.abs(F.col("__sum") - F.col(score))).alias("max_error"))


def require_additivity(contributions: DataFrame, scores: DataFrame, key: Sequence[str], score: str = "score", tolerance: float = 1e-6) -> float:
    error = additivity(contributions, scores, key, score).first()["max_error"]
    if error is None or error > tolerance:
        raise ValueError(f"Contributions do not add up to the score: {error}")
    return error


def importance(contributions: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return contributions.groupBy(*by, "feature").agg(
        F.avg(F.abs("contribution")).alias("mean_absolute"), F.avg("contribution").alias("mean_signed")
    )


def global_importance(contributions: DataFrame) -> DataFrame:
    """Importance with rank 1..n; one row per feature."""
    return ranked(importance(contributions), "mean_absolute")


def cohort_importance(contributions: DataFrame, label: str, names: tuple[str, str] = ("fraud", "legitimate")) -> DataFrame:
    """Importance of positives and negatives side by side."""
    both = importance(contributions, [label])
    return both.groupBy("feature").agg(*[
        F.max(F.when(F.col(label) == code, F.col(c))).alias(f"{name}_{c}")
        for code, name in zip((1, 0), names, strict=True) for c in ("mean_absolute", "mean_signed")
    ])


def _by_size(names: Sequence[str]) -> Column:
    """A wide row's cells, the largest contribution first, ties by feature."""
    return F.array_sort(F.array(*[
        F.struct((-F.abs(F.col("phi")[i])).alias("size"), F.lit(n).alias("feature"), F.col("x")[i].alias("value"), F.col("phi")[i].alias("contribution"))
        for i, n in enumerate(names)
    ]))


def wide_of(contributions: DataFrame, key: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """A stored long table as wide rows, at the price of one shuffle; every row must have the same features."""
    names = sorted(r["feature"] for r in contributions.select("feature").distinct().toLocalIterator())
    cells = F.map_from_entries(F.collect_list(F.struct("feature", F.struct("value", "contribution"))))
    rows = contributions.groupBy(*key).agg(cells.alias("m"), F.first("base").alias("base"))
    arrays = {out: F.array(*[F.col("m")[n][c] for n in names]) for out, c in (("x", "value"), ("phi", "contribution"))}
    return rows.withColumns(arrays).drop("m"), names


def top_contributions(wide: DataFrame, names: Sequence[str], n: int, key: Sequence[str]) -> DataFrame:
    """The n largest contributions of each wide row with rank and direction."""
    cells = F.posexplode(F.slice(_by_size(names), 1, n)).alias("at", "c")
    rows = wide.select(*key, "base", cells)
    return rows.select(
        *key, (F.col("at") + 1).alias("rank"), "c.feature", "c.value", "c.contribution", "base", direction(F.col("c.contribution")).alias("direction"))


def representative_rows(
    predictions: DataFrame, key: Sequence[str], score: str = "score", category: str = "outcome", **options
) -> DataFrame:
    """Per outcome the row whose score is nearest the outcome's median; ties to the lowest key."""
    medians = exact_quantiles(predictions, [score], [0.5], [category], **options).select(
        category, F.col("value").alias("median")
    )
    rows = join_on(predictions, cut_lineage(medians), [category])
    gap = F.abs(F.col(score) - F.col("median"))
    whole = F.struct(*[F.col(c) for c in predictions.columns if c != category])
    best = rows.groupBy(category).agg(
        F.min_by(whole, F.struct(gap.alias("gap"), *key)).alias("row"), F.count(F.lit(1)).alias("category_size")
    )
    position = F.array_position(F.array(*[F.lit(o) for o in OUTCOMES]), F.col(category))
    return best.select(
        position.alias("position"), category, "row.*", "category_size",
        F.lit("probability nearest category median").alias("selection_rule"),
    )


def representative_cases(
    model, predictions: DataFrame, key: Sequence[str], score: str = "score", n: int = 10, tolerance: float = 1e-6
) -> tuple[DataFrame, DataFrame]:
    """One case per outcome with its rebuilt score, and its top contributions.

    ``predictions`` hold the model's features next to key, score and outcome.
    """
    cases = cut_lineage(representative_rows(predictions, key, score))
    wide = cut_lineage(explain(model, cases, key, keep=["outcome"], wide=True))
    names = feature_names(model)
    contributions = explode_features(wide, names, [*key, "outcome", "base"])
    require_additivity(contributions, cases, key, score, tolerance)
    rebuilt = contributions.groupBy(*key).agg(
        F.first("base").alias("base_value"), (F.first("base") + F.sum("contribution")).alias("reconstructed_probability")
    )
    return join_on(cases, rebuilt, key), top_contributions(wide, names, n, [*key, "outcome"])


def explain_rows(
    wide: DataFrame, names: Sequence[str], key: Sequence[str], threshold: float, n: int = 5, score: str = "score"
) -> DataFrame:
    """Per wide row, which carries its score: class name, probability, threshold, top features toward fraud and legitimate."""
    cells = F.array_sort(F.array(*[F.struct(F.col("phi")[i].alias("contribution"), F.lit(f).alias("feature")) for i, f in enumerate(names)]))
    named = "x -> struct(x.feature as feature, x.contribution as contribution)"
    return wide.withColumn("__cells", cells).select(
        *key, F.when(F.col(score) >= threshold, "Fraudulent").otherwise("Legitimate").alias("predicted_class"),
        F.bround(score, 4).alias("fraud_probability"), F.lit(threshold).alias("threshold_used"),
        F.expr(f"transform(slice(reverse(__cells), 1, {n}), {named})").alias("top_toward_fraud"),
        F.expr(f"transform(slice(__cells, 1, {n}), {named})").alias("top_toward_legitimate"),
    )


def beeswarm_data(contributions: DataFrame, key: Sequence[str], n: int = 20) -> DataFrame:
    """Points of the n most important features: key, feature, rank, value, contribution."""
    stored = cut_lineage(contributions)
    order = global_importance(stored).filter(F.col("rank") <= n).select("feature", "rank")
    return stored.join(order, "feature").select(*key, "feature", "rank", "value", "contribution")


def importance_bars(contributions: DataFrame, n: int = 20) -> DataFrame:
    return global_importance(contributions).filter(F.col("rank") <= n).select("rank", "feature", "mean_absolute")


def waterfall_data(wide: DataFrame, names: Sequence[str], key: Sequence[str], shown: int = 12) -> DataFrame:
    """Bars per wide row in order of size with running start and end; the rest forms one bar."""
    cell = "struct<feature:string,value:double,contribution:double,end:double>"
    bars = f"""concat(transform(slice(cells, 1, {shown}), c -> struct(c.feature AS feature, c.value AS value, c.contribution AS contribution)),
        coalesce(CASE WHEN size(cells) > {shown} THEN array(struct('other features' AS feature, CAST(NULL AS double) AS value,
            aggregate(slice(cells, {shown + 1}, size(cells)), 0D, (a, c) -> a + c.contribution) AS contribution)) END, array()))"""
    # Each array is bound once, as the only element of an array that is transformed; ends are summed in one walk.
    walk = f"""aggregate(bars, CAST(array() AS array<{cell}>), (done, b) -> concat(done, array(struct(b.feature AS feature, b.value AS value,
        b.contribution AS contribution, coalesce(try_element_at(done, -1).end, base) + b.contribution AS end))))"""
    whole = F.expr(f"transform(transform(array(__cells), cells -> {bars}), bars -> {walk})[0]")
    rows = wide.select(*key, "base", _by_size(names).alias("__cells")).select(*key, "base", F.posexplode(whole).alias("at", "c"))
    return rows.select(
        *key, (F.col("at") + 1).alias("position"), "c.feature", "c.value", "c.contribution", "base",
        (F.col("c.end") - F.col("c.contribution")).alias("start"), F.col("c.end").alias("end"))
