"""Feature preparation: exact scalers, pass-through, class weights.

A fitted preparation is a Spark ``PipelineModel`` of one SQL projection and one assembler,
so it saves, loads and runs like any other model and stays inside code generation.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.ml import PipelineModel
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.frames import cut_lineage, join_on
from ..functions.values import fold_nan
from .quantiles import quantile_columns, quantiles_without

AMOUNT_TRANSFORMS = ("original", "log1p")
#: Prefix of scaled columns inside a preparation.
SCALED = "scaled__"


def robust_stats(df: DataFrame, cols: Sequence[str], **options) -> DataFrame:
    """Per column: median and interquartile range; a zero range counts as 1."""
    q = quantile_columns(df, cols, {"q1": 0.25, "center": 0.5, "q3": 0.75}, **options)
    spread = F.col("q3") - F.col("q1")
    return q.select("feature", "center", F.when(spread == 0, 1.0).otherwise(spread).alias("scale"))


def standard_stats(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Per column: mean and population standard deviation; a zero deviation counts as 1."""
    parts = []
    for i, c in enumerate(cols):
        x = fold_nan(F.col(c).cast("double"))
        parts += [F.avg(x).alias(f"m{i}"), F.stddev_pop(x).alias(f"s{i}")]
    cells = F.array(*[
        F.struct(
            F.lit(c).alias("feature"), F.col(f"m{i}").alias("center"),
            F.when(F.col(f"s{i}") == 0, 1.0).otherwise(F.col(f"s{i}")).alias("scale"),
        )
        for i, c in enumerate(cols)
    ])
    return df.agg(*parts).select(F.explode(cells).alias("c")).select("c.*")


def robust_stats_without(df: DataFrame, cols: Sequence[str], fold: str, numbers: Sequence[int], **options) -> DataFrame:
    """fold, feature, center, scale: ``robust_stats`` of the rows outside each fold, in two passes for all folds."""
    long = quantiles_without(df, cols, [0.25, 0.5, 0.75], fold, numbers, **options)
    q = long.groupBy(fold, "feature").agg(*[F.max(F.when(F.col("prob") == p, F.col("value"))).alias(n) for n, p in (("q1", 0.25), ("center", 0.5), ("q3", 0.75))])
    spread = F.col("q3") - F.col("q1")
    return q.select(fold, "feature", "center", F.when(spread == 0, 1.0).otherwise(spread).alias("scale"))


def standard_stats_without(df: DataFrame, cols: Sequence[str], fold: str, numbers: Sequence[int]) -> DataFrame:
    """fold, feature, center, scale: ``standard_stats`` of the rows outside each fold, from one pass.

    Every fold's count, mean and sum of squared gaps are merged over the other folds; merging, unlike
    subtracting, loses no digits.
    """
    values = [fold_nan(F.col(c).cast("double")) for c in cols]
    parts = [F.struct(F.lit(c).alias("feature"), F.count(x).alias("n"), F.avg(x).alias("mean"), (F.var_pop(x) * F.count(x)).alias("gaps")) for c, x in zip(cols, values)]
    sums = df.groupBy(fold).agg(F.array(*parts).alias("parts")).select(F.col(fold).alias("own"), F.explode("parts").alias("p")).select("own", "p.*")
    others = F.filter(F.array(*map(F.lit, numbers)), lambda f: f != F.col("own"))
    sides = cut_lineage(sums).select("*", F.explode(others).alias(fold))  # folds x folds x features
    side = Window.partitionBy(fold, "feature")
    merged = sides.filter("n > 0").withColumn("center", F.sum(F.col("n") * F.col("mean")).over(side) / F.sum("n").over(side))
    gap = F.col("mean") - F.col("center")
    deviation = F.sqrt(F.sum(F.col("gaps") + F.col("n") * gap * gap) / F.sum("n"))
    return merged.groupBy(fold, "feature").agg(F.first("center").alias("center"), F.when(deviation == 0, 1.0).otherwise(deviation).alias("scale"))


def class_sizes_without(df: DataFrame, label: str, fold: str, numbers: Sequence[int]) -> DataFrame:
    """fold, label, n: rows per class outside each fold, the total less the fold's own."""
    own = cut_lineage(df.groupBy(fold, label).agg(F.count(F.lit(1)).alias("own")))
    every = own.groupBy(label).agg(F.sum("own").alias("total"))
    grid = every.select("*", F.explode(F.array(*map(F.lit, numbers))).alias(fold))
    left = join_on(grid, own, [fold, label], "left")
    return left.select(fold, label, (F.col("total") - F.coalesce("own", F.lit(0))).alias("n")).filter("n > 0")


def scale(df: DataFrame, stats: dict[str, tuple[float, float]]) -> DataFrame:
    """Replace columns by (x - center) / scale."""
    return df.withColumns({c: (F.col(c) - F.lit(m)) / F.lit(s) for c, (m, s) in stats.items()})


def _literal(x: float) -> str:
    return f"CAST('{float(x)!r}' AS DOUBLE)"


@dataclass
class Preprocess:
    """Per-column preparation; columns not listed are dropped from the vector.

    ``robust`` and ``log1p_robust`` use median and IQR, ``standard`` mean and deviation,
    ``passthrough`` leaves values alone. ``functions`` gives a column a SQL expression of its own that is
    applied first, for example ``{"amount": "sqrt(`amount`)"}``; it is saved with the fitted preparation. Vector order: robust columns as listed in
    ``order``, or the listing order of the four groups.
    """

    robust: Sequence[str] = ()
    log1p_robust: Sequence[str] = ()
    standard: Sequence[str] = ()
    passthrough: Sequence[str] = ()
    order: Sequence[str] = ()
    output: str = "features"
    functions: dict[str, str] = field(default_factory=dict)
    options: dict = field(default_factory=dict)

    def names(self) -> list[str]:
        listed = [*self.robust, *self.log1p_robust, *self.standard, *self.passthrough]
        return list(self.order) or listed

    def _ranked(self) -> list[str]:
        return [*self.robust, *self.log1p_robust]

    def _expression(self, c: str) -> str:
        return self.functions.get(c) or (f"log1p(`{c}`)" if c in self.log1p_robust else f"`{c}`")

    def _source(self, df: DataFrame, *more: str) -> DataFrame:
        """The columns that need statistics, transformed."""
        return df.select(*more, *[F.expr(self._expression(c)).alias(c) for c in [*self._ranked(), *self.standard]])

    def fit(self, df: DataFrame) -> PipelineModel:
        """Statistics come from the given rows only."""
        source, stats = self._source(df), {}
        if self._ranked():
            rows = robust_stats(source, self._ranked(), **self.options).collect()
            stats |= {r["feature"]: (r["center"], r["scale"]) for r in rows}
        if self.standard:
            stats |= {r["feature"]: (r["center"], r["scale"]) for r in standard_stats(source, self.standard).collect()}
        return self.model(stats)

    def fit_without(self, df: DataFrame, fold: str, numbers: Sequence[int]) -> dict[int, PipelineModel]:
        """A preparation per fold, fitted on the rows outside it; the rows are read three times for all folds together."""
        stats: dict[int, dict] = {f: {} for f in numbers}
        source = self._source(df, fold)
        tables = [robust_stats_without(source, self._ranked(), fold, numbers, **self.options)] if self._ranked() else []
        tables += [standard_stats_without(source, self.standard, fold, numbers)] if self.standard else []
        for table in tables:  # a row per fold and feature
            for r in table.collect():
                stats[r[fold]][r["feature"]] = (r["center"], r["scale"])
        return {f: self.model(s) for f, s in stats.items()}

    def model(self, stats: dict[str, tuple[float, float]]) -> PipelineModel:
        """The preparation with these centers and scales."""
        made = {c: f"(({self._expression(c)}) - {_literal(m)}) / {_literal(s)}" for c, (m, s) in stats.items()}
        made |= {c: self._expression(c) for c in self.names() if c not in stats and c in self.functions}
        scaled = [f"{made[c]} AS `{SCALED}{c}`" for c in self.names() if c in made]
        inputs = [f"{SCALED}{c}" if c in made else c for c in self.names()]
        stages = []
        if scaled:
            stages.append(SQLTransformer(statement=f"SELECT *, {', '.join(scaled)} FROM __THIS__"))
        stages.append(VectorAssembler(inputCols=inputs, outputCol=self.output))
        return PipelineModel(stages)


def lr_preprocess(
    feats: Sequence[str], amount: str = "Amount", time: str | None = "Time",
    amount_transform: str = "original", **options,
) -> Preprocess:
    """Robust time and amount, standardised rest; order time, amount, rest."""
    if amount_transform not in AMOUNT_TRANSFORMS:
        raise ValueError(f"amount_transform must be one of {AMOUNT_TRANSFORMS}")
    heads = [c for c in (time, amount) if c is not None and c in feats]
    rest = [c for c in feats if c not in heads]
    logged = [amount] if amount_transform == "log1p" and amount in feats else []
    return Preprocess(
        robust=[c for c in heads if c not in logged], log1p_robust=logged, standard=rest,
        order=[*heads, *rest], options=options,
    )


def tree_preprocess(feats: Sequence[str], amount: str = "Amount", time: str | None = "Time") -> Preprocess:
    """Values unchanged; order time, amount, rest."""
    heads = [c for c in (time, amount) if c is not None and c in feats]
    return Preprocess(passthrough=[*heads, *[c for c in feats if c not in heads]])


def feature_names(model: PipelineModel) -> list[str]:
    """Names in vector order, read from the assembler."""
    for stage in model.stages:
        if isinstance(stage, VectorAssembler):
            return [c.removeprefix(SCALED) for c in stage.getInputCols()]
        if isinstance(stage, PipelineModel):
            return feature_names(stage)
    raise ValueError("The model has no assembler")


def transform_only(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Every step but the classifier."""
    return PipelineModel(model.stages[:-1]).transform(df)


def class_weights(df: DataFrame, label: str, by: Sequence[str] = ()) -> DataFrame:
    """Balanced weights: rows / (classes * rows of the class)."""
    counts = df.groupBy(*by, label).agg(F.count(F.lit(1)).alias("n"))
    if by:
        totals = counts.groupBy(*by).agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("classes"))
        joined = join_on(counts, totals, by)
    else:
        joined = counts.withColumns({
            "total": counts.agg(F.sum("n")).scalar(), "classes": counts.agg(F.count(F.lit(1))).scalar()
        })
    weight = F.col("total").cast("double") / (F.col("classes") * F.col("n"))
    return joined.select(*by, label, "n", weight.alias("weight"))


def balanced_weight(df: DataFrame, label: str) -> Column:
    """Balanced class weight of each row, from these rows, as an expression over literals."""
    return weight_of_sizes({r[label]: r["n"] for r in class_weights(df, label).collect()}, label)


def weight_of_sizes(sizes: dict, label: str) -> Column:
    """Balanced class weight of each row for given class sizes."""
    total, value = sum(sizes.values()), F
    for c, n in sizes.items():
        value = value.when(F.col(label) == c, F.lit(total / (len(sizes) * n)))
    return value
