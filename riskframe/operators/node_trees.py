"""Trees and forests as node tables: read, cut, scored.

A table has a row per node: tree, id (0 is the root), left, right (-1 for a leaf), feature, threshold,
stats (weight per class) and n_rows (rows that reached it, unweighted). A tree grown greedily does not
depend on where its growth stops: a node of too few rows, or too deep, that is not split is the full
tree with that node cut. So one grown tree answers every depth and every least number of rows for a split.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.frames import cut_lineage, shared_folder

#: Nodes held by a task at once.
NODES_AT_ONCE = 200_000


def node_table(classifier, spark) -> DataFrame:
    """Nodes of a fitted tree or forest."""
    if isinstance(classifier, NodeForest):
        return classifier.nodes
    path = f"{shared_folder(spark)}/model-{uuid.uuid4().hex}"
    classifier.write().save(path)
    stored = spark.read.parquet(f"{path}/data")
    node = F.col("nodeData") if "nodeData" in stored.columns else F.struct(*stored.columns)
    tree = F.col("treeID") if "treeID" in stored.columns else F.lit(0)
    return stored.select(tree.alias("tree"), node.alias("n")).select(
        "tree", F.col("n.id").alias("id"), F.col("n.leftChild").alias("left"), F.col("n.rightChild").alias("right"),
        F.col("n.split.featureIndex").alias("feature"),
        F.get("n.split.leftCategoriesOrThreshold", F.lit(0)).alias("threshold"),
        F.array(F.col("n.impurityStats")[0] - F.col("n.impurityStats")[1], F.col("n.impurityStats")[1]).alias("stats"),
        F.col("n.rawCount").alias("n_rows"),
    )


def with_depth(nodes: DataFrame) -> DataFrame:
    """Add ``depth``; a task holds one tree, as its fit did."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in nodes.schema.fields)

    def walk(tree: pd.DataFrame) -> pd.DataFrame:
        tree = tree.sort_values("id", ignore_index=True)
        ids, left, right = (tree[c].to_numpy() for c in ("id", "left", "right"))
        depth, level, at = np.zeros(len(tree), np.int32), 0, np.flatnonzero(ids == 0)
        while at.size:
            depth[at], level = level, level + 1
            inner = at[left[at] >= 0]
            at = np.searchsorted(ids, np.concatenate((left[inner], right[inner])))
        return tree.assign(depth=depth)

    return nodes.groupBy("tree").applyInPandas(walk, f"{schema}, depth int")


def cut(nodes: DataFrame, min_samples_split: int = 2, max_depth: int | None = None) -> DataFrame:
    """The table of the trees whose nodes of fewer rows, or at that depth (``depth`` is then needed), are not split.

    Rows and depth change one way down a path, so a node stays if its parent is still split.
    """
    ends = F.col("n_rows") < min_samples_split
    if max_depth is not None:
        ends = ends | (F.col("depth") >= max_depth)
    inner = (F.col("left") >= 0) & ~ends
    kept = nodes.filter(inner).select("tree", F.explode(F.array("left", "right")).alias("id"))
    rows = nodes.filter("id = 0").unionByName(nodes.filter("id <> 0").join(kept, ["tree", "id"], "left_semi"))
    closed = {c: F.when(inner, F.col(c)).otherwise(F.lit(-1)) for c in ("left", "right")}
    opened = {c: F.when(inner, F.col(c)) for c in ("feature", "threshold")}
    return rows.withColumns({**closed, **opened}).select(nodes.columns)


def tree_groups(nodes: DataFrame, at_once: int = NODES_AT_ONCE) -> list[list[int]]:
    """Trees in groups of at most ``at_once`` nodes (or one tree)."""
    out: list[list[int]] = [[]]
    held = 0
    for tree, n in sorted(tuple(r) for r in nodes.groupBy("tree").count().collect()):
        if out[-1] and held + n > at_once:
            out.append([])
            held = 0
        out[-1].append(tree)
        held += n
    return out


def _arrays(nodes: pd.DataFrame) -> dict[str, np.ndarray]:
    """A few trees as arrays; children are places in them, and a leaf is its own child."""
    nodes = nodes.sort_values(["tree", "id"], ignore_index=True)
    spot = nodes["tree"].to_numpy(np.int64) << 32 | nodes["id"].to_numpy(np.int64)
    inner = nodes["left"].to_numpy() >= 0
    out = {"roots": np.flatnonzero(nodes["id"].to_numpy() == 0)}
    for side in ("left", "right"):
        child = np.searchsorted(spot, nodes["tree"].to_numpy(np.int64) << 32 | nodes[side].clip(lower=0).to_numpy(np.int64))
        out[side] = np.where(inner, child, np.arange(len(nodes)))
    stats = np.stack(nodes["stats"]).astype(float)
    return out | {"feature": nodes["feature"].fillna(0).to_numpy(np.int64), "threshold": nodes["threshold"].fillna(0.0).to_numpy(float),
                  "inner": inner, "share": stats[:, 1] / stats.sum(axis=1)}


def _descend(trees: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
    """Sum over the trees of the class-1 share of each row's leaf."""
    total, rows = np.zeros(len(x)), np.arange(len(x))
    for root in trees["roots"]:
        at = np.full(len(x), root)
        while trees["inner"][at].any():
            low = x[rows, trees["feature"][at]] <= trees["threshold"][at]
            at = np.where(low, trees["left"][at], trees["right"][at])
        total += trees["share"][at]
    return total


def _leaf_shares(shared):
    @F.pandas_udf("double")
    def descend(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for x in batches:
            yield pd.Series(_descend(shared.value, np.stack(x).astype(float)) if len(x) else [], dtype="float64")

    return descend


class NodeForest:
    """A fitted preparation and a stored node table; the prediction is the mean class-1 share over the trees."""

    def __init__(self, prepared: PipelineModel, nodes: DataFrame):
        self.prepared = prepared
        self.nodes = nodes
        self.stages = [*prepared.stages, self]
        self._shared: list | None = None
        self._trees = 0

    def _groups(self) -> list:
        """Groups of trees, sent to the executors once."""
        if self._shared is None:
            groups = tree_groups(self.nodes)
            send = self.nodes.sparkSession.sparkContext.broadcast
            self._trees = sum(map(len, groups))
            self._shared = [send(_arrays(self.nodes.filter(F.col("tree").isin(g)).toPandas())) for g in groups]
        return self._shared

    def score(self, features):
        """Column: mean over the trees for an array of features."""
        parts = [_leaf_shares(shared)(features) for shared in self._groups()]
        return sum(parts[1:], parts[0]) / F.lit(float(self._trees))

    def transform(self, df: DataFrame) -> DataFrame:
        out = self.prepared.transform(df)
        return out.withColumn("prediction", self.score(vector_to_array("features")))


def stored_forest(prepared: PipelineModel, nodes: DataFrame) -> NodeForest:
    return NodeForest(prepared, cut_lineage(nodes))
