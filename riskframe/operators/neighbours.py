"""Exact k nearest neighbours within one set of points, through a metric tree.

The tree is built level by level: every node with more than ``leaf_rows`` points is split among pivots
drawn from its own points, each point going to its nearest one. A table keeps the nodes (node, parent,
level, centre, radius, rows), another the points with their leaf; neither ever is on the driver.

A point first meets its own leaf. The distance to its k-th neighbour there is its limit: a node
farther away than its radius and that limit holds nothing closer (triangle inequality). The tree is
then descended for blocks of near leaves at once, with the largest reach of any of their points. The points of the
leaves left open come by a block once, the nearest leaves first; the task holds the block's points with
the k best each has met, whose limits tighten on the way and close most of the leaves.

So no row is written for a pair of points or of a point and a leaf: a block of up to ``BLOCK_ROWS`` points reads each
open leaf once. The number of leaves a point meets does not depend on
the number of points in few dimensions; in many dimensions limits rule out little, distances are counted for nearly all
pairs, and the points are read once for each block.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.frames import cut_lineage, join_on
from .quality import attach_group_facts

LEAF_ROWS = 4096
FANOUT = 32
#: Askers that a task holds at once, and pairs whose distances are held at once.
BLOCK_ROWS, PAIRS_AT_ONCE = 1 << 16, 1 << 20
#: Rounding of distances, relative to them.
SLACK = 1e-9


def _apart(a: str | Column, b: str | Column) -> Column:
    gaps = F.zip_with(a, b, lambda p, q: (p - q) * (p - q))
    return F.sqrt(F.aggregate(gaps, F.lit(0.0), lambda s, g: s + g))


def metric_tree(points: DataFrame, leaf_rows: int = LEAF_ROWS, fanout: int = FANOUT, seed: object = 0) -> tuple[DataFrame, DataFrame]:
    """Points (id, x and others) with their leaf and reach, and the nodes: node, parent, level, centre, radius, rows.

    ``reach`` is the distance to the leaf's centre. Points of one place stay together, so a leaf
    holds at most ``leaf_rows`` points unless one place has more. The root has no centre.
    """
    spark, names, total = points.sparkSession, points.columns, points.count()
    kept = [points.select(*names, F.lit(0).cast("bigint").alias("leaf"), F.lit(0.0).alias("reach"))]
    nodes = [spark.range(1).select(
        F.col("id").alias("node"), F.lit(None).cast("bigint").alias("parent"), F.lit(0).alias("level"),
        F.lit(None).cast("array<double>").alias("centre"), F.lit(float("inf")).alias("radius"), F.lit(total).cast("bigint").alias("rows"))]
    wide, level = total > leaf_rows, 0
    while wide:
        level += 1
        sizes = nodes[-1].filter(F.col("rows") > leaf_rows).select("node", "rows")
        sizes = sizes.withColumn("wanted", F.least(F.lit(fanout), F.ceil(2 * F.col("rows") / leaf_rows).cast("int")))
        open_points = kept.pop().withColumnRenamed("leaf", "node")
        inside = attach_group_facts(open_points, sizes, ["node"])
        kept.append(inside.filter("wanted IS NULL").select(*names, F.col("node").alias("leaf"), "reach"))
        inside = inside.filter("wanted IS NOT NULL")
        # About eight candidates for each pivot, by the hash of their place; of these the lowest, one per place.
        token = F.pmod(F.xxhash64(F.lit(f"{seed}/{level}"), "x"), F.lit(1 << 40))
        drawn = inside.withColumn("token", token).filter(F.col("token") * F.col("rows") < F.lit(8.0 * (1 << 40)) * F.col("wanted"))
        drawn = drawn.groupBy("node", "wanted", "token").agg(F.min("x").alias("centre"))
        place = F.row_number().over(Window.partitionBy("node").orderBy("token"))
        chosen = drawn.withColumn("j", place).filter(F.col("j") <= F.col("wanted"))
        pivots = chosen.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("j", "centre"))).alias("pivots"))
        dealt = attach_group_facts(inside.select(*names, "node", "reach"), pivots, ["node"])
        near = F.array_min(F.transform("pivots", lambda p: F.struct(_apart(p["centre"], F.col("x")).alias("reach"), p["j"].alias("j"))))
        dealt = dealt.withColumn("near", near)
        child = F.col("node") * (fanout + 1) + F.coalesce("near.j", F.lit(0))  # a node without candidates stays whole for a level
        centre = F.get(F.col("pivots"), F.col("near.j") - 1)["centre"]
        moved = cut_lineage(dealt.select(*names, child.alias("leaf"), F.coalesce("near.reach", "reach").alias("reach"), "node", centre.alias("centre")))
        made = moved.groupBy(F.col("leaf").alias("node")).agg(
            F.first("node").alias("parent"), F.lit(level).alias("level"), F.first("centre").alias("centre"),
            F.max("reach").alias("radius"), F.count(F.lit(1)).alias("rows"))
        # Without a centre nothing is known of a node's place.
        nodes.append(cut_lineage(made.withColumn("radius", F.when(F.col("centre").isNull(), float("inf")).otherwise(F.col("radius")))))
        kept.append(moved.select(*names, "leaf", "reach"))
        wide = not nodes[-1].filter(F.col("rows") > leaf_rows).isEmpty()
    return reduce(DataFrame.unionByName, kept), reduce(DataFrame.unionByName, nodes)


def _open_nodes(groups: DataFrame, nodes: DataFrame) -> DataFrame:
    """group, parent, node, ahead: the leaves that may hold something within ``span`` of a group's centre.

    ``groups``: group, own (centre), span. Only numbers are stored on the way down, no centres.
    """
    margin = 1.0 + SLACK
    parents = nodes.select(F.col("parent").alias("node")).distinct()
    tree = cut_lineage(join_on(nodes.filter("parent IS NOT NULL").select(F.col("node").alias("child"), F.col("parent").alias("node"), "centre", "radius"),
                               parents.withColumn("inner", F.lit(True)).withColumnRenamed("node", "child"), ["child"], "left"))
    frontier = groups.select("group", F.lit(0).cast("bigint").alias("node"))
    found = []
    while not frontier.isEmpty():
        met = join_on(join_on(frontier, groups, ["group"]), tree, ["node"]).withColumnRenamed("node", "parent")
        apart = _apart("own", "centre")
        sibling = F.min(apart).over(Window.partitionBy("group", "parent"))
        met = met.withColumns({"apart": apart, "sibling": sibling})
        ball = F.col("apart") * (1 - SLACK) - F.col("radius") * margin
        ahead = F.greatest(ball, (F.col("apart") * (1 - SLACK) - F.col("sibling") * margin) / 2)
        close = F.col("apart").isNull() | F.isnan(ahead) | (ahead <= F.col("span"))
        met = cut_lineage(met.filter(close).select("group", "parent", F.col("child").alias("node"), "inner", ahead.alias("ahead")))
        found.append(met.filter("inner IS NULL").drop("inner"))
        frontier = met.filter("inner").select("group", "node")
    return reduce(DataFrame.unionByName, found)


def open_leaves(asking: DataFrame, nodes: DataFrame) -> DataFrame:
    """id, leaf, ahead: the other leaves that may hold something closer than a point's limit.

    ``asking``: id, x, leaf, reach, limit. ``ahead`` is the least distance anything in the leaf can have.
    """
    margin = 1.0 + SLACK
    whole = asking.groupBy("leaf").agg(F.max(F.col("limit") + F.col("reach")).alias("span"))
    own = nodes.select(F.col("node").alias("leaf"), F.col("centre").alias("own"), F.col("parent").alias("home"))
    groups = cut_lineage(join_on(whole, own, ["leaf"]).withColumnRenamed("leaf", "group"))
    pairs = _open_nodes(groups, nodes).filter("node <> group").drop("ahead")
    pairs = join_on(join_on(pairs, groups.select("group", "home"), ["group"]), nodes.select("node", "centre", "radius"), ["node"])
    apart = F.when(F.col("centre").isNull(), F.lit(0.0)).otherwise(_apart("x", "centre"))
    reached = join_on(asking, pairs.withColumnsRenamed({"group": "leaf", "node": "other"}), ["leaf"]).withColumn("apart", apart)
    reached = reached.withColumn("ahead", F.greatest(F.lit(0.0), F.col("apart") * (1 - SLACK) - F.col("radius") * margin)).filter(F.col("ahead") <= F.col("limit"))
    # All points of a leaf are nearer to its centre than to those of its siblings, so half the difference of distances is ahead as well.
    nearest = F.least(F.min("apart").over(Window.partitionBy("id", "parent")), F.when(F.col("parent") == F.col("home"), F.col("reach")))
    reached = reached.withColumn("ahead", F.greatest("ahead", (F.col("apart") * (1 - SLACK) - nearest * margin) / 2))
    return reached.filter(F.col("ahead") <= F.col("limit")).select("id", "x", "limit", F.col("other").alias("leaf"), "ahead")


def _blocks(nodes: DataFrame, most: int) -> DataFrame:
    """leaf, block: leaves near each other in the tree as numbered blocks of about ``most`` points.

    The largest subtrees of at most ``most`` points are taken whole, and children of one node share a block while they fit.
    """
    above = nodes.select(F.col("node").alias("parent"), F.col("rows").alias("around"))
    inner = cut_lineage(nodes.filter("parent IS NOT NULL").select(F.col("parent").alias("node")).distinct().withColumn("inner", F.lit(True)))
    placed = join_on(join_on(nodes.select("node", "parent", "rows"), above, ["parent"], "left"), inner, ["node"], "left")
    tops = placed.filter((F.col("around").isNull() | (F.col("around") > most)) & ((F.col("rows") <= most) | F.col("inner").isNull()))
    before = F.sum("rows").over(Window.partitionBy("parent").orderBy("node")) - F.col("rows")
    tops = cut_lineage(tops.withColumn("part", F.floor(before / most)).select("node", "parent", "part", "inner"))
    # A few rows per block.
    number = F.dense_rank().over(Window.orderBy("parent", "part")) - 1
    step = cut_lineage(tops.select("node", number.cast("int").alias("block"), "inner"))
    below = placed.select("node", "parent", "inner")
    found = []
    while not step.isEmpty():
        found.append(step.filter("inner IS NULL").select(F.col("node").alias("leaf"), "block"))
        step = cut_lineage(join_on(below, step.filter("inner").select(F.col("node").alias("parent"), "block"), ["parent"]).select("node", "block", "inner"))
    return reduce(DataFrame.unionByName, found)


def nearest_neighbours(
    df: DataFrame, key: str, vector: str, k: int, seed: object = 0, leaf_rows: int = LEAF_ROWS, fanout: int = FANOUT,
) -> DataFrame:
    """Rows ``key, rank, neighbour, distance``; ties in distance go to the lower key.

    ``vector`` is an array of doubles of one length and ``key`` unique.
    """
    kind = df.schema[key].dataType.simpleString()
    points = cut_lineage(df.select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("x")))
    # Copies of a point share their answer, and no answer needs more than k + 1 of them.
    copy = F.row_number().over(Window.partitionBy("x").orderBy("id"))
    copies = cut_lineage(points.withColumn("copy", copy).filter(F.col("copy") <= k + 1))
    placed, nodes = metric_tree(copies, max(leaf_rows, k + 2), fanout, seed)
    firsts = placed.filter("copy = 1").select("id", "x", "leaf", "reach")
    answers = _through_tree(firsts, placed, nodes, k + 1, kind, leaf_rows)
    near = answers.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("distance", "neighbour"))).alias("near"))
    known = join_on(copies.filter("copy = 1").select("id", "x"), near, ["id"]).select("x", "near")
    rows = attach_group_facts(points, known, ["x"], "inner")
    others = F.slice(F.filter("near", lambda s: s["neighbour"] != F.col("id")), 1, k)
    listed = rows.withColumn("others", others).select("id", F.posexplode("others").alias("at", "hit"))
    return listed.select(F.col("id").alias(key), (F.col("at") + 1).alias("rank"), "hit.neighbour", "hit.distance")


def _through_tree(asking: DataFrame, placed: DataFrame, nodes: DataFrame, k: int, kind: str, leaf_rows: int) -> DataFrame:
    """The k nearest of every asking point (id, x, leaf, reach): id, neighbour, distance."""
    own = asking.select("id", "x", "leaf", F.lit(float("inf")).alias("limit"))
    found = cut_lineage(_meet(own, placed, k, kind, leaf_rows))
    if nodes.count() == 1:
        return found
    limited = cut_lineage(join_on(asking, _limits(found, k), ["id"], "left").withColumn("limit", F.coalesce("limit", F.lit(float("inf")))))
    spark = asking.sparkSession
    total = nodes.filter("node = 0").first()["rows"]
    blocks = cut_lineage(_blocks(nodes, max(leaf_rows, min(BLOCK_ROWS, -(-total // spark.sparkContext.defaultParallelism)))))
    # A block's centre is the mean of its leaves' centres; its span takes in the limits of all its points.
    spans = limited.groupBy("leaf").agg(F.max(F.col("limit") + F.col("reach")).alias("span"))
    leaves = join_on(join_on(blocks, spans, ["leaf"]), nodes.select(F.col("node").alias("leaf"), "centre"), ["leaf"])
    leaves = cut_lineage(leaves.withColumnRenamed("block", "group"))
    means = leaves.select("group", F.posexplode("centre").alias("d", "v")).groupBy("group", "d").agg(F.avg("v").alias("v"))
    means = means.groupBy("group").agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "v"))), lambda c: c["v"]).alias("own"))
    span = F.coalesce(_apart("own", "centre") * (1 + SLACK) + F.col("span"), F.lit(float("inf")))
    groups = join_on(leaves, cut_lineage(means), ["group"], "left").groupBy("group").agg(F.first("own").alias("own"), F.max(span).alias("span"))
    pairs = cut_lineage(_open_nodes(cut_lineage(groups), nodes))
    pairs = pairs.select(F.col("group").alias("block"), F.col("node").alias("leaf"), F.greatest(F.lit(0.0), F.coalesce("ahead", F.lit(0.0))).alias("ahead"))
    askers = join_on(limited, blocks, ["leaf"]).select("block", F.lit(-1.0).alias("ahead"), "leaf", "id", "x", "limit")
    stored = join_on(placed.select("leaf", "id", "x"), pairs, ["leaf"]).select("block", "ahead", "leaf", "id", "x", F.lit(None).cast("double").alias("limit"))
    number = blocks.agg(F.max("block")).first()[0] + 1
    dealt = askers.unionByName(stored).repartitionById(number, F.col("block")).sortWithinPartitions("block", "ahead", "leaf")

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, block, waiting = None, None, []
        for key, ids, x, limits in _runs(batches):
            if key[0] != at:
                if block is not None:
                    yield from block.result()
                at, block, waiting = key[0], None, []
            if key[1]:
                waiting.append((ids, x, limits))
            else:
                block = block or Asking(waiting, k)
                block.meet(ids, x)
        if block is not None:
            yield from block.result()

    # A point may stand in several rows if keys repeat.
    return _nearest(dealt.mapInArrow(visit, f"id {kind}, neighbour {kind}, distance double"), k)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(block, asking), ids, points, limits of each run of rows with one block and leaf; batches are sorted."""
    held, now = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        block, ahead, leaf = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        asks = ahead < 0
        turns = np.flatnonzero((np.diff(block) != 0) | (np.diff(leaf) != 0) | (np.diff(asks.astype(np.int8)) != 0)) + 1
        lists = batch.column(4)
        x = lists.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
        ids, limits = batch.column(3), batch.column(5).to_numpy(zero_copy_only=False)
        for a, b in zip([0, *turns], [*turns, batch.num_rows]):
            key = (block[a], bool(asks[a]), leaf[a])
            if now is not None and key != now:
                yield now, pa.concat_arrays([h[0] for h in held]), np.concatenate([h[1] for h in held]), np.concatenate([h[2] for h in held])
                held = []
            now = key
            held.append((ids.slice(a, b - a), x[a:b], limits[a:b]))
    if held:
        yield now, pa.concat_arrays([h[0] for h in held]), np.concatenate([h[1] for h in held]), np.concatenate([h[2] for h in held])


class Asking:
    """The askers of a block with the k best each has met; leaves come by one at a time."""

    def __init__(self, leaves: list[tuple], k: int):
        self.ids = pa.concat_arrays([ids for ids, _, _ in leaves])
        self.x = np.concatenate([x for _, x, _ in leaves])
        self.limit = np.concatenate([limits for _, _, limits in leaves])
        sizes = np.array([len(ids) for ids, _, _ in leaves])
        self.leaf = np.repeat(np.arange(len(sizes)), sizes)
        self.first = np.cumsum(sizes) - sizes
        self.centre = np.stack([x.mean(axis=0) for _, x, _ in leaves])
        self.reach = _gaps(self.x, self.centre[self.leaf])
        self.square = np.einsum("ij,ij->i", self.x, self.x)
        self.near = np.full((len(self.x), k), np.inf)
        self.who = np.empty((len(self.x), k), object)
        self.k = k

    def meet(self, ids: pa.Array, points: np.ndarray) -> None:
        """Let all askers whose limit reaches a leaf meet its points."""
        with np.errstate(all="ignore"):
            centre = points.mean(axis=0)
            radius = _gaps(points, centre).max() * (1 + SLACK)
            span = np.maximum.reduceat(self.limit + self.reach * (1 + SLACK), self.first)
            leaves = ~(_gaps(self.centre, centre) * (1 - SLACK) - radius > span)
            if not leaves.any():
                return
            rows = np.flatnonzero(leaves[self.leaf])
            rows = rows[~(_gaps(self.x[rows], centre) * (1 - SLACK) - radius > self.limit[rows])]
            names = ids.to_numpy(zero_copy_only=False)
            square = np.einsum("ij,ij->i", points, points)
            step = max(1, PAIRS_AT_ONCE // len(points))
            for i in range(0, len(rows), step):
                part = rows[i : i + step]
                # What the product of matrices rules out beyond its rounding; all others are measured.
                about = self.square[part, None] + square - 2 * (self.x[part] @ points.T)
                most = np.square(self.limit[part, None]) * (1 + SLACK) + 1e-12 * (self.square[part, None] + square)
                who, there = np.nonzero(~(about > most))
                away = _gaps(self.x[part[who]], points[there])
                keep = np.isfinite(away) & (away <= self.limit[part[who]])
                if keep.any():
                    self._take(part[who[keep]], away[keep], names[there[keep]])

    def _take(self, rows: np.ndarray, away: np.ndarray, names: np.ndarray) -> None:
        """The k best of what the askers ``rows`` had and have met now; ties go to the lower name."""
        own = np.unique(rows)
        old_rows, at = np.nonzero(np.isfinite(self.near[own]))
        old_rows = own[old_rows]
        held = np.concatenate((self.who[own][np.isfinite(self.near[own])], names.astype(object)))
        rows, away = np.concatenate((old_rows, rows)), np.concatenate((self.near[own][np.isfinite(self.near[own])], away))
        code = np.unique(held, return_inverse=True)[1].reshape(-1)
        order = np.lexsort((code, away, rows))
        rows, away, held = rows[order], away[order], held[order]
        starts = np.flatnonzero(np.concatenate(([True], np.diff(rows) != 0)))
        place = np.arange(len(rows)) - np.repeat(starts, np.diff([*starts, len(rows)]))
        kept = place < self.k
        self.near[rows[kept], place[kept]] = away[kept]
        self.who[rows[kept], place[kept]] = held[kept]
        self.limit[own] = np.minimum(self.limit[own], self.near[own, self.k - 1])

    def result(self) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(self.x), 8192):
            rows, at = np.nonzero(np.isfinite(self.near[i : i + 8192]))
            yield pa.RecordBatch.from_arrays(
                [self.ids.take(pa.array(rows + i)), pa.array(self.who[i + rows, at], self.ids.type), pa.array(self.near[i + rows, at])],
                names=["id", "neighbour", "distance"])


def _gaps(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of rows, summed in dimension order as in ``_distances``."""
    out = np.zeros(len(a))
    for d in range(a.shape[1]):
        out += np.square(a[:, d] - b[..., d])
    return np.sqrt(out)


def _limits(found: DataFrame, k: int) -> DataFrame:
    """id, limit: the distance of the k-th neighbour so far, of points that have k."""
    counted = found.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.max("distance").alias("limit"))
    return counted.filter(F.col("n") >= k).select("id", "limit")


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-by-row distances, summed in dimension order so that equal inputs give equal results."""
    out = np.zeros((len(a), len(b)))
    for d in range(a.shape[1]):
        out += np.square(a[:, d][:, None] - b[:, d][None, :])
    return np.sqrt(out)


def _meet(visits: DataFrame, placed: DataFrame, k: int, kind: str, leaf_rows: int) -> DataFrame:
    """Best k per visit: ``visits`` (id, x, leaf, limit) meet the points of the leaf, in chunks of about ``leaf_rows`` askers."""
    calls = cut_lineage(visits.select("id", "x", "leaf", "limit"))
    chunks = cut_lineage(calls.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / leaf_rows).cast("int").alias("chunks")))
    callers = join_on(calls, chunks, ["leaf"]).select("leaf", F.pmod(F.xxhash64(F.lit("chunk"), "id"), F.col("chunks")).cast("int").alias("chunk"), "id", "x", "limit")
    stored = join_on(placed.select("leaf", "id", "x"), chunks, ["leaf"]).select("leaf", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), "id", "x")
    # Fresh column identities: both sides come from the same stored points.
    callers, stored = callers.toDF(*callers.columns), stored.toDF(*stored.columns)

    def meet(asking: pd.DataFrame, there: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"id": [], "neighbour": [], "distance": []})
        if asking.empty or there.empty:
            return empty
        there = there.sort_values("id", kind="stable")
        ids, points = there["id"].to_numpy(), np.stack(there["x"])
        out = []
        for at in range(0, len(asking), 256):
            part = asking.iloc[at:at + 256]
            away = _distances(np.stack(part["x"]), points)
            near = _least(away, k)
            rows = np.repeat(np.arange(len(part)), near.shape[1])
            found = away[rows, near.ravel()]
            keep = np.isfinite(found) & (found <= part["limit"].to_numpy()[rows])
            out.append(pd.DataFrame({
                "id": part["id"].to_numpy()[rows][keep], "neighbour": ids[near.ravel()][keep], "distance": found[keep],
            }))
        return pd.concat(out, ignore_index=True)

    keys = ["leaf", "chunk"]
    return callers.groupBy(*keys).cogroup(stored.groupBy(*keys)).applyInPandas(meet, f"id {kind}, neighbour {kind}, distance double")


def _least(away: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k least values per row; ties go to the lower column."""
    k = min(k, away.shape[1])
    cut = np.partition(away, k - 1, axis=1)[:, k - 1 : k]
    most = int((away <= cut).sum(axis=1).max())  # k, and values equal to the k-th
    near = np.sort(np.argpartition(away, most - 1, axis=1)[:, :most], axis=1)
    order = np.argsort(np.take_along_axis(away, near, axis=1), axis=1, kind="stable")[:, :k]
    return np.take_along_axis(near, order, axis=1)


def _nearest(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("id").orderBy("distance", "neighbour")
    ranked = found.withColumn("rank", F.row_number().over(order))
    return ranked.filter(F.col("rank") <= k).select("id", "neighbour", "distance")
