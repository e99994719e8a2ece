"""Exact top-k inner products through a pivot-distance index.

Vectors are keyed by their nearest pivot and their distance to it; each pivot's vectors are cut
into annuli of about equal size. With q.x = (|q|^2 + |x|^2 - |q - x|^2) / 2 and the triangle
inequality |q - x| >= | d(q, pivot) - d(x, pivot) | every annulus has an upper bound for a query. The annuli
with the best bounds are searched first; then only those whose bound reaches the query's k-th score
so far are expanded. Bounds have a margin for rounding, scores are exact integers, so the result
is exact; in many dimensions bounds rule out little and the work nears queries x vectors.

Components are floor(1024 x). Vectors that are null, empty, or hold a null or non-finite component
take no part, neither as query nor as candidate. Only vectors of the same length are compared. A
query's candidates are all rows but its own (those with its id). Rows that repeat an id and vector count once; an id
with several vectors is scored by the best of them, and as a query by each of its vectors (best score per candidate).
Null ids are never queries, and as candidates take no part. Fewer than k candidates: all are returned. Scores
beyond a long raise an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.frames import cut_lineage

SCALE, K = 1024.0, 10
#: Pivots are drawn from the rows with the smallest hashes; at most so many, for at least so many vectors each.
PIVOTS, VECTORS_PER_PIVOT, SAMPLE_ROWS = 256, 16384, 4096
ANNULI = 4
#: Vectors and queries compared at once.
PIECE, QUERY_PIECE = 4096, 512


def usable(df: DataFrame, key: str, vector: str) -> DataFrame:
    """id, v: integer components as doubles, of the vectors that take part; one row per id and vector."""
    x = F.col(vector).cast("array<double>")
    fine = (F.size(x) > 0) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    # Doubles from 2^52 on are integers; as longs they would saturate.
    cells = F.transform(x, lambda c: F.when(F.abs(c * SCALE) < 2.0**52, F.floor(c * SCALE).cast("double")).otherwise(c * SCALE))
    rows = df.filter(F.col(key).isNotNull() & F.col(vector).isNotNull()).filter(fine)
    return rows.select(F.col(key).cast("long").alias("id"), cells.alias("v")).dropDuplicates()


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one length as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact integer inner products; doubles hold them up to 2^53, longs up to 2^63, beyond that Python's integers decide."""
    most = np.abs(q).max(initial=0) * np.abs(x).max(initial=0) * q.shape[1]
    if most < 2.0**53:
        return (q @ x.T).astype(np.int64)
    if most < 2.0**62:
        return q.astype(np.int64) @ x.astype(np.int64).T
    exact = np.array([[int(c) for c in row] for row in q], object) @ np.array([[int(c) for c in row] for row in x], object).T
    return exact.astype(np.int64)  # raises OverflowError beyond a long


def choose_pivots(vectors: DataFrame, dims: list[tuple[int, int]], sample_rows: int = SAMPLE_ROWS) -> dict[int, np.ndarray]:
    """length -> pivots: from a bounded sample, each the farthest from those chosen before.

    ``dims``: (length, rows) pairs. The number of pivots follows the number of vectors up to a bound.
    """
    pivots = {}
    for length, rows in dims:
        own = vectors.filter(F.size("v") == length)
        sample = own.orderBy(F.xxhash64("id"), "id").limit(sample_rows).select("v").toPandas()["v"]
        x = np.stack([np.asarray(v, float) for v in sample])
        n = min(PIVOTS, max(4, -(-rows // VECTORS_PER_PIVOT)), len(x))
        chosen, far = [0], np.linalg.norm(x - x[0], axis=1)
        while len(chosen) < n and far.max() > 0:
            chosen.append(int(far.argmax()))
            far = np.minimum(far, np.linalg.norm(x - x[chosen[-1]], axis=1))
        pivots[length] = x[chosen]
    return pivots


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    out = np.empty((len(x), len(pivots)))
    for j, p in enumerate(pivots):
        out[:, j] = np.sqrt(np.square(x - p).sum(axis=1))
    return out


def index(vectors: DataFrame, pivots: dict[int, np.ndarray], annuli: int = ANNULI) -> tuple[DataFrame, list]:
    """The stored index (cell, chunk, id, v) and a row per cell: cell, length, pivot, near, far, norm2, n.

    A cell is an annulus of a pivot; cells number pivots x annuli at most, and large ones consist of
    chunks of about ``PIECE`` vectors.
    """
    first = {}
    for length in sorted(pivots):
        first[length] = sum(len(pivots[n]) for n in first)

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column(1).value_lengths().to_numpy()
            for length in np.unique(sizes):
                part = batch.filter(pa.array(sizes == length))
                x = _matrix(part.column(1))
                d = _distances(x, pivots[int(length)])
                near = d.argmin(axis=1)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(near + first[int(length)], pa.int32()), pa.array(d[np.arange(len(x)), near]), pa.array(np.square(x).sum(axis=1))],
                    names=["id", "v", "pivot", "distance", "norm2"])

    keyed = cut_lineage(vectors.mapInArrow(key, "id long, v array<double>, pivot int, distance double, norm2 double"))
    shares = [i / annuli for i in range(1, annuli)]
    cuts = keyed.groupBy("pivot").agg(F.percentile_approx("distance", shares).alias("cuts"))  # a row per pivot: bounded
    ring = F.size(F.filter("cuts", lambda c: F.col("distance") > c))
    celled = keyed.join(F.broadcast(cuts), "pivot").withColumn("cell", F.col("pivot") * annuli + ring)
    facts = celled.groupBy("cell", "pivot").agg(
        F.min("distance").alias("near"), F.max("distance").alias("far"), F.max("norm2").alias("norm2"), F.count(F.lit(1)).alias("n"))
    owner = {first[length] + i: (length, i) for length, ps in pivots.items() for i in range(len(ps))}
    cells = [(r.cell, *owner[r.pivot], r.near, r.far, r.norm2, r.n) for r in facts.collect()]
    chunks = F.ceil(F.col("n") / PIECE).cast("int").alias("chunks")
    dealt = celled.join(F.broadcast(facts.select("cell", chunks)), "cell")  # a row per cell: bounded
    return dealt.select("cell", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int").alias("chunk"), "id", "v"), cells


def _plan(queries: DataFrame, pivots: dict[int, np.ndarray], cells: list, k: int, phase: int) -> DataFrame:
    """Query rows (id, v and, in phase 2, least) dealt to the (cell, chunk) pairs they have to visit.

    Phase 1: the cells with the best bounds, until they hold more than k vectors. Phase 2: all
    others whose bound reaches ``least``, the k-th score so far (null: none yet).
    """
    by_length = {length: [c for c in cells if c[1] == length] for length in pivots}

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column(1).value_lengths().to_numpy()
            for length in np.unique(sizes):
                own = by_length.get(int(length), [])
                if not own:
                    continue
                part = batch.filter(pa.array(sizes == length))
                q, place = _matrix(part.column(1)), np.array([c[2] for c in own])
                near, far, norm2, held = (np.array([c[i] for c in own], float) for i in (3, 4, 5, 6))
                chunks = np.ceil(held / PIECE)
                d = _distances(q, pivots[int(length)])[:, place]
                apart = np.maximum(0, np.maximum(near - d, d - far))
                own2 = np.square(q).sum(axis=1)[:, None]
                bound = (own2 + norm2 - np.square(apart)) / 2 + 1e-9 * (own2 + norm2 + np.square(d)) + 1
                order = np.argsort(-bound, axis=1, kind="stable")
                # The best cell, and the next ones while those before hold too few vectors.
                upto = np.cumsum(held[order], axis=1) - held[order]
                first = np.zeros(order.shape, bool)
                np.put_along_axis(first, order, upto <= k, axis=1)
                if phase == 1:
                    visit = first
                else:
                    least = part.column(2).to_numpy(zero_copy_only=False).astype(float)[:, None]
                    visit = ~first & (np.isnan(least) | (bound >= least))
                rows, cols = np.nonzero(visit)
                n = chunks[cols].astype(np.int64)
                rows, cols = np.repeat(rows, n), np.repeat(cols, n)
                chunk = np.arange(len(rows)) - np.repeat(np.cumsum(n) - n, n)
                for i in range(0, len(rows), 8192):
                    at = pa.array(rows[i : i + 8192])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.array([c[0] for c in own], np.int32)[cols[i : i + 8192]]), pa.array(chunk[i : i + 8192], pa.int32()),
                         part.column(0).take(at), part.column(1).take(at)],
                        names=["cell", "chunk", "id", "v"])

    return queries.mapInArrow(deal, "cell int, chunk int, id long, v array<double>")


def _search(indexed: DataFrame, visits: DataFrame, k: int) -> DataFrame:
    """query_id, vec_id, score: the best k of every visited chunk."""
    both = indexed.withColumn("asks", F.lit(False)).union(visits.withColumn("asks", F.lit(True)))
    # A chunk's vectors come first and are held; its queries stream past them.
    dealt = both.repartition("cell", "chunk").sortWithinPartitions("cell", "chunk", "asks")

    def best(ids, x, asking, q):
        score = np.where(ids[None, :] == asking[:, None], np.iinfo(np.int64).min, _scores(q, x))
        for i, s in enumerate(score):
            if len(s) > k:  # ids ascend, so a stable choice sends ties to the smaller id
                least = np.partition(s, len(s) - k)[len(s) - k]
                over, ties = np.flatnonzero(s > least), np.flatnonzero(s == least)
                take = np.concatenate((over, ties[: k - len(over)]))
            else:
                take = np.arange(len(s))
            take = take[ids[take] != asking[i]]
            yield np.full(len(take), asking[i]), ids[take], s[take]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, parts, ids, x = None, [], None, None
        for batch in batches:
            cell, chunk, asks = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 4))
            new = (np.diff(cell) != 0) | (np.diff(chunk) != 0) | (asks[1:] != asks[:-1])
            edges = [0, *(np.flatnonzero(new) + 1), len(cell)] if len(cell) else [0]
            for a, b in zip(edges[:-1], edges[1:]):
                if at != (cell[a], chunk[a]):
                    at, parts, ids, x = (cell[a], chunk[a]), [], None, None
                part = batch.slice(a, b - a)
                if not asks[a]:
                    parts.append((part.column(2).to_numpy(), _matrix(part.column(3))))
                    continue
                if ids is None and parts:
                    ids, x = (np.concatenate(z) for z in zip(*parts))
                    order = np.argsort(ids, kind="stable")
                    ids, x, parts = ids[order], x[order], []
                if ids is None:
                    continue
                for i in range(0, b - a, QUERY_PIECE):
                    some = part.slice(i, QUERY_PIECE)
                    found = list(best(ids, x, some.column(2).to_numpy(), _matrix(some.column(3))))
                    yield pa.record_batch(dict(zip(("query_id", "vec_id", "score"), map(np.concatenate, zip(*found)))))

    return dealt.mapInArrow(search, "query_id long, vec_id long, score long")


def _top(found: DataFrame, k: int) -> DataFrame:
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).filter(F.col("rank") <= k)


def top_k(vectors: DataFrame, queries: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = K, annuli: int = ANNULI) -> DataFrame:
    """query_id, rank (from 1), vec_id, score."""
    x, q = cut_lineage(usable(vectors, key, vector)), cut_lineage(usable(queries, key, vector))
    dims = [(r.length, r.n) for r in x.groupBy(F.size("v").alias("length")).agg(F.count(F.lit(1)).alias("n")).collect()]
    pivots = choose_pivots(x, sorted(dims))
    indexed, cells = index(x, pivots, annuli) if pivots else (x.select(F.lit(0).alias("cell"), F.lit(0).alias("chunk"), "id", "v"), [])
    indexed = cut_lineage(indexed)
    first = cut_lineage(_top(_search(indexed, _plan(q, pivots, cells, k, 1), k), k))
    least = first.filter(F.col("rank") == k).select(F.col("query_id").alias("__q"), F.col("score").alias("least"))
    rest = q.join(least, q["id"] == least["__q"], "left").select("id", "v", "least")
    second = _search(indexed, _plan(rest, pivots, cells, k, 2), k)
    return _top(first.select("query_id", "vec_id", "score").union(second), k).select("query_id", "rank", "vec_id", "score")
