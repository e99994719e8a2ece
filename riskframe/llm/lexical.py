"""Ranked lexical search: exact top-k inner products of impact vectors in buckets by length.

A document is a vector of term impacts, an item a vector of term weights; the score is their inner product.
Both are scaled by the square root of the weight, so |item| |document| bounds every score (Cauchy-Schwarz).
Documents are ordered by length, longest first, and searched in buckets:

* the longest documents give every item a first k-th score;
* a bucket whose longest document cannot reach an item's k-th score is left out, and documents that can reach none are
  not read;
* inside a bucket the item's heaviest coordinates are scored; with them, the rest of the item's length and the rest of the
  document's length bound each score from above, also for documents that hold none of these;
* what survives is scored again in integers.

Bounds have a margin for rounding, so the result is exact. Terms that no item holds get no
coordinate: they cannot change a score, but they count for the documents' lengths. Items are searched
in blocks of about ``BLOCK_TERMS`` terms, which bounds what travels with the tasks; each block reads all documents.

Terms are maximal runs of ASCII letters, digits and non-ASCII characters, with A-Z in lower case. Null and empty
texts have none: such documents are not counted and such items get no rows. Rows that repeat a document id are
documents of their own; rows that repeat an item id are one item with the terms of all. Null ids take part and
come last in ties. Fewer than k documents with a score above 0: all are returned. Other columns are not read.
Very long texts are read whole, some megabytes at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.frames import cut_lineage
from .common import add_pieces, pieces_batch, pieces_of

K = 10
#: Documents that share a bound; coordinates that are scored before the bound is drawn tighter.
BUCKET, FOCUS = 4096, 6
#: Documents that give the first k-th scores.
FIRST_DOCUMENTS = 8192
#: Terms of the items that are searched at once.
BLOCK_TERMS = 1 << 20
#: Bytes of text split at once.
PIECE = 1 << 21
#: Bytes to themselves if they belong to a term (A-Z in lower case), all others to a blank.
TERM_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def term_lists(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text in order."""
    text = text.translate(TERM_BYTES)
    start = 0
    while start < len(text):
        end = text.find(b" ", start + PIECE)
        end = len(text) if end < 0 else end
        yield text[start:end].split()
        start = end


def item_terms(items: DataFrame, item: str = "item_id", text: str = "text") -> DataFrame:
    """item_id, term (bytes): the distinct terms of every item."""
    kind = items.select(item).schema[0].dataType.simpleString()

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, value in enumerate(batch.column(1)):
                for terms in term_lists(value.as_py() or b""):
                    found = list(set(terms))
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([i] * len(found), pa.int64())), pa.array(found, pa.binary())], names=["item_id", "term"])

    return items.select(item, F.col(text).cast("binary").alias("text")).mapInArrow(split, f"item_id {kind}, term binary").distinct()


def term_vectors(docs: DataFrame, places: dict[bytes, int], key: str, text: str) -> DataFrame:
    """id, n (all terms with repeats), terms (places of known ones), counts; only documents with a term."""
    known = docs.sparkSession.sparkContext.broadcast(places)  # BLOCK_TERMS terms at most, but for an item that has more itself

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get, size = known.value.get, len(known.value)
        for batch in batches:
            n = np.zeros(batch.num_rows, np.int64)
            keys, counts, held = [], [], []

            def settle() -> None:
                if held:
                    key, m = np.unique(np.concatenate(held), return_counts=True)
                    keys.append(key)
                    counts.append(m)
                    held.clear()

            waiting = 0
            for i, value in enumerate(batch.column(1)):
                for terms in term_lists(value.as_py() or b""):
                    at = np.fromiter((get(t, -1) for t in terms), np.int64, len(terms))
                    n[i] += len(terms)
                    held.append(at[at >= 0] + i * size)
                    waiting += len(terms)
                    if waiting > PIECE:
                        settle()
                        waiting = 0
            settle()
            spot, m = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (keys, counts))
            spot, back = np.unique(spot, return_inverse=True)
            m = np.bincount(back, m, spot.size).astype(np.int64)
            rows = np.flatnonzero(n)
            edges = np.searchsorted(spot, rows * size).astype(np.int32)
            offsets = pa.array(np.append(edges, np.int32(spot.size)), pa.int32())
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(pa.array(rows)), pa.array(n[rows]),
                pa.ListArray.from_arrays(offsets, pa.array((spot % max(size, 1)).astype(np.int32))), pa.ListArray.from_arrays(offsets, pa.array(m)),
            ], names=["id", "n", "terms", "counts"])

    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).cast("binary").alias("text"))
    return rows.mapInArrow(count, "id long, n long, terms array<int>, counts array<long>")


def collection_facts(vectors: DataFrame, size: int, step: int = 1 << 16) -> tuple[np.ndarray, int, int]:
    """Documents per term, number of documents, number of terms with repeats."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, all_terms = np.zeros(size + 1, np.int64), 0
        for batch in batches:
            found[:size] += np.bincount(batch.column(1).flatten().to_numpy(), minlength=size)
            found[size] += batch.num_rows
            all_terms += int(batch.column(0).to_numpy().sum())
        if found[size]:
            yield pieces_batch([*pieces_of(0, found, step), (1, 0, np.array([all_terms], np.int64).tobytes())])

    df, terms = np.zeros(size + 1, np.int64), 0
    for row in add_pieces(vectors.select("n", "terms").mapInArrow(add, "which long, first long, sums binary")).toLocalIterator():  # a number per known term
        part = np.frombuffer(bytes(row.sums), np.int64)
        if row.which:
            terms = int(part[0])
        else:
            df[row.first : row.first + part.size] = part
    return df[:size], int(df[size]), terms


def weights(df: np.ndarray, n_documents: int) -> np.ndarray:
    return np.floor(1000.0 * np.log((2.0 * n_documents + 2.0) / (2.0 * df + 1.0))).astype(np.int64)


def impacts(counts: np.ndarray, n: np.ndarray, n_documents: int, all_terms: int) -> np.ndarray:
    """Impact of a term that occurs so often in a document of n terms; both arrays have a cell per coordinate."""
    m = 100 - 90 + (90 * n * n_documents) // all_terms
    return (1_000_000_000 * counts) // (1000 * counts + 8 * m)


def impact_index(vectors: DataFrame, weight: np.ndarray, n_documents: int, all_terms: int) -> DataFrame:
    """id, length, terms, impacts of the documents with a known term, longest first; rows of one length are dealt by their hash."""
    shared = vectors.sparkSession.sparkContext.broadcast(weight)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value.astype(float)
        for batch in batches:
            sizes = batch.column(2).value_lengths().to_numpy()
            terms, counts = batch.column(2).flatten().to_numpy(), batch.column(3).flatten().to_numpy()
            x = impacts(counts, np.repeat(batch.column(1).to_numpy(), sizes), n_documents, all_terms)
            edges = np.append(0, np.cumsum(sizes))
            square = np.bincount(np.repeat(np.arange(sizes.size), sizes), w[terms] * np.square(x.astype(float)), sizes.size)
            offsets = pa.array(edges.astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.sqrt(square)), pa.ListArray.from_arrays(offsets, pa.array(terms)),
                                              pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int32)))], names=["id", "length", "terms", "impacts"])

    found = vectors.mapInArrow(measure, "id long, length double, terms array<int>, impacts array<int>").filter("length > 0")
    found = cut_lineage(found)
    dealt = found.repartitionByRange(F.desc("length"), F.xxhash64("id", "terms"))
    return cut_lineage(dealt.sortWithinPartitions(F.desc("length")))


class Best:
    """The k best documents of an item so far; ties go to the smaller id, null last."""

    def __init__(self, k: int, least: int):
        self.k, self.least = k, least
        self.score, self.id, self.null = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)

    def add(self, score: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        score, ids, null = np.append(self.score, score), np.append(self.id, ids), np.append(self.null, null)
        order = np.lexsort((ids, null, -score))[: self.k]
        self.score, self.id, self.null = score[order], ids[order], null[order]
        if order.size == self.k:
            self.least = max(self.least, int(self.score[-1]))


def search_bucket(bucket: pa.RecordBatch, queries: list[np.ndarray], weight: np.ndarray, norms: np.ndarray, best: list[Best], focus: int = FOCUS) -> int:
    """Update every item's best documents by those of a bucket. Returns the number of documents scored exactly."""
    ids = bucket.column(0)
    null, ids = ids.is_null().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy()
    length, sizes = bucket.column(1).to_numpy(), bucket.column(2).value_lengths().to_numpy()
    terms, x = bucket.column(2).flatten().to_numpy(), bucket.column(3).flatten().to_numpy().astype(np.int64)
    order = np.argsort(terms, kind="stable")
    terms, x, rows = terms[order], x[order], np.repeat(np.arange(len(length)), sizes)[order]
    longest, scored = length.max(initial=0.0), 0
    for query, norm, found in zip(queries, norms, best):
        if norm * longest * (1 + 1e-9) + 1 < found.least:
            continue  # Cauchy-Schwarz: no document of the bucket reaches the k-th score
        start, end = np.searchsorted(terms, query), np.searchsorted(terms, query, side="right")
        some, taken, rest = np.zeros(len(length)), np.zeros(len(length)), norm * norm
        for t, a, b in zip(query[:focus], start, end):  # the heaviest coordinates
            w, at = float(weight[t]), rows[a:b]
            some[at] += w * x[a:b]
            taken[at] += w * np.square(x[a:b].astype(float))
            rest -= w
        bound = some + np.sqrt(max(rest, 0.0) * np.maximum(np.square(length) - taken, 0.0))
        keep = np.flatnonzero(bound + 1e-9 * (norm * length) + 1 >= found.least)
        if not keep.size:
            continue
        score = np.zeros(len(length), np.int64)
        for t, a, b in zip(query, start, end):
            score[rows[a:b]] += weight[t] * x[a:b]
        scored += keep.size
        keep = keep[score[keep] >= max(found.least, 1)]
        if keep.size:
            found.add(score[keep], ids[keep], null[keep])
    return scored


def search(index: DataFrame, queries: list[np.ndarray], weight: np.ndarray, least: np.ndarray, k: int) -> DataFrame:
    """query, id, score: the best k of every task's documents that reach ``least`` (a score per query)."""
    order = [q[np.argsort(-weight[q], kind="stable")] for q in queries]
    norms = np.sqrt([float(weight[q].sum()) for q in queries])
    shared = index.sparkSession.sparkContext.broadcast((order, weight, norms, least))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order, weight, norms, least = shared.value
        best = [Best(k, int(s)) for s in least]
        for batch in batches:
            for i in range(0, batch.num_rows, BUCKET):
                search_bucket(batch.slice(i, BUCKET), order, weight, norms, best)
        for i in range(0, len(best), 4096):
            some = best[i : i + 4096]
            n = np.repeat(np.arange(i, i + len(some)), [b.score.size for b in some])
            null = np.concatenate([b.null for b in some])
            yield pa.RecordBatch.from_arrays([pa.array(n), pa.array(np.concatenate([b.id for b in some]), pa.int64(), mask=null), pa.array(np.concatenate([b.score for b in some]))],
                                             names=["query", "id", "score"])

    return index.mapInArrow(find, "query long, id long, score long")


def _top(found: DataFrame, k: int) -> DataFrame:
    """The best k per query: first within salted parts, as every task sends k."""
    best = [F.desc("score"), F.asc_nulls_last("id")]
    salt = F.pmod(F.xxhash64("id"), F.lit(64))
    parts = found.withColumn("salt", salt).withColumn("rank", F.row_number().over(Window.partitionBy("query", "salt").orderBy(*best))).filter(F.col("rank") <= k)
    return parts.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*best))).filter(F.col("rank") <= k).select("query", "rank", "id", "score")


def _search_block(docs: DataFrame, terms: list, key: str, text: str, k: int) -> DataFrame:
    """query, rank, id, score for (query, term) pairs."""
    places = {t: i for i, t in enumerate(sorted({t for _, t in terms}))}
    queries: list[list[int]] = [[] for _ in range(max(q for q, _ in terms) + 1)]
    for q, t in terms:
        queries[q].append(places[t])
    queries = [np.array(q, np.int64) for q in queries]
    vectors = cut_lineage(term_vectors(docs, places, key, text))
    df, n_documents, all_terms = collection_facts(vectors, len(places))
    weight = weights(df, n_documents)
    index = impact_index(vectors, weight, n_documents, max(all_terms, 1))
    share = max(0.0, 1.0 - FIRST_DOCUMENTS / max(n_documents, 1))
    cut = index.agg(F.percentile_approx("length", share)).head()[0] or 0.0
    least = np.zeros(len(queries), np.int64)
    first = cut_lineage(_top(search(index.filter(F.col("length") >= cut), queries, weight, least, k), k))
    for row in first.filter(F.col("rank") == k).toLocalIterator():  # a row per item of the block
        least[row.query] = row.score
    norms = np.sqrt([float(weight[q].sum()) for q in queries])
    reach = min([float(s - 1) / n for s, n in zip(least, norms) if n > 0], default=0.0) * (1 - 1e-9)
    rest = index.filter((F.col("length") < cut) & (F.col("length") >= reach))  # shorter documents reach no item's k-th score
    return _top(first.select("query", "id", "score").union(search(rest, queries, weight, least, k)), k)


def top_documents(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", k: int = K,
                  block_terms: int = BLOCK_TERMS) -> DataFrame:
    """item_id, rank (from 1), doc_id, score."""
    terms = cut_lineage(item_terms(items, item, item_text))
    blocks = -(-terms.count() // block_terms)
    block = F.pmod(F.xxhash64("item_id"), F.lit(max(blocks, 1)))
    kind = terms.schema["item_id"].dataType.simpleString()
    found = docs.sparkSession.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    for i in range(blocks):
        own = terms.filter(block == i).collect()  # about block_terms rows
        if not own:
            continue
        names = {r.item_id: None for r in own}
        numbers = {name: n for n, name in enumerate(names)}
        ranked = _search_block(docs, [(numbers[r.item_id], bytes(r.term)) for r in own], key, text, k)
        known = docs.sparkSession.createDataFrame(list(enumerate(names)), f"query long, item_id {kind}")
        ranked = ranked.join(F.broadcast(known), "query").select("item_id", "rank", F.col("id").alias("doc_id"), "score")  # a row per item of the block
        found = found.union(cut_lineage(ranked) if blocks > 1 else ranked)
    return found
