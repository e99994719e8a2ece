"""SimHash near-duplicates: fingerprints that differ in few bits, found by shared blocks of bits.

A fingerprint has a bit set where over half of the text's shingle hashes have it. It is cut into
five blocks; two fingerprints with at most three differing bits agree on at least two blocks, so
every such pair meets under one of the ten pairs of blocks, and its distance is then counted.

Null text and text without words have fingerprint zero, linked like any other. Fewer words than
a shingle holds form one shingle. Repeated rows get the same result. A null id takes part, but
is never a component's name while a member has an id. An empty table gives an empty result. Only the
id and the text are read, so other columns can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.frames import cut_lineage
from .common import BROADCAST_BYTES, PIECES, add_pieces, null_safe, pieces_batch, pieces_of, text_hash
from .components import components

BITS, SHINGLE, SEED, DISTANCE, BLOCKS = 64, 3, 42, 3, 5
#: Fingerprints compared with each other in one piece; larger groups are cut into pairs of chunks.
CHUNK = 4096
#: Shingles held at once.
SLICE = 1 << 16


def fingerprint_of(text: str | None, width: int = SHINGLE, seed: int = SEED) -> int:
    """Signed 64-bit fingerprint of one text."""
    from xxhash import xxh64_intdigest

    words = text.encode().lower().split() if text else []  # bytes: only A-Z, space and \x09-\x0D count
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    width = min(width, len(words))
    spans = list(zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist()))
    counts = np.zeros(BITS, np.int64)
    for i in range(0, len(spans), SLICE):
        part = spans[i : i + SLICE]
        h = np.fromiter((xxh64_intdigest(joined[a:b], seed) for a, b in part), np.uint64, len(part))
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += np.add.reduce(bits, axis=0, dtype=np.int64)
    chosen = np.packbits(counts * 2 > len(spans), bitorder="little")
    return int(chosen.view(np.int64)[0])


def fingerprint(text: Column) -> Column:
    """Column of signed 64-bit fingerprints."""

    @F.pandas_udf("long")
    def compute(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([fingerprint_of(t) for t in texts], dtype="int64")

    return compute(text)


def block_masks(distance: int = DISTANCE, blocks: int = BLOCKS) -> list[int]:
    """Signed masks of the block combinations on which two close fingerprints must agree somewhere."""
    cuts = [BITS * i // blocks for i in range(blocks + 1)]
    single = [((1 << cuts[i + 1]) - 1) ^ ((1 << cuts[i]) - 1) for i in range(blocks)]
    masks = [sum(chosen) for chosen in combinations(single, blocks - distance)]
    return [m - (1 << BITS) if m >> (BITS - 1) else m for m in masks]


def _spanning(values: np.ndarray, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Stars that connect what a group's links connect: at most one row per member."""
    rest = values
    while rest.size > 1:
        root, front, rest = rest[0], rest[:1], rest[1:]
        while front.size and rest.size:
            near = np.zeros(rest.size, bool)
            for i in range(0, front.size, 64):
                near |= (np.bitwise_count(front[i : i + 64, None] ^ rest[None, :]) <= distance).any(axis=0)
            front, rest = rest[near], rest[~near]
            if front.size:
                yield np.full(front.size, root), front


def _links(group: np.ndarray, value: np.ndarray, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    starts = np.concatenate(([0], np.flatnonzero(np.diff(group)) + 1, [group.size]))
    sizes = np.diff(starts)
    two = starts[:-1][sizes == 2]
    left, right = value[two], value[two + 1]
    close = np.bitwise_count(left ^ right) <= distance
    if close.any():
        yield left[close], right[close]
    for i in np.flatnonzero(sizes > 2):
        yield from _spanning(value[starts[i] : starts[i + 1]], distance)


def links(fingerprints: DataFrame, distance: int = DISTANCE, blocks: int = BLOCKS, chunk: int = CHUNK) -> DataFrame:
    """a, b: rows that connect distinct fingerprints (one stored column ``fp``) as their links do.

    Groups that share blocks are cut into chunks of bounded size and every pair of chunks is
    compared, so no group has to fit into a task; each piece returns a spanning star per cluster
    rather than all pairs.
    """
    # A block group is known by one hash; two groups of one hash would only be compared together.
    cells = F.array(*[F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(m))) for i, m in enumerate(block_masks(distance, blocks))])
    keyed = fingerprints.select("fp", F.explode(cells).alias("block"))
    shared = cut_lineage(keyed.groupBy("block").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
    met = keyed.join(shared, "block")
    chunks = F.ceil(F.col("n") / chunk).cast("int")
    met = met.withColumn("chunks", chunks).withColumn("mine", F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    group = F.xxhash64("block", F.least("mine", "other"), F.greatest("mine", "other"))
    dealt = met.select(group.alias("piece"), "fp").repartition("piece").sortWithinPartitions("piece")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, value = np.empty(0, np.int64), np.empty(0, np.int64)
        for batch in batches:
            group = np.concatenate((group, batch.column(0).to_numpy()))
            value = np.concatenate((value, batch.column(1).to_numpy()))
            done = int(np.searchsorted(group, group[-1])) if group.size else 0  # the last piece may go on
            for a, b in _links(group[:done], value[:done], distance):
                yield pa.record_batch({"a": a, "b": b})
            group, value = group[done:], value[done:]
        for a, b in _links(group, value, distance):
            yield pa.record_batch({"a": a, "b": b})

    return dealt.mapInArrow(compare, "a long, b long")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, __text (hash of the text), fp, component_id (smallest key that can be reached) per row."""
    marked = cut_lineage(docs.select(key, text_hash(text).alias("__text"), fingerprint(F.col(text)).alias("fp")))
    known = cut_lineage(marked.groupBy("fp").agg(F.min(key).alias("first")))
    roots = cut_lineage(components(links(known.select("fp"))))
    named = roots.join(known, roots["node"] == known["fp"]).groupBy("root").agg(F.min("first").alias("least"))
    moved = roots.join(named, "root").select(F.col("node").alias("fp"), "least")
    names = cut_lineage(known.join(moved, "fp", "left").select("fp", F.coalesce("least", "first").alias("component_id")))
    return marked.join(names, "fp").select(key, "__text", "fp", "component_id")


#: Similar documents: words per shingle and least Jaccard similarity of the shingle sets.
SIMILAR_SHINGLE, SIMILARITY = 5, 0.8
#: Counters of shingles by their hash. They only choose the order in which shingles are taken, not what is found.
COUNTERS, COUNTERS_STEP = 1 << 18, 1 << 12
#: Bytes of a row that says what becomes of an id and text, as an estimate.
SPECIAL_BYTES = 32
#: Bits of a set's parities, kept as 64-bit integers.
PARITIES = 512


def shingle_set(text: str | None, width: int = SIMILAR_SHINGLE, seed: int = SEED) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles; fewer words form one, none have none."""
    from xxhash import xxh64_intdigest

    words = text.encode().lower().split() if text else []
    width = min(width, len(words))
    n = len(words) - width + 1 if words else 0
    if width == 1:
        words = list(set(words))
        h = np.fromiter((xxh64_intdigest(w, seed) for w in words), np.uint64, len(words))
    else:
        h = np.fromiter((xxh64_intdigest(b" ".join(words[i : i + width]), seed) for i in range(n)), np.uint64, n)
    return np.unique(h.view(np.int64))


def shingle_ranks(docs: DataFrame, text: str, width: int) -> np.ndarray:
    """How frequent each counter's shingles are, over all texts: 0 up to four times the mean, one more per doubling. A few hundred KB."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                found = [shingle_set(t.as_py(), width) for t in batch.column(0).slice(i, 256)]
                sums += np.bincount(np.concatenate(found) & (COUNTERS - 1), minlength=COUNTERS)
        found = list(pieces_of(0, sums, COUNTERS_STEP))
        if found:
            yield pieces_batch(found)

    sums = np.zeros(COUNTERS, np.int64)
    for row in add_pieces(docs.select(text).mapInArrow(count, PIECES)).toLocalIterator():
        v = np.frombuffer(bytes(row.sums), np.int64)
        sums[row.first : row.first + v.size] = v
    return np.frexp((sums // max(4 * int(sums.sum()) // COUNTERS, 1)).astype(float))[1].astype(np.uint8)


def _prefix(shingles: np.ndarray, ranks: np.ndarray, similarity: float) -> np.ndarray:
    """The first shingles by rank, then hash: as many as a set can't miss all of and still be that similar."""
    if not shingles.size:
        return shingles
    # One more than needed where the product is rounded.
    size = min(shingles.size, shingles.size - int(np.ceil(similarity * shingles.size - 1e-6)) + 1)
    return shingles[np.argsort(ranks[shingles & (COUNTERS - 1)], kind="stable")[:size]]


def _parity(shingles: np.ndarray) -> list[int]:
    """Whether the set has an odd number of shingles of each kind; two sets differ in at least as many shingles as parities."""
    odd = np.bincount(shingles & (PARITIES - 1), minlength=PARITIES) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64).tolist()


def _fine_parity(shingles: np.ndarray) -> bytes:
    """The same with a kind for every shingle or more (a power of two): a bit or two per shingle, so that large sets are told apart too."""
    width = max(PARITIES, 1 << max(int(shingles.size) - 1, 0).bit_length())
    return np.packbits((np.bincount(shingles & (width - 1), minlength=width) & 1).astype(np.uint8)).tobytes()


def _odd(one: bytes, two: bytes) -> int:
    """How many parities differ, at the narrower set's width: the halves of a parity make up the next narrower one."""
    x, y = np.frombuffer(one, np.uint64), np.frombuffer(two, np.uint64)
    n = min(x.size, y.size)
    x, y = (np.bitwise_xor.reduce(v.reshape(-1, n), axis=0) for v in (x, y))
    return int(np.bitwise_count(x ^ y).sum())


def _may_be_similar(a: str, b: str, similarity: float) -> Column:
    """Whether sets of ``size`` that share their shingles at ``place`` as the first can be that similar."""
    x, y = F.col(f"{a}.size"), F.col(f"{b}.size")
    most = F.least(x - F.col(f"{a}.place"), y - F.col(f"{b}.place"))
    return most + 1e-6 >= similarity * (x + y - most)


def _candidates(met: DataFrame, similarity: float) -> DataFrame:
    """one, two: pairs of ``met`` (shingle, size, fp, place) next to each other or with the first, of every shingle."""
    own = F.struct("size", "fp", "place")
    along = Window.partitionBy("shingle").orderBy("size", "fp")
    near = met.select(own.alias("b"), F.array_distinct(F.array(F.lag(own).over(along), F.first(own).over(along))).alias("others"))
    near = near.select("b", F.explode("others").alias("a")).filter(F.col("a").isNotNull() & (F.col("a.fp") != F.col("b.fp")))
    return _ordered(near.filter(_may_be_similar("a", "b", similarity)))


def _candidates_across(met: DataFrame, similarity: float, chunk: int = CHUNK) -> DataFrame:
    """one, two: all pairs of ``met`` (shingle, size, fp, place, group) that share a shingle and no group.

    The rows of a shingle are cut into chunks of bounded size and every pair of chunks is a piece, so a frequent one is spread over tasks.
    """
    counted = met.groupBy("shingle").agg(F.count(F.lit(1)).alias("n"), F.min("group").alias("low"), F.max("group").alias("high"))
    mixed = cut_lineage(counted.filter("low != high").select("shingle", F.ceil(F.col("n") / chunk).cast("int").alias("chunks")))
    dealt = met.join(mixed, "shingle").withColumn("mine", F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    dealt = cut_lineage(dealt.select("shingle", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "size", "fp", "place", "group"))
    piece = ["shingle", "i", "j"]
    left = dealt.select(*piece, F.struct("size", "fp", "place", "group").alias("a"))
    right = dealt.select(*piece, F.struct("size", "fp", "place", "group").alias("b"))
    both = left.join(right, piece).filter((F.col("a.fp") < F.col("b.fp")) & (F.col("a.group") != F.col("b.group")))
    return _ordered(both.filter(_may_be_similar("a", "b", similarity)))


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a.fp", "b.fp").alias("one"), F.greatest("a.fp", "b.fp").alias("two")).distinct()


def _linked_classes(linked: DataFrame, marked: DataFrame, key: str) -> DataFrame:
    """one, two: pairs of ``marked``'s fingerprints that connect what ``linked`` connects, at most one row per fingerprint and component."""
    # A component without any key is known by its rows' fingerprints.
    group = F.coalesce(F.col("component_id").cast("string"), F.concat(F.lit("~"), F.hex("fp")))
    groups = linked.select(key, "__text", group.alias("group")).distinct()
    members = null_safe(marked.select(key, "__text", "fp").distinct(), groups, [key, "__text"], "inner").select("group", "fp").distinct()
    members = cut_lineage(members)
    least = members.groupBy("group").agg(F.min("fp").alias("one"), F.max("fp").alias("last")).filter("one < last")
    return members.join(least, "group").filter("fp != one").select("one", F.col("fp").alias("two")).distinct()


def similar_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = SIMILAR_SHINGLE, similarity: float = SIMILARITY,
                      linked: DataFrame | None = None) -> DataFrame:
    """key, __text, fp (hash of the shingle set), component_id (smallest key that can be reached) per row.

    Documents are linked if their shingle sets have that Jaccard similarity, and no link is missed: in any one order of all shingles two such
    sets share one of their first (a fifth and one more, for 0.8), so the pairs that share one are compared. Rare shingles come first. Documents of one shingle
    set are one class, so copies are never paired. Each class is compared with its neighbours under a shingle first; what that connects
    needs no more comparing, so a large group of near copies gives a few pairs per member, and then all pairs between groups are compared.
    What ``linked`` (as from ``near_duplicates`` of the same rows) holds in one component is linked as well.
    """

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                sets = [shingle_set(t.as_py(), width) for t in part.column(2)]
                fp = [int(np.uint64(xxh64_intdigest(s.tobytes())).view(np.int64)) for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(fp, pa.int64()), pa.array(map(len, sets), pa.int64()), pa.array([_prefix(s, ranks.value, similarity) for s in sets], pa.list_(pa.int64())),
                     pa.array(map(_parity, sets), pa.list_(pa.int64())), pa.array(map(_fine_parity, sets), pa.binary())],
                    names=[key, "__text", "fp", "size", "prefix", "parity", "fine"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            odd = np.fromiter(map(_odd, batch.column(3).to_pylist(), batch.column(4).to_pylist()), np.int64, batch.num_rows)
            total = batch.column(2).to_numpy()
            likely = total - odd + 1e-6 >= similarity * (total + odd)
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(pa.array(likely)) for i in range(2)], names=["one", "two"])

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                found = [shingle_set(t.as_py(), width) for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.list_(pa.int64()))], names=["fp", "shingles"])

    def verified(pairs: DataFrame) -> DataFrame:
        # What the parities rule out never needs its shingles.
        facts = classes.select("fp", F.struct("size", "parity").alias("f"))
        told = pairs.join(facts.toDF("one", "x"), "one").join(facts.toDF("two", "y"), "two")
        apart = F.aggregate(F.zip_with("x.parity", "y.parity", lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda a, b: a + b)
        total = F.col("x.size") + F.col("y.size")
        told = cut_lineage(told.filter(total - apart + 1e-6 >= similarity * (total + apart)).select("one", "two", total.alias("total")))
        fine = classes.select("fp", "fine")
        told = told.join(fine.toDF("one", "x"), "one").join(fine.toDF("two", "y"), "two").select("one", "two", "total", "x", "y")
        pairs = cut_lineage(told.mapInArrow(compare, "one long, two long"))
        asked = pairs.select(F.col("one").alias("fp")).union(pairs.select(F.col("two").alias("fp"))).distinct()
        named = cut_lineage(classes.join(asked, "fp").select(F.col(f"k.{key}").alias(key), F.col("k.__text").alias("__text"), "fp"))
        texts = null_safe(rows, named, [key, "__text"], "inner").dropDuplicates(["fp"]).select("fp", text)
        sets = cut_lineage(texts.mapInArrow(expand, "fp long, shingles array<long>"))
        both = pairs.join(sets.select(F.col("fp").alias("one"), F.col("shingles").alias("x")), "one").join(sets.select(F.col("fp").alias("two"), F.col("shingles").alias("y")), "two")
        both = both.withColumn("shared", F.size(F.array_intersect("x", "y")))
        return both.filter(F.col("shared") >= similarity * (F.size("x") + F.size("y") - F.col("shared"))).select("one", "two")

    kind = docs.select(key).schema[0].dataType.simpleString()
    rows = docs.select(key, text_hash(text).alias("__text"), text)
    ranks = docs.sparkSession.sparkContext.broadcast(shingle_ranks(docs, text, width))
    marked = cut_lineage(rows.mapInArrow(mark, f"`{key}` {kind}, __text long, fp long, size long, prefix array<long>, parity array<long>, fine binary"))
    first = F.min(F.struct(F.col(key).isNull().alias("n"), F.col(key), F.col("__text")))
    classes = cut_lineage(marked.groupBy("fp").agg(F.any_value("size").alias("size"), F.any_value("parity").alias("parity"), F.any_value("fine").alias("fine"), first.alias("k")))
    # The prefixes, most of what is held here, are not stored once more by class.
    prefixes = marked.groupBy("fp").agg(F.any_value("size").alias("size"), F.any_value("prefix").alias("prefix"))
    keyed = prefixes.select("size", "fp", F.posexplode("prefix").alias("place", "shingle"))
    alone = F.count(F.lit(1)).over(Window.partitionBy("shingle")) == 1
    met = cut_lineage(keyed.withColumn("alone", alone).filter("NOT alone").drop("alone"))
    near = verified(_candidates(met, similarity))
    near = cut_lineage(near if linked is None else near.union(_linked_classes(linked, marked, key)))
    joined = cut_lineage(components(near).select(F.col("node").alias("fp"), "root"))
    grouped = cut_lineage(met.join(joined, "fp", "left").select("shingle", "size", "fp", "place", F.coalesce("root", "fp").alias("group")))
    roots = cut_lineage(components(near.union(verified(_candidates_across(grouped, similarity)))))
    known = classes.select("fp", F.col(f"k.{key}").alias("first"))
    least = roots.join(known, roots["node"] == known["fp"]).groupBy("root").agg(F.min("first").alias("least"))
    moved = roots.join(least, "root").select(F.col("node").alias("fp"), "least")
    names = cut_lineage(known.join(moved, "fp", "left").select("fp", F.coalesce("least", "first").alias("component_id")))
    return marked.join(names, "fp").select(key, "__text", "fp", "component_id")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", found: DataFrame | None = None) -> DataFrame:
    """``docs`` with one row of each group: smallest key, then smallest hash of the text.

    Groups come from ``found``, as from ``similar_documents``, or from ``near_duplicates``.

    Rows that repeat key and text count as one document. Where no row of a group has a key, one
    row of each fingerprint stays. All columns are kept as they are.
    """
    found = cut_lineage(near_duplicates(docs, key, text) if found is None else found)
    order = F.struct(F.col(key).isNull(), F.col(key), F.col("__text"))
    group = F.coalesce(F.col("component_id").cast("string"), F.concat(F.lit("~"), F.hex("fp")))
    kept = found.groupBy(group.alias("group")).agg(F.min(order).alias("k"))
    kept = kept.select(F.col(f"k.{key}").alias(key), F.col("k.__text").alias("__text"))
    # What is lost or comes more than once is told by id and hash; only rows that come more than once are shuffled with their texts.
    seen = found.groupBy(key, "__text").agg(F.count(F.lit(1)).alias("n"))
    kept = kept.withColumn("kept", F.lit(True))
    special = cut_lineage(null_safe(seen, kept, [key, "__text"], "left").filter("kept IS NULL OR n > 1").select(key, "__text", F.col("kept").isNull().alias("__lost")))
    size = special.count() * SPECIAL_BYTES
    told = docs.withColumn("__text", text_hash(text))
    told = null_safe(told, F.broadcast(special) if size <= BROADCAST_BYTES else special, [key, "__text"], "left")
    once = told.filter("__lost IS NULL").select(docs.columns)
    more = told.filter("NOT __lost").dropDuplicates([key, "__text"]).select(docs.columns)
    return once.unionByName(more)
