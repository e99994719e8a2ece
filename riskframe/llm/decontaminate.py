"""Benchmark decontamination by template canonicalisation.

Words lose case and outer punctuation; numbers, units after numbers, and names (capitalised words
that do not open a sentence; neighbours form one name) become typed placeholders. Windows of five
template words are hash-joined with those of the benchmark. As case may be lost in a copy, every
text is also cut with its names as plain words; as names may open sentences, also with capitalised
sentence openers as names, unless the corpus mostly has that word in lower case. A document holds an item if it has at least 80 %
of the item's windows in one form or another. Then the slots are compared: in a copy or a
re-parameterised question the item's value for a slot always turns into the same value of the
document.

An item with n windows must share one of its n - ceil(0.8 n) + 1 rarest, so only those look for
candidates; passages that many items share join nothing by themselves. Documents' windows pass a
bitmap of the benchmark's hashes (of fixed size) before they leave their task. Items with the same
template are one class while candidates are sought; the slots are compared for every item that
differs from the others in words or slots. Items equal in both are named by the smallest of their
ids; ``item_names`` lists all.

A window with fewer than two literal words is compared by its words instead of its template. Null
or empty texts have no windows; items of fewer than five template words are one window of all their words. Rows that
repeat id and text give one result. Null ids take part. Only id and text are read. Very long texts are read whole.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.frames import cut_lineage
from .common import null_safe, text_hash

WIDTH, COVERAGE, CONSISTENCY, MIN_LITERALS = 5, 0.8, 0.8, 2
#: Bits of the bitmap of benchmark hashes: 4 MB.
BITMAP_BITS = 1 << 25
#: An opener is an ordinary word if it is written in lower case so often for each time with a capital, and among so many words.
ORDINARY, ORDINARY_RATE = 0.25, 1e-5
#: Characters handled at once, and known words kept, by a task.
PIECE, KNOWN_WORDS = 1 << 20, 1 << 20

UNITS = frozenset("""
% percent kg g mg kilogram kilograms gram grams km m cm mm kilometer kilometers kilometre kilometres meter meters metre metres
centimeter centimeters mile miles mi ft foot feet inch inches yard yards lb lbs pound pounds oz ounce ounces ton tons l ml liter
liters litre litres gallon gallons second seconds sec minute minutes min hour hours h day days week weeks month months year years
dollar dollars usd cent cents euro euros eur degree degrees mph kmh watt watts volt volts
""".split())
NUMBER_WORDS = frozenset("""
zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen
twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion
""".split())
LITERAL, NUMBER, UNIT, NAME, NOTHING = range(5)


class Templates:
    """Texts to template windows, many texts at once.

    ``ordinary``: words that are no names where they open a sentence. ``short``: lesser widths that are cut besides;
    None cuts forms of fewer words than ``width`` as a whole.
    """

    def __init__(self, width: int = WIDTH, min_literals: int = MIN_LITERALS, ordinary: frozenset[str] = frozenset(), short: tuple[int, ...] | None = ()):
        from xxhash import xxh64_intdigest

        self.ordinary, self.short = ordinary, short
        self.width, self.min_literals, self.digest = width, min_literals, xxh64_intdigest
        self.glued = re.compile(r"(?<=\d)(?=[^\W\d_])|(?<=\d)(?=%)")
        self.outer = re.compile(r"^[\W_]+|[\W_]+$")
        self.number = re.compile(r"^\d[\d.,:/]*$")
        self.digit = re.compile(r"\d")
        self.typed = np.array([0, *(self.digest(f"\0{k}") for k in range(1, 5))], np.uint64)
        self.forget()

    def forget(self) -> None:
        self.place: dict[str, int] = {}
        self.hash: list[int] = []
        self.kind: list[int] = []
        self.ends: list[bool] = []
        self.capital: list[bool] = []
        self.opener: list[bool] = []
        self.arrays = [np.empty(0, kind) for kind in (np.uint64, np.int8, bool, bool, bool)]

    def facts(self) -> list[np.ndarray]:
        """hash, kind, ends, capital, opener of all known words; only new ones are converted."""
        done = self.arrays[0].size
        if done < len(self.hash):
            lists = (self.hash, self.kind, self.ends, self.capital, self.opener)
            self.arrays = [np.concatenate((a, np.array(x[done:], a.dtype))) for a, x in zip(self.arrays, lists)]
        return self.arrays

    def learn(self, word: str) -> int:
        core = word if word == "%" else self.outer.sub("", word)
        low = core.lower()
        kind = NOTHING if not core else NUMBER if self.number.match(core) or low in NUMBER_WORDS else UNIT if low in UNITS else LITERAL
        i = self.place[word] = len(self.hash)
        self.hash.append(self.digest(low))
        self.kind.append(kind)
        self.ends.append(word.rstrip("\"')]}»”")[-1:] in (".", "!", "?", ":", ";"))
        self.capital.append(core[:1].isupper() and core != core.upper())
        self.opener.append(self.capital[-1] and low not in self.ordinary)
        return i

    def digits(self, text: str) -> bool:
        return any(d in text for d in "0123456789") if text.isascii() else self.digit.search(text) is not None

    def windows(self, texts: list[str], bits: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
        """text number, position, hash, slot kinds (window x width), slot values, words, and whether it starts inside a name.

        With a bitmap only the windows whose hash it knows: their kinds and slots alone are gathered.
        """
        if len(self.hash) > KNOWN_WORDS:
            self.forget()
        ids, sizes = [], []
        for text in texts:
            words = (self.glued.sub(" ", text) if self.digits(text) else text).split()
            found = np.fromiter(map(self.place.get, words, repeat(-1)), np.int64, len(words))
            for i in np.flatnonzero(found < 0).tolist():
                found[i] = self.place[words[i]] if words[i] in self.place else self.learn(words[i])
            ids.append(found)
            sizes.append(len(found))
        ids, doc = np.concatenate(ids) if ids else np.empty(0, np.int64), np.repeat(np.arange(len(sizes)), sizes)
        value, kind, ends, capital, opener = (x[ids] for x in self.facts())
        first = np.concatenate(([True], doc[1:] != doc[:-1])) if ids.size else np.empty(0, bool)
        opens = first | np.concatenate(([True], ends[:-1]))[: ids.size]
        opener = (kind == LITERAL) & opener & opens
        kind = np.where((kind == LITERAL) & capital & ~opens, NAME, kind)
        keep = kind != NOTHING
        value, kind, doc, opener, opens = value[keep], kind[keep], doc[keep], opener[keep], opens[keep]
        first = np.searchsorted(doc, np.arange(len(sizes)))
        same = np.concatenate(([False], doc[1:] == doc[:-1]))[: doc.size]
        before = np.concatenate(([NOTHING], kind[:-1]))[: doc.size]
        kind = np.where((kind == UNIT) & ~(same & (before == NUMBER)), LITERAL, kind)
        named = self.join_names(value, kind, same)
        opened = self.join_names(value, np.where(opener, NAME, kind), same & ~opens)
        forms = [(value, np.where(kind == NAME, LITERAL, kind), np.arange(doc.size), None),
                 (*named[:3], kind[named[2]] == NAME), (*opened[:3], opener[opened[2]])]
        parts = [self.cut(v, k, doc[at], at, wanted, w, bits) for v, k, at, wanted in forms for w in (self.width, *(range(1, self.width) if self.short is None else self.short))]
        doc, at, h, kinds, slots, size = (np.concatenate(x) for x in zip(*parts))
        return doc, at - first[doc], h, kinds, slots, size, opened[3][at]

    def join_names(self, value: np.ndarray, kind: np.ndarray, same: np.ndarray) -> tuple[np.ndarray, ...]:
        """Neighbouring names as one: values, kinds, first places, and which words go on a name."""
        goes_on = same & (kind == NAME) & np.concatenate(([False], kind[:-1] == NAME))[: kind.size]
        starts = np.flatnonzero(~goes_on)
        place = np.arange(kind.size) - np.repeat(starts, np.diff(np.concatenate((starts, [kind.size]))))
        with np.errstate(over="ignore"):
            value = np.add.reduceat(value * (2 * place.astype(np.uint64) + np.uint64(1)), starts) if starts.size else value
        return value, kind[starts], starts, goes_on

    def cut(self, value: np.ndarray, kind: np.ndarray, doc: np.ndarray, origin: np.ndarray, wanted: np.ndarray | None, w: int,
            bits: np.ndarray | None) -> tuple[np.ndarray, ...]:
        """Windows of w words, with a wanted one among them and known to the bitmap; arrays of words are filled up to ``width``."""
        n = value.size
        whole = np.flatnonzero(doc[: max(n - w + 1, 0)] == doc[w - 1 :])
        if self.short is None and w < self.width:
            edge = np.concatenate(([True], doc[1:] != doc[:-1], [True])) if n else np.ones(1, bool)
            whole = whole[edge[whole] & edge[whole + w]]
        if wanted is not None:
            known = np.concatenate(([0], np.cumsum(wanted)))
            whole = whole[known[whole + w] > known[whole]]
        template = np.where(kind == LITERAL, value, self.typed[kind])
        literals = np.concatenate(([0], np.cumsum(kind == LITERAL)))
        few = literals[whole + w] - literals[whole] < self.min_literals
        h = np.where(few, self.roll(value, whole, w) ^ np.uint64(0x9E3779B97F4A7C15), self.roll(template, whole, w))
        if bits is not None and h.size:
            i = h % np.uint64(bits.size * 8)
            known = (bits[i >> np.uint64(3)] >> (i & np.uint64(7)).astype(np.uint8)) & 1 == 1
            whole, h = whole[known], h[known]
        at = whole[:, None] + np.arange(w)
        kinds, slots = np.full((whole.size, self.width), LITERAL, np.int8), np.zeros((whole.size, self.width), np.int64)
        kinds[:, :w], slots[:, :w] = kind[at], value[at].view(np.int64)
        return doc[whole], origin[whole], h.view(np.int64), kinds, slots, np.full(whole.size, w, np.int8)

    def roll(self, x: np.ndarray, at: np.ndarray, w: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            h = np.zeros(at.size, np.uint64)
            for k in range(w):
                h = (h ^ x[at + k]) * np.uint64(0xD6E8FEB86659FD93)
                h ^= h >> np.uint64(32)
        return h


def _rows(batch: pa.RecordBatch) -> Iterator[list[tuple]]:
    """(id, text hash, text) of a batch, some millions of characters at a time."""
    held, size = [], 0
    for row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
        text = row[2].as_py()
        if text:
            held.append((row[0], row[1], text))
            size += len(text)
            if size >= PIECE:
                yield held
                held, size = [], 0
    if held:
        yield held


def _key_type(df: DataFrame, key: str) -> str:
    return df.select(key).schema[0].dataType.simpleString()


def ordinary_words(docs: DataFrame, benchmark: DataFrame, text: str = "text", share: float = ORDINARY, rate: float = ORDINARY_RATE) -> frozenset[str]:
    """Words that open sentences of the benchmark with a capital and are often written in lower case, by texts that have capitals."""

    def openers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        outer, ended, found = re.compile(r"^[\W_]+|[\W_]+$"), True, set()
        for batch in batches:
            for t in batch.column(0):
                ended = True
                for word in (t.as_py() or "").split():
                    core = outer.sub("", word)
                    if ended and core[:1].isupper():
                        found.add(core.lower())
                    ended = word.rstrip("\"')]}»”")[-1:] in (".", "!", "?", ":", ";")
        yield pa.record_batch({"word": pa.array(sorted(found), pa.string())})

    asked = benchmark.select("text").mapInArrow(openers, "word string").distinct()
    forms = {f: r.word for r in asked.toLocalIterator() for f in (r.word, r.word.capitalize())}  # the benchmark's openers only
    sent = docs.sparkSession.sparkContext.broadcast(forms)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forms, seen, n = sent.value, Counter(), 0
        for batch in batches:
            for t in batch.column(0):
                t = t.as_py()
                if t and t != t.lower():
                    words = t.split()
                    n += len(words)
                    seen.update(filter(forms.__contains__, words))
        low, high = ([m * ((f == forms[f]) == is_low) for f, m in seen.items()] for is_low in (True, False))
        yield pa.record_batch([pa.array([None, *(forms[f] for f in seen)], pa.string()), pa.array([n, *low], pa.int64()), pa.array([0, *high], pa.int64())], names=["word", "low", "high"])

    texts = docs.select(F.col(text).alias("text")).union(benchmark.select("text"))
    counted = texts.mapInArrow(count, "word string, low long, high long").groupBy("word").agg(F.sum("low").alias("low"), F.sum("high").alias("high"))
    found = list(counted.toLocalIterator())  # the benchmark's openers, and the number of words under None
    least = max([1, *(rate * r.low for r in found if r.word is None)])
    return frozenset(r.word for r in found if r.word is not None and r.low >= max(least, share * r.high))


def template_windows(df: DataFrame, key: str, text: str, width: int, bitmap=None, ordinary: frozenset[str] = frozenset(), short: tuple[int, ...] | None = None) -> DataFrame:
    """key, __text, pos, h, kinds, slots, wide, inside (a name) per window; with a bitmap only the windows it knows."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        templates = Templates(width, ordinary=ordinary, short=short)
        bits = np.frombuffer(bitmap.value, np.uint8) if bitmap is not None else None
        for batch in batches:
            for rows in _rows(batch):
                doc, pos, h, kinds, slots, wide, inside = templates.windows([r[2] for r in rows], bits)
                if not h.size:
                    continue
                offsets = np.arange(0, h.size * width + 1, width, dtype=np.int32)
                yield pa.RecordBatch.from_arrays([
                    pa.array([rows[i][0] for i in doc], batch.column(0).type), pa.array([rows[i][1] for i in doc], pa.int64()),
                    pa.array(pos, pa.int64()), pa.array(h, pa.int64()),
                    pa.ListArray.from_arrays(offsets, kinds.ravel()), pa.ListArray.from_arrays(offsets, slots.ravel()),
                    pa.array(wide), pa.array(inside),
                ], names=[key, "__text", "pos", "h", "kinds", "slots", "wide", "inside"])

    schema = f"`{key}` {_key_type(df, key)}, __text long, pos long, h long, kinds array<tinyint>, slots array<long>, wide tinyint, inside boolean"
    return df.select(key, text_hash(text).alias("__text"), text).mapInArrow(cut, schema)


def hash_bitmap(hashes: DataFrame, bits: int = BITMAP_BITS) -> bytes:
    """Bitmap of a long column; every task sends one of fixed size."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(bits, bool)
        for batch in batches:
            seen[batch.column(0).to_numpy().view(np.uint64) % np.uint64(bits)] = True
        yield pa.record_batch({"map": [np.packbits(seen, bitorder="little").tobytes()]})

    whole = np.zeros(bits // 8, np.uint8)
    for row in hashes.mapInArrow(mark, "map binary").toLocalIterator():
        whole |= np.frombuffer(bytes(row.map), np.uint8)
    return whole.tobytes()


def _named_items(benchmark: DataFrame, key: str, text: str, width: int, ordinary: frozenset[str] = frozenset()) -> tuple[DataFrame, DataFrame]:
    """Windows of all items, with ``shape`` (the template) and ``filled`` (the template with its slots' values) per item."""
    found = template_windows(benchmark, key, text, width, ordinary=ordinary).withColumnRenamed(key, "item_id").filter("NOT inside").drop("inside", "kinds")
    found = cut_lineage(found.dropDuplicates(["item_id", "__text", "pos", "h"]))
    shapes = found.groupBy("item_id", "__text").agg(
        F.xxhash64(F.array_sort(F.collect_set(F.struct("pos", "h")))).alias("shape"),
        F.xxhash64(F.array_sort(F.collect_set(F.struct("pos", "h", "slots")))).alias("filled"))
    return found, cut_lineage(shapes)


def _first(shapes: DataFrame, *by: str) -> DataFrame:
    """The item of smallest id of each group."""
    return shapes.groupBy(*by).agg(F.min(F.struct(F.col("item_id").isNull().alias("n"), "item_id", "__text")).alias("k")).select(*by, "k.item_id", "k.__text")


def item_names(benchmark: DataFrame, key: str = "item_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """member, item_id: the id under which ``contaminated`` names each item; they differ for items of equal words and slots only."""
    shapes = _named_items(benchmark, key, text, width)[1]
    first = _first(shapes, "filled").drop("__text")
    return shapes.select(F.col("item_id").alias("member"), "filled").join(first, "filled").select("member", "item_id").distinct()


def benchmark_items(benchmark: DataFrame, key: str = "item_id", text: str = "text", width: int = WIDTH, coverage: float = COVERAGE,
                    ordinary: frozenset[str] = frozenset()) -> tuple[DataFrame, DataFrame]:
    """Templates: shape, size (places of windows), pos, h, wide, rare (looks for candidates). Items: shape, item_id, item_text, pos, h, slots."""
    found, shapes = _named_items(benchmark, key, text, width, ordinary)
    own = null_safe(found, _first(shapes, "shape"), ["item_id", "__text"], "inner").select("shape", "pos", "h", "wide")
    common = own.groupBy("h").agg(F.count_distinct("shape").alias("items"))
    own = own.join(common, "h")
    places = own.groupBy("shape", "pos").agg(F.max("items").alias("items"))
    places = places.withColumn("size", F.count(F.lit(1)).over(Window.partitionBy("shape")))
    rank = F.row_number().over(Window.partitionBy("shape").orderBy("items", "pos"))
    need = F.ceil(F.col("size") * coverage - 1e-9)
    templates = own.drop("items").join(places.withColumn("rare", rank <= F.col("size") - need + 1).drop("items"), ["shape", "pos"])
    items = null_safe(found, _first(shapes, "shape", "filled"), ["item_id", "__text"], "inner")
    return templates, items.select("shape", "item_id", F.col("__text").alias("item_text"), "pos", "h", "slots")


def contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id",
                 width: int = WIDTH, coverage: float = COVERAGE, consistency: float = CONSISTENCY) -> DataFrame:
    """key, __text, item_id, coverage, consistency, kind (``exact`` or ``reparameterised``) per document and item."""
    spark = docs.sparkSession
    ordinary = ordinary_words(docs, benchmark, text)
    templates, items = map(cut_lineage, benchmark_items(benchmark, item, "text", width, coverage, ordinary))
    short = tuple(r.wide for r in templates.select("wide").distinct().toLocalIterator() if r.wide < width)
    bitmap = spark.sparkContext.broadcast(hash_bitmap(templates.select("h")))
    doc = [key, "__text"]
    windows = cut_lineage(template_windows(docs, key, text, width, bitmap, ordinary, short).drop("wide", "inside"))
    pairs = windows.select(*doc, "h").distinct().join(templates.filter("rare").select("h", "shape", "size").distinct(), "h")
    pairs = pairs.select(*doc, "shape", "size").distinct()
    # All windows of each pair: the template's, matched with the document's by id and hash.
    asked = pairs.join(templates.select("shape", "h", F.col("pos").alias("item_pos")), "shape")
    met = cut_lineage(null_safe(asked, windows.select(*doc, "h", "pos", "kinds", "slots"), [*doc, "h"], "inner"))
    covered = met.groupBy(*doc, "shape", "size").agg(F.count_distinct("item_pos").alias("n")).filter(F.col("n") >= F.ceil(F.col("size") * coverage - 1e-9))
    met = null_safe(met.drop("size"), covered, [*doc, "shape"], "inner")
    # From here on each item of a template by its own slots.
    theirs = items.select("shape", "item_id", "item_text", "h", F.col("pos").alias("item_pos"), F.col("slots").alias("item_slots"))
    met = cut_lineage(met.join(theirs, ["shape", "h", "item_pos"]).withColumn("shift", F.col("pos") - F.col("item_pos")))
    pair = [*doc, "item_id", "item_text"]
    # A place may be met at several others: the one on the shift with the most consistent slots counts, plain words first.
    slots = F.expr("filter(transform(kinds, (k, i) -> struct(k AS kind, item_slots[i] AS own, slots[i] AS other)), s -> s.kind != 0)")
    support = met.groupBy(*pair, "shift").agg(F.count_distinct("item_pos").alias("support"), F.count_if(F.col("slots") == F.col("item_slots")).alias("same"))
    kept = _agreement(met.select(*pair, "shift", F.explode(slots).alias("s")), [*pair, "shift"]).drop("equal")
    support = null_safe(support, kept, [*pair, "shift"], "left").withColumn("fit", F.col("support") * F.coalesce("kept", F.lit(1.0))).drop("kept")
    met = null_safe(met, support, [*pair, "shift"], "inner")
    best = F.row_number().over(Window.partitionBy(*pair, "item_pos").orderBy(F.desc("fit"), F.desc("same"), "shift", "pos", F.array_contains("kinds", NAME)))
    chosen = met.withColumn("best", best).filter("best = 1")
    values = _agreement(chosen.select(*pair, F.explode(slots).alias("s")), pair)
    found = null_safe(chosen.select(*pair, "n", "size").distinct(), values, pair, "left")
    found = found.withColumn("consistency", F.coalesce("kept", F.lit(1.0))).filter(F.col("consistency") >= consistency)
    kind = F.when(F.coalesce("equal", F.lit(1.0)) == 1.0, F.lit("exact")).otherwise(F.lit("reparameterised"))
    return found.select(*doc, "item_id", (F.col("n") / F.col("size")).alias("coverage"), "consistency", kind.alias("kind"))


def _agreement(slots: DataFrame, by: list[str]) -> DataFrame:
    """by, kept (share of slots that turn into their value's most frequent counterpart), equal (share that keep their value)."""
    values = slots.groupBy(*by, "s.kind", "s.own", "s.other").agg(F.count(F.lit(1)).alias("m"))
    values = values.groupBy(*by, "kind", "own").agg(
        F.max("m").alias("most"), F.sum("m").alias("all"), F.sum(F.when(F.col("own") == F.col("other"), F.col("m")).otherwise(0)).alias("equal"))
    return values.groupBy(*by).agg((F.sum("most") / F.sum("all")).alias("kept"), (F.sum("equal") / F.sum("all")).alias("equal"))


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the documents that hold a benchmark item."""
    found = contaminated(docs, benchmark, key, text).select(key, "__text").distinct()
    return null_safe(docs.withColumn("__text", text_hash(text)), found, [key, "__text"], "left_anti").drop("__text")
