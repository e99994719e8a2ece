"""Best-fit packing of tokenised documents after Martello-Toth dominance reduction.

Documents become token ids and one end id, and are cut into pieces of the capacity only where they are
longer. Which pieces share a sequence depends on their lengths alone, so the plan is made from the histogram
of lengths, whose size is bounded by the capacity whatever the number of documents:

* Reduction. The longest pieces come first. A set of at most two further pieces is fixed with a piece for good
  if it dominates every other way to fill its sequence: an exact fit; the largest piece that fits where no two
  fit, or where it is at least as long as any two that fit; a pair whose pieces are at least as long
  as those of any other pair. An optimal packing of all pieces exists that holds these sequences. Equal
  sequences are fixed as many times as they repeat, until nothing more can be fixed.
* Best fit. The remaining lengths, longest first, go to the sequences with the least sufficient room.

A step of the plan says: pieces of this length with these numbers go to these consecutive sequences, so many
to each, from this offset on. A sequence's room at least halves with every step it takes part in, so there are
at most about 12 steps for each of at most four groups a length: some megabytes, sent to the tasks. Pieces are numbered
within their length through salted groups of about ``GROUP`` pieces, so no task sees a whole frequent length.

Null text is an empty text, which is the end id alone. Repeated rows are packed each time; null ids take part.
An empty table gives no pieces. Only key and text are read. Texts are encoded word by word, as the
tokenizer never joins across ASCII blanks, so very long texts are whole and need little memory; a single word is encoded at once.
"""

from __future__ import annotations

import re
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.frames import cut_lineage

CAPACITY, END_ID, VOCABULARY = 4096, 1, "word_bpe_49k.json"
#: Pieces numbered by one task at once.
GROUP = 256
#: Between a small letter and a punctuation mark (no apostrophe: contractions are units).
MARK = re.compile(rb"(?<=[a-z])(?=[.,;:!?])")
#: Words encoded at once, known words kept by a task, and bytes of texts handled at once.
ENCODE, KNOWN_WORDS, PIECE = 1 << 14, 1 << 20, 1 << 21


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Words:
    """Token ids of words, kept by a worker from task to task while there are not too many.

    Plain words (small letters of Latin scripts) are one unit for the tokenizer's pattern and unchanged by its
    normalisation, so the model alone is asked; all others go through the whole tokenizer.
    """

    def __init__(self, vocabulary: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(vocabulary)
        self.model = self.tokenizer.model
        # The byte alphabet of byte-level BPE: printable bytes stand for themselves, all others come after 255.
        printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
        self.alphabet = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in printable)}
        self.forget()

    def forget(self) -> None:
        self.place: dict[bytes, int] = {}
        self.ids, self.used = np.empty(1 << 16, np.uint32), 0
        self.start, self.count = np.empty(1 << 14, np.int64), np.empty(1 << 14, np.int64)

    def tokens(self, words: list[bytes]) -> list[list[int]]:
        out: list = [None] * len(words)
        others = []
        for i, word in enumerate(words):
            text = word.decode()
            if text.isalpha() and (text.isascii() or max(text) < "\u0250") and text == text.lower():
                out[i] = [t.id for t in self.model.tokenize(word.decode("latin-1").translate(self.alphabet))]
            else:
                others.append((i, text))
        for (i, _), found in zip(others, self.tokenizer.encode_batch_fast([t for _, t in others], add_special_tokens=False)):
            out[i] = found.ids
        return out

    def learn(self, words: list[bytes]) -> None:
        for i in range(0, len(words), ENCODE):
            some = words[i : i + ENCODE]
            found = self.tokens(some)
            count, n = np.fromiter(map(len, found), np.int64, len(found)), len(self.place)
            ids = np.fromiter(chain.from_iterable(found), np.uint32, int(count.sum()))
            while self.used + ids.size > self.ids.size:
                self.ids = np.concatenate((self.ids, np.empty_like(self.ids)))
            while n + len(some) > self.start.size:
                self.start, self.count = (np.concatenate((x, np.empty_like(x))) for x in (self.start, self.count))
            self.ids[self.used : self.used + ids.size] = ids
            self.start[n : n + len(some)], self.count[n : n + len(some)] = self.used + np.cumsum(count) - count, count
            self.place.update(zip(some, range(n, n + len(some))))
            self.used += ids.size

    def encode(self, words: list[bytes]) -> np.ndarray:
        if len(self.place) > KNOWN_WORDS:
            self.forget()
        found = list(map(self.place.get, words))
        if None in found:
            self.learn(list(dict.fromkeys(w for w, at in zip(words, found) if at is None)))
            found = map(self.place.__getitem__, words)
        at = np.fromiter(found, np.int64, len(words))
        count = self.count[at]
        first = np.cumsum(count) - count
        return self.ids[np.repeat(self.start[at] - first, count) + np.arange(int(count.sum()))]


def kept_words(vocabulary: str) -> Words:
    """The worker's own; these functions travel by value, so it is kept with the tokenizer library."""
    import tokenizers

    kept = tokenizers.__dict__.setdefault("_kept_words", {})
    if hash(vocabulary) not in kept:
        kept[hash(vocabulary)] = Words(vocabulary)
    return kept[hash(vocabulary)]


def word_lists(text: bytes) -> Iterator[list[bytes]]:
    """Stretches of a text that can be encoded apart, some megabytes at a time.

    The tokenizer ignores blanks and case, and ends a unit between a letter and a punctuation mark, so
    marks are parted from words and capitals made small: there are fewer words to learn. Its special tokens alone need their case.
    """
    start = 0
    while start < len(text):
        end = min(len(text), start + PIECE)
        while end < len(text) and text[end] not in b" \t\n\r\x0b\x0c":
            end += 1
        part = text[start:end]
        yield (part if b"<|" in part else MARK.sub(b" ", part.lower())).split()
        start = end


def token_pieces(docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str | None = None, capacity: int = CAPACITY,
                 end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """key, piece, start, length, ids_crc32 and, if asked for, ids: the pieces of every document."""
    from zlib import crc32

    with open(vocabulary or vocabulary_path(), encoding="utf-8") as file:
        shared = docs.sparkSession.sparkContext.broadcast(file.read())  # one file of some megabytes
    names = [key, "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task per core
        words = kept_words(shared.value)
        for batch in batches:
            rows: list[list] = [[] for _ in names]
            held = 0
            for i, value in enumerate(batch.column(1)):
                raw = value.as_buffer() if value.is_valid else b""
                ids = np.concatenate([*map(words.encode, word_lists(bytes(raw))), np.array([end_id], np.uint32)])
                for piece, start in enumerate(range(0, ids.size, capacity)):
                    part = ids[start : start + capacity].astype("<u4")
                    for column, x in zip(rows, (i, piece, start, part.size, crc32(part.tobytes()), part)):
                        column.append(x)
                held += ids.size
                if held > PIECE:
                    yield record(batch, rows)
                    rows, held = [[] for _ in names], 0
            if rows[0]:
                yield record(batch, rows)

    def record(batch: pa.RecordBatch, rows: list[list]) -> pa.RecordBatch:
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows[0], pa.int64())), *map(pa.array, rows[1:], kinds)], names=names)

    kind = docs.select(key).schema[0].dataType.simpleString()
    schema = f"`{key}` {kind}, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    return docs.select(key, F.col(text).cast("binary").alias("text")).mapInArrow(cut, schema)


class Plan:
    """Steps that place all pieces of a histogram: length, first number, first sequence, pieces per sequence, offset."""

    def __init__(self, counts: np.ndarray, capacity: int = CAPACITY):
        self.capacity, self.left = capacity, np.zeros(capacity + 1, np.int64)
        self.left[: len(counts)] = counts
        self.numbered = np.zeros(capacity + 1, np.int64)
        self.steps: list[tuple[int, int, int, int, int]] = []
        self.sequences = 0
        self.reduce()
        self.reduced_sequences = self.sequences
        self.best_fit()

    def put(self, length: int, first: int, bins: int, each: int, offset: int) -> None:
        """``each`` pieces of this length to every one of consecutive sequences."""
        self.steps.append((length, int(self.numbered[length]), first, each, offset))
        self.numbered[length] += bins * each
        self.left[length] -= bins * each

    def fix(self, *lengths: int) -> None:
        """One sequence of these pieces, as many times as they last."""
        each = {x: lengths.count(x) for x in lengths}
        bins = int(min(self.left[x] // n for x, n in each.items()))
        offset = 0
        for x, n in each.items():
            self.put(x, self.sequences, bins, n, offset)
            offset += n * x
        self.sequences += bins

    def reduce(self) -> None:
        changed = True
        while changed:
            changed = False
            for length in np.flatnonzero(self.left)[::-1].tolist():
                while self.left[length] and (best := self.dominating(length)) is not None:
                    self.fix(length, *best)
                    changed = True

    def dominating(self, length: int) -> tuple[int, ...] | None:
        """Up to two pieces that dominate every other way to go on from a piece of this length, or None."""
        room = self.capacity - length
        self.left[length] -= 1  # the piece itself
        sizes = np.flatnonzero(self.left[: room + 1])
        copies = np.minimum(self.left[sizes], 3)
        self.left[length] += 1
        if not sizes.size:
            return ()
        top = int(sizes[-1])
        smallest = np.repeat(sizes[:3], copies[:3])[:3]
        if top == room or smallest[:2].sum() > room or smallest.size == 1:
            return (top,)
        if smallest.size == 3 and smallest.sum() <= room:
            return None  # three may fit
        # The best partner of each size, in a pair that fits: larger or equal, another piece if equal.
        at = np.searchsorted(sizes, room - sizes, side="right") - 1
        fits = (at > np.arange(sizes.size)) | ((at == np.arange(sizes.size)) & (copies > 1))
        small, large = sizes[fits], sizes[at[fits]]
        if not small.size or top >= (small + large).max():
            return (top,)
        # The largest piece with the largest that fits beside it, if no other pair has a larger second piece or that pair fits in its place.
        second = [int(s) for s, c in zip(sizes, copies) if s <= room - top and (s != top or c > 1)]
        if second and not (over := small > second[-1]).any() or second and (small + large)[over].max() <= top:
            return top, second[-1]
        return None

    def best_fit(self) -> None:
        groups: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room -> (first sequence, sequences)
        rooms: list[int] = []  # those with groups, ascending

        def keep(room: int, first: int, bins: int) -> None:
            if not groups[room]:
                insort(rooms, room)
            groups[room].append((first, bins))

        for length in np.flatnonzero(self.left)[::-1].tolist():
            while n := int(self.left[length]):
                i = bisect_left(rooms, length)
                if i == len(rooms):  # new sequences for all that is left of this length
                    bins = -(-n // (self.capacity // length))
                    keep(self.capacity, self.sequences, bins)
                    self.sequences += bins
                room = rooms[i]
                first, bins = groups[room].pop()
                if not groups[room]:
                    del rooms[i]
                each, offset = room // length, self.capacity - room
                full = min(bins, n // each)
                if full:
                    self.put(length, first, full, each, offset)
                    keep(room - each * length, first, full)
                if full < bins and (some := int(self.left[length])):
                    self.put(length, first + full, 1, some, offset)
                    keep(room - some * length, first + full, 1)
                    full += 1
                if full < bins:
                    keep(room, first + full, bins - full)

    def table(self) -> np.ndarray:
        """Steps by length and first number."""
        return np.array(sorted(self.steps), np.int64).reshape(-1, 5)


def numbered(pieces: DataFrame, sizes: DataFrame, order: list[str]) -> DataFrame:
    """``pieces`` with ``__number``, from 0 within their length; ``sizes``: length, n (a row per length: bounded)."""
    salt = F.pmod(F.xxhash64(*order), F.ceil(F.col("n") / GROUP).cast("long"))
    salted = pieces.join(F.broadcast(sizes), "length").withColumn("__salt", salt).drop("n")
    groups = cut_lineage(salted.groupBy("length", "__salt").agg(F.count(F.lit(1)).alias("__n")))
    before = Window.partitionBy("length").orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.select("length", "__salt", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    inside = F.row_number().over(Window.partitionBy("length", "__salt").orderBy(*order))
    return salted.withColumn("__inside", inside).join(groups, ["length", "__salt"]).withColumn("__number", F.col("__before") + F.col("__inside") - 1).drop("__salt", "__inside", "__before")


def place(pieces: DataFrame, order: list[str], capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` with sequence_id and offset. ``pieces`` should be stored, as it is read more than once."""
    sizes = cut_lineage(pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")))
    counts = np.zeros(capacity + 1, np.int64)
    for row in sizes.toLocalIterator():  # a row per length at most
        counts[row.length] = row.n
    steps = pieces.sparkSession.sparkContext.broadcast(Plan(counts, capacity).table())

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        length, number, first, each, offset = steps.value.T
        spot = (length << 48) | number
        for batch in batches:
            own, n = batch.column("length").to_numpy(), batch.column("__number").to_numpy()
            at = np.searchsorted(spot, (own << 48) | n, side="right") - 1
            beyond = n - number[at]
            names = [c for c in batch.schema.names if c != "__number"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in names), pa.array(first[at] + beyond // each[at]), pa.array(offset[at] + beyond % each[at] * own)],
                names=[*names, "sequence_id", "offset"])

    ready = numbered(pieces, sizes, order)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ready.schema if f.name != "__number")
    return ready.mapInArrow(find, f"{schema}, sequence_id long, offset long")


def pack(docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str | None = None, capacity: int = CAPACITY,
         end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """key, piece, start, length, ids_crc32, (ids,) sequence_id, offset."""
    pieces = cut_lineage(token_pieces(docs, key, text, vocabulary, capacity, end_id, with_ids))
    return place(pieces, [key, "piece", "ids_crc32"], capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, length, ids: the packed sequences of ``pack(..., with_ids=True)``; each holds ``capacity`` ids at most."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("length"), F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))
