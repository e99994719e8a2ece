"""Language identification with error-correcting output codes.

Each language has a codeword; one binary classifier per bit tells from character n-grams which
half of the languages a text belongs to. A classifier is linear: its weight for an n-gram is the
logarithm of the ratio of the n-gram's mean relative frequency in the languages with bit 1 and
with bit 0, counted over all training texts (languages count alike, whatever their size). The
mean weight over a text is its margin. Offset and scale of each bit's margin and its reliability
are fitted on a bounded sample per language. Decoding adds every bit's logistic loss, weighted by
reliability, and takes the codeword with the least; the score is that codeword's share of
exp(-loss). A text is ambiguous when the second codeword comes close.

Texts are lower-cased; letters count, all else is a boundary. Null text, or text without a
letter, is ``und`` with score 0, as is every text when there is nothing to learn from. With a
single language learned, every text with letters has that language and score 1. Ties go to the
language that sorts first. Rows count as often as they occur. Very long texts are read whole, in
pieces.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.frames import cut_lineage
from .common import PIECES, add_pieces, null_safe, pieces_batch, pieces_of, text_hash

UNKNOWN = "und"
#: Hash buckets of the n-grams (1, 2 and 3 characters).
BUCKETS = 1 << 15
#: Texts per language that offset, scale and reliability of the bits are fitted on.
CALIBRATION_ROWS = 500
#: Up to this many languages every split into two halves is a bit; beyond, bits are drawn.
EXHAUSTIVE = 5
#: Code points handled at once.
PIECE = 1 << 20
#: Below this share of exp(-loss) a prediction is ambiguous.
AMBIGUOUS = 0.5


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """One row of bits per language: all distinct splits for few languages, balanced random ones for many."""
    if n <= 1:
        return np.zeros((n, 0), np.int8)
    if n <= EXHAUSTIVE:
        splits = [s for k in range(n - 1) for s in combinations(range(1, n), k)]
        return np.array([[1 if i == 0 or i in s else 0 for s in splits] for i in range(n)], np.int8)
    rng, bits = np.random.default_rng(seed), 10 * int(np.ceil(np.log2(n)))
    best, distance = None, -1
    for _ in range(50):
        half = np.arange(n) % 2
        code = np.stack([rng.permutation(half) for _ in range(bits)], axis=1).astype(np.int8)
        apart = min((code[i] != code[j]).sum() for i, j in combinations(range(n), 2)) if n <= 300 else 1
        if apart > distance:
            best, distance = code, apart
    return best


def _letters() -> np.ndarray:
    """For every code point: itself if it is a letter, else 0."""
    table = np.arange(0x110000, dtype=np.uint32)
    keep = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return np.where(keep, table, 0).astype(np.uint32)


class Grams:
    """Hashed n-grams of whole batches of texts."""

    def __init__(self, buckets: int = BUCKETS):
        self.letters, self.mask = _letters(), np.uint32(buckets - 1)

    def codes(self, text: str) -> np.ndarray:
        """Letters of a text with single boundaries (0) between and around the words; empty without letters."""
        raw = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
        x = self.letters[raw]
        if not x.any():
            return x[:0]
        keep = (x != 0) | np.concatenate(([True], x[:-1] != 0))
        x = x[keep]
        return np.concatenate(([0] if x[0] else [], x, [0] if x[-1] else [])).astype(np.uint32)

    def hashes(self, x: np.ndarray) -> Iterator[np.ndarray]:
        """The n-grams that end at each place of a piece, for n = 1, 2, 3."""
        one = x * np.uint32(2654435761)
        yield self.mix(one + np.uint32(1))
        two = one[1:] + x[:-1] * np.uint32(2246822519)
        yield self.mix(two + np.uint32(2))
        yield self.mix(two[1:] + x[:-2] * np.uint32(3266489917) + np.uint32(3))

    def mix(self, h: np.ndarray) -> np.ndarray:
        h = (h ^ (h >> np.uint32(15))) * np.uint32(2246822507)
        return (h ^ (h >> np.uint32(13))) & self.mask

    def pieces(self, text: str | None) -> Iterator[np.ndarray]:
        for i in range(0, len(text or ""), PIECE):
            x = self.codes(text[i : i + PIECE])
            if x.size:
                yield x


@dataclass
class Model:
    """Everything a prediction needs; its size depends on languages and buckets only."""

    languages: list[str]
    code: np.ndarray  # language x bit
    weight: np.ndarray  # bucket x bit
    offset: np.ndarray
    scale: np.ndarray
    reliability: np.ndarray
    buckets: int = BUCKETS

    def margins(self, grams: Grams, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """text x bit mean weights, and the number of n-grams."""
        total, count = np.zeros((len(texts), self.weight.shape[1])), np.zeros(len(texts))
        held: list[tuple[int, np.ndarray]] = []
        size = 0

        def flush():
            # One n-gram more or less across the seam of two texts is kept out: seams are boundaries of length 2.
            x = np.concatenate([part for _, part in held])
            ends = np.cumsum([part.size for _, part in held])
            starts = np.concatenate(([0], ends[:-1]))
            rows = np.array([i for i, _ in held])
            for n, h in enumerate(grams.hashes(x), 1):
                w = self.weight[h]
                sums = np.add.reduceat(np.vstack((w, np.zeros((n, w.shape[1]), w.dtype))), starts, axis=0)
                for k in range(1, n):  # n-grams that reach into the next text
                    over = ends[:-1] - k
                    sums[:-1] -= w[np.minimum(over, len(w) - 1)]
                np.add.at(total, rows, sums)
                np.add.at(count, rows, np.maximum(ends - starts - n + 1, 0))

        for i, text in enumerate(texts):
            for x in grams.pieces(text):
                held.append((i, x))
                size += x.size
                if size >= PIECE:
                    flush()
                    held, size = [], 0
        if held:
            flush()
        return total / np.maximum(count, 1)[:, None], count

    def decode(self, margin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Best language, its share of exp(-loss), and the second best's share."""
        z = (margin - self.offset) * self.scale
        sign = 2.0 * self.code - 1
        loss = np.stack([(np.logaddexp(0, -z * s) * self.reliability).sum(axis=1) for s in sign], axis=1)
        share = np.exp(loss.min(axis=1, keepdims=True) - loss)
        share /= share.sum(axis=1, keepdims=True)
        best = loss.argmin(axis=1)
        ordered = np.sort(share, axis=1)
        second = ordered[:, -2] if len(self.languages) > 1 else np.zeros(len(margin))
        return best, share[np.arange(len(best)), best], second


def _counts(training: DataFrame, languages: list[str], buckets: int) -> np.ndarray:
    """language x bucket counts over all training texts; tasks send dense vectors, summed by language."""
    place = {name: i for i, name in enumerate(languages)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, sums = Grams(buckets), np.zeros((len(place), buckets), np.int64)
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for x in grams.pieces(text):
                    for h in grams.hashes(x):
                        sums[place[lang]] += np.bincount(h, minlength=buckets)
        found = [p for i in range(len(place)) for p in pieces_of(i, sums[i], 1024)]
        if found:
            yield pieces_batch(found)

    out = np.zeros((len(languages), buckets), np.int64)
    for row in add_pieces(training.select("lang", "text").mapInArrow(count, PIECES)).toLocalIterator():
        v = np.frombuffer(bytes(row.sums), np.int64)
        out[row.which, row.first : row.first + v.size] += v
    return out


def train(training: DataFrame, key: str = "doc_id", buckets: int = BUCKETS, calibration_rows: int = CALIBRATION_ROWS) -> Model:
    """Learn from the rows of ``training`` (key, text, lang) whose lang is not null.

    Counts cover all rows. The calibration reads ``calibration_rows`` texts per language, those
    with the smallest hash of their key.
    """
    known = training.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).select(key, "text", "lang")
    languages = sorted(r.lang for r in known.select("lang").distinct().toLocalIterator())
    code = codewords(len(languages))
    bits = code.shape[1]
    model = Model(languages, code, np.zeros((buckets, bits), np.float32), np.zeros(bits), np.ones(bits), np.ones(bits), buckets)
    if bits == 0:
        return model
    counts = _counts(known, languages, buckets).astype(np.float64) + 0.5
    share = counts / counts.sum(axis=1, keepdims=True)
    for b in range(bits):
        one = code[:, b] == 1
        model.weight[:, b] = np.log(share[one].mean(axis=0) / share[~one].mean(axis=0))
    _calibrate(model, known, key, calibration_rows)
    return model


def _calibrate(model: Model, known: DataFrame, key: str, rows: int) -> None:
    # Ranks travel without the texts; these are fetched for the few keys chosen.
    first = Window.partitionBy("lang").orderBy(F.xxhash64(key), key, "__text")
    ranked = known.select(key, "lang", text_hash().alias("__text")).withColumn("__n", F.row_number().over(first))
    keys = cut_lineage(ranked.filter(F.col("__n") <= rows).drop("__n"))  # at most ``rows`` per language
    chosen = null_safe(known.withColumn("__text", text_hash()), F.broadcast(keys), [key, "lang", "__text"], "left_semi")
    place = {name: i for i, name in enumerate(model.languages)}

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Grams(model.buckets)
        for batch in batches:
            margin, count = model.margins(grams, batch.column(1).to_pylist())
            langs = [place[x] for x in batch.column(0).to_pylist()]
            keep = count > 0
            yield pa.record_batch({"language": np.array(langs, np.int64)[keep], "margin": list(margin[keep])})

    found = list(chosen.select("lang", "text").mapInArrow(measure, "language long, margin array<double>").toLocalIterator())
    if not found:
        return
    found.sort(key=lambda r: (r.language, r.margin))  # sums don't depend on the order of tasks
    lang, margin = np.array([r.language for r in found]), np.array([r.margin for r in found])
    for b in range(model.code.shape[1]):
        one = model.code[lang, b] == 1
        if not one.any() or one.all():
            continue
        up, down = margin[one, b], margin[~one, b]
        spread = np.sqrt((up.var() + down.var()) / 2) + 1e-6
        apart = max((up.mean() - down.mean()) / spread, 1e-3)
        model.offset[b] = (up.mean() * (down.std() + 1e-6) + down.mean() * (up.std() + 1e-6)) / (up.std() + down.std() + 2e-6)
        model.scale[b] = min(apart, 20.0) / spread  # the log odds of two normal margins of that spread
        wrong = (np.mean(up < model.offset[b]) + np.mean(down >= model.offset[b])) / 2
        model.reliability[b] = max(1 - 2 * wrong, 0.01)


def predict(model: Model, text: Column) -> Column:
    """Column of structs: lang_pred, score, ambiguous."""

    @F.pandas_udf("lang_pred string, score double, ambiguous boolean")
    def compute(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        grams, names = Grams(model.buckets), np.array([*model.languages, UNKNOWN], object)
        for texts in batches:
            margin, count = model.margins(grams, [t if isinstance(t, str) else None for t in texts])
            if model.languages:
                best, score, second = model.decode(margin)
                best, score = np.where(count > 0, best, len(model.languages)), np.where(count > 0, score, 0.0)
            else:
                best, score, second = np.zeros(len(texts), int), np.zeros(len(texts)), np.zeros(len(texts))
            yield pd.DataFrame({"lang_pred": names[best], "score": score, "ambiguous": (score < AMBIGUOUS) & (score > 0)})

    return compute(text)


def identify(docs: DataFrame, training: DataFrame, key: str = "doc_id", column: str = "__language", text: str = "text") -> DataFrame:
    """``docs`` with the prediction as a struct column. The model is a few MB and travels with the tasks."""
    return docs.withColumn(column, predict(train(training, key), F.col(text)))
