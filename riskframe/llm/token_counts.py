"""Token counts: an exact histogram of encoded lengths and what follows from it.

Each text is encoded once, whole; only (length, documents) pairs are shuffled. Every total,
quantile and truncated total for any context limit is a running sum over the histogram.

Null text counts as an empty text of length 0. Repeated rows count each time. An empty table
gives an empty histogram. Other columns are not read.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.frames import cut_lineage

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the word pattern that belongs to this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Lengths per bucket of the running sums.
BUCKET = 64


def load_encoding(vocabulary: bytes, pattern: str = PATTERN, special: tuple[str, ...] = ()):
    """Byte-level BPE; ``special`` strings are tokens of their own after the vocabulary.

    Built once per worker process: an encoding holds much memory, and a worker runs many tasks.
    These functions travel by value, so the encoding is kept with the library's own module.
    """
    import tiktoken

    built = tiktoken.__dict__.setdefault("_built_encodings", {})
    name = (hash(vocabulary), pattern, special)
    if name not in built:
        built[name] = _build_encoding(tiktoken, vocabulary, pattern, special)
    return built[name]


def _build_encoding(tiktoken, vocabulary: bytes, pattern: str, special: tuple[str, ...]):
    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in vocabulary.splitlines() if line)}
    marks = {mark: max(ranks.values()) + 1 + i for i, mark in enumerate(special)}
    return tiktoken.Encoding("corpus", pat_str=pattern, mergeable_ranks=ranks, special_tokens=marks)


#: White space as the word pattern knows it, and runs of it that are not left to the pattern.
BLANKS = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
LONG_BLANKS, LONG_TEXT = re.compile(f"[{BLANKS}]{{2000,}}"), 100_000


def encode_text(encoding, text: str) -> list[int]:
    """The tokens of a text of any form.

    The word pattern overflows its stack on very long runs of blanks. It makes one word of a run, less its
    last blank if a word follows; such runs are cut out and encoded as that word.
    """
    if len(text) < LONG_TEXT:
        return encoding.encode_ordinary(text)
    ids, start = [], 0
    for run in LONG_BLANKS.finditer(text):
        end = run.end() - (run.end() < len(text))
        ids += encoding.encode_ordinary(text[start : run.start()])
        ids += encoding._encode_single_piece(text[run.start() : end])
        start = end
    return ids + encoding.encode_ordinary(text[start:])


def read_vocabulary(df: DataFrame, path: str) -> bytes:
    """The vocabulary file's bytes (about 1 MB), read by Spark so that any store works."""
    found = df.sparkSession.read.format("binaryFile").load(path if "://" in path else f"file://{path}")
    return bytes(found.select("content").head()[0])


def encoded_length(df: DataFrame, text: str = "text", vocabulary: str = VOCABULARY):
    """Column function: tokens of a text."""
    shared = df.sparkSession.sparkContext.broadcast(read_vocabulary(df, vocabulary))

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoding = load_encoding(shared.value)
        for texts in batches:
            yield pd.Series([len(encode_text(encoding, t)) if t else 0 for t in texts], dtype="int64")

    return count(F.col(text))


def length_histogram(docs: DataFrame, text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """length, documents; stored, as several sums read it and texts are encoded once only."""
    lengths = docs.select(encoded_length(docs, text, vocabulary).alias("length"))
    return cut_lineage(lengths.groupBy("length").agg(F.count(F.lit(1)).alias("documents")))


def length_totals(histogram: DataFrame) -> DataFrame:
    """For every length L that occurs, as a context limit.

    documents and tokens of that length; documents_up_to, tokens_up_to; documents_over,
    tokens_over (suffix sums without L itself); truncated_tokens (each document cut at L);
    share_up_to (the quantile rank of L). Sums run within buckets of lengths and start from the
    sums of the buckets before, so no task holds the whole histogram.
    """
    h = histogram.withColumn("tokens", F.col("length") * F.col("documents"))
    h = h.withColumn("__bucket", F.floor(F.col("length") / BUCKET))
    sums = h.groupBy("__bucket").agg(F.sum("documents").alias("__d"), F.sum("tokens").alias("__t"))
    before = Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    sums = sums.select(
        "__bucket",
        F.coalesce(F.sum("__d").over(before), F.lit(0)).alias("__d0"),
        F.coalesce(F.sum("__t").over(before), F.lit(0)).alias("__t0"),
        F.sum("__d").over(every).alias("__dn"),
        F.sum("__t").over(every).alias("__tn"),
    )
    inside = Window.partitionBy("__bucket").orderBy("length").rowsBetween(Window.unboundedPreceding, 0)
    h = h.withColumn("__d", F.sum("documents").over(inside)).withColumn("__t", F.sum("tokens").over(inside))
    h = h.join(sums, "__bucket")
    d, t = F.col("__d0") + F.col("__d"), F.col("__t0") + F.col("__t")
    return h.select(
        "length", "documents", "tokens",
        d.alias("documents_up_to"), t.alias("tokens_up_to"),
        (F.col("__dn") - d).alias("documents_over"), (F.col("__tn") - t).alias("tokens_over"),
        (t + F.col("length") * (F.col("__dn") - d)).alias("truncated_tokens"),
        (d / F.col("__dn")).alias("share_up_to"),
    )


def quantiles(totals: DataFrame, shares: list[float]) -> DataFrame:
    """share, length: the smallest length that at least this share of the documents does not exceed."""
    cells = F.array(*[F.struct(F.lit(s).alias("share"), (F.col("share_up_to") >= s).alias("__in")) for s in shares])
    cut = totals.select("length", F.explode(cells).alias("__c")).filter("__c.__in")
    return cut.groupBy(F.col("__c.share").alias("share")).agg(F.min("length").alias("length"))


def truncated_totals(totals: DataFrame, limits: list[int]) -> DataFrame:
    """context_limit, documents_cut, tokens_kept: for any limit, from the next smaller length that occurs."""
    cells = F.array(*[F.struct(F.lit(n).cast("long").alias("context_limit")) for n in limits])
    per = totals.select("*", F.explode(cells).alias("__c")).select("*", "__c.context_limit")
    over = F.col("length") > F.col("context_limit")
    return per.groupBy("context_limit").agg(
        F.sum(F.when(over, F.col("documents")).otherwise(0)).alias("documents_cut"),
        F.sum(F.when(over, F.col("context_limit") * F.col("documents")).otherwise(F.col("tokens"))).alias("tokens_kept"),
    )
