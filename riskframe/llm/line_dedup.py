"""Line deduplication by winnowing over line hashes, with DataFrame functions only.

A run is a stretch of whole lines with at least ``min_words`` words. From every line the shortest
run that starts there and the shortest that ends there are its windows. The smallest line hash in
a window is its fingerprint; equal windows have equal fingerprints, so any passage of that many
words which occurs twice is found through a repeated fingerprint. Windows under repeated fingerprints are
then compared whole (128 bits over the ordered lines), and a line is removed if it lies in a
window that occurred earlier: at a smaller key, or further up in the same text. Windows that start and windows that end at
each line together reach both ends of every repeated passage, so matches are extended both ways.

Lines are cut at newlines and compared without spaces around them; words are separated by
spaces and tabs. Blank lines have no words: they go only between removed lines. Null text stays
null; empty text stays empty. Rows that repeat key and text are one document and are treated
alike. Null keys come first in the order; rows of one key are ordered by the text's hash. Other columns are kept as they are. Of
every removed line an equal one stays at an earlier place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.frames import cut_lineage
from .common import null_safe, text_hash

MIN_WORDS = 50


def windows(docs: DataFrame, key: str, text: str, min_words: int) -> DataFrame:
    """key, __text, first, last, k1, k2 (content), fh (fingerprint), place (hash of where the fingerprint stands)."""
    doc = [key, "__text"]
    lines = docs.select(key, text_hash(text).alias("__text"), F.posexplode(F.split(text, "\n", -1)).alias("pos", "line"))
    bare = F.trim("line")
    lines = lines.select(
        *doc, "pos", F.xxhash64(bare).alias("h1"), F.xxhash64(F.lit(1), bare).alias("h2"),
        F.when(bare == "", 0).otherwise(F.size(F.split(bare, "[ \t]+"))).cast("long").alias("w"))
    # Rows that repeat key and text become one; grouping and windows reuse the same exchange.
    lines = lines.filter("w > 0").repartition(*doc).groupBy(*doc, "pos").agg(*[F.any_value(c).alias(c) for c in ("h1", "h2", "w")])
    lines = lines.withColumn("end", F.sum("w").over(Window.partitionBy(*doc).orderBy("pos")))
    lines = lines.withColumn("start", F.col("end") - F.col("w"))

    def window(frame, first, last, words):
        least = F.min(F.struct("h1", "pos")).over(frame)
        return F.struct(
            first.alias("first"), last.alias("last"), words.alias("words"),
            F.xxhash64(F.collect_list("h1").over(frame)).alias("k1"), F.xxhash64(F.collect_list("h2").over(frame)).alias("k2"),
            least["h1"].alias("fh"), F.xxhash64(*doc, least["pos"]).alias("place"))

    after = Window.partitionBy(*doc).orderBy("start").rangeBetween(0, min_words - 1)
    before = Window.partitionBy(*doc).orderBy("end").rangeBetween(1 - min_words, 0)
    found = lines.select(
        *doc,
        window(after, F.col("pos"), F.max("pos").over(after), F.max("end").over(after) - F.col("start")).alias("down"),
        window(before, F.min("pos").over(before), F.col("pos"), F.col("end") - F.min("start").over(before)).alias("up"))
    each = found.select(*doc, F.explode(F.array("down", "up")).alias("x")).filter(F.col("x.words") >= min_words)
    return each.select(*doc, "x.first", "x.last", "x.k1", "x.k2", "x.fh", "x.place")


def repeated_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """key, __text, gone: the positions (from 0) of the lines to remove, for texts that have any."""
    every = cut_lineage(windows(docs, key, text, min_words))
    prints = every.groupBy("fh").agg(F.min("place").alias("a"), F.max("place").alias("b")).filter("a < b").select("fh")
    shared = cut_lineage(every.join(prints, "fh", "left_semi").drop("fh", "place"))
    here = F.struct(F.col(key).alias("key"), "__text", F.col("first").alias("line"))
    content = shared.groupBy("k1", "k2").agg(F.min(here).alias("origin"), F.max(here).alias("other")).filter("origin < other")
    # Stored, so that both sides of the join are plain exchanges and a passage of many copies can be split.
    later = shared.join(cut_lineage(content.drop("other")), ["k1", "k2"]).filter(here > F.col("origin"))
    gone = later.select(key, "__text", F.explode(F.sequence("first", "last")).alias("pos"))
    return gone.groupBy(key, "__text").agg(F.collect_set("pos").alias("gone"))


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with later repeats cut out of ``text``, and ``__lines`` and ``__removed`` (counts)."""
    gone = repeated_lines(docs, key, text, min_words).withColumnRenamed("gone", "__gone")
    found = null_safe(docs.withColumn("__text", text_hash(text)), gone, [key, "__text"], "left")
    split = F.split(text, "\n", -1)
    # The outer array binds the split text once; otherwise it would be split again for every line.
    kept = F.transform(F.array(split), lambda lines: F.transform(
        F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("__gone")), lambda i: lines[i]))[0]
    found = found.withColumn("__lines", F.when(F.col(text).isNull(), 0).otherwise(F.size(split)).cast("long"))
    found = found.withColumn("__removed", F.coalesce(F.size("__gone"), F.lit(0)).cast("long"))
    return found.withColumn(text, F.when(F.col("__gone").isNull(), F.col(text)).otherwise(F.array_join(kept, "\n"))).drop("__gone", "__text")
