"""URL filter: rules first, then a character language model ratio, with DataFrame functions only.

Two variable-order Markov models over characters, one of URLs that rules allow and one of URLs
that rules block, score every URL; the difference of the log-likelihoods per character is compared
with a cut halfway (in standard deviations) between the two classes of ruled URLs. Orders 0 to 3
are interpolated: p_n = (count(context, c) + kappa * p_(n-1)) / (count(context) + kappa).

Characters are mapped to 41 symbols (a-z, 0 for any digit, punctuation, ~ for all others), so
a model has at most 42^3 * 41 = 3.0 million entries (about 60 MB), whatever the input; that is the
proven bound of what is broadcast. URLs are scored once per distinct URL.

Null URL and URL without ``://`` have an empty host and path, so no rule fits. A null or empty
URL has no characters and difference 0. When no URL is allowed, or none is blocked, by rules, there
is nothing to compare: every difference and the cut are 0, and 0 is allowed (``allow`` from the cut
upwards). Repeated rows are judged alike. Only the id and the URL are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.frames import cut_lineage

#: (verdict, host and path prefix); the longest rule that fits wins.
RULES = [
    ("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"),
]
ORDER, KAPPA = 3, 4.0
PUNCTUATION = "/.-_?=&#:%+,@"
START = "^"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]] = RULES) -> Column:
    """The longest rule that fits, else null."""
    cases = []
    for _, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        own, cut, rest = rule.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(cut + rest)
        cases.append(F.when(fits, F.lit(rule)))
    return F.coalesce(*cases) if cases else F.lit(None).cast("string")


def symbols(url: Column) -> Column:
    """A URL over the fixed alphabet."""
    lowered = F.regexp_replace(F.translate(F.lower(F.coalesce(url, F.lit(""))), "123456789", "000000000"), r"\n", "~")
    return F.regexp_replace(lowered, r"[^a-z0/.\-_?=&#:%+,@]", "~")


def grams(urls: DataFrame, order: int = ORDER) -> DataFrame:
    """One row per character: the symbol with ``order`` symbols before it, as ``gram``."""
    padded = F.concat(F.lit(START * order), "symbols")
    n = F.length("symbols")
    places = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    # The outer array binds the split text once for all places.
    cut = F.transform(F.array(F.split(padded, "")), lambda p: F.transform(
        places, lambda i: F.concat(*[p[i + k] for k in range(order + 1)])))[0]
    return urls.select(*[c for c in urls.columns if c != "symbols"], F.explode(cut).alias("gram"))


def log_ratios(counts: DataFrame, order: int = ORDER, kappa: float = KAPPA) -> DataFrame:
    """gram, llr: log p(allowed) - log p(blocked) of its last symbol; ``counts``: gram, allow, block.

    Lower orders are suffixes of the longest grams, so every count follows from one table.
    """
    size = float(len(PUNCTUATION) + 28)  # a-z, 0, ~ and the punctuation
    p = {"allow": F.lit(1.0 / size), "block": F.lit(1.0 / size)}
    joined = counts.select("gram")
    for n in range(order + 1):
        suffix = F.right("gram", F.lit(n + 1))
        gram, context = suffix, F.left(suffix, F.lit(n))
        seen = counts.groupBy(gram.alias(f"g{n}")).agg(F.sum("allow").alias(f"ga{n}"), F.sum("block").alias(f"gb{n}"))
        around = counts.groupBy(context.alias(f"c{n}")).agg(F.sum("allow").alias(f"ca{n}"), F.sum("block").alias(f"cb{n}"))
        joined = joined.withColumn(f"g{n}", gram).withColumn(f"c{n}", context).join(seen, f"g{n}").join(around, f"c{n}")
        p = {
            "allow": (F.col(f"ga{n}") + kappa * p["allow"]) / (F.col(f"ca{n}") + kappa),
            "block": (F.col(f"gb{n}") + kappa * p["block"]) / (F.col(f"cb{n}") + kappa),
        }
    return joined.select("gram", (F.ln(p["allow"]) - F.ln(p["block"])).alias("llr"))


def judge(pages: DataFrame, rules: list[tuple[str, str]] = RULES, key: str = "page_id", url: str = "url",
          order: int = ORDER, kappa: float = KAPPA) -> DataFrame:
    """key, url, host, path, rule, verdict, difference, cut."""
    parts = pages.select(F.col(key), F.col(url).alias("url"), F.col(url).alias("__join"))
    distinct = cut_lineage(
        parts.groupBy("url").agg(F.count(F.lit(1)).alias("n")).withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
        .withColumn("rule", rule_of(F.col("host"), F.col("path"), rules)))
    kind = F.lit(None).cast("string")
    for verdict, rule in rules:
        kind = F.when(F.col("rule") == rule, F.lit(verdict)).otherwise(kind)
    distinct = distinct.withColumn("ruled", kind)
    cells = grams(distinct.select(F.md5("url").alias("id"), "n", "ruled", symbols(F.col("url")).alias("symbols")), order)
    counts = cells.groupBy("gram").agg(
        F.sum(F.when(F.col("ruled") == "allow", F.col("n")).otherwise(0)).alias("allow"),
        F.sum(F.when(F.col("ruled") == "block", F.col("n")).otherwise(0)).alias("block"))
    ratios = cut_lineage(log_ratios(cut_lineage(counts), order, kappa))
    scored = cells.join(F.broadcast(ratios), "gram").groupBy("id").agg(F.avg("llr").alias("difference"))
    scored = cut_lineage(distinct.withColumn("id", F.md5("url")).join(scored, "id", "left").drop("id"))
    cut = _cut(scored)
    found = scored.crossJoin(F.broadcast(cut))
    # Both classes are needed for a comparison.
    difference = F.when(F.col("cut").isNull(), 0.0).otherwise(F.coalesce("difference", F.lit(0.0)))
    found = found.withColumn("difference", difference).withColumn("cut", F.coalesce("cut", F.lit(0.0)))
    own = F.when(F.col("difference") >= F.col("cut"), F.lit("allow")).otherwise(F.lit("block"))
    found = found.select(F.col("url").alias("__url"), "host", "path", "rule", F.coalesce("ruled", own).alias("verdict"), "difference", "cut")
    return parts.drop("__join").join(found, F.col("url").eqNullSafe(F.col("__url"))).drop("__url")


def _cut(scored: DataFrame) -> DataFrame:
    """One row: where both classes are equally many standard deviations away; null without both."""
    stats = {}
    for kind in ("allow", "block"):
        own = F.when(F.col("ruled") == kind, F.col("difference"))
        stats[kind] = (F.sum(F.when(F.col("ruled") == kind, F.col("n") * F.col("difference"))) / F.sum(F.when(own.isNotNull(), F.col("n"))),
                       F.sum(own * own * F.col("n")) / F.sum(F.when(own.isNotNull(), F.col("n"))))
    row = scored.agg(*[x.alias(f"{k}{i}") for k, both in stats.items() for i, x in enumerate(both)])

    def spread(kind):
        return F.sqrt(F.greatest(F.col(f"{kind}1") - F.col(f"{kind}0") * F.col(f"{kind}0"), F.lit(0.0))) + 1e-6

    a, b = spread("allow"), spread("block")
    return row.select(((F.col("allow0") * b + F.col("block0") * a) / (a + b)).alias("cut"))
