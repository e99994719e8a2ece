"""Length histograms against encoding each text on its own."""

import pyarrow.parquet as pq

from riskframe.llm import token_counts as T
from riskframe.llm.queries import op1


def lengths_of(texts):
    encoding = T.load_encoding(open(T.VOCABULARY, "rb").read())
    return [len(encoding.encode_ordinary(t or "")) for t in texts]


def test_query_matches_single_texts(spark, sf):
    lengths = lengths_of(pq.read_table(f"{sf}/documents.parquet", columns=["text"])["text"].to_pylist())
    rows = {r.length: r for r in op1(spark, sf).collect()}
    assert set(rows) == set(lengths)
    for n, r in rows.items():
        assert r.documents == lengths.count(n) and r.tokens == n * r.documents
        assert r.documents_up_to == sum(x <= n for x in lengths) and r.documents_over == sum(x > n for x in lengths)
        assert r.tokens_up_to == sum(x for x in lengths if x <= n) and r.tokens_over == sum(x for x in lengths if x > n)
        assert r.truncated_tokens == sum(min(x, n) for x in lengths)
        assert r.share_up_to == r.documents_up_to / len(lengths)


def test_odd_rows_and_any_limit(spark):
    texts = [None, "", "", "one two three", "one two three", "long " * 30_000, "é\n\n  ü"]
    docs = spark.createDataFrame([(t, 1, 2) for t in texts], "text string, length int, tokens int")
    lengths = lengths_of(texts)
    totals = T.length_totals(T.length_histogram(docs))
    assert sum(r.documents for r in totals.collect()) == 7
    got = {r.context_limit: r for r in T.truncated_totals(totals, [0, 1, 4, 10**9]).collect()}
    for limit, r in got.items():
        assert r.tokens_kept == sum(min(x, limit) for x in lengths) and r.documents_cut == sum(x > limit for x in lengths)
    cuts = {r.share: r.length for r in T.quantiles(totals, [0.25, 0.5, 1.0]).collect()}
    ordered = sorted(lengths)
    assert cuts == {0.25: ordered[1], 0.5: ordered[3], 1.0: ordered[-1]}


def test_empty_table(spark):
    docs = spark.createDataFrame([], "text string")
    assert T.length_totals(T.length_histogram(docs)).count() == 0


def test_long_runs_of_blanks():
    encoding = T.load_encoding(open(T.VOCABULARY, "rb").read())
    words = "some words, " * 10_000
    for run in (" " * 3000, "\n" * 2500, " \n" * 1500, "\u3000\xa0" * 1200, "\x1c" * 3000):
        for text in (run + words, words + run, f"a{run}\n{words}", words + run + "1" + run + "'s", run * 40):
            assert T.encode_text(encoding, text) == encoding.encode_ordinary(text)
    for text in (" " * 10**6, "\n" * 10**6 + "x", "x" * 10**6, words + " \t" * 10**6 + words):
        assert encoding.decode(T.encode_text(encoding, text)) == text


def test_a_million_blanks_are_counted(spark):
    docs = spark.createDataFrame([(" " * 10**6,), ("\n" * 10**6,), ("x" * 10**6,)], "text string")
    assert sum(r.documents for r in T.length_histogram(docs).collect()) == 3
