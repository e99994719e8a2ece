"""Ranked search against scoring every document; the whole table is compared with SQL."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from riskframe.llm import lexical as L

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def plain(docs, items, k=10):
    bags = [(i, Counter(t)) for i, text in docs if (t := terms(text))]
    n_docs, length = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    asked, out = {}, []
    for i, text in items:
        asked.setdefault(i, set()).update(terms(text))
    for i, own in asked.items():
        found = []
        for d, b in bags:
            m = 10 + (90 * sum(b.values()) * n_docs) // length
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * b[t] // (1000 * b[t] + 8 * m)) for t in own if t in b)
            found += [(-s, d is None, d or 0, d)] * (s > 0)
        out += [(i, rank, d, -s) for rank, (s, _, _, d) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=str)


def run(spark, docs, items, **more):
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS item_id", "2 AS id", "3 AS n", "4 AS score")
    b = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS doc_id", "2 AS query", "3 AS term")
    found = L.top_documents(d, b, **more)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted(map(tuple, found.collect()), key=str)


def texts(n, seed, words=400):
    rng = random.Random(seed)
    return [" ".join(f"w{int(words * rng.random() ** 3)}" for _ in range(rng.randint(1, 60))) for _ in range(n)]


def test_random_texts_in_small_buckets_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(L, "BUCKET", 16)
    monkeypatch.setattr(L, "FIRST_DOCUMENTS", 40)
    docs, items = list(enumerate(texts(700, 1))), list(enumerate(texts(12, 2)))
    docs += [(2000 + i, items[3][1]) for i in range(30)] + [(3000, items[5][1] + " and more"), (3001, docs[1][1])]
    assert run(spark, docs, items) == plain(docs, items)
    assert run(spark, docs, items, block_terms=60, k=3) == plain(docs, items, 3)


def test_odd_rows(spark):
    docs = [(1, None), (2, ""), (3, "?! ..."), (None, "alpha beta"), (4, "Alpha, BETA"), (4, "Alpha, BETA"), (4, "alpha"), (5, "word " * 600_000 + "alpha"), (6, "É é alpha_beta Ünder 漢字"),
            (7, "x" * 10**6), (8, " " * 10**6 + "gamma")]
    items = [(1, "ALPHA beta"), (2, None), (3, ""), (4, "?"), (None, "word"), (None, "gamma"), (1, "Alpha"), (5, "é É"), (6, "unknown")]
    assert run(spark, docs, items) == plain(docs, items)
    assert run(spark, docs[:0], items) == [] and run(spark, docs, items[:0]) == [] and run(spark, docs, items[1:4]) == []


def test_buckets_are_pruned_exactly(spark):
    """Bounds leave out documents, and never one of the best."""
    rng = np.random.default_rng(3)
    weight = rng.integers(1, 6000, 50)
    query = np.argsort(-weight, kind="stable")[:30]
    rows = [sorted(rng.choice(50, rng.integers(1, 20), replace=False).tolist()) for _ in range(400)]
    x = [[int(v) for v in rng.integers(1, 10**6, len(r))] for r in rows]
    score = [sum(int(weight[t]) * v for t, v in zip(r, f) if t in query) for r, f in zip(rows, x)]
    length = [math.sqrt(sum(float(weight[t]) * v * v for t, v in zip(r, f))) for r, f in zip(rows, x)]
    order = np.argsort(length)[::-1]
    batch = pa.record_batch([pa.array(order), pa.array(np.array(length)[order]), pa.array([rows[i] for i in order], pa.list_(pa.int32())), pa.array([x[i] for i in order], pa.list_(pa.int32()))],
                            names=["id", "length", "terms", "impacts"])
    best, norm, scored = [L.Best(5, 0)], np.sqrt([float(weight[query].sum())]), 0
    for i in range(0, 400, 20):
        scored += L.search_bucket(batch.slice(i, 20), [query], weight, norm, best)
    assert scored < 300
    assert best[0].id.tolist() == sorted(range(400), key=lambda i: (-score[i], i))[:5]
