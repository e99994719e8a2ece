"""Packing: ids against encoding whole texts, plans against item-by-item packing and the optimum."""

import functools
import random
import zlib

import numpy as np
import pyarrow.parquet as pq
from tokenizers import Tokenizer

from riskframe.llm import packing as P
from riskframe.llm.queries import op13


def cells(plan):
    """length, number -> sequence, offset of all pieces of a plan."""
    out, steps = {}, plan.table()
    for i, (length, number, first, each, offset) in enumerate(steps.tolist()):
        last = steps[i + 1][1] if i + 1 < len(steps) and steps[i + 1][0] == length else plan.numbered[length]
        for k in range(number, int(last)):
            out[length, k] = first + (k - number) // each, offset + (k - number) % each * length
    return out


def check(counts, plan):
    """Every piece once, no gap, no sequence over its capacity."""
    bins = {}
    for (length, _), (sequence, offset) in (found := cells(plan)).items():
        bins.setdefault(sequence, []).append((offset, length))
    assert len(found) == sum(counts) and len(bins) == plan.sequences
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= plan.capacity


def optimum(sizes, capacity):
    @functools.lru_cache(None)
    def least(left):
        if not left:
            return 0
        if sum(left) <= capacity:
            return 1
        best = len(left)

        def fill(i, room, taken):
            nonlocal best
            rest = tuple(x for j, x in enumerate(left) if j not in taken)
            best = min(best, 1 + least(rest))
            for j in range(i, len(left)):
                if left[j] <= room and j not in taken and (j == i or left[j] != left[j - 1] or j - 1 in taken):
                    fill(j + 1, room - left[j], taken | {j})

        fill(1, capacity - left[0], frozenset({0}))
        return best

    return least(tuple(sorted(sizes, reverse=True)))


def one_by_one(sizes, capacity):
    rooms = []
    for x in sorted(sizes, reverse=True):
        fit = [r for r in rooms if r >= x]
        if fit:
            rooms.remove(min(fit))
        rooms.append((min(fit) if fit else capacity) - x)
    return len(rooms)


def test_reduction_keeps_the_optimum():
    rng, fixed = random.Random(5), 0
    for trial in range(400):
        capacity = rng.choice([10, 20, 31])
        sizes = [rng.randint(rng.choice([1, capacity // 4]), capacity) for _ in range(rng.randint(0, 9))]
        counts = np.bincount(sizes, minlength=capacity + 1) if sizes else np.zeros(capacity + 1, int)
        plan = P.Plan.__new__(P.Plan)
        plan.capacity, plan.left, plan.numbered = capacity, counts.astype(np.int64), np.zeros(capacity + 1, np.int64)
        plan.steps, plan.sequences = [], 0
        plan.reduce()
        left = np.repeat(np.arange(capacity + 1), plan.left).tolist()
        assert plan.sequences + optimum(left, capacity) == optimum(sizes, capacity)
        fixed += plan.sequences
        rest, before = one_by_one(left, capacity), plan.sequences
        plan.best_fit()
        assert plan.sequences == before + rest
        check(counts, plan)
    assert fixed > 500


def test_large_counts_take_few_steps():
    rng = np.random.default_rng(1)
    counts = np.zeros(4097, np.int64)
    counts[1:] = rng.integers(0, 10**9, 4096) * (rng.random(4096) < 0.8)
    plan = P.Plan(counts)
    assert (plan.left == 0).all() and (plan.numbered == counts).all() and len(plan.steps) < 12 * 4 * 4096
    assert plan.sequences <= 1.003 * (counts * np.arange(4097)).sum() / 4096
    small = np.minimum(counts, rng.integers(0, 4, 4097))
    check(small, P.Plan(small))


def verify(rows, docs, capacity):
    """``rows``: as returned; ``docs``: (id, text). Returns the number of sequences."""
    tokenizer = Tokenizer.from_file(P.vocabulary_path())
    want, bins = [], {}
    for doc_id, text in docs:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        want += [(str(doc_id), i, i * capacity, len(p), zlib.crc32(p.tobytes())) for i in range(-(-len(ids) // capacity)) if len(p := ids[i * capacity : (i + 1) * capacity])]
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(want)
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


def test_words_apart_equal_the_whole_text():
    rng, tokenizer, words = random.Random(2), Tokenizer.from_file(P.vocabulary_path()), P.Words(open(P.vocabulary_path(), encoding="utf-8").read())
    parts = ["word", "Word's", "it's.", "end.", "end...", "(a,b)", "don't!", "x1y", "ﬁne", "naïve", "NAÏVE", "e\u0301", "Σίσυφος", "İstanbul", "ß", "ŉ", "漢字。", "a\u0301b",
             "<|endoftext|>", "<|ENDOFTEXT|>", "A<|endoftext|>b.", "...", "'s", "'ve", "co\xadop", "\x1c", "q\x00r", "\u2028", "a.b.c", "U.S.A.", "\u00aa", "ǅ", "\u0130."]
    for _ in range(300):
        text = "".join(rng.choice(parts) + rng.choice([" ", "\n", "  ", "\t", "", "."]) for _ in range(rng.randint(1, 12)))
        got = [i for w in P.word_lists(text.encode()) for i in words.encode(w).tolist()]
        assert got == tokenizer.encode(text, add_special_tokens=False).ids, text


def test_query(spark, sf):
    docs = [(r["doc_id"], r["text"]) for r in pq.read_table(f"{sf}/documents.parquet", columns=["doc_id", "text"]).to_pylist()]
    rows = op13(spark, sf).collect()
    used = verify(rows, docs, 4096)
    assert used <= one_by_one([r.length for r in rows], 4096)
    assert used <= sum(r.length for r in rows) // 4096 + 2


def test_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(P, "GROUP", 3)
    monkeypatch.setattr(P, "PIECE", 1 << 12)
    docs = [(1, None), (2, ""), (2, ""), (3, " \n\t"), (4, "One two"), (4, "One two"), (4, "one three"), (None, "one two"), (None, None), (5, "word's 12ab <|endoftext|>x " * 3000),
            (6, " " * 10**6), (7, "x" * 10**5), (8, "é é\x1cü\x85a\xa0漢字 ́b\x0bc\x0cd"), *[(10 + i, "the same words here") for i in range(40)]]
    frame = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS length", "2 AS n", "3 AS offset")
    packed = P.pack(frame, capacity=64, with_ids=True).cache()
    verify(packed.collect(), docs, 64)
    whole = P.sequences(packed).collect()
    assert all(len(r.ids) == r.length <= 64 for r in whole) and sum(r.length for r in whole) == sum(r.length for r in packed.collect())
    assert P.pack(frame.limit(0)).count() == 0
