"""SimHash groups against a plain implementation that compares all pairs."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest
from xxhash import xxh64_intdigest

from riskframe.llm import simhash
from riskframe.llm import simhash as S
from riskframe.llm.components import components
from riskframe.llm.queries import op7

WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def plain_fingerprint(text):
    words = WORD.findall((text or "").translate(UPPER))
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h)) if h else 0


def plain_components(prints):
    """doc_id -> fingerprint to doc_id -> smallest reachable doc_id."""
    by = {}
    for d, f in prints.items():
        by.setdefault(f, []).append(d)
    parent = {f: f for f in by}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    known = list(by)
    for i, a in enumerate(known):
        for b in known[:i]:
            if (a ^ b).bit_count() <= 3:
                parent[find(a)] = find(b)
    least = {}
    for f, ds in by.items():
        least[find(f)] = min(min(ds), least.get(find(f), min(ds)))
    return {d: least[find(f)] for d, f in prints.items()}


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.01"])
def test_query_matches_all_pairs(spark, folder):
    path = f"/root/testdata/{folder}"
    rows = pq.read_table(f"{path}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    prints = {r["doc_id"]: plain_fingerprint(r["text"]) for r in rows}
    want = plain_components(prints)
    got = op7(spark, path).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.fingerprint == f"{prints[r.doc_id]:016x}"
        assert r.component_id == want[r.doc_id]


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "OneÄ two"), (5, "oneÄ TWO"), (5, "oneÄ TWO"), (None, "oneÄ two"), (6, "word " * 5000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs = docs.selectExpr("*", "1 AS fp", "2 AS component_id", "3 AS node", "4 AS a")
    got = {(r.doc_id, r.fp): r.component_id for r in simhash.near_duplicates(docs).collect()}
    assert {(k, v) for k, v in got.items() if k[1] == 0} == {((1, 0), 1), ((2, 0), 1), ((3, 0), 1)}
    assert got[(5, simhash.fingerprint_of("oneÄ two"))] == 4
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 4, 6]
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_only_ascii_letters_are_lowered():
    assert simhash.fingerprint_of("Ä B C") == simhash.fingerprint_of("Ä b c") != simhash.fingerprint_of("ä b c")
    for text in ("a", "a b", "a b c", "a b c d", "a b c d e", "x\x0by\x1cz q"):
        assert simhash.fingerprint_of(text) % 2**64 == plain_fingerprint(text)


def test_dense_group_in_chunks(spark):
    """A cluster larger than a chunk, whose members are linked only step by step."""
    base, values = 0x0F0F_F0F0_1234_5678, []
    for i in range(300):
        values.append(base ^ (i << 20))
    frame = spark.createDataFrame([(v,) for v in values], "fp long")
    found = {r.node: r.root for r in components(simhash.links(frame, chunk=16)).collect()}
    want = plain_components(dict(enumerate(values)))
    groups = {}
    for i, v in enumerate(values):
        groups.setdefault(found[v], set()).add(want[i])
    assert all(len(g) == 1 for g in groups.values()) and len(groups) == len(set(want.values()))


def test_block_masks_cover_every_close_pair():
    masks = simhash.block_masks()
    assert len(masks) == 10
    for bits in [(0, 13, 63), (0, 1, 2), (12, 25, 51), (60, 61, 62), (5, 30, 40)]:
        x = sum(1 << b for b in bits)
        assert any(m & x == 0 for m in masks)


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(1000, 1001), (7, 7)], "a long, b long")
    found = {r.node: r.root for r in components(edges).collect()}
    assert found == {i: 0 for i in range(201)} | {1000: 1000, 1001: 1000}


def similar_pairs(texts):
    """All pairs of different shingle sets with similarity 0.8 or more, by prefixes of the rarest shingles."""
    sets = {i: frozenset(S.shingle_set(t).tolist()) for i, t in texts.items()}
    first = {}
    for i in sorted(sets):
        first.setdefault(sets[i], i)
    seen = Counter(x for s in first for x in s)
    index, pairs = {}, set()
    for s, i in sorted(first.items(), key=lambda x: len(x[0])):
        near = set()
        for x in sorted(s, key=lambda x: (seen[x], x))[: len(s) - (4 * len(s) + 4) // 5 + 1]:
            near.update(index.setdefault(x, []))
            index[x].append((i, s))
        pairs |= {(j, i) for j, t in near if len(s & t) >= 0.8 * len(s | t)}
    return sets, pairs


@pytest.mark.parametrize("name", ["sf0.01", "sf0.1"])
def test_similar_documents_are_found(spark, name):
    path = f"/root/testdata/{name}/documents.parquet"
    texts = {r["doc_id"]: r["text"] for r in pq.read_table(path, columns=["doc_id", "text"]).to_pylist()}
    sets, pairs = similar_pairs(texts)
    found = {r.doc_id: r.component_id for r in S.similar_documents(spark.read.parquet(path)).collect()}
    assert len(found) == len(texts)
    assert pairs and sum(found[a] == found[b] for a, b in pairs) >= 0.9 * len(pairs)
    same = {}
    for i, s in sets.items():
        same.setdefault(s, set()).add(found[i])
    assert all(len(c) == 1 for c in same.values())
    # Whatever shares a component is connected by similar pairs.
    up = {i: i for i in texts}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in pairs:
        up[top(a)] = top(b)
    by_set = {}
    for i, s in sets.items():
        up[top(by_set.setdefault(s, i))] = top(i)
    groups = {}
    for i, c in found.items():
        groups.setdefault(c, set()).add(top(i))
    assert all(len(g) == 1 for g in groups.values())


def test_similar_documents_on_odd_rows(spark):
    text = " ".join(f"word{i}" for i in range(100))
    near, far = text.replace("word50 ", "other "), " ".join(f"word{i}" if i % 10 else "else" for i in range(100))
    rows = [(5, text), (3, near), (9, far), (1, None), (2, ""), (4, " "), (None, text.upper()), (6, "a b"), (7, "A  b"), (8, "a b c"), (5, text)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS fp", "2 AS words", "3 AS one")
    found = S.similar_documents(docs).collect()
    assert len(found) == len(rows)
    assert {(r.doc_id, r.component_id) for r in found} == {(5, 3), (3, 3), (9, 9), (1, 1), (2, 1), (4, 1), (None, 3), (6, 6), (7, 6), (8, 8)}
    kept = S.keep_one(docs, found=S.similar_documents(docs))
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 3, 6, 8, 9]
    assert S.similar_documents(docs.limit(0)).count() == 0


def test_no_similar_pair_is_lost_in_large_groups(spark, monkeypatch):
    """Many texts share long passages; every text's only similar one is among many that are nearly similar."""
    rng = random.Random(5)
    passage = [f"common{i}" for i in range(75)]
    texts = {}
    for i in range(60):
        own = [f"own{i}x{j}" for j in range(25)]
        texts[1000 + i] = " ".join(passage + own)
        at = rng.randrange(5, 70)
        texts[i] = " ".join(passage[:at] + [f"edit{i}"] + passage[at + 1 :] + own)
    for i in range(100, 200):  # copies of one text, each edited elsewhere
        words = [f"near{j}" for j in range(100)]
        words[i - 100] = f"edit{i}"
        texts[i] = " ".join(words)
    monkeypatch.setattr(S, "CHUNK", 16)
    sets, pairs = similar_pairs(texts)
    assert {(i, 1000 + i) for i in range(60)} <= {(min(p), max(p)) for p in pairs}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    found = {r.doc_id: r.component_id for r in S.similar_documents(docs).collect()}
    assert found == {i: i % 1000 if i < 100 or i >= 1000 else 100 for i in texts}


def test_similar_documents_miss_no_link(spark):
    path = "/root/testdata/sf0.1/documents.parquet"
    texts = {r["doc_id"]: r["text"] for r in pq.read_table(path, columns=["doc_id", "text"]).to_pylist()}
    _, pairs = similar_pairs(texts)
    found = {r.doc_id: r.component_id for r in S.similar_documents(spark.read.parquet(path)).collect()}
    assert pairs and [p for p in pairs if found[p[0]] != found[p[1]]] == []


def test_parities_tell_large_sets_apart_and_rule_no_similar_pair_out():
    rng = np.random.default_rng(8)
    for size in (1, 60, 700, 3_000, 5_000):
        one = np.unique(rng.integers(-(2**62), 2**62, size))
        for part in (0.0, 0.5, 0.85, 1.0):
            two = np.unique(np.concatenate((one[: int(part * size)], rng.integers(-(2**62), 2**62, max(size // 3, 1)))))
            apart = np.setxor1d(one, two).size
            odd = S._odd(S._fine_parity(one), S._fine_parity(two))
            assert odd <= apart and (apart - odd) % 2 == 0
        assert S._odd(S._fine_parity(one), S._fine_parity(one)) == 0
        other = np.unique(rng.integers(-(2**62), 2**62, size))
        total, odd = one.size + other.size, S._odd(S._fine_parity(one), S._fine_parity(other))
        # Sets without a common shingle never come to a comparison.
        assert total - odd < 0.8 * (total + odd)
    assert S._odd(S._fine_parity(one[:0]), S._fine_parity(one[:3])) == 3


def test_keep_one_shuffles_texts_only_where_rows_repeat(spark, monkeypatch):
    rows = [(1, "a b c", "x"), (2, "a b c", "y"), (1, "a b c", "z"), (None, "d e", "x"), (None, "d e", "x"), (3, None, "x"), (4, "f", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string")
    for most in (S.BROADCAST_BYTES, 0):
        monkeypatch.setattr(S, "BROADCAST_BYTES", most)
        left = S.keep_one(docs, found=S.similar_documents(docs))
        assert left.columns == docs.columns
        assert sorted((r.doc_id or 0, r.text or "") for r in left.collect()) == [(0, "d e"), (1, "a b c"), (3, ""), (4, "f")]
