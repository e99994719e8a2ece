"""Language-model scores against a plain, sequential computation."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow.parquet as pq

from riskframe.llm import language_model as M
from riskframe.llm.queries import op8

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_base_and_counts(spark, sf):
    rows = pq.read_table(f"{sf}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    held = {r["doc_id"]: zlib.crc32(str(r["doc_id"]).encode()) % 7 == 2 for r in rows}
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tokens = {r["doc_id"]: [*WORD.findall((r["text"] or "").translate(lower)), None] for r in rows}
    c = Counter(t for d, ts in tokens.items() if not held[d] for t in ts)
    n, v = sum(c.values()), len(c)
    found = op8(spark, sf).collect()
    assert len(found) == len(rows)
    for r in found:
        ts = tokens[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(ts), sum(c[t] > 0 for t in ts), n)
        assert abs(r.base_score - sum(math.log10((c[t] + 1) / (n + v + 1)) for t in ts)) < 1e-6
        assert r.score < 0


def test_held_out_texts_are_likelier_than_under_the_base(spark):
    held = [r for r in op8(spark, "/root/testdata/sf0.01").collect() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def small_model():
    texts = [b"the cat sat on the mat", b"the dog sat", b"la casa de la noche", b"el gato de la casa"] * 8
    classes = M.fit_classes([t.split() for t in texts], classes=2)
    counts = Counter()
    for t in texts:
        k = classes.of(t.split())
        counts.update((k, w) for w in [*t.split(), b""])
    words, kinds, n = [w for _, w in counts], np.array([k for k, _ in counts]), np.array(list(counts.values()))
    s = M.Spelling(words, kinds)
    pairs = np.bincount(s.before * M.SYMBOLS + s.symbol, n[s.word], minlength=M.SYMBOLS**2).astype(np.int64)
    trees = M.build_trees(pairs.reshape(M.SYMBOLS, M.SYMBOLS))
    sums = [np.zeros((size, 2), np.int64) for size in M.SIZES]
    M._add_words(sums, trees, s, n)
    return M.Mixer(classes, trees, [M._logits(v) for v in sums], M.first_weights())


def plain_log10(mixer, words, kind):
    """One decision after the other, with weights that start anew every STRETCH decisions."""
    start, size, x, gate, bit = mixer.inputs(words, np.full(len(words), kind))
    w, total = mixer.weights.astype(float).copy(), 0.0
    for d in range(len(bit)):
        if d % M.STRETCH == 0:
            w = mixer.weights.astype(float).copy()
        p = 1 / (1 + math.exp(-float(x[d] @ w[gate[d]])))
        y = int(bit[d])
        total += math.log(p if y else 1 - p)
        w[gate[d]] += M.RATE * (y - p) * x[d]
    return (total + mixer.classes.log_share[kind]) / math.log(10)


def test_mixing_matches_the_sequential_form():
    mixer = small_model()
    texts = [b"the cat of the house", b"", b"la casa", b"zzz qqq " * 150, b"the mat"]
    docs = [[*t.split(), b""] for t in texts]
    kinds = [mixer.classes.of(d) for d in docs]
    known = M.Known(mixer)
    ids = [known.ids(d, k) for d, k in zip(docs, kinds)]
    known.complete()
    got = mixer.log10(ids, known, np.array(kinds))
    for g, d, k in zip(got, docs, kinds):
        assert abs(g - plain_log10(mixer, d, k)) < 1e-3 * max(1, abs(g))


def test_probabilities_of_all_symbols_add_up():
    """From any state, the next symbol's probabilities sum to 1, so texts have a proper distribution."""
    mixer = small_model()
    for prefix in (b"", b"th", b"\xff"):
        total = 0.0
        for symbol in range(256):
            word = prefix + bytes([symbol])
            _, _, x, gate, bit = mixer.inputs([word], np.array([0]))
            steps = mixer.trees.decisions(M.Spelling([word], np.array([0])))[0]
            own = steps == len(prefix)
            z = np.einsum("ij,ij->i", x, mixer.weights[gate])[own] * (2.0 * bit[own] - 1)
            total += float(np.exp(-np.logaddexp(0, -z).sum()))
        _, _, x, gate, bit = mixer.inputs([prefix], np.array([0]))
        own = mixer.trees.decisions(M.Spelling([prefix], np.array([0])))[0] == len(prefix)
        z = np.einsum("ij,ij->i", x, mixer.weights[gate])[own] * (2.0 * bit[own] - 1)
        assert abs(total + float(np.exp(-np.logaddexp(0, -z).sum())) - 1) < 1e-4


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (3, " \n"), (None, "the cat"), (4, "the cat " * 30_000), (5, "x" * 50_000), *[(10 + i, "the cat sat on the mat") for i in range(30)]]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS word", "2 AS n", "3 AS kind", "4 AS row", "5 AS score")
    found = M.score(docs, docs.filter("doc_id > 9")).collect()
    assert len(found) == len(rows)
    by = {r.doc_id: r for r in found}
    assert by[1].n_tokens == by[2].n_tokens == by[3].n_tokens == 1 and by[1].score == by[2].score == by[3].score
    assert by[4].n_tokens == 60_001 and by[4].n_known == 60_001 and by[5].n_known == 1 and by[None].n_known == 3
    assert by[10].score > by[3].score - 20 and all(math.isfinite(r.score) for r in found)
    assert M.score(docs.limit(0), docs).count() == 0
    nothing = M.score(docs.limit(1), docs.limit(0)).head()
    assert nothing.base_score == 0 and nothing.train_tokens == 0 and nothing.score < 0


def test_tables_less_the_sample_are_those_learned_without_it():
    trees = small_model().trees
    rest, sample = Counter({(0, b"the"): 5, (0, b"cat"): 1, (1, b"gato"): 2, (1, b""): 3}), Counter({(0, b"the"): 1, (0, b"cab"): 1, (1, b"gato"): 4})

    def tables(counts, sign=1, sums=None):
        sums = [np.zeros((size, 2), np.int64) for size in M.SIZES] if sums is None else sums
        M._add_words(sums, trees, M.Spelling([w for _, w in counts], np.array([k for k, _ in counts])), sign * np.array(list(counts.values())))
        return sums

    left, want = tables(sample, -1, tables(rest + sample)), tables(rest)
    assert all((a == b).all() for a, b in zip(left, want))
    once = tables({(0, b"dog"): 1})
    assert [int(t.sum()) for t in once] == [int(once[0].sum())] * 4 and once[0].any()


def test_weights_are_carried_to_the_end_of_a_text(monkeypatch):
    """From the first decision to the last, however the text is cut into rounds and whatever is read beside it."""
    mixer = small_model()
    texts = [b"zzz qqq the " * 400, b"la casa " * 700, b"the cat", b""]
    docs = [[*t.split(), b""] for t in texts]
    kinds = [mixer.classes.of(d) for d in docs]
    known = M.Known(mixer)
    ids = [known.ids(d, k) for d, k in zip(docs, kinds)]
    known.complete()

    def plain(words, kind):
        _, _, x, gate, bit = mixer.inputs(words, np.full(len(words), kind))
        w, total = mixer.weights.astype(float).copy(), 0.0
        for d in range(len(bit)):
            p = 1 / (1 + math.exp(-float(x[d] @ w[gate[d]])))
            total += math.log(p if bit[d] else 1 - p)
            w[gate[d]] += M.RATE * (int(bit[d]) - p) * x[d]
        return (total + mixer.classes.log_share[kind]) / math.log(10)

    want = [plain(d, k) for d, k in zip(docs, kinds)]
    for most in (1, 100, M.ROUND):
        monkeypatch.setattr(M, "ROUND", most)
        assert np.allclose(mixer.log10(ids, known, np.array(kinds)), want, rtol=1e-4)


def test_lanes_and_forgotten_words_change_no_score(spark, monkeypatch):
    words = "the cat sat on a mat in la casa de noche".split()
    rows = [(i, " ".join(words[(i * 7 + j * j) % len(words)] + ("" if j % 5 else str(i)) for j in range(i * 13 % 97))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    training = docs.filter("doc_id < 40")

    def scores():
        return {r.doc_id: (r.n_tokens, r.n_known, round(r.base_score, 6), round(r.score, 2)) for r in M.score(docs, training).collect()}

    want = scores()
    for name, value in (("TOKENS", 50), ("LANES", 3), ("LANE_WORDS", 120), ("KEPT_DECISIONS", 500), ("ROUND", 64)):
        monkeypatch.setattr(M, name, value)
    got = scores()
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k], atol=0.02) for k in want)


def test_classes_are_counted_over_all_texts(spark, monkeypatch):
    """A language that the sample does not hold shapes the distributions, shares and words all the same."""
    rows = [(i, "the cat sat on the mat") for i in range(20)] + [(100 + i, "la casa de la noche") for i in range(60)]
    training = spark.createDataFrame(rows, "doc_id long, text string")
    top = [b"the", b"la", b"casa", b"cat", b"de", b"noche", b"mat", b"on", b"sat"]
    start = M.fit_classes([b"the cat sat on the mat".split(), b"the cat casa".split()], classes=2, top=top)
    found = M.settle_classes(training, start)
    one, two = found.of(b"the cat".split()), found.of(b"la casa".split())
    assert one != two and abs(math.exp(found.log_share[two]) - 60.5 / 81) < 1e-9
    word = np.array([0.1] * len(top))
    for w, n in ((b"la", 120), (b"casa", 60), (b"de", 60), (b"noche", 60)):
        word[top.index(w)] += n
    assert np.allclose(np.exp(found.log_word[two]), word / word.sum())
    monkeypatch.setattr(M, "SAMPLE", 1)
    seen = []
    monkeypatch.setattr(M, "train", lambda counts, classes, sample: seen.append(classes) or train(counts, classes, sample))
    M.score(training, training).count()
    assert len(seen[0].place) == 9 and abs(np.exp(seen[0].log_share).sum() - 1) < 1e-9


train = M.train
