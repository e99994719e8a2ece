"""Line dedup on small texts, against a plain search for repeated runs."""

import random

from riskframe.llm import line_dedup as D


def plain(docs, min_words):
    """Lines to remove: those inside a run of whole lines that stands at an earlier place too."""
    lines = {d: [x.strip(" ") for x in t.split("\n")] for d, t in docs.items() if t is not None}
    full = {d: [(i, x) for i, x in enumerate(v) if x] for d, v in lines.items()}
    first, gone = {}, {}
    for d in sorted(full):
        rows = full[d]
        for a in range(len(rows)):
            for b in range(a, len(rows)):
                run = tuple(x for _, x in rows[a : b + 1])
                if sum(len(x.split()) for x in run) >= min_words:
                    if run in first:
                        gone.setdefault(d, set()).update(range(rows[a][0], rows[b][0] + 1))
                    else:
                        first[run] = (d, a)
    return {d: "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone.get(d, ())) for d, t in docs.items() if t is not None}


def test_random_texts(spark):
    rng = random.Random(5)
    pool = ["a b c", "d e", "f", "g h i j", "k l", "", " m n ", "o p q"]
    docs = {i: "\n".join(rng.choice(pool) for _ in range(rng.randint(1, 14))) for i in range(60)}
    frame = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    got = {r.doc_id: r.text for r in D.dedup_lines(frame, min_words=7).collect()}
    assert got == plain(docs, 7)


def test_odd_rows(spark):
    run = "\n".join(f"line {i} of a long passage" for i in range(12))
    rows = [(1, None), (2, ""), (3, "\n\n"), (4, run), (4, run), (5, "own line\n" + run + "\nmore"), (None, run), (6, "w " * 100_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs = docs.selectExpr("*", "1 AS pos", "2 AS line", "3 AS h1", "'x' AS start")
    found = D.dedup_lines(docs)
    assert found.drop("__lines", "__removed").columns == docs.columns
    got = sorted(((r.doc_id, r.text, r["__lines"], r["__removed"]) for r in found.collect()), key=str)
    # The null id comes first, so its copy stays; both rows of document 4 lose theirs.
    assert got == sorted([
        (1, None, 0, 0), (2, "", 1, 0), (3, "\n\n", 3, 0), (4, "", 12, 12), (4, "", 12, 12),
        (5, "own line\nmore", 14, 12), (None, run, 12, 0), (6, "w " * 100_000, 1, 0)], key=str)
    assert D.dedup_lines(docs.limit(0)).count() == 0


def test_many_lines(spark):
    text = "\n".join(f"only here {i}" for i in range(20_000))
    docs = spark.createDataFrame([(1, text), (2, "x\n" + text)], "doc_id long, text string")
    got = {r.doc_id: r.text for r in D.dedup_lines(docs).collect()}
    assert got == {1: text, 2: "x"}


def test_no_python_in_the_plan(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    plan = D.dedup_lines(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
