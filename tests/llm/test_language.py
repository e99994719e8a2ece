"""Language prediction: held-out accuracy, codewords and odd rows."""

import numpy as np
from pyspark.sql import functions as F

from riskframe.llm import language as L
from riskframe.llm.queries import op4


def test_held_out_accuracy(spark):
    path = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{path}/documents.parquet").collect()}
    found = op4(spark, path).collect()
    assert {r.doc_id for r in found} == set(truth)
    held = [r for r in found if r.held_out]
    assert len(held) > 200 and all(0 <= r.score <= 1 for r in found)
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.98


def test_codewords_differ():
    for n in (2, 3, 4, 5, 6, 40):
        code = L.codewords(n)
        apart = [(code[i] != code[j]).sum() for i in range(n) for j in range(i)]
        assert min(apart) >= max(1, code.shape[1] // 4)
        assert (0 < code.sum(axis=0)).all() and (code.sum(axis=0) < n).all()


ROWS = [(i, f"{'the cat and that hat in the barn' if i % 2 else 'der hund und das haus in dem dorf'} {i}", "en" if i % 2 else "de") for i in range(40)]


def test_odd_rows(spark):
    docs = spark.createDataFrame(
        ROWS + [(100, None, "en"), (101, "", "de"), (102, "12 34 !?", None), (None, "the hat", None), (103, "THE CAT " * 200_000, None), (1, ROWS[1][1], None)],
        "doc_id long, text string, lang string").withColumn("lang_pred", F.lit("x")).withColumn("score", F.lit(3))
    found = L.identify(docs, docs.filter("doc_id < 40"))
    assert found.drop("__language").columns == docs.columns
    got = {(r.doc_id, r.text and r.text[:8]): r["__language"] for r in found.collect()}
    for key in ((100, None), (101, ""), (102, "12 34 !?")):
        assert got[key].lang_pred == L.UNKNOWN and got[key].score == 0
    assert got[(None, "the hat")].lang_pred == "en" and got[(103, "THE CAT ")].lang_pred == "en"
    assert all(got[(i, t[:8])].lang_pred == lang for i, t, lang in ROWS)


def test_little_to_learn_from(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, lang string")
    nothing = L.identify(docs, docs.limit(0)).collect()
    assert {(r["__language"].lang_pred, r["__language"].score) for r in nothing} == {(L.UNKNOWN, 0.0)}
    single = L.identify(docs, docs.filter("lang = 'de'")).collect()
    assert {(r["__language"].lang_pred, r["__language"].score) for r in single} == {("de", 1.0)}
    assert L.identify(docs.limit(0), docs).count() == 0


def test_batches_do_not_matter(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, lang string")
    model = L.train(docs)
    a = {r.doc_id: r.p.score for r in docs.coalesce(1).select("doc_id", L.predict(model, F.col("text")).alias("p")).collect()}
    b = {r.doc_id: r.p.score for r in docs.repartition(13).select("doc_id", L.predict(model, F.col("text")).alias("p")).collect()}
    assert all(abs(a[k] - b[k]) < 1e-9 for k in a)
