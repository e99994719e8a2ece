"""Fill-in-the-middle against slicing the token list, and the exact way back."""

import hashlib
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from riskframe.llm import fill_middle as M
from riskframe.llm.queries import op12

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plain(doc_id, text):
    text, digest = text or "", hashlib.sha256(f"42:{'null' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    units = TOKEN.findall(text)
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 50:
        return len(units), "plain", None, None, text
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    spm = h[3] % 100 < 80
    return len(units), "spm" if spm else "psm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}"


ODD = [None, "", " ", "\n\t ", "one", " one two", "one two  \n", "a <P> b", "<M>", "<", "<< P> < M>", "é ü x 漢字 \U0001f600", "word " * 400_000, "x" * 10**6, " " * 10**6]


def test_odd_rows_and_extra_columns(spark):
    rows = [(i, t) for i in (*range(40), None) for t in (ODD[:12] if i != 7 else ODD)] + [(1, "one two three")] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS n", "2 AS form", "3 AS output")
    found = M.fill_in_middle(docs)
    assert found.columns == ["doc_id", "text", "n", "form", "output", "__fim"]
    found = found.select("doc_id", "text", "__fim.*", M.restore("__fim.output", "__fim.form").alias("back")).collect()
    assert len(found) == len(rows)
    for r in found:
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == plain(r.doc_id, r.text)
        assert r.back == (r.text or "")
    assert {r.form for r in found} == {"plain", "psm", "spm"}
    assert M.fill_in_middle(docs.limit(0)).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.text("<>PSM a\né漢", max_size=30), st.integers(0, 50), st.integers(0, 50), st.booleans())
def test_any_text_comes_back(text, a, b, spm):
    raw = text.encode()
    n, form, prefix, middle, output = M.arrange(raw, (a, b), False, spm)
    assert n == len(TOKEN.findall(text)) and M.rearrange_back(output, form) == raw
    assert (form == "plain") == (not text or bool(re.search("<[PSM]>", text)))


def test_rotation_in_blocks(monkeypatch):
    monkeypatch.setattr(M, "SWAP", 3)
    for size in range(14):
        for cut in range(size + 1):
            x = np.arange(size, dtype=np.uint8)
            M.rotate(x, 0, cut, size)
            assert x.tolist() == [*range(cut, size), *range(cut)]


def test_query_gives_digests(spark, sf):
    rows = {r.doc_id: r for r in op12(spark, sf).collect()}
    for d in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect():
        n, form, prefix, middle, output = plain(d.doc_id, d.text)
        digests = [hashlib.sha256(t.encode()).hexdigest() for t in (output, d.text or "")]
        assert tuple(rows[d.doc_id]) == (d.doc_id, n, form, prefix, middle, *digests)
