"""Decontamination against a plain search, and on re-parameterised questions."""

import re

import pyarrow.parquet as pq

from riskframe.llm import decontaminate as D
from riskframe.llm.queries import op3


def test_verbatim_items_are_found_and_nothing_else(spark):
    path = "/root/testdata/sf0.01"
    docs = pq.read_table(f"{path}/documents.parquet").to_pylist()
    items = {r["item_id"]: re.findall(r"\w+", r["text"].lower()) for r in pq.read_table(f"{path}/benchmark.parquet").to_pylist()}
    index = {}
    for i, words in items.items():
        for k in range(len(words) - 4):
            index.setdefault(tuple(words[k : k + 5]), set()).add((i, k))
    want = set()
    for r in docs:
        words, seen = re.findall(r"\w+", r["text"].lower()), {}
        for k in range(len(words) - 4):
            for i, at in index.get(tuple(words[k : k + 5]), ()):
                seen.setdefault(i, set()).add(at)
        want |= {(r["doc_id"], i) for i, at in seen.items() if len(at) >= 0.9 * (len(items[i]) - 4)}
    got = {(r.doc_id, r.item_id): r for r in op3(spark, path).collect()}
    assert want and want <= set(got) and len(got) <= len(want) + 2
    assert all(got[k].kind == "exact" and got[k].consistency >= 0.8 for k in want)


ITEM = "On Monday morning the farmer Anna Smith sells 12 apples to her neighbour Tom and then Anna Smith walks 3 km home with 12 coins in her pocket."
OTHER = "On Tuesday morning the farmer Maria sells 45 apples to her neighbour Pedro and then Maria walks 7 miles home with 45 coins in her pocket."
MIXED = "On Monday morning the farmer Anna sells 12 apples to her neighbour Tom and then Paul walks 3 km home with 99 coins in her pocket."


def found(spark, docs, items, **more):
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS item_id", "2 AS pos", "3 AS h")
    b = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS doc_id", "2 AS size")
    return {(r.doc_id, r.item_id): r for r in D.contaminated(d, b, **more).collect()}


def test_templates_and_slots(spark):
    padded = "Some words before it, and more. " + OTHER + " And then some words after it."
    docs = [(1, ITEM), (2, padded), (3, ITEM.upper()), (4, ITEM.lower().replace(" ", "\n")), (5, "Nothing of that kind is here at all, not a word."),
            (6, ITEM.replace("12 apples", "12apples").replace("3 km", "3km"))]
    got = found(spark, docs, [(10, ITEM)])
    assert {k[0] for k in got} == {1, 2, 3, 4, 6}
    assert got[1, 10].kind == "exact" and got[2, 10].kind == "reparameterised" and got[3, 10].kind == "exact"


def test_inconsistent_slots_are_another_question(spark):
    strict = found(spark, [(1, MIXED)], [(10, ITEM)], coverage=0.5, consistency=1.0)
    assert strict == {}
    assert found(spark, [(1, OTHER)], [(10, ITEM)], coverage=0.5, consistency=1.0)[1, 10].kind == "reparameterised"


def test_odd_rows(spark):
    long = "word " * 300_000 + ITEM
    docs = [(1, None), (2, ""), (3, "?! ..."), (None, ITEM), (4, ITEM), (4, ITEM), (5, long), (6, "1 2 3 4 5 6 7 8 9")]
    items = [(10, ITEM), (11, ITEM + "!"), (12, None), (13, "too short"), (14, ""), (10, ITEM), (15, "9 8 7 6 5 4 3 2 1")]
    got = found(spark, docs, items)
    assert set(got) == {(None, 10), (4, 10), (5, 10)}  # items of one template are one class; digits alone are compared as such
    kept = D.remove_contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 3, 6]
    assert found(spark, docs[:0], items) == {} and found(spark, docs, items[:0]) == {}


def test_common_passages_alone_find_nothing(spark):
    shared = "please answer the following question with a single word and explain why you think so"
    items = [(i, f"{shared} number{i} alpha{i} beta{i} gamma{i} delta{i} epsilon{i} zeta{i} eta{i}") for i in range(30)]
    docs = [(1, shared), (2, items[3][1])]
    assert set(found(spark, docs, items)) == {(2, 3)}


def test_items_that_differ_in_numbers_only(spark):
    text = "On each market day the old farmer sells {} apples and buys {} pears at market today"
    items = [(1, text.format(12, 12)), (2, text.format(12, 30)), (3, text.format(12, 30) + "!")]
    docs = [(1, items[0][1]), (2, items[1][1]), (3, f"{items[1][1]}. Later: {items[0][1]}"), (4, "nothing of that kind is in here")]
    got = found(spark, docs, items)
    assert set(got) == {(1, 1), (1, 2), (2, 2), (3, 1), (3, 2)}
    assert {k for k, r in got.items() if r.kind == "exact"} == {(1, 1), (2, 2), (3, 1), (3, 2)}
    kept = D.remove_contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert [r.doc_id for r in kept.collect()] == [4]
    names = D.item_names(spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.member, r.item_id) for r in names.collect()} == {(1, 1), (2, 2), (3, 2)}


def test_names_that_open_sentences(spark):
    text = "{0} sells 12 apples. {1} buys 3 of them at the market and {0} Smith walks home with 9 coins left over."
    items = [(1, text.format("Anna", "Tom")), (2, "When the train leaves, how far is the next station from here?")]
    docs = [(1, text.format("Maria", "Pedro")), (2, "Read this. " + text.format("Rose", "Will").replace("12", "45")), (3, items[0][1].lower()),
            (4, "How the train leaves, how far is the next station from here?"), (5, "She will come when the rose is out, and when they ask how, he will tell.")]
    got = found(spark, docs, items)
    assert {k: r.kind for k, r in got.items() if k[1] == 1} == {(1, 1): "reparameterised", (2, 1): "reparameterised", (3, 1): "exact"}
    assert D.ordinary_words(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")) == {"when"}


def test_items_shorter_than_a_window(spark):
    items = [(1, "boil water slowly"), (2, "Peter bakes fresh bread"), (3, "zyzzyva"), (4, None), (5, "?!")]
    docs = [(1, "First boil water, slowly."), (2, "Then Maria bakes fresh bread there"), (3, "a zyzzyva is a weevil"), (4, "boil the water slowly; he bakes bread"), (5, "Peter bakes fresh bread")]
    got = found(spark, docs, items)
    assert {k: r.kind for k, r in got.items()} == {(1, 1): "exact", (2, 2): "reparameterised", (3, 3): "exact", (5, 2): "exact"}
