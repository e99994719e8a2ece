"""Prefix trees: shared turns once, attention to ancestors only, exact round trips."""

import random

from pyspark.sql import functions as F

from riskframe.llm import chat_tree as C

ODD = ["", "</s>", "<\\/s>", "[INST] <<SYS>> \\ [/INST]", "<s>user\nhi</s>", "é\U0001f600 </s></s>", "a\\\\b<\\\\/s>", "<<s>>", "[[INST]]"]


def test_escapes_are_reversible():
    for text in ODD + ["".join(random.Random(i).choice(["<", "s>", "/", "\\", "[INST]", "</s>", "x", "\n"]) for _ in range(20)) for i in range(300)]:
        safe = C.escape(text)
        assert C.unescape(safe) == text and not any(c in safe for c in C.CONTROL)
        role = C.escape_role(text)
        assert C.unescape_role(role) == text and "\n" not in role and not any(c in role for c in C.CONTROL)


def chats(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def test_shared_turns_are_emitted_once(spark):
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"turn {t}" if t < 3 else f"own {c}.{t}") for c in range(20) for t in range(5)]
    packs = C.pack(chats(spark, rows)).collect()
    nodes = [r for r in packs if not r.is_conversation]
    per_pack = {}
    for r in nodes:
        per_pack.setdefault(r["pack"], {})[r.node] = r
    assert len([r for r in packs if r.is_conversation]) == 20
    # Three shared turns per pack, two own ones per conversation.
    assert len(nodes) == 3 * len(per_pack) + 2 * 20
    for own in per_pack.values():
        for r in own.values():
            up, expected = r, []
            while up is not None:
                expected += range(up.start, up.start + len(up.tokens))
                up = own.get(up.parent)
            assert sorted(expected) == [i for a in r.attention for i in range(a["first"], a["last"])]
            assert r.position == len(expected) - len(r.tokens)
            assert all(a["last"] < b["first"] for a, b in zip(r.attention, r.attention[1:]))


def test_small_packs_and_copies_round_trip(spark):
    rng = random.Random(2)
    rows = [(c, t, rng.choice(["user", "assistant", "a\nb\\"]), rng.choice(ODD)) for c in range(60) for t in range(rng.randint(1, 6))]
    rows += [(100 + c, t, "user", "same") for c in range(50) for t in range(3)]
    frame = chats(spark, rows)
    whole = sorted(map(tuple, C.read_back(C.pack(frame)).collect()))
    small = sorted(map(tuple, C.read_back(C.pack(frame, pack_tokens=40, pack_conversations=3)).collect()))
    assert whole == small and len(whole) == 110
    want = {}
    for c, t, role, text in sorted(rows):
        want.setdefault(c, []).append((role, text))
    for conv, n, _, loss_chars, _, formatted in whole:
        assert n == len(want[conv]) and loss_chars == sum(len(t) for r, t in want[conv] if r == "assistant")
        assert formatted == sum(len(f"<s>{C.escape_role(r)}\n{C.escape(t)}</s>") for r, t in want[conv])


def test_odd_rows(spark):
    rows = [(1, None, None, None), (1, 0, "user", "a"), (1, 0, "user", "a"), (None, 3, "assistant", "b" * 200_000), (2, 5, "assistant", None)]
    frame = chats(spark, rows).withColumn("place", F.lit(1)).withColumn("n", F.lit(2)).withColumn("pack", F.lit(3))
    got = {r.conv_id: r for r in C.read_back(C.pack(frame)).collect()}
    assert {k: (r.n_turns, r.loss_chars) for k, r in got.items()} == {1: (3, 0), None: (1, 200_000), 2: (1, 0)}
    assert C.pack(frame.limit(0)).count() == 0


def test_a_million_blanks_in_a_turn(spark):
    rows = [(1, 0, "user", " " * 10**6), (1, 1, "assistant", "\n" * 10**6 + "x"), (2, 0, "user", "short")]
    chats = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = {r.conv_id: r for r in C.read_back(C.pack(chats)).collect()}
    assert found[1].n_turns == 2 and found[1].loss_chars == 10**6 + 1 and found[2].n_turns == 1
