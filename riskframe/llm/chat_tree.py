"""Chat formatting as packed prefix trees.

Conversations are sorted by the hashes of their turns, so those that share initial turns stand
together, and turns stream through in that order: a turn on the path of the conversation before
is not emitted again, any other becomes a node. Nodes come out depth-first; each carries
its tokens, where they start in the pack, the position id of its first token (its depth in tokens)
and the intervals of the pack it may attend to: its ancestors and itself, merged where they touch.
A pack ends after some thousand tokens or conversations; the next one starts with a whole path.

A turn reads ``<s>role\\ntext</s>``. Control strings inside texts and roles get a backslash after their
first character (and one more where there are some already), which unescaping takes away;
backslashes and newlines in roles are escaped too. Marks are tokens of their own that no text can encode to. The loss mask
covers the text of assistant turns and nothing else.

Turns are ordered by turn, then role and text; null turn numbers come first. Null role or text is
an empty string. Repeated rows are turns of their own. Null conv_id is one conversation. An empty
table gives no packs. Other columns are not read. Only one path is held while packing, and one
pack while reading.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.frames import cut_lineage
from .common import null_safe
from .token_counts import PATTERN, VOCABULARY, encode_text, load_encoding, read_vocabulary

OPEN, CLOSE, ASSISTANT = "<s>", "</s>", "assistant"
#: Strings that chat templates use as marks; none of them survives inside a text.
CONTROL = ("<s>", "</s>", "<unk>", "<<SYS>>", "<</SYS>>", "[INST]", "[/INST]")
PACK_TOKENS, PACK_CONVERSATIONS = 32_768, 4_096

_MARK = re.compile("|".join(rf"(?:{re.escape(c[0])}\\*{re.escape(c[1:])})" for c in CONTROL))
_TURN = re.compile(rf"{OPEN}([^\n]*)\n(.*?){CLOSE}", re.DOTALL)

PACK_SCHEMA = """pack long, seq long, node int, parent int, start long, position long, tokens array<int>, loss_from int, loss_to int,
attention array<struct<first:long,last:long>>, conv_id long, is_conversation boolean"""


def escape(text: str) -> str:
    return _MARK.sub(lambda m: m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return _MARK.sub(lambda m: m[0][0] + m[0][2:] if m[0][1] == "\\" else m[0], text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def chat_encoding(vocabulary: bytes):
    """Byte-level BPE with the two marks as tokens of their own."""
    return load_encoding(vocabulary, PATTERN, (OPEN, CLOSE))


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, place (of the conversation in depth-first order), n (from 1), role, text, h1, h2."""
    blank = [F.coalesce(c, F.lit("")).alias(c) for c in ("role", "text")]
    turns = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", *blank)
    n = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text"))
    turns = turns.select("conv_id", n.alias("n"), "role", "text", F.xxhash64("role", "text").alias("h1"), F.xxhash64(F.lit(1), "text", "role").alias("h2"))
    turns = cut_lineage(turns)
    steps = F.array_sort(F.collect_list(F.struct("n", "h1")))
    paths = turns.groupBy("conv_id").agg(F.transform(steps, lambda s: s["h1"]).alias("path"))
    parts = paths.sparkSession.conf.get("spark.sql.shuffle.partitions")
    sorted_paths = paths.repartitionByRange(int(parts), "path", "conv_id").sortWithinPartitions("path", "conv_id")
    places = cut_lineage(sorted_paths.select("conv_id", F.monotonically_increasing_id().alias("place")))
    return null_safe(turns, places, ["conv_id"], "inner")


def pack(conversations: DataFrame, vocabulary: str = VOCABULARY, pack_tokens: int = PACK_TOKENS,
         pack_conversations: int = PACK_CONVERSATIONS) -> DataFrame:
    """Rows of two kinds per pack, in order of seq: nodes, and conversations with the node they end at."""
    shared = conversations.sparkSession.sparkContext.broadcast(read_vocabulary(conversations, vocabulary))
    turns = ordered_turns(conversations)
    parts = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    turns = turns.repartitionByRange(parts, "place").sortWithinPartitions("place", "n")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = chat_encoding(shared.value)
        first_mark, last_mark = encoding.encode_single_token(OPEN), encoding.encode_single_token(CLOSE)
        path: list[tuple] = []  # (hashes, node, end of its tokens along the path, intervals)
        place = conv = None
        number, seq, node, size, held, depth, on_path = 0, 0, 0, 0, 0, 0, True
        rows: list[dict] = []
        row = lambda **x: dict.fromkeys(("node", "parent", "start", "position", "tokens", "loss_from", "loss_to", "attention", "conv_id"), None) | {"pack": number, "seq": seq} | x
        schema = pa.schema([
            ("pack", pa.int64()), ("seq", pa.int64()), ("node", pa.int32()), ("parent", pa.int32()), ("start", pa.int64()), ("position", pa.int64()),
            ("tokens", pa.list_(pa.int32())), ("loss_from", pa.int32()), ("loss_to", pa.int32()),
            ("attention", pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))), ("conv_id", pa.int64()), ("is_conversation", pa.bool_())])

        for batch in batches:
            cols = {name: batch.column(i).to_pylist() for i, name in enumerate(batch.schema.names)}
            for p, c, role, text, h1, h2 in zip(*(cols[x] for x in ("place", "conv_id", "role", "text", "h1", "h2"))):
                if p != place:
                    if place is not None:
                        rows.append(row(node=path[depth - 1][1], conv_id=conv, is_conversation=True))
                        seq, held = seq + 1, held + 1
                        del path[depth:]
                    if place is None or size >= pack_tokens or held >= pack_conversations:
                        number, seq, node, size, held, path = p, 0, 0, 0, 0, []
                    place, conv, depth, on_path = p, c, 0, True
                if on_path and depth < len(path) and path[depth][0] == (h1, h2):
                    depth += 1
                    continue
                on_path = False
                del path[depth:]
                head = [first_mark, *encode_text(encoding, escape_role(role) + "\n")]
                body = encode_text(encoding, escape(text))
                tokens = [*head, *body, last_mark]
                _, parent, position, intervals = path[-1] if path else (None, -1, 0, [])
                mine = (size, size + len(tokens))
                merged = [*intervals[:-1], (intervals[-1][0], mine[1])] if intervals and intervals[-1][1] == size else [*intervals, mine]
                rows.append(row(
                    node=node, parent=parent, start=size, position=position, tokens=tokens, is_conversation=False,
                    loss_from=len(head) if role == ASSISTANT else 0, loss_to=len(head) + len(body) if role == ASSISTANT else 0,
                    attention=[{"first": a, "last": b} for a, b in merged]))
                path.append(((h1, h2), node, position + len(tokens), merged))
                seq, node, size, depth = seq + 1, node + 1, mine[1], depth + 1
            if len(rows) >= 2000:
                yield pa.RecordBatch.from_pylist(rows, schema)
                rows = []
        if place is not None:
            rows.append(row(node=path[depth - 1][1], conv_id=conv, is_conversation=True))
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)

    ordered = turns.select("place", "n", "conv_id", "role", "text", "h1", "h2")
    return ordered.mapInArrow(build, PACK_SCHEMA)


def read_back(packs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """One row per conversation, decoded from its leaf's attention intervals: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    shared = packs.sparkSession.sparkContext.broadcast(read_vocabulary(packs, vocabulary))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = chat_encoding(shared.value)
        at, tokens, mask, leaves = None, np.empty(0, np.int32), np.empty(0, bool), {}
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if r["pack"] != at:
                    at, tokens, mask, leaves = r["pack"], np.empty(1 << 16, np.int32), np.zeros(1 << 16, bool), {}
                if not r["is_conversation"]:
                    new, start = np.array(r["tokens"], np.int32), r["start"]
                    if start + len(new) > len(tokens):
                        grown = 2 * (start + len(new))
                        tokens, mask = np.resize(tokens, grown), np.concatenate((mask, np.zeros(grown - len(mask), bool)))
                    tokens[start : start + len(new)] = new
                    mask[start + r["loss_from"] : start + r["loss_to"]] = True
                    leaves[r["node"]] = [(x["first"], x["last"]) for x in r["attention"]]
                    continue
                spans = leaves[r["node"]]
                own = np.concatenate([tokens[a:b] for a, b in spans])
                told = np.concatenate([mask[a:b] for a, b in spans])
                formatted = encoding.decode_bytes(own.tolist()).decode()
                turns = [(unescape_role(m[1]), unescape(m[2])) for m in _TURN.finditer(formatted)]
                if "".join(f"{OPEN}{escape_role(a)}\n{escape(b)}{CLOSE}" for a, b in turns) != formatted:
                    raise ValueError(f"Conversation {r['conv_id']} can't be read back")
                edges = np.flatnonzero(np.diff(np.concatenate(([False], told, [False])).astype(np.int8)))
                loss = "".join(unescape(encoding.decode_bytes(own[a:b].tolist()).decode()) for a, b in zip(edges[::2], edges[1::2]))
                out.append((
                    r["conv_id"], len(turns), sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest(),
                    len(loss), sha256(loss.encode()).hexdigest(), len(formatted)))
            if out:
                names = ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")
                yield pa.record_batch([pa.array(c, pa.int64() if i in (0, 1, 3, 5) else pa.string()) for i, c in enumerate(zip(*out))], names=list(names))

    dealt = packs.repartition("pack").sortWithinPartitions("pack", "seq")
    return dealt.mapInArrow(read, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
