"""Operator 7: chat formatting of conversations as prefix trees.

Conversations that share their first turns share those turns' tokens: sorted by
the chain of their turns they come in depth-first order, and each run of them is
packed into one text in which a shared turn stands once.  Position ids go on
along each branch, and every node lists the token intervals of its ancestors,
which, with the causal part of its own, is all that it may attend to.  Tokens
are code points.

The template is ``<|im_start|>role\\ntext<|im_end|>\\n``.  Inside texts every ``<``
that comes before ``|`` (or before backslashes and ``|``) gets a backslash after it,
so no control string can stand in a text, and taking one away undoes it.

Scale: one shuffle puts a conversation's turns together, one range partition by
(turn chain, conv_id) orders them, so a first turn or a whole conversation that
a third of them share is spread over tasks.  A pack is bounded in tokens and in
conversations; at its start the path to its first conversation is written again.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _spark as S

PACK_TOKENS, PACK_CONVERSATIONS = 1 << 16, 4096
START, END = "<|im_start|>", "<|im_end|>"
LEARNED = "assistant"
_TURN = re.compile(r"<\|im_start\|>(.*?)\n(.*?)<\|im_end\|>\n", re.S)
_NODES = "array<struct<start: int, length: int, position: int, parent: int, loss_start: int, loss_length: int>>"
_PACKS = f"text string, nodes {_NODES}, attend array<array<struct<first: int, end: int>>>, leaves array<struct<conv_id: bigint, node: int>>"


def escape(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\\\1|", text)


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def chain(turns: list[tuple[str, str]]) -> bytes:
    """16 bytes for each turn that depend on it and all before it; a conversation's chain begins with that of each of its beginnings."""
    out, last = [], b""
    for role, text in turns:
        last = hashlib.blake2b(last + hashlib.blake2b(role.encode(), digest_size=16).digest() + text.encode(), digest_size=16).digest()
        out.append(last)
    return b"".join(out)


def _chains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        turns = [[(t["role"], t["text"]) for t in c] for c in batch.column("turns").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("turns"), pa.array([chain(t) for t in turns], pa.binary())], ["conv_id", "turns", "path"])


class _Pack:
    def __init__(self):
        self.parts: list[str] = []
        self.size = 0
        self.nodes: list[dict] = []
        self.attend: list[list[dict]] = []
        self.leaves: list[dict] = []
        self.branch: list[tuple[tuple[str, str], int]] = []

    def shared(self, turns: list[tuple[str, str]]) -> int:
        n = 0
        while n < min(len(turns), len(self.branch)) and self.branch[n][0] == turns[n]:
            n += 1
        return n

    def add(self, conv_id, turns: list[tuple[str, str]]) -> None:
        n = self.shared(turns)
        del self.branch[n:]
        for role, text in turns[n:]:
            head = f"{START}{escape_role(role)}\n"
            body = escape(text)
            whole = f"{head}{body}{END}\n"
            parent = self.branch[-1][1] if self.branch else -1
            above = self.nodes[parent] if self.branch else None
            learned = role == LEARNED
            self.nodes.append({"start": self.size, "length": len(whole), "position": above["position"] + above["length"] if above else 0, "parent": parent, "loss_start": self.size + len(head), "loss_length": len(body) if learned else 0})
            spans = [dict(s) for s in self.attend[parent]] if above else []
            if above:
                if spans and spans[-1]["end"] == above["start"]:
                    spans[-1]["end"] += above["length"]
                else:
                    spans.append({"first": above["start"], "end": above["start"] + above["length"]})
            self.attend.append(spans)
            self.parts.append(whole)
            self.size += len(whole)
            self.branch.append(((role, text), len(self.nodes) - 1))
        self.leaves.append({"conv_id": conv_id, "node": self.branch[-1][1]})

    def row(self) -> dict:
        return {"text": "".join(self.parts), "nodes": self.nodes, "attend": self.attend, "leaves": self.leaves}


_NODE_TYPE = pa.list_(pa.struct([(x, pa.int32()) for x in ("start", "length", "position", "parent", "loss_start", "loss_length")]))
_PACK_SCHEMA = pa.schema([("text", pa.string()), ("nodes", _NODE_TYPE), ("attend", pa.list_(pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32())])))), ("leaves", pa.list_(pa.struct([("conv_id", pa.int64()), ("node", pa.int32())])))])


def _packs(tokens: int, conversations: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = _Pack()
        for batch in batches:
            for conv_id, listed in zip(batch.column("conv_id").to_pylist(), batch.column("turns").to_pylist()):
                turns = [(t["role"], t["text"]) for t in listed]
                if pack.leaves:
                    more = sum(len(r) + len(t) + 32 for r, t in turns[pack.shared(turns) :])
                    if pack.size + more > tokens or len(pack.leaves) >= conversations:
                        yield pa.RecordBatch.from_pylist([pack.row()], _PACK_SCHEMA)
                        pack = _Pack()
                pack.add(conv_id, turns)
        if pack.leaves:
            yield pa.RecordBatch.from_pylist([pack.row()], _PACK_SCHEMA)

    return run


def format_conversations(conversations: DataFrame, tokens: int = PACK_TOKENS, most: int = PACK_CONVERSATIONS) -> DataFrame:
    """Packs (text, nodes, attend, leaves) of conversations (conv_id, turn, role, text).

    nodes, in depth-first order: where a turn's tokens start, how many there
    are, the position id of the first, the parent's index (-1: none), and the
    tokens under the loss mask (texts of assistant turns).  attend: for each
    node the token intervals of its ancestors.  leaves: each conversation's last node.

    Rows of a conversation are ordered by turn (null first), then role and text;
    repeated rows are turns of their own.  Null roles and texts read as empty.
    Rows with a null conv_id are one conversation.  An empty table gives an
    empty result; other columns are not read.  A conversation is one unit of
    work: its turns must fit a task.
    """
    S.small_batches(conversations)
    n = S.partitions(S.slices(conversations))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).alias("t"))
    whole = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t"), _before).alias("turns"))
    paths = whole.mapInArrow(S.tidy(_chains), "conv_id long, turns array<struct<turn: bigint, role: string, text: string>>, path binary")
    return paths.repartitionByRange(n, "path", "conv_id").sortWithinPartitions("path", "conv_id").select("conv_id", "turns").mapInArrow(S.tidy(_packs(tokens, most)), _PACKS)


def _before(a, b):
    def place(x):
        return F.struct(x["turn"].isNotNull(), x["turn"], x["role"], x["text"])

    return F.when(place(a) < place(b), -1).when(place(b) < place(a), 1).otherwise(0)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: dict[str, list] = {k: [] for k in ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "turns")}
        for pack in batch.to_pylist():
            known: dict[int, tuple] = {}
            for leaf in pack["leaves"]:
                if leaf["node"] not in known:
                    known[leaf["node"]] = _branch(pack, leaf["node"])
                for k, v in zip(out, (leaf["conv_id"], *known[leaf["node"]])):
                    out[k].append(v)
        turn = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), turn]
        yield pa.RecordBatch.from_arrays([pa.array(v, kind) for v, kind in zip(out.values(), kinds)], list(out))


def _branch(pack: dict, node: int) -> tuple:
    nodes = []
    while node >= 0:
        nodes.append(pack["nodes"][node])
        node = nodes[-1]["parent"]
    text = pack["text"]
    formatted, loss = [], []
    for x in reversed(nodes):
        formatted.append(text[x["start"] : x["start"] + x["length"]])
        loss.append(unescape(text[x["loss_start"] : x["loss_start"] + x["loss_length"]]))
    whole, learned = "".join(formatted), "".join(loss)
    turns = [(unescape_role(m[1]), unescape(m[2])) for m in _TURN.finditer(whole)]
    said = "".join(f"{role}\n{said}\n" for role, said in turns)
    return len(turns), hashlib.sha256(said.encode()).hexdigest(), len(learned), hashlib.sha256(learned.encode()).hexdigest(), len(whole), [{"role": r, "text": t} for r, t in turns]


def read_packs(packs: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, turns), read back from format_conversations().

    One row for each leaf of each pack; a null conv_id stays null.  Empty texts and roles come
    back as empty ones.  An empty table gives an empty result; other columns are not read.
    """
    S.small_batches(packs)
    return packs.select("text", "nodes", "leaves").mapInArrow(S.tidy(_read), "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, turns array<struct<role: string, text: string>>")
