"""Conversations formatted as training sequences that hold shared beginnings once.

A turn is formatted as control strings around its role and text; control strings inside them are broken by a
backslash, and backslashes are doubled, so that the original comes back.  Conversations that begin with the same turns form a
prefix tree.  It is laid out depth-first: every turn of the tree appears once in the text of its pack, with the position at which it
stands in its conversations and the intervals of its ancestors, which is what it may attend to besides itself.  Tokens are
code points.

Conversations are dealt out by their first turn and sorted by the digests of their turns, so that a tree's come one after the other, and
tasks build the trees from that stream.  Trees that could be longer than a pack are dealt out by all their turns and the id, so that one
first turn or one conversation that very many share spreads over many tasks.  A pack ends where a tree ends, unless a tree is longer than
a pack: then it goes on in the next one, which repeats the turns that lead there.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trainkit.llm.common import cut, tasks_for
from trainkit.operators.split import small

# The template's own control strings, and those of other templates, which texts must not smuggle in either.
TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
CONTROL = (TURN, TEXT, END, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>")
LEARNT_ROLE = "assistant"

PACK_CHARS = 1 << 20  # code points of a pack
MEMBER_CHARS = 16  # that a conversation counts besides the turns it adds, so that copies fill packs too
DIGEST_BYTES = 16

_TURN = re.compile(f"{re.escape(TURN)}(.*?){re.escape(TEXT)}(.*?){re.escape(END)}", re.S)
_ESCAPED = re.compile(r"\\(.)", re.S)

SPAN = pa.struct([("start", pa.int32()), ("end", pa.int32())])
TURNS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("position", pa.int32()), ("parent", pa.int32()), ("learn_from", pa.int32()), ("learn_to", pa.int32()), ("sees", pa.list_(SPAN))]))
MEMBERS = pa.list_(pa.struct([("conv_id", pa.int64()), ("last", pa.int32())]))
PACKS = (
    "text string, turns array<struct<start:int,end:int,position:int,parent:int,learn_from:int,learn_to:int,sees:array<struct<start:int,end:int>>>>, "
    "conversations array<struct<conv_id:long,last:int>>"
)


def escaped(text: Column) -> Column:
    """The text without control strings: backslashes doubled, and one behind the first sign of each control string."""
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for control in CONTROL:  # none of them is part of another
        out = F.replace(out, F.lit(control), F.lit(f"{control[0]}\\{control[1:]}"))
    return out


def unescaped(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def parse(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) of every turn."""
    return [(unescaped(role), unescaped(text)) for role, text in _TURN.findall(formatted)]


def formatted_turns(rows: DataFrame) -> DataFrame:
    """(conv_id, key, chars, turns): a row per conversation, its formatted turns in order and the digests of them."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    head = F.concat(F.lit(TURN), escaped(role), F.lit(TEXT))
    alone = F.when(F.col("conv_id").isNull(), F.monotonically_increasing_id())
    ordered = rows.select("conv_id", alone.alias("alone"), F.struct(F.col("turn"), role.alias("role"), text.alias("text"), head.alias("head"), escaped(text).alias("body")).alias("t"))
    whole = ordered.groupBy("conv_id", "alone").agg(F.sort_array(F.collect_list("t")).alias("t"))
    turns = F.transform(
        "t",
        lambda t: F.struct(
            F.concat(t["head"], t["body"], F.lit(END)).alias("formatted"),
            F.when(t["role"] == LEARNT_ROLE, F.char_length(t["head"])).alias("learn_from"),
            F.when(t["role"] == LEARNT_ROLE, F.char_length(t["head"]) + F.char_length(t["body"])).alias("learn_to"),
        ),
    )
    made = whole.select("conv_id", turns.alias("turns"))
    key = F.unhex(F.array_join(F.transform("turns", lambda t: F.md5(t["formatted"].cast("binary"))), ""))
    chars = F.aggregate("turns", F.lit(0).cast("long"), lambda n, t: n + F.char_length(t["formatted"]))
    return made.select("conv_id", key.alias("key"), chars.alias("chars"), "turns")


class Layout:
    """Turns laid out one behind the other; `stack` is the path to the last one: (formatted text, number)."""

    def __init__(self) -> None:
        self.pieces: list[str] = []
        self.turns: list[dict] = []
        self.members: list[dict] = []
        self.stack: list[tuple[str, int]] = []
        self.length = 0

    def size(self) -> int:
        return self.length + MEMBER_CHARS * len(self.members)

    def shared(self, path: list[dict]) -> int:
        """Leading turns that the path has in common with the stack."""
        n = 0
        while n < min(len(path), len(self.stack)) and self.stack[n][0] == path[n]["formatted"]:
            n += 1
        return n

    def add(self, conv_id: int | None, path: list[dict]) -> None:
        del self.stack[self.shared(path) :]
        for turn in path[len(self.stack) :]:
            parent = self.stack[-1][1] if self.stack else -1
            position, sees = 0, []
            if self.stack:
                above = self.turns[parent]
                position = above["position"] + above["end"] - above["start"]
                sees = [*above["sees"], {"start": above["start"], "end": above["end"]}]
                if len(sees) > 1 and sees[-2]["end"] == sees[-1]["start"]:
                    sees[-2:] = [{"start": sees[-2]["start"], "end": sees[-1]["end"]}]
            text, at = turn["formatted"], self.length
            learn = [None if turn[x] is None else at + turn[x] for x in ("learn_from", "learn_to")]
            self.stack.append((text, len(self.turns)))
            self.turns.append({"start": at, "end": at + len(text), "position": position, "parent": parent, "learn_from": learn[0], "learn_to": learn[1], "sees": sees})
            self.pieces.append(text)
            self.length += len(text)
        self.members.append({"conv_id": conv_id, "last": self.stack[-1][1]})

    def append(self, tree: Layout) -> None:
        """Another layout behind this one."""
        by, number = self.length, len(self.turns)
        moved = lambda x: None if x is None else x + by
        self.pieces += tree.pieces
        for t in tree.turns:
            sees = [{"start": s["start"] + by, "end": s["end"] + by} for s in t["sees"]]
            self.turns.append(t | {k: moved(t[k]) for k in ("start", "end", "learn_from", "learn_to")} | {"parent": t["parent"] + number if t["parent"] >= 0 else -1, "sees": sees})
        self.members += [m | {"last": m["last"] + number} for m in tree.members]
        self.length += tree.length

    def row(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(["".join(self.pieces)]), pa.array([self.turns], TURNS), pa.array([self.members], MEMBERS)], names=["text", "turns", "conversations"])


def packed(conversations: Iterator[tuple[int | None, list[dict]]], pack_chars: int) -> Iterator[Layout]:
    """Packs of the trees that neighbouring conversations form."""
    pack, tree = Layout(), Layout()
    for conv_id, path in conversations:
        ends = tree.members and not tree.shared(path)
        if ends or tree.members and tree.size() + MEMBER_CHARS + sum(len(t["formatted"]) for t in path[tree.shared(path) :]) > pack_chars:
            if pack.members and pack.size() + tree.size() > pack_chars:
                yield pack
                pack = Layout()
            pack.append(tree)
            tree = Layout()
            if not ends:  # a tree that is longer than a pack
                yield pack
                pack = Layout()
        tree.add(conv_id, path)
    if tree.members:
        if pack.members and pack.size() + tree.size() > pack_chars:
            yield pack
            pack = Layout()
        pack.append(tree)
    if pack.members:
        yield pack


def pack_conversations(rows: DataFrame, pack_chars: int = PACK_CHARS) -> DataFrame:
    """(text, turns, conversations), a row per pack.

    `turns` has, in the order of the text, each turn's interval (code points), the position of its first token in its conversations, the number of the turn
    before it (-1: none), the interval that is learnt (the escaped text of assistant turns, else null) and the intervals of
    its ancestors.  `conversations` has each conversation's id and last turn.

    `rows` has conv_id, turn, role and text; other columns are left out, whatever their names.  Turns of one number follow each other by
    role and text, repeated rows stay, null numbers come first.  Null roles and texts are empty.  A row without conv_id is
    a conversation of its own, under a null id.  A conversation fits in a row.  An empty table gives no packs.
    """
    spark = rows.sparkSession
    made = cut(formatted_turns(rows)).withColumn("first", F.substring("key", 1, DIGEST_BYTES))
    trees = made.groupBy("first").agg(F.sum(F.col("chars") + MEMBER_CHARS).alias("size")).where(F.col("size") > pack_chars)
    dealt = made.join(small(trees.select(F.col("first").alias("large"))), F.col("first") == F.col("large"), "left")
    spread = F.when(F.col("large").isNotNull(), F.struct("key", "conv_id"))
    ordered = dealt.withColumn("spread", spread).repartitionByRange(tasks_for(spark), "first", "spread").sortWithinPartitions("key", "conv_id").select("conv_id", "turns")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = (row for batch in batches for row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
        for layout in packed(stream, pack_chars):
            yield layout.row()

    return ordered.mapInArrow(build, PACKS)


def read_back(packs: DataFrame) -> DataFrame:
    """(conv_id, turns, learnt, formatted_chars): conversations read from the packs: what the last turn sees and itself, parsed; `learnt` has the texts under the loss mask."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, turns, members in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                for start in range(0, len(members), 256):
                    yield _conversations(text, turns, members[start : start + 256])

    return packs.select("text", "turns", "conversations").mapInArrow(read, "conv_id long, turns array<struct<role:string,text:string>>, learnt array<string>, formatted_chars long")


def _conversations(text: str, turns: list[dict], members: list[dict]) -> pa.RecordBatch:
    ids, said, learnt, chars = [], [], [], []
    for member in members:
        last = turns[member["last"]]
        formatted = "".join(text[s["start"] : s["end"]] for s in [*last["sees"], last])
        path, at = [], member["last"]
        while at >= 0:
            path.append(turns[at])
            at = turns[at]["parent"]
        ids.append(member["conv_id"])
        said.append([{"role": r, "text": t} for r, t in parse(formatted)])
        learnt.append([unescaped(text[t["learn_from"] : t["learn_to"]]) for t in reversed(path) if t["learn_from"] is not None])
        chars.append(len(formatted))
    said_type = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(said, said_type), pa.array(learnt, pa.list_(pa.string())), pa.array(chars, pa.int64())], names=["conv_id", "turns", "learnt", "formatted_chars"])
