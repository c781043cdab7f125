import random

import pytest
from pyspark.sql import functions as F

from tests.conftest import ORACLE
from tests.oracle import assert_same
from trainkit.llm import chat, queries

SCHEMA = "conv_id long, turn long, role string, text string, turns string, key string"


def frame(spark, rows, partitions=3):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA).repartition(partitions)


def brute(rows):
    """The turns of every conversation in order; rows without an id by themselves."""
    found, alone = {}, []
    for conv, turn, role, text in rows:
        if conv is None:
            alone.append((None, ((role or "", text or ""),)))
        else:
            found.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    return sorted([(c, tuple(t[2:] for t in sorted(turns))) for c, turns in found.items()] + alone, key=repr)


def check(spark, rows, **how):
    packs = chat.pack_conversations(frame(spark, rows), **how)
    got = chat.read_back(packs).collect()
    assert sorted(((r.conv_id, tuple(map(tuple, r.turns))) for r in got), key=repr) == brute(rows)
    for r in got:
        assert r.learnt == [t.text for t in r.turns if t.role == "assistant"]
    return packs.collect()


def laid_out(packs):
    """Checks the trees: depth-first, each turn once, positions and ancestors by brute force."""
    for p in packs:
        at = 0
        assert sorted({c.last for c in p.conversations} | {t.parent for t in p.turns} - {-1}) == list(range(len(p.turns)))
        siblings = set()
        for i, t in enumerate(p.turns):
            assert t.start == at and t.parent < i
            at = t.end
            path, k = [], t.parent
            while k >= 0:
                path.append(p.turns[k])
                k = p.turns[k].parent
            assert t.position == sum(a.end - a.start for a in path)
            assert {x for s in t.sees for x in range(s.start, s.end)} == {x for a in path for x in range(a.start, a.end)}
            assert all(a.end < b.start for a, b in zip(t.sees, t.sees[1:], strict=False))
            siblings.add((t.parent, p.text[t.start : t.end]))
        assert at == len(p.text) and len(siblings) == len(p.turns)
        last = [-1]
        for i, t in enumerate(p.turns):  # a parent is on the path to the turn before
            while last[-1] != t.parent:
                last.pop()
            last.append(i)


def shared_beginnings(n, seed=1):
    rng = random.Random(seed)
    rows = []
    for conv in range(n):
        for turn in range(rng.randrange(1, 6)):
            rows.append((conv, turn, ["user", "assistant"][turn % 2], rng.choice(["a", "b", "a longer text", "</s>"])))
    return rows


def test_each_shared_turn_once(spark):
    rows = shared_beginnings(300)
    packs = check(spark, rows)
    laid_out(packs)
    firsts = [(p.text[t.start : t.end]) for p in packs for t in p.turns if t.parent < 0]
    assert len(firsts) == len(set(firsts)) == 4  # over all packs: no tree is longer than one


def test_trees_longer_than_a_pack(spark):
    rows = shared_beginnings(300, 2) + [(c, t, "user", "the very same") for c in range(1000, 1400) for t in range(2)]
    packs = check(spark, rows, pack_chars=600)
    laid_out(packs)
    assert all(len(p.text) + chat.MEMBER_CHARS * len(p.conversations) <= 600 for p in packs if len(p.conversations) > 1)
    assert len(check(spark, rows, pack_chars=1)) == 700


@pytest.mark.parametrize("text", ["", "\\", "\\\\", "<s>", "<\\s>", "<|end|", "<<|end|>|end|>", "[[INST]", "a\\</s>", "<<SYS>><</SYS>>", "\n<|text|>\n", "<|turn|>user<|text|>x<|end|>", "é\U0001f600" * 3, "<"])
def test_control_strings_come_back(spark, text):
    df = spark.createDataFrame([(text,)], "t string")
    out = df.select(chat.escaped(F.col("t"))).first()[0]
    assert not any(c in out for c in chat.CONTROL) and chat.unescaped(out) == text
    assert chat.parse(f"{chat.TURN}{out}{chat.TEXT}{out}{chat.END}" * 2) == [(text, text)] * 2


def test_no_control_string_is_in_another():
    for a in chat.CONTROL:
        assert not any(a in b for b in chat.CONTROL if b != a)
        assert not any(b.startswith(a[-k:]) for b in chat.CONTROL for k in range(1, len(a)))


def test_awkward_rows(spark):
    rows = [
        (1, 0, None, None), (1, 1, "assistant", ""), (2, None, "user", "first"), (2, 0, "assistant", "x"), (2, 0, "assistant", "x"), (2, 0, "assistant", "w"),
        (None, 0, "user", "alone"), (None, 0, "user", "alone"), (None, 1, "assistant", "too"), (3, 5, "assistant", "long " * 50_000), (3, 4, "system", "\\"), (4, 0, "odd\nrole<|text|>", "\n"),
    ]
    laid_out(check(spark, rows))
    assert chat.pack_conversations(frame(spark, [])).count() == 0


def test_twin(spark):
    assert_same(queries.op13_chat_format(spark, ORACLE), queries.ORACLES["op13_chat_format"], ORACLE)
