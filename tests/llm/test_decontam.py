import re
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import ORACLE
from tests.llm.fixtures import awkward, nothing
from tests.oracle import assert_same
from trainkit.llm import decontam, queries


def words(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def brute(text, items, window=13):
    doc, hit, found = words(text), set(), set()
    for item, item_text in items:
        w = words(item_text)
        if not w:
            continue
        n = min(len(w), window)
        keys = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
        for i in range(len(doc) - n + 1):
            if tuple(doc[i : i + n]) in keys:
                hit.update(range(i, i + n))
                if item is not None:
                    found.add(str(item))
    return len(doc), len(hit), sorted(found)


def longest(text, item_text, window=13):
    """Words of the longest verbatim match that holds a window."""
    doc, w = words(text), words(item_text)
    best = 0
    for i in range(len(doc)):
        for j in range(len(w)):
            n = 0
            while i + n < len(doc) and j + n < len(w) and doc[i + n] == w[j + n]:
                n += 1
            best = max(best, n)
    return best if best >= min(window, max(1, len(w))) else 0


ITEMS = [
    (1, "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen"),
    (2, "a short item"),
    (3, "One two THREE four five six seven eight nine ten eleven twelve thirteen"),
    (4, None),
    (5, ""),
    (None, "a short item"),
    (None, "only here"),
    (6, "à la carte \U0001f600"),
    (2, "a short item"),
    (10, "the cat sat on"),
]
TEXTS = [
    "x one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen y",
    "two three four five six seven eight nine ten eleven twelve thirteen fourteen",
    "A short item, a SHORT item; a short a short item",
    "one two three",
    "only here it is",
    "",
    None,
    "menu à la carte \U0001f600 !",
    "filler " * 300 + "a short item",
    "one two three four five six seven eight nine ten eleven twelve thirteen one two three four five six seven eight nine ten eleven twelve thirteen",
]


@pytest.mark.parametrize("block_words", [1_000_000, 5])
def test_against_brute_force(spark, block_words):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").repartition(2)
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = {r.c0: r for r in decontam.match(docs, bench, [F.col("doc_id")], block_words=block_words).collect()}
    for i, text in enumerate(TEXTS):
        r = got[i]
        assert (r.n_words, r.n_hit, r.item_ids) == brute(text, ITEMS)
        assert sum(s.stop - s.start for s in r.spans) == r.n_hit
        check_matches(text, r.matches, ITEMS)
        assert r.longest == max((longest(text, x) for _, x in ITEMS), default=0)


def check_matches(text, matches, items):
    """Every item's longest match, and the same words at both places."""
    doc = words(text)
    best = {}
    for m in matches:
        texts = [words(x) for item, x in items if (str(item) if item is not None else None) == m.item_id]
        assert any(doc[m.start : m.start + m.length] == w[m.item_start : m.item_start + m.length] for w in texts)
        best[m.item_id] = max(m.length, best.get(m.item_id, 0))
    want = {}
    for item, x in items:
        n = longest(text, x)
        if n:
            key = str(item) if item is not None else None
            want[key] = max(n, want.get(key, 0))
    assert best == want


def test_two_adjacent_windows_are_no_longer_match(spark):
    left, right = (" ".join(f"{c}{i}" for i in range(13)) for c in "ab")
    bench = spark.createDataFrame([(1, left), (2, right)], "item_id long, text string")
    row = decontam.match(spark.createDataFrame([(1, f"{left} {right}")], "doc_id long, text string"), bench, [F.col("doc_id")]).first()
    assert (row.n_hit, row.longest, len(row.spans), [m.length for m in row.matches]) == (26, 13, 1, [13, 13])


def test_places_in_an_item(spark):
    item = " ".join(f"i{k}" for k in range(200))
    bench = spark.createDataFrame([(7, item)], "item_id long, text string")
    docs = spark.createDataFrame([(1, " ".join(f"i{k}" for k in range(90, 140)))], "doc_id long, text string")
    row = decontam.match(docs, bench, [F.col("doc_id")]).first()
    assert (row.n_hit, row.longest, row.matches[0].item_start) == (50, 50, 90)


def test_many_windows_and_small_shards(spark, monkeypatch):
    import random

    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(300)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randrange(3, 60)))) for i in range(60)]
    texts = []
    for _ in range(120):
        text = rng.choices(vocabulary, k=rng.randrange(200))
        for _ in range(rng.randrange(3)):
            passage = words(rng.choice(items)[1])
            text += passage[rng.randrange(5) :]
        texts.append(" ".join(text))
    monkeypatch.setattr(decontam, "SHARD_WORDS", 500)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = decontam.match(docs, spark.createDataFrame(items, "item_id long, text string"), [F.col("doc_id")]).collect()
    assert all((r.n_words, r.n_hit, r.item_ids) == brute(texts[r.c0], items) for r in got)
    for r in got[:40]:
        check_matches(texts[r.c0], r.matches, items)


def test_awkward_rows(spark):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = decontam.match(awkward(spark), bench, [F.col("doc_id"), F.col("score")]).collect()
    assert len(got) == 11
    shorter = decontam.match(awkward(spark), bench, [F.col("doc_id"), F.col("score")], block_words=3).collect()
    assert sorted((str(r.c0), r.n_hit, r.item_ids) for r in got) == sorted((str(r.c0), r.n_hit, r.item_ids) for r in shorter)
    assert {r.c0: r.item_ids for r in got}[1] == ["10"]
    assert decontam.match(nothing(spark), bench, [F.col("doc_id")]).count() == 0
    none = decontam.match(awkward(spark), spark.createDataFrame([], "item_id long, text string"), [F.col("doc_id")])
    assert none.agg(F.sum("n_hit")).first()[0] == 0


def test_digest_of_nothing(spark):
    got = spark.createDataFrame([([],), (["1", "10", "2"],)], "item_ids array<string>").select(decontam.items_digest().alias("d")).collect()
    assert [r.d for r in got] == [sha256(b"").hexdigest(), sha256(b"1,10,2").hexdigest()]


def test_twin(spark):
    assert_same(queries.op8_decontamination(spark, ORACLE), queries.OP8_SQL, ORACLE)


def test_repeated_lines_cost_their_places(spark):
    """A line repeated 20,000 times against a like item: time and space in proportion, results as by brute force on a small one."""
    import resource
    import time

    for line in ("again", "left right", "one two three"):
        small = [" ".join([line] * n) for n in (30, 57)]
        bench = [(1, small[0]), (2, small[1] + " then"), (3, line)]
        docs = [f"x {small[1]} y {small[0]} then", small[0], line, f"{line} then"]
        got = {r.c0: r for r in decontam.match(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string"), [F.col("doc_id")]).collect()}
        for i, text in enumerate(docs):
            assert (got[i].n_words, got[i].n_hit, got[i].item_ids) == brute(text, bench)
            check_matches(text, got[i].matches, bench)
        known = decontam.Suffixes([("1", 0, (line * 1 + " ").encode().split() * 3000)], 13)
        words_ = ((line + " ") * 20_000).encode().split()
        ids = np.array([known.vocabulary[w] for w in words_] + [0])
        began, before = time.perf_counter(), resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
        change, best = known.search(ids, np.array([0, len(ids)]))
        assert time.perf_counter() - began < 20 and resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 400_000
        assert (np.cumsum(change[:-1]) > 0).sum() == len(words_) and best[0, 2] == 3000 * len(line.split())


def test_random_texts_of_few_words(spark):
    """Small alphabets, so that windows repeat within items and across them."""
    import random

    rng = random.Random(17)
    items = [(i % 20, " ".join(rng.choices("ab", k=rng.randrange(1, 40)))) for i in range(24)]
    texts = [" ".join(rng.choices("abab" if i % 2 else "aaaab", k=rng.randrange(1, 120))) for i in range(30)]
    got = decontam.match(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), [F.col("doc_id")], window=5).collect()
    for r in got:
        assert (r.n_words, r.n_hit, r.item_ids) == brute(texts[r.c0], items, 5)
        best = {}
        for i, x in items:
            n = longest(texts[r.c0], x, 5)
            if n:
                best[str(i)] = max(n, best.get(str(i), 0))
        mine = {}
        for m in r.matches:
            mine[m.item_id] = max(m.length, mine.get(m.item_id, 0))
        assert mine == best
