"""Benchmark decontamination with suffix arrays of the training texts.

The documents of an Arrow batch make one shard.  Two neighbouring words that no benchmark item has can't lie in a
match, so only suffixes that stay clear of such pairs for a window's length are kept.  The shard's suffix array is
their sorted order, found by prefix doubling.  Every benchmark suffix is looked up by binary search: the range of
suffixes that agree on its leading window gives all verbatim occurrences.  Each of them has its longest match with an item at one of the two
neighbours in suffix order, so every item's longest verbatim match in a document is known with its place in both, and
repeated lines cost no more than their places.  A document lies in one shard, so nothing is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trainkit.llm.common import cut, map_rows

WORDS = re.compile(rb"[0-9a-z\x80-\xff]+")  # of lower-cased UTF-8: all but ASCII signs, capitals and controls
WINDOW = 13
BLOCK_WORDS = 1_000_000  # benchmark words in one broadcast; a larger benchmark goes in several
PIECE_WORDS = 1_000_000  # a longer item goes in pieces that overlap by a window
SHARD_WORDS = 1_000_000
PAIRS = 1 << 18  # (place, family) pairs that are looked at together, and at most as many more as a shard has places
MATCH = "item_id:string,start:int,item_start:int,length:int"
HITS = f"spans array<struct<start:int,stop:int>>, matches array<struct<{MATCH}>>"


def words_of(text: bytes | None) -> list[bytes]:
    return WORDS.findall((text or b"").lower())


def doubled(ids: np.ndarray, deepest: int) -> list[np.ndarray]:
    """Ranks of the next 1, 2, 4, ... up to `deepest` words of every place, in their order. A zero ends a text and sorts first."""
    levels = [np.append(ids, np.zeros(deepest, np.int64))]
    while 1 << (len(levels) - 1) < deepest:
        last, step = levels[-1], 1 << (len(levels) - 1)
        right = np.append(last[step:], np.zeros(step, np.int64))
        levels.append(np.unique(last * (int(last.max()) + 1) + right, return_inverse=True)[1])
    return levels


def common(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Words in common at the places a[i] and b[i], up to most[i] (no more than the text at b[i] has), from the longest level down."""
    length = np.zeros(len(a), np.int64)
    last = len(levels[0]) - 1
    for k in range(len(levels) - 1, -1, -1):
        same = levels[k][np.minimum(a + length, last)] == levels[k][np.minimum(b + length, last)]
        length += same.astype(np.int64) << k
    return np.minimum(length, most)


class Suffixes:
    """Items of the benchmark as word numbers, each followed by a zero, and their windows.

    Equal windows are looked up once.  The places at which one item has it form a family, of which a document needs the nearest
    in suffix order only.
    """

    def __init__(self, items: list[tuple[str | None, int, list[bytes]]], window: int):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.names = [name for name, _, _ in items]
        self.firsts = np.array([first for _, first, _ in items], np.int64)  # of pieces of long items
        sizes = np.array([len(words) for _, _, words in items], np.int64)
        number = self.vocabulary.setdefault
        ids = [[number(w, len(self.vocabulary) + 1) for w in words] + [0] for _, _, words in items]
        self.ids = np.array([x for part in ids for x in part], np.int64)
        self.starts = np.cumsum(np.append(0, sizes + 1))[:-1]
        counts = np.maximum(1, sizes - window + 1)  # windows of each item; a shorter item is one
        item = np.repeat(np.arange(len(items)), counts)
        step = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        suffix, length = self.starts[item] + step, np.minimum(window, sizes)[item]
        known: dict[bytes, int] = {}
        content = np.array([known.setdefault(self.ids[x : x + n].tobytes(), len(known)) for x, n in zip(suffix.tolist(), length.tolist(), strict=True)], np.int64)
        first = np.unique(content, return_index=True)[1]
        self.suffix, self.length = suffix[first], length[first]  # of each different window, where it is first
        order = np.lexsort((item, content))
        self.member, self.rest = suffix[order], (sizes[item] - step)[order]  # a family's places, and words up to the item's end
        new = np.ones(len(order), bool)
        new[1:] = (np.diff(content[order]) != 0) | (np.diff(item[order]) != 0)
        self.family = np.cumsum(new) - 1  # of each place
        self.item, self.content = item[order][new], content[order][new]  # of each family
        self.longest = int(sizes.max(initial=1))
        self.shortest = int(self.length.min(initial=window))
        base = len(self.vocabulary) + 1
        self.pairs = np.unique(self.ids[:-1] * base + self.ids[1:])

    def reach(self, ids: np.ndarray) -> np.ndarray:
        """Words from each place on that the benchmark knows, neighbour by neighbour."""
        if not len(ids):
            return ids
        base = len(self.vocabulary) + 1
        pair = ids[:-1] * base + ids[1:]
        at = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
        follows = np.append((self.pairs[at] == pair) & (ids[1:] > 0), False)
        ends = np.flatnonzero(~follows)
        place = np.arange(len(ids))
        return np.where(ids > 0, ends[np.searchsorted(ends, place)] - place + 1, 0)

    def search(self, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of a shard of word numbers: change of the number of open windows at each place; (document, item, words in common, place, place in the benchmark) of each item's longest match in each document.

        Documents begin at `bounds`.
        """
        change, none = np.zeros(len(ids) + 1, np.int64), np.empty((0, 5), np.int64)
        if not len(self.names):
            return change, none
        reach = self.reach(ids)
        starts = np.flatnonzero((reach > 0) & (np.append(0, reach[:-1]) < 2) & (reach >= self.shortest))
        if not len(starts):
            return change, none
        # The stretches that may hold a match, each followed by a zero, and the benchmark behind them.
        sizes = reach[starts] + 1
        within = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        place = np.repeat(starts, sizes) + within
        inside = within < np.repeat(sizes - 1, sizes)
        text = np.where(inside, ids[np.minimum(place, len(ids) - 1)], 0)
        levels = doubled(np.concatenate([text, self.ids]), max(self.longest, self.window))
        suffix = np.flatnonzero(inside)
        suffix = suffix[np.argsort(levels[-1][suffix], kind="stable")]
        low, high = (self._bound(levels, suffix, len(text) + self.suffix, after) for after in (False, True))
        for n in np.unique(self.length[high > low]):  # at most as many lengths as a window has words
            of = (high > low) & (self.length == n)
            ends = np.bincount(low[of], minlength=len(suffix) + 1) - np.bincount(high[of], minlength=len(suffix) + 1)
            at = place[suffix[np.cumsum(ends[:-1]) > 0]]
            change[at] += 1
            np.add.at(change, at + n, -1)
        return change, self._longest(levels, len(text), suffix, place, low, high, bounds)

    def _longest(self, levels: list[np.ndarray], base: int, suffix: np.ndarray, place: np.ndarray, low: np.ndarray, high: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Every place that has a window meets the family's places right before and behind it in suffix order: none has more words in common."""
        rank = levels[-1]
        top = int(rank.max()) + 1
        open_ = (high > low)[self.content[self.family]]
        member, rest, family = self.member[open_], self.rest[open_], self.family[open_]
        keys = family * top + rank[base + member]
        order = np.argsort(keys, kind="stable")
        member, rest, family, keys = member[order], rest[order], family[order], keys[order]
        asked = np.unique(family)
        sizes = (high - low)[self.content[asked]]
        best = np.empty((0, 5), np.int64)
        part = (np.cumsum(sizes) - sizes) // PAIRS  # families whose places are looked at together
        for k in np.unique(part):
            few = part == k
            of = np.repeat(asked[few], sizes[few])
            step = np.arange(len(of)) - np.repeat(np.cumsum(sizes[few]) - sizes[few], sizes[few])
            at = suffix[low[self.content[of]] + step]
            behind = np.searchsorted(keys, of * top + rank[at])
            found = [best]
            for near in (behind - 1, behind):
                near = np.clip(near, 0, len(keys) - 1)
                mine = family[near] == of
                a, b = at[mine], near[mine]
                same = common(levels, a, base + member[b], rest[b])
                doc = np.searchsorted(bounds, place[a], "right") - 1
                found.append(np.stack([doc, self.item[of[mine]], same, place[a], member[b]], axis=1))
            best = np.concatenate(found)
            order = np.lexsort((best[:, 4], best[:, 3], -best[:, 2], best[:, 1], best[:, 0]))
            best = best[order]
            best = best[np.concatenate([[True], (np.diff(best[:, :2], axis=0) != 0).any(axis=1)])]
        return best

    def _bound(self, levels: list[np.ndarray], suffix: np.ndarray, asked: np.ndarray, after: bool) -> np.ndarray:
        """For each window the first place in the suffix array that is not before it (or, `after`, that is behind it)."""
        low, high = np.zeros(len(asked), np.int64), np.full(len(asked), len(suffix), np.int64)
        words = levels[0]
        while (low < high).any():
            open_ = np.flatnonzero(low < high)
            mid = (low[open_] + high[open_]) // 2
            a, b, most = suffix[mid], asked[open_], self.length[open_]
            same = common(levels, a, b, most)
            less = (words[a + same] < words[b + same]) & (same < most)
            right = less | ((same >= most) & after)
            low[open_] = np.where(right, mid + 1, low[open_])
            high[open_] = np.where(right, high[open_], mid)
        return low


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(item, first, words): items as word lists, long ones in pieces that overlap by a window less one."""
    for batch in batches:
        rows = []
        for item, text, window in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            words = words_of(text)
            for at in range(0, max(1, len(words) - window + 1) if words else 0, PIECE_WORDS):
                rows.append((item, at, words[at : at + PIECE_WORDS + window - 1]))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.list_(pa.binary()))], names=["item", "first", "words"])


def benchmark_blocks(benchmark: DataFrame, id_col: str, text_col: str, window: int, block_words: int) -> Iterator[Suffixes]:
    """Blocks of about `block_words` words, dealt out by tasks; the driver holds one at a time. Items without words are left out."""
    rows = benchmark.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("binary").alias("text"), F.lit(window).alias("window")).where("text IS NOT NULL")
    pieces = cut(rows.mapInArrow(_pieces, "item string, first int, words array<binary>"))
    total = pieces.agg(F.sum(F.size("words"))).first()[0] or 0
    blocks = max(1, -(-total // block_words))
    for k in range(blocks):
        block = pieces.where(F.pmod(F.xxhash64("item", "first"), F.lit(blocks)) == k).collect()
        items = sorted(((r["item"], r["first"], [bytes(w) for w in r["words"]]) for r in block), key=lambda x: (x[0] is None, x))
        if items:
            yield Suffixes(items, window)


def _judge(shared) -> Callable:
    def shard(texts: list[bytes | None], known: Suffixes) -> list[tuple]:
        docs = [words_of(t) for t in texts]
        bounds = np.cumsum([0, *[len(d) + 1 for d in docs]])
        ids = np.zeros(int(bounds[-1]), np.int64)
        for k, words in enumerate(docs):
            ids[bounds[k] : bounds[k] + len(words)] = np.fromiter(map(known.vocabulary.get, words, repeat(0)), np.int64, len(words))
        change, found = known.search(ids, bounds)
        hit = np.cumsum(change[:-1]) > 0
        edge = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
        starts, stops = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        spans: list[list] = [[] for _ in docs]
        for d, a, b in zip((np.searchsorted(bounds, starts, "right") - 1).tolist(), starts.tolist(), stops.tolist(), strict=True):
            spans[d].append({"start": a - int(bounds[d]), "stop": b - int(bounds[d])})
        matches: list[list] = [[] for _ in docs]
        for d, i, n, p, j in found.tolist():
            matches[d].append({"item_id": known.names[i], "start": p - int(bounds[d]), "item_start": j - int(known.starts[i]) + int(known.firsts[i]), "length": n})
        return [(len(w), spans[k], matches[k]) for k, w in enumerate(docs)]

    def judge(inputs: list[pa.Array]) -> list[pa.Array]:
        out, held, size = [], [], 0
        for text in inputs[0].to_pylist():
            held.append(text)
            size += len(text or b"") // 4
            if size >= SHARD_WORDS:
                out += shard(held, shared.value)
                held, size = [], 0
        out += shard(held, shared.value) if held else []
        columns = list(zip(*out, strict=True))
        span = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
        match = pa.list_(pa.struct([("item_id", pa.string()), ("start", pa.int32()), ("item_start", pa.int32()), ("length", pa.int32())]))
        return [pa.array(c, t) for c, t in zip(columns, (pa.int64(), span, match), strict=True)]

    return judge


def _joined(spans: Column) -> Column:
    """Spans in order, those that overlap or touch as one."""
    empty = F.array().cast("array<struct<start:int,stop:int>>")

    def add(done: Column, s: Column) -> Column:
        last = F.get(done, F.size(done) - 1)
        longer = F.struct(last["start"].alias("start"), F.greatest(last["stop"], s["stop"]).alias("stop"))
        return F.when((F.size(done) > 0) & (s["start"] <= last["stop"]), F.concat(F.slice(done, 1, F.size(done) - 1), F.array(longer))).otherwise(F.concat(done, F.array(s)))

    return F.aggregate(F.array_sort(spans), empty, add)


def match(
    docs: DataFrame,
    benchmark: DataFrame,
    carry: list[Column],
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """`carry` as c0, c1, ... with n_words, n_hit, item_ids, spans, matches, longest: one row per input row.

    A document word is hit inside any occurrence of a window of `window` consecutive item words (of a shorter
    item: all its words); `spans` are the hit stretches in word positions.  `item_ids` are the items with occurring
    windows, sorted as strings; `matches` the longest verbatim match of each of them with its places in the document
    and the item, `longest` the longest of all.  Null and empty texts have no words; items without words match
    nothing; an item with a null id counts for hits only; repeated items count once per id, repeated documents each.
    Very long documents are read whole; an item of more than PIECE_WORDS words is matched in pieces.  Carried columns
    may have any names.  Empty tables give no hits or no rows.  A benchmark of more than `block_words` words is
    matched block by block, and the hits of each block are written before the next one.
    """
    context = docs.sparkSession.sparkContext
    fields = f"n_words long, {HITS}"
    blocks = benchmark_blocks(benchmark, item_id_col, item_text_col, window, block_words)
    first = next(blocks, Suffixes([], window))
    second = next(blocks, None)
    if second is None:
        shared = context.broadcast(first)
        found = map_rows(docs, carry, [F.col(text_col).cast("binary")], lambda: _judge(shared), fields)
    else:
        n = len(carry)
        keyed = cut(docs.select(F.monotonically_increasing_id().alias("row_key"), F.col(text_col).cast("binary").alias("text"), *[c.alias(f"c{i}") for i, c in enumerate(carry)]))
        words, parts = None, []
        todo = [first, second]
        while todo:
            shared = context.broadcast(todo.pop(0))
            judged = cut(map_rows(keyed, [F.col("row_key")], [F.col("text")], lambda s=shared: _judge(s), fields).withColumnRenamed("c0", "row_key"))
            shared.destroy()
            words = words if words is not None else judged.select("row_key", "n_words")
            parts.append(judged.where(F.size("spans") > 0).select("row_key", "spans", "matches"))
            if not todo:
                todo = [b for b in [next(blocks, None)] if b is not None]
        hits = parts[0]
        for part in parts[1:]:
            hits = hits.unionByName(part)
        hits = hits.groupBy("row_key").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.flatten(F.collect_list("matches")).alias("matches"))  # at most one row a block
        found = keyed.drop("text").join(words, "row_key").join(hits, "row_key", "left").select(
            *[f"c{i}" for i in range(n)], "n_words", F.coalesce(_joined(F.col("spans")), F.array()).alias("spans"), F.coalesce("matches", F.array()).alias("matches")
        )
    return found.select(
        *[f"c{i}" for i in range(len(carry))],
        "n_words",
        F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"]).alias("n_hit"),
        F.array_sort(F.array_distinct(F.filter(F.transform("matches", lambda m: m["item_id"]), lambda x: x.isNotNull()))).alias("item_ids"),
        "spans",
        "matches",
        F.coalesce(F.array_max(F.transform("matches", lambda m: m["length"])), F.lit(0)).alias("longest"),
    )


def contaminated() -> Column:
    """At least one word in twenty is hit."""
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def items_digest() -> Column:
    return F.sha2(F.concat_ws(",", "item_ids"), 256)
