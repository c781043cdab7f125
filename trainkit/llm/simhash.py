"""Near-duplicates: SimHash with a Gray-order hierarchical index, and an exact join of similar shingle sets.

`near_groups` makes 64-bit fingerprints inside Arrow tasks.  Distinct fingerprints are dealt out by keys of bit
blocks: near ones share one of them (pigeonhole, nothing is missed); the more rows, the longer the keys.  Inside a
key the fingerprints are sorted by Gray rank and indexed bottom-up: every node keeps the bits on which all its
members agree (mask and pattern).  A search adds up masked differences from the top and prunes whole nodes beyond
the radius, and nodes that lie in the searcher's component already; so a dense group of near copies yields the
nearest links that span it, not its pairs.

`similar_groups` confirms what that index proposes by the Jaccard similarity of the shingle sets, and completes it,
because fingerprints of similar sets may differ in any number of bits: sets that are similar share a shingle among
the first few of each, in any order that all sets keep to; rare ones come first.  Links are confirmed before they join
anything: first the index's and those to the first set in the list of a shingle; then every pair of a list that still
lies in two components, unless a bound on its overlap rules it out.  Distributed star contraction joins the links to
components.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trainkit.llm.common import cut, forget, map_rows, tasks_for

BITS = 64
FANOUT = 16
SLICE = 4096  # rows of one index; larger keys are searched slice by slice
WINDOW_ROWS = 65_536  # rows of sorted lists that a task looks at together
RADIUS = 4
SHINGLES_AT_ONCE = 65_536
SEED = 42
SKETCH = 512  # bits of a set's parity sketch
ORDER_BUCKETS = 1 << 20  # counts of shingles by the first bits of their hash, broadcast
ORDER_CHUNK = 1 << 14  # buckets of one row
ROUNDING = 1e-6  # by which bounds on counts give way
BROADCAST_NODES = 1_000_000  # long keys that may be broadcast


def _remixed(hashes: np.ndarray) -> np.ndarray:
    """A second hash of a hash (the finaliser of splitmix64)."""
    x = hashes + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(text: bytes | None, k: int) -> Iterator[np.ndarray]:
    """XXH64 (seed 42) of all k-word shingles of a UTF-8 text, in bounded arrays; of the whole text if it has fewer words."""
    words = (text or b"").lower().split()  # bytes: A-Z and ASCII white space only
    n = len(words)
    if n == 0:
        return
    line, digest = b" ".join(words), xxhash.xxh64_intdigest
    if n <= k:
        yield np.array([digest(line, SEED)], np.uint64)
        return
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts, stops = np.concatenate([[0], ends[: n - k] + 1]).tolist(), ends[k - 1 :].tolist()
    for at in range(0, len(starts), SHINGLES_AT_ONCE):
        part = slice(at, at + SHINGLES_AT_ONCE)
        yield np.array([digest(line[a:b], SEED) for a, b in zip(starts[part], stops[part], strict=True)], np.uint64)


def bits_set(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes set each of the 64 bits."""
    return np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def majority(ones: np.ndarray, total: int) -> np.ndarray:
    """Words of the bits that are set in more than half of `total` hashes."""
    return np.packbits(2 * ones > total, axis=1, bitorder="little").view("<u8")[:, 0].astype(np.uint64)


def fingerprint(text: bytes | None, words_per_shingle: int = 4, width: int = 1) -> np.ndarray:
    """SimHash as `width` unsigned words of 64 bits; zero for a text without words. The first word uses XXH64 itself."""
    ones, total = np.zeros((width, BITS), np.int64), 0
    for hashes in shingle_hashes(text, words_per_shingle):
        total += len(hashes)
        for w in range(width):
            ones[w] += bits_set(hashes)
            if w + 1 < width:
                hashes = _remixed(hashes)
    return majority(ones, total) if total else np.zeros(width, np.uint64)


def word_columns(width: int) -> list[str]:
    return [f"f{w}" for w in range(width)]


def fingerprints(docs: DataFrame, id_col: str, text_col: str, words_per_shingle: int, width: int, key_col: str | None = None) -> DataFrame:
    """(row_key, id, f0, f1, ...): one row per document; each word is a signed long with the fingerprint's bits."""

    def compute(inputs: list[pa.Array]) -> list[pa.Array]:
        fps = np.array([fingerprint(t.as_py(), words_per_shingle, width) for t in inputs[0]], np.uint64).reshape(-1, width)
        return [pa.array(np.ascontiguousarray(fps[:, w]).view(np.int64)) for w in range(width)]

    key = F.col(key_col) if key_col else F.monotonically_increasing_id()
    words = word_columns(width)
    made = map_rows(docs, [key, F.col(id_col).cast("long")], [F.col(text_col).cast("binary")], lambda: compute, ", ".join(f"{w} long" for w in words))
    return made.toDF("row_key", "id", *words)


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """The position of each 64-bit word in the reflected Gray sequence."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


def _bits(x: np.ndarray) -> np.ndarray:
    counts = np.bitwise_count(x)
    return counts[..., 0] if x.shape[-1] == 1 else counts.sum(axis=-1, dtype=np.int64)


class GrayIndex:
    """Hierarchical index over fingerprints (rows of 64-bit words), in Gray order."""

    def __init__(self, codes: np.ndarray):
        self.order = np.lexsort([gray_rank(codes[:, w]) for w in reversed(range(codes.shape[1]))])
        self.codes = codes[self.order]
        ands, ors = self.codes, self.codes
        self.levels = []  # from the leaves' parents up: (mask, pattern) of runs of FANOUT nodes
        while len(ands) > FANOUT:
            at = np.arange(0, len(ands), FANOUT)
            ands, ors = np.bitwise_and.reduceat(ands, at), np.bitwise_or.reduceat(ors, at)
            mask = ~(ands ^ ors)
            self.levels.append((mask, ands & mask))

    def _uniform(self, labels: np.ndarray) -> list[np.ndarray]:
        """For each level, the component that holds all of a node's members, or -1."""
        low = high = labels
        out = []
        for _ in self.levels:
            at = np.arange(0, len(low), FANOUT)
            low, high = np.minimum.reduceat(low, at), np.maximum.reduceat(high, at)
            out.append(np.where(low == high, low, -1))
        return out

    def search(self, queries: np.ndarray, radius: int, own: np.ndarray | None = None, labels: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query place, code place, distance) within the radius; with `own` and `labels`, only between different components."""
        top = len(self.levels)
        width = len(self.levels[-1][0]) if top else len(self.codes)
        q = np.repeat(np.arange(len(queries)), width)
        node = np.tile(np.arange(width), len(queries))
        uniform = self._uniform(labels) if own is not None else []
        for level in range(top - 1, -1, -1):
            if own is not None:
                other = uniform[level][node] != own[q]
                q, node = q[other], node[other]
            mask, pattern = self.levels[level]
            near = _bits((queries[q] ^ pattern[node]) & mask[node]) <= radius
            q, node = q[near], node[near]
            below = len(self.levels[level - 1][0]) if level else len(self.codes)
            q = np.repeat(q, FANOUT)
            node = (node[:, None] * FANOUT + np.arange(FANOUT)).ravel()
            q, node = q[node < below], node[node < below]
        if own is not None:
            other = labels[node] != own[q]
            q, node = q[other], node[other]
        distance = _bits(queries[q] ^ self.codes[node])
        near = distance <= radius
        return q[near], node[near], distance[near]


def merge(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Joins the components of a[i] and b[i] under the smaller label, by repeated minimum."""
    labels = labels.copy()
    while True:
        la, lb = labels[a], labels[b]
        apart = la != lb
        if not apart.any():
            return labels
        a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
        np.minimum.at(labels, np.maximum(la, lb), np.minimum(la, lb))
        while True:
            up = labels[labels]
            if (up == labels).all():
                break
            labels = up


def nearest_links(labels: np.ndarray, a: np.ndarray, b: np.ndarray, distance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(labels, chosen pairs): every component takes its nearest pair to another one, until the pairs join no more."""
    chosen = []
    at = np.arange(len(a))
    while True:
        at = at[labels[a[at]] != labels[b[at]]]
        if not len(at):
            return labels, np.unique(np.concatenate(chosen)) if chosen else np.empty(0, np.int64)
        for side in (a, b):
            order = np.lexsort((at, distance[at], labels[side[at]]))
            of = labels[side[at[order]]]
            chosen.append(at[order[np.concatenate([[True], of[1:] != of[:-1]])]])
        picked = np.concatenate(chosen[-2:])
        labels = merge(labels, a[picked], b[picked])


def spanning_links(codes: np.ndarray, radii: list[int], asking: np.ndarray | None = None, at_once: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (places in `codes`, then `asking`) within the last radius that connect what all such pairs connect, near ones first.

    With `asking`, only pairs between an asking row and a row of `codes` count.
    """
    n, m = len(codes), 0 if asking is None else len(asking)
    labels = np.arange(n + m)
    queries, base = (codes, 0) if asking is None else (asking, n)
    if n * len(queries) <= (4 * FANOUT) ** 2:  # a few leaves: compared at once
        distance = _bits(queries[:, None] ^ codes[None, :])
        near = distance <= radii[-1]
        q, c = np.nonzero(np.tril(near, -1) if asking is None else near)
        _, chosen = nearest_links(labels, q + base, c, distance[q, c])
        return q[chosen] + base, c[chosen]
    index = GrayIndex(codes)
    place = np.concatenate([index.order, np.arange(n, n + m)])
    if asking is None:
        queries = index.codes
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for radius in radii:
        for at in range(0, len(queries), at_once):
            part = np.arange(at, min(at + at_once, len(queries)))
            q, c, distance = index.search(queries[part], radius, labels[base + part], labels[:n])
            q = q + base + at
            labels, chosen = nearest_links(labels, q, c, distance)
            if len(chosen):
                found.append((place[q[chosen]], place[c[chosen]]))
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    u, v = zip(*found, strict=True)
    return np.concatenate(u), np.concatenate(v)


def bit_blocks(count: int) -> list[int]:
    """Masks of `count` bit blocks that make up one word."""
    bounds = [round(i * BITS / count) for i in range(count + 1)]
    return [((1 << (b - a)) - 1) << a for a, b in zip(bounds, bounds[1:], strict=False)]


def block_masks(radius: int, blocks: int | None = None) -> np.ndarray:
    """Masks of which fingerprints of one word within the radius agree on at least one: all choices of blocks - radius blocks."""
    blocks = blocks or radius + 1
    return np.array([[sum(chosen)] for chosen in combinations(bit_blocks(blocks), blocks - radius)], np.uint64)


def blocks_for(rows: int, radius: int, slice_rows: int = SLICE) -> int:
    """The fewest blocks whose keys are long enough that a key of evenly spread fingerprints fits one index."""
    blocks = radius + 1
    while blocks < 2 * radius and rows > slice_rows << ((blocks - radius) * (BITS // blocks)):
        blocks += 1
    return blocks


def keys_of(masks: np.ndarray) -> list[Column]:
    """One key per mask, of the fingerprint's bits under it."""
    return [F.xxhash64(F.lit(t), *[F.col(f"f{w}").bitwiseAND(F.lit(int(m))) for w, m in enumerate(row)]) for t, row in enumerate(masks.view(np.int64))]


def first_shared(masks: np.ndarray, differing: np.ndarray) -> np.ndarray:
    """The first mask under which each pair agrees, from the pairs' differing bits."""
    first = np.full(len(differing), len(masks))
    for t in range(len(masks) - 1, -1, -1):
        first[~(differing & masks[t]).any(axis=1)] = t
    return first


def windows(batches: Iterator[pa.RecordBatch], at_once: int = WINDOW_ROWS) -> Iterator[tuple[pa.Table, int]]:
    """(rows, how many of them were seen before) of a partition sorted by key, part, query: whole runs of a key and part.

    A run of more than `at_once` rows comes in pieces, each after the run's own rows, of which there are few.
    """
    held: list[pa.RecordBatch] = []
    n = again = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        n += batch.num_rows
        if n - again < at_once:
            continue
        rows = pa.Table.from_batches(held)
        key, part, query = (rows.column(i).to_numpy() for i in range(3))
        change = np.flatnonzero((key[1:] != key[:-1]) | (part[1:] != part[:-1]))
        if len(change):
            cut_at = int(change[-1]) + 1
            yield rows.slice(0, cut_at), again
            rest, again = rows.slice(cut_at), 0
        elif query[-1]:
            yield rows, again
            again = int((~query).sum())
            rest = rows.slice(0, again)
        else:
            continue
        held, n = rest.to_batches(), rest.num_rows
    if n > again:
        yield pa.Table.from_batches(held), again


def runs_of(rows: pa.Table, again: int) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """(places of own rows, places of asking rows, whether the own rows are new) of each run with a pair."""
    key, part, query = (rows.column(i).to_numpy() for i in range(3))
    starts = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (part[1:] != part[:-1])]))
    stops = np.append(starts[1:], len(key))
    several = stops - starts > 1
    for a, b in zip(starts[several].tolist(), stops[several].tolist(), strict=True):
        middle = a + int((~query[a:b]).sum())
        yield np.arange(a, middle), np.arange(middle, b), not (again and a == 0)


def _link_keys(radii: list[int], masks: np.ndarray):
    """Links within each (key, part) run of a partition that is sorted by key, part, query.

    A pair is listed under the first mask that it shares only.  There, nearer links connect it if it was not
    listed itself, so later masks would just repeat it.
    """
    width = masks.shape[1]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, again in windows(batches):
            node, table = rows.column(3).to_numpy(), rows.column(4).to_numpy()
            codes = np.stack([rows.column(5 + w).to_numpy().view(np.uint64) for w in range(width)], axis=1)
            found: list[tuple[np.ndarray, np.ndarray]] = []
            for own, asks, new in runs_of(rows, again):
                if new and len(own) > 1:
                    u, v = spanning_links(codes[own], radii)
                    found.append((own[u], own[v]))
                if len(own) and len(asks):
                    both = np.concatenate([own, asks])
                    u, v = spanning_links(codes[own], radii, codes[asks])
                    found.append((both[u], both[v]))
            if found:
                u, v = (np.concatenate(x) for x in zip(*found, strict=True))
                here = first_shared(masks, codes[u] ^ codes[v]) == table[u]
                u, v = node[u[here]], node[v[here]]
                yield pa.RecordBatch.from_arrays([pa.array(np.maximum(u, v)), pa.array(np.minimum(u, v))], names=["u", "v"])

    return find


def links(codes: DataFrame, masks: np.ndarray, radii: list[int], slice_rows: int = SLICE) -> DataFrame:
    """Links (u > v) between `node`s of distinct fingerprints that share a key and lie within the last radius: nearest ones that span.

    A key of more than `slice_rows` rows is cut into slices by node hash: each slice is indexed by its own
    task, and the rows of earlier slices are sent to it as queries.
    """
    spark, words = codes.sparkSession, word_columns(masks.shape[1])
    keyed = codes.select("node", *words, F.posexplode(F.array(*keys_of(masks))).alias("table", "key"))
    hot = keyed.groupBy("key").agg(F.ceil(F.count("*") / slice_rows).cast("int").alias("parts")).where("parts > 1")
    tagged = keyed.join(hot, "key", "left").withColumn("own", F.pmod(F.xxhash64("node"), F.coalesce("parts", F.lit(1))).cast("int"))
    dealt = tagged.select("key", "table", "node", *words, "own", F.explode(F.sequence("own", F.coalesce(F.col("parts") - 1, F.lit(0)))).alias("part"))
    rows = dealt.select("key", "part", (F.col("part") != F.col("own")).alias("query"), "node", "table", *words)
    near = rows.repartition(tasks_for(spark), "key", "part").sortWithinPartitions("key", "part", "query")
    return near.mapInArrow(_link_keys(radii, masks), "u long, v long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node with an edge; root is the smallest node of its component.

    Alternates two contractions until nothing changes: every node's neighbours hang on its smallest one.
    Only a count and a checksum reach the driver.
    """
    now = cut(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen = before = None
    while seen is None or seen != before:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = cut(both.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("m")))
        # Plain scans on both sides of the joins, so that Spark can split a hot node.
        large = cut(both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        least = cut(large.groupBy("u").agg(F.min("v").alias("m")))
        ends = F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))
        new = cut(large.join(least, "u").select(F.explode(ends).alias("e")).select("e.u", "e.v").where("u <> v").distinct())
        forget(now, low, large, least)
        now, before = new, seen
        seen = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _best_row() -> Column:
    return F.min_by(F.struct("id", "row_key"), F.struct(F.col("id").isNull(), F.col("id"), F.col("row_key")))


def distinct_rows(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(node, id, *columns): one row per distinct value; node is the row key of its first document."""
    return rows.groupBy(*columns).agg(_best_row().alias("b")).select(F.col("b.row_key").alias("node"), F.col("b.id").alias("id"), *columns)


def _with_groups(rows: DataFrame, firsts: DataFrame, edges: DataFrame, columns: list[str]) -> DataFrame:
    """`rows` with component_id and kept."""
    linked = cut(firsts.join(components(edges), "node").withColumn("row_key", F.col("node")))
    heads = cut(linked.groupBy("root").agg(_best_row().alias("b")).select("root", F.col("b.id").alias("low"), F.col("b.row_key").alias("head")))
    labels = linked.join(heads, "root").select("node", "low", "head")
    known = firsts.join(labels, "node", "left").select(
        *columns, F.when(F.col("head").isNull(), F.col("id")).otherwise(F.col("low")).alias("component_id"), F.coalesce("head", "node").alias("head")
    )
    return rows.join(cut(known), columns).withColumn("kept", F.col("row_key") == F.col("head"))


def near_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_per_shingle: int = 4, radius: int = RADIUS, key_col: str | None = None, slice_rows: int = SLICE
) -> DataFrame:
    """Groups by 64-bit fingerprints: (row_key, id, fingerprint, component_id, kept), one row per input row.

    `fingerprint`: 16 hex digits.  `component_id`: the smallest id reachable over links of `radius` bits or
    fewer; null when all ids of the component are null.  `kept` marks one row per component: the smallest
    id's, of rows that share it the one with the smallest row key.  A null or empty text has fingerprint zero
    and is linked like any other.  An empty table gives an empty result; other columns are left out.
    """
    fps = cut(fingerprints(docs, id_col, text_col, words_per_shingle, 1, key_col))
    codes = cut(distinct_rows(fps, word_columns(1)))
    masks = block_masks(radius, blocks_for(codes.count(), radius, slice_rows))
    grouped = _with_groups(fps, codes, links(codes, masks, [radius], slice_rows), word_columns(1))
    return grouped.select("row_key", "id", F.lpad(F.lower(F.hex("f0")), 16, "0").alias("fingerprint"), "component_id", "kept")


def shingle_set(text: bytes | None, k: int) -> np.ndarray:
    """The distinct shingle hashes of a text, sorted."""
    return np.unique(np.concatenate([*shingle_hashes(text, k), np.empty(0, np.uint64)]))


def _shingle_sets(k: int):
    def compute(inputs: list[pa.Array]) -> list[pa.Array]:
        return [pa.array([shingle_set(t.as_py(), k).view(np.int64) for t in inputs[0]], pa.list_(pa.int64()))]

    return compute


def confirmed(edges: DataFrame, docs: DataFrame, text_col: str, key_col: str, words_per_shingle: int, similarity: float) -> DataFrame:
    """The edges, written, whose documents' shingle sets have at least that Jaccard similarity (two empty sets: 1)."""
    nodes = cut(edges.select(F.explode(F.array("u", "v")).alias("node")).distinct())
    asked = F.broadcast(nodes) if nodes.limit(BROADCAST_NODES + 1).count() <= BROADCAST_NODES else nodes
    wanted = docs.select(F.col(key_col).alias("node"), F.col(text_col).cast("binary").alias("text")).join(asked, "node")
    sets = cut(map_rows(wanted, [F.col("node")], [F.col("text")], lambda: _shingle_sets(words_per_shingle), "shingles array<long>").withColumnRenamed("c0", "node"))
    pairs = edges.join(sets.toDF("u", "a"), "u").join(sets.toDF("v", "b"), "v")
    both = F.size(F.array_intersect("a", "b"))
    every = F.size("a") + F.size("b") - both
    found = cut(pairs.where(both >= similarity * every).select("u", "v"))
    forget(nodes, sets)
    return found


def order_buckets(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(BITS - ORDER_BUCKETS.bit_length() + 1)).astype(np.int64)


def _counted(k: int):
    """How many (text, shingle) pairs of a partition fall into each bucket: a row per chunk of buckets, in as few bytes as do."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(ORDER_BUCKETS, np.int64)
        for batch in batches:
            for text in batch.column(0):
                np.add.at(counts, order_buckets(shingle_set(text.as_py(), k)), 1)
        rows = [(i, c.astype(np.min_scalar_type(c.max()))) for i, c in enumerate(counts.reshape(-1, ORDER_CHUNK)) if c.any()]
        if rows:
            chunks, parts = zip(*rows, strict=True)
            columns = [pa.array(chunks, pa.int32()), pa.array([c.itemsize for c in parts], pa.int32()), pa.array([c.tobytes() for c in parts], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["chunk", "width", "counts"])

    return count


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sum of each chunk's rows."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for chunk, width, counts in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            sums[chunk] = sums.get(chunk, 0) + np.frombuffer(counts, f"u{width}").astype(np.int64)
    if sums:
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(list(sums.values()), pa.list_(pa.int64()))], names=["chunk", "counts"])


def shingle_counts(keyed: DataFrame, text_col: str, words_per_shingle: int) -> np.ndarray:
    """For each bucket of hashes, how many of all texts' shingles fall into it. Shingles of full buckets come late; any order finds all pairs."""
    parts = keyed.select(F.col(text_col).cast("binary")).mapInArrow(_counted(words_per_shingle), "chunk int, width int, counts binary")
    sums = parts.repartition(tasks_for(keyed.sparkSession), "chunk").mapInArrow(_added, "chunk int, counts array<long>").toArrow()
    counts = np.zeros((ORDER_BUCKETS // ORDER_CHUNK, ORDER_CHUNK), np.int64)
    for chunk, row in zip(sums["chunk"].to_pylist(), sums["counts"], strict=True):
        counts[chunk] = row.values.to_numpy()
    return counts.ravel()


def leading(hashes: np.ndarray, counts: np.ndarray, similarity: float) -> np.ndarray:
    """The first shingles of a sorted set, by the counts of their buckets, of which every set as similar holds one among its own first."""
    rank = counts[order_buckets(hashes)]
    needed = math.ceil(similarity * len(hashes) - ROUNDING)
    return hashes[np.argsort(rank, kind="stable")][: len(hashes) - needed + 1]


def sketch(hashes: np.ndarray) -> np.ndarray:
    """Parities of the hashes' counts per residue: two sets differ in at least as many members as sketches in bits."""
    odd = np.bincount((hashes % np.uint64(SKETCH)).astype(np.int64), minlength=SKETCH) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def may_be_similar(edges: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """The edges whose sizes and sketches (of `nodes`) do not rule the similarity out."""
    a, b = (nodes.select(F.col("node").alias(x), F.col("size").alias(f"size_{x}"), F.col("sketch").alias(f"sketch_{x}")) for x in "uv")
    sizes = F.col("size_u") + F.col("size_v")
    needed = F.ceil(similarity / (1 + similarity) * sizes - ROUNDING)
    differing = F.aggregate(F.zip_with("sketch_u", "sketch_v", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)
    return edges.join(a, "u").join(b, "v").where((F.least("size_u", "size_v") >= needed) & (differing <= sizes - 2 * needed)).select("u", "v")


def _describe_sets(k: int, similarity: float, counts):
    def compute(inputs: list[pa.Array]) -> list[pa.Array]:
        sets = [shingle_set(t.as_py(), k) for t in inputs[0]]
        digests = [xxhash.xxh128_digest(s.tobytes()) for s in sets]
        first = [leading(s, counts.value, similarity).view(np.int64) for s in sets]
        codes = np.array([majority(bits_set(s)[None], len(s))[0] if len(s) else 0 for s in sets], np.uint64).view(np.int64)
        return [
            pa.array(digests, pa.binary()), pa.array(map(len, sets), pa.int32()), pa.array([sketch(s) for s in sets], pa.list_(pa.int64())), pa.array(first, pa.list_(pa.int64())), pa.array(codes)
        ]

    return compute


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by shingle, those that share theirs, with node and size of the first such row; holds one batch.

    The first and the last row are passed on in any case, as a neighbouring range may hold their shingle too.
    """
    names = ["shingle", "node", "size", "place", "head", "head_size"]
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32()]
    last = head = None
    passed = False  # whether the last row has been passed on
    for batch in batches:
        if not batch.num_rows:
            continue
        shingle, node, size, place = (batch.column(i).to_numpy() for i in range(4))
        follows = np.concatenate([[last is not None and last[0] == shingle[0]], shingle[1:] == shingle[:-1]])
        if follows[0] and not passed:
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((*last, *head), types, strict=True)], names=names)
        shared = follows | np.append(follows[1:], False)
        shared[0] |= last is None
        at = np.maximum.accumulate(np.where(follows, -1, np.arange(len(shingle))))  # -1: begun in an earlier batch
        of = [np.where(at < 0, head[i] if head else 0, x[at]) for i, x in enumerate((node, size))]
        last, head, passed = (shingle[-1].item(), node[-1].item(), size[-1].item(), place[-1].item()), (of[0][-1].item(), of[1][-1].item()), bool(shared[-1])
        if shared.any():
            yield pa.RecordBatch.from_arrays([pa.array(c[shared], t) for c, t in zip((shingle, node, size, place, *of), types, strict=True)], names=names)
    if last is not None and not passed:
        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((*last, *head), types, strict=True)], names=names)


def _possible_pairs(similarity: float, at_once: int = 256):
    """Pairs of two components within each (shingle, part) run, but for those whose sizes, places or sketches rule the similarity out."""

    def pairs_of(a: np.ndarray, b: np.ndarray, root, size, place, sketches) -> tuple[np.ndarray, np.ndarray]:
        needed = np.ceil(similarity / (1 + similarity) * (size[a][:, None] + size[b][None, :]) - ROUNDING).astype(np.int64)
        left = np.minimum((size[a] - place[a])[:, None], (size[b] - place[b])[None, :])
        x, y = np.nonzero((root[a][:, None] != root[b][None, :]) & (left >= needed))
        spare = size[a[x]] + size[b[y]] - 2 * needed[x, y]
        near = np.bitwise_count(sketches[a[x]] ^ sketches[b[y]]).sum(axis=1, dtype=np.int64) <= spare
        return a[x[near]], b[y[near]]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, again in windows(batches):
            node, root, size, place = (rows.column(i).to_numpy() for i in range(3, 7))
            sketches = rows.column(7).combine_chunks().flatten().to_numpy().view(np.uint64).reshape(len(node), -1)
            size, place = size.astype(np.int64), place.astype(np.int64)
            for own, asks, new in runs_of(rows, again):
                for some in (own, asks) if new else (asks,):
                    for at in range(0, len(some), at_once):
                        u, v = pairs_of(some[at : at + at_once], own[: at + at_once] if some is own else own, root, size, place, sketches)
                        both = np.unique(np.stack([np.maximum(node[u], node[v]), np.minimum(node[u], node[v])], axis=1), axis=0)
                        if len(both):
                            yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["u", "v"])

    return find


def similar_pairs(shared: DataFrame, nodes: DataFrame, joined: DataFrame, similarity: float, slice_rows: int = SLICE) -> DataFrame:
    """(u, v), u > v: all pairs that share a leading shingle, lie in two components of `joined`, and may be that similar.

    A list of more than `slice_rows` rows is cut into slices, as in `links`.
    """
    spark = shared.sparkSession
    of = nodes.join(joined, "node", "left").select("node", "sketch", F.coalesce("root", "node").alias("root"))
    placed = cut(shared.select("shingle", "node", "size", "place").join(of, "node"))
    lists = placed.groupBy("shingle").agg(F.ceil(F.count("*") / slice_rows).cast("int").alias("parts"), F.min("root").alias("low"), F.max("root").alias("high"))
    open_lists = cut(lists.where("low < high").select("shingle", "parts"))
    tagged = placed.join(open_lists, "shingle").withColumn("own", F.pmod(F.xxhash64("node"), "parts").cast("int"))
    dealt = tagged.withColumn("part", F.explode(F.sequence("own", F.col("parts") - 1)))
    rows = dealt.select("shingle", "part", (F.col("part") != F.col("own")).alias("query"), "node", "root", "size", "place", "sketch")
    near = rows.repartition(tasks_for(spark) * 2, "shingle", "part").sortWithinPartitions("shingle", "part", "query")
    pairs = cut(near.mapInArrow(_possible_pairs(similarity), "u long, v long").distinct())
    forget(placed, open_lists)
    return pairs


def proposed(sets: DataFrame, radius: int = RADIUS, slice_rows: int = SLICE) -> DataFrame:
    """(u, v), u > v: sets (node, f0) of one fingerprint hang on the first of them; the index links those first ones."""
    firsts = cut(sets.groupBy("f0").agg(F.min("node").alias("node")))
    near = links(firsts, block_masks(radius, blocks_for(firsts.count(), radius, slice_rows)), [radius], slice_rows)
    same = sets.join(firsts.withColumnRenamed("node", "v"), "f0").where("node <> v").select(F.col("node").alias("u"), "v")
    return near.unionByName(same)


def similar_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_per_shingle: int = 5, similarity: float = 0.8, key_col: str | None = None, slice_rows: int = SLICE
) -> DataFrame:
    """Groups by similarity of shingle sets: (row_key, id, component_id, kept), one row per input row.

    Rows are linked if the Jaccard similarity of their sets of shingles (64-bit hashes) is at least `similarity`, and
    no such link is missed; repeats of a shingle don't count.  Two texts without words are similar.  Nulls, ties,
    repeated rows, very long texts, empty tables and ids: as `near_groups`.  `docs` must be a written table if
    `key_col` is made from the scan order.
    """
    key = key_col or "row_key"
    # Several passes need the same keys, so a table without keys of its own is written first.
    keyed = docs if key_col else cut(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.monotonically_increasing_id().alias(key)))
    if not key_col:
        id_col, text_col = "id", "text"
    counts = docs.sparkSession.sparkContext.broadcast(shingle_counts(keyed, text_col, words_per_shingle))
    fields = "digest binary, size int, sketch array<long>, leading array<long>, f0 long"
    rows = cut(
        map_rows(keyed, [F.col(key), F.col(id_col).cast("long")], [F.col(text_col).cast("binary")], lambda: _describe_sets(words_per_shingle, similarity, counts), fields)
        .withColumnRenamed("c0", "row_key")
        .withColumnRenamed("c1", "id")
    )
    counts.unpersist()
    sets = cut(distinct_rows(rows, ["digest", "f0"]))
    nodes = rows.join(sets.select(F.col("node").alias("row_key")), "row_key").withColumnRenamed("row_key", "node")
    placed = nodes.select("node", "size", F.posexplode("leading").alias("place", "shingle")).select("shingle", "node", "size", "place")
    # Ranges, so that a frequent shingle spreads; each range has a head of its own for it.
    listed = placed.repartitionByRange(tasks_for(docs.sparkSession) * 2, "shingle", "node").sortWithinPartitions("shingle", "node")
    shared = cut(listed.mapInArrow(_shared, "shingle long, node long, size int, place int, head long, head_size int"))
    sizes = F.col("size"), F.col("head_size")
    starred = shared.where((F.col("head") != F.col("node")) & (F.least(*sizes) >= similarity * F.greatest(*sizes) - ROUNDING))
    asked = starred.select(F.greatest("node", "head").alias("u"), F.least("node", "head").alias("v"))
    asked = asked.unionByName(proposed(sets.select("node", "f0"), RADIUS, slice_rows)).distinct()
    first = cut(may_be_similar(asked, nodes.select("node", "size", "sketch"), similarity))
    known = confirmed(first, keyed, text_col, key, words_per_shingle, similarity)
    joined = components(known)
    pairs = cut(similar_pairs(shared, nodes.select("node", "sketch"), joined, similarity, slice_rows).join(first, ["u", "v"], "left_anti"))
    light = cut(rows.select("row_key", "id", "digest"))
    forget(shared, rows)
    more = confirmed(pairs, keyed, text_col, key, words_per_shingle, similarity)
    forget(first, pairs)
    return _with_groups(light, sets, known.unionByName(more), ["digest"]).select("row_key", "id", "component_id", "kept")
