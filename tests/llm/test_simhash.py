import itertools

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.conftest import ORACLE
from tests.llm.fixtures import AWKWARD, awkward, nothing
from trainkit.llm import queries, simhash


def plain_fingerprint(text, k=4):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(codes, radius):
    root = {c: c for c in codes}

    def find(c):
        while root[c] != c:
            c = root[c]
        return c

    codes = list(codes)
    for i, a in enumerate(codes):
        for b in codes[:i]:
            if (a ^ b).bit_count() <= radius:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {c: find(c) for c in codes}


def near_codes(rng, n, families, flips):
    base = rng.integers(0, 1 << 63, families, dtype=np.uint64)
    out = base[rng.integers(0, families, n)]
    for _ in range(flips):
        out = out ^ (np.uint64(1) << rng.integers(0, 64, n, dtype=np.uint64))
    return np.unique(out)


def brute_partition(nodes, pairs):
    root = {c: c for c in nodes}

    def find(c):
        while root[c] != c:
            root[c] = root[root[c]]
            c = root[c]
        return c

    for a, b in pairs:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {c: find(c) for c in nodes}


@settings(max_examples=40, deadline=None)
@given(st.text(alphabet=st.sampled_from("aAbZé \t\n　x1"), max_size=60))
def test_fingerprint(text):
    first = int(simhash.fingerprint(text.encode())[0])
    assert first == plain_fingerprint(text)
    assert simhash.fingerprint(text.encode(), width=2).tolist()[0] == first


def test_gray_rank_inverts_the_gray_code():
    n = np.arange(5000, dtype=np.uint64)
    assert (simhash.gray_rank(n ^ (n >> np.uint64(1))) == n).all()


def popcount(x):
    return np.bitwise_count(x).sum(axis=-1, dtype=int)


def test_index_finds_all_pairs():
    rng = np.random.default_rng(0)
    for width, radius in ((1, 4), (2, 12)):
        codes = np.stack([near_codes(rng, 700, 30, 4)[:400] for _ in range(width)], axis=1)
        index = simhash.GrayIndex(codes)
        q, c, d = index.search(index.codes, radius)
        every = popcount(index.codes[:, None] ^ index.codes[None, :])
        assert sorted(zip(q.tolist(), c.tolist(), strict=True)) == sorted(map(tuple, np.argwhere(every <= radius).tolist()))
        assert (every[q, c] == d).all()


@pytest.mark.parametrize("radii", [[4], [1, 2, 3, 4]])
def test_spanning_links_connect_what_pairs_connect(radii):
    rng = np.random.default_rng(1)
    for n, families in ((40, 5), (900, 12), (900, 1)):
        codes = near_codes(rng, n, families, 3)
        whole, want = codes[:, None], brute_components(codes.tolist(), 4)

        def links_of(u, v, of=codes):
            assert (popcount((of[u] ^ of[v])[:, None]) <= 4).all()
            return list(zip(of[u].tolist(), of[v].tolist(), strict=True))

        pairs = links_of(*simhash.spanning_links(whole, radii, at_once=64))
        assert brute_partition(codes.tolist(), pairs) == want
        assert len(pairs) < 3 * len(codes)
        half = len(codes) // 2
        pairs = links_of(*simhash.spanning_links(whole[:half], radii)) + links_of(*simhash.spanning_links(whole[half:], radii), codes[half:])
        pairs += links_of(*simhash.spanning_links(whole[:half], radii, whole[half:], at_once=64))
        assert brute_partition(codes.tolist(), pairs) == want


def test_links_with_sliced_keys(spark):
    codes = near_codes(np.random.default_rng(2), 600, 4, 4)
    frame = spark.createDataFrame([(i, int(c)) for i, c in enumerate(codes.view(np.int64))], "node long, f0 long")
    edges = simhash.links(frame, simhash.block_masks(4), [4], slice_rows=50)
    want = brute_components(codes.tolist(), 4)
    assert brute_partition(codes.tolist(), [(int(codes[r.u]), int(codes[r.v])) for r in edges.collect()]) == want


def test_keys_of_more_blocks_find_the_same_links(spark):
    codes = near_codes(np.random.default_rng(3), 900, 60, 4)
    frame = spark.createDataFrame([(i, int(c)) for i, c in enumerate(codes.view(np.int64))], "node long, f0 long")
    want = brute_components(codes.tolist(), 4)
    for blocks in (6, 7):
        edges = simhash.links(frame, simhash.block_masks(4, blocks), [4], slice_rows=100)
        assert brute_partition(codes.tolist(), [(int(codes[r.u]), int(codes[r.v])) for r in edges.collect()]) == want


def test_keys_grow_with_the_table():
    """As many keys a row from a thousand to ten million rows; beyond, longer keys instead of ever more slices."""
    assert {simhash.blocks_for(10**k, 4) for k in range(3, 8)} == {5}
    assert [len(simhash.block_masks(4, simhash.blocks_for(10**k, 4))) for k in (8, 9, 10)] == [15, 15, 35]


def test_windows_of_long_runs(monkeypatch):
    """Runs in pieces find what whole runs find, and no own pair twice."""
    import pyarrow as pa

    codes = near_codes(np.random.default_rng(4), 500, 3, 3)
    n = len(codes)
    rows = sorted((int(k), 0, bool(i >= n // 4), i) for k in range(3) for i in range(n))
    table = pa.table({"key": [r[0] for r in rows], "part": [0] * len(rows), "query": [r[2] for r in rows], "node": [r[3] for r in rows], "table": pa.array([0] * len(rows)), "f0": codes.view(np.int64)[[r[3] for r in rows]]})
    masks = np.zeros((1, 1), np.uint64)
    pairs = {}
    for at_once in (10**6, 150):
        monkeypatch.setattr(simhash.windows, "__defaults__", (at_once,))
        out = list(simhash._link_keys([4], masks)(iter(table.to_batches(max_chunksize=40))))
        pairs[at_once] = [(u, v) for b in out for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
    assert brute_partition(range(n), pairs[150]) == brute_partition(range(n), pairs[10**6])


def test_components(spark):
    pairs = [(i, i + 1) for i in range(60)] + [(100, j) for j in range(101, 180)] + [(-5, 7), (300, 301)]
    got = simhash.components(spark.createDataFrame(pairs, "u long, v long")).collect()
    nodes = {x for p in pairs for x in p}
    assert {r.node: r.root for r in got} == brute_partition(nodes, pairs)
    assert len(got) == len(nodes)


def check(docs, rows):
    got = simhash.near_groups(docs).collect()
    assert len(got) == len(rows)
    fps = {plain_fingerprint(t) for _, t in rows}
    root = brute_components(fps, 4)
    low = {}
    for i, t in rows:
        r = root[plain_fingerprint(t)]
        low[r] = min((x for x in (low.get(r), i) if x is not None), default=None)
    want = sorted(((i is None, i), f"{plain_fingerprint(t):016x}", low[root[plain_fingerprint(t)]]) for i, t in rows)
    assert sorted(((r.id is None, r.id), r.fingerprint, r.component_id) for r in got) == want
    kept = [r for r in got if r.kept]
    assert len(kept) == len(low)
    assert all(r.id == r.component_id for r in kept)


def test_awkward_rows(spark):
    check(awkward(spark), [r[:2] for r in AWKWARD])
    assert simhash.near_groups(nothing(spark)).count() == 0


def test_query_against_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{ORACLE}/documents.parquet").select("doc_id", "text").collect()]
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op4_simhash(spark, ORACLE).collect()}
    fp = {i: plain_fingerprint(t) for i, t in rows}
    root = brute_components(set(fp.values()), 4)
    low = {}
    for i, f in fp.items():
        low[root[f]] = min(i, low.get(root[f], i))
    assert got == {i: (f"{f:016x}", low[root[f]]) for i, f in fp.items()}


def shingle_set(text, k=5):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def similar(a, b):
    return len(a & b) >= 0.8 * len(a | b)


def test_shingle_counts_of_all_texts(spark):
    expected = np.zeros(simhash.ORDER_BUCKETS, np.int64)
    for row in AWKWARD:
        words = (row[1] or "").encode().lower().split()
        for shingle in {b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else ():
            expected[xxhash.xxh64_intdigest(shingle, 42) * simhash.ORDER_BUCKETS >> 64] += 1
    assert (simhash.shingle_counts(awkward(spark), "text", 5) == expected).all()
    assert not simhash.shingle_counts(nothing(spark), "text", 5).any()


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=24), st.lists(st.integers(1, 24), max_size=5), st.integers(1, 5))
def test_shingles_shared_across_ranges(shingles, cuts, rows):
    """However sorted rows are cut into ranges and batches, rows that share a shingle are passed on, and heads are of their shingle."""
    listed = [(s, n, 10, 0) for n, s in enumerate(sorted(shingles))]
    bounds = sorted({0, len(listed), *(c for c in cuts if c < len(listed))})
    got = []
    for a, b in itertools.pairwise(bounds):
        batches = [
            pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*listed[i : min(i + rows, b)], strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], names=["shingle", "node", "size", "place"])
            for i in range(a, b, rows)
        ]
        got += [tuple(r.values()) for batch in simhash._shared(iter(batches)) for r in batch.to_pylist()]
    assert len({r[:4] for r in got}) == len(got) and {r[:4] for r in got} <= set(listed)
    assert {r[:4] for r in got} >= {r for r in listed if shingles.count(r[0]) > 1}
    assert all(listed[r[4]][0] == r[0] and r[4] <= r[1] for r in got)


def test_similar_groups_of_awkward_rows(spark):
    got = simhash.similar_groups(awkward(spark)).collect()
    assert len(got) == len(AWKWARD)
    assert sum(r.kept for r in got) == len({r.component_id for r in got if r.component_id is not None}) + 1  # one group has null ids only
    assert {r.id: r.component_id for r in got}[5] == 1
    assert simhash.similar_groups(nothing(spark)).count() == 0


def test_similar_groups_of_one_large_family(spark):
    import random

    rng = random.Random(5)
    base = [f"w{rng.randrange(900)}" for _ in range(300)]
    rows = []
    for i in range(600):
        text = list(base)
        for _ in range(2):
            text[rng.randrange(300)] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(text)))
    rows += [(600 + i, " ".join(f"y{rng.randrange(10**6)}" for _ in range(40))) for i in range(300)]
    got = simhash.similar_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    kept = sorted(r.id for r in got if r.kept)
    assert kept == [0, *range(600, 900)]


def test_recall_against_brute_force(spark):
    """All pairs of 5-word shingle sets at 0.8 or more in the whole table: the groups are the same."""
    sf = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    sets = {r.doc_id: shingle_set(r.text) for r in docs.select("doc_id", "text").collect()}
    by_shingle = {}
    for i, s in sets.items():
        for x in s:
            by_shingle.setdefault(x, []).append(i)
    pairs = set()
    for i, s in sets.items():  # a similar set shares one of the rarest fifth of the shingles
        rare = sorted(s, key=lambda x: (len(by_shingle[x]), x))[: len(s) // 5 + 1]
        for j in {j for x in rare for j in by_shingle[x]}:
            if j < i and similar(sets[i], sets[j]):
                pairs.add((i, j))
    want = brute_partition(list(sets), pairs)
    got = {r.id: r.component_id for r in simhash.similar_groups(docs).collect()}
    assert len(pairs) > 200
    assert got == want


def brute_groups(texts):
    sets = {i: shingle_set(t) for i, t in texts.items()}
    return brute_partition(list(sets), [(i, j) for i in sets for j in sets if j < i and sets[i] & sets[j] and similar(sets[i], sets[j])])


def groups_of(spark, texts, **options):
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    return {r.id: r.component_id for r in simhash.similar_groups(docs, **options).collect()}


@pytest.mark.parametrize("slice_rows", [simhash.SLICE, 7])
def test_families_around_the_similarity(spark, slice_rows):
    """Families whose members lie at 0.7 to 0.9 of each other: the groups are the brute-force ones, without tolerance."""
    import random

    rng = random.Random(11)
    texts = {}
    for family in range(25):
        base = [f"w{rng.randrange(5000)}" for _ in range(150)]
        for _ in range(20):
            text = list(base)
            for _ in range(rng.randrange(1, 6)):
                text[rng.randrange(150)] = f"x{family}_{rng.randrange(12)}"
            texts[len(texts)] = " ".join(text)
    want = brute_groups(texts)
    assert 25 < len(set(want.values())) < 480
    assert groups_of(spark, texts, slice_rows=slice_rows) == want


def test_families_of_two_or_three_changed_words(spark):
    """Six families of 60 documents of 200 words: each pair at 0.8 or more ends in one group."""
    import random

    rng = random.Random(3)
    texts = {}
    for family in range(6):
        base = [f"w{family}_{rng.randrange(4000)}" for _ in range(200)]
        for _ in range(60):
            text = list(base)
            for _ in range(rng.choice((2, 3))):
                text[rng.randrange(200)] = f"x{rng.randrange(10**6)}"
            texts[len(texts)] = " ".join(text)
    assert groups_of(spark, texts) == brute_groups(texts)


def test_one_repeated_line_does_not_make_texts_similar(spark):
    """Same 128-bit fingerprint, Jaccard below 0.1."""
    line = " ".join(f"l{i}" for i in range(11))
    texts = {k: " ".join([*(f"{k}u{i}" for i in range(60)), *[line] * 100]) for k in range(3)}
    assert len({tuple(simhash.fingerprint(t.encode(), 5, 2).tolist()) for t in texts.values()}) == 1
    assert groups_of(spark, texts) == {0: 0, 1: 1, 2: 2}


def test_numbers_of_repeats_do_not_count(spark):
    """Near shingle sets whose weighted fingerprints differ widely."""
    line = " ".join(f"l{i}" for i in range(11))
    body = [f"b{i}" for i in range(200)]
    other = [*body[:100], "changed", *body[101:]]
    texts = {k: " ".join([*words, *[line] * n]) for k, (words, n) in enumerate([(body, 40), (other, 2)])}
    assert groups_of(spark, texts) == brute_groups(texts) == dict.fromkeys(range(2), 0)
