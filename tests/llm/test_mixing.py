import pytest

from tests.conftest import ORACLE
from tests.llm.fixtures import awkward, nothing
from trainkit.llm import mixing, queries


def brute_targets(sizes, weights=(1, 2, 3), cap=3):
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    w = {s: weights[k % 3] for k, s in enumerate(order)}
    held, total = {}, sum(sizes.values())
    while True:
        free = [s for s in order if s not in held]
        rest = total - sum(held.values())
        share = {s: rest * w[s] / sum(w[x] for x in free) for s in free}
        over = [s for s in free if share[s] > cap * sizes[s]]
        if not over:
            return held | share
        held |= {s: cap * sizes[s] for s in over}


def source_sizes(rows):
    out = {}
    for r in rows:
        out[r["source"]] = out.get(r["source"], 0) + r["size"]
    return out


def check(rows):
    sizes = source_sizes(rows)
    want = brute_targets(sizes)
    taken, longest = {}, {}
    for r in rows:
        assert r["target"] == pytest.approx(want[r["source"]])
        assert r["source_size"] == sizes[r["source"]]
        assert 0 <= r["taken"] <= 3 * r["size"] and (r["size"] == 0 or r["taken"] % r["size"] == 0)
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
        longest[r["source"]] = max(longest.get(r["source"], 0), r["size"])
    for source, words in taken.items():
        assert abs(words - want[source]) <= longest[source] + 1e-6
    return taken, want


def test_awkward_rows(spark):
    rows = [r.asDict() for r in mixing.mix(awkward(spark)).collect()]
    assert len(rows) == 11
    check(rows)


def test_empty_table(spark):
    assert mixing.mix(nothing(spark)).count() == 0


def test_query(spark):
    docs = {r.doc_id: r.source for r in spark.read.parquet(f"{ORACLE}/documents.parquet").select("doc_id", "source").collect()}
    got = queries.op9_mixing(spark, ORACLE).collect()
    again = queries.op9_mixing(spark, ORACLE).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))
    taken, want = check([r.asDict() | {"source": docs[r.doc_id]} for r in got])
    assert all(abs(taken[s] - want[s]) <= 0.05 * want[s] for s in want)


def test_reshare_over_several_rounds(spark):
    rows = [(i, s, n) for i, (s, n) in enumerate([("a", 1), ("b", 2), ("c", 5), ("d", 40), ("e", 300), ("f", 4000), ("g", 0), (None, 10)])]
    frame = spark.createDataFrame(rows, "id long, src string, size long")
    got = {(r.src if r.has_src else None): r.target for r in mixing.source_targets(frame).collect()}
    assert got == pytest.approx(brute_targets({s: n for _, s, n in rows}))


def test_fair_in_expectation(spark):
    rows = [(i, "w " * (1 + i % 7), "a" if i % 4 else "b") for i in range(400)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string").cache()
    total = {}
    for seed in range(8):
        for r in mixing.mix(frame, seed=seed).collect():
            total.setdefault(r.source, []).append(r.copies / (r.target / r.source_size))
    assert all(abs(sum(x) / len(x) - 1) < 0.1 for x in total.values())


def test_large_groups_use_the_tree(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 16)
    monkeypatch.setattr(mixing, "TREE_FANOUT", 4)
    rows = [(i, "w " * (1 + i % 11), "hot" if i % 3 else f"s{i % 5}") for i in range(1500)]
    got = [r.asDict() for r in mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()]
    assert len(got) == len(rows)
    check(got)
