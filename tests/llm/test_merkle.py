import random
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from tests.conftest import ORACLE
from tests.llm.fixtures import AWKWARD, awkward, nothing
from tests.oracle import assert_same
from trainkit.llm import merkle, queries

FIELDS = ("doc_id", "source", "text")
SCHEMA = "doc_id long, source string, text string"


def h(*texts):
    return sha256("".join(texts).encode()).hexdigest()


def leaf_of(row):
    return h(*["-" if x is None else f"{len(str(x).encode())}:{x}" for x in row])


def tree(nodes):
    """(root, for each node its path of (left, right))."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, k in enumerate(at):
            run = nodes[k // 3 * 3 : k // 3 * 3 + 3]
            paths[i].append(("".join(run[: k % 3]), "".join(run[k % 3 + 1 :])))
        at = [k // 3 for k in at]
        nodes = [h(*nodes[i : i + 3]) for i in range(0, len(nodes), 3)]
    return nodes[0] if nodes else None, paths


def brute(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    found = {}
    for g in order:
        members = sorted(groups[g], key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
        found[g] = (members, *tree([leaf_of(r) for r in members]))
    root, tops = tree([found[g][1] for g in order])
    out = []
    for g, top in zip(order, tops, strict=True):
        members, subroot, paths = found[g]
        out += [(r[0], g, leaf_of(r), tuple(p) + tuple(top), subroot, root) for r, p in zip(members, paths, strict=True)]
    return sorted(out, key=repr)


def check(spark, rows, partitions=3):
    docs = spark.createDataFrame(rows, SCHEMA).repartition(partitions)
    got = merkle.manifest(docs, [F.col(c) for c in FIELDS]).withColumn("folded", merkle.folded(F.col("path"), F.col("leaf")))
    got = got.withColumn("proof", merkle.proof_digest(F.col("path"))).collect()
    assert sorted(((r.id, r.source, r.leaf, tuple((p.left, p.right) for p in r.path), r.subroot, r.root) for r in got), key=repr) == brute(rows)
    assert all(r.folded == r.root and r.proof == h(*[x for p in r.path for x in (p.left, p.right)]) for r in got)


def test_sparse_and_negative_ids(spark):
    rng = random.Random(1)
    ids = [*range(900), *{rng.randrange(-(2**62), 2**62) for _ in range(200)}, 2**63 - 1, -(2**63), *range(4090, 4100), *range(2**29 - 3, 2**29 + 3)]
    check(spark, [(i, rng.choice(["a", "a", "b", None, "é", "", "z"]), f"text {i}") for i in ids])


def test_repeated_and_null_ids(spark):
    rng = random.Random(2)
    rows = [(rng.choice([None, 5, 5, 7, 64, 4096, *range(40)]), rng.choice(["a", "a", None]), rng.choice(["x", "x", "y", "", None])) for _ in range(900)]
    check(spark, rows + [rows[0]] * 70, 5)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 10, 729, 730])
def test_sizes_of_a_tree(spark, n):
    check(spark, [(i, "one", "t") for i in range(n)])


def test_many_groups(spark):
    check(spark, [(i, f"group {i % 800:04d}", "t") for i in range(1000)])


def test_awkward_rows(spark):
    rows = [(r[0], r[3], r[1]) for r in AWKWARD]
    check(spark, rows)
    fields = [F.col(c) for c in FIELDS]
    got = merkle.manifest(awkward(spark), fields)
    assert got.columns == ["id", "source", "leaf", "claimed", "path", "subroot", "root"] and got.count() == len(AWKWARD)
    assert merkle.manifest(nothing(spark), fields).count() == 0


def test_tampering_is_found(spark):
    docs = spark.createDataFrame([(i, "s", f"line\nline {i}") for i in range(30)], SCHEMA)
    fields = [F.col(c) for c in FIELDS]
    other = merkle.leaf([*fields[:2], F.translate("text", "\n", "")])
    got = merkle.manifest(docs, fields, claimed=F.when(F.col("doc_id") % 7 == 0, other))
    got = got.withColumn("ok", merkle.folded(F.col("path"), F.coalesce("claimed", "leaf")) == F.col("root"))
    assert {r.id for r in got.collect() if not r.ok} == {0, 7, 14, 21, 28}


def test_twin(spark):
    assert_same(queries.op11_merkle(spark, ORACLE), queries.ORACLES["op11_merkle"], ORACLE)
