import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import ORACLE
from tests.oracle import assert_same
from trainkit.llm import negatives, queries

SCHEMA = "vec_id long, embedding array<double>, label int, id long, anchor string"


def brute(rows, k=5, m=10):
    sound = [(i, label, [math.floor(256 * x) for x in v]) for i, v, label, *_ in rows if None not in (i, v, label) and all(x is not None and math.isfinite(x) for x in v)]
    found = []
    for i, label, v in {(i, label, tuple(v)) for i, label, v in sound if i % 100 == 0}:
        scored = [(sum(a * b for a, b in zip(v, w, strict=False)), j, other) for j, other, w in sound]
        order = lambda x: (-x[0], x[1])
        for ps, p, _ in sorted((s for s in scored if s[2] == label and s[1] != i), key=order)[:k]:
            fits = sorted((s for s in scored if s[2] != label and 30 * ps <= 100 * s[0] <= 90 * ps), key=order)[:m]
            found += [(i, p, rank, n, ps, ns) for rank, (ns, n, _) in enumerate(fits, 1)]
    return sorted(found)


def check(spark, rows, partitions=3, **how):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA).repartition(partitions)
    got = negatives.mine(df, F.col("id") % 100 == 0, **how)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(map(tuple, got.collect())) == brute(rows)


@pytest.mark.parametrize("width, scale", [(1, 3.0), (64, 0.1), (64, 1e5), (1300, 2.0), (3000, 7.0)])
def test_products_are_exact(width, scale):
    rng = np.random.default_rng(width)
    a, b = (np.floor(256 * scale * rng.standard_normal((20, width))).astype(np.int64) for _ in range(2))
    a[0], b[0] = abs(a).max(), -abs(b).max()
    norm = int(max((x.astype(object) ** 2).sum(axis=1).max() for x in (a, b)))
    system = negatives.Residues(norm)
    assert (system.products(system.of(a), system.of(b)) == a.astype(object) @ b.astype(object).T).all()
    assert math.prod(system.primes) > 2 * norm and all((p // 2) ** 2 * c <= negatives.EXACT for p, c in zip(system.primes, system.columns, strict=True))


def test_scores_up_to_the_limit():
    a = np.array([[2**31, 0], [-(2**31), 1], [3, -5]], np.int64)
    system = negatives.Residues(2**62)
    assert (system.products(system.of(a), system.of(a)) == a.astype(object) @ a.astype(object).T).all() and len(system.primes) == 9


def test_random_vectors(spark):
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0.05, 0.1) for _ in range(24)], rng.randrange(4)) for i in range(420)]
    check(spark, rows)
    check(spark, rows, anchor_rows=2)


def test_ties_and_one_common_vector(spark, monkeypatch):
    monkeypatch.setattr(negatives, "ROWS_AT_ONCE", 64)
    rng = random.Random(4)
    common = [0.25] * 6
    rows = [(i, common if i % 3 else [rng.choice([0.0, 0.125, 0.25]) for _ in range(6)], rng.choice([1, 1, 2])) for i in range(600)]
    check(spark, rows, 5)


def test_awkward_rows(spark):
    rows = [
        (0, [1.0, 2.0], 1), (100, [1.0, None], 1), (200, None, 1), (300, [1.0, float("nan")], 2), (400, [float("inf"), 0.0], 2), (500, [1.0, 1.0], None),
        (None, [1.0, 1.0], 1), (1, [1.0, 1.5], 1), (1, [1.0, 1.5], 1), (2, [1.0], 1), (3, [0.4, 0.3, 9.0], 2), (3, [0.4, 0.3, 9.0], 2), (4, [], 2), (5, [0.5, 0.6], 2),
        (600, [-1.0, -1.0], 2), (700, [0.0, 0.0], 2), (700, [0.0, 0.0], 2), (6, [-0.001, 0.7], 3), (100, [0.5, 0.5], 1), (100, [0.5, 0.5], 1), (100, [0.9, 0.5], 1),
    ]
    check(spark, rows)
    check(spark, [(0, [1.0], 1)])
    check(spark, [])
    huge = negatives.mine(spark.createDataFrame([(0, [1e300], 1, 1, "x"), (1, [1.0], 1, 1, "x")], SCHEMA), F.lit(True))
    assert huge.count() == 0


def test_twin(spark):
    assert_same(queries.op12_hard_negatives(spark, ORACLE), queries.ORACLES["op12_hard_negatives"], ORACLE)
