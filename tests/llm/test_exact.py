import random
import re
from hashlib import sha256

from tests.conftest import ORACLE
from tests.llm.fixtures import AWKWARD, awkward, nothing
from tests.oracle import assert_same
from trainkit.llm import exact, queries


def brute(rows):
    groups = {}
    for doc_id, text in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0d]+", " ", text or ""), []).append(doc_id)
    return {t: (min((i for i in ids if i is not None), default=None), len(ids)) for t, ids in groups.items()}


def check(spark, rows, partitions):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(partitions)
    got = exact.exact_groups(docs).collect()
    want = brute(rows)
    by_sha = {sha256(t.encode()).hexdigest(): v for t, v in want.items()}
    assert len(got) == len(rows)
    assert {r.text_sha256: (r.keep_id, r.group_size) for r in got} == by_sha
    assert all((r.keep_id, r.group_size) == by_sha[r.text_sha256] for r in got)
    kept = [r for r in got if r.kept]
    assert sorted(r.text_sha256 for r in kept) == sorted(by_sha)
    assert all(r.id == r.keep_id for r in kept)


def test_awkward_rows(spark):
    check(spark, [r[:2] for r in AWKWARD], 3)
    assert exact.exact_groups(awkward(spark)).columns == ["row_key", "id", "keep_id", "group_size", "kept", "text_sha256"]


def test_empty_table(spark):
    assert exact.exact_groups(nothing(spark)).count() == 0


def test_a_group_over_many_partitions(spark):
    rng = random.Random(1)
    rows = [(i, "hot  text" if i % 3 else f"text {rng.randrange(40)}") for i in range(2000)]
    rows += [(None, "only nulls")] * 3
    rng.shuffle(rows)
    check(spark, rows, 5)


def test_one_text_only(spark):
    check(spark, [(i, "same") for i in range(500)], 4)


def test_twin(spark):
    assert_same(queries.op5_exact_dedup(spark, ORACLE), queries.OP5_SQL, ORACLE)
