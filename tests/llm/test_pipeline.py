from hashlib import sha256

import corpus_pipeline
from tests.conftest import ORACLE
from tests.llm.fixtures import AWKWARD
from tests.llm.test_decontam import brute
from tests.llm.test_mixing import check as check_mix
from tests.llm.test_simhash import shingle_set, similar


def test_stages_one_by_one(spark, tmp_path):
    docs = spark.read.parquet(f"{ORACLE}/documents.parquet")
    bench = [tuple(r) for r in spark.read.parquet(f"{ORACLE}/benchmark.parquet").select("item_id", "text").collect()]
    toxic = {r.doc_id for r in spark.read.parquet(f"{ORACLE}/labels.parquet").where("toxic = 1").collect()}
    clean = {r.doc_id for r in spark.read.parquet(f"{ORACLE}/labels.parquet").where("toxic = 0").collect()}
    before = {r.doc_id: r.text for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, ORACLE).write.parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
        if name == "mixing":
            assert after.count() == len(before)
            check_mix([r.asDict() for r in after.collect()])
            return
        assert after.columns == docs.columns
        kept = {r.doc_id: r.text for r in after.collect()}
        assert kept.items() <= before.items() and after.count() == len(kept)
        gone = {i: t for i, t in before.items() if i not in kept}
        if name == "toxicity":
            assert len(gone.keys() & toxic) >= 0.8 * len(toxic) and len(gone.keys() & clean) <= 0.02 * len(clean)
        if name == "exact_dedup":
            digest = lambda t: sha256(" ".join((t or "").replace("\n", " ").split(" ")).encode()).hexdigest()
            assert {digest(t) for t in gone.values()} <= {digest(t) for t in kept.values()}
        if name == "near_dedup":
            sets = {i: shingle_set(t) for i, t in before.items()}
            assert all(any(similar(sets[i], sets[j]) for j in sets if j != i) for i in gone)
            left = sorted(kept)
            close = sum(similar(sets[i], sets[j]) for k, i in enumerate(left) for j in left[:k])
            assert close <= 1
        if name == "decontamination":
            assert set(gone) == {i for i, t in before.items() if (n := brute(t, bench))[1] and 20 * n[1] >= n[0]}
        docs, before = after, kept


def test_awkward_rows_and_clashing_names(spark, tmp_path):
    """Every stage takes nulls, repeats, empty and long texts and any column names, and an empty table."""
    names = ["doc_id", "text", "row_key", "kept", "c0", "source", "a`b", "score", "my col"]
    rows = [(r[0], r[1], r[7], r[8], r[6], r[3], r[2], r[5], r[4]) for r in AWKWARD]
    odd = spark.createDataFrame(rows, ", ".join(f"`{n.replace('`', '``')}` {t}" for n, t in zip(names, "long string string string long string string double long".split(), strict=True)))
    for docs, counts in ((odd.repartition(2), [11, 7, 6, 11, 11]), (odd.limit(0), [0] * 5)):
        for (name, stage), count in zip(corpus_pipeline.STAGES, counts, strict=True):
            out = stage(spark, docs, "/root/testdata/sf0.001").collect()
            assert len(out) == count, name
            if name != "mixing":
                assert all(tuple(r) in rows for r in out) and (not out or list(out[0].asDict()) == names)


def test_whole_run(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.count() > 0
