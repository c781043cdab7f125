import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pandas import Series
from pyspark.sql import functions as F

from tests.conftest import ORACLE
from tests.llm.fixtures import awkward, nothing
from trainkit.llm import queries, toxicity
from trainkit.llm.common import hash_share


def brute_segments(scores, offset=0):
    """The best interval (shortest, leftmost), then the same on both sides of it."""
    best = None
    for i in range(len(scores)):
        for j in range(i + 1, len(scores) + 1):
            s = sum(scores[i:j])
            if s > 0 and (best is None or s > best[2] or (s == best[2] and j - i < best[1] - best[0])):
                best = (i, j, s)
    if best is None:
        return []
    i, j, s = best
    return brute_segments(scores[:i], offset) + [(i + offset, j + offset, s)] + brute_segments(scores[j:], offset + j)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from([-3.0, -1.0, -0.5, 0.25, 1.0, 2.5]), max_size=16))
def test_segments_against_brute_force(scores):
    got = toxicity.segments(np.array(scores))
    assert sorted(s for _, _, s in got) == sorted(s for _, _, s in brute_segments(scores))


def test_segments_in_linear_time():
    """Alternating words once made every word look back at all earlier segments."""
    import time

    began = time.perf_counter()
    assert len(toxicity.segments(np.tile([1.0, -0.999], 100_000))) == 1
    assert len(toxicity.segments(np.tile([1.0, -1.001], 100_000))) == 100_000
    assert time.perf_counter() - began < 5


def test_query_against_brute_force(spark):
    """Scores of short documents, segment by segment in plain Python, from the counts that were learnt."""
    docs = spark.read.parquet(f"{ORACLE}/documents.parquet")
    labels = spark.read.parquet(f"{ORACLE}/labels.parquet").where(queries.id_remainder("doc_id", 4) != 2)
    model = toxicity.learn(docs, labels)
    odds = model.odds()
    got = {r.doc_id: r for r in queries.op10_toxicity(spark, ORACLE).collect()}
    seen = 0
    for r in docs.select("doc_id", "text").collect():
        words = toxicity.words_of(r.text)
        if len(words) > 60:
            continue
        scores = odds.of(words).tolist()
        found = [model.rate * s - np.log(model.size * len(words)) for _, _, s in brute_segments([s - toxicity.PENALTY for s in scores])]
        strong = sum(x for x in found if x > 0)
        faint = 0.02 / (1 + np.exp(-sum(scores) / len(scores))) if scores else 0.0
        want = 0.02 + 0.98 * (1 - np.exp(-model.scale * strong)) if strong > 0 else faint
        assert abs(got[r.doc_id].score - want) < 1e-6 and got[r.doc_id].predicted == int(want >= 0.3)
        seen += 1
    assert seen > 50


def test_a_rare_inflection_inherits_from_its_stem():
    counts = sorted((toxicity.hash_of(k), v) for k, v in {"4:grob": (50, 0), "5:grobi": (50, 0), "grobian": (50, 0), "4:haus": (5, 500)}.items())
    odds = toxicity.LogOdds(np.array([k for k, _ in counts]), np.array([v for _, v in counts]), 1000, 9000)
    odds.of(["grobians", "hausboot", "grobian"])
    assert odds["grobians"] > 2 > 0 > odds["hausboot"]
    assert odds["grobian"] > odds["grobians"]


def test_awkward_rows(spark):
    docs = spark.createDataFrame([(i, ("nice words here " * 5) + ("awful rotten " * 3 if i % 4 == 0 else ""), "x") for i in range(200)], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(200)] + [(None, None, None), (3, None, None), (9999, 1, 1), (4, 0, 0)], "doc_id long, quality int, toxic int")
    model = toxicity.learn(docs, labels)
    got = {r.c0: (r.score, r.predicted, r.passages) for r in toxicity.score_texts(docs, model, [F.col("doc_id"), F.col("score")]).collect()}
    assert all(got[i][1] == int(i % 4 == 0) for i in got)
    assert got[4][2] and got[4][2][0].start >= 15 and got[4][2][-1].stop <= 21
    odd = toxicity.score_texts(awkward(spark), model, [F.col("doc_id")]).collect()
    assert len(odd) == 11 and all(0 <= r.score <= 1 for r in odd)
    assert {r.score for r in odd if r.c0 in (2, 3, 4)} == {0.0}
    assert toxicity.score_texts(nothing(spark), model, [F.col("doc_id")]).count() == 0


def test_one_id_on_most_rows_is_drawn_by_rows(spark):
    """The bound holds although two thirds of the rows have one id, which is drawn."""
    rows = [(7 if i % 3 else i, f"nice words number {i} " + ("awful rotten " * 3 if i % 4 == 0 else "")) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i == 7 or i % 4 == 0)) for i in range(3000)], "doc_id long, toxic int")
    draws = spark.range(7, 8).select(*[hash_share("id", s).alias(str(s)) for s in range(100)]).first().asDict()
    model = toxicity.learn(docs, labels, train_rows=300, seed=next(int(s) for s, share in draws.items() if share < 0.1))
    assert model.toxic and model.clean
    assert model.toxic + model.clean < 5 * 450  # a text has at most five words that count


def test_nothing_learnt(spark):
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.learn(awkward(spark), labels)
    assert {r.score for r in toxicity.score_texts(awkward(spark), model, [F.col("doc_id")]).collect()} == {0.0}
    clean = spark.createDataFrame([(1, 0)], "doc_id long, toxic int")
    assert not toxicity.learn(awkward(spark), clean).toxic


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = queries.op10_toxicity(spark, sf).collect()
    held = [(r.predicted, labels[r.doc_id]) for r in got if r.held_out and r.doc_id in labels]
    right = sum(p == t == 1 for p, t in held)
    assert len(held) > 500
    assert right >= 0.9 * sum(t for _, t in held) and right >= 0.9 * sum(p for p, _ in held)
    scores = [(r.score, labels[r.doc_id]) for r in got if r.held_out and r.doc_id in labels]
    ranks = Series([s for s, _ in scores]).rank().to_numpy()
    toxic = np.array([t for _, t in scores]) == 1
    assert (ranks[toxic].sum() - toxic.sum() * (toxic.sum() + 1) / 2) / (toxic.sum() * (~toxic).sum()) >= 0.95


def test_query_covers_all_rows(spark):
    got = queries.op10_toxicity(spark, ORACLE).collect()
    assert len({r.doc_id for r in got}) == len(got) == spark.read.parquet(f"{ORACLE}/documents.parquet").count()
