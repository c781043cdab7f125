import math

import pytest
from pyspark.sql import functions as F

from trainkit.functions import arrays as A
from trainkit.functions import losses as L
from trainkit.functions import draws, schedules


def one(spark, *columns, row="1 AS x"):
    return spark.sql(f"SELECT {row}").select(*columns).first()


def test_constant_and_null_arrays(spark):
    got = one(spark, A.minmax_rows(F.array(F.lit(2.0), F.lit(2.0))), A.minmax_rows(F.lit(None).cast("array<double>")), A.to_unit_chw(F.lit(None).cast("array<double>"), 1, 1, 1))
    assert got[0] == [None, None] and got[1] is None and got[2] is None


def test_bce_at_the_ends(spark):
    p = [F.lit(0.0), F.lit(1.0), F.lit(0.0), F.lit(1.0), F.lit(None).cast("double")]
    y = [0.0, 1.0, 1.0, 0.0, 1.0]
    assert list(one(spark, *[L.bce(a, F.lit(b)) for a, b in zip(p, y, strict=True)])) == [0.0, 0.0, 100.0, 100.0, None]


def test_ties_go_to_the_lowest_class(spark):
    logits = F.array(F.lit(1.0), F.lit(3.0), F.lit(3.0))
    got = one(spark, A.argmax(logits), A.rank_of(logits, F.lit(2)), A.rank_of(logits, F.lit(9)), A.topk_classes(logits, 2))
    assert got[0] == 1 and got[1] == 2 and got[2] is None and [r["class"] for r in got[3]] == [1, 2]


def test_moments_of_a_moved_image(spark):
    pixels = F.array(*[F.lit(float(v)) for v in range(4)])
    same = F.array(*[F.lit(float(v)) for v in (1, 0, 0, 0, 1, 0)])
    swapped = F.array(*[F.lit(float(v)) for v in (0, 1, 0, 1, 0, 0)])
    got = one(spark, A.geometric_moment(pixels, 2, 2, 1, 0), A.geometric_moment(pixels, 2, 2, 1, 0, same), A.geometric_moment(pixels, 2, 2, 1, 0, swapped), A.geometric_moment(pixels, 2, 2, 0, 1))
    assert got[0] == got[1] == 1.0 and got[2] == got[3] == 1.25


def test_heat_without_cap(spark):
    got = one(spark, A.heat_color(F.lit(0.75), capped=False)["r"], A.heat_color(F.lit(0.75))["r"])
    want = 0.5 * math.exp(-(0.15**2) / 0.08) + math.exp(-(0.05**2) / 0.18)
    assert got[0] == pytest.approx(want) and got[1] == 1.0


def test_scalar_quantize_takes_the_first_on_ties(spark):
    assert list(one(spark, A.scalar_quantize(F.lit(1.0), (-10.0, 0.0, 4.0, 3.0)), A.scalar_quantize(F.lit(3.5), (4.0, 3.0)))) == [0.0, 4.0]


# Learning rates of two published run logs, by epoch from 1; the steps per epoch are inferred.
LOGGED = {
    576: [0.099992, 0.099963, 0.099912, 0.099839, 0.099744, 0.099627, 0.099489, 0.099328, 0.099146, 0.098942, 0.098717, 0.098471],
    500: [0.099993, 0.099964, 0.099914, 0.099841, 0.099747, 0.099631, 0.099492, 0.099333, 0.099151, 0.098948, 0.098723, 0.098477, 0.098209, 0.097921],
}


@pytest.mark.parametrize("steps,rates", LOGGED.items())
def test_logged_learning_rates(spark, steps, rates):
    rate = schedules.lr_warmup_cosine(F.col("id") * steps, 100, 150 * steps, 0.1)
    got = [r[0] for r in spark.range(1, len(rates) + 1).select(F.round(rate, 6)).collect()]
    assert got == pytest.approx(rates, abs=1.5e-6)


def test_warm_up_and_floor(spark):
    rate = schedules.lr_warmup_cosine(F.col("id"), 10, 100, 1.0)
    got = {r[0]: r[1] for r in spark.range(0, 101).select("id", rate).collect()}
    assert got[0] == 0 and got[5] == 0.5 and got[10] == 1.0 and got[100] == pytest.approx(0.0, abs=1e-12)


def test_long_arrays_take_time_in_proportion(spark):
    """Softmax over 10,000 classes and the statistics of a 3 x 224 x 224 image, each in seconds."""
    import time

    import numpy as np
    from pyspark.sql import functions as F

    from trainkit.functions import arrays, losses
    from trainkit.operators import metrics

    rng = np.random.default_rng(0)
    logits, image = rng.normal(size=10_000), rng.normal(size=3 * 224 * 224)
    rows = spark.createDataFrame([(logits.tolist(), 5)] * 4, "v array<double>, label int")
    began = time.perf_counter()
    row = rows.select(arrays.softmax(F.col("v")).alias("s"), arrays.max_softmax(F.col("v")).alias("m"), arrays.minmax_rows(F.col("v")).alias("r"), losses.cross_entropy(F.col("v"), F.col("label")).alias("c"), arrays.rank_of(F.col("v"), F.col("label")).alias("k")).collect()[0]
    want = np.exp(logits - logits.max()) / np.exp(logits - logits.max()).sum()
    assert np.allclose(row.s, want) and np.isclose(row.m, want.max()) and np.isclose(row.c, -np.log(want[5])) and row.k == 1 + (logits > logits[5]).sum()
    assert np.allclose(row.r, (logits - logits.min()) / (logits.max() - logits.min()))
    stats = metrics.channel_mean_std(spark.createDataFrame([(image.tolist(),)], "a array<double>"), "a", 3, 224 * 224).orderBy("channel").collect()
    assert np.allclose([(r["mean"], r["std"]) for r in stats], [(c.mean(), c.std(ddof=1)) for c in image.reshape(3, -1)])
    assert time.perf_counter() - began < 60


def test_normal_draws(spark):
    drawn = spark.range(3000).select(draws.normals(4, 7, F.col("id")).alias("x")).collect()
    flat = sorted(v for r in drawn for v in r.x)
    assert abs(sum(flat) / len(flat)) < 0.04 and abs(sum(v * v for v in flat) / len(flat) - 1) < 0.05
    assert abs(flat[len(flat) // 2]) < 0.05 and abs(sum(v > 1.96 for v in flat) / len(flat) - 0.025) < 0.006
    df = spark.createDataFrame([(1, [0.5, 1.0], [0.0, 0.0]), (1, [0.5, 1.0], [0.0, 0.0]), (2, [], []), (3, None, [1.0]), (None, [1.0], [1.0])], "id long, mu array<double>, v array<double>")
    made = df.select("id", A.reparameterize(F.col("mu"), F.col("v"), seed=3, key=F.col("id")).alias("z"), draws.normals(2, 3, F.lit(1)).alias("e")).collect()
    by_id = {r.id: r.z for r in made}
    assert made[0].z == made[1].z == [0.5 + made[0].e[0], 1.0 + made[0].e[1]] and by_id[2] == [] and by_id[3] is None and by_id[None] is None
    with pytest.raises(ValueError):
        A.reparameterize(F.col("mu"), F.col("v"))
