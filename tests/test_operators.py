import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from trainkit.functions.draws import coin, draw
from trainkit.operators import augment, frames, metrics, quantize, runs, scoring, split


def test_two_step_numbers_equal_a_plain_window(spark):
    rng = random.Random(0)
    rows = [(i, None if i % 50 == 0 else f"c{min(3, rng.randrange(8))}") for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, c string").repartition(6)
    got = split.stratified_split(df, "c", "id", 0.8, "hash", 5)
    order = Window.partitionBy("c").orderBy(draw(5, F.col("id")), "id")
    plain = df.withColumn("p", F.row_number().over(order)).withColumn("n", F.count("*").over(Window.partitionBy("c")))
    want = {r.id: "train" if r.p <= r.n * 4 // 5 else "test" for r in plain.collect()}
    assert {r.id: r.split for r in got.collect()} == want
    assert split.split_overlap(got.where("split = 'train'"), got.where("split = 'test'"), "id").count() == 0


def test_split_of_small_classes(spark):
    df = spark.createDataFrame([(1, "one"), (2, "five"), (3, "five"), (4, "five"), (5, "five"), (6, "five")], "id long, c string")
    assert {r.id for r in split.stratified_split(df, "c", "id", order="index").where("split = 'train'").collect()} == {2, 3, 4, 5}
    assert split.stratified_split(df.limit(0), "c", "id", order="index").count() == 0
    with pytest.raises(ValueError):
        split.stratified_split(df, "c", "id", order="other")


def test_no_window_over_a_whole_table(spark):
    plan = split.batch_rows(spark.range(10), "id", 4)._jdf.queryExecution().executedPlan().toString()
    windows = [x for x in plan.splitlines() if "Window [row_number" in x]
    assert windows and all("_bucket" in x for x in windows)


def test_batches(spark):
    got = split.batch_rows(spark.range(103), "id", 10, seed=1, epoch=0, drop_last=True)
    assert got.count() == 100 and got.groupBy("batch_idx").count().where("count = 10").count() == 10
    other = split.batch_rows(spark.range(103), "id", 10, seed=1, epoch=1, drop_last=True)
    assert got.subtract(other).count() > 0
    assert sorted(r.id for r in split.shuffle_rows(spark.range(50), "id").collect()) == list(range(50))


def test_frames_of_all_lengths(spark):
    lengths = {1: 1, 2: 3, 3: 4, 4: 5, 5: 307}
    df = spark.createDataFrame([(v, i, f"{v}-{i}") for v, n in lengths.items() for i in range(n)], "video_id long, frame_idx int, payload string").repartition(3)
    for k in (1, 4, 31):
        got = {}
        for r in frames.resample_frames(df, k).collect():
            got.setdefault(r.video_id, {})[r.slot] = r.frame_idx
        for v, n in lengths.items():
            even = np.linspace(0, n - 1, k, dtype=int).tolist() if n > k else [i % n for i in range(k)]
            assert [got[v][i] for i in range(k)] == even
    assert {(r.video_id, r.frame_idx) for r in frames.middle_frame(df).collect()} == {(v, n // 2) for v, n in lengths.items()}
    assert frames.head_frames(df, 4).count() == 1 + 3 + 4 + 4 + 4
    once, again = (frames.random_frame(x, seed=3).collect() for x in (df, df.repartition(7)))
    assert sorted(once) == sorted(again) and len(once) == 5
    videos = spark.createDataFrame([(v, f"l{v}") for v in range(8)], "video_id long, label string")
    assert {r.video_id for r in frames.drop_empty_samples(videos, df).collect()} == set(lengths)
    assert frames.label_frames(df, videos).count() == df.count()
    assert frames.drop_empty_arrays(spark.sql("SELECT array() AS f UNION ALL SELECT array(1) UNION ALL SELECT NULL"), "f").count() == 1


def vectors(n, d, seed=0):
    return np.random.default_rng(seed).normal(size=(n, d)).tolist()


def test_codes_by_matrix_and_by_join(spark, monkeypatch):
    df = spark.createDataFrame(list(enumerate(vectors(500, 8))), "id long, vec array<double>")
    book = spark.createDataFrame([(i, v) for i, v in enumerate(vectors(15, 8, 1))] + [(15, vectors(15, 8, 1)[3])], "code long, vec array<double>")
    rows = lambda x: sorted((r.id, r.code, round(r.distance, 9)) for r in x.collect())
    want = rows(quantize.assign_codes(df, book, method="join"))
    assert rows(quantize.assign_codes(df, book)) == want
    monkeypatch.setattr(quantize, "CODEBOOK_BYTES", 300)
    assert rows(quantize.assign_codes(df, book)) == want
    assert all(0 <= code < 15 for _, code, _ in want)


@pytest.mark.parametrize("most", [20, 7, 1])
def test_every_code_beyond_the_bound_is_seen(spark, monkeypatch, most):
    """Codes of any spacing, in slices of any size: each vector finds its own code."""
    vecs = vectors(60, 4)
    book = spark.createDataFrame([(i * i + 7 * (i % 3), v) for i, v in enumerate(vecs)], "code long, vec array<double>")
    df = spark.createDataFrame([(i * i + 7 * (i % 3), v, 0) for i, v in enumerate(vecs)], "own long, vec array<double>, code_0 int")
    monkeypatch.setattr(quantize, "CODEBOOK_BYTES", most * 4 * 8)
    got = quantize.assign_codes(df, book)
    assert got.columns == ["own", "vec", "code_0", "code", "distance"]
    assert all(r.code == r.own and r.code_0 == 0 for r in got.collect())
    monkeypatch.setattr(quantize, "CODEBOOK_BYTES", 31)
    with pytest.raises(ValueError):
        quantize.assign_codes(df, book)


def test_flatten_and_back(spark):
    df = spark.createDataFrame(list(enumerate(vectors(20, 24))), "id long, arr array<double>")
    for c, h, w in ((2, 3, 4), (1, 4, 6), (24, 1, 1)):
        back = quantize.unflatten_spatial(quantize.flatten_spatial(df, "id", "arr", c, h, w), "id", c, h, w)
        assert sorted(back.collect()) == sorted(df.collect())


def test_codebook_losses_never_rise(spark):
    df = spark.createDataFrame(list(enumerate(vectors(400, 4))), "id long, vec array<double>").cache()
    start = quantize.init_codebook(spark, 8, 4, seed=2)
    assert all(abs(x) <= 1 / 8 for r in start.collect() for x in r.vec)
    assert sorted(start.collect()) == sorted(quantize.init_codebook(spark, 8, 4, seed=2).collect())
    book, losses = quantize.fit_codebook(df, start, 6)
    assert all(a >= b - 1e-12 for a, b in zip(losses, losses[1:], strict=False)) and losses[-1] < losses[0]
    assert quantize.code_usage(quantize.assign_codes(df, book), 8).agg(F.sum("uses")).first()[0] == 400
    _, slow = quantize.fit_codebook(df, start, 4, "gradient", 20.0)
    assert slow[-1] < slow[0]


def test_layers(spark):
    df = spark.createDataFrame([(1, [1.0, -2.0]), (2, None), (3, [0.0, 0.0])], "id long, x array<double>")
    layers = [(np.array([[1.0, 0.0], [0.0, 1.0]]), np.array([0.0, 1.0]), "relu"), (np.array([[2.0, 1.0]]), np.array([-1.0]), "sigmoid")]
    got = {r.id: r.out for r in scoring.score_dense(df, layers, "x", "out").collect()}
    assert got[1] == pytest.approx([1 / (1 + np.exp(-1.0))]) and got[2] is None and got[3] == pytest.approx([0.5])
    empty = scoring.score_dense(df.where("id = 2"), layers, "x", "out").collect()
    assert empty[0].out is None


def test_labels_are_held_in_range(spark):
    df = spark.createDataFrame([(-4,), (3,), (99,), (None,)], "label long")
    assert [r.label for r in scoring.sane_labels(df, "label", 10).collect()] == [0, 3, 9, None]


def test_batch_qa(spark):
    df = spark.createDataFrame([(0, [1, 2], 3), (0, [], 4), (0, None, 3), (0, [5, 6], 1), (1, [1], 0), (1, [1, 2], 0)], "b int, f array<int>, label int")
    got = {r.b: r for r in scoring.batch_qa(df, "b", "f", "label").collect()}
    assert (got[0].good, got[0].empty, got[0].same_size, got[0].labels) == (2, 2, True, [1, 3, 4])
    assert not got[1].same_size


def test_coins_and_crops(spark):
    assert spark.range(4000).where(coin(0.25, 1, F.col("id"))).count() == pytest.approx(1000, abs=120)
    assert spark.range(10).where(coin(1.0, 1, F.col("id"))).count() == 10
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vectors(40, 2 * 5 * 6))] + [(99, None)], "id long, a array<double>")
    small = augment.random_crop_pad(df, "id", "a", 2, 5, 6, 4, 2, seed=1)
    big = augment.random_crop_pad(df, "id", "a", 2, 5, 6, 4, 2, seed=1, big=True)
    assert sorted(small.collect(), key=repr) == sorted(big.collect(), key=repr)
    twice = df.select("id", augment.hflip(augment.hflip(F.col("a"), 2, 5, 6), 2, 5, 6).alias("a"))
    assert sorted(twice.collect(), key=repr) == sorted(df.collect(), key=repr)


def test_noise_does_not_depend_on_partitions(spark):
    noise = augment.noise_table(spark, 2500, 3, seed=4)
    rows = sorted(noise.collect())
    assert [r.id for r in rows] == list(range(2500))
    assert rows == sorted(augment.noise_table(spark, 2500, 3, seed=4).repartition(3).collect())
    flat = np.array([r.noise for r in rows])
    assert abs(flat.mean()) < 0.05 and abs(flat.std() - 1) < 0.05


def test_weights_of_zero(spark):
    df = spark.createDataFrame([(1, 1, 1.0, 0), (1, 2, 3.0, 2), (2, 1, 5.0, 0)], "run long, step long, v double, n long")
    got = {(r.run, r.step): r.run_avg for r in runs.running_average(df, ["run"], ["step"], "v", "n").collect()}
    assert got == {(1, 1): None, (1, 2): 3.0, (2, 1): None}
    assert {r.run: r["mean"] for r in runs.weighted_epoch_means(df, ["run"], "v", "n").collect()} == {1: 3.0, 2: None}


def test_best_so_far_and_trials(spark):
    df = spark.createDataFrame([(1, e, v) for e, v in enumerate([0.0, 2.0, 2.0, 1.0, 5.0])], "run long, epoch long, acc double")
    got = [(r.is_best, r.best) for r in runs.best_so_far(df, ["run"], ["epoch"], "acc").orderBy("epoch").collect()]
    assert got == [(False, 0.0), (True, 2.0), (False, 2.0), (False, 2.0), (True, 5.0)]
    grid = runs.hyperparameter_grid(spark, a=[1, 2], b=["x", "y", "z"])
    assert [(r.a, r.b) for r in grid.orderBy("trial_id").collect()] == [(1, "x"), (1, "y"), (1, "z"), (2, "x"), (2, "y"), (2, "z")]
    scored = grid.withColumn("loss", F.when(F.col("b") == "y", 1.0).when(F.col("b") == "x", 2.0))
    assert runs.best_trial(scored, "trial_id", "loss", ["a", "b"]).first().asDict() == {"trial_id": 1, "loss": 1.0, "a": 1, "b": "y"}
    with pytest.raises(ValueError):
        runs.trial_loss(df, "run", "epoch", "acc", "other")


def test_empty_sides(spark):
    df = spark.createDataFrame([(0.5, True)], "p double, real boolean")
    row = metrics.real_fake_scores(df, F.col("p"), F.col("real")).first()
    assert row.real_score == 0.5 and row.fake_score is None and row.distance is None


@pytest.mark.parametrize("keys", [["run"], ["run", "epoch"]])
def test_split_runs_equal_plain_windows(spark, keys):
    rng = random.Random(3)
    rows = [(rng.choice([0, 0, 0, 1, None]), i % 2, None if i % 50 == 0 else i * i, i, rng.choice([None, -1.0, float(rng.randrange(100))]), rng.randrange(3)) for i in range(600)]
    df = spark.createDataFrame(rows, "run int, epoch int, ts long, id int, loss double, n int")
    for job in (lambda m: runs.running_average(df, keys, ["ts", "id"], "loss", "n", m), lambda m: runs.running_accuracy(df, keys, ["ts", "id"], "n", "id", m), lambda m: runs.best_so_far(df, keys, ["ts", "id"], "loss", m)):
        assert sorted(map(repr, job(20).collect())) == sorted(map(repr, job(10_000).collect()))
    assert "_range" in runs.best_so_far(df, keys, ["ts", "id"], "loss", 20)._jdf.queryExecution().toString()
    assert runs.running_average(df.limit(0), keys, ["ts"], "loss", "n", 0).collect() == []


def test_ranges_of_an_order(spark):
    values = [None, 10**15, *range(5000)]
    df = spark.createDataFrame([(v, ) for v in values], "v long")
    found = df.withColumn("b", split.range_bucket(df, F.col("v"), 16)).orderBy(F.col("v").asc_nulls_first()).collect()
    buckets = [r.b for r in found]
    assert buckets == sorted(buckets) and buckets[0] == -1
    assert max(buckets.count(b) for b in set(buckets)) < 700
    times = spark.sql("SELECT timestamp_ntz'2024-01-01 10:00:00' AS a, timestamp'2024-01-01 10:00:00' AS b, date'2024-01-01' AS c, 'x' AS d")
    assert [split.order_number(times, c) is None for c in "abcd"] == [False, False, False, True]
    assert times.select(split.order_number(times, "a") - split.order_number(times, "b") / 1_000_000).first()[0] == 0


@pytest.mark.parametrize("keys", [["run"], []])
def test_long_runs_equal_plain_windows(spark, keys):
    rng = random.Random(5)
    rows = [(rng.choice([0, 0, 0, 1, None]), i, rng.choice([0, 1, 2, 5])) for i in sorted(rng.sample(range(100_000), 700))] + [(2, 5, 1)]
    df = spark.createDataFrame(rows, "run int, us long, n int").select("run", F.timestamp_micros(F.col("us") * 10_000).alias("ts"), "n", F.lit("x").alias("_range"), F.lit("y").alias("_n"), F.lit("z").alias("_halo"))
    jobs = (
        lambda d, m: runs.step_times(d, keys, "ts", run_rows=m),
        lambda d, m: runs.throughput_sma(d, keys, "ts", "n", 5, run_rows=m),
        lambda d, m: runs.throughput_sma(d, keys, "ts", None, 40, run_rows=m),
        lambda d, m: runs.progress_eta(d, keys, "ts", 50, 5, run_rows=m),
    )
    for job in jobs:
        cut = job(df, 16)
        assert "_range_0" in cut._jdf.queryExecution().toString()
        plain = {repr(r[:6]): r for r in job(df, 10_000).collect()}
        assert len(plain) == len(rows) == cut.count()
        for r in cut.collect():
            assert r[:6] == plain[repr(r[:6])][:6] and r[6:] == pytest.approx(plain[repr(r[:6])][6:], abs=1e-9)
        assert job(df.limit(0), 0).collect() == []
    windows = [x for x in runs.step_times(df, ["run"], "ts", run_rows=16)._jdf.queryExecution().executedPlan().toString().splitlines() if "Window [lag" in x]
    assert windows and all("_range_0" in x for x in windows)  # no window by run alone


def test_runs_in_the_order_of_a_text(spark):
    df = spark.createDataFrame([(1, f"epoch_{i:05d}", float(i % 37), 1) for i in range(900)] + [(1, None, 2.0, 1)], "run int, name string, loss double, n int")
    got = runs.running_average(df, ["run"], ["name"], "loss", "n", 30)
    assert "_range" in got._jdf.queryExecution().toString()
    want = runs.running_average(df, ["run"], ["name"], "loss", "n", 10_000)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_names_of_one_beginning_spread(spark):
    names = [f"class_of_things_{i:05d}" for i in range(2000)]
    df = spark.createDataFrame([(n,) for n in reversed(names)] + [(None,), (names[3],)], "name string")
    bucket = split.order_bucket(df, ["name"], 20, 2002)
    counts = [r["count"] for r in df.groupBy(bucket.alias("b")).count().collect()]
    assert len(counts) > 12 and max(counts) < 400
    got = split.index_classes(df, "name", bucket_names=100).collect()
    assert {r.name: r.label for r in got} == {None: None, **{n: i for i, n in enumerate(names)}} and len(got) == 2002


def test_columns_of_any_name_stay(spark):
    helpers = ["_bucket", "_n", "_b", "_rn", "_ahead", "_all", "_h", "_place", "_SIZE", "_range", "_previous", "_right", "_seen", "_name", "_k0", "_r"]
    df = spark.createDataFrame([(i, f"c{i % 3}", *[str(i)] * len(helpers)) for i in range(60)], ", ".join(["id long", "c string", *[f"{h} string" for h in helpers]]))
    jobs = [
        split.batch_rows(df, "id", 7), split.batch_rows(df, "id", 7, shuffle=False), split.stratified_split(df, "c", "id"), split.stratified_split(df, "c", "id", order="index"), split.index_classes(df, "c"),
        *[job for m in (5, 1000) for job in (runs.best_so_far(df, ["c"], ["id"], "id", m), runs.running_accuracy(df, ["c"], ["id"], "id", "id", m), runs.running_average(df, ["c"], ["id"], "id", "id", m))],
    ]
    for job in jobs:
        assert set(df.columns) <= set(job.columns) and job.count() == 60
        assert all(r[h] == str(r.id) for r in job.collect() for h in helpers)


def test_long_videos(spark):
    lengths = {1: 900, 2: 3, 3: 1, 4: 41}
    rows = [(v, 7 * i + 1, f"{v}:{i}") for v, n in lengths.items() for i in range(n)]
    df = spark.createDataFrame([*rows, (None, 5, "no video"), (4, None, "no index")], "video_id long, frame_idx int, payload string").repartition(5)
    for job in (lambda m: frames.middle_frame(df, video_rows=m), lambda m: frames.resample_frames(df, 8, video_rows=m), lambda m: frames.resample_frames(df, 1, video_rows=m)):
        assert sorted(map(repr, job(40).collect())) == sorted(map(repr, job(10_000).collect()))
    got = frames.middle_frame(df, video_rows=40)
    assert {r.video_id: r.payload for r in got.collect()} == {v: f"{v}:{n // 2}" for v, n in lengths.items()}
    windows = [x for x in got._jdf.queryExecution().executedPlan().toString().splitlines() if "Window [row_number" in x]
    assert windows and all("range#" in x for x in windows)
    assert frames.resample_frames(df.limit(0), 4, video_rows=0).count() == 0


def clustered(n, centres, d, seed, spread=0.05):
    rng = np.random.default_rng(seed)
    at = np.random.default_rng(99).normal(size=(centres, d))
    return at[rng.integers(0, centres, n)] + spread * rng.normal(size=(n, d))


@pytest.mark.parametrize("book, rows", [(clustered(4000, 60, 16, 1), clustered(3000, 60, 16, 2)), (np.random.default_rng(3).normal(size=(700, 8)), np.random.default_rng(4).normal(size=(900, 8)))])
def test_groups_of_codes_lose_nothing(book, rows):
    book[5::50] = book[7]  # ties
    cells = quantize.Cells(np.arange(len(book)) * 3, book)
    code, distance = np.full(len(rows), quantize.NO_CODE), np.full(len(rows), np.inf)
    cells.improve(rows, code, distance)
    exact = ((rows[:, None, :] - book[None, :, :]) ** 2).sum(axis=2)
    assert (code == exact.argmin(axis=1) * 3).all() and np.allclose(distance, exact.min(axis=1), atol=1e-12)
    assert cells.compared < len(rows) * len(book) // (8 if len(book) == 4000 else 1)


def test_a_vector_meets_few_slices_of_a_large_codebook(spark, monkeypatch):
    book, rows = clustered(2000, 40, 8, 5), clustered(1500, 40, 8, 6)
    codes = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(book)], "code long, vec array<double>")
    monkeypatch.setattr(quantize, "CODEBOOK_BYTES", 300 * 8 * 8)
    slices = list(quantize._slices(codes))
    assert len(slices) == 8 and sorted(c for s in slices[1:] for c in s.codes) == list(range(2000))
    code, distance = np.full(len(rows), quantize.NO_CODE), np.full(len(rows), np.inf)
    for s in slices:
        s.improve(rows, code, distance)
    assert sum(s.compared for s in slices) < len(rows) * len(book) / 5
    got = quantize.assign_codes(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rows)], "id long, vec array<double>"), codes)
    exact = ((rows[:, None, :] - book[None, :, :]) ** 2).sum(axis=2).argmin(axis=1)
    assert {r.id: r.code for r in got.collect()} == dict(enumerate(exact)) and (code == exact).all()


def test_vectors_without_a_code(spark):
    inf = float("inf")
    df = spark.createDataFrame([(1, None), (2, [1.0, None]), (3, [1.0]), (4, [float("nan"), 1.0]), (5, [inf, 0.0]), (6, []), (7, [1.0, 1.0])], "id long, vec array<double>").coalesce(1)
    book = spark.createDataFrame([(0, None), (1, [9.0, 9.0]), (2, [1.0, 2.0]), (3, [1.0, float("nan")]), (None, [1.0, 1.0])], "code long, vec array<double>")
    got = {r.id: (r.code, r.distance) for r in quantize.assign_codes(df, book).collect()}
    assert got == {**{i: (None, None) for i in range(1, 7)}, 7: (2, 1.0)}
    assert [r.code for r in quantize.assign_codes(df, book.limit(0)).collect()] == [None] * 7
    assert quantize.assign_codes(df.limit(0), book).count() == 0
    moved, losses = quantize.fit_codebook(df, book, 1)
    assert {r.code: r.vec for r in moved.collect()} == {1: [9.0, 9.0], 2: [1.0, 1.0]} and losses == [0.5]
    with pytest.raises(ValueError):
        quantize.fit_codebook(df, book.limit(0), 1)


@pytest.mark.parametrize("mode, rate", [("mean", 1.0), ("gradient", 20.0)])
def test_a_codebook_beyond_the_bound_is_fitted_alike(spark, monkeypatch, mode, rate):
    df = spark.createDataFrame(list(enumerate(clustered(300, 12, 4, 7).tolist())), "id long, vec array<double>").repartition(3)
    start = spark.createDataFrame([(i, v) for i, v in enumerate(clustered(30, 12, 4, 8).tolist())], "code long, vec array<double>")
    book, losses = quantize.fit_codebook(df, start, 2, mode, rate)
    monkeypatch.setattr(quantize, "CODEBOOK_BYTES", 12 * 4 * 8)
    monkeypatch.setattr(quantize, "ROWS_AT_ONCE", 32)
    small, again = quantize.fit_codebook(df, start, 2, mode, rate)
    want = {r.code: r.vec for r in book.collect()}
    assert {r.code: pytest.approx(r.vec, abs=1e-9) for r in small.collect()} == want and again == pytest.approx(losses)
