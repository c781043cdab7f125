import random
import time

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from tests.conftest import SMALL
from trainkit.operators import runs
from trainkit.plans.base import batch_metrics
from trainkit.streaming import monitors, sinks


def feed(spark, tmp_path):
    rows = batch_metrics(spark, SMALL).select("run", "epoch", "step", "n", "loss")
    rows.repartition(4).write.parquet(str(tmp_path / "feed"))
    return rows, spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "feed"))


def test_epoch_means(spark, tmp_path):
    rows, stream = feed(spark, tmp_path)
    query = (
        monitors.stream_epoch_means(stream, ["run", "epoch"], "loss", "n").writeStream.outputMode("complete").format("memory").queryName("means")
        .option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    )
    query.awaitTermination(120)
    got = {(r.run, r.epoch): r["mean"] for r in spark.table("means").select("run", "epoch", F.round("mean", 6).alias("mean")).collect()}
    want = runs.weighted_epoch_means(rows, ["run", "epoch"], "loss", "n").select("run", "epoch", F.round("mean", 6).alias("mean"))
    assert got == {(r.run, r.epoch): r["mean"] for r in want.collect()}


def test_best_so_far(spark, tmp_path):
    rows, stream = feed(spark, tmp_path)
    query = (
        monitors.stream_best_so_far(stream, "run", "loss").writeStream.outputMode("update").format("memory").queryName("best")
        .option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    )
    query.awaitTermination(180)
    got = {r.run: r.best for r in spark.table("best").groupBy("run").agg(F.max("best").alias("best")).collect()}
    assert got == {r.run: r.best for r in rows.groupBy("run").agg(F.max("loss").alias("best")).collect() if r.best > 0}


def test_improvements_equal_the_batch_job(spark, tmp_path):
    """Files fed in order: a row per strict improvement, with an order inside the files and runs over several of them."""
    rng = random.Random(6)
    rows = [(rng.choice([1, 1, 1, 2, None]), i, rng.choice([None, float("nan"), -3.0, *[float(rng.randrange(0, 4 + i // 4)) for _ in range(6)]])) for i in range(900)]
    for k in range(0, 900, 150):
        part = rows[k : k + 150]
        rng.shuffle(part)
        spark.createDataFrame(part, "run long, step long, acc double").coalesce(1).write.mode("append").parquet(str(tmp_path / "feed"))
        time.sleep(0.02)
    stream = spark.readStream.schema("run long, step long, acc double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "feed"))
    improved = monitors.stream_best_so_far(stream, "run", "acc", "step")
    sinks.write_batches(improved, str(tmp_path / "out"), "update").awaitTermination(180)
    got = sinks.read_batches(spark, str(tmp_path / "out"), improved.schema)
    assert got.select("batch").distinct().count() == 6
    sound = spark.createDataFrame([r for r in rows if r[2] is not None and r[2] == r[2]], "run long, step long, acc double")
    want = runs.best_so_far(sound, ["run"], ["step"], "acc").where("is_best")
    assert sorted(((r.run, r["at"], r.best) for r in got.collect()), key=repr) == sorted(((r.run, r.step, r.acc) for r in want.collect()), key=repr)
    by_run = {}
    for r in sorted(got.collect(), key=lambda r: (r.run is None, r.run or 0, r["at"])):
        assert r.previous == by_run.get(r.run, 0.0) < r.best
        by_run[r.run] = r.best


def test_only_candidates_are_shuffled(spark):
    import pyarrow as pa

    n = 5000
    batch = pa.RecordBatch.from_arrays([pa.array([7] * n), pa.array(range(n)), pa.array([float((i * 7919) % 1000) for i in range(n)])], names=["run", "at", "metric"])
    (sent,) = monitors._candidates(iter([batch]))
    assert sent.num_rows < 20 and sent.column("metric")[-1].as_py() == 999.0


def test_each_row_once_after_a_crash(spark, tmp_path, monkeypatch):
    """The query dies when a batch is written and not committed; started again, it repeats the batch under its id."""
    rows, stream = feed(spark, tmp_path)
    folder = str(tmp_path / "out")
    written, mode = [], DataFrameWriter.parquet

    def dies(self, path, *args, **kwargs):
        mode(self, path, *args, **kwargs)
        written.append(path)
        if path.endswith("batch=1") and written.count(path) == 1:
            raise RuntimeError("killed before the commit")

    monkeypatch.setattr(DataFrameWriter, "parquet", dies)
    plain = stream.select("run", "step", "loss")
    with pytest.raises(StreamingQueryException):
        sinks.write_batches(plain, folder, "append").awaitTermination(180)
    assert sinks.finished_batches(spark, folder) == [0, 1]
    sinks.write_batches(plain, folder, "append").awaitTermination(180)
    assert sinks.finished_batches(spark, folder) == [0, 1, 2, 3] and [p.rpartition("=")[2] for p in written] == ["0", "1", "1", "2", "3"]
    got = sinks.read_batches(spark, folder, plain.schema).select("run", "step", "loss")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, rows.select("run", "step", "loss").collect()))


def test_a_half_written_batch_is_not_read(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "rows/batch=0"))
    spark.range(3).write.parquet(str(tmp_path / "rows/batch=1"))
    (tmp_path / "rows/batch=1/_SUCCESS").unlink()
    schema = spark.range(1).schema
    assert sinks.finished_batches(spark, str(tmp_path)) == [0] and sinks.read_batches(spark, str(tmp_path), schema).count() == 3
    assert sinks.read_last_batch(spark, str(tmp_path / "none"), schema).count() == 0


def test_improvements_go_on_after_a_crash(spark, tmp_path, monkeypatch):
    """The state of a repeated batch is that before it: improvements are neither lost nor doubled."""
    rows, stream = feed(spark, tmp_path)
    folder, improved = str(tmp_path / "out"), monitors.stream_best_so_far(stream, "run", "loss")
    mode, died = DataFrameWriter.parquet, []

    def dies(self, path, *args, **kwargs):
        mode(self, path, *args, **kwargs)
        if path.endswith("batch=2") and not died:
            died.append(path)
            raise RuntimeError("killed before the commit")

    monkeypatch.setattr(DataFrameWriter, "parquet", dies)
    with pytest.raises(StreamingQueryException):
        sinks.write_batches(improved, folder, "update").awaitTermination(180)
    sinks.write_batches(improved, folder, "update").awaitTermination(180)
    got = sinks.read_batches(spark, folder, improved.schema).collect()
    assert len({(r.run, r.best) for r in got}) == len(got)
    assert {r.run: max(x.best for x in got if x.run == r.run) for r in got} == {r.run: r.best for r in rows.groupBy("run").agg(F.max("loss").alias("best")).collect() if r.best > 0}
