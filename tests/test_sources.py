import random
import struct

import pytest
from pyspark.sql import functions as F

from tests.oracle import assert_same
from trainkit.operators import runs
from trainkit.plans import frame_queries, registry
from trainkit.sources import containers, files, logs

FRAME = files.JPEG_START + b"x" * 200


def container(header, *frames, tail=b""):
    return b"\0" * header + b"".join(struct.pack("<I", len(f)) + f for f in frames) + tail


def test_containers():
    second = FRAME + b"2"
    assert files.frames_in(container(1024, FRAME, second), 10) == [FRAME, second]
    assert files.frames_in(container(2048, FRAME), 10) == [FRAME]
    assert files.frames_in(container(4096, FRAME, FRAME, FRAME), 2) == [FRAME, FRAME]
    assert files.frames_in(container(1024, FRAME, tail=struct.pack("<I", 5000) + b"cut"), 10) == [FRAME]
    assert files.frames_in(container(1024, b"n" * 300), 10) == []
    assert files.frames_in(bytes(range(256)) * 40, 10) == []
    assert files.frames_in(b"", 10) == files.frames_in(None, 10) == []


def test_catalogue_and_extraction(spark, tmp_path):
    for name, n in (("run", 2), ("jump", 1), ("swim", 0)):
        (tmp_path / name).mkdir()
        (tmp_path / name / "notes.txt").write_text("no video")
        for i in range(n):
            (tmp_path / name / f"v{i}.seq").write_bytes(container(1024, *[FRAME + bytes([k]) for k in range(3 + i)]))
    got = sorted((r.class_name, r.label, r.size > 0) for r in files.catalog_labeled_files(spark, str(tmp_path)).collect())
    assert got == [("jump", 0, True), ("run", 1, True), ("run", 1, True)]
    frames = files.extract_frames(files.read_files(spark, str(tmp_path)), max_frames=3, repartition=2)
    assert frames.count() == 9 and frames.where("frame_idx = 2").count() == 3


def catalogued(spark, folder, rows):
    spark.createDataFrame(rows, "doc_id long, source string").repartition(4).write.parquet(str(folder / "documents.parquet"))
    assert_same(registry.QUERIES["catalog_labeled_files"](spark, str(folder)), registry.ORACLES["catalog_labeled_files"].replace("FROM documents", f"FROM '{folder}/documents.parquet/*.parquet'"), str(folder / "none"))


def test_many_files_of_one_class_are_written_by_many_tasks_and_catalogued_by_few(spark, tmp_path, monkeypatch):
    write, keep, tasks, splits = files.write_files, files.written, [], []

    def writing(df, folder):
        tasks.extend(r[1] for r in df.groupBy(F.spark_partition_id()).count().collect())
        return write(df, folder)

    def keeping(df):
        splits.append(df.rdd.getNumPartitions())
        return keep(df)

    monkeypatch.setattr(files, "write_files", writing)
    monkeypatch.setattr(files, "written", keeping)
    monkeypatch.setattr(frame_queries, "TASK_FILES", 20)
    catalogued(spark, tmp_path, [(i, "all" if i % 10 else f"s{i % 3}") for i in range(8_000)])
    assert sum(tasks) == 402 and len(tasks) >= 15 and max(tasks) <= 60
    assert splits == [1]  # 402 files, which Spark deals out to a dozen tasks and more for every pass


def test_folders_of_odd_class_names(spark, tmp_path):
    odd = ["", " ", "a b", "x/y", "x:y", "50%", "%2F", "..", ".dot", "_hidden", "a*b?[c]{d}", "q=r#s+t", "back\\slash", "tab\there", "linia-линия", "A", "a", None]
    rows = [(i, odd[i % len(odd)]) for i in range(1_000)] + [(7, "a b"), (7, "a b"), (None, "a b"), (-5, "A")]
    catalogued(spark, tmp_path, rows)


@pytest.mark.parametrize("rows", [[], [(1, None)]])
def test_no_class_at_all(spark, tmp_path, rows):
    catalogued(spark, tmp_path, rows)


def test_run_logs(spark, tmp_path):
    rows = [(e, 0.1 / e, 1.0 / e, 2.0 / e, 10.0 * e, 9.0 * e) for e in range(1, 13)]
    df = spark.createDataFrame(rows, "epoch int, lr double, train_loss double, valid_loss double, train_acc double, valid_acc double")
    logs.write_run_log(df.repartition(4), str(tmp_path / "log"))
    back = logs.read_run_log(spark, str(tmp_path / "log"))
    assert [tuple(r) for r in back.orderBy("epoch").collect()] == [tuple(round(x, 6) for x in r) for r in rows]
    text = next((tmp_path / "log").glob("*.txt")).read_text().splitlines()
    assert text[0] == "Learning Rate\tTrain Loss\tValid Loss\tTrain Acc.\tValid Acc.\t" and text[1] == "0.100000\t1.000000\t2.000000\t10.000000\t9.000000\t"
    assert runs.best_epoch(back.withColumn("run", back.epoch * 0), ["run"], "valid_acc", "epoch").first().best_epoch == 12
    series = {r.series for r in runs.union_runs({"a": back, "b": back}, "epoch", ["train_loss", "valid_acc"]).collect()}
    assert series == {"a(train_loss)", "a(valid_acc)", "b(train_loss)", "b(valid_acc)"}


def test_predictions_and_codes(spark, tmp_path):
    df = spark.createDataFrame([(1, 0, 0, 3, 2, "0.500"), (2, 0, 0, 3, 3, "0.900")], "epoch int, batch_idx long, image_idx int, true_label int, predicted_label int, prediction_confidence string")
    logs.write_predictions(df, str(tmp_path / "p"))
    assert sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "p")).select(*df.columns).collect()) == sorted(map(tuple, df.collect()))
    codes = spark.createDataFrame([(1, 1, 7), (1, 0, 5), (2, 0, 9)], "id long, pos int, code long")
    logs.write_codes(codes, str(tmp_path / "c"))
    assert {r.id: r.codes for r in spark.read.parquet(str(tmp_path / "c")).collect()} == {1: [5, 7], 2: [9]}


def test_records_need_their_columns(spark, tmp_path):
    spark.createDataFrame([(1, [1.0])], "id long, pixels array<float>").write.parquet(str(tmp_path / "r"))
    assert files.read_labeled_records(spark, str(tmp_path / "r"), "id long, pixels array<double>").dtypes == [("id", "bigint"), ("pixels", "array<double>")]
    with pytest.raises(ValueError, match="label"):
        files.read_labeled_records(spark, str(tmp_path / "r"), "id long, label int")


def test_a_shipped_log(spark, tmp_path):
    """Golden values: twelve epochs of a published run, best validation accuracy 70.303907 in epoch 9; written again, the text is the same."""
    from trainkit.operators import runs
    from trainkit.sources import logs

    # The published log.
    lines = """Learning Rate\tTrain Loss\tValid Loss\tTrain Acc.\tValid Acc.\t
0.099992\t0.835822\t3.932447\t73.137891\t66.020260\t
0.099963\t0.177213\t3.895773\t94.382915\t62.344428\t
0.099912\t0.091963\t4.084818\t97.169741\t66.512301\t
0.099839\t0.072317\t5.286743\t97.654721\t66.280753\t
0.099744\t0.031684\t4.454279\t99.051754\t64.862518\t
0.099627\t0.022482\t4.167373\t99.413680\t68.422576\t
0.099489\t0.029616\t4.223375\t99.160332\t66.512301\t
0.099328\t0.013717\t4.626376\t99.645313\t68.480463\t
0.099146\t0.031548\t4.319625\t99.044516\t70.303907\t
0.098942\t0.019903\t4.185198\t99.522258\t68.075253\t
0.098717\t0.035757\t3.713681\t98.899746\t69.725036\t
0.098471\t0.018301\t3.809025\t99.507781\t68.625181\t
"""
    (tmp_path / "log.txt").write_text(lines)
    log = logs.read_run_log(spark, str(tmp_path / "log.txt"))
    assert log.count() == 12
    best = runs.best_epoch(log.selectExpr("0 AS run", "epoch", "valid_acc"), ["run"], "valid_acc", "epoch").first()
    assert (best.best, best.best_epoch) == (70.303907, 9)
    logs.write_run_log(log, str(tmp_path / "again"))
    assert "".join(f.read_text() for f in sorted((tmp_path / "again").glob("part-*"))) == lines


def containers_on_disk(folder):
    rng = random.Random(8)
    frames = [files.JPEG_START + rng.randbytes(rng.randrange(98, 60_000)) for _ in range(400)]
    (folder / "a b").mkdir()
    blobs = {
        "a b/long.seq": container(1024, *frames, tail=struct.pack("<I", 5000) + b"cut"),
        "mixed.seq": container(1024, frames[0], b"no jpeg" * 30, frames[1]) + b"\0" * 8 + container(0, frames[2]),
        "second.seq": container(2048, FRAME, FRAME), "third.seq": container(4096, FRAME), "noise.seq": rng.randbytes(9000), "empty.seq": b"",
    }
    for name, blob in blobs.items():
        (folder / name).write_bytes(blob)
    return blobs


@pytest.mark.parametrize("most", [None, 3])
def test_large_containers_give_the_same_frames(spark, tmp_path, most):
    blobs = containers_on_disk(tmp_path)
    got = containers.extract_large_frames(spark, str(tmp_path), max_frames=most, split_bytes=1 << 20)
    found = {}
    for r in got.collect():
        found.setdefault(r.path.rpartition("/")[2], {})[r.frame_idx] = bytes(r.frame)
    want = {name.rpartition("/")[2]: files.frames_in(blob, most or 10**6) for name, blob in blobs.items()}
    assert {k: [v[i] for i in range(len(v))] for k, v in found.items()} == {k: v for k, v in want.items() if v}


def test_one_large_container_is_read_by_many_tasks_in_small_batches(spark, tmp_path, monkeypatch):
    frame = files.JPEG_START + bytes(99_998)
    with (tmp_path / "big.seq").open("wb") as out:
        out.write(bytes(1024))
        for _ in range(1200):  # 120 MB
            out.write(struct.pack("<I", len(frame)) + frame)
    got = containers.extract_large_frames(spark, str(tmp_path), split_bytes=4 << 20)
    tasks = got.withColumn("task", F.spark_partition_id()).groupBy("task").agg(F.count("*").alias("n"), F.sum(F.octet_length("frame")).alias("bytes")).collect()
    assert sum(t.n for t in tasks) == 1200 and len(tasks) >= 12 and max(t.bytes for t in tasks) < 40 << 20
    assert "content" not in got._jdf.queryExecution().executedPlan().toString()

    class Counting:
        def __init__(self, file):
            self.file, self.read_bytes = file, 0

        def seek(self, at):
            self.file.seek(at)

        def read(self, n):
            self.read_bytes += n
            return self.file.read(n)

    with (tmp_path / "big.seq").open("rb") as file:
        counting = Counting(file)
        places = list(containers.frame_places(counting, (tmp_path / "big.seq").stat().st_size, None))
        assert len(places) == 1200 and counting.read_bytes < 10_000  # the index reads lengths only
    monkeypatch.setattr(containers, "BATCH_BYTES", 1 << 20)
    rows = [(i, at, n) for i, (at, n) in enumerate(places[:100])]
    batches = list(containers.read_ranges(iter([containers._indexed(str(tmp_path / "big.seq"), rows)])))
    assert sum(b.num_rows for b in batches) == 100 and max(b.nbytes for b in batches) < 3 << 20
