"""Queries of the frame operators: conversations as videos, turns as frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trainkit.operators import frames as V
from trainkit.operators.split import buckets_for, numbered, order_bucket
from trainkit.plans.base import FRAMES, draw_sql, frames, new_folder, query, table
from trainkit.sources import containers, files

K = 4
FILE_IDS = 20  # document ids in a file of the catalogue
TASK_FILES = 250  # such files that a task writes, about
FOLDER = "source="  # begins the name of a class folder, so that none is hidden; the source follows, url-encoded


def _plain(df: DataFrame) -> DataFrame:
    return df.select("video_id", F.col("frame_idx").cast("long").alias("frame_idx"), "payload")


OUT = "video_id, CAST(frame_idx AS BIGINT) AS frame_idx, payload"


@query(f"WITH {FRAMES} SELECT {OUT} FROM frames QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY frame_idx) <= {K}")
def head_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain(V.head_frames(frames(spark, sf_dir), K))


@query(f"WITH {FRAMES} SELECT {OUT} FROM frames QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY frame_idx) - 1 = count(*) OVER (PARTITION BY video_id) // 2")
def middle_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain(V.middle_frame(frames(spark, sf_dir)))


@query(f"WITH {FRAMES} SELECT {OUT} FROM frames QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY {draw_sql('11', 'video_id', 'frame_idx')}, frame_idx) = 1")
def random_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain(V.random_frame(frames(spark, sf_dir), seed=11))


@query(
    f"""WITH {FRAMES}, p AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY frame_idx) - 1 AS place, count(*) OVER (PARTITION BY video_id) AS n FROM frames),
slots AS (SELECT DISTINCT video_id, n, slot FROM p, (SELECT unnest(range(0, {K})) AS slot)),
plan AS (SELECT video_id, slot, CASE WHEN n <= {K} THEN slot % n WHEN slot = {K - 1} THEN n - 1 ELSE CAST(floor(slot * ((n - 1) / {K - 1}.0)) AS BIGINT) END AS place FROM slots)
SELECT p.video_id, CAST(slot AS BIGINT) AS slot, CAST(frame_idx AS BIGINT) AS frame_idx, payload FROM plan JOIN p USING (video_id, place)"""
)
def resample_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = V.resample_frames(frames(spark, sf_dir), K)
    return out.select("video_id", F.col("slot").cast("long").alias("slot"), F.col("frame_idx").cast("long").alias("frame_idx"), "payload")


@query(f"WITH {FRAMES}, videos AS (SELECT DISTINCT conv_id AS video_id, conv_id % 16 AS label FROM conversations) SELECT {OUT}, label FROM frames JOIN videos USING (video_id)")
def label_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = frames(spark, sf_dir)
    videos = rows.select("video_id").distinct().withColumn("label", F.col("video_id") % 16)
    return V.label_frames(rows, videos).select("video_id", F.col("frame_idx").cast("long").alias("frame_idx"), "payload", "label")


@query("SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def drop_empty_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.drop_empty_samples(table(spark, sf_dir, "documents").select("doc_id", "source"), table(spark, sf_dir, "labels"), "doc_id")


@query(f"WITH {FRAMES} SELECT video_id, count(*) AS n_frames FROM frames WHERE frame_idx > 4 GROUP BY video_id")
def drop_empty_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    late = F.collect_list(F.when(F.col("frame_idx") > 4, F.col("frame_idx")))
    grouped = frames(spark, sf_dir).groupBy("video_id").agg(late.alias("frames"))
    return V.drop_empty_arrays(grouped, "frames").select("video_id", F.size("frames").cast("long").alias("n_frames"))


@query(
    f"""WITH {FRAMES}, n AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY frame_idx) AS place FROM frames WHERE octet_length(encode(payload)) >= 100)
SELECT CAST(video_id AS VARCHAR) AS path, CAST(place - 1 AS BIGINT) AS frame_idx, CAST(octet_length(encode(payload)) + 2 AS BIGINT) AS size FROM n WHERE place <= 3"""
)
def extract_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations packed into containers (a header, then length-prefixed frames), and unpacked again."""
    out = files.extract_frames(_containers(spark, sf_dir).withColumn("path", F.col("video_id").cast("string")), max_frames=3)
    return out.select("path", F.col("frame_idx").cast("long").alias("frame_idx"), F.octet_length("frame").cast("long").alias("size"))


def _containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(video_id, content): the frames of at least 100 bytes behind a header of zeros."""
    body = F.concat(F.unhex(F.lit("FFD8")), F.col("payload").cast("binary"))
    size = F.lpad(F.hex(F.octet_length(body)), 8, "0")
    little = F.unhex(F.concat(*[F.substring(size, k, 2) for k in (7, 5, 3, 1)]))
    framed = frames(spark, sf_dir).where(F.octet_length("payload") >= 100).select("video_id", "frame_idx", F.concat(little, body).alias("blob"))
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("frame_idx", "blob"))), lambda s: s["blob"])
    return framed.groupBy("video_id").agg(F.concat(F.unhex(F.lit("00" * 1024)), F.unhex(F.array_join(F.transform(ordered, F.hex), ""))).alias("content"))


@query(
    f"""WITH {FRAMES}, n AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY frame_idx) AS place FROM frames WHERE octet_length(encode(payload)) >= 100)
SELECT 'c' || video_id || '.seq' AS name, CAST(place - 1 AS BIGINT) AS frame_idx, md5(payload) AS payload_md5 FROM n"""
)
def extract_large_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same containers as files, read by byte ranges, all frames."""
    folder = new_folder(spark)
    files.write_files(_containers(spark, sf_dir).withColumn("name", F.concat(F.lit("c"), "video_id", F.lit(".seq"))), folder)
    out = containers.extract_large_frames(spark, folder, split_bytes=1 << 20)
    payload = F.md5(F.expr("substring(frame, 3)"))
    return out.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("frame_idx").cast("long").alias("frame_idx"), payload.alias("payload_md5"))


@query(
    """SELECT source AS class_name, CAST(row_number() OVER (ORDER BY source) - 1 AS BIGINT) AS label, CAST(ceil(count(*) / 20.0) AS BIGINT) AS n_files, CAST(sum(length(CAST(doc_id AS VARCHAR)) + 1) AS BIGINT) AS size
FROM documents WHERE source IS NOT NULL GROUP BY source"""
)
def catalog_labeled_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of 20 document ids in a folder per source, catalogued without reading them."""
    folder = new_folder(spark)
    files.write_files(_id_files(table(spark, sf_dir, "documents").where("source IS NOT NULL")), folder)
    found = files.catalog_labeled_files(spark, folder, "*.txt", lambda name: F.url_decode(F.substr(name, F.lit(len(FOLDER) + 1))))
    return found.groupBy("class_name", F.col("label").cast("long").alias("label")).agg(F.count("*").alias("n_files"), F.sum("size").alias("size"))


def _id_files(docs: DataFrame) -> DataFrame:
    """(name, content): the ids of a source in their order, FILE_IDS to a file, a line each; null ids have a place but no line."""
    n, task_ids = docs.count(), FILE_IDS * TASK_FILES
    rows = docs.select("source", "doc_id")
    placed = numbered(rows, ["source"], [F.col("doc_id")], order_bucket(rows, ["doc_id"], buckets_for(n, task_ids), n), "place")
    filed = placed.select("source", F.floor((F.col("place") - 1) / FILE_IDS).alias("file"), F.concat(F.col("doc_id").cast("string"), F.lit("\n")).alias("line"))
    # The number is given, because by their bytes all files would go to one task.
    dealt = filed.repartition(-(-n // task_ids) or 1, "source", "file")
    lines = dealt.groupBy("source", "file").agg(F.array_join(F.sort_array(F.collect_list("line")), "").alias("content"))
    return lines.select(F.concat(F.lit(FOLDER), F.url_encode("source"), F.lit("/"), "file", F.lit(".txt")).alias("name"), "content")
