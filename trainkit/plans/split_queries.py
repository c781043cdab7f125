"""Queries of classes, splits, shuffles and batches: documents as files in class folders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trainkit.functions import schedules
from trainkit.functions.draws import draw
from trainkit.operators import split as S
from trainkit.plans.base import draw_sql, query, table
from trainkit.sources import files


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "source", "lang")


@query("SELECT vec_id, CAST(label AS BIGINT) AS label, CAST(len(embedding) AS BIGINT) AS n FROM embeddings")
def read_labeled_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = files.read_labeled_records(spark, f"{sf_dir}/embeddings.parquet", "vec_id long, embedding array<double>, label long")
    return rows.select("vec_id", "label", F.size("embedding").cast("long").alias("n"))


@query("SELECT doc_id, source, CAST(dense_rank() OVER (ORDER BY source) - 1 AS BIGINT) AS label FROM documents")
def index_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.index_classes(_docs(spark, sf_dir).drop("lang"), "source").withColumn("label", F.col("label").cast("long"))


def _split_sql(order: str) -> str:
    return f"""SELECT doc_id, lang, CASE WHEN row_number() OVER (PARTITION BY lang ORDER BY {order}) <= floor(count(*) OVER (PARTITION BY lang) * CAST(0.8 AS DOUBLE)) THEN 'train' ELSE 'test' END AS split FROM documents"""


@query(_split_sql(f"{draw_sql('42', 'doc_id')}, doc_id"))
def stratified_split_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.stratified_split(_docs(spark, sf_dir).drop("source"), "lang", "doc_id", 0.8, "hash", 42)


@query(_split_sql("doc_id"))
def stratified_split_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.stratified_split(_docs(spark, sf_dir).drop("source"), "lang", "doc_id", 0.8, "index")


@query("SELECT doc_id, lang FROM documents WHERE false")
def split_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.stratified_split(_docs(spark, sf_dir).drop("source"), "lang", "doc_id", 0.8, "hash", 42)
    return S.split_overlap(rows.where("split = 'train'").drop("split"), rows.where("split = 'test'").drop("split"), "doc_id").select("doc_id", "lang")


@query("SELECT n_name, coalesce(n, 0) AS n_files FROM nation LEFT JOIN (SELECT label, count(*) AS n FROM embeddings GROUP BY label) e ON e.label = n_nationkey")
def dataset_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    files_ = table(spark, sf_dir, "embeddings").join(F.broadcast(classes), F.col("label") == F.col("n_nationkey")).select("n_name")  # 25 nations
    return S.dataset_info(files_, classes, "n_name")


@query(f"SELECT event_id, row_number() OVER (ORDER BY {draw_sql('1', '3', 'event_id')}, event_id) AS place FROM events")
def shuffle_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order of the shuffle, as a place per row."""
    shuffled = S.shuffle_rows(table(spark, sf_dir, "events").select("event_id"), "event_id", 1, 3)
    hashed = shuffled.withColumn("_h", draw(1, 3, F.col("event_id")))
    return S.numbered(hashed, [], [F.col("_h"), F.col("event_id")], S.hash_bucket(F.col("_h")), "place").select("event_id", "place")


def _batch_sql(order: str, tail: str = "") -> str:
    return f"""WITH p AS (SELECT event_id, row_number() OVER (ORDER BY {order}) - 1 AS place, count(*) OVER () AS n FROM events)
SELECT event_id, place // 128 AS batch_idx, place % 128 AS image_idx FROM p {tail}"""


def _batched(df: DataFrame) -> DataFrame:
    return df.select("event_id", F.col("batch_idx").cast("long").alias("batch_idx"), F.col("image_idx").cast("long").alias("image_idx"))


@query(_batch_sql(f"{draw_sql('9', '2', 'event_id')}, event_id"))
def batch_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _batched(S.batch_rows(table(spark, sf_dir, "events").select("event_id"), "event_id", 128, seed=9, epoch=2))


@query(_batch_sql("event_id", "WHERE (place // 128 + 1) * 128 <= n"))
def batch_rows_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _batched(S.batch_rows(table(spark, sf_dir, "events").select("event_id"), "event_id", 128, shuffle=False, drop_last=True))


@query("SELECT event_id, event_type FROM events ORDER BY event_id LIMIT 16")
def preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.preview(table(spark, sf_dir, "events").select("event_id", "event_type"), "event_id", 16)


@query("SELECT event_id, value FROM events WHERE event_id % 20 = 0")
def every_nth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.every_nth(table(spark, sf_dir, "events").select("event_id", "value"), "event_id", 20)


@query("SELECT event_id, event_id // 128 AS batch_idx FROM events WHERE event_id // 128 < 4")
def first_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", F.floor(F.col("event_id") / 128).alias("batch_idx"))
    return S.first_batches(rows, 4)


@query("SELECT event_id AS epoch, value FROM events WHERE (event_id + 1) % 50 = 0")
def checkpoint_epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.checkpoint_epochs(table(spark, sf_dir, "events").select(F.col("event_id").alias("epoch"), "value"), 50)


@query(
    """SELECT event_id, round(0.1 * CASE WHEN event_id < 100 THEN event_id / 100.0 ELSE greatest(0.0, (cos(2.0 * 0.5 * pi() * (event_id - 100) / 74900.0) + 1.0) * 0.5) END, 9) + 0.0 AS rate FROM events"""
)
def lr_warmup_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    rate = schedules.lr_warmup_cosine(F.col("event_id"), 100, 75_000, 0.1)
    return table(spark, sf_dir, "events").select("event_id", (F.round(rate, 9) + 0.0).alias("rate"))


@query("SELECT event_id, CASE WHEN event_id % 200 >= 150 THEN 0.001 WHEN event_id % 200 >= 100 THEN 0.01 ELSE 0.1 END + CAST(0 AS DOUBLE) AS rate FROM events")
def lr_step_decay(spark: SparkSession, sf_dir: str) -> DataFrame:
    rate = schedules.lr_step_decay(F.col("event_id") % 200, 0.1)
    return table(spark, sf_dir, "events").select("event_id", (F.round(rate, 9) + 0.0).alias("rate"))


@query("SELECT event_id, user_id * 500 + event_id % 500 AS step FROM events")
def global_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", schedules.global_step(F.col("user_id"), F.col("event_id") % 500, 500).alias("step"))
