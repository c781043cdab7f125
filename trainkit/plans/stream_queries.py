"""Queries of the streaming monitors: the events table as a file stream, run until its files are read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trainkit.plans.base import BATCH_METRICS, batch_metrics_of, new_folder, query, r6, table
from trainkit.streaming import monitors, sinks


def _feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = table(spark, sf_dir, "events").schema
    path = f"{sf_dir}/events.parque[t]"  # a pattern, because a stream takes a plain path for a folder
    return batch_metrics_of(spark.readStream.schema(schema).parquet(path))


@query(f"WITH {BATCH_METRICS} SELECT run, epoch, round(CASE WHEN sum(n) <> 0 THEN sum(loss * n) / sum(n) END, 6) + 0.0 AS mean, CAST(sum(n) AS BIGINT) AS n FROM batch_metrics GROUP BY run, epoch")
def stream_epoch_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    means, folder = monitors.stream_epoch_means(_feed(spark, sf_dir), ["run", "epoch"], "loss", "n"), new_folder(spark)
    sinks.write_batches(means, folder, "complete").awaitTermination()
    out = sinks.read_last_batch(spark, folder, means.schema)
    return out.select("run", "epoch", r6(F.col("mean")).alias("mean"), "n")


def _improvements(spark: SparkSession, sf_dir: str) -> DataFrame:
    improved, folder = monitors.stream_best_so_far(_feed(spark, sf_dir), "run", "loss", "ts"), new_folder(spark)
    sinks.write_batches(improved, folder, "update").awaitTermination()
    return sinks.read_batches(spark, folder, improved.schema)


@query("SELECT user_id AS run, max(value) AS best FROM events GROUP BY user_id HAVING max(value) > 0")
def stream_best_so_far(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The final best of every run."""
    return _improvements(spark, sf_dir).groupBy("run").agg(F.max("best").alias("best"))


@query(
    """WITH p AS (SELECT user_id AS run, ts, value AS best, greatest(0.0, coalesce(max(value) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0)) AS previous FROM events)
SELECT run, ts, best, previous FROM p WHERE best > previous"""
)
def stream_improvements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every strict improvement of every run."""
    return _improvements(spark, sf_dir).select("run", F.col("at").alias("ts"), "best", "previous")
