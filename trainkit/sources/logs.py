"""Run logs as tab-separated text, predictions and codes as Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The log's columns, in order, as they are titled in the file.
LOG_TITLES = {"lr": "Learning Rate", "train_loss": "Train Loss", "valid_loss": "Valid Loss", "train_acc": "Train Acc.", "valid_acc": "Valid Acc."}


def read_run_log(spark: SparkSession, path: str) -> DataFrame:
    """(epoch, lr, train_loss, valid_loss, train_acc, valid_acc); epochs count lines from 1.

    Lines end with a tab, so the last, empty column is dropped.  A log is one small file.
    """
    schema = ", ".join(f"{c} double" for c in LOG_TITLES) + ", _rest string"
    rows = spark.read.csv(path, sep="\t", header=True, schema=schema, enforceSchema=True).drop("_rest")
    numbered = rows.coalesce(1).withColumn("epoch", (F.monotonically_increasing_id() + 1).cast("int"))
    return numbered.select("epoch", *LOG_TITLES)


def write_run_log(df: DataFrame, path: str) -> None:
    """A header line, then one line per epoch with six decimals; every line ends with a tab. One file: a log is small."""
    line = F.concat(*[F.concat(F.format_string("%.6f", F.col(c).cast("double")), F.lit("\t")) for c in LOG_TITLES])
    body = df.select(F.col("epoch").cast("long").alias("_at"), line.alias("value"))
    head = df.sparkSession.createDataFrame([(-(1 << 62), "".join(f"{t}\t" for t in LOG_TITLES.values()))], "_at long, value string")
    head.unionByName(body).coalesce(1).sortWithinPartitions("_at").select("value").write.mode("overwrite").text(path)


def write_predictions(df: DataFrame, path: str) -> None:
    """(batch_idx, image_idx, true_label, predicted_label, prediction_confidence) by epoch."""
    df.select("epoch", "batch_idx", "image_idx", "true_label", "predicted_label", "prediction_confidence").write.mode("overwrite").partitionBy("epoch").parquet(path)


def codes_table(df: DataFrame, id_col: str = "id") -> DataFrame:
    """(id, codes array<int>): the codes of every sample in order of position."""
    ordered = F.sort_array(F.collect_list(F.struct("pos", "code")))
    return df.groupBy(id_col).agg(F.transform(ordered, lambda s: s["code"].cast("int")).alias("codes"))


def write_codes(df: DataFrame, path: str, id_col: str = "id") -> None:
    codes_table(df, id_col).write.mode("overwrite").parquet(path)
