"""Batch scoring with dense layers, predictions, and their evaluation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trainkit.functions.arrays import argmax, max_softmax, rank_of
from trainkit.functions.losses import cross_entropy

WEIGHT_BYTES = 256 << 20  # all layers together; they are broadcast
ROWS_AT_ONCE = 4096

ACTIVATIONS = {
    "linear": lambda x: x,
    "relu": lambda x: np.maximum(x, 0.0),
    "sigmoid": lambda x: 1.0 / (1.0 + np.exp(-np.clip(x, -700, 700))),
}


def layers_from_table(weights: DataFrame) -> list[tuple[np.ndarray, np.ndarray, str]]:
    """Layers from a table (layer int, unit int, w array<double>, b double, activation string), in order."""
    n, width = weights.agg(F.count("*"), F.max(F.size("w"))).first()
    if n * ((width or 0) + 1) * 8 > WEIGHT_BYTES:
        raise ValueError("the weights exceed WEIGHT_BYTES")
    layers: dict[int, list] = {}
    for r in weights.orderBy("layer", "unit").collect():
        layers.setdefault(r["layer"], []).append(r)
    return [(np.array([r["w"] for r in rows], float), np.array([r["b"] for r in rows], float), rows[0]["activation"]) for _, rows in sorted(layers.items())]


def score_dense(df: DataFrame, layers: list[tuple[np.ndarray, np.ndarray, str]], in_col: str, out_col: str = "logits") -> DataFrame:
    """`df` with the output of the dense layers (weights [units, inputs], biases, activation name); one matrix product per Arrow batch.

    The weights are broadcast, within WEIGHT_BYTES.  A null input gives null.
    """
    if sum(w.nbytes + b.nbytes for w, b, _ in layers) > WEIGHT_BYTES:
        raise ValueError("the weights exceed WEIGHT_BYTES")
    shared = df.sparkSession.sparkContext.broadcast(layers)
    rows = df.withColumn(out_col, F.col(in_col).cast("array<double>"))
    at = rows.columns.index(out_col)
    schema = T.StructType([*rows.schema.fields[:at], T.StructField(out_col, T.ArrayType(T.DoubleType())), *rows.schema.fields[at + 1 :]])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, ROWS_AT_ONCE):
                batch = whole.slice(start, ROWS_AT_ONCE)
                column = batch.column(at)
                known = column.is_valid().to_numpy(zero_copy_only=False)
                x = column.drop_null().flatten().to_numpy(zero_copy_only=False).reshape(int(known.sum()), shared.value[0][0].shape[1])
                for weight, bias, activation in shared.value:
                    x = ACTIVATIONS[activation](x @ weight.T + bias) if len(x) else np.zeros((0, len(bias)))
                out = np.full(batch.num_rows, None, object)
                out[np.flatnonzero(known)] = list(x) if len(x) else []
                columns = list(batch.columns)
                columns[at] = pa.array(out.tolist(), pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in schema.fields])

    return rows.mapInArrow(score, schema)


def class_means(df: DataFrame, vec_col: str, label_col: str, width: int) -> DataFrame:
    """(label, mean array): element means per class, one partial aggregate."""
    means = [F.avg(F.get(F.col(vec_col), i)) for i in range(width)]
    return df.groupBy(label_col).agg(F.array(*means).alias("mean"))


def nearest_mean_layers(means: DataFrame, label_col: str, n_classes: int) -> list[tuple[np.ndarray, np.ndarray, str]]:
    """A linear head whose logits are -|x - mean|^2 + |x|^2; the means table has one row per class.

    Classes from 0 to `n_classes` - 1 are read, so what passes the driver is the size of the head; ones without a mean never win.  Without any mean, ValueError.
    """
    rows = {r[label_col]: np.array(r["mean"], float) for r in means.where(F.col(label_col).between(0, n_classes - 1)).collect()}
    if not rows:
        raise ValueError("no class has a mean")
    width = len(next(iter(rows.values())))
    weight, bias = np.zeros((n_classes, width)), np.full(n_classes, -1e9)
    for label, mean in rows.items():
        weight[label], bias[label] = 2.0 * mean, -(mean * mean).sum()
    return [(weight, bias, "linear")]


def predict_columns(df: DataFrame, logits_col: str = "logits") -> DataFrame:
    """`df` with predicted_label, confidence (largest softmax) and prediction_confidence (three decimals as text)."""
    logits = F.col(logits_col)
    out = df.withColumn("predicted_label", argmax(logits)).withColumn("confidence", max_softmax(logits))
    return out.withColumn("prediction_confidence", F.format_string("%.3f", "confidence"))


def sane_labels(df: DataFrame, label_col: str, n_classes: int) -> DataFrame:
    """Labels as long, held in [0, n_classes - 1]; null stays null."""
    label = F.col(label_col).cast("long")
    return df.withColumn(label_col, F.when(label.isNotNull(), F.greatest(F.lit(0), F.least(label, F.lit(n_classes - 1)))).cast("long"))


def topk_accuracy(df: DataFrame, logits_col: str = "logits", label_col: str = "label", ks: tuple[int, ...] = (1, 5)) -> DataFrame:
    """One row: top1, top5, ... in percent. k may not exceed the number of classes."""
    rank = rank_of(F.col(logits_col), F.col(label_col))
    return df.select(rank.alias("_rank")).agg(*[F.avg(F.when(F.col("_rank") <= k, 100.0).otherwise(0.0)).alias(f"top{k}") for k in ks])


def per_class_accuracy(df: DataFrame, label_col: str = "label", predicted_col: str = "predicted_label") -> DataFrame:
    right = F.when(F.col(label_col) == F.col(predicted_col), 1).otherwise(0)
    grouped = df.groupBy(label_col).agg(F.sum(right).cast("long").alias("correct"), F.count("*").alias("total"))
    return grouped.withColumn("accuracy", F.lit(100.0) * F.col("correct") / F.col("total"))


def name_classes(metrics: DataFrame, classes: DataFrame, label_col: str = "label") -> DataFrame:
    """One row per class, those without samples too."""
    return classes.join(metrics, label_col, "left")


def classification_loss(df: DataFrame, logits_col: str = "logits", label_col: str = "label") -> DataFrame:
    """One row: mean cross-entropy and accuracy in percent."""
    right = argmax(F.col(logits_col)) == F.col(label_col)
    return df.agg(F.avg(cross_entropy(F.col(logits_col), F.col(label_col))).alias("loss"), (F.lit(100.0) * F.sum(F.when(right, 1.0).otherwise(0.0)) / F.count("*")).alias("accuracy"))


def batch_qa(df: DataFrame, batch_col: str, frames_col: str, label_col: str) -> DataFrame:
    """Per batch: good and empty samples, whether all sizes agree, sorted distinct labels and their range."""
    size = F.size(frames_col)
    good = F.col(frames_col).isNotNull() & (size > 0)
    return df.groupBy(batch_col).agg(
        F.count_if(good).alias("good"),
        F.count_if(~good).alias("empty"),
        (F.countDistinct(F.when(good, size)) <= 1).alias("same_size"),
        F.sort_array(F.collect_set(label_col)).alias("labels"),
        F.min(label_col).alias("min_label"),
        F.max(label_col).alias("max_label"),
    )


def evaluate_saved(df: DataFrame, weights: DataFrame, in_col: str, label_col: str = "label") -> tuple[DataFrame, DataFrame]:
    """(loss and accuracy, per-class accuracy) of the dense layers of a weights table."""
    scored = predict_columns(score_dense(df, layers_from_table(weights), in_col))
    return classification_loss(scored, "logits", label_col), per_class_accuracy(scored, label_col)


def tensor_profile(df: DataFrame, arr_col: str) -> DataFrame:
    """One row: smallest and largest element and size over all arrays."""
    arr = F.col(arr_col)
    return df.agg(
        F.min(F.array_min(arr)).alias("min_value"), F.max(F.array_max(arr)).alias("max_value"), F.min(F.size(arr)).alias("min_size"), F.max(F.size(arr)).alias("max_size")
    )
