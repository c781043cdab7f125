"""Repeatable augmentation of flat images, and noise."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trainkit.functions.draws import below, coin, normals


def random_apply(df: DataFrame, id_col: str, col: str, p: float, fn: Callable[[Column], Column], seed: int = 0, epoch: int = 0) -> DataFrame:
    """`fn` on `col` with probability p per row, by a coin of seed, epoch and id."""
    return df.withColumn(col, F.when(coin(p, seed, epoch, F.col(id_col)), fn(F.col(col))).otherwise(F.col(col)))


def hflip(arr: Column, c: int, h: int, w: int) -> Column:
    """Each row of pixels mirrored."""
    return F.when(arr.isNotNull(), F.transform(F.sequence(F.lit(0), F.lit(c * h * w - 1)), lambda i: F.get(arr, (i - i % w + (w - 1) - i % w).cast("int"))))


def random_hflip(df: DataFrame, id_col: str, col: str, c: int, h: int, w: int, p: float = 0.5, seed: int = 0, epoch: int = 0) -> DataFrame:
    return random_apply(df, id_col, col, p, lambda a: hflip(a, c, h, w), seed, epoch)


def random_crop_pad(df: DataFrame, id_col: str, col: str, c: int, h: int, w: int, size: int, pad: int, seed: int = 0, epoch: int = 0, big: bool = False) -> DataFrame:
    """`size` x `size` from a random place of the image padded with zeros by `pad` on each side.

    Offsets are `_dy` and `_dx` draws of seed, epoch and id.  Built-in expressions by default; `big` uses numpy
    on Arrow batches with the same result.
    """
    dy = below(h + 2 * pad - size + 1, seed, epoch, F.col(id_col), "y")
    dx = below(w + 2 * pad - size + 1, seed, epoch, F.col(id_col), "x")
    rows = df.withColumn("_dy", dy).withColumn("_dx", dx)
    if big:
        return _crop_batches(rows, col, c, h, w, size, pad).drop("_dy", "_dx")

    def pixel(i: Column) -> Column:
        y = F.floor(i / size) % size + F.col("_dy") - pad
        x = i % size + F.col("_dx") - pad
        inside = (y >= 0) & (y < h) & (x >= 0) & (x < w)
        return F.when(inside, F.get(F.col(col), (F.floor(i / (size * size)) * (h * w) + y * w + x).cast("int"))).otherwise(0.0)

    crop = F.when(F.col(col).isNotNull(), F.transform(F.sequence(F.lit(0), F.lit(c * size * size - 1)), pixel))
    return rows.withColumn(col, crop).drop("_dy", "_dx")


def _crop_batches(rows: DataFrame, col: str, c: int, h: int, w: int, size: int, pad: int) -> DataFrame:
    at, dy_at, dx_at = (rows.columns.index(x) for x in (col, "_dy", "_dx"))
    rows = rows.withColumn(col, F.col(col).cast("array<double>"))
    names = rows.columns

    def crop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for arr, dy, dx in zip(batch.column(at), batch.column(dy_at).to_pylist(), batch.column(dx_at).to_pylist(), strict=True):
                if not arr.is_valid:
                    out.append(None)
                    continue
                image = np.zeros((c, h + 2 * pad, w + 2 * pad))
                image[:, pad : pad + h, pad : pad + w] = arr.values.to_numpy(zero_copy_only=False).reshape(c, h, w)
                out.append(image[:, dy : dy + size, dx : dx + size].ravel())
            columns = list(batch.columns)
            columns[at] = pa.array(out, pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return rows.mapInArrow(crop, rows.schema)


def noise_table(spark: SparkSession, n: int, dim: int, seed: int = 0) -> DataFrame:
    """(id, noise): n standard normal vectors, drawn from md5 of seed, id and place, so partitioning changes nothing and SQL can repeat them."""
    return spark.range(n).select("id", normals(dim, seed, F.col("id")).alias("noise"))
