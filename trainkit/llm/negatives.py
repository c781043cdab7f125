"""Hard negatives by exact integer inner products in a residue number system.

Components become whole numbers, floor(scale * x).  A block of anchors and a batch of rows are multiplied as float32 matrices
modulo several small primes: residues lie within half a prime of 0 and columns are taken in slices, so that every sum
stays below 2^24 and is exact.  Chinese remaindering (one mixed-radix digit per prime) puts the signed scores together.  As many primes
are taken as the largest possible score asks for: no score is above the largest squared norm.

Anchors go out in broadcasts of bounded size; every block of them meets every row, in the batches in which Spark reads
the rows.  A task keeps the best rows of its partition per anchor, and Spark merges the tasks' lists.  Positives are found first;
their scores set the windows in which the second pass looks for negatives.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trainkit.llm.common import cut, forget

# The primes below 256 from the largest; the product of all is above 2^63, of all but the last below it.
PRIMES = (251, 241, 239, 233, 229, 227, 223, 211, 199)
EXACT = 1 << 24  # float32 holds whole numbers up to here
ANCHOR_ROWS, ANCHOR_BYTES = 65_536, 32 << 20  # of a broadcast block
CELLS = 1 << 21  # scores that a task holds at once
ROWS_AT_ONCE = 8192
LARGEST_SCORE = 1 << 62
NONE = np.iinfo(np.int64).min
MINED = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


class Residues:
    """Matrices of whole numbers modulo the primes that scores up to `largest` (either sign) need."""

    def __init__(self, largest: int) -> None:
        self.primes, product = [PRIMES[0]], PRIMES[0]
        while product <= 2 * largest:
            self.primes.append(PRIMES[len(self.primes)])
            product *= self.primes[-1]
        self.columns = [EXACT // (p // 2) ** 2 for p in self.primes]  # of a slice whose sums are exact

    def of(self, whole: np.ndarray) -> list[np.ndarray]:
        """One float32 matrix per prime, entries within half a prime of 0."""
        return [((whole + p // 2) % p - p // 2).astype(np.float32) for p in self.primes]

    def products(self, a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
        """Exact a @ b.T of the matrices with these residues; signed digits of a mixed radix, so sums need no last correction."""
        score, step = np.zeros((len(a[0]), len(b[0])), np.int64), 1
        for p, columns, x, y in zip(self.primes, self.columns, a, b, strict=True):
            residue = np.zeros(score.shape, np.int64)
            for at in range(0, x.shape[1], columns):
                residue += (x[:, at : at + columns] @ y[:, at : at + columns].T).astype(np.int64)
            digit = ((residue - score) % p * pow(step, -1, p) + p // 2) % p - p // 2
            score += digit * step
            step *= p
        return score


def best_of(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k highest entries of every row that aren't NONE, on ties the first columns."""
    keep = scores != NONE
    if scores.shape[1] > k:
        keep &= scores >= np.partition(scores, scores.shape[1] - k, axis=1)[:, -k, None]
    row, column = np.nonzero(keep)
    order = np.lexsort((column, -scores[row, column], row))
    row, column = row[order], column[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    return row[place < k], column[place < k]


class Lists:
    """The k best (score, id) of every key seen so far."""

    def __init__(self, keys: int, k: int) -> None:
        self.k, self.scores, self.ids = k, np.full((keys, k), NONE, np.int64), np.zeros((keys, k), np.int64)

    def add(self, keys: slice, scores: np.ndarray, ids: np.ndarray) -> None:
        """Scores of keys (rows) by candidates (columns, in order of their ids); NONE where a candidate is out."""
        scores = np.where(scores >= self.scores[keys, -1:], scores, NONE)  # what can't enter a full list
        row, column = best_of(scores, self.k)
        if not len(row):
            return
        held = np.arange(keys.start, keys.stop)
        old_row, old_column = np.nonzero(self.scores[keys] != NONE)
        of = np.concatenate([old_row, row])
        score = np.concatenate([self.scores[keys][old_row, old_column], scores[row, column]])
        known = np.concatenate([self.ids[keys][old_row, old_column], ids[column]])
        order = np.lexsort((known, -score, of))
        of, score, known = of[order], score[order], known[order]
        place = np.arange(len(of)) - np.searchsorted(of, of)
        fits = place < self.k
        self.scores[held[of[fits]], place[fits]] = score[fits]
        self.ids[held[of[fits]], place[fits]] = known[fits]

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        key, place = np.nonzero(self.scores != NONE)
        return key, self.scores[key, place], self.ids[key, place]


def whole_vectors(rows: DataFrame, id_col: str, label: Column, vec_col: str, scale: int) -> tuple[DataFrame, int, int]:
    """(id, label, vec) with whole components, written; the largest squared norm and the most components.

    Out are rows without id or label, without a vector, or with a component that is null, not finite, or so large that a
    score could pass 2^62.
    """
    most = rows.agg(F.max(F.size(vec_col))).first()[0] or 0
    limit = isqrt(LARGEST_SCORE // max(1, most)) / scale
    taken = rows.select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), F.col(vec_col).cast("array<double>").alias("x")).dropna()
    sound = taken.where(F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) <= limit)))
    table = cut(sound.select("id", "label", F.transform("x", lambda v: F.floor(v * float(scale))).alias("vec")))
    norm = table.agg(F.max(F.aggregate("vec", F.lit(0).cast("decimal(38,0)"), lambda n, v: (n + v.cast("decimal(19,0)") * v).cast("decimal(38,0)")))).first()[0]
    return table, int(norm or 0), most


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Vectors of whole numbers, padded with zeros to a width."""
    sizes = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), width), np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


class Block:
    """What goes out with a block of anchors: ids, labels, whole vectors, and for negatives the lowest and highest score of each list."""

    def __init__(self, anchors: list, width: int, largest: int) -> None:
        self.ids = np.array([r["id"] for r in anchors], np.int64)
        self.labels = np.array([r["label"] for r in anchors], np.int64)
        self.vecs = _matrix(pa.array([r["vec"] for r in anchors], pa.list_(pa.int64())), width)
        self.width, self.largest = width, largest
        self.low = self.high = None


def _tops(table: DataFrame, shared: Broadcast, lists: int, k: int) -> DataFrame:
    """(anchor, list, score, id): each task's best k rows per anchor and list.

    Without windows there is one list of rows with the anchor's label, else one list per window of rows with another label.
    """

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        system, n = Residues(block.largest), len(block.ids)
        anchors = system.of(block.vecs)
        found = [Lists(n, k) for _ in range(lists)]
        for whole in batches:
            for start in range(0, whole.num_rows, ROWS_AT_ONCE):
                batch = whole.slice(start, ROWS_AT_ONCE)
                order = np.argsort(batch.column(0).to_numpy(), kind="stable")
                ids, labels = batch.column(0).to_numpy()[order], batch.column(1).to_numpy()[order]
                rows = system.of(_matrix(batch.column(2), block.width)[order])
                step = max(1, CELLS // len(ids))
                for at in range(0, n, step):
                    part = slice(at, min(n, at + step))
                    scores = system.products([a[part] for a in anchors], rows)
                    alike = block.labels[part, None] == labels[None, :]
                    if block.low is None:
                        found[0].add(part, np.where(alike & (block.ids[part, None] != ids[None, :]), scores, NONE), ids)
                        continue
                    for j in range(lists):
                        inside = (scores >= block.low[part, j, None]) & (scores <= block.high[part, j, None]) & ~alike
                        found[j].add(part, np.where(inside, scores, NONE), ids)
        for j, best in enumerate(found):
            key, score, known = best.rows()
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.full(len(key), j, np.int32)), pa.array(score), pa.array(known)], names=["anchor", "list", "score", "id"])

    return table.mapInArrow(search, "anchor long, list int, score long, id long")


def _merged(tops: DataFrame, k: int) -> DataFrame:
    """The best k of all tasks' lists, ranked from 1; higher scores first, then smaller ids."""
    order = Window.partitionBy("anchor", "list").orderBy(F.col("score").desc(), "id")
    return tops.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(
    rows: DataFrame, is_anchor: Column, id_col: str = "vec_id", label: Column | None = None, vec_col: str = "embedding",
    scale: int = 256, positives: int = 5, negatives: int = 10, window: tuple[int, int] = (30, 90), anchor_rows: int = ANCHOR_ROWS,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    A row's score is its inner product with the anchor; higher scores come first, then smaller ids.  Positives are an anchor's first other rows
    of its label.  Negatives are the first rows of other labels whose score lies within `window` percent of the positive's, both
    ends included; a positive score below 0 has none.

    Rows without an id, a label or a vector, or with a null or non-finite component take no part, nor do those with a component so large that a score
    could leave a long.  Shorter vectors count as padded with zeros.  `is_anchor` is a condition on `id`; a repeated anchor row counts once, other
    repeated rows are candidates of their own, and rows that share the anchor's id are not its positives.  An empty table gives no rows.
    """
    table, largest, width = whole_vectors(rows, id_col, F.col("label") if label is None else label, vec_col, scale)
    size = max(1, min(anchor_rows, ANCHOR_BYTES // (8 * max(1, width))))
    anchors = cut(table.where(is_anchor).distinct().withColumn("key", F.monotonically_increasing_id()))
    spark, found, last = rows.sparkSession, [], -1
    while taken := anchors.where(F.col("key") > last).orderBy("key").limit(size).collect():
        found.append(_mined(spark, table, Block(taken, width, largest), positives, negatives, window))
        last = taken[-1]["key"]
    whole = reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], MINED)
    forget(anchors)
    return whole


def _mined(spark: SparkSession, table: DataFrame, block: Block, positives: int, negatives: int, window: tuple[int, int]) -> DataFrame:
    """The rows of `mine` for one block of anchors, written: its positives (`positives` per anchor) go out with it again for their windows."""
    shared = spark.sparkContext.broadcast(block)
    near = _merged(_tops(table, shared, 1, positives), positives).select("anchor", (F.col("rank") - 1).alias("list"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")).toPandas()
    block.low, block.high = np.ones((len(block.ids), positives), np.int64), np.zeros((len(block.ids), positives), np.int64)
    for anchor, j, score in zip(near["anchor"], near["list"], near["positive_score"].tolist(), strict=True):
        block.low[anchor, j], block.high[anchor, j] = -(-window[0] * score // 100), window[1] * score // 100
    windows = spark.sparkContext.broadcast(block)
    far = _merged(_tops(table, windows, positives, negatives), negatives).withColumnsRenamed({"id": "negative_id", "score": "negative_score"})
    near["anchor_id"] = block.ids[near["anchor"].to_numpy(np.int64)]
    pairs = spark.createDataFrame(near, "anchor long, list int, positive_id long, positive_score long, anchor_id long") if len(near) else spark.createDataFrame([], "anchor long, list int, positive_id long, positive_score long, anchor_id long")
    mined = cut(far.join(F.broadcast(pairs), ["anchor", "list"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"))
    shared.unpersist()
    windows.unpersist()
    return mined
