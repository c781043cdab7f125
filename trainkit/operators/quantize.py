"""Vector quantisation against a codebook: assignment, lookup, losses, usage, fitting."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trainkit.functions.arrays import spatial_vectors, square_distance
from trainkit.functions.draws import draw
from trainkit.functions.losses import weighted_total_loss
from trainkit.sources.tables import written

CODEBOOK_BYTES = 64 << 20  # of a codebook, or a slice of one, that is broadcast
SLICES_AT_ONCE = 4  # that a worker holds
GROUPS_A_SLICE = 8  # neighbourhoods by which codes are put into slices
TRIED = 32  # codes looked at for a pivot
PLAIN_CODES = 256  # that are compared without groups
ROWS_AT_ONCE = 4096
NO_CODE = np.iinfo(np.int64).max


def flatten_spatial(df: DataFrame, id_col: str, arr_col: str, c: int, h: int, w: int, layout: str = "channels_last") -> DataFrame:
    """(id, pos, vec): one row per position of every image."""
    return df.select(F.col(id_col), F.posexplode(spatial_vectors(F.col(arr_col), c, h, w, layout)).alias("pos", "vec"))


def unflatten_spatial(df: DataFrame, id_col: str, c: int, h: int, w: int, arr_col: str = "arr") -> DataFrame:
    """(id, arr): the reverse of `flatten_spatial` in its channels_last layout."""
    area = h * w
    rows = df.groupBy(id_col).agg(F.sort_array(F.collect_list(F.struct("pos", "vec"))).alias("_v"))
    flat = F.transform(F.sequence(F.lit(0), F.lit(c * area - 1)), lambda i: F.get(F.get(F.col("_v"), (i % area).cast("int"))["vec"], F.floor(i / area).cast("int")))
    return rows.select(id_col, flat.alias(arr_col))


def _sound(codebook: DataFrame) -> DataFrame:
    """(code, vec) of the codes that have a vector of finite numbers."""
    rows = codebook.select("code", F.col("vec").cast("array<double>").alias("vec"))
    return rows.where(F.col("code").isNotNull() & F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))


def _vectors(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, matrix) of the vectors of a width; null ones, others' widths, and vectors with null or non-finite elements are left out."""
    fits = np.flatnonzero(pc.fill_null(pc.equal(pc.list_value_length(column), width), False).to_numpy(zero_copy_only=False))
    flat = column.take(pa.array(fits)).flatten().to_numpy(zero_copy_only=False).reshape(len(fits), width)
    finite = np.isfinite(flat).all(axis=1)
    return fits[finite], flat[finite]


def nearest(vectors: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place of the nearest code, squared distance). The expanded form proposes, the explicit difference decides near ties."""
    proposed = (book * book).sum(axis=1)[None, :] - 2.0 * vectors @ book.T
    low = proposed.min(axis=1, keepdims=True)
    scale = 1.0 + (vectors * vectors).sum(axis=1, keepdims=True) + np.abs(low)
    rows, codes = np.nonzero(proposed <= low + 1e-9 * scale)
    exact = ((vectors[rows] - book[codes]) ** 2).sum(axis=1)
    order = np.lexsort((codes, exact, rows))
    first = order[np.concatenate([[True], rows[order][1:] != rows[order][:-1]])] if len(order) else order
    return codes[first], exact[first]


def far_apart(vectors: np.ndarray, n: int) -> np.ndarray:
    """Places of `n` vectors, each the farthest from those before it, among at most 2 * TRIED * n of evenly spaced places."""
    tried = np.arange(0, len(vectors), max(1, len(vectors) // (TRIED * n)))
    some, picked = vectors[tried], [0]
    away = ((some - some[0]) ** 2).sum(axis=1)
    for _ in range(min(n, len(tried)) - 1):
        picked.append(int(away.argmax()))
        away = np.minimum(away, ((some - some[picked[-1]]) ** 2).sum(axis=1))
    return tried[np.unique(picked)]


class Cells:
    """Codes grouped around pivots, so that a vector is compared with the codes of few groups.

    A code of a group lies at least (distance to the pivot - radius of the group) from a vector, by the triangle inequality; groups for which that is
    above the best distance so far can't have the nearest code.  A little slack covers rounding, so nothing is lost by it.
    """

    def __init__(self, codes: np.ndarray, vectors: np.ndarray) -> None:
        """`codes` ascend; up to PLAIN_CODES form one group."""
        self.compared = 0
        pivots = max(1, round(len(codes) ** 0.5)) if len(codes) > PLAIN_CODES else 1
        self.pivots = vectors[far_apart(vectors, pivots)]
        parts = [nearest(vectors[at : at + ROWS_AT_ONCE], self.pivots) for at in range(0, len(codes), ROWS_AT_ONCE)]
        near, far = np.concatenate([p for p, _ in parts]), np.concatenate([d for _, d in parts])
        order = np.argsort(near, kind="stable")
        self.codes, self.vectors = codes[order], vectors[order]
        self.ends = np.cumsum(np.bincount(near, minlength=len(self.pivots)))
        self.radius = np.sqrt(np.maximum.reduceat(np.append(far[order], 0.0), np.append(0, self.ends[:-1])))
        self.slack = np.sqrt((self.pivots**2).sum(axis=1).max())

    def improve(self, rows: np.ndarray, code: np.ndarray, distance: np.ndarray) -> None:
        """Puts nearer codes (on ties lower ones) and their squared distances in the place of those that the rows have."""
        if not len(rows):
            return
        if len(self.pivots) == 1:
            self._visit(0, np.arange(len(rows)), rows, code, distance)
            return
        squares = (rows * rows).sum(axis=1)[:, None]
        away = np.sqrt(np.maximum(squares + (self.pivots**2).sum(axis=1)[None, :] - 2.0 * rows @ self.pivots.T, 0.0))
        least = away - self.radius[None, :] - 1e-6 * (1.0 + np.sqrt(squares) + self.slack)
        first = away.argmin(axis=1)
        for cell in np.unique(first):
            at = np.flatnonzero(first == cell)
            self._visit(cell, at[least[at, cell] <= np.sqrt(distance[at])], rows, code, distance)
        least[np.arange(len(rows)), first] = np.inf
        for cell in np.flatnonzero((least <= np.sqrt(distance)[:, None]).any(axis=0)):
            self._visit(cell, np.flatnonzero(least[:, cell] <= np.sqrt(distance)), rows, code, distance)

    def _visit(self, cell: int, at: np.ndarray, rows: np.ndarray, code: np.ndarray, distance: np.ndarray) -> None:
        start, end = self.ends[cell - 1] if cell else 0, self.ends[cell]
        if start == end or not len(at):
            return
        self.compared += len(at) * int(end - start)
        place, found = nearest(rows[at], self.vectors[start:end])
        known = self.codes[start + place]
        better = (found < distance[at]) | ((found == distance[at]) & (known < code[at]))
        code[at[better]], distance[at[better]] = known[better], found[better]


def _slices(codebook: DataFrame) -> Iterator[Cells]:
    """The sound codes in slices of at most CODEBOOK_BYTES, codes that lie together in one slice where there are several."""
    rows = _sound(codebook)
    n, width = rows.agg(F.count("*"), F.max(F.size("vec"))).first()
    if not n:
        return
    most = CODEBOOK_BYTES // (8 * max(1, width))
    if not most:
        raise ValueError("one code exceeds CODEBOOK_BYTES")
    order = ["code"]
    if n > most:  # slices of neighbours: codes by the nearest of some codes
        groups = min(most, GROUPS_A_SLICE * -(-n // most))
        some = rows.orderBy(F.xxhash64("code"), "code").limit(min(most, TRIED * groups)).orderBy("code").collect()
        centres = _cells([some[i] for i in far_apart(np.array([r["vec"] for r in some], float), groups)])
        rows, order = written(_improved(rows, "vec", [centres], "cell", "_away").drop("_away")), ["cell", "code"]
        yield centres  # so that each vector has a near code before it meets the first slice
    last = None
    while True:
        rest = rows if last is None else rows.where(F.struct(*order) > F.struct(*[F.lit(v).cast(rows.schema[c].dataType).alias(c) for c, v in zip(order, last, strict=True)]))
        part = rest.orderBy(*order).limit(most).collect()
        if not part:
            return
        last = [part[-1][c] for c in order]
        yield _cells(sorted(part, key=lambda r: r["code"]))


def _cells(rows: list) -> Cells:
    return Cells(np.array([r["code"] for r in rows], np.int64), np.array([r["vec"] for r in rows], float))


def assign_codes(vecs: DataFrame, codebook: DataFrame, vec_col: str = "vec", method: str = "matmul", key_cols: list[str] | None = None) -> DataFrame:
    """`vecs` with code and distance (squared) of the nearest codebook row; the lowest code on ties.

    matmul: the codebook is broadcast (within CODEBOOK_BYTES); the vectors are not shuffled, and each Arrow batch is multiplied with the
    codes of those groups that can have a nearest one.  A codebook beyond the bound, of distinct codes, is assigned in slices that fit it; every code is
    seen, and vectors carry the best of earlier slices.  join: every pair is compared in SQL, for small tables and as a check; it needs `key_cols` that
    identify a row.

    matmul gives null codes to null vectors, those with null or non-finite elements and those of another length than the codes; codes without a sound
    vector are nobody's.  An empty codebook gives null codes, no vectors no rows; columns that have the results' names are replaced.
    """
    if method == "join":
        keys = key_cols or [c for c in vecs.columns if c != vec_col]
        pairs = vecs.crossJoin(codebook.select(F.col("code").alias("_code"), F.col("vec").cast("array<double>").alias("_vec")))
        best = pairs.groupBy(*keys).agg(
            F.min(F.struct(square_distance(F.col(vec_col), F.col("_vec")).alias("distance"), F.col("_code").alias("code"))).alias("_best"), F.first(vec_col).alias(vec_col)
        )
        return best.select(*keys, vec_col, F.col("_best.code").alias("code"), F.col("_best.distance").alias("distance"))
    if method != "matmul":
        raise ValueError(f"unknown method {method}")
    out, parts = vecs.drop("code", "distance"), []
    for cells in _slices(codebook):
        if len(parts) == SLICES_AT_ONCE:  # of which workers hold no more
            out, parts = written(_improved(out, vec_col, parts)), []
        parts.append(cells)
    return _improved(out, vec_col, parts)


def _improved(vecs: DataFrame, vec_col: str, parts: list[Cells], code: str = "code", distance: str = "distance") -> DataFrame:
    """`vecs` with the nearest code of some slices, or of those and the code that they already have."""
    if not parts:
        return vecs if code in vecs.columns else vecs.withColumns({code: F.lit(None).cast("long"), distance: F.lit(None).cast("double")})
    shared = [vecs.sparkSession.sparkContext.broadcast(cells) for cells in parts]
    rows = vecs.withColumn(vec_col, F.col(vec_col).cast("array<double>"))
    if code not in vecs.columns:
        rows = rows.withColumns({code: F.lit(None).cast("long"), distance: F.lit(None).cast("double")})
    at, code_at, distance_at = (rows.columns.index(c) for c in (vec_col, code, distance))
    names = rows.columns

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, ROWS_AT_ONCE):
                batch = whole.slice(start, ROWS_AT_ONCE)
                codes = pc.fill_null(batch.column(code_at), NO_CODE).to_numpy(zero_copy_only=False).copy()
                distances = pc.fill_null(batch.column(distance_at), float("inf")).to_numpy(zero_copy_only=False).copy()
                for cells in shared:
                    places, vectors = _vectors(batch.column(at), cells.value.vectors.shape[1])
                    known, away = codes[places], distances[places]
                    cells.value.improve(vectors, known, away)
                    codes[places], distances[places] = known, away
                columns, none = list(batch.columns), np.isinf(distances)
                columns[code_at], columns[distance_at] = pa.array(codes, mask=none), pa.array(distances, mask=none)
                yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = T.StructType([T.StructField(f.name, f.dataType) for f in rows.schema.fields])
    return rows.mapInArrow(assign, schema)


def lookup_codes(codes: DataFrame, codebook: DataFrame) -> DataFrame:
    """`codes` with the vector of their code; Spark broadcasts a small codebook."""
    return codes.join(codebook.select("code", F.col("vec").alias("quantized")), "code")


def quantization_losses(df: DataFrame, vec_col: str, quantized_col: str, reconstruction: Column | None = None, beta: float = 0.25) -> DataFrame:
    """One row: codebook_loss and commitment_loss (the same mean over all elements), total_loss with the mean of `reconstruction`."""
    parts = df.agg(
        F.sum(square_distance(F.col(vec_col), F.col(quantized_col))).alias("_sq"),
        F.sum(F.size(vec_col)).alias("_n"),
        (F.avg(reconstruction) if reconstruction is not None else F.lit(0.0)).alias("_recon"),
    )
    loss = F.col("_sq") / F.col("_n")
    return parts.select(
        loss.alias("codebook_loss"), loss.alias("commitment_loss"), weighted_total_loss(F.col("_recon"), [(loss, 1.0), (loss, beta)]).alias("total_loss")
    )


def code_usage(codes: DataFrame, k: int) -> DataFrame:
    """(code, uses) for every code from 0 to k - 1, unused ones too."""
    every = codes.sparkSession.range(k).withColumnRenamed("id", "code")
    counts = codes.groupBy(F.col("code").cast("long").alias("code")).agg(F.count("*").alias("uses"))
    return every.join(counts, "code", "left").select("code", F.coalesce("uses", F.lit(0)).alias("uses"))


def init_codebook(spark: SparkSession, k: int, d: int, seed: int = 0) -> DataFrame:
    """(code, vec): k vectors, uniform in (-1/k, 1/k), drawn from md5 of seed, code and dimension."""
    number = lambda i: F.conv(F.substring(draw(seed, F.col("code"), i), 1, 8), 16, 10).cast("double") / float(2**32)
    return spark.range(k).select(F.col("id").cast("int").alias("code")).select("code", F.transform(F.sequence(F.lit(0), F.lit(d - 1)), lambda i: (number(i) * 2.0 - 1.0) / float(k)).alias("vec"))


def codebook_sums(assigned: DataFrame, width: int, vec_col: str = "vec") -> DataFrame:
    """(code, n, total, squares) of rows with code and distance: members of every code.

    Each task sends a row for a code it saw (more only if it saw more codes than fit in CODEBOOK_BYTES), so popular codes don't skew the shuffle.
    """
    most = max(1, CODEBOOK_BYTES // (8 * (width + 2)))

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, n, totals, squares = np.empty(0, np.int64), np.empty(0, np.int64), np.empty((0, width)), np.empty(0)
        for whole in batches:
            for start in range(0, whole.num_rows, ROWS_AT_ONCE):
                batch = whole.slice(start, ROWS_AT_ONCE)
                places, rows = _vectors(batch.column(2), width)
                seen = np.union1d(codes, batch.column(0).to_numpy()[places])
                if len(codes) and len(seen) > most:
                    yield _sums(codes, n, totals, squares)
                    codes, n, totals, squares, seen = codes[:0], n[:0], totals[:0], squares[:0], np.unique(batch.column(0).to_numpy()[places])
                old, new = np.searchsorted(seen, codes), np.searchsorted(seen, batch.column(0).to_numpy()[places])
                counts, sums, away = np.bincount(new, minlength=len(seen)), np.zeros((len(seen), width)), np.bincount(new, weights=batch.column(1).to_numpy()[places], minlength=len(seen))
                np.add.at(sums, new, rows)
                counts[old] += n
                sums[old] += totals
                away[old] += squares
                codes, n, totals, squares = seen, counts, sums, away
        yield _sums(codes, n, totals, squares)

    rows = assigned.where(F.col("code").isNotNull()).select(F.col("code").cast("long").alias("code"), "distance", F.col(vec_col).cast("array<double>").alias("vec"))
    parts = rows.mapInArrow(partial, "code long, n long, total array<double>, squares double")
    zeros = F.array_repeat(F.lit(0.0), width)
    together = F.aggregate(F.collect_list("total"), zeros, lambda a, t: F.zip_with(a, t, lambda x, y: x + y))
    return parts.groupBy("code").agg(F.sum("n").alias("n"), together.alias("total"), F.sum("squares").alias("squares"))


def _sums(codes: np.ndarray, n: np.ndarray, totals: np.ndarray, squares: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(codes), pa.array(n), pa.array(list(totals), pa.list_(pa.float64())), pa.array(squares)], names=["code", "n", "total", "squares"])


def fit_codebook(vecs: DataFrame, codebook: DataFrame, steps: int, mode: str = "mean", learning_rate: float = 1.0, vec_col: str = "vec") -> tuple[DataFrame, list[float]]:
    """(new codebook, mean squared loss before each step).

    mean: a code moves to the mean of its members; gradient: one plain gradient step of the codebook loss.
    Codes without members stay, vectors that have no code don't count.  The codebook is a table, written after each step; it may be larger than CODEBOOK_BYTES, then vectors are
    assigned slice by slice.  Only sums over all codes pass the driver.  An empty codebook raises ValueError.
    """
    if mode not in ("mean", "gradient"):
        raise ValueError(f"unknown mode {mode}")
    book = _sound(codebook)
    width = book.agg(F.max(F.size("vec"))).first()[0]
    if width is None:
        raise ValueError("the codebook has no codes")
    losses: list[float] = []
    for _ in range(steps):
        sums = written(codebook_sums(assign_codes(vecs.select(F.col(vec_col).alias("vec")), book), width))
        n, squares = sums.agg(F.sum("n"), F.sum("squares")).first()
        elements = max(1, (n or 0) * width)
        losses.append((squares or 0.0) / elements)
        met = book.join(sums.withColumnRenamed("code", "_code"), F.col("code") == F.col("_code"), "left")
        if mode == "mean":
            moved = F.transform("total", lambda t: t / F.col("n"))
        else:
            rate = learning_rate * 2.0 / elements
            moved = F.zip_with("vec", "total", lambda v, t: v - (F.col("n") * v - t) * rate)
        book = written(met.select("code", F.when(F.col("n").isNull(), F.col("vec")).otherwise(moved).alias("vec")))
    return book, losses
