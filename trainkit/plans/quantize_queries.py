"""Queries of vector quantisation: embeddings as 16 positions of 4 channels; the codebook is the first vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trainkit.operators import quantize as Q
from trainkit.plans.base import IMAGES, images, long_rows, new_folder, query, r6, sql_long, unit_sql
from trainkit.sources import logs

K = 16
#: Vectors of 64, the codebook of vectors below K, positions of 4, and a codebook of the first image's positions.
BOOK = f"book AS (SELECT CAST(id AS BIGINT) AS code, pixels AS vec FROM images WHERE id < {K})"
SPATIAL = "spatial AS (SELECT id, p AS pos, [pixels[p + 1], pixels[16 + p + 1], pixels[32 + p + 1], pixels[48 + p + 1]] AS vec FROM images, (SELECT unnest(range(0, 16)) AS p))"
SMALL_BOOK = "small AS (SELECT pos AS code, vec FROM spatial WHERE id = 0)"


def _dist(a: str, b: str, n: int) -> str:
    return f"list_sum(list_transform(range(1, {n + 1}), lambda i: ({a}[CAST(i AS BIGINT)] - {b}[CAST(i AS BIGINT)]) * ({a}[CAST(i AS BIGINT)] - {b}[CAST(i AS BIGINT)])))"


ASSIGNED = f"""pairs AS (SELECT i.id, i.pixels AS vec, b.code, b.vec AS q, {_dist('i.pixels', 'b.vec', 64)} AS distance FROM images i, book b),
assigned AS (SELECT * FROM pairs QUALIFY row_number() OVER (PARTITION BY id ORDER BY distance, code) = 1)"""
SMALL_ASSIGNED = f"""spairs AS (SELECT s.id, s.pos, s.vec, b.code, b.vec AS q, {_dist('s.vec', 'b.vec', 4)} AS distance FROM spatial s, small b),
sassigned AS (SELECT * FROM spairs QUALIFY row_number() OVER (PARTITION BY id, pos ORDER BY distance, code) = 1)"""


def _book(spark: SparkSession, sf_dir: str) -> DataFrame:
    return images(spark, sf_dir).where(F.col("id") < K).select(F.col("id").alias("code"), F.col("pixels").alias("vec"))


def _vecs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return images(spark, sf_dir).select("id", F.col("pixels").alias("vec"))


def _spatial(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.flatten_spatial(images(spark, sf_dir), "id", "pixels", 4, 4, 4).withColumn("pos", F.col("pos").cast("long"))


def _small_book(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spatial(spark, sf_dir).where("id = 0").select(F.col("pos").alias("code"), "vec")


@query(f"WITH {IMAGES}, {SPATIAL} SELECT id, pos AS at, CAST(c - 1 AS BIGINT) AS pos, round(vec[c], 6) + 0.0 AS value FROM (SELECT *, unnest(range(1, 5)) AS c FROM spatial)")
def flatten_spatial(spark: SparkSession, sf_dir: str) -> DataFrame:
    return long_rows(_spatial(spark, sf_dir).withColumnRenamed("pos", "at"), ["id", "at"], F.col("vec"))


@query(f"WITH {IMAGES} SELECT id, p AS at, CAST(c AS BIGINT) AS pos, round(pixels[p * 4 + c + 1], 6) + 0.0 AS value FROM images, (SELECT unnest(range(0, 16)) AS p), (SELECT unnest(range(0, 4)) AS c)")
def flatten_spatial_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = Q.flatten_spatial(images(spark, sf_dir), "id", "pixels", 4, 4, 4, "memory")
    return long_rows(rows.withColumn("at", F.col("pos").cast("long")).drop("pos"), ["id", "at"], F.col("vec"))


@query(f"WITH {IMAGES} " + sql_long("images", "id", "pixels"))
def unflatten_spatial(spark: SparkSession, sf_dir: str) -> DataFrame:
    return long_rows(Q.unflatten_spatial(_spatial(spark, sf_dir), "id", 4, 4, 4), ["id"], F.col("arr"))


ASSIGN_SQL = f"WITH {IMAGES}, {BOOK}, {ASSIGNED} SELECT id, code, round(distance, 6) + 0.0 AS distance FROM assigned"


@query(ASSIGN_SQL)
def assign_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = Q.assign_codes(_vecs(spark, sf_dir), _book(spark, sf_dir))
    return out.select("id", "code", r6(F.col("distance")).alias("distance"))


@query(f"WITH {IMAGES}, {SPATIAL}, {SMALL_BOOK}, {SMALL_ASSIGNED} SELECT id, pos AS at, CAST(c - 1 AS BIGINT) AS pos, round(q[c], 6) + 0.0 AS value FROM (SELECT *, unnest(range(1, 5)) AS c FROM sassigned)")
def lookup_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = _small_book(spark, sf_dir)
    out = Q.lookup_codes(Q.assign_codes(_spatial(spark, sf_dir), book), book)
    return long_rows(out.withColumnRenamed("pos", "at"), ["id", "at"], F.col("quantized"))


@query(
    f"WITH {IMAGES}, {BOOK}, {ASSIGNED}, l AS (SELECT sum(distance) / sum(len(vec)) AS v, avg(list_sum(list_transform(vec, lambda x: x * x))) AS r FROM assigned) "
    "SELECT round(v, 6) + 0.0 AS codebook_loss, round(v, 6) + 0.0 AS commitment_loss, round(r + v + 0.25 * v, 6) + 0.0 AS total_loss FROM l"
)
def quantization_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = _book(spark, sf_dir)
    rows = Q.lookup_codes(Q.assign_codes(_vecs(spark, sf_dir), book), book)
    energy = F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x)
    out = Q.quantization_losses(rows, "vec", "quantized", energy)
    return out.select(*[r6(F.col(c)).alias(c) for c in ("codebook_loss", "commitment_loss", "total_loss")])


@query(f"WITH {IMAGES}, {BOOK}, {ASSIGNED} SELECT CAST(k AS BIGINT) AS code, count(assigned.code) AS uses FROM (SELECT unnest(range(0, {K + 4})) AS k) LEFT JOIN assigned ON assigned.code = k GROUP BY k")
def code_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.code_usage(Q.assign_codes(_vecs(spark, sf_dir), _book(spark, sf_dir)), K + 4)


@query(f"WITH {IMAGES}, {SPATIAL}, {SMALL_BOOK}, {SMALL_ASSIGNED} SELECT id, string_agg(CAST(code AS VARCHAR), ',' ORDER BY pos) AS codes FROM sassigned GROUP BY id")
def codes_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = logs.codes_table(Q.assign_codes(_spatial(spark, sf_dir), _small_book(spark, sf_dir)))
    return rows.select("id", F.array_join(F.transform("codes", lambda c: c.cast("string")), ",").alias("codes"))


@query(f"WITH {IMAGES}, {SPATIAL}, {SMALL_BOOK}, {SMALL_ASSIGNED} SELECT id, CAST(pos AS BIGINT) AS pos, CAST(code AS BIGINT) AS code FROM sassigned")
def write_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes written per sample, and read back."""
    path = new_folder(spark)
    logs.write_codes(Q.assign_codes(_spatial(spark, sf_dir), _small_book(spark, sf_dir)), path)
    back = spark.read.parquet(path)
    return back.select("id", F.posexplode("codes").alias("pos", "code")).select("id", F.col("pos").cast("long").alias("pos"), F.col("code").cast("long").alias("code"))


MEMBERS = f"""e AS (SELECT code, i, avg(v) AS m, sum(v) AS s, count(*) AS n FROM (SELECT code, unnest(range(0, 64)) AS i, unnest(vec) AS v FROM assigned) GROUP BY code, i),
old AS (SELECT code, unnest(range(0, 64)) AS i, unnest(vec) AS v FROM book)"""


@query(f"WITH {IMAGES}, {BOOK}, {ASSIGNED}, {MEMBERS} SELECT old.code, CAST(old.i AS BIGINT) AS pos, round(coalesce(e.m, old.v), 6) + 0.0 AS value FROM old LEFT JOIN e USING (code, i)")
def fit_codebook_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    book, _ = Q.fit_codebook(_vecs(spark, sf_dir), _book(spark, sf_dir), 1, "mean")
    return long_rows(book.withColumn("code", F.col("code").cast("long")), ["code"], F.col("vec"))


@query(
    f"WITH {IMAGES}, {BOOK}, {ASSIGNED}, {MEMBERS}, t AS (SELECT count(*) AS rows FROM images) "
    "SELECT old.code, CAST(old.i AS BIGINT) AS pos, round(old.v - 10.0 * 2.0 / (t.rows * 64) * (coalesce(e.n, 0) * old.v - coalesce(e.s, 0)), 6) + 0.0 AS value FROM old CROSS JOIN t LEFT JOIN e USING (code, i)"
)
def fit_codebook_gradient(spark: SparkSession, sf_dir: str) -> DataFrame:
    book, _ = Q.fit_codebook(_vecs(spark, sf_dir), _book(spark, sf_dir), 1, "gradient", 10.0)
    return long_rows(book.withColumn("code", F.col("code").cast("long")), ["code"], F.col("vec"))


@query(
    f"""WITH {IMAGES}, book AS (SELECT code, list(({unit_sql('6', 'code', 'i')} * 2.0 - 1.0) / {K}.0 ORDER BY i) AS vec FROM (SELECT unnest(range(0, {K})) AS code), (SELECT unnest(range(0, 64)) AS i) GROUP BY code), {ASSIGNED}
SELECT id, code, round(distance, 6) + 0.0 AS distance FROM assigned"""
)
def init_codebook(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assignment to a fresh random codebook."""
    out = Q.assign_codes(_vecs(spark, sf_dir), Q.init_codebook(spark, K, 64, seed=6))
    return out.select("id", "code", r6(F.col("distance")).alias("distance"))
