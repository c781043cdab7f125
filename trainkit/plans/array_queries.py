"""Queries of the array, loss and augmentation functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trainkit.functions import arrays as A
from trainkit.functions import losses as L
from trainkit.operators import augment, metrics, scoring
from trainkit.plans.base import IMAGES, below_sql, draw_sql, images, long_rows, normal_sql, query, r6, sql_long, table


def _bytes(df: DataFrame) -> DataFrame:
    """`pixels` as bytes: each value of [-1, 1] to 0..255."""
    return df.withColumn("raw", F.transform("pixels", lambda x: F.floor((x + 1.0) * 127.5).cast("double")))


RAW = "list_transform(pixels, lambda x: CAST(floor((x + 1.0) * 127.5) AS DOUBLE))"
#: A channel's elements of a 4 x 4 x 4 image in DuckDB, and norms of lists.
MEAN3, STD3 = "[0.4914, 0.4822, 0.4465, 0.5]", "[0.2023, 0.1994, 0.2010, 0.5]"
MEAN, STD = (*A.CIFAR_MEAN, 0.5), (*A.CIFAR_STD, 0.5)


@query(f"WITH {IMAGES} " + sql_long(f"(SELECT id, list_transform(range(0, 64), lambda i: ({RAW})[CAST((i % 16) * 4 + i // 16 + 1 AS BIGINT)] / 255.0) AS arr FROM images)", "id", "arr"))
def to_unit_chw(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _bytes(images(spark, sf_dir))
    return long_rows(df, ["id"], A.to_unit_chw(F.col("raw"), 4, 4, 4))


@query(
    f"WITH {IMAGES} "
    + sql_long(f"(SELECT id, list_transform(range(0, 64), lambda i: (pixels[CAST(i + 1 AS BIGINT)] - ({MEAN3})[CAST(i // 16 + 1 AS BIGINT)]) / ({STD3})[CAST(i // 16 + 1 AS BIGINT)]) AS arr FROM images)", "id", "arr")
)
def normalize_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return long_rows(images(spark, sf_dir), ["id"], A.normalize_channels(F.col("pixels"), MEAN, STD, 16))


@query(
    f"WITH {IMAGES} "
    + sql_long(
        "(SELECT id, list_transform(range(0, 64), lambda i: trunc(greatest(0.0, least(1.0, "
        f"pixels[CAST((i % 4) * 16 + i // 4 + 1 AS BIGINT)] * CAST(({STD3})[CAST(i % 4 + 1 AS BIGINT)] AS DOUBLE) + CAST(({MEAN3})[CAST(i % 4 + 1 AS BIGINT)] AS DOUBLE))) * 255.0)) AS arr FROM images)",
        "id",
        "arr",
    )
)
def denormalize_to_uint8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return long_rows(images(spark, sf_dir), ["id"], A.denormalize_to_uint8(F.col("pixels"), MEAN, STD, 4, 4))


@query(f"WITH {IMAGES} " + sql_long("(SELECT id, list_transform(pixels, lambda x: (x - list_min(pixels)) / (list_max(pixels) - list_min(pixels))) AS arr FROM images)", "id", "arr"))
def minmax_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return long_rows(images(spark, sf_dir), ["id"], A.minmax_rows(F.col("pixels")))


@query(f"WITH {IMAGES} " + sql_long("(SELECT id, flatten([pixels[1:32], pixels[33:64]]) AS arr FROM images)", "id", "arr"))
def reshape_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    nested = F.array(F.slice("pixels", 1, 32), F.slice("pixels", 33, 32))
    return long_rows(images(spark, sf_dir), ["id"], A.reshape_rows(nested))


@query(f"WITH {IMAGES}, l AS (SELECT id, pixels AS v FROM images) " + sql_long("(SELECT id, list_transform(v, lambda x: exp(x - list_max(v)) / list_sum(list_transform(v, lambda y: exp(y - list_max(v))))) AS arr FROM l)", "id", "arr"))
def softmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return long_rows(images(spark, sf_dir), ["id"], A.softmax(F.col("pixels")))


@query(f"WITH {IMAGES} SELECT id, CAST(list_position(pixels, list_max(pixels)) - 1 AS BIGINT) AS place FROM images")
def argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return images(spark, sf_dir).select("id", A.argmax(F.col("pixels")).cast("long").alias("place"))


HALVES = "halves AS (SELECT id, label, pixels[1:32] AS a, pixels[33:64] AS b FROM images)"


def _halves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return images(spark, sf_dir).select("id", "label", F.slice("pixels", 1, 32).alias("a"), F.slice("pixels", 33, 32).alias("b"))


@query(f"WITH {IMAGES}, {HALVES} " + sql_long("(SELECT id, list_transform(range(1, 33), lambda i: (id % 5) / 4.0 * a[CAST(i AS BIGINT)] + (1.0 - (id % 5) / 4.0) * b[CAST(i AS BIGINT)]) AS arr FROM halves)", "id", "arr"))
def lerp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return long_rows(_halves(spark, sf_dir), ["id"], A.lerp(F.col("a"), F.col("b"), F.col("id") % 5 / 4.0))


@query(f"WITH {IMAGES} " + sql_long("(SELECT id, list_transform(pixels, lambda x: greatest(-0.1, least(0.1, x))) AS arr FROM images)", "id", "arr"))
def clip_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return long_rows(images(spark, sf_dir), ["id"], A.clip_array(F.col("pixels"), -0.1, 0.1))


@query(f"WITH {IMAGES} " + sql_long("(SELECT id, list_transform(range(0, 10), lambda i: CAST(i = label AS INTEGER)) AS arr FROM images)", "id", "arr"))
def one_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return long_rows(images(spark, sf_dir), ["id"], A.one_hot(F.col("label"), 10))


@query(f"WITH {IMAGES} " + sql_long("(SELECT id, list_transform(range(1, 65), lambda i: pixels[CAST(i AS BIGINT)] + exp(pixels[CAST(65 - i AS BIGINT)] * 0.5) * 2.0 * pixels[CAST(i AS BIGINT)]) AS arr FROM images)", "id", "arr"))
def reparameterize(spark: SparkSession, sf_dir: str) -> DataFrame:
    doubled = F.transform("pixels", lambda x: x * 2.0)
    return long_rows(images(spark, sf_dir), ["id"], A.reparameterize(F.col("pixels"), F.reverse("pixels"), doubled))


@query(f"WITH {IMAGES} SELECT id, CAST(i AS BIGINT) AS pos, round(pixels[i + 1] + exp(pixels[64 - i] * 0.5) * {normal_sql('21', 'id', 'i')}, 6) + 0.0 AS value FROM (SELECT *, unnest(range(0, 64)) AS i FROM images)")
def reparameterize_seeded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return long_rows(images(spark, sf_dir), ["id"], A.reparameterize(F.col("pixels"), F.reverse("pixels"), seed=21, key=F.col("id")))


@query(f"WITH {IMAGES} SELECT id, CAST(i AS BIGINT) AS pos, round(pixels[i + 1] + 0.1 * {normal_sql('4', 'id', 'i')}, 6) + 0.0 AS value FROM (SELECT *, unnest(range(0, 64)) AS i FROM images)")
def noise_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images with a tenth of their noise vector added; as many vectors as there are ids."""
    rows = images(spark, sf_dir)
    n = (rows.agg(F.max("id")).first()[0] or 0) + 1
    noisy = rows.join(augment.noise_table(spark, n, 64, seed=4), "id")
    return long_rows(noisy, ["id"], F.zip_with("pixels", "noise", lambda x, e: x + e * 0.1))


@query(
    """SELECT p_partkey, list_sort([{'d': (p_retailprice - c[1]) * (p_retailprice - c[1]), 'i': c[2], 'c': c[1]} FOR c IN [[900.0, 0], [1000.0, 1], [1200.0, 2], [1100.0, 3]]])[1].c + CAST(0 AS DOUBLE) AS nearest FROM part"""
)
def scalar_quantize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", A.scalar_quantize(F.col("p_retailprice"), (900.0, 1000.0, 1200.0, 1100.0)).alias("nearest"))


def _bump(x: str, a: float, b: float, c: float) -> str:
    return f"{a} * exp(-({x} - {b}) * ({x} - {b}) / (2 * {c} * {c}))"


X = "((pixels[i + 1] + 1.0) / 2.0)"


@query(
    f"""WITH {IMAGES} SELECT id, CAST(i AS BIGINT) AS pos, round(least(1.0, {_bump(X, 0.5, 0.6, 0.2)} + {_bump(X, 1.0, 0.8, 0.3)}), 6) + 0.0 AS r, round(least(1.0, {_bump(X, 1.0, 0.5, 0.3)}), 6) + 0.0 AS g,
round(least(1.0, {_bump(X, 1.0, 0.2, 0.3)}), 6) + 0.0 AS b FROM (SELECT *, unnest(range(0, 64)) AS i FROM images)"""
)
def heat_color(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = images(spark, sf_dir).select("id", F.posexplode("pixels").alias("pos", "x"))
    heat = A.heat_color((F.col("x") + 1.0) / 2.0)
    return rows.select("id", F.col("pos").cast("long").alias("pos"), heat.alias("h")).select("id", "pos", *[r6(F.col(f"h.{c}")).alias(c) for c in "rgb"])


@query(f"WITH {IMAGES} SELECT id, CAST(p AS BIGINT) AS pos, round((p // 8) / 7.0, 6) + 0.0 AS row, round((p % 8) / 7.0, 6) + 0.0 AS col FROM (SELECT id, unnest(range(0, 64)) AS p FROM images)")
def coordinate_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = images(spark, sf_dir).select("id", F.posexplode("pixels").alias("pos", "x"))
    at = A.coordinate(F.col("pos"), 8, 8)
    return rows.select("id", F.col("pos").cast("long").alias("pos"), r6(at["row"]).alias("row"), r6(at["col"]).alias("col"))


def _moment_sql(p: int, q: int) -> str:
    basis = " * ".join(["pixels[CAST(i + 1 AS BIGINT)]"] + ["((i % 8) / 7.0)"] * p + ["((i // 8) / 7.0)"] * q)
    return f"round(list_sum(list_transform(range(0, 64), lambda i: {basis})) / 64.0, 6) + 0.0"


@query(f"WITH {IMAGES} SELECT id, {_moment_sql(0, 0)} AS m00, {_moment_sql(1, 0)} AS m10, {_moment_sql(0, 1)} AS m01, {_moment_sql(1, 1)} AS m11, {_moment_sql(2, 0)} AS m20, {_moment_sql(0, 2)} AS m02 FROM images")
def geometric_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = [(0, 0), (1, 0), (0, 1), (1, 1), (2, 0), (0, 2)]
    return images(spark, sf_dir).select("id", *[r6(A.geometric_moment(F.col("pixels"), 8, 8, p, q)).alias(f"m{p}{q}") for p, q in orders])


@query(
    f"""WITH {IMAGES}, parts AS (SELECT id, c, pixels[c * 16 + 1 : c * 16 + 16] AS v FROM images, (SELECT unnest(range(0, 4)) AS c))
SELECT CAST(c AS BIGINT) AS channel, round(avg(list_avg(v)), 6) + 0.0 AS mean, round(avg(list_aggregate(v, 'stddev_samp')), 6) + 0.0 AS std FROM parts GROUP BY c"""
)
def channel_mean_std(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = metrics.channel_mean_std(images(spark, sf_dir), "pixels", 4, 16)
    return out.select(F.col("channel").cast("long").alias("channel"), r6(F.col("mean")).alias("mean"), r6(F.col("std")).alias("std"))


@query(
    f"""WITH {IMAGES}, x AS (SELECT p // 16 AS c, v FROM (SELECT unnest(pixels) AS v, unnest(range(0, 64)) AS p FROM images))
SELECT CAST(c AS BIGINT) AS channel, round(avg(v), 6) + 0.0 AS mean, round(stddev_samp(v), 6) + 0.0 AS std FROM x GROUP BY c"""
)
def channel_mean_std_pooled(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = metrics.channel_mean_std(images(spark, sf_dir), "pixels", 4, 16, pooled=True)
    return out.select(F.col("channel").cast("long").alias("channel"), r6(F.col("mean")).alias("mean"), r6(F.col("std")).alias("std"))


@query(
    f"WITH {IMAGES} SELECT round(min(list_min(pixels)), 6) + 0.0 AS min_value, round(max(list_max(pixels)), 6) + 0.0 AS max_value, CAST(min(len(pixels)) AS BIGINT) AS min_size, CAST(max(len(pixels)) AS BIGINT) AS max_size FROM images"
)
def tensor_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scoring.tensor_profile(images(spark, sf_dir), "pixels")
    return out.select(r6(F.col("min_value")).alias("min_value"), r6(F.col("max_value")).alias("max_value"), F.col("min_size").cast("long").alias("min_size"), F.col("max_size").cast("long").alias("max_size"))


@query("SELECT p_partkey, list_reduce(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), lambda a, b: a || ' ' || b) AS pretty FROM part")
def pretty_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", A.pretty_class(F.translate("p_name", " ", "_")).alias("pretty"))


@query(f"WITH {IMAGES}, {HALVES} SELECT id, round(list_sum(list_transform(range(1, 33), lambda i: (a[CAST(i AS BIGINT)] - b[CAST(i AS BIGINT)]) * (a[CAST(i AS BIGINT)] - b[CAST(i AS BIGINT)]))) / 32, 6) + 0.0 AS mse FROM halves")
def mse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _halves(spark, sf_dir).select("id", r6(L.mse(F.col("a"), F.col("b"))).alias("mse"))


@query(f"WITH {IMAGES}, l AS (SELECT id, label, pixels AS v FROM images) SELECT id, round(list_max(v) + ln(list_sum(list_transform(v, lambda x: exp(x - list_max(v))))) - v[label + 1], 6) + 0.0 AS loss FROM l")
def cross_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return images(spark, sf_dir).select("id", r6(L.cross_entropy(F.col("pixels"), F.col("label"))).alias("loss"))


BCE_SQL = "-(y * (CASE WHEN p <= 0 THEN -100 ELSE greatest(ln(CASE WHEN p > 0 THEN p ELSE 1 END), -100) END) + (1.0 - y) * (CASE WHEN 1.0 - p <= 0 THEN -100 ELSE greatest(ln(CASE WHEN 1.0 - p > 0 THEN 1.0 - p ELSE 1 END), -100) END))"


@query(f"SELECT l_orderkey, l_linenumber, l_partkey, round({BCE_SQL}, 6) + 0.0 AS bce FROM (SELECT *, l_discount * 10.0 AS p, l_linenumber % 2 AS y FROM lineitem)")
def bce(spark: SparkSession, sf_dir: str) -> DataFrame:
    loss = L.bce(F.col("l_discount") * 10.0, F.col("l_linenumber") % 2)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", r6(loss).alias("bce"))


@query(f"WITH {IMAGES}, {HALVES} SELECT id, round(-0.5 * list_sum(list_transform(range(1, 33), lambda i: 1.0 + b[CAST(i AS BIGINT)] - a[CAST(i AS BIGINT)] * a[CAST(i AS BIGINT)] - exp(b[CAST(i AS BIGINT)]))), 6) + 0.0 AS kl FROM halves")
def gaussian_kl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _halves(spark, sf_dir).select("id", r6(L.gaussian_kl(F.col("a"), F.col("b"))).alias("kl"))


@query("SELECT o_orderkey, round(o_totalprice / 1e6 + 0.25 * (o_orderkey % 7) + 0.5 * (o_custkey % 3), 6) + 0.0 AS total FROM orders")
def weighted_total_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    total = L.weighted_total_loss(F.col("o_totalprice") / 1e6, [(F.col("o_orderkey") % 7, 0.25), (F.col("o_custkey") % 3, 0.5)])
    return table(spark, sf_dir, "orders").select("o_orderkey", r6(total).alias("total"))


FLIP = "list_transform(range(0, 64), lambda i: pixels[CAST(i - i % 8 + 7 - i % 8 + 1 AS BIGINT)])"


@query(
    f"WITH {IMAGES} " + sql_long(f"(SELECT id, CASE WHEN substr({draw_sql('7', '2', 'id')}, 1, 8) < '{int(0.5 * 2**32):08x}' THEN {FLIP} ELSE pixels END AS arr FROM images)", "id", "arr")
)
def random_hflip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return long_rows(augment.random_hflip(images(spark, sf_dir), "id", "pixels", 1, 8, 8, 0.5, seed=7, epoch=2), ["id"], F.col("pixels"))


@query(
    f"WITH {IMAGES} "
    + sql_long(f"(SELECT id, CASE WHEN substr({draw_sql('3', '0', 'id')}, 1, 8) < '{int(0.3 * 2**32):08x}' THEN list_transform(pixels, lambda x: x * 2.0) ELSE pixels END AS arr FROM images)", "id", "arr")
)
def random_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    doubled = augment.random_apply(images(spark, sf_dir), "id", "pixels", 0.3, lambda a: F.transform(a, lambda x: x * 2.0), seed=3)
    return long_rows(doubled, ["id"], F.col("pixels"))


_Y, _XX = "(i // 6 + dy - 2)", "(i % 6 + dx - 2)"
CROP = f"CASE WHEN {_Y} >= 0 AND {_Y} < 8 AND {_XX} >= 0 AND {_XX} < 8 THEN pixels[CAST({_Y} * 8 + {_XX} + 1 AS BIGINT)] ELSE 0.0 END"
CROP_SQL = (
    f"WITH {IMAGES}, moved AS (SELECT id, pixels, {below_sql(7, '5', '1', 'id', chr(39) + 'y' + chr(39))} AS dy, {below_sql(7, '5', '1', 'id', chr(39) + 'x' + chr(39))} AS dx FROM images) "
    f"SELECT id, CAST(i AS BIGINT) AS pos, round({CROP}, 6) + 0.0 AS value FROM (SELECT *, unnest(range(0, 36)) AS i FROM moved)"
)


@query(CROP_SQL)
def random_crop_pad(spark: SparkSession, sf_dir: str) -> DataFrame:
    return long_rows(augment.random_crop_pad(images(spark, sf_dir), "id", "pixels", 1, 8, 8, 6, 2, seed=5, epoch=1), ["id"], F.col("pixels"))


@query(CROP_SQL)
def random_crop_pad_big(spark: SparkSession, sf_dir: str) -> DataFrame:
    return long_rows(augment.random_crop_pad(images(spark, sf_dir), "id", "pixels", 1, 8, 8, 6, 2, seed=5, epoch=1, big=True), ["id"], F.col("pixels"))


@query(f"WITH {IMAGES}, {HALVES}, g AS (SELECT label, sqrt(list_sum(list_transform(a, lambda x: x * x))) - 1.0 AS off FROM halves) SELECT CAST(label AS BIGINT) AS label, round(avg(off * off), 6) + 0.0 AS penalty FROM g GROUP BY label")
def gradient_norm_penalty(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = metrics.gradient_norm_penalty(_halves(spark, sf_dir), F.col("a"), ["label"])
    return out.select(F.col("label").cast("long").alias("label"), r6(F.col("penalty")).alias("penalty"))


SIG = "1.0 / (1.0 + exp(-{}))"


@query(
    f"""WITH {IMAGES}, {HALVES}, e AS (SELECT id % 10 AS batch, list_transform(range(1, 17), lambda i: {{'y': {SIG.format('a[CAST(i AS BIGINT)]')}, 'p': {SIG.format('b[CAST(i AS BIGINT)]')}}}) AS z,
  list_transform(range(17, 33), lambda i: 1.0 + b[CAST(i AS BIGINT)] - a[CAST(i AS BIGINT)] * a[CAST(i AS BIGINT)] - exp(b[CAST(i AS BIGINT)])) AS k FROM halves),
s AS (SELECT batch, list_sum(list_transform(z, lambda t: -(t.y * ln(t.p) + (1.0 - t.y) * ln(1.0 - t.p)))) AS r, -0.5 * list_sum(k) AS k FROM e)
SELECT batch, round(sum(r), 4) + 0.0 AS recon_loss, round(sum(k), 4) + 0.0 AS kl_loss, round(sum(r) + sum(k), 4) + 0.0 AS loss FROM s GROUP BY batch"""
)
def vae_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    def squash(arr):
        return F.transform(arr, lambda x: F.lit(1.0) / (F.lit(1.0) + F.exp(-x)))

    df = _halves(spark, sf_dir).withColumn("batch", F.col("id") % 10)
    x, x_hat = squash(F.slice("a", 1, 16)), squash(F.slice("b", 1, 16))
    out = metrics.vae_losses(df, "batch", x, x_hat, F.slice("a", 17, 16), F.slice("b", 17, 16))
    return out.select("batch", *[r6(F.col(c), 4).alias(c) for c in ("recon_loss", "kl_loss", "loss")])
