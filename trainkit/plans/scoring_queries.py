"""Queries of scoring and evaluation: embeddings are scored by the class means of the training split."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trainkit.functions import arrays as A
from trainkit.operators import metrics as M
from trainkit.operators import scoring as S
from trainkit.operators import split as P
from trainkit.plans.base import IMAGES, draw_sql, images, long_rows, new_folder, query, r6, table
from trainkit.sources import logs
from trainkit.sources.tables import written

CLASSES = 10
SPLIT = f"""split AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY label ORDER BY {draw_sql('42', 'id')}, id) <= floor(count(*) OVER (PARTITION BY label) * CAST(0.8 AS DOUBLE)) THEN 'train' ELSE 'test' END AS split FROM images)"""
LOGITS = f"""means AS (SELECT label, i, avg(v) AS m FROM (SELECT label, unnest(range(1, 65)) AS i, unnest(pixels) AS v FROM split WHERE split = 'train') GROUP BY label, i),
mean AS (SELECT label, list(m ORDER BY i) AS mean FROM means GROUP BY label),
one AS (SELECT s.id, s.label, mean.label AS class, 2.0 * list_sum(list_transform(range(1, 65), lambda i: s.pixels[CAST(i AS BIGINT)] * mean.mean[CAST(i AS BIGINT)])) - list_sum(list_transform(mean.mean, lambda x: x * x)) AS logit
  FROM split s, mean WHERE s.split = 'test'),
scored AS (SELECT id, label, list(logit ORDER BY class) AS logits FROM one GROUP BY id, label)"""
WITH_LOGITS = f"WITH {IMAGES}, {SPLIT}, {LOGITS}"
#: Softmax confidence, rank of the label and predicted class.
CONFIDENCE = "1.0 / list_sum(list_transform(logits, lambda x: exp(x - list_max(logits))))"
RANK = "1 + len(list_filter(range(0, 10), lambda i: logits[CAST(i + 1 AS BIGINT)] > logits[label + 1] OR (logits[CAST(i + 1 AS BIGINT)] = logits[label + 1] AND i < label)))"
PREDICTED = "list_position(logits, list_max(logits)) - 1"


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, label, logits) of the test split, scored by class means of the training split."""
    rows = written(P.stratified_split(images(spark, sf_dir), "label", "id", 0.8, "hash", 42))  # read by both sides
    means = S.class_means(rows.where("split = 'train'"), "pixels", "label", 64)
    layers = S.nearest_mean_layers(means, "label", CLASSES)
    return S.score_dense(rows.where("split = 'test'"), layers, "pixels").select("id", "label", "logits")


@query(f"{WITH_LOGITS} SELECT CAST(label AS BIGINT) AS label, CAST(sum(CASE WHEN {PREDICTED} = label THEN 1 ELSE 0 END) AS BIGINT) AS correct, count(*) AS total, "
       f"round(100.0 * sum(CASE WHEN {PREDICTED} = label THEN 1 ELSE 0 END) / count(*), 6) + 0.0 AS accuracy FROM scored GROUP BY label")  # fmt: skip
def w1_split_score_evaluate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship job: split, score, predict, accuracy per class."""
    out = S.per_class_accuracy(S.predict_columns(scored(spark, sf_dir)))
    return out.select(F.col("label").cast("long").alias("label"), "correct", "total", r6(F.col("accuracy")).alias("accuracy"))


@query(f"{WITH_LOGITS} SELECT CAST(label AS BIGINT) AS label, CAST(sum(CASE WHEN {PREDICTED} = label THEN 1 ELSE 0 END) AS BIGINT) AS correct, count(*) AS total FROM scored GROUP BY label")
def per_class_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = S.per_class_accuracy(S.predict_columns(scored(spark, sf_dir)))
    return out.select(F.col("label").cast("long").alias("label"), "correct", "total")


@query(
    f"""{WITH_LOGITS}, p AS (SELECT *, row_number() OVER (ORDER BY {draw_sql('0', '0', 'id')}, id) - 1 AS place FROM scored)
SELECT CAST(0 AS BIGINT) AS epoch, place // 16 AS batch_idx, place % 16 AS image_idx, CAST(label AS BIGINT) AS true_label, CAST({PREDICTED} AS BIGINT) AS predicted_label FROM p"""
)
def write_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All predictions written by epoch, and read back."""
    path = new_folder(spark)
    rows = S.predict_columns(P.batch_rows(scored(spark, sf_dir), "id", 16)).withColumnRenamed("label", "true_label").withColumn("epoch", F.lit(0))
    logs.write_predictions(rows, path)
    return spark.read.parquet(path).select(*[F.col(c).cast("long").alias(c) for c in ("epoch", "batch_idx", "image_idx", "true_label", "predicted_label")])


@query(f"{WITH_LOGITS} SELECT id, CAST(i - 1 AS BIGINT) AS pos, round(logits[i], 6) + 0.0 AS value FROM (SELECT *, unnest(range(1, 11)) AS i FROM scored)")
def score_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    return long_rows(scored(spark, sf_dir), ["id"], F.col("logits"))


@query(f"{WITH_LOGITS} SELECT id, CAST({PREDICTED} AS BIGINT) AS predicted_label, round({CONFIDENCE}, 6) + 0.0 AS confidence FROM scored")
def predict_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = S.predict_columns(scored(spark, sf_dir))
    return out.select("id", F.col("predicted_label").cast("long").alias("predicted_label"), r6(F.col("confidence")).alias("confidence"))


@query(f"{WITH_LOGITS} SELECT round(avg(CASE WHEN {RANK} <= 1 THEN 100.0 ELSE 0.0 END), 6) + 0.0 AS top1, round(avg(CASE WHEN {RANK} <= 5 THEN 100.0 ELSE 0.0 END), 6) + 0.0 AS top5 FROM scored")
def topk_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = S.topk_accuracy(scored(spark, sf_dir), ks=(1, 5))
    return out.select(r6(F.col("top1")).alias("top1"), r6(F.col("top5")).alias("top5"))


@query(
    f"""{WITH_LOGITS}, e AS (SELECT id, unnest(range(0, 10)) AS class, unnest(logits) AS logit FROM scored),
r AS (SELECT id, class, logit, row_number() OVER (PARTITION BY id ORDER BY logit DESC, class) AS place FROM e)
SELECT id, place - 1 AS place, class, round(logit, 6) + 0.0 AS logit FROM r WHERE place <= 3"""
)
def topk_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = scored(spark, sf_dir).select("id", F.posexplode(A.topk_classes(F.col("logits"), 3)).alias("place", "b"))
    return best.select("id", F.col("place").cast("long").alias("place"), F.col("b.class").cast("long").alias("class"), r6(F.col("b.logit")).alias("logit"))


@query(
    f"{WITH_LOGITS} SELECT round(avg(list_max(logits) + ln(list_sum(list_transform(logits, lambda x: exp(x - list_max(logits))))) - logits[label + 1]), 6) + 0.0 AS loss, "
    f"round(100.0 * sum(CASE WHEN {PREDICTED} = label THEN 1.0 ELSE 0.0 END) / count(*), 6) + 0.0 AS accuracy FROM scored"
)
def classification_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = S.classification_loss(scored(spark, sf_dir))
    return out.select(r6(F.col("loss")).alias("loss"), r6(F.col("accuracy")).alias("accuracy"))


@query(
    f"{WITH_LOGITS}, c AS (SELECT label, sum(CASE WHEN {PREDICTED} = label THEN 1 ELSE 0 END) AS correct, count(*) AS total FROM scored GROUP BY label) "
    "SELECT n_name, CAST(correct AS BIGINT) AS correct, total FROM nation LEFT JOIN c ON c.label = n_nationkey"
)
def name_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("label"), "n_name")
    found = S.per_class_accuracy(S.predict_columns(scored(spark, sf_dir)))
    return S.name_classes(found, classes).select("n_name", "correct", "total")


@query(
    f"""WITH {IMAGES}, w AS (SELECT id AS unit, pixels AS w FROM images WHERE id < 10),
one AS (SELECT i.id, i.label, w.unit, 1.0 / (1.0 + exp(-(list_sum(list_transform(range(1, 65), lambda k: w.w[CAST(k AS BIGINT)] * i.pixels[CAST(k AS BIGINT)])) + 0.01 * w.unit))) AS v FROM images i, w),
scored AS (SELECT id, label, list(v ORDER BY unit) AS logits FROM one GROUP BY id, label)
SELECT round(avg(list_max(logits) + ln(list_sum(list_transform(logits, lambda x: exp(x - list_max(logits))))) - logits[label + 1]), 6) + 0.0 AS loss,
  round(100.0 * sum(CASE WHEN {PREDICTED} = label THEN 1.0 ELSE 0.0 END) / count(*), 6) + 0.0 AS accuracy FROM scored"""
)
def evaluate_saved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A weights table made of the first ten vectors, with a sigmoid."""
    rows = images(spark, sf_dir).withColumn("x", F.col("pixels"))
    weights = rows.where("id < 10").select(
        F.lit(0).alias("layer"), F.col("id").alias("unit"), F.col("x").alias("w"), (F.col("id") * 0.01).alias("b"), F.lit("sigmoid").alias("activation")
    )
    out, _ = S.evaluate_saved(rows, weights, "x")
    return out.select(r6(F.col("loss")).alias("loss"), r6(F.col("accuracy")).alias("accuracy"))


@query("SELECT event_id, greatest(0, least(user_id - 5, 99)) AS user_id FROM events")
def sane_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", (F.col("user_id") - 5).alias("user_id"))
    return S.sane_labels(rows, "user_id", 100)


@query(
    """WITH g AS (SELECT conv_id % 32 AS batch, conv_id, conv_id % 16 % 5 AS label, count(*) FILTER (WHERE turn > 2) AS n FROM conversations GROUP BY conv_id)
SELECT batch, count(*) FILTER (WHERE n > 0) AS good, count(*) FILTER (WHERE n = 0) AS empty, count(DISTINCT CASE WHEN n > 0 THEN n END) <= 1 AS same_size,
  string_agg(DISTINCT CAST(label AS VARCHAR), ',' ORDER BY CAST(label AS VARCHAR)) AS labels, min(label) AS min_label, max(label) AS max_label FROM g GROUP BY batch"""
)
def batch_qa(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    rows = turns.groupBy("conv_id").agg(F.collect_list(F.when(F.col("turn") > 2, F.col("turn"))).alias("frames"))
    rows = rows.withColumn("batch", F.col("conv_id") % 32).withColumn("label", F.col("conv_id") % 16 % 5)
    out = S.batch_qa(rows, "batch", "frames", "label")
    return out.withColumn("labels", F.array_join(F.transform("labels", lambda x: x.cast("string")), ","))


@query(
    f"""{WITH_LOGITS}, p AS (SELECT *, row_number() OVER (ORDER BY {draw_sql('0', '0', 'id')}, id) - 1 AS place FROM scored)
SELECT place // 16 AS batch_idx, place % 16 AS image_idx, CAST(label AS BIGINT) AS true_label, CAST({PREDICTED} AS BIGINT) AS predicted_label FROM p WHERE place // 16 < 4"""
)
def prediction_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    batched = P.first_batches(P.batch_rows(scored(spark, sf_dir), "id", 16), 4)
    out = S.predict_columns(batched).withColumnRenamed("label", "true_label")
    return out.select(*[F.col(c).cast("long").alias(c) for c in ("batch_idx", "image_idx", "true_label", "predicted_label")])


SCORES = "scores AS (SELECT d.doc_id, l.quality = 1 AS is_real, d.n_chars / (d.n_chars + 1000.0) AS p, d.lang FROM documents d JOIN labels l USING (doc_id))"


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", (F.col("n_chars") / (F.col("n_chars") + 1000.0)).alias("p"))
    return docs.join(table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 1).alias("is_real")), "doc_id")


@query(
    f"""WITH {SCORES} SELECT lang, round(avg(p) FILTER (WHERE is_real), 6) + 0.0 AS real_score, round(avg(p) FILTER (WHERE NOT is_real), 6) + 0.0 AS fake_score,
round(avg(p) FILTER (WHERE is_real) - avg(p) FILTER (WHERE NOT is_real), 6) + 0.0 AS distance, round(avg(p) FILTER (WHERE NOT is_real) - avg(p) FILTER (WHERE is_real), 6) + 0.0 AS critic_loss FROM scores GROUP BY lang"""
)
def real_fake_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = M.real_fake_scores(_scores(spark, sf_dir), F.col("p"), F.col("is_real"), ["lang"])
    return out.select("lang", *[r6(F.col(c)).alias(c) for c in ("real_score", "fake_score", "distance", "critic_loss")])


@query(
    f"""WITH {SCORES} SELECT round(avg(-ln(p)) FILTER (WHERE is_real), 6) + 0.0 AS real_loss, round(avg(-ln(1.0 - p)) FILTER (WHERE NOT is_real), 6) + 0.0 AS fake_loss,
round(avg(-ln(p)) FILTER (WHERE is_real) + avg(-ln(1.0 - p)) FILTER (WHERE NOT is_real), 6) + 0.0 AS d_loss, round(avg(-ln(p)) FILTER (WHERE NOT is_real), 6) + 0.0 AS g_loss FROM scores"""
)
def discriminator_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = M.discriminator_loss(_scores(spark, sf_dir), F.col("p"), F.col("is_real"))
    return out.select(*[r6(F.col(c)).alias(c) for c in ("real_loss", "fake_loss", "d_loss", "g_loss")])


@query(f"WITH {SCORES} SELECT doc_id, CASE WHEN is_real THEN 1.0 ELSE 0.0 END + CAST(0 AS DOUBLE) AS target FROM scores")
def real_fake_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _scores(spark, sf_dir)
    return M.real_fake_union(rows.where("is_real").select("doc_id"), rows.where("NOT is_real").select("doc_id"))
