"""Queries of run logs: events as the batches of runs, orders as trials."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trainkit.operators import runs as R
from trainkit.operators import split
from trainkit.plans.base import BATCH_METRICS, batch_metrics, new_folder, query, r6, table
from trainkit.sources import logs

EPOCH = "PARTITION BY run, epoch ORDER BY ts"
SO_FAR = f"({EPOCH} ROWS UNBOUNDED PRECEDING)"


@query(
    f"""WITH {BATCH_METRICS} SELECT step, round(sum(loss * n) OVER w, 4) + 0.0 AS run_sum, CAST(sum(n) OVER w AS BIGINT) AS run_count,
round(CASE WHEN sum(n) OVER w <> 0 THEN sum(loss * n) OVER w / sum(n) OVER w END, 6) + 0.0 AS run_avg FROM batch_metrics WINDOW w AS {SO_FAR}"""
)
def running_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = R.running_average(batch_metrics(spark, sf_dir), ["run", "epoch"], ["ts"], "loss", "n")
    return out.select("step", r6(F.col("run_sum"), 4).alias("run_sum"), "run_count", r6(F.col("run_avg")).alias("run_avg"))


@query(
    f"""WITH {BATCH_METRICS}, c AS (SELECT *, CASE WHEN loss > 10 THEN n ELSE 0 END AS correct FROM batch_metrics)
SELECT step, round(CASE WHEN sum(n) OVER w <> 0 THEN 100.0 * sum(correct) OVER w / sum(n) OVER w END, 6) + 0.0 AS run_accuracy FROM c WINDOW w AS {SO_FAR}"""
)
def running_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = batch_metrics(spark, sf_dir).withColumn("correct", F.when(F.col("loss") > 10, F.col("n")).otherwise(0))
    out = R.running_accuracy(rows, ["run", "epoch"], ["ts"], "correct", "n")
    return out.select("step", r6(F.col("run_accuracy")).alias("run_accuracy"))


@query(
    """WITH p AS (SELECT o_orderkey, o_totalprice, greatest(0.0, coalesce(max(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0)) AS before FROM orders)
SELECT o_orderkey, o_totalprice > before AS is_best, greatest(before, o_totalprice) AS best FROM p"""
)
def best_so_far(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.best_so_far(table(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], "o_totalprice").select("o_orderkey", "is_best", "best")


SECONDS = "epoch_us(ts) / 1e6"


@query(
    f"""WITH {BATCH_METRICS}, s AS (SELECT *, {SECONDS} AS s FROM batch_metrics), d AS (SELECT *, s - lag(s) OVER (PARTITION BY run ORDER BY ts) AS step_s FROM s)
SELECT step, round(step_s, 4) + 0.0 AS step_s, round(avg(step_s) OVER (PARTITION BY run ORDER BY ts ROWS UNBOUNDED PRECEDING), 4) + 0.0 AS avg_step_s FROM d"""
)
def step_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = R.step_times(batch_metrics(spark, sf_dir), ["run"], "ts")
    return out.select("step", r6(F.col("step_s"), 4).alias("step_s"), r6(F.col("avg_step_s"), 4).alias("avg_step_s"))


@query(
    f"""WITH {BATCH_METRICS}, s AS (SELECT *, {SECONDS} AS s FROM batch_metrics), d AS (SELECT *, CASE WHEN n > 0 THEN (s - lag(s) OVER (PARTITION BY run ORDER BY ts)) / n END AS item_s FROM s)
SELECT step, round(item_s, 4) + 0.0 AS item_s, round(avg(item_s) OVER (PARTITION BY run ORDER BY ts ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), 4) + 0.0 AS sma_s FROM d"""
)
def throughput_sma(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The lag looks at all rows of the run, also those of weight 0.
    out = R.throughput_sma(batch_metrics(spark, sf_dir), ["run"], "ts", "n")
    return out.select("step", r6(F.col("item_s"), 4).alias("item_s"), r6(F.col("sma_s"), 4).alias("sma_s"))


@query(
    f"""WITH {BATCH_METRICS}, s AS (SELECT *, {SECONDS} AS s, epoch_us(ts) AS us FROM batch_metrics), d AS (SELECT *, s - lag(s) OVER (PARTITION BY run ORDER BY ts) AS gap FROM s),
a AS (SELECT *, avg(gap) OVER (PARTITION BY run ORDER BY ts ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS sma, row_number() OVER (PARTITION BY run ORDER BY ts) AS k, first(us) OVER (PARTITION BY run ORDER BY ts) AS started FROM d)
SELECT step AS event, k AS step, round(least(1.0, k / 100.0), 6) + 0.0 AS progress, round(least(1.0, k / 100.0) * 100.0, 6) + 0.0 AS percent, greatest(100 - k, 0) AS remaining,
  CAST(ceil(round(coalesce(sma, 0.0) * greatest(100 - k, 0), 3)) AS BIGINT) AS eta_s, CAST(floor((us - started) / 1e6) AS BIGINT) AS elapsed_s FROM a"""
)
def progress_eta(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = batch_metrics(spark, sf_dir).withColumnRenamed("step", "event")
    out = R.progress_eta(rows, ["run"], "ts", 100)
    eta = F.ceil(F.round(F.coalesce("sma_s", F.lit(0.0)) * F.col("remaining"), 3)).cast("long")  # both engines' sums differ in the last bits
    return out.select("event", "step", r6(F.col("progress")).alias("progress"), r6(F.col("percent")).alias("percent"), "remaining", eta.alias("eta_s"), "elapsed_s")


@query("SELECT l_suppkey, round(CASE WHEN sum(l_quantity) <> 0 THEN sum(l_extendedprice * l_quantity) / sum(l_quantity) END, 4) + 0.0 AS mean FROM lineitem GROUP BY l_suppkey")
def weighted_epoch_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = R.weighted_epoch_means(table(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_extendedprice", "l_quantity")
    return out.select("l_suppkey", r6(F.col("mean"), 4).alias("mean"))


@query(f"WITH {BATCH_METRICS} SELECT run, epoch, round(avg(loss), 6) + 0.0 AS loss, round(avg(n), 6) + 0.0 AS n FROM batch_metrics GROUP BY run, epoch")
def epoch_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = R.epoch_means(batch_metrics(spark, sf_dir), ["run", "epoch"], ["loss", "n"])
    return out.select("run", "epoch", r6(F.col("loss")).alias("loss"), r6(F.col("n")).alias("n"))


@query(f"WITH {BATCH_METRICS} SELECT run, epoch, step // 5 AS step, round(avg(loss), 6) + 0.0 AS loss FROM batch_metrics GROUP BY run, epoch, step // 5")
def critic_iteration_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = batch_metrics(spark, sf_dir).withColumn("step", F.floor(F.col("step") / 5))
    return R.critic_iteration_means(rows, ["loss"]).withColumn("loss", r6(F.col("loss")))


@query(
    f"""WITH {BATCH_METRICS}, c AS (SELECT run, epoch, avg(loss) AS critic_loss FROM batch_metrics WHERE tag = 'click' GROUP BY run, epoch), g AS (SELECT run, epoch, avg(loss) AS generator_loss FROM batch_metrics WHERE tag <> 'click' GROUP BY run, epoch)
SELECT run, epoch, round(critic_loss, 6) + 0.0 AS critic_loss, round(generator_loss, 6) + 0.0 AS generator_loss FROM c JOIN g USING (run, epoch)"""
)
def combine_step_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, keys = batch_metrics(spark, sf_dir), ["run", "epoch"]
    critic = R.epoch_means(rows.where("tag = 'click'"), keys, ["loss"]).withColumn("critic_loss", r6(F.col("loss"))).drop("loss")
    generator = R.epoch_means(rows.where("tag <> 'click'"), keys, ["loss"]).withColumn("generator_loss", r6(F.col("loss"))).drop("loss")
    return R.combine_step_metrics(critic, generator, keys)


TRIALS = "t AS (SELECT o_orderkey % 3125 AS trial, o_custkey % 5 AS epoch, o_totalprice AS loss FROM orders)"
PER_EPOCH = "e AS (SELECT trial, epoch, sum(loss) AS s, count(*) AS b FROM t GROUP BY trial, epoch)"


def _trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 3125).alias("trial"), (F.col("o_custkey") % 5).alias("epoch"), F.col("o_totalprice").alias("loss"))


@query(f"WITH {TRIALS}, {PER_EPOCH} SELECT trial, round(sum(s) / max(b), 4) + 0.0 AS loss FROM e GROUP BY trial")
def trial_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.trial_loss(_trials(spark, sf_dir), "trial", "epoch", "loss").withColumn("loss", r6(F.col("loss"), 4))


@query(f"WITH {TRIALS}, {PER_EPOCH} SELECT trial, round(sum(s) / max(b) / count(*), 4) + 0.0 AS loss FROM e GROUP BY trial")
def trial_loss_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.trial_loss(_trials(spark, sf_dir), "trial", "epoch", "loss", "mean").withColumn("loss", r6(F.col("loss"), 4))


GRID = {"epochs": [10, 20, 30, 40, 50], "batch_size": [16, 32, 64, 128, 256], "lr": [1e-4, 5e-4, 1e-3, 5e-3, 1e-2], "hidden_dim": [100, 200, 300, 400, 500], "latent_dim": [2, 8, 16, 32, 64]}
GRID_SQL = """grid AS (SELECT trial_id, [10, 20, 30, 40, 50][trial_id // 625 + 1] AS epochs, [16, 32, 64, 128, 256][trial_id // 125 % 5 + 1] AS batch_size,
  [0.0001, 0.0005, 0.001, 0.005, 0.01][trial_id // 25 % 5 + 1] + CAST(0 AS DOUBLE) AS lr, [100, 200, 300, 400, 500][trial_id // 5 % 5 + 1] AS hidden_dim, [2, 8, 16, 32, 64][trial_id % 5 + 1] AS latent_dim
  FROM (SELECT unnest(range(0, 3125)) AS trial_id))"""
GRID_OUT = "CAST(epochs AS INTEGER) AS epochs, CAST(batch_size AS INTEGER) AS batch_size, lr, CAST(hidden_dim AS INTEGER) AS hidden_dim, CAST(latent_dim AS INTEGER) AS latent_dim"


@query(f"WITH {TRIALS}, {PER_EPOCH}, l AS (SELECT trial, sum(s) / max(b) AS loss FROM e GROUP BY trial), {GRID_SQL} SELECT trial_id, {GRID_OUT}, round(loss, 4) + 0.0 AS loss FROM grid JOIN l ON l.trial = trial_id")
def hyperparameter_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The grid joined to the losses of its trials."""
    losses = R.trial_loss(_trials(spark, sf_dir), "trial", "epoch", "loss").withColumnRenamed("trial", "trial_id")
    return R.hyperparameter_grid(spark, **GRID).join(losses, "trial_id").withColumn("loss", r6(F.col("loss"), 4))


@query(
    f"WITH {TRIALS}, {PER_EPOCH}, l AS (SELECT trial, round(sum(s) / max(b), 4) + 0.0 AS loss FROM e GROUP BY trial), {GRID_SQL} SELECT trial_id, loss, {GRID_OUT} FROM grid JOIN l ON l.trial = trial_id ORDER BY loss, trial_id LIMIT 1"
)
def best_trial(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.best_trial(hyperparameter_grid(spark, sf_dir), "trial_id", "loss", list(GRID))


@query(
    f"""WITH {BATCH_METRICS}, m AS (SELECT run, epoch, round(avg(loss), 6) AS acc FROM batch_metrics GROUP BY run, epoch)
SELECT run, max(acc) + 0.0 AS best, CAST(first(epoch ORDER BY acc DESC, epoch) AS BIGINT) AS best_epoch FROM m GROUP BY run"""
)
def best_epoch(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = R.epoch_means(batch_metrics(spark, sf_dir), ["run", "epoch"], ["loss"]).withColumn("acc", r6(F.col("loss")))
    return R.best_epoch(means, ["run"], "acc", "epoch").select("run", "best", F.col("best_epoch").cast("long").alias("best_epoch"))


@query(
    f"""WITH {BATCH_METRICS}, m AS (SELECT run, avg(loss) AS loss, avg(n) AS n, count(*) AS k FROM batch_metrics GROUP BY run), e AS (SELECT row_number() OVER (ORDER BY run) AS epoch, * FROM m)
SELECT epoch, round(1.0 / epoch, 6) + 0.0 AS lr, round(loss, 6) + 0.0 AS train_loss, round(n, 6) + 0.0 AS valid_loss, k + CAST(0 AS DOUBLE) AS train_acc FROM e"""
)
def run_log_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means per run as the epochs of a log: written as text, and read back."""
    means = batch_metrics(spark, sf_dir).groupBy("run").agg(F.avg("loss").alias("train_loss"), F.avg("n").alias("valid_loss"), F.count("*").alias("train_acc"))
    numbered = split.numbered(means, [], [F.col("run")], F.floor(F.col("run") / 64), "epoch")
    path = new_folder(spark)
    logs.write_run_log(numbered.withColumn("lr", 1.0 / F.col("epoch")).withColumn("valid_acc", F.col("train_acc")), path)
    back = logs.read_run_log(spark, path)
    return back.select(F.col("epoch").cast("long").alias("epoch"), *[r6(F.col(c)).alias(c) for c in ("lr", "train_loss", "valid_loss", "train_acc")])


@query(
    f"""WITH {BATCH_METRICS}, m AS (SELECT tag, epoch, round(avg(loss), 6) + 0.0 AS loss, round(avg(n), 6) + 0.0 AS n FROM batch_metrics WHERE tag IS NOT NULL GROUP BY tag, epoch)
SELECT tag || '(loss)' AS series, epoch, loss AS value FROM m UNION ALL SELECT tag || '(n)', epoch, n FROM m"""
)
def union_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log per event type, all of them side by side."""
    means = R.epoch_means(batch_metrics(spark, sf_dir), ["tag", "epoch"], ["loss", "n"])
    means = means.withColumns({c: r6(F.col(c)) for c in ("loss", "n")})
    tags = [r.tag for r in batch_metrics(spark, sf_dir).where("tag IS NOT NULL").select("tag").distinct().collect()]  # a handful of types
    return R.union_runs({tag: means.where(F.col("tag") == tag) for tag in tags}, "epoch", ["loss", "n"])


@query(
    f"""WITH {BATCH_METRICS}, m AS (SELECT run * 4 + epoch AS step, round(avg(loss), 6) + 0.0 AS loss, round(avg(n), 6) + 0.0 AS n FROM batch_metrics GROUP BY run, epoch)
SELECT 'gan_events/loss' AS tag, step, loss AS value FROM m UNION ALL SELECT 'gan_events/n', step, n FROM m"""
)
def scalar_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = R.epoch_means(batch_metrics(spark, sf_dir), ["run", "epoch"], ["loss", "n"]).withColumns({"step": F.col("run") * 4 + F.col("epoch")})
    return R.scalar_log(means.withColumns({c: r6(F.col(c)) for c in ("loss", "n")}), "gan", "events", "step", ["loss", "n"])
