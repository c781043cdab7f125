"""Aggregated losses of generative models and image statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trainkit.functions.arrays import channel_stat, norm
from trainkit.functions.losses import bce, bce_sum, gaussian_kl


def channel_mean_std(df: DataFrame, arr_col: str, channels: int, pixels: int, pooled: bool = False) -> DataFrame:
    """(channel, mean, std): means over images of each image's channel mean and sample deviation.

    `pooled`: the deviation of all pixels of the channel instead.  Images are reduced row by row, so only a few
    numbers per task are shuffled.
    """
    arr = F.col(arr_col)
    stats = [channel_stat(arr, c, pixels) for c in range(channels)]
    rows = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("channel"), m.alias("m"), s.alias("s")) for c, (m, s) in enumerate(stats)])).alias("x")).select("x.*")
    if not pooled:
        return rows.groupBy("channel").agg(F.avg("m").alias("mean"), F.avg("s").alias("std"))
    # Sums of squares around the images' means, then around the overall mean.
    inside = F.sum(F.col("s") * F.col("s") * (pixels - 1))
    between = (F.count("m") - 1) * F.coalesce(F.var_samp("m"), F.lit(0.0)) * pixels
    return rows.groupBy("channel").agg(F.avg("m").alias("mean"), F.sqrt((inside + between) / (F.count("m") * pixels - 1)).alias("std"))


def real_fake_scores(df: DataFrame, score: Column, is_real: Column, keys: list[str] | None = None) -> DataFrame:
    """Mean critic score on real and on fake rows, their distance (real - fake) and the critic's loss (fake - real)."""
    real, fake = F.avg(F.when(is_real, score)), F.avg(F.when(~is_real, score))
    return df.groupBy(*(keys or [])).agg(real.alias("real_score"), fake.alias("fake_score"), (real - fake).alias("distance"), (fake - real).alias("critic_loss"))


def discriminator_loss(df: DataFrame, p: Column, is_real: Column, keys: list[str] | None = None) -> DataFrame:
    """BCE(real, 1) + BCE(fake, 0) as d_loss, BCE(fake, 1) as g_loss; each is a mean."""
    on_real = F.avg(F.when(is_real, bce(p, F.lit(1.0))))
    on_fake = F.avg(F.when(~is_real, bce(p, F.lit(0.0))))
    return df.groupBy(*(keys or [])).agg(on_real.alias("real_loss"), on_fake.alias("fake_loss"), (on_real + on_fake).alias("d_loss"), F.avg(F.when(~is_real, bce(p, F.lit(1.0)))).alias("g_loss"))


def real_fake_union(real: DataFrame, fake: DataFrame) -> DataFrame:
    """Real rows with target 1, generated rows with target 0."""
    return real.withColumn("target", F.lit(1.0)).unionByName(fake.withColumn("target", F.lit(0.0)))


def vae_losses(df: DataFrame, batch_col: str, x: Column, x_hat: Column, mu: Column, logvar: Column) -> DataFrame:
    """Per batch: summed reconstruction BCE, summed gaussian KL, and their sum."""
    recon, kl = F.sum(bce_sum(x_hat, x)), F.sum(gaussian_kl(mu, logvar))
    return df.groupBy(batch_col).agg(recon.alias("recon_loss"), kl.alias("kl_loss"), (recon + kl).alias("loss"))


def gradient_norm_penalty(df: DataFrame, vec: Column, keys: list[str] | None = None) -> DataFrame:
    """Mean of (L2 norm - 1)^2 over row vectors."""
    off = norm(vec) - 1.0
    return df.groupBy(*(keys or [])).agg(F.avg(off * off).alias("penalty"))
