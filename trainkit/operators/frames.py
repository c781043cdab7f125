"""Frames of videos: choosing, resampling and labelling. A frame row has a video, an index and a payload.

Payloads are never sorted: places are found among light (video, index) rows, and payloads join last.  Where a video has
more than `video_rows` frames, frames are counted per range of the index, the wanted places are looked up in the counts,
and only the ranges that hold one are numbered, so no task holds a video.  A null video is a video to `head_frames` only; elsewhere its
frames, like those without an index, are chosen by nothing.  Frames are taken to be unique by video and index.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trainkit.functions.draws import draw
from trainkit.functions.names import free_names
from trainkit.operators import split

VIDEO_ROWS = 1_000_000  # frames of a video that one task may hold as light rows
RANGES_A_VIDEO = 4  # ranges that VIDEO_ROWS frames are cut into


def head_frames(frames: DataFrame, k: int, video: str = "video_id", index: str = "frame_idx") -> DataFrame:
    """The first k frames of each video; Spark keeps k rows per video before the shuffle."""
    (_place,) = free_names(frames.columns, "_place")
    place = F.row_number().over(Window.partitionBy(video).orderBy(index))
    return frames.withColumn(_place, place).where(F.col(_place) <= k).drop(_place)


def frames_at(frames: DataFrame, wanted: DataFrame, lengths: DataFrame, video: str, index: str, video_rows: int) -> DataFrame:
    """(video, slot, index): the index at the 0-based `place` of every row (video, slot, place) of `wanted`.

    `lengths` has n_frames by video and tells whether any video has to be cut.
    """
    light = frames.select(video, index).where(F.col(video).isNotNull() & F.col(index).isNotNull())
    if lengths.where(F.col("n_frames") > video_rows).isEmpty():
        by_video = Window.partitionBy(video).orderBy(index)
        return light.withColumn("place", F.row_number().over(by_video) - 1).join(wanted, [video, "place"]).select(video, "slot", index)
    rows = light.count()
    cut = light.withColumn("range", split.order_bucket(light, [index], split.buckets_for(rows, max(1, video_rows // RANGES_A_VIDEO)), rows))
    along = Window.partitionBy(video).orderBy("range").rowsBetween(Window.unboundedPreceding, 0)
    counts = cut.groupBy(video, "range").agg(F.count("*").alias("n")).withColumn("end", F.sum("n").over(along))
    hit = wanted.join(counts, video).where((F.col("place") < F.col("end")) & (F.col("place") >= F.col("end") - F.col("n")))
    hit = hit.select(video, "slot", "range", (F.col("place") - F.col("end") + F.col("n")).alias("place"))
    held = cut.join(split.small(hit.select(video, "range").distinct(), 100_000), [video, "range"], "left_semi")
    inside = held.withColumn("place", F.row_number().over(Window.partitionBy(video, "range").orderBy(index)) - 1)
    return inside.join(split.small(hit, 100_000), [video, "range", "place"]).select(video, "slot", index)


def _lengths(frames: DataFrame, video: str, index: str) -> DataFrame:
    return frames.where(F.col(video).isNotNull() & F.col(index).isNotNull()).groupBy(video).agg(F.count("*").alias("n_frames"))


def middle_frame(frames: DataFrame, video: str = "video_id", index: str = "frame_idx", video_rows: int = VIDEO_ROWS) -> DataFrame:
    """The frame at place floor(n / 2) of each video."""
    lengths = _lengths(frames, video, index)
    wanted = lengths.select(video, F.lit(0).alias("slot"), F.floor(F.col("n_frames") / 2).alias("place"))
    return frames.join(frames_at(frames, wanted, lengths, video, index, video_rows).drop("slot"), [video, index])


def random_frame(frames: DataFrame, seed: int = 0, video: str = "video_id", index: str = "frame_idx") -> DataFrame:
    """One frame per video, the same for the same seed: a partial aggregate over light rows, then a join for the payload."""
    hashed = F.struct(draw(seed, F.col(video), F.col(index)).alias("h"), F.col(index).alias("i"))
    chosen = frames.select(video, index).groupBy(video).agg(F.min_by(index, hashed).alias(index))
    return frames.join(chosen, [video, index])


def _source(k: int, slot: Column, n: Column) -> Column:
    """The place that a slot shows: even places are floor(slot * ((n - 1) / (k - 1))) in doubles, the last one n - 1."""
    even = F.floor(slot * ((n - 1) / float(max(1, k - 1))))
    return F.when(n <= k, slot % n).when((slot == k - 1) & F.lit(k > 1), n - 1).otherwise(even)


def resample_frames(frames: DataFrame, k: int, video: str = "video_id", index: str = "frame_idx", video_rows: int = VIDEO_ROWS) -> DataFrame:
    """Exactly k frames per video as (slot, frame): more than k are sampled evenly, fewer are repeated in turn."""
    lengths = _lengths(frames, video, index)
    slots = lengths.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    wanted = slots.select(video, "slot", _source(k, F.col("slot"), F.col("n_frames")).cast("long").alias("place"))
    return frames.join(frames_at(frames, wanted, lengths, video, index, video_rows), [video, index])


def label_frames(frames: DataFrame, videos: DataFrame, video: str = "video_id") -> DataFrame:
    """Every frame with the columns of its video; Spark broadcasts the videos if they are small."""
    return frames.join(videos, video)


def drop_empty_samples(videos: DataFrame, frames: DataFrame, video: str = "video_id") -> DataFrame:
    """Videos that have frames."""
    return videos.join(frames.select(video).distinct(), video, "left_semi")


def drop_empty_arrays(df: DataFrame, frames_col: str) -> DataFrame:
    """Rows whose array of frames is neither null nor empty."""
    return df.where(F.size(frames_col) > 0)
