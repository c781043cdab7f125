"""Frames of containers of any size: an index of the frames first, then byte ranges read by many tasks.

A container is a chain of lengths and frames, so frame boundaries can't be found from the middle.  One task per file walks the
lengths, reading a few bytes of each frame and seeking over the rest; the index rows are dealt out by file and byte range, and tasks
read the frames of their ranges.  Neither holds more than one frame and one batch of rows.  Files are opened where they are: local
and shared paths directly, others with the file systems that Arrow knows.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import BinaryIO
from urllib.parse import unquote, urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trainkit.sources.files import HEADER_SIZES, JPEG_START, LONGEST, SHORTEST

SPLIT_BYTES = 64 << 20  # of a container that one task reads
BATCH_BYTES = 16 << 20  # of frames in one batch
WALK_BYTES = 8 << 10  # read at a time while lengths are walked
INDEX_ROWS = 4096


def open_file(path: str) -> BinaryIO:
    """The file of a path as Spark lists it."""
    parts = urlsplit(path)
    if parts.scheme in ("", "file"):
        return open(unquote(parts.path) if parts.scheme else path, "rb", buffering=WALK_BYTES)
    store, inside = fs.FileSystem.from_uri(path)
    return store.open_input_file(inside)


def walk(file: BinaryIO, size: int, header: int) -> Iterator[tuple[int, int]]:
    """(place, length) of the frames behind a header; after an implausible length the next four bytes are tried, cut-off frames are skipped."""
    at = header
    while at + 4 <= size:
        file.seek(at)
        found = file.read(4 + len(JPEG_START))
        length, at = int.from_bytes(found[:4], "little"), at + 4
        if SHORTEST <= length <= LONGEST:
            if at + length <= size and found[4:] == JPEG_START:
                yield at, length
            at += length


def frame_places(file: BinaryIO, size: int, max_frames: int | None) -> Iterator[tuple[int, int]]:
    """(place, length) of a container's frames: the first header size that yields any decides."""
    for header in HEADER_SIZES:
        n = 0
        for n, found in enumerate(walk(file, size, header), 1):  # noqa: B007
            yield found
            if n == max_frames:
                return
        if n:
            return


def index_frames(files: DataFrame, max_frames: int | None = None) -> DataFrame:
    """(path, frame_idx, at, length): where each frame of the files (path, length) lies; files without frames have no rows."""

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, size in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with open_file(path) as file:
                    rows: list[tuple[int, int, int]] = []
                    for i, (at, length) in enumerate(frame_places(file, size, max_frames)):
                        rows.append((i, at, length))
                        if len(rows) == INDEX_ROWS:
                            yield _indexed(path, rows)
                            rows = []
                    if rows:
                        yield _indexed(path, rows)

    return files.select("path", F.col("length").cast("long").alias("length")).mapInArrow(index, "path string, frame_idx int, at long, length int")


def _indexed(path: str, rows: list[tuple[int, int, int]]) -> pa.RecordBatch:
    numbers, places, lengths = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array([path] * len(rows)), pa.array(numbers, pa.int32()), pa.array(places, pa.int64()), pa.array(lengths, pa.int32())], names=["path", "frame_idx", "at", "length"])


def read_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Frames at the places of (path, frame_idx, at, length), sorted by path and place, in batches of bounded size."""
    name, file = None, None
    held: list[tuple[str, int, bytes]] = []
    size = 0
    try:
        for batch in batches:
            for path, number, at, length in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if path != name:
                    if file is not None:
                        file.close()
                    name, file = path, open_file(path)
                file.seek(at)
                held.append((path, number, file.read(length)))
                size += length
                if size >= BATCH_BYTES:
                    yield _frames(held)
                    held, size = [], 0
        if held:
            yield _frames(held)
    finally:
        if file is not None:
            file.close()


def _frames(held: list[tuple[str, int, bytes]]) -> pa.RecordBatch:
    paths, numbers, frames = zip(*held, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(paths), pa.array(numbers, pa.int32()), pa.array(frames, pa.binary())], names=["path", "frame_idx", "frame"])


def read_frames(index: DataFrame, splits: int, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """(path, frame_idx, frame) of an index; frames of one range of a file are read in a row, by one of `splits` tasks."""
    ranged = index.withColumn("range", F.floor(F.col("at") / split_bytes)).repartition(splits, "path", "range")
    return ranged.sortWithinPartitions("path", "at").select("path", "frame_idx", "at", "length").mapInArrow(read_ranges, "path string, frame_idx int, frame binary")


def extract_large_frames(spark: SparkSession, root: str, glob: str = "*.seq", max_frames: int | None = None, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """(path, frame_idx, frame): the frames that `extract_frames` gives, of containers below `root` that need not fit in memory.

    Contents aren't read through Spark; empty and broken containers give no rows.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(root).select("path", "length")
    total = files.agg(F.sum("length")).first()[0] or 0
    return read_frames(index_frames(files, max_frames), max(1, -(-total // split_bytes)), split_bytes)
