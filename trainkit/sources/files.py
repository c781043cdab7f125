"""Catalogues of labelled files, labelled records, and frames inside length-prefixed containers."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from itertools import islice

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trainkit.operators.split import index_classes
from trainkit.sources.tables import written

# Fixed values of the container: header sizes to try, the range of a plausible frame length, a JPEG's first bytes.
HEADER_SIZES = (1024, 2048, 4096)
SHORTEST, LONGEST = 100, 10 * 1024 * 1024
JPEG_START = b"\xff\xd8"

CATALOG_SPLITS = 64  # of Spark's splits that a task catalogues


def catalog_labeled_files(spark: SparkSession, root: str, glob: str = "*.seq", class_of: Callable[[Column], Column] | None = None) -> DataFrame:
    """(path, class_name, label, size): files below `root`, their class is the folder they lie in; contents are not read.

    `class_of` gives the class for a folder's name, which else is the class itself.  Every file is looked at once.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(root)
    folder = F.element_at(F.split("path", "/"), -2)
    named = files.select("path", (class_of(folder) if class_of else folder).alias("class_name"), F.col("length").alias("size"))
    # Spark deals files out as if they were read, a few to a task.
    found = written(named.coalesce(-(-named.rdd.getNumPartitions() // CATALOG_SPLITS) or 1))
    return index_classes(found, "class_name").select("path", "class_name", "label", "size")


def read_files(spark: SparkSession, root: str, glob: str = "*.seq") -> DataFrame:
    """(path, content) of the files below `root`."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(root).select("path", "content")


def _store(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder, and its path there."""
    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)


def write_files(df: DataFrame, folder: str, name_col: str = "name", content_col: str = "content") -> int:
    """Writes every row's content to a file `folder`/name and returns their number; the folder, made if it is missing, must be one that the driver and all tasks reach.

    A file appears whole under its name, so a task that runs twice leaves one.  Null contents are empty files; names must differ.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = _store(folder)
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                whole = f"{path}/{name}"
                store.create_dir(whole.rpartition("/")[0])
                part = f"{whole}.{uuid.uuid4().hex}.part"
                with store.open_output_stream(part) as out:
                    if content.is_valid:
                        out.write(content.as_buffer())
                store.move(part, whole)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], names=["n"])

    store, path = _store(folder)
    store.create_dir(path)
    rows = df.select(F.col(name_col).alias("name"), F.col(content_col).cast("binary").alias("content"))
    return rows.mapInArrow(write, "n long").agg(F.sum("n")).first()[0] or 0


def read_labeled_records(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Parquet records with the given columns and types; raises ValueError for a missing column."""
    wanted = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    found = spark.read.parquet(path)
    missing = [f.name for f in wanted.fields if f.name not in found.columns]
    if missing:
        raise ValueError(f"{path} has no column {', '.join(missing)}")
    return found.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in wanted.fields])


def _plausible(blob: memoryview, at: int) -> Iterator[memoryview]:
    """Whole frames behind plausible lengths; after an implausible length the next four bytes are tried."""
    while at + 4 <= len(blob):
        length, at = int.from_bytes(blob[at : at + 4], "little"), at + 4
        if SHORTEST <= length <= LONGEST:
            if at + length <= len(blob):
                yield blob[at : at + length]
            at += length


def frames_in(content: bytes | memoryview | None, max_frames: int) -> list[bytes]:
    """Frames of one container: the first header size that yields any decides; cut-off frames are skipped."""
    blob = memoryview(content or b"").cast("B")
    by_header = (list(islice((bytes(f) for f in _plausible(blob, header) if f[:2] == JPEG_START), max_frames)) for header in HEADER_SIZES)
    return next(filter(None, by_header), [])


def extract_frames(files: DataFrame, max_frames: int = 10, path_col: str = "path", content_col: str = "content", repartition: int | None = None) -> DataFrame:
    """(path, frame_idx, frame): the frames of every container, file by file; frames are not decoded.

    `repartition` deals the files out by path first, so that big files spread.
    """
    rows = files.select(F.col(path_col).alias("path"), F.col(content_col).alias("content"))
    if repartition:
        rows = rows.repartition(repartition, "path")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1), strict=True):
                frames = frames_in(content.as_buffer() if content.is_valid else None, max_frames)
                if frames:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([path.as_py()] * len(frames), pa.string()), pa.array(range(len(frames)), pa.int32()), pa.array(frames, pa.binary())], names=["path", "frame_idx", "frame"]
                    )

    return rows.mapInArrow(extract, "path string, frame_idx int, frame binary")
