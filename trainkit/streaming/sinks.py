"""A sink that holds each row once, whatever a stream repeats after a failure."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.types import StructType

DONE = "_SUCCESS"  # the file that Spark leaves in a folder that is written whole


def write_batches(stream: DataFrame, folder: str, output: str, **options: str) -> StreamingQuery:
    """Starts the stream; every batch goes to a folder of its own below `folder`, named after its id.

    A batch that was written but not committed is run again under the same id and replaces what it wrote, so no row
    appears twice; a batch whose folder isn't whole isn't read.  What is committed is kept in `folder`/log, so the same call goes on
    where an earlier one stopped.  Without options, the stream ends when it has read what is there now.
    """

    def save(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(_batch(folder, batch))

    writer = stream.writeStream.outputMode(output).foreachBatch(save).option("checkpointLocation", f"{folder}/log")
    return writer.trigger(**(options or {"availableNow": True})).start()


def _batch(folder: str, batch: int) -> str:
    return f"{folder}/rows/batch={batch}"


def finished_batches(spark: SparkSession, folder: str) -> list[int]:
    """Ids of the batches that are written whole, in order."""
    pattern = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/rows/batch=*/{DONE}")
    found = pattern.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(pattern)
    return sorted(int(f.getPath().getParent().getName().rpartition("=")[2]) for f in found or [])


def read_batches(spark: SparkSession, folder: str, schema: StructType) -> DataFrame:
    """The rows of all finished batches, with a column `batch` of their ids; empty without any."""
    return _read(spark, folder, schema, finished_batches(spark, folder))


def read_last_batch(spark: SparkSession, folder: str, schema: StructType) -> DataFrame:
    """The rows of the last finished batch, which in complete mode are the whole result."""
    return _read(spark, folder, schema, finished_batches(spark, folder)[-1:])


def _read(spark: SparkSession, folder: str, schema: StructType, batches: list[int]) -> DataFrame:
    whole = StructType([*schema.fields]).add("batch", "long")
    if not batches:
        return spark.createDataFrame([], whole)
    return spark.read.schema(whole).option("basePath", f"{folder}/rows").parquet(*[_batch(folder, b) for b in batches])
