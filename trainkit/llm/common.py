"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_LOCAL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """A folder of this application in the one that `spark.checkpoint.dir` names; a local one only where all tasks run on this machine."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named is None:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = _LOCAL.setdefault("folder", tempfile.mkdtemp(prefix="spark-tables-"))
    return f"{named.rstrip('/')}/tables-{spark.sparkContext.applicationId}"


def cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage: `df` written to the shared folder, and read from there.

    A table is computed once, while an eager checkpoint computes its last stage twice, and its shuffle files go as soon as
    it is written.  Names are put aside while it is
    written, so any names do.  zstd keeps texts that wait for a stage's end small.  Rows may be dealt out anew: a place in a partition is to be taken before.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    before = spark.conf.get(DROP_SHUFFLES)
    spark.conf.set(DROP_SHUFFLES, "true")
    try:
        plain.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(DROP_SHUFFLES, before)
    table = spark.read.schema(plain.schema).parquet(path).toDF(*df.columns)
    table.written_at = path
    return table


def forget(*tables: DataFrame) -> None:
    """Deletes tables that `cut` wrote and nothing reads any more."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.written_at)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def id_remainder(id_col: str, modulus: int) -> Column:
    """crc32(id as text) mod `modulus`; null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % F.lit(modulus)


def hash_share(id_col: str, seed: int, salt: str | None = None) -> Column:
    """A repeatable number in [0, 1) drawn from the id and, if given, the column `salt`, so that rows without ids don't share one draw."""
    drawn = [F.lit(seed), F.col(id_col)] + ([F.col(salt)] if salt else [])
    return F.pmod(F.xxhash64(*drawn), F.lit(1 << 30)) / F.lit(float(1 << 30))


def tasks_for(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def map_rows(
    docs: DataFrame,
    carry: list[Column],
    inputs: list[Column],
    compute: Callable[[], Callable[[list[pa.Array]], list[pa.Array]]],
    fields: str,
) -> DataFrame:
    """Columns `carry` as c0, c1, ... beside the `fields` that are computed from `inputs`, row by row, without a shuffle.

    `compute()` is called once per task and returns the function from a batch's inputs to its results.  Carried
    columns go by position, so their names can't clash with the results'.
    """
    rows = docs.select(*[c.alias(f"c{i}") for i, c in enumerate(carry)], *[x.alias(f"x{i}") for i, x in enumerate(inputs)])
    kept, given = len(carry), len(inputs)
    results = T.StructType.fromDDL(fields)
    schema = T.StructType([*rows.schema.fields[:kept], *results.fields])
    names = [f.name for f in schema.fields]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = compute()
        for batch in batches:
            if batch.num_rows:
                made = judge([batch.column(kept + i) for i in range(given)])
                yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(kept)], *made], names=names)

    return rows.mapInArrow(apply, schema)
