"""How queries are registered, and the given tables in the roles that the operators expect."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trainkit.sources.tables import new_folder

__all__ = ["ORACLES", "QUERIES", "new_folder"]

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its own name, with its DuckDB twin if there is one."""

    def register(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(x: Column, digits: int = 6) -> Column:
    """Rounded, and never minus zero."""
    return F.round(x, digits) + F.lit(0.0)


def long_rows(df: DataFrame, keys: list[str], arr: Column, digits: int = 6) -> DataFrame:
    """One row per array element: keys, pos, value."""
    rows = df.select(*keys, F.posexplode_outer(arr).alias("pos", "value"))
    return rows.select(*keys, F.col("pos").cast("long").alias("pos"), r6(F.col("value").cast("double"), digits).alias("value"))


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, pixels, label): embeddings as 1 x 8 x 8 or 4 x 4 x 4 images."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("pixels"), F.col("label").cast("int").alias("label"))


#: The same in DuckDB, as the beginning of a WITH.
IMAGES = "images AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS pixels, CAST(label AS INTEGER) AS label FROM embeddings)"


def sql_long(source: str, keys: str, arr: str, digits: int = 6) -> str:
    """One row per array element in DuckDB, from `source` (a table or a subquery in brackets)."""
    return f"""SELECT {keys}, CAST(i - 1 AS BIGINT) AS pos, round(CAST(arr[i] AS DOUBLE), {digits}) + 0.0 AS value
FROM (SELECT {keys}, {arr} AS arr, unnest(range(1, len({arr}) + 1)) AS i FROM {source})"""


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(video_id, frame_idx, payload): conversations as videos, turns as frames."""
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("video_id"), F.col("turn").cast("int").alias("frame_idx"), F.col("text").alias("payload"))


FRAMES = "frames AS (SELECT conv_id AS video_id, CAST(turn AS INTEGER) AS frame_idx, text AS payload FROM conversations)"


def batch_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(run, epoch, ts, step, n, loss): events as the batches of training runs."""
    return batch_metrics_of(table(spark, sf_dir, "events"))


def batch_metrics_of(events: DataFrame) -> DataFrame:
    return events.select(
        F.col("user_id").alias("run"),
        (F.dayofmonth("ts") % 4).cast("long").alias("epoch"),
        "ts",
        F.col("event_id").alias("step"),
        F.coalesce(F.get_json_object("props", "$.k").cast("long"), F.lit(0)).alias("n"),
        F.col("value").alias("loss"),
        F.col("event_type").alias("tag"),
    )


BATCH_METRICS = """batch_metrics AS (SELECT user_id AS run, CAST(day(ts) % 4 AS BIGINT) AS epoch, ts, event_id AS step,
  coalesce(TRY_CAST(json_extract_string(props, '$.k') AS BIGINT), 0) AS n, value AS loss, event_type AS tag FROM events)"""


def draw_sql(*parts: str) -> str:
    """md5 of SQL expressions joined by ':'."""
    return "md5(" + " || ':' || ".join(f"CAST({p} AS VARCHAR)" for p in parts) + ")"


def below_sql(n: int, *parts: str) -> str:
    """The twin of `below`."""
    digits = [f"(instr('0123456789abcdef', substr({draw_sql(*parts)}, {k + 1}, 1)) - 1) * {16 ** (5 - k)}" for k in range(6)]
    return f"(({' + '.join(digits)}) % {n})"


def unit_sql(*parts: str) -> str:
    """A number in [0, 1) from the first eight hex digits of a draw."""
    digits = [f"(instr('0123456789abcdef', substr({draw_sql(*parts)}, {k + 1}, 1)) - 1) * {16 ** (7 - k)}" for k in range(8)]
    return f"(({' + '.join(digits)}) / {float(2**32)})"


def normal_sql(*parts: str) -> str:
    """The twin of `normal`."""
    unit = lambda start: "((" + " + ".join(f"(instr('0123456789abcdef', substr({draw_sql(*parts)}, {start + k}, 1)) - 1) * {16 ** (7 - k)}" for k in range(8)) + f") + 0.5) / {float(2**32)}"
    return f"(sqrt(-2.0 * ln({unit(1)})) * cos({unit(9)} * 2.0 * pi()))"
