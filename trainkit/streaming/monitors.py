"""Monitors over a live feed of metrics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def stream_epoch_means(stream: DataFrame, keys: list[str], val: str, n: str) -> DataFrame:
    """Weighted means per key, to be read at any time; the state grows with the keys only (update or complete mode)."""
    weight = F.sum(n)
    return stream.groupBy(*keys).agg(F.when(weight != 0, F.sum(F.col(val) * F.col(n)) / weight).alias("mean"), weight.alias("n"))


def _rises(run: np.ndarray, metric: np.ndarray) -> np.ndarray:
    """Which rows, sorted by run, are above 0 and above all earlier ones of their run."""
    values = pd.Series(metric)
    before = values.groupby(run).cummax().groupby(run).shift(fill_value=0.0)
    return (values > np.maximum(before.to_numpy(), 0.0)).to_numpy()


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of each batch that no earlier row of their run in it reaches: no others can improve on anything."""
    for batch in batches:
        order = pc.sort_indices(pa.Table.from_batches([batch]), [("run", "ascending"), ("at", "ascending"), ("metric", "descending")], null_placement="at_start")
        rows = batch.take(order)
        run = pc.fill_null(rows.column("run").dictionary_encode().indices, -1).to_numpy(zero_copy_only=False)
        yield rows.filter(pa.array(_rises(run, rows.column("metric").to_numpy())))


def stream_best_so_far(stream: DataFrame, run: str, metric: str, order: str | None = None) -> DataFrame:
    """(run, at, best, previous) in update mode: one row per strict improvement of a run's best metric, which starts from 0.

    `at` is the row's `order`.  The state is one number per run.  Batches follow each other; rows inside one are taken in order, null orders
    first, so a feed that comes in order gives the rows that the batch job `best_so_far` calls best.  Without `order` the rows of a
    batch count as one, and only their highest can improve.  Rows that their own Arrow batch rules out aren't shuffled,
    so a run that has a third of all rows sends little more than its improvements.  Null and NaN metrics improve
    nothing; a null run is a run.
    """
    at = F.col(order) if order else F.lit(0)
    rows = stream.select(F.col(run).alias("run"), at.alias("at"), F.col(metric).cast("double").alias("metric")).where(F.col("metric") > 0).where(~F.isnan("metric"))
    kind = {f.name: f.dataType for f in rows.schema.fields}
    given = T.StructType([T.StructField(n, kind[n]) for n in ("run", "at", "metric")])
    result = T.StructType([T.StructField("run", kind["run"]), T.StructField("at", kind["at"]), T.StructField("best", T.DoubleType()), T.StructField("previous", T.DoubleType())])

    def improve(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        best = state.get[0] if state.exists else 0.0
        kept = None  # the rises among the rows seen so far, in order
        for part in parts:
            part = part.loc[part["metric"] > best, ["at", "metric"]]
            kept = part if kept is None else pd.concat([kept, part], ignore_index=True)
            kept = kept.sort_values(["at", "metric"], ascending=[True, False], na_position="first", kind="stable")
            kept = kept[_rises(np.zeros(len(kept), np.int8), kept["metric"].to_numpy())]
        if kept is None or kept.empty:
            return
        values = kept["metric"].to_numpy()
        state.update((float(values[-1]),))
        yield pd.DataFrame({"run": [key[0]] * len(values), "at": kept["at"].to_numpy(), "best": values, "previous": np.concatenate([[best], values[:-1]])})

    return rows.mapInArrow(_candidates, given).groupBy("run").applyInPandasWithState(improve, result, "best double", "update", GroupStateTimeout.NoTimeout)
