"""Exact duplicates by content sort.

Normalised texts are dealt out by sampled splitters over their leading characters and digest
(`repartitionByRange`), sorted inside every partition by Spark's spilling sort, and neighbours are compared
in full.  A run of equal texts keeps
its smallest identifier.  The identifier belongs to the range key, so one huge group of copies is
spread over many partitions; the two outer runs of every partition are stitched together afterwards
by their full text, of which there are at most two per partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trainkit.llm.common import cut, tasks_for

SPACE_RUN = "[\\x20\\x09-\\x0D]+"
SPLITTER_CHARS = 24
NO_ID = np.iinfo(np.int64).max

_RUNS = "row_key long, id long, head boolean, sha string, run_min long, run_rows long, edge long, edge_text string"


def normalise(text: Column) -> Column:
    """Null counts as empty; each run of ASCII white space becomes one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE_RUN, " ")


def _compare_neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Finds the runs of a sorted partition; holds the keys and ids of the open run and one text."""
    part = TaskContext.get().partitionId()
    kept = {"key": np.empty(0, np.int64), "id": np.empty(0, np.int64)}
    open_text = open_sha = None
    is_first = True

    def closed(keys, ids, starts, shas, last_of_partition, text_of):
        nonlocal is_first
        sizes = np.diff(np.append(starts, len(keys)))
        low = np.minimum.reduceat(ids, starts)
        edges, texts = [None] * len(starts), [None] * len(starts)
        if is_first:
            edges[0], texts[0] = 2 * part, text_of(0)
            is_first = False
        elif last_of_partition:
            edges[-1], texts[-1] = 2 * part + 1, text_of(len(starts) - 1)
        at = pa.array(np.repeat(np.arange(len(starts)), sizes))
        heads = np.full(len(keys), -1)
        heads[starts] = np.arange(len(starts))
        return pa.RecordBatch.from_arrays(
            [
                pa.array(keys),
                pa.array(ids, mask=ids == NO_ID),
                pa.array(heads >= 0),
                pa.array(shas, pa.string()).take(at),
                pa.array(low, mask=low == NO_ID).take(at),
                pa.array(sizes.astype(np.int64)).take(at),
                pa.array(edges, pa.int64()).take(at),
                pa.array(texts, pa.string()).take(pa.array(heads, mask=heads < 0)),
            ],
            names=["row_key", "id", "head", "sha", "run_min", "run_rows", "edge", "edge_text"],
        )

    for batch in batches:
        n = batch.num_rows
        if n == 0:
            continue
        texts, shas = batch.column(2), batch.column(3)
        new = np.ones(n, bool)
        new[0] = open_text is None or texts[0].as_py() != open_text
        if n > 1:
            new[1:] = ~pc.equal(texts.slice(1), texts.slice(0, n - 1)).to_numpy(zero_copy_only=False)
        begins = np.flatnonzero(new)
        held = len(kept["key"])
        keys = np.concatenate([kept["key"], batch.column(0).to_numpy()])
        ids = np.concatenate([kept["id"], pc.fill_null(batch.column(1), int(NO_ID)).to_numpy()])
        run_texts = [lambda: open_text] if held else []
        run_shas = [open_sha] if held else []
        run_texts += [lambda i=i: texts[i].as_py() for i in begins]
        run_shas += [shas[int(i)].as_py() for i in begins]
        starts = np.concatenate([np.zeros(1 if held else 0, np.int64), begins + held]).astype(np.int64)
        if len(starts) > 1:
            stop = starts[-1]
            yield closed(keys[:stop], ids[:stop], starts[:-1], run_shas[:-1], False, lambda k, f=run_texts: f[k]())
        kept = {"key": keys[starts[-1] :], "id": ids[starts[-1] :]}
        open_text, open_sha = run_texts[-1](), run_shas[-1]
    if len(kept["key"]):
        yield closed(kept["key"], kept["id"], np.zeros(1, np.int64), [open_sha], True, lambda _: open_text)


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key_col: str | None = None) -> DataFrame:
    """One row per input row: (row_key, id, keep_id, group_size, kept, text_sha256).

    Null texts equal empty ones.  Exactly one row of a group is kept: the smallest id's, of rows that share
    it the one with the smallest row key; a group whose ids are all null has keep_id null.  An empty table
    gives an empty result.  Other columns are left out, whatever their names.  `key_col` names a unique
    long column for row_key; without it, the row key is made from the scan order.
    """
    spark = docs.sparkSession
    key = F.col(key_col) if key_col else F.monotonically_increasing_id()
    rows = docs.select(key.alias("row_key"), F.col(id_col).cast("long").alias("id"), normalise(F.col(text_col)).alias("norm"))
    # Splitters hold the first characters and the digest of a text, not the text: they pass through the driver.
    rows = rows.withColumn("head", F.substring("norm", 1, SPLITTER_CHARS)).withColumn("digest", F.unhex(F.sha2("norm", 256)))
    by_id = [F.col("id").asc_nulls_last(), F.col("row_key")]
    ordered = rows.repartitionByRange(tasks_for(spark), "head", "digest", *by_id).sortWithinPartitions("head", "digest", "norm", *by_id)
    runs = cut(ordered.select("row_key", "id", "norm", F.lower(F.hex("digest")).alias("sha")).mapInArrow(_compare_neighbours, _RUNS))

    # At most two edge runs per partition, stitched by their full texts; the lowest edge has the smallest id.
    edges = runs.where(F.col("edge").isNotNull() & F.col("head"))
    whole = edges.groupBy("edge_text").agg(
        F.min("run_min").alias("all_min"), F.sum("run_rows").alias("all_rows"), F.min("edge").alias("first_edge"), F.collect_list("edge").alias("edge")
    )
    stitched = whole.select(F.explode("edge").alias("edge"), "all_min", "all_rows", "first_edge")
    return runs.join(F.broadcast(stitched), "edge", "left").select(
        "row_key",
        "id",
        F.when(F.col("edge").isNull(), F.col("run_min")).otherwise(F.col("all_min")).alias("keep_id"),
        F.coalesce("all_rows", "run_rows").alias("group_size"),
        (F.col("head") & (F.col("edge").isNull() | (F.col("edge") == F.col("first_edge")))).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )
