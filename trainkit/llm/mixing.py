"""Mixing sources to target weights by pivotal dependent rounding.

A source's target is its share of all words by weight, held at `max_repeat` times its size, the excess
reshared.  Every document asks for target / size copies; the whole part is given, the fraction is rounded.
Rounding moves word mass between two partners, at random and fairly in expectation, until one is integral.
Inside a bucket of one source the largest open document meets the rest of the bucket, whose documents all
share one fraction; so large documents are settled first and a small one is left over.  The residuals, at
most one per bucket, meet in pairs up a tree of buckets until each source has one, which is rounded alone.
A source's taken words thus differ from its target by less than that document's size.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trainkit.llm.common import cut

WORD = "[^\\x20\\x09-\\x0D]+"
BUCKET_ROWS = 4096
TREE_FANOUT = 64
BROADCAST_SOURCES = 10_000  # rows of the table of sources that may be broadcast
_ROWS = "row_key long, id long, src string, has_src boolean, size long, source_size long, target double, bucket long, whole long, frac double, copies long"
EPS = 1e-12


def size_in_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), max_repeat: float = 3.0) -> DataFrame:
    """(has_src, src, rows, source_size, target) from rows (src, size); a null source is one of its own, last in order.

    Weights repeat along the sources in code point order.  Only sums over sources reach the driver; each
    round holds at least one more source at its limit.
    """
    totals = cut(sizes.groupBy(F.col("src").isNotNull().alias("has_src"), F.coalesce("src", F.lit("")).alias("src")).agg(F.count("*").alias("rows"), F.sum("size").alias("source_size")))
    # Sampled splitters put the sources in order; a partition's first position is the number of sources before it.
    in_part = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    ordered = totals.repartitionByRange(F.col("has_src").desc(), F.col("src")).sortWithinPartitions(F.col("has_src").desc(), "src")
    ranged = cut(ordered.withColumn("part", F.spark_partition_id()).withColumn("in_part", in_part))
    before = ranged.groupBy("part").agg(F.count("*").alias("n")).collect()
    offset = {}
    total = 0
    for part, n in sorted(before):
        offset[part] = total
        total += n
    first = F.element_at(F.create_map(*[F.lit(x) for kv in offset.items() for x in kv]), F.col("part")) if offset else F.lit(0)
    share = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("first") + F.col("in_part")) % len(weights) + 1).cast("int"))
    weighed = cut(ranged.withColumn("first", first).withColumn("weight", share).drop("in_part", "first", "part"))
    limit = F.col("source_size") * float(max_repeat)
    rate, held = 0.0, -1
    while True:
        over = F.col("weight") * rate > limit
        n, fixed, free, whole = weighed.agg(
            F.count_if(over), F.sum(F.when(over, limit).otherwise(0.0)), F.sum(F.when(over, 0.0).otherwise(F.col("weight"))), F.sum("source_size")
        ).first()
        if n == held or not free:
            break
        held, rate = n, (float(whole) - fixed) / free
    return weighed.withColumn("target", F.least(F.col("weight") * rate, limit)).drop("weight")


def _draw(seed: int, a: int | None, b: int | None, step: int) -> float:
    return xxhash.xxh64_intdigest(f"{a}:{b}:{step}", seed) / 2.0**64


def _settle_bucket(seed: int) -> Callable:
    def settle(rows: pd.DataFrame) -> pd.DataFrame:
        """Rounds the documents of one bucket, which share one fraction, from the largest to the smallest."""
        rows = rows.sort_values(["size", "id", "row_key"], ascending=[False, True, True], na_position="first", kind="stable").reset_index(drop=True)
        sizes, ids, n = rows["size"].tolist(), rows["id"].tolist(), len(rows)
        copies, left = [None] * n, [float("nan")] * n
        rest, frac = float(sum(sizes)), float(rows["frac"][0])
        for j in range(n):
            size, rest = sizes[j], rest - sizes[j]
            up = min((1 - frac) * size, frac * rest)  # words that the document can take from the rest
            down = min(frac * size, (1 - frac) * rest)  # or give to it
            rises = _draw(seed, ids[j], None, j) * (up + down) < down
            own = frac + (up / size if rises else -down / size)
            others = frac if rest <= 0 else frac + (-up / rest if rises else down / rest)
            if EPS < own < 1 - EPS:
                left[j] = own
            else:
                copies[j] = round(own)
            if not EPS < others < 1 - EPS:  # the rest is integral
                copies[j + 1 :] = [round(others)] * (n - j - 1)
                break
            frac = others
        rows["frac"], rows["copies"] = left, pd.array(copies, dtype="Int64")
        return rows

    return settle


def _pair_off(seed: int, last: bool) -> Callable:
    def settle(rows: pd.DataFrame) -> pd.DataFrame:
        """Pairs the residuals of one node of the tree in a fixed order, carrying the open one along."""
        rows = rows.sort_values(["size", "id", "row_key"], ascending=[False, True, True], na_position="first", kind="stable").reset_index(drop=True)
        size, frac, ids, copies = rows["size"].tolist(), rows["frac"].tolist(), rows["id"].tolist(), [None] * len(rows)
        held = None
        for j in range(len(rows)):
            if held is None:
                held = j
                continue
            i, si, sj = held, size[held], size[j]
            up = min((1 - frac[i]) * si, frac[j] * sj)  # words moved from j to i
            down = min(frac[i] * si, (1 - frac[j]) * sj)  # or from i to j
            move = up if _draw(seed, ids[i], ids[j], j) * (up + down) < down else -down
            frac[i] += move / si
            frac[j] -= move / sj
            held = None
            for k in (i, j):
                if EPS < frac[k] < 1 - EPS:
                    held = k
                else:
                    copies[k] = round(frac[k])
        if held is not None and last:
            copies[held] = int(_draw(seed, ids[held], None, -1) < frac[held])
        rows["frac"], rows["copies"] = frac, pd.array(copies, dtype="Int64")
        return rows

    return settle


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[float, ...] = (1.0, 2.0, 3.0),
    max_repeat: float = 3.0,
    seed: int = 42,
    key_col: str | None = None,
) -> DataFrame:
    """One row per input row: (row_key, id, source, size, source_size, target, copies, taken).

    `taken` = copies * size; copies is a whole number of at most `max_repeat`, rounded up.  Empty and null texts have
    size 0 and take 0 words; a source of size 0 has target 0.  Very long texts are counted whole.  Reruns agree: buckets, order and draws come from ids
    and sizes (of rows that share an id, from row keys).  An empty table gives an empty result; other columns are left out.
    """
    key = F.col(key_col) if key_col else F.monotonically_increasing_id()
    rows = cut(
        docs.select(key.alias("row_key"), F.col(id_col).cast("long").alias("id"), F.col(source_col).cast("string").alias("src"), size_in_words(F.col(text_col)).alias("size"))
    )
    targets = cut(source_targets(rows, weights, max_repeat))
    # An id that would fill buckets of its own is dealt out by row keys.
    hot = rows.where("id IS NOT NULL").groupBy("id").count().where(F.col("count") > BUCKET_ROWS).select(F.col("id").alias("hot_id"))
    if hot.isEmpty():
        rows = rows.withColumn("dealt_by", F.coalesce("id", "row_key"))
    else:
        rows = rows.join(hot, F.col("id") == F.col("hot_id"), "left").withColumn("dealt_by", F.when(F.col("hot_id").isNull(), F.coalesce("id", "row_key")).otherwise(F.col("row_key"))).drop("hot_id")
    n_sources, longest = targets.agg(F.count("*"), F.max(F.length("src"))).first()
    small = n_sources <= BROADCAST_SOURCES and (longest or 0) <= 1024
    asked = (
        rows.withColumn("has_src", F.col("src").isNotNull())
        .withColumn("src", F.coalesce("src", F.lit("")))
        .join(F.broadcast(targets) if small else targets, ["has_src", "src"])
        .withColumn("ratio", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
        .withColumn("whole", F.floor(F.col("ratio") + EPS).cast("long"))
        .withColumn("frac", F.greatest(F.col("ratio") - F.col("whole"), F.lit(0.0)))
        .withColumn("bucket", F.pmod(F.xxhash64(F.lit(seed), "dealt_by"), F.ceil(F.col("rows") / BUCKET_ROWS)).cast("long"))
        .withColumn("copies", F.when((F.col("size") == 0) | (F.col("frac") <= EPS), F.lit(0)).cast("long"))
        .select("row_key", "id", "src", "has_src", "size", "source_size", "target", "bucket", "whole", "frac", "copies")
    )
    settled = asked.where(F.col("copies").isNotNull())
    level = cut(asked.where(F.col("copies").isNull()).groupBy("has_src", "src", "bucket").applyInPandas(_settle_bucket(seed), _ROWS))
    done = settled.unionByName(level.where(F.col("copies").isNotNull()))
    top = targets.agg(F.max(F.ceil(F.col("rows") / BUCKET_ROWS))).first()[0] or 1
    while True:
        top = -(-top // TREE_FANOUT)
        residuals = level.where(F.col("copies").isNull()).withColumn("bucket", F.floor(F.col("bucket") / TREE_FANOUT))
        level = cut(residuals.groupBy("has_src", "src", "bucket").applyInPandas(_pair_off(seed + top, top == 1), _ROWS))
        done = done.unionByName(level.where(F.col("copies").isNotNull()))
        if top == 1:
            break
    copies = F.col("whole") + F.col("copies")
    return done.select(
        "row_key", "id", F.when(F.col("has_src"), F.col("src")).alias("source"), "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken")
    )
