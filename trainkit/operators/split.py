"""Classes, stratified splits, shuffles and batches.

Row numbers over a whole class or table are counted in two steps: rows fall into buckets of their order key,
are numbered inside their bucket, and get the number of rows in earlier buckets added.  No task holds a whole
class, and the result equals the plain window's.  There are as many buckets as the table's rows ask for.

Every job takes empty tables (and gives one), nulls as its docstring says, and columns of any name: helper
columns take names that the table hasn't got.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trainkit.functions.draws import draw
from trainkit.functions.names import free_names

BUCKET_ROWS = 100_000  # rows of a bucket, about, up to MOST_BUCKETS; beyond that buckets grow with the table
MOST_BUCKETS = 4096
BUCKET_NAMES = 250  # class names of a bucket
SAMPLES = 32  # sampled values a bucket, from which its bounds are taken
BOUND_CHARS = 64  # of a text that is a bound
BROADCAST_CLASSES = 10_000  # rows of a table of classes that may be broadcast


def small(df: DataFrame, most: int = BROADCAST_CLASSES) -> DataFrame:
    """`df` with a broadcast hint if it has at most `most` rows, else as it is."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def buckets_for(rows: int, bucket_rows: int = BUCKET_ROWS) -> int:
    return max(1, min(MOST_BUCKETS, -(-rows // bucket_rows)))


def numbered(df: DataFrame, keys: list[str], order: list[Column], bucket: Column, number: str = "rn", size: str | None = None) -> DataFrame:
    """`df` with the 1-based row number by `order` within `keys`, and their row count; `bucket` must rise with `order`.

    Null keys are a key, null buckets come first.  A column that has the name of a result is replaced.
    """
    own, _n, _b, _ahead, _all, _rn, *_k = free_names([*df.columns, number, size or number], "_bucket", "_n", "_b", "_ahead", "_all", "_rn", *[f"_k{i}" for i in range(len(keys))])
    rows = df.withColumn(own, bucket)
    counts = rows.groupBy(*keys, own).agg(F.count("*").alias(_n))
    span = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    ahead = span.orderBy(F.col(own).asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*[F.col(k).alias(a) for k, a in zip(keys, _k, strict=True)], F.col(own).alias(_b), F.coalesce(F.sum(_n).over(ahead), F.lit(0)).alias(_ahead), F.sum(_n).over(span).alias(_all))
    inside = rows.withColumn(_rn, F.row_number().over(Window.partitionBy(*keys, own).orderBy(*order)))
    match = F.col(own).eqNullSafe(F.col(_b))
    for k, a in zip(keys, _k, strict=True):
        match = match & F.col(k).eqNullSafe(F.col(a))
    joined = inside.join(small(offsets, 100_000), match)
    out = joined.withColumn(number, F.col(_ahead) + F.col(_rn))
    if size:
        out = out.withColumn(size, F.col(_all))
    return out.drop(own, _b, _rn, _ahead, _all, *_k)


def hash_bucket(hashed: Column, digits: int = 3) -> Column:
    """The first hex digits of a draw."""
    return F.substring(hashed, 1, digits)


def hash_digits(rows: int) -> int:
    """Hex digits of a draw that make buckets of about BUCKET_ROWS rows."""
    return max(1, math.ceil(math.log(buckets_for(rows), 16)))


def order_number(df: DataFrame, key: str) -> Column | None:
    """A number that rises with a numeric, date or time column; None for other types."""
    kind = df.select(key).schema[0].dataType
    if isinstance(kind, T.TimestampNTZType):
        return F.unix_date(F.to_date(key)) * 86_400 + F.hour(key) * 3600 + F.minute(key) * 60 + F.floor(F.second(key))
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(key)
    if isinstance(kind, T.DateType):
        return F.unix_date(key)
    return F.col(key) if isinstance(kind, T.NumericType) else None


def _place(value: Column, bounds: list[Column]) -> Column:
    """How many of the rising `bounds` are not above `value`: a binary search in an array, so that code doesn't grow with the bounds."""
    if not bounds:
        return F.lit(0)
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(bounds).bit_length()))])
    array = F.array(*bounds)
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(array, at + step - 1) <= value, at + step).otherwise(at))


def range_bucket(df: DataFrame, value: Column, buckets: int) -> Column:
    """A bucket of about equally many rows that rises with a number, nulls first; equal values share theirs."""
    shares = [i / buckets for i in range(1, buckets)]
    found = df.agg(F.percentile_approx(value, shares, 10 * buckets)).first()[0] if shares else []
    return F.when(value.isNull(), -1).otherwise(_place(value, [F.lit(b) for b in sorted(set(found or []))]))


def order_bucket(df: DataFrame, order: Sequence[str], buckets: int, rows: int) -> Column:
    """A bucket of about equally many rows that rises with columns of any sortable type, nulls first; only rows equal in all share it for sure.

    One number or time is cut at its percentiles, others at bounds from a sample of about SAMPLES values a bucket; the
    bounds decide how evenly rows spread, not what is computed.
    """
    if buckets <= 1:
        return F.lit(0)
    number = order_number(df, order[0]) if len(order) == 1 else None
    if number is not None:
        return range_bucket(df, number, buckets)
    kinds = [df.select(c).schema[0].dataType for c in order]
    parts = [F.substring(c, 1, BOUND_CHARS) if isinstance(t, T.StringType) else F.col(c) for c, t in zip(order, kinds, strict=True)]
    names = [f"p{i}" for i in range(len(order))]
    sampled = df.select(*[p.alias(n) for p, n in zip(parts, names, strict=True)]).sample(min(1.0, SAMPLES * buckets / max(1, rows)), seed=7).orderBy(*names).collect()
    picked = list(dict.fromkeys(tuple(sampled[len(sampled) * i // buckets]) for i in range(1, buckets))) if sampled else []
    bounds = [F.struct(*[F.lit(v).cast(t).alias(n) for v, t, n in zip(row, kinds, names, strict=True)]) for row in picked]
    return _place(F.struct(*[F.col(c).alias(n) for c, n in zip(order, names, strict=True)]), bounds)


def index_classes(df: DataFrame, name_col: str, label_col: str = "label", bucket_names: int = BUCKET_NAMES) -> DataFrame:
    """`df` with the 0-based place of its class name in sorted order; a null name has a null label.

    Names are numbered in ranges between sampled names, so names of one beginning spread too.
    """
    (_name,) = free_names([*df.columns, label_col], "_name")
    names = df.select(F.col(name_col).alias(_name)).where(F.col(_name).isNotNull()).distinct()
    n = names.count()
    places = numbered(names, [], [F.col(_name)], order_bucket(names, [_name], buckets_for(n, bucket_names), n), label_col)
    places = places.select(_name, (F.col(label_col) - 1).cast("int").alias(label_col))
    return df.join(F.broadcast(places) if n <= BROADCAST_CLASSES else places, df[name_col] == places[_name], "left").drop(_name)


def _hashed(df: DataFrame, keys: list[str], drawn: Column, id_col: str, place: str, size: str) -> DataFrame:
    """`df` numbered by a draw, then by id."""
    (_h,) = free_names([*df.columns, place, size], "_h")
    rows = df.withColumn(_h, drawn)
    return numbered(rows, keys, [F.col(_h), F.col(id_col)], hash_bucket(F.col(_h), hash_digits(df.count())), place, size).drop(_h)


def _in_order(df: DataFrame, keys: list[str], id_col: str, place: str, size: str) -> DataFrame:
    """`df` numbered by an id of any sortable type."""
    n = df.count()
    return numbered(df, keys, [F.col(id_col)], order_bucket(df, [id_col], buckets_for(n), n), place, size)


def stratified_split(df: DataFrame, class_col: str, id_col: str, ratio: float = 0.8, order: str = "hash", seed: int = 0, split_col: str = "split") -> DataFrame:
    """`df` with `split` = train for the first floor(ratio * n) rows of each class, else test.

    order="hash": by md5 of seed and id, then id; order="index": by id.  Both are deterministic, so
    the two sides never overlap.  A class of one row goes to test.  Rows of a null class are a class; null ids come first.
    """
    _place_, _size = free_names(df.columns, "_place", "_size")
    if order == "hash":
        rows = _hashed(df, [class_col], draw(seed, F.col(id_col)), id_col, _place_, _size)
    elif order == "index":
        rows = _in_order(df, [class_col], id_col, _place_, _size)
    else:
        raise ValueError(f"unknown order {order}")
    train = F.col(_place_) <= F.floor(F.col(_size) * F.lit(ratio))
    return rows.withColumn(split_col, F.when(train, "train").otherwise("test")).drop(_place_, _size)


def split_overlap(train: DataFrame, test: DataFrame, id_col: str) -> DataFrame:
    """Rows of `test` whose id is also in `train`; none in a sound split."""
    return test.join(train.select(id_col).distinct(), id_col, "left_semi")


def dataset_info(files: DataFrame, classes: DataFrame, class_col: str) -> DataFrame:
    """Files per class, 0 for classes without files."""
    counts = files.groupBy(class_col).agg(F.count("*").alias("n_files"))
    return classes.select(class_col).distinct().join(counts, class_col, "left").select(class_col, F.coalesce("n_files", F.lit(0)).alias("n_files"))


def shuffle_rows(df: DataFrame, id_col: str, seed: int = 0, epoch: int = 0) -> DataFrame:
    """All rows in an order that changes with seed and epoch; a range shuffle by hash, no single task."""
    return df.orderBy(draw(seed, epoch, F.col(id_col)), F.col(id_col))


def batch_rows(df: DataFrame, id_col: str, batch_size: int, seed: int = 0, epoch: int = 0, shuffle: bool = True, drop_last: bool = False) -> DataFrame:
    """`df` with batch_idx and image_idx (place in the batch); `drop_last` leaves a last partial batch out.

    Without shuffle the order is that of the id, of any sortable type; null ids come first.
    """
    _place_, _size = free_names(df.columns, "_place", "_size")
    if shuffle:
        rows = _hashed(df, [], draw(seed, epoch, F.col(id_col)), id_col, _place_, _size)
    else:
        rows = _in_order(df, [], id_col, _place_, _size)
    place = F.col(_place_) - 1
    out = rows.withColumns({"batch_idx": F.floor(place / batch_size), "image_idx": (place % batch_size).cast("int")})
    if drop_last:
        out = out.where((F.col("batch_idx") + 1) * batch_size <= F.col(_size))
    return out.drop(_place_, _size)


def preview(df: DataFrame, key: str, n: int = 16) -> DataFrame:
    """The first n rows by key."""
    return df.orderBy(key).limit(n)


def every_nth(df: DataFrame, index_col: str, n: int) -> DataFrame:
    return df.where(F.col(index_col) % n == 0)


def first_batches(df: DataFrame, k: int = 4, batch_col: str = "batch_idx") -> DataFrame:
    return df.where(F.col(batch_col) < k)


def checkpoint_epochs(df: DataFrame, every: int = 50, epoch_col: str = "epoch") -> DataFrame:
    return df.where((F.col(epoch_col) + 1) % every == 0)
