"""Run logs: running and epoch averages, best so far, throughput, trials, unions of runs.

Jobs over the order of a run (`running_average` to `progress_eta`) use one window per run while no run has more than
`run_rows` rows.  Longer runs are cut into ranges of their order: a range takes the fold of the run's earlier ranges and, where a
job looks back over a few rows, copies of the last rows before it.  So no task holds a run, whatever its share of the
table; only rows equal in all order columns stay together.  Null keys are a run; null orders come first; rows equal in the
order follow each other in any sequence.  An empty table gives an empty one, and columns of any name are kept, but for
those that have a result's name.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trainkit.functions.names import free_names
from trainkit.operators import split

RUN_ROWS = 1_000_000  # rows of a run that one task may hold
RANGES_A_RUN = 4  # ranges that RUN_ROWS rows are cut into


def _same(keys: list[str], others: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(o)) for k, o in zip(keys, others, strict=True)], F.lit(True))


def _ranged(df: DataFrame, keys: list[str], order: Sequence[str | Column], run_rows: int) -> tuple[DataFrame, str | None]:
    """`df` with a column of ranges and its name; `df` and None if no run is longer than `run_rows`, or an order isn't a column's name."""
    rng, _n = free_names(df.columns, "_range", "_n")
    if not all(isinstance(o, str) for o in order) or df.groupBy(*keys).agg(F.count("*").alias(_n)).where(F.col(_n) > run_rows).isEmpty():
        return df, None
    rows = df.count()
    buckets = split.buckets_for(rows, max(1, run_rows // RANGES_A_RUN))
    return df.withColumn(rng, split.order_bucket(df, order, buckets, rows)), rng


def _within(keys: list[str], rng: str | None, order: Sequence[str | Column]) -> Window:
    return Window.partitionBy(*keys, *([rng] if rng else [])).orderBy(*order)


def _carried(rows: DataFrame, keys: list[str], rng: str | None, order: Sequence[str | Column], values: dict[str, tuple[Callable, Column]], last: int = 0) -> DataFrame:
    """`rows` with a column per name: the fold (sum, minimum or maximum) of its value from the run's first row up to `last` rows after each."""
    window = _within(keys, rng, order).rowsBetween(Window.unboundedPreceding, last)
    inside = rows.withColumns({name: fold(value).over(window) for name, (fold, value) in values.items()})
    if rng is None:
        return inside
    _r, *rest = free_names(inside.columns, "_r", *[f"_k{i}" for i in range(len(keys))], *[f"_fold{i}" for i in range(len(values))], *[f"_earlier{i}" for i in range(len(values))])
    _k, _fold, _earlier = rest[: len(keys)], rest[len(keys) : len(keys) + len(values)], rest[len(keys) + len(values) :]
    ranges = rows.groupBy(*keys, rng).agg(*[fold(value).alias(a) for a, (fold, value) in zip(_fold, values.values(), strict=True)])
    earlier = Window.partitionBy(*keys).orderBy(rng).rowsBetween(Window.unboundedPreceding, -1)
    folds = [fold(a).over(earlier).alias(e) for a, e, (fold, _) in zip(_fold, _earlier, values.values(), strict=True)]
    before = ranges.select(*[F.col(k).alias(a) for k, a in zip(keys, _k, strict=True)], F.col(rng).alias(_r), *folds)
    joined = inside.join(split.small(before, 100_000), (F.col(rng) == F.col(_r)) & _same(keys, _k))
    whole = joined.withColumns({name: fold_pair(fold, F.col(e), F.col(name)) for e, (name, (fold, _)) in zip(_earlier, values.items(), strict=True)})
    return whole.drop(_r, *_k, *_earlier)


def fold_pair(fold: Callable, a: Column, b: Column) -> Column:
    """The fold of two folds; a null one counts for nothing."""
    return F.greatest(a, b) if fold is F.max else F.least(a, b) if fold is F.min else F.coalesce(a + b, a, b)


def _with_halo(rows: DataFrame, keys: list[str], rng: str, order: list[str], width: int) -> tuple[DataFrame, str]:
    """`rows`, every range of a run preceded by copies of the `width` rows before it (all, if fewer), and the name of the column that marks the copies.

    They come from at most `width` earlier ranges, as none is empty.
    """
    halo, _n, _at, _end, _last, _to, _r, _at2, _start2, *_k = free_names(rows.columns, "_halo", "_n", "_at", "_end", "_last", "_to", "_r", "_at2", "_start2", *[f"_k{i}" for i in range(len(keys))])
    along = Window.partitionBy(*keys).orderBy(rng)
    counts = rows.groupBy(*keys, rng).agg(F.count("*").alias(_n))
    counts = counts.select(*[F.col(k).alias(a) for k, a in zip(keys, _k, strict=True)], F.col(rng).alias(_r), F.row_number().over(along).alias(_at), F.sum(_n).over(along.rowsBetween(Window.unboundedPreceding, 0)).alias(_end), F.col(_n))
    backwards = Window.partitionBy(*keys, rng).orderBy(*[F.col(o).desc_nulls_last() for o in order])
    tails = rows.withColumn(_last, F.row_number().over(backwards)).where(F.col(_last) <= width)
    placed = tails.join(split.small(counts.drop(_n), 100_000), (F.col(rng) == F.col(_r)) & _same(keys, _k)).drop(_r, *_k)
    later = counts.select(*_k, F.col(_r), F.col(_at).alias(_at2), (F.col(_end) - F.col(_n)).alias(_start2))
    sent = placed.withColumn(_to, F.explode(F.sequence(F.col(_at) + 1, F.col(_at) + width)))
    near = F.col(_start2) - F.col(_end) + F.col(_last) <= width
    received = sent.join(split.small(later, 100_000), (F.col(_to) == F.col(_at2)) & _same(keys, _k)).where(near).withColumn(rng, F.col(_r))
    copies = received.select(*[F.col(f"`{c}`") for c in rows.columns], F.lit(True).alias(halo))
    return rows.withColumn(halo, F.lit(False)).unionByName(copies), halo


def _looking_back(rows: DataFrame, keys: list[str], rng: str | None, order: list[str], width: int, steps: Callable[[DataFrame, Window], DataFrame]) -> DataFrame:
    """`steps` applied with a window of the order in which every row sees at least `width` rows before it."""
    if rng is None:
        return steps(rows, _within(keys, None, order))
    extended, halo = _with_halo(rows, keys, rng, order, width)
    return steps(extended, _within(keys, rng, order)).where(~F.col(halo)).drop(halo)


def _dropped(df: DataFrame, rng: str | None, *names: str) -> DataFrame:
    return df.drop(*names, *([rng] if rng else []))


def running_average(df: DataFrame, keys: list[str], order: list[str], val: str, n: str, run_rows: int = RUN_ROWS) -> DataFrame:
    """`df` with the weighted sum, count and average up to each row; null average while the weights are 0. Null values and weights count for nothing."""
    rows, rng = _ranged(df, keys, order, run_rows)
    out = _carried(rows, keys, rng, order, {"run_sum": (F.sum, F.col(val) * F.col(n)), "run_count": (F.sum, F.col(n))})
    return _dropped(out.withColumn("run_avg", F.when(F.col("run_count") != 0, F.col("run_sum") / F.col("run_count"))), rng)


def running_accuracy(df: DataFrame, keys: list[str], order: list[str], correct: str, total: str, run_rows: int = RUN_ROWS) -> DataFrame:
    """`df` with the percentage of correct items up to each row; null while there are none."""
    rows, rng = _ranged(df, keys, order, run_rows)
    _right, _seen = free_names(rows.columns, "_right", "_seen")
    out = _carried(rows, keys, rng, order, {_right: (F.sum, F.col(correct)), _seen: (F.sum, F.col(total))})
    return _dropped(out.withColumn("run_accuracy", F.when(F.col(_seen) != 0, F.lit(100.0) * F.col(_right) / F.col(_seen))), rng, _right, _seen)


def best_so_far(df: DataFrame, keys: list[str], order: list[str], metric: str, run_rows: int = RUN_ROWS) -> DataFrame:
    """`df` with is_best (strictly above everything before, starting from 0) and best (the running maximum); a null metric is never best."""
    rows, rng = _ranged(df, keys, order, run_rows)
    (_previous,) = free_names(rows.columns, "_previous")
    out = _carried(rows, keys, rng, order, {_previous: (F.max, F.col(metric))}, last=-1)
    out = out.withColumn(_previous, F.greatest(F.lit(0.0), F.coalesce(_previous, F.lit(0.0))))
    return _dropped(out.withColumn("is_best", F.col(metric) > F.col(_previous)).withColumn("best", F.greatest(_previous, metric)), rng, _previous)


def _micros(ts: str) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


def step_times(df: DataFrame, keys: list[str], ts: str, run_rows: int = RUN_ROWS) -> DataFrame:
    """`df` with seconds since the previous row and their mean so far; both null on a run's first row."""
    rows, rng = _ranged(df, keys, [ts], run_rows)
    _s, _sum, _n = free_names(rows.columns, "_s", "_sum", "_n")
    out = _looking_back(rows.withColumn(_s, _micros(ts) / 1e6), keys, rng, [ts], 1, lambda x, w: x.withColumn("step_s", F.col(_s) - F.lag(_s).over(w)))
    out = _carried(out, keys, rng, [ts], {_sum: (F.sum, F.col("step_s")), _n: (F.sum, F.col("step_s").isNotNull().cast("long"))})
    return _dropped(out.withColumn("avg_step_s", F.when(F.col(_n) > 0, F.col(_sum) / F.col(_n))), rng, _s, _sum, _n)


def _item_times(rows: DataFrame, keys: list[str], rng: str | None, ts: str, n: str | None, window: int) -> DataFrame:
    (_s,) = free_names(rows.columns, "_s")
    items = F.col(n) if n else F.lit(1)

    def steps(x: DataFrame, w: Window) -> DataFrame:
        x = x.withColumn("item_s", F.when(items > 0, (F.col(_s) - F.lag(_s).over(w)) / items))
        return x.withColumn("sma_s", F.avg("item_s").over(w.rowsBetween(1 - window, 0)))

    return _looking_back(rows.withColumn(_s, _micros(ts) / 1e6), keys, rng, [ts], window, steps).drop(_s)


def throughput_sma(df: DataFrame, keys: list[str], ts: str, n: str | None = None, window: int = 10, run_rows: int = RUN_ROWS) -> DataFrame:
    """`df` with seconds per item and their mean over the last `window` rows; rows without items have null seconds, which the mean leaves out."""
    rows, rng = _ranged(df, keys, [ts], run_rows)
    return _dropped(_item_times(rows, keys, rng, ts, n, window), rng)


def progress_eta(df: DataFrame, keys: list[str], ts: str, total: int, window: int = 10, run_rows: int = RUN_ROWS) -> DataFrame:
    """`df` with step number, progress (at most 1), percent, remaining steps, ETA and elapsed time in whole seconds."""
    rows, rng = _ranged(df, keys, [ts], run_rows)
    out = _item_times(rows, keys, rng, ts, None, window)
    (_first,) = free_names(out.columns, "_first")
    out = _carried(out, keys, rng, [ts], {"step": (F.sum, F.lit(1).cast("long")), _first: (F.min, _micros(ts))})
    out = out.withColumn("progress", F.least(F.lit(1.0), F.col("step") / float(total)))
    out = out.withColumn("percent", F.col("progress") * 100.0).withColumn("remaining", F.greatest(F.lit(total) - F.col("step"), F.lit(0)).cast("long"))
    out = out.withColumn("eta_s", F.ceil(F.coalesce("sma_s", F.lit(0.0)) * F.col("remaining")).cast("long"))
    return _dropped(out.withColumn("elapsed_s", F.floor((_micros(ts) - F.col(_first)) / 1e6).cast("long")), rng, _first)


def weighted_epoch_means(df: DataFrame, keys: list[str], val: str, n: str) -> DataFrame:
    """Sum(val * n) / sum(n) per key; null where the weights sum to 0."""
    weight = F.sum(n)
    return df.groupBy(*keys).agg(F.when(weight != 0, F.sum(F.col(val) * F.col(n)) / weight).alias("mean"))


def epoch_means(df: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """Plain means of every metric over the rows of a key."""
    return df.groupBy(*keys).agg(*[F.avg(m).alias(m) for m in metrics])


def critic_iteration_means(df: DataFrame, metrics: list[str], keys: Sequence[str] = ("run", "epoch", "step")) -> DataFrame:
    """Means over the critic's inner iterations of a step."""
    return epoch_means(df, list(keys), metrics)


def combine_step_metrics(critic: DataFrame, generator: DataFrame, keys: Sequence[str] = ("run", "epoch", "step")) -> DataFrame:
    """Both sides' metrics of the same step."""
    return critic.join(generator, list(keys))


def trial_loss(df: DataFrame, trial: str, epoch: str, loss: str, mode: str = "reference") -> DataFrame:
    """(trial, loss): the sum over all batches divided by the batches of an epoch; mode="mean" also by the epochs."""
    per_epoch = df.groupBy(trial, epoch).agg(F.sum(loss).alias("_sum"), F.count("*").alias("_batches"))
    value = F.sum("_sum") / F.max("_batches")
    if mode == "mean":
        value = value / F.count("*")
    elif mode != "reference":
        raise ValueError(f"unknown mode {mode}")
    return per_epoch.groupBy(trial).agg(value.alias("loss"))


def hyperparameter_grid(spark: SparkSession, **lists: Sequence) -> DataFrame:
    """(trial_id, one column per list): the product in the order of nested loops, the last list fastest."""
    total, columns = reduce(lambda a, v: a * len(v), lists.values(), 1), []
    step = total
    for name, values in lists.items():
        step //= len(values)
        place = F.floor(F.col("trial_id") / step) % len(values) + 1
        columns.append(F.element_at(F.array(*[F.lit(v) for v in values]), place.cast("int")).alias(name))
    return spark.range(total).withColumnRenamed("id", "trial_id").select("trial_id", *columns)


def best_trial(df: DataFrame, trial: str, loss: str, params: list[str]) -> DataFrame:
    """One row: the parameters of the trial with the lowest loss, the first one on ties; trials without a loss are left out."""
    best = F.min_by(F.struct(trial, loss, *params), F.struct(loss, trial))
    return df.where(F.col(loss).isNotNull()).agg(best.alias("b")).select("b.*")


def best_epoch(df: DataFrame, keys: list[str], metric: str, epoch: str) -> DataFrame:
    """Best value of a metric per run, and the first epoch that reached it."""
    order = F.struct((-F.col(metric)).alias("m"), F.col(epoch).alias("e"))
    return df.where(F.col(metric).isNotNull()).groupBy(*keys).agg(F.max(metric).alias("best"), F.min_by(epoch, order).alias("best_epoch"))


def union_runs(runs: dict[str, DataFrame], epoch: str, metrics: list[str]) -> DataFrame:
    """(series, epoch, value) of several logs; a series is named title(metric)."""
    parts = [df.select(F.lit(title).alias("title"), F.col(epoch).alias("epoch"), *metrics) for title, df in runs.items()]
    whole = reduce(lambda a, b: a.unionByName(b), parts)
    long = whole.unpivot(["title", "epoch"], metrics, "metric", "value")
    return long.select(F.concat("title", F.lit("("), "metric", F.lit(")")).alias("series"), "epoch", "value")


def scalar_log(df: DataFrame, model: str, data: str, step: str, metrics: list[str]) -> DataFrame:
    """Wide metrics -> (tag, step, value); a tag is model_data/metric."""
    long = df.select(F.col(step).alias("step"), *metrics).unpivot(["step"], metrics, "metric", "value")
    return long.select(F.concat(F.lit(f"{model}_{data}/"), F.col("metric")).alias("tag"), "step", "value")
