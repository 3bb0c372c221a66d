"""Operators over ordered rows. All of them take column names, need a total order, and partition by
keys, so that they run on segments of a stream and on any other table alike."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from tidewell.functions.ticks import WRAP


def ordered(keys: list[str], order: list[str]) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(*order)


def so_far(keys: list[str], order: list[str]) -> WindowSpec:
    return ordered(keys, order).rowsBetween(Window.unboundedPreceding, 0)


def gap_groups(df: DataFrame, keys: list[str], order: list[str], start: str, end: str, tolerance: int, name: str = "group_id") -> DataFrame:
    """Numbers runs of rows from 0 on: a row joins while its start is less than `tolerance` after the
    end of the row before (that row's, not the latest so far; a negative gap joins)."""
    gap = F.col(start) - F.lag(end).over(ordered(keys, order))
    return df.withColumn("_new", F.when(gap >= tolerance, 1).otherwise(0)).withColumn(name, F.sum("_new").over(so_far(keys, order))).drop("_new")


def opened_sets(df: DataFrame, keys: list[str], order: list[str], opens: Column, closes: Column, name: str = "set_id") -> DataFrame:
    """Numbers runs from 0 on: a run starts at a row that opens or after one that closes."""
    w = ordered(keys, order)
    first = F.row_number().over(w) == 1
    new = F.when(~first & (opens | F.coalesce(F.lag(closes).over(w), F.lit(False))), 1).otherwise(0)
    return df.withColumn("_new", new).withColumn(name, F.sum("_new").over(so_far(keys, order))).drop("_new")


def epochs_of(df: DataFrame, keys: list[str], order: list[str], starts: Column, name: str = "epoch_id") -> DataFrame:
    """Numbers runs that begin at rows with `starts`; rows before the first of them are run 0, and
    without such rows run 0 is the first one."""
    w = ordered(keys, order)
    new = F.when(starts & (F.row_number().over(w) > 1), 1).otherwise(0)
    return df.withColumn("_new", new).withColumn(name, F.sum("_new").over(so_far(keys, order))).drop("_new")


def fold_runs(df: DataFrame, keys: list[str], order: list[str], same: list[str], start: str, end: str, touching: bool = True, first: list[str] | None = None) -> DataFrame:
    """One row per run of rows that agree in `same` and, if touching, follow each other without a
    gap: keys, same, the columns `first` of its first row, the first start, the last end, and
    `run_length`."""
    w = ordered(keys, order)
    equal = F.lit(True)
    for c in same:
        equal = equal & F.col(c).eqNullSafe(F.lag(c).over(w))
    if touching:
        equal = equal & (F.lag(end).over(w) == F.col(start))
    new = F.when((F.row_number().over(w) > 1) & equal, 0).otherwise(1)
    runs = df.withColumn("_new", new).withColumn("_run", F.sum("_new").over(so_far(keys, order))).withColumn("_at", F.row_number().over(w))
    return runs.groupBy(*keys, "_run").agg(*[F.min_by(c, "_at").alias(c) for c in [*same, *(first or [])]], F.min_by(start, "_at").alias(start), F.max_by(end, "_at").alias(end), F.count("*").alias("run_length")).drop("_run")


def periodic_refreshes(df: DataFrame, start: str, end: str, period: Column | int, index: str = "k", flag: str = "copy") -> DataFrame:
    """Expands rows into pieces of `period`: n = (end - start) div period - 1 copies follow a row if
    n is at least 1, and the last keeps the end. A row of less than two periods stays whole."""
    p = period if isinstance(period, Column) else F.lit(period).cast("bigint")
    n = F.when(p >= 1, F.greatest(F.call_function("div", F.col(end) - F.col(start), p) - 1, F.lit(0).cast("bigint"))).otherwise(F.lit(0).cast("bigint"))
    pieces = df.withColumn("_n", n).withColumn("_p", p).withColumn(index, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_n"))))
    begin = F.col(start) + F.col(index) * F.col("_p")
    return pieces.withColumn("_b", begin).withColumn(end, F.when(F.col(index) < F.col("_n"), F.col("_b") + F.col("_p")).otherwise(F.col(end))).withColumn(start, F.col("_b")).withColumn(flag, F.col(index) > 0).drop("_b", "_n", "_p")


def gap_rows(df: DataFrame, keys: list[str], order: list[str], start: str, end: str) -> DataFrame:
    """A row for each gap between a row's end and the next row's start: keys, start, end."""
    following = F.lead(start).over(ordered(keys, order))
    return df.select(*keys, F.col(end).alias("_s"), following.alias("_e")).filter("_e > _s").select(*keys, F.col("_s").alias(start), F.col("_e").alias(end))


def leaky_bucket(df: DataFrame, keys: list[str], order: list[str], refill: str, cost: str, size: int, name: str = "level") -> DataFrame:
    """x = min(x + refill, size) - cost from a full bucket on, by two running windows: with R and C
    the sums so far, x_n = size + R_n - C_n + min(0, min over k <= n of (C_(k-1) - R_k))."""
    w = so_far(keys, order)
    sums = df.withColumn("_r", F.sum(refill).over(w)).withColumn("_c", F.sum(cost).over(w))
    low = F.min(F.col("_c") - F.col(cost) - F.col("_r")).over(w)
    return sums.withColumn(name, F.lit(size) + F.col("_r") - F.col("_c") + F.least(F.lit(0), low)).drop("_r", "_c")


def rolling_sum(df: DataFrame, keys: list[str], time: str, value: str, before: int, name: str = "rolling") -> DataFrame:
    """The sum over the rows of the last `before` units of time, both ends included."""
    return df.withColumn(name, F.sum(value).over(Window.partitionBy(*keys).orderBy(time).rangeBetween(-before, 0)))


def strictly_increasing(df: DataFrame, keys: list[str], order: list[str], value: str, name: str = "fixed") -> DataFrame:
    """d'_n = max(d_n, d'_(n-1) + 1): the running maximum of d_k - k, plus n."""
    w = ordered(keys, order)
    return df.withColumn("_n", F.row_number().over(w)).withColumn(name, F.max(F.col(value) - F.col("_n")).over(so_far(keys, order)) + F.col("_n")).drop("_n")


def wrapped_step(df: DataFrame, keys: list[str], order: list[str], value: str, name: str = "step", modulus: int = WRAP) -> DataFrame:
    """The step from the row before, modulo 2^32."""
    return df.withColumn(name, (F.col(value) - F.lag(value).over(ordered(keys, order))).bitwiseAND(F.lit(modulus - 1)))


def first_of_group(df: DataFrame, keys: list[str], order: list[str], column: str, name: str) -> DataFrame:
    return df.withColumn(name, F.first(column).over(so_far(keys, order)))


def latest_state(df: DataFrame, keys: list[str], order: list[str], value: Column, name: str, resets: Column | None = None) -> DataFrame:
    """As-of value: the last one that is not null, this row included, since the last reset."""
    by, out = keys, df
    if resets is not None:
        out = out.withColumn("_epoch", F.sum(F.when(resets, 1).otherwise(0)).over(so_far(keys, order)))
        by = [*keys, "_epoch"]
    return out.withColumn(name, F.last(value, ignorenulls=True).over(so_far(by, order))).drop("_epoch")


def changed_rows(df: DataFrame, keys: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """The rows that differ from the one before in one of the columns; first rows count as changed."""
    w = ordered(keys, order)
    changed = F.row_number().over(w) == 1
    for c in columns:
        changed = changed | ~F.col(c).eqNullSafe(F.lag(c).over(w))
    return df.withColumn("_changed", changed).filter("_changed").drop("_changed")


def alternating(df: DataFrame, keys: list[str], order: list[str], counts: Column, name: str = "slot") -> DataFrame:
    """0, 1, 0, 1, ...: the number of counted rows so far, modulo 2."""
    return df.withColumn(name, F.sum(F.when(counts, 1).otherwise(0)).over(so_far(keys, order)) % 2)


def numbered(df: DataFrame, keys: list[str], order: list[str], modulus: int, name: str) -> DataFrame:
    return df.withColumn(name, (F.row_number().over(ordered(keys, order)) - 1) % modulus)
