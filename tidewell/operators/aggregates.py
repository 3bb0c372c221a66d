"""Aggregations of the engine: statistics, dictionaries, histograms, layouts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewell.operators.sequence import ordered, so_far


def level_stats(df: DataFrame, keys: list[str], level: str, cost: str, order: list[str]) -> DataFrame:
    """Smallest and mean level and the peak cost of each group, and the rows (by the last order
    column) where the extremes lie: the last of equals."""
    last = [F.col(c) for c in order]
    out = df.groupBy(*keys).agg(
        F.min(F.struct(F.col(level), *[-c for c in last])).alias("_low"), F.round(F.avg(level), 6).alias(f"avg_{level}"), F.max(F.struct(F.col(cost), *last)).alias("_high")
    )
    low, high = out.select("_low.*").columns, out.select("_high.*").columns
    return out.select(*keys, F.col(f"_low.{low[0]}").alias(f"min_{level}"), f"avg_{level}", F.col(f"_high.{high[0]}").alias(f"peak_{cost}"), (-F.col("_low").getField(low[-1])).alias("min_event"), F.col("_high").getField(high[-1]).alias("peak_event"))


def sequences(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """How often each ordered sequence of values occurs: seq (joined by commas) and n. A sequence is
    as long as its group, so groups have to be bounded (lines of an order, frames of an epoch)."""
    rows = F.array_sort(F.collect_list(F.struct(*order, F.col(value).alias("_v"))))
    return df.groupBy(*keys).agg(F.array_join(F.transform(rows, lambda r: r["_v"].cast("string")), ",").alias("seq")).groupBy("seq").agg(F.count("*").alias("n"))


def top_ranked(df: DataFrame, descending: list[str], ascending: list[str], k: int) -> DataFrame:
    """The first k rows, numbered from 1 on. Only k rows reach the task that numbers them."""
    order = [F.desc(c) for c in descending] + [F.asc(c) for c in ascending]
    return df.orderBy(*order).limit(k).withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def colour_histogram(df: DataFrame, bits: int = 5) -> DataFrame:
    """Count, sums and sum of squares of colours (r, g, b) in bins of their first bits."""
    b = [F.shiftright(F.col(c).cast("bigint"), 8 - bits).alias(f"{c}b") for c in "rgb"]
    r = [F.col(c).cast("bigint") for c in "rgb"]
    return df.groupBy(*b).agg(F.count("*").alias("n"), *[F.sum(c).alias(f"s{x}") for c, x in zip(r, "rgb")], F.sum(r[0] * r[0] + r[1] * r[1] + r[2] * r[2]).alias("m2"))


def summed_volume(df: DataFrame, axes: list[str], value: str, size: int) -> DataFrame:
    """Sums over all cells up to each cell of a full cube of `size` steps an axis: one running window
    for each axis. The cube has a fixed number of cells, whatever the number of rows."""
    spark = df.sparkSession
    cube = spark.range(size ** len(axes))
    for i, a in enumerate(axes):
        cube = cube.withColumn(a, F.pmod(F.floor(F.col("id") / size**i), F.lit(size)).cast("bigint"))
    out = cube.drop("id").join(df.select(*axes, value), axes, "left").withColumn("volume", F.coalesce(value, F.lit(0)))
    for a in axes:
        out = out.withColumn("volume", F.sum("volume").over(so_far([x for x in axes if x != a], [a])))
    return out.select(*axes, "volume")


def widest_dimension(df: DataFrame, label: str, vector: str, weight: str) -> DataFrame:
    """For each cluster its weight and the dimension with the largest weighted mean absolute
    deviation from the weighted mean; the smallest of equal dimensions."""
    each = df.select(label, F.col(weight).alias("_w"), F.posexplode(vector).alias("_dim", "_v")).withColumn("_v", F.col("_v").cast("double"))
    mean = each.groupBy(label, "_dim").agg(F.sum("_w").alias("weight"), (F.sum(F.col("_w") * F.col("_v")) / F.sum("_w")).alias("_mean"))
    spread = each.join(mean, [label, "_dim"]).groupBy(label, "_dim").agg(F.first("weight").alias("weight"), F.round(F.sum(F.col("_w") * F.abs(F.col("_v") - F.col("_mean"))) / F.sum("_w"), 6).alias("_mad"))
    best = spread.groupBy(label).agg(F.first("weight").alias("weight"), F.max(F.struct("_mad", (-F.col("_dim")).alias("_d"))).alias("_best"))
    return best.select(F.col(label).cast("bigint").alias(label), F.col("weight").cast("bigint").alias("weight"), (-F.col("_best._d")).cast("bigint").alias("widest"), F.col("_best._mad").alias("mad"))


def ssim(df: DataFrame, ident: str, u: str, v: str, scale: float = 1.0) -> DataFrame:
    """Structural similarity of two arrays taken as one tile, with population variances, from the sums
    of one pass over each pair."""
    c1, c2 = (0.01 * 255) ** 2, (0.03 * 255) ** 2
    up = lambda a: F.transform(a, lambda x: x.cast("double") * scale)
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    base = df.select(ident, up(u).alias("_u"), up(v).alias("_v")).withColumn("_n", F.size("_u")).withColumn("_mu", total("_u") / F.col("_n")).withColumn("_mv", total("_v") / F.col("_n"))
    moment = lambda a, b, ma, mb: total(F.zip_with(a, b, lambda x, y: (x - F.col(ma)) * (y - F.col(mb)))) / F.col("_n")
    s = base.withColumn("_vu", moment("_u", "_u", "_mu", "_mu")).withColumn("_vv", moment("_v", "_v", "_mv", "_mv")).withColumn("_c", moment("_u", "_v", "_mu", "_mv"))
    mu, mv = F.col("_mu"), F.col("_mv")
    value = ((2 * mu * mv + c1) * (2 * F.col("_c") + c2)) / ((mu * mu + mv * mv + c1) * (F.col("_vu") + F.col("_vv") + c2))
    return s.select(ident, F.round(value, 6).alias("ssim"))


def area_weighted(df: DataFrame, keys: list[str], area: Column, score: Column) -> DataFrame:
    return df.groupBy(*keys).agg(F.round(F.sum(area * score).cast("double") / F.sum(area), 6).alias("score"))


def best_cut(mask: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """The cut of a set of pixels into the columns before and from `cut` on that makes the bounding
    boxes of both smallest together; the first of equals. Extents of all columns before and after a
    cut are running windows over one row for each column, not over pixels."""
    columns = mask.groupBy(*keys, x).agg(F.min(y).alias("_lo"), F.max(y).alias("_hi"))
    w = ordered(keys, [x])
    before, after, whole = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(1, Window.unboundedFollowing), w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = columns.select(*keys, F.col(x), F.lead(x).over(w).alias("_next"), F.min(x).over(before).alias("_x0"), F.min("_lo").over(before).alias("_l0"), F.max("_hi").over(before).alias("_h0"), F.min("_lo").over(after).alias("_l1"), F.max("_hi").over(after).alias("_h1"), F.max(x).over(whole).alias("_x1"))
    size = (F.col(x) - F.col("_x0") + 1) * (F.col("_h0") - F.col("_l0") + 1) + (F.col("_x1") - F.col("_next") + 1) * (F.col("_h1") - F.col("_l1") + 1)
    best = s.filter("_next is not null").groupBy(*keys).agg(F.min(F.struct(size.alias("area"), F.col("_next").alias("cut"))).alias("_b"))
    return best.select(*keys, F.col("_b.cut").alias("cut"), F.col("_b.area").alias("area"))


def run_lengths(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Runs of equal values: keys, run (from 1 on), value, length."""
    w = ordered(keys, order)
    new = F.when(F.col(value).eqNullSafe(F.lag(value).over(w)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    runs = df.withColumn("_new", new).withColumn("run", F.sum("_new").over(so_far(keys, order)).cast("bigint"))
    return runs.groupBy(*keys, "run").agg(F.first(value).alias(value), F.count("*").alias("length"))


def fragments(df: DataFrame, ident: str, size: str, first: int, others: int) -> DataFrame:
    """Cuts payloads of `size` units into a first fragment and others of their own limits."""
    n = F.col(size)
    more = F.when(n <= first, F.lit(0).cast("bigint")).otherwise(F.call_function("div", n - first + (others - 1), F.lit(others).cast("bigint")))
    out = df.withColumn("_m", more).withColumn("fragment", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_m"))))
    i = F.col("fragment")
    start = F.when(i == 0, F.lit(0).cast("bigint")).otherwise(first + (i - 1) * others)
    length = F.when(i == 0, F.least(n, F.lit(first).cast("bigint"))).otherwise(F.least(n - start, F.lit(others).cast("bigint")))
    return out.select(ident, "fragment", start.alias("start"), length.alias("size"), (i == 0).alias("is_first"), (i == F.col("_m")).alias("is_last"))
