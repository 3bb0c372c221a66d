"""The engine's display sets, census and rules on streams that are made of a table: every supplier is a
stream, every line item of it a display set, whose fields come from the row by arithmetic, wrong ones among
them. The segments have the columns that reading a stream gives, so the plans are those of `inspect`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewell.plans import inspect
from tidewell.sources import codec

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file, seg_ord, type, pts, dts, size, pcs, wds, pds of the streams."""
    line = ["l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice"]
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_suppkey", *line)
    n = F.row_number().over(Window.partitionBy("l_suppkey").orderBy(*line)) - 1
    rows = rows.select(F.col("l_suppkey").cast("string").alias("file"), n.cast("bigint").alias("n"), F.col("l_orderkey").alias("k"), F.col("l_partkey").alias("p"))
    p, k, n = F.col("p"), F.col("k"), F.col("n")
    every = lambda m: p % m == 0
    number = lambda c: c.cast("int")
    one = F.struct(F.lit(0).alias("o_id"), F.lit(0).alias("window_id"))
    objects = F.slice(F.array_repeat(one, 3), 1, number(F.when(every(41), 0).otherwise(p % 4)))
    state = F.when(n % 7 == 0, codec.EPOCH_START).when(every(11), codec.ACQUISITION).otherwise(codec.NORMAL)
    pcs = F.struct(
        F.lit(1920).alias("width"), F.lit(1080).alias("height"), F.lit(0x20).alias("fps"), number((n + F.when(every(17), 1).otherwise(0)) % 65_536).alias("number"), state.alias("state"), every(13).alias("pal_flag"),
        number(p % 9).alias("pal_id"), number(p % 4).alias("n_objects"), objects.alias("objects"),
    )
    window = lambda i: F.struct(number(i).alias("window_id"), number(k * 37 % 1_900 + i * 50).alias("x"), number(k * 91 % 1_000).alias("y"), number(F.lit(20) + p % 60).alias("w"), number(F.lit(30) + i).alias("h"))
    wds = F.transform(F.sequence(F.lit(0), number(p % 3)), window)
    colour = lambda a: F.struct(number(F.lit(10) + p % 240).alias("y"), number(F.lit(16) + k % 230).alias("cr"), number(F.lit(16) + k % 227).alias("cb"), F.lit(a).alias("a"))
    entry = lambda i, a: F.struct(number(i), colour(a))
    entries = F.map_from_entries(F.concat(F.array(*[entry(p % 250 + i, 255) for i in (0, 1, 5)]), F.slice(F.array(entry(F.lit(255), 10)), 1, F.when(every(47), 1).otherwise(0))))
    pds = F.struct(number(p % 9).alias("id"), number(F.when(every(7), 5).otherwise(n % 256)).alias("version"), entries.alias("entries"))
    parts = [
        (codec.WINDOWS, (p % 5 != 0) & every(19)), (codec.COMPOSITION, p % 23 != 0), (codec.WINDOWS, (p % 5 != 0) & ~every(19)), (codec.PALETTE, p % 3 != 0), (codec.PALETTE, every(37)), (codec.OBJECT, every(2)), (codec.END, p % 29 != 0),
    ]
    kinds = F.filter(F.array(*[F.struct(F.lit(i).alias("i"), F.when(there, F.lit(kind)).alias("type")) for i, (kind, there) in enumerate(parts)]), lambda x: x["type"].isNotNull())
    pts = (n + 10) * 9_000 - F.when(every(31), 9_000).otherwise(0)
    each = rows.select("file", "n", "k", "p", kinds.alias("s"), pcs.alias("pcs"), wds.alias("wds"), pds.alias("pds"), pts.alias("pts")).withColumn("s", F.explode("s"))
    own = lambda kind, c: F.when(F.col("s.type") == kind, F.col(c)).alias(c)
    return each.select(
        "file", (n * 8 + F.col("s.i")).alias("seg_ord"), F.col("s.type").cast("smallint").alias("type"), "pts", (F.col("pts") - p % 100 * 60 - 1).alias("dts"), number(k % 50 + 11).alias("size"),
        own(codec.COMPOSITION, "pcs"), own(codec.WINDOWS, "wds"), own(codec.PALETTE, "pds"),
    )


#: The same segments, their display sets (s, d, p: those with a PCS) and epochs.
_SETS = """
    l AS (SELECT CAST(l_suppkey AS VARCHAR) AS file, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice) - 1 AS n, l_orderkey AS k, l_partkey AS p FROM lineitem),
    kinds AS (
        SELECT *, 0 AS i, 23 AS type FROM l WHERE p % 5 <> 0 AND p % 19 = 0 UNION ALL SELECT *, 1, 22 FROM l WHERE p % 23 <> 0 UNION ALL SELECT *, 2, 23 FROM l WHERE p % 5 <> 0 AND p % 19 <> 0
        UNION ALL SELECT *, 3, 20 FROM l WHERE p % 3 <> 0 UNION ALL SELECT *, 4, 20 FROM l WHERE p % 37 = 0 UNION ALL SELECT *, 5, 21 FROM l WHERE p % 2 = 0 UNION ALL SELECT *, 6, 128 FROM l WHERE p % 29 <> 0),
    g AS (
        SELECT file, n, k, p, n * 8 + i AS seg_ord, type, (n + 10) * 9000 - CASE WHEN p % 31 = 0 THEN 9000 ELSE 0 END AS pts, (n + 10) * 9000 - CASE WHEN p % 31 = 0 THEN 9000 ELSE 0 END - p % 100 * 60 - 1 AS dts, k % 50 + 11 AS size,
               CASE WHEN type = 22 THEN CASE WHEN n % 7 = 0 THEN 128 WHEN p % 11 = 0 THEN 64 ELSE 0 END END AS state FROM kinds),
    f AS (SELECT *, CASE WHEN row_number() OVER w > 1 AND (type = 22 OR lag(type) OVER w = 128) THEN 1 ELSE 0 END AS fresh FROM g WINDOW w AS (PARTITION BY file ORDER BY seg_ord)),
    s0 AS (SELECT *, CAST(sum(fresh) OVER (PARTITION BY file ORDER BY seg_ord) AS BIGINT) AS ds FROM f),
    s AS (SELECT *, row_number() OVER (PARTITION BY file, ds ORDER BY seg_ord) - 1 AS pos FROM s0),
    d0 AS (
        SELECT file, ds, count(*) AS n_segments, sum(size + 13) AS bytes, count(*) FILTER (type = 128) AS n_end, count(*) FILTER (type = 23) AS n_wds, count(*) FILTER (type = 21) AS n_ods, count(*) FILTER (type = 20) AS n_pds, count(*) FILTER (type = 22) AS n_pcs,
               arg_min(state, seg_ord) FILTER (type = 22) AS state, arg_min(n, seg_ord) FILTER (type = 22) AS cn, arg_min(p, seg_ord) FILTER (type = 22) AS cp, arg_min(pts, seg_ord) FILTER (type = 22) AS pts, arg_min(dts, seg_ord) FILTER (type = 22) AS dts,
               arg_min(p, seg_ord) FILTER (type = 23) AS wp, arg_min(k, seg_ord) FILTER (type = 23) AS wk, min(pos) FILTER (type = 23) AS wds_at, arg_min(type, seg_ord) AS first_type, arg_max(type, seg_ord) AS last_type
        FROM s GROUP BY file, ds),
    d1 AS (SELECT *, (cn + CASE WHEN cp % 17 = 0 THEN 1 ELSE 0 END) % 65536 AS number, cp % 13 = 0 AS flag, coalesce(state & 128, 0) <> 0 AS starts, max(ds) OVER (PARTITION BY file) AS last_ds FROM d0),
    d AS (SELECT *, CAST(sum(CASE WHEN starts AND rn > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY file ORDER BY ds) AS BIGINT) AS epoch FROM (SELECT *, row_number() OVER (PARTITION BY file ORDER BY ds) AS rn FROM d1)),
    p AS (SELECT * FROM d WHERE state IS NOT NULL)"""


@query(f"""
    WITH {_SETS},
    own AS (SELECT *, first_value(wp) OVER (PARTITION BY file, epoch ORDER BY ds) AS w0 FROM d),
    area AS (SELECT *, CASE WHEN w0 IS NULL THEN 0 ELSE list_sum(list_transform(range(0, w0 % 3 + 1), lambda i: ((20 + w0 % 60) * (30 + i) * 90000 + 31999999) // 32000000)) END AS ticks FROM own)
    SELECT file, greatest(count(*) FILTER (starts), 1) AS epochs, count(*) AS display_sets, CAST(sum(n_segments) AS BIGINT) AS segments, CAST(sum(bytes) AS BIGINT) AS bytes,
           CAST(sum(n_pcs) AS BIGINT) AS pcs, CAST(sum(n_wds) AS BIGINT) AS wds, CAST(sum(n_pds) AS BIGINT) AS pds, CAST(sum(n_ods) AS BIGINT) AS ods, CAST(sum(n_end) AS BIGINT) AS "end",
           count(*) FILTER (state = 128) AS es, count(*) FILTER (state = 64) AS acq, count(*) FILTER (coalesce(state, 0) = 0) AS nc,
           count(*) FILTER (NOT coalesce(flag AND state IS NOT NULL, false) AND coalesce(state, 0) = 0 AND n_wds > 0 AND n_ods > 0) AS nc_ods,
           count(*) FILTER (state IS NOT NULL AND flag) AS pu, count(*) FILTER (state IS NOT NULL AND flag AND ((pts - dts) & 4294967295) > ticks + 1) AS pu_buffered
    FROM area GROUP BY file
""")
def stream_census(spark, sf_dir):
    """AGG-01..03, GRP-03/05/08: the census of each stream."""
    return inspect.census(inspect.with_sets(segments(spark, sf_dir)))


def _told(parts: list[tuple[str, str, str, str]]) -> str:
    """SQL of findings: (rule, hard, detail, what to select from and where)."""
    return " UNION ALL ".join(f"SELECT file, CAST(ds AS BIGINT) AS ds, '{rule}' AS rule, {detail} AS detail, {hard} AS hard FROM {source}" for rule, hard, detail, source in parts)


_T = "test_diplayset/"


@query(
    f"WITH {_SETS}, c AS (SELECT *, lag(number) OVER (PARTITION BY file ORDER BY ds) AS before FROM p), "
    "x AS (SELECT *, row_number() OVER (PARTITION BY file, epoch ORDER BY ds) - 1 AS k, lag(pts) OVER (PARTITION BY file, epoch ORDER BY ds) AS pts_before FROM d) "
    + _told([
        (_T + "pcs", "true", "'the display set has no PCS'", "d WHERE state IS NULL"),
        (_T + "order", "true", "'the PCS is not the first segment'", "p WHERE first_type <> 22"),
        (_T + "objects", "true", "'objects told: ' || CAST(cp % 4 AS VARCHAR)", "p WHERE cp % 4 > 2 OR cp % 4 <> CASE WHEN cp % 41 = 0 THEN 0 ELSE cp % 4 END"),
        (_T + "pal_flag", "true", "'a palette update in a display set that is not normal'", "p WHERE state <> 0 AND flag"),
        (_T + "wds", "true", "'a display set that is not normal has no WDS'", "p WHERE state <> 0 AND wds_at IS NULL"),
        (_T + "pal_id", "true", "'palette id of 8 or more'", "p WHERE cp % 9 >= 8"),
        (_T + "order", "true", "'the WDS is not the second segment'", "p WHERE wds_at <> 1"),
        (_T + "pal_flag", "true", "'windows on a palette update'", "p WHERE wds_at IS NOT NULL AND flag"),
        (_T + "wds", "true", "'windows: ' || CAST(wp % 3 + 1 AS VARCHAR)", "p WHERE wds_at IS NOT NULL AND wp % 3 + 1 > 2"),
        (_T + "end", "true", "'END is missing or not the last segment'", "p WHERE NOT (n_end = 0 AND ds = last_ds) AND (n_end = 0 OR last_type <> 128)"),
        (_T + "comp_n", "false", "'the composition number does not go up by one'", "c WHERE before <> 65535 AND number <> (before + 1) % 65536 AND number <> before AND state <> 128"),
        ("epoch/start", "true", "'an epoch starts inside an epoch'", "x WHERE state IS NOT NULL AND k > 0 AND state & 128 <> 0"),
        (_T + "pts", "false", "'two display sets have the same PTS'", "x WHERE state IS NOT NULL AND k > 0 AND pts_before = pts"),
    ])
)
def set_rules(spark, sf_dir):
    """VAL-07..19, 38, 39: the rules on display sets."""
    from functools import reduce

    return reduce(DataFrame.unionByName, inspect.set_findings(inspect.display_sets(inspect.with_sets(segments(spark, sf_dir)))))


@query(
    f"""WITH {_SETS},
    e0 AS (
        SELECT file, epoch, min(ds) AS first_ds, min(ds) FILTER (state IS NOT NULL) AS anchor, arg_min(state, ds) FILTER (state IS NOT NULL) AS state, arg_min({{'p': wp, 'k': wk}}, ds) FILTER (state IS NOT NULL) AS w,
               arg_min(pts, ds) FILTER (state IS NOT NULL) AS pts, arg_min(dts, ds) FILTER (state IS NOT NULL) AS dts, arg_max(pts, ds) FILTER (state IS NOT NULL) AS last_pts FROM d GROUP BY file, epoch),
    e AS (SELECT *, coalesce(last_value(last_pts IGNORE NULLS) OVER (PARTITION BY file ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -99999999) AS before FROM e0),
    wide AS (SELECT file, anchor AS ds, i FROM (SELECT *, unnest(range(0, w.p % 3 + 1)) AS i FROM e WHERE state IS NOT NULL AND w.p IS NOT NULL) WHERE w.k * 37 % 1900 + i * 50 + 20 + w.p % 60 > 1920 OR w.k * 91 % 1000 + 30 + i > 1080),
    opening AS (SELECT *, first_ds AS ds FROM e WHERE anchor = first_ds) """
    + _told([
        ("epoch/start", "true", "'the epoch does not begin with an epoch start'", "opening WHERE state & 128 = 0"),
        ("epoch/window", "true", "'window out of screen: ' || CAST(i AS VARCHAR)", "wide"),
        ("epoch/window", "true", "'the windows overlap'", "(SELECT *, anchor AS ds FROM e) WHERE state IS NOT NULL AND w.p % 3 = 1 AND 20 + w.p % 60 > 50"),
        ("pts_dts/epoch_start", "true", "'the epoch''s DTS does not follow the epoch before'", "opening WHERE ((dts - before) & 4294967295) <= 0 OR ((dts - before) & 4294967295) >= 2147483647"),
        ("pts_dts/epoch_start", "true", "'no time to wipe the plane before the epoch''s PTS'", "opening WHERE ((pts - dts) & 4294967295) <= 5832"),
    ])
)
def epoch_rules(spark, sf_dir):
    """VAL-02..06, GRP-05: the rules on epochs."""
    from functools import reduce

    return reduce(DataFrame.unionByName, inspect.epoch_findings(inspect.epoch_anchors(inspect.display_sets(inspect.with_sets(segments(spark, sf_dir))))))


def _segments_of_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    sets = inspect.with_sets(segments(spark, sf_dir))
    of = inspect.display_sets(sets).filter("pcs is not null").select("file", "ds", "epoch", F.col("pcs.state").alias("pcs_state"))
    return sets.join(of, ["file", "ds"])


@query(
    f"""WITH {_SETS},
    w AS (SELECT s.file, p.epoch, s.ds, s.k AS wk, s.p AS wp, row_number() OVER (PARTITION BY s.file, p.epoch ORDER BY s.seg_ord) AS r FROM s JOIN p ON p.file = s.file AND p.ds = s.ds WHERE s.type = 23),
    each AS (SELECT *, unnest(range(0, wp % 3 + 1)) AS i FROM w),
    bad AS (SELECT b.file, b.ds, b.i FROM each b JOIN each a ON a.file = b.file AND a.epoch = b.epoch AND a.i = b.i AND a.r = 1 WHERE b.r > 1 AND (a.wk * 37 % 1900 <> b.wk * 37 % 1900 OR a.wk * 91 % 1000 <> b.wk * 91 % 1000 OR a.wp % 60 <> b.wp % 60)) """
    + _told([("epoch/window", "true", "'window changed: ' || CAST(i AS VARCHAR)", "bad")])
)
def window_rules(spark, sf_dir):
    """VAL-24: windows that change within an epoch."""
    return inspect.window_findings(_segments_of_sets(spark, sf_dir))


@query(
    f"""WITH {_SETS},
    j AS (SELECT s.*, p.epoch, p.state AS pcs_state, min(s.seg_ord) OVER (PARTITION BY s.file, s.ds) AS head FROM s JOIN p ON p.file = s.file AND p.ds = s.ds),
    life AS (SELECT *, sum(CASE WHEN seg_ord = head AND pcs_state <> 0 THEN 1 ELSE 0 END) OVER (PARTITION BY file, epoch ORDER BY seg_ord) AS life FROM j),
    pd AS (SELECT file, epoch, ds, seg_ord, life, k, p AS lp, p % 9 AS pal, CASE WHEN p % 7 = 0 THEN 5 ELSE n % 256 END AS v FROM life WHERE type = 20),
    each AS (SELECT *, unnest(list_concat([lp % 250, lp % 250 + 1, lp % 250 + 5], CASE WHEN lp % 47 = 0 THEN [255] ELSE [] END)) AS i FROM pd),
    bad AS (SELECT *, CAST(10 + lp % 240 NOT BETWEEN 16 AND 235 OR 16 + k % 227 NOT BETWEEN 16 AND 240 OR 16 + k % 230 NOT BETWEEN 16 AND 240 AS INT) AS wrong, CAST(i = 255 AS INT) AS kept FROM each),
    step AS (SELECT *, wrong - coalesce(lag(wrong) OVER w, 0) AS dw, kept - coalesce(lag(kept) OVER w, 0) AS dk FROM bad WINDOW w AS (PARTITION BY file, epoch, life, pal, i ORDER BY seg_ord)),
    change AS (SELECT file, epoch, life, pal, seg_ord, sum(dw) AS dw, sum(dk) AS dk FROM step GROUP BY ALL),
    held AS (SELECT pd.*, sum(dw) OVER w AS hw, sum(dk) OVER w AS hk FROM pd JOIN change c ON c.file = pd.file AND c.seg_ord = pd.seg_ord WINDOW w AS (PARTITION BY pd.file, pd.epoch, pd.life, pd.pal ORDER BY pd.seg_ord)),
    again AS (SELECT *, row_number() OVER (PARTITION BY file, ds, pal ORDER BY seg_ord) AS r FROM pd),
    version AS (SELECT *, lag(v) OVER (PARTITION BY file, epoch, pal ORDER BY seg_ord) AS b FROM pd) """
    + _told([
        (_T + "pds", "true", "'palette given twice: ' || CAST(pal AS VARCHAR)", "again WHERE r > 1"),
        ("palette/range", "true", "'out of limited range: ' || CAST(pal AS VARCHAR)", "held WHERE hw > 0"),
        ("palette/reserved", "true", "'entry 255 is not transparent: ' || CAST(pal AS VARCHAR)", "held WHERE hk > 0"),
        ("palette/version", "false", "'version does not go up by one: ' || CAST(pal AS VARCHAR)", "version WHERE v <> (b + 1) % 256"),
    ])
)
def palette_rules(spark, sf_dir):
    """VAL-19..23, JON-10: the rules on palettes, with what each holds at any time."""
    from functools import reduce

    return reduce(DataFrame.unionByName, inspect.palette_findings(_segments_of_sets(spark, sf_dir)))


@query(f"""
    WITH {_SETS},
    b0 AS (SELECT *, sum(CASE WHEN type = 22 THEN 1 ELSE 0 END) OVER (PARTITION BY file ORDER BY seg_ord) - 1 AS own FROM g),
    b AS (SELECT file, own, seg_ord, pts, size, CAST(round_even(coalesce((dts - lag(dts) OVER w) & 4294967295, 90000) * 6250.0::DOUBLE / 90000, 0) AS BIGINT) AS refill, size + 11 AS cost FROM b0 WHERE own >= 0 WINDOW w AS (PARTITION BY file ORDER BY seg_ord)),
    r AS (SELECT *, sum(refill) OVER w AS rs, sum(cost) OVER w AS cs FROM b WINDOW w AS (PARTITION BY file ORDER BY seg_ord)),
    lv AS (SELECT *, 1048576 + rs - cs + least(0, min(cs - cost - rs) OVER (PARTITION BY file ORDER BY seg_ord)) AS level FROM r),
    per AS (SELECT file, own, sum(size + 13) AS bytes, arg_min(pts, seg_ord) AS pts FROM lv GROUP BY file, own),
    roll AS (SELECT *, sum(bytes) OVER (PARTITION BY file ORDER BY upts RANGE BETWEEN 90000 PRECEDING AND CURRENT ROW) AS second FROM (SELECT *, pts AS upts FROM per))
    SELECT u.file, round(u.low, 9) AS min_usage, round(u.mid, 9) AS avg_usage, u.ok, CAST(x.peak AS BIGINT) AS peak_bytes, round(CASE WHEN x.span > 0 THEN x.bytes / 131072.0::DOUBLE / (x.span / 90000.0::DOUBLE) ELSE 0.0 END, 9) AS avg_mbps
    FROM (SELECT file, min(level / 1048576.0::DOUBLE) AS low, avg(level / 1048576.0::DOUBLE) AS mid, bool_and(level >= 0) AS ok FROM lv GROUP BY file) u
    JOIN (SELECT file, max(second) AS peak, sum(bytes) AS bytes, arg_max(pts, own) - arg_min(pts, own) AS span FROM roll GROUP BY file) x ON x.file = u.file
""")
def stream_bitrate(spark, sf_dir):
    """AGG-10, STM-13, VAL-41, WIN-03/04: the receive buffer of each stream at 50 kbit/s."""
    rounded = lambda c: F.round(c, 9).alias(c)
    return inspect.bitrate_stats(segments(spark, sf_dir), 6_250).select("file", rounded("min_usage"), rounded("avg_usage"), "ok", "peak_bytes", rounded("avg_mbps"))
