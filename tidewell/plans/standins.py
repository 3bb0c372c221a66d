"""Analogue queries: the subtitle engine's operators applied to ordinary tables, each with SQL.

They are not queries of the engine itself, whose inputs are streams and images; they show its
operators on the tables at hand, at any size.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.functions import color, geometry, ticks, timecode
from tidewell.operators import aggregates, joins, sequence

HOUR, DAY = 3_600_000_000, 86_400_000_000
QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events with pts and out: microseconds at which a row starts and ends."""
    pts = ticks.micros("ts")
    return table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", "props", pts.alias("pts"), (pts + F.floor("value").cast("bigint") * 1_000_000).alias("out"))


E = "(SELECT event_id, user_id, event_type, value, props, epoch_us(ts) AS pts, epoch_us(ts) + CAST(floor(value) AS BIGINT) * 1000000 AS out FROM events)"
KEYS, ORDER = ["user_id"], ["pts", "event_id"]
W = "(PARTITION BY user_id ORDER BY pts, event_id)"
S = "PARTITION BY user_id ORDER BY pts, event_id ROWS UNBOUNDED PRECEDING"


def big(x: Column | str, name: str) -> Column:
    return (F.col(x) if isinstance(x, str) else x).cast("bigint").alias(name)


@query(f"""
    WITH g AS (SELECT *, CASE WHEN pts - lag(out) OVER {W} >= {6 * HOUR} THEN 1 ELSE 0 END AS fresh FROM {E}),
    n AS (SELECT *, sum(fresh) OVER ({S}) AS group_id FROM g)
    SELECT user_id, CAST(group_id AS BIGINT) AS group_id, min(pts) AS first_pts, max(out) AS last_out, count(*) AS n_events
    FROM n GROUP BY ALL
""")
def epoch_groups(spark, sf_dir):
    """GRP-01: runs of events of a user, cut where the gap reaches six hours."""
    g = sequence.gap_groups(events(spark, sf_dir), KEYS, ORDER, "pts", "out", 6 * HOUR)
    return g.groupBy("user_id", "group_id").agg(F.min("pts").alias("first_pts"), F.max("out").alias("last_out"), F.count("*").alias("n_events"))


SETS = f"""s AS (SELECT *, CASE WHEN row_number() OVER {W} > 1 AND (event_type = 'signup' OR lag(event_type) OVER {W} = 'error') THEN 1 ELSE 0 END AS fresh FROM {E}),
    d AS (SELECT *, CAST(sum(fresh) OVER ({S}) AS BIGINT) AS set_id FROM s)"""


def display_sets_of(spark, sf_dir) -> DataFrame:
    return sequence.opened_sets(events(spark, sf_dir), KEYS, ORDER, F.col("event_type") == "signup", F.col("event_type") == "error")


@query(f"WITH {SETS} SELECT event_id, set_id FROM d")
def display_sets(spark, sf_dir):
    """GRP-03: a set opens at a signup and closes after an error."""
    return display_sets_of(spark, sf_dir).select("event_id", big("set_id", "set_id"))


@query(f"""
    WITH {SETS},
    c AS (SELECT user_id, set_id, count(*) AS n, count(*) FILTER (event_type = 'click') AS n_click, count(*) FILTER (event_type = 'view') AS n_view,
          count(*) FILTER (event_type = 'purchase') AS n_purchase, arg_min(event_type, pts) AS first_type, CAST(sum(floor(value)) AS BIGINT) AS bytes FROM d GROUP BY ALL)
    SELECT count(*) AS n_sets, CAST(sum(n) AS BIGINT) AS n_events, CAST(sum(n_click) AS BIGINT) AS n_click, CAST(sum(n_view) AS BIGINT) AS n_view, CAST(sum(n_purchase) AS BIGINT) AS n_purchase,
           count(*) FILTER (first_type = 'signup') AS es, count(*) FILTER (first_type = 'purchase') AS acq, count(*) FILTER (first_type NOT IN ('signup', 'purchase')) AS nc,
           count(*) FILTER (n_purchase > 0 AND first_type NOT IN ('signup', 'purchase')) AS nc_ods, CAST(sum(bytes + 13 * n) AS BIGINT) AS bytes
    FROM c
""")
def census(spark, sf_dir):
    """AGG-01/02: counts by set, then over all sets, sets classed by how they start."""
    per = display_sets_of(spark, sf_dir).groupBy("user_id", "set_id").agg(
        F.count("*").alias("n"), *[F.count_if(F.col("event_type") == t).alias(f"n_{t}") for t in ("click", "view", "purchase")], F.min_by("event_type", "pts").alias("first_type"), F.sum(F.floor("value")).cast("bigint").alias("bytes")
    )
    first = F.col("first_type")
    return per.agg(
        F.count("*").alias("n_sets"), *[F.sum(c).alias(o) for c, o in (("n", "n_events"), ("n_click", "n_click"), ("n_view", "n_view"), ("n_purchase", "n_purchase"))], F.count_if(first == "signup").alias("es"),
        F.count_if(first == "purchase").alias("acq"), F.count_if(~first.isin("signup", "purchase")).alias("nc"), F.count_if((F.col("n_purchase") > 0) & ~first.isin("signup", "purchase")).alias("nc_ods"), F.sum(F.col("bytes") + 13 * F.col("n")).alias("bytes"),
    )


@query(f"""
    WITH {SETS}, b AS (SELECT *, first_value(value) OVER (PARTITION BY user_id, set_id ORDER BY pts, event_id ROWS UNBOUNDED PRECEDING) AS first_value FROM d)
    SELECT event_id, first_value, value > first_value + 1 AS buffered FROM b
""")
def epoch_first_broadcast(spark, sf_dir):
    """WIN-05, AGG-03: the first value of a set for all its rows, and a threshold from it."""
    out = sequence.first_of_group(display_sets_of(spark, sf_dir), ["user_id", "set_id"], ORDER, "value", "first_value")
    return out.select("event_id", "first_value", (F.col("value") > F.col("first_value") + 1).alias("buffered"))


@query(f"""
    WITH r AS (SELECT *, CASE WHEN event_type = lag(event_type) OVER {W} THEN 0 ELSE 1 END AS fresh FROM {E}),
    n AS (SELECT *, sum(fresh) OVER ({S}) AS run FROM r)
    SELECT user_id, arg_min(event_type, (pts, event_id)) AS event_type, min(pts) AS pts, arg_max(out, (pts, event_id)) AS out, count(*) AS run_length FROM n GROUP BY user_id, run
""")
def run_fold(spark, sf_dir):
    """GRP-09: consecutive equal types of a user as one row."""
    return sequence.fold_runs(events(spark, sf_dir), KEYS, ORDER, ["event_type"], "pts", "out", touching=False)


@query(f"""
    WITH x AS (SELECT o_orderkey, epoch_us(o_orderdate) AS a, (SELECT max(epoch_us(l_shipdate)) FROM lineitem WHERE l_orderkey = o_orderkey) AS b FROM orders),
    n AS (SELECT *, greatest((b - a) // {30 * DAY} - 1, 0) AS n FROM x WHERE b > a),
    k AS (SELECT *, unnest(generate_series(0, n)) AS k FROM n)
    SELECT o_orderkey, CAST(k AS BIGINT) AS k, a + k * {30 * DAY} AS start_us, CASE WHEN k < n THEN a + (k + 1) * {30 * DAY} ELSE b END AS end_us, k > 0 AS copy FROM k
""")
def periodic_expand(spark, sf_dir):
    """GEN-01: orders as intervals from order to last shipment, refreshed every 30 days."""
    last = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max(ticks.micros("l_shipdate")).alias("end_us"))
    spans = table(spark, sf_dir, "orders").select("o_orderkey", ticks.micros("o_orderdate").alias("start_us")).join(last, F.col("o_orderkey") == F.col("l_orderkey")).filter("end_us > start_us")
    return sequence.periodic_refreshes(spans, "start_us", "end_us", 30 * DAY).select("o_orderkey", "k", "start_us", "end_us", "copy")


@query(f"""
    WITH x AS (SELECT user_id, out AS pts, lead(pts) OVER {W} AS out FROM {E}),
    y AS (SELECT user_id, pts, out, 'clear' AS kind FROM x WHERE out > pts UNION ALL SELECT user_id, pts, out, 'event' AS kind FROM {E})
    SELECT * FROM y
""")
def gap_clears(spark, sf_dir):
    """GEN-03: rows that clear the screen in gaps, beside the events themselves."""
    e = events(spark, sf_dir)
    gaps = sequence.gap_rows(e, KEYS, ORDER, "pts", "out").withColumn("kind", F.lit("clear"))
    return gaps.unionByName(e.select("user_id", "pts", "out", F.lit("event").alias("kind")))


BUCKET = 1000


def bucket_of(spark, sf_dir) -> DataFrame:
    """Cents cost, microseconds refill: 1 for each 20 minutes, halves to even."""
    e = events(spark, sf_dir)
    step = F.col("pts") - F.lag("pts").over(sequence.ordered(KEYS, ORDER))
    e = e.withColumn("refill", F.coalesce(ticks.half_even(step / F.lit(1_200_000_000.0)).cast("bigint"), F.lit(0).cast("bigint"))).withColumn("cost", F.floor("value").cast("bigint"))
    return sequence.leaky_bucket(e, KEYS, ORDER, "refill", "cost", BUCKET, "level")


LEVELS = f"""q AS (SELECT *, CAST(floor(value) AS BIGINT) AS cost, coalesce(CAST(round_even((pts - lag(pts) OVER {W}) / 1200000000.0, 0) AS BIGINT), 0) AS refill FROM {E}),
    r AS (SELECT *, sum(refill) OVER ({S}) AS rr, sum(cost) OVER ({S}) AS cc FROM q),
    v AS (SELECT *, CAST({BUCKET} + rr - cc + least(0, min(cc - cost - rr) OVER ({S})) AS BIGINT) AS level FROM r)"""


@query(f"WITH {LEVELS} SELECT event_id, level FROM v")
def capped_bucket(spark, sf_dir):
    """WIN-04: a capped leaky bucket for each user, from running windows."""
    return bucket_of(spark, sf_dir).select("event_id", big("level", "level"))


@query(f"""
    WITH {LEVELS}
    SELECT user_id, min(level) AS min_level, round(avg(level), 6) AS avg_level, max(cost) AS peak_cost,
           arg_min(event_id, (level, -pts, -event_id)) AS min_event, arg_max(event_id, (cost, pts, event_id)) AS peak_event
    FROM v GROUP BY user_id
""")
def bucket_stats(spark, sf_dir):
    """AGG-09: smallest, mean and peak, the last of equals."""
    return aggregates.level_stats(bucket_of(spark, sf_dir), ["user_id"], "level", "cost", ["pts", "event_id"])


@query(f"""
    SELECT event_id, CAST(sum(CAST(floor(value) AS BIGINT)) OVER (PARTITION BY user_id ORDER BY pts RANGE BETWEEN {DAY} PRECEDING AND CURRENT ROW) AS BIGINT) AS rolling FROM {E}
""")
def rolling_rate(spark, sf_dir):
    """WIN-03: the sum over the last day, both ends included."""
    e = events(spark, sf_dir).withColumn("cost", F.floor("value").cast("bigint"))
    return sequence.rolling_sum(e, KEYS, "pts", "cost", DAY).select("event_id", "rolling")


@query(f"""
    WITH v AS (SELECT *, pts // {HOUR} AS h, row_number() OVER {W} AS n FROM {E})
    SELECT event_id, CAST(max(h - n) OVER ({S}) + n AS BIGINT) AS fixed FROM v
""")
def monotone_repair(spark, sf_dir):
    """WIN-06: hours made strictly increasing for each user."""
    e = events(spark, sf_dir).withColumn("h", ticks.div(F.col("pts"), HOUR))
    return sequence.strictly_increasing(e, KEYS, ORDER, "h").select("event_id", big("fixed", "fixed"))


@query(f"""
    WITH v AS (SELECT *, (CAST(pts // 11 AS BIGINT)) & 4294967295 AS t FROM {E}),
    l AS (SELECT *, (t - lag(t) OVER {W}) & 4294967295 AS step FROM v)
    SELECT event_id, CAST(step AS BIGINT) AS step, step = 0 AS same, step >= 2147483647 AS backward FROM l WHERE step IS NOT NULL
""")
def mod_lag_rules(spark, sf_dir):
    """WIN-07: steps of a clock that wraps at 2^32, and the rules on them."""
    e = events(spark, sf_dir).withColumn("t", ticks.div(F.col("pts"), 11).bitwiseAND(F.lit(ticks.WRAP - 1)))
    s = sequence.wrapped_step(e, KEYS, ORDER, "t").filter("step is not null")
    return s.select("event_id", "step", (F.col("step") == 0).alias("same"), (F.col("step") >= 2147483647).alias("backward"))


LINE = ["l_linenumber", "l_partkey", "l_suppkey"]


@query("""
    WITH v AS (SELECT *, lag(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS before FROM lineitem)
    SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_partkey, l_suppkey, CAST(before AS BIGINT) AS before FROM v WHERE l_linenumber <> (before + 1) % 256
""")
def version_rule(spark, sf_dir):
    """VAL-17/23/30: numbers that do not follow the one before."""
    before = F.lag("l_linenumber").over(sequence.ordered(["l_orderkey"], LINE))
    v = table(spark, sf_dir, "lineitem").withColumn("before", before).filter(F.col("l_linenumber") != (F.col("before") + 1) % 256)
    return v.select("l_orderkey", big("l_linenumber", "l_linenumber"), "l_partkey", "l_suppkey", big("before", "before"))


@query("SELECT l_orderkey, l_suppkey, count(*) - 1 AS repeats FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def dup_in_set(spark, sf_dir):
    """VAL-19: ids that occur twice in a set, with the number of repeats."""
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_suppkey").agg((F.count("*") - 1).alias("repeats")).filter("repeats > 0")


@query(f"""
    WITH v AS (SELECT *, sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER ({S}) AS ep FROM {E})
    SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id, ep ORDER BY pts, event_id ROWS UNBOUNDED PRECEDING) AS state FROM v
""")
def asof_state(spark, sf_dir):
    """JON-10: the latest purchase since the last signup."""
    value = F.when(F.col("event_type") == "purchase", F.col("value"))
    return sequence.latest_state(events(spark, sf_dir), KEYS, ORDER, value, "state", F.col("event_type") == "signup").select("event_id", "state")


@query("SELECT doc_id, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def lookup_miss(spark, sf_dir):
    """JON-03/08/09: rows whose key has no entry."""
    return joins.missing(table(spark, sf_dir, "documents").select("doc_id", "source"), table(spark, sf_dir, "labels"), "doc_id")


def part_boxes(spark, sf_dir) -> DataFrame:
    key = F.col("p_partkey")
    return table(spark, sf_dir, "part").withColumn("box", geometry.box((key * 37 % 1800).cast("int"), (key * 91 % 1000).cast("int"), (F.col("p_size") * 4).cast("int"), (F.col("p_size") + 8).cast("int")))


P = "(SELECT p_partkey, p_brand, CAST(p_partkey * 37 % 1800 AS INT) AS x, CAST(p_partkey * 91 % 1000 AS INT) AS y, p_size * 4 AS w, p_size + 8 AS h FROM part)"


@query(f"""
    SELECT a.p_partkey AS a, b.p_partkey AS b,
           CAST((least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) * (least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y)) AS BIGINT) AS common,
           round(CAST((least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) * (least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y)) AS DOUBLE) / least(a.w * a.h, b.w * b.h), 6) AS ratio
    FROM {P} a JOIN {P} b ON a.p_brand = b.p_brand AND a.p_partkey < b.p_partkey
    WHERE a.x < b.x + b.w AND b.x < a.x + a.w AND a.y < b.y + b.h AND b.y < a.y + a.h
""")
def box_overlap(spark, sf_dir):
    """JON-02, SCA-15: overlapping boxes under one key."""
    pairs = joins.overlapping_pairs(part_boxes(spark, sf_dir), "p_brand", "p_partkey", F.col("box"))
    a, b = F.col("box_a"), F.col("box_b")
    return pairs.select("a", "b", geometry.area(geometry.intersection(a, b)).alias("common"), F.round(geometry.overlap_ratio(a, b), 6).alias("ratio"))


WINDOWS = [(0, 0, 0, 1920, 400), (1, 200, 300, 900, 700)]


@query(f"""
    WITH w(window_id, wx, wy, ww, wh) AS (VALUES {", ".join(map(str, WINDOWS))}),
    j AS (SELECT *, greatest(x, wx) AS cx, greatest(y, wy) AS cy, least(x + w, wx + ww) AS rx, least(y + h, wy + wh) AS ry FROM {P}, w WHERE x < wx + ww AND wx < x + w AND y < wy + wh AND wy < y + h)
    SELECT p_partkey, CAST(window_id AS BIGINT) AS window_id, CAST(cx AS BIGINT) AS x, CAST(cy AS BIGINT) AS y, CAST(rx - cx AS BIGINT) AS w, CAST(ry - cy AS BIGINT) AS h,
           CAST(CASE WHEN x >= 0 AND x < 1920 AND y >= 0 AND y < 400 THEN 0 WHEN x >= 200 AND x < 1100 AND y >= 300 AND y < 1000 THEN 1 ELSE 0 END AS BIGINT) AS home
    FROM j
""")
def box_window(spark, sf_dir):
    """JON-05/06, GEN-05: boxes cut at two windows, and the window of their corner."""
    out = joins.windows_of(part_boxes(spark, sf_dir), F.col("box"), WINDOWS)
    home = joins.first_window(F.col("box.x"), F.col("box.y"), WINDOWS)
    return out.select("p_partkey", big("window_id", "window_id"), *[big(f"part.{c}", c) for c in "xywh"], big(home, "home"))


@query("""
    WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
    c AS (SELECT e.vec_id, k.vec_id AS id, round(list_distance(e.v, k.v), 6) AS distance FROM e, (SELECT * FROM e WHERE vec_id < 16) k)
    SELECT vec_id, arg_min(id, (distance, id)) AS nearest_id, min(distance) AS distance FROM c GROUP BY vec_id
""")
def nearest_entry(spark, sf_dir):
    """JON-11/12: the closest of 16 palette entries."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return joins.nearest_entry(e, "embedding", e.filter("vec_id < 16"), "vec_id", "embedding").select("vec_id", "nearest_id", "distance")


@query(f"""
    WITH o AS (SELECT user_id, pts, event_id, CAST(round(value * 100) AS BIGINT) AS v, row_number() OVER {W} AS n FROM {E}),
    c AS (SELECT a.event_id, a.n - b.n AS back, abs(a.v - b.v) AS score FROM o a JOIN o b ON a.user_id = b.user_id AND b.n BETWEEN a.n - 15 AND a.n - 1)
    SELECT event_id, CAST(arg_min(back, (score, back)) AS BIGINT) AS best_back, CAST(min(score) AS BIGINT) AS best_score FROM c GROUP BY event_id
""")
def lookback_best(spark, sf_dir):
    """JON-13: the most similar of the 15 rows before."""
    e = events(spark, sf_dir).withColumn("v", F.round(F.col("value") * 100).cast("bigint"))
    out = joins.best_of_previous(e, KEYS, ORDER, ["v"], 15, lambda a, b: F.abs(a("v") - b("v")))
    return out.filter("best_back is not null").select("event_id", big("best_back", "best_back"), big("best_score", "best_score"))


@query("""
    WITH s AS (SELECT l_orderkey, string_agg(CAST(l_linenumber AS VARCHAR), ',' ORDER BY l_linenumber, l_partkey, l_suppkey) AS seq FROM lineitem GROUP BY l_orderkey),
    c AS (SELECT seq, count(*) AS n FROM s GROUP BY seq),
    r AS (SELECT *, row_number() OVER (ORDER BY n DESC, seq) AS rank FROM c)
    SELECT seq, n, rank FROM r WHERE rank <= 254
""")
def seq_dictionary(spark, sf_dir):
    """AGG-17, ORD-02/03: the 254 most frequent sequences of line numbers."""
    counts = aggregates.sequences(table(spark, sf_dir, "lineitem"), ["l_orderkey"], LINE, "l_linenumber")
    return aggregates.top_ranked(counts, ["n"], ["seq"], 254).select("seq", "n", big("rank", "rank"))


@query(f"""
    WITH v AS (SELECT *, lag(event_type) OVER {W} AS before, row_number() OVER {W} AS n FROM {E})
    SELECT event_id, event_type FROM v WHERE n = 1 OR event_type <> before
""")
def delta_encode(spark, sf_dir):
    """STM-06: rows that differ from the row before."""
    return sequence.changed_rows(events(spark, sf_dir), KEYS, ORDER, ["event_type"]).select("event_id", "event_type")


@query(f"SELECT event_id, CAST(sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER ({S}) % 2 AS BIGINT) AS slot FROM {E}")
def toggle_ids(spark, sf_dir):
    """STM-05: the half of a double buffer."""
    return sequence.alternating(events(spark, sf_dir), KEYS, ORDER, F.col("event_type") == "purchase").select("event_id", big("slot", "slot"))


@query(f"SELECT event_id, (row_number() OVER {W} - 1) % 65536 AS composition FROM {E}")
def composition_number(spark, sf_dir):
    """ORD-06: numbers that wrap at 2^16."""
    return sequence.numbered(events(spark, sf_dir), KEYS, ORDER, 65_536, "composition").select("event_id", big("composition", "composition"))


@query("""
    WITH f AS (SELECT o_orderkey, o_custkey % 24 AS h, o_orderkey % 60 AS m, o_custkey % 60 AS s, o_orderkey % 24 AS fr FROM orders),
    n AS (SELECT *, (h * 3600 + m * 60 + s) * 24 + fr + 1 AS frames FROM f)
    SELECT o_orderkey, CAST(frames AS BIGINT) AS frames, CAST(CASE WHEN frames <= 1 THEN 0 ELSE (frames - 1) * 90000 * 1001 // 24000 END AS BIGINT) AS ticks,
           printf('%02d:%02d:%02d:%02d', (frames - 1) // 86400, (frames - 1) // 1440 % 60, (frames - 1) // 24 % 60, (frames - 1) % 24) AS again FROM n
""")
def timecode_ticks(spark, sf_dir):
    """SCA-01..03: time codes to frames and ticks and back, at 24000/1001."""
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    text = F.format_string("%02d:%02d:%02d:%02d", cust % 24, key % 60, cust % 60, key % 24)
    frames = timecode.from_hmsf(text, 24)
    return table(spark, sf_dir, "orders").select("o_orderkey", frames.alias("frames")).select("o_orderkey", "frames", timecode.to_ticks(F.col("frames"), 24_000, 1_001).alias("ticks"), timecode.to_hmsf(F.col("frames"), 24).alias("again"))


RGB = "CAST(l_quantity * 5 AS INT) AS r, CAST(l_discount * 2500 AS INT) AS g, CAST(l_tax * 3000 AS INT) AS b"


def rgb(spark, sf_dir) -> DataFrame:
    line = table(spark, sf_dir, "lineitem")
    return line.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *[F.round(F.col(c) * k).cast("int").alias(o) for c, k, o in (("l_quantity", 5, "r"), ("l_discount", 2500, "g"), ("l_tax", 3000, "b"))])


def _channel(row: tuple[float, float, float], offset: int, top: int) -> str:
    return f"CAST(greatest(16, least({top}, CAST(round_even(r * {row[0]!r}::DOUBLE + g * {row[1]!r}::DOUBLE + b * {row[2]!r}::DOUBLE, 0) AS INT) + {offset})) AS BIGINT)"


@query(f"""
    WITH c AS (SELECT DISTINCT {RGB} FROM lineitem)
    SELECT CAST(r AS BIGINT) AS r, CAST(g AS BIGINT) AS g, CAST(b AS BIGINT) AS b, {", ".join(f"{_channel(m, o, t)} AS {n}" for m, o, t, n in zip(color.matrix("bt709"), (16, 128, 128), (235, 240, 240), ("y", "cb", "cr")))} FROM c
""")
def ycbcr(spark, sf_dir):
    """SCA-10: colours to limited-range YCbCr."""
    colours = rgb(spark, sf_dir).select("r", "g", "b").distinct()
    return colours.select(*[big(c, c) for c in "rgb"], *[big(c, n) for c, n in zip(color.to_ycbcr(F.col("r"), F.col("g"), F.col("b")), ("y", "cb", "cr"))])


@query(f"WITH c AS (SELECT {RGB} FROM lineitem) SELECT CAST((r * 19595 + g * 38470 + b * 7471 + 32768) >> 16 AS BIGINT) AS luma, count(*) AS n FROM c GROUP BY ALL")
def luma(spark, sf_dir):
    """SCA-13: luminance in fixed point, counted."""
    return rgb(spark, sf_dir).select(big(color.luma(F.col("r"), F.col("g"), F.col("b")), "luma")).groupBy("luma").agg(F.count("*").alias("n"))


HIST = f"h AS (SELECT CAST(r >> 3 AS BIGINT) AS rb, CAST(g >> 3 AS BIGINT) AS gb, CAST(b >> 3 AS BIGINT) AS bb, count(*) AS n, CAST(sum(r) AS BIGINT) AS sr, CAST(sum(g) AS BIGINT) AS sg, CAST(sum(b) AS BIGINT) AS sb, CAST(sum(r * r + g * g + b * b) AS BIGINT) AS m2 FROM (SELECT {RGB} FROM lineitem) GROUP BY ALL)"


@query(f"WITH {HIST} SELECT * FROM h")
def color_hist(spark, sf_dir):
    """AGG-12: moments of colours in 5-bit bins."""
    return aggregates.colour_histogram(rgb(spark, sf_dir))


@query(f"""
    WITH {HIST},
    ax AS (SELECT unnest(range(32)) AS i),
    cube AS (SELECT a.i AS rb, b.i AS gb, c.i AS bb, coalesce(h.n, 0) AS n FROM ax a CROSS JOIN ax b CROSS JOIN ax c LEFT JOIN h ON h.rb = a.i AND h.gb = b.i AND h.bb = c.i),
    p1 AS (SELECT *, sum(n) OVER (PARTITION BY gb, bb ORDER BY rb) AS s1 FROM cube),
    p2 AS (SELECT *, sum(s1) OVER (PARTITION BY rb, bb ORDER BY gb) AS s2 FROM p1)
    SELECT rb, gb, bb, CAST(sum(s2) OVER (PARTITION BY rb, gb ORDER BY bb) AS BIGINT) AS volume FROM p2
""")
def prefix_volume(spark, sf_dir):
    """AGG-13: three-dimensional running sums of the histogram."""
    return aggregates.summed_volume(aggregates.colour_histogram(rgb(spark, sf_dir)), ["rb", "gb", "bb"], "n", 32)


@query("""
    WITH d AS (SELECT label, vec_id, unnest(embedding) AS v, unnest(range(len(embedding))) AS dim, 1 + vec_id % 3 AS wt FROM embeddings),
    m AS (SELECT label, dim, CAST(sum(wt) AS BIGINT) AS weight, sum(wt * CAST(v AS DOUBLE)) / sum(wt) AS mean FROM d GROUP BY ALL),
    s AS (SELECT d.label, d.dim, any_value(m.weight) AS weight, any_value(m.mean) AS mean, round(sum(wt * abs(CAST(v AS DOUBLE) - mean)) / sum(wt), 6) AS mad FROM d JOIN m ON d.label = m.label AND d.dim = m.dim GROUP BY ALL)
    SELECT CAST(label AS BIGINT) AS label, any_value(weight) AS weight, CAST(arg_max(dim, (mad, -dim)) AS BIGINT) AS widest, max(mad) AS mad FROM s GROUP BY label
""")
def cluster_stats(spark, sf_dir):
    """AGG-15: the dimension in which a cluster deviates most from its weighted mean."""
    e = table(spark, sf_dir, "embeddings").withColumn("wt", 1 + F.col("vec_id") % 3)
    return aggregates.widest_dimension(e, "label", "embedding", "wt")


@query("""
    WITH p AS (SELECT a.vec_id, [CAST(x AS DOUBLE) * 255 FOR x IN a.embedding] AS u, [CAST(x AS DOUBLE) * 255 FOR x IN b.embedding] AS v FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1),
    m AS (SELECT vec_id, unnest(u) AS u, unnest(v) AS v FROM p),
    s AS (SELECT vec_id, avg(u) AS mu, avg(v) AS mv, var_pop(u) AS vu, var_pop(v) AS vv, covar_pop(u, v) AS c FROM m GROUP BY vec_id)
    SELECT vec_id, round(((2 * mu * mv + 6.5025) * (2 * c + 58.5225)) / ((mu * mu + mv * mv + 6.5025) * (vu + vv + 58.5225)), 6) AS ssim FROM s
""")
def tile_ssim(spark, sf_dir):
    """RAS-09: structural similarity of vectors taken as one tile."""
    e = table(spark, sf_dir, "embeddings")
    pairs = e.select("vec_id", F.col("embedding").alias("u")).join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("v")), "vec_id")
    return aggregates.ssim(pairs, "vec_id", "u", "v", 255.0)


@query(f"SELECT p_brand, round(CAST(sum(w * h * (p_partkey % 101)) AS DOUBLE) / sum(w * h), 6) AS score FROM {P} GROUP BY p_brand")
def area_weighted(spark, sf_dir):
    """AGG-11: scores weighted by area."""
    return aggregates.area_weighted(part_boxes(spark, sf_dir), ["p_brand"], geometry.area(F.col("box")), F.col("p_partkey") % 101)


@query("""
    WITH px AS (SELECT DISTINCT p_brand, CAST(p_partkey * 7 % 96 AS BIGINT) AS x, CAST(p_size AS BIGINT) AS y FROM part),
    col AS (SELECT p_brand, x, min(y) AS lo, max(y) AS hi FROM px GROUP BY ALL),
    sp AS (SELECT *, lead(x) OVER b AS nx, min(x) OVER (b ROWS UNBOUNDED PRECEDING) AS x0, min(lo) OVER (b ROWS UNBOUNDED PRECEDING) AS l0, max(hi) OVER (b ROWS UNBOUNDED PRECEDING) AS h0,
           min(lo) OVER (b ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS l1, max(hi) OVER (b ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS h1, max(x) OVER (b ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS x1
           FROM col WINDOW b AS (PARTITION BY p_brand ORDER BY x)),
    a AS (SELECT p_brand, nx AS cut, (x - x0 + 1) * (h0 - l0 + 1) + (x1 - nx + 1) * (h1 - l1 + 1) AS area FROM sp WHERE nx IS NOT NULL)
    SELECT p_brand, arg_min(cut, (area, cut)) AS cut, min(area) AS area FROM a GROUP BY p_brand
""")
def coverage_layout(spark, sf_dir):
    """RAS-06: the vertical cut of a mask into two boxes of the least total area."""
    mask = table(spark, sf_dir, "part").select("p_brand", (F.col("p_partkey") * 7 % 96).cast("bigint").alias("x"), big("p_size", "y"))
    return aggregates.best_cut(mask, ["p_brand"], "x", "y")


@query(f"""
    WITH r AS (SELECT *, CASE WHEN event_type = lag(event_type) OVER {W} THEN 0 ELSE 1 END AS fresh FROM {E}),
    n AS (SELECT *, sum(fresh) OVER ({S}) AS run FROM r)
    SELECT user_id, CAST(run AS BIGINT) AS run, any_value(event_type) AS event_type, count(*) AS length FROM n GROUP BY user_id, run
""")
def rle_runs(spark, sf_dir):
    """COD-13: run lengths of types."""
    return aggregates.run_lengths(events(spark, sf_dir), KEYS, ORDER, "event_type")


@query("""
    WITH d AS (SELECT doc_id, length(text) AS n FROM documents),
    f AS (SELECT *, unnest(generate_series(0, CASE WHEN n <= 1000 THEN 0 ELSE (n - 1000 + 1006) // 1007 END)) AS i FROM d)
    SELECT doc_id, i AS fragment, CASE WHEN i = 0 THEN 0 ELSE 1000 + (i - 1) * 1007 END AS start, CAST(CASE WHEN i = 0 THEN least(n, 1000) ELSE least(n - 1000 - (i - 1) * 1007, 1007) END AS BIGINT) AS size,
           i = 0 AS is_first, i = max(i) OVER (PARTITION BY doc_id) AS is_last FROM f
""")
def ods_fragments(spark, sf_dir):
    """COD-10: a payload in fragments of 1000, then 1007 units each."""
    return aggregates.fragments(table(spark, sf_dir, "documents").select("doc_id", big(F.length("text"), "n")), "doc_id", "n", 1000, 1007)


_RATES = ", ".join(f"({code}, {n}, {d})" for code, (n, d) in sorted(timecode.RATES.items()))


@query(f"""
    WITH r(code, num, den) AS (VALUES {_RATES}),
    p AS (SELECT p_partkey, 23 + CAST(p_partkey % 400 AS DOUBLE) / 10 AS rate FROM part),
    c AS (SELECT p_partkey, code, num, den, abs(rate - num / CAST(den AS DOUBLE)) AS off FROM p, r),
    b AS (SELECT p_partkey, min(off) AS off, arg_min(code, (off, code)) AS code FROM c GROUP BY p_partkey)
    SELECT p_partkey, CAST(code AS BIGINT) AS code FROM b WHERE off < 0.07
""")
def fps_nearest(spark, sf_dir):
    """FLT-04: the closest of seven frame rates within the tolerance, the rest is rejected."""
    best = timecode.nearest_rate(F.lit(23.0) + (F.col("p_partkey") % 400).cast("double") / 10)
    return table(spark, sf_dir, "part").select("p_partkey", best["code"].cast("bigint").alias("code")).filter("code is not null")


@query("SELECT event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY ALL")
def ndjson_parse(spark, sf_dir):
    """SRC-11: objects in JSON, one in each row."""
    from tidewell.sources.ndjson import parse

    return parse(table(spark, sf_dir, "events"), "props", "k bigint").groupBy("event_type", "k").agg(F.count("*").alias("n"))


@query(f"""
    WITH v AS (SELECT *, lag(out) OVER {W} AS before FROM {E})
    SELECT event_id FROM v WHERE before IS NOT NULL AND pts < before
""")
def overlapping_events(spark, sf_dir):
    """WIN-01/02: rows that start before the one before them ends."""
    return events(spark, sf_dir).withColumn("before", F.lag("out").over(sequence.ordered(KEYS, ORDER))).filter("pts < before").select("event_id")


@query(f"""
    WITH {SETS}, f AS (SELECT user_id, set_id, event_type, count(*) AS n FROM d GROUP BY ALL HAVING count(*) > 1),
    h AS (SELECT user_id, set_id, 'set/repeat' AS rule, event_type AS detail, false AS hard FROM f
          UNION ALL SELECT user_id, set_id, 'set/end', NULL, true FROM d GROUP BY user_id, set_id HAVING count(*) FILTER (event_type = 'error') = 0)
    SELECT rule, hard, count(*) AS n FROM h GROUP BY ALL
""")
def rule_findings(spark, sf_dir):
    """VAL: findings of several rules as one table, then counted by rule."""
    d = display_sets_of(spark, sf_dir)
    repeat = d.groupBy("user_id", "set_id", "event_type").agg(F.count("*").alias("n")).filter("n > 1").select("user_id", "set_id", F.lit("set/repeat").alias("rule"), F.col("event_type").alias("detail"), F.lit(False).alias("hard"))
    end = d.groupBy("user_id", "set_id").agg(F.count_if(F.col("event_type") == "error").alias("n")).filter("n = 0").select("user_id", "set_id", F.lit("set/end").alias("rule"), F.lit(None).cast("string").alias("detail"), F.lit(True).alias("hard"))
    return reduce(DataFrame.unionByName, [repeat, end]).groupBy("rule", "hard").agg(F.count("*").alias("n"))


@query("""
    WITH p AS (SELECT vec_id, unnest(embedding) AS v FROM embeddings)
    SELECT vec_id, true AS ok, count(*) FILTER (CAST(floor(abs(CAST(v AS DOUBLE)) * 10) AS BIGINT) % 4 <> 0) AS non_empty FROM p GROUP BY vec_id
""")
def rle_bitmaps(spark, sf_dir):
    """COD-13..15: vectors as bitmaps of 8 x 8 pixels, to runs and back, with a census of pixels."""
    from tidewell.operators import images

    level = F.transform("embedding", lambda v: (F.floor(F.abs(v.cast("double")) * 10) % 4).cast("int"))
    hexed = F.array_join(F.transform(level, lambda x: F.lpad(F.hex(x), 2, "0")), "")
    side = F.lit(8)
    coded = table(spark, sf_dir, "embeddings").select("vec_id", F.unhex(hexed).alias("map")).withColumn("rle", images.encode_rle(F.col("map"), side, side))
    back = coded.withColumn("back", images.decode_rle(F.col("rle"), side, side)).withColumn("seen", images.pixel_census(F.col("rle"), side, side))
    return back.select("vec_id", (F.col("back.ok") & (F.col("back.bitmap") == F.col("map"))).alias("ok"), F.col("seen.non_empty").alias("non_empty"))


_POLICY_SQL = """
    WITH RECURSIVE e AS (
        SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts), event_id) AS n,
               CASE event_type WHEN 'click' THEN 0 WHEN 'view' THEN 1 ELSE 2 END AS brings, event_type = 'error' AS must, value - floor(value) AS margin
        FROM events),
    s AS (
        SELECT user_id, event_id, n, brings, must, margin, CAST(0 AS DOUBLE) AS before, CAST(0 AS BIGINT) AS updates_before FROM e WHERE n = 1
        UNION ALL
        SELECT e.user_id, e.event_id, e.n, e.brings, e.must, e.margin,
               CASE WHEN s.brings = 0 THEN s.before WHEN s.must THEN 0.0 WHEN s.brings = 2 THEN s.before
                    WHEN s.margin > greatest(0.5 - 0.035 * s.before, 0.0) THEN 0.0 ELSE s.before + 1.0 END,
               CASE WHEN s.brings = 0 OR (NOT s.must AND s.brings = 1 AND NOT s.margin > greatest(0.5 - 0.035 * s.before, 0.0)) THEN s.updates_before + 1 ELSE 0 END
        FROM s JOIN e ON e.user_id = s.user_id AND e.n = s.n + 1),
    t AS (
        SELECT *, CASE WHEN brings = 0 THEN 'normal' WHEN must THEN 'acquisition' WHEN brings = 2 THEN 'epoch' WHEN margin > greatest(0.5 - 0.035 * before, 0.0) THEN 'again' ELSE 'normal' END AS kind FROM s)
    SELECT event_id, CASE kind WHEN 'normal' THEN 0 WHEN 'epoch' THEN 128 ELSE 64 END AS state, kind = 'again' AS again,
           kind = 'normal' AND updates_before + 1 >= 5 AS due
    FROM t
"""


@query(_POLICY_SQL)
def policy_states(spark, sf_dir):
    """STM-02/03: the state of each event of a user by the rules for acquisitions, which fold over the user's events
    in order, so one function over each user. Views bring what is held, clicks an update, the rest what is new;
    errors have to be acquired."""
    import pyarrow as pa

    from tidewell.plans.timing import HELD, NEW, UPDATE, Progress, StateChoice

    def states(rows: pa.Table) -> pa.Table:
        choice, now, out = StateChoice(0.5, 1.0, 5), Progress(), []
        for r in sorted(rows.to_pylist(), key=lambda r: (r["pts"], r["event_id"])):
            brings = {"click": UPDATE, "view": HELD}.get(r["event_type"], NEW)
            state, again, now = choice.next(now, brings, r["event_type"] == "error", r["value"] % 1.0)
            out.append({"event_id": r["event_id"], "state": state, "again": again, "due": choice.due(now)})
        return pa.Table.from_pylist(out, pa.schema([("event_id", pa.int64()), ("state", pa.int64()), ("again", pa.bool_()), ("due", pa.bool_())]))

    rows = events(spark, sf_dir).select("user_id", "event_id", "event_type", "value", "pts")
    return rows.groupBy("user_id").applyInArrow(states, "event_id bigint, state bigint, again boolean, due boolean")


@query(None)
def palettes(spark, sf_dir):
    """RAS-13..18: each supplier's colours reduced to 16 entries by every quantiser, with the mean error."""
    import numpy as np
    import pyarrow as pa

    from tidewell.raster.colours import quantise

    def reduce_(rows: pa.Table) -> pa.Table:
        rgba = np.stack([rows.column(c).to_numpy() for c in "rgb"] + [np.full(rows.num_rows, 255)], 1).astype(np.uint8)
        rgba = rgba[np.lexsort(rgba.T)][None]
        out = []
        for name in ("means", "moments", "tree"):
            at, entries = quantise(rgba, 16, name)
            error = float(np.abs(entries[at].astype(int) - rgba).mean())
            out.append({"l_suppkey": rows.column("l_suppkey")[0].as_py(), "quantiser": name, "entries": len(entries), "error": round(error, 6)})
        return pa.Table.from_pylist(out, pa.schema([("l_suppkey", pa.int64()), ("quantiser", pa.string()), ("entries", pa.int64()), ("error", pa.float64())]))

    colours = rgb(spark, sf_dir).select("l_suppkey", "r", "g", "b").distinct()
    return colours.groupBy("l_suppkey").applyInArrow(reduce_, "l_suppkey bigint, quantiser string, entries bigint, error double")


@query(None)
def picture_regions(spark, sf_dir):
    """RAS-09..12: consecutive vectors as pictures, compared region by region."""
    from tidewell.operators import images

    byte = lambda v: F.lpad(F.hex(F.least(F.lit(255), F.floor(F.abs(v.cast("double")) * 255)).cast("int")), 2, "0")
    pixel = F.array_join(F.transform("embedding", lambda v: F.concat(byte(v), byte(v), byte(v), F.when(v < 0, "00").otherwise("FF"))), "")
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.unhex(pixel).alias("pic"))
    after = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("pic").alias("other"))
    s = images.similarity(F.col("pic"), F.col("other"), F.lit(8), F.lit(8))
    return e.join(after, "vec_id").select("vec_id", s.alias("s")).select("vec_id", F.round("s.score", 6).alias("score"), F.round("s.share", 6).alias("share"))


from tidewell.plans import ruled  # noqa: E402  the queries over made streams

QUERIES |= ruled.QUERIES
ORACLES |= ruled.ORACLES
