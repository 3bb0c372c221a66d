"""Operators over sequences against plain loops, functions against worked values."""

import random

import pytest
from pyspark.sql import functions as F

from tidewell.functions import color, geometry, ticks, timecode
from tidewell.operators import aggregates, joins, sequence


@pytest.fixture(scope="module")
def rows(spark):
    rnd = random.Random(7)
    out = []
    for u in range(4):
        t = 0
        for n in range(120):
            t += rnd.choice([0, 1, 2, 5, 40])
            out.append((u, n, t, t + rnd.randrange(6), rnd.choice("abc"), rnd.randrange(50)))
    return out


@pytest.fixture(scope="module")
def df(spark, rows):
    return spark.createDataFrame(rows, "u long, n long, s long, e long, kind string, v long").cache()


def by_user(rows):
    for u in sorted({r[0] for r in rows}):
        yield u, [r for r in rows if r[0] == u]


def column(df, name):
    return {(r.u, r.n): r[name] for r in df.collect()}


KEYS, ORDER = ["u"], ["n"]


def test_gap_groups(df, rows):
    got = column(sequence.gap_groups(df, KEYS, ORDER, "s", "e", 3), "group_id")
    for _, own in by_user(rows):
        g = 0
        for i, r in enumerate(own):
            g += i > 0 and r[2] - own[i - 1][3] >= 3
            assert got[r[0], r[1]] == g


def test_opened_sets(df, rows):
    got = column(sequence.opened_sets(df, KEYS, ORDER, F.col("kind") == "a", F.col("kind") == "c"), "set_id")
    for _, own in by_user(rows):
        g = 0
        for i, r in enumerate(own):
            g += i > 0 and (r[4] == "a" or own[i - 1][4] == "c")
            assert got[r[0], r[1]] == g


def test_leaky_bucket(df, rows):
    got = column(sequence.leaky_bucket(df.withColumn("fill", F.lit(20)), KEYS, ORDER, "fill", "v", 100), "level")
    for _, own in by_user(rows):
        x = 100
        for r in own:
            x = min(x + 20, 100) - r[5]
            assert got[r[0], r[1]] == x


def test_strictly_increasing(df, rows):
    got = column(sequence.strictly_increasing(df, KEYS, ORDER, "v"), "fixed")
    for _, own in by_user(rows):
        last = None
        for r in own:
            last = r[5] if last is None else max(r[5], last + 1)
            assert got[r[0], r[1]] == last


def test_rolling_sum(df, rows):
    got = column(sequence.rolling_sum(df, KEYS, "s", "v", 10), "rolling")
    for _, own in by_user(rows):
        for r in own:
            assert got[r[0], r[1]] == sum(x[5] for x in own if r[2] - 10 <= x[2] <= r[2])


def test_fold(df, rows):
    got = sorted(map(tuple, sequence.fold_runs(df, KEYS, ORDER, ["kind"], "s", "e").select("u", "kind", "s", "e", "run_length").collect()))
    want = []
    for u, own in by_user(rows):
        runs = []
        for r in own:
            if runs and runs[-1][1] == r[4] and runs[-1][3] == r[2]:
                runs[-1][3] = r[3]
                runs[-1][4] += 1
            else:
                runs.append([u, r[4], r[2], r[3], 1])
        want += map(tuple, runs)
    assert got == sorted(want)


@pytest.mark.parametrize("size, pieces", [(9, [(0, 9)]), (10, [(0, 10)]), (19, [(0, 19)]), (20, [(0, 10), (10, 20)]), (35, [(0, 10), (10, 20), (20, 35)])])
def test_refreshes(spark, size, pieces):
    got = sequence.periodic_refreshes(spark.createDataFrame([(0, size)], "s long, e long"), "s", "e", 10).orderBy("k").collect()
    assert [(r.s, r.e) for r in got] == pieces and [r.copy for r in got] == [i > 0 for i in range(len(pieces))]


def test_latest_state(df, rows):
    got = column(sequence.latest_state(df, KEYS, ORDER, F.when(F.col("kind") == "b", F.col("v")), "x", F.col("kind") == "a"), "x")
    for _, own in by_user(rows):
        x = None
        for r in own:
            x = None if r[4] == "a" else r[5] if r[4] == "b" else x
            assert got[r[0], r[1]] == x


def test_best_of_previous(df, rows):
    out = joins.best_of_previous(df, KEYS, ORDER, ["v"], 5, lambda a, b: F.abs(a("v") - b("v")))
    got = {(r.u, r.n): (r.best_back, r.best_score) for r in out.collect()}
    for _, own in by_user(rows):
        for i, r in enumerate(own):
            best = min(((abs(r[5] - own[i - k][5]), k) for k in range(1, min(i, 5) + 1)), default=(None, None))
            assert got[r[0], r[1]] == (best[1], best[0])


def test_run_lengths_and_cut(spark, df, rows):
    got = aggregates.run_lengths(df, KEYS, ORDER, "kind").agg(F.sum("length")).first()[0]
    assert got == len(rows)
    mask = [(0, x, y) for x, y in ((0, 0), (1, 1), (2, 0), (20, 9), (21, 9))]
    r = aggregates.best_cut(spark.createDataFrame(mask, "k int, x long, y long"), ["k"], "x", "y").first()
    assert (r.cut, r.area) == (20, 3 * 2 + 2 * 1)


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_ticks(spark):
    lit = F.lit
    assert one(spark, ticks.copy_ticks(1920 * 1080), ticks.decode_ticks(1920 * 1080), ticks.modular_difference(lit(5), lit(7))) == (5832, 11664, 4294967294)
    assert one(spark, ticks.half_even(lit(2.5)), ticks.half_even(lit(3.5)), ticks.to_ticks(lit(0.5))) == (2.0, 4.0, 45_000)
    got = spark.sql("select timestamp_ntz'2024-02-03 04:05:06.123456' as t").select(ticks.micros("t")).first()[0]
    assert got == 1706933106123456


def test_timecodes(spark):
    lit = F.lit
    assert one(spark, timecode.from_hmsf(lit("00:00:01:00"), 24), timecode.from_hmsf(lit("x:00:01:y"), 24), timecode.to_hmsf(lit(25), 24)) == (25, 25, "00:00:01:00")
    assert one(spark, timecode.to_ticks(lit(1), 24, 1), timecode.to_ticks(lit(25), 24, 1), timecode.to_ticks(lit(25), 24_000, 1_001), timecode.from_ticks(lit(90_000), 24, 1)) == (0, 90_000, 90_090, 25)
    assert one(spark, timecode.nearest_rate(lit(23.976))["code"], timecode.nearest_rate(lit(26.0)), timecode.parse_rate(lit("30000/1001")), timecode.parse_rate(lit("abc"))) == (0x10, None, 30_000 / 1_001, None)
    assert one(spark, timecode.fits_format(lit(720), lit(576), lit(0x30)), timecode.fits_format(lit(720), lit(576), lit(0x40)), timecode.nominal(lit(24_000), lit(1_001))) == (True, False, 24)


def test_colours(spark):
    lit = F.lit
    assert one(spark, *color.to_ycbcr(lit(255), lit(255), lit(255))) == (235, 128, 128) and one(spark, *color.to_ycbcr(lit(0), lit(0), lit(0))) == (16, 128, 128)
    assert one(spark, *color.to_ycbcr(lit(255), lit(0), lit(0), "bt601")) == (81, 90, 240)
    assert one(spark, *color.to_rgb(lit(235), lit(128), lit(128))) == (255, 255, 255)
    assert one(spark, color.luma(lit(255), lit(255), lit(255)), color.canonical_space(lit("BT.709")), color.canonical_space(lit("srgb"))) == (255, "bt709", None)


def test_boxes(spark):
    a, b, c = (geometry.box(*map(F.lit, x)) for x in ((0, 0, 10, 10), (5, 5, 10, 10), (10, 0, 5, 5)))
    assert one(spark, geometry.overlaps(a, b), geometry.overlaps(a, c), geometry.overlap_ratio(a, b), geometry.area(geometry.union(a, b))) == (True, False, 0.25, 225)


def test_images_in_columns(spark):
    import numpy as np

    from tidewell.operators import images
    from tidewell.sources import codec

    bitmap = np.zeros((12, 16), np.uint8)
    bitmap[2:5, 3:9] = 7
    rgba = np.zeros((60, 90, 4), np.uint8)
    rgba[10:20, 30:50] = 255
    df = spark.createDataFrame([(bytearray(codec.encode_rle(bitmap)), bytearray(bitmap.tobytes()), 16, 12, bytearray(rgba.tobytes()), bytearray((rgba[..., 3] > 0).astype(np.uint8).tobytes()))], "rle binary, map binary, w int, h int, pic binary, mask binary")
    r = df.select(images.decode_rle(F.col("rle"), F.col("w"), F.col("h")).alias("d"), images.encode_rle(F.col("map"), F.col("w"), F.col("h")).alias("e"), images.pixel_census(F.col("rle"), F.col("w"), F.col("h")).alias("c"), images.content_box(F.col("pic"), F.lit(90), F.lit(60)).alias("b"), images.similarity(F.col("pic"), F.col("pic"), F.lit(90), F.lit(60)).alias("s"), images.window_layout(F.col("mask"), F.lit(90), F.lit(60)).alias("l")).first()
    assert bytes(r.d.bitmap) == bitmap.tobytes() and r.d.ok and bytes(r.e) == codec.encode_rle(bitmap) and tuple(r.c) == (192, 18)
    assert tuple(r.b) == (30, 10, 20, 10) and r.s.score == 1.0 and r.l.first == r.l.second


def test_streaming_census(spark, tmp_path):
    from tidewell.streaming.census import running_census

    schema = "file string, seg_ord bigint, type smallint, size int, pcs struct<state:int>"
    parts = [[("f", 0, 0x16, 11, (0x80,)), ("f", 1, 0x17, 10, None)], [("f", 2, 0x80, 0, None), ("g", 0, 0x16, 11, (0,))]]
    source = tmp_path / "in"
    for i, p in enumerate(parts):
        spark.createDataFrame(p, schema).coalesce(1).write.mode("append").json(str(source))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(source))
    q = running_census(stream).writeStream.outputMode("update").format("memory").queryName("census_out").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    last = {}
    for r in spark.table("census_out").collect():
        last[r.file] = max(last.get(r.file, (0,)), (r.segments, r.display_sets, r.epochs, r.bytes))
    assert last == {"f": (3, 1, 1, 60), "g": (1, 1, 0, 24)}


def test_ndjson(spark, tmp_path):
    from tidewell.sources.ndjson import read_ndjson, write_ndjson

    (tmp_path / "a.json").write_text('{"type":"log","level":"info","msg":"x"}\n\n{"type":"warn","kind":"k","count":3}\n{"type":"done","success":true,"es":2}\n')
    assert [r.type for r in read_ndjson(spark, str(tmp_path / "a.json")).collect()] == ["log", "warn", "done"]
    (tmp_path / "b.json").write_text('{"type":"odd"}\n{"type":"log"\n')
    with pytest.raises(Exception):
        read_ndjson(spark, str(tmp_path / "b.json")).collect()
    assert read_ndjson(spark, str(tmp_path / "b.json"), strict=False).count() in (0, 1)
    write_ndjson(read_ndjson(spark, str(tmp_path / "a.json")), str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).count() == 3


def test_settings(tmp_path):
    from tidewell.sources.settings import read_quantiser_options

    p = tmp_path / "x.ini"
    p.write_text("[PILIQ]\n; note\nquality = 90\nspeed=4 # fast\nother=1\n")
    assert read_quantiser_options(str(p)) == {"quality": 90, "speed": 4}
    p.write_text("[PILIQ]\nspeed=11\n")
    with pytest.raises(ValueError):
        read_quantiser_options(str(p))


def test_runner(spark):
    from tidewell.plans.runner import Busy, Runner

    events = []
    r = Runner(spark, events.append)

    def job(progress):
        progress(1, 2)
        with pytest.raises(Busy):
            r.run(lambda p: {})
        return {"events": spark.range(5).count()}

    assert r.run(job)["success"] and events[0]["percent"] == 50 and events[-1]["events"] == 5
    assert not r.run(lambda p: 1 / 0)["success"]


def test_texts(spark):
    row = spark.range(1).select(
        timecode.rate_text(F.lit(24_000), F.lit(1_001), F.lit(False)).alias("a"), timecode.rate_text(F.lit(25), F.lit(1), F.lit(True)).alias("b"), timecode.elapsed_text(F.lit(309_999)).alias("c"), timecode.elapsed_text(F.lit(6_000_000)).alias("d"),
        timecode.remaining_text(F.lit(65_000), F.lit(1), F.lit(2)).alias("e"), timecode.remaining_text(F.lit(4_000), F.lit(1), F.lit(2)).alias("f"), timecode.remaining_text(F.lit(4_000), F.lit(2), F.lit(2)).alias("g"), timecode.without_clock(F.lit("12:30:01 WARN: 10:00:00 INFO: x")).alias("h"),
    ).first()
    assert tuple(row) == ("23.976 fps NDF", "25.000 fps DF", "05:09", "100:00", "1m 5s", "4s", None, "10:00:00 INFO: x")


def test_boxes_over_many_cells(spark):
    rnd = random.Random(3)
    boxes = [(i % 3, i, rnd.randrange(-50, 900), rnd.randrange(-50, 700), rnd.randrange(0, 400), rnd.randrange(0, 200)) for i in range(120)]
    df = spark.createDataFrame(boxes, "k int, i int, x int, y int, w int, h int")
    got = sorted((r.a, r.b) for r in joins.overlapping_pairs(df, "k", "i", geometry.box(F.col("x"), F.col("y"), F.col("w"), F.col("h")), 64).collect())
    met = lambda p, q: p[2] < q[2] + q[4] and q[2] < p[2] + p[4] and p[3] < q[3] + q[5] and q[3] < p[3] + p[5]
    solid = [b for b in boxes if b[4] and b[5]]
    assert got == sorted((p[1], q[1]) for p in solid for q in solid if p[0] == q[0] and p[1] < q[1] and met(p, q))


def test_boxes_in_one_cell_are_swept(spark):
    """Many boxes in one cell meet without a join of all with all; a after b in place, equal and missing ids, other types."""
    boxes = [("k", f"{(i * 7) % 600:03d}", i, i % 5, 3, 2) for i in range(600)] + [("k", "000", 1, 0, 3, 2), ("k", None, 1, 0, 3, 2), (None, "x", 1, 0, 3, 2), (None, "y", 1, 0, 3, 2), ("l", "z", 1, 0, 3, 2)]
    df = spark.createDataFrame(boxes, "k string, i string, x int, y int, w int, h int")
    out = joins.overlapping_pairs(df, "k", "i", geometry.box(F.col("x"), F.col("y"), F.col("w"), F.col("h")), 1_000)
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString() and out.schema["box_a"].dataType["x"].dataType.simpleString() == "int"
    met = lambda p, q: p[2] < q[2] + q[4] and q[2] < p[2] + p[4] and p[3] < q[3] + q[5] and q[3] < p[3] + p[5]
    solid = [b for b in boxes if b[0] and b[1]]
    got = sorted((r.a, r.b, *r.box_a, *r.box_b) for r in out.collect())
    assert got == sorted((p[1], q[1], *p[2:], *q[2:]) for p in solid for q in solid if p[0] == q[0] and p[1] < q[1] and met(p, q))
