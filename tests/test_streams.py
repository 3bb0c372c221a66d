"""The stream source, census and rules on built streams: one change for each rule."""

import numpy as np
import pytest
import streams
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewell.plans import inspect
from tidewell.sources import codec, pgs
from tidewell.sources.codec import COMPOSITION, END, NORMAL, OBJECT, PALETTE, WINDOWS


def at(parts, kind, n=0):
    return [i for i, p in enumerate(parts) if p[0] == kind][n]


def changed(parts, kind, n=0, pts=None, dts=None, payload=None):
    out, i = list(parts), at(parts, kind, n)
    _, a, b, c = out[i]
    out[i] = (kind, a if pts is None else pts, b if dts is None else dts, c if payload is None else payload)
    return out


E = streams.epoch()
S = streams.composition
LOOK = streams.shown
NOISE = np.random.default_rng(5).integers(1, 3, (1100, 1100)).astype(np.uint8)
CASES = {
    "good": (E, []),
    "two epochs": (E + streams.epoch(pts=1_500_000, number=2), []),
    "no start": (changed(E, COMPOSITION, payload=S(0, codec.ACQUISITION, [LOOK()])), ["epoch/start"]),
    "window off screen": (streams.epoch(windows=({**streams.WINDOW, "x": 1600},), objects=[LOOK(x=1600)]), ["epoch/window"]),
    "windows overlap": (streams.epoch(windows=(streams.WINDOW, {**streams.WINDOW, "window_id": 1, "x": 300})), ["epoch/window"]),
    "epoch too early": (E + streams.epoch(pts=900_000 + 180_000 + 3_000, number=2), ["pts_dts/epoch_start", "pts_dts/sanity"]),
    "no time to wipe": (changed(E, COMPOSITION, dts=900_000 - 5_000), ["pts_dts/epoch_start", "pts_dts/sanity"]),
    "objects told": (changed(E, COMPOSITION, payload=S(0, 0x80, [LOOK()], n_objects=3)), ["test_diplayset/objects"]),
    "palette flag": (changed(E, COMPOSITION, payload=S(0, 0x80, [LOOK()], pal_flag=True)), ["test_diplayset/pal_flag", "test_diplayset/pal_flag"]),
    "palette id": (changed(E, COMPOSITION, payload=S(0, 0x80, [LOOK()], pal_id=8)), ["object/palette", "test_diplayset/pal_id"]),
    "number": (changed(E, COMPOSITION, 1, payload=S(7, NORMAL)), ["test_diplayset/comp_n"]),
    "window changed": (changed(E, WINDOWS, 1, payload=codec.encode_windows([{**streams.WINDOW, "w": 390}])), ["epoch/window"]),
    "no windows": (changed(E, WINDOWS, 1, payload=b"\0"), ["test_diplayset/wds"]),
    "palette twice": (E[: at(E, PALETTE) + 1] + [(PALETTE, 891_000, 891_000, codec.encode_palette(0, 1, streams.COLOURS))] + E[at(E, PALETTE) + 1 :], ["test_diplayset/pds"]),
    "range": (streams.epoch(colours={1: (250, 128, 128, 255)}), ["palette/range"]),
    "reserved": (streams.epoch(colours={1: (120, 128, 128, 255), 255: (16, 128, 128, 9)}), ["palette/reserved"]),
    "version": (E[:-1] + [(PALETTE, E[-1][1], E[-1][1], codec.encode_palette(0, 5, {1: (120, 128, 128, 9)}))] + E[-1:], ["palette/version"]),
    "tiny object": (streams.epoch(size=(4, 12)), ["object/dimensions", "object/slot"]),
    "lines": (changed(E, OBJECT, payload=codec.object_fragments(0, 0, 16, 12, b"\x00\x91\x01")[0]), ["object/rle"]),
    "colour": (streams.epoch(bitmap=np.full((12, 16), 9, np.uint8)), ["object/palette"]),
    "unknown slot": (changed(E, COMPOSITION, payload=S(0, 0x80, [LOOK(3)])), ["object/slot"]),
    "crop": (changed(E, COMPOSITION, payload=S(0, 0x80, [LOOK(crop={"x": 10, "y": 0, "w": 10, "h": 5})])), ["object/crop"]),
    "empty crop": (changed(E, COMPOSITION, payload=S(0, 0x80, [LOOK(crop={"x": 0, "y": 0, "w": 0, "h": 5})])), ["object/crop"]),
    "outside window": (changed(E, COMPOSITION, payload=S(0, 0x80, [LOOK(x=90)])), ["object/window"]),
    "expired": (changed(E, COMPOSITION, 1, payload=S(1, codec.ACQUISITION, [LOOK()])), ["object/expired"]),
    "same pts": (changed(E, COMPOSITION, 1, pts=900_000), ["pts_dts/sanity", "test_diplayset/pts"]),
    "palette clock": (changed(E, PALETTE, pts=891_010), ["pts_dts/sanity"]),
    "object clock": (changed(E, OBJECT, pts=891_000), ["pts_dts/sanity"]),
    "slot size": (E[: at(E, END)] + [(OBJECT, 891_055, 891_000, codec.object_fragments(0, 1, 20, 12, codec.encode_rle(np.ones((12, 20), np.uint8)))[0])] + E[at(E, END) :], ["object/slot"]),
    "object changed": (E[: at(E, END)] + [(OBJECT, 891_055, 891_000, codec.object_fragments(0, 0, 16, 12, codec.encode_rle(np.full((12, 16), 2, np.uint8)))[0])] + E[at(E, END) :], ["object/version"]),
    "big object": (streams.epoch(size=(1100, 1100), bitmap=NOISE, windows=({"window_id": 0, "x": 0, "y": 0, "w": 1920, "h": 1080},), objects=[LOOK(x=0, y=0)]), None),
}


def written(folder, name, parts, tail=b""):
    path = folder / f"{name}.sup"
    path.write_bytes(streams.joined(parts) + tail)
    return str(path)


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("sup")
    for name, (parts, _) in CASES.items():
        written(d, name, parts)
    written(d, "cut", E, b"PG\0\0")
    written(d, "lost", E, b"XX" + bytes(20))
    written(d, "no end", E[:-1])
    (d / "empty.sup").write_bytes(b"")
    written(d, "unknown", [*E[:-1], (0x33, E[-1][1], E[-1][1], b"abc"), E[-1]])
    return d


@pytest.fixture(scope="module")
def found(spark, folder):
    rows = inspect.findings(pgs.read_segments(spark, str(folder)), pgs.read_status(spark, str(folder))).collect()
    out: dict[str, list[str]] = {}
    for r in rows:
        out.setdefault(r.file.rsplit("/", 1)[1][:-4], []).append(r.rule)
    return {k: sorted(v) for k, v in out.items()}


@pytest.mark.parametrize("name", [n for n, (_, rules) in CASES.items() if rules is not None])
def test_rule(found, name):
    assert found.get(name, []) == CASES[name][1]


def test_long_chains(found):
    assert "object/coded_size" in found["big object"]


def test_stream_rules(found):
    assert found["cut"] == ["stream"] and found["lost"] == ["stream", "stream"] and "stream" in found["no end"] and found["empty"] == ["stream"]


def test_status(spark, folder):
    rows = {r.file.rsplit("/", 1)[1]: r for r in pgs.read_status(spark, str(folder)).collect()}
    assert rows["cut.sup"].trailing_bytes == 4 and rows["lost.sup"].trailing_bytes == 22 and rows["no end.sup"].missing_final_ends
    assert rows["good.sup"].errors == [] and rows["good.sup"].trailing_bytes == 0 and rows["empty.sup"].errors


def test_unknown_type_is_a_row(spark, folder):
    kinds = [r.type_name for r in pgs.read_segments(spark, str(folder / "unknown.sup")).orderBy("seg_ord").collect()]
    assert kinds.count("UNKNOWN") == 1


def test_census(spark, folder):
    (r,) = inspect.census(inspect.with_sets(pgs.read_segments(spark, str(folder / "two epochs.sup")))).collect()
    assert (r.epochs, r.display_sets, r.segments, r.es, r.acq, r.nc, r.pu) == (2, 4, 16, 2, 0, 2, 0)
    assert r.bytes == (folder / "two epochs.sup").stat().st_size
    (e,) = inspect.census(inspect.encode_sets(pgs.read_segments(spark, str(folder / "two epochs.sup"))), pcs_first=True).collect()
    assert e == r


def test_write_and_read_again(spark, folder, tmp_path):
    segments = pgs.read_segments(spark, str(folder / "two epochs.sup"))
    out = tmp_path / "copy.sup"
    assert pgs.write_sup(segments, str(out)) == 16
    assert out.read_bytes() == (folder / "two epochs.sup").read_bytes()
    with pytest.raises(FileExistsError):
        pgs.write_sup(segments, str(out))
    pgs.write_elementary(segments, str(tmp_path / "a.pes"), str(tmp_path / "a.mui"))
    index = (tmp_path / "a.mui").read_bytes()
    assert index[:4] == b"\0\0\0\3" and len(index) == 4 + 16 * 14 + 14 and index[-14:] == b"\xff" + bytes(13)
    assert (tmp_path / "a.pes").stat().st_size == out.stat().st_size - 16 * 10


def test_bucket(spark, folder):
    s = pgs.read_segments(spark, str(folder / "good.sup"))
    level = {r.seg_ord: r.level for r in inspect.buffer_levels(s, 1_000).collect()}
    x, last = 1 << 20, None
    for r in s.orderBy("seg_ord").collect():
        gone = 90_000 if last is None else (r.dts - last) % (1 << 32)
        x = min(x + round(gone * 1_000 / 90_000), 1 << 20) - (r.size + 11)
        last = r.dts
        assert level[r.seg_ord] == x
    assert inspect.bitrate_stats(s, 1_000).first().ok
    low = inspect.findings(s, pgs.read_status(spark, str(folder / "good.sup")), 1).filter(F.col("rule") == "rx_bitrate")
    assert low.count() == 0


def test_missing_file(spark, tmp_path):
    assert pgs.read_status(spark, str(tmp_path / "none.sup")).first().errors
    assert pgs.read_segments(spark, str(tmp_path / "none.sup")).count() == 0


@pytest.mark.parametrize("line, out", [([5], "05 00 00"), ([5, 5], "05 05 00 00"), ([5] * 3, "00 83 05 00 00"), ([5] * 64, "00 C0 40 05 00 00"), ([0], "00 01 00 00"), ([0] * 300, "00 41 2C 00 00")])
def test_rle_vectors(line, out):
    assert codec.encode_rle(np.array([line], np.uint8)) == bytes.fromhex(out)


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 90), st.integers(1, 8), st.integers(0, 3), st.randoms())
def test_rle_round_trip(w, h, colours, rnd):
    bitmap = np.array([[rnd.choice([0, 1, 2, 255][: colours + 1]) for _ in range(w)] for _ in range(h)], np.uint8)
    back, ok = codec.decode_rle(codec.encode_rle(bitmap), w, h)
    assert ok and (back == bitmap).all()


def test_sets_close_at_end_and_format(spark, tmp_path):
    (tmp_path / "a.sup").write_bytes(streams.joined(E + streams.epoch(pts=1_500_000, number=2) + E[:2]))
    rows = pgs.read_segments(spark, str(tmp_path / "a.sup"), "PERMISSIVE")
    assert pgs.whole_display_sets(rows).count() == rows.count() - 2
    told = pgs.stream_format(rows).first()
    assert (told.width, told.height, told.fps) == (1920, 1080, 0x20)
    sets = inspect.with_sets(pgs.whole_display_sets(rows))
    assert [inspect.epoch(sets, n).count() for n in (0, 1, 2)] == [len(E), len(E), 0]
    assert inspect.epoch(sets, 1).agg(F.min("pts")).first()[0] >= 1_490_000


def test_rate_of_arriving_segments(spark, tmp_path):
    from tidewell.streaming.census import windowed_rate

    rows = [("a", float(t), n) for t, n in ((0.1, 10), (0.9, 20), (1.5, 30), (3.2, 40))]
    spark.createDataFrame(rows, "file string, t double, size int").write.parquet(str(tmp_path / "in"))
    arriving = spark.readStream.schema("file string, t double, size int").parquet(str(tmp_path / "in")).withColumn("at", F.timestamp_seconds("t"))
    query = windowed_rate(arriving, "at").writeStream.format("memory").queryName("rates").outputMode("update").trigger(availableNow=True).start()
    query.awaitTermination()
    got = {r.at: r.bytes for r in spark.table("rates").select(F.unix_timestamp("window.start").alias("at"), "bytes").collect()}
    h = codec.HEADER.size
    assert got == {0: 30 + 2 * h, 1: 30 + h, 3: 40 + h}


def test_parts_and_free_entries_of_bitmaps():
    from tidewell.raster.pixels import crop, free_index

    a = np.arange(12, dtype=np.uint8).reshape(3, 4)
    assert crop(a, 1, 1, 2, 2).tolist() == [[5, 6], [9, 10]] and crop(a, -1, 2, 2, 2).tolist() == [[255, 8], [255, 255]] and crop(a, 9, 9, 1, 1).tolist() == [[255]] and crop(a, 0, 0, 0, 3).shape == (3, 0)
    palette = np.array([[1, 1, 1, 255], [0, 0, 0, 0], [9, 9, 9, 8]], np.uint8)
    moved, table = free_index(np.array([[0, 1, 2]], np.uint8), palette)
    assert moved.tolist() == [[1, 255, 3]] and table[1].tolist() == [1, 1, 1, 255] and table[3].tolist() == [9, 9, 9, 8] and not table[255].any()


def test_parsed_segments_are_those_of_a_file(spark, tmp_path):
    (tmp_path / "a.sup").write_bytes(streams.joined(E))
    rows = pgs.read_segments(spark, str(tmp_path / "a.sup"))
    again = pgs.parsed(rows.select("file", "seg_ord", "type", "pts", "dts", "payload"))
    columns = [c for c in rows.columns if c != "byte_off"]
    assert sorted(map(repr, again.select(columns).collect())) == sorted(map(repr, rows.select(columns).collect()))
