"""Encoding small projects: the streams keep all rules and show what the pictures are."""

import struct
import zlib

import numpy as np
import pytest

from tidewell.plans import inspect
from tidewell.plans.encode import JobConfig, encode
from tidewell.plans.timing import HELD, NEW, NO_MARGIN, UPDATE, Progress, StateChoice, decode_duration, decode_margin, fuse_threshold
from tidewell.raster.layout import Box, decode_base, picture_similarity, windows_for
from tidewell.sources import bdn, codec, pgs


def png(rgba):
    h, w = rgba.shape[:2]
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    raw = b"".join(b"\0" + row.tobytes() for row in rgba)
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 6, 0, 0, 0)) + part(b"IDAT", zlib.compress(raw)) + part(b"IEND", b"")


def picture(w, h, colour=(250, 250, 250, 255), hole=True):
    a = np.zeros((h, w, 4), np.uint8)
    a[:] = colour
    if hole:
        a[h // 4 : h // 2, w // 4 : w // 2] = 0
    return a


def project(folder, events, rate="24", size="1080p", pictures=()):
    (folder / "img").mkdir(exist_ok=True)
    for name, a in pictures:
        (folder / "img" / name).write_bytes(png(a))
    lines = []
    for begin, end, forced, graphics in events:
        inner = "".join(f'<Graphic X="{x}" Y="{y}" Width="{w}" Height="{h}">{p}</Graphic>' for x, y, w, h, p in graphics)
        lines.append(f'<Event InTC="{begin}" OutTC="{end}" Forced="{forced}">{inner}</Event>')
    text = f'<?xml version="1.0" encoding="UTF-8"?><BDN Version="0.93"><Description><Format VideoFormat="{size}" FrameRate="{rate}" DropFrame="false"/></Description><Events>{"".join(lines)}</Events></BDN>'
    (folder / "p.xml").write_text(text.replace("1080p", "1080"))
    return str(folder / "p.xml"), str(folder / "img")


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("project")
    fade = [picture(200, 40, (250, 250, 250, a)) for a in (255, 250, 245)]
    both = [("a.png", picture(120, 40)), ("b.png", picture(64, 30, (200, 30, 30, 255))), ("c.png", picture(300, 50, (20, 200, 20, 255))), *[(f"f{i}.png", f) for i, f in enumerate(fade)]]
    events = [
        ("00:00:10:00", "00:00:12:00", "False", [(900, 950, 120, 40, "a.png")]),
        ("00:00:12:00", "00:00:13:00", "False", [(900, 950, 120, 40, "a.png")]),  # the same picture goes on
        ("00:00:20:00", "00:00:22:00", "TRUE", [(100, 80, 64, 30, "b.png"), (1500, 980, 300, 50, "c.png")]),  # two windows
        ("00:00:30:00", "00:00:31:00", "False", [(800, 900, 200, 40, "f0.png")]),
        ("00:00:31:00", "00:00:32:00", "False", [(800, 900, 200, 40, "f1.png")]),  # a fade
        ("00:00:32:00", "00:00:33:00", "False", [(800, 900, 200, 40, "f2.png")]),
        ("00:00:40:00", "00:00:40:00", "False", [(0, 0, 120, 40, "a.png")]),  # no time at all
        ("00:00:50:00", "00:00:51:00", "False", []),  # nothing to show
    ]
    xml, img = project(d, events, pictures=both)
    segments = encode(spark, xml, img).cache()
    out = d / "out.sup"
    pgs.write_sup(segments, str(out))
    return spark, segments, str(out), d


def test_stream_keeps_the_rules(made):
    spark, _, out, _ = made
    found = inspect.findings(pgs.read_segments(spark, out), pgs.read_status(spark, out), 10_000).collect()
    assert [(r.rule, r.ds, r.detail) for r in found] == []


def test_census(made):
    spark, _, out, _ = made
    r = inspect.census(inspect.with_sets(pgs.read_segments(spark, out))).first()
    # Three epochs; the same picture is one set, the fade one set and two palettes, each epoch is cleared.
    assert (r.epochs, r.es, r.pu, r.display_sets) == (3, 3, 2, 8)


def test_pictures_come_back(made):
    spark, _, out, _ = made
    rows = pgs.read_segments(spark, out).orderBy("seg_ord").collect()
    first = next(r for r in rows if r.ods is not None)
    bitmap, ok = codec.decode_rle(bytes(first.ods.data), first.ods.w, first.ods.h)
    seen = picture(120, 40)[..., 3] > 0
    assert ok and bitmap.shape == (40, 120) and ((bitmap != 255) == seen).all()
    entry = next(r for r in rows if r.pds is not None).pds.entries[int(bitmap[0, 0])]
    assert entry.a == 255 and 225 <= entry.y <= 235 and abs(entry.cb - 128) <= 1
    numbers = [r.pcs.number for r in rows if r.pcs is not None]
    assert numbers == [*range(len(numbers))]
    assert {r.pcs.objects[0].forced for r in rows if r.pcs is not None and r.pcs.objects} == {True, False}
    two = [r for r in rows if r.wds is not None and len(r.wds) == 2]
    assert two and len({(w.x, w.y) for w in two[0].wds}) == 2


def test_clocks(made):
    _, segments, _, _ = made
    first = segments.filter("seg_ord = 0").first()
    assert first.pts == 10 * 90_000


def test_order_of_partitions_does_not_matter(made, spark):
    _, segments, _, d = made
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        again = encode(spark, str(d / "p.xml"), str(d / "img")).orderBy("seg_ord").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert [(r.pts, r.dts, bytes(r.payload)) for r in again] == [(r.pts, r.dts, bytes(r.payload)) for r in segments.orderBy("seg_ord").collect()]


def test_refreshes(made, spark):
    _, _, _, d = made
    r = encode(spark, str(d / "p.xml"), str(d / "img"), JobConfig(refresh_seconds=1.0))
    assert r.filter("type = 22").count() > 8


def test_bad_projects(spark, tmp_path):
    event = [("00:00:10:00", "00:00:12:00", "False", [(0, 0, 120, 40, "a.png")])]
    small = [("a.png", picture(60, 40))]
    with pytest.raises(ValueError):
        encode(spark, *project(tmp_path, event, pictures=small))
    with pytest.raises(ValueError):
        encode(spark, *project(tmp_path, event, rate="27", pictures=small))
    with pytest.raises(ValueError):
        encode(spark, *project(tmp_path, event, size="640x480", pictures=small))
    xml, _ = project(tmp_path, [("00:00:10:00", "00:00:12:00", "x", [(0, 0, 20, 20, "a"), (10, 10, 20, 20, "b")])])
    assert bdn.overlapping_graphics(bdn.read_events(spark, xml, 24)).count() == 1
    assert bdn.read_header(spark, project(tmp_path, event, rate="24000/1001")[0]).first().rate.code == 0x10


@pytest.mark.parametrize("size, update", [((100, 50), False), ((1900, 1000), True)])
def test_wipes(size, update):
    from tidewell.plans.encode import EpochEncoder, JobConfig, Shown, Video

    video = Video(1920, 1080, 24, 1, 0x20)
    e = EpochEncoder(video, JobConfig(), [Box(0, 0, *size)], 0)
    e.chain([Shown(241, 265, False, False, 0, 0, picture(*size))], True)
    e.clear(265)
    *_, last = [codec.decode_composition(p) for kind, _, _, p in e.rows if kind == codec.COMPOSITION]
    assert last["pal_flag"] == update and bool(last["objects"]) == update
    *_, entries = [codec.decode_palette(p)["entries"] for kind, _, _, p in e.rows if kind == codec.PALETTE]
    assert all(c["a"] == 0 for c in entries.values()) == update


def brute_windows(mask):
    """The best vertical cut by trying each."""
    ys, xs = np.nonzero(mask)
    best = None
    for cut in range(xs.min() + 1, xs.max() + 1):
        a, b = mask[:, :cut], mask[:, cut:]
        if a.any() and b.any():
            area = sum((np.ptp(np.nonzero(p)[0]) + 1) * (np.ptp(np.nonzero(p)[1]) + 1) for p in (a, b))
            best = area if best is None else min(best, area)
    return best


def test_layout():
    rnd = np.random.default_rng(2)
    for _ in range(60):
        mask = np.zeros((120, 200), bool)
        for _ in range(2):
            x, y = rnd.integers(0, 150), rnd.integers(0, 90)
            mask[y : y + rnd.integers(9, 30), x : x + rnd.integers(9, 50)] = True
        container, a, b, stacked = windows_for(mask)
        ys, xs = np.nonzero(mask)
        for w in (a, b):
            assert w.w >= 8 and w.h >= 8
        inside = np.zeros_like(mask)
        for w in (a, b):
            inside[w.y : w.bottom, w.x : w.right] = True
        assert inside[mask].all()
        if a != b and not stacked and min(a.w, a.h, b.w, b.h) > 8:
            assert a.area + b.area <= brute_windows(mask)
    assert windows_for(np.zeros((50, 60), bool))[0] == Box(0, 0, 60, 50)


def test_timing():
    assert decode_base([], 1920 * 1080) == 5832 and decode_base([1920 * 1080], 1920 * 1080) == 11664 + 5832
    assert decode_duration(codec.NORMAL, 0, {0: 40_000}, [], {}) == 114
    assert decode_duration(codec.EPOCH_START, 1920 * 1080, {0: 4_000}, [(0, 0)], {0: 4_000}) == 5832 + 12
    assert fuse_threshold(1080, 1.0, 1.0) == pytest.approx(0.9608 + 1080 * 0.014 / 600)


def test_states():
    choice, now = StateChoice(0.5, 1.0, 2), Progress()
    state, _, now = choice.next(now, NEW)
    assert state == codec.EPOCH_START and now == Progress(0.0, 0)
    state, again, now = choice.next(now, HELD, margin=0.4)
    assert (state, again) == (codec.NORMAL, False) and now == Progress(1.0, 1) and not choice.due(now)
    for _ in range(2):
        _, _, now = choice.next(now, HELD, margin=0.0)
    assert choice.due(now) and choice.acquired(now) == Progress(3.0, 0)
    # The bar has fallen to 0.5 - 3 * 0.035.
    assert choice.next(now, HELD, margin=0.395)[0] == codec.NORMAL
    assert choice.next(now, HELD, margin=0.396) == (codec.ACQUISITION, True, Progress(0.0, 0))
    assert choice.next(now, HELD, must=True) == (codec.ACQUISITION, False, Progress(0.0, 0))
    assert choice.next(now, UPDATE, must=True) == (codec.NORMAL, False, Progress(3.0, 4))
    assert StateChoice(0.0).next(now, NEW)[0] == codec.ACQUISITION and StateChoice(0.0).next(Progress(), HELD)[0] == codec.NORMAL
    assert decode_margin(100, 80, 500, 400, 50, 10) == 2.0 and decode_margin(80, 80, 500, 400, 50, 10) == decode_margin(100, 80, 440, 400, 50, 10) == NO_MARGIN


def stream(spark, tmp_path, events, pictures, **options):
    xml, img = project(tmp_path, events, pictures=pictures)
    out = str(tmp_path / "out.sup")
    pgs.write_sup(encode(spark, xml, img, JobConfig(**options)), out, overwrite=True)
    rows = pgs.read_segments(spark, out).orderBy("seg_ord").collect()
    bad = [(r.rule, r.ds, r.detail) for r in inspect.findings(pgs.read_segments(spark, out), pgs.read_status(spark, out)).filter("hard").collect()]
    return rows, [(r.pcs.state, len(r.pcs.objects)) for r in rows if r.pcs is not None], bad


def test_compression_changes_the_stream(spark, tmp_path):
    """A picture that comes back after a short gap is still held: with time to spare it is sent again or not."""
    shown = lambda a, b: (f"00:00:{a}", f"00:00:{b}", "False", [(900, 950, 120, 40, "a.png")])
    events = [shown("10:00", "11:00"), shown("11:01", "12:00"), shown("12:01", "13:00")]
    pictures = [("a.png", picture(120, 40))]
    sent = {}
    for compression in (0.0, 1.0):
        rows, states, bad = stream(spark, tmp_path, events, pictures, compression=compression)
        sent[compression] = sum(r.ods is not None for r in rows)
        assert bad == [] and states[0] == (codec.EPOCH_START, 1)
    # The bar falls with every set that passes, so that even the highest one lets the third set through.
    assert sent == {0.0: 2, 1.0: 3}


def test_slots_and_content(spark, tmp_path):
    """Objects have the epoch's largest size, placed where the content is, or with tight their own."""
    wide, small = picture(200, 60), picture(60, 30, (10, 200, 30, 255))
    events = [("00:00:10:00", "00:00:11:00", "False", [(800, 900, 200, 60, "w.png")]), ("00:00:11:00", "00:00:12:00", "False", [(850, 940, 60, 30, "s.png")])]
    rows, states, bad = stream(spark, tmp_path, events, [("w.png", wide), ("s.png", small)], single_object=True)
    assert bad == [] and [(r.ods.w, r.ods.h) for r in rows if r.ods] == [(200, 60)] * 2 and states[1][0] == codec.ACQUISITION
    for r, (x, y, a) in zip([r for r in rows if r.ods], ((800, 900, wide), (850, 940, small))):
        pcs = next(p.pcs for p in rows if p.pcs is not None and any(o.o_id == r.ods.o_id for o in p.pcs.objects))
        o = next(o for o in pcs.objects if o.o_id == r.ods.o_id)
        bitmap, _ = codec.decode_rle(bytes(r.ods.data), r.ods.w, r.ods.h)
        at = bitmap[y - o.y : y - o.y + a.shape[0], x - o.x : x - o.x + a.shape[1]]
        assert ((at != 255) == (a[..., 3] > 0)).all() and (bitmap != 255).sum() == (a[..., 3] > 0).sum()
    rows, _, _ = stream(spark, tmp_path, events, [("w.png", wide), ("s.png", small)], single_object=True, tight=True)
    assert [(r.ods.w, r.ods.h) for r in rows if r.ods] == [(200, 60), (60, 30)]


def test_due_acquisition_is_put_in(spark, tmp_path):
    fade = [(f"f{i}.png", picture(200, 40, (250, 250, 250, 255 - i))) for i in range(6)]
    events = [(f"00:00:1{i}:00", f"00:00:1{i + 1}:00", "False", [(800, 900, 200, 40, f"f{i}.png")]) for i in range(6)]
    rows, states, bad = stream(spark, tmp_path, events, fade, acquisition_after=2)
    plain, before, _ = stream(spark, tmp_path, events, fade)
    assert bad == [] and [s for s, _ in states].count(codec.ACQUISITION) == 1 and len(states) == len(before) + 1
    put_in = next(r for r in rows if r.pcs is not None and r.pcs.state == codec.ACQUISITION)
    assert put_in.pts not in {r.pts for r in plain} and put_in.pts % 3750 == 0


def test_one_window_changes_alone(spark, tmp_path):
    events = [
        ("00:00:10:00", "00:00:14:00", "False", [(100, 80, 64, 30, "b.png")]),
        ("00:00:12:00", "00:00:16:00", "False", [(1500, 980, 300, 50, "c.png")]),
    ]
    pictures = [("b.png", picture(64, 30, (200, 30, 30, 255))), ("c.png", picture(300, 50, (20, 200, 20, 255)))]
    rows, states, bad = stream(spark, tmp_path, events, pictures, normal_case=True)
    assert bad == [] and states == [(codec.EPOCH_START, 1), (codec.NORMAL, 2), (codec.NORMAL, 1), (codec.NORMAL, 0)]
    entries = [r.pds.entries for r in rows if r.pds is not None]
    assert len(entries) == 2 and set(entries[0]) < set(entries[1])
    _, states, bad = stream(spark, tmp_path, events, pictures)
    assert bad == [] and codec.ACQUISITION in [s for s, _ in states]


def test_pictures_by_path(spark, tmp_path):
    """Pictures of one name in two folders."""
    for sub, colour in (("one", (250, 250, 250, 255)), ("two", (10, 10, 200, 255))):
        (tmp_path / "img" / sub).mkdir(parents=True)
        (tmp_path / "img" / sub / "a.png").write_bytes(png(picture(120, 40, colour)))
    events = [("00:00:10:00", "00:00:11:00", "False", [(0, 0, 120, 40, "img/one/a.png")]), ("00:00:20:00", "00:00:21:00", "False", [(0, 0, 120, 40, "./img/x/../two/a.png")])]
    rows, _, bad = stream(spark, tmp_path, events, [])
    ys = [max(e.y for e in r.pds.entries.values()) for r in rows if r.pds is not None]
    assert bad == [] and len(ys) == 2 and ys[0] > 200 > 100 > ys[1]


def test_overlapping_pictures_are_rejected(spark, tmp_path):
    with pytest.raises(ValueError, match="overlap"):
        encode(spark, *project(tmp_path, [("00:00:10:00", "00:00:12:00", "x", [(0, 0, 120, 40, "a.png"), (60, 10, 120, 40, "a.png")])], pictures=[("a.png", picture(120, 40))]))


def test_command(spark, tmp_path, capsys):
    import json

    from tidewell.plans.__main__ import main, matrix_of

    event = [("00:00:10:00", "00:00:12:00", "False", [(0, 0, 120, 40, "a.png")]), ("00:00:20:00", "00:00:22:00", "False", [(0, 0, 120, 40, "a.png")])]
    xml, img = project(tmp_path, event, pictures=[("a.png", picture(120, 40))])
    (tmp_path / "q.ini").write_text("[PILIQ]\ndither = 1\nquality=50\n")
    out = str(tmp_path / "o.sup")
    run = ["encode", xml, img, out, "--json", "-q", "1", "--config", str(tmp_path / "q.ini"), "--bt-matrix", "BT.601", "-c", "60", "--redraw-period", "0.5", "-m", "60000"]
    assert main(run) == 0
    said = [json.loads(x) for x in capsys.readouterr().out.splitlines() if x.startswith("{")]
    assert [e["type"] for e in said if e["type"] in ("log", "done")] == ["log", "done"]
    assert [(e["percent"], e["epoch"], e["total"]) for e in said if e["type"] == "progress"] == [(0, 0, 2), (50, 1, 2), (100, 2, 2)]
    assert len([e for e in said if e["type"] == "warn"]) == 2
    done = said[-1]
    assert done["success"] and (done["events"], done["epochs"], done["es"], done["display_sets"]) == (2, 2, 2, 4)
    assert main(run) == 1 and main([*run, "-y"]) == 0 and main(["encode", xml, img, out, "-m", "5"]) == 1
    assert [matrix_of(x) for x in ("601", "bt-2020", "x")] == ["bt601", "bt2020", None]
    assert not [p for p in tmp_path.iterdir() if p.name.endswith(".part")]
    capsys.readouterr()
    assert main(["stats", out, "--text"]) == 0 and "epochs 2, display_sets 4" in capsys.readouterr().out
    assert main(["validate", out]) == 0


def test_failed_write_leaves_nothing(spark, tmp_path):
    from pyspark.sql import functions as F

    rows = spark.range(3).select(F.col("id").alias("seg_ord"), F.lit(128).cast("short").alias("type"), F.lit(0).cast("long").alias("pts"), F.lit(0).cast("long").alias("dts"), F.when(F.col("id") == 2, F.raise_error(F.lit("no")).cast("binary")).alias("payload"))
    with pytest.raises(Exception):
        pgs.write_sup(rows, str(tmp_path / "x.sup"))
    with pytest.raises(FileExistsError):
        (tmp_path / "b").write_bytes(b"kept")
        pgs.write_elementary(rows.filter("seg_ord < 2"), str(tmp_path / "a"), str(tmp_path / "b"))
    assert [p.name for p in tmp_path.iterdir()] == ["b"] and (tmp_path / "b").read_bytes() == b"kept"


def test_dithered_palette_keeps_the_mean():
    from tidewell.raster.colours import dithered

    ramp = np.zeros((16, 64, 4), np.uint8)
    ramp[..., 0], ramp[..., 3] = np.arange(64), 255
    table = np.array([[0, 0, 0, 255], [63, 0, 0, 255]], np.uint8)
    got = table[dithered(ramp, table)][..., 0].astype(int)
    plain = table[(ramp[..., 0] > 31).astype(int)][..., 0].astype(int)
    off = lambda a: abs(a[:, 16:32].mean() - ramp[:, 16:32, 0].mean())
    assert set(np.unique(got)) == {0, 63} and off(got) < off(plain)


def test_similarity():
    a = picture(90, 60)
    assert picture_similarity(a, a)[0] == 1.0
    b = a.copy()
    b[..., :3] //= 2
    assert picture_similarity(a, b)[0] < 0.9
    assert picture_similarity(a, np.zeros_like(a)) == (1.0, 1.0)
