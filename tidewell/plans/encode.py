"""From a subtitle project to a stream.

Events are read, folded and expanded as DataFrames; groups of events with less than a decoder's
time between them are the unit of parallel work. A function over each group splits it into epochs,
chooses windows, fuses alike pictures into chains with one bitmap and changing palettes, and gives
the segments. Only composition numbers run through all epochs; they are put in afterwards from a
row for each epoch.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.functions import color, timecode
from tidewell.functions.ticks import FREQ
from tidewell.operators import sequence
from tidewell.plans.timing import HELD, NEW, UPDATE, Progress, StateChoice, copy, decode, decode_duration, decode_margin, fuse_threshold
from tidewell.raster import layout, pixels
from tidewell.raster.colours import BACKENDS, sequence_bitmap
from tidewell.sources import bdn, codec

SEGMENTS = "job string, grp bigint, epoch bigint, seg_in_epoch bigint, type smallint, pts bigint, dts bigint, payload binary"
_SCHEMA = pa.schema([("job", pa.string()), ("grp", pa.int64()), ("epoch", pa.int64()), ("seg_in_epoch", pa.int64()), ("type", pa.int16()), ("pts", pa.int64()), ("dts", pa.int64()), ("payload", pa.binary())])
#: Two windows beyond this area do not leave the coded buffer room, and become one.
WINDOW_AREA = (1 << 20) - 150
COLOURS = 254
#: Ticks that a wipe of the windows has to leave of a frame.
WIPE_SLACK = 3
#: Bitrates beyond which there is a warning; wipes that an event has to be longer than for an acquisition
#: to be put in, ticks that are left around it and the most that it may wait for, and the least side of an object.
MOST_KBPS, LEAST_KBPS = 48_000, 500
WIPES, AROUND, LONGEST_WAIT, LEAST_SIDE = 4.5, 2, FREQ // 4, 8


@dataclass(frozen=True)
class JobConfig:
    """Options of a run; values out of range are brought back as the command line does, with a warning in
    `warnings`. compression: 0 acquires every new picture, 1 sends a held one again whenever there is any time;
    rate: how fast a drought grows; acquisition_after: palette updates before a picture is sent again; normal_case:
    of two windows one may change alone; tight: objects as large as their content instead of their window's slot;
    full_palette: updates send whole palettes; dither, colours: for the quantiser."""

    backend: str = "means"
    matrix: str = "bt709"
    compression: float = 0.8
    rate: float = 1.0
    acquisition_after: int = 0
    refresh_seconds: float = 0.0
    similarity_offset: float = 0.0
    single_object: bool = False
    normal_case: bool = False
    tight: bool = False
    full_palette: bool = False
    any_size: bool = False
    dither: bool = False
    colours: int = COLOURS
    max_kbps: int = 0
    warnings: tuple[str, ...] = field(default=(), compare=False)

    def __post_init__(self):
        put, said = partial(object.__setattr__, self), []
        if self.backend not in BACKENDS:
            said.append(f"unknown quantiser {self.backend}, using {next(iter(BACKENDS))}")
            put("backend", next(iter(BACKENDS)))
        if self.matrix not in color.WEIGHTS:
            raise ValueError(f"unknown colour matrix {self.matrix}")
        if 0 < self.refresh_seconds < 1:
            said.append("a refresh below one second is none")
        if self.refresh_seconds < 1:
            put("refresh_seconds", 0.0)
        put("compression", min(1.0, max(0.0, self.compression)))
        put("rate", min(1.0, max(0.0, self.rate)))
        put("similarity_offset", min(1.0, max(-1.0, self.similarity_offset)))
        put("acquisition_after", max(0, self.acquisition_after))
        put("colours", min(COLOURS, max(2, self.colours)))
        if self.single_object and self.normal_case:
            said.append("the normal case needs two windows")
        if self.max_kbps and self.max_kbps < 10:
            raise ValueError("a bitrate below 10 kbit/s")
        if self.max_kbps > MOST_KBPS:
            said.append("the bitrate is beyond what discs allow")
        elif 10 < self.max_kbps < LEAST_KBPS:
            said.append("the bitrate is low, there will be many findings")
        put("warnings", tuple(dict.fromkeys([*self.warnings, *said])))


@dataclass(frozen=True)
class Video:
    width: int
    height: int
    num: int
    den: int
    code: int

    def pts(self, frame: int) -> int:
        return 0 if frame <= 1 else (frame - 1) * FREQ * self.den // self.num

    @property
    def area(self) -> int:
        return self.width * self.height


def ycbcr(palette: dict[int, tuple], matrix: str) -> dict[int, tuple[int, int, int, int]]:
    """Entries as Y, Cr, Cb, alpha in limited range."""
    if not palette:
        return {}
    rgb = np.array([c[:3] for c in palette.values()], float)
    y, cb, cr = (np.clip(np.rint(rgb @ np.array(m)) + o, 16, t).astype(int) for m, o, t in zip(color.matrix(matrix), (16, 128, 128), (235, 240, 240)))
    return {i: (int(a), int(b), int(c), int(e[3])) for (i, e), a, b, c in zip(palette.items(), y, cr, cb)}


@dataclass
class Shown:
    """An event with its picture on the whole screen's coordinates."""

    begin: int
    end: int
    forced: bool
    refresh: bool
    x: int
    y: int
    picture: np.ndarray

    def on(self, b: layout.Box) -> np.ndarray:
        out = np.zeros((b.h, b.w, 4), np.uint8)
        pixels.paste(out, self.picture, self.x - b.x, self.y - b.y)
        return out

    def mark(self, mask: np.ndarray) -> None:
        h, w = self.picture.shape[:2]
        y0, x0, y1, x1 = max(self.y, 0), max(self.x, 0), min(self.y + h, mask.shape[0]), min(self.x + w, mask.shape[1])
        if y1 > y0 and x1 > x0:
            mask[y0:y1, x0:x1] |= self.picture[y0 - self.y : y1 - self.y, x0 - self.x : x1 - self.x, 3] > 0


def pictured(rows: list[dict]) -> list[Shown]:
    """The events of a group in order; those without any picture, or an empty one, are left out."""
    out, at = [], {}
    for r in sorted(rows, key=lambda r: (r["frame_in"], r["event_ord"], r["k"])):
        key = (r["event_ord"], r["k"])
        if key not in at:
            at[key] = Shown(r["frame_in"], r["frame_out"], r["forced"], r["copy"], r["x"], r["y"], np.zeros((max(r["h"], 0), max(r["w"], 0), 4), np.uint8))
            out.append(at[key])
        if r["data"] is not None:
            pixels.paste(at[key].picture, bdn.rgba(r["data"], r["width"], r["height"], r["channels"]), r["at_x"], r["at_y"])
    return [e for e in out if e.picture[..., 3].any()]


def windows_of(mask: np.ndarray, single: bool) -> list[layout.Box]:
    container, a, b, _ = layout.windows_for(mask)
    if single or a == b or container.area and a.area + b.area >= WINDOW_AREA:
        return [container]
    return [a, b]


def split_epochs(events: list[Shown], video: Video, single: bool) -> list[list[Shown]]:
    """Cuts a group from its end on: an epoch is closed where the events before end long enough ahead of
    it to decode its windows; events that touch are never cut."""
    epochs: list[list[Shown]] = []
    mask = np.zeros((video.height, video.width), bool)
    for e in reversed(events):
        if epochs and e.end < epochs[-1][-1].begin:
            need = layout.decode_base([w.area for w in windows_of(mask, single)], video.area)
            if video.pts(e.end) + need < video.pts(epochs[-1][-1].begin):
                epochs.append([])
                mask[:] = False
        elif not epochs:
            epochs.append([])
        epochs[-1].append(e)
        e.mark(mask)
    return [own[::-1] for own in reversed(epochs)]


def content(events: list[Shown], window: layout.Box) -> tuple[int, int, int, int] | None:
    """The box (in the window) of what the events show there."""
    mask = np.zeros((window.h, window.w), bool)
    for e in events:
        mask |= e.on(window)[..., 3] > 0
    return pixels.bounds(mask)


def slots(parts: list[list[Shown]], windows: list[layout.Box]) -> dict[int, tuple[int, int]]:
    """The size that objects have in each window of an epoch: that of the largest content, LEAST_SIDE at least."""
    out = {}
    for i, w in enumerate(windows):
        boxes = [b for b in (content(p, w) for p in parts) if b]
        out[i] = tuple(max([LEAST_SIDE, *(b[k] for b in boxes)]) for k in (2, 3))
    return out


@dataclass
class Held:
    """What is on screen in a window: an object of the decoder's buffer, its bitmap, where it stands and until when."""

    object: int
    bitmap: np.ndarray
    x: int
    y: int
    until: int


class EpochEncoder:
    def __init__(self, video: Video, config: JobConfig, windows: list[layout.Box], last_dts: int, sizes: dict[int, tuple[int, int]] | None = None):
        self.video, self.config, self.windows = video, config, windows
        self.areas = {i: w.area for i, w in enumerate(windows)}
        self.sizes = sizes or {i: (w.w, w.h) for i, w in enumerate(windows)}
        self.choice, self.progress = StateChoice(1 - config.compression, config.rate, config.acquisition_after), Progress()
        self.rows: list[tuple[int, int, int, bytes]] = []
        self.count, self.palette_version, self.turn, self.versions = 0, -1, dict.fromkeys(self.areas, 1), {}
        self.palette: dict[int, tuple] = {}
        #: The last object of each window, and those of them that are on screen.
        self.buffer: dict[int, Held] = {}
        self.shown: list[int] = []
        self.last_dts = last_dts
        #: When the last picture began and ended, and what the epoch's first set takes.
        self.last_span, self.full = (0, 0), 0

    def definition(self) -> bytes:
        return codec.encode_windows([{"window_id": i, "x": w.x, "y": w.y, "w": w.w, "h": w.h} for i, w in enumerate(self.windows)])

    def composition(self, state: int, forced: bool, update: bool = False) -> bytes:
        v = self.video
        objects = [{"o_id": h.object, "window_id": w, "forced": forced, "x": self.windows[w].x + h.x, "y": self.windows[w].y + h.y, "crop": None} for w in self.shown for h in (self.buffer[w],)]
        self.count += 1
        return codec.encode_composition({"width": v.width, "height": v.height, "fps": v.code, "number": self.count - 1, "state": state, "pal_flag": update, "pal_id": 0, "objects": objects})

    def spent(self, state: int, sent: list[int], update: bool = False) -> int:
        """Ticks that the decoder needs for what is on screen, of which the objects of some windows are sent."""
        shown = [(self.buffer[w].object, w) for w in self.shown]
        return decode_duration(state, self.video.area, self.areas, shown, {self.buffer[w].object: self.buffer[w].bitmap.size for w in sent}, update)

    def put(self, state: int, pts: int, forced: bool, palette: dict | None, sent: list[int], update: bool = False) -> None:
        """A display set of what is on screen, with the objects of the windows in sent. Clocks of its segments never
        go back, also against the set before."""
        dts = min(max(pts - self.spent(state, sent, update), self.last_dts + 1), pts - 1)
        wipe = copy(sum(self.areas.values()))
        self.rows.append((codec.COMPOSITION, pts, dts, self.composition(state, forced, update)))
        at = dts
        if not update:
            # A window's clock follows the set's DTS and leaves time to copy it before the PTS.
            self.rows.append((codec.WINDOWS, max(pts - wipe, dts + 1), dts, self.definition()))
        if palette is not None:
            self.palette_version += 1
            self.rows.append((codec.PALETTE, dts, dts, codec.encode_palette(0, self.palette_version, ycbcr(palette, self.config.matrix))))
        for w in sent:
            o, bitmap = self.buffer[w].object, self.buffer[w].bitmap
            done = min(max(at + decode(bitmap.size), at + 1), pts)
            self.versions[o] = self.versions.get(o, -1) + 1
            for part in codec.object_fragments(o, self.versions[o], bitmap.shape[1], bitmap.shape[0], codec.encode_rle(bitmap)):
                self.rows.append((codec.OBJECT, done, at, part))
            at = done
        self.rows.append((codec.END, at, at, b""))
        self.last_dts = at

    def pictures(self, events: list[Shown]) -> tuple[dict[int, tuple[np.ndarray, int, int]], list[dict[int, tuple]]]:
        """For each window with content one bitmap and its place, and the palettes of the events. The bitmap has the
        window's slot, moved to where the content is."""
        places = {}
        for i, w in enumerate(self.windows):
            box = content(events, w)
            if box:
                x, y, own_w, own_h = box
                width, height = (max(own_w, min(LEAST_SIDE, w.w)), max(own_h, min(LEAST_SIDE, w.h))) if self.config.tight else self.sizes[i]
                places[i] = layout.Box(min(x, w.w - width), min(y, w.h - height), width, height)
        boxes = [layout.Box(self.windows[i].x + p.x, self.windows[i].y + p.y, p.w, p.h) for i, p in places.items()]
        frames = [np.concatenate([e.on(b).reshape(-1, 4) for b in boxes])[None] for e in events]
        bitmap, palettes = sequence_bitmap(frames, self.config.colours, self.config.backend, self.config.dither)
        cuts = np.cumsum([0, *(b.area for b in boxes)])
        return {i: (bitmap[0, a:z].reshape(p.h, p.w), p.x, p.y) for (i, p), a, z in zip(places.items(), cuts, cuts[1:])}, palettes

    def margin(self, events: list[Shown], sent: list[int]) -> float:
        pts = self.video.pts(events[0].begin)
        begin, end = (self.video.pts(f) for f in self.last_span)
        needed = decode_duration(codec.NORMAL, self.video.area, self.areas, [(self.buffer[w].object, w) for w in sent], {self.buffer[w].object: self.buffer[w].bitmap.size for w in sent})
        return decode_margin(pts - needed, self.last_dts, pts, begin, self.full, pts - end if pts > end else end - begin)

    def beside(self, events: list[Shown], parts: dict, palettes: list[dict]) -> int | None:
        """The normal case: the other one of two windows changes while this one's picture stays. The number that
        the new entries are moved up by, or None if it is not one."""
        on = [w for w in self.shown if self.buffer[w].until > events[0].begin]
        if not self.config.normal_case or len(self.windows) < 2 or not on or len(on) < len(self.shown) or set(on) & set(parts):
            return None
        up = max(self.palette, default=0)
        return up if up + max((max(p, default=0) for p in palettes), default=0) <= COLOURS else None

    def chain(self, events: list[Shown], first: bool) -> None:
        """A picture and those that look like it: one bitmap for each window, then palettes."""
        parts, palettes = self.pictures(events)
        pts, end = self.video.pts(events[0].begin), events[-1].end
        up = None if first else self.beside(events, parts, palettes)
        if up is not None:
            old, at = ([*self.shown], dict(self.buffer)), self.turn.copy()
            self.load(parts, end, up)
            self.shown = sorted({*old[0], *parts})
            if pts - self.spent(codec.NORMAL, [*parts]) <= self.last_dts:
                (self.shown, self.buffer), self.turn, up = old, at, None
        if up is not None:
            _, _, self.progress = self.choice.next(self.progress, UPDATE)
            palettes = [{i + up: c for i, c in p.items()} for p in palettes]
            # Palettes are fused; of equal numbers the last would win, but there are none.
            self.palette = self.palette | palettes[0]
            self.put(codec.NORMAL, pts, events[0].forced, self.palette, [*parts])
        else:
            held = not first and all(i in self.buffer and np.array_equal(parts[i][0], self.buffer[i].bitmap) for i in parts)
            if held:
                # An object may stand elsewhere than before without being sent again.
                for i, (_, x, y) in parts.items():
                    self.buffer[i].x, self.buffer[i].y, self.buffer[i].until = x, y, end
            spare = self.margin(events, sorted(parts)) if held else 0.0
            state, _, self.progress = self.choice.next(self.progress, HELD if held else NEW, not first and (not held or events[0].refresh), spare)
            state = codec.EPOCH_START if first else state
            if state != codec.NORMAL:
                self.load(parts, end, 0)
            self.shown = sorted(parts)
            if first:
                self.full = self.spent(state, [*parts])
            self.palette = dict(palettes[0])
            self.put(state, pts, events[0].forced, self.palette, [*parts] if state != codec.NORMAL else [])
        marked = self.marked(events[1:])
        for n, (e, change) in enumerate(zip(events[1:], palettes[1:])):
            self.palette = self.palette | change
            # A change of nothing is sent as the whole palette.
            self.put(codec.NORMAL, self.video.pts(e.begin), e.forced, self.palette if self.config.full_palette else change or self.palette, [], update=True)
            if marked and n == marked[0]:
                self.load({w: (self.buffer[w].bitmap, self.buffer[w].x, self.buffer[w].y) for w in self.shown}, end, 0)
                self.put(codec.ACQUISITION, marked[1], e.forced, self.palette, [*self.shown])
        self.last_span = (events[-1].begin, end)

    def load(self, parts: dict[int, tuple[np.ndarray, int, int]], until: int, up: int) -> None:
        """New objects for some windows, each in the window's other place of the buffer."""
        for i, (bitmap, x, y) in parts.items():
            self.turn[i] ^= 1
            moved = np.where(bitmap == codec.TRANSPARENT, codec.TRANSPARENT, bitmap + up).astype(np.uint8) if up else bitmap
            self.buffer[i] = Held(2 * i + self.turn[i], moved, x, y, until)

    def marked(self, updates: list[Shown]) -> tuple[int, int] | None:
        """The last one of a run's updates after which an acquisition is due and has room, and its clock."""
        found = None
        for n, e in enumerate(updates):
            _, _, self.progress = self.choice.next(self.progress, UPDATE)
            if self.choice.due(self.progress) and not e.forced and (pts := self.room(e)) is not None:
                found, self.progress = (n, pts), self.choice.acquired(self.progress)
        return found

    def room(self, e: Shown) -> int | None:
        """The clock of an acquisition within an event: the first frame at which the decoder is done with the
        event's own set and can decode again, in the event's first half and not long after that."""
        begin, end = self.video.pts(e.begin), self.video.pts(e.end)
        wipe, spent = copy(sum(self.areas.values())), self.spent(codec.ACQUISITION, [*self.shown])
        done = begin - self.spent(codec.NORMAL, [], True) + wipe
        if end - begin <= WIPES * wipe:
            return None
        for frame in range(e.begin + 1, e.begin + (e.end - e.begin - 1) // 2 + 1):
            pts = self.video.pts(frame)
            if pts >= begin + AROUND + wipe and pts - spent >= done + AROUND:
                return pts if pts - spent - done - AROUND < LONGEST_WAIT else None
        return None

    def leave(self, before: int | None) -> None:
        """What ends before a frame (at all, if there is none) goes off the screen, window by window."""
        for frame in sorted({self.buffer[w].until for w in self.shown}):
            if before is not None and frame >= before:
                return
            left = [w for w in self.shown if self.buffer[w].until > frame]
            if left:
                self.shown = left
                self.put(codec.NORMAL, self.video.pts(frame), False, None, [])
            else:
                self.clear(frame)

    def clear(self, frame: int) -> None:
        """Wipes the windows or, where that takes longer than a frame, makes the palette transparent."""
        pts = self.video.pts(frame)
        if copy(sum(self.areas.values())) + WIPE_SLACK < self.video.pts(frame + 1) - pts or not self.shown:
            self.shown = []
            self.put(codec.NORMAL, pts, False, None, [])
        else:
            unseen = {i: (*c[:3], 0) for i, c in self.palette.items()}
            self.put(codec.NORMAL, pts, False, unseen, [], update=True)
            self.shown = []


def chains(events: list[Shown], box: layout.Box, video: Video, config: JobConfig) -> list[list[Shown]]:
    """Consecutive events that touch and look like what came before, composed so far."""
    out: list[list[Shown]] = []
    below: np.ndarray | None = None
    for e in events:
        now = e.on(box)
        if below is not None and not e.refresh and out[-1][-1].end == e.begin and out[-1][-1].forced == e.forced:
            score, share = layout.picture_similarity(below, now)
            if score >= fuse_threshold(video.height, share, config.similarity_offset) and share < 1.0:
                out[-1].append(e)
                below = pixels.over(below, now)
                continue
        out.append([e])
        below = now
    return out


def encode_group(rows: pa.Table, video: Video, config: JobConfig) -> pa.Table:
    table = rows.to_pylist()
    job, grp, out, last = table[0]["job"], table[0]["grp"], [], -FREQ * 10
    for number, events in enumerate(split_epochs(pictured(table), video, config.single_object)):
        mask = np.zeros((video.height, video.width), bool)
        for e in events:
            e.mark(mask)
        windows = windows_of(mask, config.single_object)
        box = windows[0] if len(windows) == 1 else windows[0].around(windows[1])
        parts = chains(events, box, video, config)
        encoder = EpochEncoder(video, config, windows, last, slots(parts, windows))
        for n, (chain, after) in enumerate(zip(parts, [*parts[1:], None])):
            encoder.chain(chain, n == 0)
            encoder.leave(after[0].begin if after else None)
        last = encoder.last_dts
        out += [(job, grp, number, n, *r) for n, r in enumerate(encoder.rows)]
    return pa.Table.from_pylist([dict(zip(_SCHEMA.names, r)) for r in out], _SCHEMA)


def prepared(spark: SparkSession, xml: str, folder: str, images: DataFrame, video: Video, config: JobConfig) -> DataFrame:
    """Events with their group: folded where the same picture follows itself, refreshed, and cut where a
    full screen can be decoded in between."""
    nominal = video.num // 1000 if video.den == 1001 else video.num
    events = bdn.read_events(spark, xml, nominal).withColumn("job", F.lit(xml))
    prints = images.select("path", F.sha2("data", 256).alias("print"))
    named = events.withColumn("g", F.explode("graphics")).withColumn("path", bdn.place(F.col("g.path"), folder)).join(prints, "path", "left")
    look = named.groupBy("event_ord").agg(F.array_sort(F.collect_list(F.struct("g.x", "g.y", F.coalesce("print", "g.path")))).alias("look"))
    whole = events.join(look, "event_ord")
    folded = sequence.fold_runs(whole, ["job"], ["frame_in", "event_ord"], ["x", "y", "w", "h", "look"], "frame_in", "frame_out", first=["event_ord", "forced", "graphics"])
    period = round(config.refresh_seconds * video.num / video.den)
    spread = sequence.periodic_refreshes(folded, "frame_in", "frame_out", period)
    ticks = lambda c: timecode.to_ticks(F.col(c), video.num, video.den)
    timed = spread.withColumn("_s", ticks("frame_in")).withColumn("_e", ticks("frame_out"))
    tolerance = copy(video.area) + decode(video.area)
    return sequence.gap_groups(timed, ["job"], ["frame_in", "event_ord", "k"], "_s", "_e", tolerance, "grp").drop("_s", "_e", "look", "run_length")


def encode(spark: SparkSession, xml: str, folder: str, config: JobConfig | None = None) -> DataFrame:
    """Segments of the project's stream: file, seg_ord, type, pts, dts, size, payload, in order of
    seg_ord. A header that is not ok, or pictures that do not fit their events, stop the run."""
    config = config or JobConfig()
    header = bdn.read_header(spark, xml, config.any_size).first()
    if header is None or not header.ok:
        raise ValueError("the project's frame rate or size is none of the format's")
    video = Video(header.width, header.height, header.rate.num, header.rate.den, header.rate.code)
    images = bdn.read_images(spark, folder)
    nominal = video.num // 1000 if video.den == 1001 else video.num
    events = bdn.read_events(spark, xml, nominal)
    bad = bdn.rejected_images(events, images, folder).limit(1).collect()
    if bad:
        raise ValueError(f"the picture {bad[0].path} does not fit its event")
    over = bdn.overlapping_graphics(events).limit(1).collect()
    if over:
        raise ValueError(f"pictures of event {over[0].event_ord} overlap")
    rows = bdn.with_pictures(prepared(spark, xml, folder, images, video, config), images, folder)
    cols = rows.select("job", "grp", "event_ord", "k", "copy", "frame_in", "frame_out", "forced", "x", "y", "w", "h", "at_x", "at_y", "data", "width", "height", "channels")
    coded = cols.groupBy("job", "grp").applyInArrow(lambda table: encode_group(table, video, config), SEGMENTS)
    return numbered(coded)


def numbered(coded: DataFrame) -> DataFrame:
    """Puts segments of all epochs in order, with composition numbers that run through (modulo 2^16).
    Offsets come from a row for each epoch."""
    from pyspark.sql.window import Window

    per = coded.groupBy("job", "grp", "epoch").agg(F.count("*").alias("_n"), F.count_if(F.col("type") == codec.COMPOSITION).alias("_c"))
    before = Window.partitionBy("job").orderBy("grp", "epoch").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per.select("job", "grp", "epoch", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_seg"), F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_comp"))
    all_ = coded.join(offsets, ["job", "grp", "epoch"])
    own = F.conv(F.hex(F.substring("payload", 6, 2)), 16, 10).cast("bigint")
    number = F.unhex(F.lpad(F.hex((own + F.col("_comp")) % 65_536), 4, "0"))
    payload = F.when(F.col("type") == codec.COMPOSITION, F.concat(F.substring("payload", 1, 5), number, F.substring("payload", 8, 1 << 20))).otherwise(F.col("payload"))
    return all_.select(F.col("job").alias("file"), (F.col("_seg") + F.col("seg_in_epoch")).alias("seg_ord"), "type", "pts", "dts", F.length("payload").alias("size"), payload.alias("payload"))
