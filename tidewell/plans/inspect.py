"""Census and compliance rules over segments of streams (see sources.pgs).

Rules are DataFrames of findings (file, ds, rule, detail, hard), joined by unionByName. Display
sets and epochs come from windows over each file; rules that compare with what went before are
lags and running aggregates. The object buffer is a state machine in which a rejected object
takes no memory, so its rules run as one function over each epoch.
"""

from __future__ import annotations

from functools import reduce
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewell.functions import ticks
from tidewell.functions.timecode import RATES
from tidewell.operators import sequence
from tidewell.sources import codec

FILE, ORDER = ["file"], ["seg_ord"]
FINDINGS = "file string, ds bigint, rule string, detail string, hard boolean"
#: Largest step of a clock that still counts as forward, and the clock before a stream.
FORWARD, BEFORE = (1 << 31) - 1, -99_999_999
SLOTS, NO_NUMBER = 64, 0xFFFF


def is_type(kind: int) -> Column:
    return F.col("type") == kind


def window_ticks(windows: Column) -> Column:
    """Ticks to copy windows one by one, each rounded up."""
    area = lambda w: w["w"].cast("bigint") * w["h"]
    return F.coalesce(F.aggregate(windows, F.lit(0).cast("bigint"), lambda s, w: s + ticks.copy_ticks(area(w))), F.lit(0).cast("bigint"))


def with_sets(segments: DataFrame) -> DataFrame:
    """segments with ds, the number of the display set: one opens at a PCS and closes after an END."""
    return sequence.opened_sets(segments, FILE, ORDER, is_type(codec.COMPOSITION), is_type(codec.END), "ds")


def encode_sets(segments: DataFrame) -> DataFrame:
    """ds as the encoder counts them: sets close after an END only."""
    return sequence.opened_sets(segments, FILE, ORDER, F.lit(False), is_type(codec.END), "ds")


def bitrate_sets(segments: DataFrame) -> DataFrame:
    """ds as the bitrate model counts them: from PCS to PCS; what comes before the first is dropped."""
    n = F.sum(F.when(is_type(codec.COMPOSITION), 1).otherwise(0)).over(sequence.so_far(FILE, ORDER))
    return segments.withColumn("ds", n - 1).filter("ds >= 0")


def display_sets(sets: DataFrame, pcs_first: bool = False) -> DataFrame:
    """A row for each display set: its PCS and WDS (the first of each), counts of types, the place of
    the WDS, first and last type, and the number of its epoch. An epoch starts at a set whose PCS
    says so, wherever in the set it is, or under pcs_first only where it comes first."""
    place = F.row_number().over(Window.partitionBy("file", "ds").orderBy("seg_ord")) - 1
    pcs, wds = is_type(codec.COMPOSITION) & F.col("pcs").isNotNull(), is_type(codec.WINDOWS)
    first = lambda of, c: F.min_by(F.when(of, F.col(c)), F.when(of, F.col("seg_ord")))
    d = sets.withColumn("_at", place).groupBy("file", "ds").agg(
        F.count("*").alias("n_segments"), F.sum(F.col("size") + codec.HEADER.size).alias("bytes"), *[F.count_if(is_type(k)).alias(f"n_{n.lower()}") for k, n in codec.NAMES.items()],
        first(pcs, "pcs").alias("pcs"), first(pcs, "pts").alias("pts"), first(pcs, "dts").alias("dts"), first(wds, "wds").alias("wds"), first(wds, "pts").alias("wds_pts"), first(wds, "dts").alias("wds_dts"),
        F.min(F.when(wds, F.col("_at"))).alias("wds_at"), F.min_by("type", "_at").alias("first_type"), F.max_by("type", "_at").alias("last_type"),
        F.bool_and(F.when(is_type(codec.PALETTE), F.col("pts") == F.col("dts"))).alias("pds_together"), F.bool_and(F.when(is_type(codec.OBJECT), F.col("pts") != F.col("dts"))).alias("ods_apart"),
    )
    starts = F.coalesce(F.col("pcs.state").bitwiseAND(codec.EPOCH_START) != 0, F.lit(False))
    if pcs_first:
        starts = starts & (F.col("first_type") == codec.COMPOSITION)
    d = d.withColumn("starts", starts).withColumn("last_ds", F.max("ds").over(Window.partitionBy("file")))
    return sequence.epochs_of(d, FILE, ["ds"], F.col("starts"), "epoch")


def census(sets: DataFrame, pcs_first: bool = False) -> DataFrame:
    """One row for each file: epochs, display sets, segments, bytes, counts of types; display sets that
    start an epoch (es), acquire (acq) or go on (nc); those that go on with new objects (nc_ods);
    palette updates (pu) and those decoded ahead (pu_buffered)."""
    d = display_sets(sets, pcs_first)
    by = sequence.ordered(["file", "epoch"], ["ds"])
    state = F.coalesce("pcs.state", F.lit(0))
    update = F.coalesce("pcs.pal_flag", F.lit(False))
    ahead = ticks.modular_difference(F.col("pts"), F.col("dts")) > window_ticks(F.first("wds").over(by.rowsBetween(Window.unboundedPreceding, 0))) + 1
    d = d.withColumn("_state", state).withColumn("_update", update).withColumn("_ahead", ahead)
    go_on, acquires = F.col("_state") == 0, F.col("_state").bitwiseAND(codec.ACQUISITION) != 0
    return d.groupBy("file").agg(
        F.greatest(F.count_if("starts"), F.lit(1).cast("bigint")).alias("epochs"), F.count("*").alias("display_sets"), F.sum("n_segments").alias("segments"), F.sum("bytes").alias("bytes"),
        *[F.sum(f"n_{n.lower()}").alias(n.lower()) for n in codec.NAMES.values()],
        F.count_if(~go_on & ~acquires & (F.col("_state").bitwiseAND(codec.EPOCH_START) != 0)).alias("es"), F.count_if(acquires).alias("acq"), F.count_if(go_on).alias("nc"),
        F.count_if(~F.col("_update") & go_on & (F.col("n_wds") > 0) & (F.col("n_ods") > 0)).alias("nc_ods"), F.count_if("_update").alias("pu"), F.count_if(F.col("_update") & F.col("_ahead")).alias("pu_buffered"),
    )


def epoch(sets: DataFrame, number: int) -> DataFrame:
    """The segments of the display sets of one epoch (from 0 on) of each file; none beyond the last."""
    numbers = display_sets(sets).filter(F.col("epoch") == number).select("file", "ds")
    return sets.join(numbers, ["file", "ds"])


def _finding(df: DataFrame, rule: str, hard: bool, detail: Column | str, ds: str = "ds") -> DataFrame:
    text = F.lit(detail) if isinstance(detail, str) else detail
    return df.select("file", F.col(ds).cast("bigint").alias("ds"), F.lit(rule).alias("rule"), text.alias("detail"), F.lit(hard).alias("hard"))


def stream_findings(status: DataFrame) -> DataFrame:
    errors = status.withColumn("_e", F.explode("errors")).withColumn("ds", F.lit(0))
    return _finding(errors, "stream", True, F.col("_e")).unionByName(
        _finding(status.filter("missing_final_ends").withColumn("ds", F.lit(0)), "stream", True, "the last display set has no END")
    ).unionByName(_finding(status.filter("trailing_bytes > 0").withColumn("ds", F.lit(0)), "stream", True, F.concat(F.lit("bytes after the last segment: "), F.col("trailing_bytes").cast("string"))))


def epoch_anchors(d: DataFrame) -> DataFrame:
    """A row for each epoch: its first display set, the first one with a PCS, and what timing rules take
    from that: frame duration, ticks of its windows and of a whole-plane wipe."""
    has = F.col("pcs").isNotNull()
    of = lambda c: F.min_by(F.when(has, F.col(c)), F.when(has, F.col("ds")))
    rates = F.create_map(*[F.lit(x) for code, (n, m) in RATES.items() for x in (code, ticks.FREQ * m // n)])
    e = d.groupBy("file", "epoch").agg(F.min("ds").alias("first_ds"), F.min(F.when(has, F.col("ds"))).alias("anchor"), of("pcs").alias("pcs"), of("wds").alias("wds"), of("pts").alias("pts"), of("dts").alias("dts"), F.max(F.when(has, F.struct("ds", "pts"))).alias("_end"))
    before = F.last("_end.pts", ignorenulls=True).over(Window.partitionBy("file").orderBy("epoch").rowsBetween(Window.unboundedPreceding, -1))
    return e.select(
        "file", "epoch", "first_ds", "anchor", "pcs", "wds", "pts", "dts", F.coalesce(before, F.lit(BEFORE).cast("bigint")).alias("pts_before"), F.coalesce(F.try_element_at(rates, F.col("pcs.fps")), F.lit(ticks.FREQ // 24)).alias("frame"),
        window_ticks(F.col("wds")).alias("window_ticks"), F.coalesce(ticks.copy_ticks(F.col("pcs.width").cast("bigint") * F.col("pcs.height")), F.lit(0).cast("bigint")).alias("wipe"),
    )


def epoch_findings(e: DataFrame) -> list[DataFrame]:
    known, opening = e.filter("pcs is not null"), e.filter("anchor = first_ds")
    wide = known.withColumn("w", F.explode("wds")).filter((F.col("w.x") + F.col("w.w") > F.col("pcs.width")) | (F.col("w.y") + F.col("w.h") > F.col("pcs.height")))
    a, b = F.get("wds", F.lit(0)), F.get("wds", F.lit(1))
    from tidewell.functions.geometry import overlaps

    step = ticks.modular_difference(F.col("dts"), F.col("pts_before"))
    return [
        _finding(opening.filter(F.col("pcs.state").bitwiseAND(codec.EPOCH_START) == 0), "epoch/start", True, "the epoch does not begin with an epoch start", "first_ds"),
        _finding(wide, "epoch/window", True, F.concat(F.lit("window out of screen: "), F.col("w.window_id").cast("string")), "anchor"),
        _finding(known.filter((F.size("wds") == 2) & overlaps(a, b)), "epoch/window", True, "the windows overlap", "anchor"),
        _finding(opening.filter((step <= 0) | (step >= FORWARD)), "pts_dts/epoch_start", True, "the epoch's DTS does not follow the epoch before", "first_ds"),
        _finding(opening.filter(ticks.modular_difference(F.col("pts"), F.col("dts")) <= F.col("wipe")), "pts_dts/epoch_start", True, "no time to wipe the plane before the epoch's PTS", "first_ds"),
    ]


def set_findings(d: DataFrame) -> list[DataFrame]:
    p, state, by_file = d.filter("pcs is not null"), F.col("pcs.state"), Window.partitionBy("file").orderBy("ds")
    changes = state != 0
    number, before = F.col("pcs.number"), F.lag("pcs.number").over(by_file)
    counted = p.withColumn("_before", before)
    trailing = (F.col("n_end") == 0) & (F.col("ds") == F.col("last_ds"))
    in_epoch = Window.partitionBy("file", "epoch").orderBy("ds")
    d2 = d.withColumn("_k", F.row_number().over(in_epoch) - 1).withColumn("_pts", F.lag("pts").over(in_epoch)).filter("pcs is not null")
    t = "test_diplayset/"
    return [
        _finding(d.filter("pcs is null"), t + "pcs", True, "the display set has no PCS"),
        _finding(p.filter(F.col("first_type") != codec.COMPOSITION), t + "order", True, "the PCS is not the first segment"),
        _finding(p.filter((F.col("pcs.n_objects") > 2) | (F.col("pcs.n_objects") != F.size("pcs.objects"))), t + "objects", True, F.concat(F.lit("objects told: "), F.col("pcs.n_objects").cast("string"))),
        _finding(p.filter(changes & F.col("pcs.pal_flag")), t + "pal_flag", True, "a palette update in a display set that is not normal"),
        _finding(p.filter(changes & F.col("wds_at").isNull()), t + "wds", True, "a display set that is not normal has no WDS"),
        _finding(p.filter("pcs.pal_id >= 8"), t + "pal_id", True, "palette id of 8 or more"),
        _finding(p.filter("wds_at != 1"), t + "order", True, "the WDS is not the second segment"),
        _finding(p.filter(F.col("wds_at").isNotNull() & F.col("pcs.pal_flag")), t + "pal_flag", True, "windows on a palette update"),
        _finding(p.filter(F.col("wds_at").isNotNull() & ~F.size("wds").between(1, 2)), t + "wds", True, F.concat(F.lit("windows: "), F.size("wds").cast("string"))),
        _finding(p.filter(~trailing & ((F.col("n_end") == 0) | (F.col("last_type") != codec.END))), t + "end", True, "END is missing or not the last segment"),
        _finding(counted.filter((F.col("_before") != NO_NUMBER) & (number != (F.col("_before") + 1).bitwiseAND(0xFFFF)) & (number != F.col("_before")) & (state != codec.EPOCH_START)), t + "comp_n", False, "the composition number does not go up by one"),
        _finding(d2.filter((F.col("_k") > 0) & (state.bitwiseAND(codec.EPOCH_START) != 0)), "epoch/start", True, "an epoch starts inside an epoch"),
        _finding(d2.filter((F.col("_k") > 0) & (F.col("_pts") == F.col("pts"))), t + "pts", False, "two display sets have the same PTS"),
    ]


def window_findings(segs: DataFrame) -> DataFrame:
    """Windows whose shape differs from the epoch's first WDS. segs: segments of sets with a PCS."""
    wds = segs.filter(is_type(codec.WINDOWS)).withColumn("_n", F.row_number().over(Window.partitionBy("file", "epoch").orderBy("seg_ord")))
    each = wds.select("file", "epoch", "ds", "_n", F.posexplode("wds").alias("_i", "w"))
    first = each.filter("_n = 1").groupBy("file", "epoch", F.col("w.window_id").alias("_id")).agg(F.max_by("w", "_i").alias("_first"))
    later = each.filter("_n > 1").withColumn("_id", F.col("w.window_id"))
    changed = later.join(first, ["file", "epoch", "_id"]).filter(F.col("w") != F.col("_first"))
    return _finding(changed, "epoch/window", True, F.concat(F.lit("window changed: "), F.col("_id").cast("string")))


def palette_findings(segs: DataFrame) -> list[DataFrame]:
    """Rules on palettes. What a palette holds is the latest version of each entry since the last set
    that is not normal; the number of bad entries is a running sum of their changes."""
    restarts = F.when((F.col("seg_ord") == F.col("_head")) & (F.col("pcs_state") != 0), 1).otherwise(0)
    s = segs.withColumn("_head", F.min("seg_ord").over(Window.partitionBy("file", "ds"))).withColumn("_life", F.sum(restarts).over(sequence.so_far(["file", "epoch"], ORDER)))
    pds = s.filter(is_type(codec.PALETTE) & F.col("pds").isNotNull()).select("file", "epoch", "ds", "seg_ord", "_life", F.col("pds.id").alias("p"), F.col("pds.version").alias("v"), F.col("pds.entries").alias("entries"))
    by = ["file", "epoch", "_life", "p"]
    e = pds.select(*by, "ds", "seg_ord", F.explode("entries").alias("i", "c"))
    c = F.col("c")
    out_of_range = ~(c["y"].between(16, 235) & c["cb"].between(16, 240) & c["cr"].between(16, 240))
    reserved = (F.col("i") == codec.TRANSPARENT) & (c["a"] != 0)
    w = sequence.ordered([*by, "i"], ORDER)
    for name, bad in (("_range", out_of_range), ("_reserved", reserved)):
        now = bad.cast("int")
        e = e.withColumn(name, now - F.coalesce(F.lag(now).over(w), F.lit(0)))
    change = e.groupBy(*by, "seg_ord").agg(F.sum("_range").alias("_range"), F.sum("_reserved").alias("_reserved"))
    held = pds.join(change, [*by, "seg_ord"], "left")
    for name in ("_range", "_reserved"):
        held = held.withColumn(name, F.sum(F.coalesce(name, F.lit(0))).over(sequence.so_far(by, ORDER)))
    repeat = pds.withColumn("_n", F.row_number().over(Window.partitionBy("file", "ds", "p").orderBy("seg_ord"))).filter("_n > 1")
    before = F.lag("v").over(sequence.ordered(["file", "epoch", "p"], ORDER))
    name = lambda text: F.concat(F.lit(text), F.col("p").cast("string"))
    return [
        _finding(repeat, "test_diplayset/pds", True, name("palette given twice: ")),
        # An index is one byte, so that no palette can hold more than 256 entries.
        _finding(pds.filter(F.size("entries") > 256), "test_diplayset/pds", True, name("more than 256 entries: ")),
        _finding(held.filter("_range > 0"), "palette/range", True, name("out of limited range: ")),
        _finding(held.filter("_reserved > 0"), "palette/reserved", True, name("entry 255 is not transparent: ")),
        _finding(pds.withColumn("_b", before).filter(F.col("v") != (F.col("_b") + 1).bitwiseAND(0xFF)), "palette/version", False, name("version does not go up by one: ")),
    ]


def epoch_objects(rows: pa.Table) -> pa.Table:
    """Rules on objects over one epoch, in stream order. rows: seg_ord, ds, type, size, ods, wds, pcs,
    pds of the sets that have a PCS."""
    segments = sorted(rows.to_pylist(), key=lambda r: r["seg_ord"])
    file = segments[0]["file"]
    found: list[tuple] = []
    slots: dict[int, tuple[int, int]] = {}
    taken, versions, contents = 0, {}, {}
    filled: set[int] = set()
    palettes: dict[int, set[int]] = {}
    chain, coded, head = bytearray(), 0, None

    def add(ds, rule, hard, detail):
        found.append((file, ds, rule, detail, hard))

    for ds, part in groupby(segments, lambda r: r["ds"]):
        own = [*part]
        pcs = next(r["pcs"] for r in own if r["type"] == codec.COMPOSITION and r["pcs"] is not None)
        if pcs["state"] != 0:
            filled.clear()
            palettes.clear()
        for r in own:
            if r["type"] == codec.PALETTE and r["pds"] is not None:
                entries = r["pds"]["entries"]
                palettes.setdefault(r["pds"]["id"], set()).update(entries if isinstance(entries, dict) else (k for k, _ in entries))
            if r["type"] != codec.OBJECT or r["ods"] is None:
                continue
            o = r["ods"]
            ident, w, h = o["o_id"], o["w"] or 0, o["h"] or 0
            if o["seq"] & codec.FIRST:
                chain, head = bytearray(), (ident, o["version"], w, h)
                if not (8 <= w <= 4096 and 8 <= h <= 4096):
                    add(ds, "object/dimensions", True, f"size {w} x {h}")
                    continue
                if ident not in slots:
                    if len(slots) >= SLOTS or taken + w * h > ticks.DECODED_BUFFER:
                        add(ds, "object/buffer", True, f"no memory for object {ident}")
                    else:
                        slots[ident] = (w, h)
                        taken += w * h
                elif slots[ident] != (w, h):
                    add(ds, "object/slot", True, f"object {ident} has another size")
                if coded:
                    add(ds, "object/chain", True, "the chain before has no end")
            elif head is None or head[:2] != (ident, o["version"]):
                add(ds, "object/chain", True, "a fragment of another object")
            coded += codec.HEADER.size + int(r["size"])
            chain += bytes(o["data"] or b"")
            if not o["seq"] & codec.LAST:
                continue
            if coded >= ticks.CODED_BUFFER - 144:
                add(ds, "object/coded_size", True, f"{coded} bytes")
            coded = 0
            same_version = versions.get(ident) == o["version"]
            if ident in filled and ident in contents and contents[ident] != bytes(chain) and same_version:
                add(ds, "object/version", False, f"object {ident} changed under the same version")
            filled.add(ident)
            versions[ident], contents[ident] = o["version"], bytes(chain)
            bitmap, ok = codec.decode_rle(bytes(chain), *(head[2:] if head else (0, 0)))
            if not ok:
                add(ds, "object/rle", False, f"lines of object {ident} are not whole")
            elif {*np.flatnonzero(np.bincount(bitmap.ravel())).tolist()} - palettes.get(pcs["pal_id"], set()) - {codec.TRANSPARENT}:
                add(ds, "object/palette", False, f"object {ident} uses an entry that is not set")
        windows = next((r["wds"] for r in own if r["type"] == codec.WINDOWS), None)
        if windows is None:
            continue
        for o in pcs["objects"]:
            ident = o["o_id"]
            if ident not in slots:
                add(ds, "object/slot", True, f"object {ident} is in no slot")
                continue
            if ident not in filled:
                add(ds, "object/expired", True, f"object {ident} is from before the last acquisition")
                continue
            w, h = slots[ident]
            crop = o["crop"]
            if crop is not None:
                if crop["x"] + crop["w"] > w or crop["y"] + crop["h"] > h:
                    add(ds, "object/crop", True, f"the crop leaves object {ident}")
                    continue
                w, h = crop["w"], crop["h"]
                if not w or not h:
                    add(ds, "object/crop", False, "an empty crop")
            home = [x for x in windows if x["window_id"] == o["window_id"]]
            if home and not (home[-1]["x"] <= o["x"] and home[-1]["y"] <= o["y"] and o["x"] + w <= home[-1]["x"] + home[-1]["w"] and o["y"] + h <= home[-1]["y"] + home[-1]["h"]):
                add(ds, "object/window", True, f"object {ident} leaves window {o['window_id']}")
    names = ["file", "ds", "rule", "detail", "hard"]
    return pa.Table.from_pylist([dict(zip(names, x)) for x in found], pa.schema(zip(names, (pa.string(), pa.int64(), pa.string(), pa.string(), pa.bool_()))))


def object_findings(segs: DataFrame) -> DataFrame:
    cols = segs.select("file", "epoch", "ds", "seg_ord", "type", "size", "pcs", "wds", "pds", "ods")
    return cols.groupBy("file", "epoch").applyInArrow(epoch_objects, FINDINGS)


def timing_findings(segs: DataFrame, d: DataFrame, e: DataFrame) -> DataFrame:
    """The clocks of a display set: one finding for each set that breaks any of the rules. The DTS
    before is that of the last segment of the set before; the PTS before is that set's."""
    md = ticks.modular_difference
    by_file = Window.partitionBy("file").orderBy("seg_ord")
    before = F.coalesce(F.lag("dts").over(by_file), F.lit(BEFORE).cast("bigint"))
    each = segs.withColumn("_before", before)
    ok = (md(F.col("ds_pts"), F.col("pts")) <= FORWARD) & (md(F.col("dts"), F.col("ds_dts")) <= FORWARD) & (md(F.col("pts"), F.col("ds_dts")) <= FORWARD) & (md(F.col("pts"), F.col("dts")) < ticks.FREQ) & (md(F.col("dts"), F.col("_before")) < FORWARD)
    by_set = each.groupBy("file", "ds").agg(F.bool_and(ok).alias("_each"), F.min_by("_before", "seg_ord").alias("_dts_before"))
    p = d.filter("pcs is not null").withColumn("_pts_before", F.coalesce(F.lag("pts").over(Window.partitionBy("file").orderBy("ds")), F.lit(BEFORE).cast("bigint")))
    p = p.join(by_set, ["file", "ds"]).join(e.select("file", "epoch", "frame", "window_ticks", "wipe"), ["file", "epoch"])
    step = md(F.col("pts"), F.col("_pts_before"))
    with_windows = (step > F.col("window_ticks")) & (step < FORWARD) & (md(F.col("pts"), F.col("wds_pts")) <= F.col("window_ticks")) & (md(F.col("wds_pts"), F.col("wds_dts")) <= F.col("wipe") * 2) & (F.col("wds_pts") != F.col("wds_dts"))
    good = F.col("_each") & (md(F.col("dts"), F.col("_dts_before")) <= FORWARD) & (step <= FORWARD) & F.when(F.col("wds_at").isNotNull(), with_windows).otherwise(step >= F.col("frame")) & F.coalesce("pds_together", F.lit(True)) & F.coalesce("ods_apart", F.lit(True))
    return _finding(p.filter(~good), "pts_dts/sanity", True, F.concat(F.lit("clocks out of order, state "), F.col("pcs.state").cast("string")))


def buffer_levels(segments: DataFrame, bytes_per_second: int) -> DataFrame:
    """Segments from the first PCS on with the level of the receive buffer after each: full one second
    before the first DTS, filled at the rate (halves to even), emptied by each segment."""
    s = bitrate_sets(segments)
    w = sequence.ordered(FILE, ORDER)
    passed = F.coalesce(ticks.modular_difference(F.col("dts"), F.lag("dts").over(w)), F.lit(ticks.FREQ).cast("bigint"))
    s = s.withColumn("refill", ticks.half_even(passed * F.lit(float(bytes_per_second)) / ticks.FREQ).cast("bigint")).withColumn("cost", (F.col("size") + codec.HEADER.size - 2).cast("bigint"))
    return sequence.leaky_bucket(s, FILE, ORDER, "refill", "cost", ticks.BUCKET, "level")


def bitrate_stats(segments: DataFrame, bytes_per_second: int) -> DataFrame:
    """One row for each file: smallest and mean share of the buffer, bytes of the busiest second (and
    when it ended), mean rate in Mbit/s (2^17 bytes), and whether the buffer never ran empty."""
    levels = buffer_levels(segments, bytes_per_second)
    share = F.col("level") / float(ticks.BUCKET)
    use = levels.groupBy("file").agg(F.min(share).alias("min_usage"), F.avg(share).alias("avg_usage"), F.bool_and(F.col("level") >= 0).alias("ok"))
    sets = levels.groupBy("file", "ds").agg(F.sum(F.col("size") + codec.HEADER.size).alias("bytes"), F.min_by("pts", "seg_ord").alias("pts"))
    w = Window.partitionBy("file").orderBy("ds")
    sets = sets.withColumn("pts", ticks.unwrap(F.col("pts"), w))
    sets = sequence.rolling_sum(sets, FILE, "pts", "bytes", ticks.FREQ, "second")
    rates = sets.groupBy("file").agg(F.max(F.struct("second", "pts")).alias("_peak"), F.sum("bytes").alias("_bytes"), (F.max_by("pts", "ds") - F.min_by("pts", "ds")).alias("_span"))
    mean = F.when(F.col("_span") > 0, F.col("_bytes") / 131072.0 / (F.col("_span") / float(ticks.FREQ))).otherwise(0.0)
    return use.join(rates, "file").select("file", "min_usage", "avg_usage", F.col("_peak.second").alias("peak_bytes"), F.col("_peak.pts").alias("peak_pts"), mean.alias("avg_mbps"), "ok")


def findings(segments: DataFrame, status: DataFrame, max_kbps: int = 0) -> DataFrame:
    """All findings of the streams; max_kbps > 0 adds the buffer rule at that rate."""
    sets = with_sets(segments)
    d = display_sets(sets)
    e = epoch_anchors(d)
    of = d.filter("pcs is not null").select("file", "ds", "epoch", F.col("pcs.state").alias("pcs_state"), F.col("pts").alias("ds_pts"), F.col("dts").alias("ds_dts"))
    segs = sets.join(of, ["file", "ds"])
    parts = [stream_findings(status), *epoch_findings(e), *set_findings(d), window_findings(segs), *palette_findings(segs), object_findings(segs), timing_findings(segs, d, e)]
    if max_kbps > 0:
        empty = bitrate_stats(segments, max_kbps * 1000 // 8).filter("not ok").withColumn("ds", F.lit(0))
        parts.append(_finding(empty, "rx_bitrate", True, f"the buffer runs empty at {max_kbps} kbit/s"))
    return reduce(DataFrame.unionByName, parts)


def compliance(found: DataFrame, status: DataFrame) -> DataFrame:
    """(file, compliant): no hard finding."""
    bad = found.filter("hard").select("file").distinct().withColumn("_bad", F.lit(True))
    return status.select("file").join(bad, "file", "left").select("file", F.col("_bad").isNull().alias("compliant"))
