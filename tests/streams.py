"""Builds graphic-subtitle streams for tests."""

from __future__ import annotations

import numpy as np

from tidewell.sources import codec

WINDOW = {"window_id": 0, "x": 100, "y": 900, "w": 400, "h": 100}
COLOURS = {1: (120, 128, 128, 255), 2: (200, 120, 130, 255)}


def composition(number, state, objects=(), **more):
    return codec.encode_composition({"width": 1920, "height": 1080, "fps": 0x20, "number": number, "state": state, "pal_flag": False, "pal_id": 0, "objects": list(objects)} | more)


def shown(o_id=0, x=100, y=900, window=0, crop=None):
    return {"o_id": o_id, "window_id": window, "forced": False, "x": x, "y": y, "crop": crop}


def epoch(pts=900_000, number=0, o_id=0, size=(16, 12), windows=(WINDOW,), colours=COLOURS, bitmap=None, objects=None):
    """An epoch of two display sets, one that shows an object and one that clears it, as parts that
    tests change: [(type, pts, dts, payload)]."""
    w, h = size
    pixels = np.ones((h, w), np.uint8) if bitmap is None else bitmap
    area = sum(x["w"] * x["h"] for x in windows)
    ticks = -(-area * 90_000 // 32_000_000)
    start = pts - 9_000
    show = [(codec.COMPOSITION, pts, start, composition(number, codec.EPOCH_START, objects or [shown(o_id)])), (codec.WINDOWS, pts - ticks, start, codec.encode_windows(list(windows))), (codec.PALETTE, start, start, codec.encode_palette(0, 0, colours))]
    show += [(codec.OBJECT, start + 50 + i, start, f) for i, f in enumerate(codec.object_fragments(o_id, 0, w, h, codec.encode_rle(pixels)))]
    show.append((codec.END, start + 60, start + 60, b""))
    end = pts + 180_000
    clear = [(codec.COMPOSITION, end, end - ticks - 1, composition(number + 1, codec.NORMAL)), (codec.WINDOWS, end - ticks, end - ticks - 1, codec.encode_windows(list(windows))), (codec.END, end - ticks, end - ticks, b"")]
    return show + clear


def joined(parts):
    return b"".join(codec.segment(kind, pts, dts, payload) for kind, pts, dts, payload in parts)
