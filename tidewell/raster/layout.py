"""Where to put one or two windows around what is shown."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np

from tidewell.raster.pixels import bounds, masked_similarity

#: Least window side, cut margin, ticks that a split has to save, rates in bytes/s.
LEAST, MARGIN, SAVES = 8, 8, 10
FREQ, DECODE_RATE, COMPOSE_RATE = 90_000, 16_000_000, 32_000_000
#: Fixed values of the recursive split: depth, weight of regions that are the same, least side.
DEEPEST, SAME_WEIGHT, REGION = 4, 0.325, 8


@dataclass(frozen=True)
class Box:
    x: int
    y: int
    w: int
    h: int

    @property
    def area(self) -> int:
        return self.w * self.h

    @property
    def right(self) -> int:
        return self.x + self.w

    @property
    def bottom(self) -> int:
        return self.y + self.h

    def around(self, o: Box) -> Box:
        x, y = min(self.x, o.x), min(self.y, o.y)
        return Box(x, y, max(self.right, o.right) - x, max(self.bottom, o.bottom) - y)


def ticks(area: int, rate: int) -> int:
    return -(-area * FREQ // rate)


def decode_base(areas: list[int], screen: int) -> int:
    """Ticks to decode objects one after the other and copy each, after the plane was copied."""
    spent, decoded = ticks(screen, COMPOSE_RATE), 0
    for a in areas:
        decoded += ticks(a, DECODE_RATE)
        spent = max(decoded, spent) + ticks(a, COMPOSE_RATE)
    return spent


def grown(b: Box) -> Box:
    """A box of at least LEAST a side: to the left or up if there is room, else the other way."""
    dx, dy = max(0, LEAST - b.w), max(0, LEAST - b.h)
    x, w = (b.x - dx, b.w + dx) if b.x > dx else (b.x, b.w + dx)
    y, h = (b.y - dy, b.h + dy) if b.y > dy else (b.y, b.h + dy)
    return Box(x, y, w, h)


def _spread(at: int, size: int, limit: int) -> tuple[int, int]:
    """Start and length of a side grown to LEAST within limit, about evenly but towards the middle of
    the screen; whole missing pixels go to the far side first."""
    lack = max(0, LEAST - size)
    if not lack:
        return at, size
    pull = lack * (2.0 * at + size - limit) / limit
    low, high = math.floor(-lack / 2 + pull), math.ceil(-lack / 2 + pull + lack - 1)
    begin, end = at, at + size
    if low < high:
        begin, end = max(0, int(at + low)), min(limit, int(end + high))
    missing = lack - (at - begin + end - at - size)
    if missing > 0:
        if end + missing <= limit:
            end += missing
        else:
            begin -= missing
    return begin, end - begin


def padded(b: Box, width: int, height: int) -> Box:
    if b.w >= LEAST and b.h >= LEAST:
        return b
    (x, w), (y, h) = _spread(b.x, b.w, width), _spread(b.y, b.h, height)
    return Box(x, y, w, h)


def _stacked(top: Box, low: Box, region: Box) -> tuple[Box, Box] | None:
    """Two windows one above the other, thin ones grown to the edge of the region and then towards
    each other; None if they meet."""

    def side(b: Box) -> tuple[int, int]:
        lack = max(0, LEAST - b.w)
        left = max(0, min(lack, b.right - region.right + lack))
        return b.x - left, b.w + lack

    out, taken = [], 0
    for b, upper in ((top, True), (low, False)):
        lack = max(0, LEAST - b.h)
        room = (b.y - region.y if upper else region.bottom - b.bottom) if lack else 0
        inward = max(0, lack - room) if lack else 0
        taken += inward
        x, w = side(b)
        out.append(Box(x, b.y - (room if upper else inward), w, b.h + room + inward))
    return None if abs(top.bottom - low.y) - taken < 0 else (out[0], out[1])


def _best_cut(low: np.ndarray, high: np.ndarray, used: np.ndarray, begin: int, end: int) -> tuple[int, int] | None:
    """The cut of an axis with the least area on both sides together, and that area. low and high are
    the extents across the axis at each place, used where there is any; all cuts are scored at
    once from running extents."""
    cuts = np.arange(begin + MARGIN, end - MARGIN)
    places = np.flatnonzero(used)
    if not len(cuts) or not len(places):
        return None
    first_low, first_high = np.minimum.accumulate(low), np.maximum.accumulate(high)
    last_low, last_high = np.minimum.accumulate(low[::-1])[::-1], np.maximum.accumulate(high[::-1])[::-1]
    ends = np.searchsorted(places, cuts)
    inside = (ends > 0) & (ends < len(places))
    cuts, ends = cuts[inside], ends[inside]
    if not len(cuts):
        return None
    area = (places[ends - 1] - places[0] + 1) * (first_high[cuts - 1] - first_low[cuts - 1] + 1) + (places[-1] - places[ends] + 1) * (last_high[cuts] - last_low[cuts] + 1)
    at = int(area.argmin())
    return int(cuts[at]), int(area[at])


def _extents(mask: np.ndarray, axis: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n, used = mask.shape[axis], mask.any(axis)
    low = np.where(used, mask.argmax(axis), n)
    high = np.where(used, n - 1 - np.flip(mask, axis).argmax(axis), -1)
    return low, high, used


def windows_for(mask: np.ndarray) -> tuple[Box, Box, Box, bool]:
    """(container, first window, second window, stacked) for a mask of the screen. Both windows are the
    container where a split does not pay."""
    height, width = mask.shape
    whole = Box(0, 0, width, height)
    found = bounds(mask)
    if found is None:
        return whole, whole, whole, False
    tight = Box(*found)
    container = grown(tight)
    x0, y0 = tight.x - min(7, tight.x), tight.y - min(7, tight.y)
    region = Box(x0, y0, tight.right + min(7, width - tight.right) - x0, tight.bottom + min(7, height - tight.bottom) - y0)
    best, pair, stacked = container.area, None, False
    for axis, begin, end in ((0, region.x, region.right), (1, region.y, region.bottom)):
        cut = _best_cut(*_extents(mask, axis), begin, end)
        if cut is None or cut[1] >= best:
            continue
        best, stacked = cut[1], axis == 1
        parts = (mask[:, : cut[0]], mask[:, cut[0] :]) if axis == 0 else (mask[: cut[0]], mask[cut[0] :])
        a, b = (Box(*bounds(p)) for p in parts)
        pair = (a, Box(b.x + cut[0], b.y, b.w, b.h) if axis == 0 else Box(b.x, b.y + cut[0], b.w, b.h))
    if pair is None:
        return container, container, container, False
    if stacked:
        kept = _stacked(*pair, region)
        pair, stacked = (kept, True) if kept else ((pair[0].around(pair[1]),) * 2, False)
    else:
        pair = tuple(padded(b, width, height) for b in pair)
    forward, back = (decode_base([b.area for b in p], whole.area) for p in (pair, pair[::-1]))
    if back < forward:
        pair = pair[::-1]
    if min(forward, back) >= max(1, decode_base([container.area], whole.area) - SAVES):
        return container, container, container, False
    return container, pair[0], pair[1], stacked


def region_costs(a: np.ndarray, b: np.ndarray, depth: int = 0) -> list[tuple[float, float, int]]:
    """(score, share, area) of the regions that two pictures split into while that saves enough area."""
    h, w = a.shape[:2]
    if depth < DEEPEST:
        _, p, q, _ = windows_for((a[..., 3] > 0) | (b[..., 3] > 0))
        if p != q and min(p.w, p.h, q.w, q.h) >= REGION and p.area + q.area < w * h * (0.9 - depth / 13.0):
            return [c for x in (p, q) for c in region_costs(a[x.y : x.bottom, x.x : x.right], b[x.y : x.bottom, x.x : x.right], depth + 1)]
    score, share = masked_similarity(a, b)
    return [(score, share, int(w * h * SAME_WEIGHT) if score == share == 1.0 else w * h)]


def picture_similarity(a: np.ndarray, b: np.ndarray) -> tuple[float, float]:
    """Score and share of two pictures: those of their regions, weighted by area."""
    costs = np.array(region_costs(a, b))
    total = costs[:, 2].sum()
    return (1.0, 1.0) if not total else (float(costs[:, 0] @ costs[:, 2] / total), float(costs[:, 1] @ costs[:, 2] / total))
