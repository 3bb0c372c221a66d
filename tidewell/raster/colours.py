"""Reducing pictures to palettes, and sequences of pictures to one bitmap with changing palettes."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from tidewell.raster.pixels import TRANSPARENT

Quantised = tuple[np.ndarray, np.ndarray]  # indices (h, w), palette (n, 4)
#: Fixed values of the error diffusion: neighbours (row, column) that get an eighth each, the largest
#: error of a channel that is carried on and the energy below which none is.
SPREAD, SHARE, MOST_ERROR, LEAST_ENERGY = ((0, 1), (0, 2), (1, -1), (1, 0), (1, 1)), 8.0, 16.0, 2.0
ALPHA_WEIGHT = 3


def nearest(colours: np.ndarray, palette: np.ndarray) -> np.ndarray:
    """The closest entry of each colour; alpha counts three times; the first of equals."""
    weight = np.array([1, 1, 1, ALPHA_WEIGHT])
    out = np.empty(len(colours), np.int64)
    for a in range(0, len(colours), 4096):
        d = colours[a : a + 4096, None].astype(np.int64) - palette[None].astype(np.int64)
        out[a : a + 4096] = (d * d * weight).sum(-1).argmin(1)
    return out


def counted(rgba: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct colours, the place of each pixel among them, counts. Fully transparent ones are one."""
    flat = rgba.reshape(-1, 4).copy()
    flat[flat[:, 3] == 0] = 0
    packed, place, count = np.unique(flat.view(np.uint32).ravel(), return_inverse=True, return_counts=True)
    return packed.view(np.uint8).reshape(-1, 4), place, count


def _mapped(rgba: np.ndarray, entry: np.ndarray, palette: np.ndarray, place: np.ndarray) -> Quantised:
    return entry[place].reshape(rgba.shape[:2]).astype(np.uint8), palette.astype(np.uint8)


def by_means(rgba: np.ndarray, most: int) -> Quantised:
    """Bisects clusters across the direction in which their colours spread most: the cluster with the
    largest sum of squared distances first, at its mean. Then every colour goes to the nearest mean, and means
    are taken once more. Distances weigh alpha as nearest() does."""
    colours, place, count = counted(rgba)
    scaled = colours * np.sqrt([1.0, 1.0, 1.0, ALPHA_WEIGHT])
    cluster = np.zeros(len(colours), np.int64)
    spread = [np.inf]
    while len(spread) < most and max(spread) > 0:
        k = int(np.argmax(spread))
        own = np.flatnonzero(cluster == k)
        off = scaled[own] - np.average(scaled[own], axis=0, weights=count[own])
        scatter = (off * count[own, None]).T @ off
        side = off @ np.linalg.eigh(scatter)[1][:, -1] > 0
        if side.all() or not side.any():
            spread[k] = 0.0
            continue
        cluster[own[side]] = len(spread)
        spread.append(0.0)
        for new in (k, len(spread) - 1):
            own = np.flatnonzero(cluster == new)
            off = scaled[own] - np.average(scaled[own], axis=0, weights=count[own])
            spread[new] = float((off * off * count[own, None]).sum()) if len(own) > 1 else 0.0

    def means() -> np.ndarray:
        weight = np.bincount(cluster, count, len(spread))
        sums = np.stack([np.bincount(cluster, count * colours[:, c], len(spread)) for c in range(4)], 1)
        return np.rint(sums[weight > 0] / weight[weight > 0, None])

    cluster = nearest(colours, means())
    palette = means()
    palette[palette[:, 3] == 0] = 0
    return _mapped(rgba, nearest(colours, palette), palette, place)


def by_moments(rgba: np.ndarray, most: int) -> Quantised:
    """Cuts boxes of a 32-step colour cube where it lowers the variance most, from running sums of
    counts and moments; alpha is not cut by but has its mean in each box."""
    flat = rgba.reshape(-1, 4).astype(np.int64)
    flat[flat[:, 3] == 0] = 0
    cell = (flat[:, 0] >> 3) << 10 | (flat[:, 1] >> 3) << 5 | flat[:, 2] >> 3
    sums = [np.bincount(cell, w, 1 << 15) for w in (None, *flat.T, (flat[:, :3] ** 2).sum(1))]
    volume = np.stack([np.pad(s.astype(float).reshape(32, 32, 32).cumsum(0).cumsum(1).cumsum(2), ((1, 0),) * 3) for s in sums], -1)

    def total(b):
        (r0, r1), (g0, g1), (b0, b1) = b
        v = volume
        return v[r1, g1, b1] - v[r0, g1, b1] - v[r1, g0, b1] - v[r1, g1, b0] + v[r0, g0, b1] + v[r0, g1, b0] + v[r1, g0, b0] - v[r0, g0, b0]

    def variance(b):
        t = total(b)
        return t[5] - (t[1:4] ** 2).sum() / t[0] if t[0] and (np.diff(b) > 1).any() else 0.0

    def cut(b):
        whole, best = total(b), (-1.0, None)
        for axis, (lo, hi) in enumerate(b):
            for at in range(lo + 1, hi):
                part = [*b]
                part[axis] = (lo, at)
                t = total(part)
                u = whole - t
                if t[0] and u[0]:
                    gain = (t[1:4] ** 2).sum() / t[0] + (u[1:4] ** 2).sum() / u[0]
                    if gain > best[0]:
                        best = (gain, (axis, at))
        return best[1]

    boxes, spread = [[(0, 32)] * 3], []
    spread = [variance(boxes[0])]
    while len(boxes) < most and max(spread) > 0:
        k = int(np.argmax(spread))
        where = cut(boxes[k])
        if where is None:
            spread[k] = 0.0
            continue
        axis, at = where
        low, high = [*boxes[k]], [*boxes[k]]
        low[axis], high[axis] = (boxes[k][axis][0], at), (at, boxes[k][axis][1])
        boxes[k], spread[k] = low, variance(low)
        boxes.append(high)
        spread.append(variance(high))
    palette = np.array([np.rint(t[1:5] / max(t[0], 1)) for t in map(total, boxes)])
    colours, place, _ = counted(rgba)
    return _mapped(rgba, nearest(colours, palette), palette, place)


def by_tree(rgba: np.ndarray, most: int) -> Quantised:
    """Shortens colours bit by bit: while there are too many, the rarest of those that share all but
    their last kept bits are joined, so that frequent colours keep the most bits."""
    colours, place, count = counted(rgba)
    keys = colours.astype(np.int64)
    entry = np.arange(len(colours))
    for bits in range(7, -1, -1):
        live = np.unique(entry)
        if len(live) <= most:
            break
        short = (keys >> (8 - bits)) << (8 - bits) if bits else keys * 0
        packed = (short << np.array([24, 16, 8, 0])).sum(1)
        group, of = np.unique(packed, return_inverse=True)
        weight = np.bincount(of, count)
        inside = np.array([len(np.unique(entry[of == g])) for g in range(len(group))])
        for g in np.lexsort((group, weight)):
            if len(live) <= most:
                break
            if inside[g] > 1:
                own = of == g
                live = np.setdiff1d(live, np.unique(entry[own])[1:], assume_unique=True)
                entry[own] = entry[own].min()
    ids, to = np.unique(entry, return_inverse=True)
    total = np.bincount(to, count)
    palette = np.stack([np.rint(np.bincount(to, count * colours[:, c]) / total) for c in range(4)], 1)
    return _mapped(rgba, to, palette, place)


BACKENDS: dict[str, Callable[[np.ndarray, int], Quantised]] = {"means": by_means, "moments": by_moments, "tree": by_tree}


def register(name: str, f: Callable[[np.ndarray, int], Quantised]) -> None:
    """Adds a quantiser: (rgba, colours at most) to indices and a palette."""
    BACKENDS[name] = f


def quantise(rgba: np.ndarray, most: int, backend: str = "means") -> Quantised:
    """The named backend, or the next ones in turn where it fails."""
    names = [*BACKENDS]
    at = names.index(backend) if backend in names else 0
    failure: Exception | None = None
    for name in names[at:] + names[:at]:
        try:
            indices, palette = BACKENDS[name](rgba, most)
            if indices.shape == rgba.shape[:2] and 0 < len(palette) <= most:
                return indices, palette
        except Exception as e:  # a backend may be anybody's
            failure = e
    raise ValueError("no quantiser could reduce the picture") from failure


def dithered(rgba: np.ndarray, palette: np.ndarray) -> np.ndarray:
    """Indices by error diffusion, every other row from right to left."""
    h, w = rgba.shape[:2]
    out, errors = np.empty((h, w), np.uint8), np.zeros((h + 1, w + 4, 4))
    table = palette.astype(float)
    weight = np.array([1, 1, 1, ALPHA_WEIGHT])
    for y in range(h):
        step = 1 if y % 2 == 0 else -1
        for x in range(w)[::step]:
            e = np.clip(errors[y, x + 2], -MOST_ERROR, MOST_ERROR)
            colour = rgba[y, x].astype(float)
            if (e * e).sum() >= LEAST_ENERGY:
                colour = np.clip(colour + e, 0, 255)
            k = int((((colour - table) ** 2) * weight).sum(1).argmin())
            out[y, x] = k
            off = (colour - table[k]) / SHARE
            for dy, dx in SPREAD:
                errors[y + dy, x + 2 + (dx * step if dy == 0 else dx)] += off
    return out


def sequence_bitmap(frames: list[np.ndarray], most: int, backend: str = "means", dither: bool = False) -> tuple[np.ndarray, list[dict[int, tuple[int, int, int, int]]]]:
    """One bitmap and a palette for each of several RGBA frames of one size. A pixel stands for its
    sequence of colours over the frames; the most frequent sequences get an entry each (1 and up, by
    count, then bytes), the first one that is never seen gets 255, and the rest takes the closest
    entry. The first palette is whole, later ones hold what changes. dither spreads each frame's errors."""
    h, w = frames[0].shape[:2]
    columns = []
    for f in frames:
        indices, palette = quantise(f, most, backend)
        palette = np.where(palette[:, 3:] == 0, 0, palette)
        if dither:
            indices = dithered(f, palette)
        columns.append(palette[indices.ravel()])
    flat = np.ascontiguousarray(np.concatenate(columns, 1).astype(np.uint8))
    rows, place, count = np.unique(flat.view(np.dtype((np.void, flat.shape[1]))).ravel(), return_inverse=True, return_counts=True)
    sequences = rows.view(np.uint8).reshape(len(rows), -1)
    order = np.lexsort((np.arange(len(rows)), -count))
    unseen = [r for r, k in enumerate(order) if not sequences[k, 3::4].any()]
    if not unseen and len(rows) >= most > 1:
        # Without a sequence to leave out, one number stays free for what is outside.
        most -= 1
    kept = order[:most]
    hidden = unseen[0] if unseen and unseen[0] < len(kept) else None
    entry = np.empty(len(rows), np.int64)
    numbers, n = [], 0
    for r in range(len(kept)):
        n += r != hidden
        numbers.append(TRANSPARENT if r == hidden else n)
    entry[kept] = numbers
    for k in order[most:]:
        d = sequences[kept].astype(np.int64) - sequences[k].astype(np.int64)
        entry[k] = numbers[int((d * d).sum(1).argmin())]
    palettes, now = [], {}
    for f in range(len(frames)):
        own = {numbers[r]: tuple(sequences[k, 4 * f : 4 * f + 4].tolist()) for r, k in enumerate(kept) if r != hidden}
        palettes.append({i: c for i, c in own.items() if f == 0 or now.get(i) != c})
        now = own
    return entry[place].reshape(h, w).astype(np.uint8), palettes
