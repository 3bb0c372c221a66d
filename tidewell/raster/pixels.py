"""Bitmaps: trimming, cropping, composing, similarity."""

from __future__ import annotations

import numpy as np
from numpy.lib.stride_tricks import sliding_window_view

TRANSPARENT = 0xFF
#: Fixed values of the similarity measure: tile size and its two constants.
TILE, C1, C2 = 7, 2.55**2, 7.65**2
#: Binomial kernels, and the derivative of a 5 x 5 Sobel filter.
BLUR5, BLUR3, DERIVE = np.array([1, 4, 6, 4, 1]), np.array([1, 2, 1]), np.array([-1, -2, 0, 2, 1])


def bounds(mask: np.ndarray) -> tuple[int, int, int, int] | None:
    """x, y, w, h of the box around what is set, or None."""
    rows, columns = np.flatnonzero(mask.any(1)), np.flatnonzero(mask.any(0))
    if not len(rows):
        return None
    return int(columns[0]), int(rows[0]), int(columns[-1] - columns[0] + 1), int(rows[-1] - rows[0] + 1)


def trim(rgba: np.ndarray) -> tuple[tuple[int, int, int, int], np.ndarray]:
    """The box of what is not transparent and its pixels; a 1 x 1 box and no pixels if nothing is."""
    box = bounds(rgba[..., 3] > 0)
    if box is None:
        return (0, 0, 1, 1), rgba[:0, :0]
    x, y, w, h = box
    return box, rgba[y : y + h, x : x + w]


def crop(bitmap: np.ndarray, x: int, y: int, w: int, h: int) -> np.ndarray:
    """A part of an indexed bitmap; what lies outside is transparent."""
    out = np.full((max(h, 0), max(w, 0)), TRANSPARENT, np.uint8)
    x0, y0, x1, y1 = max(x, 0), max(y, 0), min(x + w, bitmap.shape[1]), min(y + h, bitmap.shape[0])
    if x1 > x0 and y1 > y0:
        out[y0 - y : y1 - y, x0 - x : x1 - x] = bitmap[y0:y1, x0:x1]
    return out


def paste(canvas: np.ndarray, picture: np.ndarray, x: int, y: int) -> None:
    """Writes a picture over a canvas, cut off at its edges."""
    x0, y0, x1, y1 = max(x, 0), max(y, 0), min(x + picture.shape[1], canvas.shape[1]), min(y + picture.shape[0], canvas.shape[0])
    if x1 > x0 and y1 > y0:
        canvas[y0:y1, x0:x1] = picture[y0 - y : y1 - y, x0 - x : x1 - x]


def over(below: np.ndarray, above: np.ndarray) -> np.ndarray:
    """Straight-alpha composition in whole numbers."""
    a, b = above[..., 3:].astype(np.int64), below[..., 3:].astype(np.int64)
    alpha = a + b * (255 - a) // 255
    colour = (above[..., :3] * a + below[..., :3] * (b * (255 - a) // 255)) // np.maximum(alpha, 1)
    return np.concatenate([np.where(alpha > 0, colour, 0), alpha], -1).astype(np.uint8)


def free_index(bitmap: np.ndarray, palette: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Moves entries up by one, so that 0 stays free, and transparent ones to 255."""
    to = np.where(palette[:, 3] == 0, TRANSPARENT, np.arange(len(palette)) + 1).astype(np.uint8)
    out = np.zeros((256, 4), palette.dtype)
    seen = palette[:, 3] != 0
    out[to[seen]] = palette[seen]
    return to[bitmap], out


def luminance(rgba: np.ndarray) -> np.ndarray:
    c = rgba.astype(np.int64)
    return ((c[..., 0] * 19595 + c[..., 1] * 38470 + c[..., 2] * 7471 + 32768) >> 16).astype(np.uint8)


def _filtered(a: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    """A separable filter; edges are mirrored without repeating the last pixel."""
    r, out = len(kernel) // 2, a.astype(np.int64)
    for axis in (1, 0):
        n = out.shape[axis]
        at = np.abs(np.arange(-r, n + r))
        at = np.clip(np.where(at >= n, 2 * (n - 1) - at, at), 0, n - 1)
        out = sliding_window_view(out.take(at, axis), len(kernel), axis) @ kernel
    return out


def blur(a: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    scale = int(kernel.sum()) ** 2
    return ((_filtered(a, kernel) + scale // 2) // scale).astype(np.uint8)


def edges(a: np.ndarray) -> np.ndarray:
    """The mixed second derivative; what is negative becomes 0."""
    return np.clip(_filtered(a, DERIVE), 0, 255).astype(np.uint8)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Mean structural similarity of whole tiles; what is left over at the edges does not count, and
    pictures smaller than a tile are alike."""
    h, w = a.shape[0] // TILE, a.shape[1] // TILE
    if not h or not w:
        return 1.0

    def tiles(x):
        return x[: h * TILE, : w * TILE].reshape(h, TILE, w, TILE).swapaxes(1, 2).reshape(h * w, -1).astype(float)

    x, y = tiles(a), tiles(b)
    mx, my = x.mean(1), y.mean(1)
    dx, dy = x - mx[:, None], y - my[:, None]
    vx, vy, c = (dx * dx).mean(1), (dy * dy).mean(1), (dx * dy).mean(1)
    return float((((2 * mx * my + C1) * (2 * c + C2)) / ((mx * mx + my * my + C1) * (vx + vy + C2))).mean())


def masked_similarity(a: np.ndarray, b: np.ndarray) -> tuple[float, float]:
    """(score, share): similarity of two RGBA pictures where both are set, widened by a blur: the worse
    of luminance and edges; and the share of the picture that is. Apart they are alike: (1, 1)."""
    both = (a[..., 3] > 0) & (b[..., 3] > 0)
    if not both.any():
        return 1.0, (1.0 if both.size else 0.0)
    mask = blur(both * np.uint8(255), BLUR5) > 0
    la, lb = luminance(a), luminance(b)
    ea, eb = edges(blur(la, BLUR3)), edges(blur(lb, BLUR3))
    return min(similarity(la * mask, lb * mask), similarity(ea * mask, eb * mask)), float(mask.mean())
