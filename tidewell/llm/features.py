"""Features of texts and logistic models on them, in numpy."""

from __future__ import annotations

import numpy as np

SIZE = 1_024
_FOLD = ((np.arange(1 << 16, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(54)).astype(np.int64)


def content(text: str | None) -> np.ndarray:
    """Square roots of the shares of hashed byte pairs, and a few figures of the words."""
    out = np.zeros(SIZE + 4, np.float32)
    raw = np.frombuffer((text or "").encode("utf-8", "replace"), np.uint8)
    if len(raw) > 1:
        pairs = (raw[:-1].astype(np.int64) << 8) | raw[1:]
        out[:SIZE] = np.sqrt(np.bincount(_FOLD[pairs], minlength=SIZE) / len(pairs))
    words = (text or "").split()
    if words:
        out[SIZE:] = (np.log1p(len(words)) / 10, len(set(words)) / len(words), min(1.0, len(text) / len(words) / 20), 1.0)
    return out


#: Places of hashed names, and of sizes by their power of 2.
NAMES, SIZES = 64, 40


def metadata(names: tuple[str | None, ...], size: int | None) -> np.ndarray:
    """What the table says about a document: its hashed names (language, source) and its size. A null name has
    a place of its own, a null size none."""
    import xxhash

    out = np.zeros(NAMES + SIZES + 2, np.float32)
    for i, n in enumerate(names):
        out[xxhash.xxh32_intdigest(f"{i}={n}".encode()) % NAMES] = 1
    if size is not None:
        out[NAMES + min(SIZES - 1, int(max(0, size)).bit_length())] = 1
        out[-2] = np.log1p(max(0, size)) / 12
    out[-1] = 1
    return out


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, decay: float = 1e-4, steps: int = 250) -> np.ndarray:
    """Multinomial logistic regression by Adam from zero: y holds a row of class shares for each
    row of x. Returns the weights (features, classes)."""
    x, y = x.astype(np.float32, copy=False), y.astype(np.float32)
    w = np.zeros((x.shape[1], y.shape[1]), np.float32)
    m, v = np.zeros_like(w), np.zeros_like(w)
    weight = (weight / weight.sum()).astype(np.float32)[:, None]
    for t in range(1, steps + 1):
        g = x.T @ (weight * (softmax(x @ w) - y)) + decay * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(1, keepdims=True))
    return z / z.sum(1, keepdims=True)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))
