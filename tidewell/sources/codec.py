"""The bytes of a graphic-subtitle stream: segments, their payloads, and run-length bitmaps."""

from __future__ import annotations

import struct

import numpy as np

#: Fixed values of the format: magic, header (two clocks, type, length), types, states, limits.
MAGIC = b"PG"
HEADER = struct.Struct(">2sIIBH")
PALETTE, OBJECT, COMPOSITION, WINDOWS, END = 0x14, 0x15, 0x16, 0x17, 0x80
NAMES = {PALETTE: "PDS", OBJECT: "ODS", COMPOSITION: "PCS", WINDOWS: "WDS", END: "END"}
NORMAL, ACQUISITION, EPOCH_START, EPOCH_CONTINUE = 0x00, 0x40, 0x80, 0xC0
FORCED, CROPPED = 0x80, 0x40
FIRST, LAST = 0x80, 0x40
FIRST_FRAGMENT, OTHER_FRAGMENT = 0xFFE4, 0xFFEB
TRANSPARENT = 0xFF


def segment(kind: int, pts: int, dts: int, payload: bytes = b"") -> bytes:
    return HEADER.pack(MAGIC, pts & 0xFFFFFFFF, dts & 0xFFFFFFFF, kind, len(payload)) + payload


def scan(data: bytes, strict: bool = True):
    """Yields (offset, pts, dts, type, payload) of whole segments. At the end of input it returns
    (offset reached, error or None); without strict a wrong magic is not an error."""
    at = 0
    while at + HEADER.size <= len(data):
        magic, pts, dts, kind, size = HEADER.unpack_from(data, at)
        if strict and magic != MAGIC:
            return at, f"lost sync at byte {at} (no PG magic)"
        if at + HEADER.size + size > len(data):
            return at, f"truncated segment at byte {at}"
        yield at, pts, dts, kind, data[at + HEADER.size : at + HEADER.size + size]
        at += HEADER.size + size
    return at, None


def scanned(data: bytes, strict: bool = True) -> tuple[list[tuple], int, str | None]:
    rows, walk = [], scan(data, strict)
    while True:
        try:
            rows.append(next(walk))
        except StopIteration as end:
            return rows, *end.value


def decode_composition(p: bytes) -> dict | None:
    """None if the fixed part is cut off; objects stop where the payload does."""
    if len(p) < 11:
        return None
    w, h, fps, number, state, flag, pal, n = struct.unpack_from(">HHBHBBBB", p)
    objects, at = [], 11
    while len(objects) < n and at + 8 <= len(p):
        o_id, window, flags, x, y = struct.unpack_from(">HBBHH", p, at)
        at += 8
        crop = None
        if flags & CROPPED:
            if at + 8 > len(p):
                break
            crop = dict(zip("xywh", struct.unpack_from(">HHHH", p, at)))
            at += 8
        objects.append({"o_id": o_id, "window_id": window, "forced": bool(flags & FORCED), "x": x, "y": y, "crop": crop})
    return {"width": w, "height": h, "fps": fps, "number": number, "state": state, "pal_flag": bool(flag & 0x80), "pal_id": pal, "n_objects": n, "objects": objects}


def encode_composition(c: dict) -> bytes:
    out = struct.pack(">HHBHBBBB", c["width"], c["height"], c["fps"], c["number"] & 0xFFFF, c["state"], 0x80 * bool(c["pal_flag"]), c["pal_id"], c.get("n_objects", len(c["objects"])))
    for o in c["objects"]:
        crop = o.get("crop")
        out += struct.pack(">HBBHH", o["o_id"], o["window_id"], FORCED * bool(o.get("forced")) | CROPPED * (crop is not None), o["x"], o["y"])
        if crop is not None:
            out += struct.pack(">HHHH", *(crop[k] for k in "xywh"))
    return out


def decode_windows(p: bytes) -> list[dict]:
    n = p[0] if p else 0
    return [dict(zip(("window_id", "x", "y", "w", "h"), struct.unpack_from(">BHHHH", p, at))) for at in range(1, min(1 + 9 * n, len(p) - 8), 9)]


def encode_windows(windows: list[dict]) -> bytes:
    return bytes([len(windows)]) + b"".join(struct.pack(">BHHHH", *(w[k] for k in ("window_id", "x", "y", "w", "h"))) for w in windows)


def decode_palette(p: bytes) -> dict | None:
    """Entries in order; a later one of the same index counts."""
    if len(p) < 2:
        return None
    entries = {p[at]: dict(zip(("y", "cr", "cb", "a"), p[at + 1 : at + 5])) for at in range(2, len(p) - 4, 5)}
    return {"id": p[0], "version": p[1], "entries": entries}


def encode_palette(ident: int, version: int, entries: dict[int, tuple[int, int, int, int]]) -> bytes:
    return bytes([ident, version & 0xFF]) + b"".join(bytes([i, *e]) for i, e in sorted(entries.items()))


def decode_object(p: bytes) -> dict | None:
    if len(p) < 4:
        return None
    o_id, version, seq = struct.unpack_from(">HBB", p)
    out = {"o_id": o_id, "version": version, "seq": seq, "rle_len": None, "w": None, "h": None, "data": p[4:]}
    if seq & FIRST and len(p) >= 11:
        out |= {"rle_len": int.from_bytes(p[4:7], "big"), "w": int.from_bytes(p[7:9], "big"), "h": int.from_bytes(p[9:11], "big"), "data": p[11:]}
    return out


def object_fragments(o_id: int, version: int, w: int, h: int, rle: bytes) -> list[bytes]:
    """Payloads that carry a run-length bitmap: a first one with its size, then plain ones."""
    cuts = [0, *range(FIRST_FRAGMENT, len(rle), OTHER_FRAGMENT), len(rle)] if len(rle) > FIRST_FRAGMENT else [0, len(rle)]
    parts = [rle[a:b] for a, b in zip(cuts, cuts[1:])]
    out = []
    for i, part in enumerate(parts):
        seq = FIRST * (i == 0) | LAST * (i == len(parts) - 1)
        head = struct.pack(">HBB", o_id, version & 0xFF, seq)
        if i == 0:
            head += (len(rle) + 4).to_bytes(3, "big") + struct.pack(">HH", w, h)
        out.append(head + part)
    return out


def encode_rle(bitmap: np.ndarray) -> bytes:
    """Rows of palette indices to runs, found in one pass over all rows."""
    h, w = bitmap.shape
    if not w:
        return b"\0\0" * h
    new = np.ones((h, w), bool)
    new[:, 1:] = bitmap[:, 1:] != bitmap[:, :-1]
    starts = np.flatnonzero(new.ravel())
    lengths = np.diff(np.append(starts, h * w))
    out = bytearray()
    for at, n, c in zip(starts.tolist(), lengths.tolist(), bitmap.ravel()[starts].tolist()):
        if at % w == 0 and at:
            out += b"\0\0"
        while n:
            k = min(n, 0x3FFF)
            if c and k <= 2:
                out += bytes([c]) * k
            else:
                flag = 0x80 if c else 0
                out += bytes([0, flag | k]) if k < 64 else bytes([0, flag | 0x40 | k >> 8, k & 0xFF])
                if c:
                    out.append(c)
            n -= k
    return bytes(out + b"\0\0" * (h > 0))


def decode_rle(data: bytes, w: int, h: int) -> tuple[np.ndarray | None, bool]:
    """(bitmap, ok). ok is false if a run crosses the end of a line, the last line is not full or
    lines are missing, which are filled with 0. A run that is cut off or leaves the bitmap gives
    None. Where the ends of lines are marked does not count."""
    if w <= 0 or h <= 0:
        return None, False
    out, at, i, ok = np.zeros(w * h, np.uint8), 0, 0, True
    try:
        while i < len(data):
            c, n = data[i], 1
            i += 1
            if c == 0:
                flags = data[i]
                i += 1
                if flags == 0:
                    continue
                n = flags & 0x3F
                if flags & 0x40:
                    n = n << 8 | data[i]
                    i += 1
                if not n:
                    return None, False
                if flags & 0x80:
                    c = data[i]
                    i += 1
            elif i < len(data) and data[i] == c:
                n, i = 2, i + 1
            if at + n > w * h:
                return None, False
            # Lines are counted from the last run that ended at the end of one.
            ok &= at % w + n <= w
            out[at : at + n] = c
            at += n
    except IndexError:
        return None, False
    return out.reshape(h, w), ok and at == w * h
