"""Pixel kernels as columns: Arrow batches in, numpy inside."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewell.raster import layout, pixels
from tidewell.sources import codec

BOX = "struct<x:int,y:int,w:int,h:int>"


def _picture(data: bytes, w: int, h: int) -> np.ndarray:
    return np.frombuffer(data, np.uint8).reshape(h, w, 4)


def decode_rle(data: Column, w: Column, h: Column) -> Column:
    """struct<bitmap, ok>; a null bitmap where the runs cannot be followed."""

    @F.pandas_udf("struct<bitmap:binary,ok:boolean>")
    def run(d: pd.Series, w: pd.Series, h: pd.Series) -> pd.DataFrame:
        out = [codec.decode_rle(bytes(a or b""), int(b), int(c)) for a, b, c in zip(d, w.fillna(0), h.fillna(0))]
        return pd.DataFrame({"bitmap": [None if x is None else x.tobytes() for x, _ in out], "ok": [ok for _, ok in out]})

    return run(data, w, h)


def encode_rle(bitmap: Column, w: Column, h: Column) -> Column:
    @F.pandas_udf("binary")
    def run(b: pd.Series, w: pd.Series, h: pd.Series) -> pd.Series:
        return pd.Series([codec.encode_rle(np.frombuffer(x, np.uint8).reshape(int(q), int(p))) for x, p, q in zip(b, w, h)])

    return run(bitmap, w, h)


def pixel_census(data: Column, w: Column, h: Column) -> Column:
    """struct<pixels, non_empty> of a run-length bitmap: how many pixels, and how many are not 0."""

    @F.pandas_udf("struct<pixels:bigint,non_empty:bigint>")
    def run(d: pd.Series, w: pd.Series, h: pd.Series) -> pd.DataFrame:
        maps = [codec.decode_rle(bytes(a or b""), int(b), int(c))[0] for a, b, c in zip(d, w.fillna(0), h.fillna(0))]
        return pd.DataFrame({"pixels": [0 if m is None else m.size for m in maps], "non_empty": [0 if m is None else int((m != 0).sum()) for m in maps]})

    return run(data, w, h)


def content_box(rgba: Column, w: Column, h: Column) -> Column:
    """The box of what is not transparent; 1 x 1 at the origin if nothing is."""

    @F.pandas_udf(BOX)
    def run(d: pd.Series, w: pd.Series, h: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([pixels.trim(_picture(a, int(b), int(c)))[0] for a, b, c in zip(d, w, h)], columns=[*"xywh"])

    return run(rgba, w, h)


def similarity(a: Column, b: Column, w: Column, h: Column) -> Column:
    """struct<score, share> of two RGBA pictures of one size."""

    @F.pandas_udf("struct<score:double,share:double>")
    def run(a: pd.Series, b: pd.Series, w: pd.Series, h: pd.Series) -> pd.DataFrame:
        out = [layout.picture_similarity(_picture(x, int(p), int(q)), _picture(y, int(p), int(q))) for x, y, p, q in zip(a, b, w, h)]
        return pd.DataFrame(out, columns=["score", "share"])

    return run(a, b, w, h)


def window_layout(mask: Column, w: Column, h: Column) -> Column:
    """struct<first, second, stacked> for a mask of a byte for each pixel; both windows are the same
    where one serves."""

    @F.pandas_udf(f"struct<first:{BOX},second:{BOX},stacked:boolean>")
    def run(m: pd.Series, w: pd.Series, h: pd.Series) -> pd.DataFrame:
        rows = []
        for x, p, q in zip(m, w, h):
            _, a, b, stacked = layout.windows_for(np.frombuffer(x, np.uint8).reshape(int(q), int(p)) != 0)
            rows.append(({"x": a.x, "y": a.y, "w": a.w, "h": a.h}, {"x": b.x, "y": b.y, "w": b.w, "h": b.h}, stacked))
        return pd.DataFrame(rows, columns=["first", "second", "stacked"])

    return run(mask, w, h)
