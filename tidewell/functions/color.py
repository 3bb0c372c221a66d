"""Colours: RGB to limited-range YCbCr and back, fixed-point luma."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the standards: the weights of red and blue in luma.
WEIGHTS = {"bt601": (0.299, 0.114), "bt709": (0.2126, 0.0722), "bt2020": (0.2627, 0.0593)}


def canonical_space(name: Column) -> Column:
    """bt601, bt709 or bt2020 for any spelling of them, else null."""
    digits = F.regexp_replace(F.regexp_replace(F.lower(F.trim(name)), r"[.\-_]", ""), "^bt", "")
    return F.when(digits.isin("601", "709", "2020"), F.concat(F.lit("bt"), digits))


def matrix(space: str) -> list[tuple[float, float, float]]:
    """Rows for Y, Cb and Cr from 8-bit full range to 8-bit limited range, without the offsets."""
    r, b = WEIGHTS[space]
    g, y, c = 1 - r - b, 219 / 255, 224 / 255
    return [
        (r * y, g * y, b * y),
        (-r / (2 * (1 - b)) * c, -g / (2 * (1 - b)) * c, 0.5 * c),
        (0.5 * c, -g / (2 * (1 - r)) * c, -b / (2 * (1 - r)) * c),
    ]


def to_ycbcr(red: Column, green: Column, blue: Column, space: str = "bt709") -> list[Column]:
    """Y, Cb and Cr as integers: halves to even, Y within 16 to 235, Cb and Cr within 16 to 240."""
    out = []
    for (a, b, c), offset, top in zip(matrix(space), (16, 128, 128), (235, 240, 240)):
        value = F.rint(red * F.lit(a) + green * F.lit(b) + blue * F.lit(c)).cast("int") + offset
        out.append(F.greatest(F.lit(16), F.least(F.lit(top), value)))
    return out


def to_rgb(y: Column, cb: Column, cr: Column, space: str = "bt709") -> list[Column]:
    r, b = WEIGHTS[space]
    g = 1 - r - b
    luma, u, v = (y - 16) * F.lit(255 / 219), (cb - 128) * F.lit(255 / 224), (cr - 128) * F.lit(255 / 224)
    red, blue = luma + v * F.lit(2 * (1 - r)), luma + u * F.lit(2 * (1 - b))
    green = luma - u * F.lit(2 * b * (1 - b) / g) - v * F.lit(2 * r * (1 - r) / g)
    return [F.greatest(F.lit(0), F.least(F.lit(255), F.rint(x).cast("int"))) for x in (red, green, blue)]


def luma(red: Column, green: Column, blue: Column) -> Column:
    """Luminance in 16-bit fixed point, rounded."""
    return F.shiftright(red.cast("int") * 19595 + green.cast("int") * 38470 + blue.cast("int") * 7471 + 32768, 16)
