"""Column functions over 90 kHz ticks and other integer clocks.

Ticks are bigint throughout; seconds are derived at the edge only.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the subtitle format: clock, receive, decode and compose rates, buffers in bytes.
FREQ = 90_000
RECEIVE_RATE, DECODE_RATE, COMPOSE_RATE = 2_000_000, 16_000_000, 32_000_000
DECODED_BUFFER, CODED_BUFFER, BUCKET = 4 << 20, 1 << 20, 1 << 20
WRAP = 1 << 32


def big(x: Column | str | int) -> Column:
    return (F.lit(x) if isinstance(x, int) else F.col(x) if isinstance(x, str) else x).cast("bigint")


def div(a: Column, b: Column | int) -> Column:
    """Integer division of non-negative bigints."""
    return F.call_function("div", big(a), big(b))


def modular_difference(a: Column, b: Column) -> Column:
    """(a - b) modulo 2^32, for ticks that wrap."""
    return (big(a) - big(b)).bitwiseAND(F.lit(WRAP - 1))


def ceil_ticks(area: Column | int, rate: int) -> Column:
    """Ticks to move `area` bytes at `rate` bytes a second, rounded up."""
    return div(big(area) * F.lit(FREQ) + F.lit(rate - 1), rate)


def copy_ticks(area: Column | int) -> Column:
    return ceil_ticks(area, COMPOSE_RATE)


def decode_ticks(area: Column | int) -> Column:
    return ceil_ticks(area, DECODE_RATE)


def to_ticks(seconds: Column) -> Column:
    """Seconds to ticks, halves away from zero."""
    return F.round(seconds * FREQ).cast("bigint")


def to_seconds(ticks: Column) -> Column:
    return ticks / F.lit(float(FREQ))


def half_even(x: Column) -> Column:
    """Banker's rounding to a whole number."""
    return F.rint(x)


def unwrap(ticks: Column, window) -> Column:
    """Ticks that continue over 2^32: a step back of more than half the range is a wrap."""
    before = F.lag(ticks).over(window)
    wraps = F.sum(F.when(before - ticks > WRAP // 2, 1).otherwise(0)).over(window)
    return ticks + wraps * F.lit(WRAP)


def micros(ts: Column | str) -> Column:
    """Microseconds since 1970 of a timestamp without zone, whatever the session's zone is."""
    c = F.col(ts) if isinstance(ts, str) else ts
    clock = F.hour(c).cast("bigint") * 3_600_000_000 + F.minute(c) * F.lit(60_000_000).cast("bigint")
    return F.unix_date(c.cast("date")).cast("bigint") * 86_400_000_000 + clock + F.round(F.extract(F.lit("SECOND"), c).cast("decimal(10,6)") * 1_000_000).cast("bigint")
