"""Time codes and frame rates.

A time code is a frame count from 1 on and a rate; a rate is an exact fraction.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewell.functions.ticks import FREQ, big, div

#: Fixed values of the format: rates by their code in the stream.
RATES = {0x10: (24_000, 1_001), 0x20: (24, 1), 0x30: (25, 1), 0x40: (30_000, 1_001), 0x60: (50, 1), 0x70: (60_000, 1_001), 0x80: (60, 1)}
#: Video sizes, and for each the rates that go with it.
FORMATS = {(1920, 1080): (0x10, 0x20, 0x30, 0x40), (1280, 720): (0x10, 0x20, 0x60, 0x70), (720, 576): (0x30,), (720, 480): (0x40,)}
RATE_TOLERANCE = 0.07


def nominal(num: Column, den: Column) -> Column:
    """Whole frames a second that a time code counts: 24 for 24000/1001."""
    return F.when(den == 1001, div(num, 1000)).otherwise(num.cast("bigint"))


def from_hmsf(text: Column, nominal_rate: Column | int) -> Column:
    """HH:MM:SS:FF to a frame count from 1 on; fields that are no numbers count as 0."""
    parts = F.split(text, ":")
    part = lambda i: F.coalesce(F.get(parts, F.lit(i)).try_cast("bigint"), F.lit(0).cast("bigint"))
    return (part(0) * 3600 + part(1) * 60 + part(2)) * big(nominal_rate) + part(3) + 1


def to_hmsf(frames: Column, nominal_rate: Column | int) -> Column:
    f, rate = big(frames) - 1, big(nominal_rate)
    seconds = div(f, rate)
    return F.format_string("%02d:%02d:%02d:%02d", div(seconds, 3600), div(seconds, 60) % 60, seconds % 60, f % rate)


def to_ticks(frames: Column, num: Column | int, den: Column | int) -> Column:
    """Ticks at which a frame starts; frame 1 and all before it start at 0."""
    return F.when(big(frames) <= 1, F.lit(0).cast("bigint")).otherwise(div((big(frames) - 1) * FREQ * big(den), big(num)))


def from_ticks(ticks: Column, num: Column | int, den: Column | int) -> Column:
    """The frame that shows at a tick, to the nearest."""
    return F.round(big(ticks) * big(num) / (F.lit(float(FREQ)) * big(den))).cast("bigint") + 1


def nearest_rate(rate: Column) -> Column:
    """struct<code, num, den> of the closest rate, or null beyond the tolerance. Of equally close
    ones the smaller code counts."""
    each = F.array(*[F.struct(F.abs(rate - F.lit(n / d)).alias("off"), F.lit(code).alias("code"), F.lit(n).alias("num"), F.lit(d).alias("den")) for code, (n, d) in sorted(RATES.items())])
    best = F.array_min(each)
    return F.when(best["off"] < RATE_TOLERANCE, F.struct(best["code"].alias("code"), best["num"].alias("num"), best["den"].alias("den")))


def parse_rate(text: Column) -> Column:
    """"24" or "24000/1001" as a double; null if it is neither."""
    parts = F.split(F.trim(text), "/")
    num, den = F.get(parts, F.lit(0)).try_cast("double"), F.get(parts, F.lit(1)).try_cast("double")
    return F.when(F.size(parts) == 1, num).when((F.size(parts) == 2) & (den != 0), num / den)


def rate_code(num: Column, den: Column) -> Column:
    out = F.lit(None).cast("int")
    for code, (n, d) in RATES.items():
        out = F.when((num == n) & (den == d), F.lit(code)).otherwise(out)
    return out


def fits_format(width: Column, height: Column, code: Column) -> Column:
    out = F.lit(False)
    for (w, h), codes in FORMATS.items():
        out = out | ((width == w) & (height == h) & code.isin(*codes))
    return out


def rate_text(num: Column, den: Column, drop_frame: Column) -> Column:
    """A frame rate as text, with three digits and DF or NDF."""
    return F.concat(F.format_string("%.3f fps ", num / den), F.when(drop_frame, "DF").otherwise("NDF"))


def elapsed_text(millis: Column) -> Column:
    """Minutes and seconds, two digits at least: 05:09, 100:00."""
    total = F.floor(millis / 1000)
    two = lambda x: F.when(x < 10, F.concat(F.lit("0"), x.cast("string"))).otherwise(x.cast("string"))
    return F.concat(two(F.floor(total / 60)), F.lit(":"), two(total % 60))


def remaining_text(millis: Column, done: Column, total: Column) -> Column:
    """How long the rest takes at the rate so far, as 1m 5s or 40s; null at the start and when all is done."""
    seconds = F.floor(millis * (total - done) / done / 1000)
    text = F.when(seconds >= 60, F.concat(F.floor(seconds / 60).cast("string"), F.lit("m "), (seconds % 60).cast("string"), F.lit("s"))).otherwise(F.concat(seconds.cast("string"), F.lit("s")))
    return F.when((done > 0) & (total > done), text)


def without_clock(line: Column) -> Column:
    """A log line without the clock and level that it begins with."""
    return F.regexp_replace(line, r"^\d{2}:\d{2}:\d{2}\s+[A-Z]+:\s+", "")
