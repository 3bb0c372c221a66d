"""Small option files, read on the driver."""

from __future__ import annotations

import configparser

#: The section of quantiser options and the range of each.
SECTION, RANGES = "PILIQ", {"quality": (0, 100), "speed": (0, 10), "dither": (0, 100)}


def read_quantiser_options(path: str) -> dict[str, int]:
    """Options of the quantiser section; unknown keys are ignored, a value out of range is an error."""
    parser = configparser.ConfigParser(comment_prefixes=(";", "#"), inline_comment_prefixes=(";", "#"))
    with open(path, encoding="utf-8") as f:
        parser.read_file(f)
    out = {}
    for key, (low, high) in RANGES.items():
        if parser.has_option(SECTION, key):
            value = int(parser.get(SECTION, key).strip())
            if not low <= value <= high:
                raise ValueError(f"{key} is {value}, not {low} to {high}")
            out[key] = value
    return out
