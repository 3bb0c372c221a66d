"""Decoder timing and the choice of states, as plain functions over one epoch."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from tidewell.raster.layout import ticks
from tidewell.sources.codec import ACQUISITION, EPOCH_START, NORMAL

#: Rates in bytes a second; how fast a drought lowers the bar for an acquisition; the
#: terms of the similarity from which pictures are fused.
DECODE_RATE, COMPOSE_RATE, DROUGHT = 16_000_000, 32_000_000, 0.035
BASE, SLOPE, HIGHEST, BIAS = 0.9608, 0.014 / 600, 0.9999, 0.008333
#: The margin of a display set that the decoder has no time for.
NO_MARGIN = -1.0


def copy(area: int) -> int:
    return ticks(area, COMPOSE_RATE)


def decode(area: int) -> int:
    return ticks(area, DECODE_RATE)


def decode_duration(state: int, plane: int, windows: dict[int, int], shown: list[tuple[int, int]], objects: dict[int, int], palette_only: bool = False) -> int:
    """Ticks between DTS and PTS of a display set. windows: area by id; shown: (object, window) in
    order; objects: area of the objects that the set defines."""
    spent = copy(plane) if state == EPOCH_START else sum(copy(a) for w, a in windows.items() if w not in {x for _, x in shown})
    if not palette_only:
        waiting, decoded = dict(objects), 0
        for k, (o, w) in enumerate(shown):
            decoded += decode(waiting.pop(o)) if o in waiting else 0
            # Two objects in one window are copied once, with the second.
            if k == 0 and len(shown) > 1 and shown[1][1] == w:
                continue
            spent = max(spent, decoded) + copy(windows.get(w, 0))
    return max(spent, sum(map(copy, windows.values())) + 1)


def fuse_threshold(height: int, share: float, offset: float = 0.0) -> float:
    """Similarity from which a picture joins the one before; share: how much of it both cover."""
    base = min(HIGHEST, BASE + height * SLOPE)
    return min(1.0, base + (1 - base) * (1 - share) - BIAS * (1 - offset))


#: What a display set brings: a new palette for what is on screen, a picture that the decoder still holds,
#: or a new picture.
UPDATE, HELD, NEW = range(3)


@dataclass(frozen=True)
class Rule:
    """The first rule that holds tells the state; drought: what it becomes, from what it was and the rate."""

    holds: Callable[[int, bool, float, float], bool]  # what it brings, whether a window has to be acquired, margin, bar
    state: int
    resend: bool
    drought: Callable[[float, float], float]


RULES = (
    Rule(lambda brings, must, margin, bar: brings == UPDATE, NORMAL, False, lambda drought, rate: drought),
    Rule(lambda brings, must, margin, bar: must, ACQUISITION, False, lambda drought, rate: 0.0),
    Rule(lambda brings, must, margin, bar: brings == NEW, EPOCH_START, False, lambda drought, rate: drought),
    Rule(lambda brings, must, margin, bar: margin > bar, ACQUISITION, True, lambda drought, rate: 0.0),
    Rule(lambda brings, must, margin, bar: True, NORMAL, False, lambda drought, rate: drought + rate),
)


@dataclass(frozen=True)
class Progress:
    """What display sets have left behind: how long no picture was acquired, and how many sets in the
    normal state have followed the last one that was not."""

    drought: float = 0.0
    updates: int = 0


@dataclass(frozen=True)
class StateChoice:
    """Chooses states one after another. least_margin: spare decoding time, as a share, from which a picture that
    the decoder holds is sent again; it falls by DROUGHT for each set that passed without (rate of them at a
    time). At 0 every new picture is acquired. refresh_after: normal sets before an acquisition is due; 0: never."""

    least_margin: float = 0.5
    rate: float = 1.0
    refresh_after: int = 0

    def next(self, before: Progress, brings: int, must: bool = False, margin: float = NO_MARGIN) -> tuple[int, bool, Progress]:
        """(state, whether a held picture is sent again, what is left behind)."""
        must = must or brings == NEW and self.least_margin == 0
        bar = max(self.least_margin - DROUGHT * before.drought, 0.0)
        rule = next(r for r in RULES if r.holds(brings, must, margin, bar))
        counted = before.updates + (self.refresh_after > 0) if rule.state == NORMAL else 0
        return rule.state, rule.resend, Progress(rule.drought(before.drought, self.rate), counted)

    def due(self, now: Progress) -> bool:
        """Whether an acquisition has to be put in; the set that began the run of updates counts as one."""
        return 0 < self.refresh_after <= now.updates

    @staticmethod
    def acquired(now: Progress) -> Progress:
        """After an acquisition that was put in: the drought goes on."""
        return replace(now, updates=0)


def decode_margin(dts: float, free_from: float, pts: float, pts_before: float, full: float, spent_before: float) -> float:
    """Spare decoding time before a display set, in units of what the set before it took: from free_from (when the
    decoder was done with that one) to dts. NO_MARGIN where the decoder is not done, or where the sets are no further
    apart than a full screen takes."""
    if dts <= free_from or pts - pts_before <= full:
        return NO_MARGIN
    return (dts - free_from) / spent_before if spent_before > 0 else float("inf")
