"""A running census over segments that arrive in a stream (a feature of the host, the engine itself
reads whole files). State for each file: counters and whether its last segment closed a set."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidewell.sources import codec

OUT = "file string, segments bigint, display_sets bigint, epochs bigint, bytes bigint"
STATE = "segments bigint, display_sets bigint, epochs bigint, bytes bigint, open boolean"


def step(state: tuple, rows: list[tuple[int, int, int | None]]) -> tuple:
    """Adds rows (type, size, state of a PCS) in order to (segments, sets, epochs, bytes, open)."""
    segments, sets, epochs, size, open_ = state
    for kind, length, pcs_state in rows:
        segments, size = segments + 1, size + codec.HEADER.size + length
        sets += kind == codec.COMPOSITION or not open_
        epochs += kind == codec.COMPOSITION and bool((pcs_state or 0) & codec.EPOCH_START)
        open_ = kind != codec.END
    return segments, sets, epochs, size, open_


def _update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    now = state.get if state.exists else (0, 0, 0, 0, False)
    rows = pd.concat([*batches]).sort_values("seg_ord")
    now = step(now, [(int(t), int(s), None if pd.isna(p) else int(p)) for t, s, p in zip(rows["type"], rows["size"], rows["state"])])
    state.update(now)
    yield pd.DataFrame({"file": [key[0]], "segments": [now[0]], "display_sets": [now[1]], "epochs": [now[2]], "bytes": [now[3]]})


def running_census(segments: DataFrame) -> DataFrame:
    """segments: a streaming DataFrame with file, seg_ord, type, size and pcs, each file's rows in order
    over the batches. Gives a file's counters whenever rows of it arrive (output mode update)."""
    rows = segments.select("file", "seg_ord", "type", "size", F.col("pcs.state").alias("state"))
    return rows.groupBy("file").applyInPandasWithState(_update, OUT, STATE, "update", GroupStateTimeout.NoTimeout)


def windowed_rate(segments: DataFrame, time: str, late: str = "10 seconds", window: str = "1 second") -> DataFrame:
    """Bytes for each file and window of event time; rows later than the watermark are dropped."""
    return segments.withWatermark(time, late).groupBy(F.window(time, window), "file").agg(F.sum(F.col("size") + codec.HEADER.size).alias("bytes"))
