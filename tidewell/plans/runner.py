"""Runs one job at a time under a Spark job group, with events and a way to cancel it."""

from __future__ import annotations

import json
import logging
import threading
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

log = logging.getLogger("tidewell")


class Busy(RuntimeError):
    pass


class Runner:
    """run() calls a job and tells `emit` what happens: progress, a log line when the job has ended or failed and, always last, done."""

    def __init__(self, spark: SparkSession, emit: Callable[[dict], None] = lambda event: None):
        self.spark, self.emit = spark, emit
        self._lock, self._group, self._cancelled = threading.Lock(), "", False

    def run(self, job: Callable[[Callable[[int, int], None]], dict]) -> dict:
        """job gets a function to tell progress (done, total) and returns counters."""
        if not self._lock.acquire(blocking=False):
            raise Busy("a job is running")
        began = time.monotonic()
        self._group, self._cancelled = f"tidewell-{uuid.uuid4().hex}", False
        self.spark.sparkContext.setJobGroup(self._group, "tidewell job", interruptOnCancel=True)
        try:
            counters = job(self.progress)
            self.emit({"type": "log", "level": "info", "msg": "the job has ended"})
            event = {"type": "done", "success": True, **counters}
        except Exception as e:
            log.debug("the job failed", exc_info=True)
            self.emit({"type": "log", "level": "error", "msg": str(e).splitlines()[0] if str(e) else type(e).__name__})
            event = {"type": "done", "success": False, "error": str(e).splitlines()[0] if str(e) else type(e).__name__, "cancelled": self._cancelled}
        finally:
            self.spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
            self._lock.release()
        event["duration_ms"] = int((time.monotonic() - began) * 1000)
        self.emit(event)
        return event

    def progress(self, epoch: int, total: int) -> None:
        self.emit({"type": "progress", "percent": 100 * epoch // max(total, 1), "epoch": epoch, "total": total})

    def cancel(self) -> None:
        self._cancelled = True
        self.spark.sparkContext.cancelJobGroup(self._group)


def as_line(event: dict) -> str:
    """An event as a line of NDJSON; what is None is left out."""
    return json.dumps({k: v for k, v in event.items() if v is not None}, separators=(",", ":"), ensure_ascii=False)


def encode_job(spark: SparkSession, xml: str, folder: str, out: str, config=None, elementary: tuple[str, str] | None = None, overwrite: bool = False, warn: Callable[[str, int], None] = lambda kind, count: None, after: Callable[[DataFrame], None] = lambda segments: None) -> Callable:
    """A job for Runner: encodes a project, writes its stream and, if it keeps the bitrate, the elementary stream and
    its index. The stream is written in any case. Progress is told by epoch while it is written. warn gets kinds of
    warnings and how often they apply; after gets the segments when all is written."""
    from tidewell.plans import encode, inspect
    from tidewell.sources import bdn, codec, pgs

    def job(progress) -> dict:
        settings = config or encode.JobConfig()
        for text in settings.warnings:
            warn(text, 1)
        segments = encode.encode(spark, xml, folder, settings).persist()
        try:
            sets = inspect.with_sets(pgs.parsed(segments))
            seen = inspect.census(sets).first()
            total = seen.epochs if seen else 0
            progress(0, total)
            done = 0

            def told(segment: bytes) -> None:
                nonlocal done
                if segment[10] == codec.COMPOSITION and segment[codec.HEADER.size + 7] & codec.EPOCH_START:
                    done += 1
                    progress(done, total)

            count = pgs.write_sup(segments, out, overwrite=overwrite, told=told)
            ok = not settings.max_kbps or inspect.bitrate_stats(segments, settings.max_kbps * 1000 // 8).filter("not ok").isEmpty()
            if not ok:
                warn("the bitrate is exceeded", 1)
            if elementary and ok:
                pgs.write_elementary(segments, *elementary, overwrite=overwrite)
            header = bdn.read_header(spark, xml, settings.any_size).first()
            events = bdn.read_events(spark, xml, header.rate.num // 1000 if header.rate.den == 1001 else header.rate.num).count()
            after(segments)
            names = ("es", "acq", "nc", "nc_ods", "pu", "pu_buffered", "display_sets")
            # Sets that go on with objects of sets before them.
            held = sets.groupBy("ds").agg(F.max(F.when(F.col("pcs.state") == codec.NORMAL, F.size("pcs.objects"))).alias("n"), F.count_if(F.col("type") == codec.OBJECT).alias("sent")).filter("n > 0 and sent = 0").count()
            return {"events": events, "epochs": total, "segments": count, **{n: seen[n] if seen else 0 for n in names}, "reuse_candidates": held, "compliant": ok}
        finally:
            segments.unpersist()

    return job


def validate_code(found: DataFrame, status: DataFrame) -> int:
    """2 if no file could be read, 1 if one breaks a hard rule, else 0."""
    readable = status.filter("segments > 0")
    if readable.isEmpty():
        return 2
    return 1 if not found.filter("hard").isEmpty() else 0
