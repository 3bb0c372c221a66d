"""python -m tidewell.plans stats|validate|inspect|encode ...: the commands of the engine."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def _between(low: int, high: int):
    def number(text: str) -> int:
        value = int(text)
        if not low <= value <= high:
            raise argparse.ArgumentTypeError(f"{value} is not from {low} to {high}")
        return value

    return number


def matrix_of(name: str) -> str | None:
    """bt601, bt709 or bt2020 from a spelling of it (BT.709, bt-709, 709), or None."""
    short = "".join(c for c in name.lower() if c not in ". -_").removeprefix("bt")
    return f"bt{short}" if short in ("601", "709", "2020") else None


def config_of(args):
    """The options of a run. Values that make no sense stop it; others are put right with a warning."""
    from dataclasses import replace

    from tidewell.plans.encode import COLOURS, JobConfig
    from tidewell.raster.colours import BACKENDS
    from tidewell.sources.settings import read_quantiser_options

    if args.redraw_period < 0:
        raise ValueError("a negative refresh period")
    names, said = [*BACKENDS], []
    if not 0 <= args.quantizer < len(names):
        said.append(f"there is no quantiser {args.quantizer}")
    matrix = matrix_of(args.bt_matrix)
    if matrix is None:
        said.append(f"unknown colour matrix {args.bt_matrix}, using bt709")
    own = read_quantiser_options(args.config) if args.config else {}
    config = JobConfig(
        names[args.quantizer] if 0 <= args.quantizer < len(names) else names[0], matrix or "bt709", args.compression / 100, args.acqrate / 100, args.extra_acq, args.redraw_period,
        args.ssim_tol / 100, args.single_object_ds, args.allow_normal, args.tight_ods, args.full_palette, args.ignore_resolution, own.get("dither", 0) > 0, COLOURS * own.get("quality", 100) // 100, args.max_kbps,
    )
    return replace(config, warnings=(*said, *config.warnings))


def _text(event: dict) -> str:
    """An event for people."""
    kind = event["type"]
    if kind == "progress":
        return f"epoch {event['epoch']} of {event['total']} ({event['percent']} %)"
    if kind == "warn":
        return f"warning: {event['kind']}" + (f" ({event['count']} times)" if event["count"] > 1 else "")
    if kind == "log":
        return f"{event['level']}: {event['msg']}"
    return ", ".join(f"{k} {v}" for k, v in event.items() if k != "type")


def main(argv: list[str] | None = None) -> int:
    from tidewell.plans import inspect, runner
    from tidewell.sources import pgs

    parser = argparse.ArgumentParser(prog="tidewell")
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("stats", "validate", "inspect"):
        c = commands.add_parser(name)
        c.add_argument("path")
        c.add_argument("--ds", type=int, default=None)
        c.add_argument("--max-kbps", type=int, default=0)
        c.add_argument("--text", action="store_true", help="a line of text instead of JSON for each row")
    c = commands.add_parser("encode")
    c.add_argument("xml")
    c.add_argument("images")
    c.add_argument("out")
    c.add_argument("-y", "--overwrite", action="store_true")
    c.add_argument("-q", "--quantizer", type=int, default=0, help="number of the quantiser, 0 on")
    c.add_argument("--bt-matrix", default="bt709")
    c.add_argument("-c", "--compression", type=_between(0, 100), default=80)
    c.add_argument("-a", "--acqrate", type=_between(0, 100), default=100)
    c.add_argument("-e", "--extra-acq", type=_between(0, 100), default=2)
    c.add_argument("--ssim-tol", type=_between(-100, 100), default=0)
    c.add_argument("--redraw-period", type=float, default=0.0)
    c.add_argument("-m", "--max-kbps", type=int, default=0)
    c.add_argument("-t", "--threads", type=_between(0, 10), default=0, help="partitions of the encoding; 0: as Spark has it")
    c.add_argument("--config", help="an INI file with quantiser options")
    c.add_argument("--elementary", nargs=2, metavar=("STREAM", "INDEX"))
    for flag in ("--allow-normal", "--full-palette", "--tight-ods", "--single-object-ds", "--ignore-resolution", "--json"):
        c.add_argument(flag, action="store_true")
    args = parser.parse_args(argv)
    if args.command == "encode":
        try:
            config = config_of(args)
        except (OSError, ValueError) as e:
            print(runner.as_line({"type": "log", "level": "error", "msg": str(e)}) if args.json else f"error: {e}")
            return 1
    spark = SparkSession.builder.appName("tidewell").getOrCreate()
    if args.command == "encode":
        if args.threads:
            spark.conf.set("spark.sql.shuffle.partitions", str(args.threads))
        emit = lambda event: print(runner.as_line(event) if args.json else _text(event), flush=True)
        warn = lambda kind, count: emit({"type": "warn", "kind": kind, "count": count})
        job = runner.encode_job(spark, args.xml, args.images, args.out, config, tuple(args.elementary) if args.elementary else None, args.overwrite, warn)
        return 0 if runner.Runner(spark, emit).run(job)["success"] else 1
    segments, status = pgs.read_segments(spark, args.path), pgs.read_status(spark, args.path)
    if status.filter("segments > 0").isEmpty():
        return 2
    sets = inspect.with_sets(segments)
    if args.command == "stats":
        rows = inspect.census(sets)
    elif args.command == "validate":
        rows = inspect.findings(segments, status, args.max_kbps)
    else:
        rows = sets.filter(F.col("ds") == args.ds) if args.ds is not None else sets
        rows = rows.select("file", "ds", "seg_ord", "type_name", "pts", "dts", "size")
        if rows.isEmpty():
            return 2
    line = F.concat_ws(", ", *[F.concat(F.lit(f"{c} "), F.col(c).cast("string")) for c in rows.columns]) if args.text else F.to_json(F.struct("*"))
    for told in rows.select(line).toLocalIterator():
        print(told[0])
    return runner.validate_code(rows, status) if args.command == "validate" else 0


if __name__ == "__main__":
    sys.exit(main())
