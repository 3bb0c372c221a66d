"""Event streams of the engine in newline-delimited JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the protocol: kinds of events, and one schema for all of them.
KINDS = ("log", "warn", "progress", "done", "stats", "validate", "finding", "error")
SCHEMA = (
    "type string, level string, msg string, kind string, count bigint, percent int, epoch int, total int, success boolean, error string, events int, epochs int, segments int, "
    "duration_ms bigint, es int, acq int, nc int, nc_ods int, pu int, pu_buffered int, display_sets int, reuse_candidates int, cancelled boolean, rule string, detail string, ds bigint, hard boolean"
)


def parse(df: DataFrame, column: str, schema: str, strict: bool = False) -> DataFrame:
    """df with the fields of the JSON objects in a column. A malformed object gives nulls, or under
    strict stops the query."""
    mode = {"mode": "FAILFAST" if strict else "PERMISSIVE"}
    return df.withColumn("_json", F.from_json(column, schema, mode)).select("*", "_json.*").drop("_json")


def read_ndjson(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """Events of files at path, in one wide schema. Blank lines are skipped; an unknown kind stops the
    query under strict and is dropped otherwise."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    out = parse(lines, "value", SCHEMA, strict).drop("value")
    known = F.col("type").isin(*KINDS)
    if strict:
        return out.filter(F.when(known, True).otherwise(F.raise_error(F.concat(F.lit("unknown kind of event: "), F.coalesce("type", F.lit("none")))).cast("boolean")))
    return out.filter(known)


def write_ndjson(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """An object for each row, without its null fields."""
    df.select(F.to_json(F.struct("*")).alias("value")).write.mode(mode).text(path)
