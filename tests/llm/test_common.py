from pathlib import Path

import pyarrow as pa
import pyarrow.fs as pafs
import pytest
from pyspark.sql import functions as F

from tidewell.llm.common import LISTING, TableWriter, arrow_rows, drop_stored, new_path, noted, remove, shared_dir, stored


def test_table_round_trip(spark):
    df = spark.range(100).select("id", (F.col("id") * 2.5).alias("d"), F.when(F.col("id") % 3 == 0, F.col("id").cast("string")).alias("s"), F.array("id", F.lit(None)).alias("a"), F.struct(F.lit(True).alias("x"), F.lit(b"\0").alias("y")).alias("t"))
    out = stored(df)
    assert out.schema.simpleString() == df.schema.simpleString() and sorted(out.collect()) == sorted(df.collect())
    path = out.inputFiles()[0].rsplit("/", 1)[0]
    drop_stored(out)
    assert pafs.FileSystem.from_uri(path.replace("file:///", "/"))[0].get_file_info(path.removeprefix("file://")).type == pafs.FileType.NotFound


def test_empty_table(spark):
    out = stored(spark.range(0).withColumn("x", F.lit("a")))
    assert out.count() == 0 and out.columns == ["id", "x"]


def test_only_listed_files_are_read(spark):
    path = new_path(spark, "attempts")
    batch = pa.RecordBatch.from_pylist([{"id": 1}])
    lost, kept = (TableWriter({"path": path}).write(iter([batch])) for _ in range(2))
    TableWriter({"path": path}).commit([kept, None])
    fs, root = pafs.FileSystem.from_uri(path)
    listed = fs.open_input_stream(f"{root}/{LISTING}").read().decode().split()
    assert listed == kept.names and lost.names[0] not in listed


def test_tables_are_removed(spark):
    with noted() as folders:
        a = stored(spark.range(5))
    b = stored(spark.range(6))
    remove(spark, folders)
    exists = lambda df: pafs.FileSystem.from_uri(f := df.inputFiles()[0].replace("file:///", "/"))[0].get_file_info(f).type != pafs.FileType.NotFound
    assert not exists(a) and exists(b) and b.count() == 6


def test_failed_writes_leave_nothing(spark):
    before = {p.name for p in Path(shared_dir(spark).removeprefix("file://"), "tidewell").glob("*")}
    with pytest.raises(Exception):
        stored(spark.range(10).withColumn("x", F.raise_error(F.lit("no"))))
    assert {p.name for p in Path(shared_dir(spark).removeprefix("file://"), "tidewell").glob("*")} == before


def test_session_settings(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    with arrow_rows(spark, 7):
        assert spark.conf.get(key) == "7"
    assert spark.conf.get(key) == before and shared_dir(spark) == shared_dir(spark)
