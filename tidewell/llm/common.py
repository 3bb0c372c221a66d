"""Helpers that the operators of this folder share."""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

#: The list of a table's files, and bytes of rows that are written at a time.
LISTING, GROUP_BYTES = "_files", 8 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or, where that is
    unset and all runs in one process (tests), a temporary folder made once per session."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("tidewell.shared.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tidewell-")
        spark.conf.set("tidewell.shared.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tidewell/{name}-{uuid.uuid4().hex}"


@dataclass
class Files(WriterCommitMessage):
    names: list[str]


class TableWriter(DataSourceArrowWriter):
    """Parquet files by pyarrow, one for each task that has rows. Commit lists the files of the tasks
    that Spark accepted; what other attempts have left is not listed and so never read."""

    def __init__(self, options):
        self.path = options["path"]

    def write(self, iterator):
        fs, root = pafs.FileSystem.from_uri(self.path)
        name, out, held, size = f"part-{uuid.uuid4().hex}.parquet", None, [], 0
        for batch in iterator:
            if not batch.num_rows:
                continue
            if out is None:
                fs.create_dir(root, recursive=True)
                out = pq.ParquetWriter(f"{root}/{name}", batch.schema, filesystem=fs)
            held.append(batch)
            size += batch.nbytes
            if size > GROUP_BYTES:
                out.write_table(pa.Table.from_batches(held))
                held, size = [], 0
        if out is None:
            return Files([])
        if held:
            out.write_table(pa.Table.from_batches(held))
        out.close()
        return Files([name])

    def commit(self, messages):
        fs, root = pafs.FileSystem.from_uri(self.path)
        fs.create_dir(root, recursive=True)
        with fs.open_output_stream(f"{root}/{LISTING}") as f:
            f.write("\n".join(n for m in messages if m for n in m.names).encode())

    def abort(self, messages):
        fs, root = pafs.FileSystem.from_uri(self.path)
        if fs.get_file_info(root).type != pafs.FileType.NotFound:
            fs.delete_dir(root)


class TableSource(DataSource):
    @classmethod
    def name(cls):
        return "tidewell_table"

    def writer(self, schema, overwrite):
        return TableWriter(self.options)


#: The folders of the tables that stored() has made.
_made: list[str] = []


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """Cuts the lineage: writes df as Parquet into the shared folder and reads it back. Where pyarrow
    does not reach the folder, Spark's own writer is used."""
    spark = df.sparkSession
    path = new_path(spark, name)
    _made.append(path)
    try:
        fs, root = pafs.FileSystem.from_uri(path)
    except Exception:
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)
    spark.dataSource.register(TableSource)
    df.write.format("tidewell_table").mode("append").save(path)
    with fs.open_input_stream(f"{root}/{LISTING}") as f:
        files = f.read().decode().split()
    return spark.read.schema(df.schema).parquet(*[f"{path}/{n}" for n in files]) if files else spark.createDataFrame([], df.schema)


def drop_stored(df: DataFrame) -> None:
    """Removes the files of a table made by stored(), once nothing will read it again."""
    for f in df.inputFiles()[:1]:
        _remove(df.sparkSession, f.rsplit("/", 1)[0])


def _remove(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    if "/tidewell/" in path.toString():
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextlib.contextmanager
def noted():
    """Gives a list that holds, at the end, the folders of the tables that were stored within."""
    before, folders = len(_made), []
    yield folders
    folders += _made[before:]
    del _made[before:]


def remove(spark: SparkSession, folders: list[str]) -> None:
    """Removes noted() tables; nothing may read them any more."""
    for folder in folders:
        _remove(spark, folder)


#: The column of with_rows().
ROW = "_tidewell_row"


def with_rows(docs: DataFrame) -> DataFrame:
    """docs with ROW, a number of its own for each row. It is written, so that it stays the same however
    often it is read."""
    with arrow_rows(docs.sparkSession):
        return stored(docs.withColumn(ROW, F.monotonically_increasing_id()), "rows")


def first_of_groups(rows: DataFrame, groups: DataFrame, id_col: str, largest: bool = False) -> DataFrame:
    """rows (of with_rows) with one row of each group (ROW, group): the one with the smallest or largest id,
    of equal ids that with such a ROW. Rows without an id come after those that have one."""
    named = groups.join(rows.select(ROW, F.col(id_col).alias("_id")), ROW)
    rank = F.struct((F.col("_id").isNotNull() if largest else F.col("_id").isNull()).alias("_no"), "_id", ROW)
    kept = named.groupBy("group").agg((F.max if largest else F.min)(rank).alias("best")).select(F.col(f"best.{ROW}").alias(ROW))
    gone = stored(named.select(ROW).join(kept, ROW, "left_anti"), "gone")
    return rows.join(gone, ROW, "left_anti").drop(ROW)


def documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_bytes(text: str | Column) -> Column:
    """The UTF-8 bytes of a text; null counts as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")).cast("binary")


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


#: Rows of whole texts or sets that a Python function gets at a time.
TEXT_ROWS = 1_000
_ROWS_KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"


def whole_texts(spark: SparkSession) -> None:
    """Lets Python functions get at most TEXT_ROWS rows at a time for the rest of the session: for results that run
    later and hand rows of whole texts to Python."""
    if not 0 < int(spark.conf.get(_ROWS_KEY)) <= TEXT_ROWS:
        spark.conf.set(_ROWS_KEY, str(TEXT_ROWS))


@contextlib.contextmanager
def arrow_rows(spark: SparkSession, rows: int = TEXT_ROWS):
    """Within, Python functions get at most so many rows at a time. It counts for what runs within, so results
    have to be stored there."""
    before = spark.conf.get(_ROWS_KEY)
    spark.conf.set(_ROWS_KEY, str(rows))
    try:
        yield
    finally:
        spark.conf.set(_ROWS_KEY, before)
