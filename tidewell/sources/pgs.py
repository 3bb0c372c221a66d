"""Graphic-subtitle streams as a data source ("pgs"), and their writers.

format("pgs") gives a row for each segment of the files at a path; option view=status gives a row
for each file instead. mode=STRICT (default) stops a file at lost sync or truncation and says so
in its status, mode=PERMISSIVE skips the check of the magic. Files are packed into partitions by
size; a file is never split, as segments can only be found from its start on.
"""

from __future__ import annotations

import contextlib
import struct
import uuid
from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema

from tidewell.sources import codec
from tidewell.sources.storage import listed, locate, packed

BOX = "x int, y int, w int, h int"
SEGMENTS = (
    "file string, seg_ord bigint, byte_off bigint, type smallint, type_name string, pts bigint, dts bigint, size int, payload binary, "
    f"pcs struct<width:int,height:int,fps:int,number:int,state:int,pal_flag:boolean,pal_id:int,n_objects:int,objects:array<struct<o_id:int,window_id:int,forced:boolean,x:int,y:int,crop:struct<{BOX.replace(' ', ':').replace(',:', ',')}>>>>, "
    "wds array<struct<window_id:int,x:int,y:int,w:int,h:int>>, pds struct<id:int,version:int,entries:map<int,struct<y:int,cr:int,cb:int,a:int>>>, "
    "ods struct<o_id:int,version:int,seq:int,rle_len:int,w:int,h:int,data:binary>"
)
STATUS = "file string, errors array<string>, trailing_bytes bigint, missing_final_ends boolean, segments bigint"
PARTITION_BYTES = 32 << 20
#: Clock offset and tail of the index beside an elementary stream; fixed values of the format.
INDEX_OFFSET, INDEX_TAIL = 54_000_000, b"\xff" + bytes(13)


def segment_row(file: str, n: int, found: tuple) -> dict:
    at, pts, dts, kind, payload = found
    row = {"file": file, "seg_ord": n, "byte_off": at, "type": kind, "type_name": codec.NAMES.get(kind, "UNKNOWN"), "pts": pts, "dts": dts, "size": len(payload), "payload": payload, "pcs": None, "wds": None, "pds": None, "ods": None}
    if kind == codec.COMPOSITION:
        row["pcs"] = codec.decode_composition(payload)
    elif kind == codec.WINDOWS:
        row["wds"] = codec.decode_windows(payload)
    elif kind == codec.PALETTE:
        pds = codec.decode_palette(payload)
        row["pds"] = pds and pds | {"entries": [*pds["entries"].items()]}
    elif kind == codec.OBJECT:
        row["ods"] = codec.decode_object(payload)
    return row


def parsed(segments: DataFrame) -> DataFrame:
    """Segments (file, seg_ord, type, pts, dts, payload) with all the columns that reading a stream gives; where they
    stand in it is not known."""

    def parse(batches):
        for batch in batches:
            rows = [segment_row(r["file"], r["seg_ord"], (None, r["pts"], r["dts"], r["type"] & 0xFF, bytes(r["payload"] or b""))) for r in batch.to_pylist()]
            yield pa.RecordBatch.from_pylist(rows, to_arrow_schema(schema))

    schema = segments.sparkSession.createDataFrame([], SEGMENTS).schema
    return segments.select("file", "seg_ord", "type", "pts", "dts", "payload").mapInArrow(parse, schema)


@dataclass
class Streams(InputPartition):
    files: tuple[str, ...]

    def __init__(self, files):
        super().__init__(None)
        self.files = files


class PgsReader(DataSourceReader):
    def __init__(self, schema, options):
        from pyspark.sql.pandas.types import to_arrow_schema

        self.path, self.status = options["path"], options.get("view") == "status"
        self.strict = options.get("mode", "STRICT").upper() != "PERMISSIVE"
        self.bytes = int(options.get("partitionBytes", PARTITION_BYTES))
        self.arrow = to_arrow_schema(schema)

    def partitions(self):
        files = listed(self.path, (".sup", ".pgs"))
        # A path without a file is reported like one that cannot be read.
        return [Streams(g) for g in packed(files, self.bytes)] or [Streams((self.path,) if self.status else ())]

    def read(self, partition):
        fs, _ = locate(self.path)
        rows, size = [], 0
        for file in partition.files:
            try:
                with fs.open_input_file(file) as f:
                    data = f.read()
                error = None if data else "empty file"
            except OSError as e:
                data, error = b"", f"cannot read: {e}"
            found, end, problem = codec.scanned(data, self.strict)
            if self.status:
                errors = [x for x in (error, problem if self.strict else None) if x]
                rows.append({"file": file, "errors": errors, "trailing_bytes": len(data) - end, "missing_final_ends": bool(found) and found[-1][3] != codec.END, "segments": len(found)})
                continue
            for n, x in enumerate(found):
                rows.append(segment_row(file, n, x))
                size += 2 * len(x[4]) + 300
                if size > 4 << 20:
                    yield pa.RecordBatch.from_pylist(rows, self.arrow)
                    rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, self.arrow)


class PgsDataSource(DataSource):
    @classmethod
    def name(cls):
        return "pgs"

    def schema(self):
        return STATUS if self.options.get("view") == "status" else SEGMENTS

    def reader(self, schema):
        return PgsReader(schema, self.options)


def read_segments(spark: SparkSession, path: str, mode: str = "STRICT") -> DataFrame:
    spark.dataSource.register(PgsDataSource)
    return spark.read.format("pgs").option("mode", mode).load(path)


def read_status(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(PgsDataSource)
    return spark.read.format("pgs").option("view", "status").load(path)


def whole_display_sets(segments: DataFrame) -> DataFrame:
    """The segments up to the last END of each file: sets close at END only, and what follows the
    last one is dropped."""
    last = segments.filter(F.col("type") == codec.END).groupBy("file").agg(F.max("seg_ord").alias("_last"))
    return segments.join(last, "file").filter("seg_ord <= _last").drop("_last")


def stream_format(segments: DataFrame) -> DataFrame:
    """(file, width, height, fps code) from the first segment, or 1920 x 1080 at 24 if that is none
    that tells."""
    first = segments.filter("seg_ord = 0")
    return first.select("file", F.coalesce("pcs.width", F.lit(1920)).alias("width"), F.coalesce("pcs.height", F.lit(1080)).alias("height"), F.coalesce("pcs.fps", F.lit(0x20)).alias("fps"))


@contextlib.contextmanager
def _created(overwrite: bool, *paths: str):
    """Streams to files that appear under their names all together, when all is written; a failure leaves nothing.
    Without overwrite none of them may be there before."""
    places = [locate(p) for p in paths]
    for path, (fs, root) in zip(paths, places):
        if not overwrite and fs.get_file_info(root).is_file:
            raise FileExistsError(path)
    mark = f".{uuid.uuid4().hex}.part"
    streams = [fs.open_output_stream(root + mark, compression=None) for fs, root in places]
    try:
        yield streams
    except BaseException:
        for stream, (fs, root) in zip(streams, places):
            stream.close()
            fs.delete_file(root + mark)
        raise
    for stream, (fs, root) in zip(streams, places):
        stream.close()
        fs.move(root + mark, root)


def write_sup(segments: DataFrame, path: str, order: list[str] = ["seg_ord"], overwrite: bool = False, told: Callable[[bytes], None] = lambda segment: None) -> int:  # noqa: B006
    """Writes one stream file in order; returns the number of segments. A stream is one ordered file,
    so the driver appends to it, a partition of the sorted rows at a time; told gets each segment."""
    count = 0
    with _created(overwrite, path) as (f,):
        for r in segments.orderBy(*order).select("type", "pts", "dts", "payload").toLocalIterator():
            segment = codec.segment(r.type & 0xFF, r.pts, r.dts, bytes(r.payload or b""))
            f.write(segment)
            told(segment)
            count += 1
    return count


def index_entry(kind: int, size: int, pts: int, dts: int) -> bytes:
    """14 bytes: type, length + 3, then the shifted clocks as one number of 72 bits."""
    clocks = (((dts + INDEX_OFFSET) & (1 << 33) - 1) << 39) | (((pts + INDEX_OFFSET) & (1 << 33) - 1) << 6)
    return struct.pack(">BI", kind, size + 3) + clocks.to_bytes(9, "big")


def write_elementary(segments: DataFrame, path: str, index_path: str, order: list[str] = ["seg_ord"], overwrite: bool = False) -> int:  # noqa: B006
    """Writes segments without clocks to path and their index to index_path."""
    count = 0
    with _created(overwrite, path, index_path) as (f, g):
        g.write(b"\0\0\0\3")
        for r in segments.orderBy(*order).select("type", "pts", "dts", "payload").toLocalIterator():
            payload = bytes(r.payload or b"")
            f.write(struct.pack(">BH", r.type & 0xFF, len(payload)) + payload)
            g.write(index_entry(r.type & 0xFF, len(payload), r.pts, r.dts))
            count += 1
        g.write(INDEX_TAIL)
    return count
