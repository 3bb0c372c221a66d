"""WARC archives as a Python data source ("warc"), for reading and writing.

Reading: the driver lists the archives and packs files into partitions by size. Equality, IN and
prefix predicates on the header columns and comparisons of content_length are pushed down; a
record's headers are parsed first, and the block of a record that a predicate rejects, or of any
record under the option payload=false, is skipped: by seeking in plain files and where the
gzip member says how long it is, else by inflating without decoding. An archive that is cut off or damaged
raises an error; under the option mode=permissive its records before that place are read.

Writing: a record per row, a gzip member per record with its length in the member's extra field
("SL"), in files of about maxFileBytes. Tasks write in place; commit lists the files of the attempts that
Spark accepted in a file of the job's own and removes those of others. Where there are such lists, only
files that they name are read.

Paths are URIs that pyarrow.fs opens (file, hdfs, s3, gs) or absolute paths.
"""

from __future__ import annotations

import io
import struct
import uuid
import zlib
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, StringStartsWith, WriterCommitMessage

from tidewell.llm.common import stored

#: Columns that are headers, in WARC's spelling.
HEADERS = {
    "warc_type": "WARC-Type", "record_id": "WARC-Record-ID", "warc_date": "WARC-Date", "target_uri": "WARC-Target-URI",
    "refers_to": "WARC-Refers-To", "payload_digest": "WARC-Payload-Digest", "content_type": "Content-Type", "payload_length": "X-Payload-Length",
}
SCHEMA = ", ".join(f"{c} {'long' if c == 'payload_length' else 'string'}" for c in HEADERS) + ", content_length long, payload binary, file string, offset long"
_ARROW = pa.schema([(c, pa.int64() if c == "payload_length" else pa.string()) for c in HEADERS] + [("content_length", pa.int64()), ("payload", pa.binary()), ("file", pa.string()), ("offset", pa.int64())])
PARTITION_BYTES = 32 << 20
FILE_BYTES = 64 << 20
#: Start of the name of a job's list of files.
LISTED = "_files-"
#: Payloads that are there more than once are broadcast (digest and id) up to this many, else joined.
BROADCAST_FIRST = 500_000
BATCH_BYTES = 8 << 20


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path)


def member(record: bytes, level: int = 6) -> bytes:
    """A gzip member with the extra field SL: its own length and that of the record."""
    squeeze = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = squeeze.compress(record) + squeeze.flush()
    size = 12 + 20 + len(body) + 8
    return struct.pack("<4BI2BH2sHQQ", 31, 139, 8, 4, 0, 0, 255, 20, b"SL", 16, size, len(record)) + body + struct.pack("<II", zlib.crc32(record), len(record) & 0xFFFFFFFF)


def parse_headers(block: bytes) -> dict[str, str]:
    """Names in lower case; folded lines are joined; the first of repeated names counts."""
    out: dict[str, str] = {}
    last = None
    for line in block.split(b"\r\n")[1:]:
        text = line.decode("utf-8", "replace")
        if text[:1] in (" ", "\t") and last:
            out[last] += " " + text.strip()
        elif ":" in text:
            name, value = text.split(":", 1)
            last = name.strip().lower()
            out.setdefault(last, value.strip())
    return out


def http_payload(block: bytes) -> bytes:
    at = block.find(b"\r\n\r\n")
    return block[at + 4 :] if block.startswith(b"HTTP/") and at >= 0 else block


class _Plain:
    """Records of an uncompressed archive of so many bytes."""

    def __init__(self, f: io.BufferedReader, size: int):
        self.f, self.size = f, size

    def __iter__(self):
        while True:
            at = self.f.tell()
            head = bytearray()
            while not head.endswith(b"\r\n\r\n"):
                line = self.f.readline()
                if not line and head:
                    raise ValueError(f"the record at {at} is cut off")
                if not line:
                    return
                if head or line.strip():
                    head += line
                else:
                    at += len(line)
            headers = parse_headers(bytes(head))
            size = int(headers.get("content-length", 0))
            begin = self.f.tell()
            if begin + size > self.size:
                raise ValueError(f"the record at {at} is cut off")
            yield at, headers, lambda n=size: self.f.read(n)
            self.f.seek(begin + size)


class _Member:
    """A gzip member that is inflated as far as it is asked for."""

    def __init__(self, f: io.BufferedReader, at: int, first: bytes):
        self.f, self.at, self.known, self.length = f, at, None, None
        if len(first) < 12 or first[:3] != b"\x1f\x8b\x08":
            raise ValueError(f"no gzip member at {at}")
        flags = first[3]
        if flags & 4:
            extra = f.read(struct.unpack("<H", first[10:12])[0])
            if extra[:2] == b"SL" and len(extra) >= 20:
                self.known, self.length = struct.unpack_from("<QQ", extra, 4)
        else:
            f.seek(at + 10)
        for bit in (8, 16):
            if flags & bit:
                while f.read(1) not in (b"\0", b""):
                    pass
        if flags & 2:
            f.read(2)
        self.unpack, self.fed, self.data, self.used, self.check = zlib.decompressobj(-15), b"", bytearray(), 0, 0

    def more(self) -> bool:
        while not self.unpack.eof:
            raw = self.fed or self.f.read(1 << 12 if not self.used else 1 << 16)
            if not raw:
                raise ValueError(f"the member at {self.at} is cut off")
            found = self.unpack.decompress(raw, 1 << 18)
            self.fed = self.unpack.unconsumed_tail
            if found:
                self.check = zlib.crc32(found, self.check)
                self.data += found
                return True
        return False

    def head(self) -> bytes | None:
        """The headers of the next record; None at the member's end."""
        while True:
            blank = len(self.data) - len(self.data.lstrip(b"\r\n"))
            self.drop(blank)
            cut = self.data.find(b"\r\n\r\n")
            if cut >= 0:
                out = bytes(self.data[: cut + 4])
                self.drop(cut + 4)
                return out
            if not self.more():
                if self.data:
                    raise ValueError(f"a record of the member at {self.at} is cut off")
                return None

    def drop(self, n: int) -> None:
        del self.data[:n]
        self.used += n

    def block(self, size: int, keep: bool) -> bytes:
        parts, left = [], size
        while left:
            if not self.data and not self.more():
                raise ValueError(f"a record of the member at {self.at} is cut off")
            n = min(left, len(self.data))
            if keep:
                parts.append(bytes(self.data[:n]))
            self.drop(n)
            left -= n
        return b"".join(parts)

    def end(self) -> None:
        """Goes to where the next member starts. All of this one has been inflated."""
        self.f.seek(self.f.tell() - len(self.unpack.unused_data))
        trailer = self.f.read(8)
        if len(trailer) < 8 or struct.unpack("<I", trailer[:4])[0] != self.check:
            raise ValueError(f"the member at {self.at} is damaged")


class _Gzip:
    """Records of an archive of gzip members, of one record or several. The offset is that of the member."""

    def __init__(self, f: io.BufferedReader, size: int):
        self.f, self.size = f, size

    def __iter__(self):
        while True:
            at = self.f.tell()
            first = self.f.read(12)
            if not first.strip(b"\0"):
                return
            member = _Member(self.f, at, first)
            while (head := member.head()) is not None:
                headers = parse_headers(head)
                size = int(headers.get("content-length", 0))
                state = [False]

                def block(size=size, member=member, state=state) -> bytes:
                    state[0] = True
                    return member.block(size, True)

                yield at, headers, block
                if member.known is not None and len(head) + size + 4 == member.length:
                    if at + member.known > self.size:
                        raise ValueError(f"the member at {at} is cut off")
                    self.f.seek(at + member.known)
                    break
                if not state[0]:
                    member.block(size, False)
            else:
                member.end()


def _value(headers: dict[str, str], column: str):
    if column == "content_length":
        return int(headers.get("content-length", 0))
    x = headers.get(HEADERS[column].lower())
    return int(x) if column == "payload_length" and x and x.isdigit() else None if column == "payload_length" else x


def _holds(f, headers: dict[str, str]) -> bool:
    x = _value(headers, f.attribute[0])
    if x is None:
        return False
    if isinstance(f, In):
        return x in f.value
    tests = {EqualTo: lambda: x == f.value, StringStartsWith: lambda: x.startswith(f.value), GreaterThan: lambda: x > f.value, GreaterThanOrEqual: lambda: x >= f.value, LessThan: lambda: x < f.value, LessThanOrEqual: lambda: x <= f.value}
    return tests[type(f)]()


@dataclass
class Archives(InputPartition):
    files: tuple[str, ...]

    def __init__(self, files):
        super().__init__(None)
        self.files = files


class WarcReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.payload = options.get("payload", "true").lower() == "true"
        self.bytes = int(options.get("partitionBytes", PARTITION_BYTES))
        self.permissive = options.get("mode", "failfast").lower() == "permissive"
        self.filters: list = []

    def pushFilters(self, filters):
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            numbers = column in ("content_length", "payload_length")
            if column in (*HEADERS, "content_length") and (isinstance(f, (EqualTo, In)) or isinstance(f, StringStartsWith) and not numbers or numbers and isinstance(f, (GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual))):
                self.filters.append(f)
            else:
                yield f

    def partitions(self):
        fs, root = file_system(self.path)
        info = fs.get_file_info(root)
        found = [info] if info.is_file or info.type == pafs.FileType.NotFound else fs.get_file_info(pafs.FileSelector(root, recursive=True))
        lists = [x.path for x in found if x.is_file and x.path.rsplit("/", 1)[1].startswith(LISTED)]
        if lists:
            named = {f"{p.rsplit('/', 1)[0]}/{n}" for p in lists for n in _listed(fs, p)}
            found = [x for x in found if x.path in named]
        files = sorted((x.path, x.size) for x in found if x.is_file and x.path.endswith((".warc", ".warc.gz")) and "/_" not in x.path[len(root) :])
        packed, now, size = [], [], 0
        for path, n in files:
            if now and size + n > self.bytes:
                packed.append(Archives(tuple(now)))
                now, size = [], 0
            now.append(path)
            size += n
        return [*packed, Archives(tuple(now))]

    def read(self, partition):
        fs, _ = file_system(self.path)
        rows, size = [], 0
        for path in partition.files:
            with fs.open_input_file(path) as raw, io.BufferedReader(raw, 1 << 18) as f:
                records = iter((_Gzip if path.endswith(".gz") else _Plain)(f, raw.size()))
                while True:
                    try:
                        at, headers, block = next(records)
                        if not all(_holds(x, headers) for x in self.filters):
                            continue
                        payload = http_payload(block()) if self.payload else None
                    except StopIteration:
                        break
                    except (ValueError, zlib.error) as e:
                        if self.permissive:
                            break
                        raise ValueError(f"{path}: {e}") from e
                    rows.append([*(_value(headers, c) for c in HEADERS), _value(headers, "content_length"), payload, path, at])
                    size += len(payload or b"") + 500
                    if size > BATCH_BYTES:
                        yield self._batch(rows)
                        rows, size = [], 0
        if rows:
            yield self._batch(rows)

    @staticmethod
    def _batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW)], schema=_ARROW)


def _listed(fs, path: str) -> list[str]:
    with fs.open_input_stream(path) as f:
        return f.read().decode().split()


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options, overwrite):
        self.path, self.overwrite = options["path"].rstrip("/"), overwrite
        self.most = int(options.get("maxFileBytes", FILE_BYTES))
        self.gzip = options.get("compression", "gzip") == "gzip"
        self.job = uuid.uuid4().hex

    def write(self, iterator):
        fs, root = file_system(self.path)
        fs.create_dir(root, recursive=True)
        files, out, size = [], None, 0
        try:
            for batch in iterator:
                for row in batch.to_pylist():
                    if out is None:
                        files.append(f"part-{self.job}-{uuid.uuid4().hex}.warc{'.gz' * self.gzip}")
                        out, size = fs.open_output_stream(f"{root}/{files[-1]}", compression=None), 0
                    record = record_bytes(row)
                    record = member(record) if self.gzip else record
                    out.write(record)
                    size += len(record)
                    if size >= self.most:
                        out.close()
                        out = None
        finally:
            if out is not None:
                out.close()
        return Written(files)

    def commit(self, messages):
        fs, root = file_system(self.path)
        fs.create_dir(root, recursive=True)
        files = [f for m in messages if m for f in m.files]
        self._clean(fs, root, {*files})
        with fs.open_output_stream(f"{root}/{LISTED}{self.job}") as f:
            f.write("\n".join(files).encode())

    def abort(self, messages):
        fs, root = file_system(self.path)
        if fs.get_file_info(root).type != pafs.FileType.NotFound:
            self._clean(fs, root, set(), everything=False)

    def _clean(self, fs, root: str, kept: set[str], everything: bool = True) -> None:
        """Removes what other attempts of this job have left and, to overwrite, all files of before."""
        for x in fs.get_file_info(pafs.FileSelector(root)):
            name = x.path.rsplit("/", 1)[1]
            if x.is_file and name not in kept and (name.startswith(f"part-{self.job}-") or self.overwrite and everything):
                fs.delete_file(x.path)


def record_bytes(row: dict) -> bytes:
    """A record of a row with header columns and payload. A response wraps its payload in an HTTP
    answer; any other type has the payload as its block, a revisit usually none."""
    payload = row.get("payload") or b""
    block = payload
    if row["warc_type"] == "response":
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload
    lines = ["WARC/1.1"]
    for c, name in HEADERS.items():
        if row.get(c) is not None:
            lines.append(f"{name}: {' '.join(str(row[c]).split())}")
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class WarcDataSource(DataSource):
    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(self.options)

    def writer(self, schema, overwrite):
        return WarcWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)


def read_warc(spark: SparkSession, path: str, payload: bool = True, mode: str = "failfast") -> DataFrame:
    """The records of the archives (.warc, .warc.gz) at path, a file or a folder with subfolders; see SCHEMA.
    Headers that a record lacks are null. An empty folder or a path that is not there gives no rows."""
    register(spark)
    return spark.read.format("warc").option("payload", str(payload).lower()).option("mode", mode).load(path)


def archive(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 100) -> None:
    """Writes a record per row. Of rows with equal payloads of at least `least` bytes the one with
    the smallest id is the response and the others revisit it; rows that repeat that id, and all
    shorter payloads, are responses. A null payload is an empty one, a null url is left out, rows
    without an id are revisits of the smallest id or, if none has one, responses. The id goes into
    the record's id as urn:record:<id>. Payloads may be of any length, an empty table gives no archive, and
    no other column is read."""
    register(pages.sparkSession)
    payload = F.coalesce(html_col, F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256)).withColumn("n", F.length("payload").cast("long"))
    first = rows.filter(F.col("n") >= least).groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("m")).filter("m > 1")
    first = stored(first.select("digest", "first"))
    # Up to BROADCAST_FIRST no payload moves; beyond it the join splits a digest that many rows have.
    told = rows.join(F.broadcast(first) if first.count() <= BROADCAST_FIRST else first, "digest", "left")
    revisit = F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    urn = lambda c: F.when(F.col(c).isNotNull(), F.concat(F.lit("<urn:record:"), F.col(c).cast("string"), F.lit(">")))
    told.select(
        F.when(revisit, "revisit").otherwise("response").alias("warc_type"), urn("id").alias("record_id"), F.lit("2000-01-01T00:00:00Z").alias("warc_date"), F.col("url").alias("target_uri"),
        F.when(revisit, urn("first")).alias("refers_to"), F.concat(F.lit("sha256:"), "digest").alias("payload_digest"), F.lit("application/http; msgtype=response").alias("content_type"), F.col("n").alias("payload_length"),
        F.when(~revisit, F.col("payload")).alias("payload"),
    ).write.format("warc").mode("append").save(path)


def archived(spark: SparkSession, path: str, id_type: str = "long") -> DataFrame:
    """The records of archives that archive() wrote: id, payload_bytes, payload_digest, record_type,
    refers_to. A response's length and digest are taken from its payload, a revisit's from its
    headers. Records of other types are skipped by their headers; every archive is read once."""
    number = lambda c: F.regexp_extract(c, r"^<urn:record:(.*)>$", 1)
    as_id = lambda c: F.when(F.col(c).isNotNull(), number(c)).cast(id_type)
    payload = F.col("warc_type") == "response"
    length, digest = F.length("payload").cast("long"), F.sha2("payload", 256)
    return read_warc(spark, path).filter(F.col("warc_type").isin("response", "revisit")).select(
        as_id("record_id").alias("id"), F.when(payload, length).otherwise(F.col("payload_length")).alias("payload_bytes"),
        F.when(payload, digest).otherwise(F.regexp_replace("payload_digest", "^sha256:", "")).alias("payload_digest"),
        F.col("warc_type").alias("record_type"), F.when(~payload, as_id("refers_to")).alias("refers_to"),
    )
