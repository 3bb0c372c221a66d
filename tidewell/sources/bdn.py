"""Subtitle projects: an XML list of events with pictures in PNG."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.functions import timecode

EVENT = "_InTC string, _OutTC string, _Forced string, Graphic array<struct<_VALUE:string,_X:string,_Y:string,_Width:string,_Height:string>>"
FORMAT = "_FrameRate string, _VideoFormat string, _DropFrame string"
SIZES = ((1920, 1080), (1280, 720), (720, 576), (720, 480))


def _number(c: str) -> Column:
    return F.coalesce(F.col(c).try_cast("int"), F.lit(0))


def read_header(spark: SparkSession, path: str, any_size: bool = False) -> DataFrame:
    """One row: rate (num, den, code), width, height, drop_frame, ok. A rate that is none of the
    format's, and a size that is none unless any_size, are not ok."""
    raw = spark.read.format("xml").option("rowTag", "Format").schema(FORMAT).load(path).limit(1)
    rate = timecode.nearest_rate(timecode.parse_rate(F.col("_FrameRate")))
    size = F.split(F.lower(F.trim("_VideoFormat")), "x")
    first, second = F.get(size, F.lit(0)).try_cast("int"), F.get(size, F.lit(1)).try_cast("int")
    by_height = F.create_map(*[F.lit(x) for w, h in SIZES for x in (h, w)])
    width = F.when(F.size(size) == 2, first).otherwise(F.try_element_at(by_height, first))
    height = F.when(F.size(size) == 2, second).otherwise(first)
    told = width.isNotNull() & height.isNotNull()
    out = raw.select(rate.alias("rate"), F.when(told, width).otherwise(1920).alias("width"), F.when(told, height).otherwise(1080).alias("height"), (F.col("_DropFrame") == "true").alias("drop_frame"))
    known = F.struct("width", "height").isin(*[F.struct(F.lit(w), F.lit(h)) for w, h in SIZES])
    return out.withColumn("ok", F.col("rate").isNotNull() & (F.col("width") > 0) & (F.col("height") > 0) & (F.lit(any_size) | known))


def read_events(spark: SparkSession, path: str, nominal: int) -> DataFrame:
    """event_ord, frame_in, frame_out, forced, graphics and the box (x, y, w, h) around them. Events
    without a picture or that end before they start are dropped."""
    raw = spark.read.format("xml").option("rowTag", "Event").schema(EVENT).load(path).withColumn("event_ord", F.monotonically_increasing_id())
    part = lambda g, c: F.coalesce(g[c].try_cast("int"), F.lit(0))
    graphics = F.transform("Graphic", lambda g: F.struct(part(g, "_X").alias("x"), part(g, "_Y").alias("y"), part(g, "_Width").alias("w"), part(g, "_Height").alias("h"), F.trim(g["_VALUE"]).alias("path")))
    e = raw.select("event_ord", timecode.from_hmsf(F.col("_InTC"), nominal).alias("frame_in"), timecode.from_hmsf(F.col("_OutTC"), nominal).alias("frame_out"), (F.lower("_Forced") == "true").alias("forced"), graphics.alias("graphics"))
    e = e.filter((F.size("graphics") > 0) & (F.col("frame_in") < F.col("frame_out")))
    far = lambda a, n: F.array_max(F.transform("graphics", lambda g: g[a] + g[n]))
    near = lambda a: F.array_min(F.transform("graphics", lambda g: g[a]))
    e = e.select("*", near("x").alias("x"), near("y").alias("y"), far("x", "w").alias("_r"), far("y", "h").alias("_b"))
    return e.select("event_ord", "frame_in", "frame_out", F.coalesce("forced", F.lit(False)).alias("forced"), "graphics", "x", "y", (F.col("_r") - F.col("x")).alias("w"), (F.col("_b") - F.col("y")).alias("h"))


def overlapping_graphics(events: DataFrame) -> DataFrame:
    """Events of which two pictures overlap."""
    from tidewell.functions.geometry import overlaps

    met = F.exists("graphics", lambda a: F.size(F.filter("graphics", lambda b: overlaps(a, b))) > 1)
    return events.filter(met)


def normal_path(path: Column) -> Column:
    """A path with / between its parts and without parts that go nowhere: "." and a part before "..", of names
    that the folder of the project does not hold."""
    parts = F.filter(F.split(F.translate(path, "\\", "/"), "/"), lambda p: (p != "") & (p != "."))
    step = lambda done, p: F.when((p == "..") & (F.size(done) > 0), F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).when(p == "..", done).otherwise(F.concat(done, F.array(p)))
    return F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")


def place(path: Column, folder: str) -> Column:
    """Where a picture of a project is, relative to the folder of its pictures: paths are told relative to the XML, so
    they may begin with the name of that folder."""
    own, name = normal_path(path), folder.rstrip("/").rsplit("/", 1)[-1]
    return F.when(F.startswith(own, F.lit(name + "/")), F.substr(own, F.lit(len(name) + 2))).otherwise(own)


def read_images(spark: SparkSession, folder: str) -> DataFrame:
    """(path, width, height, data, channels) of the PNG files in a folder and those in it; path is relative to it, data
    is BGR or BGRA. What is no picture is left out; pruning data leaves only sizes to read."""
    image = spark.read.format("image").option("dropInvalid", True).option("recursiveFileLookup", True).load(folder)
    origin = F.url_decode(F.regexp_replace("image.origin", r"\+", "%2B"))
    name = folder.rstrip("/").rsplit("/", 1)[-1]
    inside = F.element_at(F.split(origin, "/" + re.escape(name) + "/", 2), -1)
    return image.select(inside.alias("path"), F.col("image.width").alias("width"), F.col("image.height").alias("height"), F.col("image.data").alias("data"), F.col("image.nChannels").alias("channels"))


def rejected_images(events: DataFrame, images: DataFrame, folder: str = "") -> DataFrame:
    """(event_ord, path): pictures of several in an event that are not as large as told or missing, and
    single ones that are smaller than told. A single picture may be missing."""
    g = events.select("event_ord", F.size("graphics").alias("_n"), F.explode("graphics").alias("g"))
    joined = g.join(images.select(F.col("path").alias("name"), "width", "height"), place(F.col("g.path"), folder) == F.col("name"), "left")
    w, h = F.col("g.w"), F.col("g.h")
    bad = F.when(F.col("_n") > 1, F.col("width").isNull() | (F.col("width") != w) | (F.col("height") != h)).otherwise((F.col("width") < w) | (F.col("height") < h))
    return joined.filter(F.coalesce(bad, F.lit(False))).select("event_ord", F.col("g.path").alias("path"))


def with_pictures(events: DataFrame, images: DataFrame, folder: str = "") -> DataFrame:
    """A row for each event and picture: the event's columns, at (x and y in the event's box) and data."""
    g = events.withColumn("g", F.explode("graphics")).withColumn("path", place(F.col("g.path"), folder)).drop("graphics")
    return g.join(images, "path", "left").withColumn("at_x", F.col("g.x") - F.col("x")).withColumn("at_y", F.col("g.y") - F.col("y"))


def rgba(data: bytes, width: int, height: int, channels: int) -> np.ndarray:
    """The pixels of a row of the image source."""
    a = np.frombuffer(data, np.uint8).reshape(height, width, channels)
    if channels == 1:
        a = np.repeat(a, 3, 2)
    alpha = a[..., 3:4] if a.shape[2] == 4 else np.full((height, width, 1), 255, np.uint8)
    return np.concatenate([a[..., 2::-1], alpha], 2)
