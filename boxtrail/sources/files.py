"""Files: pictures and raw buffers, label lines, scene metadata and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a pixel by format (fixed values).
CHANNELS = {"rgb": 3, "bgr": 3, "rgba": 4, "bgra": 4, "gray": 1}


def pictures(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, content) of pictures below a folder that aren't empty."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{jpg,jpeg,png}").load(path).where("length > 0").select("path", "length", "content")


def valid_buffer(data: Column, width: Column, height: Column, pixel: Column) -> Column:
    """Whether a raw buffer has width * height * channels bytes."""
    channels = F.element_at(F.create_map(*[F.lit(x) for kv in CHANNELS.items() for x in kv]), F.lower(pixel))
    return F.length(data) == width * height * channels


def label_line(frame_w: Column, frame_h: Column) -> Column:
    """`class cx cy w h`, shares of the frame with six digits, of columns class_id, x, y, w, h."""
    x, y, w, h = (F.col(c) for c in "xywh")
    shares = (x + w / 2) / frame_w, (y + h / 2) / frame_h, w / frame_w, h / frame_h
    return F.format_string("%d %.6f %.6f %.6f %.6f", "class_id", *[F.bround(c, 6) for c in shares])


def write_label_lines(detections: DataFrame, frame_w: int, frame_h: int, path: str) -> None:
    """A folder of text for each frame."""
    detections.select("stream_id", "frame_id", label_line(F.lit(frame_w), F.lit(frame_h)).alias("value")).write.partitionBy("stream_id", "frame_id").text(path)


def read_label_lines(spark: SparkSession, path: str) -> DataFrame:
    part = F.split("value", " ")
    return spark.read.text(path).select(*[c for c in ("stream_id", "frame_id") if c in spark.read.text(path).columns], part[0].cast("int").alias("class_id"), *[part[i + 1].cast("double").alias(c) for i, c in enumerate(("cx", "cy", "w", "h"))])


def write_scenes(detections: DataFrame, path: str) -> None:
    """A JSON line for each frame with its annotations."""
    note = F.struct(F.col("class_id").alias("class"), F.array(*"xywh").alias("bbox"))
    detections.groupBy("stream_id", "frame_id").agg(F.collect_list(note).alias("annotations")).write.json(path)


def read_scenes(spark: SparkSession, path: str) -> DataFrame:
    schema = "stream_id long, frame_id long, annotations array<struct<class:long,bbox:array<double>>>"
    rows = spark.read.schema(schema).json(path).select("stream_id", "frame_id", F.explode("annotations").alias("a"))
    return rows.select("stream_id", "frame_id", F.col("a.class").alias("class_id"), *[F.col("a.bbox")[i].alias(c) for i, c in enumerate("xywh")])


def write_report(summary: DataFrame, path: str) -> None:
    summary.select(F.to_json(F.struct("*")).alias("value")).write.text(path)
