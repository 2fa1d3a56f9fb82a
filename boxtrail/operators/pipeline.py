"""Whole chains: model outputs of tiles to the detections of frames, a caller's scorer, and what tracks know of classes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxtrail.config import DetectorConfig, PipelineConfig, require_columns
from boxtrail.functions import labels as lb
from boxtrail.operators import analytics, assign, decode, pairs, suppress, tiles

PREDICTIONS = "frame_id long, query_id int, cx double, cy double, w double, h double, logits array<double>"

_SCORERS: dict[str, Callable[..., Callable[[pd.DataFrame], pd.DataFrame]]] = {}


def register_scorer(name: str, make: Callable[..., Callable[[pd.DataFrame], pd.DataFrame]]) -> None:
    """make(**options) gives a function from a batch of frames to a batch of PREDICTIONS."""
    _SCORERS[name] = make


def score_frames(frames: DataFrame, scorer: str, schema: str = PREDICTIONS, **options) -> DataFrame:
    """Model outputs by a registered scorer, a batch at a time; it is made once in each task."""
    make = _SCORERS[scorer]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        score = make(**options)
        for batch in batches:
            yield score(batch)

    return frames.mapInPandas(run, schema)


def detect(predictions: DataFrame, labels: DataFrame, width: int, height: int, detector: DetectorConfig = DetectorConfig(), config: PipelineConfig = PipelineConfig()) -> DataFrame:
    """predictions (stream_id, frame_id, tile_idx, query_id, cx, cy, w, h, logits) as detections of frames: decoded,
    filtered by confidence and class, moved from tiles to the frame, named."""
    require_columns(predictions, "stream_id", "frame_id", "tile_idx", "query_id", "cx", "cy", "w", "h", "logits")
    found = decode.decode(predictions.withColumn("frame_id", F.struct("stream_id", "frame_id", "tile_idx")), detector.input_width, detector.input_height, detector.confidence, config.classes)
    found = found.select("frame_id.stream_id", "frame_id.frame_id", "frame_id.tile_idx", "query_id", "class_id", "confidence", "x", "y", "w", "h")
    grid = tiles.tile_grid(predictions.sparkSession.createDataFrame([(width, height)], "width int, height int"), config.tile, config.overlap)
    out = tiles.to_frame(found, grid, config.tile)
    out = lb.with_names(out, labels).withColumn("class_name", lb.capitalized(F.col("class_name")))
    out = out.withColumn("det_id", F.col("tile_idx").cast("long") * 1_000_000 + F.col("query_id"))
    if detector.max_detections is not None:
        out = analytics.top_k(out, ("stream_id", "frame_id"), detector.max_detections).drop("rank")
    return out


def detect_and_clean(predictions: DataFrame, labels: DataFrame, width: int, height: int, detector: DetectorConfig = DetectorConfig(), config: PipelineConfig = PipelineConfig()) -> DataFrame:
    """detect(), then suppression and removal of nested boxes."""
    return suppress.postprocess(detect(predictions, labels, width, height, detector, config), config.iou_threshold, config.nested_padding)


def enrich(tracks: DataFrame, detections: DataFrame, threshold: float = 0.3, method: str = "min") -> DataFrame:
    """tracks (stream_id, frame_id, det_id, boxes) with class and confidence of the detection that a second assignment
    by overlap gives them, of least cost (any method of assign.solve); null where none does."""
    near = pairs.pair_join(tracks, detections)
    got = assign.greedy_pairs(near, threshold) if method == "greedy" else assign.best_pairs(near, threshold, method)
    known = detections.select("stream_id", "frame_id", F.col("det_id").alias("r_id"), F.col("class_id").alias("_class"), F.col("confidence").alias("_confidence"))
    found = got.join(known, ["stream_id", "frame_id", "r_id"]).select("stream_id", "frame_id", F.col("l_id").alias("det_id"), "_class", "_confidence")
    keep = [c for c in tracks.columns if c not in ("class_id", "confidence")]
    return tracks.select(*keep).join(found, ["stream_id", "frame_id", "det_id"], "left").withColumnsRenamed({"_class": "class_id", "_confidence": "confidence"})


def overlay(tracks: DataFrame) -> DataFrame:
    """The line that a video's frame shows."""
    out = tracks.groupBy("stream_id", "frame_id").agg(F.countDistinct("track_id").alias("tracks"), F.max(F.col("det_id").isNotNull().cast("int")).alias("ran"))
    from pyspark.sql import Window

    runs = F.sum("ran").over(Window.partitionBy("stream_id").orderBy("frame_id").rowsBetween(Window.unboundedPreceding, 0))
    return out.select("stream_id", "frame_id", F.format_string("Frame: %d # Tracks: %d # Runs: %d", "frame_id", "tracks", runs).alias("line"))


def count_by_suffix(files: DataFrame, path: str = "path") -> DataFrame:
    return files.groupBy(F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1)).alias("suffix")).agg(F.count("*").alias("n"))
