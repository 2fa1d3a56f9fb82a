"""Tiles of a frame, and detections of tiles in the coordinates of their frame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _starts(size: Column, tile: int, overlap: int) -> Column:
    """Where tiles begin along an axis: steps of tile - overlap, the last one flush with the edge."""
    stride = max(tile - overlap, 1)
    more = F.ceil((size - tile) / stride).cast("int")
    steps = F.transform(F.sequence(F.lit(0), more), lambda i: F.least(i * stride, size - tile))
    return F.when(size <= tile, F.array(F.lit(0))).otherwise(steps)


def tile_grid(frames: DataFrame, tile: int = 640, overlap: int = 64) -> DataFrame:
    """(width, height, tile_idx, offset_x, offset_y) for each size in frames (width, height): tiles in order of x, then y."""
    xy = frames.select(F.col("width").cast("int").alias("width"), F.col("height").cast("int").alias("height")).distinct()
    xs, ys = F.array_sort(F.array_distinct(_starts(F.col("width"), tile, overlap))), F.array_sort(F.array_distinct(_starts(F.col("height"), tile, overlap)))
    both = F.flatten(F.transform(xs, lambda x: F.transform(ys, lambda y: F.struct(x.alias("x"), y.alias("y")))))
    return xy.select("width", "height", F.posexplode(both).alias("tile_idx", "t")).select("width", "height", "tile_idx", F.col("t.x").alias("offset_x"), F.col("t.y").alias("offset_y"))


def to_frame(detections: DataFrame, tiles: DataFrame, tile: int = 640) -> DataFrame:
    """detections in shares of a tile (tile_idx, x, y, w, h) as pixels of the frame. tiles: the grid of one frame size,
    a few rows by construction."""
    out = detections.join(F.broadcast(tiles.select("tile_idx", "offset_x", "offset_y")), "tile_idx")
    return out.withColumns({"x": F.col("x") * tile + F.col("offset_x"), "y": F.col("y") * tile + F.col("offset_y"), "w": F.col("w") * tile, "h": F.col("h") * tile}).drop("offset_x", "offset_y")


def extract(tiles: DataFrame, tile: int = 640) -> DataFrame:
    """The part of the frame that each tile copies, and how much of it is padding at the right and lower edges."""
    w, h = F.least(F.lit(tile), F.col("width") - F.col("offset_x")), F.least(F.lit(tile), F.col("height") - F.col("offset_y"))
    return tiles.withColumns({"copy_w": w, "copy_h": h, "pad_w": F.lit(tile) - w, "pad_h": F.lit(tile) - h})
