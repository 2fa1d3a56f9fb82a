"""Pair joins of boxes in the same picture: all pairs of the picture, or candidates from a grid of cells."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxtrail.functions import geometry as g

FRAME = ("stream_id", "frame_id")


def _renamed(df: DataFrame, prefix: str) -> DataFrame:
    return df.select(*FRAME, *[F.col(c).alias(f"{prefix}_{c}") for c in df.columns if c not in FRAME])


def _overlap(prefix_a: str, prefix_b: str):
    a, b = (g.corners(*g.columns(f"{p}_")) for p in (prefix_a, prefix_b))
    return g.iou(a, b)


def dense_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """Every pair of a picture with its overlap: an equi-join on the picture, never a product of the tables."""
    return _renamed(left, "l").join(_renamed(right, "r"), [*FRAME]).withColumn("iou", _overlap("l", "r"))


def cells(df: DataFrame, size: float = 100.0) -> DataFrame:
    """df once for each grid cell that a box touches: floor of its least to ceiling of its greatest edge, inclusive."""
    span = lambda lo, hi: F.explode(F.sequence(F.floor(lo / size), F.ceil(hi / size)))
    x, y, w, h = g.columns()
    return df.withColumn("cell_x", span(x, x + w)).withColumn("cell_y", span(y, y + h))


def grid_candidates(left: DataFrame, right: DataFrame, size: float = 100.0) -> DataFrame:
    """(stream_id, frame_id, l_id, r_id) of pairs that share a cell; may hold pairs that don't overlap, misses none."""
    key = [*FRAME, "cell_x", "cell_y"]
    a = cells(left, size).select(*key, F.col("det_id").alias("l_id"))
    b = cells(right, size).select(*key, F.col("det_id").alias("r_id"))
    return a.join(b, key).select(*FRAME, "l_id", "r_id").distinct()


def grid_pairs(left: DataFrame, right: DataFrame, size: float = 100.0) -> DataFrame:
    """dense_pairs() with an overlap above 0, by way of the grid."""
    found = grid_candidates(left, right, size)
    out = found.join(_renamed(left, "l").withColumnRenamed("l_det_id", "l_id"), [*FRAME, "l_id"]).join(_renamed(right, "r").withColumnRenamed("r_det_id", "r_id"), [*FRAME, "r_id"])
    return out.withColumn("iou", _overlap("l", "r")).where("iou > 0")


def pair_join(left: DataFrame, right: DataFrame, strategy: str = "dense", size: float = 100.0) -> DataFrame:
    """(stream_id, frame_id, l_id, r_id, iou) of overlapping pairs; the strategies give the same rows."""
    if strategy == "grid":
        return grid_pairs(left, right, size).select(*FRAME, "l_id", "r_id", "iou")
    return dense_pairs(left, right).where("iou > 0").select(*FRAME, F.col("l_det_id").alias("l_id"), F.col("r_det_id").alias("r_id"), "iou")


def grid_stats(df: DataFrame, size: float = 100.0) -> DataFrame:
    """By picture: cells in use, entries in them, most and mean entries of a cell."""
    per_cell = cells(df, size).groupBy(*FRAME, "cell_x", "cell_y").agg(F.count("*").alias("n"))
    return per_cell.groupBy(*FRAME).agg(F.count("*").alias("total_cells"), F.sum("n").alias("total_entries"), F.max("n").alias("max_entries"), F.avg("n").alias("avg_entries"))


def grid_efficiency(left: DataFrame, right: DataFrame, size: float = 100.0) -> DataFrame:
    """By picture: possible and candidate pairs, and the share of pairs that the grid saves."""
    count = lambda df, name: df.groupBy(*FRAME).agg(F.count("*").alias(name))
    out = count(left, "nl").join(count(right, "nr"), [*FRAME]).join(count(grid_candidates(left, right, size), "candidate_pairs"), [*FRAME], "left").na.fill(0, ["candidate_pairs"])
    possible = F.col("nl") * F.col("nr")
    return out.select(*FRAME, possible.alias("possible_pairs"), "candidate_pairs", (1 - F.try_divide(F.col("candidate_pairs"), possible)).alias("reduction"))
