"""Suppression of duplicates (greedy, by class) and of nested boxes, and the counters of both."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxtrail.functions import geometry as g

#: The columns that say which picture a detection belongs to.
FRAME = ("stream_id", "frame_id")


def _corners(s: Column) -> g.Box:
    return g.corners(s["x"], s["y"], s["w"], s["h"])


def suppress(detections: DataFrame, threshold: float = 0.5, by: tuple[str, ...] = (*FRAME, "class_id")) -> DataFrame:
    """Detections that survive greedy suppression: by falling confidence (ties by det_id), one that overlaps a kept one of
    its class by more than threshold goes. NaN confidences are dropped first. One shuffle; a group is a picture's class."""
    rest = [c for c in detections.columns if c not in by and c not in ("confidence", "det_id")]
    row = F.struct((-F.col("confidence")).alias("order"), "det_id", "confidence", *rest)
    groups = detections.where(~F.isnan("confidence")).groupBy(*by).agg(F.array_sort(F.collect_list(row)).alias("all"))
    empty = F.filter("all", lambda _: F.lit(False))
    kept = F.aggregate("all", empty, lambda acc, x: F.when(F.exists(acc, lambda k: g.iou(_corners(k), _corners(x)) > threshold), acc).otherwise(F.concat(acc, F.array(x))))
    return groups.select(*by, F.explode(kept).alias("k")).select(*[F.col(c) if c in by else F.col(f"k.{c}") for c in detections.columns])


def nested(detections: DataFrame, pad: float = 10.0, keep_one: bool = False) -> DataFrame:
    """(stream_id, frame_id, det_id) of boxes that lie inside another one of their class, grown by pad. Boxes that lie
    in each other are both nested, unless keep_one keeps the one with the smaller det_id."""
    a, b = detections.alias("a"), detections.alias("b")
    inner, outer = (g.corners(*[F.col(f"{t}.{c}") for c in "xywh"]) for t in "ab")
    same = F.expr(" and ".join(f"a.{c} = b.{c}" for c in (*FRAME, "class_id")))
    hit = same & (F.col("a.det_id") != F.col("b.det_id")) & g.contains(outer, inner, pad)
    if keep_one:
        hit = hit & (~g.contains(inner, outer, pad) | (F.col("b.det_id") < F.col("a.det_id")))
    return a.join(b, hit).select(*[F.col(f"a.{c}") for c in (*FRAME, "det_id")]).distinct()


def drop_nested(detections: DataFrame, pad: float = 10.0, keep_one: bool = False) -> DataFrame:
    return detections.join(nested(detections, pad, keep_one), [*FRAME, "det_id"], "left_anti")


def postprocess(detections: DataFrame, threshold: float = 0.5, pad: float = 10.0) -> DataFrame:
    """Suppression, then removal of nested boxes."""
    return drop_nested(suppress(detections, threshold), pad)


def counters(detections: DataFrame, threshold: float = 0.5, pad: float = 10.0) -> DataFrame:
    """By picture: detections in, duplicates_removed, nested_removed, kept."""
    count = lambda df, name: df.groupBy(*FRAME).agg(F.count("*").alias(name))
    single = suppress(detections, threshold)
    out = count(detections, "n_in").join(count(single, "n_single"), [*FRAME], "left").join(count(drop_nested(single, pad), "n_kept"), [*FRAME], "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long"))
    return out.select(*FRAME, "n_in", (F.col("n_in") - zero("n_single")).alias("duplicates_removed"), (zero("n_single") - zero("n_kept")).alias("nested_removed"), zero("n_kept").alias("n_kept"))
