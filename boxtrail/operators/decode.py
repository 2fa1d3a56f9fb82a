"""Model outputs as detections: class and confidence from logits, boxes from centered shares of the frame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxtrail.functions import geometry as g


def best_class(logits: Column) -> tuple[Column, Column]:
    """Class of the greatest logit (the first of equals) and its softmax."""
    top = F.array_max(logits)
    total = F.aggregate(logits, F.lit(0.0), lambda a, v: a + F.exp(v - top))
    return (F.array_position(logits, top) - 1).cast("long"), 1 / total


def split_tensor(row: Column) -> tuple[Column, Column]:
    """Boxes and logits of a combined output: the first four values, and the rest."""
    return F.slice(row, 1, 4), F.slice(row, 5, F.greatest(F.size(row) - 4, F.lit(0)))


def decode(predictions: DataFrame, frame_w: int = 640, frame_h: int = 640, threshold: float = 0.5, classes: list[int] | None = None) -> DataFrame:
    """(frame_id, query_id, class_id, confidence, x, y, w, h in shares) of queries from threshold upwards; an empty or
    missing list of classes lets all pass."""
    cls, conf = best_class(F.col("logits"))
    x, y, w, h = g.from_query(*[F.col(c) for c in ("cx", "cy", "w", "h")], F.lit(float(frame_w)), F.lit(float(frame_h)))
    out = predictions.select("frame_id", "query_id", cls.alias("class_id"), conf.alias("confidence"), x.alias("x"), y.alias("y"), w.alias("w"), h.alias("h")).where(F.col("confidence") >= threshold)
    return out.where(F.col("class_id").isin(*classes)) if classes else out
