"""Summaries over detections, frames and tracks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def class_distribution(detections: DataFrame, labels: DataFrame) -> DataFrame:
    """For each class of labels (class_id, class_name): count, mean, population deviation, least and greatest confidence;
    0 for a class without detections."""
    stats = detections.groupBy("class_id").agg(
        F.count("*").alias("n"), F.avg("confidence").alias("avg_confidence"), F.stddev_pop("confidence").alias("std_confidence"), F.min("confidence").alias("min_confidence"), F.max("confidence").alias("max_confidence")
    )
    measures = ["avg_confidence", "std_confidence", "min_confidence", "max_confidence"]
    return labels.join(stats, "class_id", "left").select("class_id", "class_name", F.coalesce("n", F.lit(0).cast("long")).alias("n"), *[F.round(F.coalesce(m, F.lit(0.0)), 6).alias(m) for m in measures])


def video_summary(frames: DataFrame) -> DataFrame:
    """frames: n_detections, ms. One row: frames, detections, mean milliseconds and the rate that they mean."""
    return frames.agg(F.count("*").alias("total_frames"), F.sum("n_detections").alias("total_detections"), F.avg("ms").alias("avg_ms")).select("total_frames", "total_detections", F.round("avg_ms", 6).alias("avg_ms"), F.round(F.try_divide(F.lit(1000.0), F.col("avg_ms")), 6).alias("avg_fps"))


def latency(frames: DataFrame, order: str, ms: str = "ms", warm_up: int = 10, by: str = "stream_id") -> DataFrame:
    """By stream: mean, deviation, least and greatest milliseconds after the first warm_up frames."""
    rank = F.row_number().over(Window.partitionBy(by).orderBy(order))
    return frames.withColumn("_n", rank).where(F.col("_n") > warm_up).groupBy(by).agg(
        F.count("*").alias("n"), F.round(F.avg(ms), 6).alias("mean_ms"), F.round(F.stddev_pop(ms), 6).alias("std_ms"), F.round(F.min(ms), 6).alias("min_ms"), F.round(F.max(ms), 6).alias("max_ms"), F.round(F.try_divide(F.lit(1000.0), F.avg(ms)), 6).alias("fps")
    )


def capture_info(frames: DataFrame, by: str = "stream_id", order: str = "frame_id", ts: str = "ts", declared: str | None = None) -> DataFrame:
    """frames with their stream's fps (the declared one, else by its first and last time; 20 where that is no positive number),
    seconds from the stream's first frame at which each is due at that rate, and whether it is the stream's last one."""
    now = F.unix_micros(F.col(ts).cast("timestamp"))
    ends = frames.groupBy(by).agg(F.count("*").alias("n"), F.min(now).alias("first"), F.max(now).alias("last"), F.max(order).alias("end"), *([F.max(declared).alias("said")] if declared else []))
    measured = F.try_divide((F.col("n") - 1) * 1e6, F.col("last") - F.col("first"))
    fps = F.coalesce(F.col("said").cast("double"), measured) if declared else measured
    info = ends.select(F.col(by), "end", F.when(fps > 0, fps).otherwise(20.0).alias("fps"))
    start = Window.partitionBy(by).orderBy(order)
    return frames.join(info, by).withColumn("due", (F.row_number().over(start) - 1) / F.col("fps")).withColumn("is_last", F.col(order) == F.col("end")).drop("end")


def frame_steps(frames: DataFrame, by: str = "stream_id", ts: str = "ts", least: float = 0.001, most: float = 0.2) -> Column:
    """Seconds since the frame before, within bounds; the first frame has the least."""
    w = Window.partitionBy(by).orderBy(ts)
    now = F.unix_micros(F.col(ts).cast("timestamp")) / 1e6
    return F.greatest(F.lit(least), F.least(F.lit(most), F.coalesce(now - F.lag(now).over(w), F.lit(0.0))))


def moving_average(value: str, by: str, order: str, n: int = 30) -> Column:
    return F.avg(value).over(Window.partitionBy(by).orderBy(order).rowsBetween(-(n - 1), 0))


def every_nth(rows: DataFrame, by: str, order: str, n: int = 100) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(by).orderBy(order))).where(F.col("_n") % n == 0).drop("_n")


def streaks(sightings: DataFrame, key: tuple[str, ...] = ("stream_id", "gt_id")) -> DataFrame:
    """By object and run of frames without a gap: first and last frame and length (gaps and islands)."""
    w = Window.partitionBy(*key).orderBy("frame_id")
    island = F.col("frame_id") - F.row_number().over(w)
    return sightings.select(*key, "frame_id").distinct().withColumn("_i", island).groupBy(*key, "_i").agg(F.min("frame_id").alias("first_frame"), F.max("frame_id").alias("last_frame"), F.count("*").alias("hit_streak")).drop("_i")


def latest(rows: DataFrame, by: str, order: str, columns: list[str]) -> DataFrame:
    """The newest row of each key; a maximum, so it combines before the shuffle."""
    best = F.max_by(F.struct(*columns), F.struct(order, *columns)).alias("r")
    return rows.groupBy(by).agg(best).select(by, *[F.col(f"r.{c}") for c in columns])


def top_k(rows: DataFrame, by: tuple[str, ...], k: int = 100) -> DataFrame:
    """The k most confident detections of each picture, ties by det_id."""
    w = Window.partitionBy(*by).orderBy(F.desc("confidence"), "det_id")
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def last_known(rows: DataFrame, value: str, by: tuple[str, ...], order: str) -> Column:
    return F.last(value, ignorenulls=True).over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))


def track_summary(tracks: DataFrame) -> DataFrame:
    """By track: frames, updates, extrapolated frames, path length of its center and share of frames seen."""
    w = Window.partitionBy("stream_id", "track_id").orderBy("frame_id")
    cx, cy = F.col("x") + F.col("w") / 2, F.col("y") + F.col("h") / 2
    step = F.sqrt((cx - F.lag(cx).over(w)) ** 2 + (cy - F.lag(cy).over(w)) ** 2)
    return tracks.withColumn("_step", step).groupBy("stream_id", "track_id").agg(
        F.count("*").alias("frames"), F.sum(F.col("det_id").isNotNull().cast("long")).alias("updates"), F.sum(F.col("is_extrapolated").cast("long")).alias("extrapolated"), F.min("frame_id").alias("first_frame"), F.max("frame_id").alias("last_frame"), F.round(F.coalesce(F.sum("_step"), F.lit(0.0)), 3).alias("path")
    )


def average_precision(detections: DataFrame, truth: DataFrame, threshold: float = 0.5) -> DataFrame:
    """By class: area under the precision-recall steps, a detection counting where its best box of truth (of its picture
    and class, above threshold) has no more confident claim."""
    from boxtrail.functions import geometry as g

    key = ["stream_id", "frame_id", "class_id"]
    d, t = detections.select(*key, "det_id", "confidence", *"xywh"), truth.select(*key, F.col("det_id").alias("gt"), *[F.col(c).alias(f"t_{c}") for c in "xywh"])
    pairs = d.join(t, key).withColumn("iou", g.iou(g.corners(*g.columns()), g.corners(*g.columns("t_")))).where(F.col("iou") >= threshold)
    best = pairs.groupBy(*key, "det_id", "confidence").agg(F.max_by("gt", F.struct("iou", (-F.col("gt")).alias("o"))).alias("gt"))
    first = best.withColumn("_r", F.row_number().over(Window.partitionBy(*key, "gt").orderBy(F.desc("confidence"), "det_id"))).where("_r = 1").select(*key, "det_id", F.lit(1).alias("hit"))
    total = truth.groupBy("class_id").agg(F.count("*").alias("n_truth"))
    w = Window.partitionBy("class_id").orderBy(F.desc("confidence"), "det_id")
    scored = d.join(first, [*key, "det_id"], "left").withColumn("hit", F.coalesce("hit", F.lit(0))).withColumns({"_tp": F.sum("hit").over(w), "_n": F.row_number().over(w)})
    ap = scored.join(total, "class_id").groupBy("class_id", "n_truth").agg(F.sum(F.when(F.col("hit") == 1, F.col("_tp") / F.col("_n")).otherwise(0.0)).alias("_s"))
    return ap.select("class_id", "n_truth", F.round(F.col("_s") / F.col("n_truth"), 6).alias("ap"))
