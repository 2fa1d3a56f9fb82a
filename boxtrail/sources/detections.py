"""Detections derived from the events table, with the same arithmetic for Spark and DuckDB.

dense: overlapping boxes in groups of a few to a class, for suppression, containment and pair joins.
smooth: ten separated objects a stream that drift two pixels a frame, with misses; gt_id tells them apart.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_DENSE = """SELECT event_id AS det_id, event_id % 4 AS stream_id, CAST(FLOOR(event_id/{d40}) AS BIGINT) AS frame_id, ts,
 CAST(FLOOR((event_id%40)/{d4}) AS BIGINT) % 2 AS class_id,
 CAST(FLOOR((event_id%40)/{d16}) AS BIGINT)*{d90} + CAST(FLOOR(event_id/{d40}) AS BIGINT)%50*{d2} + (user_id*7)%31 AS x,
 {d10} + (user_id*3)%17 AS y, {d60} + user_id%5 AS w, {d40} + user_id%3 AS h,
 {d005} + (CAST(ROUND(value*{d100}) AS BIGINT)%95)/{d100} AS confidence FROM events"""

_SMOOTH = """SELECT event_id AS det_id, event_id % 4 AS stream_id, CAST(FLOOR(event_id/{d40}) AS BIGINT) AS frame_id, ts,
 CAST(FLOOR((event_id%40)/{d4}) AS BIGINT) AS gt_id,
 CAST(FLOOR((event_id%40)/{d4}) AS BIGINT)*{d150} + CAST(FLOOR(event_id/{d40}) AS BIGINT)*{d2} + user_id%3 + {d5} AS x,
 CAST(FLOOR((event_id%40)/{d4}) AS BIGINT)%2*{d100} + {d20} AS y, {d60} AS w, {d40} AS h,
 {d055} + (user_id%40)/{d100} AS confidence FROM events WHERE user_id % 11 <> 0"""

_NUMBERS = {"d2": "2", "d4": "4", "d5": "5", "d10": "10", "d16": "16", "d20": "20", "d40": "40", "d60": "60", "d90": "90", "d100": "100", "d150": "150", "d005": "0.05", "d055": "0.55"}
_SPARK = {k: f"{v}D" for k, v in _NUMBERS.items()}
_DUCK = {k: f"{float(v)}::DOUBLE" for k, v in _NUMBERS.items()}

#: For use in DuckDB queries: SELECTs over the view `events`.
DENSE_SQL, SMOOTH_SQL = _DENSE.format(**_DUCK), _SMOOTH.format(**_DUCK)


def _from_events(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    return spark.sql(sql.replace("FROM events", "FROM {events}"), events=spark.read.parquet(f"{sf_dir}/events.parquet"))


def dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _from_events(spark, sf_dir, _DENSE.format(**_SPARK))


def smooth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _from_events(spark, sf_dir, _SMOOTH.format(**_SPARK))


def raw_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model outputs (frame_id, query_id, cx, cy, w, h, logits): the embeddings as logits, boxes from their ids."""
    v = F.col("vec_id")
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(
        F.floor(v / 300).alias("frame_id"), (v % 300).alias("query_id"), ((v % 97) / 96.0).alias("cx"), ((v % 89) / 88.0).alias("cy"), ((v % 13 + 1) / 40.0).alias("w"), ((v % 7 + 1) / 30.0).alias("h"),
        F.transform("embedding", lambda e: e.cast("double")).alias("logits"),
    )


RAW_SQL = """SELECT CAST(floor(vec_id / 300) AS BIGINT) AS frame_id, vec_id % 300 AS query_id, (vec_id % 97) / 96.0::DOUBLE AS cx, (vec_id % 89) / 88.0::DOUBLE AS cy,
 (vec_id % 13 + 1) / 40.0::DOUBLE AS w, (vec_id % 7 + 1) / 30.0::DOUBLE AS h, list_transform(embedding, lambda e: e::DOUBLE) AS logits FROM embeddings"""
