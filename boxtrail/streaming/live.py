"""Structured Streaming: trackers as keyed state, windowed counts with watermarks, latest rows, throttled sources."""

from __future__ import annotations

import json
import pickle
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from boxtrail.operators.tracking import TRACKS, StreamRunner, Tracker, TrackerConfig, as_frame, as_rows
from boxtrail.sources.shared import shared_dir

DETECTIONS = "stream_id long, frame_id long, ts timestamp, det_id long, class_id long, confidence double, x double, y double, w double, h double"


#: The stream id of the row that closes staged files.
END_STREAM = -1


class TrackProcessor(StatefulProcessor):
    """One stream's tracker in a value state. A frame is run once a later one arrives, or once the watermark passes it,
    so late rows of the newest frame are still taken."""

    def __init__(self, config: TrackerConfig):
        self.config = config

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.value = handle.getValueState("tracker", "saved binary")

    def _load(self, stream: int) -> StreamRunner:
        runner = StreamRunner(self.config, stream)
        if self.value.exists():
            saved = pickle.loads(self.value.get()[0])
            runner.tracker = Tracker.restore(self.config, json.loads(saved["tracker"]))
            runner.memory, runner.last, runner.open = saved["memory"], saved["last"], saved["open"]
        return runner

    def _save(self, runner: StreamRunner) -> None:
        self.value.update((pickle.dumps({"tracker": json.dumps(runner.tracker.state()), "memory": runner.memory, "last": runner.last, "open": runner.open}),))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        if int(key[0]) == END_STREAM:
            yield _EMPTY
            return
        runner = self._load(int(key[0]))
        batch = pd.concat(list(rows)).sort_values(["frame_id", "det_id"])
        newest = runner.open[0] if runner.open else runner.last
        batch = batch if newest is None else batch[batch.frame_id >= newest]  # frames that were run already are late
        done = []
        if len(batch):
            done = runner.feed(batch.frame_id.to_numpy("int64"), as_rows(batch))
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(int(batch.ts.max().timestamp() * 1000) + 1)  # the frame that is still open
        self._save(runner)
        yield as_frame(done) if done else _EMPTY

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        runner = self._load(int(key[0]))
        done = runner.finish()
        self._save(runner)
        yield as_frame(done) if done else _EMPTY

    def close(self) -> None:
        pass


_EMPTY = pd.DataFrame({c.split()[0]: [] for c in TRACKS.split(", ")})


def live_tracks(stream: DataFrame, config: TrackerConfig = TrackerConfig(), late: str = "10 seconds") -> DataFrame:
    """Tracks of a stream of detections (schema DETECTIONS). Needs the RocksDB state store."""
    kept = stream.withWatermark("ts", late)
    return kept.groupBy("stream_id").transformWithStateInPandas(TrackProcessor(config), outputStructType=TRACKS, outputMode="append", timeMode="eventTime")


def live_counts(stream: DataFrame, window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Detections by window of event time and class."""
    real = (F.col("stream_id") != END_STREAM) | F.col("ts").isNull()  # names ts, so that it isn't pushed before the watermark
    return stream.withWatermark("ts", late).where(real).groupBy(F.window("ts", window), "class_id").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "class_id", "n")


def live_sessions(stream: DataFrame, gap: str = "5 minutes", late: str = "1 hour") -> DataFrame:
    """Runs of detections of a stream and class that no gap divides."""
    return stream.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "stream_id", "class_id").agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "stream_id", "class_id", "n")


def live_latest(stream: DataFrame) -> DataFrame:
    """The newest detection of each stream, for update mode."""
    return stream.groupBy("stream_id").agg(F.max_by(F.struct("frame_id", "det_id"), "ts").alias("r")).select("stream_id", "r.frame_id", "r.det_id")


def source(spark: SparkSession, path: str, files_per_trigger: int = 2) -> DataFrame:
    """Detections from Parquet files, a bounded number of them at a time; nothing is shed."""
    return spark.readStream.schema(DETECTIONS).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def staged(detections: DataFrame, path: str, files: int = 4) -> None:
    """For replays: detections as files that appear in the order of time (one for each part, as a trigger takes files, not parts), so that a stream over them is one in order; the last row
    belongs to no stream and stands a day after all others, so that the watermark passes them."""
    columns = [c.split()[0] for c in DETECTIONS.split(", ")]
    rows = detections.withColumn("ts", F.col("ts").cast("timestamp")).select(*columns)
    low, high = rows.agg(F.unix_micros(F.min("ts")), F.unix_micros(F.max("ts"))).first()
    if low is None:
        rows.write.parquet(path)
        return
    part = F.floor((F.unix_micros("ts") - low) * files / (high - low + 1))
    for i in range(files):
        rows.where(part == i).coalesce(1).write.mode("append").parquet(path)
    end = rows.sparkSession.range(1).select(F.lit(END_STREAM).cast("long").alias("stream_id"), F.lit(0).cast("long").alias("frame_id"), F.timestamp_micros(F.lit(high + 86_400_000_000)).alias("ts"))
    end.select(*[c if c in end.columns else F.lit(None).cast(k).alias(c) for c, k in (x.split() for x in DETECTIONS.split(", "))]).write.mode("append").parquet(path)


def run_to_table(query: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Runs a streaming query over all that is there and gives its output as a table in the shared folder."""
    spark = query.sparkSession
    base = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    query.writeStream.format("parquet").outputMode(mode).option("path", f"{base}/out").option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(query.schema).parquet(f"{base}/out")


def _rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def run_tracks(detections: DataFrame, config: TrackerConfig = TrackerConfig()) -> DataFrame:
    """track() as a streaming query over the same rows."""
    spark = detections.sparkSession
    _rocksdb(spark)
    path = f"{shared_dir(spark).rstrip('/')}/staged-{uuid.uuid4().hex}"
    staged(detections, path)
    return run_to_table(live_tracks(source(spark, path, 1), config), "tracks")


def run_counts(detections: DataFrame) -> DataFrame:
    spark = detections.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/staged-{uuid.uuid4().hex}"
    staged(detections, path)
    return run_to_table(live_counts(source(spark, path, 1)), "counts")


def fan_out(stream: DataFrame, sinks: dict[str, Callable[[DataFrame], DataFrame]], checkpoint: str, base: str) -> None:
    """Runs a stream over all that is there into several tables under base at once, each by a function of a batch; the batch is kept while it is
    written. A batch that is run again after a failure replaces what it wrote before, so each counts once."""

    def write(batch: DataFrame, number: int) -> None:
        kept = batch.persist(StorageLevel.DISK_ONLY)
        for name, make in sinks.items():
            make(kept).write.mode("overwrite").parquet(f"{base}/{name}/batch={number}")
        kept.unpersist()

    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def run_fan_out(detections: DataFrame, sinks: dict[str, Callable[[DataFrame], DataFrame]]) -> dict[str, DataFrame]:
    """fan_out() over the same rows; the tables that come of it."""
    spark = detections.sparkSession
    base = f"{shared_dir(spark).rstrip('/')}/fan-{uuid.uuid4().hex}"
    staged(detections, f"{base}/in")
    fan_out(source(spark, f"{base}/in", 1).where(F.col("stream_id") != END_STREAM), sinks, f"{base}/checkpoint", base)
    return {name: spark.read.parquet(f"{base}/{name}") for name in sinks}
