import pytest

from boxtrail.operators import pairs, suppress
from boxtrail.sources import files
from boxtrail.sources.detections import dense

BOX = "stream_id long, frame_id long, class_id long, det_id long, x double, y double, w double, h double, confidence double"


def boxes(spark, rows):
    return spark.createDataFrame([(0, 0, c, i, float(x), float(y), float(w), float(h), s) for i, (c, x, y, w, h, s) in enumerate(rows)], BOX)


def ids(df):
    return sorted(r.det_id for r in df.collect())


def test_overlap_at_the_threshold_stays(spark):
    rows = [(0, 0, 0, 10, 10, 0.9), (0, 0, 0, 10, 5, 0.8)]
    assert ids(suppress.suppress(boxes(spark, rows), 0.5)) == [0, 1]
    assert ids(suppress.suppress(boxes(spark, rows), 0.49)) == [0]


def test_other_classes_do_not_suppress(spark):
    assert ids(suppress.suppress(boxes(spark, [(0, 0, 0, 10, 10, 0.9), (1, 0, 0, 10, 10, 0.8)]))) == [0, 1]


def test_nan_confidence_goes(spark):
    assert ids(suppress.suppress(boxes(spark, [(0, 0, 0, 10, 10, float("nan")), (0, 50, 0, 10, 10, 0.8)]))) == [1]


def test_boxes_in_each_other(spark):
    d = boxes(spark, [(0, 10, 10, 40, 40, 0.9), (0, 12, 12, 40, 40, 0.8)])
    assert ids(suppress.drop_nested(d)) == []
    assert ids(suppress.drop_nested(d, keep_one=True)) == [0]


def test_empty(spark):
    d = boxes(spark, [(0, 0, 0, 1, 1, 0.5)]).limit(0)
    assert suppress.postprocess(d).count() == pairs.pair_join(d, d).count() == suppress.counters(d).count() == 0


def test_grid_finds_what_dense_finds(spark, sf):
    d = dense(spark, sf)
    a, b = ({(r.l_id, r.r_id) for r in pairs.pair_join(d, d, s).collect()} for s in ("dense", "grid"))
    assert a == b and a


def test_plan_of_a_filter(spark, sf):
    plan = pairs.dense_pairs(dense(spark, sf), dense(spark, sf))._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_label_lines_and_scenes(spark, sf, tmp_path):
    d = dense(spark, sf).where("frame_id < 3")
    files.write_label_lines(d, 1920, 1080, str(tmp_path / "labels"))
    lines = files.read_label_lines(spark, str(tmp_path / "labels"))
    assert lines.count() == d.count() and lines.where("w is null").count() == 0
    files.write_scenes(d, str(tmp_path / "scenes"))
    back = files.read_scenes(spark, str(tmp_path / "scenes"))
    assert back.exceptAll(d.select("stream_id", "frame_id", "class_id", "x", "y", "w", "h")).count() == 0 and back.count() == d.count()
    files.write_report(d.groupBy("class_id").count(), str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "report")).count() == 2


def test_pictures(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.png").write_bytes(b"123456")
    (tmp_path / "y.jpg").write_bytes(b"")
    (tmp_path / "z.txt").write_bytes(b"1")
    got = files.pictures(spark, str(tmp_path))
    assert [r.length for r in got.collect()] == [6]
    from pyspark.sql import functions as F

    assert got.select(files.valid_buffer(F.col("content"), F.lit(2), F.lit(1), F.lit("RGB"))).first()[0]


@pytest.mark.parametrize("mode", ["sessions", "latest", "counts"])
def test_streams(spark, sf, tmp_path, mode):
    from boxtrail.streaming import live

    path = str(tmp_path / "in")
    live.staged(dense(spark, sf), path)
    s = live.source(spark, path, 1).where(f"stream_id != {live.END_STREAM}")
    if mode == "latest":
        live.live_latest(s).writeStream.format("memory").queryName("latest").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
        assert spark.table("latest").count() == 4
        return
    query = live.live_sessions(live.source(spark, path, 1)) if mode == "sessions" else live.live_counts(live.source(spark, path, 1))
    assert live.run_to_table(query, mode).agg({"n": "sum"}).first()[0] == dense(spark, sf).count()


def test_scorer_hook(spark):
    import pandas as pd

    from boxtrail.operators import pipeline

    def make(shift):
        return lambda frames: pd.DataFrame({"frame_id": frames.frame_id, "query_id": 0, "cx": 0.5 + shift, "cy": 0.5, "w": 0.1, "h": 0.1, "logits": [[0.0, 5.0]] * len(frames)})

    pipeline.register_scorer("fixed", make)
    got = pipeline.score_frames(spark.range(3).withColumnRenamed("id", "frame_id"), "fixed", shift=0.25).collect()
    assert [(r.frame_id, r.cx, list(r.logits)) for r in sorted(got)] == [(i, 0.75, [0.0, 5.0]) for i in range(3)]


def test_settings():
    from boxtrail import config, errors

    assert config.PipelineConfig().classes == [2, 3, 4, 7] and config.VIDEO_PIPELINE.overlap == 32
    with pytest.raises(errors.ConfigError):
        config.PipelineConfig(overlap=640)
    with pytest.raises(errors.ConfigError):
        config.require_keys({"path": 1})
    assert config.method_name(config.TrackerConfig(kind="kalman")) == "Kalman Filter"
    assert str(errors.InvalidDimensions([1], [2])) == "expected dimensions [1], got [2]"


def test_files_by_suffix(spark):
    from boxtrail.operators.pipeline import count_by_suffix

    files = spark.createDataFrame([("a/x.JPG",), ("a/y.jpg",), ("b.c/z.png",), ("none",)], "path string")
    assert {r.suffix: r.n for r in count_by_suffix(files).collect()} == {"jpg": 2, "png": 1, "": 1}


def test_names_beyond_cocos(spark, tmp_path):
    from boxtrail.functions import labels as lb

    (tmp_path / "names.txt").write_text("\n".join(["person", *(f"thing {i}" for i in range(1, 365))]) + "\n")
    names = {r.class_id: r.class_name for r in lb.label_table(spark, lb.read_names(spark, str(tmp_path / "names.txt"))).collect()}
    assert len(names) == 365 and names[1] == "bicycle" and names[79] == "toothbrush" and names[80] == "thing 80" and names[364] == "thing 364"
    assert lb.label_table(spark).count() == 80


def test_capture_info_defaults(spark):
    from boxtrail.operators import analytics

    rows = spark.sql("SELECT * FROM VALUES (1, 0, TIMESTAMP'2024-01-01 00:00:00'), (1, 1, TIMESTAMP'2024-01-01 00:00:02'), (2, 5, TIMESTAMP'2024-01-01 00:00:00'), (3, 0, NULL) AS t(stream_id, frame_id, ts)")
    got = sorted((r.stream_id, r.frame_id, r.fps, r.due, r.is_last) for r in analytics.capture_info(rows).collect())
    assert got == [(1, 0, 0.5, 0.0, False), (1, 1, 0.5, 2.0, True), (2, 5, 20.0, 0.0, True), (3, 0, 20.0, 0.0, True)]
