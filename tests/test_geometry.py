import math

import pytest
from pyspark.sql import functions as F

from boxtrail.functions import geometry as g
from boxtrail.functions import labels as lb


def value(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def box(*v):
    return tuple(F.lit(float(x)) for x in v)


def test_corner_box(spark):
    b = box(0, 0, 10, 5)
    assert value(spark, g.width(b), g.height(b), g.area(b), *g.center(b)) == (10, 5, 50, 5, 2.5)


@pytest.mark.parametrize(("a", "b", "want"), [((0, 0, 10, 10), (5, 5, 15, 15), 25 / 175), ((0, 0, 10, 10), (10, 0, 20, 10), 0), ((0, 0, 0, 0), (0, 0, 0, 0), 0), ((0, 0, 4, 4), (0, 0, 4, 4), 1)])
def test_overlap(spark, a, b, want):
    got = value(spark, g.iou(box(*a), box(*b)), g.iou(box(*b), box(*a)))
    assert got == pytest.approx((want, want))


@pytest.mark.parametrize("b", [(0, 0, 10, 10), (10, 20, 30, 40)])
def test_measurement_and_back(spark, b):
    assert value(spark, *g.from_measurement(g.to_measurement(box(*b)))) == pytest.approx(b, abs=1e-3)


def test_negative_area_is_nan(spark):
    assert all(math.isnan(v) for v in value(spark, *g.from_measurement(box(5, 5, -4, 1))))


def test_normal_values(spark):
    assert value(spark, *[g.normal(F.lit(float(v))) for v in (1, 0, "inf", "nan", 1e-39, -2)]) == (True, False, False, False, False, True)


def test_contained_both_ways(spark):
    a, b = box(10, 10, 50, 50), box(12, 12, 52, 52)
    assert value(spark, g.contains(a, b), g.contains(b, a)) == (True, True)


def test_pixels_cut_towards_zero(spark):
    assert value(spark, *g.to_pixels(box(0.5, -0.1, 0.999, 1), F.lit(10), F.lit(10))) == (5, 0, 9, 10)


def test_tiles(spark):
    from boxtrail.operators.tiles import tile_grid

    rows = lambda w, h: [(r.offset_x, r.offset_y) for r in tile_grid(spark.createDataFrame([(w, h)], "width int, height int")).orderBy("tile_idx").collect()]
    assert rows(1014, 640) == [(0, 0), (374, 0)]
    assert rows(640, 480) == [(0, 0)]


def test_names(spark):
    d = spark.createDataFrame([(0,), (79,), (365,)], "class_id long")
    labels = spark.createDataFrame(list(enumerate(lb.COCO)), "class_id long, class_name string")
    assert {r.class_id: r.class_name for r in lb.with_names(d, labels).collect()} == {0: "person", 79: "toothbrush", 365: "class_365"}
    assert len(lb.COCO) == 80


def test_captions(spark):
    assert value(spark, lb.caption(F.lit("Person"), F.lit(0.865), F.lit(3)), lb.caption(F.lit("Car"), F.lit(0.5))) == ("#3 Person 86%", "Car 50%")


def test_models(spark):
    assert value(spark, lb.parse_model(F.lit("R18")), lb.parse_model(F.lit("r50-UINT8")), lb.parse_model(F.lit("x"))) == ("r18vd_fp32", "r50vd_uint8", None)


def test_equal_logits_take_the_first_class(spark):
    from boxtrail.operators.decode import best_class

    cls, conf = value(spark, *best_class(F.array(F.lit(1.0), F.lit(3.0), F.lit(3.0))))
    assert cls == 1 and conf == pytest.approx(1 / (2 + math.exp(-2)))
