"""All registered queries of the detection engine, each beside its DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxtrail.functions import geometry as g
from boxtrail.functions import labels as lb
from boxtrail.operators import analytics, assign, decode, pairs, suppress, tiles, tracking
from boxtrail.sources.detections import DENSE_SQL, RAW_SQL, SMOOTH_SQL, dense, raw_predictions, smooth

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Relations that the SQL below names: d and s are the derived detections, raw the model outputs.
_WITH = {"d": f"d AS ({DENSE_SQL})", "s": f"s AS ({SMOOTH_SQL})", "raw": f"raw AS ({RAW_SQL})"}


def query(name: str, sql: str | None = None, *relations: str, recursive: bool = False):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            parts = [_WITH[r] for r in relations]
            body = sql.strip()
            if body.upper().startswith("WITH "):
                body = "WITH " + ("RECURSIVE " if recursive else "") + ", ".join([*parts, body[5:]])
            elif parts:
                body = f"WITH {', '.join(parts)} {body}"
            ORACLES[name] = body
        return f

    return add


def _r(c, name: str, digits: int = 6):
    return F.round(c, digits).alias(name)


def _corner(prefix: str = "") -> g.Box:
    return g.corners(*g.columns(prefix))


# --- projections --------------------------------------------------------------------------------


@query("corner_geometry", "SELECT det_id, x + w - x AS width, y + h - y AS height, (x + w - x) * (y + h - y) AS area, (x + x + w) / 2 AS center_x, (y + y + h) / 2 AS center_y, x AS b0, y AS b1, x + w AS b2, y + h AS b3, 'Bbox(' || x || ', ' || y || ', ' || (x + w) || ', ' || (y + h) || ')' AS shown FROM d", "d")
def corner_geometry(spark, sf_dir):
    b = _corner()
    cx, cy = g.center(b)
    e = g.bounds(b)
    return dense(spark, sf_dir).select("det_id", g.width(b).alias("width"), g.height(b).alias("height"), g.area(b).alias("area"), cx.alias("center_x"), cy.alias("center_y"), *[e[i].alias(f"b{i}") for i in range(4)], g.shown(b).alias("shown"))


@query("measurement", "SELECT det_id, x + w / 2 AS cx, y + h / 2 AS cy, w * h AS area, round(w / h, 6) AS aspect, round(x, 6) AS x0, round(y, 6) AS y0, round(x + w, 6) AS x1, round(y + h, 6) AS y1 FROM d", "d")
def measurement(spark, sf_dir):
    z = g.to_measurement(_corner())
    b = g.from_measurement(z)
    return dense(spark, sf_dir).select("det_id", z[0].alias("cx"), z[1].alias("cy"), z[2].alias("area"), _r(z[3], "aspect"), _r(b[0], "x0"), _r(b[1], "y0"), _r(b[2], "x1"), _r(b[3], "y1"))


@query("pixels", "SELECT det_id, round(x / 1919, 6) AS nx, round(y / 1079, 6) AS ny, round(w / 1919, 6) AS nw, round(h / 1079, 6) AS nh, greatest(trunc(x / 1919 * 640)::INT, 0) AS px, greatest(trunc(y / 1079 * 480)::INT, 0) AS py, greatest(trunc(w / 1919 * 640)::INT, 0) AS pw, greatest(trunc(h / 1079 * 480)::INT, 0) AS ph FROM d", "d")
def pixels(spark, sf_dir):
    n = g.to_normalized(g.columns(), F.lit(1919), F.lit(1079))
    p = g.to_pixels(n, F.lit(640), F.lit(480))
    return dense(spark, sf_dir).select("det_id", *[_r(c, k) for c, k in zip(n, ("nx", "ny", "nw", "nh"), strict=True)], *[c.alias(k) for c, k in zip(p, ("px", "py", "pw", "ph"), strict=True)])


@query("normalized_center_area", "SELECT det_id, round(x / 1919 + w / 1919 / 2, 6) AS cx, round(y / 1079 + h / 1079 / 2, 6) AS cy, round(w / 1919 * (h / 1079), 9) AS area FROM d", "d")
def normalized_center_area(spark, sf_dir):
    x, y, w, h = g.to_normalized(g.columns(), F.lit(1919), F.lit(1079))
    return dense(spark, sf_dir).select("det_id", _r(x + w / 2, "cx"), _r(y + h / 2, "cy"), _r(w * h, "area", 9))


@query("tracker_rows", "SELECT det_id, x AS x1, y AS y1, x + w AS x2, y + h AS y2, round(confidence, 6) AS score FROM d", "d")
def tracker_rows(spark, sf_dir):
    return dense(spark, sf_dir).select("det_id", *[c.alias(k) for c, k in zip(_corner(), ("x1", "y1", "x2", "y2"), strict=True)], _r(F.col("confidence"), "score"))


@query("tracker_defaults", "SELECT det_id AS track_id, x, y, x + w - x AS w, y + h - y AS h, 0.0::DOUBLE AS confidence, 0::BIGINT AS class_id, 'tracked_object' AS class_name FROM d WHERE NOT isnan(x)", "d")
def tracker_defaults(spark, sf_dir):
    """What a track's row holds before a class is known."""
    b = _corner()
    return dense(spark, sf_dir).where(~F.isnan("x")).select(F.col("det_id").alias("track_id"), "x", "y", g.width(b).alias("w"), g.height(b).alias("h"), F.lit(0.0).alias("confidence"), F.lit(0).cast("long").alias("class_id"), F.lit("tracked_object").alias("class_name"))


_DECODE_SQL = """SELECT frame_id, query_id, list_position(logits, list_max(logits))::BIGINT - 1 AS class_id,
 1 / list_sum(list_transform(logits, lambda v: exp(v - list_max(logits)))) AS conf, greatest((cx - w / 2) * 640, 0) / 640 AS x, greatest((cy - h / 2) * 640, 0) / 640 AS y, w, h FROM raw"""


@query("decode_queries", f"SELECT frame_id, query_id, class_id, round(conf, 6) AS confidence, round(x, 6) AS x, round(y, 6) AS y, round(least(w, 1 - x), 6) AS w, round(least(h, 1 - y), 6) AS h FROM ({_DECODE_SQL}) WHERE conf >= 0.02", "raw")
def decode_queries(spark, sf_dir):
    out = decode.decode(raw_predictions(spark, sf_dir), threshold=0.02)
    return out.select("frame_id", "query_id", "class_id", *[_r(F.col(c), c) for c in ("confidence", "x", "y", "w", "h")])


@query("split_tensor", "SELECT vec_id, round(list_sum(list_transform(embedding[1:4], lambda e: e::DOUBLE)), 5) AS box_sum, len(embedding[5:]) ::BIGINT AS n_logits FROM embeddings")
def split_tensor(spark, sf_dir):
    box, logits = decode.split_tensor(F.col("embedding"))
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", _r(F.aggregate(F.transform(box, lambda e: e.cast("double")), F.lit(0.0), lambda a, v: a + v), "box_sum", 5), F.size(logits).cast("long").alias("n_logits"))


_SIZES = "(SELECT (640 + (event_id % 7) * 211)::INT AS width, (480 + (event_id % 5) * 173)::INT AS height, event_id FROM events)"


def _sizes(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select((640 + (F.col("event_id") % 7) * 211).cast("int").alias("width"), (480 + (F.col("event_id") % 5) * 173).cast("int").alias("height"), "event_id")


_TILES_SQL = f"""WITH z AS (SELECT DISTINCT width, height FROM {_SIZES}),
 p AS (SELECT DISTINCT width, height, least(i * 576, greatest(width - 640, 0))::INT AS offset_x, least(j * 576, greatest(height - 640, 0))::INT AS offset_y
  FROM z, range(0, 10) a(i), range(0, 10) b(j) WHERE i <= CASE WHEN width <= 640 THEN 0 ELSE ceil((width - 640) / 576.0) END AND j <= CASE WHEN height <= 640 THEN 0 ELSE ceil((height - 640) / 576.0) END),
 t AS (SELECT width, height, (row_number() OVER (PARTITION BY width, height ORDER BY offset_x, offset_y) - 1)::INT AS tile_idx, offset_x, offset_y FROM p) """


@query("tile_grid", _TILES_SQL + "SELECT * FROM t")
def tile_grid(spark, sf_dir):
    return tiles.tile_grid(_sizes(spark, sf_dir))


@query("tile_extract", _TILES_SQL + "SELECT width, height, tile_idx, offset_x, offset_y, least(640, width - offset_x)::INT AS copy_w, least(640, height - offset_y)::INT AS copy_h, (640 - least(640, width - offset_x))::INT AS pad_w, (640 - least(640, height - offset_y))::INT AS pad_h FROM t")
def tile_extract(spark, sf_dir):
    return tiles.extract(tile_grid(spark, sf_dir))


@query("tile_to_frame", "WITH t AS (SELECT * FROM (VALUES (0, 0), (1, 374)) v(tile_idx, offset_x)) SELECT det_id, x / 640 * 640 + offset_x AS x, y / 640 * 640 AS y, w / 640 * 640 AS w, h / 640 * 640 AS h FROM d JOIN t ON d.det_id % 2 = t.tile_idx", "d")
def tile_to_frame(spark, sf_dir):
    grid = tiles.tile_grid(spark.createDataFrame([(1014, 640)], "width int, height int"))
    local = dense(spark, sf_dir).select("det_id", (F.col("det_id") % 2).cast("int").alias("tile_idx"), *[(F.col(c) / 640).alias(c) for c in "xywh"])
    return tiles.to_frame(local, grid).select("det_id", "x", "y", "w", "h")


@query(
    "picture_sizes",
    f"""WITH k AS (SELECT event_id, width AS w, height AS h, least(800.0::DOUBLE / CASE WHEN width > height THEN width ELSE height END, 1.0) AS s, least(640.0::DOUBLE / width, 640.0::DOUBLE / height) AS b FROM {_SIZES})
 SELECT event_id, round(s, 6) AS scale, floor(w * s)::INT AS small_w, floor(h * s)::INT AS small_h, round(w::DOUBLE / floor(w * s)::INT, 6) AS scale_x, round(h::DOUBLE / floor(h * s)::INT, 6) AS scale_y, floor((640 - floor(w * b)) / 2)::INT AS pad_x, floor((640 - floor(h * b)) / 2)::INT AS pad_y FROM k""",
)
def picture_sizes(spark, sf_dir):
    w, h = F.col("width"), F.col("height")
    scale, sw, sh = g.shrunk(w, h, F.lit(800))
    fx, fy = g.scale_factors(w, h, F.lit(800))
    _, px, py = g.letterbox(w, h, F.lit(640))
    return _sizes(spark, sf_dir).select("event_id", _r(scale, "scale"), sw.alias("small_w"), sh.alias("small_h"), _r(fx, "scale_x"), _r(fy, "scale_y"), px.alias("pad_x"), py.alias("pad_y"))


@query(
    "annotations",
    """SELECT det_id, trunc(x * 0.5)::INT AS x, trunc(y * 0.5)::INT AS y, trunc(greatest(w * 0.5, 1))::INT AS w, trunc(greatest(h * 0.5, 1))::INT AS h,
 CASE WHEN det_id % 3 = 0 THEN '#' || det_id || ' ' ELSE '' END || 'class_' || class_id || ' ' || round_even(round(confidence, 6) * 100, 0)::INT || '%' AS label, trunc(h * 0.5) > 20 AND trunc(w * 0.5) > 30 AS show_label FROM d WHERE w > 0 AND h > 0""",
    "d",
)
def annotations(spark, sf_dir):
    x, y, w, h = (c * 0.5 for c in g.columns())
    track = F.when(F.col("det_id") % 3 == 0, F.col("det_id"))
    iw, ih = (F.greatest(c, F.lit(1.0)).cast("int") for c in (w, h))
    out = dense(spark, sf_dir).where("w > 0 and h > 0")
    return out.select("det_id", x.cast("int").alias("x"), y.cast("int").alias("y"), iw.alias("w"), ih.alias("h"), lb.caption(lb.fallback(F.col("class_id")), F.round("confidence", 6), track).alias("label"), ((ih > 20) & (iw > 30)).alias("show_label"))


@query("flipped_boxes", "SELECT det_id, round(x / 1919, 6) AS x, round(1 - y / 1079 - h / 1079, 6) AS y, round(w / 1919, 6) AS w, round(h / 1079, 6) AS h FROM d", "d")
def flipped_boxes(spark, sf_dir):
    b = g.flipped(g.to_normalized(g.columns(), F.lit(1919), F.lit(1079)))
    return dense(spark, sf_dir).select("det_id", *[_r(c, k) for c, k in zip(b, "xywh", strict=True)])


@query("nested_results", "SELECT stream_id, frame_id, det_id, round(confidence, 6) AS confidence FROM d WHERE confidence >= 0.5", "d")
def nested_results(spark, sf_dir):
    """A picture's detections as an array (one result row), filtered there and exploded again."""
    rows = dense(spark, sf_dir).groupBy("stream_id", "frame_id").agg(F.collect_list(F.struct("det_id", "confidence")).alias("detections"))
    return rows.select("stream_id", "frame_id", F.explode(F.filter("detections", lambda s: s["confidence"] >= 0.5)).alias("s")).select("stream_id", "frame_id", "s.det_id", _r(F.col("s.confidence"), "confidence"))


@query("label_lines", "SELECT det_id, class_id || ' ' || printf('%.6f %.6f %.6f %.6f', (x + w / 2) / 1919, (y + h / 2) / 1079, w / 1919, h / 1079) AS line FROM d", "d")
def label_lines(spark, sf_dir):
    from boxtrail.sources.files import label_line

    return dense(spark, sf_dir).select("det_id", label_line(F.lit(1919), F.lit(1079)).alias("line"))


@query("rescaled", "SELECT det_id, round(x * 1.5, 6) AS x, round(y * 0.75, 6) AS y, round(w * 1.5, 6) AS w, round(h * 0.75, 6) AS h, round((x - lag(x) OVER p) * 1.5, 6) AS vx, round((y - lag(y) OVER p) * 0.75, 6) AS vy FROM s WINDOW p AS (PARTITION BY stream_id, gt_id ORDER BY frame_id)", "s")
def rescaled(spark, sf_dir):
    from pyspark.sql import Window

    p = Window.partitionBy("stream_id", "gt_id").orderBy("frame_id")
    s = smooth(spark, sf_dir)
    return s.select("det_id", *[_r(F.col(c) * k, c) for c, k in (("x", 1.5), ("y", 0.75), ("w", 1.5), ("h", 0.75))], *[_r((F.col(c) - F.lag(c).over(p)) * k, f"v{c}") for c, k in (("x", 1.5), ("y", 0.75))])


# --- filters ------------------------------------------------------------------------------------


@query("confidence_filter", "SELECT det_id FROM d WHERE confidence >= 0.5", "d")
def confidence_filter(spark, sf_dir):
    return dense(spark, sf_dir).where(F.col("confidence") >= 0.5).select("det_id")


@query("class_filter", "SELECT det_id FROM d WHERE class_id = 1", "d")
def class_filter(spark, sf_dir):
    return dense(spark, sf_dir).where(F.col("class_id") == 1).select("det_id")


@query("class_list_filter", "SELECT det_id, 'some' AS list FROM d WHERE class_id IN (0, 2, 3) UNION ALL SELECT det_id, 'all' FROM d", "d")
def class_list_filter(spark, sf_dir):
    """A list of classes; an empty one lets all pass."""
    d = dense(spark, sf_dir)
    allow = lambda ids: d.where(F.col("class_id").isin(*ids)) if ids else d
    return allow([0, 2, 3]).select("det_id", F.lit("some").alias("list")).unionByName(allow([]).select("det_id", F.lit("all").alias("list")))


@query("class_name_filter", "SELECT det_id, CASE class_id WHEN 0 THEN 'Person' ELSE 'Bicycle' END AS class_name FROM d WHERE class_id = 0", "d")
def class_name_filter(spark, sf_dir):
    named = lb.with_names(dense(spark, sf_dir), lb.label_table(spark)).withColumn("class_name", lb.capitalized(F.col("class_name")))
    return named.where(F.col("class_name").isin("Person", "car")).select("det_id", "class_name")


@query("valid_boxes", "SELECT det_id, w >= 1 AND h >= 1 AS drawable, x < x + w AND y < y + h AND x <> 0 AND y <> 0 AS normal FROM d WHERE w > 0 AND h > 0", "d")
def valid_boxes(spark, sf_dir):
    return dense(spark, sf_dir).where("w > 0 and h > 0").select("det_id", ((F.col("w") >= 1) & (F.col("h") >= 1)).alias("drawable"), g.valid_prediction(_corner()).alias("normal"))


@query("score_split", "SELECT det_id, CASE WHEN confidence >= 0.5 THEN 'high' ELSE 'low' END AS part FROM d WHERE confidence >= 0.1", "d")
def score_split(spark, sf_dir):
    part = F.when(F.col("confidence") >= 0.5, "high").when(F.col("confidence") >= 0.1, "low")
    return dense(spark, sf_dir).withColumn("part", part).where(F.col("part").isNotNull()).select("det_id", "part")


_PAIR = "FROM d a JOIN d b ON a.stream_id = b.stream_id AND a.frame_id = b.frame_id"
_W, _H = "(least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x))", "(least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y))"
_IOU = f"CASE WHEN {_W} > 0 AND {_H} > 0 THEN {_W} * {_H} / (a.w * a.h + b.w * b.h - {_W} * {_H}) ELSE 0 END"
_IN = "a.x >= greatest(b.x - 10, 0) AND a.y >= greatest(b.y - 10, 0) AND a.x + a.w <= b.x + b.w + 10 AND a.y + a.h <= b.y + b.h + 10"


@query("box_relations", f"SELECT a.det_id AS l_id, b.det_id AS r_id, {_W} > 0 AND {_H} > 0 AS intersects, {_IN} AS inside {_PAIR} WHERE a.det_id <> b.det_id", "d")
def box_relations(spark, sf_dir):
    d = dense(spark, sf_dir)
    p = pairs.dense_pairs(d, d).where("l_det_id <> r_det_id")
    a, b = _corner("l_"), _corner("r_")
    return p.select(F.col("l_det_id").alias("l_id"), F.col("r_det_id").alias("r_id"), g.intersects(a, b).alias("intersects"), g.contains(b, a).alias("inside"))


# --- joins --------------------------------------------------------------------------------------

_PAIRS_SQL = f"SELECT a.stream_id, a.frame_id, a.det_id AS l_id, b.det_id AS r_id, {_IOU} AS iou {_PAIR} WHERE a.class_id = 0 AND b.class_id = 1 AND {_W} > 0 AND {_H} > 0"


def _sides(spark, sf_dir):
    d = dense(spark, sf_dir)
    return d.where("class_id = 0"), d.where("class_id = 1")


@query("iou_dense", f"SELECT stream_id, frame_id, l_id, r_id, round(iou, 6) AS iou FROM ({_PAIRS_SQL})", "d")
def iou_dense(spark, sf_dir):
    return pairs.pair_join(*_sides(spark, sf_dir), "dense").withColumn("iou", F.round("iou", 6))


@query("iou_grid", f"SELECT stream_id, frame_id, l_id, r_id, round(iou, 6) AS iou FROM ({_PAIRS_SQL})", "d")
def iou_grid(spark, sf_dir):
    return pairs.pair_join(*_sides(spark, sf_dir), "grid").withColumn("iou", F.round("iou", 6))


_CELLS = "c AS (SELECT *, unnest(range(floor(x / 100)::BIGINT, ceil((x + w) / 100)::BIGINT + 1)) AS cx FROM d), e AS (SELECT *, unnest(range(floor(y / 100)::BIGINT, ceil((y + h) / 100)::BIGINT + 1)) AS cy FROM c)"


@query("grid_candidates", f"WITH {_CELLS} SELECT DISTINCT a.stream_id, a.frame_id, a.det_id AS l_id, b.det_id AS r_id FROM e a JOIN e b ON a.stream_id = b.stream_id AND a.frame_id = b.frame_id AND a.cx = b.cx AND a.cy = b.cy WHERE a.class_id = 0 AND b.class_id = 1", "d")
def grid_candidates(spark, sf_dir):
    return pairs.grid_candidates(*_sides(spark, sf_dir))


@query("grid_stats", f"WITH {_CELLS}, n AS (SELECT stream_id, frame_id, cx, cy, count(*) AS n FROM e GROUP BY ALL) SELECT stream_id, frame_id, count(*) AS total_cells, sum(n)::BIGINT AS total_entries, max(n) AS max_entries, round(avg(n), 6) AS avg_entries FROM n GROUP BY ALL", "d")
def grid_stats(spark, sf_dir):
    return pairs.grid_stats(dense(spark, sf_dir)).withColumn("avg_entries", F.round("avg_entries", 6))


@query("grid_efficiency", f"""WITH {_CELLS}, q AS (SELECT a.stream_id, a.frame_id, count(DISTINCT (a.det_id, b.det_id)) AS candidate_pairs FROM e a JOIN e b ON a.stream_id = b.stream_id AND a.frame_id = b.frame_id AND a.cx = b.cx AND a.cy = b.cy WHERE a.class_id = 0 AND b.class_id = 1 GROUP BY ALL),
 n AS (SELECT stream_id, frame_id, count(*) FILTER (class_id = 0) * count(*) FILTER (class_id = 1) AS possible_pairs FROM d GROUP BY ALL)
 SELECT n.stream_id, n.frame_id, possible_pairs, coalesce(candidate_pairs, 0) AS candidate_pairs, round(1 - coalesce(candidate_pairs, 0) / possible_pairs::DOUBLE, 6) AS reduction FROM n LEFT JOIN q USING (stream_id, frame_id) WHERE possible_pairs > 0""", "d")
def grid_efficiency(spark, sf_dir):
    return pairs.grid_efficiency(*_sides(spark, sf_dir)).withColumn("reduction", F.round("reduction", 6))


_GREEDY = """WITH p AS (SELECT * FROM (@PAIRS) WHERE iou > @MOST),
 q AS (SELECT stream_id, frame_id, list({'o': -iou, 'l': l_id, 'r': r_id} ORDER BY iou DESC, l_id, r_id) AS a FROM p GROUP BY ALL),
 n AS (SELECT stream_id, frame_id, a, 1 AS i, [a[1]] AS k FROM q UNION ALL SELECT stream_id, frame_id, a, i + 1, CASE WHEN len(list_filter(k, lambda t: t.l = a[i + 1].l OR t.r = a[i + 1].r)) > 0 THEN k ELSE list_append(k, a[i + 1]) END FROM n WHERE i < len(a)),
 m AS (SELECT stream_id, frame_id, unnest(k) AS t FROM n WHERE i = len(a)) """.replace("@PAIRS", _PAIRS_SQL)


@query("greedy_assignment", _GREEDY.replace("@MOST", "0.1") + "SELECT stream_id, frame_id, t.l AS l_id, t.r AS r_id, round(-t.o, 6) AS iou FROM m", "d", recursive=True)
def greedy_assignment(spark, sf_dir):
    return assign.greedy_pairs(pairs.pair_join(*_sides(spark, sf_dir)), 0.1).withColumn("iou", F.round("iou", 6))


@query("unassigned", _GREEDY.replace("@MOST", "0.6") + "SELECT det_id, 'l' AS side FROM d WHERE class_id = 0 AND det_id NOT IN (SELECT t.l FROM m) UNION ALL SELECT det_id, 'r' FROM d WHERE class_id = 1 AND det_id NOT IN (SELECT t.r FROM m)", "d", recursive=True)
def unassigned(spark, sf_dir):
    left, right = _sides(spark, sf_dir)
    got = assign.greedy_pairs(pairs.pair_join(left, right), 0.6)
    side = lambda rows, s: assign.unassigned(rows, got, s).select("det_id", F.lit(s).alias("side"))
    return side(left, "l").unionByName(side(right, "r"))


@query("best_assignment")
def best_assignment(spark, sf_dir):
    """Least-cost one-to-one pairs by picture (no SQL; held against all permutations in the tests)."""
    return assign.best_pairs(pairs.pair_join(*_sides(spark, sf_dir)), 0.1).withColumn("iou", F.round("iou", 6))


_BEST = "WITH p AS (" + _PAIRS_SQL + """), q AS (SELECT * FROM p WHERE iou > @MOST), l AS (SELECT stream_id, frame_id, l_id, row_number() OVER (PARTITION BY stream_id, frame_id ORDER BY l_id) AS i FROM (SELECT DISTINCT stream_id, frame_id, l_id FROM q)),
 c AS (SELECT stream_id, frame_id, i, r_id, floor((1 - iou) * 1000)::BIGINT AS cost FROM q JOIN l USING (stream_id, frame_id, l_id) UNION ALL SELECT stream_id, frame_id, i, NULL, 0 FROM l),
 n AS (SELECT stream_id, frame_id, max(i) AS m, 0::BIGINT AS i, []::BIGINT[] AS used, 0::BIGINT AS cost FROM l GROUP BY ALL
  UNION ALL SELECT n.stream_id, n.frame_id, m, n.i + 1, CASE WHEN c.r_id IS NULL THEN used ELSE list_append(used, c.r_id) END, n.cost + c.cost FROM n JOIN c ON n.stream_id = c.stream_id AND n.frame_id = c.frame_id AND c.i = n.i + 1 WHERE c.r_id IS NULL OR NOT list_contains(used, c.r_id)) """


@query("assignment_cost", _BEST.replace("@MOST", "0.1") + "SELECT stream_id, frame_id, n_pairs, cost FROM (SELECT stream_id, frame_id, len(used) AS n_pairs, min(cost) / 1000 AS cost, row_number() OVER (PARTITION BY stream_id, frame_id ORDER BY len(used) DESC) AS best FROM n WHERE i = m GROUP BY stream_id, frame_id, len(used)) WHERE best = 1", "d", recursive=True)
def assignment_cost(spark, sf_dir):
    """Pairs and total cost of the least-cost assignment of each picture; the SQL tries every assignment."""
    return assign.total_cost(assign.best_pairs(pairs.pair_join(*_sides(spark, sf_dir)), 0.1))


@query("assignment_vector", _GREEDY.replace("@MOST", "0.1") + "SELECT d.det_id, m.t.r AS r_id FROM d LEFT JOIN m ON m.t.l = d.det_id WHERE d.class_id = 0", "d", recursive=True)
def assignment_vector(spark, sf_dir):
    left, right = _sides(spark, sf_dir)
    return assign.assigned(left, assign.greedy_pairs(pairs.pair_join(left, right), 0.1)).select("det_id", "r_id")


@query("capture_info", f"WITH f AS (SELECT stream_id, frame_id, min(ts) AS ts, count(*) AS n_detections, sum(w)::DOUBLE / 10 AS ms FROM d GROUP BY ALL), e AS (SELECT stream_id, count(*) AS n, max(epoch_us(ts)) - min(epoch_us(ts)) AS span, max(frame_id) AS last FROM f GROUP BY 1), r AS (SELECT stream_id, last, CASE WHEN stream_id % 2 = 0 THEN 20.0 ELSE (n - 1) * 1e6 / span END::DOUBLE AS fps FROM e) SELECT stream_id, frame_id, round(fps, 6) AS fps, round((row_number() OVER (PARTITION BY stream_id ORDER BY frame_id) - 1) / fps, 6) AS due, frame_id = last AS is_last FROM f JOIN r USING (stream_id)", "d")
def capture_info(spark, sf_dir):
    """Streams that declare a rate of 0 get 20 frames a second, the others the rate of their frames."""
    frames = _frames(spark, sf_dir).withColumn("said", F.when(F.col("stream_id") % 2 == 0, 0.0))
    return analytics.capture_info(frames, declared="said").select("stream_id", "frame_id", _r(F.col("fps"), "fps"), _r(F.col("due"), "due"), "is_last")


@query("class_names", "SELECT det_id, CASE (det_id % 4) * 1000 + class_id WHEN 0 THEN 'person' WHEN 1 THEN 'bicycle' WHEN 1000 THEN 'cow' WHEN 1001 THEN 'class_81' WHEN 2000 THEN 'class_363' WHEN 2001 THEN 'flashlight' WHEN 3000 THEN 'toothbrush' ELSE 'class_365' END AS class_name FROM d", "d")
def class_names(spark, sf_dir):
    """COCO's names, then those of a table of more classes (here two of them), then class_N."""
    part, c = F.col("det_id") % 4, F.col("class_id")
    beyond = F.when(part == 0, c).when(part == 1, c + 80).when(part == 2, c + 363).otherwise(F.when(c == 0, 79).otherwise(365))
    more = spark.createDataFrame([(2, "chair"), (80, "cow"), (364, "flashlight")], "class_id long, class_name string")
    return lb.with_names(dense(spark, sf_dir).withColumn("class_id", beyond), lb.label_table(spark, more)).select("det_id", "class_name")


_NMS = """WITH g AS (SELECT stream_id, frame_id, class_id, list({'det_id': det_id, 'x': x, 'y': y, 'w': w, 'h': h, 'c': confidence} ORDER BY confidence DESC, det_id) AS a FROM d GROUP BY ALL),
 n AS (SELECT stream_id, frame_id, class_id, a, 1 AS i, [a[1]] AS k FROM g UNION ALL
  SELECT stream_id, frame_id, class_id, a, i + 1, CASE WHEN len(list_filter(k, lambda t: CASE WHEN least(t.x + t.w, a[i+1].x + a[i+1].w) > greatest(t.x, a[i+1].x) AND least(t.y + t.h, a[i+1].y + a[i+1].h) > greatest(t.y, a[i+1].y) THEN
   (least(t.x + t.w, a[i+1].x + a[i+1].w) - greatest(t.x, a[i+1].x)) * (least(t.y + t.h, a[i+1].y + a[i+1].h) - greatest(t.y, a[i+1].y)) / (t.w * t.h + a[i+1].w * a[i+1].h - (least(t.x + t.w, a[i+1].x + a[i+1].w) - greatest(t.x, a[i+1].x)) * (least(t.y + t.h, a[i+1].y + a[i+1].h) - greatest(t.y, a[i+1].y))) ELSE 0 END > 0.5)) > 0 THEN k ELSE list_append(k, a[i+1]) END FROM n WHERE i < len(a)),
 kept AS (SELECT stream_id, frame_id, class_id, unnest(k) AS t FROM n WHERE i = len(a)), u AS (SELECT stream_id, frame_id, class_id, t.det_id, t.x, t.y, t.w, t.h, t.c AS confidence FROM kept),
 nest AS (SELECT DISTINCT a.det_id FROM u a JOIN u b ON a.stream_id = b.stream_id AND a.frame_id = b.frame_id AND a.class_id = b.class_id AND a.det_id <> b.det_id AND """ + _IN + """) """


@query("suppressed", _NMS + "SELECT stream_id, frame_id, class_id, det_id, round(confidence, 6) AS confidence FROM u", "d", recursive=True)
def suppressed(spark, sf_dir):
    return suppress.suppress(dense(spark, sf_dir)).select("stream_id", "frame_id", "class_id", "det_id", _r(F.col("confidence"), "confidence"))


@query("nested_boxes", f"SELECT DISTINCT a.stream_id, a.frame_id, a.det_id {_PAIR} AND a.class_id = b.class_id AND a.det_id <> b.det_id WHERE {_IN}", "d")
def nested_boxes(spark, sf_dir):
    return suppress.nested(dense(spark, sf_dir))


@query("postprocess", _NMS + "SELECT stream_id, frame_id, class_id, det_id FROM u WHERE det_id NOT IN (SELECT det_id FROM nest)", "d", recursive=True)
def postprocess(spark, sf_dir):
    return suppress.postprocess(dense(spark, sf_dir)).select("stream_id", "frame_id", "class_id", "det_id")


@query("removal_counters", _NMS + """SELECT d.stream_id, d.frame_id, count(*) AS n_in, count(*) - count(u.det_id) AS duplicates_removed, count(nest.det_id) AS nested_removed, count(u.det_id) - count(nest.det_id) AS n_kept
 FROM d LEFT JOIN u USING (det_id) LEFT JOIN nest USING (det_id) GROUP BY 1, 2""", "d", recursive=True)
def removal_counters(spark, sf_dir):
    return suppress.counters(dense(spark, sf_dir))


@query("kept_class_distribution", _NMS + """, l AS (SELECT * FROM (VALUES (0::BIGINT, 'person'), (1::BIGINT, 'bicycle'), (2::BIGINT, 'car')) v(class_id, class_name))
 SELECT class_id, class_name, count(det_id) AS n, round(coalesce(avg(confidence), 0), 6) AS avg_confidence, round(coalesce(stddev_pop(confidence), 0), 6) AS std_confidence, round(coalesce(min(confidence), 0), 6) AS min_confidence, round(coalesce(max(confidence), 0), 6) AS max_confidence
 FROM l LEFT JOIN u USING (class_id) GROUP BY 1, 2""", "d", recursive=True)
def kept_class_distribution(spark, sf_dir):
    return analytics.class_distribution(suppress.suppress(dense(spark, sf_dir)), lb.label_table(spark).where("class_id < 3"))


# --- aggregations and windows -------------------------------------------------------------------

_FRAMES = "f AS (SELECT stream_id, frame_id, min(ts) AS ts, count(*) AS n_detections, sum(w)::DOUBLE / 10 AS ms FROM d GROUP BY ALL)"


def _frames(spark, sf_dir):
    return dense(spark, sf_dir).groupBy("stream_id", "frame_id").agg(F.min("ts").alias("ts"), F.count("*").alias("n_detections"), (F.sum("w") / 10).alias("ms"))


@query("video_summary", f"WITH {_FRAMES} SELECT count(*) AS total_frames, sum(n_detections)::BIGINT AS total_detections, round(avg(ms), 6) AS avg_ms, round(1000 / avg(ms), 6) AS avg_fps FROM f", "d")
def video_summary(spark, sf_dir):
    return analytics.video_summary(_frames(spark, sf_dir))


@query("latency", f"WITH {_FRAMES}, r AS (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY frame_id) AS n FROM f) SELECT stream_id, count(*) AS n, round(avg(ms), 6) AS mean_ms, round(stddev_pop(ms), 6) AS std_ms, round(min(ms), 6) AS min_ms, round(max(ms), 6) AS max_ms, round(1000 / avg(ms), 6) AS fps FROM r WHERE n > 10 GROUP BY 1", "d")
def latency(spark, sf_dir):
    return analytics.latency(_frames(spark, sf_dir), "frame_id")


@query("moving_average", f"WITH {_FRAMES} SELECT stream_id, frame_id, round(avg(ms) OVER w, 6) AS avg_ms, round(1000 / avg(ms) OVER w, 6) AS fps FROM f WINDOW w AS (PARTITION BY stream_id ORDER BY frame_id ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)", "d")
def moving_average(spark, sf_dir):
    avg = analytics.moving_average("ms", "stream_id", "frame_id")
    return _frames(spark, sf_dir).select("stream_id", "frame_id", _r(avg, "avg_ms"), _r(F.lit(1000.0) / avg, "fps"))


@query("frame_steps", f"WITH {_FRAMES} SELECT stream_id, frame_id, round(greatest(0.001, least(0.2, coalesce((epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY stream_id ORDER BY ts)) / 1e6, 0))), 6)::DOUBLE AS dt FROM f", "d")
def frame_steps(spark, sf_dir):
    return _frames(spark, sf_dir).withColumn("dt", F.round(analytics.frame_steps(None), 6)).select("stream_id", "frame_id", "dt")


@query("every_tenth", f"WITH {_FRAMES}, r AS (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY frame_id) AS n FROM f) SELECT stream_id, frame_id, n_detections FROM r WHERE n % 10 = 0", "d")
def every_tenth(spark, sf_dir):
    return analytics.every_nth(_frames(spark, sf_dir), "stream_id", "frame_id", 10).select("stream_id", "frame_id", "n_detections")


@query("sighting_streaks", "WITH r AS (SELECT DISTINCT stream_id, gt_id, frame_id FROM s), i AS (SELECT *, frame_id - row_number() OVER (PARTITION BY stream_id, gt_id ORDER BY frame_id) AS k FROM r) SELECT stream_id, gt_id, min(frame_id) AS first_frame, max(frame_id) AS last_frame, count(*) AS hit_streak FROM i GROUP BY stream_id, gt_id, k", "s")
def sighting_streaks(spark, sf_dir):
    return analytics.streaks(smooth(spark, sf_dir))


@query("last_known_class", "SELECT stream_id, gt_id, frame_id, det_id, last_value(CASE WHEN det_id % 3 = 0 THEN det_id % 7 END IGNORE NULLS) OVER (PARTITION BY stream_id, gt_id ORDER BY frame_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS class_id FROM s", "s")
def last_known_class(spark, sf_dir):
    s = smooth(spark, sf_dir).withColumn("seen", F.when(F.col("det_id") % 3 == 0, F.col("det_id") % 7))
    return s.select("stream_id", "gt_id", "frame_id", "det_id", analytics.last_known(s, "seen", ("stream_id", "gt_id"), "frame_id").alias("class_id"))


@query("with_metadata", "SELECT a.det_id, m.class_id FROM s a JOIN (SELECT stream_id, gt_id, max(det_id % 5) AS class_id FROM s WHERE gt_id % 2 = 0 GROUP BY ALL) m USING (stream_id, gt_id)", "s")
def with_metadata(spark, sf_dir):
    """Tracks with what is known of them; those without are left out."""
    s = smooth(spark, sf_dir)
    known = s.where("gt_id % 2 = 0").groupBy("stream_id", "gt_id").agg(F.max(F.col("det_id") % 5).alias("class_id"))
    return s.join(known, ["stream_id", "gt_id"]).select("det_id", "class_id")


@query("by_confidence", "SELECT det_id, row_number() OVER (PARTITION BY stream_id, frame_id ORDER BY confidence DESC, det_id) AS place FROM d", "d")
def by_confidence(spark, sf_dir):
    return analytics.top_k(dense(spark, sf_dir), ("stream_id", "frame_id"), 2**31 - 1).select("det_id", F.col("rank").cast("long").alias("place"))


@query("top_three", "SELECT det_id FROM (SELECT *, row_number() OVER (PARTITION BY stream_id, frame_id ORDER BY confidence DESC, det_id) AS n FROM d) WHERE n <= 3", "d")
def top_three(spark, sf_dir):
    return analytics.top_k(dense(spark, sf_dir), ("stream_id", "frame_id"), 3).select("det_id")


@query("latest_frame", "SELECT stream_id, max(frame_id) AS frame_id, max(det_id) AS det_id FROM d WHERE (stream_id, frame_id) IN (SELECT (stream_id, max(frame_id)) FROM d GROUP BY stream_id) GROUP BY stream_id", "d")
def latest_frame(spark, sf_dir):
    return analytics.latest(dense(spark, sf_dir), "stream_id", "frame_id", ["frame_id", "det_id"])


@query("run_stats", "SELECT stream_id, count(*) AS detections, count(DISTINCT frame_id) AS frames, count(DISTINCT gt_id) AS active, sum(CASE WHEN confidence >= 0.7 THEN 1 ELSE 0 END)::BIGINT AS confident, round(avg(confidence), 6) AS avg_confidence FROM s GROUP BY 1", "s")
def run_stats(spark, sf_dir):
    return smooth(spark, sf_dir).groupBy("stream_id").agg(F.count("*").alias("detections"), F.countDistinct("frame_id").alias("frames"), F.countDistinct("gt_id").alias("active"), F.sum(F.when(F.col("confidence") >= 0.7, 1).otherwise(0)).alias("confident"), _r(F.avg("confidence"), "avg_confidence"))


@query("scene_totals", "SELECT count(DISTINCT (stream_id, frame_id)) AS scenes, count(*) AS objects FROM d", "d")
def scene_totals(spark, sf_dir):
    scenes = dense(spark, sf_dir).groupBy("stream_id", "frame_id").agg(F.collect_list("det_id").alias("annotations"))
    return scenes.agg(F.count("*").alias("scenes"), F.sum(F.size("annotations")).alias("objects"))


@query("label_quality", "SELECT quality, toxic, count(*) AS n FROM labels GROUP BY ALL")
def label_quality(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/labels.parquet").groupBy("quality", "toxic").agg(F.count("*").alias("n"))


@query("event_sessions", "WITH e AS (SELECT *, CASE WHEN ts - lag(ts) OVER p > INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS new FROM events WINDOW p AS (PARTITION BY user_id ORDER BY ts)), k AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM e) SELECT user_id, min(event_id) AS first_event, count(*) AS n FROM k GROUP BY user_id, session")
def event_sessions(spark, sf_dir):
    from pyspark.sql import Window

    p = Window.partitionBy("user_id").orderBy("ts")
    gap = F.coalesce((F.col("ts") - F.lag("ts").over(p)) > F.expr("interval 30 minutes"), F.lit(False)).cast("int")
    e = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("new", gap)
    return e.withColumn("session", F.sum("new").over(p.rowsBetween(Window.unboundedPreceding, 0))).groupBy("user_id", "session").agg(F.min("event_id").alias("first_event"), F.count("*").alias("n")).drop("session")


@query("average_precision")
def average_precision(spark, sf_dir):
    """Of the dense detections against those of a confidence of 0.5 and more as truth (no SQL here; tested by hand)."""
    d = dense(spark, sf_dir)
    return analytics.average_precision(d, d.where("confidence >= 0.5"))


# --- scalar functions ---------------------------------------------------------------------------


@query("hue_colors", "SELECT id, floor((m + CASE k WHEN 0 THEN c WHEN 1 THEN x WHEN 4 THEN x WHEN 5 THEN c ELSE 0 END) * 255)::INT AS r, floor((m + CASE k WHEN 0 THEN x WHEN 1 THEN c WHEN 2 THEN c WHEN 3 THEN x ELSE 0 END) * 255)::INT AS g, floor((m + CASE k WHEN 2 THEN x WHEN 3 THEN c WHEN 4 THEN c WHEN 5 THEN x ELSE 0 END) * 255)::INT AS b FROM (SELECT id, 0.9::DOUBLE * 0.7::DOUBLE AS c, 0.9::DOUBLE * 0.7::DOUBLE * (1 - abs(fmod(hue / 60.0::DOUBLE, 2) - 1)) AS x, 0.9::DOUBLE - 0.9::DOUBLE * 0.7::DOUBLE AS m, hue // 60 AS k FROM (SELECT event_id AS id, (event_id * 137) % 360 AS hue FROM events))")
def hue_colors(spark, sf_dir):
    rgb = lb.hue_color(F.col("event_id"))
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("id"), *[c.alias(k) for c, k in zip(rgb, "rgb", strict=True)])


_HASH = "(({0})::HUGEINT * 2654435761 % 4294967296)::BIGINT"


@query(
    "hash_colors",
    f"""WITH a AS (SELECT event_id AS id, {_HASH.format("event_id")} AS h1 FROM events), b AS (SELECT *, {_HASH.format("h1")} AS h2 FROM a), c AS (SELECT id, h1 % 256 AS r, h2 % 256 AS g, {_HASH.format("h2")} % 256 AS b FROM b),
 e AS (SELECT id, greatest(least(r, 180), CASE WHEN r > g AND r > b THEN 100 ELSE 40 END) AS r, g, b FROM c), f AS (SELECT id, r, greatest(least(g, 180), CASE WHEN g > r AND g > b THEN 100 ELSE 40 END) AS g, b FROM e)
 SELECT id, r::INT AS r, g::INT AS g, greatest(least(b, 180), CASE WHEN b > r AND b > g THEN 100 ELSE 40 END)::INT AS b FROM f""",
)
def hash_colors(spark, sf_dir):
    rgb = lb.hash_color(F.col("event_id"))
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("id"), *[c.alias(k) for c, k in zip(rgb, "rgb", strict=True)])


@query("palette", "SELECT det_id, (['red', 'green', 'blue', 'yellow'])[(det_id % 4 + 1)::INT] AS color FROM d", "d")
def palette(spark, sf_dir):
    return dense(spark, sf_dir).select("det_id", lb.palette_color(F.col("det_id"), ["red", "green", "blue", "yellow"]).alias("color"))


@query("text_functions", "SELECT event_id, upper(event_type[1]) || event_type[2:] AS name, upper(event_type) AS glyphs, CASE WHEN event_id % 3 = 0 THEN 2 ELSE 1 END::BIGINT AS ids, round(greatest(least(value, 1), 0), 6) AS share FROM events")
def text_functions(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    listed = F.when(F.col("event_id") % 3 == 0, F.lit("0, 2,x")).otherwise(F.lit("7,,a"))
    return e.select("event_id", lb.capitalized(F.col("event_type")).alias("name"), F.upper("event_type").alias("glyphs"), F.size(lb.parse_ids(listed)).cast("long").alias("ids"), _r(lb.parse_percent((F.col("value") * 100).cast("string")), "share"))


@query(
    "models",
    """SELECT upper(name) AS name, variant, 'rtdetr_v2_' || variant || '.onnx' AS file, shown FROM (VALUES
 ('r18vd_fp16', 'r18vd_fp16', 'RT-DETR R18 (FP16)'), ('r18_fp16', 'r18vd_fp16', 'RT-DETR R18 (FP16)'), ('r18-fp16', 'r18vd_fp16', 'RT-DETR R18 (FP16)'),
 ('r18vd_fp32', 'r18vd_fp32', 'RT-DETR R18 (FP32)'), ('r18_fp32', 'r18vd_fp32', 'RT-DETR R18 (FP32)'), ('r18-fp32', 'r18vd_fp32', 'RT-DETR R18 (FP32)'), ('r18vd', 'r18vd_fp32', 'RT-DETR R18 (FP32)'), ('r18', 'r18vd_fp32', 'RT-DETR R18 (FP32)'),
 ('r34vd_fp16', 'r34vd_fp16', 'RT-DETR R34 (FP16)'), ('r34_fp16', 'r34vd_fp16', 'RT-DETR R34 (FP16)'), ('r34-fp16', 'r34vd_fp16', 'RT-DETR R34 (FP16)'),
 ('r34vd_fp32', 'r34vd_fp32', 'RT-DETR R34 (FP32)'), ('r34_fp32', 'r34vd_fp32', 'RT-DETR R34 (FP32)'), ('r34-fp32', 'r34vd_fp32', 'RT-DETR R34 (FP32)'), ('r34vd', 'r34vd_fp32', 'RT-DETR R34 (FP32)'), ('r34', 'r34vd_fp32', 'RT-DETR R34 (FP32)'),
 ('r50vd_fp16', 'r50vd_fp16', 'RT-DETR R50 (FP16)'), ('r50_fp16', 'r50vd_fp16', 'RT-DETR R50 (FP16)'), ('r50-fp16', 'r50vd_fp16', 'RT-DETR R50 (FP16)'),
 ('r50vd_fp32', 'r50vd_fp32', 'RT-DETR R50 (FP32)'), ('r50_fp32', 'r50vd_fp32', 'RT-DETR R50 (FP32)'), ('r50-fp32', 'r50vd_fp32', 'RT-DETR R50 (FP32)'), ('r50vd', 'r50vd_fp32', 'RT-DETR R50 (FP32)'), ('r50', 'r50vd_fp32', 'RT-DETR R50 (FP32)'),
 ('r50vd_uint8', 'r50vd_uint8', 'RT-DETR R50 (UINT8)'), ('r50_uint8', 'r50vd_uint8', 'RT-DETR R50 (UINT8)'), ('r50-uint8', 'r50vd_uint8', 'RT-DETR R50 (UINT8)'),
 ('r101vd_fp16', 'r101vd_fp16', 'RT-DETR R101 (FP16)'), ('r101_fp16', 'r101vd_fp16', 'RT-DETR R101 (FP16)'), ('r101-fp16', 'r101vd_fp16', 'RT-DETR R101 (FP16)'),
 ('r101vd_fp32', 'r101vd_fp32', 'RT-DETR R101 (FP32)'), ('r101_fp32', 'r101vd_fp32', 'RT-DETR R101 (FP32)'), ('r101-fp32', 'r101vd_fp32', 'RT-DETR R101 (FP32)'), ('r101vd', 'r101vd_fp32', 'RT-DETR R101 (FP32)'), ('r101', 'r101vd_fp32', 'RT-DETR R101 (FP32)')) v(name, variant, shown)""",
)
def models(spark, sf_dir):
    table = spark.createDataFrame([(v, f, n) for v, f, n, _ in lb.MODELS], "variant string, file string, shown string")
    names = spark.createDataFrame([(a.upper(),) for *_, aliases in lb.MODELS for a in aliases] + [("none",)], "name string")
    return names.withColumn("variant", lb.parse_model(F.col("name"))).join(table, "variant").select("name", "variant", "file", "shown")


# --- trackers -----------------------------------------------------------------------------------


def _tracked(spark, sf_dir, kind: str, **more) -> DataFrame:
    return tracking.track(smooth(spark, sf_dir).withColumn("class_id", F.col("gt_id")), tracking.TrackerConfig(kind=kind, **more))


def _shown(tracks: DataFrame) -> DataFrame:
    return tracks.select("stream_id", "frame_id", "track_id", *[_r(F.col(c), c, 3) for c in "xywh"], "det_id", "class_id", "age", "hits", "hit_streak", "steps_since_update", "is_extrapolated")


@query("track_sort")
def track_sort(spark, sf_dir):
    return _shown(_tracked(spark, sf_dir, "sort", return_all=True))


@query("track_kalman")
def track_kalman(spark, sf_dir):
    return _shown(_tracked(spark, sf_dir, "kalman", return_all=True))


@query("track_two_pass")
def track_two_pass(spark, sf_dir):
    return _shown(_tracked(spark, sf_dir, "two_pass", return_all=True))


_PURITY = "SELECT stream_id, gt_id, 1::BIGINT AS track_ids, count(*) AS updates, min(frame_id) AS first_frame, max(frame_id) AS last_frame FROM s GROUP BY 1, 2"


@query("track_purity", _PURITY, "s")
def track_purity(spark, sf_dir):
    """Each object keeps one track through its misses, and every sighting of it updates that track. A track's first
    frame creates it without an update's det_id being new, so created detections count as well."""
    t = _tracked(spark, sf_dir, "sort", return_all=True).where("det_id is not null").select("stream_id", "track_id", "det_id")
    s = smooth(spark, sf_dir).select("stream_id", "gt_id", "frame_id", "det_id")
    return s.join(t, ["stream_id", "det_id"]).groupBy("stream_id", "gt_id").agg(F.countDistinct("track_id").alias("track_ids"), F.count("*").alias("updates"), F.min("frame_id").alias("first_frame"), F.max("frame_id").alias("last_frame"))


@query("track_summary")
def track_summary(spark, sf_dir):
    return analytics.track_summary(_tracked(spark, sf_dir, "sort", return_all=True))


# --- chains -------------------------------------------------------------------------------------

_CHAIN_SQL = f"""WITH q AS (SELECT frame_id % 2 AS tile_idx, frame_id, query_id, class_id, conf, x, y, least(w, 1 - x) AS w, least(h, 1 - y) AS h FROM ({_DECODE_SQL}) WHERE conf >= 0.02 AND class_id % 2 = 0)
 SELECT frame_id, tile_idx * 1000000 + query_id AS det_id, CASE WHEN class_id = 0 THEN 'Person' WHEN class_id = 2 THEN 'Car' ELSE 'Class_' || class_id END AS class_name, round(x * 640 + CASE tile_idx WHEN 1 THEN 374 ELSE 0 END, 6) AS x, round(y * 640, 6) AS y, round(w * 640, 6) AS w, round(h * 640, 6) AS h FROM q"""


def _chain(spark, sf_dir):
    from boxtrail.config import DetectorConfig, PipelineConfig

    raw = raw_predictions(spark, sf_dir).withColumns({"stream_id": F.lit(0).cast("long"), "tile_idx": (F.col("frame_id") % 2).cast("int")})
    return raw, lb.label_table(spark).where("class_id in (0, 2)"), 1014, 640, DetectorConfig(confidence=0.02), PipelineConfig(classes=list(range(0, 64, 2)))


@query("tiled_detections", _CHAIN_SQL, "raw")
def tiled_detections(spark, sf_dir):
    """Model outputs of two tiles a frame, decoded, filtered, moved to the frame and named."""
    from boxtrail.operators.pipeline import detect

    return detect(*_chain(spark, sf_dir)).select("frame_id", "det_id", "class_name", *[_r(F.col(c), c) for c in "xywh"])


@query("cleaned_detections")
def cleaned_detections(spark, sf_dir):
    from boxtrail.operators.pipeline import detect_and_clean

    return detect_and_clean(*_chain(spark, sf_dir)).select("frame_id", "det_id", "class_name", *[_r(F.col(c), c) for c in "xywh"])


@query("enriched_tracks", _GREEDY.replace("@MOST", "0.3") + "SELECT d.det_id, e.class_id, round(e.confidence, 6) AS confidence FROM d LEFT JOIN m ON m.t.l = d.det_id LEFT JOIN d e ON e.det_id = m.t.r WHERE d.class_id = 0", "d", recursive=True)
def enriched_tracks(spark, sf_dir):
    """Boxes of one class as tracks, those of the other as detections that they take class and confidence from, greedily."""
    from boxtrail.operators.pipeline import enrich

    return enrich(*_sides(spark, sf_dir), method="greedy").select("det_id", "class_id", _r(F.col("confidence"), "confidence"))


@query("enriched_pictures", _BEST.replace("@MOST", "0.3") + ", b AS (SELECT stream_id, frame_id, max(len(used)) AS known FROM n WHERE i = m GROUP BY ALL) SELECT stream_id, frame_id, count(*) AS tracks, coalesce(any_value(known), 0) AS known FROM d LEFT JOIN b USING (stream_id, frame_id) WHERE class_id = 0 GROUP BY ALL", "d", recursive=True)
def enriched_pictures(spark, sf_dir):
    """By picture, how many boxes take a class by the assignment of least cost; the SQL tries every assignment."""
    from boxtrail.operators.pipeline import enrich

    return enrich(*_sides(spark, sf_dir)).groupBy("stream_id", "frame_id").agg(F.count("*").alias("tracks"), F.count("class_id").alias("known"))


@query("overlay_lines", "SELECT stream_id, frame_id, 'Frame: ' || frame_id || ' # Tracks: ' || n || ' # Runs: ' || row_number() OVER (PARTITION BY stream_id ORDER BY frame_id) AS line FROM (SELECT stream_id, frame_id, count(DISTINCT gt_id) AS n FROM s GROUP BY 1, 2)", "s")
def overlay_lines(spark, sf_dir):
    from boxtrail.operators.pipeline import overlay

    return overlay(smooth(spark, sf_dir).withColumn("track_id", F.col("gt_id")))


# --- streaming ----------------------------------------------------------------------------------


@query("stream_track_purity", _PURITY, "s")
def stream_track_purity(spark, sf_dir):
    """track_purity() of a streaming query with the same tracker as its state."""
    from boxtrail.streaming.live import run_tracks

    t = run_tracks(smooth(spark, sf_dir).withColumn("class_id", F.col("gt_id")), tracking.TrackerConfig(return_all=True)).where("det_id is not null").select("stream_id", "track_id", "det_id")
    s = smooth(spark, sf_dir).select("stream_id", "gt_id", "frame_id", "det_id")
    return s.join(t, ["stream_id", "det_id"]).groupBy("stream_id", "gt_id").agg(F.countDistinct("track_id").alias("track_ids"), F.count("*").alias("updates"), F.min("frame_id").alias("first_frame"), F.max("frame_id").alias("last_frame"))


@query("stream_counts", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, class_id, count(*) AS n FROM d GROUP BY ALL", "d")
def stream_counts(spark, sf_dir):
    from boxtrail.streaming.live import run_counts

    return run_counts(dense(spark, sf_dir))


@query("stream_fan_out", "SELECT 'classes' AS sink, class_id AS key, count(*) AS n FROM d GROUP BY ALL UNION ALL SELECT 'sure', stream_id, count(*) FROM d WHERE confidence > 0.5 GROUP BY ALL", "d")
def stream_fan_out(spark, sf_dir):
    """One stream into two tables, batch by batch."""
    from boxtrail.streaming.live import run_fan_out

    out = run_fan_out(dense(spark, sf_dir), {"classes": lambda b: b.groupBy("class_id").agg(F.count("*").alias("n")), "sure": lambda b: b.where("confidence > 0.5").groupBy("stream_id").agg(F.count("*").alias("n"))})
    total = lambda sink, key: out[sink].groupBy(F.col(key).alias("key")).agg(F.sum("n").alias("n")).select(F.lit(sink).alias("sink"), "key", "n")
    return total("classes", "class_id").unionByName(total("sure", "stream_id"))
