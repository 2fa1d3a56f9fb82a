"""Class names, colors and captions as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The names of the COCO classes, ids 0 to 79.
COCO = [
    "person", "bicycle", "car", "motorcycle", "airplane", "bus", "train", "truck", "boat", "traffic light", "fire hydrant", "stop sign", "parking meter", "bench", "bird", "cat", "dog", "horse", "sheep", "cow",
    "elephant", "bear", "zebra", "giraffe", "backpack", "umbrella", "handbag", "tie", "suitcase", "frisbee", "skis", "snowboard", "sports ball", "kite", "baseball bat", "baseball glove", "skateboard", "surfboard",
    "tennis racket", "bottle", "wine glass", "cup", "fork", "knife", "spoon", "bowl", "banana", "apple", "sandwich", "orange", "broccoli", "carrot", "hot dog", "pizza", "donut", "cake", "chair", "couch", "potted plant",
    "bed", "dining table", "toilet", "tv", "laptop", "mouse", "remote", "keyboard", "cell phone", "microwave", "oven", "toaster", "sink", "refrigerator", "book", "clock", "vase", "scissors", "teddy bear", "hair drier", "toothbrush",
]

# Variant, file, display name and aliases of the models.
MODELS = [
    ("r18vd_fp16", "rtdetr_v2_r18vd_fp16.onnx", "RT-DETR R18 (FP16)", ["r18vd_fp16", "r18_fp16", "r18-fp16"]),
    ("r18vd_fp32", "rtdetr_v2_r18vd_fp32.onnx", "RT-DETR R18 (FP32)", ["r18vd_fp32", "r18_fp32", "r18-fp32", "r18vd", "r18"]),
    ("r34vd_fp16", "rtdetr_v2_r34vd_fp16.onnx", "RT-DETR R34 (FP16)", ["r34vd_fp16", "r34_fp16", "r34-fp16"]),
    ("r34vd_fp32", "rtdetr_v2_r34vd_fp32.onnx", "RT-DETR R34 (FP32)", ["r34vd_fp32", "r34_fp32", "r34-fp32", "r34vd", "r34"]),
    ("r50vd_fp16", "rtdetr_v2_r50vd_fp16.onnx", "RT-DETR R50 (FP16)", ["r50vd_fp16", "r50_fp16", "r50-fp16"]),
    ("r50vd_fp32", "rtdetr_v2_r50vd_fp32.onnx", "RT-DETR R50 (FP32)", ["r50vd_fp32", "r50_fp32", "r50-fp32", "r50vd", "r50"]),
    ("r50vd_uint8", "rtdetr_v2_r50vd_uint8.onnx", "RT-DETR R50 (UINT8)", ["r50vd_uint8", "r50_uint8", "r50-uint8"]),
    ("r101vd_fp16", "rtdetr_v2_r101vd_fp16.onnx", "RT-DETR R101 (FP16)", ["r101vd_fp16", "r101_fp16", "r101-fp16"]),
    ("r101vd_fp32", "rtdetr_v2_r101vd_fp32.onnx", "RT-DETR R101 (FP32)", ["r101vd_fp32", "r101_fp32", "r101-fp32", "r101vd", "r101"]),
]


def label_table(spark: SparkSession, more: DataFrame | None = None) -> DataFrame:
    """(class_id, class_name): COCO's names, and those of `more` (a table of the same columns) for ids beyond them. A model with more
    classes, as those of Objects365, brings its names this way: `read_names` of a file, or any table."""
    coco = spark.createDataFrame(list(enumerate(COCO)), "class_id long, class_name string")
    return coco if more is None else coco.unionByName(more.select("class_id", "class_name").where(F.col("class_id") >= len(COCO)))


def read_names(spark: SparkSession, path: str) -> DataFrame:
    """(class_id, class_name) of a text file with a name on each line, the first one's id 0. Lines of blanks count, but name nothing."""
    lines = F.split(F.regexp_replace(F.col("value"), "\r", ""), "\n")
    rows = spark.read.text(path, wholetext=True).select(F.posexplode(lines).alias("class_id", "class_name"))
    return rows.select(F.col("class_id").cast("long"), F.trim("class_name").alias("class_name")).where("class_name <> ''")


def capitalized(name: Column) -> Column:
    """The first character in upper case, the rest as it is."""
    return F.concat(F.upper(F.substring(name, 1, 1)), F.substring(name, 2, 2**31 - 1))


def fallback(class_id: Column) -> Column:
    return F.concat(F.lit("class_"), class_id.cast("string"))


def with_names(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """rows with class_name from labels (class_id, class_name), class_N where there is none."""
    dim = labels.select("class_id", F.col("class_name").alias("_name")).dropDuplicates(["class_id"])
    return rows.join(dim, "class_id", "left").withColumn("class_name", F.coalesce("_name", fallback(F.col("class_id")))).drop("_name")


def hue_color(class_id: Column) -> tuple[Column, Column, Column]:
    """Red, green and blue of a hue of 137 degrees a class, saturation 0.7, value 0.9, cut to whole numbers."""
    hue = (class_id.cast("long") * 137) % 360
    c = F.lit(0.9 * 0.7)
    x = c * (1 - F.abs((hue / 60.0) % 2 - 1))
    m, zero = F.lit(0.9) - c, F.lit(0.0)
    sector = F.floor(hue / 60.0)
    pick = lambda *v: F.element_at(F.array(*v), sector.cast("int") + 1)
    rgb = pick(c, x, zero, zero, x, c), pick(x, c, c, x, zero, zero), pick(zero, zero, x, c, c, x)
    return tuple(F.floor((v + m) * 255).cast("int") for v in rgb)


def palette_color(class_id: Column, palette: list[str]) -> Column:
    return F.element_at(F.array(*[F.lit(p) for p in palette]), (class_id % len(palette)).cast("int") + 1)


#: The multiplier of a hash by the golden ratio, modulo 2^32.
GOLDEN = 2654435761


def hashed(value: Column) -> Column:
    """value times GOLDEN modulo 2^32, by halves, so that no product leaves 64 bits."""
    low, high = value % 65536, F.shiftright(value, 16) % 65536
    return (low * GOLDEN + ((high * GOLDEN) % 65536) * 65536) % 4294967296


def hash_color(class_id: Column) -> tuple[Column, Column, Column]:
    """Red, green and blue from three rounds of the hash: at most 180, at least 100 for a channel above both others and
    40 otherwise; green is held against the red that came of this, blue against both."""
    one = hashed(class_id.cast("long"))
    two = hashed(one)
    r, g, b = (c % 256 for c in (one, two, hashed(two)))
    limit = lambda c, p, q: F.greatest(F.least(c, F.lit(180)), F.when((c > p) & (c > q), 100).otherwise(40)).cast("int")
    r = limit(r, g, b)
    g = limit(g, r, b)
    return r, g, limit(b, r, g)


def caption(name: Column, confidence: Column, track_id: Column | None = None) -> Column:
    """`#id Name 87%`, without the id where there is none; halves round to even."""
    text = F.concat(name, F.lit(" "), F.bround(confidence * 100, 0).cast("int").cast("string"), F.lit("%"))
    return text if track_id is None else F.when(track_id.isNotNull(), F.concat(F.lit("#"), track_id.cast("string"), F.lit(" "), text)).otherwise(text)


def parse_ids(text: Column) -> Column:
    """The whole numbers of a list with commas; what is none is left out."""
    return F.filter(F.transform(F.split(text, ","), lambda s: F.trim(s).try_cast("int")), lambda v: v.isNotNull())


def parse_percent(text: Column) -> Column:
    """A percentage as a share from 0 to 1."""
    return F.greatest(F.least(F.trim(text).try_cast("double") / 100, F.lit(1.0)), F.lit(0.0))


def parse_model(text: Column) -> Column:
    """The variant that a name means, whatever its case; null if none."""
    out = F.lit(None).cast("string")
    for variant, _, _, aliases in MODELS:
        out = F.when(F.lower(text).isin(*aliases), variant).otherwise(out)
    return out
