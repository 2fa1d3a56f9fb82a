"""Boxes as columns. A corner box is (xmin, ymin, xmax, ymax), a frame box (x, y, w, h) with its top left corner."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Box = tuple[Column, Column, Column, Column]


def corners(x: Column, y: Column, w: Column, h: Column) -> Box:
    return x, y, x + w, y + h


def columns(prefix: str = "") -> Box:
    """The frame box in the columns x, y, w, h, with a prefix."""
    return tuple(F.col(f"{prefix}{c}") for c in "xywh")


def width(b: Box) -> Column:
    return b[2] - b[0]


def height(b: Box) -> Column:
    return b[3] - b[1]


def area(b: Box) -> Column:
    return width(b) * height(b)


def center(b: Box) -> tuple[Column, Column]:
    return (b[0] + b[2]) / 2, (b[1] + b[3]) / 2


def bounds(b: Box) -> Column:
    return F.array(*b)


def shown(b: Box) -> Column:
    return F.concat(F.lit("Bbox("), F.concat_ws(", ", *[c.cast("string") for c in b]), F.lit(")"))


def to_measurement(b: Box) -> Box:
    """Center, area and aspect; a box without height has aspect 1."""
    w, h = width(b), height(b)
    return (*center(b), w * h, F.when(h != 0, w / F.when(h != 0, h)).otherwise(F.lit(1.0)))


def from_measurement(z: Box) -> Box:
    """The corner box of center, area and aspect; NaN where area over aspect is negative."""
    h = F.sqrt(F.try_divide(z[2], z[3]))
    w = z[3] * h
    return z[0] - w / 2, z[1] - h / 2, z[0] + w / 2, z[1] + h / 2


def iou(a: Box, b: Box) -> Column:
    """Intersection over union of corner boxes; 0 where they don't overlap or the union is empty."""
    w = F.least(a[2], b[2]) - F.greatest(a[0], b[0])
    h = F.least(a[3], b[3]) - F.greatest(a[1], b[1])
    inter = w * h
    union = area(a) + area(b) - inter
    return F.when((w > 0) & (h > 0) & (union > 0), F.try_divide(inter, union)).otherwise(F.lit(0.0))


def intersects(a: Box, b: Box) -> Column:
    return (a[0] < b[2]) & (a[2] > b[0]) & (a[1] < b[3]) & (a[3] > b[1])


def contains(outer: Box, inner: Box, pad: float = 10.0) -> Column:
    """Whether inner lies in outer grown by pad on each side; the left and top edges stop at 0."""
    zero = F.lit(0.0)
    return (inner[0] >= F.greatest(outer[0] - pad, zero)) & (inner[1] >= F.greatest(outer[1] - pad, zero)) & (inner[2] <= outer[2] + pad) & (inner[3] <= outer[3] + pad)


def whole(c: Column) -> Column:
    """A pixel: towards zero, and never below it."""
    return F.greatest(c.cast("int"), F.lit(0))


def to_pixels(b: Box, frame_w: Column, frame_h: Column) -> Box:
    return whole(b[0] * frame_w), whole(b[1] * frame_h), whole(b[2] * frame_w), whole(b[3] * frame_h)


def to_normalized(b: Box, frame_w: Column, frame_h: Column) -> Box:
    return F.try_divide(b[0], frame_w), F.try_divide(b[1], frame_h), F.try_divide(b[2], frame_w), F.try_divide(b[3], frame_h)


def from_query(cx: Column, cy: Column, w: Column, h: Column, frame_w: Column, frame_h: Column) -> Box:
    """A model's centered box in shares of the frame as a top-left one, clipped to the frame."""
    left, top = F.greatest((cx - w / 2) * frame_w, F.lit(0.0)) / frame_w, F.greatest((cy - h / 2) * frame_h, F.lit(0.0)) / frame_h
    return left, top, F.least(w, 1 - left), F.least(h, 1 - top)


def flipped(b: Box) -> Box:
    """A frame box in shares whose vertical axis points the other way."""
    return b[0], 1 - b[1] - b[3], b[2], b[3]


#: The smallest and largest magnitudes of a normal 32-bit float (fixed values of IEEE 754).
NORMAL = (1.17549435e-38, 3.4028235e38)


def normal(c: Column) -> Column:
    """Whether a value is a normal 32-bit float: not NaN, infinite, subnormal or 0."""
    return ~F.isnan(c) & F.abs(c).between(*NORMAL)


def valid_prediction(b: Box) -> Column:
    return (b[0] < b[2]) & (b[1] < b[3]) & normal(b[0]) & normal(b[1]) & normal(b[2]) & normal(b[3])


def shrunk(w: Column, h: Column, target: Column) -> tuple[Column, Column, Column]:
    """Scale and whole size of a picture whose longer side is brought down to target; never enlarged."""
    scale = F.least(F.try_divide(target.cast("double"), F.when(w > h, w).otherwise(h)), F.lit(1.0))
    return scale, F.floor(w * scale).cast("int"), F.floor(h * scale).cast("int")


def scale_factors(w: Column, h: Column, target: Column) -> tuple[Column, Column]:
    """What brings coordinates of the shrunk picture back to the original, by axis."""
    _, small_w, small_h = shrunk(w, h, target)
    return F.try_divide(w, small_w), F.try_divide(h, small_h)


def letterbox(w: Column, h: Column, target: Column) -> tuple[Column, Column, Column]:
    """Scale and whole offsets that center a picture in a square."""
    scale = F.least(F.try_divide(target.cast("double"), w), F.try_divide(target.cast("double"), h))
    offset = lambda d: F.floor((target - F.floor(d * scale)) / 2).cast("int")
    return scale, offset(w), offset(h)
