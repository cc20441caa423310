"""Box algebra as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-6


def corners(cx: Column, cy: Column, w: Column, h: Column, width, height) -> Column:
    """Normalised centre box to pixel corners, as struct(x1, y1, x2, y2)."""
    width, height = (x if isinstance(x, Column) else F.lit(float(x)) for x in (width, height))
    return F.struct(
        ((cx - w / 2) * width).alias("x1"),
        ((cy - h / 2) * height).alias("y1"),
        ((cx + w / 2) * width).alias("x2"),
        ((cy + h / 2) * height).alias("y2"),
    )


def clipped(cx: Column, cy: Column, w: Column, h: Column) -> Column:
    """The box cut to the unit square, recentred; null if a side is EPS or less."""
    x1, y1 = F.greatest(F.lit(0.0), cx - w / 2), F.greatest(F.lit(0.0), cy - h / 2)
    x2, y2 = F.least(F.lit(1.0), cx + w / 2), F.least(F.lit(1.0), cy + h / 2)
    box = F.struct(((x1 + x2) / 2).alias("cx"), ((y1 + y2) / 2).alias("cy"), (x2 - x1).alias("w"), (y2 - y1).alias("h"))
    return F.when((x2 - x1 > EPS) & (y2 - y1 > EPS), box)


def area(w: Column, h: Column) -> Column:
    return w * h


#: The least share of a box that must stay in the picture.
LEAST_VISIBLE = 0.2


def clipped_boxes(boxes: Column, least_visible: float = LEAST_VISIBLE) -> Column:
    """An array of struct(class_id, cx, cy, w, h) after a transformation: boxes cut to the picture, those hardly in it dropped."""

    def cut(b: Column) -> Column:
        return F.struct(b["class_id"].alias("class_id"), area(b["w"], b["h"]).alias("was"), clipped(b["cx"], b["cy"], b["w"], b["h"]).alias("to"))

    seen = F.filter(F.transform(boxes, cut), lambda x: x["to"].isNotNull() & (area(x["to"]["w"], x["to"]["h"]) >= least_visible * x["was"]))
    return F.transform(seen, lambda x: F.struct(x["class_id"].alias("class_id"), *(x["to"][c].alias(c) for c in ("cx", "cy", "w", "h"))))


def flipped(cx: Column) -> Column:
    """Horizontal flip of a centre."""
    return 1 - cx


def flip_allowed(class_ids: Column) -> Column:
    """No assembly class among an image's ids; an empty list may be flipped."""
    return ~F.exists(F.coalesce(class_ids, F.array().cast("array<int>")), lambda x: x.isin(5, 6))


def iou(a: list[Column], b: list[Column]) -> Column:
    """Intersection over union of two corner boxes; 0 without overlap, negative sides count as 0."""
    zero = F.lit(0.0)
    inter = F.greatest(zero, F.least(a[2], b[2]) - F.greatest(a[0], b[0])) * F.greatest(zero, F.least(a[3], b[3]) - F.greatest(a[1], b[1]))
    area = lambda x: F.greatest(zero, x[2] - x[0]) * F.greatest(zero, x[3] - x[1])
    return F.when(inter <= 0, zero).otherwise(F.coalesce(F.try_divide(inter, area(a) + area(b) - inter), zero))


def array_iou(a: Column, b: Column) -> Column:
    """iou() of two array boxes."""
    return iou([a[i] for i in range(4)], [b[i] for i in range(4)])


def label_problems(class_id: Column, cx: Column, cy: Column, w: Column, h: Column, n_classes: int = 7) -> Column:
    """The geometry rules a label row breaks, in order; zero area hides the later ones, NaN breaks the range rule only."""

    def under(x: Column, y: float) -> Column:  # NaN is under and over nothing
        return (x < y) & ~F.isnan(x)

    def over(x: Column, y: float) -> Column:
        return (x > y) & ~F.isnan(x)

    class_rule = F.when((class_id < 0) | (class_id >= n_classes), F.lit("class_id"))
    flat = (~F.isnan(w) & (w <= 0)) | (~F.isnan(h) & (h <= 0))
    inside = F.lit(True)
    for x in (cx, cy, w, h):
        inside = inside & (x >= 0) & (x <= 1) & ~F.isnan(x)
    left, top, right, bottom = cx - w / 2, cy - h / 2, cx + w / 2, cy + h / 2
    rest = [
        F.when(~inside, F.lit("outside_unit")),
        F.when(under(left, -EPS) | under(top, -EPS), F.lit("above_or_left")),
        F.when(over(right, 1 + EPS) | over(bottom, 1 + EPS), F.lit("below_or_right")),
    ]
    return F.array_compact(F.when(flat, F.array(class_rule, F.lit("zero_area"))).otherwise(F.array(class_rule, *rest)))


def mask_bounds(x: str = "x", y: str = "y") -> list[Column]:
    """Aggregates that turn the set pixels of a mask into corner bounds, far edges included."""
    return [F.min(x).cast("double").alias("x1"), F.min(y).cast("double").alias("y1"), (F.max(x) + 1).cast("double").alias("x2"), (F.max(y) + 1).cast("double").alias("y2")]


def bounds_to_box(width: int, height: int) -> Column:
    """Normalised centre box of the bounds in x1, y1, x2, y2; sides are a pixel at least."""
    x1, y1, x2, y2 = (F.col(c) for c in ("x1", "y1", "x2", "y2"))
    clip = lambda v, low: F.least(F.lit(1.0), F.greatest(F.lit(low), v))
    return F.struct(
        clip((x1 + x2) / 2 / width, 0.0).alias("cx"), clip((y1 + y2) / 2 / height, 0.0).alias("cy"), clip((x2 - x1) / width, 1.0 / width).alias("w"), clip((y2 - y1) / height, 1.0 / height).alias("h")
    )
