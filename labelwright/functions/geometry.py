"""Box geometry. A box is four columns x0, y0, x1, y1; quads are converted on the way in."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def box(prefix: str = "") -> Column:
    c = lambda n: F.col(f"{prefix}{n}")
    return F.struct(c("x0").alias("x0"), c("y0").alias("y0"), c("x1").alias("x1"), c("y1").alias("y1"))


def quad(b: Column) -> Column:
    """Four corner points, clockwise from the top left."""
    point = lambda x, y: F.array(b[x], b[y])
    return F.array(point("x0", "y0"), point("x1", "y0"), point("x1", "y1"), point("x0", "y1"))


def enclosing(points: Column) -> Column:
    """Axis-aligned box around any number of points."""
    axis = lambda i: F.transform(points, lambda p: p[i])
    return F.struct(
        F.array_min(axis(0)).alias("x0"),
        F.array_min(axis(1)).alias("y0"),
        F.array_max(axis(0)).alias("x1"),
        F.array_max(axis(1)).alias("y1"),
    )


def center(b: Column) -> tuple[Column, Column]:
    return (b["x0"] + b["x1"]) / 2, (b["y0"] + b["y1"]) / 2


def height(b: Column) -> Column:
    return F.abs(b["y1"] - b["y0"])


def width(b: Column) -> Column:
    return F.abs(b["x1"] - b["x0"])


def font_size(b: Column) -> Column:
    return F.greatest(F.lit(8.0), F.least(height(b), width(b)))


def distance(a: Column, b: Column) -> Column:
    (ax, ay), (bx, by) = center(a), center(b)
    return F.sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by))


def overlap_ratio(inner: Column, outer: Column) -> Column:
    """Share of ``inner`` that lies in ``outer``; null for an empty box."""
    side = lambda lo, hi: F.greatest(F.lit(0.0), F.least(inner[hi], outer[hi]) - F.greatest(inner[lo], outer[lo]))
    area = (inner["x1"] - inner["x0"]) * (inner["y1"] - inner["y0"])
    return F.when(area > 0, side("x0", "x1") * side("y0", "y1") / area)


def relation(inner: Column, outer: Column) -> Column:
    ratio = overlap_ratio(inner, outer)
    return (
        F.when(ratio.isNull(), F.lit("UNKNOWN"))
        .when(ratio > 0.9, F.lit("INSIDE"))
        .when(ratio > 0.1, F.lit("PARTIAL"))
        .otherwise(F.lit("OUTSIDE"))
    )


def clamp(value: Column, low, high) -> Column:
    as_col = lambda v: v if isinstance(v, Column) else F.lit(float(v))
    return F.greatest(as_col(low), F.least(value, as_col(high)))


def normalized(b: Column, img_w: Column, img_h: Column) -> Column:
    """(cx, cy, w, h) in parts of the image after clipping to it; null when nothing is left."""
    x0, x1 = clamp(b["x0"], 0, img_w), clamp(b["x1"], 0, img_w)
    y0, y1 = clamp(b["y0"], 0, img_h), clamp(b["y1"], 0, img_h)
    w, h = (x1 - x0) / img_w, (y1 - y0) / img_h
    return F.when(
        (w > 0) & (h > 0),
        F.struct(
            ((x0 + (x1 - x0) / 2) / img_w).alias("cx"),
            ((y0 + (y1 - y0) / 2) / img_h).alias("cy"),
            w.alias("w"),
            h.alias("h"),
        ),
    )


def transformed(cx: Column, cy: Column, w: Column, h: Column, shift=(0.0, 0.0), scale=(1.0, 1.0)) -> Column:
    """A normalised box after shift then zoom, clipped to the image; null once its centre leaves it."""
    tx, ty = (cx + shift[0]) * scale[0], (cy + shift[1]) * scale[1]
    tw, th = w * scale[0], h * scale[1]
    x0, y0 = F.greatest(F.lit(0.0), tx - tw / 2), F.greatest(F.lit(0.0), ty - th / 2)
    nw, nh = F.least(F.lit(1.0), tx + tw / 2) - x0, F.least(F.lit(1.0), ty + th / 2) - y0
    inside = tx.between(0, 1) & ty.between(0, 1) & (nw > 0) & (nh > 0)
    return F.when(
        inside,
        F.struct((x0 + nw / 2).alias("cx"), (y0 + nh / 2).alias("cy"), nw.alias("w"), nh.alias("h")),
    )


def crop_pixels(cx: Column, cy: Column, w: Column, h: Column, img_w: Column, img_h: Column) -> Column:
    """Pixel rectangle of a normalised box, clipped; null when it is empty."""
    edge = lambda c, s, size: clamp(F.floor(c * size + s * size / 2 + 0.5).cast("double"), 0, size)
    x0, x1 = edge(cx, -w, img_w), edge(cx, w, img_w)
    y0, y1 = edge(cy, -h, img_h), edge(cy, h, img_h)
    return F.when(
        (x1 > x0) & (y1 > y0), F.struct(x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"))
    )
