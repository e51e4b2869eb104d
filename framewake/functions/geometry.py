"""Drawing sizes, box rectangles and label places. Box rectangles include their far edges, label rectangles don't."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numbers import nearest_int

#: The part of a side that a corner's arm covers.
ARM = 0.25


def draw_sizes(width: Column, height: Column) -> Column:
    """struct<thickness, font_scale, halo, clearance> for a frame."""
    short = F.least(width, height)
    thickness = F.greatest(F.lit(2).cast("long"), nearest_int(short / 540))
    return F.struct(
        thickness.alias("thickness"),
        F.greatest(F.lit(0.5), short / 1080).alias("font_scale"),
        F.greatest(F.lit(1).cast("long"), nearest_int(short / 1080)).alias("halo"),
        (F.floor(thickness / 2) + 1).alias("clearance"),
    )


def _within(x: Column, most: Column) -> Column:
    return F.greatest(F.lit(0).cast("long"), F.least(x, most.cast("long")))


def box_rect(x1: Column, y1: Column, x2: Column, y2: Column, width: Column, height: Column) -> Column:
    """The box in whole pixels inside the frame."""
    return F.struct(
        _within(nearest_int(x1), width - 1).alias("left"), _within(nearest_int(y1), height - 1).alias("top"),
        _within(nearest_int(x2), width - 1).alias("right"), _within(nearest_int(y2), height - 1).alias("bottom"),
    )


def outlined(rect: Column, thickness: Column) -> Column:
    """Whether a box is too small for corner arms and gets a closed outline."""
    span = lambda lo, hi: rect[hi] - rect[lo] + 1
    gap = lambda s: s - 2 * F.greatest(thickness, nearest_int(s * ARM))
    return (gap(span("left", "right")) <= thickness) | (gap(span("top", "bottom")) <= thickness)


def candidate_rects(rect: Column, label_w: Column, label_h: Column, clearance: Column, width: Column, height: Column) -> Column:
    """array<struct<left, top, right, bottom>> of places for a label, best first: above, inside, below; left, then right."""
    places = ((rect["top"] - clearance - label_h, F.lit(0).cast("long")), (rect["top"] + clearance, clearance), (rect["bottom"] + clearance, F.lit(0).cast("long")))
    out = []
    for top, inset in places:
        for wanted in (rect["left"] + inset, rect["right"] - inset - label_w):
            left = _within(wanted, width - label_w)
            out.append(F.struct(left.alias("left"), top.alias("top"), (left + label_w).alias("right"), (top + label_h).alias("bottom")))
    return F.filter(F.array(*out), lambda r: (r["top"] >= 0) & (r["bottom"] <= height))


def intersects(a: Column, b: Column) -> Column:
    """Whether half-open rectangles share a pixel."""
    return (a["left"] < b["right"]) & (b["left"] < a["right"]) & (a["top"] < b["bottom"]) & (b["top"] < a["bottom"])
