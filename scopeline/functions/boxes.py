"""Boxes (x1, y1, x2, y2; upper bounds exclusive) as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed

SIDES = ("x1", "y1", "x2", "y2")
BOX = "struct<x1:int,y1:int,x2:int,y2:int>"


def box(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.struct(*(c.cast("int").alias(n) for c, n in zip((x1, y1, x2, y2), SIDES, strict=True)))


def area(b: Column) -> Column:
    return (b["x2"] - b["x1"]).cast("long") * (b["y2"] - b["y1"])


def iou(a: Column, b: Column) -> Column:
    """Intersection over union; 0 for boxes that are apart or touch."""
    w = F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"])
    h = F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"])
    inter = w.cast("long") * h
    return F.when((w > 0) & (h > 0), inter / (area(a) + area(b) - inter)).when(w.isNotNull() & h.isNotNull(), F.lit(0.0))


def area_ratio(a: Column, b: Column) -> Column:
    """Smaller area over larger; 0 if both are empty."""
    most = F.greatest(area(a), area(b))
    return F.when(most > 0, F.least(area(a), area(b)) / most).when(most.isNotNull(), F.lit(0.0))


def rounded(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Half-even rounding; an empty side becomes one pixel wide."""
    a, b, c, d = (F.bround(v, 0).cast("int") for v in (x1, y1, x2, y2))
    return box(a, b, F.greatest(c, a + 1), F.greatest(d, b + 1))


def reason(coords: Column, width: Column, height: Column, min_side: int = fixed.MIN_SIDE, expected: tuple[Column, Column] | None = None) -> Column:
    """Why an array of doubles is no legal box of a frame, or ``valid``: the first check that fails.

    ``expected`` is the frame size that the box was made for; a null there is not checked.
    """
    other = F.lit(False) if expected is None else F.coalesce((expected[0] != width) | (expected[1] != height), F.lit(False))
    x1, y1, x2, y2 = (F.get(coords, i) for i in range(4))
    odd = F.exists(coords, lambda c: F.isnan(c) | (F.abs(c) == float("inf")))
    part = F.exists(coords, lambda c: c != F.floor(c))
    return (
        F.when((width <= 0) | (height <= 0) | other, fixed.MISMATCH)
        .when(coords.isNull() | (F.size(coords) != 4), fixed.NOT_FOUR)
        .when(F.exists(coords, lambda c: c.isNull()), fixed.NON_INTEGER)
        .when(odd, fixed.NON_FINITE)
        .when(part, fixed.NON_INTEGER)
        .when((x2 <= x1) | (y2 <= y1), fixed.INVERTED)
        .when((x1 < 0) | (y1 < 0) | (x2 > width) | (y2 > height), fixed.OUT_OF_FRAME)
        .when((x2 - x1 < min_side) | (y2 - y1 < min_side), fixed.TOO_SMALL)
        .otherwise(fixed.VALID)
    )


def clamped(b: Column, width: Column, height: Column) -> Column:
    """The part of a box inside the frame; null if there is none. (Spark's greatest and least pass over nulls.)"""
    cut = box(F.greatest(b["x1"], F.lit(0)), F.greatest(b["y1"], F.lit(0)), F.least(b["x2"], width), F.least(b["y2"], height))
    return F.when(b.isNotNull() & (cut["x2"] > cut["x1"]) & (cut["y2"] > cut["y1"]), cut)


def drifted(observed: Column, locked: Column, below: float = fixed.DRIFT_IOU) -> Column:
    """Whether an observed box disagrees with a locked one; false without either."""
    return F.coalesce(iou(observed, locked) < below, F.lit(False))


def live(last_positive: Column, t: Column, interval: float) -> Column:
    """Whether the last positive observation is within its time to live."""
    return F.coalesce(t - last_positive <= fixed.TTL_FACTOR * interval, F.lit(False))


def letterbox(width: Column, height: Column, to_width: int, to_height: int) -> Column:
    """Scale, size and margins that fit a frame into a fixed input."""
    scale = F.least(to_width / width, to_height / height)
    w = F.greatest(F.lit(1), F.bround(width * scale, 0).cast("int"))
    h = F.greatest(F.lit(1), F.bround(height * scale, 0).cast("int"))
    return F.struct(
        scale.alias("scale"),
        w.alias("new_w"),
        h.alias("new_h"),
        F.floor((to_height - h) / 2).cast("int").alias("top"),
        F.floor((to_width - w) / 2).cast("int").alias("left"),
    )
