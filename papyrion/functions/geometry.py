"""Boxes as four columns or a struct (x0, y0, x1, y1)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def box(prefix: str = "") -> Column:
    return F.struct(*(F.col(f"{prefix}{c}").cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")))


def area(b: Column) -> Column:
    return F.greatest(b["x1"] - b["x0"], F.lit(0.0)) * F.greatest(b["y1"] - b["y0"], F.lit(0.0))


def overlap(a: Column, b: Column) -> Column:
    """Area that two boxes share."""
    w = F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"])
    h = F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"])
    return F.when((w > 0) & (h > 0), w * h).otherwise(0.0)


def iou(a: Column, b: Column) -> Column:
    """shared area over united area, 0 for empty boxes."""
    shared, union = overlap(a, b), area(a) + area(b) - overlap(a, b)
    return F.when(union > 0, shared / union).otherwise(0.0)


def contained(inner: Column, outer: Column, share: float = 0.7) -> Column:
    """whether so much of the inner box lies in the outer one."""
    return F.when(area(inner) > 0, overlap(inner, outer) / area(inner) >= share).otherwise(False)


def same_column(a: Column, b: Column) -> Column:
    """horizontal overlap of at least half the narrower width."""
    shared = F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"])
    narrow = F.least(a["x1"] - a["x0"], b["x1"] - b["x0"])
    return (narrow > 0) & (shared >= 0.5 * narrow)


def vertical(b: Column) -> Column:
    """a block of upright text: under 40 wide and over four times as high."""
    w, h = b["x1"] - b["x0"], b["y1"] - b["y0"]
    return (w < 40) & (h > 4 * w)


def covers(region: Column, block: Column, chars: Column) -> Column:
    """a region covers a block: its centre within, or half its area, or over a tenth if the block is short."""
    cx, cy = (block["x0"] + block["x1"]) / 2, (block["y0"] + block["y1"]) / 2
    centre = cx.between(region["x0"], region["x1"]) & cy.between(region["y0"], region["y1"])
    share = F.when(area(block) > 0, overlap(block, region) / area(block)).otherwise(0.0)
    return centre | (share >= 0.5) | ((share > 0.1) & (chars < 40))


def dominated(cover: Column, chars: Column) -> Column:
    """A page that is mostly image: over 0.6 of it with under 200 characters, or over 0.35 with under 120."""
    return ((cover > 0.6) & (chars < 200)) | ((cover > 0.35) & (chars < 120))


def hull(polygon: Column) -> Column:
    """the box of an array of points (x, y)."""
    xs, ys = F.transform(polygon, lambda p: p["x"]), F.transform(polygon, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"))
