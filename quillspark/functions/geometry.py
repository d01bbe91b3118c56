"""Polygons as arrays of [x, y]: their texts, boxes and pages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .fixed_values import PALETTE


def parse_points(text: Column, strict: bool = False) -> Column:
    """"x,y x,y" to a polygon. Tokens without a comma are skipped, or fail the row if strict; more than one comma always fails it."""
    found = F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda t: t != "")
    if not strict:
        found = F.filter(found, lambda t: F.contains(t, F.lit(",")))

    def point(t: Column) -> Column:
        parts = F.split(t, ",", -1)
        sure = F.when(F.size(parts) == 2, parts).otherwise(F.raise_error(F.concat(F.lit("not a point: "), t)).cast("array<string>"))
        return F.transform(sure, lambda p: F.trim(p).cast("double"))

    return F.transform(found, point)


def format_points(polygon: Column) -> Column:
    """A polygon as "x,y x,y", cut to integers toward zero."""
    return F.array_join(F.transform(polygon, lambda p: F.concat_ws(",", F.get(p, F.lit(0)).cast("bigint").cast("string"), F.get(p, F.lit(1)).cast("bigint").cast("string"))), " ")


def page_polygon(width: Column, height: Column) -> Column:
    """The four corners of a page."""
    zero = F.lit(0.0)
    w, h = width.cast("double"), height.cast("double")
    return F.array(F.array(zero, zero), F.array(w, zero), F.array(w, h), F.array(zero, h))


def alto_polygon(points: Column, x: Column, y: Column, w: Column, h: Column) -> Column:
    """Numbers "x y x y" paired (an odd last one dropped) if they make three points, else the box, else nothing."""
    numbers = F.transform(F.filter(F.split(F.coalesce(points, F.lit("")), r"\s+"), lambda t: t != ""), lambda t: t.cast("double"))
    half = F.floor(F.size(numbers) / 2).cast("int")
    paired = F.transform(F.filter(F.sequence(F.lit(0), F.greatest(half - 1, F.lit(0))), lambda i: i < half), lambda i: F.array(F.get(numbers, 2 * i), F.get(numbers, 2 * i + 1)))
    box = F.when((w > 0) & (h > 0), F.array(F.array(x, y), F.array(x + w, y), F.array(x + w, y + h), F.array(x, y + h)))
    return F.when(F.size(paired) >= 3, paired).otherwise(F.coalesce(box, F.array().cast("array<array<double>>")))


def bounding_box(polygon: Column, width: Column, height: Column) -> Column:
    """(x0, y0, x1, y1): the polygon's integer box clamped to the image."""
    axis = lambda k: F.transform(polygon, lambda p: F.get(p, F.lit(k)).cast("bigint"))
    return F.struct(
        F.greatest(F.array_min(axis(0)), F.lit(0).cast("bigint")).alias("x0"),
        F.greatest(F.array_min(axis(1)), F.lit(0).cast("bigint")).alias("y0"),
        F.least(F.array_max(axis(0)), width.cast("bigint")).alias("x1"),
        F.least(F.array_max(axis(1)), height.cast("bigint")).alias("y1"),
    )


def line_colour(index: Column) -> Column:
    """The palette's colour of a line, from the start again after the last."""
    colours = F.array(*(F.array(*(F.lit(v) for v in c)) for c in PALETTE))
    return F.get(colours, F.pmod(index, F.lit(len(PALETTE))).cast("int"))
