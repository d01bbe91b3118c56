"""Raster pages: line segmentation over rows of pixels, crops, and the filters that need whole images.

A page is rows (page_id, row_idx, pixels) with 0 for ink and 255 for paper.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def islands(df: DataFrame, *keys: str, order: str, active: Column) -> DataFrame:
    """Runs of active rows in each key: (keys, start, end), end exclusive; order counts without gaps."""
    rows = df.select(*keys, F.col(order).alias("at"), active.alias("active"))
    w = Window.partitionBy(*keys).orderBy("at")
    begun = rows.withColumn("begins", (F.col("active") & ~F.coalesce(F.lag("active").over(w), F.lit(False))).cast("int"))
    runs = begun.withColumn("run", F.sum("begins").over(w)).where("active")
    return runs.groupBy(*keys, "run").agg(F.min("at").alias("start"), (F.max("at") + 1).alias("end")).drop("run")


def ink(pixels: Column) -> Column:
    """The row's ink, a white pixel counting 0 and a black one 1."""
    return F.aggregate(pixels, F.lit(0).cast("long"), lambda a, p: a + (255 - p)) / 255.0


def segment_lines(rows: DataFrame, min_height: int = 10, margin: int = 3) -> DataFrame:
    """(page_id, reading_order, x, y, w, h, polygon) of the text lines, top to bottom.

    Text rows have ink over 1 % of the width; runs lower than min_height go, margins are added within the page; the width
    runs from the first to the last ink column, the last one excluded. Pages without rows or with uneven rows are errors.

    Pixels become three numbers a row, and only these are shuffled, once, by page: a band's first and last ink columns are
    the least and greatest, over its text rows, of what a window of the margin finds around each row.
    """
    at = rows.select("page_id", "row_idx", F.size("pixels").alias("width"), ink(F.col("pixels")).alias("ink"), F.transform("pixels", lambda p, i: F.when(p < 255, i)).alias("at"))
    measured = at.select("page_id", "row_idx", "width", (F.col("ink") > F.col("width") * 0.01).alias("active"), F.array_min("at").alias("left"), F.array_max("at").alias("right"))
    page, down = Window.partitionBy("page_id"), Window.partitionBy("page_id").orderBy("row_idx")
    near = down.rangeBetween(-margin, margin)
    even = (F.min("width").over(page) == F.max("width").over(page)) & (F.min("width").over(page) > 0)
    height = F.when(even, F.max("row_idx").over(page) + 1).otherwise(F.raise_error(F.lit("a page's rows are uneven or empty")).cast("int"))
    begins = F.col("active") & ~F.coalesce(F.lag("active").over(down), F.lit(False))
    seen = measured.select("page_id", "row_idx", "active", height.alias("height"), begins.cast("int").alias("begins"), F.min("left").over(near).alias("left"), F.max("right").over(near).alias("right"))
    runs = seen.withColumn("run", F.sum("begins").over(down)).where("active").groupBy("page_id", "run").agg(
        F.min("row_idx").alias("start"), (F.max("row_idx") + 1).alias("end"), F.min("left").alias("x0"), F.max("right").alias("x1"), F.max("height").alias("height")
    )
    boxes = runs.where((F.col("end") - F.col("start") >= min_height) & F.col("x0").isNotNull())
    boxes = boxes.withColumn("y0", F.greatest(F.col("start") - margin, F.lit(0))).withColumn("y1", F.least(F.col("end") + margin, F.col("height")))
    order = F.row_number().over(Window.partitionBy("page_id").orderBy("y0", "y1")) - 1
    x, y, w, h = F.col("x0"), F.col("y0"), F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    corner = lambda a, b: F.array(a.cast("double"), b.cast("double"))
    return boxes.select("page_id", order.alias("reading_order"), x.alias("x"), y.alias("y"), w.alias("w"), h.alias("h"), F.array(corner(x, y), corner(x + w, y), corner(x + w, y + h), corner(x, y + h)).alias("polygon"))


def crop(pixels: Column, x0: Column, x1: Column) -> Column:
    """The pixels of a row from x0 up to x1."""
    return F.slice(pixels, x0.cast("int") + 1, F.greatest((x1 - x0).cast("int"), F.lit(0)))


# Filters over whole images, as NumPy functions for mapInPandas.


def grey(image: np.ndarray) -> np.ndarray:
    """Colour (blue, green, red) to grey by luminance; a grey image stays."""
    if image.ndim == 2:
        return image
    return np.clip(np.rint(image[..., :3].astype(float) @ np.array([0.114, 0.587, 0.299])), 0, 255).astype(np.uint8)


def sauvola(image: np.ndarray, window: int = 25, k: float = 0.2) -> np.ndarray:
    """Local threshold mean * (1 + k * (deviation / 0.5 - 1)) on values from 0 to 1, by integral images of the mirrored page; an even window grows by one."""
    window += 1 - window % 2
    r = window // 2
    x = np.pad(image.astype(float) / 255.0, r, mode="reflect" if min(image.shape) > r else "symmetric")

    def box(v: np.ndarray) -> np.ndarray:
        s = np.pad(v, ((1, 0), (1, 0))).cumsum(axis=0).cumsum(axis=1)
        return (s[window:, window:] - s[:-window, window:] - s[window:, :-window] + s[:-window, :-window]) / window**2

    mean = box(x)
    deviation = np.sqrt(np.maximum(box(x * x) - mean**2, 0))
    return np.where(image.astype(float) / 255.0 > mean * (1 + k * (deviation / 0.5 - 1)), 255, 0).astype(np.uint8)


def open_image(image: np.ndarray, size: int = 2) -> np.ndarray:
    """Morphological opening with a square: minimum, then maximum, borders ignored."""

    def slide(v: np.ndarray, reduce, fill: int, before: int) -> np.ndarray:
        padded = np.pad(v, ((before, size - 1 - before),) * 2, constant_values=fill)
        out = padded[: v.shape[0], : v.shape[1]].copy()
        for i in range(size):
            for j in range(size):
                out = reduce(out, padded[i : i + v.shape[0], j : j + v.shape[1]])
        return out

    return slide(slide(image, np.minimum, 255, size // 2), np.maximum, 0, size - 1 - size // 2)


def equalise(image: np.ndarray, tiles: int = 8, clip: float = 2.0) -> np.ndarray:
    """Contrast-limited equalisation: each tile's clipped histogram maps grey values, maps are interpolated between tile centres."""
    h, w = image.shape
    th, tw = -(-h // tiles), -(-w // tiles)
    padded = np.pad(image, ((0, th * tiles - h), (0, tw * tiles - w)), mode="reflect" if min(h, w) > max(th, tw) else "symmetric")
    limit = max(1, int(clip * th * tw / 256))
    maps = np.empty((tiles, tiles, 256))
    for i in range(tiles):
        for j in range(tiles):
            counts = np.bincount(padded[i * th : (i + 1) * th, j * tw : (j + 1) * tw].ravel(), minlength=256)
            excess = int(np.maximum(counts - limit, 0).sum())
            counts = np.minimum(counts, limit) + excess // 256
            counts[: excess % 256] += 1
            maps[i, j] = np.clip(np.rint(counts.cumsum() * 255 / (th * tw)), 0, 255)
    y, x = (np.arange(h) + 0.5) / th - 0.5, (np.arange(w) + 0.5) / tw - 0.5
    y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
    fy, fx = (y - y0)[:, None], (x - x0)[None, :]
    at = lambda a, b: maps[np.clip(a, 0, tiles - 1)[:, None], np.clip(b, 0, tiles - 1)[None, :], image]
    mixed = (1 - fy) * ((1 - fx) * at(y0, x0) + fx * at(y0, x0 + 1)) + fy * ((1 - fx) * at(y0 + 1, x0) + fx * at(y0 + 1, x0 + 1))
    return np.clip(np.rint(mixed), 0, 255).astype(np.uint8)


def skew_angle(image: np.ndarray, limit: float = 10.0, step: float = 0.25) -> float:
    """The rotation in degrees within the limit that makes row profiles of ink sharpest; 0 for fewer than 100 ink pixels or less than half a degree."""
    ys, xs = np.nonzero(image < 128)
    if len(ys) < 100:
        return 0.0

    def sharpness(angle: float) -> float:
        a = np.deg2rad(angle)
        rows = np.rint(ys * np.cos(a) - xs * np.sin(a)).astype(int)
        return float((np.bincount(rows - rows.min()).astype(float) ** 2).sum())

    best = max(np.arange(-limit, limit + step / 2, step), key=lambda a: (sharpness(float(a)), -abs(a)))
    return float(best) if abs(best) >= 0.5 else 0.0


def deskew(image: np.ndarray, limit: float = 10.0) -> np.ndarray:
    """Rotated by its skew angle about the centre, nearest pixel, borders repeated."""
    angle = skew_angle(image, limit)
    if not angle:
        return image
    a, (h, w) = np.deg2rad(angle), image.shape
    y, x = np.mgrid[:h, :w]
    cy, cx = (h - 1) / 2, (w - 1) / 2
    sy = np.clip(np.rint(cy + (y - cy) * np.cos(a) + (x - cx) * np.sin(a)), 0, h - 1).astype(int)
    sx = np.clip(np.rint(cx - (y - cy) * np.sin(a) + (x - cx) * np.cos(a)), 0, w - 1).astype(int)
    return image[sy, sx]


def preprocess(image: np.ndarray, tiles: int = 8, window: int = 25, opening: int = 2) -> np.ndarray:
    """Grey, deskewed, equalised, binarised, cleaned."""
    if image.size == 0 or image.ndim not in (2, 3):
        raise ValueError("not an image")
    return open_image(sauvola(equalise(deskew(grey(image)), tiles), window), opening)


def preprocessed(images: DataFrame, tiles: int = 8, window: int = 25, opening: int = 2) -> DataFrame:
    """Images (page_id, height, width, content: 8-bit grey pixels) after preprocess()."""
    import pandas as pd

    def run(batches):
        for pdf in batches:
            out = [preprocess(np.frombuffer(c, np.uint8).reshape(h, w), tiles, window, opening) for c, h, w in zip(pdf["content"], pdf["height"], pdf["width"])]
            yield pd.DataFrame({"page_id": pdf["page_id"], "height": pdf["height"], "width": pdf["width"], "content": [x.tobytes() for x in out]})

    return images.select("page_id", "height", "width", "content").mapInPandas(run, images.select("page_id", "height", "width", "content").schema)


def pixel_rows(images: DataFrame) -> DataFrame:
    """(page_id, row_idx, pixels) of images (page_id, height, width, content)."""
    at = images.select("page_id", "width", "content", F.explode(F.sequence(F.lit(0), F.col("height") - 1)).alias("row_idx"))
    row = F.hex(F.substring(F.col("content"), F.col("row_idx") * F.col("width") + 1, F.col("width")))
    pixels = F.transform(F.sequence(F.lit(0), F.col("width") - 1), lambda i: F.conv(F.substring(F.col("row_hex"), 2 * i + 1, F.lit(2)), 16, 10).cast("int"))
    return at.withColumn("row_hex", row).select("page_id", "row_idx", pixels.alias("pixels"))
