"""A corpus on disk: images with their PAGE or ALTO files, as one example a line."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import images, xml

EXAMPLE = "path string, line_idx int, text string, polygon array<array<double>>, height int, width int, content binary"


def load_corpus(spark: SparkSession, folder: str, metadata: dict[str, str] | None = None, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Examples (path of the XML file, line_idx, text, polygon, the line's own height, width and grey pixels, metadata), and (path, error) of files left out.

    A page's lines meet its image once, as an array; crops are clamped to the image and empty ones dropped. With a limit
    the first examples in the order of path and line are returned.
    """
    lines, bad_files = xml.corpus_lines(xml.read_files(spark, folder, "*.xml"))
    pictures = images.read_images(spark, folder)
    pairs = xml.pair_images(lines.select("path").distinct(), pictures.select("path"), (*xml.IMAGE_EXTENSIONS, ".pgm", ".ppm"))
    pages = lines.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("line_idx", "text", "polygon"))).alias("lines"))
    joined = pages.join(pairs, pages["path"] == pairs["xml"]).drop("xml").join(pictures.withColumnRenamed("path", "image"), "image")

    def crop(batches):
        for pdf in batches:
            rows = []
            for path, page, h, w, content in zip(pdf["path"], pdf["lines"], pdf["height"], pdf["width"], pdf["content"]):
                picture = np.frombuffer(content, np.uint8).reshape(int(h), int(w))
                for line in page:
                    points = np.array([list(p) for p in line["polygon"]]).astype(int)
                    (x0, y0), (x1, y1) = np.maximum(points.min(axis=0), 0), np.minimum(points.max(axis=0), (int(w), int(h)))
                    if x1 > x0 and y1 > y0:
                        rows.append((path, line["line_idx"], line["text"], [list(p) for p in line["polygon"]], int(y1 - y0), int(x1 - x0), picture[y0:y1, x0:x1].tobytes()))
            yield pd.DataFrame(rows, columns=["path", "line_idx", "text", "polygon", "height", "width", "content"])

    examples = joined.where("error IS NULL").select("path", "lines", "height", "width", "content").mapInPandas(crop, EXAMPLE)
    given = F.create_map(*(F.lit(x) for kv in (metadata or {}).items() for x in kv)).cast("map<string,string>")
    examples = examples.withColumn("metadata", given)
    bad = bad_files.unionByName(pictures.where("error IS NOT NULL").select("path", "error"))
    return (examples if limit is None else examples.orderBy("path", "line_idx").limit(limit)), bad
