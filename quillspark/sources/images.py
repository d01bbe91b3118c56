"""Images as rows (path, height, width, content): 8-bit grey pixels from PGM, PPM and PNG files, JPEG and TIFF files by the JVM's decoders, and PNG to write."""

from __future__ import annotations

import re
import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.raster import grey

IMAGE = "path string, height int, width int, content binary, error string"
_CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


def _png(data: bytes) -> np.ndarray:
    at, body, palette, head = 8, [], None, None
    while at < len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        part = data[at + 8 : at + 8 + size]
        at += size + 12
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", part)
        elif kind == b"PLTE":
            palette = np.frombuffer(part, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            body.append(part)
        elif kind == b"IEND":
            break
    if head is None or head[2] != 8 or head[6] or head[3] not in _CHANNELS:
        raise ValueError("only 8-bit PNG files without interlacing are read")
    width, height, n = head[0], head[1], _CHANNELS[head[3]]
    raw = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(height, 1 + width * n)
    out = np.zeros((height + 1, width + 1, n), np.int64)  # a row above and a pixel to the left of the image
    for y in range(height):
        kind, line = raw[y, 0], raw[y, 1:].reshape(width, n).astype(np.int64)
        above, row = out[y], out[y + 1]
        if kind == 0:
            row[1:] = line
        elif kind == 2:
            row[1:] = (line + above[1:]) & 255
        elif kind == 1:
            row[1:] = np.cumsum(line, axis=0) & 255
        else:
            for x in range(width):
                left, up, corner = row[x], above[x + 1], above[x]
                if kind == 3:
                    guess = (left + up) >> 1
                else:
                    p = left + up - corner
                    a, b, c = abs(p - left), abs(p - up), abs(p - corner)
                    guess = np.where((a <= b) & (a <= c), left, np.where(b <= c, up, corner))
                row[x + 1] = (line[x] + guess) & 255
    pixels = out[1:, 1:].astype(np.uint8)
    if head[3] == 3:
        pixels = palette[pixels[..., 0]]
    elif head[3] in (4, 6):
        pixels = pixels[..., : n - 1]
    # File order is red, green, blue; grey() takes blue first.
    return pixels[..., 0] if pixels.shape[2] == 1 else pixels[..., ::-1]


def _pnm(data: bytes) -> np.ndarray:
    found = re.match(rb"(P[56])(?:\s|#[^\n]*\n)+(\d+)(?:\s|#[^\n]*\n)+(\d+)(?:\s|#[^\n]*\n)+(\d+)\s", data)
    if not found or int(found[4]) != 255:
        raise ValueError("only 8-bit PGM and PPM files are read")
    width, height, n = int(found[2]), int(found[3]), 1 if found[1] == b"P5" else 3
    pixels = np.frombuffer(data, np.uint8, width * height * n, found.end()).reshape(height, width, n)
    return pixels[..., 0] if n == 1 else pixels[..., ::-1]


def decode(data: bytes) -> np.ndarray:
    """A grey image from a file's bytes."""
    if data[:8] == b"\x89PNG\r\n\x1a\n":
        return grey(_png(data))
    if data[:2] in (b"P5", b"P6"):
        return grey(_pnm(data))
    raise ValueError("not a PGM, PPM or PNG file")


def encode_png(image: np.ndarray) -> bytes:
    """A grey image as a PNG file."""
    height, width = image.shape
    part = lambda kind, x: struct.pack(">I", len(x)) + kind + x + struct.pack(">I", zlib.crc32(kind + x))
    rows = np.hstack([np.zeros((height, 1), np.uint8), image.astype(np.uint8)]).tobytes()
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)) + part(b"IDAT", zlib.compress(rows)) + part(b"IEND", b"")


def decoded(files: DataFrame) -> DataFrame:
    """Rows (path, content) of image files as pixels; a file that can't be read has an error and no pixels."""

    def run(batches):
        for pdf in batches:
            rows = []
            for path, data in zip(pdf["path"], pdf["content"]):
                try:
                    image = decode(bytes(data))
                    rows.append((path, *image.shape, image.tobytes(), None))
                except (ValueError, zlib.error, struct.error) as e:
                    rows.append((path, None, None, None, str(e)))
            out = pd.DataFrame(rows, columns=["path", "height", "width", "content", "error"])
            yield out.astype({"height": "Int32", "width": "Int32"})

    return files.select("path", "content").mapInPandas(run, IMAGE)


#: What Python decodes, and what the JVM's image source does.
OWN, JVM = (".png", ".pgm", ".ppm"), (".jpg", ".jpeg", ".tif", ".tiff")


def _jvm_decoded(files: DataFrame) -> DataFrame:
    """Rows of Spark's image source as pixels."""

    def run(batches):
        for pdf in batches:
            rows = []
            for path, h, w, n, data in zip(pdf["path"], pdf["height"], pdf["width"], pdf["nChannels"], pdf["data"]):
                if h is None or not h > 0:
                    rows.append((path, None, None, None, "not a JPEG or TIFF file that can be read"))
                    continue
                pixels = np.frombuffer(data, np.uint8).reshape(int(h), int(w), int(n))
                image = grey(pixels[..., 0] if n == 1 else pixels)
                rows.append((path, int(h), int(w), image.tobytes(), None))
            yield pd.DataFrame(rows, columns=["path", "height", "width", "content", "error"]).astype({"height": "Int32", "width": "Int32"})

    # The file's path as the binary source writes it.
    path = F.regexp_replace("image.origin", "^file:/+", "file:/").alias("path")
    return files.select(path, "image.height", "image.width", "image.nChannels", "image.data").mapInPandas(run, IMAGE)


def read_images(spark: SparkSession, folder: str, extensions: tuple[str, ...] = OWN + JVM, recursive: bool = True) -> DataFrame:
    """Pixels of a folder's image files, by extension in any case; a file that can't be read has an error and no pixels."""
    cased = lambda es: "*{" + ",".join(x for e in es for x in (e, e.upper())) + "}"
    reader = lambda kind, es: spark.read.format(kind).option("recursiveFileLookup", recursive).option("pathGlobFilter", cased(es)).load(folder)
    own, jvm = [e for e in extensions if e not in JVM], [e for e in extensions if e in JVM]
    parts = [decoded(reader("binaryFile", own).select("path", "content"))] if own else []
    parts += [_jvm_decoded(reader("image", jvm))] if jvm else []
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
