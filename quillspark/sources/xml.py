"""PAGE and ALTO files: detection, lines, pairing with images, and PAGE and TEI texts to write.

Lines are parsed by an Arrow-batched Python stage (an aligned pair of points and text for each line is beyond xpath());
a file that can't be parsed becomes a row of its own with the error, and fails nothing else.
"""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Iterator
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry
from ..functions.fixed_values import ALTO_NAMESPACE, ALTO_NAMESPACE_V2, PAGE_CREATOR, PAGE_NAMESPACE, PAGE_NAMESPACE_2013, TEI_NAMESPACE, TEI_PUBLICATION, TEI_SOURCE
from ..operators.tokens import xml_escape

IMAGE_EXTENSIONS = (".jpg", ".jpeg", ".png", ".tif", ".tiff")
LINES = "array<struct<line_id:string,points:string,text:string,hpos:string,vpos:string,width:string,height:string,kind:string>>"


def detect_format(content: Column) -> Column:
    """page or alto by what stands in the first 2,000 characters; any other file fails the row."""
    head = F.substring(content, 1, 2000)
    return F.when(F.contains(head, F.lit("PAGE/gts/pagecontent")), "page").when(F.contains(head, F.lit("standards/alto")), "alto").otherwise(F.raise_error(F.lit("neither PAGE nor ALTO")).cast("string"))


def _page_lines(root: ET.Element, namespaces: tuple[str, ...]) -> list[dict]:
    ns = next((n for n in namespaces if root.tag.startswith(f"{{{n}}}")), namespaces[-1])
    rows = []
    for line in root.iter(f"{{{ns}}}TextLine"):
        coords, text = line.find(f"{{{ns}}}Coords"), next(line.iter(f"{{{ns}}}Unicode"), None)
        rows.append({"line_id": line.get("id", ""), "points": "" if coords is None else coords.get("points", ""), "text": (text.text or "") if text is not None else "", "kind": "page"})
    return rows


def _alto_lines(root: ET.Element) -> list[dict]:
    ns = next((n for n in (ALTO_NAMESPACE, ALTO_NAMESPACE_V2) if root.tag.startswith(f"{{{n}}}")), ALTO_NAMESPACE_V2)
    rows = []
    for line in root.iter(f"{{{ns}}}TextLine"):
        polygon = next(line.iter(f"{{{ns}}}Polygon"), None)
        words = [s.get("CONTENT", "") for s in line.findall(f"{{{ns}}}String")]
        rows.append({"line_id": line.get("ID", ""), "points": None if polygon is None else polygon.get("POINTS", ""), "text": " ".join(w for w in words if w), "kind": "alto", **{k.lower(): line.get(k, "0") for k in ("HPOS", "VPOS", "WIDTH", "HEIGHT")}})
    return rows


def parse_lines(content: str, page_namespaces: tuple[str, ...] = (PAGE_NAMESPACE, PAGE_NAMESPACE_2013)) -> list[dict]:
    """The raw lines of one file."""
    root = ET.fromstring(content)
    head = content[:2000]
    if "PAGE/gts/pagecontent" in head:
        return _page_lines(root, page_namespaces)
    if "standards/alto" in head:
        return _alto_lines(root)
    raise ValueError("neither PAGE nor ALTO")


def _parsed(files: DataFrame, namespaces: tuple[str, ...]) -> DataFrame:
    """files(path, content) with lines and error."""

    @F.pandas_udf(f"struct<lines:{LINES},error:string>")
    def parse(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        names = ("line_id", "points", "text", "hpos", "vpos", "width", "height", "kind")
        for contents in batches:
            lines, errors = [], []
            for c in contents:
                try:
                    lines.append([{n: r.get(n) for n in names} for r in parse_lines(c or "", namespaces)])
                    errors.append(None)
                except (ET.ParseError, ValueError) as e:
                    lines.append([])
                    errors.append(str(e))
            yield pd.DataFrame({"lines": lines, "error": errors})

    return files.withColumn("parsed", parse(F.col("content").cast("string"))).select("path", "parsed.lines", "parsed.error")


def corpus_lines(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From files(path, content): (path, line_idx, text, polygon) of lines with both a text and a polygon, and (path, error) of files that can't be read.

    Texts are stripped. A PAGE token without a comma is skipped; any number that isn't one quarantines its page. A page is
    judged by its own array of lines, so neither result needs a shuffle.
    """
    number = lambda t: t.try_cast("double").isNotNull()

    def good(x: Column) -> Column:
        found = F.filter(F.split(F.coalesce(x["points"], F.lit("")), r"\s+"), lambda t: t != "")
        pair = lambda t: ~F.contains(t, F.lit(",")) | ((F.size(F.split(t, ",", -1)) == 2) & F.forall(F.split(t, ",", -1), number))
        return F.when(x["kind"] == "page", F.forall(found, pair)).otherwise(F.forall(found, number))

    parsed = _parsed(files, (PAGE_NAMESPACE, PAGE_NAMESPACE_2013))
    wrong = F.when(F.exists("lines", lambda x: ~good(x)), F.lit("not a number in a polygon"))
    judged = parsed.select("path", "lines", F.coalesce("error", wrong).alias("error"))
    bad = judged.where("error IS NOT NULL").select("path", "error")
    fine = judged.where("error IS NULL").select("path", F.posexplode("lines").alias("line_idx", "line")).select("path", "line_idx", "line.*")
    size = lambda c: F.coalesce(F.col(c).try_cast("double"), F.lit(0.0))
    polygon = F.when(F.col("kind") == "page", geometry.parse_points(F.col("points"))).otherwise(geometry.alto_polygon(F.col("points"), size("hpos"), size("vpos"), size("width"), size("height")))
    out = fine.select("path", "line_idx", F.regexp_replace("text", r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "").alias("text"), polygon.alias("polygon"))
    return out.where((F.length("text") > 0) & (F.size("polygon") > 0)), bad


def page_lines(files: DataFrame) -> DataFrame:
    """(path, line_idx, line_id, text, polygon) of every line of 2019 PAGE files, texts as they stand; a point without a comma fails the row."""
    rows = _parsed(files, (PAGE_NAMESPACE,)).select("path", F.posexplode("lines").alias("line_idx", "line"))
    return rows.select("path", "line_idx", "line.line_id", "line.text", geometry.parse_points(F.col("line.points"), strict=True).alias("polygon"))


def read_files(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """(path, content) of the files below path whose names match the glob pattern."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path).select("path", "content")


def pair_images(xml_paths: DataFrame, image_paths: DataFrame, extensions: tuple[str, ...] = IMAGE_EXTENSIONS) -> DataFrame:
    """(xml, image): each XML file's image of the same stem, in its folder by order of extension, else anywhere by extension and path; files without one are dropped."""
    parts = lambda df, name: df.select(F.col("path").alias(name), F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("dir"), F.regexp_extract("path", r"([^/]*?)(\.[^./]*)?$", 1).alias("stem"), F.lower(F.regexp_extract("path", r"(\.[^./]*)$", 1)).alias("ext"))
    xml = parts(xml_paths, "xml").drop("ext")
    order = F.array_position(F.array(*(F.lit(e) for e in extensions)), F.col("ext"))
    images = parts(image_paths, "image").withColumn("rank", order).where("rank > 0").select("stem", "rank", "image", F.col("dir").alias("image_dir"))
    # One aggregate a stem: the best image anywhere, and a folder's own by the join below.
    here = images.groupBy("stem", "image_dir").agg(F.min(F.struct("rank", "image")).alias("near"))
    anywhere = images.groupBy("stem").agg(F.min(F.struct("rank", "image")).alias("far"))
    found = xml.join(here, (xml["stem"] == here["stem"]) & (xml["dir"] == here["image_dir"]), "left").select("xml", xml["stem"].alias("stem"), "near").join(anywhere, "stem")
    return found.select("xml", F.coalesce("near.image", "far.image").alias("image"))


def page_xml(image_name: Column, width: Column, height: Column, lines: Column, created: Column, creator: str = PAGE_CREATOR) -> Column:
    """A PAGE document of lines (reading_order, polygon, text or null); created is its time stamp, a parameter so that equal input gives equal files."""
    attribute = lambda c: F.replace(xml_escape(c), F.lit('"'), F.lit("&quot;"))

    def line(x: Column) -> Column:
        equiv = F.coalesce(F.concat(F.lit("        <TextEquiv>\n          <Unicode>"), xml_escape(x["text"]), F.lit("</Unicode>\n        </TextEquiv>\n")), F.lit(""))
        return F.concat(F.lit('      <TextLine id="line_'), x["reading_order"].cast("string"), F.lit('">\n        <Coords points="'), geometry.format_points(x["polygon"]), F.lit('"/>\n'), equiv, F.lit("      </TextLine>\n"))

    return F.concat(
        F.lit(f'<?xml version="1.0" ?>\n<PcGts xmlns="{PAGE_NAMESPACE}">\n  <Metadata>\n    <Creator>{escape(creator)}</Creator>\n    <Created>'), created, F.lit("</Created>\n    <LastChange>"), created,
        F.lit('</LastChange>\n  </Metadata>\n  <Page imageFilename="'), attribute(image_name), F.lit('" imageWidth="'), width.cast("string"), F.lit('" imageHeight="'), height.cast("string"),
        F.lit('">\n    <TextRegion id="region_0">\n      <Coords points="'), geometry.format_points(geometry.page_polygon(width, height)), F.lit('"/>\n'), F.array_join(F.transform(lines, line), ""), F.lit("    </TextRegion>\n  </Page>\n</PcGts>\n"),
    )


def tei_xml(paragraph: Column, title: Column, publication: str = TEI_PUBLICATION, source: str = TEI_SOURCE) -> Column:
    """A TEI document around one tagged paragraph."""
    return F.concat(
        F.lit(f'<?xml version="1.0" ?>\n<TEI xmlns="{TEI_NAMESPACE}">\n  <teiHeader>\n    <fileDesc>\n      <titleStmt>\n        <title>'), xml_escape(title),
        F.lit(f"</title>\n      </titleStmt>\n      <publicationStmt>\n        <p>{escape(publication)}</p>\n      </publicationStmt>\n      <sourceDesc>\n        <p>{escape(source)}</p>\n      </sourceDesc>\n    </fileDesc>\n  </teiHeader>\n  <text>\n    <body>\n      <p>"),
        paragraph, F.lit("</p>\n    </body>\n  </text>\n</TEI>\n"),
    )


def write_texts(documents: DataFrame, path: str, content: str = "xml") -> None:
    """One text row a document; Spark names the files."""
    documents.select(content).write.mode("overwrite").option("lineSep", "\n").text(path)
