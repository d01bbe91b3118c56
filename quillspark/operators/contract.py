"""The data contract: lines and documents, their construction, validation, flattening and review rates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import sequences
from ..functions.fixed_values import CENTURIES, DEFAULT_LICENSE, DOCUMENT_TYPES, REVIEW_THRESHOLD

LINE = T.StructType(
    [
        T.StructField("line_id", T.StringType()),
        T.StructField("reading_order", T.IntegerType()),
        T.StructField("text", T.StringType()),
        T.StructField("polygon", T.ArrayType(T.ArrayType(T.DoubleType()))),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("char_confidences", T.ArrayType(T.DoubleType())),
        T.StructField("needs_review", T.BooleanType()),
        T.StructField("candidates", T.ArrayType(T.StructType([T.StructField("position", T.IntegerType()), T.StructField("options", T.ArrayType(T.StringType()))]))),
    ]
)
METADATA = T.StructType([T.StructField("century", T.IntegerType()), *(T.StructField(n, T.StringType()) for n in ("document_type", "language", "source", "license"))])
COORDINATES = T.StructType([T.StructField("origin", T.StringType()), T.StructField("unit", T.StringType()), T.StructField("image_width", T.IntegerType()), T.StructField("image_height", T.IntegerType())])
DOCUMENT = T.StructType([T.StructField("document_id", T.StringType()), T.StructField("metadata", METADATA), T.StructField("coordinate_system", COORDINATES), T.StructField("lines", T.ArrayType(LINE))])


def line_id(document_id: Column, reading_order: Column) -> Column:
    """document_lineNNN, three digits at least."""
    return F.format_string("%s_line%03d", document_id.cast("string"), reading_order.cast("int"))


def make_line(line_id: Column, text: Column, polygon: Column, confidences: Column, reading_order: Column | None = None, candidates: Column | None = None) -> Column:
    """A contract line. Review is decided on the unrounded mean; a confidence outside of 0 to 1 fails the row; no candidates become null."""
    bad = F.exists(confidences, lambda c: c.isNull() | F.isnan(c) | (c < 0) | (c > 1))
    sure = F.when(bad, F.raise_error(F.lit("a confidence is outside of 0 to 1")).cast("array<double>")).otherwise(confidences)
    no_candidates = F.lit(None).cast(LINE["candidates"].dataType)
    given = no_candidates if candidates is None else F.when(F.size(candidates) > 0, candidates.cast(LINE["candidates"].dataType))
    line = lambda mean: F.struct(
        line_id.alias("line_id"),
        (F.lit(0) if reading_order is None else reading_order).cast("int").alias("reading_order"),
        text.alias("text"),
        polygon.alias("polygon"),
        sequences.rounded(mean, 4).alias("confidence"),
        confidences.alias("char_confidences"),
        (mean < REVIEW_THRESHOLD).alias("needs_review"),
        given.alias("candidates"),
    )
    return sequences.bound(sequences.bound(sure, sequences.mean), line)


def make_documents(lines: DataFrame, document_id: str = "document_id", line: str = "line", century: str = "century", document_type: str = "document_type", language: str = "language", source: str = "source", width: str = "image_width", height: str = "image_height", license: str = DEFAULT_LICENSE, build: Callable[[Column], Column] | None = None) -> DataFrame:
    """Rows of lines with their document's metadata, gathered to contract documents in reading order; a row without a line makes a document without lines. A document's lines are one row by contract.

    build: makes the contract line from a gathered one, which then needs only reading_order, line_id and what build reads;
    what is shuffled is that, not the confidences and candidates of each character.
    """
    sortable = F.when(F.col(line).isNotNull(), F.struct(F.col(f"{line}.reading_order").alias("o"), F.col(f"{line}.line_id").alias("i"), F.col(line).alias("line")))
    ordered = F.transform(F.sort_array(F.collect_list(sortable)), lambda x: x["line"])
    whole = lines.groupBy(F.col(document_id).alias("document_id")).agg(*(F.first(c).alias(n) for n, c in (("century", century), ("document_type", document_type), ("language", language), ("source", source), ("w", width), ("h", height))), ordered.alias("lines"))
    if build is not None:
        # Generated, so that no filter on the lines is moved below them and builds them anew.
        whole = whole.select(*(c for c in whole.columns if c != "lines"), F.explode(F.array(F.transform("lines", build))).alias("lines"))
    return whole.select(
        F.col("document_id").cast("string").alias("document_id"),
        F.struct(F.col("century").cast("int").alias("century"), "document_type", "language", "source", F.lit(license).alias("license")).alias("metadata"),
        F.struct(F.lit("top_left").alias("origin"), F.lit("pixel").alias("unit"), F.col("w").cast("int").alias("image_width"), F.col("h").cast("int").alias("image_height")).alias("coordinate_system"),
        "lines",
    )


def violations() -> Column:
    """All broken rules of a contract document as "path : message", in path order; empty for a valid one."""

    def need(ok: Column, message: str) -> Column:
        return F.when(~F.coalesce(ok, F.lit(False)), F.lit(message))

    present = [need(F.col(p).isNotNull(), f"$.{p} : is required") for p in ("document_id", "metadata", "coordinate_system", "lines")]
    meta = [need(F.col("metadata").isNull() | F.col(f"metadata.{p}").isNotNull(), f"$.metadata.{p} : is required") for p in ("century", "document_type", "language", "source")]
    system = [need(F.col("coordinate_system").isNull() | F.col(f"coordinate_system.{p}").isNotNull(), f"$.coordinate_system.{p} : is required") for p in ("origin", "unit")]
    null_or = lambda c, ok: F.col(c).isNull() | ok
    values = [
        need(null_or("metadata.century", F.col("metadata.century").between(*CENTURIES)), "$.metadata.century : is out of range"),
        need(null_or("metadata.document_type", F.col("metadata.document_type").isin(*DOCUMENT_TYPES)), "$.metadata.document_type : is not a known type"),
        need(null_or("coordinate_system.origin", F.col("coordinate_system.origin") == "top_left"), "$.coordinate_system.origin : is not top_left"),
        need(null_or("coordinate_system.unit", F.col("coordinate_system.unit") == "pixel"), "$.coordinate_system.unit : is not pixel"),
    ]
    unit = lambda x: (x >= 0) & (x <= 1)

    def of_line(x: Column, i: Column) -> Column:
        rules = [(x[f].isNotNull(), f, "is required") for f in ("line_id", "text", "polygon", "confidence", "char_confidences", "needs_review")]
        rules += [
            (x["polygon"].isNull() | (F.size(x["polygon"]) >= 3), "polygon", "has fewer than 3 points"),
            (x["polygon"].isNull() | F.forall(x["polygon"], lambda p: F.size(p) == 2), "polygon", "has a point without 2 numbers"),
            (x["confidence"].isNull() | unit(x["confidence"]), "confidence", "is out of range"),
            (x["char_confidences"].isNull() | F.forall(x["char_confidences"], unit), "char_confidences", "has a value out of range"),
            (x["reading_order"].isNull() | (x["reading_order"] >= 0), "reading_order", "is negative"),
            (x["candidates"].isNull() | F.forall(x["candidates"], lambda c: c["position"] >= 0), "candidates", "has a negative position"),
        ]
        path = lambda f, m: F.concat(F.lit("$.lines["), i.cast("string"), F.lit(f"].{f} : {m}"))
        return F.array_compact(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), path(f, m)) for ok, f, m in rules)))

    lines = F.flatten(F.transform(F.coalesce(F.col("lines"), F.array().cast(DOCUMENT["lines"].dataType)), of_line))
    return F.concat(F.array_compact(F.array(*present, *meta, *system, *values)), lines)


def validated(documents: DataFrame) -> DataFrame:
    """documents with violations, valid and message (OK, or the first violation)."""
    found = documents.withColumn("violations", violations())
    valid = F.size("violations") == 0
    return found.withColumn("valid", valid).withColumn("message", F.when(valid, "OK").otherwise(F.get("violations", F.lit(0))))


def review_rate(lines: Column) -> Column:
    """The share of a document's lines that need review, 0 without lines."""
    n = F.size(lines)
    return F.when(n > 0, F.size(F.filter(lines, lambda x: x["needs_review"])) / F.when(n > 0, n)).otherwise(F.lit(0.0))


def flatten(documents: DataFrame) -> DataFrame:
    """A row for each line with its document's id, century and type."""
    rows = documents.select("document_id", "metadata.century", "metadata.document_type", F.explode("lines").alias("line"))
    return rows.select("document_id", "century", "document_type", "line.*")
