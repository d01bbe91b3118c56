"""End-to-end plans: pages to documents, documents to normalised lines, a corpus to its evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import contract, engines, evaluation, raster
from ..sources import corpus, images, journal, xml


HEAD = ("century", "document_type", "language", "source", "image_width", "image_height")


def pages_to_documents(pages: DataFrame, engine_name: str = "trocr") -> DataFrame:
    """From pages (page_id, century, document_type, language, source, image_width, image_height) joined to raster rows (row_idx, pixels): contract documents of their segmented and transcribed lines. A blank page is a document without lines."""
    return rows_to_documents(pages.select("page_id", "row_idx", "pixels"), pages.groupBy("page_id").agg(*(F.first(c).alias(c) for c in HEAD)), engine_name)


def rows_to_documents(rows: DataFrame, head: DataFrame, engine_name: str = "trocr") -> DataFrame:
    """pages_to_documents() for raster rows (page_id, row_idx, pixels) apart from what is known of each page, a row a page: no pixels are joined, and the rows are made once."""
    lines = raster.segment_lines(rows)
    transcribe = engines.engine(engine_name)
    document = F.col("page_id").cast("string")
    read = head.select("page_id", *HEAD).join(lines, "page_id", "left").withColumn("document_id", document).withColumn("line_id", contract.line_id(document, F.col("reading_order")))
    read = read.withColumn("result", transcribe(F.col("w"), F.col("line_id")))
    line = contract.make_line(F.col("line_id"), F.col("result.text"), F.col("polygon"), F.col("result.char_confidences"), F.col("reading_order"), F.col("result.candidates"))
    return contract.validated(contract.make_documents(read.withColumn("line", F.when(F.col("reading_order").isNotNull(), line))))


def folder_to_documents(spark: SparkSession, folder: str, century: int, document_type: str, language: str, source: str, engine_name: str = "trocr", preprocess: bool = True) -> DataFrame:
    """Contract documents of all readable images directly in a folder; a document is named after its file. Its PAGE text is in page_xml. unread_images() has the others."""
    pictures = images.read_images(spark, folder, recursive=False).where("error IS NULL")
    named = pictures.withColumn("page_id", F.regexp_extract("path", r"([^/]*?)(\.[^./]*)?$", 1)).select("page_id", "height", "width", "content")
    prepared = raster.preprocessed(named) if preprocess else named
    meta = named.select("page_id", F.lit(century).alias("century"), F.lit(document_type).alias("document_type"), F.lit(language).alias("language"), F.lit(source).alias("source"), F.col("width").alias("image_width"), F.col("height").alias("image_height"))
    documents = pages_to_documents(raster.pixel_rows(prepared).join(meta, "page_id"), engine_name)
    lines = F.transform("lines", lambda x: F.struct(x["reading_order"].alias("reading_order"), x["polygon"].alias("polygon"), x["text"].alias("text")))
    size = F.col("coordinate_system")
    return documents.withColumn("page_xml", xml.page_xml(F.concat("document_id", F.lit(".png")), size["image_width"], size["image_height"], lines, F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss")))


def unread_images(spark: SparkSession, folder: str, recursive: bool = False) -> DataFrame:
    """(path, error) of the folder's images that can't be read."""
    return images.read_images(spark, folder, recursive=recursive).where("error IS NOT NULL").select("path", "error")


def normalise_documents(documents: DataFrame, correction: bool = True) -> DataFrame:
    """Lines of contract documents with text_normalise beside the raw text."""
    lines = contract.flatten(documents)
    if correction:
        return lines.withColumn("text_normalise", text.normalise_line(F.col("text"), F.col("char_confidences"), F.col("candidates")))
    return lines.withColumn("text_normalise", text.normalise(F.col("text")))


def normalisation_impact(lines: DataFrame) -> DataFrame:
    """How far each stage of normalisation moves the lines."""
    rows = lines.select("text", text.normalise(F.col("text")).alias("rules"), "text_normalise")
    return evaluation.wide_transitions(rows, {"brut": "text", "regles": "rules", "correction": "text_normalise"})


def evaluate_engine(spark: SparkSession, lines: DataFrame, engine_name: str, journal_path: str | None = None, iterations: int = 1000) -> dict:
    """A corpus of lines (line_id, width, reference) read by an engine: its report, and an entry in the journal. An empty corpus is an error."""
    if lines.isEmpty():
        raise ValueError("the corpus has no line")
    read = lines.withColumn("prediction", engines.engine(engine_name)(F.col("width"), F.col("line_id"))["text"])
    found = evaluation.report(read, ("line_id",), iterations=iterations) | {"modele": engine_name}
    if journal_path:
        journal.append_entry(spark, journal_path, f"eval_{engine_name}_corpus", {"modele": engine_name, "n_lignes": found["n_lignes"]}, {"CER": found["CER"], "WER": found["WER"]}, f"Évaluation de {engine_name} sur corpus")
    return found


def evaluate_corpus(spark: SparkSession, folder: str, engine_name: str, metadata: dict[str, str] | None = None, limit: int | None = None, journal_path: str | None = None, iterations: int = 1000) -> dict:
    """evaluate_engine() over a corpus on disk, named after its folder."""
    examples, _ = corpus.load_corpus(spark, folder, metadata, limit)
    lines = examples.select(F.concat_ws("#", "path", "line_idx").alias("line_id"), "width", F.col("text").alias("reference"))
    return evaluate_engine(spark, lines, engine_name, journal_path, iterations) | {"corpus": folder.rstrip("/").rpartition("/")[2]}


def compare_engines(lines: DataFrame, a: str = "trocr", b: str = "kraken") -> dict:
    """Both engines over the same lines (line_id, width, reference)."""
    read = lines.withColumn(a, engines.engine(a)(F.col("width"), F.col("line_id"))["text"]).withColumn(b, engines.engine(b)(F.col("width"), F.col("line_id"))["text"])
    return evaluation.compare_report(read, "reference", a, b) | {"n_lignes": read.count()}
