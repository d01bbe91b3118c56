"""Incremental ingestion (an extension): contract documents as they arrive in a folder, to lines and running statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import abbreviation_count, normalise
from ..operators.contract import DOCUMENT, flatten, validated


def stream_contracts(spark: SparkSession, folder: str, files_a_batch: int = 1000) -> DataFrame:
    """Documents of new JSON files in the folder, with their verdict."""
    return validated(spark.readStream.schema(DOCUMENT).option("multiLine", True).option("maxFilesPerTrigger", files_a_batch).json(folder))


def write_lines(documents: DataFrame, out: str, quarantine: str, checkpoint: str) -> StreamingQuery:
    """Normalised lines of valid documents to Parquet, the others to a quarantine, once for each batch even if it is repeated."""

    def one(batch: DataFrame, n: int) -> None:
        batch.persist()
        lines = flatten(batch.where("valid")).withColumn("text_normalise", normalise(F.col("text")))
        # A batch's own folder, so that a repeated batch replaces itself.
        lines.write.mode("overwrite").parquet(f"{out}/batch={n}")
        batch.where("NOT valid").select("document_id", "violations").write.mode("overwrite").parquet(f"{quarantine}/batch={n}")
        batch.unpersist()

    return documents.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def running_statistics(documents: DataFrame) -> DataFrame:
    """Lines, review rate and unresolved abbreviations by century over all documents so far."""
    lines = flatten(documents.where("valid"))
    return lines.groupBy("century").agg(
        F.count(F.lit(1)).alias("n_lines"), F.avg(F.col("needs_review").cast("int")).alias("review_rate"), F.sum(abbreviation_count(F.col("text")).cast("long")).alias("n_abbreviations")
    )
