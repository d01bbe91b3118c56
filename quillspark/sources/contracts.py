"""Contract documents as JSON: one pretty-printed file a document, strict or with a quarantine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.contract import DOCUMENT, validated


def read_contracts(spark: SparkSession, path: str, strict: bool = True, lines: bool = False) -> DataFrame:
    """Documents of one file, or of the *.json and *.json.gz of one folder, with their file name and verdict.

    Strict: any unparsable or invalid file fails the read. Otherwise rows keep valid = false and their violations. lines:
    a document a line, as write_contracts() writes them, instead of a document a file.
    """
    reader = spark.read.schema(T.StructType([*DOCUMENT.fields, T.StructField("_corrupt", T.StringType())])).option("multiLine", not lines).option("columnNameOfCorruptRecord", "_corrupt").option("mode", "PERMISSIVE")
    whole = reader.json(path if path.endswith((".json", ".json.gz")) else f"{path.rstrip('/')}/*.json{{,.gz}}")
    found = validated(whole.withColumn("file", F.col("_metadata.file_path")))
    valid = F.col("valid") & F.col("_corrupt").isNull()
    found = found.withColumn("valid", valid).withColumn("message", F.when(F.col("_corrupt").isNotNull(), "not a JSON document").otherwise(F.col("message"))).drop("_corrupt")
    if strict:
        found = found.where(F.when(F.col("valid"), True).otherwise(F.raise_error(F.concat_ws(" : ", "file", "message")).cast("boolean")))
    return found


def split_quarantine(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid documents, and the others with what is wrong."""
    return documents.where("valid").select(*DOCUMENT.fieldNames()), documents.where("NOT valid")


def write_contracts(documents: DataFrame, path: str, strict: bool = True) -> None:
    """JSON lines of the documents, by gzip: a confidence and candidates a character make some 30 bytes of JSON of one of text. Strict: one invalid document fails the write before anything is committed; otherwise only valid ones are written."""
    found = validated(documents)
    if strict:
        ok = F.when(F.col("valid"), True).otherwise(F.raise_error(F.col("message")).cast("boolean"))
    else:
        ok = F.col("valid")
    found.where(ok).select(*documents.columns).write.mode("overwrite").option("compression", "gzip").json(path)
