"""The experiment journal: JSON lines that are only ever appended to."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ENTRY = "timestamp string, nom string, parametres map<string,string>, metriques map<string,double>, notes string"


def read_journal(spark: SparkSession, path: str) -> DataFrame:
    """All entries, with their time parsed."""
    return spark.read.schema(ENTRY).json(path).withColumn("at", F.to_timestamp("timestamp"))


def append_entry(spark: SparkSession, path: str, name: str, parameters: dict, metrics: dict, notes: str = "", timestamp: str | None = None) -> None:
    """Append one entry; the time is now unless given."""
    schema = T._parse_datatype_string(ENTRY)
    row = (timestamp, name, {k: str(v) for k, v in parameters.items()}, {k: float(v) for k, v in metrics.items()}, notes)
    entry = spark.createDataFrame([row], schema)
    now = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    entry.withColumn("timestamp", F.coalesce("timestamp", now)).coalesce(1).write.mode("append").json(path)


def metric_rows(journal: DataFrame) -> DataFrame:
    """A row for each metric of each entry."""
    return journal.select("timestamp", "nom", F.explode("metriques").alias("metric", "value"))
