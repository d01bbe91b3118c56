"""Stratified splits, their distribution, and seals."""

from __future__ import annotations

import hashlib
import json
from pathlib import Path

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .evaluation import bucket_digits

SPLITS = ("train", "val", "test")


def stratified_split(df: DataFrame, stratum: Column, row_id: Column, proportions: tuple[float, float, float] = (0.7, 0.15, 0.15), seed: int = 42) -> DataFrame:
    """df with a split column: in each stratum, in the order of a seeded hash, the first int(n * p) rows are train, the next val, the rest test. A missing stratum is "inconnu".

    A stratum may hold most rows, so no task gets it whole: ranks come from hash buckets of each stratum, 256 or as many as
    the rows need, shifted by the sizes of the buckets before (a row a bucket and stratum).
    """
    if abs(sum(proportions) - 1) > 1e-6:
        raise ValueError(f"proportions must add up to 1: {proportions}")
    order = F.md5(F.concat_ws(":", F.lit(seed), row_id.cast("string")))
    rows = df.withColumn("__stratum", F.coalesce(stratum.cast("string"), F.lit("inconnu"))).withColumn("__order", order).withColumn("__row", row_id.cast("string"))
    rows = rows.withColumn("__bucket", F.substring("__order", 1, bucket_digits(df.count())))
    sizes = rows.groupBy("__stratum", "__bucket").agg(F.count(F.lit(1)).alias("__n"))
    every = Window.partitionBy("__stratum")
    shifts = sizes.select(
        "__stratum", "__bucket", F.sum("__n").over(every).alias("__all"), F.coalesce(F.sum("__n").over(every.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before")
    )
    ranked = rows.withColumn("__rank", F.row_number().over(Window.partitionBy("__stratum", "__bucket").orderBy("__order", "__row"))).join(shifts, ["__stratum", "__bucket"])
    rank = F.col("__rank") + F.col("__before")
    n_train, n_val = (F.floor(F.col("__all") * F.lit(float(p))) for p in proportions[:2])
    split = F.when(rank <= n_train, SPLITS[0]).when(rank <= n_train + n_val, SPLITS[1]).otherwise(SPLITS[2])
    return ranked.withColumn("split", split).drop("__stratum", "__order", "__row", "__bucket", "__rank", "__all", "__before")


def distribution(df: DataFrame, stratum: Column, split: str = "split") -> DataFrame:
    """Rows of each split and stratum."""
    return df.groupBy(split, F.coalesce(stratum.cast("string"), F.lit("inconnu")).alias("stratum")).agg(F.count(F.lit(1)).alias("n"))


def row_digest(*columns: str) -> Column:
    """SHA-256 of a row's values under their names in order."""
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)


def seal(df: DataFrame, *columns: str) -> DataFrame:
    """(digest, n): one SHA-256 of all rows whatever their order; a changed, lost or added row changes it.

    Row digests are gathered by their first six hex digits, the digests of those 16 million groups by three, and those of
    4,096 groups make the seal, so no task gathers more than a small share of the rows.
    """
    level = df.select(row_digest(*columns).alias("d"), F.lit(1).cast("long").alias("n")).withColumn("g", F.col("d"))
    for digits in (6, 3, 0):
        ordered = F.transform(F.sort_array(F.collect_list(F.struct("g", "d"))), lambda x: x["d"])
        grouped = level.groupBy(F.substring("g", 1, digits).alias("g")) if digits else level.groupBy()
        level = grouped.agg(F.sha2(F.array_join(ordered, ""), 256).alias("d"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    return level.select(F.col("d").alias("digest"), "n")


def sealed_as(df: DataFrame, digest: str, *columns: str) -> bool:
    """Whether the rows still have that seal."""
    return seal(df, *columns).first()["digest"] == digest


def file_digests(files: DataFrame) -> DataFrame:
    """(path, sha256) of rows of Spark's binaryFile source."""
    return files.select("path", F.sha2("content", 256).alias("sha256"))


def seal_file(df: DataFrame, path: str, *order: str, most: int = 100_000) -> str:
    """A small test set as sorted, indented JSON beside its SHA-256, both on the driver. Larger sets than `most` rows are an error: seal() has no bound."""
    rows = [r.asDict(recursive=True) for r in df.orderBy(*order).limit(most + 1).collect()]
    if len(rows) > most:
        raise ValueError(f"more than {most} rows: use seal()")
    content = json.dumps(rows, sort_keys=True, ensure_ascii=False, indent=2)
    digest = hashlib.sha256(content.encode()).hexdigest()
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(content, encoding="utf-8")
    Path(path).with_suffix(".sha256").write_text(digest + "\n", encoding="utf-8")
    return digest


def file_sealed_as(path: str, digest: str) -> bool:
    """Whether the file still has that SHA-256."""
    return hashlib.sha256(Path(path).read_bytes()).hexdigest() == digest
