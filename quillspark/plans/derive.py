"""Inputs of the engine's kind, derived from the driver's tables by formulas that Spark and SQL share.

A line is up to 40 words of a text line, so that every character of every document is in some line.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators.tokens import Lexicon

WORDS_A_LINE = 40
LINE_STEP = 1_000_000

#: Entity words and relation verbs that occur in the tables' invented languages.
CORPUS_LEXICON = Lexicon(PER=("re", "er", "nd"), LOC=("th", "es"), TITLE=("el", "der"), ORG=("la", "sur"), DATE=("an", "und"))
CORPUS_VERBS = {"is": "EST", "was": "FUT", "tint": "TIENT", "von": "DE", "para": "POUR", "qui": "QUI"}
CORPUS_WORDS = ("the", "that", "and", "of", "one", "de", "la", "las", "el", "der", "die", "und", "le", "les", "que", "qui")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder for a query's files, removed when the application ends: in spark.checkpoint.dir, or a local one where that is unset and the master is local."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file://" + tempfile.gettempdir()
    path = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"

    def remove() -> None:
        if spark.sparkContext._jsc is not None:
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)

    atexit.register(remove)
    return path


def spread(df: DataFrame) -> DataFrame:
    """df over all cores where its files make fewer partitions than that, as one small file does. Larger inputs stay as they are read, without a shuffle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, pos, line) of all documents."""
    texts = spread(table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text"))
    docs = texts.select("doc_id", "lang", "source", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("ln", "x"))
    words = docs.select("doc_id", "lang", "source", "ln", F.split("x", " ").alias("w"))
    step = F.lit(WORDS_A_LINE)
    parts = F.transform(F.sequence(F.lit(0), F.size("w") - 1, step), lambda s: F.array_join(F.slice("w", s + 1, step), " "))
    return words.select("doc_id", "lang", "source", "ln", F.posexplode(parts).alias("part", "line")).select("doc_id", "lang", "source", (F.col("ln").cast("long") * LINE_STEP + F.col("part")).alias("pos"), "line")


def raw(line: Column) -> Column:
    """A line with medieval signs put in."""
    for a, b in ((" un", " vn"), ("que", "q~"), ("on", "õ"), ("et", "⁊")):
        line = F.replace(line, F.lit(a), F.lit(b))
    return line


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lines() with raw and norm."""
    return lines(spark, sf_dir).withColumn("raw", raw(F.col("line"))).withColumn("norm", text.normalise(F.col("raw")))


def percents(length: Column, doc_id: Column | None = None, pos: Column | None = None) -> Column:
    """Confidences in percent, 40 to 100, of the characters of a line, by default that of the columns doc_id and pos."""
    i, doc_id, pos = F.sequence(F.lit(1), length.cast("int")), F.col("doc_id") if doc_id is None else doc_id, F.col("pos") if pos is None else pos
    return F.when(length > 0, F.transform(i, lambda k: F.pmod(doc_id * 31 + pos * 17 + k * 7, F.lit(61)) + 40)).otherwise(F.array().cast("array<bigint>"))


def confidences(percent: Column) -> Column:
    """The same from 0 to 1."""
    return F.transform(percent, lambda p: p / F.lit(100.0))


def polygon(vector: Column) -> Column:
    """A polygon of non-negative pixels from the first 16 numbers of a vector."""
    at = lambda k: F.floor(F.abs(F.get(vector, k).cast("double")) * 1000)
    return F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.array(at(2 * i).cast("double"), at(2 * i + 1).cast("double")))


def raster_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, row_idx, pixels): a page for each document, 18 rows a text line, of which 12 (8 in every seventh line) have ink; 48 pixels wide.

    Only the lengths of a document's lines are shuffled, once, by document; its rows are made after that, where they stay.
    """
    texts = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    step = F.lit(WORDS_A_LINE)
    longest = lambda w: F.array_max(F.transform(F.sequence(F.lit(0), F.size(w) - 1, step), lambda s: F.length(F.array_join(F.slice(w, s + 1, step), " "))))
    # The words are an array of one, so that they are split once a text line.
    lengths = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.get(F.transform(F.array(F.split(x, " ")), longest), F.lit(0)))
    # Few bytes that become many rows: adaptive execution would join them in one partition.
    parts = max(spark.sparkContext.defaultParallelism, 4 * texts.rdd.getNumPartitions())
    pages = texts.select("doc_id", lengths.alias("n")).repartition(parts, "doc_id").groupBy("doc_id").agg(F.collect_list("n").alias("all"))
    highest = F.transform(F.sequence(F.lit(0), F.array_max(F.transform("all", F.size)) - 1), lambda k: F.array_max(F.transform("all", lambda n: F.get(n, k))))
    lines = pages.select("doc_id", F.posexplode(F.when(F.size("all") == 1, F.get("all", F.lit(0))).otherwise(highest)).alias("pos", "n"))
    rows = lines.select("doc_id", "pos", "n", F.explode(F.sequence(F.lit(0), F.lit(17))).alias("row"))
    inked = (F.col("row") >= 4) & (F.col("row") < F.when(F.col("pos") % 7 == 6, 12).otherwise(16))
    left, right = F.col("pos") % 5, F.least(F.lit(47), 10 + F.col("n") % 40)
    run = lambda value, n: F.array_repeat(F.lit(value), n)
    pixels = F.when(inked, F.concat(run(255, left), run(0, right - left + 1), run(255, 47 - right))).otherwise(run(255, F.lit(48)))
    return rows.select(F.col("doc_id").alias("page_id"), (F.col("pos") * 18 + F.col("row")).alias("row_idx"), pixels.alias("pixels"))
