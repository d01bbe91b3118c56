"""What the training-data operators share: tables in the shared folder, and private column names."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the input folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a temporary one with a local master and an error on a cluster, whose executors wouldn't see it."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="quillspark-")
        spark.conf.set("spark.checkpoint.dir", found)
        atexit.register(_remove_local, found.removeprefix("file://"))
    return found.rstrip("/")


def _remove_local(path: str) -> None:
    import shutil

    shutil.rmtree(path, ignore_errors=True)


class Workspace:
    """Intermediate tables of one run, written to the shared folder so that a lost executor costs no recomputed lineage."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.made = 0
        atexit.register(_remove_at_exit, spark, self.root)

    def path(self, label: str) -> str:
        """A path of its own below this workspace."""
        self.made += 1
        return f"{self.root}/{self.made:03d}-{label}"

    def keep(self, df: DataFrame, label: str) -> DataFrame:
        """Write df and read it again."""
        path = self.path(label)
        df.write.option("compression", "zstd").parquet(path)
        kept = self.spark.read.schema(df.schema).parquet(path)
        kept._workspace_path = path
        return kept

    def drop(self, *tables: DataFrame) -> None:
        """Remove tables that nothing reads any more."""
        for t in tables:
            remove(self.spark, t._workspace_path)


def _remove_at_exit(spark: SparkSession, path: str) -> None:
    """Results are lazy and may read a workspace until the application ends; a session that was stopped before can't be asked any more."""
    if spark.sparkContext._jsc is not None:
        remove(spark, path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a file or folder in whatever store it lies."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def private(df: DataFrame, *names: str) -> list[str]:
    """Column names that df doesn't have yet, derived from names."""
    taken = {c.lower() for c in df.columns}
    found = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        found.append(name)
    return found


def identity(doc_id: str, text: str) -> list[Column]:
    """128 bits that tell rows apart by id and text, two columns that are never null."""
    return [F.xxhash64(F.lit(n), F.col(doc_id), F.col(text)) for n in (1, 2)]


def values(column, step: int = 500) -> Iterator:
    """The Python values of an Arrow column; few are held at a time."""
    for at in range(0, len(column), step):
        yield from column.slice(at, step).to_pylist()


def texts(column) -> Iterator[bytes]:
    """An Arrow string column as UTF-8 bytes, nulls as empty."""
    import pyarrow as pa

    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return (x or b"" for x in values(column.cast(kind)))


def long_column(values: Iterable[int]):
    """An Arrow column of 64-bit integers."""
    import pyarrow as pa

    return pa.array(values, pa.int64())
