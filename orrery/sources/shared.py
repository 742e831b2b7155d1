"""The folder that driver and executors share; tables written there cut lineage and outlive lost executors."""

from __future__ import annotations

import hashlib
import json
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


#: Folders that this process has made in the shared folder, for ``clean_up``.
_MADE: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a temporary folder only where it is unset and the master is local (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="orrery-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    _MADE.append(f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex[:12]}")
    return _MADE[-1]


def stamped_path(table: DataFrame, label: str, facts: list) -> str:
    """A folder in the shared one, named after a table's files as they are now, so that a changed table has another."""
    spark, files, stamp = table.sparkSession, sorted(table.inputFiles()), 0
    for f in files:
        p = spark._jvm.org.apache.hadoop.fs.Path(f)
        status = p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p)
        stamp += status.getLen() + status.getModificationTime()
    return f"{shared_dir(spark)}/{label}-{hashlib.sha256(json.dumps([files, stamp, facts]).encode()).hexdigest()[:16]}"


def drop_path(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def clean_up(spark: SparkSession) -> int:
    """Delete all intermediate tables of this process; call it once no result that reads them is needed any more."""
    n = len(_MADE)
    while _MADE:
        drop_path(spark, _MADE.pop())
    return n


def cut(df: DataFrame, label: str = "step") -> DataFrame:
    """The same rows, read from a table."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


class Saved:
    """Tables of one operator, written below one folder of the shared folder."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.name = spark, name
        self.root = new_path(spark, name)
        self.n = 0

    def path(self, label: str) -> str:
        self.n += 1
        return f"{self.root}/{self.n:03d}-{label}"

    def keep(self, df: DataFrame, label: str, partition_by: list[str] | None = None) -> DataFrame:
        """Write ``df`` once and return a reader of what was written."""
        to = self.path(label)
        writer = df.write.option("compression", "zstd").option("parquet.compression.codec.zstd.level", "1")
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(to)
        out = self.spark.read.schema(df.schema).parquet(to)
        out._saved_path = to
        return out

    def keep_sorted(self, df: DataFrame, label: str, keys: list[str], buckets: int) -> DataFrame:
        """As ``keep``, dealt by hash of ``keys`` over ``buckets`` and sorted by them in each: joins on them need no exchange.

        The bucketing is known to the session's catalog under a name of its own until ``drop``.
        """
        to = self.path(label)
        name = f"orrery_{uuid.uuid4().hex}"
        writer = df.write.format("parquet").option("compression", "zstd").option("parquet.compression.codec.zstd.level", "1").option("path", to)
        writer.bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(name)
        out = self.spark.table(name)
        out._saved_path, out._saved_name = to, name
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that no later plan reads."""
        for t in tables:
            if name := getattr(t, "_saved_name", None):
                self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            self.drop_path(t._saved_path)

    def drop_path(self, path: str) -> None:
        drop_path(self.spark, path)


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, unless their Python finds it by the same path as the driver's."""
    root, context = Path(__file__).resolve().parents[2], spark.sparkContext
    if str(root) in os.environ.get("PYTHONPATH", "").split(os.pathsep) or Path.cwd() == root or getattr(context, "_orrery_shipped", False):
        return
    archive = Path(tempfile.mkdtemp(prefix="orrery-")) / "orrery.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted((root / "orrery").rglob("*.py")):
            z.write(f, f.relative_to(root))
    context.addPyFile(str(archive))
    context._orrery_shipped = True
