"""Versioned tables: append, replace, drop, look at and go back, migrate; and small tables to and from Arrow."""

from __future__ import annotations

import json
import time
import uuid
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.sources.shared import drop_path


class VersionedTable:
    """A table as folders of Parquet and one small manifest a version, which lists the folders that the version has.

    Appending writes the new rows only; old versions keep their folders, so any of them can be read again.  A commit
    creates the next manifest and fails if another writer has made it first.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        p, fs = self._fs(f"{self.root}/manifests")
        return sorted(int(s.getPath().getName().removesuffix(".json")) for s in fs.listStatus(p)) if fs.exists(p) else []

    def manifest(self, version: int | None = None) -> dict:
        known = self.versions()
        if not known or (version is not None and version not in known):
            raise ValueError(f"no version {version or ''} of {self.root}")
        p, fs = self._fs(f"{self.root}/manifests/{version or known[-1]}.json")
        stream = fs.open(p)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _commit(self, parts: list[str], action: str, dead: list | None = None, applied: dict[str, int] | None = None) -> int:
        version = (self.versions() or [0])[-1] + 1
        if applied is None:
            applied = self.manifest().get("applied", {}) if version > 1 else {}
        p, fs = self._fs(f"{self.root}/manifests/{version}.json")
        out = fs.create(p, False)
        try:
            out.write(bytearray(json.dumps({"version": version, "action": action, "parts": parts, "dead": dead or [], "applied": applied, "time": int(time.time())}).encode()))
        finally:
            out.close()
        return version

    def _write(self, df: DataFrame, partition_by: str | None = None) -> str:
        part = f"{self.root}/data/{uuid.uuid4().hex}"
        writer = df.write
        (writer.partitionBy(partition_by) if partition_by else writer).parquet(part)
        return part

    def append(self, df: DataFrame, partition_by: str | None = None) -> int:
        m = self.manifest() if self.versions() else {"parts": []}
        return self._commit([*m["parts"], self._write(df, partition_by)], "append", m.get("dead"))

    def replace(self, df: DataFrame) -> int:
        return self._commit([self._write(df)], "replace")

    def delete(self, condition: Column) -> int:
        kept = self.read().where(~F.coalesce(condition, F.lit(False)))
        return self._commit([self._write(kept)], "delete")

    def upsert(self, new: DataFrame, key: str, batch: tuple[str, int] | None = None) -> int | None:
        """Rows of ``new`` replace those with their keys; only they and their keys are written, ``read`` hides the rest.

        ``batch`` is (source, number): a batch that a source has had applied already changes nothing and gives None, so
        a stream that repeats its last batch after a failure has it once.  Keys of ``new`` are unique.
        """
        m = self.manifest() if self.versions() else {"parts": []}
        applied = m.get("applied", {})
        if batch and applied.get(batch[0], -1) >= batch[1]:
            return None
        part = self._write(new)
        keys = self._write(self.spark.read.schema(new.schema).parquet(part).select(key))
        dead = [*m.get("dead", []), [keys, key, len(m["parts"])]]
        return self._commit([*m["parts"], part], "upsert", dead, {**applied, batch[0]: batch[1]} if batch else applied)

    def compact(self) -> int:
        """The latest version as one part without hidden rows."""
        return self._commit([self._write(self.read())], "compact")

    def read(self, version: int | None = None) -> DataFrame:
        """The latest version, or an older one; columns that a folder lacks are null."""
        m = self.manifest(version)
        parts = [self.spark.read.parquet(p) for p in m["parts"]]
        hidden = m.get("dead", [])
        if not hidden:
            return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
        out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [p.withColumn("_part", F.lit(i)) for i, p in enumerate(parts)])
        for key in dict.fromkeys(k for _, k, _ in hidden):
            own = [self.spark.read.parquet(p).select(F.col(key).alias("_key"), F.lit(before).alias("_before")) for p, k, before in hidden if k == key]
            last = reduce(DataFrame.unionByName, own).groupBy("_key").agg(F.max("_before").alias("_before"))
            out = out.join(last, F.col(key) == F.col("_key"), "left").where(F.col("_before").isNull() | (F.col("_part") >= F.col("_before"))).drop("_key", "_before")
        return out.drop("_part")

    def checkout(self, version: int) -> int:
        """Make an older version the latest one."""
        m = self.manifest(version)
        return self._commit(m["parts"], "checkout", m.get("dead"))

    def info(self) -> dict:
        m = self.manifest()
        df = self.read()
        return {"version": m["version"], "rows": df.count(), "columns": df.columns, "parts": len(m["parts"])}

    def fragments(self) -> DataFrame:
        """(part, rows, files) of each folder of the latest version."""
        out = None
        for i, p in enumerate(self.manifest()["parts"]):
            one = self.spark.read.parquet(p).select(F.input_file_name().alias("file")).agg(F.lit(i).alias("part"), F.count("*").alias("rows"), F.countDistinct("file").alias("files"))
            out = one if out is None else out.unionByName(one)
        return out

    def pending_migrations(self, columns: dict[str, str]) -> dict[str, str]:
        """Of the wanted columns (name -> type) those that the table lacks or has with another type."""
        have = dict(self.read().dtypes)
        return {c: t for c, t in columns.items() if have.get(c) != t}

    def migrate(self, columns: dict[str, str]) -> int | None:
        """Bring the table to the wanted types in a new version; None if there is nothing to do."""
        todo = self.pending_migrations(columns)
        if not todo:
            return None
        df = self.read()
        have = set(df.columns)
        return self.replace(df.withColumns({c: (F.col(c) if c in have else F.lit(None)).cast(t) for c, t in todo.items()}))

    def drop(self) -> None:
        drop_path(self.spark, self.root)


def to_ipc(df: DataFrame, limit: int, metadata: dict[str, str] | None = None, trace: str | None = None) -> bytes:
    """At most ``limit`` rows as an Arrow stream, with metadata and a trace id in its schema."""
    table = df.limit(limit).toArrow()
    extra = {**(metadata or {}), **({"trace_id": trace} if trace else {})}
    table = table.replace_schema_metadata({**(table.schema.metadata or {}), **{k.encode(): v.encode() for k, v in extra.items()}})
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def from_ipc(spark: SparkSession, data: bytes) -> tuple[DataFrame, dict[str, str]]:
    """The rows and the metadata of an Arrow stream."""
    table = pa.ipc.open_stream(data).read_all()
    return spark.createDataFrame(table), {k.decode(): v.decode() for k, v in (table.schema.metadata or {}).items()}


def arrow_relation(spark: SparkSession, namespace: str, name: str, table: pa.Table | list[dict]) -> DataFrame:
    """Rows that the caller holds, as a table of SQL called ``namespace_name``."""
    df = spark.createDataFrame(table if isinstance(table, pa.Table) else pa.Table.from_pylist(table))
    df.createOrReplaceTempView(f"{namespace}_{name}")
    return df
