"""A versioned table that follows a stream of changes: one version for each micro-batch, applied once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.sources.shared import cut
from orrery.sources.versions import VersionedTable

#: Versions after which the table's parts are written as one.
COMPACT_AFTER = 16


def latest(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row of each key by ``order``; of equal ones the largest by the other columns."""
    rest = [c for c in rows.columns if c != key and c not in order]
    last = rows.groupBy(key).agg(F.max(F.struct(*order, *rest)).alias("_r"))
    return last.select(*[F.col(key) if c == key else F.col("_r")[c].alias(c) for c in rows.columns])


def applier(table: VersionedTable, source: str, key: str, order: list[str], gone: Column) -> Callable[[DataFrame, int], None]:
    """A function for ``foreachBatch``: takes the latest change of each key into ``table``.

    A change that is older than the table's row of its key is late and changes nothing; so a removed key stays in the
    table, marked ``gone``, and does not come back by a late change.  Null keys are left out.
    """

    def apply(batch: DataFrame, number: int) -> None:
        new = cut(latest(batch.where(F.col(key).isNotNull()), key, order).withColumn("gone", gone), "batch")
        if new.isEmpty():
            return
        if table.versions():
            now = table.read().select(F.col(key).alias("_k"), F.struct(*order).alias("_now"))
            met = new.join(now, F.col(key) == F.col("_k"), "left")
            new = cut(met.where(F.col("_now").isNull() | (F.struct(*order) > F.col("_now"))).drop("_k", "_now"), "newer")
        table.upsert(new, key, (source, number))
        if table.versions()[-1] % COMPACT_AFTER == 0:
            table.compact()

    return apply


class Follower:
    """A table below ``root`` and the stream that it follows: changes are files that come into ``root/inbox``."""

    def __init__(self, spark: SparkSession, root: str, key: str, order: list[str], gone: Column) -> None:
        self.spark, self.root = spark, root
        self.table = VersionedTable(spark, f"{root}/table")
        self.apply = applier(self.table, "inbox", key, order, gone)

    def feed(self, changes: DataFrame) -> None:
        """Put changes into the inbox and take in all that is new there."""
        changes.write.mode("append").parquet(f"{self.root}/inbox")
        stream = self.spark.readStream.schema(changes.schema).parquet(f"{self.root}/inbox")
        stream.writeStream.foreachBatch(self.apply).option("checkpointLocation", f"{self.root}/state").trigger(availableNow=True).start().awaitTermination()

    def read(self, version: int | None = None) -> DataFrame:
        """Rows of the keys that are not gone."""
        return self.table.read(version).where(~F.col("gone")).drop("gone")
