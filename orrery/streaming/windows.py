"""Event-time windows, for streams and for tables alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.sources.shared import new_path


def windowed(events: DataFrame, time: str, size: str, slide: str | None = None, keys: tuple[str, ...] = (), watermark: str | None = None) -> DataFrame:
    """Count and value sum by tumbling or sliding window; a watermark bounds the state of a stream."""
    df = events.withWatermark(time, watermark) if watermark else events
    w = F.window(time, size, slide) if slide else F.window(time, size)
    return df.groupBy(w.alias("w"), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def sessions(events: DataFrame, time: str, gap: str, key: str, watermark: str | None = None) -> DataFrame:
    df = events.withWatermark(time, watermark) if watermark else events
    return df.groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count("*").alias("n"))


def first_seen(events: DataFrame, time: str, keys: list[str], watermark: str) -> DataFrame:
    """A stream without repeats of a key within the watermark."""
    return events.withWatermark(time, watermark).dropDuplicatesWithinWatermark(keys)


def drain(stream: DataFrame, label: str, mode: str = "append") -> DataFrame:
    """Run a stream over all that its source holds now; the rows it wrote, read from the shared folder."""
    spark = stream.sparkSession
    path = new_path(spark, label)
    q = stream.writeStream.format("parquet").option("checkpointLocation", f"{path}/state").outputMode(mode).trigger(availableNow=True).start(f"{path}/rows")
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")


def read_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as a stream of files; times without a zone are taken in the session's, as watermarks need."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    raw = spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}*.parquet")
    return raw.select(*[F.col(f.name).cast("timestamp") if f.dataType.typeName() == "timestamp_ntz" else F.col(f.name) for f in schema])
