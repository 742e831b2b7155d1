"""Joins in time: the last value before, points in intervals; rows of a key in order, dealt over tasks in ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.sources.shared import cut

#: Rows of a range, about.
RANGE_ROWS = 1_000_000


def in_ranges(df: DataFrame, by: list[str], rows: int | None = None) -> DataFrame:
    """The rows in order of ``by``, with the number ``_range`` of the range that they are in.

    Ranges hold about ``rows`` (``RANGE_ROWS``) rows each whatever the values, so a hot key comes in many, and their numbers ascend with
    the order; a table of no more rows is one range.  Ranges are written, as a second reading would draw other bounds.
    """
    size, rows = df.count(), rows or RANGE_ROWS
    if size <= rows:
        return df.withColumn("_range", F.lit(0))
    df = cut(df, "rows")
    n = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // rows))
    return cut(df.repartitionByRange(n, *by).withColumn("_range", F.spark_partition_id()), "ranges")


def as_of(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, value: str) -> DataFrame:
    """``left`` with the ``value`` of the latest row of ``right`` with its key at or before its time, null if there is none.

    Both sides are sorted together once, in ranges; what a range ends with is carried into the next ones of the key.
    """
    own = left.select(F.col(key).alias("_k"), F.col(left_time).alias("_t"), F.lit(1).alias("_side"), F.struct("*").alias("_row"), F.lit(None).cast(right.schema[value].dataType).alias("_v"))
    other = right.select(F.col(key).alias("_k"), F.col(right_time).alias("_t"), F.lit(0).alias("_side"), F.lit(None).cast(own.schema["_row"].dataType).alias("_row"), F.col(value).alias("_v"))
    both = in_ranges(own.unionByName(other), ["_k", "_t", "_side"])
    before = Window.partitionBy("_k").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    ends = both.groupBy("_k", "_range").agg(F.max_by("_v", F.when(F.col("_v").isNotNull(), F.struct("_t", "_v"))).alias("_end"))
    carried = ends.select("_k", "_range", F.last("_end", ignorenulls=True).over(before).alias("_carried"))
    w = Window.partitionBy("_k", "_range").orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("_found", F.last("_v", ignorenulls=True).over(w)).where("_side = 1")
    joined = found.join(carried.withColumnsRenamed({"_k": "_ck", "_range": "_cr"}), (F.col("_k").eqNullSafe(F.col("_ck"))) & (F.col("_range") == F.col("_cr")), "left")
    return joined.select("_row.*", F.coalesce("_found", "_carried").alias(value))


def within(points: DataFrame, intervals: DataFrame, key: str, at: Column, start: Column, end: Column, width: int) -> DataFrame:
    """Points joined with the intervals of their key that hold them, ends included; times are whole numbers.

    Time is cut into buckets of ``width``: an interval is in all that it touches, a point in one, so a hot key is dealt
    over its buckets and no pair comes twice.
    """
    p = points.withColumns({"_at": at, "_bucket": F.floor(at / width)})
    i = intervals.withColumns({"_start": start, "_end": end}).where("_start <= _end")
    i = i.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col("_start") / width), F.floor(F.col("_end") / width))))
    return p.join(i, [key, "_bucket"]).where("_at BETWEEN _start AND _end").drop("_at", "_bucket", "_start", "_end")
