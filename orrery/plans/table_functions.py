"""Table functions of SQL and filters that a scan takes in part."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from orrery.operators import search, surface
from orrery.plans import states  # noqa: F401  it registers the plugin
from orrery.plans.registry import query
from orrery.sources.relations import Relations, register_batches
from orrery.sources.tables import table


@query("SELECT click_id, value FROM clicks WHERE kind = 'view' AND value >= 20 AND CASE WHEN json_valid(props) THEN json_extract_string(props, '$.device.os') END = 'android'")
def filter_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A condition that the scan takes, and one on JSON that is applied to its rows."""
    clicks = search.filtered(table(spark, sf_dir, "clicks"), "kind = 'view' AND value >= 20")
    return search.filtered(clicks, '{"device.os": "android"}', metadata="props").select("click_id", "value")


@query("SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey")
def table_function_relation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers joined with a relation that the caller holds, named in SQL; it is of a checked size, so it is broadcast."""
    relations = Relations()
    relations.hold("held", "nations", table(spark, sf_dir, "nation").select("n_nationkey", "n_name").toArrow())
    relations.register(spark)
    return spark.sql(
        "SELECT /*+ BROADCAST(n) */ c_custkey, n_name FROM {customer} JOIN arrow_relation('held', 'nations') AS n ON c_nationkey = n_nationkey",
        customer=table(spark, sf_dir, "customer"),
    )


@query("SELECT event_id, CASE WHEN value >= 50 THEN 'high' ELSE 'low' END AS band FROM events")
def table_function_plugin(spark: SparkSession, sf_dir: str) -> DataFrame:
    surface.register_plugin(spark, "value_bands")
    return spark.sql("SELECT event_id, band FROM value_bands(TABLE(SELECT event_id, value FROM {events}))", events=table(spark, sf_dir, "events"))


def _profile(rows: pa.Table) -> pa.Table:
    """Of each key of a batch: rows, nulls, least and greatest value."""
    found = rows.group_by("key").aggregate([("value", "count", pa.compute.CountOptions(mode="all")), ("value", "count", pa.compute.CountOptions(mode="only_null")), ("value", "min"), ("value", "max")])
    return found.rename_columns(["key", "n", "nulls", "low", "high"])


@query("SELECT kind, count(*) AS n, count(*) FILTER (value IS NULL) AS nulls, min(value) AS low, max(value) AS high FROM clicks GROUP BY 1")
def table_function_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of each kind of click by a table function over dealt keys; each kind is dealt over 64 parts, so none is one task."""
    register_batches(spark, "profile", _profile, "key string, n bigint, nulls bigint, low double, high double")
    return spark.sql(
        """SELECT key AS kind, sum(n) AS n, sum(nulls) AS nulls, min(low) AS low, max(high) AS high
        FROM profile(TABLE(SELECT kind AS key, value, pmod(xxhash64(click_id, ts), 64) AS deal FROM {clicks}) PARTITION BY (key, deal)) GROUP BY key""",
        clicks=table(spark, sf_dir, "clicks"),
    )
