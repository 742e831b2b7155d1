"""SQL surface: scans, joins, aggregation, windows, sets, tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orrery.operators import joins, search
from orrery.plans.registry import query
from orrery.sources import tables
from orrery.sources.tables import table


def passed_to_spark(name: str, sql: str, duck: str | None = None, *needed: str) -> None:
    """Register a query whose text Spark SQL runs over registered tables."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return spark.sql(sql, **{t: table(spark, sf_dir, t) for t in needed})

    run.__name__ = name
    query(duck or sql.replace("{", "").replace("}", ""))(run)


passed_to_spark("sql_q1_pricing_summary", """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue,
    round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM {lineitem} WHERE l_shipdate <= TIMESTAMP '2001-06-01 00:00:00' GROUP BY l_returnflag, l_linestatus""", None, "lineitem")
passed_to_spark("sql_q3_top_orders", """SELECT o_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM {customer} JOIN {orders} ON c_custkey = o_custkey
    JOIN {lineitem} ON l_orderkey = o_orderkey WHERE c_mktsegment = 'BUILDING' GROUP BY o_orderkey ORDER BY revenue DESC, o_orderkey LIMIT 10""", None, "customer", "orders", "lineitem")
passed_to_spark("sql_q5_nation_revenue", """SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM {customer} JOIN {orders} ON c_custkey = o_custkey JOIN {lineitem} ON l_orderkey = o_orderkey
    JOIN {supplier} ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey JOIN {nation} ON s_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey
    WHERE r_name = 'ASIA' GROUP BY n_name""", None, "customer", "orders", "lineitem", "supplier", "nation", "region")
passed_to_spark("join_left", "SELECT c_custkey, count(o_orderkey) AS n_orders FROM {customer} LEFT JOIN {orders} ON c_custkey = o_custkey GROUP BY c_custkey", None, "customer", "orders")
passed_to_spark("join_right", "SELECT c_custkey, count(o_orderkey) AS n FROM {orders} RIGHT JOIN {customer} ON c_custkey = o_custkey AND o_totalprice > 300000 GROUP BY c_custkey", None, "customer", "orders")
passed_to_spark("join_full", """SELECT coalesce(a.k, b.k) AS k, a.n AS n_cust, b.n AS n_supp FROM (SELECT c_nationkey AS k, count(*) AS n FROM {customer} GROUP BY c_nationkey) a
    FULL JOIN (SELECT s_nationkey AS k, count(*) AS n FROM {supplier} GROUP BY s_nationkey) b ON a.k = b.k""", None, "customer", "supplier")
passed_to_spark("join_semi", "SELECT c_custkey FROM {customer} WHERE EXISTS (SELECT 1 FROM {orders} WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')", None, "customer", "orders")
passed_to_spark("join_anti", "SELECT c_custkey FROM {customer} WHERE NOT EXISTS (SELECT 1 FROM {orders} WHERE o_custkey = c_custkey)", None, "customer", "orders")
passed_to_spark("join_cross", "SELECT r_name, n_name FROM {region} CROSS JOIN {nation}", None, "region", "nation")
passed_to_spark("join_theta", "SELECT a.n_name AS n1, b.n_name AS n2 FROM {nation} a JOIN {nation} b ON a.n_nationkey < b.n_nationkey AND a.n_regionkey = b.n_regionkey", None, "nation")
passed_to_spark("agg_grouping_sets", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM {lineitem} GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())", None, "lineitem")
passed_to_spark("agg_rollup", "SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM {orders} GROUP BY ROLLUP (o_orderstatus, o_orderpriority)", None, "orders")
passed_to_spark("agg_cube", "SELECT p_brand, p_type, count(*) AS n FROM {part} GROUP BY CUBE (p_brand, p_type)", None, "part")
passed_to_spark("agg_distinct", "SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS suppliers FROM {lineitem} GROUP BY l_returnflag", None, "lineitem")
passed_to_spark("agg_having", "SELECT o_custkey, count(*) AS n FROM {orders} GROUP BY o_custkey HAVING count(*) > 12", None, "orders")
passed_to_spark("window_frames", """SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS run3,
    CAST(rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC) AS INT) AS r, lead(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS nxt FROM {orders}""", None, "orders")
passed_to_spark("set_intersect", "SELECT c_nationkey AS k FROM {customer} INTERSECT SELECT s_nationkey AS k FROM {supplier}", None, "customer", "supplier")
passed_to_spark("set_except", "SELECT o_custkey AS k FROM {orders} EXCEPT SELECT c_custkey AS k FROM {customer} WHERE c_acctbal < 0", None, "orders", "customer")
passed_to_spark("set_union", "SELECT n_name AS name FROM {nation} UNION SELECT r_name AS name FROM {region}", None, "nation", "region")
passed_to_spark("set_union_all", "SELECT c_nationkey AS k FROM {customer} UNION ALL SELECT s_nationkey AS k FROM {supplier}", None, "customer", "supplier")
passed_to_spark("filter_like", "SELECT p_partkey, p_name FROM {part} WHERE p_name LIKE 'red%' OR p_name LIKE '%ring'", None, "part")
passed_to_spark("order_limit_offset", "SELECT o_orderkey, o_totalprice FROM {orders} ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 10", None, "orders")
passed_to_spark("latency_percentiles", "SELECT event_type, round(percentile(value, 0.5), 4) AS p50, round(percentile(value, 0.95), 4) AS p95, round(percentile(value, 0.99), 4) AS p99 FROM {events} GROUP BY event_type",
    "SELECT event_type, round(quantile_cont(value, 0.5), 4) AS p50, round(quantile_cont(value, 0.95), 4) AS p95, round(quantile_cont(value, 0.99), 4) AS p99 FROM events GROUP BY event_type", "events")


@query("SELECT o_orderkey, o_custkey, e.event_id AS last_event FROM (SELECT *, o_custkey % 50 AS u FROM orders) o ASOF LEFT JOIN (SELECT user_id AS u, ts, max(event_id) AS event_id FROM events GROUP BY ALL) e ON o.u = e.u AND o.o_orderdate + INTERVAL 23 YEAR >= e.ts")
def join_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest event before each order: one sort of the union, no pair expansion."""
    o = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 50).alias("u"), F.expr("o_orderdate + INTERVAL 23 YEAR").alias("t"), "o_orderkey", "o_custkey")
    e = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("u"), "ts").agg(F.max("event_id").alias("last_event"))
    return joins.as_of(o, e, "u", "t", "ts", "last_event").select("o_orderkey", "o_custkey", "last_event")


@query("""WITH i AS (SELECT o_orderkey, o_custkey % 100 AS k, datediff('day', DATE '1970-01-01', o_orderdate::DATE) AS a FROM orders), p AS (SELECT l_suppkey AS k, datediff('day', DATE '1970-01-01', l_shipdate::DATE) AS d FROM lineitem)
    SELECT o_orderkey, count(*) AS n FROM i JOIN p ON i.k = p.k AND d BETWEEN a AND a + 20 GROUP BY 1""")
def join_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shipments in the twenty days after each order, of the supplier with the customer's number."""
    days = lambda c: F.datediff(F.col(c), F.lit("1970-01-01"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 100).alias("k"), days("o_orderdate").alias("a"))
    p = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("k"), days("l_shipdate").alias("d"))
    return joins.within(p, o, "k", F.col("d"), F.col("a"), F.col("a") + 20, 30).groupBy("o_orderkey").agg(F.count("*").alias("n"))


@query("SELECT c_custkey, coalesce(n.c_mktsegment, o.c_mktsegment) AS c_mktsegment FROM customer o LEFT JOIN (SELECT c_custkey AS k, 'NEW' AS c_mktsegment FROM customer WHERE c_acctbal < 0) n ON n.k = o.c_custkey")
def table_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    new = table(spark, sf_dir, "customer").where("c_acctbal < 0").select("c_custkey", F.lit("NEW").alias("c_mktsegment"))
    return tables.upsert(base, new, "c_custkey")


@query("SELECT count(*) FILTER (c_custkey IS NOT NULL) AS updated, count(*) FILTER (c_custkey IS NULL) AS inserted FROM orders LEFT JOIN customer ON o_orderkey = c_custkey")
def table_upsert_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.upsert_counts(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")), table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k")), "k")


@query("SELECT * FROM supplier WHERE NOT coalesce(s_acctbal < 0 OR s_nationkey = 3, false)")
def table_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.delete_where(table(spark, sf_dir, "supplier"), (F.col("s_acctbal") < 0) | (F.col("s_nationkey") == 3))


@query("SELECT s_suppkey AS supplier_id, s_name, s_nationkey, s_acctbal > 0 AS in_credit FROM supplier")
def table_alter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.alter(table(spark, sf_dir, "supplier"), {"in_credit": F.col("s_acctbal") > 0}, {"s_suppkey": "supplier_id"}, ["s_acctbal"])


@query("SELECT p_name AS path, p_partkey FROM part WHERE p_name NOT IN (SELECT p_name FROM part WHERE p_size = 1) UNION ALL SELECT p_name, -p_partkey FROM part WHERE p_size = 1")
def snapshot_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = table(spark, sf_dir, "part").select(F.col("p_name").alias("path"), "p_partkey", "p_size")
    new = base.where("p_size = 1").withColumn("p_partkey", -F.col("p_partkey"))
    return tables.new_snapshot(base, new, new).select("path", "p_partkey")


@query("SELECT coalesce(o.c_custkey, n.o_custkey) AS path, CASE WHEN o.c_custkey IS NULL THEN 'added' WHEN n.o_custkey IS NULL THEN 'deleted' ELSE 'changed' END AS change FROM customer o FULL JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) n ON o.c_custkey = n.o_custkey WHERE o.c_custkey IS NULL OR n.o_custkey IS NULL OR n.n <> o.c_nationkey")
def staged_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("path"), F.col("c_nationkey").cast("long").alias("h"))
    new = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("path")).agg(F.count("*").alias("h"))
    return tables.changed_paths(old, new, "path", "h")


@query("SELECT n_name AS name, 'nation' AS repo_id FROM nation UNION ALL SELECT r_name, 'region' FROM region")
def union_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.union_view({"nation": table(spark, sf_dir, "nation").select(F.col("n_name").alias("name")), "region": table(spark, sf_dir, "region").select(F.col("r_name").alias("name"))})


@query("SELECT coalesce(json_extract_string(props, '$.k'), '_unknown') AS part, count(*) AS n FROM events GROUP BY 1")
def partition_by_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy(tables.unknown_partition(F.col("props"), "k").alias("part")).agg(F.count("*").alias("n"))


@query("SELECT p_partkey, p_size FROM part WHERE p_size > 40 AND p_type = 'ECONOMY'")
def filter_json_predicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").where(search.json_filter({"p_size": {"$gt": 40}, "p_type": "ECONOMY"})).select("p_partkey", "p_size")


@query("SELECT event_id FROM events WHERE json_extract_string(props, '$.k') = '7'")
def filter_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").where(search.metadata_filter(F.col("props"), {"k": 7})).select("event_id")


@query("SELECT p_partkey AS id, p_retailprice AS score FROM part WHERE p_brand = 'Brand#2' AND contains(p_name, 'ring') AND coalesce(p_retailprice, 0) >= 950")
def filter_column_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("repo"), F.col("p_name").alias("path"), F.col("p_retailprice").alias("score"))
    return search.column_mask(df, repo="Brand#2", path_contains="ring", min_score=950).select("id", "score")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_totalprice >= 100000 ORDER BY o_totalprice ASC NULLS FIRST, o_orderkey DESC NULLS FIRST LIMIT 15 OFFSET 15")
def graphql_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.graphql(table(spark, sf_dir, "orders"), ["o_orderkey", "o_totalprice"], {"o_totalprice": {"gte": 100000}, "o_orderstatus": "F"}, [("o_totalprice", False), ("o_orderkey", True)], limit=15, page=2)


@query("SELECT * FROM (VALUES ('customer', 'c_custkey', 'bigint', 1), ('customer', 'c_name', 'string', 2), ('customer', 'c_nationkey', 'int', 3), ('customer', 'c_acctbal', 'double', 4), ('customer', 'c_mktsegment', 'string', 5), ('nation', 'n_nationkey', 'int', 1), ('nation', 'n_name', 'string', 2), ('nation', 'n_regionkey', 'int', 3)) t(sql_table_name, column_name, data_type, ordinal_position)")
def catalog_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    for name in ("customer", "nation"):
        table(spark, sf_dir, name).createOrReplaceTempView(name)
    return tables.catalog_columns(spark, ["customer", "nation"]).select("sql_table_name", "column_name", "data_type", "ordinal_position")


@query("SELECT user_id, event_type, n FROM (SELECT user_id, event_type, count(*) AS n, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, event_type) AS r FROM events GROUP BY 1, 2) WHERE r <= 3")
def top_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    w = Window.partitionBy("user_id").orderBy(F.desc("n"), "event_type")
    return n.withColumn("r", F.row_number().over(w)).where("r <= 3").drop("r")


@query("SELECT source, count(*) AS n, count(DISTINCT lang) AS langs, max(n_chars) AS longest FROM documents GROUP BY source")
def corpus_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n"), F.countDistinct("lang").alias("langs"), F.max("n_chars").alias("longest"))


@query("SELECT k, sum(n)::BIGINT AS degree FROM (SELECT 's' || l_suppkey AS k, count(*) AS n FROM lineitem GROUP BY 1 UNION ALL SELECT 'p' || l_partkey, count(*) FROM lineitem GROUP BY 1) GROUP BY k ORDER BY degree DESC, k LIMIT 10")
def top_connected(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    ends = [li.groupBy(F.concat(F.lit(p), c).alias("k")).agg(F.count("*").alias("degree")) for p, c in (("s", "l_suppkey"), ("p", "l_partkey"))]
    return search.top(reduce(lambda a, b: a.unionByName(b), ends), 10, F.desc("degree"), F.col("k"))
