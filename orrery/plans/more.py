"""Further queries: weighted fusion, boosts, chunking, traversal, pruning, decay."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orrery.functions import scalars as sc
from orrery.operators import fusion, graph
from orrery.plans.registry import query
from orrery.sources.tables import table
from orrery.streaming import windows


@query("SELECT c_custkey, round(2 - least(1.0, 0.2 * n), 6)::DOUBLE AS wv, round(1.5 * least(1.0, 0.2 * n), 6)::DOUBLE AS wk FROM (SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1)")
def fusion_adaptive_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights of vector and keyword side by the number of keyword hits."""
    n = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left").groupBy("c_custkey").agg(F.count("o_orderkey").alias("n"))
    wv, wk = fusion.adaptive_weights(F.col("n"))
    return n.select("c_custkey", F.round(wv, 6).alias("wv"), F.round(wk, 6).alias("wk"))


@query("SELECT p_partkey, round(CASE WHEN n > 0 THEN s * (1 + c * 0.3 + n * 0.15) ELSE s END, 10) AS boosted FROM (SELECT p_partkey, p_retailprice / 10000 AS s, contains(p_name, 'red')::INT + contains(p_name, 'ring')::INT AS n, 0.8::DOUBLE AS c FROM part)")
def fusion_entity_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.contains("p_name", F.lit("red")).cast("int") + F.contains("p_name", F.lit("ring")).cast("int")
    return table(spark, sf_dir, "part").select("p_partkey", F.round(fusion.entity_boost(F.col("p_retailprice") / 10000, n, F.lit(0.8)), 10).alias("boosted"))


@query("SELECT o_orderkey, round(0.6::DOUBLE * least(o_totalprice / 300000, 1) + (1 - 0.6::DOUBLE) * least(o_custkey / 1000.0::DOUBLE, 1), 10) AS score FROM orders")
def fusion_quantum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", F.round(fusion.quantum(F.col("o_totalprice") / 300000, F.col("o_custkey") / 1000.0, 0.6), 10).alias("score"))


@query("SELECT item_id, len(w) AS n_words, array_to_string(list_transform(range(0, CASE WHEN len(w) = 0 THEN 0 ELSE 1 + greatest(len(w) - 4 - 1, 0) // 16 END), lambda i: array_to_string(w[i * 16 + 1 : i * 16 + 20], ' ')), '|') AS chunks FROM (SELECT item_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS w FROM benchmark)")
def scalar_word_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 20 words that share 4."""
    b = table(spark, sf_dir, "benchmark")
    words = F.filter(F.split("text", r"\s+"), lambda t: t != "")
    return b.select("item_id", F.size(words).cast("long").alias("n_words"), F.array_join(sc.word_chunks(F.col("text"), 20, 4), "|").alias("chunks"))


@query("SELECT page_id, CASE split_part(split_part(split_part(url, '#', 1), '?', 1), '.', -1) WHEN 'html' THEN 'python' ELSE NULL END AS kind FROM pages")
def scalar_extension(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of each page's file, were html files python."""
    path = F.substring_index(F.substring_index("url", "#", 1), "?", 1)
    return table(spark, sf_dir, "pages").select("page_id", sc.language_of_path(F.regexp_replace(path, r"\.html$", ".py")).alias("kind"))


@query("SELECT event_id, round(0.5 + (least(value / 100, 1) - 0.5) * pow(0.99, event_id % 24), 10) AS q, round((event_id % 7 + 1.0::DOUBLE) / (event_id % 11 + 1) * 0.5, 6) AS utility FROM events")
def state_decay_and_utility(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    q = sc.toward_half(F.least(F.col("value") / 100, F.lit(1.0)), i % 24, 0.99)
    return table(spark, sf_dir, "events").select("event_id", F.round(q, 10).alias("q"), F.round(sc.utility(i % 7, i % 11, F.lit(0.5)), 6).alias("utility"))


@query("SELECT conv_id, turn, CASE WHEN r > 2 AND role <> 'user' AND length(text) > 40 THEN substr(text, 1, 40) || '...' ELSE text END AS text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role, text) AS r FROM conversations)")
def session_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last two turns stay whole; older output is cut to a snippet."""
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"), "role", "text")
    c = table(spark, sf_dir, "conversations").withColumn("r", F.row_number().over(w))
    return c.select("conv_id", "turn", F.when((F.col("r") > 2) & (F.col("role") != "user"), sc.snippet(F.col("text"), 40)).otherwise(F.col("text")).alias("text"))


_EDGES = "e AS (SELECT DISTINCT 's' || l_suppkey AS src, 'p' || l_partkey AS dst FROM lineitem)"


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.concat(F.lit("s"), "l_suppkey").alias("src"), F.concat(F.lit("p"), "l_partkey").alias("dst")).distinct()


@query(f"WITH {_EDGES} SELECT dst AS node, 1 AS distance FROM e WHERE src = 's1' UNION SELECT 's1', 0")
def graph_reachable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directed traversal."""
    return graph.distances(_edges(spark, sf_dir), spark.createDataFrame([("s1",)], "node string"), 1, "out")


@query(f"WITH {_EDGES}, n AS (SELECT src AS node FROM e UNION SELECT dst FROM e) SELECT (SELECT count(*) FROM e) AS edges, (SELECT count(*) FROM n) AS linked, (SELECT count(*) FROM part WHERE 'p' || p_partkey NOT IN (SELECT node FROM n)) AS orphans")
def graph_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges, linked nodes and parts without a link."""
    e = _edges(spark, sf_dir)
    nodes = e.select(F.col("src").alias("node")).union(e.select("dst")).distinct()
    parts = table(spark, sf_dir, "part").select(F.concat(F.lit("p"), "p_partkey").alias("node"))
    counts = [("edges", e), ("linked", nodes), ("orphans", parts.join(nodes, "node", "left_anti"))]
    one = [df.agg(F.count("*").alias(k)) for k, df in counts]
    return one[0].crossJoin(one[1]).crossJoin(one[2])  # one row each


@query("SELECT event_type, count(*) AS n FROM (SELECT DISTINCT user_id, event_type, date_trunc('hour', ts) AS h FROM events) GROUP BY event_type")
def window_distinct_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct (user, type, hour) by type."""
    w = windows.windowed(table(spark, sf_dir, "events"), "ts", "1 hour", keys=("user_id", "event_type"))
    return w.groupBy("event_type").agg(F.count("*").alias("n"))
