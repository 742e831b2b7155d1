"""Hit lists: boosted fusion, filters, orders, tiers, confidence, imports, definitions, votes, requests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.operators import fusion, hits, requests
from orrery.plans.registry import query
from orrery.sources import tables
from orrery.sources.tables import table


@query("""WITH v AS (SELECT p_partkey, p_retailprice / 2000 AS s, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) - 1 AS r FROM part ORDER BY r LIMIT 40), k AS (SELECT p_partkey, p_size::DOUBLE AS s, row_number() OVER (ORDER BY p_size DESC, p_partkey) - 1 AS r FROM part ORDER BY r LIMIT 40),
    f AS (SELECT coalesce(v.p_partkey, k.p_partkey) AS p_partkey, coalesce(1.0::DOUBLE / (11 + v.r), 0) + 1.5::DOUBLE * coalesce(1.0::DOUBLE / (11 + k.r), 0) AS fused, k.p_partkey IS NOT NULL AS in_k FROM v FULL JOIN k ON v.p_partkey = k.p_partkey)
    SELECT p_name || ' ' || p_partkey AS name, round(fused + 0.3 * contains(p_name, 'red')::INT + 0.3 * contains(p_name, 'ring')::INT + 0.5 * contains(p_name, 'red ring')::INT + CASE WHEN in_k THEN least(0.17 * contains(p_name, 'red')::INT + 0.17 * contains(p_name, 'ring')::INT + 0.03 * (contains(lower(p_type), 'red')::INT + contains(lower(p_type), 'ring')::INT), 0.45) + 0.25 * (p_brand = 'Brand#2')::INT ELSE 0 END, 8)::DOUBLE AS rrf FROM f JOIN part USING (p_partkey)""")
def fusion_weighted_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts by price and by size; names serve as routing keywords and intents too."""
    name = F.concat_ws(" ", "p_name", F.col("p_partkey").cast("string"))
    p = table(spark, sf_dir, "part")
    v, k = (fusion.ranked(p.select("p_partkey", s.alias("score")), "p_partkey", "score", 40).join(p, "p_partkey").select(name.alias("name"), "score", "rank", F.array("p_name").alias("routing_keywords"), F.array("p_name").alias("intents"), F.lit("").alias("category"), F.col("p_type").alias("description"), "p_brand") for s in (F.col("p_retailprice") / 2000, F.col("p_size").cast("double")))
    return hits.weighted_rrf(v, k, "red ring", F.col("p_brand") == "Brand#2").select("name", F.round("rrf", 8).alias("rrf"))


@query("""WITH f AS (SELECT count(*) AS n, max(least(greatest(s_acctbal / 12000, 0), 1)) AS top, count(DISTINCT lower(trim(s_name))) AS sources FROM supplier)
    SELECT round(c, 6) AS confidence, CASE WHEN c <= 0 THEN 'none' WHEN c < 0.35 THEN 'low' WHEN c < 0.7 THEN 'medium' ELSE 'high' END AS level, n >= 100000 AND top >= 0.9 AS sufficient, sources FROM (SELECT *, 0.45 * least(n / 100000.0::DOUBLE, 1) + 0.35 * top + 0.2 * least(top / 0.9::DOUBLE, 1) AS c FROM f)""")
def search_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("path"), (F.col("s_acctbal") / 12000).alias("score"))
    return hits.graph_confidence(h, 100000, 0.9).withColumn("confidence", F.round("confidence", 6))


@query("SELECT o_custkey, round(least(sum(s), 1), 6) AS topology FROM (SELECT o_custkey, o_totalprice / 2000000 AS s, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r <= 4 GROUP BY 1")
def search_topology_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", (F.col("o_totalprice") / 2000000).alias("score"))
    return hits.topology_score(r, "o_custkey", [F.desc("score"), F.col("o_orderkey")], 4).withColumn("topology", F.round("topology", 6))


@query("SELECT o_orderkey AS path FROM orders ORDER BY CASE WHEN o_orderstatus = 'F' THEN NULL ELSE o_orderdate END DESC NULLS FIRST, o_totalprice DESC, o_orderkey LIMIT 50")
def search_multi_key_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("path"), F.lit("s").alias("stem"), F.col("o_totalprice").alias("score"), F.when(F.col("o_orderstatus") != "F", F.col("o_orderdate")).alias("modified"))
    return h.orderBy(*hits.hit_order([("modified", True)])).limit(50).select("path")


@query("SELECT p_partkey FROM part WHERE p_type = 'PROMO' AND (p_brand = 'Brand#2' OR p_brand = 'Brand#3') AND NOT list_contains(string_split(lower(p_name), ' '), 'ring')")
def filter_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").withColumn("tags", F.concat(F.array("p_type", "p_brand"), F.split("p_name", " ")))
    return p.where(hits.tag_filter(F.col("tags"), ["promo"], ["BRAND#2", "brand#3"], ["ring"])).select("p_partkey")


@query("SELECT page_id FROM pages WHERE regexp_matches(lower(regexp_replace(url, '^[^:]*://', '')), '^[^/]*/en(/|$)')")
def filter_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.regexp_replace(F.regexp_replace("url", "^[^:]*://", ""), "^[^/]*", "")
    return table(spark, sf_dir, "pages").where(hits.under_path(path, "/EN/")).select("page_id")


@query("SELECT o_orderkey FROM orders WHERE o_orderdate > TIMESTAMP '1998-01-01' AND o_orderdate < TIMESTAMP '1999-01-01'")
def filter_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").where(hits.between_times(F.col("o_orderdate").cast("timestamp"), "1998-01-01", "1999-01-01")).select("o_orderkey")


_LINKS = "e AS (SELECT DISTINCT c_nationkey AS src, (c_custkey % 25)::INT AS dst FROM customer)"


def _links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("src"), (F.col("c_custkey") % 25).cast("int").alias("dst"))


@query(f"WITH {_LINKS} SELECT n_name FROM nation WHERE n_nationkey NOT IN (SELECT src FROM e UNION SELECT dst FROM e)")
def filter_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hits.without_links(table(spark, sf_dir, "nation"), _links(spark, sf_dir), "n_nationkey").select("n_name")


@query(f"WITH {_LINKS} SELECT src, dst FROM e EXCEPT SELECT dst, src FROM e")
def filter_missing_backlinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hits.missing_backlinks(_links(spark, sf_dir))


@query(f"WITH {_LINKS} SELECT n_name, n_nationkey IN (SELECT dst FROM e WHERE src IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)) AS linked FROM nation")
def filter_linked_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, e = table(spark, sf_dir, "nation"), _links(spark, sf_dir)
    s = n.where("n_regionkey = 1").select(F.col("n_nationkey").alias("node"))
    both = [hits.linked_by(n, e, "n_nationkey", s, negate).select("n_name", F.lit(not negate).alias("linked")) for negate in (False, True)]
    return both[0].unionByName(both[1])


@query("SELECT name, min(tier)::INT AS tier FROM (SELECT p_name AS name, 0 AS tier FROM part WHERE p_name = 'red ring' UNION ALL SELECT p_name, 1 FROM part WHERE levenshtein(p_name, 'red ring') <= 3 UNION ALL SELECT p_name, 2 FROM part WHERE contains(p_name, 'ri')) GROUP BY 1 ORDER BY tier, name LIMIT 15")
def search_ordered_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(F.col("p_name").alias("name"))
    return hits.ordered_union(15, "name", p.where("name = 'red ring'"), p.where(F.levenshtein("name", F.lit("red ring")) <= 3), p.where(F.contains("name", F.lit("ri"))))


@query(f"WITH {_LINKS}, p AS (SELECT dst AS node, 2.0::DOUBLE AS p FROM e UNION ALL SELECT src, 0.5 FROM e), r AS (SELECT n_nationkey AS node, coalesce(sum(p), 0) AS p FROM nation LEFT JOIN p ON n_nationkey = node GROUP BY 1) SELECT node, round(p / (SELECT max(p) FROM r), 6) AS saliency FROM r")
def graph_repository_saliency(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("node"))
    return hits.repository_saliency(n, _links(spark, sf_dir).distinct()).withColumn("saliency", F.round("saliency", 6))


@query("SELECT p_partkey, bucket FROM (SELECT p_partkey, CASE WHEN lower(p_brand) = 'brand#2' THEN CASE WHEN lower(p_name) = 'red' THEN 0 WHEN starts_with(lower(p_name), 'red') THEN 1 END WHEN starts_with(lower(p_brand), 'brand#2') THEN CASE WHEN starts_with(lower(p_name), 'red') THEN 2 END WHEN contains(lower(p_brand), 'brand#2') THEN 3 END AS bucket FROM part) WHERE bucket IS NOT NULL")
def search_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    package, module = hits.import_filters("package=brand#2; module=red")
    return table(spark, sf_dir, "part").select("p_partkey", hits.import_rank(F.col("p_brand"), F.col("p_name"), package, module).alias("bucket")).where("bucket IS NOT NULL")


@query("WITH s AS (SELECT p_partkey, CASE WHEN p_name = 'Red ring' THEN 1.0 ELSE 0.98 END::DOUBLE AS score FROM part WHERE lower(p_name) = 'red ring' AND p_type <> 'PROMO') SELECT p_partkey, score FROM s WHERE score = (SELECT max(score) FROM s)")
def search_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("name"), F.when(F.col("p_type") == "PROMO", "markdown").otherwise("rust").alias("language"))
    return hits.definitions(s, " Red ring").select("p_partkey", "score")


@query("SELECT p_partkey, CASE WHEN p_size > 10 THEN 'vector=' || printf('%.3f', p_size / 64.0) || ' | ' ELSE '' END || 'category=' || p_type || ' | intents=' || p_brand || ' | confidence=high | raw=0.250 | final=0.500' AS reason FROM part")
def scalar_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    vector = F.when(F.col("p_size") > 10, F.col("p_size") / 64.0)
    return table(spark, sf_dir, "part").select("p_partkey", hits.reason(vector, F.lit(None).cast("double"), F.col("p_type"), F.array("p_brand"), F.lit("high"), F.lit(0.25), F.lit(0.5)).alias("reason"))


@query("SELECT p_partkey, ((row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) - 1) // 7)::INT AS worker_id FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 28")
def projection_workers(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return hits.workers(p, [F.desc("p_retailprice"), F.col("p_partkey")], 4, 7).select("p_partkey", "worker_id")


@query("""WITH l AS (SELECT user_id % 10 AS s, user_id AS a, max_by(event_type, event_id) AS c, max_by(round(value), event_id) AS w FROM events GROUP BY 1, 2), t AS (SELECT s, c, sum(w) AS w FROM l GROUP BY 1, 2)
    SELECT s AS session, choice, weight, weight >= 0.4 * total AS agreed FROM (SELECT s, c AS choice, w AS weight, sum(w) OVER (PARTITION BY s) AS total, row_number() OVER (PARTITION BY s ORDER BY w DESC, c) AS r FROM t) WHERE r = 1""")
def state_vote_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "events").select((F.col("user_id") % 10).alias("session"), "user_id", F.col("event_type").alias("choice"), F.round("value").alias("weight"), "event_id")
    return hits.vote_tally(v, "session", "user_id", "choice", "weight", "event_id", 0.4)


@query("SELECT user_id AS node, round(CASE WHEN t < 1704500000 THEN least(greatest(s * exp(-0.05 * (1704500000 - t) / 86400), 1), 10) ELSE s END, 6) AS saliency FROM (SELECT user_id, max(value) / 40 AS s, max(epoch_us(ts)) / 1e6 AS t FROM events GROUP BY 1)")
def state_decay_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("node")).agg((F.max("value") / 40).alias("saliency"), (F.max(F.unix_micros(F.col("ts").cast("timestamp"))) / 1e6).alias("last_seen"))
    return hits.decay_sweep(s, 1704500000.0).select("node", F.round("saliency", 6).alias("saliency"))


@query("SELECT user_id, payload FROM (SELECT user_id, max_by(CASE WHEN event_type = 'error' THEN 'none' ELSE props END, event_id) AS payload FROM events GROUP BY 1) WHERE payload <> 'none'")
def state_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last snapshot of each user that has not been dropped."""
    log = table(spark, sf_dir, "events").select("user_id", "event_id", F.when(F.col("event_type") != "error", F.col("props")).alias("payload"))
    return tables.snapshot_at(log, "user_id", "event_id", 2**62)


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'O' AND o_totalprice > 300000 ORDER BY o_totalprice DESC NULLS FIRST, o_orderkey ASC NULLS FIRST LIMIT 10 OFFSET 10")
def surface_graphql(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = 'query Page { orders(filter: {o_totalprice: {gt: 300000}, o_orderstatus: "O"}, sort: [{column: "o_totalprice", order: desc}, "o_orderkey"], limit: 10, page: 2) { o_orderkey o_totalprice } }'
    return requests.run_table_query({"orders": table(spark, sf_dir, "orders")}, text)


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 1000 ORDER BY o_totalprice DESC, o_orderkey LIMIT 12")
def surface_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return requests.Pipeline(table(spark, sf_dir, "orders")).where("o_totalprice > 1000").sort_by("o_totalprice", True).take(12).select("o_orderkey", "o_totalprice").build()


@query("SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'ring') AND (lower(p_type) = 'promo' OR lower(p_type) = 'economy') ORDER BY p_name DESC, p_partkey LIMIT 8")
def surface_directives(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = requests.directives("limit:8 tag:(promo,economy) sort:-path ring")
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", F.col("p_name").alias("path"), F.format_string("%012d", "p_partkey").alias("stem"), F.lit(0.0).alias("score"), F.array("p_type").alias("tags"))
    found = p.where(F.contains(F.lower("p_name"), F.lit(r.text)) & hits.tag_filter(F.col("tags"), some=r.lists["tags"]))
    return found.orderBy(*hits.hit_order(r.sort)).limit(r.limit).select("p_partkey", "p_name")
