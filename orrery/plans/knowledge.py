"""Knowledge graph, documentation projection, fusion."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orrery.operators import entities, fusion, graph, projection
from orrery.plans.more import _EDGES, _edges
from orrery.plans.registry import query
from orrery.sources.tables import table


@query(f"WITH RECURSIVE {_EDGES}, u AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e), r(node, distance) AS (SELECT 's1', 0 UNION SELECT u.dst, r.distance + 1 FROM r JOIN u ON r.node = u.src WHERE r.distance < 2) SELECT node, min(distance) AS distance FROM r GROUP BY node")
def graph_multi_hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three hops emit what lies within two steps."""
    return entities.multi_hop(_edges(spark, sf_dir), spark.createDataFrame([("s1",)], "node string"), 3)


_TRADE = "n AS (SELECT n_nationkey AS node, count(c_custkey) / 100.0::DOUBLE AS saliency, CASE WHEN n_regionkey = 2 THEN 0.2::DOUBLE ELSE 0 END AS seed FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY n_nationkey, n_regionkey), e AS (SELECT c_nationkey AS src, (c_custkey % 25)::INT AS dst, sum(abs(c_acctbal)) AS weight FROM customer GROUP BY 1, 2), o AS (SELECT src, sum(weight) AS total FROM e GROUP BY src), b AS (SELECT node, seed AS rank, least(seed + saliency / 10, 1) AS teleport FROM n), r0 AS (SELECT node, rank FROM b)"


def _trade(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    nodes = n.join(c, F.col("c_nationkey") == F.col("n_nationkey"), "left").groupBy(F.col("n_nationkey").alias("node")).agg((F.count("c_custkey") / 100.0).alias("saliency"))
    edges = c.groupBy(F.col("c_nationkey").alias("src"), (F.col("c_custkey") % 25).cast("int").alias("dst")).agg(F.sum(F.abs("c_acctbal")).alias("weight"))
    return nodes, edges, n.where("n_regionkey = 2").select(F.col("n_nationkey").alias("node"), F.lit(0.2).alias("seed"))


@query("WITH " + _TRADE + "".join(f", f{i} AS (SELECT e.dst, sum(e.weight / o.total * r{i}.rank) AS got FROM e JOIN o USING (src) JOIN r{i} ON e.src = r{i}.node GROUP BY e.dst), r{i + 1} AS (SELECT b.node, 0.85 * coalesce(got, 0) + 0.15 * teleport AS rank FROM b LEFT JOIN f{i} ON b.node = f{i}.dst)" for i in range(4)) + " SELECT node, round(rank, 8) AS rank FROM r4")
def graph_weighted_pagerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.weighted_pagerank(*_trade(spark, sf_dir), iterations=4).select("node", F.round("rank", 8).alias("rank"))


@query()
def graph_dense_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense groups of nations by trade; tests hold it against growth over the whole graph."""
    c = table(spark, sf_dir, "customer")
    nodes = c.groupBy(F.col("c_nationkey").cast("string").alias("node")).agg(F.round(F.avg("c_acctbal") / 1000, 6).alias("score"), F.count("*").alias("activations"))
    edges = c.select(F.col("c_nationkey").cast("string").alias("src"), (F.col("c_custkey") % 25).cast("string").alias("dst"))
    return graph.dense_clusters(nodes, edges, 0.7).select("cluster", F.explode("members").alias("node"), F.round("avg_score", 6).alias("avg_score"), F.round("density", 6).alias("density"))


@query("""WITH d AS (SELECT p_partkey AS id, p_retailprice / 2000 AS rank, [p_brand, p_type] AS tags, p_size / 50.0::DOUBLE AS saliency FROM part ORDER BY rank DESC, id LIMIT 50), e AS (SELECT p_partkey AS a, p_partkey + 1 AS b FROM part WHERE p_size > 25)
    SELECT l.id AS left_id, r.id AS right_id, round(least(least(least((l.rank + r.rank) / 2, 1) * 0.7 + len(list_intersect(l.tags, r.tags)) / 2.0::DOUBLE * 0.3, 1) * least(1 + (l.saliency + r.saliency) / 2, 2), 1), 6)::DOUBLE AS priority
    FROM d l JOIN d r ON l.id < r.id WHERE NOT EXISTS (FROM e WHERE (a = l.id AND b = r.id) OR (a = r.id AND b = l.id)) ORDER BY priority DESC, left_id, right_id LIMIT 40""")
def graph_suggest_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    docs = p.select(F.col("p_partkey").alias("id"), (F.col("p_retailprice") / 2000).alias("rank"), F.array("p_brand", "p_type").alias("tags"), (F.col("p_size") / 50.0).alias("saliency"))
    edges = p.where("p_size > 25").select(F.col("p_partkey").alias("src"), (F.col("p_partkey") + 1).alias("dst"))
    return graph.suggest_links(docs, edges, 50, 40).withColumn("priority", F.round("priority", 6))


@query("SELECT a.n_name AS left_name, b.n_name AS right_name FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_name < b.n_name WHERE levenshtein(a.n_name, b.n_name) <= 6")
def graph_similar_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of similar names, blocked by region."""
    n = table(spark, sf_dir, "nation")
    a, b = n.select("n_regionkey", F.col("n_name").alias("left_name")), n.select("n_regionkey", F.col("n_name").alias("right_name"))
    return a.join(b, "n_regionkey").where((F.col("left_name") < F.col("right_name")) & (F.levenshtein("left_name", "right_name") <= 6)).select("left_name", "right_name")


@query("""WITH a AS (SELECT DISTINCT l_orderkey AS page_id, 'module' AS kind, l_partkey AS anchor_id FROM lineitem UNION SELECT o_orderkey, 'doc', o_custkey FROM orders), w AS (SELECT o_orderkey AS page_id FROM orders WHERE o_orderpriority = '1-URGENT'),
    s AS (SELECT x.page_id, y.page_id AS other_id, count(*) AS score FROM a x JOIN a y USING (kind, anchor_id) WHERE x.page_id <> y.page_id AND x.page_id IN (FROM w) GROUP BY 1, 2)
    SELECT page_id, other_id, score, position::INT AS position FROM (SELECT s.*, row_number() OVER (PARTITION BY page_id ORDER BY score DESC, o_orderpriority, other_id) AS position FROM s JOIN orders ON other_id = o_orderkey) WHERE position <= 3""")
def projection_related_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    li, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    anchors = li.select(F.col("l_orderkey").alias("page_id"), F.lit("module").alias("kind"), F.col("l_partkey").alias("anchor_id")).union(o.select("o_orderkey", F.lit("doc"), "o_custkey"))
    wanted = o.where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("page_id"))
    return projection.related_pages(o.select(F.col("o_orderkey").alias("page_id"), F.col("o_orderpriority").alias("title")), anchors, wanted, 3)


@query("""SELECT 'module_reference_without_documentation' AS kind, 'reference' AS page_kind, c_custkey AS entity_id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)
    UNION ALL SELECT CASE WHEN n = 0 THEN 'symbol_reference_without_documentation' ELSE 'symbol_reference_unverified' END, 'reference', p_partkey FROM (SELECT p_partkey, p_size, count(l_partkey) AS n FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY 1, 2) WHERE n = 0 OR p_size > 40
    UNION ALL SELECT 'example_how_to_without_anchor', 'how_to', s_suppkey FROM supplier WHERE s_acctbal < 0
    UNION ALL SELECT 'documentation_page_without_anchor', 'explanation', o_orderkey FROM orders WHERE o_totalprice < 2000""")
def projection_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, p = table(spark, sf_dir, "orders"), table(spark, sf_dir, "part")
    uses = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("id")).agg(F.count("*").alias("n_docs"))
    orders = o.groupBy(F.col("o_custkey").alias("id")).agg(F.count("*").alias("n_docs"))
    modules = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")).join(orders, "id", "left").select("id", F.coalesce("n_docs", F.lit(0)).alias("n_docs"))
    symbols = p.select(F.col("p_partkey").alias("id"), F.when(F.col("p_size") > 40, "unverified").alias("verification")).join(uses, "id", "left").select("id", "verification", F.coalesce("n_docs", F.lit(0)).alias("n_docs"))
    examples = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_acctbal") >= 0).cast("int").alias("n_modules"), F.lit(0).alias("n_symbols"))
    docs = o.select(F.col("o_orderkey").alias("id"), F.lit(0).alias("n_modules"), (F.col("o_totalprice") >= 2000).cast("int").alias("n_symbols"), F.lit("explanation").alias("page_kind"))
    return projection.gaps(modules, symbols, examples, docs)


@query("""SELECT p_partkey, least(CASE WHEN p_type = 'PROMO' THEN 96 ELSE 88 END + CASE WHEN p_size > 25 THEN 2 ELSE 1 END + least(p_size % 4, 2) + least(p_size % 3, 2) + least(p_size % 5, 1) + least(p_size % 2, 1), 100)::INT AS priority,
    greatest(CASE WHEN lower(p_name) = 'ring' THEN 90 WHEN contains(lower(p_name), 'ring') THEN 70 ELSE 0 END, CASE WHEN contains(lower(p_brand), 'ring') THEN 68 ELSE 0 END, CASE WHEN contains(lower(p_name), 'ring') AND p_size > 25 THEN 52 ELSE 0 END)::INT AS score FROM part""")
def projection_gap_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size")
    kind = F.when(F.col("p_type") == "PROMO", "module_reference_without_documentation").otherwise("documentation_page_without_anchor")
    gap = table(spark, sf_dir, "part").select("p_partkey", "p_size", F.col("p_name").alias("title"), F.col("p_brand").alias("path"), F.lit("e").alias("entity_id"), F.lit("g").alias("gap_id"), kind.alias("kind"), F.when(size > 25, "reference").otherwise("explanation").alias("page_kind"))
    hints = F.when(size > 25, F.array("title")).otherwise(F.array().cast("array<string>"))
    return gap.select("p_partkey", projection.gap_priority(F.col("kind"), F.col("page_kind"), size % 4, size % 3, size % 5, size % 2).alias("priority"), projection.gap_search_score("ring", hints).alias("score"))


@query("WITH n AS (SELECT p_brand, count(*) AS n FROM part GROUP BY 1), a AS (SELECT sum(n)::BIGINT AS t, count(*) AS g, max(n) - min(n) AS spread FROM n) SELECT p_brand, n, t // g AS floor, t // g + (t % g <> 0)::INT AS ceiling, n BETWEEN t // g AND t // g + (t % g <> 0)::INT AS within, spread, spread <= 1 AS balanced FROM n, a")
def projection_workset_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projection.workset_balance(table(spark, sf_dir, "part"), "p_brand")


@query("SELECT p_partkey FROM part WHERE lower(p_name) = 'red ring' OR (NOT EXISTS (FROM part WHERE lower(p_name) = 'red ring') AND contains(lower(p_name), 'ring'))")
def search_tiered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact hits, or containing ones if there are none."""
    p = table(spark, sf_dir, "part")
    return projection.tiered(p.where(F.lower("p_name") == "red ring").select("p_partkey"), p.where(F.contains(F.lower("p_name"), F.lit("ring"))).select("p_partkey"))


@query("SELECT o_orderstatus AS scope, count(*) FILTER (o_totalprice > 100000) AS covered, count(*) FILTER (NOT coalesce(o_totalprice > 100000, false)) AS uncovered FROM orders GROUP BY 1")
def projection_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    hit = F.coalesce(F.col("o_totalprice") > 100000, F.lit(False))
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("scope")).agg(F.count_if(hit).alias("covered"), F.count_if(~hit).alias("uncovered"))


@query("""WITH s AS (SELECT o_orderkey, o_totalprice / 500000 AS s, lead(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) / 500000 AS nxt, (o_orderkey % 10) / 10.0::DOUBLE AS v, (o_orderkey % 7) / 20.0::DOUBLE AS k FROM orders),
    h AS (SELECT *, s >= 0.75 OR (s >= 0.5 AND (coalesce(s - nxt >= 0.15, false) OR v >= 0.55 OR k >= 0.2 OR (k > 0 AND v < 0.5 AND k > v))) AS high FROM s)
    SELECT o_orderkey, CASE WHEN high THEN 'high' WHEN s >= 0.5 THEN 'medium' ELSE 'low' END AS band, round(least(CASE WHEN high THEN least(0.9 + s * 0.05, 0.99) WHEN s >= 0.5 THEN least(0.6 + s * 0.3, 0.89) ELSE greatest(s, 0.1) END, 1), 10) AS final FROM h""")
def fusion_calibrated(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    key = F.col("o_orderkey")
    o = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_totalprice") / 500000).alias("s"), (F.lead("o_totalprice").over(w) / 500000).alias("nxt"), (key % 10 / 10.0).alias("v"), (key % 7 / 20.0).alias("k"))
    band, final = fusion.calibrated(F.col("s"), F.col("nxt"), F.col("v"), F.col("k"))
    return o.select("o_orderkey", band.alias("band"), F.round(final, 10).alias("final"))


@query("""WITH a AS (SELECT p_partkey, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) - 1 AS r FROM part ORDER BY r LIMIT 60), b AS (SELECT p_partkey, row_number() OVER (ORDER BY p_size DESC, p_partkey) - 1 AS r FROM part ORDER BY r LIMIT 60), c AS (SELECT p_partkey, 0.05::DOUBLE AS rrf, 0.08::DOUBLE AS boosted FROM part WHERE p_brand = 'Brand#2'),
    s AS (SELECT coalesce(a.p_partkey, b.p_partkey) AS p_partkey, coalesce(1.0::DOUBLE / (11 + a.r), 0) + coalesce(1.0::DOUBLE / (11 + b.r), 0) AS s FROM a FULL JOIN b ON a.p_partkey = b.p_partkey)
    SELECT coalesce(s.p_partkey, c.p_partkey) AS p_partkey, round(CASE WHEN s IS NULL THEN rrf WHEN boosted IS NULL THEN s ELSE (s + boosted) / 2 END, 8) AS rrf, round(coalesce(s, boosted), 8) AS boosted FROM s FULL JOIN c ON s.p_partkey = c.p_partkey""")
def fusion_triple_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    lists = [fusion.ranked(p.select("p_partkey", F.col(c).alias("score")), "p_partkey", "score", 60) for c in ("p_retailprice", "p_size")]
    third = p.where("p_brand = 'Brand#2'").select("p_partkey", F.lit(0.05).alias("rrf"), F.lit(0.08).alias("boosted"))
    return fusion.triple_rrf(*lists, third, "p_partkey", 10.0).select("p_partkey", F.round("rrf", 8).alias("rrf"), F.round("boosted", 8).alias("boosted"))


@query("SELECT k, is_valid, round(CASE WHEN is_valid THEN least(c_acctbal / 10000 + 0.1, 1) ELSE greatest(c_acctbal / 10000 - 0.5, 0) END, 6) AS reranked FROM (SELECT c_custkey AS k, c_acctbal, c_custkey IN (SELECT o_custkey FROM orders) AS is_valid FROM customer)")
def fusion_skeleton_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), (F.col("c_acctbal") / 10000).alias("score"))
    return fusion.skeleton_rerank(hits, table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")), "k").select("k", "is_valid", F.round("reranked", 6).alias("reranked"))


_GAPS = f"""g AS (SELECT {sorted(projection.GAP_BASE)}[(p_size % 5 + 1)::INT] AS kind, ['reference', 'how_to', 'tutorial', 'explanation'][(p_partkey % 4 + 1)::INT] AS page_kind, p_partkey AS entity_id, floor(p_retailprice)::BIGINT AS points FROM part),
    s AS (SELECT *, row_number() OVER (ORDER BY points DESC, entity_id) AS rank FROM g QUALIFY rank <= 40)"""


def _gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    kinds, families = (F.array(*[F.lit(x) for x in names]) for names in (sorted(projection.GAP_BASE), ("reference", "how_to", "tutorial", "explanation")))
    return p.select(F.element_at(kinds, (F.col("p_size") % 5 + 1).cast("int")).alias("kind"), F.element_at(families, (F.col("p_partkey") % 4 + 1).cast("int")).alias("page_kind"), F.col("p_partkey").alias("entity_id"), F.floor("p_retailprice").alias("points"))


@query(f"""WITH {_GAPS}, k AS (SELECT kind, count(*) AS n FROM s GROUP BY 1), f AS (SELECT kind, page_kind, count(*) AS n FROM s GROUP BY 1, 2),
    kb AS (SELECT kind, row_number() OVER (ORDER BY n DESC, kind)::INT AS kind_position, n AS kind_count, (sum(n) OVER () // count(*) OVER ())::BIGINT AS kind_floor, ceil(sum(n) OVER () / count(*) OVER ())::BIGINT AS kind_ceiling FROM k),
    fb AS (SELECT kind, page_kind, row_number() OVER (w ORDER BY n DESC, page_kind)::INT AS family_position, n AS family_count, (sum(n) OVER w // count(*) OVER w)::BIGINT AS family_floor, ceil(sum(n) OVER w / count(*) OVER w)::BIGINT AS family_ceiling FROM f WINDOW w AS (PARTITION BY kind))
    SELECT kind, page_kind, entity_id, points, rank::INT AS rank, kind_position, kind_count, kind_floor, kind_ceiling, kind_count BETWEEN kind_floor AND kind_ceiling AS kind_within,
    family_position, family_count, family_floor, family_ceiling, family_count BETWEEN family_floor AND family_ceiling AS family_within FROM s JOIN kb USING (kind) JOIN fb USING (kind, page_kind)""")
def projection_workset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The forty first gaps in groups and families with their quotas."""
    return projection.planner_workset(_gaps(spark, sf_dir), 40)


@query(f"""WITH {_GAPS}, a AS (SELECT p_partkey AS page_id, 'module' AS kind, p_brand AS anchor_id FROM part UNION SELECT l_partkey, 'symbol', l_suppkey::VARCHAR FROM lineitem),
    x AS (SELECT m.page_id, o.page_id AS other_id, count(*) AS score FROM a m JOIN a o USING (kind, anchor_id) WHERE m.page_id <> o.page_id AND m.page_id IN (SELECT entity_id FROM s) GROUP BY 1, 2),
    r AS (SELECT x.*, page_kind, row_number() OVER (PARTITION BY page_id ORDER BY score DESC, p_name, other_id) AS place, row_number() OVER (PARTITION BY page_id, page_kind ORDER BY score DESC, p_name, other_id) AS of_kind FROM x JOIN part ON p_partkey = other_id JOIN g ON g.entity_id = other_id),
    n AS (SELECT page_id, 'related' AS role, other_id, score, place AS position FROM r WHERE place <= 5 UNION ALL SELECT page_id, 'family', other_id, score, of_kind FROM r WHERE page_kind = 'how_to' AND of_kind <= 3 UNION ALL SELECT entity_id, 'page', entity_id, NULL, 0 FROM s)
    SELECT kind, entity_id, entity_id AS page_id, true AS found, role, other_id, score, position::INT AS position FROM s JOIN n ON n.page_id = s.entity_id""")
def projection_planner_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The selected gaps opened: each one's page, its related pages, and the nearest how-tos."""
    p, li, gaps = table(spark, sf_dir, "part"), table(spark, sf_dir, "lineitem"), _gaps(spark, sf_dir)
    pages = gaps.select(F.col("entity_id").alias("page_id"), F.col("page_kind").alias("kind")).join(p.select(F.col("p_partkey").alias("page_id"), F.col("p_name").alias("title")), "page_id")
    anchors = p.select(F.col("p_partkey").alias("page_id"), F.lit("module").alias("kind"), F.col("p_brand").alias("anchor_id")).union(li.select("l_partkey", F.lit("symbol"), F.col("l_suppkey").cast("string")).distinct())
    selected = projection.planner_workset(gaps, 40).select("kind", "entity_id", F.col("entity_id").alias("page_id"))
    return projection.planner_items(selected, pages, anchors, 5, "how_to", 3)
