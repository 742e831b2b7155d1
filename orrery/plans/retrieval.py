"""Corpus search, vector search, fusion, graph, state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orrery.functions import scalars as sc
from orrery.operators import fusion, graph, search, vector_index
from orrery.plans.registry import query
from orrery.sources.tables import table
from orrery.streaming import windows


@query("""SELECT p_partkey, score, p_type FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY score DESC, p_partkey) AS r FROM (SELECT *, CASE WHEN p_name = 'red ring' THEN 1.0 WHEN contains(lower(p_name), 'red ring') THEN 0.95
    WHEN contains(lower(p_type), 'red ring') THEN 0.90 WHEN contains(lower(p_brand), 'red ring') THEN 0.88 WHEN contains(lower(p_name || ' ' || p_type), 'red') THEN 0.82 END::DOUBLE AS score FROM part) WHERE score IS NOT NULL) WHERE r = 1 ORDER BY score DESC, p_partkey LIMIT 10""")
def search_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score ladder, best row of each path, top-k, payload fetch."""
    p = table(spark, sf_dir, "part")
    q = "red ring"
    wide = F.contains(F.lower(F.concat_ws(" ", "p_name", "p_type")), F.lit("red"))
    score = F.coalesce(search.section_score(F.col("p_name"), F.col("p_type"), F.col("p_brand"), F.lit(""), q), F.when(wide, 0.82))
    hits = search.best_per_key(p.withColumn("score", score).where("score IS NOT NULL"), "p_brand", F.desc("score"), F.col("p_partkey"))
    return search.hydrate(search.top(hits.select("p_partkey", "score"), 10, F.desc("score"), F.col("p_partkey")), p, "p_partkey", ["p_type"]).select("p_partkey", "score", "p_type")


@query("SELECT p_partkey, CASE WHEN lower(p_name) = 'ring' THEN 1.0 WHEN starts_with(lower(p_name), 'ring') THEN 0.97 WHEN contains(lower(p_name), 'ring') THEN 0.93 WHEN contains(lower(p_type), 'ring') THEN 0.86 WHEN contains(lower(p_brand), 'ring') THEN 0.81 END::DOUBLE AS score FROM part WHERE contains(lower(p_name || p_type || p_brand), 'ring')")
def search_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = search.symbol_score(F.col("p_name"), F.col("p_type"), F.col("p_brand"), "ring")
    return table(spark, sf_dir, "part").select("p_partkey", score.alias("score")).where("score IS NOT NULL")


@query("SELECT doc_id, CASE WHEN contains(text, 'The') THEN 0.9 WHEN contains(lower(text), 'the') THEN 0.82 ELSE 0.7 END::DOUBLE AS score FROM documents WHERE text IS NOT NULL")
def search_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", search.occurrence_score(F.col("text"), "The").alias("score"))


@query("SELECT page_id, round(0.3 * contains(lower(url), 'example')::INT + 0.2 * (contains(lower(url), 'en')::INT + contains(lower(url), 'html')::INT) / 2.0, 6)::DOUBLE AS score FROM pages")
def search_attachments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.round(search.attachment_score(F.lit("x"), F.col("url"), ["en", "html"], "example"), 6).alias("score"))


BM25 = """WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^a-z0-9]+'), lambda x: x <> '') AS w FROM documents),
    t AS (SELECT doc_id, len(w) AS dl, len(list_filter(w, lambda x: x = 'thing')) AS a, len(list_filter(w, lambda x: x = 'tion')) AS b FROM w),
    f AS (SELECT count(*) AS n, avg(dl) AS av, count(*) FILTER (a > 0) AS da, count(*) FILTER (b > 0) AS db FROM t)
    SELECT doc_id, round(ln(1 + (n - da + 0.5) / (da + 0.5)) * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * dl / av)) + ln(1 + (n - db + 0.5) / (db + 0.5)) * b * 2.2 / (b + 1.2 * (0.25 + 0.75 * dl / av)), 6) AS score FROM t, f WHERE a > 0 OR b > 0"""


@query(BM25)
def search_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.bm25(table(spark, sf_dir, "documents"), ["thing", "tion"], "doc_id", "text").select("doc_id", F.round("score", 6).alias("score"))


@query("SELECT o_custkey, round(least(greatest(max(s) + 0.15 * (sum(s) - max(s)), 0), 1), 6) AS doc_score FROM (SELECT o_custkey, o_totalprice / 1000000 AS s FROM orders) GROUP BY o_custkey")
def section_roll_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "orders").select("o_custkey", (F.col("o_totalprice") / 1000000).alias("s"))
    return search.roll_up(s, "o_custkey", "s").select("o_custkey", F.round("doc_score", 6).alias("doc_score"))


def _query_vector(spark: SparkSession, sf_dir: str, vec_id: int) -> DataFrame:
    return table(spark, sf_dir, "embeddings").where(F.col("vec_id") == vec_id).select(F.col("embedding").alias("q"))


def _scored(spark: SparkSession, sf_dir: str, vec_id: int, score) -> DataFrame:
    """Every vector against one query vector."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return e.crossJoin(F.broadcast(_query_vector(spark, sf_dir, vec_id))).withColumn("score", score(F.col("embedding"), F.col("q")))  # one row


_COS = "list_dot_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) / (sqrt(list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[])) * sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[])))"


@query(f"SELECT e.vec_id, round({_COS}, 6) AS score FROM embeddings e, embeddings q WHERE q.vec_id = 0 ORDER BY {_COS} DESC, e.vec_id LIMIT 20")
def vector_knn_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.top(_scored(spark, sf_dir, 0, sc.cosine), 20, F.desc("score"), F.col("vec_id")).select("vec_id", F.round("score", 6).alias("score"))


@query()
def vector_index_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest rows of every twentieth row, by an index over all rows; tests measure its recall."""
    e = table(spark, sf_dir, "embeddings")
    return vector_index.search(vector_index.kept(e, "embeddings", "vec_id", "embedding"), e.where("vec_id % 20 = 0"), "vec_id", "embedding")


@query("SELECT e.vec_id, round(1 / (1 + list_distance(e.embedding::DOUBLE[], q.embedding::DOUBLE[])), 6) AS score FROM embeddings e, embeddings q WHERE q.vec_id = 3")
def vector_l2_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir, 3, sc.l2_score).select("vec_id", F.round("score", 6).alias("score"))


@query(f"""WITH s AS (SELECT e.vec_id, {_COS} AS c FROM embeddings e, embeddings q WHERE q.vec_id = 5)
    SELECT vec_id, round((c + 1) / 2, 6) AS semantic_score, round(0.4 / (1 + vec_id) + 0.6 * (c + 1) / 2, 6) AS final_score FROM s""")
def vector_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").crossJoin(F.broadcast(_query_vector(spark, sf_dir, 5))).withColumn("vector_score", 1.0 / (1 + F.col("vec_id")))  # one row
    return fusion.rerank(e, F.col("embedding"), F.col("q")).select("vec_id", F.round("semantic_score", 6).alias("semantic_score"), F.round("final_score", 6).alias("final_score"))


@query(f"""WITH a AS (SELECT vec_id, row_number() OVER (ORDER BY c DESC, vec_id) - 1 AS r FROM (SELECT e.vec_id, {_COS} AS c FROM embeddings e, embeddings q WHERE q.vec_id = 0) QUALIFY r < 40),
    b AS (SELECT vec_id, row_number() OVER (ORDER BY c DESC, vec_id) - 1 AS r FROM (SELECT e.vec_id, {_COS} AS c FROM embeddings e, embeddings q WHERE q.vec_id = 1) QUALIFY r < 40)
    SELECT coalesce(a.vec_id, b.vec_id) AS vec_id, round(coalesce(1.0::DOUBLE / (10 + a.r + 1), 0) + 1.5::DOUBLE * coalesce(1.0::DOUBLE / (10 + b.r + 1), 0), 6) AS rrf FROM a FULL JOIN b ON a.vec_id = b.vec_id""")
def hybrid_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reciprocal rank fusion of two top lists; the second stands for the keyword side."""
    v, k = (fusion.ranked(_scored(spark, sf_dir, i, sc.cosine), "vec_id", "score", 40) for i in (0, 1))
    return fusion.rrf(v, k, "vec_id").select("vec_id", F.round("rrf", 6).alias("rrf"))


@query("SELECT o_orderkey, CASE WHEN s >= 0.75 OR (s >= 0.5 AND g >= 0.15) THEN 'high' WHEN s >= 0.5 THEN 'medium' ELSE 'low' END AS confidence FROM (SELECT o_orderkey, o_totalprice / 500000 AS s, o_totalprice / 500000 - lead(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) / 500000 AS g FROM orders)")
def confidence_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    o = table(spark, sf_dir, "orders").withColumn("s", F.col("o_totalprice") / 500000).withColumn("g", F.col("s") - F.lead("o_totalprice").over(w) / 500000)
    return o.select("o_orderkey", fusion.confidence(F.col("s"), F.col("g")).alias("confidence"))


def _links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges as often as they are in the table; ranks count them once."""
    return table(spark, sf_dir, "lineitem").select(F.concat(F.lit("s"), "l_suppkey").alias("src"), F.concat(F.lit("p"), "l_partkey").alias("dst"))


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _links(spark, sf_dir).distinct()


_EDGES = "e AS (SELECT DISTINCT 's' || l_suppkey AS src, 'p' || l_partkey AS dst FROM lineitem), u AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e)"


def _seeds(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("s1",), ("s2",)], "node string")


@query(f"WITH RECURSIVE {_EDGES}, r(node, distance) AS (SELECT unnest(['s1', 's2']), 0 UNION SELECT u.dst, r.distance + 1 FROM r JOIN u ON r.node = u.src WHERE r.distance < 2) SELECT node, min(distance) AS distance FROM r GROUP BY node")
def graph_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.distances(_edges(spark, sf_dir), _seeds(spark), 2)


@query(f"WITH {_EDGES}, d AS (SELECT node, sum(i)::BIGINT AS n_in, sum(o)::BIGINT AS n_out FROM (SELECT src AS node, 0 AS i, 1 AS o FROM e UNION ALL SELECT dst, 1, 0 FROM e) GROUP BY node) SELECT node, n_in, n_out, round(ln(1 + 2 * n_in + n_out) / max(ln(1 + 2 * n_in + n_out)) OVER (), 6) AS score FROM d")
def graph_degree_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.degree_rank(_edges(spark, sf_dir)).withColumn("score", F.round("score", 6))


def _pagerank_sql(n: int) -> str:
    parts = [f"WITH {_EDGES}, o AS (SELECT src, count(*) AS n FROM u GROUP BY src), s AS (SELECT src AS node FROM o WHERE src IN ('s1', 's2')), b AS (SELECT o.src AS node, CASE WHEN s.node IS NULL THEN 0.0::DOUBLE ELSE 1.0::DOUBLE / (SELECT count(*) FROM s) END AS restart FROM o LEFT JOIN s ON o.src = s.node), r0 AS (SELECT node, restart AS rank FROM b)"]
    for i in range(n):
        parts.append(f"f{i} AS (SELECT u.dst, sum(r{i}.rank / o.n) AS got FROM u JOIN o ON u.src = o.src JOIN r{i} ON u.src = r{i}.node GROUP BY u.dst), r{i + 1} AS (SELECT b.node, 0.15 * b.restart + 0.85 * coalesce(got, 0) AS rank FROM b LEFT JOIN f{i} ON b.node = f{i}.dst)")
    return ", ".join(parts) + f" SELECT node, round(rank, 8) AS rank FROM r{n}"


@query(_pagerank_sql(30))
def graph_personalized_pagerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Until the ranks settle, 30 rounds at most; a walk between two kinds of nodes takes them all, as its SQL does."""
    return graph.pagerank(_links(spark, sf_dir), _seeds(spark)).select("node", F.round("rank", 8).alias("rank"))


@query(_pagerank_sql(4))
def graph_pagerank_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four rounds, on the way for graphs of any size."""
    return graph.pagerank(_links(spark, sf_dir), _seeds(spark), 4, tol=0.0).select("node", F.round("rank", 8).alias("rank"))


@query(f"WITH {_EDGES}, m AS (SELECT src AS node, 'c' || length(src) AS cluster FROM e GROUP BY 1) SELECT DISTINCT coalesce(m.cluster, e.src) AS src, e.dst FROM e LEFT JOIN m ON e.src = m.node")
def graph_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _edges(spark, sf_dir)
    m = e.select(F.col("src").alias("node"), F.concat(F.lit("c"), F.length("src").cast("string")).alias("cluster")).distinct()
    return graph.collapse(e, m)


@query("SELECT lower(c_mktsegment) AS k, min_by(c_name, c_custkey) AS name, max(c_acctbal) AS confidence, string_agg(DISTINCT c_name, ',' ORDER BY c_name) AS aliases FROM customer GROUP BY 1")
def merge_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.lower("c_mktsegment").alias("k"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("confidence"), "c_custkey")
    return graph.merge_entities(c, "k", "c_custkey").select("k", "name", "confidence", "aliases")


@query("SELECT p_partkey, len(list_filter(regexp_split_to_array(p_name || ' ' || p_brand, '[^A-Za-z0-9_-]+'), lambda x: x <> '')) AS n_tokens, (contains(p_name, 'red')::INT + contains(p_name, 'ring')::INT) / 2.0::DOUBLE AS ratio, ((length(p_name) - length(replace(p_name, 'r', ''))))::INT AS n_r, CASE WHEN length(p_name) > 8 THEN substr(p_name, 1, 8) || '...' ELSE p_name END AS snip FROM part")
def scalar_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("p_name")
    tokens = F.array(F.lit("red"), F.lit("ring"))
    return table(spark, sf_dir, "part").select("p_partkey", F.size(sc.tokenize(F.concat_ws(" ", "p_name", "p_brand"))).cast("long").alias("n_tokens"), sc.token_match_ratio(n, tokens).alias("ratio"), sc.count_occurrences(n, "r").alias("n_r"), sc.snippet(n, 8).alias("snip"))


@query("SELECT p_partkey, levenshtein(p_name, 'red widget')::INT AS d, round(1.0 - levenshtein(p_name, 'red widget') / greatest(length(p_name), 10)::DOUBLE, 6) AS score, round(CASE WHEN p_name = 'red widget' THEN 1.0 WHEN contains(p_name, 'red widget') OR contains('red widget', p_name) THEN 0.9 ELSE 1.0 - levenshtein(p_name, 'red widget') / greatest(length(p_name), 10)::DOUBLE END, 6) AS sim FROM part")
def scalar_edit_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, q = F.col("p_name"), F.lit("red widget")
    return table(spark, sf_dir, "part").select("p_partkey", F.levenshtein(n, q).alias("d"), F.round(sc.edit_score(n, q), 6).alias("score"), F.round(sc.name_similarity(n, q), 6).alias("sim"))


@query("SELECT page_id, 'page://' || split_part(url, '#', 1) AS uri FROM pages WHERE regexp_matches(lower(url), '^https?://')")
def scalar_web_uri(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", sc.canonical_web_uri(F.col("url")).alias("uri")).where("uri IS NOT NULL")


@query("SELECT user_id, round(least(greatest(5 * exp(-0.05 * (max(day) - min(day))) + 0.5 * ln(1 + count(*)), 1), 10), 6) AS saliency FROM (SELECT user_id, day(ts) AS day FROM events) GROUP BY user_id")
def state_saliency(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").groupBy("user_id").agg((F.max(F.dayofmonth("ts")) - F.min(F.dayofmonth("ts"))).alias("days"), F.count("*").alias("n"))
    return e.select("user_id", F.round(sc.saliency(F.lit(5.0), F.col("days"), F.col("n")), 6).alias("saliency"))


@query("SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role) AS r FROM conversations) WHERE r <= 2")
def session_last_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"), "role")
    return table(spark, sf_dir, "conversations").withColumn("r", F.row_number().over(w)).where("r <= 2").select("conv_id", "turn", "role")


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS r FROM events) WHERE r = 1 AND event_type <> 'error'")
def latest_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest row of a key in an append log; the state filter comes after."""
    return search.best_per_key(table(spark, sf_dir, "events"), "user_id", F.desc("ts"), F.col("event_id")).where("event_type <> 'error'").select("user_id", "event_id", "event_type")


@query("SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def window_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = windows.windowed(table(spark, sf_dir, "events"), "ts", "1 hour", keys=("event_type",))
    return w.select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("SELECT strftime(s, '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT value, unnest([date_trunc('hour', ts), date_trunc('hour', ts) - INTERVAL 1 HOUR]) AS s FROM events) GROUP BY 1")
def window_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = windows.windowed(table(spark, sf_dir, "events"), "ts", "2 hours", "1 hour")
    return w.select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n", F.round("total", 4).alias("total"))


@query("WITH a AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), b AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM a) SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM b GROUP BY user_id, s")
def window_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = windows.sessions(table(spark, sf_dir, "events"), "ts", "2 hours", "user_id")
    return s.select("user_id", F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


@query()
def scalar_osa_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edit distance with transpositions; tests hold it against a plain version."""
    return table(spark, sf_dir, "part").select("p_partkey", sc.osa_distance(F.col("p_name"), F.lit("rde ringlet")).alias("d"))
