"""Statistics, audits, table versions, graph neighbourhoods, sessions and logs, aggregates of plugins."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.operators import entities, graph, state, stats, surface
from orrery.plans.registry import query
from orrery.plans.retrieval import _EDGES, _edges, _links, _seeds
from orrery.sources.shared import new_path
from orrery.sources.tables import mutation_plan, register, table, unknown_partition, write_nonempty
from orrery.sources.versions import VersionedTable, arrow_relation


@query("SELECT event_type AS kind, count(*) AS n FROM events GROUP BY 1")
def stats_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.type_counts(table(spark, sf_dir, "events"), "event_type")


@query("""WITH e AS (SELECT l_suppkey AS src, -l_partkey AS dst FROM lineitem), c AS (SELECT 'source' AS side, src AS node, count(*) AS n FROM e GROUP BY 2 UNION ALL SELECT 'target', dst, count(*) FROM e GROUP BY 2 UNION ALL SELECT 'any', node, count(*) FROM (SELECT src AS node FROM e UNION ALL SELECT dst FROM e) GROUP BY 2)
    SELECT side, node, n FROM c QUALIFY row_number() OVER (PARTITION BY side ORDER BY n DESC, node) <= 5""")
def stats_connections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.connections(table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("src"), (-F.col("l_partkey")).alias("dst")))


@query("SELECT count(*) AS total, count(o) AS covered, round(count(o) / count(*), 6) AS share FROM (SELECT c_custkey, max(o_custkey) AS o FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1)")
def stats_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, o = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")), table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"))
    return stats.coverage(c, o, "k").withColumn("share", F.round("share", 6))


@query("SELECT 'part' AS name, count(*) AS n FROM part UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'documents', count(*) FROM documents UNION ALL SELECT 'pages', count(*) FROM pages")
def stats_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.overview({n: table(spark, sf_dir, n) for n in ("part", "orders", "documents", "pages")})


@query("SELECT 'event_type' AS \"column\", CASE WHEN count(DISTINCT event_type) < 100 THEN 'bitmap' ELSE 'btree' END AS index FROM events UNION ALL SELECT 'event_id', CASE WHEN count(DISTINCT event_id) < 100 THEN 'bitmap' ELSE 'btree' END FROM events")
def stats_index_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which index suits each column, by a sketch of its distinct values."""
    return stats.cardinality(table(spark, sf_dir, "events"), ["event_type", "event_id"]).select("column", "index")


@query("WITH r AS (SELECT p_name AS name, CASE WHEN p_size % 2 = 1 THEN p_brand END AS address FROM part) SELECT CASE WHEN address IS NULL THEN 'note' ELSE 'addressed' END AS kind, count(*) AS n, (SELECT count(*) FROM r) AS total, (SELECT count(DISTINCT name) FROM r) AS names FROM r GROUP BY 1")
def stats_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.reference_stats(table(spark, sf_dir, "part").select(F.col("p_name").alias("name"), F.when(F.col("p_size") % 2 == 1, F.col("p_brand")).alias("address")))


@query("SELECT coalesce(source, 'none') AS category, count(*) AS n, (SELECT count(*) FROM documents) AS total, (SELECT count(DISTINCT lang) FROM documents) AS tags, (SELECT max(doc_id) FROM documents) AS last FROM documents GROUP BY 1")
def stats_knowledge(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.coalesce("source", F.lit("none")).alias("category"), F.array_compact(F.array("lang")).alias("tags"), F.col("doc_id").alias("updated"))
    return stats.knowledge_stats(d).select("category", "n", "total", "tags", "last")


@query("SELECT l_returnflag AS repo, l_suppkey AS src, l_partkey % 100 AS dst, l_linestatus AS kind, min(l_orderkey) AS id FROM lineitem GROUP BY ALL")
def relation_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("repo"), F.col("l_suppkey").alias("src"), (F.col("l_partkey") % 100).alias("dst"), F.col("l_linestatus").alias("kind"), F.col("l_orderkey").alias("id"))
    return stats.deduped_relations(li, ["id"])


@query("SELECT doc_id FROM documents ORDER BY coalesce(source, '') || '/' || doc_id, coalesce(source, '') LIMIT 25")
def notes_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("source", F.lit("")).alias("stem"))
    return stats.table_of_contents(d.withColumn("path", F.concat_ws("/", "stem", F.col("doc_id").cast("string"))), 25).select("doc_id")


@query("SELECT doc_id FROM documents WHERE lang = 'fr' AND (contains(lower(text), 'the ') OR contains(lower(text), 'une ')) AND doc_id NOT IN (SELECT l_suppkey FROM lineitem UNION SELECT l_partkey FROM lineitem)")
def filter_note_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes without tags and links that name a phrase; French ones have no tags here."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text", F.when(F.coalesce(F.col("lang"), F.lit("")) == "fr", F.array().cast("array<string>")).otherwise(F.array(F.lit("tag"))).alias("tags"))
    links = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"))
    return stats.state_filters(d, links, "doc_id", orphan=True, tagless=True, mentions=["The ", "une "]).select("doc_id")


@query("""WITH d AS (SELECT o_orderkey AS doc_id, CASE o_orderkey % 3 WHEN 0 THEN 'bolt' WHEN 1 THEN 'the large widget' ELSE 'gear' END AS title FROM orders),
    g AS (SELECT p_partkey AS symbol_id, max(contains(title, p_name) OR contains(p_name, title)) AS good, count(l_partkey) AS n FROM part LEFT JOIN lineitem ON l_partkey = p_partkey AND l_quantity < 3 LEFT JOIN d ON l_orderkey = doc_id GROUP BY 1)
    SELECT symbol_id, CASE WHEN n = 0 THEN 'unknown' WHEN good THEN 'verified' ELSE 'unverified' END AS state FROM g""")
def audit_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Small quantities stand for the relation of documenting; other lines relate otherwise."""
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    title = F.when(F.col("o_orderkey") % 3 == 0, "bolt").when(F.col("o_orderkey") % 3 == 1, "the large widget").otherwise("gear")
    symbols = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("symbol_id"), F.col("p_name").alias("name"))
    return stats.audited_symbols(symbols, o.select(F.col("o_orderkey").alias("doc_id"), title.alias("title")), li.where("l_quantity < 3").select(F.col("l_orderkey").alias("doc_id"), F.col("l_partkey").alias("symbol_id")))


@query("""WITH t AS (SELECT p_partkey AS id, list_concat(string_split(p_name, ' '), [p_type, p_brand]) AS tags FROM part)
    SELECT a.id AS left_id, b.id AS right_id, array_to_string(list_sort(list_intersect(a.tags, b.tags)), ',') AS shared, round(len(list_intersect(a.tags, b.tags)) / len(list_distinct(list_concat(a.tags, b.tags))), 6)::DOUBLE AS overlap FROM t a JOIN t b ON b.id = a.id + 1""")
def structural_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.concat(F.split("p_name", " "), F.array("p_type", "p_brand")).alias("tags"))
    pairs = t.select(F.col("id").alias("left_id"), F.col("tags").alias("left_tags"), (F.col("id") + 1).alias("right_id")).join(t.select(F.col("id").alias("right_id"), F.col("tags").alias("right_tags")), "right_id")
    return stats.structural_pairs(pairs).select("left_id", "right_id", F.array_join("shared", ",").alias("shared"), F.round("overlap", 6).alias("overlap"))


@query("WITH n AS (SELECT c_custkey AS id, c_name AS path, c_mktsegment AS hash FROM customer) SELECT id, path FROM n WHERE hash = 'BUILDING'")
def address_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No id and no path is called so; the hash is."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("path"), F.col("c_mktsegment").alias("hash"))
    return stats.resolved(c, "BUILDING").select("id", "path")


def _related_sql() -> str:
    parts = [f"""WITH RECURSIVE {_EDGES}, r(node, distance) AS (SELECT unnest(['s1', 's2']), 0 UNION SELECT u.dst, r.distance + 1 FROM r JOIN u ON r.node = u.src WHERE r.distance < 2), w AS (SELECT node, min(distance) AS distance FROM r GROUP BY node),
        near AS (SELECT * FROM w WHERE distance = 0 UNION ALL SELECT * FROM (FROM w WHERE distance > 0 ORDER BY distance, node LIMIT 5000)), v AS (SELECT src, dst FROM u WHERE src IN (SELECT node FROM near) AND dst IN (SELECT node FROM near)),
        o AS (SELECT src, count(*) AS n FROM v GROUP BY src), b AS (SELECT src AS node, CASE WHEN src IN ('s1', 's2') THEN 1.0 / (SELECT count(*) FROM o WHERE src IN ('s1', 's2')) ELSE 0 END::DOUBLE AS restart FROM o), r0 AS (SELECT node, restart AS rank FROM b)"""]
    for i in range(30):
        parts.append(f"f{i} AS (SELECT v.dst, sum(r{i}.rank / o.n) AS got FROM v JOIN o ON v.src = o.src JOIN r{i} ON v.src = r{i}.node GROUP BY v.dst), r{i + 1} AS (SELECT b.node, 0.15 * b.restart + 0.85 * coalesce(got, 0) AS rank FROM b LEFT JOIN f{i} ON b.node = f{i}.dst)")
    return ", ".join(parts) + " SELECT node, distance::INT AS distance, round(rank, 7) AS score FROM r30 JOIN near USING (node) WHERE distance > 0"


@query(_related_sql())
def graph_related(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All nodes of the horizon; a walk between two kinds of nodes does not settle before the last round."""
    return graph.related(_links(spark, sf_dir), _seeds(spark), 2, limit=5000).select("node", "distance", F.round("score", 7).alias("score"))


def _fused_sql(rounds: int) -> str:
    parts = [f"""WITH {_EDGES}, o AS (SELECT src, count(*) AS n FROM u GROUP BY src), k AS (SELECT DISTINCT 'k' || (l_suppkey % 4) AS kernel, 's' || l_suppkey AS node FROM lineitem WHERE l_suppkey < 8),
        r0 AS (SELECT kernel, node, 1.0::DOUBLE / count(*) OVER (PARTITION BY kernel) AS r FROM k), p0 AS (SELECT kernel, node, r * 0.15 AS r FROM r0)"""]
    for i in range(rounds):
        parts.append(f"r{i + 1} AS (SELECT kernel, dst AS node, sum(r * 0.85 / n) AS r FROM r{i} JOIN u ON node = u.src JOIN o ON o.src = u.src GROUP BY 1, 2)" + (f", p{i + 1} AS (SELECT kernel, node, r * 0.15 AS r FROM r{i + 1})" if i + 1 < rounds else ""))
    union = " UNION ALL ".join([f"FROM p{i}" for i in range(rounds)] + [f"FROM r{rounds}"])
    return ", ".join(parts) + f" SELECT node, round(max(rank), 8) AS rank FROM (SELECT kernel, node, sum(r) AS rank FROM ({union}) GROUP BY 1, 2) GROUP BY node"


@query(_fused_sql(6))
def graph_fused_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranks of four kernels of suppliers over the whole graph, pushed in six waves at once and fused by the highest."""
    li = table(spark, sf_dir, "lineitem").where("l_suppkey < 8")
    seeds = li.select(F.concat(F.lit("k"), F.col("l_suppkey") % 4).alias("kernel"), F.concat(F.lit("s"), "l_suppkey").alias("node"))
    return graph.fused(graph.pushed_ranks(_links(spark, sf_dir), seeds, 6, least=0.0)).withColumn("rank", F.round("rank", 8))


@query(f"WITH {_EDGES}, x AS (SELECT src AS node, dst AS other, 1 AS o, 0 AS i FROM e UNION ALL SELECT dst, src, 0, 1 FROM e) SELECT node, count(DISTINCT CASE WHEN o = 1 THEN other END) AS n_out, count(DISTINCT CASE WHEN i = 1 THEN other END) AS n_in, count(DISTINCT other) AS n_both FROM x GROUP BY node")
def graph_neighbor_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.neighbor_counts(_edges(spark, sf_dir))


@query(f"WITH RECURSIVE {_EDGES}, r(node, distance) AS (SELECT unnest(['s1', 's2']), 0 UNION SELECT e.dst, r.distance + 1 FROM r JOIN e ON r.node = e.src WHERE r.distance < 8) SELECT node, min(distance)::INT AS distance FROM r GROUP BY node HAVING min(distance) > 0 ORDER BY distance, node LIMIT 300")
def graph_neighbors_bounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outgoing links only; hops and limit beyond their bounds are cut to them."""
    return graph.neighbors(_edges(spark, sf_dir), _seeds(spark), "out", 99, 9999)


@query(f"WITH {_EDGES} SELECT DISTINCT 'at/' || length(dst) || '/' || right(dst, 2) AS path FROM u WHERE src IN ('s1', 's2') AND dst NOT IN ('s1', 's2')")
def graph_paths_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _edges(spark, sf_dir)
    paths = e.select(F.explode(F.array("src", "dst")).alias("node")).distinct().withColumn("path", F.expr("concat('at/', length(node), '/', right(node, 2))"))
    return graph.paths_at(graph.distances(e, _seeds(spark), 2), paths, 1)


@query("""SELECT 1 AS version, 'append' AS action, count(*) AS n, count(*)::BIGINT AS wide FROM customer UNION ALL SELECT 2, 'append', (SELECT count(*) FROM customer) + count(*), (SELECT count(*) FROM customer) + count(*) FROM supplier
    UNION ALL SELECT 3, 'delete', (SELECT count(*) FROM customer WHERE c_nationkey <> 3) + count(*), (SELECT count(*) FROM customer WHERE c_nationkey <> 3) + count(*) FROM supplier WHERE s_nationkey <> 3
    UNION ALL SELECT 4, 'replace', count(*), count(*) FROM supplier UNION ALL SELECT 5, 'replace', count(*), count(*) FROM supplier UNION ALL SELECT 6, 'checkout', (SELECT count(*) FROM customer) + count(*), (SELECT count(*) FROM customer) + count(*) FROM supplier""")
def table_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Append, append by partition, delete, replace, migrate and check out; rows of each version, read again afterwards."""
    t = VersionedTable(spark, new_path(spark, "versions"))
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("nation"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("nation"))
    t.append(c)
    t.append(s.withColumn("metadata", F.lit('{"kind": "s"}')).withColumn("kind", unknown_partition(F.col("metadata"), "kind")), "kind")
    t.delete(F.col("nation") == 3)
    t.replace(s)
    t.migrate({"nation": "bigint"})
    t.checkout(2)
    parts = [t.read(v).agg(F.lit(v).alias("version"), F.lit(t.manifest(v)["action"]).alias("action"), F.count("*").alias("n"), F.count(F.col("nation").cast("bigint")).alias("wide")) for v in t.versions()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("SELECT r_name AS name, n_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_regionkey IN (1, 3)")
def table_arrow_relation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A relation that the caller holds, the names of two regions, joined by SQL."""
    names = {r["r_regionkey"]: r["r_name"] for r in table(spark, sf_dir, "region").collect()}  # five rows
    arrow_relation(spark, "held", "regions", pa.table({"k": pa.array([1, 3], pa.int32()), "name": [names[1], names[3]]}))
    register(spark, "registered_nation", f"{sf_dir}/nation.parquet")
    return spark.sql("SELECT name, n_name FROM registered_nation JOIN held_regions ON n_regionkey = k")


@query("SELECT 'ReplaceAll' AS first, 'CloneAndMutate' AS changed, 'Noop' AS same, 'RefreshPublication' AS moved, true AS wrote, false AS wrote_empty")
def staged_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    path = new_path(spark, "nonempty")
    wrote = write_nonempty(n, path), write_nonempty(n.limit(0), path)
    plans = [mutation_plan(c, had, same) for c, had, same in ((0, False, False), (2, True, False), (0, True, True), (0, True, False))]
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in zip(("first", "changed", "same", "moved", "wrote", "wrote_empty"), [*plans, *wrote], strict=True)])


@query("SELECT conv_id, turn, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INT AS slot FROM (FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 3)")
def session_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.last_turns(table(spark, sf_dir, "conversations").select("conv_id", "turn"), "conv_id", "turn", 3)


@query("SELECT conv_id, turn FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn) <= 2")
def session_drained(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.drained(table(spark, sf_dir, "conversations").select("conv_id", "turn"), "conv_id", "turn", 2)


_LOG = "l AS (SELECT l_partkey AS k, l_orderkey * 10 + l_linenumber AS pos, CASE WHEN l_quantity < 25 THEN 'provisional' WHEN l_quantity < 35 THEN 'promoted' ELSE 'rejected' END AS state FROM lineitem)"


@query(f"""WITH {_LOG}, o AS (SELECT k, min(pos) AS opened FROM l WHERE state = 'provisional' GROUP BY k), d AS (SELECT o.k, opened, first(l.state ORDER BY l.pos, l.state) AS s, min(l.pos) AS t FROM o LEFT JOIN l ON l.k = o.k AND l.pos > opened AND l.state <> 'provisional' GROUP BY ALL)
    SELECT k, coalesce(s, 'provisional') AS state, coalesce(t, opened) AS decided FROM d""")
def state_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    kind = F.when(F.col("l_quantity") < 25, "provisional").when(F.col("l_quantity") < 35, "promoted").otherwise("rejected")
    return state.decided(li.select(F.col("l_partkey").alias("k"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"), kind.alias("state")), "k", "pos", "state").withColumnRenamed("at", "decided")


RULES = {("none", "provisional"): "provisional", ("provisional", "promoted"): "promoted", ("provisional", "rejected"): "rejected", ("rejected", "provisional"): "provisional"}
_NEXT = "CASE " + " ".join(f"WHEN {{s}} = '{s}' AND n.state = '{a}' THEN '{t}'" for (s, a), t in RULES.items()) + " ELSE {s} END"
_LEGAL = " OR ".join(f"({{s}} = '{s}' AND n.state = '{a}')" for s, a in RULES)


@query(f"""WITH RECURSIVE l AS (SELECT l_partkey AS k, l_orderkey * 10 + l_linenumber AS pos, CASE WHEN max(l_quantity) < 25 THEN 'provisional' WHEN max(l_quantity) < 35 THEN 'promoted' ELSE 'rejected' END AS state FROM lineitem GROUP BY 1, 2), n AS (SELECT k, pos, state, row_number() OVER (PARTITION BY k ORDER BY pos) AS i FROM l),
    r AS (SELECT k, pos, state, i, 'none' AS before, {_NEXT.format(s="'none'")} AS after, {_LEGAL.format(s="'none'")} AS legal FROM n WHERE i = 1
    UNION ALL SELECT n.k, n.pos, n.state, n.i, r.after, {_NEXT.format(s="r.after")}, {_LEGAL.format(s="r.after")} FROM r JOIN n ON n.k = r.k AND n.i = r.i + 1)
    SELECT k, pos, state, before, after, legal FROM r""")
def state_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every step of each link's log: from which state to which, and whether it was legal; a rejected link may be suggested again."""
    li = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("k"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos")).agg(F.max("l_quantity").alias("l_quantity"))
    kind = F.when(F.col("l_quantity") < 25, "provisional").when(F.col("l_quantity") < 35, "promoted").otherwise("rejected")
    log = li.select("k", "pos", kind.alias("state"))
    return state.transitions(log, "k", "pos", "state", RULES, "none")


@query("""WITH n AS (SELECT c_mktsegment AS src, 'n' || c_nationkey AS dst, 'k' || c_custkey % 2 AS kind FROM customer), k AS (SELECT 'n' || n_nationkey AS name FROM nation WHERE n_regionkey < 3 UNION SELECT 'BUILDING' UNION SELECT 'FURNITURE')
    SELECT kind, count(DISTINCT (src, dst)) FILTER (src IN (FROM k) AND dst IN (FROM k)) AS added, count(*) FILTER (NOT (src IN (FROM k) AND dst IN (FROM k))) AS refused FROM n GROUP BY kind""")
def graph_added_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relations whose ends are both known are added once, the others refused."""
    n = table(spark, sf_dir, "nation").where("n_regionkey < 3").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("name"), F.col("n_nationkey").cast("string").alias("id"))
    segments = spark.range(1).select(F.explode(F.array(F.lit("BUILDING"), F.lit("FURNITURE"))).alias("name"), F.lit("x").alias("id"))
    known = entities.upserted_entities(n, segments)
    new = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("src"), F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("dst"), F.concat(F.lit("k"), (F.col("c_custkey") % 2).cast("string")).alias("kind"))
    added, refused = entities.added_relations(known, new.limit(0), new)
    a, r = added.groupBy("kind").agg(F.count("*").alias("added")), refused.groupBy("kind").agg(F.count("*").alias("refused"))
    zero = F.lit(0).cast("long")
    return a.join(r, "kind", "full").select("kind", F.coalesce("added", zero).alias("added"), F.coalesce("refused", zero).alias("refused"))


@query("SELECT c_nationkey, round(exp(avg(ln(abs(c_acctbal) + 1))), 4) AS mean FROM customer GROUP BY 1")
def surface_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A geometric mean in Python, called from SQL."""
    surface.register_aggregate(spark, "geometric_mean", "double", lambda x: float(np.exp(np.log(x).mean())))
    table(spark, sf_dir, "customer").createOrReplaceTempView("aggregate_customer")
    return spark.sql("SELECT c_nationkey, round(geometric_mean(abs(c_acctbal) + 1), 4) AS mean FROM aggregate_customer GROUP BY c_nationkey")


@query("SELECT l_orderkey, l_linenumber, l_partkey, round(l_quantity / 50 + l_discount, 6) AS score FROM lineitem")
def surface_scorer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An outside scorer over Arrow batches."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_discount")
    scored = surface.scored_by(li, ["l_quantity", "l_discount"], lambda b: (b.column(0).to_numpy() / 50 + b.column(1).to_numpy()).tolist())
    return scored.select("l_orderkey", "l_linenumber", "l_partkey", F.round("score", 6).alias("score"))
