"""Repository and page search, planned note search, tool lists, weights by intent."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.functions import intents
from orrery.functions import scalars as sc
from orrery.operators import fanout, fusion, linkgraph, repo, search, state, tools
from orrery.plans.notes import _COUNTED, _LEXICAL, _LINES, _NOTES, QUERY, _notes
from orrery.plans.registry import query
from orrery.sources.tables import table


def _entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    kind = F.element_at(F.array(F.lit("module"), F.lit("symbol"), F.lit("example")), (F.col("p_partkey") % 3 + 1).cast("int"))
    return p.select(
        F.col("p_partkey").alias("id"), kind.alias("entity_kind"), F.col("p_name").alias("name"), F.concat_ws(".", "p_brand", "p_name").alias("qualified_name"), F.concat_ws("/", "p_type", F.replace("p_name", F.lit(" "), F.lit("/"))).alias("path"), F.col("p_type").alias("language"), F.col("p_brand").alias("symbol_kind"),
        F.concat_ws(" ", "p_type", "p_name").alias("signature"), F.col("p_brand").alias("summary"), F.split("p_name", " ").alias("related_symbols"), F.array("p_type").alias("related_modules"), (F.col("p_size") / 200).alias("saliency_score"),
    )


_ENTITIES = """p AS (SELECT p_partkey AS id, p_partkey % 3 AS k, lower(p_name) AS name, lower(p_brand || '.' || p_name) AS qualified, lower(p_type || '/' || replace(p_name, ' ', '/')) AS path, lower(p_type) AS lang, lower(p_type || ' ' || p_name) AS sig, lower(p_brand) AS summary, string_split(lower(p_name), ' ') AS syms, p_size / 200.0::DOUBLE AS saliency FROM part),
    b AS (SELECT *, CASE k WHEN 0 THEN (4 - CASE WHEN qualified = 'bolt' THEN 0 WHEN starts_with(qualified, 'bolt') THEN 1 WHEN contains(qualified, 'bolt') THEN 2 WHEN contains(path, 'bolt') THEN 3 END) / 4.0::DOUBLE
        WHEN 1 THEN (8 - CASE WHEN name = 'bolt' THEN 0 WHEN qualified = 'bolt' THEN 1 WHEN starts_with(name, 'bolt') THEN 2 WHEN starts_with(qualified, 'bolt') THEN 3 WHEN contains(name, 'bolt') THEN 4 WHEN contains(qualified, 'bolt') THEN 5 WHEN contains(sig, 'bolt') THEN 6 WHEN contains(path, 'bolt') THEN 7 END) / 8.0::DOUBLE
        ELSE (11 - CASE WHEN name = 'bolt' THEN 0 WHEN starts_with(name, 'bolt') THEN 1 WHEN contains(name, 'bolt') THEN 2 WHEN list_contains(syms, 'bolt') THEN 3 WHEN lang = 'bolt' THEN 4 WHEN len(list_filter(syms, lambda x: starts_with(x, 'bolt'))) > 0 THEN 5 WHEN starts_with(lang, 'bolt') THEN 6 WHEN contains(path, 'bolt') THEN 7 WHEN contains(summary, 'bolt') THEN 8 WHEN len(list_filter(syms, lambda x: contains(x, 'bolt'))) > 0 THEN 9 WHEN contains(lang, 'bolt') THEN 10 END) / 11.0::DOUBLE END AS m FROM p),
    f AS (SELECT id, name, path, least(greatest(m, saliency, 0), 1) AS score FROM b WHERE m IS NOT NULL)"""


@query(f"WITH {_ENTITIES} SELECT id, round(score, 6) AS score FROM f")
def search_repo_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Modules, symbols and examples that match, each kind by its own ladder."""
    return repo.search_entities(_entities(spark, sf_dir), "bolt").select("id", F.round("score", 6).alias("score"))


@query("""WITH s AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_returnflag AS target, l_linestatus AS source FROM lineitem) SELECT id, CASE WHEN target = 'A' AND source = 'F' THEN 1.0 END::DOUBLE AS score FROM s WHERE target = 'A' AND source = 'F'""")
def search_repo_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    none = F.lit(None).cast("string")
    e = li.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.lit("import").alias("entity_kind"), F.col("l_linestatus").alias("name"), F.col("l_returnflag").alias("qualified_name"), *[none.alias(c) for c in ("path", "language", "symbol_kind", "signature", "summary")], F.array().cast("array<string>").alias("related_symbols"), F.array().cast("array<string>").alias("related_modules"), F.lit(0.0).alias("saliency_score"))
    return repo.search_entities(e, "", package="a", module="f").select("id", "score")


_SOURCES = """a AS (SELECT 'entities' AS source, id::VARCHAR AS id, path, score FROM f ORDER BY score DESC, path, id::VARCHAR LIMIT 40), b2 AS (SELECT 'suppliers', s_suppkey::VARCHAR AS id, s_name AS path, abs(s_acctbal) / 20000 AS score FROM supplier ORDER BY score DESC, path, id LIMIT 40),
    c AS (SELECT 'customers', c_custkey::VARCHAR AS id, c_name AS path, abs(c_acctbal) / 20000 AS score FROM customer ORDER BY score DESC, path, id LIMIT 40), m AS (SELECT * FROM (FROM a UNION ALL FROM b2 UNION ALL FROM c) ORDER BY score DESC, path, source, id LIMIT 40)"""


@query(f"WITH {_ENTITIES}, {_SOURCES} SELECT source, id, path, round(score, 6) AS score, true AS partial, 1::BIGINT AS n_pending FROM m")
def search_intent_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best hits of three corpora in one list, of which one repository is not searched yet."""
    found = repo.search_entities(_entities(spark, sf_dir), "bolt")
    low = F.lower("path")
    sources = {"entities": found.select(F.col("id").cast("string").alias("id"), low.alias("path"), "score")}
    for name, prefix in (("suppliers", "s"), ("customers", "c")):
        t = table(spark, sf_dir, {"s": "supplier", "c": "customer"}[prefix])
        key = F.col("s_suppkey" if prefix == "s" else "c_custkey").cast("string")
        sources[name] = t.select(key.alias("id"), F.col(f"{prefix}_name").alias("path"), (F.abs(F.col(f"{prefix}_acctbal")) / 20000).alias("score"))
    return repo.intent_hits(sources, 40, pending=["later"]).select("source", "id", "path", F.round("score", 6).alias("score"), "partial", F.size("pending").cast("long").alias("n_pending"))


def _contains(spark: SparkSession, sf_dir: str, name: str, key: str, text: str):
    """Hits of a table: rows whose text holds the query, worth more the shorter they are."""

    def hits(q: str, limit: int) -> DataFrame:
        rows = table(spark, sf_dir, name).where(F.contains(F.lower(text), F.lit(q.lower())))
        found = rows.select(F.col(key).cast("string").alias("id"), F.col(text).alias("path"), (len(q) / F.char_length(text)).alias("score"))
        return found.orderBy(F.desc("score"), "path", "id").limit(limit)

    return hits


def _contains_sql(name: str, key: str, text: str) -> str:
    return f"(SELECT '{name}' AS source, {key}::VARCHAR AS id, {text} AS path, 2 / len({text}) AS score FROM {name} WHERE contains(lower({text}), 'er') ORDER BY score DESC, path, id LIMIT 24)"


_CODE = {"clients": ("client_id", "name"), "vendors": ("vendor_id", "name"), "items": ("item_id", "name"), "supplier": ("s_suppkey", "s_name")}


@query("SELECT source, id, path, round(score, 6)::DOUBLE AS score, 0::BIGINT AS n_pending, false AS partial FROM (" + " UNION ALL ".join(_contains_sql(n, *c) for n, c in _CODE.items()) + ") ORDER BY score DESC, path, source, id LIMIT 60")
def search_fan_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four tables searched side by side, all in time."""
    found = fanout.code_search(spark, "er", {n: _contains(spark, sf_dir, n, *c) for n, c in _CODE.items()}, 60, seconds=600.0)
    return found.select("source", "id", "path", F.round("score", 6).alias("score"), F.size("pending").cast("long").alias("n_pending"), "partial")


@query("""WITH s AS (SELECT DISTINCT p_name AS name FROM part), t AS (SELECT name, CASE WHEN name = 'small bolt' THEN 0 WHEN left(name, 1) = 's' AND levenshtein('small bolt', name) <= 5 THEN 1 WHEN contains(name, 'small bolt') THEN 2 END AS tier,
    CASE WHEN name = 'small bolt' THEN 1.0 WHEN left(name, 1) = 's' AND levenshtein('small bolt', name) <= 5 THEN 1 - levenshtein('small bolt', name) / greatest(length(name), 10)::DOUBLE ELSE 0 END::DOUBLE AS score FROM s)
    SELECT name, tier::INT AS tier, round(score, 6) AS score FROM t WHERE tier IS NOT NULL ORDER BY tier, score DESC, name LIMIT 20""")
def search_unified_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "part").select(F.col("p_name").alias("name"))
    return repo.unified_symbols(s, "small bolt", 20, max_distance=5).withColumn("score", F.round("score", 6))


@query("""SELECT p_partkey AS page_id, p_type AS kind, p_name AS title, p_brand AS path, CASE WHEN p_name = 'small' THEN 100 WHEN starts_with(p_name, 'small') THEN 85 WHEN contains(p_name, 'small') THEN 70 WHEN contains(lower(p_type), 'small') OR contains(lower(p_brand), 'small') THEN 60 ELSE 40 END::INT AS points FROM part
    WHERE contains(p_name, 'small') OR contains(lower(p_type), 'small') OR contains(lower(p_brand), 'small') ORDER BY points DESC, title, page_id LIMIT 60""")
def projection_page_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return repo.search_pages(p.select(F.col("p_partkey").alias("page_id"), F.col("p_type").alias("kind"), F.col("p_name").alias("title"), F.col("p_brand").alias("path"), F.array("p_type", "p_brand").alias("keywords")), " Small ", 60)


@query("""WITH r AS (SELECT c_nationkey AS page_id, c_custkey AS other_id, ['reference', 'how_to', 'tutorial', 'explanation', 'faq'][(c_custkey % 5 + 1)::INT] AS kind, c_acctbal AS score, c_name AS title FROM customer),
    b AS (SELECT *, row_number() OVER (PARTITION BY page_id, kind ORDER BY score DESC, title, other_id) AS n FROM r QUALIFY n <= 3)
    SELECT page_id, kind, other_id, row_number() OVER (PARTITION BY page_id ORDER BY CASE kind WHEN 'reference' THEN 1 WHEN 'how_to' THEN 2 WHEN 'tutorial' THEN 3 WHEN 'explanation' THEN 4 ELSE 5 END, kind, n)::INT AS position FROM b""")
def projection_family_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    kinds = F.array(*[F.lit(k) for k in (*repo.FAMILIES, "faq")])
    related = c.select(F.col("c_nationkey").alias("page_id"), F.col("c_custkey").alias("other_id"), F.element_at(kinds, (F.col("c_custkey") % 5 + 1).cast("int")).alias("kind"), F.col("c_acctbal").alias("score"), F.col("c_name").alias("title"))
    return repo.family_context(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("page_id")), related, 3)


@query("""WITH g AS (SELECT c_mktsegment AS kind, 'k' || c_nationkey % 3 AS page_kind, c_custkey AS entity_id, floor(abs(c_acctbal) / 100)::BIGINT AS points FROM customer)
    SELECT kind, page_kind, entity_id, points, row_number() OVER (PARTITION BY kind, page_kind ORDER BY points DESC, entity_id)::INT AS position, count(*) OVER (PARTITION BY kind, page_kind) AS total FROM g QUALIFY position <= 5""")
def projection_planner_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    gaps = c.select(F.col("c_mktsegment").alias("kind"), F.concat(F.lit("k"), (F.col("c_nationkey") % 3).cast("string")).alias("page_kind"), F.col("c_custkey").alias("entity_id"), F.floor(F.abs("c_acctbal") / 100).alias("points"))
    return repo.planner_queue(gaps, 5)


_SECTIONS = """x AS (SELECT doc_id, 'line ' || line_no AS heading_path, greatest(CASE WHEN contains(lower(body), 'of the') THEN 0.72 ELSE 0 END, 0.40 * (contains(lower(body), 'of')::INT + contains(lower(body), 'the')::INT) / 2.0) AS s, (line_no % 7)::INT AS level
    FROM l WHERE len(list_filter(regexp_split_to_array(body, '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '')) >= 24),
    y AS (SELECT doc_id, max(score) AS best, sum(score) AS total FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, heading_path) AS r FROM (SELECT doc_id, heading_path, least(s + (6 - least(level, 6)) * 0.01, 1)::DOUBLE AS score FROM x WHERE s > 0)) WHERE r <= 3 GROUP BY doc_id)"""


@query(f"""WITH {_NOTES}, {_COUNTED}, {_LINES}, {_SECTIONS}, s AS (SELECT doc_id, ({_LEXICAL})::DOUBLE AS lexical, greatest(CASE WHEN contains(title, 'of the') OR contains(path, 'of the') THEN 0.82 ELSE 0 END, CASE WHEN pr > 0 THEN 0.5 + pr * 0.45 ELSE 0 END)::DOUBLE AS p, tag FROM h),
    j AS (SELECT s.*, coalesce(best, 0) AS best, coalesce(total, 0) AS total, (doc_id % 100) / 100.0::DOUBLE AS rank FROM s LEFT JOIN y USING (doc_id) WHERE tag IN ('en', 'de')),
    v AS (SELECT doc_id, rank, greatest(lexical * 0.62 + best * 0.23 + p * 0.15, lexical, least(best + 0.15 * (total - best), 1)) AS score FROM j)
    SELECT doc_id, round(score + (1 - score) * rank * 0.35, 9) AS score FROM v WHERE score > 0""")
def search_planned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filters, lexical, section and path scores, roll-up of sections, graph rank, order and limit of one request."""
    d, note = _notes(spark, sf_dir)
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "body"))
    sections = lines.select("doc_id", F.concat(F.lit("line "), (F.col("i") + 1).cast("string")).alias("heading_path"), ((F.col("i") + 1) % 7).alias("level"), "body")
    ranks = d.select("doc_id", ((F.col("doc_id") % 100) / 100.0).alias("rank"))
    notes = d.withColumns({"path": F.concat_ws("/", "source", F.col("doc_id").cast("string")), "stem": F.col("source")})
    return linkgraph.planned_search(notes, note, f"{QUERY} tag:(en,de)", None, sections, ranks).select("doc_id", F.round("score", 9).alias("score"))


@query(f"""WITH {_NOTES}, {_COUNTED} SELECT doc_id, round(greatest(CASE WHEN contains(title, 'of the') OR contains(path, 'of the') THEN 0.82 ELSE 0 END, CASE WHEN pr > 0 THEN 0.5 + pr * 0.45 ELSE 0 END)::DOUBLE, 6) AS score FROM h WHERE score > 0 ORDER BY score DESC, path, stem LIMIT 50""")
def search_planned_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, note = _notes(spark, sf_dir)
    notes = d.withColumns({"path": F.concat_ws("/", "source", F.col("doc_id").cast("string")), "stem": F.col("source")})
    return linkgraph.planned_search(notes, note, f"{QUERY} match:fuzzy limit:50", 20).select("doc_id", F.round("score", 6).alias("score"))


_LISTS = """v AS (SELECT p_name || ' ' || p_partkey AS name, p_retailprice / 2000 AS score FROM part ORDER BY score DESC, name LIMIT 60), k AS (SELECT p_name || ' ' || p_partkey AS name, p_size / 60.0::DOUBLE AS score FROM part ORDER BY score DESC, name LIMIT {n}),
    vr AS (SELECT *, row_number() OVER (ORDER BY score DESC, name) - 1 AS r FROM v), kr AS (SELECT *, row_number() OVER (ORDER BY score DESC, name) - 1 AS r FROM k)"""


def _lists(spark: SparkSession, sf_dir: str, n: int) -> tuple[DataFrame, DataFrame]:
    p = table(spark, sf_dir, "part").select(F.concat_ws(" ", "p_name", F.col("p_partkey").cast("string")).alias("name"), "p_retailprice", "p_size")
    return fusion.ranked(p.select("name", (F.col("p_retailprice") / 2000).alias("score")), "name", "score", 60), fusion.ranked(p.select("name", (F.col("p_size") / 60.0).alias("score")), "name", "score", n)


_BOOST = "0.3 * (contains(name, 'small')::INT + contains(name, 'bolt')::INT) + 0.5 * contains(name, 'small bolt')::INT"


@query(f"""WITH {_LISTS.format(n=2)} SELECT name, round(CASE WHEN vr.r IS NOT NULL THEN 1.6 / (10 + vr.r + 1) + 0.4 * vr.score ELSE 0 END + coalesce(1.5 * 0.4 / (10 + kr.r + 1) * CASE WHEN vr.r IS NULL THEN 0.5 ELSE 1 END, 0) + {_BOOST}, 6)::DOUBLE AS rrf FROM vr FULL JOIN kr USING (name)""")
def fusion_adaptive_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two keyword hits only: the vector list leads and its scores count themselves."""
    return tools.adaptive_rrf(*_lists(spark, sf_dir, 2), "small bolt").withColumn("rrf", F.round("rrf", 6))


@query("""SELECT p_partkey AS id, round(greatest(p_size / 50.0 - 0.3 * 0.1 * (contains(lower(p_type), 'promo')::INT + 1.2 * contains(lower(p_brand), 'promo')::INT + 0.5 * contains(p_name, 'promo')::INT + 0.3 * contains(lower(p_type), 'promo')::INT + contains(lower(p_type), 'bolt')::INT + 1.2 * contains(lower(p_brand), 'bolt')::INT + 0.5 * contains(p_name, 'bolt')::INT + 0.3 * contains(lower(p_type), 'bolt')::INT), 0)::DOUBLE, 6) AS distance FROM part""")
def vector_keyword_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (F.col("p_size") / 50.0).alias("d"), F.array("p_type").alias("routing_keywords"), F.array("p_brand").alias("intents"), F.col("p_name").alias("name"), F.col("p_type").alias("content"))
    return p.select("id", F.round(tools.boosted_distance(F.col("d"), ["Promo bolt"]), 6).alias("distance"))


@query("""WITH v AS (SELECT p_name || ' ' || p_partkey AS name, p_retailprice / 2000 AS score FROM part WHERE p_type = 'PROMO'), k AS (SELECT p_name || ' ' || p_partkey AS name, p_size / 60.0::DOUBLE AS score FROM part)
    SELECT 'semantic' AS intent, name, round(score, 6) AS score FROM (FROM v WHERE score >= 0.2 ORDER BY score DESC, name LIMIT 25) UNION ALL SELECT 'exact', name, round(score, 6) FROM (FROM k WHERE score >= 0.2 ORDER BY score DESC, name LIMIT 25)""")
def search_agentic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vector list alone within a category, and the keyword list alone."""
    p = table(spark, sf_dir, "part").select(F.concat_ws(" ", "p_name", F.col("p_partkey").cast("string")).alias("name"), F.col("p_type").alias("category"), "p_retailprice", "p_size")
    v, k = p.select("name", "category", (F.col("p_retailprice") / 2000).alias("score")), p.select("name", (F.col("p_size") / 60.0).alias("score"))
    parts = [tools.agentic_search(v, k, "bolt", kind, 25, category="PROMO").select(F.lit(kind).alias("intent"), "name", F.round("score", 6).alias("score")) for kind in ("semantic", "exact")]
    return parts[0].unionByName(parts[1])


@query("SELECT vec_id, label FROM embeddings WHERE vec_id IN (SELECT l_partkey FROM lineitem)")
def vector_fetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("vec_id"))
    return tools.embeddings_of(table(spark, sf_dir, "embeddings"), ids, "vec_id").select("vec_id", "label")


@query("SELECT c_custkey AS id, least(10 + ceil((least(greatest(abs(c_acctbal) / 800, 5), 10) - 5) / 5 * 10), 20)::INT AS n FROM customer")
def fusion_related_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), tools.related_limit(F.lit(10), F.abs("c_acctbal") / 800).alias("n"))


_REQUESTS = "CASE o_orderstatus WHEN 'F' THEN 'find' WHEN 'O' THEN 'refactor' ELSE 'commit' END || ' the ' || CASE left(o_orderpriority, 1) WHEN '1' THEN 'notes' WHEN '2' THEN 'function' WHEN '3' THEN 'readme' ELSE 'customer' END || ' of customer-' || o_custkey || ' and order ' || o_orderkey"


@query(f"""WITH q AS (SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 'search' WHEN 'O' THEN 'update' ELSE 'commit' END AS action, left(o_orderpriority, 1) AS p, o_orderstatus AS s, 1 + 1 + 1 + 1 + (length(o_custkey::VARCHAR) > 1)::INT + (length(o_orderkey::VARCHAR) > 1)::INT AS n FROM orders),
    t AS (SELECT *, CASE p WHEN '1' THEN 'knowledge' WHEN '2' THEN 'code' WHEN '3' THEN 'docs' ELSE CASE WHEN s = 'P' THEN 'git' END END AS target FROM q),
    w AS (SELECT *, target IN ('knowledge', 'docs') AS g, coalesce(target = 'code', false) AS c, n >= 4 AS broad FROM t)
    SELECT id, action, target, n::INT AS n_keywords, round(CASE WHEN action = 'search' AND NOT c THEN greatest(CASE WHEN g THEN 1.5 ELSE 1 END, 1.3) WHEN action = 'commit' AND NOT coalesce(g, false) THEN least(CASE WHEN c THEN 0.7 ELSE 1 END, 0.8) ELSE CASE WHEN g THEN 1.5 WHEN c THEN 0.7 ELSE 1 END END, 2)::DOUBLE AS proximity,
    round(CASE WHEN action = 'commit' THEN greatest(CASE WHEN c THEN 1.3 ELSE 1 END, 1.4) ELSE CASE WHEN c THEN 1.3 ELSE 1 END END, 2)::DOUBLE AS keyword, round(CASE WHEN g THEN 1.4 WHEN c THEN 0.8 ELSE 1 END * CASE WHEN broad THEN 1.1 ELSE 1 END, 2)::DOUBLE AS entity FROM w""")
def intent_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What requests ask for, and the fusion weights that follow."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.explode(F.array(intents.query_intent(F.expr(_REQUESTS)))).alias("i"))  # a generator's row is not computed anew for each use
    w = o.select("id", "i.action", "i.target", F.size("i.keywords").alias("n_keywords"), tools.fusion_weights(F.col("i.action"), F.col("i.target"), F.size("i.keywords")).alias("w"))
    return w.select("id", "action", "target", "n_keywords", "w.proximity", "w.keyword", "w.entity")


@query("""SELECT source, chunk_index, n FROM (SELECT p_type AS source, p_size AS chunk_index, count(*) AS n FROM part WHERE contains(p_name, 'bolt') OR contains(p_brand, 'bolt') OR contains(p_name, 'large') OR contains(p_brand, 'large') GROUP BY 1, 2)""")
def list_tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each source and chunk; ``n`` counts what each stands for."""
    p = table(spark, sf_dir, "part").select(F.col("p_type").alias("source"), F.col("p_size").alias("chunk_index"), F.col("p_name").alias("file_path"), F.col("p_brand").alias("metadata"))
    one = tools.listed(p, "bolt||large").select("source", "chunk_index")
    return one.join(p.where("file_path LIKE '%bolt%' OR file_path LIKE '%large%'"), ["source", "chunk_index"]).groupBy("source", "chunk_index").agg(F.count("*").alias("n"))


@query("""SELECT doc_id AS id, round(score, 6) AS score FROM (SELECT doc_id, (CASE WHEN contains(lower(text), 'the') THEN 0.5 ELSE 0 END + CASE WHEN doc_id::VARCHAR = '7' THEN 1 ELSE 0 END + CASE WHEN contains('7', source) THEN 0.1 ELSE 0 END)::DOUBLE AS score FROM documents) WHERE score > 0 ORDER BY score DESC, id LIMIT 40""")
def search_storage_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("category"), "text")
    return tools.storage_text_search(d, F.when(F.contains(F.lower("text"), F.lit("the")), 0.5).otherwise(0.0), "7", 40).withColumn("score", F.round("score", 6))


@query("""SELECT p_partkey AS id, 'brand,' || substr(p_brand, 7) || ',http,server,' || p_size || ',value' AS tokens, 'min' AS stem, 'javascript' AS language, (CASE WHEN p_type = 'PROMO' THEN 1 ELSE 3 END)::INT AS steps, round(1 / (1 + greatest(p_size - 10, 0)::DOUBLE), 6) AS score,
    CASE WHEN left(p_name, 1) = 's' AND levenshtein('small bolt', p_name) <= 3 THEN round(1 - levenshtein('small bolt', p_name) / greatest(10, length(p_name))::DOUBLE, 6) END AS near, false AS wild, round(CASE WHEN p_size > 5 THEN p_size / 50.0 + (1 - p_size / 50.0) * 0.5 * 0.35 ELSE p_size / 50.0 END::DOUBLE, 6) AS boosted FROM part""")
def scalar_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identifier parts, stems, languages, tree steps, distances, near names, literal LIKE, rank boost."""
    p = table(spark, sf_dir, "part")
    path = F.array(F.lit("a"), F.col("p_type"), F.lit("x"))
    score = F.col("p_size") / 50.0
    return p.select(
        F.col("p_partkey").alias("id"), F.array_join(sc.code_tokens(F.concat("p_brand", F.lit("HTTPServer"), "p_size", F.lit("Value"))), ",").alias("tokens"), intents.stem_of_source(F.concat(F.lit("src/"), "p_type", F.lit(".min.js"))).alias("stem"), sc.language_of_path(F.concat("p_name", F.lit(".JS"))).alias("language"),
        sc.tree_distance(path, F.array(F.lit("a"), F.lit("PROMO"))).alias("steps"), F.round(sc.distance_score((F.col("p_size") - 10).cast("double")), 6).alias("score"), F.round(sc.candidate_score(F.lit("small bolt"), F.col("p_name"), 1, 3), 6).alias("near"), sc.like_contains(F.col("p_name"), "%").alias("wild"),
        F.round(linkgraph.rank_boost(score, F.when(F.col("p_size") > 5, 0.5)), 6).alias("boosted"),
    )


@query("""WITH b AS (SELECT event_id AS id, greatest(least(value / 100 - 1, 1), -1) AS b FROM events), s AS (SELECT *, abs(b) AS x, CASE WHEN abs(b) >= 0.7 THEN 2 ELSE 1 END AS d FROM b)
    SELECT id, CASE WHEN b <= -0.25 THEN 20 + 3 * d WHEN b >= 0.35 THEN 20 - 2 * d ELSE 20 END::INT AS k1, CASE WHEN b <= -0.25 THEN 5 + d WHEN b >= 0.35 THEN 5 - d ELSE 5 END::INT AS k2, round(CASE WHEN b <= -0.25 THEN 0.3 - 0.06 * x WHEN b >= 0.35 THEN 0.3 + 0.05 * x ELSE 0.3 END, 6)::DOUBLE AS mix,
    round(CASE WHEN b <= -0.25 THEN greatest(0.1 - 0.05 * x, 0.01) WHEN b >= 0.35 THEN least(0.1 + 0.04 * x, 0.35) ELSE 0.1 END, 6)::DOUBLE AS min_score FROM s""")
def state_tuned_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), (F.col("value") / 100 - 1).alias("b"))
    plan = state.tuned_plan(F.col("b"), F.lit(20), F.lit(5), F.lit(0.3), F.lit(0.1), F.lit(1200))
    return e.select("id", plan.alias("p")).select("id", "p.k1", "p.k2", F.round("p.mix", 6).alias("mix"), F.round("p.min_score", 6).alias("min_score"))


@query("SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS r FROM documents) WHERE r = 1")
def search_best_per_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.best_per_key(table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars"), "source", F.desc("n_chars"), F.asc("doc_id")).select("source", "doc_id")
