"""Note search: lexical, path, regex and section scores, suggested links, proximity, completion, lines, entities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.functions import scalars as sc
from orrery.operators import entities, linkgraph, search
from orrery.plans.registry import query
from orrery.sources.tables import table

QUERY, TOKENS = "of the", ["of", "the"]
_NOTES = "n AS (SELECT doc_id, 'd' || doc_id AS id, coalesce(lower(source), '') AS stem, coalesce(lower(substr(text, 1, 40)), '') AS title, coalesce(lower(source), '') || '/' || doc_id AS path, coalesce(lower(lang), '') AS tag, coalesce(lower(text), '') AS t FROM documents)"


def _notes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, linkgraph.Note]:
    empty = F.lit("")
    d = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", empty).alias("text"), F.coalesce("source", empty).alias("source"), F.coalesce("lang", empty).alias("lang"))
    note = linkgraph.Note(F.concat(F.lit("d"), F.col("doc_id").cast("string")), F.col("source"), F.substring("text", 1, 40), F.concat_ws("/", "source", F.col("doc_id").cast("string")), F.array("lang"), F.col("text"))
    return d, note.folded()


_HELD = "(contains(id, '{0}') OR contains(stem, '{0}') OR contains(title, '{0}') OR contains(path, '{0}') OR contains(tag, '{0}') OR contains(t, '{0}'))"
_LEXICAL = f"""greatest(CASE WHEN id = 'of the' OR stem = 'of the' THEN 1.0 WHEN title = 'of the' THEN 0.95 WHEN tag = 'of the' THEN 0.85 ELSE 0 END, CASE WHEN {_HELD.format("of the")} THEN 0.7 ELSE 0 END,
    CASE WHEN hits > 0 THEN least(0.70 + least(hits, 8) * 0.03 + CASE WHEN words > 0 AND times > 0 THEN least(times * 2.0::DOUBLE / words, 0.08) ELSE 0 END, 0.97) ELSE 0 END,
    CASE WHEN m > 0 THEN 0.33 + m / 2.0::DOUBLE * 0.42 ELSE 0 END)"""
_COUNTED = f"""c AS (SELECT *, (length(t) - length(replace(t, 'of the', ''))) // 6 AS times, len(list_filter(regexp_split_to_array(t, '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '')) AS words,
    {_HELD.format("of")}::INT + {_HELD.format("the")}::INT AS m FROM n),
    h AS (SELECT *, 2 * (contains(id, 'of the') OR contains(stem, 'of the') OR contains(path, 'of the'))::INT + 3 * contains(title, 'of the')::INT + 2 * contains(tag, 'of the')::INT + least(times, 6) AS hits,
    (contains(path || ' ' || id || ' ' || stem || ' ' || title, 'of')::INT + contains(path || ' ' || id || ' ' || stem || ' ' || title, 'the')::INT) / 2.0::DOUBLE AS pr FROM c)"""


@query(f"""WITH {_NOTES}, {_COUNTED}, s AS (SELECT doc_id, {_LEXICAL} AS lexical, greatest(CASE WHEN contains(title, 'of the') OR contains(path, 'of the') THEN 0.82 ELSE 0 END, CASE WHEN pr > 0 THEN 0.5 + pr * 0.45 ELSE 0 END) AS path, CASE WHEN title = 'of the' THEN 0.95 WHEN contains(t, 'of the') THEN 0.75 ELSE 0 END AS exact FROM h)
    SELECT doc_id, round(lexical::DOUBLE, 6) AS lexical, round(path::DOUBLE, 6) AS path, exact::DOUBLE AS exact, round(greatest(lexical * 0.62 + path * 0.15, lexical)::DOUBLE, 6) AS blend FROM s WHERE lexical > 0""")
def search_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lexical, path and exact score of every note, and their blend without sections."""
    d, note = _notes(spark, sf_dir)
    s = d.select("doc_id", linkgraph.document_score(note, QUERY, TOKENS).alias("lexical"), linkgraph.path_score(note, QUERY, TOKENS).alias("path"), linkgraph.exact_score(note, QUERY).alias("exact")).where("lexical > 0")
    blend = linkgraph.text_blend(F.col("lexical"), F.lit(0.0), F.col("path"))
    return s.select("doc_id", F.round("lexical", 6).alias("lexical"), F.round("path", 6).alias("path"), "exact", F.round(blend, 6).alias("blend"))


@query(f"WITH {_NOTES} SELECT doc_id, CASE WHEN regexp_matches(id, '^the') OR regexp_matches(stem, '^the') THEN 1.0 WHEN regexp_matches(title, '^the') THEN 0.95 WHEN regexp_matches(path, '^the') THEN 0.8 WHEN regexp_matches(tag, '^the') THEN 0.85 WHEN regexp_matches(t, '^the') THEN 0.75 ELSE 0 END::DOUBLE AS score FROM n")
def search_notes_regex(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, note = _notes(spark, sf_dir)
    return d.select("doc_id", linkgraph.regex_score(note, "^the").alias("score"))


_LINES = "l AS (SELECT doc_id, line AS body, i AS line_no FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents WHERE text IS NOT NULL))"


@query(f"""WITH {_LINES}, s AS (SELECT doc_id, 'line ' || line_no AS heading_path, greatest(CASE WHEN contains(lower(body), 'of the') THEN 0.72 ELSE 0 END, 0.40 * (contains(lower(body), 'of')::INT + contains(lower(body), 'the')::INT) / 2.0) AS s, (line_no % 7)::INT AS level
    FROM l WHERE len(list_filter(regexp_split_to_array(body, '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '')) >= 24)
    SELECT doc_id, heading_path, score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, heading_path) AS r FROM (SELECT doc_id, heading_path, round(least(s + (6 - least(level, 6)) * 0.01, 1)::DOUBLE, 6) AS score FROM s WHERE s > 0)) WHERE r <= 3""")
def search_section_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three best lines of each document as sections."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "body"))
    s = d.select("doc_id", F.concat(F.lit("line "), (F.col("i") + 1).cast("string")).alias("heading_path"), ((F.col("i") + 1) % 7).alias("level"), "body")
    return linkgraph.section_candidates(s, QUERY, TOKENS).select("doc_id", "heading_path", F.round("score", 6).alias("score"))


@query("""WITH h AS (SELECT o_orderkey AS doc_id, o_totalprice / 1000000 AS score FROM orders WHERE o_orderstatus = 'F'), b AS (SELECT l_orderkey AS doc_id, max(l_discount) AS boost FROM lineitem GROUP BY 1)
    SELECT doc_id, round(CASE WHEN score IS NULL THEN 0.25 + 0.5 * boost ELSE score + (1 - score) * coalesce(boost, 0) END, 12) AS score, score IS NULL AS injected FROM h FULL JOIN b USING (doc_id)""")
def search_provisional(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("doc_id"), (F.col("o_totalprice") / 1000000).alias("score"))
    links = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_discount").alias("boost"))
    return linkgraph.with_provisional(hits, links).withColumn("score", F.round("score", 12))


@query("""WITH h AS (SELECT n_nationkey AS stem, n_nationkey / 25.0::DOUBLE AS score FROM nation), e AS (SELECT DISTINCT c_nationkey AS a, (c_custkey % 25)::INT AS b FROM customer), t AS (SELECT n_nationkey AS stem, 'r' || n_regionkey AS tag FROM nation UNION SELECT n_nationkey, substr(n_name, 1, 1) FROM nation)
    SELECT x.stem, round(x.score + sum(0.1::DOUBLE * (EXISTS (FROM e WHERE (a = x.stem AND b = y.stem) OR (a = y.stem AND b = x.stem)))::INT + 0.05::DOUBLE * (EXISTS (FROM t p JOIN t q ON p.tag = q.tag WHERE p.stem = x.stem AND q.stem = y.stem))::INT), 6) AS score FROM h x JOIN h y ON x.stem <> y.stem GROUP BY x.stem, x.score""")
def search_proximity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations gain by links and shared tags (region, first letter)."""
    n = table(spark, sf_dir, "nation")
    hits = n.select(F.col("n_nationkey").alias("stem"), (F.col("n_nationkey") / 25.0).alias("score"))
    links = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("src"), (F.col("c_custkey") % 25).cast("int").alias("dst"))
    tags = n.select(F.col("n_nationkey").alias("stem"), F.explode(F.array(F.concat(F.lit("r"), F.col("n_regionkey").cast("string")), F.substring("n_name", 1, 1))).alias("tag"))
    return linkgraph.proximity_boost(hits, links, tags, 0.1, 0.05).withColumn("score", F.round("score", 6))


@query("SELECT DISTINCT p_name AS suggestion, CASE WHEN p_type <> 'PROMO' THEN 'symbol' ELSE 'heading' END AS kind FROM part WHERE regexp_matches(lower(p_name), '(^|[^a-z0-9_])ri') ORDER BY CASE kind WHEN 'symbol' THEN 0 ELSE 1 END, suggestion LIMIT 20")
def search_autocomplete(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "part").select(F.col("p_name").alias("text"), F.when(F.col("p_type") == "PROMO", "markdown").otherwise("rust").alias("language"), F.lit("section").alias("node_kind"))
    return search.autocomplete(s, "RI", 20)


@query(f"WITH {_LINES} SELECT doc_id, line_no::INT AS line_number, score::DOUBLE AS score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, line_no) AS r FROM (SELECT doc_id, line_no, CASE WHEN contains(body, 'That') THEN 0.73 ELSE 0.72 END AS score FROM l WHERE contains(lower(body), 'that'))) WHERE r = 1")
def search_best_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.best_lines(table(spark, sf_dir, "documents"), "doc_id", "text", "That")


_PARTS = "string_split(lower(p_name), ' ')"


@query(f"""WITH s AS (SELECT *, lower(p_name) AS n, len(list_filter(['red', 'rings'], lambda q: len(list_filter({_PARTS}, lambda p: contains(p, q) OR contains(q, p))) > 0)) AS m, len(list_intersect({_PARTS}, ['red', 'rings'])) AS w FROM part),
    v AS (SELECT *, CASE WHEN n = 'red rings' THEN 1.0 WHEN contains(n, 'red rings') OR contains('red rings', n) THEN 0.9 ELSE least(1 - levenshtein(n, 'red rings') / greatest(length(n), 9)::DOUBLE + w / (len(list_distinct({_PARTS})) + 2.0::DOUBLE) * 0.2, 1) END::DOUBLE AS sim FROM s)
    SELECT name, description, round(best * (0.8 + 0.2 * c), 6) AS score FROM (SELECT p_name || ' ' || p_partkey AS name, p_type AS description, p_size / 50.0::DOUBLE AS c, greatest(CASE WHEN n = 'red rings' THEN 1.0 ELSE 0 END, CASE WHEN m = 2 THEN 0.85 ELSE 0.5::DOUBLE * m / 2 END, CASE WHEN contains(n, 'red rings') OR contains('red rings', n) THEN 0.7 ELSE 0 END, CASE WHEN sim >= 0.75 THEN 0.4 * sim ELSE 0 END) AS best FROM v) WHERE best > 0""")
def search_entity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all parts as entities."""
    p = table(spark, sf_dir, "part")
    score = entities.entity_score(F.col("p_name"), F.array("p_brand"), F.col("p_type"), F.col("p_size") / 50.0, "red rings")
    return p.select(F.concat_ws(" ", "p_name", F.col("p_partkey").cast("string")).alias("name"), F.col("p_type").alias("description"), F.round(score, 6).alias("score")).where("score IS NOT NULL")


@query("""WITH n AS (SELECT lower(n_name) AS node, CASE WHEN lower(n_name) = 'china' THEN 1.0 WHEN lower(r_name) = 'asia' THEN 0.85 WHEN contains(lower(n_name), 'china') OR contains(lower(n_name), 'asia') THEN 0.5 END::DOUBLE AS s, n_nationkey AS k FROM nation JOIN region ON n_regionkey = r_regionkey)
    SELECT s_name AS node, round(least((s + 0.2) * 0.5, 2), 6) AS score FROM supplier JOIN n ON s_nationkey = k WHERE s IS NOT NULL ORDER BY score DESC, node LIMIT 20""")
def search_tool_relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as tools that nations contain; a nation's region is its alias."""
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    s = table(spark, sf_dir, "supplier")
    found = n.select(F.lower("n_name").alias("name"), F.array("r_name").alias("aliases"), F.lit("Keyword").alias("entity_type")).unionByName(s.select(F.col("s_name").alias("name"), F.array().cast("array<string>").alias("aliases"), F.lit("Tool").alias("entity_type")))
    relations = n.join(s, F.col("n_nationkey") == F.col("s_nationkey")).select(F.lower("n_name").alias("src"), F.col("s_name").alias("dst"), F.lit("Contains").alias("kind"))
    return entities.tool_relevance(found, relations, ["china", "asia"], 2, 20).withColumn("score", F.round("score", 6))


@query("SELECT doc_id, array_to_string(list_filter([CASE WHEN regexp_matches(text, 'AKIA[0-9A-Z]{16}') THEN 'AWS Access Key' END, CASE WHEN regexp_matches(text, '(?i)sk_(test|live)_[0-9a-zA-Z]{24}') THEN 'Stripe Secret Key' END, CASE WHEN regexp_matches(text, 'xox[baprs]-([0-9a-zA-Z\\-]{10,48})') THEN 'Slack Token' END, CASE WHEN regexp_matches(text, '-----BEGIN [A-Z ]+ PRIVATE KEY-----') THEN 'PEM Private Key' END, CASE WHEN regexp_matches(text, '(?i)(api_key|access_token|secret)\\s*[:=]\\s*[\"''][A-Za-z0-9_=-]{16,}[\"'']') THEN 'Generic High-Entropy Secret' END], lambda x: x IS NOT NULL), ',') AS labels FROM documents WHERE labels <> ''")
def scalar_secret_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(sc.secret_labels(F.col("text")), ",").alias("labels")).where("labels != ''")


@query("SELECT page_id, trim(regexp_extract(html, '(?s)<title>(.*?)</title>', 1), chr(32) || chr(9) || chr(10) || chr(13)) AS title FROM pages WHERE regexp_matches(html, '(?s)<title>.*?</title>')")
def scalar_tag_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", sc.tag_value(F.col("html"), "title").alias("title")).where("title IS NOT NULL")
