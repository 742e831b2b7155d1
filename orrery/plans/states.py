"""Keyed state, streams, markdown notes, guarded surfaces."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.functions import markdown as md
from orrery.functions import scalars as sc
from orrery.operators import state, surface
from orrery.plans.more import _EDGES, _edges
from orrery.plans.registry import query
from orrery.sources import tables
from orrery.sources.shared import new_path
from orrery.sources.tables import table
from orrery.streaming import changes, stateful, windows


@query("WITH o AS (SELECT user_id, list(least(value / 100, 1.0) ORDER BY event_id) AS r FROM events GROUP BY user_id) SELECT user_id, round(list_reduce(r, lambda q, x: least(greatest(q + 0.2 * (x - q), 0.0), 1.0), 0.5), 6) AS q, len(r) AS n FROM o")
def state_q_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = state.q_values(table(spark, sf_dir, "events"), "user_id", "event_id", F.least(F.col("value") / 100, F.lit(1.0)))
    return q.select("user_id", F.round("state", 6).alias("q"), "n")


@query("SELECT user_id, round(list_reduce(list(value ORDER BY event_id), lambda p, d: 0.85 * p + 0.15 * d, 0.0::DOUBLE), 4) AS bias FROM events GROUP BY user_id")
def state_feedback_bias(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.feedback_bias(table(spark, sf_dir, "events"), "user_id", "event_id", F.col("value")).select("user_id", F.round("state", 4).alias("bias"))


_TOUCHES = "WITH d AS (SELECT user_id, event_id, coalesce(greatest(epoch_us(ts) / 1e6 - lag(epoch_us(ts) / 1e6) OVER (PARTITION BY user_id ORDER BY event_id), 0), 0) / 86400.0 AS days FROM events) SELECT user_id, round(list_reduce(list(days::DOUBLE ORDER BY event_id), lambda s, x: least(greatest(s * exp(-0.05 * x) + 0.5 * ln(2), 1), 10), 5.0::DOUBLE), 6) AS saliency FROM d GROUP BY user_id"


@query(_TOUCHES)
def state_touches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.touches(table(spark, sf_dir, "events"), "user_id", "event_id", "ts").select("user_id", F.round("state", 6).alias("saliency"))


@query(_TOUCHES)
def stream_touches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same saliency from a stream with state, fed in four slices and started anew for each."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "ts")
    run = stateful.Replay(spark, "stream-touches", e.schema, lambda s: stateful.touched(s, "user_id", "event_id", "ts"))
    for part in stateful.sliced(e, "event_id", 4):
        run.feed(part)
    last = run.rows().groupBy("user_id").agg(F.max_by("saliency", "n").alias("saliency"))
    return last.select("user_id", F.round("saliency", 6).alias("saliency"))


@query("SELECT user_id, event_id, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS slot FROM (FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= 5)")
def stream_rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last five events of each user, as a list in the state of a stream that is fed in four slices."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value")
    run = stateful.Replay(spark, "stream-rings", e.schema, lambda s: stateful.rings(s, "user_id", "event_id", 5))
    for part in stateful.sliced(e, "event_id", 4):
        run.feed(part)
    rows = run.rows()
    latest = rows.groupBy("user_id").agg(F.max("seen").alias("seen"))
    return rows.join(latest, ["user_id", "seen"], "left_semi").select("user_id", "event_id", "event_type", "value", "slot")


@query("SELECT client_id, seq, segment, city, balance FROM (FROM client_changes WHERE client_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY client_id ORDER BY seq DESC NULLS LAST, change_id DESC NULLS LAST) = 1) WHERE op IS DISTINCT FROM 'D'")
def stream_followed_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table that follows a log of changes as they arrive, late and repeated ones among them, in four slices."""
    log = table(spark, sf_dir, "client_changes").select("change_id", "client_id", "seq", "op", "segment", "city", "balance")
    follower = changes.Follower(spark, new_path(spark, "changes"), "client_id", ["seq", "change_id"], F.col("op").eqNullSafe("D"))
    for part in stateful.sliced(log, "change_id", 4):
        follower.feed(part)
    return follower.read().select("client_id", "seq", "segment", "city", "balance")


@query(f"""WITH {_EDGES}, b AS (SELECT src, dst, 'out' AS d, 1.0::DOUBLE AS s FROM e UNION SELECT dst, src, 'in', 0.25 FROM e), r AS (SELECT *, row_number() OVER (PARTITION BY src, d ORDER BY dst) - 1 AS r FROM b), n AS (SELECT src, dst, max(s / (r + 1)) AS w FROM r WHERE r < 5 GROUP BY 1, 2),
    h1 AS (SELECT * FROM (SELECT src AS origin, dst AS node, w, row_number() OVER (PARTITION BY src ORDER BY w DESC, dst) AS k FROM n WHERE src IN ('s1', 's2') AND dst <> src) WHERE k <= 12),
    c2 AS (SELECT h1.origin, n.dst AS node, max(h1.w * 0.5 * n.w) AS w FROM h1 JOIN n ON h1.node = n.src WHERE n.dst <> h1.origin AND (h1.origin, n.dst) NOT IN (SELECT (origin, node) FROM h1) GROUP BY 1, 2),
    h2 AS (SELECT *, row_number() OVER (PARTITION BY origin ORDER BY w DESC, node) AS k FROM c2)
    SELECT origin, node, 1 AS hop, round(w, 8) AS weight FROM h1 UNION ALL SELECT origin, node, 2, round(w, 8) FROM h2 WHERE k + (SELECT count(*) FROM h1 WHERE h1.origin = h2.origin) <= 12""")
def state_coactivation(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = state.coactivation(_edges(spark, sf_dir), spark.createDataFrame([("s1",), ("s2",)], "node string"), 5, budget=12)
    return out.withColumn("weight", F.round("weight", 8))


@query("""WITH q AS (SELECT embedding AS q FROM embeddings WHERE vec_id = 0), s AS (SELECT vec_id, list_dot_product(embedding::DOUBLE[], q::DOUBLE[]) / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) / sqrt(list_dot_product(q::DOUBLE[], q::DOUBLE[])) AS s, (vec_id % 10) / 10.0::DOUBLE AS v FROM embeddings, q ORDER BY s DESC, vec_id LIMIT 20)
    SELECT vec_id, round(0.7 * s + 0.3 * v, 6) AS score FROM s ORDER BY 0.7 * s + 0.3 * v DESC, vec_id LIMIT 5""")
def state_two_phase_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    both = e.crossJoin(F.broadcast(e.where("vec_id = 0").select(F.col("embedding").alias("q"))))  # one row
    return state.two_phase_recall(both, "vec_id", sc.cosine(F.col("embedding"), F.col("q")), F.col("vec_id") % 10 / 10.0).select("vec_id", F.round("score", 6).alias("score"))


@query("""WITH e AS (SELECT user_id, event_type, count(*) AS n, count(*) FILTER (value > 20) AS s, count(*) FILTER (value < 5) AS f, avg(least(value / 50, 1)) AS q FROM events GROUP BY 1, 2), l AS (SELECT *, CASE WHEN s + f = 0 THEN (event_type = 'error')::INT ELSE f / (s + f)::DOUBLE END AS rate FROM e),
    u AS (SELECT *, 0.45 * n / (n + 3.0::DOUBLE) + 0.35 * (1 - rate) + 0.2 * (s + 1.0::DOUBLE) / (s + f + 2) AS ttl, 0.32 * q + 0.23 * (user_id % 5) / 4.0::DOUBLE + 0.25 * (user_id % 3) / 2.0::DOUBLE + 0.2 * q AS utility FROM l),
    v AS (SELECT *, CASE WHEN n >= 3 AND utility >= 0.78 AND rate <= 0.25 AND ttl >= 0.5 THEN 'promote' WHEN n >= 2 AND utility <= 0.32 AND rate >= 0.7 AND ttl <= 0.45 THEN 'obsolete' ELSE 'retain' END AS verdict FROM u)
    SELECT user_id, event_type, verdict, round(CASE verdict WHEN 'promote' THEN least(0.55 + (utility - 0.78) * 1.8 + (0.25 - rate) * 0.8, 1) WHEN 'obsolete' THEN least(0.55 + (0.32 - utility) * 1.8 + (rate - 0.7) * 0.8, 1) ELSE least(0.42 + least(abs(0.78 - utility), abs(utility - 0.32)) * 0.6, 0.85) END, 6) AS confidence FROM v""")
def state_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    e = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.count_if(v > 20).alias("s"), F.count_if(v < 5).alias("f"), F.avg(F.least(v / 50, F.lit(1.0))).alias("q"))
    u = F.col("user_id")
    book = state.ledger(e, F.col("n"), F.col("s"), F.col("f"), F.col("event_type"), F.col("q"), F.col("q"), u % 5 / 4.0, u % 3 / 2.0)
    return state.gate(book).select("user_id", "event_type", "verdict", F.round("confidence", 6).alias("confidence"))


@query("SELECT user_id, min(event_id) AS halt_at FROM (SELECT user_id, event_id, avg(value) OVER w AS m, count(*) OVER w AS c FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS 2 PRECEDING)) WHERE c = 3 AND m < 20 GROUP BY 1")
def state_halt_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.halt_points(table(spark, sf_dir, "events"), "user_id", "event_id", F.col("value"), 20.0)


@query("""SELECT strftime(s, '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT date_trunc('hour', ts) AS s, event_type, value FROM events)
    WHERE s + INTERVAL 1 HOUR <= (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 2 HOUR FROM events) GROUP BY 1, 2""")
def stream_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows that the watermark, two hours behind, has closed."""
    w = windows.windowed(windows.read_stream(spark, sf_dir, "events"), "ts", "1 hour", keys=("event_type",), watermark="2 hours")
    return windows.drain(w, "stream-tumbling").select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("""WITH a AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), b AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM a)
    SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM b GROUP BY user_id, s HAVING max(ts) + INTERVAL 2 HOUR <= (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 1 HOUR FROM events)""")
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = windows.sessions(windows.read_stream(spark, sf_dir, "events"), "ts", "2 hours", "user_id", watermark="1 hour")
    return windows.drain(s, "stream-sessions").select("user_id", F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys without repeats; files of one trigger are one batch."""
    s = windows.first_seen(windows.read_stream(spark, sf_dir, "events"), "ts", ["user_id", "event_type"], "1 hour")
    return windows.drain(s.select("user_id", "event_type"), "stream-first")


_NOTE = "# {id}\n:ID: n{id}\n\n{text}\n\n## Words\n- one\n- two\n\n```\n# no heading\n```\n"


def _notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _NOTE.replace("{id}", "%1$d").split("{text}")
    return table(spark, sf_dir, "benchmark").where("text IS NOT NULL").select("item_id", F.concat(F.format_string(a, "item_id"), F.col("text"), F.lit(b)).alias("note"))


@query("""SELECT item_id, item_id::VARCHAR AS heading_path, 1 AS level, 1 AS line_start, 'n' || item_id AS id, length(trim(':ID: n' || item_id || chr(10) || chr(10) || text, chr(32) || chr(10))) AS body_length FROM benchmark
    UNION ALL SELECT item_id, item_id || ' / Words', 2, 5 + len(string_split(text, chr(10))), NULL, length('- one' || chr(10) || '- two' || chr(10) || chr(10) || '```' || chr(10) || '# no heading' || chr(10) || '```') FROM benchmark""")
def markdown_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = md.section_table(_notes(spark, sf_dir), "item_id", "note")
    return s.select("item_id", "heading_path", "level", "line_start", F.col("attributes")["ID"].alias("id"), F.char_length("body").alias("body_length"))


@query("""SELECT item_id, heading_path, level, skeleton FROM (SELECT item_id, item_id || '/Words' AS heading_path, 2 AS level, '## Words' || chr(10) || '- one' || chr(10) || '- two' || chr(10) || chr(10) || '```' || chr(10) || '# no heading' || chr(10) || '```' AS skeleton FROM benchmark)""")
def markdown_work_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return md.work_table(_notes(spark, sf_dir), "item_id", "note").where("level = 2").select("item_id", "heading_path", "level", "skeleton")


@query()
def markdown_page_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thinned page trees; tests hold them against plain trees."""
    return md.page_index(_notes(spark, sf_dir), "item_id", "note", 40)


@query("SELECT DISTINCT page_id, trim(x) AS target FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"\\]|]+)\"', 1)) AS x FROM pages)")
def markdown_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of a page, written as wiki links, are found again."""
    links = F.regexp_extract_all("html", F.lit('href="([^"\\]|]+)"'), F.lit(1))
    p = table(spark, sf_dir, "pages").select("page_id", F.array_join(F.transform(links, lambda x: F.concat(F.lit("see [["), x, F.lit("|label]]"))), "\n").alias("t"))
    return p.select("page_id", F.explode(md.entity_refs(F.col("t"))).alias("target"))


@query("SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey")
def surface_read_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surface.run_read_only(spark, "SELECT o_custkey, count(*) AS n FROM {orders} WHERE o_orderstatus = 'F' GROUP BY o_custkey", orders=table(spark, sf_dir, "orders"))


@query("SELECT p_partkey, p_name FROM part WHERE p_type = 'PROMO' AND p_name LIKE '%ring%' ORDER BY p_name ASC, p_partkey DESC LIMIT 30")
def surface_authored(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = surface.Spec("part", ["p_partkey", "p_name"], 30, [("p_type", "eq", "PROMO"), ("p_name", "contains", "ring")], [("p_name", "asc"), ("p_partkey", "desc")])
    return surface.author({"part": table(spark, sf_dir, "part")}, spec, surface.Policy(needs_filter=frozenset({"part"})))


@surface.plugin("value_bands", "event_id bigint, band string")
def _value_bands(rows: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"event_id": rows["event_id"], "band": ["high" if v >= 50 else "low" for v in rows["value"]]})


@query("SELECT event_id, CASE WHEN value >= 50 THEN 'high' ELSE 'low' END AS band FROM events")
def surface_plugin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surface.run_plugin(table(spark, sf_dir, "events").select("event_id", "value"), "value_bands")


@query("SELECT DISTINCT split_part(split_part(url, '://', 2), '/', 1) AS namespace, sha256(html) AS content_hash FROM pages WHERE regexp_matches(lower(url), '^https?://') AND html IS NOT NULL")
def source_page_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Web pages once a host and content."""
    p = table(spark, sf_dir, "pages").where(sc.canonical_web_uri(F.col("url")).isNotNull() & F.col("html").isNotNull())
    host = F.substring_index(F.element_at(F.split("url", "://"), 2), "/", 1)
    return p.select(host.alias("namespace"), F.sha2("html", 256).alias("content_hash")).distinct()


@query("SELECT c_custkey::VARCHAR AS path, sha256(c_name) AS digest FROM customer")
def table_file_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The JSON map of hashes, read again."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("path"), F.sha2("c_name", 256).alias("digest"))
    return tables.file_hashes(c, "path", "digest").select(F.explode(F.from_json("hashes", "map<string,string>")).alias("path", "digest"))
