"""Lists of hits: fusion with field boosts, filters, orders, tiers, confidence, definitions, imports."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.operators.fusion import rrf_term

#: Boosts of the name's tokens and phrase, of metadata fields by term with their cap, and of file discovery.
NAME_TOKEN, NAME_PHRASE = 0.3, 0.5
FIELD_BOOST = {"routing_keywords": 0.08, "intents": 0.09, "category": 0.05, "description": 0.03}
FIELD_CAP = 0.45
DISCOVERY_BOOST = 0.25
#: Weights if there are fewer than two keyword hits, and the share of the vector score added then.
SPARSE_WEIGHTS = (2.0, 0.1)
SPARSE_BONUS = 0.3


def _sum(parts: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, parts, F.lit(0.0))


def _hit(c: Column, points: float) -> Column:
    return F.when(c, points).otherwise(0.0)


def metadata_boost(terms: Sequence[str]) -> Column:
    """Points of each term of three and more characters in routing_keywords, intents, category and description."""
    any_holds = lambda c, t: F.exists(F.col(c), lambda x: F.contains(F.lower(x), F.lit(t)))
    parts = []
    for t in [t for t in terms if len(t.encode()) > 2]:
        parts += [_hit(any_holds(c, t), FIELD_BOOST[c]) for c in ("routing_keywords", "intents")]
        parts += [_hit(F.contains(F.lower(c), F.lit(t)), FIELD_BOOST[c]) for c in ("category", "description")]
    return F.least(_sum(parts), F.lit(FIELD_CAP))


def name_boost(name: Column, query: str) -> Column:
    """Points for each query word in a name, and for the whole query."""
    q = query.lower()
    words = sorted(set(q.split()))
    phrase = [_hit(F.contains(F.lower(name), F.lit(q)), NAME_PHRASE)] if q else []
    return _sum([_hit(F.contains(F.lower(name), F.lit(w)), NAME_TOKEN) for w in words] + phrase)


def weighted_rrf(vector: DataFrame, keyword: DataFrame, query: str, discovery: Column | None = None, k: float = 10.0, w_vector: float = 1.0, w_keyword: float = 1.5) -> DataFrame:
    """(name, rrf, vector_score, keyword_score): two ranked top-k lists fused, with boosts by name and by the keyword side's metadata.

    ``vector`` holds (name, score, rank), ``keyword`` those and the metadata columns.  With fewer than two keyword
    hits the vector side leads.  ``discovery`` marks keyword rows that a query for files prefers.
    """
    n = keyword.agg(F.count("*").alias("_n"))
    v = vector.select("name", F.col("score").alias("vector_score"), F.col("rank").alias("_v"))
    meta = keyword.withColumns({"_boost": metadata_boost(query.lower().split()), "_found": _hit(discovery, DISCOVERY_BOOST) if discovery is not None else F.lit(0.0)})
    w = meta.select("name", F.col("score").alias("keyword_score"), F.col("rank").alias("_k"), "_boost", "_found")
    both = v.join(w, "name", "full_outer").crossJoin(F.broadcast(n))  # one row
    sparse = F.col("_n") < 2
    zero = F.lit(0.0)
    side = lambda rank, a, b: F.when(sparse, a).otherwise(b) * F.coalesce(rrf_term(k, F.col(rank)), zero)
    fused = side("_v", SPARSE_WEIGHTS[0], w_vector) + side("_k", SPARSE_WEIGHTS[1], w_keyword) + F.when(sparse, SPARSE_BONUS * F.coalesce("vector_score", zero)).otherwise(0.0)
    total = fused + name_boost(F.col("name"), query) + F.coalesce("_boost", zero) + F.coalesce("_found", zero)
    return both.select("name", total.alias("rrf"), F.coalesce("vector_score", zero).alias("vector_score"), F.coalesce("keyword_score", zero).alias("keyword_score")).orderBy(F.desc("rrf"), "name")


def graph_confidence(hits: DataFrame, min_hits: int, min_top: float) -> DataFrame:
    """One row (confidence, level, sufficient, sources) of a list of hits (path, score)."""
    s = F.least(F.greatest("score", F.lit(0.0)), F.lit(1.0))
    path = F.lower(F.trim("path"))
    facts = hits.agg(F.count("*").alias("n"), F.coalesce(F.max(s), F.lit(0.0)).alias("top"), F.count_distinct(F.nullif(path, F.lit(""))).alias("sources"))
    near = F.least(F.col("top") / min_top, F.lit(1.0)) if min_top > 0 else F.col("top")
    value = F.when(F.col("n") > 0, F.least(0.45 * F.least(F.col("n") / float(max(min_hits, 1)), F.lit(1.0)) + 0.35 * F.col("top") + 0.2 * near, F.lit(1.0))).otherwise(0.0)
    level = F.when(value <= 0, "none").when(value < 0.35, "low").when(value < 0.7, "medium").otherwise("high")
    return facts.select(value.alias("confidence"), level.alias("level"), ((F.col("n") >= max(min_hits, 1)) & (F.col("top") >= min(max(min_top, 0.0), 1.0))).alias("sufficient"), "sources")


def topology_score(related: DataFrame, key: str, order: Sequence[Column], limit: int) -> DataFrame:
    """(key, topology): the ``limit`` first related scores of each key added up, within 0 and 1."""
    w = Window.partitionBy(key).orderBy(*order)
    best = related.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= max(limit, 1))
    return best.groupBy(key).agg(F.least(F.sum(F.greatest("score", F.lit(0.0))), F.lit(1.0)).alias("topology"))


def hit_order(terms: Sequence[tuple[str, bool]]) -> list[Column]:
    """Sort columns of (field, descending) terms; missing times come last ascending and first descending; ties by score, path, stem.

    ``random`` is a fixed order by the hash of stem and path.
    """
    out = []
    for name, down in terms or [("score", True)]:
        c = F.xxhash64("stem", "path") if name == "random" else F.col(name)
        out.append(c.desc_nulls_first() if down else c.asc_nulls_last())
    return [*out, F.desc("score"), F.asc("path"), F.asc("stem")]


def tag_filter(tags: Column, every: Sequence[str] = (), some: Sequence[str] = (), none: Sequence[str] = ()) -> Column:
    """All, any and none of tags, whatever their case."""
    low = F.transform(F.coalesce(tags, F.array().cast("array<string>")), F.lower)
    holds = lambda t: F.array_contains(low, t.lower())
    out = reduce(lambda a, b: a & b, [holds(t) for t in every], F.lit(True))
    if some:
        out = out & reduce(lambda a, b: a | b, [holds(t) for t in some])
    return reduce(lambda a, b: a & ~b, [holds(t) for t in none], out)


def under_path(path: Column, prefix: str) -> Column:
    """Equality or directory prefix, without case, outer slashes and backslashes; nothing is under an empty prefix."""
    p = prefix.strip().replace("\\", "/").strip("/").lower()
    norm = F.lower(F.btrim(F.replace(F.trim(path), F.lit("\\"), F.lit("/")), F.lit("/")))
    return ((norm == p) | norm.startswith(p + "/")) if p else F.lit(False)


def between_times(c: Column, after: str | None = None, before: str | None = None) -> Column:
    """Open bounds on a time."""
    bounds = ([c > F.lit(after).cast("timestamp")] if after else []) + ([c < F.lit(before).cast("timestamp")] if before else [])
    return reduce(lambda a, b: a & b, bounds, F.lit(True))


def without_links(notes: DataFrame, edges: DataFrame, key: str) -> DataFrame:
    """Notes without any link in or out."""
    return notes.join(edges.select(F.col("src").alias(key)), key, "left_anti").join(edges.select(F.col("dst").alias(key)), key, "left_anti")


def missing_backlinks(edges: DataFrame) -> DataFrame:
    """Links without one back."""
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return edges.select("src", "dst").distinct().join(back, ["src", "dst"], "left_anti")


def linked_by(notes: DataFrame, edges: DataFrame, key: str, sources: DataFrame, negate: bool = False) -> DataFrame:
    """Notes that any of ``sources`` (node) links to, or those that none does."""
    to = edges.join(sources.select(F.col("node").alias("src")), "src", "left_semi").select(F.col("dst").alias(key))
    return notes.join(to, key, "left_anti" if negate else "left_semi")


def ordered_union(limit: int, key: str, *tiers: DataFrame) -> DataFrame:
    """Rows of the tiers in turn, each key once with its first tier, until the limit."""
    all_ = reduce(lambda a, b: a.unionByName(b), [t.withColumn("tier", F.lit(i)) for i, t in enumerate(tiers)])
    return all_.groupBy(key).agg(F.min("tier").alias("tier")).orderBy("tier", key).limit(limit)


def repository_saliency(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, saliency): 2 in + out / 2 over relations between known nodes, over the largest."""
    known = edges.join(nodes.select(F.col("node").alias("src")), "src", "left_semi").join(nodes.select(F.col("node").alias("dst")), "dst", "left_semi")
    points = known.select(F.col("dst").alias("node"), F.lit(2.0).alias("p")).union(known.select("src", F.lit(0.5)))
    raw = nodes.select("node").distinct().join(points.groupBy("node").agg(F.sum("p").alias("p")), "node", "left").select("node", F.coalesce("p", F.lit(0.0)).alias("p"))
    most = raw.agg(F.max("p").alias("most"))
    return raw.crossJoin(F.broadcast(most)).select("node", F.when(F.col("most") > 0, F.col("p") / F.col("most")).otherwise(0.0).alias("saliency"))  # one row


def import_filters(text: str) -> tuple[str | None, str | None]:
    """(package, module) of ``package=...;module=...``; empty values and ``*`` are no filter."""
    found: dict[str, str] = {}
    for part in text.split(";"):
        key, eq, value = part.partition("=")
        if eq and value.strip() not in ("", "*"):
            found[key.strip()] = value.strip()
    return found.get("package"), found.get("module")


def import_rank(target: Column, source: Column, package: str | None, module: str | None) -> Column:
    """Bucket of an import, 0 the best; null if it does not match."""
    t, s = F.lower(target), F.lower(source)
    if package is None and module is None:
        return F.lit(0)
    if package is None:
        return F.when(s == module, 0).when(s.startswith(module), 1).when(F.contains(s, F.lit(module)), 2)
    if module is None:
        return F.when(t == package, 0).when(t.startswith(package), 1).when(F.contains(t, F.lit(package)), 3)
    equal, prefix = t == package, t.startswith(package)
    return F.when(equal, F.when(s == module, 0).when(s.startswith(module), 1)).when(prefix, F.when(s.startswith(module), 2)).when(F.contains(t, F.lit(package)), 3)


def definitions(symbols: DataFrame, name: str, languages: Sequence[str] | None = None, markdown: bool = False) -> DataFrame:
    """Symbols (name, path, language) of a name: equal ones (1.0), or without case (0.98) if there are none."""
    q = name.strip()
    s = symbols if markdown else symbols.where(F.coalesce(F.col("language") != "markdown", F.lit(True)))
    if languages is not None:
        s = s.where(F.col("language").isin(list(languages)))
    s = s.where(F.lower("name") == q.lower()).withColumn("score", F.when(F.col("name") == q, 1.0).otherwise(0.98))
    best = s.agg(F.max("score").alias("_best"))
    return s.crossJoin(F.broadcast(best)).where("score = _best").drop("_best")  # one row


def reason(vector: Column, keyword: Column, category: Column, intents: Column, confidence: Column, raw: Column, final: Column) -> Column:
    """``vector=0.123 | keyword=... | ...``; missing parts are left out, of the intents three are named; halves round to even."""
    num = lambda name, c: F.when(c.isNotNull(), F.format_string(f"{name}=%.3f", F.bround(c.cast("double"), 3)))
    named = F.when(F.size(intents) > 0, F.concat(F.lit("intents="), F.array_join(F.slice(intents, 1, 3), ",")))
    return F.concat_ws(" | ", num("vector", vector), num("keyword", keyword), F.when(category != "", F.concat(F.lit("category="), category)), named, F.concat(F.lit("confidence="), confidence), num("raw", raw), num("final", final))


def workers(pairs: DataFrame, order: Sequence[Column], max_workers: int, per_worker: int) -> DataFrame:
    """A result list of pairs dealt to workers in order, ``per_worker`` each; what exceeds them all is left for the next plan."""
    best = pairs.orderBy(*order).limit(max(max_workers, 1) * max(per_worker, 1))
    n = F.row_number().over(Window.orderBy(*order)) - 1  # a bounded list
    return best.withColumn("worker_id", F.floor(n / max(per_worker, 1)).cast("int"))


def vote_tally(votes: DataFrame, session: str, agent: str, choice: str, weight: str, order: str, quorum: float) -> DataFrame:
    """(session, choice, weight, agreed) of the leading choice; an agent's last vote counts, ties go to the smaller choice."""
    last = votes.groupBy(session, agent).agg(F.max_by(F.struct(choice, weight), order).alias("v"))
    sums = last.groupBy(session, F.col(f"v.{choice}").alias(choice)).agg(F.sum(f"v.{weight}").alias("weight"))
    best = sums.groupBy(session).agg(F.min(F.struct((-F.col("weight")).alias("w"), choice)).alias("b"), F.sum("weight").alias("total"))
    return best.select(session, f"b.{choice}", (-F.col("b.w")).alias("weight"), (-F.col("b.w") >= quorum * F.col("total")).alias("agreed"))


def decay_sweep(states: DataFrame, now: float, decay: float = 0.05) -> DataFrame:
    """States (node, saliency, last_seen in seconds) at ``now``: older ones decay and move on, rows without a node or score go."""
    days = (F.lit(now) - F.col("last_seen")) / 86400.0
    older = F.col("last_seen") < now
    fresh = F.least(F.greatest(F.col("saliency") * F.exp(-decay * days), F.lit(1.0)), F.lit(10.0))
    return states.where("node IS NOT NULL AND saliency IS NOT NULL AND last_seen IS NOT NULL").withColumns({"saliency": F.when(older, fresh).otherwise(F.col("saliency")), "last_seen": F.when(older, F.lit(now)).otherwise(F.col("last_seen"))})
