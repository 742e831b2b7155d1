"""Search over typed entities (name, aliases, description, confidence) and their relations (src, dst, kind)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.functions import scalars as sc
from orrery.operators import graph
from orrery.sources.shared import cut

_PARTS = r"[\s._-]+"


def name_tokens(name: Column) -> Column:
    """Parts of two and more characters between spaces, dots, underscores and hyphens."""
    return F.filter(F.split(name, _PARTS), lambda t: F.length(t) >= 2)


def plain_name(name: Column) -> Column:
    """Lower case, trimmed, letters, digits and spaces only."""
    return F.regexp_replace(F.trim(F.lower(name)), r"[^\p{L}\p{N} ]", "")


def word_similarity(a: Column, b: Column) -> Column:
    """1 if equal, 0.9 if one contains the other, else the edit score and a fifth of the share of common words, to 1 at most."""
    a, b = plain_name(a), plain_name(b)
    x, y = F.array_distinct(sc.words(a)), F.array_distinct(sc.words(b))
    bonus = F.when((F.size(x) > 0) & (F.size(y) > 0), F.size(F.array_intersect(x, y)) / (F.size(x) + F.size(y)) * 0.2).otherwise(0.0)
    near = F.least(sc.edit_score(a, b) + bonus, F.lit(1.0))
    return F.when(a == b, 1.0).when(F.contains(a, b) | F.contains(b, a), 0.9).otherwise(near)


def entity_score(name: Column, aliases: Column, description: Column, confidence: Column, query: str) -> Column:
    """The best of the signals, times 0.8 + 0.2 confidence; null if none holds."""
    q = query.lower()
    tokens = [t for t in _split(q) if len(t) >= 2]
    n, al = F.lower(name), F.transform(F.coalesce(aliases, F.array().cast("array<string>")), F.lower)
    parts = name_tokens(n)
    matched = reduce(lambda a, b: a + b, [F.exists(parts, (lambda t: lambda p: F.contains(p, F.lit(t)) | F.contains(F.lit(t), p))(t)).cast("int") for t in tokens]) if tokens else F.lit(0)
    similar = word_similarity(F.lit(q), n)
    signals = [
        F.when(n == q, 1.0),
        F.when(F.array_contains(al, q), 0.95),
        F.when(matched == len(tokens), 0.85).otherwise(0.5 * matched / float(len(tokens))) if tokens else F.lit(0.0),
        F.when(F.contains(n, F.lit(q)) | F.contains(F.lit(q), n), 0.7),
        F.when(F.exists(al, lambda a: F.contains(a, F.lit(q)) | F.contains(F.lit(q), a)), 0.65),
        F.when(similar >= 0.75, 0.4 * similar),
        F.when(F.contains(F.lower(description), F.lit(q)), 0.3),
    ]
    best = F.greatest(*[F.coalesce(s, F.lit(0.0)) for s in signals])
    return F.when(best > 0, best * (0.8 + 0.2 * F.coalesce(confidence, F.lit(0.0))))


def _split(text: str) -> list[str]:
    for c in "._-":
        text = text.replace(c, " ")
    return text.split()


def search_entities(entities: DataFrame, query: str, limit: int) -> DataFrame:
    """The ``limit`` best entities; ties go to the smaller name."""
    score = entity_score(F.col("name"), F.col("aliases"), F.col("description"), F.col("confidence"), query)
    return entities.withColumn("score", score).where("score IS NOT NULL").orderBy(F.desc("score"), "name").limit(limit)


def relevance_seeds(entities: DataFrame, terms: list[str]) -> DataFrame:
    """(node, score) of entities that a term names, by its first rule that holds for the earliest term."""
    n = F.col("name")
    al = F.transform(F.coalesce(F.col("aliases"), F.array().cast("array<string>")), F.lower)
    steps = []
    for t in [t.lower() for t in terms if t]:
        steps += [F.when(n == t, 1.0), F.when(n == f"keyword:{t}", 0.8), F.when(F.array_contains(al, t), 0.85), F.when(F.contains(n, F.lit(t)), 0.5)]
    return entities.select(n.alias("node"), F.coalesce(*steps).alias("score")).where("score IS NOT NULL")


#: Decay by hop, bonus of containment, largest score.
HOP_DECAY = (1.0, 0.5, 0.25)
CONTAINS_BONUS = 0.2
MOST_RELEVANT = 2.0


def tool_relevance(entities: DataFrame, relations: DataFrame, terms: list[str], hops: int, limit: int) -> DataFrame:
    """(node, score): tools within ``hops`` - 1 steps of the entities that the terms name.

    Each seed has its own walk, in which a node counts once, at its first hop and with the best score that reaches
    it there.  A tool gains score times the hop's decay; a step carries the decayed score on, and 0.2 more along a
    ``Contains`` relation.  A tool's gains are added up, to 2 at most.
    """
    tools = entities.where("entity_type = 'Tool'").select(F.col("name").alias("node"))
    ends = relations.select("src", "dst", F.when(F.col("kind") == "Contains", CONTAINS_BONUS).otherwise(0.0).alias("bonus"))
    back = relations.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(0.0).alias("bonus"))
    edges = cut(ends.unionByName(back).groupBy("src", "dst").agg(F.max("bonus").alias("bonus")), "relations")
    front = relevance_seeds(entities, terms).select(F.col("node").alias("seed"), "node", "score")
    seen, gains = front.select("seed", "node"), []
    for hop in range(hops):
        decay = HOP_DECAY[min(hop, 2)]
        gains.append(front.select("node", (F.col("score") * decay).alias("gain")))
        if hop + 1 < hops:
            step = front.join(edges, F.col("node") == F.col("src")).select("seed", F.col("dst").alias("node"), (F.col("score") * decay + F.col("bonus")).alias("score"))
            front = cut(step.groupBy("seed", "node").agg(F.max("score").alias("score")).join(seen, ["seed", "node"], "left_anti"), "relevance")
            seen = seen.unionByName(front.select("seed", "node"))
    if not gains:
        return tools.select("node", F.lit(0.0).alias("score")).limit(0)
    total = reduce(lambda a, b: a.unionByName(b), gains).join(tools, "node", "left_semi").groupBy("node").agg(F.least(F.sum("gain"), F.lit(MOST_RELEVANT)).alias("score"))
    return total.orderBy(F.desc("score"), "node").limit(limit)


def multi_hop(relations: DataFrame, start: DataFrame, hops: int) -> DataFrame:
    """(node, distance) in either direction, the start included; nodes first met at the last hop are left out."""
    return graph.distances(relations, start, max(hops - 1, 0), "both") if hops > 0 else graph.distances(relations, start, 0, "both").limit(0)


def upserted_entities(entities: DataFrame, new: DataFrame) -> DataFrame:
    """Entities (name, ...) of which new ones replace those of the same name; of new ones with one name the last by id."""
    last = new.groupBy("name").agg(F.max_by(F.struct(*[c for c in new.columns if c != "name"]), "id").alias("r")).select("name", "r.*").select(*new.columns)
    return entities.join(last.select("name"), "name", "left_anti").select(*entities.columns).unionByName(last)


def added_relations(entities: DataFrame, relations: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Relations (src, dst, kind, ...) with the new ones whose ends are both known, each (src, dst, kind) once; and the new ones that are refused."""
    known = entities.select("name").distinct()
    ends = new.join(known.withColumnsRenamed({"name": "src"}).withColumn("_s", F.lit(True)), "src", "left").join(known.withColumnsRenamed({"name": "dst"}).withColumn("_d", F.lit(True)), "dst", "left")
    ok = F.col("_s").isNotNull() & F.col("_d").isNotNull()
    good, bad = ends.where(ok).select(*new.columns), ends.where(~ok).select(*new.columns)
    key = ["src", "dst", "kind"]
    fresh = good.dropDuplicates(key).join(relations.select(*key), key, "left_anti").select(*relations.columns)
    return relations.unionByName(fresh), bad
