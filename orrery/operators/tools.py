"""Tool search: vector and keyword lists fused by intent, boosts, listings, weights by what a query asks for."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.functions import scalars as sc
from orrery.operators.fusion import ranked, rrf_term
from orrery.operators.hits import name_boost, weighted_rrf

#: Points by field, and their share that comes off a distance.
KEYWORD_POINT, KEYWORD_FIELDS, KEYWORD_SHARE = 0.1, {"routing_keywords": 1.0, "intents": 1.2, "name": 0.5, "content": 0.3}, 0.3
#: What a query for files says, and what a tool that finds files says.
DISCOVERY_QUERY = ("find", "list", "files", "file", "directory", "folder", "path", "glob", "extension")
DISCOVERY_TOOL = ("find", "file", "files", "directory", "path", "glob", "filename")
DISCOVERY_PARTS = (".py", ".rs")


def boosted_distance(distance: Column, keywords: Sequence[str]) -> Column:
    """The distance less a share of the points of each keyword's word in routing_keywords, intents, name and content; 0 at least."""
    words = [w for k in keywords for w in k.lower().split()]
    parts = []
    for w in words:
        for c, weight in KEYWORD_FIELDS.items():
            whole = F.col(c) if c in ("name", "content") else F.array_join(c, "\n")  # no word holds a line break
            hit = F.contains(F.lower(whole), F.lit(w))
            parts.append(F.when(hit, KEYWORD_POINT * weight).otherwise(0.0))
    bonus = reduce(lambda a, b: a + b, parts, F.lit(0.0)) * KEYWORD_SHARE
    return F.greatest(distance - bonus, F.lit(0.0)) if words else distance


def asks_for_files(query: str) -> bool:
    """Whether a query is about finding files."""
    q = query.lower()
    return any(w in DISCOVERY_QUERY or w.startswith("*.") for w in q.split()) or any(p in q for p in DISCOVERY_PARTS)


def finds_files() -> Column:
    """Whether a tool (name, category, description, routing_keywords, intents) finds files."""
    texts = [F.col("category"), F.col("description"), F.col("name"), F.array_join("routing_keywords", " "), F.array_join("intents", " ")]
    whole = F.lower(F.concat_ws("\n", *texts))
    return reduce(lambda a, b: a | b, [F.contains(whole, F.lit(t)) for t in DISCOVERY_TOOL])


def adaptive_rrf(vector: DataFrame, keyword: DataFrame, query: str, k: float = 10.0, w_vector: float = 1.0, w_keyword: float = 1.5) -> DataFrame:
    """(name, rrf): two ranked top-k lists (name, score, rank) fused by how many keyword hits there are.

    With confidence c = min(1, 0.2 hits) the vector side weighs (2 - c) and the keyword side c; below 0.5 vector scores
    count by 0.4 themselves; keyword rows without a vector row count half; names gain by the query's words.
    """
    n = keyword.agg(F.count("*").alias("n_hits"))
    v = vector.select("name", F.col("score").alias("v_score"), F.col("rank").alias("v_rank"))
    w = keyword.select("name", F.col("rank").alias("k_rank"))
    both = v.join(w, "name", "full_outer").crossJoin(F.broadcast(n))  # one row
    c = F.least(F.lit(1.0), 0.2 * F.col("n_hits"))
    of_vector = F.when(F.col("v_rank").isNotNull(), w_vector * (2 - c) * rrf_term(k, F.col("v_rank")) + F.when(c < 0.5, 0.4 * F.col("v_score")).otherwise(0.0)).otherwise(0.0)
    weight = w_keyword * c
    of_keyword = F.when(weight > 0.01, weight * rrf_term(k, F.col("k_rank")) * F.when(F.col("v_rank").isNull(), 0.5).otherwise(1.0))
    rows = both.where(F.col("v_rank").isNotNull() | (weight > 0.01))
    return rows.select("name", (of_vector + F.coalesce(of_keyword, F.lit(0.0)) + name_boost(F.col("name"), query)).alias("rrf")).orderBy(F.desc("rrf"), "name")


#: Rows and score of a search by default.
LIMIT, THRESHOLD = 10, 0.2


def search_tools(vector: DataFrame, keyword: DataFrame | None, query: str | None, limit: int = LIMIT, threshold: float = THRESHOLD, where: Column | None = None, window: int = 200) -> DataFrame:
    """(name, score): the vector list (name, score), fused with the keyword list (name, score and metadata) if there is a query text.

    The condition holds for the vector list; each list enters with its ``window`` best.  Scores under the threshold go.
    """
    v = ranked(vector if where is None else vector.where(where), "name", "score", window)
    if keyword is None or not query:
        found = v.select("name", "score")
    else:
        k = ranked(keyword, "name", "score", window)
        found = weighted_rrf(v, k, query, finds_files() if asks_for_files(query) else None).select("name", F.col("rrf").alias("score"))
    return found.where(F.col("score") >= threshold).orderBy(F.desc("score"), "name").limit(limit)


def agentic_search(vector: DataFrame, keyword: DataFrame, query: str | None, intent: str = "hybrid", limit: int = LIMIT, threshold: float = THRESHOLD, skill: str | None = None, category: str | None = None) -> DataFrame:
    """``exact``: the keyword list alone; ``semantic``: the vector list alone; else both.  Skill and category limit the vector list."""
    conditions = [F.col(c) == x for c, x in (("skill", skill), ("category", category)) if x]
    where = reduce(lambda a, b: a & b, conditions) if conditions else None
    kind = intent.strip().lower()
    if kind == "exact" and query:
        return keyword.select("name", "score").where(F.col("score") >= threshold).orderBy(F.desc("score"), "name").limit(limit)
    return search_tools(vector, None if kind == "semantic" else keyword, None if kind == "semantic" else query, limit, threshold, where)


def embeddings_of(vectors: DataFrame, ids: DataFrame | Sequence, key: str = "id") -> DataFrame:
    """The rows with these ids: a list becomes a pushed-down IN, a table a semi-join."""
    if isinstance(ids, DataFrame):
        return vectors.join(ids.select(key).distinct(), key, "left_semi")
    return vectors.where(F.col(key).isin(list(ids)))


def cut_list(df: DataFrame, score: str, key: str, top_k: int | None = None, min_score: float | None = None) -> DataFrame:
    """A reranked list from a score on, and its first rows."""
    out = df if min_score is None else df.where(F.col(score) >= min_score)
    return out if top_k is None else out.orderBy(F.desc(score), key).limit(top_k)


def related_limit(base: Column, saliency: Column, floor: float = 5.0, most: float = 10.0) -> Column:
    """One to two times the base limit, by how far saliency is from its base value to its maximum."""
    at_least = F.greatest(base, F.lit(1))
    signal = (F.least(F.greatest(saliency, F.lit(floor)), F.lit(most)) - floor) / (most - floor)
    return F.least(at_least + F.ceil(signal * at_least), 2 * at_least).cast("int")


def over_fetch(limit: int, filtered: bool) -> int:
    """Rows that an approximate search asks for before the filter."""
    return max(4 * limit, limit + 50) if filtered else max(2 * limit, limit + 10)


#: Targets and actions that lean to the graph or to vectors and keywords.
GRAPH_TARGETS, VECTOR_TARGETS = ("knowledge", "docs"), ("code", "database", "skill", "test")
GRAPH_ACTIONS, TOOL_ACTIONS = ("search", "research"), ("commit", "push", "pull", "merge", "rebase", "run", "test", "lint", "format")


def fusion_weights(action: Column, target: Column, n_keywords: Column) -> Column:
    """A struct of five weights by what a query asks for: proximity, entity, rerank, vector, keyword; all 1 if it says nothing."""
    graph, vectors = F.coalesce(target.isin(*GRAPH_TARGETS), F.lit(False)), F.coalesce(target.isin(*VECTOR_TARGETS), F.lit(False))
    seeks = F.coalesce(action.isin(*GRAPH_ACTIONS), F.lit(False)) & ~vectors
    acts = F.coalesce(action.isin(*TOOL_ACTIONS), F.lit(False)) & ~seeks
    pick = lambda g, v: F.when(graph, g).when(vectors, v).otherwise(1.0)
    proximity, entity, again, vector, keyword = pick(1.5, 0.7), pick(1.4, 0.8), pick(1.3, 0.9), pick(0.9, 1.2), pick(1.0, 1.3)
    proximity = F.when(seeks, F.greatest(proximity, F.lit(1.3))).when(acts & ~graph, F.least(proximity, F.lit(0.8))).otherwise(proximity)
    again = F.when(seeks, F.greatest(again, F.lit(1.2))).otherwise(again)
    vector = F.when(acts, F.greatest(vector, F.lit(1.1))).otherwise(vector)
    keyword = F.when(acts, F.greatest(keyword, F.lit(1.4))).otherwise(keyword)
    broad = F.when(n_keywords >= 4, 1.1).otherwise(1.0)
    values = {"proximity": proximity, "entity": entity * broad, "rerank": again * broad, "vector": vector, "keyword": keyword}
    return F.struct(*[F.round(v, 2).alias(k) for k, v in values.items()])


def listed(tools: DataFrame, pattern: str, columns: Sequence[str] = ("file_path", "metadata")) -> DataFrame:
    """Rows in which any part of ``a||b`` occurs, one for each source and chunk, in their order."""
    parts = [p.strip() for p in pattern.split("||") if p.strip()]
    hit = reduce(lambda a, b: a | b, [sc.like_contains(F.col(c), p) for p in parts for c in columns], F.lit(False))
    return tools.where(hit).dropDuplicates(["source", "chunk_index"]).orderBy("source", "chunk_index")


def storage_text_search(entries: DataFrame, text_score: Column, query: str, limit: int) -> DataFrame:
    """(id, score): a text score, 1 more for the entry named by the query, 0.1 more if the query names its category; zeros go."""
    score = text_score + F.when(F.col("id").cast("string") == query, 1.0).otherwise(0.0) + F.when(F.contains(F.lit(query.lower()), F.col("category")), 0.1).otherwise(0.0)
    return entries.select("id", score.alias("score")).where("score > 0").orderBy(F.desc("score"), "id").limit(limit)
