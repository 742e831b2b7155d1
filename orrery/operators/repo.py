"""Repository search: modules, symbols, examples and imports by match bucket; merged hit lists; documentation pages."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.functions import scalars as sc
from orrery.operators.hits import import_rank
from orrery.operators.search import ladder

#: The worst bucket of each kind of entity.
WORST = {"module": 3, "symbol": 7, "example": 10, "import": 4}


def _any_of(values: Column, test) -> Column:
    return F.exists(F.coalesce(values, F.array().cast("array<string>")), test)


def module_bucket(qualified: Column, path: Column, q: str) -> Column:
    """0 (equal) to 3 (in the path), null without a match; all arguments are lower-cased."""
    return ladder((qualified == q, 0), (qualified.startswith(q), 1), (F.contains(qualified, F.lit(q)), 2), (F.contains(path, F.lit(q)), 3))


def symbol_bucket(name: Column, qualified: Column, path: Column, signature: Column, q: str) -> Column:
    has = lambda c: F.contains(c, F.lit(q))
    return ladder((name == q, 0), (qualified == q, 1), (name.startswith(q), 2), (qualified.startswith(q), 3), (has(name), 4), (has(qualified), 5), (has(signature), 6), (has(path), 7))


def example_bucket(title: Column, path: Column, summary: Column, symbols: Column, modules: Column, q: str) -> Column:
    """The example's own title first, then related symbols and modules, path and summary in between."""
    has = lambda c: F.contains(c, F.lit(q))
    same, begins, holds = (lambda x: x == q), (lambda x: x.startswith(q)), (lambda x: F.contains(x, F.lit(q)))
    related = [_any_of(c, test) for test in (same, begins, holds) for c in (symbols, modules)]
    return ladder((title == q, 0), (title.startswith(q), 1), (has(title), 2), (related[0], 3), (related[1], 4), (related[2], 5), (related[3], 6), (has(path), 7), (has(summary), 8), (related[4], 9), (related[5], 10))


def rank_score(bucket: Column, worst: int) -> Column:
    """1 for bucket 0 down to 1 / (worst + 1); null without a bucket."""
    return F.when(bucket.isNotNull(), F.greatest((worst + 1 - bucket) / (worst + 1), F.lit(0.0)))


def entity_score(query: str, package: str | None = None, module: str | None = None) -> Column:
    """Score of an entity row by its kind, null without a match."""
    q, col = query.lower(), F.col
    low = lambda c: F.lower(F.coalesce(col(c), F.lit("")))
    folded = lambda c: F.transform(col(c), F.lower)
    buckets = {
        "module": module_bucket(low("qualified_name"), low("path"), q),
        "symbol": symbol_bucket(low("name"), low("qualified_name"), low("path"), low("signature"), q),
        "example": example_bucket(low("name"), low("path"), low("summary"), folded("related_symbols"), folded("related_modules"), q),
        "import": import_rank(low("qualified_name"), low("name"), package, module),
    }
    scored = F.lit(None).cast("double")
    for kind, bucket in buckets.items():
        scored = F.when(col("entity_kind") == kind, rank_score(bucket, WORST[kind])).otherwise(scored)
    return scored


def search_entities(entities: DataFrame, query: str, limit: int | None = None, languages: Sequence[str] = (), kinds: Sequence[str] = (), package: str | None = None, module: str | None = None) -> DataFrame:
    """The entities that match, with their score: that of the bucket, or their saliency if it is more, within 0 and 1.

    Best first, then by name, path and id; without a limit all of them, unordered.
    """
    rows = entities
    if languages:
        rows = rows.where(F.lower("language").isin([x.lower() for x in languages]))
    if kinds:
        low = [x.lower() for x in kinds]
        rows = rows.where(F.lower("entity_kind").isin(low) | F.coalesce(F.lower("symbol_kind").isin(low), F.lit(False)))
    found = rows.withColumn("match", entity_score(query, package, module)).where("match IS NOT NULL")
    score = F.least(F.greatest("match", F.coalesce("saliency_score", F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    found = found.withColumn("score", score).drop("match")
    return found if limit is None else found.orderBy(F.desc("score"), "name", "path", "id").limit(limit)


def merged_hits(sources: dict[str, DataFrame], limit: int) -> DataFrame:
    """(source, id, path, score): the best hits of several corpora or repositories, each a frame of (id, path, score).

    Every source is cut to its own best first, so that what meets is bounded by their number.
    """
    order = (F.desc("score"), F.asc("path"), F.asc("id"))
    parts = [df.select(F.lit(name).alias("source"), "id", "path", "score").orderBy(*order).limit(limit) for name, df in sources.items()]
    return reduce(DataFrame.unionByName, parts).orderBy(F.desc("score"), "path", "source", "id").limit(limit)


def intent_hits(sources: dict[str, DataFrame], limit: int, pending: Sequence[str] = (), skipped: Sequence[str] = ()) -> DataFrame:
    """``merged_hits``, with the repositories that are not searched yet or left out, and whether the list is partial."""
    names = lambda x: F.array(*[F.lit(v) for v in x]).cast("array<string>")
    return merged_hits(sources, limit).withColumns({"pending": names(pending), "skipped": names(skipped), "partial": F.lit(bool(pending or skipped))})


def unified_symbols(symbols: DataFrame, query: str, limit: int, source: str | None = None, max_distance: int = 2) -> DataFrame:
    """(name, tier, score): exact names, then near ones by edit distance, then those that hold the query, until the limit."""
    rows = symbols if source is None else symbols.where(F.col("source") == source)
    q, name = F.lit(query.lower()), F.lower("name")
    fuzzy = sc.candidate_score(q, name, 1, max_distance)
    tier = F.when(name == q, 0).when(fuzzy.isNotNull(), 1).when(F.contains(name, q), 2)
    found = rows.select("name", tier.alias("tier"), F.coalesce(F.when(name == q, 1.0), fuzzy, F.lit(0.0)).alias("score")).where("tier IS NOT NULL").distinct()
    return found.orderBy("tier", F.desc("score"), "name").limit(limit)


#: Points of a documentation page by the field that matches; base and range of a fuzzy match.
PAGE_POINTS = {"equal": 100, "prefix": 85, "title": 70, "keyword": 60, "path": 40}
FUZZY_POINTS = (45, 35)


def page_points(query: str) -> Column:
    """Points of a page (title, keywords, path) for a lower-cased query, null without a match."""
    q, title = query.strip().lower(), F.lower("title")
    p = PAGE_POINTS
    return ladder((title == q, p["equal"]), (title.startswith(q), p["prefix"]), (F.contains(title, F.lit(q)), p["title"]), (_any_of(F.col("keywords"), lambda k: F.contains(F.lower(k), F.lit(q))), p["keyword"]), (F.contains(F.lower("path"), F.lit(q)), p["path"]))


def search_pages(pages: DataFrame, query: str, limit: int, kind: str | None = None, max_distance: int = 2) -> DataFrame:
    """(page_id, kind, title, path, points): pages by title, keyword and path; only if none matches, by nearly equal titles.

    Best first, then by title and page_id.
    """
    if not query.strip() or limit <= 0:
        return pages.limit(0).select("page_id", "kind", "title", "path", F.lit(0).alias("points"))
    base, span = FUZZY_POINTS
    rows = pages if kind is None else pages.where(F.col("kind") == kind)
    near = sc.candidate_score(F.lit(query.strip().lower()), F.lower("title"), 1, max_distance)
    scored = rows.select("page_id", "kind", "title", "path", page_points(query).cast("int").alias("direct"), F.floor(base + span * near).cast("int").alias("near"))
    found = scored.where("direct IS NOT NULL OR near IS NOT NULL")
    any_direct = found.agg(F.coalesce(F.max(F.col("direct").isNotNull()), F.lit(False)).alias("any_direct"))  # one row
    points = F.when(F.col("any_direct"), F.col("direct")).otherwise(F.col("near"))
    kept = found.crossJoin(F.broadcast(any_direct)).withColumn("points", points).where("points IS NOT NULL")
    return kept.select("page_id", "kind", "title", "path", "points").orderBy(F.desc("points"), "title", "page_id").limit(limit)


#: The order in which the families of related pages are shown.
FAMILIES = ("reference", "how_to", "tutorial", "explanation")


def family_context(hits: DataFrame, related: DataFrame, per_kind: int) -> DataFrame:
    """(page_id, kind, other_id, position): the best related pages (page_id, other_id, kind, score, title) of each hit (page_id), by family.

    Each hit's list is cut per family before families are put in order; other kinds come last.
    """
    rank = F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(k) for k in FAMILIES]), F.col("kind")), F.lit(0)), F.lit(len(FAMILIES) + 1))
    w = Window.partitionBy("page_id", "kind").orderBy(F.desc("score"), "title", "other_id")
    best = related.join(hits.select("page_id"), "page_id", "left_semi").withColumn("n", F.row_number().over(w)).where(F.col("n") <= per_kind)
    order = Window.partitionBy("page_id").orderBy(rank, "kind", "n")
    return best.withColumn("position", F.row_number().over(order)).select("page_id", "kind", "other_id", "position")


def planner_queue(gaps: DataFrame, per_group: int) -> DataFrame:
    """(kind, page_kind, entity_id, points, position, total): the first gaps of each kind and page family, and how many it has.

    Totals are added up before, so a large group is one row there; its gaps are cut by their rank.
    """
    total = gaps.groupBy("kind", "page_kind").agg(F.count("*").alias("total"))
    w = Window.partitionBy("kind", "page_kind").orderBy(F.desc("points"), "entity_id")
    first = gaps.withColumn("position", F.row_number().over(w)).where(F.col("position") <= per_group)
    return first.join(F.broadcast(total), ["kind", "page_kind"]).select("kind", "page_kind", "entity_id", "points", "position", "total")  # kinds x families rows
