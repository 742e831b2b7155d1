"""Scores of notes and their sections for a text query, as single expressions: one scan, no shuffle."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.functions import scalars as sc
from orrery.operators.hits import hit_order, linked_by, tag_filter, under_path
from orrery.operators.requests import directives
from orrery.operators.search import ladder


@dataclass(frozen=True)
class Note:
    """Columns of a note; folded to lower case by ``folded``."""

    id: Column
    stem: Column
    title: Column
    path: Column
    tags: Column
    text: Column

    def folded(self) -> Note:
        return Note(F.lower(self.id), F.lower(self.stem), F.lower(self.title), F.lower(self.path), F.transform(self.tags, F.lower), F.lower(self.text))


def _any(*conditions: Column) -> Column:
    return reduce(lambda a, b: a | b, [F.coalesce(c, F.lit(False)) for c in conditions])


def _has(c: Column, q: str) -> Column:
    return F.coalesce(F.contains(c, F.lit(q)), F.lit(False))


def _tag_has(tags: Column, q: str) -> Column:
    return F.coalesce(F.exists(tags, lambda t: F.contains(t, F.lit(q))), F.lit(False))


def _unit(c: Column) -> Column:
    return F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))


def _ratio(text: Column, tokens: Sequence[str]) -> Column:
    if not tokens:
        return F.lit(0.0)
    return reduce(lambda a, b: a + b, [_has(text, t).cast("int") for t in tokens]) / float(len(tokens))


def document_score(note: Note, query: str, tokens: Sequence[str]) -> Column:
    """The best of equality, containment, phrase hits with their density, and the share of tokens."""
    if not query:
        return F.lit(0.0)
    equal = F.coalesce(ladder((_any(note.id == query, note.stem == query), 1.0), (_any(note.title == query), 0.95), (_any(F.array_contains(note.tags, query)), 0.85)), F.lit(0.0))
    names = _has(note.id, query) | _has(note.stem, query) | _has(note.path, query)
    held = names | _has(note.title, query) | _tag_has(note.tags, query) | _has(note.text, query)
    scores = [equal, F.when(held, 0.7).otherwise(0.0)]
    if len(tokens) >= 2:
        times = F.coalesce(sc.count_occurrences(note.text, query), F.lit(0))
        in_tags = F.coalesce(F.size(F.filter(note.tags, lambda t: F.contains(t, F.lit(query)))), F.lit(0))
        hits = 2 * names.cast("int") + 3 * _has(note.title, query).cast("int") + 2 * F.greatest(in_tags, F.lit(0)) + F.least(times, F.lit(6))
        words = F.size(sc.words(note.text))
        density = F.when((words > 0) & (times > 0), F.least(times * float(len(tokens)) / words, F.lit(0.08))).otherwise(0.0)
        scores.append(F.when(hits > 0, F.least(0.70 + F.least(hits, F.lit(8)) * 0.03 + density, F.lit(0.97))).otherwise(0.0))
    found = [_has(note.id, t) | _has(note.stem, t) | _has(note.title, t) | _has(note.path, t) | _tag_has(note.tags, t) | _has(note.text, t) for t in tokens if t]
    if found:
        ratio = reduce(lambda a, b: a + b, [f.cast("int") for f in found]) / float(len(tokens))
        base, part = (0.33, 0.42) if len(tokens) >= 2 else (0.45, 0.45)
        scores.append(F.when(ratio > 0, base + ratio * part).otherwise(0.0))
    return _unit(F.greatest(*scores))


def exact_score(note: Note, query: str) -> Column:
    if not query:
        return F.lit(0.0)
    steps = [(_any(note.id == query, note.stem == query), 1.0), (_any(note.title == query), 0.95), (_any(F.array_contains(note.tags, query)), 0.85), (_any(note.path == query), 0.8), (_has(note.text, query), 0.75)]
    return F.coalesce(ladder(*steps), F.lit(0.0))


def regex_score(note: Note, pattern: str) -> Column:
    """Path is tested before tags."""
    steps = [(_any(note.id.rlike(pattern), note.stem.rlike(pattern)), 1.0), (_any(note.title.rlike(pattern)), 0.95), (_any(note.path.rlike(pattern)), 0.8), (_any(F.exists(note.tags, lambda t: t.rlike(pattern))), 0.85), (_any(note.text.rlike(pattern)), 0.75)]
    return F.coalesce(ladder(*steps), F.lit(0.0))


def path_score(note: Note, query: str, tokens: Sequence[str]) -> Column:
    if not query:
        return F.lit(0.0)
    equal = F.coalesce(ladder((_any(note.path == query, note.id == query, note.stem == query), 1.0), (_any(note.title == query), 0.95)), F.lit(0.0))
    held = F.when(_has(note.path, query) | _has(note.id, query) | _has(note.stem, query) | _has(note.title, query), 0.82).otherwise(0.0)
    ratio = _ratio(F.concat_ws(" ", note.path, note.id, note.stem, note.title), tokens)
    return _unit(F.greatest(equal, held, F.when(ratio > 0, 0.50 + ratio * 0.45).otherwise(0.0)))


def section_score(heading: Column, body: Column, level: Column, query: str, tokens: Sequence[str]) -> Column:
    """Heading, body and token score with a bonus for shallow headings; 0 if nothing matches."""
    if not query:
        return F.lit(1.0)
    base = F.coalesce(ladder((_any((heading != "") & (heading == query)), 1.0), (_has(heading, query), 0.92), (_has(body, query), 0.72)), F.lit(0.0))
    score = F.greatest(base, _unit(_ratio(heading, tokens) * 0.75 + _ratio(body, tokens) * 0.40))
    depth = (6 - F.least(F.coalesce(level, F.lit(0)), F.lit(6))) * 0.01
    return F.when(score > 0, _unit(score + depth)).otherwise(0.0)


def section_candidates(sections: DataFrame, query: str, tokens: Sequence[str], cap: int = 3, min_words: int = 24, max_level: int = 6) -> DataFrame:
    """(doc_id, heading_path, score): the ``cap`` best sections of each note from (doc_id, heading_path, level, body)."""
    s = sections.where((F.col("level") == 0) | (F.col("level") <= max_level)).where(F.size(sc.words(F.col("body"))) >= min_words)
    s = s.withColumn("score", section_score(F.lower("heading_path"), F.lower("body"), F.col("level"), query, tokens)).where("score > 0")
    w = Window.partitionBy("doc_id").orderBy(F.desc("score"), "heading_path")
    return s.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= cap).select("doc_id", "heading_path", "score")


#: Weights of the lexical, section and path score, of the fuzzy path strategy, and of the graph rank.
TEXT_WEIGHTS = (0.62, 0.23, 0.15)
FUZZY_WEIGHTS = (0.70, 0.30)
RANK_BOOST = 0.35


def text_blend(lexical: Column, section: Column, path: Column) -> Column:
    a, b, c = TEXT_WEIGHTS
    return F.greatest(lexical * a + section * b + path * c, lexical)


def fuzzy_path_blend(path: Column, section: Column) -> Column:
    a, b = FUZZY_WEIGHTS
    return F.greatest(path * a + section * b, path, section)


def rank_boost(score: Column, rank: Column) -> Column:
    """s + (1 - s) rank 0.35 for positive scores."""
    return F.when(score > 0, score + (1 - score) * F.coalesce(rank, F.lit(0.0)) * RANK_BOOST).otherwise(score)


def provisional_boost(score: Column, boost: Column) -> Column:
    return score + (1 - score) * F.coalesce(boost, F.lit(0.0))


def with_provisional(hits: DataFrame, links: DataFrame, key: str = "doc_id") -> DataFrame:
    """Hits raised by suggested links (key, boost); suggestions without a hit come in with 0.25 + 0.5 boost."""
    best = links.groupBy(key).agg(F.max("boost").alias("boost"))
    joined = hits.select(key, "score").join(best, key, "full_outer")
    return joined.select(key, F.when(F.col("score").isNull(), 0.25 + 0.5 * F.col("boost")).otherwise(provisional_boost(F.col("score"), F.col("boost"))).alias("score"), F.col("score").isNull().alias("injected"))


def proximity_boost(hits: DataFrame, links: DataFrame, tags: DataFrame, link_boost: float, tag_boost: float) -> DataFrame:
    """Hits (stem, score) gain for each other hit that they link with (src, dst), either way, or share a tag (stem, tag) with.

    Hits are a result list, one row a stem.  Equal sets of tags are compared once, with their numbers of hits.
    """
    h = hits.select("stem", "score")
    ends = links.select("src", "dst").where("src != dst").union(links.select("dst", "src").where("src != dst")).distinct()
    linked = ends.join(h.select(F.col("stem").alias("src")), "src", "left_semi").join(h.select(F.col("stem").alias("dst")), "dst", "left_semi")
    n_links = linked.groupBy(F.col("src").alias("stem")).agg(F.count("*").alias("n_links"))
    sets = tags.join(h.select("stem"), "stem", "left_semi").groupBy("stem").agg(F.array_sort(F.collect_set("tag")).alias("tag_set"))
    sizes = sets.groupBy("tag_set").agg(F.count("*").alias("m"))
    a = sizes.select(F.col("tag_set").alias("mine"), F.explode("tag_set").alias("tag"))
    b = sizes.select(F.col("tag_set").alias("other"), "m", F.explode("tag_set").alias("tag"))
    near = a.join(b, "tag").select("mine", "other", "m").distinct().groupBy("mine").agg((F.sum("m") - 1).alias("n_tags"))
    n_tags = sets.join(near, F.col("tag_set") == F.col("mine")).select("stem", "n_tags")
    out = h.join(n_links, "stem", "left").join(n_tags, "stem", "left")
    return out.select("stem", (F.col("score") + link_boost * F.coalesce("n_links", F.lit(0)) + tag_boost * F.coalesce("n_tags", F.lit(0))).alias("score"))


#: The weight of a note's further sections.
SECTION_TAIL = 0.15
STRATEGIES = ("fts", "path_fuzzy", "exact", "re")


def with_scores(rows: DataFrame, scores: DataFrame, key: str, name: str = "rank") -> DataFrame:
    """Rows with their value of ``scores`` (key, name), 0 where there is none."""
    return rows.join(scores.select(key, name), key, "left").withColumn(name, F.coalesce(name, F.lit(0.0)))


def planned_search(notes: DataFrame, note: Note, text: str, limit: int | None, sections: DataFrame | None = None, ranks: DataFrame | None = None, boosts: DataFrame | None = None, edges: DataFrame | None = None, condition: Column | None = None, strategy: str | None = None) -> DataFrame:
    """(doc_id, score): a whole note search in one plan.

    ``text`` may hold directives: its limit and match strategy come before the arguments, its tag, path and sort
    directives filter and order, its linked_by and link_to directives filter by ``edges`` (src, dst).  ``fts`` blends lexical, section and path score, ``path_fuzzy`` path and section score,
    ``exact`` and ``re`` stand alone; without words every note that passes the filters scores 1.  The best sections
    (doc_id, heading_path, level, body) of a note add up and may lift it; with the first two strategies its graph rank
    (doc_id, rank) and then suggested links (doc_id, boost) raise it.  Zeros go; the order is by the sort directives,
    then score, path and stem; without a limit all notes come, unordered.  ``notes`` has doc_id, path, stem and what ``note`` refers to, folded unless the request
    minds case.
    """
    request = directives(text)
    limit = request.limit or limit
    kind = strategy or {"fuzzy": "path_fuzzy", "regex": "re"}.get(request.match or "", request.match) or "fts"
    if kind not in STRATEGIES:
        raise ValueError(f"unknown strategy {kind}")
    query = request.text if request.case_sensitive or kind == "re" else request.text.lower()
    words = list(dict.fromkeys(query.split()))
    rows = notes if condition is None else notes.where(condition)
    if tags := request.lists.get("tags"):
        rows = rows.where(tag_filter(note.tags, some=tags))
    if prefixes := request.lists.get("path"):
        rows = rows.where(reduce(lambda a, b: a | b, [under_path(F.col("path"), p) for p in prefixes]))
    if edges is not None:
        back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        for name, links in (("linked_by", edges), ("link_to", back)):
            if stems := request.lists.get(name):
                ends = notes.where(F.lower("stem").isin([x.lower() for x in stems])).select(F.col("doc_id").alias("node"))
                rows = linked_by(rows, links, "doc_id", ends)
    section = F.lit(0.0)
    if sections is not None and query:
        best = section_candidates(sections, query, words)
        sums = best.groupBy("doc_id").agg(F.max("score").alias("best_section"), F.sum("score").alias("all_sections"))
        rows = rows.join(sums, "doc_id", "left").withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("best_section", "all_sections")})
        section = F.col("best_section")
    if not query:
        score = F.lit(1.0)
    elif kind == "fts":
        score = text_blend(document_score(note, query, words), section, path_score(note, query, words))
    elif kind == "path_fuzzy":
        score = fuzzy_path_blend(path_score(note, query, words), section)
    else:
        score = exact_score(note, query) if kind == "exact" else regex_score(note, query)
    if sections is not None and query:
        score = F.greatest(score, _unit(section + SECTION_TAIL * (F.col("all_sections") - section)))
    scored = rows.withColumn("score", score).where("score > 0")
    if ranks is not None and query and kind in ("fts", "path_fuzzy"):
        scored = with_scores(scored, ranks, "doc_id").withColumn("score", rank_boost(F.col("score"), F.col("rank")))
    if boosts is not None:
        raised = with_provisional(scored.select("doc_id", "score"), boosts).select("doc_id", "score")
        scored = rows.select("doc_id", "path", "stem").join(raised, "doc_id")
    return (scored if limit is None else scored.orderBy(*hit_order(request.sort)).limit(limit)).select("doc_id", "score")
