"""Counts and roll-ups of entities, relations, references and scans; windows of ranked lists; audits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def type_counts(df: DataFrame, kind: str) -> DataFrame:
    """(kind, n) of each type, most frequent first."""
    return df.groupBy(F.col(kind).alias("kind")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "kind")


def connections(relations: DataFrame, top: int = 5) -> DataFrame:
    """(side, node, n): the nodes with most relations as source, as target and in all."""
    ends = relations.select(F.explode(F.array(*[F.struct(F.lit(s).alias("side"), F.col(c).alias("node")) for s, c in (("source", "src"), ("target", "dst"), ("any", "src"), ("any", "dst"))])).alias("e"))
    counts = ends.groupBy("e.side", "e.node").agg(F.count("*").alias("n"))
    sides = [counts.where(F.col("side") == s).orderBy(F.desc("n"), "node").limit(top) for s in ("source", "target", "any")]
    return sides[0].unionByName(sides[1]).unionByName(sides[2])


def coverage(pages: DataFrame, documented: DataFrame, key: str) -> DataFrame:
    """One row (total, covered, share): how many of the keys have documentation."""
    known = documented.select(key).distinct().withColumn("has", F.lit(1))
    out = pages.select(key).distinct().join(known, key, "left").agg(F.count("*").alias("total"), F.count("has").alias("covered"))
    return out.withColumn("share", F.when(F.col("total") > 0, F.col("covered") / F.col("total")).otherwise(0.0))


def overview(tables: dict[str, DataFrame]) -> DataFrame:
    """(name, n): rows of each table."""
    parts = [df.agg(F.lit(name).alias("name"), F.count("*").alias("n")) for name, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


#: Rows that are looked at, and the number of values from which on a sorted index is better than a bitmap.
SAMPLE_ROWS, BITMAP_BELOW = 2000, 100


def cardinality(df: DataFrame, columns: Sequence[str], rows: int | None = None) -> DataFrame:
    """(column, n_values, index): distinct non-empty values of each column, and the kind of index that suits.

    Over the whole table by default, by a sketch; with ``rows`` over so many first ones, exactly.
    """
    part = df.select(*columns) if rows is None else df.select(*columns).limit(rows)
    count = F.approx_count_distinct if rows is None else F.countDistinct
    texts = [F.nullif(F.col(c).cast("string"), F.lit("")) for c in columns]
    one = part.agg(*[count(t).alias(c) for t, c in zip(texts, columns, strict=True)])
    long = one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("n_values")) for c in columns])).alias("x"))
    return long.select("x.column", "x.n_values", F.when(F.col("x.n_values") < BITMAP_BELOW, "bitmap").otherwise("btree").alias("index"))


def reference_stats(refs: DataFrame) -> DataFrame:
    """(kind, n, total, names): references (name, address) by whether they have an address, all of them, distinct names."""
    kinds = refs.groupBy(F.when(F.col("address").isNotNull(), "addressed").otherwise("note").alias("kind")).agg(F.count("*").alias("n"))
    total = refs.agg(F.count("*").alias("total"), F.countDistinct("name").alias("names"))
    return kinds.crossJoin(F.broadcast(total)).orderBy(F.desc("n"), "kind")  # one row


def knowledge_stats(entries: DataFrame) -> DataFrame:
    """(category, n, total, tags, last): entries (category, tags, updated) by category, all of them, distinct tags whatever their case, the last change."""
    by = entries.groupBy("category").agg(F.count("*").alias("n"))
    tags = entries.select(F.explode("tags").alias("tag")).agg(F.countDistinct(F.lower("tag")).alias("tags"))
    total = entries.agg(F.count("*").alias("total"), F.max("updated").alias("last")).crossJoin(tags)
    return by.crossJoin(F.broadcast(total))  # one row


def deduped_relations(relations: DataFrame, order: Sequence[str | Column], keys: Sequence[str] = ("repo", "src", "dst", "kind")) -> DataFrame:
    """The first relation, by ``order``, of each repository, source, target and kind."""
    rest = [c for c in relations.columns if c not in keys]
    first = F.min_by(F.struct(*rest), F.struct(*order)).alias("first")
    return relations.groupBy(*keys).agg(first).select(*keys, *[f"first.{c}" for c in rest])


def retained_window(limit: int, multiplier: int, minimum: int) -> tuple[int, int]:
    """Rows that a ranked list keeps, and at how many it is cut."""
    keep = max(limit * multiplier, minimum)
    return keep, 2 * keep


def candidate_window(limit: int) -> int:
    return min(3 * limit, 96)


def table_of_contents(notes: DataFrame, limit: int) -> DataFrame:
    """The first notes by path and stem, one at least."""
    return notes.orderBy("path", "stem").limit(max(1, limit))


def observed_search(scanned: DataFrame, condition: Column, order: Sequence[Column], limit: int, multiplier: int = 2, minimum: int = 64) -> tuple[DataFrame, Observation, Observation]:
    """The best rows of a scan, and what was seen on the way: rows scanned and rows that matched, once the result has been read."""
    seen, matched = Observation("scanned"), Observation("matched")
    keep, _ = retained_window(limit, multiplier, minimum)
    rows = scanned.observe(seen, F.count(F.lit(1)).alias("rows")).where(condition).observe(matched, F.count(F.lit(1)).alias("rows"))
    return rows.orderBy(*order).limit(min(limit, keep)), seen, matched


def state_filters(notes: DataFrame, edges: DataFrame, key: str, orphan: bool = False, tagless: bool = False, missing_backlink: bool = False, mentions: Sequence[str] = (), text: str = "text", tags: str = "tags") -> DataFrame:
    """Notes without links, without tags, with a link that is not returned, or that name one of the phrases; all conditions hold."""
    from orrery.operators.hits import missing_backlinks, without_links

    out = notes
    if tagless:
        out = out.where(F.coalesce(F.size(tags), F.lit(0)) <= 0)
    if mentions:
        low = F.lower(F.coalesce(F.col(text), F.lit("")))
        hit = F.lit(False)
        for m in mentions:
            hit = hit | F.contains(low, F.lit(m.lower()))
        out = out.where(hit)
    if orphan:
        out = without_links(out, edges, key)
    if missing_backlink:
        out = out.join(missing_backlinks(edges).select(F.col("src").alias(key)).distinct(), key, "left_semi")
    return out


def audited_symbols(symbols: DataFrame, docs: DataFrame, links: DataFrame) -> DataFrame:
    """(symbol_id, state): ``verified`` if the title of a document that documents it holds its name or is held by it, else ``unverified``; ``unknown`` without documents.

    Documents (doc_id, title), links (doc_id, symbol_id).  A symbol's links are added up, so one with many is one row.
    """
    titled = links.select("doc_id", "symbol_id").join(docs.select("doc_id", F.lower("title").alias("title")), "doc_id", "left")
    named = titled.join(symbols.select("symbol_id", F.lower("name").alias("name")), "symbol_id")
    good = F.coalesce(F.contains("title", "name") | F.contains("name", "title"), F.lit(False))
    by = named.groupBy("symbol_id").agg(F.max(good).alias("good"))
    state = F.when(F.col("good"), "verified").when(F.col("good").isNotNull(), "unverified").otherwise("unknown")
    return symbols.select("symbol_id").join(by, "symbol_id", "left").select("symbol_id", state.alias("state"))


def resolved(nodes: DataFrame, address: str, fuzzy: bool = False) -> DataFrame:
    """The nodes (id, path, hash) that an address names: by id, else by path, else by hash; or, fuzzy, those whose path holds all its words."""
    if fuzzy:
        low = F.lower("path")
        hit = F.lit(True)
        for w in address.lower().split():
            hit = hit & F.contains(low, F.lit(w))
        return nodes.where(hit).orderBy(F.length("path"), "path")
    tier = F.when(F.col("id").cast("string") == address, 0).when(F.col("path") == address, 1).when(F.col("hash") == address, 2)
    found = nodes.withColumn("tier", tier).where("tier IS NOT NULL")
    return found.join(F.broadcast(found.agg(F.min("tier").alias("tier"))), "tier").drop("tier")  # one row


def structural_pairs(pairs: DataFrame) -> DataFrame:
    """Rows for an outside scorer: pairs (left_id, right_id, left_tags, right_tags) with their shared tags and the overlap."""
    shared, all_ = F.array_sort(F.array_intersect("left_tags", "right_tags")), F.size(F.array_union("left_tags", "right_tags"))
    return pairs.select("left_id", "right_id", shared.alias("shared"), F.when(all_ > 0, F.size(shared) / all_).otherwise(0.0).alias("overlap"))
