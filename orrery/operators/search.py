"""Corpus search: score ladders, best row of a key, top-k, payload fetch, BM25."""

from __future__ import annotations

import json
import re
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ladder(*steps: tuple[Column, float]) -> Column:
    """The score of the first step that holds; null if none does."""
    return F.coalesce(*[F.when(c, F.lit(float(s))) for c, s in steps])


def best_per_key(df: DataFrame, key: str, *order: Column) -> DataFrame:
    """First row of each key in the given order."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def top(df: DataFrame, k: int, *order: Column) -> DataFrame:
    return df.orderBy(*order).limit(k)


def hydrate(hits: DataFrame, payload: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Late materialisation: wide columns only for the hits (at most a top-k)."""
    if missing := [c for c in columns if c not in payload.columns]:
        raise ValueError(f"unknown columns: {missing}")
    return payload.select(key, *columns).join(hits, key)


def section_score(title: Column, section: Column, stem: Column, text: Column, query: str) -> Column:
    q = query.lower()
    return ladder((title == query, 1.0), (F.contains(F.lower(title), F.lit(q)), 0.95), (F.contains(F.lower(section), F.lit(q)), 0.90), (F.contains(F.lower(stem), F.lit(q)), 0.88), (F.contains(F.lower(text), F.lit(q)), 0.82))


def symbol_score(name: Column, signature: Column, owner: Column, query: str) -> Column:
    q, n = query.lower(), F.lower(name)
    return ladder((n == q, 1.0), (n.startswith(q), 0.97), (F.contains(n, F.lit(q)), 0.93), (F.contains(F.lower(signature), F.lit(q)), 0.86), (F.contains(F.lower(owner), F.lit(q)), 0.81))


def occurrence_score(line: Column, query: str) -> Column:
    return ladder((F.contains(line, F.lit(query)), 0.9), (F.contains(F.lower(line), F.lit(query.lower())), 0.82), (F.lit(True), 0.7))


def attachment_score(name: Column, path: Column, tokens: list[str], query: str) -> Column:
    q = query.lower()
    ratio = reduce(lambda a, b: a + b, [F.contains(F.lower(path), F.lit(t)).cast("int") for t in tokens]) / float(len(tokens))
    return 0.5 * (F.lower(name) == q).cast("int") + 0.3 * F.contains(F.lower(path), F.lit(q)).cast("int") + 0.2 * ratio


def roll_up(sections: DataFrame, doc: str, score: str) -> DataFrame:
    """max + 0.15 of the other scores, within 0 and 1."""
    s = F.max(score) + 0.15 * (F.sum(score) - F.max(score))
    return sections.groupBy(doc).agg(F.least(F.greatest(s, F.lit(0.0)), F.lit(1.0)).alias("doc_score"))


def bm25(docs: DataFrame, terms: list[str], key: str, text: str, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(key, score) of documents that hold a term, a run of a-z and 0-9.  Terms are counted row by row, so no token table is shuffled."""
    low = F.lower(F.coalesce(F.col(text), F.lit("")))

    def count(term: str) -> Column:
        if not re.fullmatch("[a-z0-9]+", term):
            return F.lit(0)
        return F.when(F.contains(low, F.lit(term)), F.regexp_count(low, F.lit(f"(?<![a-z0-9]){term}(?![a-z0-9])"))).otherwise(0)

    d = docs.select(key, F.regexp_count(low, F.lit("[a-z0-9]+")).alias("dl"), *[count(t).alias(f"tf{i}") for i, t in enumerate(terms)])
    facts = d.agg(F.count("*").alias("N"), F.avg("dl").alias("avgdl"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(terms))])
    d = d.where(reduce(lambda x, y: x | y, [F.col(f"tf{i}") > 0 for i in range(len(terms))])).crossJoin(F.broadcast(facts))  # one row

    def term(i: int) -> Column:
        idf = F.log(1 + (F.col("N") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5))
        tf = F.col(f"tf{i}")
        return idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))

    return d.select(key, reduce(lambda x, y: x + y, [term(i) for i in range(len(terms))]).alias("score"))


_OPS = {"$gt": lambda c, v: c > v, "$gte": lambda c, v: c >= v, "$lt": lambda c, v: c < v, "$lte": lambda c, v: c <= v, "$ne": lambda c, v: c != v}


def json_filter(spec: dict[str, Any]) -> Column:
    """Conjunction of a JSON predicate; of an operator object the first key counts, unknown operators are skipped."""
    out = F.lit(True)
    for name, v in spec.items():
        if isinstance(v, dict):
            op = next(iter(v), None)
            if op in _OPS:
                out = out & _OPS[op](F.col(name), F.lit(v[op]))
        else:
            out = out & (F.col(name) == F.lit(v))
    return out


def metadata_filter(metadata: Column, spec: dict[str, Any]) -> Column:
    """Equality on dotted paths of JSON metadata; a missing key is false."""
    return reduce(lambda a, b: a & b, [F.coalesce(F.get_json_object(metadata, f"$.{k}") == F.lit(v if isinstance(v, str) else json.dumps(v)), F.lit(False)) for k, v in spec.items()], F.lit(True))


#: A JSON predicate goes to the scan as a whole if it is on these columns only.
SCANNED = ("id", "content", "metadata", "_distance")


def split_filter(spec: str | dict[str, Any] | None, scanned: tuple[str, ...] = SCANNED, metadata: str = "metadata") -> tuple[Column | None, Column | None]:
    """(what the scan may take, what is applied to its rows) of a filter; None where there is nothing.

    JSON text or a dict goes to the scan if all its keys are ``scanned``, and is always applied to the metadata as well,
    where an operator object equals nothing.  Other text is a condition of SQL for the scan alone.  Blank text is none.
    """
    if isinstance(spec, str):
        text = spec.strip()
        if not text:
            return None, None
        try:
            spec = json.loads(text)
        except ValueError:
            return F.expr(text), None
        if not isinstance(spec, dict):
            return None, None
    if not spec:
        return None, None
    pushed = json_filter(spec) if all(k in scanned for k in spec) else None
    after = F.lit(False) if any(isinstance(v, (dict, list)) for v in spec.values()) else metadata_filter(F.col(metadata), spec)
    return pushed, after


def filtered(df: DataFrame, spec: str | dict[str, Any] | None, scanned: tuple[str, ...] = SCANNED, metadata: str = "metadata") -> DataFrame:
    """Rows that pass both sides of ``split_filter``.  What the scan may take stands first, so it reaches the files."""
    for part in split_filter(spec, scanned, metadata):
        df = df if part is None else df.where(part)
    return df


def column_mask(df: DataFrame, ids: list | None = None, id_col: str = "id", repo: str | None = None, path_contains: str | None = None, min_score: float | None = None) -> DataFrame:
    """Narrow-phase mask; a null score is 0."""
    if ids is not None:
        df = df.where(F.col(id_col).isin(ids))
    if repo is not None:
        df = df.where(F.col("repo") == repo)
    if path_contains is not None:
        df = df.where(F.contains("path", F.lit(path_contains)))
    if min_score is not None:
        df = df.where(F.coalesce("score", F.lit(0.0)) >= min_score)
    return df


def path_filter(path: Column, prefixes: list[str]) -> Column:
    """Equality or directory prefix."""
    return reduce(lambda a, b: a | b, [(path == p) | path.startswith(p.rstrip("/") + "/") for p in prefixes])


def graphql(df: DataFrame, select: list[str], where: dict[str, Any] | None = None, sort: list[tuple[str, bool]] | None = None, limit: int | None = None, page: int | None = None) -> DataFrame:
    """One-field table query: predicates AND-ed, nulls first in either direction, pages need a limit."""
    if page is not None and limit is None:
        raise ValueError("page needs limit")
    spec = {k: {f"${op}": x for op, x in v.items() if op != "eq"} or v.get("eq") if isinstance(v, dict) else v for k, v in sorted((where or {}).items())}
    out = df.where(json_filter(spec))
    if sort:
        out = out.orderBy(*[F.col(c).desc_nulls_first() if down else F.col(c).asc_nulls_first() for c, down in sort])
    if page is not None:
        out = out.offset((page - 1) * limit)
    if limit is not None:
        out = out.limit(limit)
    return out.select(*select)


def autocomplete(symbols: DataFrame, prefix: str, limit: int) -> DataFrame:
    """(suggestion, kind) from (text, language, node_kind): texts that start with a prefix or hold an identifier that does, each once."""
    p = prefix.lower()
    parts = F.split(F.lower("text"), r"[^a-z0-9_]")
    kind = F.when(F.coalesce(F.col("language") != "markdown", F.lit(True)), "symbol").when(F.col("node_kind").isin("property", "observation"), "metadata").otherwise("heading")
    hits = symbols.where(F.lower("text").startswith(p) | F.exists(parts, lambda t: t.startswith(p))).select(F.col("text").alias("suggestion"), kind.alias("kind"))
    rank = F.when(F.col("kind") == "symbol", 0).when(F.col("kind") == "heading", 1).otherwise(2)
    return hits.distinct().orderBy(rank, "suggestion").limit(limit)


def best_lines(docs: DataFrame, key: str, text: str, query: str) -> DataFrame:
    """(key, line_number, score): the best line of each text, equal case first, then the first line."""
    q = query.lower()
    lines = docs.select(key, F.posexplode(F.split(text, "\n")).alias("i", "line")).where(F.contains(F.lower("line"), F.lit(q)))
    s = F.when(F.contains("line", F.lit(query)), 0.73).otherwise(0.72)
    best = lines.groupBy(key).agg(F.max(F.struct(s.alias("score"), (-F.col("i")).alias("i"))).alias("b"))
    return best.select(key, (1 - F.col("b.i")).alias("line_number"), F.col("b.score").alias("score"))
