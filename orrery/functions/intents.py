"""What a query asks for; digests, names and vectors of texts; byte-pair pieces."""

from __future__ import annotations

import base64
import json
from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType

#: Verbs by the action that they name, nouns by the target, targets by the action that implies them, stop words.
ACTIONS = {
    "search": "search find look lookup query recall retrieve fetch get locate", "create": "create make add write generate build scaffold init initialize new",
    "update": "update edit modify change refactor rename fix patch", "delete": "delete remove drop clean purge",
    "commit": "commit", "push": "push", "pull": "pull", "merge": "merge", "rebase": "rebase", "branch": "branch", "checkout": "checkout", "diff": "diff", "status": "status", "log": "log", "stash": "stash",
    "run": "run execute start launch", "test": "test", "lint": "lint", "format": "format", "analyze": "analyze inspect explain describe show", "list": "list", "count": "count",
    "index": "index reindex", "sync": "sync", "embed": "embed", "research": "research", "crawl": "crawl browse",
}
TARGETS = {
    "git": "git repo repository branch commit", "knowledge": "knowledge note notes graph", "memory": "memory", "code": "code function class module file files codebase source",
    "skill": "skill skills tool tools command commands", "web": "web internet url page site website", "database": "database db table vector index",
    "docs": "doc docs documentation readme spec reference", "test": "test tests testing",
}
IMPLIED = {"git": "commit push pull merge rebase branch checkout diff status log stash", "web": "crawl research", "database": "embed index"}
STOP_WORDS = (
    "a an the is are was were be been being have has had do does did will would shall should may might must can could to of in for on with at by from as into through during before after above"
    " below between out off over under again further then once here there when where why how all both each every few more most other some such no nor not only own same so than too very just also"
    " about up down if or and but because until while it its this that these those my your his her our their what which who whom me him them i you he she we they please want need help like using"
).split()


def _inverted(groups: dict[str, str]) -> dict[str, str]:
    return {w: k for k, words in groups.items() for w in words.split()}


def _lookup(groups: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in _inverted(groups).items() for x in kv])


def _once(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once, however often it is used, also inside of lambdas."""
    return F.get(F.transform(F.array(value), then), 0)


def query_intent(text: Column) -> Column:
    """A struct of action, target, keywords and context of a query.

    The first verb names the action, the first noun that is not that action's own word the target, or else the action
    implies one; keywords are the words of two and more bytes that are no stop words, context those of no action or target.
    """
    tokens = F.filter(F.split(F.lower(F.trim(text)), r"[\s._\-/,]+"), lambda t: t != "")
    actions, targets, implied = _lookup(ACTIONS), _lookup(TARGETS), _lookup(IMPLIED)
    stop = F.array(*[F.lit(w) for w in STOP_WORDS])
    first = lambda a: F.get(F.filter(a, lambda x: x.isNotNull()), 0)

    def target_of(tokens: Column, action: Column) -> Column:
        named = first(F.transform(tokens, lambda t: F.when(~t.eqNullSafe(action), F.try_element_at(targets, t))))
        return F.coalesce(named, F.try_element_at(implied, action))

    def found(action: Column, target: Column, keywords: Column) -> Column:
        context = F.filter(keywords, lambda t: ~F.coalesce(F.try_element_at(actions, t) == action, F.lit(False)) & ~F.coalesce(F.try_element_at(targets, t) == target, F.lit(False)))
        return F.struct(action.alias("action"), target.alias("target"), keywords.alias("keywords"), context.alias("context"))

    def of(tokens: Column) -> Column:
        keywords = F.filter(tokens, lambda t: (F.octet_length(t) >= 2) & ~F.array_contains(stop, t))
        action = first(F.transform(tokens, lambda t: F.try_element_at(actions, t)))
        return _once(action, lambda a: _once(target_of(tokens, a), lambda t: _once(keywords, lambda k: found(a, t, k))))

    return _once(tokens, of)


def stem_of_source(source: Column) -> Column:
    """The last but one of a file name's parts between dots; the source itself if there is one part only."""
    parts = F.split(F.substring_index(source, "/", -1), r"\.")
    return F.when(F.size(parts) > 1, F.get(parts, F.size(parts) - 2)).otherwise(source)


def fnv1a(data: bytes) -> int:
    """64-bit FNV-1a."""
    h = 0xCBF29CE484222325
    for b in data:
        h = ((h ^ b) * 0x100000001B3) & 0xFFFFFFFFFFFFFFFF
    return h


@F.pandas_udf(StringType())
def json_digest(value: pd.Series) -> pd.Series:
    """``fnv1a64:`` and the digest of a JSON object with sorted keys; ``fnv1a64:empty`` for an empty one or no object."""

    def one(text: str | None) -> str:
        try:
            parsed = json.loads(text) if text else None
        except ValueError:
            parsed = None
        if not isinstance(parsed, dict) or not parsed:
            return "fnv1a64:empty"
        return f"fnv1a64:{fnv1a(json.dumps(parsed, sort_keys=True, separators=(',', ':'), ensure_ascii=False).encode()):016x}"

    return value.map(one, na_action=None)


def intent_vector(text: Column, size: int) -> Column:
    """A unit vector of hash buckets, equal for equal texts."""
    raw = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.pmod(F.xxhash64(text, i), F.lit(1000)) / 1000.0)
    norm = F.sqrt(F.aggregate(raw, F.lit(0.0), lambda s, x: s + x * x))
    return F.when(norm > 0, F.transform(raw, lambda x: x / norm)).otherwise(raw)


def json_cells(*columns: str) -> Column:
    """A row's cells as one JSON object, nulls included."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


#: Fixed value: how a text falls into pieces before pairs are merged.
PIECES = r"(?i:'s|'t|'re|'ve|'m|'ll|'d)|[^\r\n\p{L}\p{N}]?\p{L}+|\p{N}{1,3}| ?[^\s\p{L}\p{N}]+[\r\n]*|\s*[\r\n]+|\s+(?!\S)|\s+"


@lru_cache(4)
def _encoding(ranks_path: str, pieces: str):
    import tiktoken

    with open(ranks_path, "rb") as f:  # a vocabulary that is shipped to the executors
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding(name="orrery", pat_str=pieces, mergeable_ranks=ranks, special_tokens={})


def token_count(text: Column, ranks_path: str, pieces: str = PIECES) -> Column:
    """Byte-pair tokens of a text by a rank file; null counts as empty."""

    @F.pandas_udf(IntegerType())
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        e = _encoding(ranks_path, pieces)
        for b in batches:
            yield b.map(lambda t: len(e.encode_ordinary(t or "")), na_action=None)

    return run(text)


def truncated(text: Column, ranks_path: str, n: int, pieces: str = PIECES) -> Column:
    """The text of the first ``n`` tokens, without a character that they cut."""

    @F.pandas_udf(StringType())
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        e = _encoding(ranks_path, pieces)
        for b in batches:
            yield b.map(lambda t: e.decode_bytes(e.encode_ordinary(t or "")[:n]).decode("utf-8", "ignore"), na_action=None)

    return run(text)


def token_chunks(text: Column, ranks_path: str, size: int, overlap: int = 0, pieces: str = PIECES) -> Column:
    """Texts of ``size`` tokens each, the last may be shorter, with ``overlap`` tokens in common; characters on a cut are left out."""
    if not 0 <= overlap < size:
        raise ValueError("the overlap must be smaller than the size")

    @F.pandas_udf(ArrayType(StringType()))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        e = _encoding(ranks_path, pieces)

        def one(t: str | None) -> list[str]:
            ids = e.encode_ordinary(t or "")
            starts = range(0, max(1, len(ids) - overlap), size - overlap) if ids else ()
            return [e.decode_bytes(ids[s : s + size]).decode("utf-8", "ignore") for s in starts]

        for b in batches:
            yield b.map(one, na_action=None)

    return run(text)
