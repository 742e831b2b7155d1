"""Scalar expressions: text, similarity, scores."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType


def tokenize(text: Column) -> Column:
    """Tokens of letters, digits, ``_`` and ``-``."""
    return F.filter(F.split(text, "[^A-Za-z0-9_-]+"), lambda t: t != "")


def words(text: Column) -> Column:
    """Parts between white space."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda t: t != "")


def code_tokens(text: Column) -> Column:
    """Lower-cased parts of identifiers, split at case and digit changes; parts of 80 bytes and more are left out."""
    parts = F.regexp_extract_all(text, F.lit(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+"), F.lit(0))
    return F.filter(F.transform(parts, F.lower), lambda t: F.octet_length(t) < 80)


def token_match_ratio(text: Column, tokens: Column) -> Column:
    """Share of ``tokens`` that occur in ``text``."""
    hit = F.size(F.filter(tokens, lambda t: F.contains(text, t)))
    return F.when(F.size(tokens) > 0, hit / F.size(tokens)).otherwise(0.0)


def count_occurrences(text: Column, needle: str) -> Column:
    """Non-overlapping occurrences of a string."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(needle), F.lit("")))) / len(needle)).cast("int")


def edit_score(a: Column, b: Column) -> Column:
    """1 - distance / longer length."""
    most = F.greatest(F.length(a), F.length(b))
    return F.when(most == 0, 1.0).otherwise(1.0 - F.levenshtein(a, b) / most)


def _osa(a: str, b: str) -> int:
    before, last = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            now.append(min(last[j] + 1, now[j - 1] + 1, last[j - 1] + (x != y)))
            if i > 1 and j > 1 and x == b[j - 2] and y == a[i - 2]:
                now[j] = min(now[j], before[j - 2] + 1)
        before, last = last, now
    return last[-1]


@F.pandas_udf(IntegerType())
def osa_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    """Edit distance in which swapping neighbours is one step."""
    return pd.Series([None if x is None or y is None else _osa(x, y) for x, y in zip(a, b, strict=True)], dtype="Int32")


def candidate_score(query: Column, candidate: Column, prefix: int = 1, max_distance: int = 2) -> Column:
    """Fuzzy score, null unless both share a prefix and lie within the distance."""
    near = (F.substring(query, 1, prefix) == F.substring(candidate, 1, prefix)) & (F.levenshtein(query, candidate) <= max_distance)
    return F.when(near, edit_score(query, candidate))


def name_similarity(a: Column, b: Column) -> Column:
    """1 if equal, 0.9 if one contains the other, else the edit score; case-insensitive."""
    x, y = F.lower(a), F.lower(b)
    return F.when(x == y, 1.0).when(F.contains(x, y) | F.contains(y, x), 0.9).otherwise(edit_score(x, y))


def word_chunks(text: Column, size: int, overlap: int) -> Column:
    """Word windows of ``size`` with ``overlap`` words in common."""
    words = F.filter(F.split(text, r"\s+"), lambda t: t != "")
    starts = F.sequence(F.lit(0), F.greatest(F.size(words) - overlap - 1, F.lit(0)), F.lit(size - overlap))
    return F.when(F.size(words) > 0, F.transform(starts, lambda i: F.array_join(F.slice(words, i + 1, size), " "))).otherwise(F.array().cast("array<string>"))


def snippet(text: Column, n: int) -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("..."))).otherwise(text)


#: File extensions and their languages.
LANGUAGES = {"rs": "rust", "py": "python", "jl": "julia", "mo": "modelica", "toml": "toml", "md": "markdown", "ts": "typescript", "js": "javascript"}


def language_of_path(path: Column) -> Column:
    ext = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    return F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])[ext]


def canonical_web_uri(url: Column, prefix: str = "page://") -> Column:
    """The page uri without its fragment under a prefix; null unless http(s)."""
    return F.when(F.lower(url).rlike("^https?://"), F.concat(F.lit(prefix), F.substring_index(url, "#", 1)))


def wikilinks(text: Column) -> Column:
    """Targets of [[target]] and [[target|label]]."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"\[\[([^\]|]+)(?:\|[^\]]*)?\]\]"), F.lit(1)), F.trim)


def tree_distance(a: Column, b: Column) -> Column:
    """Steps between two paths of a tree: what is left of each after the common prefix."""
    same = F.transform(F.arrays_zip(a.alias("a"), b.alias("b")), lambda x: F.coalesce(x["a"] == x["b"], F.lit(False)))
    common = F.coalesce(F.nullif(F.array_position(same, F.lit(False)), F.lit(0)) - 1, F.size(same))
    return (F.size(a) + F.size(b) - 2 * common).cast("int")


def dot(a: Column, b: Column) -> Column:
    z = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(z, F.lit(0.0), lambda s, v: s + F.coalesce(v, F.lit(0.0)))


def cosine(a: Column, b: Column) -> Column:
    """0 for a vector of norm 0."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(0.0)


def l2_score(a: Column, b: Column) -> Column:
    """1 / (1 + distance); the shorter vector is padded with zeros."""
    zero = F.lit(0.0)
    z = F.zip_with(a, b, lambda x, y: F.pow(F.coalesce(x.cast("double"), zero) - F.coalesce(y.cast("double"), zero), F.lit(2.0)))
    return 1.0 / (1.0 + F.sqrt(F.aggregate(z, zero, lambda s, v: s + v)))


def distance_score(d: Column) -> Column:
    return 1.0 / (1.0 + F.greatest(d, F.lit(0.0)))


def saliency(base: Column, days: Column, n: Column, decay: float = 0.05, alpha: float = 0.5) -> Column:
    """clamp(base e^(-decay days) + alpha ln(1 + n), 1, 10)."""
    return F.least(F.greatest(base * F.exp(-decay * days) + alpha * F.log1p(n), F.lit(1.0)), F.lit(10.0))


def q_update(rewards: Column, rate: float = 0.2, start: float = 0.5) -> Column:
    """q + rate (r - q) over an ordered array of rewards, within 0 and 1."""
    return F.aggregate(rewards, F.lit(start), lambda q, r: F.least(F.greatest(q + rate * (r - q), F.lit(0.0)), F.lit(1.0)))


def ewma(deltas: Column, keep: float = 0.85) -> Column:
    return F.aggregate(deltas, F.lit(0.0), lambda p, d: keep * p + (1 - keep) * d)


def toward_half(q: Column, hours: Column, decay: float) -> Column:
    return 0.5 + (q - 0.5) * F.pow(F.lit(decay), hours)


def utility(success: Column, n: Column, q: Column) -> Column:
    return (success + 1) / (n + 1) * q


#: Patterns of secrets with their names, in order.
SECRET_PATTERNS = (
    ("AWS Access Key", r"AKIA[0-9A-Z]{16}"),
    ("Stripe Secret Key", r"(?i)sk_(test|live)_[0-9a-zA-Z]{24}"),
    ("Slack Token", r"xox[baprs]-([0-9a-zA-Z\-]{10,48})"),
    ("PEM Private Key", r"-----BEGIN [A-Z ]+ PRIVATE KEY-----"),
    ("Generic High-Entropy Secret", r"(?i)(api_key|access_token|secret)\s*[:=]\s*[\"'][A-Za-z0-9_=-]{16,}[\"']"),
)


def secret_labels(text: Column) -> Column:
    """Names of the patterns that occur in a text."""
    return F.filter(F.array(*[F.when(text.rlike(p), name) for name, p in SECRET_PATTERNS]), lambda x: x.isNotNull())


def tag_value(text: Column, tag: str) -> Column:
    """What lies between the first ``<tag>`` and the next ``</tag>``, trimmed; null without both."""
    body = F.regexp_extract(text, f"(?s)<{tag}>(.*?)</{tag}>", 1)
    return F.when(text.rlike(f"(?s)<{tag}>.*?</{tag}>"), F.btrim(body, F.lit(" \t\n\r")))


def like_contains(text: Column, needle: str) -> Column:
    """Containment with the wildcards of LIKE taken literally."""
    return F.contains(text, F.lit(needle))
