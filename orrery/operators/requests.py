"""Request texts: search directives and one-field table queries, parsed on the driver into DataFrame calls."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame

from orrery.operators.search import graphql

_WORD = re.compile(r'(-?[A-Za-z_]+):("[^"]*"|\([^)]*\)|\S+)|"[^"]*"|\S+')
#: Other names of directives.
ALIASES = {"top": "limit", "n": "limit", "k": "limit", "q": "query", "strategy": "match", "match_strategy": "match", "case_sensitive": "case", "tag": "tags", "to": "link_to", "from": "linked_by"}
KNOWN = frozenset({"limit", "query", "match", "case", "sort", "scope", "tags", "link_to", "linked_by", "related", "path", "id"})


@dataclass
class Request:
    text: str = ""
    limit: int | None = None
    match: str | None = None
    case_sensitive: bool = False
    sort: list[tuple[str, bool]] = field(default_factory=list)
    lists: dict[str, list[str]] = field(default_factory=dict)


def _values(raw: str) -> list[str]:
    inner = raw[1:-1] if raw[:1] in '("' and raw[-1:] in ')"' else raw
    return [v.strip().strip("\"'") for v in re.split(r"[,|]", inner) if v.strip()]


def directives(text: str) -> Request:
    """``limit:5 tag:(a,b) sort:-score words``; unknown directives and bad limits stay words or are skipped."""
    out, words = Request(), []
    for m in _WORD.finditer(text):
        name = ALIASES.get((m[1] or "").lower(), (m[1] or "").lower())
        if name not in KNOWN:
            words.append(m[0].strip('"'))
        elif name == "limit":
            out.limit = int(m[2]) if m[2].isdigit() and int(m[2]) > 0 else out.limit
        elif name == "query":
            words += _values(m[2])
        elif name == "match":
            out.match = m[2].lower()
        elif name == "case":
            out.case_sensitive = m[2].lower() in ("1", "true", "yes", "on")
        elif name == "sort":
            out.sort += [(v.lstrip("-+").split("_")[0] if v.endswith(("_asc", "_desc")) else v.lstrip("-+"), v.startswith("-") or v.endswith("_desc")) for v in _values(m[2])]
        else:
            out.lists.setdefault(name, []).extend(_values(m[2]))
    out.text = " ".join(words)
    return out


_TOKEN = re.compile(r'\s*(?:(?P<str>"(?:[^"\\]|\\.)*")|(?P<num>-?\d+(?:\.\d+)?)|(?P<name>[A-Za-z_]\w*)|(?P<sym>[{}()\[\]:,]))')


class _Reader:
    def __init__(self, text: str) -> None:
        self.items: list[tuple[str, str]] = []
        at, text = 0, text.rstrip()
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise ValueError(f"unexpected text at {at}")
            self.items.append((m.lastgroup or "", m[m.lastgroup or 0]))
            at = m.end()
        self.i = 0

    def peek(self) -> str:
        return self.items[self.i][1] if self.i < len(self.items) else ""

    def take(self, want: str | None = None) -> tuple[str, str]:
        if self.i >= len(self.items) or (want is not None and self.items[self.i][1] != want):
            raise ValueError(f"expected {want or 'more'}, found {self.peek() or 'the end'}")
        self.i += 1
        return self.items[self.i - 1]

    def name(self) -> str:
        kind, v = self.take()
        if kind != "name":
            raise ValueError(f"expected a name, found {v}")
        return v

    def value(self) -> Any:
        kind, v = self.take()
        if v == "{":
            return self.pairs("}")
        if v == "[":
            out = []
            while self.peek() != "]":
                out.append(self.value())
                if self.peek() == ",":
                    self.take()
            self.take("]")
            return out
        if kind == "str":
            return re.sub(r"\\(.)", r"\1", v[1:-1])
        if kind == "num":
            return float(v) if "." in v else int(v)
        if kind == "name":
            return {"true": True, "false": False, "null": None}.get(v, v)
        raise ValueError(f"expected a value, found {v}")

    def pairs(self, end: str) -> dict[str, Any]:
        out = {}
        while self.peek() != end:
            key = self.name()
            self.take(":")
            out[key] = self.value()
            if self.peek() == ",":
                self.take()
        self.take(end)
        return out


def table_query(text: str) -> tuple[str, list[str], dict[str, Any]]:
    """(table, columns, arguments) of ``{ table(filter: {...}, sort: [...], limit: n, page: n) { columns } }``; ValueError otherwise."""
    r = _Reader(text)
    if r.peek() == "query":
        r.take()
        if r.peek() != "{":
            r.name()
    r.take("{")
    name = r.name()
    if r.peek() == ":":  # an alias
        r.take()
        name = r.name()
    args: dict[str, Any] = {}
    if r.peek() == "(":
        r.take()
        args = r.pairs(")")
    if bad := set(args) - {"filter", "sort", "limit", "page"}:
        raise ValueError(f"unknown arguments: {sorted(bad)}")
    r.take("{")
    columns = []
    while r.peek() != "}":
        columns.append(r.name())
        if r.peek() == ",":
            r.take()
    r.take("}")
    r.take("}")
    if r.peek() or not columns:
        raise ValueError("one root field with columns is expected")
    return name, columns, args


def run_table_query(tables: dict[str, DataFrame], text: str) -> DataFrame:
    """The rows of a table query; sort terms are {column: name, order: asc or desc}, or names."""
    name, columns, args = table_query(text)
    if name not in tables:
        raise ValueError(f"unknown table {name}")
    terms = args.get("sort") or []
    terms = terms if isinstance(terms, list) else [terms]
    sort = [(t, False) if isinstance(t, str) else (t["column"], str(t.get("order", "asc")).lower() == "desc") for t in terms]
    return graphql(tables[name], columns, args.get("filter"), sort or None, args.get("limit"), args.get("page"))


class Pipeline:
    """``where``, ``select``, ``sort_by`` and ``take`` over a table, in any order of calls."""

    def __init__(self, df: DataFrame) -> None:
        self.df, self.columns, self.order, self.n = df, [], None, None

    def where(self, condition: str) -> Pipeline:
        self.df = self.df.where(condition)
        return self

    def select(self, *columns: str) -> Pipeline:
        self.columns += columns
        return self

    def sort_by(self, column: str, down: bool = False) -> Pipeline:
        self.order = (column, down)
        return self

    def take(self, n: int) -> Pipeline:
        self.n = n
        return self

    def build(self) -> DataFrame:
        df = self.df
        if self.order:
            df = df.orderBy(self.order[0], ascending=not self.order[1])
        if self.n is not None:
            df = df.limit(self.n)
        return df.select(*self.columns) if self.columns else df
