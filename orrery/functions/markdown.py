"""Markdown: sections, front matter, drawers, links, work tables and page trees.

A note is parsed as a whole in its own row; notes are independent, so all of it is one Arrow pass without a shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_HEADING = re.compile(r"\s*(#{1,6})(?!#)\s*(\S.*)$")
_FENCE = ("```", "~~~")
_DRAWER = re.compile(r"\s*:([^:]+):\s*(\S.*?)\s*$")
_ENTRY = re.compile(r"\s*-\s*\[\s*([^\]]*?)\s*\]\s*(\S.*?)\s*$")
_LISTED = re.compile(r"\s*([-*+] |\d+\. )")


@dataclass
class Section:
    title: str
    path: str
    level: int
    start: int
    end: int
    lines: list[str] = field(default_factory=list)

    @property
    def body(self) -> str:
        return "\n".join(self.lines).strip()


def split_front_matter(text: str) -> tuple[str, str]:
    """(front matter, rest); empty front matter unless the text starts with a ``---`` block."""
    m = re.match(r"---\r?\n(.*?)\r?\n---[ \t]*(?:\r?\n|$)", text, re.S)
    return (m[1], text[m.end() :]) if m else ("", text)


def sections(text: str) -> list[Section]:
    """Sections by headings outside code fences; text before the first heading has level 0; lines count from 1."""
    found = [Section("", "", 0, 1, 1)]
    trail: list[str] = []
    fenced = False
    n = 0
    for n, line in enumerate(text.splitlines(), 1):
        mark = line.lstrip().startswith(_FENCE)
        m = None if fenced or mark else _HEADING.match(line)
        fenced ^= mark
        if not m:
            found[-1].lines.append(line)
            continue
        level, title = len(m[1]), " ".join(m[2].split())
        found[-1].end = max(n - 1, found[-1].start)
        trail = [*trail[: level - 1], title]
        found.append(Section(title, " / ".join(trail), level, n, n))
    found[-1].end = max(n, found[-1].start)
    return [s for s in found if s.body or s.path]


def attributes(lines: list[str]) -> dict[str, str]:
    """``:KEY: value`` lines at the head of a section, in a ``:PROPERTIES:`` block or bare."""
    out: dict[str, str] = {}
    block = done = False
    for line in lines:
        t = line.strip()
        if t == ":PROPERTIES:":
            block = True
        elif block and t == ":END:":
            block, done = False, True
        elif not block and done:
            break
        elif m := _DRAWER.match(line):
            out[m[1].strip().upper()] = m[2]
        elif not block and t:
            break
    return out


def log_entries(lines: list[str], start: int) -> list[tuple[str, str, int]]:
    """(timestamp, message, line) of a section's ``:LOGBOOK:`` block."""
    marks = [line.strip() for line in lines]
    if ":LOGBOOK:" not in marks:
        return []
    a = marks.index(":LOGBOOK:") + 1
    b = marks.index(":END:", a) if ":END:" in marks[a:] else len(lines)
    return [(m[1], m[2], start + i + 1) for i in range(a, b) if (m := _ENTRY.match(lines[i])) and m[1]]


def skeleton(title: str, level: int, drawer: dict[str, str], body: str) -> str:
    """Heading, drawer, and of the body only headings, drawers, fences, lists and single blanks; its first line if nothing is left."""
    head = ["#" * min(max(level, 1), 6) + " " + title.strip()]
    if drawer:
        head += [":PROPERTIES:", *[f":{k}: {v}" for k, v in sorted(drawer.items())], ":END:"]
    kept = [x.rstrip() for x in body.splitlines()]
    kept = [x for x in kept if not x.strip() or x.lstrip().startswith(("#", ":", *_FENCE)) or _LISTED.match(x)]
    if not kept:
        kept = [x.strip() for x in body.splitlines() if x.strip()][:1]
    kept = [x for i, x in enumerate(kept) if x.strip() or i == 0 or kept[i - 1].strip()]
    return "\n".join([*head, *kept]).strip()


def work_rows(text: str, fallback: str) -> list[tuple[str, str, int, str, str]]:
    """(heading_path, title, level, skeleton, body): the whole note at level 0, then its sections."""
    parts = sections(split_front_matter(text)[1])
    title = next((s.title for s in parts if s.level == 1), fallback)
    rows = [("", title, 0, skeleton(title, 1, {}, text), text.strip())]
    for s in parts:
        path = "/".join(p.strip() for p in s.path.split(" / ") if p.strip())
        name = s.title.strip() or "Overview"
        rows.append((path, name, s.level, skeleton(name, max(s.level, 1), attributes(s.lines) if s.level else {}, s.body), s.body))
    return rows


#: Trees fold nodes of fewer words into themselves.
THIN_WORDS = 12


def page_tree(text: str, thin: int = THIN_WORDS) -> list[tuple[int, int, str, int, int, int, bool]]:
    """(node, parent, title, level, start, words, thinned) in page order; parent -1 for roots.

    From the leaves up, a node of fewer than ``thin`` words takes in the texts of its children, which go.
    """
    parts = sections(split_front_matter(text)[1])
    level = [max(s.level, 1) for s in parts]
    parent, stack = [], []
    for i in range(len(parts)):
        while stack and level[stack[-1]] >= level[i]:
            stack.pop()
        parent.append(stack[-1] if stack else -1)
        stack.append(i)
    kids: dict[int, list[int]] = {}
    for i, p in enumerate(parent):
        kids.setdefault(p, []).append(i)
    body = [s.body for s in parts]
    thinned = [False] * len(parts)
    for i in reversed(range(len(parts))):
        if kids.get(i) and len(body[i].split()) < max(thin, 1):
            texts = [f"{parts[c].title}\n{body[c].strip()}" if body[c].strip() else parts[c].title for c in kids[i]]
            body[i] = "\n\n".join(([body[i].strip()] if body[i].strip() else []) + texts)
            thinned[i], kids[i] = True, []
    out, todo = [], list(reversed(kids.get(-1, [])))
    while todo:
        i = todo.pop()
        out.append((i, parent[i], parts[i].title, level[i], parts[i].start, len(body[i].split()), thinned[i]))
        todo += reversed(kids.get(i, []))
    return out


def _parsed(notes: DataFrame, key: str, text: str, columns: dict[str, str], rows_of: Callable[[str, object], list[tuple]]) -> DataFrame:
    """Rows that a parser makes of each text, with the note's key; null texts have none."""
    schema = ", ".join(f"{c} {t}" for c, t in {key: notes.schema[key].dataType.simpleString(), **columns}.items())

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(k, *r) for k, t in zip(b[key], b[text], strict=True) if t is not None for r in rows_of(t, k)], columns=[key, *columns])

    return notes.select(key, text).mapInPandas(parse, schema)


def section_table(notes: DataFrame, key: str, text: str) -> DataFrame:
    """One row a section, with its drawer and log."""
    columns = {"heading_path": "string", "title": "string", "level": "int", "line_start": "int", "line_end": "int", "attributes": "map<string,string>", "log": "array<struct<ts:string,message:string,line:int>>", "body": "string"}

    def rows(t: str, _) -> list[tuple]:
        out = []
        for s in sections(split_front_matter(t)[1]):
            drawer, log = (attributes(s.lines), log_entries(s.lines, s.start)) if s.level else ({}, [])
            out.append((s.path, s.title, s.level, s.start, s.end, drawer, [{"ts": a, "message": m, "line": n} for a, m, n in log], s.body))
        return out

    return _parsed(notes, key, text, columns, rows)


def work_table(notes: DataFrame, key: str, text: str) -> DataFrame:
    """Notes as a table of structural rows."""
    columns = {"heading_path": "string", "title": "string", "level": "int", "skeleton": "string", "body": "string"}
    return _parsed(notes, key, text, columns, lambda t, k: work_rows(t, str(k)))


def page_index(notes: DataFrame, key: str, text: str, thin: int = THIN_WORDS) -> DataFrame:
    """Thinned page trees."""
    columns = {"node": "int", "parent": "int", "title": "string", "level": "int", "line_start": "int", "words": "int", "thinned": "boolean"}
    return _parsed(notes, key, text, columns, lambda t, _: page_tree(t, thin))


def entity_refs(text: Column) -> Column:
    """Distinct targets of wiki links, address included, in order of first occurrence."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"\[\[([^\]|]+)(?:\|[^\]]*)?\]\]"), F.lit(1)), F.trim))


def front_value(text: Column, key: str) -> Column:
    """A scalar of the front matter; null without it."""
    front = F.regexp_extract(text, r"(?s)^---\r?\n(.*?)\r?\n---", 1)
    value = F.regexp_extract(front, rf"(?m)^{key}:[ \t]*(\S.*?)[ \t]*$", 1)
    return F.nullif(F.regexp_replace(value, "^[\"']|[\"']$", ""), F.lit(""))
