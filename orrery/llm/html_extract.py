"""HTML extraction: equivalence-class template deduction over the pages of a host.

Tokens are a page's tags, told apart by the hash of their path of element names, classes and ids, and its runs of
text, told apart by path and content.  Tokens of one host with the same occurrence vector over its pages form an
equivalence class.  A vector is kept as its support and the XOR of a hash of (page, count), which partial aggregation
adds up, so a hot host is no larger a group than a page has tokens.  A class is valid if it has at least two tokens, a
tag among them, occurs on a fair share of the host's pages, and nests: the parent of each of its tags is itself in a
class of no smaller support.  The tags of the valid classes, nested by their paths, are the host's template, their
texts its fixed wording.

Each page is then aligned with its host's template.  What lies between two consecutive template tags is a slot, named
by the tag before it.  A second aggregation tells how a slot's contents vary over the host's pages, and how much of
them is link text.  Slots that vary and are mostly no link text hold the host's prose; the deepest container of the
template around most of it is the main region.  Slots of link text are menus.  A page's text is what its main region has but
for menus and fixed wording.  Fixed wording in paragraphs, headings and other prose goes if it is on most of the
host's pages and fills its element; prose that mixes it with slots stays whole, as does a page whose main region has
nothing else.

Variation cannot tell a reader's comment, a sponsored paragraph or a byline form from the article's own paragraphs.
For these, and for pages whose host has no template (less than ``MIN_PAGES`` pages, or nothing in common), fixed lists
of tags, roles and words of classes and ids decide.  In a main region by the template, a word that is but a part of a
class or id, or one of the loose words, decides nothing where the slot has a text of its own on most pages
(``OWN_SHARE``), unless the element is one of several of its kind on the page, or has several, and the word speaks of
comments.  ``extract(..., marks=False)`` goes without the lists.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.llm.common import Saved, table
from orrery.llm.url_filter import host_and_path

#: A class counts for the template from this share of a host's pages and from so many pages on.
MIN_SHARE, MIN_PAGES = 0.2, 3
#: Prose counts for the template from this share on, so that a few near copies on a host are no template.
PROSE_SHARE = 0.5
#: A slot varies if so many of its contents differ, and this share of them; the main region has this share of the prose.
MIN_CONTENTS, VARYING_SHARE, REGION_SHARE = 3, 0.1, 0.6
#: A slot has a text of its own on each page if this share of its contents differ, over so many pages at least.
OWN_SHARE, OWN_PAGES = 0.6, 6
#: A slot with this share of link text is a menu.
MENU_SHARE = 0.5
#: Templates up to so many bytes are broadcast; more meet the pages in a shuffle join, in which a host's pages are dealt
#: over one more task for each so many pages.
BROADCAST_BYTES, PAGES_PER_TASK = 32 << 20, 5000

_START = re.compile(r"<(?:(/?)([A-Za-z][A-Za-z0-9:-]*)|(!--)|(!\[CDATA\[)|[!?])", re.I)
_END_OR_QUOTE = re.compile(r"""=\s*(["'])|>""")
#: Elements whose content is no markup, or is never shown.
_RAW = frozenset("script style noscript template textarea iframe head".split())
_CLOSERS = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in _RAW}
_TELLING = re.compile("class|id|role|itemprop|style|hidden", re.I)
_ATTR = re.compile(r"""\b(class|id|role|itemprop|style|aria-hidden|hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "html body address article aside blockquote button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr legend li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul br".split()
)
_CLOSES_P = _BLOCK - {"button", "br", "html", "body", "caption", "legend", "summary", "td", "th", "tr", "tbody", "thead", "tfoot"}
_SIBLING = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_SCOPE = frozenset("article aside body div main section table td th ul ol dl form blockquote nav header footer figure fieldset html".split())
_PROSE = frozenset("p h1 h2 h3 h4 h5 h6 li blockquote pre td th dd dt figcaption".split())
_CONTAINERS = _BLOCK - _PROSE - {"br", "hr", "ul", "ol", "dl", "table", "tbody", "thead", "tfoot", "tr"}
#: Elements and words of classes and ids that mark what is no article text.
_OUT_TAGS = frozenset("nav footer aside form button dialog menu input label legend fieldset select datalist textarea head title script style noscript template iframe".split())
_OUT_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar tablist".split())
_OUT_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adbox adsense sponsor sponsored promo promotion promoted banner cookie cookies consent gdpr notice notices notification alert popup modal overlay"
    " sidebar rail widget widgets menu menus nav navbar navigation navi breadcrumb breadcrumbs pagination pager footer foot header masthead topbar toolbar"
    " comment comments discussion disqus respond reply replies share sharing social related recommended recommendations newsletter subscribe subscription signup login signin register search searchbox form tags skip copyright legal disclaimer".split()
)
#: Of these words, those that speak of readers' comments, and those that as a whole class or id name parts of articles as well.
_COMMENT_WORDS = frozenset("comment comments discussion disqus respond reply replies".split())
_LOOSE_WORDS = frozenset("discussion legal notice notices respond reply search register header foot social".split())
#: Marks of these tags and roles hold for all that is inside; a word or a form may just be on a wrapper of the page.
_FIRM_TAGS = _OUT_TAGS - {"form"}


class Facts(NamedTuple):
    """What the name and attributes of a start tag say."""

    label: bytes  # name, classes and id, numbers of three digits and more as 0: its part of the path
    main: bool
    main_role: bool
    hidden: bool
    role: str
    words: frozenset[str]
    comment: bool
    whole: bool  # whether a class or id is made of words of the list alone, not just a loose one
    judged: tuple[tuple[bool, bool], tuple[bool, bool]] = ((False, False), (False, False))  # (out, whatever its words), outside the main region and inside


class Element:
    __slots__ = ("hard", "soft", "facts", "name", "token", "out", "mark", "link", "parent", "number", "main", "marked", "prose", "firm", "cleared", "block", "region", "article")

    def __init__(self, name: str, token: int, parent: Element | None, number: int) -> None:
        self.name, self.token, self.parent, self.number = name, token, parent, number
        self.main = self.marked = self.firm = self.out = self.link = False
        self.block: Element = self if name in _BLOCK or parent is None else parent.block  # the innermost block, itself included
        self.region: Element | None = None if parent is None else parent if parent.marked else parent.region  # the innermost main or article around
        self.article = name == "article" or (parent is not None and parent.article)
        self.hard = 0  # number of the innermost element around that more than words marks, itself included
        self.soft: Element | None = None if parent is None else parent.soft  # the innermost element around that words alone mark, itself included
        self.mark = 0  # number of the innermost marked element around, itself included
        self.prose: int = number if name in _PROSE else parent.prose if parent else 0  # the innermost prose element around
        self.cleared = 0  # if out by a wrapper only: 1 inside main, 2 inside an article


#: Of a page, in order: text with its element; an element as it opens (None) or closes (False); '' for a break between blocks.
Events = list[tuple[Element, str | bool | None]]


@lru_cache(8192)
def _facts(name: str, raw: str) -> Facts:
    attrs = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTR.finditer(raw)}
    marked = ".".join(sorted({*attrs.get("class", "").split(), *attrs.get("id", "").split()}))
    role = attrs.get("role", "").lower()
    hidden = "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true" or bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attrs.get("style", ""), re.I))
    main_role = name == "main" or role == "main"
    main = name == "article" or main_role or attrs.get("itemprop", "").lower() == "articlebody"
    words = frozenset(w.lower() for k in ("class", "id") for w in _PART.findall(attrs.get(k, "")))
    comment = not words.isdisjoint(("comment", "comments")) and bool({"comment", "comments"} & {w.lower() for w in _PART.findall(attrs.get("class", ""))})
    names = [frozenset(w.lower() for w in _PART.findall(n)) for k in ("class", "id") for n in attrs.get(k, "").split()]
    whole = any(n and n <= _OUT_WORDS and not (len(n) == 1 and n <= _LOOSE_WORDS) for n in names)
    f = Facts(f"{name}.{re.sub('[0-9]{3,}', '0', marked)}".encode(), main, main_role, hidden, role, words, comment, whole)
    return f._replace(judged=tuple((_is_out(name, f, inside), _is_hard(name, f, inside)) for inside in (False, True)))


def _is_hard(name: str, f: Facts, inside_main: bool) -> bool:
    """Whether tag, role or style mark an element, whatever its words."""
    return name in _OUT_TAGS or (name == "header" and not inside_main) or (name == "article" and inside_main) or f.hidden or f.role in _OUT_ROLES


def _is_out(name: str, f: Facts, inside_main: bool) -> bool:
    if _is_hard(name, f, inside_main):
        return True
    if name in ("html", "body") or f.main_role or (name == "article" and not f.comment):
        return False
    found = f.words & _OUT_WORDS
    return bool(found) and not (inside_main and found <= {"header", "banner", "tags", "search", "form"} and name in ("h1", "h2", "header"))


def _is_firm(name: str, f: Facts) -> bool:
    """Whether a marked element outside the main region is out with all main elements inside."""
    return f.hidden or name in _FIRM_TAGS or name == "header" or f.role in _OUT_ROLES - {"form"}


def _tag_end(page: str, at: int) -> int:
    """Where the tag ends whose name ends at ``at``: at the first ``>`` outside quoted values; -1 if a quote stays open."""
    while m := _END_OR_QUOTE.search(page, at):
        if not m[1]:
            return m.start()
        at = page.find(m[1], m.end()) + 1
        if not at:
            return -1
    return -1


def markup(page: str) -> Iterator[tuple[int, int, str, bool, str]]:
    """(start, end, name, closes, attributes) of each tag; name '' for comments and declarations, '-' for raw elements.

    Linear in the page: what is not found beyond some place is not looked for again.
    """
    at, last, loose, never = 0, page.rfind(">"), False, set()
    while (lt := page.find("<", at)) >= 0:
        m = _START.match(page, lt)
        if not m:
            at = lt + 1
            continue
        if m[3]:
            end = page.find("-->", m.end() - 2)
            at = end + 3 if end >= 0 else len(page)
            yield lt, at, "", False, ""
            continue
        if m[4] and "]]" not in never:
            end = page.find("]]>", m.end())
            if end >= 0:
                at = end + 3
                yield lt, at, "", False, ""
                continue
            never.add("]]")
        if last < m.end():
            return  # an open tag at the end of the page is text
        end = page.find(">", m.end())
        if not m[2]:
            at = end + 1
            yield lt, at, "", False, ""
            continue
        if not loose and not m[1] and page.find("=", m.end(), end) >= 0:
            found = _tag_end(page, m.end())
            loose = found < 0
            end = end if loose else found
        at, name = end + 1, m[2].lower()
        if name in _RAW and not m[1] and name not in never:
            close = _CLOSERS[name].search(page, at)
            if close:
                end = page.find(">", close.end())
                at = end + 1 if end >= 0 else len(page)
                yield lt, at, "-", False, ""
                continue
            never.add(name)
        yield lt, at, name, bool(m[1]), page[m.end() : end]


def parse(page: str, marks: bool = True) -> Events:
    """The events of a page, with character references decoded; ``marks`` says whether elements are judged by the lists."""
    root = Element("", 0, None, 1)
    stack, events, at, number = [root], [], 0, 1
    opened: Counter = Counter()  # open elements by name

    def close(i: int) -> None:
        for x in reversed(stack[i:]):
            events.append((x, False))
            opened[x.name] -= 1
        del stack[i:]

    def text(to: int) -> None:
        t = page[at:to]
        events.append((stack[-1], entities.unescape(t) if "&" in t else t))

    for start, end, name, closes, raw in markup(page):
        if start > at:
            text(start)
        at = end
        if not name or name == "-":
            if name:
                events.append((stack[-1], ""))
            continue
        if name in _BLOCK:
            events.append((stack[-1], ""))
        if closes:
            if opened[name]:
                close(next(i for i in range(len(stack) - 1, 0, -1) if stack[i].name == name))
            continue
        if name in _VOID:
            continue
        if name == "body" and opened["head"]:
            close(next(i for i, x in enumerate(stack) if x.name == "head"))
        if opened["p"] and name in _CLOSES_P:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].name == "p":
                    close(i)
                    break
                if stack[i].name in _SCOPE:
                    break
        if name in _SIBLING and any(opened[x] for x in _SIBLING[name]):
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].name in _SIBLING[name]:
                    close(i)
                    break
                if stack[i].name in _SCOPE and stack[i].name not in ("td", "th"):
                    break
        f = _facts(name, "") if not raw or not _TELLING.search(raw) else _facts(name, raw) if len(raw) < 300 else _facts.__wrapped__(name, raw)
        top = stack[-1]
        number += 1
        e = Element(name, token_of(top.token, f.label), top, number)
        e.link = top.link or name == "a"
        if marks:
            inside = top.main
            own, hard = f.judged[inside and not (name == "article" and not top.article)]
            e.hard = number if hard else top.hard
            if own and not hard:
                e.soft, e.facts = e, f
            e.out, e.mark, e.main, e.marked = top.out or own, number if own else top.mark, inside or f.main, f.main
            if e.out:
                e.firm = top.firm or (own and (inside or f.main or _is_firm(name, f)))
                if not e.firm:
                    e.cleared = 1 if f.main_role else top.cleared or 2 * f.main
        events.append((e, None))
        stack.append(e)
        opened[name] += 1
    if at < len(page):
        text(len(page))
    return events


def _home(article: Element) -> Element | None:
    """The main region of an article, or else its parent; sibling articles have the same."""
    return article.region or article.parent


def token_of(parent: int, content: bytes) -> int:
    """A tag's token by its parent's and its label, a text's by its element's and its words."""
    return xxhash.xxh3_64_intdigest(content, parent & ((1 << 64) - 1)) - (1 << 63)


def text_token(e: Element, t: str) -> int:
    return token_of(e.token, b"\0" + " ".join(t.split()).encode("utf-8", "surrogatepass"))


class Template(NamedTuple):
    """A host's template: tag tokens, tokens of its fixed texts, the token of its main region (or None), its menu slots, slots whose text is a page's own."""

    tags: frozenset[int] = frozenset()
    fixed: frozenset[int] = frozenset()
    region: int | None = None
    menus: frozenset[int] = frozenset()
    own: frozenset[int] = frozenset()


NO_TEMPLATE = Template()


def aligned(events: Events, tags: frozenset[int]) -> Iterator[tuple[Element, str, int]]:
    """(element, text, slot) of each run: the slot's name is the token of the template tag before it, inverted for an end tag."""
    slot = 0
    for e, t in events:
        if isinstance(t, str):
            yield e, t, slot
        elif e.token in tags:
            slot = e.token if t is None else ~e.token


def extract(page: str | None, template: Template = NO_TEMPLATE, marks: bool = True) -> str:
    """Main text of a page by its host's template; ``marks`` says whether the lists of tags, roles and words may help."""
    if not page:
        return ""
    events, fixed = parse(page, marks), template.fixed
    bound = next((e for e, t in events if t is None and e.token == template.region), None) if template.region is not None else None
    bounds: set[int] = set()  # the elements of the main region by the template, none if it has none on this page
    if bound is not None:
        bounds = {e.number for e, t in events if t is None and e.token == template.region}
    inner: dict[int, int] = {}
    repeats = _Repeats(events)
    runs: list[tuple[Element | None, str, bool, bool]] = []  # element, text, whether the template has it, whether it is marked
    for e, t, slot in aligned(events, template.tags):
        if not t:
            runs.append((None, " ", False, False))
            continue
        around = 0
        if bounds and not (around := _around(e, bounds, inner)):
            continue
        if slot in template.menus and (e.link or not marks):
            runs.append((None, " ", False, False))
            continue
        known = bool(fixed) and not t.isspace() and text_token(e, t) in fixed
        out = marks and e.out and e.mark > around and not (bounds and slot in template.own and _yields(e, around, repeats))
        runs.append((e, t, known, out))
    regions, cleared = _marked_regions(runs, bool(bounds)) if marks else (set(), 0)
    inside: list[tuple[Element | None, str, bool]] = []
    open_prose: set[int] = set()  # prose elements with a slot
    inner = {}
    for e, t, known, out in runs:
        if e is None:
            inside.append((None, " ", False))
            continue
        if out and not 0 < e.cleared <= cleared:
            continue
        if not regions or _around(e, regions, inner):
            inside.append((e, t, known))
            if not known and not t.isspace():
                open_prose.add(e.prose)
    text = " ".join("".join(t for e, t, known in inside if not known or (e.prose and e.prose in open_prose)).split())
    return text or " ".join("".join(t for e, t, known in inside if not known or e.prose).split())


class _Repeats:
    """The elements that are one of several of their kind on the page, or that hold several containers or list items of one kind; found when asked for."""

    def __init__(self, events: Events) -> None:
        self.events, self.found = events, None

    def __contains__(self, number: int) -> bool:
        if self.found is None:
            opened = [e for e, t in self.events if t is None]
            kinds = Counter(e.token for e in opened)
            several = [e for e in opened if kinds[e.token] > 1 and (e.name in _CONTAINERS or e.name == "li")]
            self.found = {n for e in several for n in (e.number, e.parent.number)}
        return number in self.found


def _yields(e: Element, around: int, repeats: _Repeats) -> bool:
    """Whether all that marks ``e`` inside element ``around`` are words that give way to a slot with a text of each page's own."""
    if e.hard > around:
        return False
    x = e.soft
    while x is not None and x.number > around:
        if x.facts.whole or (not x.facts.words.isdisjoint(_COMMENT_WORDS) and x.number in repeats):
            return False
        x = x.parent.soft
    return True


def _around(e: Element, numbers: set[int], inner: dict[int, int]) -> int:
    """The number of the innermost of these elements around ``e``, itself included, 0 for none; ``inner`` has what was found before."""
    passed, x = [], e
    while x is not None and x.number not in inner and x.number not in numbers:
        passed.append(x.number)
        x = x.parent
    found = 0 if x is None else x.number if x.number in numbers else inner[x.number]
    inner.update((k, found) for k in passed)
    return found


def _marked_regions(runs: list[tuple[Element | None, str, bool, bool]], bounded: bool) -> tuple[set[int], int]:
    """The articles and main elements to keep, or without them and without a template the fullest container; up to which ``cleared`` marks hold not."""
    plain, lifted, slots_in = Counter(), Counter(), Counter()  # characters by innermost region: open text, in marked wrappers, slots in wrapped articles
    scores: Counter = Counter()  # by container, where there is no main region
    elements: dict[int, Element] = {}
    cleared = 1
    for e, t, known, out in runs:
        n = len(t.strip()) if e is not None else 0
        if e is None or not n or (out and not e.cleared):
            continue
        x = e if e.marked else e.region
        if x is not None:
            elements[x.number] = x
            if not out:
                plain[x.number] += n
            elif e.cleared < 2:
                lifted[x.number] += n
            elif not e.link and not known:
                slots_in[x.number] += n
        if not out and not e.link and not known:
            block = e.block.parent if e.block.name in _PROSE else e.block
            if block is not None:
                scores[block.number] += n
                elements[block.number] = block
                if block.parent is not None:
                    scores[block.parent.number] += n / 2
                    elements[block.parent.number] = block.parent
    for k in list(elements):  # and the regions around these
        x = elements[k].region
        while x is not None and x.number not in elements:
            elements[x.number] = x
            x = x.region
    for k in sorted(elements, reverse=True):
        up = elements[k].region
        if elements[k].marked and up is not None:
            for held in (plain, lifted, slots_in):
                if held[k]:
                    held[up.number] += held[k]
    ours = {k: not x.out or x.cleared for k, x in elements.items() if x.marked}
    size = Counter({k: n for k, free in ours.items() if (n := plain[k] + (lifted[k] if free else 0))})
    wrapped = Counter({k: slots_in[k] for k, free in ours.items() if free and slots_in[k]})
    has_main = any(elements[k].name != "article" for k in size)
    if wrapped and not has_main and max(wrapped.values()) > max([*size.values(), *scores.values()], default=0):
        size, cleared = wrapped, 2  # the mark was on a wrapper of the article, not on an aside of the page
    regions: set[int] = set()
    if size:
        most = max(size, key=lambda k: (size[k], k))  # of nested ones of equal size the inner
        articles = [k for k in size if elements[k].name == "article"]
        regions = {most}
        if articles:
            best = elements[max(articles, key=lambda k: (size[k], -k))]
            together = {k for k in articles if _home(elements[k]) is _home(best)}
            if 3 * sum(size[k] for k in together) >= size[most]:
                regions = together
    elif scores and not bounded:
        regions = {max(scores, key=lambda k: (scores[k], -k))}
    return regions, cleared


def _in_slices(batches: Iterator[pa.RecordBatch], rows_of, names: list[str], types: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
    """``rows_of`` over slices of 256 rows, so that few pages are Python objects at a time."""
    for b in batches:
        for at in range(0, max(1, b.num_rows), 256):
            part = b.slice(at, 256)
            out = [row for values in zip(*(c.to_pylist() for c in part.columns), strict=True) for row in rows_of(*values)]
            columns = list(zip(*out, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)


def tokens(pages: DataFrame) -> DataFrame:
    """(host, page, token, parent, is_text, prose, n) of each distinct token of each page."""

    def of_page(host: str, page: int, page_html: str) -> list[tuple]:
        events = parse(page_html, marks=False)
        tags = Counter((e.token, e.parent.token) for e, t in events if t is None)
        out = [(host, page, own, up or None, False, False, n) for (own, up), n in tags.items()]
        texts = Counter((text_token(e, t), e.token, e.prose > 0) for e, t in events if isinstance(t, str) and t and not t.isspace())
        return out + [(host, page, own, up, True, prose, n) for (own, up, prose), n in texts.items()]

    names = ["host", "page", "token", "parent", "is_text", "prose", "n"]
    types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.int32()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _in_slices(batches, of_page, names, types)

    return pages.where("html IS NOT NULL").select("host", F.xxhash64("page_id", "url", "html").alias("page"), "html").mapInArrow(run, "host string, page bigint, token bigint, parent bigint, is_text boolean, prose boolean, n int")


def templates(pages: DataFrame, saved: Saved, min_share: float = MIN_SHARE, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, tags, fixed): the tokens of the tags and texts of each host's template, at most mean tokens of a page / ``min_share``."""
    vector = F.bit_xor(F.xxhash64("page", "n")).alias("vector")
    found = tokens(pages).groupBy("host", "token", "parent", "is_text", "prose").agg(F.count("*").alias("support"), vector)
    count = pages.where("html IS NOT NULL").groupBy("host").agg(F.count("*").alias("pages"))
    found = found.where(F.col("support") >= min_pages).join(count, "host").where(F.col("support") >= min_share * F.col("pages"))
    found = saved.keep(found, "tokens")
    tags = found.where("NOT is_text").select("host", F.col("token").alias("parent"), F.col("support").alias("parent_support"))
    nested = found.join(tags, ["host", "parent"], "left")
    nests = F.col("is_text") | F.col("parent").isNull() | (F.col("parent_support") >= F.col("support"))
    classes = nested.groupBy("host", "support", "vector").agg(F.count("*").alias("size"), F.count_if(~F.col("is_text")).alias("tags"), F.min(F.coalesce(nests, F.lit(False))).alias("valid"))
    valid = classes.where("valid AND size > 1 AND tags > 0").select("host", "support", "vector")
    kept = found.where(~F.col("is_text") | ~F.col("prose") | (F.col("support") >= PROSE_SHARE * F.col("pages"))).join(valid, ["host", "support", "vector"], "left_semi")
    return kept.groupBy("host").agg(F.collect_list(F.expr("CASE WHEN NOT is_text THEN token END")).alias("tags"), F.collect_list(F.expr("CASE WHEN is_text THEN token END")).alias("fixed"))


def slots(pages: DataFrame, found: DataFrame) -> DataFrame:
    """(host, slot, around, pages, contents, prose, links) of each slot of each host's template.

    ``around`` has the containers of the template that enclose the slot, outermost first; ``contents`` is about how many contents
    it has over the pages; ``prose`` and ``links`` are characters of its text outside and inside links, fixed wording left out.
    """
    names = ["host", "slot", "around", "content", "prose", "links"]
    types = [pa.string(), pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.int64()]

    def of_page(host: str, page_html: str, tags: list[int], fixed: list[int]) -> list[tuple]:
        in_tags, in_fixed = frozenset(tags), frozenset(fixed)
        by: dict[int, list] = {}
        slot, around = 0, None
        for e, t in parse(page_html, marks=False):
            if isinstance(t, str):
                if not t or t.isspace():
                    continue
                if text_token(e, t) in in_fixed:
                    continue
                seen = by.get(slot)
                if seen is None:
                    chain, x = [], around
                    while x is not None:
                        if x.token in in_tags and x.name in _CONTAINERS:
                            chain.append(x.token)
                        x = x.parent
                    seen = by[slot] = [chain[::-1], xxhash.xxh3_64(), 0, 0]
                words = " ".join(t.split())
                seen[1].update(words.encode("utf-8", "surrogatepass"))
                seen[3 if e.link else 2] += len(words)
            elif e.token in in_tags:
                slot, around = (e.token, e) if t is None else (~e.token, e.parent)
        return [(host, k, chain, h.intdigest() - (1 << 63), prose, links) for k, (chain, h, prose, links) in by.items()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _in_slices(batches, of_page, names, types)

    each = with_templates(pages.where("html IS NOT NULL"), found, "inner").select("host", "html", "tags", "fixed")
    each = each.mapInArrow(run, "host string, slot bigint, around array<bigint>, content bigint, prose bigint, links bigint")
    sums = [F.first("around").alias("around"), F.count("*").alias("pages"), F.approx_count_distinct("content").alias("contents"), F.sum("prose").alias("prose"), F.sum("links").alias("links")]
    return each.groupBy("host", "slot").agg(*sums)


def regions(found: DataFrame) -> DataFrame:
    """(host, region, menus, own) by the slots of each host: the deepest element around most of the varying prose, the slots
    of links, and those whose text is a page's own."""
    menu = F.col("links") >= MENU_SHARE * (F.col("links") + F.col("prose"))
    varies = (F.col("contents") >= MIN_CONTENTS) & (F.col("contents") >= VARYING_SHARE * F.col("pages")) & ~menu
    prose = found.where(varies)
    total = prose.groupBy("host").agg(F.sum("prose").alias("total"))
    around = prose.select("host", "prose", F.posexplode("around").alias("depth", "element")).groupBy("host", "depth", "element").agg(F.sum("prose").alias("held"))
    main = around.join(total, "host").where(F.col("held") >= REGION_SHARE * F.col("total")).groupBy("host").agg(F.max_by("element", "depth").alias("region"))
    own = (F.col("pages") >= OWN_PAGES) & (F.col("contents") >= OWN_SHARE * F.col("pages")) & ~menu
    lists = found.groupBy("host").agg(F.collect_list(F.when(menu, F.col("slot"))).alias("menus"), F.collect_list(F.when(own, F.col("slot"))).alias("own"))
    return main.join(lists, "host", "right")


def with_templates(pages: DataFrame, found: DataFrame, how: str, broadcast_bytes: int | None = None, pages_per_task: int | None = None) -> DataFrame:
    """Pages with the columns of their host's row in ``found``.  The limits are ``BROADCAST_BYTES`` and ``PAGES_PER_TASK``.

    Beyond the first, a host's pages are dealt over tasks by a salt, and its row is repeated for each: as many salts as
    the largest hosts need, for all hosts with more than ``pages_per_task`` pages.
    """
    limit, per_task = (BROADCAST_BYTES if broadcast_bytes is None else broadcast_bytes), (PAGES_PER_TASK if pages_per_task is None else pages_per_task)
    arrays = [c for c, t in found.dtypes if t.startswith("array")]
    size = found.agg(F.sum(sum((F.size(c) * 8 for c in arrays), F.octet_length("host") + 64))).first()[0] or 0
    if size <= limit:
        return pages.join(F.broadcast(found), "host", how)
    counts = pages.groupBy("host").agg(F.count("*").alias("n"))
    salted = found.join(counts, "host").withColumn("salt", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor(F.col("n") / per_task).cast("int"))))).drop("n")
    hot = counts.where(F.col("n") >= per_task).select("host", (F.floor(F.col("n") / per_task) + 1).alias("salts"))
    few = hot.count() * 256 <= max(limit, 1 << 20)  # hosts are at most 255 bytes
    dealt = pages.join(F.broadcast(hot) if few else hot, "host", "left")
    dealt = dealt.withColumn("salt", F.pmod(F.xxhash64("page_id", "url", F.octet_length("html")), F.coalesce("salts", F.lit(1))).cast("int")).drop("salts")
    return dealt.join(salted, ["host", "salt"], how).drop("salt")


def deduce(pages: DataFrame, saved: Saved) -> DataFrame:
    """(host, tags, fixed, region, menus, own) of each host that has a template; ``pages`` has page_id, url, html, host."""
    found = saved.keep(templates(pages, saved), "templates")
    seen = saved.keep(slots(pages, found), "slots")
    return saved.keep(found.join(regions(seen), "host", "left"), "regions")


def extract_pages(pages: DataFrame, marks: bool = True) -> DataFrame:
    """One row for each row of ``pages``: page_id, url, text, n_chars (code points).

    A null or empty page, or one without main text, gives '' and 0.  A page without a host shares its template with the
    others that have none.  Repeated rows each give a row, an empty table gives none; other columns are not read.
    """
    saved = Saved(pages.sparkSession, "html")
    p = pages.select("page_id", "url", "html").withColumn("host", host_and_path(F.col("url"))[0])

    def of_page(page_id: int, url: str | None, page_html: str | None, tags: list | None, fixed: list | None, region: int | None, menus: list | None, own: list | None) -> list[tuple]:
        text = extract(page_html, Template(frozenset(tags or ()), frozenset(fixed or ()), region, frozenset(menus or ()), frozenset(own or ())), marks)
        return [(page_id, url, text, len(text))]

    names, kind = ["page_id", "url", "text", "n_chars"], p.schema["page_id"].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    types = [to_arrow_type(kind), pa.string(), pa.string(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _in_slices(batches, of_page, names, types)

    joined = with_templates(p, deduce(p, saved), "left")
    return joined.select("page_id", "url", "html", "tags", "fixed", "region", "menus", "own").mapInArrow(run, f"page_id {kind.simpleString()}, url string, text string, n_chars bigint")


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))
