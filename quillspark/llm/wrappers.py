"""Main text of web pages by union-free regular expressions, inferred for each host.

Skeleton. A page is a stream of tags and texts. Open elements are tracked (with implied end tags); every text gets
the kind content or boilerplate from the elements around it: the article is the largest `article` that is no comment, else
`main`, else an element whose class or id names content, else the body; menus, page headers, footers, asides, forms, adverts, notices,
comments, scripts, styles and hidden parts are boilerplate, by tag, role, or class and id words.

Inference. All different pages of a host take part, where it has two or more. A wrapper begins as one page, folded: a run of
equal groups becomes a repeated group. Every stream of tags is held against it; one that it does not match is folded and
aligned with it: what only one side has becomes an optional group, repeated groups are aligned within, and texts become
slots. So the wrapper, a regular expression without alternatives, grows until it matches all pages. The streams of a host that
has more than STREAMS are dealt into buckets, of which only the streams that made a wrapper grow go on to larger buckets; all are
held against the result, and those it misses are taken again. Then every page is matched once more, and its texts are
counted by slot: how many were content by tags, and how many pages held which text.

Extraction. A slot that was content on all pages is content; texts that a slot holds on most pages are the host's template. On a
page that its host's wrapper matches, texts in content slots are content, as are those that the page's own tags call so, and
texts that equal a template in a slot that has one are not. Where tags name an article, a text is template only by STRONG;
where they name none (the body is all there is), by WEAK. Pages of one host may be copies of one article: a template that would
take more than half of a page takes nothing. A page that no wrapper matches falls back to its own tags, so no page is lost.

Defined cases: null html is empty and has empty text; a null or unparsable url is the host ''; repeated rows are extracted
each; empty input gives empty output. Other columns are ignored.
"""

from __future__ import annotations

import html as entities
import json
import re
import zlib
from collections.abc import Iterable
from dataclasses import dataclass
from difflib import SequenceMatcher
from functools import lru_cache, reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column, map_batches, stage

#: Streams of one host that one task looks at, at first; where streams of all buckets still differ, twice as many in each further step.
STREAMS = 1024
#: A text is template if so many pages or more, this share of the host's pages or more, and this share of the pages that fill its slot have it there.
STRONG, WEAK = (8, 8 / 16, 1.0), (3, 3 / 16, 0.8)
#: Largest wrapper table, in bytes, that is broadcast; beyond it wrappers meet pages in a shuffle join.
BROADCAST_BYTES = 32 << 20

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "xmp", "noembed", "noframes"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_BLOCKS = set(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr "
    "html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: An opening tag ends open elements of these names, up to the nearest of the barriers.
_ENDS = {n: ({"p"}, {"button", "table", "td", "th"}) for n in _BLOCKS - {"body", "html", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "legend"}}
_ENDS |= {"li": ({"li", "p"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd", "p"}, {"dl"}), "dd": ({"dt", "dd", "p"}, {"dl"}), "option": ({"option"}, {"select"})}
_ENDS |= {"tr": ({"tr", "td", "th", "p"}, {"table"}), "td": ({"td", "th", "p"}, {"table", "tr"}), "th": ({"td", "th", "p"}, {"table", "tr"})}
_ENDS |= {n: ({"thead", "tbody", "tfoot", "tr", "td", "th", "p"}, {"table"}) for n in ("thead", "tbody", "tfoot")}
_DROP_TAGS = _RAW - {"xmp"} | set("nav footer aside form button select svg canvas template head dialog menu object audio video math label input option".split())
_DROP_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "alertdialog", "form", "menu", "menubar", "toolbar", "status"}
_DROP_WORDS = set(
    "ad ads advert adverts advertisement advertisements advertising adsense adsbygoogle sponsor sponsored promo promotion promotions banner cookie cookies consent gdpr notice notices alert popup modal overlay newsletter "
    "subscribe subscription signup sidebar sidebars widget widgets menu menus nav navbar navigation breadcrumb breadcrumbs footer masthead topbar comment comments commentlist reply replies respond discussion "
    "disqus share sharing social related recommended recommendations pagination pager toolbar login search skip hidden".split()
)
#: Inside an article only these elements are dropped by class or id, and only by a name that consists of the words above
#: and of words for parts of a layout; words that are also subjects of articles do not suffice alone.
_CONTAINERS = {"div", "section", "ul", "ol", "table", "span"}
_LAYOUT_WORDS = set("area bar block box button buttons container form icons inner item items link links list post posts section slot unit wrap wrapper".split())
_SUBJECTS = set("alert discussion menu menus notice notices promotion promotions search social subscription".split())
#: Ids of these are made from headings or name passages.
_PASSAGES = {"h1", "h2", "h3", "h4", "h5", "h6", "p", "section"}
_MAIN_WORDS = {"content", "article", "post", "entry", "story", "main"}
_WORD = re.compile(r"[a-z]+")


def _names_boilerplate(name: str, attributes: dict[str, str]) -> bool:
    """Whether an element inside an article is boilerplate by class or id."""
    if name not in _CONTAINERS:
        return False
    names = attributes.get("class", "").lower().split() + ([] if name in _PASSAGES else attributes.get("id", "").lower().split())
    for words in (_WORD.findall(n) for n in names):
        found = _DROP_WORDS.intersection(words)
        if found and found | _LAYOUT_WORDS >= set(words) and (len(words) > 1 or not found & _SUBJECTS):
            return True
    return False


def _attributes(source: str) -> dict[str, str]:
    return {m[1].lower(): entities.unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(source)}


class Page:
    """Tokens of a page: tags as (name with / if closing, mark), texts as None in `tags` with their source in `texts`."""

    def __init__(self, source: str):
        self.tags: list[str | None] = []
        self.texts: list[str] = []
        self.kinds: list[bool] = []  # of the texts: content
        self.breaks: list[int] = []  # of all tokens: 2 a block begins or ends, 1 a line breaks, 0 neither
        self._read(source)
        self._choose()

    def _text(self, source: str) -> None:
        if source and not source.isspace():
            self.tags.append(None)
            self.texts.append(source)
            self.breaks.append(0)
            self.owners.append(self.stack[-1] if self.stack else 0)
        elif source and self.texts and self.tags[-1] is not None and not self.breaks[-1]:
            self.breaks[-1] = 1  # white space between inline elements

    def _open(self, name: str, attributes: dict[str, str]) -> None:
        ends = _ENDS.get(name)
        if ends:
            for depth in range(len(self.stack) - 1, -1, -1):
                at = self.names[self.stack[depth]]
                if at in ends[1]:
                    break
                if at in ends[0]:
                    del self.stack[depth:]
                    if at == "p" and len(ends[0]) == 1:
                        break
        parent = self.stack[-1] if self.stack else 0
        words = set(_WORD.findall(f"{attributes.get('class', '')} {attributes.get('id', '')}".lower()))
        inside = self.articles[parent]
        structural = name in ("html", "body", "main", "article")
        dropped = (name in _DROP_TAGS and not (inside and name in ("math", "label"))) or attributes.get("role", "").lower() in _DROP_ROLES or "hidden" in attributes or attributes.get("aria-hidden") == "true"
        dropped = dropped or "none" in attributes.get("style", "").replace(" ", "").lower().partition("display:")[2][:4]
        comment = bool(words & {"comment", "comments", "reply", "replies"})
        if structural:
            dropped = dropped or comment
        elif inside:
            dropped = dropped or _names_boilerplate(name, attributes)
        else:
            passage = name in _PASSAGES - {"section"}
            dropped = dropped or bool(_DROP_WORDS.intersection(_WORD.findall(attributes.get("class", "").lower()) if passage else words))
        self.names.append(name)
        self.parents.append(parent)
        self.dropped.append(dropped or self.dropped[parent])
        self.articles.append(inside or name in ("article", "main") or attributes.get("role", "").lower() in ("article", "main"))
        self.header.append(self.header[parent] or name == "header")
        self.marks.append(words)
        self.roles.append(attributes.get("role", "").lower())
        if name not in _VOID:
            self.stack.append(len(self.names) - 1)

    def _read(self, source: str) -> None:
        # Element 0 stands for the document.
        self.names, self.parents, self.dropped, self.header, self.marks, self.roles, self.articles = ["#"], [0], [False], [False], [set()], [""], [False]
        self.stack: list[int] = []
        self.owners: list[int] = []
        at, n = 0, len(source)
        while at < n:
            m = _TOKEN.search(source, at)
            if m is None:
                rest = source[at:]
                cut = re.search(r"<[a-zA-Z/!?][^>]*\Z", rest)
                self._text(rest[: cut.start()] if cut else rest)
                break
            self._text(source[at : m.start()])
            at = m.end()
            if m[2] is None:
                continue
            name = m[2].lower()
            if m[1]:
                for depth in range(len(self.stack) - 1, -1, -1):
                    if self.names[self.stack[depth]] == name:
                        del self.stack[depth:]
                        break
                self.tags.append("/" + name)
            else:
                attributes = _attributes(m[3])
                self._open(name, attributes)
                # Whether its attributes drop an element is part of its token: slots of equal streams mean the same.
                own = self.dropped[-1] and not self.dropped[self.parents[-1]]
                self.tags.append(" ".join([name + "!" * own, *sorted(self.marks[-1] & (_DROP_WORDS | _MAIN_WORDS))]))
                if name in _RAW:
                    end = re.compile(rf"</{re.escape(name)}\s*/?>", re.I).search(source, at)
                    at = end.end() if end else n
                    self.stack.pop()
            self.breaks.append(2 if name in _BLOCKS else 1 if name in ("br", "wbr") and name == "br" else 0)

    def _choose(self) -> None:
        size: dict[int, int] = {}
        for owner, text in zip(self.owners, self.texts, strict=True):
            e = owner
            while True:
                size[e] = size.get(e, 0) + len(text)
                if not e:
                    break
                e = self.parents[e]
        elements = range(1, len(self.names))
        alive = [e for e in elements if not self.dropped[e]]
        articles = [e for e in alive if self.names[e] == "article" or self.roles[e] == "article"]
        mains = [e for e in alive if self.names[e] == "main" or self.roles[e] == "main"]
        named = [e for e in alive if self.names[e] in ("div", "section", "td") and self.marks[e] & _MAIN_WORDS]
        for found in (articles, mains, named):
            if found:
                root = max(found, key=lambda e: (size.get(e, 0), -e))
                break
        else:
            root = 0
        self.strong = root != 0  # tags name the article
        inside: dict[int, bool] = {0: root == 0}
        for e in elements:
            inside[e] = e == root or inside[self.parents[e]]
        # A header outside the article is the page's own.
        self.kinds = [inside[o] and not self.dropped[o] and not (self.header[o] and root == 0) for o in self.owners]

    def text(self, kinds: list[bool]) -> str:
        blocks, line, k = [], [], 0
        for tag, brk in zip(self.tags, self.breaks, strict=True):
            if tag is None:
                if kinds[k]:
                    line.append(entities.unescape(self.texts[k]))
                k += 1
            elif brk == 2 and line:
                blocks.append("".join(line))
                line = []
            elif brk == 1 and line:
                line.append(" ")
        blocks.append("".join(line))
        return "\n\n".join(b for b in (" ".join(b.split()) for b in blocks) if b)


# Wrapper nodes: a tag is its string; a text is None; a group is [flag, nodes], flag "+", "*" or "?".
def _single(node) -> bool:
    return node is None or isinstance(node, str)


def _shape(node):
    return node if _single(node) else (node[0] == "+", tuple(map(_shape, node[1])))


def fold(nodes: list, longest: int = 24) -> list:
    """Runs of two or more equal groups of up to `longest` nodes, shortest groups first, become repeated groups."""
    for period in range(1, longest + 1):
        out, i = [], 0
        shapes = [_shape(n) for n in nodes]
        while i < len(nodes):
            group = shapes[i : i + period]
            j = i + period
            while len(group) == period and shapes[j : j + period] == group:
                j += period
            if j > i + period and not (period == 1 and not isinstance(group[0], str)):
                body = [nodes[i + k] for k in range(period)]
                for at in range(i + period, j, period):
                    body = [_join(a, b) for a, b in zip(body, nodes[at : at + period], strict=True)]
                out.append(["+", body])
                i = j
            else:
                out.append(nodes[i])
                i += 1
        nodes = out
    return nodes


def _join(a, b):
    """One node for two of equal shape."""
    if _single(a):
        return a
    return [a[0] if a[0] == b[0] else "*", [_join(x, y) for x, y in zip(a[1], b[1], strict=True)] if len(a[1]) == len(b[1]) else align(a[1], b[1])]


def align(wrapper: list, page: list) -> list:
    """Resolve mismatches between a wrapper and a folded page: what only one side has becomes optional; a repeated
    group against one with another body is aligned within."""
    key = lambda n: n if _single(n) else ("group", _first(n))
    a, b = [key(n) for n in wrapper], [key(n) for n in page]
    out = []
    for kind, i, j, k, m in SequenceMatcher(None, a, b, autojunk=False).get_opcodes():
        if kind == "equal":
            for x, y in zip(wrapper[i:j], page[k:m], strict=True):
                if _single(x):
                    out.append(x)
                else:
                    flag = x[0] if x[0] == y[0] else "*"
                    out.append([flag, [_join(p, q) for p, q in zip(x[1], y[1], strict=True)] if [*map(_shape, x[1])] == [*map(_shape, y[1])] else align(x[1], y[1])])
        else:
            out += _optional(wrapper[i:j]) + _optional(page[k:m])
    return out


def _optional(side: list) -> list:
    """Nodes that may be absent: each element that begins and ends here, and each other node, becomes a group of its own."""
    out, i = [], 0
    while i < len(side):
        n, j = side[i], i
        if not _single(n):
            out.append(["*" if n[0] in "+*" else "?", n[1]])
        else:
            if n is not None and n[0] != "/":
                name, depth = _name(n), 0
                for at in range(i, len(side)):
                    if isinstance(side[at], str) and _name(side[at]) == name:
                        depth += -1 if side[at][0] == "/" else 1
                        if not depth:
                            j = at
                            break
            out.append(["?", side[i : j + 1]])
        i = j + 1
    return out


def _name(tag: str) -> str:
    return tag.partition(" ")[0].strip("/!")


def _first(group) -> str | None:
    while not _single(group):
        group = group[1][0] if group[1] else None
    return group


def simplify(nodes: list) -> list:
    """The same pages or more, in fewer groups: a group of one group becomes one, and from one group that may be absent to
    another that begins alike all become one that may repeat, in which each beginning is one group. So a wrapper does not grow
    longer than its host has different elements, however their order varies."""
    out: list = []
    run = 0  # where the groups that may be absent begin
    for n in nodes:
        if _single(n):
            out.append(n)
            run = len(out)
            continue
        flag, body = n[0], simplify(n[1])
        while len(body) == 1 and not _single(body[0]):
            flag, body = flag if flag == body[0][0] else "*", body[0][1]
        out.append([flag, body])
        if flag == "+":
            run = len(out)
            continue
        begins = {_first(m) for m in _members(out[-1])}
        for at in range(run, len(out) - 1):
            if any(_first(m) in begins for m in _members(out[at])):
                out[at:] = [_repeated([m for g in out[at:] for m in _members(g)])]
                break
    return out


def _members(group: list) -> list:
    """The groups that a repeated group of groups that may be absent consists of, else the group."""
    return group[1] if group[0] == "*" and all(not _single(m) and m[0] != "+" for m in group[1]) else [group]


def _repeated(groups: list) -> list:
    """All sequences of these groups, those that begin alike aligned."""
    found: dict = {}
    for flag, body in groups:
        if (begin := _first([flag, body])) in found:
            other = found[begin]
            same = [*map(_shape, other[1])] == [*map(_shape, body)]
            found[begin] = [flag if flag == other[0] else "*", [_join(x, y) for x, y in zip(other[1], body, strict=True)] if same else simplify(align(other[1], body))]
        else:
            found[begin] = [flag, body]
    return ["*", next(iter(found.values()))[1] if len(found) == 1 else list(found.values())]


def program(nodes: list) -> list:
    """Steps that match a wrapper: a tag is its string, a slot its number, (first, second) a choice, None the end."""
    steps: list = []
    slots = 0

    def put(body: list) -> None:
        nonlocal slots
        for n in body:
            if n is None:
                steps.append(slots)
                slots += 1
            elif isinstance(n, str):
                steps.append(n)
            else:
                begin = len(steps)
                if n[0] != "+":
                    steps.append(None)
                put(n[1])
                if n[0] == "+":
                    steps.append((begin, len(steps) + 1))
                else:
                    if n[0] == "*":
                        steps.append((begin, begin))
                    steps[begin] = (begin + 1, len(steps))

    put(nodes)
    steps.append(None)
    return steps


def places(steps: list, tags: list) -> list[int] | None:
    """The slots of a page's texts, None if the wrapper does not match it: the first way to match that repeats and fills groups
    where it can. No choice is tried twice at one place, so time is at most the steps times the tags."""
    n, seen, held = len(tags), set(), []
    left = [(0, 0, 0)]
    while left:
        step, at, size = left.pop()
        del held[size:]
        while True:
            s = steps[step]
            if isinstance(s, tuple):
                tried = step * (n + 1) + at
                if tried in seen:
                    break
                seen.add(tried)
                left.append((s[1], at, len(held)))
                step = s[0]
            elif s is None:
                if at == n:
                    return held
                break
            elif at == n or tags[at] != (s if isinstance(s, str) else None):
                break
            else:
                if tags[at] is None:
                    held.append(s)
                step, at = step + 1, at + 1
    return None


def grow(wrapper: list | None, streams: Iterable[list]) -> tuple[list | None, list[int]]:
    """A wrapper that matches what it matched and all streams, and the numbers of the streams that made it grow."""
    steps, grown = None if wrapper is None else program(wrapper), []
    for number, tags in enumerate(streams):
        if steps is not None and places(steps, tags) is not None:
            continue
        page = fold(tags)
        wrapper = page if wrapper is None else simplify(align(wrapper, page))
        steps = program(wrapper)
        grown.append(number)
    return wrapper, grown


def text_hash(source: str) -> int:
    return zlib.crc32(" ".join(source.split()).encode())


@dataclass
class Stream:
    """What inference knows of a page: its tags with None for texts, and of the texts whether they are content by tags, and hashes."""

    number: int
    tags: list[str | None]
    kinds: list[bool]
    hashes: list[int]


def stream(page: Page, number: int = 0) -> Stream:
    return Stream(number, page.tags, page.kinds, [text_hash(x) for x in page.texts])


class Tally:
    """Counts of pages and texts by slot; a page's numbers are [pages, texts, texts that are content by tags]."""

    def __init__(self):
        self.pages = 0
        self.slots: dict[int, list[int]] = {}
        self.texts: dict[tuple[int, int], int] = {}  # pages by slot and text

    def add(self, held: list[int], kinds: list[bool], hashes: list[int]) -> None:
        self.pages += 1
        for slot, content in zip(held, kinds, strict=True):
            counts = self.slots.setdefault(slot, [0, 0, 0])
            counts[1] += 1
            counts[2] += content
        for slot in set(held):
            self.slots[slot][0] += 1
        for key in set(zip(held, hashes, strict=True)):
            self.texts[key] = self.texts.get(key, 0) + 1

    def templates(self, rule: tuple[int, float, float]) -> set[tuple[int, int]]:
        least, host, slot = rule
        return {key for key, n in self.texts.items() if self.slots[key[0]][2] and n >= max(least, host * self.pages, slot * self.slots[key[0]][0])}


def infer(pages: list[Stream]) -> tuple[list, Tally]:
    """The wrapper of all pages, and their counts by its slots."""
    wrapper, _ = grow(None, (p.tags for p in pages))
    steps, tally = program(wrapper), Tally()
    for p in pages:
        tally.add(places(steps, p.tags), p.kinds, p.hashes)
    return wrapper, tally


def compiled(found: tuple[list, Tally]) -> str:
    wrapper, tally = found
    strong, weak = tally.templates(STRONG), tally.templates(WEAK)
    return written(wrapper, {k for k, c in tally.slots.items() if c[1] == c[2]}, {k for k, _ in weak}, {t for _, t in strong}, {t for _, t in weak})


def written(wrapper: list, content: Iterable[int], template: Iterable[int], always: Iterable[int], mostly: Iterable[int]) -> str:
    """A wrapper as text: its nodes, the slots that are content and those that may hold template, and the template's texts by STRONG and by WEAK."""
    return json.dumps([wrapper, sorted(content), sorted(template), sorted(always), sorted(mostly)], separators=(",", ":"))


@lru_cache(maxsize=4096)
def _loaded(wrapper: str):
    nodes, *sets = json.loads(wrapper)
    return program(nodes), *map(frozenset, sets)


def _line(tags: list[str | None]) -> str:
    return "\x1f".join("T" if t is None else t for t in tags)


def _tags(line: str) -> list[str | None]:
    return [None if t == "T" else t for t in line.split("\x1f")] if line else []


@lru_cache(maxsize=1024)
def _places(wrapper: str, line: str) -> list[int] | None:
    """`places` of a page written as one line, by a wrapper as text; many pages of a host have the same tags."""
    return places(_loaded(wrapper)[0], _tags(line))


def extract(page: Page, wrapper: str | None) -> tuple[str, bool]:
    """The main text, and whether the wrapper matched."""
    held = None if wrapper is None else _places(wrapper, _line(page.tags))
    if held is None:
        return page.text(page.kinds), False
    _, content, template, always, mostly = _loaded(wrapper)
    kinds = [slot in content or k for slot, k in zip(held, page.kinds, strict=True)]
    known = always if page.strong else mostly
    left = [k and not (slot in template and text_hash(x) in known) for k, slot, x in zip(kinds, held, page.texts, strict=True)]
    size = lambda which: sum(len(x) for x, k in zip(page.texts, which, strict=True) if k)
    return page.text(left if 2 * size(left) >= size(kinds) else kinds), True


def host_of(url: str = "url"):
    return F.coalesce(F.lower(F.regexp_extract(F.col(url).cast("string"), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def streams_of(pages: DataFrame) -> DataFrame:
    """(host, h, tags, texts) of every different page: its tags in one line, and of each text its hash times two, one more if it is content by tags."""

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        read = [stream(Page(h)) for h in column(batch, "html").to_pylist()]
        texts = [[2 * h + k for h, k in zip(s.hashes, s.kinds, strict=True)] for s in read]
        return pa.RecordBatch.from_arrays(
            [column(batch, "host"), column(batch, "h"), pa.array([_line(s.tags) for s in read], pa.string()), pa.array(texts, pa.list_(pa.int64()))], names=["host", "h", "tags", "texts"]
        )

    # Copies of a page show no template: pages with the same html count once.
    chosen = pages.select("host", "html", F.xxhash64("html").alias("h"))
    return map_batches(chosen, kernel, "host string, h long, tags string, texts array<long>").distinct()


def _matching(spark: SparkSession, frame: DataFrame, found: DataFrame):
    """The frame, joined with the wrappers of its hosts if these are too large to broadcast, and what gives a batch's wrappers."""
    if found.agg(F.coalesce(F.sum(F.length("wrapper") + F.length("host")), F.lit(0))).first()[0] > BROADCAST_BYTES:
        return frame.join(found, "host", "left"), lambda batch: column(batch, "wrapper").to_pylist()
    shared = spark.sparkContext.broadcast({r.host: r.wrapper for r in found.collect()})
    return frame, lambda batch: [shared.value.get(h) for h in column(batch, "host").to_pylist()]


def grown(spark: SparkSession, streams: DataFrame, width: int | None = None) -> DataFrame:
    """(host, wrapper): for each host of (host, tags) a wrapper, without counts, that matches all its streams."""

    def widen(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["order", "tags"])
        begun = group["wrapper"].iloc[0]
        wrapper, numbers = grow(None if begun is None else json.loads(begun)[0], map(_tags, group["tags"]))
        if group["last"].iloc[0]:
            return pd.DataFrame({"host": group["host"].iloc[:1], "wrapper": [written(wrapper, (), (), (), ())], "tags": [None]})
        return pd.DataFrame({"host": group["host"].iloc[0], "wrapper": None, "tags": group["tags"].iloc[numbers]}, columns=["host", "wrapper", "tags"])

    found, left = None, streams
    while True:
        size, parts, divided = width or STREAMS, [], None
        while True:
            large = stage(spark, left.groupBy("host").agg(F.count("*").alias("n")).where(F.col("n") > size), "large")
            dealt = left.join(F.broadcast(large), "host", "left").withColumn("order", F.xxhash64("tags")).withColumn("last", F.col("n").isNull())
            dealt = dealt.withColumn("bucket", F.when(F.col("last"), 0).otherwise(F.pmod(F.xxhash64("order"), F.ceil(F.col("n") / size))).cast("long")).drop("n")
            dealt = dealt.withColumn("wrapper", F.lit(None).cast("string")) if found is None else dealt.join(found, "host", "left")
            out = stage(spark, dealt.groupBy("host", "bucket").applyInPandas(widen, "host string, wrapper string, tags string"), "grown")
            parts.append(out.where("wrapper is not null").select("host", "wrapper"))
            divided = divided or large
            if large.isEmpty():
                break
            left, size = out.where("wrapper is null").select("host", "tags"), 2 * size
        new = reduce(DataFrame.unionAll, parts)
        found = new if found is None else stage(spark, new.unionAll(found.join(new, "host", "left_anti")), "wrappers")
        if divided.isEmpty():
            return found  # one task saw all streams of a host
        frame, wrappers_of = _matching(spark, streams.join(F.broadcast(divided.select("host")), "host", "left_semi"), found)

        def missed(batch: pa.RecordBatch) -> pa.RecordBatch:
            lines = column(batch, "tags").to_pylist()
            return batch.select(["host", "tags"]).filter(pa.array([places(_loaded(w)[0], _tags(x)) is None for w, x in zip(wrappers_of(batch), lines, strict=True)]))  # noqa: B023

        left = stage(spark, map_batches(frame, missed, "host string, tags string"), "missed")
        if left.isEmpty():
            return found


def counted(spark: SparkSession, pages: DataFrame, found: DataFrame) -> DataFrame:
    """(host, slot, text, pages, texts, content): all pages of `streams_of` counted by the slots of their hosts' wrappers. Rows without a text
    are of whole slots, and of the host if they have no slot either; texts are there if WEAK pages or more have them."""
    frame, wrappers_of = _matching(spark, pages, found)

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        tallies: dict[str, Tally] = {}
        columns = [column(batch, name).to_pylist() for name in ("host", "tags", "texts")]
        for host, line, texts, wrapper in zip(*columns, wrappers_of(batch), strict=True):
            tallies.setdefault(host, Tally()).add(_places(wrapper, line), [bool(t & 1) for t in texts], [t >> 1 for t in texts])
        rows = [(host, None, None, t.pages, 0, 0) for host, t in tallies.items()]
        rows += [(host, slot, None, *counts) for host, t in tallies.items() for slot, counts in t.slots.items()]
        rows += [(host, slot, text, n, 0, 0) for host, t in tallies.items() for (slot, text), n in t.texts.items()]
        types = [pa.string(), *[pa.int64()] * 5]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["host", "slot", "text", "pages", "texts", "content"])

    partial = map_batches(frame, kernel, "host string, slot long, text long, pages long, texts long, content long")
    sums = partial.groupBy("host", "slot", "text").agg(*(F.sum(c).alias(c) for c in ("pages", "texts", "content")))
    return sums.where((F.col("text").isNull()) | (F.col("pages") >= WEAK[0]))


def wrappers(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """(host, wrapper): one regular expression for each host of two different pages or more, inferred from all of them."""
    source = stage(spark, streams_of(pages), "streams")
    found = grown(spark, stage(spark, source.select("host", "tags").distinct(), "tags"))
    counts = stage(spark, counted(spark, source, found), "counts")
    # One page shows no template: there is nothing to align it with.
    hosts = counts.where("slot is null").where("pages > 1").select("host", F.col("pages").alias("n"))
    slots = counts.where("slot is not null and text is null").select("host", "slot", F.col("pages").alias("filled"), "texts", "content")
    rule = lambda least, host, slot: F.col("pages") >= F.greatest(F.lit(float(least)), host * F.col("n"), slot * F.col("filled"))
    often = counts.where("text is not null").select("host", "slot", "text", "pages").join(hosts, "host").where(F.col("pages") >= WEAK[1] * F.col("n"))
    template = often.join(slots.where("content > 0").select("host", "slot", "filled"), ["host", "slot"]).where(rule(*WEAK)).withColumn("strong", rule(*STRONG))
    template = template.groupBy("host").agg(F.collect_set("slot").alias("template"), F.collect_set(F.when(F.col("strong"), F.col("text"))).alias("always"), F.collect_set("text").alias("mostly"))
    content = slots.groupBy("host").agg(F.collect_set(F.when(F.col("content") == F.col("texts"), F.col("slot"))).alias("content"))

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        columns = [column(batch, name).to_pylist() for name in ("wrapper", "content", "template", "always", "mostly")]
        done = [written(json.loads(w)[0], *(x or () for x in sets)) for w, *sets in zip(*columns, strict=True)]
        return pa.RecordBatch.from_arrays([column(batch, "host"), pa.array(done, pa.string())], names=["host", "wrapper"])

    return map_batches(found.join(hosts.select("host"), "host").join(content, "host", "left").join(template, "host", "left"), kernel, "host string, wrapper string")


def main_text(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars, matched for every page."""
    source = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].cast("string").alias("url"), F.coalesce(pages["html"].cast("string"), F.lit("")).alias("html"))
    source = source.withColumn("host", host_of())
    joined, wrappers_of = _matching(spark, source, stage(spark, wrappers(spark, source), "wrappers"))

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = [extract(Page(h), w) for h, w in zip(column(batch, "html").to_pylist(), wrappers_of(batch), strict=True)]
        texts = [t for t, _ in out]
        return pa.RecordBatch.from_arrays(
            [column(batch, "page_id"), column(batch, "url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array([m for _, m in out])],
            names=["page_id", "url", "text", "n_chars", "matched"],
        )

    return map_batches(joined, kernel, "page_id long, url string, text string, n_chars long, matched boolean")
