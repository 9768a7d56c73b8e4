"""HTML main text by wrapper induction over pages of one host.

A page is a tree of its blocks; inline markup is text. Its outline is that tree without texts. All different outlines of a
host are aligned one after the other by simple tree matching (Yang, 1991) with a running wrapper: nodes that match are one
slot of it, what is new is put in where it stands. They are dealt to parts by hash, each part's wrapper is an outline
again, and these are merged in the same way until there is one. Then all of the host's pages are aligned with the wrapper, and vote: a text that is constant in SHARE of
the pages that have its slot is template; the rest of a slot's text varies, and each page says which share of its text is
in which slot. A page's article is where its layout's varying text is, by the votes for the slots that the page has and in
the page's own order: from the root downwards while one slot has most of it, unless a varying heading would be left
behind. Slots that a page doesn't have are other layouts' and have no say, so a layout of few pages keeps its articles
whatever the host's others are. A page's text is what it has in the article's slot, without template, furniture (menus,
headers, footers, sidebars, notices, adverts, forms, reader comments) and, where the article has no element of its own
but stands in the body, without what little comes before its heading. A page that has more text in places that the
most of its host's pages don't have is of a layout that places it badly: its article is looked for in its own
tree, with the host's template left out.

Hosts with fewer than LEAST_PAGES different pages share a wrapper with the other such hosts of their domain (the last
two labels; three below a country's general second level). Customers of a blog host are such hosts of one domain. Pages without a host, or whose group still has fewer, are judged by their own tree and tags alone. Where
template would be most of a page's text and no heading of its own is left, most of its host are near copies of it, and it
keeps all.

Tags such as nav or footer are furniture, a header with a heading inside the article is not. Names in class, id or role
only break ties: they mark furniture where a slot has less than half of the article's text, and never body, main,
article, paragraphs or headings, but for names of adverts.

Defined results: null or empty html gives an empty text; equal pages of a host give equal texts; unclosed and misnested
tags are closed where the next block begins; a quote that never ends doesn't hide what follows; columns besides ``url``
and ``html`` are carried along, result columns replace those of the same names.
"""

from __future__ import annotations

import hashlib
import html as entities
import json
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronopanel.llm.common import dropped, sized, written
from chronopanel.llm.urls import host_and_path

#: Different outlines of a group, on average, that one task merges at a time.
FAN = 16
#: A group has a wrapper from so many different pages on. A text is template if so many pages at least have it, and this
#: share of those with its slot; a page that would be template but for less than so much of its text is a copy.
LEAST_PAGES, LEAST_EQUAL, SHARE, LEAST_VARYING = 3, 3, 0.8, 0.5
#: A slot is entered while it has so much of the varying text; slots of so many of the pages are common.
MOST, COMMON = 0.6, 0.5
#: Pages that are added to a slot's when its mean share is taken, so that a slot of few pages has little say; what stands
#: before the heading of an article without an element goes only if it has less than so much of the varying text.
FEW, SMALL = 2, 0.2

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg select object canvas".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure"
    " footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary table tbody td tfoot th"
    " thead tr ul".split()
)
#: Elements that are never text of the article.
FURNITURE = frozenset("nav header footer aside form menu dialog button label input fieldset head".split())
#: Names in class, id or role: of adverts, of other furniture, and of what may be a part of an article as well.
ADVERTS = frozenset("ad ads adv advert adverts advertisement advertising sponsor sponsored sponsors".split())
MARKS = ADVERTS | frozenset(
    "nav navbar navigation menus breadcrumb breadcrumbs masthead footer sidebar aside related recommended"
    " recommendations share sharing comment comments discussion disqus replies respond cookie cookies consent gdpr"
    " popup modal overlay newsletter subscription pagination pager complementary contentinfo".split()
)
AMBIGUOUS = frozenset(
    "header promo promotion banner menu widget social reply notice notices notification alert subscribe signup login"
    " search toolbar dialog form".split()
)
OTHERWISE = frozenset("no not non with without has have is hide show".split())
#: Elements that no name marks, those that only an advert's name does, and those that are not entered for the article.
ARTICLE = frozenset("html body main article".split())
PLAIN = frozenset("p h1 h2 h3 h4 h5 h6 li td th tr tbody thead tfoot caption pre dt dd figcaption".split())
LEAVES = PLAIN | frozenset("blockquote ul ol dl table".split())
HEADINGS = frozenset(("h1", "h2", "h3"))
_NAME = re.compile(r"/?([a-zA-Z][^\s/>]*)")
# An attribute's quotes may hold anything; nothing is read twice but the last quote of each kind.
_REST = re.compile(r"((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)>")
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_PART = re.compile(r"[a-z0-9]+")
_DIGITS = re.compile(r"\d+")


class Shape:
    """The tree below a node without its texts; runs of equal siblings count once. Equal trees are one object."""

    __slots__ = ("kids", "label", "number", "size")


class Shapes:
    """Makes equal shapes one object, and aligns them by simple tree matching."""

    def __init__(self):
        self.table: dict[tuple, Shape] = {}
        self.known: dict[tuple[int, int], int] = {}
        self.made = 0

    def of(self, label: str, kids: list[Shape]) -> Shape:
        runs = tuple(k for i, k in enumerate(kids) if not i or k is not kids[i - 1])
        key = (label, *[k.number for k in runs])
        found = self.table.get(key)
        if found is None:
            if len(self.table) > 500_000:  # numbers are never used again, so what was known stays true
                self.table.clear()
            found = self.table[key] = Shape()
            self.made += 1
            found.label, found.kids, found.number, found.size = label, runs, self.made, 1 + sum(k.size for k in runs)
        return found

    def weight(self, a: Shape, b: Shape) -> int:
        """Nodes in the greatest matching that keeps labels, order and parents."""
        todo = [(a, b)] if self.seen(a, b) is None else []
        while todo:
            x, y = todo[-1]
            missing = [
                (p, q) for p in dict.fromkeys(x.kids) for q in dict.fromkeys(y.kids) if x.label == y.label and self.seen(p, q) is None
            ]
            if missing and self.seen(x, y) is None:
                todo += missing
                continue
            todo.pop()
            if self.seen(x, y) is None:
                self.known[x.number, y.number] = 1 + sum(self.seen(x.kids[i], y.kids[j]) for i, j in self.match(x.kids, y.kids))
        return self.seen(a, b)

    def seen(self, a: Shape, b: Shape) -> int | None:
        if a.label != b.label:
            return 0
        return a.size if a is b else self.known.get((a.number, b.number))

    def match(self, x: tuple[Shape, ...], y: tuple[Shape, ...]) -> list[tuple[int, int]]:
        """The best alignment of two lists in order, all weights known: divide and conquer, so memory is linear."""
        lead = 0
        while lead < min(len(x), len(y)) and x[lead] is y[lead]:
            lead += 1
        tail = 0
        while tail < min(len(x), len(y)) - lead and x[-1 - tail] is y[-1 - tail]:
            tail += 1
        out = [(i, i) for i in range(lead)] + [(len(x) - 1 - i, len(y) - 1 - i) for i in range(tail)]
        if min(len(x), len(y)) == lead + tail:
            return sorted(out)
        if len(x) == len(y) == lead + tail + 1:
            return sorted([*out, (lead, lead)] if self.seen(x[lead], y[lead]) else out)
        kinds = list(dict.fromkeys(y[lead : len(y) - tail]))
        place = {k: i for i, k in enumerate(kinds)}
        index = np.array([place[k] for k in y[lead : len(y) - tail]], dtype=np.int64)
        rows: dict[Shape, np.ndarray] = {}

        def row(p: Shape) -> np.ndarray:
            if p not in rows:
                rows[p] = np.array([self.seen(p, q) for q in kinds], dtype=np.int64)
            return rows[p][index]

        def best(p: list[Shape], a: int, b: int, back: bool) -> np.ndarray:
            """Greatest weight of p with the first 0, 1, ... of y[a:b], or with the last."""
            step = -1 if back else 1
            score = np.zeros(b - a + 1, dtype=np.int64)
            for k in p[::step]:
                score[1:] = np.maximum(score[1:], score[:-1] + row(k)[a:b][::step])
                np.maximum.accumulate(score, out=score)
            return score

        todo = [(lead, len(x) - tail, 0, len(index))]
        while todo:
            i, j, a, b = todo.pop()
            if i >= j or a >= b:
                continue
            if j - i == 1:
                weights = row(x[i])[a:b]
                at = int(weights.argmax())
                if weights[at] > 0:
                    out.append((i, lead + a + at))
                continue
            mid = (i + j) // 2
            cut = a + int((best(x[i:mid], a, b, False) + best(x[mid:j], a, b, True)[::-1]).argmax())
            todo += [(i, mid, a, cut), (mid, j, cut, b)]
        return sorted(out)

    def children(self, a: Shape, b: Shape) -> list[tuple[int, int]]:
        """Places of children that match, of two trees whose roots do."""
        if len(self.known) > 1_000_000:
            self.known.clear()
        for p in dict.fromkeys(a.kids):
            for q in dict.fromkeys(b.kids):
                self.weight(p, q)
        return self.match(a.kids, b.kids)


shapes = Shapes()


class Node:
    """A block, or with tag ``#`` a run of text in one."""

    __slots__ = ("dull", "hinted", "kids", "label", "links", "marked", "named", "shape", "slot", "tag", "template", "text")

    def __init__(self, tag: str, label: str):
        self.tag, self.label, self.kids = tag, label, []
        self.text, self.links = "", 0  # characters within links
        # Furniture by tag or unseen, by its names, perhaps by its names; template; in a common place outside the article.
        self.marked = self.named = self.hinted = self.template = self.dull = False
        self.shape, self.slot = None, -1


def _attributes(raw: str) -> tuple[str, bool, bool, set[str], bool]:
    """Class; whether names mark furniture, whether they may; the names; whether it is unseen."""
    if "=" not in raw and "hidden" not in raw:
        return "", False, False, set(), False
    found = {}
    for name, *values in _ATTRIBUTE.findall(raw):
        found.setdefault(name.lower(), next((v for v in values if v), ""))
    unseen = "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", "").lower()
    own = {n for k in ("class", "role") for n in found.get(k, "").lower().split()}
    names = own | set(found.get("id", "").lower().split())
    parts = [p for p in map(_PART.findall, names - MARKS - AMBIGUOUS) if p and p[0] not in OTHERWISE]
    hinted = any(not MARKS.isdisjoint(p) or not AMBIGUOUS.isdisjoint(p) for p in parts)
    return found.get("class", ""), bool(names & MARKS or own & AMBIGUOUS), hinted or bool(names & AMBIGUOUS), names, unseen


def _open(tag: str, raw: str) -> Node | None:
    """A node for a start tag, or none for markup within a block."""
    name, marked, hinted, names, unseen = _attributes(raw)
    if tag in ARTICLE:
        marked, hinted, unseen, name = False, False, unseen and tag not in ("html", "body"), ""
    elif tag in PLAIN:
        marked, hinted = not names.isdisjoint(ADVERTS), False
    elif tag == "section" and not names.isdisjoint(AMBIGUOUS) and names.isdisjoint(MARKS):
        marked, hinted = False, False
    if tag not in BLOCKS and tag not in FURNITURE and not marked and not unseen:
        return None  # names that only may mark furniture don't mark inline elements
    node = Node(tag, f"{tag}.{_DIGITS.sub('', name)}" if name else tag)
    # Some sites put a form around the whole page.
    node.marked, node.named = unseen or (tag in FURNITURE and tag != "form"), marked
    node.hinted = not marked and (hinted or tag == "form")
    return node


def parse(page: str) -> Node:
    """The tree of blocks and texts. A block ends an open paragraph, an end tag closes what it can. Linear in the page."""
    root = Node("html", "html")
    stack, count = [root], Counter(["html"])
    texts: list[Node] = []
    at = pos = link = 0
    quoted = True

    def add(raw: str) -> None:
        top = stack[-1]
        if not top.kids or top.kids[-1].tag != "#":
            if not raw.strip() and (not top.kids or top.kids[-1].tag in BLOCKS):
                return
            node = Node("#", "#")
            node.text = []
            top.kids.append(node)
            texts.append(node)
        node = top.kids[-1]
        node.text.append(raw)
        if link:
            node.links += len(raw.strip())

    def close(n: int) -> None:
        for node in stack[n:]:
            count[node.tag] -= 1
        del stack[n:]

    while (lt := page.find("<", pos)) >= 0:
        pos = lt + 1
        if page.startswith(("!", "?"), pos):
            if at < lt:
                add(page[at:lt])
            ends = ("-->", lt + 4) if page.startswith("!--", pos) else ("]]>", pos) if page.startswith("![CDATA[", pos) else (">", pos)
            end = page.find(*ends)
            at = pos = len(page) if end < 0 else end + len(ends[0])
            continue
        name = _NAME.match(page, pos)
        if not name:
            continue
        rest = _REST.match(page, name.end()) if quoted else None
        if rest is None:  # a quote that never ends, or no end at all: from here on quotes are characters
            quoted = False
            end = page.find(">", name.end())
            if end < 0:
                break
            raw, end = page[name.end() : end], end + 1
        else:
            raw, end = rest[1], rest.end()
        if at < lt:
            add(page[at:lt])
        at = pos = end
        tag = name[1].lower()
        if tag == "html":
            continue
        if tag == "a":
            link = page[lt + 1] != "/"
        if page[lt + 1] == "/":
            if count[tag]:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag == tag:
                        close(i)
                        break
                    if stack[i].tag in BLOCKS and tag not in BLOCKS:
                        break
            continue
        closed = raw.endswith("/")
        if tag in RAW:  # its inside is no markup; one that never ends holds the rest of the page
            if not closed:
                end = _raw_end(tag).search(page, at)
                at = pos = end.end() if end else len(page)
            continue
        if tag == "br":
            add(" ")
            continue
        if tag in BLOCKS:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == "p" or (stack[i].tag == tag and tag in ("li", "dt", "dd", "tr", "td", "th")):
                    close(i)
                    break
                if stack[i].tag in BLOCKS:
                    break
        node = _open(tag, raw)
        if node is None:
            continue
        stack[-1].kids.append(node)
        if tag not in VOID and not closed:
            stack.append(node)
            count[tag] += 1
    if at < len(page):
        add(page[at:])
    for node in texts:
        node.text = entities.unescape("".join(node.text))
    return root


@lru_cache(maxsize=64)
def _raw_end(tag: str) -> re.Pattern:
    return re.compile(f"</{re.escape(tag)}\\s*>", re.I)


def walk(root: Node) -> list[Node]:
    """All nodes, parents before their children."""
    order, todo = [], [root]
    while todo:
        n = todo.pop()
        order.append(n)
        todo += reversed(n.kids)
    return order


def shape(root: Node) -> Shape:
    """Give each node its shape; without recursion, as pages may nest deeply."""
    for n in reversed(walk(root)):
        n.shape = shapes.of(n.label, [k.shape for k in n.kids])
    return root.shape


class Slot:
    """A node of a wrapper."""

    __slots__ = ("kids", "label", "number", "shape", "up")

    def __init__(self, label: str, up: Slot | None):
        self.label, self.up, self.kids, self.number, self.shape = label, up, [], 0, None

    @property
    def tag(self) -> str:
        return self.label.split(".", 1)[0]


class Place(NamedTuple):
    """Where a layout's article is: its slot, the slots above it, those before its heading, those with half its text."""

    article: int
    spine: frozenset[int]
    before: frozenset[int]
    heavy: frozenset[int]


class Wrapper:
    """The running wrapper of a group's pages, and what their votes say of its slots."""

    def __init__(self):
        self.root = Slot("html", None)
        self.slots: list[Slot] = [self.root]
        self.pairs: dict[tuple[int, int], list[Slot | None]] = {}
        self.article: Slot | None = None
        self.common: set[int] = set()
        self.template: set[int] = set()
        self.weight: dict[int, float] = {}
        self.count: dict[int, int] = {}
        self.found: dict[tuple[int, ...], Place] = {}

    def settle(self) -> None:
        """Number the slots and find their shapes."""
        self.slots, todo = [], [self.root]
        while todo:
            s = todo.pop()
            s.number = len(self.slots)
            self.slots.append(s)
            todo += reversed(s.kids)
        for s in reversed(self.slots):
            s.shape = shapes.of(s.label, [k.shape for k in s.kids])
        self.pairs.clear()

    def aligned(self, given: Shape, slot: Slot) -> list[Slot | None]:
        """For each run of equal children of a shape, the child of the slot that it matches."""
        key = (given.number, slot.number)
        if key not in self.pairs:
            runs = [i for i, k in enumerate(slot.kids) if not i or k.shape is not slot.kids[i - 1].shape]
            out: list[Slot | None] = [None] * len(given.kids)
            for i, j in shapes.children(given, slot.shape):
                out[i] = slot.kids[runs[j]]
            if len(self.pairs) > 200_000:
                self.pairs.clear()
            self.pairs[key] = out
        return self.pairs[key]

    def learn(self, tree: Shape) -> None:
        """Take a page's nodes in: those that match are known, others are put in after what stands before them."""
        self.settle()
        todo = [(tree, self.root)]
        while todo:
            given, slot = todo.pop()
            found = self.aligned(given, slot) if slot.shape else [None] * len(given.kids)
            kids, after = list(slot.kids), 0
            for k, match in zip(given.kids, found, strict=True):
                if match is None:
                    match = Slot(k.label, slot)
                    kids.insert(after, match)
                after = kids.index(match, max(after - 1, 0)) + 1
                todo.append((k, match))
            slot.kids = kids
        self.settle()

    def place(self, root: Node) -> None:
        """Give each node of a page its slot's number, or -1."""
        shape(root)
        root.slot, todo = 0, [root]
        while todo:
            n = todo.pop()
            if not n.kids:
                continue
            found, run, last = self.aligned(n.shape, self.slots[n.slot]), -1, None
            for k in n.kids:
                if k.shape is not last:
                    run, last = run + 1, k.shape
                if found[run] is not None:
                    k.slot = found[run].number
                    todo.append(k)

    def decide(self, seen: dict[int, tuple[int, float, float]], n_pages: int, template: set[int]) -> None:
        """From the pages that have each slot and the varying and all shares of text there: what is template, and how much
        of a page's varying text is in a slot where a page has it.

        Where most of the text is constant and no heading varies, the pages are near copies: then nothing is template.
        """
        slots = [seen.get(s.number, (0, 0.0, 0.0)) for s in self.slots]
        titles = [slots[s.number] for s in self.slots if s.up and s.up.tag in HEADINGS]
        copies = bool(titles) and not any(t[1] > 0 for t in titles)
        copies &= sum(t[1] for t in slots) < LEAST_VARYING * sum(t[2] for t in slots)
        self.template = set() if copies else template
        self.common = {i for i, (n, *_) in seen.items() if n >= COMMON * n_pages}
        self.count = {i: n for i, (n, *_) in seen.items()}
        self.weight = {i: t[1 + copies] / (t[0] + FEW) for i, t in seen.items() if t[1 + copies] > 0}
        self.found.clear()
        # The layout of most pages: their common slots, and what these are in.
        held = set(self.common)
        for s in reversed(self.slots):
            if s.up and s.number in held:
                held.add(s.up.number)
        self.article = self.slots[self.place_of(tuple(s.number for s in self.slots if s.number in held or not s.number)).article]

    @property
    def spine(self) -> frozenset[int]:
        """The article of most pages' layout, and what it is in."""
        up, out = self.article, set()
        while up:
            out.add(up.number)
            up = up.up
        return frozenset(out)

    def place_of(self, order: tuple[int, ...]) -> Place:
        """Where the article of a page is that has these slots, in its own order. Slots of other layouts have no say."""
        if order not in self.found:
            if len(self.found) > 10_000:
                self.found.clear()
            self.found[order] = self._place_of(order)
        return self.found[order]

    def _place_of(self, order: tuple[int, ...]) -> Place:
        mass, headed, kids = {i: self.weight.get(i, 0.0) for i in order}, set(), {i: [] for i in order}
        for i in order[1:]:
            kids[self.slots[i].up.number].append(i)
        for i in reversed(order[1:]):
            up = self.slots[i].up.number
            mass[up] += mass[i]
            if mass[i] > 0 and (i in headed or self.slots[i].tag in HEADINGS):
                headed |= {i, up}
        node = order[0]
        while kids[node]:
            most = max(kids[node], key=lambda k: mass[k])
            tag = self.slots[most].tag
            if mass[most] < MOST * mass[node] or not mass[most] or tag in LEAVES or tag == "#":
                break
            if headed & set(kids[node][: kids[node].index(most)]):
                break
            node = most
        spine, up = set(), self.slots[node]
        while up:
            spine.add(up.number)
            up = up.up
        heavy = {i for i in order if 2 * mass[i] >= mass[node] > 0}
        before: set[int] = set()
        if self.slots[node].tag in ("html", "body"):
            titles = {i: self.count.get(i, 0) for i in order if self.slots[i].up and self.slots[i].up.tag == "h1" and mass[i] > 0}
            title = {i for i, n in titles.items() if n >= LEAST_PAGES and n >= COMMON * max(titles.values())}
            while title and not title & set(kids[node]):
                title = {self.slots[i].up.number for i in title if self.slots[i].up}
            first = next((n for n, i in enumerate(kids[node]) if i in title), 0)
            before = {i for i in kids[node][:first] if self.slots[i].tag not in PLAIN and self.slots[i].tag != "#" and mass[i] < SMALL * mass[node]}
        return Place(node, frozenset(spine), frozenset(before), frozenset(heavy))

    def dump(self) -> str:
        depth = {}
        tree = []
        for s in self.slots:
            depth[s.number] = depth[s.up.number] + 1 if s.up else 0
            tree.append([s.label, depth[s.number]])
        stats = [[i, self.count[i], self.weight.get(i, 0.0)] for i in sorted(self.count)]
        return json.dumps({"tree": tree, "article": self.article.number if self.article else None, "common": sorted(self.common),
                           "template": sorted(self.template), "stats": stats})

    @staticmethod
    def load(said: str) -> Wrapper:
        given, w = json.loads(said), Wrapper()
        path: list[Slot] = []
        for label, depth in given["tree"]:
            del path[depth:]
            slot = Slot(label, path[-1] if path else None)
            if path:
                path[-1].kids.append(slot)
            else:
                w.root = slot
            path.append(slot)
        w.settle()
        w.article = None if given["article"] is None else w.slots[given["article"]]
        w.common, w.template = set(given["common"]), set(given["template"])
        w.count, w.weight = {i: n for i, n, _ in given["stats"]}, {i: x for i, _, x in given["stats"] if x > 0}
        return w


def outline(page: str) -> str:
    """A page's tree without its texts, runs of equal siblings once: the wrapper of this page alone, before any vote."""
    return learned([shape(parse(page))]).dump()


def learned(trees: list[Shape]) -> Wrapper:
    """The running wrapper of trees in the order given, before any vote."""
    w = Wrapper()
    for tree in trees:
        w.learn(tree)
    w.settle()
    return w


def merged(outlines: list[str]) -> str:
    """The outline of a wrapper that has what all of these have, in whatever order they are given."""
    return outlines[0] if len(outlines) == 1 else learned([Wrapper.load(o).root.shape for o in sorted(outlines)]).dump()


def furniture(node: Node, inside: bool) -> bool:
    """Whether a subtree is no part of the article. An article's own header with its heading is."""
    if not node.marked and not node.named:
        return False
    if inside and (node.tag == "header" or _header(node)):
        return not any(n.tag in ("h1", "h2") for n in walk(node))
    return True


def _header(node: Node) -> bool:
    parts = _PART.findall(node.label.lower())
    return not node.marked and "header" in parts and MARKS.isdisjoint(parts)


def leaves(root: Node, places: set[int] | frozenset = frozenset()) -> list[tuple[Node, bool]]:
    """A page's texts outside furniture, and whether each is in a heading. ``places``: ids of nodes where the article is."""
    out, todo = [], [(root, False, False)]
    while todo:
        n, inside, heading = todo.pop()
        if n.tag == "#":
            out.append((n, heading))
            continue
        inside, heading = inside or n.tag in ("article", "main") or id(n) in places, heading or n.tag in HEADINGS
        todo += [(k, inside, heading) for k in reversed(n.kids) if not furniture(k, inside)]
    return out


def voting(root: Node) -> list[Node]:
    """A page's texts but those in elements that are furniture by their tag: names don't count in votes."""
    out, todo = [], [root]
    while todo:
        n = todo.pop()
        if n.tag == "#":
            out.append(n)
        todo += [k for k in n.kids if not k.marked or (k.tag == "header" and not furniture(k, True))]
    return out


def _key(slot: int, text: str) -> int:
    """A text in its slot."""
    raw = f"{slot}\0{' '.join(text.split())}".encode("utf-8", "replace")
    return int.from_bytes(hashlib.blake2b(raw, digest_size=8).digest(), "big", signed=True)


def votes(page: str, wrapper: Wrapper) -> list[tuple[int, int, float]]:
    """Slots, keys and shares of a page's different texts; slot -1 for what the wrapper hasn't got."""
    root = parse(page)
    wrapper.place(root)
    found: dict[tuple[int, int], float] = {}
    total = 0
    for n in voting(root):
        length = max(len(n.text.strip()) - n.links, 0)
        total += length
        key = (n.slot, _key(n.slot, n.text))
        found[key] = found.get(key, 0) + length
    return sorted((s, k, v / max(total, 1)) for (s, k), v in found.items())


def core(ballot: list[tuple[int, int, float]]) -> int:
    """Pages that vote alike are copies, whatever their furniture."""
    raw = repr([(s, k) for s, k, _ in ballot]).encode()
    return int.from_bytes(hashlib.blake2b(raw, digest_size=8).digest(), "big", signed=True)


def _settle(root: Node, place: Place | None = None) -> None:
    """Names that only may mark furniture do, unless the element holds most of the text and what is named its article.

    Where the wrapper knows the element's slot, most of the host's text counts, and it is never where the article is.
    """
    order = walk(root)
    if place:
        for n in order:
            if n.slot in place.spine or n.slot in place.heavy:
                n.hinted = n.named = False
    if not any(n.hinted for n in order):
        return
    held: dict[int, tuple[int, int]] = {}
    for n in reversed(order):
        below = [held[id(k)] for k in n.kids if not k.marked and not k.named]
        named = n.tag in ("h1", "main", "article")
        held[id(n)] = len(n.text.strip()) + sum(h[0] for h in below), named + sum(h[1] for h in below)
    length, named = held[id(root)]
    for n in order:
        if n.hinted:
            n.named = not (2 * held[id(n)][0] > length and (held[id(n)][1] > 0 or not named))


def content_length(root: Node) -> dict[int, int]:
    """Characters below each node, by id, that are neither furniture nor template nor the host's."""
    order, todo, out = [], [(root, False)], {}
    while todo:
        n, inside = todo.pop()
        order.append(n)
        inside = inside or n.tag in ("article", "main")
        todo += [(k, inside) for k in n.kids if not furniture(k, inside)]
    for n in reversed(order):
        own = 0 if n.template or n.dull or n.tag != "#" else len(n.text.strip())
        out[id(n)] = own + sum(out.get(id(k), 0) for k in n.kids)
    return out


def own_article(root: Node) -> Node:
    """The element that holds the article, by the page alone: downwards while one child has most of the text."""
    amount, node = content_length(root), root
    while True:
        named = [k for k in node.kids if k.tag in ("article", "main") and amount.get(id(k), 0) > 0]
        # An element named as the article is it if it is the only one, or has most of the text.
        nxt = next((k for k in named if len(named) == 1 or 2 * amount[id(k)] > amount[id(node)]), None)
        if nxt is None:
            inner = [k for k in node.kids if k.tag in BLOCKS and id(k) in amount]
            nxt = max(inner, key=lambda k: amount[id(k)], default=None)
            if nxt is None or not amount[id(nxt)] or amount[id(nxt)] < MOST * amount[id(node)] or nxt.tag in LEAVES:
                return node
            if any(h.tag in HEADINGS for k in inner[: inner.index(nxt)] for h in walk(k)):
                return node
        node = nxt
        if node.tag == "article":
            return node


def blocks(nodes: list[Node], skip: set[int] | frozenset = frozenset()) -> list[str]:
    """Texts of the blocks below the nodes in page order, without furniture, template and the slots of ``skip``."""
    out, run = [], []

    def close():
        # A block is template only as a whole: constant words within varying ones are content.
        text = " ".join("".join(t for t, _ in run).split())
        if text and not all(constant for t, constant in run if t.strip()):
            out.append(text)
        run.clear()

    todo: list = [(n, True) for n in reversed(nodes)]
    while todo:
        n, last = todo.pop()
        if n is None:
            close()
        elif n.tag == "#":
            run.append((n.text, n.template))
        else:
            if n.tag in BLOCKS:
                close()
                todo.append((None, last))
            todo += [(k, last) for k in reversed(n.kids) if not furniture(k, True) and k.slot not in skip]
    close()
    return out


def mark(found: list[tuple[Node, bool]], template: set[int]) -> None:
    """Mark the texts that are template; none if that is most of the text and no heading is left that is not."""
    constant = [n for n, _ in found if n.slot >= 0 and _key(n.slot, n.text) in template] if template else []
    total, equal = sum(len(n.text.strip()) for n, _ in found), sum(len(n.text.strip()) for n in constant)
    held = set(map(id, constant))
    if any(heading and id(n) not in held for n, heading in found) or total - equal >= LEAST_VARYING * total:
        for n in constant:
            n.template = True


def extract(page: str | None, wrapper: Wrapper | None = None) -> str:
    """The main text of one page."""
    if not page:
        return ""
    root = parse(page)
    if wrapper and wrapper.article:
        wrapper.place(root)
        place = wrapper.place_of(tuple(dict.fromkeys(n.slot for n in walk(root) if n.slot >= 0)))
        _settle(root, place)
        places = [n for n in walk(root) if n.slot == place.article]
        found = leaves(root, set(map(id, places)))
        mark(found, wrapper.template)
        # Where the article is the whole body, what the wrapper hasn't got may be an article of its own.
        whole = wrapper.slots[place.article].tag in ("html", "body")
        inside = {id(n) for p in places for n in walk(p) if not whole or n.slot >= 0}
        held = sum(len(n.text.strip()) for n, _ in found if id(n) in inside and not n.template)
        rare = sum(len(n.text.strip()) for n, _ in found if id(n) not in inside and n.slot not in wrapper.common)
        if held and held >= rare:
            text = blocks(places, place.before)
            if text:
                return "\n\n".join(text)
        for n, _ in found:
            n.dull = n.slot in wrapper.common and (whole or id(n) not in inside)
    else:
        _settle(root)
    for nodes in ([own_article(root)], [root]):
        text = blocks(nodes)
        if text:
            return "\n\n".join(text)
    # Names that leave nothing were none of furniture; elements such as nav still are.
    for n in walk(root):
        n.marked, n.named, n.dull = n.tag in FURNITURE and n.tag != "form", False, False
    return "\n\n".join(blocks([own_article(root)]) or blocks([root]))


def induce(pages: list[str]) -> Wrapper | None:
    """The wrapper of a host whose pages are all given, as the tables below make it."""
    import xxhash

    pages = list(dict.fromkeys(pages))
    if len(pages) < LEAST_PAGES:
        return None
    found = {outline(p) for p in pages}
    while len(found) > 1:
        parts: dict[int, list[str]] = {}
        for o in found:
            h = int.from_bytes(xxhash.xxh64(o.encode("utf-8", "replace"), seed=42).digest(), "big", signed=True)
            parts.setdefault(h % -(-len(found) // FAN), []).append(o)
        found = {merged(p) for p in parts.values()}
    w = Wrapper.load(found.pop())
    cast: dict[int, list] = {}
    for b in (votes(p, w) for p in pages):
        cast[core(b)] = min(cast.get(core(b), b), b, key=lambda x: [v for *_, v in x])
    tally(w, list(cast.values()))
    return w


def tally(w: Wrapper, ballots: list[list[tuple[int, int, float]]]) -> None:
    """Count the pages' different ballots, as the tables below do, and decide."""
    n_pages = Counter(s for b in ballots for s in {s for s, _, _ in b})
    texts = Counter((s, k) for b in ballots for s, k, _ in b)
    template = {k for (s, k), c in texts.items() if s >= 0 and c >= LEAST_EQUAL and c >= SHARE * n_pages[s]}
    mass = {s: [0.0, 0.0] for s in n_pages}
    for b in ballots:
        for s, k, v in b:
            mass[s][0] += v * (k not in template)
            mass[s][1] += v
    w.decide({s: (n, *mass[s]) for s, n in n_pages.items() if s >= 0}, len(ballots), template)


@lru_cache(maxsize=512)
def _loaded(said: str) -> Wrapper:
    return Wrapper.load(said)


def domain(host: Column) -> Column:
    """The last two labels of a host; three below a country's general second level, such as co.uk."""
    registry = host.rlike(r"(^|\.)(ac|co|com|edu|gob|gov|ne|net|nom|or|org)\.[a-z][a-z]$")
    return F.when(registry, F.substring_index(host, ".", -3)).otherwise(F.substring_index(host, ".", -2))


def grouped(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(host, group) and (group, said), the running wrapper of all outlines of the group's pages; both written.

    Different pages are counted by their hashes, and equal outlines meet before they are shuffled. No task gets all
    outlines of a group: each merges some FAN of them, and passes are repeated until a group has one.
    """
    hashes = written(pages.select("host", F.xxhash64("html").alias("hash")).distinct(), "page-hashes")
    alone = (F.col("n") >= LEAST_PAGES) | F.col("host").rlike("^[0-9.:]+$")
    own = F.when(alone, F.col("host")).otherwise(F.concat(F.lit("."), domain(F.col("host"))))
    groups = written(hashes.groupBy("host").agg(F.count("*").alias("n")).select("host", own.alias("group")), "page-groups")
    enough = hashes.join(sized(groups), "host").groupBy("group").agg(F.count_distinct("hash").alias("n")).where(F.col("n") >= LEAST_PAGES)
    enough = written(groups.join(enough.select("group"), "group"), "groups-with-wrappers")

    @F.pandas_udf("string")
    def drawn(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for bodies in batches:
            yield pd.Series([outline(b) for b in bodies], dtype=object)

    @F.pandas_udf("string")
    def merge(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for lists in batches:
            yield pd.Series([merged(list(o)) for o in lists], dtype=object)

    met = pages.join(sized(enough), "host").select("group", drawn("html").alias("said"))
    said = written(met.distinct(), "outlines")
    while True:
        counts = written(said.groupBy("group").agg(F.count("*").alias("n")), "outline-counts")
        if (counts.agg(F.max("n")).first()[0] or 0) <= 1:  # one number
            break
        part = F.pmod(F.xxhash64("said"), F.ceil(F.col("n") / FAN)).alias("part")
        dealt = said.join(sized(counts), "group").select("group", part, "said").groupBy("group", "part").agg(F.collect_list("said").alias("some"))
        fewer = written(dealt.select("group", merge("some").alias("said")).distinct(), "outlines")
        dropped(said, counts)
        said = fewer
    dropped(hashes, enough, counts)
    return groups, said


def ballots(pages: DataFrame) -> DataFrame:
    """From (group, said, html) one row a page: group, ``core`` (what it votes for), ``slots``, ``keys``, ``shares``."""

    @F.pandas_udf("core long, slots array<int>, keys array<long>, shares array<double>")
    def cast(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for bodies, known in batches:
            rows = []
            for page, said in zip(bodies, known, strict=True):
                b = votes(page, _loaded(said))
                rows.append((core(b), *([list(c) for c in zip(*b, strict=True)] or ([], [], []))))
            yield pd.DataFrame(rows, columns=["core", "slots", "keys", "shares"])

    return pages.select("group", cast("html", "said").alias("v")).select("group", "v.*")


def wrappers(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(host, group) and (group, wrapper), both written. ``pages`` has ``host`` and ``html``.

    All pages vote, those with equal votes once. Votes are summed before they are shuffled.
    """
    pages = pages.where("html IS NOT NULL AND host <> ''")
    groups, said = grouped(pages)
    cast = ballots(pages.join(sized(groups), "host").join(sized(said), "group"))
    # Shares of equal votes may differ by what is a link: the least are taken.
    least = F.min(F.struct("shares", "slots", "keys")).alias("v")
    once = written(cast.groupBy("group", "core").agg(least).select("group", "core", "v.*"), "ballots")
    voters = once.groupBy("group").agg(F.count("*").alias("voters"))
    parts = once.select("group", F.explode(F.arrays_zip("slots", "keys", "shares")).alias("v")).select("group", "v.*").toDF("group", "slot", "key", "share")
    texts = parts.where("slot >= 0").groupBy("group", "slot", "key").agg(F.count("*").alias("c"), F.sum("share").alias("share"))
    texts = written(texts.where(F.col("c") >= LEAST_EQUAL), "constant-texts")
    mass = parts.where("slot >= 0").groupBy("group", "slot").agg(F.sum("share").alias("mass"))
    count = once.select("group", F.explode(F.array_distinct("slots")).alias("slot")).groupBy("group", "slot").agg(F.count("*").alias("n"))
    slots = written(mass.join(count, ["group", "slot"]), "slots")
    constant = written(texts.join(sized(slots), ["group", "slot"]).where(F.col("c") >= SHARE * F.col("n")).select("group", "slot", "key", "share"), "template")
    fixed = constant.groupBy("group", "slot").agg(F.sum("share").alias("fixed"))
    varying = slots.join(fixed, ["group", "slot"], "left").withColumn("varying", F.when(F.col("fixed") < F.col("mass") * (1 - 1e-9), F.col("mass") - F.col("fixed")).when(F.col("fixed").isNull(), F.col("mass")).otherwise(0.0))
    # Slots and template of a wrapper are bounded by what its outlines have together.
    seen = varying.groupBy("group").agg(F.collect_list(F.struct("slot", "n", "varying", "mass")).alias("seen"))
    template = constant.groupBy("group").agg(F.collect_list("key").alias("template"))

    @F.pandas_udf("string")
    def decide(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for known, lists, keys, voters in batches:
            out = []
            for s, seen, template, n in zip(known, lists, keys, voters, strict=True):
                w = Wrapper.load(s)
                of = {int(r["slot"]): (int(r["n"]), float(r["varying"]), float(r["mass"])) for r in (seen if seen is not None else [])}
                w.decide(of, int(n), {int(k) for k in (template if template is not None else [])})
                out.append(w.dump())
            yield pd.Series(out, dtype=object)

    rows = said.join(voters, "group").join(seen, "group", "left").join(template, "group", "left")
    out = written(rows.select("group", decide("said", "seen", "template", "voters").alias("wrapper")), "wrappers")
    dropped(said, once, texts, slots, constant)
    return groups, out


def main_text(pages: DataFrame, url: str = "url", body: str = "html") -> DataFrame:
    """Every page with ``text`` and ``n_chars``."""
    host = host_and_path(url)[0]
    groups, learned = wrappers(pages.select(host.alias("host"), F.col(body).alias("html")))

    @F.pandas_udf("string")
    def read(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for bodies, known in batches:
            yield pd.Series([extract(b, _loaded(w) if w else None) for b, w in zip(bodies, known, strict=True)], dtype=object)

    rows = pages.withColumn("__host", host).withColumnRenamed(body, "__body")
    rows = rows.join(sized(groups.toDF("__host", "__group"), groups), "__host", "left")
    rows = rows.join(sized(learned.toDF("__group", "__wrapper"), learned), "__group", "left")
    rows = rows.withColumn("__text", read("__body", "__wrapper"))
    kept = [F.col("__body").alias(body) if c == body else F.col(f"`{c}`") for c in pages.columns if c not in ("text", "n_chars")]
    return rows.select(*kept, F.col("__text").alias("text"), F.length("__text").cast("long").alias("n_chars"))
