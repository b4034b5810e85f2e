"""Main text of web pages by wrapper induction.

Pages of one host come from few templates. Each page becomes a skeleton (its block elements, runs of like siblings
folded, texts as hashes). The pages of a host fall into layouts by the outline of their holding elements, and the
skeletons of a layout are aligned with one of its commonest shape, the pivot, by simple tree matching; pages of rare
layouts are aligned with the pivot of the host's commonest layout. Aligned nodes whose text is the same on the pages are
template, wherever they stand, and so are short ones that say the same but for numbers; lists and boxes whose text is
nearly all links are menus. The other nodes are slots. The wrapper of a layout is the path of the smallest element that
holds nearly all text of the slots, of a main element where several nested ones do, with the template nodes; every page is
aligned once more to find its own template nodes, and only their own text goes. Names of elements decide where the
alignment can't: which of several slots is the article where none has nearly all text or too few pages are there, and
that an advert or a comment within the article, whose text varies as the article's does, is none of it.

Skeletons are short; whole pages are read where they lie, once for skeletons and once for the text.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_text, from_text, written
from .dom import INLINE, RAW, Node, blocks, parse

# Elements and names of classes, ids and roles that are not article text.
ASIDE_TAGS = frozenset("nav footer aside form button select input dialog menu head object embed canvas svg audio video".split())
ASIDE_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright disqus footer form gdpr login menu modal nav navbar navigation "
    "newsletter notice notices overlay pager pagination popup promo promoted recommended related reply replies respond search share sharing sidebar signup skip social sponsor sponsored subscribe toolbar widget".split()
)
HEAD_NAMES = frozenset(["header", "masthead", "banner"])
MAIN_TAGS, MAIN_NAMES = frozenset(["article", "main"]), frozenset(["main", "article"])
#: Elements that may hold an article (others are its paragraphs).
HOLDERS = frozenset(["", "html", "body", "main", "article", "section", "div", "td", "tr", "table", "tbody", "center"])

#: Words beside which such a name says how the page is, not what the element is (``has-sidebar``).
MODIFIERS = frozenset("has no not non with without is js hide hidden show enable enabled disable disabled supports free".split())

#: A node is template if at least this share of the aligned pages has its text, among this many pages at least.
SAME, LEAST_PAGES = 0.9, 3
#: An element stands for the article if it holds this share of the varying text.
HOLDS = 0.85
#: Text that varies in numbers only is template if it is no longer than this and no headline, and other text, so many
#: times as much, varies.
SHORT, MORE, HEADLINES = 100, 5, frozenset(["h1", "h2", "h3"])
#: An element of these is a menu if this share of its text is in links.
LISTS, LINKED = frozenset("ul ol dl div section table tbody tr td".split()), 0.8
#: Elements deeper than this count as text of the element above.
DEPTH = 200
#: Pairs of siblings whose scores are one whole table; of more, some rows of the same table are held, see _Rows.
PLAIN = 4096
#: Holding elements down to this depth make the outline of a page.
OUTLINE = 5

_NOT_ARTICLE = ASIDE_NAMES | HEAD_NAMES
_NAME, _DIGITS = re.compile(r"[a-z0-9]+"), re.compile(r"\d+")


@lru_cache(4096)
def names_of(label_names: str) -> set[str]:
    """The words of an element's class names, id and role, but those of names with a modifier."""
    return {w for name in label_names.split() if not MODIFIERS & (ws := set(_NAME.findall(name))) for w in ws}


@lru_cache(4096)
def is_main(tag: str, names: str) -> bool:
    if tag in MAIN_TAGS:
        return True
    return tag not in ("", "html", "body") and bool(names) and bool((words := names_of(names)) & MAIN_NAMES and not words & ASIDE_NAMES)


@lru_cache(4096)
def is_aside(tag: str, names: str, inside: bool) -> bool:
    """Whether an element is none of the article; ``inside``: it stands within a main element, whose header is its own.

    What the whole page and main elements are called says nothing of this.
    """
    if tag in ASIDE_TAGS or tag in RAW:
        return True
    if tag in ("", "html", "body") or tag in MAIN_TAGS:
        return False
    if not inside and tag == "header":
        return True
    return bool(names) and bool((words := names_of(names)) & ASIDE_NAMES or (not inside and words & HEAD_NAMES))


def page_tree(html: str | None) -> Node:
    """The tree of a page. A form that wraps most of the page's text is no form to fill in but a frame: it counts as div.
    An element that holds a main element, or a top headline and a paragraph, is no aside whatever it is called: it loses
    such names."""
    named: list[Node] = []
    tree = parse(html, named)
    for n in named:
        if names_of(n.names) & _NOT_ARTICLE and _holds_article(n):
            n.names = " ".join(x for x in n.names.split() if not names_of(x) & _NOT_ARTICLE)
    if html and "<form" in html.lower():
        order = list(_elements(tree))
        size: dict[int, int] = {}
        for n in reversed(order):
            size[id(n)] = sum(len(c.strip()) if isinstance(c, str) else size[id(c)] for c in n.children)
        for n in order:
            if n.tag == "form" and 2 * size[id(n)] > size[id(tree)]:
                n.tag = "div"
    return tree


def _elements(tree: Node) -> Iterator[Node]:
    todo = [tree]
    while todo:
        n = todo.pop()
        yield n
        todo += [c for c in n.children if not isinstance(c, str)]


def _holds_article(n: Node) -> bool:
    """Whether a main element, or a top headline and a paragraph, stand within an element."""
    below = {x.tag for x in _elements(n) if x is not n}
    return bool(below & MAIN_TAGS) or {"h1", "p"} <= below


# A skeleton node is [label, text length, text hash, children, hash of the text with numbers alike, text length in links].
# Lengths count a number as one figure.


def skeleton(node: Node, depth: int = 0, places: dict[int, list[Node]] | None = None, linked: bool = False) -> list:
    """The block elements below ``node``; consecutive siblings of like structure are one node.

    places: takes, for the id of each skeleton node, the elements it stands for.
    """
    length, crc, alike, links, children = 0, 0, 0, 0, []
    todo: list = [(c, linked) for c in reversed(node.children)]
    while todo:
        x, link = todo.pop()
        if isinstance(x, str):
            said = " ".join(x.split())
            if said:
                crc = zlib.crc32(said.encode("utf-8", "replace"), crc)
                said = _DIGITS.sub("0", said)
                length, alike, links = length + len(said), zlib.crc32(said.encode("utf-8", "replace"), alike), links + len(said) * link
        elif x.tag in RAW:
            continue
        elif x.tag in INLINE or depth >= DEPTH:
            todo.extend((c, link or x.tag == "a") for c in reversed(x.children))
        else:
            own = skeleton(x, depth + 1, places, link)
            if children and _shape(children[-1]) == _shape(own):
                _fold(children[-1], own, places)
            else:
                children.append(own)
    out = [node.label, length, crc, children, alike, links]
    if places is not None:
        places[id(out)] = [node]
    return out


def outline(tree: Node) -> str:
    """The layout of a page: a hash of the paths of its holding elements, of whatever number and order; '' without text."""
    if not _says(tree):
        return ""
    paths: set[str] = set()
    todo = [(tree, "", 0)]
    while todo:
        x, path, depth = todo.pop()
        path = f"{path}>{_DIGITS.sub('', x.label)}"
        paths.add(path)
        # What stands in main elements and asides is content.
        if depth < OUTLINE and not is_aside(x.tag, x.names, False) and not is_main(x.tag, x.names):
            inner = list(x.children)
            while inner:
                c = inner.pop()
                if isinstance(c, str):
                    continue
                if c.tag in INLINE:
                    inner += c.children
                elif c.tag in HOLDERS:
                    todo.append((c, path, depth + 1))
    return hashlib.md5("\n".join(sorted(paths)).encode("utf-8", "replace")).hexdigest()


def _says(tree: Node) -> bool:
    todo = [tree]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            if x.strip():
                return True
        elif x.tag not in RAW:
            todo += x.children
    return False


def longest_text(s: list) -> str:
    """The length and hash of the longest text of a skeleton: pages that share it are copies of one article."""
    best, todo = (0, 0), [s]
    while todo:
        x = todo.pop()
        best = max(best, (x[1], x[2]))
        todo += x[3]
    return f"{best[0]}/{best[1]}"


def _shape(s: list) -> tuple:
    return s[0], tuple(_shape(c) for c in s[3])


def _fold(a: list, b: list, places: dict[int, list[Node]] | None = None) -> None:
    # Not a CRC of CRCs: that would be their XOR, in which equal changes of two texts cancel.
    a[1], a[5] = a[1] + b[1], a[5] + b[5]
    for k in (2, 4):
        a[k] = (a[k] * 0x9E3779B1 + b[k]) & 0xFFFFFFFF
    if places is not None:
        places[id(a)] += places.pop(id(b))
    for x, y in zip(a[3], b[3], strict=True):
        _fold(x, y, places)


class _Rows:
    """Best scores of the first i of one list of siblings with the first j of another, a row for each i. Every so many rows one
    is held and the rows between are worked out again when they are asked for, so lists of any length are aligned alike and
    memory grows with their number to the power of 1.5."""

    def __init__(self, own: list[int], other: np.ndarray, of: np.ndarray) -> None:
        """own: the kind of each sibling of the one list; of: for each kind its scores with the kinds of the other list, which
        ``other`` names."""
        self.own, self.other, self.of = own, other, of
        self.step = max(1, math.isqrt(len(own)))
        row = np.zeros(len(other) + 1, np.int64)
        self.held = [row]
        for i in range(len(own)):
            row = self._next(row, i)
            if (i + 1) % self.step == 0:
                self.held.append(row)
        self.at, self.rows = -1, [row]

    def _next(self, above: np.ndarray, i: int) -> np.ndarray:
        row = np.zeros_like(above)
        np.maximum.accumulate(np.maximum(above[1:], above[:-1] + self.of[self.own[i]][self.other]), out=row[1:])
        return row

    def __getitem__(self, i: int) -> np.ndarray:
        if i // self.step != self.at:
            self.at = i // self.step
            self.rows = [self.held[self.at]]
            for k in range(self.at * self.step, min(len(self.own), (self.at + 1) * self.step - 1)):
                self.rows.append(self._next(self.rows[-1], k))
        return self.rows[i % self.step]


def matched(a: list, b: list) -> list[tuple[int, list, list]]:
    """Simple tree matching: the pairs (number of a's node in preorder, a's node, b's node) of a largest alignment that
    keeps order and descent and pairs equal labels only. Lists of siblings of any length are aligned in full."""
    kinds: dict[tuple, int] = {}
    kind_of: dict[int, int] = {}
    sizes: dict[int, int] = {}
    scores: dict[tuple[int, int], int] = {}
    tables: dict[tuple[int, int], _Rows | list[list[int]]] = {}

    def named(s: list) -> None:
        """Nodes of like structure are one kind: they match alike."""
        for c in s[3]:
            named(c)
        kind_of[id(s)] = kinds.setdefault((s[0], *(kind_of[id(c)] for c in s[3])), len(kinds))
        sizes[id(s)] = 1 + sum(sizes[id(c)] for c in s[3])

    def aligned(x: list, y: list) -> _Rows | list[list[int]]:
        key = kind_of[id(x)], kind_of[id(y)]
        if key in tables:
            return tables[key]
        if len(x[3]) * len(y[3]) > PLAIN:
            (xs, own), (ys, other) = (_distinct(n[3], kind_of) for n in (x, y))
            tables[key] = _Rows(own, np.array(other), np.array([[score(c, d) for d in ys] for c in xs], np.int64))
            return tables[key]
        table = [[0] * (len(y[3]) + 1)]
        for c in x[3]:
            row, above = [0], table[-1]
            for j, d in enumerate(y[3]):
                row.append(max(above[j + 1], row[j], above[j] + score(c, d)))
            table.append(row)
        tables[key] = table
        return table

    def score(x: list, y: list) -> int:
        if x[0] != y[0]:
            return 0
        key = kind_of[id(x)], kind_of[id(y)]
        if key not in scores:
            scores[key] = 1 + (int(aligned(x, y)[len(x[3])][-1]) if x[3] and y[3] else 0)
        return scores[key]

    out: list[tuple[int, list, list]] = []

    def trace(x: list, y: list, number: int) -> None:
        out.append((number, x, y))
        if not x[3] or not y[3]:
            return
        numbers, n = [], number + 1
        for c in x[3]:
            numbers.append(n)
            n += sizes[id(c)]
        table = aligned(x, y)
        i, j = len(x[3]), len(y[3])
        row, above = table[i], table[i - 1]
        while i and j:
            if row[j] != above[j] and row[j] == row[j - 1]:
                j -= 1
                continue
            pair = row[j] != above[j]
            i -= 1
            row, above = above, table[i - 1] if i else above
            if pair:
                j -= 1
                trace(x[3][i], y[3][j], numbers[i])

    named(a)
    named(b)
    if score(a, b):
        trace(a, b, 0)
    return out


def _distinct(nodes: list[list], kind_of: dict[int, int]) -> tuple[list[list], list[int]]:
    """A node of each kind, and for each node which of them is like it."""
    first: dict[int, int] = {}
    some: list[list] = []
    which = []
    for n in nodes:
        k = kind_of[id(n)]
        if k not in first:
            first[k] = len(some)
            some.append(n)
        which.append(first[k])
    return some, which


Votes = tuple[int, int, int, int, int]
VOTES = ["n", "same", "chars", "alike", "links"]


def induced(pivot: list, votes: dict[int, Votes]) -> dict:
    """The wrapper of a layout: {"root": labels from the top, "by": what decided on it, "template", "alike", "menus": numbers
    of the pivot's nodes whose text is the same, the same but for numbers, and of links}.

    The root is the smallest holding element with nearly all varying text, or a main element among those that have it. Where
    that is the whole page, or fewer than LEAST_PAGES were aligned, names decide: text of elements that call themselves
    asides does not count, and an element that calls itself main ends the search.

    votes: for a node's number in the pivot, (pages aligned with it, of those with the same text, their text length, with
    the same text but for numbers, their text length in links), over the pages. Without votes every node counts as varying.
    A wrapper without varying text has the root None.
    """
    nodes: list[tuple[list, list[str], bool]] = []
    found: list[list[float]] = []  # pages, text and links a page, of the node and then of all below

    def visit(s: list, path: list[str], inside: bool, aside: bool) -> tuple[float, float]:
        number = len(nodes)
        aside = aside or is_aside(*_parts(s[0]), inside)
        inside = inside or is_main(*_parts(s[0]))
        nodes.append((s, [*path, s[0]], aside))
        n, _, length, _, links = votes.get(number, (1, 0, s[1], 0, s[5]))
        own = [n, length / max(n, 1), links / max(n, 1)]
        found.append(own)
        below = [visit(c, nodes[number][1], inside, aside) for c in s[3]]
        own += [own[1] + sum(x for x, _ in below), own[2] + sum(x for _, x in below)]
        return own[3], own[4]

    visit(pivot, [], False, False)
    sizes = [_count(s) for s, *_ in nodes]
    enough = [n >= LEAST_PAGES for n, *_ in found]
    same = [enough[k] and votes[k][1] >= SAME * found[k][0] for k in range(len(nodes))]
    menus: set[int] = set()
    for k, (s, *_) in enumerate(nodes):
        if enough[k] and _parts(s[0])[0] in LISTS and found[k][4] >= LINKED * found[k][3] > 0:
            menus.update(range(k, k + sizes[k]))
    alike = {k for k in range(len(nodes)) if enough[k] and not same[k] and votes[k][3] >= SAME * found[k][0] and found[k][1] <= SHORT and _parts(nodes[k][0][0])[0] not in HEADLINES}
    varying = [0.0 if same[k] or k in menus or k in alike else found[k][1] for k in range(len(nodes))]
    if sum(varying) < MORE * sum(found[k][1] for k in alike):
        varying, alike = [0.0 if same[k] or k in menus else found[k][1] for k in range(len(nodes))], set()
    if not sum(varying):
        # A page of links alone.
        varying, menus = [0.0 if same[k] else found[k][1] for k in range(len(nodes))], set()

    def summed(own: list[float]) -> list[float]:
        return [sum(own[k : k + sizes[k]]) for k in range(len(nodes))]

    def down(weight: list[float], names: bool) -> list[int]:
        """The elements that hold nearly all of the weight, from the top on."""
        way = [0]
        while weight[0] and not (names and is_main(*_parts(nodes[way[-1]][0][0]))):
            n, next_ = way[-1] + 1, None
            for c in nodes[way[-1]][0][3]:
                if weight[n] >= HOLDS * weight[0] and _parts(c[0])[0] in HOLDERS:
                    next_ = c, n
                n += _count(c)
            # A headline beside the text belongs to it.
            if next_ is None or any(c is not next_[0] and _has_headline(c) for c in nodes[way[-1]][0][3]):
                break
            way.append(next_[1])
        return way

    total, by = sum(varying), "alignment"
    way = down(summed(varying), False)
    number = next((k for k in way if is_main(*_parts(nodes[k][0][0]))), way[-1])
    if total and not (enough[number] and _parts(nodes[number][0][0])[0] not in ("", "html", "body")):
        by = "names"
        weight = summed([0.0 if nodes[k][2] else x for k, x in enumerate(varying)])
        total, number = weight[0], down(weight, True)[-1]
        if total and not is_main(*_parts(nodes[number][0][0])):
            # The text is spread: a main element below that holds most of it.
            number = next((k for k in range(number, number + sizes[number]) if weight[k] >= 0.5 * total and is_main(*_parts(nodes[k][0][0]))), number)
    root = nodes[number][1] if total else None
    # What the root stands in is no menu.
    above = {k for k in range(number + 1) if k + sizes[k] > number}
    return {"root": root, "by": by, "template": [k for k, (s, *_) in enumerate(nodes) if same[k] and s[1]], "alike": sorted(alike), "menus": sorted(menus) if not above & menus else []}


def _has_headline(s: list) -> bool:
    tag, names = _parts(s[0])
    return not is_aside(tag, names, True) and (tag in ("h1", "h2") or any(_has_headline(c) for c in s[3]))


def _parts(label: str) -> tuple[str, str]:
    tag, _, names = label.partition(".")
    return tag, names


def _count(s: list) -> int:
    return 1 + sum(_count(c) for c in s[3])


def article(html: str | None, wrapper: dict | None) -> tuple[str, str]:
    """The main text of one page by its wrapper, and what decided where it stands; by its own slots if the wrapper has no
    root or its element is not on the page.

    wrapper: as of :func:`induced`, with its pivot. A wrapper without root is only a pivot's template. The page's nodes that
    are aligned with template nodes and say the same lose their own text; elements inside them are judged by themselves.
    """
    tree = page_tree(html)
    found = _at_path(tree, wrapper["root"]) if wrapper and wrapper["root"] else []
    places: dict[int, list[Node]] = {}
    page = skeleton(tree, 0, places)
    constant = _template_nodes(wrapper, page) if wrapper and (wrapper["template"] or wrapper["alike"] or wrapper["menus"]) else []
    by = wrapper["by"] if found else "names"
    if not found:
        said = {id(n) for n in constant}
        votes = {k: (LEAST_PAGES, LEAST_PAGES, 0, 0, 0) for k, n in enumerate(_preorder(page)) if id(n) in said}
        root = induced(page, votes)["root"] or [page[0]]
        found = _at_path(tree, root)
    else:
        root = wrapper["root"]
    inside = any(is_main(*_parts(label)) for label in root)
    if constant:
        kept = {id(e) for es in places.values() for e in es}
        for n in constant:
            for e in places[id(n)]:
                e.children = _block_children(e, kept)
    return "\n".join(blocks(found, lambda n: is_aside(n.tag, n.names, inside))), by


def _template_nodes(wrapper: dict, page: list) -> list[list]:
    """The nodes of a page's skeleton that are aligned with template nodes of the wrapper's pivot and have their text, or
    are links where it has a menu."""
    template, alike, menus = (set(wrapper[k]) for k in ("template", "alike", "menus"))
    out = []
    for number, x, y in matched(wrapper["pivot"], page):
        same = x[1] == y[1] and x[2] == y[2]
        if (number in template and same) or (number in alike and x[1] == y[1] and x[4] == y[4]) or number in menus:
            out.append(y)
    return out


def _preorder(s: list) -> Iterator[list]:
    yield s
    for c in s[3]:
        yield from _preorder(c)


def _block_children(node: Node, kept: set[int]) -> list[Node]:
    """The elements directly below ``node`` that are skeleton nodes of their own (also through inline elements)."""
    out, todo = [], list(reversed(node.children))
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            continue
        if id(x) in kept:
            out.append(x)
        elif x.tag not in RAW:
            todo.extend(reversed(x.children))
    return out


def _at_path(tree: Node, path: list[str]) -> list[Node]:
    """The elements whose labels from the top are ``path`` (of block elements), in page order."""
    found = [tree] if tree.label == path[0] else []
    for label in path[1:]:
        found = [c for n in found for c in n.children if isinstance(c, Node) and c.label == label]
    return found


def host_of(url: Column) -> Column:
    """The host name in lower case, without user and port; '' for null or odd addresses."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def _skeletons(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        trees = [page_tree(h) for h in b["html"]]
        found = [skeleton(t) for t in trees]
        shapes = [hashlib.md5(repr(_shape(s)).encode("utf-8", "replace")).hexdigest() for s in found]
        yield pd.DataFrame({
            "host": b["host"], "page_id": b["page_id"], "layout": [outline(t) for t in trees], "shape": shapes,
            "longest": [longest_text(s) for s in found], "skeleton": [json.dumps(s, separators=(",", ":")) for s in found],
        })


def _layouts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        yield b.assign(layout=[outline(page_tree(h)) for h in b["html"]])


def _aligned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    counts: dict[tuple[str, str, int], list[int]] = {}

    def flushed() -> pd.DataFrame:
        out = pd.DataFrame([(*k, *v) for k, v in counts.items()], columns=["host", "used", "node", *VOTES])
        counts.clear()
        return out

    pivots: dict[tuple[str, str], list] = {}
    for b in batches:
        for host, used, page, pivot in zip(b["host"], b["used"], b["skeleton"], b["pivot"], strict=True):
            if (host, used) not in pivots:
                if len(pivots) > 1000:
                    pivots.clear()
                pivots[host, used] = json.loads(pivot)
            for number, x, y in matched(pivots[host, used], json.loads(page)):
                c = counts.setdefault((host, used, number), [0, 0, 0, 0, 0])
                for k, v in enumerate((1, x[1] == y[1] and x[2] == y[2], y[1], x[1] == y[1] and x[4] == y[4], y[5])):
                    c[k] += v
        if len(counts) > 100_000:
            yield flushed()
    yield flushed()


def _wrappers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = []
        for host, used, pivot, votes in zip(b["host"], b["used"], b["pivot"], b["votes"], strict=True):
            shape = json.loads(pivot)
            found = induced(shape, {v["node"]: tuple(v[k] for k in VOTES) for v in votes})
            # Pages of rare layouts share the template only; their text may stand elsewhere.
            rows.append((host, used, *(json.dumps(w | {"pivot": shape}, separators=(",", ":")) for w in (found, found | {"root": None}))))
        yield pd.DataFrame(rows, columns=["host", "used", "wrapper", "shared"])


def wrappers(pages: DataFrame) -> DataFrame:
    """(host, layout, wrapper as JSON) from all pages (page_id, url, html); one row per layout of a host.

    Pages that share their longest text are one vote, so copies of an article do not make its text template. The pivot of a layout is the
    first page of its commonest shape; a layout of fewer than LEAST_PAGES skeletons is aligned with the pivot of its
    host's commonest layout. Pages without text have no part in this.

    The skeletons are written once. The joins that bring each page its pivot have exchanges of their own, so a host with
    very many pages can be split; votes are summed in the tasks before they are shuffled.
    """
    kind = dict(pages.dtypes)["page_id"]
    shapes = pages.select(host_of(F.col("url")).alias("host"), as_text("page_id").alias("page_id"), "html")
    shapes = shapes.mapInPandas(_skeletons, "host string, page_id string, layout string, shape string, longest string, skeleton string").where("layout <> ''")
    first = F.struct(F.col("page_id").isNull().alias("none"), from_text("page_id", kind, "page_id"))
    one = F.min(F.struct(first.alias("first"), "shape", "skeleton")).alias("one")
    shapes = shapes.groupBy("host", "layout", "longest").agg(one).select("host", "layout", "one.*")
    shapes = written(shapes, "skeletons")
    by_shape = shapes.groupBy("host", "layout", "shape").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("first", "skeleton")).alias("p"))
    layouts = by_shape.groupBy("host", "layout").agg(F.sum("n").alias("n"), F.min(F.struct(-F.col("n"), "p"))["p"]["skeleton"].alias("pivot"))
    layouts = written(layouts, "layouts")
    lead = F.substring("host", 1, 1)
    common = layouts.groupBy("host").agg(F.min(F.struct(-F.col("n"), "layout", "pivot")).alias("c")).withColumn("_lead", lead)
    rare = F.col("n") < LEAST_PAGES
    used = layouts.withColumn("_lead", lead).join(common, ["host", "_lead"]).select(
        "host", "layout", (rare & (F.col("layout") != F.col("c.layout"))).alias("rare"),
        F.when(rare, F.col("c.layout")).otherwise(F.col("layout")).alias("used"), F.when(rare, F.col("c.pivot")).otherwise(F.col("pivot")).alias("pivot"),
    )
    used = written(used, "pivots")
    pairs = shapes.withColumn("_lead", lead).join(used.withColumn("_lead", lead), ["host", "layout", "_lead"])
    votes = pairs.select("host", "used", "skeleton", "pivot").mapInPandas(_aligned, f"host string, used string, node int, {', '.join(f'{k} long' for k in VOTES)}")
    votes = votes.groupBy("host", "used", "node").agg(*(F.sum(k).alias(k) for k in VOTES))
    by_layout = votes.groupBy("host", "used").agg(F.collect_list(F.struct("node", *VOTES)).alias("votes"))
    own = used.where("layout = used").select("host", "used", "pivot").join(by_layout, ["host", "used"])
    made = own.mapInPandas(_wrappers, "host string, used string, wrapper string, shared string")
    every = used.select("host", "layout", "used", "rare").withColumn("_lead", lead).join(made.withColumn("_lead", lead), ["host", "used", "_lead"])
    return every.select("host", "layout", F.when(F.col("rare"), F.col("shared")).otherwise(F.col("wrapper")).alias("wrapper"))


def extracted(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars, decided_by): the main text of every page, and whether ``alignment`` with other pages or
    ``names`` of its elements told where it stands.

    Null html is an empty page with empty text; pages without usable url share the host ''. Blocks are joined by one line
    end. Other columns are not used. Pages are parsed once more for their layout, which is cheaper than to store them. The
    wrappers are written first, so Spark knows their size: it broadcasts them while
    they are small and shuffles the pages by host and layout otherwise.
    """
    kind = dict(pages.dtypes)["page_id"]
    found = written(wrappers(pages), "wrappers")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        read: dict[str, dict] = {}
        for b in batches:
            texts, by = [], []
            for html, wrapper in zip(b["html"], b["wrapper"], strict=True):
                if wrapper is not None and wrapper not in read:
                    if len(read) > 1000:
                        read.clear()
                    read[wrapper] = json.loads(wrapper)
                for to, x in zip((texts, by), article(html, read.get(wrapper)), strict=True):
                    to.append(x)
            yield pd.DataFrame({"page_id": b["page_id"], "url": b["url"], "text": texts, "n_chars": [len(t) for t in texts], "decided_by": by})

    lead = F.substring("host", 1, 1)
    own = pages.select(as_text("page_id").alias("page_id"), "url", "html", host_of(F.col("url")).alias("host"))
    own = own.mapInPandas(_layouts, "page_id string, url string, html string, host string, layout string").withColumn("_lead", lead)
    own = own.join(found.withColumn("_lead", lead), ["host", "layout", "_lead"], "left").select("page_id", "url", "html", "wrapper")
    return own.mapInPandas(run, "page_id string, url string, text string, n_chars long, decided_by string").select(from_text("page_id", kind, "page_id"), "url", "text", "n_chars", "decided_by")
