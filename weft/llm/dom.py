"""A small tolerant reader of HTML: element trees, and the text blocks of a tree in page order."""

from __future__ import annotations

import html as html_lib
import re
from collections.abc import Callable, Iterator

# Element names by their part in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes template".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split())
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "thead": ("thead", "tbody", "tfoot"), "tbody": ("thead", "tbody", "tfoot"), "tfoot": ("thead", "tbody", "tfoot")}
SCOPES = frozenset("ul ol dl table select html body article section div main aside nav td th".split())

TAG = re.compile(r"""<(?:!--.*?(?:-->|\Z)|![^>]*(?:>|\Z)|\?[^>]*(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*"|'[^']*')*+)(?:>|\Z))""", re.S)
ATTRIBUTE = re.compile(r"""(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)


class Node:
    """An element: its name, the words of its class, id and role, and its children (elements and strings)."""

    __slots__ = ("children", "names", "tag")

    def __init__(self, tag: str, names: str = "") -> None:
        self.tag, self.names, self.children = tag, names, []

    @property
    def label(self) -> str:
        return f"{self.tag}.{self.names}" if self.names else self.tag


def parse(html: str | None, named: list[Node] | None = None) -> Node:
    """The tree of a page below a root without name; ``named`` takes the elements with class, id or role. Unclosed, misnested and cut-off elements are mended as browsers do
    in the common cases; scripts, styles and other raw elements stand without content; comments are left out."""
    root = Node("")
    stack, at, text = [root], 0, html or ""
    while True:
        m = TAG.search(text, at)
        end = m.start() if m else len(text)
        if end > at:
            piece = text[at:end]
            stack[-1].children.append(html_lib.unescape(piece) if "&" in piece else piece)
        if not m:
            return root
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
            continue
        attributes = m[3]
        if tag in CLOSES_P:
            _close(stack, ("p",), SCOPES)
        elif tag in SIBLINGS:
            _close(stack, SIBLINGS[tag], SCOPES - {"td", "th"} if tag in ("tr", "thead", "tbody", "tfoot") else SCOPES - frozenset(SIBLINGS[tag]))
        names = ""
        if attributes and "=" in attributes:
            names = " ".join((x[1] or x[2] or x[3]).lower() for x in ATTRIBUTE.findall(attributes))
        node = Node(tag, " ".join(names.split()))
        stack[-1].children.append(node)
        if named is not None and names:
            named.append(node)
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(text, at)
            at = close.end() if close else len(text)
        elif tag not in VOID and not attributes.endswith("/"):
            stack.append(node)


def _close(stack: list[Node], tags: tuple[str, ...], scopes: frozenset[str]) -> None:
    """Close the nearest open element of these names, unless a scope stands between."""
    for k in range(len(stack) - 1, 0, -1):
        if stack[k].tag in tags:
            del stack[k:]
            return
        if stack[k].tag in scopes:
            return


def blocks(nodes: list[Node], skipped: Callable[[Node], bool]) -> Iterator[str]:
    """The text blocks under the nodes, in page order, without skipped elements: white space made single and trimmed."""
    run: list[str] = []
    todo: list = list(reversed(nodes))
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            run.append(x)
            continue
        if x is not None and (x.tag in RAW or skipped(x)):
            continue
        if x is not None and x.tag in INLINE:
            run.append(" ") if x.tag == "br" else todo.extend(reversed(x.children))
            continue
        said = " ".join("".join(run).split())
        if said:
            yield said
        run = []
        if x is not None:
            todo.append(None)  # the block ends
            todo.extend(reversed(x.children))
    said = " ".join("".join(run).split())
    if said:
        yield said
