"""A small forgiving HTML tree, and simple tree matching over it."""

from __future__ import annotations

import html
import re

# HTML element sets.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template xmp iframe noembed noframes svg math".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: An opening tag of the key closes an open element of the values, up to the nearest of SCOPE.
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "option": {"option"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"thead", "tbody", "tr", "td", "th"},
}
CLOSES_P = BLOCK - {"body", "html", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "option", "optgroup", "legend", "summary"}
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "tbody": {"table"}, "tfoot": {"table"}, "option": {"select"}}

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^'\">]|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
_DIGIT = re.compile(r"\d")
_ATTR = re.compile(r"(?:^|\s)(id|class|role|itemprop|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)


class Node:
    __slots__ = ("tag", "marks", "children")

    def __init__(self, tag: str, marks: dict | None = None):
        self.tag, self.marks, self.children = tag, marks or {}, []

    def elements(self) -> list[Node]:
        return [c for c in self.children if not isinstance(c, str)]

    def label(self) -> str:
        """Element name with the class or id, but for names that number single elements."""
        name = self.marks.get("class") or self.marks.get("id")
        return f"{self.tag}.{'.'.join(name.split())}" if name and not _DIGIT.search(name) else self.tag


def parse(page: str | None) -> Node:
    """The tree of a page: raw elements (scripts, styles, ...) are dropped, text keeps its place among the children."""
    root = Node("#root")
    stack = [root]
    at, text = 0, page or ""
    # where the open elements of each name, and open blocks, stand in the stack: no end tag has to walk through it
    places: dict[str, list[int]] = {}
    blocks: list[int] = []

    def nearest(*tags: str) -> int:
        return max((places[t][-1] for t in tags if places.get(t)), default=0)

    def close(i: int) -> None:
        for n in stack[i:]:
            places[n.tag].pop()
        while blocks and blocks[-1] >= i:
            blocks.pop()
        del stack[i:]

    while True:
        m = _TOKEN.search(text, at)
        upto = m.start() if m else len(text)
        if upto > at:
            stack[-1].children.append(text[at:upto])
        if not m:
            return root
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            if m[0].startswith("<![CDATA["):
                stack[-1].children.append(html.escape(m[0][9:].removesuffix("]]>"), quote=False))
            continue
        if m[1]:
            i = nearest(tag)
            # an inline end tag does not close the block around it
            if i and (tag in BLOCK or not blocks or i > blocks[-1]):
                close(i)
            continue
        if tag in CLOSES_P and blocks and stack[blocks[-1]].tag == "p":
            close(blocks[-1])
        if tag in CLOSES:
            while (i := nearest(*CLOSES[tag])) > nearest(*SCOPE.get(tag, ())):
                close(i)
                if tag not in ("tr", "tbody", "tfoot"):
                    break
        if tag in RAW and not m[3].endswith("/"):
            end = re.compile(rf"</{re.escape(tag)}\s*[^>]*(?:>|\Z)", re.I).search(text, at)
            at = end.end() if end else len(text)
            continue
        node = Node(tag, {a[1].lower(): a[2] or a[3] or a[4] or "" for a in _ATTR.finditer(m[3])} if m[3] else None)
        stack[-1].children.append(node)
        if tag not in VOID and not m[3].endswith("/") or tag in BLOCK and tag not in VOID:
            places.setdefault(tag, []).append(len(stack))
            if tag in BLOCK:
                blocks.append(len(stack))
            stack.append(node)


def squeeze(text: str) -> str:
    return " ".join((html.unescape(text) if "&" in text else text).split())


def own_text(node: Node) -> str:
    """The text of a node and of the inline elements in it, not of the blocks below."""
    out, todo = [], list(reversed(node.children))
    while todo:
        c = todo.pop()
        if isinstance(c, str):
            out.append(c)
        elif c.tag == "br":
            out.append(" ")
        elif c.tag not in BLOCK:
            todo.extend(reversed(c.children))
    return squeeze("".join(out))


def block_children(node: Node) -> list[Node]:
    """Blocks below a node, through inline elements."""
    out, todo = [], list(reversed(node.children))
    while todo:
        c = todo.pop()
        if isinstance(c, str):
            continue
        if c.tag in BLOCK:
            out.append(c)
        else:
            todo.extend(reversed(c.children))
    return out


#: Levels of a page that a wrapper tells apart; text further down counts to the node there.
WRAPPER_DEPTH = 120


def _length(nodes: list[Node]) -> int:
    """Characters below nodes, at any depth."""
    total, todo = 0, list(nodes)
    while todo:
        for c in todo.pop().children:
            if isinstance(c, str):
                total += len(squeeze(c))
            else:
                todo.append(c)
    return total


class Slot:
    """A node of a wrapper: the aligned nodes of several pages. Like-named siblings of a page are one slot (a list). ``texts``: those
    of its own that are the same on every page it is on; ``volume``: characters of all its own texts; ``pages``: pages it is on."""

    __slots__ = ("label", "tag", "marks", "texts", "volume", "pages", "children")

    def __init__(self, nodes: list[Node], depth: int = 0):
        self.label, self.tag, self.marks, self.pages = nodes[0].label(), nodes[0].tag, nodes[0].marks, 1
        own = [own_text(n) for n in nodes]
        self.texts, self.volume, self.children = {t for t in own if t}, sum(map(len, own)), []
        if depth == WRAPPER_DEPTH:
            self.volume = max(self.volume, _length(nodes))
            return
        lists: dict[str, list[Node]] = {}
        for n in nodes:
            for c in block_children(n):
                lists.setdefault(c.label(), []).append(c)
        self.children = [Slot(x, depth + 1) for x in lists.values()]

    def fixed(self) -> int:
        """Characters of the texts that are the same on every page."""
        return self.pages * sum(map(len, self.texts))


def match(a: Slot, b: Slot, memo: dict) -> int:
    """Simple tree matching: size of the largest order-preserving matching of two trees with equal root labels."""
    if a.label != b.label:
        return 0
    if not a.children or not b.children:
        return 1
    key = (id(a), id(b))
    if key not in memo:
        memo[key] = _table(a, b, memo)[-1][-1] + 1
    return memo[key]


def _table(a: Slot, b: Slot, memo: dict) -> list[list[int]]:
    rows = [[0] * (len(b.children) + 1)]
    for x in a.children:
        above, line = rows[-1], [0]
        for j, y in enumerate(b.children):
            line.append(max(above[j + 1], line[j], above[j] + match(x, y, memo) if x.label == y.label else 0))
        rows.append(line)
    return rows


def merge(wrapper: Slot, page: Slot, memo: dict) -> None:
    """Adds a page, or another wrapper, to a wrapper: aligned nodes join, the page's other nodes become optional ones at their place."""
    wrapper.pages += page.pages
    wrapper.volume += page.volume
    wrapper.texts &= page.texts
    rows = _table(wrapper, page, memo)
    i, j, out = len(wrapper.children), len(page.children), []
    while i or j:
        x = wrapper.children[i - 1] if i else None
        y = page.children[j - 1] if j else None
        if x and y and x.label == y.label and rows[i][j] == rows[i - 1][j - 1] + match(x, y, memo):
            out.append((x, y))
            i, j = i - 1, j - 1
        elif y and (not x or rows[i][j] == rows[i][j - 1]):
            out.append((y, None))
            j -= 1
        else:
            out.append((x, None))
            i -= 1
    wrapper.children = [x for x, _ in reversed(out)]
    for x, y in out:
        if y is not None:
            merge(x, y, memo)
