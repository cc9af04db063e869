"""Main text of web pages by wrapper induction.

Every page of a host is folded into the host's wrapper by simple tree matching: in each task first, then the partial wrappers
of a host are merged in two steps, so a host of any size is spread over tasks. A wrapper node holds the texts
that are the same on every page it is on (template) and how much its texts vary. The content slot is the smallest subtree with
most of the varying text; where it lies inside main or article elements, the outermost of these on its path, so that title and
lead stay with the story. A page's main text is read from the nodes on the slot's path, in page order, without template
texts and without what element names, roles or class names mark as navigation, header, footer, sidebar, notice,
advert, form or comments. A page whose host has a single page, or that has no node on the path, is read by its own article and
main elements, else whole. The order of merging may decide which of two crossing siblings are aligned; template texts do not depend on it.

Defined results: null or empty html gives an empty text and is no part of a wrapper; a null url is a host of its own; a null
``page_id`` is an ordinary row; repeated rows are separate rows and count as pages of their own; an empty table gives an empty
result; long and deep pages are read whole, the wrapper tells their first ``dom.WRAPPER_DEPTH`` levels apart.
"""

from __future__ import annotations

import pickle
import re

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, dom

#: Bytes of rules (paths and template texts of hosts) that may be broadcast.
BROADCAST_BYTES = 32 << 20
#: Wrappers that a task holds before it passes them on.
HELD_HOSTS = 1_000
#: Groups of tasks whose partial wrappers of a host are merged first.
MERGE_GROUPS = 32
CONTENT_SHARE = 0.8
TEMPLATE_PAGES = 3
#: Elements that are pieces of a text, not regions of a page.
PIECES = frozenset("p li dd dt td tr tbody h1 h2 h3 h4 h5 h6 pre blockquote".split())
# What marks a part of a page that is not its article.
OUTSIDE_TAGS = frozenset("nav aside form footer menu dialog button select head".split())
OUTSIDE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form toolbar".split())
OUTSIDE_WORDS = frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs sidebar aside ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner "
    "cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup login register search share sharing social "
    "related recommended recommendations comment comments respond reply replies disqus pagination pager toolbar footer masthead widget skip".split()
)
# Words that stand beside these in a name and say nothing themselves.
FILLER_WORDS = frozenset(
    "box wrap wrapper container block section area list bar link links button buttons post posts site page global main top bottom left right primary secondary "
    "form forms content inner outer panel slot unit item items row col column group holder header"
    .split()
)
_NAME = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


def outside(tag: str, marks: dict, in_article: bool) -> bool:
    """Whether element name, role or class and id mark a part that is not the article."""
    if tag in OUTSIDE_TAGS or tag == "header" and not in_article:
        return True
    if not marks:
        return False
    if "hidden" in marks or marks.get("aria-hidden") == "true" or marks.get("role", "").lower() in OUTSIDE_ROLES:
        return True
    if tag in ("body", "html", "main", "article"):
        return "comment" in marks.get("class", "").lower()
    telling = OUTSIDE_WORDS if in_article else OUTSIDE_WORDS | {"header", "topbar", "top"}
    # a class or id counts as a whole: "related-links" is outside, "related-work" is not
    for name in f"{marks.get('class', '')} {marks.get('id', '')}".split():
        found = set(_NAME.findall(_CAMEL.sub(" ", name).lower()))
        if found & telling and found <= telling | FILLER_WORDS:
            return True
    return False


def fold(wrapper: dom.Slot | None, page: str) -> dom.Slot:
    """The wrapper with one more page."""
    slot = dom.Slot([dom.parse(page)])
    if wrapper is None:
        return slot
    dom.merge(wrapper, slot, {})
    return wrapper


def content_slot(wrapper: dom.Slot) -> tuple[str, list[str]]:
    """(path of the content slot, template texts inside it) of a host's wrapper; nothing can be told from one page."""
    if wrapper.pages < 2:
        return "", []

    def varying(s: dom.Slot, inside: bool) -> int:
        if outside(s.tag, s.marks, inside):
            return 0
        # on a single page nothing is known to be template
        own = s.volume - (s.fixed() if s.pages > 1 else 0)
        return own + sum(varying(c, inside or s.tag in ("article", "main")) for c in s.children)

    path, node = [], wrapper
    whole = varying(node, False)
    while whole:
        inside = any(n.tag in ("article", "main") for n in path)
        best = max(node.children, key=lambda c: varying(c, inside), default=None)
        if best is None or varying(best, inside) < CONTENT_SHARE * whole:
            break
        path.append(best)
        node = best
    # a list of paragraphs is no region of its own: its parent may hold headings between them
    while path and path[-1].tag in PIECES:
        path.pop()
    named = [i for i, n in enumerate(path) if n.tag in ("article", "main") or n.marks.get("role") == "main" or n.marks.get("itemprop") == "articleBody"]
    path = path[: named[0] + 1] if named else path
    node = path[-1] if path else wrapper
    fixed, volume = [], [0, 0]

    def constants(s: dom.Slot) -> None:
        same = s.fixed() if s.pages >= TEMPLATE_PAGES else 0
        if same:
            fixed.extend(s.texts)
        volume[0] += same
        volume[1] += s.volume - same
        for c in s.children:
            constants(c)

    constants(node)
    # copies of one article on all pages look constant as well: a template is the small part of a slot
    return ">".join(n.label for n in path), sorted(fixed) if volume[0] * 4 <= volume[1] else []


def _find(root: dom.Node, path: str) -> list[dom.Node]:
    """All nodes of a page on the slot's path, in page order."""
    nodes = [root] if path else []
    for label in path.split(">") if path else ():
        nodes = [c for n in nodes for c in dom.block_children(n) if c.label() == label]
    return nodes


def _volume(node: dom.Node) -> int:
    """Characters below a node, at any depth."""
    total, todo = 0, [node]
    while todo:
        for c in todo.pop().children:
            if isinstance(c, str):
                total += len(c)
            else:
                todo.append(c)
    return total


def _region(root: dom.Node, path: str) -> tuple[list[dom.Node], bool]:
    """The parts of the page that hold its article, in page order, and whether they are marked as such: the wrapper's slot first."""
    slot = _find(root, path)
    if any(_volume(x) for x in slot):
        return slot, any(p.split(".")[0] in ("article", "main") for p in path.split(">"))
    parts, todo = [], list(reversed(root.children))
    while todo:
        c = todo.pop()
        if isinstance(c, str) or outside(c.tag, c.marks, False):
            continue
        if c.tag in ("article", "main") or c.marks.get("role") == "main" or c.marks.get("itemprop") == "articleBody":
            parts.append(c)
        else:
            todo.extend(reversed(c.children))
    # a main element may hold title and lead beside the articles in it
    return (parts, True) if any(_volume(x) for x in parts) else ([root], False)


def extract(page: str | None, path: str = "", template: frozenset = frozenset()) -> str:
    """The main text: blocks in page order, joined by an empty line."""
    regions, inside = _region(dom.parse(page), path)
    blocks: list[str] = []
    buffer: list[str] = []

    def flush() -> None:
        text = dom.squeeze("".join(buffer))
        buffer.clear()
        if text and text not in template:
            blocks.append(text)

    # an explicit stack, for trees of any depth; None stands for the end of a block
    todo: list = [x for r in reversed(regions) for x in (None, *reversed(r.children))]
    while todo:
        c = todo.pop()
        if c is None:
            flush()
        elif isinstance(c, str):
            buffer.append(c)
        elif c.tag == "br":
            buffer.append(" ")
        elif outside(c.tag, c.marks, inside):
            if c.tag in dom.BLOCK:
                flush()
        elif c.tag in dom.BLOCK:
            flush()
            todo.append(None)
            todo.extend(reversed(c.children))
        else:
            todo.extend(reversed(c.children))
    flush()
    return "\n\n".join(blocks)


def wrappers(pages: DataFrame) -> DataFrame:
    """``host, path, template``: a row for each host, induced from all of its pages."""

    def partial(batches):
        held: dict[str, dom.Slot] = {}
        task = TaskContext.get().partitionId()

        def out():
            rows = [(h, task, pickle.dumps(w)) for h, w in held.items()]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int32(), pa.binary()))], names=["host", "task", "wrapper"])

        for batch in batches:
            for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held[host] = fold(held.get(host), page)
                if len(held) >= HELD_HOSTS:
                    yield out()
        if held:
            yield out()

    def merged(rows: pd.DataFrame) -> dom.Slot:
        parts = [pickle.loads(w) for w in rows.sort_values("task")["wrapper"]]
        for other in parts[1:]:
            dom.merge(parts[0], other, {})
        return parts[0]

    def some(key, rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"host": [key[0]], "task": [key[1]], "wrapper": [pickle.dumps(merged(rows))]})

    def all_of(key, rows: pd.DataFrame) -> pd.DataFrame:
        path, template = content_slot(merged(rows))
        return pd.DataFrame({"host": [key[0]], "path": [path], "template": [template]})

    schema = "host string, task int, wrapper binary"
    parts = pages.filter(F.length("html") > 0).select("host", "html").mapInArrow(partial, schema)
    parts = parts.withColumn("task", F.pmod("task", F.lit(MERGE_GROUPS))).groupBy("host", "task").applyInPandas(some, schema)
    return parts.groupBy("host").applyInPandas(all_of, "host string, path string, template array<string>")


def extract_pages(pages: DataFrame) -> DataFrame:
    """``page_id, url, text`` of every row of ``pages`` (``page_id, url, html``)."""
    common.bound_batches(pages.sparkSession)
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))
    pages = pages.select("page_id", "url", "html", host.alias("host"))
    rules = common.materialize(wrappers(pages), "wrappers")
    held = F.octet_length("host") + F.octet_length("path") + F.aggregate("template", F.lit(0), lambda a, t: a + F.octet_length(t))
    few = (rules.agg(F.sum(held + 64)).first()[0] or 0) <= BROADCAST_BYTES
    joined = pages.join(F.broadcast(rules) if few else rules, "host", "left").select("page_id", "url", "html", "path", "template")

    def run(batches):
        for batch in batches:
            page, path, template = batch.column(2), batch.column(3).to_pylist(), batch.column(4).to_pylist()
            texts = [extract(page[i].as_py(), path[i] or "", frozenset(template[i] or ())) for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    return joined.mapInArrow(run, "page_id long, url string, text string")


def query(spark, sf_dir: str) -> DataFrame:
    """op3: the main text of every page."""
    return extract_pages(common.read(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))
