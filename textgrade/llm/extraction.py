"""Main text of web pages by composite text density.

Every element gets a density, its characters for each tag, adjusted by how much of both lies in links. Densities of the
children of an element are summed, and the element with the greatest sum is the centre of the page. The least density
on the way from there up to the body is the threshold that anything beside this way must reach to belong to the text.
A centre within an article (or main part) is raised to it; other articles are taken as any element is, by the threshold.
Elements that by tag or role, or by a class or id that is just their name, are menus, headers, footers, sidebars, notices,
adverts, forms, scripts, styles or reader comments take no part, unless they are wrapped around the article itself. A class
or id that only contains such a word halves the density and leaves the decision to the threshold. Headings
and paragraphs are judged by neither, nor is what lies in an article by an id that can be its heading's.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

# Pages of a batch that a task has as Python strings at a time.
SLICE = 64

# Names of HTML.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript iframe noembed noframes xmp template svg".split())
BLOCKS = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure"
    " footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search"
    " section summary table tbody td tfoot th thead title tr ul".split()
)
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
DROPPED = set(
    "head script style noscript template title nav menu footer aside form button select option input textarea iframe"
    " object embed svg canvas audio video dialog search noembed noframes xmp map".split()
)
CLOSED_BY = {
    "li": {"li"},
    "dt": {"dt", "dd"},
    "dd": {"dt", "dd"},
    "tr": {"tr", "td", "th"},
    "td": {"td", "th"},
    "th": {"td", "th"},
    "option": {"option"},
}
WALLS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}}
# Roles, and words in class names and ids, of what is not the article.
ROLES = set("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
ASIDE = set(
    "ad ads advert adverts advertisement advertisements advertising adsbygoogle sponsor sponsored sponsors promo promos"
    " promotion nav navbar navigation menu menus breadcrumb breadcrumbs header masthead topbar footer sidebar sidebars"
    " notice notices cookie cookies consent gdpr banner alert popup modal overlay newsletter subscribe subscription"
    " signup login comment comments disqus reply replies respond share sharing social related recommended"
    " recommendations widget widgets pagination pager toolbar form search skip".split()
)
# Words that say where or how such a part is placed; others ("related-work", "post-header") say that it is something else.
PLACES = set(
    "area author back bar block body bottom box btn button buttons center col column container content count date entry"
    " fixed global group holder inner item items large left link links list main meta mobile outer page panel posts"
    " primary right row secondary section site small sticky text thread title top wrap wrapper".split()
)
# Of the above, what goes from inside an article too by an id; other ids there are names of its sections.
INNER = set(
    "ad ads advert adverts advertisement advertisements adsbygoogle sponsor sponsored sponsors promo promos cookie"
    " cookies consent gdpr newsletter subscribe subscription popup modal overlay comment comments disqus reply replies"
    " respond".split()
)
NEGATIONS = set("has with no without".split())
#: What a class or id that only contains such a word leaves of an element's density.
DOUBT = 0.5

_TAG = re.compile(r"<(?:(!--)|([!?])|(/?)([a-zA-Z][^\s/>]*))")
_QUOTE_OR_END = re.compile(r"[>\"']")
_ATTRIBUTE = re.compile(r"(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


@dataclass
class Node:
    tag: str
    parent: Node | None
    attributes: str = ""
    #: Text and elements in page order.
    parts: list = field(default_factory=list)
    density: float = 0.0
    total: float = 0.0
    chars: int = 0
    tags: int = 0
    link_chars: int = 0
    link_tags: int = 0
    #: Whether it lies in an article or main part.
    inside: bool = False


def _end_of_tag(html: str, at: int, quotes: bool) -> tuple[int, bool]:
    """Where the tag's ``>`` is, and whether later quotes can still be trusted to be closed."""
    while quotes:
        found = _QUOTE_OR_END.search(html, at)
        if found is None:
            return -1, quotes
        if found[0] == ">":
            return found.start(), quotes
        close = html.find(found[0], found.end())
        if close < 0:
            return html.find(">", at), False
        at = close + 1
    return html.find(">", at), quotes


def parse(html: str) -> Node:
    """The page as a tree; unclosed and misplaced tags are borne with. One pass, linear in the page's length."""
    root = Node("html", None)
    open_: list[Node] = [root]
    at, quotes = 0, True
    raw_ends: dict[str, bool] = {}

    def text(part: str) -> None:
        if part:
            open_[-1].parts.append(unescape(part))

    def close(names: set[str], walls: set[str]) -> None:
        for k in range(len(open_) - 1, 0, -1):
            if open_[k].tag in names:
                del open_[k:]
                return
            if open_[k].tag in walls:
                return

    while True:
        found = _TAG.search(html, at)
        if found is None:
            text(html[at:])
            return root
        text(html[at : found.start()])
        comment, mark, slash, name = found.groups()
        if comment:
            end = html.find("-->", max(found.end() - 2, 0))
            at = len(html) if end < 0 else end + 3
            continue
        if mark:
            if html.startswith("[CDATA[", found.end()):
                end = html.find("]]>", found.end())
                open_[-1].parts.append(html[found.end() + 7 : len(html) if end < 0 else end])
                at = len(html) if end < 0 else end + 3
            else:
                end = html.find(">", found.end())
                at = len(html) if end < 0 else end + 1
            continue
        name = name.lower()
        end, quotes = (html.find(">", found.end()), quotes) if slash else _end_of_tag(html, found.end(), quotes)
        if end < 0:
            return root  # a tag that is cut off by the end of the page
        at = end + 1
        if slash:
            close({name}, {"article", "main", "body", "table"} if name not in BLOCKS else set())
            continue
        if name == "html" or (name == "body" and any(n.tag == "body" for n in open_)):
            continue
        if name in BLOCKS:
            close({"p"}, {"table", "button", "td", "th"})
            if name == "body":
                del open_[1:]
        if name in CLOSED_BY:
            close(CLOSED_BY[name], WALLS.get(name, set()))
        node = Node(name, open_[-1], html[found.end() : end])
        open_[-1].parts.append(node)
        if name in VOID or (node.attributes.endswith("/") and name in ("svg", "path")):
            continue
        if name in RAW:
            stop = None
            if raw_ends.get(name, True):
                stop = re.compile(rf"</{name}\b", re.I).search(html, at)
                raw_ends[name] = stop is not None
            at = len(html) if stop is None else stop.start()
            if stop is not None:
                end = html.find(">", at)
                at = len(html) if end < 0 else end + 1
            continue
        open_.append(node)


def _elements(node: Node) -> Iterator[Node]:
    """The node and everything in it, in page order, without recursion."""
    stack = [node]
    while stack:
        node = stack.pop()
        yield node
        stack += [p for p in reversed(node.parts) if isinstance(p, Node)]


def _words(node: Node) -> Iterator[tuple[str, set[str]]]:
    """For each name in the class and id of an element the attribute and the words in it, if one is of ``ASIDE``."""
    for name, *values in _ATTRIBUTE.findall(node.attributes):
        if name.lower() in ("class", "id"):
            for one in unescape(next((v for v in values if v), "")).split():
                words = {w.lower() for w in _WORD.findall(one)}
                if words & ASIDE and not words & NEGATIONS:
                    yield name.lower(), words


def _named_aside(node: Node) -> bool:
    """Whether class or id are just the name of what is not the article. Headings and paragraphs are never judged by these,
    and the id of an element in an article, or of a section, is mostly that of its heading."""
    if node.tag in HEADINGS or node.tag == "p":
        return False
    anchor = node.tag == "section" or node.inside
    return any(words <= ASIDE | PLACES and (name == "class" or not anchor or words & INNER) for name, words in _words(node))


def _aside(node: Node, keeps: set[int]) -> bool:
    """Whether the element is not part of the article by its tag, role, or class and id."""
    if node.tag in DROPPED and not (node.tag == "form" and id(node) in keeps):
        return True
    if node.tag in ("html", "body", "main") or not node.attributes:
        return False
    for name, *values in _ATTRIBUTE.findall(node.attributes):
        name, value = name.lower(), next((v for v in values if v), "")
        if name == "role" and value.lower() in ROLES and id(node) not in keeps:
            return True
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
            return True
        if name == "style" and re.search(r"display\s*:\s*none", value, re.I):
            return True
    return id(node) not in keeps and _named_aside(node)


def _header(node: Node) -> bool:
    """Whether the element is a header by its tag or class, whose headings stay in an article."""
    return node.tag == "header" or (node.tag not in HEADINGS and any("header" in words for _, words in _words(node)) and _named_aside(node))


def _unlinked(nodes: list[Node], keeps: set[int]) -> dict[int, int]:
    """Characters outside of links, and of what is no part of the article, of every element by its identity."""
    chars: dict[int, int] = {}
    for node in reversed(nodes):
        n = 0
        for part in node.parts:
            if isinstance(part, str):
                n += len("".join(part.split()))
            elif part.tag != "a" and not (_header(part) and id(part) not in keeps) and not _aside(part, keeps):
                n += chars[id(part)]
        chars[id(node)] = n
    return chars


def _wrappers(nodes: list[Node]) -> set[int]:
    """The elements that hold the greater part of the page's unlinked characters, also when all that their forms, roles
    and classes tell not to be the article is left out inside of them (reader comments have then nothing left)."""
    everything = {id(n) for n in nodes}
    gross = _unlinked(nodes, everything)
    holds = {k for k, n in gross.items() if 2 * n > gross[id(nodes[0])]}
    net = _unlinked(nodes, holds)
    return {k for k in holds if 2 * net[k] > net[id(nodes[0])]}


def _prune(root: Node) -> None:
    """Take out what is not the article. A form, or an element with such a role, class or id, that holds the article or
    main part stays without its controls; so does, on a page without these, one that holds the greater part of the
    unlinked characters. Of a header inside an article the headings stay."""
    nodes = list(_elements(root))
    for node in nodes[1:]:
        node.inside = node.parent.inside or node.parent.tag in ("article", "main")
    keeps: set[int] = set()
    for node in nodes:
        if node.tag in ("article", "main") and not _aside(node, set()):
            up = node.parent
            while up is not None and id(up) not in keeps:
                keeps.add(id(up))
                up = up.parent
    keeps = keeps or _wrappers(nodes)
    for node in nodes:
        kept = []
        for part in node.parts:
            if isinstance(part, str):
                kept.append(part)
            elif _header(part) and id(part) not in keeps:
                if part.inside or node.tag in ("article", "main"):
                    kept += [n for n in _elements(part) if n.tag in HEADINGS and not _aside(n, keeps)]
            elif not _aside(part, keeps):
                kept.append(part)
        node.parts = kept
        for part in kept:
            if isinstance(part, Node):
                part.parent = node


def _measure(root: Node, body: Node) -> None:
    """Characters, tags, and those in links, of every element; then its density and the sum over its children."""
    nodes = list(_elements(root))
    for node in reversed(nodes):
        for part in node.parts:
            if isinstance(part, str):
                node.chars += len("".join(part.split()))
            else:
                node.chars += part.chars
                node.tags += part.tags + 1
                node.link_chars += part.link_chars
                node.link_tags += part.link_tags + (part.tag == "a")
        if node.tag == "a":
            node.link_chars = node.chars
    share = body.link_chars / max(body.chars, 1)
    for node in reversed(nodes):
        if node.chars:
            tags = max(node.tags, 1)
            plain = max(node.chars - node.link_chars, 1)
            base = math.log(node.chars / plain * node.link_chars + share * node.chars + math.e) + 1
            links = node.chars / max(node.link_chars, 1) * tags / max(node.link_tags, 1)
            node.density = node.chars / tags * math.log(max(links, 1)) / math.log(base)
            if node.tag not in HEADINGS and next(_words(node), None):
                node.density *= DOUBT
        children = [p for p in node.parts if isinstance(p, Node)]
        node.total = sum(p.density for p in children) if children else node.density


def _wanted(body: Node) -> list[Node]:
    """The parts of the page that are its text, in page order.

    The centre is raised to the outermost article around it, or to the main part if there is none. What is beside the
    way from there to the body is taken by the threshold, in tagged pages too.
    """
    nodes = list(_elements(body))
    centre = max(nodes, key=lambda n: n.total)  # the first, thus the outermost, of equals
    path = [centre]
    while path[-1] is not body:
        path.append(path[-1].parent)
    articles = [n for n in path if n.tag == "article"] or [
        n for n in path if n.tag == "main" or re.search(r"role\s*=\s*[\"']?main\b|articleBody", n.attributes)
    ]
    if articles:
        centre = articles[-1]
        path = path[path.index(centre) :]
    threshold = min(n.density for n in path)
    chosen: list[Node] = []

    def add(node: Node, way: list[Node]) -> None:
        on_way = {id(n): k for k, n in enumerate(way)}
        stack = [node]
        while stack:
            one = stack.pop()
            if one is centre:
                chosen.append(one)
            elif id(one) in on_way:
                stack += [p for p in reversed(one.parts) if isinstance(p, Node)]
                if any(isinstance(p, str) and p.strip() for p in one.parts):
                    chosen.append(Node(one.tag, one.parent, "", [p for p in one.parts if isinstance(p, str)]))
            elif one.chars and (one.density >= threshold or one.tag in HEADINGS):
                chosen.append(one)

    add(body, path)
    return chosen


def _blocks(nodes: list[Node]) -> Iterator[str]:
    """Text between the bounds of block elements, white space as single spaces, without empty ones."""
    run: list[str] = []
    stack: list = [x for node in reversed(nodes) for x in (None, node, None)]
    while stack:
        item = stack.pop()
        if item is None:
            block = " ".join("".join(run).split())
            run = []
            if block:
                yield block
        elif isinstance(item, str):
            run.append(item)
        elif item.tag in ("br", "wbr"):
            run.append(" " if item.tag == "br" else "")
        else:
            inner = list(reversed(item.parts))
            stack += [None, *inner, None] if item.tag in BLOCKS else inner
    block = " ".join("".join(run).split())
    if block:
        yield block


def main_text(html: str | None) -> str:
    if not html:
        return ""
    root = parse(html)
    _prune(root)
    body = next((n for n in _elements(root) if n.tag == "body"), root)
    _measure(root, body)
    return "\n".join(_blocks(_wanted(body)))


def extract_main_text(pages: DataFrame, keys: tuple[str, ...] = ("page_id", "url"), html_col: str = "html") -> DataFrame:
    """Per row the key columns, ``text`` (blocks joined by line feeds, empty if there is none) and ``n_chars``.

    A null page is empty. Repeated rows are each extracted; an empty table gives an empty result; columns beside the
    keys are left out. Pages stay where they are: nothing is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # pages as Python strings a few at a time, whatever the size of the batch
            for low in range(0, batch.num_rows, SLICE):
                few = batch.slice(low, SLICE)
                texts = pa.array([main_text(h) for h in few.column("html").to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([*few.columns[:-1], texts], names=[*few.schema.names[:-1], "text"])

    # the keys pass through under neutral names, so that they may be called like the results
    neutral = [F.col(k).alias(f"k{i}") for i, k in enumerate(keys)]
    rows = pages.select(*neutral, F.col(html_col).cast("string").alias("html"))
    kinds = ", ".join(f"k{i} {rows.schema[f'k{i}'].dataType.simpleString()}" for i in range(len(keys)))
    out = rows.mapInArrow(run, f"{kinds}, text string")
    return out.select(
        *[F.col(f"k{i}").alias(k) for i, k in enumerate(keys)], "text", F.length("text").cast("long").alias("n_chars")
    )
