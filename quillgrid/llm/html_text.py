"""Main text of web pages by composite text density.

A page becomes a tree; what is never article text (menus, forms, scripts, adverts, reader
comments and so on, by tag, role or class) is left out of it, unless it holds most of the text. Each node has a density: its
characters per tag, adjusted by how much of them is link text. The node whose children's
densities sum up highest is the core of the article. Siblings of the nodes between it and
the body belong to the article too if their density reaches the lowest one on that path.
An article or main element around the core, or one that holds most of it, is taken whole.

Nulls: a null or empty page has an empty text and 0 characters. Rows that repeat get the
same text each. Broken markup never fails: what is open at the end is closed there.
"""

import html
import re
from math import e, log

import pyarrow as pa
from pyspark.sql import DataFrame

from quillgrid.llm.text import per_batch, raw

_MARK = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*|[^>]*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|([^\s=/]+)")

# Kinds of HTML elements.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes", "noscript"}
BLOCK = set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer "
            "form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section "
            "summary table tbody tfoot thead tr ul".split())
#: What the start of an element ends, if it is open within the nearest of the second set.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
        "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
        "tbody": ({"tbody", "thead", "tfoot", "tr"}, {"table"}), "option": ({"option"}, {"select"})}
AWAY = set("head script style noscript template nav footer aside form button input select textarea iframe svg canvas object "
           "audio video map dialog menu title math embed noembed noframes search".split())
AWAY_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "menu", "menubar", "form"}
#: Of these, what never has text that a reader sees; the others stay if they hold most of the page.
UNSEEN = set("head script style noscript template input select textarea iframe svg canvas object audio video map title math embed "
             "noembed noframes".split())
AWAY_NAMES = re.compile(
    r"nav|navbar|navigation|menus?|breadcrumbs?|sidebar|side-?bar|foot|footer|masthead|banner|ads?|advert\w*|"
    r"sponsor\w*|promo\w*|cookies?|consent|gdpr|notices?|popup|modal|overlay|newsletter|subscribe|subscription|signup|share|sharing|"
    r"social|related|recommend\w*|comments?|comment-?list|disqus|replies|respond|widget|toolbar|pagination|pager|copyright|login|"
    r"search|skip", re.I)
HEADER = re.compile(r"header|head", re.I)
COMMENTS = re.compile(r"comments?|comment-?list|disqus|replies|respond", re.I)
#: Words that such names are combined with; a name with any other part, as has-sidebar or elementor-widget, tells nothing.
PLACES = set("site page global main primary secondary top bottom left right area bar bars box block list links link buttons button icons "
             "container wrap wrapper inner outer section item items form header head post posts article articles text js 1 2 3".split())


def named(names: str, of: re.Pattern) -> bool:
    """Whether one of the names is a word of the pattern, or made of some and of places only."""
    for name in names.split():
        if of.fullmatch(name):
            return True
        parts = [x for x in re.split("[-_]+", name) if x]
        hits = [bool(of.fullmatch(x)) for x in parts]
        if any(hits) and all(hit or x.lower() in PLACES for hit, x in zip(hits, parts)):
            return True
    return False


class Node:
    __slots__ = ("tag", "names", "role", "hidden", "parent", "items", "chars", "link_chars", "tags", "link_tags", "density", "sum", "plain")

    def __init__(self, tag: str, parent: "Node | None", attributes: str = ""):
        self.tag, self.parent, self.items = tag, parent, []
        self.names, self.role, self.hidden = "", "", False
        for m in _ATTRIBUTE.finditer(attributes) if attributes else ():
            name, value = (m[1] or m[5]).lower(), m[2] or m[3] or m[4] or ""
            if name in ("class", "id"):
                self.names += " " + value
            elif name == "role":
                self.role = value.lower()
            elif name == "hidden" or (name == "aria-hidden" and value == "true") or (
                    name == "style" and "display:none" in value.replace(" ", "").lower()):
                self.hidden = True


def parse(page: str) -> Node:
    """The tree of a page; strings among a node's items are text as written."""
    root = top = Node("html", None)
    at, end = 0, len(page)
    while at < end:
        m = _MARK.search(page, at)
        if m is None:
            top.items.append(page[at:])
            break
        if m.start() > at:
            top.items.append(page[at:m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            node = top
            while node is not None and node.tag != tag:
                node = node.parent
            if node is not None and node.parent is not None:
                top = node.parent
            continue
        if tag == "html":
            continue
        if tag in ENDS:
            closes, within = ENDS[tag]
            node, last = top, None
            while node is not None and node.tag not in within:
                last, node = (node if node.tag in closes else last), node.parent
            top = last.parent if last is not None else top
        elif tag in BLOCK:
            node = top                        # a block ends an open paragraph of its own box
            while node is not None and node.tag not in ("p", "td", "th", "table", "button", "div", "article", "section", "body"):
                node = node.parent
            if node is not None and node.tag == "p":
                top = node.parent
        node = Node(tag, top, m[3])
        top.items.append(node)
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            node.items.append(page[at:close.start() if close else end])
            at = close.end() if close else end
        elif tag not in VOID and not m[3].rstrip().endswith("/"):
            top = node
    return root


def _inside(node: Node, tags: tuple[str, ...]) -> bool:
    while node.parent is not None:
        node = node.parent
        if node.tag in tags:
            return True
    return False


def _nodes(root: Node):
    todo = [root]
    while todo:
        n = todo.pop()
        yield n
        todo += [x for x in reversed(n.items) if isinstance(x, Node)]


def _below(node: Node, tags: tuple[str, ...]):
    return (n for n in _nodes(node) if n is not node and n.tag in tags)


def _count_plain(root: Node) -> None:
    """Characters outside of links that a reader sees, below each node."""
    order = list(_nodes(root))
    for n in reversed(order):
        n.plain = 0 if n.tag in UNSEEN or n.tag == "a" or n.hidden else sum(
            len(" ".join(x.split())) if isinstance(x, str) else x.plain for x in n.items)


def away(node: Node, total: int, marked: bool) -> bool:
    """Whether a node is never part of an article.

    One that holds an article, for want of an end tag as a rule, is not; nor is one that holds
    most of the ``total`` characters of the page (nearly all, for elements such as footer and for
    readers' comments), unless the page is ``marked`` by an article elsewhere.
    """
    if node.tag in ("html", "body", "main"):
        return False
    sure = node.tag in AWAY - {"form"} or named(node.names, COMMENTS)
    if node.tag not in UNSEEN and (10 * node.plain > 9 * total if sure else 2 * node.plain > total) and (
            not marked or _inside(node, ("article", "main"))):
        return False
    if node.tag in AWAY or node.hidden or node.role in AWAY_ROLES or named(node.names, AWAY_NAMES):
        return not any(not named(n.names, AWAY_NAMES) for n in _below(node, ("article", "main")))
    if node.tag == "header" or (node.names and node.tag not in ("article", "h1", "h2", "h3") and named(node.names, HEADER)):
        return not (_inside(node, ("article", "main")) and any(_below(node, ("h1", "h2"))) or any(_below(node, ("article", "main"))))
    return False


def _prune_and_count(node: Node) -> None:
    """Leave out what is no article text, and count characters and tags below each node."""
    _count_plain(node)
    marked = any(not named(n.names, AWAY_NAMES) for n in _below(node, ("article", "main")))
    order, todo = [], [node]
    while todo:
        n = todo.pop()
        n.items = [x for x in n.items if isinstance(x, str) or not away(x, node.plain, marked)]
        order.append(n)
        todo += [x for x in n.items if isinstance(x, Node)]
    for n in reversed(order):
        n.chars = sum(len(" ".join(x.split())) for x in n.items if isinstance(x, str))
        n.link_chars = n.link_tags = 0
        n.tags = 1
        for x in n.items:
            if isinstance(x, Node):
                n.chars += x.chars
                n.tags += x.tags
                n.link_chars += x.link_chars
                n.link_tags += x.link_tags
        if n.tag == "a":
            n.link_chars, n.link_tags = n.chars, n.link_tags + 1


def density(n: Node, body: Node) -> float:
    """Characters per tag, adjusted by links; a count of 0 below a line counts as 1."""
    if not n.chars:
        return 0.0
    plain = max(1, n.chars - n.link_chars)
    base = log(n.chars / plain * n.link_chars + body.link_chars / max(1, body.chars) * n.chars + e)
    links = n.chars / max(1, n.link_chars) * n.tags / max(1, n.link_tags)
    return n.chars / n.tags * log(max(links, 1.0)) / log(max(base, 1.05))


def article(root: Node) -> list[Node | str]:
    """What of the page is article, in page order."""
    body = next((n for n in _nodes(root) if n.tag == "body"), root)
    _prune_and_count(body)
    every = list(_nodes(body))
    for n in every:
        n.density = density(n, body)
    best, most = body, -1.0
    for n in every:
        n.sum = sum(x.density for x in n.items if isinstance(x, Node))
        if n.sum > most:
            best, most = n, n.sum
    for tag in ("article", "main"):
        n = best
        while n is not body and n.tag != tag:
            n = n.parent
        if n.tag == tag:
            # one of several articles is not the whole of their main element
            outer = n
            while tag == "article" and outer is not body and outer.tag != "main":
                outer = outer.parent
            return [outer if outer.tag == "main" and 2 * n.plain < outer.plain else n]
    marked = [n for n in every if n.tag in ("article", "main") and 2 * n.chars >= best.chars > 0]
    if marked:
        return [max(marked, key=lambda n: n.chars)]
    path = [best]
    while path[-1] is not body:
        path.append(path[-1].parent)
    least = min(n.density for n in path)
    chosen: list[Node | str] = [best]
    for inner, outer in zip(path, path[1:]):
        at = next(k for k, x in enumerate(outer.items) if x is inner)
        fits = [k for k, x in enumerate(outer.items) if k == at or (isinstance(x, Node) and x.chars and x.density >= least)]
        low, high = fits[0], fits[-1]
        # a heading right before the article is its title
        while low and (isinstance(outer.items[low - 1], str) and not outer.items[low - 1].strip()
                       or isinstance(outer.items[low - 1], Node) and outer.items[low - 1].tag in ("h1", "h2", "h3")):
            low -= 1
        chosen = outer.items[low:at] + chosen + outer.items[at + 1:high + 1]
    return chosen


def blocks(items: list[Node | str]) -> list[str]:
    """Text of each block: white space is one blank, character references are decoded."""
    out: list[str] = []
    part: list[str] = []

    def close() -> None:
        text = " ".join(html.unescape("".join(part)).split())
        part.clear()
        if text:
            out.append(text)
    todo: list = list(reversed(items))
    while todo:
        x = todo.pop()
        if x is None:
            close()
        elif isinstance(x, str):
            part.append(x)
        else:
            block = x.tag in BLOCK
            if block:
                close()
                todo.append(None)
            if x.tag in ("br", "td", "th"):
                part.append(" ")
            todo.extend(reversed(x.items))
    close()
    return out


def main_text(page: str) -> str:
    return "\n".join(blocks(article(parse(page)))) if page else ""


def extracted(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of every page."""
    def made(batch: pa.RecordBatch) -> dict:
        texts = [main_text(x.decode()) for x in raw(batch, "html")]
        return {"page_id": batch.column("page_id").cast(pa.int64()), "url": batch.column("url"), "text": texts,
                "n_chars": [len(t) for t in texts]}
    return per_batch(pages.select("page_id", "url", "html"), made, "page_id long,url string,text string,n_chars long")
