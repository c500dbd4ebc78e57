"""Main text of web pages by tree scoring.

A forgiving reader turns a page into a tree of elements.  Menus, headers,
footers, sidebars, notices, adverts, forms, comments of readers and the like go
by element and by class or id.  Every paragraph then scores points for its
length and commas and passes them to its ancestors, less with each step; a
container's points are discounted by the share of its text inside links.  The
best container is kept, with siblings that score like it or read like prose.
Outside articles, so is what stands beside it on each level up to the page: text
blocks that aren't mostly links, and headings, lists, tables and short
paragraphs next to what is kept.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

_MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>|<(/?)([A-Za-z][A-Za-z0-9:-]*)([^<>]*)(?:>|\Z|(?=<))", re.DOTALL)
_ATTRIBUTE = re.compile(r"""([A-Za-z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
_SPACE = re.compile(r"\s+")

# fixed values: the elements' roles
RAW = frozenset(("script", "style", "noscript", "template", "textarea", "svg", "iframe", "object", "canvas", "xmp", "noframes", "noembed", "title"))
VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"))
DROPPED = RAW | frozenset(("head", "nav", "footer", "aside", "button", "select", "option", "annotation", "annotation-xml", "label", "dialog", "menu", "audio", "video", "map", "input", "datalist", "progress", "meter"))
INLINE = frozenset(("a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "ruby", "rt", "rp", "math", "mrow", "mi", "mn", "mo", "mtext", "ms", "msub", "msup", "msubsup", "mfrac", "msqrt", "mroot", "munder", "mover", "munderover", "mtable", "mtr", "mtd", "mspace", "mstyle", "semantics", "mfenced", "mpadded"))
CLOSES_P = frozenset(("address", "article", "aside", "blockquote", "details", "div", "dl", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul"))
PARAGRAPHS = frozenset(("p", "pre", "td", "blockquote", "li", "h1", "h2", "h3", "h4", "h5", "h6", "dd", "dt", "figcaption"))
# fixed values: words of class and id names by what they say of an element
#: readers' comments; other boilerplate; boilerplate only where the text is short or full of links
COMMENTS = frozenset("comment comments commentlist disqus respond reply replies".split())
BOILERPLATE = frozenset(
    "ad ads adsense sponsor sponsors sponsored promo promos promotion banner cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe signup login nav navbar navigation menu menus "
    "breadcrumb breadcrumbs crumbs pagination pager sidebar sidebars widget widgets footer toolbar share shared sharing social related recommended recommendation recommendations skip skiplink hidden".split()
)
#: inside an article these are its own: bylines, legal texts, headers
OUTSIDE = frozenset("alert aside legal copyright topbar masthead".split())
WEAK = frozenset("side rail foot header discussion tag tags byline meta".split())
#: what may stand after such a word without changing its sense
PARTS = frozenset(
    "area bar block body bottom box btn button buttons card cards center column columns container content cont count feed form full group header head holder icon icons inner item items label left link links list lists main media "
    "menu module news outer page pages panel post posts article articles story stories topics reading primary region right row secondary section site small slot tab tabs text title to top unit view wrap wrapper zone thread author template".split()
)
#: of a name that begins with one of these the rest says what an element has, not what it is
MODIFIERS = frozenset("has have with without no not is show shows hide two three".split())
STOPS = frozenset("a an and as at by for from in into of on or over the to under".split())
_MAIN = re.compile(r"(?:^|[\s_-])(?:article\w*|body|content\w*|entry|main\w*|post\w*|text|story|blog)(?=$|[\s_-])", re.IGNORECASE)
_ROLES = frozenset(("navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar"))


_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
#: how sure it is that an element is no main text
WEAKLY, STRONGLY, BY_READERS, FORM = 1, 2, 3, 4


class Node:
    __slots__ = ("tag", "parent", "children", "score", "weight", "length", "links", "commas", "flag", "prose", "leads")

    def __init__(self, tag: str, parent: Node | None, weight: float = 0, flag: int = 0):
        self.tag, self.parent, self.weight, self.flag = tag, parent, weight, flag
        self.children: list[Node | str] = []
        self.score, self.length, self.links, self.commas = 0.0, 0, 0, 0
        self.prose, self.leads = 0, False


def named(name: str, inside: bool) -> int:
    """What a class or id says: 0 if it doesn't name boilerplate.  A name is one if such
    a word ends it, or has only parts of pages after it: a ``social-impact`` or a page that
    ``has-sidebar`` is none, nor is a phrase with words like ``of``."""
    parts = [w for w in re.split(r"[\W_]+", _CAMEL.sub("-", name).lower()) if w and not w.isdigit()]
    if not parts or parts[0] in MODIFIERS and len(parts) > 1:
        return 0
    found = 0
    for k, w in enumerate(parts):
        of = BY_READERS if w in COMMENTS else STRONGLY if w in BOILERPLATE or w.startswith("advert") or (w in OUTSIDE and not inside) else WEAKLY if w in WEAK and not inside else 0
        if of and all(v in PARTS or v in BOILERPLATE or v in COMMENTS or v in WEAK or len(v) < 3 and v not in STOPS for v in parts[k + 1 :]):
            found = max(found, of)
    return 0 if STOPS.intersection(parts[1:-1]) else found


def _judge(tag: str, attributes: str, inside: bool = False) -> tuple[float | None, int]:
    """(weight by class, id and role, flag); the weight is None if the element is never
    main text.  Headings and what stands inside a line aren't judged by their names."""
    if tag == "form" or tag == "fieldset":
        return 0.0, FORM
    if tag in DROPPED:
        return None, 0
    if tag in ("html", "body", "main", "article") and not (tag == "article" and inside) or not attributes.strip():
        return (25.0 if tag in ("article", "main") else 0.0), 0
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(attributes)}
    if found.get("role", "").lower() in _ROLES or found.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", found.get("style", "")):
        return None, 0
    if re.search(r"(?i)(?:^|\s)hidden(?:\s|=|$)", re.sub(_ATTRIBUTE, " ", attributes)):
        return None, 0
    names = f"{found.get('class', '')} {found.get('id', '')}"
    flag = 0 if tag in INLINE or tag in HEADINGS else max((named(n, inside) for n in names.split()), default=0)
    return (25.0 if tag in ("article", "main") or not flag and _MAIN.search(names) else 0.0), flag


HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))


def prune(root: Node) -> None:
    """Takes out elements that their names or tags flag, where what they hold agrees.

    Readers' comments go unless the page's title or main part lies in them.  Other flagged
    elements go unless they hold that, or half of the page's paragraph text: then they are
    wrappers that have a sidebar, not sidebars.  Weakly flagged ones go only if they are
    short or full of links."""
    nodes = _walk(root)
    for node in reversed(nodes):
        node.leads = node.tag in ("h1", "main")
        own = 0
        for c in node.children:
            if isinstance(c, str):
                text = len(c.strip())
                node.length += text
                own += text
            else:
                node.length += c.length
                node.links += c.length if c.tag == "a" else c.links
                own += c.length - c.links if c.tag in INLINE and c.tag != "a" else 0
                node.leads |= c.leads and c.flag != BY_READERS
                if c.tag not in INLINE and c.flag != BY_READERS:
                    node.prose += c.prose
        if node.tag in ("p", "pre", "blockquote", "dd") or node.tag in ("div", "td", "section", "article", "main", "body", "html", "form"):
            node.prose += own if own >= 25 else 0
    total = root.prose
    stack = [root]
    while stack:
        node = stack.pop()
        kept: list[Node | str] = []
        for c in node.children:
            if isinstance(c, Node) and c.flag and not _stays(c, total):
                kept.append(Node("hr", node))
            else:
                kept.append(c)
                if isinstance(c, Node):
                    stack.append(c)
        node.children = kept
    for node in nodes:
        node.length = node.links = 0


def _stays(c: Node, total: int) -> bool:
    if c.leads and (c.prose or c.flag != STRONGLY):
        return True
    if c.flag == BY_READERS:
        return False
    if c.flag == WEAKLY:
        return c.prose >= 140 and c.links * 5 < c.length
    return c.prose > 0 and c.prose * 2 >= total and c.links * 2 < c.length


def parse(page: str) -> Node:
    """The tree of a page without what is never main text."""
    root = Node("html", None)
    here, at, n = root, 0, len(page)
    last = page.rfind(">")
    skipped = 0  # depth inside a dropped element
    skip_tag = ""
    article_depth = 0
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            lt = n
        if lt > at and not skipped:
            here.children.append(page[at:lt])
        if lt >= n:
            break
        if lt > last:  # nothing closes any more: a page cut off inside a tag
            break
        m = _MARKUP.match(page, lt)
        if not m:
            if not skipped:
                here.children.append("<")
            at = lt + 1
            continue
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        closing, attributes = m[1] or m[4], m[3] or m[6] or ""
        if skipped:
            if tag == skip_tag and tag not in VOID:
                skipped += -1 if closing else 1
            continue
        if closing:
            node = here
            while node is not root and node.tag != tag:
                if tag in INLINE and node.tag not in INLINE:
                    node = root  # an inline end tag doesn't close blocks
                    break
                node = node.parent
            if node is not root:
                if tag == "article":
                    article_depth -= 1
                here = node.parent
            continue
        if tag in RAW:
            end = re.compile(rf"(?i)</{re.escape(tag)}\s*>").search(page, at)
            at = end.end() if end else (n if tag != "svg" else at)
            continue
        if tag in VOID:
            if tag in ("br", "hr", "img"):
                here.children.append(Node(tag, here))
            continue
        weight, flag = _judge(tag, attributes, article_depth > 0)
        if tag == "header" and not article_depth:
            flag = max(flag, WEAKLY)
        if weight is None:
            if not attributes.rstrip().endswith("/"):
                skipped, skip_tag = 1, tag
                if tag in CLOSES_P:
                    here = _close_p(here, root)
                here.children.append(Node("hr", here))
            continue
        if tag in CLOSES_P:
            here = _close_p(here, root)
        elif tag in ("li", "dt", "dd", "tr", "td", "th"):
            here = _close_item(here, root, tag)
        node = Node(tag, here, weight, flag)
        here.children.append(node)
        here = node
        if tag == "article":
            article_depth += 1
    return root


def _close_p(here: Node, root: Node) -> Node:
    node = here
    while node is not root:
        if node.tag == "p":
            return node.parent
        if node.tag not in INLINE:
            return here
        node = node.parent
    return here


def _close_item(here: Node, root: Node, tag: str) -> Node:
    same = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th")}[tag]
    stop = {"li": ("ul", "ol"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table")}[tag]
    node = here
    while node is not root and node.tag not in stop:
        if node.tag in same:
            return node.parent
        node = node.parent
    return here


def _walk(root: Node) -> list[Node]:
    """All nodes, parents first."""
    out = [root]
    for node in out:
        out.extend(c for c in node.children if isinstance(c, Node))
    return out


def score(root: Node) -> list[Node]:
    """Sets lengths, link lengths and points; returns the nodes, parents first."""
    prune(root)
    nodes = _walk(root)
    for node in reversed(nodes):
        for c in node.children:
            if isinstance(c, str):
                text = c.strip()
                node.length += len(text)
                node.commas += text.count(",") + text.count("、") + text.count("，")
            else:
                node.length += c.length
                node.links += c.length if c.tag == "a" else c.links
                node.commas += c.commas
    for node in nodes:
        if node.tag in PARAGRAPHS or (node.tag == "div" and any(isinstance(c, str) and c.strip() for c in node.children)):
            if node.length < 25:
                continue
            points = 1 + node.commas + min(node.length / 100, 3)
            if node.tag == "li" or node.tag.startswith("h"):
                points = min(points, 1)
            up, share = node.parent, 1.0
            for level in range(5):
                if up is None:
                    break
                up.score += points * share
                up, share = up.parent, 0.5 if level == 0 else share * 0.6
    for node in nodes:
        node.score = (node.score + node.weight) * (1 - (node.links / node.length if node.length else 0))
    return nodes


def blocks(node: Node, out: list[list[str]]) -> None:
    """Appends the text of a node as blocks, in page order."""
    stack: list[tuple[Node, int]] = [(node, 0)]
    while stack:
        here, k = stack.pop()
        if k == 0 and here.tag not in INLINE:
            out.append([])
        while k < len(here.children):
            c = here.children[k]
            k += 1
            if isinstance(c, str):
                out[-1].append(c)
            elif c.tag in ("br", "img"):
                out[-1].append(" ")
            else:
                stack.append((here, k))
                stack.append((c, 0))
                break
        else:
            if here.tag not in INLINE:
                out.append([])


def best_nodes(nodes: list[Node]) -> list[Node]:
    """The best container and those of its siblings that belong to it, in page order."""
    root = nodes[0]
    articles = [n for n in nodes if n.tag == "article" and n.length]
    pool = [n for n in nodes if n.tag not in INLINE and n.tag not in ("p", "li", "tr", "hr", "br", "img") and n.length]
    if not pool:
        return [root]
    best = max(pool, key=lambda n: (n.score, n.length))
    within = [best]
    while within[-1].parent is not None:
        within.append(within[-1].parent)
    main = next((n for n in within if n.tag == "main" and n.length), None)
    own = next((n for n in within if n.tag == "article" and n.length), None)
    if own is None and main is None and len(articles) == 1 and articles[0].length * 4 >= root.length:
        own = articles[0]
    if main is not None and best is main:
        return [main]
    best = own or main or best  # a part of an article stands for the article
    if best.parent is None or best is main:
        return [best]
    least = max(10.0, best.score * 0.2)
    out, here = [best], best
    while here.parent is not None:
        siblings = here.parent.children
        kept = [c is here or _belongs(c, least, own is not None and main is None) for c in siblings]
        if own is None or main is not None:
            _spread(siblings, kept)
        else:
            _appended(siblings, kept)
        level: list[Node] = []
        for c, keep in zip(siblings, kept, strict=True):
            if c is here:
                level.extend(out)
            elif keep:
                level.append(_wrap(c, here.parent))
        out, here = level, here.parent
        if here is main or own is not None and main is None:
            break
    return out


def _appended(children: list[Node | str], kept: list[bool]) -> None:
    """Keeps what follows an article under a heading of its own: an appendix, notes."""
    beside = False
    for k, c in enumerate(children):
        if isinstance(c, str) or c.tag in ("hr", "br", "img") or not c.length:
            continue
        if kept[k]:
            beside = True
        elif beside and c.tag in _BESIDE and c.tag not in INLINE and _density(c) < 0.3 and (c.tag in HEADINGS or any(isinstance(b, Node) and b.tag in HEADINGS and kept[j] for j, b in enumerate(children[:k]))):
            kept[k] = True
        else:
            beside = False


def _wrap(c: Node | str, parent: Node) -> Node:
    if isinstance(c, Node):
        return c
    node = Node("span", parent)
    node.children.append(c)
    return node


def _density(c: Node) -> float:
    return c.links / c.length if c.length else 1.0


def _belongs(c: Node | str, least: float, inside: bool) -> bool:
    """Whether a sibling of what is kept is text in its own right."""
    if not isinstance(c, Node) or c.tag in ("hr", "br", "img"):
        return False
    density = _density(c)
    if c.tag in ("p", "blockquote", "pre") and (c.length > 80 and density < 0.25 or 0 < c.length <= 80 and density == 0 and c.commas > 0):
        return True
    if c.tag in INLINE or density >= 0.3:
        return False
    return c.score >= least or (not inside and c.weight >= 0 and c.score > 0)


def _spread(children: list[Node | str], kept: list[bool]) -> None:
    """Keeps texts, headings, lists, tables and paragraphs that stand next to a
    kept sibling, or next to one of these."""
    for order in (range(len(children)), range(len(children) - 1, -1, -1)):
        beside = False
        for k in order:
            c = children[k]
            if isinstance(c, str):
                plain = True
                if not c.strip():
                    continue
            elif c.tag in ("hr", "br", "img") or not c.length:
                continue
            else:
                plain = c.tag in _BESIDE and _density(c) < 0.3 and c.weight >= 0
            kept[k] = kept[k] or (beside and plain)
            beside = kept[k]


_BESIDE = INLINE | frozenset(("p", "pre", "blockquote", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "dl", "table", "figure", "header", "hgroup"))


def extract(page: str | None) -> str:
    """The main text of a page: blocks joined by two newlines; empty if none."""
    if not page:
        return ""
    nodes = score(parse(page))
    out: list[list[str]] = []
    inline = False
    for node in best_nodes(nodes):
        if not (inline and node.tag in INLINE):
            out.append([])
        inline = node.tag in INLINE
        blocks(node, out)
    texts = (_SPACE.sub(" ", html.unescape("".join(b))).strip() for b in out if b)
    return "\n\n".join(t for t in texts if t)


def main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of whole pages.

    Null or empty html, and pages without text, give an empty text; broken
    markup is read as browsers do, roughly; repeated rows give repeated results;
    further columns are not read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
