"""Main text of web pages by composite text density."""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element names by their role in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
DROPPED = frozenset(
    "head script style noscript template textarea title xmp iframe noembed noframes nav footer aside select option datalist dialog menu "
    "object embed applet svg annotation annotation-xml canvas audio video map input".split()
)
# Controls that may stand in a sentence: their text stays there, and goes elsewhere.
CONTROLS = frozenset(("button", "label"))
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCKS - frozenset("caption dd dt li legend tbody td tfoot th thead tr body html summary".split())
# A start tag ends an open element of these names, up to the nearest of the second names.
IMPLIED = {
    "li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "option": ("option", "select"), "tr": ("tr td th", "table"),
    "td": ("td th", "tr table"), "th": ("td th", "tr table"), "thead": ("tr td th tbody tfoot thead", "table"),
    "tbody": ("tr td th tbody tfoot thead", "table"), "tfoot": ("tr td th tbody tfoot thead", "table"),
}
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
# Words of class and id that mark what is not the article.
BOILERPLATE = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disqus "
    "footer gdpr login masthead menu modal nav navbar navigation newsletter notice notices notification outbrain overlay pager pagination popup promo "
    "promoted promotion recommended related replies reply respond search share sharing shoutbox sidebar sidenav signup skyscraper social sponsor "
    "sponsored subscribe subscription taboola toolbar topbar widget widgets".split()
)
READERS = frozenset("comment comments commentlist disqus replies reply respond shoutbox".split())
# Words of class and id that mark an article, whatever else the element is called.
ARTICLE = frozenset("article content entry hentry main post story text".split())
# Characters without spaces of a block from which on it counts as prose, on a page of any length.
PROSE = 60
KEPT_NAMES = frozenset("html body main article".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

# A quote that is not closed is an ordinary character.
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:\"[^\"]*\"|'[^']*'|[^>])*+)>", re.S)
# As deep as browsers nest elements; deeper ones are children of the last level.
DEEPEST = 512
_ATTRIBUTE = re.compile(r"([^\s=\"'>/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_NAME_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class Node:
    """An element: name, attributes, and children, which are nodes or strings."""

    __slots__ = ("attributes", "children", "density", "depth", "link_chars", "link_tags", "name", "own", "parent", "tags", "total", "chars")

    def __init__(self, name: str, parent: Node | None, attributes: str = ""):
        self.name, self.parent, self.attributes = name, parent, attributes
        self.depth = parent.depth + 1 if parent else 0
        self.children: list[Node | str] = []


def _closed(source: str, name: str, at: int) -> tuple[int, int]:
    """Begin and end of the end tag of a raw element; the end of the page if there is none."""
    end = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(source, at)
    return (end.start(), end.end()) if end else (len(source), len(source))


def parsed(source: str) -> Node:
    """The element tree of a page, with end tags supplied where HTML lets them be left out."""
    root = Node("#root", None)
    at, node, size = 0, root, len(source)
    last = source.rfind(">")
    while at < size:
        tag = source.find("<", at)
        # Without another ">" only comments and the like can begin.
        match = _TOKEN.match(source, tag) if tag >= 0 and (tag < last or source[tag + 1 : tag + 2] in ("!", "?")) else None
        if tag < 0 or match is None:
            stop = size if tag < 0 else tag + 1
            node.children.append(html.unescape(source[at:stop]))
            at = stop
            continue
        if tag > at:
            node.children.append(html.unescape(source[at:tag]))
        at = match.end()
        closing, name = match[1], (match[2] or "").lower()
        if not name:
            if match[0].startswith("<![CDATA["):
                node.children.append(match[0][9:].removesuffix("]]>"))
            continue
        if closing:
            node = _ended(node, name)
            continue
        if name in CLOSES_P:
            node = _until(node, frozenset(["p"]), BLOCKS - {"p"})
        if name in IMPLIED:
            names, limits = IMPLIED[name]
            node = _until(node, frozenset(names.split()), frozenset(limits.split()))
        if name in ("body", "html") and any(x.name == name for x in _above(node)):
            continue
        new = Node(name, node, match[3])
        node.children.append(new)
        if name in RAW:
            begin, end = _closed(source, name, at)
            new.children.append(source[at:begin])
            at = end
        elif name not in VOID and new.depth < DEEPEST:
            node = new
    return root


def _above(node: Node | None) -> Iterator[Node]:
    while node is not None:
        yield node
        node = node.parent


def _until(node: Node, names: frozenset, limits: frozenset) -> Node:
    """Close the outermost of `names` that is open inside the nearest of `limits`."""
    out = node
    for x in _above(node):
        if x.name in names and x.parent is not None:
            out = x.parent
        elif x.name in limits:
            break
    return out


def _ended(node: Node, name: str) -> Node:
    for x in _above(node):
        if x.name == name and x.parent is not None:
            return x.parent
        if x.name in BLOCKS and name not in BLOCKS:
            break
    return node


def _ordered(root: Node) -> list[Node]:
    """All elements, parents before children, in page order."""
    out, open_nodes = [], [root]
    while open_nodes:
        x = open_nodes.pop()
        out.append(x)
        open_nodes += [c for c in reversed(x.children) if isinstance(c, Node)]
    return out


def _name_words(attributes: str) -> tuple[set[str], set[str], bool, bool]:
    """Words of class and id, roles, whether the element is hidden, and whether from screen readers only."""
    words: set[str] = set()
    roles: set[str] = set()
    hidden = muted = False
    for m in _ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key in ("class", "id"):
            words |= {w.lower() for w in _NAME_WORDS.findall(value)}
        elif key == "role":
            roles |= set(value.lower().split())
        elif key == "hidden" or (key == "style" and _HIDDEN.search(value)):
            hidden = True
        elif key == "aria-hidden" and value.lower() == "true":
            muted = True
    return words, roles, hidden, muted


def _spoken(children: list[Node | str], at: int) -> bool:
    """Whether a child stands in running text: words before and after it, right beside."""
    around = (children[at - 1] if at else "", children[at + 1] if at + 1 < len(children) else "")
    return all(isinstance(c, str) and not c.isspace() and c for c in around)


def _measured(nodes: list[Node]) -> None:
    """Characters, tags and link shares of every subtree."""
    for x in nodes:
        x.own = sum(len(c) - c.count(" ") for c in x.children if isinstance(c, str))
    for x in reversed(nodes):
        inside = [c for c in x.children if isinstance(c, Node)]
        x.chars = x.own + sum(c.chars for c in inside)
        x.tags = sum(c.tags + 1 for c in inside)
        if x.name == "a":
            x.link_chars, x.link_tags = x.chars, x.tags
        else:
            x.link_chars = sum(c.link_chars for c in inside)
            x.link_tags = sum(c.link_tags + (c.name == "a") for c in inside)


def _stripped(root: Node) -> None:
    """Remove what is no article by its name, role, class or state.

    What readers wrote goes by its name, unless it is or holds an `article` or `main` element that
    is not a comment itself. Forms, elements muted while a dialog is open, and elements named
    like boilerplate are left to `_judged`: any of them may be wrapped around the page.
    """
    nodes = _ordered(root)
    named = {id(x): _name_words(x.attributes) for x in nodes if x.attributes}
    nothing = (set(), set(), False, False)
    landmark: dict[int, bool] = {}
    article: dict[int, bool] = {}
    for x in reversed(nodes):
        words = named.get(id(x), nothing)[0]
        own = x.name in ("article", "main")
        inside = [c for c in x.children if isinstance(c, Node)]
        landmark[id(x)] = own or any(landmark[id(c)] for c in inside)
        article[id(x)] = (own and not (words & READERS and not words & ARTICLE)) or any(article[id(c)] for c in inside)
    doubtful: set[int] = set()
    articles: set[int] = set()
    for x in nodes:
        kept: list[Node | str] = []
        for at, c in enumerate(x.children):
            if isinstance(c, Node):
                if c.name in DROPPED or (c.name in CONTROLS and not _spoken(x.children, at)):
                    continue
                if c.name == "header" and not any(a.name in ("article", "main") for a in _above(x)):
                    continue
                own = c.name in ("article", "main")
                if own:
                    articles.add(id(c))
                if c.name == "form" and not landmark[id(c)]:
                    doubtful.add(id(c))
                if c.attributes and c.name not in ("html", "body"):
                    words, roles, hidden, muted = named[id(c)]
                    if hidden or roles & DROPPED_ROLES:
                        continue
                    if words & READERS and not (own and words & ARTICLE):
                        if not own and not article[id(c)]:
                            continue
                        doubtful.add(id(c))
                    if words & ARTICLE:
                        articles.add(id(c))
                    if not landmark[id(c)] and (muted or (words & BOILERPLATE and c.name not in KEPT_NAMES)):
                        doubtful.add(id(c))
            kept.append(c)
        x.children = kept
    doubtful &= {id(x) for x in _ordered(root)}  # not those inside what has gone
    while doubtful:
        _judged(root, doubtful, articles)


class Part:
    """What `_judged` knows of a subtree or the rest of the page: its thickest block, whether it has a title and lies in a landmark."""

    __slots__ = ("landmark", "node", "thick", "title")

    def __init__(self, node: Node, landmark: bool = False):
        self.node, self.landmark, self.thick, self.title = node, landmark, 0, False


def _judged(root: Node, doubtful: set[int], articles: set[int]) -> None:
    """Remove the outermost `doubtful` subtrees, or settle that they stay; those inside come next.

    A block's characters outside links are its thickness, if links do not hold half of it. A
    subtree goes if the rest of the page holds an article: a block of prose, one at least
    as thick, or an `article` or `main` element with text that is not around it. A form without prose goes if there is
    any other block. If the subtree is also named as an article or has the only title, the prose
    has to be inside an element named as an article; if another such subtree has prose, that is the article.
    """
    rest, named, landmarks = Part(root), Part(root), False
    parts: list[Part] = []
    blocks: list[tuple[Part, bool, list[int]]] = []
    todo: list[tuple[Node, Part, bool, bool, bool, list[int]]] = [(root, rest, False, False, False, [0, 0])]
    while todo:
        x, part, inside, landmark, linked, block = todo.pop()
        if part is rest and id(x) in doubtful:
            part = Part(x, landmark)
            parts.append(part)
            block = [0, 0]
            blocks.append((part, False, block))
        inside = inside or id(x) in articles
        landmark = landmark or x.name in ("article", "main")
        linked = linked or x.name == "a"
        part.title = part.title or x.name == "h1"
        if x.name in BLOCKS or x is root:
            block = [0, 0]
            if x.name not in HEADINGS:
                blocks.append((part, inside, block))
        for c in x.children:
            if isinstance(c, Node):
                todo.append((c, part, inside, landmark, linked, block))
            else:
                block[linked] += sum(map(len, c.split()))
                landmarks = landmarks or (landmark and part is rest and not linked and not c.isspace())
    for part, inside, (plain, link) in blocks:
        if plain > link:
            part.thick = max(part.thick, plain)
            if part is rest and inside:
                named.thick = max(named.thick, plain)
    as_article = {id(p): id(p.node) in articles or (p.title and not rest.title) for p in parts}
    other = any(as_article[id(p)] and p.thick >= PROSE for p in parts)
    gone: dict[int, Node] = {}
    for p in parts:
        doubtful.discard(id(p.node))
        prose = (named if as_article[id(p)] else rest).thick >= PROSE
        beside = landmarks and not p.landmark and not as_article[id(p)]
        thinner = rest.thick >= p.thick and not (p.node.name in ("article", "main") and p.thick >= PROSE)
        bare = p.node.name == "form" and p.thick < PROSE and rest.thick > 0
        if prose or beside or thinner or bare or (other and not as_article[id(p)]):
            gone[id(p.node)] = p.node
            doubtful.difference_update(id(x) for x in _ordered(p.node))
    for above in {id(x.parent): x.parent for x in gone.values()}.values():
        above.children = [c for c in above.children if id(c) not in gone]


def _density(x: Node, share: float) -> float:
    c, t, lc, lt = x.chars, max(1, x.tags), max(1, x.link_chars), max(1, x.link_tags)
    if not c:
        return 0.0
    base = math.log(c / max(1, c - x.link_chars) * x.link_chars + share * c + math.e)
    return c / t * max(0.0, math.log(max(1.0, c / lc * t / lt))) / base


def _densities(nodes: list[Node], body: Node) -> None:
    """Composite text density of every node: characters per tag, lowered by links."""
    share = body.link_chars / max(1, body.chars)
    for x in nodes:
        x.density = _density(x, share)
    for x in nodes:
        x.total = sum(c.density for c in x.children if isinstance(c, Node))


def _grouped(node: Node, on_path: set[int]) -> list[Node | list[Node | str]]:
    """The children of a node, with runs of strings and inline elements as lists."""
    out: list[Node | list[Node | str]] = []
    for c in node.children:
        if isinstance(c, Node) and (id(c) in on_path or any(x.name in BLOCKS for x in _ordered(c))):
            out.append(c)
        elif out and isinstance(out[-1], list):
            out[-1].append(c)
        else:
            out.append([c])
    return out


def _block(run: list[Node | str], parent: Node, share: float) -> Node:
    """A block of a run of strings and inline elements; its line breaks are no tags."""
    x = Node("div", parent)
    x.children = run
    _measured([x])
    x.tags -= sum(n.name in ("br", "wbr") for c in run if isinstance(c, Node) for n in _ordered(c))
    x.density = _density(x, share)
    return x


def _text(start: list[Node]) -> list[str]:
    """Blocks of the subtrees in page order."""
    blocks: list[str] = []
    held: list[str] = []

    def end() -> None:
        text = " ".join("".join(held).split())
        if text:
            blocks.append(text)
        held.clear()

    todo: list[Node | str | None] = list(reversed(start))
    while todo:
        x = todo.pop()
        if x is None:
            end()
        elif isinstance(x, str):
            held.append(x)
        elif x.name == "br":
            held.append(" ")
        else:
            block = x.name in BLOCKS
            if block:
                end()
                todo.append(None)
            todo += reversed(x.children)
    end()
    return blocks


def main_text(source: str | None) -> str:
    """The article of a page as blocks joined by blank lines; see `extracted`."""
    if not source:
        return ""
    root = parsed(source)
    _stripped(root)
    nodes = _ordered(root)
    body = next((x for x in nodes if x.name == "body"), root)
    nodes = _ordered(body)
    _measured(nodes)
    _densities(nodes, body)
    best = max(nodes, key=lambda x: x.total)
    if best.total == 0.0:
        best = body
    for x in _above(best):
        if x.name in ("article", "main"):
            return "\n\n".join(_text([x]))
    # What is as dense as the thinnest node on the way to the body belongs to the article.
    path = list(_above(best))
    path = path[: path.index(body) + 1]
    threshold = min(x.density for x in path)
    if best is body:
        return "\n\n".join(_text([body]))
    chosen: list[Node] = []
    on_path = set(map(id, path))
    share = body.link_chars / max(1, body.chars)

    def dense(c: Node) -> bool:
        return c.density >= threshold and c.chars > 0 and 2 * c.link_chars < c.chars

    todo = [body]
    while todo:
        x = todo.pop()
        if x is best or id(x) not in on_path:
            chosen.append(x)
            continue
        inside: list[Node] = []
        for c in _grouped(x, on_path):
            if isinstance(c, Node):
                if id(c) in on_path or c.name in HEADINGS or dense(c):
                    inside.append(c)
                continue
            # A run that is too thin as a whole may still hold a piece that is not.
            block = _block(c, x, share)
            pieces = [block] if dense(block) else [p if isinstance(p, Node) else _block([p], x, share) for p in c]
            inside += filter(dense, pieces)
        todo += reversed(inside)
    return "\n\n".join(_text(chosen))


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(page.as_py()) for page in batch.column(2)]
        columns = [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text", "n_chars"])


def extracted(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every page, from the whole html.

    Subtrees whose name, role, class or state rules them out go first; those named like
    sidebars or adverts go if the rest of the page still holds an article (`_judged`), whatever
    the lengths of both and of scripts. Then every node has
    its composite text density, a node's sum is that of its children's densities, and the
    node of the largest sum is the article. Inside an `article` or `main` element that
    element is taken; elsewhere also what is as dense as the thinnest node between the
    article and the body, and the headings on that way; there a run of strings and inline
    elements between blocks is a block too. White space in a block is one space.

    Null and empty pages give an empty text; a page without text too. Null and repeated ids
    keep their rows; an empty table gives no rows; other columns are ignored.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html"))
    return rows.mapInArrow(_run, "page_id long, url string, text string, n_chars long")
