"""Main text of web pages by composite text density over the DOM."""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitchlake.llm.common import byte_batches, fresh, table

# Element names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
NEVER = frozenset("head script style noscript template iframe object svg math canvas audio video nav footer aside form button select option textarea input label fieldset dialog menu".split())
BLOCKS = frozenset("address article aside blockquote body br caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main nav ol p pre section summary table tbody td tfoot th thead title tr ul".split())
#: What a start tag closes, and where the search for it ends.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr"}, {"table"}), "tfoot": ({"tbody", "thead", "tr"}, {"table"}),
}
ENDS_P = BLOCKS - {"br", "caption", "tbody", "td", "tfoot", "th", "thead", "tr", "html", "body", "title", "legend"}
FORMATS = frozenset("a b big code em font i s small strike strong tt u".split())
CONTENT = frozenset(("article", "main"))
#: Blocks that are parts of a text and not its place.
LEAVES = frozenset("p br li td th tr h1 h2 h3 h4 h5 h6 dt dd pre".split())
#: Words of class, id and role that mark what is no part of an article.
UNWANTED = re.compile(
    r"(?:^|[^a-z])(?:ads?|advert\w*|adsense|adbox|banner|sponsor\w*|promo\w*|sidebar|side-?bar|nav\w*|menus?|breadcrumbs?|footer|masthead|page-?header|site-?header|topbar|toolbar|"
    r"comments?|comment-?\w*|disqus|replies|reply|respond|discussion|cookies?|consent|gdpr|notices?|notification|alert|popup|modal|overlay|newsletter|subscri\w*|signup|login|"
    r"share|sharing|social|related|recommend\w*|widget|pagination|pager|skip|hidden|search|complementary|navigation|contentinfo)(?:$|[^a-z])"
)
#: Those of readers' words; they mark comments in any compound.
COMMENTS = re.compile(r"(?:^|[^a-z])(?:comments?|comment-?\w*|disqus|replies|reply|respond|discussion)(?:$|[^a-z])")
#: Words that say what a wrapper has or lacks, not what it is.
ABOUT = re.compile(r"\b(?:no|has|with|without|hide|show)-[\w-]+")
TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
SPACE = re.compile(r"\s+")


#: Elements that CLOSES looks for or stops at.
MARKS = frozenset().union(*[ends | stop for ends, stop in CLOSES.values()])


#: What name and attributes say of an element.
WANTED, DOUBTFUL, DROPPED = range(3)


class Node:
    """An element. What a start tag asks of its ancestors is carried down, so that depth costs nothing."""

    __slots__ = ("name", "parent", "kids", "drop", "doubt", "content", "paragraph", "mark", "chars", "tags", "link_chars", "link_tags", "density", "total")

    def __init__(self, name: str, parent: Node | None, unwanted: int = WANTED):
        self.name, self.parent, self.drop, self.doubt = name, parent, unwanted != WANTED, unwanted == DOUBTFUL
        self.content: bool = name in CONTENT or (parent is not None and parent.content)  # within an article or main element
        #: The open p around it with nothing but formats between, and the nearest element of MARKS.
        self.paragraph: Node | None = self if name == "p" else parent.paragraph if parent is not None and (name in FORMATS or name == "span") else None
        self.mark: Node | None = self if name in MARKS else parent.mark if parent is not None else None
        self.kids: list[Node | str] = []
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0


def _unwanted(name: str, attributes: str, inside: Node) -> int:
    """DROPPED for what is never part of an article; DOUBTFUL where an unwanted word is only part of a class, id or role,
    as in right-sidebar or social-science: such names are also given to what lies beside or around it."""
    if name in NEVER:
        return DROPPED
    if name == "header":
        return WANTED if inside.content else DROPPED
    if not attributes or name in ("html", "body", "article", "main"):
        return WANTED
    found = WANTED
    for m in ATTRIBUTE.finditer(attributes):
        kind, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if kind == "hidden" or (kind == "aria-hidden" and value == "true") or (kind == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value)):
            return DROPPED
        if kind in ("class", "id", "role"):
            if COMMENTS.search(value) or (not inside.content and "header" in value.split()):
                return DROPPED
            for word in ABOUT.sub(" ", value).split():
                m = UNWANTED.search(word)
                if m and m[0] == word:
                    return DROPPED
                found = DOUBTFUL if m else found
    return found


def _settle(root: Node) -> None:
    """Keep doubtful elements that hold more than half of the page's unlinked text; the others stay dropped."""
    nodes, stack = [], [root]
    while stack:
        node = stack.pop()
        nodes.append(node)
        stack.extend(k for k in node.kids if isinstance(k, Node) and (k.doubt or not k.drop))
    if not any(n.doubt for n in nodes):
        return
    for node in reversed(nodes):
        own = sum(len(SPACE.sub("", k)) for k in node.kids if isinstance(k, str))
        node.chars = 0 if node.name == "a" else own + sum(k.chars for k in node.kids if isinstance(k, Node) and (k.doubt or not k.drop))
    for node in nodes:
        if node.doubt and 2 * node.chars > root.chars:
            node.drop = False


class _Open:
    """The element that is open, and how many of each name are."""

    def __init__(self, root: Node):
        self.node, self.count = root, Counter([root.name])

    def enter(self, kid: Node) -> None:
        self.node = kid
        self.count[kid.name] += 1

    def leave(self, last: Node) -> None:
        """Close all up to last, and last."""
        while True:
            node = self.node
            self.count[node.name] -= 1
            self.node = node.parent
            if node is last:
                return


def _close(tag: str, here: _Open) -> None:
    if here.count[tag]:
        up = here.node
        while up.name != tag:
            if tag in FORMATS and up.name in BLOCKS:  # a stray end of bold or link ends no block
                return
            up = up.parent
        if up.parent is not None:
            here.leave(up)
    elif tag == "p":
        here.node.kids.append(Node("p", here.node))


def _make_room(tag: str, here: _Open) -> None:
    """Close what the start of tag ends."""
    if tag == "body" or (tag in BLOCKS and tag != "title"):
        if here.count["head"]:
            up = here.node
            while up.name != "head":
                up = up.parent
            here.leave(up)
    if tag in ENDS_P and here.node.paragraph is not None:
        here.leave(here.node.paragraph)
    if tag in CLOSES:
        ends, stop = CLOSES[tag]
        mark, last = here.node.mark, None
        while mark is not None and mark.name not in stop:
            if mark.name in ends:
                last = mark
            mark = mark.parent.mark if mark.parent is not None else None
        if last is not None:
            here.leave(last)


def parse(page: str) -> Node:
    """The page as a tree. Ends of elements that pages leave out are put in as browsers do; what is open at the end closes."""
    root = Node("html", None)
    here = _Open(root)
    at = 0
    while at < len(page):
        m = TAG.search(page, at)
        if m is None:
            here.node.kids.append(page[at:])
            break
        if m.start() > at:
            here.node.kids.append(page[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        name = m[2].lower()
        if m[1]:
            _close(name, here)
            continue
        if name in ("html", "body") and here.count[name]:
            continue
        _make_room(name, here)
        kid = Node(name, here.node, _unwanted(name, m[3], here.node))
        here.node.kids.append(kid)
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
            if end is None and not kid.drop:
                kid.kids.append(page[at:])
            elif end is not None and not kid.drop:
                kid.kids.append(page[at : end.start()])
            at = len(page) if end is None else end.end()
        elif name not in VOID:
            here.enter(kid)
    _settle(root)
    return root


def _path(node: Node | None) -> Iterator[Node]:
    while node is not None:
        yield node
        node = node.parent


def _order(root: Node) -> list[Node]:
    """All kept nodes, parents first."""
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        out.append(node)
        stack.extend(k for k in reversed(node.kids) if isinstance(k, Node) and not k.drop)
    return out


def densities(root: Node) -> list[Node]:
    """Fill in, for each kept node, characters, tags, those of links, the composite density and the sum over children."""
    nodes = _order(root)
    for node in reversed(nodes):
        kids = [k for k in node.kids if isinstance(k, Node) and not k.drop]
        own = sum(len(SPACE.sub("", k)) for k in node.kids if isinstance(k, str))
        node.chars = own + sum(k.chars for k in kids)
        node.tags = len(kids) + sum(k.tags for k in kids)
        if node.name == "a":
            node.link_chars, node.link_tags = node.chars, 1
        else:
            node.link_chars, node.link_tags = sum(k.link_chars for k in kids), sum(k.link_tags for k in kids)
    body = next((n for n in nodes if n.name == "body"), root)
    share = body.link_chars / max(body.chars, 1)
    for node in nodes:
        if node.chars:
            c, t, lc, lt = node.chars, max(node.tags, 1), max(node.link_chars, 1), max(node.link_tags, 1)
            base = math.log(c / max(c - node.link_chars, 1) * node.link_chars + share * c + math.e)
            node.density = c / t * max(math.log(max(c / lc * t / lt, 1.0)) / base, 0.0) if base else 0.0
    for node in nodes:
        node.total = sum(k.density for k in node.kids if isinstance(k, Node) and not k.drop)
    return nodes


def _text(node: Node) -> str:
    """Blocks of a subtree in page order, white space in one as one space, joined by one space."""
    blocks: list[list[str]] = [[]]
    stack: list = [node]
    while stack:
        x = stack.pop()
        if x is None:
            blocks.append([])
        elif isinstance(x, str):
            blocks[-1].append(x)
        elif not x.drop:
            if x.name in BLOCKS:
                blocks.append([])
                stack.append(None)
            stack.extend(reversed(x.kids))
    done = (SPACE.sub(" ", html.unescape("".join(b))).strip() for b in blocks)
    return " ".join(b for b in done if b)


def main_text(page: str | None) -> str:
    """The article of a page: the subtree of the largest density sum, and others on which the same threshold holds.

    Where a page has article or main elements with text, the best block is looked for in them, and the outermost of them
    around it is the text as a whole, so that its short headings and last lines stay. Else the threshold is the least
    density between body and the best block. Menus, headers and the like are known by element name, class, id or role and
    count nowhere. A null or empty page, or one of such parts only, gives an empty text.
    """
    if not page:
        return ""
    root = parse(page)
    nodes = densities(root)
    body = next((n for n in nodes if n.name == "body"), root)
    if not body.chars:
        return ""
    blocks = [n for n in _order(body) if n.chars and n.name in BLOCKS and n.name not in LEAVES]
    best = max([n for n in blocks if n.content] or blocks, key=lambda n: n.total, default=body)  # of equal ones the outermost
    around = list(_path(best))
    if best.content or best is body:
        return _text(next((n for n in reversed(around) if n.name in CONTENT), best))
    threshold = min((n.density for n in around if n.chars and n.name in BLOCKS), default=0.0)
    inside = set(map(id, around))
    picked: list[Node] = []
    stack = [body]
    while stack:
        node = stack.pop()
        if node is best:
            picked.append(node)
        elif id(node) in inside:
            stack.extend(k for k in reversed(node.kids) if isinstance(k, Node) and not k.drop)
        elif node.density >= threshold and node.density > 0 and node.name in BLOCKS:
            picked.append(node)
    return " ".join(t for t in map(_text, picked) if t)


def _texts(column: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column(column)]
            yield batch.select([n for n in batch.schema.names if n != column]).append_column("text", pa.array(texts, pa.string()))

    return run


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """pages without html_col, with text, the main text of each row; a column text is replaced, repeated rows stay."""
    rest = pages.drop("text").drop(html_col)
    (page,) = fresh(pages, "_html")
    rows = pages.select(*rest.columns, F.col(html_col).alias(page))
    return byte_batches(rows, _texts(page), rest.schema.add("text", "string"))


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """extract() of all pages: page_id, url, text, n_chars; a null html has an empty text, repeated rows stay."""
    rows = extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return rows.withColumn("n_chars", F.length("text").cast("long"))


SQL = None
