"""Main text of web pages by composite text density.

A page is read into a tree of elements. Each gets its characters, tags, link characters and link tags; the composite
density is characters per tag, adjusted by the share of links (and by that share on the whole page). The element with
the largest sum of its children's densities is the core. From there the selection grows towards the body as long as
the parent holds another child that is as dense as the least dense element on the path from the body to the core.
Articles and sections that lie beside the selected one belong to it.

Elements that HTML itself gives another purpose are never text. Names (words of class and id) only say which elements
do not compete for the selection; inside the selected article a box goes only if one of its class or id words as a whole
names a part that is no article, or if it begins with a heading of reader comments.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snapfold.llm.common import prepare, whole

# Fixed values of HTML: elements without content, elements whose content is no markup, and elements that start blocks.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre section "
    "summary table tbody td tfoot th thead tr ul".split()
)
# Elements that a start tag closes, up to the nearest of the elements that hold it.
CLOSES = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu", "dir"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "option": (frozenset(["option"]), frozenset(["select", "optgroup", "datalist"])),
    "tr": (frozenset(["tr", "td", "th"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
}
ENDS_P = BLOCKS - {"body", "html", "head", "option", "optgroup", "tbody", "tfoot", "thead", "tr", "td", "th", "caption", "legend"}
P = frozenset(["p"])
HOLDS_P = frozenset(["button", "table", "td", "th", "caption", "object", "html", "body"])

# What is no article text: by element, by role, and by words of class and id.
NO_TEXT = RAW | frozenset(
    "head nav footer aside form button select option template noscript svg canvas audio video "
    "embed dialog menu input datalist".split()
)
NO_ROLE = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
NO_NAME = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|adv|advert|adverts|advertisement|advertising|sponsor|sponsored|promo|promotion|banner|"
    r"nav|navbar|navigation|menu|breadcrumb|breadcrumbs|header|masthead|footer|sidebar|aside|widget|"
    r"comment|comments|commentlist|disqus|respond|reply|replies|cookie|cookies|consent|gdpr|notice|popup|modal|"
    r"newsletter|subscribe|signup|login|share|sharing|social|related|recommended|pagination|pager|skip)(?=$|[\s_-]|[0-9])",
    re.I,
)
# Names that say how a page is laid out, of elements that can hold all of it.
STATE = re.compile(r"(?:has|no|not|with|without|is|show|hide)[_-]|.*[_-](?:open|opened|closed|enabled|disabled|on|off)$", re.I)
# A whole class or id word of a box that is no article text wherever it stands.
JUNK = re.compile(
    r"(?:(?:user|reader|article|post|entry)[_-]?)?(?:comments?|repl(?:y|ies))(?:[_-]?(?:list|area|section|thread|form|box))?|disqus_thread|"
    r"ads?|advert|adverts|advertisement|advertising|ad[_-](?:slot|unit|box|banner|container|wrapper)|sponsored|promo|"
    r"nav|navbar|navigation|menu|breadcrumbs?|pagination|pager|sidebar|footer|"
    r"cookies?|cookie[_-](?:notice|banner|bar|consent)|notice|popup|modal|newsletter|newsletter[_-](?:signup|form|box)|subscribe|"
    r"share|sharing|share[_-](?:buttons|links|bar)|social[_-](?:share|links|buttons)|related[_-](?:posts|articles|stories)",
    re.I,
)
# Headings of reader comments.
REMARKS = re.compile(r"(?:(?:reader|user)s?['’]?s? )?comments?(?: ?\(?\d+\)?)?:?|\d+ comments|leave a (?:comment|reply)|join the discussion", re.I)
HOME = frozenset(["article", "main"])
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Where a header belongs to the text.
OWN_HEADER = ("article", "main", "section")
#: Elements that hold boxes; only their names count.
BOXES = BLOCKS - HEADINGS - frozenset("p pre blockquote caption dt dd figcaption legend html body".split())
NAME = re.compile(r"(/?)([A-Za-z][^\s/>]*+)")
REST = re.compile(r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>")
ATTRIBUTE = re.compile(r"(?:^|(?<=[\s\"'/]))(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?(?=[\s/]|$)", re.I)


class Node:
    __slots__ = ("tag", "parent", "parts", "drop", "named", "junk", "away", "chars", "tags", "links", "link_tags", "density", "total")

    def __init__(self, tag: str, parent: "Node | None", drop: bool = False, named: bool = False, junk: bool = False):
        self.tag, self.parent, self.drop, self.named, self.junk = tag, parent, drop, named, junk
        self.away = False  # does not compete for the selection
        self.parts: list[Node | str] = []
        self.chars = self.tags = self.links = self.link_tags = 0
        self.density = self.total = 0.0


def _dropped(tag: str, attributes: str) -> bool:
    if tag in NO_TEXT:
        return True
    if not attributes or tag in ("html", "body"):
        return False
    for name, *values in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), "".join(values)
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
            return True
        if name == "role" and value.lower() in NO_ROLE:
            return True
    return False


def _named(tag: str, attributes: str) -> tuple[bool, bool]:
    """Whether class or id hint, and whether a whole word of them says, that this box is no article text."""
    if not attributes or tag not in BOXES:
        return False, False
    given = [(x[0].lower(), "".join(x[1:])) for x in ATTRIBUTE.findall(attributes)]
    # ids of sections and articles are made from their headings
    words = [x for name, value in given if name == "class" or (name == "id" and tag not in ("section", *HOME)) for x in value.split()]
    junk = any(JUNK.fullmatch(x) for x in words)
    return tag not in HOME and (junk or any(NO_NAME.search(x) and not STATE.match(x) for x in words)), junk


def _remarks(node: Node) -> bool:
    """Whether a box begins with a heading of reader comments."""
    if node.tag not in BOXES or node.tag in HOME:
        return False
    first = next((p for p in node.parts if not isinstance(p, str) or p.strip()), "")
    if isinstance(first, str) or first.tag not in HEADINGS:
        return False
    own = " ".join(x for p in first.parts for x in ([p] if isinstance(p, str) else [y for y in p.parts if isinstance(y, str)]))
    return bool(REMARKS.fullmatch(" ".join(own.split())))


def _drop_named(root: Node) -> None:
    """Mark elements as away by name, but none that holds the page's articles or most of its plain text."""
    order, stack = [], [(root, False, False)]
    plain, homes, apart = {}, {}, False
    while stack:
        node, linked, inside = stack.pop()
        if _remarks(node):
            node.named = node.junk = True
        linked, inside = linked or node.tag == "a", inside or node.named or node.junk
        order.append(node)
        plain[id(node)] = 0 if linked else sum(len(x) for p in node.parts if isinstance(p, str) for x in p.split())
        homes[id(node)] = node.tag in HOME
        apart = apart or (node.tag in HOME and not inside)
        stack.extend((p, linked, inside) for p in node.parts if not isinstance(p, str) and not p.drop)
    for node in reversed(order):
        if node.parent is not None:
            plain[id(node.parent)] += plain[id(node)]
            homes[id(node.parent)] |= homes[id(node)]
    for node in order:
        if node.named or node.junk:
            # where an article lies outside of such elements, those inside are comments or teasers
            node.away = apart or not (homes[id(node)] or 2 * plain[id(node)] > plain[id(root)])


def parse(html: str) -> Node:
    """The tree of a page; unclosed and misplaced tags are closed as a browser would in the common cases.

    Linear in the page: an open element is only looked for where there is one.
    """
    root = now = Node("#root", None)
    opened: Counter = Counter()  # by tag, on the way from the root to the current element
    at, n, last = 0, len(html), html.rfind(">")

    def close(node: Node) -> Node:
        """Leave the current element and those around it up to ``node``."""
        inner = now
        while True:
            opened[inner.tag] -= 1
            if inner is node:
                return node.parent
            inner = inner.parent

    def upward(tags: frozenset, stop: frozenset, outermost: bool = False) -> Node | None:
        node, found = now, None
        while node is not root and node.tag not in stop:
            if node.tag in tags:
                found = node
                if not outermost:
                    break
            node = node.parent
        return found

    while at < n:
        begin = html.find("<", at)
        if begin < 0 or begin >= last:
            now.parts.append(unescape(html[at:]))
            break
        after = html[begin + 1 : begin + 2]
        name = NAME.match(html, begin + 1) if after not in ("!", "?") else None
        if name is None and after not in ("!", "?", "/"):
            now.parts.append(unescape(html[at : begin + 1]))  # a plain "less than"
            at = begin + 1
            continue
        if begin > at:
            now.parts.append(unescape(html[at:begin]))
        if name is None:
            comment = html.startswith("!--", begin + 1)
            end = html.find("-->", begin + 2) + 2 if comment else html.find(">", begin)
            at = n if end < begin else end + 1
            continue
        rest = REST.match(html, name.end())
        end = rest.end() if rest else html.find(">", name.end()) + 1
        attributes, tag = html[name.end() : end - 1], name[2].lower()
        at = end
        if name[1]:
            if opened[tag]:
                found = upward(frozenset([tag]), frozenset() if tag in BLOCKS else BLOCKS - {tag})
                if found is not None:
                    now = close(found)
            continue
        if tag in ("html", "body") and opened[tag]:
            continue
        if opened["p"] and tag in ENDS_P and (found := upward(P, HOLDS_P)) is not None:
            now = close(found)
        if tag in CLOSES and any(opened[x] for x in CLOSES[tag][0]):
            if (found := upward(*CLOSES[tag], outermost=True)) is not None:
                now = close(found)
        drop = _dropped(tag, attributes) or (tag == "header" and not any(opened[x] for x in OWN_HEADER))
        node = Node(tag, now, drop, *_named(tag, attributes))
        now.parts.append(node)
        if tag in RAW:
            shut = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(html, at)
            at = shut.end() if shut else n
        elif tag not in VOID and not attributes.endswith("/"):
            now = node
            opened[tag] += 1
    _drop_named(root)
    return root


def _measure(root: Node) -> list[Node]:
    """Fill in counts, densities and sums from the leaves up; the kept elements in page order."""
    order, stack = [], [(root, False)]
    while stack:
        node, linked = stack.pop()
        linked = linked or node.tag == "a"
        order.append(node)
        for part in node.parts:
            if isinstance(part, str):
                size = sum(map(len, part.split()))
                node.chars += size
                node.links += size * linked
        stack.extend((p, linked) for p in reversed(node.parts) if not isinstance(p, str) and not (p.drop or p.away))
    for node in reversed(order):
        if node.parent is not None:
            up = node.parent
            up.chars += node.chars
            up.links += node.links
            up.tags += node.tags + 1
            up.link_tags += node.link_tags + (node.tag == "a")
    share = root.links / root.chars if root.chars else 0.0
    for node in reversed(order):
        plain = node.chars - node.links
        if node.chars:
            tags, links = max(node.tags, 1), max(node.links, 1)
            base = math.log(max(node.chars / max(plain, 1) * node.links + share * node.chars + math.e, 1.0001))
            ratio = node.chars / links * tags / max(node.link_tags, 1)
            node.density = node.chars / tags * max(math.log(max(ratio, 1.0)), 1e-9) / base
        if node.parent is not None:
            node.parent.total += node.density
    return order


def _beside(node: Node) -> list[Node]:
    """The element and those of its kind beside it, with headings in front of any of them, in page order."""
    kin, headings = [], []
    for p in node.parent.parts if node.parent is not None else [node]:
        if isinstance(p, str) or p.drop or p.away or not p.chars:
            continue
        if p is node or (p.tag == node.tag and not p.junk and not _menu(p)):
            kin += [*headings, p]
            headings = []
        elif p.tag in HEADINGS or (node.tag == "section" and p.tag in ("p", "header")):
            headings.append(p)
    return kin


def _select(root: Node, order: list[Node]) -> tuple[list[Node], Node]:
    """(selected elements, article): the article is the article element or the core; in it no list of links is dropped."""
    body = next((x for x in order if x.tag == "body"), root)
    inside, held = [], {id(body)}
    for node in order:
        if id(node) in held or (node.parent is not None and id(node.parent) in held):
            held.add(id(node))
            inside.append(node)
    core = max(inside, key=lambda x: x.total, default=body)
    path, node = [], core
    while node is not None:
        path.append(node)
        if node is body:
            break
        node = node.parent
    threshold = min(x.density for x in path)
    homes = [x for x in path if x.tag in HOME]
    if homes:
        home = ([x for x in homes if x.tag == "article"] or homes)[-1]
        return _beside(home) if home.tag == "article" else [home], home
    chosen = core
    for below, node in zip(path, path[1:], strict=False):
        if any(not isinstance(p, str) and not (p.drop or p.away) and p is not below and p.chars and p.density >= threshold for p in node.parts):
            chosen = node
    sections = [x for x in path[path.index(chosen) :] if x.tag == "section"]
    return (_beside(sections[-1]), sections[-1]) if sections else ([chosen], core)


def _menu(node: Node) -> bool:
    """A list or box whose text is nearly all links."""
    return node.tag in BLOCKS and node.link_tags >= 2 and node.links > 0.8 * node.chars


def extract(html: str) -> str:
    """Text of the selected element: blocks in page order, joined by an empty line."""
    root = parse(html)
    order = _measure(root)
    if not root.chars:
        return ""
    blocks: list[str] = []
    line: list[str] = []

    def end() -> None:
        if text := " ".join("".join(line).split()):
            blocks.append(text)
        line.clear()

    selected, article = _select(root, order)
    whole_page = article is root or article.tag in ("html", "body")
    chosen = {id(x) for x in selected}
    stack: list = [(x, False) for x in reversed(selected)]
    while stack:
        part, inside = stack.pop()
        if part is None:
            end()
        elif isinstance(part, str):
            line.append(part)
        elif part.tag == "br":
            line.append(" ")
        elif not part.drop:
            own = id(part) in chosen
            if part.away and not own and (part.junk or not inside):
                continue
            inside = inside or part.tag in HOME or part.tag == "section" and own or (part is article and not whole_page)
            if not inside and not own and _menu(part):
                continue
            block = part.tag in BLOCKS
            if block:
                end()
                stack.append((None, inside))
            stack.extend((x, inside) for x in reversed(part.parts))
    end()
    return "\n\n".join(blocks)


def extract_pages(pages: DataFrame) -> DataFrame:
    """(page_id, url, text) of every row of ``pages`` (page_id, url, html; other columns are not read).

    Whole pages are read; null and empty html, and pages without any text, give an empty text. Rows are handled one
    by one, so repeated rows and null ids or urls come out as they came in.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([extract(x) for x in batch.column(2).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), texts], ["page_id", "url", "text"])

    prepare(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("bigint"), F.col("url").cast("string"), whole("html").alias("html"))
    return rows.mapInArrow(run, "page_id bigint, url string, text string")
