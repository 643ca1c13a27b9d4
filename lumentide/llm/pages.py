"""Main text of web pages by scoring the tree of elements."""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import session_setup

#: One piece of markup: comment, declaration, or a tag with its attributes (quoted values may hold >); or a cut-off rest.
_MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(>|\Z)|</[^>]*(?:>|\Z)", re.S)
_LOOSE_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)(>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_SPACE = re.compile(r"[\s ]+")
#: Elements whose content is text up to their own end tag, and none of it is shown.
_RAW = frozenset("script style noscript template iframe noembed noframes xmp plaintext textarea title".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that are never part of an article.
_DROPPED = frozenset("nav footer aside button select option datalist dialog menu svg math canvas object audio video map head input label fieldset".split()) | _RAW
#: Of these, those that may stand within a paragraph.
_INLINE = frozenset("button select option datalist svg math canvas object audio video map head label".split())
_BLOCK = frozenset("html body article section main div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd blockquote pre table thead tbody tfoot tr td th caption figure figcaption header address details summary hgroup center hr form".split()) | _DROPPED
#: An opening tag of the first kind ends an open element of the second kind, within the third.
_CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
_BARRIER = frozenset("article section main div ul ol dl table td th blockquote body aside nav footer header form figure".split())
#: Elements whose points go to the one around them first.
_LEAF = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th pre blockquote figcaption caption address hr center summary hgroup".split())
_BAD_ROLE = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar status".split())
_BAD_NAME = re.compile(r"(?:^|[-_ ])(?:ads?|advert\w*|adbox|adslot|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|comments?|commentlist|discussions?|reviews?|disqus|respond|replies|reply|sidebar|side-bar|menu|nav|navbar|navigation|breadcrumbs?|pagination|pager|footer|masthead|topbar|social|share|sharing|related|recommend\w*|newsletter|subscribe|signup|login|popup|modal|notice|alert|widget|toolbar|skip|outbrain|taboola|copyright|legal|tags?|toc)(?:$|[-_ ])", re.I)
_GOOD_NAME = re.compile(r"article|entry|main|post|content|body|story|text", re.I)
_BAD_WEIGHT = re.compile(r"meta|foot|link|list|hidden|shop|tool|scroll", re.I)
#: An element with a bad name is left out unless it holds more than so many times the points of all that has none; with a
#: good name beside it, as in `content no-sidebar`, more than as many.
BAD_NAME_FACTOR = 4
_HEADLINE = frozenset("h1 h2 h3 h4 h5 h6".split())


class _Node:
    __slots__ = ("tag", "parent", "children", "names", "good", "bad")

    def __init__(self, tag: str, parent: "_Node | None", names: str = "", good: bool = False):
        names = names or ("form" if tag == "form" else "")  # a form can be around a whole page, so it is weighed, too
        self.tag, self.parent, self.children, self.names, self.good = tag, parent, [], names, good
        self.bad = tag == "form" or bool(names) and tag not in ("html", "body", "article", "main") and bool(_BAD_NAME.search(names)) and not (tag in ("div", "section") and "article" in names.lower().split())


def _dropped(tag: str, a: dict[str, str], inside: bool) -> bool:
    if tag in _DROPPED or (tag == "header" and not inside):
        return True
    if not a:
        return False
    return "hidden" in a or a.get("aria-hidden") == "true" or "display:none" in a.get("style", "").replace(" ", "") or a.get("role", "") in _BAD_ROLE


class _Open:
    """The elements that are open where the parser stands, the innermost last, with the places of each tag and of barriers."""

    def __init__(self, root: _Node):
        self.path = [root]
        self.places: dict[str, list[int]] = {}
        self.barriers: list[int] = []

    def push(self, node: _Node) -> None:
        self.places.setdefault(node.tag, []).append(len(self.path))
        if node.tag in _BARRIER:
            self.barriers.append(len(self.path))
        self.path.append(node)

    def close(self, place: int) -> None:
        """Closes the element at a place with all that is open inside it."""
        while len(self.path) > place:
            tag = self.path.pop().tag
            self.places[tag].pop()
            if tag in _BARRIER:
                self.barriers.pop()

    def last(self, *tags: str) -> int:
        """The innermost place of some tags, 0 where none is open."""
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=0)

    def first(self, tags: set[str], after: int) -> int:
        """The outermost place of some tags inside the element at a place, 0 where none is open."""
        found = []
        for t in tags:
            places = self.places.get(t, [])
            i = bisect_right(places, after)
            found += places[i : i + 1]
        return min(found, default=0)

    def reachable(self, tag: str) -> int:
        """The innermost place of a tag with no barrier inside it, or 0."""
        at = self.last(tag)
        return at if at and (tag in _BARRIER or not self.barriers or self.barriers[-1] < at) else 0


def parse(page: str) -> _Node:
    """The page's tree, as far as it matters here: dropped elements are left out with all they hold; tags may be missing.

    A dropped element is parsed like others, but isn't among its parent's children, so it ends where others would.
    A tag whose quoted value never ends reaches to its next >; a < that begins no tag is text. What an element needs
    to know of those around it is looked up, so a page takes time by its length, however deep it is.
    """
    root = _Node("#root", None)
    at, n = 0, len(page)
    here = _Open(root)

    def add(text: str) -> None:
        if text:
            here.path[-1].children.append(text)

    while at < n:
        start = page.find("<", at)
        if start < 0:
            add(page[at:])
            break
        add(page[at:start])
        m = _MARKUP.match(page, start)
        if m is None or m[2] is not None and m[4] != ">":  # a quote left open, or cut off inside a tag: to the next > if there is one
            m = _LOOSE_TAG.match(page, start)
            if m is None:
                add("<")
                at = start + 1
                continue
            if m[4] != ">":
                break
        at = m.end()
        if m[2] is None:
            continue
        tag, rest = m[2].lower(), m[3]
        if m[1]:
            place = here.reachable(tag)
            if place:
                here.close(place)
            continue
        if tag == "br":
            add(" ")
            continue
        if tag in _VOID and tag != "hr":
            continue
        if tag in _RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*[^>]*>", re.I).search(page, at)
            at = end.end() if end else n
            continue
        a = {k.lower(): html.unescape(x or y or z) for k, x, y, z in _ATTRIBUTE.findall(rest)} if rest and not rest.isspace() else {}
        if tag != "head" and here.last("head"):  # a head whose end tag is missing
            here.close(here.last("head"))
        dropped = _dropped(tag, a, here.last("article", "main") > 0)
        if tag in _BLOCK and tag not in _INLINE:  # a block ends an open paragraph, with what is open inside it
            if place := here.reachable("p"):
                here.close(place)
            if tag in _CLOSES:
                ended, stop = _CLOSES[tag]
                if place := here.first(ended, here.last(*stop)):
                    here.close(place)
            if tag in _HEADLINE and here.path[-1].tag in _HEADLINE:
                here.close(len(here.path) - 1)
        if tag == "hr":
            continue
        node = here.path[-1]
        child = _Node(tag, node, f"{a.get('class', '')} {a.get('id', '')}".strip(), a.get("role") in ("main", "article") or a.get("itemprop") == "articleBody")
        if not dropped:
            node.children.append(child)
        if not rest.endswith("/") or not dropped and tag in _BLOCK:
            here.push(child)
    return root


def blocks(node: _Node) -> list[tuple[_Node, str, int]]:
    """The node's blocks in page order: (element, text, characters inside links). A block is what stands in a block element between other blocks."""
    out: list[tuple[_Node, str, int]] = []
    held: list[str] = []
    links = 0
    owners = [node]

    def flush() -> None:
        nonlocal links
        text = _SPACE.sub(" ", html.unescape("".join(held))).strip(" ")
        if text:
            out.append((owners[-1], text, links))
        held.clear()
        links = 0

    stack: list[tuple[_Node, int, int]] = [(node, 0, 0)]
    while stack:
        at, i, in_link = stack.pop()
        block = at.tag in _BLOCK and at is not node
        if i == 0 and block:
            flush()
            owners.append(at)
        children = at.children
        while i < len(children):
            c = children[i]
            i += 1
            if isinstance(c, str):
                held.append(c)
                if in_link:
                    links += len(c)
            else:
                stack.append((at, i, in_link))
                stack.append((c, 0, in_link or c.tag == "a"))
                break
        else:
            if block:
                flush()
                owners.pop()
    flush()
    return out


def _elements(root: _Node) -> list[_Node]:
    """All elements, outer ones before those inside them."""
    out = [root]
    for x in out:
        out.extend(c for c in x.children if not isinstance(c, str))
    return out


def _weight(node: _Node) -> float:
    base = {"article": 30, "main": 20, "div": 5, "section": 5, "td": 3, "blockquote": 3, "pre": 3, "ul": -3, "ol": -3, "li": -3, "th": -5, "header": -5}.get(node.tag, 0)
    if node.names:
        base += 25 * bool(_GOOD_NAME.search(node.names)) - 25 * bool(_BAD_WEIGHT.search(node.names))
    return base


def _points(text: str) -> float:
    return 1 + text.count(",") + min(len(text) / 100, 3)


def drop_bad_names(root: _Node) -> None:
    """Takes elements with bad names off the tree, but for those whose text outweighs what has no such name.

    Blocks count for the nearest element with a bad name around them, by their points less their share of links. The
    heaviest element that outweighs the rest stays, with those around it and siblings whose first name is the same.
    """
    held: dict[_Node | None, float] = {None: 0.0}
    nearest: dict[_Node, _Node | None] = {}
    stack: list[tuple[_Node, _Node | None]] = [(root, None)]
    while stack:
        x, bad = stack.pop()
        nearest[x] = bad = x if x.bad else bad
        held.setdefault(bad, 0.0)
        stack.extend((c, bad) for c in x.children if not isinstance(c, str))
    if len(held) == 1:
        return
    for owner, text, links in blocks(root):
        held[nearest[owner]] += _points(text) * (1 - min(1.0, links / len(text)))
    rest = held.pop(None)
    stays: set[_Node] = set()
    for x in sorted(held, key=lambda x: -held[x]):
        if x in stays:
            continue
        if held[x] <= rest * (1 if _GOOD_NAME.search(x.names) else BAD_NAME_FACTOR):
            continue
        up: _Node | None = x
        more = [y for y in x.parent.children if y in held and y.tag == x.tag and y.names.split()[0] == x.names.split()[0]]
        while up is not None:
            if up.bad:
                more.append(up)
            up = up.parent
        for y in {*more} - stays:
            stays.add(y)
            rest += held[y]
    for up in {x.parent for x in held if x not in stays}:
        up.children = [c for c in up.children if isinstance(c, str) or not c.bad or c in stays]


def main_text(page: str) -> str:
    """The article's blocks, joined by a line feed; empty if none.

    Every block of text passes points to the elements above it: one, one for each comma, and up to three for its
    length; all of them to the element around the block, half to the next, a third to the one after. An element's
    points are discounted by the share of its text inside links. The best element is the container (or the article
    around it); siblings with a fair share of its points, or long blocks with few links, are kept beside it.
    """
    if not page:
        return ""
    root = parse(page)
    drop_bad_names(root)
    found = blocks(root)
    score: dict[_Node, float] = {}
    size: dict[_Node, int] = {}
    linked: dict[_Node, int] = {}
    elements = _elements(root)
    around: dict[_Node, _Node | None] = {root: None}  # the block around each element
    for x in elements[1:]:
        around[x] = x.parent if x.parent.tag in _BLOCK or x.parent is root else around[x.parent]
    for owner, text, in_links in found:
        points = _points(text)
        up = around[owner] if owner.parent is not None and owner.tag in _LEAF else owner
        for level in (1, 2, 3):
            if up is None:
                break
            if up not in score:
                score[up] = _weight(up)
            score[up] += points / level
            up = around[up]
        size[owner] = size.get(owner, 0) + len(text)
        linked[owner] = linked.get(owner, 0) + in_links
    if not score:
        return ""
    for x in reversed(elements):  # inner ones first
        if x in size and x.parent is not None:
            size[x.parent] = size.get(x.parent, 0) + size[x]
            linked[x.parent] = linked.get(x.parent, 0) + linked[x]
    density = lambda x: min(1.0, linked[x] / max(1, size[x]))
    final = {x: s * (1 - density(x)) for x, s in score.items()}
    best = max(final, key=lambda x: (final[x], size[x]))
    up = best
    while up is not None:  # the article that the container is part of is the whole of it
        if up.tag == "article" or up.good or (up.tag == "main" and best.tag != "article"):
            best = up
        up = up.parent
    kept = {best}
    if best.parent is not None and best.tag not in ("body", "html", "main", "#root"):
        least = max(10.0, 0.2 * final.get(best, 0))
        for x in best.parent.children:
            if isinstance(x, str) or x is best or x not in size:
                continue
            bonus = 0.2 * final.get(best, 0) if x.names and x.names == best.names else 0
            if x.tag == best.tag == "article":
                keep = False
            elif x.tag == "p":
                keep = size[x] > 80 and density(x) < 0.25 or size[x] <= 80 and density(x) == 0 and best.tag != "article"
            else:
                keep = final.get(x, 0) + bonus >= least and density(x) < 0.3 and best.tag != "article"
            if keep:
                kept.add(x)
    inside: dict[_Node, bool] = {}

    def is_kept(x: _Node) -> bool:
        path = []
        while x is not None and x not in inside:
            if x in kept:
                inside[x] = True
                break
            path.append(x)
            x = x.parent
        got = x is not None and inside[x]
        for y in path:
            inside[y] = got
        return got

    return "\n".join(text for owner, text, _ in found if is_kept(owner))


def extract(pages: DataFrame, key: str = "page_id", markup: str = "html", also: tuple[str, ...] = ("url",)) -> DataFrame:
    """The main text of every page: key, the columns of `also`, text (empty if none) and n_chars.

    Null html is empty. An empty table gives no rows; rows that share a key are each handled. A column of `also` that is
    named as key, text or n_chars is replaced by the result's.
    """
    session_setup(pages.sparkSession)
    extra = [key, *dict.fromkeys(c for c in also if c not in (key, "text", "n_chars"))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x or "") for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*(f"c{i}" for i in range(len(extra))), "text", "n_chars"])

    kinds = ", ".join(f"c{i} {pages.schema[c].dataType.simpleString()}" for i, c in enumerate(extra))
    return pages.select(F.col(markup).alias("m"), *(F.col(c).alias(f"c{i}") for i, c in enumerate(extra))).mapInArrow(run, f"{kinds}, text string, n_chars long").toDF(*extra, "text", "n_chars")
