"""Main-text extraction by tree scoring.

The page becomes a tree (with the end tags that HTML lets authors leave out).
Every paragraph passes points for its length and commas to its ancestors, less at
each level; a container's points are discounted by the share of its text that
lies in links. The container with the most is the best, wherever it stands, article element
or not; elements whose tag, ARIA role or class and id words name them page furniture
hold no points. From the best container the way leads up while it is
inside an ``article`` or ``main``, else as long as something beside it scores well too: siblings are kept if they hold a container that scores a
fifth of the best or more, next to the best container also if they are headings, prose, or hold a paragraph of ``LONG_PROSE`` letters; boxes of links, teasers and stray text are not.

Edge cases: null or empty html gives empty text; pages without any paragraph fall
back to whatever text the body holds after pruning; malformed tags are text;
unclosed elements end where their parent ends; references to invalid code points
decode as HTML prescribes; nothing is capped, and the walk is iterative, so very
deep or very long pages are fine. Of containers with equal values the first in the page
is the best. Repeated pages give repeated rows, an empty table none; null ids and urls
stay; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_ATTRIBUTE = re.compile(r"""(class|id|role|hidden|aria-hidden|style|aria-label|itemprop)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?(?=[\s/]|$)""", re.I)
_WORDS = re.compile(r"[A-Za-z][a-z]*")
_SPACE = re.compile(r"\s+")

#: Fixed values of HTML.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title xmp iframe noembed noframes noscript".split())
BLOCK = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCK - set("body html caption tbody td tfoot th thead tr option optgroup legend".split())
IMPLIED = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}), "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}), "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"})}
SCOPE = set("table td th caption button object html body article section div main aside nav header footer form blockquote li ul ol dl dd figure".split())

#: What is not the article.
NEVER = set("head script style noscript template iframe textarea title xmp noembed noframes nav aside footer form button input select option optgroup datalist menu dialog svg math canvas object embed audio video map fieldset label".split())
ROLES = set("navigation banner complementary contentinfo search menu menubar dialog alertdialog alert form toolbar".split())
FURNITURE = set(
    "ad ads adv advert adverts advertisement advertising adbox adsense sponsor sponsored promo promotion banner breadcrumb breadcrumbs menu menus nav navbar navigation sidebar sidenav footer masthead topbar toolbar cookie cookies consent gdpr notice notices disclaimer alert popup modal overlay subscribe subscription newsletter signup login share sharing social related recommended recommendations comment comments commentlist disqus respond replies reply pagination pager search widget widgets skip copyright toc".split()
)
MODIFIERS = set("has no with without not hide".split())
CONTENT = set("article main content post entry story body text page".split())
BOXES = set("ul ol div section table dl article".split())
READERS = set("comment comments reply replies respond".split())
KEEP = set("html body article main h1 h2 h3 h4 h5 h6 p".split())
LONG_PROSE = 80
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())


class Node:
    __slots__ = ("tag", "parent", "items", "own", "links", "commas", "score", "junk", "peak", "prose")

    def __init__(self, tag: str, parent: Node | None, junk: bool):
        self.tag, self.parent, self.items = tag, parent, []  # items: texts and nodes in page order
        self.own = self.links = self.commas = 0  # of the whole subtree, once measured
        self.score, self.junk = 0.0, junk
        self.peak, self.prose = 0.0, 0  # the best value in the subtree, the longest paragraph there


def furniture(tag: str, attributes: str, inside_article: bool) -> bool:
    """Whether an element with these attributes is page furniture."""
    if tag in NEVER or (tag == "header" and not inside_article):
        return True
    if not attributes or attributes.isspace() or tag in ("html", "body"):
        return False
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), (m[2] or "").strip("\"'")
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
            return True
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
        if name == "role" and value.lower() in ROLES:
            return True
        readers = tag == "article" and inside_article and name in ("class", "id") and READERS & {w.lower() for w in _WORDS.findall(value)}
        if readers:  # readers' comments may be articles inside the article
            return True
        if name in ("class", "id") and tag not in KEEP - {"p"}:
            # a name such as no-sidebar says nothing, and one such as post-content outweighs its neighbours
            names = [{w.lower() for w in _WORDS.findall(x)} for x in value.split()]
            names = [words for words in names if words and not words & MODIFIERS]
            if any(words <= CONTENT for words in names):
                continue
            if any(words & FURNITURE for words in names) or (tag != "header" and not inside_article and any("header" in words for words in names)):
                return True
    return False


def tree(page: str) -> Node:
    """The element tree; texts are decoded, furniture is marked as junk and its contents are dropped."""
    root = at = Node("html", None, False)
    articles, position, n = 0, 0, len(page)

    def close(upto: Node) -> None:
        nonlocal at, articles
        while at is not upto:
            articles -= at.tag in ("article", "main")
            at = at.parent

    def inside(tags: set, barrier: set) -> Node | None:
        x, found = at, None
        while x is not root and x.tag not in barrier:
            if x.tag in tags:
                found = x
            x = x.parent
        return found

    def text(piece: str) -> None:
        if piece and not at.junk:
            at.items.append(html.unescape(piece) if "&" in piece else piece)

    while position < n:
        m = _MARKUP.search(page, position)
        if m is None:
            text(page[position:])
            break
        text(page[position : m.start()])
        position = m.end()
        if m[2] is None:
            if m[0].startswith("<![CDATA["):
                text(m[0][9:].removesuffix("]]>"))
            continue
        tag = m[2].lower()
        if m[1]:
            x = at
            while x is not root and x.tag != tag:
                x = x.parent
            if x is not root:
                close(x.parent)
            elif tag == "p":
                at.items.append(Node("p", at, at.junk))
            elif tag == "br":
                text(" ")
            continue
        if tag in ("html", "body"):
            continue
        if tag in CLOSES_P and (x := inside({"p"}, SCOPE)):
            close(x.parent)
        if tag in IMPLIED and (x := inside(*IMPLIED[tag])):
            close(x.parent)
        if tag == "br":
            text(" ")
        if tag in BLOCK and at.tag == "head":
            close(at.parent)
        node = Node(tag, at, at.junk or furniture(tag, m[3], articles > 0))
        at.items.append(node)
        if tag in VOID or (m[3].endswith("/") and tag not in BLOCK and tag not in RAW and tag != "a"):
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(page, position)
            position = end.end() if end else n
            continue
        at = node
        articles += tag in ("article", "main")
    return root


def nodes(root: Node) -> list[Node]:
    """All nodes that are not junk, parents first."""
    out, stack = [], [root]
    while stack:
        x = stack.pop()
        if not x.junk:
            out.append(x)
            stack += [y for y in reversed(x.items) if isinstance(y, Node)]
    return out


def measure(order: list[Node]) -> None:
    """Text, link text and commas of every subtree."""
    for x in reversed(order):
        for y in x.items:
            if isinstance(y, str):
                x.own += len(_SPACE.sub(" ", y).strip())
                x.commas += y.count(",") + y.count("、") + y.count("，")
            elif not y.junk:
                x.own, x.links, x.commas = x.own + y.own, x.links + y.links, x.commas + y.commas
        if x.tag == "a":
            x.links = x.own


def density(x: Node) -> float:
    return x.links / x.own if x.own else 0.0


def is_menu(x: Node, least: float = 0.8) -> bool:
    """A list or box that is nearly all links, several of them."""
    if x.tag not in BOXES or density(x) < least:
        return False
    return sum(y.tag == "a" for y in nodes(x)) >= 3


def value(x: Node) -> float:
    return x.score * (1 - density(x)) * (1.25 if x.tag in ("article", "main") else 1)


def pass_points(order: list[Node]) -> list[Node]:
    """Each paragraph's points go to its ancestors; returned are the containers that got some, in page order."""
    scored: dict[Node, None] = {}
    for x in order:
        has_block = any(isinstance(y, Node) and y.tag in BLOCK and not y.junk for y in x.items)
        prose = x.tag in ("p", "pre", "td", "blockquote", "dd", "li") or (x.tag in BLOCK and x.tag[0] != "h" and not has_block)
        if not prose or has_block or not x.own:
            continue
        x.prose = x.own
        points = min(x.own / 25, 1) + x.commas + min(x.own / 100, 3)
        up, level = x.parent, 0
        while up is not None and level < 4:
            up.score += points / (1, 2, 6, 9)[level]
            scored[up] = None
            up, level = up.parent, level + 1
    for x in reversed(order):
        x.peak = max(x.peak, value(x))
        if x.parent is not None:
            x.parent.peak, x.parent.prose = max(x.parent.peak, x.peak), max(x.parent.prose, x.prose)
    return list(scored)


def _kept(y: Node, top: float, inside: bool, near: bool) -> bool:
    """Whether a sibling of the best container (``near``: or else of what holds it) belongs to the text."""
    if y.junk or not y.own:
        return False
    good = y.peak > 0 and y.peak >= 0.2 * top
    if inside:  # the article's own parts, but no boxes of links and no teasers
        return not is_menu(y, 0.5) and (y.tag != "article" or good)
    prose = y.tag in ("p", "blockquote", "pre") and density(y) < 0.25
    long = y.prose >= LONG_PROSE and density(y) < 0.25
    return good or (near and (prose or long or y.tag in HEADINGS or y.tag == "header"))


def _is_heading(y: Node) -> bool:
    """Whether all the text of an element stands in headings."""
    return bool(y.own) and not y.junk and y.own == sum(x.own for x in nodes(y) if x.tag in HEADINGS)


def main_nodes(root: Node) -> list[Node]:
    """The best container with its kept siblings, in page order."""
    order = nodes(root)
    measure(order)
    for x in order:
        if not x.junk and is_menu(x) and x.parent is not None:
            x.junk = True
    order = nodes(root)
    for x in order:
        x.own = x.links = x.commas = 0
    measure(order)
    scored = pass_points(order)
    if not scored:
        return [root]
    best = at = max(scored, key=value)
    top, kept = value(best), [best]
    framed, up = set(), best.parent
    while up is not None:  # all that stands inside the outermost article or main
        if up.tag in ("article", "main"):
            framed.add(up)
        up = up.parent
    near = True  # no level with other text was passed yet
    while at.parent is not None:
        inside, same = bool(framed), at.tag in ("article", "main")
        around, open_, others, more = [], [], 0, 0
        for y in at.parent.items:
            if y is at:
                around, open_ = around + open_ + kept, []
            elif isinstance(y, str):
                around += [y] * inside
            elif (same and not inside and not y.junk and y.tag == at.tag and value(y) >= 0.2 * top) or ((inside or not same) and _kept(y, top, inside, near)):
                around, open_ = around + open_ + [y], []
                more += 1
            elif not inside and not same and _is_heading(y):
                open_.append(y)  # kept if text that it may head follows
            else:
                others += bool(y.own and not y.junk)
        at, kept = at.parent, around
        framed.discard(at)
        if inside and at.tag in ("article", "main") and not framed:
            break
        if not inside and (same or (others and not more)):
            break  # beyond an article, or where nothing beside it belongs to the text
        near = near and not others and not more
    return kept


def blocks(kept: list[Node]) -> list[str]:
    """Text blocks in page order, white space turned into single spaces."""
    out, now = [], []

    def end() -> None:
        if line := _SPACE.sub(" ", "".join(now)).strip():
            out.append(line)
        now.clear()

    stack: list[Node | str | None] = list(reversed(kept))
    while stack:
        x = stack.pop()
        if x is None:
            end()
        elif isinstance(x, str):
            now.append(x)
        elif not x.junk:
            if x.tag in BLOCK or x.tag == "html":
                end()
                stack.append(None)
            stack += reversed(x.items)
    end()
    return out


def extract(page: str | None) -> str:
    return "\n".join(blocks(main_nodes(tree(page)))) if page else ""


def extract_html(pages: DataFrame) -> DataFrame:
    """``(page_id, url, text, n_chars)`` for each row of ``(page_id, url, html)``; a map over rows, without a shuffle."""

    def run(batches):
        for b in batches:
            text = [extract(x) for x in b.column("html").to_pylist()]
            columns = [b.column("page_id"), b.column("url"), pa.array(text, pa.string()), pa.array([len(x) for x in text], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op6_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_html(spark.read.parquet(f"{sf_dir}/pages.parquet"))


QUERIES = {"op6_html_extract": op6_html_extract}
