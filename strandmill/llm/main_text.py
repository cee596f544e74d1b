"""Main text of web pages by tree scoring.

Every paragraph gives points for its length and its commas to the elements that hold it: all to
the parent, half to the grandparent, less and less further up. An element's points are discounted by the
share of its text that lies in links. The best element is the container of the article, together with its
siblings that score nearly as well. Without an <article> or <main>, siblings that are prose by their length and their share of
links belong to it too, however few points they have, and so do headings before what is kept. An article may be split over
nested boxes, of which the best element is one; so the siblings of the elements around it are looked at in the same way, all the way
up, where they must have the same class or hold a fair share of the best element's prose. What is never part of an article (menus, footers,
forms, scripts, adverts, notices, reader comments and the like) is left out, by tag, role or name.

A page is one row's work; the functions here parse one page at a time inside Arrow batches.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Element names of HTML by their part in a page, and usual names of page furniture.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noembed noframes iframe noscript".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike "
    "strong sub sup time tt u var wbr".split()
)
NEVER = frozenset(
    "head script style nav aside footer form noscript iframe template svg math object embed applet button select textarea input "
    "option dialog menu audio video canvas map title xmp noembed noframes".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form toolbar".split())
FURNITURE = frozenset(
    "ad ads advert adverts advertisement advertising adsense adslot alert alerts banner breadcrumb breadcrumbs comment comments cookie cookies "
    "consent disclaimer disqus discussion footer footnav gdpr header masthead menu modal nav navbar navigation newsletter notice notices notification notifications "
    "outbrain pager pagination paywall popup promo promotion promoted related replies respond share sharing shoutbox sidebar "
    "signup social sponsor sponsored subscribe taboola toolbar topbar widget widgets".split()
)
ARTICLE_NAMES = frozenset("article body content entry main page post story text".split())
# furniture names that a part of an article may have beside one of ARTICLE_NAMES, and such as a paragraph or heading may have
LAYOUT = frozenset("banner discussion header masthead modal popup share sharing social subscribe toolbar topbar widget widgets".split())
TITLES = frozenset("header masthead".split())
READERS = frozenset("reader readers user users visitor visitors".split())
OPINIONS = frozenset("feedback letters opinion opinions reactions responses reviews".split())
ABOUT_OTHERS = frozenset("has hide is no non not show with without".split())  # a class such as no-sidebar
KEPT_TAGS = frozenset("html body article main".split())
PAGE = frozenset("html body #page".split())
PARAGRAPHS = frozenset("p li td th pre blockquote h1 h2 h3 h4 h5 h6 dt dd".split())
CLOSED_BY = {
    "li": frozenset(["li"]),
    "dt": frozenset(["dt", "dd"]),
    "dd": frozenset(["dt", "dd"]),
    "tr": frozenset(["tr", "td", "th"]),
    "td": frozenset(["td", "th"]),
    "th": frozenset(["td", "th"]),
    "option": frozenset(["option"]),
}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
LISTS = frozenset("ul ol dl table tbody thead tfoot select".split())
BARRIERS = LISTS | frozenset("div article section main body #page".split())
STOPS = BARRIERS | frozenset("p li dt dd tr td th option".split())  # what an opening block looks at

_TOKEN = re.compile(r"<!--(?:>|->|.*?(?:--!?>|\Z))|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(>|\Z)|<[!?/][^>]*(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'=<>`]+)))?")
_SENTENCE_END = re.compile(r"[.!?…。！？؟।][\"'”’»)\]]*(?:\s|\Z)")
_NAME_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")

SIBLING_SHARE = 0.2
MAX_DEPTH = 512  # deeper elements count as their ancestor at this depth, as in browsers; their end tags close them only
SEMANTIC_POINTS = 25.0
PROSE_CHARS = 80  # from this length on text is prose without the end of a sentence too
PROSE_LINKS = 0.25


class Element:
    """An element, its place in the tree, and what was found of its text."""

    __slots__ = ("tag", "kind", "parent", "left_out", "in_article", "points", "chars", "link_chars", "in_paragraphs", "sentences")

    def __init__(self, tag: str, parent: Element | None, left_out: bool, kind: str = ""):
        self.kind = kind  # its class
        self.tag, self.parent, self.left_out = tag, parent, left_out
        self.in_article = tag in ("article", "main") or (parent is not None and parent.in_article)
        self.points = 0.0
        self.chars = self.link_chars = self.in_paragraphs = self.sentences = 0


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(text)} if text.strip() else {}


def _is_furniture(tag: str, attributes: dict[str, str], in_article: bool) -> bool:
    """Whether an element with these attributes is not part of any article."""
    if tag in NEVER or "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true":
        return True
    if attributes.get("role", "").lower() in ROLES or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attributes.get("style", ""), re.I):
        return True
    if tag == "header":
        return not in_article
    if tag in KEPT_TAGS:
        return False
    parts = [[part.lower() for part in _NAME_PARTS.findall(name)] for key in ("class", "id") for name in attributes.get(key, "").split()]
    names = {part for name in parts if name and name[0] not in ABOUT_OTHERS for part in name}
    if names & READERS and names & OPINIONS:
        return True
    bad = names & FURNITURE
    if in_article or tag == "p" or tag in HEADINGS:
        bad -= TITLES
    if names & ARTICLE_NAMES:
        bad -= LAYOUT
    return bool(bad)


def parse(html: str) -> list[tuple[Element, str, int]]:
    """The page's blocks of text outside of furniture, in order: element, text, characters in links."""
    root = Element("#page", None, False)
    # tag, the element its text goes to, and the place of the nearest entry of STOPS at or below it; beyond MAX_DEPTH
    # the element is an ancestor's, but the entry is there for its end tag
    stack, blocks = [("#page", root, 0)], []
    opened: Counter[str] = Counter()
    pieces: list[str] = []
    linked: list[str] = []
    holder = root

    def flush() -> None:
        nonlocal holder
        if pieces:
            text = " ".join("".join(pieces).split())
            if text and not holder.left_out:
                blocks.append((holder, text, len(" ".join(" ".join(linked).split()))))
            pieces.clear()
            linked.clear()

    def add(text: str) -> None:
        nonlocal holder
        if text and not stack[-1][1].left_out:
            block = stack[-1][1]
            in_link = False
            while block.tag in INLINE and block.parent is not None:
                in_link |= block.tag == "a"
                block = block.parent
            if block is not holder:
                flush()
                holder = block
            text = unescape(text)
            pieces.append(text)
            if in_link:
                linked.append(text)

    def close(at: int) -> None:
        tags = [tag for tag, _, _ in stack[at:]]
        if any(tag not in INLINE for tag in tags):
            flush()
        opened.subtract(tags)
        del stack[at:]

    at = 0
    while at < len(html):
        token = _TOKEN.search(html, at)
        if token is None:
            add(html[at:])
            break
        add(html[at : token.start()])
        at = token.end()
        if not token[2]:
            continue
        tag = token[2].lower()
        if not token[4] and not token[1]:
            break  # the page ends inside a tag
        if token[1]:
            if opened[tag] > 0:
                close(next(i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == tag))
            continue
        if tag == "br":
            add(" ")
            continue
        if tag not in INLINE:
            # what an opening block ends by itself: a paragraph, or an item of the same list or table row
            open_ = stack[-1][2]
            ended = CLOSED_BY.get(tag, ())
            while (name := stack[open_][0]) not in BARRIERS and name != "p" and name not in ended:
                open_ = stack[open_ - 1][2]
            if name == "p" or name in ended:
                close(open_)
            flush()
        parent = stack[-1][1]
        left_out, kind = parent.left_out, ""
        if not left_out:
            attributes = _attributes(token[3])
            left_out, kind = _is_furniture(tag, attributes, parent.in_article), attributes.get("class", "")
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)", re.I).search(html, at)
            at = len(html) if end is None else end.start()
            if end is not None:
                at = html.find(">", end.end()) + 1 or len(html)
            continue
        if tag not in VOID:
            deep = len(stack) >= MAX_DEPTH and (parent.left_out or not left_out)
            opened[tag] += 1
            stack.append((tag, parent if deep else Element(tag, parent, left_out, kind), len(stack) if tag in STOPS else stack[-1][2]))
    flush()
    return blocks


def _ancestors(element: Element) -> Iterator[Element]:
    while element is not None:
        yield element
        element = element.parent


def container(blocks: list[tuple[Element, str, int]]) -> tuple[set[int], set[int]]:
    """Ids of the elements whose text is the article's, the best container and good siblings, and of those in them whose text is not."""
    scored: dict[int, Element] = {}
    holding: dict[int, Element] = {}  # all elements with text, paragraphs too, in order
    for holder, text, link_chars in blocks:
        points = 1.0 + text.count(",") + text.count("、") + min(len(text) // 100, 3)
        ended = _SENTENCE_END.search(text) is not None
        for depth, element in enumerate(_ancestors(holder)):
            element.chars += len(text)
            element.link_chars += link_chars
            element.in_paragraphs += len(text) if holder.tag in PARAGRAPHS else 0
            element.sentences += ended
            holding[id(element)] = element
            level = depth - (holder.tag in PARAGRAPHS)
            if level < 0:
                continue  # a paragraph passes its points on
            element.points += points / (1 if level <= 0 else 2 if level == 1 else 3 * level)
            scored[id(element)] = element
    if not scored:
        return set(), set()

    def score(element: Element) -> float:
        bonus = SEMANTIC_POINTS if element.tag in ("article", "main") else 0.0
        return (element.points + bonus) * (1 - element.link_chars / max(1, element.chars))

    best = max(scored.values(), key=score)
    # a part of an article stands for the whole article
    for element in _ancestors(best):
        if element.tag in ("article", "main"):
            best = element
            break
    least = max(10.0, SIBLING_SHARE * score(best))
    marked = best.tag in ("article", "main")
    children: dict[int, list[Element]] = {}  # by parent; where an element begins is where its first text is
    for element in holding.values():
        children.setdefault(id(element.parent), []).append(element)
    kept = {id(best)}
    # of the page itself, boxes of links do not belong to the article
    links = {id(e) for e in children.get(id(best), ()) if 2 * e.link_chars > e.chars and e.tag not in PARAGRAPHS} if best.tag in PAGE else set()

    def is_prose(element: Element, like: Element, far: bool) -> bool:
        """Whether a sibling of ``like`` is a paragraph of the article, or a part of it as that one is."""
        if element.tag not in PARAGRAPHS and (element.tag != like.tag or 2 * element.in_paragraphs < element.chars):
            return False
        if element.link_chars > PROSE_LINKS * element.chars:
            return False
        if far and not (element.kind and element.kind == like.kind):
            return element.in_paragraphs > max(PROSE_CHARS, SIBLING_SHARE * best.in_paragraphs) and element.sentences > 0
        return element.chars > PROSE_CHARS or not element.link_chars and element.sentences > 0

    around, far = best, False
    while around.parent is not None:
        follows = False  # whether what comes next is kept
        siblings = children[id(around.parent)]
        for element in reversed(siblings):
            if element is not around:
                good = not far and id(element) in scored and score(element) >= least
                if not marked and element.tag in HEADINGS:
                    good |= follows and element.link_chars <= PROSE_LINKS * element.chars
                elif not marked:
                    good |= is_prose(element, around, far)
                if good:
                    kept.add(id(element))
            follows = element is around or id(element) in kept
        if marked:
            break
        far, around = True, around.parent
    return kept, links


def main_text(html: str | None) -> str:
    """The article of a page: its blocks, one to a line; empty if there is none."""
    blocks = parse(html or "")
    kept, dropped = container(blocks)

    def belongs(holder: Element) -> bool:
        around = {id(e) for e in _ancestors(holder)}
        return not kept.isdisjoint(around) and dropped.isdisjoint(around)

    return "\n".join(text for holder, text, _ in blocks if belongs(holder))


def extract(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: page_id, url, text, n_chars.

    Null or empty html has an empty text. Ids and URLs are passed on, null or repeated; a table
    without rows gives none. Other columns are not read.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).cast("string").alias("html"))

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [main_text(html.as_py()) for html in batch.column("html")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(found, pa.string()), pa.array([len(x) for x in found], pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    schema = T.StructType([rows.schema["page_id"], rows.schema["url"], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    return rows.mapInArrow(texts, schema)
