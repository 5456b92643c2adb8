"""Main text of web pages by tree scoring.

Paragraphs pass points for length and commas to their ancestors, less with every level and less
the more of their text is links. The best container is kept with those of its siblings that
look like text as well; menus, forms, adverts and the like never take part. Names of elements
alone take nothing out that reads like article text.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.llm.common import small

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[\s/]++|[^\s/>][^\s/>=]*+(?:\s*=\s*(?:"[^"]*"|'[^']*'|[^\s>]*))?)*+)>?""", re.S)
#: Quotes open a value only right after the equals sign; a bare value ends at white space or the tag's end.
ATTRIBUTE = re.compile(r"""([^\s=/>][^\s=/>]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")

VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is text up to their own end tag, whatever it looks like.
RAW = set("script style textarea title iframe noembed noframes xmp".split())
#: Never part of the text.
OUT = set("head script style noscript template nav footer aside form fieldset button select option textarea input label iframe "
          "object embed svg canvas audio video dialog menu menuitem title noembed noframes xmp annotation annotation-xml".split())
BLOCK = set("address article blockquote body center dd details div dl dt figcaption figure h1 h2 h3 h4 h5 h6 header hgroup hr html li "
            "main ol p pre section summary table tbody td tfoot th thead tr ul caption br".split()) | OUT
#: An opening tag ends these elements if they are open, up to the named outer ones.
P_ENDS = set("address article aside blockquote center details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header "
             "hgroup hr main menu nav ol p pre section table ul".split())
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"thead", "tbody", "tr", "td", "th"}, {"table"}), "tfoot": ({"thead", "tbody", "tr", "td", "th"}, {"table"}),
    "option": ({"option"}, {"select"}), "body": ({"head"}, set()),
}
#: Closing such an element ends everything open inside it.
SCOPES = BLOCK - {"p", "br", "hr"}
#: Words in class, id or role of what is not the article; fixed by usage on the web.
UNLIKELY = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertise\w*|advertising|adsense|sponsor\w*|promo\w*|banner|sidebar|aside|menu\w*|nav\w*|breadcrumbs?|"
    r"footer|masthead|comments?|commentlist|disqus\w*|repl(?:y|ies)|respond|newsletter|signup|login|popup|modal|overlay|cookies?\w*|consent|gdpr|"
    r"widgets?|pager|pagination|toolbar|complementary|contentinfo|navigation|hidden)(?=$|[\s_-])", re.I)
#: Words that real parts of an article are named by as well, as in ids made from headings.
DOUBTFUL = re.compile(
    r"(?:^|[\s_-])(?:side|foot|responses|discussion|share\w*|sharing|social\w*|related\w*|recommend\w*|subscri\w*|pop|notices?|alert|disclaimer|"
    r"search\w*|skip|copyright|legal|header)(?=$|[\s_-])", re.I)
#: What follows says how a page is laid out, not what an element is.
LAYOUT = re.compile(r"(?:(?<=[\s_-])|^)(?:(?:has|no|non|with|without)[_-][^\s_-]+|side-by-side)(?=$|[\s_-])", re.I)
ARTICLE = re.compile(r"(?:^|[\s_-])(?:article|entry|post|content|story|text|body|main)(?=$|[\s_-])", re.I)
NEVER_UNLIKELY = {"html", "body", "main"}
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)

#: Paragraphs shorter than this give no points; a point for so many characters, up to three.
MIN_PARAGRAPH = 25
POINT_CHARS = 100
PARAGRAPHS = {"p", "pre", "blockquote", "td", "li", "dd", "div", "section", "article", "main", "body", "figcaption"}
#: A sibling is kept with this share of the best score, or as a paragraph of so many characters.
SIBLING_SHARE = 0.2
SIBLING_CHARS = 80
#: Text goes on beside the best container, or around it, where something else has this share of its score.
SIMILAR_SHARE = 0.5
LINK_SHARE = 0.5
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Names say nothing about these and what is inside them.
TEXTUAL = HEADINGS | {"p", "pre", "blockquote", "figcaption", "caption"}
#: Lists and boxes with more of their text in links are left out of the article if more speaks for a menu.
LINK_BOXES = {"ul", "ol", "dl", "div", "section", "table"}
#: Items of a menu are this short and no sentences; the menu has at most this share of the text it stands beside.
ITEM_CHARS = 40
MENU_SHARE = 0.25
SENTENCE = re.compile(r"[.!?](?=\s|$)|[。！？]")
#: With a doubtful name a box needs this many characters, and a link share under this.
DOUBTFUL_CHARS = 80
DOUBTFUL_LINKS = 0.25
#: A box with an unlikely name is only a wrapper if it has this share of the page's text.
WRAPPER_SHARE = 0.75
#: Points of boxes that are kept against their name count this much.
LOWERED = 0.25


class Node:
    __slots__ = ("tag", "parent", "out", "kids", "own", "chars", "commas", "linked", "score", "wrapped", "article", "textual", "doubt", "weight")

    def __init__(self, tag: str, parent: Node | None, out: bool) -> None:
        self.tag, self.parent, self.out = tag, parent, out
        self.kids: list[Node | str] = []
        self.own = self.chars = self.commas = self.linked = 0
        self.score = 0.0
        self.article = tag in ("article", "main") or bool(parent and parent.article)
        self.wrapped = tag == "a" or bool(parent and parent.wrapped)
        self.textual = tag in TEXTUAL or bool(parent and parent.textual)
        self.doubt = 0  # what the names say: 1 article or not, 2 not the article
        self.weight = 1.0


def judge(tag: str, raw: str, inside: Node) -> tuple[bool, int]:
    """Whether an element can be told not to be text by its tag and attributes, and the doubt that its names leave."""
    if tag in OUT:
        return True, 0
    if tag == "header":
        return not inside.article, 0
    if "=" not in raw and "hidden" not in raw or tag in NEVER_UNLIKELY:
        return False, 0
    found = {}
    for name, value in ATTRIBUTE.findall(raw):
        found.setdefault(name.lower(), entities.unescape(value.strip("\"'")))
    if "hidden" in found or found.get("aria-hidden") == "true" or HIDDEN.search(found.get("style", "")):
        return True, 0
    if inside.textual or tag in TEXTUAL or tag in ("td", "th", "tr", "tbody") or tag not in BLOCK and tag != "span":
        return False, 0
    names = LAYOUT.sub(" ", " ".join(found.get(k, "") for k in ("class", "id", "role")))
    unlikely = UNLIKELY.search(names)
    if not unlikely and not DOUBTFUL.search(names):
        return False, 0
    article = any(ARTICLE.search(w) and not UNLIKELY.search(w) for w in names.split())
    return False, 2 if unlikely and not article else 1


def parse(page: str) -> Node:
    """The element tree; unclosed and misplaced tags are put right as browsers do, roughly."""
    root = Node("html", None, False)
    stack, at = [root], 0

    def add(raw: str) -> None:
        if raw and not stack[-1].out:
            stack[-1].kids.append(entities.unescape(raw) if "&" in raw else raw)

    def close(tags: set[str], bounds: set[str]) -> None:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in tags:
                del stack[i:]
                return close(tags, bounds)
            if stack[i].tag in bounds:
                return None
        return None

    while found := TOKEN.search(page, at):
        add(page[at : found.start()])
        at = found.end()
        name = found[2]
        if not name:
            continue
        tag = name.lower()
        if found[1]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
                if stack[i].tag in SCOPES and tag not in SCOPES:
                    break
            continue
        if tag in ("html", "body") and any(n.tag == tag for n in stack):
            continue
        if tag in P_ENDS:
            close({"p"}, SCOPES)
        if tag in CLOSES:
            close(*CLOSES[tag])
        out, doubt = judge(tag, found[3], stack[-1])
        node = Node(tag, stack[-1], stack[-1].out or out)
        node.doubt = doubt
        stack[-1].kids.append(node)
        if tag in RAW:
            end = re.compile(f"</{tag}(?=[\\s/>]|$)[^>]*>?", re.I).search(page, at)
            at = end.end() if end else len(page)
        elif tag not in VOID and not found[0].endswith("/>"):
            stack.append(node)
    add(page[at:])
    return root


def walk(root: Node) -> list[Node]:
    """Elements in page order, without those that are out. No recursion: trees can be deep."""
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        if not node.out:
            order.append(node)
            todo += [k for k in reversed(node.kids) if isinstance(k, Node)]
    return order


def count(order: list[Node]) -> None:
    """Characters, commas and linked characters of every element."""
    for node in order:
        node.own = node.chars = node.commas = node.linked = 0
    for node in order:
        for k in node.kids:
            if isinstance(k, str) and (t := "".join(k.split())):
                block = node
                while block.tag not in BLOCK and block.parent:
                    block = block.parent
                block.own += len(t)
                node.chars += len(t)
                node.commas += t.count(",") + t.count("，") + t.count("、")
                node.linked += len(t) if node.wrapped else 0
    for node in reversed(order):
        if node.parent:
            node.parent.chars += node.chars
            node.parent.commas += node.commas
            node.parent.linked += node.linked


def settle(order: list[Node]) -> bool:
    """Takes out boxes in doubt whose content does not speak for them; whether there were any.

    Text with few links is kept against a doubtful name, and against an unlikely one only if the
    box wraps the article or most of the page.
    """
    if not any(n.doubt for n in order):
        return False
    # Comments and teasers can be article elements too, so only the longest counts.
    marks = [n for n in order if n.tag == "main"] + [n for n in order if n.tag == "h1"][:1]
    wraps = set()
    for n in [*marks, max((n for n in order if n.tag == "article"), key=lambda n: n.chars, default=None)]:
        while n and n not in wraps:
            wraps.add(n)
            n = n.parent
    total = order[0].chars
    for n in order:
        if n.doubt and n.chars:
            low = n.linked / n.chars < DOUBTFUL_LINKS
            n.out = not (n in wraps or low and n.chars >= (DOUBTFUL_CHARS if n.doubt == 1 else WRAPPER_SHARE * total))
    for n in order:
        if n.parent:
            n.out = n.out or n.parent.out
            n.weight = n.parent.weight if not n.doubt or n in wraps else LOWERED
    return True


def measure(order: list[Node]) -> None:
    """Points of every element."""
    for node in order:
        if node.tag in PARAGRAPHS and node.own >= MIN_PARAGRAPH:
            points = (1 + node.commas * node.own / node.chars + min(node.own / POINT_CHARS, 3)) * (1 - node.linked / node.chars) * node.weight
            up, level = node.parent, 1
            if node.tag in ("div", "section", "article", "main", "body"):
                node.score += points
            while up and level <= 8:
                up.score += points / level
                up, level = up.parent, level * 2


def best_container(root: Node, order: list[Node]) -> list[Node]:
    """The kept elements, in page order.

    Inside ``article`` or ``main`` the whole element is kept, with those of its siblings of the same
    kind that have a similar amount of unlinked text. Elsewhere the container climbs as long as
    something beside it holds a similar score, and is kept with its siblings that look like text.
    """
    scored = [n for n in order if n.score and n.tag not in ("p", "pre", "li", "td", "dd", "html", "tr", "span", "a", "b", "i", "em", "strong")]
    if not scored:
        named = [n for n in order if n.tag in ("article", "main") and n.chars] or [n for n in order if n.tag == "body" and n.chars]
        return named[:1] or [root]
    best = max(scored, key=lambda n: n.score * (1 - n.linked / n.chars))
    top: Node | None = best
    while top and top.tag not in ("article", "main"):
        top = top.parent
    if top:
        beside = [k for k in top.parent.kids if isinstance(k, Node) and k.tag == top.tag and not k.out and not k.doubt] if top.parent else []
        return [k for k in beside if k is top or k.chars - k.linked >= SIMILAR_SHARE * (top.chars - top.linked)] if top in beside else [top]
    if best.tag == "body" or not best.parent:
        return [best]
    # The best score in every element or below it.
    held: dict[Node, float] = {}
    for n in reversed(order):
        own = n.score * (1 - n.linked / n.chars) if n.chars else 0.0
        held[n] = max([own, *(held.get(k, 0.0) for k in n.kids if isinstance(k, Node) and not k.doubt)])
    path = node = best
    while node.parent and node.parent.tag != "html":
        if any(isinstance(k, Node) and k is not node and not k.doubt and held.get(k, 0.0) >= SIMILAR_SHARE * held[best] for k in node.parent.kids):
            path = node
        node = node.parent
    least = SIBLING_SHARE * best.score
    kept = []
    for k in path.parent.kids:
        if not isinstance(k, Node) or k.out or k.doubt and k is not path:
            continue
        links = k.linked / k.chars if k.chars else 1
        paragraph = k.tag in ("p", "pre", "blockquote") and k.chars >= SIBLING_CHARS and links < 0.25
        similar = held.get(k, 0.0) >= (least if path is best else SIMILAR_SHARE * held[best])
        if k is path or k.score * (1 - links) >= least or similar or paragraph or (k.tag in HEADINGS and links < LINK_SHARE):
            kept.append(k)
    return kept


def inner(top: Node) -> str:
    """All text below, without what is out."""
    parts: list[str] = []
    todo: list[Node | str] = [top]
    while todo:
        k = todo.pop()
        if isinstance(k, str):
            parts.append(k)
        elif not k.out:
            if k.tag in BLOCK:
                todo.append(" ")
                parts.append(" ")
            todo += reversed(k.kids)
    return " ".join("".join(parts).split())


class Below(NamedTuple):
    """Counts in an element: list items or cells, those of them and of the links that are long or sentences, and paragraphs."""

    items: int
    long_items: int
    long_links: int
    paragraphs: int


def below(order: list[Node]) -> dict[Node, Below]:
    found: dict[Node, Below] = {}
    for n in reversed(order):
        item, link = n.tag in ("li", "dt", "dd", "td", "th"), n.tag == "a"
        long = (item or link) and (n.chars > ITEM_CHARS or SENTENCE.search(inner(n)) is not None)
        own = (item, item and long, link and long, n.tag == "p" and n.own >= MIN_PARAGRAPH)
        found[n] = Below(*map(sum, zip(own, *(found[k] for k in n.kids if isinstance(k, Node) and k in found), strict=True)))
    return found


def menus(top: Node) -> set[Node]:
    """Link-heavy lists and boxes inside ``top`` that are menus by more than their links.

    Either their names say so, or they are short lists of short items at an edge of ``top``, not
    introduced by a heading or a colon; and link-only cells beside a cell that holds the text.
    """
    order = walk(top)
    heavy = [n for n in order if n is not top and n.tag in LINK_BOXES and n.chars and n.linked / n.chars > LINK_SHARE]
    cells = [n for n in order if n.tag == "td" and n.chars and n.linked / n.chars > LINK_SHARE and n.parent]
    found = {n for n in heavy if n.doubt}
    if not cells and len(heavy) == len(found):
        return found
    held = below(order)
    for n in cells:
        beside = [k for k in n.parent.kids if isinstance(k, Node) and k is not n and k.tag == "td" and k.chars > top.chars / 2]
        if any(held[k].paragraphs > 1 for k in beside if k in held):
            found.add(n)
    if len(heavy) == len(found):
        return found
    # Unlinked characters before every element, and what comes right before it.
    before, last, seen, final = {}, {}, 0, (None, "")
    todo: list[tuple[Node | str, Node | None]] = [(top, None)]
    while todo:
        k, of = todo.pop()
        if isinstance(k, str):
            if t := "".join(k.split()):
                seen += 0 if of.wrapped else len(t)
                final = (of, t)
        elif not k.out:
            before[k], last[k] = seen, final
            todo += [(c, k) for c in reversed(k.kids)]
    for n in heavy:
        own = n.chars - n.linked
        at_edge = not before[n] or before[n] + own >= seen
        of, text = last[n]
        while of and of is not top and of.tag not in HEADINGS:
            of = of.parent
        introduced = bool(of and of.tag in HEADINGS) or text.endswith((":", "："))
        short = not held[n].long_items if held[n].items else not held[n].long_links
        if n not in found and at_edge and not introduced and n.chars <= MENU_SHARE * top.chars and short:
            found.add(n)
    return found


def collect(kept: list[Node]) -> str:
    for top in kept:
        for n in menus(top):
            n.out = True
    return " ".join(t for t in map(inner, kept) if t)


def main_text(page: str | None) -> str:
    """The article's text in one line; empty if there is none."""
    if not page:
        return ""
    root = parse(page)
    order = walk(root)
    count(order)
    if settle(order):
        order = walk(root)
        count(order)
    measure(order)
    return collect(best_container(root, order))


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` per row of ``pages(page_id, url, html)``.

    Nulls: a null html gives an empty text; page_id and url are passed on. Pages are read whole. Ties between containers:
    the first in the page. Repeated rows: one result each. Empty table: empty result. Other
    columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            texts = [main_text(h) for h in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    narrow = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return narrow.mapInArrow(run, "page_id long, url string, text string, n_chars long")
