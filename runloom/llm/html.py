"""Main text of web pages by tree scoring."""

from __future__ import annotations

import html
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runloom.llm.common import fresh, ship_package

# Fixed values of HTML: elements whose content is no text, without content, inline, and never part of an article.
_RAW = frozenset("script style noscript template iframe svg canvas audio video select textarea title annotation annotation-xml".split())
#: Of these, the ones that a slash before the closing bracket ends.
_FOREIGN = frozenset("svg annotation annotation-xml".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike "
    "strong sub sup time tt u var wbr br img object "
    "math semantics maction menclose merror mfenced mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms "
    "mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover none".split()
)
_OUTSIDE = frozenset("nav aside footer form button dialog menu fieldset head".split())
_PARAGRAPH = frozenset("p pre blockquote td li dd dt section div article main h1 h2 h3 h4 h5 h6 figcaption".split())
#: What belongs to an article when it stands between parts that are kept, however little text it has.
_BETWEEN = frozenset("h3 h4 h5 h6 ul ol dl table figure".split())
_CLOSES_P = frozenset("p div ul ol dl table section article main h1 h2 h3 h4 h5 h6 pre blockquote form nav aside footer header hr figure".split())
#: Words of class, id and role that mark what surrounds an article, and those that mark an article.
_AROUND = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice "
    "notices alert popup modal overlay newsletter subscribe subscription signup login sidebar side widget menu nav navbar navigation "
    "breadcrumb breadcrumbs comment comments disqus reply replies respondlist reader share sharing social related recommended "
    "footer header masthead toolbar search pagination pager complementary contentinfo hidden".split()
)
_ARTICLE = frozenset("article content main post story entry body text".split())

#: Of the words above, those of what readers wrote: often longer than the article.
_READERS = frozenset("comment comments disqus reply replies respondlist".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?>(?:[^<>\"']|\"[^\"]*\"|'[^']*')*))>",
    re.S | re.I,
)
#: Where an element without text ends if nothing closes it: at the next block, or the end of one.
_EDGE = re.compile(rf"<(?:{'|'.join(sorted(_CLOSES_P))}|body|li|td|tr)(?=[\s>/])|</(?:{'|'.join(sorted(_CLOSES_P))}|body|html|li|td|tr|head)\s*>", re.I)
_NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_HIDES = re.compile(r"""(?:^|\s)(?:hidden(?:\s|=|$)|aria-hidden\s*=\s*["']?true)|display\s*:\s*none""", re.I)


class _Node:
    __slots__ = ("tag", "parent", "outside", "inside", "marked", "score", "chars", "linked", "depth", "flows", "group")

    def __init__(self, tag, parent, attrs):
        self.tag, self.parent = tag, parent
        self.depth = parent.depth + 1 if parent else 0
        #: part of an article by its elements, so that a header belongs to it
        self.inside = bool(parent) and (parent.inside or parent.tag in ("article", "main"))
        self.outside, self.marked = _surrounds(tag, attrs, self) if parent else (False, "")
        self.score, self.chars, self.linked, self.flows, self.group = 0.0, 0, 0, [0.0] * 4, None


def _surrounds(tag: str, attrs: str, node: _Node) -> tuple[bool, str]:
    """Whether an element is no part of an article by its kind, and what the words of its class, id and role speak for."""
    if node.parent.outside or tag in _OUTSIDE or tag == "header" and not node.inside:
        return True, ""
    if not attrs or tag in ("body", "html", "article", "main"):
        return False, ""
    names = {w for m in _NAMED.finditer(attrs) for w in re.split(r"[\s_-]+", (m[1] or m[2] or m[3] or "").lower())}
    if _HIDES.search(attrs):
        return True, ""
    if names & _READERS and ({"comment", "comments"} & names or not names & _ARTICLE):
        return False, "readers"
    return False, "around" if names & _AROUND and not names & _ARTICLE else ""


def _parse(page: str) -> tuple[list[_Node], list[tuple[_Node, str, int, int]]]:
    """Elements, each after its parent, and blocks of text outside of menus and the like: (node, text, characters, characters in links)."""
    root = here = _Node("", None, "")
    nodes, blocks = [root], []
    pieces: list[str] = []
    link, linked, at = 0, 0, 0
    open_tags: Counter = Counter()
    low, last_end = page.lower(), {}

    def text(raw: str):
        nonlocal linked
        if raw and not here.outside:
            pieces.append(raw)
            if link:
                linked += len(raw)

    def flush():
        nonlocal linked
        if pieces:
            whole = " ".join(html.unescape("".join(pieces)).split())
            if whole:
                blocks.append((here, whole, len(whole), min(linked, len(whole))))
            pieces.clear()
        linked = 0

    def leave():
        nonlocal here
        open_tags[here.tag] -= 1
        here = here.parent

    def without(tag: str, attrs: str, end: int) -> int:
        """Where the page goes on after an element without text."""
        if attrs.endswith("/") and tag in _FOREIGN:
            return end
        if tag not in last_end:
            last_end[tag] = low.rfind(f"</{tag}")
        if last_end[tag] >= end:
            closed = re.compile(rf"</{tag}\s*>", re.I).search(page, end)
            if closed:
                return closed.end()
        edge = _EDGE.search(page, end)
        return edge.start() if edge else len(page)

    while token := _TOKEN.search(page, at):
        if token.start() > at:
            text(page[at : token.start()])
        at = token.end()
        tag = token["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if tag in _RAW:
            if not token["end"]:
                at = without(tag, token["attrs"], at)
            continue
        if tag in _INLINE or tag in _VOID and tag != "hr":
            if tag == "a":
                link = 0 if token["end"] else 1
            elif tag == "br":
                text(" ")
            # an inline element that only surrounds the article still hides its text
            continue
        flush()
        link = 0
        if token["end"]:
            if open_tags[tag]:
                while here.tag != tag:
                    leave()
                leave()
            continue
        if tag in _CLOSES_P:
            while here is not root and here.tag in ("p", "dt", "dd"):
                leave()
        elif tag in ("li", "td", "th", "tr", "dt", "dd", "option") and here.tag == tag:
            leave()
        if tag != "hr" and not token["attrs"].endswith("/"):
            here = _Node(tag, here, token["attrs"])
            nodes.append(here)
            open_tags[tag] += 1
    text(page[at:])
    flush()
    return nodes, blocks


def _points(node: _Node, whole: str, chars: int, linked: int) -> float:
    return (1 + whole.count(",") + min(chars / 100, 3)) * (1 - linked / chars) if node.tag in _PARAGRAPH or not node.tag else 0.0


def _without_marked(nodes: list[_Node], blocks: list) -> list:
    """The blocks that no marked element holds, where the marks are to be believed.

    The words of a class only speak against an element. One that holds four times the points of all that is not marked is no
    surroundings; what readers wrote can be longer than an article, so it is let in only if there is nothing else.
    """
    while True:
        held: dict[_Node, float] = {}
        free, kept = 0.0, []
        for node in nodes:
            node.group = node if node.marked else node.parent and node.parent.group
        for block in blocks:
            owner = block[0].group
            if owner is None:
                kept.append(block)
                free += _points(*block)
            else:
                held[owner] = held.get(owner, 0.0) + _points(*block) + 1e-9
        wrong = [n for n, p in held.items() if p > (4 * free if n.marked == "around" else 0 if not kept else float("inf"))]
        around = [n for n in wrong if n.marked == "around"]
        if not wrong:
            return kept
        worst = max(around or wrong, key=lambda n: (held[n], -n.depth))
        while worst:  # what holds it is no surroundings either
            worst.marked = ""
            worst = worst.parent and worst.parent.group


def _scored(nodes: list[_Node], blocks: list) -> None:
    """Points, characters and characters in links of all elements, from the leaves up in one pass.

    A block's points go whole to its parent, by half to the next ancestor, by a sixth to the third, and by two thirds of that
    which came last to each further one.
    """
    for node, whole, chars, linked in blocks:
        node.chars += chars
        node.linked += linked
        node.flows[0] += _points(node, whole, chars, linked)
    for node in reversed(nodes):
        own, first, second, rest = node.flows
        # the paragraph itself stands for its block
        stands = node.tag in ("p", "li", "td", "dd", "dt", "h1", "h2", "h3", "h4", "h5", "h6")
        node.score = (0.0 if stands else own) + first + second / 2 + rest
        if up := node.parent:
            up.chars += node.chars
            up.linked += node.linked
            up.flows[1] += own
            up.flows[2] += first
            up.flows[3] += second / 6 + rest * 2 / 3


def main_text(page: str | None) -> str:
    """The article of a page: blocks joined by two line ends; empty for null or a page without text."""
    nodes, blocks = _parse(page) if page else ([], [])
    blocks = _without_marked(nodes, blocks) if blocks else []
    if not blocks:
        return ""
    _scored(nodes, blocks)

    def plain(n: _Node) -> float:
        return n.score * (1 - n.linked / n.chars)

    def weight(n: _Node) -> float:
        return plain(n) + (25 if n.tag in ("article", "main") else 0) * (1 - n.linked / n.chars)

    best = max((n for n in nodes if n.chars), key=lambda n: (weight(n), n.chars, -n.depth))
    top = weight(best)
    while best.parent and best.parent.tag not in ("", "html", "body") and (
        best.tag not in ("article", "main") and weight(best.parent) >= 0.5 * top
    ):
        best = best.parent
    stories = Counter(n.parent for n in nodes if n.tag == "article")
    up = best.parent
    # of several articles side by side the best one is the page's
    while up and not (best.tag == "article" and stories[best.parent] > 1):
        if up.tag in ("article", "main"):
            best = up
            break
        up = up.parent
    text_top = plain(best)

    def sibling(n: _Node) -> bool:
        if n is best:
            return True
        if n.parent is not best.parent or n.linked > 0.25 * n.chars:
            return False
        # an article beside the best one is another story unless its own text says otherwise
        return n.tag in ("p", "h1", "h2", "blockquote", "pre") or (weight(n) >= 0.2 * top and (n.tag not in ("article", "main") or plain(n) >= 0.2 * text_top))

    for node in nodes:  # which part beside the best one, or the best one, holds a block
        node.group = node if node is best or node.parent is not None and node.parent is best.parent else node.parent and node.parent.group
    parts = [block[0].group for block in blocks]
    kept = [up is not None and (best.parent is None or sibling(up)) for up in parts]
    first, last = kept.index(True), len(kept) - kept[::-1].index(True)
    for i in range(first, last):
        up = parts[i]
        kept[i] = kept[i] or up is not None and up.tag in _BETWEEN and up.linked <= 0.25 * up.chars
    return "\n\n".join(whole for (_, whole, *_), keep in zip(blocks, kept) if keep)


def _extract(html_name: str, text_name: str):
    def run(batches):
        for batch in batches:
            at = batch.schema.names.index(html_name)
            texts = pa.array([main_text(v) for v in batch.column(at).to_pylist()], pa.string())
            columns = [batch.column(i) for i in range(batch.num_columns) if i != at]
            names = [n for i, n in enumerate(batch.schema.names) if i != at]
            yield pa.RecordBatch.from_arrays([*columns, texts], [*names, text_name])

    return run


def extract_text(pages: DataFrame, text: str = "text") -> DataFrame:
    """``pages`` (url, html, any other columns) with the main text in place of ``html``.

    Blocks of text pass points for their length and commas to their ancestors, discounted by the share of text in links; the
    best container and its fitting siblings are kept, whole, in page order. Menus, headers, footers, sidebars, notices, adverts,
    forms, scripts and comments are left out by element and by the words of class, id and role; the words only speak against an
    element, and one that holds nearly all of the text is kept.

    * null or empty html, or a page without text: the empty string; * unclosed elements end with what surrounds them, those
    without text at the next block; * a page is read in one pass and its elements are scored in another, however long or deep; * rows are independent, so repeated rows give repeated results; * a column that has
    the name ``text`` already keeps it, and the text gets a free name.
    """
    ship_package(pages.sparkSession)
    rest = [f for f in pages.schema.fields if f.name != "html"]
    (name,) = fresh(pages.drop("html"), text)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rest), f"`{name}` string"])
    return pages.select(*[F.col(f"`{f.name}`") for f in rest], "html").mapInArrow(_extract("html", name), schema)
