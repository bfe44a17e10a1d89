"""Main-text extraction by tree scoring.

Paragraphs pass points for their length and commas to their ancestors, discounted by link density; the best
container and those of its siblings that read like it are kept, with the headings, lists, tables and quotes among and
beside them, without the parts that are never article text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veldra.llm.common import small_batches

#: Elements without content.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is text up to their own end tag.
_RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
#: Elements that never hold article text.
_NEVER = frozenset("head script style noscript template iframe nav header footer aside form button select option textarea input label fieldset dialog menu svg canvas object embed video audio title xmp noembed noframes".split())
#: Elements that stand in the line with the text around them.
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br".split())
#: Start tags that end an open paragraph.
_ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
#: Start tags that end an open element of the same family, up to the given container.
_SIBLINGS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
}
#: Words in class, id or role that mark parts which aren't the article, as the first or the last word of a name.
_ASIDE = frozenset(
    "ad ads advert advertisement adverts advertising adsense banner sponsor sponsored promo promotion breadcrumb breadcrumbs comment comments commentlist disqus respond cookie cookies consent gdpr footer masthead menu nav navbar navigation navigator pager pagination popup modal newsletter subscribe outbrain sidebar sidebox widget toolbar skip disclaimer".split()
)
#: The same for words that name other things as well: as the last word, or before one that names a part of a page.
_PERHAPS = frozenset("alert copyright foot header login notice notices reactions recommended related replies search share sharing side signup social tags".split())
_PARTS = frozenset("area articles bar block box button buttons container content icons items links list module news panel posts section stories tools widget wrap wrapper".split())
#: Of all these, the words of reader comments.
_READERS = frozenset("comment comments commentlist disqus respond replies reactions".split())
#: Such words that mark the article.
_BODY = frozenset("article articlebody body content entry main post story text".split())

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>"']|"[^"<]*"|'[^'<]*')*+)>|<(/?)([A-Za-z][^\s/>]*)([^>]*)>""", re.S)
_ATTRIBUTE = re.compile(r"""(?:^|[\s"'/])(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?(?=[\s/]|$)""", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_SPACE = re.compile(r"\s+")


_HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
_CONTAINERS = frozenset(("div", "td", "pre", "article", "section", "main", "body", "#top"))
#: Parts of a text that hold no paragraph of their own.
_INSERTS = frozenset(("ul", "ol", "dl", "blockquote", "table", "pre", "figure"))
_ENDS = frozenset(".!?:\u2026\u3002\uff01\uff1f\"\u201d\u00bb)")


class Node:
    """An element.  ``away``: nothing of it is article text, whatever it holds; ``hinted``: because of its names;
    ``doubt``: its names lower its points; ``body``: its names or its kind raise them; ``block``: the element itself
    if it isn't inline, else the nearest around it that isn't."""

    __slots__ = ("name", "up", "kids", "block", "away", "hinted", "readers", "doubt", "body", "score", "text_n", "link_n", "p_n", "keep", "ends")

    def __init__(self, name: str, up: Node | None, attributes: str = ""):
        self.name, self.up, self.kids = name, up, []
        self.block = up.block if up is not None and name in _INLINE else self
        self.score, self.text_n, self.link_n, self.p_n, self.keep, self.ends = 0.0, 0, 0, 0, False, False
        self.away, self.hinted, self.readers, self.doubt, self.body = name in _NEVER, False, False, False, name in ("article", "main")
        if attributes and (not self.away or name == "form"):
            self._read(attributes)

    def _read(self, attributes: str) -> None:
        for key, value in _ATTRIBUTE.findall(attributes):
            key, value = key.lower(), unescape(value.strip("\"'"))
            if key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none", value):
                self.away, self.readers = True, True
            elif key in ("class", "id", "role"):
                for one in value.split():
                    words = [w.lower() for w in _WORD.findall(one)]
                    if not words or words[0] in ("has", "with", "no", "is"):
                        continue
                    first, last = words[0], words[-1]
                    # the first or last word says what a part is: ad-box, main-nav
                    if last in _ASIDE or last in _PERHAPS or first in _ASIDE or first in _PERHAPS and last in _PARTS:
                        self.hinted = self.name not in ("body", "html", "article", "main")
                        self.readers |= first in _READERS or last in _READERS
                    elif first in _PERHAPS:
                        self.doubt = True
                    elif last in _BODY or first in _BODY:
                        self.body = True
        self.away = self.away or self.hinted
        self.body = self.body and not self.away


def parse(html: str) -> Node:
    """A tree of the page; what is never closed, crossed or unknown is borne as browsers bear it."""
    top = Node("#top", None)
    path = [top]
    #: depths of the open elements of each name
    opened: dict[str, list[int]] = {}

    def last(names) -> int:
        return max((opened[x][-1] for x in names if opened.get(x)), default=0)

    #: open elements, from the top on, that are known to hold an article
    holds = 0

    def cut(depth: int) -> None:
        nonlocal holds
        while len(path) > depth:
            opened[path.pop().name].pop()
        holds = min(holds, depth)

    def close(names, stops=()) -> None:
        """End the innermost open element of these names, unless one of ``stops`` is open inside it."""
        depth = last(names)
        if depth and depth > last(stops):
            cut(depth)

    at, n, end = 0, len(html), html.rfind(">")
    while at < n:
        m = _TAG.search(html, at) if at <= end else None
        if m is None:
            # a tag that the page's end cuts off is no text
            path[-1].kids.append(re.split(r"<[A-Za-z/!?]", html[at:], maxsplit=1)[0])
            break
        if m.start() > at:
            path[-1].kids.append(html[at : m.start()])
        at = m.end()
        if m[0].startswith("<![CDATA["):
            path[-1].kids.append(m[0][9:-3].replace("&", "&amp;"))
            continue
        name = m[2] or m[5]
        if not name:
            continue
        name, ending, attributes = name.lower(), m[1] or m[4], m[3] or m[6] or ""
        if ending:
            if name == "p" or name not in _VOID:
                close((name,), ("table",) if name == "p" else ())
            elif name == "br":
                path[-1].kids.append(" ")
            continue
        if name in _ENDS_P:
            close(("p",), ("table", "td", "th", "button", "object"))
        if name in _SIBLINGS:
            close(*_SIBLINGS[name])
        if name in _HEADINGS and path[-1].name in _HEADINGS:
            cut(len(path) - 1)
        node = Node(name, path[-1], attributes)
        path[-1].kids.append(node)
        if name in ("article", "main"):
            # what holds an article is no side part, whatever its names say, nor a form to be filled in
            for up in path[holds:]:
                if up.hinted or up.name == "form":
                    up.away = up.hinted = False
            holds = len(path)
        if name in _RAW:
            stop = re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I).search(html, at)
            at = stop.end() if stop else n
        elif name not in _VOID:
            opened.setdefault(name, []).append(len(path))
            path.append(node)
    _clear(top)
    return top


def _walk(top: Node) -> list[Node]:
    """All elements, each before those inside it."""
    out, todo = [], [top]
    while todo:
        node = todo.pop()
        out.append(node)
        todo += [k for k in reversed(node.kids) if not isinstance(k, str)]
    return out


def _clear(top: Node) -> None:
    """A form, or a part whose names say that it stands aside, holds the article if it holds more than half of the text
    of the page's paragraphs; reader comments never do."""
    order = _walk(top)
    if not any(x.away and (x.name == "form" or x.hinted) for x in order):
        return
    inside: dict[int, bool] = {}
    for x in order:
        # text of a paragraph, and of no other part that is never article text
        out = x.name in _NEVER and x.name != "form" or x.readers
        inside[id(x)] = None if out or x.up is not None and inside[id(x.up)] is None else x.name == "p" or x.up is not None and inside[id(x.up)]
        if inside[id(x)]:
            x.p_n = sum(len(k.strip()) for k in x.kids if isinstance(k, str))
    for x in reversed(order):
        if x.up is not None:
            x.up.p_n += x.p_n
    for x in order:
        if x.away and not x.readers and (x.name == "form" or x.hinted) and x.p_n * 2 > top.p_n:
            x.away = x.hinted = False


def blocks(top: Node) -> Iterator[tuple[Node, str, int]]:
    """(block element, its text, characters of it inside links), in page order.  Text on both sides of a block that
    stands inside an element makes two blocks."""
    parts: list[str] = []
    linked: list[str] = []
    owner = top

    def cut() -> Iterator[tuple[Node, str, int]]:
        text = _SPACE.sub(" ", unescape("".join(parts))).strip(" ")
        if text:
            yield owner, text, len(_SPACE.sub(" ", unescape("".join(linked))))
        parts.clear()
        linked.clear()

    #: (node, next kid, inside a link)
    stack: list[list] = [[top, 0, False]]
    while stack:
        frame = stack[-1]
        node, k, link = frame
        if k == len(node.kids):
            stack.pop()
            if node.block is node:
                yield from cut()
                owner = (node.up or top).block
            continue
        frame[1] += 1
        kid = node.kids[k]
        if isinstance(kid, str):
            parts.append(kid)
            if link:
                linked.append(kid)
        elif kid.away:
            if kid.block is kid and kid.name not in ("script", "style", "noscript", "template"):
                yield from cut()
        elif kid.name in ("br", "hr") or kid.name in _VOID:
            parts.append(" ")
        else:
            if kid.block is kid:
                yield from cut()
                owner = kid
            stack.append([kid, 0, link or kid.name == "a"])


def points(node: Node, text: str, link: int) -> float:
    """Of a paragraph: one, one for each comma, and up to three for its length; links count against it, headings and
    parts that may stand aside count less."""
    got = (1 + text.count(",") + text.count("，") + min(3, len(text) / 100)) * (1 - min(1, link / len(text)))
    return got * (0.2 if node.name in _HEADINGS else 1) * (0.5 if node.doubt else 1)


def _complete(row: list[Node]) -> None:
    """What stands between kept siblings is part of the article, unless links fill half of it or its names say otherwise;
    so are lists, tables and quotes with few links next to the kept ones, and headings right before what is kept."""
    few = lambda kid, most: not kid.doubt and kid.link_n < most * kid.text_n
    insert = lambda k: 0 <= k < len(row) and row[k].name in _INSERTS and few(row[k], 0.25)
    heading = lambda k: 0 <= k < len(row) and row[k].name in _HEADINGS and few(row[k], 0.25)
    kept = [k for k, kid in enumerate(row) if kid.keep]
    first, last = kept[0], kept[-1]
    for kid in row[first:last]:
        kid.keep = kid.keep or few(kid, 0.5)
    while insert(first - 1) or heading(first - 1):
        first -= 1
        row[first].keep = True
    while insert(last + 1) or heading(last + 1) and insert(last + 2):
        last += 1
        row[last].keep = True


def extract(html: str | None) -> str:
    """The main text; empty where the page is null, empty or has none."""
    if not html:
        return ""
    top = parse(html)
    found = list(blocks(top))
    if not found:
        return ""
    scored: list[Node] = []
    for node, text, link in found:
        node.text_n += len(text)
        node.link_n += min(link, len(text))
        node.ends = text[-1] in _ENDS
        up, share, got = node if node.name in _CONTAINERS else node.up or node, 1.0, points(node, text, link)
        while up is not None and share > 0.03:
            if not up.score:
                up.score = 1.0 if up.body else 0.01
                scored.append(up)
            up.score += got * share * (0.9 if up.name in ("body", "html", "#top") else 1) * (0.5 if up.doubt else 1)
            share *= 0.5 if share == 1 else 0.4
            up = up.up
    order = _walk(top)
    for x in reversed(order):
        if x.up is not None:
            x.up.text_n += x.text_n
            x.up.link_n += x.link_n
    worth = lambda x: x.score * (1 - x.link_n / max(1, x.text_n))
    best = max(scored, key=worth)
    # an article whose best part is only one of its parts is taken as a whole
    up = best
    while up is not None:
        if up.name in ("article", "main") and up.up is not None:
            best = up
            break
        up = up.up
    best.keep = True
    if best.up is not None:
        enough = max(2.0, 0.2 * worth(best))
        for kid in best.up.kids:
            if isinstance(kid, Node) and not kid.away and kid is not best and kid.text_n:
                density = kid.link_n / kid.text_n
                alike = worth(kid) >= enough and density < 0.5 and (kid.name == best.name or kid.body)
                # a paragraph beside it: one of some length with few links, or a short one that is a sentence
                kid.keep = alike or kid.name == "p" and (density < 0.25 if kid.text_n >= 80 else density == 0 and kid.ends)
        _complete([kid for kid in best.up.kids if isinstance(kid, Node) and not kid.away and kid.text_n])
    for x in order:
        x.keep = x.keep or x.up is not None and x.up.keep
    return "\n".join(text for node, text, _ in found if node.keep)


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of ``pages``: page_id, url, text, n_chars (code points); other columns are dropped.

    Null, empty and text-free pages give the empty text.  Repeated rows are extracted each; an empty table gives no
    rows.  Pages of any length and depth are parsed whole, without recursion, in time that grows as they do.  Rows are
    independent: no shuffle, and memory for one page's tree.
    """

    def extracted(html: pd.Series) -> pd.Series:
        return html.map(extract)

    small_batches(pages.sparkSession)
    text = F.pandas_udf(extracted, "string")(F.col(html_col))
    return pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), text.alias("text")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
