"""Main text of web pages by tree scoring.

Every paragraph earns points for its length and its commas and passes them to the elements around
it: all to the parent, half to the grandparent, less further up. A container's points are
discounted by the share of its text that lies in links. The best container is kept, with the whole
article around it if it is in one. Without an article, what stands beside it or beside a container
around it is kept too if it holds a paragraph or heading, however short, and is not mostly links.
What is never part of a text (menus, forms, scripts, notices and the like) is left out before
the scoring. A class or id that only sounds like one leaves out elements with little prose or mostly
links and without an article inside; one that is wholly such a name leaves out any but the page's text.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterable
from itertools import takewhile

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .texts import by_portion

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("iframe noembed noframes noscript script style template textarea title xmp".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
BLOCKS = HEADINGS | frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
PROSE = frozenset("p pre blockquote li dd td".split())
LINKED = 0.5  # share of links from which text is no part of the main text
PARAGRAPHS = frozenset("p pre td th li dd blockquote figcaption".split())
FLAT = PARAGRAPHS | HEADINGS  # blocks that hold no paragraphs
ARTICLES = frozenset(("article", "main"))
LEFT_OUT = RAW | frozenset(
    "annotation annotation-xml aside audio button canvas datalist dialog footer form head input label menu meter nav object option optgroup "
    "progress select svg video".split()
)
ROLES = frozenset(
    "alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split()
)
# Words in a class or id of what is no part of a text, unless it holds an article or much prose.
NEVER = frozenset(
    "ad ads adv advert adverts advertisement advertising adbox adsense banner breadcrumb breadcrumbs comment comments "
    "consent cookie cookies disqus footer gdpr masthead menu modal nav navbar navigation newsletter notice overlay pager "
    "pagination popup promo promoted promotion recommended related replies respond share sharing sidebar signup skip social "
    "sponsor sponsored subscribe toolbar widget".split()
)
# Labels that tell an element's layout: what follows in the label is inside or beside it.
LAYOUT = frozenset(("has", "no", "with", "without"))
LITTLE = 200  # characters outside links; an element with fewer is left out for one such word
# A new start tag closes an open element of these kinds, if no element of the second kind lies between.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "option": ({"option"}, {"select"}),
}
TOKEN = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|</([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)"
    r"|<([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(>|\Z)|<([a-zA-Z][^\s/>]*)([^>]*)(>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.S)
WORDS = re.compile(r"[A-Za-z][a-z]*|[A-Z]+(?![a-z])")
HIDDEN = re.compile(r"(?:display\s*:\s*none|visibility\s*:\s*hidden)", re.I)


IN, DOUBTED, NAMED, OUT = range(4)


class Element:
    __slots__ = ("commas", "length", "linked", "mark", "name", "out", "own", "parent", "points", "text")

    def __init__(self, name: str, parent: int, out: bool, mark: int = 0) -> None:
        self.name, self.parent, self.out, self.mark = name, parent, out, mark
        self.points = 0.0
        self.length = self.linked = self.own = self.text = self.commas = 0


def _mark(name: str, attributes: str, in_article: bool) -> int:
    """OUT if never part of a text, NAMED or DOUBTED if a whole label or a word of one says so."""
    if name in LEFT_OUT or (name == "header" and not in_article):
        return OUT
    if not attributes.strip() or name in ("html", "body"):
        return IN
    given = {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(attributes)}
    if "hidden" in given or HIDDEN.search(given.get("style", "")) or given.get("role", "").lower() in ROLES:
        return OUT
    if name in ARTICLES:
        return IN
    found = DOUBTED if given.get("aria-hidden") == "true" else IN
    whole_only = name in HEADINGS or name in ("p", "pre", "blockquote")
    labels = [(label, whole_only) for label in given.get("class", "").split()]
    if not whole_only:  # their ids are made from their words
        labels += [(label, name not in ("div", "span", "ul", "ol", "table")) for label in given.get("id", "").split()]
    for label, whole_label in labels:
        words = list(takewhile(lambda w: w not in LAYOUT, (w.lower() for w in WORDS.findall(label))))
        told = [w in NEVER or (w == "header" and not in_article) for w in words]
        if told and all(told):
            return NAMED
        if any(told) and not whole_label:
            found = DOUBTED
    return found


def _decide(elements: list[Element]) -> None:
    """Leave out the elements that a class or id marks, except what holds the text or much prose."""
    plain = [0 if e.out else e.length - e.linked for e in elements]  # characters outside links, below too
    linked = [0 if e.out else e.linked for e in elements]
    holds = [e.name in ARTICLES and not e.out for e in elements]
    below = [e.mark == NAMED for e in elements]  # in a named element, or one itself
    for i in range(1, len(elements)):
        below[i] = below[i] or below[elements[i].parent]
    apart = any(h and not b for h, b in zip(holds, below, strict=True))  # an article in no named element
    for i in range(len(elements) - 1, 0, -1):
        up = elements[i].parent
        plain[up] += plain[i]
        linked[up] += linked[i]
        holds[up] = holds[up] or holds[i]
    inside = [False] * len(elements)
    for i, e in enumerate(elements):
        inside[i] = e.name in ARTICLES or (e.parent >= 0 and inside[e.parent])
        if e.parent >= 0 and elements[e.parent].out:
            e.out = True
        elif e.mark == DOUBTED and not holds[i]:
            e.out = plain[i] < LITTLE or linked[i] > plain[i]
        elif e.mark == NAMED and (apart or not holds[i]):
            most = plain[i] >= LITTLE and plain[i] > plain[0] - plain[i] and linked[i] <= plain[i]
            e.out = not most or (apart and not inside[i])


def main_text(page: str) -> str:
    """The blocks of the main text, one to a line; empty if the page has none."""
    elements = [Element("#root", -1, False)]
    events: list[tuple[int, str | None]] = []  # text of an element, or None where a block begins or ends
    stack = [0]
    owners = [0]  # by place on the stack: the element that owns the text there
    depths: dict[str, list[int]] = {}  # places of the open elements of a name
    blocks: list[int] = []  # places of the open blocks
    containers: list[int] = []  # and of those that hold paragraphs
    articles = 0  # open articles
    links = 0
    at = 0
    length = len(page)

    def close(depth: int) -> None:
        nonlocal articles, links
        while len(stack) > depth:
            name = elements[stack.pop()].name
            owners.pop()
            depths[name].pop()
            if name in BLOCKS:
                blocks.pop()
                if name not in FLAT:
                    containers.pop()
            articles -= name in ARTICLES
            links -= name == "a"
            if name in BLOCKS:
                events.append((stack[-1], None))

    def nearest(names: Iterable[str]) -> int:
        """The place of the innermost open element of these names, 0 without one."""
        return max((depths[n][-1] for n in names if depths.get(n)), default=0)

    def add(text: str) -> None:
        if not text:
            return
        here = elements[stack[-1]]
        if here.out:
            return
        text = html.unescape(text) if "&" in text else text
        events.append((stack[-1], text))
        size = len(text.strip())
        if size:
            block = elements[owners[-1]]
            block.length += size
            block.commas += text.count(",")
            block.linked += size if links else 0

    while at < length:
        begin = page.find("<", at)
        if begin < 0:
            add(page[at:])
            break
        match = TOKEN.match(page, begin)
        if match is None:
            add(page[at : begin + 1])
            at = begin + 1
            continue
        add(page[at:begin])
        at = match.end()
        ended, name, attributes = match[1], match[2] or match[5], match[3] or match[6] or ""
        if ended:
            name = ended.lower()
            if name == "br":
                events.append((stack[-1], " "))
                continue
            depth = nearest([name])
            # An inline or paragraph end does not reach through a container.
            walls = blocks if name not in BLOCKS else containers if name in FLAT else []
            if depth and (not walls or depth >= walls[-1]):
                close(depth)
            continue
        if not name:
            continue
        name = name.lower()
        if name in BLOCKS and name not in ("html", "body"):
            if blocks and elements[stack[blocks[-1]]].name == "p":
                close(blocks[-1])
        if name in CLOSES:
            shut, walls = CLOSES[name]
            while (depth := nearest(shut)) > nearest(walls):
                close(depth)
                if name != "tr":
                    break
        if name in HEADINGS and elements[stack[-1]].name in HEADINGS:
            close(len(stack) - 1)
        if name in RAW:
            end = re.compile(rf"</{name}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(page, at)
            at = end.end() if end else length
            continue
        if name in VOID:
            if name in BLOCKS:
                events.append((stack[-1], None))
            elif name == "br":
                events.append((stack[-1], " "))
            continue
        if name in BLOCKS:
            events.append((stack[-1], None))
        mark = _mark(name, attributes, articles > 0)
        elements.append(Element(name, stack[-1], elements[stack[-1]].out or mark == OUT, mark))
        if attributes.endswith("/") and name not in BLOCKS:
            continue
        stack.append(len(elements) - 1)
        owners.append(len(elements) - 1 if name in BLOCKS or mark else owners[-1])
        depths.setdefault(name, []).append(len(stack) - 1)
        if name in BLOCKS:
            blocks.append(len(stack) - 1)
            if name not in FLAT:
                containers.append(len(stack) - 1)
        articles += name in ARTICLES
        links += name == "a"

    _decide(elements)
    _pass_points(elements)
    kept = _kept(elements)
    return "\n".join(_blocks(events, kept))


def _pass_points(elements: list[Element]) -> None:
    around = [-1] * len(elements)  # the next block on the way up, through any inline elements
    for i, element in enumerate(elements):
        up = element.parent
        around[i] = up if up <= 0 or elements[up].name in BLOCKS else around[up]
        element.own = element.linked  # before the links of what is inside join it
        if not element.length or element.out or element.name in HEADINGS:
            continue
        points = 1 + element.commas + min(element.length / 100, 3.0)
        points *= 1 - element.linked / element.length
        up, share = around[i], 1
        if element.name not in PARAGRAPHS:  # a container with text of its own
            element.points += points
            share = 2
        level = 0
        while up >= 0 and level < 5:
            elements[up].points += points / share
            up = around[up]
            level += 1
            share = 2 if share == 1 else 3 * (level + 1)
    for i in range(len(elements) - 1, 0, -1):  # text of whole subtrees; parents stand first
        element = elements[i]
        if not element.out:
            element.text += element.length
            elements[element.parent].text += element.text
            elements[element.parent].linked += element.linked
    elements[0].text += elements[0].length


def _kept(elements: list[Element]) -> list[bool]:
    """Whether the text right inside each element belongs to the main text."""
    best, most = -1, 0.0
    for i, e in enumerate(elements):
        if e.out or not e.text or e.name in FLAT or (e.name not in BLOCKS and i):
            continue
        score = e.points * (1 - e.linked / e.text)
        if score > most:
            best, most = i, score
    if best < 0:
        return [False] * len(elements)
    up = best
    while up >= 0:
        if elements[up].name in ARTICLES:
            best = up
            break
        up = elements[up].parent
    prose = [e.name in PROSE | HEADINGS and e.text > 2 * e.linked for e in elements]  # in the element or below
    for i in range(len(elements) - 1, 0, -1):
        if prose[i] and not elements[i].out:
            prose[elements[i].parent] = True
    level = {}  # the way up from the best container: the next element down, by element
    up = best
    while up > 0:
        level[elements[up].parent] = up
        up = elements[up].parent
    marked = elements[best].name in ARTICLES
    inside = [False] * len(elements)  # an article
    for i, e in enumerate(elements):
        inside[i] = e.name in ARTICLES or (e.parent >= 0 and inside[e.parent])
    chosen = {best}
    climbed = set()
    for i, e in enumerate(elements):
        if e.parent not in level or level[e.parent] == i or e.out or not e.text:
            continue
        density = e.linked / e.text
        near = e.parent == elements[best].parent
        if marked and not inside[e.parent]:
            # Beside an article stands little of it.
            like = e.points * (1 - density) >= max(10.0, 0.2 * most)
            part = e.name in PARAGRAPHS and density < 0.25 and e.text > 80
            good = near and (like or part or (e.name in ARTICLES and density < LINKED))
        else:
            good = density < LINKED and (prose[i] or e.points * (1 - density) >= 0.2 * most)
        if good or (near and e.name == "h1" and i < best):
            chosen.add(i)
            if good and (not marked or inside[e.parent]):
                climbed.add(e.parent)
    kept = [False] * len(elements)
    for i, e in enumerate(elements):
        if e.out:
            continue
        if i in level and i != best:  # a container around: its own words, if it holds several parts
            kept[i] = i in climbed and e.length > 0 and e.own < LINKED * e.length
        elif e.parent in level and e.text and i not in chosen:
            kept[i] = False
        else:
            kept[i] = i in chosen or (e.parent >= 0 and kept[e.parent])
    return kept


def _blocks(events: list[tuple[int, str | None]], kept: list[bool]) -> list[str]:
    out: list[str] = []
    parts: list[str] = []
    for element, text in events:
        if text is None:
            line = " ".join("".join(parts).split())
            if line:
                out.append(line)
            parts = []
        elif kept[element]:
            parts.append(text)
    line = " ".join("".join(parts).split())
    return [*out, line] if line else out


def page_texts(df: DataFrame, page: str, keep: list[str]) -> DataFrame:
    """``keep`` with ``text``, the main text of each whole page, and ``n_chars``, its code points.

    Blocks (headings, paragraphs, list items, table cells) are in page order, one to a line; white
    space inside a block is one space and character references are decoded. A page that is null, empty
    or without any text has the empty text. Pages that break off anywhere are read to their end.
    Repeated rows keep their rows, other columns are ignored, an empty table gives an empty one.
    """

    def made(pages: list[str]) -> dict[str, pa.Array]:
        return {"text": pa.array([main_text(p) for p in pages], pa.string())}

    return by_portion(df, page, made, "text string", keep).withColumn("n_chars", F.length("text").cast("long"))
