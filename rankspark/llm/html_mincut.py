"""Main-text extraction by minimum-cut labelling (operator 6).

A page becomes a list of text blocks. A linear classifier scores every block from its ancestors,
class names, link share and prose shape; the score is the capacity of its edge to the content or
boilerplate terminal. Neighbouring blocks, and blocks that follow each other under one parent, are
joined by smoothness edges that weaken with their distance in the DOM. The minimum cut, found by
maximum flow, is the labelling; blocks whose terminal outweighs all their edges are settled first,
which leaves small graphs.
"""

from __future__ import annotations

import re
from collections import deque

import pyarrow as pa
from pyspark.sql import DataFrame

from rankspark.llm.common import bounded

#: Element classes of HTML. RAW_TEXT holds no markup, only its own end tag; HIDDEN
#: holds markup whose text is left out.
RAW_TEXT = frozenset("script style noscript textarea title iframe noembed noframes xmp".split())
HIDDEN = frozenset("template svg math select option button object canvas audio video".split())
#: Hidden elements that a start tag of the same name closes, and start tags that close a select.
RENEWED = frozenset("select option button".split())
CLOSES_SELECT = frozenset("input keygen textarea".split())
#: Start tags that end an svg or math element, unless one of the elements INTEGRATION is open in it.
BREAKOUT = frozenset("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split())
INTEGRATION = frozenset("foreignobject desc title mi mo mn ms mtext annotation-xml".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rt rp s samp small span strike strong sub sup time tt u var".split())
#: Names that speak for content or boilerplate, as element, role, or part of a class or id.
GOOD_ELEMENTS = {"article": 6.0, "main": 4.0}
BAD_ELEMENTS = {"nav": 9.0, "footer": 9.0, "aside": 9.0, "form": 9.0, "menu": 9.0, "dialog": 9.0, "header": 5.0}
BAD_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar tablist toolbar".split())
GOOD_ROLES = frozenset("main article".split())
BAD_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner banners breadcrumb breadcrumbs comment comments commentlist commenting consent cookie cookies "
    "disclaimer disqus footer gdpr header login masthead menu menus modal nav navbar navigation newsletter notice notices notification overlay pager pagination paywall popup "
    "promo promos promoted promotion recommended related reply replies respond review reviews share sharing sidebar signup skyscraper social sponsor sponsored sponsors subscribe "
    "subscription tags toolbar topbar widget widgets".split()
)
GOOD_NAMES = frozenset("article articlebody body content entry main maincontent post postbody prose story storybody text".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/<>]*+)((?:[^<>\"']|\"[^\"<]*+\"|'[^'<]*+')*+)>"
    r"|<(/?)([a-zA-Z][^\s/<>]*+)([^<>]*+)(?:>|\Z)",
    re.S,
)
_RAW_END = {x: re.compile(rf"</{x}(?=[\s/>])[^>]*+(?:>|\Z)", re.I) for x in RAW_TEXT}
_ATTRIBUTE = re.compile(r"(class|id|role|hidden|aria-hidden|style|itemprop)(?![\w-])\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)
_HIDDEN_STYLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_SPACE = re.compile(r"\s+")


class Block:
    __slots__ = ("text", "linked", "path", "bias", "heading")

    def __init__(self, text, linked, path, bias, heading):
        self.text, self.linked, self.path, self.bias, self.heading = text, linked, path, bias, heading


def _element_bias(name: str, attributes: str, inside_good: bool) -> tuple[float, bool]:
    """What an element says about its text, and whether it opens a content region."""
    bias = 0.0
    if name in BAD_ELEMENTS:
        bias -= 0.5 if name == "header" and inside_good else BAD_ELEMENTS[name]
    good = name in GOOD_ELEMENTS
    if good:
        bias += GOOD_ELEMENTS[name]
    if attributes:
        for key, value in _ATTRIBUTE.findall(attributes):
            key, value = key.lower(), value.strip("\"'")
            if key in ("class", "id", "itemprop"):
                names = {x.lower() for x in _NAME.findall(value)} | {value.lower()}
                if names & BAD_NAMES:
                    bias -= 9.0
                elif names & GOOD_NAMES:
                    bias += 2.5
                    good = good or name in ("div", "section")
            elif key == "role":
                bias -= 9.0 if value.lower() in BAD_ROLES else 0.0
                bias += 4.0 if value.lower() in GOOD_ROLES else 0.0
            elif key == "hidden" or (key == "aria-hidden" and value.lower() == "true") or (key == "style" and _HIDDEN_STYLE.search(value)):
                bias -= 9.0
    return bias, good


def page_blocks(page: str) -> list[Block]:
    """The text blocks of a page in order, with character references decoded and white space
    as single spaces. Comments, scripts, styles and form controls hold no text.

    Left-out end tags are read as in HTML: a head ends where anything stands that cannot be in
    it; a hidden element also ends with an element around it, other than a template; in raw text
    only the matching end tag counts, and without one it goes on to the end of the page.
    """
    from html import unescape

    blocks: list[Block] = []
    stack: list[tuple[str, int, float, bool]] = []  # element, its number, bias so far, in a content region
    parts: list[str] = []
    linked = links = count = at = 0
    skip = ""  # the hidden element that is open
    inner: list[str] = []  # open elements in it

    def flush():
        nonlocal linked
        text = _SPACE.sub(" ", "".join(parts)).strip()
        if text:
            top = stack[-1] if stack else ("", 0, 0.0, False)
            blocks.append(Block(text, min(1.0, linked / len(text)), tuple(x[1] for x in stack), top[2], top[0][:1] == "h" and top[0][1:].isdigit()))
        parts.clear()
        linked = 0

    def say(raw: str):
        nonlocal linked
        text = unescape(raw) if "&" in raw else raw
        parts.append(text)
        if links:
            linked += len(text)

    while m := _TOKEN.search(page, at):
        if m.start() > at and not skip:
            say(page[at: m.start()])
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        closing = bool(m[1] or m[4])
        empty = (m[3] or m[6] or "").endswith("/")
        foreign = skip in ("svg", "math") and INTEGRATION.isdisjoint(inner)
        if skip and closing:
            if name in inner:
                while inner.pop() != name:
                    pass
                continue
            if name != skip and (skip == "template" or all(x[0] != name for x in stack)):
                continue
            own, skip = name == skip, ""
            if own:
                continue
        elif skip:
            if foreign and name in BREAKOUT or skip == "select" and name in CLOSES_SELECT:
                skip = ""
            elif name == skip and name in RENEWED:
                inner.clear()
                continue
            elif foreign or name not in RAW_TEXT:
                if name not in VOID and name not in INLINE and not (empty and foreign):
                    inner.append(name)
                continue
        if name in RAW_TEXT or name in HIDDEN or name == "head":
            # nothing in a head has text of its own, so what has text stands after it
            if not closing and not skip:
                parts.append(" ")
            if closing or empty or name == "head":
                continue
            if name in HIDDEN:
                skip = name
                inner.clear()
            else:
                end = _RAW_END[name].search(page, at)
                at = end.end() if end else len(page)
            continue
        if name == "br":
            parts.append(" ")
        elif name in VOID:
            if name == "hr":
                flush()
        elif name in INLINE:
            if name == "a":
                links = 0 if closing else 1
        elif closing:
            flush()
            links = 0
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    del stack[i:]
                    break
        else:
            flush()
            links = 0
            if stack and stack[-1][0] == "p" or stack and stack[-1][0] == name == "li":
                stack.pop()
            count += 1
            _, _, above, inside = stack[-1] if stack else ("", 0, 0.0, False)
            bias, good = _element_bias(name, m[3] or m[6] or "", inside)
            stack.append((name, count, above + bias, inside or good))
    if not skip and at < len(page):
        say(page[at:])
    flush()
    return blocks


def content_score(block: Block) -> float:
    """The classifier: positive for content. What the ancestors say, plus the shape of the text:
    long, punctuated, unlinked text is prose."""
    words = block.text.count(" ") + 1
    ends = sum(block.text.count(c) for c in ".!?;:,")
    score = block.bias - 1.0 - 4.0 * block.linked
    score += min(words, 40) / 10 + min(ends, 4) / 4
    if block.heading:
        score += 1.0
    if words < 4 and not ends:
        score -= 1.0
    return score


def smoothness(blocks: list[Block]) -> dict[tuple[int, int], float]:
    """Edges between neighbours and between successive blocks of one parent."""
    edges: dict[tuple[int, int], float] = {}
    latest: dict[tuple, int] = {}
    for i, block in enumerate(blocks):
        if i:
            a, b = blocks[i - 1].path, block.path
            common = 0
            while common < min(len(a), len(b)) and a[common] == b[common]:
                common += 1
            edges[i - 1, i] = 1.5 * 0.6 ** (len(a) + len(b) - 2 * common)
        parent = block.path[:-1]
        before = latest.get(parent)
        if before is not None:
            edges[before, i] = edges.get((before, i), 0.0) + 0.8
        latest[parent] = i
    return edges


def minimum_cut(scores: list[float], edges: dict[tuple[int, int], float]) -> list[bool]:
    """Labels that minimise the scores given up plus the edges cut; ties go to boilerplate."""
    unit = 1000
    terminal = [round(s * unit) for s in scores]
    around: list[dict[int, int]] = [{} for _ in scores]
    for (a, b), w in edges.items():
        w = round(w * unit)
        if w > 0:
            around[a][b] = around[b][a] = w
    label: list[bool | None] = [None] * len(scores)
    # persistency: a terminal that outweighs all edges decides, and then biases its neighbours
    ready = deque(range(len(scores)))
    while ready:
        i = ready.popleft()
        if label[i] is None and abs(terminal[i]) >= sum(around[i].values()):
            label[i] = terminal[i] > 0
            for j, w in around[i].items():
                terminal[j] += w if label[i] else -w
                del around[j][i]
                ready.append(j)
            around[i] = {}
    open_ = [i for i, x in enumerate(label) if x is None]
    if open_:
        for i in _source_side(open_, terminal, around):
            label[i] = True
    return [bool(x) for x in label]


def _source_side(nodes: list[int], terminal: list[int], around: list[dict[int, int]]) -> set[int]:
    """Maximum flow by shortest augmenting paths; the nodes that the source still reaches."""
    source, sink = -1, -2
    room: dict[int, dict[int, int]] = {i: dict(around[i]) for i in nodes}
    room[source], room[sink] = {}, {}
    for i in nodes:
        if terminal[i] > 0:
            room[source][i], room[i][source] = terminal[i], 0
        elif terminal[i] < 0:
            room[i][sink], room[sink][i] = -terminal[i], 0
    while True:
        came = {source: source}
        queue = deque([source])
        while queue and sink not in came:
            u = queue.popleft()
            for v, c in room[u].items():
                if c > 0 and v not in came:
                    came[v] = u
                    queue.append(v)
        if sink not in came:
            return set(came) - {source}
        path, v = [], sink
        while v != source:
            path.append((came[v], v))
            v = came[v]
        flow = min(room[u][v] for u, v in path)
        for u, v in path:
            room[u][v] -= flow
            room[v][u] = room[v].get(u, 0) + flow


def main_text(page: str | None) -> str:
    """The content blocks of a page joined by one space."""
    blocks = page_blocks(page or "")
    if not blocks:
        return ""
    keep = minimum_cut([content_score(b) for b in blocks], smoothness(blocks))
    return " ".join(b.text for b, k in zip(blocks, keep, strict=True) if k)


def _extract(batches):
    for b in bounded(batches, 2):
        texts = [main_text(x) for x in b.column(2).to_pylist()]
        yield pa.record_batch([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """Main text of every row of ``pages`` (page_id, url, html; other columns are ignored):
    page_id, url, text, n_chars (code points).

    Null or empty html, and pages without content blocks, give an empty text. Rows are worked on
    alone, so null ids and repeated rows pass through; no rows give no rows.
    """
    return pages.select("page_id", "url", "html").mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
