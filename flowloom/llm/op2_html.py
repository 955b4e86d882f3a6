"""Main text of web pages by minimum-cut labelling of their blocks.

A page is cut into blocks of text at block-level tags. A small classifier turns length,
link share and the enclosing elements of a block into the costs of calling it content or
boilerplate; these are the capacities to the two terminals. Neighbouring blocks and blocks
under one parent are tied by smoothness edges, and the maximum flow between the terminals
gives the cheapest labelling of the whole page.

Tags are read from front to back, each character a bounded number of times. What is inside a script, a style
or another raw-text element ends at its own end tag only; a quote counts only where a value
begins; a tag that is never closed ends at the next ``<``. An element that is no text of the
page (a form control, say) and is left open ends with the element around it.

Defined results: a null or empty page, and a page without content, gives an empty text;
unclosed and stray tags are tolerated; repeated rows are treated alike; extra
columns are ignored; an empty table gives no rows. No block is cut short or dropped for its
number, and very long pages are read whole.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter, deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from flowloom.llm.arrow import map_batches

BLOCK_TAGS = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
    "header hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is no text of the page.
SKIPPED_TAGS = frozenset("script style noscript template textarea iframe svg math canvas object select datalist option button title audio video map xmp noembed noframes".split())
#: Those whose content is no markup.
RAW_TAGS = frozenset("script style textarea title iframe xmp noembed noframes".split())
#: Those that a block of the page cannot stand in.
CONTROL_TAGS = frozenset("select datalist option".split())
PARAGRAPH_ENDS = BLOCK_TAGS - {"br", "body", "html"}
#: Elements that hold one block; what holds them ties their texts together.
LEAF_TAGS = frozenset("p li dt dd td th pre blockquote figcaption summary".split())
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}

BOILER_TAGS = frozenset("nav footer aside menu dialog search".split())
BOILER_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar toolbar form".split())
BOILER_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsbygoogle sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs footer "
    "masthead sidebar sidenav aside widget cookie cookies consent gdpr notice popup modal overlay subscribe newsletter signup login share sharing social related "
    "recommended recommendations comment comments commentlist reply replies respond disqus pagination pager toolbar search form copyright legal skip".split()
)
#: A name with one of these speaks of a page's layout, not of what the element holds.
LAYOUT_WORDS = frozenset("with has no without is show wrap wrapper container layout site page grid row col column columns left right".split())
CONTENT_WORDS = frozenset("article content main post entry story body text".split())

#: Costs, in units of flow.
BOILER, ARTICLE, FORM, CONTENT_HINT, LINKS, SMOOTH, SIBLING = 48, 14, 14, 4, 9, 2, 1

#: A tag up to its end or the next ``<``. The groups give back nothing, so each character is looked at a bounded number of times.
_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/<>]*)((?>[^<>=]+|=\s*(?>"[^"]*"|'[^']*')?)*+)>?""")
_DECLARATION = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)", re.S)
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in RAW_TAGS}
_HINT = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_NAME = re.compile(r"[A-Z]?[a-z0-9]+|[A-Z]+")


class _Element:
    """An open element and what its blocks inherit."""

    __slots__ = ("tag", "number", "up", "boiler", "article", "form", "hint", "link")

    def __init__(self, tag: str, number: int, up: _Element | None):
        self.tag, self.number, self.up = tag, number, up.number if up else 0
        self.boiler, self.article, self.form, self.hint, self.link = (up.boiler, up.article, up.form, up.hint, up.link) if up else (0, False, False, False, False)


def _enter(tag: str, attributes: str, number: int, up: _Element) -> _Element:
    e = _Element(tag, number, up)
    words: set[str] = set()
    if attributes and tag not in ("html", "body"):
        for name, value in _HINT.findall(attributes):
            name, value = name.lower(), value.strip("\"'")
            if name in ("class", "id"):
                for each in value.split():
                    parts = [w.lower() for w in _NAME.findall(each)]
                    if not LAYOUT_WORDS.intersection(parts):
                        words.update(parts)
            elif name == "role" and value.lower() in BOILER_ROLES or name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and "display:none" in value.replace(" ", "").lower():
                e.boiler = 2
    if tag in ("article", "main"):
        # an outer wrapper's names say nothing about the article in it
        e.article, e.boiler = True, 2 if e.boiler == 2 else 1 if words & {"comment", "comments", "reply", "ad", "advert", "related", "promo"} else 0
    elif words & BOILER_WORDS:
        e.boiler = max(e.boiler, 1)
    elif words & CONTENT_WORDS:
        e.hint = True
    if tag in BOILER_TAGS or tag == "header" and not e.article:
        e.boiler = 2
    e.form, e.link = e.form or tag == "form", e.link or tag == "a"
    return e


class Block:
    """A run of text and what is known about its place."""

    __slots__ = ("text", "size", "linked", "parent", "element", "heading")

    def __init__(self, text: str, size: int, linked: int, element: _Element):
        self.text, self.size, self.linked, self.element = text, size, linked, element
        self.heading = len(element.tag) == 2 and element.tag[0] == "h"
        self.parent = element.up if self.heading or element.tag in LEAF_TAGS else element.number


def blocks(page: str) -> list[Block]:
    """The blocks of a page in order, white space folded and references decoded."""
    root = _Element("#root", 0, None)
    stack, out, pieces = [root], [], []
    size = linked = number = at = 0
    skipping, owner = "", root

    def close() -> None:
        nonlocal size, linked
        if pieces:
            text = " ".join(entities.unescape("".join(pieces)).split())
            if text:
                out.append(Block(text, size, linked, owner))
            pieces.clear()
        size = linked = 0

    def say(stop: int) -> None:
        nonlocal size, linked, owner
        if skipping or stop <= at:
            return
        if not pieces:
            owner = stack[-1]
        piece = page[at:stop]
        pieces.append(piece)
        size += len(piece)
        linked += len(piece) * stack[-1].link

    def drop(depth: int) -> None:
        for e in stack[depth:]:
            opened[e.tag] -= 1
        del stack[depth:]

    opened: Counter[str] = Counter()  # elements on the stack
    inner: dict[str, int] = {}  # what is open inside a skipped element
    look = 0
    while (start := page.find("<", look)) >= 0:
        m = _TAG.match(page, start)
        if m is None:
            d = _DECLARATION.match(page, start)
            look = d.end() if d else start + 1
            if d:  # anything else is text
                say(start)
                at = look
            continue
        tag, ends = m[2].lower(), bool(m[1])
        say(start)
        at = look = m.end()
        if skipping:
            if ends and inner.get(tag):
                inner[tag] -= 1
                continue
            if ends and tag == skipping:
                skipping = ""
                continue
            around = ends and opened[tag] > 0
            block = not ends and skipping in CONTROL_TAGS and (tag in BLOCK_TAGS or tag == skipping == "option") and tag not in ("hr", "legend")
            if not (around or block):
                if tag in RAW_TAGS and not ends and not m[3].endswith("/"):
                    at = look = _raw_end(page, tag, look)
                elif not ends and tag not in VOID_TAGS and tag != "option" and not m[3].endswith("/"):
                    inner[tag] = inner.get(tag, 0) + 1
                continue
            skipping = ""
        if tag in BLOCK_TAGS:
            close()
        if ends:
            if opened[tag]:
                drop(next(depth for depth in range(len(stack) - 1, 0, -1) if stack[depth].tag == tag))
        elif tag in SKIPPED_TAGS:
            if m[3].endswith("/"):
                continue
            if tag in RAW_TAGS:
                at = look = _raw_end(page, tag, look)
            else:
                skipping = tag
                inner.clear()
        elif tag not in VOID_TAGS:
            if tag in PARAGRAPH_ENDS and stack[-1].tag == "p":
                drop(len(stack) - 1)
            closes = CLOSED_BY.get(tag, frozenset())
            if any(opened[c] for c in closes):
                for depth in range(len(stack) - 1, 0, -1):
                    if stack[depth].tag in closes:
                        drop(depth)
                        break
                    if stack[depth].tag in ("ul", "ol", "dl", "table"):
                        break
            number += 1
            opened[tag] += 1
            stack.append(_enter(tag, m[3], number, stack[-1]))
    say(len(page))
    close()
    return out


def _raw_end(page: str, tag: str, at: int) -> int:
    """Where a raw-text element's end tag ends; an open title ends at the next tag, others with the page."""
    m = _RAW_END[tag].search(page, at)
    if m:
        stop = page.find(">", m.end())
        return stop + 1 if stop >= 0 else len(page)
    stop = page.find("<", at) if tag == "title" else -1
    return stop if stop >= 0 else len(page)


def costs(block: Block) -> tuple[int, int]:
    """``(cost of boilerplate, cost of content)`` of a block."""
    e = block.element
    content = min(8, (block.size // 8).bit_length())
    boiler = 1
    if e.article:
        content += ARTICLE
    if e.hint:
        content += CONTENT_HINT
    if block.heading:
        content += 2
    if e.boiler:
        boiler += BOILER if e.boiler == 2 else BOILER // 2 + 4
    if e.form:
        boiler += FORM
    if 2 * block.linked > block.size:
        boiler += LINKS
    return content, boiler


def minimum_cut(gain: list[int], edges: list[tuple[int, int, int]]) -> list[bool]:
    """Labels of least cost: node i pays ``gain[i]`` if it leaves the source side
    (``-gain[i]`` if it stays, where negative), an edge its weight if it is cut.

    Dinic's algorithm on the nodes; flow between a node's own two terminals is already
    cancelled out. True for the nodes that stay with the source; of equal cuts the one that
    keeps most nodes there.
    """
    n = len(gain)
    excess = [max(0, g) for g in gain]
    room = [max(0, -g) for g in gain]
    near: list[list[int]] = [[] for _ in range(n)]
    to, cap = [], []
    for a, b, w in edges:
        near[a].append(len(to))
        near[b].append(len(to) + 1)
        to += [b, a]
        cap += [w, w]
    while True:
        level = [0 if x else -1 for x in excess]
        queue = deque(i for i in range(n) if excess[i])
        goal = False
        while queue:
            i = queue.popleft()
            goal |= room[i] > 0
            for k in near[i]:
                if cap[k] and level[to[k]] < 0:
                    level[to[k]] = level[i] + 1
                    queue.append(to[k])
        if not goal:
            break
        turn = [0] * n
        for source in range(n):
            while excess[source]:
                path, i = [], source
                while not room[i]:
                    while turn[i] < len(near[i]):
                        k = near[i][turn[i]]
                        if cap[k] and level[to[k]] == level[i] + 1:
                            break
                        turn[i] += 1
                    else:
                        if not path:
                            break
                        k = path.pop()
                        i = to[k ^ 1]
                        turn[i] += 1
                        continue
                    path.append(k)
                    i = to[k]
                if not room[i]:
                    break
                push = min([excess[source], room[i], *(cap[k] for k in path)])
                excess[source] -= push
                room[i] -= push
                for k in path:
                    cap[k] -= push
                    cap[k ^ 1] += push
    lost = [x > 0 for x in room]
    queue = deque(i for i in range(n) if lost[i])
    while queue:
        for k in near[queue.popleft()]:
            if cap[k ^ 1] and not lost[to[k]]:
                lost[to[k]] = True
                queue.append(to[k])
    return [not x for x in lost]


def label(found: list[Block]) -> list[bool]:
    """Which blocks are content."""
    gain = [a - b for a, b in map(costs, found)]
    edges, last = [], {}
    for i, block in enumerate(found):
        if i:
            # neighbours under one parent hold together more than others
            edges.append((i - 1, i, SMOOTH + SIBLING if found[i - 1].parent == block.parent else SMOOTH))
        near = last.get(block.parent)
        if near is not None and near != i - 1:
            edges.append((near, i, SIBLING))
        last[block.parent] = i
    return minimum_cut(gain, edges)


def main_text(page: str | None) -> str:
    found = blocks(page or "")
    return " ".join(b.text for b, keep in zip(found, label(found)) if keep)


def _extract_batches(batches: Iterator[pa.RecordBatch], columns: list[str], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pages = batch.column("_html")
        for at in range(0, batch.num_rows, 1000):
            part = batch.slice(at, 1000)
            texts = [main_text(pages[at + i].as_py()) for i in range(part.num_rows)]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in columns), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], schema=schema)


def extract(pages: DataFrame, keep: tuple[str, ...] = ("page_id", "url"), html: str = "html") -> DataFrame:
    """``text`` and ``n_chars`` of each page, beside the columns in ``keep``."""
    rows = pages.select(*keep, F.col(html).alias("_html"))
    out = StructType([*(rows.schema[c] for c in keep)]).add("text", "string").add("n_chars", "long")
    return map_batches(rows, _extract_batches, out, list(keep))
