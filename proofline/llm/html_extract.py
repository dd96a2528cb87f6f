"""Main text of web pages by minimum-cut labelling.

A page becomes blocks of text in page order. A classifier over a block's surroundings and shape gives what it costs to
call the block content or boilerplate: the capacities to the two terminals. A block that is short beside the others of
its container speaks against itself there. Neighbours in page order are joined by edges that weaken with their distance
in the DOM, blocks of one parent by a further edge, and each block with the longest of its container; between containers
of different kind edges are weak. The minimum cut of that graph, by augmenting paths, is the cheapest labelling, so a
line that looks like boilerplate by itself stays in the article around it, and one that looks like prose goes with its
surroundings. The content side, in page order, is the main text.

Blocks inside scripts, styles, templates, forms' controls and other elements without prose are no candidates. Where such
an element is not closed, it ends with its parent or at the next block; only a script goes on to the page's end.

Defined cases: a null or empty page, or one without text, gives an empty text; unclosed and stray tags are tolerated;
character references are decoded once; white space inside a block becomes one space, blocks are joined by one space;
repeated rows are extracted one by one; an empty table gives an empty result; columns of the input that clash with
the results' are replaced.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterable, Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

_START = re.compile(r"<(?:(!--)|(!\[CDATA\[)|([!?])|(/?)([a-zA-Z][a-zA-Z0-9:-]*))")
_STOP = re.compile(r"[\"'>]")
_ATTRIBUTE = re.compile(r"(class|id|role|hidden|aria-hidden|itemprop|style)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)
_SPACE = re.compile(r"[ \t\n\x0b\x0c\r]+")

#: Elements whose content is read to their end tag as text and never shown as prose.
_RAW = {"script", "style", "textarea", "title", "iframe", "noembed", "noframes", "xmp"}
#: Elements whose content is markup and never shown as prose.
_DROPPED = {"noscript", "template", "svg", "select", "button", "option", "canvas", "audio", "video"}
_ENDS = {tag: re.compile(rf"</{tag}\b[^>]*>", re.I) for tag in _RAW | _DROPPED}
_TURNS = {tag: re.compile(rf"<(/?){tag}\b", re.I) for tag in _RAW | _DROPPED}
#: Dropped elements that may hold their like.
_NESTED = {"template", "svg"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: Elements that do not interrupt a block.
_INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "object", "math", "semantics", "annotation", "annotation-xml", "merror", "mfrac", "mi", "mmultiscripts", "mn", "mo", "mover", "mpadded", "mphantom", "mprescripts", "mroot", "mrow", "ms", "mspace", "msqrt", "mstyle", "msub", "msubsup", "msup", "mtable", "mtd", "mtext", "mtr", "munder", "munderover"}
_CLOSES_P = {"p", "div", "article", "section", "aside", "nav", "header", "footer", "ul", "ol", "dl", "table", "form", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "hr", "main", "figure", "address", "fieldset", "details"}
_SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
_SCOPE = {"ul", "ol", "dl", "table", "article", "section", "div", "body", "main", "nav", "aside", "header", "footer", "form"}

#: The classifier: log-odds for content of what surrounds a block, learned by hand from how pages are marked up.
_TAG_ODDS = {"article": 3.0, "main": 2.5, "nav": -6.0, "footer": -6.0, "aside": -6.0, "form": -6.0, "header": -3.0, "menu": -6.0, "dialog": -5.0, "address": -0.5, "figcaption": 0.5, "blockquote": 0.5, "fieldset": -5.0}
_BAD_WORDS = r"(?:ads?|advert\w*|adverts?|sponsor\w*|promo\w*|banner\w*|cookies?|consent|gdpr|notices?|popups?|modal|overlay|nav\w*|menu\w*|breadcrumbs?|footer\w*|site-?header|masthead|side-?bar\w*|widgets?|related\w*|recommend\w*|share\w*|sharing|social\w*|comments?\w*|disqus|respon[ds]\w*|replies|reply|subscribe|newsletter|sign-?up|login|log-?in|search\w*|pagination|pager|toolbar|copyright|legal|disclaimer|skip\w*|tags?|tagcloud|meta)"
_BAD_WORD = re.compile(rf"(?:^|[\s_-]){_BAD_WORDS}(?:$|[\s_-])", re.I)
#: Words that do not make more than boilerplate of a boilerplate word.
_BOX_WORDS = r"(?:areas?|articles?|bars?|block|box|buttons?|container|content|form|icons?|inner|items?|links?|lists?|outer|posts?|section|thread|wrap|wrapper|\d+)"
_BOILERPLATE = re.compile(rf"{_BAD_WORDS}|{_BOX_WORDS}", re.I)
_PARTED = re.compile(r"\b(site|side|sign|log|skip)[-_](header|bar\w*|up|in|to)", re.I)
_GOOD_WORD = re.compile(r"(?:^|[\s_-])(?:article\w*|post|entry\w*|content|main\w*|body|story\w*|text|blog\w*|articlebody|post-?body|prose)(?:$|[\s_-])", re.I)
_ROLES = {"navigation": -6.0, "banner": -4.0, "contentinfo": -6.0, "complementary": -6.0, "search": -6.0, "form": -6.0, "dialog": -5.0, "alert": -4.0, "main": 2.5, "article": 3.0}
_PROSE = {"p", "h1", "h2", "h3", "h4", "h5", "h6"}
_BAD, _GOOD, _HIDDEN = -6.0, 1.5, -8.0
#: What evidence for content counts, of that against it; evidence that makes an element a container of its own.
_POSITIVE, _CONTAINER = 0.5, 1.0
#: A block that is shorter than this share of its container's median, and what that counts.
_SHORT_SHARE, _SHORT = 0.25, -2.3
#: Costs of parting two blocks: neighbours in page order, by shared parent, and from the longest of their container.
_NEIGHBOUR, _SIBLING, _ANCHOR = 0.9, 0.5, 0.6
#: What is left of these between containers, and the DOM distance beyond which neighbours are not joined.
_ACROSS, _FAR = 0.1, 6


class Block:
    """A run of text between block boundaries, with its element and the log-odds of the element's path.

    Elements are (parent, depth, number) of the DOM; ``container`` is the number of the innermost element that tells
    content from boilerplate.
    """

    __slots__ = ("container", "doubt", "element", "linked", "odds", "parent", "tag", "text")

    def __init__(self, text: str, linked: int, tag: str, element: tuple, odds: float, doubt: float, container: int):
        self.text, self.linked, self.tag, self.element, self.odds, self.doubt, self.container = text, linked, tag, element, odds, doubt, container
        self.parent = element[0][2] if element[0] else 0


def _distance(a: tuple, b: tuple) -> int:
    """Elements between two and their lowest common ancestor, 0 for siblings; at most about ``_FAR``."""
    steps = 0
    while a[2] != b[2] and steps <= _FAR + 2:
        if a[1] >= b[1]:
            a = a[0]
        else:
            b = b[0]
        steps += 1
    return max(0, steps - 2)


class _Tags:
    """Reads tags from left to right in linear time: a quote without its like closes nothing."""

    def __init__(self, html: str):
        self.html = html
        self.done: set[str] = set()

    def _find(self, what: str, at: int) -> int:
        if what in self.done:
            return -1
        found = self.html.find(what, at)
        if found < 0:
            self.done.add(what)
        return found

    def next(self, at: int) -> tuple[int, int, str, str | None, str] | None:
        """(start, end, slash, name, attributes) of the next tag, or name None for comments and declarations."""
        html = self.html
        while True:
            m = _START.search(html, at)
            if m is None:
                return None
            if m[1] or m[2]:
                end = "-->" if m[1] else "]]>"
                stop = self._find(end, m.end())
                return m.start(), len(html) if stop < 0 else stop + 3, "", None, ""
            stop = self._find(">", m.end()) if m[3] else self._attributes(m.end())
            if stop >= 0:
                return m.start(), stop + 1, m[4] or "", m[5], "" if m[3] else html[m.end() : stop]
            if ">" in self.done:
                return None
            at = m.end()

    def _attributes(self, at: int) -> int:
        while True:
            m = _STOP.search(self.html, at) if ">" not in self.done else None
            if m is None:
                self.done.add(">")
                return -1
            if m[0] == ">":
                return m.start()
            close = self._find(m[0], m.end())
            at = m.end() if close < 0 else close + 1


def _only_boilerplate(value: str) -> bool:
    """Whether a value, or one of the words between its spaces, has boilerplate words and nothing but such."""
    for name in value.split():
        words = [w for w in re.split(r"[_-]+", _PARTED.sub(r"\1\2", name)) if w]
        if _BAD_WORD.search(" ".join(words)) and all(_BOILERPLATE.fullmatch(w) for w in words):
            return True
    return False


def _element_odds(tag: str, attributes: str, inside: bool) -> tuple[float, float]:
    """Log-odds that one element adds for what it holds, and those it adds for links only.

    ``inside``: an article or main element is open. There, ids are often made from headings, so one boilerplate word
    counts for links only: an id counts in full when it is all boilerplate, and never on a heading or paragraph; the
    classes of headings, paragraphs and sections likewise count in full when one is all boilerplate.
    """
    odds, doubt = _TAG_ODDS.get(tag, 0.0), 0.0
    if tag == "header" and inside:
        odds = 0.0  # an article's own head
    if not attributes.strip("/ \n\t"):
        return (odds * _POSITIVE if odds > 0 else odds), doubt
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name in ("class", "id", "itemprop"):
            if tag in ("body", "html"):
                continue
            if _BAD_WORD.search(value):
                prose = tag in _PROSE
                if not inside or not (prose or tag == "section" or name == "id") or (not (prose and name == "id") and _only_boilerplate(value)):
                    odds += _BAD
                else:
                    doubt += _BAD
            elif _GOOD_WORD.search(value):
                odds += _GOOD
        elif name == "role":
            odds += _ROLES.get(value.lower(), 0.0)
        elif name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I)):
            odds += _HIDDEN
    return (odds * _POSITIVE if odds > 0 else odds), doubt


def blocks(html: str) -> list[Block]:
    """The text blocks of a page in page order."""
    found: list[Block] = []
    stack: list[tuple] = [("", 0, 0.0, 0.0, (None, 0, 0), 0)]  # open block elements: name, number, log-odds of the path, element, container
    tags = _Tags(html)
    parts: list[str] = []
    linked, in_link, number, at, size, inside = 0, 0, 0, 0, len(html), 0
    drop, loose = 0, False  # the place of the outermost dropped element in the stack, and whether the next block ends it
    live, open_inline, last_end = {0}, {}, {}  # numbers in the stack; of each inline element's block; places of last end tags

    def flush() -> None:
        nonlocal linked
        if parts:
            text = _SPACE.sub(" ", unescape("".join(parts))).strip(" ")
            if text:
                name, _, odds, doubt, element, container = stack[drop - 1 if drop else -1]
                found.append(Block(text, linked, name, element, odds, doubt, container))
            parts.clear()
        linked = 0

    def close(k: int) -> None:
        nonlocal inside, drop
        inside -= sum(1 for x in stack[k:] if x[0] in ("article", "main"))
        live.difference_update(x[1] for x in stack[k:])
        del stack[k:]
        if drop >= k:
            drop = 0

    def push(tag: str, odds: float, doubt: float) -> None:
        nonlocal number, inside
        number += 1
        live.add(number)
        above = stack[-1]
        element = (above[4], above[4][1] + 1, number)
        stack.append((tag, number, above[2] + odds, above[3] + doubt, element, number if abs(odds) >= _CONTAINER else above[5]))
        inside += tag in ("article", "main")

    def unclosed(tag: str) -> bool:
        """No end tag follows, or none before the next such element, which can't be inside."""
        if tag not in last_end:
            last_end[tag] = max((m.start() for m in _ENDS[tag].finditer(html)), default=-1)
        if at > last_end[tag]:
            return True
        return tag not in _NESTED and tag not in ("script", "style") and not _TURNS[tag].search(html, at)[1]

    def words(text: str) -> None:
        nonlocal linked
        if text and not drop:
            parts.append(text)
            if in_link:
                linked += len(text)

    while at < size:
        read = tags.next(at)
        if read is None:
            words(html[at:])
            break
        start, end, slash, tag, attributes = read
        words(html[at:start])
        at = end
        if tag is None:
            continue
        tag = tag.lower()
        if not slash:
            shut = attributes.rstrip().endswith("/")
            if shut and (tag == "svg" or (drop and stack[drop][0] == "svg")):
                continue
            open_ = (tag in _RAW or tag in _DROPPED) and unclosed(tag)
            if tag in _RAW and (not open_ or tag == "script"):
                at = size if open_ else _ENDS[tag].search(html, at).end()
                continue
            if drop and (stack[drop][0] == tag and tag not in _NESTED or loose and tag not in _INLINE and tag not in _VOID and tag not in _DROPPED and tag != "optgroup"):
                close(drop)
            if tag in _RAW or tag in _DROPPED or drop:
                if tag in _INLINE:
                    open_inline.setdefault(tag, []).append(stack[-1][1])
                elif tag not in _VOID:
                    push(tag, 0.0, 0.0)
                    if not drop:
                        drop, loose = len(stack) - 1, open_ or tag in ("option", "select")
                continue
            if tag == "br":
                parts.append(" ")
            elif tag == "a":
                in_link = 1
            if tag in _INLINE or tag in ("br", "img", "input", "wbr"):
                if tag in _INLINE and tag not in _VOID:
                    open_inline.setdefault(tag, []).append(stack[-1][1])
                continue
            flush()
            if tag in _VOID:
                continue
            if tag in _CLOSES_P:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] == "p":
                        close(k)
                        break
                    if stack[k][0] in _SCOPE:
                        break
            if tag in _SAME:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] in _SAME[tag]:
                        close(k)
                        break
                    if stack[k][0] in _SCOPE:
                        break
            push(tag, *_element_odds(tag, attributes, inside > 0))
        elif tag in _INLINE:
            began = open_inline.get(tag, [])
            while began and began[-1] not in live:
                began.pop()
            if began and began.pop() < stack[drop][1] and drop:
                close(drop)  # the inline parent's end
            if tag == "a" and not drop:
                in_link = 0
        elif tag not in _VOID:
            if not drop and tag not in _DROPPED:
                flush()
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == tag:
                    if drop > k:
                        flush()
                    close(k)
                    break
                if tag == "p" and stack[k][0] in _SCOPE:
                    break
    flush()
    return found


def _costs(found: list[Block]) -> list[float]:
    """Log-odds that each block is content: its surroundings, then its own shape, also beside its container's others."""
    sizes: dict[int, list[int]] = {}
    for block in found:
        sizes.setdefault(block.container, []).append(len(block.text))
    middle = {container: sorted(n)[len(n) // 2] for container, n in sizes.items()}
    odds = []
    for block in found:
        n = len(block.text)
        own = block.odds + (0.8 if n >= 80 else 0.3 if n >= 25 else 0.0) + (block.doubt - 2.2) * (block.linked > 0.6 * n)
        if block.tag in ("p", "h1", "h2", "h3", "h4", "pre", "blockquote"):
            own += 0.7
        odds.append(own + (_SHORT if n < _SHORT_SHARE * middle[block.container] else 0.0))
    return odds


def _edges(found: list[Block]) -> list[tuple[int, int, float]]:
    """Pairs of blocks with the cost of parting them."""
    edges, last, longest = [], {}, {}
    for i, block in enumerate(found):
        if block.container not in longest or len(block.text) > len(found[longest[block.container]].text):
            longest[block.container] = i
    for i, block in enumerate(found):
        if i:
            before = found[i - 1]
            far = _distance(before.element, block.element)
            if far <= _FAR:
                edges.append((i - 1, i, _NEIGHBOUR * 0.5**far * (1 if before.container == block.container else _ACROSS)))
        if block.parent in last:
            j = last[block.parent]
            edges.append((j, i, _SIBLING * (1 if found[j].container == block.container else _ACROSS)))
        last[block.parent] = i
        if longest[block.container] != i:
            edges.append((longest[block.container], i, _ANCHOR))
    return edges


def minimum_cut(odds: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes stay on the content side of the cheapest cut.

    A node with positive odds is tied to the content terminal with that capacity, one with negative odds to the other;
    edges hold both ways. Flow is pushed along all shortest augmenting paths of one length together, then of the next.
    """
    n = len(odds)
    source, sink = n, n + 1
    ends: list[int] = []  # of arc e; arc e ^ 1 goes back
    room: list[float] = []
    arcs: list[list[int]] = [[] for _ in range(n + 2)]

    def arc(x: int, y: int, there: float, back: float) -> None:
        arcs[x].append(len(ends))
        arcs[y].append(len(ends) + 1)
        ends.extend((y, x))
        room.extend((there, back))

    for i, w in enumerate(odds):
        if w > 0:
            arc(source, i, w, 0.0)
        elif w < 0:
            arc(i, sink, -w, 0.0)
    for x, y, w in edges:
        arc(x, y, w, w)
    while True:
        # distances from the source; without a way to the sink, what is reached is the content side
        level = [-1] * (n + 2)
        level[source] = 0
        queue = deque((source,))
        while queue:
            x = queue.popleft()
            for e in arcs[x]:
                if room[e] > 1e-9 and level[ends[e]] < 0:
                    level[ends[e]] = level[x] + 1
                    queue.append(ends[e])
        if level[sink] < 0:
            return [level[i] >= 0 for i in range(n)]
        # all shortest ways at once: an arc that leads nowhere is not looked at again
        looked, way, at = [0] * (n + 2), [], source
        while True:
            if at == sink:
                least = min(room[e] for e in way)
                for e in way:
                    room[e] -= least
                    room[e ^ 1] += least
                full = next(k for k, e in enumerate(way) if room[e] <= 1e-9)
                at = ends[way[full] ^ 1]
                del way[full:]
            further = arcs[at]
            while looked[at] < len(further):
                e = further[looked[at]]
                if room[e] > 1e-9 and level[ends[e]] == level[at] + 1:
                    break
                looked[at] += 1
            if looked[at] < len(further):
                way.append(e)
                at = ends[e]
            elif at == source:
                break
            else:
                at = ends[way.pop() ^ 1]
                looked[at] += 1


def labelled(found: list[Block]) -> list[bool]:
    """Content or not, for the blocks of a page.

    A block that would pay more at its terminal than for parting from all its neighbours is on its own side in every
    cheapest cut; what it pulls on its neighbours is added to their ties, and the flow runs over the rest.
    """
    odds, edges = _costs(found), _edges(found)
    if all(w > 0 for w in odds) or all(w <= 0 for w in odds):
        return [w > 0 for w in odds]
    around = [0.0] * len(odds)
    for a, b, w in edges:
        around[a] += w
        around[b] += w
    fixed = [w > 0 if abs(w) > around[i] else None for i, w in enumerate(odds)]
    if None not in fixed:
        return fixed
    free = [i for i, f in enumerate(fixed) if f is None]
    place = {i: k for k, i in enumerate(free)}
    own, inner = [odds[i] for i in free], []
    for a, b, w in edges:
        if a in place and b in place:
            inner.append((place[a], place[b], w))
        elif a in place or b in place:
            i, j = (a, b) if a in place else (b, a)
            own[place[i]] += w if fixed[j] else -w
    for i, kept in zip(free, minimum_cut(own, inner)):
        fixed[i] = kept
    return fixed


def main_text(html: str | None) -> str:
    """The main text of a page."""
    if not html:
        return ""
    found = blocks(html)
    return " ".join(b.text for b, kept in zip(found, labelled(found)) if kept)


def extracted(batches: Iterable[pa.RecordBatch], html: str = "html") -> Iterator[pa.RecordBatch]:
    """Batches whose html column becomes ``text`` and ``n_chars``."""
    for batch in batches:
        at = batch.schema.get_field_index(html)
        texts = [main_text(x.as_py()) for x in batch.column(at)]
        keep = [i for i, n in enumerate(batch.schema.names) if i != at and n.lower() not in ("text", "n_chars")]
        yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*(batch.schema.names[i] for i in keep), "text", "n_chars"])


def extract(pages: DataFrame, html: str = "html") -> DataFrame:
    """``pages`` with the main text and its number of code points in place of the html."""
    kept = [f for f in pages.schema.fields if f.name != html and f.name.lower() not in ("text", "n_chars")]
    return pages.mapInArrow(lambda it: extracted(it, html), T.StructType([*kept, T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())]))


def query(spark, sf_dir: str) -> DataFrame:
    """The main text of all pages."""
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
