"""Main text of HTML pages by minimum-cut labelling.

A page is read into text blocks (runs of text between block-level tags) below their open elements.
A log-linear classifier gives each block the cost of either label from link share, length and
punctuation, and from what its ancestors' tags and names say; these are terminal capacities.  Weights are
set by hand, as no table has labelled blocks.  Neighbouring
blocks, and blocks and elements that are parent and child in the DOM, are tied by smoothness edges.
The minimum cut, found by max-flow, separates content from boilerplate.

Edge cases: null or empty html gives an empty text; broken or cut markup is read as far as it goes
(an unfinished tag is markup, an unfinished character reference is text); pages are read whole;
repeated rows are read each.  Reading takes linear time; deep or stray markup makes no difference.
"""

from __future__ import annotations

import re
from collections import deque
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^<>"']|"[^"]*"|'[^']*')*+)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)""", re.S)
NAMES = re.compile(r"""(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

# fixed values: HTML elements by how they lay out or hold text
RAW = {"script", "style", "textarea", "title", "iframe", "noscript", "xmp", "noembed", "noframes"}
HIDDEN = {"head", "template", "svg", "math", "select", "button", "object", "audio", "video", "canvas", "datalist"}
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
LEVELS = ("h1", "h2", "h3", "h4", "h5", "h6")
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
CLOSES = {
    "p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"},
    "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"},
    **{t: {"p"} for t in "address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol pre section table ul".split()},
}
#: What may stand in a head whose end tag is missing, and what ends an open select, datalist or button.
IN_HEAD = {"base", "link", "meta", "noscript", "script", "style", "template", "title"}
ENDS_SELECT = set("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header main nav ol p pre section table ul".split())
ENDS_BUTTON = ENDS_SELECT - {"div"}
#: Elements that implied closing doesn't look beyond.
SCOPE = set("article aside body div footer form header html main nav ol section table td th ul dl".split())

#: Elements that an opening tag may close.
CLOSABLE = set().union(*CLOSES.values())

# fixed values: what names of elements say
LAYOUT = set("area block body box col column container content count grid group holder inner item items layout list outer page panel region row section text wrap wrapper".split())
MODIFIERS = set("disable enable has hide is no not show toggle with without".split())
TAXONOMY = set("cat category format status tag tags type".split())
APART = set(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies discussion disqus footer gdpr header masthead modal nav navbar navigation newsletter notice "
    "notices popup promo promoted promotion recommended related replies reply respond sidebar signup sponsor sponsored subscribe teaser toolbar warning widget".split()
)
ASIDE = set("alert bar byline form login menu meta pager pagination search share sharing skip social tag tags".split())
GOOD = set("article entry main post story".split())
#: Of these, names that hold whatever the text is.
SURE = set("ad ads advert adverts advertisement advertising breadcrumb breadcrumbs comment comments consent cookie cookies disqus gdpr modal nav navbar navigation popup replies reply respond sidebar".split())
#: Names that speak of a list of links only alone or before one of the second set ("related-posts", not "related-work").
LISTED, LISTS = {"related", "recommended"}, set("articles items links news pages posts products reading stories topics videos".split())
#: Headings of what isn't the article: reader comments, link lists, notes on the site.
HEADING = re.compile(
    r"(\d+|no|one|two|three)?\s*(reader )?(comments?|responses|replies|thoughts|reviews)( \(\d+\))?( on .*| so far)?|leave a (reply|comment)|join the (discussion|conversation)|post a comment"
    r"|about (us|me|the (author|site|blog))|(related|recommended|popular|recent|latest|more|similar|top) (posts|articles|stories|news|links|reading|topics)|(you may|you might) also like.*"
    r"|(share|follow|connect|contact|subscribe|newsletter|advertisement|sponsored|tags|categories|archives?|navigation|menu|search|blogroll|sitemap)( this| us| me| with us| now| by)?", re.I)  # fmt: skip
#: Words that make a block prose, and the link share that it may have.
PROSE_WORDS, PROSE_LINKS = 12, 0.3
#: Prose of an element whose name is set aside: so many words, and so many times what is kept otherwise.
PARDON_WORDS, PARDON_TIMES = 40, 4

# the classifier: weights of log-odds for content
TAGS = {"nav": -12.0, "footer": -12.0, "aside": -12.0, "form": -12.0, "menu": -12.0, "dialog": -12.0, "header": -6.0, "article": 3.0, "main": 2.0}
NAME_SURE, NAME_APART, NAME_ASIDE, NAME_GOOD = -8.0, -7.0, -2.0, 1.5
BIAS, PER_LOG_WORD, LINKS, SENTENCE, RIGHTS, MOST = -2.0, 1.2, -6.0, 1.0, -3.0, 5.0
# smoothness: neighbours on the page, neighbours in one element, parent and child in the DOM
ADJACENT, SIBLING, CHILD = 0.3, 0.9, 0.7


def name_odds(attributes: str) -> tuple[float, float]:
    """(least, greatest) evidence of an element's class, id and role names.

    A name counts by its first word and by its last that isn't a word of layout; names with words
    like "no" or "has" say what the element lacks or holds, and "tags-travel" what the page is about.
    """
    low, high = 0.0, 0.0
    for m in NAMES.finditer(attributes):
        for name in (m[1] or m[2] or m[3] or "").split():
            parts = [x.lower() for x in PART.findall(name)]
            if not parts or MODIFIERS & set(parts) or (len(parts) > 1 and parts[0] in TAXONOMY):
                continue
            ends = {parts[0], next((x for x in reversed(parts) if x not in LAYOUT), parts[0])}
            if ends & LISTED and not set(parts) - LISTED <= LAYOUT | LISTS:
                ends -= LISTED
            if ends & APART:
                low = min(low, NAME_ASIDE if parts[0] in GOOD and ends & {"header", "footer"} else NAME_SURE if set(parts) <= SURE | LAYOUT else NAME_APART)
            elif ends & ASIDE:
                low = min(low, NAME_ASIDE)
            elif ends & GOOD or "content" in parts or "text" in parts:
                high = NAME_GOOD
    return low, high


class _Element:
    __slots__ = ("tag", "parent", "stop", "node", "hidden", "low", "high", "named", "holds", "own")

    def __init__(self, tag: str, parent: _Element | None, attributes: str):
        self.tag, self.parent, self.node, self.holds = tag, parent, -1, False
        self.stop = self if parent is None or tag in CLOSABLE or tag in SCOPE else parent.stop
        self.hidden = tag in HIDDEN or bool(parent and parent.hidden)
        own = TAGS.get(tag, 0.0)
        self.named, good = name_odds(attributes) if attributes and tag not in ("body", "html", "main") else (0.0, 0.0)
        self.low, self.high = min(own, 0.0), max(own, good)
        if tag == "header" and parent and parent.within("article"):
            self.low = NAME_ASIDE
        self.own = (self.low, self.high)

    def within(self, tag: str) -> bool:
        e, steps = self, 0
        while e is not None and steps < 8:
            if e.tag == tag:
                return True
            e, steps = e.parent, steps + 1
        return False


def blocks(html: str) -> list[tuple[str, _Element, int]]:
    """(text, element, characters in links) of the text blocks in page order; elements have their evidence."""
    return _read(html)[0]


def _read(html: str) -> tuple[list[tuple[str, _Element, int]], list[_Element]]:
    """:func:`blocks`, and all elements, parents first."""
    out: list[tuple[str, _Element, int]] = []
    here = root = _Element("", None, "")
    every = [root]
    opened: dict[str, int] = {}
    buffer: list[str] = []
    linked, link = 0, 0
    link_in = root  # the element that holds the open link: the link ends with it, at the latest

    def flush() -> None:
        nonlocal linked
        if buffer:
            if not here.hidden and (text := " ".join("".join(buffer).split())):
                out.append((text, here, linked))
            buffer.clear()
        linked = 0

    def leave(to: _Element) -> None:
        """Close all elements up to ``to``, which stays open."""
        nonlocal here, link
        while here is not to:
            opened[here.tag] -= 1
            if here is link_in:
                link = 0
            here = here.parent

    def out_of(tag: str) -> None:
        """Close the innermost open element of this kind."""
        e = here
        while e.tag != tag:
            e = e.parent
        leave(e.parent)

    at = 0
    while at <= len(html):
        m = TAG.search(html, at)
        piece = html[at : m.start() if m else len(html)]
        if piece:
            if "&" in piece:
                piece = unescape(piece)
            if here.tag == "head" and not piece.isspace():  # text ends a head
                flush()
                leave(here.parent)
            buffer.append(piece)
            if link:
                linked += len(piece)
        if m is None:
            break
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        closing, attributes = m[1] or m[4], m[3] or m[6] or ""
        if tag in INLINE:
            if tag == "a":
                link, link_in = int(not closing and "href" in attributes.lower()), here
            continue
        if tag == "br":
            buffer.append(" ")
            continue
        if tag in VOID and tag != "hr":
            continue
        flush()
        if closing:
            if opened.get(tag):
                out_of(tag)
            continue
        if here.tag == "head" and tag not in IN_HEAD:
            leave(here.parent)
        for kind, ends in (("select", ENDS_SELECT), ("datalist", ENDS_SELECT), ("button", ENDS_BUTTON | {"button"})):
            if opened.get(kind) and tag in ends:
                out_of(kind)
        if ends := CLOSES.get(tag):
            e = here.stop
            while e is not root and (e.tag in ends or e.tag not in SCOPE):
                if e.tag in ends:
                    leave(e.parent)
                e = e.parent.stop
        if tag in RAW:
            end = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(html, at)
            at = end.end() if end else len(html)
        elif tag != "hr" and not (tag in HIDDEN and attributes.endswith("/")):
            here = _Element(tag, here, attributes)
            every.append(here)
            opened[tag] = opened.get(tag, 0) + 1
    flush()
    _settle(every)
    return out, every


def _settle(every: list[_Element]) -> None:
    """Hand evidence down, parents first: the worst against and the best for content among an element and those it is in.

    What holds the page's main element, or an article that isn't apart itself, isn't judged by its name.
    """
    apart: dict[int, bool] = {}
    for e in every:
        (e.low, e.high), e.holds = e.own, False
    for e in every:
        apart[id(e)] = e.named < 0 or e.low < 0 or bool(e.parent and apart[id(e.parent)] and e.tag != "main")
        if e.tag == "main" or (e.tag == "article" and e.named == 0):
            up = e.parent
            if e.tag == "article":  # comments are articles too: those in something apart by name don't count
                x = up
                while x is not None and x.named == 0 and not x.holds:
                    x = x.parent
                if x is not None and x.named < NAME_ASIDE and not x.holds:
                    continue
            while up is not None and not up.holds:
                up.holds = True
                up = up.parent
    for e in every:
        if not e.holds:
            e.low = min(e.low, e.named)
        if e.parent:  # what speaks against an element ends what its surroundings say for it
            e.low, e.high = min(e.low, e.parent.low), max(e.high, e.parent.high if e.low == 0 else 0.0)


def log_odds(text: str, element: _Element, linked: int) -> float:
    words = text.count(" ") + 1
    z = BIAS + PER_LOG_WORD * np.log1p(words) + LINKS * min(1.0, linked / len(text))
    if text[-1] in ".!?…:;\"'”»)":
        z += SENTENCE
    if "©" in text or "copyright" in text.lower():
        z += RIGHTS
    if element.tag in ("h1", "h2", "h3"):
        z += SENTENCE
    return float(np.clip(z, -MOST, MOST)) + element.low + element.high


def min_cut(odds: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Labels (True: content) of least cost: |odds| of nodes labelled against their odds, plus cut edges.

    A node whose odds outweigh all its edges keeps its own label in some minimum cut; such nodes go
    first, handing their edges to their neighbours as odds.  Max-flow by blocking flows on level
    graphs settles what is left.
    """
    n = len(odds)
    odds = list(odds)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for a, b, w in edges:
        near[a][b] = near[a].get(b, 0.0) + w
        near[b][a] = near[b].get(a, 0.0) + w
    tied = [sum(x.values()) for x in near]
    label: list[bool | None] = [None] * n
    todo = deque(range(n))
    while todo:
        i = todo.popleft()
        if label[i] is None and abs(odds[i]) >= tied[i] - 1e-9:
            label[i] = odds[i] > 0
            for j, w in near[i].items():
                odds[j] += w if label[i] else -w
                tied[j] -= w
                del near[j][i]
                todo.append(j)
            near[i] = {}
    rest = [i for i in range(n) if label[i] is None]
    if rest:
        source = _flow(rest, odds, near)
        for i in rest:
            label[i] = i in source
    return [bool(x) for x in label]


def _flow(rest: list[int], odds: list[float], near: list[dict[int, float]]) -> set[int]:
    """Nodes on the source's side of a minimum cut; terminals have odds as capacities."""
    s, t = -1, -2
    to: list[int] = []
    cap: list[float] = []
    arcs: dict[int, list[int]] = {i: [] for i in (*rest, s, t)}

    def arc(a: int, b: int, forth: float, back: float) -> None:
        arcs[a].append(len(to))
        to.append(b)
        cap.append(forth)
        arcs[b].append(len(to))
        to.append(a)
        cap.append(back)

    for i in rest:
        if odds[i] > 0:
            arc(s, i, odds[i], 0.0)
        elif odds[i] < 0:
            arc(i, t, -odds[i], 0.0)
        for j, w in near[i].items():
            if i < j:
                arc(i, j, w, w)
    while True:
        level = {s: 0}
        queue = deque([s])
        while queue:
            i = queue.popleft()
            for x in arcs[i]:
                if cap[x] > 1e-9 and to[x] not in level:
                    level[to[x]] = level[i] + 1
                    queue.append(to[x])
        if t not in level:
            return set(level)
        turn = dict.fromkeys(level, 0)
        path: list[int] = []
        while True:
            i = to[path[-1]] if path else s
            if i == t:
                flow = min(cap[x] for x in path)
                first = 0
                for k, x in enumerate(path):
                    cap[x] -= flow
                    cap[x ^ 1] += flow
                for k, x in enumerate(path):
                    if cap[x] <= 1e-9:
                        first = k
                        break
                del path[first:]
                continue
            own = arcs[i]
            while turn[i] < len(own):
                x = own[turn[i]]
                if cap[x] > 1e-9 and level.get(to[x], -1) == level[i] + 1:
                    break
                turn[i] += 1
            if turn[i] < len(own):
                path.append(own[turn[i]])
            elif path:
                path.pop()
                turn[to[path[-1]] if path else s] += 1
            else:
                break


def _under_headings(found: list[tuple[str, _Element, int]]) -> set[int]:
    """Blocks under a heading of something else than the article, up to the next heading of its level in the same element."""
    out: set[int] = set()
    for i, (text, e, _) in enumerate(found):
        if e.tag in LEVELS and len(text) < 80 and HEADING.fullmatch(text.strip(" :.!?…»-–|")):
            out.add(i)
            for k in range(i + 1, len(found)):
                x = found[k][1]
                if x.tag in LEVELS and x.tag <= e.tag and x.parent is e.parent:
                    break
                while x is not None and x is not e.parent:
                    x = x.parent
                if x is None:
                    break
                out.add(k)
    return out


def _is_prose(block: tuple[str, _Element, int]) -> bool:
    text, _, linked = block
    return text.count(" ") + 1 >= PROSE_WORDS and linked <= PROSE_LINKS * len(text)


def _pardoned(found: list[tuple[str, _Element, int]], every: list[_Element], kept: int) -> bool:
    """Where an element with a bad name holds nearly all prose of a page of which ``kept`` words are left, the name says
    nothing: forget it, and those of what the element is in.  False if there is no such element."""
    words: dict[int, int] = {}
    for block in found:
        if _is_prose(block):
            e = block[1]
            while e is not None:
                words[id(e)] = words.get(id(e), 0) + block[0].count(" ") + 1
                e = e.parent
    named = [e for e in every if NAME_APART <= e.named < 0 and words.get(id(e), 0) >= max(PARDON_WORDS, PARDON_TIMES * kept)]
    if not named:
        return False
    e = max(named, key=lambda x: words[id(x)])
    while e is not None:
        e.named = 0.0
        e = e.parent
    _settle(every)
    return True


def labelled(html: str) -> list[tuple[str, float, bool]]:
    """(text, own log-odds, label of the cut) of the blocks of a page."""
    found, every = _read(html)
    out = _cut(found)
    if _pardoned(found, every, sum(text.count(" ") + 1 for text, _, keep in out if keep)):
        for _, e, _ in found:
            while e is not None:
                e.node, e = -1, e.parent
        out = _cut(found)
    return out


def _cut(found: list[tuple[str, _Element, int]]) -> list[tuple[str, float, bool]]:
    apart = _under_headings(found)
    odds = [log_odds(*b) + (NAME_APART if i in apart else 0.0) for i, b in enumerate(found)]
    edges = []
    for i, (_, e, _) in enumerate(found):
        if i:
            before = found[i - 1][1]
            same = before is e or before.parent is e.parent
            edges.append((i - 1, i, SIBLING if same else ADJACENT))
        node, up = i, e
        while up is not None and up.parent is not None:
            fresh = up.node < 0
            if fresh:
                up.node = len(odds)
                odds.append(0.0)
            edges.append((node, up.node, CHILD))
            if not fresh:
                break
            node, up = up.node, up.parent
    return [(b[0], z, keep) for b, z, keep in zip(found, odds, min_cut(odds, edges))]


def main_text(html: str) -> str:
    """Content blocks of a page, joined by line ends."""
    return "\n".join(text for text, _, keep in labelled(html) if keep)


def extract(df: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """Columns ``keep`` of each row, ``text`` (the main text) and ``n_chars`` (its code points)."""
    rows = df.select(*keep, F.coalesce(F.col(html_col), F.lit("")).alias("__html"))

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                text = [main_text(h) for h in part.column(len(keep)).to_pylist()]
                made = [pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], *made], names=[*keep, "text", "n_chars"])

    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[: len(keep)]]
    return rows.mapInArrow(run, ", ".join([*kinds, "text string", "n_chars long"]))
