"""Main text of HTML pages by minimum cut.

A page is cut into text blocks. A classifier gives each its capacity from the content terminal or to
the boilerplate terminal, in log odds: a logistic regression over the block's own text (words, closing
punctuation, link share, tag, words of notices) and over what the elements around it are (an article, one apart from the
text, one whose name or form speaks against it or for it, none on a page that has an article, none at
all). Neighbouring blocks are joined by adjacency edges, blocks of one box, list or table and what
stands around it by DOM edges, on the scale of the capacities. The maximum flow's cut is the cheapest
labelling, and the blocks on the content side are the text: a short paragraph stays with its article, and a
fluent sentence goes with the advert that it is in.

The text's part is fitted on all blocks whose markup leaves no doubt (in an article without a contrary
sign, or in navigation and the like), counted over all pages by cell of feature values, of which
there are at most ``CELLS``; then the markup's part on the same blocks, given the text's. Pages carry no labels, so
kinds of markup that no such block has keep their prior weights. Counts are scaled to one weight, so that
prior weights, which alone decide where no page has such blocks, matter the same at every size.

Null and empty pages, and pages without a content block, give the empty text. Pages are parsed
whole in one pass; broken markup is read as browsers do, near enough: unknown ends are dropped, open
elements end with the page. Repeated rows get equal texts; an empty table gives an empty result.
Other columns pass through, whatever their names; one named as ``into`` is replaced.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter, deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^<>"']|"[^"<]*+"|'[^'<]*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^<>]*+)>""", re.S)
ATTRIBUTE = re.compile(r"""(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
#: Elements whose text is never shown as text of the page.
SKIPPED = {"script", "style", "noscript", "template", "title", "textarea", "iframe", "svg", "math", "object", "canvas", "audio", "video", "select", "head"}
#: Those whose content is no markup: without an end they last to the end of the page.
RAW = {"script", "style", "noscript", "title", "textarea", "iframe"}
#: Elements whose short parts are judged by their links and what is around the whole.
GROUPS = {"ul", "ol", "dl", "table"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "mark", "q", "ruby", "rp", "rt", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img"}
#: Elements that hold no main text.
OUTER = {"nav", "footer", "aside", "menu", "dialog", "button", "fieldset", "label", "legend", "datalist", "output"}
OUTER_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "alertdialog", "menu", "menubar", "toolbar"}
CLOSES_P = {"address", "article", "aside", "blockquote", "details", "div", "dl", "fieldset", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul"}
IN_BOX = {"p", "li", "h1", "h2", "h3", "h4", "h5", "h6", "dt", "dd", "tr", "td", "th", "pre", "blockquote"}
OUTER_NAME = re.compile(r"^(?:ads?|adverts?|advert\w*|adsense|sponsor\w*|promos?|promo\w*|banners?|nav|navbar|navigation|menus?|breadcrumbs?|sidebars?|aside|footers?|foot|headers?|masthead|topbar|cookies?|consent|gdpr|notices?|notifications?|alerts?|popups?|modals?|overlay|newsletters?|subscribe|subscription|signup|share|sharing|social|related|recommend\w*|comments?|commentlist|disqus|replies|reply|respond|widgets?|toolbars?|pagination|pager|login|search|copyright|legal|disclaimer|hidden|teasers?)$")
INNER_NAME = re.compile(r"^(?:article|content|post|entry|story|main|body|text|prose|maincontent)$")
#: Those of them that hold texts in articles of their own.
LISTED_NAME = re.compile(r"^(?:ads?|advert\w*|adsense|sponsor\w*|promo\w*|related|recommend\w*|comments?|commentlist|disqus|replies|reply|respond|teasers?)$")
STATE = {"has", "with", "no", "is", "without", "js", "not"}

#: Features of a block: constant, words (50 at most) over 50, closing punctuation, link share, tag
#: of a paragraph, of a list item, of a heading. The weights are the prior, in log odds.
PRIOR = np.array([-4.0, 7.5, 1.5, -10.0, 2.0, -0.5, 1.0])
CELLS = 50 * 2 * 11 * 4
#: Weight of all counts together, and the prior's precision: what a text is like is learnt, what
#: tags tell of it hardly, as pages of one make would teach their template's habits.
WEIGHT, PRECISION = 200.0, np.array([0.44, 0.44, 0.44, 0.44, 50.0, 50.0, 50.0])
#: Kinds of markup around a block and what they tell before any fit, in log odds.
WHOLE, APART, AGAINST, FOR, OUTSIDE, BARE, NONE = range(7)
MARKUP = np.array([6.0, -9.0, -8.0, 2.0, -3.0, 3.0, 0.0])
#: The precision of those priors, on the scale of ``WEIGHT``.
MARKUP_PRECISION = 4.0
#: Words of notices: with two of them a short text is likely one, in log odds.
NOTICE = re.compile(r"(?i)\b(?:cookies?|consent|privacy|accept(?: all)?|newsletters?|subscribe|sign (?:up|in)|log ?in|copyright|all rights reserved|advertisement|terms of (?:use|service))\b|©")
NOTICED = -6.0
#: Capacity of one unit of log odds, and the most that a block's own text counts.
UNIT, MOST = 10, 50


@dataclass
class Block:
    text: str
    tag: str
    container: int
    depth: int
    links: float
    #: Elements around it that only names, or a form, speak against; whether one speaks for it.
    doubts: int
    favoured: bool
    #: 1 or -1 where markup leaves no doubt.
    sure: int
    #: The list or table around it (0: none), the element around that, and the characters.
    group: int
    around: int
    size: int


@dataclass
class Page:
    blocks: list[Block] = field(default_factory=list)
    #: Elements on the page.
    elements: int = 0


def _names(attributes: str) -> tuple[list[list[str]], str, bool]:
    """Class and id names in parts, the role, and whether the element is hidden."""
    names, role, hidden = [], "", False
    for m in ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), (m[2] or m[3] or m[4] or "")
        if key in ("class", "id"):
            names += [re.split(r"[-_]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", x).lower()) for x in value.split()]
        elif key == "role":
            role = value.strip().lower()
        elif key == "style":
            hidden |= bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I))
        else:
            hidden |= key == "hidden" or value.lower() == "true"
    return names, role, hidden


def _against(name: list[str], inner: bool) -> str:
    """The part of a name that speaks against an element: its last before a word of state, or its first
    unless a part after that speaks for it."""
    name = name[: next((i for i, x in enumerate(name) if x in STATE), len(name))]
    if not name:
        return ""
    first, last = name[0], name[-1]
    if OUTER_NAME.match(last):
        # the header of an article or entry is its own
        return "" if last in ("header", "headers") and (inner or INNER_NAME.match(first)) else last
    told = OUTER_NAME.match(first) and (LISTED_NAME.match(first) or not any(map(INNER_NAME.match, name[1:])))
    return first if told else ""


@dataclass
class _Open:
    """An open element: what holds for the texts in it."""

    tag: str
    number: int = 0
    outer: bool = False
    inner: bool = False
    doubts: int = 0
    favoured: bool = False
    #: Doubts that an article does not end.
    listed: int = 0
    group: int = 0
    around: int = 0


def parsed(page: str) -> Page:
    """The text blocks of a page in order, those of skipped elements left out, and the elements with evidence."""
    out = Page()
    stack = [_Open("")]
    parts: list[str] = []
    shown = linked = 0
    in_link, number, at = False, 0, 0
    endless: set[str] = set()  # skipped elements that have no further end on the page

    def end_block() -> None:
        nonlocal shown, linked
        text = " ".join(entities.unescape("".join(parts)).split())
        if text:
            own = stack[-1]
            box = stack[-2].number if len(stack) > 1 and own.tag in IN_BOX else own.number
            sure = -1 if own.outer else int(own.inner and not own.doubts)
            out.blocks.append(Block(text, own.tag, box, len(stack), linked / max(shown, 1), own.doubts, own.favoured, sure, own.group, own.around, shown))
        parts.clear()
        shown = linked = 0

    while at < len(page):
        m = TOKEN.search(page, at)
        piece = page[at : m.start() if m else len(page)]
        if piece:
            parts.append(piece)
            n = len(piece.strip())
            shown += n
            linked += n * in_link
        if not m:
            break
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        closing = bool(m[1] or m[4])
        if tag in INLINE:
            in_link = not closing if tag == "a" else in_link
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag in SKIPPED:
            empty = tag in ("svg", "math") and (m[3] or m[6] or "").endswith("/")
            if not closing and not empty and tag not in endless:
                end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>" if tag != "head" else r"</head\s*>|(?=<body[\s>])", re.I).search(page, at)
                if end:
                    at = end.end()
                elif tag in RAW:
                    at = len(page)
                else:
                    endless.add(tag)
            parts.append(" ")
            continue
        end_block()
        in_link = False
        if closing:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
            continue
        if tag in CLOSES_P and stack[-1].tag == "p" or tag in ("li", "dt", "dd", "tr", "td", "th", "option") and stack[-1].tag in (tag, "p", "dt", "dd"):
            del stack[-1:]
            if tag in ("li", "dt", "dd") and stack[-1].tag == tag:
                del stack[-1:]
        if tag in VOID:
            continue
        number += 1
        up = stack[-1]
        own = _Open(tag, number, up.outer, up.inner, up.doubts, up.favoured, up.listed, up.group, up.around)
        names, role, hidden = _names(m[3] or m[6] or "")
        whole = tag in ("article", "main") or role in ("main", "article")
        if tag not in ("html", "body"):
            against = [x for x in (_against(n[:1] if whole else n, up.inner) for n in names) if x and (not whole or LISTED_NAME.match(x))]
            if tag in OUTER or tag == "header" and not up.inner or role in OUTER_ROLES or hidden:
                own.outer = True
            elif against or tag == "form" or role == "form":
                own.inner = own.favoured = False
                own.doubts += 1
                own.listed += any(map(LISTED_NAME.match, against))
            elif whole and not up.outer:
                own.doubts, own.inner, own.group = up.listed, not up.listed, 0
            elif any(x[0] not in STATE and any(map(INNER_NAME.match, x)) for x in names):
                own.favoured = True
        if tag in GROUPS:
            own.group, own.around = number, up.number
        stack.append(own)
    end_block()
    out.elements = number
    return out


def kinds(page: Page, of_text: Scores) -> list[int]:
    """The kind of markup around each block. A doubt that nearly all of the page's likely text is under
    tells nothing, and a page whose text stands in an article has none outside it."""
    likely: Counter[int] = Counter()
    for b in page.blocks:
        likely[b.doubts] += max(of_text[cell(b)], 0) if b.sure >= 0 else 0
    shared = likely.total() and next(k for k in sorted(likely) if 10 * sum(v for x, v in likely.items() if x <= k) >= likely.total())
    out = []
    has = any(b.sure > 0 for b in page.blocks)
    for b in page.blocks:
        if b.sure:
            out.append(WHOLE if b.sure > 0 else APART)
        elif b.doubts > shared:
            out.append(AGAINST)
        elif has:
            out.append(OUTSIDE)
        else:
            out.append(FOR if b.favoured else NONE if page.elements else BARE)
    return out


def cell(block: Block) -> tuple[int, int, int, int]:
    """The feature values of a block's text: words, closing punctuation, tenths of links, kind of tag."""
    kind = 1 if block.tag in ("p", "pre", "blockquote") else 2 if block.tag == "li" else 3 if len(block.tag) == 2 and block.tag[0] == "h" and block.tag[1] in "123456" else 0
    return min(block.text.count(" ") + 1, 50), int(block.text[-1] in ".!?…:\"'”»"), round(10 * min(block.links, 1.0)), kind


def features(cells: np.ndarray) -> np.ndarray:
    """One row of features for each row of ``cells``."""
    words, closed, links, kind = np.asarray(cells, dtype=np.float64).reshape(-1, 4).T
    return np.stack([np.ones_like(words), words / 50, closed, links / 10, kind == 1, kind == 2, kind == 3], 1)


def fit(cells: np.ndarray, yes: np.ndarray, no: np.ndarray) -> np.ndarray:
    """Weights of the logistic regression over counted cells, drawn to the prior: Newton's method."""
    w = PRIOR.copy()
    total = float(yes.sum() + no.sum())
    if not (yes.sum() and no.sum()):
        return w
    x, yes, no = features(cells), yes * (WEIGHT / total), no * (WEIGHT / total)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ ((yes + no) * p - yes) + PRECISION * (w - PRIOR)
        bend = (x * ((yes + no) * p * (1 - p))[:, None]).T @ x + np.diag(PRECISION)
        step = np.linalg.solve(bend, slope)
        w -= step / max(1.0, float(np.abs(step).max()))
        if np.abs(step).max() < 1e-9:
            break
    return w


class Scores(dict):
    """cell -> capacity of a block with this text, positive where content is likelier; ``markup``: what its kind adds."""

    def __init__(self, weights: np.ndarray = PRIOR, markup: np.ndarray = MARKUP):
        self.weights = weights
        self.markup = [round(UNIT * float(x)) for x in markup]

    def __missing__(self, key: tuple[int, int, int, int]) -> int:
        value = self[key] = max(-MOST, min(MOST, round(UNIT * float((features(np.array(key)) @ self.weights)[0]))))
        return value


def fit_markup(cells: np.ndarray, kind: np.ndarray, yes: np.ndarray, no: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Log odds of the kinds of markup, given the text's: Newton's method for each kind by itself, as a block
    has one."""
    out, total = MARKUP.copy(), float(yes.sum() + no.sum())
    if not total:
        return out
    text = np.clip(features(cells) @ weights, -MOST / UNIT, MOST / UNIT)
    for k in np.unique(kind):
        of, scale = kind == k, WEIGHT / total
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(text[of] + out[k], -30, 30)))
            n = (yes + no)[of] * scale
            step = ((n * p - yes[of] * scale).sum() + MARKUP_PRECISION * (out[k] - MARKUP[k])) / ((n * p * (1 - p)).sum() + MARKUP_PRECISION)
            out[k] -= step
            if abs(step) < 1e-9:
                break
    return out


def minimum_cut(scores: list[int], edges: list[tuple[int, int, int, int]]) -> list[bool]:
    """Which nodes stay with the source: the scores are terminal capacities (source if positive, sink
    if negative); an edge (a, b, there, back) costs ``there`` if only a stays, ``back`` if only b
    does. Dinic's maximum flow; of equally cheap cuts the one where most nodes stay."""
    n = len(scores)
    source, sink = n, n + 1
    to: list[int] = []
    left: list[int] = []
    out: list[list[int]] = [[] for _ in range(n + 2)]

    def join(a: int, b: int, there: int, back: int) -> None:
        out[a].append(len(to))
        to.append(b)
        left.append(there)
        out[b].append(len(to))
        to.append(a)
        left.append(back)

    for v, s in enumerate(scores):
        if s > 0:
            join(source, v, s, 0)
        elif s < 0:
            join(v, sink, -s, 0)
    for edge in edges:
        join(*edge)
    while True:
        level = [-1] * (n + 2)
        level[source], queue = 0, deque([source])
        while queue:
            v = queue.popleft()
            for e in out[v]:
                if left[e] and level[to[e]] < 0:
                    level[to[e]] = level[v] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            break
        nxt, path, v = [0] * (n + 2), [], source
        while True:
            if v == sink:
                f = min(left[e] for e in path)
                for e in path:
                    left[e] -= f
                    left[e ^ 1] += f
                cut = next(i for i, e in enumerate(path) if not left[e])
                v = to[path[cut] ^ 1]
                del path[cut:]
            while nxt[v] < len(out[v]):
                e = out[v][nxt[v]]
                if left[e] and level[to[e]] == level[v] + 1:
                    break
                nxt[v] += 1
            if nxt[v] < len(out[v]):
                path.append(e)
                v = to[e]
            elif v == source:
                break
            else:
                e = path.pop()
                v = to[e ^ 1]
                nxt[v] += 1
    # all stay but those from which the sink can still be reached
    lost, queue = [False] * (n + 2), deque([sink])
    lost[sink] = True
    while queue:
        v = queue.popleft()
        for e in out[v]:
            if left[e ^ 1] and not lost[to[e]]:
                lost[to[e]] = True
                queue.append(to[e])
    return [not x for x in lost[:n]]


def network(page: Page, of_text: Scores, near: int = 15, same_box: int = 45) -> tuple[list[int], list[tuple[int, int, int, int]]]:
    """(capacities of the blocks, edges) of a page."""
    blocks = page.blocks
    # short parts of lists and tables speak against them by their links only
    of_group: dict[int, list[float]] = {}
    for b in blocks:
        sums = of_group.setdefault(b.group, [0.0, 0.0])
        sums[0] += b.links * b.size
        sums[1] += b.size
    linked = {k: min(1.0, 2 * x / max(n, 1)) if k else 1.0 for k, (x, n) in of_group.items()}
    scores, around = [], kinds(page, of_text)
    for b, kind in zip(blocks, around, strict=True):
        s = of_text[cell(b)]
        s = round(s * max(linked[b.group], min(1.0, 2 * b.links))) if b.group and s < 0 else s
        noticed = kind != WHOLE and len(b.text) < 400 and len({x.lower() for x in NOTICE.findall(b.text)}) > 1
        scores.append(s + of_text.markup[kind] + round(UNIT * NOTICED) * noticed)
    edges: list[tuple[int, int, int, int]] = []
    # a list or table holds together and to what stands before and after it, the less the more links it has
    tie = {k: round(same_box * (1 - x)) for k, x in linked.items()}
    last: dict[int, int] = {}
    begun: set[int] = set()
    ended: dict[int, int] = {}
    for i, b in enumerate(blocks):
        if i:
            edge = same_box if blocks[i - 1].container == b.container else near // (1 + abs(blocks[i - 1].depth - b.depth))
            edge = max(edge, tie[b.group]) if blocks[i - 1].group == b.group else edge
            # what stands in another kind of markup is hardly nearer for being next
            edge = edge if around[i - 1] == around[i] else edge // 3
            edges.append((i - 1, i, edge, edge))
        before = last.get(b.container, -1)
        if 0 <= before < i - 1:
            edges.append((before, i, same_box, same_box))
        if b.container in ended:
            k = ended.pop(b.container)
            edges.append((k, i, tie[blocks[k].group], tie[blocks[k].group]))
        if b.group:
            if b.group not in begun and b.around in last:
                edges.append((last[b.around], i, tie[b.group], tie[b.group]))
            begun.add(b.group)
            ended[b.around] = i
        last[b.container] = i
    return scores, [x for x in edges if x[2] or x[3]]


def label(page: Page, of_text: Scores | None = None) -> list[bool]:
    """True for the blocks on the content side of the minimum cut."""
    scores, edges = network(page, of_text if of_text is not None else Scores())
    return minimum_cut(scores, edges)


def main_text(page: str, of_text: Scores | None = None) -> str:
    found = parsed(page)
    return "\n".join(b.text for b, content in zip(found.blocks, label(found, of_text), strict=True) if content)


def counted(pages: DataFrame, html: str = "html") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cells, numbers of blocks of text, numbers of others) over all blocks of all pages that markup decides beyond doubt."""

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter[tuple] = Counter()
        for batch in it:
            for page in batch.column(0):
                n.update((*cell(b), b.sure) for b in parsed(page.as_py()).blocks if b.sure)
        yield pa.RecordBatch.from_pydict({name: pa.array([key[i] for key in n], pa.int32()) for i, name in enumerate(("words", "closed", "links", "kind", "sure"))} | {"n": pa.array(list(n.values()), pa.int64())})

    key = ["words", "closed", "links", "kind"]
    rows = pages.select(text_of(pages, html).alias("_tw_html")).mapInArrow(count, "words int, closed int, links int, kind int, sure int, n long")
    rows = rows.groupBy(*key).agg(F.sum(F.when(F.col("sure") > 0, F.col("n")).otherwise(0)).alias("yes"), F.sum(F.when(F.col("sure") < 0, F.col("n")).otherwise(0)).alias("no")).orderBy(*key).collect()
    return np.array([[r[k] for k in key] for r in rows]), np.array([r["yes"] for r in rows], dtype=np.float64), np.array([r["no"] for r in rows], dtype=np.float64)


def trained(pages: DataFrame, html: str = "html") -> np.ndarray:
    """The weights of the text's part of the classifier."""
    return fit(*counted(pages, html))


def classifier(pages: DataFrame, html: str = "html") -> tuple[np.ndarray, np.ndarray]:
    """The weights of both parts of the classifier, fitted on these pages."""
    cells, yes, no = counted(pages, html)
    weights = fit(cells, yes, no)
    # a block that counts as text is of a whole, one that does not is apart
    both, none = np.concatenate([cells, cells]), np.zeros_like(yes)
    kind = np.repeat([WHOLE, APART], len(cells))
    return weights, fit_markup(both, kind, np.concatenate([yes, none]), np.concatenate([none, no]), weights)


def extract(pages: DataFrame, html: str = "html", into: str = "_tw_text") -> DataFrame:
    """``pages`` with the main text of each page in ``into``; the classifier is fitted on these pages."""
    weights, markup = classifier(pages, html)

    @F.arrow_udf("string")
    def main(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        of_text = Scores(weights, markup)
        for column in parts:
            yield pa.array([main_text(x.as_py() or "", of_text) for x in column], pa.string())

    return pages.withColumn(into, main(text_of(pages, html)))
