"""Main text of HTML pages by minimum-cut labelling.

A page becomes its blocks of text in page order.  A logistic classifier turns each
block's shape and place (length, links, punctuation, tag, ancestors) into the costs
of calling it content or boilerplate: the capacities to the two terminals.  Blocks
that are neighbours in the page, and blocks that share a parent element, are tied
by smoothness edges, the tighter the nearer they stand in the tree.  The minimum
cut, found by maximum flow, is the labelling of least total cost.

The classifier is trained on at most ``TRAIN_PAGES`` different pages of at most
``TRAIN_BYTES`` (least hashes of id and html): blocks
inside the primary article are examples of content, those below navigation, footer,
form, advert, notice or comment elements examples of boilerplate; structural
features are hidden from half the examples so that text features learn too, and
weights stay near a prior where the sample says nothing.

Edge cases: null and empty html give the empty text, as do pages without content;
unclosed and stray tags, comments and attributes are tolerated, in time linear in the
page; nothing is cut off, however long; the text of formulas stays; repeated rows are extracted each; columns named text or n_chars are
replaced.
"""

from __future__ import annotations

import html
import re
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orthoplex.llm import arrowtext as at

TRAIN_PAGES, TRAIN_BYTES = 400, 200_000

_TAG = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
_JUMP = re.compile(r"[>\"']")
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?|\"[^\"]*\"|'[^']*'")
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_SPACE = re.compile(r"\s+")

# Element names of HTML.
RAW = {"script", "style", "textarea", "title", "iframe", "xmp", "head"}
UNSEEN = {"noscript", "template", "svg", "object", "audio", "video", "canvas", "select", "annotation", "annotation-xml"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = set(
    "address article aside blockquote body button center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html label legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCK - {"td", "th", "tr", "tbody", "thead", "tfoot", "html", "body", "button", "label"}
#: A start tag ends an open element of its group, up to an element of the second set.
IMPLIED = {
    **dict.fromkeys(["li"], ({"li"}, {"ul", "ol", "menu", "dir"})),
    **dict.fromkeys(["dt", "dd"], ({"dt", "dd"}, {"dl"})),
    **dict.fromkeys(["td", "th"], ({"td", "th"}, {"tr", "table"})),
    **dict.fromkeys(["tr"], ({"tr", "td", "th"}, {"table"})),
    **dict.fromkeys(["tbody", "thead", "tfoot"], ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"})),
}
AWAY_TAGS = {"nav", "aside", "footer", "form", "dialog", "menu", "button", "label", "fieldset"}
AWAY_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "alertdialog", "menu", "menubar", "toolbar", "form"}
AWAY_NAMES = set(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs pagination pager sidebar "
    "widget footer masthead toolbar cookie cookies consent gdpr popup modal overlay newsletter subscribe subscription signup login sharing social "
    "related recommended recommendations comment comments commentlist disqus respond replies copyright disclaimer skip dropdown outbrain taboola".split()
)
#: These count only where no other word of the name speaks for an article.
WEAK_NAMES = set("notice alert legal search share reply reviews teaser teasers".split())
#: What may stand beside a name without changing what it says.
PLAIN_NAMES = set("area bar block bottom box button buttons container content form group holder inner item items left links list main outer page panel right row section site slot text top wrap wrapper".split())
CONTENT_NAMES = set("article content main post entry body story text page".split())
RIGHTS = re.compile(r"©|copyright|all rights reserved", re.I)


def speaks_of_boilerplate(name: str) -> bool:
    """Whether a class or an id names boilerplate: its last word does, or all of its words do but for plain ones."""
    parts = [p.lower() for p in _PART.findall(name)]
    if not parts:
        return False
    known = AWAY_NAMES | WEAK_NAMES
    if not (parts[-1] in known or (any(p in known for p in parts) and all(p in known or p in PLAIN_NAMES for p in parts))):
        return False
    return not AWAY_NAMES.isdisjoint(parts) or not (CONTENT_NAMES - PLAIN_NAMES).intersection(parts)


class Element:
    __slots__ = ("tag", "parent", "depth", "away", "away_name", "fits", "size", "hidden", "primary", "seen")

    def __init__(self, tag: str, parent: Element | None, attributes: str) -> None:
        self.tag, self.parent, self.depth = tag, parent, parent.depth + 1 if parent else 0
        self.away = tag in AWAY_TAGS
        self.away_name = self.fits = self.hidden = self.primary = False
        self.size = 0
        self.seen: tuple | None = None
        if attributes and tag not in ("html", "body"):
            for name, value in _ATTRIBUTE.findall(attributes):
                name, value = name.lower(), value.strip("\"'")
                if name in ("class", "id"):
                    for word in value.split():
                        self.away_name |= speaks_of_boilerplate(word)
                        self.fits |= not CONTENT_NAMES.isdisjoint(p.lower() for p in _PART.findall(word))
                elif name == "role":
                    self.away |= value.lower() in AWAY_ROLES
                    self.fits |= value.lower() in ("main", "article")
                elif name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I)):
                    self.hidden = True


class Block:
    __slots__ = ("text", "element", "linked")

    def __init__(self, text: str, element: Element, linked: int) -> None:
        self.text, self.element, self.linked = text, element, linked


def _tokens(page: str) -> Iterator[tuple[int, int, str, str | None, str]]:
    """(begin, end, slash, tag, attributes) of the tags of a page, the tag None for comments and declarations; each place is read a bounded number of times.

    A tag ends at the first > outside quotes; where a quote is never closed, at the
    first > at all, and from there on quotes are not heeded.  What has no > is text.
    The caller may send the place to go on from.
    """
    at_, n, heed = 0, len(page), True
    last_quote = {q: page.rfind(q) for q in "\"'"}
    last_end = page.rfind(">")
    while True:
        begin = page.find("<", at_)
        if begin < 0:
            return
        if page.startswith("<!--", begin):
            end = page.find("-->", begin + 4)
            skip = yield begin, n if end < 0 else end + 3, "", None, ""
            at_ = (n if end < 0 else end + 3) if skip is None else skip
            continue
        if begin > last_end:
            return
        head = _TAG.match(page, begin + 1)
        if not head:
            if page[begin + 1 : begin + 2] in ("!", "?"):
                end = page.find(">", begin) + 1
                skip = yield begin, end, "", None, ""
                at_ = end if skip is None else skip
            else:
                at_ = begin + 1
            continue
        stop = -1
        if heed:
            place = head.end()
            while (m := _JUMP.search(page, place)) is not None:
                if m.group() == ">":
                    stop = m.start()
                    break
                if m.start() >= last_quote[m.group()]:
                    heed = False
                    break
                place = page.find(m.group(), m.end()) + 1
            heed &= stop >= 0
        if stop < 0:
            stop = page.find(">", head.end())
        if stop < 0:
            return
        skip = yield begin, stop + 1, head.group(1), head.group(2), page[head.end() : stop]
        at_ = stop + 1 if skip is None else skip


def blocks_of(page: str) -> list[Block]:
    """Blocks of text in page order, without raw elements and markup."""
    root = Element("#root", None, "")
    here, out = root, []
    elements = [root]
    pieces: list[str] = []
    linked, links, unseen, block = 0, 0, 0, root
    open_: dict[str, int] = {}  # how many elements of each name are open: where none is, none is looked for
    last: dict[str, int] = {}  # where the last end tag of an unseen element begins
    body = [-2]

    def never_closed(tag: str, start: int) -> bool:
        if tag not in last:
            last[tag] = max((e.start() for e in re.finditer(rf"</{re.escape(tag)}\s*>", page, re.I)), default=-1)
        return last[tag] < start

    def flush() -> None:
        nonlocal linked
        if pieces:
            text = _SPACE.sub(" ", html.unescape("".join(pieces))).strip()
            if text:
                out.append(Block(text, block, min(linked, len(text))))
                block.size += len(text)
            pieces.clear()
        linked = 0

    def close_to(target: Element) -> None:
        nonlocal here, links, unseen
        while here is not target.parent:
            open_[here.tag] -= 1
            if here.tag in UNSEEN:
                unseen -= 1
            if here.tag == "a":
                links = max(0, links - 1)
            here = here.parent

    def take(tag: str, closing: str, attributes: str) -> None:
        nonlocal here, links, unseen, block
        covered = unseen
        if tag in BLOCK and not unseen:
            flush()
        if closing:
            if open_.get(tag):
                up = here
                while up.tag != tag:
                    up = up.parent
                close_to(up)
            if tag in BLOCK and covered and not unseen:
                flush()
        elif tag not in VOID:
            if tag in CLOSES_P and open_.get("p"):
                up = here
                while up is not root and up.tag not in UNSEEN and up.tag not in ("p", "td", "th", "button", "div", "section", "article", "li", "blockquote", "aside"):
                    up = up.parent
                if up.tag == "p":
                    close_to(up)
            if tag in IMPLIED and any(open_.get(x) for x in IMPLIED[tag][0]):
                ends, stops = IMPLIED[tag]
                up = here
                while up is not root and up.tag not in stops and up.tag not in UNSEEN:
                    if up.tag in ends:
                        close_to(up)
                        up = here
                        continue
                    up = up.parent
            here = Element(tag, here, attributes)
            elements.append(here)
            open_[tag] = open_.get(tag, 0) + 1
            if tag == "a":
                links += 1
            if tag in UNSEEN:
                unseen += 1
            if attributes.endswith("/") and tag not in BLOCK:
                close_to(here)
        if tag in BLOCK and not unseen:
            block = here
            while block.tag not in BLOCK and block.parent is not None:
                block = block.parent

    at_, n = 0, len(page)
    tokens = _tokens(page)
    token = next(tokens, None)
    while token is not None:
        begin, end, closing, tag, attributes = token
        if begin > at_ and not unseen:
            pieces.append(page[at_:begin])
            if links:
                linked += begin - at_
        at_ = end
        tag = tag.lower() if tag else None
        if tag == "br":
            pieces.append(" ")
        elif tag in UNSEEN and not closing and (attributes.endswith("/") or never_closed(tag, at_)):
            pass  # without content, rather than the rest of the page as content
        elif tag in RAW and not closing:
            if attributes.endswith("/") and unseen:
                pass
            elif never_closed(tag, at_):
                if tag == "head":
                    if body[0] == -2:
                        found = re.search(r"<body", page, re.I)
                        body[0] = found.start() if found else -1
                    at_ = max(at_, body[0])
                else:
                    at_ = n
            else:
                at_ = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at_).end()
        elif tag is not None:
            take(tag, closing, attributes)
        try:
            token = tokens.send(at_)
        except StopIteration:
            token = None
    if at_ < n and not unseen:
        pieces.append(page[at_:])
    flush()
    for e in reversed(elements):  # children stand after their parents
        if e.parent is not None:
            e.parent.size += e.size
    _inherit(elements)
    return out


# Weights that hold where the training pages say nothing, in the order of _row.
PRIOR = np.array([-0.6, 1.2, -2.5, 0.8, 0.8, -0.6, 0.8, 0.4, -0.5, 4.5, -10.0, -9.0, 1.2, -4.0, 0.0])
_STRUCTURE = slice(9, 13)


def _inherit(elements: list[Element]) -> None:
    """What the blocks of an element inherit from its ancestors: inside the primary article, away, named, fits, in an article, in a header."""
    best = None
    for e in elements:
        if e.tag in ("article", "main") and not e.away_name and e.size and (best is None or e.size > best.size):
            best = e
    while best is not None:
        best.primary = True
        best = best.parent
    for e in elements:
        inside, away, named, fits, article, header = e.parent.seen if e.parent else (False,) * 6
        e.seen = (
            inside or (e.primary and e.tag in ("article", "main")), away or e.hidden or (e.away and not (e.primary and e.tag in ("form", "fieldset"))), named or (e.away_name and not e.primary), fits or e.fits,
            article or e.tag == "article", header or (e.tag == "header" and not e.primary),
        )


def _row(block: Block, k: int, n: int) -> tuple[list[float], int]:
    """Features of a block, and its example label: 1 content, 0 boilerplate, -1 none."""
    text = block.text
    inside, away, named, fits, article, header = block.element.seen
    away |= header and not article
    words = text.count(" ") + 1
    tag = block.element.tag
    row = [
        1.0, np.log1p(len(text)) / 5, block.linked / len(text), float(text[-1] in ".!?…\"”"), float(words >= 15), float(words <= 4), float(tag in ("p", "blockquote", "pre")),
        float(len(tag) == 2 and tag[0] == "h" and tag != "hr"), float(tag in ("li", "td", "th", "dt")), float(inside), float(away), float(named), float(fits and not named), float(bool(RIGHTS.search(text))), k / n,
    ]
    return row, 0 if away or named else 1 if inside else -1


def _matrix(blocks: list[Block]) -> tuple[np.ndarray, list[int]]:
    rows = [_row(b, k, len(blocks)) for k, b in enumerate(blocks)]
    return np.array([r for r, _ in rows], np.float64).reshape(len(rows), len(PRIOR)), [y for _, y in rows]


def train(pages: list[str], seed: int = 3, steps: int = 300, pull: float = 0.02) -> np.ndarray:
    """Logistic weights, pulled towards the prior."""
    xs, ys = [], []
    for page in pages:
        x, y = _matrix(blocks_of(page))
        y = np.array(y, np.int64)
        xs.append(x[y >= 0])
        ys.append(y[y >= 0])
    x = np.concatenate(xs) if xs else np.empty((0, len(PRIOR)))
    y = np.concatenate(ys).astype(np.float64) if ys else np.empty(0)
    w = PRIOR.copy()
    if not len(y) or y.min() == y.max():
        return w
    bare = x.copy()
    bare[np.random.default_rng(seed).random(len(x)) < 0.5, _STRUCTURE] = 0
    weight = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum()))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(bare @ w, -30, 30)))
        w += 0.5 * (bare.T @ (weight * (y - p)) - pull * (w - PRIOR))
    return w


def minimum_cut(gain: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Side of the source of each node after a minimum cut.

    gain > 0: capacity from the source (content); gain < 0: capacity to the sink.
    Dinic's maximum flow over the undirected ``edges``.
    """
    n = len(gain)
    s, t = n, n + 1
    heads: list[list[int]] = [[] for _ in range(n + 2)]
    to: list[int] = []
    room: list[float] = []

    def join(a: int, b: int, forth: float, back: float) -> None:
        heads[a].append(len(to))
        to.append(b)
        room.append(forth)
        heads[b].append(len(to))
        to.append(a)
        room.append(back)

    for k, g in enumerate(gain):
        join(s, k, g, 0.0) if g > 0 else join(k, t, -g, 0.0)
    for a, b, w in edges:
        join(a, b, w, w)
    tiny = 1e-9
    while True:
        level = [-1] * (n + 2)
        level[s] = 0
        queue = deque([s])
        while queue:
            u = queue.popleft()
            for e in heads[u]:
                if room[e] > tiny and level[to[e]] < 0:
                    level[to[e]] = level[u] + 1
                    queue.append(to[e])
        if level[t] < 0:
            return [level[k] >= 0 for k in range(n)]
        tried = [0] * (n + 2)
        while True:
            path: list[int] = []
            u = s
            while u != t:
                while tried[u] < len(heads[u]):
                    e = heads[u][tried[u]]
                    if room[e] > tiny and level[to[e]] == level[u] + 1:
                        break
                    tried[u] += 1
                else:
                    if not path:
                        break
                    level[u] = -2
                    u = to[path.pop() ^ 1]
                    tried[u] += 1
                    continue
                path.append(e)
                u = to[e]
            if u != t:
                break
            flow = min(room[e] for e in path)
            for e in path:
                room[e] -= flow
                room[e ^ 1] += flow


def _apart(a: Element, b: Element) -> int:
    """Steps between two elements in the tree."""
    steps = 0
    while a is not b:
        if a.depth >= b.depth:
            a = a.parent
        else:
            b = b.parent
        steps += 1
    return steps


def extract(page: str | None, weights: np.ndarray, near: float = 0.8, kin: float = 0.5) -> str:
    """The main text of a page."""
    blocks = blocks_of(page) if page else []
    if not blocks:
        return ""
    x, _ = _matrix(blocks)
    gain = np.clip(x @ weights, -9, 9).tolist()
    if min(gain) < 0 < max(gain):
        edges = [(k, k + 1, near * 2.0 ** -(_apart(blocks[k].element, blocks[k + 1].element) / 2)) for k in range(len(blocks) - 1)]
        last: dict[int, int] = {}
        for k, b in enumerate(blocks):
            parent = id(b.element.parent)
            if parent in last:
                edges.append((last[parent], k, kin))
            last[parent] = k
        chosen = minimum_cut(gain, edges)
    else:
        chosen = [g > 0 for g in gain]
    return "\n\n".join(b.text for b, c in zip(blocks, chosen, strict=True) if c)


def _extract(batches: Iterator[pa.RecordBatch], shared, html_at: int) -> Iterator[pa.RecordBatch]:
    weights = shared.value
    for batch in batches:
        texts = [extract(p, weights) for p in batch.column(html_at).to_pylist()]
        columns = [c for k, c in enumerate(batch.columns) if k != html_at]
        names = [c for k, c in enumerate(batch.schema.names) if k != html_at]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*names, "text", "n_chars"])


def main_text(pages: DataFrame, *, html_column: str = "html", page_id: str = "page_id") -> DataFrame:
    """``pages`` with text and n_chars in place of the html column."""
    plain = pages.select(F.col(html_column).alias("html"), F.xxhash64(page_id, html_column).alias("o")).where("html is not null")
    total = pages.count()
    cut = min((1 << 63) - 1, -(1 << 63) + int((1 << 64) * min(1.0, 4 * TRAIN_PAGES / max(1, total))))
    near = plain.where((F.col("o") <= cut) & (F.octet_length("html") <= TRAIN_BYTES)).orderBy("o").limit(TRAIN_PAGES)
    sample = near.select("html").collect()  # at most TRAIN_PAGES rows of TRAIN_BYTES
    shared = pages.sparkSession.sparkContext.broadcast(train(sorted({r[0] for r in sample})))
    source = at.drop_clashing(pages, {"text", "n_chars"} - {html_column.lower()})
    html_at = [c.lower() for c in source.columns].index(html_column.lower())
    fields = [f for k, f in enumerate(source.schema.fields) if k != html_at]
    schema = T.StructType([*fields, T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    return source.mapInArrow(lambda it: _extract(it, shared, html_at), schema)


def digest(found: DataFrame) -> DataFrame:
    return found.select("page_id", "url", "text", "n_chars")
