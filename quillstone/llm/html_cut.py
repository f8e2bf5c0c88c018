"""Main text of web pages by minimum-cut labelling.

A page is cut into blocks of text at block-level tags.  A linear classifier scores each block (landmark elements and
class names above it, link density, length, tag); the costs of calling it content or boilerplate become the capacities
to the two terminals.  Neighbouring blocks, and successive blocks of one container, are joined by smoothness edges
whose capacity falls with their distance in the DOM.  The minimum cut, found by maximum flow, labels the blocks.
Blocks whose terminal capacity outweighs all their edges are fixed first, which never changes the optimum, so that the
flow only runs over blocks in doubt.

Character references are decoded, white space in a block becomes one space, blocks are joined by a line feed in page
order, nothing else is dropped.

Cases: null or empty html gives an empty text; unclosed tags, comments and raw elements end with the page; blocks
without evidence are boilerplate; repeated rows are extracted each; page size has no bound but memory for one page.
"""

from __future__ import annotations

import html
import math
import re
from collections import deque
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: HTML element classes.
RAW = {"script", "style", "template", "svg", "math", "iframe", "object", "title", "textarea", "select", "noscript", "noframes", "xmp", "canvas", "audio", "video"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var"}
CLOSED_BY_BLOCK = {"p", "h1", "h2", "h3", "h4", "h5", "h6"}
GOOD_TAGS = {"article": 3.5, "main": 2.5}
BAD_TAGS = {"nav", "footer", "aside", "form", "menu", "dialog", "button", "fieldset", "head"}
GOOD_ROLES, BAD_ROLES = {"main", "article"}, {"navigation", "banner", "contentinfo", "search", "complementary", "form", "menu", "menubar", "dialog", "alert", "alertdialog"}
#: Words of class and id attributes.
GOOD_NAMES = {"article", "articlebody", "body", "content", "entry", "main", "page", "post", "story", "text"}
BAD_NAMES = {
    "ad", "ads", "advert", "advertisement", "adverts", "banner", "breadcrumb", "breadcrumbs", "comment", "commentlist", "comments", "consent", "cookie", "cookies", "copyright", "disqus",
    "footer", "form", "gdpr", "header", "login", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "pager", "pagination", "popup", "promo", "promotion",
    "related", "replies", "reply", "search", "share", "sharing", "sidebar", "signup", "social", "sponsor", "sponsored", "subscribe", "tags", "toolbar", "topbar", "widget",
}
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)(?:>|\Z)|<[!?][^>]*(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"(class|id|role|itemprop|hidden|aria-hidden)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
WEIGHTS = {"bias": -1.2, "good_name": 1.2, "bad": -7.0, "link": -3.5, "words": 1.8, "end": 0.5, "p": 0.9, "heading": 0.7, "li": -0.2, "sign": -2.0}
ADJACENT, CONTAINER = 0.9, 0.6


@dataclass
class Element:
    tag: str
    good: float
    bad: bool
    depth: int
    up: "Element | None"
    last: int = -1  # the last block directly in it


@dataclass
class Block:
    tag: str
    owner: Element
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    text: str = ""


def _evidence(tag: str, attributes: str, up: Element) -> tuple[float, bool]:
    good, bad = GOOD_TAGS.get(tag, 0.0), tag in BAD_TAGS or (tag == "header" and not up.good)
    if attributes:
        for name, *values in ATTRIBUTE.findall(attributes):
            name, value = name.lower(), "".join(values)
            if name == "role":
                good, bad = good + 2.5 * (value.lower() in GOOD_ROLES), bad or value.lower() in BAD_ROLES
            elif name == "hidden" or name == "aria-hidden" and value.lower() == "true":
                bad = True
            elif value:
                words = {w.lower() for w in NAME.findall(value)}
                bad = bad or not words.isdisjoint(BAD_NAMES) and tag not in GOOD_TAGS and tag not in ("body", "html")
                good += WEIGHTS["good_name"] * (not words.isdisjoint(GOOD_NAMES) and tag not in ("body", "html"))
    return good, bad


def blocks_of(page: str) -> list[Block]:
    """Text blocks in page order, empty ones left out."""
    root = Element("", 0.0, False, 0, None)
    at, found, links, block, tag = root, [], 0, None, ""

    def add(raw: str) -> None:
        nonlocal block
        if block is None:
            block = Block(tag, at)
            found.append(block)
        text = html.unescape(raw) if "&" in raw else raw
        block.parts.append(text)
        if links:
            block.linked += len(text)

    pos, n = 0, len(page)
    while pos < n:
        m = TOKEN.search(page, pos)
        end = m.start() if m else n
        if end > pos:
            add(page[pos:end])
        if not m:
            break
        pos = max(m.end(), pos + 1)
        name = (m[2] or "").lower()
        if not name:
            continue
        closing = bool(m[1])
        if name in RAW:
            if not closing and not m[3].endswith("/"):
                close = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(page, pos)
                pos = close.end() if close else n
            continue
        if name in ("br", "wbr", "img", "input"):
            if block is not None and name != "wbr":
                block.parts.append(" ")
            continue
        if name == "a":
            links = max(0, links - 1) if closing else 1
        if name in INLINE:
            continue
        block, tag = None, ""
        if closing:
            e = at
            while e.up is not None and e.tag != name:
                e = e.up
            if e.up is not None:
                at = e.up
            tag = at.tag
            links = 0
        elif name not in VOID:
            if at.tag in CLOSED_BY_BLOCK and at.up is not None:
                at = at.up
            if name in ("li", "dd", "dt", "option") and at.tag == name and at.up is not None:
                at = at.up
            good, bad = _evidence(name, m[3], at)
            at = Element(name, at.good + good, at.bad or bad, at.depth + 1, at)
            tag, links = name, 0
    out = []
    for b in found:
        b.text = " ".join("".join(b.parts).split())
        if b.text:
            out.append(b)
    return out


def score(b: Block) -> float:
    """Log odds that a block is content."""
    w, words = WEIGHTS, b.text.count(" ") + 1
    s = w["bias"] + b.owner.good + w["bad"] * b.owner.bad + w["link"] * min(1.0, b.linked / len(b.text)) + w["words"] * min(words, 40) / 40
    s += w["end"] * (b.text[-1] in ".!?:;\"'”»…") + w["sign"] * (b.text[0] == "©")
    return s + w.get(b.tag, w["heading"] if b.tag[:1] == "h" and b.tag[1:].isdigit() else 0.0)


def _dom_distance(a: Element, b: Element) -> int:
    d = 0
    while a is not b:
        if a.depth >= b.depth:
            a = a.up
        else:
            b = b.up
        d += 1
    return d


def edges_of(found: list[Block]) -> dict[tuple[int, int], float]:
    edges: dict[tuple[int, int], float] = {}
    for i in range(1, len(found)):
        edges[i - 1, i] = ADJACENT / (1 + _dom_distance(found[i - 1].owner, found[i].owner))
    for i, b in enumerate(found):
        holder = b.owner.up or b.owner
        if holder.last >= 0:
            edges[holder.last, i] = edges.get((holder.last, i), 0.0) + CONTAINER / 2
        holder.last = i
    return edges


def min_cut(source: list[float], sink: list[float], edges: dict[tuple[int, int], float]) -> list[bool]:
    """Of each node, whether a minimum cut leaves it with the source; ties go to the sink."""
    n = len(source)
    gain, label = [a - b for a, b in zip(source, sink)], [None] * n
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for (i, j), w in edges.items():
        if i != j and w > 0:
            near[i][j] = near[i].get(j, 0.0) + w
            near[j][i] = near[j].get(i, 0.0) + w
    todo = deque(range(n))
    while todo:
        i = todo.popleft()
        if label[i] is None and abs(gain[i]) > sum(near[i].values()) - (0 if near[i] else 1e-12):
            label[i] = gain[i] > 0
            for j, w in near[i].items():
                gain[j] += w if label[i] else -w
                del near[j][i]
                todo.append(j)
            near[i] = {}
    rest = [i for i in range(n) if label[i] is None]
    if rest:
        for i, x in zip(rest, _flow(rest, gain, near)):
            label[i] = x
    return label  # type: ignore[return-value]


def _flow(nodes: list[int], gain: list[float], near: list[dict[int, float]]) -> list[bool]:
    """Dinic's maximum flow over the nodes in doubt; the residual graph's source side."""
    at = {v: k for k, v in enumerate(nodes)}
    s, t = len(nodes), len(nodes) + 1
    head: list[list[int]] = [[] for _ in range(t + 1)]
    to: list[int] = []
    cap: list[float] = []

    def join(u: int, v: int, there: float, back: float) -> None:
        head[u].append(len(to))
        to.append(v)
        cap.append(there)
        head[v].append(len(to))
        to.append(u)
        cap.append(back)

    for i in nodes:
        if gain[i] > 0:
            join(s, at[i], gain[i], 0.0)
        elif gain[i] < 0:
            join(at[i], t, -gain[i], 0.0)
        for j, w in near[i].items():
            if i < j:
                join(at[i], at[j], w, w)
    tiny = 1e-12
    while True:
        level = [-1] * (t + 1)
        level[s], queue = 0, deque([s])
        while queue:
            u = queue.popleft()
            for e in head[u]:
                if cap[e] > tiny and level[to[e]] < 0:
                    level[to[e]] = level[u] + 1
                    queue.append(to[e])
        if level[t] < 0:
            return [level[k] >= 0 for k in range(len(nodes))]
        turn, path, u = [0] * (t + 1), [], s
        while True:
            if u == t:
                pushed = min(cap[e] for e in path)
                for e in path:
                    cap[e] -= pushed
                    cap[e ^ 1] += pushed
                first = next(k for k, e in enumerate(path) if cap[e] <= tiny)
                u = to[path[first] ^ 1]
                del path[first:]
                continue
            while turn[u] < len(head[u]):
                e = head[u][turn[u]]
                if cap[e] > tiny and level[to[e]] == level[u] + 1:
                    break
                turn[u] += 1
            if turn[u] < len(head[u]):
                path.append(head[u][turn[u]])
                u = to[path[-1]]
            elif path:
                u = to[path.pop() ^ 1]
                turn[u] += 1
            else:
                break


def main_text(page: str | None) -> str:
    found = blocks_of(page or "")
    scores = [score(b) for b in found]
    soft = lambda x: x + math.log1p(math.exp(-x)) if x > 0 else math.log1p(math.exp(x))
    content = min_cut([soft(s) for s in scores], [soft(-s) for s in scores], edges_of(found))
    return "\n".join(b.text for b, c in zip(found, content) if c)


def extracted(pages: DataFrame, keep: list[str]) -> DataFrame:
    """Columns ``keep`` of pages with text and n_chars."""
    schema = T.StructType([*(pages.schema[c] for c in keep), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 1000):
                part = batch.slice(i, 1000)
                texts = [main_text(h.as_py()) for h in part.column("html")]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=schema.names)

    return pages.select(*keep, "html").mapInArrow(run, schema)


def result(pages: DataFrame) -> DataFrame:
    """The columns of query op3."""
    return extracted(pages, ["page_id", "url"])
