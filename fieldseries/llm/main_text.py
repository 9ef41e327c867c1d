"""Main text of HTML pages by minimum-cut labelling.

A page is cut into blocks of text. A classifier's costs are the capacities of each
block's edges to the two terminals, blocks that follow each other or stand in the same
part of the tree are tied by smoothness edges, and a maximum flow separates content
from boilerplate.
"""

from __future__ import annotations

import html
import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textvec import slices

#: Elements whose content is never text of the page. Tags mean nothing in raw ones, which run to the end of the page
#: if they are not closed; the others hide only what their end tag closes. What a head shows is its title.
RAW = "script style iframe textarea".split()
UNSEEN = frozenset("noscript template svg math object canvas video audio select button".split())
#: Elements that start and end a block of text.
BLOCKS = frozenset(
    "html body address article aside blockquote caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements and words of class, id and role that speak for boilerplate, whatever the text says.
BOILER_TAGS = frozenset("nav footer aside form menu dialog fieldset".split())
BOILER_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert newsletter subscribe subscription signup sidebar widget widgets related recommended recommendations share sharing social menu nav navbar navigation breadcrumb breadcrumbs footer masthead comment comments commentlist disqus replies respond login popup modal overlay toolbar pagination pager copyright disclaimer skip contentinfo complementary search".split()
)
#: The same for content.
CONTENT_TAGS = frozenset("article main".split())
CONTENT_WORDS = frozenset("article main content post entry story body text".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Costs of the classifier for a block, in units of log odds; positive speaks for content.
WEIGHTS = {"bias": -0.6, "words": 0.55, "sentence": 0.8, "links": -3.0, "heading": 0.6, "content": 3.0, "boiler": -12.0, "hidden": -12.0}
#: Smoothness of blocks that follow each other, and of blocks under the same parent; less with each step between them.
ADJACENT, SIBLING = 0.4, 0.6

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(" + "|".join(RAW) + r")(?=[\s/>])(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>.*?(?:</\1\s*>|\Z)|<title(?=[\s/>])[^>]*>.*?(?:</title\s*>|(?=</?(?:head|body|meta|link|base)[\s/>])|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|style)\b(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)
_WORD = re.compile(r"[a-z0-9]+")
_HEADING = re.compile(r"h[1-6]\Z")


@dataclass
class Block:
    text: str
    path: tuple[int, ...]
    linked: int
    heading: bool
    content: bool
    boiler: bool
    hidden: bool


def hidden_spans(tokens: list[re.Match]) -> dict[int, int]:
    """Numbers of the start tags of unseen elements, and of the tags up to which they hide.

    An end tag closes what is open inside its element. An unseen element closed that way,
    by the next select or button, or by nothing, has no end tag: it hides nothing, or its
    label, up to the next block, if it is a select or button.
    """
    spans: dict[int, int] = {}
    stack: list[tuple[str, int]] = []
    open_: dict[str, int] = {}
    for i, m in enumerate(tokens):
        tag = (m[3] or "").lower()
        if tag not in UNSEEN and tag not in BLOCKS:
            continue
        if m[2]:
            if open_.get(tag):
                while True:
                    last, k = stack.pop()
                    open_[last] -= 1
                    if last == tag:
                        break
                if tag in UNSEEN:
                    spans[k] = i
        elif not (tag in _VOID or m[4].endswith("/")):
            if tag in ("select", "button") and open_.get(tag):
                k = next(k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == tag)
                del stack[k]
                open_[tag] -= 1
            stack.append((tag, i))
            open_[tag] = open_.get(tag, 0) + 1
    following = None
    for i in range(len(tokens) - 1, -1, -1):
        tag = (tokens[i][3] or "").lower()
        if tag in BLOCKS:
            following = i
        elif tag in ("select", "button") and not tokens[i][2] and i not in spans and following is not None:
            spans[i] = following
    return spans


def blocks(page: str) -> list[Block]:
    """Blocks of visible text in page order, with their place in the tree.

    Character references are decoded and white space becomes one space. Unclosed and
    crossing tags are closed by the blocks around them.
    """
    out: list[Block] = []
    # an open element: tag, number, content, boiler, hidden
    stack: list[tuple[str, int, bool, bool, bool]] = [("", 0, False, False, False)]
    pieces: list[str] = []
    linked, number, link_depth = 0, 0, 0

    def close() -> None:
        nonlocal linked
        if pieces:
            text = " ".join(html.unescape("".join(pieces)).split())
            if text:
                *_, content, boiler, hidden = stack[-1]
                heading = any(_HEADING.match(e[0]) for e in stack[-3:])
                out.append(Block(text, tuple(e[1] for e in stack), linked, heading, content, boiler, hidden))
            pieces.clear()
        linked = 0

    def add(piece: str) -> None:
        nonlocal linked
        if piece:
            pieces.append(piece)
            if link_depth:
                linked += len(piece)

    at, skip = 0, -1
    tokens = list(_TOKEN.finditer(page))
    spans = hidden_spans(tokens)
    for i, m in enumerate(tokens):
        if i > skip:
            add(page[at : m.start()])
        at = m.end()
        if i < skip:
            continue
        skip = spans.get(i, skip)
        tag = (m[3] or "").lower()
        if not tag:
            continue
        if tag == "a":
            link_depth = 0 if m[2] else 1
        if tag == "br":
            pieces.append(" ")
        if tag not in BLOCKS:
            continue
        close()
        link_depth = 0
        if m[2]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    break
            continue
        if stack[-1][0] == "p" or tag == "li" and stack[-1][0] == "li":
            stack.pop()
        if tag in _VOID or m[4].endswith("/"):
            continue
        number += 1
        _, _, content, boiler, hidden = stack[-1]
        words: set[str] = set()
        if m[4]:
            for name, value in _ATTRIBUTE.findall(m[4]):
                name = name.lower()
                if name == "hidden" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                    hidden = True
                elif name != "style":
                    words.update(_WORD.findall(value.lower()))
        inside = content
        content = content or tag in CONTENT_TAGS or bool(words & CONTENT_WORDS)
        boiler = boiler or tag in BOILER_TAGS or tag == "header" and not inside or bool(words & BOILER_WORDS)
        stack.append((tag, number, content, boiler, hidden))
    add(page[at:])
    close()
    return out


def leaning(block: Block) -> float:
    """Log odds that a block is content."""
    words = block.text.count(" ") + 1
    score = WEIGHTS["bias"] + WEIGHTS["words"] * min(words, 60) ** 0.5
    score += WEIGHTS["sentence"] * (block.text[-1] in ".!?…:;。" and words > 2)
    score += WEIGHTS["links"] * min(1.0, block.linked / max(1, len(block.text))) + WEIGHTS["heading"] * block.heading
    return score + WEIGHTS["content"] * block.content + WEIGHTS["boiler"] * block.boiler + WEIGHTS["hidden"] * block.hidden


def ties(found: list[Block]) -> list[tuple[int, int, float]]:
    """Smoothness edges: each block to the next one, and to the next one under the same parent."""
    edges = [(k, k + 1, ADJACENT / (1 + _steps(found[k].path, found[k + 1].path))) for k in range(len(found) - 1)]
    last: dict[tuple[int, ...], int] = {}
    for k, b in enumerate(found):
        parent = b.path[:-1]
        if parent in last:
            edges.append((last[parent], k, SIBLING))
        last[parent] = k
    return edges


def _steps(a: tuple[int, ...], b: tuple[int, ...]) -> int:
    """Steps in the tree between two blocks, beyond those of siblings."""
    same = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        same += 1
    return max(0, len(a) + len(b) - 2 * same - 2)


def minimum_cut(costs: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Labels of least total cost: a node without its label pays ``abs(cost)``, a tied pair that differs pays its tie.

    Nodes whose cost outweighs all their ties have that label in every least cut; they
    are settled first, and a maximum flow decides on the rest. True is content.
    """
    n = len(costs)
    near: list[list[tuple[int, float]]] = [[] for _ in range(n)]
    for a, b, w in edges:
        near[a].append((b, w))
        near[b].append((a, w))
    lean, label = list(costs), [None] * n
    pull = [sum(w for _, w in x) for x in near]
    queue = deque(range(n))
    while queue:
        k = queue.popleft()
        if label[k] is None and abs(lean[k]) > pull[k]:
            label[k] = lean[k] > 0
            for other, w in near[k]:
                if label[other] is None:
                    lean[other] += w if label[k] else -w
                    pull[other] -= w
                    queue.append(other)
    rest = [k for k in range(n) if label[k] is None]
    if rest:
        number = {k: i for i, k in enumerate(rest)}
        inner = [(number[a], number[b], w) for a, b, w in edges if a in number and b in number]
        for k, side in zip(rest, _flow([lean[k] for k in rest], inner), strict=True):
            label[k] = side
    return label


def _flow(costs: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Source side of a minimum cut by shortest augmenting paths with level graphs."""
    n = len(costs)
    source, sink = n, n + 1
    head: list[list[int]] = [[] for _ in range(n + 2)]
    to, room = [], []

    def link(a: int, b: int, forth: float, back: float) -> None:
        head[a].append(len(to))
        to.append(b)
        room.append(forth)
        head[b].append(len(to))
        to.append(a)
        room.append(back)

    for k, c in enumerate(costs):
        link(source, k, c, 0.0) if c > 0 else link(k, sink, -c, 0.0)
    for a, b, w in edges:
        link(a, b, w, w)
    least = 1e-9
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = deque([source])
        while queue:
            a = queue.popleft()
            for e in head[a]:
                if room[e] > least and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return [level[k] >= 0 for k in range(n)]
        next_edge = [0] * (n + 2)
        path: list[int] = []
        at = source
        while True:
            if at == sink:
                flow = min(room[e] for e in path)
                for e in path:
                    room[e] -= flow
                    room[e ^ 1] += flow
                cut = next(i for i, e in enumerate(path) if room[e] <= least)
                at = to[path[cut] ^ 1]
                del path[cut:]
                continue
            while next_edge[at] < len(head[at]):
                e = head[at][next_edge[at]]
                if room[e] > least and level[to[e]] == level[at] + 1:
                    break
                next_edge[at] += 1
            if next_edge[at] < len(head[at]):
                path.append(e)
                at = to[e]
            elif path:
                e = path.pop()
                at = to[e ^ 1]
                next_edge[at] += 1
            else:
                break


def main_text(page: str | None) -> str:
    """Content blocks of a page, in page order, one to a line."""
    found = blocks(page or "")
    keep = minimum_cut([leaning(b) for b in found], ties(found))
    return "\n".join(b.text for b, k in zip(found, keep, strict=True) if k)


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """``pages`` without ``html_col``, plus ``text`` and ``n_chars`` (code points) of each page's main text.

    A null or empty page, and one without content, has an empty text. Pages are read
    whole, one at a time. Columns named ``text`` or ``n_chars`` are replaced; repeated
    rows give repeated rows and an empty table an empty one.
    """
    kept = [c for c in pages.columns if c not in (html_col, "text", "n_chars")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_html"):
            texts = [main_text(p) for p in batch.column("_html").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*kept, "text", "n_chars"])

    rows = pages.select(*kept, F.col(html_col).alias("_html"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(run, f"{fields}, text string, n_chars long")
