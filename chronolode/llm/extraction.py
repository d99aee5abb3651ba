"""Main text of web pages by minimum-cut labelling of their blocks.

A page is cut into blocks of text at block-level tags. A logistic classifier gives each block
a cost for either label, which become the capacities to the two terminals of a flow network;
blocks that follow one another or share a parent are joined by smoothness edges. The minimum
cut separates content from boilerplate. The classifier is trained on the blocks of a bounded
sample of pages that their own semantic markup labels, and judges blocks in pages without it
by text and link features.

Defined results: a NULL or empty page, and one without a content block, gives the empty text
with 0 characters; broken markup (tags left open, cut off, unknown) is read as far as it goes.
Pages are read one by one: repeated ones, NULL ids and extra columns do not matter.
"""

from __future__ import annotations

import html
import math
import re
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolode.llm.common import map_arrow, with_fields

# Pages whose blocks train the classifier.
SAMPLE = 500
# Smoothness of neighbours in page order, and of neighbours with the same parent.
NEXT, SIBLING = 0.4, 0.8
MOST_COST = 8.0

_TAG = re.compile(
    r"<!--.*?(?:-->|$)|<(script|style|noscript|template|svg|iframe|textarea|select|button|title)"
    r"\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</\1\s*>|$)|<[!?][^>]*>"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|$)",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"(?:class|id|role|aria-label)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
_BAD = re.compile(
    r"(?<![a-z])(?:ads?|advert\w*|banner|nav\w*|menu|foot\w*|header|masthead|side\w*|comments?|"
    r"respond|cookies?|notice|consent|gdpr|promo\w*|sponsor\w*|related|recommend\w*|share|sharing|"
    r"social|subscribe|newsletter|breadcrumbs?|widget|login|search|form|modal|popup|toolbar|legal|"
    r"copyright|pagination|pager|tags?|complementary|contentinfo|navigation|alert|dialog)(?![a-z])",
    re.I,
)
_GOOD = re.compile(
    r"(?<![a-z])(?:article\w*|main|content|post|entry|story|body|text)(?![a-z])", re.I
)
_BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre "
    "section summary table tbody td tfoot th thead tr ul".split()
)
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_BAD_TAGS = frozenset("nav footer aside form menu dialog head fieldset".split())
_GOOD_TAGS = frozenset(("article", "main"))
# A new block of these closes an open one of the same kind.
_CLOSES = {"li": ("li",), "p": ("p",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"),
           "td": ("td", "th"), "th": ("td", "th")}


def _mark(tag: str, attributes: str, inside: int) -> int:
    """-1 if an element is boilerplate by its markup, 1 if content, else what its parent is."""
    if tag in _BAD_TAGS or (tag == "header" and inside <= 0):
        return -1
    if attributes and "=" in attributes:
        names = " ".join(_ATTRIBUTE.findall(attributes))
        if names and tag not in ("html", "body"):
            if _BAD.search(names):
                return -1
            if _GOOD.search(names) and inside >= 0:
                return 1
    if tag in _GOOD_TAGS and inside >= 0:
        return 1
    return inside


class Block:
    __slots__ = ("text", "tag", "mark", "parent", "links", "depth")

    def __init__(self, text: str, tag: str, mark: int, parent: int, links: int, depth: int):
        self.text, self.tag, self.mark = text, tag, mark
        self.parent, self.links, self.depth = parent, links, depth


def blocks_of(page: str) -> list[Block]:
    """Blocks of text in page order, white space collapsed, character references decoded."""
    out: list[Block] = []
    # Open elements: tag, mark, number of the element.
    stack: list[tuple[str, int, int]] = [("", 0, 0)]
    parts: list[str] = []
    links = count = anchors = 0

    def flush() -> None:
        nonlocal links
        if parts:
            raw = "".join(parts)
            parts.clear()
            text = " ".join((html.unescape(raw) if "&" in raw else raw).split())
            if text:
                block = next((e for e in reversed(stack) if e[0] in _BLOCK), stack[0])
                at = stack.index(block)
                parent = stack[max(at - 1, 0)][2]
                out.append(Block(text, block[0], stack[-1][1], parent, links, at))
        links = 0

    position = 0
    for match in _TAG.finditer(page):
        if match.start() > position:
            piece = page[position : match.start()]
            parts.append(piece)
            links += len(piece) if anchors else 0
        position = match.end()
        tag = match.group(3)
        if tag is None:
            continue
        tag = tag.lower()
        if tag == "br":
            parts.append(" ")
            continue
        if match.group(2):
            if tag == "a":
                anchors = max(0, anchors - 1)
            at = next((i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == tag), 0)
            if tag in _BLOCK:
                flush()
            if at:
                del stack[at:]
            continue
        if tag in _BLOCK:
            flush()
            anchors = 0 if tag == "body" else anchors
            while len(stack) > 1 and stack[-1][0] not in _BLOCK:
                stack.pop()
            if tag == "body":
                while len(stack) > 1 and stack[-1][0] != "html":
                    stack.pop()
            elif stack[-1][0] == "p" or stack[-1][0] in _CLOSES.get(tag, ()):
                stack.pop()
        if tag in _VOID:
            continue
        count += 1
        attributes = match.group(4)
        if tag == "a":
            anchors += 1
        stack.append((tag, _mark(tag, attributes, stack[-1][1]), count))
    parts.append(page[position:])
    flush()
    return out


def features(blocks: list[Block]) -> np.ndarray:
    """One row per block: markup, size, links, punctuation, kind and place."""
    rows = []
    n = len(blocks)
    for i, b in enumerate(blocks):
        words = b.text.count(" ") + 1
        rows.append(
            (
                1.0,
                float(b.mark > 0),
                float(b.mark < 0),
                min(1.0, math.log1p(words) / 5),
                min(1.0, b.links / (len(b.text) + 1)),
                float(b.text[-1] in ".!?:;\"'…”»)"),
                min(1.0, 8 * sum(map(b.text.count, ".,;")) / len(b.text)),
                float(b.tag in ("p", "pre", "blockquote")),
                float(b.tag[:1] == "h" and b.tag[1:].isdigit()),
                float(b.tag in ("li", "td", "th", "dd", "dt")),
                float(i == 0),
                float(i == n - 1),
            )
        )
    return np.array(rows).reshape(n, 12)


# Log-odds used where a sample has no block of one kind: trust markup, then size and links.
PRIOR = np.array([-0.5, 3.0, -4.0, 3.0, -3.0, 0.5, 0.5, 0.5, 0.5, -0.5, -0.2, -0.2])


def fit(pages: DataFrame, sample: int = SAMPLE) -> np.ndarray:
    """Classifier weights from the blocks that semantic markup labels in ``sample`` pages."""
    drawn = (
        pages.where(F.length("html") > 0)
        .select(F.xxhash64("html").alias("draw"), "page_id")
        .orderBy("draw", "page_id")
        .limit(sample)
        .select("page_id")
        .distinct()
        .withColumnRenamed("page_id", "drawn")
    )
    rows = pages.join(drawn, F.col("page_id").eqNullSafe(F.col("drawn"))).select(
        F.col("html").alias("text")
    )

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        x, y = [], []
        for page in batch.column("text").to_pylist():
            blocks = blocks_of(page)
            if blocks:
                x.append(features(blocks))
                y += [b.mark for b in blocks]
        x = np.concatenate(x) if x else np.zeros((0, 12))
        # Equal rows are summed, so what goes to the driver is small.
        table, times = np.unique(
            np.hstack([np.round(x, 2), np.array(y, float).reshape(-1, 1)]), axis=0, return_counts=True
        )
        return pa.RecordBatch.from_arrays(
            [pa.array(table.tolist(), pa.list_(pa.float64())), pa.array(times.astype(np.int64))],
            names=["row", "times"],
        )

    found = map_arrow(rows, step, "row array<double>, times long").collect()
    found = sorted((tuple(r["row"]), r["times"]) for r in found if r["row"][-1] != 0)
    if len({r[-1] for r, _ in found}) < 2:
        return PRIOR
    x = np.array([r[:-1] for r, _ in found])
    y = np.array([r[-1] > 0 for r, _ in found], float)
    times = np.array([t for _, t in found], float)
    times = np.where(y > 0, times / times[y > 0].sum(), times / times[y == 0].sum()) / 2
    w = PRIOR.copy()
    for _ in range(25):  # Newton steps, pulled to the prior
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (times * (p - y)) + 0.003 * (w - PRIOR)
        bend = (x * (times * p * (1 - p))[:, None]).T @ x + 0.003 * np.eye(len(w))
        w = w - np.linalg.solve(bend, slope)
    return w


def minimum_cut(gain: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Labels (True: source side) that minimise lost gains plus cut edges.

    A positive gain is what labelling a node False loses, a negative one what True loses.
    Nodes whose gain exceeds all their edges are settled first and their edges folded into
    the neighbours' gains; augmenting paths solve what is left.
    """
    n = len(gain)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for i, j, w in edges:
        if i != j:
            near[i][j] = near[i].get(j, 0.0) + w
            near[j][i] = near[j].get(i, 0.0) + w
    gain = list(gain)
    label: list[bool | None] = [None] * n
    todo = deque(range(n))
    while todo:
        i = todo.popleft()
        if label[i] is not None or abs(gain[i]) < sum(near[i].values()) or (near[i] and gain[i] == 0):
            continue
        label[i] = gain[i] > 0
        for j, w in near[i].items():
            del near[j][i]
            gain[j] += w if label[i] else -w
            todo.append(j)
        near[i] = {}
    rest = [i for i in range(n) if label[i] is None]
    if rest:
        source, sink = n, n + 1
        room: dict[int, dict[int, float]] = {i: dict(near[i]) for i in rest}
        room[source] = {i: gain[i] for i in rest if gain[i] > 0}
        room[sink] = {}
        for i in rest:
            if gain[i] > 0:
                room[i].setdefault(source, 0.0)
            else:
                room[i][sink] = -gain[i]
                room[sink][i] = 0.0
        while True:
            came = {source: source}
            line = deque([source])
            while line and sink not in came:
                u = line.popleft()
                for v, r in room[u].items():
                    if r > 1e-9 and v not in came:
                        came[v] = u
                        line.append(v)
            if sink not in came:
                break
            flow, v = math.inf, sink
            while v != source:
                flow, v = min(flow, room[came[v]][v]), came[v]
            v = sink
            while v != source:
                u = came[v]
                room[u][v] -= flow
                room[v][u] = room[v].get(u, 0.0) + flow
                v = u
        for i in rest:
            label[i] = i in came
    return [bool(x) for x in label]


def main_text(page: str, weights: np.ndarray) -> str:
    """Content blocks of a page, one per line."""
    blocks = blocks_of(page)
    if not blocks:
        return ""
    # The log-odds are the difference of the two labels' costs -log p and -log (1 - p).
    gain = np.clip(features(blocks) @ weights, -MOST_COST, MOST_COST).tolist()
    edges = [(i, i + 1, NEXT) for i in range(len(blocks) - 1)]
    last: dict[int, int] = {}
    for i, b in enumerate(blocks):
        if b.parent in last:
            edges.append((last[b.parent], i, SIBLING))
        last[b.parent] = i
    labels = minimum_cut(gain, edges)
    return "\n".join(b.text for b, good in zip(blocks, labels) if good)


def extract(pages: DataFrame, weights: np.ndarray | None = None) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    weights = fit(pages) if weights is None else weights

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [main_text(p, weights) for p in batch.column("text").to_pylist()]
        return pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()),
             pa.array([len(t) for t in texts], pa.int64())],
            names=["page_id", "url", "text", "n_chars"],
        )

    schema = with_fields(pages, ["page_id", "url"], "text string, n_chars long")
    return map_arrow(pages.select("page_id", "url", F.col("html").alias("text")), step, schema)
