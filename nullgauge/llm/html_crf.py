"""Main text of web pages by a linear-chain conditional random field over DOM leaf blocks.

A page is parsed into leaf blocks: runs of text between block boundaries, with character references decoded and white
space squeezed. Each block has features of its ancestors (tags, words of class and id) and of its text (length, link
share, punctuation, place). A two-state chain scores content against boilerplate; the best path is Viterbi's, and the
content blocks are joined in page order.

Training: pages whose markup names its parts (article, main, nav, aside, footer, class words) label their own blocks.
The sample is bounded: `train_pages` pages of smallest hash of at most TRAIN_CHARS characters, TRAIN_BLOCKS labelled
blocks in all, and the small pages of SEEDS; each page is also learnt
with its content-naming features left out, so that text features count where markup says nothing. Likelihood and
gradient come from the forward-backward algorithm over all sampled pages at once.

Defined results: null or empty html gives an empty text; unclosed elements end with their parent or the page, a tag
that the page's end cuts is dropped; pages of any length and depth are read whole, in time in proportion to their
length; repeated rows give equal rows; other columns aren't looked at; an empty table gives an empty result.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bounds of the training sample: pages, characters of a page that is drawn, labelled blocks in all, and blocks of one
#: chain (longer pages are cut into several chains).
TRAIN_PAGES, TRAIN_CHARS, TRAIN_BLOCKS, CHAIN_BLOCKS = 300, 200_000, 40_000, 200

# Element kinds of HTML and words that name parts of a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template title textarea".split())
HIDDEN = frozenset("iframe svg select option button object".split())
BLOCK = frozenset(
    "address article aside blockquote body br center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " head header hr html legend li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
CLOSED_BY = {"p": BLOCK - {"br", "html", "body", "head"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}}
TAGS = "nav header footer aside article main section form figure ul ol li table h1 h2 h3 p blockquote pre div".split()
_TAGS = frozenset(TAGS)
NAMED = {
    "advert": "ad ads advert advertisement sponsor sponsored promo banner",
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs pagination toc",
    "side": "sidebar side widget related recommended popular",
    "comment": "comment comments disqus reply replies respond discussion",
    "notice": "cookie cookies consent notice gdpr popup modal newsletter subscribe alert",
    "edge": "footer header masthead copyright legal",
    "share": "share social sharing follow",
    "content": "content article post entry story text body main prose",
}
WORD_NAMES = {w: name for name, words in NAMED.items() for w in words.split()}
CONTENT_TAGS, OTHER_TAGS = {"article", "main"}, {"nav", "footer", "aside", "form", "header"}
_NOTICE = re.compile(r"\b(?:cookies?|privacy|subscribe|newsletter|sign (?:in|up)|all rights reserved|terms of (?:use|service))\b", re.I)
_TOKEN = re.compile(r"<!--(?:.*?-->|.*\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(>|\Z)|<[a-zA-Z/][^>]*(?:>|\Z)|[^<]+|<", re.S)
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_SPLIT = re.compile(r"[^a-z]+")

FEATURES = [*(f"in {t}" for t in TAGS), *(f"named {n}" for n in NAMED), *(f"words {k}" for k in range(5)), "links none", "links some", "links most", "ends sentence", "copyright", "notice words", "first block", "last block", "any"]
INDEX = {f: k for k, f in enumerate(FEATURES)}
_HINTS = [INDEX[f] for f in ("in article", "in main", "named content")]


@dataclass
class Block:
    text: str
    features: list[int]
    label: int | None


class Node:
    """An open element: what its blocks inherit from it and its ancestors, and its nearest block element."""

    __slots__ = ("tag", "place", "hidden", "features", "label", "nearest")

    def __init__(self, tag: str, names: tuple[str, ...], parent: Node | None, place: int):
        own = {INDEX[f"named {x}"] for x in names} | ({INDEX[f"in {tag}"]} if tag in _TAGS else set())
        self.tag, self.place = tag, place
        self.features = parent.features if parent and own <= parent.features else (parent.features if parent else frozenset()) | own
        self.hidden = tag in HIDDEN or parent is not None and parent.hidden
        self.nearest = self if tag in BLOCK else parent.nearest if parent else None
        # the innermost part that the markup names decides; an article's header is part of it
        label = parent.label if parent else None
        if tag in CONTENT_TAGS:
            label = 1
        elif tag in OTHER_TAGS and not (tag == "header" and label == 1) or names and "content" not in names:
            label = 0
        elif "content" in names and tag != "body":
            label = 1
        self.label = label


def leaf_blocks(page: str) -> list[Block]:
    """The non-empty leaf blocks of a page in order; time follows the page's length, however deep its elements nest."""
    stack: list[Node] = []
    opened: dict[str, int] = {}
    found: list[tuple[str, int, Node | None]] = []
    parts: list[str] = []
    linked = 0

    def close_block() -> None:
        nonlocal linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                found.append((text, linked, stack[-1] if stack else None))
            parts.clear()
        linked = 0

    def close(place: int) -> None:
        for node in stack[place:]:
            opened[node.tag] -= 1
        del stack[place:]

    position, n = 0, len(page)
    while position < n:
        m = _TOKEN.match(page, position)
        position = m.end()
        token = m.group()
        if m.group(2) is None:
            if (token[0] != "<" or token == "<") and not (stack and stack[-1].hidden):
                parts.append(token)
                linked += len(token) if opened.get("a") else 0
            continue
        tag, closing = m.group(2).lower(), bool(m.group(1))
        if not m.group(4):
            break
        if tag in RAW and not closing:
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*>?", re.I).search(page, position)
            position = end.end() if end else n
            continue
        if tag in BLOCK:
            close_block()
        if closing:
            if opened.get(tag):
                close(next(k for k in range(len(stack) - 1, -1, -1) if stack[k].tag == tag))
        elif tag not in VOID and not (tag == "svg" and m.group(3).endswith("/")):
            above = stack[-1].nearest if stack else None
            if above is not None and tag in CLOSED_BY.get(above.tag, ()):
                close(above.place)
            names: tuple[str, ...] = ()
            if m.group(3) and not m.group(3).isspace():
                names = tuple({WORD_NAMES[w] for a in _NAMES.findall(m.group(3)) for w in _SPLIT.split("".join(a).lower()) if w in WORD_NAMES})
            stack.append(Node(tag, names, stack[-1] if stack else None, len(stack)))
            opened[tag] = opened.get(tag, 0) + 1
    close_block()
    return [_block(text, linked, node, k, len(found)) for k, (text, linked, node) in enumerate(found)]


def _block(text: str, linked: int, node: Node | None, place: int, n: int) -> Block:
    out = {INDEX["any"], *(node.features if node else ())}
    words = text.count(" ") + 1
    out.add(INDEX[f"words {0 if words <= 2 else 1 if words <= 8 else 2 if words <= 20 else 3 if words <= 60 else 4}"])
    share = linked / max(len(text), 1)
    out.add(INDEX["links none" if not linked else "links most" if share >= 0.5 else "links some"])
    if text[-1] in ".!?…":
        out.add(INDEX["ends sentence"])
    if text[0] == "©" or "©" in text[:40]:
        out.add(INDEX["copyright"])
    if _NOTICE.search(text):
        out.add(INDEX["notice words"])
    if place == 0:
        out.add(INDEX["first block"])
    if place == n - 1:
        out.add(INDEX["last block"])
    return Block(text, sorted(out), node.label if node else None)


SEEDS = [
    '<html><body><div class="menu"><a href="/">Home</a> <a href="/n">News</a></div><div class="content"><h1>Rain in the hills</h1><p>It rained for a week, and the river rose above its banks.</p><p>People moved their cattle to the upper fields.</p></div><div class="sidebar"><h3>Popular</h3><ul><li><a href="/a">Ten tips</a></li></ul></div><div class="comments"><p>Great read, thanks for writing this down for us.</p></div><div class="footer">© 2020 Example</div></body></html>',
    '<body><header><a href="/">Example</a></header><div class="cookie notice"><p>We use cookies to improve this site. Read our privacy terms.</p></div><main><h1>How bread rises</h1><p>Yeast eats sugar and gives off gas.</p><ul><li>Flour holds the gas.</li><li>Heat sets the crumb.</li></ul></main><form><p>Subscribe to the newsletter</p></form><footer><p>All rights reserved.</p></footer></body>',
    '<body><nav><ul><li><a href="/1">One</a></li><li><a href="/2">Two</a></li></ul></nav><article><h2>Short</h2><p>Yes.</p><p>No.</p><p>He said so, and then he left the room without another word.</p><aside><p>Related: other rooms he has left.</p></aside></article><aside><p>Advertisement for rooms.</p></aside><footer>Contact</footer></body>',
    '<body><div class="ad">Buy now! The best offer of the whole year is waiting here.</div><div class="post"><p>The old mill stands by the water.</p><p>Its wheel has not turned since the war, but the stones are sound.</p></div><div class="share"><a href="#">Share</a></div><div class="related"><a href="/x">More mills</a></div></body>',
]


@dataclass
class Model:
    weights: np.ndarray
    between: np.ndarray

    def content(self, blocks: list[Block]) -> list[bool]:
        """Viterbi's best path; a block's score is that of content against boilerplate."""
        if not blocks:
            return []
        w, ((stay, rise), (fall, hold)) = self.weights.tolist(), self.between.tolist()
        low, high, back = 0.0, 0.0, []
        for k, b in enumerate(blocks):
            gain = sum(w[f] for f in b.features)
            if k:
                to_low, to_high = (low + stay, high + fall), (low + rise, high + hold)
                back.append((to_low[1] > to_low[0], to_high[1] > to_high[0]))
                low, high = max(to_low), max(to_high)
            high += gain
        state = high > low
        path = [state]
        for b in reversed(back):
            state = b[state]
            path.append(state)
        return path[::-1]


def train(pages: list[str], rounds: int = 200, ridge: float = 1e-3) -> Model:
    """Weights by gradient ascent on the likelihood of the pages' own labels; step sizes adapt to each weight."""
    chains, used = [], 0
    for page in [*SEEDS * 10, *pages]:
        blocks = leaf_blocks(page)
        known = [b for b in blocks if b.label is not None]
        if used + len(known) > TRAIN_BLOCKS or len({b.label for b in known}) < 2:
            continue
        used += len(known)
        for low in range(0, len(known), CHAIN_BLOCKS):
            part = known[low : low + CHAIN_BLOCKS]
            chains.append([(b.features, b.label) for b in part])
            chains.append([([f for f in b.features if f not in _HINTS], b.label) for b in part])
    width, longest = len(FEATURES), max(map(len, chains))
    x = np.zeros((len(chains), longest, width))
    y = np.zeros((len(chains), longest), int)
    mask = np.zeros((len(chains), longest), bool)
    for c, chain in enumerate(chains):
        for t, (features, label) in enumerate(chain):
            x[c, t, features], y[c, t], mask[c, t] = 1, label, True
    model = Model(np.zeros(width), np.zeros((2, 2)))
    rate_w, rate_b = np.full(width, 1e-8), np.full((2, 2), 1e-8)
    pairs = mask[:, 1:]
    for _ in range(rounds):
        score = np.zeros((len(chains), longest, 2))
        score[..., 1] = x @ model.weights
        ahead = np.zeros_like(score)
        ahead[:, 0] = score[:, 0]
        for t in range(1, longest):
            step = np.logaddexp.reduce(ahead[:, t - 1, :, None] + model.between, axis=1) + score[:, t]
            ahead[:, t] = np.where(mask[:, t, None], step, ahead[:, t - 1])
        behind = np.zeros_like(score)
        for t in range(longest - 2, -1, -1):
            step = np.logaddexp.reduce(model.between + (score[:, t + 1] + behind[:, t + 1])[:, None, :], axis=2)
            behind[:, t] = np.where(mask[:, t + 1, None], step, 0)
        total = np.logaddexp.reduce(ahead[:, -1], axis=1)[:, None]
        one = np.where(mask, np.exp(ahead[..., 1] + behind[..., 1] - total), 0)
        joint = np.exp(ahead[:, :-1, :, None] + model.between + (score[:, 1:] + behind[:, 1:])[:, :, None, :] - total[..., None, None])
        joint = np.where(pairs[..., None, None], joint, 0).sum((0, 1))
        seen = np.zeros((2, 2))
        np.add.at(seen, (y[:, :-1][pairs], y[:, 1:][pairs]), 1)
        size = mask.sum()
        slope_w = np.einsum("ct,ctf->f", np.where(mask, y, 0) - one, x) / size - ridge * model.weights
        slope_b = (seen - joint) / size - ridge * model.between
        rate_w += slope_w**2
        rate_b += slope_b**2
        model.weights += 0.5 * slope_w / np.sqrt(rate_w)
        model.between += 0.5 * slope_b / np.sqrt(rate_b)
    return model


def train_on(pages: DataFrame, train_pages: int = TRAIN_PAGES) -> Model:
    """A model from at most `train_pages` pages, those of smallest hash, and the seeds."""
    hashed = pages.filter(F.length("html") <= TRAIN_CHARS).select("html", F.xxhash64("page_id", "url").alias("h"))
    # the hashes choose first, so that tasks send numbers to the driver, not each its own candidate pages
    edge = hashed.select("h").orderBy("h").limit(train_pages).agg(F.max("h").alias("h")).first().h
    if edge is None:
        return train([])
    sample = hashed.filter(F.col("h") <= edge).select("html", "h").orderBy("h", F.length("html")).limit(train_pages)
    return train([r.html for r in sample.collect()])


def main_texts(pages: DataFrame, train_pages: int = TRAIN_PAGES, model: Model | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of pages (page_id, url, html); a scan without a shuffle."""
    model = model or train_on(pages, train_pages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for page in batch.column("html").to_pylist():
                blocks = leaf_blocks(page or "")
                texts.append(" ".join(b.text for b, keep in zip(blocks, model.content(blocks), strict=True) if keep))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    kind = dict(pages.dtypes)["page_id"]
    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
