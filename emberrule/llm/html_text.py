"""Main text of web pages by the maximum-scoring run of tokens.

A page is a sequence of words, which score positive, and tags, which score negative. How much each counts is
learnt from labelled pages, those that mark their article as such: tags by name, words by the element that holds them and
by the nearest element around them that has a class or id. One linear scan finds the best contiguous run.
Menus, forms and other parts that are never text are left out wherever they stand, with their tags.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hash_sample, text_of

# Elements by kind, as the HTML standard and common usage have them.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe xmp noembed noframes svg math object select button".split())
ASIDE = frozenset("nav header footer aside form head dialog menu".split()) | RAW
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th "
    "thead tr ul".split()
)
CLOSES_P = BLOCK - {"br", "html", "body", "head"}
#: Words in class, id or role that mark a part as no text of the article.
NOISE = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisement|advertising|banner|breadcrumbs?|comments?|commentlist|cookies?|consent|disqus|"
    r"disclaimer|footer|gdpr|header|login|masthead|menu|modal|nav|navbar|navigation|newsletter|notice|pagination|pager|popup|promo|"
    r"promoted|related|respond|replies|share|sharing|sidebar|signup|skip|social|sponsor|sponsored|subscribe|toolbar|widget)(?=$|[\s_-])",
    re.I,
)
ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
MARKUP = re.compile(
    r"<!--(?:.*?-->|.*\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+(?:>|\Z)|[^>]*(?:>|\Z))|<[!?][^>]*(?:>|\Z)|</[^a-zA-Z][^>]*(?:>|\Z)", re.S
)
RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in RAW}
#: Blocks that hold text for the element around them.
PARAGRAPH = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th pre blockquote figcaption caption address br hr".split())
DIGITS = re.compile(r"[0-9]+")
#: Weights where no labelled page is at hand, and their range; a word's is negative where labelled pages have no article.
PRIOR = {"tag": 1.5, "word": 1.0}
LEAST_TAG, MOST_TAG, LEAST_WORD = 0.1, 10.0, -1.0
#: Words that stand for the whole sample's mean beside those counted.
FEW_WORDS = 20.0
#: What it is worth, in words, that a block stands in the element that holds most of the run.
BELONGS = 6.0


def marks_of(name: str, attributes: str) -> tuple[bool, str]:
    """Whether an element is no text by its name or marks, and its class or id, digits left out, with its name."""
    noise, place = name in ASIDE, ""
    if noise or len(attributes) < 3:
        return noise, place
    for key, value in ATTRIBUTE.findall(attributes):
        key, value = key.lower(), value.strip("\"'")
        if key in ("class", "id") and value.strip() and (not place or key == "class"):
            place = f"{name}.{DIGITS.sub('', ' '.join(sorted(value.split())))}"
        if key == "hidden" or (key == "aria-hidden" and value.lower() == "true") or (key in ("class", "id", "role") and NOISE.search(value)):
            noise = name not in ("html", "body", "main", "article") or noise
    return noise, place


def tokens(page: str) -> Iterator[tuple[str, str, bool, str]]:
    """(kind, value, noise, place): kind is ``<`` or ``/`` for an opening or closing tag, else the element that holds the text.

    An opening tag is closed by its own closing tag, by that of an element around it, or by nothing if it is void.
    """
    stack: list[tuple[str, bool, str]] = []  # open elements, whether they or one around them are noise, and where they stand
    count: Counter[str] = Counter()
    at, end = 0, len(page)

    def shut(name: str) -> None:
        while stack:
            top, _, _ = stack.pop()
            count[top] -= 1
            if top == name:
                return

    while at < end:
        m = MARKUP.search(page, at)
        upto = m.start() if m else end
        noise = bool(stack) and stack[-1][1]
        if upto > at:
            yield stack[-1][0] if stack else "", page[at:upto], noise, stack[-1][2] if stack else ""
        if m is None:
            return
        at = m.end()
        if m[2] is None:
            continue
        name = m[2].lower()
        if m[1]:
            if count[name]:
                noise = any(x == name and n for x, n, _ in reversed(stack)) if noise else False
                shut(name)
            yield "/", name, noise, ""
            continue
        if name in CLOSES_P and count["p"]:
            shut("p")
        elif name in ("li", "dt", "dd", "tr", "td", "th", "option") and stack and stack[-1][0] == name:
            shut(name)
        own, place = marks_of(name, m[3])
        noise = (bool(stack) and stack[-1][1]) or own
        yield "<", name, noise, place
        if name in RAW:
            close = RAW_END[name].search(page, at)
            at = close.start() if close else end
            if close:
                at = page.find(">", at) + 1 or end
        elif name not in VOID and not m[3].endswith("/>"):
            stack.append((name, noise, place or (stack[-1][2] if stack else "")))
            count[name] += 1


def fit(pages: Iterable[str]) -> dict[str, dict[str, float]]:
    """Weights of tags, and of words by element and by place, from pages with exactly one article element."""
    kinds = ("tag", "word", "place")
    inside, outside = {k: Counter() for k in kinds}, {k: Counter() for k in kinds}
    for page in pages:
        found = list(tokens(page))
        if sum(k == "<" and v == "article" for k, v, *_ in found) != 1:
            continue
        within = False
        for kind, value, noise, place in found:
            if kind in ("<", "/"):
                within = within and not (kind == "/" and value == "article")
                if not noise:
                    (inside if within else outside)["tag"][value] += 1
                within = within or (kind == "<" and value == "article")
            elif not noise:
                n = len(value.split())
                side = inside if within else outside
                side["word"][kind] += n
                side["place"][place] += n
    words = [sum(x["word"].values()) for x in (inside, outside)]
    out: dict[str, dict[str, float]] = {k: {} for k in kinds}
    for kind in kinds:
        for name in sorted(x for x in inside[kind] | outside[kind] if inside[kind][x] + outside[kind][x]):
            rate = (inside[kind][name] + outside[kind][name]) / max(1, sum(words))  # what either side is taken to have where it has few words
            odds = math.log((inside[kind][name] + FEW_WORDS * rate) / (words[0] + FEW_WORDS)) - math.log((outside[kind][name] + FEW_WORDS * rate) / (words[1] + FEW_WORDS))
            out[kind][name] = min(MOST_TAG, max(LEAST_TAG, PRIOR["tag"] - odds)) if kind == "tag" else odds / 4
    return out


class Block:
    """A block of text: its pieces, words, score, what the tags before it cost, and the element that holds it."""

    __slots__ = ("pieces", "words", "score", "cost", "holder")

    def __init__(self, cost: float, holder: int):
        self.pieces: list[str] = []
        self.words, self.score, self.cost, self.holder = 0, 0.0, cost, holder


def _blocks(page: str, weights: dict[str, dict[str, float]]) -> tuple[list[Block], dict[int, tuple[int, int]]]:
    """The blocks of a page that have words and aren't noise, and of each element that holds some directly the first and last within it."""
    tag, element, places = (weights.get(k, {}) for k in ("tag", "word", "place"))
    blocks: list[Block] = []
    opened: list[tuple[str, int, int]] = []  # open block elements: name, number, blocks before
    count: Counter[str] = Counter()
    ranges: dict[int, tuple[int, int]] = {}
    number, cost, block = 0, 0.0, None
    for kind, value, noise, place in tokens(page):
        if kind not in ("<", "/"):
            n = 0 if noise else len(value.split())
            if not noise and (n or block):
                if block is None:
                    at = len(opened) - 1
                    while at > 0 and opened[at][0] in PARAGRAPH:
                        at -= 1
                    block = Block(cost, opened[at][1] if opened else 0)
                    blocks.append(block)
                    cost = 0.0
                weight = PRIOR["word"] + element.get(kind, 0.0) + places.get(place, 0.0)
                block.pieces.append(value)
                block.words += n
                block.score += min(1.0, max(LEAST_WORD, weight)) * n - cost
                cost = 0.0
            continue
        if value in BLOCK:
            block = None
            if kind == "<" and value not in VOID:
                number += 1
                opened.append((value, number, len(blocks)))
                count[value] += 1
            elif kind == "/" and count[value]:
                while opened:
                    name, own, before = opened.pop()
                    count[name] -= 1
                    ranges[own] = (before, len(blocks))
                    if name == value:
                        break
        if not noise:
            cost += tag.get(value, PRIOR["tag"])
    ranges |= {own: (before, len(blocks)) for _, own, before in opened}
    ranges[0] = (0, len(blocks))
    return blocks, ranges


def best_run(blocks: list[Block], ranges: dict[int, tuple[int, int]]) -> tuple[int, int]:
    """The run of blocks of the highest score, then what follows and precedes it in the element that holds most of its words.

    There a block joins if its words score positive and, with those between, make up for the tags but for BELONGS.
    """
    sums, best, start, run = 0.0, 0.0, 0, (0, 0)
    for i, b in enumerate(blocks):
        sums -= b.cost
        if sums <= 0:
            sums, start = 0.0, i
        sums += b.score
        if sums > best:
            best, run = sums, (start, i + 1)
    low, high = run
    held: Counter[int] = Counter()
    for b in blocks[low:high]:
        held[b.holder] += b.words
    if not held:
        return run
    holder = min(held, key=lambda h: (-held[h], h))
    first, last = ranges[holder]
    sums = 0.0
    for i in range(high, max(high, last)):
        sums += blocks[i].score - blocks[i].cost
        if blocks[i].score > 0 and sums + BELONGS > 0:
            high, sums = i + 1, 0.0
    sums = 0.0
    for i in range(low - 1, min(low, first) - 1, -1):
        sums += blocks[i].score - blocks[i + 1].cost
        if blocks[i].score > 0 and sums + BELONGS > 0:
            low, sums = i, 0.0
    return low, high


def extract(page: str, weights: dict[str, dict[str, float]] | None = None) -> str:
    """The text of the best run of blocks; blocks' white space is one space, and one space stands between blocks."""
    blocks, ranges = _blocks(page, weights or {})
    low, high = best_run(blocks, ranges)
    texts = (" ".join(html.unescape("".join(b.pieces)).split()) for b in blocks[low:high])
    return " ".join(t for t in texts if t)


def extract_pages(pages: DataFrame, sample: int = 512) -> DataFrame:
    """One row for each row of ``pages``: page_id, url, text, n_chars.

    Weights are learnt from at most ``sample`` different pages with an article element, those of least hash; without any,
    fixed ones are used. Null or empty html, and pages without text, give an empty text. Unclosed
    tags, comments and cut-off pages are read to their end. Repeated rows give repeated rows. No rows give no rows. Other columns
    are ignored.
    """
    labelled = pages.filter(F.col("html").contains("<article")).select(F.xxhash64("html").alias("h"), "html")
    n = labelled.select("h").distinct().count()
    chosen = hash_sample(labelled, F.col("h"), n, sample).distinct().collect()
    weights = fit(r["html"] for r in sorted(chosen)[:sample])
    kind = pages.schema["page_id"].dataType.simpleString()

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            text = [extract(x, weights) for x in b["html"]]
            yield pd.DataFrame({"page_id": b["page_id"], "url": b["url"], "text": text, "n_chars": [len(t) for t in text]})

    rows = pages.select("page_id", "url", text_of("html").alias("html"))
    return rows.mapInPandas(read, f"page_id {kind}, url string, text string, n_chars long")
