"""Main-text extraction from HTML by classifying flat text blocks (operator 2).

A page becomes a flat list of text blocks.  Each block has its word count, its link density, both of
its neighbours' values, whether it stands inside an article, and how strongly the markup around it hints at furniture
(menus, footers, adverts, comments, ...): 2 where an element or a class is named so, 1 where such a word is only part of
another name ('share-enabled', 'with-comments'), 0 else.  A small decision tree, grown
on the labelled table below, tells main text from the rest; main blocks are joined in page order.

Defined results: a null or empty page gives an empty text; markup cut off at the end of the page is
dropped, unclosed elements end with the page; repeated pages give repeated rows; a null page_id or
url is carried; extra columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element names of HTML by their role.
RAW = frozenset("script style noscript template svg iframe textarea select title object math canvas audio video".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
FURNITURE = frozenset("nav header footer aside form button fieldset menu dialog head legend".split())
MAIN = frozenset("article main".split())

# Words of class and id names that tell furniture, and words that leave the sense of a name as it is.
HINT = frozenset(
    "nav navbar navigation menu menus header footer foot masthead sidebar aside ad ads advert adverts advertisement advertisements advertising banner promo promos promotion promotions sponsor sponsors sponsored "
    "cookie cookies cc notice notices consent gdpr popup modal overlay alert newsletter subscribe subscription comment comments reply replies respond responses feedback disqus discussion login signin signup search share sharing social "
    "breadcrumb breadcrumbs related recommend recommended recommendations widget widgets toolbar pagination pager copyright skip toc".split()
)
NEUTRAL = frozenset("a the of and list section box wrapper wrap container block area left right top bottom item items inner outer site page global main primary secondary slot unit bar panel link links holder row col column content text body button icon small large first last js wp id desktop mobile window thread threads".split())
WORDS_OF_NAME = re.compile(r"[a-z]+")
ROLE = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<!--.*?(?:--!?>|\Z)|<[!?/][^>]*(?:>|\Z)|<[a-zA-Z][^>]*(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([a-zA-Z-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")

#: words, link density, words and link density before, words and link density after, in an article, hint; main text or not.
LABELLED = [
    # articles of news pages: head line, long and short paragraphs, list items
    (8, 0.0, 3, 1.0, 60, 0.0, 1, 0, 1), (62, 0.0, 8, 0.0, 55, 0.02, 1, 0, 1), (55, 0.02, 62, 0.0, 4, 0.0, 1, 0, 1), (4, 0.0, 55, 0.02, 71, 0.0, 1, 0, 1), (71, 0.0, 4, 0.0, 9, 0.0, 1, 0, 1),
    (2, 0.0, 71, 0.0, 48, 0.0, 1, 0, 1), (1, 0.0, 6, 0.0, 7, 0.0, 1, 0, 1), (1, 0.0, 0, 0.0, 0, 0.0, 1, 0, 1), (120, 0.0, 0, 0.0, 0, 0.0, 1, 0, 1), (6, 1.0, 40, 0.0, 38, 0.0, 1, 0, 1), (3, 1.0, 2, 0.0, 5, 0.0, 1, 0, 1), (30, 0.3, 44, 0.0, 20, 0.1, 1, 0, 1),
    (9, 0.0, 1, 1.0, 30, 0.0, 1, 0, 1), (12, 0.4, 1, 1.0, 1, 1.0, 1, 0, 1), (5, 0.0, 2, 1.0, 2, 1.0, 1, 0, 1), (14, 1.0, 30, 0.0, 0, 0.0, 1, 0, 1), (4, 1.0, 25, 0.0, 1, 1.0, 1, 0, 1), (25, 0.0, 9, 0.0, 2, 1.0, 1, 0, 1), (3, 0.0, 20, 0.0, 0, 0.0, 1, 0, 1),
    # lists of links inside articles: tags, further reading, tables of contents
    (1, 1.0, 1, 1.0, 1, 1.0, 1, 0, 0), (2, 1.0, 1, 1.0, 3, 1.0, 1, 0, 0), (4, 1.0, 3, 1.0, 5, 1.0, 1, 0, 0), (6, 0.9, 7, 1.0, 6, 0.9, 1, 0, 0), (2, 1.0, 4, 1.0, 2, 0.9, 1, 0, 0), (9, 1.0, 8, 1.0, 10, 1.0, 1, 0, 0),
    # furniture, inside articles too: menus, footers, adverts, notices, comments, forms
    (1, 1.0, 0, 0.0, 1, 1.0, 0, 2, 0), (2, 1.0, 1, 1.0, 1, 1.0, 0, 2, 0), (12, 0.0, 1, 1.0, 9, 0.0, 0, 2, 0), (45, 0.0, 60, 0.0, 0, 0.0, 0, 2, 0), (14, 0.2, 33, 0.0, 0, 0.0, 0, 2, 0), (80, 0.0, 52, 0.0, 41, 0.0, 0, 2, 0),
    (25, 0.0, 70, 0.0, 66, 0.0, 1, 2, 0), (90, 0.0, 70, 0.0, 66, 0.0, 1, 2, 0), (3, 1.0, 70, 0.0, 22, 0.0, 1, 2, 0), (7, 0.0, 0, 0.0, 50, 0.0, 1, 2, 0), (1, 0.0, 0, 0.0, 9, 0.0, 1, 2, 0), (6, 0.0, 4, 1.0, 33, 0.0, 0, 2, 0),
    (40, 0.0, 2, 1.0, 50, 0.0, 0, 2, 0), (150, 0.0, 80, 0.0, 90, 0.0, 0, 2, 0), (20, 0.5, 8, 0.0, 5, 1.0, 0, 2, 0), (120, 0.0, 0, 0.0, 0, 0.0, 1, 2, 0),
    # names that only hold such a word: articles that can be shared or have comments, pages with a sidebar
    (9, 0.0, 2, 1.0, 50, 0.0, 1, 1, 1), (50, 0.0, 9, 0.0, 45, 0.0, 1, 1, 1), (45, 0.05, 50, 0.0, 3, 0.0, 1, 1, 1), (3, 0.0, 45, 0.0, 60, 0.0, 1, 1, 1), (50, 0.0, 0, 0.0, 0, 0.0, 1, 1, 1),
    (50, 0.0, 0, 0.0, 0, 0.0, 0, 1, 1), (40, 0.0, 6, 0.0, 38, 0.0, 0, 1, 1), (60, 0.1, 40, 0.0, 2, 1.0, 0, 1, 1), (25, 0.0, 40, 0.0, 30, 0.0, 0, 1, 1), (8, 0.0, 2, 1.0, 55, 0.0, 0, 1, 1), (6, 0.0, 44, 0.0, 51, 0.0, 0, 1, 1),
    (2, 1.0, 1, 1.0, 2, 1.0, 0, 1, 0), (3, 1.0, 2, 1.0, 30, 0.0, 0, 1, 0), (4, 0.5, 1, 1.0, 3, 1.0, 0, 1, 0), (2, 0.0, 1, 1.0, 2, 1.0, 0, 1, 0), (1, 1.0, 1, 1.0, 1, 1.0, 1, 1, 0), (3, 1.0, 4, 1.0, 2, 1.0, 1, 1, 0),
    # pages without a marked article: length and links tell
    (50, 0.0, 6, 0.0, 47, 0.0, 0, 0, 1), (47, 0.05, 50, 0.0, 60, 0.0, 0, 0, 1), (9, 0.0, 52, 0.0, 41, 0.0, 0, 0, 1), (5, 0.0, 36, 0.0, 58, 0.0, 0, 0, 1), (7, 0.0, 2, 1.0, 64, 0.0, 0, 0, 1), (22, 0.1, 40, 0.0, 30, 0.0, 0, 0, 1), (16, 0.0, 48, 0.0, 3, 0.5, 0, 0, 1), (34, 0.0, 1, 1.0, 2, 1.0, 0, 0, 1),
    (30, 0.0, 40, 0.0, 0, 0.0, 0, 0, 1), (45, 0.0, 50, 0.0, 0, 0.0, 0, 0, 1), (60, 0.0, 0, 0.0, 0, 0.0, 0, 0, 1), (28, 0.0, 35, 0.0, 4, 1.0, 0, 0, 1), (40, 0.0, 2, 1.0, 0, 0.0, 0, 0, 1), (38, 0.0, 1, 1.0, 30, 0.0, 0, 0, 1), (25, 0.05, 60, 0.0, 3, 0.8, 0, 0, 1),
    # a page that holds one short paragraph and nothing else
    (1, 0.0, 0, 0.0, 0, 0.0, 0, 0, 1), (4, 0.0, 0, 0.0, 0, 0.0, 0, 0, 1), (9, 0.0, 0, 0.0, 0, 0.0, 0, 0, 1), (16, 0.2, 0, 0.0, 0, 0.0, 0, 0, 1),
    (1, 1.0, 1, 1.0, 1, 1.0, 0, 0, 0), (3, 1.0, 2, 1.0, 8, 0.0, 0, 0, 0), (4, 0.5, 2, 1.0, 3, 1.0, 0, 0, 0), (2, 0.0, 1, 1.0, 1, 1.0, 0, 0, 0), (6, 0.0, 3, 0.5, 4, 0.3, 0, 0, 0), (9, 0.9, 12, 0.8, 7, 1.0, 0, 0, 0), (20, 0.8, 14, 0.9, 25, 0.7, 0, 0, 0), (5, 0.0, 2, 0.0, 0, 0.0, 0, 0, 0), (30, 0.7, 50, 0.0, 40, 0.6, 0, 0, 0), (4, 0.0, 0, 0.0, 3, 1.0, 0, 0, 0), (3, 0.0, 5, 1.0, 2, 0.0, 0, 0, 0),
    (2, 1.0, 0, 0.0, 1, 1.0, 0, 0, 0), (2, 1.0, 0, 0.0, 0, 0.0, 0, 0, 0), (7, 0.0, 2, 1.0, 1, 1.0, 0, 0, 0), (4, 0.0, 2, 0.0, 1, 1.0, 0, 0, 0), (12, 1.0, 40, 0.0, 13, 1.0, 0, 0, 0), (5, 0.6, 30, 0.0, 4, 1.0, 0, 0, 0),
]


def labelled_table() -> np.ndarray:
    """LABELLED, and rows by rule: blocks of articles stay unless they are links among links, blocks of furniture go."""
    near = [(0, 0.0), (2, 1.0), (4, 0.0), (30, 0.0)]
    sizes = [(n, d) for n in (1, 2, 4, 9, 20, 60) for d in (0.0, 0.2, 1.0)]
    links = lambda *blocks: all(d > 0.5 for _, d in blocks)
    rows = [(*own, *a, *b, 1, hint, float(not links(own, a, b))) for own in sizes for a in near for b in near for hint in (0, 1)]
    rows += [(*own, *a, *b, article, 2, 0.0) for own in sizes for a in near for b in near for article in (0, 1)]
    return np.array([*LABELLED, *rows], float)


def grow(rows: np.ndarray, labels: np.ndarray, depth: int = 8) -> tuple:
    """A binary decision tree by Gini impurity: (feature, cut, left, right), or the share of main text at a leaf."""
    share = float(labels.mean())
    if depth == 0 or share in (0.0, 1.0):
        return (share,)
    best = None
    for feature in range(rows.shape[1]):
        values = np.unique(rows[:, feature])
        for cut in (values[1:] + values[:-1]) / 2:
            left = rows[:, feature] <= cut
            a, b = labels[left], labels[~left]
            loss = len(a) * a.mean() * (1 - a.mean()) + len(b) * b.mean() * (1 - b.mean())
            if best is None or loss < best[0] - 1e-12:
                best = (loss, feature, float(cut), left)
    if best is None:
        return (share,)
    _, feature, cut, left = best
    return feature, cut, grow(rows[left], labels[left], depth - 1), grow(rows[~left], labels[~left], depth - 1)


def classify(tree: tuple, row: tuple) -> bool:
    while len(tree) > 1:
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree[0] >= 0.5


def trained_tree() -> tuple:
    table = labelled_table()
    return grow(table[:, :-1], table[:, -1])


def hint_of(name: str) -> int:
    """0 to 2: how strongly a class or id name tells furniture."""
    strength = 0
    for part in name.lower().split():
        words = WORDS_OF_NAME.findall(part)
        told = [w in HINT for w in words]
        if any(told):
            plain = all(t or w in NEUTRAL for t, w in zip(told, words)) or (told[-1] and not any(w in ("with", "has", "no", "without") for w in words))
            strength = max(strength, 2 if plain else 1)
    return strength


def _hint(name: str, attributes: str) -> int:
    if name in FURNITURE:
        return 2
    strength = 0
    for key, a, b, c in ATTRIBUTE.findall(attributes) if attributes.strip() else ():
        key, value = key.lower(), a or b or c
        if key in ("class", "id"):
            strength = max(strength, hint_of(value))
        if key == "role" and value.lower() in ROLE or key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return 2
    return min(strength, 1) if name in MAIN else strength  # the name of an article does not make it furniture


def text_blocks(page: str) -> list[tuple[str, float, bool, int]]:
    """(text, link density, in an article, hint) of every flat block of a page."""
    blocks: list[tuple[str, float, bool, int]] = []
    open_: list[tuple[str, bool, int]] = []  # name, inside an article, strongest hint around
    parts: list[str] = []
    linked: list[str] = []
    link_depth = -1  # elements open where the present link began

    def flush() -> None:
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            n, of = len(text.split()), len(html.unescape(" ".join(linked)).split())
            _, article, hint = open_[-1] if open_ else ("", False, 0)
            blocks.append((text, min(1.0, of / n), article, hint))
        parts.clear()
        linked.clear()

    def say(text: str) -> None:
        parts.append(text)
        if link_depth >= 0:
            linked.append(text)

    def enter(name: str, attributes: str) -> None:
        _, article, hint = open_[-1] if open_ else ("", False, 0)
        open_.append((name, article or name in MAIN, max(hint, _hint(name, attributes))))

    at = 0
    while at < len(page):
        found = TAG.search(page, at)
        if not found:
            say(page[at:])
            break
        if found.start() > at:
            say(page[at : found.start()])
        at, name = found.end(), (found[2] or "").lower()
        if not name:
            continue
        closing = bool(found[1])
        if name in RAW and not closing and not found[3].endswith("/"):
            end = re.compile(rf"</{re.escape(name)}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if name in INLINE:
            if name == "a":
                link_depth = -1 if closing else len(open_)
            if closing and open_ and open_[-1][0] == name:
                flush()
                open_.pop()
            elif not closing and name not in VOID and (open_ and open_[-1][0] == name or _hint(name, found[3]) == 2):
                flush()  # an inline advert or notice is a block of its own
                enter(name, found[3])
            continue
        flush()
        if name in VOID:
            continue
        if closing:
            for i in range(len(open_) - 1, -1, -1):
                if open_[i][0] == name:
                    del open_[i:]
                    break
            if len(open_) < link_depth:  # a link ends with the element that it stands in
                link_depth = -1
        else:
            if name == "p" and open_ and open_[-1][0] == "p":
                open_.pop()
            enter(name, found[3])
    flush()
    return blocks


def main_text(page: str | None, tree: tuple) -> str:
    if not page:
        return ""
    blocks = text_blocks(page)
    shape = [(0, 0.0), *((len(text.split()), density) for text, density, _, _ in blocks), (0, 0.0)]
    kept = [
        block[0]
        for i, block in enumerate(blocks, 1)
        if classify(tree, (*shape[i], *shape[i - 1], *shape[i + 1], float(block[2]), float(block[3])))
    ]
    return " ".join(kept)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    tree = trained_tree()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = [main_text(h, tree) for h in pdf["html"]]
            yield pd.DataFrame({"page_id": pdf["page_id"].astype("Int64"), "url": pdf["url"], "text": texts})

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInPandas(run, "page_id long, url string, text string").withColumn("n_chars", F.char_length("text").cast("long"))
