"""Main text of HTML pages from flat text blocks.

A page is read as a flat run of text blocks, each with its number of words, its link density, those
of its neighbours, and whether an article or a boilerplate container is open around it. A decision
tree, trained on the blocks of a small table of labelled markup, tells content from the rest: what
lies in a boilerplate container is never content, the rest is judged by words and link density."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache
from html import unescape
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfare.llm.common import short_batches

#: HTML element names and the words that name boilerplate in class, id and role.
SKIPPED = "script style noscript template title textarea select option button svg iframe object audio video canvas math".split()
#: Of those, the ones that a /> closes, and the ones that a missing end tag leaves open to the end of the page.
FOREIGN, TO_THE_END = {"svg", "math"}, {"script", "style", "title", "textarea"}
BLOCKS = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
CONTAINERS = set("article aside blockquote details dialog div dl fieldset figure footer form header main menu nav ol p section span table td tr ul li".split())
BOILER_TAGS = set("nav aside footer form dialog menu".split())
BOILER_WORDS = set(
    "ad ads adv advert adverts advertisement advertising alert banner breadcrumb breadcrumbs comment comments consent contentinfo cookie cookies "
    "complementary dialog disclaimer disqus footer form header legal login masthead menu modal nav navbar navigation newsletter notice notices notification "
    "overlay pagination pager popup promo promotion related replies reply search share sharing sidebar signup site-header social sponsor sponsored subscribe "
    "subscription toolbar topbar widget widgets".split()
)
TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|</?[a-zA-Z](?:[^>\"']|\"[^\"<]*+(?:<[^\"]{0,2000}+)?\"|'[^'<]*+(?:<[^']{0,2000}+)?')*+(?:>|$)|</?[a-zA-Z][^<>]*(?:>|(?=<)|$)|<", re.S)
NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
ATTRIBUTE = re.compile(r"\s(class|id|role|hidden|style|aria-hidden)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?(?=[\s/>])", re.I)
SKIP_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in SKIPPED}


@dataclass
class Block:
    text: str
    words: int
    linked: int
    article: bool
    boiler: bool
    heading: bool


def _closes(html: str, at: int, name: str) -> bool:
    """Whether the element of this name that is open at this place has an end tag of its own."""
    depth = 0
    for m in re.finditer(rf"<(/?){name}(?=[\s/>])", html[at:], re.I):
        depth += -1 if m[1] else 1
        if depth < 0:
            return True
    return False


def _is_boiler(tag: str, name: str, in_article: bool) -> bool:
    if name in BOILER_TAGS or name == "header" and not in_article:
        return True
    for key, value in ATTRIBUTE.findall(tag):
        key, value = key.lower(), value.strip("\"'").lower()
        if key == "hidden" or key == "aria-hidden" and value == "true":
            return True
        if key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True
        if key in ("class", "id", "role") and BOILER_WORDS.intersection(re.split(r"[^a-z0-9]+", value)):
            return not (in_article and name == "header")
    return False


def blocks(html: str | None) -> list[Block]:
    """The page's non-empty text blocks in order. Broken markup is read as far as it goes: a boilerplate
    element that is never closed ends with the page or where an article begins. An attribute's quotes
    may be missing their end: the tag ends at its > then."""
    html, out, stack = html or "", [], []  # stack of (name, article, boiler)
    parts: list[str] = []
    linked, depth_a, heading = 0, 0, False

    def words_of(text: str) -> int:
        return len(text.split())

    def flush():
        nonlocal linked
        text = " ".join(unescape("".join(parts)).split())
        if text:
            out.append(Block(text, words_of(text), min(linked, words_of(text)), any(s[1] for s in stack), any(s[2] for s in stack), heading))
        parts.clear()
        linked = 0

    at = 0
    while True:
        match = TOKEN.search(html, at)
        text = html[at : match.start() if match else len(html)]
        if text:
            parts.append(text)
            if depth_a:
                linked += words_of(text)
        if not match:
            break
        tag, at = match[0], match.end()
        if tag == "<":
            parts.append("<")
            continue
        if not (named := NAME.match(tag)):
            continue
        name, closing = named[1].lower(), tag[1] == "/"
        if name in SKIP_END and not closing:
            end = None if name in FOREIGN and tag.endswith("/>") else SKIP_END[name].search(html, at)
            if end:
                at = end.start()
            elif name in TO_THE_END:
                at = len(html)
            continue
        if name == "a":
            depth_a = 0 if closing else 1
        if name == "br":
            parts.append(" ")
        if name in BLOCKS:
            flush()
            heading = not closing and re.fullmatch("h[1-6]", name) is not None
        if name in CONTAINERS and not tag.endswith("/>"):
            if closing:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == name:
                        del stack[i:]
                        break
            else:
                main = name in ("article", "main")
                if main and any(b for _, _, b in stack):
                    stack = [(n, a, b and _closes(html, at, n)) for n, a, b in stack]
                if name in ("p", "li"):  # an open one ends here
                    for i in range(len(stack) - 1, -1, -1):
                        if stack[i][0] == name:
                            del stack[i:]
                        elif stack[i][0] != "span":
                            break
                boiler = _is_boiler(tag, name, any(s[1] for s in stack))
                if boiler and name == "span":
                    flush()
                stack.append((name, main, boiler))
    flush()
    return out


#: The labelled table: pages apart by blank lines, + or - (content or not) before each piece of markup, and #n for n words.
LABELLED = """
- <nav><ul><li><a>#1</a><li><a>#2</a><li><a>#1</a></ul></nav>
- <div class=ad>#12</div>
+ <article><h1>#8</h1><p>#60</p><p>#3</p><p>#90</p>
+ <ul><li>#4</li><li>#9</li></ul>
- <aside>#30</aside>
+ <p>#25 <a>#12</a></p></article>
- <section class=comments><p>#40</p><p>#12</p></section>
- <footer>#14</footer>

- <header><p>#3</p></header><p>#22</p>
+ <main><h1>#2</h1><p>#1</p><p>#1</p></main>
- <p>#35</p><div>#9 <a>#2</a></div>

- <div>#4</div>
+ <article><p>#12</p><h2>#3</h2><p>#70</p>
- <ul><li><a>#3</a></li><li><a>#5</a></li><li><a>#2</a></li></ul>
+ <p>#45</p><blockquote>#20</blockquote>
- <ul><li><a>#6</a></li><li><a>#4</a></li></ul></article>
- <p>#50</p>

- <h3>#2</h3>
+ <main><h1>#5</h1><p><a>#3</a></p><p>#40</p><p>#18 <a>#9</a></p>
- <div class=share><a>#1</a></div><form>#8</form>
+ <p>#2</p></main>

+ <article><h1>#6</h1><p>#20</p><p><a>#8</a></p><p>#40</p><p>#2</p><p><a>#4</a></p><p>#30</p>
+ <p>#50</p><p><a>#2</a></p><p>#9</p></article>

- <nav><a>#1</a> <a>#1</a> <a>#2</a></nav>
- <div class=cookie-banner>#24</div>
+ <h1>#7</h1><p>#55</p><h2>#2</h2><p>#80</p><p>#6</p><p>#33</p>
- <div id=related><p>#11</p></div>
- <footer>#13</footer>

- <div><a>#1</a> <a>#1</a> <a>#1</a></div>
+ <div>#9</div><div>#48</div><div>#20 <a>#4</a></div><div>#75</div>
- <div><a>#2</a> <a>#3</a></div>

- <div>#1</div><ul><li><a>#2</a></li><li><a>#1</a></li><li><a>#3</a></li></ul>
+ <h2>#6</h2><div>#30</div><div>#4</div><div>#64</div>
- <h3>#2</h3><ul><li><a>#7</a></li><li><a>#8</a></li></ul>

- <table><tr><td><a>#1</a></td><td><a>#2</a></td><td><a>#1</a></td></tr></table>
+ <table><tr><td>#45</td></tr><tr><td>#8</td></tr><tr><td>#95</td></tr></table>
- <table><tr><td><a>#2</a></td><td><a>#1</a></td></tr></table>

+ <p>#2</p>

+ <h1>#3</h1><p>#5</p>

+ <p>#1</p><p>#2</p><p>#4</p>

+ <div>#15</div><div>#3</div>
- <footer>#6</footer>

- <div class=notice>#30</div>
+ <p>#9</p>
- <div class=newsletter>#12</div>

- <a>#1</a>

- <p><a>#2</a></p><p><a>#4</a></p>
+ <p>#16</p>

- <div><a>#3</a> #1</div>
+ <p>#40</p><ul><li>#3</li><li>#5</li><li>#2</li></ul><p>#28</p>
- <p><a>#6</a> #1</p><p><a>#5</a></p>

- <li><a>#1</a><li><a>#1</a>
+ <h1>#10</h1><p>#120</p><p>#7</p>
- <div class="site-footer"><p>#20</p><p>#4</p></div>

- <div role=dialog><p>#26</p></div>
+ <h1>#4</h1><p>#14</p><p>#22 <a>#3</a></p><h2>#1</h2><p>#11</p>
- <div id=sidebar><h3>#2</h3><p>#45</p></div>
- <section class=comments><h3>#2</h3><p>#19</p><p>#60</p></section>

- <ul><li><a>#4</a></li><li><a>#3</a></li></ul>
+ <h1>#2</h1><p>#3</p><p>#36 <a>#14</a></p><p>#52</p>
+ <p>#2</p>
- <ul><li><a>#2</a></li><li><a>#2</a></li></ul>

+ <p>#40</p>
- <ul><li><a>#2</a></li><li><a>#6</a></li></ul>
+ <p>#30</p>

+ <article><p>#30</p>
- <ul><li><a>#1</a></li><li><a>#2</a></li></ul>
+ <p>#2</p></article>

+ <p>#70</p><p>#3</p>
- <ul><li><a>#2</a></li><li><a>#6</a></li></ul>

+ <h2>#2</h2><p>#90</p><p>#45</p>
- <div><a>#2</a></div><div><a>#3</a></div>

+ <p>#26</p><p>#3</p>
- <ul><li><a>#1</a></li><li><a>#3</a></li></ul>
"""
FEATURES = 9


def labelled_blocks() -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the labelled markup's blocks, each page in three lengths."""
    rows, labels = [], []
    for page, times in product(LABELLED.strip().split("\n\n"), (0.6, 1.0, 1.7)):
        html = ""
        for line in page.splitlines():
            word = "good " if line[0] == "+" else "bad "
            html += re.sub(r"#(\d+)", lambda m, w=word, x=times: (w * max(1, int(int(m[1]) * x))).strip(), line[2:])
        found = blocks(html)
        rows += [features_of(found, i) for i in range(len(found))]
        labels += [b.text.startswith("good") for b in found]
    return np.array(rows, float), np.array(labels, float)


def train_tree(rows: np.ndarray, labels: np.ndarray, depth: int = 7, leaf: int = 3):
    """A CART tree by Gini impurity: nested (feature, threshold, low, high), or a label. No side of a
    split has fewer than leaf rows."""
    share = labels.mean()
    if depth == 0 or share in (0, 1):
        return int(share >= 0.5)
    best = None
    for f in [*range(rows.shape[1])][::-1]:  # of equal splits the one on markup
        values = np.unique(rows[:, f])
        for threshold in (values[1:] + values[:-1]) / 2:
            low = rows[:, f] <= threshold
            if min(low.sum(), (~low).sum()) < leaf:
                continue
            impurity = sum(own.sum() * labels[own].mean() * (1 - labels[own].mean()) for own in (low, ~low))
            if best is None or impurity < best[0] - 1e-12:
                best = (impurity, f, float(threshold), low)
    if best is None:
        return int(share >= 0.5)
    _, f, threshold, low = best
    return f, threshold, train_tree(rows[low], labels[low], depth - 1, leaf), train_tree(rows[~low], labels[~low], depth - 1, leaf)


@lru_cache(maxsize=1)
def default_tree():
    return train_tree(*labelled_blocks())


def is_content(tree, features: list[float]) -> bool:
    while isinstance(tree, tuple):
        f, threshold, low, high = tree
        tree = low if features[f] <= threshold else high
    return bool(tree)


def features_of(page: list[Block], i: int) -> list[float]:
    out: list[float] = []
    for k in (i, i - 1, i + 1):
        b = page[k] if 0 <= k < len(page) else None
        out += [b.words, b.linked / max(1, b.words)] if b else [0, 0.0]
    article = 1.0 if page[i].article else -1.0 if any(b.article for b in page) else 0.0
    return [*out, article, float(page[i].boiler), float(page[i].heading)]


def main_text(html: str | None, tree=None) -> str:
    """Content blocks joined by a line feed."""
    tree = tree or default_tree()
    page = blocks(html)
    return "\n".join(b.text for i, b in enumerate(page) if is_content(tree, features_of(page, i)))


def extract(pages: DataFrame, tree=None) -> DataFrame:
    """pages plus text and n_chars (code points). A null or empty html gives an empty text; extra
    columns are kept, text and n_chars replaced; repeated rows give equal results; empty tables give
    no rows."""
    short_batches(pages.sparkSession, 500)
    tree = tree or default_tree()

    @F.pandas_udf("string")
    def read(html: pd.Series) -> pd.Series:
        return pd.Series([main_text(h, tree) for h in html], dtype=object)

    out = pages.drop("text", "n_chars").withColumn("text", read(F.col("html")))
    return out.withColumn("n_chars", F.length("text").cast("long"))
