"""Main text of web pages from flat text blocks and a decision tree.

A page is read once, left to right, into blocks: stretches of text between
block-level tags, each with its word count, link density, kind of tag and
whether an element around it speaks for or against it. A decision tree over
these and the counts and densities of the blocks before and after keeps or drops
each block. The tree is trained on the small labelled table in
``labelled_pages``.

Defined results: a null or empty page, and one without a kept block, has the
empty text. Unclosed comments and scripts reach to the end of the page; reading
takes time in proportion to a page's length, also if no tag is closed. Null ids
and repeated rows keep one result row each; an empty table has no rows. Other
columns are ignored.
"""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm.common import quoted, slices

FEATURES = [
    "words",
    "link_density",
    "words_before",
    "density_before",
    "words_after",
    "density_after",
    "against",
    "for",
    "heading",
    "item",
    "paragraph",
]
_HIDDEN = "script|style|noscript|template|svg|iframe|object|canvas|title|math|audio|video|select|textarea|button|datalist"
_MARKUP = re.compile(
    rf"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<({_HIDDEN})\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"<]*\"|'[^'<]*')*)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)>|<[!?][^>]*>",
    re.S | re.I,
)
_HIDDEN_TAIL = re.compile(r"(?:<!--|<!\[CDATA\[).*\Z", re.S | re.I)
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small "
    "span strike strong sub sup time tt u var wbr picture source input".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that may hold others and so stay on the stack.
_HOLDERS = frozenset(
    "nav header footer aside form article main section div ul ol dl table figure blockquote body dialog details menu "
    "fieldset center address tbody td th tr li".split()
)
_AGAINST_TAGS = frozenset("nav footer aside form dialog menu fieldset".split())
_FOR_TAGS = frozenset(["article", "main"])
_ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_HIDDEN_ATTRIBUTE = re.compile(r"display\s*:\s*none|aria-hidden\s*=\s*[\"']?true|\shidden(?=[\s=/]|$)", re.I)
_NAME = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_AGAINST = frozenset(
    "nav navbar navigation menu submenu sidebar sidebars aside rail footer foot bottom header masthead topbar breadcrumb breadcrumbs "
    "ad ads adv advert adverts advertisement advertising adsense banner banners promo promotion promotions sponsor "
    "sponsored sponsors cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe "
    "subscription signup login signin register social share sharing related recommend recommended recommendations "
    "more comment comments commentlist reply replies respond disqus discussion feedback widget widgets toolbar tools pagination pager "
    "search searchform skip legal copyright disclaimer tags tagcloud complementary contentinfo dialog outbrain taboola "
    "hidden form trending popular".split()
)
_FOR = frozenset("article content post entry story main body text page prose".split())
_LAYOUT = frozenset(["has", "with", "no", "without"])


def _opinion(tag: str, attributes: str, inside_for: bool) -> tuple[bool, bool]:
    """Whether an element speaks against or for what it holds."""
    against = tag in _AGAINST_TAGS or (tag == "header" and not inside_for)
    speaks_for = tag in _FOR_TAGS
    if attributes:
        if _HIDDEN_ATTRIBUTE.search(attributes):
            against = True
        for found in _ATTRIBUTE.finditer(attributes):
            value = found[2] or found[3] or found[4] or ""
            names = _NAME.findall(_CAMEL.sub("-", value).lower())
            for k, name in enumerate(names):
                if name in _FOR:
                    speaks_for = True
                elif name in _AGAINST and tag not in ("body", "main") and not (k and names[k - 1] in _LAYOUT):
                    # The heading of an article is part of it.
                    if not (name == "header" and (inside_for or (k and names[k - 1] in _FOR))):
                        against = True
    return against, speaks_for and not against


def _closed(found: re.Match) -> bool:
    """Whether hidden markup that ends at the last bracket of a page has its own end there."""
    text = found[0]
    if found[1]:
        return re.search(rf"</{found[1]}\s*>\Z", text, re.I) is not None
    if text.startswith("<!--"):
        return len(text) >= 7 and text.endswith("-->")
    if text[:9].upper() == "<![CDATA[":
        return len(text) >= 12 and text.endswith("]]>")
    return True


def blocks(page: str) -> list[tuple[str, int, int, float, bool, bool, str]]:
    """``(text, start, words, link density, against, for, tag)`` of each block in page order."""
    out = []
    stack: list[tuple[str, bool, bool]] = []
    against = speaks_for = False
    own = (False, False)
    tag, links = "", 0
    pieces: list[str] = []
    linked = start = position = 0
    filled = hidden_to_end = False
    # No tag can end behind the last bracket, so unclosed ones are not searched for there.
    last = page.rfind(">") + 1

    def close() -> None:
        nonlocal pieces, linked, filled
        if pieces:
            words = html.unescape("".join(pieces)).split()
            if words:
                density = min(1.0, linked / len(words))
                no = against or own[0]
                out.append((" ".join(words), start, len(words), density, no, (speaks_for or own[1]) and not no, tag))
        pieces, linked, filled = [], 0, False

    def add(text: str, at: int) -> None:
        nonlocal linked, start, filled
        if not filled:
            start = at
            filled = bool(text.strip())
        pieces.append(text)
        if links:
            linked += len(text.split())

    for found in _MARKUP.finditer(page, 0, last):
        if found.start() > position:
            add(page[position : found.start()], position)
        position = found.end()
        name = found[3] or found[6]
        if name is None:
            hidden_to_end = position == last and not _closed(found)
            continue
        name = name.lower()
        closing = (found[2] if found[3] else found[5]) == "/"
        attributes = (found[4] if found[3] else found[7]) or ""
        if name == "br":
            pieces.append(" ") if pieces else None
            continue
        if name in _INLINE:
            if name == "a":
                links = 0 if closing else 1
            continue
        close()
        own = (False, False)
        if closing:
            if name in _HOLDERS:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == name:
                        del stack[k:]
                        against = stack[-1][1] if stack else False
                        speaks_for = stack[-1][2] if stack else False
                        break
            tag, links = "", 0
        else:
            tag = name
            if attributes and name not in _HOLDERS:
                own = _opinion(name, attributes, speaks_for)
            if name in _HOLDERS and not attributes.endswith("/"):
                if name in ("li", "td", "th", "tr") and stack and stack[-1][0] == name:
                    stack.pop()
                    against = stack[-1][1] if stack else False
                    speaks_for = stack[-1][2] if stack else False
                no, yes = _opinion(name, attributes, speaks_for)
                against, speaks_for = against or no, (speaks_for or yes) and not no
                stack.append((name, against, speaks_for))
    if position < len(page) and not hidden_to_end:
        add(_HIDDEN_TAIL.sub("", page[position:]), position)
    close()
    return out


def block_features(found: list[tuple]) -> np.ndarray:
    """One row of ``FEATURES`` per block of a page."""
    n = len(found)
    x = np.zeros((n, len(FEATURES)))
    if not n:
        return x
    x[:, 0] = [b[2] for b in found]
    x[:, 1] = [b[3] for b in found]
    x[1:, 2:4] = x[:-1, 0:2]
    x[:-1, 4:6] = x[1:, 0:2]
    x[:, 6] = [b[4] for b in found]
    x[:, 7] = [b[5] for b in found]
    x[:, 8] = [len(b[6]) == 2 and b[6][0] == "h" and b[6][1].isdigit() for b in found]
    x[:, 9] = [b[6] in ("li", "td", "th", "dd", "dt", "option") for b in found]
    x[:, 10] = [b[6] in ("p", "blockquote", "pre") for b in found]
    return x


def grow(x: np.ndarray, y: np.ndarray, depth: int = 9, least: int = 3) -> list | float:
    """A decision tree by Gini impurity: ``[feature, threshold, low, high]`` or the share of 1 in a leaf."""
    if depth == 0 or len(y) < 2 * least or y.min() == y.max():
        return float(y.mean())
    best = (1e-9, 0, 0.0)
    whole = y.mean() * (1 - y.mean()) * len(y)
    for k in range(x.shape[1]):
        order = np.argsort(x[:, k], kind="stable")
        values, labels = x[order, k], y[order]
        ones = np.cumsum(labels)[:-1]
        low = np.arange(1, len(y))
        high = len(y) - low
        rest = labels.sum() - ones
        impurity = ones * (1 - ones / low) + rest * (1 - rest / high)
        gain = np.where((values[1:] > values[:-1]) & (low >= least) & (high >= least), whole - impurity, 0.0)
        at = int(gain.argmax())
        if gain[at] > best[0] + 1e-9:
            best = (float(gain[at]), k, float((values[at] + values[at + 1]) / 2))
    gain, k, threshold = best
    if gain <= 1e-9:
        return float(y.mean())
    left = x[:, k] <= threshold
    return [k, threshold, grow(x[left], y[left], depth - 1, least), grow(x[~left], y[~left], depth - 1, least)]


def decide(tree: list | float, x: np.ndarray) -> np.ndarray:
    if not isinstance(tree, list):
        return np.full(len(x), tree >= 0.5)
    k, threshold, low, high = tree
    left = x[:, k] <= threshold
    out = np.empty(len(x), bool)
    out[left] = decide(low, x[left])
    out[~left] = decide(high, x[~left])
    return out


# The labelled table: fragments of pages, main text marked by a plus. A number in
# braces stands for so many filler words, with an L for so many linked words.
_LABELLED = """
-<html><head><title>{5}</title></head><body><nav><ul><li><a href="/">{1}</a></li><li><a href="/b">{2}</a></li></ul></nav>
+<article><h1>{6}</h1><p>{40}</p><p>{3}</p><p>{1}</p><p>{80}</p>
+<p>{2}</p><ul><li>{5}</li><li>{1}</li></ul><blockquote>{12}</blockquote></article>
-<div class="ad">{9}</div><footer>{8} <a href="/c">{2}</a></footer></body></html>
=
-<body><header><div class="logo">{2}</div><p>{7}</p></header><div class="menu"><a href="/">{1}</a> <a href="/x">{1}</a> <a href="/y">{2}</a></div>
+<main><h1>{4}</h1><p>{25}</p><h2>{3}</h2><p>{60} <a href="/z">{2}</a> {9}</p><p>{4}</p></main>
-<aside><h3>{2}</h3><p>{15}</p><p>{30}</p></aside><div id="comments"><h3>{2}</h3><p>{20}</p><p>{35}</p><p>{2}</p></div>
-<form action="/s"><label>{2}</label><p>{9}</p></form><footer><p>{12}</p></footer></body>
=
-<body><div id="top"><a href="/">{2}</a> | <a href="/b">{1}</a> | <a href="/c">{2}</a></div><div><a href="/d">{3}</a></div>
+<div><h1>{5}</h1><p>{30}</p><p>{55}</p><p>{6}</p><p>{45}</p><p>{2}</p><p>{33}</p></div>
-<div><a href="/e">{4}</a></div><div><a href="/f">{3}</a> {1}</div>
=
-<body><ul><li><a href="/1">{1}</a></li><li><a href="/2">{2}</a></li><li><a href="/3">{1}</a></li></ul><div class="cookie-notice"><p>{18}</p></div>
+<div class="post-content"><h2>{5}</h2><p>{22}</p><ol><li>{8}</li><li>{3}</li></ol><p>{70}</p><table><tr><td>{2}</td><td>{1}</td></tr></table></div>
-<div class="related"><h4>{2}</h4><ul><li><a href="/4">{6}</a></li><li><a href="/5">{7}</a></li></ul></div><div class="newsletter"><p>{16}</p></div>
-<div id="footer"><p>{10}</p><p><a href="/6">{1}</a> <a href="/7">{1}</a></p></div>
=
-<body><table><tr><td><a href="/1">{1}</a></td><td><a href="/2">{1}</a></td></tr></table>
+<h1>{6}</h1><p>{35}</p><p>{48}</p><pre>{14}</pre><p>{3}</p><p>{26}</p>
-<div><a href="/1">{2}</a> <a href="/2">{2}</a> <a href="/3">{2}</a></div>
=
-<body><div class="banner"><p>{11}</p></div><div role="navigation"><a href="/1">{3}</a></div>
+<section class="article-body"><header><h1>{7}</h1><p>{5}</p></header><p>{44}</p><p>{1}</p><figure><figcaption>{9}</figcaption></figure><p>{38}</p></section>
-<section class="comments-area"><article class="comment"><p>{24}</p></article><article class="comment"><p>{3}</p></article></section>
-<div class="sponsored"><p>{28}</p></div><div class="share"><a href="/t">{1}</a></div>
=
-<body><p><a href="/1">{2}</a></p><p><a href="/2">{3}</a></p>
+<p>{50}</p><p>{28}</p><p>{5}</p><p>{61}</p>
-<p><a href="/3">{4}</a> <a href="/4">{2}</a></p>
=
-<body class="has-sidebar"><div class="site-header"><h2>{3}</h2><p>{6}</p></div><div class="breadcrumbs"><a href="/">{1}</a> {1} <a href="/b">{1}</a></div>
+<article class="entry"><p>{3}</p><div>{20}</div><div>{2}</div><p>{31} <a href="/q">{5}</a></p><h3>{2}</h3><p>{1}</p></article>
-<div class="sidebar"><div class="widget"><h3>{2}</h3><p>{40}</p></div></div><div class="legal">{30}</div>
=
-<body><nav><a href="/1">{1}</a> <a href="/2">{1}</a></nav>
+<article><p>{12}</p><p>{36}</p><p>{2}</p></article>
=
-<div class="topbar">{4}</div>
+<div id="content"><h1>{4}</h1><p>{1}</p><p>{22}</p><div>{3}</div></div>
=
-<html><head><title>{4}</title></head><body>
+<p>{18}</p>
=
-<body><div><a href="/1">{2}</a> <a href="/2">{1}</a> {1}</div>
+<div>{24}</div><div>{6}</div><div>{41}</div><div>{3}</div><div>{17}</div>
=
+<body><h1>{3}</h1>{30}<p>{4}</p><p>{29}</p>
=
-<body><aside>{14}</aside><div class="promo"><p>{20}</p></div>
+<main><section><h2>{3}</h2><p>{2}</p></section><section><h2>{2}</h2><ul><li>{1}</li><li>{4} <a href="/k">{1}</a></li></ul><p>{7}</p></section></main>
=
-<body><footer><p>{9}</p></footer>
+<article><h2>{2}</h2><p><a href="/s">{3}</a></p><p>{14}</p><p>{1}</p></article>
-<div class="notice">{12}</div>
=
-<body><div>{4}</div><div>{7}</div><div><a href="/1">{2}</a></div><div><a href="/2">{3}</a></div>
+<div>{5}</div><div>{35}</div><div>{52}</div><div>{4}</div><div>{41}</div><div>{9}</div><div>{28}</div>
-<div>{9}</div><div>{3}</div><div>{8}</div></body>
=
-<body><p>{6}</p><p><a href="/1">{2}</a></p>
+<h1>{6}</h1><p>{30}</p><p>{7}</p><p>{55}</p><ul><li>{3}</li><li>{5}</li><li>{2}</li></ul><p>{38}</p>
-<p>{8}</p><p>{3}</p><p>{9}</p></body>
=
-<body><div>{2}</div><div>{9}</div><div>{3}</div>
+<h2>{5}</h2><div>{60}</div><div>{24}</div><div>{2}</div><div>{47}</div><div>{33}</div>
-<div>{6}</div><div>{2}</div><div>{9}</div><div>{4}</div></body>
=
-<body><p>{3}</p><p>{8}</p>
+<h1>{4}</h1><p>{26}</p><h2>{3}</h2><p>{44}</p><table><tr><td>{2}</td><td>{1}</td></tr><tr><td>{3}</td><td>{2}</td></tr></table><p>{31}</p>
-<p>{7}</p><p>{5}</p><p><a href="/1">{2}</a></p></body>
=
+<body><p>{6}</p></body>
=
+<body><div>{9}</div></body>
"""


def labelled_pages(copies: int = 3, seed: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of all blocks of the labelled pages."""
    rng = random.Random(seed)
    syllables = "an ber co del es fra gen ho in ka lo mi nor pe ra so ti un ve".split()

    def words(found: re.Match) -> str:
        n = max(1, round(int(found[1]) * rng.uniform(0.7, 1.4)))
        return " ".join("".join(rng.choices(syllables, k=rng.randint(1, 3))) for _ in range(n))

    rows, labels = [], []
    for _ in range(copies):
        for page in _LABELLED.split("\n=\n"):
            text, kept = "", []
            for line in page.strip().split("\n"):
                kept.append((len(text), line[0] == "+"))
                text += re.sub(r"\{(\d+)\}", words, line[1:])
            found = blocks(text)
            rows.append(block_features(found))
            labels += [[k for at, k in kept if at <= b[1]][-1] for b in found]
    return np.vstack(rows), np.array(labels, float)


def train() -> list | float:
    return grow(*labelled_pages())


def main_text(page: str, tree: list | float) -> str:
    found = blocks(page)
    keep = decide(tree, block_features(found))
    return "\n".join(b[0] for b, k in zip(found, keep, strict=True) if k)


def extracted(
    pages: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html"
) -> DataFrame:
    """One row per page: id, url, ``text``, ``n_chars``."""
    tree = train()
    rows = pages.select(
        F.col(quoted(id_column)), F.col(quoted(url_column)), F.coalesce(F.col(quoted(html_column)), F.lit("")).alias("html")
    )
    schema = T.StructType([*rows.schema.fields[:2], T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = [main_text(page, tree) for page in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=[id_column, url_column, "text"]
            )

    return rows.mapInArrow(run, schema).withColumn("n_chars", F.length("text").cast("long"))
