"""Main text of web pages by a maximum-scoring subsequence.

A page is a sequence of tags and texts. A text scores a positive weight for each word, an element a negative one where
it begins; one linear scan finds the contiguous region with the highest sum, the first of equals. Weights are learned
from labelled pages: how often words of a kind (plain, heading, list, link) and elements of a class (block, row, inline,
link) lie inside the labelled content, as log odds that keep their sign. Elements are pooled by class, so that those
which labelled pages happen to lack, such as tables, cost no more than their like. By default the pages that mark exactly
one `article` are the labels, of which about LABELLED are used, chosen by a hash; this bound is the only one. Every page
is then judged whole. The tags `article` and `main` score nothing themselves, so that the weights hold for pages without them.

Elements that are not content by their name or their class, id or role (menus, sidebars, notices, adverts, forms,
comments) are one negative tag: their words neither score nor count as text, wherever they stand. A name says so by
its last part, so that `site-footer` does, while `comments-open` and `has-sidebar` tell of a page's state. A form with
most of the page's words is a wrapper of the page and counts as content, and so is an element with such a name if it
holds a main heading, `main` or `article` too; menus and comments are not, however long. Whatever its name, an element is
content if it holds all of the page's articles (or, without any, all that is `main`) and more words than are content outside
of it. Names within `article` and `main` bar nothing on a page that would have no text otherwise. Controls of forms, drawings,
frames, templates and what is shown without scripts only are never text, as none of it is in the page as it is read.

Text: character references are decoded, white space within a block becomes one space, blocks are joined by line
feeds; empty blocks are left out.

Cases: a null or empty html gives an empty text; without labelled pages the weights are the priors; a null url
stays null; a page without content gives an empty text; unclosed tags and markup that is cut off are closed at the
end; repeated rows give equal rows; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Labelled pages in use, about; pseudo-counts behind each prior; the weakest and the strongest weight of a word.
LABELLED, PRIOR, LEAST, MOST_WORD = 2000, 5.0, 0.1, 1.0
SLICE = 64
#: Weights of words before any page was seen.
WORDS = {"plain": 1.0, "heading": 1.0, "list": 0.3, "link": 0.1}
#: By class of elements: the weight before any page was seen, the weakest and the strongest one. An element of no known name has TAG.
CLASSES = {"block": (-0.3, -0.1, -1.0), "row": (-0.3, -0.1, -1.0), "inline": (-0.05, -0.02, -0.2), "link": (-1.0, -0.5, -2.0)}
TAG, BOILERPLATE = -0.3, -6.0
_RAW = "script style title textarea template noscript iframe svg canvas select option button".split()
_OUT = {"nav", "aside", "footer", "form", "dialog", "menu", "fieldset"}
_BLOCKS = set("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = set("abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
_ROWS = set("caption col colgroup dd dt figcaption li summary tbody td tfoot th thead tr".split())
_SHUTS = {"li": {"ul", "ol", "menu"}, "dd": {"dl"}, "dt": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}}
#: Words in class, id and role that mark what is not content.
_MARKS = set(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar menu nav navbar navigation breadcrumb breadcrumbs footer masthead cookie cookies consent notice notices"
    " notification alert popup modal overlay newsletter subscribe signup share sharing social related recommended comment comments disqus respond replies toolbar pagination pager login copyright complementary contentinfo".split()
)
_ITEM = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<raw>" + "|".join(_RAW) + r")(?=[\s/>])[^>]*>.*?(?:</(?P=raw)\s*>|\Z)|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)|<[a-zA-Z][^>]*\Z", re.S | re.I
)
_NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
#: Marks of what may be longer than a page's main text, and first parts of names that tell of a state.
_LONG = set("menu nav navbar navigation breadcrumb breadcrumbs footer comment comments disqus respond replies related recommended pagination pager".split())
_STATES = {"has", "no", "with", "without", "is", "not", "hide", "show"}
_PARTS = re.compile(r"[a-z]+")


def _marks(attrs: str) -> set[str]:
    """The last part of each name in class, id and role, but for those that tell of a state."""
    names = [_PARTS.findall(w) for m in _NAMED.finditer(attrs) for w in m[1].lower().split()]
    return {parts[-1] for parts in names if parts and not (len(parts) > 1 and parts[0] in _STATES)}


def _wrapper(name: str, attrs: str) -> bool:
    """Whether an element that is out may be a wrapper of the page."""
    return name in {"form", "fieldset"} or (name not in _OUT and name != "header" and _LONG.isdisjoint(_marks(attrs)))


def _class(name: str) -> str | None:
    """The class of an element of a known name."""
    return "link" if name == "a" else "inline" if name in _INLINE else "row" if name in _ROWS else "block" if name in _BLOCKS | _VOID | {"raw", "object"} else None


def _out(name: str, attrs: str, within: bool, named: bool = True) -> bool:
    """Whether an element is not content by its name or marks; within: it stands in an article or main, where marks count if `named`."""
    if name in _OUT:
        return True
    if name == "header":
        return not within
    if not attrs or name in {"html", "body", "article", "main"} or (within and not named):
        return False
    words = _marks(attrs)
    return not words.isdisjoint(_MARKS) or ("header" in words and not within)


def items(page: str | None) -> list[tuple[str, str, str, bool, bool]]:
    """The page as (kind, name, text, in an article, content) in page order.

    kind is "text" (name says where: plain, heading, list or link), "tag" where an element begins or "end"; a tag's name is
    "boilerplate" where an element begins that is not content. content is false within such elements.
    """
    found, wrappers = _items(page or "", frozenset())
    return _items(page or "", frozenset(wrappers))[0] if wrappers else found


def _items(page: str, kept: frozenset[int], named: bool = True) -> tuple[list[tuple[str, str, str, bool, bool]], list[int]]:
    """The items, and where the elements begin that are out but wrap the page; those that begin at one of kept are not out."""
    out: list[tuple[str, str, str, bool, bool]] = []
    stack: list[tuple[str, bool]] = []
    # where elements of a name, and blocks, are open in the stack; so no step walks it
    places: defaultdict[str, list[int]] = defaultdict(list)
    blocks: list[int] = []
    # open elements that are out: place, begin, whether it may be a wrapper by its name, whether a form; words, main headings, all words, articles and mains before it
    around: list[tuple[int, int, bool, bool, int, int, int, int, int]] = []
    wrappers: list[tuple[int, int]] = []
    holders: list[tuple[int, int, int, int]] = []
    always, n_words, n_heads, n_all, n_open, n_articles, n_mains, barred, at = 0, 0, 0, 0, 0, 0, 0, 0, 0

    def last(*names: str) -> int:
        return max(places[n][-1] if places[n] else -1 for n in names)

    def shut(k: int) -> None:
        nonlocal barred, always
        while around and around[-1][0] >= k:
            _, begin, may, form, words, heads, every, articles, mains = around.pop()
            always -= not may
            if may and (form or n_heads > heads):
                wrappers.append((begin, n_words - words))
            if n_articles > articles or n_mains > mains:
                holders.append((begin, n_all - every, n_articles - articles, n_mains - mains))
        while len(stack) > k:
            name, bars = stack.pop()
            places[name].pop()
            if blocks and blocks[-1] == len(stack):
                blocks.pop()
            barred -= bars

    def text(raw: str) -> None:
        nonlocal n_words, n_all, n_open
        n = len(raw.split())
        n_all, n_words, n_open = n_all + n, n_words + (0 if always else n), n_open + (0 if barred else n)
        where = "link" if places["a"] else "heading" if last("h1", "h2", "h3", "h4", "h5", "h6") >= 0 else "list" if places["li"] else "plain"
        out.append(("text", where, html.unescape(raw), bool(places["article"]), not barred))

    for m in _ITEM.finditer(page):
        if m.start() > at:
            text(page[at : m.start()])
        at = m.end()
        if m["raw"]:
            out.append(("tag", "raw", "", bool(places["article"]), not barred))
        if not m["name"]:
            continue
        name = m["name"].lower()
        if m["end"]:
            out.append(("end", name, "", bool(places["article"]), not barred))
            if name in places and places[name]:
                shut(places[name][-1])
            continue
        if name in _BLOCKS and blocks and stack[blocks[-1]][0] == "p":
            shut(blocks[-1])
        if name in _SHUTS:
            same = last(*({"dd", "dt"} if name in {"dd", "dt"} else {"td", "th"} if name in {"td", "th"} else {name}))
            if same > last(*_SHUTS[name]):
                shut(same)
        bars = name not in _VOID and m.start() not in kept and _out(name, m["attrs"] or "", last("article", "main") >= 0, named)
        if name in {"h1", "main", "article"} and not always:
            n_heads += 1
        if bars:
            may = _wrapper(name, m["attrs"] or "")
            around.append((len(stack), m.start(), may, name in {"form", "fieldset"}, n_words, n_heads, n_all, n_articles, n_mains))
            always += not may
        if name in {"article", "main"} and _marks(m["attrs"] or "").isdisjoint(_MARKS):
            n_articles, n_mains = n_articles + (name == "article"), n_mains + (name == "main")
        out.append(("tag", "boilerplate" if bars and not barred else name, "", bool(places["article"]), not barred))
        if name not in _VOID:
            places[name].append(len(stack))
            if name in _BLOCKS:
                blocks.append(len(stack))
            stack.append((name, bars))
            barred += bars
    if at < len(page):
        text(page[at:])
    shut(0)
    whole = [begin for begin, n, articles, mains in holders if n > n_open and (articles == n_articles if n_articles else mains == n_mains)]
    return out, [begin for begin, n in wrappers if 2 * n > n_words] + whole


def counted(page: str | None) -> Counter:
    """How many words and tags of each kind a labelled page has inside and outside of its article."""
    found: Counter = Counter()
    for kind, name, text, inside, content in items(page):
        if content and kind != "end":
            found[kind, name, inside] += len(text.split()) if kind == "text" else 1
    return found


def weights_of(counts: dict[tuple[str, str], tuple[int, int]]) -> dict[tuple[str, str], float]:
    """Log odds of lying inside, from (inside, outside) by kind and name; words stay positive and tags negative, which have the odds of their class."""

    def odds(prior: float, inside: int, outside: int) -> float:
        p = 1 / (1 + math.exp(-prior))
        return math.log((inside + PRIOR * p) / (outside + PRIOR * (1 - p)))

    out = {("text", name): min(MOST_WORD, max(LEAST, odds(prior, *counts.get(("text", name), (0, 0))))) for name, prior in WORDS.items()}
    pooled = {c: [0, 0] for c in CLASSES}
    for (kind, name), (inside, outside) in counts.items():
        if kind == "tag" and name not in {"boilerplate", "article", "main", "html", "body", "head"} and (c := _class(name)):
            pooled[c] = [pooled[c][0] + inside, pooled[c][1] + outside]
    of_class = {c: max(most, min(least, odds(prior, *pooled[c]))) for c, (prior, least, most) in CLASSES.items()}
    names = _BLOCKS | _VOID | _INLINE | _ROWS | {"a", "raw", "object"}
    out |= {("tag", name): of_class[_class(name)] for name in names} | {("end", name): 0.0 for name in names}
    return out | {("tag", "boilerplate"): BOILERPLATE, ("tag", "article"): 0.0, ("tag", "main"): 0.0}


def main_text(page: str | None, weights: dict[tuple[str, str], float]) -> str:
    parts = items(page)
    text = _best_text(parts, weights)
    if not text and any(kind == "tag" and name in {"article", "main"} for kind, name, *_ in parts):
        return _best_text(_items(page or "", frozenset(), named=False)[0], weights)
    return text


def _best_text(parts: list[tuple[str, str, str, bool, bool]], weights: dict[tuple[str, str], float]) -> str:
    """The text of the region with the highest sum."""
    edge = [kind != "text" and (name in _BLOCKS or name == "boilerplate") for kind, name, *_ in parts]
    best, total, begin, region, score = 0.0, 0.0, 0, (0, 0), 0.0
    for k, (kind, name, text, _, content) in enumerate(parts):
        if content:
            score += weights.get((kind, name), TAG) * (len(text.split()) if kind == "text" else 1)
        # what is in line stands together: a region begins and ends at the edges of blocks
        if k + 1 < len(parts) and not edge[k] and not edge[k + 1]:
            continue
        total, score = total + score, 0.0
        if total <= 0:
            total, begin = 0.0, k + 1
        elif total > best:
            best, region = total, (begin, k + 1)
    first, last = region
    blocks, now = [], []
    for kind, name, text, _, content in parts[first:last]:
        if kind == "text" and content:
            now.append(text)
        elif name == "br":
            now.append(" ")
        elif kind != "text" and (name in _BLOCKS or name == "boilerplate"):
            blocks.append(now)
            now = []
    return "\n".join(b for b in (" ".join("".join(x).split()) for x in [*blocks, now]) if b)


def learned(pages: DataFrame, labelled: int = LABELLED) -> dict[tuple[str, str], float]:
    """Weights from the pages (page_id, html) that mark one article. The driver gets one row per kind and name of tag."""
    tags = F.regexp_count("html", F.lit(r"(?i)<article[\s>]"))
    marked = pages.where(tags == 1)
    n = marked.count()
    place = F.pmod(F.xxhash64(F.lit("labelled"), "page_id"), F.lit(1 << 32))
    some = marked.where(place < F.lit((1 << 32) * labelled // max(n, 1))).select("html")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: Counter = Counter()
        for b in batches:
            for page in b["html"]:
                found.update(counted(page))
        known = [(kind, name, inside, n) for (kind, name, inside), n in found.items() if kind == "text" or _class(name)]
        yield pd.DataFrame(known, columns=["kind", "name", "inside", "n"])

    rows = some.mapInPandas(run, "kind string, name string, inside boolean, n long").groupBy("kind", "name").agg(F.sum(F.when(F.col("inside"), F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(~F.col("inside"), F.col("n")).otherwise(0)).alias("b"))
    return weights_of({(r["kind"], r["name"]): (r["a"], r["b"]) for r in rows.collect()})


def extracted(pages: DataFrame, weights: dict[tuple[str, str], float]) -> DataFrame:
    """page_id, url, text and n_chars of each row of pages. One narrow pass."""
    shared = pages.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, SLICE):
                part = batch.slice(k, SLICE)
                texts = [main_text(x, shared.value) for x in part.column(2).to_pylist()]
                yield pa.record_batch([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
