"""Main text of web pages from flat text blocks.

A page is cut into blocks at block-level elements. A block is told by its word count and link density and those of its
neighbours, by the containers it lies in (article-like, boilerplate-like inside and outside of that), and by whether it is a
heading. A decision tree over these numbers says which blocks are main text. It is grown from PAGES, a small labelled table
of page layouts, before the job starts; tasks get the finished tree.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellspan.llm.common import cut, small_batches, table

#: Elements that begin and end a block (fixed values: block-level elements of HTML).
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav "
    "ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul button".split()
)
#: Elements without content (fixed values of HTML).
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is not markup, or not shown (fixed values of HTML).
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template svg object".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: A start tag of the key ends an open element of the values that it is directly in.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}

#: Boilerplate by element, by words of class, id or role: 3 surely, 2 perhaps.
SURE = frozenset(
    "ad ads adsense advert adverts advertisement advertising adslot announcement aside banner breadcrumb breadcrumbs carousel comment comments commentlist consent cookie cookies copyright dialog discussion disqus feedback footer gdpr leaderboard login menu menus "
    "modal nav navbar navigation navigational newsletter notification notifications outbrain overlay pager paginate pagination paywall popular popup privacy promo promoted promotion recommended reactions recommendations related replies reply respond response responses search share sharing "
    "shoutbox sidebar sidebars sidenav signup skip social sponsor sponsors sponsored subnav subscribe subscription taboola toolbar topnav trending widget widgets contentinfo complementary hidden notice notices".split()
)
PERHAPS = frozenset("alert author byline caption credits date dateline disclaimer header headers legal masthead message meta metadata posted register tags teaser teasers toc topbar warning".split())
SURE_ELEMENTS = frozenset("nav aside footer dialog menu select button option".split())
PERHAPS_ELEMENTS = frozenset("header form label fieldset legend address search".split())
#: Article-like containers by words of class, id, role or itemprop.
CONTENT = frozenset("article articlebody blog body content entry hentry main post story text".split())
LAYOUT = frozenset("has no with without".split())

_ATTRIBUTES = r"(?:[^\s=>/]++(?:\s*+=\s*+(?:\"[^\"]*\"|'[^']*'|[^\s>]*+))?|[\s/=]++)*+"
_TAG = re.compile(rf"<!--(?:-?>|.*?(?:--!?>|\Z))|<(/?)([A-Za-z][^\s/>]*+)({_ATTRIBUTES})>|<[A-Za-z/!?][^>]*(?:>|\Z)", re.DOTALL)
_HINTS = re.compile(r"(?:^|[\s\"'/])(class|id|role|itemprop|style|aria-hidden|hidden|href)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*)))?", re.IGNORECASE)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_NONE = (0, 0, False)


def _hints(name: str, attributes: str) -> tuple[int, int, bool]:
    """(boilerplate 0 to 3, article-like 0 to 2, has a link target) of an element."""
    boiler = 3 if name in SURE_ELEMENTS else 2 if name in PERHAPS_ELEMENTS else 0
    content = 2 if name in ("article", "main") else 0
    link = False
    if not attributes:
        return boiler, content, link
    whole = name in ("article", "main", "body", "html")  # their classes tell of themes and topics; the first words count
    for key, *values in _HINTS.findall(attributes):
        key, value = key.lower(), html.unescape("".join(values))
        if key == "href":
            link = True
        elif key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.IGNORECASE):
            boiler = 3
        elif key in ("class", "id", "role", "itemprop"):
            for word in value.split():
                parts = [w.lower() for w in _WORDS.findall(word)]
                if whole:
                    parts = parts[:1]
                    if name in ("body", "html"):
                        continue
                parts = [w for i, w in enumerate(parts) if not i or parts[i - 1] not in LAYOUT]
                if any(w in SURE for w in parts):
                    boiler = 3
                elif any(w in PERHAPS for w in parts):
                    boiler = max(boiler, 2)
                elif any(w in CONTENT for w in parts):
                    content = max(content, 2 if key == "itemprop" or word == "main" and key == "role" else 1)
    return boiler, 0 if boiler else content, link


class Block:
    """Text of a block, its words and linked words, and what its containers are."""

    __slots__ = ("text", "words", "linked", "article", "inside", "outside", "heading")

    def __init__(self, text: str, words: int, linked: int, article: int, inside: int, outside: int, heading: bool):
        self.text, self.words, self.linked, self.article, self.inside, self.outside, self.heading = text, words, linked, article, inside, outside, heading


def blocks(page: str) -> list[Block]:
    """Blocks with text, in page order; character references are decoded, white space within a block is one space."""
    out: list[Block] = []
    stack: list[tuple[str, int, int, bool]] = []  # name, boilerplate, article-like, link
    marked = 0  # elements of the stack that are one of these
    parts: list[str] = []
    linked = 0
    at, raw_to = 0, len(page)

    def flush() -> None:
        nonlocal linked
        words = "".join(parts).split()
        parts.clear()
        if words:
            article = inside = outside = 0
            heading = False
            for name, boiler, content, _ in stack if marked else ():
                if content:
                    article, inside, outside = max(article, content), 0, max(outside, inside)
                inside = max(inside, boiler)
                heading |= name in HEADINGS
            if not article:
                inside, outside = 0, max(inside, outside)
            out.append(Block(" ".join(words), len(words), min(linked, len(words)), article, inside, outside, heading))
        linked = 0

    def close(upto: int) -> None:
        nonlocal marked
        for name, boiler, content, link in stack[upto:]:
            marked -= bool(boiler or content or link or name in HEADINGS)
        del stack[upto:]

    def add(text: str) -> None:
        nonlocal linked
        if text:
            text = html.unescape(text) if "&" in text else text
            parts.append(text)
            if marked and any(e[3] for e in stack):
                linked += len(text.split())

    while at < raw_to:
        m = _TAG.search(page, at)
        if m is None:
            add(page[at:])
            break
        add(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        name = m[2].lower()
        if m[1]:
            if name in BLOCK:
                flush()
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    close(i)
                    break
                if name not in BLOCK and stack[i][0] in BLOCK:
                    break
            if name == "br":
                parts.append(" ")
            continue
        if name == "br":
            parts.append(" ")
            continue
        if name in RAW and not m[3].endswith("/"):
            end = re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.IGNORECASE).search(page, at)
            at = end.end() if end else raw_to
            continue
        boiler, content, link = _hints(name, m[3]) if m[3] or name in BLOCK or name == "label" else _NONE
        if name in BLOCK or boiler == 3:
            flush()
        if name in VOID:
            continue
        if name in BLOCK:  # an open paragraph ends, and what this element cannot be in
            own = ENDS.get(name, set())
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == "p" or stack[i][0] in own:
                    close(i)
                    if stack and stack[-1][0] in own:
                        continue
                elif stack[i][0] in BLOCK:
                    break
        elif name == "a":
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == "a":
                    close(i)
                    break
                if stack[i][0] in BLOCK:
                    break
        stack.append((name, boiler, content, link and name == "a"))
        marked += bool(boiler or content or stack[-1][3] or name in HEADINGS)
    flush()
    return out


#: words, links, words before, links before, words after, links after, heading, article-like, boilerplate inside it, outside it, best article-like container of the page
Features = tuple[float, ...]


def features(page: list[Block]) -> list[Features]:
    """The numbers that the tree asks for; links are shares of linked words, neighbours beyond the page are empty."""
    best = max((b.article for b in page if not b.outside), default=0)
    sizes = [(float(b.words), b.linked / b.words) for b in page]
    around = [(0.0, 0.0), *sizes, (0.0, 0.0)]
    return [
        (*around[i + 1], *around[i], *around[i + 2], float(b.heading), float(b.article), float(b.inside), float(b.outside), float(best))
        for i, b in enumerate(page)
    ]


#: The labelled table: layouts in which {n} stands for n words of boilerplate and [n] for n words of main text.
PAGES = (
    # an article between menus, adverts and footers
    "<nav><ul><li><a href=/>{1}</a></li><li><a href=/>{2}</a></li></ul></nav><div class=ad>{9}</div><article><h1>[6]</h1><p>[40]</p><p>[1]</p><p>[3]</p><p>[70]</p></article><footer>{8}</footer>",
    "<div class=ad>{30}</div><nav><a href=/>{3}</a></nav><article><h1>[1]</h1><p>[2]</p></article><footer>{25}</footer>",
    "<header><h1>{3}</h1><p>{30}</p></header><main><h1>[8]</h1><p>[60]</p><h2>[4]</h2><ul><li>[3]</li><li>[9]</li></ul><table><tr><td>[1]</td><td>[2]</td></tr></table></main><aside><h2>{2}</h2><p>{45}</p></aside><footer><p>{40}</p></footer>",
    # headings, bylines, notices and forms within the article
    "<article><header><h1>[7]</h1><p class=byline>{4}</p><p class=date>{3}</p></header><p>[50]</p><div class=share><a href=/>{1}</a></div><p>[30]</p><aside class=related><h3>{2}</h3><a href=/>{7}</a></aside><form><label>{3}</label><button>{1}</button></form>"
    "<p>[20]</p><div class=newsletter><p>{25}</p></div><footer>{12}</footer></article>",
    "<article><p class=notice>{20}</p><h1>[5]</h1><div class=meta>{6}</div><p>[35]</p><blockquote><p>[18]</p></blockquote><figure><figcaption>[9]</figcaption></figure><p><a href=/>[6]</a></p><p>[25]</p><nav><a href=/>{3}</a></nav></article>",
    "<article><h2>[4]</h2><p><a href=/>[2]</a></p><ul><li><a href=/>[3]</a></li><li><a href=/>[5]</a></li></ul><p>[12]</p><div class=tags><a href=/>{1}</a></div></article>",
    "<nav><a href=/>{2}</a></nav><article><header><p class=category>{2}</p><h1>[6]</h1><p>{14}</p></header><p>[40]</p><h2>[3]</h2><p>[30]</p></article><footer>{9}</footer>",
    "<main><header><a href=/>{1}</a><h1>[9]</h1></header><p>[5]</p><p>[60]</p><div class=warning><p>{12}</p></div></main>",
    # reader comments inside, beside and marked as articles
    "<article><h1>[5]</h1><p>[45]</p><section id=comments><h3>{2}</h3><div class=comment><p>{40}</p></div><div class=comment><p>{5}</p></div></section></article><footer>{5}</footer>",
    "<main><article><h1>[5]</h1><p>[45]</p><p>[2]</p></article><div id=comments><h2>{2}</h2><article><p>{60}</p></article><article class=comment><p>{4}</p></article></div></main>",
    "<article><p>[30]</p></article><section class=comments><article><h4>{2}</h4><p>{30}</p></article></section>",
    # teasers of other articles
    "<section class=related><article><h3><a href=/>{6}</a></h3><p>{20}</p></article></section><article><h1>[6]</h1><p>[55]</p></article><aside><article><h3>{4}</h3><p>{30}</p></article></aside>",
    # containers told by their names
    "<div id=header><a href=/>{2}</a><p>{15}</p></div><div id=content><h1>[6]</h1><p>[40]</p><p>[2]</p><div class=sidebar><p>{30}</p></div><ul><li>[4]</li></ul><p>[9]</p></div><div id=footer>{20}</div>",
    "<div class=menu><a href=/>{1}</a></div><div class=post><h2>[5]</h2><div class=meta>{5}</div><div class=entry><p>[30]</p><p>[3]</p><p>[50]</p></div><div class=comments><p>{30}</p></div></div><div class=widget><p>{20}</p></div>",
    "<div class=cookie><p>{25}</p><button>{1}</button></div><div class=content><p>[4]</p><p>[1]</p><h3>[3]</h3><p>[22]</p></div><div>{6}</div><div><a href=/>{4}</a></div>",
    "<form class=search><label>{2}</label></form><div>{20}</div><article><p>[12]</p><p>[40]</p></article><div>{35}</div><p>{3}</p>",
    "<p>{18}</p><main><p>[4]</p><p>[80]</p></main><p>{40}</p><h2>{3}</h2>",
    "<div><p>{25}</p></div><div class=story><h1>[4]</h1><p>[80]</p><p>[5]</p></div><div><p>{12}</p></div><h3>{2}</h3>",
    # a page within a form
    "<form><div class=menu>{6}</div><article><h1>[4]</h1><p>[60]</p><p>[2]</p></article><div class=footer>{9}</div></form>",
    "<form><div id=content><h1>[4]</h1><p>[60]</p><p>[2]</p><label>{2}</label></div><label>{3}</label></form>",
    # nothing but text and links
    "<div><a href=/>{1}</a></div><div><a href=/>{2}</a></div><h1>[6]</h1><p>[40]</p><p>[25]</p><p>[12]</p><p>[60]</p><div><a href=/>{4}</a></div><div><a href=/>{3}</a></div><div>{4}</div>",
    "<table><tr><td><a href=/>{2}</a></td><td><p>[70]</p><p>[14]</p><p>[30]</p><p>[45]</p></td></tr></table><div><a href=/>{10}</a></div><div>{5}</div>",
    "<h1>[3]</h1><p>[20]</p><p>[15]</p>",
    "<p>[12]</p>",
    "<p>[2]</p><p>[30]</p><p>[3]</p><p>[40]</p>",
    "<header><p>{20}</p></header><div><p>[30]</p><p>[12]</p></div><nav><a href=/>{2}</a></nav><aside><p>{40}</p></aside><div class=comments><p>{30}</p></div><form><p>{14}</p></form><footer><p>{30}</p></footer>",
    "<div class=header>{8}</div><p>[30]</p><h2>[4]</h2><p>[50]</p><div class=ad>{20}</div><p>[14]</p><div class=share>{3}</div>",
)
_FILL = re.compile(r"\{(\d+)\}|\[(\d+)\]")


def labelled(pages: tuple[str, ...] = PAGES) -> tuple[list[Features], list[int]]:
    """Features and labels (1: main) of all blocks of the table."""
    x, y = [], []
    for page in pages:
        found = blocks(_FILL.sub(lambda m: " ".join(["other"] * int(m[1])) if m[1] else " ".join(["main"] * int(m[2])), page))
        x += features(found)
        y += [int(b.text.startswith("main")) for b in found]
    return x, y


#: A leaf is its label; a node is (feature, threshold, at most, more).
Tree = int | tuple


def grow(x: list[Features], y: list[int], depth: int = 9) -> Tree:
    """A binary tree by the largest fall of Gini impurity; ties go to the later feature (containers before sizes), then to the
    lowest threshold. Leaves take the majority, main text in a tie."""
    ones = sum(y)
    if depth == 0 or ones in (0, len(y)):
        return int(2 * ones >= len(y))
    best, where = 1e-9, None
    whole = ones * (len(y) - ones) / len(y)
    for f in range(len(x[0]) - 1, -1, -1):
        counts = Counter((row[f], label) for row, label in zip(x, y, strict=True))
        values = sorted({v for v, _ in counts})
        n = k = 0
        for a, b in zip(values, values[1:], strict=False):
            n += counts[a, 0] + counts[a, 1]
            k += counts[a, 1]
            m = len(y) - n
            fall = whole - k * (n - k) / n - (ones - k) * (m - ones + k) / m
            if fall > best + 1e-9:
                best, where = fall, (f, (a + b) / 2)
    if where is None:
        return int(2 * ones >= len(y))
    f, t = where
    sides = [([r for r in zip(x, y, strict=True) if (r[0][f] <= t) == low]) for low in (True, False)]
    return f, t, *(grow([r[0] for r in side], [r[1] for r in side], depth - 1) for side in sides)


def decide(tree: Tree, row: Features) -> bool:
    while isinstance(tree, tuple):
        f, t, low, high = tree
        tree = low if row[f] <= t else high
    return tree == 1


def main_text(page: str, tree: Tree) -> str:
    """Main blocks of a page, joined by line ends."""
    found = blocks(page)
    return "\n".join(b.text for b, row in zip(found, features(found), strict=True) if decide(tree, row))


def extract(pages: DataFrame, tree: Tree | None = None) -> DataFrame:
    """page_id, url, text, n_chars (code points of text).

    A null or empty page, or one without main text, has the empty text; null ids and addresses stay null; repeated rows are
    extracted as often as they occur; long and broken pages are read whole; an empty table gives no rows. Only page_id, url and
    html are read, so other columns can have any name.
    """
    known = grow(*labelled()) if tree is None else tree

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in cut(batches, column=2):
            found = [main_text(p or "", known) for p in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.string()), pa.array(list(map(len, found)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    columns = [F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")]
    return pages.select(*columns).mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op13_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return extract(table(spark, sf_dir, "pages"))
