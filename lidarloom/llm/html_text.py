"""Operator 12: the main text of web pages from flat text blocks, classified by a decision tree.

A page is cut into flat blocks at block-level tags. A block has its text, its words, how many of them are linked, and
what the markup around it says: whether it stands in an element marked as a menu, advert, form, comment and so on,
whether it stands in the page's article, and whether it is a heading. The tree sees these and the word counts and link
densities of the block's neighbours. It is trained by ``pyspark.ml`` on ``LAYOUTS``, a small table of blocks of typical
pages labelled by hand, and applied as one column expression over the page's array of blocks, so no block leaves its
page's row: nothing is shuffled. Only the cutting into blocks is Python.

Markup needn't be well formed: unclosed elements end with their parents, unmatched end tags are passed over, an
unclosed comment or script lasts to the end of the page. Character references are decoded once. A null or empty page,
or one without main text, has the text ``""``. Pages are read whole. Repeated rows and null ids are kept; an empty table
gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lidarloom.llm.common import small_batches

#: Elements that are blocks, those without content, and those whose content is no text: fixed values of HTML.
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html label legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = "script|style|title|textarea|noscript|noembed|noframes|iframe|template|svg|video|audio|canvas|object|xmp"
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: What a new element closes of those before it in the same list, table or run of paragraphs.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = frozenset("ul ol menu dl table article section div main body".split())
MARKUP = re.compile(
    rf"<!--(?:-?>|.*?(?:--!?>|\Z))|<(?P<silent>{SILENT})\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>.*?(?:</(?P=silent)\s*>|\Z)|<(?P<end>/?)(?P<tag>[a-z][^\s/>]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>|[^>]*(?:>|\Z))|<[!?/][^>]*(?:>|\Z)",
    re.IGNORECASE | re.DOTALL,
)
ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+)|\b(hidden)\b""")
#: Words in classes, ids and roles. ``FIRM`` marks hold for articles inside as well (comments are often articles).
FIRM = frozenset("aside comment comments commentlist complementary disqus recommended related replies reply respond sidebar teaser teasers".split())
LOOSE = frozenset(
    "ad ads adsense advert advertisement advertising alert alertdialog banner breadcrumb breadcrumbs byline-share consent contentinfo cookie cookies copyright dialog disclaimer foot footer gdpr legal login masthead menu modal nav navbar navigation newsletter notice notification overlay pager pagination popup promo promoted promotion search share sharing signup skip social sponsor sponsored subscribe subscription toolbar topbar widget widgets".split()
)
TOP = frozenset("header masthead".split())
#: Words in classes and ids of what holds a page's main text where it has no article element.
HOLDER = frozenset("article articlebody content entry main maincontent post story".split())


@lru_cache(20_000)
def mark_of(tag: str, rest: str) -> tuple[float, bool, bool, bool]:
    """(how firmly an element is marked as no main text, whether it is a page's header, whether its text is linked, whether
    it is called what a main text's holder is): 0 no, 0.5 a form, 1 loosely, 2 firmly."""
    firm = tag == "aside"
    loose = tag in ("nav", "footer", "menu", "button", "select", "option", "label", "legend", "dialog", "search")
    top, link, holder = tag == "header", False, False
    if tag not in ("html", "body", "article", "main"):
        for name, value, bare in ATTRIBUTE.findall(rest):
            name, value = name.lower() or bare.lower(), value.strip("\"'").lower()
            link = link or name == "href"
            if name in ("class", "id", "role"):
                for word in value.split():
                    parts = [p for p in re.split(r"[^a-z]+", word) if p]
                    if parts and parts[0] not in ("no", "has", "with", "without"):
                        firm = firm or not FIRM.isdisjoint(parts)
                        loose = loose or not LOOSE.isdisjoint(parts) or word in LOOSE
                        top = top or not TOP.isdisjoint(parts)
                        holder = holder or (name != "role" and not HOLDER.isdisjoint(parts))
            elif name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value)):
                loose = True
    else:
        firm = tag == "article" and bool(re.search(r"\b(comment|reply|teaser)", rest, re.IGNORECASE))
    return 2.0 if firm else 1.0 if loose else 0.5 if tag == "form" else 0.0, top, link, holder and not (firm or loose or top)


def blocks_of(html: str) -> list[tuple[str, int, int, float, int, bool]]:
    """(text, words, linked words, mark, in an article, heading) of a page's blocks; in an article is 1, 2 in an element
    that is only called so. Open elements are kept as (tag, mark, in an article, linked, heading), each with what holds
    within it."""
    stack: list[tuple[str, float, int, bool, bool]] = [("", 0.0, 0, False, False)]
    depth: dict[str, int] = {}
    out: list[tuple[str, int, int, float, int, bool]] = []
    parts: list[tuple[str, bool]] = []
    at = 0

    def close(down_to: int) -> None:
        while len(stack) > down_to:
            depth[stack.pop()[0]] -= 1

    def flush() -> None:
        if parts:
            words = linked = 0
            for text, link in parts if any(k for _, k in parts) else ():
                n = len(unescape(text).split())
                words, linked = words + n, linked + n * link
            text = " ".join(unescape("".join(t for t, _ in parts)).split())
            parts.clear()
            if text:
                own = stack[-1]
                out.append((text, text.count(" ") + 1, min(linked, text.count(" ") + 1), own[1], own[2], own[4]))

    for m in MARKUP.finditer(html):
        if m.start() > at:
            parts.append((html[at : m.start()], stack[-1][3]))
        at = m.end()
        tag = m["tag"] and m["tag"].lower()
        if not tag:
            if m["silent"] is not None and m["silent"].lower() not in ("script", "style"):
                flush()
            continue
        if tag == "br":
            parts.append((" ", False))
            continue
        block = tag in BLOCK
        if not block and tag != "a":
            continue
        if block:
            flush()
        if m["end"]:
            if depth.get(tag):
                close(max(i for i, e in enumerate(stack) if e[0] == tag))
            continue
        if tag in VOID:
            continue
        if block and depth.get("p"):
            close(max(i for i, e in enumerate(stack) if e[0] == "p"))
        for other in CLOSES.get(tag, ()):
            if depth.get(other):
                i = max(i for i, e in enumerate(stack) if e[0] == other)
                if not any(e[0] in SCOPES for e in stack[i + 1 :]):
                    close(i)
        if tag == "a" and depth.get("a"):
            close(max(i for i, e in enumerate(stack) if e[0] == "a"))
        _, mark, article, link, heading = stack[-1]
        own, top, href, holder = mark_of(tag, m["rest"])
        if tag in ("article", "main"):
            mark, article = max(own, mark if mark >= 2 else 0.0), 1
        else:
            mark = max(mark, own, 1.0 if top and not article else 0.0)
            article = article or (2 if holder else 0)
        stack.append((tag, mark, article, link or (tag == "a" and href), heading or tag in HEADINGS))
        depth[tag] = depth.get(tag, 0) + 1
    if at < len(html):
        parts.append((html[at:], stack[-1][3]))
    flush()
    return out


BLOCKS = pa.struct([("text", pa.string()), ("words", pa.int32()), ("linked", pa.int32()), ("mark", pa.float64()), ("article", pa.int32()), ("heading", pa.bool_())])
BLOCKS_SQL = "array<struct<text: string, words: int, linked: int, mark: double, article: int, heading: boolean>>"


def with_blocks(pages: DataFrame) -> DataFrame:
    """(page_id, url, blocks) of ``pages(page_id, url, html)``."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cut, flat = [0], []
            for html in b.column("html").to_pylist():
                flat += blocks_of(html or "")
                cut.append(len(flat))
            columns = [pa.array(c, f.type) for c, f in zip(zip(*flat, strict=True) if flat else [[]] * len(BLOCKS), BLOCKS, strict=True)]
            blocks = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.StructArray.from_arrays(columns, fields=list(BLOCKS)))
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), blocks], ["page_id", "url", "blocks"])

    kind = lambda c: pages.schema[c].dataType.simpleString()
    return small_batches(pages.select("page_id", "url", "html")).mapInArrow(work, f"page_id {kind('page_id')}, url {kind('url')}, blocks {BLOCKS_SQL}")


#: The small labelled table: blocks of typical pages in page order, as (main text, words, linked words, mark, in an
#: article, heading). The marks are those of ``mark_of``.
LAYOUTS = (
    # a menu, an advert, an article with a title and paragraphs of all lengths, a footer
    ((0, 1, 1, 1, 0, 0), (0, 2, 2, 1, 0, 0), (0, 1, 1, 1, 0, 0), (0, 9, 0, 1, 0, 0), (1, 8, 0, 0, 1, 1), (1, 70, 2, 0, 1, 0), (1, 1, 0, 0, 1, 0), (1, 2, 0, 0, 1, 0), (1, 140, 0, 0, 1, 0), (1, 12, 1, 0, 1, 0), (0, 12, 0, 1, 0, 0)),
    # a cookie notice, a short article, related links, comments as articles, a form
    ((0, 38, 2, 1, 0, 0), (0, 6, 6, 0, 0, 0), (1, 5, 0, 0, 1, 1), (1, 3, 0, 0, 1, 0), (1, 24, 0, 0, 1, 0), (0, 2, 0, 2, 0, 1), (0, 7, 7, 2, 0, 0), (0, 55, 0, 2, 1, 0), (0, 31, 1, 2, 1, 0), (0, 4, 0, 2, 1, 0), (0, 3, 0, 0.5, 0, 0)),
    # an article whose page has unmarked lines and a long unmarked text around it
    ((0, 4, 0, 0, 0, 0), (0, 11, 0, 0, 0, 0), (1, 7, 0, 0, 1, 1), (1, 44, 3, 0, 1, 0), (1, 20, 20, 0, 1, 0), (1, 90, 0, 0, 1, 0), (0, 3, 3, 0, 1, 0), (0, 4, 4, 0, 1, 0), (0, 60, 0, 0, 0, 0), (0, 8, 2, 0, 0, 0)),
    # one very short article, an advert within it
    ((0, 2, 2, 1, 0, 0), (1, 2, 0, 0, 1, 1), (1, 1, 0, 0, 1, 0), (0, 14, 1, 1, 1, 0), (1, 1, 0, 0, 1, 0), (0, 30, 0, 1, 1, 0), (1, 4, 0, 0, 1, 0), (0, 25, 0, 1, 0, 0)),
    # an article of short and long paragraphs in turn, adverts of all lengths between them
    ((0, 5, 5, 1, 0, 0), (1, 3, 0, 0, 1, 1), (1, 40, 0, 0, 1, 0), (1, 3, 0, 0, 1, 0), (0, 20, 0, 1, 1, 0), (1, 2, 0, 0, 1, 0), (1, 55, 1, 0, 1, 0), (0, 65, 2, 1, 1, 0), (1, 34, 0, 0, 1, 0), (1, 1, 0, 0, 1, 0), (0, 3, 0, 1, 1, 0), (1, 9, 0, 0, 1, 0), (1, 25, 2, 0, 1, 0), (0, 110, 0, 1, 0, 0)),
    # a long notice and a long sidebar around a short article, whose last paragraph is a long one
    ((0, 90, 3, 1, 0, 0), (0, 50, 50, 1, 0, 0), (1, 6, 0, 0, 1, 1), (1, 11, 0, 0, 1, 0), (1, 5, 0, 0, 1, 0), (1, 18, 3, 0, 1, 0), (1, 75, 0, 0, 1, 0), (0, 80, 0, 2, 0, 0), (0, 120, 0, 2, 0, 0), (0, 3, 0, 2, 0, 1), (0, 70, 2, 1, 0, 0)),
    # a short article and many comments
    ((1, 4, 0, 0, 1, 1), (1, 14, 0, 0, 1, 0), (1, 50, 0, 0, 1, 0), (0, 2, 0, 2, 0, 1), (0, 60, 0, 2, 1, 0), (0, 9, 0, 2, 1, 0), (0, 33, 2, 2, 1, 0), (0, 140, 0, 2, 1, 0), (0, 1, 1, 2, 1, 0), (0, 28, 0, 2, 1, 0)),
    # an article of one paragraph between unmarked texts of any length
    ((0, 45, 0, 0, 0, 0), (0, 16, 2, 0, 0, 0), (1, 33, 0, 0, 1, 0), (0, 85, 1, 0, 0, 0), (0, 2, 0, 0, 0, 0), (0, 28, 0, 0, 0, 0)),
    # no article element: marked texts of all lengths around and between the paragraphs
    ((0, 75, 2, 1, 0, 0), (0, 12, 12, 1, 0, 0), (1, 8, 0, 0, 0, 1), (1, 66, 1, 0, 0, 0), (0, 48, 1, 1, 0, 0), (1, 52, 2, 0, 0, 0), (0, 7, 0, 1, 0, 0), (1, 88, 0, 0, 0, 0), (1, 41, 0, 0, 0, 0), (0, 95, 0, 2, 0, 0), (0, 60, 0, 2, 0, 0), (0, 36, 0, 1, 0, 0)),
    # articles with nothing or with links behind them
    ((0, 4, 4, 1, 0, 0), (1, 5, 0, 0, 1, 1), (1, 30, 0, 0, 1, 0), (1, 3, 0, 0, 1, 0)),
    ((1, 2, 0, 0, 1, 0),),
    ((1, 5, 0, 0, 1, 1), (1, 40, 4, 0, 1, 0), (1, 12, 0, 0, 1, 0)),
    ((1, 30, 3, 0, 1, 0), (1, 2, 0, 0, 1, 0)),
    ((1, 6, 0, 0, 1, 1), (1, 1, 0, 0, 1, 0)),
    ((1, 80, 0, 0, 1, 0), (1, 4, 0, 0, 1, 0), (0, 6, 6, 1, 0, 0), (0, 3, 3, 1, 0, 0)),
    ((1, 7, 0, 0, 1, 1), (1, 2, 0, 0, 1, 0), (0, 5, 5, 2, 0, 0), (0, 4, 4, 2, 0, 0)),
    # articles of one or two blocks, with links right before or behind them
    ((0, 3, 3, 1, 0, 0), (1, 20, 0, 0, 1, 0)),
    ((0, 2, 2, 1, 0, 0), (1, 2, 0, 0, 1, 0)),
    ((0, 4, 4, 1, 0, 0), (1, 60, 0, 0, 1, 0), (0, 2, 2, 1, 0, 0)),
    ((0, 1, 1, 1, 0, 0), (1, 9, 0, 0, 1, 0), (0, 1, 1, 1, 0, 0)),
    ((0, 2, 2, 0, 0, 0), (1, 4, 0, 0, 1, 1), (1, 1, 0, 0, 1, 0), (0, 3, 3, 0, 0, 0)),
    ((1, 3, 0, 0, 1, 1), (0, 2, 2, 1, 0, 0)),
    # no article element: marked links behind the last paragraph, long or short
    ((0, 3, 3, 1, 0, 0), (1, 50, 1, 0, 0, 0), (1, 45, 0, 0, 0, 0), (0, 4, 4, 1, 0, 0), (0, 2, 2, 1, 0, 0)),
    ((0, 2, 2, 1, 0, 0), (1, 70, 2, 0, 0, 0), (1, 26, 0, 0, 0, 0), (1, 15, 0, 0, 0, 0), (0, 5, 5, 2, 0, 0), (0, 8, 2, 1, 0, 0)),
    ((1, 120, 0, 0, 0, 0), (1, 38, 0, 0, 0, 0), (0, 7, 7, 0, 0, 0), (0, 3, 3, 0, 0, 0)),
    # no article element: the last paragraph is the page's last block
    ((0, 2, 2, 0, 0, 0), (1, 58, 0, 0, 0, 0), (1, 35, 0, 0, 0, 0)),
    # no article element: links, a title, long paragraphs and a short one between them, small print
    ((0, 1, 1, 0, 0, 0), (0, 2, 2, 0, 0, 0), (0, 1, 1, 0, 0, 0), (1, 7, 0, 0, 0, 1), (1, 60, 1, 0, 0, 0), (1, 95, 0, 0, 0, 0), (1, 6, 0, 0, 0, 0), (1, 48, 4, 0, 0, 0), (1, 30, 0, 0, 0, 0), (0, 5, 0, 0, 0, 0), (0, 3, 3, 0, 0, 0), (0, 4, 0, 0, 0, 0)),
    # no article element: marked menu and sidebar around paragraphs, a heading between them
    ((0, 3, 3, 1, 0, 0), (0, 4, 0, 1, 0, 1), (1, 9, 0, 0, 0, 1), (1, 34, 0, 0, 0, 0), (1, 4, 0, 0, 0, 1), (1, 80, 6, 0, 0, 0), (1, 22, 0, 0, 0, 0), (0, 40, 0, 2, 0, 0), (0, 6, 6, 2, 0, 0), (0, 18, 0, 1, 0, 0)),
    # no article element: one form around all, its fields and a long text
    ((0, 2, 2, 0.5, 0, 0), (0, 1, 1, 0.5, 0, 0), (1, 64, 2, 0.5, 0, 0), (1, 52, 0, 0.5, 0, 0), (0, 4, 0, 0.5, 0, 0), (0, 2, 0, 0.5, 0, 0), (0, 6, 1, 0.5, 0, 0)),
    # no article element: a list of links with teasers
    ((0, 3, 3, 0, 0, 0), (0, 8, 8, 0, 0, 0), (0, 7, 0, 0, 0, 0), (0, 9, 9, 0, 0, 0), (0, 6, 0, 0, 0, 0), (0, 8, 8, 0, 0, 0), (0, 2, 0, 0, 0, 0)),
)
LABELLED = "page int, at int, main double, words int, linked int, mark double, article int, heading boolean"
FEATURES = ("words", "density", "words_before", "density_before", "words_after", "density_after", "mark", "place", "heading")


def features(blocks: Column, b: Column, i: Column) -> dict[str, Column]:
    """What the tree sees of block ``b``, the ``i``-th of ``blocks``. ``place`` is 1 in an article, -1 outside one on a
    page that has one; on a page without, 1 in an element called so, else 0. Where there is no neighbour, its values are
    0."""
    before, after = F.get(blocks, i - 1), F.get(blocks, i + 1)
    number = lambda c: F.coalesce(c.cast("double"), F.lit(0.0))
    density = lambda x: number(x["linked"] / F.greatest(x["words"], F.lit(1)))
    place = F.when(b["article"] == 1, 1.0).when(F.exists(blocks, lambda x: (x["article"] == 1) & (x["mark"] < 2)), -1.0).when(b["article"] == 2, 1.0).otherwise(0.0)
    values = (number(b["words"]), density(b), number(before["words"]), density(before), number(after["words"]), density(after), b["mark"], place, number(b["heading"]))
    return dict(zip(FEATURES, values, strict=True))


def labelled(spark: SparkSession) -> DataFrame:
    """``LAYOUTS`` as (main, features), one row a block."""
    rows = [(page, at, float(main), *values[:-1], bool(values[-1])) for page, layout in enumerate(LAYOUTS) for at, (main, *values) in enumerate((m, w, k, float(mark), a, h) for m, w, k, mark, a, h in layout)]
    block = F.struct("at", "main", "words", "linked", "mark", "article", "heading")
    pages = spark.createDataFrame(rows, LABELLED).groupBy("page").agg(F.array_sort(F.collect_list(block)).alias("blocks"))
    own = F.transform("blocks", lambda b, i: F.struct(b["main"].alias("main"), *(v.alias(k) for k, v in features(F.col("blocks"), b, i).items())))
    return pages.select("page", F.posexplode(own)).select("page", "pos", "col.*").orderBy("page", "pos").drop("page", "pos")


Tree = float | tuple


@lru_cache(1)
def tree_of(depth: int = 6) -> Tree:
    """The fitted tree as (feature, threshold, left, right) down to 0 or 1: kept by the driver, fitted once."""
    from pyspark.ml.classification import DecisionTreeClassifier
    from pyspark.ml.functions import array_to_vector

    spark = SparkSession.active()
    data = labelled(spark).select(F.col("main").alias("label"), array_to_vector(F.array(*FEATURES)).alias("features")).coalesce(1)
    model = DecisionTreeClassifier(maxDepth=depth, maxBins=128, minInstancesPerNode=1, seed=1).fit(data)

    def read(node) -> Tree:
        if node.numDescendants() == 0:
            return float(node.prediction())
        split = node.split()
        return FEATURES[split.featureIndex()], float(split.threshold()), read(node.leftChild()), read(node.rightChild())

    return read(model._call_java("rootNode"))


def decide(tree: Tree, values: dict[str, Column]) -> Column:
    """The tree as a column: true for main text."""
    if isinstance(tree, float):
        return F.lit(tree > 0.5)
    name, threshold, left, right = tree
    return F.when(values[name] <= threshold, decide(left, values)).otherwise(decide(right, values))


def main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars, n_blocks, n_main) of ``pages(page_id, url, html)``."""
    tree = tree_of()
    rows = with_blocks(pages)
    kept = F.filter("blocks", lambda b, i: decide(tree, features(F.col("blocks"), b, i)))
    rows = rows.select("page_id", "url", F.size("blocks").alias("n_blocks"), F.transform(kept, lambda b: b["text"]).alias("kept"))
    text = F.array_join("kept", "\n")
    return rows.select("page_id", "url", text.alias("text"), F.char_length(text).cast("long").alias("n_chars"), "n_blocks", F.size("kept").alias("n_main"))
