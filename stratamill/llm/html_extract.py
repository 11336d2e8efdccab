"""Main text of pages by site style trees."""

from __future__ import annotations

import hashlib
import html
import re
from collections import namedtuple
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratamill.llm.common import materialize, small

#: Elements without text of their own, elements that stand apart from the article, elements that part blocks,
#: whole class tokens and ids that name such parts, those of them that name no part for sure within an article, those
#: that list articles of their own, elements without an end tag.
MUTE = "script style noscript template svg math iframe object embed canvas video audio map select datalist textarea button title head"
ASIDE = "nav aside footer form menu dialog search"
BLOCKS = "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul"
PARTS = (
    "ad ads advert advertisement advertisements adverts adsense adslot ad-banner ad-container ad-slot ad-wrapper banner banners breadcrumb breadcrumbs byline-links comment comments comment-form "
    "comment-list commentlist comments-area consent contentinfo cookie cookies cookie-banner cookie-consent cookie-notice disqus dropdown footer gdpr header main-menu main-nav main-navigation masthead "
    "menu menubar menus modal nav nav-menu navbar navigation newsletter notice notices notification overlay page-footer pager pagination paywall popup post-navigation promo promos promotion "
    "recommended related related-articles related-posts replies reply respond share share-buttons share-links sharing side-bar sidebar sidebars signup site-footer site-header site-nav site-navigation skip skip-link social "
    "social-links social-share sponsor sponsored subscribe subscription toc toolbar topbar top-bar widget widgets"
)
UNSURE = "banner dropdown header masthead menu menus modal notice notices notification overlay promotion skip subscription widget widgets"
LISTS = "comment comments comment-list commentlist comments-area disqus recommended related related-articles related-posts replies reply respond side-bar sidebar sidebars"
VOID = "area base br col embed hr img input link meta param source track wbr"

_MUTE, _ASIDE, _BLOCKS, _PARTS, _UNSURE, _LISTS, _VOID = (frozenset(x.split()) for x in (MUTE, ASIDE, BLOCKS, PARTS, UNSURE, LISTS, VOID))
_SURE = _PARTS - _UNSURE
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_COMMENT = frozenset("comment comments comment-body reply replies respond".split())
#: How far an element stands apart: by a name that an article in it outweighs, by one that only a main element does, for good.
_WEAK, _STRONG, _HIDDEN = 1, 2, 3
_ROLES = frozenset("alert banner complementary contentinfo dialog form menu menubar navigation search".split())
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|svg|math|iframe|textarea|title)\b[^>]*(?:/>|>.*?(?:</\1\s*>|\Z))|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"'=]|=\s*\"[^\"]*\"|=\s*'[^']*'|[=\"'])*)(?:>|\Z)", re.S | re.I)
_ATTR = re.compile(r"""([^\s=/>"']+)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s>]+))?|["'=]""")
_HOST = r"(?i)^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)"
_DIGITS = re.compile(r"\d+")
#: Characters from which a block is prose; levels of the style tree; damping of a presentation on the way up.
PROSE, DEPTH, DAMPING = 80, 64, 0.9
#: Most low nodes that are broadcast (8 bytes each), and the salts by which more of them are joined.
MOST, SALTS = 500_000, 16
#: Elements that end an open one of the same kind.
_ENDS = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}


def attributes(raw: str) -> dict[str, str]:
    """Attributes by name, the first of a name; values are passed over as a whole, so no name is found in one."""
    out: dict[str, str] = {}
    for m in _ATTR.finditer(raw):
        if m[1]:
            out.setdefault(m[1].lower(), (m[2] or "").strip("\"'").lower())
    return out


def set_apart(name: str, attrs: dict[str, str], within: bool) -> int:
    """How far an element stands apart by its own name, role, class and id; names that may belong to an article are left to the style tree."""
    if name in _MUTE or "hidden" in attrs or attrs.get("aria-hidden") == "true":
        return _HIDDEN
    role, tokens = attrs.get("role"), {*attrs.get("class", "").split(), attrs.get("id", "").strip()}
    if name in ("article", "main") or role in ("main", "article"):
        return _STRONG if tokens & _COMMENT else 0  # a comment can be an article of its own
    if name == "form" or role == "form":
        return _WEAK
    if name in _ASIDE or role in _ROLES or name == "header" and not within:
        return _STRONG
    if name in _HEADINGS or name in ("html", "body"):
        return 0
    named = tokens & (_SURE if within else _PARTS)
    return (_STRONG if named & _LISTS else _WEAK) if named else 0


Block = namedtuple("Block", "text node chain apart within")
Element = namedtuple("Element", "node chain kids")


@lru_cache(1 << 16)
def digest(x: str) -> int:
    return int.from_bytes(hashlib.blake2b(x.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def content(node: int, text: str) -> int:
    """The content node of a text in an element node."""
    return int.from_bytes(hashlib.blake2b(f"{node}\0{text}".encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def parse(page: str, site: str = "") -> tuple[list[Block], list[Element]]:
    """Blocks of text in page order and elements that part blocks, each with its node in the tree of the site.

    An element's node is its parent's node with its own look (name and classes, digits alike); below DEPTH elements
    take the node above them. An element that stands apart takes what it holds along, except that a main element, or
    an article where only a weak name is above it, starts anew. Tolerates pages that are cut off, unclosed and stray
    tags.
    """
    root = digest(f"\0{site}")
    elements = [Element(root, (root,), [])]
    # of each open element: name, its node, how far it stands apart, whether in an article or main element
    stack: list[tuple[str, Element, int, bool]] = [("", elements[0], 0, False)]
    held: list[str] = []
    found: list[Block] = []

    def close() -> None:
        text = "".join(held)
        held.clear()
        if text := " ".join((html.unescape(text) if "&" in text else text).split()):
            _, element, apart, within = stack[-1]
            found.append(Block(text, element.node, element.chain, apart, within))

    at = 0
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            held.append(page[at : m.start()])
        at = m.end()
        name = m[3] and m[3].lower()
        if not name:
            continue
        if name in _BLOCKS:
            close()
        elif name == "br":
            held.append(" ")
        if m[2]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == name:
                    if name not in _BLOCKS and any(x[0] in _BLOCKS for x in stack[k:]):
                        break
                    del stack[k:]
                    break
            continue
        if name in _VOID or m[4].rstrip().endswith("/") and name not in _BLOCKS:
            continue
        if name in _BLOCKS and stack[-1][0] == "p":
            stack.pop()
        elif name in _ENDS:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] in _ENDS[name]:
                    del stack[k:]
                    break
                if stack[k][0] in ("ul", "ol", "dl", "table", "div", "article", "section", "td"):
                    break
        attrs = attributes(m[4]) if m[4].strip() else {}
        _, element, apart, within = stack[-1]
        main = name in ("article", "main") or attrs.get("role") in ("main", "article")
        if main and apart <= (_STRONG if "main" in (name, attrs.get("role")) else _WEAK):
            apart = 0
        off = max(apart, set_apart(name, attrs, within))
        # inline elements part no blocks and are no nodes of the style tree
        if name in _BLOCKS and len(element.chain) <= DEPTH and off < _HIDDEN:
            look = f"{name}.{_DIGITS.sub('#', ' '.join(sorted(attrs.get('class', '').split())))}"
            if element.kids[-1:] != [look]:
                element.kids.append(look)
            node = digest(f"{element.node}/{look}")
            element = Element(node, (*element.chain, node), [])
            elements.append(element)
        stack.append((name, element, off, within or main))
    if at < len(page) and not re.match(r"<[a-zA-Z/!]", page[at:]):
        held.append(page[at:])
    close()
    return found, elements


def style_tree(pages: DataFrame, html_col: str, site_col: str) -> tuple[DataFrame, DataFrame]:
    """(node, content, n, size, pages, importance) of content nodes, (node, chain, pages, importance, low) of element nodes.

    The pages of a site share one tree: elements with equal looks under one node merge. A presentation of a node is
    the sequence of its children's looks, runs taken as one. By the entropy of Yi, Liu and Li (2003):

    - a content node, a text in an element node, has 1 less the entropy of the text over the pages that have the
      element, over the logarithm of their number: 1 where one page has the text, 0 where all have;
    - an element node without children has the mean of its texts, by length;
    - one with children has (1 - g) times the entropy of its presentations, over the logarithm of its pages, and g times
      the mean of its texts and children, by length, where g is 0.9 to the power of the number of its presentations.

    low is, for an importance below what was asked for, whether no element below is as important: chosen by low_marks().
    Nodes have their site in them. Pages of a site whose texts are equal are one page, so copies take nothing from a
    text. All counts are partial sums before a shuffle; the composition goes up by one row for each node and element
    above it, so no tree, however large its site, is held in a task.
    """

    def shown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts, looks = [], [], []
            for site, page in zip(*(batch.column(i).to_pylist() for i in (0, 1))):
                found, elements = parse(page or "", site)
                keys.append(content(elements[0].node, "\n".join(b.text for b in found if not b.apart)))
                texts.append([{"node": n, "content": c, "size": s} for (n, c), s in {(b.node, content(b.node, b.text)): len(b.text) for b in found if b.apart < _HIDDEN}.items()])
                met: set[int] = set()
                looks.append([])
                for node, chain, kids in dict.fromkeys((e.node, e.chain, tuple(e.kids)) for e in elements):
                    looks[-1].append({"node": node, "chain": chain, "look": digest("\0".join(kids)) if kids else 0, "first": int(node not in met)})
                    met.add(node)
            one, two = (pa.list_(pa.struct(x)) for x in ([(n, pa.int64()) for n in ("node", "content", "size")], [("node", pa.int64()), ("chain", pa.list_(pa.int64())), ("look", pa.int64()), ("first", pa.int64())]))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(texts, one), pa.array(looks, two)], names=["page", "texts", "looks"])

    schema = "page long, texts array<struct<node:long,content:long,size:long>>, looks array<struct<node:long,chain:array<long>,look:long,first:long>>"
    seen = materialize(pages.select(site_col, html_col).mapInArrow(shown, schema).dropDuplicates(["page"]))
    n = F.col("n").cast("double")
    looks = seen.select(F.inline("looks")).groupBy("node", "chain", "look").agg(F.count("*").alias("n"), F.sum("first").alias("first"))
    many = F.count_if(F.col("look") != 0) > 0
    spread = F.log(F.sum("n")) - F.sum(n * F.log(n)) / F.sum("n")
    shape = looks.groupBy("node", "chain").agg(F.sum("first").alias("pages"), F.when(many, F.pow(F.lit(DAMPING), F.count("*"))).otherwise(1.0).alias("g"), spread.alias("_spread"))
    shape = shape.withColumn("variety", F.when(F.col("pages") > 1, F.least(F.col("_spread") / F.log("pages"), F.lit(1.0))).otherwise(1.0)).drop("_spread")
    shape = materialize(shape)
    texts = seen.select(F.inline("texts")).groupBy("node", "content").agg(F.count("*").alias("n"), F.max("size").alias("size"))
    importance = F.when(F.col("pages") > 1, 1 - F.log("n") / F.log("pages")).otherwise(1.0)
    texts = materialize(texts.join(shape.select("node", "pages"), "node").withColumn("importance", importance))
    own = texts.groupBy("node").agg(F.sum(F.col("n") * F.col("size") * F.col("importance")).alias("value"), F.sum(F.col("n") * F.col("size")).alias("weight"))
    nodes = shape.join(own, "node", "left").fillna(0.0, ["value"]).fillna(0, ["weight"])
    # weight of all that is below a node, then what each node below adds to it, damped on the way up
    above = nodes.select("node", "weight", F.explode("chain").alias("top"))
    whole = above.groupBy(F.col("top").alias("node")).agg(F.sum("weight").alias("total"))
    nodes = materialize(nodes.join(whole, "node").filter("total > 0"))
    adds = F.col("g") * F.col("value") + (1 - F.col("g")) * F.col("variety") * F.col("total")
    above = nodes.select("node", adds.alias("adds"), (F.size("chain") - 1).alias("depth"), F.posexplode("chain").alias("at", "top"))
    damped = above.join(small(nodes.select(F.col("node").alias("top"), "g")), "top")
    up = Window.partitionBy("node").orderBy(F.desc("at")).rowsBetween(Window.unboundedPreceding, 0)
    passed = F.exp(F.sum(F.when(F.col("at") < F.col("depth"), F.log("g")).otherwise(0.0)).over(up))
    total = damped.withColumn("share", passed * F.col("adds")).groupBy(F.col("top").alias("node")).agg(F.sum("share").alias("share"))
    elements = nodes.join(total, "node").select("node", "chain", "pages", (F.col("share") / F.col("total")).alias("importance"))
    return texts, materialize(elements)


def low_marks(texts: DataFrame, elements: DataFrame, least: float) -> DataFrame:
    """(mark, lowest): content nodes of two pages or more with an importance below least; element nodes of two pages or
    more that are below it and have no element below them that isn't. lowest: the same holds for half of least."""
    marks = texts.filter((F.col("n") > 1) & (F.col("importance") < least)).select(F.col("content").alias("mark"), (F.col("importance") < least / 2).alias("lowest"))
    # of the elements below a node the greatest importance, itself included
    greatest = elements.select("importance", F.explode("chain").alias("node")).groupBy("node").agg(F.max("importance").alias("most"))
    branches = elements.filter("pages > 1").join(greatest, "node").filter(F.col("most") < least)
    return marks.union(branches.select("node", F.col("most") < least / 2)).groupBy("mark").agg(F.max("lowest").alias("lowest"))


def main_text(found: list[Block], low: set[int], lowest: set[int]) -> str:
    """The text of a page's blocks without low nodes; in an article or main element only the lowest are low.

    A low branch takes its short texts along; a block of PROSE characters goes only if it is low itself. Where most of
    the prose would go, the site's pages are near copies of each other, and it stays.
    """
    found = [b for b in found if not b.apart]
    if low:
        gone = []
        for b in found:
            marks = lowest if b.within else low
            gone.append(content(b.node, b.text) in marks or len(b.text) < PROSE and not marks.isdisjoint(b.chain))
        article = any(b.within for b in found)
        prose = [(len(b.text), x) for b, x in zip(found, gone) if len(b.text) >= PROSE and b.within == article]
        whole = 2 * sum(n for n, x in prose if x) > sum(n for n, _ in prose)
        found = [b for b, x in zip(found, gone) if not x or whole and b.within == article]
    prose = [0, 0]
    for b in found:
        prose[b.within] += len(b.text) if len(b.text) >= PROSE else 0
    if any(b.within for b in found) and prose[True] >= prose[False]:
        found = [b for b in found if b.within]
    return "\n\n".join(b.text for b in found)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: float = 0.3, most: int = MOST) -> DataFrame:
    """id, url, text, n_chars for each row of pages.

    Elements that stand apart by name, role, class or id go, inside an article too. Of what is left, the low nodes of
    its site's style tree go, on every page: see style_tree(), low_marks() and main_text(). A site is a host; a null
    url is a site of its own. Then, if article and main elements have text, and no less in blocks of PROSE characters
    than the rest of the page has in such blocks, they are the main text; else all that is left is. Blocks are joined
    in page order by two line breaks; white space in a block becomes one space, character references are decoded.

    A null or empty page has an empty text. Repeated rows and ids each give a row; a page's text depends on its html
    and host alone, so equal pages of a host have equal texts. A page of any length is taken whole. Other columns of
    pages are ignored. An empty table gives no rows.

    What goes to the pages are the low nodes: broadcast if there are no more than most of them, else joined to the
    pages that have them, by page and a salt, so that neither a site nor a page with many copies is one task's.
    """
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), F.lower(F.coalesce(F.regexp_extract(F.col(url_col), _HOST, 1), F.lit(""))).alias("site"))
    low = materialize(low_marks(*style_tree(rows, "html", "site"), least))
    few = low.limit(most + 1).count() <= most
    sent = pages.sparkSession.sparkContext.broadcast([{r["mark"] for r in low.collect() if r["lowest"] or every} for every in (True, False)] if few else None)

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, marks = [], [batch.column(4).to_pylist(), batch.column(5).to_pylist()] if batch.num_columns > 4 else None
            for r, (page, site) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())):
                low, lowest = sent.value if marks is None else (set(m[r] or ()) for m in marks)
                out.append(main_text(parse(page or "", site)[0], low, lowest))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], names=[id_col, url_col, "text", "n_chars"])

    schema = T.StructType([T.StructField(id_col, pages.schema[id_col].dataType), T.StructField(url_col, pages.schema[url_col].dataType), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    if few:
        return rows.mapInArrow(texts, schema)

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = []
            for page, site in zip(*(batch.column(i).to_pylist() for i in (1, 2))):
                found = [b for b in parse(page or "", site)[0] if not b.apart]
                marks.append(list({m for b in found for m in (content(b.node, b.text), *b.chain)}))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(marks, pa.list_(pa.int64()))], names=["page", "marks"])

    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    keyed = rows.withColumns({"page": F.sha2(F.concat_ws("\n", "site", F.coalesce("html", F.lit(""))), 256), "salt": F.pmod(F.xxhash64("id", F.monotonically_increasing_id()), F.lit(SALTS)).cast("int")})
    keyed = materialize(keyed)
    own = keyed.dropDuplicates(["page"]).select("page", "html", "site").mapInArrow(marked, "page string, marks array<long>").select("page", F.explode("marks").alias("mark"))
    own = own.withColumn("salt", F.pmod(F.xxhash64("page"), F.lit(SALTS)).cast("int"))
    gone = own.join(low.select("*", salts), ["mark", "salt"]).groupBy("page").agg(F.collect_set("mark").alias("low"), F.collect_set(F.when(F.col("lowest"), F.col("mark"))).alias("lowest"))
    joined = keyed.join(gone.select("*", salts), ["page", "salt"], "left")
    return joined.select("id", "url", "html", "site", "low", "lowest").mapInArrow(texts, schema)
