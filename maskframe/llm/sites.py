"""Main text of web pages by a style tree of each site.

The block elements of a page make a tree: an element's style is the sequence of its
children's tags, classes and ids.  Pages of one host are merged from the body down:
the children of two elements are the same node of the site's tree if the elements
are and their styles are equal.  A node of m pages has an importance between 0 and 1:
for an element with block children the entropy (base m) of the styles it has in them,
for one with text alone the entropy of its texts.  What looks and reads the same on
every page has 0.  An element's composite importance blends its own with that of its
children, more from the children the fewer styles it has.

What HTML itself says counts too.  Importance is weighted down in elements that are
navigation, notices, forms, comments and the like by tag, role, class or id, and
outside the article (or main part) where a page names one.  What a page names as
its article is measured as a whole, by its text.  A page then loses every branch that
is of low importance, itself and all below it; an article only if another one of the
page is left, because copies of an article within a site look like a menu.

Two passes read the pages.  One counts (node, style or text) of every site, combined
before the shuffle, so that a host with a third of all pages sends few rows.  The
other carries each page's blocks, compressed, to the importances of its layout.  Pages of
layouts that hold a thousandth of all pages or more, of which there are at most a thousand,
are spread over as many parts, and the layout's importances are repeated for each.
"""

from __future__ import annotations

import html
import json
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskframe.llm.store import stage

#: Fewer different pages than this say nothing about a node.
MIN_PAGES = 3
#: A layout with one page in so many or more is hot; there are at most as many hot layouts.
HOT_SHARE = 1_000
#: Branches of less importance go, if all in them are of less.
LEAST = 0.3
#: Weight of the own importance of an element with s styles is 1 - DECAY ** s.
DECAY = 0.9
#: Weight of what HTML says is not content: always below LEAST.
ASIDE = 0.2

# Fixed values of HTML: elements by how they are laid out, closed and read.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCKS = frozenset(
    """address article aside blockquote body caption center colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form
    h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li listing main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul""".split()
)
#: An open element of the second kind ends where one of the first begins, up to the third.
CLOSES = {
    "li": (("li",), ("ul", "ol", "menu", "dir")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "tbody": (("thead", "tbody", "tfoot", "tr", "td", "th"), ("table",)),
    "tfoot": (("thead", "tbody", "tfoot", "tr", "td", "th"), ("table",)),
    "option": (("option",), ("select", "datalist", "optgroup")),
}
ENDS_P = BLOCKS - frozenset("caption colgroup head html body tbody td tfoot th thead tr legend option optgroup".split())
HOLDS_P = frozenset("button table td th caption object template marquee applet html".split())
#: Never the main text.
ASIDE_TAGS = frozenset(
    "head title nav footer aside form search menu dialog script style textarea input select button label fieldset noscript template iframe object svg canvas audio video map noembed noframes datalist progress meter".split()
)
ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar status tablist tooltip".split())
#: Words of classes and ids: of parts that are never the article, and of parts that may be around it.
ASIDE_WORDS = frozenset(
    """ad ads adv advert adverts advertisement advertising adsense sponsor sponsored comment comments commentlist reply replies respond disqus discussion cookie cookies
    consent gdpr newsletter subscribe subscription signup login popup modal overlay share sharing social related recommended recommendations promo promotion breadcrumb breadcrumbs
    pagination pager notice notices notification copyright skip""".split()
)
AROUND_WORDS = frozenset("sidebar menu nav navbar navigation header footer masthead banner widget widgets toolbar search form alert legal topbar".split())

_TOKEN = re.compile(
    r"""<(?:!--(?:>|->|(?P<comment>.*?)(?:--!?>|\Z))|(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[\s/]*+[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+))?+)*+)[\s/]*+(?:>|(?P<cut>\Z))|[!?/][^>]*+(?:>|\Z))""",
    re.DOTALL,
)
_ATTR = re.compile(r"""([^\s/>=][^\s/>=]*+)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>"'][^\s>]*+)))?+""")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_DIGITS = re.compile(r"\d+")
_NUMBERS = re.compile(r"\b\d+\b")


def _digest(*parts: object) -> int:
    """A 64-bit hash, the same in every process."""
    return xxhash.xxh3_64_intdigest("\x1f".join(map(str, parts)).encode("utf-8", "surrogatepass")) - (1 << 63)


def _spaced(text: str) -> str:
    return " ".join(text.split())


def _unnumbered(text: str) -> str:
    """A text with letters, whatever its numbers are; a text without letters as it is."""
    return _NUMBERS.sub("0", text) if any(map(str.isalpha, text)) else text


class Page:
    """The tree of one page's block elements and of the texts between them, in page order; node 0 is the body."""

    def __init__(self, source: str) -> None:
        #: of every element: parent, block it belongs to, 0 to 2 for no aside, perhaps, surely; 0 to 2 for no part, main, article
        self.parent, self.block, self.aside, self.part = [0], [0], [0], [0]
        #: of every node: parent and mark (tag, class and id), and what texts say, piece by piece with its element
        self.nodes: list[tuple[int, str]] = [(0, "body")]
        self.texts: dict[int, list[tuple[int, str]]] = {}
        self.open: list[tuple[str, int]] = [("body", 0)]
        self.count: dict[str, int] = {}  # of open elements by tag, so that deep pages are not searched for what is not open
        self.said: list[tuple[int, str]] = []
        self._read(source)
        self._flush()
        self._settle()

    def _flush(self) -> None:
        if any(t and not t.isspace() for _, t in self.said):
            self.texts[len(self.nodes)] = self.said
            self.nodes.append((self.block[self.open[-1][1]], "#text"))
        self.said = []

    def _pop(self, to: int) -> None:
        """Close the open elements from place ``to`` on."""
        if any(tag in BLOCKS for tag, _ in self.open[to:]):
            self._flush()
        for tag, _ in self.open[to:]:
            self.count[tag] -= 1
        del self.open[to:]

    def _start(self, tag: str, attrs: str) -> None:
        if tag in ("html", "body"):
            return
        if tag in ENDS_P and self.count.get("p"):
            for k in range(len(self.open) - 1, 0, -1):
                if self.open[k][0] == "p":
                    self._pop(k)
                    break
                if self.open[k][0] in HOLDS_P:
                    break
        if tag in CLOSES and any(map(self.count.get, CLOSES[tag][0])):
            ends, up_to = CLOSES[tag]
            last = None
            for k in range(len(self.open) - 1, 0, -1):
                if self.open[k][0] in up_to:
                    break
                if self.open[k][0] in ends:
                    last = k
            if last is not None:
                self._pop(last)
        above = self.open[-1][1]
        mark, aside, part = tag, 2 if tag in ASIDE_TAGS else 1 if tag == "header" else 0, 2 if tag == "article" else 1 if tag == "main" else 0
        if attrs.strip(" \t\r\n\f/"):
            of = {}
            for name, *values in _ATTR.findall(attrs):
                of.setdefault(name.lower(), html.unescape(next(filter(None, values), "")))
            role = of.get("role", "").lower().strip()
            part = {"article": 2, "main": 1}.get(role, part)
            words = {w.lower() for w in _WORDS.findall(f"{of.get('class', '')} {of.get('id', '')}")}
            if words & ASIDE_WORDS and not (part and not words & {"comment", "comments", "reply"}):
                aside = 2
            elif words & AROUND_WORDS and not part:
                aside = max(aside, 1)
            if role in ASIDE_ROLES or "hidden" in of or of.get("aria-hidden", "").lower() == "true" or _HIDDEN.search(of.get("style", "")):
                aside = 2
            mark = _DIGITS.sub("0", f"{tag}.{' '.join(sorted(of.get('class', '').split()))}#{of.get('id', '')}")
        if tag == "br":
            self.said.append((above, " "))
        if tag in BLOCKS:
            self._flush()
        if tag in VOID:
            return
        me = len(self.parent)
        self.parent.append(above)
        self.aside.append(aside)
        self.part.append(part)
        if tag in BLOCKS:
            self.block.append(len(self.nodes))
            self.nodes.append((self.block[above], mark))
        else:
            self.block.append(self.block[above])
        self.open.append((tag, me))
        self.count[tag] = self.count.get(tag, 0) + 1

    def _end(self, tag: str) -> None:
        if tag in ("html", "body") or not self.count.get(tag):
            return
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k][0] == tag:
                self._pop(k)
                return
            if tag not in BLOCKS and self.open[k][0] in BLOCKS:
                return

    def _read(self, source: str) -> None:
        at, n = 0, len(source)
        while at < n:
            lt = source.find("<", at)
            if lt != at:
                lt = n if lt < 0 else lt
                self.said.append((self.open[-1][1], html.unescape(source[at:lt])))
                at = lt
                continue
            found = _TOKEN.match(source, at)
            if found is None:  # a sign, not a tag
                self.said.append((self.open[-1][1], "<"))
                at += 1
                continue
            at = found.end()
            tag = found["tag"]
            if tag is None or found["cut"] is not None:
                continue
            tag = tag.lower()
            if found["end"]:
                self._end(tag)
                continue
            self._start(tag, found["attrs"])
            if tag in RAW:
                close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(source, at)
                at = close.start() if close else n

    def _settle(self) -> None:
        """Which elements are asides, once it is known which of them hold the article, and the weights of nodes."""
        up, count = self.parent, len(self.parent)
        sure, holds = [False] * count, [False] * count
        for e in range(1, count):
            sure[e] = sure[up[e]] or self.aside[e] == 2
            if self.part[e] and not sure[e]:
                at = e
                while at and not holds[at]:
                    holds[at], at = True, up[at]
        self.off, area = [False] * count, [0] * count
        for e in range(1, count):
            self.off[e] = self.off[up[e]] or sure[e] or (self.aside[e] == 1 and not holds[e] and not area[up[e]])
            area[e] = max(area[up[e]], 0 if self.off[e] else self.part[e])
        element = dict(zip(reversed(self.block), range(count - 1, -1, -1), strict=True))  # the first of every block
        owner = [self.nodes[k][0] if k in self.texts else k for k in range(len(self.nodes))]
        self.area = [area[element[k]] for k in owner]
        aside = [self.off[element[k]] for k in owner]
        named = max((self.area[k] for k in self.texts if not aside[k]), default=0)
        self.weight = [ASIDE if a or at < named else 1.0 for a, at in zip(aside, self.area, strict=True)]

    def inside(self, k: int) -> bool:
        """Whether a node lies within the named article, below its element."""
        return self.area[k] == 2 and k > 0 and self.area[self.nodes[k][0]] == 2


def site_tree(page: Page, host: str, measured: bool = True) -> tuple[int, list[list], list[list]]:
    """Layout of a page, its nodes in the site's tree, and its blocks.

    A node: parent, id, its style or text, weight, and 2 for an article, 1 for what has block
    children, 0 for texts.  A block: node (within an article the article's, which is measured as a
    whole), and what is said there, without inline asides.  Articles of pages that are not
    ``measured`` get no style, which only counting needs.
    """
    children: list[list[int]] = [[] for _ in page.nodes]
    for k in range(1, len(page.nodes)):
        children[page.nodes[k][0]].append(k)
    said = {k: _spaced("".join(t for _, t in pieces)) for k, pieces in page.texts.items()}

    def value(k: int) -> int:
        if k in said:
            return _digest("#text", _unnumbered(said[k]))
        alone = children[k]
        return value(alone[0]) if len(alone) == 1 and alone[0] in said else _digest(*(page.nodes[c][1] for c in alone))

    def whole(k: int) -> int:
        """The text of a named article, whatever its blocks are."""
        found, todo = [], [k]
        while todo:
            at = todo.pop()
            if at in said:
                found.append(said[at])
            else:
                todo += reversed(children[at])
        return _digest("#article", _unnumbered(" ".join(found)))

    root = value(0)
    layout = _digest(host, root)
    ids, place, nodes, blocks = {0: (layout, root)}, {}, [], []
    for k, (up, _) in enumerate(page.nodes):
        within = page.inside(k)
        alone = k in said and len(children[up]) == 1
        if within or alone:
            place[k] = place[up]  # an article is a leaf, and an element with one text
        else:
            node, style = ids[k]
            if page.area[k] == 2:
                style = whole(k) if measured else 0
            place[k] = len(nodes)
            leaf = k in said or (len(children[k]) == 1 and children[k][0] in said)
            nodes.append([place[up] if k else -1, node, style, page.weight[k], 2 if page.area[k] == 2 else 0 if leaf else 1])
            if not leaf:
                ids |= {c: (_digest(node, style, n), value(c)) for n, c in enumerate(children[k]) if not page.inside(c)}
        if k in said:
            # a block that is an aside goes with its branch, within the article it goes here
            stays = said[k] if page.weight[k] < 1 and not within else _spaced("".join(t for e, t in page.texts[k] if not page.off[e]))
            if stays:
                blocks.append([place[k], stays])
    return layout, nodes, blocks


def main_text(nodes: list[list], blocks: list[list], known: dict[int, tuple[float, int]]) -> str:
    """What stays of a page; ``known`` has importance and number of styles of the nodes that enough pages have."""
    count = len(nodes)
    # copies of an article look like a menu: the least important go only if others are left
    left = max((known.get(node, (1.0, 1))[0] for _, node, _, kind in nodes if kind == 2), default=0.0) >= LEAST
    below, born, noisy = [0.0] * count, [0] * count, [True] * count
    for k in range(count - 1, -1, -1):
        up, node, weight, kind = nodes[k]
        importance, styles = known.get(node, (1.0, 1))
        if kind == 1 and born[k]:
            share = DECAY**styles
            importance = (1 - share) * importance + share * below[k] / born[k]
        importance = 1.0 if kind == 2 and not (left and importance < LEAST) else weight * importance
        noisy[k] = noisy[k] and importance < LEAST
        if up >= 0:
            below[up] += importance
            born[up] += 1
            noisy[up] = noisy[up] and noisy[k]
    gone = [False] * count
    for k in range(count):
        up = nodes[k][0]
        gone[k] = noisy[k] or (up >= 0 and gone[up])
    return "\n\n".join(text for k, text in blocks if not gone[k])


HOST = r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)"
SEEN = pa.schema([("layout", pa.int64()), ("node", pa.int64()), ("style", pa.int64()), ("page", pa.int64())])
CARRIED = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("layout", pa.int64()), ("made", pa.binary())])
TEXT = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string())])


def _sites(pages: DataFrame) -> DataFrame:
    """``page_id``, ``url``, ``host`` (empty if there is none) and ``html`` of all pages."""
    url = F.col("url").cast("string")
    host = F.lower(F.coalesce(F.regexp_extract(url, HOST, 1), F.lit("")))
    return pages.select(F.col("page_id").cast("long"), url.alias("url"), host.alias("host"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))


def site_importance(pages: DataFrame) -> DataFrame:
    """``layout``, number of its pages, and ``nodes`` (node, importance, styles) that at least MIN_PAGES different pages have.

    A style or text that only copies of one page have counts once, like any other page's.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[int, int, int, int]] = []
            for host, source in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                layout, nodes, _ = site_tree(Page(source), host)
                page = _digest(source)
                out += [(layout, node, style, page) for _, node, style, _, _ in nodes]
            if out:
                yield pa.record_batch([pa.array(c, type=pa.int64()) for c in zip(*out, strict=True)], schema=SEEN)

    seen = _sites(pages).where("host != '' AND html != ''").select("host", "html").mapInArrow(rows, "layout long, node long, style long, page long")
    styles = seen.groupBy("layout", "node", "style").agg(F.count("*").alias("pages"), F.min("page").alias("a"), F.max("page").alias("b"))
    styles = styles.withColumn("n", F.when(F.col("a") == F.col("b"), 1).otherwise(F.col("pages")).cast("double"))
    nodes = styles.groupBy("layout", "node").agg(F.sum("n").alias("m"), F.sum(F.col("n") * F.log("n")).alias("s"), F.count("*").alias("styles"), F.sum("pages").alias("pages"))
    known, top = F.col("m") >= MIN_PAGES, F.col("node") == F.col("layout")
    importance = F.greatest(F.lit(0.0), 1 - F.col("s") / F.col("m") / F.log("m"))
    measured = F.when(known, F.struct("node", importance.alias("importance"), "styles"))
    return nodes.where(known | top).groupBy("layout").agg(F.max(F.when(top, F.col("pages"))).alias("pages"), F.collect_list(measured).alias("nodes"))


def extract(pages: DataFrame) -> DataFrame:
    """``page_id``, ``url`` and ``text``, the main text of the whole ``html``, of every row.

    Blocks follow in page order, two line feeds apart; white space within a block is one
    space; character references are decoded.  Null and empty pages have an empty text.
    Pages without a host (also a null ``url``) are sites of their own.  Repeated rows and ids
    are rows of their own, null ids stay null.  Other columns are left out.
    """

    def carry(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            out = []
            for page_id, url, host, source in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                layout, nodes, blocks = site_tree(Page(source), host or f"page {page_id} {url}", measured=False)
                slim = [[up, node, weight, kind] for up, node, _, weight, kind in nodes]
                out.append((page_id, url, layout, packer.compress(json.dumps([slim, blocks], ensure_ascii=False).encode())))
            if out:
                yield pa.record_batch([pa.array(c, type=t) for c, t in zip(zip(*out, strict=True), CARRIED.types, strict=True)], schema=CARRIED)

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpacker = zstandard.ZstdDecompressor()
        for batch in batches:
            texts = []
            for made, known in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                nodes, blocks = json.loads(unpacker.decompress(made))
                texts.append(main_text(nodes, blocks, {k["node"]: (k["importance"], k["styles"]) for k in known or ()}))
            if texts:
                yield pa.record_batch([batch.column(0), batch.column(1), pa.array(texts, type=pa.string())], schema=TEXT)

    carried = _sites(pages).mapInArrow(carry, "page_id long, url string, layout long, made binary")
    known = stage(site_importance(pages), "sites")
    total = known.agg(F.sum("pages")).first()[0] or 1
    hot = known.select("layout", F.floor(F.col("pages") * HOT_SHARE / total).cast("int").alias("spread")).where("spread > 0")
    known = known.where(F.size("nodes") > 0).join(F.broadcast(hot), "layout", "left")
    known = known.select("layout", "nodes", F.explode(F.sequence(F.lit(0), F.coalesce("spread", F.lit(1)) - 1)).alias("part"))
    part = F.pmod(F.xxhash64("page_id", "url"), F.coalesce("spread", F.lit(1))).cast("int")
    carried = carried.join(F.broadcast(hot), "layout", "left").withColumn("part", part)
    joined = carried.join(known, ["layout", "part"], "left").select("page_id", "url", "made", "nodes")
    return joined.mapInArrow(decide, "page_id long, url string, text string")
